"""Scalar text functions, all as column expressions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, functions as F

# Line separators that end a line of text.
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"

# White space of Unicode.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"

# Secrets that are masked in texts, with what takes their place.
SECRETS = (
    (r"ghp_[A-Za-z0-9]{20,}", "ghp_****"),
    (r"sk-ant-[A-Za-z0-9\-_]{20,}", "sk-ant-****"),
    (r"AKIA[0-9A-Z]{16}", "AKIA****"),
    (r"(?i)(password|secret|token|api_key)\s*=\s*['\"][^'\"]{6,}['\"]", "$1=****"),
)


def to_lines(text: Column) -> Column:
    """The lines of a text; a line break at the end opens no further line. Null and empty: none."""
    # Through a lambda's variable, so that the text is split once.
    whole = lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, F.lit(1), F.size(p) - 1)).otherwise(p)
    return F.element_at(F.transform(F.array(F.split(F.coalesce(text, F.lit("")), LINE_BREAK)), whole), 1)


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.trim(text, F.lit(WHITE))


def squeeze(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Lower-case text after the last dot of the base name, empty if it has none."""
    return F.lower(F.regexp_extract(base_name(path), r"\.([^.]*)$", 1))


def stem(path: Column) -> Column:
    """The base name without its last extension."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def leaf(name: Column) -> Column:
    """Text after the last dot."""
    return F.substring_index(name, ".", -1)


def slug(text: Column, size: int = 60) -> Column:
    """Lower case, other than letters and digits as ``-``, at most ``size`` characters."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, size)


def first_sentence(text: Column, size: int = 120) -> Column:
    """Up to the first ``. ``, else ``! ``, else ``? ``; cut at ``size`` characters with an ellipsis."""
    flat = F.replace(strip(text), F.lit("\n"), F.lit(" "))
    out = flat
    for mark in ("? ", "! ", ". "):
        out = F.when(flat.contains(mark), F.concat(F.substring_index(flat, mark, 1), F.lit(mark[0]))).otherwise(out)
    return F.concat(F.substring(out, 1, size), F.when(F.char_length(out) > size, "…").otherwise(""))


def truncated(content: Column, name: Column, cap: Column) -> Column:
    """``content`` cut to at most ``cap`` characters at a safe place, with a marker.

    SQL is cut after the last ``;`` (and the line feed behind it), Python after the last blank line
    or else line feed, all else after the last line feed; if there is none, at the cap itself.
    """
    window = F.substring(content, F.lit(1), cap)
    after = lambda mark: F.when(F.instr(window, mark) > 0, F.char_length(window) - F.char_length(F.substring_index(window, mark, -1)))
    statement = after(";")
    statement = statement + F.when(F.substring(content, statement + 1, F.lit(1)) == "\n", 1).otherwise(0)
    feed = after("\n")
    place = F.when(name.endswith(".sql"), statement).when(name.endswith(".py"), F.coalesce(after("\n\n"), feed)).otherwise(feed)
    place = F.coalesce(place, cap)
    marker = F.concat(F.lit("\n-- [truncated: "), (F.char_length(content) - place).cast("string"), F.lit(" bytes omitted]\n"))
    return F.when(F.char_length(content) <= cap, content).otherwise(F.concat(F.substring(content, F.lit(1), place), marker))


def normalized_comment(text: Column) -> Column:
    """A comment without names in capitals and with numbers as ``N``, lower-cased, single-spaced."""
    out = F.regexp_replace(text, r"\b[A-Z][A-Z0-9]*(?:\.[A-Z][A-Z0-9_]*)+\b", "")
    out = F.regexp_replace(out, r"\b[A-Z][A-Z0-9_]{3,}\b", "")
    return squeeze(F.lower(F.regexp_replace(out, r"\b\d+\b", "N")))


def redacted(text: Column) -> Column:
    """Known secrets masked."""
    for pattern, mask in SECRETS:
        text = F.regexp_replace(text, pattern, mask)
    return text


def masked_value(text: Column) -> Column:
    """Quoted values of four or more characters masked."""
    return F.regexp_replace(text, r"([\"'])[A-Za-z0-9+/\-_]{4,}([\"'])", "$1****$2")


def masked_key(text: Column) -> Column:
    """First and last four characters of a key of more than eight; stars for a shorter one."""
    return F.when(F.char_length(text) > 8, F.concat(F.substring(text, 1, 4), F.lit("****"), F.right(text, F.lit(4)))).otherwise("****")


def glob(pattern: str) -> str:
    """A shell pattern as an anchored regular expression; ``*`` crosses ``/``."""
    out = ""
    for c in pattern:
        out += ".*" if c == "*" else "." if c == "?" else c if c.isalnum() or c in "_/-" else f"\\{c}"
    return f"(?s)^{out}$"


def matches_glob(path: Column, patterns: list[str] | tuple[str, ...]) -> Column:
    """Whether the path or its base name has one of the shell patterns."""
    out = F.lit(False)
    for p in patterns:
        out = out | path.rlike(glob(p)) | base_name(path).rlike(glob(p))
    return out


def parsed_date(stamp: Column, date: Column, modified: Column) -> Column:
    """Unix seconds: the stamp, else the date with or without time (a zone name is cut off), else ``modified``."""
    clean = F.regexp_replace(strip(date), r"\s+[A-Z]{2,5}$", "")
    timed = F.coalesce(F.try_to_timestamp(clean, F.lit("yyyy-MM-dd HH:mm")), F.try_to_timestamp(clean, F.lit("yyyy-MM-dd")))
    return F.coalesce(stamp.try_cast("double"), F.unix_timestamp(timed).cast("double"), modified)


def age_label(seconds: Column) -> Column:
    """A short name of an age."""
    minutes, hours, days = (F.floor(seconds / n).cast("string") for n in (60, 3600, 86_400))
    return (
        F.when(seconds < 60, "just now")
        .when(seconds < 3600, F.concat(minutes, F.lit("m ago")))
        .when(seconds < 86_400, F.concat(hours, F.lit("h ago")))
        .otherwise(F.concat(days, F.lit("d ago")))
    )


def object_name(database: Column, schema: Column, name: Column) -> Column:
    """``Db.Schema.Object`` of the parts that are there, without stray dots."""
    part = lambda c: F.nullif(F.regexp_replace(F.trim(c), r"^\.+|\.+$", ""), F.lit(""))
    return F.concat_ws(".", part(database), part(schema), part(name))


def name_parts(raw: Column) -> Column:
    """A reference of up to three parts as ``struct(catalog, schema, table)``, quotes taken off."""
    parts = F.split(F.regexp_replace(raw, "[`\"\\[\\]]", ""), r"\.")
    n = F.size(parts)
    at = lambda back: F.nullif(F.trim(F.get(parts, n - back)), F.lit(""))
    return F.struct(F.when(n >= 3, at(3)).alias("catalog"), F.when(n >= 2, at(2)).alias("schema"), at(1).alias("table"))


def repo_slug(text: Column) -> Column:
    """``struct(owner, repo, number)`` of ``owner/repo`` or the URL of a pull request."""
    pattern = r"^(?:https?://[^/]+/)?([^/\s]+)/([^/\s#]+?)(?:\.git)?(?:/pull/(\d+).*)?$"
    got = lambda n: F.nullif(F.regexp_extract(F.trim(text), pattern, n), F.lit(""))
    return F.struct(got(1).alias("owner"), got(2).alias("repo"), got(3).cast("int").alias("number"))


def substituted(template: Column, values: dict[str, Column]) -> Column:
    """A template with each ``{{key}}`` replaced."""
    for key, value in values.items():
        template = F.replace(template, F.lit("{{" + key + "}}"), value)
    return template


def list_or_object(text: Column, element: str) -> Column:
    """JSON that is a list of objects or a single one, fences around it taken off, as an array."""
    bare = F.regexp_replace(F.trim(text), r"(?s)^```[a-z]*\s*|\s*```$", "")
    return F.coalesce(F.from_json(bare, f"array<{element}>"), F.array(F.from_json(bare, element)))


def front_matter(text: Column) -> Column:
    """The keys and values between ``---`` lines at the start, as a map; of equal keys the last."""
    body = F.regexp_extract(text, r"(?s)^---\n(.*?)\n---\n", 1)
    pair = lambda x: F.struct(strip(F.substring_index(x, ":", 1)).alias("k"), strip(F.substring(x, F.instr(x, ":") + 1, F.char_length(x))).alias("v"))
    keyed = F.filter(F.transform(F.filter(to_lines(body), lambda x: x.contains(":")), pair), lambda p: p["k"] != "")
    # Through a lambda's variable, so that the pairs are made once and not for each of them again.
    last = lambda ps: F.filter(ps, lambda p, i: ~F.exists(F.slice(ps, i + 2, F.size(ps)), lambda q: q["k"] == p["k"]))
    return F.element_at(F.transform(F.array(keyed), lambda ps: F.map_from_entries(last(ps))), 1)


def hmac_sha256(body: Column, key: str) -> Column:
    """Hexadecimal HMAC-SHA256 of a binary column under a key that is known when the plan is made."""
    raw = key.encode()
    raw = hashlib.sha256(raw).digest() if len(raw) > 64 else raw
    pads = [bytes(b ^ pad for b in raw.ljust(64, b"\0")) for pad in (0x36, 0x5C)]
    inner = F.unhex(F.sha2(F.concat(F.lit(bytearray(pads[0])), body), 256))
    return F.sha2(F.concat(F.lit(bytearray(pads[1])), inner), 256)


def signed(body: Column, signature: Column, key: str) -> Column:
    """Whether ``signature`` is ``sha256=`` and the body's HMAC; always true without a key."""
    return F.coalesce(F.concat(F.lit("sha256="), hmac_sha256(body, key)) == signature, F.lit(False)) if key else F.lit(True)
