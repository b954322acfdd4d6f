"""WARC files, and revisits that stand for a page that had not changed.

Records are written as one gzip member each, so a record can be read alone by file and offset.
Revisits are resolved on header rows; payloads stay where they are. An as-of join by canonical URL
gives each revisit the latest earlier full response. If the validators agree, the headers that a
304 answer may update are merged into those of the response.

The as-of join works on distinct (URL, date) pairs, made by an aggregation that is combined before
the shuffle, and goes in two levels: pairs are dealt by URL and time bucket, the last response of each
bucket is carried on to later buckets, and within a bucket a running window finds the last one. So a
group is at most as long as a bucket has moments, or a URL's history has buckets, however many
captures there are.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from lumenspan.llm import shared, urls
from lumenspan.llm.tokens import filesystem

#: Headers that a 304 answer never updates.
NOT_MERGED = (
    *("connection", "keep-alive", "proxy-authenticate", "proxy-authorization", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade"),
    *("content-encoding", "content-length", "content-range", "content-type"),
)
BUCKET_SECONDS, PIECE = 86_400, 1 << 16
HEADERS = "array<struct<name: string, value: string>>"
#: Columns of records to write; ``payload`` is the HTTP body.
RECORDS = f"record_id string, type string, url string, date timestamp, status int, headers {HEADERS}, profile string, payload binary"


def payload_digest(payload: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()  # noqa: S324  the format's usual digest


_LINE_ENDS = re.compile(r"[\r\n]+")


def _line(text: str | None) -> str:
    return _LINE_ENDS.sub(" ", text) if text else ""


def utc(micros: int | None) -> str | None:
    """A moment in ISO form, with a fraction only where it has one."""
    return None if micros is None else str(np.datetime64(micros, "us")).removesuffix(".000000") + "Z"


def format_record(r: dict) -> bytes:
    """One record, not compressed. ``date`` is text in ISO form. Line ends in values become spaces."""
    payload = r["payload"] or b""
    http = [f"HTTP/1.1 {r['status'] if r['status'] is not None else 200} -"] + [f"{_line(h['name'])}: {_line(h['value'])}" for h in r["headers"] or ()]
    block = "\r\n".join(http).encode() + b"\r\n\r\n" + payload
    head = ["WARC/1.1", f"WARC-Type: {_line(r['type'])}"]
    fields = (("WARC-Record-ID", r["record_id"]), ("WARC-Target-URI", r["url"]), ("WARC-Date", r["date"]), ("WARC-Profile", r["profile"]))
    head += [f"{name}: {_line(value)}" for name, value in fields if value is not None]
    if payload:
        head.append(f"WARC-Payload-Digest: {payload_digest(payload)}")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fields(lines: list[str]) -> list[tuple[str, str]]:
    """Names and values; a line that begins with white space goes on with the value before it."""
    out: list[tuple[str, str]] = []
    for x in lines:
        if x[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {x.strip()}".strip())
        else:
            name, colon, value = x.partition(":")
            if colon:
                out.append((name.strip(), value.strip()))
    return out


def _text(raw: bytes) -> str:
    """Header bytes as text: UTF-8, or where they aren't, Latin-1."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def parse_record(data: bytes) -> dict | None:
    """A record as a dict; None if it isn't one. Header names keep their case, values lose outer spaces.

    ``problem`` is "truncated" where the block is shorter than the record says, else null.
    """
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        return None
    fields = {k.lower(): v for k, v in _fields(lines[1:])}
    size = fields.get("content-length", "")
    size = int(size) if size.isdigit() else len(rest)
    block, status, headers = rest[:size], None, []
    payload = block
    if block.startswith(b"HTTP/"):
        http, _, payload = block.partition(b"\r\n\r\n")
        first, *others = _text(http).split("\r\n")
        code = first.split(" ")[1:2]
        status = int(code[0]) if code and code[0].isdigit() else None
        headers = [{"name": k, "value": v} for k, v in _fields(others)]
    own = {"record_id": "warc-record-id", "type": "warc-type", "url": "warc-target-uri", "date": "warc-date", "profile": "warc-profile", "digest": "warc-payload-digest"}
    problem = None if found and len(block) == size else "truncated"
    return {k: fields.get(v) for k, v in own.items()} | {"status": status, "headers": headers, "payload": payload, "problem": problem}


def records(pieces: Iterator[bytes]) -> Iterator[tuple[int, int | None, int, bytes, str | None]]:
    """(offset, length, inside, content, problem) of each record of a file that comes in pieces.

    A file that begins like gzip is members, of one record or of several: ``inside`` is where a record
    begins in its member's content, and the length is null where the member holds more than it. Any
    other file has plain records. The problem is "truncated" for a record that the file ends in,
    "corrupt" where the file can't be read on; else it is null.
    """
    first = b""
    for piece in pieces:
        first += piece
        if len(first) >= 2:
            break
    whole = _chained(first, pieces)
    if first[:2] == b"\x1f\x8b":
        yield from _zipped(whole)
    else:
        for at, n, content, problem in _plain(whole):
            yield at, n, 0, content, problem


def members(pieces: Iterator[bytes]) -> Iterator[tuple[int, int | None, bytes, str | None]]:
    """(offset, length, content, problem) of each record."""
    for at, n, _, content, problem in records(pieces):
        yield at, n, content, problem


def _chained(first: bytes, pieces: Iterator[bytes]) -> Iterator[bytes]:
    if first:
        yield first
    yield from pieces


class _Gzip:
    """The members of a gzip file, one after another, each as pieces of its content."""

    def __init__(self, pieces: Iterator[bytes]) -> None:
        self.pieces, self.rest, self.at, self.problem = pieces, b"", 0, None

    def more(self) -> bool:
        while not self.rest and (piece := next(self.pieces, None)) is not None:
            self.rest = piece
        return bool(self.rest)

    def member(self) -> Iterator[bytes]:
        machine = zlib.decompressobj(31)
        while not machine.eof:
            if not self.more():
                self.problem = "truncated"
                return
            piece, self.rest = self.rest, b""
            try:
                content = machine.decompress(piece, PIECE)
                while len(content) == PIECE or machine.unconsumed_tail:
                    yield content
                    content = machine.decompress(machine.unconsumed_tail, PIECE)
            except zlib.error:
                self.at += len(piece)
                self.problem = "corrupt"
                return
            self.rest = machine.unused_data
            self.at += len(piece) - len(self.rest)
            if content:
                yield content


def _zipped(pieces: Iterator[bytes]) -> Iterator[tuple[int, int | None, int, bytes, str | None]]:
    file = _Gzip(pieces)
    while file.problem is None and file.more():
        begin, content, first = file.at, file.member(), b""
        for piece in content:
            first += piece
            if len(first.lstrip(b"\r\n")) >= 5:
                break
        if not first.lstrip(b"\r\n").startswith(b"WARC/"):
            data = b"".join((first, *content))
            yield begin, file.at - begin, 0, data, file.problem
            continue
        held, several = None, False
        for inside, _, data, problem in _plain(_chained(first, content)):
            if held is not None:
                several = True
                yield begin, None, *held
            held = inside, data, problem
        for _ in content:  # what follows a record that can't be read on
            pass
        if held is not None:
            yield begin, None if several else file.at - begin, held[0], held[1], file.problem or held[2]


def _plain(pieces: Iterator[bytes]) -> Iterator[tuple[int, int, bytes, str | None]]:
    held, at, ended = bytearray(), 0, False

    def more(n: int) -> bool:
        """Whether at least ``n`` bytes are held."""
        nonlocal ended
        while len(held) < n and not ended:
            piece = next(pieces, b"")
            held.extend(piece)
            ended = not piece
        return len(held) >= n

    while True:
        while more(1) and held[:1] in (b"\r", b"\n"):
            del held[0]
            at += 1
        if not held:
            return
        if not (more(5) and held.startswith(b"WARC/")):
            yield at, len(held), bytes(held), "corrupt"
            return
        looked = 0
        while (end := held.find(b"\r\n\r\n", max(0, looked - 3))) < 0:
            looked = len(held)
            if not more(looked + 1):
                yield at, len(held), bytes(held), "truncated"
                return
        size = re.search(rb"\r\ncontent-length:[ \t]*(\d+)", held[: end + 2], re.IGNORECASE)
        if size is None:
            yield at, len(held), bytes(held), "corrupt"
            return
        n = end + 4 + int(size[1])
        if not more(n):
            yield at, len(held), bytes(held), "truncated"
            return
        yield at, n, bytes(held[:n]), None
        del held[:n]
        at += n


def write_warc(records: DataFrame, folder: str) -> DataFrame:
    """Write records to ``.warc.gz`` files, one a task; gives ``(path, n_records)`` of each.

    ``records`` has the columns of ``RECORDS``; null urls, dates, profiles and payloads are left out
    of the record, a null status is 200. Dates are written in UTC, whatever the session's zone. Line
    ends within a header's name or value become one space, all else is kept. Repeated rows are
    repeated records; very long payloads are one record; an empty table makes no file. Files of tasks
    that ran again are not in the result.
    """
    store, place = filesystem(folder)
    store.create_dir(place, recursive=True)
    date = F.unix_micros("date").alias("date")
    rows = records.select("record_id", "type", "url", date, "status", "headers", "profile", "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n = None, 0
        path = f"{folder}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for r in batch.slice(at, 64).to_pylist():
                    r["date"] = utc(r["date"])
                    if out is None:
                        store, place = filesystem(path)
                        out = store.open_output_stream(place, compression=None)
                    machine = zlib.compressobj(1, zlib.DEFLATED, 31)
                    out.write(machine.compress(format_record(r)) + machine.flush())
                    n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "n_records": [n]})

    return shared.cut(shared.arrow(rows, run, "path string, n_records long"), "warc-manifest")


def read_warc(files: DataFrame, with_payload: bool = False) -> DataFrame:
    """Records of the files named in ``path``: headers, and where each lies (``path``, ``offset``,
    ``length``, ``inside``). The payload comes only where asked for.

    Files may be gzip or plain; a member may hold one record or several (``inside`` tells them apart,
    ``length`` is null then). Header lines are UTF-8 or else Latin-1. ``problem`` is null for a whole record, else
    "truncated" (the file or record ends early) or "corrupt" (the rest of the file can't be read: one
    row with the place, and what could be read of the record); members that hold something else are
    "no record". Fractions of seconds are kept, dates without a zone are UTC, what is no date is null.
    Header lines may be folded. An empty file or table gives no rows.
    """
    fields = f"record_id string, type string, url string, date string, status int, headers {HEADERS}, profile string, digest string, problem string"
    schema = f"{fields}, path string, offset long, length long, inside long" + ", payload binary" * with_payload
    kinds = [
        *((c, pa.string()) for c in ("record_id", "type", "url", "date")),
        ("status", pa.int32()),
        ("headers", pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))),
        *((c, pa.string()) for c in ("profile", "digest", "problem", "path")),
        *((c, pa.int64()) for c in ("offset", "length", "inside")),
        *[("payload", pa.binary())] * with_payload,
    ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, place = filesystem(path)
                held, size = [], 0
                with store.open_input_stream(place, compression=None) as file:
                    for offset, length, inside, data, problem in records(iter(lambda: file.read(PIECE), b"")):  # noqa: B023
                        r = parse_record(data) or {"problem": "no record"}
                        held.append(r | {"problem": problem or r["problem"], "path": path, "offset": offset, "length": length, "inside": inside})
                        size += len(data) if with_payload else 1000
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pylist(held, pa.schema(kinds))
                            held, size = [], 0
                yield pa.RecordBatch.from_pylist(held, pa.schema(kinds))

    n = max(1, files.count())
    found = shared.arrow(files.select("path").repartition(n, "path"), run, schema)
    date = F.col("date")
    for n, rest in ((4, "-01-01"), (7, "-01")):
        date = F.when(F.char_length(date) == n, F.concat(date, F.lit(rest))).otherwise(date)
    date = F.when(date.rlike(r"(Z|[+-]\d\d:?\d\d)$") & date.contains("T"), date).when(date.contains("T"), F.concat(date, F.lit("Z"))).otherwise(F.concat(date, F.lit("T00:00:00Z")))
    return found.withColumn("date", F.try_to_timestamp(date))


def read_payload(path: str, offset: int, length: int | None, inside: int = 0) -> bytes | None:
    """The body of one record, from its place."""
    store, place = filesystem(path)
    with store.open_input_file(place) as file:
        if length is not None:
            pieces = iter([file.read_at(length, offset)])
        else:
            file.seek(offset)
            pieces = iter(lambda: file.read(PIECE), b"")
        found = next((content for _, _, at, content, _ in records(pieces) if at == inside), None)
    r = parse_record(found) if found is not None else None
    return r and r["payload"]


def header(headers: Column, name: str) -> Column:
    """The last value of a header, names without regard to case; null if there is none."""
    return F.try_element_at(F.filter(F.coalesce(headers, F.array().cast(HEADERS)), lambda h: F.lower(h["name"]) == name), F.lit(-1))["value"]


def _tag(headers: Column) -> Column:
    return F.regexp_replace(header(headers, "etag"), r"^W/", "")


def merged_headers(old: Column, new: Column) -> Column:
    """The old headers, those named in ``new`` replaced by its permitted ones, which come last."""
    permitted = F.filter(F.coalesce(new, F.array().cast(HEADERS)), lambda h: ~F.lower(h["name"]).isin(*NOT_MERGED))
    names = F.transform(permitted, lambda h: F.lower(h["name"]))
    return F.concat(F.filter(F.coalesce(old, F.array().cast(HEADERS)), lambda h: ~F.array_contains(names, F.lower(h["name"]))), permitted)


def resolve_revisits(records: DataFrame, bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """One row for each revisit record, with the full response that it stands for.

    ``record_id``, ``url``, ``canonical``, ``date`` of the revisit; ``outcome``; ``response_id``,
    ``response_date``, ``path``, ``offset``, ``length`` of the latest response of the canonical URL
    with status 200 and an earlier date (of equal dates, the greatest id); and ``headers``.
    Outcomes: ``resolved``; ``mismatch``: a validator of the revisit differs from the response's
    (the digest where the profile is identical-payload-digest, else the entity tag, weak or not,
    else the date of modification); ``unvalidated``: there is none on both sides to compare;
    ``orphan``: no earlier response. Only resolved ones have merged headers, others keep their own.

    Records with null url, one without ``://``, or null date are never joined: such revisits are
    orphans. A response that wasn't read whole isn't one. Null headers are none. Repeated rows stay
    repeated. An empty table gives no rows. Columns other than those of ``read_warc`` aren't read.
    """
    # Written once: files are parsed once, and Spark knows the size of what it joins.
    rows = records.where(F.col("type").isin("response", "revisit")).select(
        *("record_id", "type", "url", "date", "status", "headers", "profile", "digest", "problem", "path", "offset", "length"),
        urls.spelling_of(F.col("url")).alias("canonical"),
        F.floor(F.unix_timestamp("date") / bucket_seconds).alias("bucket"),
    )
    rows = shared.cut(rows, "captures")
    known = F.col("canonical").isNotNull() & F.col("date").isNotNull()
    revisits = rows.where("type = 'revisit'")
    response = F.struct("date", "record_id", "headers", "digest", "path", "offset", "length")
    whole = (F.col("type") == "response") & (F.col("status") == 200) & F.col("problem").isNull()
    full = rows.where(known & whole).groupBy("canonical", "bucket", "date").agg(F.max_by(response, F.struct("record_id")).alias("found"))
    moments = full.select("canonical", "bucket", "date", F.lit(1).alias("late"), "found")
    kind = full.schema["found"].dataType
    asked = revisits.where(known).select("canonical", "bucket", "date").distinct()
    moments = asked.select("canonical", "bucket", "date", F.lit(0).alias("late"), F.lit(None).cast(kind).alias("found")).union(moments)
    # One row for each bucket of a URL: what the buckets before it end with.
    ends = moments.groupBy("canonical", "bucket").agg(F.max_by("found", F.when(F.col("late") == 1, F.col("date"))).alias("last"))
    before = Window.partitionBy("canonical").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("canonical", "bucket", F.last("last", True).over(before).alias("carried"))
    running = Window.partitionBy("canonical", "bucket").orderBy("date", "late").rowsBetween(Window.unboundedPreceding, -1)
    within = moments.withColumn("near", F.last("found", True).over(running)).where("late = 0").drop("found", "late")
    answers = within.join(carried, ["canonical", "bucket"], "left").select("canonical", "date", F.coalesce("near", "carried").alias("near"))
    columns = ["canonical", "date", "record_id", "url", "headers", "profile", "digest"]
    joined = revisits.where(known).select(*columns).join(answers, ["canonical", "date"], "left").select(*columns, "near")
    lost = revisits.where(~known | F.col("canonical").isNull() | F.col("date").isNull())
    joined = joined.unionByName(lost.select(*columns, F.lit(None).cast(kind).alias("near")))
    near, own = F.col("near"), F.col("headers")
    by_digest = F.coalesce(F.col("profile"), F.lit("")).contains("identical-payload-digest")
    mine = F.when(by_digest, F.col("digest")).when(_tag(own).isNotNull(), _tag(own)).otherwise(header(own, "last-modified"))
    other = F.when(by_digest, near["digest"]).when(_tag(own).isNotNull(), _tag(near["headers"])).otherwise(header(near["headers"], "last-modified"))
    outcome = (
        F.when(near.isNull(), "orphan")
        .when(mine.isNull() | other.isNull(), "unvalidated")
        .when(mine == other, "resolved")
        .otherwise("mismatch")
    )
    return joined.withColumn("outcome", outcome).select(
        *("record_id", "url", "canonical", "date", "outcome"),
        near["record_id"].alias("response_id"),
        near["date"].alias("response_date"),
        near["path"].alias("path"),
        near["offset"].alias("offset"),
        near["length"].alias("length"),
        F.when(F.col("outcome") == "resolved", merged_headers(near["headers"], own)).otherwise(own).alias("headers"),
    )


def captures(pages: DataFrame) -> DataFrame:
    """Each page as two records: a full response, and a later not-modified revisit of it.

    Page ``n`` is fetched ``n`` minutes after the start of 2024 and visited again 20 days later, by
    another spelling of its URL. Every seventh revisit has another entity tag, every fifth has
    only the date of modification, every eleventh has no validator.
    """
    n = F.coalesce("page_id", F.lit(0))
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    at = F.timestamp_seconds(F.unix_timestamp(start) + n * 60)
    pair = lambda name, value: F.struct(F.lit(name).alias("name"), value.cast("string").alias("value"))
    tag = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit("")).cast("binary")), F.lit('"'))
    changed = F.date_format(F.timestamp_seconds(F.unix_timestamp(start) - n * 60), "yyyy-MM-dd HH:mm:ss")
    name = F.concat(F.coalesce(F.col("page_id").cast("string"), F.lit("none")))
    first = pages.select(
        F.concat(F.lit("<urn:page:"), name, F.lit(":response>")).alias("record_id"),
        F.lit("response").alias("type"),
        "url",
        at.alias("date"),
        F.lit(200).alias("status"),
        F.array(pair("ETag", tag), pair("Last-Modified", changed), pair("Content-Type", F.lit("text/html")), pair("Cache-Control", F.lit("max-age=60")), pair("X-Run", F.lit("1"))).alias("headers"),
        F.lit(None).cast("string").alias("profile"),
        F.col("html").cast("binary").alias("payload"),
    )
    etag = F.when((n % 11 != 0) & (n % 5 != 0), pair("etag", F.when(n % 7 == 0, F.lit('W/"other"')).otherwise(F.concat(F.lit("W/"), tag))))
    second = pages.select(
        F.concat(F.lit("<urn:page:"), name, F.lit(":revisit>")).alias("record_id"),
        F.lit("revisit").alias("type"),
        F.concat(F.regexp_replace("url", "^https?://", "http://"), F.when(F.col("url").contains("#"), "").otherwise("#again")).alias("url"),
        F.timestamp_seconds(F.unix_timestamp(start) + n * 60 + 20 * 86_400).alias("date"),
        F.lit(304).alias("status"),
        F.array_compact(F.array(etag, F.when(n % 11 != 0, pair("Last-Modified", changed)), pair("Content-Length", F.lit("0")), pair("cache-control", F.lit("max-age=90")), pair("Date", F.col("page_id")))).alias("headers"),
        F.lit("http://netpreserve.org/warc/1.1/revisit/server-not-modified").alias("profile"),
        F.lit(None).cast("binary").alias("payload"),
    )
    return first.union(second)


ORACLE = r"""
WITH p AS (
  SELECT row_number() OVER () AS i, page_id, url, coalesce(html, '') AS html, coalesce(page_id, 0) AS n FROM pages),
q AS (
  SELECT *, array_to_string(list_filter(string_split(regexp_extract(url, '(?s)^.*?://[^?#]*\?([^#]*)', 1), '&'),
      lambda x: NOT regexp_matches(x, '(?is)^(utm_[^=]*|ref|fbclid|gclid|msclkid|mc_cid|mc_eid)(=.*)?$')), '&') AS query FROM p),
c AS (
  SELECT *, CASE WHEN contains(url, '://') THEN translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
    || regexp_replace(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '/+$', '') || CASE WHEN query <> '' THEN '?' || query ELSE '' END END AS canonical,
    md5(html) AS tag, strftime(TIMESTAMP '2024-01-01' - to_minutes(n), '%Y-%m-%d %H:%M:%S') AS changed FROM q),
r AS (
  SELECT v.i, v.page_id, v.n, v.tag, v.changed, v.canonical, arg_max(struct_pack(id := f.page_id, tag := f.tag, changed := f.changed), (f.n, '<urn:page:' || f.page_id || ':response>')) AS near
  FROM c v LEFT JOIN c f ON v.canonical = f.canonical AND f.n < v.n + 28800 GROUP BY ALL),
o AS (
  SELECT *, CASE WHEN near.id IS NULL THEN 'orphan' WHEN n % 11 = 0 THEN 'unvalidated'
    WHEN n % 5 <> 0 THEN CASE WHEN n % 7 <> 0 AND tag = near.tag THEN 'resolved' ELSE 'mismatch' END
    WHEN changed = near.changed THEN 'resolved' ELSE 'mismatch' END AS outcome FROM r)
SELECT page_id, canonical, outcome, near.id AS response_page,
  CASE WHEN outcome = 'resolved' THEN
    CASE WHEN n % 5 <> 0 THEN 'Content-Type: text/html; X-Run: 1; etag: W/"' || tag || '"; ' ELSE 'ETag: "' || near.tag || '"; Content-Type: text/html; X-Run: 1; ' END
      || 'Last-Modified: ' || changed || '; cache-control: max-age=90; Date: ' || page_id
    ELSE CASE WHEN n % 11 <> 0 AND n % 5 <> 0 THEN 'etag: W/"' || CASE WHEN n % 7 = 0 THEN 'other' ELSE tag END || '"; ' ELSE '' END
      || CASE WHEN n % 11 <> 0 THEN 'Last-Modified: ' || changed || '; ' ELSE '' END || 'Content-Length: 0; cache-control: max-age=90; Date: ' || page_id END AS headers
FROM o
"""
