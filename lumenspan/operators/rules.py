"""Line rules: every rule against every line in one pass over the lines."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from lumenspan.functions import text as T
from lumenspan.operators.select import keep_first


@dataclass(frozen=True)
class Rule:
    rule_id: str
    cwe: str
    severity: str
    category: str
    pattern: str
    title: str
    fix: str
    exclude: str | None = None
    mask: bool = False
    #: One of these is in every line that fits, if there are any; told faster than the pattern.
    holds: tuple[str, ...] = ()


# Ids, weakness numbers, severities, categories and patterns of the rules for code. The last part
# of SEC-010, which names a statement, may be missing: what builds text in an execute call is told by the rest.
SECURITY_RULES = (
    Rule("SEC-001", "CWE-798", "critical", "secrets", r"""(?i)(api[_\-]?key|api[_\-]?secret|access[_\-]?token|auth[_\-]?token|secret[_\-]?key|private[_\-]?key|client[_\-]?secret|password|passwd|pwd)\s*=\s*["'][A-Za-z0-9+/\-_]{8,}["']""", "Credential in source code", "Read it from the environment or a secrets manager.", mask=True),
    Rule("SEC-002", "CWE-798", "critical", "secrets", r"(sk-ant-|ghp_|ghs_|github_pat_|xoxb-|xoxp-|AKID|AKIA)[A-Za-z0-9+/\-_]{10,}", "Key of a known format", "Revoke the key and read a new one from the environment.", mask=True),
    Rule("SEC-003", "CWE-798", "high", "secrets", r"""(?i)(jdbc|mongodb|postgresql|mysql|redis|amqp)://[^"\s]{5,}:[^"\s]{5,}@""", "Credentials in a connection URL", "Keep user and password out of the URL.", mask=True),
    Rule("SEC-010", "CWE-89", "critical", "injection", r"""(?i)(execute|executemany)\s*\(\s*(?:f["']+|["']+[^"']*["']+\s*(?:\+|%))\s*(?:(?:SELECT|INSERT|UPDATE|DELETE|DROP|CREATE)\b)?""", "SQL text built in an execute call", "Pass values as parameters."),
    Rule("SEC-011", "CWE-89", "high", "injection", r"(?i)(SELECT|INSERT|UPDATE|DELETE)\s+.*\+\s*(request\.|params\[|args\[|data\[|input)", "SQL joined with request data", "Pass values as parameters."),
    Rule("SEC-020", "CWE-78", "critical", "injection", r"subprocess\.(run|Popen|call|check_output)\s*\([^)]*shell\s*=\s*True", "Subprocess through a shell", "Pass a list of arguments without a shell."),
    Rule("SEC-021", "CWE-78", "high", "injection", r"os\.system\s*\(|os\.popen\s*\(", "Shell command", "Use subprocess with a list of arguments."),
    Rule("SEC-030", "CWE-502", "critical", "deserialization", r"pickle\.loads?\s*\(|cPickle\.loads?\s*\(", "Unpickling", "Use JSON, or unpickle signed data only."),
    Rule("SEC-031", "CWE-502", "high", "deserialization", r"(?i)yaml\.load\s*\([^,)]+\)(?!\s*,\s*Loader)", "YAML loaded without a safe loader", "Use the safe loader."),
    Rule("SEC-040", "CWE-327", "high", "crypto", r"(?i)hashlib\.(md5|sha1)\s*\(|MD5\s*\(|SHA1\s*\(|DigestAlgorithm\.SHA1", "Weak hash", "Use SHA-256 or stronger.", exclude=r"(?i)checksum|etag|dedup|fingerprint"),
    Rule("SEC-041", "CWE-330", "high", "crypto", r"random\.(random|randint|choice|shuffle)\s*\(", "Predictable random numbers", "Use a cryptographic generator.", exclude=r"(?i)test_|_test|sample|shuffle|simulation"),
    Rule("SEC-050", "CWE-208", "high", "auth", r"(?i)(token|api_key|secret|signature|hmac)\s*==\s*|==\s*(token|api_key|secret|signature)", "Comparison that leaks timing", "Compare digests in constant time.", exclude=r"#|test_|None|is None|isinstance|len\("),
    Rule("SEC-051", "CWE-306", "critical", "auth", r"(?i)(auth_required|login_required|permission_required|authenticate)\s*=\s*False|skip_auth\s*=\s*True|bypass_auth\s*=\s*True|verify\s*=\s*False", "Authentication or verification off", "Leave it on outside of tests."),
    Rule("SEC-060", "CWE-918", "high", "ssrf", r"""(?i)requests\.(get|post|put|patch|delete)\s*\(\s*(request\.|params\[|args\[|data\[|f["'])""", "Request to a URL from user data", "Allow known hosts only."),
    Rule("SEC-070", "CWE-22", "high", "path_traversal", r"""(?i)open\s*\(\s*(request\.|params\[|args\[|f["'].*\{)|Path\s*\(\s*(request\.|params\[|args\[)""", "Path from user data", "Resolve the path and check its base folder."),
    Rule("SEC-080", "CWE-489", "medium", "exposure", r"(?i)DEBUG\s*=\s*True|debug\s*=\s*True", "Debug mode on", "Set it from the environment.", exclude=r"#|test_|LOG_LEVEL|logging\.DEBUG|logger\.debug"),
    Rule("SEC-081", "CWE-215", "medium", "exposure", r"(?i)print\s*\(\s*(password|token|secret|api_key|credential)", "Secret printed", "Leave it out or mask it."),
)

# Rules for prose: what a corpus of documents should not hold.
TEXT_RULES = (
    Rule("TXT-001", "CWE-798", "critical", "secrets", r"(password|token|secret|api_key) = \"[A-Za-z0-9]{8,}\"", "Credential in text", "Mask it.", mask=True, holds=(' = "',)),
    Rule("TXT-002", "CWE-359", "high", "pii", r"[A-Za-z0-9._-]+@[A-Za-z0-9-]+\.[a-z]{2,}", "Mail address", "Mask it.", holds=("@",)),
    Rule("TXT-003", "", "medium", "license", r"[Ll]icense", "License line", "Check the terms.", holds=("icense",)),
    Rule("TXT-004", "", "low", "noise", r"[#$%&*]{3}", "Symbol noise", "Drop the document."),
)

# Extensions and folders that are never scanned.
SKIPPED_EXTENSIONS = ("png", "jpg", "jpeg", "gif", "svg", "ico", "pdf", "lock", "sum", "map")
SKIPPED_ENDINGS = (".min.js", ".min.css")
SKIPPED_FOLDERS = r"(?i)(^|/)(vendor|node_modules|\.git|dist|build|__pycache__|\.mypy_cache)/"


def skipped(path: Column) -> Column:
    """Binary, generated, lock and vendored files."""
    out = T.extension(path).isin(*SKIPPED_EXTENSIONS) | path.rlike(SKIPPED_FOLDERS)
    for ending in SKIPPED_ENDINGS:
        out = out | F.lower(path).endswith(ending)
    return out


def comment_only(line: Column) -> Column:
    return line.rlike(r"^\s*(#|//|\*)")


def fits(line: Column, r: Rule) -> Column:
    """Whether a rule fits a line; patterns are literals, so compiled once."""
    out = line.rlike(r.pattern)
    if r.exclude:
        out = ~line.rlike(r.exclude) & out
    if r.holds:
        some = F.lit(False)
        for part in r.holds:
            some = some | line.contains(part)
        out = some & out
    return out


def hits(line: Column, rules: Sequence[Rule]) -> Column:
    """For each rule its finding in a line, null where it doesn't fit, as an array of structs."""
    found = []
    for r in rules:
        matched = F.lit("****") if r.mask else F.substring(F.regexp_extract(line, r.pattern, 0), 1, 120)
        fields = {"rule_id": r.rule_id, "cwe": r.cwe, "severity": r.severity, "category": r.category, "title": r.title, "fix": r.fix}
        found.append(F.when(fits(line, r), F.struct(*[F.lit(v).alias(k) for k, v in fields.items()], matched.alias("matched"))))
    return F.array(*found)


def scan(lines: DataFrame, rules: Sequence[Rule], *keys: str, content: str = "content") -> DataFrame:
    """One row for each line and rule that fits, with the line's key columns.

    Lines that no rule fits are left out first; findings are made of the others only.
    """
    columns = ("rule_id", "cwe", "severity", "category", "title", "fix", "matched")
    some = F.lit(False)
    for r in rules:
        some = some | fits(F.col(content), r)
    exploded = lines.where(some).select(*keys, F.explode(hits(F.col(content), rules)).alias("hit")).where("hit is not null")
    return exploded.select(*keys, *[F.col(f"hit.{c}") for c in columns])


def scan_diff(cursor: DataFrame, key: str = "pr_id", rules: Sequence[Rule] = SECURITY_RULES) -> DataFrame:
    """Findings in the added lines of diffs, each rule once for a line of a file."""
    lines = cursor.where((F.col("change") == "added") & ~skipped(F.col("file")) & ~comment_only(F.col("text")))
    found = scan(lines, rules, key, "file", "new_line", "pos", content="text").withColumnRenamed("new_line", "line")
    return keep_first(found, [key, "rule_id", "file", "line"], "pos").drop("pos")


def scan_summary(cursor: DataFrame, key: str = "pr_id") -> DataFrame:
    """Files and added lines that a scan covers."""
    seen = cursor.where(~skipped(F.col("file")))
    return seen.groupBy(key).agg(F.count_distinct("file").alias("files_scanned"), F.count_if(F.col("change") == "added").alias("lines_added"))
