"""Landed tables: what an earlier fetch has written, brought into the review schemas."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lumenspan.schemas import EDGES
from lumenspan.sources.sinks import current

PULLS = (
    "number int, title string, body string, state string, merged_at string, html_url string, user struct<login: string>, "
    "base struct<ref: string, sha: string>, head struct<ref: string, sha: string>, additions int, deletions int, changed_files int"
)


def pull_requests(spark: SparkSession, path: str) -> DataFrame:
    """Pull requests from landed JSON, with ``pr_status`` merged, open or closed."""
    rows = spark.read.schema(PULLS).option("mode", "DROPMALFORMED").json(path)
    status = F.when(F.coalesce("merged_at", F.lit("")) != "", "merged").otherwise(F.col("state"))
    return rows.select(
        F.col("number").alias("pr_number"), "title", F.col("user.login").alias("author"), F.coalesce("body", F.lit("")).alias("body"), status.alias("pr_status"),
        "merged_at", F.col("html_url").alias("url"), F.col("base.ref").alias("base"), F.col("base.sha").alias("base_sha"), F.col("head.sha").alias("head_sha"),
        "additions", "deletions", "changed_files",
    )


def merged_pulls(pulls: DataFrame, n: int) -> DataFrame:
    """The newest merged pull requests, their bodies cut to 300 characters."""
    return pulls.where("pr_status = 'merged'").orderBy(F.desc("merged_at"), F.desc("pr_number")).limit(n).withColumn("body_snippet", F.substring("body", 1, 300))


def open_pulls(pulls: DataFrame, n: int = 100) -> DataFrame:
    """The newest open pull requests."""
    return pulls.where("pr_status = 'open'").orderBy(F.desc("pr_number")).limit(n)


def changed_files(spark: SparkSession, path: str) -> DataFrame:
    """``(pr_number, file, status, additions, deletions, patch, previous)`` of landed pages of changed files.

    A file that two pages have, as happens when a request is repeated, is one row; counts that a page
    leaves out are 0, a patch that it leaves out (a binary or very large file) is the empty text.
    """
    fields = "pr_number int, filename string, status string, additions int, deletions int, patch string, previous_filename string"
    rows = spark.read.schema(fields).option("mode", "DROPMALFORMED").json(path).where("filename is not null")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select(
        "pr_number", F.col("filename").alias("file"), F.coalesce("status", F.lit("modified")).alias("status"), zero("additions"), zero("deletions"),
        F.coalesce("patch", F.lit("")).alias("patch"), F.col("previous_filename").alias("previous"),
    ).dropDuplicates(["pr_number", "file"])


def repositories(spark: SparkSession, path: str) -> DataFrame:
    """Repositories of landed JSON by ``owner`` and ``repo``, with defaults for what it leaves out."""
    fields = (
        "owner string, repo string, name string, full_name string, description string, language string, topics array<string>, "
        "default_branch string, stargazers_count long, html_url string"
    )
    rows = spark.read.schema(fields).option("mode", "DROPMALFORMED").json(path)
    filled = {
        "name": F.col("repo"), "full_name": F.concat_ws("/", "owner", "repo"), "description": F.lit(""), "language": F.lit(""),
        "topics": F.array().cast("array<string>"), "default_branch": F.lit("main"), "stargazers_count": F.lit(0).cast("long"), "html_url": F.lit(""),
    }
    return rows.select("owner", "repo", *[F.coalesce(c, default).alias(c) for c, default in filled.items()])


def with_readme(repos: DataFrame, readmes: DataFrame) -> DataFrame:
    """Repositories with the text of their README, empty where none has landed."""
    return repos.join(readmes.select("owner", "repo", "readme").dropDuplicates(["owner", "repo"]), ["owner", "repo"], "left").withColumn("readme", F.coalesce("readme", F.lit("")))


def trees(asked: DataFrame, branches: DataFrame, repos: DataFrame, entries: DataFrame) -> DataFrame:
    """``(repo, branch, ord, path, type, size)``: the tree of each asked ``(repo, branch)``.

    ``branches`` is ``(repo, branch, sha)``, ``entries`` is ``(sha, ord, path, type, size)``. A branch that
    isn't known falls back to the repository's default branch; if that isn't either, there is no tree.
    """
    known = branches.select("repo", F.col("branch").alias("_b"), "sha")
    asked = asked.join(repos.select(F.col("full_name").alias("repo"), "default_branch"), "repo", "left")
    own = asked.join(known, (asked["repo"] == known["repo"]) & (asked["branch"] == known["_b"]), "left").select(asked["repo"], "branch", "default_branch", F.col("sha").alias("_own"))
    default = known.toDF("_r", "_d", "_other")
    both = own.join(default, (F.col("repo") == F.col("_r")) & (F.coalesce("default_branch", F.lit("main")) == F.col("_d")), "left")
    found = both.select("repo", "branch", F.coalesce("_own", "_other").alias("sha"))
    return found.join(entries, "sha").select("repo", "branch", "ord", "path", "type", "size")


def decoded(content: Column) -> Column:
    """Text of base64 content, bytes that are no UTF-8 replaced."""
    return F.decode(F.unbase64(content), "UTF-8")


def files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """``(path, content, size)`` of the files below a folder, whole."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return raw.select("path", F.decode("content", "UTF-8").alias("content"), F.col("length").alias("size"))


def report_files(spark: SparkSession, path: str) -> DataFrame:
    """``(path, text, mtime)`` of saved markdown reports."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(path)
    return raw.select("path", F.decode("content", "UTF-8").alias("text"), F.col("modificationTime").alias("mtime"))


def snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Dependency edges from JSON records, column names in any letter case; missing ones are null.

    Of a versioned snapshot the current version.
    """
    version = current(spark, path)
    raw = spark.read.json(version) if version else spark.read.option("multiLine", True).json(path)
    upper = raw.toDF(*[c.upper() for c in raw.columns])
    names = [x.split()[0] for x in EDGES.split(", ")]
    return upper.select(*[(F.col(c) if c in upper.columns else F.lit(None)).cast("string").alias(c) for c in names])


def snapshot_columns(spark: SparkSession, path: str) -> DataFrame:
    """The same from one object of equally long lists."""
    raw = spark.read.option("multiLine", True).json(path)
    zipped = raw.select(F.explode(F.arrays_zip(*[F.col(c).alias(c.upper()) for c in raw.columns])).alias("row")).select("row.*")
    names = [x.split()[0] for x in EDGES.split(", ")]
    return zipped.select(*[(F.col(c) if c in zipped.columns else F.lit(None)).cast("string").alias(c) for c in names])


#: Kinds of metadata snapshots, with the file that each is written to.
SNAPSHOTS = {
    "dependencies": "object_dependencies_snapshot.json",
    "procedures": "procedures_snapshot.json",
    "views": "views_snapshot.json",
    "functions": "functions_snapshot.json",
}
Reader = Callable[[SparkSession, str], DataFrame]
_PROVIDERS: dict[str, Reader] = {}


def provider(name: str) -> Callable[[Reader], Reader]:
    """Register what reads dependency edges under a name."""

    def add(read: Reader) -> Reader:
        _PROVIDERS[name] = read
        return read

    return add


def edges_from(name: str, spark: SparkSession, path: str) -> DataFrame:
    """Dependency edges by a registered provider."""
    if name not in _PROVIDERS:
        raise ValueError(f"no lineage provider {name!r}; there are {sorted(_PROVIDERS)}")
    return _PROVIDERS[name](spark, path)


provider("records")(snapshot)
provider("columns")(snapshot_columns)


def refresh_snapshots(tables: dict[str, DataFrame], folder: str, **wanted: bool) -> dict[str, str]:
    """Write the wanted kinds of ``tables`` as JSON records; gives the path of each.

    Kinds are those of ``SNAPSHOTS``; a kind that isn't wanted, or has no table, is left as it was.
    """
    for kind in (*tables, *wanted):
        if kind not in SNAPSHOTS:
            raise ValueError(f"no kind of snapshot {kind!r}; there are {sorted(SNAPSHOTS)}")
    written = {kind: f"{folder.rstrip('/')}/{SNAPSHOTS[kind]}" for kind in SNAPSHOTS if wanted.get(kind) and kind in tables}
    for kind, path in written.items():
        tables[kind].write.mode("overwrite").json(path)
    return written


def jdbc_snapshot(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """Dependency edges from a database, read once for all hops."""
    return spark.read.jdbc(url, table, properties=options)


def store(spark: SparkSession, path: str, schema: str, version: int | None = None) -> DataFrame:
    """A keyed JSON store, its current version; broken records, and those of another schema version, are left out."""
    rows = spark.read.schema(schema if version is None else f"{schema}, schema_version int").option("mode", "DROPMALFORMED").json(current(spark, path) or path)
    return rows if version is None else rows.where(F.col("schema_version") == version).drop("schema_version")
