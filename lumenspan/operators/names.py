"""Names that a diff changes, files that may call them, and which analyses a change needs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from lumenspan.functions import text as T
from lumenspan.operators import index as symbol_index
from lumenspan.operators.select import top_n, until_over
from lumenspan.schemas import LIMITS

# Names that say nothing, statements that name objects, and words in paths that call for an analysis.
DUNDERS = ("__init__", "__repr__", "__str__")
VAGUE = ("RDS", "ODS_LS", "ODS", "BIGDATA", "STG", "STAGING", "TEMP", "TMP", "TABLE", "VIEW", "EXISTS", "IF")
FUNCTION = r"^\s*(?:async\s+)?def ([a-zA-Z_][a-zA-Z0-9_]*)\s*\("
OBJECT = (
    r"(?i)^\s*(?:CREATE\s+(?:OR\s+REPLACE\s+)?(?:TRANSIENT\s+|VOLATILE\s+|TEMP\s+|SECURE\s+)?(?:TABLE|VIEW)|ALTER\s+TABLE|DROP\s+(?:TABLE|VIEW))"
    r"\s+(?:IF\s+(?:NOT\s+)?EXISTS\s+)?([A-Z_][A-Z0-9_.]*)"
)
GATES = {
    "schema": (".sql", ".ddl", ".hql", "migration", "alembic", "schema", "model.py", "models.py", "pydantic", "serializer", "dto", "typedef", "types.py", "table.py", "tables.py", "entities.py"),
    "pipeline": (".yml", ".yaml", "dag", "airflow", "dbt", "pipeline", "workflow", "spark", "databricks"),
    "feature": ("feature", "featuregroup", "feature_group", "feature_store", "training", "inference"),
    "architecture": (".py", ".js", ".ts", ".jsx", ".tsx", ".java", ".go", ".rb", ".cs"),
}
FLOW_GLOBS = (
    "*.dag.py", "dags/*.py", "airflow/*.py", "flows/*.py", "pipelines/*.py", "dagster.yaml", "dagster/*.py", "definitions.py", "prefect.yaml",
    "prefect/*.py", "dbt_project.yml", "models/**/*.sql", "models/**/*.yml", "sources.yml", "schema.yml", "jobs/*.py", "notebooks/*.py", "*.py",
    "cicd/*.yml", "cicd/*.yaml", ".github/workflows/*.yml", "config/*.yaml", "config/*.yml", "config/*.json", "schemas/*.json", "schemas/*.yaml",
    "kafka/*.py", "streaming/*.py", "producers/*.py", "consumers/*.py",
)
FLOW_WORDS = (
    r"(?i)(spark|kafka|snowflake|delta|parquet|bronze|silver|gold|dbt|airflow|dagster|prefect|pipeline|ingest|transform|sink|source|stream|batch|"
    r"read\.format|write\.format|\.load\(|\.save\(|createOrReplace|merge into|insert into|copy into)"
)
SCHEMA_LAYERS, API_LAYERS = r"(?i)schema|model|database|table|migration|orm", r"(?i)api|endpoint|handler|route|service|interface"


def changed_names(cursor: DataFrame, key: str = "pr_id", n: int = 10) -> DataFrame:
    """Functions and SQL objects (in full and by their last part) on changed lines; functions first."""
    text = F.col("text")
    edited = cursor.where("change <> 'context'")
    functions = edited.select(key, F.lit(0).alias("rank"), F.regexp_extract(text, FUNCTION, 1).alias("name")).where(~F.col("name").isin("", *DUNDERS))
    objects = edited.select(key, F.upper(F.regexp_extract(text, OBJECT, 1)).alias("full")).where("full <> ''")
    plain = objects.where(~T.leaf(F.col("full")).isin(*VAGUE)).select(key, F.lit(1).alias("rank"), F.explode(F.array("full", T.leaf(F.col("full")))).alias("name"))
    once = functions.union(plain).groupBy(key, "name").agg(F.min("rank").alias("rank"))
    return top_n(once, [key], n, "rank", "name").select(key, "name")


def caller_files(index: DataFrame, names: DataFrame, changed: DataFrame, budget: int, modules: int = 3) -> DataFrame:
    """``(repo, file, level)``: files that use a changed name, then those that import a changed module.

    Both levels share one budget of files for each repository; ``changed(repo, file)`` are known already.
    """
    calls = index.where(~F.col("kind").endswith("def"))
    direct = symbol_index.candidate_files(calls, names, changed, budget).withColumn("level", F.lit(1))
    stems = top_n(changed.select("repo", T.stem(F.col("file")).alias("name")).distinct(), ["repo"], modules, "name")
    imports = index.where(F.col("kind").isin("py.import", "js.import", "py.call")).join(stems, ["repo", "name"], "left_semi")
    known = changed.select("repo", "file").union(direct.select("repo", "file"))
    second = imports.select("repo", "file").distinct().join(known, ["repo", "file"], "left_anti").withColumn("level", F.lit(2))
    return top_n(direct.unionByName(second), ["repo"], budget, "level", "file")


def gate(files: Column, words: Sequence[str]) -> Column:
    """Whether any path of an array holds any of the words."""
    return F.exists(files, lambda f: F.lower(f).rlike("|".join(w.replace(".", r"\.") for w in words)))


def gates(changes: DataFrame, files: str = "files") -> DataFrame:
    """Which analyses the changed ``files`` of each row call for."""
    return changes.select("*", *[gate(F.col(files), words).alias(name) for name, words in GATES.items()])


def flow_files(files: DataFrame, n: int = 25, cap: int = 80_000, chars: int = 6_000) -> DataFrame:
    """Files that tell how data flows, by pattern, with a sign of it near their beginning, up to a size.

    Patterns are taken in order until ``n`` files are found; all files of the last pattern taken are in.
    """
    rank = F.coalesce(*[F.when(T.matches_glob(F.col("path"), [g]), i) for i, g in enumerate(FLOW_GLOBS)])
    ranked = files.withColumn("priority", rank).where("priority is not null")
    upto = Window.partitionBy("repo").orderBy("priority").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranked.groupBy("repo", "priority").agg(F.count("*").alias("_n"))  # a row for each pattern
    taken = counts.withColumn("_before", F.coalesce(F.sum("_n").over(upto), F.lit(0))).where(F.col("_before") < n).select("repo", "priority")
    picked = ranked.join(taken, ["repo", "priority"], "left_semi")
    told = picked.where(F.substring("content", 1, 2000).rlike(FLOW_WORDS)).withColumn("chunk", F.substring("content", 1, chars))
    return until_over(told, ["repo"], ["priority", "ord"], F.char_length("chunk"), cap, strict=True)


def downstream_of(details: Column) -> Column:
    """Names behind ``Downstream:`` in a text, empty if it says none."""
    found = F.regexp_replace(T.strip(F.regexp_extract(details, r"[Dd]ownstream:\s*(.+?)$", 1)), r"\.+$", "")
    return F.when(F.lower(found).isin("none known", "none", "—", "-"), "").otherwise(found)


def layer_hints(layers: DataFrame, *keys: str) -> DataFrame:
    """Descriptions of layers that hold schemas, and of those that offer interfaces."""
    line = F.concat(F.col("name"), F.lit(": "), F.col("description"))
    pick = lambda p: F.sort_array(F.collect_list(F.when(F.col("name").rlike(p), line)))
    return layers.groupBy(*keys).agg(pick(SCHEMA_LAYERS).alias("schema_hints"), pick(API_LAYERS).alias("api_hints"))


def manifest(files: DataFrame, *keys: str) -> DataFrame:
    """Files and bytes by status."""
    return files.groupBy(*keys, "status").agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def capped_files(files: DataFrame) -> DataFrame:
    """Contents cut to their caps at safe places: SQL files have a cap of their own."""
    cap = F.when(F.col("path").endswith(".sql"), LIMITS.sql_file_bytes).otherwise(LIMITS.file_bytes)
    return files.withColumn("content", T.truncated(F.col("content"), F.col("path"), cap))


def as_table(headers: Sequence[str], rows: Column) -> Column:
    """Markdown of an array of arrays of text."""
    top = f"| {' | '.join(headers)} |\n|{'---|' * len(headers)}"
    cells = F.transform(rows, lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit(r"\|"))), " | "), F.lit(" |")))
    return F.concat_ws("\n", F.array_insert(cells, 1, F.lit(top)))
