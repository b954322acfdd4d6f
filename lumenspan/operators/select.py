"""Selection: first of each key, caps by group, priority fill, byte budgets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from lumenspan.functions import text as T
from lumenspan.operators.running import numbered, running
from lumenspan.schemas import LIMITS


def keep_first(df: DataFrame, keys: Sequence[str], *order: str | Column) -> DataFrame:
    """The first row of each key in the given order."""
    return top_n(df, keys, 1, *order)


def top_n(df: DataFrame, keys: Sequence[str], n: int, *order: str | Column) -> DataFrame:
    """The first ``n`` rows of each key; the planner cuts groups before it shuffles them."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")


def most_common(df: DataFrame, value: Column, n: int, name: str, order: str) -> DataFrame:
    """The ``n`` most common values with their counts; of equal counts those seen first."""
    counts = df.where(value.isNotNull() & (value != "")).groupBy(value.alias(name)).agg(F.count("*").alias("n"), F.min(order).alias("_first"))
    return counts.orderBy(F.desc("n"), "_first", name).limit(n).select(name, "n")


def priority_fill(df: DataFrame, matches: Sequence[Column], n: int, order: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Up to ``n`` rows (of each key): first those of the first condition, then of the second, ..."""
    rank = F.coalesce(*[F.when(m, i) for i, m in enumerate(matches)])
    ranked = df.withColumn("priority", rank).where(F.col("priority").isNotNull())
    if keys:
        return top_n(ranked, keys, n, "priority", *order)
    return ranked.orderBy("priority", *order).limit(n)


def byte_budget(df: DataFrame, keys: Sequence[str], order: Sequence[str], size: Column, cap: int, files: int, file_cap: Column | int) -> DataFrame:
    """A ``status`` for each row: rows are taken while what was taken before is below the cap.

    ``file_cap`` beyond the first ``files`` rows, ``error`` for a null size, ``byte_cap``, else
    ``truncated`` where the row alone is over ``file_cap`` and ``ok`` where not. Rows are numbered in
    segments, so a key may have any number; the bytes of its first ``files`` rows are a window.
    """
    most = file_cap if isinstance(file_cap, Column) else F.lit(file_cap)
    out = numbered(df.withColumns({"_size": size, "_most": most}), keys, order, "_n")
    by = Window.partitionBy(*keys).orderBy("_n").rowsBetween(Window.unboundedPreceding, -1)
    own = F.coalesce(F.when(F.col("_size").isNotNull(), F.least("_size", "_most")), F.lit(0))
    first = out.where(F.col("_n") <= files).withColumn("_before", F.coalesce(F.sum(own).over(by), F.lit(0)))
    status = (
        F.when(F.col("_size").isNull(), "error")
        .when(F.col("_before") >= cap, "byte_cap")
        .when(F.col("_size") > F.col("_most"), "truncated")
        .otherwise("ok")
    )
    known = first.select(*df.columns, status.alias("status"))
    return known.unionByName(out.where(F.col("_n") > files).select(*df.columns, F.lit("file_cap").alias("status")))


def within_budget(df: DataFrame, keys: Sequence[str], order: Sequence[str], size: Column, cap: int) -> DataFrame:
    """The rows before the first that would exceed the cap; a key of any size is summed in segments."""
    return running(df, keys, order, {"_sum": size}).where(F.col("_sum") <= cap).drop("_sum")


def until_over(df: DataFrame, keys: Sequence[str], order: Sequence[str], size: Column, cap: int, strict: bool = False) -> DataFrame:
    """Rows up to and with the one that goes over the cap (or, ``strict``, reaches it), summed in segments."""
    before = F.col("_sum")
    return running(df, keys, order, {"_sum": size}, before=True).where(before < cap if strict else before <= cap).drop("_sum")


# What repositories' scanners read, skip, and take first.
SCANNED_EXTENSIONS = (".py", ".yml", ".yaml", ".sql", ".json", ".toml", ".ini", ".cfg")
SCANNED_NAMES = ("dockerfile", "makefile")
SKIPPED_PREFIXES = ("node_modules/", "vendor/", ".git/", "__pycache__/", ".mypy_cache/")
NOISE_PREFIXES = (*SKIPPED_PREFIXES, ".venv/", "venv/", "dist/", "build/", ".tox/", ".eggs/")
DATA_PREFIXES = ("data/", "out/", "fixtures/", "tests/", "test/", "docs/")
HOT_GLOBS = (
    "config*.yml", "config*.yaml", "config*.json", "*.env", "*.env.*", "secrets*", ".github/workflows/*",
    "Dockerfile", "docker-compose*.yml", "docker-compose*.yaml", "main.py", "app.py", "settings.py", "cicd/*",
)
KEY_FILES = (
    "README.md", "README.rst", "readme.md", "CONTRIBUTING.md", "pyproject.toml", "setup.py", "setup.cfg", "package.json",
    "Cargo.toml", "go.mod", "pom.xml", "build.gradle", "Dockerfile", "docker-compose.yml", "docker-compose.yaml",
    ".github/workflows/*.yml", ".github/workflows/*.yaml", "src/main.*", "src/app.*", "src/index.*", "main.py", "app.py",
    "index.js", "index.ts", "dbt_project.yml", "airflow_settings.yaml", "dagster.yaml", "prefect.yaml", "config/*.py",
    "config/*.yaml", "config/*.yml", "docs/ARCHITECTURE.md", "docs/architecture.md",
)
PREFERRED_MODULES = ("core", "src", "app", "api", "server", "backend", "services", "models", "lib", "ingest", "agents", "jobs", "worker", "pipelines")
ENTRY_POINTS = ("main.py", "app.py", "__init__.py", "__main__.py", "asgi.py", "wsgi.py", "index.py", "index.js", "index.ts")
CONFIG_ENDINGS = (".yml", ".yaml", ".toml", ".ini", ".cfg", ".json", "dockerfile")
SIGNALS = (
    ("dbt_project.yml", "dbt"), ("dagster.yaml", "dagster"), ("prefect.yaml", "prefect"), ("airflow", "airflow"), ("dags/", "airflow"),
    (".github/workflows/", "github-actions"), ("dockerfile", "docker"), ("docker-compose", "docker"), ("pyproject.toml", "python-packaging"),
    ("package.json", "nodejs"), ("go.mod", "go"), ("snowflake", "snowflake"), ("spark", "spark"), ("kafka", "kafka"),
    ("models/", "data-models"), ("cicd/", "cicd"), ("terraform", "terraform"), ("kubernetes", "kubernetes"),
)


def has_prefix(path: Column, prefixes: Sequence[str], anywhere: bool = True) -> Column:
    low, out = F.lower(path), F.lit(False)
    for p in prefixes:
        out = out | low.startswith(p) | (low.contains(f"/{p}") if anywhere else F.lit(False))
    return out


def scannable(path: Column) -> Column:
    low = F.lower(path)
    out = F.lower(T.base_name(path)).isin(*SCANNED_NAMES)
    for e in SCANNED_EXTENSIONS:
        out = out | low.endswith(e)
    return ~has_prefix(path, SKIPPED_PREFIXES) & out


def blobs(tree: DataFrame, scope: str | None = None) -> DataFrame:
    files = tree.where("type = 'blob'")
    return files.where(F.col("path").startswith(f"{scope.rstrip('/')}/")) if scope else files


def key_files(tree: DataFrame, n: int = LIMITS.key_files) -> DataFrame:
    """The files that tell most about a repository, in the order of their patterns."""
    return priority_fill(blobs(tree), [T.matches_glob(F.col("path"), [g]) for g in KEY_FILES], n, ["ord"], ["repo"])


def audit_files(tree: DataFrame, scope: str | None = None, n: int = LIMITS.audit_files) -> DataFrame:
    """Files to audit: key files, then those that often hold secrets, then the rest."""
    path = F.col("path")
    files = blobs(tree, scope).where(scannable(path))
    return priority_fill(files, [T.matches_glob(path, KEY_FILES), T.matches_glob(path, HOT_GLOBS), F.lit(True)], n, ["ord"], ["repo"])


def audit_coverage(tree: DataFrame, scope: str | None = None, n: int = LIMITS.audit_files) -> DataFrame:
    counts = blobs(tree, scope).groupBy("repo").agg(F.count("*").alias("tree_files"), F.count_if(scannable(F.col("path"))).alias("audit_eligible"))
    return counts.withColumn("audit_scanned", F.least("audit_eligible", F.lit(n).cast("long")))


def modules(tree: DataFrame, scope: str | None = None, data: bool = False, n: int = LIMITS.modules, files: int = LIMITS.module_files) -> DataFrame:
    """``(repo, name, paths, score)``: the best modules of each repository and the files to read in them."""
    path = F.col("path")
    rel = F.expr(f"substring(path, {len(scope.rstrip('/')) + 2})") if scope else path
    name = F.when(rel.contains("/"), F.substring_index(rel, "/", 1)).otherwise("root")
    rows = blobs(tree, scope).where(~has_prefix(path, NOISE_PREFIXES) & scannable(path))
    if not data:
        rows = rows.where(~has_prefix(path, DATA_PREFIXES, False) & ~F.lower(name).isin(*[p.rstrip("/") for p in DATA_PREFIXES]))
    config = F.lit(False)
    for e in CONFIG_ENDINGS:
        config = config | F.lower(path).endswith(e)
    entry = F.lower(T.base_name(path)).isin(*ENTRY_POINTS)
    kind = F.when(entry, 0).when(config, 1).otherwise(2)
    depth = F.when(kind == 2, F.char_length(path) - F.char_length(F.replace(path, F.lit("/"), F.lit("")))).otherwise(0)
    within = F.when(kind == 2, F.lpad(F.col("ord").cast("string"), 12, "0")).otherwise(path)
    picked = top_n(rows.select("repo", name.alias("name"), "path", kind.alias("k"), depth.alias("d"), within.alias("w")), ["repo", "name"], files, "k", "d", "w")
    grouped = picked.groupBy("repo", "name").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "d", "w", "path"))), lambda x: x["path"]).alias("paths"))
    preferred = F.lower("name").isin(*PREFERRED_MODULES)
    score = F.size("paths") + F.when(preferred, 50.0).otherwise(0.0) + F.when(F.col("name") == "root", 10.0).otherwise(0.0)
    kept = grouped.withColumn("score", score.cast("double")).where((F.size("paths") >= 2) | preferred | (F.col("name") == "root"))
    return top_n(kept, ["repo"], n, F.desc("score"), "name")


def signals(tree: DataFrame) -> DataFrame:
    """``(repo, signals)``: technologies that the paths of a repository show, in the order of the rules."""
    low = F.lower(F.col("path"))
    flags = [F.bool_or(low.contains(p)).alias(f"s{n}") for n, (p, _) in enumerate(SIGNALS)]
    found = tree.groupBy("repo").agg(*flags)
    return found.select("repo", F.array_distinct(F.array_compact(F.array(*[F.when(F.col(f"s{n}"), s) for n, (_, s) in enumerate(SIGNALS)]))).alias("signals"))


def tree_excerpt(tree: DataFrame, n: int = 60) -> DataFrame:
    """Of the first ``n`` entries of each tree its files, sorted, and how many entries follow."""
    head = top_n(tree, ["repo"], n, "ord").groupBy("repo").agg(F.array_sort(F.collect_list(F.when(F.col("type") == "blob", F.col("path")))).alias("files"))
    total = tree.groupBy("repo").agg(F.greatest(F.count("*") - n, F.lit(0)).alias("more"))
    return head.join(total, "repo")
