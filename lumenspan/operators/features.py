"""Feature columns and load jobs, and the catalog that is built from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lumenspan.functions import text as T
from lumenspan.operators import stores
from lumenspan.operators.pipelines import job_name
from lumenspan.operators.joins import within
from lumenspan.operators.select import keep_first, top_n
from lumenspan.schemas import LIMITS

# Names that tell a file's role, patterns of columns and of feature groups.
ROLES = (
    ("load", r"load[_\-].*feature|feature[_\-].*load|load[_\-].*metric|feature_load|load_feature"),
    ("register", r"register[_\-].*model|train[_\-].*model|score[_\-].*model|model[_\-].*register|model[_\-].*train"),
    ("feature_def", r"feature[_\-]group|featuregroup|feature[_\-]store|feature[_\-]definition|feature[_\-]schema|feature[_\-]config"),
    ("training", r"train[_\-]|[_\-]train|training|fit[_\-]model"),
    ("inference", r"infer|score[_\-]|predict|serving"),
    ("validation", r"feature[_\-]valid|valid[_\-]feature|feature[_\-]check"),
)
FEATURE_WORDS = (
    "feature", "featuregroup", "feature_group", "feature_store", "train", "training", "infer", "score", "register_model",
    "model_register", "feature_load", "load_feature",
)
COLUMNS = (
    ("type_defined", r"^(\w+)\s*=\s*(\w+Type|FloatType|IntType|StringType|BoolType|ArrayType|MapType)\s*\("),
    ("df_column", r"""df\[['"](\w+)['"]\]"""),
    ("feature_ref", r"""["'](\w+_score|\w*feature\w*|\w*metric\w*)["']"""),
    ("sql_column", r"^\s*(\w+)\s+(FLOAT|INT|INTEGER|VARCHAR|STRING|DOUBLE|BOOLEAN|TIMESTAMP|DATE|NUMBER)"),
    ("typed_field", r"^\s*(\w+)\s*:\s*(float|int|str|bool|Optional\[)"),
)
TYPE = r"(Optional\[[\w\[\]]+\]|float|int|str|bool|double|Float|Integer|String|Boolean)"
RENAME = r"""withColumnRenamed\s*\(\s*["'](\w+)["']\s*,\s*["'](\w+)["']"""
GROUPS = (
    r"""(?i)feature_group[_\s]*=\s*["']([^"']+)["']""",
    r"""(?i)feature_table[_\s]*=\s*["']([^"']+)["']""",
    r"""(?i)FeatureGroup\s*\(\s*["']([^"']+)["']""",
    r"""(?i)feature_store\.get_table\s*\(\s*["']([^"']+)["']""",
    r"""(?i)notebook_path.*?/(\w+_features?)["\s]""",
    r"""(?i)"(\w*features?\w*)"\s*:""",
    r"""(?i)feature_groups?\s*[:=]\s*\[([^\]]+)\]""",
)


def role(path: Column) -> Column:
    """A file's part in a feature pipeline, from its name."""
    name, out = F.lower(T.stem(path)), F.lit("other")
    for value, pattern in reversed(ROLES):
        out = F.when(name.rlike(pattern), value).otherwise(out)
    return out


def feature_file(path: Column) -> Column:
    return F.lower(path).rlike("|".join(FEATURE_WORDS))


def groups_of(content: Column) -> Column:
    """Names of feature groups in a text, each once, in the order of the patterns."""
    found = F.flatten(F.array(*[F.regexp_extract_all(content, F.lit(p), F.lit(1)) for p in GROUPS]))
    clean = F.transform(found, lambda x: F.regexp_replace(T.strip(x), "^[\"']+|[\"']+$", ""))
    return F.array_distinct(F.filter(clean, lambda x: F.char_length(x) > 3))


def last_of_line(rows: DataFrame, key: str = "pr_id") -> DataFrame:
    """Of rows with one line number on a side of a file, the last by ``pos``."""
    return keep_first(rows, [key, "file", "change", "line"], F.desc("pos"))


def column_changes(cursor: DataFrame, key: str = "pr_id") -> DataFrame:
    """``(key, file, line, column_name, change_type, old_type, new_type)`` in feature files of a diff.

    Of each file, a column is renamed, has another type, is added or is removed; a column that is on
    both sides with one type is no change.
    """
    text = T.strip(F.col("text"))
    lines = last_of_line(cursor.where(feature_file(F.col("file")) & (F.col("change") != "context")).withColumn("line", F.coalesce("new_line", "old_line")), key)
    renamed = lines.where((F.col("change") == "added") & text.rlike(RENAME)).select(
        key, "file", "line", F.regexp_extract(text, RENAME, 1).alias("column_name"), F.lit("renamed").alias("change_type"),
        F.lit(None).cast("string").alias("old_type"), F.regexp_extract(text, RENAME, 2).alias("new_type"),
    )
    named = F.array_compact(F.array(*[F.when(text.rlike(p), F.struct(F.lit(n).alias("rank"), F.regexp_extract(text, p, 1).alias("name"))) for n, (_, p) in enumerate(COLUMNS)]))
    type_ = F.nullif(F.regexp_extract(F.col("text"), TYPE, 1), F.lit(""))
    seen = lines.where(~text.rlike(RENAME)).select(key, "file", "line", "pos", "change", type_.alias("type"), F.explode(named).alias("c")).where(F.col("c.name") != "")
    side = lambda kind: keep_first(
        seen.where(F.col("change") == kind).select(key, "file", "line", "pos", "type", F.col("c.name").alias("column_name"), F.col("c.rank").alias("rank")),
        [key, "file", "column_name"], "pos", "rank",
    )
    new = side("added").select(key, "file", "column_name", F.col("line").alias("new_at"), F.col("type").alias("new_type"), F.lit(1).alias("is_new"))
    old = side("removed").select(key, "file", "column_name", F.col("line").alias("old_at"), F.col("type").alias("old_type"), F.lit(1).alias("is_old"))
    both = new.join(old, [key, "file", "column_name"], "full")
    plain = F.col("column_name").rlike("^[a-z_][a-z0-9_]{2,}$")
    kind = (
        F.when(F.col("is_new").isNotNull() & F.col("is_old").isNotNull(), F.when(F.col("new_type") != F.col("old_type"), "type_changed"))
        .when(plain & F.col("is_new").isNotNull(), "added")
        .when(plain, "removed")
    )
    typed = kind == "type_changed"
    rest = both.withColumn("change_type", kind).where("change_type is not null").select(
        key, "file", F.coalesce("new_at", "old_at").alias("line"), "column_name", "change_type",
        F.when(typed, F.col("old_type")).alias("old_type"), F.when(typed, F.col("new_type")).alias("new_type"),
    )
    return renamed.dropDuplicates([key, "file", "column_name", "new_type"]).unionByName(rest)


def job_changes(texts: DataFrame, files: DataFrame, key: str = "pr_id") -> DataFrame:
    """Feature jobs whose YAML a diff touches, with the groups they name."""
    content = F.coalesce("content", "added")
    rows = texts.where(F.lower("file").rlike(r"\.ya?ml$")).join(files.select(F.col("path").alias("file"), "content"), "file", "left")
    found = rows.select(key, "file", F.coalesce(job_name(content), T.stem(F.col("file"))).alias("job_name"), role(F.col("file")).alias("job_kind"), groups_of(content).alias("feature_groups"))
    return found.where("job_kind <> 'other'")


def consumers(terms: DataFrame, lines: DataFrame, n: int = LIMITS.feature_consumers) -> DataFrame:
    """``(term, path, line, snippet, role)``: the first ``n`` lines with each term as a word, any case."""
    words = lines.select("path", "line", "content", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("content"), F.lit(r"(?U)\w{3,}"), F.lit(0)))).alias("_word"))
    wanted = terms.select("term", F.lower("term").alias("_word")).where(F.char_length("term") >= 3).distinct()
    first = top_n(words.join(wanted, "_word"), ["term"], n, "path", "line")
    return first.select("term", "path", "line", F.substring(T.strip(F.col("content")), 1, 120).alias("snippet"), role(F.col("path").cast("string")).alias("role"))


def catalog(columns: DataFrame, jobs: DataFrame, repo: str, built_at: float) -> DataFrame:
    """Catalog entries of added columns.

    Load jobs belong to a feature if they name its group, or a group that is a part of its source
    file's path; groups meet paths by equality of pieces.
    """
    entry = columns.where("change_type = 'added'").select(
        F.col("column_name").alias("feature_name"), stores.feature_group(F.col("file")).alias("feature_group"), F.col("file").alias("source_file"), "line"
    )
    last = keep_first(entry, ["feature_name"], F.desc("source_file"), F.desc("line")).drop("line")
    named = jobs.where("job_kind = 'load'").select("job_name", F.explode("feature_groups").alias("feature_group"))
    in_path = within(last.select("source_file").distinct(), named.toDF("job_name", "_group"), ["source_file"], F.col("source_file"), "_group").select("source_file", "job_name")
    by_group = last.join(named, "feature_group").select("feature_name", "job_name")
    jobs_of = by_group.union(last.join(in_path, "source_file").select("feature_name", "job_name")).groupBy("feature_name").agg(F.sort_array(F.collect_set("job_name")).alias("load_jobs"))
    own = last.join(jobs_of, "feature_name", "left").withColumn("load_jobs", F.coalesce("load_jobs", F.array().cast("array<string>")))
    return own.select(F.lit(repo).alias("feature_store_repo"), "feature_name", "feature_group", "source_file", "load_jobs", F.lit(built_at).alias("built_at"))
