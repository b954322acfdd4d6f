"""Job and model files of data pipelines: what is in them, what changed, who depends on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lumenspan.functions import text as T
from lumenspan.operators.joins import first_within

# Keys of job files.
JOB_NAME = r"(?m)^name\s*:\s*(.+)$"
CRON = r"""(?:quartz_cron_expression|cron_expression)\s*:\s*["']?([^"'\n]+)["']?"""
SCHEDULE = r"""schedule\s*:\s*\n\s+(?:cron\s*:\s*)?["']?([^\n"']+)["']?"""
FAIL_FLAG = r"(?i)fail_on_run_failure\s*:\s*(true|false)"
TASK_KEY = r"""task_key\s*:\s*["']?(\w[\w_-]*)["']?"""
WORKERS = r"num_workers\s*:\s*(\d+)"
MODEL_REF = r"""\{\{\s*ref\s*\(\s*['"](\w+)['"]\s*\)\s*\}\}"""


def _get(text: Column, pattern: str, n: int = 1) -> Column:
    return F.nullif(T.strip(F.regexp_extract(text, pattern, n)), F.lit(""))


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def pipeline_file(path: Column) -> Column:
    low = F.lower(path)
    return low.endswith(".yml") | low.endswith(".yaml") | (low.endswith(".sql") & low.rlike("dbt|model|pipeline"))


def job_name(content: Column) -> Column:
    return F.nullif(F.regexp_replace(_get(content, JOB_NAME), "^[\"']+|[\"']+$", ""), F.lit(""))


def schedule(content: Column) -> Column:
    return F.coalesce(_get(content, CRON), _get(content, SCHEDULE))


def fail_flag(text: Column) -> Column:
    """true, false, or null where it isn't set."""
    return F.lower(_get(text, FAIL_FLAG)).try_cast("boolean")


def jobs(files: DataFrame) -> DataFrame:
    """``(file, job_name, schedule, tasks)`` of the job files of ``(path, content)``."""
    content = F.col("content")
    # A dependency names a task too, further in; blocks begin at the indentation of the first task.
    indent = F.char_length(F.regexp_extract(content, r"\n([ \t]*)-\s+task_key\s*:", 1))
    blocks = F.split(content, F.concat(F.lit(r"\n[ \t]{"), indent.cast("string"), F.lit(r"}-\s+task_key\s*:")))
    key = lambda b: F.regexp_replace(T.strip(F.substring_index(b, "\n", 1)), "^[\"']+|[\"']+$", "")
    depends = lambda b: _all(F.regexp_extract(b, r"depends_on\s*:\s*\n((?:\s+-.*\n?)*)", 1), TASK_KEY)
    node = lambda b: _get(b, r"""node_type_id\s*:\s*["']?([^"'\n]+)["']?""")
    cluster = lambda b: F.when(
        node(b).isNotNull() | _get(b, WORKERS).isNotNull(), F.concat(F.coalesce(node(b), F.lit("")), F.lit(" x"), F.coalesce(_get(b, WORKERS), F.lit("?")))
    )
    tasks = F.transform(
        F.filter(F.slice(blocks, F.lit(2), F.size(blocks)), lambda b: key(b) != ""),
        lambda b: F.struct(
            key(b).alias("task_key"), _get(b, r"""notebook_path\s*:\s*["']?([^"'\n]+)["']?""").alias("notebook_path"), depends(b).alias("depends_on"),
            fail_flag(b).alias("fail_on_run_failure"), cluster(b).alias("cluster_size"),
        ),
    )
    found = files.where(pipeline_file(F.col("path"))).select(F.col("path").alias("file"), job_name(content).alias("job_name"), schedule(content).alias("schedule"), tasks.alias("tasks"))
    return found.where("job_name is not null")


def job_changes(texts: DataFrame, files: DataFrame, key: str = "pr_id") -> DataFrame:
    """What a diff changes in job files.

    ``texts`` has the added and removed text of each file, ``files`` the whole contents by ``path``.
    ``fail_flag`` is the new value, null with ``fail_flag_changed`` where the line was taken out.
    """
    added, removed = F.col("added"), F.col("removed")
    whole = texts.where(F.lower("file").rlike(r"\.ya?ml$")).join(files.select(F.col("path").alias("file"), "content"), "file", "left")
    full = F.coalesce("content", added)
    blank = lambda c: T.strip(c) == ""
    new, old = _all(added, TASK_KEY), _all(removed, TASK_KEY)
    was, now = schedule(removed), schedule(added)
    rows = whole.where(~(blank(full) & blank(added))).select(
        key,
        "file",
        F.coalesce(job_name(full), T.stem(F.col("file"))).alias("job_name"),
        F.when(blank(removed) & ~blank(added), "added").when(~blank(removed) & blank(added), "removed").otherwise("modified").alias("change_type"),
        (fail_flag(added).isNotNull() | fail_flag(removed).isNotNull()).alias("fail_flag_changed"),
        fail_flag(added).alias("fail_flag"),
        (~was.eqNullSafe(now)).alias("schedule_changed"),
        was.alias("old_schedule"),
        now.alias("new_schedule"),
        *[c.alias(n) for c, n in zip(set_changes(new, old), ("tasks_added", "tasks_removed", "tasks_modified"), strict=True)],
        (_all(removed, WORKERS) != _all(added, WORKERS)).alias("cluster_changed"),
    )
    part = lambda ok, *text: F.when(ok, F.concat(*text))
    none = F.lit("none")
    detail = F.concat_ws(
        "; ",
        part(F.col("fail_flag_changed"), F.lit("fail_on_run_failure: "), F.coalesce(F.col("fail_flag").cast("string"), F.lit("removed"))),
        part(F.col("schedule_changed"), F.lit("schedule: "), F.coalesce("old_schedule", none), F.lit(" -> "), F.coalesce("new_schedule", none)),
        part(F.size("tasks_added") > 0, F.lit("tasks added: "), F.array_join("tasks_added", ", ")),
        part(F.size("tasks_removed") > 0, F.lit("tasks removed: "), F.array_join("tasks_removed", ", ")),
        part(F.col("cluster_changed"), F.lit("workers changed")),
    )
    return rows.withColumn("detail", detail)


def model_changes(texts: DataFrame, key: str = "pr_id") -> DataFrame:
    """Models of which a diff adds text or changes references: the references on one side only, sorted."""
    added, removed = _all(F.col("added"), MODEL_REF), _all(F.col("removed"), MODEL_REF)
    model = F.lower("file").endswith(".sql") | F.lower("file").contains("dbt")
    some = (F.size(added) > 0) | (F.size(removed) > 0) | (T.strip(F.col("added")) != "")
    changed = on_one_side(added, removed)
    kind = F.when(T.strip(F.col("removed")) == "", "added").otherwise("modified")
    return texts.where(model & some).select(key, "file", T.stem(F.col("file")).alias("model_name"), kind.alias("change_type"), changed.alias("refs_changed"))


def dependencies(files: DataFrame) -> DataFrame:
    """``(upstream, downstream)``: jobs whose tasks another job's tasks or triggers name.

    A task's dependency is resolved to the job that the task is in.
    """
    found = jobs(files)
    tasks = found.select("job_name", F.explode("tasks").alias("t"))
    owner = tasks.select(F.col("t.task_key").alias("key"), F.col("job_name").alias("upstream")).distinct()
    needs = tasks.select("job_name", F.col("t.task_key").alias("task"), F.explode("t.depends_on").alias("key"))
    by_task = needs.join(owner, "key").select("upstream", F.concat_ws(".", "job_name", "task").alias("downstream"))
    content = F.col("content")
    triggers = files.select(job_name(content).alias("downstream"), F.explode(_all(content, r"""job_name\s*:\s*["']?([^"'\n]+)["']?""")).alias("upstream"))
    by_trigger = triggers.where("downstream is not null").select(T.strip(F.col("upstream")).alias("upstream"), "downstream").where("upstream <> downstream")
    return by_task.union(by_trigger).distinct()


def dependency_risks(changes: DataFrame, depends: DataFrame, files: DataFrame, key: str = "pr_id") -> DataFrame:
    """Jobs at risk from changed ones, with the first file (by ``ord``) whose job's name is in that of the dependent job.

    A dependent job without such a file has a null file.
    """
    risk = F.when(F.col("fail_flag") == False, "silent_cascade").when(F.col("schedule_changed"), "schedule_conflict").otherwise("missing_output")  # noqa: E712
    hit = changes.join(depends, F.col("job_name") == F.col("upstream")).select(key, "upstream", "downstream", risk.alias("risk")).distinct()
    named = files.select("ord", F.col("path").alias("downstream_file"), job_name(F.col("content")).alias("_job")).where("_job is not null")
    found = first_within(hit.select("downstream").distinct(), named, ["downstream"], F.col("downstream"), "_job", "ord").select("downstream", "downstream_file")
    return hit.join(found, "downstream", "left").select(key, "upstream", "downstream", "downstream_file", "risk")


def set_changes(new: Column, old: Column) -> tuple[Column, Column, Column]:
    """What two arrays have as sets: only the new one, only the old one, both; each sorted."""
    return F.sort_array(F.array_except(new, old)), F.sort_array(F.array_except(old, new)), F.sort_array(F.array_intersect(new, old))


def on_one_side(a: Column, b: Column) -> Column:
    """What only one of two arrays has, sorted."""
    return F.sort_array(F.array_union(F.array_except(a, b), F.array_except(b, a)))
