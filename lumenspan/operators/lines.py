"""Texts as lines, diffs as numbered lines, and markdown sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lumenspan.functions import text as T
from lumenspan.operators.running import running, windowed


def explode_lines(df: DataFrame, text_col: str, *keys: str, line: str = "line", content: str = "content") -> DataFrame:
    """One row for each line of a text, numbered from 1."""
    return df.select(*keys, F.posexplode(T.to_lines(F.col(text_col))).alias("_at", content)).select(*keys, (F.col("_at") + 1).alias(line), content)


def diff_lines(diffs: DataFrame, key: str = "pr_id", diff: str = "diff") -> DataFrame:
    """``(key, pos, raw)``: the lines of each diff in order."""
    return explode_lines(diffs, diff, key, line="pos", content="raw")


def diff_cursor(lines: DataFrame, key: str = "pr_id", split: bool = False) -> DataFrame:
    """``(key, pos, file, hunk_id, change, old_line, new_line, text)`` of the lines in hunks.

    ``change`` is added, removed or context. A hunk's header tells how many old and new lines it
    has, so a removed line that begins with ``--`` is told from a file header. Both sides are
    numbered from the header. What lines take over from those before them (file, header, lines seen) is
    a window over the diff, or with ``split`` goes over segments of it, so that a diff of millions of
    lines is many tasks.
    """
    run = running if split else windowed
    raw = F.col("raw")
    header = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
    number = lambda n: F.regexp_extract(raw, header, n).try_cast("int")
    sign = F.substring("raw", 1, 1)
    # All windows have one key and order, so a diff is sorted once.
    marked = lines.withColumns({"is_file": raw.startswith("diff --git "), "is_hunk": raw.startswith("@@ -") & raw.rlike(header)})
    one = lambda c: F.when(c, 1).otherwise(0)
    counts = ~raw.startswith("\\")
    on_old, on_new = one(counts & (sign != "+")), one(counts & (sign != "-"))
    named = {"file": F.when(F.col("is_file"), F.regexp_extract(raw, r"^diff --git a/.+ b/(.+)$", 1))}
    carried = run(marked, [key], ["pos"], {"hunks": one(F.col("is_hunk")), "old_upto": on_old, "new_upto": on_new}, named)
    start = F.struct(
        F.col("is_hunk").alias("open"),  # a file's header ends the hunk before it
        *(number(1).alias("old"), F.coalesce(number(2), F.lit(1)).alias("old_n"), number(3).alias("new"), F.coalesce(number(4), F.lit(1)).alias("new_n")),
        *("old_upto", "new_upto"),
    )
    begun = {"hunks_before": F.when(F.col("is_file"), F.col("hunks")), "start": F.when(F.col("is_file") | F.col("is_hunk"), start)}
    carried = run(carried, [key], ["pos"], lasts=begun)
    body = carried.where(F.col("start.open") & ~F.col("is_hunk") & counts)
    seen = {"old_seen": F.col("old_upto") - on_old - F.col("start.old_upto"), "new_seen": F.col("new_upto") - on_new - F.col("start.new_upto")}
    counted = body.withColumns(seen).withColumn("hunk_id", F.col("hunks") - F.coalesce("hunks_before", F.lit(0)))
    inside = counted.where((F.col("old_seen") < F.col("start.old_n")) | (F.col("new_seen") < F.col("start.new_n")))
    change = F.when(sign == "+", "added").when(sign == "-", "removed").otherwise("context")
    return inside.select(
        key,
        "pos",
        "file",
        F.col("hunk_id").cast("int").alias("hunk_id"),
        change.alias("change"),
        F.when(sign != "+", F.col("start.old") + F.col("old_seen")).cast("int").alias("old_line"),
        F.when(sign != "-", F.col("start.new") + F.col("new_seen")).cast("int").alias("new_line"),
        F.expr("substring(raw, 2)").alias("text"),
    )


def changed_files(lines: DataFrame, key: str = "pr_id") -> DataFrame:
    """Paths that a diff writes, from its ``+++ b/`` headers, each once with its first place."""
    found = lines.where(F.col("raw").startswith("+++ b/"))
    return found.groupBy(key, F.expr("substring(raw, 7)").alias("file")).agg(F.min("pos").alias("ord"))


def changed_texts(cursor: DataFrame, key: str = "pr_id") -> DataFrame:
    """Added and removed text of each file as two blocks."""
    block = lambda kind: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("change") == kind, F.struct("pos", "text")))), lambda x: x["text"]), "\n")
    return cursor.where("change <> 'context'").groupBy(key, "file").agg(block("added").alias("added"), block("removed").alias("removed"))


def as_added(files: DataFrame, *keys: str, path: str = "path", content: str = "content") -> DataFrame:
    """Whole files in the form of a diff's added lines."""
    lines = explode_lines(files, content, *keys, path, line="new_line", content="text")
    return lines.select(*keys, F.col(path).alias("file"), F.lit("added").alias("change"), F.lit(None).cast("int").alias("old_line"), "new_line", "text")


def import_lines(cursor: DataFrame) -> DataFrame:
    """Import statements that the new side of a diff has."""
    return cursor.where((F.col("change") != "removed") & F.col("text").rlike(r"^\s*(import\s+\w|from\s+[\w.]+\s+import\b)"))


def kept_sections(lines: DataFrame, words: list[str], key: str = "pr_id", placeholder: str = "(no relevant changes)", split: bool = False) -> DataFrame:
    """Of each diff, the sections whose header line has one of the words; a placeholder if none has."""
    header = F.when(F.col("raw").startswith("diff --git "), F.col("raw"))
    hit = F.lit(False)
    for w in words:
        hit = hit | F.lower("head").contains(w.lower())
    kept = (running if split else windowed)(lines, [key], ["pos"], lasts={"head": header})
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(hit, F.struct("pos", "raw")))), lambda x: x["raw"]), "\n")
    return kept.groupBy(key).agg(joined.alias("_text")).select(key, F.when(F.col("_text") == "", placeholder).otherwise(F.col("_text")).alias("text"))


def sections(lines: DataFrame, *keys: str, level: str = "###") -> DataFrame:
    """``(keys, heading, body)`` of markdown ``(keys, line, content)``; of equal headings the last.

    Lines between code fences are never headings. Text before the first heading is left out.
    """
    text = F.col("content")
    upto = Window.partitionBy(*keys).orderBy("line")
    fenced = F.sum(F.when(text.startswith("```"), 1).otherwise(0)).over(upto) % 2 == 1
    title = F.when(~F.col("fenced") & text.rlike(f"^{level} .+$"), T.strip(F.regexp_extract(text, f"^{level} (.+)$", 1)))
    titled = lines.withColumn("fenced", fenced).withColumn("title", title).withColumn("section", F.count("title").over(upto)).where("section > 0")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("title").isNull(), F.struct("line", "content")))), lambda x: x["content"]), "\n")
    built = titled.groupBy(*keys, "section").agg(F.max("title").alias("heading"), T.strip(body).alias("body"))
    return built.groupBy(*keys, "heading").agg(F.max_by("body", "section").alias("body"))


def tokens(text: Column) -> Column:
    """Distinct words of ASCII letters, digits and underscores."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("[A-Za-z0-9_]+"), F.lit(0)))  # much faster than to split
