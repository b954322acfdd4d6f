"""Keyed stores as tables: upserts, merges, relevance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from lumenspan.functions import text as T
from lumenspan.operators.select import keep_first, top_n
from lumenspan.schemas import LIMITS


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """One row a key: the newest by version; of equal versions that of ``new``."""
    both = old.withColumn("_side", F.lit(0)).unionByName(new.withColumn("_side", F.lit(1)))
    return keep_first(both, keys, F.desc(version), F.desc("_side")).drop("_side")


def insert_absent(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``old`` and those rows of ``new`` whose key it doesn't have, each such key once."""
    order = [c for c in new.columns if c not in keys]
    fresh = keep_first(new, keys, *order) if order else new.dropDuplicates(list(keys))
    return old.unionByName(fresh.join(old.select(*keys).distinct(), list(keys), "left_anti"))


def latest_with_history(df: DataFrame, keys: Sequence[str], order: Sequence[Column], columns: Sequence[str], n: int = LIMITS.history) -> DataFrame:
    """The latest row of each key, and the newest ``n`` as the array ``history``."""
    newest = top_n(df, keys, n, *order)
    ranked = newest.withColumn("_rn", F.row_number().over(_by(keys, order)))
    listed = F.array_sort(F.collect_list(F.struct("_rn", *columns)))
    grouped = ranked.groupBy(*keys).agg(listed.alias("_all"))
    return grouped.select(*keys, *[F.col("_all")[0][c].alias(c) for c in columns], F.transform("_all", lambda x: F.struct(*[x[c].alias(c) for c in columns])).alias("history"))


def _by(keys: Sequence[str], order: Sequence[Column]):
    return Window.partitionBy(*keys).orderBy(*order)


def merge_catalog(old: DataFrame, fresh: DataFrame, old_consumers: DataFrame, fresh_consumers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A refreshed feature catalog: fresh entries, old ones that are gone from it, all consumers once.

    Entries keep the ``built_at`` that they had first.
    """
    kept = old.join(fresh.select("feature_name"), "feature_name", "left_anti")
    first = old.select("feature_name", F.col("built_at").alias("_built"))
    now = fresh.join(first, "feature_name", "left").withColumn("built_at", F.coalesce("_built", "built_at")).drop("_built")
    return now.unionByName(kept), insert_absent(fresh_consumers, old_consumers, ["feature_name", "repo", "file", "line"])


def matched_features(features: DataFrame, consumers: DataFrame, words: DataFrame, changed: DataFrame) -> DataFrame:
    """Features named in a diff's ``words(word)``, and those with a consumer among ``changed(repo, file)``."""
    named = features.join(words.select(F.col("word").alias("feature_name")), "feature_name", "left_semi")
    used = consumers.join(changed, ["repo", "file"], "left_semi").select("feature_name")
    return named.select("feature_name").union(used).distinct()


def consumer_counts(consumers: DataFrame) -> DataFrame:
    return consumers.groupBy("feature_name").agg(F.count_distinct("repo").alias("repos"), F.count("*").alias("consumers"))


def stale(refreshed_at: Column, now: Column, days: int) -> Column:
    return now - refreshed_at > days * 86_400


def related(history: DataFrame, keys: Sequence[str], member: str, changed: DataFrame, order: Sequence[Column], n: int = LIMITS.related_history) -> DataFrame:
    """The newest ``n`` keys of ``history`` that share a member with ``changed``."""
    shared = history.join(changed.select(member).distinct(), member, "left_semi").select(*keys).distinct()
    rows = history.select(*keys, *[c for c in history.columns if c not in (*keys, member)])
    return rows.join(shared, list(keys), "left_semi").distinct().orderBy(*order).limit(n)  # only what is shared is told apart


def relevant_context(contexts: DataFrame, text: str, explicit: Sequence[str] = (), repo: str = "") -> DataFrame:
    """Contexts that are standard, named, or whose repository or owner the text mentions; each once.

    ``contexts`` has ``name``, ``standard`` and ``repo`` (``owner/name``).
    """
    head = F.lit((text[:5000] + "\n" + repo).lower())
    owner, name = F.lower(F.substring_index("repo", "/", 1)), F.lower(F.substring_index("repo", "/", -1))
    mentioned = ((owner != "") & head.contains(owner)) | ((name != "") & head.contains(name))
    rank = F.when(F.col("name").isin(*explicit) if explicit else F.lit(False), 0).when(F.col("standard"), 1).when(mentioned, 2)
    return keep_first(contexts.withColumn("_rank", rank).where("_rank is not null"), ["name"], "_rank").drop("_rank")


def repo_names(repos: DataFrame, names: Sequence[str] = (), topic: str | None = None) -> DataFrame:
    """Repositories that are neither forks nor archived, by name or topic."""
    out = repos.where("not fork and not archived")
    if names:
        out = out.where(F.col("name").isin(*names))
    return out.where(F.array_contains(F.transform("topics", F.lower), topic.lower())) if topic else out


def feature_group(path: Column) -> Column:
    """The group that a feature file's name tells."""
    return F.regexp_replace(T.stem(path), r"(_features?|_feature_group|_metrics?)$", "")
