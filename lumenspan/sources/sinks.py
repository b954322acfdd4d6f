"""Where results go."""

from __future__ import annotations

import contextlib
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lumenspan.functions import text as T
from lumenspan.functions.workers import ship


def front_matter(values: dict[str, Column]) -> Column:
    """A block of keys and values between ``---`` lines; null values are left out."""
    lines = [F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), v.cast("string"))) for k, v in values.items()]
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n"))


def report_name(number: Column, title: Column, stamp: Column) -> Column:
    """``pr-<number>-<slug>-<seconds>.md``."""
    return F.concat(F.lit("pr-"), number.cast("string"), F.lit("-"), T.slug(title), F.lit("-"), F.unix_timestamp(stamp).cast("string"), F.lit(".md"))


def review_text(row: dict[str, Column], body: Column) -> Column:
    """A review's front matter, a blank line and its body."""
    return F.concat(front_matter(row), F.lit("\n"), body)


def evaluation_text(row: dict[str, Column], sections: dict[str, Column]) -> Column:
    """An evaluation: front matter, and a ``##`` section for each text that isn't null or empty."""
    parts = [F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f"## {k}\n\n"), v, F.lit("\n"))) for k, v in sections.items()]
    return F.concat(front_matter(row), F.lit("\n"), F.concat_ws("\n", *parts))


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The store that a path of Spark's names, and the path in it."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.LocalFileSystem() if path.startswith("/") else pafs.FileSystem.from_uri(path)[0], path if path.startswith("/") else pafs.FileSystem.from_uri(path)[1]


def write_reports(reports: DataFrame, folder: str, repo: str = "repo", name: str = "name", text: str = "text") -> DataFrame:
    """One file for each report, ``folder/<owner-repo>/<name>``; gives the paths when it is run.

    The folder must be one that all executors share. A task that runs again writes the same files. Rows
    with a null repository or name are left out, a null text is an empty file.
    """
    ship(reports.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = []
            for owner, file, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                path = f"{folder.rstrip('/')}/{owner.replace('/', '-')}/{file}"
                store, place = filesystem(path)
                store.create_dir(place.rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(place, compression=None) as out:
                    out.write((content or "").encode())
                paths.append(path)
            yield pa.RecordBatch.from_pydict({"path": pa.array(paths, pa.string())})

    known = reports.where(F.col(repo).isNotNull() & F.col(name).isNotNull())
    return known.select(F.col(repo).cast("string"), F.col(name).cast("string"), F.col(text).cast("string")).mapInArrow(run, "path string")


#: The file of a versioned folder that names its current version, and the versions that are kept for readers.
MANIFEST, KEPT_VERSIONS = "CURRENT.manifest", 2


def _hadoop(spark: SparkSession, path: str):
    """The file system and a maker of paths, as Spark itself reads and writes ``path``."""
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    at = lambda *parts: jvm.Path("/".join([path.rstrip("/"), *parts]))
    return at().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def current(spark: SparkSession, path: str) -> str | None:
    """The folder of the current version; null where ``path`` has no versions."""
    store, at = _hadoop(spark, path)
    if not store.exists(at(MANIFEST)):
        return None
    with contextlib.closing(store.open(at(MANIFEST))) as file:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(file, "UTF-8")
    return f"{path.rstrip('/')}/{json.loads(text)['folder']}"


def write_version(rows: DataFrame, path: str, kept: int = KEPT_VERSIONS) -> str:
    """Write ``rows`` as JSON in a new version below ``path`` and make it the current one; gives its folder.

    The manifest is swapped by one rename once all is written: who reads meanwhile sees the version before,
    and a write that fails leaves it current. ``rows`` may read the store itself. Versions older than the
    last ``kept`` go, and what failed writes have left with them; one writer at a time.
    """
    spark = rows.sparkSession
    store, at = _hadoop(spark, path)
    before = current(spark, path)
    number = int(before.rsplit("/v-", 1)[1].split("-")[0]) + 1 if before else 1
    folder = f"v-{number:010d}-{uuid.uuid4().hex}"
    rows.write.json(str(at(folder)))
    with contextlib.closing(store.create(at(f"{MANIFEST}.{folder}"), True)) as file:
        file.write(bytearray(json.dumps({"folder": folder, "version": number}).encode()))
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(at().toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(at(f"{MANIFEST}.{folder}"), at(MANIFEST), options)
    for status in store.listStatus(at()):
        name = status.getPath().getName()
        if name.startswith("v-") and name != folder and int(name.split("-")[1]) <= number - kept:
            store.delete(status.getPath(), True)
    return str(at(folder))


def write_store(rows: DataFrame, path: str) -> str:
    """A keyed store, as a new version: readers of the one before aren't disturbed."""
    return write_version(rows, path)


def write_snapshot(edges: DataFrame, path: str) -> str:
    """Dependency edges, as a new version."""
    return write_version(edges, path)
