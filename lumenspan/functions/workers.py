"""Python functions over rows that built-in expressions can't express, run on the executors."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).resolve().parent.parent
        target = Path(tempfile.mkdtemp(prefix="lumenspan-")) / "lumenspan_package.zip"
        with zipfile.ZipFile(target, "w") as out:
            for file in sorted(package.rglob("*.py")):
                out.write(file, file.relative_to(package.parent))
        context.addPyFile(str(target))
        _shipped.add(context.applicationId)


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many partitions as tasks run at once, at least; a table in few files is dealt out.

    Costly work on each row would otherwise wait for the few tasks that read. A table in many files
    stays as it is and isn't shuffled.
    """
    tasks = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= tasks else df.repartition(tasks)


def tasks_for(df: DataFrame, rows: int = 500_000) -> int:
    """How many partitions hold about ``rows`` rows of ``df`` each, at least as many as tasks run at once.

    For shuffles whose tasks sort what they get: their memory then doesn't grow with the table. A table's
    rows are counted, which for Parquet reads footers only.
    """
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))


def flat_map(df: DataFrame, function: Callable[[dict], Iterable[dict]], schema: str) -> DataFrame:
    """Rows that ``function`` makes of each row; one batch in, batches of bounded size out."""
    ship(df.sparkSession)
    parsed = _parse_datatype_string(schema)
    assert isinstance(parsed, StructType)
    kinds = to_arrow_schema(parsed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for row in batch.slice(at, 64).to_pylist():
                    held.extend(function(row))
                    if len(held) >= 4096:
                        yield pa.RecordBatch.from_pylist(held, kinds)
                        held = []
        yield pa.RecordBatch.from_pylist(held, kinds)

    return df.mapInArrow(run, parsed)


def line_starts(text: str) -> list[int]:
    """Offsets at which the lines of a text begin."""
    return [0, *(i + 1 for i, c in enumerate(text) if c == "\n")]
