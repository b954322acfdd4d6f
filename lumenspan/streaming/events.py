"""Event intake: review requests from event files, polls, and call limits."""

from __future__ import annotations

import bisect
import contextlib
import logging
import math
import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from lumenspan.functions.workers import ship
from lumenspan.schemas import EVENTS, LIMITS
from lumenspan.sources.sinks import filesystem

# Actions that ask for a review.
ACTIONS = ("opened", "synchronize", "reopened")


def review_requests(events: DataFrame) -> DataFrame:
    """``(repo, pr_number, title, action)`` of events that ask for a review; for batches and streams."""
    wanted = events.where((F.col("event") == "pull_request") & F.col("action").isin(*ACTIONS))
    return wanted.select(F.col("repository.full_name").alias("repo"), F.col("pull_request.number").alias("pr_number"), F.col("pull_request.title").alias("title"), "action")


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """Events from JSON files as they come in."""
    return spark.readStream.schema(EVENTS).json(path)


def unreviewed(requests: DataFrame, history: DataFrame) -> DataFrame:
    """Requests whose pull request has no review yet."""
    return requests.join(history.select("repo", "pr_number"), ["repo", "pr_number"], "left_anti")


def intake(requests: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Run all that has come in, hand each batch to ``handle``, and stop; started again, it goes on."""
    return requests.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def poll(start: Callable[[], StreamingQuery], every: float, rounds: int | None = None, stop: Callable[[], bool] = lambda: False) -> int:
    """Start a run that ends by itself again and again, ``every`` seconds apart; gives how many failed.

    ``start`` gives a query that takes what has come in (``intake``, ``post``). A run that fails is logged
    and the next one goes on from its checkpoint. Ends after ``rounds``, or once ``stop`` says so.
    """
    failed = done = 0
    while (rounds is None or done < rounds) and not stop():
        begun = time.monotonic()
        try:
            start().awaitTermination()
        except StreamingQueryException as error:
            failed += 1
            logging.getLogger(__name__).warning("a poll failed: %s", str(error).split("\n", 1)[0])
        done += 1
        if (rounds is None or done < rounds) and not stop():
            time.sleep(max(0.0, every - (time.monotonic() - begun)))
    return failed


def post(requests: DataFrame, keys: Sequence[str], ledger: str, checkpoint: str, send: Callable[[dict, str], None]) -> StreamingQuery:
    """Send each row of a stream once, by tasks, and stop when all that has come in is sent.

    ``send`` gets a row and its idempotency key, the digest of the batch's number and the row's ``keys``.
    What has been sent is noted at once in ``ledger``, a folder that executors share: a batch that fails
    half-way runs again under its old number, and rows that are noted there aren't sent again. Between
    sending and noting a task can be lost; the other side then gets the same key once more and should
    take it for the same request. Rows of equal keys in a batch are one request. Leave speculation off.
    """
    ship(requests.sparkSession)
    names = requests.columns

    def sent(place: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            store, root = filesystem(place)
            store.create_dir(root, recursive=True)
            for batch in batches:
                done = []
                for row in batch.to_pylist():
                    key = row.pop("_request")
                    if store.get_file_info(f"{root}/{key}").type == pafs.FileType.NotFound:
                        send(row, key)
                        with store.open_output_stream(f"{root}/{key}") as mark:
                            mark.write(b"")
                        done.append(key)
                yield pa.RecordBatch.from_pydict({"request": pa.array(done, pa.string())})

        return run

    def handle(batch: DataFrame, number: int) -> None:
        request = F.sha2(F.to_json(F.struct(F.lit(number).alias("batch"), *keys), {"ignoreNullFields": "false"}), 256)
        rows = batch.dropDuplicates(list(keys)).select(*names, request.alias("_request"))
        rows.mapInArrow(sent(f"{ledger.rstrip('/')}/batch={number}"), "request string").write.format("noop").mode("overwrite").save()

    return intake(requests, checkpoint, handle)


#: Seconds that times are moved by for the engine, whose watermark begins at 0 and takes all up to it for late;
#: so times from 1902 to 2191 are in order.
SHIFT = 1 << 31
#: The state store that timers and lists of state need.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextlib.contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that are started within keep their state in RocksDB; the session's setting comes back after."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def _mark(at: float) -> int:
    """The first millisecond of the engine's that isn't before a time."""
    return math.ceil(at * 1000) + SHIFT * 1000


class Limiter(StatefulProcessor):
    """Lets each key of a group make ``most`` calls in any ``window`` seconds, in the order of their times.

    Each exchange with the store costs more than many calls, so keys share their group's state. Calls
    wait in a buffer, a chunk for each frame, until the watermark has passed them: no earlier one can come
    then. A timer stands at the first of the buffer; when it fires, all that the watermark has passed are
    taken in order. What has been let through is kept as the times of the last ``most`` calls of a key that
    are less than ``window`` behind the watermark; older ones hold no later call back.
    """

    def __init__(self, key: str, kind: str, at: str, most: int, window: float) -> None:
        self.key, self.kind, self.at, self.most, self.window = key, kind, at, most, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", f"keys array<{self.kind}>, at array<double>")
        self.passed = handle.getValueState("passed", f"keys array<{self.kind}>, times array<array<double>>")
        self.first = handle.getValueState("first", "at double")

    def _wait_for(self, at: float) -> None:
        self.handle.registerTimer(_mark(at))
        self.first.update((at,))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        least = math.inf
        for frame in rows:
            times = frame[self.at].tolist()
            self.pending.appendValue((frame[self.key].tolist(), times))
            least = min([least, *times])
        known = self.first.get()[0] if self.first.exists() else math.inf
        if least < known:
            if known < math.inf and _mark(known) != _mark(least):
                self.handle.deleteTimer(_mark(known))
            self._wait_for(least)
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        upto = timerValues.getCurrentWatermarkInMs() - SHIFT * 1000
        held = sorted((call for keys, times in self.pending.get() for call in zip(times, keys, strict=True)), key=lambda call: call[0])
        ready = bisect.bisect_right(held, upto, key=lambda call: call[0] * 1000)
        passed = {k: list(times) for k, times in zip(*self.passed.get(), strict=True)} if self.passed.exists() else {}
        waits = []
        for now, who in held[:ready]:
            times = passed.get(who, [])
            wait = max(0.0, times[-self.most] + self.window - now) if len(times) >= self.most else 0.0
            passed[who] = [*times, now + wait][-self.most :]
            waits.append((who, now, wait))
        if ready:
            live = {k: late for k, times in passed.items() if (late := [t for t in times if (t + self.window) * 1000 > upto])}
            self.passed.update((list(live), list(live.values())))
        if ready < len(held):
            self.pending.put([([k for _, k in held[ready:]], [t for t, _ in held[ready:]])])
            self._wait_for(held[ready][0])
        else:
            self.pending.clear()
            self.first.clear()
        if waits:
            yield pd.DataFrame(waits, columns=[self.key, self.at, "wait"])

    def close(self) -> None:
        pass


def limited(calls: DataFrame, key: str = "user_id", at: str = "seconds", most: int = LIMITS.search_calls, window: float = LIMITS.search_seconds, delay: str = "0 seconds", groups: int = 1024) -> DataFrame:
    """``(key, at, wait)``: how long each call of a stream must wait so that any window holds ``most`` calls.

    Calls are taken in the order of ``at`` (seconds), however they are split over frames, batches and
    files: one is given out once the watermark, ``delay`` behind the latest call, has passed it. A call
    that comes later than that is dropped, and counted by the engine in ``numRowsDroppedByWatermark``;
    choose ``delay`` as long as calls may be late. Calls of one time come out each, null times and keys
    make no call; keys are numbers or strings. They share the state of ``groups`` hash groups, of which a task
    takes one at a time; a stream must go on with the number that it began with. State is what waits, and of
    each key the times of its last ``most`` calls in the last ``window``, so it doesn't grow with the past. Start
    the stream within ``rocksdb``.
    """
    if not calls.isStreaming:
        raise ValueError("calls are limited as they come in: read them as a stream")
    ship(calls.sparkSession)
    kind = calls.schema[key].dataType.simpleString()
    own = calls.select(key, F.col(at).cast("double").alias(at)).where(F.col(at).isNotNull() & F.col(key).isNotNull())
    timed = own.withColumn("_time", F.timestamp_micros(F.ceil(F.col(at) * 1_000_000).cast("long") + SHIFT * 1_000_000)).withWatermark("_time", delay)
    grouped = timed.withColumn("_group", F.pmod(F.hash(key), F.lit(groups))).groupBy("_group")
    return grouped.transformWithStateInPandas(Limiter(key, kind, at, most, window), f"{key} {kind}, {at} double, wait double", "append", "eventTime")
