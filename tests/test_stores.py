import json
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lumenspan.sources import landed, sinks
from lumenspan.streaming import events


def test_versions(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = lambda n: spark.createDataFrame([(k, n) for k in range(5)], "k int, schema_version int")
    sinks.write_store(rows(1), path)
    old = landed.store(spark, path, "k int, schema_version int")
    assert old.count() == 5
    # A write that fails is without effect, and so is what it has left.
    broken = rows(2).withColumn("k", F.when(F.col("k") == 3, F.raise_error("stop").cast("int")).otherwise(F.col("k")))
    with pytest.raises(Exception, match="stop"):
        sinks.write_store(broken, path)
    assert landed.store(spark, path, "k int", 1).count() == 5
    # A store may be written from itself; who reads the version before still can.
    sinks.write_store(landed.store(spark, path, "k int, schema_version int").withColumn("schema_version", F.lit(2)), path)
    assert landed.store(spark, path, "k int", 2).count() == 5 and landed.store(spark, path, "k int", 1).count() == 0
    assert old.count() == 5
    for n in (3, 4):
        sinks.write_store(rows(n), path)
    assert landed.store(spark, path, "k int", 4).count() == 5
    assert len([d for d in os.listdir(path) if d.startswith("v-")]) == sinks.KEPT_VERSIONS
    edges = spark.createDataFrame([("A", "B")], "obj string, referenced_object_name string")
    sinks.write_snapshot(edges, str(tmp_path / "edges"))
    assert landed.snapshot(spark, str(tmp_path / "edges")).select("OBJ", "REFERENCED_OBJECT_NAME").collect() == [("A", "B")]


def test_requests_are_sent_once(spark, tmp_path):
    put = lambda name, ids: (tmp_path / "in" / name).write_text("\n".join(json.dumps({"id": i, "body": f"b{i}"}) for i in ids))
    (tmp_path / "in").mkdir()
    put("a.json", [*range(20), 3, 3])
    log, broken = tmp_path / "log", tmp_path / "broken"
    broken.touch()

    def send(row, key):
        if row["id"] == 13 and broken.exists():
            raise OSError("the other side is away")
        with open(log, "a") as out:
            out.write(f"{row['id']} {row['body']} {key}\n")

    def start():
        rows = spark.readStream.schema("id long, body string").json(str(tmp_path / "in"))
        return events.post(rows, ["id"], str(tmp_path / "ledger"), str(tmp_path / "marks"), send)

    assert events.poll(start, 0, rounds=2) == 2  # both runs fail at the same row
    half = log.read_text().splitlines()
    assert len(half) == len(set(half)) < 20
    broken.unlink()
    put("b.json", [100])
    assert events.poll(start, 0, rounds=2) == 0
    sent = [x.split() for x in log.read_text().splitlines()]
    assert Counter(int(x[0]) for x in sent) == Counter([*range(20), 100]) and len({x[2] for x in sent}) == 21
    assert events.poll(start, 0, stop=lambda: True) == 0
