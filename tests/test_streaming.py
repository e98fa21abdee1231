"""Folds over a growing trace against the folds of whole tables: restarts, several groups, idle groups."""

import random
import time

import pytest
from pyspark.sql import functions as F

from lodestone.operators import folds
from lodestone.streaming import observer

SCHEMA = "g string, k long, x double, d double, better boolean"


@pytest.fixture
def rocks(spark):
    kept = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    observer.use_state_store(spark)
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", kept)


def trace(n=60):
    rng = random.Random(5)
    return [(g, k, rng.choice([0.0, 1.0, 2.5, 4.0]), rng.random(), rng.random() < 0.3) for k in range(n) for g in "abc" if g != "c" or k < 4]


def drain(out, folder, seen):
    def keep(batch, number):
        seen.extend(batch.collect())

    out.writeStream.outputMode("append").foreachBatch(keep).option("checkpointLocation", folder).trigger(availableNow=True).start().awaitTermination(300)


@pytest.mark.parametrize("which", ["patience", "rate"])
def test_folds_of_a_growing_trace(rocks, tmp_path, which):
    rows = trace()
    source = f"{tmp_path}/in"
    whole = rocks.createDataFrame(rows, SCHEMA)
    if which == "patience":
        fold = lambda m, df: m.patience(df, "g", "k", "x", 1.0, 3)
        names = ["reference", "counter", "stagnated"]
    else:
        fold = lambda m, df: m.adaptive_rate(df, "g", "k", "d", "better", 0.2, 0.1, 0.9, 0.05, 0.3)
        names = ["rate", "stagnant", "reason"]
    seen = []
    for low, high in ((0, 13), (13, 14), (14, 60)):  # the query ends and is started again from its checkpoint
        whole.where(F.col("k").between(low, high - 1)).coalesce(1).write.mode("append").parquet(source)
        drain(fold(observer, observer.read_trace(rocks, source, SCHEMA)), f"{tmp_path}/c", seen)
    want = {(r.g, r.k): tuple(r[n] for n in names) for r in fold(folds, whole).collect()}
    assert {(r["group"], r["order"]): tuple(r[n] for n in names) for r in seen} == want and len(seen) == len(want)
    assert not any(r["closed"] for r in seen) and max(r["seen"] for r in seen if r["group"] == "c") == 4


def test_idle_groups_are_closed(rocks, tmp_path):
    source = f"{tmp_path}/in"
    rocks.createDataFrame(trace(5), SCHEMA).coalesce(1).write.parquet(source)
    out = observer.patience(observer.read_trace(rocks, source, SCHEMA), "g", "k", "x", 1.0, 3, idle_ms=1500)
    asked = out.writeStream.outputMode("append").format("memory").queryName("idle").option("checkpointLocation", f"{tmp_path}/c").trigger(processingTime="300 milliseconds").start()
    try:
        end = time.time() + 90
        while time.time() < end and rocks.table("idle").where("closed").count() < 3:
            time.sleep(1)
    finally:
        asked.stop()
    closed = {r["group"]: (r["seen"], r["reference"]) for r in rocks.table("idle").where("closed").collect()}
    last = {r.g: r.reference for r in folds.patience(rocks.createDataFrame(trace(5), SCHEMA), "g", "k", "x", 1.0, 3).orderBy("k").collect()}
    assert closed == {"a": (5, last["a"]), "b": (5, last["b"]), "c": (4, last["c"])}
