import datetime as dt
import glob
import os
import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from veriloom.operators.ledger import upsert_ledger
from veriloom.plans.verify import incremental_verify
from veriloom.streaming.arrivals import batch_handler, incremental, read_ledger, start_ledger
from veriloom.streaming.limits import ROCKSDB, accept, rate_limit, rate_limit_stream


def test_rate_limit_stream_equals_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    base = dt.datetime(2026, 1, 1)
    rows = [(f"k{i % 3}", base + dt.timedelta(minutes=7 * i % 400), i) for i in range(120)]
    events = spark.createDataFrame(rows, "key string, ts timestamp, id long")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = rate_limit_stream(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), 2, 3600)
    query = stream.writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r.key, r.id): r.allowed for r in spark.table("limited").collect()}
    want = {(r.key, r.id): r.allowed for r in rate_limit(events, 2, 3600).collect()}
    assert got == want and False in want.values()


def test_incremental_stream_skips_repeats(spark, tmp_path):
    for i in range(2):
        spark.createDataFrame([(f"h{j}", j) for j in range(i, i + 3)], "file_hash string, id long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seen = []
    files = spark.readStream.schema("file_hash string, id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    incremental(files.withColumn("id", files["id"]), lambda batch, n: seen.extend(r.file_hash for r in batch.collect()), str(tmp_path / "c")).awaitTermination(120)
    assert sorted(seen) == ["h0", "h1", "h2", "h3"]


def test_incremental_runs_verify_what_is_new_and_upsert_it(spark):
    kind = "id long, doc_id long, saved_at timestamp, owner string, file_hash string, pipeline_version int, backup boolean"
    t = dt.datetime(2026, 1, 1)
    ledger = spark.createDataFrame([(1, 1, t, "a", "h1", 2, False, 7), (2, 2, t, "a", "h2", 1, False, 8)], kind + ", n long")
    files = spark.createDataFrame([(3, 3, t, "a", "h1", 2, False), (4, 4, t, "a", "h2", 2, False), (5, 5, t, "a", "h5", 2, False), (6, 6, t, "a", "h5", 2, False)], kind)
    asked = []

    def check(fresh):
        asked.extend(sorted(r.file_hash for r in fresh.collect()))
        return fresh.select("doc_id", fresh["doc_id"].alias("n"))

    after, answered = incremental_verify(files, ledger, 2, check)
    assert asked == ["h2", "h5"] and [(r.id, r.reused_id) for r in answered.collect()] == [(3, 1)]
    rows = {r.file_hash: (r.id, r.n) for r in after.collect()}
    assert rows["h1"] == (1, 7) and rows["h2"] == (4, 4) and rows["h5"][0] in (5, 6) and len(rows) == 3
    assert upsert_ledger(after, after).count() == 3


KIND = "id long, doc_id long, saved_at timestamp, owner string, file_hash string, pipeline_version int, backup boolean"


def arriving(spark, folder, batches):
    """A stream that gets a file of rows (id, hash) a batch."""
    t = dt.datetime(2026, 1, 1)
    for n, rows in enumerate(batches):
        spark.createDataFrame([(i, i, t + dt.timedelta(hours=i), "a", h, 2, False) for i, h in rows], KIND).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        for f in glob.glob(f"{folder}/in/part-*"):
            if not os.path.exists(f + ".seen"):
                os.utime(f, (1_700_000_000 + n, 1_700_000_000 + n))
                open(f + ".seen", "w").close()
    for f in glob.glob(f"{folder}/in/*.seen"):
        os.remove(f)
    return spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


@pytest.mark.parametrize("fails", ["before", "after"])
def test_a_stream_that_is_killed_and_restarted_leaves_the_ledger_of_the_batch_form(spark, tmp_path, fails):
    t = dt.datetime(2025, 1, 1)
    old = spark.createDataFrame([(1, 1, t, "a", "h1", 2, False, 7), (2, 2, t, "a", "h2", 1, False, 8), (3, 3, t, "a", None, 2, False, 9)], KIND + ", n long")
    batches = [[(10, "h1"), (11, "h2"), (12, "h5"), (13, None)], [(14, "h5"), (15, "h6"), (16, None), (17, "h6")], [(18, "h1"), (19, "h7"), (20, "h2")]]
    asked = []

    def check(fresh):
        asked.append(sorted(r.id for r in fresh.collect()))
        return fresh.select("doc_id", (F.col("id") * 100).alias("n"))

    start_ledger(old, str(tmp_path / "ledger"))
    files, handle = arriving(spark, str(tmp_path), batches), batch_handler(spark, str(tmp_path / "ledger"), 2, check)
    tried = []

    def killed(batch, number):
        tried.append(number)
        if fails == "after" or number != 1:
            handle(batch, number)
        if number == 1:
            raise RuntimeError("killed")

    with pytest.raises(StreamingQueryException):
        incremental(files, killed, str(tmp_path / "c")).awaitTermination(180)
    assert tried == [0, 1]
    incremental(files, handle, str(tmp_path / "c")).awaitTermination(180)
    got = {(r.file_hash, r.id, r.n) for r in read_ledger(spark, str(tmp_path / "ledger")).collect()}
    whole = spark.createDataFrame([(i, i, dt.datetime(2026, 1, 1) + dt.timedelta(hours=i), "a", h, 2, False) for rows in batches for i, h in rows], KIND)
    want, _ = incremental_verify(whole, old, 2, lambda fresh: fresh.select("doc_id", (F.col("id") * 100).alias("n")))
    assert got == {(r.file_hash, r.id, r.n) for r in want.collect()} and ("h6", 15, 1500) in got and (None, 16, 1600) in got
    assert asked[0] == [11, 12, 13] and asked[-1] == [19] and [a for a in asked[1:-1] if a] == [[15, 16]] * (1 + (fails == "after"))


def test_rate_limits_by_scope_equal_a_loop(spark, tmp_path):
    rng, base = random.Random(4), dt.datetime(2026, 1, 1)
    rows, now = [], 0
    for i in range(600):
        now += rng.choice([1, 30, 200, 5000])
        rows.append((rng.choice(["hot", "hot", "hot", "b", None]), rng.choice(["x", "y", "open", None]), base + dt.timedelta(seconds=now), i))
    events = spark.createDataFrame(rows, "key string, scope string, ts timestamp, id long")
    limits, held, want = {"x": 1, "y": 3}, {}, {}
    for key, scope, ts, i in rows:
        if scope not in limits:
            want[i] = True
            continue
        held[key, scope], want[i] = accept(held.get((key, scope), ()), int((ts - base).total_seconds() * 1_000_000), limits[scope], 3600 * 1_000_000)
    assert {r.id: r.allowed for r in rate_limit(events, limits, 3600).collect()} == want and False in want.values()
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    known = events.where("key is not null and scope is not null")
    known.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = rate_limit_stream(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), limits, 3600)
    query = stream.writeStream.format("memory").queryName("scoped").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {r.id: r.allowed for r in spark.table("scoped").collect()} == {r.id: want[r.id] for r in known.collect()}
