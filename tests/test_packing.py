"""Packing by pointer jumping and running sums in two levels, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from veriloom.operators import chunking
from veriloom.operators.packing import pack
from veriloom.operators.running import dealt, running


def packed(rows, room, most):
    """The chunk of each (size, alone, blank, counted) row of one key."""
    out, number, used, shown, closed = [], -1, 0, 0, True
    for size, alone, blank, counted in rows:
        alone = alone or size > room
        if not closed and (alone or used + size > room or (most and counted and shown >= most)):
            closed = True
        if closed and blank:
            out.append(None)
            continue
        if closed:
            number, used, shown, closed = number + 1, 0, 0, False
        used, shown = used + size, shown + counted
        out.append(number)
        closed = alone
    return out


@pytest.mark.parametrize("seed", range(4))
def test_packs_as_a_loop_does(spark, seed):
    rng = random.Random(seed)
    room, most = rng.choice([5, 30]), rng.choice([0, 2])
    keys = {k: [(rng.choice([0, 1, 2, 3, room, room + 1]) if rng.random() < 0.5 else rng.randrange(1, 4), rng.random() < 0.05, False, most > 0 and rng.random() < 0.4) for _ in range(n)] for k, n in ((1, 200), (2, 1), (3, 40), (4, 0), (5, 12))}
    if seed % 2:  # blank rows weigh one
        keys = {k: [(1, False, True, False) if rng.random() < 0.3 else (max(1, s), a, False, c) for s, a, _, c in rows] for k, rows in keys.items()}
    rows = [(k, i, *r) for k, rs in keys.items() for i, r in enumerate(rs)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k long, i int, size long, alone boolean, blank boolean, image boolean").repartition(5)
    got = pack(df, ["k"], ["i"], F.col("size"), room, "chunk", alone=F.col("alone"), blank=F.col("blank"), counted=F.col("image") if most else None, most=most)
    found = {(r.k, r.i): r.chunk for r in got.collect()}
    want = {(k, i): c for k, rs in keys.items() for i, c in enumerate(packed(rs, room, most))}
    assert found == want


def test_a_long_document_is_many_tasks_work(spark):
    n = 20_000
    df = spark.range(n).select(F.lit(7).cast("long").alias("doc"), F.col("id").alias("i"), (F.col("id") * 7919 % 50).alias("size"))
    got = pack(df, ["doc"], ["i"], F.col("size"), 400, "chunk").orderBy("i").collect()
    assert [r.chunk for r in got] == packed([(i * 7919 % 50, False, False, False) for i in range(n)], 400, 0)
    ranges = dealt(df, ["doc"], ["i"]).groupBy("__range").count().collect()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        spread = dealt(df, ["doc"], ["i"]).groupBy("__range").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(spread) >= 6 and max(r["count"] for r in spread) < n / 3 and sum(r["count"] for r in ranges) == n


def test_running_sums_and_maxima(spark):
    rng = random.Random(1)
    rows = [(rng.choice("abz"), i, rng.choice([None, 1, 5, 9])) for i in range(500)]
    df = dealt(spark.createDataFrame(rows, "k string, i int, v long").repartition(3), ["k"], ["i"])
    for inclusive in (False, True):
        sums = {(r.k, r.i): r.s for r in running(df, ["k"], ["i"], {"s": F.col("v")}, inclusive).collect()}
        tops = {(r.k, r.i): r.t for r in running(df, ["k"], ["i"], {"t": F.col("v")}, inclusive, F.max).collect()}
        for k, i, _ in rows:
            before = [v for k2, i2, v in rows if k2 == k and (i2 < i or inclusive and i2 == i) and v is not None]
            assert sums[k, i] == sum(before) and tops[k, i] == max(before, default=None)


def test_pages_are_taken_apart_in_their_row_as_by_packing(spark, monkeypatch):
    """Pages of few lines and cuts are folded without a shuffle, larger ones packed, with equal pieces."""
    rng = random.Random(3)
    line = lambda: "".join(rng.choice("ab ") for _ in range(rng.choice([0, 0, 1, 3, 5, 9, 10, 11, 19, 20, 21, 40])))
    rows = [(i, 1, "\n".join(line() for _ in range(rng.randint(1, 14)))) for i in range(100)] + [(100, 1, None), (101, 1, "")]
    pages = spark.createDataFrame(rows, "doc_id long, page int, text string")
    for blank_lines in (True, False):
        monkeypatch.setattr(chunking, "_FOLDED", 4096)
        folded = chunking.split_long_pages(pages, 10, blank_lines=blank_lines)
        assert "Exchange" not in folded._jdf.queryExecution().executedPlan().toString()
        monkeypatch.setattr(chunking, "_FOLDED", 6)
        packed = chunking.split_long_pages(pages, 10, blank_lines=blank_lines)
        assert sorted(map(tuple, folded.collect())) == sorted(map(tuple, packed.collect()))
