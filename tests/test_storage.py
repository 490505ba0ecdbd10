"""Files under their names, beginnings of files, ledgers in ranges, and ranks by narrowing."""

import glob
import json
import os
import random
import tarfile
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veriloom.operators import ledger as L
from veriloom.operators.selection import select_rank
from veriloom.sources import files
from veriloom.sources.named import file_heads, packed_files, write_named


def test_records_are_files_under_their_names(spark, tmp_path):
    rows = [(1, "a b.pdf", "x"), (2, "a b.pdf", "y"), (3, "c", None), (4, "a_b.PDF", "z"), (5, "*.pdf", "q")]
    df = spark.createDataFrame(rows, "doc_id long, file string, v string").repartition(3)
    records = df.select("doc_id", files.record_name(F.col("file"), "en").alias("name"), F.struct("v").alias("record"))
    files.write_records(records, str(tmp_path / "out"))
    names = sorted(os.listdir(tmp_path / "out"))
    assert names == ["_.insight.en.json", "a_b-2.insight.en.json", "a_b-3.insight.en.json", "a_b.insight.en.json", "c.insight.en.json"]
    back = {r.name: r.record.v for r in files.read_records_files(spark, str(tmp_path / "out"), "struct<v:string>").collect()}
    assert back == {"a_b.insight.en.json": "x", "a_b-2.insight.en.json": "y", "a_b-3.insight.en.json": "z", "c.insight.en.json": None, "_.insight.en.json": "q"}


def test_an_aborted_write_leaves_no_file(spark, tmp_path):
    df = spark.range(40).repartition(4).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("name"), F.when(F.col("id") == 33, F.raise_error(F.lit("stop"))).otherwise(F.lit("x")).cast("binary").alias("content"))
    with pytest.raises(Exception, match="stop"):
        write_named(df, str(tmp_path / "out"))
    assert [p for p in glob.glob(str(tmp_path / "out" / "**"), recursive=True) if os.path.isfile(p)] == []


def test_only_the_beginnings_of_files_are_read(spark, tmp_path):
    bodies = {"a.pdf": b"%PDF-1.4" + b"x" * 5000, "b.PDF": b"", "c.txt": b"%PDF-", "d.pdf": b"y" * 1020 + b"%PDF-", "sub/e.pdf": b"z%PDF-", ".hidden": b"x"}
    (tmp_path / "in" / "sub").mkdir(parents=True)
    for name, body in bodies.items():
        (tmp_path / "in" / name).write_bytes(body)
    heads = file_heads(spark, str(tmp_path / "in"), per_task=2)
    assert heads.rdd.getNumPartitions() == 3 and {len(r.head) for r in heads.collect()} <= {0, 5, 6, 1024}
    codes = {os.path.basename(r.path): (r.code, r.length) for r in files.admit_files(heads.withColumn("mime", F.lit(None).cast("string"))).collect()}
    assert codes == {"a.pdf": ("OK", 5008), "b.PDF": ("EMPTY", 0), "c.txt": ("NOT_PDF", 5), "d.pdf": ("BAD_SIGNATURE", 1025), "e.pdf": ("OK", 6)}
    assert file_heads(spark, f"file://{tmp_path}/in/sub").count() == 1


def test_files_are_written_and_read_in_any_thread(spark, tmp_path):
    df = spark.range(3).select(F.col("id").cast("string").alias("name"), F.lit("x").cast("binary").alias("content"))

    def there_and_back(folder):
        write_named(df, folder)
        return file_heads(spark, folder).count()

    with ThreadPoolExecutor(2) as pool:
        assert list(pool.map(there_and_back, [str(tmp_path / "a"), str(tmp_path / "b")])) == [3, 3]


def parts(path):
    return {r: set(glob.glob(f"{path}/range={r}/part-*")) for r in range(8)}


def test_changes_of_a_stored_ledger_rewrite_only_what_they_touch(spark, tmp_path):
    path, kind = str(tmp_path / "ledger"), "id long, saved_at timestamp, file_hash string, n int"
    t = F.timestamp_seconds(F.lit(5))
    entries = spark.range(60).select("id", t.alias("saved_at"), F.when(F.col("id") % 10 != 0, F.concat(F.lit("h"), F.col("id").cast("string"))).alias("file_hash"), F.lit(0).alias("n"))
    L.write_ledger(entries, path, 8)
    before, new = parts(path), spark.createDataFrame([(100, None, "h1", 1), (101, None, "h77", 1)], kind)
    L.upsert_ranges(spark, path, new, 8)
    want = {tuple(r) for r in L.upsert_ledger(entries, new).collect()}
    assert {tuple(r) for r in L.read_ledger(spark, path).select("id", "saved_at", "file_hash", "n").collect()} == want
    after = parts(path)
    assert 1 <= sum(before[r] != after[r] for r in range(8)) <= 2
    L.upsert_ranges(spark, path, new, 8)
    assert {tuple(r) for r in L.read_ledger(spark, path).select("id", "saved_at", "file_hash", "n").collect()} == want
    only = spark.read.parquet(path).where("range = 3").select("id")
    gone = {r.id for r in only.collect()}
    again = parts(path)
    L.remove_ranges(spark, path, spark.createDataFrame([(i,) for i in gone], "id long"))
    left = L.read_ledger(spark, path)
    assert {r.id for r in left.collect()} == {w[0] for w in want} - gone and left.where("id is null").count() == 0
    assert [r for r in range(8) if again[r] != parts(path)[r]] == [3]
    L.upsert_ranges(spark, path, new.where("false"), 8)


@pytest.mark.parametrize("lower", [True, False])
def test_ranks_equal_sorting(spark, lower):
    rng = random.Random(9)
    groups = {"a": [rng.gauss(0, 1) for _ in range(2001)], "b": [5.0] * 40, "c": [1e308, -1e308, 0.0, 5e-324], "d": [rng.choice([1.0, 2.0, 2.0, 1e9]) for _ in range(300)], "e": [-0.5], "f": [2.0**i for i in range(-300, 300)], "g": [None, float("nan"), 3.0, 4.0]}
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("h", None)]
    rng.shuffle(rows)
    n = F.col("n")
    got = {r.k: r.v for r in select_rank(spark.createDataFrame(rows, "k string, v double").repartition(4), ["k"], "v", F.floor((n - 1) / 2) if lower else F.floor(n / 2), buckets=64).collect()}
    want = {}
    for k, vs in groups.items():
        vs = sorted(v for v in vs if v is not None and v == v)
        want[k] = vs[(len(vs) - 1) // 2 if lower else len(vs) // 2]
    assert got == want


def test_packed_records_are_members_of_tar_volumes(spark, tmp_path, monkeypatch):
    """Names of any length and script, repeated rows, and as few files of the disk as there are volumes."""
    monkeypatch.setattr("veriloom.sources.named._MEMBERS", 7)
    rows = [(i // 2, f"a {i % 3}.pdf", str(i)) for i in range(60)] + [(90, "ż" * 60, "long"), (91, "x" * 101, "y"), (92, "c", None), (92, "c", None), (93, "ł.pdf", "é" * 600)]
    df = spark.createDataFrame(rows, "doc_id long, file string, v string").repartition(3)
    records = df.select("doc_id", files.record_name(F.col("file")).alias("name"), F.struct("v").alias("record"))
    files.write_records(records, str(tmp_path / "loose"))
    files.write_records(records, str(tmp_path / "packed"), packed=True)
    read = lambda folder, packed: sorted((r.name, r.record.v) for r in files.read_records_files(spark, str(tmp_path / folder), "struct<v:string>", packed).where("name not like 'a%'").select("name", "record").collect() if r.record)
    assert read("packed", True) == read("loose", False) and len(read("packed", True)) == 5
    volumes = glob.glob(str(tmp_path / "packed" / "*"))
    assert all(v.endswith(".tar.zst") for v in volumes) and len(volumes) < 30
    names, bodies = set(), {}
    for v in volumes:
        with pa.CompressedInputStream(v, "zstd") as stream, tarfile.open(fileobj=stream, mode="r|") as volume:
            for info in volume:
                names.add(info.name)
                bodies[info.name] = volume.extractfile(info).read().decode()
    assert names == set(os.listdir(tmp_path / "loose")) and len(names) == 65
    by_name = {}  # of equal names the smaller doc_id comes first
    for d, f, v in sorted(rows[:60]):
        by_name.setdefault(f[2], []).append({v2 for d2, f2, v2 in rows[:60] if (d2, f2) == (d, f)})
    for k, told in by_name.items():
        for nth, allowed in enumerate(told):
            assert json.loads(bodies[f"a_{k}{f'-{nth + 1}' if nth else ''}.insight.json"])["v"] in allowed


def test_an_aborted_packed_write_leaves_no_file(spark, tmp_path):
    df = spark.range(40).repartition(4).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("name"), F.when(F.col("id") == 33, F.raise_error(F.lit("stop"))).otherwise(F.lit("x")).cast("binary").alias("content"))
    with pytest.raises(Exception, match="stop"):
        write_named(df, str(tmp_path / "out"), packed=True)
    assert [p for p in glob.glob(str(tmp_path / "out" / "**"), recursive=True) if os.path.isfile(p)] == []
    write_named(df.where("id <> 33 and id < 0"), str(tmp_path / "none"), packed=True)
    assert packed_files(spark, str(tmp_path / "none")).count() == 0
