"""SimHash near-duplicates, found with BK-trees over shards of fingerprints.

Two fingerprints that differ in at most two bits agree in at least two of four 16-bit blocks, so
each is filed under its six pairs of blocks and every linked pair meets in a shard. A shard's
fingerprints form a BK-tree (children keyed by their Hamming distance to the parent), and a search
follows only the edges within the radius. A shard above ``max_shard`` is filed again by pairs of
four 8-bit blocks of its other 32 bits; such a shard holds at most 2^16 fingerprints by
construction.

What prunes: in a corpus of unrelated texts the filing leaves few fingerprints in a shard, and a pair
in a shard of two is compared without a tree. The trees do the pruning where fingerprints crowd: in
groups of near copies and in shards that are filed again. Trees stay where their shard is: together
they grow with the corpus, so they are dealt out with the fingerprints that ask them instead of
being sent to every task.

A shard reports a spanning forest of its links, never all pairs; connected components join the
forests.
"""

from collections.abc import Iterator
from itertools import chain, combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from .components import connected_components
from .tables import cut, free_name

RADIUS = 2
SEED = 42


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """64-bit SimHash of a UTF-8 text, unsigned; 0 without words."""
    words = (text or b"").lower().split()  # bytes: A-Z only, and exactly the ASCII white space
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else iter([b" ".join(words)])
    n = max(1, len(words) - shingle + 1)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), dtype=np.uint64, count=n)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 15):
        ones += np.unpackbits(hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, tid, fp) for every row of ``docs`` (doc_id, text); tid is a hash of the text, fp the
    signed form of the bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            fp = np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tid"), pa.array(fp)], ["doc_id", "tid", "fp"])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tid"), text.alias("text")).mapInArrow(run, "doc_id long, tid long, fp long")


class BKTree:
    """Fingerprints by Hamming distance: a node's child at k is the subtree at distance k."""

    __slots__ = ("root",)

    def __init__(self) -> None:
        self.root: tuple[int, dict] | None = None

    def add(self, fp: int) -> None:
        if self.root is None:
            self.root = (fp, {})
            return
        node = self.root
        while (d := (node[0] ^ fp).bit_count()) and d in node[1]:
            node = node[1][d]
        if d:
            node[1][d] = (fp, {})

    def within(self, fp: int, radius: int) -> list[int]:
        found, open_nodes = [], [self.root] if self.root else []
        while open_nodes:
            at, children = open_nodes.pop()
            d = (at ^ fp).bit_count()
            if d <= radius:
                found.append(at)
            if children:
                for k in range(d - radius, d + radius + 1):
                    if k in children:
                        open_nodes.append(children[k])
        return found


def spanning_forest(shard: list[int], radius: int) -> list[tuple[int, int]]:
    """(fingerprint, root of its component) for all linked fingerprints of a shard but the roots."""
    if len(shard) == 2:
        a, b = shard
        return [(a, b)] if a != b and (a ^ b).bit_count() <= radius else []
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(up, up)
        return x

    tree = BKTree()
    for fp in shard:
        for other in tree.within(fp, radius):
            a, b = root(fp), root(other)
            if a != b:
                parent[max(a, b)] = min(a, b)
        tree.add(fp)
    return [(x, r) for x in list(parent) if (r := root(x)) != x]


def _block(fp: Column, at: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, at * width).bitwiseAND(F.lit((1 << width) - 1))


def _shard_keys(fp: Column) -> Column:
    """The six (pair of blocks, their 32 bits) keys of a fingerprint, as one long each."""
    return F.array(*(F.lit(i << 32).cast("long") + _block(fp, a, 16) * 65536 + _block(fp, b, 16) for i, (a, b) in enumerate(combinations(range(4), 2))))


def _finer_keys(key: Column, fp: Column) -> Column:
    """Of a shard's key and a fingerprint in it: six keys from the 32 bits that the shard leaves
    open, as (pair of blocks, their 16 bits)."""
    pairs = list(combinations(range(4), 2))
    out = F.lit(None).cast("array<int>")
    for i, taken in enumerate(pairs):
        free = [8 * (2 * b + half) for b in range(4) if b not in taken for half in (0, 1)]
        part = [F.shiftrightunsigned(fp, s).bitwiseAND(F.lit(255)) for s in free]
        keys = F.array(*((F.lit(j << 16) + part[a] * 256 + part[b]).cast("int") for j, (a, b) in enumerate(pairs)))
        out = F.when(F.shiftright(key, 32) == i, keys).otherwise(out)
    return out


def links(fps: DataFrame, radius: int = RADIUS, max_shard: int = 4096) -> DataFrame:
    """A spanning forest (a, b) of the links among distinct fingerprints ``fps`` (fp)."""
    if radius > 2:
        raise ValueError("shards hold links of at most two differing bits")
    filed = fps.select("fp", F.explode(_shard_keys(F.col("fp"))).alias("key"))
    large = cut(filed.groupBy("key").count().where(F.col("count") > max_shard).select("key"))
    if large.isEmpty():
        shards = filed.select("key", F.lit(-1).alias("finer"), "fp")
    else:
        again = filed.join(large, "key", "left_semi")
        shards = filed.join(large, "key", "left_anti").select("key", F.lit(-1).alias("finer"), "fp")
        shards = shards.unionByName(again.select("key", F.explode(_finer_keys(F.col("key"), F.col("fp"))).alias("finer"), "fp"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in chain(batches, [None]):  # a shard may go on in the next batch
            if batch is not None:
                rows = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("key", "finer", "fp")])
                rest = rows if rest is None else np.concatenate([rest, rows], axis=1)
            if rest is None or not rest.shape[1]:
                continue
            starts = np.flatnonzero(np.r_[True, (rest[:2, 1:] != rest[:2, :-1]).any(axis=0)])
            ends = np.r_[starts[1:], rest.shape[1]]
            if batch is not None:
                rest, starts, ends, done = rest[:, starts[-1] :], starts[:-1], ends[:-1], rest
            else:
                done, rest = rest, None
            found = []
            for s, e in zip(starts[ends - starts > 1], ends[ends - starts > 1]):
                found += spanning_forest(done[2, s:e].view(np.uint64).tolist(), radius)
            pairs = np.array(found, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return shards.repartition("key", "finer").sortWithinPartitions("key", "finer", "fp").mapInArrow(run, "a long, b long")


def _grouped(docs: DataFrame, shingle: int, radius: int, max_shard: int) -> tuple[DataFrame, DataFrame]:
    """The fingerprints of ``docs``, and (fp, root, component_id) of each different one."""
    marked = cut(fingerprints(docs, shingle))
    first = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    member = connected_components(links(first.select("fp"), radius, max_shard))
    rooted = cut(first.join(member.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return marked, cut(rooted.select("fp", "root").join(smallest, "root").select("fp", "root", "component_id"))


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = RADIUS, max_shard: int = 4096) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs`` (doc_id, text).

    The component is the smallest doc_id that is reachable over links of at most ``radius``
    differing bits. A null or empty text has fingerprint zero and links like any other. Rows that
    repeat a doc_id stay, each with its own text's fingerprint. A row with a null doc_id links its
    fingerprint, but is never a component's id; where no row has an id the component is null.
    """
    marked, of_fp = _grouped(docs, shingle, radius, max_shard)
    named = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return marked.join(of_fp, "fp").select("doc_id", named, "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, radius: int = RADIUS, max_shard: int = 4096) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates: that of its smallest doc_id. Where
    rows share that doc_id, the one with the smallest text hash in the group stays, so that a text
    goes only if another of its own group is kept. Rows without a doc_id cannot be told apart and
    stay."""
    marked, of_fp = _grouped(docs.select("doc_id", "text"), shingle, radius, max_shard)
    kept, tid, order = (free_name(docs, name) for name in ("kept", "tid", "order"))
    keepers = marked.join(of_fp, "fp").where(F.col("doc_id") == F.col("component_id")).groupBy("root").agg(F.min("doc_id").alias(kept), F.min("tid").alias(tid)).select(kept, tid).distinct()
    nth = F.row_number().over(Window.partitionBy(kept, tid).orderBy(F.lit(0)))  # repeated rows are alike
    same = (docs["doc_id"].cast("long") == F.col(kept)) & (F.xxhash64(docs["text"].cast("string")) == F.col(tid))
    stay = docs.join(keepers, same).withColumn(order, nth).where(F.col(order) == 1)
    return stay.select(*docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))
