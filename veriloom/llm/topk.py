"""Exact top-k inner products: norm-sorted blocks, SVD-rotated partial sums, Cauchy-Schwarz bounds.

Vectors are rotated onto the corpus's singular directions, so that the first coordinates hold most
of every inner product; what the others can add is at most the product of the two residual
lengths. Candidates are dealt out in blocks of descending length. The longest block gives each query a
floor for its k-th score, and so the length that a candidate must have; queries are dealt out in parts
by that length. A block meets only the parts that it reaches, in tasks of their own, and no query
passes the driver. There candidates come by descending length, are scored in full only where the
bound reaches the query's floor, and raise it; where the length alone says that no query can
gain, the task ends.
"""

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window, functions as F

from .tables import cut

SLACK = 1e-9


def to_integers(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component; null for vectors that are null, empty or hold null,
    NaN or infinite components."""
    usable = vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(usable, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def singular_directions(vectors: DataFrame, dims: int) -> np.ndarray:
    """Right singular vectors of all rows by descending singular value, from the Gram matrix, of
    which each task sums its part. The driver holds dims x dims numbers a partition group."""

    def gram(batches):
        total = np.zeros((dims, dims))
        for batch in batches:
            x = np.array(batch["v"].to_list(), dtype=np.float64).reshape(-1, dims)
            total += x.T @ x
        yield pd.DataFrame({"at": np.arange(dims), "row": list(total)})

    rows = vectors.mapInPandas(gram, "at int, row array<double>")
    summed = rows.select("at", F.posexplode("row").alias("to", "x")).groupBy("at", "to").agg(F.sum("x").alias("x"))
    matrix = np.zeros((dims, dims))
    for at, to, x in summed.collect():
        matrix[at, to] = x
    return np.linalg.eigh(matrix)[1][:, ::-1]


class Longest:
    """Some queries' ``k`` best candidates so far, ties to the smaller vec_id, and their floors: the
    score that a candidate must reach to be one of them."""

    def __init__(self, queries: pa.Table, dims: int, k: int, rotation: np.ndarray) -> None:
        self.k, self.rotation, self.head = k, rotation, max(1, dims // 4)
        self.row, self.floor = (queries.column(c).to_numpy() for c in ("row", "floor"))
        self.v = _matrix(queries.column("v"), dims)
        rotated = self.v @ rotation
        self.start, self.length = np.ascontiguousarray(rotated[:, : self.head]), np.sqrt((rotated**2).sum(1))
        self.tail = np.sqrt((rotated[:, self.head :] ** 2).sum(1))
        self.floor = np.where(np.isnan(self.floor), -np.inf, self.floor)
        self.found = [np.zeros(0, dtype=np.int64) for _ in range(3)]  # query, vec_id, score

    def meet(self, row: np.ndarray, vec_id: np.ndarray, v: np.ndarray, cells: int = 2_000_000) -> None:
        """Take in candidates, the longest first."""
        rotated = v @ self.rotation
        length = np.sqrt((rotated**2).sum(1))
        order = np.argsort(-length, kind="stable")
        row, vec_id, v, rotated, length = row[order], vec_id[order], v[order], rotated[order], length[order]
        start, tail = np.ascontiguousarray(rotated[:, : self.head]), np.sqrt((rotated[:, self.head :] ** 2).sum(1))
        step = max(1, cells // max(1, len(self.row)))
        for at in range(0, len(row), step):
            to = at + step
            slack = SLACK * (1 + self.length * length[at])
            asked = np.flatnonzero(length[at] * self.length + slack >= self.floor)  # those that these and all shorter ones may serve
            if not len(asked):
                return
            bound = start[at:to] @ self.start[asked].T + tail[at:to, None] * self.tail[asked]
            c, q = np.nonzero(bound + slack[asked] >= self.floor[asked])
            q = asked[q]
            other = row[at:to][c] != self.row[q]
            c, q = c[other], q[other]
            self._take(q, vec_id[at:to][c], _products(v[at:to], self.v, c, q))

    def _take(self, query: np.ndarray, vec_id: np.ndarray, score: np.ndarray) -> None:
        query, vec_id, score = (np.concatenate(x) for x in zip(self.found, (query, vec_id, score)))
        order = np.lexsort((vec_id, -score, query))
        query, vec_id, score = query[order], vec_id[order], score[order]
        first = np.flatnonzero(np.r_[True, query[1:] != query[:-1]][: len(query)])
        rank = np.arange(len(query)) - np.repeat(first, np.diff(np.r_[first, len(query)]))
        keep = rank < self.k
        self.found = [query[keep], vec_id[keep], score[keep]]
        last = rank == self.k - 1
        self.floor[query[last]] = np.maximum(self.floor[query[last]], score[last])


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    """Vectors of whole numbers, as doubles where these hold all sums of their products exactly."""
    flat = column.combine_chunks().flatten().to_numpy()
    return flat.astype(np.float64).reshape(-1, dims)


def _products(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact inner products of rows i of ``a`` with rows j of ``b``."""
    most = max(np.abs(a).max(initial=0.0), np.abs(b).max(initial=0.0))
    if a.shape[1] * most**2 < 2.0**53:
        if len(i) * 4 > len(a) * len(b):
            return (a @ b.T)[i, j].astype(np.int64)
    else:
        a, b = a.astype(np.int64), b.astype(np.int64)
    parts = [np.einsum("nd,nd->n", a[i[k : k + 65536]], b[j[k : k + 65536]]) for k in range(0, len(i), 65536)]
    return np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, dtype=np.int64)


def top_k(vectors: DataFrame, query: Column, k: int = 5, scale: int = 256, candidate_block: int = 8192, query_bytes: int = 32 << 20) -> DataFrame:
    """The k highest integer inner products of each query row with all other rows: query_id, rank
    (from 1), vec_id, score; ties go to the smaller vec_id.

    ``query`` says which rows of ``vectors`` (vec_id, embedding) are queries. A row is left out of
    its own query only: rows that repeat a vec_id are queries and candidates each. Rows with a null
    vec_id or an unusable vector take no part; vectors of another length than most are compared
    only with their own kind, as each length is searched by itself. Fewer than k candidates give
    fewer rows; an empty table gives none.
    """
    spark = vectors.sparkSession
    quantised = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), query.alias("asked"), to_integers(F.col("embedding"), scale).alias("v"))
    usable = quantised.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    data = cut(usable.withColumn("row", F.monotonically_increasing_id()))  # written once, so that a row keeps its number
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    for (dims,) in data.select(F.size("v")).distinct().collect() if k > 0 else ():  # the lengths of vectors: one, as a rule
        out = out.unionByName(_search(data.where(F.size("v") == dims), dims, k, candidate_block, query_bytes))
    return out


def _search(data: DataFrame, dims: int, k: int, candidate_block: int, query_bytes: int) -> DataFrame:
    rotation = data.sparkSession.sparkContext.broadcast(singular_directions(data.select("v"), dims))
    squared = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    sized = data.withColumn("squared", squared)
    candidates = _ranges(sized.select("row", "vec_id", "v", "squared"), "block", math.ceil(data.count() / candidate_block), F.col("squared").desc(), "vec_id", "row")
    asked = _with_floors(sized, dims, k, candidate_block, rotation)
    queries = _ranges(asked, "part", math.ceil(asked.count() * dims * 8 / query_bytes), "reach", "row")
    pairs = _pairs(queries, candidates)

    def score(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        """The k best of a block's candidates for each query of a part."""
        found = [[] for _ in range(4)]
        if len(queries) and len(candidates):
            best = Longest(queries, dims, k, rotation.value)
            best.meet(candidates.column("row").to_numpy(), candidates.column("vec_id").to_numpy(), _matrix(candidates.column("v"), dims))
            query, vec_id, points = best.found
            found = [best.row[query], queries.column("vec_id").to_numpy()[query], vec_id, points]
        return pa.table([pa.array(x, pa.int64()) for x in found], ["query", "query_id", "vec_id", "score"])

    n_pairs = pairs.count()
    n_tasks = max(1, min(n_pairs, max(int(data.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_pairs // 64)))
    met = [_dealt(rows, pairs, own, other).repartition(n_tasks, "part", "block").groupBy("part", "block") for rows, own, other in ((queries.select("part", "row", "vec_id", "v", "floor"), "part", "block"), (candidates.select("block", "row", "vec_id", "v"), "block", "part"))]
    found = met[0].cogroup(met[1]).applyInArrow(score, "query long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("vec_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _ranges(df: DataFrame, name: str, n: int, *order: Column | str) -> DataFrame:
    """``df`` in about ``n`` ranges of ``order``, numbered in a column ``name``, and written."""
    return cut(df.repartitionByRange(max(1, n), *order).withColumn(name, F.spark_partition_id()))


def _with_floors(sized: DataFrame, dims: int, k: int, n_longest: int, rotation: Broadcast) -> DataFrame:
    """The queries with their k-th score among the ``n_longest`` longest candidates, and the length
    that a candidate must reach to come up to that."""
    longest = sized.orderBy(F.col("squared").desc(), "vec_id", "row").limit(n_longest).select("row", "vec_id", "v").toArrow()
    top = sized.sparkSession.sparkContext.broadcast(longest)

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = top.value
        for batch in batches:
            best = Longest(pa.Table.from_batches([batch]), dims, k, rotation.value)
            best.meet(rows.column("row").to_numpy(), rows.column("vec_id").to_numpy(), _matrix(rows.column("v"), dims))
            reach = np.where(best.floor > 0, best.floor, 0.0) / np.maximum(best.length, 1e-300) * (1 - 1e-6)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(best.floor), pa.array(reach)], schema=batch.schema)

    none = F.lit(float("nan"))
    asked = sized.where("asked").select("row", "vec_id", "v", none.alias("floor"), none.alias("reach"))
    return cut(asked.mapInArrow(floors, asked.schema))


def _pairs(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """Parts of queries with the blocks whose longest candidate reaches any query's floor: one row for
    thousands of rows of either side."""
    parts = queries.groupBy("part").agg(F.min("reach").alias("reach"))
    blocks = candidates.groupBy("block").agg(F.sqrt(F.max("squared")).alias("longest"))
    last = candidates.agg(F.coalesce(F.max("block"), F.lit(0))).first()[0]
    every = parts.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(last))))
    return cut(every.join(blocks, "block").where(F.col("longest") >= F.col("reach")).select("part", "block"))


def _dealt(rows: DataFrame, pairs: DataFrame, own: str, other: str, stripe: int = 256) -> DataFrame:
    """``rows`` once for each pair of their ``own`` number. A number's pairs are dealt over stripes of the
    ``other``, so that no task writes out more than ``stripe`` times what it reads."""
    last = pairs.agg(F.coalesce(F.max(other), F.lit(0))).first()[0] // stripe
    striped = pairs.withColumn("stripe", F.floor(F.col(other) / stripe).cast("int"))
    return rows.withColumn("stripe", F.explode(F.sequence(F.lit(0), F.lit(last)))).join(striped, [own, "stripe"]).drop("stripe")
