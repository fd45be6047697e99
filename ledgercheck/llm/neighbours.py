"""Nearest vectors by inner product: an inverted multi-index.

Both halves of the vectors are quantised separately by k-means, so K centroids per half make K * K
cells; a vector lies in the cell of its two nearest centroids.  A query walks the pairs of
centroids by the sum of its two distances (minus the inner product with each centroid) with a
heap, until the cells it has passed hold `reach` vectors; all vectors of these cells are reranked
by their exact inner product.

Centroids are fitted on at most SAMPLE vectors, the first by a hash of their components; every
vector is indexed.  `reach` is calibrated: for CALIBRATION queries the true neighbours among all
vectors are found by brute force, and the least share of the vectors is taken at which the walk
meets RECALL of them.  It is a share, so recall does not fall as tables grow; neither cells nor
candidates are capped.  It is never less than `top` vectors and the query's own, so small tables
are passed whole.  The walks are made where the queries lie, from the broadcast centroids and cell
sizes; queries go against the index in blocks of QUERY_BLOCK, broadcast with the cells they visit.

Defined results: rows with a null vec_id, null, empty and zero vectors and vectors with a null or non-finite component take
no part; nor do vectors of another length than the most frequent one (of equally frequent ones the
longer).  A query's own id is no candidate.  Ties go to the smaller id.  Repeated rows are
candidates each by itself.  Other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ledgercheck.llm.common import fields, sample_by_hash, settled, to_batch

K = 24
SAMPLE = 20000
ITERATIONS = 12
CALIBRATION = 128
RECALL = 0.95
QUERY_BLOCK = 1 << 14
SUB_ROWS = 512   # vectors of one cell that go to a task together


def usable(frame: DataFrame) -> DataFrame:
    """(vec_id, v) of the vectors that take part, in double precision."""
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = frame.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n"))
    most = sizes.first()
    return rows.where(F.size("v") == (most["n"] if most else -1))


def k_means(x: np.ndarray, k: int) -> np.ndarray:
    """Centroids, started from rows at even distances; empty ones keep their place."""
    centre = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(ITERATIONS):
        own = nearest(x, centre)
        count = np.bincount(own, minlength=k)
        for d in range(x.shape[1]):
            total = np.bincount(own, x[:, d], k)
            centre[:, d] = np.where(count > 0, total / np.maximum(count, 1), centre[:, d])
    return centre


def nearest(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return ((centre ** 2).sum(1) - 2 * x @ centre.T).argmin(1)


def halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut = x.shape[1] // 2
    return x[:, :cut], x[:, cut:]


def walk(first: np.ndarray, second: np.ndarray, sizes: np.ndarray, reach: float):
    """Cells by ascending summed distance, until they hold `reach` vectors; yields cells.

    `first`, `second`: the distances to the centroids of each half."""
    a, b, k = np.argsort(first, kind="stable"), np.argsort(second, kind="stable"), len(first)
    heap, seen, held = [(first[a[0]] + second[b[0]], 0, 0)], {(0, 0)}, 0
    while heap and held < reach:
        _, i, j = heapq.heappop(heap)
        cell = int(a[i]) * k + int(b[j])
        held += sizes[cell]
        yield cell
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < k and y < k and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (first[a[x]] + second[b[y]], x, y))


def matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten(), dtype=np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products, summed in the same order for every pair, so equal vectors tie."""
    return np.einsum("id,jd->ij", x, q)


class Index:
    """Centroids and cell sizes (on the driver), and the table of cells."""

    def __init__(self, vectors: DataFrame, k: int = K, sample: int = SAMPLE) -> None:
        spark = vectors.sparkSession
        rows = usable(vectors)
        found = sorted(sample_by_hash(rows.select("v"), "v", sample).collect())
        self.empty = not found
        if self.empty:
            return
        x = np.array([r[0] for r in found])
        k = max(1, min(k, len(x)))
        self.first, self.second = (k_means(h, k) for h in halves(x))
        shared = spark.sparkContext.broadcast((self.first, self.second))
        schema = fields("vec_id long, cell int, v array<double>")
        types = to_arrow_schema(schema)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            one, two = shared.value
            for batch in batches:
                if batch.num_rows:
                    a, b = halves(matrix(batch.column("v")))
                    yield to_batch({"vec_id": batch.column("vec_id"), "v": batch.column("v"),
                                    "cell": nearest(a, one) * len(one) + nearest(b, two)}, types)

        placed = settled(rows.select(F.col("vec_id").cast("long").alias("vec_id"), "v")
                         .mapInArrow(assign, schema), "cells")
        self.sizes = np.zeros(k * k, np.int64)  # k * k rows at any size
        for cell, n in placed.groupBy("cell").count().collect():
            self.sizes[cell] = n
        # a cell that holds a third of all vectors goes to many tasks
        sub = F.pmod(F.xxhash64("vec_id"), F.expr(f"greatest(1L, n div {SUB_ROWS})"))
        counts = placed.groupBy("cell").agg(F.count("*").alias("n"))
        self.table = settled(
            placed.join(F.broadcast(counts), "cell").withColumn("part", sub)
            .repartition("cell", "part").sortWithinPartitions("cell").select("vec_id", "cell", "v"),
            "index")

    def walked(self, queries: DataFrame, reach: float) -> DataFrame:
        """Queries (vec_id, v) with the cells they visit, one bit each."""
        shared = queries.sparkSession.sparkContext.broadcast((self.first, self.second, self.sizes))
        schema = fields("vec_id long, v array<double>, cells binary")
        types = to_arrow_schema(schema)

        def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            one, two, sizes = shared.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                a, b = halves(matrix(batch.column("v")))
                out = np.zeros((batch.num_rows, len(sizes)), bool)
                for i, (x, y) in enumerate(zip(-a @ one.T, -b @ two.T)):
                    out[i, list(walk(x, y, sizes, reach))] = True
                yield to_batch({"vec_id": batch.column("vec_id"), "v": batch.column("v"),
                                "cells": [row.tobytes() for row in np.packbits(out, axis=1)]}, types)

        return queries.select("vec_id", "v").mapInArrow(visit, schema)

    def rerank(self, ids: np.ndarray, q: np.ndarray, visits: np.ndarray, top: int) -> DataFrame:
        """(query_id, vec_id, score, cell): the `top` best of every task for each query; `visits`
        has the visited cells of each, packed in bytes."""
        spark = self.table.sparkSession
        shared = spark.sparkContext.broadcast((ids, q, visits))
        schema = fields("query_id long, vec_id long, score double, cell int")
        types = to_arrow_schema(schema)

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q, packed = shared.value
            held, n = [], 0
            for batch in batches:
                x = matrix(batch.column("v"))
                vec, cell = (np.asarray(batch.column(c)) for c in ("vec_id", "cell"))
                for c in np.unique(cell).tolist():
                    mine = np.flatnonzero((packed[:, c >> 3] >> (7 - (c & 7))) & 1)
                    rows = np.flatnonzero(cell == c)
                    if not len(mine):
                        continue
                    rows = rows[np.argsort(vec[rows], kind="stable")]
                    for lo in range(0, len(rows), 512):
                        some = rows[lo:lo + 512]
                        s = products(x[some], q[mine])
                        s[vec[some][:, None] == ids[mine][None, :]] = -np.inf
                        best = np.argsort(-s, axis=0, kind="stable")[:top]
                        value = np.take_along_axis(s, best, 0)
                        held.append((np.broadcast_to(mine, best.shape)[value > -np.inf],
                                     vec[some][best][value > -np.inf], value[value > -np.inf],
                                     np.full(int((value > -np.inf).sum()), c)))
                        n += len(held[-1][0])
                    if n > 1_000_000:
                        held, n = [keep(held, top)], 0
            if held:
                at, vec, value, cell = keep(held, top)
                if len(at):
                    yield to_batch({"query_id": ids[at], "vec_id": vec, "score": value,
                                    "cell": cell}, types)

        return self.table.mapInArrow(score, schema)

    def calibrate(self, recall: float, top: int, queries: int = CALIBRATION) -> float:
        """The least number of vectors the walk has to pass to meet `recall` of the neighbours."""
        some = sorted(sample_by_hash(self.table, "v", queries).collect())
        ids = np.array([r["vec_id"] for r in some], np.int64)
        q = np.array([r["v"] for r in some])
        every = np.packbits(np.ones((len(q), len(self.sizes)), bool), axis=1)
        true: dict[int, list[int]] = {}
        for r in best_of(self.rerank(ids, q, every, top), top).collect():
            true.setdefault(r["query_id"], []).append(r["cell"])
        a, b = halves(q)
        passed = []
        for i, x, y in zip(ids.tolist(), -a @ self.first.T, -b @ self.second.T):
            order = list(walk(x, y, self.sizes, float("inf")))
            before = np.empty(len(self.sizes))
            before[order] = np.cumsum(self.sizes[order])
            passed += before[true.get(i, [])].tolist()
        if not passed:
            return float(self.sizes.sum())
        # rows that share the query's id are no candidates: they count on top of `top`
        own = self.table.groupBy("vec_id").count().agg(F.max("count")).first()[0]
        least = np.sort(passed)[min(len(passed) - 1, int(np.ceil(recall * len(passed))))]
        return float(max(least, top + own))


def keep(held: list, top: int):
    """The best `top` per query, by score and then smaller id."""
    at, vec, value, cell = (np.concatenate([h[i] for h in held]) for i in range(4))
    order = np.lexsort((vec, -value, at))
    at, vec, value, cell = at[order], vec[order], value[order], cell[order]
    first = np.searchsorted(at, at)
    mine = np.arange(len(at)) - first < top
    return at[mine], vec[mine], value[mine], cell[mine]


def best_of(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def search(vectors: DataFrame, is_query: Column, top: int = 20, recall: float = RECALL,
           k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the `top` nearest found of every query."""
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    index = Index(vectors, k)
    if index.empty:
        return spark.createDataFrame([], schema)
    reach = index.calibrate(recall, top)
    queries = settled(index.walked(index.table.where(is_query), reach), "queries")
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    out = None
    for block in range(blocks):
        # about QUERY_BLOCK queries, whatever their number
        rows = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).collect()
        if not rows:
            continue
        ids = np.array([r["vec_id"] for r in rows], np.int64)
        q = np.array([r["v"] for r in rows])
        visits = np.stack([np.frombuffer(r["cells"], np.uint8) for r in rows])
        found = settled(best_of(index.rerank(ids, q, visits, top), top), "found")
        out = found if out is None else out.union(found)
    if out is None:
        return spark.createDataFrame([], schema)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
