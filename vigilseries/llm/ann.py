"""Nearest vectors by inner product with cross-polytope hashing.

A table turns a vector by a fast pseudo-rotation (three rounds of random signs and a Hadamard
transform) and takes the signed axis nearest to it; with more vectors than one axis can tell apart, a
second rotation adds an axis of its own. Every vector is in one bucket of each table. A query ranks the
buckets of a table by its own coordinates along their axes and probes the first of them; what it meets
there is scored exactly, in double precision, on the original vectors.

Inner products are brought to angles by one more coordinate, which fills a vector up to the largest
norm of its band; bands are powers of two, so that a few long vectors do not blur all others. Queries
have nothing there and probe alike in all bands.

How many buckets are probed is fitted: a bounded sample of queries meets all vectors, and the fewest
probes are taken that find the wanted share of their true neighbours. Equal vectors are one entry with
their smallest identifiers, which is all that a result of k rows can hold of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilseries.functions.arrow import list_matrix
from vigilseries.functions.storage import materialise
from vigilseries.llm.text import column

K = 20
TABLES = 4
RECALL = 0.95  # wanted of the sample
SAMPLE = 200  # queries that the number of probes is fitted on
BUCKET = 256  # vectors in a bucket, as long as there are fewer than MOST_BUCKETS
MOST_BUCKETS = 1 << 16  # of a table
BLOCK = 8192  # vectors and queries that meet in a task
SLICE = 128  # queries that are scored at once

_FOUND = "query_id long, vec_id long, score double"


def hadamard(rows: np.ndarray) -> np.ndarray:
    """Orthonormal transform of every row; the width is a power of two."""
    n, width = rows.shape
    half = 1
    while half < width:
        pairs = rows.reshape(n, width // (2 * half), 2, half)
        rows = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2).reshape(n, width)
        half *= 2
    return rows / np.sqrt(width)


@dataclass(frozen=True)
class Index:
    """Rotations and buckets for so many different vectors of one length."""

    dim: int
    vectors: int
    bands: tuple[tuple[int, float], ...]  # largest norm of each
    tables: int = TABLES

    @property
    def width(self) -> int:
        return 1 << self.dim.bit_length()

    @property
    def axes(self) -> list[int]:
        """Axes that each hash of a table tells apart; each has two signs."""
        wanted = 1
        while wanted * BUCKET < self.vectors and wanted < MOST_BUCKETS:
            wanted *= 2
        if wanted <= 2 * self.width:
            return [wanted // 2]
        return [self.width, min(wanted // (2 * self.width) // 2 or 1, self.width)]

    @property
    def buckets(self) -> int:
        """Of a table. With a single one nothing is told apart."""
        return int(np.prod([max(2 * a, 1) for a in self.axes]))

    def _signed(self, rows: np.ndarray, table: int) -> list[np.ndarray]:
        """Coordinates along the signed axes of each hash of a table."""
        found = []
        for hash_, axes in enumerate(self.axes):
            turned = np.zeros((len(rows), self.width))
            turned[:, : rows.shape[1]] = rows
            draw = np.random.default_rng([table, hash_])
            for _ in range(3):
                turned = hadamard(turned * draw.choice([-1.0, 1.0], self.width))
            some = turned[:, :axes]
            found.append(np.concatenate([some, -some], axis=1) if axes else np.zeros((len(rows), 1)))
        return found

    def codes(self, vectors: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """The bucket in each table."""
        most = dict(self.bands)
        longest = np.array([most[b] for b in band(norms)])
        share = np.minimum(norms / longest, 1.0)
        rows = np.c_[vectors / longest[:, None], np.sqrt(1 - share * share)]
        out = np.zeros((len(rows), self.tables), np.int64)
        for t in range(self.tables):
            for of in self._signed(rows, t):
                out[:, t] = out[:, t] * of.shape[1] + of.argmax(axis=1)
        return out

    def order(self, queries: np.ndarray, table: int) -> np.ndarray:
        """How well each bucket of a table suits each query."""
        total = np.zeros((len(queries), 1))
        for of in self._signed(queries, table):
            total = (total[:, :, None] + of[:, None, :]).reshape(len(queries), -1)
        return total

    def probed(self, queries: np.ndarray, table: int, probes: int) -> np.ndarray:
        """The first ``probes`` buckets of each query."""
        if probes >= self.buckets:
            return np.broadcast_to(np.arange(self.buckets), (len(queries), self.buckets))
        return np.argpartition(-self.order(queries, table), probes - 1, axis=1)[:, :probes]


def band(norms: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(norms) + 0.5).astype(np.int64)


def inner(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Products of row pairs, added from the first component to the last in double precision."""
    total = np.zeros(len(left))
    for a, b in zip(left.T, right.T, strict=True):
        total += a * b
    return total


def _matrix(values: pa.Array | pa.ChunkedArray) -> np.ndarray:
    chunked = values if isinstance(values, pa.ChunkedArray) else pa.chunked_array([values])
    return list_matrix(chunked).astype(np.float64)


def best(
    ids: np.ndarray, queries: np.ndarray, known: list[np.ndarray], vectors: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per query the ``k`` nearest identifiers of ``vectors``, each of which has several (``known``):
    place of the query, identifier, score."""
    sizes = np.array([len(x) for x in known])
    starts, flat = np.cumsum(sizes) - sizes, np.concatenate(known)
    norms = np.sqrt((vectors * vectors).sum(axis=1)).max()
    out = []
    for at in range(0, len(queries), SLICE):
        some = queries[at : at + SLICE]
        rough = some @ vectors.T
        take = min(k + 1, len(vectors))  # one may hold the query's own identifier only
        edge = -np.partition(-rough, take - 1, axis=1)[:, take - 1]
        slack = 1e-9 * norms * np.sqrt((some * some).sum(axis=1))
        of, row = np.nonzero(rough >= (edge - slack)[:, None])
        score = inner(some[of], vectors[row])
        again = np.repeat(np.arange(len(row)), sizes[row])
        inside = np.arange(len(again)) - np.repeat(np.cumsum(sizes[row]) - sizes[row], sizes[row])
        name = flat[starts[row][again] + inside]
        of, score = of[again], score[again]
        other = name != ids[at + of]
        of, score, name = of[other], score[other], name[other]
        order = np.lexsort((name, -score, of))
        of, score, name = of[order], score[order], name[order]
        first = np.arange(len(of)) - np.searchsorted(of, of) < k
        out.append((at + of[first], name[first], score[first]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    element = vectors.schema[vector_column].dataType.elementType
    kind = "array<float>" if isinstance(element, T.FloatType) else "array<double>"
    rows = vectors.select(
        column(id_column).cast("long").alias("id"), column(vector_column).cast(kind).alias("vec")
    )
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    some = rows.where(
        F.col("id").isNotNull() & F.forall("vec", finite) & F.exists("vec", lambda x: x != 0)
    )
    return some.groupBy("id").agg(F.min("vec").alias("vec"))


def _entries(rows: DataFrame, k: int) -> DataFrame:
    """Different vectors with their ``k + 1`` smallest identifiers: one may be the query's own."""
    order = Window.partitionBy("vec").orderBy("id")
    some = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    return some.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def _norm():
    doubles = F.transform("vec", lambda x: x.cast("double"))
    return F.sqrt(F.aggregate(doubles, F.lit(0.0), lambda s, x: s + x * x))


def fitted(entries: DataFrame, queries: DataFrame, index: Index, k: int, recall: float) -> int:
    """The fewest probes a table with which the sample of queries finds so much of its neighbours."""
    if index.buckets == 1:
        return 1
    rows = queries.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()
    if not len(rows):
        return 1
    ids, sample = rows["id"].to_numpy(), _matrix(rows["vec"])

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The nearest of each batch, with its buckets."""
        for b in batches:
            if not b.num_rows:
                continue
            vectors = _matrix(b.column(0))
            known = [np.array([i]) for i in range(b.num_rows)]
            of, at, score = best(np.full(len(ids), -1), sample, known, vectors, k + 1)
            own = np.array([x[0] if len(x) == 1 else -1 for x in b.column(1).to_pylist()])
            single = np.array([len(x) == 1 for x in b.column(1).to_pylist()])
            other = ~(single[at] & (own[at] == ids[of]))
            of, at, score = of[other], at[other], score[other]
            codes = index.codes(vectors[at], b.column(2).to_numpy()[at])
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(0, codes.size + 1, index.tables), pa.int32()), pa.array(codes.ravel())
            )
            yield pa.RecordBatch.from_arrays([pa.array(of), pa.array(score), lists], ["of", "score", "codes"])

    met = entries.select("vec", "ids", "norm").mapInArrow(nearest, "of long, score double, codes array<long>")
    rank = F.row_number().over(Window.partitionBy("of").orderBy(F.desc("score"), "codes"))
    true = met.withColumn("rank", rank).where(F.col("rank") <= k).toArrow()
    of, codes = true["of"].to_numpy(), list_matrix(true["codes"]).astype(np.int64)
    needed = np.full(len(of), index.buckets)
    for t in range(index.tables):
        for i in range(len(ids)):
            own = np.flatnonzero(of == i)
            if len(own):
                suits = index.order(sample[i : i + 1], t)[0]
                ordered = np.sort(-suits)
                needed[own] = np.minimum(needed[own], np.searchsorted(ordered, -suits[codes[own, t]]) + 1)
    return int(np.sort(needed)[max(int(np.ceil(recall * len(needed))) - 1, 0)]) if len(needed) else 1


def _search(entries: DataFrame, queries: DataFrame, index: Index, probes: int, k: int) -> DataFrame:
    """What the queries find in their buckets; both sides of a large bucket meet in blocks."""
    spark, tables, buckets = entries.sparkSession, index.tables, index.buckets

    def probing(vectors: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """Table, first row and buckets of some queries."""
        step = max(1, min(len(vectors), (1 << 22) // buckets))
        for at in range(0, len(vectors), step):
            for t in range(tables):
                yield t, at, index.probed(vectors[at : at + step], t, probes)

    def counted(batches: Iterator[pa.RecordBatch], is_query: bool) -> Iterator[pa.RecordBatch]:
        n = np.zeros(tables * buckets, np.int64)
        for b in batches:
            vectors = _matrix(b.column(0))
            if is_query:
                for t, _, found in probing(vectors):
                    n += np.bincount(t * buckets + found.ravel(), minlength=len(n))
            else:
                codes = index.codes(vectors, b.column(1).to_numpy())
                n += np.bincount((codes + np.arange(tables) * buckets).ravel(), minlength=len(n))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], ["bucket", "n"])

    def blocks(rows: DataFrame, is_query: bool) -> np.ndarray:
        """Blocks of each bucket; at most ``tables * MOST_BUCKETS`` numbers."""
        each = rows.mapInArrow(lambda b: counted(b, is_query), "bucket long, n long")
        total = each.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
        n = np.zeros(tables * buckets, np.int64)
        n[total["bucket"].to_numpy()] = total["n"].to_numpy()
        return -(-n // BLOCK)

    shared = spark.sparkContext.broadcast(
        (blocks(entries.select("vec", "norm"), False), blocks(queries.select("vec"), True))
    )

    def sent(bucket: np.ndarray, row: np.ndarray, is_query: bool, values: list[pa.Array], spread: np.ndarray):
        """Rows go to one block of their side and to all of the other."""
        own, other = shared.value[::-1] if is_query else shared.value
        times = other[bucket]
        again = np.repeat(np.arange(len(bucket)), times)
        of_other = np.arange(len(again)) - np.repeat(np.cumsum(times) - times, times)
        bucket, row = bucket[again], row[again]
        of_own = spread[row] % np.maximum(own[bucket], 1)
        at = pa.array(row)
        pair = (of_other, of_own) if is_query else (of_own, of_other)
        return pa.RecordBatch.from_arrays(
            [pa.array(bucket), *map(pa.array, pair), *(v.take(at) for v in values)],
            ["bucket", "rows", "asked", *(("id", "vec") if is_query else ("ids", "vec"))],
        )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(at, 1000) for b in batches for at in range(0, b.num_rows, 1000)):
            codes = index.codes(_matrix(b.column(0)), b.column(2).to_numpy()) + np.arange(tables) * buckets
            row = np.repeat(np.arange(b.num_rows), tables)
            yield sent(codes.ravel(), row, False, [b.column(1), b.column(0)], b.column(3).to_numpy())

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(at, 1000) for b in batches for at in range(0, b.num_rows, 1000)):
            for t, at, found in probing(_matrix(b.column(0))):
                row = at + np.repeat(np.arange(len(found)), found.shape[1])
                yield sent(t * buckets + found.ravel(), row, True, [b.column(1), b.column(0)], b.column(2).to_numpy())

    vec = entries.schema["vec"].dataType.simpleString()
    spread = lambda *of: F.pmod(F.xxhash64(*of), F.lit(1 << 40)).alias("spread")
    rows = entries.select("vec", "ids", "norm", spread("vec")).mapInArrow(
        place, f"bucket long, rows long, asked long, ids array<long>, vec {vec}"
    )
    asked = queries.select("vec", "id", spread("id", "vec")).mapInArrow(
        ask, f"bucket long, rows long, asked long, id long, vec {vec}"
    )

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not (len(left) and len(right)):
            return pa.table({c: pa.array([], t) for c, t in (("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()))})
        ids = left["id"].to_numpy()
        known = [np.array(x) for x in right["ids"].to_pylist()]
        of, name, score = best(ids, _matrix(left["vec"]), known, _matrix(right["vec"]), k)
        return pa.table({"query_id": ids[of], "vec_id": name, "score": score})

    keys = ["bucket", "rows", "asked"]
    met = asked.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(meet, _FOUND)
    # several tables may find the same neighbour, with the same score
    once = met.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k)


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = K,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    recall: float = RECALL,
) -> DataFrame:
    """The ``k`` nearest found of each query: ``query_id, rank, vec_id, score``, nearest first, ties
    to the smaller identifier. The rows of ``queries`` have the same two columns; a query does not
    find its own identifier.

    Vectors that are null, zero, or hold a null or a number that is not finite take no part, nor do
    rows without an identifier and vectors of another length than the most frequent one (of several
    such, the shortest). Repeated rows count once; an identifier with several vectors stands for the
    smallest of them, compared component by component. Queries that find fewer than ``k`` look
    into all buckets, so none has fewer than there are. Empty tables give an empty result; other
    columns are not looked at.
    """
    spark = vectors.sparkSession
    rows = _usable(vectors, id_column, vector_column)
    entries = materialise(_entries(rows, k).withColumn("norm", _norm()), "ann-entries")
    length = entries.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if length is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = length["dim"]
    entries = entries.where(F.size("vec") == dim)
    asking = _usable(queries, id_column, vector_column).where(F.size("vec") == dim)
    asking = materialise(asking, "ann-queries")
    bands = entries.groupBy(F.floor(F.log2("norm") + 0.5).alias("band")).agg(F.max("norm").alias("most"))
    index = Index(dim, length["count"], tuple(sorted((r.band, r.most) for r in bands.collect())))
    probes = fitted(entries, asking, index, k, recall)
    found = _search(entries, asking, index, probes, k)
    if probes < index.buckets:
        found = materialise(found, "ann-found")
        full = found.where(F.col("rank") == k).select(F.col("query_id").alias("id"))
        short = materialise(asking.join(full, "id", "left_anti"), "ann-short")
        if not short.isEmpty():
            rest = _search(entries, short, index, index.buckets, k)
            found = found.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(rest)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
