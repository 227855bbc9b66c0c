"""Near duplicates: MinHash signatures joined by a multi-index on chunks, links confirmed on full sets.

A document's set of word shingles has a signature of 24 symbols of 16 bits. Two signatures that differ
in at most 15 symbols differ, by the pigeonhole principle, in at most one symbol of one of the eight
chunks of three; every chunk is therefore entered under each pair of its symbols (one error is
allowed at each place), and no pair within the distance is missed. Documents in one bucket within the
distance are joined to candidate clusters, which are small, by edges of a spanning forest only. The
texts of a cluster then meet once, in blocks, and pairs are confirmed on their whole sets; again only
a spanning forest leaves the block, since links within a class that is already connected change
nothing. Equal sets are one node throughout.

At a similarity of 0.8 the number of differing symbols is binomial with mean 4.8; more than 15 have a
probability of about one in a million.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilseries.functions.storage import materialise
from vigilseries.llm.graph import components
from vigilseries.llm.text import column, row_struct

WORDS = 5
SIMILARITY = 80  # percent
SYMBOLS = 24
CHUNK = 3
DISTANCE = 15  # at most SYMBOLS / CHUNK * 2 - 1, else a pair could be missed
BUCKET = 4096  # members that are compared by distance; of larger buckets all are candidates
BLOCK = 1024  # texts of a side that meet in a task

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_SHIFT = np.uint64(31)


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _SHIFT)) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> _SHIFT)


_FACTORS = _scramble(np.arange(1, SYMBOLS + 1, dtype=np.uint64) * _MIX[0]) | np.uint64(1)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; fewer words are one shingle, none are none.
    Splitting and lower-casing of bytes touch exactly ASCII white space and A to Z."""
    tokens = (text or "").encode("utf-8", "replace").lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    if len(tokens) < words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(tokens), seed=1)], np.uint64)
    hashed = np.fromiter(map(xxhash.xxh64_intdigest, tokens), np.uint64, len(tokens))
    count = len(tokens) - words + 1
    mixed = hashed[:count].copy()
    for k in range(1, words):
        mixed = _scramble(mixed * _MIX[0] + hashed[k : count + k])
    return np.unique(mixed)


def signature(of: np.ndarray) -> np.ndarray:
    """Low bits of the least value of each hash function."""
    least = np.full(SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(of), 50_000):
        some = of[at : at + 50_000]
        least = np.minimum(least, (some[:, None] * _FACTORS[None, :]).min(axis=0))
    return (_scramble(least) & np.uint64(0xFFFF)).astype("<u2")


def _signed(words: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, marks, signs = [], [], []
            for text in batch.column(2).to_pylist():
                own = shingles(text, words)
                sizes.append(len(own))
                marks.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
                signs.append(signature(own).tobytes() if len(own) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64())]
                + [pa.array(marks, pa.binary()), pa.array(signs, pa.binary())],
                ["id", "digest", "n", "node", "sign"],
            )

    return sign


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every chunk under each two of its three symbols."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        signs = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u2").reshape(n, SYMBOLS)
        wide = signs.astype(np.int64)
        short = pa.array([s.tobytes() for s in (signs & 0xFF).astype(np.uint8)], pa.binary())
        for chunk in range(SYMBOLS // CHUNK):
            for place in range(CHUNK):  # the symbol that may differ
                one, two = (chunk * CHUNK + k for k in range(CHUNK) if k != place)
                key = ((chunk * CHUNK + place) << 32) | (wide[:, one] << 16) | wide[:, two]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), batch.column(0), short], ["key", "node", "sign"]
                )


def _groups(batches: Iterator[pa.RecordBatch], by: int) -> Iterator[pa.Table]:
    """Rows of a sorted stream with equal first ``by`` columns."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_pylist() for i in range(by)]
        keys = list(zip(*columns, strict=True))
        start = 0
        for i, k in enumerate(keys):
            if k != key:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, start, key = [], i, k
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


class _Forest:
    """Classes of the rows of a group, and the edges that made them."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)
        self.edges: list[tuple[int, int]] = []

    def link(self, i: int, others: np.ndarray) -> None:
        for j, label in zip(others, self.label[others], strict=True):
            own = self.label[i]
            if self.label[j] == own or label == own:
                continue
            self.edges.append((i, int(j)))
            self.label[self.label == self.label[j]] = own


def _batch(edges: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    a, b = zip(*edges, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])


def _within_distance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: list[tuple[bytes, bytes]] = []
    for group in _groups(batches, 1):
        nodes = group["node"].to_pylist()
        signs = np.frombuffer(b"".join(group["sign"].to_pylist()), np.uint8).reshape(-1, SYMBOLS)
        forest = _Forest(len(nodes))
        for i in range(1, len(nodes)):
            near = (signs[:i] != signs[i]).sum(axis=1) <= DISTANCE
            forest.link(i, np.flatnonzero(near))
        found += [(nodes[i], nodes[j]) for i, j in forest.edges]
        if len(found) > 10_000:
            yield _batch(found)
            found = []
    if found:
        yield _batch(found)


def linked(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, similarity: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between rows ``left`` and rows ``right``."""
    forest = _Forest(len(sets))
    sizes = np.array([len(s) for s in sets])
    order = {int(r): k for k, r in enumerate(right)}
    values = np.concatenate([sets[r] for r in right])
    owners = np.repeat(np.arange(len(right)), sizes[right])
    by_value = np.argsort(values, kind="stable")
    values, owners = values[by_value], owners[by_value]
    for i in left:
        own = sets[i]
        begin = np.searchsorted(values, own, "left")
        length = np.searchsorted(values, own, "right") - begin
        total = int(length.sum())
        if not total:
            continue
        # the places begin..begin+length of every shingle, one after the other
        shift = np.repeat(begin - np.r_[0, np.cumsum(length)[:-1]], length)
        common = np.bincount(owners[np.arange(total) + shift], minlength=len(right))
        union = sizes[i] + sizes[right] - common
        hits = right[100 * common >= similarity * union]
        forest.link(int(i), hits[hits != i] if int(i) in order else hits)
    return forest.edges


def _confirmed(words: int, similarity: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 3):
            first = {}
            for k, node in enumerate(group["node"].to_pylist()):
                first.setdefault(node, k)  # repeated rows have one node
            nodes, rows = list(first), list(first.values())
            texts = group["text"].take(rows).to_pylist()
            side = group["block"].take(rows).to_numpy()
            sets = [shingles(t, words) for t in texts]
            low, high = group["low"][0].as_py(), group["high"][0].as_py()
            left, right = np.flatnonzero(side == low), np.flatnonzero(side == high)
            if len(left) and len(right):
                edges = linked(sets, left, right, similarity)
                if edges:
                    yield _batch([(nodes[i], nodes[j]) for i, j in edges])

    return confirm


def classes(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    words: int = WORDS,
    similarity: int = SIMILARITY,
) -> DataFrame:
    """Every row as ``id, digest, n, node, root, component_id``: the number of its shingles, the name
    of its set, that of its class, and the smallest identifier of the class.

    Rows without words, nulls included, have neither set nor class and are linked with nothing; their
    component is their own identifier. Repeated rows and equal sets are one node. A class without any
    identifier has a null one. An empty table gives an empty result; other columns are not looked at.
    """
    if DISTANCE > SYMBOLS // CHUNK * 2 - 1:
        raise ValueError("the chunks do not cover this distance")
    text = column(text_column)
    digest = F.xxhash64(text)
    id_type = docs.schema[id_column].dataType.simpleString()
    signed = materialise(
        docs.select(column(id_column).alias("id"), digest.alias("digest"), text.alias("text")).mapInArrow(
            _signed(words), f"id {id_type}, digest long, n long, node binary, sign binary"
        ),
        "near-signatures",
    )
    # One row per set; the text of its first row is fetched if it is needed.
    sets = materialise(
        signed.where("node is not null")
        .groupBy("node")
        .agg(
            F.min("id").alias("least"),
            F.first("sign").alias("sign"),
            F.min(F.struct("id", "digest")).alias("from"),
        ),
        "near-sets",
    )
    keys = sets.select("node", "sign").mapInArrow(_keys, "key long, node binary, sign binary")
    full = keys.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("node").alias("head"))
    shared = materialise(keys.join(full.where("members > 1"), "key"), "near-buckets")
    close = (
        shared.where(F.col("members") <= BUCKET)
        .select("key", "node", "sign")
        .repartition("key")
        .sortWithinPartitions("key")
        .mapInArrow(_within_distance, "a binary, b binary")
    )
    crowded = shared.where(F.col("members") > BUCKET).select(F.col("node").alias("a"), F.col("head").alias("b"))
    clusters = components(close.union(crowded))

    sizes = clusters.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    blocks = F.ceil(F.col("size") / BLOCK).cast("long")
    wanted = clusters.join(sizes, "root").join(sets.select("node", "from"), "node").select(
        "node", "root", blocks.alias("blocks"),
        F.pmod(F.xxhash64("node"), blocks).alias("block"),
        F.col("from.id").alias("of"), F.col("from.digest").alias("key"),
    )
    wanted = materialise(wanted, "near-wanted")
    texts = docs.select(column(id_column).alias("id"), digest.alias("digest"), text.alias("text"))
    fetched = texts.join(
        wanted, (F.col("digest") == F.col("key")) & F.col("id").eqNullSafe(F.col("of"))
    ).select(
        "root", "block", "node", "text",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"),
    )
    paired = fetched.select(
        "root", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
        "block", "node", "text",
    )
    links = (
        paired.repartition("root", "low", "high")
        .sortWithinPartitions("root", "low", "high")
        .mapInArrow(_confirmed(words, similarity), "a binary, b binary")
    )
    joined = components(links)
    rooted = sets.select("node", "least").join(joined, "node", "left").select(
        "node", "least", F.coalesce("root", "node").alias("root")
    )
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component"))
    named = materialise(rooted.join(smallest, "root").select("node", "root", "component"), "near-classes")
    return signed.join(named, "node", "left").select(
        "id", "digest", "n", "node", "root",
        F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component")).alias("component_id"),
    )


def deduplicated(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    words: int = WORDS,
    similarity: int = SIMILARITY,
) -> DataFrame:
    """One document of each class, that with the smallest identifier, with all its columns; of
    several rows with that identifier one is kept. Rows without words all stay."""
    every = materialise(classes(docs, id_column, text_column, words, similarity), "near-all")
    heads = every.where(F.col("root").isNotNull() & F.col("id").eqNullSafe(F.col("component_id")))
    kept = heads.groupBy("root").agg(
        F.min(F.struct("digest")).alias("one"), F.first("id").alias("keep_id")
    ).select(F.col("one.digest").alias("key"), "keep_id", F.lit(True).alias("single"))
    bare = every.where("root is null").select(
        F.col("digest").alias("key"), F.col("id").alias("keep_id"), F.lit(False).alias("single")
    ).distinct()
    kept = materialise(kept.union(bare), "near-kept")
    doubled = every.where("root is not null").groupBy("id", "digest").count().where("count > 1")
    carried = docs.select(
        F.xxhash64(column(text_column)).alias("digest"), column(id_column).alias("id"),
        row_struct(docs).alias("row"),
    )
    rows = carried.join(
        kept, F.col("digest").eqNullSafe(F.col("key")) & F.col("id").eqNullSafe(F.col("keep_id"))
    )
    if not doubled.isEmpty():  # repeated rows: one of each stays
        plain = rows.where(~F.col("single"))
        rows = rows.where("single").dropDuplicates(["id", "digest"]).union(plain)
    return rows.select(*[F.col("row")[c].alias(c) for c in docs.columns])
