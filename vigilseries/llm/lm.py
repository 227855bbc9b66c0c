"""Language-model scores: a Katz backoff model of word pairs.

Texts are read once into batches of whole documents: the batch's distinct words, and its tokens as
places in that list. All counting is question and answer. A batch asks for its distinct words, dealt
over partitions by hash, and gets their counts and numbers; then it asks for its distinct pairs, dealt
by the first word's number (the pairs of a frequent first word over several partitions), and gets
their counts. A word that is in a third of all texts is thus one entry per batch. Pairs are kept as a
table of partitions, from which each history's backoff weight is summed up. With the answers at hand
a batch scores its documents by itself.

Discounts are Good and Turing's up to a count of five; where the counts of counts do not give a factor
between zero and one, the absolute discount ``n1 / (n1 + 2 n2)`` takes its place. What the discounts
leave of words goes to one unknown word. A history whose pairs are all too frequent to be discounted
leaves one part in ``c + 1``. The weights are such that every history's probabilities sum to one.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilseries.functions.storage import materialise, stage_path
from vigilseries.llm.text import column

FOLDS = 10  # documents whose checksum leaves 0 are held out
TOKENS = 1_000_000  # of a batch
MOST = 5  # counts above are not discounted
END = xxhash.xxh64_intdigest(b"")  # no word is empty,
START = xxhash.xxh64_intdigest(b"\n")  # and none has white space
_COUNTS = [f"n{r}" for r in range(1, MOST + 2)]
_STATS = ", ".join(f"{c} long" for c in (*_COUNTS, "kinds", "total"))
_ANSWER = f"kind string, batch long, part int, payload binary, {_STATS}"


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of whole or real numbers, small ones in few bytes, byte planes together."""
    parts = []
    for a in arrays:
        if a.dtype.kind in "iu":
            most = int(a.max()) if len(a) else 0
            a = a.astype(next(t for t in ("u1", "u2", "u4", "u8") if most <= np.iinfo(t).max))
        parts.append(struct.pack("<2sq", a.dtype.str[1:].encode(), len(a)))
        parts.append(np.ascontiguousarray(a).view("u1").reshape(len(a), a.itemsize).T.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(payload: bytes) -> list[np.ndarray]:
    data, at, arrays = zstandard.ZstdDecompressor().decompress(payload), 0, []
    while at < len(data):
        kind, n = struct.unpack_from("<2sq", data, at)
        at += 10
        size = int(kind[1:])
        planes = np.frombuffer(data, "u1", n * size, at).reshape(size, n)
        a = np.ascontiguousarray(planes.T).view(f"<{kind.decode()}").ravel()
        arrays.append(a.astype(np.int64) if kind[:1] == b"u" and size < 8 else a)
        at += n * size
    return arrays


def _gaps(ordered: np.ndarray) -> np.ndarray:
    return np.diff(ordered, prepend=ordered.dtype.type(0))


@dataclass(frozen=True)
class Discounts:
    """``factor[r]`` of a count ``r``; counts above ``MOST`` have factor one."""

    factor: tuple[float, ...]

    @staticmethod
    def of(n: list[int]) -> Discounts:
        """From the numbers of things seen once, twice, ... ``MOST + 1`` times."""
        absolute = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5
        cut = (MOST + 1) * n[MOST] / n[0] if n[0] else 1.0
        factor = [0.0]
        for r in range(1, MOST + 1):
            turing = (r + 1) * n[r] / (r * n[r - 1]) if n[r - 1] else 0.0
            d = (turing - cut) / (1 - cut) if cut < 1 else 0.0
            factor.append(d if 0 < d < 1 else (r - absolute) / r)
        return Discounts(tuple(factor))

    def __call__(self, counts: np.ndarray) -> np.ndarray:
        """Discounted counts."""
        table = np.array([*self.factor, 1.0])
        return table[np.minimum(counts, MOST + 1)] * counts


@dataclass(frozen=True)
class Words:
    """Probabilities of single words by their count."""

    discounts: Discounts
    total: int
    kinds: int
    unknown: float
    scale: float

    @staticmethod
    def of(n: list[int], kinds: int, total: int) -> Words:
        d = Discounts.of(n)
        left = sum((1 - d.factor[r]) * r * n[r - 1] for r in range(1, MOST + 1))
        if total == 0:
            return Words(d, 0, 0, 1.0, 1.0)
        if left <= 0:  # nothing was discounted
            return Words(d, total, kinds, 1 / (total + 1), total / (total + 1))
        return Words(d, total, kinds, left / total, 1.0)

    def __call__(self, counts: np.ndarray) -> np.ndarray:
        seen = self.scale * self.discounts(counts) / max(self.total, 1)
        return np.where(counts > 0, seen, self.unknown)


def _read(parts: int, id_type: pa.DataType | None = None):
    """Batches of whole documents from a stream of ``id, held, text``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, held, hashes, size, kind = TaskContext.get().partitionId() << 32, [], [], [], 0, None

        def batch() -> pa.RecordBatch:
            lengths = np.array([len(h) + 1 for h in hashes])
            ends = np.array([END], np.uint64)
            tokens = np.concatenate([x for h in hashes for x in (h, ends)])
            train = ~np.array(held)
            extra = np.array([START, END], np.uint64)
            words, place = np.unique(np.r_[tokens, extra], return_inverse=True)
            place = place[:-2]
            counts = np.bincount(place[np.repeat(train, lengths)], minlength=len(words))
            counts[np.searchsorted(words, np.uint64(START))] = train.sum()
            part = (words % np.uint64(parts)).astype(np.int64)
            order = np.lexsort((words, part))
            rank = np.empty(len(words), np.int64)
            rank[order] = np.arange(len(words))
            borders = np.searchsorted(part[order], np.arange(parts + 1))
            asked = [
                pack(_gaps(words[order[a:b]]), counts[order[a:b]])
                for a, b in zip(borders, borders[1:], strict=False)
            ]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([number], pa.int64()), pa.array([ids], pa.list_(kind)), pa.array([held], pa.list_(pa.bool_())),
                    pa.array([pack(lengths, rank[place])], pa.binary()), pa.array([asked], pa.list_(pa.binary())),
                ],
                ["batch", "ids", "held", "tokens", "words"],
            )

        for rows in (b.slice(at, 500) for b in batches for at in range(0, b.num_rows, 500)):
            kind = rows.column(0).type
            for key, out, text in zip(*(rows.column(i).to_pylist() for i in range(3)), strict=True):
                split = (text or "").encode("utf-8", "replace").lower().split()
                ids.append(key)
                held.append(out)
                hashes.append(np.fromiter(map(xxhash.xxh64_intdigest, split), np.uint64, len(split)))
                size += len(split) + 1
                if size >= TOKENS:
                    yield batch()
                    number, ids, held, hashes, size = number + 1, [], [], [], 0
        if ids:
            yield batch()

    return read


def _answers(rows: list[tuple], stats: tuple | None) -> pa.Table:
    kinds, batches, parts, payloads = zip(*rows, strict=True) if rows else ((), (), (), ())
    n = len(rows)
    numbers = {c: [None] * n for c in (*_COUNTS, "kinds", "total")}
    if stats:
        kinds, batches, parts, payloads = (*kinds, "stats"), (*batches, None), (*parts, None), (*payloads, None)
        for name, value in zip(numbers, stats, strict=True):
            numbers[name].append(int(value))
    return pa.table(
        {
            "kind": pa.array(kinds, pa.string()), "batch": pa.array(batches, pa.int64()),
            "part": pa.array(parts, pa.int32()), "payload": pa.array(payloads, pa.binary()),
            **{c: pa.array(v, pa.int64()) for c, v in numbers.items()},
        }
    )


def _spectrum(counts: np.ndarray) -> tuple:
    seen = np.bincount(np.minimum(counts, MOST + 2), minlength=MOST + 3)
    return (*seen[1 : MOST + 2], (counts > 0).sum(), counts.sum())


def _merged(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    borders = np.cumsum([0, *map(len, keys)])
    unique, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    return unique, inverse, borders


def _count_words(parts: int):
    """Answers ``count, number`` to each batch; frequent words have small numbers."""

    def count(asked: pa.Table) -> pa.Table:
        part = asked["part"][0].as_py()
        got = [unpack(p) for p in asked["payload"].to_pylist()]
        keys = [np.cumsum(g[0].astype(np.uint64), dtype=np.uint64) for g in got]
        unique, inverse, borders = _merged(keys)
        counts = np.zeros(len(unique), np.int64)
        np.add.at(counts, inverse, np.concatenate([g[1] for g in got]).astype(np.int64))
        rank = np.empty(len(unique), np.int64)
        rank[np.lexsort((unique, -counts))] = np.arange(len(unique))
        number = rank * parts + part
        rows = []
        for batch, a, b in zip(asked["batch"].to_pylist(), borders, borders[1:], strict=False):
            own = inverse[a:b]
            rows.append(("words", batch, part, pack(counts[own], number[own])))
        tokens = counts[unique != np.uint64(START)]  # the start is no token
        return _answers(rows, _spectrum(tokens))

    return count


class _Batch:
    """What a batch knows: its tokens, and the answers to its questions so far."""

    def __init__(self, own: pa.Table, answers: pa.Table, total: int, parts: int) -> None:
        self.parts = parts
        self.lengths, self.tokens = unpack(own["tokens"][0].as_py())
        self.held = np.array(own["held"][0].as_py(), bool)
        self.ids = own["ids"].combine_chunks()
        rows = zip(
            answers["kind"].to_pylist(), answers["part"].to_pylist(), answers["payload"].to_pylist(),
            strict=True,
        )
        self.answers = {(kind, part): payload for kind, part, payload in rows}
        words = [unpack(self.answers["words", p]) for p in range(parts)]
        self.count, self.number = (np.concatenate([w[i] for w in words]).astype(np.int64) for i in (0, 1))
        keys = [np.cumsum(unpack(p)[0].astype(np.uint64), dtype=np.uint64) for p in own["words"][0].as_py()]
        start = int(np.flatnonzero(np.concatenate(keys) == np.uint64(START))[0])
        firsts = np.cumsum(self.lengths) - self.lengths
        self.before = np.r_[np.int64(0), self.tokens[:-1]]
        self.before[firsts] = start
        self.firsts = firsts
        # Distinct pairs of known words, in the order of the questions.
        pair = self.before * len(self.count) + self.tokens
        known = (self.count[self.before] > 0) & (self.count[self.tokens] > 0)
        unique, inverse = np.unique(pair[known], return_inverse=True)
        one, two = unique // len(self.count), unique % len(self.count)
        train = np.repeat(~self.held, self.lengths)[known]
        times = np.bincount(inverse[train], minlength=len(unique))
        # A history with more than its share of a partition is dealt over several by the second word.
        shares = np.minimum(parts, 1 + self.count[one] * 4 * parts // max(total, 1))
        part = (self.number[one] + self.number[two] * 0x9E3779B1 % 0x7FFFFFFF % shares) % parts
        order = np.lexsort((self.number[two], self.number[one], part))
        place = np.empty(len(unique), np.int64)
        place[order] = np.arange(len(unique))
        self.pair_of = np.full(len(pair), -1)
        self.pair_of[known] = place[inverse]
        self.one, self.two, self.times = one[order], two[order], times[order]
        self.borders = np.searchsorted(part[order], np.arange(parts + 1))


def _ask_pairs(total: int, parts: int):
    def ask(own: pa.Table, answers: pa.Table) -> pa.Table:
        batch = _Batch(own, answers, total, parts)
        number, count = batch.number, batch.count
        rows = []
        for part, (a, b) in enumerate(zip(batch.borders, batch.borders[1:], strict=False)):
            if b > a:
                one, two = batch.one[a:b], batch.two[a:b]
                rows.append((part, pack(_gaps(number[one]), number[two], count[two], batch.times[a:b])))
        name = own["batch"][0].as_py()
        return pa.table(
            {
                "part": pa.array([r[0] for r in rows], pa.int32()),
                "batch": pa.array([name] * len(rows), pa.int64()),
                "payload": pa.array([r[1] for r in rows], pa.binary()),
            }
        )

    return ask


def _count_pairs(asked: pa.Table) -> pa.Table:
    """Answers ``count`` to each batch, and the partition's pairs ``one, two, count, count of two``."""
    part = asked["part"][0].as_py()
    got = [unpack(p) for p in asked["payload"].to_pylist()]
    ones = [np.cumsum(g[0]) for g in got]
    if max(int(max(o.max(), g[1].max())) for o, g in zip(ones, got, strict=True)) >> 32:
        raise OverflowError("more than four billion different words")
    keys = [o.astype(np.uint64) << np.uint64(32) | g[1].astype(np.uint64) for o, g in zip(ones, got, strict=True)]
    unique, inverse, borders = _merged(keys)
    counts = np.zeros(len(unique), np.int64)
    np.add.at(counts, inverse, np.concatenate([g[3] for g in got]))
    of_two = np.zeros(len(unique), np.int64)
    of_two[inverse] = np.concatenate([g[2] for g in got])
    rows = [
        ("pairs", batch, part, pack(counts[inverse[a:b]]))
        for batch, a, b in zip(asked["batch"].to_pylist(), borders, borders[1:], strict=False)
    ]
    seen = counts > 0
    one, two = (unique[seen] >> np.uint64(32)).astype(np.int64), (unique[seen] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    rows.append(("model", None, part, pack(_gaps(one), two, counts[seen], of_two[seen])))
    return _answers(rows, _spectrum(counts[seen]))


def _histories(words: Words, pairs: Discounts, parts: int):
    """Sums per history of the pairs of a partition, dealt back by the history's number."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for payload in rows.column(0).to_pylist():
                gaps, _, counts, of_two = unpack(payload)
                if not len(gaps):
                    continue
                one = np.cumsum(gaps)
                begin = np.flatnonzero(np.r_[True, one[1:] != one[:-1]])
                seen, mass, lower = (
                    np.add.reduceat(x, begin) for x in (counts, pairs(counts), words(of_two))
                )
                part = one[begin] % parts
                for p in np.unique(part):
                    own = part == p
                    packed = pack(_gaps(one[begin][own]), seen[own], mass[own], lower[own])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([int(p)], pa.int32()), pa.array([packed], pa.binary())], ["part", "payload"]
                    )

    return sums


def weights(seen: np.ndarray, mass: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What a discounted count is multiplied with, and the backoff weight, so that all sums to one."""
    left = 1 - mass / seen
    none = left <= 1e-12
    left = np.where(none, 1 / (seen + 1), left)
    return np.where(none, seen / (seen + 1), 1.0) / seen, left / (1 - lower)


def _tell_histories(parts: int):
    def tell(words: pa.Table, sums: pa.Table) -> pa.Table:
        got = [unpack(p) for p in sums["payload"].to_pylist()]
        rows = []
        if got:
            one, inverse, _ = _merged([np.cumsum(g[0]) for g in got])
            total = [np.zeros(len(one)) for _ in range(3)]
            for k in range(3):
                np.add.at(total[k], inverse, np.concatenate([g[k + 1] for g in got]).astype(float))
            per_count, backoff = weights(*total)
        else:
            one = np.zeros(0, np.int64)
        for batch, part, payload in zip(*(words[c].to_pylist() for c in ("batch", "part", "payload")), strict=True):
            number = unpack(payload)[1]
            factor, alpha = np.zeros(len(number)), np.ones(len(number))
            if len(one):
                at = np.minimum(np.searchsorted(one, number), len(one) - 1)
                hit = one[at] == number
                factor[hit], alpha[hit] = per_count[at[hit]], backoff[at[hit]]
            rows.append(("histories", batch, part, pack(factor, alpha)))
        return _answers(rows, None)

    return tell


def _score(words: Words, pairs: Discounts, parts: int):
    def score(own: pa.Table, answers: pa.Table) -> pa.Table:
        batch = _Batch(own, answers, words.total, parts)
        known = [unpack(batch.answers["histories", p]) for p in range(parts)]
        factor, alpha = (np.concatenate([k[i] for k in known]) for i in (0, 1))
        times = np.zeros(len(batch.one) + 1, np.int64)  # the last for pairs with an unknown word
        for p, (a, b) in enumerate(zip(batch.borders, batch.borders[1:], strict=False)):
            if b > a:
                times[a:b] = unpack(batch.answers["pairs", p])[0]
        seen = times[batch.pair_of]
        count = batch.count[batch.tokens]
        lower = words(batch.count)[batch.tokens]
        before = batch.before
        chance = np.where(seen > 0, pairs(seen) * factor[before], alpha[before] * lower)
        base = np.log10((count + 0.1) / (words.total + 0.1 * (words.kinds + 1)))
        n = len(batch.lengths)

        def summed(x: np.ndarray) -> np.ndarray:
            return np.add.reduceat(x, batch.firsts)

        return pa.table(
            {
                "id": batch.ids.flatten() if not isinstance(batch.ids, pa.ChunkedArray) else pa.concat_arrays(batch.ids.chunks).flatten(),
                "held_out": pa.array(batch.held), "n_tokens": pa.array(batch.lengths.astype(np.int64)),
                "n_known": pa.array(summed((count > 0).astype(np.int64))),
                "train_tokens": pa.array(np.full(n, words.total, np.int64)),
                "base_score": pa.array(summed(base)), "score": pa.array(summed(np.log10(chance))),
            }
        )

    return score


def _stats(answers: DataFrame) -> tuple[list[int], int, int]:
    """One row of sums: counts of counts, kinds, total."""
    row = answers.where("kind = 'stats'").agg(
        *[F.coalesce(F.sum(c), F.lit(0)) for c in (*_COUNTS, "kinds", "total")]
    ).first()
    return list(row[: MOST + 1]), row[MOST + 1], row[MOST + 2]


def scored(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Every row with ``held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Documents learn and are scored as whole texts, a null text as an empty one, which is an end after
    a start. A document is held out if the checksum of its identifier leaves 0; without an identifier
    it is held out. Repeated rows count as often as they come. If nothing is left to learn from, all
    words are the unknown one, of probability one. An empty table gives an empty result; other
    columns are not looked at.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    id_type = docs.schema[id_column].dataType.simpleString()
    held = F.coalesce(F.crc32(column(id_column).cast("string").cast("binary")) % FOLDS == 0, F.lit(True))
    read = docs.select(column(id_column).alias("id"), held.alias("held"), column(text_column).alias("text")).mapInArrow(
        _read(parts),
        f"batch long, ids array<{id_type}>, held array<boolean>, tokens binary, words array<binary>",
    )
    # Bucketed by batch: the answers come to the batches, which never move again.
    name = f"lm_batches_{uuid.uuid4().hex}"
    read.write.format("parquet").option("compression", "none").option("path", stage_path(spark, "lm-batches")).bucketBy(
        parts, "batch"
    ).saveAsTable(name)
    batches = spark.table(name)

    asked = batches.select("batch", F.posexplode("words").alias("part", "payload"))
    answers = materialise(asked.groupBy("part").applyInArrow(_count_words(parts), _ANSWER), "lm-words")
    words = Words.of(*_stats(answers))
    word_answers = answers.where("kind = 'words'").select("kind", "batch", "part", "payload")

    pairs_asked = batches.groupBy("batch").cogroup(word_answers.groupBy("batch")).applyInArrow(
        _ask_pairs(words.total, parts), "part int, batch long, payload binary"
    )
    path = stage_path(spark, "lm-pairs")
    counted = pairs_asked.groupBy("part").applyInArrow(_count_pairs, _ANSWER)
    counted.write.partitionBy("kind").parquet(path)
    model = spark.read.schema(_ANSWER).parquet(path)
    pairs = Discounts.of(_stats(model)[0])

    sums = model.where("kind = 'model'").select("payload").mapInArrow(
        _histories(words, pairs, parts), "part int, payload binary"
    )
    histories = word_answers.groupBy("part").cogroup(sums.groupBy("part")).applyInArrow(
        _tell_histories(parts), _ANSWER
    )
    columns = ["kind", "batch", "part", "payload"]
    told = materialise(histories.select(*columns), "lm-histories")
    all_answers = word_answers.union(model.where("kind = 'pairs'").select(*columns)).union(told)
    return batches.groupBy("batch").cogroup(all_answers.groupBy("batch")).applyInArrow(
        _score(words, pairs, parts),
        f"id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, "
        "base_score double, score double",
    )
