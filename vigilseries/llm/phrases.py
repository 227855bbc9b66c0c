"""Collocations by stripes: every prefix keys an associative counter of the words that follow it.

A task combines the stripes of some two million words before anything moves; stripes of a prefix then
meet in one sorted stream and are added up element by element. A stripe is cut by a hash of the next
word, so that the counter of a frequent prefix spreads over tasks. One structure gives everything:
an entry is the number of a longer phrase, the sum of a stripe (with the mark for the end of a piece)
is that of its prefix, and the largest entries over a stripe and over stripes whose prefixes end alike
tell which phrases are only parts of longer ones.

Texts are read twice. The first reading counts words and pairs. A phrase can only be frequent if all
its pairs are, so the second reading follows pairs that pass a bit table of the frequent ones. The
table has a fixed size (16 MB); a false hit costs an entry that is counted and then dropped, nothing
is lost. All numbers are exact.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilseries.functions.columns import every_salt, salt
from vigilseries.functions.storage import materialise
from vigilseries.llm.text import column

BREAKS = ".,;:!?\n\x0b\x0c\r"  # end a piece
LEAST = 30
MOST_WORDS = 4
SHARE = 80  # percent of a phrase's occurrences that a longer one takes over
TOP = 2000
SCALE = 2_000_000
NO_GROUP = "und"

TOKENS = 2_000_000  # words whose stripes are combined in a task
BITS = 1 << 27  # of the table of frequent pairs
PARTS = (64, 16, 4)  # parts of a stripe by the words of its prefix; the last holds for longer ones
ROWS = 1000  # stripes that are added up at once
RANKED_PARTS = 64

_BREAK = b"\xff"  # not part of any UTF-8 text
_TABLE = bytes.maketrans(BREAKS.encode(), _BREAK * len(BREAKS))
_STRIPE = "lang string, prefix string, part int, nexts string, counts array<long>"
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: str | None) -> list[bytes]:
    """Words and, as a token of its own, the end of a piece."""
    raw = (text or "").encode("utf-8", "replace").lower().translate(_TABLE)
    return raw.replace(_BREAK, b" " + _BREAK + b" ").split()


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hash(lang: str, word: bytes) -> int:
    return xxhash.xxh64_intdigest(lang.encode("utf-8", "replace") + b"\0" + word)


def _places(first: np.ndarray, second: np.ndarray, bits: int) -> list[np.ndarray]:
    """Where a pair of word hashes stands in a table of so many bits."""
    one = _scramble(first * _FACTOR + second)
    two = _scramble(one + _FACTOR)
    mask = np.uint64(bits - 1)
    return [(x & mask).astype(np.int64) for x in (one, one >> np.uint64(32), two)]


class _Words:
    """Numbers for the words of a batch; 0 ends a piece."""

    def __init__(self) -> None:
        self.number = count(1)
        self.known: dict[str, defaultdict] = {}
        self.held: list[np.ndarray] = []
        self.size = 0

    def add(self, lang: str, found: list[bytes]) -> None:
        if lang not in self.known:
            self.known[lang] = defaultdict(self.number.__next__, {_BREAK: 0})
        numbers = self.known[lang].__getitem__
        self.held += [np.fromiter(map(numbers, found), np.int64, len(found)), np.zeros(1, np.int64)]
        self.size += len(found) + 1

    def listed(self) -> tuple[pa.Array, pa.Array, np.ndarray]:
        """By number: language, word, hash."""
        rows = [(n, lang, word) for lang, of in self.known.items() for word, n in of.items() if n]
        rows.sort()
        langs = pa.array(["", *(r[1] for r in rows)], pa.string())
        words = pa.array([b"", *(r[2] for r in rows)], pa.binary()).cast(pa.string())
        hashes = np.array([0, *(_word_hash(lang, word) for _, lang, word in rows)], np.uint64)
        return langs, words, hashes


def _stripes(
    langs: pa.Array, prefixes: pa.Array, words: pa.Array, hashes: np.ndarray,
    prefix: np.ndarray, following: np.ndarray, counts: np.ndarray, parts: int,
) -> pa.RecordBatch:
    """Entries as one row per prefix and part. ``langs`` and ``prefixes`` are listed by ``prefix``,
    ``words`` and ``hashes`` by ``following``."""
    part = (hashes[following] % np.uint64(parts)).astype(np.int32)
    order = np.lexsort((part, prefix))
    prefix, following, counts, part = prefix[order], following[order], counts[order], part[order]
    starts = np.flatnonzero(np.r_[True, (prefix[1:] != prefix[:-1]) | (part[1:] != part[:-1])])
    offsets = pa.array(np.r_[starts, len(prefix)], pa.int32())
    nexts = pa.ListArray.from_arrays(offsets, words.take(pa.array(following)))
    of = pa.array(prefix[starts])
    return pa.RecordBatch.from_arrays(
        [
            langs.take(of), prefixes.take(of), pa.array(part[starts]),
            pc.binary_join(nexts, " "), pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int64())),
        ],
        ["lang", "prefix", "part", "nexts", "counts"],
    )


def _parts(words: int) -> int:
    return PARTS[min(words, len(PARTS)) - 1]


def _pair_stripes(batch: _Words) -> Iterator[pa.RecordBatch]:
    langs, words, hashes = batch.listed()
    at, n = np.concatenate(batch.held), len(words)
    key, counts = np.unique(at[:-1][at[:-1] > 0] * n + at[1:][at[:-1] > 0], return_counts=True)
    if len(key):
        yield _stripes(langs, words, words, hashes, key // n, key % n, counts, _parts(1))


def _longer_stripes(batch: _Words, bits: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    """Stripes of prefixes of two words and more, along pairs that may be frequent."""
    langs, words, hashes = batch.listed()
    at, n = np.concatenate(batch.held), len(words)
    pair = (at[:-1] > 0) & (at[1:] > 0)
    places = _places(hashes[at[:-1][pair]], hashes[at[1:][pair]], 8 * len(bits))
    pair[pair] = np.all([bits[p >> 3] >> (p & 7) & 1 for p in places], axis=0)
    start = np.flatnonzero(pair)  # where the phrases so far begin
    key, number = np.unique(at[start] * n + at[start + 1], return_inverse=True)
    langs = langs.take(pa.array(key // n))
    texts = _joined(words.take(pa.array(key // n)), words.take(pa.array(key % n)))
    for k in range(3, most + 1):
        going = np.zeros(len(start), bool)
        inside = start + k - 2 < len(pair)
        going[inside] = pair[start[inside] + k - 2]
        start, number = start[going], number[going]
        if not len(start):
            return
        key, again, counts = np.unique(
            number * n + at[start + k - 1], return_inverse=True, return_counts=True
        )
        yield _stripes(langs, texts, words, hashes, key // n, key % n, counts, _parts(k - 1))
        of = pa.array(key // n)
        langs, texts = langs.take(of), _joined(texts.take(of), words.take(pa.array(key % n)))
        number = again


def _joined(left: pa.Array, right: pa.Array) -> pa.Array:
    return pc.binary_join_element_wise(left, right, " ")


def _combined(make: Callable[[_Words], Iterator[pa.RecordBatch]]):
    """Stripes of every ``TOKENS`` words of a task, from a stream of ``lang, text``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Words()
        for rows in (b.slice(at, 500) for b in batches for at in range(0, b.num_rows, 500)):
            for lang, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                held.add(lang, tokens(text))
                if held.size >= TOKENS:
                    yield from make(held)
                    held = _Words()
        if held.size:
            yield from make(held)

    return read


def _added(rows: pa.Table) -> tuple[pa.Table, np.ndarray, pa.Table]:
    """Stripes of one key added up: the keys, where each one's entries end, and the entries."""
    keys = [rows[c].combine_chunks() for c in ("lang", "prefix", "part")]
    new = np.zeros(len(rows), bool)
    new[0] = True
    for k in keys:
        new[1:] |= pc.not_equal(k.slice(1), k.slice(0, len(k) - 1)).to_numpy(zero_copy_only=False)
    group = np.cumsum(new) - 1
    nexts = pc.split_pattern(rows["nexts"].combine_chunks(), " ")
    entries = pa.table(
        {
            "group": pa.array(np.repeat(group, pc.list_value_length(nexts).to_numpy())),
            "next": nexts.flatten(),
            "n": rows["counts"].combine_chunks().flatten(),
        }
    )
    summed = entries.group_by(["group", "next"], use_threads=False).aggregate([("n", "sum")])
    summed = summed.take(pa.array(np.argsort(summed["group"].to_numpy(), kind="stable")))
    ends = np.searchsorted(summed["group"].to_numpy(), np.arange(group[-1] + 1), side="right")
    first = pa.array(np.flatnonzero(new))
    return pa.table({"lang": keys[0].take(first), "prefix": keys[1].take(first), "part": keys[2].take(first)}), ends, summed


def _lists(ends: np.ndarray, entries: pa.Table) -> tuple[pa.Array, pa.Array]:
    offsets = pa.array(np.r_[0, ends], pa.int32())
    return tuple(
        pa.ListArray.from_arrays(offsets, entries[c].combine_chunks()) for c in ("next", "n_sum")
    )


def _merged(least: int, totals: bool):
    """From sorted stripes: per key the sum and the entries of at least ``least``. Without
    ``totals`` a key without such entries is left out."""

    def finished(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        keys, ends, entries = _added(rows)
        n = entries["n_sum"].to_numpy()
        sums = np.diff(np.r_[0, np.cumsum(n)[ends - 1]])
        often = (n >= least) & pc.not_equal(entries["next"], "").to_numpy()
        nexts, counts = _lists(np.cumsum(often)[ends - 1], entries.filter(pa.array(often)))
        out = pa.RecordBatch.from_arrays(
            [
                *(keys[c].combine_chunks() for c in ("lang", "prefix")),
                pa.array(sums, pa.int64()), nexts, counts,
            ],
            ["lang", "prefix", "total", "nexts", "counts"],
        )
        yield out if totals else out.filter(pc.greater(pc.list_value_length(nexts), 0))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for rows in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            table = pa.Table.from_batches([rows])
            if held is not None:
                table = pa.concat_tables([held, table])
            last = table.slice(len(table) - 1).to_pylist()[0]
            open_ = np.ones(len(table), bool)
            for c in ("lang", "prefix", "part"):
                open_ &= pc.equal(table[c], last[c]).to_numpy()
            start = len(table) - int(open_.sum())
            if start:
                yield from finished(table.slice(0, start))
            keys, ends, entries = _added(table.slice(start))
            nexts, counts = _lists(ends, entries)
            held = keys.append_column("nexts", pc.binary_join(nexts, " ")).append_column("counts", counts)
        if held is not None:
            yield from finished(held)

    return merge


def _merge(stripes: DataFrame, least: int, totals: bool, name: str) -> DataFrame:
    ordered = stripes.repartition("lang", "prefix", "part").sortWithinPartitions("lang", "prefix", "part")
    schema = "lang string, prefix string, total long, nexts array<string>, counts array<long>"
    return materialise(ordered.mapInArrow(_merged(least, totals), schema), name)


def _entries(stripes: DataFrame) -> DataFrame:
    one = F.explode(F.arrays_zip(F.col("nexts").alias("next"), F.col("counts").alias("n")))
    found = stripes.select("lang", "prefix", one.alias("e"))
    return found.select(
        "lang", "prefix", F.col("e.next").alias("next"),
        F.concat_ws(" ", "prefix", "e.next").alias("phrase"), F.col("e.n").alias("a"),
    )


def _bit_table(pairs: DataFrame) -> np.ndarray:
    """The table of frequent pairs, at most ``BITS`` / 64 rows whatever their number."""
    size = BITS

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, first, second = (b.column(i).to_pylist() for i in range(3))
            hashed = [
                np.array([_word_hash(lang, w.encode("utf-8")) for lang, w in zip(langs, of, strict=True)], np.uint64)
                for of in (first, second)
            ]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(_places(*hashed, size)))], ["place"])

    at = pairs.select("lang", "prefix", "next").mapInArrow(places, "place long")
    bit = F.expr("shiftleft(1L, CAST(place % 64 AS INT))")
    packed = at.groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    table = np.zeros(size // 64, "<i8")
    table[packed["word"].to_numpy()] = packed["bits"].to_numpy()
    return table.view(np.uint8)


def _without_first(phrase: Column) -> Column:
    return F.substr(phrase, F.instr(phrase, " ") + F.lit(1))


def mined(
    docs: DataFrame,
    text_column: str = "text",
    group_column: str = "lang",
    least: int = LEAST,
    most_words: int = MOST_WORDS,
    share: int = SHARE,
    top: int = TOP,
) -> DataFrame:
    """The first ``top`` phrases of each group: ``lang, rank, phrase, a, l, r, n, score``.

    Candidates are phrases of two to ``most_words`` words with ``a >= least`` occurrences. A cut
    leaves parts with ``l`` and ``r`` occurrences and the score ``floor(SCALE * a / (l + r))``; the
    lowest cut counts, ties go to the earliest. A phrase within a longer candidate that has at least
    ``share`` percent of its occurrences is left out. ``n`` is the number of words of the group.
    Order: score, occurrences, phrase by bytes.

    Null texts are empty, a null group is ``und``, repeated rows count as often as they come; texts
    are read whole. An empty table gives an empty result; other columns are not looked at.
    """
    texts = docs.select(
        F.coalesce(column(group_column).cast("string"), F.lit(NO_GROUP)).alias("lang"),
        column(text_column).alias("text"),
    )
    one = _merge(texts.mapInArrow(_combined(_pair_stripes), _STRIPE), least, True, "phrase-pairs")
    pairs = _entries(one)
    held = docs.sparkSession.sparkContext.broadcast(_bit_table(pairs))
    longer = _merge(
        texts.mapInArrow(_combined(lambda b: _longer_stripes(b, held.value, most_words)), _STRIPE),
        least, False, "phrase-longer",
    )
    more = _entries(longer)

    # What is left of a phrase whose longest frequent extension, on either side, is taken out.
    # A phrase further inside of a longer one is inside of an extension that is at least as frequent.
    none = F.lit(None).cast("long")
    known = pairs.unionByName(more).select("lang", "phrase", "a", none.alias("beyond"))
    inside = [
        more.select("lang", part.alias("phrase"), none.alias("a"), F.col("a").alias("beyond"))
        for part in (F.col("prefix"), _without_first(F.col("phrase")))
    ]
    kept = (
        known.unionByName(inside[0]).unionByName(inside[1])
        .groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.max("beyond").alias("beyond"))
        .where(F.col("beyond").isNull() | (100 * F.col("beyond") < share * F.col("a")))
        .select("lang", "phrase", "a")
    )
    kept = materialise(kept, "phrase-kept")

    words = one.groupBy("lang", F.col("prefix").alias("part")).agg(F.sum("total").alias("f"))
    words = words.where(F.col("f") >= least).withColumn("salt", every_salt())
    phrases = pairs.unionByName(more).select(
        "lang", F.col("phrase").alias("part"), F.col("a").alias("f"), F.lit(0).alias("salt")
    )
    cut = F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k")
    cuts = kept.withColumn("w", F.split("phrase", " ")).select("lang", "phrase", "a", "w", cut)
    side = lambda n, at, size: F.struct(F.lit(n).alias("side"), F.slice("w", at, size).alias("w"))
    sides = F.explode(
        F.array(side("l", F.lit(1), F.col("k")), side("r", F.col("k") + 1, F.size("w") - F.col("k")))
    )
    asked = cuts.select("lang", "phrase", "a", "k", sides.alias("s")).select(
        "lang", "phrase", "a", "k", "s.side", F.array_join("s.w", " ").alias("part"),
        F.when(F.size("s.w") == 1, salt(F.col("phrase"))).otherwise(0).alias("salt"),
    )
    counted = asked.join(words.unionByName(phrases), ["lang", "part", "salt"])
    of = lambda name: F.max(F.when(F.col("side") == name, F.col("f"))).alias(name)
    sums = counted.groupBy("lang", "phrase", "a", "k").agg(of("l"), of("r"))
    score = F.expr(
        f"CAST({SCALE} AS DECIMAL(7, 0)) * CAST(a AS DECIMAL(19, 0)) div CAST(l + r AS DECIMAL(19, 0))"
    )
    lowest = sums.withColumn("score", score).groupBy("lang", "phrase", "a").agg(
        F.min_by(F.struct("score", "l", "r"), F.struct("score", "k")).alias("best")
    )
    scored = lowest.select("lang", "phrase", "a", "best.*")
    total = one.groupBy("lang").agg(F.sum("total").alias("n"))
    return _first(scored, top).join(total, "lang").select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score"
    )


def _first(scored: DataFrame, top: int) -> DataFrame:
    """The first of a group are among the first of its parts, so no task ranks a whole group."""
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANKED_PARTS)).alias("ranked_part")
    parted = scored.select("*", part)
    own = F.row_number().over(Window.partitionBy("lang", "ranked_part").orderBy(*order))
    some = parted.withColumn("own", own).where(F.col("own") <= top).drop("own", "ranked_part")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    return some.withColumn("rank", rank).where(F.col("rank") <= top)
