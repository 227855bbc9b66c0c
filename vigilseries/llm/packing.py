"""Best-fit packing of token pieces into sequences by exact complements.

Only the number of pieces of every length matters for the plan, at most as many numbers as a sequence
has tokens, so the plan is made once from that histogram: the longest open length takes a single, a
pair or a triple of lengths that fills its gap exactly, as often as all of them are available; what
no combination completes is packed best fit. The plan is a list of shapes with a multiplicity. Pieces
are then numbered within their length and look their place up by that number.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigilseries.functions.storage import materialise
from vigilseries.llm.text import column

TOKENS = 2048  # of a sequence
END = 0  # id after every document
NUMBERED_ROWS = 100_000  # pieces that are numbered in one task


@dataclass
class Plan:
    """Shapes as (lengths in order, how many sequences)."""

    size: int
    shapes: list[tuple[tuple[int, ...], int]] = field(default_factory=list)

    @property
    def sequences(self) -> int:
        return sum(n for _, n in self.shapes)


def _take(free: np.ndarray, parts: tuple[int, ...]) -> int:
    """How often the combination is available."""
    need = {p: parts.count(p) for p in parts}
    return min(int(free[p]) // n for p, n in need.items())


def _complement(free: np.ndarray, gap: int) -> Iterator[tuple[int, ...]]:
    """Available combinations of one, two and three lengths that sum to ``gap``, longest first.
    ``free`` may change between two of them."""
    if gap < 1:
        return
    if free[gap]:
        yield (gap,)
    have = free > 0
    longs = np.arange(gap - 1, (gap + 1) // 2 - 1, -1)
    for a in longs[have[longs] & have[gap - longs]]:
        yield (int(a), int(gap - a))
    for a in range(gap - 2, (gap + 2) // 3 - 1, -1):
        if not free[a]:
            continue
        rest = gap - a
        seconds = np.arange(min(a, rest - 1), (rest + 1) // 2 - 1, -1)
        for b in seconds[(free[seconds] > 0) & (free[rest - seconds] > 0)]:
            yield (a, int(b), int(rest - b))
            if not free[a]:
                break


def plan(counts: dict[int, int], size: int = TOKENS) -> Plan:
    """Sequences for ``counts`` pieces of every length up to ``size``."""
    free = np.zeros(size + 1, np.int64)
    for length, n in counts.items():
        free[length] += n
    made = Plan(size)
    if free[size]:
        made.shapes.append(((size,), int(free[size])))
        free[size] = 0
    for first in range(size - 1, 0, -1):
        if not free[first]:
            continue
        for rest in _complement(free, size - first):
            n = _take(free, (first, *rest))
            if n:
                for part in (first, *rest):
                    free[part] -= n
                made.shapes.append(((first, *rest), n))
            if not free[first]:
                break
    _best_fit(free, made)
    return made


def _best_fit(free: np.ndarray, made: Plan) -> None:
    """Longest first into the fullest open sequence that has room, many equal ones at a time."""
    open_by_gap: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    gaps = np.zeros(made.size + 1, bool)
    for length in range(made.size, 0, -1):
        left = int(free[length])
        while left:
            room = np.flatnonzero(gaps[length:])
            if not len(room):
                per = made.size // length  # as many as fit into new ones
                full, rest = divmod(left, per)
                for k, n in ((per, full), (rest, 1 if rest else 0)):
                    if n:
                        gap = made.size - k * length
                        open_by_gap.setdefault(gap, []).append(((length,) * k, n))
                        gaps[gap] = True
                break
            gap = length + int(room[0])
            shape, n = open_by_gap[gap].pop()
            put = min(n, left)
            if n > put:
                open_by_gap[gap].append((shape, n - put))
            elif not open_by_gap[gap]:
                gaps[gap] = False
            left -= put
            rest = gap - length
            open_by_gap.setdefault(rest, []).append(((*shape, length), put))
            gaps[rest] = True
        free[length] = 0
    for shapes in open_by_gap.values():
        made.shapes += shapes


def _slots(made: Plan) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: first number of each slot, its first sequence, its offset."""
    slots: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    first = 0
    for shape, n in made.shapes:
        offset = 0
        for length in shape:
            slots.setdefault(length, []).append((used.get(length, 0), first, offset))
            used[length] = used.get(length, 0) + n
            offset += length
        first += n
    return {
        length: tuple(np.array(x, np.int64) for x in zip(*rows, strict=True))
        for length, rows in slots.items()
    }


_encoder: dict[str, WordEncoder] = {}
# Letters are letters in every version of Unicode; what ends them surely is none.
_PARTS = re.compile(
    r" ?[A-Za-zÀ-ÖØ-öø-ɏ]+(?=[!-@\[-`{-~ \n]|\Z)|"
    r" ?[!-@\[-`{-~]+(?=[ \n]|\Z)|"
    r"\n(?=\S)|"
    r".+?(?:(?<=\S)(?= )|\Z)",
    re.S,
)


class _Known(dict):
    """Ids of parts, found when they are first asked for."""

    def __init__(self, tokenizer) -> None:
        super().__init__()
        self.tokenizer = tokenizer

    def __missing__(self, part: str) -> bytes:
        ids = array("I", self.tokenizer.encode(part, add_special_tokens=False).ids).tobytes()
        self[part] = ids
        return ids


class WordEncoder:
    """Ids of whole texts as bytes (32-bit little-endian), from a cache of their parts.

    A pre-token of a byte-level vocabulary never reaches from something into white space, a run of
    letters that something else follows is one, and so is a line break before something; a text may
    be cut at all of these without changing its ids.
    """

    LIMIT = 1_000_000  # parts kept

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.known = _Known(self.tokenizer)

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > self.LIMIT:
            self.known.clear()
        ids = self.known.__getitem__
        return [b"".join(map(ids, _PARTS.findall(text))) for text in texts]


_PIECE = "doc_id long, piece int, start long, length int, ids_crc32 long"


def pieces(
    docs: DataFrame,
    tokenizer: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    size: int = TOKENS,
    with_ids: bool = False,
) -> DataFrame:
    """Documents as ids with ``END`` after them, those longer than ``size`` cut into pieces of
    ``size`` after a first one that may be shorter: ``doc_id, piece, start, length, ids_crc32`` and
    with ``with_ids`` the ids as bytes. A null text is empty and gives one piece of one id."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _encoder:
            _encoder[tokenizer] = WordEncoder(tokenizer)
        encoder = _encoder[tokenizer]
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                texts = [t or "" for t in batch.column(1).to_pylist()]
                out: dict[str, list] = {c: [] for c in ("doc", "piece", "start", "length", "crc", "ids")}
                for doc, ids in zip(batch.column(0).to_pylist(), encoder.encode(texts), strict=True):
                    ids += END.to_bytes(4, "little")
                    n = len(ids) // 4
                    borders = [0, *range(n % size or size, n + 1, size)]
                    for k, (a, b) in enumerate(zip(borders, borders[1:], strict=False)):
                        part = ids[4 * a : 4 * b]
                        for name, value in zip(out, (doc, k, a, b - a, zlib.crc32(part), part), strict=True):
                            out[name].append(value)
                columns = [
                    pa.array(out["doc"], pa.int64()), pa.array(out["piece"], pa.int32()),
                    pa.array(out["start"], pa.int64()), pa.array(out["length"], pa.int32()),
                    pa.array(out["crc"], pa.int64()),
                ]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(out["ids"], pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    chosen = docs.select(column(id_column).cast("long").alias("id"), column(text_column).alias("text"))
    return chosen.mapInArrow(cut, _PIECE + (", ids binary" if with_ids else ""))


def packed(cut: DataFrame, size: int = TOKENS) -> DataFrame:
    """``cut`` (see :func:`pieces`) with ``sequence_id`` and ``offset``.

    Equal pieces may change places between runs, which no row shows; repeated rows are pieces of
    their own. An empty table has no sequence.
    """
    stored = materialise(cut, "packing-pieces")
    histogram = {r["length"]: r["n"] for r in stored.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = _slots(plan(histogram, size))
    total = sum(histogram.values())
    chunks = max(1, -(-total // NUMBERED_ROWS))
    # Number the pieces of a length: chunks are counted first, so a frequent length is many tasks.
    chunk = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(chunks))
    chunked = stored.withColumn("chunk", chunk)
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        chunked.groupBy("length", "chunk")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("length", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    )
    within = Window.partitionBy("length", "chunk").orderBy("doc_id", "piece", "ids_crc32")
    ranked = chunked.withColumn("rank", F.row_number().over(within) - 1).join(starts, ["length", "chunk"])
    names = stored.columns
    numbered = ranked.select(*names, (F.col("base") + F.col("rank")).alias("number"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(names.index("length")).to_numpy()
            number = batch.column(len(names)).to_numpy()
            sequence = np.empty(len(length), np.int64)
            offset = np.empty(len(length), np.int64)
            for one in np.unique(length):
                first, begin, where = slots[int(one)]
                at = np.flatnonzero(length == one)
                slot = np.searchsorted(first, number[at], "right") - 1
                sequence[at] = begin[slot] + number[at] - first[slot]
                offset[at] = where[slot]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(sequence), pa.array(offset)],
                [*names, "sequence_id", "offset"],
            )

    schema = numbered.drop("number").schema.add("sequence_id", "long").add("offset", "long")
    return numbered.mapInArrow(place, schema)


def sequences(placed: DataFrame) -> DataFrame:
    """The sequences themselves: ``sequence_id, ids`` (bytes, at most one sequence long)."""
    part = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(part, F.unhex(F.lit("")), lambda all_, x: F.concat(all_, x["ids"]))
    return placed.groupBy("sequence_id").agg(joined.alias("ids"))
