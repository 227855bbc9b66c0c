"""Exact neighbour searches between two sets of vectors of the same instance.

Both sides meet in blocks: a task computes the distances of a block of queries and a block of
references and reports one (or k) rows per query. No pair of points ever becomes a row, and a group of
``_meet`` holds two blocks at most.

An instance with more references than a block gets a metric index. A bounded number of references are
its pivots; every reference is in the cell of its nearest pivot (balls in cells of their own), and a cell
knows how near and how far its members are from the pivots. A query measures the pivots only. Its k-th
nearest pivot bounds how far its neighbours can be; triangle inequalities bound how near the members of a
cell can be; it marks the cells that may hold a neighbour. Queries stay one row each: those with near
pivots form a block, which a task holds (``MOST_QUERIES`` bounds it) while the references of the marked
cells stream past it, batch by batch. Cells that nobody asks for do not move. A reference moves to at most
``SPREAD`` blocks, or as many as the bound of a block makes necessary. The search stays exact; where
distances tell nothing apart all blocks meet all references.

Queries: keys, ``qid`` (any type), ``vec``. References: keys, ``rid`` (long), ``vec``, ``aux``
(double; a radius, a label or missing).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilseries.functions.arrow import list_matrix
from vigilseries.functions.columns import INSTANCE
from vigilseries.functions.storage import materialise

BLOCK = 2048
MOST_PIVOTS = 256  # of an instance; fewer where it has few blocks
BOUNDED = 32  # pivots whose distances to the members of a cell are known
PART = 16_384  # rows that measure the pivots in a task
SPREAD = 24  # blocks that the queries of an instance with an index are dealt to
MOST_QUERIES = 32_768  # of such a block; more blocks where it would have more
CELLS = 2 * MOST_PIVOTS  # cells of points, then cells of balls
WORDS = CELLS // 64  # numbers of 64 bits with a mark per cell


def squared_distances(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sums of squared differences, dimension by dimension (exactly 0 for equal points)."""
    total = np.zeros((len(left), len(right)))
    step = np.empty_like(total)
    for a, b in zip(left.T, right.T, strict=True):
        np.subtract(a[:, None], b[None, :], out=step)
        np.multiply(step, step, out=step)
        total += step
    return total


def _slices(n_queries: int, n_refs: int):
    """Query slices whose distance matrix stays in the processor cache."""
    size = max(1, 65_536 // max(n_refs, 1))
    return (slice(i, min(i + size, n_queries)) for i in range(0, n_queries, size))


def _meet(
    queries: DataFrame,
    refs: DataFrame,
    keys: Sequence[str],
    columns: list[tuple[str, T.DataType, pa.DataType]],
    kernel: Callable[[pa.Table, np.ndarray, pa.Table, np.ndarray], dict],
    one_block: bool,
    search: Search,
) -> DataFrame:
    """Run ``kernel(query rows, query matrix, reference rows, reference matrix)`` per meeting."""
    keys = list(keys)
    large = None
    if one_block:
        zero = [F.lit(0).cast("long").alias(c) for c in ("cell", "qb", "rb")]
        both = _sides(queries, refs, keys, zero, zero)
    else:
        both, large = _small_and_large(queries, refs, keys, search)
    out = T.StructType(
        [
            *[queries.schema[k] for k in keys],
            T.StructField("qid", both.schema["qid"].dataType),
            *[T.StructField(name, spark_type) for name, spark_type, _ in columns],
        ]
    )

    def run(table: pa.Table) -> pa.Table:
        is_query = table["is_query"]
        left, right = table.filter(is_query), table.filter(pc.invert(is_query))
        rows = left.select([*keys, "qid"])
        if not (len(left) and len(right)):
            result = {name: pa.array([], arrow) for name, _, arrow in columns}
            rows = rows.slice(0, 0)
        else:
            result = kernel(left, list_matrix(left["vec"]), right, list_matrix(right["vec"]))
            if "_query" in result:
                rows = rows.take(pa.array(result["_query"]))
        for name, _, _ in columns:
            rows = rows.append_column(name, result[name])
        return rows

    met = both.groupBy(*keys, "cell", "qb", "rb").applyInArrow(run, out)
    if large is None:
        return met
    ordered = large.repartition(*keys, "qb").sortWithinPartitions(*keys, "qb", F.desc("is_query"), "at")
    return met.unionByName(ordered.mapInArrow(_stream(keys, search, [name for name, _, _ in columns]), out))


@dataclass(frozen=True)
class Search:
    """What a search needs to know of a cell to pass it by."""

    k: int
    balls: bool = False  # references with ``aux`` matter only where a query is closer than it
    skip_same: bool = False


def _sides(q: DataFrame, r: DataFrame, keys: list[str], of_q: list, of_r: list) -> DataFrame:
    """Queries and references in one frame, with their cell and block numbers."""
    kind = q.schema["qid"].dataType
    left = q.select(
        *keys, F.lit(True).alias("is_query"), "qid", F.lit(None).cast("long").alias("rid"), "vec",
        F.lit(None).cast("double").alias("aux"), *of_q,
    )
    right = r.select(
        *keys, F.lit(False).alias("is_query"), F.lit(None).cast(kind).alias("qid"),
        F.col("rid").cast("long").alias("rid"), "vec", F.col("aux").cast("double").alias("aux"), *of_r,
    )
    return left.unionByName(right)


def blocks(queries: DataFrame, refs: DataFrame, keys: Sequence[str], search: Search) -> DataFrame:
    """All rows with ``cell``, ``qb`` and ``rb``: those with equal numbers meet."""
    small, large = _small_and_large(queries, refs, keys, search)
    return small if large is None else small.unionByName(large.select(*small.columns))


def _small_and_large(
    queries: DataFrame, refs: DataFrame, keys: Sequence[str], search: Search
) -> tuple[DataFrame, DataFrame | None]:
    """Rows of :func:`blocks`: of instances with one block of references, and of those with an index."""
    keys = list(keys)
    q = queries.select(*keys, "qid", "vec")
    r = refs.select(*keys, F.col("rid").cast("long").alias("rid"), "vec", F.col("aux").cast("double").alias("aux"))
    per = lambda n, size: F.greatest(F.ceil(F.col(n) / size), F.lit(1)).alias
    counts = (
        q.select(*keys, F.lit(1).alias("q"))
        .unionByName(r.select(*keys, F.lit(0).alias("q")))
        .groupBy(*keys)
        .agg(F.count_if(F.col("q") == 1).alias("n_q"), F.count_if(F.col("q") == 0).alias("n_r"))
    )
    # Only instances with more than one block are listed, so what all rows meet stays small.
    sizes = materialise(
        counts.select(
            *keys, per("n_q", BLOCK)("nq"), per("n_r", BLOCK)("nr"), per("n_q", PART)("q_parts"),
            per("n_r", PART)("r_parts"),
        ).where((F.col("nq") > 1) | (F.col("nr") > 1)),
        "neighbour-sizes",
    )
    zero = F.lit(0).cast("long")
    large = sizes.where(F.col("nr") > 1)
    wide = sizes.where(F.col("nr") == 1).select(*keys, "nq")
    small_q = q.join(large.select(*keys), keys, "left_anti").join(wide, keys, "left")
    small_r = r.join(large.select(*keys), keys, "left_anti").join(wide, keys, "left")
    nq = F.coalesce("nq", F.lit(1).cast("long"))
    small = _sides(
        small_q, small_r, keys,
        [zero.alias("cell"), F.pmod(F.xxhash64("qid"), nq).alias("qb"), zero.alias("rb")],
        [zero.alias("cell"), F.explode(F.sequence(zero, nq - 1)).alias("qb"), zero.alias("rb")],
    )
    return small, None if large.isEmpty() else _in_cells(q, r, keys, large, search)


def _parted(rows: DataFrame, large: DataFrame, keys: list[str], name: str, parts: str) -> DataFrame:
    """Rows of large instances, an instance in parts."""
    some = rows.join(large.select(*keys, F.col(parts).alias("parts")), keys)
    return some.withColumn("part", F.pmod(F.xxhash64(name), "parts")).drop("parts")


def _for_parts(small: DataFrame, large: DataFrame, keys: list[str], parts: str) -> DataFrame:
    """A row per instance for each of its parts."""
    some = small.join(large.select(*keys, F.col(parts).alias("parts")), keys)
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    return some.withColumn("part", every).drop("parts")


def _in_cells(q: DataFrame, r: DataFrame, keys: list[str], large: DataFrame, search: Search) -> DataFrame:
    """Rows of instances with an index: queries in their block with the cells that they need (``needs``,
    64 marks a number) and a bound (``within``), references in the blocks that need their cell (``at``)."""
    order = Window.partitionBy(*keys).orderBy(F.xxhash64("rid"), "rid")
    wanted = F.greatest(F.lit(16), 4 * F.col("nr")).alias("pivots")
    drawn = (
        r.join(large.select(*keys, wanted), keys)
        .withColumn("nth", F.row_number().over(order))
        .where((F.col("nth") <= MOST_PIVOTS) & (F.col("nth") <= F.col("pivots")))
    )
    pivots = materialise(
        drawn.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("nth", "rid", "vec", "aux"))).alias("pivots")),
        "neighbour-pivots",
    )
    # field by field: a name of a type does not tell what may be missing
    typed = lambda *more: T.StructType([*[q.schema[k] for k in keys], *[T.StructField(n, t) for n, t in more]])
    long, double, vector = T.LongType(), T.DoubleType(), T.ArrayType(T.DoubleType())
    low, high = (F.lit(x).cast("double") for x in ("inf", "-inf"))
    placed = materialise(
        _parted(r, large, keys, "rid", "r_parts").groupBy(*keys, "part")
        .cogroup(_for_parts(pivots, large, keys, "r_parts").groupBy(*keys, "part"))
        .applyInArrow(
            _place(keys, search.balls, BOUNDED),
            typed(
                ("cell", long), ("rid", long), ("vec", vector), ("aux", double), ("n", long), ("plain", long),
                ("reach", double), ("radius", double), ("low", vector), ("high", vector),
            ),
        ),
        "neighbour-cells",
    )
    merged = lambda name, start, pick: F.aggregate(
        F.collect_list(name), F.array_repeat(start, BOUNDED), lambda s, x: F.zip_with(s, x, lambda a, b: pick(a, b))
    ).alias(name)  # one list per part
    cells = materialise(
        placed.where(F.col("n").isNotNull()).groupBy(*keys, "cell").agg(
            F.sum("n").alias("n"), F.sum("plain").alias("plain"), F.max("reach").alias("reach"),
            F.max("radius").alias("radius"), merged("low", low, F.least), merged("high", high, F.greatest),
        ),
        "neighbour-index",
    )
    columns = ("cell", "plain", "reach", "radius", "low", "high")
    index = pivots.join(cells.groupBy(*keys).agg(F.collect_list(F.struct(*columns)).alias("cells")), keys)
    marks = T.ArrayType(long)
    asked = materialise(
        _parted(q, large, keys, "qid", "q_parts").groupBy(*keys, "part")
        .cogroup(_for_parts(index, large, keys, "q_parts").groupBy(*keys, "part"))
        .applyInArrow(
            _ask(keys, search),
            typed(("qid", q.schema["qid"].dataType), ("vec", vector), ("home", long), ("within", double), ("needs", marks)),
        ),
        "neighbour-asked",
    )
    whole = Window.partitionBy(*keys)
    before = F.sum("n").over(whole.orderBy("home")) - F.col("n")
    fair = F.greatest(F.ceil(F.sum("n").over(whole) / SPREAD), F.lit(BLOCK))
    homes = (
        asked.groupBy(*keys, "home").agg(F.count(F.lit(1)).alias("n"))  # a row per pivot at most
        .withColumn("before", before)
        .withColumn("size", F.least(fair, F.lit(max(BLOCK, MOST_QUERIES))))
    )
    # Queries with the same nearest pivot share a block, unless they alone are more than a block.
    in_block = lambda nth: F.floor(nth / F.col("size"))
    whole_home, middle = F.col("n") <= F.col("size"), in_block(F.col("before") + F.col("n") / 2)
    first = F.when(whole_home, middle).otherwise(in_block(F.col("before")))
    last = F.when(whole_home, middle).otherwise(in_block(F.col("before") + F.col("n") - 1))
    homes = materialise(homes.select(*keys, "home", first.alias("first"), last.alias("last")), "neighbour-homes")
    spread = F.col("first") + F.pmod(F.xxhash64("qid"), F.col("last") - F.col("first") + 1)
    asked = asked.join(homes, [*keys, "home"]).withColumn("qb", spread)
    marked = lambda c: F.getbit(F.get("needs", (c / 64).cast("int")), (c % 64).cast("int")) == 1
    every = F.sequence(F.lit(0).cast("long"), F.lit(CELLS - 1).cast("long"))
    meeting = materialise(
        asked.groupBy(*keys, "qb")
        .agg(F.array(*[F.bit_or(F.get("needs", F.lit(w))) for w in range(WORDS)]).alias("needs"))
        .select(*keys, "qb", F.explode(F.filter(every, marked)).alias("cell"))
        .groupBy(*keys, "cell").agg(F.collect_list("qb").alias("blocks")),
        "neighbour-blocks",
    )
    zero, none = F.lit(0).cast("long"), F.lit(None)
    return _sides(
        asked, placed.where(F.col("n").isNull()).join(meeting, [*keys, "cell"]), keys,
        [zero.alias("cell"), "qb", zero.alias("rb"), none.cast(long).alias("at"), "within", "needs"],
        [
            zero.alias("cell"), F.explode("blocks").alias("qb"), zero.alias("rb"), F.col("cell").alias("at"),
            none.cast(double).alias("within"), none.cast(marks).alias("needs"),
        ],
    )


def _place(keys: list[str], balls: bool, bounded: int):
    """References with their cell; one more row per cell tells how far its members are."""

    def place(left: pa.Table, right: pa.Table) -> pa.Table:
        points = list_matrix(left["vec"])
        pivots = np.array([p["vec"] for p in right["pivots"][0].as_py()]) if len(right) else points[:0]
        far = np.sqrt(squared_distances(points, pivots))
        cell = far.argmin(axis=1) if len(left) else np.zeros(0, np.int64)
        aux = left["aux"].to_numpy()
        ball = ~np.isnan(aux) if balls else np.zeros(len(left), bool)
        cell = cell + MOST_PIVOTS * ball
        told = {c: [] for c in ("cell", "n", "plain", "reach", "radius", "low", "high")}
        for c in np.unique(cell).tolist():
            own = cell == c
            low, high = np.zeros(bounded), np.full(bounded, np.inf)  # beyond the pivots: no bound
            some = far[own, :bounded]
            low[: some.shape[1]], high[: some.shape[1]] = some.min(axis=0), some.max(axis=0)
            radius = float(aux[own & ball].max()) if (own & ball).any() else -np.inf
            reach = float(far[own, c % MOST_PIVOTS].max())
            values = (c, int(own.sum()), int((own & ~ball).sum()), reach, radius, low, high)
            for column, value in zip(told.values(), values, strict=True):
                column.append(value)
        n, m = len(left), len(told["cell"])
        both = lambda first, second: pa.chunked_array([*(first.chunks if isinstance(first, pa.ChunkedArray) else [first]), second])
        arrays = {k: both(left[k], left[k].combine_chunks().take(pa.array(np.zeros(m, np.int64)))) for k in keys}
        lists = pa.list_(pa.float64())
        arrays["cell"] = both(pa.array(cell, pa.int64()), pa.array(told["cell"], pa.int64()))
        for c, kind in (("rid", pa.int64()), ("vec", lists), ("aux", pa.float64())):
            arrays[c] = both(left[c].cast(kind), pa.nulls(m, kind))
        for c, kind in (("n", pa.int64()), ("plain", pa.int64()), ("reach", pa.float64()), ("radius", pa.float64()), ("low", lists), ("high", lists)):
            arrays[c] = both(pa.nulls(n, kind), pa.array(told[c], kind))
        return pa.table(arrays)

    return place


def _ask(keys: list[str], search: Search):
    """Every query with its place along the pivots, the cells that it needs and how far its k-th nearest
    pivot is."""

    def needed(far: np.ndarray, within: np.ndarray, cells: dict[str, np.ndarray]) -> np.ndarray:
        own = far[:, cells["cell"] % MOST_PIVOTS]
        nearer = np.maximum(own - cells["reach"], (own - far.min(axis=1)[:, None]) / 2)
        for p in range(min(far.shape[1], cells["low"].shape[1])):
            at = far[:, p, None]
            np.maximum(nearer, np.maximum(at - cells["high"][:, p], cells["low"][:, p] - at), out=nearer)
        nearer -= 1e-9 * (1 + far.max(axis=1)[:, None])  # rounding of the distances
        found = (cells["plain"] > 0) & (nearer <= within[:, None])
        found |= nearer < cells["radius"]
        found[~found.any(axis=1), nearer[~found.any(axis=1)].argmin(axis=1)] = True
        return found

    def ask(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = left.select([*keys, "qid", "vec"])
        told = lambda rows, home, within, needs: (
            rows.append_column("home", pa.array(home, pa.int64())).append_column("within", pa.array(within, pa.float64()))
            .append_column("needs", needs)
        )
        if not (len(left) and len(right)):
            return told(rows.slice(0, 0), [], [], pa.array([], pa.list_(pa.int64())))
        points = list_matrix(left["vec"])
        pivots, listed = right["pivots"][0].as_py(), right["cells"][0].as_py()
        cells = {c: np.array([x[c] for x in listed]) for c in ("cell", "plain", "reach", "radius", "low", "high")}
        at = np.array([p["vec"] for p in pivots])
        plain = np.array([not search.balls or p["aux"] is None or np.isnan(p["aux"]) for p in pivots])
        place = np.argsort(_along(at))
        home, bound = np.zeros(len(points), np.int64), np.zeros(len(points))
        needs = np.zeros((len(points), CELLS // 8), np.uint8)
        for part in (slice(i, i + 512) for i in range(0, len(points), 512)):
            far = np.sqrt(squared_distances(points[part], at))
            known = np.where(plain, far, np.inf)
            if search.skip_same:
                same = left["qid"].to_numpy()[part, None] == np.array([p["rid"] for p in pivots])
                known = np.where(same, np.inf, known)
            k = search.k
            within = np.partition(known, k - 1, axis=1)[:, k - 1] if k <= len(at) else np.full(len(far), np.inf)
            home[part], bound[part] = place[far.argmin(axis=1)], within
            mark = np.zeros((len(far), CELLS), bool)
            mark[:, cells["cell"]] = needed(far, within, cells)
            needs[part] = np.packbits(mark, axis=1, bitorder="little")
        marks = needs.view("<i8")
        offsets = np.arange(0, marks.size + 1, WORDS, dtype=np.int32)
        return told(rows, home, bound, pa.ListArray.from_arrays(offsets, pa.array(marks.ravel(), pa.int64())))

    return ask


def _along(at: np.ndarray) -> np.ndarray:
    """Pivots in an order in which near ones follow each other: each time the nearest one not yet taken."""
    left, order = np.ones(len(at), bool), [0]
    for _ in range(len(at) - 1):
        left[order[-1]] = False
        far = squared_distances(at[order[-1:]], at)[0]
        order.append(int(np.where(left, far, np.inf).argmin()) if np.isfinite(far[left]).any() else int(left.argmax()))
    return np.array(order)


def _pair_distances(q: np.ndarray, r: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """:func:`squared_distances` of the pairs ``i, j``, the same number for number."""
    if 4 * len(i) > len(q) * len(r):
        return squared_distances(q, r)[i, j]
    total = np.zeros(len(i))
    for a, b in zip(q.T, r.T, strict=True):
        step = a[i] - b[j]
        total += step * step
    return total


class _Block:
    """A block of queries and what they have found so far in the references that streamed past."""

    def __init__(self, search: Search) -> None:
        self.search, self.parts, self.rows = search, [], None

    def _open(self) -> None:
        self.rows = pa.concat_tables(self.parts)
        self.parts = []
        self.x = list_matrix(self.rows["vec"])
        middle = self.x.mean(axis=0)
        self.middle = np.where(np.isfinite(middle), middle, 0.0)
        self.norm, self.short = self._shortened(self.x)
        self.bound = self.rows["within"].to_numpy() ** 2 * (1 + 1e-9)  # squared; rounding of the root
        self.needs = list_matrix(self.rows["needs"])
        n, k = len(self.x), self.search.k
        self.d2, self.rid = np.full((n, k), np.inf), np.full((n, k), np.iinfo(np.int64).max)
        self.aux, self.hit = np.full((n, k), np.nan), np.zeros(n, bool)
        self.own = self.rows["qid"].to_numpy() if self.search.skip_same else None
        self.rows = self.rows.drop_columns(["vec", "within", "needs"])

    def _shortened(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared norms around the middle, and rows in single precision with their norm and a one."""
        with np.errstate(over="ignore", invalid="ignore"):
            x = x - self.middle
            norm = (x * x).sum(axis=1)
            return norm, np.column_stack([x, norm, np.ones(len(x))]).astype(np.float32)

    def meet(self, refs: pa.Table) -> None:
        """References in the order of their cells."""
        if self.rows is None:
            self._open()
        at, r = refs["at"].to_numpy(), list_matrix(refs["vec"])
        rid, aux = refs["rid"].to_numpy(), refs["aux"].to_numpy()
        starts = np.flatnonzero(np.diff(at, prepend=-1))
        for start, end in zip(starts, [*starts[1:], len(at)], strict=True):
            cell = int(at[start])
            asking = np.flatnonzero((self.needs[:, cell // 64] >> (cell % 64)) & 1)
            for few in (slice(i, min(i + 2048, end)) for i in range(start, end, 2048)):
                self._meet_cell(cell >= MOST_PIVOTS, asking, r[few], rid[few], aux[few])

    def _meet_cell(self, balls: bool, asking: np.ndarray, r: np.ndarray, rid: np.ndarray, aux: np.ndarray) -> None:
        """A product of matrices in single precision, around the middle of the queries, tells which pairs
        may matter; those are measured exactly."""
        norm, short = self._shortened(r)
        short[:, -2:] = short[:, :-3:-1]
        turned, longest = (short * np.float32([*[-2] * r.shape[1], 1, 1])).T, np.sqrt(norm.max())
        radius = np.where(aux > 0, aux, 0.0)
        for i in range(0, len(asking), 512):
            of = asking[i : i + 512]
            if balls:
                of = of[~self.hit[of]]
            x = self.x[of]
            # more than the rounding of the numbers, the product and the comparison
            slack = 2.5e-7 * (len(r.T) + 8) * (np.sqrt(self.norm[of]) + longest) ** 2 + 1e-30
            if (slack < 1e30).all():
                reach = radius * radius * (1 + 1e-9) if balls else self.bound[of][:, None]
                with np.errstate(over="ignore"):
                    reach = (reach + slack[:, None]).astype(np.float32)
                close = self.short[of] @ turned <= reach
            else:
                about = squared_distances(x, r)
                close = about <= (radius * radius * (1 + 1e-9) if balls else self.bound[of][:, None])
            row, col = np.divmod(np.flatnonzero(close), len(r))
            if not len(row):
                continue
            d2 = _pair_distances(x, r, row, col)
            if balls:
                self.hit[of[row[np.sqrt(d2) < aux[col]]]] = True
                continue
            good = d2 <= self.bound[of[row]]
            if self.own is not None:
                good &= self.own[of[row]] != rid[col]
            row, col = row[good], col[good]
            self._keep(of[row], d2[good], rid[col], aux[col])

    def _keep(self, row: np.ndarray, d2: np.ndarray, rid: np.ndarray, aux: np.ndarray) -> None:
        """The k nearest of what was known and what is new (ties: smaller ``rid``)."""
        k, met = self.search.k, np.unique(row)
        if not len(met):
            return
        row = np.concatenate([np.repeat(met, k), row])
        d2 = np.concatenate([self.d2[met].ravel(), d2])
        rid = np.concatenate([self.rid[met].ravel(), rid])
        aux = np.concatenate([self.aux[met].ravel(), aux])
        order = np.lexsort((rid, d2, row))
        first = np.searchsorted(row[order], met)
        best = order[first[:, None] + np.arange(k)]
        self.d2[met], self.rid[met], self.aux[met] = d2[best], rid[best], aux[best]
        self.bound[met] = np.minimum(self.bound[met], self.d2[met, -1])

    def found(self, names: list[str], keys: list[str]) -> pa.Table | None:
        if self.rows is None:
            return None  # queries without references
        rows = self.rows.select([*keys, "qid"])
        if names == ["near", "hit"]:
            near = np.sqrt(self.d2[:, 0])
            values = {"near": pa.array(near, mask=~np.isfinite(near)), "hit": pa.array(self.hit)}
        else:
            query, nth = np.nonzero(np.isfinite(self.d2))
            rows, aux = rows.take(pa.array(query)), self.aux[query, nth]
            values = {
                "rid": pa.array(self.rid[query, nth]), "aux": pa.array(aux, mask=np.isnan(aux)),
                "dist": pa.array(np.sqrt(self.d2[query, nth])),
            }
        for name in names:
            rows = rows.append_column(name, values[name])
        return rows


def _stream(keys: list[str], search: Search, names: list[str]):
    """Rows ordered by block, queries first, references by cell: a block is held, references are not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block = None, None

        def done():
            rows = block.found(names, keys) if block is not None else None
            return rows.to_batches(max_chunksize=10_000) if rows is not None else []

        for batch in batches:
            if not len(batch):
                continue
            table = pa.Table.from_batches([batch])
            change = np.diff(table["is_query"].to_numpy(zero_copy_only=False).astype(np.int8), prepend=-1) != 0
            for c in (*keys, "qb"):
                code = pc.fill_null(batch.column(c).dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
                change |= np.diff(code, prepend=-2) != 0
            starts = np.flatnonzero(change).tolist()
            for start, end in zip(starts, [*starts[1:], len(batch)], strict=True):
                key = tuple(batch.column(c)[start].as_py() for c in (*keys, "qb"))
                if block is None or key != now:
                    yield from done()
                    now, block = key, _Block(search)
                part = table.slice(start, end - start)
                if part["is_query"][0].as_py():
                    block.parts.append(part.select([*keys, "qid", "vec", "within", "needs"]))
                elif block.parts or block.rows is not None:
                    block.meet(part)
        yield from done()

    return run


def _single(max_queries: int | None, max_refs: int | None) -> bool:
    return None not in (max_queries, max_refs) and max(max_queries, max_refs) <= BLOCK


def nearest(
    queries: DataFrame,
    refs: DataFrame,
    keys: Sequence[str] = INSTANCE,
    max_queries: int | None = None,
    max_refs: int | None = None,
    skip_same: bool = False,
) -> DataFrame:
    """``near``: distance to the nearest reference without a radius; ``hit``: whether a reference
    with a radius (``aux``) is closer than it. ``skip_same`` ignores a reference whose ``rid``
    equals ``qid``. The bounds on rows per instance, where known, avoid a counting pass."""

    def kernel(left, q, right, r):
        radius = right["aux"].to_numpy()
        ball = ~np.isnan(radius)
        rid = right["rid"].to_numpy()
        near = np.full(len(q), np.nan)
        hit = np.zeros(len(q), dtype=bool)
        for part in _slices(len(q), len(r)):
            d2 = squared_distances(q[part], r)
            if ball.any():
                hit[part] = (np.sqrt(d2[:, ball]) < radius[ball]).any(axis=1)
            if not ball.all():
                plain = d2[:, ~ball]
                if skip_same:
                    own = left["qid"].to_numpy()[part, None] == rid[None, ~ball]
                    plain = np.where(own, np.inf, plain)
                near[part] = np.sqrt(plain.min(axis=1))
        near = pa.array(near, mask=~np.isfinite(near))
        return {"near": near, "hit": pa.array(hit)}

    columns = [("near", T.DoubleType(), pa.float64()), ("hit", T.BooleanType(), pa.bool_())]
    one_block = _single(max_queries, max_refs)
    search = Search(1, balls=True, skip_same=skip_same)
    met = _meet(queries, refs, keys, columns, kernel, one_block, search)
    if one_block:
        return met
    return met.groupBy(*keys, "qid").agg(F.min("near").alias("near"), F.max("hit").alias("hit"))


def k_nearest(
    queries: DataFrame,
    refs: DataFrame,
    k: int,
    keys: Sequence[str] = INSTANCE,
    max_queries: int | None = None,
    max_refs: int | None = None,
) -> DataFrame:
    """The k nearest references per query: ``rid, aux, dist, rank`` (ties by ``rid``)."""

    def kernel(left, q, right, r):
        rid = right["rid"].to_numpy()
        take = min(k, len(r))
        found_q, found_r, found_d = [], [], []
        for part in _slices(len(q), len(r)):
            d2 = squared_distances(q[part], r)
            rows = np.arange(len(d2))[:, None]
            close = np.argpartition(d2, take - 1, axis=1)[:, :take]
            edge = d2[rows, close].max(axis=1)
            for row in np.flatnonzero((d2 <= edge[:, None]).sum(axis=1) > take):
                tied = np.flatnonzero(d2[row] <= edge[row])  # the smallest rid wins at the edge
                close[row] = tied[np.lexsort((rid[tied], d2[row, tied]))][:take]
            found_q.append(np.repeat(np.arange(part.start, part.start + len(d2)), take))
            found_r.append(close.ravel())
            found_d.append(np.sqrt(d2[rows, close]).ravel())
        at = np.concatenate(found_r)
        return {
            "_query": np.concatenate(found_q),
            "rid": pa.array(rid[at]),
            "aux": right["aux"].combine_chunks().take(pa.array(at)),
            "dist": pa.array(np.concatenate(found_d)),
        }

    columns = [
        ("rid", T.LongType(), pa.int64()),
        ("aux", T.DoubleType(), pa.float64()),
        ("dist", T.DoubleType(), pa.float64()),
    ]
    met = _meet(queries, refs, keys, columns, kernel, _single(max_queries, max_refs), Search(k))
    order = Window.partitionBy(*keys, "qid").orderBy("dist", "rid")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def distinct_points(points: DataFrame, keys: Sequence[str] = INSTANCE) -> DataFrame:
    """Equal vectors once: smallest ``rid`` and number of copies ``n``. Copies are counted before
    the shuffle, so a vector that makes up much of the data costs one row per task."""
    return points.groupBy(*keys, "vec").agg(
        F.min("rid").alias("rid"), F.count(F.lit(1)).alias("n")
    )


def first_copies(points: DataFrame, k: int, keys: Sequence[str] = INSTANCE) -> DataFrame:
    """The k copies of every vector with the smallest ``rid``: no other copy can be among the k
    nearest of any query, because ties are broken by ``rid``."""
    order = Window.partitionBy(*keys, "vec").orderBy("rid")
    return (
        points.withColumn("copy", F.row_number().over(order)).where(F.col("copy") <= k).drop("copy")
    )
