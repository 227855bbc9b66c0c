"""Plain SQL for the registered queries, written for DuckDB on the same tables.

The SQL follows the definitions, not the Spark plans: full reindex joins, all pairs, row-by-row
window functions, a recursive query for the cluster iterations. Named parts are put together with
the parts they use.
"""

from __future__ import annotations

import re

from vigilseries.config import DAY
from vigilseries.operators import forest
from vigilseries.plans.tables import CONFIG, DAILY, HOUR, METRICS, NOW

C = CONFIG
LO, MID = NOW - C.score_seconds - C.train_seconds, NOW - C.score_seconds
KEY = "application, instance"
SER = "application, instance, metric"
DIM = C.top_n * C.nsa_shape.width
PCT = C.self_percentage


# Seven decimals: exact ties of the rounding would need gaps of 64 steps in two-decimal data.
def r7(x: str) -> str:
    return f"CASE WHEN round({x}, 7) = 0 THEN 0.0 ELSE round({x}, 7) END"


def moment(second: int) -> str:
    return f"make_timestamp({second * 1_000_000})"


def big(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


def eq(a: str, b: str, cols: str) -> str:
    return " AND ".join(f"{a}.{c} = {b}.{c}" for c in cols.split(", "))


def uniform(*parts: str) -> str:
    text = " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"(CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT) / 4294967296.0)"


PARTS: dict[str, str] = {}


def part(name: str, sql: str) -> None:
    PARTS[name] = sql


def query(final: str) -> str:
    """Put the used parts in front of the final select."""
    needed: list[str] = []

    def visit(sql: str, own: str = "") -> None:
        for name in PARTS:
            if name != own and name not in needed and re.search(rf"\b{name}\b", sql):
                visit(PARTS[name], name)
                if name not in needed:
                    needed.append(name)

    visit(final)
    if not needed:
        return final
    ctes = ",\n".join(f"{head(n)} AS ({PARTS[n]})" for n in needed)
    return f"WITH RECURSIVE {ctes}\n{final}"


RECURSIVE_HEADS = {"x_lloyd": "x_lloyd(it, application, instance, metric, c0, c1)"}


def head(name: str) -> str:
    return RECURSIVE_HEADS.get(name, name)


# --- points -----------------------------------------------------------------------------------

K = "CAST(json_extract(props, '$.k') AS BIGINT)"
SECONDS = "(epoch_us({0}) // 1000000)"

part(
    "x_points",
    f"""SELECT 'shop_' || CAST(user_id % 2 AS VARCHAR) AS application,
  'instance_' || CAST((user_id // 2) % 2 AS VARCHAR) AS instance,
  CASE WHEN event_type = 'signup' THEN 'sys_signup' ELSE 'adt_' || event_type END AS measurement,
  CASE WHEN {K} % 2 = 0 THEN 'eth0, in' ELSE 'eth0,out' END AS destination_key,
  CASE WHEN {K} % 5 = 0 THEN 'raw' ELSE 'value' END AS field,
  {SECONDS.format('ts')} AS sec, ts, value FROM events""",
)
ENCODED = """CASE WHEN contains(destination_key, ', ') THEN replace(destination_key, ', ', '---')
  WHEN contains(destination_key, ',') THEN replace(destination_key, ',', '--') ELSE destination_key END"""
part(
    "x_series",
    f"""SELECT application, instance, measurement, {ENCODED} AS destination,
  measurement || '_' || {ENCODED} AS metric, sec, epoch_us(ts) AS us, value
  FROM x_points WHERE measurement LIKE 'adt\\_%' ESCAPE '\\'""",
)
part("x_train", f"SELECT * FROM x_series WHERE sec >= {LO} AND sec < {MID}")
part("x_score", f"SELECT * FROM x_series WHERE sec >= {MID} AND sec < {NOW}")
part(
    "x_gate",
    f"""SELECT {SER}, measurement, destination, count(*) AS records FROM x_train
  GROUP BY ALL HAVING count(*) > {C.min_records}""",
)
part(
    "x_metrics",
    f"""SELECT {SER}, row_number() OVER (PARTITION BY {KEY} ORDER BY measurement, destination) - 1 AS ord
  FROM x_gate""",
)


def alignment(tag: str, source: str) -> None:
    part(
        f"{tag}_mm",
        f"""SELECT {SER}, sec - sec % {C.freq} AS t, avg(value) AS value FROM {source}
  WHERE ({SER}) IN (SELECT ({SER}) FROM x_gate) GROUP BY ALL""",
    )
    part(f"{tag}_bounds", f"SELECT {KEY}, min(t) AS lo, max(t) AS hi FROM {tag}_mm GROUP BY ALL")
    part(
        f"{tag}_spine",
        f"SELECT {KEY}, unnest(generate_series(lo, hi, {C.freq})) AS t FROM {tag}_bounds",
    )
    part(
        f"{tag}_reindex",
        f"""SELECT m.application, m.instance, m.metric, s.t, v.value
  FROM (SELECT DISTINCT {SER} FROM {tag}_mm) m JOIN {tag}_spine s ON {eq('m', 's', KEY)}
  LEFT JOIN {tag}_mm v ON {eq('m', 'v', SER)} AND v.t = s.t""",
    )
    known = "CASE WHEN value IS NOT NULL THEN t END"
    back = f"OVER (PARTITION BY {SER} ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    ahead = f"OVER (PARTITION BY {SER} ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    part(
        f"{tag}_interp",
        f"""SELECT {SER}, t, CASE WHEN pv IS NULL THEN NULL WHEN nv IS NULL OR nt = pt THEN pv
    ELSE pv + (nv - pv) * ((t - pt) / (nt - pt)) END AS value
  FROM (SELECT *, last_value(value IGNORE NULLS) {back} AS pv, last_value({known} IGNORE NULLS) {back} AS pt,
    first_value(value IGNORE NULLS) {ahead} AS nv, first_value({known} IGNORE NULLS) {ahead} AS nt
  FROM {tag}_reindex)""",
    )
    part(f"{tag}_aligned", f"SELECT {SER}, t, coalesce(value, 0.0) AS value FROM {tag}_interp")


alignment("x_tr", "x_train")
alignment("x_sc", "x_score")

# --- selection --------------------------------------------------------------------------------

part(
    "x_profile",
    f"""SELECT {SER}, ord, count(value) AS n, min(value) AS vmin, max(value) AS vmax,
  var_pop(value) AS variance FROM x_tr_aligned JOIN x_metrics USING ({SER}) GROUP BY ALL""",
)
part("x_varying", f"SELECT * FROM x_profile WHERE vmin < vmax AND variance > {C.variance_floor}")
# A lower limit than the default, so that the random series have something to report.
LIMIT_SHOWN = 0.1


def correlation(name: str, limit: float) -> None:
    part(
        f"{name}_pairs",
        f"""SELECT j.application, j.instance, j.metric, i.metric AS blocker, i.ord AS blocker_ord,
    corr(a.value, b.value) AS r
  FROM x_varying i JOIN x_varying j ON {eq('i', 'j', KEY)} AND i.ord < j.ord
  JOIN x_tr_aligned a ON {eq('a', 'i', SER)} JOIN x_tr_aligned b ON {eq('b', 'j', SER)} AND a.t = b.t
  GROUP BY ALL HAVING abs(corr(a.value, b.value)) > {limit}""",
    )
    part(
        name,
        f"""SELECT {SER}, arg_min(blocker, blocker_ord) AS blocker, arg_min(r, blocker_ord) AS r
  FROM {name}_pairs GROUP BY ALL""",
    )


correlation("x_corr_shown", LIMIT_SHOWN)
correlation("x_corr", C.correlation_limit)
part(
    "x_kept",
    f"SELECT * FROM x_varying v WHERE NOT EXISTS (SELECT 1 FROM x_corr c WHERE {eq('c', 'v', SER)})",
)
part(
    "x_crowded",
    f"""SELECT * FROM x_kept WHERE ({KEY}) IN
  (SELECT ({KEY}) FROM x_kept GROUP BY {KEY} HAVING count(*) > {C.top_n})""",
)
CUTS = ", ".join(f"{k / C.importance_bins!r}" for k in range(1, C.importance_bins))
part(
    "x_imp_rows",
    f"""SELECT a.application, a.instance, a.metric, a.t, a.value FROM x_tr_aligned a
  JOIN x_crowded c ON {eq('a', 'c', SER)}""",
)
part(
    "x_binned",
    f"""SELECT {SER}, bin, CAST(count(y) AS DOUBLE) AS c, sum(y) AS s, sum(y * y) AS ss FROM (
  SELECT v.application, v.instance, v.metric, len(list_filter(cuts, lambda x: v.value > x)) AS bin,
    CAST((v.t - lo) / {C.freq} AS DOUBLE) AS y
  FROM x_imp_rows v
  JOIN (SELECT {SER}, quantile_cont(value, [{CUTS}]) AS cuts FROM x_imp_rows GROUP BY ALL) q
    ON {eq('v', 'q', SER)}
  JOIN (SELECT {KEY}, min(t) AS lo FROM x_imp_rows GROUP BY ALL) b ON {eq('v', 'b', KEY)}) GROUP BY ALL""",
)
part(
    "x_importance",
    f"""SELECT {SER}, CASE WHEN total <> 0 THEN raw / total ELSE 0.0 END AS importance FROM (
  SELECT *, sum(raw) OVER (PARTITION BY {KEY}) AS total FROM (
    SELECT {SER}, 1 - sum(ss - s * s / c) / (sum(ss) - sum(s) * sum(s) / sum(c)) AS raw
    FROM x_binned GROUP BY ALL))""",
)
# A forest, one recursive level after the other: sums per bin, best split, children.
part(
    "x_fr_rows",
    f"""SELECT v.application, v.instance, p.pos, v.t, len(list_filter(cuts, lambda x: v.value > x)) AS bin,
    CAST((v.t - lo) / {C.freq} AS DOUBLE) AS y FROM x_imp_rows v
  JOIN (SELECT {SER}, quantile_cont(value, [{CUTS}]) AS cuts FROM x_imp_rows GROUP BY ALL) q ON {eq('v', 'q', SER)}
  JOIN (SELECT {KEY}, min(t) AS lo FROM x_imp_rows GROUP BY ALL) b ON {eq('v', 'b', KEY)}
  JOIN (SELECT {SER}, row_number() OVER (PARTITION BY {KEY} ORDER BY ord) - 1 AS pos FROM x_crowded) p
    ON {eq('v', 'p', SER)}""",
)
part(
    "x_fr_drawn",
    f"""SELECT tree, y, {" + ".join(f"(u >= {x})::INT" for x in forest.DRAWN)} AS n FROM (
  SELECT tree, y, {uniform(str(C.seed), "'tree'", 'tree', 'CAST(y AS BIGINT)')} AS u
  FROM (SELECT DISTINCT y FROM x_fr_rows), range({C.forest_trees}) AS r(tree))""",
)
part(
    "x_fr_node_0",
    f"""SELECT {KEY}, t, tree, n, r.y, 1 AS node FROM (SELECT DISTINCT {KEY}, t, y FROM x_fr_rows) r
  JOIN x_fr_drawn d ON r.y = d.y WHERE n > 0""",
)
for _level in range(C.forest_depth):
    part(
        f"x_fr_split_{_level}",
        f"""SELECT {KEY}, tree, node, best.pos AS pos, best.bin AS bin, best.gain AS gain FROM (
  SELECT {KEY}, tree, node, arg_max({{'pos': pos, 'bin': bin, 'gain': gain}}, ROW(gain, -pos, -bin)) AS best FROM (
    SELECT *, s1 * s1 / c1 + (s - s1) * (s - s1) / (c - c1) - s * s / c AS gain FROM (
      SELECT {KEY}, tree, node, pos, bin, sum(c) OVER u AS c1, sum(s) OVER u AS s1, sum(c) OVER w AS c, sum(s) OVER w AS s
      FROM (SELECT x.application, x.instance, tree, node, pos, bin, CAST(sum(n) AS DOUBLE) AS c, sum(n * x.y) AS s
        FROM x_fr_node_{_level} x JOIN x_fr_rows r ON {eq('x', 'r', KEY + ', t')} GROUP BY ALL)
      WINDOW w AS (PARTITION BY {KEY}, tree, node, pos),
        u AS (PARTITION BY {KEY}, tree, node, pos ORDER BY bin ROWS UNBOUNDED PRECEDING)) WHERE c1 < c)
  GROUP BY ALL) WHERE best.gain > {forest.LEAST_GAIN}""",
    )
    part(
        f"x_fr_node_{_level + 1}",
        f"""SELECT x.application, x.instance, x.t, x.tree, x.n, x.y, 2 * x.node + (r.bin > s.bin)::INT AS node
  FROM x_fr_node_{_level} x JOIN x_fr_split_{_level} s ON {eq('x', 's', KEY + ', tree, node')}
  JOIN x_fr_rows r ON {eq('x', 'r', KEY + ', t')} AND r.pos = s.pos""",
    )
part(
    "x_forest",
    f"""SELECT c.application, c.instance, c.metric, coalesce(share / sum(share) OVER (PARTITION BY c.application, c.instance), 0.0) AS importance
  FROM (SELECT {SER}, row_number() OVER (PARTITION BY {KEY} ORDER BY ord) - 1 AS pos FROM x_crowded) c
  LEFT JOIN (SELECT {KEY}, pos, sum(gain / total) AS share FROM (
    SELECT {KEY}, pos, gain, sum(gain) OVER (PARTITION BY {KEY}, tree) AS total FROM (
      {" UNION ALL ".join(f"SELECT {KEY}, tree, pos, gain FROM x_fr_split_{k}" for k in range(C.forest_depth))}))
    GROUP BY ALL) g ON {eq('c', 'g', KEY + ', pos')}""",
)
part(
    "x_selected",
    f"""SELECT {SER}, rk - 1 AS ord, vmin, vmax, importance FROM (
  SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY k, ord) AS rk FROM (
    SELECT v.application, v.instance, v.metric, v.ord, vmin, vmax, importance,
      CASE WHEN count(*) OVER (PARTITION BY v.application, v.instance) > {C.top_n}
        THEN -importance ELSE 0.0 END AS k
    FROM x_kept v LEFT JOIN x_importance i ON {eq('i', 'v', SER)})) WHERE rk <= {C.top_n}""",
)

# --- features ---------------------------------------------------------------------------------


def features(tag: str) -> None:
    s = C.nsa_shape
    w = f"OVER (PARTITION BY {SER} ORDER BY t)"
    part(
        f"{tag}_scaled",
        f"""SELECT a.application, a.instance, a.metric, s.ord, a.t, (a.value - vmin) / (vmax - vmin) AS value
  FROM {tag}_aligned a JOIN x_selected s ON {eq('a', 's', SER)}""",
    )
    part(
        f"{tag}_diff",
        f"""SELECT {SER}, ord, t, value - lag(value, {s.diffs}) {w} AS diff,
    row_number() {w} AS rn FROM {tag}_scaled""",
    )
    frame = f"OVER (PARTITION BY {SER} ORDER BY t ROWS BETWEEN {s.smooth - 1} PRECEDING AND CURRENT ROW)"
    part(
        f"{tag}_smooth",
        f"""SELECT {SER}, ord, t, rn, CASE WHEN rn >= {s.diffs + s.smooth} THEN avg(diff) {frame} END AS sm
  FROM {tag}_diff""",
    )
    lags = ", ".join(f"abs(lag(sm, {n}) {w}) AS l{n}" for n in range(s.width))
    part(f"{tag}_lags", f"SELECT {SER}, ord, t, rn, {lags} FROM {tag}_smooth")
    part(f"{tag}_feat", f"SELECT * FROM {tag}_lags WHERE rn > {s.lost_rows}")
    part(f"{tag}_warm", f"SELECT * FROM {tag}_lags WHERE rn > {s.warmup_rows}")


features("x_tr")
features("x_sc")
LAGS = ", ".join(f"l{n}" for n in range(C.nsa_shape.width))


def vectors(name: str, rows: str) -> None:
    part(
        name,
        f"SELECT {KEY}, t, flatten(list([{LAGS}] ORDER BY ord)) AS vec FROM {rows} GROUP BY ALL",
    )


vectors("x_vec", "x_tr_feat")
vectors("x_qvec", "x_sc_warm")

# --- negative selection -----------------------------------------------------------------------

part(
    "x_params0",
    f"""SELECT {KEY}, max(len(vec)) AS dim, sqrt(CAST(max(len(vec)) AS DOUBLE)) * {PCT} AS self_radius
  FROM x_vec GROUP BY ALL""",
)
part(
    "x_second",
    f"""SELECT a.application, a.instance, a.t, min(list_distance(a.vec, b.vec)) AS near
  FROM x_vec a JOIN x_vec b ON {eq('a', 'b', KEY)} AND a.t <> b.t GROUP BY ALL""",
)
part(
    "x_threshold",
    f"SELECT {KEY}, quantile_cont(near, {C.nsa_percentile / 100}) AS threshold FROM x_second GROUP BY ALL",
)
part(
    "x_params",
    f"SELECT p.*, h.threshold FROM x_params0 p JOIN x_threshold h ON {eq('p', 'h', KEY)}",
)
# Median-split tree: levels 0..3 of the (at most 15) nodes.
TREE_DEPTH = 6
part(
    "x_tree0",
    f"""SELECT {KEY}, t, vec, 0 AS node,
  CAST(trunc(log2(greatest(1.0, (count(*) OVER (PARTITION BY {KEY}) - 1) / 40)) + 1) AS BIGINT) AS levels
  FROM x_vec""",
)
for _level in range(TREE_DEPTH):
    part(
        f"x_node{_level}",
        f"""SELECT {KEY}, node, count(*) AS size, max(levels) AS levels,
  [{', '.join(f'min(vec[{j}])' for j in range(1, DIM + 1))}] AS low,
  [{', '.join(f'max(vec[{j}])' for j in range(1, DIM + 1))}] AS high
  FROM x_tree{_level} GROUP BY ALL""",
    )
    if _level < TREE_DEPTH - 1:
        spread = "list_transform(list_zip(high, low), lambda p: p[1] - p[2])"
        part(
            f"x_tree{_level + 1}",
            f"""SELECT {KEY}, t, vec, CASE WHEN nth <= size // 2 THEN 2 * node + 1 ELSE 2 * node + 2 END AS node,
  levels FROM (SELECT p.*, size, row_number() OVER (PARTITION BY p.application, p.instance, p.node
    ORDER BY vec[axis], t) AS nth
  FROM x_tree{_level} p JOIN (SELECT {KEY}, node, size, list_position({spread}, list_max({spread})) AS axis
    FROM x_node{_level}) n ON {eq('p', 'n', KEY + ', node')}
  WHERE p.levels > {_level + 1} AND size > 1)""",
        )
part(
    "x_seeds",
    f"SELECT {KEY}, min(node) AS cand, low AS centre FROM ("
    + " UNION ALL ".join(f"SELECT {KEY}, node, low FROM x_node{i}" for i in range(TREE_DEPTH))
    + ") GROUP BY ALL",
)
part(
    "x_units",
    f"""SELECT i, list({uniform(str(C.seed), "'centre'", 'i', 'j')} ORDER BY j) AS unit
  FROM range({C.max_detectors}) a(i), range({DIM}) b(j) GROUP BY ALL""",
)
part(
    "x_random",
    f"""SELECT {KEY}, i + 1000000000 AS cand,
  list_transform(unit[1:dim], lambda u: (1 + 2 * self_radius) * u - self_radius) AS centre
  FROM x_params, x_units""",
)
part(
    "x_cands",
    f"SELECT {KEY}, cand, centre FROM x_seeds UNION ALL SELECT {KEY}, cand, centre FROM x_random",
)
part(
    "x_tested",
    f"""SELECT c.application, c.instance, c.cand, c.centre,
  min(list_distance(c.centre, v.vec)) - any_value(p.self_radius) AS radius
  FROM x_cands c JOIN x_vec v ON {eq('c', 'v', KEY)} JOIN x_params p ON {eq('c', 'p', KEY)}
  GROUP BY ALL""",
)
STEP = f"{2 * PCT} * {uniform(str(C.seed), chr(39) + 'step' + chr(39), 'cand', 'attempt', 'j')} - {PCT}"
part(
    "x_walks",
    f"""SELECT cand, attempt, list(x ORDER BY j) AS shift FROM (
  SELECT cand, attempt, j, sum({STEP}) OVER (PARTITION BY cand, j ORDER BY attempt) AS x
  FROM (SELECT DISTINCT cand FROM x_tested WHERE radius <= 0) c,
    range(1, {C.max_attempts + 1}) a(attempt), range({DIM}) b(j)) GROUP BY ALL""",
)
part(
    "x_moved",
    f"""SELECT {KEY}, cand, attempt,
  list_transform(list_zip(centre, shift), lambda p: p[1] + p[2]) AS centre
  FROM x_tested JOIN x_walks USING (cand) WHERE radius <= 0""",
)
part(
    "x_retested",
    f"""SELECT m.application, m.instance, m.cand, m.attempt, m.centre,
  min(list_distance(m.centre, v.vec)) - any_value(p.self_radius) AS radius
  FROM x_moved m JOIN x_vec v ON {eq('m', 'v', KEY)} JOIN x_params p ON {eq('m', 'p', KEY)}
  GROUP BY ALL""",
)
part(
    "x_later",
    f"""SELECT {KEY}, cand, min(attempt) AS attempt, arg_min(centre, attempt) AS centre,
  arg_min(radius, attempt) AS radius FROM x_retested WHERE radius > 0 GROUP BY ALL""",
)
part(
    "x_detectors",
    f"""SELECT {KEY}, nth - 1 AS det_id, centre, radius FROM (
  SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY cand) AS nth FROM (
    SELECT {KEY}, cand, centre, radius FROM x_tested WHERE radius > 0
    UNION ALL SELECT {KEY}, cand, centre, radius FROM x_later)) WHERE nth <= {C.max_detectors}""",
)
part(
    "x_near",
    f"""SELECT q.application, q.instance, q.t, min(list_distance(q.vec, v.vec)) AS near
  FROM x_qvec q JOIN x_vec v ON {eq('q', 'v', KEY)} GROUP BY ALL""",
)
part(
    "x_hit",
    f"""SELECT q.application, q.instance, q.t, bool_or(list_distance(q.vec, d.centre) < d.radius) AS hit
  FROM x_qvec q JOIN x_detectors d ON {eq('q', 'd', KEY)} GROUP BY ALL""",
)
BEYOND = (
    "sqrt(list_sum(list_transform(q.vec, lambda x: x * x))) > "
    "sqrt(p.dim * (1 + p.self_radius) * (1 + p.self_radius))"
)
part(
    "x_nsa",
    f"""SELECT q.application, q.instance, q.t, near AS distance_score,
  CASE WHEN hit OR ({BEYOND}) OR near >= threshold THEN {C.anomaly_bit_max} ELSE 0 END AS anomaly_bit
  FROM x_qvec q JOIN x_params p ON {eq('q', 'p', KEY)} AND len(q.vec) = p.dim
  JOIN x_near n ON {eq('q', 'n', KEY + ', t')} JOIN x_hit h ON {eq('q', 'h', KEY + ', t')}""",
)

# --- labelled vectors -------------------------------------------------------------------------

part(
    "x_ranges",
    "SELECT list(lo ORDER BY j) AS low, list(hi ORDER BY j) AS high FROM ("
    "SELECT j, min(CAST(embedding[j] AS DOUBLE)) AS lo, max(CAST(embedding[j] AS DOUBLE)) AS hi "
    "FROM embeddings, range(1, 65) a(j) GROUP BY j)",
)
part(
    "x_lab",
    """SELECT 'vectors' AS application, 'all' AS instance, vec_id AS rid, label AS kind,
  CASE WHEN label = 0 THEN 0 ELSE 1 END AS label,
  list_transform(list_zip(CAST(embedding AS DOUBLE[]), low, high), lambda p: (p[1] - p[2]) / (p[3] - p[2])) AS vec
  FROM embeddings, x_ranges""",
)
LAB_RADIUS = f"(sqrt(64.0) * {PCT})"
part(
    "x_lab_near",
    """SELECT q.rid, min(list_distance(q.vec, s.vec)) AS near FROM x_lab q JOIN x_lab s ON s.label = 0
  GROUP BY ALL""",
)
part(
    "x_knn",
    f"""SELECT qid, rid, label, dist, rk FROM (
  SELECT q.rid AS qid, s.rid, s.label, list_distance(q.vec, s.vec) AS dist,
    row_number() OVER (PARTITION BY q.rid ORDER BY list_distance(q.vec, s.vec), s.rid) AS rk
  FROM x_lab q, x_lab s) WHERE rk <= {C.neighbours}""",
)
part(
    "x_vote",
    f"""SELECT qid, NOT (min(dist) < max(dist) AND min(dist) <= {LAB_RADIUS} AND arg_min(label, rk) = 0)
  AND sum(label) >= count(*) - sum(label) AS vote FROM x_knn GROUP BY ALL""",
)
# Detectors of the labelled set: random candidates only.
part(
    "x_lab_units",
    f"""SELECT i, list({uniform(str(C.seed), "'centre'", 'i', 'j')} ORDER BY j) AS unit
  FROM range({C.max_detectors}) a(i), range(64) b(j) GROUP BY ALL""",
)
part(
    "x_lab_tested",
    f"""SELECT c.i, c.centre, min(list_distance(c.centre, s.vec)) - {LAB_RADIUS} AS radius FROM (
  SELECT i, list_transform(unit, lambda u: (1 + 2 * {LAB_RADIUS}) * u - {LAB_RADIUS}) AS centre
  FROM x_lab_units) c JOIN x_lab s ON s.label = 0 GROUP BY ALL""",
)
part("x_lab_det", "SELECT i AS det_id, centre, radius FROM x_lab_tested WHERE radius > 0")
part(
    "x_lab_hit",
    """SELECT q.rid, bool_or(list_distance(q.vec, d.centre) < d.radius) AS hit FROM x_lab q, x_lab_det d
  GROUP BY ALL""",
)
LAB_BEYOND = (
    "sqrt(list_sum(list_transform(q.vec, lambda x: x * x))) > "
    f"sqrt(64 * (1 + {LAB_RADIUS}) * (1 + {LAB_RADIUS}))"
)
part(
    "x_judged",
    f"""SELECT q.rid, q.label, q.vec, h.hit OR ({LAB_BEYOND}) AS anomalous
  FROM x_lab q JOIN x_lab_hit h ON q.rid = h.rid""",
)

# Detectors of the labelled set with seeds and retries, as trained by default.
LAB_DEPTH = 6
SPREAD = "list_transform(list_zip(high, low), lambda p: p[1] - p[2])"
part(
    "x_whole_tree0",
    f"""SELECT {KEY}, rid, vec, 0 AS node,
  CAST(trunc(log2(greatest(1.0, (count(*) OVER () - 1) / 40)) + 1) AS BIGINT) AS levels
  FROM x_lab WHERE label = 0""",
)
for _level in range(LAB_DEPTH):
    part(
        f"x_whole_node{_level}",
        f"""SELECT node, count(*) AS size, [{', '.join(f'min(vec[{j}])' for j in range(1, 65))}] AS low,
  [{', '.join(f'max(vec[{j}])' for j in range(1, 65))}] AS high FROM x_whole_tree{_level} GROUP BY ALL""",
    )
    if _level < LAB_DEPTH - 1:
        part(
            f"x_whole_tree{_level + 1}",
            f"""SELECT {KEY}, rid, vec, CASE WHEN nth <= size // 2 THEN 2 * node + 1 ELSE 2 * node + 2 END AS node,
  levels FROM (SELECT p.*, size, row_number() OVER (PARTITION BY p.node ORDER BY vec[axis], rid) AS nth
  FROM x_whole_tree{_level} p JOIN (SELECT node, size, list_position({SPREAD}, list_max({SPREAD})) AS axis
    FROM x_whole_node{_level}) n ON p.node = n.node
  WHERE p.levels > {_level + 1} AND size > 1)""",
        )
part(
    "x_whole_cands",
    "SELECT min(node) AS cand, low AS centre FROM ("
    + " UNION ALL ".join(f"SELECT node, low FROM x_whole_node{i}" for i in range(LAB_DEPTH))
    + f""") GROUP BY ALL
  UNION ALL SELECT i + 1000000000, list_transform(unit, lambda u: (1 + 2 * {LAB_RADIUS}) * u - {LAB_RADIUS})
  FROM x_lab_units""",
)
part(
    "x_whole_tested",
    f"""SELECT c.cand, c.centre, min(list_distance(c.centre, s.vec)) - {LAB_RADIUS} AS radius
  FROM x_whole_cands c JOIN x_lab s ON s.label = 0 GROUP BY ALL""",
)
part(
    "x_whole_walks",
    f"""SELECT cand, attempt, list(x ORDER BY j) AS shift FROM (
  SELECT cand, attempt, j, sum({STEP}) OVER (PARTITION BY cand, j ORDER BY attempt) AS x
  FROM (SELECT cand FROM x_whole_tested WHERE radius <= 0) c,
    range(1, {C.max_attempts + 1}) a(attempt), range(64) b(j)) GROUP BY ALL""",
)
part(
    "x_whole_moved",
    """SELECT cand, attempt, list_transform(list_zip(centre, shift), lambda p: p[1] + p[2]) AS centre
  FROM x_whole_tested JOIN x_whole_walks USING (cand)""",
)
part(
    "x_whole_retested",
    f"""SELECT m.cand, m.attempt, m.centre, min(list_distance(m.centre, s.vec)) - {LAB_RADIUS} AS radius
  FROM x_whole_moved m JOIN x_lab s ON s.label = 0 GROUP BY ALL""",
)
part(
    "x_whole_det",
    f"""SELECT nth - 1 AS det_id, centre, radius FROM (
  SELECT *, row_number() OVER (ORDER BY cand) AS nth FROM (
    SELECT cand, centre, radius FROM x_whole_tested WHERE radius > 0
    UNION ALL SELECT cand, arg_min(centre, attempt), arg_min(radius, attempt) FROM x_whole_retested
      WHERE radius > 0 GROUP BY cand)) WHERE nth <= {C.max_detectors}""",
)
part(
    "x_whole_hit",
    """SELECT q.rid, bool_or(list_distance(q.vec, d.centre) < d.radius) AS hit FROM x_lab q, x_whole_det d
  GROUP BY ALL""",
)
part(
    "x_whole_judged",
    f"""SELECT q.rid, q.label, q.vec, h.hit OR ({LAB_BEYOND}) AS anomalous
  FROM x_lab q JOIN x_whole_hit h ON q.rid = h.rid""",
)
# Centroids of the nodes of the training tree.
part(
    "x_centroids",
    f"SELECT {KEY}, min(node) AS cand, mean AS centre FROM ("
    + " UNION ALL ".join(
        f"SELECT {KEY}, node, [{', '.join(f'avg(vec[{j}])' for j in range(1, DIM + 1))}] AS mean "
        f"FROM x_tree{i} GROUP BY {KEY}, node"
        for i in range(TREE_DEPTH)
    )
    + ") GROUP BY ALL",
)

# --- two clusters -----------------------------------------------------------------------------

NORM = "l0 * l0 + l1 * l1 + l2 * l2 + l3 * l3"


def d2(c: str) -> str:
    return " + ".join(f"(l{n} - {c}[{n + 1}]) * (l{n} - {c}[{n + 1}])" for n in range(4))


def mean_of(condition: str) -> str:
    return "[" + ", ".join(f"avg(CASE WHEN {condition} THEN l{n} END)" for n in range(4)) + "]"


part("x_first", f"SELECT {SER}, arg_min([{LAGS}], ROW({NORM}, t)) AS c0 FROM x_tr_feat GROUP BY ALL")
part(
    "x_start",
    f"""SELECT f.application, f.instance, f.metric, any_value(c0) AS c0,
  arg_max([{LAGS}], ROW({d2('c0')}, -t)) AS c1
  FROM x_tr_feat f JOIN x_first s ON {eq('f', 's', SER)} GROUP BY ALL""",
)
NEAR0 = f"({d2('c0')}) <= ({d2('c1')})"
part(
    "x_lloyd",
    f"""SELECT 0, {SER}, c0, c1 FROM x_start UNION ALL
  SELECT it + 1, {SER}, CASE WHEN n0 > 0 THEN m0 ELSE c0 END, CASE WHEN n1 > 0 THEN m1 ELSE c1 END FROM (
    SELECT max(c.it) AS it, f.application, f.instance, f.metric, any_value(c0) AS c0, any_value(c1) AS c1,
      count(CASE WHEN {NEAR0} THEN 1 END) AS n0, count(CASE WHEN NOT ({NEAR0}) THEN 1 END) AS n1,
      {mean_of(NEAR0)} AS m0, {mean_of(f'NOT ({NEAR0})')} AS m1
    FROM x_lloyd c JOIN x_tr_feat f ON {eq('f', 'c', SER)}
    WHERE c.it < {C.kmeans_iterations} GROUP BY f.application, f.instance, f.metric)""",
)
part("x_centres", f"SELECT {SER}, c0, c1 FROM x_lloyd WHERE it = {C.kmeans_iterations}")
RAW = f"sqrt({d2('c0')}) + sqrt({d2('c1')})"
part(
    "x_raw",
    f"""SELECT f.application, f.instance, f.metric, f.t, {RAW} AS raw
  FROM x_tr_feat f JOIN x_centres c ON {eq('f', 'c', SER)}""",
)
part(
    "x_limits",
    f"""SELECT {SER}, min(raw) AS raw_min, max(raw) AS raw_max, CASE WHEN max(raw) > min(raw) THEN
  (quantile_cont(raw, {C.kmeans_percentile / 100}) - min(raw)) / (max(raw) - min(raw)) ELSE 1.0 END AS threshold
  FROM x_raw GROUP BY ALL""",
)
part(
    "x_kraw",
    f"""SELECT f.application, f.instance, f.metric, f.t, {RAW} AS raw, raw_min, raw_max, threshold
  FROM x_sc_warm f JOIN x_centres c ON {eq('f', 'c', SER)} JOIN x_limits m ON {eq('f', 'm', SER)}""",
)
part(
    "x_kscore",
    f"""SELECT {SER}, t, score AS anomaly_score, CASE WHEN score >= threshold THEN {C.anomaly_bit_max} ELSE 0 END
  AS anomaly_bit FROM (SELECT *, CASE WHEN raw_max = raw_min THEN 0.0
    ELSE (raw - raw_min) / (raw_max - raw_min) END AS score FROM x_kraw)""",
)

# --- detections -------------------------------------------------------------------------------


def rate(source: str, keys: str) -> str:
    return f"""SELECT {keys}, sum(anomaly_bit) * 100.0 / (count(*) * {C.anomaly_bit_max}) AS rate,
  min(t) AS window_start, max(t) AS window_end FROM {source} GROUP BY ALL"""


part("x_nsa_rate", rate("x_nsa", KEY))
part("x_km_rate", rate("x_kscore", SER))


def slot(now: str, margin: str, h: int) -> str:
    first = f"(({now} // {h} + 1) * {h})"
    late = f"({now} + {margin} - {first})"
    return f"{first} + (CASE WHEN {late} > 0 THEN 1 + {late} // {h} ELSE 1 END) * {h}"


SLOT = slot(str(NOW), str(C.safety_margin), C.horizon)
part(
    "x_detections",
    f"""SELECT '_predicted_nsa_' || d.instance AS measurement, d.application AS application_name,
  d.instance AS node, 'nsa' AS method, names AS metrics, '3' AS level, rate AS metricValue,
  rate >= {C.nsa_rate_limit} AS anomaly, {SLOT} AS predictionTime, window_start, window_end
  FROM x_nsa_rate d JOIN (SELECT {KEY}, string_agg(metric, ',' ORDER BY ord) AS names FROM x_selected
    GROUP BY ALL) s ON {eq('d', 's', KEY)}
  UNION ALL SELECT '_predicted_kmeans_' || instance || '_' || metric, application, instance, 'kmeans', metric, '3',
  rate, rate >= {C.kmeans_rate_limit}, {SLOT}, window_start, window_end FROM x_km_rate""",
)

# --- control and stored detections --------------------------------------------------------------

part(
    "x_control",
    f"""SELECT 'shop_' || CAST(user_id % 3 AS VARCHAR) AS subject,
  CASE WHEN {K} % 7 <> 0 THEN 'shop_' || CAST(user_id % 3 AS VARCHAR) END AS application,
  CASE WHEN {K} % 5 <> 0 THEN {K} END AS version, 'adt_' || event_type AS metric,
  {SECONDS.format('ts')} AS received_at, ts, event_id FROM events WHERE event_type <> 'error'""",
)
part(
    "x_registry",
    """SELECT application, arg_max(coalesce(version, 0), ROW(ts, event_id)) AS version FROM x_control
  WHERE application IS NOT NULL GROUP BY ALL""",
)
HOURS = f"({SECONDS.format('ts')} // {HOUR} * {HOUR})"
part(
    "x_stored",
    f"""SELECT {HOURS} AS time,
  CASE WHEN event_type = 'error' THEN '_predicted_nsa_instance_' || CAST(user_id % 4 AS VARCHAR)
    ELSE '_predicted_kmeans_instance_' || CAST(user_id % 4 AS VARCHAR) || '_adt_' || event_type END AS measurement,
  'shop_' || CAST(user_id % 2 AS VARCHAR) AS application_name,
  'instance_' || CAST(user_id % 4 AS VARCHAR) AS node,
  CASE WHEN event_type = 'error' THEN 'nsa' ELSE 'kmeans' END AS method,
  CASE WHEN event_type = 'error' THEN 'adt_click,adt_view' ELSE 'adt_' || event_type END AS metrics,
  '3' AS level, least(value, 100.0) AS metricValue, value >= 20 AS anomaly, {HOURS} + {HOUR} AS predictionTime,
  {HOURS} - {120 * HOUR} AS window_start, {HOURS} AS window_end, event_id, event_id AS written FROM events""",
)
part(
    "x_current",
    """SELECT * FROM x_stored QUALIFY row_number() OVER (PARTITION BY time, measurement, application_name,
  node, method, metrics, level ORDER BY written DESC) = 1""",
)
part(
    "x_daily",
    f"""SELECT 'lineitem' AS application, l_returnflag || l_linestatus AS instance,
  {SECONDS.format('l_shipdate')} // {DAY} * {DAY} AS t, avg(l_quantity) AS quantity,
  avg(l_extendedprice) AS price, avg(l_discount) AS discount, avg(l_tax) AS tax FROM lineitem GROUP BY ALL""",
)


def iqr(prefix: str, bounds: dict[str, tuple[float | None, float | None]]) -> str:
    previous = "x_daily"
    for name in DAILY:
        low, high = bounds.get(name, (None, None))
        lower = "q[1] - 1.5 * (q[2] - q[1])"
        upper = "q[2] + 1.5 * (q[2] - q[1])"
        if low is not None:
            lower = f"greatest({lower}, {low})"
        if high is not None:
            upper = f"least({upper}, {high})"
        part(
            f"{prefix}_{name}",
            f"""SELECT d.* FROM {previous} d JOIN (SELECT {KEY}, quantile_cont({name}, [0.1, 0.9]) AS q
  FROM {previous} GROUP BY ALL) f ON {eq('d', 'f', KEY)}
  WHERE q[1] IS NULL OR q[2] = q[1] OR d.{name} BETWEEN {lower} AND {upper}""",
        )
        previous = f"{prefix}_{name}"
    not_null = " AND ".join(f"{c} IS NOT NULL" for c in DAILY)
    return f"SELECT {KEY}, t, {', '.join(f'{r7(c)} AS {c}' for c in DAILY)} FROM {previous} WHERE {not_null}"


IQR_BOUNDS = {"quantity": (20.0, 30.0), "discount": (0.02, None)}
IQR_PLAIN_SQL = iqr("x_iqr", {})
IQR_BOUND_SQL = iqr("x_iqb", IQR_BOUNDS)
PIVOTED = ", ".join(f"{r7(f'max(CASE WHEN metric = {chr(39)}{m}{chr(39)} THEN value END)')} AS \"{m}\"" for m in METRICS)
