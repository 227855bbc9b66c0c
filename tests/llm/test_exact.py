import hashlib
import re
from collections import defaultdict

from tests.llm import edge
from vigilseries.llm import exact


def brute(pairs):
    groups = defaultdict(list)
    for i, t in pairs:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    out = []
    for norm, ids in groups.items():
        known = [i for i in ids if i is not None]
        order = sorted(known) + [None] * (len(ids) - len(known))
        sha = hashlib.sha256(norm.encode()).hexdigest()
        keep = min(known, default=None)
        out += [(i, keep, len(ids), k == 0, sha) for k, i in enumerate(order)]
    return out


def test_edges(spark):
    edge.same(exact.classes(edge.rows(spark)).collect(), brute(edge.TEXTS))


def test_empty(spark):
    assert exact.classes(edge.empty(spark)).count() == 0
    assert exact.deduplicated(edge.empty(spark)).columns == edge.empty(spark).columns


def test_group_over_many_partitions(spark):
    pairs = [(i, "copy of a text") for i in range(3000)] + [(i, f"text {i}") for i in range(3000, 3500)]
    frame = edge.rows(spark, pairs).repartition(16)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        edge.same(exact.classes(frame).collect(), brute(pairs))
        kept = exact.deduplicated(frame)
        assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == [0, *range(3000, 3500)]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_kept_rows_are_whole(spark):
    frame = edge.rows(spark)
    kept = exact.deduplicated(frame)
    assert kept.schema.names == frame.schema.names
    wanted = [r for r in brute(edge.TEXTS) if r[3]]
    edge.same([(r.doc_id,) for r in kept.select("doc_id").collect()], [(r[0],) for r in wanted])
    assert kept.exceptAll(frame).count() == 0
