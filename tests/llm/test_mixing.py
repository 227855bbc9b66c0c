from collections import defaultdict

import numpy as np
import pytest

from tests.llm import edge
from vigilseries.llm import mixing


def brute_targets(sizes):
    """Share by weight, cap, share the excess again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(order)}
    left, free, target = float(sum(sizes.values())), set(order), {}
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > 3 * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / total for s in free}
        for s in over:
            target[s] = 3.0 * sizes[s]
        left -= sum(target[s] for s in over)
        free -= over
    return target


def check(rows):
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    sizes = {s: sum(r["size"] for r in found) for s, found in by.items()}
    targets = brute_targets(sizes)
    for s, found in by.items():
        assert {r.source_size for r in found} == {sizes[s]}
        assert found[0].target == edge.approx(targets[s])
        assert all(0 <= r.taken <= 3 * r["size"] for r in found)
        assert abs(sum(r.taken for r in found) - targets[s]) <= max(r["size"] for r in found)


def test_edges(spark):
    found = mixing.mixed(edge.rows(spark)).collect()
    assert len(found) == len(edge.TEXTS)
    check(found)


def test_targets_near_and_reruns_agree(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    first = mixing.mixed(docs).collect()
    check(first)
    edge.same(first, mixing.mixed(docs.repartition(7)).collect())


def test_small_groups_and_many_levels(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP_ROWS", 20)
    monkeypatch.setattr(mixing, "FAN_IN", 3)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    check(mixing.mixed(docs).collect())


def test_capped_sources(spark):
    texts = [(i, "w " * (1 if i % 4 == 0 else 50)) for i in range(400)]
    check(mixing.mixed(edge.rows(spark, texts)).collect())


def test_resampled_repeats_rows(spark):
    docs = edge.rows(spark, [(i, "some words " * (i % 9 + 1)) for i in range(200)])
    copies = {r.id: r.copies for r in mixing.mixed(docs).collect()}
    mix = mixing.resampled(docs)
    assert mix.columns == docs.columns
    found = {r.doc_id: r["count"] for r in mix.groupBy("doc_id").count().collect()}
    assert found == {i: n for i, n in copies.items() if n}
    assert mixing.resampled(edge.empty(spark)).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_pivotal_keeps_words_and_means(seed):
    rng = np.random.default_rng(seed)
    size, share = rng.integers(1, 50, 300).astype(float), rng.random(300)
    rounded, left = mixing.pivotal(size, share, rng.integers(0, 1 << 40, 300), seed)
    assert (size * rounded).sum() == edge.approx((size * share).sum())
    assert set(np.delete(rounded, left) if left >= 0 else rounded) <= {0.0, 1.0}


def test_pivotal_is_fair():
    size, share = np.array([5.0, 3.0, 8.0]), np.array([0.5, 0.25, 0.75])
    rng = np.random.default_rng(3)
    means = np.mean([mixing.pivotal(size, share, rng.integers(0, 1 << 60, 3), 1)[0] for _ in range(20_000)], axis=0)
    assert np.allclose(means, share, atol=0.015)
