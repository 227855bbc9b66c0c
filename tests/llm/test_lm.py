import math
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm import edge
from vigilseries.llm import lm


def brute(pairs):
    docs = [
        (i, zlib.crc32(str(i).encode()) % lm.FOLDS == 0 if i is not None else True, [*(t or "").encode().lower().split(), b""])
        for i, t in pairs
    ]
    one, two, before = Counter(), Counter(), Counter()
    for _, held, words in docs:
        if not held:
            one.update(words)
            history = [b"\n", *words[:-1]]
            two.update(zip(history, words, strict=True))
            before.update(history)
    total, kinds = sum(one.values()), len(one)

    if not total:
        return [(i, held, len(words), 0, 0, 0.0, 0.0) for i, held, words in docs]

    def factors(counts):
        spectrum = Counter(counts.values())
        return lm.Discounts.of([spectrum[r] for r in range(1, lm.MOST + 2)]).factor

    d1, d2 = factors(one), factors(two)

    def cut(d, c):
        return (d[c] if c <= lm.MOST else 1.0) * c

    left = total - sum(cut(d1, c) for c in one.values())
    unknown, whole = (left / total, total) if left > 1e-9 else (1 / (total + 1), total + 1)

    def single(w):
        return cut(d1, one[w]) / whole if one[w] else unknown

    mass, lower = Counter(), Counter()
    for (h, w), c in two.items():
        mass[h] += cut(d2, c)
        lower[h] += single(w)

    def chance(h, w):
        if not before[h]:
            return single(w)
        left, scale = 1 - mass[h] / before[h], 1.0
        if left <= 1e-12:
            left, scale = 1 / (before[h] + 1), before[h] / (before[h] + 1)
        if two[h, w]:
            return scale * cut(d2, two[h, w]) / before[h]
        return left / (1 - lower[h]) * single(w)

    for h in list(before)[:200]:  # exactly normalised
        assert sum(chance(h, w) for w in one) + chance(h, b"\n\n") == edge.approx(1)
    out = []
    for i, held, words in docs:
        score = sum(math.log10(chance(h, w)) for h, w in zip([b"\n", *words[:-1]], words, strict=True))
        base = sum(math.log10((one[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in words)
        out.append((i, held, len(words), sum(one[w] > 0 for w in words), total, base, score))
    return out


def check(spark, pairs):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    got = sorted(map(tuple, lm.scored(edge.rows(spark, pairs)).collect()), key=key)
    wanted = sorted(brute(pairs), key=key)
    assert len(got) == len(wanted)
    for g, w in zip(got, wanted, strict=True):
        assert g[:5] == w[:5] and g[5:] == edge.approx(w[5:], rel=1e-9)


def test_edges(spark):
    check(spark, edge.TEXTS)


def test_empty_and_nothing_to_learn_from(spark):
    assert lm.scored(edge.empty(spark)).count() == 0
    row = lm.scored(edge.rows(spark, [(None, "a b")])).first()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens, row.score) == (True, 3, 0, 0, 0.0)


def test_given_documents_in_small_batches(spark, monkeypatch):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    check(spark, [tuple(r) for r in rows])


def test_frequent_history_is_dealt_over_partitions(spark):
    check(spark, [(i, " ".join(f"hot w{(i * k) % 97}" for k in range(40))) for i in range(60)])


def test_history_without_discount(spark):
    check(spark, [(i, "always the same words") for i in range(50)] + [(1000, "always new")])


def test_better_than_base_on_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = lm.scored(docs).where("held_out").selectExpr("sum(score) as s", "sum(base_score) as b").first()
    assert held.s > held.b


def test_bad_counts_of_counts_fall_back():
    factor = lm.Discounts.of([1, 0, 0, 0, 0, 0]).factor
    assert all(0 < f < 1 for f in factor[1:])
    assert all(0 < f < 1 for f in lm.Discounts.of([0] * 6).factor[1:])


def test_pack_round_trip():
    rng = np.random.default_rng(0)
    arrays = [rng.integers(0, 9, 100), np.zeros(0, np.int64), rng.random(7), np.array([1 << 63], np.uint64)]
    for a, b in zip(arrays, lm.unpack(lm.pack(*arrays)), strict=True):
        assert np.array_equal(a, b)


@pytest.mark.parametrize("seed", range(3))
def test_weights_normalise(seed):
    rng = np.random.default_rng(seed)
    seen = rng.integers(1, 50, 20).astype(float)
    mass, lower = seen * rng.choice([0.3, 0.9, 1.0], 20), rng.random(20) * 0.9
    factor, alpha = lm.weights(seen, mass, lower)
    assert np.allclose(factor * mass + alpha * (1 - lower), 1)
