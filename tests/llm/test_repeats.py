import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm import edge
from vigilseries.llm import repeats


def brute(words, least=24, times=3):
    """All runs, by trying every period at every place."""
    n, found = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, times * q):
                found.setdefault((i, j + q), q)  # periods come in order
            i = j + 1
    return sorted((i, end - i, q) for (i, end), q in found.items())


def collapsed(words, found):
    out = {i for s, n, p in found for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in out)


def check(words, least=24, times=3):
    got = repeats.runs(repeats.numbered([str(w).encode() for w in words]), least, times)
    assert got == brute(words, least, times)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=6), st.integers(1, 12)), max_size=8), st.sampled_from([(24, 3), (6, 2), (7, 3), (10, 4)]))
def test_powers_of_short_words(parts, wanted):
    check([w for part, times in parts for w in part * times], *wanted)


@pytest.mark.parametrize("seed", range(40))
def test_nested_repeats(seed):
    draw = random.Random(seed)
    words = [draw.randrange(3) for _ in range(draw.choice([1, 5, 30]))]
    for _ in range(draw.choice([2, 4, 6])):
        words = words * draw.choice([1, 2, 3]) + [draw.randrange(4) for _ in range(draw.randrange(4))]
        words = words[:700]
    check(words)


def test_fibonacci_words():
    a, b = "a", "ab"
    while len(b) < 600:
        a, b = b, b + a
    check(list(b), 6, 2)


def test_long_texts():
    """A million equal words, and a million with a period of a thousand: one pass each."""
    assert repeats.runs(np.zeros(1_000_000, np.int64)) == [(0, 1_000_000, 1)]
    period = np.arange(1000)
    assert repeats.runs(np.r_[7, np.tile(period, 300), 5]) == [(1, 300_000, 1000)]


def words_of(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def test_edges(spark):
    texts = [*edge.TEXTS, (60, "na " * 50 + "é 😀 " * 20 + "\x1c end"), (61, ("a b c " * 9 + "stop ") * 4), (60, "na " * 50)]
    got = repeats.periodic(edge.rows(spark, texts)).collect()
    wanted = []
    for i, t in texts:
        words = words_of(t)
        found = brute(words) if len(words) < 5000 else []
        wanted.append((i, len(words), [tuple(r) for r in found], collapsed(words, found)))
    edge.same([(r.id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got], wanted)


def test_empty(spark):
    assert repeats.periodic(edge.empty(spark)).count() == 0


def test_greatest_is_exact(spark):
    runs = "array<struct<start: long, length: long, period: long>>"
    rows = [(1, []), (2, [(5, 33, 11), (0, 33, 11), (2, 30, 10)]), (3, [(0, 100_000_000, 33_333_333), (1, 99_999_999, 33_333_333), (9, 300_000_001, 99_999_999)])]
    got = spark.createDataFrame(rows, f"id long, runs {runs}").select("id", repeats.greatest("runs").alias("r")).orderBy("id").collect()
    # later entries win only if strictly larger: the caller's order decides ties
    assert got[0].r is None and tuple(got[1].r) == (5, 33, 11) and tuple(got[2].r) == (9, 300_000_001, 99_999_999)
