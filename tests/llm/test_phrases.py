import random
import re
from collections import Counter

import pytest

from tests.llm import edge
from vigilseries.llm import phrases

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=30, most=4, share=80, top=2000):
    """Rows of ``lang, text``."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(UPPER)):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, most + 1):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    often = {p: c for p, c in f.items() if len(p[1]) > 1 and c >= least}
    dropped = set()
    for (lang, long), c in often.items():
        for k in range(2, len(long)):
            for i in range(len(long) - k + 1):
                p = (lang, long[i : i + k])
                if 100 * c >= share * f[p]:
                    dropped.add(p)
    out = []
    for lang in n:
        found = []
        for (own, p), a in often.items():
            if own == lang and (own, p) not in dropped:
                cuts = []
                for k in range(1, len(p)):
                    left, right = f[lang, p[:k]], f[lang, p[k:]]
                    cuts.append((2_000_000 * a // (left + right), k, left, right))
                score, _, left, right = min(cuts)
                found.append((-score, -a, " ".join(p).encode(), left, right))
        found.sort()
        for rank, (score, a, p, left, right) in enumerate(found[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return out


def test_edges(spark):
    texts = [(i, t) for i, t in edge.TEXTS] + [(50, "Go on. go on, go\ton\vgo on! go on and on; go on and on")]
    frame = edge.rows(spark, texts)
    edge.same(phrases.mined(frame, least=1).collect(), brute([(None, t) for _, t in texts], 1))
    edge.same(phrases.mined(frame, least=2).collect(), brute([(None, t) for _, t in texts], 2))


def test_empty(spark):
    assert phrases.mined(edge.empty(spark)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_random_texts(spark, monkeypatch, seed):
    """Many batches, stripes in many parts over many partitions, a nearly full bit table."""
    monkeypatch.setattr(phrases, "TOKENS", 300)
    monkeypatch.setattr(phrases, "ROWS", 7)
    monkeypatch.setattr(phrases, "BITS", 1 << 10)
    draw = random.Random(seed)
    words = ["the", "The", "of", "a", "x'y", "é", "ÉA", "\x1c", "re-do", "1", *map(str, range(20, 40))]
    rows = []
    for _ in range(400):
        text = "".join(
            draw.choice(words[: draw.choice([3, 10, 30])]) + draw.choice([" ", " ", " ", "\t ", ". ", ",", "\n"])
            for _ in range(draw.choice([0, 1, 5, 40]))
        )
        rows.append((draw.choice(["en", "en", "en", "de", "und", None]), text))
    frame = spark.createDataFrame(rows, "lang string, text string").repartition(8)
    for least, top in ((1, 40), (5, 2000)):
        edge.same(phrases.mined(frame, least=least, top=top).collect(), brute(rows, least, top=top))


def test_one_phrase_everywhere(spark):
    """A third of all rows is one text; numbers beyond what floating point holds stay exact."""
    rows = [("en", "as it were and so on")] * 2000 + [("en", f"w{i} as it v{i % 7} on") for i in range(4000)]
    frame = spark.createDataFrame(rows, "lang string, text string")
    edge.same(phrases.mined(frame).collect(), brute(rows))


def test_scores_beyond_64_bits(spark):
    row = spark.sql(
        f"SELECT CAST({phrases.SCALE} AS DECIMAL(7, 0)) * CAST(a AS DECIMAL(19, 0)) div CAST(l + r AS DECIMAL(19, 0)) AS s "
        "FROM VALUES (9000000000000000000, 9000000000000000001, 1) AS t(a, l, r)"
    ).first()
    assert row.s == 2_000_000 * 9_000_000_000_000_000_000 // 9_000_000_000_000_000_002
