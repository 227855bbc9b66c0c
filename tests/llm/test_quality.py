import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm import edge
from vigilseries.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)),
        len(covered), len(words) < 10 or 100 * len(covered) > 20 * len(words),
    )


def test_base_against_brute_force(spark):
    repeats = " ".join(["a b c d e f g"] * 3) + " x y z"
    texts = [*edge.TEXTS, (20, repeats), (21, "x\nx\n\nx y\n" * 3), (22, "a b c d e a b c d e"), (23, "# & < a" * 9)]
    got = quality.judged(edge.rows(spark, texts)).select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"
    )
    edge.same(got.collect(), [(i, *brute(t)) for i, t in texts])


def test_long_texts_are_judged_like_short_ones(spark):
    """A clean text of a million words is kept as its first thousand are; one of few words is not."""
    draw = random.Random(3)
    names = ["the", "of", "and", *(f"w{k}" for k in range(20_000))]
    weights = [1 / (k + 1) for k in range(len(names))]
    clean = draw.choices(names, weights, k=1_000_000)
    dull = draw.choices(names[:60], k=50_000)
    texts = [(1, " ".join(clean)), (2, " ".join(clean[:1000])), (3, " ".join(dull)), (4, " ".join(dull[:1000])), (5, "")]
    rows = {r.doc_id: r for r in quality.judged(edge.rows(spark, texts)).select(
        "row.doc_id", "n_words", "n_distinct_words", "n_repeat_words", "failed").collect()}
    assert len(set(clean)) * 100 < 10 * len(clean)  # what a share of the whole text would reject
    assert rows[1].failed == rows[2].failed == [] and "distinct_words" in rows[3].failed and "distinct_words" in rows[4].failed
    words = clean
    assert rows[1].n_distinct_words == sum(len(set(words[i : i + 1000])) for i in range(0, len(words), 1000))
    assert rows[1].n_repeat_words == brute(texts[0][1])[4] and rows[5].n_distinct_words == 0


def test_empty(spark):
    assert quality.accepted(edge.empty(spark)).columns == edge.empty(spark).columns


def test_no_python_in_the_plan(spark):
    plan = quality.judged(edge.rows(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_agrees_with_labels(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    labels = spark.read.parquet(f"/root/testdata/{sf}/labels.parquet")
    judged = quality.judged(docs).where(~F.col("base_failed")).select("row.doc_id", "kept")
    found = {
        r.quality: r.share
        for r in judged.join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()
    }
    assert found[1] > 0.998 and found[0] < 0.05
