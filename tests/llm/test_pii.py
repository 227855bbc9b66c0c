import re

from tests.llm import edge
from vigilseries.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
HARD = [
    "a@b.c_d@e.f", "x@foo@bar.com", "a@b.c.@d.e", "1.2.3.4.5.6.7.8", "999.1.1.1 00255.1.1.1 0.0.0.0",
    "4111 1111 1111 1111 5", "4111111111111111", "1 2", "+1 (017) 555-7713", "+12 34", "+1234567890.",
    "é 4111-1111-1111-1111😀 a@b.co", "1" * 40, "a" * 3000, "a@b" + ".c" * 20_000, "+" + "1 " * 30_000,
    "12 " * 30_000, "4111 1111 1111 1112 4111  1111", "😀+49 170 1234567", "a@b.c\na@b.c",
]


def luhn(digits):
    twice = [int(c) * 2 for c in digits[-2::-2]]
    return (sum(map(int, digits[::-2])) + sum(t - 9 if t > 9 else t for t in twice)) % 10 == 0


def passes(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(x) <= 255 for x in match.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    found = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        found += [
            (m.start(), rank, m.end(), kind) for m in re.finditer(pattern, text or "") if passes(kind, m[0])
        ]
    return sorted(found)


def spans(spark, pairs):
    return {r.id: r for r in pii.spans(edge.rows(spark, pairs)).collect()}


def test_base_spans(spark):
    texts = [t for _, t in edge.TEXTS] + HARD
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    found = spans(spark, list(enumerate(texts)))
    assert len(found) == len(texts)
    for i, text in enumerate(texts):
        assert [tuple(s) for s in found[i].base] == brute(text)


def test_contexts_find_unseen_identifiers(spark):
    texts = [f"please call me at +1 (555) 000-{i:04d} any day" for i in range(6)]
    texts += ["you may call me at ID77-8812x now", "an order of 5550123 parts", "version 4.0.7 is out"] * 2
    found = spans(spark, list(enumerate(texts)))
    added = {i: [tuple(s) for s in r.added] for i, r in found.items() if r.added}
    at = texts[6].index("ID77")
    assert added == {i: [(at, 7, at + 10, "found_phone")] for i in (6, 9)}


def test_contexts_of_mixed_company_are_not_trusted(spark):
    texts = [f"the number +1 (555) 000-{i:04d}" for i in range(4)] + [f"the number A{i}00-{i}9" for i in range(9)]
    assert not any(r.added for r in spans(spark, list(enumerate(texts))).values())


def trusted(spark, edges):
    frame = spark.createDataFrame(edges, "kind string, pattern string, instance string")
    return {(r.kind, r.pattern) for r in pii.scored(frame).collect()}


def test_chain_of_patterns_is_followed_to_its_end(spark):
    edges = [("phone", f"p{i}", f"s{i}-{k}") for i in range(8) for k in range(8 if i == 0 else 7)]
    edges += [(None, f"p{i}", f"x{j}") for i in range(8) for j in (i - 1, i) if j >= 0]
    assert trusted(spark, edges) == {("phone", f"p{i}") for i in range(8)}


def test_believed_instances_support_other_patterns(spark):
    edges = [("email", "p", f"s{k}") for k in range(16)] + [(None, "p", f"x{k}") for k in range(4)]
    edges += [(None, "q", f"x{k}") for k in range(5)]
    edges += [(None, "r", f"x{k}") for k in (0, 1, 2, 5)] + [(None, "t", f"x{k}") for k in (0, 1)]
    assert trusted(spark, edges) == {("email", "p"), ("email", "q")}


def test_an_instance_counts_once_in_a_pattern(spark):
    edges = [("email", "p", f"s{k}") for k in range(16)] + [(None, "p", f"x{k}") for k in range(4)]
    edges += [("email", "q", "x0"), (None, "q", "x0"), (None, "q", "y"), (None, "q", "z")]
    assert trusted(spark, edges) == {("email", "p")}


def test_empty(spark):
    assert pii.spans(edge.empty(spark)).count() == 0


def test_plans_hold_no_python(spark, monkeypatch):
    plans = []
    keep = pii.materialise
    monkeypatch.setattr(
        pii, "materialise",
        lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df, name),
    )
    plans.append(pii.spans(edge.rows(spark))._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 5 and not any(w in p for p in plans for w in ("Python", "Arrow", "Pandas"))
