import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm import edge
from vigilseries.llm import graph, near


def brute_sets(texts, words):
    sets = []
    for text in texts:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        found = re.findall(r"[^\x20\x09-\x0D]+", lower)
        whole = [tuple(found)] if found else []
        sets.append({tuple(found[i : i + words]) for i in range(len(found) - words + 1)} or set(whole))
    return sets


def brute(pairs, words=5, similarity=80):
    sets = brute_sets([t for _, t in pairs], words)
    parent = list(range(len(pairs)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    holders = defaultdict(list)
    for k, own in enumerate(sets):
        common = Counter(j for s in own for j in holders[s])
        for j, n in common.items():
            if 100 * n >= similarity * (len(own) + len(sets[j]) - n):
                parent[find(k)] = find(j)
        for s in own:
            holders[s].append(k)
    least = {}
    for k, (i, _) in enumerate(pairs):
        least.setdefault(find(k), []).append(i)
    return [
        (i, len(sets[k]), min((x for x in least[find(k)] if x is not None), default=None) if sets[k] else i)
        for k, (i, _) in enumerate(pairs)
    ]


def check(spark, pairs, **options):
    got = near.classes(edge.rows(spark, pairs), **options).select("id", "n", "component_id")
    edge.same(got.collect(), brute(pairs, **options))


def test_edges(spark):
    check(spark, edge.TEXTS)
    check(spark, edge.TEXTS, words=4)


def test_empty(spark):
    assert near.classes(edge.empty(spark)).count() == 0
    assert near.deduplicated(edge.empty(spark)).columns == edge.empty(spark).columns


def near_copies(n, length, edits, seed):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(length)]
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randint(0, edits)):
            copy[rng.randrange(length)] = f"e{rng.randrange(10**6)}"
        yield " ".join(copy)


@pytest.fixture
def families():
    """Families of copies around the threshold, exact copies, a shared passage, short texts."""
    texts = [t for s in range(12) for t in near_copies(12, 60 + 25 * s, 8, s)]
    passage = " ".join(f"p{k}" for k in range(60))
    texts += [passage + " " + t for t in near_copies(30, 80, 80, 99)]
    texts += ["one two three four five six"] * 40 + ["One  two three four five six seven", "one", "ONE"]
    order = random.Random(1).sample(range(len(texts)), len(texts))
    return list(zip(order, texts, strict=True))


def test_families(spark, families):
    check(spark, families)
    check(spark, families, words=4)


def test_small_blocks_and_crowded_buckets(spark, families, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 7)
    monkeypatch.setattr(near, "BUCKET", 5)
    check(spark, families)


def test_given_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    check(spark, [tuple(r) for r in rows], words=4)


def test_kept_rows_are_whole(spark, families):
    families = [(1000 + i, t) for i, t in families]
    # Two different texts share identifier 11; classes are counted by identifier here.
    pairs = [*families, *families[:5], *[t for t in edge.TEXTS if t[0] != 11]]
    frame = edge.rows(spark, pairs)
    kept = near.deduplicated(frame)
    assert kept.columns == frame.columns and kept.exceptAll(frame).count() == 0
    sets = brute_sets([t for _, t in pairs], 5)
    classes = brute(pairs)
    bare = sum(not s for s in sets)
    heads = {c for (_, n, c), s in zip(classes, sets, strict=True) if s}
    assert kept.count() == bare + len(heads)


def test_every_close_pair_shares_a_key():
    """The pigeonhole: signatures that differ in up to DISTANCE symbols meet in some bucket."""
    import pyarrow as pa

    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 16, (300, near.SYMBOLS)).astype("<u2")
    b = a.copy()
    for row in b:
        spots = rng.choice(near.SYMBOLS, near.DISTANCE, replace=False)
        row[spots] ^= 1
    keys = []
    for signs in (a, b):
        batch = pa.RecordBatch.from_arrays(
            [pa.array([str(i).encode() for i in range(300)]), pa.array([s.tobytes() for s in signs])], ["node", "sign"]
        )
        own = defaultdict(set)
        for out in near._keys([batch]):
            for key, node in zip(out["key"].to_pylist(), out["node"].to_pylist(), strict=True):
                own[node].add(key)
        keys.append(own)
    assert all(keys[0][n] & keys[1][n] for n in keys[0])


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(4)
    differ = []
    for _ in range(300):
        pool = rng.integers(0, 1 << 62, 225).astype(np.uint64)
        differ.append((near.signature(pool[:125 + 75]) != near.signature(pool[25:])).mean())
    assert abs(np.mean(differ) - (1 - 175 / 225)) < 0.02


def test_components_of_paths_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 150)] + [(200, 201), (201, 202), (202, 200)]
    frame = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.root for r in graph.components(frame).collect()}
    wanted = {i: 0 for i in range(61)} | {i: 100 for i in range(100, 150)} | {200: 200, 201: 200, 202: 200}
    assert got == wanted
    assert graph.components(frame.limit(0)).count() == 0
