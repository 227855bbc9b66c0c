import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tests.llm import edge
from vigilseries.llm import packing
from vigilseries.llm.queries import byte_bpe

HARD = [
    "", "a", " a", "  a", "a  b", "a\n b", "a \n b", "\n\nx", "x\n\n", "x\ny", "don't we'll I'D", "é\nü", "x y z",
    "α\nβ abcα def", "1a b2c", "a\tb", "<|endoftext|> hi", "x\r\ny", "  ", "\n", "a.\nB.\n\nC  d　 e", "ab\x1c cd",
    "²a a²", "naïve–dash ok", "x'\nT", "a\x85 b", "zażółć gęślą", "İstanbul ǅ",
]


@pytest.fixture(scope="module")
def tokenizer():
    one = Tokenizer.from_file(byte_bpe())
    one.encode_special_tokens = True
    return one


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END]


def test_encoder_equals_tokenizer(spark, tokenizer):
    texts = HARD + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for text, got in zip(texts, packing.WordEncoder(byte_bpe()).encode(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == ids_of(tokenizer, text)[:-1], text[:80]


def test_pieces_and_places(spark, tokenizer):
    docs = edge.rows(spark)
    placed = packing.packed(packing.pieces(docs, byte_bpe(), with_ids=True))
    found = placed.collect()
    wanted = []
    for i, text in edge.TEXTS:
        ids = ids_of(tokenizer, text)
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            part = np.array(ids[a:b], "<u4").tobytes()
            wanted.append((i, k, a, b - a, zlib.crc32(part)))
    edge.same([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found], wanted)
    ends = {}
    for r in sorted(found, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= packing.TOKENS
    whole = {r.sequence_id: r.ids for r in packing.sequences(placed).collect()}
    for r in found:
        assert whole[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)] == r.ids


def test_empty(spark):
    assert packing.packed(packing.pieces(edge.empty(spark), byte_bpe())).count() == 0


def check_plan(counts, size):
    made = packing.plan(counts, size)
    used = {}
    for shape, n in made.shapes:
        assert sum(shape) <= size and n > 0
        for part in shape:
            used[part] = used.get(part, 0) + n
    assert used == {k: n for k, n in counts.items() if n}
    return made.sequences


def test_exact_complements():
    assert check_plan({70: 3, 30: 3}, 100) == 3
    assert check_plan({50: 1, 30: 1, 20: 1}, 100) == 1
    assert check_plan({40: 1, 25: 1, 20: 1, 15: 1}, 100) == 1
    assert check_plan({50: 5}, 100) == 3
    assert check_plan({25: 9, 100: 2, 1: 1}, 100) == 5
    assert check_plan({}, 100) == 0


@pytest.mark.parametrize("seed", range(6))
def test_random_plans_are_tight(seed):
    rng = random.Random(seed)
    counts = {rng.randint(1, 200): rng.randint(1, 40) for _ in range(rng.randint(1, 120))}
    total = sum(k * n for k, n in counts.items())
    assert check_plan(counts, 200) <= -(-total // 200) * 1.1 + 2 + sum(n for k, n in counts.items() if k > 100)


def test_few_sequences_on_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    placed = packing.packed(packing.pieces(docs, byte_bpe())).selectExpr(
        "sum(length) as tokens", "count(distinct sequence_id) as n"
    ).first()
    assert placed.n <= -(-placed.tokens // packing.TOKENS) + 2
