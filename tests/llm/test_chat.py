from collections import defaultdict

import pytest

from tests.llm import edge
from vigilseries.llm import chat


def brute(turns, size):
    order = lambda t: (t[1] is not None, t[1] or 0, t[2], t[3])
    groups, seats = defaultdict(list), defaultdict(set)
    for conv, turn, role, text in turns:
        role = "unknown" if role is None else role
        groups[conv, -1 if turn is None else turn // size].append((conv, turn, role, text or ""))
        if role != "system":
            seats[conv].add(role)
    out = []
    for (conv, block), found in groups.items():
        for seat in seats[conv]:
            text, masks, masked = "", [], 0
            for _, _, role, said in sorted(found, key=order):
                name = "assistant" if role == seat else "system" if role == "system" else f"user name={role}"
                text += f"<|im_start|>{name}\n"
                if role == seat:
                    masks.append(f"{len(text)}:{len(text) + len(said)}")
                    masked += len(said)
                text += f"{said}<|im_end|>\n"
            out.append((conv, seat, block, text, ",".join(masks), len(found), masked))
    return out


EDGES = [
    (1, 0, "ann", "hi 😀"), (1, 1, "bob", "héllo"), (1, 2, "cid", ""), (1, 3, "ann", None), (1, 1, "bob", "héllo"),
    (2, 0, "system", "rules"), (3, 0, "system", "rules"), (3, 1, "ann", "x" * 100_000), (None, 5, None, "lost"),
    (None, None, "dan", "later"), (4, None, "ann", "first"), (4, 7, "ann", "then"), (4, 700, "bob", "much later"),
]


def frame(spark, turns):
    return spark.createDataFrame([(*t, "x", 1) for t in turns], "conv_id long, turn long, role string, text string, perspective string, block long")


@pytest.mark.parametrize("size", [1, 256])
def test_edges(spark, size):
    got = chat.rotated(frame(spark, EDGES), block_turns=size)
    edge.same(got.collect(), brute(EDGES, size))


def test_long_conversation(spark):
    turns = [(9, i, f"p{i % 3}", f"turn {i}") for i in range(2000)]
    got = chat.rotated(frame(spark, turns)).collect()
    edge.same(got, brute(turns, chat.BLOCK_TURNS))
    whole = "".join(r.text for r in sorted(got, key=lambda r: r.block) if r.perspective == "p1")
    assert whole.count("<|im_start|>assistant") == 667 and whole.count("<|im_start|>") == 2000


def test_masks_are_the_assistants_words(spark):
    for r in chat.rotated(frame(spark, EDGES)).collect():
        for span in filter(None, r.masks.split(",")):
            a, b = map(int, span.split(":"))
            assert r.text[:a].endswith("<|im_start|>assistant\n") and r.text[b:].startswith("<|im_end|>")


def test_blocks_of_many_rows_are_parts(spark, monkeypatch):
    monkeypatch.setattr(chat, "CHUNK_ROWS", 50)
    turns = [(None, None, "ann", f"lost {i:03d}") for i in range(300)] + [(None, None, "bob", "same")] * 200
    turns += [(5, 3, "cid", f"again {i:03d}") for i in range(120)] + [(5, 400, "cid", "later"), (5, 0, "dan", "hi")]
    turns += [(6, i, "ann", f"turn {i}") for i in range(30)]
    got = chat.rotated(frame(spark, turns), part_rows=40)
    rows = got.orderBy("conv_id", "perspective", *chat.in_order(got.block)).collect()
    assert max(r.n_turns for r in rows) == 40
    assert len({(r.conv_id, r.perspective, r.block) for r in rows}) == len(rows)
    whole = defaultdict(str)
    for r in rows:
        whole[r.conv_id, r.perspective] += r.text
    expected = defaultdict(str)
    for conv, seat, _, text, *_ in sorted(brute(turns, 256), key=lambda b: b[2]):
        expected[conv, seat] += text
    assert whole == expected


def test_empty(spark):
    assert chat.rotated(frame(spark, EDGES).limit(0)).count() == 0
