"""The registered queries against their SQL, and the pipeline against its stages done by hand."""

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tests.compare import compare, oracle_connection
from tests.llm import edge, test_exact, test_near, test_packing
from vigilseries.llm import mixing, quality
from vigilseries.llm.queries import ORACLES, QUERIES, byte_bpe

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert compare(got, oracle_connection(SF).execute(ORACLES[name]).df()) is None


def test_all_are_registered():
    known = entry.queries()
    assert "pipeline" in known
    assert [next(q for q in known if q.startswith(f"op{n}_")) for n in range(1, 14)]


def run_by_hand(spark, rows):
    """Documents as ``doc_id, text, source`` through the first four stages."""
    rows = [
        r for r, kept in zip(rows, [x.kept for x in quality.judged(
            spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1)
        ).collect()], strict=True) if kept
    ]
    kept = {(k, i) for i, k, _, first, _ in test_exact.brute([r[:2] for r in rows]) if first and k == i}
    rows = [r for r in rows if (r[0], r[0]) in kept]
    classes = test_near.brute([r[:2] for r in rows])
    return [r for r, (i, _, c) in zip(rows, classes, strict=True) if i == c]


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in docs.orderBy("doc_id").collect()]
    left = run_by_hand(spark, rows)
    frame = spark.createDataFrame(left, "doc_id long, text string, source string")
    copies = {r.id: r.copies for r in mixing.mixed(frame).collect()}
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(byte_bpe())
    tokenizer.encode_special_tokens = True
    wanted = []
    for i, text, _ in left:
        ids = len(test_packing.ids_of(tokenizer, text))
        cuts = [0, *range(ids % 2048 or 2048, ids + 1, 2048)]
        wanted += [(i, k, a, b - a) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))] * copies[i]
    got = corpus_pipeline.run(spark, SF)
    edge.same(got.select("doc_id", "piece", "start", "length").collect(), wanted)
    sums = got.groupBy("sequence_id").agg({"length": "sum"}).collect()
    assert max(r[1] for r in sums) <= 2048
    assert len(sums) <= -(-sum(r[1] for r in sums) // 2048) + 2


def test_stages_keep_the_columns(spark, tmp_path):
    docs = edge.rows(spark, [*edge.TEXTS, *[(100 + i, f"the words of the text {i} and the end of it all " * 3) for i in range(30)]])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for frame in (docs, edge.empty(spark)):
            assert stage(spark, frame, SF).columns == docs.columns, name
    for frame in (docs, edge.empty(spark)):
        path = str(tmp_path / f"t{frame.count()}")
        edge.written(spark, frame, path)
        corpus_pipeline.run(spark, path).collect()
