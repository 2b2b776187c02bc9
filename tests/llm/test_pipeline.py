"""The corpus pipeline against brute force, stage by stage, on the smallest tables."""

import duckdb
import pyarrow as pa
import pytest

import corpus_pipeline
from codeloom.llm import langid, mixing
from codeloom.llm.common import table

from .test_basic_ops import brute_lines
from .test_model_ops import brute_contaminated
from .test_near_dedup import brute_kept

FOLDER = "/root/testdata/sf0.001"


def brute(spark, docs, items):
    """(rows of the result, documents left after each stage) for docs of dicts in order of id."""
    frame = table(spark, FOLDER, "documents")
    label = langid._labeller(langid.train(frame.where(~langid.held_out(frame.doc_id))))
    left = []
    found = [label([(d["text"] or "").encode()]) for d in docs]
    docs = [d for d, (lang, score) in zip(docs, found) if lang[0] != "und" and score[0] >= 0.35]
    left.append(len(docs))
    texts = brute_lines([d["text"] for d in docs])
    docs = [d | {"text": t} for d, t in zip(docs, texts) if t == d["text"] or t.split()]
    left.append(len(docs))
    docs = [docs[i] for i in brute_kept([d["text"] for d in docs])]
    left.append(len(docs))
    bad = {i for i, _ in brute_contaminated([(d["doc_id"], d["text"]) for d in docs], items)}
    docs = [d for d in docs if d["doc_id"] not in bad]
    left.append(len(docs))
    con = duckdb.connect()
    con.register("given", pa.Table.from_pylist(docs))
    rows = con.execute("WITH " + mixing.oracle("given").lstrip() + "\nSELECT doc_id, domain, lang, source, n_tokens, epoch FROM mixed").fetchall()
    return sorted(rows), left


@pytest.fixture(scope="module")
def given(spark):
    docs = sorted((r.asDict() for r in table(spark, FOLDER, "documents").collect()), key=lambda d: d["doc_id"])
    items = [(r.item_id, r.text) for r in table(spark, FOLDER, "benchmark").collect()]
    return docs, items


def test_whole_pipeline(spark, given):
    want, left = brute(spark, *given)
    got = corpus_pipeline.run(spark, FOLDER)
    assert sorted(tuple(r) for r in got.select("doc_id", "domain", "lang", "source", "n_tokens", "epoch").collect()) == want
    assert want and len(given[0]) >= left[0] >= left[1] > left[2] > left[3] > 0


def test_stages_keep_the_columns_of_documents(spark, given):
    docs = table(spark, FOLDER, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, FOLDER).columns == docs.columns
        assert stage(spark, docs.limit(0), FOLDER).count() == 0
    assert corpus_pipeline.mix(spark, docs.limit(0), FOLDER).count() == 0


def test_stages_take_nulls(spark):
    docs = spark.createDataFrame([(None, None, None, None, None), (1, None, "en", "src1", 0), (2, "", None, None, 0), (2, "", None, None, 0)], table(spark, FOLDER, "documents").schema)
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs, FOLDER).collect()
