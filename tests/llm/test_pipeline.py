"""The corpus pipeline, stage by stage, against plain versions of the stages."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from barloom.llm import mixing, ppm, spm
from barloom.llm.common import stored
from tests.llm.test_near_copies import plain_groups
from tests.llm.test_text_operators import DOCS, odd_documents, plain_line_dedup

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """Input and output rows of every stage."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        after = stored(stage(spark, docs, SF), name)
        out.append((docs, after))
        docs = after
    return out


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_columns_stay_until_the_last_stage(steps):
    for before, after in steps[:-1]:
        assert after.columns == before.columns and after.dtypes == before.dtypes


def test_language_stage(spark, steps):
    before, after = (rows(x) for x in steps[0])
    trees = ppm.train(steps[0][0].where(~ppm.held_out("doc_id")))
    want = {}
    for r in before:
        lang, score = trees.predict((r["text"] or "").encode())
        if lang != "und" and score >= corpus_pipeline.LEAST_CERTAIN:
            want[r["doc_id"]] = r | {"lang": lang}
    assert {r["doc_id"]: r for r in after} == want


def test_line_stage(steps):
    before, after = (rows(x) for x in steps[1])
    plain = plain_line_dedup([(r["doc_id"], r["text"]) for r in before], 50)
    want = {d: t for d, (t, n) in plain.items() if not n or t.split()}
    assert {r["doc_id"]: r["text"] for r in after} == want
    assert all(r["n_chars"] == len(r["text"]) for r in after)


def test_near_duplicate_stage(steps):
    """Against all pairs of documents: five-word shingles, similarity 0.8 or more."""
    before, after = (rows(x) for x in steps[2])
    groups = plain_groups([(r["doc_id"], r["text"]) for r in before])
    assert sorted(r["doc_id"] for r in after) == sorted({*groups.values()})
    texts = {r["doc_id"]: r for r in before}
    assert all(r == texts[r["doc_id"]] for r in after)


def test_mixing_stage(spark, steps):
    before, after = (rows(x) for x in steps[3])
    copies = Counter(r["doc_id"] for r in after)
    assert set(copies) == {r["doc_id"] for r in before}
    want = Counter(r.doc_id for r in mixing.mix_sources(steps[3][0]).select("doc_id").collect())
    assert copies == want


def test_last_stage(steps):
    import public_tokenizers

    model = spm.backend(public_tokenizers.path(corpus_pipeline.MODEL))
    texts = {r["doc_id"]: r["text"] for r in rows(steps[4][0])}
    for r in rows(steps[4][1]):
        assert r["ids"] == model.library.encode(texts[r["doc_id"]])
        assert r["round_trip"] and model.decode(np.array(r["ids"], "<u4")) == texts[r["doc_id"]]


def test_stages_take_odd_and_empty_tables(spark):
    odd = odd_documents(spark)
    assert odd.columns[:5] == [c.split()[0] for c in DOCS.split(", ")[:5]]
    for docs in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            docs = stored(stage(spark, docs, SF), name)
        kept = docs.select("doc_id").collect()
        assert {r.doc_id for r in kept} <= {*range(13), None}
    near = corpus_pipeline.near_dedup(spark, odd.where(F.col("doc_id") == 4), SF)
    assert near.count() == 1


def test_ids_that_clash(spark):
    """Different texts of one id stay; repeated rows, and near copies under one id, go."""
    a, b = (" ".join(f"{name}{i}" for i in range(80)) for name in "ab")
    rows = [(5, a, "en", "s", 1), (5, b, "en", "s", 1), (5, a, "en", "s", 1), (5, a, "de", "s", 1), (6, b + " c", "en", "s", 1), (7, a + " c", "en", "s", 1), (5, a + " d", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = [tuple(r)[:3] for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()]
    assert len(kept) == 2 and {d for d, *_ in kept} == {5}
    assert sorted(t[:1] for _, t, _ in kept) == ["a", "b"]
