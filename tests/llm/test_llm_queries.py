import pytest
from compare import connect, difference
from samples import no_docs, odd_docs

import corpus_pipeline
from opinarium.llm import queries

SF = "/root/testdata/sf0.001"
NAMED = {"op1_quality_rules", "op2_toxicity", "op3_chat_format", "op4_simhash_groups", "op5_bm25_top_k", "op6_byte_bpe",
         "op7_mix_sources", "op8_lm_scores", "op9_substring_dedup", "op10_secret_spans",
         "op11_hard_negatives", "op12_token_alignment", "op13_exact_dedup"}


def test_names():
    assert set(queries.QUERIES) == NAMED and set(queries.ORACLES) == {"op1_quality_rules", "op3_chat_format", "op11_hard_negatives", "op13_exact_dedup"}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, name):
    assert difference(queries.QUERIES[name](spark, SF), connect(SF), queries.ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(NAMED - set(queries.ORACLES) - {"op5_bm25_top_k"}))
def test_one_row_per_document(spark, name):
    got = queries.QUERIES[name](spark, SF)
    ids = sorted(r.doc_id for r in got.select("doc_id").collect())
    assert ids == list(range(200))


def test_stages_and_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "simhash_near_dedup", "secret_scans", "mix_sources", "byte_bpe"]
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, SF).cache()
        if name != "byte_bpe":
            assert after.columns == docs.columns
        before = after
    run = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, run.collect())) == sorted(map(tuple, before.collect()))


@pytest.mark.parametrize("made", [odd_docs, no_docs])
def test_pipeline_on_odd_rows(spark, tmp_path, made):
    """Nulls, empty and long texts, repeats and clashing columns through all stages, and no rows at all."""
    docs = made(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(6, 1, 0), (8, 0, 1), (None, 1, 1), (9, None, None)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    if made is no_docs:
        assert got == []
    else:
        ids = {r.doc_id for r in got}
        assert len(ids) >= 8 and not {5, 10} & ids  # later copies go, and what the mix does not take
