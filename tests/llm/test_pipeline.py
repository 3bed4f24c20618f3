import pytest

from gridfire.llm import decontaminate, gam, queries
from gridfire.llm.bpe import Encoder, Vocabulary

from .test_jaccard import groups_of, similar_pairs
from .test_simhash_bpe import components_of, plain_fingerprint

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_match_brute_force(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    good = {r.doc_id for r in gam.keep_good(docs, queries.table(spark, sf_dir, "labels")).collect()}
    predicted = {r.doc_id for r in queries.op1_quality(spark, sf_dir).where("predicted = 1").collect()}
    assert good == predicted and 0.5 < len(good) / len(rows) < 1
    first = {}
    for i in sorted(good):
        first.setdefault(rows[i].text, i)
    unique = sorted(first.values())
    texts = {i: rows[i].text or "" for i in unique}
    linked = [*components_of({i: plain_fingerprint(t) for i, t in texts.items()}).items(), *similar_pairs(texts)]  # 2 bits, or 0.8 of the shingles of five words
    component = groups_of(texts, linked)
    alone = [i for i in unique if component[i] == i]
    items = decontaminate.find_leaks(docs.where(docs.doc_id.isin(alone)), queries.table(spark, sf_dir, "benchmark"))
    leaks = {r.doc_id for r in items.collect()}
    encode = Encoder(Vocabulary(queries.vocabulary_path()))
    want = {i: len(encode.whole(rows[i].text or "")) for i in alone if i not in leaks}
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id: r.n_tokens for r in got} == want and len(got) == len(want) and all(r.round_trip for r in got)


def test_stage_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "exact_dedup", "simhash_near_dedup", "benchmark_decontamination", "bpe_encoding"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).dtypes == docs.dtypes
