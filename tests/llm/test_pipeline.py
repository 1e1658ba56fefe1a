import glob

from pyspark.sql import functions as F

import corpus_pipeline
from featurespark.llm.common import shared_dir
from featurespark.llm.minhash import near_duplicates
from test_decontaminate import brute as windows
from test_minhash import brute as groups
from test_packing import check_documents, check_sequences
from test_pii_quality import base_spans


def test_stages_take_effect(spark, sf, monkeypatch):
    seen, spied = {}, []
    for name, stage in corpus_pipeline.STAGES:

        def spy(s, docs, d, name=name, stage=stage):
            out = stage(s, docs, d)
            assert name == "packing" or out.columns == docs.columns
            seen[name] = ({r.doc_id: r for r in docs.collect()}, docs)
            return out

        spied.append((name, spy))
    monkeypatch.setattr(corpus_pipeline, "STAGES", spied)
    rows = corpus_pipeline.run(spark, sf).collect()
    texts = {k: {i: r.text for i, r in v[0].items()} for k, v in seen.items()}
    bench = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    gone = set(texts["toxicity"]) - set(texts["near_dedup"])
    assert all(labels.get(i, 1) for i in gone)
    want = groups(sorted(texts["near_dedup"].items()), 5, 80)
    assert set(texts["decontamination"]) == {i for i, _, _, kept in want if kept}
    judged = windows(sorted(texts["decontamination"].items()), bench)
    assert set(texts["pii"]) == {r[0] for r in judged if not r[-1]} and len(texts["pii"]) < len(judged)
    left = texts["packing"]
    assert set(left) == set(texts["pii"])
    for i, text in left.items():
        if not base_spans(texts["pii"][i]):
            assert text == texts["pii"][i] or "[" in text
        assert not base_spans(text) and seen["packing"][0][i].n_chars == len(text)
    check_documents(rows, left, 2048)
    check_sequences(rows, 2048)
    assert {r.doc_id for r in rows} == set(left)
    assert near_duplicates(seen["packing"][1].limit(0)).count() == 0


def test_stages_on_odd_rows(spark, sf, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows and ids, an extra column, empty tables."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    names = docs.columns
    long = "long " + " ".join(f"w{i}" for i in range(60_000))
    odd = [(None, "a text of its own without an id", None, None, None), (70001, None, "en", "s", None), (70002, "", "en", "s", 0), (70003, long, "en", "s", len(long)),
           (70004, "one of two texts", "en", "s", 16), (70004, "the other text here", "en", "s", 19), (70005, "same row", "en", "s", 8), (70005, "same row", "en", "s", 8)]
    df = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    extra = ["score", "predicted", "n_words", "n_hit", "contaminated", "_m_email", "_found", "_pii", "_row", "_doc", "_words", "_own0", "kept"]
    df = df.withColumns({c: F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in extra})
    texts = {"a text of its own without an id", None, "", long, "one of two texts", "the other text here", "same row"}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, sf)
        assert out.columns == [*names, *extra] and dict(out.dtypes) == dict(df.dtypes)
        assert all(r[c] == f"{c} of {'none' if r.doc_id is None else r.doc_id}" for r in out.collect() for c in extra)
        rows = [r for r in out.collect() if r.doc_id is None or r.doc_id > 70000]
        assert {r.text for r in rows} == texts and len(rows) == (7 if name == "near_dedup" else 8)
        assert stage(spark, df.limit(0), sf).count() == 0
    packed = corpus_pipeline.packing(spark, df, sf)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in df.collect()}
    assert corpus_pipeline.packing(spark, df.limit(0), sf).count() == 0


def test_run_leaves_no_tables_behind(spark, sf):
    before = set(glob.glob(f"{shared_dir(spark).rsplit('/', 1)[0]}/table-*"))
    corpus_pipeline.run(spark, sf).count()
    assert len(set(glob.glob(f"{shared_dir(spark).rsplit('/', 1)[0]}/table-*")) - before) <= 6
