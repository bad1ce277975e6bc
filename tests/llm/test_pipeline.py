"""The pipeline, stage by stage, each against brute force on its own input."""

import zlib

import corpus_pipeline
from somatlas.llm import langid, queries, toxicity
from somatlas.runtime import Scratch, table
from tests.conftest import DATA
from tests.llm.common import check_packing, contamination, odd_documents
from tests.llm.test_nearsets import keys, kept_by_all_pairs
from tests.llm.test_operators import brute_ids


def test_stages_on_the_drivers_tables(spark):
    scratch = Scratch(spark, "test")
    docs = table(spark, DATA, "documents")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "toxicity", "near_duplicates", "decontamination", "packing"]

    predicted = {r["doc_id"]: r for r in langid.predict_documents(docs).collect()}
    out = scratch.save(stages["language"](spark, docs, DATA))
    assert out.columns == columns
    assert {r["doc_id"] for r in out.collect()} == {k for k, r in predicted.items() if r["lang_pred"] != "und" and r["score"] >= langid.MIN_SCORE}
    assert out.count() > 0.99 * docs.count()

    scored = {r["doc_id"]: r["predicted"] for r in toxicity.score_documents(out, table(spark, DATA, "labels")).collect()}
    docs, out = out, scratch.save(stages["toxicity"](spark, out, DATA))
    assert out.columns == columns and {r["doc_id"] for r in out.collect()} == {k for k, p in scored.items() if not p}

    # Stages on word shingles take five words and a similarity of 0.8, which is not op7's own rule.
    want = kept_by_all_pairs([(r["doc_id"], r["text"]) for r in out.collect()])
    docs, out = out, scratch.save(stages["near_duplicates"](spark, out, DATA))
    assert out.columns == columns and keys(out) == want

    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    items = [(r["item_id"], r["text"]) for r in table(spark, DATA, "benchmark").collect()]
    clean = {k for k, (n, hit, _) in zip(texts, contamination(texts.values(), items)) if not (hit and 20 * hit >= n)}
    docs, out = out, scratch.save(stages["decontamination"](spark, out, DATA))
    assert out.columns == columns and {r["doc_id"] for r in out.collect()} == clean

    ids = dict(zip(clean, brute_ids([texts[k] for k in clean])))
    rows = stages["packing"](spark, out, DATA).collect()
    check_packing(rows, {k: [len(v)] for k, v in ids.items()})
    whole = corpus_pipeline.run(spark, DATA).collect()
    assert {(r["doc_id"], r["start"], r["ids_crc32"]) for r in whole} == {(r["doc_id"], r["start"], r["ids_crc32"]) for r in rows}
    r = rows[0]
    assert zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]


def test_stages_on_odd_rows_and_empty_tables(spark):
    df, rows = odd_documents(spark)
    scratch = Scratch(spark, "test")
    for docs in (df, df.where("1 = 0")):
        docs = scratch.save(docs)
        for name, stage in corpus_pipeline.STAGES:
            docs = scratch.save(stage(spark, docs, DATA))
            if name != "packing":
                assert docs.columns == df.columns
        assert docs.columns == queries.op8_pack_cutting_stock(spark, DATA).columns
