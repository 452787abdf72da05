"""The pipeline's stages, one after the other, against brute force on the smallest tables."""

import re

import __spark_entry__ as entry
import corpus_pipeline
from dayloom.llm import toxicity

from .test_bytes_and_packs import check_packs
from .test_joins_and_scans import brute

SF = "/root/testdata/sf0.001"


def test_all_queries_are_registered():
    names = entry.queries()
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert names["pipeline"] is corpus_pipeline.run
    assert corpus_pipeline.ORACLE_SQL is None or "pipeline" in entry.oracle_sql()


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, rows, seen = docs.columns, docs.collect(), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append(docs.collect())
        assert k == 3 or docs.columns == columns
    clean, single, masked, packs = seen

    # toxicity: what stays is as it was, and is what the model does not reject
    before = {r.doc_id: r for r in rows}
    assert all(before[r.doc_id] == r for r in clean)
    source = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").filter(~toxicity.held_out())
    model = toxicity.train(source.select("doc_id", "text"), labels)
    assert {r.doc_id for r in clean} == {r.doc_id for r in rows if model.score(r.text) < 0.5}
    # one of each group
    groups = brute([(r.doc_id, r.text) for r in clean])
    assert {r.doc_id for r in single} == {g for _, g in groups.values()}
    # secrets: only runs of key characters change, and none that is assigned to a name is left
    texts = {r.doc_id: r.text for r in single}
    run = r"[A-Za-z0-9_+/-]{16,}={0,2}"
    assert len(masked) == len(single)
    for r in masked:
        pieces = [re.escape(p) for p in r.text.split("[SECRET]")]
        assert re.fullmatch(run.join(pieces), texts[r.doc_id], re.DOTALL)
        assert r.n_chars == (len(r.text) if r.text != texts[r.doc_id] else before[r.doc_id].n_chars)
        assert not re.search(r'token = "[0-9a-f]{40}"', r.text)
    check_packs(packs, [(r.doc_id, r.text) for r in masked], 4096)


def test_run_returns_packed_rows(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert out.count() > 0
