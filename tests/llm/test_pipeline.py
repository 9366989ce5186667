import re

import corpus_pipeline
import numpy as np
from emberline.llm import credentials, packing, wordbpe

SF = "/root/testdata/sf0.001"


def test_stages():
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "secret_scan", "best_fit_packing"]


def test_against_a_plain_pipeline(spark, tmp_path):
    from test_dedup import brute

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows, state = docs.collect(), docs
    kept = {r.doc_id: r.text for r in rows if re.search(r"[^\W\d_]", r.text or "")}
    first = {}
    for i in sorted(kept):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", kept[i]), i)
    kept = {i: kept[i] for i in first.values()}
    comp = brute(list(kept.items()))
    kept = {i: t for i, t in kept.items() if comp[i][1] == i}
    kept = {i: credentials.masked(t, credentials.scan(t)[1]) for i, t in kept.items()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, state, SF)
        if name != "best_fit_packing":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(k)))
        state = spark.read.parquet(str(tmp_path / str(k)))
        if name == "secret_scan":
            assert {r.doc_id: r.text for r in state.collect()} == kept
    got, whole = {}, {}
    for r in state.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
        whole.setdefault(r.sequence_id, []).append((r.offset, r.length))
    code = wordbpe.coder(wordbpe.default_path())
    assert got == {i: len(code.library.encode(t, add_special_tokens=False).ids) + 1 for i, t in kept.items()}
    assert all(sum(n for _, n in x) <= packing.LIMIT for x in whole.values())
    again = corpus_pipeline.run(spark, SF)
    assert again.columns == state.columns and again.count() == state.count()
    assert np.isclose(again.agg({"length": "sum"}).first()[0], sum(got.values()))
