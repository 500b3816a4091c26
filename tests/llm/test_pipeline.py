"""The pipeline against the brute-force versions of its stages."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

import corpus_pipeline
from merchloom.llm import decontaminate, mixing, quality_rules, secrets
from merchloom.llm import spans as sp
from test_documents import component_ids, fingerprint


def test_stages(spark, docs, rows, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    items = [(1, rows[8][1])]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = {r["doc_id"] for r in quality_rules.apply_rules(docs).collect() if r["kept"]}
    stay = [r for r in rows if r[0] in kept]
    stay = [r for r in stay if r[0] == dict(component_ids([(x[0], fingerprint(x[1])) for x in stay]))[r[0]]]
    grams = decontaminate.Grams([("1", rows[8][1].encode())])
    want = {}
    for r in stay:
        hit, _ = grams.scan(decontaminate.words(r[1].encode()))
        if hit.mean() <= 0.8:
            text = decontaminate.excise(r[1].encode(), hit).decode() if hit.any() else r[1]
            want[r[0]] = sp.replace(text, secrets.base_spans(text) + secrets.lexed(text))
    state = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        state = stage(spark, state, str(tmp_path))
        assert state.columns == docs.columns, name
    assert {r["doc_id"]: r["text"] for r in state.collect()} == want
    result = corpus_pipeline.run(spark, str(tmp_path)).collect()
    copies = {r["doc_id"]: r["copies"] for r in mixing.copies(state).collect()}
    assert sorted((r["doc_id"], r["text"]) for r in result) == sorted((d, want[d]) for d, n in copies.items() for _ in range(n))
