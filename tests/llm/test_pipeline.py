"""The pipeline's stages one after the other over small rows."""

import corpus_pipeline

from . import fixture
from .test_operators import components_of, naive_simhash


def test_pipeline(spark, tmp_path):
    rows = [r for r in fixture.documents() if r[0] is not None]
    labels = [(r[0], 1, 0) for r in rows[:60:2]]
    folder = fixture.tables(spark, tmp_path / "t", rows, labels)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.schema.names == docs.schema.names or name == "bpe"
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs.collect()
    ids = lambda name: {r["doc_id"] for r in seen[name]}
    assert ids("near_dedup") < ids("line_dedup") == ids("quality_rules") < {r[0] for r in rows}
    fps = {r["doc_id"]: naive_simhash(r["text"]) for r in seen["line_dedup"]}
    label = components_of(set(fps.values()))
    smallest = {}
    for i, f in sorted(fps.items()):
        smallest.setdefault(label[f], i)
    assert ids("near_dedup") == set(smallest.values())
    assert all(r["n_chars"] == len(r["text"]) for r in seen["line_dedup"] if r["text"] is not None)
    assert sorted(r["decoded"] for r in seen["bpe"]) == sorted(r["text"] or "" for r in seen["mixing"])
    whole = corpus_pipeline.run(spark, folder).collect()
    assert sorted((r["doc_id"], r["decoded"]) for r in whole) == sorted((r["doc_id"], r["decoded"]) for r in seen["bpe"])
