"""The stages on the smallest table: columns, and what each keeps, against plain counts."""

import corpus_pipeline
from skyloom.scratch import store

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    before = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = {r.doc_id: r.text for r in docs.collect()}
        docs = store(stage(spark, docs, FOLDER), name)
        assert docs.columns == before, name
        after = docs.collect()
        assert {r.doc_id for r in after} <= set(rows), name
        if name == "simhash_near_dedup":
            # Brute force: no two kept texts are near copies, and each that went is near one of the same group.
            sets = {i: {tuple(w[k : k + 5]) for w in [t.lower().split()] for k in range(max(1, len(w) - 4))} for i, t in rows.items()}
            near = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
            kept = {r.doc_id for r in after}
            assert not [(a, b) for a in kept for b in kept if a < b and near(a, b)]
            assert all(any(near(g, o) for o in rows if o != g) for g in set(rows) - kept)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert packed.groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).first()[0] <= 2048
