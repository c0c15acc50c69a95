"""The pipeline against a plain re-run of its stages on collected rows."""
import corpus_pipeline as C

from rankframe.llm import decontaminate, langid, pieces, simhash
from .test_secrets import every
from .test_simhash import brute_classes, brute_fingerprint


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    model = langid.train(docs)
    kept = []
    for r in rows:
        h = model.cross_entropy(r.text)
        if h is not None and h.min() <= model.limits[h.argmin()]:
            kept.append(r)
    assert len(kept) > 0.97 * len(rows)
    classes = brute_classes([brute_fingerprint(r.text) for r in kept])
    kept = [r for i, r in enumerate(kept) if classes[i] == i]
    bench = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    from .test_decontaminate import brute

    found = {r.doc_id for r in decontaminate.flag(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).filter("contaminated").collect()}
    assert found and all(any(brute(r.text, b.text) for b in bench) for r in rows if r.doc_id in found)
    kept = [r for r in kept if r.doc_id not in found]
    got = {r.doc_id: r for r in C.run(spark, sf).collect()}
    assert sorted(got) == [r.doc_id for r in kept]
    v = pieces.vocabulary(pieces.default_model())
    for r in kept:
        text, out, at = r.text, "", 0
        for a, _, b in every(text):
            if a >= at:
                out, at = out + text[at:a] + "[SECRET]", b
            at = max(at, b)
        assert got[r.doc_id].round_trip and pieces.decode_ids(got[r.doc_id].ids, v) == out + text[at:]


def test_stages_keep_the_columns_and_stand_edges(spark, sf, edge_docs, no_docs):
    for _, stage in C.STAGES[:-1]:
        assert stage(spark, edge_docs, sf).columns == C.COLUMNS
        assert stage(spark, no_docs, sf).count() == 0
    last = C.STAGES[-1][1]
    assert last(spark, edge_docs, sf).count() == edge_docs.count() and last(spark, no_docs, sf).count() == 0
