"""Spark operators against plain-Python brute force on random small collections."""
import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from rankframe.operators import evaluation as EV
from rankframe.operators import lexical as LX

WORDS = st.sampled_from(["a", "b", "c", "d", "e", "f"])
DOC = st.lists(WORDS, min_size=0, max_size=7).map(" ".join)
SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def bm25_brute(docs, queries, k1=1.5, b=0.75, eps=0.25):
    toks = {d: t.split() for d, t in docs}
    n = len(toks)
    avgdl = sum(len(t) for t in toks.values()) / n
    df = {}
    for t in toks.values():
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    raw = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    mean = sum(raw.values()) / len(raw) if raw else 0.0
    idf = {w: (eps * mean if r < 0 else r) for w, r in raw.items()}
    out = {}
    for q, text in queries:
        for d, t in toks.items():
            s = 0.0
            for w in text.split():
                tf = t.count(w)
                s += idf.get(w, 0.0) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(t) / avgdl)) if tf else 0.0
            out[(q, d)] = s
    return out


def ranked(scores, k):
    by_q = {}
    for (q, d), s in scores.items():
        by_q.setdefault(q, []).append((-round(s, 6), d))
    return {q: [d for _, d in sorted(v)[:k]] for q, v in by_q.items()}


@SETTINGS
@given(st.lists(DOC, min_size=1, max_size=6), st.lists(DOC, min_size=1, max_size=3))
def test_bm25_matches_brute_force(spark, doc_texts, query_texts):
    docs = [(f"d{i}", t) for i, t in enumerate(doc_texts)]
    queries = [(f"q{i}", t) for i, t in enumerate(query_texts)]
    ddf = spark.createDataFrame(docs, "doc_id string, text string")
    qdf = spark.createDataFrame(queries, "query_id string, text string")
    k = 3
    run = LX.bm25_search(ddf, qdf, top_k=k, score_digits=6).collect()
    brute = bm25_brute(docs, queries)
    got = {}
    for r in run:
        assert r.score == round(brute[(r.query_id, r.doc_id)], 6)
        got.setdefault(r.query_id, []).append((r["rank"], r.doc_id))
    want = ranked(brute, k)
    assert {q: [d for _, d in sorted(v)] for q, v in got.items()} == want


def metrics_brute(run, qrels, k=20):
    out = {}
    judged = {q for q, _, _ in qrels}
    rel = {(q, d): g for q, d, g in qrels}
    for q in judged:
        # score descending, ties by doc_id descending (string order)
        lst = sorted([(s, d) for qq, d, s in run if qq == q], reverse=True)
        docs = [d for _, d in lst]
        grades = [rel.get((q, d), 0) for d in docs]
        nrel = sum(1 for (qq, _), g in rel.items() if qq == q and g >= 1)
        hits, ap = 0, 0.0
        for i, g in enumerate(grades[:k], start=1):
            if g >= 1:
                hits += 1
                ap += hits / i
        dcg = sum(g / math.log2(i + 1) for i, g in enumerate(grades[:k], start=1))
        ideal = sorted((g for (qq, _), g in rel.items() if qq == q), reverse=True)[:k]
        idcg = sum(g / math.log2(i + 1) for i, g in enumerate(ideal, start=1))
        out[q] = {"P@10": sum(1 for g in grades[:10] if g >= 1) / 10, "MAP@20": ap / nrel if nrel else 0.0,
                  "nDCG@20": dcg / idcg if idcg > 0 else 0.0}
    return out


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from(["q1", "q2"]), st.sampled_from([f"d{i}" for i in range(12)]),
                          st.integers(0, 5).map(float)), min_size=1, max_size=20, unique_by=lambda x: (x[0], x[1])),
       st.lists(st.tuples(st.sampled_from(["q1", "q2", "q3"]), st.sampled_from([f"d{i}" for i in range(12)]),
                          st.integers(0, 2)), min_size=1, max_size=15, unique_by=lambda x: (x[0], x[1])))
def test_metrics_match_brute_force(spark, run, qrels):
    rdf = spark.createDataFrame(run, "query_id string, doc_id string, score double")
    qdf = spark.createDataFrame(qrels, "query_id string, doc_id string, relevance int")
    ms = {"P@10": EV.Measure("P", 10), "MAP@20": EV.Measure("AP", 20), "nDCG@20": EV.Measure("nDCG", 20)}
    got = {r.query_id: r for r in EV.per_query_metrics(rdf, qdf, ms).collect()}
    want = metrics_brute(run, qrels)
    assert set(got) == set(want)
    for q, w in want.items():
        for name, v in w.items():
            assert math.isclose(got[q][name], v, abs_tol=1e-9), (q, name, got[q][name], v)
