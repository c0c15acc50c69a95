"""Both collections share one derivation of the judgements; embeddings equal a plain pass."""
import hashlib
import math

from rankframe.operators import dense
from rankframe.suite import queries as Q


def test_judgements_are_derived_once(spark, monkeypatch):
    calls, plain = [], Q.derive_qrels
    monkeypatch.setattr(Q, "derive_qrels", lambda *a: calls.append(1) or plain(*a))
    both = Q.datasets(spark, "/root/testdata/sf0.001", bm25=False)
    assert len(calls) == 1 and both["qrels"].count() > 0


def test_embeddings_of_odd_rows_in_two_exchanges(spark):
    rows = [("1", "a b a"), ("2", ""), ("3", None), ("4", "a"), ("4", "c c"), (None, "a")]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    found = dense.hashed_embeddings(df, "doc_id", "text", 8)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2

    def vector(tokens):
        v = [0.0] * 8
        for t in tokens:
            v[int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % 8] += 1
        norm = math.sqrt(sum(x * x for x in v))
        return [x / norm if norm else 0.0 for x in v]

    expected = {"1": vector(["a", "b", "a"]), "2": vector([]), "3": vector([]), "4": vector(["a", "c", "c"]), None: vector([])}
    got = {r.id: list(r.embedding) for r in found.collect()}
    assert set(got) == set(expected)
    assert all(abs(x - y) < 1e-6 for k in got for x, y in zip(got[k], expected[k]))
