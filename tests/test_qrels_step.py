"""Derived judgements: equal to all pairs, and no query text is written once per candidate."""
import math
import random

import pytest

from rankframe.sources.testdata import derive_qrels


def _tables(spark):
    rnd = random.Random(7)
    word = lambda: f"w{min(int(rnd.expovariate(0.12)), 40)}"
    docs = [(str(i), " ".join(word() for _ in range(rnd.choice([0, 1, 3, 8, 20])))) for i in range(150)]
    queries = [(str(i), " ".join(word() for _ in range(n))) for i, n in enumerate([0, 1, 1, 2, 3, 4, 5, 7, 9, 12])]
    return docs, queries, spark.createDataFrame(docs, "doc_id string, text string"), spark.createDataFrame(queries, "query_id string, text string")


@pytest.mark.parametrize("share", [0.2, 0.5, 0.9])
def test_equal_to_all_pairs(spark, share):
    docs, queries, d, q = _tables(spark)
    expected = set()
    for qi, qt in queries:
        terms = set(qt.split())
        for di, dt in docs:
            if terms and len(terms & set(dt.split())) >= math.ceil(len(terms) * share):
                expected.add((qi, di, 2 if qt in dt else 1))
    found = [tuple(r) for r in derive_qrels(d, q, share).collect()]
    assert len(found) == len(expected) and set(found) == expected


def test_candidates_are_written_as_ids(spark, monkeypatch):
    _, _, d, q = _tables(spark)
    kind, written = type(d), []
    plain = kind.checkpoint
    monkeypatch.setattr(kind, "checkpoint", lambda self, *a, **k: written.append(self.columns) or plain(self, *a, **k))
    derive_qrels(d, q).count()
    assert written and not any({"q_text", "q_terms"} & set(columns) for columns in written)
