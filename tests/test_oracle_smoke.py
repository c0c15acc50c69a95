"""A few registered queries against their DuckDB twins on the smallest tables."""
import os

import pytest

from tests.oracle_check import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
def test_twins_match(spark):
    res = compare(spark, SF, ["bm25_top10", "tfidf_top10", "bm25_grid", "collection_stats", "qrels", "query_ordinals", "grouped_split", "letor_parse", "run_minmax", "subword_vocab"], verbose=False)
    assert all(v[0] == "ok" for v in res.values()), res
