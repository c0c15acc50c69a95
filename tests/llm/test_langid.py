import numpy as np
import pytest

from rankframe.llm import langid as L


def test_held_out_accuracy(spark):
    import os

    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("driver test data not present")
    from rankframe.llm.suite import QUERIES

    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op4_language_id"](spark, sf).collect()
    assert len(got) == len(truth)
    held = [r for r in got if r.held_out]
    assert len(held) > 200
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
    assert np.mean([r.accepted for r in got]) > 0.97


def test_probabilities_sum_to_one():
    counts = {"x": {"abcab": 5, "bcabc": 2, "cabca": 1, " abca": 3}, "y": {"zzzzz": 4, "abcab": 1}}
    m = L.Model(counts)
    one = {chr(c) for g in [*counts["x"], *counts["y"]] for c in map(ord, g)}
    for j in range(2):
        for context in ("", "a", "ca", "bca", "abca", "zz", "q"):
            total = 0.0
            for c in sorted(one):
                codes = np.array([ord(x) for x in context + c], np.uint32)
                total += np.exp(-m._sum(codes, len(context))[j])
            # the rest is the share of a character that was never seen
            assert 0.5 < total <= 1 + 1e-6


def plain_kneser_ney(counts, text):
    """Nats per character by the interpolated formula, from the counts of one language, order by order."""
    levels = [counts]
    for _ in range(L.ORDER - 1):
        lower = {}
        for g in levels[-1]:
            lower[g[1:]] = lower.get(g[1:], 0) + 1
        levels.append(lower)
    levels.reverse()

    def prob(context, c, k):
        below = prob(context[1:], c, k - 1) if k else 1 / chars
        table = levels[k]
        same = {g: n for g, n in table.items() if g[:-1] == context}
        total = sum(same.values())
        if not total:
            return below
        once, two = (sum(n == m for n in table.values()) for m in (1, 2))
        d = min(max(once / (once + 2 * two), 0.1), 0.9) if once else 0.5
        return max(same.get(context + c, 0) - d, 0) / total + d * len(same) / total * below

    chars = len(levels[0]) + 1
    total = 0.0
    for i, c in enumerate(text):
        k = min(i, L.ORDER - 1)
        total -= np.log(prob(text[i - k : i], c, k))
    return total / len(text)


def test_scores_equal_the_plain_formula():
    rng = np.random.default_rng(3)
    text = "".join(rng.choice(list("abcde "), 400))
    counts = {}
    for i in range(len(text) - L.ORDER + 1):
        g = text[i : i + L.ORDER]
        if "  " not in g:
            counts[g] = counts.get(g, 0) + 1
    m = L.Model({"x": counts})
    for sample in ("abcde", "aabbccddee", text[50:90].replace("  ", " ").strip(), "cab bac"):
        codes = L.normalise(sample)
        plain = "".join(map(chr, codes))
        assert m.cross_entropy(sample)[0] == pytest.approx(plain_kneser_ney(counts, plain), abs=1e-4)


def test_all_grams_are_counted(spark):
    rng = np.random.default_rng(4)
    docs = spark.createDataFrame([(i, "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz "), 3000)), "en", None, 1) for i in range(40)], "doc_id long, text string, lang string, source string, n_chars long")
    fitted = [r.text for r in docs.collect()]
    m = L.train(docs, rows_per_lang=100)
    assert len(m.keys[-1].keys) - 1 > 60_000 and len(fitted) == 40


def test_rejection_and_edges(spark, edge_docs, no_docs):
    train = spark.createDataFrame(
        [(i, t, lang, None, 1) for i, (t, lang) in enumerate(
            [("the cat and the dog went to the house of the man " * 3, "en"), ("der hund und die katze gehen in das haus des mannes " * 3, "de")] * 30
        )],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    m = L.train(train.union(train.limit(3)))
    assert m.langs == ["de", "en"]
    docs = spark.createDataFrame([(1, "the man and the dog"), (2, "die katze und das haus"), (3, "xqzv kjqx wvzq qqxz jjkv"), (4, "123 !!"), (5, None)], "doc_id long, text string")
    got = {r.doc_id: r.language for r in L.identify(docs, m).collect()}
    assert [got[i].lang for i in (1, 2, 4, 5)] == ["en", "de", "und", "und"]
    assert got[3].lang in m.langs and not got[3].accepted and got[4].score == 0
    edges = L.identify(edge_docs, L.train(edge_docs)).collect()
    assert len(edges) == edge_docs.count()
    assert L.identify(no_docs, L.train(no_docs)).count() == 0
    assert all(r.language.lang == "und" for r in L.identify(edge_docs, L.train(no_docs)).collect())


def test_pieces_of_long_texts_add_up():
    m = L.Model({"x": {"abcab": 5, "bcabc": 2, "cabca": 1}})
    text = "abcabca bc" * 500
    assert np.allclose(m.cross_entropy(text), m.cross_entropy(text, piece=37))


def test_sample_is_the_smallest_hashes(spark):
    from pyspark.sql import functions as F

    ids = spark.range(20000).select(
        F.col("id").alias("doc_id"), F.xxhash64("id").alias("text_hash"), F.when(F.col("id") % 10 == 0, "b").otherwise("a").alias("lang")
    )
    got = L._sample(ids, 700, "fit", F.lit(True)).collect()
    keyed = ids.withColumn("k", F.xxhash64(F.lit("fit"), "doc_id", "text_hash")).collect()
    for lang in "ab":
        want = sorted((r.k, r.doc_id) for r in keyed if r.lang == lang)[:700]
        assert sorted(r.doc_id for r in got if r.lang == lang) == sorted(d for _, d in want)
    assert L._sample(ids, 30000, "fit", F.lit(True)).count() == 20000
