import math
import random
from collections import Counter

from rankframe.llm import urls as U


def split(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])
    rest = rest[:cut]
    at = rest.find("/")
    host, path = (rest, "") if at < 0 else (rest[:at], rest[at:])
    return "".join(c.lower() if c.isascii() else c for c in host), path


def rule(host, path):
    fits = [(h + p, v) for v, h, p in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda x: len(x[0])) if fits else (None, None)


URLS = [
    "http://A.Example.ORG/en/1x?y#z", "https://example.org/es/1", "http://org/x", "http://org", "http://notexample.org/es/", None, "",
    "no scheme", "http://x.com/de/", "http://x.com/fr/é?", "http://dcom/de/1", "a://b://c.com/de/", "http://h.com#/de/", "http://h.com?x=/de/",
    "http://xyz.example.org/en/2", "http://EXAMPLE.org:80/es/", "http://ÄÖ.Org/ß",
]


def test_parts_and_rules(spark):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string")
    for r in U.judge(df).collect():
        assert (r.host, r.path) == split(r.url), r.url
        text, verdict = rule(r.host, r.path)
        assert r.rule == text
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")


def model(labelled, order=U.ORDER, tau=U.TAU):
    """Smoothed probabilities of both classes by plain counting."""
    n = {v: Counter(t[i - k : i] for t, x in labelled if x == v for k in range(1, order + 1) for i in range(k, len(t) + 1)) for v in ("allow", "block")}

    def p(v, gram):
        below = p(v, gram[1:]) if len(gram) > 1 else 1 / 256
        total = sum(c for g, c in n[v].items() if len(g) == len(gram) and g[:-1] == gram[:-1])
        return (n[v][gram] + tau * below) / (total + tau)

    return {g: math.log(p("allow", g) / p("block", g)) for g in set(n["allow"]) | set(n["block"])}


def test_scores_match_brute_force(spark, sf):
    urls = [r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    texts = [("".join(split(u)), rule(*split(u))[1]) for u in urls]
    labelled = [x for x in texts if x[1]]
    ratios = model(labelled)
    df = spark.createDataFrame(texts, "text string, verdict string")
    got = U.scored(df, df["text"], U.train(df.filter("verdict is not null"))).collect()

    def score(t):
        ks = lambda i: range(min(U.ORDER, i), 0, -1)
        return sum(next((ratios[t[i - k : i]] for k in ks(i) if t[i - k : i] in ratios), 0.0) for i in range(1, len(t) + 1)) / len(t)

    # grams share slots now and then
    off = [abs(r.score - score(r.text)) for r in got]
    assert sorted(off)[len(off) // 2] < 0.02 and max(off) < 0.5
    right = [(r.score >= 0) == (r.verdict == "allow") for r in got if r.verdict]
    assert sum(right) > 0.95 * len(right)


def test_method_separates_what_it_learned(spark):
    good = [f"http://a{i}.example.com/fr/{i}" for i in range(200)]
    bad = [f"http://casino{i}.win.com/de/{i}" for i in range(200)]
    new = ["http://casino7777.win.net/de/5", "http://a55.example.net/fr/77"]
    df = spark.createDataFrame([(u,) for u in good + bad + new], "url string")
    got = {r.url: r.verdict for r in U.judge(df).collect()}
    assert [got[u] for u in new] == ["block", "allow"]


def test_edges(spark, edge_docs, no_docs):
    got = U.judge(edge_docs.withColumnRenamed("text", "url").withColumnRenamed("key", "host")).collect()
    assert len(got) == edge_docs.count() and {r.verdict for r in got} == {"allow"} and {r.score for r in got} == {0.0}
    assert U.judge(no_docs.withColumnRenamed("text", "url")).count() == 0


def test_every_gram_counts_for_itself(spark):
    """Different grams, none mixed with another's; all ways to look them up agree."""
    rng = random.Random(3)
    texts = [(f"a{rng.randrange(10**6)}.example.{c}/{p}/{rng.randrange(10**7)}", v) for c, p, v in [("org", "es", "block"), ("com", "fr", "allow")] * 60]
    texts += [(f"b{rng.randrange(10**6)}.example.net/{rng.randrange(10**7)}", None) for _ in range(40)] + [("", None)] + [("é\U0001f600", None)] * 2
    ratios = model([x for x in texts if x[1]])
    df = spark.createDataFrame(texts, "text string, verdict string")
    grams = U.train(df.filter("verdict is not null"))
    assert grams.count() == len(ratios) > 2_000
    for extra in ({}, {"broadcast_rows": 0}, {"broadcast_rows": 500}):
        got = U.scored(df, df["text"], grams, **extra).collect()
        assert sorted((r.text, r.verdict or "") for r in got) == sorted((t, v or "") for t, v in texts)
        for r in got:
            longest = [next((ratios[w[-k:]] for k in range(len(w), 0, -1) if w[-k:] in ratios), 0.0) for w in (r.text[max(0, i - U.ORDER) : i] for i in range(1, len(r.text) + 1))]
            assert abs(r.score - sum(longest) / max(1, len(longest))) < 1e-6, r


def test_clashing_names_of_the_user_stay(spark):
    from pyspark.sql import functions as F

    names = ("_text", "text", "_w", "n", "gram", "ratio", "_salt", "fold")
    pages = spark.createDataFrame([(i, f"http://a{i}.org/x{i}") for i in range(20)] + [(30, f"http://b.example.com/de/{7}"), (31, None)], "page_id long, url string")
    import rankframe.llm.urls as U

    want = {r.page_id: (r.host, r.verdict, round(r.score, 9)) for r in U.judge(pages).collect()}
    got = U.judge(pages.withColumns({n: F.lit("user") for n in names})).collect()
    assert {r.page_id: (r.host, r.verdict, round(r.score, 9)) for r in got} == want
    assert all(r[n] == "user" for r in got for n in names)
