import random
from functools import cache

import pytest

from rankframe.llm import pieces as P

MODEL = P.default_model()


@pytest.fixture(scope="module")
def vocab():
    return P.vocabulary(MODEL)


ALPHABET = "abcdefgh the ing tion  \n\té\U0001f600中文x.,-0123'\""


def made_texts(n, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(ALPHABET) for _ in range(r.randrange(1, 60))) for _ in range(n)] + [
        "water running the  three   spaces ", " lead", "trail  ", "   ", "a\n\n  b", "\u65e5本語のテキスト", "x" * 5000, "ab" * 3000, "z", " ",
    ]


def test_bpe_ids_are_the_librarys(vocab, spark, sf):
    """All words of the documents and made texts: equal ids, where the text holds no mark of its own."""
    import sentencepiece

    assert vocab.kind == "bpe"
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + made_texts(1000)
    ids, edges, counts = P._encode_batch(texts, vocab)
    for k, t in enumerate(texts):
        own = ids[edges[k] : edges[k + 1]].tolist()
        assert own == lib.encode(t) and P.decode_ids(own, vocab) == t and counts[k] == len(t.split(" "))
    for word in ("the", "water", "running"):
        assert len(P.encode_words([P.MARK + word], vocab)[0]) == 1


def test_units_cover_every_text(vocab):
    for t in made_texts(500, 4) + ["a.b,c\n\nd e.", "..", "x)y(z", "1.5a 2,b", "_a.b_", "Ünï,çødé."]:
        marked = P.MARK + t.replace(" ", P.MARK)
        units = vocab.units.findall(marked)
        assert "".join(units) == marked and all(units)
    assert vocab.units.findall("▁word,▁word.\nNext") == ["▁word,", "▁word.", "\n", "Next"]


def test_prefix_sharing_changes_nothing(vocab):
    words = sorted({u for t in made_texts(400, 2) for u in vocab.units.findall(P.MARK + t.replace(" ", P.MARK))})
    assert P.encode_words(words, vocab) == [P.encode_words([w], vocab)[0] for w in words]


def small_unigram():
    v = P.Vocabulary.__new__(P.Vocabulary)
    r = random.Random(5)
    strings = {c for c in "▁abcd"} | {"".join(r.choice("abcd") for _ in range(r.randint(2, 5))) for _ in range(60)} | {"▁" + "ab"[: r.randint(1, 2)] for _ in range(4)}
    v.scores = {p: (-r.uniform(1, 12), 300 + i) for i, p in enumerate(sorted(strings))}
    v.byte_ids, v.kind = {b: b for b in range(256)}, "unigram"
    v._index()
    return v


def test_unigram_path_has_the_best_score():
    v, r = small_unigram(), random.Random(6)
    by_id = {i: s for s, i in v.scores.values()}
    words = sorted({"▁" + "".join(r.choice("abcdz") for _ in range(r.randint(0, 12))) for _ in range(500)})
    for word, ids in zip(words, P.encode_words(words, v)):

        @cache
        def best(end):
            if not end:
                return 0.0
            covered = [best(a) + v.scores[word[a:end]][0] for a in range(end) if word[a:end] in v.scores]
            return max([*covered, best(end - 1) + v.lone_score])

        # "z" has no piece: its byte stands for one lone character
        assert abs(sum(by_id.get(i, v.lone_score) for i in ids) - best(len(word))) < 1e-9
        assert ids == P.encode_words([word], v)[0]


def test_round_trip(spark, sf, edge_docs, no_docs):
    docs = edge_docs.select("doc_id", "text").unionByName(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))
    got = P.decode(P.encode(docs, MODEL), MODEL).collect()
    assert len(got) == docs.count()
    for r in got:
        assert r.decoded == r.text
        assert (r.ids is None) == (r.text is None)
    assert [r.ids for r in got if r.text == ""] == [[]]
    both = P.encode_decode(docs, MODEL)
    assert both.filter("not round_trip").count() == 0
    assert P.encode_decode(no_docs, MODEL).count() == 0
    clash = P.decode(P.encode(edge_docs, MODEL), MODEL)
    assert clash.columns.count("ids") == 1 and clash.count() == edge_docs.count()


def test_marks_in_the_text_and_library_decoding(spark, vocab):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = ["the cat sat on the mat", "über élan \U0001f600", "two  spaces and\nlines", "a▁b ▁c▁", "▁", "▁▁ ▁"]
    ids, edges, _ = P._encode_batch(texts, vocab)
    for k, t in enumerate(texts):
        own = ids[edges[k] : edges[k + 1]].tolist()
        assert P.decode_ids(own, vocab) == t
        if P.MARK not in t:
            assert lib.decode(own) == t


def test_memory_is_bounded(vocab):
    small = P.Vocabulary(MODEL)
    texts = made_texts(300, 3)
    first = P._encode_batch(texts, small, memory=10)
    again = P._encode_batch(texts, small, memory=10)
    assert [x.tolist() for x in first[:2]] == [x.tolist() for x in again[:2]]
    assert small.stand("▁", "the", most=1) in (True, False) and len(small.pairs) <= 1
