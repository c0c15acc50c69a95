"""Main text of web pages by two-pass block rules (operator 9).

First pass: each block of text is judged alone by its length, its stop-word density and its link density. Second pass: short or
ambiguous blocks inherit the label of the nearest decided neighbours; where nothing on a page is decided, they stay. A page in a language
without a list of stop words is judged by lengths and links.

Blocks in elements that are never main text (menus, adverts, reader comments, ...) are left out before. An element is left out by its
class, id or role if one of their tokens consists of hint words alone, or starts or ends with a word for comments; other
tokens with a hint word are evidence against its blocks. A form that holds most of a page's text, and what wraps its first article, is
not left out; neither is an element without which nothing would be left (comments excepted).

Where a page marks articles, low stop-word density alone is no reason to drop a block of theirs, a block of theirs that is mostly links
goes alone and hands its label to nobody, and blocks outside go if the articles hold most of the text.
"""
from __future__ import annotations

import re
from bisect import bisect
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read_table, text_batches

# HTML element names.
FORMS, HEADS = frozenset({"form", "fieldset"}), frozenset({"header", "dialog"})
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody "
    "td tfoot th thead title tr ul".split()
)
SKIP = frozenset(
    "head title script style noscript template iframe object embed svg math canvas audio video map nav header footer aside "
    "menu form fieldset select textarea button input label dialog search".split()
)
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "body": {"head"},
}
# Parts of class, id and role values that mark other things than main text.
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu "
    "menubar breadcrumb breadcrumbs sidebar complementary aside footer contentinfo header masthead topbar toolbar cookie cookies "
    "consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login comment comments "
    "commentlist disqus reply replies respond related recommended share sharing social widget pagination pager search copyright "
    "disclaimer legal tags".split()
)
COMMENTS = frozenset("comment comments commentlist disqus reply replies respond".split())
# First parts of tokens that say something about a page or an article, not that the element is such a part.
ABOUT = frozenset("has no with without tag category is not hide show".split())
# The commonest function words of four languages.
STOP_WORDS = [
    frozenset(x.split())
    for x in (
        "the of and to a in is it that for on with as was at by an be this are from or which but not have has had its they you he she we",
        "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach bei",
        "de la le et les des en un une du que est pour qui dans sur par au pas plus ne avec ce son il elle se sont ou aux mais nous",
        "de la el que y en los se del las por un para con no una su al lo como más o pero sus le ha me si sin sobre este ya entre",
    )
]
LONG, SHORT, DENSE, SPARSE, LINKED, HINT_LINKED = 140, 60, 0.25, 0.10, 0.5, 0.2
WORDS, SENTENCE = re.compile(r"[^\W\d_]+"), re.compile(r"[.!?\u2026\u3002\uff01\uff1f](\s|$)")


# How an element is left out: not, for good, unless it holds most of the text or an article, or unless it wraps the first article or all there is.
NOT, GONE, FORM, MARKED = range(4)


def _hint(marks: str) -> tuple[bool, bool, bool]:
    """Whether some token of the class, id and role values is made of hint words alone, whether some other holds one, and whether one says comments."""
    tokens = [[x for x in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", t).lower()) if x] for t in marks.split()]
    tokens = [t for t in tokens if t and t[0] not in ABOUT]
    return (
        any(HINTS.issuperset(t) for t in tokens), any(not HINTS.isdisjoint(t) for t in tokens),
        any(t[0] in COMMENTS or t[-1] in COMMENTS for t in tokens),
    )


class _Blocks(HTMLParser):
    """Blocks in page order: [text, characters in links, inside an article, inside an element with a hint, places of its owners]; an owner is an
    element that may be left out: [how, is kept]."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[list] = []
        self.text: list[str] = []
        self.linked = 0
        # open elements: [name, how it is left out, is an article, hints outside it, place of its owner or None]
        self.open: list[list] = []
        self.owners: list[list] = []
        self.inside: list[int] = []
        self.gone = self.article = self.link = self.hint = 0
        self.seen = False

    def flush(self):
        words = " ".join("".join(self.text).split())
        if words:
            self.blocks.append([words, self.linked, self.article > 0, self.hint > 0, tuple(self.inside)])
        self.text, self.linked = [], 0

    def _pop(self):
        name, how, article, hint, owner = self.open.pop()
        if name in BLOCK or hint != self.hint or owner is not None:
            self.flush()
        self.hint = hint
        self.gone -= how == GONE
        if owner is not None:
            self.inside.remove(owner)
        self.article -= article
        self.link -= name == "a"

    def _close(self, names, stop):
        """Close the innermost of ``names`` that lies inside the innermost ``stop`` element."""
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] in names:
                while len(self.open) > at:
                    self._pop()
                return
            if self.open[at][0] in stop:
                return

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK:
            self.flush()
            self._close({"p"}, {"td", "th", "button", "caption", "object"} | SKIP)
        if tag in CLOSES:
            self._close(CLOSES[tag], {"ul", "ol", "menu", "dl", "table", "select"})
        if tag in VOID:
            if tag in ("br", "hr"):
                self.text.append(" ")
            return
        found = {k: v or "" for k, v in attrs}
        role = found.get("role", "").lower()
        article = tag in ("article", "main") or role in ("main", "article")
        marks = " ".join(found.get(k, "") for k in ("class", "id", "role"))
        hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "")
        before, how = self.hint, NOT
        if tag in SKIP and not (tag == "header" and self.article) or hidden:
            how = GONE if hidden else FORM if tag in FORMS and not self.article else MARKED if tag in HEADS else GONE
        if article and how == NOT:
            if not self.gone:
                for x in self.open:  # what wraps an article is no mere form; what wraps the first one is not left out by a hint
                    if x[4] is not None and (x[1] == FORM or not self.seen):
                        self.owners[x[4]][1] = True
                self.seen = True
            self.flush()
            self.hint = 0
        elif how == NOT and marks.strip() and tag not in ("html", "body"):
            whole, some, comments = _hint(marks)
            if comments:
                how = GONE
            elif whole:
                how = MARKED if tag in BLOCK else GONE
            elif some:
                self.flush()
                self.hint += 1
        owner = None
        if how in (FORM, MARKED):
            self.flush()
            owner = len(self.owners)
            self.owners.append([how, False])
            self.inside.append(owner)
        self.open.append([tag, how, article, before, owner])
        self.gone += how == GONE
        self.article += article
        self.link += tag == "a"

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCK:
            self._close({tag}, ())

    def handle_endtag(self, tag):
        if tag == "p" and not any(x[0] == "p" for x in self.open):
            self.flush()
            return
        stop = () if tag in ("html", "body", "article", "main", "nav", "header", "footer", "aside") else {"article", "main"}
        self._close({tag}, stop)

    def handle_data(self, data):
        if not self.gone:
            self.text.append(data)
            if self.link:
                self.linked += len(data)


def _density(text: str) -> tuple[float, int]:
    """The share of stop words of the language that has most of them, and the number of words."""
    words = WORDS.findall(text.lower())
    return (max(sum(w in stop for w in words) for stop in STOP_WORDS) / len(words) if words else 0.0), len(words)


def _first_pass(text: str, linked: int, article: bool, hint: bool = False, listed: bool = True) -> bool | str | None:
    """True: main text, False: not, ``links``: not, and no neighbour inherits it, None: undecided. ``listed``: the page's language has stop words."""
    if linked > (HINT_LINKED if hint else LINKED) * len(text):
        return "links" if article else False
    if len(text) < SHORT:
        return False if hint else None
    if article and not hint:
        return True if len(text) >= LONG else None
    if not listed:
        return None if hint or len(text) < LONG else True
    share, _ = _density(text)
    if share >= DENSE:
        return True
    if hint:
        return False
    return None if share >= SPARSE or SENTENCE.search(text) else False


def _second_pass(labels: list[bool | str | None], unsure: bool | None) -> list[bool]:
    """Undecided blocks take the nearest decided label; between two equally near ones ``unsure``, or (if that is None) the label that
    follows: a heading goes with the text under it. Where nothing is decided they are main text."""
    decided = [at for at, x in enumerate(labels) if isinstance(x, bool)]
    out = []
    for at, x in enumerate(labels):
        if x is None:
            i = bisect(decided, at)
            before, after = decided[max(i - 1, 0) : i], decided[i : i + 1]
            if not before and not after:
                x = True
            elif not before or not after:
                x = labels[(before + after)[0]]
            elif at - before[0] != after[0] - at:
                x = labels[before[0] if at - before[0] < after[0] - at else after[0]]
            else:
                x = labels[after[0]] if unsure is None or labels[before[0]] == labels[after[0]] else unsure
        out.append(x is True)
    return out


def _own(block) -> int:
    """Characters outside links."""
    return len(block[0]) - block[1]


def _kept(blocks: list[list]) -> list[str]:
    """The texts of the blocks that the two passes take for main text."""
    whole = " ".join(b[0] for b in blocks)
    listed = _density(whole)[0] >= SPARSE
    labels = [_first_pass(*b[:4], listed) for b in blocks]
    unmarked = _second_pass(labels, None)
    inside = sum(_own(b) for b in blocks if b[2])
    outside = sum(_own(b) for b, ok in zip(blocks, unmarked) if ok and not b[2])
    if inside and inside >= outside:
        pairs = [(b, x) for b, x in zip(blocks, labels) if b[2]]
        return [b[0] for (b, _), ok in zip(pairs, _second_pass([x for _, x in pairs], True)) if ok]
    return [b[0] for b, ok in zip(blocks, unmarked) if ok]


def main_text(html: str | None) -> str:
    """Main text of a page: its blocks joined by newlines; empty for none."""
    if not html:
        return ""
    parser = _Blocks()
    parser.feed(html)
    parser.close()
    parser.flush()
    owners = parser.owners
    # a form outside articles is kept if it holds over three quarters of the text that other elements do not take out
    texts = [b for b in parser.blocks if all(owners[o][0] == FORM or owners[o][1] for o in b[4])]
    total = sum(map(_own, texts))
    for at, owner in enumerate(owners):
        if owner[0] == FORM and 4 * sum(_own(b) for b in texts if at in b[4]) > 3 * total:
            owner[1] = True
    kept = _kept([b for b in parser.blocks if all(owners[o][1] for o in b[4])])
    if not kept and owners:
        kept = _kept(parser.blocks)
    return "\n".join(kept)


def extract(pages: DataFrame, html_col: str = "html", out: str = "main_text") -> DataFrame:
    """``pages`` with the main text of ``html_col`` (null and empty pages: empty text).

    Rows are independent: no shuffle; whole pages are read, broken or unclosed markup included;
    repeated rows get equal texts; an empty table gives no rows; other columns pass through
    (one named like ``out`` is replaced).
    """

    text_batches(pages.sparkSession)

    @F.pandas_udf("string")
    def texts(htmls: pd.Series) -> pd.Series:
        return htmls.map(main_text)

    return pages.withColumn(out, texts(pages[html_col]))


def op9_html_extraction(spark, sf_dir) -> DataFrame:
    pages = extract(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))
