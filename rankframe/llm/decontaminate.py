"""Benchmark decontamination by spaced-seed hashing (operator 10), in DataFrame functions only.

Texts become lower-case words of letters and digits. A mask selects some of the words in a window; the hash of the selected
words is the window's key, so a changed word at an ignored position does not change it. Document
windows meet benchmark windows by an equi-join on the keys. Each hit is verified on its diagonal: some run of
``window`` benchmark words (all of a shorter item) around it must agree with the document in ``similarity`` of the positions.
The masks are chosen so that every run that agrees enough holds a hit: nothing the verification accepts is missed.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.key_filter import filter_words, key_filter, may_match
from ..session import ensure_checkpoint_dir
from .common import free_names, let, read_table

# Masks by the shortest item they are for. Wherever the allowed number of words differs (2 of 10 to 13, 1 of 5 to
# 9), some mask of the family lies on equal words only; longer items allow more words per mask, so fewer chance hits.
# ``MASKS`` alone does so for all lengths.
MASKS = ("1111", "11011", "11101", "10111")
FAMILIES = {5: MASKS, 10: ("111011", "11010011", "1100001011"), 13: ("11101111", "1111010011", "100100110111")}
WINDOW, SIMILARITY, LEAST = 13, 0.8, 5
CHUNK = 4096  # words of a text that are windowed at once


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _windows(df: DataFrame, masks: list[str], position: str, back: int, ahead: int) -> DataFrame:
    """Rows of ``df`` without ``h`` (the word hashes), one for each window and mask: ``key``, ``position`` (0-based) and
    ``near``, the hashes from ``back`` words before the position to ``ahead`` from it on (null outside the text).

    Long texts are first cut into chunks that overlap by what a window needs, so a row holds a bounded number of words.
    All masks read the same shifted copies of a chunk; a window that passes the end of the text has no key.
    """
    kept = [c for c in df.columns if c != "h"]
    padded = F.concat(F.array_repeat(F.lit(None).cast("long"), back), F.col("h"))
    starts = F.when(F.size("h") > 0, F.sequence(F.lit(0), F.size("h") - 1, F.lit(CHUNK)))
    chunks = let(
        padded, lambda h: F.transform(starts, lambda at: F.struct(at.alias("at"), F.slice(h, at + 1, CHUNK + back + ahead - 1).alias("g")))
    )
    cut = df.select(*kept, F.explode(chunks).alias("_c"))
    shifted = [F.slice("_c.g", i + 1, CHUNK).alias(f"w{i}") for i in range(back + ahead)]
    zipped = cut.select(*kept, F.col("_c.at").alias("_at"), F.posexplode(F.arrays_zip(*shifted)).alias("_i", "_w"))
    word = lambda i: F.col(f"_w.w{i + back}")
    key = [
        F.when(word(len(m) - 1).isNotNull() & word(0).isNotNull(), F.xxhash64(F.lit(no), *[word(i) for i, x in enumerate(m) if x == "1"]))
        for no, m in enumerate(masks)
    ]
    near = F.array(*[F.col(f"_w.w{i}") for i in range(back + ahead)])
    keyed = zipped.select(*kept, (F.col("_at") + F.col("_i")).alias(position), near.alias("near"), F.posexplode(F.array(*key)).alias("_mask", "key"))
    return keyed.filter("key is not null")


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    masks: dict[int, tuple[str, ...]] = FAMILIES,
    window: int = WINDOW,
    similarity: float = SIMILARITY,
    least: int = LEAST,
    broadcast_words: int = 200_000,
) -> DataFrame:
    """Verified overlaps, one row for each (``doc_id``, ``text_hash``, ``item_id``) with the number of hits ``n_hits`` and the
    first document word ``first_word`` of one.

    An item is searched by the family of ``masks`` with the largest key up to its number of words. The given families find every
    run that agrees enough at the given ``window`` and ``similarity``; other values need others. Items of fewer than ``least`` words
    match a line of the same words, no more and no fewer. Null and empty texts match nothing. Null ids are kept as
    null; rows with equal id and text share one result; empty tables give no rows; only the named columns are read.
    The benchmark's windows (a fixed number of hashes each) are broadcast when it has at most ``broadcast_words`` words. Beyond, the
    documents' windows first meet a filter of the benchmark's keys, of bounded size; those that may have a partner are joined by key.
    """
    if min(masks) > least:
        raise ValueError("items of ``least`` words need masks")
    for shortest, family in masks.items():
        for m in family:
            if m[0] + m[-1] != "11" or len(m) > shortest:
                raise ValueError("a mask begins and ends with a selected word and fits in its items")
    hashes = lambda text: F.transform(words(text), lambda w: F.xxhash64(w))
    every_item = benchmark.select(benchmark[item_col].alias("item_id"), hashes(benchmark[item_text]).alias("h"))
    items, short = every_item.filter(F.size("h") >= least), every_item.filter((F.size("h") > 0) & (F.size("h") < least))
    family = F.greatest(F.lit(0), *[F.when(F.size("h") >= k, k) for k in masks])
    # one row; at most as many families as ``masks`` has
    total, present = items.agg(F.sum(F.size("h")), F.collect_set(family)).first()
    chosen = [(k, m) for k in sorted(present) or [max(masks)] for m in masks[k]]
    every = [m for _, m in chosen]
    spans = F.array(*[F.lit(len(m)) for m in every])
    # a run that holds a window begins at most ``back`` words before it and ends at most ``ahead`` after its first
    back = max(0, window - min(map(len, every)))
    ahead = max(window, max(map(len, every)))
    grams = _windows(items.withColumns({"item_n": F.size("h"), "_family": family}), every, "item_pos", back, ahead)
    grams = grams.withColumn("span", F.get(spans, F.col("_mask")))
    # an item has keys by the masks of its own family only
    grams = grams.filter(F.get(F.array(*[F.lit(k) for k, _ in chosen]), F.col("_mask")) == F.col("_family"))
    grams = grams.select("key", "span", "item_id", "item_pos", "item_n", F.col("near").alias("item_near"))
    texts = docs.select(docs[id_col].alias("doc_id"), F.xxhash64(docs[text_col]).alias("text_hash"), hashes(docs[text_col]).alias("h"))
    found_windows = _windows(texts, every, "doc_pos", back, ahead).drop("_mask")
    if (total or 0) <= broadcast_words:
        grams = F.broadcast(grams)
    else:
        n_words = filter_words(total * max(len(masks[k]) for k in present))
        found_windows = may_match(found_windows, F.col("key"), key_filter(grams, "key", n_words), n_words)
        grams = grams.hint("merge")  # Spark takes the exploded windows for as small as the benchmark's file and would broadcast them
    hits = found_windows.join(grams, "key")
    length = F.least(F.lit(window), F.col("item_n"))

    def agrees(x):
        at = lambda j: j - F.col("item_pos") + back
        same = lambda j: F.get("near", at(j)) == F.get("item_near", at(j))
        run = lambda at: F.size(F.filter(F.sequence(at, at + x["n"] - 1), same))
        return F.exists(F.sequence(x["lo"], x["hi"]), lambda at: run(at) >= F.ceil(x["n"] * similarity))

    # runs of ``length`` words that hold the window, or that lie in it
    lo = F.greatest(F.lit(0), F.least(F.col("item_pos"), F.col("item_pos") + F.col("span") - length))
    hi = F.greatest(lo, F.least(F.greatest(F.col("item_pos"), F.col("item_pos") + F.col("span") - length), F.col("item_n") - length))
    verified = hits.filter(let(F.struct(length.alias("n"), lo.alias("lo"), hi.alias("hi")), agrees))
    found = verified.groupBy("doc_id", "text_hash", "item_id").agg(F.count("*").alias("n_hits"), F.min("doc_pos").alias("first_word"))
    return found if short.isEmpty() else found.unionByName(_equal_lines(docs, short, id_col, text_col, least, broadcast_words))


def _equal_lines(docs: DataFrame, short: DataFrame, id_col: str, text_col: str, least: int, broadcast_rows: int) -> DataFrame:
    """Overlaps with items of fewer than ``least`` words: lines of the text whose words are exactly the item's (``first_word`` is null)."""
    lines = docs.select(
        docs[id_col].alias("doc_id"), F.xxhash64(docs[text_col]).alias("text_hash"), F.explode(F.split(docs[text_col], "\n", -1)).alias("line")
    ).select("doc_id", "text_hash", F.transform(words(F.col("line")), lambda w: F.xxhash64(w)).alias("h")).filter((F.size("h") > 0) & (F.size("h") < least))
    if short.count() <= broadcast_rows:
        short = F.broadcast(short)
    return lines.join(short, "h").groupBy("doc_id", "text_hash", "item_id").agg(F.count("*").alias("n_hits"), F.lit(None).cast("int").alias("first_word"))


def flag(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """``doc_id, contaminated, n_items, item_ids`` (sorted, comma-joined) for every row of ``docs``."""
    per_doc = (
        contaminated(docs, benchmark, id_col, text_col, **params)
        .groupBy("doc_id", "text_hash")
        .agg(F.sort_array(F.collect_set("item_id")).alias("items"))  # as many as the benchmark at most
        .withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})
    )
    rows = docs.select(docs[id_col].alias("doc_id"), F.xxhash64(docs[text_col]).alias("text_hash"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
    return rows.join(per_doc, same, "left").select(
        "doc_id",
        F.col("items").isNotNull().alias("contaminated"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce(F.array_join(F.transform("items", lambda x: x.cast("string")), ","), F.lit("")).alias("item_ids"),
    )


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 200_000, **params
) -> DataFrame:
    """The rows of ``docs``, all columns, without a verified overlap.

    The keys of the documents to drop are written and counted; up to ``broadcast_rows`` of them (two longs each) are broadcast, so
    the texts are not shuffled; beyond, the join is by key.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    bad_id, bad_hash = free_names(docs.columns, "bad_id", "bad_hash")
    bad = contaminated(docs, benchmark, id_col, text_col, **params).select(
        F.col("doc_id").alias(bad_id), F.col("text_hash").alias(bad_hash)
    ).distinct().checkpoint()
    if bad.count() <= broadcast_rows:
        bad = F.broadcast(bad)
    same = docs[id_col].eqNullSafe(F.col(bad_id)) & (F.xxhash64(docs[text_col]) == F.col(bad_hash))
    return docs.join(bad, same, "left_anti")


def op10_benchmark_decontamination(spark, sf_dir) -> DataFrame:
    return flag(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def _oracle_windows(table: str, ident: str, pos: str) -> str:
    parts = []
    for no, m in enumerate(MASKS):
        key = " || ' ' || ".join(f"w[p + {i}]" for i, x in enumerate(m) if x == "1")
        parts.append(f"SELECT {ident}, w, p - 1 AS {pos}, {no} AS mask, {len(m)} AS span, {key} AS key FROM (SELECT {ident}, w, unnest(range(1, len(w) - {len(m) - 2})) AS p FROM {table})")
    return " UNION ALL ".join(parts)


# ``MASKS`` for all items, which finds the same overlaps; items of under ``LEAST`` words (none in the given tables) are left to the tests.
ORACLE = f"""
WITH d AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS w FROM benchmark),
dw AS ({_oracle_windows("d", "doc_id", "dp")}),
bw AS ({_oracle_windows("b", "item_id", "ip")}),
hits AS (SELECT dw.doc_id, dw.w AS dws, dp, bw.item_id, bw.w AS bws, ip, dw.span, least({WINDOW}, len(bw.w)) AS n
         FROM dw JOIN bw ON dw.mask = bw.mask AND dw.key = bw.key),
ranged AS (SELECT *, greatest(0, least(ip, ip + span - n)) AS lo, greatest(ip, ip + span - n) AS top, len(bws) - n AS last FROM hits),
good AS (SELECT DISTINCT doc_id, item_id FROM ranged WHERE len(list_filter(range(lo, greatest(lo, least(top, last)) + 1), lambda a:
    len(list_filter(range(a, a + n), lambda j: dp + j - ip >= 0 AND dws[dp + j - ip + 1] = bws[j + 1])) >= ceil(n * {SIMILARITY}))) > 0),
per AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) AS item_ids FROM good GROUP BY doc_id)
SELECT d.doc_id, per.doc_id IS NOT NULL AS contaminated, coalesce(n_items, 0) AS n_items, coalesce(item_ids, '') AS item_ids
FROM documents d LEFT JOIN per ON d.doc_id IS NOT DISTINCT FROM per.doc_id
"""
