"""Line deduplication across documents (operator 12), in DataFrame functions only.

Each long line becomes a narrow row: 128 bits of hash of its key, its document and its position; texts do not travel. The rows are
partitioned by ranges of the hash and sorted by hash, document (largest first) and position, so that one pass over a
partition meets the first occurrence of a key before the others. What goes on are the positions of the lines to drop, folded to
one compressed bitmap per document. Only documents with such a bitmap are cut.

Hot keys: a key that a sample of the documents shows in more than a range's share of them is dealt over all ranges by
document; each range streams its part, and the few part results of a hot key meet in an aggregate. The sample decides where rows
go, never what is dropped.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .common import free_names, let, read_table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z lower-cased."""
    # lower() changes nothing but A-Z in a text of one byte per character, and is much faster there
    bare = F.btrim(line, F.lit(BLANKS))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def long_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """``doc, text_hash, pos, h1, h2`` for every line whose key has at least ``min_chars`` code points."""
    lines = docs.select(
        docs[id_col].alias("doc"), F.xxhash64(docs[text_col]).alias("text_hash"),
        F.posexplode(F.split(docs[text_col], "\n", -1)).alias("pos", "line"),
    )
    # a key has no more bytes than its line
    keyed = lines.filter(F.octet_length("line") >= min_chars).select("doc", "text_hash", "pos", line_key(F.col("line")).alias("key"))
    long = keyed.filter(F.length("key") >= min_chars)
    return long.select("doc", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def _range(hashed: Column, ranges: int) -> Column:
    """The range, of ``ranges`` equal ones, that an unsigned 64-bit hash falls into."""
    return F.floor(F.shiftrightunsigned(hashed, 11) * F.lit(2.0**-53) * ranges).cast("int")


def _hot_keys(docs: DataFrame, id_col: str, text_col: str, min_chars: int, ranges: int, sample_docs: int) -> DataFrame:
    """At most ``4 * ranges`` keys ``h1, h2``: those in the largest share of about ``sample_docs`` documents, if over half a range's share."""
    n = docs.count()
    part = docs.sample(min(1.0, sample_docs / n), seed=17) if n else docs
    share = max(8, min(n, sample_docs) // (2 * ranges))
    counts = long_lines(part, id_col, text_col, min_chars).groupBy("h1", "h2").agg(F.count("*").alias("n")).filter(F.col("n") >= share)
    return counts.orderBy(F.desc("n"), "h1", "h2").limit(4 * ranges).select("h1", "h2")


def lines_to_drop(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5, sample_docs: int = 20_000
) -> DataFrame:
    """``doc, text_hash, pos``: every line whose key is in at least ``min_docs`` documents, but for those in the largest document.

    Rows of one id are one document, whatever their texts; rows with a null id are one, below every other. ``pos`` counts from 0.
    """
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    hot = _hot_keys(docs, id_col, text_col, min_chars, ranges, sample_docs).withColumn("hot", F.lit(True))
    rows = long_lines(docs, id_col, text_col, min_chars).join(F.broadcast(hot), ["h1", "h2"], "left")
    home = F.when(F.col("hot"), F.xxhash64("h1", "h2", "doc")).otherwise(F.col("h1"))
    rows = rows.withColumn("part", _range(home, ranges)).repartitionById(ranges, F.col("part"))
    # sorted once; all windows stream over the same order, none exchanges rows again
    key = Window.partitionBy("part", "h1", "h2")
    order = key.orderBy(F.desc_nulls_last("doc"), "text_hash", "pos")
    first = (F.row_number().over(order) == 1) | ~F.col("doc").eqNullSafe(F.lag("doc").over(order))
    seen = rows.withColumns({"fresh": first.cast("int"), "top": F.first("doc").over(order)})
    counted = seen.withColumn("n_docs", F.sum("fresh").over(key))
    # a cold key is decided here; the rows of hot keys wait for the counts of their parts
    left = counted.filter(F.col("hot") | ((F.col("n_docs") >= min_docs) & ~F.col("doc").eqNullSafe(F.col("top")))).checkpoint()
    cold = left.filter("hot is null")
    heat = left.filter("hot")
    whole = heat.groupBy("h1", "h2").agg(F.sum("fresh").alias("all_docs"), F.max("doc").alias("last")).filter(F.col("all_docs") >= min_docs)
    # at most 4 * ranges rows
    warm = heat.join(F.broadcast(whole), ["h1", "h2"]).filter(~F.col("doc").eqNullSafe(F.col("last")))
    return cold.select("doc", "text_hash", "pos").unionByName(warm.select("doc", "text_hash", "pos"))


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """``doc, text_hash, keep, n_dropped`` for every different (id, text) that loses lines.

    ``keep`` holds one bit per line, 1 for lines that stay, in 64-bit words from the lowest bit on: an array of ``(full, bits)``,
    ``full`` words of ones and then the word ``bits``; ones follow the last. It is as long as the document has words with a zero.
    """
    gone = lines_to_drop(docs, id_col, text_col, **params)
    word, bit = F.shiftright("pos", 6), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("pos") % 64)
    words = gone.groupBy("doc", "text_hash", word.alias("word")).agg(F.bit_or(bit).alias("gone"))
    listed = words.groupBy("doc", "text_hash").agg(
        F.sort_array(F.collect_list(F.struct("word", "gone"))).alias("words"), F.sum(F.bit_count("gone")).cast("long").alias("n_dropped")
    )
    before = lambda i: F.coalesce(F.get("words", i - 1)["word"], F.lit(-1))
    runs = F.transform("words", lambda x, i: F.struct((x["word"] - before(i) - 1).alias("full"), F.bitwise_not(x["gone"]).alias("bits")))
    return listed.select("doc", "text_hash", runs.alias("keep"), "n_dropped")


def kept_lines(lines: Column, keep: Column) -> Column:
    """The lines of an array whose bit in a bitmap of ``keep_bitmaps`` is one."""
    ones = F.lit(-1).cast("long")
    words = F.flatten(F.transform(keep, lambda r: F.concat(F.array_repeat(ones, r["full"]), F.array(r["bits"]))))
    stays = lambda w, i: F.getbit(F.coalesce(F.get(w, F.shiftright(i, 6)), ones), i % 64) == 1
    return let(words, lambda w: F.filter(lines, lambda _, i: stays(w, i)))


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", out: str = "lines", broadcast_bytes: int = 32 << 20, **params
) -> DataFrame:
    """``docs`` with the struct ``out``: ``n_lines`` and ``n_dropped`` (long) and ``text``, the kept lines joined by line feeds.

    A null or empty text is one empty line. A document that loses all its lines has an empty text. Lines with a short key always
    stay. Repeated rows get equal results; an empty table gives no rows; other columns pass through whatever their names (one named
    like ``out`` is replaced). The bitmaps are written, measured, and broadcast up to ``broadcast_bytes``; beyond, documents and
    bitmaps meet by id and text hash.
    """
    bitmaps = keep_bitmaps(docs, id_col, text_col, **params).checkpoint()
    doc, text_hash, keep, n_dropped, key = free_names([*docs.columns, out], "doc", "text_hash", "keep", "n_dropped", "key")
    size = bitmaps.agg(F.sum(F.size("keep") * 16 + 64)).first()[0] or 0
    # plain equality on two columns, null ids under a mark of their own
    mark = lambda c: F.struct(F.coalesce(c.cast("string"), F.lit("")), c.isNull())
    maps = bitmaps.select(mark(F.col("doc")).alias(key), F.col("text_hash").alias(text_hash), F.col("keep").alias(keep), F.col("n_dropped").alias(n_dropped))
    keyed = docs.withColumns({key: mark(docs[id_col]), text_hash: F.xxhash64(docs[text_col])})
    met = keyed.join(F.broadcast(maps) if size <= broadcast_bytes else maps, [key, text_hash], "left")
    whole = F.coalesce(F.col(text_col), F.lit(""))
    cut = F.array_join(kept_lines(F.split(whole, "\n", -1), F.col(keep)), "\n")
    breaks = F.octet_length(whole) - F.octet_length(F.replace(whole, F.lit("\n"), F.lit("")))
    result = F.struct(
        (breaks + 1).cast("long").alias("n_lines"),
        F.coalesce(n_dropped, F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col(keep).isNull(), whole).otherwise(cut).alias("text"),
    )
    return met.select(*[c for c in docs.columns if c.lower() != out.lower()], result.alias(out))


def op12_line_dedup(spark, sf_dir) -> DataFrame:
    found = dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "lines.n_lines", "lines.n_dropped", F.sha2(F.col("lines.text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = f"""
WITH l AS (
  SELECT doc_id, generate_subscripts(s, 1) AS pos, unnest(s) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents)),
k AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM l),
g AS (
  SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (
  SELECT k.doc_id, k.pos, k.line, coalesce(k.doc_id <> g.top, FALSE) AS gone FROM k LEFT JOIN g ON k.key = g.key)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
