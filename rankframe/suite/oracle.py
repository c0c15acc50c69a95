"""DuckDB twins of the registered queries (tables are the driver's parquet views)."""
from __future__ import annotations

from . import sqlparts as S

ORACLE: dict[str, str] = {}

ORACLE["bm25_top10"] = f"""
WITH {S.bm25_scores()},
{S.ranked_all_pairs("b_sc", "b_d2", S.QUERIES, 10, "bm25", "run")}
SELECT * FROM run"""

ORACLE["tfidf_top10"] = f"""
WITH t_d AS (SELECT doc_id, {S.tok('text')} AS toks FROM ({S.DOCS})),
t_st AS (SELECT count(*) AS n FROM t_d),
t_post AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(toks) AS term FROM t_d) GROUP BY doc_id, term),
t_idf AS (SELECT term, ln((1 + n) / (1 + count(*))) + 1 AS idf FROM t_post, t_st GROUP BY term, n),
t_dn AS (SELECT doc_id, sqrt(sum((tf * idf) * (tf * idf))) AS dn FROM t_post JOIN t_idf USING (term) GROUP BY doc_id),
t_qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({S.tok('text')}) AS term FROM ({S.QUERIES})) GROUP BY query_id, term),
t_qw AS (SELECT query_id, term, qtf * idf AS w, idf FROM t_qt JOIN t_idf USING (term)),
t_qn AS (SELECT query_id, sqrt(sum(w * w)) AS qn FROM t_qw GROUP BY query_id),
t_sc AS (SELECT query_id, doc_id, sum(w * tf * idf) / (any_value(qn) * any_value(dn)) AS score
         FROM t_qw JOIN t_qn USING (query_id) JOIN t_post USING (term) JOIN t_dn USING (doc_id) GROUP BY query_id, doc_id),
{S.ranked_all_pairs("t_sc", "t_d", S.QUERIES, 10, "tfidf", "run")}
SELECT * FROM run"""

ORACLE["qrels"] = f"""
WITH {S.QRELS}
SELECT * FROM qrels"""

ORACLE["bm25_eval"] = f"""
WITH {S.bm25_scores()},
{S.ranked_all_pairs("b_sc", "b_d2", S.QUERIES, 100, "bm25", "run")},
{S.QRELS},
{S.evaluate("run", "qrels", "ev")}
SELECT * FROM ev"""

ORACLE["bm25_eval_per_query"] = f"""
WITH {S.bm25_scores()},
{S.ranked_all_pairs("b_sc", "b_d2", S.QUERIES, 100, "bm25", "run")},
{S.QRELS},
{S.evaluate("run", "qrels", "ev", per_query=True)}
SELECT * FROM ev"""


# ------------------------------------------------------------------ statistics
from ..plans.permute import permuted_sql  # noqa: E402
from ..sources.testdata import STOPWORDS  # noqa: E402

_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
_WORDS = f"""
s_d AS (SELECT doc_id, {S.tok('text')} AS toks FROM ({S.DOCS})),
s_w AS (SELECT unnest(toks) AS word FROM s_d),
s_tf AS (SELECT word, CAST(count(*) AS BIGINT) AS count, word IN ({_STOP}) AS is_stopword FROM s_w GROUP BY word)"""

ORACLE["collection_stats"] = f"""
WITH {_WORDS}
SELECT (SELECT count(*) FROM s_d) AS n_docs,
       (SELECT CAST(sum(len(toks)) AS BIGINT) FROM s_d) AS total_words,
       round((SELECT sum(len(toks)) FROM s_d) / (SELECT count(*) FROM s_d), 6) AS avg_doc_len,
       (SELECT count(*) FROM s_tf) AS unique_words,
       round((SELECT avg(length(word)) FROM s_tf), 6) AS avg_unique_word_len,
       round((SELECT avg(length(word)) FROM s_w), 6) AS avg_word_len"""

ORACLE["term_freq"] = f"""
WITH {_WORDS}
SELECT * FROM s_tf"""

ORACLE["term_freq_table"] = f"""
WITH {_WORDS}
SELECT * FROM s_tf WHERE NOT is_stopword"""

ORACLE["stopword_coverage"] = f"""
WITH {_WORDS}
SELECT CAST(sum(CASE WHEN is_stopword THEN count ELSE 0 END) AS BIGINT) AS stop_occurrences,
       CAST(sum(count) AS BIGINT) AS total_occurrences,
       round(100.0 * sum(CASE WHEN is_stopword THEN count ELSE 0 END) / sum(count), 6) AS stop_percent
FROM s_tf"""

ORACLE["top_words"] = f"""
WITH {_WORDS}
SELECT 'top_nonstop' AS list, word, count FROM (SELECT * FROM s_tf ORDER BY count DESC, word LIMIT 30) WHERE NOT is_stopword
UNION ALL
SELECT 'expansion' AS list, word, count FROM (SELECT * FROM s_tf WHERE NOT is_stopword ORDER BY count DESC, word LIMIT 15)"""

ORACLE["zipf"] = f"""
WITH {_WORDS},
z_all AS (SELECT 'all' AS list, row_number() OVER (ORDER BY count DESC, word) AS rank, word, count FROM s_tf),
z_ns AS (SELECT 'no_stop' AS list, row_number() OVER (ORDER BY count DESC, word) AS rank, word, count FROM s_tf WHERE NOT is_stopword)
SELECT list, rank, word, count, CAST((SELECT max(count) FROM z_all) AS DOUBLE) / rank AS ideal FROM z_all
UNION ALL
SELECT list, rank, word, count, CAST((SELECT max(count) FROM z_ns) AS DOUBLE) / rank AS ideal FROM z_ns"""

ORACLE["bigrams"] = f"""
WITH bg_d AS (SELECT {S.tok('text')} AS toks FROM ({S.DOCS})),
bg_p AS (SELECT toks[i] AS w1, toks[i + 1] AS w2 FROM (SELECT toks, unnest(range(1, len(toks))) AS i FROM bg_d)),
bg_c AS (SELECT w1 || '_' || w2 AS bigram, count(*) AS count,
                bool_and(w1 NOT IN ({_STOP}) AND w2 NOT IN ({_STOP})) AS keep FROM bg_p GROUP BY bigram)
SELECT 'all' AS list, bigram, count FROM bg_c
UNION ALL
SELECT 'no_stop' AS list, bigram, count FROM bg_c WHERE keep"""

_HEAPS = f"""
h_d AS (SELECT row_number() OVER (ORDER BY CAST(doc_id AS BIGINT)) AS ord, {S.tok('text')} AS toks FROM ({S.DOCS})),
h_d2 AS (SELECT ord, toks, len(toks) AS dl, sum(len(toks)) OVER (ORDER BY ord ROWS UNBOUNDED PRECEDING) - len(toks) AS off FROM h_d),
h_occ AS (SELECT ord, off + i - 1 AS gpos, toks[i] AS word FROM (SELECT ord, off, toks, unnest(range(1, len(toks) + 1)) AS i FROM h_d2)),
h_n AS (SELECT n, CAST(floor(sqrt(n - 1)) AS BIGINT) + 1 AS a FROM (SELECT CAST(sum(dl) AS BIGINT) AS n FROM h_d2)),
h_size AS (SELECT n, a, (n + a - 1) // a AS b FROM h_n),
h_perm AS (SELECT word, {permuted_sql("CAST(gpos AS BIGINT)", "n", "a", "b", 42)} AS slot FROM h_occ, h_size),
h_dealt AS (SELECT o.ord, p.word FROM h_perm p JOIN h_occ o ON p.slot = o.gpos),
h_src AS (SELECT 'original' AS variant, ord, word FROM h_occ UNION ALL SELECT 'shuffled' AS variant, ord, word FROM h_dealt),
h_first AS (SELECT variant, word, min(ord) AS ord FROM h_src GROUP BY variant, word),
h_new AS (SELECT variant, ord, count(*) AS n FROM h_first GROUP BY variant, ord),
h_v AS (SELECT * FROM (VALUES ('original'), ('shuffled')) t(variant)),
heaps AS (SELECT v.variant, d.ord,
       CAST(sum(d.dl) OVER (PARTITION BY v.variant ORDER BY d.ord ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total_words,
       CAST(sum(coalesce(n.n, 0)) OVER (PARTITION BY v.variant ORDER BY d.ord ROWS UNBOUNDED PRECEDING) AS BIGINT) AS unique_words
  FROM h_v v CROSS JOIN h_d2 d LEFT JOIN h_new n ON n.variant = v.variant AND n.ord = d.ord)"""

ORACLE["heaps"] = f"""
WITH {_HEAPS}
SELECT * FROM heaps"""

ORACLE["heaps_fit"] = f"""
WITH {_HEAPS}
SELECT variant, round(regr_slope(ln(unique_words), ln(total_words)), 6) AS beta,
       round(exp(regr_intercept(ln(unique_words), ln(total_words))), 6) AS K
FROM heaps GROUP BY variant"""

_QSTATS = f"""
{S.QRELS},
qs_q AS (SELECT query_id, len({S.tok('text')}) AS query_length_words FROM ({S.QUERIES})),
qs_r AS (SELECT query_id, count(DISTINCT doc_id) AS relevant_docs_count FROM qrels WHERE relevance <> 0 GROUP BY query_id),
qs AS (SELECT q.query_id, CAST(q.query_length_words AS INTEGER) AS query_length_words,
              coalesce(r.relevant_docs_count, 0) AS relevant_docs_count FROM qs_q q LEFT JOIN qs_r r USING (query_id))"""

ORACLE["query_stats"] = f"""
WITH {_QSTATS}
SELECT count(DISTINCT query_id) AS n_queries, round(avg(query_length_words), 6) AS avg_query_len,
       round(avg(relevant_docs_count), 6) AS avg_relevant_docs FROM qs"""

ORACLE["query_stats_per_query"] = f"""
WITH {_QSTATS}
SELECT * FROM qs"""


# ------------------------------------------------------------------ grids and splits
from .queries import GRID, GRID_B, RUN_K  # noqa: E402

_SPLIT = f"""
sp_q AS (SELECT query_id, text FROM ({S.QUERIES})),
sp_r AS (SELECT query_id, row_number() OVER (ORDER BY md5('42:' || query_id), query_id) AS o FROM (SELECT DISTINCT query_id FROM sp_q)),
sp AS (SELECT q.query_id, q.text, CASE WHEN r.o <= floor((SELECT count(*) FROM sp_r) * 0.1) THEN 'vali' ELSE 'train' END AS split
       FROM sp_q q JOIN sp_r r USING (query_id))"""

ORACLE["query_split"] = f"""
WITH {_SPLIT}
SELECT query_id, split FROM sp"""

_GRID_VALUES = ", ".join(f"({k1}, {b})" for k1, b in GRID)


def _grid_runs(split: str, top_k: int, grid_values: str = _GRID_VALUES, docs: str = S.DOCS, queries: str = "sp") -> str:
    return f"""
{S.bm25_scores(docs=docs, queries=f"SELECT query_id, text FROM {queries} JOIN (SELECT query_id, split FROM sp) USING (query_id) WHERE split = '{split}'" if queries != "sp" else f"SELECT query_id, text FROM sp WHERE split = '{split}'", prefix='g')},
g_grid AS (SELECT CAST(k1 AS DOUBLE) AS k1, CAST(b AS DOUBLE) AS b FROM (VALUES {grid_values}) t(k1, b)),
g_sc2 AS (SELECT g_grid.k1, g_grid.b, query_id, doc_id,
             sum(qtf * idf * tf * (g_grid.k1 + 1) / (tf + g_grid.k1 * (1 - g_grid.b + g_grid.b * dl / avgdl))) AS score
          FROM g_qt JOIN g_idf USING (term) JOIN g_tf USING (term) CROSS JOIN g_st CROSS JOIN g_grid
          GROUP BY g_grid.k1, g_grid.b, query_id, doc_id),
g_all AS (SELECT gg.k1, gg.b, qq.query_id, dd.doc_id, round(coalesce(s.score, 0.0), 6) AS score
          FROM (SELECT DISTINCT query_id FROM sp WHERE split = '{split}') qq CROSS JOIN g_d2 dd CROSS JOIN g_grid gg
          LEFT JOIN g_sc2 s ON s.query_id = qq.query_id AND s.doc_id = dd.doc_id AND s.k1 = gg.k1 AND s.b = gg.b),
g_run AS (SELECT k1, b, query_id, doc_id, score,
                 'bm25_k1_' || CAST(k1 AS VARCHAR) || '_b_' || CAST(b AS VARCHAR) AS run_name
          FROM (SELECT *, row_number() OVER (PARTITION BY k1, b, query_id ORDER BY score DESC, doc_id) AS rank FROM g_all)
          WHERE rank <= {top_k})"""


_GRID_LONG = f"""
{_SPLIT},
{_grid_runs('vali', 10)},
{S.QRELS},
qrels_vali AS (SELECT q.* FROM qrels q JOIN sp USING (query_id) WHERE sp.split = 'vali'),
qrels_train AS (SELECT q.* FROM qrels q JOIN sp USING (query_id) WHERE sp.split = 'train'),
{S.evaluate("g_run", "qrels_vali", "gl", group=["k1", "b"], measures=[("P@10", "P", 10)], digits=12)}"""

ORACLE["bm25_grid"] = f"""
WITH {_GRID_LONG}
SELECT k1, b, round("P@10", 6) AS "P@10" FROM gl"""

ORACLE["bm25_grid_pivot"] = f"""
WITH {_GRID_LONG}
SELECT k1, {", ".join(f'max(CASE WHEN b = {b} THEN round("P@10", 4) END) AS "b={float(b)}"' for b in GRID_B)}
FROM gl GROUP BY k1"""

ORACLE["bm25_grid_marginals"] = f"""
WITH {_GRID_LONG},
gm AS (SELECT k1, b, round("P@10", 4) AS m FROM gl)
SELECT k1, b, 'cell' AS kind, round(m, 6) AS value FROM gm
UNION ALL SELECT k1, NULL, 'row_mean', round(avg(m), 6) FROM gm GROUP BY k1
UNION ALL SELECT NULL, b, 'col_mean', round(avg(m), 6) FROM gm GROUP BY b"""

ORACLE["bm25_grid_best"] = f"""
WITH {_GRID_LONG}
SELECT k1, b, round("P@10", 4) AS "P@10" FROM gl ORDER BY round("P@10", 4) DESC, k1, b LIMIT 2"""

ORACLE["bm25_tuned_eval"] = f"""
WITH {_GRID_LONG},
best AS (SELECT k1, b FROM gl ORDER BY round("P@10", 4) DESC, k1, b LIMIT 2),
{_grid_runs('train', RUN_K, "(0, 0)").replace("g_grid AS (SELECT CAST(k1 AS DOUBLE) AS k1, CAST(b AS DOUBLE) AS b FROM (VALUES (0, 0)) t(k1, b))", "g_grid AS (SELECT * FROM best)").replace("g_", "t_")},
{S.evaluate("t_run", "qrels_train", "te", group=["run_name"], measures=S.RUN_MEASURES, digits=4)}
SELECT * FROM te"""


# ------------------------------------------------------------------ dense, re-ranking, fusion
from .queries import CANDIDATE_K, EMBED_DIM, RERANK_KS, SWEEP_DIMS  # noqa: E402


def _hashed(src: str, dim: int, out: str) -> str:
    """CTE ``out(id, embedding FLOAT[])`` for a source with columns (id, text)."""
    return f"""
{out}_src AS ({src}),
{out}_t AS (SELECT id, unnest({S.tok('text')}) AS t FROM {out}_src),
{out}_c AS (SELECT id, CAST(('0x' || substr(md5(t), 1, 8)) AS BIGINT) % {dim} AS bk, CAST(count(*) AS DOUBLE) AS n FROM {out}_t GROUP BY ALL),
{out}_n AS (SELECT id, sqrt(sum(n * n)) AS nrm FROM {out}_c GROUP BY id),
{out} AS (SELECT i.id, list(CAST(CASE WHEN nn.nrm > 0 THEN coalesce(c.n, 0.0) / nn.nrm ELSE 0.0 END AS FLOAT) ORDER BY r.bk) AS embedding
          FROM (SELECT DISTINCT id FROM {out}_src) i CROSS JOIN (SELECT unnest(range({dim})) AS bk) r
          LEFT JOIN {out}_c c ON c.id = i.id AND c.bk = r.bk LEFT JOIN {out}_n nn ON nn.id = i.id
          GROUP BY i.id)"""


def _dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE)))"


_DOC_SRC = f"SELECT doc_id AS id, text FROM ({S.DOCS})"
_Q_SRC = f"SELECT query_id AS id, text FROM ({S.QUERIES})"

ORACLE["dense_embed"] = f"""
WITH {_hashed(_DOC_SRC, EMBED_DIM, "hd")}
SELECT id, embedding FROM hd"""


def _dense_run(dim: int, k: int, name: str, out: str) -> str:
    return f"""
{_hashed(_DOC_SRC, dim, out + "_dv")},
{_hashed(_Q_SRC, dim, out + "_qv")},
{out} AS (SELECT query_id, 'Q0' AS "Q0", doc_id, CAST(rank AS INTEGER) AS rank, score, '{name}' AS run_name FROM (
    SELECT q.id AS query_id, d.id AS doc_id, round({_dot('q.embedding', 'd.embedding')}, 6) AS score,
           row_number() OVER (PARTITION BY q.id ORDER BY round({_dot('q.embedding', 'd.embedding')}, 6) DESC, d.id) AS rank
    FROM {out}_qv q CROSS JOIN {out}_dv d) WHERE rank <= {k})"""


ORACLE["dense_top10"] = f"""
WITH {_dense_run(EMBED_DIM, 10, "dense", "dr")}
SELECT * FROM dr"""

_CANDS = lambda k: f"""{S.bm25_scores()},
{S.ranked_all_pairs("b_sc", "b_d2", S.QUERIES, k, "bm25", "run")},
{_hashed(_DOC_SRC, EMBED_DIM, "cv_d")},
{_hashed(_Q_SRC, EMBED_DIM, "cv_q")}"""

ORACLE["biencoder_pairs"] = f"""
WITH {_CANDS(20)}
SELECT r.*, round({_dot('q.embedding', 'd.embedding')}, 6) AS dense_score
FROM run r LEFT JOIN cv_q q ON q.id = r.query_id LEFT JOIN cv_d d ON d.id = r.doc_id"""

ORACLE["dense_embed_model"] = ORACLE["dense_embed"]

ORACLE["cross_pairs_model"] = f"""
WITH {S.bm25_scores()},
{S.ranked_all_pairs("b_sc", "b_d2", S.QUERIES, 20, "bm25", "run")}
SELECT query_id, doc_id, rank,
       round(CASE WHEN len(qs) > 0 THEN len(list_intersect(qs, ds)) / len(qs) ELSE 0 END
           + CASE WHEN len(ds) > 0 THEN len(list_intersect(qs, ds)) / len(ds) ELSE 0 END * 0.001, 6) AS rerank_score
FROM (SELECT c.query_id, c.doc_id, c.rank, list_distinct({S.tok('q.text')}) AS qs, list_distinct({S.tok('d.text')}) AS ds
      FROM run c LEFT JOIN ({S.QUERIES}) q USING (query_id) LEFT JOIN ({S.DOCS}) d USING (doc_id))"""


def _checked(name: str, source: str, columns: dict[str, str], key: str) -> str:
    """Rows, nulls and repeats of each column of a source."""
    repeated = lambda c: f"CAST(count({c}) - count(DISTINCT {c}) AS BIGINT)" if c == key else "CAST(NULL AS BIGINT)"
    return " UNION ALL ".join(
        f"SELECT '{name}' AS \"table\", '{alias}' AS \"column\", count(*) AS n_rows, count(*) - count({c}) AS n_null, {repeated(c)} AS n_repeated FROM {source}"
        for alias, c in columns.items())


ORACLE["contract_checks"] = " UNION ALL ".join([
    _checked("documents", "documents", {"doc_id": "doc_id", "text": "text", "lang": "lang", "source": "source"}, "doc_id"),
    _checked("queries", "benchmark", {"query_id": "item_id", "text": "text"}, "item_id")])

_KS = ", ".join(str(k) for k in RERANK_KS)
ORACLE["rerank_sweep"] = f"""
WITH {_CANDS(100)},
{S.QRELS},
rr_min AS (SELECT min(n) AS m FROM (SELECT query_id, count(*) AS n FROM run GROUP BY query_id)),
rr_ks AS (SELECT CAST(k AS INTEGER) AS k FROM (SELECT unnest([{_KS}]) AS k) WHERE k <= (SELECT m FROM rr_min)
          UNION ALL SELECT CAST(m AS INTEGER) FROM rr_min WHERE NOT EXISTS (SELECT 1 FROM (SELECT unnest([{_KS}]) AS k) WHERE k <= (SELECT m FROM rr_min))),
rr_c AS (SELECT * FROM run WHERE rank <= (SELECT max(k) FROM rr_ks)),
rr_s AS (SELECT query_id, doc_id, rank,
           round(CASE WHEN len(qs) > 0 THEN len(list_intersect(qs, ds)) / len(qs) ELSE 0 END
               + CASE WHEN len(ds) > 0 THEN len(list_intersect(qs, ds)) / len(ds) ELSE 0 END * 0.001, 6) AS rerank_score
         FROM (SELECT c.query_id, c.doc_id, c.rank, list_distinct({S.tok('q.text')}) AS qs, list_distinct({S.tok('d.text')}) AS ds
               FROM rr_c c LEFT JOIN ({S.QUERIES}) q USING (query_id) LEFT JOIN ({S.DOCS}) d USING (doc_id))),
rr_r AS (SELECT k.k, s.query_id, s.doc_id, s.rerank_score AS score FROM rr_s s CROSS JOIN rr_ks k WHERE s.rank <= k.k),
{S.evaluate("rr_r", "qrels", "rre", group=["k"])}
SELECT * FROM rre"""

_MIX = f"""{_CANDS(CANDIDATE_K)},
{_SPLIT},
{S.QRELS},
qrels_vali AS (SELECT q.* FROM qrels q JOIN sp USING (query_id) WHERE sp.split = 'vali'),
qrels_train AS (SELECT q.* FROM qrels q JOIN sp USING (query_id) WHERE sp.split = 'train'),
mx_c AS (SELECT r.query_id, r.doc_id, r.rank, r.score, round({_dot('q.embedding', 'd.embedding')}, 6) AS dense_score, sp.split
         FROM run r LEFT JOIN cv_q q ON q.id = r.query_id LEFT JOIN cv_d d ON d.id = r.doc_id JOIN sp USING (query_id)),
mx_n AS (SELECT *, CASE WHEN max(score) OVER w - min(score) OVER w > 0
                   THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 0.0 END AS bn
         FROM mx_c WINDOW w AS (PARTITION BY query_id)),
mx_a AS (SELECT i / 20 AS alpha FROM range(21) t(i)),
mx_t AS (SELECT a.alpha, n.query_id, n.doc_id, round(a.alpha * n.bn + (1 - a.alpha) * n.dense_score, 6) AS score
         FROM mx_n n CROSS JOIN mx_a a WHERE n.split = 'train'),
mx_tr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY alpha, query_id ORDER BY score DESC, doc_id) AS rk FROM mx_t) WHERE rk <= 20),
{S.evaluate("mx_tr", "qrels_train", "mxe", group=["alpha"], measures=[("nDCG@20", "nDCG", 20)], digits=12)}"""

ORACLE["mixture_tune"] = f"""
WITH {_MIX}
SELECT alpha, round("nDCG@20", 6) AS "nDCG@20" FROM mxe"""

# ------------------------------------------------------------------ lexical features, LTR frame
_FEAT = f"""{_CANDS(20)},
fc AS (SELECT r.*, round({_dot('q.embedding', 'd.embedding')}, 6) AS dense_score
       FROM run r LEFT JOIN cv_q q ON q.id = r.query_id LEFT JOIN cv_d d ON d.id = r.doc_id),
f_qt AS (SELECT b_qt.query_id, b_qt.term, b_qt.qtf, coalesce(b_idf.idf, 0.0) AS idf FROM b_qt LEFT JOIN b_idf USING (term)),
f_pq AS (SELECT query_id, CAST(sum(qtf) AS INTEGER) AS query_len, sum(qtf * idf) AS idf_sum, max(idf) AS idf_max, count(*) AS nq FROM f_qt GROUP BY query_id),
f_occ AS (SELECT doc_id, i - 1 AS pos, toks[i] AS term FROM (SELECT doc_id, toks, unnest(range(1, len(toks) + 1)) AS i FROM b_d2 WHERE doc_id IN (SELECT doc_id FROM fc))),
f_hits AS (SELECT p.query_id, p.doc_id, t.term, any_value(t.qtf) AS qtf, count(*) AS tf, min(o.pos) AS p0, max(o.pos) AS p1
           FROM (SELECT DISTINCT query_id, doc_id FROM fc) p JOIN f_qt t USING (query_id) JOIN f_occ o ON o.doc_id = p.doc_id AND o.term = t.term
           GROUP BY p.query_id, p.doc_id, t.term),
f_pp AS (SELECT query_id, doc_id, sum(qtf * tf) AS tf_sum, max(tf) AS tf_max, count(*) AS m, max(p1) - min(p0) AS span FROM f_hits GROUP BY query_id, doc_id),
feat AS (SELECT fc.*, CAST(d.dl AS INTEGER) AS doc_len, coalesce(pq.query_len, 0) AS query_len,
           CAST(coalesce(pp.tf_sum, 0) AS DOUBLE) AS tf_sum, CAST(coalesce(pp.tf_max, 0) AS DOUBLE) AS tf_max,
           coalesce(pq.idf_sum, 0.0) AS idf_sum, coalesce(pq.idf_max, 0.0) AS idf_max,
           CASE WHEN pq.nq > 0 THEN coalesce(pp.m, 0) / pq.nq ELSE 0.0 END AS matched_terms_ratio,
           CAST(CASE WHEN pp.m > 1 THEN pp.span ELSE 0 END AS INTEGER) AS min_span
         FROM fc LEFT JOIN b_d2 d USING (doc_id) LEFT JOIN f_pq pq USING (query_id) LEFT JOIN f_pp pp USING (query_id, doc_id))"""

ORACLE["lexical_features"] = f"""
WITH {_FEAT}
SELECT query_id, doc_id, doc_len, query_len, round(tf_sum, 6) AS tf_sum, round(tf_max, 6) AS tf_max, round(idf_sum, 6) AS idf_sum,
       round(idf_max, 6) AS idf_max, round(matched_terms_ratio, 6) AS matched_terms_ratio, min_span FROM feat"""

ORACLE["ltr_frame"] = f"""
WITH {_FEAT},
{S.QRELS},
lf AS (SELECT f.*, CASE WHEN max(score) OVER w - min(score) OVER w > 0 THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 0.0 END AS bm25_norm,
              coalesce(q.relevance, 0) AS relevance
       FROM feat f LEFT JOIN (SELECT query_id, doc_id, max(relevance) AS relevance FROM qrels GROUP BY ALL) q USING (query_id, doc_id)
       WINDOW w AS (PARTITION BY f.query_id))
SELECT CAST(dense_rank() OVER (ORDER BY query_id) - 1 AS BIGINT) AS group_id, query_id, doc_id, relevance,
       CAST(relevance > 0 AS INTEGER) AS binary_label,
       list_transform([bm25_norm, dense_score, tf_sum, tf_max, idf_sum, idf_max, doc_len, query_len, matched_terms_ratio, min_span],
                      lambda x: round(CAST(CAST(coalesce(x, 0) AS FLOAT) AS DOUBLE), 4)) AS features
FROM lf"""


# ------------------------------------------------------------------ LETOR and learning to rank
from .queries import LINEAR_WEIGHTS, STUMPS  # noqa: E402

_F32 = lambda c: f"CAST(CAST(CAST({c} AS DOUBLE) AS VARCHAR) AS FLOAT)"  # decimal text -> float, as parsed
_LAB = "CASE l_returnflag WHEN 'R' THEN 2 WHEN 'A' THEN 1 ELSE 0 END"
_LETOR = f"""
lt AS (SELECT l_linenumber AS row_id, CAST({_LAB} AS FLOAT) AS label, l_orderkey AS group_id,
              [{_F32('l_quantity')}, {_F32('l_extendedprice')}, {_F32('l_discount')}, {_F32('l_tax')}] AS features FROM lineitem)"""

ORACLE["letor_parse"] = f"""
WITH {_LETOR}
SELECT row_id, round(label, 6) AS label, group_id, list_transform(features, lambda x: CAST(x AS DOUBLE)) AS features FROM lt"""

_SPARSE = f"""
ls AS (SELECT l_linenumber AS row_id, CAST({_LAB} AS FLOAT) AS label, l_orderkey AS group_id,
              [{_F32('l_quantity')}, {_F32('l_extendedprice')}, {_F32('l_discount')}, {_F32('l_tax')}, CAST(0 AS FLOAT), CAST(0 AS FLOAT)] AS features FROM lineitem)"""

ORACLE["letor_sparse_parse"] = f"""
WITH {_SPARSE}
SELECT row_id, round(label, 6) AS label, group_id, list_transform(features, lambda x: CAST(x AS DOUBLE)) AS features FROM ls"""

_FOLDS = f"""{_LETOR},
fg AS (SELECT group_id, row_number() OVER (ORDER BY md5('42:' || CAST(group_id AS VARCHAR)), group_id) AS o FROM (SELECT DISTINCT group_id FROM lt)),
fp AS (SELECT group_id, CAST(floor((o - 1) * 5 / (SELECT count(*) FROM fg)) + 1 AS INTEGER) AS part FROM fg),
lp AS (SELECT lt.*, fp.part FROM lt JOIN fp USING (group_id))"""

ORACLE["ltr_fold_overview"] = f"""
WITH {_FOLDS},
fm AS (SELECT f AS fold, p AS part, CASE WHEN p = f THEN 'test' WHEN p = f % 5 + 1 THEN 'vali' ELSE 'train' END AS split
       FROM range(1, 6) a(f) CROSS JOIN range(1, 6) b(p))
SELECT CAST(fm.fold AS INTEGER) AS fold, fm.split, count(*) AS n_docs, count(DISTINCT group_id) AS n_queries,
       CAST(count_if(CAST(label AS INTEGER) = 0) AS BIGINT) AS label_0, CAST(count_if(CAST(label AS INTEGER) = 1) AS BIGINT) AS label_1,
       CAST(count_if(CAST(label AS INTEGER) = 2) AS BIGINT) AS label_2,
       CAST(max(len(features)) AS INTEGER) AS n_features
FROM lp JOIN fm USING (part) GROUP BY fm.fold, fm.split
UNION ALL
SELECT 0, 'full', count(*), count(DISTINCT group_id), CAST(count_if(CAST(label AS INTEGER) = 0) AS BIGINT),
       CAST(count_if(CAST(label AS INTEGER) = 1) AS BIGINT), CAST(count_if(CAST(label AS INTEGER) = 2) AS BIGINT),
       CAST(max(len(features)) AS INTEGER) FROM lp"""

ORACLE["ltr_describe"] = f"""
WITH {_SPARSE},
pg AS (SELECT group_id, count(*) AS n FROM ls GROUP BY group_id)
SELECT count(*) AS n_docs, CAST(max(len(features)) AS INTEGER) AS n_features,
       round(avg(len(list_filter(features, lambda v: v <> 0))), 6) AS mean_nonzero_features,
       count(DISTINCT label) AS n_labels, round(100.0 * avg(CASE WHEN label = 0 THEN 1.0 ELSE 0.0 END), 6) AS pct_label_0,
       (SELECT count(*) FROM pg) AS n_queries, round((SELECT avg(n) FROM pg), 6) AS mean_docs_per_query, (SELECT max(n) FROM pg) AS max_docs_per_query
FROM ls"""

_W = ", ".join(str(float(w)) for w in LINEAR_WEIGHTS)
ORACLE["ltr_linear_eval"] = f"""
WITH {_LETOR},
le_run AS (SELECT CAST(group_id AS VARCHAR) AS query_id, CAST(row_id AS VARCHAR) AS doc_id,
                  round(list_sum(list_transform(list_zip(features, [{_W}]), lambda x: CAST(x[1] AS DOUBLE) * x[2])), 6) AS score FROM lt),
le_q AS (SELECT CAST(group_id AS VARCHAR) AS query_id, CAST(row_id AS VARCHAR) AS doc_id, CAST(label AS INTEGER) AS relevance FROM lt),
{S.evaluate("le_run", "le_q", "lee", measures=[("Precision@10", "P", 10), ("MAP@10", "AP", 10), ("NDCG@10", "nDCG", 10)])}
SELECT * FROM lee"""


# The orders have fewer than 32 rows, so all their rows enter the pairs; row numbers may repeat in an order.
ORACLE["ltr_pair_weights"] = f"""
WITH {_LETOR},
pw_s AS (SELECT DISTINCT group_id, row_id, features, CAST(label AS DOUBLE) AS label,
                round(list_sum(list_transform(list_zip(features, [{_W}]), lambda x: CAST(x[1] AS DOUBLE) * x[2])), 6) AS score FROM lt),
pw_r AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY score DESC, row_id, label, features) AS pos,
                row_number() OVER (PARTITION BY group_id ORDER BY label DESC) AS best FROM pw_s),
pw_i AS (SELECT group_id, sum(CASE WHEN best <= 10 THEN label / log2(best + 1) ELSE 0 END) AS ideal FROM pw_r GROUP BY group_id),
pw_d AS (SELECT *, CASE WHEN pos <= 10 THEN 1 / log2(pos + 1) ELSE 0 END AS discount FROM pw_r)
SELECT a.group_id, count(*) AS n_pairs, round(sum((a.label - b.label) * abs(a.discount - b.discount) / ideal), 6) AS weight
FROM pw_d a JOIN pw_d b ON a.group_id = b.group_id AND a.label > b.label AND a.discount <> b.discount JOIN pw_i ON a.group_id = pw_i.group_id
GROUP BY a.group_id"""


ORACLE["ltr_ndcg_gradients"] = f"""
WITH {_LETOR},
ng_s AS (SELECT DISTINCT group_id, row_id, features, CAST(label AS DOUBLE) AS label,
                round(list_sum(list_transform(list_zip(features, [{_W}]), lambda x: CAST(x[1] AS DOUBLE) * x[2])), 6) AS score FROM lt),
ng_r AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY score DESC, row_id, label, features) AS pos,
                row_number() OVER (PARTITION BY group_id ORDER BY label DESC) AS best FROM ng_s),
ng_i AS (SELECT group_id, sum(CASE WHEN best <= 10 THEN label / log2(best + 1) ELSE 0 END) AS ideal FROM ng_r GROUP BY group_id),
ng_d AS (SELECT *, CASE WHEN pos <= 10 THEN 1 / log2(pos + 1) ELSE 0 END AS discount FROM ng_r),
ng_p AS (SELECT a.group_id, a.pos, sign(a.label - b.label) AS side, abs((a.label - b.label) * (a.discount - b.discount)) / ideal AS w,
                1 / (1 + exp(sign(a.label - b.label) * (a.score - b.score))) AS miss
         FROM ng_d a JOIN ng_d b ON a.group_id = b.group_id AND a.label <> b.label JOIN ng_i ON a.group_id = ng_i.group_id WHERE ideal > 0),
ng_t AS (SELECT group_id, pos, sum(side * miss * w) AS push, sum(miss * (1 - miss) * w) AS curve FROM ng_p GROUP BY group_id, pos)
SELECT group_id, row_id, label, round(coalesce(push, 0.0), 6) AS push, round(coalesce(curve, 0.0), 6) AS curve
FROM ng_d LEFT JOIN ng_t USING (group_id, pos)"""

_STEPS = [f"CASE WHEN features[{f + 1}] <= {t} THEN {low} ELSE {high} END" for f, t, low, high in STUMPS]
ORACLE["ltr_staged_eval"] = f"""
WITH {_LETOR},
sg_run AS ({" UNION ALL ".join(f"SELECT {n} AS n_trees, CAST(group_id AS VARCHAR) AS query_id, CAST(row_id AS VARCHAR) AS doc_id, round(CAST({' + '.join(_STEPS[:n])} AS DOUBLE), 6) AS score FROM lt" for n in range(1, len(STUMPS) + 1))}),
sg_q AS (SELECT CAST(group_id AS VARCHAR) AS query_id, CAST(row_id AS VARCHAR) AS doc_id, CAST(label AS INTEGER) AS relevance FROM lt),
{S.evaluate("sg_run", "sg_q", "sge", group=["n_trees"], measures=[("Precision@10", "P", 10), ("MAP@10", "AP", 10), ("NDCG@10", "nDCG", 10)])}
SELECT * FROM sge"""


# ------------------------------------------------------------------ pooled collections, grouped split
from ..functions.text import WHITESPACE_RUN  # noqa: E402


def _strip(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '^{WHITESPACE_RUN}|{WHITESPACE_RUN}$', '', 'g')"


_POOL_ROWS = f"""
pe AS (SELECT CAST(d.doc_id % p.n AS VARCHAR) AS query_id, d.doc_id // p.n AS pos, d.source AS doc_name, d.text AS doc_chunk,
              coalesce(q.relevance, 0) AS support, d.lang
       FROM documents d CROSS JOIN (SELECT count(*) AS n FROM benchmark) p
       LEFT JOIN qrels q ON q.query_id = CAST(d.doc_id % p.n AS VARCHAR) AND q.doc_id = CAST(d.doc_id AS VARCHAR)),
pe2 AS (SELECT *, {_strip('doc_name')} AS t, {_strip('doc_chunk')} AS c FROM pe),
pd AS (SELECT query_id, pos, support, lang, doc_name, t AS title,
              CASE WHEN c = '' THEN '' WHEN t <> '' AND NOT starts_with(c, t) THEN t || '. ' || c ELSE c END AS text FROM pe2),
pd2 AS (SELECT *, 'mirage_' || md5(text) AS doc_id FROM pd WHERE text <> '')"""

_POOL = f"""{S.QRELS},
{_POOL_ROWS}"""

# a query's pool in the pool queries: its BM25 top 20 over all documents, by rank, and after them the other documents of its share
_POOL_FOUND = f"""{S.bm25_scores()},
{S.ranked_all_pairs("b_sc", "b_d2", S.QUERIES, 20, "pool", "run")},
""" + _POOL.replace("pe AS (", "pe_share AS (", 1).replace("\npe2 AS", """
pe AS (SELECT r.query_id, r.rank - 1 AS pos, d.source AS doc_name, d.text AS doc_chunk, coalesce(q.relevance, 0) AS support, d.lang
       FROM run r JOIN documents d ON CAST(d.doc_id AS VARCHAR) = r.doc_id LEFT JOIN qrels q ON q.query_id = r.query_id AND q.doc_id = r.doc_id
       UNION ALL
       SELECT query_id, 20 + pos, doc_name, doc_chunk, support, lang FROM pe_share s
       WHERE NOT EXISTS (SELECT 1 FROM run r WHERE r.query_id = s.query_id AND r.doc_id = CAST(s.id AS VARCHAR))),
pe2 AS""", 1).replace("SELECT CAST(d.doc_id % p.n AS VARCHAR)", "SELECT d.doc_id AS id, CAST(d.doc_id % p.n AS VARCHAR)", 1)

ORACLE["pool_collection_docs"] = f"""
WITH {_POOL_FOUND}
SELECT doc_id, arg_min(title, CAST(query_id AS BIGINT) * 100000 + pos) AS title, arg_min(text, CAST(query_id AS BIGINT) * 100000 + pos) AS text
FROM pd2 GROUP BY doc_id"""

ORACLE["pool_collection_qrels"] = f"""
WITH {_POOL_FOUND}
SELECT DISTINCT query_id, doc_id, support AS relevance FROM pd2"""

_POOL_BM25 = f"""
pb_d2 AS (SELECT query_id, doc_id, pos, {S.tok('text')} AS toks, len({S.tok('text')}) AS dl FROM pd2),
pb_st AS (SELECT query_id, count(*) AS n, avg(dl) AS avgdl FROM pb_d2 GROUP BY query_id),
pb_dfs AS (SELECT query_id, term, count(*) AS df FROM (SELECT query_id, pos, unnest(list_distinct(toks)) AS term FROM pb_d2) GROUP BY query_id, term),
pb_raw AS (SELECT query_id, term, ln(n - df + 0.5) - ln(df + 0.5) AS r FROM pb_dfs JOIN pb_st USING (query_id)),
pb_mr AS (SELECT query_id, avg(r) AS m FROM pb_raw GROUP BY query_id),
pb_idf AS (SELECT query_id, term, CASE WHEN r < 0 THEN 0.25 * m ELSE r END AS idf FROM pb_raw JOIN pb_mr USING (query_id)),
pb_qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({S.tok('text')}) AS term FROM ({S.QUERIES})) GROUP BY query_id, term),
pb_tf AS (SELECT query_id, doc_id, pos, term, count(*) AS tf, any_value(dl) AS dl
          FROM (SELECT query_id, doc_id, pos, dl, unnest(toks) AS term FROM pb_d2) GROUP BY query_id, doc_id, pos, term),
pb_sc AS (SELECT query_id, doc_id, pos, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))) AS score
          FROM pb_qt JOIN pb_idf USING (query_id, term) JOIN pb_tf USING (query_id, term) JOIN pb_st USING (query_id)
          GROUP BY query_id, doc_id, pos),
pb_all AS (SELECT d.query_id, d.doc_id, round(coalesce(s.score, 0.0), 6) AS score FROM pb_d2 d LEFT JOIN pb_sc s USING (query_id, doc_id, pos)),
pbr AS (SELECT query_id, 'Q0' AS "Q0", doc_id, CAST(rank AS INTEGER) AS rank, score, 'bm25_pool' AS run_name
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM pb_all) WHERE rank <= 100)"""

ORACLE["pool_bm25"] = f"""
WITH {_POOL_FOUND},
{_POOL_BM25}
SELECT * FROM pbr"""

_GSPLIT = f"""{_POOL_FOUND},
gs AS (SELECT query_id, lang AS source, coalesce(nullif(doc_name, ''), query_id) AS group_key FROM pe WHERE pos = 0),
gs_g AS (SELECT group_key, source, count(*) AS n FROM gs GROUP BY group_key, source),
gs_main AS (SELECT group_key, source AS stratum FROM (SELECT *, row_number() OVER (PARTITION BY group_key ORDER BY n DESC, source) AS r FROM gs_g) WHERE r = 1),
gs_size AS (SELECT group_key, sum(n) AS size FROM gs_g GROUP BY group_key),
gs_r AS (SELECT m.group_key, m.stratum, s.size, sum(s.size) OVER (PARTITION BY m.stratum) AS tot,
                (row_number() OVER (PARTITION BY m.stratum ORDER BY s.size DESC, md5('42:' || m.group_key), m.group_key) - 1) % 20 AS w
         FROM gs_main m JOIN gs_size s USING (group_key)),
gs_d AS (SELECT *, CASE WHEN w < 10 THEN w ELSE 19 - w END AS fold FROM gs_r),
gs_f AS (SELECT stratum, fold, sum(size) AS n, round(abs(sum(size) - any_value(tot) * CAST(0.1 AS DOUBLE)), 6) AS off,
                round(any_value(tot) * CAST(0.1 AS DOUBLE), 6) AS goal FROM gs_d GROUP BY stratum, fold),
gs_b AS (SELECT stratum, fold FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY off, n DESC, fold) AS r FROM gs_f) WHERE r = 1 AND off <= goal),
gsplit AS (SELECT gs.query_id, gs.group_key, gs.source, CASE WHEN b.fold IS NOT NULL THEN 'test' ELSE 'train' END AS split
           FROM gs JOIN gs_d d USING (group_key) LEFT JOIN gs_b b ON b.stratum IS NOT DISTINCT FROM d.stratum AND b.fold = d.fold)"""

ORACLE["grouped_split"] = f"""
WITH {_GSPLIT}
SELECT * FROM gsplit"""

ORACLE["split_metadata"] = f"""
WITH {_GSPLIT}
SELECT 'benchmark-pools' AS source, CAST(0.1 AS DOUBLE) AS test_size, 42 AS random_state,
       CAST(count_if(split = 'train') AS BIGINT) AS num_train, CAST(count_if(split = 'test') AS BIGINT) AS num_test FROM gsplit"""


# ------------------------------------------------------------------ run text round trip, ranking helpers
ORACLE["trec_roundtrip"] = ORACLE["bm25_top10"]

ORACLE["run_minmax"] = f"""
WITH {S.bm25_scores()},
{S.ranked_all_pairs("b_sc", "b_d2", S.QUERIES, 20, "bm25", "run")}
SELECT query_id, doc_id, score,
       round(CASE WHEN max(score) OVER w - min(score) OVER w > 0 THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 0.0 END, 6) AS score_minmax
FROM run WINDOW w AS (PARTITION BY query_id)"""

ORACLE["run_top3_rows"] = f"""
WITH {S.bm25_scores()},
{S.ranked_all_pairs("b_sc", "b_d2", S.QUERIES, 20, "bm25", "run")}
SELECT * FROM run WHERE rank <= 3"""

ORACLE["query_ordinals"] = f"""
SELECT query_id, CAST(dense_rank() OVER (ORDER BY query_id) - 1 AS BIGINT) AS group_id FROM ({S.QUERIES})"""

ORACLE["preview_sample"] = f"""
SELECT query_id FROM ({S.QUERIES}) ORDER BY md5('42:' || query_id), query_id LIMIT 5"""


# ------------------------------------------------------------------ normalisation and variants
from ..functions.porter import DUCKDB, stem_steps  # noqa: E402

_VOCAB = f"""
nv AS (SELECT DISTINCT word FROM (SELECT unnest({S.tok('text')}) AS word FROM ({S.DOCS})
                                  UNION ALL SELECT unnest({S.tok('text')}) AS word FROM ({S.QUERIES})))"""


def _stem_ctes() -> str:
    parts, prev = [], "nv"
    for i, (name, expr) in enumerate(stem_steps("word", DUCKDB)):
        parts.append(f"ns{i} AS (SELECT *, {expr} AS {name} FROM {prev})")
        prev = f"ns{i}"
    parts.append(f"stem_map AS (SELECT word, stem AS form FROM {prev})")
    return ",\n".join(parts)


_LEMMA = """
lemma_map AS (
  SELECT c.word, c.form FROM (
    SELECT word, CASE WHEN regexp_matches(word, 'ies$') THEN substr(word, 1, length(word) - 3) || 'y'
                      WHEN regexp_matches(word, '(ss|x|ch|sh)es$') THEN substr(word, 1, length(word) - 2)
                      WHEN regexp_matches(word, '[^s]s$') THEN substr(word, 1, length(word) - 1) END AS form FROM nv) c
  WHERE c.form IS NOT NULL AND length(c.form) > 1 AND c.form IN (SELECT word FROM nv))"""

_NORM = f"{_VOCAB},\n{_stem_ctes()},\n{_LEMMA}"


def _mapped(src: str, id_col: str, mapping: str) -> str:
    return f"""(SELECT s.{id_col}, coalesce(t.text, '') AS text FROM ({src}) s LEFT JOIN (
      SELECT {id_col}, string_agg(coalesce(m.form, x.word), ' ' ORDER BY x.pos) AS text
      FROM (SELECT {id_col}, unnest(toks) AS word, unnest(range(len(toks))) AS pos FROM (SELECT {id_col}, {S.tok('text')} AS toks FROM ({src}))) x
      LEFT JOIN {mapping} m ON m.word = x.word GROUP BY {id_col}) t USING ({id_col}))"""


_DOCV = {"original": f"SELECT doc_id, text FROM ({S.DOCS})", "stemmed": _mapped(S.DOCS, "doc_id", "stem_map"), "lemmatized": _mapped(S.DOCS, "doc_id", "lemma_map")}
_QV = {"original": f"SELECT query_id, text FROM ({S.QUERIES})", "stemmed": _mapped(S.QUERIES, "query_id", "stem_map"), "lemmatized": _mapped(S.QUERIES, "query_id", "lemma_map")}

ORACLE["stem_vocab"] = f"""
WITH {_NORM}
SELECT * FROM stem_map"""

ORACLE["lemma_vocab"] = f"""
WITH {_VOCAB},
{_LEMMA}
SELECT * FROM lemma_map"""


def _substrings(src: str) -> str:
    """Every substring of up to 4 characters of the words of ``src``, as a subword piece."""
    places = f"SELECT word, unnest(range(1, length(word) + 1)) AS pos FROM {src}"
    sizes = f"SELECT word, pos, unnest(range(1, least(4, length(word) - pos + 1) + 1)) AS n FROM ({places})"
    return f"SELECT word, pos, n, CASE WHEN pos > 1 THEN '##' ELSE '' END || substr(word, pos, n) AS piece FROM ({sizes})"


ORACLE["subword_vocab"] = f"""
WITH RECURSIVE {_VOCAB},
qw AS (SELECT DISTINCT word FROM (SELECT unnest({S.tok('text')}) AS word FROM ({S.QUERIES}))),
pieces AS (SELECT piece FROM ({_substrings('qw')}) GROUP BY piece HAVING count(DISTINCT word) >= 3),
best AS (SELECT word, pos, max(n) AS n FROM ({_substrings('nv')}) JOIN pieces USING (piece) GROUP BY word, pos),
walk AS (
  SELECT word, CAST(1 AS BIGINT) AS at, '' AS form FROM nv
  UNION ALL
  SELECT w.word, w.at + b.n, CASE WHEN w.at > 1 THEN w.form || ' ##' ELSE '' END || substr(w.word, w.at, b.n) FROM walk w JOIN best b ON b.word = w.word AND b.pos = w.at)
SELECT nv.word, coalesce(w.form, '[UNK]') AS form FROM nv LEFT JOIN walk w ON w.word = nv.word AND w.at = length(nv.word) + 1"""

ORACLE["bm25_grid_lemmatized"] = f"""
WITH {_VOCAB},
{_LEMMA},
{_SPLIT},
{_grid_runs("vali", 10, docs="SELECT * FROM " + _DOCV["lemmatized"], queries=_QV["lemmatized"])},
{S.QRELS},
qrels_vali AS (SELECT q.* FROM qrels q JOIN sp USING (query_id) WHERE sp.split = 'vali'),
{S.evaluate("g_run", "qrels_vali", "gl", group=["k1", "b"], measures=[("P@10", "P", 10)], digits=12)}
SELECT k1, b, round("P@10", 6) AS "P@10" FROM gl"""

ORACLE["query_versions"] = f"""
WITH {_NORM}
SELECT query_id, text, 'original' AS variant FROM ({_QV['original']})
UNION ALL SELECT query_id, text, 'stemmed' FROM {_QV['stemmed']}
UNION ALL SELECT query_id, text, 'lemmatized' FROM {_QV['lemmatized']}"""

_DV_ALL = " UNION ALL ".join(f"SELECT '{v}' AS variant, doc_id, text FROM ({src})" if v == "original" else f"SELECT '{v}' AS variant, doc_id, text FROM {src}" for v, src in _DOCV.items())

ORACLE["variant_stats"] = f"""
WITH {_NORM},
vd AS ({_DV_ALL}),
vd2 AS (SELECT variant, {S.tok('text')} AS toks FROM vd),
vw AS (SELECT variant, unnest(toks) AS word FROM vd2),
vtf AS (SELECT variant, word, count(*) AS c FROM vw GROUP BY variant, word)
SELECT a.variant, a.n_docs, a.total_words, round(a.total_words / a.n_docs, 6) AS avg_doc_len, b.unique_words,
       round(b.avg_unique_word_len, 6) AS avg_unique_word_len, round(c.avg_word_len, 6) AS avg_word_len
FROM (SELECT variant, count(*) AS n_docs, CAST(sum(len(toks)) AS BIGINT) AS total_words FROM vd2 GROUP BY variant) a
JOIN (SELECT variant, count(*) AS unique_words, avg(length(word)) AS avg_unique_word_len FROM vtf GROUP BY variant) b USING (variant)
JOIN (SELECT variant, avg(length(word)) AS avg_word_len FROM vw GROUP BY variant) c USING (variant)"""


def _tfidf(docs: str, queries: str, p: str) -> str:
    return f"""
{p}_d AS (SELECT doc_id, {S.tok('text')} AS toks FROM ({docs})),
{p}_st AS (SELECT count(*) AS n FROM {p}_d),
{p}_post AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(toks) AS term FROM {p}_d) GROUP BY doc_id, term),
{p}_idf AS (SELECT term, ln((1 + n) / (1 + count(*))) + 1 AS idf FROM {p}_post, {p}_st GROUP BY term, n),
{p}_dn AS (SELECT doc_id, sqrt(sum((tf * idf) * (tf * idf))) AS dn FROM {p}_post JOIN {p}_idf USING (term) GROUP BY doc_id),
{p}_qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({S.tok('text')}) AS term FROM ({queries})) GROUP BY query_id, term),
{p}_qw AS (SELECT query_id, term, qtf * idf AS w, idf FROM {p}_qt JOIN {p}_idf USING (term)),
{p}_qn AS (SELECT query_id, sqrt(sum(w * w)) AS qn FROM {p}_qw GROUP BY query_id),
{p}_sc AS (SELECT query_id, doc_id, sum(w * tf * idf) / (any_value(qn) * any_value(dn)) AS score
         FROM {p}_qw JOIN {p}_qn USING (query_id) JOIN {p}_post USING (term) JOIN {p}_dn USING (doc_id) GROUP BY query_id, doc_id)"""


def _all_models() -> str:
    parts, runs = [], []
    for v in ("original", "stemmed", "lemmatized"):
        d = _DOCV[v] if v != "original" else f"SELECT doc_id, text FROM ({S.DOCS})"
        q = _QV[v] if v != "original" else f"SELECT query_id, text FROM ({S.QUERIES})"
        d = d if v == "original" else f"SELECT * FROM {d}"
        q = q if v == "original" else f"SELECT * FROM {q}"
        parts.append(S.bm25_scores(docs=d, queries=q, prefix=f"b{v[:3]}"))
        parts.append(S.ranked_all_pairs(f"b{v[:3]}_sc", f"b{v[:3]}_d2", q, RUN_K, f"bm25_{v}", f"rb{v[:3]}"))
        parts.append(_tfidf(d, q, f"t{v[:3]}"))
        parts.append(S.ranked_all_pairs(f"t{v[:3]}_sc", f"t{v[:3]}_d", q, RUN_K, f"tfidf_{v}", f"rt{v[:3]}"))
        runs += [f"rb{v[:3]}", f"rt{v[:3]}"]
    parts.append("allruns AS (" + " UNION ALL ".join(f"SELECT run_name, query_id, doc_id, score FROM {r}" for r in runs) + ")")
    return ",\n".join(parts)


ORACLE["run_all_models"] = f"""
WITH {_NORM},
{_all_models()},
{S.QRELS},
{S.evaluate("allruns", "qrels", "ram", group=["run_name"], measures=S.RUN_MEASURES, digits=4)}
SELECT * FROM ram"""


# ------------------------------------------------------------------ both collections: dense sweep, mixture, final report
_POOL_COLLECTION = f"""
pc_docs AS (SELECT doc_id, arg_min(text, CAST(query_id AS BIGINT) * 100000 + pos) AS text FROM pd2 GROUP BY doc_id),
pc_qrels AS (SELECT DISTINCT query_id, doc_id, support AS relevance FROM pd2)"""


def _dense_over(dim: int, docs: str, out: str) -> str:
    """CTE ``out``: dense top 20 of every query over the documents of CTE ``docs``."""
    return f"""
{_hashed(f"SELECT doc_id AS id, text FROM {docs}", dim, out + "_dv")},
{_hashed(_Q_SRC, dim, out + "_qv")},
{out} AS (SELECT query_id, doc_id, score FROM (
    SELECT q.id AS query_id, d.id AS doc_id, round({_dot('q.embedding', 'd.embedding')}, 6) AS score,
           row_number() OVER (PARTITION BY q.id ORDER BY round({_dot('q.embedding', 'd.embedding')}, 6) DESC, d.id) AS rank
    FROM {out}_qv q CROSS JOIN {out}_dv d) WHERE rank <= 20)"""


ORACLE["dense_sweep"] = "WITH " + ",\n".join(
    [_POOL, _POOL_COLLECTION, f"all_docs AS (SELECT doc_id, text FROM ({S.DOCS}))"]
    + [_dense_over(d, src, f"ds{d}{ds[0]}") for d in SWEEP_DIMS for ds, src in (("documents", "all_docs"), ("pools", "pc_docs"))]
    + [S.evaluate(f"ds{d}{ds[0]}", qr, f"dse{d}{ds[0]}") for d in SWEEP_DIMS for ds, qr in (("documents", "qrels"), ("pools", "pc_qrels"))]
) + "\n" + "\nUNION ALL\n".join(f"SELECT '{ds}' AS dataset, 'hash{d}' AS model, * FROM dse{d}{ds[0]}" for d in SWEEP_DIMS for ds in ("documents", "pools"))

_BOTH = f"""{_MIX},
{_POOL_ROWS},
{_POOL_COLLECTION},
{_POOL_BM25},
{_hashed("SELECT doc_id AS id, text FROM pc_docs", EMBED_DIM, "pv_d")},
pqrels_vali AS (SELECT q.* FROM pc_qrels q JOIN sp USING (query_id) WHERE sp.split = 'vali'),
mx_best AS (SELECT alpha FROM mxe ORDER BY "nDCG@20" DESC, alpha LIMIT 1),
pm_c AS (SELECT r.query_id, r.doc_id, r.rank, r.score, round({_dot('q.embedding', 'd.embedding')}, 6) AS dense_score
         FROM pbr r JOIN cv_q q ON q.id = r.query_id JOIN pv_d d ON d.id = r.doc_id JOIN sp USING (query_id) WHERE sp.split = 'vali'),
pm_v AS (SELECT *, CASE WHEN max(score) OVER w - min(score) OVER w > 0
                   THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 0.0 END AS bn
         FROM pm_c WINDOW w AS (PARTITION BY query_id)),
mx_v AS (SELECT query_id, doc_id, rank, score, dense_score, bn FROM mx_n WHERE split = 'vali')"""


def _methods(v: str, out: str) -> str:
    """CTEs ``{out}_bm25``, ``{out}_dense`` and ``{out}_mix`` (top 20) from scored candidates."""
    mixed = "round(b.alpha * bn + (1 - b.alpha) * dense_score, 6)"
    return f"""
{out}_bm25 AS (SELECT query_id, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, doc_id) AS r FROM {v}) WHERE r <= 20),
{out}_dense AS (SELECT query_id, doc_id, dense_score AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dense_score DESC, doc_id) AS r FROM {v}) WHERE r <= 20),
{out}_mix AS (SELECT query_id, doc_id, score FROM (SELECT query_id, doc_id, {mixed} AS score,
            row_number() OVER (PARTITION BY query_id ORDER BY {mixed} DESC, doc_id) AS r FROM {v} CROSS JOIN mx_best b) WHERE r <= 20)"""


_MIX_NAME = "'Mixture a=' || printf('%.2f', (SELECT alpha FROM mx_best))"
_BOTH_RUNS = [("documents", "d", "qrels_vali"), ("pools", "p", "pqrels_vali")]

ORACLE["mixture_report"] = "WITH " + ",\n".join(
    [_BOTH, _methods("mx_v", "d"), _methods("pm_v", "p")]
    + [S.evaluate(f"{p}_{m}", qr, f"e_{p}_{m}") for _, p, qr in _BOTH_RUNS for m in ("bm25", "dense", "mix")]
) + "\n" + "\nUNION ALL\n".join(
    f"SELECT '{ds}' AS dataset, {name} AS method, * FROM e_{p}_{m}" for ds, p, _ in _BOTH_RUNS
    for m, name in (("bm25", "'BM25'"), ("dense", "'Dense'"), ("mix", _MIX_NAME)))


def _cross(v: str, docs: str, out: str) -> str:
    """CTE ``out``: the first 20 of ``v``, re-ranked by lexical overlap."""
    return f"""
{out} AS (SELECT query_id, doc_id,
       round(CASE WHEN len(qs) > 0 THEN len(list_intersect(qs, ds)) / len(qs) ELSE 0 END
           + CASE WHEN len(ds) > 0 THEN len(list_intersect(qs, ds)) / len(ds) ELSE 0 END * 0.001, 6) AS score
      FROM (SELECT c.query_id, c.doc_id, list_distinct({S.tok('q.text')}) AS qs, list_distinct({S.tok('d.text')}) AS ds
            FROM {v} c LEFT JOIN ({S.QUERIES}) q USING (query_id) LEFT JOIN {docs} d USING (doc_id)))"""


# ------------------------------------------------------------------ final comparison report
ORACLE["final_report"] = "WITH " + ",\n".join(
    [_BOTH, _methods("mx_v", "d"), _methods("pm_v", "p"), f"all_docs AS (SELECT doc_id, text FROM ({S.DOCS}))",
     _cross("d_bm25", "all_docs", "d_ce"), _cross("p_bm25", "pc_docs", "p_ce"), _dense_over(EMBED_DIM, "all_docs", "d_all"), _dense_over(EMBED_DIM, "pc_docs", "p_all")]
    + [S.evaluate(f"{p}_{m}", qr, f"e_{p}_{m}") for _, p, qr in _BOTH_RUNS for m in ("bm25", "ce", "all", "mix")]
) + "\n" + "\nUNION ALL\n".join(
    f"SELECT '{ds}' AS dataset, {name} AS method, * FROM e_{p}_{m}" for ds, p, _ in _BOTH_RUNS
    for m, name in (("bm25", "'BM25'"), ("ce", "'CE k=20'"), ("all", "'Dense hash64'"), ("mix", _MIX_NAME)))
