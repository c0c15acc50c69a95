"""SQL fragments for the DuckDB twins of the registered queries.

The twins are written the plain way (they only check results at small scale); the Spark side
is the scalable plan. Every fragment uses the same tokeniser class as the Spark code.
"""
from __future__ import annotations

from ..functions.text import WHITESPACE_RUN


def tok(expr: str) -> str:
    return f"list_filter(regexp_split_to_array({expr}, '{WHITESPACE_RUN}'), lambda x: x <> '')"


DOCS = "SELECT CAST(doc_id AS VARCHAR) AS doc_id, source AS title, coalesce(text, '') AS text FROM documents"
QUERIES = "SELECT CAST(item_id AS VARCHAR) AS query_id, coalesce(text, '') AS text FROM benchmark"

# qrels derived from documents x benchmark: share of distinct query terms >= 0.5 -> 1,
# and the document containing the query text -> 2
QRELS = f"""
qd_docs AS (SELECT doc_id, text, list_distinct({tok('text')}) AS terms FROM ({DOCS})),
qd_q AS (SELECT query_id, text, list_distinct({tok('text')}) AS terms FROM ({QUERIES})),
qd_qt AS (SELECT query_id, len(terms) AS n, unnest(terms) AS term FROM qd_q),
qd_dt AS (SELECT doc_id, unnest(terms) AS term FROM qd_docs),
qd_sh AS (SELECT query_id, doc_id, count(*) AS s, any_value(n) AS n FROM qd_qt JOIN qd_dt USING (term) GROUP BY query_id, doc_id),
qrels AS (
  SELECT qd_sh.query_id, qd_sh.doc_id,
         CAST(CASE WHEN contains(qd_docs.text, qd_q.text) THEN 2 ELSE 1 END AS INTEGER) AS relevance
  FROM qd_sh JOIN qd_docs USING (doc_id) JOIN qd_q USING (query_id)
  WHERE qd_sh.s >= ceil(qd_sh.n * 0.5)
)"""


def bm25_scores(k1: float = 1.5, b: float = 0.75, eps: float = 0.25, docs: str = DOCS, queries: str = QUERIES,
                prefix: str = "b") -> str:
    """CTEs ``{prefix}_sc(query_id, doc_id, score)`` (matched pairs) and ``{prefix}_d``."""
    p = prefix
    return f"""
{p}_d AS (SELECT doc_id, {tok('text')} AS toks FROM ({docs})),
{p}_d2 AS (SELECT doc_id, toks, len(toks) AS dl FROM {p}_d),
{p}_st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM {p}_d2),
{p}_dfs AS (SELECT term, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct(toks)) AS term FROM {p}_d2) GROUP BY term),
{p}_raw AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS r FROM {p}_dfs, {p}_st),
{p}_mr AS (SELECT avg(r) AS m FROM {p}_raw),
{p}_idf AS (SELECT term, CASE WHEN r < 0 THEN {eps} * m ELSE r END AS idf FROM {p}_raw, {p}_mr),
{p}_q AS (SELECT query_id, unnest({tok('text')}) AS term FROM ({queries})),
{p}_qt AS (SELECT query_id, term, count(*) AS qtf FROM {p}_q GROUP BY query_id, term),
{p}_tf AS (SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl
          FROM (SELECT doc_id, dl, unnest(toks) AS term FROM {p}_d2)
          WHERE term IN (SELECT term FROM {p}_qt) GROUP BY doc_id, term),
{p}_sc AS (SELECT query_id, doc_id,
             sum(qtf * idf * tf * ({k1} + 1) / (tf + {k1} * (1 - {b} + {b} * dl / avgdl))) AS score
          FROM {p}_qt JOIN {p}_idf USING (term) JOIN {p}_tf USING (term), {p}_st GROUP BY query_id, doc_id)"""


def ranked_all_pairs(sc: str, d: str, queries: str, top_k: int, run_name: str, out: str) -> str:
    """CTE ``out``: every (query, doc) scored (unmatched = 0), top k by rounded score, doc_id."""
    return f"""
{out}_all AS (SELECT qq.query_id, dd.doc_id, round(coalesce(s.score, 0.0), 6) AS score
          FROM (SELECT DISTINCT query_id FROM ({queries})) qq CROSS JOIN (SELECT doc_id FROM {d}) dd
          LEFT JOIN {sc} s ON s.query_id = qq.query_id AND s.doc_id = dd.doc_id),
{out} AS (SELECT query_id, 'Q0' AS "Q0", doc_id, CAST(rank AS INTEGER) AS rank, score, '{run_name}' AS run_name
          FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM {out}_all)
          WHERE rank <= {top_k})"""


# Default measure set (name, kind, cutoff) and gains.
MEASURES = [("P@1", "P", 1), ("P@10", "P", 10), ("P@20", "P", 20), ("MAP@20", "AP", 20), ("nDCG@20", "nDCG", 20)]
RUN_MEASURES = [("P@1", "P", 1), ("P@10", "P", 10), ("P@20", "P", 20), ("MAP", "AP", None), ("nDCG@20", "nDCG", 20)]


def evaluate(run: str, qrels: str, out: str, group: list[str] | None = None, measures=None,
             digits: int = 6, per_query: bool = False, tie: str = "DESC") -> str:
    """CTEs ending in ``out``: mean metrics per group over all judged queries (missing = 0)."""
    group = group or []
    measures = measures or MEASURES
    g = "".join(f"{c}, " for c in group)
    gp = f"PARTITION BY {g}query_id"
    cut = {m[2] for m in measures if m[1] == "nDCG"}
    parts = [f"""
{out}_qr AS (SELECT query_id, doc_id, max(relevance) AS relevance FROM {qrels} GROUP BY query_id, doc_id),
{out}_judged AS (SELECT DISTINCT query_id FROM {out}_qr),
{out}_r AS (SELECT {g}query_id, doc_id, max(score) AS score FROM {run}
           WHERE query_id IN (SELECT query_id FROM {out}_judged) GROUP BY {g}query_id, doc_id),
{out}_r2 AS (SELECT x.*, coalesce(q.relevance, 0) AS rel,
             row_number() OVER ({gp} ORDER BY x.score DESC, x.doc_id {tie}) AS rk
           FROM {out}_r x LEFT JOIN {out}_qr q USING (query_id, doc_id)),
{out}_r3 AS (SELECT *, sum(CASE WHEN rel >= 1 THEN 1 ELSE 0 END) OVER ({gp} ORDER BY rk ROWS UNBOUNDED PRECEDING) AS cum,
             CASE rel WHEN 1 THEN 1.0 WHEN 2 THEN 2.0 ELSE 0.0 END AS g FROM {out}_r2),
{out}_nrel AS (SELECT query_id, count_if(relevance >= 1) AS R FROM {out}_qr GROUP BY query_id),
{out}_ideal AS (SELECT query_id, {", ".join(f"sum(CASE WHEN ir <= {c} THEN ig / log2(ir + 1) ELSE 0 END) AS idcg{c}" for c in cut) or "0 AS idcg_none"}
           FROM (SELECT query_id, ig, row_number() OVER (PARTITION BY query_id ORDER BY ig DESC, doc_id) AS ir
                 FROM (SELECT query_id, doc_id, CASE relevance WHEN 1 THEN 1.0 WHEN 2 THEN 2.0 ELSE 0.0 END AS ig FROM {out}_qr))
           GROUP BY query_id)"""]
    sel = []
    for name, kind, c in measures:
        within = f"rk <= {c}" if c else "TRUE"
        if kind == "P":
            sel.append(f"sum(CASE WHEN {within} AND rel >= 1 THEN 1 ELSE 0 END) / {float(c)} AS \"{name}\"")
        elif kind == "AP":
            sel.append(f"CASE WHEN any_value(R) > 0 THEN sum(CASE WHEN {within} AND rel >= 1 THEN cum / rk ELSE 0 END) / any_value(R) ELSE 0 END AS \"{name}\"")
        else:
            sel.append(f"CASE WHEN any_value(idcg{c}) > 0 THEN sum(CASE WHEN {within} THEN g / log2(rk + 1) ELSE 0 END) / any_value(idcg{c}) ELSE 0 END AS \"{name}\"")
    parts.append(f"""
{out}_pq AS (SELECT {g}query_id, {", ".join(sel)}
           FROM {out}_r3 JOIN {out}_nrel USING (query_id) LEFT JOIN {out}_ideal USING (query_id)
           GROUP BY {g}query_id)""")
    if per_query:
        cols = ", ".join(f"round(coalesce(p.\"{n}\", 0), {digits}) AS \"{n}\"" for n, _, _ in measures)
        parts.append(f"""
{out} AS (SELECT j.query_id, {cols} FROM {out}_judged j LEFT JOIN {out}_pq p USING (query_id))""")
    else:
        cols = ", ".join(f"round(sum(\"{n}\") / (SELECT count(*) FROM {out}_judged), {digits}) AS \"{n}\"" for n, _, _ in measures)
        gb = f" GROUP BY {', '.join(group)}" if group else ""
        parts.append(f"""
{out} AS (SELECT {g}{cols} FROM {out}_pq{gb})""")
    return ",".join(parts)
