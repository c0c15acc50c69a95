"""Run evaluation: precision, average precision and nDCG per query and their means.

Conventions (trec_eval style): relevant = grade >= ``rel`` (default 1), unjudged documents are
non-relevant, P@k divides by k, AP divides by the number of relevant documents in the qrels,
nDCG uses ``gain / log2(rank + 1)`` with the ideal list built from all qrels of the query. The
run's own rank column is ignored: order is rebuilt from the score, ties on doc_id descending
(``tie="desc"``). A query judged in the qrels but absent from the run scores 0; run-only queries
are ignored. Repeated (query, doc) rows keep the best score / the highest grade.

The mean over judged queries is ``sum over present queries / number of judged queries``, so the
zeros of missing queries are never materialised (no run x query product).
"""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ordinals import keyed_ordinal
from .ranking import ensure_str_ids


@dataclass(frozen=True)
class Measure:
    kind: str  # "P", "AP", "nDCG"
    cutoff: int | None = None
    rel: float = 1  # least relevant grade; 0 means any grade above zero

    @property
    def name(self) -> str:
        base = {"P": "P", "AP": "MAP", "nDCG": "nDCG"}[self.kind]
        return f"{base}@{self.cutoff}" if self.cutoff else base


# The default measure sets.
DEFAULT_MEASURES = {
    "P@1": Measure("P", 1),
    "P@10": Measure("P", 10),
    "P@20": Measure("P", 20),
    "MAP@20": Measure("AP", 20),
    "nDCG@20": Measure("nDCG", 20),
}
RUN_MEASURES = {
    "P@1": Measure("P", 1),
    "P@10": Measure("P", 10),
    "P@20": Measure("P", 20),
    "MAP": Measure("AP", None),
    "nDCG@20": Measure("nDCG", 20),
}


def prepare_qrels(qrels: DataFrame) -> DataFrame:
    """E5: string ids, highest grade (any number) per (query, doc)."""
    q = ensure_str_ids(qrels.select("query_id", "doc_id", F.col("relevance").cast("double").alias("relevance")))
    return q.groupBy("query_id", "doc_id").agg(F.max("relevance").alias("relevance"))


def best_scores(run: DataFrame, score_col: str = "score", group_cols: Sequence[str] = ()) -> DataFrame:
    """E5: string ids, double score, best score per (query, doc)."""
    r = ensure_str_ids(run.select(*group_cols, "query_id", "doc_id", F.col(score_col).cast("double").alias("score")))
    return r.groupBy(*group_cols, "query_id", "doc_id").agg(F.max("score").alias("score"))


def prepare_run(run: DataFrame, score_col: str = "score", group_cols: Sequence[str] = (), tie: str = "desc") -> DataFrame:
    """E5: ``best_scores`` with the rank rebuilt from score."""
    r = best_scores(run, score_col, group_cols)
    doc_order = F.col("doc_id").desc() if tie == "desc" else F.col("doc_id").asc()
    w = Window.partitionBy(*group_cols, "query_id").orderBy(F.col("score").desc(), doc_order)
    return r.withColumn("_rank", F.row_number().over(w))


def _gain(rel: Column, gains: dict[float, float] | None) -> Column:
    """The grade itself, or its value in ``gains`` (grades that are not listed keep theirs)."""
    expr = rel.cast("double")
    for grade, g in (gains or {}).items():
        expr = F.when(rel == grade, F.lit(float(g))).otherwise(expr)
    return expr


def _relevant(level: float) -> Column:
    return F.col("relevance") >= level if level > 0 else F.col("relevance") > 0


def per_query_metrics(
    run: DataFrame,
    qrels: DataFrame,
    measures: dict[str, Measure] | None = None,
    group_cols: Sequence[str] = (),
    score_col: str = "score",
    tie: str = "desc",
    gains: dict[int, float] | None = None,
    fill_missing: bool = True,
    ap_denominator: str = "relevant",
    empty_ndcg: float | None = 0.0,
) -> DataFrame:
    """One row per (group, judged query) with one column per measure.

    ``ap_denominator``: ``relevant`` (all relevant in the qrels, default), ``min_k``
    (min(cutoff, relevant)) or ``hits`` (relevant retrieved within the cutoff).
    ``empty_ndcg``: value of nDCG for a query with no relevant document (0, 1, or ``None`` to
    leave it null so means skip it).

    With ``fill_missing`` judged queries absent from the run (from a group's run) appear with zeros.
    ``fill_missing=False`` lists only queries present in the run.
    """
    measures = measures or DEFAULT_MEASURES
    qr = prepare_qrels(qrels)
    judged = qr.select("query_id").distinct()
    cuts = [m.cutoff for m in measures.values()]
    list_keys = [*group_cols, "query_id"]
    if all(cuts):
        # every measure stops at a cutoff: keep only the head of each list (map-side top-k)
        r = prepare_run(run, score_col, group_cols, tie).join(judged, "query_id", "left_semi").filter(F.col("_rank") <= max(cuts))
    else:
        # whole lists, of any length: ranks from a range partitioning of all lists, no list in one task
        doc_order = F.col("doc_id").desc() if tie == "desc" else F.col("doc_id").asc()
        r = best_scores(run, score_col, group_cols).join(judged, "query_id", "left_semi")
        r = keyed_ordinal(r, list_keys, [F.col("score").desc(), doc_order], out="_rank")
    r = r.join(qr, ["query_id", "doc_id"], "left").withColumn("relevance", F.coalesce("relevance", F.lit(0.0)))

    rels = {m.rel for m in measures.values()}
    # running count of relevant docs down the list (for AP)
    wrun = Window.partitionBy(*list_keys).orderBy("_rank").rowsBetween(Window.unboundedPreceding, 0)
    for lv in rels:
        r = r.withColumn(f"_isrel{lv}", _relevant(lv).cast("int"))
    if not all(cuts):
        # past the cutoffs only rows with a gain count; the first row stands for lists without any
        gain = _gain(F.col("relevance"), gains)
        r = r.filter((F.col("_rank") <= max([c for c in cuts if c], default=1)) | (gain != 0) | (F.greatest(F.lit(0), *[f"_isrel{lv}" for lv in rels]) == 1))
    for lv in rels:
        if any(m.kind == "AP" and m.rel == lv for m in measures.values()):
            if all(cuts):
                r = r.withColumn(f"_cum{lv}", F.sum(f"_isrel{lv}").over(wrun))
            else:
                # numbered among the relevant rows of its list only; rows that are not relevant need no count
                r = keyed_ordinal(r, [*list_keys, f"_isrel{lv}"], ["_rank"], out=f"_cum{lv}")
    disc = F.log2(F.col("_rank") + 1)
    gain = _gain(F.col("relevance"), gains)

    n_rel = qr.groupBy("query_id").agg(*[F.count_if(_relevant(lv)).alias(f"_R{lv}") for lv in rels])
    best_first = [_gain(F.col("relevance"), gains).desc(), F.col("doc_id")]
    cutoffs = {m.cutoff for m in measures.values() if m.kind == "nDCG"}
    idcg = None
    if cutoffs:
        if all(cutoffs):
            ideal = qr.withColumn("_ir", F.row_number().over(Window.partitionBy("query_id").orderBy(*best_first))).filter(F.col("_ir") <= max(cutoffs))
        else:
            ideal = keyed_ordinal(qr, ["query_id"], best_first, out="_ir")
        ideal = ideal.withColumn("_ig", _gain(F.col("relevance"), gains) / F.log2(F.col("_ir") + 1))
        idcg = ideal.groupBy("query_id").agg(
            *[F.sum(F.when(F.col("_ir") <= c, F.col("_ig")) if c else F.col("_ig")).alias(f"_idcg{c}") for c in cutoffs]
        )

    aggs = []
    for name, m in measures.items():
        within = (F.col("_rank") <= m.cutoff) if m.cutoff else F.lit(True)
        if m.kind == "P":
            aggs.append((F.sum(F.when(within, F.col(f"_isrel{m.rel}")).otherwise(0)) / F.lit(float(m.cutoff))).alias(name))
        elif m.kind == "AP":
            aggs.append(F.sum(F.when(within & (F.col(f"_isrel{m.rel}") == 1), F.col(f"_cum{m.rel}") / F.col("_rank")).otherwise(0.0)).alias(f"_ap_{name}"))
            aggs.append(F.sum(F.when(within, F.col(f"_isrel{m.rel}")).otherwise(0)).alias(f"_hits_{name}"))
        elif m.kind == "nDCG":
            aggs.append(F.sum(F.when(within, gain / disc).otherwise(0.0)).alias(f"_dcg_{name}"))
        else:
            raise ValueError(m.kind)
    per_q = r.groupBy(*group_cols, "query_id").agg(*aggs).join(n_rel, "query_id")
    if idcg is not None:
        per_q = per_q.join(idcg, "query_id", "left")
    outs = []
    for name, m in measures.items():
        if m.kind == "P":
            outs.append(F.col(name))
        elif m.kind == "AP":
            denom = {
                "relevant": F.col(f"_R{m.rel}"),
                "min_k": F.least(F.col(f"_R{m.rel}"), F.lit(m.cutoff)) if m.cutoff else F.col(f"_R{m.rel}"),
                "hits": F.col(f"_hits_{name}"),
            }[ap_denominator]
            outs.append(F.when(denom > 0, F.col(f"_ap_{name}") / denom).otherwise(0.0).alias(name))
        else:
            idc = F.col(f"_idcg{m.cutoff}")
            empty = F.lit(None).cast("double") if empty_ndcg is None else F.lit(float(empty_ndcg))
            outs.append(F.when(idc > 0, F.col(f"_dcg_{name}") / idc).otherwise(empty).alias(name))
    per_q = per_q.select(*group_cols, "query_id", *outs)
    if fill_missing and group_cols:
        # groups are runs or parameters: few, listed in one value
        groups = run.select(*group_cols).distinct().agg(F.collect_list(F.struct(*group_cols)).alias("_g"))
        wanted = judged.select(F.inline(groups.scalar()), "query_id")
        per_q = wanted.join(per_q, list_keys, "left").fillna(0.0, list(measures))
    elif fill_missing:
        per_q = judged.join(per_q, "query_id", "left").fillna(0.0, list(measures))
    return per_q


def mean_metrics_skip_missing(run: DataFrame, qrels: DataFrame, measures: dict[str, Measure] | None = None,
                              group_cols: Sequence[str] = (), **kw) -> DataFrame:
    """E6 / E8 with ``missing = skip``: the mean over judged queries present in the run (and,
    with ``empty_ndcg=None``, over queries whose nDCG is defined)."""
    measures = measures or DEFAULT_MEASURES
    per_q = per_query_metrics(run, qrels, measures, group_cols, fill_missing=False, **kw)
    return per_q.groupBy(*group_cols).agg(*[F.avg(F.col(f"`{n}`")).alias(n) for n in measures])


def mean_metrics(
    run: DataFrame,
    qrels: DataFrame,
    measures: dict[str, Measure] | None = None,
    group_cols: Sequence[str] = (),
    score_col: str = "score",
    tie: str = "desc",
    gains: dict[int, float] | None = None,
    judged_cols: Sequence[str] = (),
) -> DataFrame:
    """Mean of each measure over all judged queries, one row per group.

    ``judged_cols``: group columns that ``qrels`` has too (a ``dataset``, say); a group's mean is then over the judged queries of
    its own dataset. Query ids must differ between datasets."""
    measures = measures or DEFAULT_MEASURES
    per_q = per_query_metrics(run, qrels, measures, group_cols, score_col, tie, gains, fill_missing=False)
    if judged_cols:
        sums = per_q.groupBy(*group_cols).agg(*[F.sum(n).alias(n) for n in measures])
        sums = run.select(*group_cols).distinct().join(sums, list(group_cols), "left")
        judged = qrels.select(*judged_cols, F.col("query_id").cast("string").alias("query_id")).distinct().groupBy(*judged_cols).agg(F.count(F.lit(1)).alias("_n"))
        own = sums.join(judged, list(judged_cols), "left")
        return own.select(*group_cols, *[F.coalesce(F.col(n) / F.col("_n"), F.lit(0.0)).alias(n) for n in measures])
    # the number of judged queries is one scalar (a small job over the qrels)
    n_judged = prepare_qrels(qrels).select("query_id").distinct().count()
    sums = per_q.groupBy(*group_cols).agg(*[F.sum(n).alias(n) for n in measures])
    if group_cols:
        # a run without a judged query still has its row, of zeros
        sums = run.select(*group_cols).distinct().join(sums, list(group_cols), "left")
    mean = lambda n: F.coalesce(F.col(n) / F.lit(float(max(n_judged, 1))), F.lit(0.0))
    return sums.select(*group_cols, *[mean(n).alias(n) for n in measures])


def evaluate_run(run: DataFrame, qrels: DataFrame, measures: dict[str, Measure] | None = None, **kw) -> DataFrame:
    """E8 for one run: a one-row frame with one column per measure."""
    return mean_metrics(run, qrels, measures, **kw)


def evaluate_runs(runs: DataFrame, qrels: DataFrame, measures: dict[str, Measure] | None = None, digits: int = 4) -> DataFrame:
    """E8 for many runs in one job: one row per ``run_name``, sorted, rounded."""
    measures = measures or RUN_MEASURES
    runs = runs.checkpoint()  # read by the ranks and, in a job of its own, by the list of runs: searched once
    out = mean_metrics(runs, qrels, measures, group_cols=["run_name"])
    return out.select("run_name", *[F.round(n, digits).alias(n) for n in measures]).orderBy("run_name")
