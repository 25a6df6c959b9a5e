"""Scoring a set of predicted documents against the true ones.

match -> one row for each document and field -> run metrics, tier scores, entity
F1, ANLS, comparisons of models.  Fields are pruned before anything is compared,
so the scan reads only what is scored.  The long form is built by one explode in
the row; every aggregate combines before its shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.compare import RESULT, described, judged, prepared
from ..plans.registry import GRADES, NESTED_KINDS, TIER_WEIGHTS, Field, selected
from .align import align_items, align_taxes

KEY = "file_name"


def last_wins(df: DataFrame, key: str = KEY, order: str = "ordinal") -> DataFrame:
    """One row for each key: the last in input order.  An aggregate by max_by
    combines in the map task, so repeated keys do not meet in a sort."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_last")).select(key, *(F.col(f"_last.{c}").alias(c) for c in rest))


def _side(df: DataFrame, key: str, order: str | None, names: list[str], name: str, value, by: tuple[str, ...] = ()) -> DataFrame:
    have = [n for n in names if n in df.columns]
    if order:
        df = last_wins(df.select(key, order, *have), key, order)
    row = F.struct(*(value(df, n, n in have).alias(n) for n in names))
    return df.where(F.coalesce(F.col(key), F.lit("")) != "").select(key, *by, row.alias(name))


def matched(gt: DataFrame, pred: DataFrame, names: list[str], key: str = KEY, order: str | None = None) -> DataFrame:
    """(key, g, p): the documents in both sets as structs of the named columns,
    after last-wins dedup if an order is given; empty names take no part."""
    raw = lambda df, n, have: df[n] if have else F.lit(None).cast("string")
    return _joined(_side(gt, key, order, names, "g", raw), _side(pred, key, order, names, "p", raw), key)


def _joined(g: DataFrame, p: DataFrame, key: str) -> DataFrame:
    """Two sets of documents by key: both grow with the data, and what follows is
    work in the row, so both are dealt by key and neither is sent to all."""
    return g.hint("merge").join(p.hint("merge"), key)


def unmatched(gt: DataFrame, pred: DataFrame, key: str = KEY) -> DataFrame:
    """(side, key): names that only one set has."""
    g, p = gt.select(key).distinct(), pred.select(key).distinct()
    return g.join(p, key, "left_anti").select(F.lit("gt_only").alias("side"), key).unionByName(p.join(g, key, "left_anti").select(F.lit("pred_only").alias("side"), key))


def field_results(gt: DataFrame, pred: DataFrame, fields: Iterable[Field] | None = None, key: str = KEY, order: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(key, by..., field_name, field_type, tier, weight, null_status, exact_match,
    similarity, levenshtein, grade), one row for each document and scalar field.

    by: columns of the predictions that tell several runs apart; the truth is
    then read and joined once for all of them.
    """
    fields = [f for f in (selected() if fields is None else fields) if f.kind not in NESTED_KINDS]
    by_name = {f.name: f for f in fields}
    types = [dict(gt.dtypes), dict(pred.dtypes)]

    def value(df: DataFrame, n: str, have: bool) -> Column:
        typed = by_name[n].kind == "numeric" and all(t.get(n, "double") == "double" for t in types)
        return prepared(by_name[n], df[n] if have else F.lit(None).cast("double" if typed else "string"), typed)

    names = list(by_name)
    both = _joined(_side(gt, key, order, names, "g", value), _side(pred, key, order, names, "p", value, by), key)
    rows = [F.struct(*described(f), both["g"][f.name].alias("_g"), both["p"][f.name].alias("_p")) for f in fields]
    long = both.select(key, *by, F.explode(F.array(*rows)).alias("f")).select(key, *by, "f.*")
    return judged(long).select(key, *by, "field_name", "field_type", "tier", "weight", *RESULT)


def _share(condition: Column, total: Column) -> Column:
    return F.when(total > 0, F.count_if(condition) / total).otherwise(0.0)


def field_metrics(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Metrics of each field over all documents; true negatives count for
    presence but not for similarity and grades."""
    real = F.col("null_status") != "tn"
    n, seen = F.count(F.lit(1)), F.count_if(real)
    over = lambda f, c: F.coalesce(f(F.when(real, F.col(c))), F.lit(0.0))
    return results.groupBy(*(by or []), "field_name").agg(
        F.first("field_type").alias("field_type"), F.first("tier").alias("tier"), F.first("weight").alias("weight"),
        n.alias("n"), seen.alias("n_evaluated"),
        over(F.avg, "exact_match").alias("exact_match"), over(F.avg, "similarity").alias("similarity_mean"), over(F.min, "similarity").alias("similarity_min"), over(F.max, "similarity").alias("similarity_max"),
        *(F.count_if(F.col("null_status") == s).alias(s) for s in ("tp", "tn", "fp", "fn")),
        _share(F.col("null_status").isin("tp", "tn"), n).alias("presence_rate"), _share(F.col("null_status") == "fp", n).alias("hallucination_rate"), _share(F.col("null_status") == "fn", n).alias("miss_rate"), _share(F.col("null_status") == "tn", n).alias("tn_rate"),
        *(_share(real & (F.col("grade") == g), seen).alias(f"grade_{g}") for g in GRADES[:4]), *(_share(F.col("grade") == g, n).alias(f"grade_{g}") for g in GRADES[4:]),
    )


def grade_distribution(results: DataFrame) -> DataFrame:
    """(grade, n) of all seven grades, zeros included."""
    counted = results.agg(*(F.count_if(F.col("grade") == g).alias(g) for g in GRADES))
    return counted.select(F.explode(F.array(*(F.struct(F.lit(g).alias("grade"), F.col(g).alias("n")) for g in GRADES))).alias("x")).select("x.*")


def _tiers(scores: DataFrame, by: list[str], more: list[Column] | None = None) -> DataFrame:
    """Weighted mean of rows (by..., tier, score, weight) for each tier, and the
    overall score over the tiers that have any; more: further aggregates."""
    sums = [x for t in TIER_WEIGHTS for x in (F.sum(F.when(F.col("tier") == t, F.col("score") * F.col("weight"))).alias(f"s{t}"), F.sum(F.when(F.col("tier") == t, F.col("weight"))).alias(f"w{t}"))]
    made = scores.groupBy(*by).agg(*sums, *(more or []))
    part = {t: F.coalesce(F.col(f"s{t}") / F.col(f"w{t}"), F.lit(0.0)) for t in TIER_WEIGHTS}
    share = {t: F.when(F.col(f"w{t}").isNotNull(), w).otherwise(0.0) for t, w in TIER_WEIGHTS.items()}
    whole = share[1] + share[2] + share[3]
    overall = F.when(whole > 0, (share[1] * part[1] + share[2] * part[2] + share[3] * part[3]) / whole).otherwise(0.0)
    rest = [c for c in made.columns if c not in by and c[0] not in "sw" or c in ("n",)]
    return made.select(*by, *(part[t].alias(f"tier{t}_score") for t in TIER_WEIGHTS), overall.alias("overall_score"), *rest)


def item_results(gt: DataFrame, pred: DataFrame, key: str = KEY, order: str | None = None) -> DataFrame:
    """(key, line_items, taxes): the alignment structs of each matched document."""
    both = matched(gt, pred, [f.name for f in selected(kinds=set(NESTED_KINDS))], key, order).select(key, F.col("g.line_items").alias("gi"), F.col("p.line_items").alias("pi"), F.col("g.taxes").alias("gt"), F.col("p.taxes").alias("pt"))
    return align_taxes(align_items(both, "gi", "pi", "line_items"), "gt", "pt", "taxes").select(key, "line_items", "taxes")


def document_scores(results: DataFrame, items: DataFrame | None = None, key: str = KEY) -> DataFrame:
    """Tier and overall scores of each document: weighted means over its fields
    that are not true negatives, with item scores where given."""
    real = F.col("null_status") != "tn"  # a true negative only makes its document known
    scored = results.select(key, "tier", F.when(real, F.col("similarity")).alias("score"), F.when(real, F.col("weight")).alias("weight"))
    if items is not None:
        extra = [F.struct(F.lit(f.tier).alias("tier"), F.col(f"{f.name}.overall").alias("score"), F.lit(f.weight).alias("weight")) for f in selected(kinds=set(NESTED_KINDS))]
        scored = scored.unionByName(items.select(key, F.explode(F.array(*extra)).alias("x")).select(key, "x.*"))
    return _tiers(scored, [key])


def run_scores(metrics: DataFrame, items: DataFrame | None = None, by: list[str] | None = None) -> DataFrame:
    """Tier and overall scores of a run: weighted means of the fields' means, so
    a field counts once however often it appears.  by: keys of several runs.

    Item scores join tier 1, and those of taxes tier 2, only if items are given.
    """
    by = by or []
    scored = metrics.where(F.col("n_evaluated") > 0).select(*by, "tier", F.col("similarity_mean").alias("score"), "weight")
    if items is not None:
        means = items.groupBy(*by).agg(*(F.avg(f"{f.name}.overall").alias(f.name) for f in selected(kinds=set(NESTED_KINDS))))
        extra = [F.struct(F.lit(f.tier).alias("tier"), F.col(f.name).alias("score"), F.lit(f.weight).alias("weight")) for f in selected(kinds=set(NESTED_KINDS))]
        scored = scored.unionByName(means.select(*by, F.explode(F.array(*extra)).alias("x")).select(*by, "x.*").where(F.col("score").isNotNull()))
    return _tiers(scored, by).withColumnRenamed("overall_score", "wfes")


def item_run_metrics(items: DataFrame) -> DataFrame:
    """Means over documents; item fields over documents with any matched pair."""
    names = [f.name for f in items.schema["line_items"].dataType["fields"].dataType]
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return items.agg(*(mean(f"line_items.{c}").alias(c) for c in ("count_accuracy", "precision", "recall", "f1", "overall")), *(mean(f"line_items.fields.{n}").alias(f"field_{n}") for n in names))


def _f1(tp: Column, fp: Column, fn: Column) -> Column:
    return F.when(tp > 0, 2.0 * tp / (2.0 * tp + fp + fn)).otherwise(0.0)


def entity_f1(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Precision, recall and F1 of exact values, for each field and (field_name
    null) over all: one pass by grouping sets."""
    by = by or []
    s, hit = F.col("null_status"), F.col("exact_match") >= 1.0
    both = s == "tp"
    counted = results.groupBy(*by, "field_name").agg(F.count_if(both & hit).alias("tp"), F.count_if((s == "fp") | (both & ~hit)).alias("fp"), F.count_if((s == "fn") | (both & ~hit)).alias("fn"))
    every = _with_total(counted, by, ("tp", "fp", "fn"))
    ratio = lambda a, b: F.when(a + b > 0, a / (a + b)).otherwise(0.0)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return every.select(*by, "field_name", "tp", "fp", "fn", ratio(tp, fp).alias("precision"), ratio(tp, fn).alias("recall"), _f1(tp, fp, fn).alias("f1"))


def _anls_score(threshold: float) -> Column:
    s = F.col("null_status")
    value = F.when(F.col("field_type").isin("numeric", "date"), F.col("similarity")).otherwise(F.coalesce("levenshtein", "similarity"))
    return F.when(s == "tn", F.lit(None)).when(s != "tp", 0.0).when(value >= threshold, value).otherwise(0.0)


def anls(results: DataFrame, threshold: float = 0.5, by: list[str] | None = None) -> DataFrame:
    """Mean normalised edit similarity of each field and (field_name null) over
    all; below the threshold it is 0, true negatives are skipped."""
    by = by or []
    score = _anls_score(threshold)
    counted = results.groupBy(*by, "field_name").agg(F.sum(score).alias("total"), F.count(score).alias("n"), F.count_if(F.col("null_status") == "tn").alias("tn_skipped"))
    every = _with_total(counted, by, ("total", "n", "tn_skipped"))
    return every.select(*by, "field_name", F.when(F.col("n") > 0, F.col("total") / F.col("n")).otherwise(0.0).alias("anls"), "n", "tn_skipped")


def _with_total(counted: DataFrame, by: list[str], sums: tuple[str, ...]) -> DataFrame:
    """counted (one row a field) and a row over all fields, by a rollup of the
    small table, so that what is below is computed once."""
    return counted.groupingSets([[*by, "field_name"], [*by]], *by, "field_name").agg(*(F.sum(c).alias(c) for c in sums))


def standard_metrics(results: DataFrame, items: DataFrame | None = None, by: list[str] | None = None, threshold: float = 0.5) -> DataFrame:
    """(by..., wfes, entity_f1, entity_precision, entity_recall, anls
    [, line_item_f1]), one row for each run.

    One aggregation by field feeds all of them, so the comparisons are made once.
    """
    by = by or []
    s, hit = F.col("null_status"), F.col("exact_match") >= 1.0
    both = s == "tp"
    fields = results.groupBy(*by, "field_name").agg(
        F.first("tier").alias("tier"), F.first("weight").alias("weight"), F.avg(F.when(s != "tn", F.col("similarity"))).alias("score"),
        F.count_if(both & hit).alias("tp"), F.count_if((s == "fp") | (both & ~hit)).alias("fp"), F.count_if((s == "fn") | (both & ~hit)).alias("fn"),
        F.sum(_anls_score(threshold)).alias("near"), F.count(_anls_score(threshold)).alias("n"),
    )
    one = F.lit(1).alias("_run")
    keys = by or ["_run"]
    fields = fields if by else fields.select("*", one)
    scored = fields.where(F.col("score").isNotNull()).select(*keys, "tier", "score", "weight", "tp", "fp", "fn", "near", "n")
    if items is not None:
        means = items.groupBy(*by).agg(*(F.avg(f"{f.name}.overall").alias(f.name) for f in selected(kinds=set(NESTED_KINDS))), F.avg("line_items.f1").alias("line_item_f1"))
        means = means if by else means.select("*", one)
        extra = [F.struct(F.lit(f.tier).alias("tier"), F.col(f.name).alias("score"), F.lit(f.weight).alias("weight")) for f in selected(kinds=set(NESTED_KINDS))]
        zero = [F.lit(0).cast("long").alias(c) for c in ("tp", "fp", "fn")] + [F.lit(0.0).alias("near"), F.lit(0).cast("long").alias("n")]
        nested = means.select(*keys, F.explode(F.array(*extra)).alias("x"), F.col("line_item_f1")).select(*keys, "x.*", *zero, "line_item_f1").where(F.col("score").isNotNull())
        scored = scored.withColumn("line_item_f1", F.lit(None).cast("double")).unionByName(nested)
    more = [*(F.sum(c).alias(c) for c in ("tp", "fp", "fn", "near", "n")), *([F.first("line_item_f1", ignorenulls=True).alias("line_item_f1")] if items is not None else [])]
    tiers = _tiers(scored, keys, more)
    ratio = lambda a, b: F.when(a + b > 0, a / (a + b)).otherwise(0.0)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return tiers.select(
        *by, F.col("overall_score").alias("wfes"), _f1(tp, fp, fn).alias("entity_f1"), ratio(tp, fp).alias("entity_precision"), ratio(tp, fn).alias("entity_recall"),
        F.when(F.col("n") > 0, F.col("near") / F.col("n")).otherwise(0.0).alias("anls"), *(["line_item_f1"] if items is not None else []),
    )


def model_ranking(metrics: DataFrame, names: list[str], model: str = "model") -> DataFrame:
    """(metric, model, value, place): models by each metric, best first; ties go
    to the model that comes first by name."""
    long = metrics.select(model, F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names))).alias("x")).select("x.metric", model, "x.value")
    return long.withColumn("place", F.row_number().over(Window.partitionBy("metric").orderBy(F.desc("value"), model)))


def field_comparison(metrics: DataFrame, models: list[str], model: str = "model", value: str = "similarity_mean") -> DataFrame:
    """One row for each field, one column for each model, and the best model."""
    wide = metrics.groupBy("field_name").pivot(model, models).agg(F.first(value))
    best = F.greatest(*(F.coalesce(F.col(m), F.lit(-1.0)) for m in models))
    winner = F.coalesce(*(F.when(F.col(m) == best, F.lit(m)) for m in models))
    return wide.withColumn("winner", winner)


def document_reports(results: DataFrame, items: DataFrame | None = None, key: str = KEY) -> DataFrame:
    """(key, report): the JSON of each document - its scores, each field's result
    and, if given, the counts and scores of its items."""
    parts = F.map_from_entries(F.array_sort(F.collect_list(F.struct("field_name", F.struct(F.col("exact_match"), F.col("similarity"), F.col("grade"), F.col("null_status"))))))
    fields = results.groupBy(key).agg(parts.alias("fields"))
    whole = document_scores(results, items, key).join(fields, key)
    columns = [key, "overall_score", *(f"tier{t}_score" for t in TIER_WEIGHTS), "fields"]
    if items is not None:
        r, n = F.col("line_items"), F.size("line_items.pairs")
        counts = F.struct(
            r["gt_count"].alias("gt_count"), r["pred_count"].alias("pred_count"), r["count_accuracy"].alias("count_accuracy"), r["f1"].alias("item_f1"), r["overall"].alias("overall_score"),
            n.alias("matched_pairs"), (r["gt_count"] - n).alias("unmatched_gt"), (r["pred_count"] - n).alias("unmatched_pred"), r["fields"].alias("avg_field_scores"),
        )
        whole = whole.join(items.select(key, counts.alias("line_items")), key)
        columns.append("line_items")
    return whole.select(key, F.to_json(F.struct(*columns)).alias("report"))


def run_report(results: DataFrame, items: DataFrame | None = None, model: str = "model", dataset: str = "dataset", key: str = KEY) -> DataFrame:
    """(level, key, report): the run's scores, each field's metrics and each
    document's results as JSON rows, so that no document list is one row's work."""
    metrics = field_metrics(results)
    run = run_scores(metrics, items).select(F.col("wfes").alias("overall_weighted_score"), *(f"tier{t}_score" for t in TIER_WEIGHTS))
    graded = grade_distribution(results).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("grade", "n")))).alias("grade_distribution"))
    counted = results.agg(F.count_distinct(key).alias("num_documents"))
    one = run.join(graded).join(counted)  # one row each
    names = ["model_name", "dataset_name", "num_documents", *run.columns, "grade_distribution"]
    if items is not None:
        one = one.join(item_run_metrics(items).select(F.struct("*").alias("line_item_metrics")))
        names.append("line_item_metrics")
    head = one.withColumns({"model_name": F.lit(model), "dataset_name": F.lit(dataset)}).select(F.lit("run").alias("level"), F.lit(model).alias("key"), F.to_json(F.struct(*names)).alias("report"))
    fields = metrics.select(F.lit("field").alias("level"), F.col("field_name").alias("key"), F.to_json(F.struct("*")).alias("report"))
    docs = document_reports(results, items, key).select(F.lit("document").alias("level"), F.col(key).alias("key"), "report")
    return head.unionByName(fields).unionByName(docs)


def verbose_rows(results: DataFrame, scores: DataFrame, key: str = KEY) -> DataFrame:
    """Every field result with its document's score, worst documents first,
    fields by name."""
    rows = results.join(scores.select(key, "overall_score"), key)
    return rows.select(key, "overall_score", "field_name", "grade", "similarity").orderBy("overall_score", key, "field_name")


def run_timing(rows: DataFrame, seconds: str = "seconds", error: str = "error") -> DataFrame:
    """(documents, succeeded, failed, mean_seconds): the mean is over all."""
    return rows.agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col(error).isNull()).alias("succeeded"), F.count_if(F.col(error).isNotNull()).alias("failed"), F.avg(seconds).alias("mean_seconds"))


def worst_documents(scores: DataFrame, n: int = 5, key: str = KEY) -> DataFrame:
    return scores.orderBy("overall_score", key).limit(n)
