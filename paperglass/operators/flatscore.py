"""The flat scorer: accuracies by image condition, greedy item F1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.compare import flat_number_match, flat_string_match
from .align import first_fit_f1
from .score import last_wins

# The fields that the flat scorer looks at.
STRING_FIELDS = ("supplier_name", "document_date", "document_currency", "document_category", "invoice_number", "receipt_number", "customer_name")
NUMERIC_FIELDS = ("document_total_amount", "document_total_net", "document_total_tax")
# End of fixed values.


def flat_matches(gt: DataFrame, pred: DataFrame, key: str = "file_name", order: str | None = None) -> DataFrame:
    """One row for each prediction that has a true document (repeats kept): the
    condition, and for each field a match flag, null where there is no truth."""
    have_s = [f for f in STRING_FIELDS if f in gt.columns]
    have_n = [f for f in NUMERIC_FIELDS if f in gt.columns]
    gt = last_wins(gt, key, order) if order else gt
    condition = F.coalesce("g.degradation", F.lit("unknown")) if "degradation" in gt.columns else F.lit("unknown")
    both = pred.alias("p").join(gt.alias("g"), key)

    def side(s: str, df: DataFrame, f: str) -> Column:
        return F.col(f"{s}.{f}") if f in df.columns else F.lit(None)

    text = [F.when(F.coalesce(F.col(f"g.{f}"), F.lit("")) != "", flat_string_match(side("p", pred, f).cast("string"), F.col(f"g.{f}"), f == "document_date")).alias(f) for f in have_s]
    numbers = [F.when(F.col(f"g.{f}").isNotNull(), flat_number_match(side("p", pred, f).cast("double"), F.col(f"g.{f}"))).alias(f) for f in have_n]
    items = [first_fit_f1(F.col("g.line_items"), F.col("p.line_items")).alias("line_item_f1")] if "line_items" in gt.columns and "line_items" in pred.columns else []
    return both.select(key, condition.alias("degradation"), *text, *numbers, *items)


def flat_accuracy(matches: DataFrame) -> DataFrame:
    """Accuracy of each field by condition, their mean, the mean over amounts and
    the mean item F1."""
    fields = [c for c in (*STRING_FIELDS, *NUMERIC_FIELDS) if c in matches.columns]
    made = matches.groupBy("degradation").agg(F.count(F.lit(1)).alias("count"), *(F.avg(F.col(f).cast("int")).alias(f"{f}_acc") for f in fields), *([F.avg("line_item_f1").alias("line_item_f1")] if "line_item_f1" in matches.columns else []))

    def mean(names: list[str]) -> Column:
        some = F.array_compact(F.array(*(F.col(f"{n}_acc") for n in names)))
        return F.when(F.size(some) > 0, F.aggregate(some, F.lit(0.0), lambda s, x: s + x) / F.size(some)).otherwise(0.0)

    return made.withColumn("field_accuracy_mean", mean(fields)).withColumn("amount_accuracy", mean([f for f in fields if f in NUMERIC_FIELDS]))


def delta_to_clean(accuracy: DataFrame, metrics: list[str], clean: str = "clean") -> DataFrame:
    """(degradation, metric, value, delta): each metric less that of the clean
    condition, which is one row and goes to every task."""
    long = accuracy.select("degradation", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics))).alias("x")).select("degradation", "x.*")
    base = long.where(F.col("degradation") == clean).select("metric", F.col("value").alias("clean_value"))
    return long.join(F.broadcast(base), "metric", "left").select("degradation", "metric", "value", (F.col("value") - F.col("clean_value")).alias("delta"))
