"""Typed comparison of a true and a predicted value.

Each side is normalised once, into one struct for all kinds; the comparison then
works on those structs.  So the plan holds one comparison, however many fields
are scored, and edit distances are computed only where nothing cheaper decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.registry import Field
from . import normalize as N
from . import similarity as M

RESULT = ("null_status", "exact_match", "similarity", "levenshtein", "grade")
_TEXTS = ("short_string", "category", "medium_string", "long_text")


def prepared(f: Field, value: Column, typed: bool = False) -> Column:
    """What the comparison needs of one value: a struct with the parts of its
    kind filled.  typed: the column is a number already."""
    string = value.cast("string")
    kind = f.kind if f.kind in ("numeric", "date", "time", *_TEXTS) else "short_string"
    none = lambda t: F.lit(None).cast(t)
    number = (value.cast("double") if typed else N.number(string)) if kind == "numeric" else none("double")
    clock = N.time(string) if kind == "time" else none("string")
    text = N.text(string) if kind in _TEXTS else N.text(clock) if kind == "time" else none("string")
    return F.struct(
        (value.isNull() if typed else N.is_null(string)).alias("missing"),
        number.alias("number"),
        (N.date(string) if kind == "date" else none("date")).alias("day"),
        clock.alias("clock"),
        text.alias("text"),
        (N.identifier(string) if kind in ("short_string", "category") else none("string")).alias("ident"),
        (string if kind == "long_text" else none("string")).alias("raw"),
    )


def described(f: Field) -> list[Column]:
    """Constant columns of a field that ``judged`` and the reports use."""
    values = {"field_name": f.name, "field_type": f.kind, "tier": f.tier, "weight": f.weight, "tolerance": f.tolerance, "exact_from": f.exact_from, "acceptable_from": f.acceptable_from, "partial_from": f.partial_from}
    return [F.lit(v).alias(k) for k, v in values.items()]


def judged(rows: DataFrame) -> DataFrame:
    """rows (described fields; _g, _p: prepared structs) with the result columns."""
    g, p, kind = F.col("_g"), F.col("_p"), F.col("field_type")
    texts = kind.isin("short_string", "category", "medium_string", "long_text")
    status = F.when(g["missing"] & p["missing"], "tn").when(g["missing"], "fp").when(p["missing"], "fn").otherwise("tp")
    equal = F.when(kind == "numeric", F.abs(g["number"] - p["number"]) <= F.col("tolerance")).when(kind == "date", g["day"] == p["day"]).when(kind == "time", g["clock"] == p["clock"]).otherwise(g["text"].eqNullSafe(p["text"]))
    alike = kind.isin("short_string", "category") & (g["ident"] != "") & (g["ident"] == p["ident"])
    rows = rows.withColumns({"null_status": status, "_equal": F.coalesce(equal, F.lit(False)), "_alike": F.coalesce(alike, F.lit(False))})
    open_ = (F.col("null_status") == "tp") & ~F.col("_equal") & ~F.col("_alike")
    words = lambda c: F.coalesce(F.filter(F.split(c, " "), lambda t: t != ""), F.array().cast("array<string>"))
    rows = rows.withColumns(
        {
            "_lev": F.when(open_ & kind.isin("short_string", "category", "medium_string", "time"), M.levenshtein_of(g["text"], p["text"])),
            "_words": F.when(open_ & kind.isin("short_string", "medium_string", "long_text"), M.token_scores_of(words(g["text"]), words(p["text"]))["f1"]),
            "_recall": F.when(open_ & (kind == "long_text"), M.key_information_recall(g["raw"], p["raw"])),
            "_off": F.when(open_ & (kind == "numeric"), M.relative_error(g["number"], p["number"])),
            "_parts": F.when(open_ & (kind == "date"), (F.year(g["day"]) == F.year(p["day"])).cast("int") + (F.month(g["day"]) == F.month(p["day"])).cast("int") + (F.dayofmonth(g["day"]) == F.dayofmonth(p["day"])).cast("int")),
            "_swap": (F.year(g["day"]) == F.year(p["day"])) & (F.month(g["day"]) == F.dayofmonth(p["day"])) & (F.dayofmonth(g["day"]) == F.month(p["day"])) & (F.month(g["day"]) != F.dayofmonth(g["day"])),
        }
    )
    lev, off, parts, swap = F.col("_lev"), F.col("_off"), F.col("_parts"), F.coalesce("_swap", F.lit(False))
    by_kind = (
        F.when(kind == "numeric", F.when(off < 1.0, 1.0 - off).otherwise(0.0))
        .when(kind == "date", F.when(parts.isNull(), 0.0).when(swap, 0.5).otherwise(parts / 3.0))
        .when(kind == "time", lev)
        .when(kind == "category", F.when(lev >= 0.8, 0.7).otherwise(0.0))
        .when(kind == "medium_string", F.col("_words"))
        .when(kind == "long_text", 0.5 * F.col("_words") + 0.5 * F.col("_recall"))
        .otherwise(F.greatest(lev, F.col("_words")))
    )
    similarity = F.when((F.col("null_status") == "tn") | ((F.col("null_status") == "tp") & (F.col("_equal") | F.col("_alike"))), 1.0).when(F.col("null_status") == "tp", by_kind).otherwise(0.0)
    rows = rows.withColumn("similarity", similarity)
    score = F.col("similarity")
    absolute = F.abs(g["number"] - p["number"])
    graded = (
        F.when(kind == "numeric", F.when(F.coalesce(absolute <= 0.05, F.lit(False)) | F.coalesce(off < 0.05, F.lit(False)), "acceptable").when(off < 0.20, "partial").otherwise("wrong"))
        .when(kind == "date", F.when(swap | (parts >= 2), "partial").otherwise("wrong"))
        .when(kind == "time", F.when(lev > 0.5, "partial").otherwise("wrong"))
        .when(kind == "category", F.when(lev >= 0.8, "partial").otherwise("wrong"))
        .otherwise(F.when(score >= F.col("exact_from"), "exact").when(score >= F.col("acceptable_from"), "acceptable").when(score >= F.col("partial_from"), "partial").otherwise("wrong"))
    )
    grade = F.when(F.col("null_status") == "tn", "null_match").when(F.col("null_status") == "fp", "hallucination").when(F.col("null_status") == "fn", "miss").when(F.col("_equal") | F.col("_alike"), "exact").otherwise(graded)
    exact = F.when((F.col("null_status") == "tn") | ((F.col("null_status") == "tp") & F.col("_equal")), 1.0).otherwise(0.0)
    recorded = F.when(texts, lev)  # times are judged by their edit distance but do not record it
    return rows.withColumns({"exact_match": exact, "levenshtein": recorded, "grade": grade}).drop("_equal", "_alike", "_lev", "_words", "_recall", "_off", "_parts", "_swap")


def compare_pairs(df: DataFrame, f: Field, gt: str, pred: str, typed: bool = False) -> DataFrame:
    """df with the result columns of one field compared between two columns."""
    staged = df.select(F.struct(*df.columns).alias("_row"), *described(f), prepared(f, F.col(gt), typed).alias("_g"), prepared(f, F.col(pred), typed).alias("_p"))
    return judged(staged).select("_row.*", *RESULT)


def flat_string_match(pred: Column, gold: Column, is_date: bool = False) -> Column:
    """The flat scorer's text match; nothing to match is a match."""
    same = N.flat_date(pred) == N.flat_date(gold) if is_date else N.flat_text(pred) == N.flat_text(gold)
    return F.when(gold.isNull() | (gold == ""), True).otherwise(same)


def flat_number_match(pred: Column, gold: Column, tolerance: float = 0.02) -> Column:
    return F.when(gold.isNull(), True).otherwise(F.coalesce(F.abs(F.coalesce(pred, F.lit(0.0)) - gold) <= tolerance, F.lit(False)))
