"""Alignment of predicted with true line items and tax entries.

Similarities of all item pairs of a document are computed in the row by nested
array functions; only the numbers of that small matrix go to Python, where an
optimal one-to-one assignment is found.  No shuffle: both arrays are in the row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import normalize as N
from ..functions import similarity as M
from ..plans.registry import ITEM_FIELDS, TAX_FIELDS
from ..plans.shipping import ship_package

PAIRS = T.ArrayType(T.StructType([T.StructField("g", T.IntegerType()), T.StructField("p", T.IntegerType())]))
LEAST_SIMILARITY = 0.3


def assign(similarity: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of the one-to-one assignment of largest sum, for a
    matrix of any shape: shortest augmenting paths with potentials, O(n^3).

    Ties go to the smaller column, so equal rows pair up in order.
    """
    rows, cols = similarity.shape
    n = max(rows, cols)
    cost = np.zeros((n + 1, n + 1))
    cost[1 : rows + 1, 1 : cols + 1] = -similarity
    u, v, match = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used, back = np.full(n + 1, np.inf), np.zeros(n + 1, bool), np.zeros(n + 1, int)
        while match[j0]:
            used[j0] = True
            i0 = match[j0]
            slack = cost[i0] - u[i0] - v
            better = ~used & (slack < least - 1e-12)
            better[0] = False
            least[better] = slack[better]
            back[better] = j0
            open_ = np.where(used, np.inf, least)
            open_[0] = np.inf
            j1 = int(np.argmin(open_))
            step = open_[j1]
            u[match[used]] += step
            v[used] -= step
            least[~used] -= step
            j0 = j1
        while j0:
            j1 = back[j0]
            match[j0] = match[j1]
            j0 = j1
    return [(int(match[j]) - 1, j - 1) for j in range(1, n + 1) if match[j] <= rows and j <= cols]


def greedy(similarity: np.ndarray) -> list[tuple[int, int]]:
    """Pairs taken from the most similar down; ties go to larger indices."""
    order = sorted(((similarity[i, j], i, j) for i in range(similarity.shape[0]) for j in range(similarity.shape[1])), reverse=True)
    rows, cols, out = set(), set(), []
    for _, i, j in order:
        if i not in rows and j not in cols:
            rows.add(i)
            cols.add(j)
            out.append((i, j))
    return out


def _with_pairs(df: DataFrame, matrix: str, out: str, least: float, method: str) -> DataFrame:
    """df with the pairs of each row's similarities, by the optimal assignment or
    the greedy one; the other columns pass through as they are."""

    def one(rows) -> list[dict]:
        if not rows or not rows[0]:
            return []
        if method == "greedy":
            m = np.array(rows, float)
            return [{"g": i, "p": j} for i, j in sorted(greedy(m)) if m[i, j] >= least]
        if len(rows) <= len(rows[0]):  # each item's best is another's: nothing to trade
            first = [r.index(max(r)) for r in rows]
            if len(set(first)) == len(first):
                return [{"g": i, "p": j} for i, j in enumerate(first) if rows[i][j] >= least]
        m = np.array(rows, float)
        return [{"g": i, "p": j} for i, j in sorted(assign(m)) if m[i, j] >= least]

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("g", pa.int32()), ("p", pa.int32())]))
        for batch in batches:
            made = pa.array([one(rows) for rows in batch.column(matrix).to_pylist()], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, out])

    return df.mapInArrow(paired, T.StructType([*df.schema.fields, T.StructField(out, PAIRS)]))


def _as_text(c: Column) -> Column:
    return c.cast("string")


def _prepared(items: Column, fields: tuple) -> Column:
    """What pairing needs of each item, normalised once: struct(text, words, amount)."""
    names = {f[0] for f in fields}

    def one(x: Column) -> Column:
        said = x["description"].cast("string") if "description" in names else F.lit(None).cast("string")
        text = F.when(F.coalesce(said, F.lit("")) != "", F.coalesce(N.text(said), F.lit("")))
        return F.struct(text.alias("text"), (x["amount"] if "amount" in names else F.lit(None)).cast("double").alias("amount"))

    words = lambda x: F.struct(x["text"].alias("text"), F.array_distinct(F.filter(F.split(F.coalesce(x["text"], F.lit("")), " "), lambda t: t != "")).alias("words"), x["amount"].alias("amount"))
    return F.transform(F.transform(items, one), words)


def item_similarity(g: Column, p: Column) -> Column:
    """How alike two prepared items are for pairing: description first, then amount."""
    size = F.size(g["words"]) + F.size(p["words"])
    tokens = F.when(size == 0, 1.0).otherwise(2.0 * F.size(F.array_intersect(g["words"], p["words"])) / size)
    near = F.when(g["text"] == p["text"], 1.0).otherwise(F.greatest(tokens, 1.0 - F.levenshtein(g["text"], p["text"]) / F.greatest(F.length(g["text"]), F.length(p["text"]))))
    said = F.when(g["text"].isNull() | p["text"].isNull(), 0.0).otherwise(near)
    off = F.abs(g["amount"] - p["amount"]) / F.abs(g["amount"])
    paid = F.when(g["amount"].isNull() & p["amount"].isNull(), 1.0).when(g["amount"].isNull() | p["amount"].isNull(), 0.0).when(F.abs(g["amount"] - p["amount"]) <= 0.02, 1.0).when((g["amount"] != 0) & (off < 0.5), 1.0 - off).otherwise(0.0)
    return 0.6 * said + 0.4 * paid


def _pair_score(kind: str, g: Column, p: Column) -> Column:
    g0, p0 = N.is_null(_as_text(g)), N.is_null(_as_text(p))
    if kind == "numeric":
        a, b = N.number(_as_text(g)), N.number(_as_text(p))
        inner = F.coalesce(M.numeric_exact(a, b, 0.02), F.lit(0.0))
    else:
        inner = F.greatest(M.token_f1(_as_text(g), _as_text(p)), M.levenshtein_similarity(_as_text(g), _as_text(p)))
    return F.when(g0 & p0, 1.0).when(g0 | p0, 0.0).otherwise(inner)


def _part(name: str):
    """A one-argument accessor (a second argument would be the index)."""
    return lambda s: s[name]


def align_items(df: DataFrame, gt: str, pred: str, out: str, fields: tuple = ITEM_FIELDS, least: float = LEAST_SIMILARITY, method: str = "optimal") -> DataFrame:
    """df with a struct column out: counts, count_accuracy, precision, recall, f1,
    overall, pairs, and the mean score of each item field over the pairs.

    Both lists empty is a perfect match; only one empty is none.  method is
    "optimal" or "greedy", which takes the most similar pair first.
    """
    if method not in ("optimal", "greedy"):
        raise ValueError(f"unknown method {method}")
    ship_package(df.sparkSession)
    g, p = F.coalesce(F.col(gt), F.array().cast(df.schema[gt].dataType)), F.coalesce(F.col(pred), F.array().cast(df.schema[pred].dataType))
    ready = df.select("*", _prepared(g, fields).alias("_g"), _prepared(p, fields).alias("_p"))
    matrix = F.transform("_g", lambda x: F.transform("_p", lambda y: item_similarity(x, y)))
    staged = _with_pairs(ready.withColumn("_matrix", matrix).drop("_g", "_p"), "_matrix", "_pairs", least, method).drop("_matrix")
    n_g, n_p, n = F.size(g), F.size(p), F.size("_pairs")
    scored = F.transform("_pairs", lambda q: F.struct(*(_pair_score(k, F.get(g, q["g"])[f], F.get(p, q["p"])[f]).alias(f) for f, k, _ in fields)))
    staged = staged.withColumn("_scores", scored)
    weight = sum(w for _, _, w in fields)
    pair_mean = F.transform("_scores", lambda s: sum((s[f] * w for f, _, w in fields[1:]), s[fields[0][0]] * fields[0][2]) / weight)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda t, x: t + x)
    both_empty, none_true, none_said = (n_g == 0) & (n_p == 0), n_g == 0, n_p == 0
    pick = lambda empty, true, said, value: F.when(both_empty, empty).when(none_true, true).when(none_said, said).otherwise(value)
    f1 = F.when(n > 0, 2.0 * n / (n_g + n_p)).otherwise(0.0)
    quality = F.when(n > 0, total(pair_mean) / n).otherwise(0.0)
    result = F.struct(
        n_g.alias("gt_count"), n_p.alias("pred_count"), F.col("_pairs").alias("pairs"),
        pick(1.0, 0.0, 0.0, 1.0 - F.abs(n_g - n_p) / F.greatest(n_g, n_p)).alias("count_accuracy"),
        pick(1.0, 0.0, 1.0, n / n_p.cast("double")).alias("precision"),
        pick(1.0, 1.0, 0.0, n / n_g.cast("double")).alias("recall"),
        pick(1.0, 0.0, 0.0, f1).alias("f1"),
        pick(1.0, 0.0, 0.0, f1 * quality).alias("overall"),
        F.struct(*(F.when(n > 0, total(F.transform("_scores", _part(f))) / n).alias(f) for f, _, _ in fields)).alias("fields"),
    )
    return staged.withColumn(out, result).drop("_pairs", "_scores")


def align_taxes(df: DataFrame, gt: str, pred: str, out: str) -> DataFrame:
    """Tax entries have nothing to be paired by: every pair is equally alike, and
    the entries pair up in order."""
    return align_items(df, gt, pred, out, TAX_FIELDS)


def first_fit_f1(gt: Column, pred: Column) -> Column:
    """The flat scorer's item F1: each predicted item, in order, takes the first
    unused true item of like description and amount.  An array fold with the
    used indices as state."""

    def like(x: Column, y: Column) -> Column:
        a, b = N.flat_text(x["description"]), N.flat_text(y["description"])
        inside = (b.contains(a) | a.contains(b)) & (F.length(a) > 3)
        paid = F.when(y["amount"].isNull(), True).otherwise(F.abs(F.coalesce(x["amount"], F.lit(0.0)) - y["amount"]) <= 0.05)
        return ((a == b) | inside) & paid

    def take(used: Column, x: Column) -> Column:
        free = F.filter(F.sequence(F.lit(0), F.size(gt) - 1), lambda j: ~F.array_contains(used, j) & like(x, F.get(gt, j)))
        return F.when(F.size(free) > 0, F.concat(used, F.slice(free, 1, 1))).otherwise(used)

    used = F.size(F.aggregate(pred, F.array().cast("array<int>"), take))
    no_gt, no_pred = gt.isNull() | (F.size(gt) == 0), pred.isNull() | (F.size(pred) == 0)
    return F.when(no_gt, 1.0).when(no_pred, 0.0).otherwise(2.0 * used / (F.size(gt) + F.size(pred)))
