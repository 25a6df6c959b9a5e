"""Validation, arithmetic repair and normalisation of generated records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import normalize as N


def _filled(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def validation_issues(docs: DataFrame) -> DataFrame:
    """docs with ``issues`` (array of text) and ``is_valid``: only a missing
    supplier or date makes a record invalid; sums are reported."""
    net, tax, total = (F.col(f"document_total_{n}") for n in ("net", "tax", "amount"))
    items = F.aggregate(F.coalesce("line_items", F.array().cast(docs.schema["line_items"].dataType)), F.lit(0.0), lambda s, x: s + F.coalesce(x["amount"], F.lit(0.0)))
    issues = F.array_compact(
        F.array(
            F.when(~_filled(F.col("supplier_name")), "missing supplier_name"),
            F.when(~_filled(F.col("document_date")), "missing document_date"),
            F.when(F.abs(net + tax - total) > 0.10, "total mismatch"),
            F.when((F.size("line_items") > 0) & (items > 0) & (F.abs(items - net) > 1.0), "line items sum mismatch"),
        )
    )
    return docs.withColumn("issues", issues).withColumn("is_valid", ~F.exists("issues", lambda x: x.startswith("missing")))


def repair_math(docs: DataFrame) -> DataFrame:
    """Makes amounts follow from quantities and rates, and totals from lines.

    An empty list zeroes the totals, a null one changes nothing; taxes are
    rewritten only if there is exactly one entry.
    """
    kind = docs.schema["line_items"].dataType

    def fixed(x: Column) -> Column:
        quantity = F.when(F.coalesce(x["quantity"], F.lit(0.0)) == 0, 1.0).otherwise(x["quantity"])
        price, amount = F.coalesce(x["unit_price"], F.lit(0.0)), F.coalesce(x["amount"], F.lit(0.0))
        expected = F.round(quantity * price, 2)
        paid = F.when((price > 0) & (F.abs(expected - amount) > 0.02), expected).otherwise(amount)
        text = F.trim(F.replace(F.coalesce(x["tax_rate"], F.lit("0")), F.lit("%"), F.lit("")))
        share = F.when(text == "", 0.0).otherwise(N.plain_float(text))
        rate = F.when(share > 1, share / 100).otherwise(share)
        taxed = F.coalesce(F.round(paid * rate, 2), x["tax_amount"])
        values = {"amount": paid, "tax_amount": taxed}
        return F.struct(*(values.get(f, x[f]).alias(f) for f in kind.elementType.names))

    total = lambda items, f: F.round(F.aggregate(items, F.lit(0.0), lambda s, x: s + F.coalesce(x[f], F.lit(0.0))), 2)
    lines = docs.withColumn("line_items", F.transform("line_items", fixed))
    have = F.col("line_items").isNotNull()
    lines = lines.withColumns({f"document_total_{n}": F.when(have, total(F.col("line_items"), f)).otherwise(F.col(f"document_total_{n}")) for n, f in (("net", "amount"), ("tax", "tax_amount"))})
    lines = lines.withColumn("document_total_amount", F.when(have, F.round(F.col("document_total_net") + F.col("document_total_tax"), 2)).otherwise(F.col("document_total_amount")))
    if "taxes" not in docs.columns:
        return lines
    parts = docs.schema["taxes"].dataType.elementType.names
    values = {"base": F.col("document_total_net"), "value": F.col("document_total_tax")}
    single = F.transform("taxes", lambda t: F.struct(*(values.get(p, t[p]).alias(p) for p in parts)))
    return lines.withColumn("taxes", F.when(have & (F.size("taxes") == 1), single).otherwise(F.col("taxes")))


def _rate_as_text(field: str):
    return lambda x: x.withField(field, F.when(x[field].isNotNull(), N.tax_rate_text(x[field].cast("string"))))


def normalize_records(docs: DataFrame) -> DataFrame:
    """Tax rates as percentage texts, registration lists as one text, locale en."""
    out = docs.withColumn("locale", F.lit("en"))
    for array, field in (("line_items", "tax_rate"), ("taxes", "rate")):
        if array in docs.columns:
            out = out.withColumn(array, F.transform(array, _rate_as_text(field)))
    for c in ("supplier_company_registrations", "customer_company_registrations"):
        if c in docs.columns and dict(docs.dtypes)[c].startswith("array"):
            out = out.withColumn(c, F.array_join(c, ", "))
    return out


def fill_absent(docs: DataFrame, fields: list[str]) -> DataFrame:
    """Adds the fields that the table lacks, as nulls; others are untouched."""
    return docs.withColumns({f: F.lit(None).cast("string") for f in fields if f not in docs.columns})
