"""Schemas and the field registry that drives typed comparison and scoring."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    tier: int
    weight: float
    identity: bool = False
    exact_from: float = 0.90
    acceptable_from: float = 0.75
    partial_from: float = 0.55
    tolerance: float = 0.01


# Fields, kinds, tiers, weights and thresholds of the scoring scheme.
FIELDS: tuple[Field, ...] = (
    Field("supplier_name", "short_string", 1, 1.0, True),
    Field("document_date", "date", 1, 1.0),
    Field("document_currency", "short_string", 1, 0.8, True, 0.95),
    Field("document_total_amount", "numeric", 1, 1.5),
    Field("document_total_net", "numeric", 1, 1.0),
    Field("document_total_tax", "numeric", 1, 1.0),
    Field("line_items", "line_items", 1, 2.0),
    Field("invoice_number", "short_string", 1, 0.8, True),
    Field("document_category", "category", 1, 0.7),
    Field("payment_date", "date", 1, 0.3),
    Field("subcategory", "category", 2, 0.5),
    Field("document_number", "short_string", 2, 0.8, True),
    Field("receipt_number", "short_string", 3, 0.5, True),
    Field("document_type_extended", "category", 2, 0.5),
    Field("taxes", "tax_items", 2, 1.0),
    Field("supplier_company_registrations", "short_string", 2, 0.6, True),
    Field("due_date", "date", 2, 0.5),
    Field("reference_numbers", "short_string", 3, 0.3, True),
    Field("po_number", "short_string", 3, 0.3, True),
    Field("document_time", "time", 3, 0.3),
    Field("customer_name", "short_string", 3, 0.5, True),
    Field("customer_id", "short_string", 3, 0.3, True),
    Field("customer_address", "medium_string", 3, 0.4),
    Field("billing_address", "medium_string", 3, 0.3),
    Field("shipping_address", "medium_string", 3, 0.3),
    Field("supplier_address", "medium_string", 3, 0.4),
    Field("supplier_email", "short_string", 3, 0.3, True),
    Field("supplier_phone", "short_string", 3, 0.3, True),
    Field("supplier_website", "short_string", 3, 0.3, True),
    Field("customer_company_registrations", "short_string", 3, 0.3, True),
    Field("locale", "short_string", 3, 0.2),
    Field("notes", "long_text", 3, 0.3),
)
ITEM_FIELDS = (("description", "medium_string", 1.5), ("quantity", "numeric", 0.5), ("unit_price", "numeric", 1.0), ("amount", "numeric", 1.2), ("tax_rate", "short_string", 0.5), ("tax_amount", "numeric", 0.8))
TAX_FIELDS = (("base", "numeric", 1.0), ("rate", "numeric", 1.0), ("code", "short_string", 0.5), ("value", "numeric", 1.2))
TIER_WEIGHTS = {1: 0.60, 2: 0.25, 3: 0.15}
GRADES = ("exact", "acceptable", "partial", "wrong", "null_match", "hallucination", "miss")
METRICS = ("wfes", "entity_f1", "anls", "line_item_f1")
# End of fixed values.

NESTED_KINDS = ("line_items", "tax_items")

ITEM_TYPE = T.ArrayType(T.StructType([T.StructField(n, T.DoubleType() if n in ("quantity", "unit_price", "amount", "tax_amount") else T.StringType()) for n in ("description", "quantity", "unit_price", "amount", "tax_rate", "tax_amount")]))
TAX_TYPE = T.ArrayType(T.StructType([T.StructField(n, T.DoubleType() if n in ("base", "value") else T.StringType()) for n in ("base", "rate", "code", "value")]))

#: A document: every scored field, what names it, and what a label adds.
TEXT_COLUMNS = ("file_name", "mime_type", "labeled_at")
DOCUMENT = T.StructType(
    [T.StructField(n, T.StringType()) for n in TEXT_COLUMNS]
    + [T.StructField(f.name, {"line_items": ITEM_TYPE, "tax_items": TAX_TYPE, "numeric": T.DoubleType()}.get(f.kind, T.StringType())) for f in FIELDS]
    + [T.StructField("_template_used", T.StringType()), T.StructField("_synthetic", T.BooleanType()), T.StructField("_font_info", T.StringType()), T.StructField("degradation_variants", T.MapType(T.StringType(), T.StringType()))]
)


def selected(tiers: set[int] | None = None, names: set[str] | None = None, kinds: set[str] | None = None, extra: tuple[Field, ...] = ()) -> list[Field]:
    """Registry rows by tier, name and kind; extra adds to the registry."""
    return [f for f in (*FIELDS, *extra) if (tiers is None or f.tier in tiers) and (names is None or f.name in names) and (kinds is None or f.kind in kinds)]


def field_registry(spark: SparkSession) -> DataFrame:
    """The registry as a DataFrame, for introspection and joins."""
    return spark.createDataFrame(
        [(k, f.name, f.kind, f.tier, f.weight, f.identity, f.exact_from, f.acceptable_from, f.partial_from, f.tolerance) for k, f in enumerate(FIELDS)],
        "position int, name string, field_type string, tier int, weight double, identity_critical boolean, threshold_exact double, threshold_acceptable double, threshold_partial double, numeric_tolerance double",
    )


def item_registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("line_items", *f) for f in ITEM_FIELDS] + [("taxes", *f) for f in TAX_FIELDS], "list string, name string, field_type string, weight double")
