"""Normalising extraction output and merging the pages of a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.registry import FIELDS, ITEM_TYPE, TAX_TYPE

# Other names of fields, merge rules and defaults.
ALIASES = {
    "supplier_name": "supplierName", "document_date": "documentDate", "document_time": "documentTime", "invoice_number": "invoiceNumber", "document_currency": "currency",
    "document_total_amount": "totalAmount", "document_total_net": "subtotal", "document_total_tax": "taxAmount", "document_category": "category", "line_items": "lineItems",
    "file_name": "filename", "labeled_at": "labeledAt", "mime_type": "mimeType", "due_date": "dueDate", "payment_date": "paymentDate", "document_type_extended": "documentTypeExtended",
    "document_number": "documentNumber", "receipt_number": "receiptNumber", "reference_numbers": "referenceNumbers", "po_number": "poNumber", "customer_name": "customerName",
    "customer_id": "customerId", "customer_address": "customerAddress", "billing_address": "billingAddress", "shipping_address": "shippingAddress", "customer_company_registrations": "customerCompanyRegistrations",
    "supplier_address": "supplierAddress", "supplier_phone": "supplierPhone", "supplier_email": "supplierEmail", "supplier_website": "supplierWebsite", "supplier_company_registrations": "supplierCompanyRegistrations",
}
PRICE_NAMES = ("unit_price", "unitPrice", "price", "rate")
AMOUNT_NAMES = ("amount", "total", "line_total", "lineTotal")
ITEM_TAX_NAMES = ("tax_amount", "taxAmount", "tax")
BASE_NAMES = ("base", "taxableBase", "taxable_base", "net")
VALUE_NAMES = ("value", "amount", "tax", "taxAmount", "tax_amount")
TOTALS = ("document_total_amount", "document_total_net", "document_total_tax")
# End of fixed values.

TEXT_FIELDS = tuple(f.name for f in FIELDS if f.kind not in ("numeric", "line_items", "tax_items", "long_text"))


def _first_number(m: Column, names: tuple[str, ...]) -> Column:
    return F.coalesce(*(m[n].try_cast("double") for n in names), F.lit(0.0))


def normalized_items(items: Column) -> Column:
    """Line items from an array of string maps of any naming: the first number
    among the aliases; amount and price follow from each other."""

    def one(m: Column) -> Column:
        quantity = F.coalesce(m["quantity"].try_cast("double"), F.lit(1.0))
        whole = F.when(quantity == 0, 1.0).otherwise(quantity)
        price, amount = _first_number(m, PRICE_NAMES), _first_number(m, AMOUNT_NAMES)
        paid = F.when((amount == 0) & (price > 0), price * whole).otherwise(amount)
        each = F.when((price == 0) & (paid > 0) & (whole > 0), paid / whole).otherwise(price)
        rate = F.coalesce(F.nullif(m["tax_rate"], F.lit("")), m["taxRate"], F.lit(""))
        return F.struct(F.coalesce(m["description"], F.lit("")).alias("description"), quantity.alias("quantity"), each.alias("unit_price"), paid.alias("amount"), rate.alias("tax_rate"), _first_number(m, ITEM_TAX_NAMES).alias("tax_amount"))

    return F.transform(F.filter(items, lambda m: m.isNotNull()), one)


def normalized_taxes(taxes: Column) -> Column:
    def one(m: Column) -> Column:
        return F.struct(_first_number(m, BASE_NAMES).alias("base"), F.coalesce(m["rate"], F.lit("")).alias("rate"), F.coalesce(m["code"], F.lit("")).alias("code"), _first_number(m, VALUE_NAMES).alias("value"))

    return F.transform(F.filter(taxes, lambda m: m.isNotNull()), one)


def normalize_output(raw: DataFrame, json: str = "value") -> DataFrame:
    """Documents from JSON text of either naming style; a default stands only
    where the key is absent.  Unknown keys stay in ``other``."""
    keys = F.coalesce(F.json_object_keys(json), F.array().cast("array<string>"))
    values = F.from_json(json, "map<string,string>")
    staged = raw.select("*", keys.alias("_keys"), values.alias("_values"))

    def value(f: str) -> Column:
        alias = ALIASES.get(f)
        return F.coalesce(F.col("_values")[f], F.col("_values")[alias]) if alias else F.col("_values")[f]

    def has(f: str) -> Column:
        alias = ALIASES.get(f)
        return F.array_contains("_keys", f) | (F.array_contains("_keys", alias) if alias else F.lit(False))

    out = {f: value(f) for f in (*TEXT_FIELDS, "notes", "file_name", "mime_type", "labeled_at")}
    for f in ("notes", "file_name", "mime_type", "labeled_at"):
        out[f] = F.when(has(f), value(f)).otherwise("")
    out["document_category"] = F.when(has("document_category"), value("document_category")).otherwise("other")
    for f in TOTALS:
        out[f] = F.when(has(f), value(f).try_cast("double")).otherwise(0.0)
    maps = "array<map<string,string>>"
    out["line_items"] = F.coalesce(normalized_items(F.from_json(value("line_items"), maps)), F.array().cast(ITEM_TYPE))
    out["taxes"] = F.coalesce(normalized_taxes(F.from_json(value("taxes"), maps)), F.array().cast(TAX_TYPE))
    known = [*out, *ALIASES.values()]
    return staged.withColumns(out).withColumn("other", F.map_filter("_values", lambda k, v: ~k.isin(*known))).drop("_keys", "_values")


def error_pages(pages: DataFrame) -> DataFrame:
    """Pages that hold an error and next to nothing else take no part."""
    return pages.where(~(F.col("error").isNotNull() & (F.coalesce("n_keys", F.lit(0)) <= 3)))


def ordered_distinct(rows: DataFrame, group: list[str], keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key within its group, in order; as an aggregate, so
    repeats combine before the shuffle."""
    rest = [c for c in rows.columns if c not in group + keys]
    first = rows.groupBy(*group, *keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_first"))
    return first.select(*group, *keys, *(F.col(f"_first.{c}").alias(c) for c in rest))


def merge_pages(pages: DataFrame, key: str = "file_name", page: str = "page_no") -> DataFrame:
    """One document from its pages: the first filled value of each text field, the
    largest totals (never below 0), items and taxes in page order without
    repeats, distinct notes joined by `` | ``."""
    have = [f for f in TEXT_FIELDS if f in pages.columns]
    usable = error_pages(pages) if "error" in pages.columns else pages
    filled = lambda f: F.when(~F.coalesce(F.col(f), F.lit("")).isin("", "null"), F.col(f))
    note = F.nullif(F.trim("notes"), F.lit(""))
    merged = usable.groupBy(key).agg(
        *(F.min_by(filled(f), F.when(filled(f).isNotNull(), F.col(page))).alias(f) for f in have),
        *(F.greatest(F.lit(0.0), F.max(t)).alias(t) for t in TOTALS if t in pages.columns),
        F.array_sort(F.collect_list(F.struct(F.col(page).alias("page"), note.alias("note"), "line_items", "taxes"))).alias("_pages"),
    )

    def first_only(entries: Column, same) -> Column:
        empty = F.slice(entries, 1, 0)
        return F.aggregate(entries, empty, lambda done, x: F.when(F.exists(done, lambda y: same(x, y)), done).otherwise(F.concat(done, F.array(x))))

    def listed(f: str) -> Column:
        return F.flatten(F.transform("_pages", lambda p: F.coalesce(p[f], F.array().cast(pages.schema[f].dataType))))

    equal = lambda *names: lambda x, y: _all(x[n].eqNullSafe(y[n]) for n in names)
    items = first_only(F.filter(listed("line_items"), lambda x: F.coalesce(x["description"], F.lit("")) != ""), equal("description", "quantity", "unit_price"))
    taxes = first_only(listed("taxes"), equal("base", "rate", "code"))
    notes = F.array_join(F.array_distinct(F.array_compact(F.transform("_pages", lambda p: p["note"]))), " | ")
    out = merged.withColumns({"line_items": items, "taxes": taxes, "notes": notes}).drop("_pages")
    return out.withColumn("document_category", F.coalesce("document_category", F.lit("other"))) if "document_category" in have else out


def _all(conditions) -> Column:
    out = None
    for c in conditions:
        out = c if out is None else out & c
    return out


def first_rows(rows: DataFrame, group: list[str], order: list[str], n: int) -> DataFrame:
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_place") <= n).drop("_place")
