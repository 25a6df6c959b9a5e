"""Data-quality audit of labelled documents: integrity, distributions, diversity,
arithmetic, sparsity.  Each section is one aggregate; the input is read once a
section and only the columns it needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normalize as N

# Audited fields, registration prefixes expected with a currency,
# identities and the default tolerance.
SCHEMA_FIELDS = (
    "file_name", "supplier_name", "supplier_address", "supplier_phone", "supplier_email", "supplier_website", "supplier_company_registrations",
    "customer_name", "customer_id", "customer_address", "billing_address", "shipping_address", "customer_company_registrations",
    "document_type_extended", "document_number", "invoice_number", "receipt_number", "reference_numbers", "po_number",
    "document_date", "document_time", "due_date", "payment_date", "document_currency", "document_total_amount", "document_total_net", "document_total_tax",
    "document_category", "subcategory", "locale", "line_items", "taxes", "notes",
)
EXPECTED_PREFIXES = {"EUR": ("IE", "DE", "FR", "ES", "IT"), "GBP": ("GB",), "USD": ("US", "CA", "EI"), "PLN": ("PL",)}
DISTRIBUTION_KEYS = ("_template_used", "_font_info", "document_currency", "locale", "document_category", "document_type_extended")
IDENTITIES = ("line_amount", "line_tax", "items_net", "items_tax", "gross", "taxes_net", "taxes_tax", "tax_value")
TOLERANCE = 0.011
# End of fixed values.


def _array(c: Column, df: DataFrame, name: str) -> Column:
    return F.coalesce(c, F.array().cast(df.schema[name].dataType))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def arithmetic_violations(docs: DataFrame, key: str = "file_name", tolerance: float = TOLERANCE) -> DataFrame:
    """(key, rule, position): every identity that a document breaks; position is
    the line or tax entry, null for totals.  Null operands are skipped."""
    items, taxes = _array(docs["line_items"], docs, "line_items"), _array(docs["taxes"], docs, "taxes")
    net, tax, gross = (docs[f"document_total_{n}"] for n in ("net", "tax", "amount"))
    off = lambda a, b: F.coalesce(~N.close(a, b, tolerance), F.lit(False))
    broken = lambda rule, position=None: F.struct(F.lit(rule).alias("rule"), (F.lit(None).cast("int") if position is None else position).alias("position"))
    none = F.array().cast("array<struct<rule:string,position:int>>")

    def each(array: Column, rule: str, wrong) -> Column:
        return F.transform(F.filter(F.sequence(F.lit(0), F.size(array) - 1), lambda i: wrong(F.get(array, i))), lambda i: broken(rule, i))

    def lines(array: Column, rule: str, wrong) -> Column:
        return F.when(F.size(array) > 0, each(array, rule, wrong)).otherwise(none)

    def whole(rule: str, condition: Column) -> Column:
        return F.when(condition, F.array(broken(rule))).otherwise(none)

    found = F.concat(
        lines(items, "line_amount", lambda x: off(x["quantity"] * x["unit_price"], x["amount"])),
        lines(items, "line_tax", lambda x: off(x["amount"] * N.rate(x["tax_rate"]) / 100.0, x["tax_amount"])),
        whole("items_net", (F.size(items) > 0) & off(_total(F.transform(items, lambda x: x["amount"])), net)),
        whole("items_tax", (F.size(items) > 0) & off(_total(F.transform(items, lambda x: x["tax_amount"])), tax)),
        whole("gross", off(net + tax, gross)),
        whole("taxes_net", (F.size(taxes) > 0) & off(_total(F.transform(taxes, lambda x: x["base"])), net)),
        whole("taxes_tax", (F.size(taxes) > 0) & off(_total(F.transform(taxes, lambda x: x["value"])), tax)),
        lines(taxes, "tax_value", lambda x: off(x["base"] * N.rate(x["rate"]) / 100.0, x["value"])),
    )
    return docs.select(key, F.explode(found).alias("v")).select(key, "v.rule", "v.position")


def violation_counts(violations: DataFrame) -> DataFrame:
    """(rule, violations), most frequent first."""
    return violations.groupBy("rule").agg(F.count(F.lit(1)).alias("violations")).orderBy(F.desc("violations"), "rule")


def clean_share(docs: DataFrame, violations: DataFrame, key: str = "file_name") -> DataFrame:
    """(records, dirty, clean): a record with several violations counts once."""
    return docs.agg(F.count(F.lit(1)).alias("records")).crossJoin(violations.agg(F.count_distinct(key).alias("dirty"))).withColumn("clean", F.col("records") - F.col("dirty"))


def violation_examples(violations: DataFrame, n: int = 10, key: str = "file_name") -> DataFrame:
    place = Window.partitionBy("rule").orderBy(key, "position")
    return violations.withColumn("example", F.row_number().over(place)).where(F.col("example") <= n)


def sparsity(docs: DataFrame, fields: tuple[str, ...] = SCHEMA_FIELDS) -> DataFrame:
    """(field, position, empty, share): values that are null, "" or [], in one
    pass over the columns; a field the table lacks is empty throughout."""
    types = dict(docs.dtypes)

    def empty(f: str) -> Column:
        if f not in types:
            return F.lit(True)
        c = docs[f]
        if types[f].startswith("array"):
            return c.isNull() | (F.size(c) == 0)
        return c.isNull() | (c == "") if types[f] == "string" else c.isNull()

    made = docs.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(empty(f)).alias(f"e{k}") for k, f in enumerate(fields)))
    rows = F.array(*(F.struct(F.lit(f).alias("field"), F.lit(k).alias("position"), F.col(f"e{k}").alias("empty"), F.when(F.col("n") > 0, F.col(f"e{k}") / F.col("n")).otherwise(0.0).alias("share")) for k, f in enumerate(fields)))
    return made.select(F.explode(rows).alias("r")).select("r.*").orderBy(F.desc("empty"), "position")


def array_stats(docs: DataFrame) -> DataFrame:
    """One row for each list: total, mean, least, most and empty; notes filled."""
    sizes = docs.select(*(F.coalesce(F.size(c), F.lit(0)).alias(c) if c in docs.columns else F.lit(0).alias(c) for c in ("line_items", "taxes")), (F.trim(F.coalesce("notes", F.lit(""))) != "").alias("noted"))
    sizes = sizes.select(*(F.greatest(F.col(c), F.lit(0)).alias(c) for c in ("line_items", "taxes")), "noted")
    made = sizes.agg(*(F.struct(F.sum(c).alias("total"), F.avg(c).alias("mean"), F.min(c).alias("least"), F.max(c).alias("most"), F.count_if(F.col(c) == 0).alias("empty"), F.count_if("noted").alias("notes_filled")).alias(c) for c in ("line_items", "taxes")))
    return made.select(F.explode(F.array(*(F.struct(F.lit(c).alias("list"), F.col(c).alias("s")) for c in ("line_items", "taxes")))).alias("x")).select("x.list", "x.s.*")


def size_histogram(docs: DataFrame, column: str = "line_items") -> DataFrame:
    return docs.groupBy(F.greatest(F.coalesce(F.size(column), F.lit(0)), F.lit(0)).alias("items")).agg(F.count(F.lit(1)).alias("documents"))


def uniqueness(docs: DataFrame, columns: list[str]) -> DataFrame:
    """(column, distinct, filled, share) over non-empty values; exact counts from
    one aggregation by value, which combines repeats before the shuffle."""
    long = docs.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns))).alias("x")).select("x.*").where(F.coalesce("value", F.lit("")) != "")
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")).groupBy("column").agg(F.count(F.lit(1)).alias("distinct"), F.sum("n").alias("filled")).withColumn("share", F.col("distinct") / F.col("filled"))


def most_common(docs: DataFrame, column: str, n: int = 10, missing: str | None = None) -> DataFrame:
    """(value, n) of the most frequent values; ties by value.  missing names
    nulls and blanks, which are left out otherwise."""
    value = F.nullif(F.col(column).cast("string"), F.lit(""))
    rows = docs.select((F.coalesce(value, F.lit(missing)) if missing else value).alias("value")).where(F.col("value").isNotNull())
    return rows.groupBy("value").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(n)


def distributions(docs: DataFrame, keys: tuple[str, ...] = DISTRIBUTION_KEYS) -> DataFrame:
    """(key, value, n) of every value of the keys."""
    have = [k for k in keys if k in docs.columns]
    return docs.select(F.explode(F.array(*(F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in have))).alias("x")).groupBy("x.key", "x.value").agg(F.count(F.lit(1)).alias("n"))


def prefix_mismatches(docs: DataFrame) -> DataFrame:
    """Documents whose supplier registration begins with letters of another
    country than the currency's."""
    prefix = F.upper(F.substring(F.trim("supplier_company_registrations"), 1, 2))
    expected = F.create_map(*(x for k, v in EXPECTED_PREFIXES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    allowed = F.element_at(expected, F.col("document_currency"))
    return docs.where((F.coalesce("supplier_company_registrations", F.lit("")) != "") & allowed.isNotNull() & prefix.rlike(r"^\p{L}+$") & ~F.array_contains(allowed, prefix))


def degenerate(docs: DataFrame) -> DataFrame:
    return docs.where((F.coalesce(F.size("line_items"), F.lit(0)) <= 0) | (F.coalesce("document_total_amount", F.lit(0.0)) == 0))


def variant_disagreements(docs: DataFrame) -> DataFrame:
    return docs.where((F.size("degradation_variants") > 0) & (F.size(F.array_distinct(F.map_values("degradation_variants"))) != 1))


def duplicate_keys(docs: DataFrame, key: str = "file_name") -> DataFrame:
    return docs.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def missing_fields(raw: DataFrame, fields: tuple[str, ...] = SCHEMA_FIELDS, json: str = "value") -> DataFrame:
    """Fields that are a key of no record, null-valued keys counted as present;
    raw holds one JSON object a row."""
    present = raw.select(F.explode(F.json_object_keys(json)).alias("field")).distinct()
    every = raw.sparkSession.createDataFrame([(f,) for f in fields], "field string")
    return every.join(present, "field", "left_anti")
