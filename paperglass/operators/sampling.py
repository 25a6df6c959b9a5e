"""Sampling of generation parameters, fields and fonts, and splits.

A draw is a function of a key and a salt: the first eight hex digits of an md5
over 2**32.  It is the same whatever the partitioning, and SQL can repeat it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Weights and vocabularies of the generator.
REGIONS = (("IE", "en", "irish_vat", 0.45), ("GB", "en", "uk_vat", 0.25), ("US", "en", "us_sales_tax", 0.20), ("AU", "en", "australian_gst", 0.05), ("CA", "en", "canadian_gst", 0.05))
COMPLEXITIES = (("low", 0.35), ("medium", 0.45), ("high", 0.20))
DOCUMENT_TYPES = ("tax_invoice", "proforma_invoice", "credit_note", "receipt", "order_confirmation", "freelancer_invoice", "utility_bill", "event_ticket", "hotel_receipt", "restaurant_receipt", "taxi_receipt", "subscription_invoice", "consulting_invoice", "rent_invoice", "delivery_note")
PROFILES = {
    "receipt": {
        "always": ("supplier_name", "document_date", "document_currency", "document_total_amount", "line_items"),
        "common": ("document_time", "receipt_number", "supplier_address", "supplier_phone", "taxes", "document_total_tax", "document_total_net"),
        "rare": ("customer_name", "supplier_email", "supplier_website", "supplier_company_registrations", "notes"),
    },
    "invoice": {
        "always": ("supplier_name", "document_date", "document_currency", "document_total_amount", "document_total_net", "document_total_tax", "line_items", "taxes", "invoice_number"),
        "common": ("supplier_address", "supplier_company_registrations", "customer_name", "customer_address", "due_date", "supplier_phone", "document_number"),
        "rare": ("supplier_email", "supplier_website", "customer_id", "customer_company_registrations", "po_number", "reference_numbers", "billing_address", "payment_date", "notes"),
    },
    "event": {
        "always": ("supplier_name", "document_date", "document_currency", "document_total_amount", "line_items", "document_number"),
        "common": ("customer_name", "receipt_number", "document_time"),
        "rare": ("supplier_address", "supplier_email", "supplier_website", "notes"),
    },
    "freelancer": {
        "always": ("supplier_name", "supplier_address", "document_date", "document_currency", "document_total_amount", "document_total_net", "line_items", "invoice_number", "customer_name"),
        "common": ("supplier_phone", "supplier_email", "customer_address", "due_date", "taxes", "document_total_tax", "notes"),
        "rare": ("supplier_website", "supplier_company_registrations", "customer_company_registrations", "po_number", "reference_numbers"),
    },
}
FILL_PROBABILITY = {"always": 1.0, "common": 0.70, "rare": 0.25}
PROFILE_OF_TYPE = {
    "receipt": ("receipt", "restaurant_receipt", "taxi_receipt", "hotel_receipt"),
    "event": ("order_confirmation", "event_ticket"),
    "freelancer": ("freelancer_invoice",),
}
FONTS = {
    "sans": (("'Roboto', sans-serif", 3), ("'Open Sans', sans-serif", 3), ("'Lato', sans-serif", 3), ("'Noto Sans', sans-serif", 2), ("'Liberation Sans', sans-serif", 2), ("'DejaVu Sans', sans-serif", 2), ("'Ubuntu', sans-serif", 1), ("'FreeSans', sans-serif", 1), ("'Carlito', sans-serif", 1)),
    "serif": (("'Liberation Serif', serif", 3), ("'DejaVu Serif', serif", 3), ("'FreeSerif', serif", 2), ("'Bitstream Charter', serif", 2), ("'Caladea', serif", 1)),
    "mono": (("'Courier 10 Pitch', 'Courier New', monospace", 3), ("'DejaVu Sans Mono', monospace", 3), ("'Liberation Mono', monospace", 2), ("'Ubuntu Mono', monospace", 2), ("'FreeMono', monospace", 1)),
}
MONO_TEMPLATES = ("pos_thermal", "retail_receipt")
# End of fixed values.


def draw(key: Column, salt: str) -> Column:
    """A number in [0, 1) from a key and a salt."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", key.cast("string"), F.lit(salt))), 1, 8), 16, 10).cast("double") / 4294967296.0


def weighted(u: Column, values: list, weights: list[float]) -> Column:
    """The value whose cumulated weight u falls under."""
    total, ends = sum(weights), []
    for w in weights:
        ends.append((ends[-1] if ends else 0.0) + w)
    chosen = reduce(lambda done, k: done.when(u * total < ends[k], F.lit(values[k])), range(1, len(values) - 1), F.when(u * total < ends[0], F.lit(values[0])))
    return chosen.otherwise(F.lit(values[-1]))


def profile_of(document_type: Column) -> Column:
    first, *rest = PROFILE_OF_TYPE.items()
    return reduce(lambda done, kv: done.when(document_type.isin(*kv[1]), kv[0]), rest, F.when(document_type.isin(*first[1]), first[0])).otherwise("invoice")


def generation_params(rows: DataFrame, key: str = "id", seed: str = "params") -> DataFrame:
    """rows with region, language, tax regime, complexity, type and profile."""
    k = F.col(key)
    u = draw(k, f"{seed}-region")
    pick = lambda i: weighted(u, [r[i] for r in REGIONS], [r[3] for r in REGIONS])
    number = F.floor(draw(k, f"{seed}-type") * len(DOCUMENT_TYPES)).cast("int")
    kind = F.get(F.array(*map(F.lit, DOCUMENT_TYPES)), number)
    out = rows.withColumns({"region": pick(0), "language": pick(1), "tax_regime": pick(2), "complexity": weighted(draw(k, f"{seed}-complexity"), [c[0] for c in COMPLEXITIES], [c[1] for c in COMPLEXITIES]), "document_type": kind})
    return out.withColumn("sparsity_profile", profile_of(F.col("document_type")))


def fields_to_fill(params: DataFrame, key: str = "id", seed: str = "fields") -> DataFrame:
    """params with ``fields``: all of a profile's fixed fields, a share of others."""

    def of(profile: str) -> Column:
        rows = [F.struct(F.lit(f).alias("f"), F.lit(p).alias("p")) for level, p in FILL_PROBABILITY.items() for f in PROFILES[profile][level]]
        return F.array(*rows)

    first, *rest = PROFILES
    listed = reduce(lambda done, p: done.when(F.col("sparsity_profile") == p, of(p)), rest, F.when(F.col("sparsity_profile") == first, of(first)))
    u = lambda f: F.conv(F.substring(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(seed), f)), 1, 8), 16, 10).cast("double") / 4294967296.0
    return params.withColumn("fields", F.transform(F.filter(listed, lambda x: u(x["f"]) < x["p"]), lambda x: x["f"]))


def generation_summary(params: DataFrame, keys: tuple[str, ...] = ("region", "complexity", "sparsity_profile")) -> DataFrame:
    """(key, value, n, share) of the sampled parameters."""
    long = params.select(F.explode(F.array(*(F.struct(F.lit(k).alias("key"), F.col(k).alias("value")) for k in keys))).alias("x")).groupBy("x.key", "x.value").agg(F.count(F.lit(1)).alias("n"))
    return long.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("key")))


def fonts(rows: DataFrame, key: str, template: str = "template", seed: str = "font") -> DataFrame:
    """rows with body_font and heading_font drawn from the template's pool."""
    k, mono = F.col(key), F.col(template).isin(*MONO_TEMPLATES)
    pool = {p: (lambda salt, p=p: weighted(draw(k, f"{seed}-{p}-{salt}"), [f for f, _ in FONTS[p]], [w for _, w in FONTS[p]])) for p in FONTS}
    serif = draw(k, f"{seed}-serif") < 0.15
    redraw = draw(k, f"{seed}-redraw") < 0.30
    of = lambda salt: F.when(mono, pool["mono"](salt)).when(serif, pool["serif"](salt)).otherwise(pool["sans"](salt))
    return rows.withColumns({"body_font": of("body"), "heading_font": F.when(~mono & redraw, pool["sans"]("again")).otherwise(of("heading"))})


def payment_details(rows: DataFrame, key: str, region: str = "region", seed: str = "pay") -> DataFrame:
    """rows with a map of payment details of the region for six in ten."""
    k = F.col(key)
    number = lambda low, high, salt: F.format_string("%d", (F.lit(low) + F.floor(draw(k, f"{seed}-{salt}") * (high - low + 1))).cast("long"))
    text = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    ie = F.create_map(F.lit("BIC"), text("BOFI", F.when(draw(k, f"{seed}-bic") < 0.5, "IE").otherwise("XX"), "2D"), F.lit("IBAN"), text("IE", number(10, 99, "i1"), "BOFI", number(10000000, 99999999, "i2"), number(100000, 999999, "i3")), F.lit("Account Name"), F.lit("Acme Payments Ltd"))
    gb = F.create_map(F.lit("Sort Code"), text(number(10, 99, "s1"), "-", number(10, 99, "s2"), "-", number(10, 99, "s3")), F.lit("Account No"), number(10000000, 99999999, "a"))
    other = F.create_map(F.lit("Bank"), text("National Bank #", number(1000, 9999, "b")))
    made = F.when(F.col(region) == "IE", ie).when(F.col(region) == "GB", gb).otherwise(other)
    return rows.withColumn("payment_details", F.when(draw(k, f"{seed}-any") > 0.4, made))


def stratified_split(docs: DataFrame, stratum: str, key: str, validation: float = 0.1, test: float = 0.2, seed: str = "42") -> DataFrame:
    """(key, stratum, split): within each stratum the first by hash validate, the
    next test, the rest train; sizes are rounded half to even.

    The cut is by rank.  Ranks come from counts of hash ranges (256 buckets of
    the md5) and a sort within a range, so a stratum with most rows is not one
    task's sort.
    """
    hashed = docs.select(F.col(key), F.col(stratum), F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(seed))).alias("_h"))
    hashed = hashed.withColumn("_b", F.substring("_h", 1, 2))
    counts = hashed.groupBy(stratum, "_b").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(stratum).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(stratum)
    starts = counts.select(F.col(stratum).alias("_s"), F.col("_b").alias("_c"), F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_start"), F.sum("_n").over(whole).alias("_total"))
    placed = hashed.join(starts, F.col(stratum).eqNullSafe(F.col("_s")) & (F.col("_b") == F.col("_c"))).drop("_s", "_c")
    rank = F.col("_start") + F.row_number().over(Window.partitionBy(stratum, "_b").orderBy("_h", key)) - 1
    n_val, n_test = F.bround(F.col("_total") * validation, 0), F.bround(F.col("_total") * test, 0)
    return placed.withColumn("_rank", rank).select(key, stratum, F.when(F.col("_rank") < n_val, "val").when(F.col("_rank") < n_val + n_test, "test").otherwise("train").alias("split"))


def fixed_split(docs: DataFrame, key: str, train: int = 700, validation: int = 100, test: int = 200, seed: str = "42") -> DataFrame:
    """(key, split): sizes as asked; if there are too few rows they shrink in
    proportion and the rest is test.  Rows beyond the sizes are left out."""
    n = docs.count()
    asked = train + validation + test
    if n < asked:
        train, validation = train * n // asked, validation * n // asked
        test = n - train - validation
    ordered = stratified_rank(docs, key, seed)
    return ordered.where(F.col("_rank") < train + validation + test).select(key, F.when(F.col("_rank") < train, "train").when(F.col("_rank") < train + validation, "val").otherwise("test").alias("split"))


def stratified_rank(docs: DataFrame, key: str, seed: str) -> DataFrame:
    """key and its 0-based rank in hash order, without a single-task sort."""
    hashed = docs.select(F.col(key), F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(seed))).alias("_h")).withColumn("_b", F.substring("_h", 1, 2))
    counts = hashed.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))  # 256 rows
    starts = counts.select("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    joined = hashed.join(F.broadcast(starts), "_b")
    return joined.withColumn("_rank", F.col("_start") + F.row_number().over(Window.partitionBy("_b").orderBy("_h", key)) - 1)


def assign_split(variants: DataFrame, splits: DataFrame, key: str = "file_name") -> DataFrame:
    """Every variant of a document gets the split of the document."""
    return variants.join(splits.select(key, "split"), key)
