"""Labels, template choice and the text rows of a rendered document."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import normalize as N
from ..plans.registry import FIELDS, ITEM_TYPE, TAX_TYPE
from .sampling import draw, weighted

# Rules for choosing a template, layouts, symbols and colours.
TEMPLATE_RULES = {
    "formal_corporate": {"layouts": ("formal_corporate", "traditional_tabular"), "types": ("tax_invoice", "sales_invoice", "proforma_invoice"), "subcategories": (), "categories": ("rent", "utilities", "services", "software", "office_supplies")},
    "freelancer_invoice": {"layouts": ("freelancer",), "types": ("freelancer_invoice", "consulting_invoice"), "subcategories": ("consulting", "development", "design", "freelance", "coaching", "writing", "translation"), "categories": ("services",)},
    "pos_thermal": {"layouts": ("pos_thermal",), "types": ("restaurant_receipt",), "subcategories": ("restaurant", "cafe", "bar", "pub", "bistro", "fast_food", "takeaway", "bakery", "deli"), "categories": ("food",)},
    "retail_receipt": {"layouts": ("retail_receipt",), "types": ("receipt",), "subcategories": ("grocery", "supermarket", "pharmacy", "shop", "convenience", "hardware", "electronics", "department_store", "bookshop", "clothing", "sports", "home_improvement", "pet_store", "toy_store", "stationery"), "categories": ("retail", "electronics", "office_supplies")},
    "modern_minimal": {"layouts": ("modern_minimal",), "types": ("subscription_invoice", "tax_invoice"), "subcategories": (), "categories": ("software", "services", "electronics", "shipping")},
    "event_ticket": {"layouts": ("event_ticket",), "types": ("event_ticket", "order_confirmation"), "subcategories": ("event", "ticket", "concert", "conference", "exhibition", "festival", "theatre"), "categories": ("miscellaneous",)},
    "utility_bill": {"layouts": ("utility_bill",), "types": ("utility_bill", "credit_note"), "subcategories": ("electricity", "gas", "water", "broadband", "phone", "internet", "waste"), "categories": ("utilities",)},
    "delivery_note": {"layouts": ("delivery_note",), "types": ("delivery_note",), "subcategories": ("delivery", "shipping", "logistics", "warehouse", "fulfilment"), "categories": ("shipping",)},
    "taxi_receipt": {"layouts": ("taxi_receipt",), "types": ("taxi_receipt",), "subcategories": ("taxi", "uber", "ride", "rideshare", "cab", "transfer"), "categories": ("transport",)},
}
FALLBACK_WEIGHTS = {"formal_corporate": 0.18, "freelancer_invoice": 0.12, "pos_thermal": 0.12, "modern_minimal": 0.15, "event_ticket": 0.06, "utility_bill": 0.08, "delivery_note": 0.06, "taxi_receipt": 0.08}
LAYOUT_OF_TYPE = {
    "receipt": "pos_thermal", "restaurant_receipt": "pos_thermal", "taxi_receipt": "pos_thermal", "hotel_receipt": "modern_minimal", "tax_invoice": "formal_corporate",
    "proforma_invoice": "formal_corporate", "credit_note": "utility_bill", "rent_invoice": "formal_corporate", "utility_bill": "utility_bill", "delivery_note": "utility_bill",
    "subscription_invoice": "modern_minimal", "consulting_invoice": "freelancer_invoice", "freelancer_invoice": "freelancer_invoice", "order_confirmation": "event_ticket", "event_ticket": "event_ticket",
}
SYMBOLS = {"EUR": "€", "USD": "$", "GBP": "£", "PLN": "zł", "CHF": "CHF ", "SEK": "kr", "NOK": "kr", "DKK": "kr", "CZK": "Kč", "JPY": "¥", "CNY": "¥", "AUD": "A$", "CAD": "C$"}
COLORS = {
    "blue_corporate": ("#2c5aa0", "#4a90d9"), "green_eco": ("#27ae60", "#2ecc71"), "red_accent": ("#c0392b", "#e74c3c"), "monochrome": ("#333333", "#666666"), "teal_modern": ("#00b4d8", "#48cae4"),
    "purple_creative": ("#6c5ce7", "#a29bfe"), "orange_warm": ("#e17055", "#fab1a0"), "navy_formal": ("#2c3e50", "#34495e"), "dark_green": ("#1a5632", "#27ae60"), "burgundy": ("#7b2d3b", "#b03a4e"),
}
PAYMENT_METHODS = ("Visa", "MasterCard", "Amex", "Bank Transfer", "PayPal", "Card", "Direct Debit", "Apple Pay", "Google Pay", "Revolut")
CATEGORIES = ("services", "software", "electronics", "travel", "food", "office_supplies", "utilities", "rent", "shipping", "retail", "transport", "miscellaneous", "other")
COMPLEXITY_TEXT = {"low": "1-2 line items", "medium": "3-5 line items", "high": "6-15 line items"}
TAX_TEXT = {"irish_vat": "23%, 13.5%, 9%, 0%", "uk_vat": "20%, 5%, 0%", "us_sales_tax": "0-10.25%", "australian_gst": "10%", "canadian_gst": "5%, 13-15%"}
# End of fixed values.


def lookup(table: dict[str, str], key: Column, default: Column | str) -> Column:
    got = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[key]
    return F.coalesce(got, default if isinstance(default, Column) else F.lit(default))


def labels(records: DataFrame, file_name: str = "file_name", mime: str = "application/pdf") -> DataFrame:
    """The label of every record: totals default to 0, a missing category key to
    "other", a missing note to empty text; item numbers are never null."""
    have = set(records.columns)
    number = lambda c: F.coalesce(c.try_cast("double"), F.lit(0.0))
    quantity = lambda c: F.when(number(c) == 0, 1.0).otherwise(number(c))

    def item(x: Column) -> Column:
        return F.struct(F.coalesce(x["description"], F.lit("")).alias("description"), quantity(x["quantity"]).alias("quantity"), number(x["unit_price"]).alias("unit_price"), number(x["amount"]).alias("amount"), F.coalesce(x["tax_rate"].cast("string"), F.lit("None")).alias("tax_rate"), number(x["tax_amount"]).alias("tax_amount"))

    def tax(x: Column) -> Column:
        return F.struct(number(x["base"]).alias("base"), F.coalesce(x["rate"].cast("string"), F.lit("None")).alias("rate"), F.coalesce(x["code"].cast("string"), F.lit("None")).alias("code"), number(x["value"]).alias("value"))

    out = [F.col(file_name).alias("file_name")]
    for f in FIELDS:
        if f.kind in ("line_items", "tax_items"):
            made = F.coalesce(F.transform(f.name, item if f.kind == "line_items" else tax), F.array()) if f.name in have else F.array()
        elif f.kind == "numeric":
            made = number(F.col(f.name)) if f.name in have else F.lit(0.0)
        elif f.name not in have:
            made = F.lit({"document_category": "other", "notes": ""}.get(f.name)).cast("string")
        else:
            made = F.col(f.name)
        out.append(made.alias(f.name))
    return records.select(*out, F.lit(mime).alias("mime_type"), F.current_timestamp().cast("string").alias("labeled_at"))


def template(layout: Column, document_type: Column, subcategory: Column, category: Column, key: Column, seed: str = "template") -> Column:
    """The template of a record: by layout hint, type, subcategory, category, in
    that order, the first rule that matches; else a weighted draw."""
    lower = lambda c: F.lower(F.coalesce(c, F.lit("")))
    values = {"layouts": F.coalesce(layout, F.lit("")), "types": F.replace(lower(document_type), F.lit(" "), F.lit("_")), "subcategories": lower(subcategory), "categories": lower(category)}
    rules = [(values[level].isin(*rule[level]), name) for level in values for name, rule in TEMPLATE_RULES.items() if rule[level]]
    chosen = reduce(lambda done, r: done.when(*r), rules[1:], F.when(*rules[0]))
    return chosen.otherwise(weighted(draw(key, seed), list(FALLBACK_WEIGHTS), list(FALLBACK_WEIGHTS.values())))


def template_hints(rows: DataFrame, key: str, document_type: str = "document_type", seed: str = "color") -> DataFrame:
    """rows with _template_hints: layout by type, colour by draw."""
    color = F.get(F.array(*map(F.lit, COLORS)), F.floor(draw(F.col(key), seed) * len(COLORS)).cast("int"))
    return rows.withColumn("_template_hints", F.struct(lookup(LAYOUT_OF_TYPE, F.col(document_type), "modern_minimal").alias("layout_style"), color.alias("color_scheme")))


def template_context(docs: DataFrame, region: Column | None = None, key: str = "file_name") -> DataFrame:
    """docs with what a template needs: symbol, dates in the region's style,
    colours, a payment method, numbers without nulls."""
    region = F.lit("IE") if region is None else region
    style = F.when(region == "US", "MM/dd/yyyy").otherwise("dd/MM/yyyy")
    currency = F.coalesce(F.nullif("document_currency", F.lit("")), F.lit("EUR"))
    out = {"currency_symbol": lookup(SYMBOLS, currency, F.concat(currency, F.lit(" ")))}
    for f in ("document_date", "due_date", "payment_date"):
        if f in docs.columns:
            out[f"{f}_formatted"] = N.shown_date(F.col(f), style)
    out["document_date_display"] = N.shown_date(F.col("document_date"), "d MMMM yyyy")
    scheme = F.col("_template_hints.color_scheme") if "_template_hints" in docs.columns else F.get(F.array(*map(F.lit, COLORS)), F.floor(draw(F.col(key), "scheme") * len(COLORS)).cast("int"))
    for k, name in enumerate(("color_primary", "color_secondary")):
        out[name] = lookup({c: v[k] for c, v in COLORS.items()}, scheme, COLORS["blue_corporate"][k])
    out["payment_method"] = F.get(F.array(*map(F.lit, PAYMENT_METHODS)), F.floor(draw(F.col(key), "method") * len(PAYMENT_METHODS)).cast("int"))
    for t in ("document_total_net", "document_total_tax", "document_total_amount"):
        out[t] = F.coalesce(F.col(t).try_cast("double"), F.lit(0.0))
    for c, numbers in (("line_items", ("quantity", "unit_price", "amount", "tax_amount")), ("taxes", ("base", "value"))):
        if c in docs.columns:
            kind = docs.schema[c].dataType
            if not isinstance(kind, T.ArrayType):  # what is no list counts as an empty one
                out[c] = F.array().cast(ITEM_TYPE if c == "line_items" else TAX_TYPE)
                continue
            out[c] = F.coalesce(F.transform(c, _numbers_filled([n for n in numbers if n in kind.elementType.names])), F.array().cast(kind))
    return docs.withColumns(out)


def _numbers_filled(names: list[str]):
    """An item with its numbers as such: 0.0 where there is none."""

    def filled(x: Column) -> Column:
        return reduce(lambda done, n: done.withField(n, F.coalesce(x[n].try_cast("double"), F.lit(0.0))), names, x)

    return filled


def money(c: Column, symbol: Column | str = "") -> Column:
    return F.concat(symbol if isinstance(symbol, Column) else F.lit(symbol), F.format_string("%.2f", c))


def receipt_text(docs: DataFrame, width: int = 28, padding: int = 0) -> DataFrame:
    """docs with ``text``: the lines of a till receipt - head, items (descriptions
    cut to width, each price where it differs), taxes and totals; short item
    lists are padded with empty rows."""
    items = F.coalesce("line_items", F.array().cast(docs.schema["line_items"].dataType))
    number = F.coalesce("receipt_number", "document_number") if "receipt_number" in docs.columns else F.lit(None)

    def row(x: Column) -> Column:
        main = F.concat_ws(" ", F.substring(x["description"], 1, width), x["quantity"].cast("string"), money(x["amount"]))
        return F.when(x["unit_price"] != x["amount"], F.concat(main, F.lit("\n@ "), money(x["unit_price"]), F.lit(" each"))).otherwise(main)

    taxes = F.coalesce("taxes", F.array().cast(docs.schema["taxes"].dataType))
    tax_rows = F.transform(taxes, lambda t: F.concat(F.coalesce(F.nullif(t["code"], F.lit("")), F.lit("Tax")), F.lit(" ("), F.coalesce(t["rate"], F.lit("")), F.lit(") "), money(t["value"], F.col("currency_symbol"))))
    lines = F.concat(
        F.array_compact(F.array(F.upper("supplier_name"), F.col("supplier_address") if "supplier_address" in docs.columns else F.lit(None).cast("string"), F.concat_ws(" ", F.lit("Date:"), "document_date_formatted", F.coalesce(F.col("document_time"), F.lit("12:34")) if "document_time" in docs.columns else F.lit("12:34")), F.concat(F.lit("Receipt: "), number))),
        F.transform(items, row),
        F.when(F.size(items) < padding, F.array_repeat(F.lit(""), padding - F.size(items))).otherwise(F.array().cast("array<string>")),
        F.array(F.concat(F.lit("Subtotal "), money(F.col("document_total_net"), F.col("currency_symbol")))),
        F.when(F.size(taxes) > 0, tax_rows).otherwise(F.array(F.concat(F.lit("Tax "), money(F.col("document_total_tax"), F.col("currency_symbol"))))),
        F.array(F.concat(F.lit("TOTAL "), money(F.col("document_total_amount"), F.col("currency_symbol")))),
    )
    return docs.withColumn("text", F.array_join(lines, "\n"))


def generation_prompt(params: DataFrame) -> DataFrame:
    """params with ``prompt``: what to ask a model for, by the sampled values."""
    has = lambda f: F.array_contains("fields", f)
    lines = F.array_compact(
        F.array(
            F.concat(F.lit("Write one fictional "), F.replace("document_type", F.lit("_"), F.lit(" ")), F.lit(" for region "), F.col("region"), F.lit(" as a JSON object.")),
            F.concat(F.lit("Tax rates: "), lookup(TAX_TEXT, F.col("tax_regime"), "local rates")),
            F.concat(F.lit("Complexity: "), lookup(COMPLEXITY_TEXT, F.col("complexity"), "")),
            F.concat(F.lit("Fill these fields, all others null: "), F.array_join("fields", ", ")),
            F.when(has("line_items"), "line_items: description, quantity, unit_price, amount, tax_rate as text with %, tax_amount."),
            F.when(has("taxes"), "taxes: base, rate as text with %, code, value."),
            F.lit("amount is quantity x unit_price; net and tax are the sums of the lines; the total is net + tax; two decimals."),
            F.lit("document_category is one of " + ", ".join(CATEGORIES) + "."),
            F.lit("Answer with the JSON only."),
        )
    )
    return params.withColumn("prompt", F.array_join(lines, "\n"))


def extraction_prompt(schema_json: str, pages: Column | None = None) -> Column:
    """What a model that reads page images is asked: the schema and the rules."""
    lines = [
        "Read the document image and put what it says into one JSON object of this schema:",
        schema_json,
        "Numbers are plain numbers with two decimals, dates are YYYY-MM-DD, times HH:MM, the currency is its three-letter code.",
        "Every line of the item table is one entry of line_items, every rate one entry of taxes.",
        "A field that the document does not show is an empty text, 0.0 or an empty list.",
        "Answer with the JSON only.",
    ]
    if pages is None:
        return F.lit("\n".join(lines))
    several = F.when(pages > 1, F.concat(F.lit("\nThis is one of "), pages.cast("string"), F.lit(" pages; report only what this page shows."))).otherwise("")
    return F.concat(F.lit("\n".join(lines)), several)


def extended_prompt(schema_json: str) -> Column:
    """The longer form: a line for each field, by tier."""
    hints = {"numeric": "number", "date": "date as YYYY-MM-DD", "time": "time as HH:MM", "line_items": "list of description, quantity, unit_price, amount, tax_rate, tax_amount", "tax_items": "list of base, rate, code, value", "category": "one word"}
    fields = [f"- {f.name}: {hints.get(f.kind, 'text')}{' (copy exactly)' if f.identity else ''}" for f in sorted(FIELDS, key=lambda f: (f.tier, f.name))]
    categories = "document_category is one of " + ", ".join(CATEGORIES) + "."
    return F.lit("\n".join(["Find these fields in the document image:", *fields, categories, "Schema:", schema_json, "Think briefly, then answer with the JSON only."]))


def document_names(rows: DataFrame, index: str, columns: list[str]) -> DataFrame:
    """rows with ``base_name``: index and a short hash of the columns' JSON."""
    digest = F.substring(F.md5(F.to_json(F.struct(*sorted(columns)))), 1, 8)
    return rows.withColumn("base_name", F.concat(F.lit("synth_"), F.format_string("%04d", F.col(index)), F.lit("_"), digest))

