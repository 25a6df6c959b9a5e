"""Recovery of structured fields from free model output."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Patterns that find a field in prose, tried in order; currency signs.
_SIGN = {"€": "EUR", "$": "USD", "£": "GBP", "¥": "JPY"}
FIELD_PATTERNS = {
    "supplier_name": [r"""(?:supplier|merchant|company|vendor|seller)\s*(?:name)?[:\s]*["']?([A-Z][A-Za-z0-9\s&.,'-]+?)(?:["']?\s*(?:\n|\.|,\s*[a-z]|$))""", r"""["']?(?:Merchant Name|Supplier)["']?\s*:\s*["']([^"']+)["']"""],
    "document_date": [r"""(?:date|document.?date|invoice.?date|order.?date)[:\s]*["']?(\d{1,2}[\s/.-]\w+[\s/.-]\d{2,4})["']?""", r"""(?:date|document.?date|invoice.?date)[:\s]*["']?(\d{4}[-/]\d{2}[-/]\d{2})["']?"""],
    "document_total_amount": [r"""(?:total|final.?total|total.?amount|amount.?due|grand.?total)[:\s]*["']?[€$£¥]?\s*(\d[\d,]*\.?\d*)""", r"""[€$£¥]\s*(\d[\d,]*\.\d{2})\s*(?:total|$)"""],
    "document_total_net": [r"""(?:subtotal|sub.?total|net|before.?tax|excl\.?.?(?:vat|tax))[:\s]*["']?[€$£¥]?\s*(\d[\d,]*\.?\d*)"""],
    "document_total_tax": [r"""(?:tax|vat|gst|tax.?amount|total.?tax)[:\s]*["']?[€$£¥]?\s*(\d[\d,]*\.?\d*)"""],
    "document_currency": [r"""(?:currency)[:\s]*["']?([A-Z]{3})["']?""", r"""([€$£¥])"""],
    "document_number": [r"""(?:order|document|invoice|receipt)\s*(?:number|no\.?|#)[:\s]*["']?([A-Z0-9#-]+)["']?""", r"""#([A-Z]{2,4}-\d{4,}[-\d]*)"""],
    "invoice_number": [r"""(?:invoice)\s*(?:number|no\.?|#)[:\s]*["']?([A-Z0-9#-]+)["']?"""],
    "receipt_number": [r"""(?:receipt)\s*(?:number|no\.?|#)[:\s]*["']?([A-Z0-9#-]+)["']?"""],
    "customer_name": [r"""(?:customer|buyer|client|bill.?to)\s*(?:name)?[:\s]*["']?([A-Z][A-Za-z\s]+?)(?:["']?\s*(?:\n|\.|$))"""],
    "supplier_address": [r"""(?:supplier|merchant|company)\s*(?:address)[:\s]*["']?(.+?)(?:["']?\s*\n)"""],
    "supplier_phone": [r"""(?:phone|tel|telephone)[:\s]*["']?([\d+().\s-]{7,20})["']?"""],
    "supplier_email": [r"""(?:email)[:\s]*["']?([\w.+-]+@[\w-]+\.[\w.-]+)["']?""", r"""([\w.+-]+@[\w-]+\.[\w.-]+)"""],
    "supplier_website": [r"""(?:website|url|web)[:\s]*["']?(https?://\S+|www\.\S+)["']?"""],
}
QUANTITY_FIRST = r"""(?i)(\d+\.?\d*)\s*x\s+(.+?)\s+[€$£¥]?\s*(\d[\d,]*\.\d{2})"""
NAME_FIRST = r"""(?i)["'](.+?)["'].*?(?:qty|quantity)[:\s]*(\d+).*?[€$£¥]?\s*(\d[\d,]*\.\d{2})"""
# End of fixed values.

_NUMERIC = ("document_total_amount", "document_total_net", "document_total_tax")


def fields_from_prose(c: Column) -> Column:
    """struct of the fields found in prose, and line_items; all null for texts
    below ten characters."""

    def first(field: str) -> Column:
        ways = []
        for p in FIELD_PATTERNS[field]:
            hit = F.nullif(F.rtrim(F.trim(F.regexp_extract(c, "(?im)" + p, 1)), F.lit(".,;:")), F.lit(""))
            if field in _NUMERIC:
                hit = F.replace(hit, F.lit(","), F.lit("")).try_cast("double")
            if field == "document_currency":
                hit = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in _SIGN.items() for x in kv)), hit), hit)
            ways.append(hit)
        return F.coalesce(*ways)

    def items(pattern: str, name: int, quantity: int) -> Column:
        got = [F.regexp_extract_all(c, F.lit(pattern), F.lit(k)) for k in (name, quantity, 3)]
        return F.transform(F.arrays_zip(*(g.alias(a) for g, a in zip(got, "nqa"))), lambda x: F.struct(F.trim(x["n"]).alias("description"), x["q"].try_cast("double").alias("quantity"), F.lit(0.0).alias("unit_price"), F.replace(x["a"], F.lit(","), F.lit("")).try_cast("double").alias("amount"), F.lit("").alias("tax_rate"), F.lit(0.0).alias("tax_amount")))

    enough = F.length(F.trim(c)) >= 10
    lines = F.concat(items(QUANTITY_FIRST, 2, 1), items(NAME_FIRST, 1, 2))
    return F.struct(*(F.when(enough, first(f)).alias(f) for f in FIELD_PATTERNS), F.when(enough & (F.size(lines) > 0), lines).alias("line_items"))


def _balanced(text: str) -> list[str]:
    """Top-level {...} blocks, in order; braces inside strings count too."""
    depth, start, out = 0, None, []
    for m in re.finditer(r"[{}]", text):
        if m[0] == "{":
            if depth == 0:
                start = m.start()
            depth += 1
        else:
            depth -= 1
            if depth == 0 and start is not None:
                out.append(text[start : m.end()])
    return out


def _first_json(candidates) -> str | None:
    for text in candidates:
        try:
            return json.dumps(json.loads(text), ensure_ascii=False)
        except ValueError:
            continue
    return None


def _unfenced(text: str) -> str:
    t = text.strip()
    if t.startswith("```"):
        t = t.partition("\n")[2] if "\n" in t else t[3:]
    if t.endswith("```"):
        t = t[: t.rindex("```")]
    return t.strip()


def _from_generation(text: str | None) -> str | None:
    return _first_json([_unfenced(text), *_balanced(text)]) if text else None


def first_json_object(text: str | None) -> str | None:
    """What ``extract_json`` gives for one text."""
    return _from_generation(text)


def _from_response(text: str | None) -> str | None:
    if not text or not text.strip():
        return None
    t = text.strip()
    fence = re.search(r"```(?:json)?\s*(\{.*?\})\s*```", t, re.DOTALL)
    blocks = _balanced(t[t.find("{") :])[:1] if "{" in t else []
    outer = re.search(r"\{.*\}", t, re.DOTALL)
    return _first_json([t, *([fence[1]] if fence else []), *blocks, *([outer[0]] if outer else [])])


def _vectorised(f: Callable):
    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(f)

    return run


#: JSON text of the object inside a generated record, or null: fences are
#: stripped, then each balanced block is tried.  Parsing is strict.
extract_json = _vectorised(_from_generation)

#: The same for an extraction response: fenced part, first block, widest block.
parse_response = _vectorised(_from_response)


def _one_copy(text: str | None, least: int = 8000, copies: int = 10) -> str | None:
    """The text without the repeats of the shortest suffix that it ends with ten
    times or more."""
    if text is None or len(text) < least:
        return text
    n = len(text)
    for size in range(2, n // copies + 1):
        if text[n - size :] != text[n - 2 * size : n - size]:  # cheap first look
            continue
        end, unit = n, text[n - size :]
        count = 0
        while end >= size and text.startswith(unit, end - size):
            end -= size
            count += 1
        if count >= copies:
            return text[: end + size]
    return text


without_repeated_suffix = _vectorised(_one_copy)


def retry_prompt(c: Column, schema_json: str, most: int = 3000) -> Column:
    """Text-only prompt that asks to put an analysis into the schema."""
    cut = F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("\n... [truncated]"))).otherwise(c)
    return F.concat(F.lit("Put the document analysis below into one JSON object of the given schema. Answer with the JSON only.\n\nAnalysis:\n"), cut, F.lit("\n\nSchema:\n" + schema_json + "\n\nJSON:"))


def recovered(c: Column, retry: Column | None = None) -> Column:
    """Fields from prose; a retry's answer (a text) fills only what is missing."""
    first = fields_from_prose(c)
    return first if retry is None else merged_fields(first, fields_from_prose(retry))


def merged_fields(first: Column, second: Column) -> Column:
    """Fields of the first struct, gaps filled from the second."""
    return F.struct(*(F.coalesce(first[f], second[f]).alias(f) for f in (*FIELD_PATTERNS, "line_items")))
