"""Pages of a document: the text rows of each template, as text, HTML, PDF, image.

A template is a row of ``LAYOUTS``: its title, how it names the parties, the
columns of its item table, how many rows the table has at least, and what its
totals show.  The rows are one array expression in the row; HTML is the same rows
with marks around them.  PDF and image need bytes and are Arrow functions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.shipping import ship_package
from .render import money


@dataclass(frozen=True)
class Layout:
    title: str
    columns: tuple[str, ...]
    least_rows: int = 0
    description_width: int | None = None
    upper: bool = False
    signed: bool = True  # amounts carry the currency's sign
    subtotal: bool = True
    tax: str = "each"  # each entry, only their sum, or none
    parties: bool = True
    closing: str = ""


# Columns, least rows and cuts of each template's item table.
LAYOUTS = {
    "delivery_note": Layout("DELIVERY NOTE", ("number", "description", "quantity", "shipped", "unit_price", "tax_rate", "amount")),
    "event_ticket": Layout("ORDER SUMMARY", ("ordered", "amount"), upper=True, subtotal=False, tax="none", parties=False, closing="Contact the organiser with questions about this order"),
    "formal_corporate": Layout("INVOICE", ("description", "quantity", "unit_price", "amount"), least_rows=5, signed=False),
    "freelancer_invoice": Layout("INVOICE", ("date", "description", "quantity", "unit_price", "amount"), least_rows=8),
    "hotel_receipt": Layout("GUEST FOLIO", ("date", "description", "quantity", "unit_price", "amount")),
    "modern_minimal": Layout("INVOICE", ("number", "description", "quantity", "unit_price", "tax_rate", "amount")),
    "pos_thermal": Layout("RECEIPT", ("description", "quantity", "amount"), description_width=28, signed=False, parties=False, closing="Thank you"),
    "retail_receipt": Layout("RECEIPT", ("description", "quantity", "unit_price", "amount"), description_width=26, upper=True, parties=False),
    "taxi_receipt": Layout("TRIP RECEIPT", ("description", "amount"), subtotal=False, tax="sum", parties=False),
    "utility_bill": Layout("BILL", ("description", "quantity", "unit_price", "tax_rate", "amount"), signed=False),
}
# End of fixed values.


def _cell(layout: Layout, name: str, x: Column, at: Column, symbol: Column, date: Column) -> Column:
    sign = symbol if layout.signed else F.lit("")
    said = F.coalesce(x["description"], F.lit(""))
    said = F.substring(said, 1, layout.description_width) if layout.description_width else said
    said = F.upper(said) if layout.upper else said
    quantity = F.format_string("%.2f", F.coalesce(x["quantity"], F.lit(0.0)))
    cells = {
        "number": lambda: (at + 1).cast("string"), "description": lambda: said, "quantity": lambda: quantity, "shipped": lambda: quantity, "date": lambda: date,
        "ordered": lambda: F.concat(quantity, F.lit(" x "), said), "tax_rate": lambda: F.coalesce(x["tax_rate"], F.lit("")),
        "unit_price": lambda: money(F.coalesce(x["unit_price"], F.lit(0.0)), sign), "amount": lambda: money(F.coalesce(x["amount"], F.lit(0.0)), sign),
    }
    return cells[name]()


def page_rows(docs: DataFrame, layout: Layout) -> Column:
    """The rows of a document's page, as an array of arrays of cells."""
    have = set(docs.columns)
    value = lambda c: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit(None).cast("string")) if c in have else F.lit(None).cast("string")
    symbol, date = value("currency_symbol"), F.coalesce(value("document_date_formatted"), F.lit(""))
    items = F.coalesce("line_items", F.array().cast(docs.schema["line_items"].dataType))
    taxes = F.coalesce("taxes", F.array().cast(docs.schema["taxes"].dataType)) if "taxes" in have else F.array().cast("array<struct<base:double,rate:string,code:string,value:double>>")
    total = lambda c: money(F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)), symbol) if c in have else money(F.lit(0.0), symbol)
    row = lambda *cells: F.array(*(c if isinstance(c, Column) else F.lit(c) for c in cells))
    when = lambda c, *cells: F.when(c, F.array(row(*cells))).otherwise(F.array().cast("array<array<string>>"))

    number = F.coalesce(value("invoice_number"), value("receipt_number"), value("document_number"))
    supplier = F.coalesce(value("supplier_name"), F.lit(""))
    title = F.upper(F.replace(F.coalesce(value("document_type_extended"), F.lit(layout.title)), F.lit("_"), F.lit(" ")))
    head = [F.array(row(F.upper(supplier) if layout.upper or layout.tax == "sum" else supplier)), when(value("supplier_address").isNotNull(), value("supplier_address")), F.array(row(title)), when(number.isNotNull(), "No.", number), when(date != "", "Date", date)]
    if layout.parties:
        head.append(when(value("customer_name").isNotNull(), "For", value("customer_name"), F.coalesce(value("customer_address"), F.lit(""))))
    table = [F.array(row(*(c.replace("_", " ").capitalize() for c in layout.columns))), F.transform(items, lambda x, k: row(*(_cell(layout, c, x, k, symbol, date) for c in layout.columns)))]
    if layout.least_rows:
        blank = row(*("" for _ in layout.columns))
        table.append(F.when(F.size(items) < layout.least_rows, F.array_repeat(blank, F.lit(layout.least_rows) - F.size(items))).otherwise(F.array().cast("array<array<string>>")))
    sums = [F.array(row("Subtotal", total("document_total_net")))] if layout.subtotal else []
    if layout.tax == "each":
        entry = lambda t: row(F.concat(F.coalesce(F.nullif(t["code"], F.lit("")), F.lit("Tax")), F.lit(" ("), F.coalesce(t["rate"], F.lit("")), F.lit(")")), money(F.coalesce(t["value"], F.lit(0.0)), symbol))
        sums.append(F.when(F.size(taxes) > 0, F.transform(taxes, entry)).otherwise(F.array(row("Tax", total("document_total_tax")))))
    elif layout.tax == "sum":
        sums.append(F.array(row("Tax", total("document_total_tax"))))
    sums.append(F.array(row("TOTAL", total("document_total_amount"))))
    foot = [when(value("payment_method").isNotNull(), "Paid by", value("payment_method")), when(value("notes").isNotNull(), value("notes"))]
    if layout.closing:
        foot.append(F.array(row(layout.closing)))
    return F.concat(*head, *table, *sums, *foot)


def page_text(docs: DataFrame, template: str = "template", out: str = "text") -> DataFrame:
    """docs with the page's text by the template named in a column; an unknown
    template is a formal invoice.  Cells are separated by two spaces."""
    lines = {name: F.array_join(F.transform(page_rows(docs, layout), lambda r: F.rtrim(F.array_join(r, "  "))), "\n") for name, layout in LAYOUTS.items()}
    chosen = None
    for name, text in lines.items():
        chosen = F.when(F.col(template) == name, text) if chosen is None else chosen.when(F.col(template) == name, text)
    return docs.withColumn(out, chosen.otherwise(lines["formal_corporate"]))


def _escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def page_html(docs: DataFrame, text: str = "text", out: str = "html") -> DataFrame:
    """docs with the page as HTML: one row of the text is one row of a table, in
    the document's colour."""
    color = F.col("color_primary") if "color_primary" in docs.columns else F.lit("#333333")
    rows = F.transform(F.split(text, "\n"), lambda r: F.concat(F.lit("<tr>"), F.array_join(F.transform(F.split(r, "  "), lambda c: F.concat(F.lit("<td>"), _escaped(c), F.lit("</td>"))), ""), F.lit("</tr>")))
    return docs.withColumn(out, F.concat(F.lit('<html><body style="border-top:3px solid '), color, F.lit('"><table>'), F.array_join(rows, ""), F.lit("</table></body></html>")))


def pdf(lines: list[str], size: int = 10, margin: int = 40) -> bytes:
    """A PDF of text lines, as many pages as they need."""
    per_page = (842 - 2 * margin) // (size + 2)
    pages = [lines[k : k + per_page] for k in range(0, len(lines), per_page)] or [[]]
    plain = lambda s: s.encode("cp1252", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)")
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"", b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"]
    kids = []
    for page in pages:
        stream = b"BT /F1 %d Tf %d TL %d %d Td " % (size, size + 2, margin, 842 - margin) + b" ".join(b"(" + plain(line) + b") Tj T*" for line in page) + b" ET"
        objects.append(b"<< /Length %d >>\nstream\n" % len(stream) + stream + b"\nendstream")
        objects.append(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595 842] /Contents %d 0 R /Resources << /Font << /F1 3 0 R >> >> >>" % len(objects))
        kids.append(b"%d 0 R" % len(objects))
    objects[1] = b"<< /Type /Pages /Kids [" + b" ".join(kids) + b"] /Count %d >>" % len(kids)
    out, places = b"%PDF-1.4\n", []
    for k, o in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n" % k + o + b"\nendobj\n"
    table = b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    return out + table + b"trailer << /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, len(out))


def rastered(lines: list[str], cell: tuple[int, int] = (6, 10), margin: int = 12) -> np.ndarray:
    """A picture of text lines: each character a block whose pattern its code
    tells.  It stands in for a renderer; what is drawn is where the text is."""
    width = max((len(line) for line in lines), default=0)
    image = np.full((2 * margin + cell[1] * max(len(lines), 1), 2 * margin + cell[0] * max(width, 1), 3), 255, np.uint8)
    for y, line in enumerate(lines):
        for x, c in enumerate(line):
            if not c.isspace():
                bits = np.unpackbits(np.frombuffer(((ord(c) * 2654435761) & 0xFFFFFF).to_bytes(3, "big"), np.uint8)).reshape(6, 4)
                top, left = margin + cell[1] * y + 1, margin + cell[0] * x + 1
                image[top : top + 6, left : left + 4][bits == 1] = 20
    return image


def rendered_pages(docs: DataFrame, key: str = "file_name", text: str = "text") -> DataFrame:
    """(key, pdf, height, width, pixels, error) of each document's text; a
    document that cannot be drawn is a row with the message."""
    ship_package(docs.sparkSession)
    names = [key, "pdf", "height", "width", "pixels", "error"]

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part, rows = batch.slice(at, 64), []
                for t in part.column(1).to_pylist():
                    try:
                        lines = t.split("\n")
                        image = rastered(lines)
                        rows.append((pdf(lines), *image.shape[:2], image.tobytes(), None))
                    except Exception as e:  # noqa: BLE001 - kept as a row
                        rows.append((None, None, None, None, str(e)))
                kinds = (pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], names=names)

    return docs.select(key, text).mapInArrow(drawn, f"`{key}` {docs.schema[key].dataType.simpleString()}, pdf binary, height int, width int, pixels binary, error string")
