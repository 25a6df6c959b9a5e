"""Generating records with a language model, and their post-processing.

``Complete`` is a callable from a list of prompts and the number of the attempt
to a list of answers; a client for a service is given by the caller.  The one
included, ``stand_in``, writes a small record from the prompt's own hash.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.recover import first_json_object
from ..plans.registry import DOCUMENT
from ..plans.shipping import ship_package
from . import render, repair

Complete = Callable[[list[str], int], list[str | None]]

SYSTEM_TEXT = "You write fictional invoices and receipts, realistic in form, as JSON."


def stand_in(prompts: list[str], attempt: int) -> list[str | None]:
    """A fenced record for most prompts; every fifth answer of the first attempt
    is prose and every seventh lacks its supplier, so retries are met."""
    out: list[str | None] = []
    for prompt in prompts:
        number = int(hashlib.md5(prompt.encode()).hexdigest()[:8], 16)
        if attempt == 0 and number % 5 == 0:
            out.append("Let me think about this document first.")
            continue
        record = {
            "supplier_name": None if attempt == 0 and number % 7 == 0 else f"Supplier {number % 97}", "document_date": f"2024-{number % 12 + 1:02d}-{number % 28 + 1:02d}", "document_currency": ("EUR", "GBP", "USD")[number % 3],
            "line_items": [{"description": f"Item {k}", "quantity": k + 1, "unit_price": (number % 50) + 0.5, "amount": 0.0, "tax_rate": 0.23, "tax_amount": 0.0} for k in range(number % 4)],
            "taxes": [{"base": 0.0, "rate": "0.23", "code": "VAT", "value": 0.0}], "document_total_net": 1.0, "document_total_tax": 0.0, "document_total_amount": 2.0,
        }
        out.append(f"```json\n{json.dumps(record)}\n```")
    return out


def _valid(record: str) -> bool:
    """The rule of ``validation_issues``: a supplier and a date are there."""
    value = json.loads(record)
    return isinstance(value, dict) and all(value.get(f) not in (None, "") for f in ("supplier_name", "document_date"))


def generate_records(params: DataFrame, complete: Complete = stand_in, retries: int = 2, prompt: str = "prompt", at_once: int = 16) -> DataFrame:
    """params with ``record`` (JSON text, null if all attempts failed),
    ``attempts`` and ``error``, the last failure's message.

    An answer without JSON, an invalid record or an exception is tried again, up
    to ``retries`` times; what the last attempt gives is taken even if invalid.
    """
    ship_package(params.sparkSession)
    place = params.columns.index(prompt)
    names = [*params.columns, "record", "attempts", "error"]

    def generated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, at_once):
                batch = whole.slice(at, at_once)
                asked = batch.column(place).to_pylist()
                record: list[str | None] = [None] * len(asked)
                error: list[str | None] = [None] * len(asked)
                attempts = [0] * len(asked)
                open_ = list(range(len(asked)))
                for attempt in range(retries + 1):
                    if not open_:
                        break
                    try:
                        answers = complete([asked[k] for k in open_], attempt)
                    except Exception as e:  # noqa: BLE001 - the rows are tried again
                        answers = [None] * len(open_)
                        for k in open_:
                            error[k] = str(e)
                    still = []
                    for k, answer in zip(open_, answers, strict=True):
                        attempts[k] = attempt + 1
                        got = first_json_object(answer)
                        if got is None:
                            error[k] = error[k] or "no JSON"
                            still.append(k)
                        elif not _valid(got) and attempt < retries:
                            error[k] = "invalid"
                            still.append(k)
                        else:
                            record[k], error[k] = got, None
                    open_ = still
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(record, pa.string()), pa.array(attempts, pa.int32()), pa.array(error, pa.string())], names=names)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in params.schema.fields)
    return params.mapInArrow(generated, f"{kinds}, record string, attempts int, error string")


def finished_records(generated: DataFrame, key: str, params: tuple[str, ...] = ("region", "document_type", "complexity"), fix_math: bool = True) -> DataFrame:
    """Documents of the generated records: arithmetic repaired, formats made
    normal, template hints, the parameters, ``math_fixed``."""
    schema = [f for f in DOCUMENT.fields if not f.name.startswith("_") and f.name != "degradation_variants"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    # Numbers where the schema has text (a rate of 0.23) become text.
    rows = generated.where("record is not null").select(key, *params, "fields", F.from_json("record", kinds).alias("d")).select(key, *params, F.col("fields").alias("_fields_requested"), "d.*")
    before = repair.validation_issues(rows).withColumn("_issues", F.size("issues")).drop("issues", "is_valid")
    fixed = repair.repair_math(before) if fix_math else before
    after = repair.validation_issues(fixed)
    done = repair.normalize_records(after.withColumn("math_fixed", F.size("issues") < F.col("_issues")).drop("_issues"))
    hinted = render.template_hints(done, key)
    return hinted.withColumn("_generation_params", F.struct(*params)).withColumnRenamed("issues", "remaining_issues")


def generation_totals(generated: DataFrame, finished: DataFrame) -> DataFrame:
    """One row: asked, generated, failed, math_fixed."""
    asked = generated.agg(F.count(F.lit(1)).alias("asked"), F.count("record").alias("generated"), F.count_if(F.col("record").isNull()).alias("failed"))
    return asked.join(finished.agg(F.count_if("math_fixed").alias("math_fixed")))
