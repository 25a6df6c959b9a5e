"""Reading documents with a model: back ends, pages, recovery, failed rows.

A back end is a name and up to three callables, each from one list to another of
the same length, so a model sees whole Arrow batches: what it answers to page
images with a schema (``structured``), the plain text of page images (``text``),
and what it answers to a prompt without an image (``prompt``).  Back ends that
need a network or a GPU are given by the caller (``register_backend``); the one
included, ``stand_in``, reads the page's bytes as text and is deterministic.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import recover as R
from ..plans.registry import DOCUMENT
from ..plans.shipping import ship_package
from ..sources.json_docs import mime_type
from . import merge


@dataclass(frozen=True)
class Backend:
    name: str
    structured: Callable[[list[bytes], str], list[str | None]]
    text: Callable[[list[bytes]], list[str | None]]
    prompt: Callable[[list[str]], list[str | None]] | None = None  # none: no retry by text


def _as_text(pages: list[bytes]) -> list[str | None]:
    return [None if p is None else p.decode("utf-8", "replace") for p in pages]


def stand_in() -> Backend:
    """Answers with what the page says: its bytes are the model's output.  A
    prompt is answered with the lines behind its last blank line but one."""
    return Backend("stand_in", lambda pages, schema: _as_text(pages), _as_text, lambda prompts: [p.split("\n\n")[1] if p and "\n\n" in p else None for p in prompts])


_REGISTERED: dict[str, Callable[..., Backend]] = {"stand_in": stand_in}


def register_backend(name: str, make: Callable[..., Backend]) -> None:
    _REGISTERED[name] = make


def get_backend(name: str, **options) -> Backend:
    if name not in _REGISTERED:
        raise ValueError(f"unknown back end {name}; there are {', '.join(sorted(_REGISTERED))}")
    return _REGISTERED[name](**options)


def quantization(name: str | None) -> dict | None:
    """Settings for loading a model's weights in fewer bits."""
    if name not in (None, "4bit", "8bit"):
        raise ValueError(f"unknown quantization {name}; use 4bit or 8bit")
    return None if name is None else {"bits": int(name[0])}


def split_pages(files: DataFrame, splitter: Callable[[bytes, str], list[bytes]] | None = None, most_pages: int | None = None) -> DataFrame:
    """(path, page_no, page) of files (path, content): one row a page from 1 on.

    splitter cuts a file's bytes by its type (a PDF library's work); without one
    a form feed ends a page.  A file that it fails on is one row with null page
    and the message in ``error``.
    """
    ship_package(files.sparkSession)
    cut = splitter or (lambda content, kind: content.split(b"\f"))
    schema = pa.schema([("path", pa.string()), ("page_no", pa.int32()), ("page", pa.binary()), ("error", pa.string())])

    def paged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content, kind in zip(*(batch.column(k).to_pylist() for k in range(3))):
                try:
                    pages, error = cut(content or b"", kind)[:most_pages], None
                except Exception as e:  # noqa: BLE001 - kept as a row
                    pages, error = [None], str(e)
                yield pa.RecordBatch.from_pylist([{"path": path, "page_no": n, "page": p, "error": error} for n, p in enumerate(pages, 1)], schema=schema)

    return files.select("path", "content", mime_type(F.col("path")).alias("kind")).mapInArrow(paged, "path string, page_no int, page binary, error string")


def read_pages(pages: DataFrame, backend: Backend, schema_json: str = "{}", at_once: int = 16) -> DataFrame:
    """pages with ``raw``, what the back end answers, and ``error`` where it
    fails; it gets at_once pages at a time."""
    ship_package(pages.sparkSession)
    names = [*pages.columns, "raw"]
    page, error = pages.columns.index("page"), pages.columns.index("error")

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, at_once):
                batch = whole.slice(at, at_once)
                given, errors = batch.column(page).to_pylist(), batch.column(error).to_pylist()
                asked = [k for k, p in enumerate(given) if p is not None]
                raw: list[str | None] = [None] * len(given)
                try:
                    for k, answer in zip(asked, backend.structured([given[k] for k in asked], schema_json), strict=True):
                        raw[k] = answer
                except Exception as e:  # noqa: BLE001 - the pages stay, with the message
                    for k in asked:
                        errors[k] = str(e)
                columns = list(batch.columns)
                columns[error] = pa.array(errors, pa.string())
                yield pa.RecordBatch.from_arrays([*columns, pa.array(raw, pa.string())], names=names)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields)
    return pages.mapInArrow(answered, f"{kinds}, raw string")


def _prompted(rows: DataFrame, backend: Backend, prompt: str, out: str, at_once: int = 16) -> DataFrame:
    """rows with the back end's answer to a prompt column (null: none asked)."""
    place = rows.columns.index(prompt)

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, at_once):
                batch = whole.slice(at, at_once)
                given = batch.column(place).to_pylist()
                asked = [k for k, p in enumerate(given) if p is not None]
                got: list[str | None] = [None] * len(given)
                if asked:
                    for k, answer in zip(asked, backend.prompt([given[k] for k in asked]), strict=True):
                        got[k] = answer
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.string())], names=[*batch.schema.names, out])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(answered, f"{kinds}, `{out}` string")


def recover_answers(rows: DataFrame, backend: Backend | None = None, schema_json: str = "{}") -> DataFrame:
    """rows (.., raw) with ``value``, the JSON of the answer or of what could be
    saved of it, and ``error``.

    An answer that holds no JSON is a failed parse: its fields are looked for in
    the prose; where no supplier is found and the back end takes prompts, it is
    asked once more for JSON from the text.  JSON in that answer wins; prose in it
    fills only what is missing.
    """
    ship_package(rows.sparkSession)
    said = F.coalesce(F.trim("raw"), F.lit("")) != ""
    parsed = rows.withColumn("_json", R.parse_response("raw"))
    first = parsed.withColumn("_first", F.when(F.col("_json").isNull() & said, R.fields_from_prose(F.col("raw"))))
    asks = F.when(F.col("_json").isNull() & said & (F.coalesce(F.col("_first.supplier_name"), F.lit("")) == ""), R.retry_prompt(F.col("raw"), schema_json))
    if backend is not None and backend.prompt is not None:
        first = _prompted(first.withColumn("_prompt", asks), backend, "_prompt", "_again")
    else:
        first = first.withColumn("_again", F.lit(None).cast("string"))
    second = first.withColumn("_retry", R.parse_response("_again")).withColumn("_saved", R.merged_fields(F.col("_first"), R.fields_from_prose(F.col("_again"))))
    kept = F.to_json("_saved")
    some = F.coalesce(kept, F.lit("{}")) != "{}"
    failed = F.col("_json").isNull() & said
    value = F.coalesce("_json", "_retry", F.when(some, kept))
    error = F.when(F.col("error").isNotNull(), F.col("error")).when(~said, "empty_answer").when(failed & F.col("_retry").isNotNull(), F.lit(None)).when(failed & some, "parse_failed_recovered_via_regex_extraction").when(failed, "parse_failed")
    return second.withColumns({"value": value, "error": error}).drop("_json", "_first", "_prompt", "_again", "_retry", "_saved")


def process_files(files: DataFrame, backend: Backend, schema_json: str = "{}", splitter: Callable[[bytes, str], list[bytes]] | None = None, most_pages: int | None = None, stamp: Column | None = None) -> DataFrame:
    """Documents of files (path, content): pages -> answers -> recovery -> merged
    pages -> normal keys -> stamped.

    A file that fails as a whole is kept as a row with its message in ``error``.
    """
    answers = recover_answers(read_pages(split_pages(files, splitter, most_pages), backend, schema_json), backend, schema_json)
    name = F.element_at(F.split("path", "/"), -1)
    pages = merge.normalize_output(answers.select(name.alias("file_name"), "page_no", "error", "value").where("value is not null").withColumn("_file", F.col("file_name")))
    pages = pages.drop("file_name").withColumnRenamed("_file", "file_name")
    merged = merge.merge_pages(pages.drop("error", "value"))
    every = answers.groupBy(name.alias("file_name")).agg(F.count(F.lit(1)).cast("int").alias("pages"), F.min_by("error", "page_no").alias("error"))
    rest = [c for c in merged.columns if c not in ("file_name", "page_no", "pages", "error", "mime_type", "labeled_at")]
    out = every.join(merged.select("file_name", *rest), "file_name", "left")
    return out.withColumns({"mime_type": mime_type(F.col("file_name")), "labeled_at": (F.current_timestamp() if stamp is None else stamp).cast("string")})


def output_schema_json() -> str:
    """The document schema as JSON for prompts: every field with an empty value."""
    empty = {"double": 0.0, "array": []}
    return json.dumps({f.name: empty.get(f.dataType.typeName(), "") for f in DOCUMENT.fields if not f.name.startswith("_")})
