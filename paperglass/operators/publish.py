"""Publishing labelled documents: one row for each image variant."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.degrade import png
from ..plans.shipping import ship_package

# Columns of a published row that are taken over as they are.
CARRIED = ("supplier_name", "document_date", "document_currency", "document_total_amount", "document_total_net", "document_total_tax", "document_category", "subcategory", "document_type_extended", "invoice_number", "receipt_number", "customer_name", "supplier_address", "supplier_phone")
# End of fixed values.


def metadata_rows(labels: DataFrame) -> DataFrame:
    """One row for each condition of a document; lists become JSON text; a
    document without variants is its own clean one."""
    variants = F.col("degradation_variants") if "degradation_variants" in labels.columns else F.lit(None).cast("map<string,string>")
    some = F.when(F.size(variants) > 0, variants).otherwise(F.create_map(F.lit("clean"), F.col("file_name")))
    exploded = labels.select("*", F.explode(some).alias("_condition", "_variant"))
    text = lambda c: F.coalesce(F.to_json(c), F.lit("[]")) if c in labels.columns else F.lit("[]")
    size = F.greatest(F.coalesce(F.size("line_items"), F.lit(0)), F.lit(0)) if "line_items" in labels.columns else F.lit(0)
    return exploded.select(
        F.concat_ws("/", "_condition", "_variant").alias("file_name"), F.col("_condition").alias("degradation"), F.replace("file_name", F.lit(".png"), F.lit("")).alias("base_id"), F.col("file_name").alias("source_file"),
        *((F.col(c) if c in labels.columns else F.lit(None).cast("string")).alias(c) for c in CARRIED),
        text("line_items").alias("line_items"), text("taxes").alias("taxes"), (F.col("_template_used") if "_template_used" in labels.columns else F.lit(None).cast("string")).alias("template_used"), size.alias("num_line_items"),
    )


def write_published(rows: DataFrame, splits: DataFrame, path: str, presets: list[str] | None = None) -> None:
    """JSON rows in a folder for each split and condition; documents of no split
    are left out."""
    published(rows, splits, presets).write.mode("overwrite").partitionBy("split", "degradation").json(path)


def published(rows: DataFrame, splits: DataFrame, presets: list[str] | None = None) -> DataFrame:
    """Metadata rows with the split of their document, joined by the file name
    that the split was made for."""
    chosen = rows.where(F.col("degradation").isin(presets)) if presets else rows
    return chosen.join(splits.select(F.col("file_name").alias("source_file"), "split"), "source_file").drop("source_file")


def published_counts(path_rows: DataFrame) -> DataFrame:
    """(split, degradation, n) of published rows, to verify what was written."""
    return path_rows.groupBy("split", "degradation").agg(F.count(F.lit(1)).alias("n"))


def write_images(images: DataFrame, path: str, key: str = "file_name") -> DataFrame:
    """Writes images (key, condition, height, width, pixels) as PNG files, a folder
    for each condition, under the document's name; (key, condition, path, error)
    of each.  Written under a name of its own and renamed, so a repeated task
    leaves the same file."""
    ship_package(images.sparkSession)
    names = ["key", "condition", "path", "error"]

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(path)
        for batch in batches:
            rows = []
            for name, condition, height, width, pixels in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if pixels is None:
                    rows.append((name, condition, None, "no image"))
                    continue
                folder = f"{root}/{condition}"
                system.create_dir(folder, recursive=True)
                final, own = f"{folder}/{name}", f"{folder}/.{uuid.uuid4().hex}"
                with system.open_output_stream(own, compression=None) as out:
                    out.write(png(np.frombuffer(pixels, np.uint8).reshape(height, width, 3)))
                system.move(own, final)
                rows.append((name, condition, final, None))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(4)], names=names)

    return images.select(key, "condition", "height", "width", "pixels").mapInArrow(written, "key string, condition string, path string, error string")
