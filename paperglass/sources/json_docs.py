"""Reading and writing documents as JSON, and listing document files."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.registry import DOCUMENT, METRICS, selected

# Suffixes of document files and their types.
MIME_TYPES = {"pdf": "application/pdf", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "bmp": "image/bmp", "tiff": "image/tiff", "tif": "image/tiff"}
SCANNED = ("pdf", "png", "jpg", "jpeg", "tiff", "bmp", "webp")
# End of fixed values.


def read_documents(spark: SparkSession, path: str, schema: T.StructType = DOCUMENT, limit: int | None = None) -> DataFrame:
    """Documents of a JSON array, a single object or JSON lines, with ``ordinal``
    (the place in the input) and ``_keys`` (the keys that each record has).

    The first byte tells the layout.  Lines are read in parallel; a file that is
    one array is one task's to parse, whatever reads it.
    """
    text = spark.read.text(path, wholetext=True)
    head = spark.read.text(path).where(F.trim("value") != "").select(F.substring(F.ltrim("value"), 1, 1)).first()
    if head is None:
        raise ValueError(f"no documents in {path}")
    if head[0] == "[":
        items = text.select(F.struct("_metadata.file_path").alias("part"), F.posexplode(F.from_json("value", "array<variant>")).alias("at", "v"))
        rows = _numbered(items.select("part", "at", F.to_json("v").alias("value")))
    elif head[0] == "{":
        lines = spark.read.text(path).where(F.trim("value") != "")
        whole = lines.limit(2).count() > 1 and lines.where(F.try_parse_json("value").isNull()).limit(1).count() > 0
        part = F.struct("_metadata.file_path", "_metadata.file_block_start").alias("part")
        rows = _numbered((text if whole else lines).select(part, F.monotonically_increasing_id().alias("at"), "value"))
    else:
        raise ValueError(f"{path} holds neither an array nor an object")
    out = rows.select(F.col("at").alias("ordinal"), F.json_object_keys("value").alias("_keys"), F.from_json("value", schema).alias("d")).select("ordinal", "_keys", "d.*")
    return out.where(F.col("ordinal") < limit) if limit is not None else out


def _numbered(rows: DataFrame) -> DataFrame:
    """rows (part, at, value) with ``at`` counted from 0 over all parts (pieces of
    files, in their order): what the parts before hold is added, from one row a
    part.  at rises by one from row to row of a part."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    starts = counts.select("part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("start"))
    return rows.join(starts, "part").select((F.col("at") + F.col("start")).cast("long").alias("at"), "value")


def uploaded(spark: SparkSession, text: str, what: str = "ground_truth", schema: T.StructType = DOCUMENT) -> DataFrame:
    """Documents of a posted JSON text; one object is one document.  Text that is
    no JSON is an error that names the file."""
    try:
        value = json.loads(text)
    except ValueError as e:
        raise ValueError(f"invalid JSON in {what}: {e}") from e
    docs = [value] if isinstance(value, dict) else value
    rows = spark.createDataFrame([(n, json.dumps(d)) for n, d in enumerate(docs)], "ordinal long, value string")
    return rows.select("ordinal", F.json_object_keys("value").alias("_keys"), F.from_json("value", schema).alias("d")).select("ordinal", "_keys", "d.*")


def listed(text: str | None) -> list[str] | None:
    """The values of a comma list, null if none is given."""
    return [x.strip() for x in text.split(",") if x.strip()] if text else None


def upload_options(tiers: str | None = None, fields: str | None = None, metrics: str = "all") -> dict:
    """Chosen registry rows and metric names of a request's comma lists."""
    names = listed(metrics) or ["all"]
    unknown = set(names) - {"all", *METRICS}
    if unknown:
        raise ValueError(f"unknown metrics {', '.join(sorted(unknown))}")
    chosen = selected({int(t) for t in listed(tiers)} if tiers else None, set(listed(fields)) if fields else None)
    return {"fields": chosen, "metrics": list(METRICS) if "all" in names else [m for m in METRICS if m in names]}


def model_name(file_name: str | None, number: int = 0) -> str:
    """A model's name: that of its file without the suffix."""
    return file_name.rsplit(".", 1)[0] if file_name else f"model_{number}"


def write_documents(docs: DataFrame, path: str) -> None:
    """JSON lines, one file a partition; writing again replaces all."""
    docs.write.mode("overwrite").json(path)


def append_results(done: DataFrame, path: str, by: str) -> None:
    """Results of one step; writing the step again replaces only its own folder."""
    done.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).json(path)


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def mime_type(path: Column) -> Column:
    """The type by suffix; application/octet-stream if it is unknown."""
    return F.coalesce(F.create_map(*(F.lit(x) for kv in MIME_TYPES.items() for x in kv))[suffix(path)], F.lit("application/octet-stream"))


def scan_files(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = SCANNED, content: bool = True) -> DataFrame:
    """Document files under a folder, whatever the case of their suffix."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    files = files if content else files.drop("content")
    return files.where(suffix(F.col("path")).isin(*suffixes)).withColumn("mime_type", mime_type(F.col("path")))


def output_name(model: Column, stamp: Column, quantization: Column) -> Column:
    """Name of a result file: model, quantisation if any, and time."""
    return F.concat(F.concat_ws("_", F.lit("results"), model, F.nullif(quantization, F.lit("")), F.date_format(stamp, "yyyyMMdd_HHmmss")), F.lit(".json"))


def report_path(path: str) -> str:
    """Where the report on a results file goes."""
    return path.removesuffix(".json") + "_report.json"


def write_report(report: DataFrame, path: str) -> None:
    """Report rows (level, key, report) as JSON, a folder for each level."""
    report.write.mode("overwrite").partitionBy("level").json(path)


def report_json(metrics: DataFrame, key: str = "field_name") -> DataFrame:
    """Metrics rows as (key, json) for a nested report."""
    return metrics.select(key, F.to_json(F.struct(*[c for c in metrics.columns if c != key])).alias("report"))
