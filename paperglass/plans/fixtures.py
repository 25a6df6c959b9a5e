"""Document sets derived from the relational tables.

Each set is one SQL text that both Spark and DuckDB read, so a query and its
check see the same rows.  Predictions differ from the truth by rules on the key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import FIELDS, Field

SCORED = ("supplier_name", "document_date", "document_currency", "document_total_amount", "document_total_net", "document_total_tax", "invoice_number", "document_category", "document_time", "supplier_address", "notes")

GT_SQL = """
SELECT o_orderkey AS k, 'doc_' || CAST(o_orderkey AS STRING) AS file_name,
  CASE WHEN o_orderkey % 17 <> 0 THEN c_name END AS supplier_name,
  CAST(CAST(o_orderdate AS DATE) AS STRING) AS document_date,
  CASE o_orderkey % 3 WHEN 0 THEN 'EUR' WHEN 1 THEN 'USD' ELSE 'GBP' END AS document_currency,
  o_totalprice AS document_total_amount,
  o_totalprice - CAST(o_orderkey % 50 AS DOUBLE) AS document_total_net,
  CAST(o_orderkey % 50 AS DOUBLE) AS document_total_tax,
  'INV-' || lpad(CAST(o_orderkey % 100000 AS STRING), 6, '0') AS invoice_number,
  lower(o_orderpriority) AS document_category,
  lpad(CAST(o_orderkey % 24 AS STRING), 2, '0') || ':' || lpad(CAST(o_orderkey % 60 AS STRING), 2, '0') AS document_time,
  c_name || ', ' || CAST(o_orderkey % 97 AS STRING) || ' ' || lower(c_mktsegment) || ' street' AS supplier_address,
  CASE WHEN o_orderkey % 4 = 0 THEN 'Thank you. Write to sales' || CAST(o_orderkey % 7 AS STRING) || '@example.com or call 555-0' || lpad(CAST(o_orderkey % 1000 AS STRING), 3, '0') || ' before ' || CAST(CAST(o_orderdate AS DATE) AS STRING) END AS notes,
  CASE o_orderkey % 5 WHEN 0 THEN 'clean' WHEN 1 THEN 'clean' WHEN 2 THEN 'faded' WHEN 3 THEN 'bad_scan' END AS degradation
FROM {orders} JOIN {customer} ON o_custkey = c_custkey"""

PRED_SQL = """
SELECT k, file_name,
  CASE WHEN k % 7 = 0 THEN NULL WHEN k % 5 = 0 THEN upper(coalesce(supplier_name, 'Unknown Ltd')) || '.' WHEN k % 23 = 0 THEN substr(supplier_name, 1, 12) || 'xx' ELSE supplier_name END AS supplier_name,
  CASE WHEN k % 11 = 0 THEN substr(document_date, 1, 4) || '-' || substr(document_date, 9, 2) || '-' || substr(document_date, 6, 2) WHEN k % 6 = 0 THEN substr(document_date, 9, 2) || '/' || substr(document_date, 6, 2) || '/' || substr(document_date, 1, 4) WHEN k % 29 = 0 THEN 'n/a' ELSE document_date END AS document_date,
  CASE WHEN k % 10 = 0 THEN lower(document_currency) WHEN k % 31 = 0 THEN 'CHF' ELSE document_currency END AS document_currency,
  CASE WHEN k % 41 = 0 THEN NULL WHEN k % 37 = 0 THEN document_total_amount * 1.125 WHEN k % 13 = 0 THEN document_total_amount + 0.03 ELSE document_total_amount END AS document_total_amount,
  CASE WHEN k % 9 = 0 THEN document_total_net * 2.5 ELSE document_total_net END AS document_total_net,
  document_total_tax,
  CASE WHEN k % 21 = 0 THEN NULL WHEN k % 8 = 3 THEN replace(invoice_number, '-', ' ') WHEN k % 12 = 0 THEN invoice_number || '7' ELSE invoice_number END AS invoice_number,
  CASE WHEN k % 14 = 0 THEN '5-low' WHEN k % 9 = 0 THEN replace(document_category, '-', ' ') WHEN k % 16 = 1 THEN document_category || 's' ELSE document_category END AS document_category,
  CASE WHEN k % 15 = 0 THEN 'noon' WHEN k % 18 = 0 THEN '23:59' ELSE document_time || ':00' END AS document_time,
  CASE WHEN k % 3 = 0 THEN replace(supplier_address, ' street', '') WHEN k % 22 = 0 THEN '-' ELSE supplier_address END AS supplier_address,
  CASE WHEN k % 5 = 0 THEN 'n/a' WHEN k % 8 = 0 THEN substr(notes, 1, 40) ELSE notes END AS notes
FROM gt WHERE k % 19 <> 0"""

#: Line items of an order; (order, line number) repeats, so lines are numbered.
LINES_SQL = """
SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS line,
  'part ' || CAST(l_partkey AS STRING) AS description, l_quantity AS quantity, CAST(l_partkey % 100 + 1 AS DOUBLE) AS unit_price,
  l_quantity * (l_partkey % 100 + 1) + CASE WHEN l_orderkey % 7 = 0 AND l_linenumber = 1 THEN 5 ELSE 0 END AS amount,
  CASE WHEN l_orderkey % 3 = 0 THEN '23%' ELSE '10' END AS tax_rate,
  (l_quantity * (l_partkey % 100 + 1) * CASE WHEN l_orderkey % 3 = 0 THEN 23 ELSE 10 END) / 100 + CASE WHEN l_orderkey % 11 = 0 AND l_linenumber = 2 THEN 1 ELSE 0 END AS tax_amount
FROM {lineitem}"""


def registry_rows(names: tuple[str, ...] = SCORED) -> list[Field]:
    return [f for f in FIELDS if f.name in names]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def gt_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(GT_SQL.replace("{orders}", "{o}").replace("{customer}", "{c}"), o=table(spark, sf_dir, "orders"), c=table(spark, sf_dir, "customer"))


def pred_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(PRED_SQL.replace("FROM gt", "FROM {gt}"), gt=gt_docs(spark, sf_dir))


#: Three models: their predictions are the same but for what each leaves out.
MODELS = {"alpha": 0, "beta": 4, "gamma": 10}


def model_predictions(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    pred = pred_docs(spark, sf_dir)
    return {m: pred if not n else pred.withColumn("supplier_name", F.when(F.col("k") % n != 0, F.col("supplier_name"))).withColumn("document_currency", F.when(F.col("k") % (n + 1) != 0, F.col("document_currency"))) for m, n in MODELS.items()}


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(LINES_SQL, lineitem=table(spark, sf_dir, "lineitem"))


def item_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with items and one tax entry, totals by sum, errors planted."""
    row = F.struct("line", "description", "quantity", "unit_price", "amount", "tax_rate", "tax_amount")
    docs = lines(spark, sf_dir).groupBy("k").agg(F.array_sort(F.collect_list(row)).alias("r"), F.sum("amount").alias("net"), F.sum("tax_amount").alias("tax"))
    fields = ("description", "quantity", "unit_price", "amount", "tax_rate", "tax_amount")
    k = F.col("k")
    net, tax = F.col("net"), F.col("tax")
    return docs.select(
        "k", F.concat(F.lit("doc_"), k.cast("string")).alias("file_name"),
        F.transform("r", lambda x: F.struct(*(x[f].cast("double" if f not in ("description", "tax_rate") else "string").alias(f) for f in fields))).alias("line_items"),
        F.array(F.struct(net.alias("base"), F.lit("10%").alias("rate"), F.lit("VAT").alias("code"), (tax + F.when(k % 13 == 0, 2.0).otherwise(0.0)).alias("value"))).alias("taxes"),
        (net + F.when(k % 17 == 0, 3.0).otherwise(0.0)).alias("document_total_net"), tax.alias("document_total_tax"), (net + tax + F.when(k % 19 == 0, 1.0).otherwise(0.0)).alias("document_total_amount"),
        F.concat(F.lit("Supplier "), (k % 101).cast("string")).alias("supplier_name"), F.lit("2024-05-06").alias("document_date"), F.lit("EUR").alias("document_currency"),
    )


def item_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_docs with lines dropped, added, renamed and mispriced by rule."""
    docs = item_docs(spark, sf_dir)
    k = F.col("k")
    off = F.transform("line_items", lambda x: x.withField("amount", x["amount"] + F.when(k % 5 == 0, 0.5).otherwise(0.0)).withField("description", F.when(k % 7 == 0, F.upper(x["description"])).otherwise(x["description"])))
    cut = F.when(k % 4 == 0, F.slice(off, 1, F.greatest(F.size(off) - 1, F.lit(0)))).when(k % 9 == 0, F.reverse(off)).otherwise(off)
    return docs.withColumn("line_items", F.when(k % 23 == 0, F.slice(off, 1, 0)).otherwise(cut)).where(k % 19 != 0)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
