import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from paperglass.operators import align, audit, merge, publish, render, repair, sampling, score
from paperglass.plans import catalog
from paperglass.plans.registry import ITEM_TYPE, TAX_TYPE, selected
from paperglass.sources import json_docs

ITEM = ITEM_TYPE.simpleString()
TAX = TAX_TYPE.simpleString()


def test_items_edge_cases(spark):
    item = ("tea", 1.0, 2.0, 2.0, "10%", 0.2)
    rows = [("both", [], []), ("truth", [item], []), ("said", [], [item]), ("same", [item], [item]), ("null", None, None)]
    df = spark.createDataFrame(rows, f"k string, g {ITEM}, p {ITEM}")
    got = {r["k"]: r["r"] for r in align.align_items(df, "g", "p", "r").collect()}
    assert [got["both"][c] for c in ("precision", "recall", "f1", "overall")] == [1, 1, 1, 1]
    assert [got["truth"][c] for c in ("precision", "recall", "f1")] == [1, 0, 0]
    assert [got["said"][c] for c in ("precision", "recall", "f1")] == [0, 1, 0]
    assert got["same"]["overall"] == 1 and got["null"]["f1"] == 1
    flat = {r["k"]: r["f"] for r in df.select("k", align.first_fit_f1(F.col("g"), F.col("p")).alias("f")).collect()}
    assert flat == {"both": 1.0, "truth": 0.0, "said": 1.0, "same": 1.0, "null": 1.0}


def test_scores_of_a_document(spark):
    gt = spark.createDataFrame([("a", "Acme", 10.0, 1), ("a", "Acme Ltd", 10.0, 2), ("", "x", 1.0, 3), ("b", "Bee", 5.0, 4)], "file_name string, supplier_name string, document_total_amount double, ordinal long")
    pred = spark.createDataFrame([("a", "acme ltd.", 10.0, 1), ("c", "x", 1.0, 2)], "file_name string, supplier_name string, document_total_amount double, ordinal long")
    results = score.field_results(gt, pred, selected(names={"supplier_name", "document_total_amount", "notes"}), order="ordinal")
    assert {r["field_name"]: r["grade"] for r in results.collect()} == {"supplier_name": "exact", "document_total_amount": "exact", "notes": "null_match"}
    assert score.document_scores(results).first()["overall_score"] == 1.0
    assert score.standard_metrics(results).first()["entity_f1"] == 1.0


def docs(spark):
    good = ("a", [("tea", 2.0, 3.0, 6.0, "10%", 0.6)], [(6.0, "10%", "VAT", 0.6)], 6.0, 0.6, 6.6, "S", "2024-01-01")
    bad = ("b", [("tea", 2.0, 3.0, 7.0, "10", 0.6), ("x", None, 1.0, 1.0, "", None)], [], 9.0, 0.6, 9.0, None, "2024-01-01")
    empty = ("c", [], None, None, None, None, "S", None)
    return spark.createDataFrame([good, bad, empty], f"file_name string, line_items {ITEM}, taxes {TAX}, document_total_net double, document_total_tax double, document_total_amount double, supplier_name string, document_date string")


def test_audit_and_repair(spark):
    rows = docs(spark)
    found = {(r["file_name"], r["rule"], r["position"]) for r in audit.arithmetic_violations(rows).collect()}
    assert found == {("b", "line_amount", 0), ("b", "line_tax", 0), ("b", "items_net", None), ("b", "gross", None)}
    assert audit.clean_share(rows, audit.arithmetic_violations(rows)).first()["clean"] == 2
    fixed = repair.repair_math(rows)
    after = {r["file_name"]: r for r in fixed.collect()}
    assert (after["b"]["document_total_net"], after["c"]["document_total_amount"]) == (7.0, 0.0)
    assert audit.arithmetic_violations(fixed).count() == 0
    issues = {r["file_name"]: (r["is_valid"], r["issues"]) for r in repair.validation_issues(rows).collect()}
    assert issues["a"] == (True, []) and not issues["b"][0] and not issues["c"][0]
    assert [r["file_name"] for r in audit.degenerate(rows).collect()] == ["c"]


def test_merge_pages(spark):
    item = lambda d, q=1.0: (d, q, 1.0, 1.0, "", 0.0)
    pages = spark.createDataFrame(
        [("f", 2, "Late", "n2", [item("a"), item("b")], [], 5.0, None, 9), ("f", 1, "", "n1", [item("b"), item("")], [(1.0, "5%", "V", 2.0)], -3.0, None, 9), ("f", 3, None, "n1", None, None, None, "boom", 2)],
        f"file_name string, page_no int, supplier_name string, notes string, line_items {ITEM}, taxes {TAX}, document_total_amount double, error string, n_keys int",
    )
    r = merge.merge_pages(pages).first()
    assert (r["supplier_name"], r["notes"], r["document_total_amount"]) == ("Late", "n1 | n2", 5.0)
    assert [x["description"] for x in r["line_items"]] == ["b", "a"] and len(r["taxes"]) == 1


def test_splits(spark):
    rows = spark.range(1000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 700, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 3)).alias("source"))
    sizes = {(r["source"], r["split"]): r["count"] for r in sampling.stratified_split(rows, "source", "doc_id").groupBy("source", "split").count().collect()}
    assert [sizes["hot", s] for s in ("train", "val", "test")] == [490, 70, 140]
    fixed = {r["split"]: r["count"] for r in sampling.fixed_split(rows, "doc_id").groupBy("split").count().collect()}
    assert fixed == {"train": 700, "val": 100, "test": 200}
    small = {r["split"]: r["count"] for r in sampling.fixed_split(rows.limit(55), "doc_id").groupBy("split").count().collect()}
    assert small == {"train": 38, "val": 5, "test": 12}


def test_templates_and_labels(spark):
    rows = spark.createDataFrame([(1, "freelancer_invoice", "tax invoice", None, None), (2, "", "x", "pub", "rent"), (3, None, None, None, None)], "k int, layout string, t string, s string, c string")
    got = [r["x"] for r in rows.select("k", render.template(*(F.col(c) for c in ("layout", "t", "s", "c", "k"))).alias("x")).orderBy("k").collect()]
    assert got[:2] == ["formal_corporate", "pos_thermal"] and got[2] in render.FALLBACK_WEIGHTS
    label = render.labels(docs(spark).where("file_name = 'b'")).first()
    assert label["line_items"][1]["quantity"] == 1.0 and label["notes"] == "" and label["document_category"] == "other"


def test_publish(spark):
    rows = docs(spark).withColumn("degradation_variants", F.when(F.col("file_name") == "a", F.create_map(F.lit("clean"), F.lit("a.png"), F.lit("faded"), F.lit("a.png"))))
    assert sorted(r["file_name"] for r in publish.metadata_rows(rows).collect()) == ["clean/a.png", "clean/b", "clean/c", "faded/a.png"]


def test_json_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"file_name": "a", "locale": null}, {"file_name": "b"}]')
    (tmp_path / "l.jsonl").write_text('{"file_name": "a"}\n{"file_name": "b"}\n')
    (tmp_path / "o.json").write_text('{\n "file_name": "a"\n}')
    (tmp_path / "bad.json").write_text("7")
    array = json_docs.read_documents(spark, str(tmp_path / "a.json"))
    assert {r["file_name"]: r["_keys"] for r in array.collect()} == {"a": ["file_name", "locale"], "b": ["file_name"]}
    assert json_docs.read_documents(spark, str(tmp_path / "l.jsonl")).count() == 2
    assert json_docs.read_documents(spark, str(tmp_path / "o.json")).count() == 1
    with pytest.raises(ValueError):
        json_docs.read_documents(spark, str(tmp_path / "bad.json"))


def test_stream(spark, tmp_path):
    from paperglass.streaming.scoring import score_stream

    gt = spark.createDataFrame([("a", "Acme")], "file_name string, supplier_name string")
    gt.write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(gt.schema).json(str(tmp_path / "in"))
    score_stream(stream, gt, str(tmp_path / "out"), str(tmp_path / "cp"), selected(names={"supplier_name"})).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).first()["grade"] == "exact"


QUICK = ("unmatched_files", "numeric_parse", "date_parse", "time_parse", "arith_audit", "math_repair", "page_merge", "stratified_split", "weighted_params", "field_sparsity_sample", "variant_explode", "flat_lookup", "template_select", "receipt_text", "levenshtein_pairs", "field_metrics", "entity_f1", "anls")


@pytest.mark.parametrize("name", QUICK)
def test_query_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("orders", "customer", "lineitem", "events", "documents", "part"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = catalog.queries()[name](spark, sf)
    cursor = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    plain = lambda v: round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    expected = sorted(str([plain(row[names.index(c)]) for c in sorted(names)]) for row in cursor.fetchall())
    assert sorted(df.columns) == sorted(names)
    assert sorted(str([plain(r[c]) for c in sorted(names)]) for r in df.collect()) == expected


def test_entry(spark, sf):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_repeated_suffix_reads_whole_texts(spark, sf):
    from paperglass.plans import catalog

    got = catalog.queries()["repeated_suffix"](spark, sf).where("text_before is not null").collect()
    length = {r["doc_id"]: r["n"] for r in spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id", "length(text) as n").collect()}
    assert max(length.values()) > 500
    assert all(r["text_before"] == length[r["doc_id"]] and r["before"] == length[r["doc_id"]] + 1200 * len(f" again {r['doc_id']}") for r in got)
    assert all(r["text_after"] <= r["text_before"] and r["after"] < r["before"] for r in got)
