"""Model interfaces, images, pages, reports and sources on small inputs."""

import json
import unicodedata
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperglass.functions import degrade, similarity
from paperglass.functions import normalize as N
from paperglass.operators import align, extract, generate, nearest, pages, publish, render, score
from paperglass.plans.registry import selected
from paperglass.sources import json_docs


def picture(height=90, width=70, seed=1):
    return np.random.default_rng(seed).integers(0, 256, (height, width, 3)).astype(np.uint8)


@pytest.mark.parametrize("name", degrade.STAGES)
def test_stages_keep_images(name):
    image = picture()
    made = degrade.STAGES[name](image, 0.5, np.random.default_rng(2))
    assert made.dtype == np.uint8 and made.ndim == 3 and made.shape[2] == 3
    assert (made.shape == image.shape) != (name == "scanner_bed")
    again = degrade.STAGES[name](image, 0.5, np.random.default_rng(2))
    assert (made == again).all()


def test_stage_figures():
    flat = np.full((64, 64, 3), 128, np.uint8)
    light = degrade.lighting_gradient(flat, 0.4, np.random.default_rng(0)).astype(float) / 128
    assert 1 - 0.12 * 0.4 - 0.01 <= light.min() and light.max() <= 1 + 0.15 * 0.4 + 0.01
    noise = degrade.camera_noise(flat, 0.3, np.random.default_rng(0)).astype(float)
    assert abs(noise.std() - 3.0) < 0.3 and abs(noise.mean() - 127.5) < 0.3
    assert (degrade.jpeg_compress(flat, 0.5, np.random.default_rng(0)) == 128).all()
    assert degrade.fitted(3000, 1000, 1500) == (1500, 500) and degrade.fitted(10, 20, 30) == (10, 20)
    assert degrade.resized(flat, 16).shape == (16, 16, 3) and (degrade.resized(flat, 16) == 128).all()


def test_presets_and_failing_stages():
    image = picture()
    same, failed = degrade.degraded(image, "clean", np.random.default_rng(0))
    assert (same == image).all() and failed == []

    def broken(image, intensity, rng):
        raise ValueError("no")

    _, failed = degrade.degraded(image, "faded", np.random.default_rng(0), degrade.STAGES | {"camera_noise": broken})
    assert failed == ["camera_noise"]
    unknown, _ = degrade.degraded(image, "none such", np.random.default_rng(5))
    scan, _ = degrade.degraded(image, "bad_scan", np.random.default_rng(5))
    assert (unknown == scan).all()


def test_degraded_and_written_images(spark, tmp_path):
    image = picture(20, 30)
    rows = spark.createDataFrame([("a.png", 20, 30, bytearray(image.tobytes())), ("b.png", 20, 30, bytearray(b"short")), ("c.png", None, None, None)], "file_name string, height int, width int, pixels binary")
    made = degrade.degrade_images(rows, "file_name", ("clean", "faded")).cache()
    got = {(r["file_name"], r["condition"]): r for r in made.collect()}
    assert len(got) == 6 and bytes(got["a.png", "clean"]["pixels"]) == image.tobytes() and got["b.png", "faded"]["pixels"] is None
    written = {(r["key"], r["condition"]): r for r in publish.write_images(made, f"file://{tmp_path}").collect()}
    assert written["b.png", "clean"]["error"] == "no image"
    raw = (tmp_path / "clean" / "a.png").read_bytes()
    assert raw[:8] == b"\x89PNG\r\n\x1a\n" and int.from_bytes(raw[16:20], "big") == 30 and int.from_bytes(raw[20:24], "big") == 20
    at = raw.index(b"IDAT")
    lines = np.frombuffer(zlib.decompress(raw[at + 4 : at + 4 + int.from_bytes(raw[at - 4 : at], "big")]), np.uint8).reshape(20, 91)
    assert (lines[:, 1:].reshape(20, 30, 3) == image).all()
    found = json_docs.scan_files(spark, str(tmp_path), content=False).collect()
    assert {r["mime_type"] for r in found} == {"image/png"} and len(found) == 2


def test_png_names_reach_their_split(spark):
    docs = spark.createDataFrame([("a.png", {"clean": "a.png", "faded": "a.png"}), ("b.png", None)], "file_name string, degradation_variants map<string,string>")
    splits = spark.createDataFrame([("a.png", "train"), ("b.png", "test")], "file_name string, split string")
    got = {(r["split"], r["degradation"], r["base_id"], r["file_name"]) for r in publish.published(publish.metadata_rows(docs), splits).collect()}
    assert got == {("train", "clean", "a", "clean/a.png"), ("train", "faded", "a", "faded/a.png"), ("test", "clean", "b", "clean/b.png")}


# pages -----------------------------------------------------------------------------


def document(spark, n=2):
    schema = "file_name string, supplier_name string, customer_name string, document_date string, document_currency string, document_total_net double, document_total_tax double, document_total_amount double, line_items array<struct<description:string,quantity:double,unit_price:double,amount:double,tax_rate:string,tax_amount:double>>, taxes array<struct<base:double,rate:string,code:string,value:double>>"
    items = [("Bolt & nut <M8> with a very long description", 2.0, 1.5, 3.0, "23%", 0.69)] * n
    return spark.createDataFrame([("a", "Acme", "Buyer", "2024-05-06", "GBP", 6.0, 1.38, 7.38, items, [(6.0, "23%", "VAT", 1.38)])], schema)


def test_templates(spark):
    docs = render.template_context(document(spark)).crossJoin(spark.createDataFrame([(t,) for t in pages.LAYOUTS], "template string"))
    got = {r["template"]: r["text"].split("\n") for r in pages.page_text(docs).collect()}
    assert set(got) == set(pages.LAYOUTS)
    for name, lines in got.items():
        layout = pages.LAYOUTS[name]
        assert any(x.startswith("TOTAL") and x.endswith("£7.38") for x in lines), name
        assert ("Subtotal  £6.00" in lines) == layout.subtotal and ("VAT (23%)  £1.38" in lines) == (layout.tax == "each"), name
    assert sum(x == "" for x in got["formal_corporate"]) == 3 and sum(x == "" for x in got["freelancer_invoice"]) == 6
    assert any("BOLT & NUT <M8> WITH A VER  " in x for x in got["retail_receipt"])
    assert any(x.startswith("2.00 x BOLT") for x in got["event_ticket"])


def test_html_pdf_and_picture(spark):
    docs = pages.page_text(render.template_context(document(spark)).withColumn("template", F.lit("taxi_receipt")))
    html = pages.page_html(docs).first()["html"]
    assert html.count("<tr>") == docs.first()["text"].count("\n") + 1 and "&lt;M8&gt;" in html and "<M8>" not in html
    rows = pages.rendered_pages(docs.unionByName(docs.withColumn("text", F.lit(None).cast("string")))).collect()
    good, bad = sorted(rows, key=lambda r: r["error"] is not None)
    assert bytes(good["pdf"]).startswith(b"%PDF-1.4") and b"(TRIP RECEIPT) Tj" in bytes(good["pdf"]) and bytes(good["pdf"]).rstrip().endswith(b"%%EOF")
    assert len(good["pixels"]) == 3 * good["height"] * good["width"] and min(good["pixels"]) == 20
    assert bad["error"] is not None and bad["pdf"] is None
    assert pages.pdf([f"line {k}" for k in range(200)]).count(b"/Type /Page ") == 4


def test_prompts(spark):
    schema = extract.output_schema_json()
    assert set(json.loads(schema)) >= {"supplier_name", "line_items", "document_total_amount"}
    row = spark.range(1).select(render.extraction_prompt(schema).alias("a"), render.extraction_prompt(schema, F.lit(3)).alias("b"), render.extended_prompt(schema).alias("c")).first()
    assert schema in row["a"] and "one of 3 pages" in row["b"] and row["c"].count("\n- ") == len(selected())


# extraction and generation ------------------------------------------------------------


def test_backends(spark):
    with pytest.raises(ValueError, match="stand_in"):
        extract.get_backend("none such")
    extract.register_backend("shout", lambda mark="!": extract.Backend("shout", lambda pages, schema: [p.decode().upper() + mark for p in pages], lambda pages: [None] * len(pages)))
    assert extract.get_backend("shout", mark="?").structured([b"a"], "{}") == ["A?"]
    assert extract.quantization("4bit") == {"bits": 4} and extract.quantization(None) is None
    with pytest.raises(ValueError):
        extract.quantization("2bit")


def test_failing_files_and_pages_stay(spark):
    files = spark.createDataFrame([("in/a.pdf", b'{"supplierName": "A", "totalAmount": 5}\f{"taxAmount": 1}'), ("in/b.jpg", b"bad"), ("in/c.png", b"no answer at all here"), ("in/d.tiff", b"Supplier: Dee Ltd\nTotal: 12.50\n")], "path string, content binary")

    def cut(content, kind):
        if kind == "image/jpeg":
            raise ValueError("unreadable")
        return content.split(b"\f")

    got = {r["file_name"]: r for r in extract.process_files(files, extract.stand_in(), splitter=cut, stamp=F.lit("2024-01-01")).collect()}
    assert got["a.pdf"]["supplier_name"] == "A" and got["a.pdf"]["document_total_amount"] == 5 and got["a.pdf"]["document_total_tax"] == 1 and got["a.pdf"]["pages"] == 2 and got["a.pdf"]["error"] is None
    assert got["b.jpg"]["error"] == "unreadable" and got["b.jpg"]["mime_type"] == "image/jpeg"
    assert got["c.png"]["error"] == "parse_failed" and got["c.png"]["supplier_name"] is None
    assert got["d.tiff"]["supplier_name"] == "Dee Ltd" and got["d.tiff"]["document_total_amount"] == 12.5 and got["d.tiff"]["error"].startswith("parse_failed_recovered")

    def fail(pages, schema):
        raise RuntimeError("out of memory")

    broken = extract.Backend("broken", fail, lambda pages: [None] * len(pages))
    assert {r["error"] for r in extract.process_files(files, broken).collect()} == {"out of memory"}


def test_retry_by_text(spark):
    pages_ = spark.createDataFrame([("a", 1, b"The total: 9.00 is all I can see", None)], "path string, page_no int, page binary, error string")
    asked = []

    def again(prompts):
        return ['{"supplier_name": "Found"}' if "9.00" in p else None for p in prompts]

    backend = extract.Backend("two", lambda pages, schema: [p.decode() for p in pages], lambda pages: [], again)
    row = extract.recover_answers(extract.read_pages(pages_, backend), backend).first()
    assert json.loads(row["value"]) == {"supplier_name": "Found"} and row["error"] is None and asked == []
    plain = extract.Backend("one", lambda pages, schema: [p.decode() for p in pages], lambda pages: [])
    row = extract.recover_answers(extract.read_pages(pages_, plain), plain).first()
    assert json.loads(row["value"])["document_total_amount"] == 9.0 and row["error"] == "parse_failed_recovered_via_regex_extraction"


def test_generation_retries(spark):
    rows = spark.createDataFrame([(k, f"p{k}") for k in range(4)], "id long, prompt string")

    def complete(prompts, attempt):
        if attempt == 0 and "p3" in prompts:
            raise RuntimeError("busy")
        answers = {"p0": ['{"supplier_name": "A", "document_date": "2024-01-01"}'] * 3, "p1": ["nothing", "```json\n{\"supplier_name\": \"B\", \"document_date\": \"x\"}\n```"], "p2": ['{"supplier_name": ""}'] * 3, "p3": [None, "prose", "more prose"]}
        return [answers[p][attempt] for p in prompts]

    got = {r["id"]: r for r in generate.generate_records(rows, complete, at_once=1).collect()}
    assert [got[k]["attempts"] for k in range(4)] == [1, 2, 3, 3]
    assert json.loads(got[1]["record"])["supplier_name"] == "B" and json.loads(got[2]["record"]) == {"supplier_name": ""}  # the last attempt is taken
    assert got[3]["record"] is None and got[3]["error"] == "busy" and got[0]["error"] is None


# scoring interfaces, sources -----------------------------------------------------------


def test_greedy_and_optimal_alignment(spark):
    item = lambda d, a: (d, 1.0, a, a, "0%", 0.0)
    kind = "array<struct<description:string,quantity:double,unit_price:double,amount:double,tax_rate:string,tax_amount:double>>"
    rows = spark.createDataFrame([([item("red blue", 10.0), item("red", 10.0)], [item("red", 10.0), item("red blue green", 10.0)])], f"g {kind}, p {kind}")
    for method in ("optimal", "greedy"):
        got = align.align_items(rows, "g", "p", "r", method=method).first()["r"]
        assert {(x["g"], x["p"]) for x in got["pairs"]} == {(0, 1), (1, 0)} and got["f1"] == 1.0
    with pytest.raises(ValueError):
        align.align_items(rows, "g", "p", "r", method="other")
    # The best single pair first costs the greedy one more than it gains.
    matrix = np.array([[0.9, 0.8], [0.8, 0.0]])
    assert sorted(align.greedy(matrix)) == [(0, 0), (1, 1)] and sorted(align.assign(matrix)) == [(0, 1), (1, 0)]


def test_embedding_pairs(spark):
    rows = spark.createDataFrame([(1, "Green Apple", "green  apple!"), (2, "", "x"), (3, None, "x"), (4, "abcd", "abce"), (5, "abc", "xyz")], "k int, a string, b string")
    calls = spark.sparkContext.accumulator(0)

    def encode(texts):
        calls.add(len(texts))
        return similarity.hashed_ngrams(texts)

    got = {r["k"]: r["embedding"] for r in similarity.embedding_similarity(rows, "a", "b", encode=encode).collect()}
    assert got[1] == 1.0 and got[2] == got[3] == 0.0 and got[4] == pytest.approx(0.5) and got[5] == 0.0


def test_nearest_in_blocks(spark):
    x = np.random.default_rng(2).normal(size=(300, 8))
    x[7] = x[5] * 2
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(999, None)], "vec_id long, embedding array<double>")
    got = nearest.nearest_cosine(rows, F.col("vec_id") % 50 == 0, 4, block_rows=60).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(0, 300, 50):
        order = sorted((k for k in range(300) if k != q), key=lambda k: (-round(float(unit[q] @ unit[k]), 12), k))[:4]
        assert [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["place"])] == order


def test_unicode_forms(spark):
    rows = spark.createDataFrame([("ﬁne ①", "x"), (None, "ｱ"), ("plain", None)], "a string, b string")
    got = N.compose_unicode(rows, ["a", "b"]).collect()
    assert [tuple(r) for r in got] == [tuple(None if v is None else unicodedata.normalize("NFKC", v) for v in r) for r in rows.collect()]


def test_sources(spark, tmp_path):
    (tmp_path / "arrays").mkdir()
    for name, ids in (("b.json", "cd"), ("a.json", "abx")):
        (tmp_path / "arrays" / name).write_text(json.dumps([{"file_name": i} for i in ids]))
    got = json_docs.read_documents(spark, str(tmp_path / "arrays")).orderBy("ordinal").collect()
    assert [(r["ordinal"], r["file_name"]) for r in got] == list(enumerate("abxcd"))
    assert [r["file_name"] for r in json_docs.read_documents(spark, str(tmp_path / "arrays"), limit=4).orderBy("ordinal").collect()] == list("abxc")
    (tmp_path / "lines").mkdir()
    for k in range(3):
        (tmp_path / "lines" / f"p{k}.json").write_text("".join(json.dumps({"file_name": f"{k}-{n}"}) + "\n\n" for n in range(4 + k)))
    got = json_docs.read_documents(spark, str(tmp_path / "lines"), limit=7).orderBy("ordinal").collect()
    assert [(r["ordinal"], r["file_name"]) for r in got] == list(enumerate(["0-0", "0-1", "0-2", "0-3", "1-0", "1-1", "1-2"]))
    (tmp_path / "one.json").write_text('{\n "file_name": "single"\n}')
    assert [r["file_name"] for r in json_docs.read_documents(spark, str(tmp_path / "one.json")).collect()] == ["single"]
    (tmp_path / "text.json").write_text("hello")
    with pytest.raises(ValueError):
        json_docs.read_documents(spark, str(tmp_path / "text.json"))
    (tmp_path / "none.json").write_text(" \n")
    with pytest.raises(ValueError):
        json_docs.read_documents(spark, str(tmp_path / "none.json"))


def test_uploads(spark):
    assert json_docs.uploaded(spark, '{"file_name": "a"}').count() == 1
    with pytest.raises(ValueError, match="predictions"):
        json_docs.uploaded(spark, "{", "predictions")
    options = json_docs.upload_options("1", "supplier_name,notes", "anls")
    assert [f.name for f in options["fields"]] == ["supplier_name"] and options["metrics"] == ["anls"]
    with pytest.raises(ValueError, match="bleu"):
        json_docs.upload_options(metrics="bleu")
    assert json_docs.model_name("run.one.json") == "run.one" and json_docs.model_name(None, 2) == "model_2"
    assert json_docs.report_path("out/results.json") == "out/results_report.json"


def test_nested_report(spark, tmp_path):
    docs = document(spark)
    results = score.field_results(docs, docs, selected(names={"supplier_name", "document_date"}))
    items = score.item_results(docs, docs)
    report = score.run_report(results, items, "m", "d")
    rows = {(r["level"], r["key"]): json.loads(r["report"]) for r in report.collect()}
    assert rows["run", "m"]["num_documents"] == 1 and rows["run", "m"]["overall_weighted_score"] == 1.0 and rows["run", "m"]["line_item_metrics"]["f1"] == 1.0
    assert rows["field", "supplier_name"]["n"] == 1
    doc = rows["document", "a"]
    assert doc["fields"]["supplier_name"]["grade"] == "exact" and doc["line_items"]["matched_pairs"] == 2 and doc["line_items"]["unmatched_gt"] == 0
    json_docs.write_report(report, str(tmp_path / "report"))
    assert {p.name for p in (tmp_path / "report").iterdir() if p.is_dir()} == {"level=run", "level=field", "level=document"}


def test_runs_in_one_join(spark):
    gt = spark.createDataFrame([("a", "X"), ("b", "Y")], "file_name string, supplier_name string")
    pred = spark.createDataFrame([("a", "x", "m1"), ("b", "z", "m1"), ("a", "q", "m2")], "file_name string, supplier_name string, model string")
    got = {(r["model"], r["file_name"]): r["exact_match"] for r in score.field_results(gt, pred, selected(names={"supplier_name"}), by=("model",)).collect()}
    assert got == {("m1", "a"): 1.0, ("m1", "b"): 0.0, ("m2", "a"): 0.0}
