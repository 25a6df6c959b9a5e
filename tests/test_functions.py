import datetime
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperglass.functions import normalize as N
from paperglass.functions import recover as R
from paperglass.functions import similarity as M
from paperglass.functions.compare import compare_pairs
from paperglass.operators.align import assign, greedy
from paperglass.plans.registry import FIELDS, Field


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}").select("k", f(F.col("v")).alias("x")).collect()
    return [r["x"] for r in sorted(rows)]


@pytest.mark.parametrize(
    ("f", "values", "expected"),
    [
        (N.text, [" Hello,  WORLD! ", "", None, "..", "É x"], ["hello, world", None, None, None, "é x"]),
        (N.identifier, ["INV-001", "inv 001"], ["inv001", "inv001"]),
        (N.number, ["9.99", "9,99", "$9.99", "€27.20", "1,234.56", "1.234,56", "EUR 5", "23%", "x 7 y", "", "abc", "1,234", "5d"], [9.99, 9.99, 9.99, 27.2, 1234.56, 1234.56, 5.0, 23.0, 7.0, None, None, 1234.0, 5.0]),
        (N.date, ["2024-01-05", "05/01/2024", "13/25/2024", "12/25/2024", "1.2.24", "1/1/75", "January 26, 2024", "26th Jan 2024", "Mon, 2024-02-03", "2024-02-30", "x", None, "2024-01-02T03:04:05"],
         [datetime.date(2024, 1, 5), datetime.date(2024, 1, 5), None, datetime.date(2024, 12, 25), datetime.date(2024, 2, 1), datetime.date(1975, 1, 1), datetime.date(2024, 1, 26), datetime.date(2024, 1, 26), datetime.date(2024, 2, 3), None, None, None, datetime.date(2024, 1, 2)]),
        (N.time, ["9:05", "09:05:59", "9:05 pm", "12:00 AM", "1:30PM", "noon", None], ["09:05", "09:05", "21:05", "00:00", "13:30", "NOON", None]),
        (N.currency, ["euros", "$", " gbp ", "x", None], ["EUR", "USD", "GBP", "X", None]),
        (N.is_null, ["", "null", "N/A", "-", "--", "0", None], [True, True, True, True, True, False, True]),
        (N.tax_rate_text, ["0.23", "0.055", "23", "10", "23%", "0", None, "x", "5.5"], ["23%", "5.5%", "23%", "10%", "23%", "0%", "0%", "0%", "5.5%"]),
        (N.flat_text, ["A.  b!", None], ["a b", ""]),
        (N.flat_date, ["5 March 2024", "2024-1-2", "zz", None], ["2024-03-05", "2024-01-02", "zz", ""]),
        (N.shown_date, ["2024-03-05", "bad", None], ["05/03/2024", "bad", ""]),
    ],
)
def test_normalizers(spark, f, values, expected):
    assert column(spark, values, f) == expected


def test_elapsed(spark):
    assert column(spark, [3.5, 65.0, 3661.25], N.elapsed_text, "double") == ["3.50s", "1m 5.00s", "1h 1m 1.25s"]


def test_compose_unicode(spark):
    rows = N.compose_unicode(spark.createDataFrame([("ﬁx", "ﬁ"), (None, "a")], "a string, b string"), ["a"]).collect()
    assert [tuple(r) for r in rows] == [("fix", "ﬁ"), (None, "a")]


def judged(spark, name, gt, pred, **more):
    f = next((x for x in FIELDS if x.name == name), None) or Field(name, **more)
    return compare_pairs(spark.createDataFrame([(gt, pred)], "g string, p string"), f, "g", "p").first()


@pytest.mark.parametrize(
    ("field", "gt", "pred", "status", "exact", "similarity", "grade"),
    [
        ("document_date", "2024-01-05", "2024-05-01", "tp", 0.0, 0.5, "partial"),
        ("document_date", "2024-01-05", "05/01/2024", "tp", 1.0, 1.0, "exact"),
        ("document_date", "2024-01-05", "soon", "tp", 0.0, 0.0, "wrong"),
        ("document_total_amount", "0", "3", "tp", 0.0, 0.0, "wrong"),
        ("document_total_amount", "100", "100.04", "tp", 0.0, 0.9996, "acceptable"),
        ("invoice_number", "INV-001", "INV 001", "tp", 0.0, 1.0, "exact"),
        ("supplier_name", None, "n/a", "tn", 1.0, 1.0, "null_match"),
        ("supplier_name", None, "x", "fp", 0.0, 0.0, "hallucination"),
        ("supplier_name", "x", "-", "fn", 0.0, 0.0, "miss"),
        ("document_category", "transport", "transports", "tp", 0.0, 0.7, "partial"),
        ("document_category", "food", "rent", "tp", 0.0, 0.0, "wrong"),
        ("customer_address", "1 main street", "1 main road", "tp", 0.0, 2 / 3, "partial"),
        ("document_time", "09:05", "9:05 am", "tp", 1.0, 1.0, "exact"),
        ("notes", "mail a@b.co now", "mail a@b.co", "tp", 0.0, 0.9, "exact"),
    ],
)
def test_compare(spark, field, gt, pred, status, exact, similarity, grade):
    r = judged(spark, field, gt, pred)
    assert (r["null_status"], r["exact_match"], r["grade"]) == (status, exact, grade)
    assert r["similarity"] == pytest.approx(similarity)


def test_similarity_bounds(spark):
    random.seed(3)
    pairs = [("".join(random.choices("ab c", k=random.randrange(8))), "".join(random.choices("ab c", k=random.randrange(8)))) for _ in range(60)]
    a, b = F.col("a"), F.col("b")
    for r in spark.createDataFrame(pairs, "a string, b string").select(M.levenshtein_similarity(a, b).alias("x"), M.levenshtein_similarity(b, a).alias("y"), M.token_f1(a, b).alias("t")).collect():
        assert 0 <= r["x"] <= 1 and r["x"] == r["y"] and 0 <= r["t"] <= 1


def test_key_information(spark):
    r = spark.createDataFrame([("mail a@b.co or 2024-01-02", "2024-01-02"), ("none", "x")], "g string, p string").select(M.key_information_recall(F.col("g"), F.col("p")).alias("r")).collect()
    assert r[1]["r"] == 1.0 and 0 < r[0]["r"] < 1


def test_assignment_is_optimal():
    random.seed(5)
    for _ in range(150):
        n, m = random.randrange(1, 6), random.randrange(1, 6)
        s = np.round(np.random.default_rng(random.randrange(10**6)).random((n, m)), 2)
        total = lambda pairs: sum(s[i, j] for i, j in pairs)
        short, long = min(n, m), max(n, m)
        best = max(sum(s[i, j] if n <= m else s[j, i] for i, j in zip(range(short), p)) for p in itertools.permutations(range(long), short))
        pairs = assign(s)
        assert total(pairs) == pytest.approx(best) and total(greedy(s)) <= best + 1e-9
        assert len({i for i, _ in pairs}) == len({j for _, j in pairs}) == short
    assert assign(np.full((3, 3), 0.4)) == [(0, 0), (1, 1), (2, 2)]


def test_json_recovery(spark):
    texts = ['{"a": 1}', '```json\n{"a": 1}\n```', 'so {x} then {"a": 1} end', "no", None, '{"a":1} x']
    assert [bool(x) for x in column(spark, texts, R.extract_json)] == [True, True, True, False, False, True]
    assert [bool(x) for x in column(spark, texts, R.parse_response)] == [True, True, False, False, False, True]


def test_prose_and_suffix(spark):
    text = "**Supplier**: Acme Ltd\nDate: 15 July 2023\nTotal: €222.75\nCurrency: €\n2 x Tea Cup €71.00\n"
    r = spark.createDataFrame([(text,)], "s string").select(R.fields_from_prose(F.col("s")).alias("r")).first()["r"]
    assert (r["document_date"], r["document_total_amount"], r["line_items"][0]["amount"]) == ("15 July 2023", 222.75, 71.0)
    long = "x" * 100 + "abc " * 3000
    got = column(spark, [long, "short " * 3], R.without_repeated_suffix)
    assert got[0] == "x" * 100 + "abc " and got[1] == "short " * 3
