"""The registered queries of the document-extraction operators, each beside the
SQL that checks it.  Rounding to six decimals hides the order of float sums."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import degrade
from ..functions import normalize as N
from ..functions import recover as R
from ..functions import similarity as M
from ..functions.compare import compare_pairs
from ..operators import align, audit, extract, flatscore, generate, merge, nearest, pages, publish, render, repair, sampling, score
from ..sources import json_docs
from . import fixtures as X
from . import oracles as O
from .registry import FIELDS, GRADES, ITEM_FIELDS, NESTED_KINDS, TAX_FIELDS, Field, field_registry, item_registry, selected
from .shipping import ship_package

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, name: str | None = None):
    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return f(spark, sf_dir)

        _QUERIES[name or f.__name__] = run
        if oracle is not None:
            _ORACLES[name or f.__name__] = oracle
        return f

    return register


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if t in ("int", "smallint") else F.col(c) for c, t in df.dtypes))


def _results(spark, sf_dir, names=None):
    return score.field_results(X.gt_docs(spark, sf_dir), X.pred_docs(spark, sf_dir), X.registry_rows(names or X.SCORED))


# scoring ------------------------------------------------------------------------


@query(O.with_results(O.metrics()))
def field_metrics(spark, sf_dir):
    return rounded(score.field_metrics(_results(spark, sf_dir)))


@query(O.with_results("SELECT file_name, field_name, null_status, round(exact_match, 6) AS exact_match, round(similarity, 6) AS similarity, round(levenshtein, 6) AS levenshtein, grade FROM res"))
def field_results(spark, sf_dir):
    return rounded(_results(spark, sf_dir).drop("field_type", "tier", "weight"))


@query(O.with_results("SELECT field_name, null_status, count(*) AS n FROM res GROUP BY 1, 2"))
def null_status_matrix(spark, sf_dir):
    return _results(spark, sf_dir).groupBy("field_name", "null_status").agg(F.count(F.lit(1)).alias("n"))


@query(O.with_results("SELECT x.grade, count(res.grade) AS n FROM (VALUES " + ", ".join(f"('{g}')" for g in GRADES) + ") x(grade) LEFT JOIN res ON res.grade = x.grade GROUP BY 1"))
def grade_distribution(spark, sf_dir):
    return score.grade_distribution(_results(spark, sf_dir))


#: A true negative has no score; it only makes its document known.
_EVERY_DOC = "SELECT file_name, tier, CASE WHEN null_status <> 'tn' THEN similarity END AS score, CASE WHEN null_status <> 'tn' THEN weight END AS weight FROM res"
_RUN = "SELECT {by}tier, avg(similarity) AS score, any_value(weight) AS weight FROM res WHERE null_status <> 'tn' GROUP BY {by}field_name, tier"


@query(O.with_results(O.tiers(_EVERY_DOC, "file_name")))
def doc_scores(spark, sf_dir):
    return rounded(score.document_scores(_results(spark, sf_dir)))


@query(O.with_results(f"SELECT * FROM ({O.tiers(_EVERY_DOC, 'file_name')}) ORDER BY overall_score, file_name LIMIT 5"))
def worst_docs(spark, sf_dir):
    return score.worst_documents(rounded(score.document_scores(_results(spark, sf_dir))))


@query(O.with_results(O.tiers(_RUN.format(by=""), "", "wfes")))
def tier_scores(spark, sf_dir):
    return rounded(score.run_scores(score.field_metrics(_results(spark, sf_dir))))


@query(O.with_results(O.entity()))
def entity_f1(spark, sf_dir):
    return rounded(score.entity_f1(_results(spark, sf_dir)))


@query(O.with_results(O.anls()))
def anls(spark, sf_dir):
    return rounded(score.anls(_results(spark, sf_dir)))


def _standard_sql(by: str) -> str:
    on = f"USING ({by})" if by else "ON true"
    lead = f"{by}, " if by else ""
    return f"""SELECT {lead}a.wfes, b.f1 AS entity_f1, b.precision AS entity_precision, b.recall AS entity_recall, c.anls
      FROM (SELECT {lead}wfes FROM ({O.tiers(_RUN.format(by=lead), by, 'wfes')})) a JOIN (SELECT * FROM ({O.entity(by)}) WHERE field_name IS NULL) b {on} JOIN (SELECT * FROM ({O.anls(by)}) WHERE field_name IS NULL) c {on}"""


@query(O.with_results(_standard_sql("")))
def standard_metrics(spark, sf_dir):
    return rounded(score.standard_metrics(_results(spark, sf_dir)))


def _models(spark, sf_dir):
    said = X.union_all([p.withColumn("model", F.lit(m)) for m, p in X.model_predictions(spark, sf_dir).items()])
    return score.field_results(X.gt_docs(spark, sf_dir), said, X.registry_rows(X.SCORED), by=("model",))


@query(O.with_models(f"""SELECT metric, model, value, row_number() OVER (PARTITION BY metric ORDER BY value DESC, model) AS place
  FROM (UNPIVOT (SELECT model, wfes, entity_f1, anls FROM ({_standard_sql('model')})) ON wfes, entity_f1, anls INTO NAME metric VALUE value)""", X.SCORED))
def model_ranking(spark, sf_dir):
    return rounded(score.model_ranking(rounded(score.standard_metrics(_models(spark, sf_dir), by=["model"])), ["wfes", "entity_f1", "anls"]))


@query(O.with_models("""SELECT field_name, alpha, beta, gamma, CASE WHEN alpha >= beta AND alpha >= gamma THEN 'alpha' WHEN beta >= gamma THEN 'beta' ELSE 'gamma' END AS winner
  FROM (SELECT field_name, """ + ", ".join(f"round(avg(similarity) FILTER (model = '{m}' AND null_status <> 'tn'), 6) AS {m}" for m in X.MODELS) + " FROM res GROUP BY 1)", X.SCORED))
def field_comparison_pivot(spark, sf_dir):
    made = rounded(score.field_metrics(_models(spark, sf_dir), ["model"]))
    return score.field_comparison(made, list(X.MODELS))


@query(O.BOTH + " SELECT 'gt_only' AS side, file_name FROM gt WHERE file_name NOT IN (SELECT file_name FROM pred) UNION ALL SELECT 'pred_only', file_name FROM pred WHERE file_name NOT IN (SELECT file_name FROM gt)")
def unmatched_files(spark, sf_dir):
    return score.unmatched(X.gt_docs(spark, sf_dir), X.pred_docs(spark, sf_dir))


@query("SELECT user_id, max_by(event_type, event_id) AS event_type, max_by(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY user_id")
def last_wins_dedup(spark, sf_dir):
    events = X.table(spark, sf_dir, "events").select("user_id", "event_type", "value", "event_id")
    return score.last_wins(events.withColumn("ordinal", F.col("event_id")), "user_id").drop("ordinal")


@query(O.BOTH + " SELECT CAST(count(*) AS BIGINT) AS documents, CAST(count(*) FILTER (k % 19 = 0) AS BIGINT) AS failed FROM gt")
def run_summary(spark, sf_dir):
    gt, pred = X.gt_docs(spark, sf_dir), X.pred_docs(spark, sf_dir)
    joined = gt.select("file_name").join(pred.select("file_name", F.lit(1).alias("ok")), "file_name", "left")
    return joined.agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("ok").isNull()).alias("failed"))


@query("""WITH f AS (SELECT * FROM (VALUES """ + ", ".join(f"('{f.name}', {f.tier})" for f in FIELDS) + """) x(name, tier)) SELECT tier, count(*) AS fields FROM f GROUP BY tier""")
def registry_lookup(spark, sf_dir):
    return field_registry(spark).groupBy("tier").agg(F.count(F.lit(1)).alias("fields"))


@query(O.with_results("SELECT field_name, tier, count(*) AS n FROM res WHERE tier IN (1, 2) GROUP BY 1, 2", ("supplier_name", "document_currency", "document_total_tax")))
def field_filter(spark, sf_dir):
    chosen = [f for f in selected(tiers={1, 2}, names={"supplier_name", "document_currency", "document_total_tax"})]
    return rounded(score.field_results(X.gt_docs(spark, sf_dir), X.pred_docs(spark, sf_dir), chosen).groupBy("field_name", "tier").agg(F.count(F.lit(1)).alias("n")))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{t}', '{n}', '{k}', {w}::DOUBLE)" for t, fs in (("line_items", ITEM_FIELDS), ("taxes", TAX_FIELDS)) for n, k, w in fs) + ") x(list, name, field_type, weight)")
def item_field_registry(spark, sf_dir):
    return item_registry(spark)


# similarity and parsing ---------------------------------------------------------

_PARTS = "(SELECT a.p_partkey, a.p_name AS a, b.p_name AS b, a.p_type AS ta, b.p_type AS tb FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1)"


def _parts(spark, sf_dir):
    part = X.table(spark, sf_dir, "part")
    other = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("b"), F.col("p_type").alias("tb"))
    return part.select("p_partkey", F.col("p_name").alias("a"), F.col("p_type").alias("ta")).join(other, "p_partkey")


@query(f"SELECT p_partkey, levenshtein(a, b) AS distance, round({O.lev(O.text('a'), O.text('b'))}, 6) AS similarity FROM {_PARTS}")
def levenshtein_pairs(spark, sf_dir):
    return rounded(_parts(spark, sf_dir).select("p_partkey", F.levenshtein("a", "b").alias("distance"), M.levenshtein_similarity(F.col("a"), F.col("b")).alias("similarity")))


@query(f"SELECT p_partkey, round({O.token_f1(O.text('ta'), O.text('tb'))}, 6) AS f1 FROM {_PARTS}")
def token_f1_pairs(spark, sf_dir):
    return rounded(_parts(spark, sf_dir).select("p_partkey", M.token_f1(F.col("ta"), F.col("tb")).alias("f1")))


@query(f"SELECT p_partkey, len(list_intersect(list_distinct(string_split(lower(ta), ' ')), list_distinct(string_split(lower(tb), ' ')))) AS shared, CAST({O.text('ta')} = {O.text('tb')} AS INT) AS same FROM {_PARTS}")
def token_sets(spark, sf_dir):
    a, b = N.tokens(F.col("ta")), N.tokens(F.col("tb"))
    return rounded(_parts(spark, sf_dir).select("p_partkey", F.size(F.array_intersect(a, b)).alias("shared"), M.exact_match(F.col("ta"), F.col("tb")).cast("int").alias("same")))


@query(f"SELECT p_partkey, CASE WHEN {O.text('ta')} = {O.text('tb')} THEN 1e0 WHEN {O.lev(O.text('ta'), O.text('tb'))} >= 0.8 THEN 0.7e0 ELSE 0e0 END AS similarity FROM {_PARTS}")
def category_match(spark, sf_dir):
    return compare_pairs(_parts(spark, sf_dir), Field("p_type", "category", 1, 1.0), "ta", "tb").select("p_partkey", "similarity")


_NUMBERS = """SELECT o_orderkey AS k, CASE o_orderkey % 9
  WHEN 0 THEN '€ ' || CAST(o_orderkey AS STRING) || ',5' WHEN 1 THEN 'USD ' || CAST(o_orderkey % 1000 AS STRING) || '.25' WHEN 2 THEN '1.' || lpad(CAST(o_orderkey % 1000 AS STRING), 3, '0') || ',75'
  WHEN 3 THEN '1,' || lpad(CAST(o_orderkey % 1000 AS STRING), 3, '0') || '.75' WHEN 4 THEN CAST(o_orderkey % 100 AS STRING) || '%' WHEN 5 THEN '2,' || lpad(CAST(o_orderkey % 1000 AS STRING), 3, '0')
  WHEN 6 THEN 'about ' || CAST(o_orderkey % 100 AS STRING) || ' items' WHEN 7 THEN 'none' ELSE '-' || CAST(o_orderkey % 100 AS STRING) || '.5' END AS s FROM {orders}"""


def _over(sql: str, spark, sf_dir, **tables) -> DataFrame:
    return spark.sql(sql, **{k: X.table(spark, sf_dir, v) for k, v in (tables or {"orders": "orders"}).items()})


@query(f"SELECT k, s, {O.number('s')} AS number FROM ({_NUMBERS.format(orders='orders')})")
def numeric_parse(spark, sf_dir):
    return _over(_NUMBERS, spark, sf_dir).select("k", "s", N.number(F.col("s")).alias("number"))


_DATES = """SELECT o_orderkey AS k, d, CASE o_orderkey % 5 WHEN 0 THEN d WHEN 1 THEN substr(d, 9, 2) || '/' || substr(d, 6, 2) || '/' || substr(d, 1, 4) WHEN 2 THEN substr(d, 6, 2) || '/' || substr(d, 9, 2) || '/' || substr(d, 1, 4)
  WHEN 3 THEN 'not a date' ELSE d END AS s FROM (SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS STRING) AS d FROM {orders})"""


@query(f"SELECT k, s, CAST({O.date('s')} AS STRING) AS parsed FROM ({_DATES.format(orders='orders')})")
def date_parse(spark, sf_dir):
    return _over(_DATES, spark, sf_dir).select("k", "s", N.date(F.col("s")).cast("string").alias("parsed"))


@query(O.with_results("SELECT file_name, similarity, grade FROM res WHERE similarity = 0.5", ("document_date",)))
def date_swap(spark, sf_dir):
    return _results(spark, sf_dir, ("document_date",)).where(F.col("similarity") == 0.5).select("file_name", "similarity", "grade")


_TIMES = """SELECT event_id, CASE event_id % 4 WHEN 0 THEN lpad(CAST(h AS STRING), 2, '0') || ':' || m WHEN 1 THEN CAST((h + 11) % 12 + 1 AS STRING) || ':' || m || CASE WHEN h < 12 THEN ' am' ELSE ' pm' END
  WHEN 2 THEN lpad(CAST(h AS STRING), 2, '0') || ':' || m || ':07' ELSE 'half past' END AS s FROM (SELECT event_id, event_id % 24 AS h, lpad(CAST(event_id % 60 AS STRING), 2, '0') AS m FROM {events})"""


@query("SELECT event_id, CASE WHEN event_id % 4 = 3 THEN 'HALF PAST' ELSE lpad(CAST(event_id % 24 AS STRING), 2, '0') || ':' || lpad(CAST(event_id % 60 AS STRING), 2, '0') END AS t FROM events")
def time_parse(spark, sf_dir):
    return _over(_TIMES, spark, sf_dir, events="events").select("event_id", N.time(F.col("s")).alias("t"))


_ALIASES = "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'euros' WHEN 1 THEN ' Sterling ' WHEN 2 THEN '$' WHEN 3 THEN 'chf' WHEN 4 THEN 'Yen' ELSE 'pesos' END AS s FROM {events}"


@query("SELECT code, count(*) AS n FROM (SELECT CASE event_id % 6 WHEN 0 THEN 'EUR' WHEN 1 THEN 'GBP' WHEN 2 THEN 'USD' WHEN 3 THEN 'CHF' WHEN 4 THEN 'JPY' ELSE 'PESOS' END AS code FROM events) GROUP BY 1")
def currency_alias(spark, sf_dir):
    return _over(_ALIASES, spark, sf_dir, events="events").groupBy(N.currency(F.col("s")).alias("code")).agg(F.count(F.lit(1)).alias("n"))


@query(rf"SELECT conv_id, turn, len(list_distinct(regexp_extract_all(text, '[\w.+-]+@[\w-]+\.[\w.-]+'))) AS emails, len(list_distinct(regexp_extract_all(text, '\d{{1,4}}[-/.]\d{{1,2}}[-/.]\d{{1,4}}'))) AS dates FROM conversations")
def key_info_extract(spark, sf_dir):
    found = M.key_information(F.col("text"))
    return rounded(X.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(found["emails"]).alias("emails"), F.size(found["dates"]).alias("dates")))


@query(O.BOTH + f" SELECT g.file_name, round({O.key_recall('g.notes', 'p.notes')}, 6) AS recall FROM gt g JOIN pred p ON g.file_name = p.file_name WHERE g.notes IS NOT NULL")
def key_info_recall(spark, sf_dir):
    both = X.gt_docs(spark, sf_dir).where("notes is not null").select("file_name", F.col("notes").alias("g")).join(X.pred_docs(spark, sf_dir).select("file_name", F.col("notes").alias("p")), "file_name")
    return rounded(both.select("file_name", M.key_information_recall(F.col("g"), F.col("p")).alias("recall")))


@query("""SELECT q AS query_id, vec_id, place, round(c, 6) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY c DESC, vec_id) AS place FROM (
  SELECT a.vec_id AS q, b.vec_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS c FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)) WHERE place <= 5""")
def embedding_cosine_topk(spark, sf_dir):
    """Nearest of all rows, for the stated query set (ids divisible by 100)."""
    return rounded(nearest.nearest_cosine(X.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0))


# audit and repair ---------------------------------------------------------------

_ITEMS = f"""WITH l AS ({O.LINES}), d AS (SELECT k, 'doc_' || CAST(k AS STRING) AS file_name, sum(amount) AS net0, sum(tax_amount) AS tax0, count(*) AS n FROM l GROUP BY k),
  docs AS (SELECT k, file_name, n, net0, tax0, net0 + CASE WHEN k % 17 = 0 THEN 3 ELSE 0 END AS net, net0 + tax0 + CASE WHEN k % 19 = 0 THEN 1 ELSE 0 END AS gross, tax0 + CASE WHEN k % 13 = 0 THEN 2 ELSE 0 END AS tvalue FROM d)"""
_RATE = "CAST(replace(tax_rate, '%', '') AS DOUBLE)"
_VIOLATIONS = f"""SELECT 'doc_' || CAST(k AS STRING) AS file_name, 'line_amount' AS rule, line - 1 AS position FROM l WHERE abs(quantity * unit_price - amount) > 0.011
  UNION ALL SELECT 'doc_' || CAST(k AS STRING), 'line_tax', line - 1 FROM l WHERE abs(amount * {_RATE} / 100 - tax_amount) > 0.011
  UNION ALL SELECT file_name, 'items_net', NULL FROM docs WHERE abs(net0 - net) > 0.011 UNION ALL SELECT file_name, 'gross', NULL FROM docs WHERE abs(net + tax0 - gross) > 0.011
  UNION ALL SELECT file_name, 'taxes_net', NULL FROM docs WHERE abs(net0 - net) > 0.011 UNION ALL SELECT file_name, 'taxes_tax', NULL FROM docs WHERE abs(tvalue - tax0) > 0.011
  UNION ALL SELECT file_name, 'tax_value', 0 FROM docs WHERE abs(net0 * 10 / 100 - tvalue) > 0.011"""


@query(f"{_ITEMS} SELECT rule, count(*) AS violations FROM ({_VIOLATIONS}) GROUP BY rule")
def arith_audit(spark, sf_dir):
    return audit.violation_counts(audit.arithmetic_violations(X.item_docs(spark, sf_dir)))


@query(f"{_ITEMS} SELECT (SELECT count(*) FROM docs) AS records, count(DISTINCT file_name) AS dirty, (SELECT count(*) FROM docs) - count(DISTINCT file_name) AS clean FROM ({_VIOLATIONS})")
def clean_records(spark, sf_dir):
    docs = X.item_docs(spark, sf_dir)
    return audit.clean_share(docs, audit.arithmetic_violations(docs))


@query(f"{_ITEMS} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY file_name, position NULLS FIRST) AS example FROM ({_VIOLATIONS})) WHERE example <= 10")
def violation_examples(spark, sf_dir):
    return rounded(audit.violation_examples(audit.arithmetic_violations(X.item_docs(spark, sf_dir))))


@query(f"{_ITEMS}, p AS (SELECT * FROM docs WHERE k % 19 <> 0) SELECT file_name FROM p WHERE k % 23 = 0 OR (k % 4 = 0 AND n = 1) OR gross = 0")
def degenerate_docs(spark, sf_dir):
    return audit.degenerate(X.item_predictions(spark, sf_dir)).select("file_name")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def dup_keys(spark, sf_dir):
    rows = X.table(spark, sf_dir, "lineitem").withColumn("key", F.struct("l_orderkey", "l_linenumber"))
    return audit.duplicate_keys(rows, "key").select("key.*", "n")


@query(O.BOTH + " " + " UNION ALL ".join(f"SELECT '{f}' AS field, {k} AS position, " + (f"count(*) FILTER ({f} IS NULL{'' if f.startswith('document_total') else f' OR {f} = {chr(39)}{chr(39)}'})" if f in ("file_name", *X.SCORED) else "count(*)") + " AS empty, round(empty / count(*), 6) AS share FROM pred" for k, f in enumerate(audit.SCHEMA_FIELDS)))
def sparsity(spark, sf_dir):
    return rounded(audit.sparsity(X.pred_docs(spark, sf_dir)))


@query(f"{_ITEMS} SELECT 'line_items' AS list, CAST(sum(n) AS BIGINT) AS total, round(avg(n), 6) AS mean, min(n) AS least, max(n) AS most, count(*) FILTER (n = 0) AS empty, 0 AS notes_filled FROM docs UNION ALL SELECT 'taxes', count(*), 1e0, 1, 1, 0, 0 FROM docs")
def array_stats(spark, sf_dir):
    return rounded(audit.array_stats(X.item_docs(spark, sf_dir).withColumn("notes", F.lit(""))))


@query(f"{_ITEMS} SELECT n AS items, count(*) AS documents FROM docs GROUP BY n")
def item_histogram(spark, sf_dir):
    return rounded(audit.size_histogram(X.item_docs(spark, sf_dir)))


@query(O.BOTH + " " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS \"distinct\", count({c}) AS filled, round(count(DISTINCT {c}) / count({c}), 6) AS share FROM gt" for c in ("supplier_name", "supplier_address", "notes")))
def uniqueness(spark, sf_dir):
    return rounded(audit.uniqueness(X.gt_docs(spark, sf_dir), ["supplier_name", "supplier_address", "notes"]))


@query(O.BOTH + " SELECT supplier_name AS value, count(*) AS n FROM gt WHERE supplier_name IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def uniqueness_topk(spark, sf_dir):
    return audit.most_common(X.gt_docs(spark, sf_dir), "supplier_name", 10)


@query(O.BOTH + " SELECT coalesce(supplier_name, '<null>') AS value, count(*) AS n FROM gt GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15")
def subcategory_top(spark, sf_dir):
    return audit.most_common(X.gt_docs(spark, sf_dir), "supplier_name", 15, "<null>")


@query("SELECT 'lang' AS key, lang AS value, count(*) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY 2")
def dist_counts(spark, sf_dir):
    return audit.distributions(X.table(spark, sf_dir, "documents"), ("lang", "source"))


_REGISTERED = "SELECT o_orderkey AS k, CASE o_orderkey % 5 WHEN 0 THEN 'IE 1234' WHEN 1 THEN 'gb99' WHEN 2 THEN 'US-1' WHEN 3 THEN '12-99' END AS supplier_company_registrations, CASE o_orderkey % 4 WHEN 0 THEN 'EUR' WHEN 1 THEN 'GBP' WHEN 2 THEN 'USD' ELSE 'XXX' END AS document_currency FROM {orders}"


@query("SELECT k FROM (" + _REGISTERED.format(orders="orders") + ") WHERE (document_currency = 'EUR' AND k % 5 IN (1, 2)) OR (document_currency = 'GBP' AND k % 5 IN (0, 2)) OR (document_currency = 'USD' AND k % 5 IN (0, 1))")
def prefix_mismatch(spark, sf_dir):
    return audit.prefix_mismatches(_over(_REGISTERED, spark, sf_dir)).select("k")


def _variants(spark, sf_dir):
    gt = X.gt_docs(spark, sf_dir)
    k, f = F.col("k"), F.col("file_name")
    return gt.withColumn("degradation_variants", F.when(k % 6 != 0, F.create_map(F.lit("clean"), f, F.lit("faded"), F.when(k % 10 == 0, F.concat(f, F.lit("x"))).otherwise(f))))


@query(O.BOTH + " SELECT file_name FROM gt WHERE k % 6 <> 0 AND k % 10 = 0")
def variant_disagreement(spark, sf_dir):
    return audit.variant_disagreements(_variants(spark, sf_dir)).select("file_name")


@query("SELECT x.field FROM (VALUES ('k'), ('j'), ('n'), ('missing')) x(field) WHERE x.field NOT IN (SELECT unnest(json_keys(props)) FROM events)")
def missing_schema_fields(spark, sf_dir):
    return audit.missing_fields(X.table(spark, sf_dir, "events").select(F.col("props").alias("value")), ("k", "j", "n", "missing"))


@query(f"""WITH l AS ({O.LINES}), f AS (SELECT k, line, quantity * unit_price AS paid, CASE WHEN tax_rate = '23%' THEN 23 ELSE 10 END AS rate FROM l)
  SELECT 'doc_' || CAST(k AS STRING) AS file_name, round(sum(paid), 2) AS net, round(sum(paid * rate) / 100, 2) AS tax, round(round(sum(paid), 2) + round(sum(paid * rate) / 100, 2), 2) AS total, count(*) AS n FROM f GROUP BY k""")
def math_repair(spark, sf_dir):
    fixed = repair.repair_math(X.item_docs(spark, sf_dir))
    return rounded(fixed.select("file_name", F.col("document_total_net").alias("net"), F.col("document_total_tax").alias("tax"), F.col("document_total_amount").alias("total"), F.size("line_items").alias("n")))


@query(f"{_ITEMS} SELECT 'total mismatch' AS issue, count(*) AS n FROM docs WHERE abs(net + tax0 - gross) > 0.10 UNION ALL SELECT 'line items sum mismatch', count(*) FROM docs WHERE abs(net0 - net) > 1")
def validate_issues(spark, sf_dir):
    return repair.validation_issues(X.item_docs(spark, sf_dir)).select(F.explode("issues").alias("issue")).groupBy("issue").agg(F.count(F.lit(1)).alias("n"))


_RATES = "SELECT event_id, CASE event_id % 7 WHEN 0 THEN '0.23' WHEN 1 THEN '0.055' WHEN 2 THEN '23' WHEN 3 THEN '23%' WHEN 4 THEN '0' WHEN 5 THEN 'zero' ELSE '5.5' END AS s FROM {events}"


@query("SELECT rate, count(*) AS n FROM (SELECT CASE event_id % 7 WHEN 0 THEN '23%' WHEN 1 THEN '5.5%' WHEN 2 THEN '23%' WHEN 3 THEN '23%' WHEN 4 THEN '0%' WHEN 5 THEN '0%' ELSE '5.5%' END AS rate FROM events) GROUP BY 1")
def rate_normalize(spark, sf_dir):
    return _over(_RATES, spark, sf_dir, events="events").groupBy(N.tax_rate_text(F.col("s")).alias("rate")).agg(F.count(F.lit(1)).alias("n"))


# flat scorer and items ------------------------------------------------------------

_FLAT_TEXT = lambda x: rf"regexp_replace(regexp_replace(lower(trim(coalesce({x}, ''))), '\s+', ' ', 'g'), '[^\w\s]', '', 'g')"
_FLAT_FIELDS = ("supplier_name", "document_date", "document_currency", "document_category", "invoice_number")
_FLAT_DATE = lambda x: f"coalesce(CAST({O.date(x)} AS STRING), trim({x}))"
_FLAT = O.BOTH + ", m AS (SELECT g.file_name, coalesce(g.degradation, 'unknown') AS degradation, " + ", ".join(f"CASE WHEN g.{f} IS NOT NULL THEN coalesce({_FLAT_DATE(f'p.{f}') if f == 'document_date' else _FLAT_TEXT(f'p.{f}')} = {_FLAT_DATE(f'g.{f}') if f == 'document_date' else _FLAT_TEXT(f'g.{f}')}, false) END AS {f}" for f in _FLAT_FIELDS) + ", " + ", ".join(f"abs(coalesce(p.{f}, 0) - g.{f}) <= 0.02 AS {f}" for f in flatscore.NUMERIC_FIELDS) + " FROM pred p JOIN gt g ON p.file_name = g.file_name)"
_FLAT_ALL = (*_FLAT_FIELDS, *flatscore.NUMERIC_FIELDS)
_FLAT_ACC = "SELECT degradation, count(*) AS count, " + ", ".join(f"avg(CAST({f} AS INT)) AS {f}_acc" for f in _FLAT_ALL) + " FROM m GROUP BY 1"
_FLAT_MEANS = f"SELECT *, ({' + '.join(f'{f}_acc' for f in _FLAT_ALL)}) / {len(_FLAT_ALL)} AS field_accuracy_mean, ({' + '.join(f'{f}_acc' for f in flatscore.NUMERIC_FIELDS)}) / 3 AS amount_accuracy FROM ({_FLAT_ACC})"


def _flat(spark, sf_dir):
    return flatscore.flat_matches(X.gt_docs(spark, sf_dir), X.pred_docs(spark, sf_dir))


@query(_FLAT + " SELECT file_name, " + ", ".join(f"CAST({f} AS INT) AS {f}" for f in _FLAT_ALL) + " FROM m")
def flat_lookup(spark, sf_dir):
    return rounded(_flat(spark, sf_dir).select("file_name", *(F.col(f).cast("int").alias(f) for f in _FLAT_ALL)))


@query(_FLAT + f" SELECT degradation, count, {', '.join(f'round({f}_acc, 6) AS {f}_acc' for f in _FLAT_ALL)}, round(field_accuracy_mean, 6) AS field_accuracy_mean, round(amount_accuracy, 6) AS amount_accuracy FROM ({_FLAT_MEANS})")
def flat_accuracy_by_condition(spark, sf_dir):
    return rounded(flatscore.flat_accuracy(_flat(spark, sf_dir)))


@query(_FLAT + f", a AS ({_FLAT_MEANS}), u AS (UNPIVOT (SELECT degradation, field_accuracy_mean, amount_accuracy FROM a) ON field_accuracy_mean, amount_accuracy INTO NAME metric VALUE value) SELECT u.degradation, u.metric, round(u.value, 6) AS value, round(u.value - c.value, 6) AS delta FROM u LEFT JOIN u c ON c.metric = u.metric AND c.degradation = 'clean'")
def delta_vs_clean(spark, sf_dir):
    return rounded(flatscore.delta_to_clean(flatscore.flat_accuracy(_flat(spark, sf_dir)), ["field_accuracy_mean", "amount_accuracy"]))


def _item_pairs(spark, sf_dir):
    gt, pred = X.item_docs(spark, sf_dir), X.item_predictions(spark, sf_dir)
    return gt.select("file_name", F.col("line_items").alias("g"), F.col("taxes").alias("gt")).join(pred.select("file_name", F.col("line_items").alias("p"), F.col("taxes").alias("pt")), "file_name")


@query(O.first_fit(_FLAT_TEXT))
def greedy_item_f1(spark, sf_dir):
    return rounded(_item_pairs(spark, sf_dir).select("file_name", align.first_fit_f1(F.col("g"), F.col("p")).alias("f1")))


@query(O.best_assignment("SELECT file_name, gt_count, pred_count, " + ", ".join(f'round("{c}", 6) AS "{c}"' for c in ("count_accuracy", "precision", "recall", "f1", "overall")) + " FROM item"))
def assignment_item_f1(spark, sf_dir):
    made = align.align_items(_item_pairs(spark, sf_dir), "g", "p", "r")
    return rounded(made.select("file_name", *(F.col(f"r.{c}").alias(c) for c in ("gt_count", "pred_count", "count_accuracy", "precision", "recall", "f1", "overall"))))


@query(f"{_ITEMS} SELECT file_name, 1e0 AS f1, CASE WHEN k % 19 = 0 THEN 0e0 ELSE 1e0 END AS overall FROM docs WHERE k % 19 <> 0")
def tax_item_f1(spark, sf_dir):
    made = align.align_taxes(_item_pairs(spark, sf_dir), "gt", "pt", "r")
    return rounded(made.select("file_name", "r.f1", "r.overall"))


@query(O.best_assignment("SELECT " + ", ".join(f'round(avg("{c}"), 6) AS "{c}"' for c in ("count_accuracy", "precision", "recall", "f1", "overall")) + ", " + ", ".join(f"round(coalesce(avg({f}), 0e0), 6) AS field_{f}" for f, *_ in ITEM_FIELDS) + " FROM item"))
def item_run_metrics(spark, sf_dir):
    items = score.item_results(X.item_docs(spark, sf_dir), X.item_predictions(spark, sf_dir))
    return rounded(score.item_run_metrics(items))


_WHOLE = ("supplier_name", "document_date", "document_currency", "document_total_amount", "document_total_net", "document_total_tax")
_NESTED = {f.name: f for f in FIELDS if f.kind in NESTED_KINDS}
#: Every scalar field is predicted as it is; the tax entry too.
_WHOLE_SCORES = " UNION ALL ".join([*(f"SELECT {f.tier} AS tier, 1e0 AS score, {f.weight}::DOUBLE AS weight" for f in FIELDS if f.name in _WHOLE), *(f"SELECT {f.tier}, {score_}, {f.weight}::DOUBLE{source}" for f, score_, source in ((_NESTED["line_items"], "avg(overall)", " FROM item"), (_NESTED["taxes"], "1e0", "")))])


@query(O.best_assignment(f"SELECT wfes, 1e0 AS entity_f1, 1e0 AS entity_precision, 1e0 AS entity_recall, 1e0 AS anls, (SELECT round(avg(f1), 6) FROM item) AS line_item_f1 FROM ({O.tiers(_WHOLE_SCORES, '', 'wfes')})"))
def full_evaluation(spark, sf_dir):
    """Standard metrics of a run with items and taxes."""
    gt, pred = X.item_docs(spark, sf_dir), X.item_predictions(spark, sf_dir)
    fields = selected(names=set(_WHOLE))
    return rounded(score.standard_metrics(score.field_results(gt, pred, fields), score.item_results(gt, pred)))


# merging, recovery ----------------------------------------------------------------

_MERGED = f"""WITH l AS ({O.LINES}), pages AS (SELECT *, (line - 1) // 2 AS page_no FROM l),
  kept AS (SELECT k, description, quantity, unit_price, min(line) AS line, arg_min(amount, line) AS amount FROM pages GROUP BY k, description, quantity, unit_price)
  SELECT 'doc_' || CAST(p.k AS STRING) AS file_name, 'Supplier ' || CAST(min(page_no) + 1 AS STRING) AS supplier_name, max(amount) AS document_total_amount, any_value(i.n) AS n_items, round(any_value(i.total), 6) AS items_total
  FROM pages p JOIN (SELECT k, count(*) AS n, sum(amount) AS total FROM kept GROUP BY k) i ON i.k = p.k GROUP BY p.k"""


@query(_MERGED)
def page_merge(spark, sf_dir):
    lines = X.lines(spark, sf_dir).withColumn("page_no", ((F.col("line") - 1) / 2).cast("int"))
    row = F.struct("line", "description", "quantity", "unit_price", "amount", "tax_rate", "tax_amount")
    pages = lines.groupBy("k", "page_no").agg(F.array_sort(F.collect_list(row)).alias("line_items"), F.max("amount").alias("document_total_amount"))
    pages = pages.select(F.concat(F.lit("doc_"), F.col("k").cast("string")).alias("file_name"), "page_no", "line_items", F.array().cast("array<struct<base:double,rate:string,code:string,value:double>>").alias("taxes"), F.lit("").alias("notes"), "document_total_amount", F.concat(F.lit("Supplier "), (F.col("page_no") + 1).cast("string")).alias("supplier_name"))
    merged = merge.merge_pages(pages)
    total = F.aggregate("line_items", F.lit(0.0), lambda s, x: s + x["amount"])
    return rounded(merged.select("file_name", "supplier_name", "document_total_amount", F.size("line_items").alias("n_items"), total.alias("items_total")))


@query("SELECT conv_id, role, min(turn) AS turn, arg_min(length(text), turn) AS length FROM conversations GROUP BY 1, 2")
def ordered_dedup(spark, sf_dir):
    rows = X.table(spark, sf_dir, "conversations").select("conv_id", "role", "turn", F.length("text").alias("length"))
    return rounded(merge.ordered_distinct(rows, ["conv_id"], ["role"], ["turn"]))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract(spark, sf_dir):
    """Objects between fences and prose, one in three each."""
    raw = X.table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.col("props")).when(F.col("event_id") % 3 == 1, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).otherwise(F.concat(F.lit("I think {not json} the answer is "), "props", F.lit(" ok."))).alias("s"))
    return raw.select("event_id", F.get_json_object(R.extract_json("s"), "$.k").cast("long").alias("k"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_response(spark, sf_dir):
    raw = X.table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("Here: "), "props")).otherwise(F.concat(F.lit("```json "), "props", F.lit(" ``` done"))).alias("s"))
    return raw.select("event_id", F.get_json_object(R.parse_response("s"), "$.k").cast("long").alias("k"))


def _prose(spark, sf_dir):
    gt = X.gt_docs(spark, sf_dir).where("supplier_name is not null")
    return gt.select("k", "file_name", "supplier_address", F.concat(F.lit("**Supplier**: Acme Trading\nInvoice Date: "), "document_date", F.lit("\nTotal Amount: "), F.format_string("%d.50", F.col("k") % 1000), F.lit("\nInvoice number: "), "invoice_number", F.lit("\nCurrency: "), "document_currency", F.lit("\n2 x Widget €19.00\n")).alias("s"))


@query(O.BOTH + " SELECT file_name, document_date, CAST(k % 1000 AS DOUBLE) + 0.5 AS total, invoice_number, document_currency, 1 AS n_items FROM gt WHERE supplier_name IS NOT NULL")
def reasoning_recover(spark, sf_dir):
    got = _prose(spark, sf_dir).select("file_name", R.fields_from_prose(F.col("s")).alias("r"))
    return rounded(got.select("file_name", "r.document_date", F.col("r.document_total_amount").alias("total"), "r.invoice_number", "r.document_currency", F.size("r.line_items").alias("n_items")))


@query(O.BOTH + " SELECT file_name, 'Retry Ltd' AS supplier_name, '555 0100 22' AS supplier_phone, k % 1000 + 0.5e0 AS document_total_amount FROM gt WHERE supplier_name IS NOT NULL AND k % 20 <> 0")
def recover_pipeline(spark, sf_dir):
    """Pages -> error pages out -> fields from prose -> defaults."""
    pages = _prose(spark, sf_dir).withColumn("error", F.when(F.col("k") % 10 == 0, "parse_failed")).withColumn("n_keys", F.when(F.col("k") % 20 == 0, 2).otherwise(9))
    got = merge.error_pages(pages).select("file_name", R.recovered(F.col("s"), F.lit("Supplier: Retry Ltd\nphone: 555 0100 22")).alias("r"))
    return got.select("file_name", "r.supplier_name", "r.supplier_phone", "r.document_total_amount")


#: The shortest suffix that a text of 8,000 characters or more ends with ten times.
_ONE_COPY = """SELECT doc_id, n, CASE WHEN unit IS NULL THEN n ELSE n - unit * (list_last(list_filter(range(10, n // unit + 1), lambda c: right(text, c * unit) = repeat(right(text, unit), CAST(c AS INT)))) - 1) END AS left_ FROM
  (SELECT doc_id, text, length(text) AS n, CASE WHEN length(text) >= 8000 THEN list_filter(range(2, length(text) // 10 + 1), lambda s: right(text, s) = left(right(text, 2 * s), s) AND right(text, 10 * s) = repeat(right(text, s), 10))[1] END AS unit FROM documents)"""


@query(f"SELECT doc_id, n + 1200 * (7 + length(CAST(doc_id AS STRING))) AS before, n + 7 + length(CAST(doc_id AS STRING)) AS after, n AS text_before, left_ AS text_after FROM ({_ONE_COPY})")
def repeated_suffix(spark, sf_dir):
    """Every whole text, as it is and with a repeated tail planted behind it."""
    docs = X.table(spark, sf_dir, "documents").select("doc_id", "text", F.concat("text", F.repeat(F.concat(F.lit(" again "), F.col("doc_id").cast("string")), 1200)).alias("s"))
    sizes = [F.length(x).cast("long").alias(name) for name, x in (("before", F.col("s")), ("after", R.without_repeated_suffix("s")), ("text_before", F.col("text")), ("text_after", R.without_repeated_suffix("text")))]
    return docs.select("doc_id", *sizes)


@query(O.BOTH + " SELECT file_name, supplier_name, document_total_amount AS total, 'other' AS document_category, 1 AS n_items, 2.5e0 * 4 AS amount, 'VAT' AS code FROM gt")
def normalize_output_keys(spark, sf_dir):
    """camelCase answers to snake_case documents with defaults."""
    gt = X.gt_docs(spark, sf_dir)
    item = F.array(F.create_map(F.lit("description"), F.lit("w"), F.lit("quantity"), F.lit("4"), F.lit("price"), F.lit("2.5")))
    tax = F.array(F.create_map(F.lit("code"), F.lit("VAT"), F.lit("amount"), F.lit("1.5")))
    raw = gt.select(F.to_json(F.struct(F.col("file_name").alias("filename"), F.col("supplier_name").alias("supplierName"), F.col("document_total_amount").alias("totalAmount"), item.alias("lineItems"), tax.alias("taxes"))).alias("value"))
    made = merge.normalize_output(raw)
    return rounded(made.select("file_name", "supplier_name", F.col("document_total_amount").alias("total"), "document_category", F.size("line_items").alias("n_items"), F.col("line_items")[0]["amount"].alias("amount"), F.col("taxes")[0]["code"].alias("code")))


# sampling, splits, publishing -------------------------------------------------------

_DRAW = lambda key, salt: f"(CAST(('0x' || substr(md5(CAST({key} AS STRING) || ':{salt}'), 1, 8)) AS BIGINT) / 4294967296e0)"


def _weighted_sql(u: str, values: list, weights: list[float]) -> str:
    total, end, out = sum(weights), 0.0, []
    for v, w in zip(values[:-1], weights[:-1]):
        end += w
        out.append(f"WHEN {u} * {total!r}::DOUBLE < {end!r}::DOUBLE THEN '{v}'")
    return f"CASE {' '.join(out)} ELSE '{values[-1]}' END"


_PARAMS = f"""SELECT o_orderkey AS id, {_weighted_sql(_DRAW('o_orderkey', 'params-region'), [r[0] for r in sampling.REGIONS], [r[3] for r in sampling.REGIONS])} AS region,
  {_weighted_sql(_DRAW('o_orderkey', 'params-complexity'), [c[0] for c in sampling.COMPLEXITIES], [c[1] for c in sampling.COMPLEXITIES])} AS complexity,
  {list(sampling.DOCUMENT_TYPES)!r}[CAST(floor({_DRAW('o_orderkey', 'params-type')} * {len(sampling.DOCUMENT_TYPES)}) AS INT) + 1] AS document_type FROM orders"""


def _params(spark, sf_dir):
    return sampling.generation_params(X.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")))


@query(_PARAMS)
def weighted_params(spark, sf_dir):
    return _params(spark, sf_dir).select("id", "region", "complexity", "document_type")


_PROFILE = "CASE " + " ".join(f"WHEN document_type IN {t!r} THEN '{p}'" if len(t) > 1 else f"WHEN document_type = '{t[0]}' THEN '{p}'" for p, t in sampling.PROFILE_OF_TYPE.items()) + " ELSE 'invoice' END"
_FILL = "(VALUES " + ", ".join(f"('{p}', '{f}', {q}::DOUBLE)" for p, levels in sampling.PROFILES.items() for level, q in sampling.FILL_PROBABILITY.items() for f in levels[level]) + ") x(profile, field, p)"


@query(f"SELECT id, count(*) AS n, string_agg(field, ',' ORDER BY field) AS fields FROM (SELECT id, {_PROFILE} AS profile FROM ({_PARAMS})) d JOIN {_FILL} USING (profile) WHERE CAST(('0x' || substr(md5(CAST(id AS STRING) || ':fields:' || field), 1, 8)) AS BIGINT) / 4294967296e0 < p GROUP BY id")
def field_sparsity_sample(spark, sf_dir):
    made = sampling.fields_to_fill(_params(spark, sf_dir))
    return rounded(made.select("id", F.size("fields").alias("n"), F.array_join(F.array_sort("fields"), ",").alias("fields")))


@query(f"SELECT 'region' AS key, region AS value, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM ({_PARAMS}) GROUP BY 2")
def generation_summary(spark, sf_dir):
    return rounded(sampling.generation_summary(_params(spark, sf_dir), ("region",)))


@query("""SELECT doc_id, source, CASE WHEN r < v THEN 'val' WHEN r < v + t THEN 'test' ELSE 'train' END AS split FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS STRING) || ':42'), doc_id) - 1 AS r,
  round_even(count(*) OVER (PARTITION BY source) * 0.1::DOUBLE, 0) AS v, round_even(count(*) OVER (PARTITION BY source) * 0.2::DOUBLE, 0) AS t FROM documents)""")
def stratified_split(spark, sf_dir):
    return sampling.stratified_split(X.table(spark, sf_dir, "documents"), "source", "doc_id")


@query("SELECT doc_id, CASE WHEN r < 70 THEN 'train' WHEN r < 80 THEN 'val' ELSE 'test' END AS split FROM (SELECT doc_id, row_number() OVER (ORDER BY md5(CAST(doc_id AS STRING) || ':42'), doc_id) - 1 AS r FROM documents) WHERE r < 100")
def fixed_split(spark, sf_dir):
    return sampling.fixed_split(X.table(spark, sf_dir, "documents"), "doc_id", 70, 10, 20)


@query(O.BOTH + " SELECT 'clean' AS degradation, 'clean/' || file_name AS file_name, file_name AS base_id, document_total_amount FROM gt UNION ALL SELECT 'faded', 'faded/' || file_name || CASE WHEN k % 10 = 0 THEN 'x' ELSE '' END, file_name, document_total_amount FROM gt WHERE k % 6 <> 0")
def variant_explode(spark, sf_dir):
    return publish.metadata_rows(_variants(spark, sf_dir)).select("degradation", "file_name", "base_id", "document_total_amount")


@query(O.BOTH + " SELECT v.degradation, g.file_name, CASE WHEN r < 70 THEN 'train' WHEN r < 80 THEN 'val' ELSE 'test' END AS split FROM (SELECT *, row_number() OVER (ORDER BY md5(file_name || ':42'), file_name) - 1 AS r FROM gt) g JOIN (VALUES ('clean'), ('faded')) v(degradation) ON v.degradation = 'clean' OR k % 6 <> 0 WHERE r < 100")
def variant_split_join(spark, sf_dir):
    rows = publish.metadata_rows(_variants(spark, sf_dir)).select("degradation", F.col("base_id").alias("file_name"))
    return sampling.assign_split(rows, sampling.fixed_split(X.gt_docs(spark, sf_dir), "file_name", 70, 10, 20)).select("degradation", "file_name", "split")


@query(f"{_ITEMS} SELECT file_name AS base_id, 'clean/' || file_name AS file_name, 'clean' AS degradation, 'Supplier ' || CAST(k % 101 AS STRING) AS supplier_name, round(gross, 6) AS document_total_amount, round(net, 6) AS document_total_net, round(tax0, 6) AS document_total_tax, n AS num_line_items, n AS listed, round(net0, 6) AS items_total, round(tvalue, 6) AS tax_value FROM docs")
def metadata_rows(spark, sf_dir):
    """Published rows; what their JSON lists hold is read back from the text."""
    rows = publish.metadata_rows(X.item_docs(spark, sf_dir))
    items, taxes = F.from_json("line_items", "array<struct<amount:double>>"), F.from_json("taxes", "array<struct<value:double>>")
    total = F.aggregate(items, F.lit(0.0), lambda s, x: s + x["amount"])
    return rounded(rows.select("base_id", "file_name", "degradation", "supplier_name", "document_total_amount", "document_total_net", "document_total_tax", "num_line_items", F.size(items).alias("listed"), total.alias("items_total"), taxes[0]["value"].alias("tax_value")))


@query(O.BOTH + """ SELECT k AS "number", supplier_name, document_date, 'synth_' || CASE WHEN k < 1000 THEN lpad(CAST(k AS STRING), 4, '0') ELSE CAST(k AS STRING) END || '_' || substr(md5('{"document_date":"' || document_date || '"' || coalesce(',"supplier_name":"' || supplier_name || '"', '') || '}'), 1, 8) AS base_name FROM gt""")
def doc_ids(spark, sf_dir):
    rows = X.gt_docs(spark, sf_dir).select(F.col("k").alias("number"), "supplier_name", "document_date")
    return render.document_names(rows, "number", ["supplier_name", "document_date"])


# labels, templates, prompts -----------------------------------------------------------

_KINDS = """SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN 'pos_thermal' WHEN o_orderkey % 5 = 1 THEN 'freelancer_invoice' END AS layout,
  CASE o_orderkey % 4 WHEN 0 THEN 'Tax Invoice' WHEN 1 THEN 'receipt' WHEN 2 THEN 'unknown' END AS type, CASE o_orderkey % 3 WHEN 0 THEN 'Pub' WHEN 1 THEN 'none' END AS sub, CASE o_orderkey % 2 WHEN 0 THEN 'Shipping' ELSE 'rent' END AS cat FROM {orders}"""


@query("SELECT k, CASE WHEN k % 5 = 0 THEN 'pos_thermal' WHEN k % 4 = 0 THEN 'formal_corporate' WHEN k % 4 = 1 THEN 'retail_receipt' WHEN k % 3 = 0 THEN 'pos_thermal' WHEN k % 2 = 0 THEN 'modern_minimal' ELSE 'formal_corporate' END AS template FROM (" + _KINDS.format(orders="orders") + ")")
def template_select(spark, sf_dir):
    return _over(_KINDS, spark, sf_dir).select("k", render.template(F.col("layout"), F.col("type"), F.col("sub"), F.col("cat"), F.col("k")).alias("template"))


@query(f"SELECT id, CASE document_type {' '.join(f'WHEN {t!r} THEN {v!r}' for t, v in render.LAYOUT_OF_TYPE.items())} END AS layout_style FROM ({_PARAMS})")
def template_hints(spark, sf_dir):
    return render.template_hints(_params(spark, sf_dir), "id").select("id", "_template_hints.layout_style")


def _font_sql(pool: str, salt: str) -> str:
    return _weighted_sql(_DRAW("id", f"font-{pool}-{salt}"), [f.replace(chr(39), chr(39) * 2) for f, _ in sampling.FONTS[pool]], [w for _, w in sampling.FONTS[pool]])


def _drawn_font(salt: str) -> str:
    return f"CASE WHEN document_type = 'receipt' THEN {_font_sql('mono', salt)} WHEN {_DRAW('id', 'font-serif')} < 0.15 THEN {_font_sql('serif', salt)} ELSE {_font_sql('sans', salt)} END"


@query(f"SELECT id, document_type = 'receipt' AS is_receipt, {_drawn_font('body')} AS body_font, CASE WHEN document_type <> 'receipt' AND {_DRAW('id', 'font-redraw')} < 0.30 THEN {_font_sql('sans', 'again')} ELSE {_drawn_font('heading')} END AS heading_font FROM ({_PARAMS})")
def font_choice(spark, sf_dir):
    """Fonts of all three pools: till receipts are set in one width."""
    receipt = F.col("document_type") == "receipt"
    rows = _params(spark, sf_dir).withColumn("template", F.when(receipt, "pos_thermal").otherwise("formal_corporate"))
    return sampling.fonts(rows, "id").select("id", receipt.alias("is_receipt"), "body_font", "heading_font")


@query("SELECT o_orderkey AS id, 'en' AS locale, 'IE' || CAST(o_orderkey AS STRING) || CASE WHEN o_orderkey % 3 > 0 THEN ', VAT' || CAST(o_orderkey % 97 AS STRING) ELSE '' END AS registrations, CASE o_orderkey % 3 WHEN 0 THEN '23%' WHEN 1 THEN '5.5%' ELSE '0%' END AS item_rate, CASE o_orderkey % 3 WHEN 0 THEN '23%' WHEN 1 THEN '5.5%' ELSE '0%' END AS tax_rate FROM orders")
def normalized_records(spark, sf_dir):
    """Registration lists joined, rates as percentage texts, the locale set."""
    k = F.col("o_orderkey")
    rate = F.when(k % 3 == 0, "0.23").when(k % 3 == 1, "5.5").otherwise("zero")
    numbers = F.array_compact(F.array(F.concat(F.lit("IE"), k.cast("string")), F.when(k % 3 > 0, F.concat(F.lit("VAT"), (k % 97).cast("string")))))
    rows = X.table(spark, sf_dir, "orders").select(k.alias("id"), F.lit("xx").alias("locale"), numbers.alias("supplier_company_registrations"), F.array(F.struct(rate.alias("tax_rate"))).alias("line_items"), F.array(F.struct(rate.alias("rate"))).alias("taxes"))
    made = repair.normalize_records(rows)
    return made.select("id", "locale", F.col("supplier_company_registrations").alias("registrations"), F.col("line_items")[0]["tax_rate"].alias("item_rate"), F.col("taxes")[0]["rate"].alias("tax_rate"))


_PAY = lambda low, high, salt: f"CAST({low} + CAST(floor({_DRAW('id', f'pay-{salt}')} * {high - low + 1}) AS BIGINT) AS STRING)"


@query(f"""SELECT id, region, CASE WHEN {_DRAW('id', 'pay-any')} > 0.4 THEN CASE region
  WHEN 'IE' THEN '{{"BIC":"BOFI' || CASE WHEN {_DRAW('id', 'pay-bic')} < 0.5 THEN 'IE' ELSE 'XX' END || '2D","IBAN":"IE' || {_PAY(10, 99, 'i1')} || 'BOFI' || {_PAY(10000000, 99999999, 'i2')} || {_PAY(100000, 999999, 'i3')} || '","Account Name":"Acme Payments Ltd"}}'
  WHEN 'GB' THEN '{{"Sort Code":"' || {_PAY(10, 99, 's1')} || '-' || {_PAY(10, 99, 's2')} || '-' || {_PAY(10, 99, 's3')} || '","Account No":"' || {_PAY(10000000, 99999999, 'a')} || '"}}'
  ELSE '{{"Bank":"National Bank #' || {_PAY(1000, 9999, 'b')} || '"}}' END END AS details FROM ({_PARAMS})""")
def payment_details(spark, sf_dir):
    return sampling.payment_details(_params(spark, sf_dir), "id").select("id", "region", F.to_json("payment_details").alias("details"))


@query(O.BOTH + " SELECT file_name, coalesce(document_total_amount, 0) AS total, coalesce(document_category, 'other') AS category, document_time IS NULL AS timeless FROM pred")
def label_projection(spark, sf_dir):
    made = render.labels(X.pred_docs(spark, sf_dir))
    return made.select("file_name", F.col("document_total_amount").alias("total"), F.coalesce("document_category", F.lit("other")).alias("category"), F.col("document_time").isNull().alias("timeless"))


@query(f"SELECT k, CASE WHEN regexp_full_match(s, '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN substr(s, 9, 2) || '/' || substr(s, 6, 2) || '/' || substr(s, 1, 4) ELSE s END AS shown FROM ({_DATES.format(orders='orders')})")
def format_dates(spark, sf_dir):
    return _over(_DATES, spark, sf_dir).select("k", N.shown_date(F.col("s")).alias("shown"))


@query(f"""{_ITEMS}, t AS (SELECT k, string_agg(CASE WHEN unit_price <> amount THEN substr(description, 1, 28) || ' ' || CAST(CAST(quantity AS INT) AS STRING) || '.0 ' || printf('%.2f', amount) || chr(10) || '@ ' || printf('%.2f', unit_price) || ' each' ELSE substr(description, 1, 28) || ' ' || CAST(CAST(quantity AS INT) AS STRING) || '.0 ' || printf('%.2f', amount) END, chr(10) ORDER BY line) AS rows FROM (SELECT k, line, description, quantity::DOUBLE AS quantity, unit_price, amount::DOUBLE AS amount FROM l) GROUP BY k)
  SELECT file_name, md5('SUPPLIER ' || CAST(k % 101 AS STRING) || chr(10) || 'Date: 06/05/2024 12:34' || chr(10) || rows || chr(10) || 'Subtotal €' || printf('%.2f', net::DOUBLE) || chr(10) || 'VAT (10%) €' || printf('%.2f', tvalue::DOUBLE) || chr(10) || 'TOTAL €' || printf('%.2f', gross::DOUBLE)) AS digest FROM docs JOIN t USING (k)""")
def receipt_text(spark, sf_dir):
    docs = render.receipt_text(render.template_context(X.item_docs(spark, sf_dir)))
    return docs.select("file_name", F.md5("text").alias("digest"))


_ORDERED_FILL = "(VALUES " + ", ".join(f"('{p}', '{f}', {n}, {q}::DOUBLE)" for p, levels in sampling.PROFILES.items() for n, (f, q) in enumerate((f, q) for level, q in sampling.FILL_PROBABILITY.items() for f in levels[level])) + ") x(profile, field, place, p)"
_TAXES_TEXT = "CASE region " + " ".join(f"WHEN '{r}' THEN '{render.TAX_TEXT[tax]}'" for r, _, tax, _ in sampling.REGIONS) + " END"
_DETAIL_TEXT = "CASE complexity " + " ".join(f"WHEN '{c}' THEN '{t}'" for c, t in render.COMPLEXITY_TEXT.items()) + " END"
#: (id, prompt) of every sampled set of parameters.
_PROMPTS = f"""SELECT id, array_to_string(list_filter(['Write one fictional ' || replace(document_type, '_', ' ') || ' for region ' || region || ' as a JSON object.', 'Tax rates: ' || {_TAXES_TEXT}, 'Complexity: ' || {_DETAIL_TEXT}, 'Fill these fields, all others null: ' || array_to_string(fields, ', '),
    CASE WHEN list_contains(fields, 'line_items') THEN 'line_items: description, quantity, unit_price, amount, tax_rate as text with %, tax_amount.' END, CASE WHEN list_contains(fields, 'taxes') THEN 'taxes: base, rate as text with %, code, value.' END,
    'amount is quantity x unit_price; net and tax are the sums of the lines; the total is net + tax; two decimals.', 'document_category is one of {", ".join(render.CATEGORIES)}.', 'Answer with the JSON only.'], lambda x: x IS NOT NULL), chr(10)) AS prompt
  FROM ({_PARAMS}) JOIN (SELECT id, list(field ORDER BY place) AS fields FROM (SELECT id, {_PROFILE} AS profile FROM ({_PARAMS})) d JOIN {_ORDERED_FILL} USING (profile)
    WHERE CAST(('0x' || substr(md5(CAST(id AS STRING) || ':fields:' || field), 1, 8)) AS BIGINT) / 4294967296e0 < p GROUP BY id) USING (id)"""


@query(f"SELECT id, prompt, 'Put the document analysis below into one JSON object of the given schema. Answer with the JSON only.' || chr(10) || chr(10) || 'Analysis:' || chr(10) || prompt || chr(10) || chr(10) || 'Schema:' || chr(10) || '{{}}' || chr(10) || chr(10) || 'JSON:' AS retry FROM ({_PROMPTS})")
def prompt_text(spark, sf_dir):
    made = render.generation_prompt(sampling.fields_to_fill(_params(spark, sf_dir)))
    return made.select("id", "prompt", R.retry_prompt(F.col("prompt"), "{}").alias("retry"))


_HASHED = f"SELECT id, CAST(('0x' || substr(md5(prompt), 1, 8)) AS BIGINT) AS h FROM ({_PROMPTS})"


@query(f"SELECT id, CASE WHEN h % 5 = 0 OR h % 7 = 0 THEN 2 ELSE 1 END AS attempts, 'Supplier ' || CAST(h % 97 AS STRING) AS supplier_name, h % 4 AS n_items, round((h % 50 + 0.5) * (h % 4) * (h % 4 + 1) / 2, 2) AS net, CASE WHEN h % 4 > 0 THEN '23%' END AS tax_rate FROM ({_HASHED})")
def generated_records(spark, sf_dir):
    """The generation loop with the stand-in model: answers without JSON or
    supplier are asked for again; arithmetic and rates are made right."""
    prompts = render.generation_prompt(sampling.fields_to_fill(_params(spark, sf_dir)))
    made = generate.generate_records(prompts)
    done = generate.finished_records(made, "id").select("id", "supplier_name", F.size("line_items").alias("n_items"), F.col("document_total_net").alias("net"), F.get("line_items", F.lit(0))["tax_rate"].alias("tax_rate"))
    return rounded(made.select("id", "attempts").join(done, "id"))


@query(f"SELECT count(*) AS asked, count(*) AS generated, 0 AS failed, count(*) AS math_fixed FROM ({_HASHED})")
def generated_totals(spark, sf_dir):
    prompts = render.generation_prompt(sampling.fields_to_fill(_params(spark, sf_dir)))
    made = generate.generate_records(prompts)
    return rounded(generate.generation_totals(made, generate.finished_records(made, "id")))


# sources and sinks ----------------------------------------------------------------------

_FILES = "SELECT o_orderkey AS k, 'dir/file_' || CAST(o_orderkey AS STRING) || CASE o_orderkey % 5 WHEN 0 THEN '.PDF' WHEN 1 THEN '.jpg' WHEN 2 THEN '.JPEG' WHEN 3 THEN '.png' ELSE '.txt' END AS path FROM {orders}"


@query("SELECT mime, count(*) AS n FROM (SELECT CASE o_orderkey % 5 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'image/jpeg' WHEN 3 THEN 'image/png' ELSE 'application/octet-stream' END AS mime FROM orders) GROUP BY 1")
def file_scan_mime(spark, sf_dir):
    return _over(_FILES, spark, sf_dir).groupBy(json_docs.mime_type(F.col("path")).alias("mime")).agg(F.count(F.lit(1)).alias("n"))


def _scratch(spark: SparkSession, name: str) -> str:
    """A folder for round trips, in the session's warehouse (shared on a cluster)."""
    import uuid

    return f"{spark.conf.get('spark.sql.warehouse.dir')}/scratch-{name}-{uuid.uuid4().hex}"


@query(O.BOTH + " SELECT file_name, supplier_name, document_total_amount, document_date FROM pred")
def json_roundtrip(spark, sf_dir):
    path = _scratch(spark, "docs")
    json_docs.write_documents(X.pred_docs(spark, sf_dir).drop("k"), path)
    return json_docs.read_documents(spark, path).select("file_name", "supplier_name", "document_total_amount", "document_date")


@query(O.with_results(f"""SELECT 'run' AS level, 'alpha' AS key, wfes AS score, (SELECT count(DISTINCT file_name) FROM res) AS n FROM ({O.tiers(_RUN.format(by=''), '', 'wfes')})
  UNION ALL SELECT 'field', field_name, similarity_mean, n FROM ({O.metrics()})
  UNION ALL SELECT 'document', d.file_name, overall_score, exact FROM ({O.tiers(_EVERY_DOC, 'file_name')}) d JOIN (SELECT file_name, count(*) FILTER (grade = 'exact') AS exact FROM res GROUP BY 1) e ON e.file_name = d.file_name"""))
def report_export(spark, sf_dir):
    """The run's, fields' and documents' reports; the figures are read back from
    their JSON, for documents the number of exact fields."""
    report = score.run_report(_results(spark, sf_dir), model="alpha")
    j = lambda path: F.get_json_object("report", path)
    exact = F.size(F.filter(F.map_values(F.from_json(j("$.fields"), "map<string,struct<grade:string>>")), lambda x: x["grade"] == "exact"))
    value = F.coalesce(j("$.overall_weighted_score"), j("$.similarity_mean"), j("$.overall_score")).cast("double")
    return rounded(report.select("level", "key", value.alias("score"), F.when(F.col("level") == "document", exact).otherwise(F.coalesce(j("$.num_documents"), j("$.n")).cast("long")).alias("n")))


@query(O.with_results(f"SELECT res.file_name, overall_score, field_name, grade, round(similarity, 6) AS similarity FROM res JOIN ({O.tiers(_EVERY_DOC, 'file_name')}) d ON d.file_name = res.file_name", ("supplier_name", "document_date", "notes")))
def verbose_rows(spark, sf_dir):
    results = _results(spark, sf_dir, ("supplier_name", "document_date", "notes"))
    return rounded(score.verbose_rows(results, rounded(score.document_scores(results))))


@query("SELECT count(*) AS documents, count(*) FILTER (event_id % 19 <> 0) AS succeeded, count(*) FILTER (event_id % 19 = 0) AS failed, round(avg(value), 6) AS mean_seconds FROM events")
def run_timing(spark, sf_dir):
    rows = X.table(spark, sf_dir, "events").select(F.col("value").alias("seconds"), F.when(F.col("event_id") % 19 == 0, "failed").alias("error"))
    return rounded(score.run_timing(rows))


@query("SELECT 0.4e0 AS entity_f1, round(1e0 / 3, 6) AS anls, 2 AS fields")
def upload_evaluation(spark, sf_dir):
    """Posted documents, chosen by comma lists: one name is right, one is missed, a currency is wrong."""
    gt = json_docs.uploaded(spark, '[{"file_name": "a", "supplier_name": "Acme"}, {"file_name": "b", "supplier_name": "Best", "document_currency": "EUR"}]')
    pred = json_docs.uploaded(spark, '[{"file_name": "a", "supplier_name": "acme"}, {"file_name": "b", "supplier_name": null, "document_currency": "USD"}, {"file_name": "c"}]', "predictions")
    options = json_docs.upload_options("1,2", "supplier_name, document_currency", "entity_f1,anls")
    results = score.field_results(gt, pred, options["fields"], order="ordinal")
    made = score.standard_metrics(results).select(*options["metrics"])
    return rounded(made.join(results.agg(F.count_distinct("field_name").alias("fields"))))


def _files(spark, sf_dir):
    """Two-page files whose pages are what a model answers: JSON, fenced JSON,
    prose, or nothing."""
    gt = X.gt_docs(spark, sf_dir).where("supplier_name is not null")
    head = F.to_json(F.struct(F.col("supplier_name").alias("supplierName"), F.col("document_total_amount").alias("totalAmount"), F.array(F.struct(F.lit("Widget").alias("description"), F.lit(2.0).alias("quantity"), F.lit(1.5).alias("price"))).alias("lineItems")))
    prose = F.concat(F.lit("Supplier: Prose Ltd\nTotal Amount: "), F.format_string("%d.50", F.col("k") % 1000), F.lit("\n"))
    first = F.when(F.col("k") % 4 == 0, prose).when(F.col("k") % 4 == 1, F.concat(F.lit("```json\n"), head, F.lit("\n```"))).when(F.col("k") % 4 == 2, F.lit("   ")).otherwise(head)
    second = F.to_json(F.struct(F.col("document_currency").alias("currency"), F.array(F.struct(F.lit("Widget").alias("description"), F.lit(2.0).alias("quantity"), F.lit(1.5).alias("price")), F.struct(F.lit("Bolt").alias("description"), F.lit(1.0).alias("quantity"), F.lit(3.0).alias("price"))).alias("lineItems")))
    return gt.select("k", F.concat(F.lit("scans/"), "file_name", F.lit(".pdf")).alias("path"), F.concat(first, F.lit("\f"), second).cast("binary").alias("content"))


@query(O.BOTH + """ SELECT file_name || '.pdf' AS file_name, 2 AS pages, CASE WHEN k % 4 = 0 THEN 'parse_failed_recovered_via_regex_extraction' WHEN k % 4 = 2 THEN 'empty_answer' END AS error, CASE WHEN k % 4 = 0 THEN 'Prose Ltd' WHEN k % 4 <> 2 THEN supplier_name END AS supplier_name,
  round(CASE WHEN k % 4 = 0 THEN k % 1000 + 0.5 WHEN k % 4 = 2 THEN 0 ELSE document_total_amount END, 6) AS total, document_currency AS currency, 2 AS n_items, 'application/pdf' AS mime_type FROM gt WHERE supplier_name IS NOT NULL""")
def process_files(spark, sf_dir):
    """Files -> pages -> answers -> recovery -> merged documents, with the stand-in back end."""
    made = extract.process_files(_files(spark, sf_dir), extract.get_backend("stand_in"))
    return rounded(made.select("file_name", "pages", "error", "supplier_name", F.col("document_total_amount").alias("total"), F.col("document_currency").alias("currency"), F.size("line_items").alias("n_items"), "mime_type"))


@query(O.BOTH + " SELECT 'scans/' || file_name || '.pdf' AS path, 1 AS page_no, false AS failed FROM gt WHERE supplier_name IS NOT NULL AND k % 7 <> 0 UNION ALL SELECT 'scans/' || file_name || '.pdf', 1, true FROM gt WHERE supplier_name IS NOT NULL AND k % 7 = 0")
def page_split(spark, sf_dir):
    """At most one page a file; files that the splitter fails on stay as rows."""

    def cut(content: bytes, kind: str) -> list[bytes]:
        if not content:
            raise ValueError("empty file")
        return content.split(b"\f")

    files = _files(spark, sf_dir).withColumn("content", F.when(F.col("k") % 7 != 0, F.col("content")))
    return rounded(extract.split_pages(files, cut, 1).select("path", "page_no", F.col("error").isNotNull().alias("failed")))


_TEMPLATES = ", ".join(f"'{t}'" for t in pages.LAYOUTS)
_PAGE_LINES = " ".join(f"WHEN '{t}' THEN {3 + (2 if y.closing else 1) + int(y.subtotal) + (1 if y.tax != 'none' else 0)} + greatest(n, {y.least_rows})" for t, y in pages.LAYOUTS.items())


@query(f"{_ITEMS} SELECT file_name, [{_TEMPLATES}][k % {len(pages.LAYOUTS)} + 1] AS template, CASE [{_TEMPLATES}][k % {len(pages.LAYOUTS)} + 1] {_PAGE_LINES} END + 1 AS n_lines, 'TOTAL  €' || printf('%.2f', gross::DOUBLE) AS total FROM docs")
def page_text(spark, sf_dir):
    """Each document on one of the ten templates."""
    docs = render.template_context(X.item_docs(spark, sf_dir)).drop("payment_method")
    docs = docs.withColumn("template", F.get(F.array(*map(F.lit, pages.LAYOUTS)), (F.col("k") % len(pages.LAYOUTS)).cast("int")))
    made = pages.page_text(docs).withColumn("lines", F.split("text", "\n"))
    return rounded(made.select("file_name", "template", F.size("lines").alias("n_lines"), F.get(F.filter("lines", lambda x: x.startswith("TOTAL")), F.lit(0)).alias("total")))


@query("WITH t AS (SELECT CASE WHEN k % 5 = 0 THEN 'pos_thermal' WHEN k % 4 = 0 THEN 'formal_corporate' WHEN k % 4 = 1 THEN 'retail_receipt' WHEN k % 3 = 0 THEN 'pos_thermal' WHEN k % 2 = 0 THEN 'modern_minimal' ELSE 'formal_corporate' END AS template FROM (" + _KINDS.format(orders="orders") + ")) SELECT 'template' AS key, template AS value, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM t GROUP BY 2")
def template_counts(spark, sf_dir):
    return rounded(sampling.generation_summary(template_select(spark, sf_dir), ("template",)))


def _pictures(spark, sf_dir):
    """Small pages of text as images, one for each nation."""
    docs = X.table(spark, sf_dir, "nation").select(F.concat("n_name", F.lit(".png")).alias("file_name"), F.concat_ws("\n", F.col("n_name"), F.repeat(F.lit("row of text "), 5), F.lit("TOTAL 1.00")).alias("text"))
    return pages.rendered_pages(docs)


@query("SELECT condition, count(*) AS images, count(*) AS files, 0 AS failed FROM nation CROSS JOIN (VALUES ('clean'), ('bad_scan'), ('faded')) v(condition) GROUP BY 1")
def image_scan(spark, sf_dir):
    """Rendered pages under each condition, written as PNG files and found again."""
    path = _scratch(spark, "images")
    made = degrade.degrade_images(_pictures(spark, sf_dir), "file_name")
    written = publish.write_images(made, path).groupBy("condition").agg(F.count(F.lit(1)).alias("images"), F.count_if(F.col("error").isNotNull()).alias("failed")).collect()
    counts = spark.createDataFrame([tuple(r) for r in written], "condition string, images long, failed long")
    found = json_docs.scan_files(spark, path, content=False).where(F.col("mime_type") == "image/png").groupBy(F.element_at(F.split("path", "/"), -2).alias("condition")).agg(F.count(F.lit(1)).alias("files"))
    return counts.join(found, "condition")


@query(O.BOTH + " SELECT split, degradation, count(*) AS n FROM (SELECT CASE WHEN r < 70 THEN 'train' WHEN r < 80 THEN 'val' ELSE 'test' END AS split, k, r FROM (SELECT *, row_number() OVER (ORDER BY md5(file_name || '.png:42'), file_name) - 1 AS r FROM gt) WHERE r < 100) JOIN (VALUES ('clean'), ('faded')) v(degradation) ON v.degradation = 'clean' OR k % 6 <> 0 GROUP BY 1, 2")
def published_counts(spark, sf_dir):
    """Documents named like image files, written by split and condition and read back."""
    path = _scratch(spark, "published")
    docs = X.gt_docs(spark, sf_dir).withColumn("file_name", F.concat("file_name", F.lit(".png")))
    f = F.col("file_name")
    docs = docs.withColumn("degradation_variants", F.when(F.col("k") % 6 != 0, F.create_map(F.lit("clean"), f, F.lit("faded"), f)))
    publish.write_published(publish.metadata_rows(docs), sampling.fixed_split(docs, "file_name", 70, 10, 20), path)
    return publish.published_counts(spark.read.json(path))


@query("SELECT o_orderkey AS file_name, o_orderkey % 5 AS n_keys FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS r FROM orders) WHERE r <= 1000")
def limited_records(spark, sf_dir):
    """The first thousand of a written set of records, in file order."""
    path = _scratch(spark, "records")
    docs = X.table(spark, sf_dir, "orders").orderBy("o_orderkey").select(F.col("o_orderkey").cast("string").alias("file_name"), F.array_join(F.array_repeat(F.lit("x"), (F.col("o_orderkey") % 5).cast("int")), "").alias("notes"))
    docs.repartitionByRange(8, F.col("file_name").cast("long")).sortWithinPartitions(F.col("file_name").cast("long")).write.json(path)
    return rounded(json_docs.read_documents(spark, path, limit=1000).select(F.col("file_name").cast("long").alias("file_name"), F.length("notes").alias("n_keys")))


@query(O.BOTH + " SELECT CAST(count(DISTINCT field) AS BIGINT) AS fields, count(*) AS cells FROM (SELECT unnest(['supplier_name', 'document_date']) AS field, 'a' AS model FROM gt UNION ALL SELECT 'document_currency', 'b' FROM gt)")
def model_union(spark, sf_dir):
    gt = X.gt_docs(spark, sf_dir)
    a = gt.select(F.explode(F.array(F.lit("supplier_name"), F.lit("document_date"))).alias("field"))
    return X.union_all([a, gt.select(F.lit("document_currency").alias("field"))]).agg(F.count_distinct("field").alias("fields"), F.count(F.lit(1)).alias("cells"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
