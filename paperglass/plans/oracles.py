"""SQL builders for the checks: the comparisons again, as plain SQL."""

from __future__ import annotations

from collections.abc import Callable

from .fixtures import GT_SQL, LINES_SQL, PRED_SQL, registry_rows
from .registry import GRADES, ITEM_FIELDS, TIER_WEIGHTS, Field

GT = GT_SQL.format(orders="orders", customer="customer")
BOTH = f"WITH gt AS ({GT}), pred AS ({PRED_SQL})"
LINES = LINES_SQL.format(lineitem="lineitem")


def text(x: str) -> str:
    return rf"nullif(trim(regexp_replace(lower(trim({x})), '\s+', ' ', 'g'), '.,;:!? '), '')"


def ident(x: str) -> str:
    return f"regexp_replace({text(x)}, '[^a-z0-9]', '', 'g')"


def is_null(x: str) -> str:
    return f"({x} IS NULL OR lower(trim({x})) IN ('', 'null', 'none', 'n/a', 'na', '-', '--'))"


def lev(a: str, b: str) -> str:
    return f"(CASE WHEN {a} IS NULL AND {b} IS NULL THEN 1e0 WHEN {a} IS NULL OR {b} IS NULL THEN 0e0 WHEN {a} = {b} THEN 1e0 ELSE 1e0 - levenshtein({a}, {b}) / greatest(length({a}), length({b})) END)"


def token_f1(a: str, b: str) -> str:
    g, p = (f"list_distinct(list_filter(coalesce(string_split({x}, ' '), []), lambda t: t <> ''))" for x in (a, b))
    return f"(CASE WHEN len({g}) = 0 AND len({p}) = 0 THEN 1e0 WHEN len({g}) = 0 OR len({p}) = 0 THEN 0e0 ELSE 2e0 * len(list_intersect({g}, {p})) / (len({g}) + len({p})) END)"


def plain_float(x: str) -> str:
    return rf"(CASE WHEN regexp_full_match(trim({x}), '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') THEN TRY_CAST(trim({x}) AS DOUBLE) END)"


def number(x: str) -> str:
    bare = rf"trim(replace(trim(regexp_replace(regexp_replace(trim({x}), '[€$£¥]', '', 'g'), '(?i)^\s*(EUR|USD|GBP|CHF|JPY|CAD|AUD)\s*', '')), '%', ''))"
    tail = lambda sep: f"(length({bare}) - length(regexp_replace({bare}, '^.*[{sep}]', '')))"
    plain = f"""(CASE WHEN contains({bare}, ',') AND contains({bare}, '.') THEN CASE WHEN {tail(',')} > {tail('.')} THEN replace(replace({bare}, '.', ''), ',', '.') ELSE replace({bare}, ',', '') END
      WHEN contains({bare}, ',') AND len(string_split({bare}, ',')) = 2 AND length(string_split({bare}, ',')[2]) <= 2 THEN replace({bare}, ',', '.') ELSE replace({bare}, ',', '') END)"""
    return f"coalesce({plain_float(plain)}, {plain_float(f'nullif(regexp_extract({plain}, {chr(39)}[0-9.]+{chr(39)}), {chr(39)}{chr(39)})')})"


def date(x: str) -> str:
    """The notations that the derived predictions use."""
    return f"""coalesce(TRY_CAST(CASE WHEN regexp_full_match({x}, '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN {x} END AS DATE),
      TRY_CAST(CASE WHEN regexp_full_match({x}, '\\d{{2}}/\\d{{2}}/\\d{{4}}') THEN substr({x}, 7, 4) || '-' || substr({x}, 4, 2) || '-' || substr({x}, 1, 2) END AS DATE),
      TRY_CAST(CASE WHEN regexp_full_match({x}, '\\d{{2}}/\\d{{2}}/\\d{{4}}') THEN substr({x}, 7, 4) || '-' || substr({x}, 1, 2) || '-' || substr({x}, 4, 2) END AS DATE))"""


def time(x: str) -> str:
    return f"(CASE WHEN regexp_full_match({x}, '\\d{{2}}:\\d{{2}}(:\\d{{2}})?') THEN substr({x}, 1, 5) ELSE upper(trim({x})) END)"


_KEY = {"emails": r"[\w.+-]+@[\w-]+\.[\w.-]+", "dates": r"\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}", "phones": r"[\+]?[\d\s\-()]{7,}"}


def key_recall(g: str, p: str) -> str:
    """Over the kinds that the derived notes hold."""
    plain = lambda x, k: f"list_transform(list_distinct(regexp_extract_all(coalesce({x}, ''), '{_KEY[k]}')), lambda y: coalesce({text('y')}, ''))"
    found = " + ".join(f"len(list_filter({plain(g, k)}, lambda a: len(list_filter({plain(p, k)}, lambda b: contains(a, b) OR contains(b, a))) > 0))" for k in _KEY)
    total = " + ".join(f"len({plain(g, k)})" for k in _KEY)
    return f"(CASE WHEN {total} = 0 THEN 1e0 ELSE ({found}) / ({total}) END)"


def _grade(score: str, f: Field) -> str:
    return f"CASE WHEN {score} >= {f.exact_from} THEN 'exact' WHEN {score} >= {f.acceptable_from} THEN 'acceptable' WHEN {score} >= {f.partial_from} THEN 'partial' ELSE 'wrong' END"


def _field(f: Field, source: str) -> str:
    """One field's rows: file_name, field_name, field_type, tier, weight,
    null_status, exact_match, similarity, levenshtein, grade."""
    head = f"file_name, '{f.name}' AS field_name, '{f.kind}' AS field_type, {f.tier} AS tier, CAST({f.weight} AS DOUBLE) AS weight"
    null = (lambda x: f"({x} IS NULL)") if f.kind == "numeric" else is_null
    status = f"CASE WHEN {null('g')} AND {null('p')} THEN 'tn' WHEN {null('g')} THEN 'fp' WHEN {null('p')} THEN 'fn' ELSE 'tp' END"
    pair = f"(SELECT g.file_name, g.{f.name} AS g, p.{f.name} AS p FROM gt g JOIN {source} p ON g.file_name = p.file_name)"
    lev_sql = "CAST(NULL AS DOUBLE)"
    if f.kind == "numeric":
        inner = pair
        rel = "CASE WHEN g = 0 THEN CASE WHEN p = 0 THEN 0e0 END ELSE abs(g - p) / abs(g) END"
        exact = f"CASE WHEN abs(g - p) <= {f.tolerance} THEN 1e0 ELSE 0e0 END"
        sim = f"CASE WHEN abs(g - p) <= {f.tolerance} THEN 1e0 WHEN {rel} < 1 THEN 1e0 - {rel} ELSE 0e0 END"
        grade = f"CASE WHEN abs(g - p) <= {f.tolerance} THEN 'exact' WHEN abs(g - p) <= 0.05 OR coalesce({rel} < 0.05, false) THEN 'acceptable' WHEN {rel} < 0.20 THEN 'partial' ELSE 'wrong' END"
    elif f.kind == "date":
        inner = f"(SELECT *, {date('g')} AS a, {date('p')} AS b FROM {pair})"
        right = "(CAST(year(a) = year(b) AS INT) + CAST(month(a) = month(b) AS INT) + CAST(day(a) = day(b) AS INT))"
        swap = "(year(a) = year(b) AND month(a) = day(b) AND day(a) = month(b) AND month(a) <> day(a))"
        exact = "CASE WHEN a = b THEN 1e0 ELSE 0e0 END"
        sim = f"CASE WHEN a IS NULL OR b IS NULL THEN 0e0 WHEN a = b THEN 1e0 WHEN {swap} THEN 0.5e0 ELSE {right} / 3e0 END"
        grade = f"CASE WHEN a IS NULL OR b IS NULL THEN 'wrong' WHEN a = b THEN 'exact' WHEN {swap} OR {right} >= 2 THEN 'partial' ELSE 'wrong' END"
    elif f.kind == "time":
        inner = f"(SELECT *, {lev(text('a'), text('b'))} AS l FROM (SELECT *, {time('g')} AS a, {time('p')} AS b FROM {pair}))"
        exact, sim = "CASE WHEN a = b THEN 1e0 ELSE 0e0 END", "CASE WHEN a = b THEN 1e0 ELSE l END"
        grade = "CASE WHEN a = b THEN 'exact' WHEN l > 0.5 THEN 'partial' ELSE 'wrong' END"
    else:
        inner = f"(SELECT *, {lev('a', 'b')} AS l, {token_f1('a', 'b')} AS t FROM (SELECT *, {text('g')} AS a, {text('p')} AS b, {ident('g')} AS ai, {ident('p')} AS bi FROM {pair}))"
        same = "a IS NOT DISTINCT FROM b"
        exact = f"CASE WHEN {same} THEN 1e0 ELSE 0e0 END"
        loose = "(ai <> '' AND ai = bi)" if f.kind in ("short_string", "category") else "false"
        score = {"short_string": "greatest(l, t)", "category": "CASE WHEN l >= 0.8 THEN 0.7e0 ELSE 0e0 END", "medium_string": "t", "long_text": f"(0.5e0 * t + 0.5e0 * {key_recall('g', 'p')})"}[f.kind]
        sim = f"CASE WHEN {same} OR {loose} THEN 1e0 ELSE {score} END"
        graded = "CASE WHEN l >= 0.8 THEN 'partial' ELSE 'wrong' END" if f.kind == "category" else _grade(score, f)
        grade = f"CASE WHEN {same} OR {loose} THEN 'exact' ELSE {graded} END"
        if f.kind != "long_text":
            lev_sql = f"CASE WHEN s = 'tp' AND NOT ({same} OR {loose}) THEN l END"
    return f"""SELECT {head}, s AS null_status,
      CASE s WHEN 'tn' THEN 1e0 WHEN 'tp' THEN {exact} ELSE 0e0 END AS exact_match, CASE s WHEN 'tn' THEN 1e0 WHEN 'tp' THEN {sim} ELSE 0e0 END AS similarity, {lev_sql} AS levenshtein,
      CASE s WHEN 'tn' THEN 'null_match' WHEN 'fp' THEN 'hallucination' WHEN 'fn' THEN 'miss' ELSE {grade} END AS grade
    FROM (SELECT *, {status} AS s FROM {inner})"""


def results(names: tuple[str, ...] | None = None, source: str = "pred") -> str:
    fields = [f for f in registry_rows() if names is None or f.name in names]
    return " UNION ALL ".join(_field(f, source) for f in fields)


def with_results(body: str, names: tuple[str, ...] | None = None) -> str:
    return f"{BOTH}, res AS ({results(names)}) {body}"


#: The three models' predictions as views over pred.
MODEL_VIEWS = ", ".join(
    f"pred_{m} AS (SELECT * REPLACE (CASE WHEN k % {n} <> 0 THEN supplier_name END AS supplier_name, CASE WHEN k % {n + 1} <> 0 THEN document_currency END AS document_currency) FROM pred)" if n else f"pred_{m} AS (SELECT * FROM pred)"
    for m, n in (("alpha", 0), ("beta", 4), ("gamma", 10))
)


def with_models(body: str, names: tuple[str, ...]) -> str:
    every = " UNION ALL ".join(f"SELECT '{m}' AS model, * FROM ({results(names, f'pred_{m}')})" for m in ("alpha", "beta", "gamma"))
    return f"{BOTH}, {MODEL_VIEWS}, res AS ({every}) {body}"


def metrics(by: str = "") -> str:
    """Select of the field metrics over res."""
    lead = f"{by}, " if by else ""
    real = "null_status <> 'tn'"
    r = lambda x: f"round({x}, 6)"
    share = lambda c, t: r(f"CASE WHEN {t} > 0 THEN count(*) FILTER ({c}) / {t} ELSE 0e0 END")
    seen = f"count(*) FILTER ({real})"
    cols = [f"count(*) AS n, {seen} AS n_evaluated"]
    cols += [f"{r(f'coalesce({fn}({c}) FILTER ({real}), 0e0)')} AS {a}" for fn, c, a in (("avg", "exact_match", "exact_match"), ("avg", "similarity", "similarity_mean"), ("min", "similarity", "similarity_min"), ("max", "similarity", "similarity_max"))]
    cols += [f"count(*) FILTER (null_status = '{s}') AS {s}" for s in ("tp", "tn", "fp", "fn")]
    cols += [f"{share(c, 'count(*)')} AS {a}" for c, a in (("null_status IN ('tp', 'tn')", "presence_rate"), ("null_status = 'fp'", "hallucination_rate"), ("null_status = 'fn'", "miss_rate"), ("null_status = 'tn'", "tn_rate"))]
    both = f"{real} AND grade = "
    cols += [share(both + "'" + g + "'", seen) + f" AS grade_{g}" for g in GRADES[:4]]
    cols += [share("grade = '" + g + "'", "count(*)") + f" AS grade_{g}" for g in GRADES[4:]]
    return f"SELECT {lead}field_name, any_value(field_type) AS field_type, any_value(tier) AS tier, any_value(weight) AS weight, {', '.join(cols)} FROM res GROUP BY {lead}field_name"


def tiers(source: str, by: str, total: str = "overall_score") -> str:
    """Tier and overall scores from rows (by, tier, score, weight)."""
    lead = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    sums = ", ".join(f"sum(score * weight) FILTER (tier = {t}) / sum(weight) FILTER (tier = {t}) AS t{t}" for t in TIER_WEIGHTS)
    top = " + ".join(f"coalesce({w} * t{t}, 0e0)" for t, w in TIER_WEIGHTS.items())
    bottom = " + ".join(f"CASE WHEN t{t} IS NULL THEN 0e0 ELSE {w} END" for t, w in TIER_WEIGHTS.items())
    parts = ", ".join(f"round(coalesce(t{t}, 0e0), 6) AS tier{t}_score" for t in TIER_WEIGHTS)
    return f"SELECT {lead}{parts}, round(CASE WHEN {bottom} > 0 THEN ({top}) / ({bottom}) ELSE 0e0 END, 6) AS {total} FROM (SELECT {lead}{sums} FROM ({source}) {group})"


def entity(by: str = "") -> str:
    lead = f"{by}, " if by else ""
    sets = f"GROUPING SETS (({lead}field_name), ({by}))"
    counted = f"SELECT {lead}field_name, count(*) FILTER (null_status = 'tp' AND exact_match >= 1) AS tp, count(*) FILTER (null_status = 'fp' OR (null_status = 'tp' AND exact_match < 1)) AS fp, count(*) FILTER (null_status = 'fn' OR (null_status = 'tp' AND exact_match < 1)) AS fn FROM res GROUP BY {sets}"
    ratio = lambda a, b: f"round(CASE WHEN {a} + {b} > 0 THEN {a} / ({a} + {b}) ELSE 0e0 END, 6)"
    return f"SELECT {lead}field_name, tp, fp, fn, {ratio('tp', 'fp')} AS precision, {ratio('tp', 'fn')} AS recall, round(CASE WHEN tp > 0 THEN 2e0 * tp / (2e0 * tp + fp + fn) ELSE 0e0 END, 6) AS f1 FROM ({counted})"


def anls(by: str = "", threshold: float = 0.5) -> str:
    lead = f"{by}, " if by else ""
    value = "CASE WHEN field_type IN ('numeric', 'date') THEN similarity ELSE coalesce(levenshtein, similarity) END"
    score = f"CASE WHEN null_status = 'tn' THEN NULL WHEN null_status <> 'tp' THEN 0e0 WHEN {value} >= {threshold} THEN {value} ELSE 0e0 END"
    return f"SELECT {lead}field_name, round(coalesce(avg(s), 0e0), 6) AS anls, count(s) AS n, count(*) FILTER (null_status = 'tn') AS tn_skipped FROM (SELECT *, {score} AS s FROM res) GROUP BY GROUPING SETS (({lead}field_name), ({by}))"


#: Line items of the true and predicted documents, each with its place in the list.
ITEMS = f"""l AS ({LINES}), size AS (SELECT k, count(*) AS n FROM l GROUP BY k),
  gi AS (SELECT k, line AS g, description, quantity::DOUBLE AS quantity, unit_price::DOUBLE AS unit_price, amount::DOUBLE AS amount, tax_rate, tax_amount::DOUBLE AS tax_amount FROM l WHERE k % 19 <> 0),
  pi AS (SELECT k, CASE WHEN k % 4 <> 0 AND k % 9 = 0 THEN n + 1 - line ELSE line END AS p, CASE WHEN k % 7 = 0 THEN upper(description) ELSE description END AS description, quantity::DOUBLE AS quantity,
    unit_price::DOUBLE AS unit_price, amount::DOUBLE + CASE WHEN k % 5 = 0 THEN 0.5 ELSE 0 END AS amount, tax_rate, tax_amount::DOUBLE AS tax_amount FROM l JOIN size USING (k) WHERE k % 19 <> 0 AND k % 23 <> 0 AND (k % 4 <> 0 OR line < n))"""


def first_fit(flat: Callable[[str], str]) -> str:
    """f1 of pairing each predicted item, in order, with the first free true one."""
    like = f"(({flat('x.description')} = y.flat) OR (length({flat('x.description')}) > 3 AND (contains(y.flat, {flat('x.description')}) OR contains({flat('x.description')}, y.flat)))) AND abs(x.amount - y.amount) <= 0.05"
    return f"""WITH RECURSIVE {ITEMS}, gl AS (SELECT k, count(*) AS n FROM gi GROUP BY k), pl AS (SELECT k, count(*) AS n FROM pi GROUP BY k),
      fits AS (SELECT x.k, x.p, list(y.g ORDER BY y.g) AS free FROM pi x JOIN (SELECT *, {flat('description')} AS flat FROM gi) y ON x.k = y.k AND {like} GROUP BY x.k, x.p),
      walk(k, p, used) AS (SELECT k, 0::BIGINT, []::BIGINT[] FROM pl UNION ALL
        SELECT w.k, w.p + 1, CASE WHEN len(list_filter(coalesce(f.free, []), lambda j: NOT list_contains(w.used, j))) > 0 THEN list_append(w.used, list_filter(f.free, lambda j: NOT list_contains(w.used, j))[1]) ELSE w.used END
        FROM walk w JOIN pl ON pl.k = w.k AND w.p < pl.n LEFT JOIN fits f ON f.k = w.k AND f.p = w.p + 1),
      done AS (SELECT w.k, len(w.used) AS hits FROM walk w JOIN pl ON pl.k = w.k AND w.p = pl.n)
      SELECT 'doc_' || CAST(gl.k AS STRING) AS file_name, round(CASE WHEN pl.n IS NULL THEN 0e0 ELSE 2e0 * hits / (gl.n + pl.n) END, 6) AS f1 FROM gl LEFT JOIN pl USING (k) LEFT JOIN done USING (k)"""


def _pair_scores() -> str:
    numeric = lambda f: f"CASE WHEN abs(x.{f} - y.{f}) <= 0.02 THEN 1e0 ELSE 0e0 END AS s_{f}"
    string = lambda f: f"greatest({token_f1(text(f'x.{f}'), text(f'y.{f}'))}, {lev(text(f'x.{f}'), text(f'y.{f}'))}) AS s_{f}"
    return ", ".join(numeric(f) if kind == "numeric" else string(f) for f, kind, _ in ITEM_FIELDS)


def best_assignment(body: str, more: str = "") -> str:
    """body over item (k, file_name and the result columns of the best one-to-one
    assignment), found by walking all sets of taken predicted items."""
    said = f"greatest({token_f1(text('x.description'), text('y.description'))}, {lev(text('x.description'), text('y.description'))})"
    off = "abs(x.amount - y.amount) / abs(x.amount)"
    paid = f"CASE WHEN abs(x.amount - y.amount) <= 0.02 THEN 1e0 WHEN x.amount <> 0 AND {off} < 0.5 THEN 1e0 - {off} ELSE 0e0 END"
    weight = sum(w for *_, w in ITEM_FIELDS)
    quality = "(" + " + ".join(f"{w} * s_{f}" for f, _, w in ITEM_FIELDS) + f") / {weight}"
    means = ", ".join(f"avg(s_{f}) AS {f}" for f, *_ in ITEM_FIELDS)
    pick = lambda none_said, value: f"CASE WHEN np IS NULL THEN {none_said} ELSE {value} END"
    return f"""WITH RECURSIVE {more}{ITEMS}, gl AS (SELECT k, count(*) AS ng FROM gi GROUP BY k), pl AS (SELECT k, count(*) AS np FROM pi GROUP BY k),
      likely AS (SELECT x.k, x.g, y.p, 0.6e0 * {said} + 0.4e0 * ({paid}) AS sim, {_pair_scores()} FROM gi x JOIN pi y ON x.k = y.k),
      walk(k, g, mask, total, pairs) AS (SELECT k, 0::BIGINT, 0::BIGINT, 0e0, []::BIGINT[] FROM pl UNION ALL
        SELECT k, g, mask, max(total), max_by(pairs, total) FROM (
          SELECT w.k, w.g + 1 AS g, w.mask | (1::BIGINT << CAST(s.p AS INT)) AS mask, w.total + s.sim AS total, list_append(w.pairs, s.p) AS pairs FROM walk w JOIN likely s ON s.k = w.k AND s.g = w.g + 1 AND (w.mask >> CAST(s.p AS INT)) & 1 = 0
          UNION ALL SELECT w.k, w.g + 1, w.mask, w.total, list_append(w.pairs, 0) FROM walk w JOIN gl ON gl.k = w.k AND w.g < gl.ng JOIN pl ON pl.k = w.k AND pl.np < gl.ng) GROUP BY k, g, mask),
      best AS (SELECT w.k, max_by(w.pairs, w.total) AS pairs FROM walk w JOIN gl ON gl.k = w.k AND w.g = gl.ng GROUP BY w.k),
      taken AS (SELECT s.* FROM (SELECT k, unnest(pairs) AS p, generate_subscripts(pairs, 1) AS g FROM best) b JOIN likely s ON s.k = b.k AND s.g = b.g AND s.p = b.p WHERE s.sim >= 0.3),
      scored AS (SELECT k, count(*) AS n, avg({quality}) AS quality, {means} FROM taken GROUP BY k),
      item AS (SELECT gl.k, 'doc_' || CAST(gl.k AS STRING) AS file_name, ng AS gt_count, coalesce(np, 0) AS pred_count, {pick('0e0', '1e0 - abs(ng - np) / greatest(ng, np)')} AS count_accuracy, {pick('1e0', 'coalesce(n, 0) / np')} AS "precision",
        {pick('0e0', 'coalesce(n, 0) / ng')} AS recall, {pick('0e0', '2e0 * coalesce(n, 0) / (ng + np)')} AS f1, {pick('0e0', 'coalesce(2e0 * n / (ng + np) * quality, 0e0)')} AS overall, {', '.join(f for f, *_ in ITEM_FIELDS)}
        FROM gl LEFT JOIN pl USING (k) LEFT JOIN scored USING (k)) {body}"""
