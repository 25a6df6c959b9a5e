"""Operator 5, secret scans with multipart credential linking (native).

Patterns find parts of credentials in every text: labelled values, access
identifiers and hexadecimal keys are reported wherever they stand (the base
kinds).  Weaker parts - labelled identifiers, long mixed tokens, endpoints - are
reported only when their complement stands in the same scope: a token needs an
identifier nearby, an identifier needs a secret nearby, an endpoint needs both.
A complement never overlaps what it completes, so a value that is written once
is not its own second part.

The link is an interval join by sweep inside the row: the ends of possible
complements and the starts of candidates are sorted together, and a running
maximum over that order tells each candidate the nearest complement before it
(and, on negated places, after it).  Nothing is paired with everything, and
neither texts nor parts are shuffled.  Running values are built by doubling
steps, so a text of n matches costs n log n and no list is copied per match.

All positions are code points, end exclusive.  Positions come from the running
sum of the lengths of matches and of what lies between them (a split on the same
pattern), since the regular-expression functions return no offsets.

Only DataFrame functions are used; there is no Python on the executors.

Defined results: null text is an empty text and has no parts (``redact`` keeps
it null); repeated rows get equal answers; null ids are kept; extra columns are
ignored (or carried, by ``redact``, whatever their names); an empty table gives
an empty table; a very long text is one row's work.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import documents

#: Kinds in report order; the first three are the base.
KINDS = ("assign", "access", "hex", "ident", "secret", "endpoint")

_VALUE = r"[A-Za-z0-9+/_.=-]"
_ASSIGN = rf"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?({_VALUE}+)"""
_PATTERN = {
    "access": r"AKIA[A-Z0-9]{14,}",
    "hex": r"[0-9a-f]{16,}",
    "ident": rf"""(?i:access_?key_?id|client_?id|account_?id|user_?name|login)["']?\x20*[:=]\x20*["']?{_VALUE}{{4,}}""",
    "secret": r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[a-z0-9+/_-]*+[A-Z])(?=[A-Z0-9+/_-]*+[a-z])[A-Za-z0-9+/_-]{32,}+={0,2}(?![A-Za-z0-9+/_=-])",
    "endpoint": r"""(?i:https?|ftp|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[A-Za-z0-9._~:/?#@!$&*+,;=%-]{4,}""",
}


_BASE = 3  # kinds below this number are the base
_PARTS = "array<struct<start:bigint,kind:int,end:bigint>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body uses it."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def _running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Each element combined with all before it: after round k an element covers
    the 2**(k + 1) elements that end with it."""

    def rounds(all_: Column) -> Column:
        def double(now: Column, k: Column) -> Column:
            return F.transform(now, lambda x, i: combine(x, F.get(now, i - F.pow(F.lit(2), k).cast("int"))))

        last = F.floor(F.log2(F.size(all_) - 1)).cast("int")
        return F.when(F.size(all_) < 2, all_).otherwise(F.aggregate(F.sequence(F.lit(0), last), all_, double))

    return _let(values, rounds)


def _sums(values: Column) -> Column:
    return _running(values, lambda x, before: x + F.coalesce(before, F.lit(0).cast("long")))


def _greatest(values: Column) -> Column:
    """Running maximum; nulls are skipped."""
    return _running(values, F.greatest)


def _is(*kinds: str) -> Callable[[Column], Column]:
    numbers = [KINDS.index(k) for k in kinds]
    return lambda p: p["kind"].isin(*numbers)


def _located(text: Column, kind: str, pattern: str) -> Column:
    """The parts of one kind in a text, by start."""
    none = F.array().cast(_PARTS)

    def placed(matches: Column) -> Column:
        def parts(gaps: Column) -> Column:
            reach = F.transform(matches, lambda m, i: (F.length(F.get(gaps, i)) + F.length(m)).cast("long"))
            return _let(_sums(reach), lambda ends: F.transform(matches, lambda m, i: part(m, F.get(ends, i))))

        def part(m: Column, end: Column) -> Column:
            return F.struct((end - F.length(m)).alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.alias("end"), good(m).alias("good"))

        found = F.filter(_let(F.split(text, pattern, -1), parts), lambda p: p["good"])
        # A text is split again only where the pattern matched at all.
        return F.when(F.size(matches) == 0, none).otherwise(F.transform(found, lambda p: F.struct(p["start"].alias("start"), p["kind"].alias("kind"), p["end"].alias("end"))))

    def good(m: Column) -> Column:
        return F.length(F.regexp_extract(m, _ASSIGN, 1)) >= 12 if kind == "assign" else F.lit(True)

    return _let(F.regexp_extract_all(text, F.lit(pattern), 0), placed)


def _distance_back(places: Column, asked: Column) -> Column:
    """For each asked place the distance to the nearest of places at or before
    it, null if there is none: one sort of both, one running maximum."""
    known = F.transform(places, lambda p: F.struct(p.alias("at"), F.lit(0).alias("turn")))
    asks = F.transform(asked, lambda q, i: F.struct(q.alias("at"), (i + 1).alias("turn")))

    def answered(events: Column) -> Column:
        seen = _greatest(F.transform(events, lambda e: F.when(e["turn"] == 0, e["at"])))
        gaps = _let(seen, lambda s: F.transform(events, lambda e, i: F.struct(e["turn"].alias("turn"), (e["at"] - F.get(s, i)).alias("gap"))))
        return F.transform(F.sort_array(F.filter(gaps, lambda g: g["turn"] > 0)), lambda g: g["gap"])

    return _let(F.sort_array(F.concat(known, asks)), answered)


def _linked(parts: Column, reach: int) -> Column:
    """The parts to report, of all parts of a text by start and kind: the base,
    and weak ones that overlap no base part and have their complement."""

    def without_values(all_: Column) -> Column:
        # A token that is the value of a labelled identifier is that identifier.
        labels = _greatest(F.transform(all_, lambda p: F.when(_is("ident")(p), p["end"])))
        return _let(labels, lambda ends: F.filter(all_, lambda p, i: ~(_is("secret")(p) & F.coalesce(F.get(ends, i) > p["start"], F.lit(False)))))

    def alone(all_: Column) -> Column:
        """The weak parts that overlap no base part."""
        is_base = lambda p: p["kind"] < _BASE
        before = _greatest(F.transform(all_, lambda p: F.when(is_base(p), p["end"])))
        after = F.reverse(_greatest(F.reverse(F.transform(all_, lambda p: F.when(is_base(p), -p["start"])))))
        apart = lambda p, e, s: F.coalesce(e <= p["start"], F.lit(True)) & F.coalesce(-s >= p["end"], F.lit(True))
        return _let(before, lambda ends: _let(after, lambda starts: F.filter(all_, lambda p, i: (p["kind"] >= _BASE) & apart(p, F.get(ends, i), F.get(starts, i)))))

    def complete(all_: Column, weak: Column) -> Column:
        def near(is_one: Callable[[Column], Column]) -> Column:
            """Whether each weak part has one of the group within reach."""
            group = F.filter(all_, is_one)
            back = _distance_back(F.transform(group, lambda p: p["end"]), F.transform(weak, lambda p: p["start"]))
            ahead = _distance_back(F.transform(group, lambda p: -p["start"]), F.transform(weak, lambda p: -p["end"]))
            return F.zip_with(back, ahead, lambda b, a: F.coalesce(F.least(b, a) <= reach, F.lit(False)))

        def met(names: Column, secrets: Column) -> Column:
            linked = lambda p, n, s: F.when(_is("ident")(p), s).when(_is("secret")(p), n).otherwise(n & s)
            return F.filter(weak, lambda p, i: linked(p, F.get(names, i), F.get(secrets, i)))

        return _let(near(_is("access", "ident")), lambda names: _let(near(_is("assign", "hex", "secret")), lambda secrets: met(names, secrets)))

    def reported(all_: Column) -> Column:
        base = F.filter(all_, lambda p: p["kind"] < _BASE)
        found = _let(alone(all_), lambda weak: F.when(F.size(weak) == 0, F.array().cast(_PARTS)).otherwise(complete(all_, weak)))
        return F.when(F.size(base) == F.size(all_), all_).otherwise(F.sort_array(F.concat(base, found)))

    return _let(parts, lambda p: F.when(F.size(p) == 0, p).otherwise(_let(without_values(p), reported)))


def credential_spans(text: Column, reach: int = 200) -> Column:
    """The reported parts of a text by start, then kind: structs (start, kind,
    end), kind being a place in KINDS."""
    whole = F.coalesce(text, F.lit(""))
    return _linked(F.sort_array(F.concat(*(_located(whole, k, p) for k, p in ({"assign": _ASSIGN} | _PATTERN).items()))), reach)


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = 200) -> DataFrame:
    """(id, spans) for each row of docs: its reported parts."""
    return docs.select(id_col, credential_spans(F.col(text_col), reach).alias("spans"))


def redacted(text: Column, mark: str = "[SECRET]", reach: int = 200) -> Column:
    """The text with every reported span replaced by mark; overlapping spans are
    replaced as one."""

    def cut(spans: Column) -> Column:
        """Structs (after, until): what stays between the spans."""

        def kept(reached: Column) -> Column:
            heads = F.transform(spans, lambda s, i: F.struct(F.coalesce(F.get(reached, i - 1), F.lit(0).cast("long")).alias("after"), s["start"].alias("until")))
            return F.concat(F.filter(heads, lambda h: h["after"] <= h["until"]), F.array(F.struct(F.element_at(reached, -1).alias("after"), F.length(text).cast("long").alias("until"))))

        return _let(_greatest(F.transform(spans, lambda s: s["end"])), kept)

    def pieces(spans: Column) -> Column:
        # Four bytes a code point: a piece is cut without walking the text.
        wide = lambda code: F.transform(cut(spans), lambda c: F.decode(F.substr(code, (4 * c["after"] + 1).cast("int"), (4 * (c["until"] - c["after"])).cast("int")), "UTF-32"))
        return F.when(F.size(spans) == 0, text).otherwise(F.array_join(_let(F.encode(text, "UTF-32"), wide), mark))

    return F.when(text.isNull(), text).otherwise(_let(credential_spans(text, reach), pieces))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]", reach: int = 200) -> DataFrame:
    """docs with every reported span replaced by mark; all other columns stay."""
    return docs.select(*(redacted(docs[c], mark, reach).alias(c) if c == text_col else docs[c] for c in docs.columns))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = secret_spans(documents(spark, sf_dir))
    counts = [F.size(F.filter("spans", _is(k))).cast("long").alias(f"n_{k}") for k in KINDS[:_BASE]]
    base = F.filter("spans", lambda s: s["kind"] < _BASE)
    return spans.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
