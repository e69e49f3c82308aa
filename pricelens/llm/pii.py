"""Personal data: patterns propose spans, checksums confirm them, context adjusts their score.

Everything is a column expression (regular expressions and array functions in
the JVM); no row leaves it. A kind's matches and the gaps between them come
from one pattern, so a match's place is the sum of the lengths before it.

Base kinds (email, ip, card, phone) stay whatever their score. Further kinds -
IBAN (mod-97), social security numbers, keys and tokens - are proposed by a
pattern, and a span is taken if its score, its kind's start value plus what its
checksum and the context words nearby add, reaches the threshold.

Patterns use possessive repeats and start only where a run starts (or where the
last match ended), which gives the same leftmost matches in time proportional
to the text, however long a run is.

Cases: a null text counts as empty; places are code points, ends exclusive;
whole texts are searched; spans of different kinds may overlap; when texts are
masked, overlapping spans become one and its first kind names it; an empty
table gives an empty result; other columns are not touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelens.llm.common import column, free_name

BASE_KINDS = ("email", "ip", "card", "phone")
EXTRA_KINDS = ("iban", "ssn", "secret")
THRESHOLD = 0.6

#: Lengths of the countries' IBANs. Others are taken as far as their run of capitals and digits goes.
_IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}
_IBAN = ("(?=[A-Z]{2}[0-9]{2})(?:" + "|".join(rf"(?:{'|'.join(c.split())})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, c in _IBAN_LENGTHS.items())
         + ")(?![A-Za-z0-9])")

#: The base patterns, written without backtracking.
_PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": rf"(?<![A-Za-z0-9])(?:{_IBAN}|[A-Z]{{2}}[0-9]{{2}}(?:(?!\x20{_IBAN})\x20?[A-Z0-9]){{11,30}}(?![A-Za-z0-9]))",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "secret": r"(?<![A-Za-z0-9])(?:AKIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|(?i:password|passwd|token|secret|api_key)\x20?[=:]\x20?\"?[A-Za-z0-9_/+-]{12,}+)",
}
#: A kind is looked for only in texts that hold this.
_NEEDS = {"email": "@", "phone": "+", "ssn": "-"}
#: Scores before context, and what a confirmed checksum adds.
_START = {"iban": 0.2, "ssn": 0.4, "secret": 0.7}
_CHECKED = 0.6
#: Words within this many characters of a span that add to or take from its score: those that add, before or after
#: it in the text; those that take, only between the match before it and the span.
_NEAR = 40
_CONTEXT = {
    "iban": (r"(?i)\b(?:iban|account|konto|cuenta|compte|bank|transfer)\b", 0.2),
    "ssn": (r"(?i)\b(?:ssn|social security|tax id|taxpayer)\b", 0.4),
    "secret": (r"(?i)\b(?:example|placeholder|dummy|sample)\b", -0.3),
}

#: Items of a run that is built up element by element; longer arrays are built of such runs.
_RUN = 256


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def scan(items: Column, zero: Column, step, emit, kind: str) -> Column:
    """array<kind> of ``emit(state, item)``, with the state before each item.

    Appending to an array copies it, so runs of ``_RUN`` items are built apart
    and put together once: the cost grows with the number of items, not its square.
    """
    def run(state: Column, some: Column) -> Column:
        begin = F.struct(state.alias("state"), F.array().cast(f"array<{kind}>").alias("out"))
        return F.aggregate(some, begin, lambda acc, x: F.struct(step(acc["state"], x).alias("state"),
                                                                F.concat(acc["out"], F.array(emit(acc["state"], x))).alias("out")))

    def whole(of: Column) -> Column:
        begin = F.struct(zero.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("out"))
        runs = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(of) / _RUN).cast("int") - 1, F.lit(0)))
        each = lambda acc, c: _let(run(acc["state"], F.slice(of, c * _RUN + 1, F.lit(_RUN))),
                                   lambda r: F.struct(r["state"].alias("state"), F.concat(acc["out"], F.array(r["out"])).alias("out")))
        return F.flatten(F.aggregate(runs, begin, each, lambda acc: acc["out"]))

    return _let(items, whole)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, r"[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Does a string of digits pass the Luhn checksum?"""
    n = F.length(digits)
    value = lambda i: F.substr(digits, n - i, F.lit(1)).cast("int")  # noqa: E731  the i-th digit from the right
    doubled = lambda i: F.when(value(i) > 4, 2 * value(i) - 9).otherwise(2 * value(i))
    terms = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(i % 2 == 1, doubled(i)).otherwise(value(i)))
    return F.aggregate(terms, F.lit(0), lambda a, b: a + b) % 10 == 0


def mod97(iban: Column) -> Column:
    """Does an IBAN (letters and digits only) pass its mod-97 checksum?"""
    moved = F.concat(F.substr(iban, F.lit(5), F.length(iban)), F.substr(iban, F.lit(1), F.lit(4)))
    step = lambda acc, c: F.when(c.between("0", "9"), (acc * 10 + F.ascii(c) - 48) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.filter(F.split(moved, "(?!^)"), lambda c: c != ""), F.lit(0), step) == 1


def _confirmed(kind: str, match: Column) -> Column:
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
        return match.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        digits = _digits(match)
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    return F.lit(True)


def _score(kind: str, span: Column) -> Column:
    """A further kind's score: its start, its checksum's verdict, and the words near it."""
    checked = F.lit(0.0)
    if kind == "iban":
        plain = F.regexp_replace(span["match"], " ", "")
        passed = F.when(F.length(plain).between(15, 34), mod97(plain)).otherwise(F.lit(False))
        checked = F.when(passed, F.lit(_CHECKED)).otherwise(F.lit(-1.0))
    near, weight = _CONTEXT[kind]
    return F.lit(_START[kind]) + checked + F.when(span["near"].rlike(near), F.lit(weight)).otherwise(F.lit(0.0))


def spans_of(kind: str, text: Column) -> Column:
    """array<struct<kind, start, end>> of one kind's confirmed spans, in order."""
    matches = F.regexp_extract_all(text, F.lit(_PATTERNS[kind]), F.lit(0))
    gaps = F.split(text, _PATTERNS[kind], -1)
    pairs = F.zip_with(gaps, matches, lambda g, m: F.struct(g.alias("gap"), m.alias("match")))  # the last gap has no match
    size = lambda pair: F.length(pair["gap"]) + F.coalesce(F.length(pair["match"]), F.lit(0))

    def around(of: Column, i: Column) -> Column:
        """What stands near the i-th match, from the pairs beside it: ``_NEAR`` characters on
        both sides, or the end of the gap before it. A match of the kinds that look
        to both sides has more than ten characters, so four pairs on a side are enough."""
        gap = F.element_at(of, i + 1)["gap"]
        if _CONTEXT[kind][1] < 0:
            return F.right(gap, F.lit(_NEAR))
        joined = lambda some: F.array_join(F.transform(some, lambda x: F.concat(x["gap"], F.coalesce(x["match"], F.lit("")))), "")
        before = F.concat(joined(F.slice(of, F.greatest(i - 3, F.lit(1)), F.least(i, F.lit(4)))), gap)
        after = joined(F.slice(of, i + 2, F.lit(5)))
        return F.concat(F.right(before, F.lit(_NEAR)), F.lit("\n"), F.left(after, F.lit(_NEAR)))

    def taken(of: Column) -> Column:
        begins = scan(of, F.lit(0), lambda at, x: at + size(x), lambda at, x: at + F.length(x["gap"]), "int")

        def span(x: Column, i: Column) -> Column:
            near = around(of, i) if kind in _CONTEXT else F.lit("")
            return F.struct(x["pair"]["match"].alias("match"), near.alias("near"), F.lit(kind).alias("kind"), x["begin"].alias("start"),
                            (x["begin"] + F.length(x["pair"]["match"])).alias("end"))

        both = F.zip_with(F.slice(of, F.lit(1), F.size(of) - 1), begins, lambda pair, begin: F.struct(pair.alias("pair"), begin.alias("begin")))
        placed = F.transform(F.filter(both, lambda x: x["pair"].isNotNull()), span)
        return F.transform(F.filter(placed, keep), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

    def keep(s: Column) -> Column:
        return _score(kind, s) >= THRESHOLD if kind in EXTRA_KINDS else _confirmed(kind, s["match"])

    none = F.array().cast("array<struct<kind: string, start: int, end: int>>")
    there = text.rlike(_PATTERNS[kind])
    if kind in _NEEDS:
        there = F.contains(text, F.lit(_NEEDS[kind])) & there
    return F.when(there, _let(pairs, taken)).otherwise(none)


def with_spans(docs: DataFrame, text: str = "text", into: str = "spans") -> DataFrame:
    """``docs`` with a struct column that holds one array of spans per kind."""
    whole = F.coalesce(column(text), F.lit(""))
    return docs.withColumn(into, F.struct(*[spans_of(k, whole).alias(k) for k in BASE_KINDS + EXTRA_KINDS]))


def mask(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; overlapping spans become one."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    # with each span the end of all before it; those that begin below it belong to the one before
    ends = scan(order, F.lit(0), lambda most, s: F.greatest(most, s["end"]),
                lambda most, s: F.struct(most.alias("before"), s["start"].alias("start"), s["kind"].alias("kind")), "struct<before: int, start: int, kind: string>")

    def whole(of: Column) -> Column:
        # runs of spans take their part of the text out once, so that no step walks the whole text
        def part(c: Column) -> Column:
            some = F.slice(of, c * _RUN + 1, F.lit(_RUN))
            return _let(some, lambda run: _let(F.struct(run[0]["before"].alias("at"), F.substr(
                text, run[0]["before"] + 1, F.element_at(run, -1)["start"] - run[0]["before"]).alias("text")), lambda own: F.array_join(F.transform(
                    run, lambda s: F.concat(F.substr(own["text"], s["before"] - own["at"] + 1, s["start"] - s["before"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))), "")))

        return F.array_join(F.transform(F.sequence(F.lit(0), F.ceil(F.size(of) / _RUN).cast("int") - 1), part), "")

    last = F.array_max(F.transform(spans, lambda s: s["end"]))
    return F.concat(_let(F.filter(ends, lambda s: s["start"] >= s["before"]), whole), F.substr(text, last + 1, F.length(text)))


def masked(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with personal data in ``text`` masked; same columns."""
    own = free_name(docs, "_spans")
    all_spans = F.concat(*[F.col(f"{own}.{k}") for k in BASE_KINDS + EXTRA_KINDS])
    found = with_spans(docs, text, own)
    return (found.withColumn(text, F.when(F.size(all_spans) > 0, mask(column(text), all_spans)).otherwise(column(text)))
            .select(*[column(c) for c in docs.columns]))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, checksum of the base spans, all spans, and how many spans of any kind."""
    found = with_spans(docs.select("doc_id", "text"))
    kinds = lambda names: F.concat(*[F.col(f"spans.{k}") for k in names])
    return found.select("doc_id", *[F.size(f"spans.{k}").cast("long").alias(f"n_{k}") for k in BASE_KINDS],
                        F.sha2(_listed(kinds(BASE_KINDS)), 256).alias("base_sha256"), _listed(kinds(BASE_KINDS + EXTRA_KINDS)).alias("spans"),
                        F.size(kinds(BASE_KINDS + EXTRA_KINDS)).cast("long").alias("n_private"))
