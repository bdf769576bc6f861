"""Operator 7: personal data by patterns, checksums and context (DataFrame functions only).

Patterns propose spans; validators confirm them (address parts, digit counts,
Luhn for cards, mod-97 for bank accounts); words around a span move its score.

Base kinds, always kept when their check passes: email, ip, card, phone. Added
kinds, kept at ``KEEP_SCORE`` or more: iban (the mod-97 check is strong evidence
by itself), ssn (three digit groups) and secret (a long hexadecimal or base-64
value), which need a word nearby that says what they are.

Spans come without a Python function: ``split`` and ``regexp_extract_all`` walk
the text with the same pattern, so piece lengths and match lengths, summed in
turn, give each match's place in code points.

The patterns match what the contract's do, in linear time and without recursion
on very long runs: repeated groups are possessive, which changes nothing where
what follows cannot begin inside them, and a run is entered at its start only
(or where the last match ended), since a match that fails there fails from
everywhere in the run.

Defined results: null text is empty and has no spans; equal spans of different
kinds are all reported, in the kinds' order; repeated rows each give their own
row; only id and text columns are read, so others may have any name; an empty
table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEEP_SCORE = 0.5
CONTEXT = 40  # code points before and after a span, up to the next one of its kind, that are its context
SUM_BLOCK = 128

#: The contract's patterns, written possessively; kinds in the contract's order.
BASE_PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
ADDED_PATTERNS = {
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "secret": r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}+=*+",
}
#: A character that every match of the kind holds; texts without it are not searched.
NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]",
         "iban": r"[A-Z]{2}[0-9]{2}", "ssn": r"[0-9]-[0-9]", "secret": r"[A-Za-z0-9+/_-]{32}"}
PART = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2}+|)"
#: Context words that raise a kind's score (near the span, any case).
WORDS = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write)\b", "ip": r"(?i)\b(?:ip|host|server|address)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|credit|debit)\b", "phone": r"(?i)\b(?:phone|tel|call|mobile|fax)\b",
    "iban": r"(?i)\b(?:iban|bank|account|konto|compte|cuenta)\b", "ssn": r"(?i)\b(?:ssn|social security)\b",
    "secret": r"(?i)(?:token|secret|passw|api.?key|key)\W{0,4}\s*$",
}
#: Words that lower it: the value is an example or a version.
DOUBT = r"(?i)\b(?:example|sample|dummy|version)\b"
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.7, "ssn": 0.3, "secret": 0.2}
RAISE, LOWER = 0.35, 0.15


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, r"[^0-9]", "")


def luhn(m: Column) -> Column:
    """12 to 19 digits whose Luhn sum is a multiple of ten; zeros in front change nothing."""
    d = F.lpad(F.right(_digits(m), F.lit(19)), 19, "0")
    total = []
    for k in range(19):  # k-th digit from the right
        x = F.substring(d, 19 - k, 1).cast("int")
        total.append(x if k % 2 == 0 else F.when(x > 4, x * 2 - 9).otherwise(x * 2))
    return F.length(_digits(m)).between(12, 19) & (reduce(lambda a, b: a + b, total) % 10 == 0)


def mod97(m: Column) -> Column:
    """Country code and check digits moved to the end, letters as 10 to 35: remainder 1 modulo 97."""
    s = F.regexp_replace(m, " ", "")
    moved = F.concat(F.substring(s, 5, 64), F.substring(s, 1, 4))
    figures = reduce(lambda c, k: F.regexp_replace(c, chr(55 + k), str(k)), range(10, 36), moved)
    chunks = F.regexp_extract_all(figures, F.lit("[0-9]{1,7}"), F.lit(0))
    rest = F.aggregate(chunks, F.lit(0).cast("bigint"),
                       lambda acc, c: F.concat(acc.cast("string"), c).cast("bigint") % 97)
    return (F.length(s).between(15, 34)) & (rest == 1)


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike("^" + r"\.".join([PART] * 4) + "$")
    if kind == "card":
        return luhn(m)
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    if kind == "iban":
        return mod97(m)
    if kind == "secret":  # mixed letters and figures, so neither a word nor a number
        return m.rlike("[0-9]") & m.rlike("[A-Za-z]")
    return F.lit(True)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body's lambdas use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(lengths: Column) -> Callable[[Column], Callable[[Column], Column]]:
    """Sum of the first k + 1 lengths: whole blocks before k from a short array, the rest added up.

    Work grows with the number of lengths times ``SUM_BLOCK``, not with its square.
    """
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(lengths) / SUM_BLOCK).cast("int")),
                         lambda b: F.aggregate(F.slice(lengths, b * SUM_BLOCK + 1, F.lit(SUM_BLOCK)), F.lit(0),
                                               lambda acc, x: acc + x))
    before = F.aggregate(blocks, F.array(F.lit(0)),
                         lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    def at(sums: Column) -> Callable[[Column], Column]:
        def upto(k: Column) -> Column:
            block = F.floor(k / SUM_BLOCK).cast("int")
            own = F.slice(lengths, block * SUM_BLOCK + 1, k - block * SUM_BLOCK + 1)
            return F.get(sums, block) + F.aggregate(own, F.lit(0), lambda acc, x: acc + x)
        return upto

    return lambda body: _let(before, lambda sums: body(at(sums)))


def _spans(kind: str, pattern: str, text: Column) -> Column:
    """array<struct<start, rank, kind, end, score>> of the kind's confirmed spans."""
    rank = list(PRIOR).index(kind)

    def score(before: Column, after: Column) -> Column:
        near, then = F.right(before, F.lit(CONTEXT)), F.left(after, F.lit(CONTEXT))
        words = near.rlike(WORDS[kind]) if kind == "secret" else near.rlike(WORDS[kind]) | then.rlike(WORDS[kind])
        doubt = near.rlike(DOUBT) | then.rlike(DOUBT)
        return F.least(F.lit(PRIOR[kind]) + F.when(words, RAISE).otherwise(0.0)
                       - F.when(doubt, LOWER).otherwise(0.0), F.lit(1.0))

    def place(found: Column) -> Column:
        lengths = F.transform(found, lambda x: F.length(x["before"]) + F.length(x["m"]))
        placed = _let(lengths, lambda n: _running(n)(lambda upto: F.transform(found, lambda x, k: F.struct(
            (upto(k) - F.length(x["m"])).alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"),
            upto(k).alias("end"), x["m"].alias("m"), x["before"].alias("before"), x["after"].alias("after")))))
        valid = F.filter(placed, lambda s: _valid(kind, s["m"]))
        return F.transform(valid, lambda s: F.struct(
            s["start"].alias("start"), s["rank"].alias("rank"), s["kind"].alias("kind"), s["end"].alias("end"),
            score(s["before"], s["after"]).alias("score")))

    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    with_gaps = _let(F.split(text, pattern, -1), lambda gaps: F.zip_with(
        F.zip_with(matches, gaps, lambda m, g: F.struct(m.alias("m"), g.alias("before"))),
        F.slice(gaps, F.lit(2), F.size(gaps)),
        lambda x, g: F.struct(x["m"].alias("m"), x["before"].alias("before"), g.alias("after"))))
    found = _let(F.filter(with_gaps, lambda x: x["m"].isNotNull()), place)
    if kind not in BASE_PATTERNS:
        found = F.filter(found, lambda s: s["score"] >= KEEP_SCORE)
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int,score:double>>")
    return F.when(text.rlike(NEEDS[kind]), found).otherwise(none)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, found): spans of all kinds as array<struct<start, rank, kind, end, score>>, by start, then kind."""
    text = F.coalesce(F.col("__t"), F.lit(""))
    kinds = {**BASE_PATTERNS, **ADDED_PATTERNS}
    each = docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias("__t")).select(
        id_col, *[_spans(k, p, text).alias(f"__{k}") for k, p in kinds.items()])
    return each.select(id_col, F.array_sort(F.concat(*[f"__{k}" for k in kinds])).alias("found"))


def pii_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans as text."""
    found = find_pii(docs, id_col, text_col)
    base = F.filter("found", lambda s: s["rank"] < len(BASE_PATTERNS))

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(id_col, *[count(k) for k in BASE_PATTERNS], F.sha2(_joined(base), 256).alias("base_sha256"),
                        _joined(F.col("found")).alias("spans"),
                        F.transform("found", lambda s: F.round(s["score"], 2)).alias("scores"))
