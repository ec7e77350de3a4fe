"""Personal data: patterns propose spans, validators confirm them, nearby words adjust their scores.

DataFrame functions only. Places of matches come from two built-in functions over the same pattern: what split()
leaves between matches and what regexp_extract_all() takes, in turn, add up to the places. The patterns are written so
that a failed match never starts again inside the same run of characters, which keeps them linear in the text; places
add up block by block, so that the work on a text with many matches stays near linear, too.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused

ONE = "struct<kind:string,start:int,end:int,score:double>"
SPAN = f"array<{ONE}>"
#: Characters before and behind a span that are searched for context words, up to the next match of its kind.
REACH = 40
#: Items that one growing array of a running total holds.
BLOCK = 256
#: Spans of the added kinds stay from this score on.
KEEP = 0.5


@dataclass(frozen=True)
class Kind:
    """base: the score of a proposed span. A validator drops a span that fails it and adds `sure` otherwise."""

    name: str
    pattern: str
    hint: str  # a cheap pattern that any text with a match has
    base: float
    validator: str | None = None
    sure: float = 0.0
    context: str | None = None
    near: float = 0.3
    against: str | None = None
    always: bool = False  # context never drops it


_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: The four kinds of the contract, then the added ones.
KINDS = (
    Kind("email", rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++", "@", 0.9, always=True, context="mail|contact|write to|reach"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", 0.6, "ip", 0.1, r"\bip\b|host|server|address|login", always=True, against="version|release"),
    Kind("card", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,}+", r"[0-9](?:[\x20-]?[0-9]){15}", 0.4, "luhn", 0.4, "card|visa|master|credit|payment", always=True, against="isbn|order|serial"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", 0.6, "phone", 0.1, "phone|call|tel|mobile|fax", always=True),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]", 0.3, "mod97", 0.5, "iban|account|bank|konto|compte|cuenta"),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]-[0-9]{2}-[0-9]", 0.3, "ssn", 0.1, r"\bssn\b|social|security|tax"),
    Kind("key", r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])", "AKIA", 0.8),
    Kind("secret", r"(?<![A-Za-z0-9])[0-9a-f]{16,128}+(?![A-Za-z0-9])", r"[0-9a-f]{16}", 0.1, "secret", 0.2, "password|passwd|pwd|token|secret|key", near=0.4),
)
BASE = ("email", "ip", "card", "phone")
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check sum of a string of digits ends in 0."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return total + F.when((n - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), add) % 10 == 0


def mod97(s: Column) -> Column:
    """Whether an account number, its first four characters moved to the end and letters read as 10 to 35, is 1 modulo 97."""
    plain = F.regexp_replace(s, " ", "")
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))

    def step(rest: Column, i: Column) -> Column:
        v = F.conv(F.substring(turned, i, F.lit(1)), 36, 10).cast("int")
        return (rest * F.when(v > 9, 100).otherwise(10) + v) % 97

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(turned), F.lit(1))), F.lit(0), step) == 1


def _valid(kind: Kind, match: Column) -> Column:
    if kind.validator == "ip":
        return match.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind.validator == "luhn":
        d = _digits(match)
        return F.length(d).between(16, 19) & luhn(d)
    if kind.validator == "phone":
        return F.length(_digits(match)).between(8, 15)
    if kind.validator == "mod97":
        return F.length(F.regexp_replace(match, " ", "")).between(15, 34) & mod97(match)
    if kind.validator == "ssn":
        return ~match.rlike("^(?:000|666|9)|-00-|-0000$")
    if kind.validator == "secret":
        return match.rlike("[0-9]") & match.rlike("[A-Za-z]")
    return F.lit(True)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value made once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def running(items: Column, step: Callable[[Column, Column], Column], made: Callable[[Column, Column], Column], kind: str) -> Column:
    """made(state, item) of every item, where state is a number that starts at 0 and becomes step(state, item) behind an item.

    The states before each block of items come first, then all blocks are gone through: appending to an array copies it,
    so no array grows beyond a block or the number of blocks.
    """

    def ahead(blocks: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("seen"))
        seen = F.aggregate(blocks, start, lambda s, b: F.struct(F.aggregate(b["rows"], s["at"], step).alias("at"), F.concat(s["seen"], F.array(s["at"])).alias("seen")), lambda s: s["seen"])
        return F.flatten(F.zip_with(blocks, seen, within))

    def within(block: Column, at: Column) -> Column:
        start = F.struct(at.alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
        return F.aggregate(block["rows"], start, lambda s, x: F.struct(step(s["at"], x).alias("at"), F.concat(s["out"], F.array(made(s["at"], x))).alias("out")), lambda s: s["out"])

    def in_blocks(rows: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor(F.greatest(F.size(rows) - 1, F.lit(0)) / BLOCK).cast("int"))
        return once(F.transform(numbers, lambda i: F.struct(F.slice(rows, i * BLOCK + 1, F.lit(BLOCK)).alias("rows"))), ahead)

    return once(items, in_blocks)


def find(text: Column, kind: Kind) -> Column:
    """Spans of one kind: kind, start, end (code points, end exclusive), score."""
    between, taken = F.split(text, kind.pattern, -1), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    # What comes before a match, the match, what comes behind it.
    both = once(between, lambda gaps: F.arrays_zip(gaps.alias("gap"), taken.alias("match"), F.slice(gaps, 2, F.size(gaps)).alias("behind")))

    def scored(part: Column) -> Column:
        score = F.lit(kind.base + kind.sure)
        around = F.lower(F.concat(F.substring(part["gap"], -REACH, REACH), part["match"], F.substring(part["behind"], 1, REACH)))
        if kind.context:
            score = score + F.when(around.rlike(kind.context), kind.near).otherwise(0.0)
        if kind.against:
            score = score - F.when(around.rlike(kind.against), kind.near).otherwise(0.0)
        return F.round(F.greatest(F.least(score, F.lit(1.0)), F.lit(KEEP if kind.always else 0.0)), 3)

    def step(at: Column, part: Column) -> Column:
        return at + F.length(part["gap"]) + F.coalesce(F.length(part["match"]), F.lit(0))

    def made(at: Column, part: Column) -> Column:
        start = at + F.length(part["gap"])
        span = F.struct(F.lit(kind.name).alias("kind"), start.alias("start"), (start + F.length(part["match"])).alias("end"), scored(part).alias("score"))
        return F.when(part["match"].isNotNull() & _valid(kind, part["match"]), span)

    spans = F.filter(running(both, step, made, ONE), lambda s: s.isNotNull() if kind.always else s["score"] >= KEEP)
    return F.when(text.rlike(kind.hint), spans).otherwise(F.array().cast(SPAN))


def spans_of(text: Column) -> Column:
    return F.concat(*(find(text, k) for k in KINDS))


def personal_data(docs: DataFrame, text_col: str = "text", out_col: str = "spans") -> DataFrame:
    """docs with a column `out_col`: array<struct<kind, start, end, score>>, by kind as in KINDS, then start.

    A null text has no spans, like an empty one; all rows and columns stay as they are, repeated rows included (an own
    column of that name is replaced: give another name to keep it); an empty table stays empty. Spans of different kinds
    may overlap.
    """
    return docs.withColumn(out_col, spans_of(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with each found span replaced by its kind in brackets; spans that overlap go as one, under the first's kind.

    Null and empty texts stay as they are, so do all other columns, whatever their names; repeated rows are each masked;
    an empty table stays empty.
    """
    spans, = unused(docs, "spans")
    found = personal_data(docs, text_col, spans)
    text = F.col(text_col)
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def masked(raw: Column) -> Column:
        """raw: the text with four bytes for each character, of which a part is found without reading the rest."""
        part = lambda a, size: F.decode(F.substring(raw, 4 * a + 1, 4 * size), "UTF-32")

        def made(at: Column, s: Column) -> Column:
            return F.when(s["start"] >= at, F.concat(part(at, s["start"] - at), F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise("")

        pieces = running(ordered, lambda at, s: F.greatest(at, s["end"]), made, "string")
        return F.concat(F.array_join(pieces, ""), part(F.array_max(F.transform(spans, lambda s: s["end"])), F.length(text)))

    return found.withColumn(text_col, F.when(F.size(spans) > 0, once(F.encode(text, "UTF-32"), masked)).otherwise(text)).select(docs.columns)


def _of_kind(kind: str):
    return lambda s: s["kind"] == kind


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and digests of the spans, one row for each document."""
    named = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    count = lambda k: F.size(F.filter("spans", _of_kind(k))).cast("long").alias(f"n_{k}")
    added = [count(k.name) for k in KINDS if k.name not in BASE]
    return found.select(F.col(id_col).cast("long").alias("doc_id"), *map(count, BASE), F.sha2(named(base), 256).alias("base_sha256"), named(F.col("spans")).alias("spans"), *added)
