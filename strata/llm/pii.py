"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust a score.

DataFrame functions only.  A pattern's matches come from ``regexp_extract_all``
and the text between them from ``split``; their lengths, summed up, are the
matches' places, and the ends of the pieces between are their contexts.  Only
texts with a match are split.

The patterns run over whole texts.  They are written so that a long run of one
kind of character is gone through once: repeats are possessive, and a match can
begin only where such a run begins (or where the last match ended).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 64  # running sums are taken in two levels, so that many matches in a text don't cost their square


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]++", "")


def between(c: Column, low: int, high: int) -> Column:
    return (F.length(c) >= low) & (F.length(c) <= high)


def luhn(c: Column, low: int, high: int) -> Column:
    """As many digits as that, whose Luhn sum is right."""
    return F.when(between(digits(c), low, high), F.call_function("luhn_check", digits(c))).otherwise(False)


def mod97(c: Column) -> Column:
    """The remainder by 97 of a string of digits and A-Z, letters read as 10 to 35."""
    code = lambda x: F.ascii(x)
    step = lambda r, x: F.when(code(x) < 58, r * 10 + code(x) - 48).otherwise(r * 100 + code(x) - 55) % 97
    return F.aggregate(F.split(c, ""), F.lit(0), lambda r, x: F.when(x == "", r).otherwise(step(r, x)).cast("int"))


def iban(c: Column) -> Column:
    plain = F.replace(c, F.lit(" "), F.lit(""))
    return F.when(between(plain, 15, 34), mod97(F.concat(F.substring(plain, 5, 34), F.substring(plain, 1, 4))) == 1).otherwise(False)


def social_number_fr(c: Column) -> Column:
    """Thirteen digits, then 97 less their remainder by 97."""
    d = digits(c)
    return F.when(F.length(d) == 15, F.substring(d, 14, 2).cast("int") == 97 - mod97(F.substring(d, 1, 13))).otherwise(False)


def ip_parts(c: Column) -> Column:
    return c.rlike(r"^0*+(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]|(?<=0))(\.0*+(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]|(?<=0))){3}$")


@dataclass(frozen=True)
class Kind:
    """What to look for: a pattern, what confirms a match, and a score before and after its context."""

    name: str
    pattern: str
    confirmed: Callable[[Column], Column] = lambda c: F.lit(True)
    score: float = 0.5
    lifting: tuple[str, ...] = ()  # words nearby that add 0.3
    lowering: tuple[str, ...] = ("example", "sample", "version", "order", "isbn", "invoice")  # and that take 0.3
    always: bool = False  # kept whatever its score
    needs: str = ""  # a character without which no match is possible


# The given kinds, in the given order.  Their patterns match what the given ones match.
BASE = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
         score=0.9, lifting=("mail", "contact", "write", "@"), always=True, needs="@"),
    Kind("ip", r"(?=[0-9])(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ip_parts,
         score=0.6, lifting=("ip", "address", "host", "server", "login"), always=True, needs="."),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", lambda c: luhn(c, 12, 19),
         score=0.7, lifting=("card", "visa", "credit", "karte", "carte", "tarjeta", "pay"), always=True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda c: between(digits(c), 9, 15),
         score=0.7, lifting=("phone", "tel", "call", "mobile", "fax", "whatsapp"), always=True, needs="+"),
)
# The method's own kinds; a match without a checksum needs a word nearby.
OWN = (
    Kind("iban", r"(?=[A-Z])(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])", iban,
         score=0.9, lifting=("iban", "account", "bank", "konto", "compte", "cuenta")),
    Kind("social_fr", r"(?=[12])(?<![0-9])[12]\x20?[0-9]{2}\x20?[0-9]{2}\x20?[0-9]{2}\x20?[0-9]{3}\x20?[0-9]{3}\x20?[0-9]{2}(?![0-9])", social_number_fr,
         score=0.7, lifting=("social", "insee", "nir", "assur")),
    Kind("social_us", r"(?=[0-9])(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
         score=0.4, lifting=("ssn", "social"), needs="-"),
)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, also where ``use`` loops over it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def sums_before(lengths: Column) -> Column:
    """For each element the sum of those before it."""
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    chunks = F.sequence(F.lit(0), F.floor(F.size(lengths) / CHUNK).cast("int"))
    by_chunk = F.transform(chunks, lambda c: total(F.slice(lengths, c * CHUNK + 1, F.lit(CHUNK))))
    ahead = bound(by_chunk, lambda s: F.transform(s, lambda _, c: total(F.slice(s, F.lit(1), c))))
    return bound(ahead, lambda a: F.transform(lengths, lambda _, i: F.get(a, F.floor(i / CHUNK).cast("int")) + total(
        F.slice(lengths, (F.floor(i / CHUNK) * CHUNK + 1).cast("int"), i % CHUNK))))


def _spans(kind: Kind, rank: int, found: Column, text: Column, near: int, least: float) -> Column:
    def scored(x: Column, before: Column, after: Column) -> Column:
        context = F.lower(F.concat(F.right(before, F.lit(near)), F.lit(" "), F.left(after, F.lit(near))))
        says = lambda words: reduce(lambda a, b: a | b, [F.contains(context, F.lit(w)) for w in words], F.lit(False))
        return F.lit(kind.score) + F.when(says(kind.lifting), 0.3).otherwise(0.0) - F.when(says(kind.lowering), 0.3).otherwise(0.0)

    def placed(gaps: Column) -> Column:
        lengths = F.transform(found, lambda x, i: (F.length(x) + F.length(F.get(gaps, i))).cast("long"))
        starts = bound(lengths, sums_before)

        def one(x: Column, i: Column, before: Column) -> Column:
            start = F.get(before, i) + F.length(F.get(gaps, i))
            score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), scored(x, F.get(gaps, i), F.get(gaps, i + 1))))
            return F.struct(start.alias("start"), F.lit(rank).alias("rank"), (start + F.length(x)).alias("stop"),
                            F.lit(kind.name).alias("kind"), x.alias("value"), F.round(score, 2).alias("score"))

        return bound(starts, lambda before: F.transform(found, lambda x, i: one(x, i, before)))

    spans = bound(F.split(text, kind.pattern, -1), placed)
    kept = F.filter(spans, lambda s: kind.confirmed(s["value"]) & (F.lit(kind.always) | (s["score"] >= least)))
    return F.when(F.size(found) > 0, kept)


def find(docs: DataFrame, kinds: tuple[Kind, ...] = BASE + OWN, text: str = "text", near: int = 40, least: float = 0.5) -> DataFrame:
    """Adds ``spans``: an array of (start, rank, stop, kind, value, score), ordered by start, then kind as listed.

    Per kind, matches are leftmost and do not overlap; one that its checksum
    does not confirm is dropped, without another try inside it.  Places count
    code points from 0, ends are exclusive.  The score is the kind's own, 0.3
    higher or lower by words in the ``near`` characters on either side (up to
    the next match of that kind); a kind not kept ``always`` needs ``least``.

    Null and empty texts have no spans.  Repeated rows and rows with null ids
    each keep their own; an empty table stays empty.  Columns of any name stay,
    but for one named ``spans``, which is replaced.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast("array<string>")
    matched = F.struct(*[
        (F.when(F.contains(whole, F.lit(k.needs)), m).otherwise(none) if k.needs else m).alias(f"m{i}")
        for i, k in enumerate(kinds) for m in [F.regexp_extract_all(whole, F.lit(k.pattern), F.lit(0))]])
    name = "spans"
    d = docs.withColumn(name, matched)
    some = [F.coalesce(_spans(k, i, F.col(name)[f"m{i}"], whole, near, least), F.array().cast(
        "array<struct<start:bigint,rank:int,stop:bigint,kind:string,value:string,score:double>>")) for i, k in enumerate(kinds)]
    return d.withColumn(name, F.array_sort(F.concat(*some)))


def listed(spans: Column) -> Column:
    """kind:start:stop of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
