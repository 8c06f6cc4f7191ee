"""Personal data: regular expressions propose spans, checksums confirm them, context scores them.

Everything is a DataFrame expression; there is no shuffle and no Python on the executors.

Base kinds are ``email``, ``ip``, ``card`` (Luhn) and ``phone``. The operator adds ``iban``
(mod-97). The patterns use possessive repeats and a look-behind at the start of a run: both give
the matches of the plain greedy patterns, in time linear in the text and without deep recursion.

Each span scores ``0.5``, ``+0.3`` where a checksum confirmed it, ``+0.2`` where a context word
stands whole within :data:`CONTEXT_CHARS` code points before or after it; a word that the edge of that
window cuts does not count.

Null text is read as empty and gives no spans; null ids, repeated rows and extra columns pass
through unchanged; spans of one kind never overlap, spans of several kinds at one place all stay; texts of any
length and with any number of matches are taken whole; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import from_blocks, in_blocks, match_spans, span_list, span_text, whole_text

BASE_KINDS = ["email", "ip", "card", "phone"]
KINDS = [*BASE_KINDS, "iban"]
CONTEXT_CHARS = 40

PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,4})?)(?![A-Za-z0-9])",
}

#: Whole words, in the corpus's languages.
CONTEXT_WORDS = {
    "email": "e-?mail|mail|contact|kontakt|correo|courriel",
    "ip": "ip|host|server|address|addr|adresse",
    "card": "card|visa|mastercard|amex|credit|debit|karte|carte|tarjeta",
    "phone": "phone|tel|call|mobile|fax|telefon|t[eé]l[eé]phone|tel[eé]fono",
    "iban": "iban|bank|account|konto|compte|cuenta",
}
_LETTER = r"[\p{L}\p{N}_]"


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn_ok(number: Column) -> Column:
    """Luhn's checksum of a string of digits."""
    back = F.reverse(number)

    def add(total, i):
        d = F.substring(back, i, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), add) % 10 == 0


def mod97_ok(value: Column) -> Column:
    """ISO 7064 mod 97-10 of an account number, spaces ignored."""
    plain = F.regexp_replace(value, " ", "")
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))

    def add(rest, i):
        code = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(code >= 65, (rest * 100 + code - 55) % 97).otherwise((rest * 10 + code - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, r"^0+(?=[0-9])", "")
        small = lambda p: (F.length(part(p)) <= 3) & (F.substring(part(p), 1, 3).cast("int") <= 255)
        return F.forall(F.split(value, r"\."), small)
    if kind == "card":
        n = F.length(digits(value))
        return F.when((n >= 14) & (n <= 19), luhn_ok(digits(value))).otherwise(False)
    if kind == "phone":
        return F.length(digits(value)).between(10, 15)
    if kind == "iban":
        return mod97_ok(value)
    return F.lit(True)


def find_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` plus ``pii``: ``array<struct<start, kind_order, end, kind, value, score>>``, and
    one ``m_<kind>`` array per kind with the confirmed matches."""
    df = docs.withColumn("__text", whole_text(text))
    df = match_spans(df, "__text", PATTERNS)

    def confirmed(kind: str) -> Column:
        return F.filter(F.col(f"m_{kind}"), lambda s: _valid(kind, s["value"]))

    df = df.withColumns({f"m_{k}": confirmed(k) for k in KINDS})

    # the text in blocks: to take a few code points out of a block does not mean to walk the text
    some = F.lit(False)
    for k in KINDS:
        some = some | (F.size(f"m_{k}") > 0)
    df = df.withColumn("__blocks", F.when(some, in_blocks(F.col("__text"))))

    def part(start: Column, size: Column) -> Column:
        return from_blocks(F.col("__blocks"), start, start + size)

    def near(kind: str, s: Column) -> Column:
        """A context word on either side. Each side also has one code point of the span, so that
        a word must end before it, and one that is farther out than it counts: the rest of a
        word at that end goes."""
        left = F.greatest(s["start"] - CONTEXT_CHARS - 1, F.lit(0))
        before = part(left, s["start"] - left + 1)
        after = part(s["end"] - 1, F.lit(CONTEXT_CHARS + 2))
        before = F.when(s["start"] > CONTEXT_CHARS, F.regexp_replace(before, f"^{_LETTER}+", "")).otherwise(before)
        after = F.when(F.length(after) > CONTEXT_CHARS + 1, F.regexp_replace(after, f"{_LETTER}+$", "")).otherwise(after)
        word = f"(?<!{_LETTER})(?:{CONTEXT_WORDS[kind]})(?!{_LETTER})"
        return F.regexp_like(before, F.lit(f"(?ius){word}(?=.)")) | F.regexp_like(after, F.lit(f"(?ius)(?<=.){word}"))

    def scored(kind: str, order: int) -> Column:
        def one(s):
            score = F.round(F.lit(0.8 if kind in ("card", "iban") else 0.5) + F.when(near(kind, s), 0.2).otherwise(0.0), 2)
            return F.struct(s["start"].alias("start"), F.lit(order).alias("kind_order"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["value"].alias("value"), score.alias("score"))

        return F.transform(F.col(f"m_{kind}"), one)

    df = df.withColumn("pii", F.array_sort(F.concat(*[scored(k, i) for i, k in enumerate(KINDS)])))
    return df.drop("__text", "__blocks")


def report(docs: DataFrame) -> DataFrame:
    """One row per document: counts, the base spans' digest, all spans and their scores."""
    df = find_pii(docs.select("doc_id", "text"))
    count = lambda k: F.size(f"m_{k}").cast("long")
    return df.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(span_text(span_list(BASE_KINDS)), 256).alias("base_sha256"),
        span_text(F.col("pii")).alias("spans"),
        F.array_join(F.transform("pii", lambda s: F.format_number(s["score"], 2)), ",").alias("scores"),
        F.coalesce(F.array_max(F.transform("pii", lambda s: s["score"])), F.lit(0.0)).alias("max_score"),
    )
