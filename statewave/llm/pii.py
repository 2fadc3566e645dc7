"""Personal data in texts, with column expressions only.

A regular expression proposes spans, a checksum or range check confirms them (Luhn for cards,
mod 97 for account numbers, 255 for addresses), and context words in the forty characters
before a span adjust its score: past spans of the kind that weren't confirmed, and past confirmed
ones if no letters follow them, as in a list of numbers. The four base kinds are kept whatever their score; the added
kinds are kept from a score of ``MIN_SCORE`` on.

Nulls count as empty texts. Positions are code points, the end is exclusive. Spans of one kind
don't overlap; spans of different kinds may. Work per text is linear in its length: every
pattern is written so that it cannot back-track over a long run.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statewave.llm.text import let, plain

MIN_SCORE = 0.5
CONTEXT_CHARS = 40
#: Every match has two characters at least, so that many gaps and matches fill the context.
CONTEXT_PIECES = 20
#: Stands for each character of a confirmed span in the context.
TAKEN = "\x01"
PREFIX_BLOCK = 256


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def octets(match: Column) -> Column:
    part = "0*(?:[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
    return match.rlike(rf"^{part}(?:\.{part}){{3}}$")


def luhn(low: int, high: int) -> Callable[[Column], Column]:
    return lambda match: (F.length(digits(match)).between(low, high)
                          & F.call_function("luhn_check", digits(match)))


def phone_digits(match: Column) -> Column:
    return F.length(digits(match)).between(8, 15)


def mod97(match: Column) -> Column:
    """The account number with its first four characters moved to the end, letters as 10 to 35."""
    plain = F.replace(match, F.lit(" "), F.lit(""))
    moved = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))

    def step(rest: Column, char: Column) -> Column:
        code = F.ascii(char)
        return F.when(code >= 65, (rest * 100 + code - 55) % 97).otherwise((rest * 10 + code - 48) % 97)

    rest = F.aggregate(F.split(moved, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise(step(a, c)))
    return F.length(plain).between(15, 34) & (rest == 1)


#: Length of the account numbers of each country that issues any.
IBAN_LENGTHS = dict(x.split(":") for x in (
    "AD:24 AE:23 AL:28 AT:20 AZ:28 BA:20 BE:16 BG:22 BH:22 BI:27 BR:29 BY:28 CH:21 CR:22 CY:28 CZ:24 DE:22 DJ:27 DK:18 DO:28 EE:20 "
    "EG:29 ES:24 FI:18 FK:18 FO:18 FR:27 GB:22 GE:22 GI:23 GL:18 GR:27 GT:28 HN:28 HR:21 HU:28 IE:22 IL:23 IQ:23 IS:26 IT:27 JO:30 "
    "KW:30 KZ:20 LB:28 LC:32 LI:21 LT:20 LU:20 LV:21 LY:25 MC:27 MD:24 ME:22 MK:19 MN:20 MR:27 MT:31 MU:30 NI:28 NL:18 NO:15 OM:23 "
    "PK:24 PL:28 PS:29 PT:25 QA:29 RO:24 RS:22 RU:33 SA:24 SC:31 SD:18 SE:24 SI:19 SK:24 SM:27 SO:23 ST:25 SV:28 TL:23 TN:24 TR:26 "
    "UA:29 VA:22 VG:24 XK:20 YE:30").split())


def account_numbers() -> str:
    """Spans of the country's length, or else up to where no more or another country's number follows."""
    by_length = {n: "|".join(c for c, m in IBAN_LENGTHS.items() if m == n) for n in sorted(set(IBAN_LENGTHS.values()))}
    fixed = "|".join(rf"(?:{c})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{int(n) - 4}}}" for n, c in by_length.items())
    head = rf"(?:{'|'.join(IBAN_LENGTHS)})[0-9]{{2}}"
    other = rf"[A-Z]{{2}}[0-9]{{2}}(?:(?!\x20{head})\x20?[A-Z0-9]){{11,30}}+"
    return rf"(?<![A-Za-z0-9])(?:(?:{fixed})(?![A-Za-z0-9])|{other}(?![A-Za-z0-9]))"


def issued(match: Column) -> Column:
    return ~match.rlike("^(?:000|666|9[0-9][0-9])|-00-|-0000$")


@dataclass(frozen=True)
class Kind:
    """One kind: ``pattern`` proposes, ``confirm`` decides, ``context`` words add to ``score``.

    ``hint`` is a cheaper pattern that every text with a match also matches.
    """

    name: str
    pattern: str
    hint: str
    confirm: Callable[[Column], Column]
    score: float
    context: str
    base: bool = True


LOCAL = r"[A-Za-z0-9._%+-]"
BASE_KINDS = (
    Kind("email", rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@",
         lambda m: F.lit(True), 0.9, "mail|contact|write|address"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]",
         octets, 0.6, "ip|host|server|address|login"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9](?:[\x20-]?[0-9]){15}",
         luhn(16, 19), 0.8, "card|visa|master|credit|karte|carte|tarjeta"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]",
         phone_digits, 0.7, "phone|tel|call|mobile|fax|anruf"),
)
ADDED_KINDS = (
    Kind("iban", account_numbers(), r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]", mod97, 0.8, "iban|account|konto|compte|cuenta|bank", False),
    Kind("short_card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9](?:[\x20-]?[0-9]){12}",
         luhn(13, 15), 0.3, "card|visa|amex|diners|credit|karte|carte|tarjeta", False),
    Kind("us_ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
         issued, 0.3, "ssn|social|security|tax", False),
)
KINDS = BASE_KINDS + ADDED_KINDS
CONTEXT_BONUS = 0.3


def prefix_sums(lengths: Column) -> Column:
    """Sum of everything before each element, in blocks so that long arrays stay cheap."""
    total = lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x)
    n = F.size(lengths)

    def within(bases: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(bases, (i / PREFIX_BLOCK).cast("int")) + total(
            F.slice(lengths, (i / PREFIX_BLOCK).cast("int") * PREFIX_BLOCK + 1, i % PREFIX_BLOCK)))

    blocks = F.transform(F.sequence(F.lit(0), ((n - 1) / PREFIX_BLOCK).cast("int")),
                         lambda j: total(F.slice(lengths, j * PREFIX_BLOCK + 1, F.lit(PREFIX_BLOCK))))
    bases = let(blocks, lambda b: F.transform(F.sequence(F.lit(0), F.size(b) - 1),
                                              lambda j: total(F.slice(b, F.lit(1), j))))
    return let(bases, within)


def near_context(gaps: Column, matches: Column, kind: Kind, body: Callable[[Callable[[Column], Column]], Column]) -> Column:
    """``body`` with a function that tells whether context words come before a match, by its place.

    Each gap and match is cut to its last characters once, so long texts stay cheap.
    """
    def tail(gap: Column, match: Column) -> Column:
        end = F.right(match, F.lit(CONTEXT_CHARS))
        end = F.when(kind.confirm(match), F.regexp_replace(end, "(?s).", TAKEN)).otherwise(end)
        return F.concat(F.translate(F.right(gap, F.lit(CONTEXT_CHARS)), TAKEN, " "), F.coalesce(end, F.lit("")))

    words = rf"(?s)(?:{kind.context})(?!.*{TAKEN}[^{TAKEN}]*\p{{L}})"

    def near(tails: Column) -> Callable[[Column], Column]:
        def at(i: Column) -> Column:
            first = F.greatest(i - CONTEXT_PIECES, F.lit(0))
            before = F.concat(F.array_join(F.slice(tails, first + 1, i - first), ""), F.right(F.get(gaps, i), F.lit(CONTEXT_CHARS)))
            return F.lower(F.right(before, F.lit(CONTEXT_CHARS))).rlike(words)

        return at

    return let(F.zip_with(gaps, matches, tail), lambda tails: body(near(tails)))


def kind_spans(text: Column, kind: Kind) -> Column:
    """array<struct<kind, start, end, score>> of one kind, in text order.

    ``split`` gives the gaps and ``regexp_extract_all`` the matches of the same scan, so start
    positions are running sums of their lengths.
    """
    matches = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    gaps = F.split(text, kind.pattern, -1)

    def found(gaps: Column, matches: Column, before: Column, near: Callable[[Column], Column]) -> Column:
        def one(m: Column, i: Column) -> Column:
            gap = F.get(gaps, i)
            start = F.get(before, i) + F.length(gap)
            return F.struct(
                F.lit(kind.name).alias("kind"), start.cast("long").alias("start"),
                (start + F.length(m)).cast("long").alias("end"),
                (F.lit(kind.score) + F.when(near(i), CONTEXT_BONUS).otherwise(0.0)).alias("score"),
                kind.confirm(m).alias("confirmed"))

        spans = F.filter(F.transform(matches, one),
                         lambda s: s["confirmed"] & (F.lit(kind.base) | (s["score"] >= MIN_SCORE)))
        return F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"),
                                                     s["end"].alias("end"), s["score"].alias("score")))

    lengths = lambda g, m: F.zip_with(g, m, lambda a, b: F.length(a) + F.coalesce(F.length(b), F.lit(0)))
    spans = let(gaps, lambda g: let(matches, lambda m: let(
        prefix_sums(lengths(g, m)), lambda before: near_context(g, m, kind, lambda near: found(g, m, before, near)))))
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,score:double>>")
    return F.when(text.rlike(kind.hint), spans).otherwise(none)


def masked(text: Column, kind: Kind) -> Column:
    """The text with every confirmed span of one kind replaced by its upper-case name in brackets."""
    matches = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    gaps = F.split(text, kind.pattern, -1)

    def replaced(gaps: Column, matches: Column, near: Callable[[Column], Column]) -> Column:
        def piece(gap: Column, i: Column) -> Column:
            match = F.get(matches, i)
            keep = kind.confirm(match)
            if not kind.base:
                keep = keep & (F.lit(kind.score) + F.when(near(i), CONTEXT_BONUS).otherwise(0.0) >= MIN_SCORE)
            return F.concat(gap, F.when(match.isNull(), "").when(keep, f"[{kind.name.upper()}]").otherwise(match))

        return F.array_join(F.transform(gaps, piece), "")

    if kind.base or kind.score >= MIN_SCORE:  # kept whatever the context
        pieces = let(matches, lambda m: replaced(gaps, m, lambda i: F.lit(False)))
    else:
        pieces = let(gaps, lambda g: let(matches, lambda m: near_context(g, m, kind, lambda near: replaced(g, m, near))))
    return F.when(text.rlike(kind.hint), pieces).otherwise(text)


def find_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Every input column and ``pii``, one array per kind in the order of ``KINDS``.

    A null text has no spans. Existing columns named ``pii`` are replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumn("pii", F.array(*[kind_spans(text, k) for k in KINDS]))


def mask_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows with personal data masked in ``text_col``; null stays null.

    Kinds are masked one after the other in the order of ``KINDS``, each in what the ones
    before have left.
    """
    out = plain(docs, (text_col,))
    for kind in KINDS:
        out = out.withColumn(text_col, masked(F.col(text_col), kind))
    return out.toDF(*docs.columns)


def span_list(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii_digest(docs: DataFrame) -> DataFrame:
    """One row per document with counts and positions, as ``op1_pii`` returns them."""
    found = find_pii(plain(docs).select("doc_id", "text")).select("doc_id", "pii")
    base = len(BASE_KINDS)
    counts = [F.size(F.get("pii", F.lit(i))).cast("long").alias(f"n_{k.name}") for i, k in enumerate(BASE_KINDS)]
    return found.select(
        "doc_id", *counts,
        F.sha2(span_list(F.flatten(F.slice("pii", 1, base))).cast("binary"), 256).alias("base_sha256"),
        span_list(F.flatten("pii")).alias("spans"))
