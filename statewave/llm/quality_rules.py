"""Quality rules: a threshold table compiled into one projection of column expressions.

Each rule compares two counts by integer arithmetic, so that verdicts don't depend on rounding.
Null texts count as empty. All counts are over the whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statewave.llm.text import let, plain, words

#: Common function words of the four languages of the corpus.
STOP_WORDS = (
    "the be to of and that have with in is for "  # English
    "der die und das den von zu mit ist ein nicht "  # German
    "le la les de et des que un une est dans "  # French
    "el los las del y en por con una para se"  # Spanish
).split()


@dataclass(frozen=True)
class Rule:
    """Fails where ``100 * value > percent * per`` (or ``<`` for ``least``); ``per`` may be a number."""

    name: str
    value: str
    percent: int
    per: str | int
    least: bool = False
    base: bool = False

    def failed(self, m: dict[str, Column]) -> Column:
        per = F.lit(self.per) if isinstance(self.per, int) else m[self.per]
        left, right = m[self.value] * 100, per * self.percent
        return left < right if self.least else left > right


RULES = (
    Rule("few_words", "n_words", 100, 50, least=True, base=True),
    Rule("repeated_words", "n_repeat_words", 50, "n_words", base=True),
    Rule("short_words", "word_chars", 200, "n_words", least=True),
    Rule("long_words", "word_chars", 2000, "n_words"),
    Rule("symbols", "n_symbols", 20, "n_words"),
    Rule("duplicate_lines", "n_dup_lines", 50, "n_lines"),
    Rule("ellipsis_lines", "n_ellipsis_lines", 50, "n_lines"),
    Rule("few_stop_words", "n_stop_words", 100, 2, least=True),
)


def with_equal_neighbour(ordered: Column, field: str) -> Column:
    """Elements of a sorted array of structs that agree in ``field`` with the one before or after."""
    same = lambda x, j: F.coalesce(F.get(ordered, j)[field] == x[field], F.lit(False))
    return F.filter(ordered, lambda x, i: same(x, i - 1) | same(x, i + 1))


def repeated_positions(tokens: Column) -> Column:
    """Words that lie in a three-word window found twice or more.

    Hashes of all windows, sorted with their places, show which may repeat: different windows
    may share a hash, equal ones always do. The windows at those places are then compared as
    text, and the words of all that do repeat are counted once.
    """
    windows = F.arrays_zip(tokens, F.slice(tokens, F.lit(2), F.size(tokens)), F.slice(tokens, F.lit(3), F.size(tokens)))
    hashes = F.transform(windows, lambda w: F.xxhash64(w))

    def count(ordered: Column) -> Column:
        covered = F.flatten(F.transform(with_equal_neighbour(ordered, "g"),
                                        lambda x: F.array(x["p"], x["p"] + 1, x["p"] + 2)))
        return F.size(F.array_distinct(covered))

    def of_hashes(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        grams = F.transform(let(placed, lambda o: with_equal_neighbour(o, "h")), lambda x: F.struct(
            F.concat_ws(" ", *[F.get(tokens, x["p"] + k) for k in range(3)]).alias("g"), x["p"].alias("p")))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(F.sort_array(grams), count))

    return F.when(F.size(tokens) < 4, F.lit(0)).otherwise(let(hashes, of_hashes))


def of_words(tokens: Column) -> Column:
    return F.struct(
        F.size(tokens).cast("long").alias("n_words"),
        F.length(F.array_join(tokens, "")).cast("long").alias("word_chars"),
        repeated_positions(tokens).cast("long").alias("n_repeat_words"),
        F.size(F.array_intersect(tokens, F.array(*map(F.lit, STOP_WORDS)))).cast("long").alias("n_stop_words"))


def of_lines(lines: Column) -> Column:
    return F.struct(
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.size(F.filter(lines, lambda x: x.rlike(r"(?:\.\.\.|…)[\x20\x09-\x0D]*\z"))).cast("long").alias("n_ellipsis_lines"))


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Every input column and the counts in ``__words``, ``__lines`` and ``__symbols``.

    The counts are columns of their own and not fields of one struct, which the optimizer would
    take apart and evaluate once for each use.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return docs.withColumns({
        "__words": let(words(text), of_words),
        "__lines": let(lines, of_lines),
        "__symbols": (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))).cast("long")})


def counts() -> dict[str, Column]:
    """The counts of ``measured`` by name."""
    fields = {"__words": ("n_words", "word_chars", "n_repeat_words", "n_stop_words"),
              "__lines": ("n_lines", "n_dup_lines", "n_ellipsis_lines")}
    return ({n: F.col(c)[n] for c, names in fields.items() for n in names}
            | {"n_symbols": F.col("__symbols")})


def any_failed(rules: tuple[Rule, ...]) -> Column:
    failed = F.lit(False)
    for rule in rules:
        failed = failed | rule.failed(counts())
    return failed


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Documents that fail no rule, with their own columns."""
    own = plain(docs)
    return measured(own).where(~any_failed(rules)).select(*own.columns).toDF(*docs.columns)


def rules_digest(docs: DataFrame) -> DataFrame:
    """One row per document, as ``op7_quality_rules`` returns it."""
    base = tuple(r for r in RULES if r.base)
    shown = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return measured(plain(docs).select("doc_id", "text")).select(
        "doc_id", *[counts()[n].alias(n) for n in shown],
        any_failed(base).alias("base_failed"), (~any_failed(RULES)).alias("kept"))
