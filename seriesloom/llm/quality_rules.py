"""Quality rules: measures of a text and a threshold table, compiled into one projection of built-in functions.

Null and empty texts have no words; they fail the base rule. All measures are taken over whole texts, row by row, so
nothing is shuffled, repeated rows get equal verdicts and an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.tables import let

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
SPLIT = r"[\x20\x09-\x0D]+"
WINDOW = 5

#: Common words of the languages the corpus is written in (fixed values).
STOP_WORDS = (
    "the of and to in a is that for it as was with be by on not he his this are or from at an have "
    "de la le et les des en un une du que qui dans est pour par sur pas au avec "
    "der die und den von zu das mit sich auf für ist im dem nicht ein eine als "
    "el los las por con del se su para al es una y no lo"
).split()


@dataclass(frozen=True)
class Rule:
    """A text is rejected if ``measure`` lies outside ``[low, high]``; the rule holds from ``min_words`` words on."""

    measure: str
    low: float | None = None
    high: float | None = None
    min_words: int = 0


#: The production table. Ratios are per word unless the name says line.
RULES = (
    Rule("mean_word_chars", 1.5, 25.0),
    Rule("symbol_ratio", high=0.25),
    Rule("stop_word_ratio", low=0.06, min_words=50),
    Rule("dup_line_ratio", high=0.6),
)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPLIT), lambda w: w != "")


def lines_of(text: Column) -> Column:
    """The lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


def _window(words: Column, i: Column) -> list[Column]:
    return [F.get(words, i + j) for j in range(WINDOW)]


def repeated_words(w: Column) -> Column:
    """Number of words inside ``WINDOW``-word windows that are found twice or more.

    Most texts repeat nothing: if all window hashes differ, so do the windows. Else equal windows are brought together by
    sorting them as text, and the positions they cover are counted.
    """

    def exact(w: Column, starts: Column) -> Column:
        windows = F.transform(starts, lambda i: F.struct(F.array_join(F.slice(w, i + 1, WINDOW), " ").alias("t"), i.alias("i")))
        return let(F.array_sort(windows), covered)

    def covered(s: Column) -> Column:
        last = F.size(s) - 1
        again = F.filter(
            s,
            lambda x, k: ((k > 0) & (F.get(s, k - 1)["t"] == x["t"])) | ((k < last) & (F.get(s, k + 1)["t"] == x["t"])),
        )
        return let(F.array_sort(F.transform(again, lambda x: x["i"])), total)

    def total(at: Column) -> Column:
        gaps = F.transform(at, lambda x, k: F.least(F.coalesce(F.get(at, k + 1) - x, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(gaps, F.lit(0), lambda acc, g: acc + g)

    def by_hash(starts: Column) -> Column:
        hashes = F.transform(starts, lambda i: F.xxhash64(*_window(w, i)))
        same = let(hashes, lambda h: F.size(F.array_distinct(h)) == F.size(h))
        return F.when(same, F.lit(0)).otherwise(exact(w, starts))

    starts = F.sequence(F.lit(0), F.size(w) - WINDOW)
    return F.when(F.size(w) <= WINDOW, F.lit(0)).otherwise(let(starts, by_hash))


def measures(text: Column) -> Column:
    """Counts of a text as a struct; ``text`` must not be null."""
    plain = F.split(F.translate(F.lower(text), ".,", ""), SPLIT)
    return F.struct(
        let(words_of(text), lambda w: F.struct(F.size(w).alias("n"), repeated_words(w).alias("again"))).alias("words"),
        F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines_of(text), lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d"))).alias("lines"),
        F.size(F.filter(plain, lambda w: w.isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
    )


def ratios(at: Column) -> dict[str, Column]:
    words = F.greatest(at["n_words"], F.lit(1))
    return {
        "mean_word_chars": at["word_chars"] / words,
        "symbol_ratio": at["n_symbols"] / words,
        "stop_word_ratio": at["n_stop_words"] / words,
        "dup_line_ratio": at["n_dup_lines"] / F.greatest(at["n_lines"], F.lit(1)),
    }


def verdict(at: Column, rules: Sequence[Rule]) -> Column:
    """True if every rule of the table holds."""
    good, value = F.lit(True), ratios(at)
    for rule in rules:
        for bound, fits in ((rule.low, Column.__ge__), (rule.high, Column.__le__)):
            if bound is not None:
                good &= fits(value[rule.measure], F.lit(bound)) | (at["n_words"] < rule.min_words)
    return good


def quality(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """``docs`` with one struct column ``quality``: the measures, ``base_failed`` and ``kept``.

    The base rule comes first: fewer than 10 words, or more than a fifth of the words in repeated windows. Input columns
    of any name stay as they are, but for one called ``quality``, which is replaced.
    """
    q = F.col("quality")
    out = docs.withColumn("quality", measures(F.coalesce(F.col(text), F.lit(""))))
    out = out.withColumn(
        "quality",
        F.struct(
            q["words"]["n"].cast("long").alias("n_words"),
            q["word_chars"],
            q["n_symbols"],
            (q["lines"]["n"] - q["lines"]["d"]).cast("long").alias("n_dup_lines"),
            q["words"]["again"].cast("long").alias("n_repeat_words"),
            q["lines"]["n"].cast("long").alias("n_lines"),
            q["n_stop_words"],
        ),
    )
    failed = (q["n_words"] < 10) | (100 * q["n_repeat_words"] > 20 * q["n_words"])
    return out.withColumn(
        "quality", q.withField("base_failed", failed).withField("kept", ~failed & verdict(q, rules))
    )
