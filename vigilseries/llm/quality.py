"""Quality rules: a table of thresholds compiled into one projection of built-in functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilseries.llm.text import WORD, column, let, whole, word_array

SYMBOLS = "#*$%&|<>"
WINDOW = 5
BLOCK = 1_000  # words within which different words are counted

# Frequent function words of the four languages, in ASCII lower case (fixed values).
STOP_WORDS = (
    "the of and to in is that it for on with as was be by at or are this from "
    "der die das und ist im den mit von zu ein eine nicht sich auf als auch dem des für "
    "le la les de du et en un une est que qui dans pour par sur pas au avec "
    "el los las y que se del por con una su para es lo como más"
).split()

STOP_FORMS = list(dict.fromkeys([*STOP_WORDS, *[w.capitalize() for w in STOP_WORDS]]))


@dataclass(frozen=True)
class Rule:
    """A document passes if ``low <= 100 * part / total <= high``, cross-multiplied so that no
    division rounds; with ``total`` ``one`` the part itself is judged."""

    name: str
    part: str
    total: str
    low: int | None
    high: int | None
    from_words: int = 0  # shorter texts are not judged by this rule


# The thresholds keep labelled clean prose of all four languages; see tests/llm/test_quality.py.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 200, 1500),
    Rule("symbols_per_word", "n_symbols", "n_words", None, 15, 10),
    Rule("stop_words", "n_stop_words", "n_words", 3, None, 50),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 50),
    Rule("capitals", "n_capitals", "word_chars", None, 40, 10),
    Rule("distinct_words", "n_distinct_words", "n_words", 10, None, 10),
)


def _repeat_words(words: Column) -> Column:
    """Words covered by windows of five that occur twice or more in the text."""
    begins = F.slice(words, F.lit(1), F.size(words) - (WINDOW - 1))

    def key(word: Column, i: Column) -> Column:
        return F.xxhash64(word, *[F.get(words, i + k) for k in range(1, WINDOW)])

    def marked(ordered: Column) -> Column:
        last = F.size(ordered)
        twice = F.filter(
            ordered,
            lambda x, k: ((k > 0) & (F.get(ordered, k - 1)["key"] == x["key"]))
            | ((k + 1 < last) & (F.get(ordered, k + 1)["key"] == x["key"])),
        )
        places = F.transform(
            twice, lambda x: F.array(*[x["at"] + k for k in range(WINDOW)])
        )
        return F.size(F.array_distinct(F.flatten(places)))

    def counted(keys: Column) -> Column:
        pairs = F.transform(
            keys, lambda h, k: F.struct(h.alias("key"), k.alias("at"))
        )
        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.lit(0)).otherwise(
            let(F.sort_array(pairs), marked)
        )

    return F.when(F.size(words) < WINDOW, F.lit(0)).otherwise(
        let(F.transform(begins, key), counted)
    )


def _distinct_words(words: Column) -> Column:
    """Different words of every block of words, added up: over a whole text their share would fall
    with its length."""
    last = F.greatest(F.floor((F.size(words) - 1) / BLOCK).cast("int"), F.lit(0))
    counts = F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.size(F.array_distinct(F.slice(words, i * BLOCK + 1, BLOCK))),
    )
    return F.aggregate(counts, F.lit(0), lambda total, n: total + n)


def _metrics(text: Column) -> Column:
    def of(words: Column) -> Column:
        lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(WORD)))
        return F.struct(
            F.size(words).alias("n_words"),
            F.length(F.array_join(words, "")).alias("word_chars"),
            F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).alias("n_symbols"),
            F.size(lines).alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"),
            _repeat_words(words).alias("n_repeat_words"),
            F.size(F.filter(words, lambda w: w.isin(STOP_FORMS))).alias("n_stop_words"),
            F.length(F.regexp_replace(text, r"\P{Lu}+", "")).alias("n_capitals"),
            _distinct_words(words).alias("n_distinct_words"),
        )

    return let(word_array(text), of)


def _passes(rule: Rule) -> Column:
    part, total = F.col(rule.part) * 100, F.lit(1) if rule.total == "one" else F.col(rule.total)
    ok = F.lit(True)
    if rule.low is not None:
        ok = ok & (part >= total * rule.low)
    if rule.high is not None:
        ok = ok & (part <= total * rule.high)
    return ok | (F.col("n_words") < rule.from_words)


METRICS = (
    "n_words word_chars n_symbols n_dup_lines n_repeat_words n_lines n_stop_words "
    "n_capitals n_distinct_words"
).split()


def judged(docs: DataFrame, text_column: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``row`` (all columns of ``docs``), the metrics, ``base_failed``, ``failed`` (names of the
    rules that reject) and ``kept``.

    A null is a text without words, which like every text of fewer than ten words fails the base.
    Repeated rows are judged alike; an empty table gives an empty result. Column names of ``docs``
    cannot clash, they stay inside ``row``.
    """
    row = F.struct(*[column(c) for c in docs.columns]).alias("row")
    # One generated row: a filter on the verdict stays above it, so the metrics are computed once.
    measured = docs.select(
        row, F.inline(F.array(_metrics(whole(column(text_column)))))
    ).select("row", *[F.col(m).cast("long").alias(m) for m in METRICS])
    base = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    failed = F.array_compact(
        F.array(*[F.when(~_passes(r), F.lit(r.name)) for r in rules])
    )
    return measured.select(
        "*",
        base.alias("base_failed"),
        failed.alias("failed"),
        (~base & (F.size(failed) == 0)).alias("kept"),
    )


def accepted(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """The documents that pass, with their columns."""
    good = judged(docs, text_column).where("kept")
    return good.select(*[F.col("row")[c].alias(c) for c in docs.columns])
