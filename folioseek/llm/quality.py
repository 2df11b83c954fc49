"""Quality rules as a short-circuit cascade, in column functions only.

Every rule says what it looks at (one row, each character or each word) and
what that costs for one of them. A sample of the documents gives the mean cost
of a rule and the share of documents that it rejects; rules are then asked in
the order of rejections per cost, and a document is not shown to the rules
behind the one that rejects it. The order changes how much is computed and
which rule is named, never the verdict.

A null or empty text has no words and fails the base rule. Columns other than
those named are passed on as they are; if one has the name of a result, the
result replaces it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from folioseek.llm.common import WHITE, let, words

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
SAMPLE_ROWS = 2000


@dataclass(frozen=True)
class Rule:
    """``rejects`` is a condition on text, words and measures; ``unit`` is row, char or word, ``price`` the cost of one."""

    name: str
    rejects: Callable[[], Column]
    unit: str = "row"
    price: float = 1.0


def _letters() -> Column:
    return F.length(F.regexp_replace("text", r"[^\p{L}]", ""))


def _capitals() -> Column:
    return F.length(F.regexp_replace("text", r"[^\p{Lu}]", ""))


def _stutters() -> Column:
    found = F.col("words")
    return F.size(F.filter(found, lambda word, i: word == F.get(found, i - 1)))


RULES = (
    Rule("symbols", lambda: 10 * F.col("n_symbols") > F.col("n_words")),
    Rule("repeated_lines", lambda: 100 * F.col("n_dup_lines") > 40 * F.col("n_lines")),
    Rule("short_words", lambda: 2 * F.col("word_chars") < 5 * F.col("n_words")),
    Rule("long_words", lambda: F.col("word_chars") > 14 * F.col("n_words")),
    Rule("capitals", lambda: 2 * _capitals() > _letters(), "char", 0.08),
    Rule("no_letters", lambda: 2 * _letters() < F.col("word_chars"), "char", 0.04),
    Rule("stutter", lambda: 5 * _stutters() > F.col("n_words"), "word", 0.15),
)


def _covered(windows: Column) -> Column:
    """How many words lie in a window that occurs twice, given the hashes of all windows in order."""

    def of(placed: Column) -> Column:
        again = F.filter(
            placed, lambda x, i: (F.get(placed, i - 1)["hash"] == x["hash"]) | (F.get(placed, i + 1)["hash"] == x["hash"])
        )
        starts = F.sort_array(F.transform(again, lambda x: x["at"]))
        return let(
            starts,
            lambda at: F.aggregate(
                F.transform(at, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - x, F.lit(WINDOW)))),
                F.lit(0),
                lambda total, x: total + x,
            ),
        )

    placed = F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("hash"), i.alias("at"))))
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), let(placed, of)).otherwise(F.lit(0))


def repeated_words(found: Column) -> Column:
    """The words in windows of eight that occur twice or more in the text, the first occurrence included."""

    def of(hashes: Column) -> Column:
        last = F.greatest(F.size(hashes) - WINDOW, F.lit(0))
        windows = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)]))
        return let(windows, _covered)

    return F.when(F.size(found) <= WINDOW, F.lit(0)).otherwise(let(F.transform(found, lambda w: F.xxhash64(w)), of))


def measured(documents: DataFrame) -> DataFrame:
    """The documents with their words and the numbers that rules look at."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: F.translate(line, WHITE, "") != "")
    with_words = documents.withColumns({"text": text, "words": words(F.col("text")), "lines": lines})
    return with_words.select(
        *[c for c in documents.columns if c not in {"text", "words", "lines", *MEASURES}],
        "text",
        "words",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", WHITE, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).cast("long").alias("n_repeat_words"),
    )


MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", "rejected_by", "kept")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def ordered_rules(documents: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules in the order of rejections per cost on a sample of about ``sample_rows`` documents that pass the base rule.

    Rows are sampled over the whole table by chance with a fixed seed. An empty
    sample leaves the rules in their order, as ties do.
    """
    rows = documents.count()
    if not rows or not rules:
        return list(rules)
    sample = measured(documents.select("text").sample(min(1.0, sample_rows / rows), seed=7)).where(~base_failed())
    cost = {"row": F.lit(1.0), "char": F.length("text").cast("double"), "word": F.col("n_words").cast("double")}
    found = sample.agg(
        *[F.avg(F.coalesce(rule.rejects(), F.lit(False)).cast("double")).alias(f"rate{i}") for i, rule in enumerate(rules)],
        *[(F.avg(cost[rule.unit]) * rule.price).alias(f"cost{i}") for i, rule in enumerate(rules)],
    ).first()
    worth = [(found[f"rate{i}"] or 0.0) / max(found[f"cost{i}"] or 1.0, 1e-9) for i in range(len(rules))]
    return [rules[i] for i in sorted(range(len(rules)), key=lambda i: (-worth[i], i))]


def judged(documents: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents with their measures, ``base_failed``, the first rule that rejects them (``rejected_by``) and ``kept``."""
    order = ordered_rules(documents, rules, sample_rows)
    verdict = F.when(F.col("base_failed"), F.lit("base"))
    for rule in order:
        verdict = verdict.when(rule.rejects(), F.lit(rule.name))
    return (
        measured(documents)
        .withColumn("base_failed", base_failed())
        .withColumn("rejected_by", verdict)
        .withColumn("kept", F.col("rejected_by").isNull())
        .drop("words")
    )
