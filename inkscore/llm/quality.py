"""Quality rules learned as a decision list, in DataFrame operations alone.

Sequential covering over labelled rows: a rule for poor documents is grown
condition by condition (feature above or below a threshold) to the best gain,
counted by one aggregation over binned features; it is pruned on rows set aside,
and what it covers is left out before the next rule is grown. The list is one
Spark conditional expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fold, settle

SPACE = " \t\n\x0b\f\r"
SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIGITS = "0123456789"
WINDOW = 5
BINS = 24
RULES = 8
CONDITIONS = 3
FEATURES = (
    "n_words",
    "mean_word_chars",
    "symbols_per_word",
    "dup_line_share",
    "repeat_share",
    "upper_share",
    "digit_share",
    "exclaim_per_word",
    "comma_per_word",
    "words_per_line",
    "distinct_share",
)


def _without(text: Column, characters: str) -> Column:
    """How many of ``characters`` the text has."""
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once for each row."""
    return F.transform(F.array(value), use)[0]


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words in windows that are found twice or more in the same array.

    Windows are sorted with their places, so equal ones are neighbours; the
    places found are sorted again, and what each adds to the cover is summed.
    """

    def hashed(w: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(w) - window)
        pair = lambda i: F.struct(
            F.xxhash64(*[F.get(w, i + k) for k in range(window)]).alias("h"), i.alias("i")
        )
        return F.sort_array(F.transform(places, pair))

    def twice(pairs: Column) -> Column:
        def near(x: Column, j: Column) -> Column:
            before, after = F.get(pairs, j - 1), F.get(pairs, j + 1)
            return (x["h"].eqNullSafe(before["h"])) | (x["h"].eqNullSafe(after["h"]))

        return F.sort_array(F.transform(F.filter(pairs, near), lambda x: x["i"]))

    def covered(places: Column) -> Column:
        start = F.struct(F.lit(-window).alias("last"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(
            places,
            start,
            lambda a, p: F.struct(
                p.alias("last"), (a["n"] + F.least(F.lit(window), p - a["last"])).alias("n")
            ),
            lambda a: a["n"],
        )

    count = _bound(words, lambda w: _bound(hashed(w), lambda s: covered(twice(s))))
    return F.when(F.size(words) > window, count).otherwise(F.lit(0).cast("long"))


def measures(docs: DataFrame) -> DataFrame:
    """Counts and features of each row's whole text; see :func:`rate_quality`."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.filter(F.split("text", SPACES), lambda w: w != "")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    held = base.select("doc_id", "text", words.alias("words"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, SPACE, "")) > 0)
    counted = held.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", SPACE, "")).cast("long").alias("word_chars"),
        _without(F.col("text"), SYMBOLS).cast("long").alias("n_symbols"),
        _bound(
            lines,
            lambda x: F.struct(
                (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup"),
                F.size(x).cast("long").alias("n"),
            ),
        ).alias("lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        _without(F.col("text"), UPPER).alias("n_upper"),
        _without(F.col("text"), DIGITS).alias("n_digits"),
        _without(F.col("text"), "!").alias("n_exclaim"),
        _without(F.col("text"), ",").alias("n_comma"),
    )
    per_word = lambda c: F.coalesce(F.col(c) / F.col("n_words"), F.lit(0.0))
    per_char = lambda c: F.coalesce(F.col(c) / F.col("word_chars"), F.lit(0.0))
    per_line = lambda c: F.coalesce(c / F.col("lines.n"), F.lit(0.0))
    guarded = counted.withColumns(
        {
            "n_words": F.nullif("n_words", F.lit(0)),
            "word_chars": F.nullif("word_chars", F.lit(0)),
            "lines": F.struct(
                F.col("lines.n_dup").alias("n_dup"), F.nullif("lines.n", F.lit(0)).alias("n")
            ),
        }
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    return guarded.select(
        "doc_id",
        zero("n_words").alias("n_words"),
        zero("word_chars").alias("word_chars"),
        "n_symbols",
        F.col("lines.n_dup").alias("n_dup_lines"),
        "n_repeat_words",
        F.struct(
            zero("n_words").cast("double").alias("n_words"),
            per_word("word_chars").alias("mean_word_chars"),
            per_word("n_symbols").alias("symbols_per_word"),
            per_line(F.col("lines.n_dup")).alias("dup_line_share"),
            per_word("n_repeat_words").alias("repeat_share"),
            per_char("n_upper").alias("upper_share"),
            per_char("n_digits").alias("digit_share"),
            per_word("n_exclaim").alias("exclaim_per_word"),
            per_word("n_comma").alias("comma_per_word"),
            per_line(F.col("n_words")).alias("words_per_line"),
            per_word("n_distinct").alias("distinct_share"),
        ).alias("features"),
    )


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.col(f"features.{self.feature}")
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:g}"


Rule = tuple[Condition, ...]


def all_of(rule: Rule) -> Column:
    met = F.lit(True)
    for condition in rule:
        met = met & condition.column()
    return met


def verdict(rules: list[Rule]) -> Column:
    """True where no rule for poor documents applies: an ordered conditional."""
    decided: Column | None = None
    for rule in rules:
        decided = (F if decided is None else decided).when(all_of(rule), F.lit(False))
    return F.lit(True) if decided is None else decided.otherwise(F.lit(True))


def _round(value: float) -> float:
    return float(f"{value:.3g}")


def _thresholds(rows: DataFrame, bins: int) -> dict[str, list[float]]:
    """Rounded quantiles of each feature."""
    shares = [i / bins for i in range(1, bins)]
    quantiles = [
        F.percentile_approx(F.col(f"features.{f}"), shares, 10_000).alias(f) for f in FEATURES
    ]
    row = rows.agg(*quantiles).first()
    return {f: sorted({_round(q) for q in row[f] or ()}) for f in FEATURES}


def _counts(rows: DataFrame, cuts: dict[str, list[float]]) -> dict[str, dict[int, tuple]]:
    """Poor and good rows of each feature's bins, pre-aggregated in one pass."""

    def bin_of(f: str) -> Column:
        value = F.col(f"features.{f}")
        steps = F.array(*[F.lit(c) for c in cuts[f]])
        return F.size(F.filter(steps, lambda c: c < value))

    if not any(cuts.values()):
        return {}
    binned = F.array(
        *[F.struct(F.lit(f).alias("feature"), bin_of(f).alias("bin")) for f in FEATURES if cuts[f]]
    )
    found = (
        rows.select("poor", F.inline(binned))
        .groupBy("feature", "bin")
        .agg(F.sum("poor").alias("p"), F.sum(1 - F.col("poor")).alias("n"))
        .collect()
    )
    counts: dict[str, dict[int, tuple]] = {}
    for row in found:
        counts.setdefault(row["feature"], {})[row["bin"]] = (row["p"], row["n"])
    return counts


def _best_condition(counts: dict, cuts: dict[str, list[float]]) -> Condition | None:
    """The condition of the largest gain in information over the covered poor rows."""
    best, best_gain = None, 1e-9
    for feature in FEATURES:
        bins = counts.get(feature)
        if not bins:
            continue
        p_all, n_all = (sum(b[k] for b in bins.values()) for k in (0, 1))
        if not p_all:
            return None
        before = math.log2(p_all / (p_all + n_all))
        p_low = n_low = 0
        for i, cut in enumerate(cuts[feature]):
            p, n = bins.get(i, (0, 0))
            p_low, n_low = p_low + p, n_low + n
            for above, p, n in ((False, p_low, n_low), (True, p_all - p_low, n_all - n_low)):
                if p:
                    gain = p * (math.log2(p / (p + n)) - before)
                    if gain > best_gain:
                        best, best_gain = Condition(feature, above, cut), gain
    return best


def _prune(rule: Rule, rows: DataFrame) -> tuple[Rule, float]:
    """The beginning of the rule that separates best on rows set aside, and how well."""
    sums = []
    for i in range(1, len(rule) + 1):
        met = all_of(rule[:i]).cast("long")
        sums += [
            F.coalesce(F.sum(met * F.col("poor")), F.lit(0)).alias(f"p{i}"),
            F.coalesce(F.sum(met * (1 - F.col("poor"))), F.lit(0)).alias(f"n{i}"),
        ]
    row = rows.agg(*sums).first()
    worth = [
        ((row[f"p{i}"] - row[f"n{i}"]) / (row[f"p{i}"] + row[f"n{i}"] + 1.0), -i)
        for i in range(1, len(rule) + 1)
    ]
    value, i = max(worth)
    return rule[:-i], value


def learn_rules(
    labelled: DataFrame, rules: int = RULES, conditions: int = CONDITIONS, bins: int = BINS
) -> list[Rule]:
    """Rules for poor documents, in order.

    ``labelled`` has features, poor (1 or 0) and set_aside (for pruning). A rule that
    is no better than chance on the rows set aside ends the list. Only counts of
    bins come to the driver: features times bins rows for each condition.
    """
    found: list[Rule] = []
    cuts = _thresholds(labelled, bins)
    left = labelled
    while len(found) < rules:
        rule: Rule = ()
        inside = left.where(~F.col("set_aside"))
        while len(rule) < conditions:
            condition = _best_condition(_counts(inside.where(all_of(rule)), cuts), cuts)
            if condition is None or condition in rule:
                break
            rule = (*rule, condition)
        if not rule:
            break
        rule, worth = _prune(rule, left.where("set_aside"))
        if worth <= 0:
            break
        found.append(rule)
        left = left.where(~all_of(rule))
    return found


def rate_quality(docs: DataFrame, labels: DataFrame, **shape: int) -> DataFrame:
    """Counts and verdict of each row: doc_id, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, kept, rule, features.

    Learns from all labels of 0 or 1, pruning on those whose fold of five is 1.
    ``rule`` is the number of the rule that applies, from 1, or null. A null text
    counts as empty and fails the base rules; null labels and ids without a
    document are left out, every label of several of one id counts; without labels
    the list is empty and keeps all; repeated rows are rated each; a null id stays
    null and has no label; an empty table gives no rows.
    """
    rated = settle(measures(docs), "measures")
    known = labels.where(F.col("quality").isin(0, 1)).select(
        F.col("doc_id").cast("long").alias("_id"), (1 - F.col("quality")).cast("long").alias("poor")
    )
    labelled = rated.join(known, F.col("doc_id") == F.col("_id")).select(
        "features", "poor", (fold("doc_id", 5) == 1).alias("set_aside")
    )
    rules = learn_rules(settle(labelled, "labelled"), **shape)
    base_failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    number = F.lit(None).cast("int")
    for i, rule in reversed(list(enumerate(rules, 1))):
        number = F.when(all_of(rule), F.lit(i)).otherwise(number)
    return rated.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base_failed.alias("base_failed"),
        (~base_failed & verdict(rules)).alias("kept"),
        number.alias("rule"),
        "features",
    )
