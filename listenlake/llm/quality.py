"""Quality rules: a threshold table compiled into one projection.

Null text counts as empty.  Every row is judged by itself, so repeated rows and
ties get equal verdicts, an empty table gives an empty result, and extra columns
stay as they are; a column named like a result is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listenlake.llm.text import GAP, let, words

# Frequent function words of the four languages.
STOP_WORDS = (
    "the", "be", "to", "of", "and", "that", "have", "with", "is", "in", "for", "it", "on", "as", "was", "this", "a", "an",
    "der", "die", "das", "und", "ist", "nicht", "mit", "von", "zu", "den", "im", "ein", "eine", "auf", "für", "dem", "sich",
    "le", "la", "les", "des", "et", "est", "un", "une", "du", "en", "que", "pas", "sur", "de", "il", "elle", "dans",
    "el", "los", "las", "y", "se", "del", "no", "por", "con", "para", "al", "es", "lo", "su", "como",
)


@dataclass(frozen=True)
class Rule:
    """A measure must lie between `least` and `most`; a measure with no value passes."""

    measure: str
    least: float | None = None
    most: float | None = None


RULES = (
    Rule("word_length", least=1.5, most=14.0),
    Rule("symbol_ratio", most=0.1),
    Rule("exclaim_ratio", most=0.3),
    Rule("stop_ratio", least=0.01),
    Rule("dup_line_ratio", most=0.5),
    Rule("ellipsis_line_ratio", most=0.5),
    Rule("bullet_line_ratio", most=0.9),
)


def repeated_words(found: Column) -> Column:
    """Words inside any three-word window that occurs twice or more.

    Windows are sorted with their places; a window equal to a neighbour marks its three places.
    """
    def mark(ordered: Column) -> Column:
        twice = F.filter(F.sequence(F.lit(0), F.size(ordered) - 1), lambda k: (
            (F.get(ordered, k)["g"] == F.get(ordered, k - 1)["g"]) | (F.get(ordered, k)["g"] == F.get(ordered, k + 1)["g"])
        ))
        places = F.flatten(F.transform(twice, lambda k: let(
            F.get(ordered, k)["p"], lambda p: F.array(p, p + 1, p + 2)
        )))
        return F.size(F.array_distinct(places))

    def windows(w: Column) -> Column:
        return F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(
            F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("g"), i.alias("p")
        )))

    return let(found, lambda w: F.when(F.size(w) < 4, 0).otherwise(let(windows(w), mark)))


def measures(text: Column) -> Column:
    """Counts of one text as a struct: words, characters, symbols, stop words, lines."""
    body = F.coalesce(text, F.lit(""))
    chars = lambda pattern: F.length(F.regexp_replace(body, pattern, ""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(F.struct(words(body).alias("w"), lines.alias("l")), lambda x: F.struct(
        F.size(x["w"]).cast("long").alias("n_words"),
        chars(GAP).cast("long").alias("word_chars"),
        chars(r"[^#*$%&|<>]+").cast("long").alias("n_symbols"),
        chars(r"[^!]+").cast("long").alias("n_exclaims"),
        F.size(F.filter(x["w"], lambda v: F.lower(v).isin(*STOP_WORDS))).cast("long").alias("n_stop"),
        F.size(x["l"]).cast("long").alias("n_lines"),
        (F.size(x["l"]) - F.size(F.array_distinct(x["l"]))).cast("long").alias("n_dup_lines"),
        F.size(F.filter(x["l"], lambda v: v.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$"))).cast("long").alias("n_ellipsis"),
        F.size(F.filter(x["l"], lambda v: v.rlike(r"^[\x20\x09-\x0D]*[-*•]"))).cast("long").alias("n_bullets"),
        repeated_words(x["w"]).cast("long").alias("n_repeat_words"),
    ))


#: Every measure a rule may name, over the counts of a text.
RATIOS = {
    "word_length": lambda m: m["word_chars"] / m["n_words"],
    "symbol_ratio": lambda m: m["n_symbols"] / m["n_words"],
    "exclaim_ratio": lambda m: m["n_exclaims"] / m["n_words"],
    "stop_ratio": lambda m: m["n_stop"] / m["n_words"],
    "dup_line_ratio": lambda m: m["n_dup_lines"] / m["n_lines"],
    "ellipsis_line_ratio": lambda m: m["n_ellipsis"] / m["n_lines"],
    "bullet_line_ratio": lambda m: m["n_bullets"] / m["n_lines"],
}


def passes(counts: Column, rules: tuple[Rule, ...]) -> Column:
    """The rule table as one boolean expression."""
    verdict = F.lit(True)
    for rule in rules:
        ratio = RATIOS[rule.measure]({name: F.nullif(counts[name], F.lit(0)) if name in ("n_words", "n_lines")
                                      else counts[name] for name in
                                      ("n_words", "word_chars", "n_symbols", "n_exclaims", "n_stop", "n_lines",
                                       "n_dup_lines", "n_ellipsis", "n_bullets")})
        if rule.least is not None:
            verdict = verdict & F.coalesce(ratio >= rule.least, F.lit(True))
        if rule.most is not None:
            verdict = verdict & F.coalesce(ratio <= rule.most, F.lit(True))
    return verdict


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """`docs` with the counts, `base_failed` and `kept`; one projection, no shuffle.

    Too short (under 50 words) or mostly repeated three-word windows fails at once;
    otherwise all of `rules` must hold.
    """
    counted = docs.withColumn("_counts", measures(F.col(text)))
    counts = F.col("_counts")
    failed = (counts["n_words"] < 50) | (100 * counts["n_repeat_words"] > 50 * counts["n_words"])
    return counted.withColumns({
        **{name: counts[name] for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")},
        "base_failed": failed,
        "kept": ~failed & passes(counts, rules),
    }).drop("_counts")
