"""Quality rules: a table of thresholds, compiled into one projection over each text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import words_of

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "a an and are as at be by for from he in is it of on or that the this to was were with "
    "auf das dem den der des die ein eine für im in ist mit nicht sich und von zu "
    "dans de des du elle en est et il la le les par pas pour que qui sur un une "
    "con de del el en es la las lo los no para por que se su un una y"
).split()


@dataclass(frozen=True)
class Rule:
    """Fails a text of at least min_words words whose measure is under low or over high."""

    measure: str
    low: float | None = None
    high: float | None = None
    min_words: int = 0


#: The thresholds; each measure is a column of measures().
RULES = (
    Rule("n_words", low=20),
    Rule("repeat_ratio", high=0.30),
    Rule("mean_word_chars", low=1.5, high=20.0),
    Rule("symbol_ratio", high=0.30),
    Rule("dup_line_ratio", high=0.50),
    Rule("stop_ratio", low=0.02, min_words=50),
)


def measures(docs: DataFrame, text_col: str = "text", window: int = 8) -> DataFrame:
    """docs with the columns n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words and n_stop.

    Columns of docs with those names are replaced. All are 0 for a null or empty text. Repeated windows are found by
    sorting each text's window hashes (64 bits) with their places, so a text costs n log n, however often it repeats itself.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    docs = docs.withColumn("__words", words_of(F.col(text_col))).withColumn("__lines", lines)
    n = F.size("__words")
    grams = F.when(n >= window, F.transform(F.sequence(F.lit(1), n - window + 1), lambda i: F.struct(F.xxhash64(F.slice("__words", i, window)).alias("h"), i.alias("at"))))
    docs = docs.withColumn("__grams", F.sort_array(F.coalesce(grams, F.array().cast("array<struct<h:bigint,at:int>>"))))
    hits = F.filter("__grams", lambda x, i: F.coalesce(F.get(F.col("__grams"), i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(F.col("__grams"), i + 1)["h"] == x["h"], F.lit(False)))
    docs = docs.withColumn("__hits", F.sort_array(F.transform(hits, lambda x: x["at"])))
    start = F.struct(F.lit(0).alias("n"), F.lit(-1_000_000_000).alias("last"))
    covered = F.aggregate("__hits", start, lambda a, x: F.struct((a["n"] + F.least(F.lit(window), x - a["last"])).cast("int").alias("n"), x.alias("last")), lambda a: a["n"])
    symbols = F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))
    return docs.withColumns(
        {
            # non-deterministic in name only: a filter on the measures is not to be pushed below, where it would work them out anew for each use
            "n_words": F.when(F.monotonically_increasing_id() >= 0, n.cast("long")),
            "word_chars": F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long"),
            "n_symbols": symbols.cast("long"),
            "n_lines": F.size("__lines").cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "n_repeat_words": covered.cast("long"),
            "n_stop": F.size(F.filter("__words", lambda w: F.lower(F.rtrim(w, F.lit(".,;:!?"))).isin(*sorted(set(STOP_WORDS))))).cast("long"),
        }
    ).drop("__words", "__lines", "__grams", "__hits")


def _ratios() -> dict[str, Column]:
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return {
        "n_words": F.col("n_words").cast("double"),
        "repeat_ratio": per("n_repeat_words", "n_words"),
        "mean_word_chars": per("word_chars", "n_words"),
        "symbol_ratio": per("n_symbols", "n_words"),
        "dup_line_ratio": per("n_dup_lines", "n_lines"),
        "stop_ratio": per("n_stop", "n_words"),
    }


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """An array with the names of the measures that fail."""
    ratio, checks = _ratios(), []
    for r in rules:
        x = ratio[r.measure]
        bad = F.lit(False)
        if r.low is not None:
            bad = bad | (x < r.low)
        if r.high is not None:
            bad = bad | (x > r.high)
        checks.append(F.when(bad & (F.col("n_words") >= r.min_words), F.lit(r.measure)))
    return F.array_compact(F.array(*checks))


def quality(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with the measures and the columns base_failed, failed_rules and kept; no rows go.

    A null or empty text has no words, and so fails. Repeated rows get the same verdict each. No shuffle, no Python.
    """
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    out = measures(docs, text_col).withColumn("base_failed", base).withColumn("failed_rules", verdict(rules))
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
