"""Quality rules: a threshold table compiled into Spark projections.

The table is data; ``judge`` turns each row into a comparison of one ratio with
its bounds. All metrics are built-in expressions: no Python runs on executors,
and no row leaves its partition.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, fresh

#: Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to in a is it that for on with as by this was are be or an "
    "der die das und zu den mit von ist im ein eine nicht auf für als auch "
    "le la les de des du et un une en est que qui dans pour par "
    "el los las del y es con por para se no una su al lo"
).split()
SYMBOLS = "#*$%&|<>"
WINDOW = 8


@dataclass(frozen=True)
class Threshold:
    """A text fails where ``metric`` is below ``low`` or above ``high``; a null metric never fails."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None


#: Metrics are SQL over the columns that ``measure`` adds.
BASE = (
    Threshold("too_short", "n_words", low=20),
    Threshold("repetitive", "100.0 * n_repeat_words / n_words", high=30),
)
METHOD = (
    Threshold("word_length", "1.0 * word_chars / n_words", low=2, high=14),
    Threshold("symbols", "1.0 * n_symbols / n_words", high=0.35),
    Threshold("exclamations", "1.0 * n_marks / n_words", high=0.35),
    Threshold("stop_words", "1.0 * n_stop_words / n_words", low=0.01),
    Threshold("duplicate_lines", "1.0 * n_dup_lines / n_lines", high=0.5),
)


def _grams(words: str) -> Column:
    return F.transform(
        F.sequence(F.lit(0), F.size(words) - WINDOW),
        lambda i: F.xxhash64(F.slice(F.col(words), i + 1, WINDOW)),
    )


def measure(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """docs with the metrics as columns ``prefix`` + name.

    A null or empty text has no words and zero in every metric. Columns of docs
    that carry a metric's name are replaced; choose a prefix to keep them.
    """
    p = prefix
    words, lines, grams, sorted_, hits = (fresh(docs, f"__q_{x}") for x in ("words", "lines", "grams", "sorted", "hits"))
    t = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumns(
        {
            words: F.regexp_extract_all(t, F.lit(WORD), F.lit(0)),
            lines: F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD)),
            f"{p}word_chars": F.length(F.regexp_replace(t, r"[\x20\x09-\x0D]+", "")).cast("long"),
            f"{p}n_symbols": F.length(F.regexp_replace(t, f"[^{SYMBOLS}]+", "")).cast("long"),
            f"{p}n_marks": F.length(F.regexp_replace(t, "[^!?]+", "")).cast("long"),
        }
    )
    out = out.withColumns(
        {
            f"{p}n_words": F.size(words).cast("long"),
            f"{p}n_stop_words": F.size(F.filter(F.col(words), lambda w: F.lower(w).isin(STOP_WORDS))).cast("long"),
            f"{p}n_lines": F.size(lines).cast("long"),
            f"{p}n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            grams: F.when(F.size(words) > WINDOW, _grams(words)).otherwise(F.array().cast("array<bigint>")),
        }
    )
    repeated = F.size(F.array_distinct(grams)) < F.size(grams)
    pairs = F.array_sort(F.transform(F.col(grams), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn(sorted_, F.when(repeated, pairs))
    near = lambda k: F.coalesce(F.get(F.col(sorted_), k)["h"], F.lit(None).cast("bigint"))
    flagged = F.transform(
        F.col(sorted_),
        lambda x, k: F.when(x["h"].eqNullSafe(near(k - 1)) | x["h"].eqNullSafe(near(k + 1)), x["i"]),
    )
    out = out.withColumn(hits, F.array_sort(F.filter(flagged, lambda i: i.isNotNull())))
    covered = F.aggregate(
        F.col(hits),
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, i: F.struct((i + WINDOW).alias("end"), (a["n"] + i + WINDOW - F.greatest(a["end"], i)).alias("n")),
        lambda a: a["n"],
    )
    out = out.withColumn(f"{p}n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    return out.drop(words, lines, grams, sorted_, hits)


def failed(thresholds: tuple[Threshold, ...]) -> Column:
    """Whether any row of the table fails; one boolean expression, never null."""
    out = F.lit(False)
    for x in thresholds:
        # try_divide's null for an empty text passes: a ratio of nothing has no verdict
        metric = F.expr(x.metric.replace(" / ", " / nullif(") + ", 0)" * x.metric.count(" / "))
        if x.low is not None:
            out = out | F.coalesce(metric < x.low, F.lit(False))
        if x.high is not None:
            out = out | F.coalesce(metric > x.high, F.lit(False))
    return out


def quality_rules(
    docs: DataFrame,
    text: str = "text",
    base: tuple[Threshold, ...] = BASE,
    method: tuple[Threshold, ...] = METHOD,
) -> DataFrame:
    """docs with all metrics, ``base_failed`` and ``kept``.

    Null, empty and one-word texts are short and fail the base rule. A very long
    text is measured whole. A ratio that ties with a bound passes. Repeated rows
    are judged row by row; an empty table stays empty. Extra columns pass through,
    except those named like a metric or verdict, which are replaced.
    """
    out = measure(docs, text)
    out = out.withColumn("base_failed", failed(base))
    return out.withColumn("kept", ~F.col("base_failed") & ~failed(method))
