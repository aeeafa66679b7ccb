"""Host-level quality rules with an empirical beta prior, in Spark expressions only.

``text_counts`` measures each text, ``host_verdicts`` adds up rule failures by domain,
fits a beta prior to the domains' failure rates by moments, and shrinks every rate
towards it, ``judge`` joins the verdicts back to the documents.

Per text: one pass of array expressions, no shuffle. Repeated 3-word windows are found
by sorting (hash of the window, position), so the cost is n log n in the text's length.
Windows are compared by a 64-bit hash.

Domains: partial sums in each task before the shuffle, so a domain with a third of the
rows sends one row per task; the join back is left to adaptive planning (broadcast when
the domain table is small, else a sort-merge join with split skewed partitions).

Defined results: a null text counts as no words (and so fails); a null domain is a
domain of its own; repeated rows are judged each; with no domain the prior is not used.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, WORD_BREAK

SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class QualityRules:
    min_words: int = 50
    max_repeat_percent: int = 50
    max_host_rate: float = 0.5       # a domain whose shrunk failure rate is above it is dropped


def _let(value: Column, body) -> Column:
    """``body`` applied to a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.filter(F.split(text, WORD_BREAK), lambda w: w != "")


def repeat_words(ws: Column) -> Column:
    """Words lying in 3-word windows found at least twice in the text."""
    def covered(sorted_):
        last = F.size(sorted_) - 1
        hit = F.filter(sorted_, lambda x, i: (
            ((i > 0) & (F.get(sorted_, i - 1)["h"] == x["h"]))
            | ((i < last) & (F.get(sorted_, i + 1)["h"] == x["h"]))))
        return _let(F.sort_array(F.transform(hit, lambda x: x["p"])), lambda pos: F.aggregate(
            F.transform(pos, lambda p, i: F.coalesce(F.least(F.lit(3), F.get(pos, i + 1) - p), F.lit(3))),
            F.lit(0), lambda a, b: a + b))

    def by_windows(hashes):
        pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p")))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(
            _let(F.array_sort(pairs), covered))

    hashes = F.transform(F.sequence(F.lit(0), F.size(ws) - 3),
                         lambda i: F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)))
    return F.when(F.size(ws) < 4, F.lit(0)).otherwise(_let(hashes, by_windows))


def text_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the five counts of ``text`` (see ``COUNTS``)."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.length(F.translate(x, WHITE, "")) > 0)
    pre = df.withColumns({"_w": words(t), "_l": lines})
    return pre.withColumns({
        "n_words": F.size("_w").cast("long"),
        "word_chars": F.length(F.translate(t, WHITE, "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
        "n_repeat_words": repeat_words(F.col("_w")).cast("long"),
    }).drop("_w", "_l")


def base_failed(rules: QualityRules) -> Column:
    return (F.col("n_words") < rules.min_words) | (
        100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))


def host_verdicts(judged: DataFrame, rules: QualityRules, host: str = "host") -> DataFrame:
    """(host, n_docs, n_failed, shrunk_rate, host_kept) from rows with ``base_failed``.

    Prior by moments over domains: with mean m and variance v of the failure rates, the
    prior's weight is m(1-m)/v - 1 (at least 1; with v = 0 the rates agree and any
    weight gives them back), split m : 1-m into alpha and beta.
    """
    per = judged.groupBy(host).agg(F.count(F.lit(1)).alias("n_docs"),
                                   F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    prior = per.agg(F.avg(rate).alias("_m"), F.var_pop(rate).alias("_v"))
    weight = F.greatest(F.lit(1.0), F.when(F.col("_v") > 0, F.col("_m") * (1 - F.col("_m")) / F.col("_v") - 1)
                        .otherwise(F.lit(1.0)))
    shrunk = (F.col("n_failed") + weight * F.col("_m")) / (F.col("n_docs") + weight)
    # the prior is one row by construction
    return (per.crossJoin(F.broadcast(prior)).withColumn("shrunk_rate", shrunk)
            .withColumn("host_kept", F.col("shrunk_rate") <= rules.max_host_rate)
            .select(host, "n_docs", "n_failed", "shrunk_rate", "host_kept"))


def judge(counted: DataFrame, rules: QualityRules = QualityRules(), host: str = "host") -> DataFrame:
    """Add base_failed, shrunk_rate and kept. ``counted`` is read twice: pass a written table."""
    judged = counted.withColumn("base_failed", base_failed(rules))
    verdicts = host_verdicts(judged, rules, host).select(
        F.col(host).alias("_h"), "shrunk_rate", "host_kept")
    return (judged.join(verdicts, judged[host].eqNullSafe(F.col("_h")), "left").drop("_h")
            .withColumn("kept", ~F.col("base_failed") & F.coalesce("host_kept", F.lit(True))))
