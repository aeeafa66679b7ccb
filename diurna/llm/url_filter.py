"""URL filter: prefix rules first, then logistic regression on hashed character n-grams.

Native: DataFrame functions and ``pyspark.ml`` on the JVM, no Python on the executors.
The rules are row-wise expressions (no join, no shuffle); the model is fitted on a
bounded labelled URL table, so the pages table is read once for scoring.

Defined results: a null URL or one without ``://`` has an empty host and path (no rule
fits it, the model judges the empty string); repeated rows stay; with no labelled
row, or labels of one kind only, the model answers that kind (``allow`` without any).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower


@dataclass(frozen=True)
class Rule:
    verdict: str          # "allow" or "block"
    pattern: str          # host, "/" and the start of the path

    @property
    def host(self) -> str:
        return self.pattern.split("/", 1)[0]

    @property
    def path(self) -> str:
        return "/" + self.pattern.split("/", 1)[1]


@dataclass(frozen=True)
class UrlModelConfig:
    grams: tuple = (3, 4)
    dimensions: int = 1 << 12
    iterations: int = 30
    ridge: float = 1e-3
    max_labelled: int = 4000   # bound of the labelled table that the model is fitted on


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL; both empty for null or without ``://``."""
    pat = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    clean = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(clean, pat, 1)), F.regexp_extract(clean, pat, 2)


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, null if none."""
    longest = sorted(rules, key=lambda r: (-len(r.pattern), r.pattern))
    fits = [F.when(((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path),
                   F.struct(F.lit(r.pattern).alias("rule"), F.lit(r.verdict).alias("verdict")))
            for r in longest]
    none = F.lit(None).cast("struct<rule:string,verdict:string>")
    return F.coalesce(*fits, none)


def char_grams(host: Column, path: Column, sizes: tuple) -> Column:
    """Character n-grams of host and path, each marked with where it comes from."""
    def grams(mark, part, n):
        framed = F.concat(F.lit("^"), part, F.lit("$"))
        starts = F.when(F.length(framed) >= n, F.sequence(F.lit(1), F.length(framed) - (n - 1))
                        ).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.concat(F.lit(mark), F.substr(framed, i, F.lit(n))))

    return F.concat(*[grams(m, p, n) for m, p in (("h", host), ("p", path)) for n in sizes])


def with_grams(df: DataFrame, config: UrlModelConfig) -> DataFrame:
    return df.withColumn("grams", char_grams(F.col("host"), F.col("path"), config.grams))


def fit(labelled: DataFrame, config: UrlModelConfig = UrlModelConfig()) -> PipelineModel | str:
    """Fit on (host, path, blocked int). The table is cut to ``max_labelled`` rows in hash
    order; one task holds it, so the optimiser's sums have one order and the weights
    are reproducible. Returns the only verdict instead when there is but one."""
    bounded = (labelled.select("host", "path", F.col("blocked").cast("double").alias("label")).distinct()
               .orderBy(F.xxhash64("host", "path"), "host", "path", "label").limit(config.max_labelled)
               .coalesce(1))
    kinds = bounded.agg(F.min("label").alias("lo"), F.max("label").alias("hi")).first()
    if kinds.lo is None or kinds.lo == kinds.hi:
        return "block" if kinds.hi else "allow"
    stages = [HashingTF(numFeatures=config.dimensions, binary=True, inputCol="grams", outputCol="features"),
              LogisticRegression(maxIter=config.iterations, regParam=config.ridge, labelCol="label")]
    return Pipeline(stages=stages).fit(with_grams(bounded, config))


def judge(pages: DataFrame, rules: list[Rule], model, config: UrlModelConfig = UrlModelConfig(),
          threshold: float = 0.5, url: str = "url") -> DataFrame:
    """Add host, path, rule, p_block and verdict to ``pages``."""
    host, path = url_parts(F.col(url))
    parts = pages.drop("host", "path", "rule", "p_block", "verdict").withColumns({"host": host, "path": path})
    ruled = parts.withColumn("_r", matching_rule(F.col("host"), F.col("path"), rules))
    if isinstance(model, str):
        scored = ruled.withColumn("p_block", F.lit(1.0 if model == "block" else 0.0))
    else:
        scored = model.transform(with_grams(ruled, config)).withColumn(
            "p_block", vector_to_array("probability")[1])
    return (scored.withColumns({
        "rule": F.col("_r.rule"),
        "verdict": F.coalesce(F.col("_r.verdict"), F.when(F.col("p_block") >= threshold, "block").otherwise("allow"))})
        .drop("_r", "grams", "features", "rawPrediction", "probability", "prediction"))


def labelled_by_rules(pages: DataFrame, rules: list[Rule], url: str = "url") -> DataFrame:
    """Labelled URL table (host, path, blocked) from the URLs that a rule decides."""
    host, path = url_parts(F.col(url))
    parts = pages.select(host.alias("host"), path.alias("path"))
    r = matching_rule(F.col("host"), F.col("path"), rules)["verdict"]
    return parts.select("host", "path", (r == "block").cast("int").alias("blocked")).where("blocked is not null")
