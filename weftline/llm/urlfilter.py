"""URL filter: rules first, then gradient-boosted trees on lexical features of the address.

A rule names a host and a path prefix; it fits the host and all subdomains, and the longest fitting rule decides.
The trees are trained on labelled URLs: length, depth, digit ratio, character entropy, parameter counts and the
statistics of host suffix and first path segment (how often the labelled URLs with it are blocked, smoothed).

A null URL, or one without ``://``, has an empty host and path and no rule; the trees judge it like any other, and
where nothing can be learned (no labelled URL, or labels of one kind) the verdict is the labels' kind, or ``allow``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.runtime import materialize

TRAINING_ROWS = 40_000  # bound on the distinct labelled URLs that the trees are fitted on, drawn by hash
DRAWS = 1 << 40          # range of that hash
TREES, DEPTH, SEED = 20, 4, 11
SMOOTHING = 20.0        # labelled URLs' worth of the overall share in a suffix's statistic
FEATURES = [
    "f_length", "f_host_length", "f_path_length", "f_labels", "f_depth", "f_digits", "f_host_digits", "f_entropy",
    "f_parameters", "f_query_length", "f_hyphens", "f_suffix", "f_suffix_rows", "f_segment", "f_segment_rows",
]


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): host after the first ``://`` with A-Z lower-cased, path up to ``?`` or ``#``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(F.coalesce(rest, F.lit("")), r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), path


def fitting_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """struct(length, name, verdict) of the longest rule that fits, or null; equal lengths go by name."""
    fits = [
        F.when(
            ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path)),
            F.struct(F.lit(len(r.name)).alias("length"), F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict")),
        )
        for r in rules
    ]
    return F.greatest(*fits) if len(fits) > 1 else fits[0]


def with_features(urls: DataFrame) -> DataFrame:
    """The rows (url, host, path, …) with the lexical features that need no statistics."""
    url = F.coalesce("url", F.lit(""))
    length = F.greatest(F.length(url), F.lit(1))
    share = lambda c: (F.length(url) - F.length(F.replace(url, c, F.lit("")))) / length
    entropy = F.aggregate(
        F.transform(F.array_distinct(F.split(url, "")), lambda c: F.when(F.length(c) > 0, share(c))),
        F.lit(0.0),
        lambda total, p: total - F.when(p > 0, p * F.log2(p)).otherwise(0.0),
    )
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    count = lambda text, pattern: F.regexp_count(text, F.lit(pattern)).cast("double")
    return urls.select(
        "*",
        F.length(url).cast("double").alias("f_length"),
        F.length("host").cast("double").alias("f_host_length"),
        F.length("path").cast("double").alias("f_path_length"),
        count(F.col("host"), r"\.").alias("f_labels"),
        count(F.col("path"), r"/[^/]").alias("f_depth"),
        (count(url, "[0-9]") / length).alias("f_digits"),
        (count(F.col("host"), "[0-9]") / F.greatest(F.length("host"), F.lit(1))).alias("f_host_digits"),
        entropy.alias("f_entropy"),
        F.when(query == "", 0.0).otherwise(count(query, "&") + 1).alias("f_parameters"),
        F.length(query).cast("double").alias("f_query_length"),
        count(F.col("host"), "-").alias("f_hyphens"),
        F.regexp_extract("host", r"([^.]*)$", 1).alias("_suffix"),
        F.regexp_extract("path", r"^/([^/]*)", 1).alias("_segment"),
    )


def _statistic(rows: DataFrame, key: str, name: str, overall: float) -> DataFrame:
    """``rows`` with f_name: smoothed share of blocked among the other labelled rows of the key, and f_name_rows: log of
    all its rows.  A row's own label is left out, or it would be the answer where the key is rare."""
    counted = rows.groupBy(key).agg(
        F.coalesce(F.sum("label"), F.lit(0.0)).alias("_blocked"), F.count("label").alias("_labelled"), F.count(F.lit(1)).alias("_all")
    )
    own, known = F.coalesce("label", F.lit(0.0)), F.col("label").isNotNull().cast("int")
    share = (F.col("_blocked") - own + SMOOTHING * overall) / (F.col("_labelled") - known + SMOOTHING)
    return (
        rows.join(materialize(counted, "url-statistic"), key, "left")  # written, so that a hot key is split
        .withColumns({f"f_{name}": F.coalesce(share, F.lit(overall)), f"f_{name}_rows": F.log1p(F.coalesce("_all", F.lit(0)).cast("double"))})
        .drop("_blocked", "_labelled", "_all")
    )


def drawn(rows: DataFrame) -> DataFrame:
    """At most about TRAINING_ROWS of the labelled rows (url, label, …), copies once."""
    labelled = rows.where("label is not null").withColumn("_hash", F.xxhash64("url", F.lit(SEED)))
    share = min(1.0, TRAINING_ROWS / max(1, labelled.select("_hash", "label").distinct().count()))
    return labelled.where(F.pmod("_hash", F.lit(DRAWS)) < int(share * DRAWS)).dropDuplicates(["_hash", "label"]).drop("_hash")


def train(rows: DataFrame) -> GBTClassificationModel:
    """Trees on at most about TRAINING_ROWS of the labelled rows (label, FEATURES)."""
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(drawn(rows))
    trees = GBTClassifier(labelCol="label", featuresCol="features", maxIter=TREES, maxDepth=DEPTH, seed=SEED)
    return trees.fit(vectors.select("label", "features"))


def judged(urls: DataFrame) -> DataFrame:
    """``urls`` (url, host, path, label, …; label 1 blocks, 0 allows, null asks) with the trees' ``score`` of blocking."""
    rows = materialize(with_features(urls), "url-features")
    labelled, blocked = rows.agg(F.count("label"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    overall = blocked / labelled if labelled else 0.0
    full = _statistic(_statistic(rows, "_suffix", "suffix", overall), "_segment", "segment", overall)
    if not 0 < overall < 1:
        return full.withColumn("score", F.lit(overall))
    full = materialize(full, "url-rows")
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(full)
    return train(full).transform(vectors).withColumn("score", vector_to_array("probability")[1])


def filter_urls(pages: DataFrame, rules: list[Rule], key: str = "page_id", url: str = "url") -> DataFrame:
    """(key, host, path, rule, verdict, score) for every row; the URLs that a rule decides are the labelled ones."""
    host, path = split_url(F.col("url"))
    addressed = pages.select(F.col(key).alias("_key"), F.col(url).alias("url")).select("*", host.alias("host"), path.alias("path"))
    ruled = addressed.withColumn("_rule", fitting_rule(F.col("host"), F.col("path"), rules))
    labelled = ruled.withColumn("label", (F.col("_rule.verdict") == "block").cast("double"))
    by_model = F.when(F.col("score") > 0.5, "block").otherwise("allow")
    return judged(labelled).select(
        F.col("_key").alias(key),
        "host",
        "path",
        F.col("_rule.name").alias("rule"),
        F.coalesce("_rule.verdict", by_model).alias("verdict"),
        "score",
    )
