"""URL filter: host and path rules first, a logistic regression on hashed character n-grams for the rest.

Everything is DataFrame expressions and spark.ml, which run in the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlRule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The list in force: a rule fits its host and all subdomains, if the path starts with the rule's.
RULES = (
    UrlRule("net", "/", "block"),
    UrlRule("example.net", "/en/", "allow"),
    UrlRule("example.com", "/de/", "block"),
    UrlRule("org", "/fr/", "allow"),
)

#: Labelled URLs to train on, at most; those with the smallest hashes are taken.
TRAIN_ROWS = 8_000
FEATURES = 1 << 14
SIZES = (3, 4, 5)


def host_of(url: Column) -> Column:
    """What follows the first `://`, up to `/`, `?`, `#` or the end, with A-Z lower-cased; empty without `://` or url."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end; empty without `://` or url."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: tuple[UrlRule, ...] = RULES) -> Column:
    """The longest rule that fits, as a struct of its text and verdict; null if none does."""
    chain = None
    for rule in sorted(rules, key=lambda r: (-len(r.text), r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))
        chain = F.when(fits, found) if chain is None else chain.when(fits, found)
    return chain


def grams_of(text: Column, n: int) -> Column:
    """All character n-grams of a text, each led by n; none of a shorter text."""
    places = F.sequence(F.lit(1), F.length(text) - (n - 1))
    found = F.transform(places, lambda at: F.concat(F.lit(str(n)), F.substring(text, at, F.lit(n))))
    return F.when(F.length(text) >= n, found).otherwise(F.array().cast("array<string>"))


def grams(text: Column, sizes: tuple[int, ...] = SIZES) -> Column:
    """The n-grams of these sizes of a text between two marks."""
    marked = F.concat(F.lit("^"), text, F.lit("$"))
    return F.flatten(F.array(*[grams_of(marked, n) for n in sizes]))


def labelled(urls: DataFrame, rules: tuple[UrlRule, ...] = RULES, rows: int = TRAIN_ROWS, url: str = "url") -> DataFrame:
    """A small labelled table: distinct URLs that a rule decides, `rows` of them at most, in the order of their hashes."""
    host, path = host_of(F.col(url)), path_of(F.col(url))
    known = urls.select(host.alias("host"), path.alias("path"), rule_for(host, path, rules).alias("_r")).filter("_r IS NOT NULL")
    known = known.groupBy("host", "path").agg(F.min("_r.verdict").alias("verdict"))
    return known.orderBy(F.xxhash64("host", "path"), "host", "path").limit(rows)


def url_verdicts(urls: DataFrame, labels: DataFrame | None = None, rules: tuple[UrlRule, ...] = RULES, url: str = "url", features: int = FEATURES) -> DataFrame:
    """urls with host, path, rule (text of the rule or null), verdict (allow or block) and block_score (null where a rule decides).

    labels: columns host, path, verdict; by default labelled(urls).  Null and odd URLs have an empty host and
    path and are judged by the model as such.  Without two classes to learn from, the model says what it
    has seen, and `allow` if it has seen nothing.  No row is dropped; columns of these names are replaced.
    """
    labels = (labelled(urls, rules, url=url) if labels is None else labels).select("host", "path", "verdict")
    text = F.concat(F.col("host"), F.col("path"))
    train = labels.select(grams(text).alias("_grams"), (F.col("verdict") == "block").cast("double").alias("_label"))
    hashed = HashingTF(numFeatures=features, binary=True, inputCol="_grams", outputCol="_features")
    train = hashed.transform(train).coalesce(4).cache()
    classes = {row["_label"] for row in train.select("_label").distinct().collect()}
    out = urls.withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    rule = rule_for(F.col("host"), F.col("path"), rules)
    out = out.withColumn("rule", rule["rule"]).withColumn("_decided", rule["verdict"])
    if len(classes) < 2:
        score = F.lit(1.0 if classes == {1.0} else 0.0)
    else:
        model = LogisticRegression(featuresCol="_features", labelCol="_label", predictionCol="_said", probabilityCol="_odds", rawPredictionCol="_raw", regParam=0.001, maxIter=25).fit(train)
        out = model.transform(hashed.transform(out.withColumn("_grams", grams(text))))
        score = F.col("_said")
    train.unpersist()
    out = out.withColumn("verdict", F.coalesce(F.col("_decided"), F.when(score >= 0.5, F.lit("block")).otherwise(F.lit("allow"))))
    return out.drop("_decided", "_grams", "_features", "_said", "_odds", "_raw")
