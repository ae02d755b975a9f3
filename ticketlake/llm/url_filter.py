"""URL filters: rules by host and path, and gradient-boosted trees on lexical features for the rest.

A rule fits its host and all subdomains, if the path starts with the rule's; the longest wins. URLs that a
rule decides are the labelled ones: the trees learn from at most ``SAMPLE`` of them, chosen per label by hash of
id and URL and weighed by the labels' shares, and decide all others. Features are length, depth, digit ratio, entropy of the signs, number of parameters,
hyphens and labels of the host, and for the host's last two labels and its last label the share of blocked
URLs among all labelled ones (smoothed). Only DataFrame functions and Spark's own trees are used.

The host is what follows the first ``://``, ASCII lower case; without one, and for null URLs, host and path
are empty. Rows are judged one by one, so repeated rows and null ids stay. Without labelled URLs of both kinds
everything left is allowed. An empty table gives an empty result. Other columns play no part.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlake.llm.common import is_small, saved, table

#: Verdict, host and path of each rule.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
#: Most labelled URLs that the trees are fitted on.
SAMPLE = 20_000
FEATURES = ["length", "depth", "digits", "entropy", "parameters", "hyphens", "labels", "site_blocked", "suffix_blocked"]

_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def parts(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds host and path."""
    of = lambda n: F.coalesce(F.regexp_extract(F.col(url), _PARTS, n), F.lit(""))
    return df.withColumn("host", F.translate(of(1), string.ascii_uppercase, string.ascii_lowercase)).withColumn("path", of(2))


def ruled(df: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """Adds rule (host and path) and the rule's verdict, null where none fits."""
    longest_first = sorted(rules, key=lambda r: -len(r[1] + r[2]))

    def pick(value) -> Column:
        fits = [((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p) for _, h, p in longest_first]
        return reduce(lambda rest, case: F.when(case[0], F.lit(value(case[1]))).otherwise(rest), [*zip(fits, longest_first)][::-1], F.lit(None).cast("string"))

    return df.withColumn("rule", pick(lambda r: r[1] + r[2])).withColumn("_ruled", pick(lambda r: r[0]))


def with_features(df: DataFrame, url: str = "url") -> DataFrame:
    text, size = F.coalesce(F.col(url), F.lit("")), F.greatest(F.length(url), F.lit(1))
    share = lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / size
    signs = F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))
    counted = lambda sign, column: F.length(column) - F.length(F.replace(column, F.lit(sign), F.lit("")))
    query = F.coalesce(F.regexp_extract(F.col(url), r"\?([^#]*)", 1), F.lit(""))
    return (
        df.withColumn("length", F.length(text).cast("double"))
        .withColumn("depth", counted("/", F.col("path")).cast("double"))
        .withColumn("digits", F.length(F.regexp_replace(text, "[^0-9]", "")) / size)
        .withColumn("entropy", F.coalesce(F.aggregate(signs, F.lit(0.0), lambda s, c: s - share(c) * F.log(share(c))), F.lit(0.0)))
        .withColumn("parameters", F.when(query == "", 0.0).otherwise(1.0 + counted("&", query)))
        .withColumn("hyphens", counted("-", F.col("host")).cast("double"))
        .withColumn("labels", counted(".", F.col("host")).cast("double"))
        .withColumn("_suffix", F.substring_index("host", ".", -1))
        .withColumn("_site", F.substring_index("host", ".", -2))
    )


def _with_rates(rows: DataFrame, key: str, name: str) -> DataFrame:
    """Adds the smoothed share of blocked URLs among labelled ones of the same key."""
    blocked = (F.col("_ruled") == "block").cast("double")
    rates = saved(rows.where("_ruled IS NOT NULL").groupBy(key).agg(((F.sum(blocked) + 0.5) / (F.count("*") + 1)).alias(name)))
    return rows.join(F.broadcast(rates) if is_small(rates) else rates, key, "left").fillna(0.5, [name])


def sampled(labelled: DataFrame, counts: dict[float, int], key: str, url: str, sample: int) -> DataFrame:
    """At most ``sample`` rows, half of them at least of the rarer label if it has as many; weights give the labels their shares back."""
    rare, common = sorted(counts, key=lambda label: (counts[label], label))
    first = min(counts[rare], max(1, sample // 2))
    taken = {rare: first, common: min(counts[common], max(1, sample - first))}
    some = [
        labelled.where(F.col("label") == label).orderBy(F.xxhash64(key, url)).limit(most).withColumn("weight", F.lit(counts[label] / most))
        for label, most in taken.items()
    ]
    return some[0].unionByName(some[1])


def filter_urls(pages: DataFrame, key: str = "page_id", url: str = "url", rules: list[tuple[str, str, str]] = RULES, sample: int = SAMPLE) -> DataFrame:
    """page_id, host, path, rule, verdict."""
    rows = with_features(ruled(parts(pages.select(key, url), url), rules), url)
    rows = saved(_with_rates(_with_rates(rows, "_site", "site_blocked"), "_suffix", "suffix_blocked"))
    labelled = rows.where("_ruled IS NOT NULL").withColumn("label", (F.col("_ruled") == "block").cast("double"))
    counts = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    judged = F.lit(0.0)
    if len(counts) == 2:
        gather = VectorAssembler(inputCols=FEATURES, outputCol="features")
        chosen = saved(gather.transform(sampled(labelled, counts, key, url, sample)).select("features", "label", "weight"))
        model = GBTClassifier(maxIter=8, maxDepth=3, seed=7, weightCol="weight").fit(chosen)
        rows = model.transform(gather.transform(rows))
        judged = F.col("prediction")
    verdict = F.coalesce("_ruled", F.when(judged > 0.5, "block").otherwise("allow")).alias("verdict")
    return rows.select(F.col(key).alias("page_id"), "host", "path", "rule", verdict)


QUERY = "op6_url_filter"
STATEMENT = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))
