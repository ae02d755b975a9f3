"""Pair scores of long texts, ranks within hot keys."""

import random
import time

from pyspark.sql import functions as F

from ticketlake.functions import trigram
from ticketlake.operators.ordering import with_rank_within


def grams(text):
    return [f"  {w} "[i : i + 3] for w in text.split() for i in range(len(w) + 1)]


def brute_extent(wanted, ordered):
    wanted, best = set(wanted), 0.0
    for i in range(len(ordered)):
        seen = set()
        for gram in ordered[i:]:
            seen.add(gram)
            best = max(best, len(seen & wanted) / len(seen | wanted))
    return best


def test_extent_score_equals_brute_force(spark):
    draw = random.Random(3)
    word = lambda: "".join(draw.choice("abc") for _ in range(draw.randint(1, 5)))
    pairs = [(" ".join(word() for _ in range(draw.randint(0, 9))), " ".join(word() for _ in range(draw.randint(0, 9)))) for _ in range(150)]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", trigram.word_similarity(F.col("a"), F.col("b")).alias("score"))
    for r in rows.collect():
        assert r.score == brute_extent(grams(r.a), grams(r.b)), (r.a, r.b)


def test_long_pair_is_scored_fast(spark):
    draw = random.Random(4)
    text = lambda: " ".join("".join(draw.choice("abcdefgh") for _ in range(6)) for _ in range(30))
    a, b = text(), text()
    frame = spark.createDataFrame([(a, b), (b, a)], "a string, b string").select("a", trigram.word_similarity(F.col("a"), F.col("b")).alias("score"))
    frame.collect()
    start = time.time()
    found = {r.a: r.score for r in frame.collect()}
    assert time.time() - start < 5
    assert found == {a: brute_extent(grams(a), grams(b)), b: brute_extent(grams(b), grams(a))}


def test_rank_within_a_hot_key_spans_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [("hot", n * 7919 % 1000) for n in range(1000)] + [("cold", n) for n in (3, 1, 2)] + [(None, 5), (None, 4)]
        frame = spark.createDataFrame(rows, "label string, value int")
        spread = frame.repartitionByRange("label", "value").where("label = 'hot'").select(F.spark_partition_id().alias("p")).distinct().count()
        assert spread > 1
        ranked = with_rank_within(frame.where("label is not null"), ["label"], ["value"])
        expected = {("hot", n): n + 1 for n in range(1000)} | {("cold", n): n for n in (1, 2, 3)}
        assert {(r.label, r.value): r["rank"] for r in ranked.collect()} == expected
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
