"""Toxicity by a counterfactual-regularised logistic classifier over words and parts of words.

A document's features are the lower-cased words of its whole text, their starts of 4 to 6 letters and their runs
of 5 letters, each counted once, hashed into ``BUCKETS``. Training uses at most ``SAMPLE`` labelled rows that
aren't held out, chosen by hash of the id. Features whose rates differ between the labels (root of the
likelihood ratio at least ``Z``; the ``VOCABULARY`` clearest) get weights by regularised logistic regression. For every
training row that names a group (``IDENTITY_TERMS``), copies with the terms swapped are made, and the
squared change of the logit between row and copy is penalised, so that naming a group does not move a score.

Null texts are empty texts; their score is that of a text without any known feature. Null ids are not held out.
Labels of a document given several times: any 1 makes it 1; null labels don't count. Without training rows
every score is 0.5. Repeated rows are scored one by one; ties score alike. Labels, lang, source and id are
no inputs of a score. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlake.llm.common import is_small, lean, saved, table, text_of

BUCKETS = 1 << 20
#: Most labelled rows that the classifier is fitted on.
SAMPLE = 20_000
Z = 4.5
VOCABULARY = 2048
THRESHOLD = 0.7
#: Strength of the squared weights and of the squared change under swapped identity terms.
RIDGE = 1e-4
FAIRNESS = 1.0
#: Words whose features a task remembers.
REMEMBERED = 100_000

#: Terms of each list are swapped for each other.
IDENTITY_TERMS = [
    "women men girls boys mothers fathers nonbinary transgender".split(),
    "muslims christians jews hindus buddhists atheists".split(),
    "muslim christian jewish hindu buddhist atheist".split(),
    "black white asian latino arab african european".split(),
    "gay straight lesbian bisexual queer".split(),
    "immigrants refugees natives foreigners citizens".split(),
    "frauen männer mädchen jungen mütter väter".split(),
    "juden christen muslime".split(),
    "femmes hommes filles garçons juifs chrétiens musulmans".split(),
    "mujeres hombres judíos cristianos musulmanes".split(),
]

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def buckets_of(word: str) -> tuple[int, ...]:
    parts = [word, *("^" + word[:n] for n in (4, 5, 6) if len(word) > n), *("~" + word[i : i + 5] for i in range(len(word) - 4))]
    return tuple({zlib.crc32(part.encode()) % BUCKETS for part in parts})


class Features(dict):
    """Buckets of each word seen; of ``chosen`` ones alone, where given."""

    def __init__(self, chosen: set[int] | None = None):
        self.chosen = chosen

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > REMEMBERED:
            self.clear()
        found = buckets_of(word)
        if self.chosen is not None:
            found = tuple(b for b in found if b in self.chosen)
        self[word] = found
        return found

    def of(self, words: set[str]) -> set[int]:
        return set(chain.from_iterable(map(self.__getitem__, words)))


def swapped(text: str, shift: int) -> str:
    """The text with each identity term replaced by one of its list, ``shift`` places on."""

    def other(match: re.Match) -> str:
        word = match.group().lower()
        for terms in IDENTITY_TERMS:
            if word in terms:
                return terms[(terms.index(word) + shift) % len(terms)]
        return match.group()

    return _WORD.sub(other, text)


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """text and toxic of at most about ``sample`` labelled documents that aren't held out."""
    usable = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, sample / max(usable.count(), 1))
    chosen = saved(usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000)))
    texts = docs.select("doc_id", text_of().alias("text"))
    return texts.join(F.broadcast(chosen) if is_small(chosen) else chosen, "doc_id").select("text", F.col("toxic").cast("int"))


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    features, counts = Features(), np.zeros((2, BUCKETS), dtype=np.int64)
    for batch in batches:
        for text, toxic in zip(batch["text"], batch["toxic"]):
            counts[toxic, list(features.of(words_of(text)))] += 1
    seen = np.flatnonzero(counts.any(axis=0))
    yield pd.DataFrame({"bucket": seen, "clean": counts[0, seen], "toxic": counts[1, seen]})


def telling_buckets(rows: DataFrame, z: float = Z, vocabulary: int = VOCABULARY) -> list[int]:
    """Features whose rates differ clearly, the clearest first."""
    clean, toxic = rows.agg(F.count(F.when(F.col("toxic") == 0, 1)), F.count(F.when(F.col("toxic") == 1, 1))).head()
    if not clean or not toxic:
        return []
    counts = rows.mapInPandas(lean(_counts), "bucket long, clean long, toxic long").groupBy("bucket")
    counts = counts.agg(F.sum("clean").alias("b"), F.sum("toxic").alias("a"))
    # Likelihood ratio of the feature's two rates against one common rate.
    both, total = F.col("a") + F.col("b"), clean + toxic
    cell = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    gain = sum(
        cell(F.col(n), both * (of / total)) + cell(of - F.col(n), (total - both) * (of / total)) for n, of in (("a", toxic), ("b", clean))
    )
    scored = counts.withColumn("z", F.sqrt(F.greatest(2 * gain, F.lit(0.0))))
    return [r[0] for r in scored.where(F.col("z") >= z).orderBy(F.desc("z"), "bucket").limit(vocabulary).collect()]


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, fairness: float = FAIRNESS, z: float = Z) -> tuple[dict[int, float], float]:
    """Weights by bucket, and the intercept."""
    rows = saved(training_rows(docs, labels, sample).repartition(8))
    chosen = telling_buckets(rows, z)
    place = {bucket: n for n, bucket in enumerate(chosen)}

    def examples(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features, terms = Features(set(place)), {t for group in IDENTITY_TERMS for t in group}
        for batch in batches:
            out = []
            for text, toxic in zip(batch["text"], batch["toxic"]):
                words = words_of(text)
                variants = [words_of(swapped(text, n)) for n in (1, 2)] if words & terms else []
                first, *others = [sorted(place[b] for b in features.of(w)) for w in [words, *variants]]
                out.append((first, [o for o in others if o != first], toxic))
            yield pd.DataFrame(out, columns=["own", "others", "toxic"])

    found = rows.mapInPandas(lean(examples), "own array<int>, others array<array<int>>, toxic int").collect()
    found.sort(key=lambda r: (r["toxic"], r["own"], r["others"]))  # sums don't depend on the order of arrival
    return _regression(found, chosen, fairness)


def _regression(found: list, chosen: list[int], fairness: float) -> tuple[dict[int, float], float]:
    """Full-batch gradient descent with Adam steps on sparse rows."""
    if not found:
        return {}, 0.0
    width, y = len(chosen), np.array([r["toxic"] for r in found], dtype=float)
    at = np.repeat(np.arange(len(found)), [len(r["own"]) for r in found])
    column = np.fromiter(chain.from_iterable(r["own"] for r in found), dtype=np.int64)
    # A pair's difference of features: +1 where only the row has one, -1 where only the copy has it.
    pairs = [(set(r["own"]), set(o)) for r in found for o in r["others"]]
    change = [(n, c, 1.0 if c in a else -1.0) for n, (a, b) in enumerate(pairs) for c in a ^ b]
    p_at, p_column, p_sign = (np.array(x) for x in zip(*change)) if change else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    weights = np.zeros(width + 1)
    rate = (y.sum() + 0.5) / (len(y) + 1)
    weights[-1] = np.log(rate / (1 - rate))
    slope, square = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, 601):
        logit = np.bincount(at, weights[column], len(y)) + weights[-1]
        miss = (1 / (1 + np.exp(-logit)) - y) / len(y)
        gradient = np.append(np.bincount(column, miss[at], width) + RIDGE * weights[:-1], miss.sum())
        if len(pairs):
            moved = np.bincount(p_at, weights[p_column] * p_sign, len(pairs))
            gradient[:-1] += np.bincount(p_column, 2 * fairness / len(pairs) * moved[p_at] * p_sign, width)
        slope, square = 0.9 * slope + 0.1 * gradient, 0.999 * square + 0.001 * gradient**2
        weights -= 0.05 * (slope / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-9)
    return {b: float(w) for b, w in zip(chosen, weights)}, float(weights[-1])


def logistic(weights: dict[int, float], intercept: float, features: Features, texts: pd.Series) -> np.ndarray:
    sums = [intercept + sum(weights[b] for b in sorted(features.of(words_of(t)))) for t in texts]
    return 1 / (1 + np.exp(-np.array(sums, dtype=float)))


def score(docs: DataFrame, weights: dict[int, float], intercept: float, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""

    def scores(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features = Features(set(weights))
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "score": logistic(weights, intercept, features, batch["text"])})

    rows = docs.select(F.col(key).alias("doc_id"), text_of(text).alias("text"))
    out = rows.mapInPandas(lean(scores), "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, *fit(docs, labels))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier doesn't call toxic, with all their columns. Each row's own text decides, whatever its id."""
    weights, intercept = fit(docs, labels)

    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        features = Features(set(weights))
        for texts in batches:
            yield pd.Series(logistic(weights, intercept, features, texts))

    return docs.where(F.pandas_udf(lean(scores), "double")(text_of()) < THRESHOLD)


QUERY = "op5_toxicity"
STATEMENT = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
