"""Trigram scores over normalised text (words of [a-z0-9] separated by single blanks)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ordered_trigrams(text: Column) -> Column:
    """All trigrams in order; each word is padded with two blanks before and one after."""
    words = F.filter(F.split(text, " "), lambda w: w != "")
    per_word = F.transform(
        words,
        lambda w: F.transform(
            F.sequence(F.lit(1), F.length(w) + 1),
            lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)),
        ),
    )
    return F.flatten(per_word)


def trigram_set(text: Column) -> Column:
    return F.array_distinct(ordered_trigrams(text))


def _overlap(left: Column, right: Column) -> Column:
    shared = F.size(F.array_intersect(left, right))
    return F.try_divide(shared.cast("double"), F.size(F.array_union(left, right)).cast("double"))


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``."""
    return F.get(F.transform(F.array(value), body), 0)


def set_similarity(left: Column, right: Column) -> Column:
    return F.coalesce(_overlap(left, right), F.lit(0.0))


def extent_similarity(wanted: Column, ordered: Column) -> Column:
    """Best similarity of a trigram set to a contiguous extent of the other, ordered trigrams.

    A best extent starts on a wanted trigram. From each such start, one walk to the end counts the different
    trigrams and the wanted ones among them; a trigram is new if its last occurrence lies before the start. A
    start is passed over when the wanted trigrams left from there can't beat the best extent found.
    """

    def marked(pair: Column) -> Column:
        """Of each trigram the place of its last occurrence before (0: none), and whether it is wanted."""

        def mark(gram: Column, at: Column) -> Column:
            back = F.array_position(F.reverse(F.slice(pair["ordered"], F.lit(1), at)), gram)
            before = F.when(back > 0, at - back + 1).otherwise(F.lit(0)).cast("int")
            return F.struct(before.alias("before"), F.array_contains(pair["wanted"], gram).alias("hit"))

        return F.transform(pair["ordered"], mark)

    def walk(marks: Column, size: Column, start: Column) -> Column:
        """Best similarity of an extent that starts here."""

        def step(state: Column, mark: Column) -> Column:
            new = mark["before"] < start
            hits = state["hits"] + F.when(new & mark["hit"], F.lit(1)).otherwise(F.lit(0))
            count = state["count"] + F.when(new, F.lit(1)).otherwise(F.lit(0))
            return F.struct(hits.alias("hits"), count.alias("count"), F.greatest(state["best"], hits.cast("double") / (size + count - hits)).alias("best"))

        begun = F.struct(F.lit(0).alias("hits"), F.lit(0).alias("count"), F.lit(0.0).alias("best"))
        return F.aggregate(F.slice(marks, start, F.size(marks) - start + 1), begun, step, lambda state: state["best"])

    def best(marks: Column, size: Column) -> Column:
        places = F.filter(F.transform(marks, lambda m, at: F.when(m["hit"], at + 1)), lambda at: at.isNotNull())
        starts = lambda found: F.transform(found, lambda at, n: F.struct(at.alias("at"), (F.size(found) - n).alias("left")))

        def try_start(known: Column, start: Column) -> Column:
            hopeful = start["left"].cast("double") / size > known
            return F.when(hopeful, F.greatest(known, walk(marks, size, start["at"]))).otherwise(known)

        return _let(places, lambda found: F.aggregate(starts(found), F.lit(0.0), try_start))

    pair = F.struct(wanted.alias("wanted"), ordered.alias("ordered"))
    found = _let(pair, lambda p: _let(marked(p), lambda marks: best(marks, F.size(p["wanted"]))))
    return F.coalesce(found, F.lit(0.0))


def trigram_similarity(left: Column, right: Column) -> Column:
    return set_similarity(trigram_set(left), trigram_set(right))


def word_similarity(left: Column, right: Column) -> Column:
    return extent_similarity(trigram_set(left), ordered_trigrams(right))


def best_score(left: Column, right: Column) -> Column:
    """Greatest of the symmetric score and the extent score in both directions, from ordered trigrams."""
    texts = F.struct(
        left.alias("lo"), right.alias("ro"), F.array_distinct(left).alias("ls"), F.array_distinct(right).alias("rs")
    )
    return _let(
        texts,
        lambda t: F.greatest(
            set_similarity(t["ls"], t["rs"]),
            extent_similarity(t["ls"], t["ro"]),
            extent_similarity(t["rs"], t["lo"]),
        ),
    )


def search_score(score: Column) -> Column:
    return F.round(score * 100, 2)


def score_confidence(points: Column) -> Column:
    return F.least(F.greatest(points.cast("decimal(9,4)") / 100, F.lit(0)), F.lit(1)).cast("decimal(5,4)")
