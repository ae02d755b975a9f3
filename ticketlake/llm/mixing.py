"""Mixing sources to target weights by pivotal dependent rounding.

Each source has a target in words; each of its documents a copy rate target / source size, from 0 to 2.
The whole part of the rate is taken as it is. The fractional part becomes mass (fraction x words).
Documents are paired: mass moves between the two, so that their sum stays, until one of them has
none or all of its words; which way it moves is drawn so that every document keeps its expectation.
The one that stays fractional goes on to the next pair. Cells of about ``FAN`` documents of a source work in
parallel, each leaves one residual, and residuals combine through a reduction tree of the same cells.
So a source that holds a third of all rows is as many cells as it needs, and its words taken differ
from its target by less than one document. The last residual of a source goes to the nearer side.

Draws are hashes of ids, so reruns agree. Rows that repeat an id, or have none, are documents of their own: they are numbered
by id, source and text, and draw by that number. Null sources form one source, last in order. Null or blank texts
have no words, weigh nothing and take nothing; long texts are counted whole. An empty table gives an empty result. Other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlake.llm.common import free_name, is_small, saved, table, text_of, with_row_number
from ticketlake.operators.ordering import with_rank

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
#: Documents or residuals that one cell of the tree combines, on average.
FAN = 64

#: One step of a cell: a document meets the residual. Mass goes to the residual ("up") or to the document ("down").
_STEP = """
  aggregate(
    transform(array_sort(collect_list(struct(order_, id_, size_, mass_))), x -> struct(x.id_ AS id_, x.size_ AS size_, x.mass_ AS mass_)),
    named_struct('rest', cast(null AS struct<id_: bigint, size_: bigint, mass_: double>), 'done', cast(array() AS array<struct<id_: bigint, size_: bigint, extra: int>>)),
    (s, x) -> CASE
      WHEN s.rest IS NULL THEN named_struct('rest', x, 'done', s.done)
      WHEN shiftrightunsigned(xxhash64(s.rest.id_, x.id_, s.rest.size_, {seed}), 11) / 9007199254740992D * (least(s.rest.size_ - s.rest.mass_, x.mass_) + least(x.size_ - x.mass_, s.rest.mass_)) < least(x.size_ - x.mass_, s.rest.mass_)
      THEN CASE WHEN s.rest.size_ - s.rest.mass_ <= x.mass_
        THEN named_struct('rest', named_struct('id_', x.id_, 'size_', x.size_, 'mass_', x.mass_ - (s.rest.size_ - s.rest.mass_)), 'done', array_append(s.done, named_struct('id_', s.rest.id_, 'size_', s.rest.size_, 'extra', 1)))
        ELSE named_struct('rest', named_struct('id_', s.rest.id_, 'size_', s.rest.size_, 'mass_', s.rest.mass_ + x.mass_), 'done', array_append(s.done, named_struct('id_', x.id_, 'size_', x.size_, 'extra', 0))) END
      ELSE CASE WHEN x.size_ - x.mass_ <= s.rest.mass_
        THEN named_struct('rest', named_struct('id_', s.rest.id_, 'size_', s.rest.size_, 'mass_', s.rest.mass_ - (x.size_ - x.mass_)), 'done', array_append(s.done, named_struct('id_', x.id_, 'size_', x.size_, 'extra', 1)))
        ELSE named_struct('rest', named_struct('id_', x.id_, 'size_', x.size_, 'mass_', x.mass_ + s.rest.mass_), 'done', array_append(s.done, named_struct('id_', s.rest.id_, 'size_', s.rest.size_, 'extra', 0))) END
    END) AS cell_result
"""


def word_count(column: str = "text") -> Column:
    return F.regexp_count(text_of(column), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row per source: source, source_size, docs, target. ``sizes`` has source and size.

    Sources above ``most`` times their size are set to it and the rest is shared anew by weight, until
    none is above. The loop only carries three totals; every round is an aggregate over the sources.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    ranked = with_rank(sources, [F.col("source").asc_nulls_last()], "_rank")
    picked = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("_rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = saved(ranked.withColumn("_weight", picked.cast("double")).drop("_rank"))
    most_words = F.col("source_size") * F.lit(float(most))
    mass = (ranked.agg(F.sum("source_size")).head()[0] or 0) * share
    left, free, stopped = mass, ranked.agg(F.sum("_weight")).head()[0] or 1.0, 0
    while True:
        above = most_words < F.lit(left) * F.col("_weight") / F.lit(free)
        row = ranked.agg(F.sum(F.when(above, most_words)), F.sum(F.when(~above, F.col("_weight"))), F.count(F.when(above, 1))).head()
        if row[2] == stopped:
            break
        left, free, stopped = mass - row[0], row[1] or 1.0, row[2]
    target = F.least(most_words, F.lit(left) * F.col("_weight") / F.lit(free))
    return ranked.select("source", "source_size", "docs", target.alias("target"))


def _rounded(parts: DataFrame, cells: int, seed: int) -> DataFrame:
    """parts: source, cell, id_, size_, mass_ with 0 < mass_ < size_. Returns source, id_, size_, extra (0 or 1)."""
    decided = None
    level = 0
    while True:
        level += 1
        # Long documents first: the shorter ones that follow are what decides them.
        keyed = parts.withColumn("order_", F.struct(-F.col("size_"), F.xxhash64("id_", F.lit(seed + level))))
        met = saved(keyed.groupBy("source", "cell").agg(F.expr(_STEP.format(seed=seed + level))))
        done = met.select("source", F.explode("cell_result.done").alias("d")).select("source", "d.*")
        decided = done if decided is None else decided.unionByName(done)
        rest = met.where("cell_result.rest IS NOT NULL").select("source", "cell", "cell_result.rest.*")
        # What floating point leaves at either end is integral already.
        whole = (F.col("mass_") < 1e-6) | (F.col("mass_") > F.col("size_") - 1e-6)
        last = (F.col("mass_") * 2 >= F.col("size_")).cast("int").alias("extra")
        if cells <= 1:
            return decided.unionByName(rest.select("source", "id_", "size_", last))
        decided = decided.unionByName(rest.where(whole).select("source", "id_", "size_", last))
        parts = rest.where(~whole).withColumn("cell", F.floor(F.col("cell") / FAN))
        cells = -(-cells // FAN)


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", seed: int = 7) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken."""
    row = free_name("row", docs.columns)
    mixed = _mix(with_row_number(docs, row, key, source, text), row, key, source, text, seed)
    return mixed.select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


def _mix(docs: DataFrame, row: str, key: str, source: str, text: str, seed: int = 7) -> DataFrame:
    """row (unique long) and the columns of ``mix``."""
    sizes = docs.select(F.col(row).alias("row"), F.col(key).cast("bigint").alias("doc_id"), F.col(source).alias("source"), word_count(text).alias("size"))
    sizes = saved(sizes)
    targets = saved(source_targets(sizes))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = targets.withColumn("_rate", rate).withColumn("_whole", F.floor("_rate").cast("int"))
    targets = targets.withColumn("_cells", F.ceil(F.col("docs") / FAN)).withColumn("_part", F.col("_rate") - F.col("_whole"))
    named = sizes.alias("d").join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")))
    named = named.select("d.*", "t.source_size", "t.target", "t._whole", "t._part", "t._cells")
    parts = named.where("size > 0 and _part > 0").select(
        "source",
        F.pmod(F.xxhash64("row", F.lit(seed)), F.col("_cells")).alias("cell"),
        F.col("row").alias("id_"),
        F.col("size").alias("size_"),
        (F.col("size") * F.col("_part")).alias("mass_"),
    )
    most = targets.agg(F.max("_cells")).head()[0] or 1
    decided = _rounded(parts, most, seed).select("id_", "extra")
    out = named.alias("n").join(decided.alias("e"), F.col("n.row") == F.col("e.id_"), "left")
    copies = F.col("n._whole") + F.coalesce(F.col("e.extra"), F.lit(0))
    out = out.select("n.row", "n.doc_id", "n.source", "n.size", "n.source_size", "n.target", copies.alias("copies"))
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def mixed_documents(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The mix itself: each document as many times as it is taken, with all its columns."""
    row, times, copy = (free_name(n, docs.columns) for n in ("row", "times", "copy"))
    rows = with_row_number(docs, row, key, source, text)
    copies = saved(_mix(rows, row, key, source, text).where("copies > 0").select(F.col("row").alias(row), F.col("copies").alias(times)))
    taken = rows.join(F.broadcast(copies) if is_small(copies) else copies, row)
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)


QUERY = "op8_mixing"
STATEMENT = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
