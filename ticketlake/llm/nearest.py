"""Nearest neighbours by cosine: shifted space-filling curves, and an exact completion.

Vectors are projected to ``AXES`` coordinates, ``CURVES`` times with other (seeded) axes and shifts, and ordered
along a Hilbert curve each. Spark range-partitions the curves by key and id; in each partition a query is compared
with the ``WINDOW`` vectors on either side, and the windows of all curves merge into a first list. On data
without low-dimensional structure such lists alone miss most neighbours (see README), so they only
give each query a bound: the score of its k-th candidate. The completion holds blocks of queries against
blocks of vectors, both cut along the first curve; by the centre and radius of a block it passes over what
can't reach a query's bound, and reranks the rest. Results are exact, whatever the curves find.

Scores are computed in double precision from the original vectors; the order of additions depends on
neither partition nor block, so equal vectors score alike and ties go to the smaller id. Null vectors, zero
vectors and those with null or non-finite components take no part, nor do vectors of another length than
the most frequent one, nor null ids. Rows that repeat an id count once (the least vector). With fewer candidates
than k all are returned. An empty table gives an empty result. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ticketlake.llm.common import saved, table
from ticketlake.operators.ordering import with_rank

K = 5
EVERY = 50
CURVES, AXES, BITS = 4, 8, 7
WINDOW = 64
#: Vectors (curves counted) of a range partition, vectors of a block, queries of a block.
PART, BLOCK, QUERIES_BLOCK = 50_000, 2048, 2048
#: Vector blocks that meet one copy of the queries, at most; query blocks that meet one copy of a vector block.
TOGETHER, QUERIES_TOGETHER = 32, 8

_FOUND = "query_id long, vec_id long, score double"


def usable(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and v (array<double>) of the vectors that take part."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = embeddings.select(F.col(key).cast("bigint").alias("vec_id"), v.alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    rows = rows.where(~F.exists("v", bad) & F.exists("v", lambda x: x != 0))
    rows = rows.groupBy("vec_id").agg(F.min("v").alias("v"))
    sizes = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").head()
    return rows.where(F.size("v") == (sizes[0] if sizes else 0))


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Positions of integer points along a Hilbert curve (Skilling's transform, then interleaved bits)."""
    x = points.astype(np.int64).T.copy()
    axes = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(axes):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, axes):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(axes):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


def curve_keys(vectors: np.ndarray, curve: int) -> np.ndarray:
    """Keys of unit vectors along one of the shifted curves."""
    draw = np.random.default_rng(1000 + curve)
    size = vectors.shape[1]
    directions = draw.standard_normal((size, AXES)) / np.sqrt(size)
    projected = vectors @ directions * np.sqrt(size) + draw.uniform(-0.5, 0.5, AXES)  # about -3 .. 3
    cells = ((projected + 4.0) / 8.0 * (1 << BITS)).astype(np.int64)
    return hilbert_keys(np.clip(cells, 0, (1 << BITS) - 1))


def stacked(cells) -> np.ndarray:
    return np.stack([np.asarray(c, dtype=np.float64) for c in cells]) if len(cells) else np.empty((0, 0))


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of a with the same row of b; each row is added up alike wherever it stands."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def _best(query_ids, ids, found, k: int) -> pd.DataFrame:
    """The first k of each query."""
    frame = pd.DataFrame({"query_id": query_ids, "vec_id": ids, "score": found}).drop_duplicates()
    return frame.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True]).groupby("query_id").head(k)


def dealt(keyed: DataFrame) -> DataFrame:
    """Ranges of the curves, of about ``PART`` vectors each; the id is part of the range, so copies of one vector span many."""
    return keyed.repartitionByRange(-(-keyed.count() // PART) or 1, "curve", "key", "vec_id")


def window_candidates(keyed: DataFrame, k: int, every: int) -> DataFrame:
    """Candidates of each query from the windows of all curves."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [b for b in batches if len(b)]
        if not rows:
            return
        part = pd.concat(rows)
        for _, curve in part.groupby("curve"):
            curve = curve.sort_values(["key", "vec_id"])
            ids, vectors = curve["vec_id"].to_numpy(), stacked(curve["v"].to_list())
            asked = np.flatnonzero(ids % every == 0)
            for some in np.array_split(asked, max(1, len(asked) // 500)):
                near = some[:, None] + np.array([*range(-WINDOW, 0), *range(1, WINDOW + 1)])
                at, place = np.nonzero((near >= 0) & (near < len(ids)))
                if len(at):
                    mine, other = some[at], near[at, place]
                    yield _best(ids[mine], ids[other], scores(vectors[mine], vectors[other]), k)

    return _top(dealt(keyed).mapInPandas(compare, _FOUND), k)


def _top(found: DataFrame, k: int) -> DataFrame:
    first = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)


def _blocks(rows: DataFrame, size: int, extra: str | None = None) -> tuple[DataFrame, int]:
    """Blocks of vectors that lie together on the first curve: block, ids, vectors, extra; and their number.

    Blocks go by rank, so their size depends neither on the number of partitions nor on how often a key occurs.
    """

    def cut(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("vec_id")
        more = part[extra].to_numpy(dtype=np.float64) if extra else np.empty(0)
        row = (part["block"].iloc[0], part["vec_id"].to_numpy(dtype=np.int64).tobytes(), stacked(part["v"].to_list()).tobytes(), more.tobytes())
        return pd.DataFrame([row], columns=["block", "ids", "vectors", "extra"])

    ranked = with_rank(rows, [F.col("key"), F.col("vec_id")], "_rank").withColumn("block", F.expr(f"(_rank - 1) div {size}"))
    blocks = saved(ranked.drop("_rank").groupBy("block").applyInPandas(cut, "block long, ids binary, vectors binary, extra binary"))
    return blocks, blocks.count()


def completion(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Every vector that may be among a query's first k, given ``bound`` of each query."""

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                ids, query_ids = np.frombuffer(row.ids, np.int64), np.frombuffer(row.query_ids, np.int64)
                x = np.frombuffer(row.vectors, np.float64).reshape(len(ids), -1)
                q, bound = np.frombuffer(row.query_vectors, np.float64).reshape(len(query_ids), -1), np.frombuffer(row.bounds, np.float64)
                x_unit, q_unit = (m / np.sqrt((m * m).sum(axis=1, keepdims=True)) for m in (x, q))
                centre = x_unit.sum(axis=0)
                centre = centre / max(np.sqrt((centre * centre).sum()), 1e-300)
                radius = np.arccos(np.clip((x_unit @ centre).min(), -1, 1))
                angle = np.arccos(np.clip(q_unit @ centre, -1, 1))
                reach = np.cos(np.maximum(angle - radius, 0))
                asked = np.flatnonzero(reach >= bound - 1e-9)
                for some in np.array_split(asked, max(1, len(asked) // 64)):
                    if len(some):
                        close = (q_unit[some] @ x_unit.T >= bound[some, None] - 1e-9) & (query_ids[some, None] != ids[None, :])
                        at, place = np.nonzero(close)
                        if len(at):
                            yield _best(query_ids[some[at]], ids[place], scores(q[some[at]], x[place]), k)

    vector_blocks, count = _blocks(vectors, BLOCK)
    query_blocks, query_count = _blocks(queries, QUERIES_BLOCK, "bound")
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salts = max(-(-count // TOGETHER), min(count, tasks), 1)
    groups = -(-query_count // QUERIES_TOGETHER) or 1
    copies = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    rows = vector_blocks.select("ids", "vectors", (F.col("block") % salts).cast("int").alias("salt"), copies(groups, "query_group"))
    asked = query_blocks.select(F.col("ids").alias("query_ids"), F.col("vectors").alias("query_vectors"), F.col("extra").alias("bounds"), F.expr(f"cast(block div {QUERIES_TOGETHER} as int)").alias("query_group"), copies(salts, "salt"))
    # Spark would judge these copies by the size of the table they are made of, and broadcast them through the driver.
    return rows.join(asked.hint("merge"), ["query_group", "salt"]).mapInPandas(search, _FOUND)


def nearest(embeddings: DataFrame, k: int = K, every: int = EVERY, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score for the vectors whose id is divisible by ``every``."""

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = stacked(batch["v"].to_list())
                x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
                for curve in range(CURVES):
                    yield batch.assign(curve=curve, key=curve_keys(x, curve))

    keyed = saved(usable(embeddings, key, vector).mapInPandas(keys, "vec_id long, v array<double>, curve int, key long"))
    first = saved(window_candidates(keyed, k, every).select("query_id", "vec_id", "score", "rank"))
    bounds = first.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("bound"))
    vectors = keyed.where("curve = 0").select("vec_id", "v", "key")
    queries = vectors.where(F.pmod(F.col("vec_id"), F.lit(every)) == 0).join(bounds, "vec_id", "left").withColumn("bound", F.coalesce("bound", F.lit(-2.0)))
    found = first.select("query_id", "vec_id", "score").unionByName(completion(vectors, queries, k))
    return _top(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


QUERY = "op4_nearest"
STATEMENT = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
