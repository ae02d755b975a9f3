"""Hard negatives by inner product: a cover tree over norm-augmented candidates.

Components become integers, floor(256 * x), and a label (label + 1) % 10 where the id is divisible by 7. Candidates get one
more coordinate, sqrt(M^2 - |x|^2) with the largest norm M, so that all lie on one sphere, where inner products and distances
agree; anchors get 0 there. For an anchor q and a node of centre c and covering radius r, q.x lies within q.c -/+ |q| r.

1. The first level of the tree is global: pivots by farthest-first traversal of a sample of at most ``SAMPLE`` rows (which rows,
   changes bounds, not results). Every row goes to its nearest pivot; nodes larger than ``BLOCK`` rows are cut by a hash of the
   id, so copies of one vector, however many, span blocks. Below, each block is a cover tree of its own: the radius
   shrinks by ``BASE`` a level, each level's centres cover their node's rows. A node that no level splits into fewer than ``CENTRES``
   parts (as in data without structure) is a leaf, compared whole.
2. Anchors first search their own block, for a bound. Groups of anchors and cells of blocks then meet only where the block's
   root can reach a bound; the others aren't shipped. A search descends best first: the node of the highest bound next, none
   that lies outside all windows or below what is found already, and leaves are verified in exact integers.
3. First positives (the same label), then one window for each anchor and positive (other labels).

Rows with a null id, label or vector, with null or non-finite components, or of another length than the most frequent one (of
equals the shorter) take no part. Rows that repeat an id count once (least label, then least vector). Components beyond 2^62 and scores beyond a
long are held at that. A negative positive_score has an empty window. Ties go to the smaller id, which
also orders equal vectors. An empty table gives an empty result. Other columns play no part.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ticketlake.llm.common import saved, table

EVERY, K = 100, 5
SAMPLE, PIVOTS = 2048, 256
BLOCK, CELL, GROUP, TOGETHER, SHELF = 4096, 4, 128, 8, 4096
LEAF, CENTRES, BASE = 32, 64, 1.3
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1
_FOUND = "anchor_id long, window int, vec_id long, score long"


def quantised(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, label, v (array<long>) of the rows that take part."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = embeddings.select(F.col(key).cast("bigint").alias("vec_id"), F.col(label).cast("bigint").alias("label"), v.alias("v"))
    rows = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").where(~F.exists("v", bad))
    limit = float(1 << 62)
    whole = lambda x: F.floor(F.greatest(F.lit(-limit), F.least(F.lit(limit), x * 256.0)))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.select("vec_id", moved.alias("label"), F.transform("v", whole).alias("v"))
    rows = rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.*")
    sizes = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").head()
    return rows.where(F.size("v") == (sizes[0] if sizes else 0))


def matrix(cells) -> np.ndarray:
    return np.stack([np.asarray(c, dtype=np.int64) for c in cells]) if len(cells) else np.empty((0, 0), np.int64)


def dots(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact x @ q of integers."""
    reach = len(q) * float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0))
    if reach < 2.0**52:  # whole numbers that doubles hold
        return (x.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    if reach < 2.0**62:
        return x @ q
    return np.array([min(max(sum(a * b for a, b in zip(row, q.tolist())), _LEAST), _MOST) for row in x.tolist()], dtype=np.int64)


def augmented(x: np.ndarray, largest: float) -> np.ndarray:
    x = x.astype(np.float64)
    return np.column_stack([x, np.sqrt(np.maximum(largest - (x * x).sum(axis=1), 0.0))])


def bounds(centres: np.ndarray, radius: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of q with what lies in balls; a little wider, for rounding."""
    centres, norm = centres.astype(np.float64), np.sqrt((q * q).sum())
    middle, far = centres @ q, norm * radius
    far = far + 1.0 + 1e-9 * norm * (np.sqrt((centres * centres).sum(axis=1)) + radius)
    return middle - far, middle + far


class CoverTree:
    """Rows in tree order; of each node its centre (a row), covering radius, rows and children as ranges."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, largest: float):
        points, order, nodes, at = augmented(x, largest), [], [], 0
        distance = lambda rows, centre: np.sqrt(((points[rows] - points[centre]) ** 2).sum(axis=1))
        all_rows = np.arange(len(ids))
        first = int(((points - points.mean(axis=0)) ** 2).sum(axis=1).argmin())
        queue: list[tuple[int, float, np.ndarray]] = [(first, float(distance(all_rows, first).max()), all_rows)]
        while at < len(queue):
            centre, radius, rows = queue[at]
            children = self._split(centre, radius, rows, distance)
            nodes.append((centre, radius, len(queue), len(queue) + len(children), rows))
            queue += children
            at += 1
        # Rows go where their leaf stands; leaves follow each other.
        start, filled = np.zeros(len(nodes), dtype=np.int64), 0
        for n, (_, _, low, high, rows) in enumerate(nodes):
            if low == high:
                start[n] = filled
                order.append(rows)
                filled += len(rows)
        order = np.concatenate([np.empty(0, np.int64), *order])
        self.ids, self.labels, self.x, self.largest = ids[order], labels[order], x[order], largest
        place = np.empty(len(ids), dtype=np.int64)
        place[order] = np.arange(len(order))
        self.centre = place[np.array([n[0] for n in nodes], dtype=np.int64)]
        self.radius = np.array([n[1] for n in nodes])
        self.below = np.array([[n[2], n[3]] for n in nodes], dtype=np.int64).reshape(-1, 2)
        self.rows = np.column_stack([start, start + np.array([len(n[4]) for n in nodes], dtype=np.int64)])

    @staticmethod
    def _split(centre: int, radius: float, rows: np.ndarray, distance) -> list[tuple]:
        """The next level: centres whose balls of the smaller radius cover the node's rows."""
        if len(rows) <= LEAF or radius <= 0:
            return []
        children, left, nearer = [], rows, radius / BASE
        while len(left):
            if len(children) == CENTRES:
                return []
            d = distance(left, centre)
            close = d <= nearer
            children.append((centre, float(d[close].max()), left[close]))
            left = left[~close]
            centre = int(left[0]) if len(left) else centre
        return children

    FIELDS = ("ids", "labels", "x", "centre", "radius", "below", "rows")

    def packed(self) -> bytes:
        blob = b""
        for name in self.FIELDS:
            values = getattr(self, name)
            part = zstandard.compress(np.ascontiguousarray(values).tobytes(), 1)
            blob += len(part).to_bytes(8, "little") + part
        return blob

    @classmethod
    def read(cls, blob: bytes) -> CoverTree:
        tree, at = cls.__new__(cls), 0
        for name in cls.FIELDS:
            size = int.from_bytes(blob[at : at + 8], "little")
            values = np.frombuffer(zstandard.decompress(blob[at + 8 : at + 8 + size]), np.float64 if name == "radius" else np.int64)
            at += 8 + size
            setattr(tree, name, values)
        tree.x = tree.x.reshape(len(tree.ids), -1)
        tree.below, tree.rows = tree.below.reshape(-1, 2), tree.rows.reshape(-1, 2)
        return tree

    def search(self, ask: Ask) -> None:
        """Adds to the ask what this tree holds for it."""
        q = ask.q.astype(np.float64)

        def push(nodes: np.ndarray) -> None:
            low, high = bounds(self.x[self.centre[nodes]], self.radius[nodes], q)
            for n, high, low in zip(nodes.tolist(), high.tolist(), low.tolist()):
                if ask.wants(low, high):
                    heapq.heappush(heap, (-high, low, n))

        heap: list[tuple[float, float, int]] = []
        push(np.zeros(1, dtype=np.int64))
        while heap:
            high, low, node = heapq.heappop(heap)
            if not ask.wants(low, -high):
                if -high < ask.floor:
                    return  # all that is left reaches less
                continue
            start, stop = self.below[node]
            if start < stop:
                push(np.arange(start, stop))
            else:
                rows = slice(*self.rows[node])
                ask.verify(self.ids[rows], self.labels[rows], dots(self.x[rows], ask.q))


class Ask:
    """An anchor's windows [low, high] of scores, each with the ``k`` best rows found so far."""

    def __init__(self, anchor: int, label: int, q: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, k: int):
        self.anchor, self.label, self.q, self.same, self.k = anchor, label, q, same, k
        self.low, self.high, self.need = low.copy(), high, low.copy()
        self.ids = [np.empty(0, np.int64) for _ in low]
        self.scores = [np.empty(0, np.int64) for _ in low]
        self.floor = self.need.min(initial=_MOST)

    def wants(self, low: float, high: float) -> bool:
        return bool(((self.need <= high) & (self.high >= low)).any())

    def verify(self, ids: np.ndarray, labels: np.ndarray, scores: np.ndarray) -> None:
        usable = ((labels == self.label) == self.same) & (ids != self.anchor) & (scores >= self.floor)
        ids, scores = ids[usable], scores[usable]
        for w in range(len(self.low)):
            fits = (scores >= self.need[w]) & (scores <= self.high[w])
            if fits.any():
                found, score = np.concatenate([self.ids[w], ids[fits]]), np.concatenate([self.scores[w], scores[fits]])
                first = np.lexsort((found, ~score))[: self.k]  # ~score falls as the score rises, without overflow
                self.ids[w], self.scores[w] = found[first], score[first]
                if len(first) == self.k:
                    self.need[w] = max(self.low[w], score[first[-1]])
        self.floor = self.need.min(initial=_MOST)

    def found(self) -> Iterator[tuple]:
        for w, (ids, scores) in enumerate(zip(self.ids, self.scores)):
            yield from ((self.anchor, w, i, s) for i, s in zip(ids.tolist(), scores.tolist()))


def _pivots(rows: DataFrame, total: int, largest: float) -> np.ndarray:
    """Farthest-first traversal of a bounded sample: each further pivot is the row that the others cover worst."""
    some = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(max(total, 1))) < 2 * SAMPLE).select("v").limit(SAMPLE).collect() or rows.select("v").limit(1).collect()
    points = augmented(matrix([r.v for r in some]), largest)
    chosen, cover = [0], ((points - points[0]) ** 2).sum(axis=1)
    while len(chosen) < min(PIVOTS, -(-total // BLOCK)) and cover.max() > 0:
        chosen.append(int(cover.argmax()))
        cover = np.minimum(cover, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    return points[chosen]


def cover_trees(rows: DataFrame, every: int, k: int) -> DataFrame | None:
    """block, tree, centre, radius, and the anchors of the block with the bounds that it gives them."""
    total, largest = rows.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda n, x: n + x.cast("double") * x))).head()
    if not total:
        return None
    pivots = _pivots(rows, total, largest)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = augmented(matrix(batch["v"].tolist()), largest)
                yield batch.assign(node=((pivots * pivots).sum(axis=1) - 2 * x @ pivots.T).argmin(axis=1).astype(np.int32))

    placed = saved(rows.mapInPandas(assign, "vec_id long, label long, v array<long>, node int"))
    # At most one row for each pivot.
    parts = placed.groupBy("node").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    blocks = placed.join(F.broadcast(parts), "node").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("parts")) * PIVOTS + F.col("node"))

    def build(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("vec_id")
        ids, labels, x = part["vec_id"].to_numpy(np.int64), part["label"].to_numpy(np.int64), matrix(part["v"].tolist())
        tree, anchors = CoverTree(ids, labels, x, largest), []
        for n in np.flatnonzero(ids % every == 0):
            ask = Ask(int(ids[n]), int(labels[n]), x[n], np.array([_LEAST]), np.array([_MOST]), True, k)
            tree.search(ask)
            anchors.append({"anchor_id": int(ids[n]), "label": int(labels[n]), "q": x[n].tolist(), "low": [int(ask.need[0])], "high": [_MOST]})
        return pd.DataFrame([(part["block"].iloc[0], tree.packed(), tree.x[tree.centre[0]].tolist(), tree.radius[0], anchors)], columns=["block", "tree", "centre", "radius", "anchors"])

    anchor = "struct<anchor_id:bigint,label:bigint,q:array<bigint>,low:array<bigint>,high:array<bigint>>"
    return saved(blocks.groupBy("block").applyInPandas(build, f"block long, tree binary, centre array<long>, radius double, anchors array<{anchor}>"))


def _asked(batch: pd.DataFrame, same: bool, k: int) -> list[Ask]:
    as_array = lambda cell: np.asarray(cell, dtype=np.int64)
    return [Ask(int(r.anchor_id), int(r.label), as_array(r.q), as_array(r.low), as_array(r.high), same, k) for r in batch.itertuples()]


def _upto(count: int):
    """One row for each of 0 to count - 1."""
    return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(count - 1).cast("bigint")))


def _near_cells(trees: DataFrame, asked: DataFrame, cell, blocks: int, same: bool, k: int) -> DataFrame:
    """group, cell: cells with a block whose root can hold something for an anchor of the group."""
    shelves, parts = -(-blocks // SHELF), -(-asked.count() // SHELF) or 1
    shelf = F.pmod(F.xxhash64("block", F.lit(2)), F.lit(shelves)).alias("shelf")
    heads = trees.groupBy(shelf).agg(F.collect_list(F.struct(cell.alias("cell"), "centre", "radius")).alias("heads"))

    def reach(mine: pd.DataFrame, shelf: pd.DataFrame) -> pd.DataFrame:
        found: set[tuple[int, int]] = set()
        if len(mine) and len(shelf):
            rows = shelf["heads"].iloc[0]
            centres, radius, cells = matrix([r["centre"] for r in rows]), np.array([r["radius"] for r in rows]), np.array([r["cell"] for r in rows])
            for group, ask in zip(mine["group"], _asked(mine, same, k)):
                low, high = bounds(centres, radius, ask.q.astype(np.float64))
                near = ((ask.need[:, None] <= high) & (ask.high[:, None] >= low)).any(axis=0)
                found.update((group, c) for c in cells[near].tolist())
        return pd.DataFrame(sorted(found), columns=["group", "cell"], dtype="int64")

    # A stated query set against all blocks' roots, both cut into parts: each shelf meets each part once.
    asking = asked.withColumn("part", F.pmod("group", F.lit(parts))).withColumn("shelf", _upto(shelves))
    offered = heads.withColumn("part", _upto(parts))
    return saved(asking.groupBy("shelf", "part").cogroup(offered.groupBy("shelf", "part")).applyInPandas(reach, "group long, cell long").distinct())


def search(trees: DataFrame, asks: DataFrame, same: bool, k: int) -> DataFrame:
    """anchor_id, window, vec_id, score, rank: the first k of each window. asks: anchor_id, label, q, low, high, block (of the anchor)."""
    blocks = trees.count()
    cell = F.pmod(F.xxhash64("block"), F.lit(-(-blocks // CELL)))
    sizes = asks.groupBy("block").agg(F.ceil(F.count("*") / GROUP).alias("parts"))
    grouped = asks.join(sizes, "block").withColumn("part", F.pmod(F.xxhash64("anchor_id"), F.col("parts")))
    asked = saved(grouped.withColumn("group", F.xxhash64("block", "part")).drop("block", "part", "parts"))
    pairs = _near_cells(trees, asked, cell, blocks, same, k)
    salts = -(-asked.select("group").distinct().count() // TOGETHER) or 1
    salt = F.pmod(F.xxhash64("group", F.lit(1)), F.lit(salts))
    places = pairs.withColumn("salt", salt)
    hosts = trees.select(cell.alias("cell"), "block", "tree").join(places.select("cell", "salt").distinct(), "cell")
    guests = asked.join(pairs.select("group", F.col("cell").alias("to_cell"), salt.alias("to_salt")), "group")

    def meet(host: pd.DataFrame, guest: pd.DataFrame) -> pd.DataFrame:
        asks_ = _asked(guest, same, k) if len(host) else []
        for blob in host["tree"] if asks_ else []:
            tree = CoverTree.read(blob)
            for ask in asks_:
                tree.search(ask)
        return pd.DataFrame([row for ask in asks_ for row in ask.found()], columns=["anchor_id", "window", "vec_id", "score"])

    found = hosts.groupBy("cell", "salt").cogroup(guests.groupBy("to_cell", "to_salt")).applyInPandas(meet, _FOUND)
    first = Window.partitionBy("anchor_id", "window").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)


_NEGATIVES = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def hard_negatives(embeddings: DataFrame, every: int = EVERY, k: int = K, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    trees = cover_trees(saved(quantised(embeddings, key, vector, label)), every, k)
    if trees is None:
        return embeddings.sparkSession.createDataFrame([], _NEGATIVES)
    asks = saved(trees.select("block", F.explode("anchors").alias("a")).select("a.*", "block"))
    positives = saved(search(trees, asks, True, k).select("anchor_id", F.col("rank").alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    windows = positives.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("window", "positive_score"))).alias("ps"))
    # 80 * p <= 100 * n in whole numbers: n >= p - p div 5; a window whose low end is above the high one is empty.
    low = f"transform(ps, p -> CASE WHEN p.positive_score < 0 THEN {_MOST} ELSE p.positive_score - p.positive_score div 5 END)"
    ends = windows.select("anchor_id", F.expr(low).alias("low"), F.col("ps.positive_score").alias("high"))
    found = search(trees, asks.drop("low", "high").join(ends, "anchor_id"), False, k)
    found = found.withColumn("window", F.col("window") + 1).join(positives, ["anchor_id", "window"])
    return found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


QUERY = "op11_hard_negatives"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(table(spark, sf_dir, "embeddings"))


STATEMENT = """
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM usable a JOIN usable b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score
  FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER best::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW best AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER best <= 5
"""
