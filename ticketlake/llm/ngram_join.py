"""N-gram Jaccard join by T-occurrence search with DivideSkip, and the components of its links.

Texts are sets of distinct shingles of ``SHINGLE`` words (ASCII lower case; words end at
``[\\x20\\x09-\\x0D]``), held as 64-bit hashes. Two sets link when 100 * intersection >= PERCENT * union.

1. Equal sets become one node. Sets of the same content are one row after a pre-aggregation.
2. Filter without loss. t(n) = ceil(PERCENT * n / 100) shingles at least are common to a set of n and any
   partner. In any fixed order of shingles (here: by hash) the first l common ones lie within the first
   n - t(n) + l of both sets. With l(n) = n - t(n) + 1 a set can only have a partner if at least l(t(n)) of its
   first shingles occur in another set too. They are counted per shingle in blocks: a batch of sets
   settles what repeats within it, and sends the rest by hash range, so that a shingle of a third of all
   sets is one entry for each batch. Texts that merely share a passage end here.
3. The sets that are left are dealt into shards by their least shingle, so near copies lie together; a
   group larger than a shard is as many shards as it needs. Each shard joins its own sets: an inverted
   index; for each set its short lists are merged and counted, those that can still reach t are probed
   in its long lists by binary search (DivideSkip). Pairs of one component are not verified again.
4. The least set of each component of a shard is searched again among those of all shards, which ties the
   shards of a large group together.
5. Completion: sets in different components are still to be compared, if they share l of their first
   n - t(n) + l shingles, with l(n) of at most ``FIRST`` here. First now means: by hash, but shingles of
   ``HEAVY`` sets or more last (any order loses nothing; this one keeps shared passages out). For each shingle
   the sets outside its largest component look at the other shards that hold it. Of a pair one set or
   the other is outside, so that one of them meets half of the l shingles in the other's shard; that
   set visits it, split by salt where many visit one.

No pair is written but those of a spanning forest. Null texts, and texts without words, have no shingles
and link with nothing; shorter ones than ``SHINGLE`` words are one shingle. Null ids link with nothing and
have no component. Rows that repeat an id are nodes by their texts. Ties don't matter: every order gives
the same components. An empty table gives an empty result. Other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlake.llm.common import free_name, is_small, lean, narrowed, saved, table, text_of, with_row_number
from ticketlake.llm.components import components

SHINGLE = 4
PERCENT = 85
#: Words whose hashes a task remembers.
REMEMBERED = 200_000
#: Shingles that a block of the filter counts, and that a shard holds, on average.
BLOCK = 1_000_000
SHARD = 1_000_000
#: Sets that make a shingle a heavy one, and the most shingles (the heaviest) that are ordered as such.
HEAVY, HEAVY_MOST = 8, 200_000
#: Largest l of the completion.
FIRST = 8
#: Sets that visit one copy of a shard's index.
VISITS = 16_384
#: DivideSkip's estimate of what a probe costs against a merge step.
MU = 0.0085


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


def shingles(text: str, hashes: WordHashes, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    width = min(width, len(h))
    mixed = np.full(len(h) - width + 1, width, dtype=np.uint64)
    for n in range(width):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + h[n : len(h) - width + 1 + n]
        mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


def least_common(n, percent: int = PERCENT):
    """t(n)."""
    return -(-percent * n // 100)


def first_common(n, percent: int = PERCENT):
    """l(n); so many first shingles also hold at least one that is common."""
    return n - least_common(n, percent) + 1


def node_of(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def _sets(docs: DataFrame, key: str, text: str, width: int, percent: int, whole: bool) -> DataFrame:
    """doc_id, n, node, tokens: all shingles, or the first ones that step 2 needs."""

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            out = []
            for text in batch["text"]:
                tokens = shingles(text, hashes, width)
                n = len(tokens)
                kept = tokens if whole or not n else tokens[: n - least_common(n, percent) + first_common(n, percent)]
                out.append((n, node_of(tokens), kept.tobytes()))
            frame = pd.DataFrame(out, columns=["n", "node", "tokens"])
            frame.insert(0, "doc_id", batch["doc_id"].astype("Int64"))
            yield frame

    rows = docs.select(F.col(key).alias("doc_id"), text_of(text).alias("text"))
    return rows.mapInPandas(lean(sets), "doc_id long, n long, node long, tokens binary")


def _as_tokens(cells) -> list[np.ndarray]:
    return [np.frombuffer(c, dtype=np.uint64) for c in cells]


def _bytes(values: np.ndarray, dtype) -> bytes:
    return values.astype(dtype).tobytes()


def _shared_counts(reps: DataFrame, blocks: int) -> DataFrame:
    """node, shared: how many of a set's first shingles occur among the first ones of another set.

    Blocks go by a hash's upper half and carry its lower half. As a block is bounded, few shingles look
    alike by that; they add to the counts, which loses nothing.
    """

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for turn, batch in enumerate(batches):
            lists = _as_tokens(batch["tokens"])
            owner = np.repeat(batch["node"].to_numpy(), [len(x) for x in lists])
            tokens, inverse, count = np.unique(np.concatenate([np.empty(0, np.uint64), *lists]), return_inverse=True, return_counts=True)
            settled, times = np.unique(owner[count[inverse] > 1], return_counts=True)
            single = np.empty(len(tokens), dtype=np.int64)
            single[inverse] = owner
            block = ((tokens >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)  # ascends with the token
            edges = np.searchsorted(block, np.arange(blocks + 1))
            rows = []
            for b in range(blocks):
                part = slice(edges[b], edges[b + 1])
                alone = count[part] == 1
                mine = b == turn % blocks
                if edges[b] == edges[b + 1] and not mine:
                    continue
                rows.append((b, _bytes(tokens[part][alone], np.uint32), _bytes(single[part][alone], np.int64), _bytes(tokens[part][~alone], np.uint32), _bytes(settled if mine else settled[:0], np.int64), _bytes(times if mine else times[:0], np.int64)))
            yield pd.DataFrame(rows, columns=["block", "alone", "owner", "several", "settled", "times"])

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        read = lambda name, dtype: np.concatenate([np.frombuffer(c, dtype=dtype) for c in group[name]])
        alone, owner, several = read("alone", np.uint32), read("owner", np.int64), read("several", np.uint32)
        tokens, inverse, count = np.unique(np.concatenate([alone, several, several]), return_inverse=True, return_counts=True)
        nodes, times = np.unique(owner[count[inverse[: len(alone)]] > 1], return_counts=True)
        return pd.DataFrame({"node": np.concatenate([nodes, read("settled", np.int64)]), "times": np.concatenate([times, read("times", np.int64)])})

    sent = reps.select("node", "tokens").mapInPandas(lean(send), "block int, alone binary, owner binary, several binary, settled binary, times binary")
    met = sent.groupBy("block").applyInPandas(meet, "node long, times long")
    return met.groupBy("node").agg(F.sum("times").alias("shared"))


class Forest:
    """Union-find over numbered sets; a root is the least number of its tree."""

    def __init__(self, size: int):
        self.up = np.arange(size)

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return int(x)

    def roots(self, xs: np.ndarray) -> np.ndarray:
        found = self.up[xs]
        while True:
            further = self.up[found]
            if np.array_equal(further, found):
                return found
            found = further

    def join(self, x: int, y: int) -> None:
        x, y = sorted((self.root(x), self.root(y)))
        self.up[y] = x


class Index:
    """Inverted lists of numbered sets."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.percent = percent
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)
        owner = np.repeat(np.arange(len(sets), dtype=np.int32), self.sizes)
        tokens = np.concatenate([np.empty(0, np.uint64), *sets])
        order = np.argsort(tokens, kind="stable")  # owners ascend within a list
        self.owner, tokens = owner[order], tokens[order]
        del owner, order
        first = np.append(True, tokens[1:] != tokens[:-1])[: len(tokens)]
        self.start = np.flatnonzero(first)
        self.tokens = tokens[self.start]
        self.stop = np.append(self.start[1:], len(tokens))

    def search(self, query: np.ndarray, skip) -> Iterator[int]:
        """Numbers of the sets that link with the query; ``skip`` drops candidates nobody needs to verify."""
        n, need = len(query), least_common(len(query), self.percent)
        at = np.searchsorted(self.tokens, query)
        inside = at < len(self.tokens)
        at, known = at[inside], query[inside]
        at = at[self.tokens[at] == known]
        length = self.stop[at] - self.start[at]
        if len(at) < need:
            return
        at, longest = at[np.argsort(length, kind="stable")], int(length.max())
        long = min(need - 1, int(need / (MU * np.log2(longest + 1) + 1)))
        short, probed = at[: len(at) - long], at[len(at) - long :]
        merged = np.sort(np.concatenate([self.owner[self.start[i] : self.stop[i]] for i in short]), kind="stable")
        candidates, count = np.unique(merged, return_counts=True)
        sizes = self.sizes[candidates]
        possible = (count >= need - long) & (sizes >= need) & (least_common(sizes, self.percent) <= n)
        candidates, count = candidates[possible], count[possible]
        wanted = ~skip(candidates)
        candidates, count = candidates[wanted], count[wanted]
        needed = -(-self.percent * (n + self.sizes[candidates]) // (100 + self.percent))
        for left, i in zip(range(len(probed), 0, -1), probed):
            hopeful = count + left >= needed
            if not hopeful.all():
                candidates, count, needed = candidates[hopeful], count[hopeful], needed[hopeful]
            if not len(candidates):
                return
            owners = self.owner[self.start[i] : self.stop[i]]
            place = np.minimum(np.searchsorted(owners, candidates), len(owners) - 1)
            count = count + (owners[place] == candidates)
        yield from candidates[count >= needed].tolist()


def self_join(sets: list[np.ndarray], percent: int = PERCENT) -> np.ndarray:
    """Number of the least set of each set's component."""
    index, forest = Index(sets, percent), Forest(len(sets))
    for number, query in enumerate(sets):
        for other in index.search(query, lambda c, x=number: forest.roots(c) == forest.root(x)):
            forest.join(number, other)
    return forest.roots(np.arange(len(sets)))


def _shards(sets: DataFrame, percent: int, keep: list[str]) -> DataFrame:
    """Of node, n, least, shard, comp, tokens the ones to keep: near copies side by side, joined within each shard."""

    def join(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values("node")
        shard["comp"] = shard["node"].to_numpy()[self_join(_as_tokens(shard["tokens"]), percent)]
        return shard[keep]

    total = sets.agg(F.sum("n")).head()[0] or 0
    count = F.lit(-(-total // SHARD) or 1)
    # A least shingle whose sets fill a shard alone is spread over as many as it needs.
    large = saved(sets.groupBy("least").agg(F.sum("n").alias("size")).where(F.col("size") > SHARD))
    dealt = sets.select("node", "n", "least", "tokens").join(F.broadcast(large) if is_small(large) else large, "least", "left")
    part = F.coalesce(F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / SHARD)), F.lit(0))
    dealt = dealt.withColumn("shard", (F.pmod("least", count) + count * part).cast("int")).drop("size")
    kinds = {"shard": "int", "tokens": "binary"}
    return saved(dealt.groupBy("shard").applyInPandas(join, ", ".join(f"{c} {kinds.get(c, 'long')}" for c in keep)))


def _heavy(homes: DataFrame) -> np.ndarray:
    """Sorted heavy shingles."""

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            tokens, times = np.unique(np.concatenate([np.empty(0, np.uint64), *_as_tokens(batch["tokens"])]), return_counts=True)
            yield pd.DataFrame({"token": tokens.view(np.int64), "times": times})

    counted = homes.select("tokens").mapInPandas(lean(counts), "token long, times long").groupBy("token").agg(F.sum("times").alias("times"))
    found = counted.where(F.col("times") >= HEAVY).orderBy(F.desc("times"), "token").limit(HEAVY_MOST).collect()
    return np.sort(np.array([r["token"] for r in found], dtype=np.int64).view(np.uint64))


def _visits(homes: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """node, shard: the shards that a set has still to be searched in."""
    heavy = _heavy(homes)

    def firsts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lists, fewest = [], []
            for tokens in _as_tokens(batch["tokens"]):
                place = np.minimum(np.searchsorted(heavy, tokens), max(len(heavy) - 1, 0))
                last = heavy[place] == tokens if len(heavy) else np.zeros(len(tokens), dtype=bool)
                need = least_common(len(tokens), percent)
                first = min(FIRST, first_common(len(tokens), percent))
                lists.append(np.concatenate([tokens[~last], tokens[last]])[: len(tokens) - need + first])
                fewest.append((min(FIRST, first_common(need, percent)) + 1) // 2)
            frame = batch[["node", "shard"]].assign(fewest=fewest).loc[batch.index.repeat([len(x) for x in lists])]
            frame["token"] = np.concatenate([np.empty(0, np.uint64), *lists]).view(np.int64)
            yield frame

    postings = homes.select("node", "shard", "tokens").mapInPandas(lean(firsts), "node long, shard int, fewest int, token long")
    postings = saved(postings.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))
    by_label = postings.groupBy("token", "label").agg(F.count("*").alias("rows"))
    largest = by_label.groupBy("token").agg(F.max_by("label", F.struct("rows", "label")).alias("largest"), F.count("*").alias("labels"))
    unsettled = saved(largest.where("labels > 1").select("token", "largest"))
    places = saved(postings.join(unsettled, "token", "left_semi").select("token", "shard").distinct())
    outside = postings.join(unsettled, "token").where("label <> largest").select("token", "node", "fewest", F.col("shard").alias("home"))
    met = outside.join(places, "token").where("shard <> home").groupBy("node", "shard", "fewest").count()
    return met.where("count >= fewest").select("node", "shard").distinct()


def _searched(homes: DataFrame, visits: DataFrame, percent: int) -> DataFrame:
    """Edges a, b that the visiting sets find."""
    visits = saved(visits)
    salts = visits.groupBy("shard").count().select("shard", F.ceil(F.col("count") / VISITS).alias("salts"))
    guests = visits.join(salts, "shard").withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")))
    visitors = homes.select("node", F.col("tokens").alias("query"))
    guests = guests.select("node", F.col("shard").alias("to_shard"), F.col("salt").alias("to_salt")).join(visitors, "node")
    guests = guests.select("to_shard", "to_salt", F.col("node").alias("guest"), "query")
    hosts = homes.select("node", "shard", "tokens").join(salts, "shard").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))

    def search(host: pd.DataFrame, guest: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(host) and len(guest):
            index, forest = Index(_as_tokens(host["tokens"]), percent), Forest(len(host))
            nodes = host["node"].to_numpy()
            for node, query in zip(guest["guest"], _as_tokens(guest["query"])):
                links = list(index.search(query, lambda c: np.zeros(len(c), dtype=bool)))
                roots = sorted({forest.root(x) for x in links})
                found += [(node, nodes[r]) for r in roots]
                for r in roots[1:]:  # one guest ties them: the next guest names one
                    forest.join(roots[0], r)
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    sides = hosts.select("shard", "salt", "node", "tokens").groupBy("shard", "salt").cogroup(guests.groupBy("to_shard", "to_salt"))
    return sides.applyInPandas(search, "a long, b long")


def linked_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    rows = saved(_sets(docs, key, text, width, percent, whole=False))
    usable = rows.where("doc_id IS NOT NULL AND n > 0")
    reps = saved(usable.groupBy("node").agg(F.min(F.struct("doc_id", "n")).alias("r")).select("node", "r.*"))
    copies = saved(usable.select("node", "doc_id").join(reps.select("node", F.col("doc_id").alias("first")), "node").where("doc_id <> first").select("node", "doc_id"))
    first = narrowed(usable, copies, ["node", "doc_id"], "left_anti")
    total = reps.agg(F.sum("n")).head()[0] or 0
    least = lambda c: F.floor((F.lit(percent) * c + 99) / 100)
    few = least(F.col("n"))
    fewest = few - least(few) + 1
    shared = _shared_counts(first, -(-total * (100 - percent) * 2 // (100 * BLOCK)) or 1)
    hopeful = saved(shared.join(reps, "node").where(F.col("shared") >= fewest).select("node", "doc_id"))
    texts = narrowed(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), hopeful, ["doc_id"], "left_semi")
    whole = narrowed(_sets(texts, "doc_id", "text", width, percent, whole=True), hopeful, ["node", "doc_id"], "left_semi")
    # Rows that repeat an id and a text are equal sets of one node. Sets go by their least shingle.
    sets = saved(whole.select("node", "n", "tokens", F.xxhash64(F.substring(F.col("tokens"), 1, 8)).alias("least")))
    homes = _shards(sets, percent, ["node", "n", "least", "shard", "comp", "tokens"])
    edges = homes.where("node <> comp").select(F.col("node").alias("a"), F.col("comp").alias("b"))
    if homes.select("shard").distinct().count() > 1:
        leaders = _shards(homes.where("node = comp").drop("comp", "shard"), percent, ["node", "comp"])
        edges = edges.unionByName(leaders.where("node <> comp").select(F.col("node").alias("a"), F.col("comp").alias("b")))
        visits = _visits(homes, components(edges), percent)
        edges = edges.unionByName(_searched(homes, visits, percent))
    labels = components(edges)
    named = labels.join(reps.select("node", "doc_id"), "node")
    least_ids = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    found = saved(named.join(least_ids, "label").select("node", "component_id"))
    alone = reps.select("node", "doc_id").join(found, "node", "left").select("node", F.coalesce("component_id", "doc_id").alias("component_id"))
    out = rows.select("doc_id", "n", F.when(F.col("n") > 0, F.col("node")).alias("node")).join(alone, "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component stays, the one with the least number (``with_row_number``: its id, if it has one of its own). All columns."""
    row = free_name("row", docs.columns)
    docs = with_row_number(docs, row, key, text)
    dropped = saved(linked_documents(docs, row, text, width, percent).where("doc_id <> component_id").select(F.col("doc_id").alias(row)))
    return narrowed(docs, dropped, [row], "left_anti").drop(row)


QUERY = "op10_ngram_join"
STATEMENT = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_documents(table(spark, sf_dir, "documents"))
