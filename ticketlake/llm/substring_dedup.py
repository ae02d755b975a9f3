"""Substring dedup by seed and extend: winnowed anchors, windows around shared ones, maximal repeats.

Words end at ``[\\x20\\x09-\\x0D]`` and are compared unchanged. A window is ``WINDOW`` consecutive words of one
document. Every word goes that a window covers whose words also start earlier: in a document that comes
before, or earlier in the same one. All windows are judged on the input.

1. Seeds. Of the hashes of ``SEED`` words in a window the least one is the window's anchor (winnowing), so equal
   windows have equal anchors, and about one position in six is an anchor. Anchors meet in buckets of hash
   ranges; those that occur twice or more are seeds.
2. Extension. From each place of a seed, the windows that hold it reach up to ``WINDOW`` - ``SEED`` words to
   either side. They meet in buckets by a 128-bit hash of their words; of each group all but the first are repeats.
   No pair of places is written, so a passage of a third of all documents costs a row for each place.
3. Neighbouring repeats merge into maximal ones, ``[start, stop)`` in words, which leave the text.

A task settles what repeats within its own run of documents and sends each key of a run once, so a bucket gets at
most one entry of a hot key from each run. Buckets hold about ``BUCKET`` entries, at any size of the input.

Null texts are empty texts: no words, nothing removed, the digest of nothing. Documents are ordered by id, null ids
last, then by a hash of the text; rows equal in id and text are one document, each with its own row in the result.
Long texts are whole: their words stay in one task, their windows don't. An empty table gives an empty
result. Other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlake.llm.common import is_small, saved, table, text_of

WINDOW, SEED = 20, 10
#: Words of a run, entries of a bucket, words whose hashes a task remembers.
RUN, BUCKET, REMEMBERED = 500_000, 400_000, 150_000
#: Characters of a word with its space, and words from one anchor to the next, for the number of buckets.
LETTERS, STEP = 6, 6

_LAST = (1 << 63) - 1
_SENT = "bucket int, run long, document binary, place binary, high binary, low binary, several binary, done_document binary, done_place binary"
_MET = "run long, document binary, place binary"
_FOUND = "document long, digest long, places binary"


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()


def _mixed(a: np.ndarray, b: np.ndarray, turn: int) -> np.ndarray:
    odd = np.uint64((0x9E3779B97F4A7C15 * (2 * turn + 1)) & (2**64 - 1))
    x = (a ^ (a >> np.uint64(32))) * odd + b
    x ^= x >> np.uint64(29)
    return x * np.uint64(0xBF58476D1CE4E5B9)


def gram_hashes(words: np.ndarray, width: int, turn: int = 0) -> np.ndarray:
    """Hash of the ``width`` words from each place on, by doubling."""
    if len(words) < width:
        return np.empty(0, np.uint64)
    power, size, out, reach = words, 1, None, 0
    while True:
        if width & size:
            out = power if out is None else _mixed(out[: len(power) - reach], power[reach:], turn + 7)
            reach += size
        size *= 2
        if size > width:
            return out[: len(words) - width + 1]
        power = _mixed(power[: len(power) - size // 2], power[size // 2 :], turn + size)


def _sliding(values: np.ndarray, width: int, pick: Callable) -> np.ndarray:
    """Least or greatest of ``width`` neighbours, by doubling."""
    out, size = values, 1
    while size * 2 <= width:
        out = pick(out[:-size], out[size:])
        size *= 2
    rest = width - size
    return pick(out[:-rest], out[rest:]) if rest else out


class Run:
    """Documents of a task, as one array of word hashes."""

    def __init__(self, window: int, seed: int):
        self.window, self.seed = window, seed
        self.hashes = WordHashes()
        self.clear()

    def clear(self) -> None:
        self.size, self.rows, self.parts = 0, [], []

    def add(self, row: tuple, words: list[bytes]) -> None:
        """row: (document, digest, ...)."""
        self.rows.append(row)
        self.parts.append(np.fromiter(map(self.hashes.__getitem__, words), np.uint64, len(words)))
        self.size += len(words)

    def layout(self) -> None:
        lengths = np.array([len(p) for p in self.parts], dtype=np.int64)
        self.words = np.concatenate(self.parts)
        self.start = np.cumsum(lengths) - lengths
        self.owner = np.repeat(np.arange(len(lengths)), lengths)
        left = np.repeat(self.start + lengths, lengths) - np.arange(len(self.words))
        count = max(len(self.words) - self.window + 1, 0)
        self.inside = left[:count] >= self.window  # windows of one document
        grams = gram_hashes(self.words, self.seed)
        self.anchor = _sliding(grams, self.window - self.seed + 1, np.minimum) if count else np.empty(0, np.uint64)
        self.grams = grams

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Places in the run, and hashes, of all anchors."""
        count, span = len(self.anchor), self.window - self.seed + 1
        if not count:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        least = np.where(self.inside, self.anchor, np.uint64(0))
        edge = np.zeros(span - 1, np.uint64)
        around = _sliding(np.concatenate([edge, least, edge]), span, np.maximum)
        at = np.flatnonzero((around == self.grams) & (around > 0))
        return at, self.grams[at]


def _packed(values: np.ndarray) -> bytes:
    return zstandard.compress(values.tobytes(), 1)


def _read(cells, dtype) -> np.ndarray:
    return np.concatenate([np.empty(0, dtype), *(np.frombuffer(zstandard.decompress(c), dtype) for c in cells)])


def _sent(run: Run, at: np.ndarray, high: np.ndarray, low: np.ndarray, buckets: int, only_first: bool, number: int) -> pd.DataFrame:
    """What a run sends to each bucket, and what it has settled itself."""
    owner = run.owner[at]
    document = np.array([r[:2] for r in run.rows], dtype=np.int64).reshape(-1, 2)[owner]
    place = (at - run.start[owner]).astype(np.uint32)
    order = np.lexsort((place, document[:, 1], document[:, 0], low, high))
    document, place, high, low = document[order], place[order], high[order], low[order]
    begins = np.append(True, (high[1:] != high[:-1]) | (low[1:] != low[:-1]))[: len(high)]
    same = ~begins & np.append(False, (place[1:] == place[:-1]) & (document[1:] == document[:-1]).all(axis=1))[: len(high)]
    document, place, high, low, begins = (x[~same] for x in (document, place, high, low, begins))  # rows that repeat an id and a text
    group = np.cumsum(begins) - 1
    several = np.bincount(group, minlength=int(begins.sum())) > 1
    done = ~begins if only_first else several[group]
    at = np.flatnonzero(begins)
    bucket = ((high[at] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)  # ascends with the hash
    edges = np.searchsorted(bucket, np.arange(buckets + 1))
    rows, nothing = [], _packed(np.empty(0, np.int64))
    for b in np.flatnonzero(edges[1:] > edges[:-1]).tolist():
        part = at[edges[b] : edges[b + 1]]
        rows.append((b, number, _packed(document[part]), _packed(place[part]), _packed(high[part]), nothing if low is high else _packed(low[part]), _packed(several[edges[b] : edges[b + 1]]), nothing, nothing))
    if done.any():
        rows.append((number % buckets, number, nothing, nothing, nothing, nothing, nothing, _packed(document[done]), _packed(place[done])))
    return pd.DataFrame(rows, columns=[c.split()[0] for c in _SENT.split(", ")])


def _met(sent: DataFrame, only_first: bool) -> DataFrame:
    """run, document, place: where keys occur again (``only_first``: but for the first place), else all places of such keys."""

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        high, low = _read(group["high"], np.uint64), _read(group["low"], np.uint64)
        places = [_read([c], np.uint32) for c in group["place"]]
        document, place = _read(group["document"], np.int64).reshape(-1, 2), np.concatenate(places)
        run, several = np.repeat(group["run"].to_numpy(), [len(p) for p in places]), _read(group["several"], np.bool_)
        low = low if len(low) else high
        order = np.lexsort((place, document[:, 1], document[:, 0], low, high))
        document, place, run, several, high, low = (x[order] for x in (document, place, run, several, high, low))
        begins = np.append(True, (high[1:] != high[:-1]) | (low[1:] != low[:-1]))[: len(high)]
        number = np.cumsum(begins) - 1
        first = np.flatnonzero(begins)[number]
        hit = (place != place[first]) | (document != document[first]).any(axis=1)
        if not only_first:
            hit = (np.bincount(number, hit | several, minlength=int(begins.sum())) > 0)[number]
        document, place, run = document[hit], place[hit], run[hit]
        order = np.argsort(run, kind="stable")
        runs, starts = np.unique(run[order], return_index=True)
        rows = [(r, _packed(document[part]), _packed(place[part])) for r, part in zip(runs, np.split(order, starts[1:]))] if len(runs) else []
        rows += [(r, d, p) for r, d, p in zip(group["run"], group["done_document"], group["done_place"]) if len(_read([p], np.uint32))]
        return pd.DataFrame(rows, columns=["run", "document", "place"])

    return sent.groupBy("bucket").applyInPandas(meet, _MET)


def _by_document(met: DataFrame) -> DataFrame:
    """document, digest, places of what the buckets answer to each run."""

    def gather(group: pd.DataFrame) -> pd.DataFrame:
        document, place = _read(group["document"], np.int64).reshape(-1, 2), _read(group["place"], np.uint32)
        order = np.lexsort((place, document[:, 1], document[:, 0]))
        document, place = document[order], place[order]
        starts = np.flatnonzero(np.append(True, (document[1:] != document[:-1]).any(axis=1))[: len(document)])
        return pd.DataFrame({"document": document[starts, 0], "digest": document[starts, 1], "places": [p.tobytes() for p in np.split(place, starts[1:])]})

    # Rows equal in id and text get equal answers, whichever runs they are in.
    return saved(met.groupBy("run").applyInPandas(gather, _FOUND).groupBy("document", "digest").agg(F.min("places").alias("places")))


def _places(cell: bytes) -> np.ndarray:
    return np.frombuffer(cell, np.uint32)


def _runs(rows: DataFrame, keys: Callable[[Run], tuple], buckets: int, only_first: bool, window: int, seed: int) -> DataFrame:
    """Runs of documents, each with its keys sent to buckets; rows: document, digest, text, and places if any."""

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, number = Run(window, seed), TaskContext.get().partitionId() << 32
        for batch in batches:
            places = batch["places"] if "places" in batch else [None] * len(batch)
            for document, digest, text, some in zip(batch["document"], batch["digest"], batch["text"], places):
                run.add((document, digest, some), words_of(text))
                if run.size >= RUN:
                    run.layout()
                    yield _sent(run, *keys(run), buckets, only_first, number := number + 1)
                    run.clear()
        if run.size:
            run.layout()
            yield _sent(run, *keys(run), buckets, only_first, number + 1)

    return rows.mapInPandas(send, _SENT)


def _anchors(run: Run) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at, hashes = run.anchors()
    return at, hashes, hashes


def _extended(run: Run) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows that hold a seed, which ``places`` of a row name."""
    seeds = [at + _places(row[2]).astype(np.int64) for at, row in zip(run.start, run.rows)]
    hashes = np.unique(run.grams[np.concatenate([np.empty(0, np.int64), *seeds])])
    if not len(hashes):
        nothing = np.empty(0, np.uint64)
        return np.empty(0, np.int64), nothing, nothing
    found = np.minimum(np.searchsorted(hashes, run.anchor), len(hashes) - 1)
    at = np.flatnonzero(run.inside & (hashes[found] == run.anchor))
    return at, gram_hashes(run.words, run.window, 101)[at], gram_hashes(run.words, run.window, 202)[at]


def _identified(docs: DataFrame, key: str, text: str) -> DataFrame:
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), text_of(text).alias("text"))
    return rows.select("doc_id", F.coalesce("doc_id", F.lit(_LAST)).alias("document"), F.xxhash64("text", F.col("doc_id").isNull()).alias("digest"), "text")


def _with_places(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of documents that have places; texts of others aren't shuffled where the keys are few."""
    if is_small(found.select("document", "digest")):
        rows = rows.join(F.broadcast(found.select("document", "digest")), ["document", "digest"], "left_semi")
    return rows.join(found, ["document", "digest"])


def repeated_windows(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """document, digest, places: starts of the repeated windows, of documents that have some."""
    rows = _identified(docs, key, text).drop("doc_id")
    letters = rows.agg(F.sum(F.length("text"))).head()[0] or 0
    buckets = lambda n: int(-(-n // BUCKET) or 1)
    seeds = _by_document(_met(_runs(rows, _anchors, buckets(letters // (LETTERS * STEP)), False, window, seed), False))
    held = seeds.agg(F.sum(F.octet_length("places"))).head()[0] or 0
    return _by_document(_met(_runs(_with_places(rows, seeds), _extended, buckets(held // 4 * STEP), True, window, seed), True))


def merged(places: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Maximal [start, stop) that windows from sorted ``places`` cover; ones that touch are two."""
    if not len(places):
        return []
    breaks = np.flatnonzero(np.diff(places.astype(np.int64)) >= window) + 1
    return [(int(p[0]), int(p[-1]) + window) for p in np.split(places, breaks)]


def _on_rows(docs: DataFrame, function: Callable, schema: str, key: str, text: str, window: int, seed: int) -> DataFrame:
    """``function`` of (doc_id, words, maximal repeats) on every row, in ``mapInPandas``; it gives tuples."""
    names = [c.split()[0] for c in schema.split(", ")]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            places = batch["places"] if "places" in batch else [None] * len(batch)
            out = [row for i, t, p in zip(batch["doc_id"], batch["text"], places) for row in function(i, words_of(t), merged(_places(p), window) if p is not None else [])]
            yield pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})

    rows, found = _identified(docs, key, text), repeated_windows(docs, key, text, window, seed)
    named = found.select("document", "digest")
    if not is_small(named):
        return rows.join(found, ["document", "digest"], "left").select("doc_id", "text", "places").mapInPandas(each, schema)
    untouched = rows.join(F.broadcast(named), ["document", "digest"], "left_anti").select("doc_id", "text")
    touched = _with_places(rows, found).select("doc_id", "text", "places")
    return untouched.mapInPandas(each, schema).unionByName(touched.mapInPandas(each, schema))


def repeated_passages(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """doc_id, start, stop (in words), passage of every maximal repeat."""

    def passages(doc, words: list[bytes], repeats: list[tuple[int, int]]) -> list[tuple]:
        return [(doc, a, b, b" ".join(words[a:b]).decode("utf-8", "replace")) for a, b in repeats]

    return _on_rows(docs, passages, "doc_id long, start long, stop long, passage string", key, text, window, seed)


def kept_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_removed, kept: the text that stays, words joined by one space, as UTF-8."""

    def keep(doc, words: list[bytes], repeats: list[tuple[int, int]]) -> list[tuple]:
        left, end = [], 0
        for a, b in repeats:
            left += words[end:a]
            end = b
        left += words[end:]
        return [(doc, len(words), len(words) - len(left), b" ".join(left))]

    return _on_rows(docs, keep, "doc_id long, n_words long, n_removed long, kept binary", key, text, window, seed)


QUERY = "op13_substring_dedup"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = kept_texts(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


STATEMENT = r"""
WITH docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
tokens AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM docs),
places AS (
  SELECT doc_id, pos, count(*) OVER ahead AS n, string_agg(word, ' ') OVER ahead AS words
  FROM tokens WINDOW ahead AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
windows AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY words ORDER BY doc_id, pos) AS nth FROM places WHERE n = 20),
removed AS (
  SELECT DISTINCT doc_id, unnest(range(pos, pos + 20)) AS pos FROM windows WHERE nth > 1),
marked AS (
  SELECT w.doc_id, w.pos, w.word, r.pos IS NOT NULL AS gone
  FROM tokens w LEFT JOIN removed r USING (doc_id, pos)),
kept AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS stay FROM marked GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(stay, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)
"""
