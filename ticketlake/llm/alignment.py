"""Alignment of two tokenizers' tokens, and corpus-wide counts of linked pairs by external spill counting.

Both sides cut the same bytes. A group ends where a token of either side ends; tokens of the sides whose
bytes overlap are linked. A pair of ids counts the documents that hold it linked.

1. Runs. A task aligns documents until they hold ``RUN`` bytes. The run's pair-document records are sorted
   side-major: by the radix of the A id, then A id, B id and document. What is counted, (pair, documents of the run),
   goes out as one zstd run for each radix; the records themselves stay behind as one row of the run.
2. Counting. Runs of a radix meet ``FAN`` at a time and are merged by a k-way heap, which adds up the counts
   of equal pairs, and in further levels until one is left. Runs are decompressed as the heap reads on. As a
   pair is one entry of a run whatever its documents, a pair that all documents hold is no larger than others. In
   side-major order an A id's pairs follow each other, so the last merge also yields the highest count of each A id.
3. Contributions. Counts stream back: each run's pairs look up their counts in that order, and the run's records
   turn them into sums for its documents.

Nothing grows with the corpus but the number of runs; a radix of the last merge holds distinct pairs, which the
vocabularies bound. Null texts, empty texts and texts that either side doesn't spell byte by byte have no tokens: zeros
and an empty string. Rows count one by one, so repeated rows are documents of their own, and null ids stay. Ties for the
highest count are all best. Long texts are whole, in a run of their own. An empty table gives an empty result. Other
columns play no part.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import io
from collections.abc import Callable, Iterator
from itertools import chain, groupby
from operator import itemgetter

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlake.llm.common import lean, saved, table, text_of

#: Bytes of text of a run, of a slice of it that is aligned at once, radixes, runs that a merge takes, entries that a reader holds.
RUN, SLICE, RADIX, FAN, HELD = 6_000_000, 750_000, 64, 64, 4096

_RUNS = "run long, radix int, pairs binary, ids binary, known binary, figures binary, digests binary, records binary"
_OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class Side:
    """A tokenizer: ids of texts, with a space before each, and the bytes of each id."""

    def __init__(self, path: str, pattern: str | None = None):
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)  # adds the space itself
            self.ids: Callable[[list[str]], list[list[int]]] = lambda texts: model.encode(texts, num_threads=1)
            size = range(model.get_piece_size())
            self.bytes_of = [bytes([int(model.id_to_piece(i)[3:-1], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode() for i in size]
        else:
            import tiktoken

            with open(path, "rb") as lines:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            encode = tiktoken.Encoding("side", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            self.ids = lambda texts: [encode(" " + text) for text in texts]
            self.bytes_of = [b""] * (max(ranks.values()) + 1)
            for token, rank in ranks.items():
                self.bytes_of[rank] = token
        self.lengths = np.array([len(b) for b in self.bytes_of], dtype=np.int64)
        self.names = np.array([str(i) for i in range(len(self.bytes_of))], dtype=object)

    def spells(self, ids: list[int], whole: bytes) -> bool:
        return b"".join(map(self.bytes_of.__getitem__, ids)) == whole


class Aligner:
    def __init__(self, a: Side, b: Side):
        self.a, self.b = a, b
        # Ids with the sign that follows them: A ids end in , or | and B ids in , or ;
        self.signed = np.concatenate([a.names + ",", a.names + "|", b.names + ",", b.names + ";"])

    def align(self, texts: list[str]) -> dict:
        """Of each document its figures and groups, and of the run the links: A id, B id, document."""
        a, b, at, wanted = self.a, self.b, [], []
        for n, (text, ids_a, ids_b) in enumerate(zip(texts, a.ids(texts), b.ids(texts))):
            whole = (" " + text).encode("utf-8", "surrogatepass")
            if text and a.spells(ids_a, whole) and b.spells(ids_b, whole):
                at.append(n)
                wanted.append((ids_a, ids_b, len(whole)))
        flat = lambda k: np.fromiter(chain.from_iterable(w[k] for w in wanted), np.int64)
        ids_a, ids_b = flat(0), flat(1)
        ends_a, ends_b = np.cumsum(a.lengths[ids_a]), np.cumsum(b.lengths[ids_b])
        stops = np.cumsum([w[2] for w in wanted], dtype=np.int64)
        both = np.intersect1d(ends_a, ends_b, assume_unique=True)
        ends = np.union1d(ends_a, ends_b)  # between two neighbours lies one token of either side: a link
        document = lambda places: np.searchsorted(stops, places)
        figures = np.zeros((4, len(texts)), dtype=np.int64)
        for row, places in zip(figures, (ends_a, ends_b, both, ends)):
            row[at] = np.bincount(document(places), minlength=len(at))
        links = ids_a[np.searchsorted(ends_a, ends)], ids_b[np.searchsorted(ends_b, ends)], np.array(at, dtype=np.int64)[document(ends)]
        return {"figures": figures, "links": links, "groups": self._groups(ids_a, ids_b, ends_a, ends_b, both, len(texts), at, figures)}

    def align_run(self, texts: list[str]) -> dict:
        """As ``align``, a slice at a time and with digests in place of groups: only figures and links are held for all texts."""
        figures, links, digests, first = [], [], [], 0
        while first < len(texts):
            last, size = first, 0
            while last < len(texts) and size < SLICE:
                size, last = size + len(texts[last]) + 100, last + 1
            done = self.align(texts[first:last])
            id_a, id_b, document = done["links"]
            links.append((id_a, id_b, document + first))
            figures.append(done["figures"])
            digests += [hashlib.sha256(g.encode()).digest() if g else bytes(32) for g in done["groups"]]
            first = last
        return {"figures": np.concatenate(figures, axis=1), "links": tuple(map(np.concatenate, zip(*links))), "digests": b"".join(digests)}

    def _groups(self, ids_a, ids_b, ends_a, ends_b, both, count: int, at: list[int], figures) -> list[str]:
        last_a, last_b = np.isin(ends_a, both, assume_unique=True), np.isin(ends_b, both, assume_unique=True)
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        size_a, size_b = np.bincount(group_a, minlength=len(both)), np.bincount(group_b, minlength=len(both))
        signed = np.empty(len(ids_a) + len(ids_b), dtype=object)
        signed[np.arange(len(ids_a)) + (np.cumsum(size_b) - size_b)[group_a]] = self.signed[ids_a + last_a * len(self.a.names)]
        signed[np.arange(len(ids_b)) + np.cumsum(size_a)[group_b]] = self.signed[2 * len(self.a.names) + ids_b + last_b * len(self.b.names)]
        groups, start = [""] * count, 0
        for n in at:
            stop = start + int(figures[0, n] + figures[1, n])
            groups[n] = "".join(signed[start:stop].tolist())[:-1]
            start = stop
        return groups


def _packed(values: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(values).tobytes(), 3)


def _unpacked(cell: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(cell), dtype)


def radix_of(a: np.ndarray) -> np.ndarray:
    return ((a * 2_654_435_761) >> 16) % RADIX


def _entries(cell: bytes) -> Iterator[tuple[int, int]]:
    """(pair, count) of a run in its order, decompressed piece by piece."""
    with zstandard.ZstdDecompressor().stream_reader(io.BytesIO(cell)) as reader:
        while piece := reader.read(16 * HELD):
            while len(piece) % 16:
                piece += reader.read(16 - len(piece) % 16)
            yield from map(tuple, np.frombuffer(piece, np.int64).reshape(-1, 2).tolist())


def merge_runs(cells: list[bytes]) -> np.ndarray:
    """K-way heap merge: rows of (pair, count), counts of equal pairs added up."""
    out = np.fromiter(
        chain.from_iterable((pair, sum(count for _, count in same)) for pair, same in groupby(heapq.merge(*map(_entries, cells)), key=itemgetter(0))),
        np.int64,
    )
    return out.reshape(-1, 2)


def alignment_runs(docs: DataFrame, a: tuple, b: tuple, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of runs; a and b are the arguments of the sides. Radix -1 is the run's row of documents."""

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        aligner = Aligner(Side(*a), Side(*b))
        size_b, number = len(aligner.b.names), TaskContext.get().partitionId() << 32

        def finished() -> pd.DataFrame:
            done = aligner.align_run(texts)
            id_a, id_b, document = done.pop("links")
            count = max(len(texts), 1)
            order = ((radix_of(id_a) * len(aligner.a.names) + id_a) * size_b + id_b) * count + document
            order, times = np.unique(order, return_counts=True)
            document, pair = order % count, order // count
            first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])[: len(pair)])
            held, pair = np.diff(np.append(first, len(pair))), pair[first] % (len(aligner.a.names) * size_b)
            entries, radix = np.stack([pair, held], axis=1), radix_of(pair // size_b)
            edges = np.searchsorted(radix, np.arange(RADIX + 1))
            known = np.array([i is not None for i in ids])
            rows = [(number, -1, b"", _packed(np.array([i or 0 for i in ids], dtype=np.int64)), _packed(known), _packed(done["figures"]), done["digests"], b"".join(p.to_bytes(8, "little") + x for x in (_packed(held.astype(np.uint32)), _packed(document.astype(np.uint32)), _packed(times.astype(np.uint32))) for p in [len(x)]))]
            rows += [(number, r, _packed(entries[edges[r] : edges[r + 1]]), b"", b"", b"", b"", b"") for r in np.flatnonzero(edges[1:] > edges[:-1]).tolist()]
            return pd.DataFrame(rows, columns=[c.split()[0] for c in _RUNS.split(", ")])

        ids, texts, size = [], [], 0
        for batch in batches:
            for i, text in zip(batch["doc_id"].astype("Int64"), batch["text"]):
                ids.append(None if i is pd.NA else int(i))
                texts.append(text)
                size += len(text) + 100
                if size >= RUN:
                    yield finished()
                    ids, texts, size, number = [], [], 0, number + 1
        if ids:
            yield finished()

    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), text_of(text).alias("text"))
    return saved(rows.mapInPandas(lean(runs), _RUNS))


def _counted(runs: DataFrame, size_b: int) -> DataFrame:
    """radix, counted: rows of (pair, documents, whether highest of the A id), in order of the pairs."""

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"radix": group["radix"].iloc[:1], "run": group["group"].iloc[:1], "pairs": [_packed(merge_runs(group["pairs"].tolist()))]})

    def last(group: pd.DataFrame) -> pd.DataFrame:
        merged = merge_runs(group["pairs"].tolist())
        first = np.flatnonzero(np.append(True, np.diff(merged[:, 0] // size_b) != 0)[: len(merged)])
        highest = np.repeat(np.maximum.reduceat(merged[:, 1], first), np.diff(np.append(first, len(merged))))
        return pd.DataFrame({"radix": group["radix"].iloc[:1], "counted": [_packed(np.column_stack([merged, merged[:, 1] == highest]))]})

    level = runs.select("radix", "run", "pairs")
    while (groups := -(-level.select("run").distinct().count() // FAN)) > 1:
        level = level.withColumn("group", F.pmod(F.xxhash64("run"), F.lit(groups)))
        level = saved(level.groupBy("radix", "group").applyInPandas(merge, "radix int, run long, pairs binary"))
    return saved(level.groupBy("radix").applyInPandas(last, "radix int, counted binary"))


def _parts(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    return runs.where("radix >= 0"), runs.where("radix < 0").drop("pairs")


def pair_counts(runs: DataFrame, size_b: int) -> DataFrame:
    """a, b, documents, best of every linked pair."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for cell in batch["counted"]:
                counted = _unpacked(cell, np.int64).reshape(-1, 3)
                yield pd.DataFrame({"a": counted[:, 0] // size_b, "b": counted[:, 0] % size_b, "documents": counted[:, 1], "best": counted[:, 2] > 0})

    return _counted(_parts(runs)[0], size_b).select("counted").mapInPandas(rows, "a long, b long, documents long, best boolean")


def aligned(runs: DataFrame, size_b: int) -> DataFrame:
    """One row per document: its figures, the sums over its links, the digest of its groups."""
    pairs, documents = _parts(runs)
    counted = _counted(pairs, size_b)
    groups = -(-documents.count() // FAN) or 1

    def contribute(mine: pd.DataFrame, all_: pd.DataFrame) -> pd.DataFrame:
        known = _unpacked(all_["counted"].iloc[0], np.int64).reshape(-1, 3)
        cells = [_packed(known[np.searchsorted(known[:, 0], _unpacked(c, np.int64)[::2]), 1:]) for c in mine["pairs"]] if len(mine) else []
        return pd.DataFrame({"run": mine["run"], "radix": mine["radix"], "counts": cells})

    group = F.pmod(F.xxhash64("run"), F.lit(groups))
    asked = pairs.select("run", "radix", "pairs", group.alias("group")).groupBy("radix", "group")
    offered = counted.withColumn("group", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(groups - 1).cast("bigint")))).groupBy("radix", "group")
    back = asked.cogroup(offered).applyInPandas(contribute, "run long, radix int, counts binary")

    def add_up(mine: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        row = mine.iloc[0]
        cells = counts.sort_values("radix")["counts"]
        found = np.concatenate([np.empty((0, 2), np.int64), *(_unpacked(c, np.int64).reshape(-1, 2) for c in cells)])
        parts, at, blob = [], 0, row["records"]
        for _ in range(3):
            size = int.from_bytes(blob[at : at + 8], "little")
            parts.append(_unpacked(blob[at + 8 : at + 8 + size], np.uint32).astype(np.int64))
            at += 8 + size
        held, document, times = parts
        found = np.repeat(found, held, axis=0) * times[:, None]
        figures, ids = _unpacked(row["figures"], np.int64).reshape(4, -1), _unpacked(row["ids"], np.int64)
        sums = np.zeros((len(ids), 2), dtype=np.int64)
        np.add.at(sums, document, found)
        digests = [row["digests"][32 * n : 32 * n + 32].hex() if figures[0, n] else "" for n in range(len(ids))]
        doc_id = pd.array(ids, dtype="Int64")
        doc_id[~_unpacked(row["known"], np.bool_)] = pd.NA
        return pd.DataFrame({"doc_id": doc_id, "n_a": figures[0], "n_b": figures[1], "n_groups": figures[2], "n_links": figures[3], "n_best": sums[:, 1], "count_sum": sums[:, 0], "groups_sha256": digests})

    return documents.drop("radix").groupBy("run").cogroup(back.groupBy("run")).applyInPandas(add_up, _OUT)


def aligned_groups(docs: DataFrame, a: tuple, b: tuple, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, groups: ``a1,a2|b1;a3|b2,b3`` of every document."""

    def groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        aligner = Aligner(Side(*a), Side(*b))
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "groups": aligner.align(batch["text"].tolist())["groups"]})

    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), text_of(text).alias("text"))
    return rows.mapInPandas(groups, "doc_id long, groups string")


def sides() -> tuple[tuple, tuple, int]:
    """Byte-level vocabulary, piece vocabulary, and the size of the second."""
    import public_tokenizers
    import sentencepiece

    pieces = public_tokenizers.path("piece_bpe_32k.model")
    # The rank file holds the vocabulary of byte_bpe_50k.json (a test compares their ids), and encodes faster.
    return (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN), (pieces,), sentencepiece.SentencePieceProcessor(model_file=pieces).get_piece_size()


QUERY = "op12_tokenizer_alignment"
STATEMENT = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, size_b = sides()
    return aligned(alignment_runs(table(spark, sf_dir, "documents"), a, b), size_b)
