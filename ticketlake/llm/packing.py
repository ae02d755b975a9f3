"""Packing documents into sequences of at most ``CAPACITY`` tokens by the sum-of-squares rule.

A document is its token ids and then id 0. Documents longer than a sequence are cut into full pieces; the
last piece may be shorter. Full pieces are sequences of their own. Every other piece goes where the sum
of squares of N(g) grows least, N(g) being the number of open sequences with g tokens left (a new
sequence is one of the choices; of equal choices the tightest gap). Pieces are dealt by hash into leaves
of about ``LEAF`` pieces, packed side by side, long pieces first. Sequences that a leaf leaves open, and
that the smallest open one would fit into, are then pieces themselves, dealt anew and packed in the same way, until one leaf
holds them all or a level joins nothing. A sequence is named after one of its pieces.

Null texts are empty texts, which are the one id 0. Repeated rows are pieces of their own; rows may repeat an
id. An empty table gives an empty result. Other columns play no part. Results of a rerun are equal, as leaves
sort their pieces; only rows that repeat an id and a text may change places.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlake.llm.common import lean, saved, table, text_of

CAPACITY = 2048
LEAF = 20_000
#: Different words whose ids a task remembers, and the most characters of one.
REMEMBERED, REMEMBERED_LENGTH = 150_000, 64

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def byte_characters() -> dict[str, int]:
    """Byte of each character that byte-level vocabularies use: printable ones stand for themselves."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(others)}


class WordIds(dict):
    """Little-endian ids of each word seen, as the tokenizer file gives them.

    The tokenizer drops white space and lets no token cross it, so words are encoded one by one, each
    different one once. Words of plain Latin letters take a short way: their parts are looked up as byte
    ranks, where the end of a word is byte 255, which UTF-8 lacks. All other words go through
    the tokenizer itself.
    """

    def __init__(self, path: str):
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        byte_of, ranks = byte_characters(), {}
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        for token, rank in self.tokenizer.get_vocab().items():
            if token not in special:
                ended = token.endswith("</w>") and len(token) > 4
                ranks[bytes(byte_of[c] for c in (token[:-4] if ended else token)) + b"\xff" * ended] = rank
        self.piece = tiktoken.Encoding("words", pat_str=".+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.parts = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall
        self.plain = re.compile(r"[!-;=-~\xa1-\u0129\u0139-\u0148\u014a-\u017e]+").fullmatch
        self.odd = re.compile("[\x1c-\x1f]").search

    def __missing__(self, word: str) -> bytes:
        if not self.plain(word):
            found = array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        elif (low := word.lower()) != word:
            found = self[low]
        elif word.isalpha():
            found = array("I", self.piece(word.encode() + b"\xff")).tobytes()
        elif word[:-1].isalpha():  # a letter run and one sign or digit
            found = self[word[:-1]] + self[word[-1]]
        else:
            ids = [i for part in self.parts(word) for i in self.piece(part.encode() + b"\xff")]
            found = array("I", ids).tobytes()
        if len(word) <= REMEMBERED_LENGTH:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = found
        return found

    def of(self, text: str) -> bytes:
        """Ids of the text, then id 0."""
        if self.odd(text):  # what Python splits at and the tokenizer doesn't
            return array("I", [*self.tokenizer.encode(text, add_special_tokens=False).ids, 0]).tobytes()
        return b"".join(map(self.__getitem__, text.split())) + b"\0\0\0\0"


def cut_into_pieces(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece."""

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = WordIds(path)
        for batch in batches:
            out = []
            for doc, text in zip(batch["doc_id"], batch["text"]):
                ids = words.of(text)
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    out.append((doc, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            frame = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield frame.astype({"doc_id": "Int64"})

    return docs.select(F.col(key).alias("doc_id"), text_of(text).alias("text")).mapInPandas(lean(pieces), _PIECES)


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item (1 to ``capacity`` - 1), items taken in the given order."""
    count = np.zeros(capacity + 1, dtype=np.int64)  # open bins by gap; neither closed nor new bins count
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, made = np.empty(len(sizes), dtype=np.int64), np.empty(len(sizes), dtype=np.int64), 0
    for at, size in enumerate(sizes.tolist()):
        before, after = count[size:], count[: capacity + 1 - size]
        # One bin fewer with the gap, one more with the smaller gap; growth of the two squares.
        growth = 2 * (after - before) + 2
        growth[0] -= 1  # a full bin adds no square
        growth[-1] -= 1  # a new bin takes none away
        growth[:-1][before[:-1] == 0] = np.iinfo(np.int64).max
        gap = int(growth.argmin()) + size
        if gap == capacity:
            chosen, made = made, made + 1
        else:
            chosen = stacks[gap].pop()
            count[gap] -= 1
        bins[at], offsets[at] = chosen, capacity - gap
        if gap > size:
            stacks[gap - size].append(chosen)
            count[gap - size] += 1
    return bins, offsets


def _packed(items: DataFrame, capacity: int) -> DataFrame:
    """items: item (unique long), length, leaf. Adds bin, which is the first item in it, and offset."""

    def leaf(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "item"], ascending=[False, True], kind="stable")
        bins, offsets = sum_of_squares(frame["length"].to_numpy(), capacity)
        items = frame["item"].to_numpy()
        return pd.DataFrame({"item": items, "length": frame["length"].to_numpy(), "bin": items[np.unique(bins, return_index=True)[1]][bins], "offset": offsets})

    return items.groupBy("leaf").applyInPandas(leaf, "item long, length long, bin long, offset long")


def pack(pieces: DataFrame, capacity: int = CAPACITY, leaf_size: int = LEAF) -> DataFrame:
    """Adds sequence_id and offset to rows with a ``length`` of 1 to ``capacity``."""
    pieces = saved(pieces.withColumn("item", F.monotonically_increasing_id()))
    short = pieces.where(F.col("length") < capacity).select("item", "length")
    placed = short.select("item", "length", F.col("item").alias("bin"), F.lit(0).cast("bigint").alias("offset"))
    open_bins, level = short, 0
    while count := open_bins.count():
        leaves = -(-count // leaf_size)
        leaf = F.pmod(F.xxhash64("item", F.lit(level)), F.lit(leaves))
        moves = saved(_packed(open_bins.withColumn("leaf", leaf), capacity))
        moves = moves.where("item <> bin").select(F.col("item").alias("bin"), F.col("bin").alias("_into"), F.col("offset").alias("_shift"))
        placed = saved(
            placed.join(moves, "bin", "left").select(
                "item",
                "length",
                F.coalesce("_into", "bin").alias("bin"),
                (F.col("offset") + F.coalesce("_shift", F.lit(0))).alias("offset"),
            )
        )
        if leaves == 1 or moves.isEmpty():
            break
        filled = placed.groupBy(F.col("bin").alias("item")).agg(F.sum("length").alias("length"))
        filled = saved(filled.where(F.col("length") < capacity))
        smallest = filled.agg(F.min("length")).head()[0] or capacity
        open_bins, level = filled.where(F.col("length") <= capacity - smallest), level + 1
    out = pieces.join(placed.drop("length"), "item", "left")
    alone = -1 - F.col("item")
    return out.select(*pieces.drop("item").columns, F.coalesce("bin", alone).alias("sequence_id"), F.coalesce("offset", F.lit(0)).cast("bigint").alias("offset"))


def packed_documents(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    return pack(cut_into_pieces(docs, path, capacity=capacity), capacity)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


QUERY = "op9_best_fit_packing"
STATEMENT = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"), tokenizer_path())
