"""Token counts by a tokenizer compiled into a deterministic finite-state transducer.

A list of tokens is what byte-pair merging makes of its text just when merging leaves every two neighbours
as they are. So the last token of a prefix is the one vocabulary piece that ends there and agrees with
the last token before it. A state of the transducer holds what the next characters need: the longest
ending that begins a piece, and for each position inside it the last token and the count there. States
and transitions are made when first met and kept; a transition is annotated with the change of the
count. No piece crosses a white space mark after another sign, nor a sign outside the vocabulary, which
gives one token per byte: there the start state comes back.

Texts longer than ``CHUNK`` characters are cut into chunks. Each chunk becomes a map from entry states to exit
states: its head, which depends on the entry, up to its first return to the start state, and the count and
state after. Maps compose associatively, so they are combined pairwise in a tree (prefix scan).

Null texts are empty texts, which have no token. Rows are counted one by one, so repeated rows and null ids
stay. An empty table gives an empty result. Other columns play no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlake.llm.common import table, text_of

LIMIT = 4096
CHUNK = 1 << 16
#: Words and states that a task remembers.
REMEMBERED = 500_000
STATES = 300_000
PAIRS = 1_000_000

MARK = "▁"  # stands for a space
_CHUNKS = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")
#: A return to the start state: a mark after another sign, or a line end.
_RETURN = re.compile(f"(?<=[^{MARK}]){MARK}|\n")


#: Head, tokens after it, exit state; without a return the head is all, and the count None.
StateMap = tuple[str, int | None, int]


class Transducer:
    def __init__(self, scores: dict[str, float]):
        """scores: of all pieces with text; larger ones merge first."""
        self.scores = scores
        self.begins = {piece[:n] for piece in scores for n in range(1, len(piece))}
        self.seen: dict[str, tuple] = {}
        self.agreed: dict[tuple[str, str], bool] = {}
        self.reset()

    @classmethod
    def of_model(cls, path: str) -> Transducer:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = (i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)))
        return cls({model.id_to_piece(i): model.get_score(i) for i in plain})

    def reset(self) -> None:
        start = ("", ((None, 0),))
        self.numbers, self.states, self.moves = {start: 0}, [start], [{}]

    def ends(self, text: str) -> tuple[list[tuple[int, str]], str, tuple[bool, ...], bool]:
        """Of an ending and a sign: pieces that end there, the ending that is left, use of its positions, a return.

        The past is of use only where an unfinished piece may have begun; the rest would tell equal states apart.
        """
        if text not in self.seen:
            size = next((n for n in range(len(text), 0, -1) if text[-n:] in self.begins), 0)
            left = text[len(text) - size :]
            useful = (*(left[n:] in self.begins for n in range(size)), True)
            back = size > 0 and left[0] == MARK and text[-size - 1 : -size] != MARK  # nothing merges across such a mark
            self.seen[text] = ([(-n, text[-n:]) for n in range(len(text), 0, -1) if text[-n:] in self.scores], left, useful, back)
        return self.seen[text]

    def merged(self, text: str) -> list[str]:
        """Byte-pair merging by definition, for the short texts of two pieces: best score first, then leftmost."""
        scores, parts = self.scores, list(text)
        found = [scores.get(a + b) for a, b in zip(parts, parts[1:])]
        while True:
            best = max((x for x in found if x is not None), default=None)
            if best is None:
                return parts
            n = found.index(best)
            parts[n : n + 2] = [parts[n] + parts[n + 1]]
            del found[n]
            if n < len(found):
                found[n] = scores.get(parts[n] + parts[n + 1])
            if n:
                found[n - 1] = scores.get(parts[n - 1] + parts[n])

    def agree(self, left: str, right: str) -> bool:
        known = self.agreed.get((left, right))
        if known is None:
            if len(self.agreed) > PAIRS:
                self.agreed.clear()
            self.agreed[left, right] = known = self.merged(left + right) == [left, right]
        return known

    def move(self, state: int, sign: str) -> tuple[int, int]:
        """Next state and change of the count."""
        if sign not in self.scores:
            made = (0, len(sign.encode("utf-8", "surrogatepass")))
        else:
            ending, known = self.states[state]
            pieces, left, useful, back = self.ends(ending + sign)
            for place, last in pieces:  # known[-1] is the position before this sign
                before, count = known[place] or (None, 0)
                if before is None or self.agree(before, last):
                    break
            count += 1
            window = [None if not use or w is None else (w[0], w[1] - count) for use, w in zip(useful, known[len(known) - len(left) :])]
            if back:
                window[0] = (None, window[0][1])
            after = (left, (*window, (last, 0)))
            number = self.numbers.setdefault(after, len(self.states))
            if number == len(self.states):
                self.states.append(after)
                self.moves.append({})
            made = (number, count)
        self.moves[state][sign] = made
        return made

    def run(self, state: int, text: str) -> tuple[int, int]:
        """Exit state and tokens emitted."""
        moves, total = self.moves, 0
        for sign in text:
            state, change = moves[state].get(sign) or self.move(state, sign)
            total += change
        return state, total


class WordCounts(dict):
    """Tokens of each word seen that starts in the start state."""

    def __init__(self, transducer: Transducer):
        self.transducer = transducer

    def __missing__(self, word: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        self[word] = found = self.transducer.run(0, word)[1]
        return found

    def chunk_map(self, chunk: str) -> StateMap:
        back = _RETURN.search(chunk)
        if back is None:
            return chunk, None, 0
        *words, last = _CHUNKS.findall(chunk, back.start())
        leave, count = self.transducer.run(0, last)
        return chunk[: back.start()], sum(map(self.__getitem__, words)) + count, leave

    def compose(self, a: StateMap, b: StateMap) -> StateMap:
        """First a, then b."""
        if a[1] is None:
            return a[0] + b[0], b[1], b[2]
        leave, count = self.transducer.run(a[2], b[0])
        return (a[0], a[1] + count, leave) if b[1] is None else (a[0], a[1] + count + b[1], b[2])

    def of(self, text: str) -> int:
        if len(self.transducer.states) > STATES:
            self.transducer.reset()
        if not text:
            return 0
        text = MARK + text.replace(" ", MARK)
        if len(text) <= CHUNK:
            return sum(map(self.__getitem__, _CHUNKS.findall(text)))
        maps = [self.chunk_map(text[at : at + CHUNK]) for at in range(0, len(text), CHUNK)]
        while len(maps) > 1:
            maps = [self.compose(*maps[n : n + 2]) if n + 1 < len(maps) else maps[n] for n in range(0, len(maps), 2)]
        head, count, _ = maps[0]
        return self.transducer.run(0, head)[1] + (count or 0)


def token_counts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document."""

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = WordCounts(Transducer.of_model(path))
        for batch in batches:
            tokens = np.fromiter(map(words.of, batch["text"]), dtype=np.int64, count=len(batch))
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "n_bytes": batch["n_bytes"], "n_tokens": tokens, "over_limit": tokens > limit})

    rows = docs.select(F.col(key).alias("doc_id"), F.octet_length(text_of(text)).cast("bigint").alias("n_bytes"), text_of(text).alias("text"))
    return rows.mapInPandas(counts, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


QUERY = "op3_token_counts"
STATEMENT = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
