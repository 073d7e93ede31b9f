"""Encoding and decoding with merge-type piece vocabularies, exactly as the sentencepiece library.

White space is written as a mark, a mark is put in front, and each character is a symbol. An agenda
holds the adjacent pairs that together are a piece, by score, the leftmost of equals first; the
first is joined, and pairs with its neighbours come in. Entries of symbols that have changed are
passed over. What is no piece in the end is spelled in bytes.

No pair crosses two characters that no piece has side by side, so texts are cut there, and what a part
gives is remembered, for a bounded number of parts. Each word that a worker meets for the first time
is also given to the library, a batch at a time; a difference stops the task.
"""

from __future__ import annotations

import functools
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Words and parts that a worker remembers before it starts anew; longer ones than LONG aren't remembered.
WORDS, LONG = 1_000_000, 64
#: Ids that are handed on at a time.
SLICE = 1 << 18


class Codec:
    """The vocabulary of a model file. It must be of merge type, without normalization, unused pieces or symbols of the user's own, with bytes to fall back on."""

    def __init__(self, model_path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        every = range(sp.get_piece_size())
        if any(map(sp.is_unused, every)) or sum(map(sp.is_byte, every)) != 256:
            raise ValueError("the vocabulary has unused pieces, or no bytes")
        own = [i for i in every if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        self.ids = {sp.id_to_piece(i): i for i in own}
        self.scores = {sp.id_to_piece(i): -sp.get_score(i) for i in own}
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.inside = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.local = not any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids)
        self.words: dict[str, tuple[int, ...]] = {}
        self.parts: dict[str, tuple[int, ...]] = {}
        self.new: dict[str, tuple[int, ...]] = {}

    def merged(self, part: str) -> list[str]:
        """The symbols that the agenda leaves."""
        symbols, scores = list(part), self.scores
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = []
        for i in range(n - 1):
            both = part[i : i + 2]
            if both in scores:
                agenda.append((scores[both], i, i + 1, both))
        heapq.heapify(agenda)
        while agenda:
            _, i, j, both = heapq.heappop(agenda)
            if not symbols[i] or not symbols[j] or len(symbols[i]) + len(symbols[j]) != len(both):
                continue
            symbols[i], symbols[j] = both, ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                more = both + symbols[k]
                if more in scores:
                    heapq.heappush(agenda, (scores[more], i, k, more))
            h = before[i]
            if h >= 0:
                more = symbols[h] + both
                if more in scores:
                    heapq.heappush(agenda, (scores[more], h, i, more))
        return [s for s in symbols if s]

    def part(self, part: str) -> tuple[int, ...]:
        got = self.parts.get(part)
        if got is None:
            out: list[int] = []
            for s in (part,) if part in self.ids and len(part) == 1 else self.merged(part):
                i = self.ids.get(s)
                out += [i] if i is not None else [self.bytes[b] for b in s.encode()]
            got = tuple(out)
            if len(part) <= LONG:
                self.parts[part] = got
        return got

    def word(self, word: str) -> tuple[int, ...]:
        """Cut where two characters meet that no piece has side by side."""
        at, out, inside = 0, [], self.inside
        for i in range(1, len(word) + 1):
            if i == len(word) or word[i - 1 : i + 1] not in inside:
                out += self.part(word[at:i])
                at = i
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        marked = MARK + text.replace(" ", MARK)
        if not self.local:
            words = [marked]
        elif "  " in text or text[0] == " " or text[-1] == " " or MARK in text:
            words = re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", marked)
        else:
            words = [MARK + w for w in text.split(" ")]
        out: list[int] = []
        for w in words:
            got = self.words.get(w)
            if got is None:
                got = self.word(w)
                self.new[w] = got
                if len(w) <= LONG:
                    self.words[w] = got
            out += got
        return out

    def checked(self) -> None:
        """Compares what is new with the library; a lone mark is what it adds itself, so that isn't asked for."""
        self.new.pop(MARK, None)
        asked = [w[1:].replace(MARK, " ") for w in self.new]
        for w, own, its in zip(asked, self.new.values(), self.library.encode(asked, num_threads=1)):
            if list(own) != its:
                raise RuntimeError(f"the library encodes {w[:80]!r} as {its[:20]}, not {list(own)[:20]}")
        self.new = {}
        if len(self.words) + len(self.parts) > WORDS:
            self.words, self.parts = {}, {}


@functools.lru_cache(maxsize=1)
def _codec(model_path: str) -> Codec:
    """One for all tasks of a Python worker, which goes on with what it remembers."""
    return Codec(model_path)


def encoded(df: DataFrame, id_col: str, text_col: str, model_path: str, decode: bool = False) -> DataFrame:
    """One row per input row: id, ids (array of int, without those of begin and end), and with ``decode`` what the library makes of them, decoded.

    A null text is an empty one: no ids, decoded ''. Texts are encoded whole, however long; a word of a megabyte is one agenda. Repeated rows
    are encoded one by one. Only id and text are read, so other columns can't clash; no rows give none. ``model_path`` must be there on each executor.
    """
    ids = df.schema[id_col].dataType.simpleString()
    names = ["id", "ids", "decoded"][: 2 + decode]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model_path)

        def told(column: pa.Array, lists: list[list[int]]) -> pa.RecordBatch:
            codec.checked()
            offsets = np.cumsum([0, *map(len, lists)], dtype=np.int32)
            flat = np.fromiter((i for x in lists for i in x), np.int32, int(offsets[-1]))
            columns = [column, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))]
            if decode:
                columns.append(pa.array(codec.library.decode(lists, num_threads=1) if lists else [], pa.string()))
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            lists, many, start = [], 0, 0
            for i, text in enumerate(batch.column(1)):
                lists.append(codec.encode(text.as_py() or ""))
                many += len(lists[-1])
                if many >= SLICE:
                    yield told(batch.column(0).slice(start, len(lists)), lists)
                    lists, many, start = [], 0, i + 1
            yield told(batch.column(0).slice(start), lists)

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {ids}, ids array<int>" + ", decoded string" * decode)
