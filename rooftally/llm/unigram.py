"""Token counts of a unigram vocabulary, without the tokens: best score and number of pieces.

An Aho-Corasick automaton lists all vocabulary pieces that end at each character; dynamic
programming keeps, for each end, the best score and the count of pieces on its path. Ties go
to the path found first, walking starts from left to right: the one whose last piece
starts earliest. A character that is no piece of its own may be unknown, at the lowest
score minus 10; unknown characters are spelled as their UTF-8 bytes, one piece each.

If no piece has the word mark after another character, no piece crosses the start of a
word, so the best path of a text is those of its words in a row, and a word's score and
count are remembered, for a bounded number of words. Otherwise texts are walked whole.
Scores of the vocabulary file are used as they are, in double precision.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Words that a worker remembers before it starts anew.
WORDS = 400_000


def vocabulary(model_path: str) -> tuple[list[tuple[str, float]], int]:
    """(piece, score) by id, and the id of the unknown piece, of a sentencepiece file."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    return [(sp.id_to_piece(i), float(sp.get_score(i))) for i in range(sp.get_piece_size())], sp.unk_id()


class Counter:
    def __init__(self, pieces: list[tuple[str, float]], words: int = WORDS):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY
        self.inside = {piece[i : i + 2] for piece, _ in pieces for i in range(len(piece) - 1)}
        self.local = not any(re.search(f"[^{MARK}]{MARK}", piece) for piece, _ in pieces)
        self.memo: dict[str, tuple[float, int]] = {}
        self.words = words

    def best(self, text: str) -> tuple[float, int]:
        """Of marked text: the score and the pieces of the best path."""
        n = len(text)
        scores: list[float | None] = [0.0] + [None] * n
        counts = [0] * (n + 1)
        done, single = 0, -1  # ends up to here are final; the last character that is a piece

        def unknown(end: int) -> None:
            now = scores[end - 1] + self.unknown
            if scores[end] is None or now > scores[end]:  # starts last, so a tie is lost
                scores[end], counts[end] = now, counts[end - 1] + len(text[end - 1].encode("utf-8", "surrogatepass"))

        for last, (length, score) in self.automaton.iter(text):  # by end, the longest first
            end, start = last + 1, last + 1 - length
            while done < last:
                done += 1
                if single != done - 1:
                    unknown(done)
            now = scores[start] + score
            if scores[end] is None or now > scores[end]:
                scores[end], counts[end] = now, counts[start] + 1
            if length == 1:
                single = last
        while done < n:
            done += 1
            if single != done - 1:
                unknown(done)
        return scores[n], counts[n]

    def word(self, word: str) -> tuple[float, int]:
        """Cut where two characters meet that no piece has side by side; no path crosses there."""
        at, score, n, inside = 0, 0.0, 0, self.inside
        for i in range(1, len(word) + 1):
            if i == len(word) or word[i - 1 : i + 1] not in inside:
                part = word[at:i]
                got = self.memo.get(part)
                if got is None:
                    got = self.best(part)
                    if len(part) < 64:
                        self.memo[part] = got
                score, n, at = score + got[0], n + got[1], i
        return score, n

    def count(self, text: str) -> tuple[float, int]:
        if not text:
            return 0.0, 0
        if not self.local:
            return self.best(MARK + text.replace(" ", MARK))
        if len(self.memo) > self.words:
            self.memo = {}
        memo, score, n = self.memo, 0.0, 0
        if "  " in text or text[0] == " " or text[-1] == " " or MARK in text:
            words = re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", MARK + text.replace(" ", MARK))
        else:
            words = [MARK + w for w in text.split(" ")]
        for w in words:
            got = memo.get(w)
            if got is None:
                got = self.word(w)
                if len(w) < 64:
                    memo[w] = got
            score += got[0]
            n += got[1]
        return score, n


def count_tokens(df: DataFrame, id_col: str, text_col: str, model_path: str) -> DataFrame:
    """One row per input row: id, n_tokens, best_score. Null and empty texts have 0 pieces and score 0.

    Repeated rows are counted one by one; an empty table gives no rows.
    """
    ids = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for batch in batches:
            counter = counter or Counter(vocabulary(model_path)[0])
            got = [counter.count(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for _, n in got], pa.int64()), pa.array([s for s, _ in got], pa.float64())], ["id", "n_tokens", "best_score"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {ids}, n_tokens bigint, best_score double")
