"""Token ids as ORC files: one row per document in id order, read back stripe by stripe.

Texts are dealt by ranges of the id and sorted, so part k of the files holds ids below
those of part k + 1. Each part is encoded and written by one task: ORC's integer run-length
encoding packs the ids, each stripe has row indexes, and document ids have a Bloom filter
besides, so a look-up of one id opens the stripes that may hold it. There is no
further compression: it would cost more CPU than the disk that it saves is worth here. A row also has its place in the
part (``part``, ``row``, ``start_in_part``), which makes the whole order readable from
column pruned scans: parts before it are summed, one row for each part.

Texts are cut where the pre-tokenizer always cuts: before white space that follows
something else. A piece is encoded once and remembered, up to a bounded number of pieces.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rooftally.llm.text import shared_dir

#: Pieces that a worker remembers before it starts anew.
PIECES = 800_000
#: Rows of the table of parts up to which it is broadcast.
BROADCAST_PARTS = 50_000
#: Bytes of text that a part holds, about, so that parts are many, not large, when the input grows.
PART_BYTES = 64 << 20
#: Bytes of text in one call of the tokenizer's batch.
_BATCH = 1 << 20
#: White space of the pre-tokenizer besides the blank and the line end.
_OTHER = "\t\x0b\x0c\r\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_ENDS = ".,;:!?"
_GAP = " \n" + _OTHER
_PIECE = re.compile(rf"[{_GAP}]*[^{_GAP}]+|[{_GAP}]+")


def plain(text: str) -> bool:
    """White space is single blanks and line ends between other characters."""
    ends = text[0] in " \n" or text[-1] in " \n"
    return not (ends or "  " in text or " \n" in text or "\n " in text or "\n\n" in text or "\0" in text or any(c in text for c in _OTHER))


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """A worker keeps its encoder, and what it remembers, from task to task."""
    return Encoder(path)


class Encoder:
    """Ids of whole texts as the tokenizers library gives them, as little-endian 16 or 32 bits."""

    def __init__(self, path: str, pieces: int = PIECES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a worker for each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.type = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.code = "H" if self.type.itemsize == 2 else "I"
        self.blank = np.zeros(1 << 8 * self.type.itemsize if self.type.itemsize == 2 else self.tokenizer.get_vocab_size(), bool)
        self.blank[[i for t, i in self.tokenizer.get_vocab().items() if t[0] == "\u0120"]] = True
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.pieces = pieces

    def _encode(self, some: list[str]) -> None:
        """Words after one blank are encoded in a row: each token that begins with a blank begins a word."""
        words, rest = [], []
        for x in some:
            (words if x[0] == " " and len(x) > 1 and not x[1].isspace() and "<|" not in x else rest).append(x)
        ids = np.array(self.tokenizer.encode_batch_fast(["".join(words)], add_special_tokens=False)[0].ids if words else [], self.type)
        ends = np.append(np.flatnonzero(self.blank[ids])[1:], len(ids)) * self.type.itemsize
        if words and len(ends) == len(words):
            raw, at = ids.tobytes(), 0
            for x, to in zip(words, ends.tolist()):
                self.memo[x] = raw[at:to]
                at = to
        else:
            rest = some
        for at in range(0, len(rest), 4096):
            self._encode_each(rest[at : at + 4096])

    def _encode_each(self, some: list[str]) -> None:
        for piece, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False)):
            self.memo[piece] = array(self.code, e.ids).tobytes()

    def _learn(self, new: list[str]) -> None:
        memo, old = self.memo, self.old
        ended, plain_ = [], set()
        for x in new:
            if x in old:
                memo[x] = old[x]
            elif x[-1] in _ENDS and len(x) > 1 and x[-2].isalpha():  # the pre-tokenizer cuts after the letter
                ended.append(x)
            else:
                plain_.add(x)
        for y in {x[:-1] for x in ended}.union(_ENDS):
            if y in old:
                memo[y] = old[y]
            elif y not in memo:
                plain_.add(y)
        self._encode(list(plain_))
        for x in ended:
            memo[x] = memo[x[:-1]] + memo[x[-1]]

    def texts(self, texts: list[str]) -> list[bytes]:
        cut, size, out = [], 0, []
        for text in texts:
            if not text:
                cut.append([])
            elif plain(text):
                cut.append(text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0"))
            else:
                cut.append(_PIECE.findall(text))
            size += len(text)
            if size > _BATCH:
                out += self._encoded(cut)
                cut, size = [], 0
        return out + self._encoded(cut)

    def _encoded(self, cut: list[list[str]]) -> list[bytes]:
        if len(self.memo) > self.pieces:  # pieces met since then stay for one more turn
            self.memo, self.old = {}, self.memo
        self._learn(list(set().union(*cut).difference(self.memo)))
        get = self.memo.__getitem__
        return [b"".join(map(get, pieces)) for pieces in cut]


def write(df: DataFrame, id_col: str, text_col: str, tokenizer_path: str, out: str, end_id: int = 0, parts: int | None = None, stripe_bytes: int = 16 << 20) -> None:
    """Writes ORC files to ``out``, which must be in a store that all executors share.

    Null texts are empty and have the end id alone. Rows of equal ids are in the order of
    their texts, null ids first. Parts are cut by id and the text's first characters, so rows of one id can be in
    several; rows that repeat both are in one. An empty table gives files without rows. Other columns aren't read.
    """
    spark = df.sparkSession
    ids = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if parts is None:
        size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    rows = rows.repartitionByRange(parts, F.col("id"), F.substring("text", 1, 16)).sortWithinPartitions("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, row, start = TaskContext.get().partitionId(), 0, 0
        coder = encoder(tokenizer_path)
        end = np.array([end_id], coder.type).tobytes()
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                raw = [x + end for x in coder.texts(batch.column(1).to_pylist())]
                n = np.fromiter(map(len, raw), np.int64, len(raw)) // coder.type.itemsize
                ids_ = np.frombuffer(b"".join(raw), coder.type).astype(np.int32)
                ends = np.cumsum(n)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0), pa.array(np.full(len(n), part, np.int32)), pa.array(np.arange(row, row + len(n))), pa.array(start + ends - n), pa.array(n),
                    pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(ids_)),
                ], ["doc_id", "part", "row", "start_in_part", "n_tokens", "ids"])
                row, start = row + len(n), start + int(ends[-1])

    coded = rows.mapInArrow(run, f"doc_id {ids}, part int, row bigint, start_in_part bigint, n_tokens bigint, ids array<int>")
    (coded.write.mode("error").option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01")
        .option("orc.stripe.size", str(stripe_bytes)).option("orc.row.index.stride", "10000").option("compression", "none").orc(out))


def look_up(spark: SparkSession, out: str, doc_id) -> DataFrame:
    """The rows of one document: statistics and Bloom filters leave out the other stripes."""
    return spark.read.orc(out).where(F.col("doc_id") == doc_id)


def digest(spark: SparkSession, out: str) -> DataFrame:
    """From the files: doc_id, start (ids before it), n_tokens, ids_crc32 (of little-endian 32 bits).

    A row for each row written, repeated ones too; files without rows give none.
    """
    files = spark.read.orc(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(4)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            crc = [zlib.crc32(memoryview(flat[i:j])) for i, j in zip([0, *ends[:-1].tolist()], ends.tolist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(crc, pa.int64())], ["doc_id", "part", "start_in_part", "n_tokens", "ids_crc32"])

    kind = files.schema["doc_id"].dataType.simpleString()
    rows = files.select("doc_id", "part", "start_in_part", "n_tokens", "ids").mapInArrow(run, f"doc_id {kind}, part int, start_in_part bigint, n_tokens bigint, ids_crc32 bigint")
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before")).persist()
    hint = F.broadcast if parts.count() <= BROADCAST_PARTS else lambda x: x
    return rows.join(hint(parts), "part").select("doc_id", (F.col("before") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32")


def new_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
