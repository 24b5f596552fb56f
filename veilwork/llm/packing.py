"""Sum-of-squares packing of tokenised documents into fixed-length sequences.

The packer keeps the number of open bins for each residual gap and places a
piece where the sum of the squares of those numbers becomes smallest, which
keeps the gaps spread and fits later pieces exactly.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, text_bytes

SEQUENCE = 4096
END_ID = 1
LANE_ROWS = 50_000
MEMO_WORDS = 500_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder(dict):
    """Token ids of white-space separated words, as little-endian 32-bit bytes.

    The tokenizer drops white space before anything else, so a text's ids are
    its words' ids one after the other, and joining bytes puts them together.
    A word is looked up in this dict and encoded where it is missing: Latin
    letters with marks after them are two pieces that are lower-cased here and
    go to the merging model directly, once for all spellings; other words go
    through the whole tokenizer.  Both memos are emptied when they are full.
    """

    #: Letters whose case mapping and normal form are single and the same
    #: everywhere: the Latin letters below U+0180 but for the dotted capital I.
    #: ASCII marks but for the apostrophe, which the tokenizer may cut after.
    LATIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017f]+)([!-&(-/:-@[-`{-~]*)").fullmatch

    def __init__(self, path: str):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        self.merge = self.whole.model.tokenize
        # printable bytes stand for themselves, the others follow from U+0100 on
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in own]
        self.as_text = {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}
        self.parts: dict[str, bytes] = {}

    def _part(self, part: str) -> bytes:
        if len(self.parts) >= MEMO_WORDS:
            self.parts.clear()
        text = part if part.isascii() else "".join(map(self.as_text.__getitem__, part.encode()))
        ids = self.parts[part] = array("I", [t.id for t in self.merge(text)]).tobytes()
        return ids

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= MEMO_WORDS:
            self.clear()
        text, parts = word.decode(), self.parts
        if m := self.LATIN(text):
            letters, marks = m.groups()
            letters = letters.lower()
            ids = parts.get(letters) or self._part(letters)
            if marks:
                ids += parts.get(marks) or self._part(marks)
        else:
            ids = array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        self[word] = ids
        return ids

    def encode(self, text: bytes) -> bytes:
        return b"".join(map(self.__getitem__, text.split()))


_encoders: dict[str, WordEncoder] = {}

PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.list_(pa.uint32()))])


def _tokenise(path: str, capacity: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _encoders:
            _encoders[path] = WordEncoder(path)
        enc = _encoders[path]
        end = array("I", [end_id]).tobytes()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for lo in range(0, len(ids), 500):
                rows = []
                for i, t in zip(ids[lo:lo + 500], batch.column(1)[lo:lo + 500], strict=True):
                    seq = enc.encode(t.as_py()) + end
                    for p, s in enumerate(range(0, len(seq) // 4, capacity)):
                        x = seq[4 * s:4 * (s + capacity)]
                        rows.append((i, p, s, len(x) // 4, zlib.crc32(x), np.frombuffer(x, "<u4") if with_ids else None))
                cols = list(zip(*rows, strict=True)) or [[]] * 6
                arrays = [pa.array(c, f.type) for c, f in zip(cols, PIECES, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays[:6 if with_ids else 5], schema=PIECES if with_ids else pa.schema(list(PIECES)[:5]))
    return run


def tokenised_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
                     capacity: int = SEQUENCE, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    kind = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("t"))
    return src.mapInArrow(_tokenise(tokenizer or default_tokenizer(), capacity, end_id, with_ids), kind)


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin, offset) of each size, in the order given, and the number of bins.
    Ties go to the tightest gap.  A bin is opened only where no open one has
    room: sizes are known beforehand and come largest first, so keeping gaps
    spread by opening bins early only costs bins."""
    n_open = np.zeros(capacity + 1, np.int64)
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]
    where, offset, bins = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), 0
    for i, s in enumerate(sizes.tolist()):
        # change of the sum by taking an open bin of gap s, s+1, ... capacity
        grow = 2 * n_open[:capacity - s + 1] + 1
        grow[0] = 0
        cost = grow - 2 * n_open[s:] + 1
        cost[n_open[s:] == 0] = 1 << 40
        j = int(cost.argmin())
        g = capacity if cost[j] >= 1 << 40 else s + j
        if g == capacity:
            b, bins = bins, bins + 1
        else:
            b = open_[g].pop()
            n_open[g] -= 1
        if g > s:
            open_[g - s].append(b)
            n_open[g - s] += 1
        where[i], offset[i] = b, capacity - g
    return where, offset, bins


def _packer(capacity: int):
    def run(t: pa.Table) -> pa.Table:
        size = t.column("length").to_numpy()
        order = np.lexsort((t.column("piece").to_numpy(), t.column("doc_id").fill_null(-1).to_numpy(), -size))
        where, offset, _ = sum_of_squares(size[order], capacity)
        seq, off = np.empty_like(where), np.empty_like(offset)
        seq[order], off[order] = where, offset
        lane = t.column("lane").to_numpy()
        return t.drop_columns(["lane"]).append_column("sequence_id", pa.array((lane << 32) | seq)).append_column("offset", pa.array(off))
    return run


def packed(pieces: DataFrame, capacity: int = SEQUENCE, lane_rows: int = LANE_ROWS) -> DataFrame:
    """Adds sequence_id and offset to (doc_id, piece, start, length, ids_crc32).

    Pieces are dealt by hash to lanes of about `lane_rows`, each packed on its
    own, so a lane's memory is bounded at any input size; a lane leaves a
    handful of partly filled sequences of the tens of thousands it makes.
    """
    lanes = max(1, -(-pieces.count() // lane_rows))
    dealt = pieces.withColumn("lane", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(lanes)))
    return dealt.groupBy("lane").applyInArrow(_packer(capacity), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
                   capacity: int = SEQUENCE, end_id: int = END_ID, lane_rows: int = LANE_ROWS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the end id alone.  Only documents longer than
    `capacity` are cut.  Repeated rows and ids are packed once for each row; a
    null doc_id is kept.  An empty table gives an empty result.  Other columns
    are not read.
    """
    scratch = Scratch(docs.sparkSession)
    return packed(scratch.save(tokenised_pieces(docs, id_col, text_col, tokenizer, capacity, end_id)), capacity, lane_rows)
