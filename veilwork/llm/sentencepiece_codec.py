"""SentencePiece encoding and decoding with shared prefixes.

Distinct marked words (a run of the space mark and what follows) are sorted and
walked as a trie, depth first: the forward table of a word's prefixes is kept
as far as the next word agrees with it and only continued from there.

The table depends on the kind of model.  A unigram model's entry is the best
score of a prefix and its last piece (Viterbi).  A merging (BPE) model is not
an additive score: its encoding is the one in which every two neighbouring
pieces merge to themselves, so the entry is the only piece that can end the
encoding of that prefix.  Both are exact and both share prefixes.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship

MARK = "▁"
MEMO_WORDS = 500_000


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Codec:
    def __init__(self, path: str):
        import sentencepiece

        sp = self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {names[i]: i for i in plain}
        self.text = {i: names[i] for i in plain}
        self.score = {i: sp.get_score(i) for i in plain}
        self.bytes = {int(names[i][1:-1], 16): i for i in range(n) if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        self.least = min(self.score.values(), default=0.0)
        ends: dict[str, set[int]] = {}
        for p in self.ids:
            ends.setdefault(p[-1], set()).add(len(p))
        self.sizes = {c: sorted(n, reverse=True) for c, n in ends.items()}
        # merging models score their pieces by rank: -0, -1, -2, ...
        ranks = sorted(self.score.values(), reverse=True)
        whole = [s for s in ranks if s > -1e8]
        self.merging = all(float(s).is_integer() for s in whole) and len(set(whole)) == len(whole)
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids) or any("\n" in p for p in self.ids):
            raise ValueError("pieces reach across words: words cannot be encoded one by one")
        self.word = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")
        # what the model does to a text beforehand, beyond marking spaces
        probe = "a  bﬁ c "
        self.plain_text = sp.normalize(probe) == MARK + probe.replace(" ", MARK)
        self.pairs: dict[tuple[int, int], bool] = {}
        self.split_of: dict[int, tuple[int, int] | None] = {}
        # letters come before all merges
        self.rank = {i: k for k, i in enumerate(sorted(plain, key=lambda i: (len(names[i]) > 1, -self.score[i], i)))}
        out = [b""] * n
        for i, p in self.text.items():
            out[i] = p.replace(MARK, " ").encode()
        for b, i in self.bytes.items():
            out[i] = bytes([b])
        out[self.unknown] = " ⁇ ".encode()
        self.out_size = np.array([len(b) for b in out])
        self.out_start = np.cumsum(self.out_size) - self.out_size
        self.out_flat = np.frombuffer(b"".join(out), np.uint8)
        self.reset()

    def reset(self) -> None:
        self.at: dict[str, int] = {}
        self.start, self.size, self.flat, self.used = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.uint32), 0

    def normalized(self, text: str) -> str:
        if not text:
            return ""
        return MARK + text.replace(" ", MARK) if self.plain_text else self.sp.normalize(text)

    def _halves(self, piece: int) -> tuple[int, int] | None:
        """The two pieces that a piece is last merged from; itself twice for a
        single letter; None if merging never makes it."""
        if piece not in self.split_of:
            name = self.text[piece]
            self.split_of[piece] = (piece, piece) if len(name) == 1 else None
            parts = list(name)
            while len(parts) > 1:
                best, at = -np.inf, -1
                for k in range(len(parts) - 1):
                    i = self.ids.get(parts[k] + parts[k + 1])
                    if i is not None and self.score[i] > best:
                        best, at = self.score[i], k
                if at < 0:
                    break
                if len(parts) == 2 and parts[0] in self.ids and parts[1] in self.ids:
                    self.split_of[piece] = (self.ids[parts[0]], self.ids[parts[1]])
                parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return self.split_of[piece]

    def _stay(self, a: int, b: int) -> bool:
        """Whether merging leaves two neighbours as they are: going back from
        the later of their own merges to the first letters at the border, no
        merge across it may come before the one that is undone."""
        key = (a, b)
        got = self.pairs.get(key)
        if got is not None:
            return got
        if len(self.pairs) > 2_000_000:
            self.pairs.clear()
        x, y, limit, rank, out = a, b, 1 << 60, self.rank, True
        while True:
            c = self.ids.get(self.text[x] + self.text[y])
            if c is not None and rank[c] < limit:
                out = False
                break
            rx, ry = rank[x], rank[y]
            left = (self._halves(x) or (x, x))[1]
            right = (self._halves(y) or (y, y))[0]
            if rx > ry and left != x or right == y and left != x:
                x, limit = left, rx
            elif right != y:
                y, limit = right, ry + 1
            else:
                break
        self.pairs[key] = out
        return out

    def _entry(self, word: str, i: int, table: list[tuple[int, int, float]]) -> tuple[int, int, float]:
        """(last piece or -1, its length, score) of the first i letters."""
        sizes = self.sizes.get(word[i - 1], ())
        if self.merging:
            for size in sizes:
                if size > i:
                    continue
                piece = self.ids.get(word[i - size:i])
                if piece is not None and (size == 1 or self._halves(piece)):
                    if i == size:
                        return (piece, size, 0.0)
                    before = table[i - size][0]
                    if before == -1 or self._stay(before, piece):
                        return (piece, size, 0.0)
            return (-1, 1, 0.0)
        found = (-1, 1, table[i - 1][2] + self.least - 10.0)
        for size in sizes:
            piece = self.ids.get(word[i - size:i]) if size <= i else None
            if piece is not None and table[i - size][2] + self.score[piece] > found[2]:
                found = (piece, size, table[i - size][2] + self.score[piece])
        return found

    def encode_words(self, words: list[str]) -> Iterator[tuple[str, list[int]]]:
        """Sorted distinct words; neighbours share the table of their common prefix."""
        before, table = "", [(-2, 0, 0.0)]
        for w in words:
            n = 0
            for a, b in zip(before, w, strict=False):
                if a != b:
                    break
                n += 1
            del table[n + 1:]
            for i in range(n + 1, len(w) + 1):
                table.append(self._entry(w, i, table))
            ids: list[int] = []
            i = len(w)
            while i:
                piece, size, _ = table[i]
                if piece >= 0:
                    ids.append(piece)
                else:
                    raw = w[i - 1].encode()
                    ids += [self.bytes[b] for b in reversed(raw)] if self.bytes else [self.unknown]
                i -= size
            yield w, ids[::-1]
            before = w

    def learn(self, words: set[str]) -> None:
        """Knows all of `words` afterwards; the memo is emptied beforehand only."""
        if len(self.at) + sum(w not in self.at for w in words) > MEMO_WORDS:
            self.reset()
        for w, ids in self.encode_words(sorted(w for w in words if w not in self.at)):
            k, n = len(self.at), len(ids)
            if k == len(self.start):
                self.start, self.size = np.resize(self.start, 2 * k), np.resize(self.size, 2 * k)
            while self.used + n > len(self.flat):
                self.flat = np.resize(self.flat, 2 * len(self.flat))
            self.flat[self.used:self.used + n] = ids
            self.at[w], self.start[k], self.size[k] = k, self.used, n
            self.used += n

    def split(self, text: str) -> list[str]:
        return self.word.findall(self.normalized(text))

    def gather(self, words: list[str]) -> np.ndarray:
        k = np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))
        return _ragged(self.flat, self.start[k], self.size[k])

    def encode(self, text: str) -> np.ndarray:
        words = self.split(text)
        self.learn(set(words))
        return self.gather(words)

    def decode(self, ids: np.ndarray) -> str:
        raw = _ragged(self.out_flat, self.out_start[ids], self.out_size[ids]).tobytes()
        return raw[1:].decode(errors="replace") if raw[:1] == b" " else raw.decode(errors="replace")


def _ragged(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(start - (ends - size), size)]


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _encode(path: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                texts = [t or "" for t in part.column(1).to_pylist()]
                words = [c.split(t) for t in texts]
                c.learn(set().union(*words))
                n, crc, same, ids = [], [], [], []
                for t, p in zip(texts, words, strict=True):
                    x = c.gather(p)
                    n.append(len(x))
                    crc.append(zlib.crc32(x.astype("<u4").tobytes()))
                    same.append(c.decode(x) == t)
                    ids.append(x if with_ids else None)
                cols = [part.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())]
                names = ["doc_id", "n_tokens", "ids_crc32", "round_trip"]
                if with_ids:
                    cols, names = [*cols, pa.array(ids, pa.list_(pa.int64()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names=names)
    return run


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_crc32, round_trip[, ids].

    round_trip tells whether decoding the ids gives the text again.  A null
    text counts as empty and has no ids.  Texts of any length are encoded
    whole; repeated rows and null ids are kept; an empty table gives an empty
    result; other columns are not read.
    """
    ship(docs.sparkSession)
    kind = "doc_id long, n_tokens long, ids_crc32 long, round_trip boolean" + ", ids array<long>" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t")).mapInArrow(_encode(model or default_model(), with_ids), kind)


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            out = [None if x is None else c.decode(np.array(x, np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])
    return run


def decoded(ids: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str | None = None) -> DataFrame:
    """doc_id, text; null ids give a null text."""
    ship(ids.sparkSession)
    return ids.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("i")).mapInArrow(_decode(model or default_model()), "doc_id long, text string")
