"""Toxicity by a subsequence string-kernel support vector machine.

The kernel of two words counts their common subsequences of `order` letters,
each weighed by `decay` to the power of the letters it spans, so an insult with
letters inserted or left out still resembles itself.  A Nyström map over a few
landmark words turns it into vectors, on which a linear machine with squared
hinge loss is trained.  A text scores as its worst unit: a word, or a run of
single letters set apart ("w o r d"), so its length neither hides nor feeds it.

Training sees sentences of labelled documents; which of a toxic document's
words earn the label is found by alternation (the best-scoring one of each,
starting from words that are frequent in toxic and absent from clean ones).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship

ORDER, DECAY = 4, 0.7
LANDMARKS = 32
SAMPLE_PER_CLASS = 500
SAMPLE_CHARS = 20_000
UNIT = 24
MEMO_WORDS = 500_000
_NOT_LETTER = re.compile(r"[\W_]+")


def units(word: str) -> list[str]:
    """A word's letters and digits, lower-cased; overlapping pieces of very long ones."""
    w = (word if word.isalnum() else _NOT_LETTER.sub("", word)).lower()
    return pieces(w)


#: Beyond the first plane everything counts as a letter.
_ALNUM = np.array([chr(i).isalnum() for i in range(1 << 16)] + [True])


def pieces(w: str) -> list[str]:
    if len(w) <= UNIT:
        return [w] if w else []
    return [w[i:i + UNIT] for i in range(0, len(w) - UNIT // 2, UNIT // 2)]


_SPACED = re.compile(rb"(?<!\S)(?:[A-Za-z0-9][^A-Za-z0-9\s]?\s+){2,}[A-Za-z0-9][^A-Za-z0-9\s]?(?!\S)")


def spaced(text: bytes) -> list[bytes]:
    """Runs of three or more single letters set apart, joined."""
    return [b"".join(m.split()) for m in _SPACED.findall(text)]


def _codes(words: list[str], width: int) -> np.ndarray:
    out = np.zeros((len(words), width), np.uint32)
    for i, w in enumerate(words):
        out[i, :len(w)] = np.frombuffer(w.encode("utf-32-le"), np.uint32)
    return out


def _raw_kernel(a: np.ndarray, b: np.ndarray, order: int, decay: float) -> np.ndarray:
    """Row by row, by the usual dynamic programme; 0 pads and matches nothing."""
    n, la, lb = len(a), a.shape[1], b.shape[1]
    d, d2 = np.float32(decay), np.float32(decay * decay)
    # spread[k, m] = decay ** (m - k) carries a match at k to the places after it
    step = np.arange(lb)[None, :] - np.arange(lb)[:, None]
    spread = np.where(step >= 0, float(decay) ** np.maximum(step, 0), 0).astype(np.float32)
    same = [d2 * ((a[:, j, None] == b) & (b != 0)) for j in range(la)]
    before = [np.ones((n, lb + 1), np.float32)] * (la + 1)
    for _ in range(order - 1):
        now = [np.zeros((n, lb + 1), np.float32)]
        for j in range(la):
            row = d * now[j]
            row[:, 1:] += (same[j] * before[j][:, :-1]) @ spread
            now.append(row)
        before = now
    total = np.zeros(n, np.float32)
    for j in range(la):
        total += np.einsum("nk,nk->n", same[j], before[j][:, :-1])
    return total


def _by_length(words: list[str], block: int = 8192) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    size = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(size):
        if n:
            at = np.flatnonzero(size == n)
            for i in range(0, len(at), block):
                yield at[i:i + block], _codes([words[x] for x in at[i:i + block]], int(n))


def self_kernels(words: list[str], order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    out = np.ones(len(words), np.float32)
    for idx, c in _by_length(words):
        out[idx] = _raw_kernel(c, c, order, decay)
    return np.where(out > 0, out, 1)


def _common(codes: np.ndarray, marks: list[str]) -> np.ndarray:
    """Longest common subsequence of each word with each mark, bit-parallel."""
    letters = np.array(sorted({c for m in marks for c in map(ord, m)}), np.uint32)
    mask = np.zeros((len(letters) + 1, len(marks)), np.uint32)
    for m, mark in enumerate(marks):
        for k, c in enumerate(mark):
            mask[np.searchsorted(letters, ord(c)), m] |= np.uint32(1 << k)
    at = np.minimum(np.searchsorted(letters, codes), len(letters) - 1)
    at = np.where(letters[at] == codes, at, len(letters))
    v = np.full((len(codes), len(marks)), 0xFFFFFFFF, np.uint32)
    for j in range(codes.shape[1]):
        u = v & mask[at[:, j]]
        v = (v + u) | (v - u)
    full = np.array([(1 << len(m)) - 1 for m in marks], np.uint32)
    return np.bitwise_count(~v & full)


def kernel(words: list[str], marks: list[str], order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """Normalised kernel matrix (marks of at most 31 letters).  Pairs without a
    common subsequence of `order` letters are zero and cost a few bit operations."""
    out = np.zeros((len(words), len(marks)), np.float32)
    if not words or not marks:
        return out
    for idx, c in _by_length(words):
        out[idx] = _kernel_rows(c, marks, order, decay)
    return out


def _kernel_rows(c: np.ndarray, marks: list[str], order: int, decay: float) -> np.ndarray:
    """Of words of one length, given as codes."""
    out = np.zeros((len(c), len(marks)), np.float32)
    i, m = np.nonzero(_common(c, marks) >= order)
    if not len(i):
        return out
    mark_codes = _codes(marks, max(map(len, marks)))
    mark_norm = self_kernels(marks, order, decay)
    got = np.concatenate([_raw_kernel(c[i[x:x + 8192]], mark_codes[m[x:x + 8192]], order, decay) for x in range(0, len(i), 8192)])
    own = np.unique(i)
    norm = np.ones(len(c), np.float32)
    norm[own] = np.concatenate([_raw_kernel(c[own[x:x + 8192]], c[own[x:x + 8192]], order, decay) for x in range(0, len(own), 8192)])
    out[i, m] = got / np.sqrt(norm[i] * mark_norm[m])
    return out


@dataclass
class Model:
    marks: list[str]
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def decide(self, words: list[str]) -> np.ndarray:
        return kernel(words, self.marks) @ self.weights + np.float32(self.bias)

    def decide_rows(self, codes: np.ndarray) -> np.ndarray:
        return _kernel_rows(codes, self.marks, ORDER, DECAY) @ self.weights + np.float32(self.bias)

    def probability(self, decision: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * decision + self.offset, -30, 30)))


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, reg: float = 1e-3, steps: int = 40) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss by Newton steps."""
    a = np.c_[x, np.ones(len(x))].astype(np.float64)
    w = np.zeros(a.shape[1])
    ridge = np.diag(np.r_[np.full(x.shape[1], reg), 1e-8])
    for _ in range(steps):
        gap = 1 - y * (a @ w)
        act = gap > 0
        g = ridge @ w - (a[act] * (weight[act] * y[act] * gap[act])[:, None]).sum(0)
        h = ridge + (a[act] * weight[act][:, None]).T @ a[act]
        step = np.linalg.solve(h + 1e-9 * np.eye(len(w)), g)
        w = w - step
        if np.abs(step).max() < 1e-7:
            break
    return w[:-1], float(w[-1])


def _calibrate(s: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve that is a half between the toxic
    and the clean documents: where toxic ones found, less four times the share
    of clean ones accused, is highest (the middle of that stretch)."""
    edge = np.unique(s)
    mid = np.r_[edge[0] - 1, (edge[1:] + edge[:-1]) / 2]
    ahead = lambda v: 1 - np.searchsorted(np.sort(v), mid) / len(v)
    worth = ahead(s[y]) - 4 * ahead(s[~y])
    at = float(mid[worth >= worth.max() - 1e-12].mean())
    gap = max(1e-3, float(np.median(s[y]) - at) if (s[y] > at).any() else 1.0)
    slope = min(20.0, max(1.0, 4 / gap))
    return slope, -slope * at


def _variants(word: str, rng: np.random.Generator) -> list[str]:
    """A letter inserted, doubled, left out or replaced."""
    out = []
    for k in range(1, len(word)):
        out.append(word[:k] + chr(97 + int(rng.integers(26))) + word[k:])
        if len(word) >= 6:
            out.append(word[:k] + word[k + 1:])
        if len(word) >= 5 and k + 1 < len(word):
            out.append(word[:k] + chr(48 + int(rng.integers(10))) + word[k + 1:])
    return out + [word[:1] + word, word + word[-1:]]


def sentences(text: str) -> list[str]:
    return [s for s in re.split(r"(?<=[.!?])\s+|\n+", text) if s.strip()]


def train(texts: list[str], toxic: list[bool], landmarks: int = LANDMARKS, rounds: int = 2, seed: int = 11) -> Model:
    rng = np.random.default_rng(seed)
    bags: list[set[str]] = []
    for t in texts:
        bag: set[str] = set()
        for s in sentences(t):
            raw = s.encode()
            for w in {*raw.split(), *spaced(raw)}:
                bag.update(units(w.decode(errors="replace")))
        bags.append(bag)
    y = np.array(toxic, bool)
    if not y.any() or y.all():
        return Model([], np.zeros(0, np.float32), 0.0, 1.0, -5.0 if not y.any() else 5.0)
    bad, good = Counter(), Counter()
    for bag, flag in zip(bags, y, strict=True):
        (bad if flag else good).update(bag)
    n1, n0 = int(y.sum()), int((~y).sum())

    def gain(w: str) -> float:
        p, q = (bad[w] + 0.1) / (n1 + 0.2), (good[w] + 0.1) / (n0 + 0.2)
        return p * np.log(p / q) if p > q else 0.0

    ranked = sorted((w for w in bad if bad[w] >= max(5, 0.01 * n1) and len(w) >= 3), key=lambda w: (-gain(w), w))
    # one landmark for each family of similar words that explains toxic documents
    top = gain(ranked[0]) if ranked else 0.0
    cand = [w for w in ranked if gain(w) >= 0.04 * top and good[w] * n1 <= 0.2 * bad[w] * n0 and len(w) < 32][:600]
    alike = kernel(cand, cand) >= 0.5
    have = {w: {i for i in range(len(y)) if y[i] and w in bags[i]} for w in cand}
    left, chosen, family, taken = {i for i in range(len(y)) if y[i]}, [], set(), np.zeros(len(cand), bool)
    for k, w in enumerate(cand):
        if taken[k] or len(chosen) >= landmarks * 3 // 4:
            continue
        kin = [cand[j] for j in np.flatnonzero(alike[k])] or [w]
        docs = set().union(*(have[v] for v in kin))
        if len(docs & left) >= max(2, 0.01 * n1) or len(docs) >= max(5, 0.03 * n1):
            chosen.append(w)
            family.update(kin)
            taken |= alike[k]
            left -= docs
    if not chosen:  # nothing in so few labels tells the classes apart: accuse nobody
        return Model([], np.zeros(0, np.float32), 0.0, 1.0, -5.0)
    family.update(chosen)
    clean = sorted(good)
    few = [clean[i] for i in rng.permutation(len(clean))[:20_000]]
    near = kernel(few, chosen).max(1) if few else np.zeros(0)
    hard = [few[i] for i in np.argsort(-near, kind="stable")[:3000]]
    other = [few[i] for i in rng.permutation(len(few))[:3000]]
    marks = [w for w in chosen + hard[:max(4, len(chosen) // 3)] if len(w) < 32]
    k_mm = kernel(marks, marks).astype(np.float64)
    val, vec = np.linalg.eigh(k_mm + 1e-6 * np.eye(len(marks)))
    root = vec @ np.diag(1 / np.sqrt(np.maximum(val, 1e-6))) @ vec.T
    pos = sorted(family)
    neg = sorted(set(hard + other) - set(pos))
    model = None
    for _ in range(rounds):
        pos_all = sorted(set(pos)) + [v for w in sorted(set(pos) & set(chosen)) for v in _variants(w, rng) if v not in good]
        words = pos_all + neg
        label = np.r_[np.ones(len(pos_all)), -np.ones(len(neg))]
        weight = np.where(label > 0, 1 / max(1, len(pos_all)), 4 / max(1, len(neg))) * 100
        w, b = _svm(kernel(words, marks).astype(np.float64) @ root, label, weight)
        model = Model(marks, (root @ w).astype(np.float32), b, 1.0, 0.0)
        vocab = sorted(set().union(*bags))
        score = dict(zip(vocab, model.decide(vocab).tolist(), strict=True))
        best = np.array([max((score[u] for u in bag), default=b) for bag in bags])
        # a witness resembles a word that stands out by itself
        wit = {max(bag, key=lambda u: (score[u], u)) for bag, flag in zip(bags, y, strict=True) if flag and bag}
        wit = sorted(u for u in wit if score[u] > 0 and good[u] == 0)
        pos = sorted(family | {u for u, k in zip(wit, kernel(wit, chosen).max(1, initial=0).tolist(), strict=True) if k > 0.4})
        neg = sorted((set(neg) | {u for u in good if score[u] > -0.3}) - set(pos))
    model.slope, model.offset = _calibrate(best, y)
    return model


class Scorer:
    """Best decision of a text; words are scored once while the memo holds them."""

    def __init__(self, model: Model):
        self.model, self.memo = model, {}

    def learn(self, words: set[bytes]) -> None:
        new = [w for w in words if w not in self.memo]
        if len(self.memo) + len(new) > MEMO_WORDS:
            self.memo.clear()
            new = list(words)
        for i in range(0, len(new), 100_000):
            part = new[i:i + 100_000]
            self.memo.update(zip(part, self._decide(part).tolist(), strict=True))

    def _decide(self, words: list[bytes]) -> np.ndarray:
        """The same as the best decision of `units` of each word, all at once."""
        c = np.frombuffer(b" ".join(words).decode(errors="replace").lower().encode("utf-32-le"), np.uint32)
        letter = _ALNUM[np.minimum(c, 1 << 16)]
        owner, c = np.cumsum(c == 32)[letter], c[letter]
        size = np.bincount(owner, minlength=len(words))
        start = np.cumsum(size) - size
        out = np.full(len(words), self.model.bias, np.float32)
        if not self.model.marks:
            return out
        for n in np.unique(size).tolist():
            at = np.flatnonzero(size == n)
            if 0 < n <= UNIT:
                for x in range(0, len(at), 16384):
                    out[at[x:x + 16384]] = self.model.decide_rows(c[start[at[x:x + 16384], None] + np.arange(n)])
            elif n:
                for w in at.tolist():
                    out[w] = self.model.decide(pieces(c[start[w]:start[w] + n].tobytes().decode("utf-32-le"))).max()
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        bags = []
        for t in texts:
            low = t.lower()
            bags.append({*low.split(), *spaced(low)})
        self.learn(set().union(*bags))
        get = self.memo.__getitem__
        best = np.array([max(map(get, b)) if b else self.model.bias for b in bags])
        return self.model.probability(best)


_scorers: dict[bytes, Scorer] = {}


def _scoring(blob: bytes, text_col: str, out_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        if blob not in _scorers:
            _scorers.clear()
            _scorers[blob] = Scorer(pickle.loads(blob))
        scorer = _scorers[blob]
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                part = batch.slice(i, 2000)
                s = scorer.scores([(t or "").encode() for t in part.column(text_col).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s, pa.float64())], names=[*part.schema.names, out_col])
    return run


def scored(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "toxicity_score") -> DataFrame:
    """All columns and out_col, the probability that a text is toxic."""
    import pickle

    ship(docs.sparkSession)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(_scoring(pickle.dumps(model), text_col, out_col), f"{kinds}, `{out_col}` double")


def remainder(col: str = "doc_id"):
    """crc32 of the id as text, modulo 5; 0 is held out."""
    return F.pmod(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(5))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_PER_CLASS, chars: int = SAMPLE_CHARS) -> Model:
    """Trains on at most `sample` documents of each class, those of smallest
    hash among the labelled ones that are not held out, and of these the ones
    of at most `chars` characters: at most 2 * sample * chars characters."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").where(remainder() != 0).select("doc_id", "toxic")
    order = F.xxhash64(F.col("doc_id"), F.lit(3))
    ids = None
    for c in (0, 1):
        part = known.where(F.col("toxic") == c).orderBy(order, "doc_id").limit(sample)
        ids = part if ids is None else ids.unionByName(part)
    got = docs.select("doc_id", "text").where(F.length("text") <= chars).join(F.broadcast(ids), "doc_id").select("doc_id", "text", "toxic").limit(4 * sample).collect()
    rows = sorted((r.doc_id, r.text, r.toxic) for r in got)
    return train([r[1] for r in rows], [bool(r[2]) for r in rows])


def score(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Scores depend on the text alone.  Null and empty texts score as a text
    without units.  Repeated rows and ids are scored each; a null doc_id is
    not held out and never a label.  Without labels of both classes nothing
    (or everything) is toxic; where no word stands out, nothing is.  Very long texts are scored whole.  An empty
    table gives an empty result.
    """
    out = scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model or fit(docs, labels))
    score_ = F.col("toxicity_score")
    return out.select("doc_id", F.coalesce(remainder() == 0, F.lit(False)).alias("held_out"), score_.alias("score"), (score_ >= 0.5).cast("int").alias("predicted"))
