"""Removal of byte strings that occur more than once in a corpus, exactly.

A byte goes if some string of `length` bytes that covers it also starts
anywhere else in the corpus.  All such strings are found without an entry for
each byte:

1. Every window of `length` bytes has one anchor: its leftmost smallest k-gram
   by a fixed hash.  Equal windows have equal anchors at the same place, so
   only windows below the same k-gram can be equal.  One row stands for all
   windows of an anchor: their span, about `length + 85` bytes, is its domain.
2. Anchors whose k-gram occurs once are done.  Domains that occur twice as a
   whole are repeated throughout, which covers the inside of every copy
   without fetching its bytes again.
3. What is left are the edges of copies: different domains below one k-gram.
   Of each group of them the strings to the right of the anchor and, reversed,
   those to its left are ordered by deep-shallow sorting; the two
   longest-common-prefix arrays give every pair's match around the anchor, and
   the ones of `length` bytes or more mark what is repeated.
4. A group of more than `hot` different domains is never gathered: its windows
   are counted by 128-bit hashes with partial aggregation.  Blocks of windows
   are counted first; the windows of a block that many domains share are
   written for one of them only.  All windows of a domain hold its anchor, so
   its first and last repeated ones span everything that goes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, n_parts, text_bytes
from .deep_shallow import deep_shallow, lcp

GRAM = 32
HOT = 32
BLOCK = 8
_TABLE = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Hash of each run of `gram` bytes (a power of two), by doubling."""
    h, size = _TABLE[data], 1
    while size < gram:
        b = h[size:]
        b = (b ^ (b >> np.uint64(29))) * _B
        h = h[:-size] * _A + b
        size *= 2
    return h ^ (h >> np.uint64(32))


def anchors(text: bytes, length: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, first window, last window) of each anchor of a text."""
    n = len(text)
    if n < length:
        z = np.zeros(0, np.int64)
        return z, z, z, z
    h = gram_hashes(np.frombuffer(text, np.uint8), gram)
    w = length - gram + 1
    m, at, size = h, np.arange(len(h), dtype=np.int32), 1
    while size < w:
        step = min(size, w - size)
        right = m[step:] < m[:-step]
        at = np.where(right, at[step:], at[:-step])
        m = np.minimum(m[step:], m[:-step])
        size += step
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    q = at[first].astype(np.int64)
    last = np.r_[first[1:] - 1, len(at) - 1]
    return h[q].view(np.int64), q, first, last


def _small(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Slices, so that no worker holds the Python objects of a whole batch."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


OCC = pa.schema([("kg", pa.int64()), ("ch", pa.int64()), ("id", pa.int64()), ("p0", pa.int32()), ("lf", pa.int16()), ("ln", pa.int32())])


def _scan(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[], [], [], [], [], []]
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                b = t.as_py()
                h, q, lo, hi = anchors(b, length, gram)
                if not len(h):
                    continue
                end = hi + length
                ch = [xxhash.xxh3_64_intdigest(b[s:e], x) for s, e, x in zip(lo.tolist(), end.tolist(), (q - lo).tolist(), strict=True)]
                for c, v in zip(cols, (h, np.array(ch, np.uint64).view(np.int64), np.full(len(h), i), lo.astype(np.int32), (q - lo).astype(np.int16), (end - lo).astype(np.int32)), strict=True):
                    c.append(v)
                if sum(map(len, cols[0])) > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), f.type) for c, f in zip(cols, OCC, strict=True)], schema=OCC)
                    cols = [[], [], [], [], [], []]
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), f.type) for c, f in zip(cols, OCC, strict=True)], schema=OCC)
    return run


CTX = pa.schema([("kg", pa.int64()), ("uniq", pa.bool_()), ("hot", pa.bool_()), ("id", pa.int64()), ("p0", pa.int32()), ("lf", pa.int32()), ("ctx", pa.binary())])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, requests) to the bytes of each request."""
    for batch in _small(batches):
        rows: list[tuple] = []
        for i, t, want in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            b = t.as_py()
            for w in want.as_py():
                c = b[w["p0"]:w["p0"] + w["ln"]]
                # another text of the same id has other bytes there
                if xxhash.xxh3_64_intdigest(c, w["lf"]) == w["ch"] & (1 << 64) - 1:
                    rows.append((w["kg"], w["uniq"], w["hot"], i, w["p0"], w["lf"], c))
        cols = list(zip(*rows, strict=True)) or [[]] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, CTX, strict=True)], schema=CTX)


def _pair_lcps(strings: list[bytes], known: int) -> np.ndarray:
    m = len(strings)
    if m == 2:
        x = lcp(strings[0], strings[1], known)
        return np.array([[0, x], [x, 0]])
    order, adjacent = deep_shallow(strings, known)
    sorted_ = np.zeros((m, m), np.int64)
    a = np.array(adjacent, np.int64)
    for k in range(m - 1):
        sorted_[k, k + 1:] = np.minimum.accumulate(a[k:])
    sorted_ = np.maximum(sorted_, sorted_.T)
    out = np.empty_like(sorted_)
    out[np.ix_(order, order)] = sorted_
    return out


def group_matches(members: list[tuple[int, bytes]], length: int, gram: int = GRAM) -> list[tuple[int, int]]:
    """For each (bytes before the anchor, domain) how many bytes before and
    after the anchor's start are covered by matches with others; (0, 0) if none."""
    right = _pair_lcps([c[lf:] for lf, c in members], gram)
    left = _pair_lcps([c[:lf][::-1] for lf, c in members], 0)
    ok = left + right >= length
    np.fill_diagonal(ok, False)
    return list(zip((left * ok).max(1).tolist(), (right * ok).max(1).tolist(), strict=True))


SPAN = pa.schema([("id", pa.int64()), ("s", pa.int32()), ("e", pa.int32())])


def _edges(length: int, gram: int):
    def close(group: list[tuple], out: list[tuple]) -> None:
        if len(group) < 2:
            return
        for (_, uniq, i, p0, lf, _), (a, b) in zip(group, group_matches([(x[4], x[5]) for x in group], length, gram), strict=True):
            if uniq and b:
                out.append((i, p0 + lf - a, p0 + lf + b))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        for batch in _small(batches):
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and group[0][0] != row[0]:
                    close(group, out)
                    group = []
                group.append(row)
            yield _spans(out)
        out = []
        close(group, out)
        yield _spans(out)
    return run


def _spans(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, SPAN, strict=True)], schema=SPAN)


BLK = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("kg", pa.int64()), ("id", pa.int64()), ("p0", pa.int32()), ("k", pa.int32())])


def _halves(b: bytes) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(b)
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _blocks(length: int, block: int):
    """(kg, id, p0, lf, ctx) to the hash of each whole block of windows, dealt
    from the anchor so that equal blocks start at the same distance to it."""
    size = length + block - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches):
            rows = [(*_halves(ctx[k:k + size]), kg, i, p0, k) for kg, i, p0, lf, ctx in zip(*(c.to_pylist() for c in batch.columns), strict=True)
                    for k in range(lf % block, len(ctx) - size + 1, block)]
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, BLK, strict=True)], schema=BLK)
    return run


WIN = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("ask", pa.bool_()), ("id", pa.int64()), ("p0", pa.int32()), ("k", pa.int32())])


def _windows(length: int, block: int):
    """(uniq, id, p0, ctx, blocks) to window hashes.  A repeated block's windows
    come from the domain that stands for it; `ask` marks the windows that could
    widen what a domain's repeated blocks span."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches):
            rows = []
            for uniq, i, p0, ctx, blocks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ks = [x["k"] for x in blocks or ()]
                lo, hi = (min(ks), max(ks) + block) if ks else (len(ctx), 0)
                skip = {k for x in blocks or () if not x["stands"] for k in range(x["k"], x["k"] + block)}
                rows += [(*_halves(ctx[k:k + length]), uniq and not lo <= k < hi, i, p0, k) for k in range(len(ctx) - length + 1) if k not in skip]
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, WIN, strict=True)], schema=WIN)
    return run


def _hot_spans(scratch: Scratch, ctx: DataFrame, length: int, block: int = BLOCK) -> DataFrame:
    """(id, s, e) for (kg, uniq, id, p0, lf, ctx) of groups of any size."""
    blk = scratch.save(ctx.select("kg", "id", "p0", "lf", "ctx").mapInArrow(_blocks(length, block), "h1 long, h2 long, kg long, id long, p0 int, k int"))
    shared = blk.groupBy("h1", "h2").agg(F.count("*").alias("c"), F.min(F.struct("kg", "id", "p0")).alias("one")).where("c > 1")
    stands = F.struct("kg", "id", "p0") == F.col("one")
    seen = scratch.save(blk.join(shared, ["h1", "h2"]).groupBy("kg", "id", "p0").agg(F.collect_list(F.struct("k", stands.alias("stands"))).alias("blocks")))
    win = scratch.save(ctx.join(seen, ["kg", "id", "p0"], "left").select("uniq", "id", "p0", "ctx", "blocks")
                       .mapInArrow(_windows(length, block), "h1 long, h2 long, ask boolean, id long, p0 int, k int"))
    twice = win.groupBy("h1", "h2").agg(F.count("*").alias("c")).where("c > 1").select("h1", "h2")
    wider = win.where("ask").join(twice, ["h1", "h2"]).select("id", (F.col("p0") + F.col("k")).alias("s"), (F.col("p0") + F.col("k") + length).alias("e"))
    known = seen.join(ctx.where("uniq").select("kg", "id", "p0").distinct(), ["kg", "id", "p0"]).select(
        "id", (F.col("p0") + F.array_min("blocks.k")).alias("s"), (F.col("p0") + F.array_max("blocks.k") + (block - 1 + length)).alias("e"))
    scratch.drop(blk)
    return known.unionByName(wider)


def row_key(id_col: str, text_col: str):
    """Of id and text, either null or not: rows that share it are copies of one
    row, but for a chance of 2**-64 a pair."""
    return F.xxhash64(F.col(id_col).isNull(), F.col(id_col).cast("long"), F.col(text_col).cast("binary"))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(id, spans array<struct<s,e>>): byte ranges to remove, possibly
    overlapping, for each `row_key`."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    src = docs.select(row_key(id_col, text_col).alias("id"), text_bytes(text_col).alias("t"))
    occ = scratch.save(src.where(F.length("t") >= length).mapInArrow(_scan(length, gram), "kg long, ch long, id long, p0 int, lf short, ln int"))
    # counts are written before they are joined, so that Spark may split a frequent k-gram's rows
    again = scratch.save(occ.groupBy("kg").agg(F.count("*").alias("c")).where("c > 1").select("kg"))
    rep = scratch.save(occ.join(again, "kg"))
    scratch.drop(occ, again)
    cls = scratch.save(rep.groupBy("kg", "ch").agg(F.count("*").alias("c"), F.min(F.struct("id", "p0", "lf", "ln")).alias("one")))
    whole = rep.join(cls.where("c > 1").select("kg", "ch"), ["kg", "ch"]).select("id", F.col("p0").alias("s"), (F.col("p0") + F.col("ln")).alias("e"))
    kinds = scratch.save(cls.groupBy("kg").agg(F.count("*").alias("m")).where("m > 1"))
    # the bytes of the different domains below one k-gram
    want = cls.join(kinds, "kg").select("one.id", F.struct("kg", (F.col("c") == 1).alias("uniq"), (F.col("m") > hot).alias("hot"), "one.p0", F.col("one.lf").cast("int").alias("lf"), "one.ln", "ch").alias("w"))
    asked = want.groupBy("id").agg(F.collect_list("w").alias("want"))
    ctx = scratch.save(src.join(asked, "id").select("id", "t", "want").mapInArrow(_cut, "kg long, uniq boolean, hot boolean, id long, p0 int, lf int, ctx binary"))
    # read from a table, never from a join by kg: Spark would take the join's exchange for this
    # one, and then deal out parts of a group where it splits or broadcasts that join
    few = ctx.where("not hot").drop("hot").repartition(n_parts(spark), "kg").sortWithinPartitions("kg")
    edges = few.mapInArrow(_edges(length, gram), "id long, s int, e int")
    many = _hot_spans(scratch, scratch.save(ctx.where("hot").drop("hot")), length)
    spans = scratch.save(whole.unionByName(edges).unionByName(many))
    scratch.drop(rep)
    return spans.groupBy("id").agg(F.collect_list(F.struct("s", "e")).alias("spans"))


def merged(spans: list[dict] | None, n: int) -> list[tuple[int, int]]:
    """Sorted, clipped to n, and joined where they touch."""
    out: list[list[int]] = []
    for s, e in sorted((x["s"], min(x["e"], n)) for x in spans or ()):
        if s >= e:
            continue
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(a, b) for a, b in out]


def _cleaner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _small(batches):
        n, gone, runs, sha, kept = [], [], [], [], []
        for t, spans in zip(batch.column(1), batch.column(2), strict=True):
            b = t.as_py()
            cuts = merged(spans.as_py(), len(b))
            at, parts = 0, []
            for s, e in cuts:
                parts.append(b[at:s])
                at = e
            rest = b"".join([*parts, b[at:]])
            n.append(len(b))
            gone.append(len(b) - len(rest))
            runs.append(len(cuts))
            sha.append(hashlib.sha256(rest).hexdigest())
            kept.append(rest.decode(errors="ignore"))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.string()), *batch.columns[3:]],
                                         names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", *batch.schema.names[3:]])


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, gram: int = GRAM, hot: int = HOT, carry: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept.

    `kept` is the remaining text, without the rest of characters that lost some
    of their bytes; kept_sha256 is of the remaining bytes.  With `carry` the
    other columns come along in a struct `row`, whatever their names.

    A null text counts as empty.  Matches never cross documents.  Each row is a
    document: a repeated row is one more with that text, so both lose what they
    share, and so do rows of one doc_id, null or not, with different texts.  Texts
    below `length` bytes and empty tables need no case of their own.  Other
    columns are not read.
    """
    spans = repeated_spans(docs, id_col, text_col, length, gram, hot)
    src = docs.select(row_key(id_col, text_col).alias("id"), F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("t"),
                      *([F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("row")] if carry else []))
    kind = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string"
    if carry:
        kind += f", row {src.schema['row'].dataType.simpleString()}"
    return src.join(spans, "id", "left").select("doc_id", "t", "spans", *(["row"] if carry else [])).mapInArrow(_cleaner, kind)
