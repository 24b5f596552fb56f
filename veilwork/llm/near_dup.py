"""MinHash near-duplicate detection with bottom-k sketches.

One 64-bit hash function orders the shingles; a document's sketch is its k
smallest shingle hashes.  Inverted lists of retained values generate the
candidates, the union sketch estimates the overlap, and Jaccard over the full
shingle sets confirms every link.

* Equal sets collapse first: groups of copies of any size become one class.
* Two documents of similarity t share about t*k values of their union sketch.
  At least `need` of k are shared except with probability under 1e-5 a pair at
  the threshold itself (exactly, for sets that the sketch holds whole), so only
  the `k - need + 1` rarest values of a sketch have to be looked up: frequent
  values lead nobody anywhere and their lists stay closed.
* A coarse sketch, the first values of the full one, goes first: a class that
  has too many values of its own there is left out of the lists, so only
  classes that can have a partner pay for all k values.  A value counts as its
  class's own where no other class that holds it has a size within the
  threshold: chance meetings of texts of other lengths open no list.
* A list first links its members to its most central one, whose values the most
  others retain: in a group of near copies that is the least edited.  Members
  of lists that then still hold different components get new lists from deeper
  sketches, which hold all but very long sets whole: there a pair has to share
  one of the few values that its two sizes allow to come before the overlap,
  and only pairs of different components come out.  A group of near copies
  therefore costs a row for each member and value, not for each pair, and no
  link that could join two components is skipped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, n_parts, text_bytes
from .components import connected_components

MEMO = 1 << 19
#: Values of a sketch, of the coarse one, and of the one for what is left in mixed lists.
RETAINED, COARSE, DEEP = 96, 32, 1024
#: Listed values that a pair shares at least, and members up to which a list's pairs are all counted.
SHARED, SMALL = 8, 4
#: Ratio of neighbouring size classes.
SIZE_STEP = 1.05
#: Places, a power of two, in the table that tells which texts are asked for.
MARKS = 1 << 24
#: Rounds in which lists of deep sketches link their members to one of them before all pairs are asked for.
ROUNDS = 2


class _WordHash(dict):
    def __missing__(self, w: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        h = self[w] = xxhash.xxh3_64_intdigest(w)
        return h


_words = _WordHash()


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the `width`-word shingles, as signed numbers.  Words are
    runs of bytes that are not ASCII white space, ASCII letters lower-cased;
    with fewer words than `width` the whole sequence is the one shingle."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, n)
    m = max(1, n - width + 1)
    acc = np.full(m, np.uint64(min(n, width)))
    for i in range(min(n, width)):
        acc = _mix(acc * np.uint64(0x9E3779B97F4A7C15) + h[i:i + m])
    return np.unique(acc.view(np.int64))


def required_overlap(k: int, percent: int) -> int:
    """Fewest shared values of k that a pair at the threshold shows, but for
    4.5 standard deviations."""
    t = percent / 100
    return max(1, math.floor(t * k - 4.5 * math.sqrt(k * t * (1 - t))))


def _floor_of(k: int, union: Column, percent: int) -> Column:
    """The same for a union of known size: a sketch is drawn from it without
    replacement, so it varies less the more of the union it holds."""
    t = percent / 100
    left = F.greatest(union - k, F.lit(0.0)) / F.greatest(union - 1, F.lit(1.0))
    return F.lit(t * k) - F.lit(4.5 * math.sqrt(k * t * (1 - t))) * F.sqrt(left)


SKETCH = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("sketch", pa.list_(pa.int64()))])


def _sketcher(width: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n, s1, s2, sk = [], [], [], [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = shingle_set(t.as_py(), width)
                d = xxhash.xxh3_128_intdigest(s.tobytes())
                ids.append(i)
                n.append(len(s))
                s1.append((d >> 64) - (1 << 63))
                s2.append((d & (1 << 64) - 1) - (1 << 63))
                sk.append(s[:k])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(sk, pa.list_(pa.int64()))], schema=SKETCH)
    return run


def sketches(docs: DataFrame, id_col: str, text_col: str, width: int, k: int) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("t")).mapInArrow(
        _sketcher(width, k), "id long, n long, s1 long, s2 long, sketch array<long>")


def _unlike(n: Column, k: int, percent: int) -> Column:
    """How many of a sketch's values a partner may lack: of a union of up to k
    shingles, held whole, as many as the threshold allows, and of larger ones
    what the estimate may differ by; a set's unions have n to n / threshold."""
    sampled = F.greatest(F.lit(required_overlap(k, percent)), F.floor(_floor_of(k, n.cast("double") / (percent / 100), percent)))
    whole = F.ceil(n * percent / 100)
    least = F.when(n * 100 < k * percent, whole).when(n <= k, F.least(whole, sampled)).otherwise(sampled)
    return F.least(n, F.lit(k)) - least


def _size_class(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / math.log(SIZE_STEP)).cast("int")


def _shared(values: DataFrame, percent: int) -> DataFrame:
    """(v, z, df): values of classes of size class z that another class holds
    too whose size is within the threshold; df counts all classes of v, so that
    every class orders its values alike."""
    reach = math.ceil(math.log(100 / percent) / math.log(SIZE_STEP) + 1e-6)
    # one entry a size class: bounded however many classes hold v
    sizes = values.groupBy("v", _size_class(F.col("n")).alias("z")).agg(F.count("*").alias("c")).groupBy("v").agg(
        F.collect_list(F.struct("z", "c")).alias("zs"), F.sum("c").alias("df")).where("df > 1")
    near = lambda x: F.aggregate(F.filter("zs", lambda y: F.abs(y.z - x.z) <= reach), F.lit(0).cast("long"), lambda t, y: t + y.c)
    met = F.filter("zs", lambda x: near(x) > 1)
    return sizes.select("v", F.explode(met).alias("x"), "df").select("v", F.col("x.z").alias("z"), "df")


def _with_shared(scratch: Scratch, values: DataFrame, percent: int) -> DataFrame:
    shared = scratch.save(_shared(values, percent))
    scratch.release()
    return values.withColumn("z", _size_class(F.col("n"))).join(shared, ["v", "z"])


def _postings(scratch: Scratch, classes: DataFrame, k: int, coarse: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The classes that can have a partner, and (v, id, n, central, share): the rarest retained values of each class that
    others retain too; central grows with how many others retain its values.
    As many as make a pair share at least `share` of them, whatever its sizes."""
    few = classes.select("id", "n", F.explode(F.slice("sketch", 1, coarse)).alias("v"))
    own = F.least("n", F.lit(coarse)) - F.col("common")
    able = scratch.save(_with_shared(scratch, few, percent).groupBy("id").agg(F.first("n").alias("n"), F.count("*").alias("common"))
                        .where(own <= _unlike(F.col("n"), coarse, percent)).select("id"))
    every, classes = classes, scratch.save(classes.join(able, "id", "left_semi").select("id", "n", "sketch"))
    # most classes end here, and so do the shuffles of their values
    scratch.drop(every, able)
    scratch.release()
    values = classes.select("id", "n", F.explode("sketch").alias("v"))
    shared = _with_shared(scratch, values, percent)
    # values nobody else retains are the rarest: they fill the prefix first
    kept = shared.groupBy("id").agg(F.first("n").alias("n"), F.sum("df").alias("central"), F.sort_array(F.collect_list(F.struct("df", "v"))).alias("vs"))
    take = _unlike(F.col("n"), k, percent) + SHARED - (F.least("n", F.lit(k)) - F.size("vs"))
    # a partner has percent * n shingles at least, and shares percent of them
    share = F.least(F.lit(SHARED), F.ceil(F.col("n") * (percent * percent) / 10_000)).cast("int")
    out = scratch.save(kept.where(take >= share).select("id", "n", "central", share.alias("share"), F.explode(F.slice("vs", F.lit(1), take.cast("int"))).alias("x"))
                       .select(F.col("x.v").alias("v"), "id", "n", "central", "share"))
    scratch.release()
    return classes, out


def _may_be_alike(sa: Column, sb: Column, na: Column, nb: Column, k: int, percent: int) -> Column:
    """By the sizes and the values that both sketches hold; exact where they hold both sets whole."""
    both = F.size(F.array_intersect(sa, sb))
    enough = F.when((na <= k) & (nb <= k), (na + nb).cast("double") * (percent / (100 + percent)) - 1e-6).otherwise(
        _floor_of(k, (na + nb).cast("double") / (1 + percent / 100), percent))
    return (na * 100 >= nb * percent) & (nb * 100 >= na * percent) & (both >= enough)


def _estimated(sa: Column, sb: Column, na: Column, nb: Column, k: int, percent: int) -> Column:
    """By the shared ones among the k smallest values of the union."""
    smallest = F.slice(F.sort_array(F.array_union(sa, sb)), 1, k)
    seen = F.size(F.array_intersect(smallest, F.array_intersect(sa, sb)))
    return ((na <= k) & (nb <= k)) | (seen >= _floor_of(k, (na + nb).cast("double") / (1 + percent / 100), percent))


def _likely(scratch: Scratch, pairs: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b, n): pairs that pass both filters, with the larger size."""
    side = lambda x: classes.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    two = (F.col("sa"), F.col("sb"), F.col("na"), F.col("nb"), k, percent)
    return scratch.save(pairs.join(side("a"), "a").join(side("b"), "b").where(_may_be_alike(*two)).where(_estimated(*two)).select("a", "b", F.greatest("na", "nb").alias("n")))


def _open_lists(scratch: Scratch, open_: DataFrame, deep: int, percent: int) -> DataFrame:
    """(v, id, n, c, rank) for (id, c, set), by sketches of `deep` values, rarest first."""
    values = scratch.save(open_.select("id", "c", F.size("set").cast("long").alias("n"), F.explode(F.slice("set", 1, deep)).alias("v")))
    shared = _with_shared(scratch, values, percent)
    kept = shared.groupBy("id").agg(F.first("n").alias("n"), F.first("c").alias("c"), F.sort_array(F.collect_list(F.struct("df", "v"))).alias("vs"))
    own = F.least("n", F.lit(deep)) - F.size("vs")
    take = _unlike(F.col("n"), deep, percent) + 1 - own
    ranked = kept.where(take > 0).select("id", "n", "c", own.alias("own"), F.posexplode(F.slice("vs", F.lit(1), take.cast("int"))).alias("at", "x"))
    post = scratch.save(ranked.select(F.col("x.v").alias("v"), "id", "n", "c", (F.col("own") + F.col("at") + 1).alias("rank")))
    scratch.drop(values)
    return post


def _sides(post: DataFrame) -> tuple[DataFrame, DataFrame]:
    x, y = (post.select("v", F.col("id").alias(i), F.col("n").alias(f"n{i}"), F.col("c").alias(f"c{i}"), F.col("rank").alias(f"r{i}")) for i in "ab")
    return x, y


def _early(deep: int, percent: int) -> Column:
    """Of two sets held whole the first shared value stands among the first
    n - overlap + 1 of either."""
    overlap = F.ceil((F.col("na") + F.col("nb")) * percent / (100 + percent))
    sizes = (F.col("na") * 100 >= F.col("nb") * percent) & (F.col("nb") * 100 >= F.col("na") * percent)
    return (F.col("ca") != F.col("cb")) & sizes & ((F.greatest("na", "nb") > deep) | ((F.col("ra") <= F.col("na") - overlap + 1) & (F.col("rb") <= F.col("nb") - overlap + 1)))


def _with_leader(post: DataFrame, deep: int, percent: int, seed: int) -> DataFrame:
    """(a, b) of different components: each member of a list with one of it."""
    heads = post.groupBy("v").agg(F.min_by(F.struct("id", "n", "c", "rank"), F.xxhash64("id", "v", F.lit(seed))).alias("x"))
    x = heads.select("v", F.col("x.id").alias("a"), F.col("x.n").alias("na"), F.col("x.c").alias("ca"), F.col("x.rank").alias("ra"))
    return _sides(post)[1].join(x, "v").where(_early(deep, percent)).select("a", "b").distinct()


def _across(post: DataFrame, deep: int, percent: int) -> DataFrame:
    """(a, b) of different components: all pairs that a list may still link."""
    x, y = _sides(post)
    return x.join(y, "v").where(F.col("a") < F.col("b")).where(_early(deep, percent)).select("a", "b").distinct()


def _alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    inter = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * inter >= percent * (len(x) + len(y) - inter)


def _verifier(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, bases, met = None, {}, False
        for batch in batches:
            a_, b_ = [], []
            for a, b, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                s = x.values.to_numpy()
                if b is None:
                    # an id of several texts leads with each of them
                    if met or a != leader:
                        leader, bases, met = a, {}, False
                    bases.setdefault(xxhash.xxh3_128_digest(s.tobytes()), s)
                    continue
                assert a == leader
                met = True
                if any(_alike(base, s, percent) for base in bases.values()):
                    a_.append(a)
                    b_.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(a_, pa.int64()), pa.array(b_, pa.int64())], names=["a", "b"])
    return run


def _setter(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingle_set(t.as_py(), width) for t in part.column(1)], pa.list_(pa.int64()))], names=["id", "set"])
    return run


def _among(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose id is one of ids, and a few others: ids are marked in a
    table of MARKS hashed places, of one size however many there are."""
    place = lambda c: F.xxhash64(c).bitwiseAND(F.lit(MARKS - 1))
    word = lambda c: F.shiftright(place(c), 6).cast("int")
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), place(c).bitwiseAND(F.lit(63)).cast("int"))
    marked = ids.groupBy(word("id").alias("w")).agg(F.bit_or(bit("id")).alias("b"))
    whole = rows.sparkSession.range(MARKS >> 6).select(F.col("id").cast("int").alias("w")).join(marked, "w", "left")
    table = whole.agg(F.sort_array(F.collect_list(F.struct("w", F.coalesce("b", F.lit(0).cast("long")).alias("b")))).alias("x")).select(F.col("x.b").alias("marks"))
    seen = F.get("marks", word("id")).bitwiseAND(bit("id")) != 0
    return rows.join(F.broadcast(table), seen, "left_semi")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int, per_block: int = 64) -> DataFrame:
    """Links of which the full sets agree.  A leader's set is sent once to
    each block of at most about `per_block` partners and compared there as the
    partners stream by; no leader's partners have to meet in one task."""
    block = F.pmod(F.xxhash64("b"), F.greatest(F.lit(1), F.ceil(F.col("m") / per_block)))
    sizes = pairs.groupBy("a").agg(F.count("*").alias("m"))
    dealt = pairs.join(sizes, "a").select("a", "b", block.alias("s"))
    left = dealt.select("a", "s").distinct().join(sets.withColumnRenamed("id", "a"), "a").select("a", "s", F.lit(None).cast("long").alias("b"), "set")
    right = dealt.join(sets.withColumnRenamed("id", "b"), "b").select("a", "s", "b", "set")
    n = n_parts(pairs.sparkSession)
    rows = left.unionByName(right).repartition(n, "a", "s").sortWithinPartitions("a", "s", F.col("b").asc_nulls_first())
    return rows.select("a", "b", "set").mapInArrow(_verifier(percent), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5,
                    percent: int = 80, k: int = RETAINED, coarse: int = COARSE, deep: int = DEEP) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Null or blank texts have no shingles and are linked with nothing.  Repeated
    ids are treated as one document's rows: each row is returned, and their
    links meet in that id.  Null ids are returned with a null component and kept.
    An empty table gives an empty result.  Other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    all_ = scratch.save(sketches(docs, id_col, text_col, width, k))
    classes = scratch.save(all_.where("id is not null and n > 0").groupBy("n", "s1", "s2").agg(F.min("id").alias("id"), F.min("sketch").alias("sketch")))
    sk = scratch.save(all_.drop("sketch"))
    scratch.drop(all_)
    scratch.release()
    known = sk.where("id is not null and n > 0")
    reps = scratch.save(classes.drop("sketch"))
    able, lists = _postings(scratch, classes, k, coarse, percent)  # drops classes
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("t"))

    def sets_of(ids: DataFrame) -> DataFrame:
        # one way at every size: an exchange of the texts, without most of those nobody asked for
        ids = scratch.save(ids)
        out = scratch.save(_among(texts, ids).join(ids.hint("merge"), "id").mapInArrow(_setter(width), "id long, set array<long>"))
        scratch.release()
        return out

    heads = scratch.save(lists.groupBy("v").agg(F.count("*").alias("m"), F.max_by("id", F.struct("central", -F.col("id"))).alias("a")).where("m > 1"))
    headed = scratch.save(lists.join(heads, "v"))
    large = headed.where(F.col("m") > SMALL)
    # of `share` common values half are in small lists, or more than half in large ones
    few = headed.where(F.col("m") <= SMALL).select("v", "id", "share")
    x, y = (few.select("v", F.col("id").alias(i), F.col("share").alias(f"k{i}")) for i in "ab")
    pairs = x.join(y, "v").where("a < b").groupBy("a", "b").agg(F.count("*").alias("c"), F.least(F.first("ka"), F.first("kb")).alias("share")).where("2 * c >= share").select("a", "b")
    star = large.where("a <> id").select("a", F.col("id").alias("b")).distinct()
    likely = _likely(scratch, pairs.unionByName(star), able, k, percent)
    scratch.drop(able)
    scratch.release()
    # sketches that hold both sets whole have compared them already
    far = likely.where(F.col("n") > k).select("a", "b")
    sets = sets_of(far.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    links = likely.where(F.col("n") <= k).select("a", "b").unionByName(scratch.save(_verified(far, sets, percent)))
    scratch.drop(sets)
    scratch.release()
    comp = scratch.save(connected_components(scratch, links))
    # what is left: members of large lists in different components
    placed = large.join(comp.withColumnRenamed("node", "id"), "id", "left").select("v", "id", "share", F.coalesce("component", "id").alias("c"))
    mixed = placed.groupBy("v").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("v")
    left = scratch.save(placed.join(scratch.save(mixed), "v").groupBy("id").agg(F.first("c").alias("c"), F.count("*").alias("k"), F.first("share").alias("share")).where("2 * k > share").select("id", "c"))
    scratch.drop(lists, headed)
    sets = sets_of(left.select("id"))
    post = _open_lists(scratch, left.join(sets, "id"), deep, percent)
    for step in (*range(ROUNDS), None):
        pairs = scratch.save(_across(post, deep, percent) if step is None else _with_leader(post, deep, percent, step))
        # deep sketches hold these sets whole or nearly so: only the full sets tell more
        more = scratch.save(_verified(pairs, sets, percent))
        scratch.release()
        comp = scratch.save(connected_components(scratch, comp.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)))
        if step is not None:
            post = scratch.save(post.join(comp.withColumnRenamed("node", "id"), "id", "left").select("v", "id", "n", F.coalesce("component", "c").alias("c"), "rank"))
    scratch.drop(sets)
    member = known.join(reps.select("n", "s1", "s2", F.col("id").alias("rep")), ["n", "s1", "s2"]).select("id", "n", "s1", "s2", "rep")
    alone = sk.where("id is null or n = 0").select("id", "n", "s1", "s2", F.col("id").alias("rep"))
    rows = member.unionByName(alone).join(comp.select(F.col("node").alias("rep"), "component"), "rep", "left")
    cid = F.coalesce("component", "rep")
    return rows.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), cid.alias("component_id"), F.coalesce(F.col("id") == cid, F.lit(True)).alias("kept"))
