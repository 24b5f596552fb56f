import hashlib
import importlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilwork.llm import ann, cover_tree
from veilwork.llm.deep_shallow import deep_shallow
from veilwork.llm.line_dedup import dedup_lines
from veilwork.llm.near_dup import near_duplicates
from veilwork.llm.packing import default_tokenizer, pack_documents, sum_of_squares
from veilwork.llm.repeats import without_repeats
from veilwork.llm.sentencepiece_codec import Codec, decoded, default_model, encoded
from veilwork.llm.sharding import best_fit_decreasing, shard_documents
from veilwork.llm.toxicity import score
from veilwork.llm.url_filter import judge

SCHEMA = "doc_id long, text string, lang string, score double, id string"


def frame(spark, rows):
    """Documents with further columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, "en", 0.0, "x") for i, t in rows], SCHEMA)


def words(rng, n):
    return " ".join(rng.choice(["ba", "ke", "lo", "mi", "nu", "po"]) + rng.choice("aeiou") * rng.randint(1, 3) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    base = [words(rng, rng.randint(1, 300)) for _ in range(40)]
    passage = words(rng, 90)
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, base[i]) for i in range(5)]
    rows += [(200 + i, " ".join(w if rng.random() > 0.03 else "zz" for w in base[5].split(" "))) for i in range(30)]
    rows += [(300 + i, f"{words(rng, 20)} {passage} {words(rng, 20)}") for i in range(40)]
    return rows + [(400, None), (401, ""), (402, " \n\t"), (403, "é" * 500), (404, "aaaaaaaa" * 60), (405, "one"), (None, "one two"), (0, base[0]), (406, words(rng, 20_000))]


EDGE = {
    "near": lambda d: near_duplicates(d), "lines": lambda d: dedup_lines(d), "repeats": lambda d: without_repeats(d), "shards": lambda d: shard_documents(d),
    "pack": lambda d: pack_documents(d), "pieces": lambda d: encoded(d),
    "toxicity": lambda d: score(d, d.sparkSession.createDataFrame([], "doc_id long, quality int, toxic int")),
    "urls": lambda d: judge(d.select(F.col("doc_id").alias("page_id"), F.col("text").alias("url"), F.lit("h").alias("host"), F.lit("p").alias("verdict"))),
}


@pytest.mark.parametrize("name", EDGE)
def test_empty_and_odd_rows(spark, name, corpus):
    assert EDGE[name](frame(spark, [])).count() == 0
    odd = [r for r in corpus if r[0] is None or r[0] >= 400 or r[0] == 0]
    assert EDGE[name](frame(spark, odd)).count() >= len(odd)


def test_near_duplicates(spark, corpus):
    got = near_duplicates(frame(spark, corpus), width=2).collect()
    sets = {}
    for i, t in corpus:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k:k + 2]) for k in range(max(1, len(w) - 1))} if w else set()
    up = {i: i for i in sets if i is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    ids = sorted(up)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is not None} == {(i, len(sets[i]), root(i), root(i) == i) for i in ids}


@pytest.mark.parametrize("hot", [32, 1])
def test_repeats(spark, corpus, hot):
    rows = [r for r in corpus if r[0] is not None]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in without_repeats(frame(spark, rows), hot=hot).collect()}
    seen = {}
    for _, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - 199):
            seen[b[p:p + 200]] = seen.get(b[p:p + 200], 0) + 1
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 199):
            if seen[b[p:p + 200]] > 1:
                gone[p:p + 200] = b"\1" * 200
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        runs = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        assert got[i] == (len(b), len(b) - len(kept), runs, hashlib.sha256(kept).hexdigest()), i


@pytest.mark.parametrize("hot", [32, 1])
def test_repeats_of_odd_ids(spark, hot):
    """Rows without an id, of id -1 and of one id with two texts are documents like others."""
    rng = np.random.default_rng(5)
    words = lambda n: " ".join("".join(map(chr, rng.integers(97, 123, 6))) for _ in range(n))
    passage, own = words(60), words(60)
    rows = [(None, words(40) + passage + words(40)), (5, words(50) + passage + words(30)), (-1, words(5) + passage), (6, own), (6, words(70)), (7, words(9)), (None, None)]
    got = {(r.doc_id, r.n_bytes): r.n_removed for r in without_repeats(frame(spark, rows), hot=hot).collect()}
    assert got == {(i, len(t or "")): len(passage) if passage in (t or "") else 0 for i, t in rows}
    twice = without_repeats(frame(spark, [(6, own)] * 2 + [(None, passage)] * 2), hot=hot).collect()
    assert len(twice) == 4 and all(r.n_removed == r.n_bytes for r in twice)


@pytest.mark.parametrize("conf", [{"autoBroadcastJoinThreshold": "512"}, {
    "autoBroadcastJoinThreshold": "-1", "adaptive.advisoryPartitionSizeInBytes": "4k", "adaptive.skewJoin.skewedPartitionThresholdInBytes": "8k", "adaptive.skewJoin.skewedPartitionFactor": "0"}])
def test_repeats_under_any_join(spark, conf):
    """A group's domains meet in one task however Spark joins, splits and reads the tables before."""
    rng = np.random.default_rng(8)
    words = lambda n: " ".join("".join(map(chr, rng.integers(97, 123, 6))) for _ in range(n))
    passages = [words(60) for _ in range(200)]
    rows = [(3 * i + k, f"{words(40)}{k}{p}{k}{words(40)}") for k in range(3) for i, p in enumerate(passages)]
    rows += [(600 + i, f"{words(9)}{chr(65 + i)}{passages[0]}{chr(65 + i)}{words(9)}") for i in range(50)]
    session = spark.newSession()  # settings of its own
    for k, v in {"shuffle.partitions": "4", "adaptive.coalescePartitions.enabled": "false", **conf}.items():
        session.conf.set(f"spark.sql.{k}", v)
    got = {r.doc_id: r.n_removed for r in without_repeats(frame(session, rows)).collect()}
    assert got == {i: len(passages[0]) for i, _ in rows}


def test_deep_shallow_sort():
    rng = random.Random(1)
    for known in (0, 3):
        for _ in range(60):
            s = [b"xyz"[:known] + bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 60))) for _ in range(rng.randint(1, 40))]
            order, adjacent = deep_shallow(s, known, shallow=rng.choice([0, 2, 24]))
            assert [s[i] for i in order] == sorted(s)
            for k, n in enumerate(adjacent):
                a, b = s[order[k]], s[order[k + 1]]
                assert n == next((j for j in range(min(len(a), len(b))) if a[j] != b[j]), min(len(a), len(b)))


def test_line_runs(spark):
    rows = [(2, "a\nb\nc\nonly"), (1, "x\na\n\nb\ny"), (3, "a\nc"), (4, "b\nc\nq\nb\nc"), (5, None)]
    got = {r.doc_id: (r.n_lines, r.n_removed, r.n_runs, r.kept) for r in dedup_lines(frame(spark, rows)).collect()}
    assert got == {1: (4, 0, 0, "x\na\n\nb\ny"), 2: (4, 2, 1, "c\nonly"), 3: (2, 0, 0, "a\nc"), 4: (5, 4, 2, "q"), 5: (0, 0, 0, None)}
    three = {r.doc_id: r.n_removed for r in dedup_lines(frame(spark, [(1, "a\nb\nc\nd"), (2, "b\nc\nd\na"), (3, "a\nb")]), min_lines=3).collect()}
    assert three == {1: 0, 2: 3, 3: 0}


@pytest.mark.parametrize("min_lines", [2, 3, 5])
def test_line_runs_by_brute_force(spark, min_lines):
    rng = random.Random(min_lines)
    block = [rng.choice("abcdefgh") * 2 for _ in range(40)]
    rows = [(i, [rng.choice("abcd") for _ in range(rng.randint(0, 25))]) for i in range(30)]
    rows += [(100 + i, [*rows[i][1][:5], *block[i:i + rng.randint(3, 30)], "z"]) for i in range(8)] + [(200, block), (201, block)]
    seen, want = set(), {}
    for i, lines in sorted(rows):
        gone = set()
        for p in range(len(lines) - min_lines + 1):
            k = tuple(lines[p:p + min_lines])
            gone |= set(range(p, p + min_lines)) if k in seen else set()
            seen.add(k)
        want[i] = (len(lines), len(gone), sum(p - 1 not in gone for p in gone), "\n".join(x for p, x in enumerate(lines) if p not in gone))
    got = dedup_lines(frame(spark, [(i, "\n".join(x)) for i, x in rows]), min_lines=min_lines).collect()
    assert {r.doc_id: (r.n_lines, r.n_removed, r.n_runs, r.kept) for r in got} == want


def test_long_single_lines(spark):
    """Between different neighbours, and where a document is that one line."""
    rng = random.Random(9)
    long, edge = words(rng, 51), words(rng, 50)
    rows = [(1, f"a\n{long}\nb"), (2, f"c\n{long}\nd\n{long}"), (3, long), (4, f"e\n{edge}"), (5, f"f\n{edge}"), (6, "a")]
    got = {r.doc_id: (r.n_lines, r.n_removed, r.n_runs, r.kept) for r in dedup_lines(frame(spark, rows), long_words=50).collect()}
    assert got == {1: (3, 0, 0, rows[0][1]), 2: (4, 2, 2, "c\nd"), 3: (1, 1, 1, ""), 4: (2, 0, 0, rows[3][1]), 5: (2, 0, 0, rows[4][1]), 6: (1, 0, 0, "a")}
    stage = importlib.import_module("corpus_pipeline").line_dedup(spark, frame(spark, rows), "")
    assert {r.doc_id: r.text for r in stage.collect()} == {1: rows[0][1], 2: "c\nd", **dict(rows[3:])}


def test_pipeline_keeps_one_of_repeated_rows(spark, tmp_path):
    """A clean document whose row is repeated comes out once, and so do exact
    copies under no id and texts of one id that has a copy elsewhere."""
    import corpus_pipeline

    rng = np.random.default_rng(7)
    clean = ["".join(" " if rng.random() < 0.15 else chr(rng.integers(97, 123)) for _ in range(400)) for _ in range(6)]
    rows = [(1, clean[0])] * 3 + [(2, clean[1]), (3, clean[2]), (None, clean[3]), (None, clean[3]), (7, clean[4]), (7, clean[2]), (9, clean[4]), (None, clean[5]), (4, clean[5])]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    got = sorted((r.doc_id if r.doc_id is not None else -1, clean.index(r.text)) for r in docs.collect())
    assert got == [(-1, 3), (1, 0), (2, 1), (3, 2), (4, 5), (7, 4)]


def test_toxicity_stage_and_clashing_names(spark, tmp_path):
    """A column of the score's name comes through; empty and null texts stay."""
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = frame(spark, [(1, "ba"), (2, None), (None, ""), (1, "ba")]).withColumn("toxicity_score", F.lit(9)).withColumn("row", F.lit("r")).withColumn("kept", F.lit(1))
    out = corpus_pipeline.toxicity(spark, docs, str(tmp_path))
    assert out.columns == docs.columns and out.count() == 4 and {r.toxicity_score for r in out.collect()} == {9}
    for stage in (corpus_pipeline.line_dedup, corpus_pipeline.suffix_array_dedup):
        assert stage(spark, docs, "").columns == docs.columns


def test_shards(spark, corpus):
    got = shard_documents(frame(spark, corpus), shards=5).collect()
    assert len(got) == len(corpus) and {r.shard for r in got} <= set(range(5))
    load, home = [0] * 5, {}
    for r in got:
        load[r.shard] += r.size
        assert home.setdefault((r.text_crc32, r.size), r.shard) == r.shard
    for s in range(5):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    sizes = [7, 5, 5, 4, 3, 3, 3]
    where = best_fit_decreasing(sizes, 10)
    assert max(where) == 2 and all(sum(s for s, w in zip(sizes, where, strict=True) if w == b) <= 10 for b in range(3))


def test_packing(spark, corpus):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(default_tokenizer())
    tok.encode_special_tokens = True
    rows = [*corpus, (900, "Don't STOP! ÀÉ naïve İstanbul ΣΑΣ 3.14 <|endoftext|> \x1c x"), (901, "x" * 300)]
    got = {}
    fill = {}
    for r in pack_documents(frame(spark, rows)).collect():
        got.setdefault(r.doc_id, []).append(r)
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in fill.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 4096
    for i, t in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for r in got[i]:
            assert r.length == min(4096, len(ids) - r.start) and r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length].tobytes())
    sizes = np.random.default_rng(0).integers(1, 4096, 3000)
    _, _, bins = sum_of_squares(np.sort(sizes)[::-1], 4096)
    assert bins <= 1.03 * math.ceil(sizes.sum() / 4096)


def test_pieces(spark, corpus):
    c = Codec(default_model())
    rows = [*corpus, (900, "  a  b \n c ﬁ 日本語😀 mississippi (((( ")]
    out = encoded(frame(spark, rows), with_ids=True)
    for r in out.collect():
        texts = [t or "" for i, t in rows if i == r.doc_id]
        assert r.ids in [c.sp.encode(t) for t in texts] and r.round_trip
    back = {r.doc_id: r.text for r in decoded(out).collect()}
    assert all(back[i] == (t or "") for i, t in rows)


def vectors(spark):
    rng = np.random.default_rng(0)
    x = np.round(rng.normal(size=(900, 8)), 2)
    x[300:600] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2001, [None] * 8), (2002, [float("nan")] * 8), (2003, [float("inf")] * 8), (2100, [0.0] * 8), (2101, [1e30] * 8), (None, [1.0] * 8), (2102, [1.0])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def test_top_inner_products(spark):
    df = vectors(spark)
    rows = [(r.vec_id, [math.floor(float(x) * 1024) for x in r.embedding] + [0] * (8 - len(r.embedding))) for r in df.where("vec_id is not null and embedding is not null and vec_id not in (2001, 2002, 2003)").collect()]
    want = set()
    for q, v in rows:
        if q % 100 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in rows if i != q)[:10]
            want |= {(q, k + 1, i, max(-(1 << 63), min(-s, (1 << 63) - 1))) for k, (s, i) in enumerate(best)}
    assert {tuple(r) for r in cover_tree.top_inner_products(df).collect()} == want


def test_nearest(spark):
    df = vectors(spark)
    x = {r.vec_id: np.array([float(c) for c in r.embedding] + [0.0] * (8 - len(r.embedding))) for r in df.where("vec_id is not null and embedding is not null and vec_id not in (2001, 2002, 2003, 2100)").collect()}
    got, hit, all_ = {}, 0, 0
    for r in ann.nearest(df).collect():
        got.setdefault(r.query_id, []).append(r)
    for q, rows in got.items():
        rows.sort(key=lambda r: r["rank"])
        want = sorted((-float((x[q] * v).sum() / (np.sqrt((v * v).sum()) * np.sqrt((x[q] * x[q]).sum()))), i) for i, v in x.items() if i != q)[:5]
        hit += len({i for _, i in want} & {r.vec_id for r in rows})
        all_ += 5
        assert [(-r.score, r.vec_id) for r in rows] == sorted((-r.score, r.vec_id) for r in rows)
    assert hit >= 0.9 * all_ and set(got) == {i for i in x if i % 50 == 0}


@pytest.mark.parametrize("n", [2, 40])
def test_repeated_ids_leave_room_for_others(spark, n):
    """Each row n times, a third of all rows with one id: k others are found."""
    x = np.round(np.random.default_rng(2).normal(size=(60, 8)), 2)
    rows = [(i, v.tolist()) for i, v in enumerate(x) for _ in range(n)] + [(0, x[0].tolist())] * (30 * n)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = np.floor(x * 1024)
    ids = np.array([i for i, _ in rows])
    for q in (0, 50):
        score = whole[ids] @ whole[q]
        want = sorted((-s, i) for s, i in zip(score.tolist(), ids.tolist(), strict=True) if i != q)[:10]
        got = sorted(tuple(r) for r in cover_tree.top_inner_products(df, every=50).where(F.col("query_id") == q).collect())
        assert [(-r[3], r[2]) for r in got] == want
        cos = (x[ids] @ x[q]) / (np.sqrt((x[ids] ** 2).sum(1)) * np.sqrt((x[q] ** 2).sum()))
        want = [i for _, i in sorted((-round(s, 9), i) for s, i in zip(cos.tolist(), ids.tolist(), strict=True) if i != q)[:5]]
        assert [r.vec_id for r in ann.nearest(df).where(F.col("query_id") == q).orderBy("rank").collect()] == want


def test_nearest_of_one_vector_held_by_the_query(spark):
    """All rows have one vector, and the query's id holds most of them."""
    rows = [(0, [1.0, 2.0])] * 30 + [(i, [1.0, 2.0]) for i in range(1, 8)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("rank").collect()
    assert [(r.query_id, r.vec_id) for r in got] == [(0, i) for i in range(1, 6)]


def test_toxicity_learns_variants(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(400):
        t, bad = words(rng, 30), i % 2
        if bad:
            t += " " + rng.choice(["grumblefot", "snarkwick"]) + "."
        rows.append((i, t))
        labels.append((i, 1, bad))
    probe = [(1000, "ba ke grumblxefot lo"), (1001, "g r u m b l e f o t"), (1002, "ba ke lo mi nu"), (1003, None), (1004, "snark.wick")]
    out = {r.doc_id: r for r in score(frame(spark, rows + probe), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    held = [r for r in out.values() if r.held_out and r.doc_id < 400]
    assert sum(r.predicted == r.doc_id % 2 for r in held) >= 0.95 * len(held)
    assert [out[i].predicted for i in range(1000, 1005)] == [1, 1, 0, 0, 1]
    assert out[7].held_out == (zlib.crc32(b"7") % 5 == 0)


def test_url_rules(spark):
    rows = [(1, "https://a.Example.org/en/12?x"), (2, "http://org/"), (3, "http://x.org"), (4, "ftp://shop.com/de/#a"), (5, None), (6, "no scheme"), (7, "http://example.org/es/q"), (8, "http://notexample.org/es/")]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[1] == ("a.example.org", "/en/12", "example.org/en/1", "block") and got[2][2:] == ("org/", "allow") and got[3][:3] == ("x.org", "", None)
    assert got[4] == ("shop.com", "/de/", "com/de/", "block") and got[5][:3] == ("", "", None) and got[6][:2] == ("", "")
    assert got[7][2:] == ("example.org/es/", "block") and got[8][2:] == ("org/", "allow")


def test_only_texts_asked_for_are_exchanged(spark):
    """All of them, whatever their ids, and few others."""
    from veilwork.llm.near_dup import _among

    asked = [0, -1, 7, 1 << 62, -(1 << 63), (1 << 63) - 1, *range(10_000, 10_500)]
    rows = spark.createDataFrame([(i, "x") for i in [*asked, *asked[:9], *range(20_000, 30_000), None]], "id long, t string")
    got = [r.id for r in _among(rows, spark.createDataFrame([(i,) for i in asked], "id long")).collect()]
    assert sorted(i for i in got if i in asked) == sorted([*asked, *asked[:9]]) and len(got) < len(asked) + 30
    assert _among(rows, spark.createDataFrame([], "id long")).count() == 0


def test_verifier_compares_each_text_of_a_leading_id():
    import pyarrow as pa

    from veilwork.llm.near_dup import _verifier

    x, y = np.arange(10), np.arange(100, 110)
    rows = [(1, None, x), (1, None, y), (1, 5, y), (1, 6, np.arange(50)), (1, None, x), (1, 7, x), (1, 8, y), (2, None, y), (2, 5, y), (2, 9, x)]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                                        pa.array([r[2] for r in rows], pa.list_(pa.int64()))], names=["a", "b", "set"])
    # a block of one leader starts anew with its own sets
    cut = [batch.slice(0, 3), batch.slice(3, 4), batch.slice(7)]
    got = [p for out in _verifier(80)(iter(cut)) for p in zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True)]
    assert got == [(1, 5), (1, 7), (2, 5)]
