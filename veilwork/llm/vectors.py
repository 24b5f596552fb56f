"""Vectors dealt into blocks, and the merge of what each block found."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK_ROWS = 8192


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v): rows with an id and a vector of finite components."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    ok = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(F.coalesce(ok, F.lit(False)))


def matrix(column: pa.ChunkedArray, width: int | None = None) -> np.ndarray:
    """Rows of components; shorter vectors are as if filled with zeros."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.diff(arr.offsets.to_numpy())
    width = max(width or 0, int(size.max(initial=0)))
    flat = arr.flatten().to_numpy(zero_copy_only=False)
    if len(size) and (size == width).all():
        return flat.reshape(len(size), width).astype(np.float64)
    out = np.zeros((len(size), width))
    ends = np.cumsum(size)
    for i, (a, n) in enumerate(zip((ends - size).tolist(), size.tolist(), strict=True)):
        out[i, :n] = flat[a:a + n]
    return out


def searched_in_blocks(queries: DataFrame, rows: DataFrame, search, score_type: str, k: int, block_rows: int = BLOCK_ROWS, query_rows: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: the best k over all blocks.

    Every vector is in one data block by its hash, each of about `block_rows`;
    query blocks of about `query_rows` visit every data block, where one index
    is built and searched.  A task holds one block of either kind.  `search`
    gets (data ids, data, query ids, queries) and returns (query id, id, score)
    arrays with up to k rows for each query.
    """
    n, q = rows.count(), queries.count()
    blocks, groups = max(1, -(-n // block_rows)), max(1, -(-q // query_rows))
    data = rows.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"), "id", "v")
    asked = queries.select(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(groups)).alias("group"), "id", "v")
    # the stated query set against all rows, in blocks
    spread = data.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))) if groups > 1 else data.withColumn("group", F.lit(0))
    visits = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    spread = spread.select(F.col("block").cast("long"), F.col("group").cast("long"), "id", "v")
    visits = visits.select(F.col("block").cast("long"), F.col("group").cast("long"), "id", "v")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            a = b = np.zeros(0, np.int64)
            s = np.zeros(0)
        else:
            d = matrix(left["v"])
            e = matrix(right["v"], d.shape[1])
            if e.shape[1] > d.shape[1]:
                d = np.pad(d, ((0, 0), (0, e.shape[1] - d.shape[1])))
            a, b, s = search(left["id"].to_numpy(), d, right["id"].to_numpy(), e)
        return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(s, pa.int64() if score_type == "long" else pa.float64())})

    found = spread.groupBy("block", "group").cogroup(visits.groupBy("block", "group")).applyInArrow(run, f"query_id long, vec_id long, score {score_type}")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
