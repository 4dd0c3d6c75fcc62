"""Exact top-k by inner product over vector-approximation files.

Vectors are integers, floor(1024 * x) of each component.  The approximation of a
vector is one cell number per dimension on an equal grid between that dimension's
smallest and largest value.  Blocks of vectors meet blocks of queries: the cells
alone give a lower and an upper bound of every score; the k-th best lower bound is
a floor that each hit must reach; then the exact vectors are read in the order of
their upper bounds, until the k-th best exact score is above the next bound.  The
blocks' hits, k per query and block, are merged per query.

The queries are a stated set against all rows, in blocks: a block of queries is
copied to each block of vectors, so the number of block pairs is the product of
the two numbers of blocks; nothing is collected, and memory is bounded by a block.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gatherlens.llm.common import staged

SCALE, K, CELLS = 1024, 10, 16
BLOCK_ROWS, QUERY_ROWS = 8192, 256
EXACT = float(1 << 53)
LONG = (1 << 63) - 1


def _quantised(batches):
    """Rows (v_id, dim, vec): the integers as doubles, which hold them exactly."""
    for batch in batches:
        ids, dims, vecs = [], [], []
        for i, v in zip(batch.column(0).to_pylist(), batch.column(1)):
            x = None if i is None or not v.is_valid else v.values.to_numpy(zero_copy_only=False).astype(np.float64)
            if x is None or not len(x) or v.values.null_count or not np.isfinite(x).all():
                continue
            with np.errstate(over="ignore"):
                q = np.floor(SCALE * x)
            if np.abs(q).max() < LONG:
                ids.append(i)
                dims.append(len(q))
                vecs.append(q.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()),
                                          pa.array(vecs, pa.binary())], names=["v_id", "dim", "vec"])


def _edges(batches):
    """Smallest and largest value of each dimension in a partition."""
    low, high = {}, {}
    for batch in batches:
        for d, v in zip(batch.column("dim").to_pylist(), batch.column("vec").to_pylist()):
            x = np.frombuffer(v)
            low[d] = np.minimum(low[d], x) if d in low else x
            high[d] = np.maximum(high[d], x) if d in high else x
    for d in low:
        yield pa.RecordBatch.from_pydict({"dim": pa.array([d] * d, pa.int32()), "axis": pa.array(range(d), pa.int32()),
                                          "lo": pa.array(low[d]), "hi": pa.array(high[d])})


def exact_dot(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of ``q`` and ``v``; beyond a long they
    saturate."""
    most = np.abs(q).max(initial=0) * np.abs(v).max(initial=0) * q.shape[1]
    if most < EXACT:
        return (q @ v.T).astype(np.int64)
    ints = [[int(x) for x in row] for row in v.tolist()]
    out = [[max(-LONG - 1, min(LONG, sum(int(a) * b for a, b in zip(row, w)))) for w in ints] for row in q.tolist()]
    return np.array(out, dtype=np.int64).reshape(len(q), len(v))


def search_block(q_ids, q, v_ids, v, cells, lo, step, k):
    """Hits (query, vec, score) of one block: at least all those among the k best of
    each query within the block, ties to the smaller id."""
    lower = lo + cells * step
    upper = lower + step
    pos, neg = np.maximum(q, 0), np.minimum(q, 0)
    ub, lb = pos @ upper.T + neg @ lower.T, pos @ lower.T + neg @ upper.T
    # Rounding of the bounds themselves (not of the scores) is covered by a margin.
    margin = 1e-9 * (np.abs(ub).max(initial=0) + np.abs(lb).max(initial=0) + 1)
    out = []
    for j in range(len(q_ids)):
        other = np.flatnonzero(v_ids != q_ids[j])
        if not len(other):
            continue
        floor = -np.inf if len(other) <= k else np.partition(lb[j, other], -k)[-k] - margin
        wanted = other[ub[j, other] >= floor - margin]
        wanted = wanted[np.argsort(-ub[j, wanted], kind="stable")]
        ids, scores, at, size = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, 4 * k
        while at < len(wanted):
            if len(scores) >= k and scores[-1] > ub[j, wanted[at]] + margin:
                break
            some = wanted[at:at + size]
            ids = np.concatenate([ids, v_ids[some]])
            scores = np.concatenate([scores, exact_dot(q[j:j + 1], v[some])[0]])
            best = np.lexsort((ids, -scores))[:k]
            ids, scores, at = ids[best], scores[best], at + size
        out.append(pd.DataFrame({"query_id": q_ids[j], "vec_id": ids, "score": scores}))
    return out


def _search(k):
    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                d, lo, hi = r["dim"], np.array(r["lo"]), np.array(r["hi"])
                step = np.maximum((hi - lo) / CELLS, 1e-9)
                v = np.frombuffer(b"".join(r["vecs"])).reshape(-1, d)
                q = np.frombuffer(b"".join(r["q_vecs"])).reshape(-1, d)
                cells = np.frombuffer(b"".join(r["cells"]), np.uint8).reshape(-1, d)
                hits = search_block(np.array(r["q_ids"]), q, np.array(r["ids"]), v, cells, lo, step, k)
                if hits:
                    yield pa.RecordBatch.from_pandas(pd.concat(hits), preserve_index=False)
    return run


def _cells(batches):
    """Adds the approximation: one cell number per dimension."""
    for batch in batches:
        cells = []
        for v, lo, hi in zip(batch.column("vec").to_pylist(), batch.column("lo").to_pylist(),
                             batch.column("hi").to_pylist()):
            low = np.array(lo)
            step = np.maximum((np.array(hi) - low) / CELLS, 1e-9)
            cells.append(np.clip(np.floor((np.frombuffer(v) - low) / step), 0, CELLS - 1).astype(np.uint8).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("v_id"), batch.column("dim"), batch.column("vec"),
                                          pa.array(cells, pa.binary())], names=["v_id", "dim", "vec", "cells"])


def top_k(vectors: DataFrame, id_col: str, vec_col: str, is_query, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best rows for each row for which the
    column expression ``is_query`` (over ``v_id``) holds, its own id excepted.

    Rows with a null id, and vectors that are null, empty or hold null or non-finite
    components (or one beyond a long once scaled), take no part; scores beyond a long
    saturate; vectors of another length than the query's aren't
    compared with it.  Repeated ids are all candidates, a repeated query is asked
    once per distinct vector and keeps the k best of all.  Ties go to the smaller id.
    """
    spark = vectors.sparkSession
    quant = staged(vectors.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{vec_col}`").cast("array<double>"))
                   .mapInArrow(_quantised, "v_id long, dim int, vec binary"), "vectors")
    edges = quant.mapInArrow(_edges, "dim int, axis int, lo double, hi double").groupBy("dim", "axis").agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    # One row per vector length; a row is as long as a vector.
    edges = edges.groupBy("dim").agg(F.array_sort(F.collect_list(F.struct("axis", "lo", "hi"))).alias("e")).select(
        "dim", F.col("e.lo").alias("lo"), F.col("e.hi").alias("hi"))
    edges = staged(edges, "vector-edges")
    approx = staged(quant.join(edges, "dim").select("v_id", "dim", "vec", "lo", "hi").mapInArrow(
        _cells, "v_id long, dim int, vec binary, cells binary"), "vector-cells")

    def blocks(df, rows, *cols):
        n = df.count()
        number = max(1, -(-n // rows))
        return number, df.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(number))).groupBy(
            "dim", "block").agg(*[F.collect_list(c).alias(a) for c, a in cols])

    # Rows are dealt to blocks by their place in the staged table, so no block is hot.
    n_blocks, v = blocks(approx, BLOCK_ROWS, ("v_id", "ids"), ("vec", "vecs"), ("cells", "cells"))
    asked = staged(quant.where(is_query).dropDuplicates(["v_id", "vec"]), "queries")
    _, q = blocks(asked, QUERY_ROWS, ("v_id", "q_ids"), ("vec", "q_vecs"))
    q = staged(q, "query-blocks").select("dim", "q_ids", "q_vecs", F.explode(
        F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))).alias("block"))
    pairs = q.join(v.join(edges, "dim"), ["dim", "block"]).select(
        "dim", "q_ids", "q_vecs", "ids", "vecs", "cells", "lo", "hi")
    hits = pairs.mapInArrow(_search(k), "query_id long, vec_id long, score long")
    ranked = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return hits.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
