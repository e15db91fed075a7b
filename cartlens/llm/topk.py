"""Exact top-k search with segment statistics at several resolutions.

Vectors are cut into equal segments. From the means m and deviations s of two vectors' segments of length l,
sum l * ((m1 - m2)^2 + (s1 - s2)^2) is a lower bound of their squared distance, and so
(|q|^2 + |v|^2 - bound) / 2 an upper bound of their inner product. Bounds go from coarse to fine; a candidate whose
bound falls below the k-th best score known for the query is out, and only survivors get exact scores. Nothing is approximate.

Queries are a stated set, compared with all rows in tiles: QUERY_BLOCK queries by CANDIDATE_BLOCK rows. Block numbers come
from row numbers, so no value of the data makes a block large. Each tile returns k rows per query.

Cases: rows whose id or vector is null, or whose vector holds a null or a non-finite component, take no part; vectors of different
length are not compared; an empty vector scores 0 with other empty ones; equal scores go to the smaller id; rows that repeat an
id are rows of their own (a query leaves out only its own row); an empty table gives an empty one; other columns are not
read. Components whose products could exceed 63 bits raise an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartlens.llm.storage import kept

QUERY_BLOCK = 1024
CANDIDATE_BLOCK = 8192
# Numbers of segments, coarse to fine.
RESOLUTIONS = (4, 16)
# Queries whose bounds are held at once.
ROWS = 64


def usable(vector: str) -> Column:
    """Vectors without null and non-finite components."""
    return F.col(vector).isNotNull() & ~F.exists(
        vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    )


def segment_statistics(vectors: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of all segments, scaled so that plain squared differences give the bound."""
    d = vectors.shape[1]
    cuts = np.linspace(0, d, min(segments, d) + 1).astype(int)
    found = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        part = vectors[:, a:b]
        found += [part.mean(axis=1) * np.sqrt(b - a), part.std(axis=1) * np.sqrt(b - a)]
    return np.stack(found, axis=1) if found else np.zeros((len(vectors), 0))


def search(queries: np.ndarray, own: np.ndarray, vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int):
    """For each query its k best rows: query places, row places and scores. `own` and `rows` number the rows; a query skips its own."""
    d = queries.shape[1]
    most = lambda x: int(np.abs(x).max()) if x.size else 0
    if most(queries) * most(vectors) * max(d, 1) >= 1 << 63:
        raise ValueError("inner products do not fit into 63 bits")
    exact = queries.astype(np.int64), vectors.astype(np.int64)
    plain = most(queries) * most(vectors) * max(d, 1) < 1 << 53
    if plain:
        # Whole numbers below 2^53 and their sums are exact as doubles.
        exact = queries.astype(np.float64), vectors.astype(np.float64)
    q, v = queries.astype(np.float64), vectors.astype(np.float64)
    q2, v2 = (q * q).sum(axis=1), (v * v).sum(axis=1)
    levels = [(segment_statistics(q, s), segment_statistics(v, s)) for s in RESOLUTIONS]
    squares = [((a * a).sum(axis=1), (b * b).sum(axis=1)) for a, b in levels]
    slack = 1e-9 * (q2.max(initial=0) + v2.max(initial=0)) + 1e-6
    found = []
    for start in range(0, len(q), ROWS):
        block = slice(start, min(start + ROWS, len(q)))
        skip = own[block, None] == rows[None, :]
        (a, b), (a2, b2) = levels[0], squares[0]
        bound = a2[block, None] + b2[None, :] - 2 * (a[block] @ b.T)
        bound = (q2[block, None] + v2[None, :] - bound) / 2 + slack
        bound[skip] = -np.inf
        # The k rows with the best bounds give a score that k rows reach.
        first = np.argpartition(-bound, min(k, bound.shape[1]) - 1, axis=1)[:, :k]
        scores = np.einsum("ijk,ik->ij", exact[1][first], exact[0][block])
        lone = np.take_along_axis(bound, first, 1) == -np.inf
        reached = np.where(lone, -np.inf, scores.astype(np.float64)).min(axis=1) - slack
        if bound.shape[1] < k:
            reached[:] = -np.inf
        at, to = np.nonzero((bound >= reached[:, None]) & ~skip)
        for (a, b), (a2, b2) in zip(levels[1:], squares[1:], strict=True):
            keep = np.empty(len(at), bool)
            for c in range(0, len(at), 1 << 16):
                i, j = at[c : c + (1 << 16)] + start, to[c : c + (1 << 16)]
                finer = a2[i] + b2[j] - 2 * np.einsum("ij,ij->i", a[i], b[j])
                keep[c : c + (1 << 16)] = (q2[i] + v2[j] - finer) / 2 + slack >= reached[i - start]
            at, to = at[keep], to[keep]
        score = np.empty(len(at), np.int64)
        for c in range(0, len(at), 1 << 16):
            i, j = at[c : c + (1 << 16)] + start, to[c : c + (1 << 16)]
            score[c : c + (1 << 16)] = np.einsum("ij,ij->i", exact[0][i], exact[1][j])
        order = np.lexsort((rows[to], ids[to], -score, at))
        at, to, score = at[order], to[order], score[order]
        best = np.arange(len(at)) - np.searchsorted(at, at) < k
        found.append((at[best] + start, to[best], score[best]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) and len(flat) else np.zeros((len(column), 0), np.int64)


def top_k(table: DataFrame, id_column: str, vector_column: str, is_query: Column, k: int = 10, scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id and score: the k rows with the largest inner products of floor(scale * component) for each query row."""
    rows = kept(
        table.select(F.col(id_column).cast("bigint").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("v"), is_query.alias("q"))
        .where(F.col("vec_id").isNotNull() & usable("v"))
        .select(
            F.monotonically_increasing_id().alias("row"),
            "vec_id",
            F.coalesce("q", F.lit(False)).alias("q"),
            F.transform("v", lambda x: F.floor(x * scale)).alias("v"),
            F.size("v").alias("d"),
        ),
        "vectors",
    )
    n, asked = rows.agg(F.count("*"), F.count_if("q")).first()
    blocks, q_blocks = max(1, -(-n // CANDIDATE_BLOCK)), max(1, -(-asked // QUERY_BLOCK))
    number = lambda of: F.expr(f"cast(pmod(xxhash64(row), {of}) as int)")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    queries = rows.where("q").select("row", "vec_id", "v", "d", number(q_blocks).alias("qb"), every(blocks).alias("cb"))
    candidates = rows.select("row", "vec_id", "v", "d", number(blocks).alias("cb"), every(q_blocks).alias("qb"))

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.combine_chunks(), right.combine_chunks()
        if not left.num_rows or not right.num_rows:
            return pa.table({"row": [], "query_id": [], "vec_id": [], "score": []}, schema=out)
        get = lambda t, c: t.column(c).to_numpy()
        one = lambda t: _matrix(pa.concat_arrays(t.column("v").chunks))
        ids = get(right, "vec_id")
        i, j, score = search(one(left), get(left, "row"), one(right), ids, get(right, "row"), k)
        return pa.table({"row": get(left, "row")[i], "query_id": get(left, "vec_id")[i], "vec_id": ids[j], "score": score}, schema=out)

    out = pa.schema([(c, pa.int64()) for c in ("row", "query_id", "vec_id", "score")])
    keys = ["qb", "cb", "d"]
    best = queries.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInArrow(
        tile, "row bigint, query_id bigint, vec_id bigint, score bigint"
    )
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
