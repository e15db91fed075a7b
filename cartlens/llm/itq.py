"""Near-duplicate vectors: iterative quantisation, multi-index Hamming tables, and a rerank with the original vectors.

1. A rotation for balanced binary codes of BITS bits is learned on a sample of about SAMPLE vectors: principal axes
   of the centred unit vectors, then rounds of signs and an orthogonal Procrustes fit. It is the only thing that is sampled.
2. Each code is cut into TABLES substrings. A vector stands in a table under its own substring (at home) and as a visitor under the
   substrings in which one 0 bit is set, so substrings with at most one differing bit meet, and codes with at most
   2 * TABLES - 1 differing bits meet in some table (others often do, too).
3. Buckets where nothing can meet are dropped by counting codes alone; only then do vectors follow. A bucket of more
   than BLOCK rows is cut into blocks, and each pair of blocks is work of its own.
4. All meetings are reranked with exact cosines in double precision. A pair counts in the first table in which it meets. Tasks return
   counts and a few links that connect what they have linked, never all pairs.

Cases: rows without an id take no part and come back with a null component; null, zero, empty vectors and those with
null or non-finite components, and rows without a label, link with nothing; vectors of different length are not compared; rows
that repeat an id count as one vector if equal (each other row of a linked vector counts); the threshold itself links; an empty
table gives an empty one; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from cartlens.llm.components import components
from cartlens.llm.storage import kept
from cartlens.llm.text import ragged
from cartlens.llm.topk import usable

THRESHOLD = 0.93
BITS = 64
TABLES = 4
WIDTH = BITS // TABLES
SAMPLE = 10_000
ROUNDS = 40
BLOCK = 1024
# Pairs that are looked at together.
PAIRS = 1 << 17


def learn(sample: np.ndarray, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Centre and projection (d x BITS) for unit vectors; shorter vectors get several rotations side by side."""
    d = sample.shape[1]
    rng = np.random.default_rng(seed + d)
    centre = sample.mean(axis=0) if len(sample) else np.zeros(d)
    axes = np.eye(d)
    if len(sample) > d:
        _, _, axes = np.linalg.svd(np.cov((sample - centre).T) + 1e-12 * np.eye(d))
        axes = axes.T
    parts, left = [], BITS
    while left > 0:
        use = axes[:, : min(d, left)]
        reduced = (sample - centre) @ use
        rotation, _ = np.linalg.qr(rng.normal(size=(use.shape[1], use.shape[1])))
        for _ in range(ROUNDS if len(sample) > d else 0):
            codes = np.where(reduced @ rotation >= 0, 1.0, -1.0)
            u, _, v = np.linalg.svd(codes.T @ reduced)
            rotation = (u @ v).T
        parts.append(use @ rotation)
        left -= use.shape[1]
    return centre, np.hstack(parts)


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def encode(unit: np.ndarray, centre: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """The code of each unit vector as a 64-bit number."""
    bits = (unit - centre) @ projection >= 0
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()


def _meetings(code: np.ndarray, table: np.ndarray, home: np.ndarray, block: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
    """Pairs of rows inside groups: both at home, or one a visitor; tiles of two blocks pair rows across them only.
    Of the same two vectors only the meeting in their first table is given."""
    places = np.repeat(np.arange(len(starts)), sizes)
    rows = np.arange(len(places)) + 0
    begin = starts[places]
    end = begin + sizes[places]
    # Each row is paired with all later rows of its group, a slice of rows at a time.
    later = end - rows - 1
    ends = np.cumsum(later)
    at = 0
    while at < len(rows):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + PAIRS, "right")))
        i = np.repeat(rows[at:to], later[at:to])
        j = ragged(rows[at:to] + 1, later[at:to])
        good = home[i] | home[j]
        good &= (block[i] < 0) | (block[i] != block[j])
        i, j = i[good], j[good]
        differ = code[i] ^ code[j]
        for t in range(TABLES - 1):
            part = (differ >> np.uint64(t * WIDTH)) & np.uint64((1 << WIDTH) - 1)
            fine = (table[i] <= t) | (np.bitwise_count(part) > 1)
            i, j, differ = i[fine], j[fine], differ[fine]
        yield i, j
        at = to


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links inside the groups of a sorted stream: rows (a, null, n) count links of a, rows (a, b, null) connect."""
    held: pa.Table | None = None

    def worked(table: pa.Table):
        table = table.combine_chunks()
        get = lambda c: table.column(c).to_numpy()
        ids, code, which = get("vec_id"), get("code").view(np.uint64), get("t")
        group = np.stack([get(c) for c in ("space", "t", "key", "tile")])
        first = np.append(0, np.flatnonzero((group[:, 1:] != group[:, :-1]).any(axis=0)) + 1)
        sizes = np.diff(np.append(first, len(ids)))
        width = get("d")
        flat = pa.concat_arrays(table.column("v").chunks).flatten().to_numpy()
        offset = np.cumsum(width) - width
        block = np.where(get("split"), get("block"), -1)
        n = np.zeros(len(ids), np.int64)
        parent = np.arange(len(ids))

        def root(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for i, j in _meetings(code, which, get("home"), block, first, sizes):
            good = ids[i] != ids[j]
            i, j = i[good], j[good]
            cosine = np.zeros(len(i))
            for d in np.unique(width[i]):
                of = np.flatnonzero(width[i] == d)
                for c in range(0, len(of), 1 << 14):
                    part = of[c : c + (1 << 14)]
                    x = flat[offset[i[part], None] + np.arange(d)]
                    y = flat[offset[j[part], None] + np.arange(d)]
                    cosine[part] = np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))
            i, j = i[cosine >= THRESHOLD], j[cosine >= THRESHOLD]
            n += np.bincount(i, minlength=len(ids)) + np.bincount(j, minlength=len(ids))
            # A new link between rows that are connected already tells nothing more.
            while len(i):
                a, b = parent[i], parent[j]
                while (parent[a] != a).any() or (parent[b] != b).any():
                    a, b = parent[a], parent[b]
                differ = a != b
                i, j, a, b = i[differ], j[differ], a[differ], b[differ]
                if len(i):
                    low, high = np.minimum(a, b), np.maximum(a, b)
                    order = np.lexsort((low, high))
                    top = np.append(True, high[order][1:] != high[order][:-1])
                    parent[high[order][top]] = low[order][top]
        linked = np.flatnonzero(n)
        if not len(linked):
            return
        while (parent[parent] != parent).any():
            parent = parent[parent]
        nothing = pa.nulls(len(linked), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(ids[linked]), nothing, pa.array(n[linked])], ["a", "b", "n"])
        star = linked[parent[linked] != linked]
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[star]), pa.array(ids[parent[star]]), pa.nulls(len(star), pa.int64())], ["a", "b", "n"]
        )

    for batch in batches:
        here = pa.Table.from_batches([batch])
        held = here if held is None else pa.concat_tables([held, here])
        # All but the last group are whole.
        last = held.slice(held.num_rows - 1, 1).to_pylist()[0]
        same = np.ones(held.num_rows, bool)
        for c in ("space", "t", "key", "tile"):
            same &= held.column(c).to_numpy() == last[c]
        cut = held.num_rows - int(same.sum())
        if cut >= 4096:
            yield from worked(held.slice(0, cut))
            held = held.slice(cut)
    if held is not None and held.num_rows:
        yield from worked(held)


def neighbours(table: DataFrame, id_column: str, vector_column: str, label_column: str) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    all_rows = table.select(
        F.col(id_column).cast("bigint").alias("vec_id"),
        F.col(vector_column).cast("array<double>").alias("v"),
        F.col(label_column).cast("string").alias("label"),
    )
    usable_rows = all_rows.where(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable("v") & F.exists("v", lambda x: x != 0)
    )
    n = usable_rows.count()
    share = F.xxhash64("vec_id").bitwiseAND(F.lit((1 << 30) - 1)) / F.lit(float(1 << 30))
    sample = usable_rows.where(share < SAMPLE / max(n, 1)).select(F.size("v").alias("d"), "v").toPandas()
    models = {}
    for d, part in sample.groupby("d"):
        x = np.array(part["v"].tolist(), np.float64)
        x /= np.abs(x).max(axis=1, keepdims=True)
        models[int(d)] = learn(x / np.linalg.norm(x, axis=1, keepdims=True))

    def codes(column: pa.Array) -> pa.Array:
        found = np.zeros(len(column), np.uint64)
        sizes = np.diff(column.offsets.to_numpy())
        for d in np.unique(sizes):
            at = np.flatnonzero(sizes == d)
            x = _rows(column.take(pa.array(at)))
            x = x / np.abs(x).max(axis=1, keepdims=True)
            model = models.get(int(d)) or learn(np.zeros((0, int(d))))
            found[at] = encode(x / np.linalg.norm(x, axis=1, keepdims=True), *model)
        return pa.array(found.view(np.int64))

    # Very large components would overflow squares; cosines do not change with scale.
    scaled = F.transform("v", lambda x: x / F.array_max(F.transform("v", lambda y: F.abs(y))))
    rows = kept(
        usable_rows.select(
            "vec_id",
            F.when(F.exists("v", lambda x: F.abs(x) > 1e100) | ~F.exists("v", lambda x: F.abs(x) > 1e-100), scaled)
            .otherwise(F.col("v"))
            .alias("v"),
            F.xxhash64("label", F.size("v")).alias("space"),
            F.size("v").alias("d"),
        )
        .dropDuplicates(["vec_id", "space", "v"])
        .withColumn("code", arrow_udf(codes, "bigint")("v")),
        "codes",
    )
    mask = (1 << WIDTH) - 1
    parts = rows.select("vec_id", "space", "code", F.explode(F.sequence(F.lit(0), F.lit(TABLES - 1))).alias("t")).withColumn(
        "own", F.expr(f"cast(shiftrightunsigned(code, t * {WIDTH}) & {mask} as int)")
    )
    visits = F.expr(f"filter(transform(sequence(0, {WIDTH - 1}), b -> own | shiftleft(1, b)), x -> x <> own)")
    stands = parts.select(
        "vec_id", "space", "t", "own", F.explode(F.concat(F.array("own"), visits)).alias("key")
    ).select("vec_id", "space", "t", "key", (F.col("key") == F.col("own")).alias("home"))
    useful = (
        stands.groupBy("space", "t", "key")
        .agg(F.count("*").alias("size"), F.max("home").alias("any_home"))
        .where("any_home and size > 1")
        .select("space", "t", "key", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    )
    placed = stands.join(useful, ["space", "t", "key"]).withColumn("block", F.expr("cast(pmod(xxhash64(vec_id, t), blocks) as int)"))
    # Rows of block b go to tiles (min(b, x), max(b, x)) for every block x.
    tiles = F.expr("transform(sequence(0, blocks - 1), x -> least(block, x) * blocks + greatest(block, x))")
    placed = placed.withColumn("tile", F.explode(F.when(F.col("blocks") > 1, tiles).otherwise(F.array(F.lit(0))))).withColumn(
        "split", F.expr("blocks > 1 and tile div blocks <> tile % blocks")
    )
    order = ["space", "t", "key", "tile"]
    found = kept(
        placed.join(rows.select("vec_id", "space", "code", "d", "v"), ["vec_id", "space"])
        .select("vec_id", "space", "code", "d", "v", "t", "key", F.col("tile").cast("bigint").alias("tile"), "home", "block", "split")
        .repartition(*order)
        .sortWithinPartitions(*order, "vec_id")
        .mapInArrow(_link, "a bigint, b bigint, n bigint"),
        "links",
    )
    counts = found.where("n is not null").groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "vec_id")
    names = components(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "vec_id")
    return (
        all_rows.select("vec_id")
        .join(counts, "vec_id", "left")
        .join(names, "vec_id", "left")
        .select(
            "vec_id",
            F.coalesce("n", F.lit(0)).alias("n_links"),
            F.coalesce("component", "vec_id").alias("component_id"),
            F.coalesce(F.col("component") == F.col("vec_id"), F.lit(True)).alias("kept"),
        )
    )
