"""Near-duplicate documents by order MinHash and banded alignment.

1. Words are stretches without white space, ASCII letters in lower case. Every run of SHINGLE words is labelled with
   how often it has occurred in its text before. Each of SKETCHES sketches takes the PICKED runs with the
   smallest hashes, in the order of the text; equal sketches become likelier with edit similarity, not only with
   shared content. A text of at most SHORT words also has keys: it without every choice of at most a fifth of its words. Two
   such texts that are a link have a common key, so short pairs are never missed.
2. Texts with equal words are one class from the start; only its smallest id goes on.
3. Rows (sketch number, sketch) are sorted over all partitions, those of one sketch by their following sketches, and
   each is paired with the one before it: as many pairs as rows, and a sketch that very many documents share is
   cut like any other stretch of the order.
4. Numbers of words, and of two-word runs in bins (an edit changes two runs at most), bound the edits of a pair from below; they rule
   out most pairs, and never a link, before any text moves. Rows move only if their id is set in a bitmap of the ids asked for, which
   lets a few others pass; joins then are exact. All other pairs are verified by banded alignment of whole texts: similarity =
   1 - edits / words of the longer text, with edits of single words; SIMILARITY or more is a link.
5. Where a sketch of three or more documents still spans several classes, all of its documents meet, first with their counts of
   runs alone and then, where these leave a pair, with their words: they are cut into blocks of about BLOCK rows and WORDS words, and each
   pair of blocks is work of its own. Rows stand by size, so only those of sizes that may be a link are paired; pairs whose
   ends are in one class by now are skipped, and bins rule out most others. Tasks return
   only links that connect, at most one less than they have documents. Classes are connected components.

Cases: texts that are null, empty or only white space are alone; a text of fewer words than SHINGLE is one run; copies and repeated
rows share a class; rows with a null id are alone, with a null class; ties go to the smaller id; an empty table gives
an empty one; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartlens.llm.components import components
from cartlens.llm.storage import bound_batches, drop, kept, sweep
from cartlens.llm.text import _LOWER, mixed, ragged, range_hashes, slices, utf8, words

SHINGLE = 2
SIMILARITY = 0.8
SKETCHES = 32
PICKED = 2
# Texts with at most so many words have a key for every way to leave out as many words as a link may.
SHORT = 14
# Up to so many edits a band is held in the bits of a number; wider ones are arrays, CELLS of one batch at a time.
BAND = 4096
CELLS = 400_000
# Documents and words of one block of a sketch that many share, and pairs that are looked at together.
BLOCK = 4096
WORDS = 2_000_000
PAIRS = 1 << 15
BINS = 256
# Bins for the runs of a short text, and bits of the largest bitmap of ids that goes to all tasks (16 MB).
RUN_BINS = 512
BITS = 1 << 27

_TOP = np.uint64(2**64 - 1)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word of all texts, and the n + 1 places where those of each text begin and end."""
    data, offsets = utf8(column)
    data = _LOWER[data]
    starts, ends, places = words(data, offsets)
    return range_hashes(data, starts, ends), places


def sketches(hashes: np.ndarray, places: np.ndarray) -> np.ndarray:
    """SKETCHES numbers for every text; texts without words have zeros."""
    n = len(places) - 1
    found = np.zeros((n, SKETCHES), np.int64)
    sizes = np.diff(places)
    counts = np.where(sizes > 0, np.maximum(sizes - SHINGLE + 1, 1), 0)
    full = np.flatnonzero(counts)
    if not len(full):
        return found
    begins = np.cumsum(counts) - counts
    text = np.repeat(np.arange(n), counts)
    at = np.arange(len(text)) - begins[text] + places[text]
    padded = np.append(hashes, np.zeros(SHINGLE, np.uint64))
    run = np.zeros(len(text), np.uint64)
    for k in range(SHINGLE):
        here = padded[at + k]
        if k:
            here = np.where(at + k < places[text + 1], here, np.uint64(0))
        run = run * _STEP + here
    run = mixed(run)
    # The label of the second and later occurrences of a run in its text.
    codes, _ = pd.factorize(mixed(run + text.astype(np.uint64) * _STEP))
    again = np.bincount(codes)[codes] > 1
    if again.any():
        where = np.flatnonzero(again)
        order = where[np.argsort(codes[where], kind="stable")]
        first = np.append(True, np.diff(codes[order]) != 0)
        rank = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
        run[order] += rank.astype(np.uint64) * _STEP
    starts = begins[full]
    sizes = counts[full]
    for j in range(SKETCHES):
        value = mixed(run, j + 1)
        picked = []
        for k in range(PICKED):
            least = np.minimum.reduceat(value, starts)
            spots = np.flatnonzero(value == np.repeat(least, sizes))
            spots = spots[np.searchsorted(spots, starts)]
            picked.append(spots)
            if k + 1 < PICKED:
                value[spots[sizes > k + 1]] = _TOP
        spots = np.sort(np.array(picked), axis=0)
        sketch = np.zeros(len(full), np.uint64)
        for row in spots:
            sketch = sketch * _STEP + run[row]
        found[full, j] = mixed(sketch).view(np.int64)
    return found


def short_keys(hashes: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the texts of at most SHORT words, and the text of each: a link's edits leave a common subsequence, and each
    text gets there without more words than its own length allows edits."""
    sizes = np.diff(places)
    keys, texts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    # Shorter texts are a link with a text of as many words only if equal; those are one class already.
    for n in range(4, SHORT + 1):
        of = np.flatnonzero(sizes == n)
        if not len(of):
            continue
        own = hashes[places[of][:, None] + np.arange(n)]
        for left in range(n - int(_limits(n)), n + 1):
            choice = np.array(list(combinations(range(n), left)))
            key = np.full((len(of), len(choice)), left, np.uint64)
            for k in range(left):
                key = mixed(key * _STEP + own[:, choice[:, k]])
            keys.append(key.ravel())
            texts.append(np.repeat(of, len(choice)))
    return np.concatenate(keys), np.concatenate(texts)


def bags(hashes: np.ndarray, places: np.ndarray) -> np.ndarray:
    """How many words of each text fall into each of BINS bins, up to 255."""
    n = len(places) - 1
    at = np.repeat(np.arange(n), np.diff(places)) * BINS + (hashes % np.uint64(BINS)).astype(np.int64)
    return np.minimum(np.bincount(at, minlength=n * BINS), 255).astype(np.uint8).reshape(n, BINS)


def run_bins(n: np.ndarray) -> np.ndarray:
    """How many bins the two-word runs of a text of n words are counted in: a power of two that grows with the text."""
    return RUN_BINS << np.clip(np.ceil(np.log2(np.maximum(n, 1) / RUN_BINS)), 0, 5).astype(np.int64)


def run_bags(hashes: np.ndarray, places: np.ndarray) -> list[bytes]:
    """How many two-word runs of each text fall into each of its bins, up to 255."""
    n = np.diff(places)
    bins = run_bins(n)
    ends = np.cumsum(bins)
    begins = ends - bins
    text = np.repeat(np.arange(len(n)), n)
    inside = np.flatnonzero(text[1:] == text[:-1])
    of = text[inside]
    at = begins[of] + (mixed(hashes[inside] * _STEP + hashes[inside + 1]) & (bins[of] - 1).astype(np.uint64)).astype(np.int64)
    found = np.minimum(np.bincount(at, minlength=int(ends[-1]) if len(ends) else 0), 255).astype(np.uint8).tobytes()
    return [found[a:b] for a, b in zip(begins.tolist(), ends.tolist())]


def _possible_pair(left: bytes, right: bytes, n_left: int, n_right: int) -> bool:
    """Whether two texts may be a link: an edit changes two runs at most, so a link has this many in common."""
    a, b = np.frombuffer(left, np.uint8), np.frombuffer(right, np.uint8)
    most = max(n_left, n_right)
    # Runs beyond the counts of a byte might all be common.
    spare = min(max(n_left - 1, 0) - int(a.sum(dtype=np.int64)), max(n_right - 1, 0) - int(b.sum(dtype=np.int64)))
    if len(a) != len(b):
        size = min(len(a), len(b))
        a, b = (x.reshape(-1, size).sum(axis=0, dtype=np.int64) for x in (a, b))
    return most - 1 - int(np.minimum(a, b).sum(dtype=np.int64)) - spare <= 2 * int(_limits(most))


def sketch_rows(texts: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """doc_id, n (words), h1 and h2 (a hash of all words) and sketches, followed by short keys, of every row with words and an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            hashes, places = word_hashes(batch.column("text"))
            found = sketches(hashes, places)
            keys, of = short_keys(hashes, places)
            text = np.concatenate([np.repeat(np.arange(len(found)), SKETCHES), of])
            numbers = np.concatenate([found.ravel(), keys.view(np.int64)])[np.argsort(text, kind="stable")]
            ends = np.append(0, np.cumsum(np.bincount(text, minlength=len(found))))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(numbers))
            h1 = range_hashes(mixed(hashes, 7), places[:-1], places[1:]).view(np.int64)
            h2 = range_hashes(mixed(hashes, 11), places[:-1], places[1:]).view(np.int64)
            out = pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(places)), pa.array(h1), pa.array(h2), lists],
                ["doc_id", "n", "h1", "h2", "sketches"],
            )
            yield out.filter(pa.array(np.diff(places) > 0))

    return (
        texts.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text"))
        .where("doc_id is not null")
        .mapInArrow(run, "doc_id bigint, n bigint, h1 bigint, h2 bigint, sketches array<bigint>")
    )


def _neighbours(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of neighbours in the order of all sketches, with the sketch (j, sketch) that puts them side by side, and their words (na, nb);
    and the kept table that they are read from."""
    # Keys of short texts stand behind the sketches and share a number.
    spread = rows.select("doc_id", "n", "sketches", F.posexplode("sketches").alias("j", "sketch")).selectExpr(
        f"least(j, {SKETCHES}) as j", "sketch", f"sketches[(j + 1) % {SKETCHES}] as next", f"sketches[(j + 2) % {SKETCHES}] as later", "n", "doc_id"
    )
    order = ["j", "sketch", "next", "later", "n", "doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        before, names = None, ["a", "b", "na", "nb", "part", "j", "sketch", "end"]
        first = None

        def mark(row, end):
            j, sketch, doc, n = row
            numbers = [pa.array([part], pa.int32()), pa.array([j], pa.int32()), pa.array([sketch]), pa.array([end], pa.int32())]
            return pa.RecordBatch.from_arrays([pa.array([doc]), pa.array([doc]), pa.array([n]), pa.array([n]), *numbers], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(c).to_numpy() for c in ("j", "sketch", "doc_id", "n")]
            if before is None:
                first = tuple(int(c[0]) for c in columns)
            else:
                columns = [np.append(was, c) for was, c in zip(before, columns)]
            before = tuple(int(c[-1]) for c in columns)
            j, sketch, doc, n = columns
            same = np.flatnonzero((j[1:] == j[:-1]) & (sketch[1:] == sketch[:-1]) & (doc[1:] != doc[:-1]))
            low = np.where(doc[same] < doc[same + 1], same, same + 1)
            high = 2 * same + 1 - low
            empty = pa.array(np.zeros(len(same), np.int32))
            pair = [pa.array(doc[low]), pa.array(doc[high]), pa.array(n[low]), pa.array(n[high])]
            yield pa.RecordBatch.from_arrays([*pair, empty, pa.array(j[same].astype(np.int32)), pa.array(sketch[same]), empty], names)
        if first is not None:
            yield mark(first, 1)
            yield mark(before, 2)

    found = kept(
        spread.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("j", "sketch", "doc_id", "n")
        .mapInArrow(run, "a bigint, b bigint, na bigint, nb bigint, part int, j int, sketch bigint, end int"),
        "neighbours",
    )
    # Two rows for each partition: the seams between partitions.
    seams = found.where("end > 0").selectExpr("*", "lag(struct(a as doc, na as n, j, sketch)) over (order by part, end) as before")
    seams = seams.where("end = 1 and j = before.j and sketch = before.sketch and a <> before.doc").selectExpr(
        "least(a, before.doc) as a", "greatest(a, before.doc) as b",
        "if(a < before.doc, na, before.n) as na", "if(a < before.doc, before.n, na) as nb", "j", "sketch",
    )
    return found.where("end = 0").select("a", "b", "na", "nb", "j", "sketch").unionAll(seams), found


def _bits(ids: DataFrame) -> tuple[np.ndarray, int]:
    """A bitmap in which the places of all ids are set, and its size. It has 16 bits an id or more up to BITS, so it stays small
    whatever the number of ids; where they are too many for it, it lets more others pass."""
    size = 1 << min(max(int(16 * ids.count()), 1 << 15).bit_length(), BITS.bit_length() - 1)
    place = F.pmod(F.xxhash64("doc_id"), F.lit(size))
    rows = (
        ids.select(place.alias("place"))
        .groupBy(F.expr("place div 32768").alias("k"))
        .agg(F.expr("bitmap_construct_agg(place % 32768)").alias("bits"))
        .collect()
    )
    found = np.zeros(size // 8, np.uint8)
    for row in rows:
        found[row["k"] * 4096 : (row["k"] + 1) * 4096] = np.frombuffer(row["bits"], np.uint8)
    return found, size


def _among(rows: DataFrame, ids: DataFrame, step=None, schema: str | None = None) -> DataFrame:
    """Rows whose doc_id is among `ids`, and a few others, without an exchange; `step` is applied to their batches in the same pass."""
    spark = rows.sparkSession
    bits, size = _bits(ids)
    shared = spark.sparkContext.broadcast(bits)
    columns = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def passing():
            for batch in batches:
                place = batch.column("place").to_numpy()
                inside = shared.value[place >> 3] >> (place & 7).astype(np.uint8) & 1
                yield batch.select(columns).filter(pa.array(inside.astype(bool)))

        return passing() if step is None else step(passing())

    placed = rows.where("doc_id is not null").withColumn("place", F.pmod(F.xxhash64("doc_id"), F.lit(size)))
    return placed.mapInArrow(run, schema or rows.schema)


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("doc_id"))


def _both(pairs: DataFrame, here: DataFrame, *columns: str) -> DataFrame:
    """Pairs (a, b, ...) with the columns of both ends in `here`, as <column>_a and <column>_b."""
    for end in ("a", "b"):
        pairs = pairs.join(here.select(F.col("doc_id").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in columns]).hint("merge"), end)
    return pairs


def _possible(pairs: DataFrame, candidates: DataFrame) -> DataFrame:
    """Those of `pairs` (a, b, shared) whose runs allow a link. Counts of runs move, not texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("runs_a", "runs_b", "n_a", "n_b")))
            near = [_possible_pair(*row) for row in rows]
            yield batch.select(["a", "b", "shared"]).filter(pa.array(near, pa.bool_()))

    here = _among(candidates.select("doc_id", "n", "runs"), _ends(pairs))
    return _both(pairs, here, "n", "runs").mapInArrow(run, "a bigint, b bigint, shared bigint").distinct()


def alignment_distances(pairs: list[tuple[np.ndarray, np.ndarray]], limits: list[int]) -> np.ndarray:
    """Edits of single items between the two lists of each pair; more than the limit is told as limit + 1."""
    found = np.array([limit + 1 for limit in limits], np.int64)
    todo = []
    for k, (a, b) in enumerate(pairs):
        if len(a) > len(b):
            a, b = b, a
        if len(b) - len(a) > limits[k]:
            continue
        m = len(a)
        differ = np.flatnonzero(a != b[:m])
        head = int(differ[0]) if len(differ) else m
        a, b = a[head:], b[head:]
        m = len(a)
        differ = np.flatnonzero(a[::-1] != b[::-1][:m]) if m else []
        tail = int(differ[0]) if len(differ) else m
        a, b = a[: len(a) - tail], b[: len(b) - tail]
        if not len(a):
            found[k] = len(b)
            continue
        # Items that the other list lacks must go.
        both = np.concatenate([a, b])
        codes, distinct = pd.factorize(both)
        common = np.minimum(np.bincount(codes[: len(a)], minlength=len(distinct)), np.bincount(codes[len(a) :], minlength=len(distinct))).sum()
        if len(b) - common <= limits[k]:
            todo.append((len(a), k, a, b))
    # A narrow band is enough for most; what does not end inside it is aligned again in a wider one.
    wide = []
    for n, k, a, b in todo:
        band = min(max(64, len(b) - n), limits[k])
        while (d := _in_band(a, b, band) if band <= BAND else None) is not None and d > band < limits[k]:
            band = min(4 * band, limits[k])
        if d is None:
            wide.append((n, k, a, b))
        else:
            found[k] = min(d, limits[k] + 1)
    todo = sorted(wide, key=lambda x: (x[0], x[1]))
    band = 4 * BAND
    while todo:
        again, batch, cells = [], [], 0
        for item in [*todo, None]:
            if item is not None:
                width = 2 * min(band, limits[item[1]]) + 1
            if batch and (item is None or cells + width > CELLS or len(item[2]) > 2 * len(batch[0][2]) + 64):
                reach = max(min(band, limits[x[1]]) for x in batch)
                for (n, k, a, b), d in zip(batch, _banded(batch, reach), strict=True):
                    if d <= reach or reach >= limits[k]:
                        found[k] = min(d, limits[k] + 1)
                    else:
                        again.append((n, k, a, b))
                batch, cells = [], 0
            if item is not None:
                batch.append(item)
                cells += width
        todo, band = again, band * 4
    return found


def _in_band(a: np.ndarray, b: np.ndarray, reach: int) -> int:
    """Edit distance of two lists, `a` not longer than `b` and by `reach` at most; reach + 1 if it is more than `reach`.

    The cells of a column that are at most `reach` off the diagonal are the bits of two numbers, which say where the next
    cell down is one more (`up`) or one less (`down`). The band moves one row down with every column, so the whole column costs a few
    operations on numbers of 2 * reach + 1 bits. Rows above the first one count back up, which keeps them out of the way."""
    m, n = len(a), len(b)
    mask = (1 << 2 * reach + 1) - 1
    down = (1 << reach) - 1
    up = mask ^ down
    score, diagonal, most = 0, 1 << reach, reach + n - m
    left, right = a.tolist(), b.tolist()
    for first in range(0, n, BAND):
        last = min(first + BAND, n)
        # Places of the words of the rows that these columns can meet.
        base = max(first - reach, 0)
        places: dict[int, int] = {}
        for i, word in enumerate(left[base : last + reach]):
            places[word] = places.get(word, 0) | 1 << i
        for j in range(first, last):
            shift = j - reach - base
            same = places.get(right[j], 0)
            if same:
                same = (same >> shift if shift >= 0 else same << -shift) & mask
            even = (((same & up) + up) ^ up | same | down) & mask
            if not even & diagonal:
                score += 1
                if score > most:
                    return reach + 1
            more = down | mask ^ (even | up)
            less = even & up
            even >>= 1
            up = less | mask ^ (even | more)
            down = even & more
    # From the cell on the diagonal back to the last row.
    rest = (1 << reach) - (1 << reach - (n - m))
    found = score - (up & rest).bit_count() + (down & rest).bit_count()
    return min(found, reach + 1)


def _banded(batch: list, reach: int) -> np.ndarray:
    """Edit distances of several pairs at once, at most `reach` off the diagonal; larger ones are not exact."""
    size = len(batch)
    rows = np.array([len(x[2]) for x in batch])
    columns = np.array([len(x[3]) for x in batch])
    width = 2 * reach + 1
    far = 1 << 28
    left = np.zeros((size, int(rows.max())), np.int64)
    right = np.full((size, int(max(rows.max(), columns.max())) + 2 * reach + 1), -1, np.int64)
    for k, (_, _, a, b) in enumerate(batch):
        left[k, : len(a)] = a
        right[k, reach : reach + len(b)] = b
    step = np.arange(width, dtype=np.int32)
    # Place c of row i stands for column i + c - reach.
    row = np.where(step >= reach, step - reach, far).astype(np.int32)
    row = np.repeat(row[None, :], size, axis=0)
    found = np.full(size, far, np.int64)
    goal = columns - rows + reach
    for i in range(1, int(rows.max()) + 1):
        moved = row + (right[:, i - 1 : i - 1 + width] != left[:, i - 1 : i])
        moved[:, :-1] = np.minimum(moved[:, :-1], row[:, 1:] + 1)
        if i <= reach:
            moved[:, reach - i] = i
            moved[:, : reach - i] = far
        row = (np.minimum.accumulate(moved - step, axis=1) + step).astype(np.int32)
        done = np.flatnonzero(rows == i)
        inside = done[(goal[done] >= 0) & (goal[done] < width)]
        found[inside] = row[inside, goal[inside]]
    return found


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of `pairs` (a, b) whose texts (doc_id, text) are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                both = [
                    tuple(np.frombuffer(part.column(c)[k].as_buffer(), "<u4") for c in ("words_a", "words_b"))
                    for k in range(part.num_rows)
                ]
                limits = _limits(np.array([max(len(a), len(b)) for a, b in both]))
                near = alignment_distances(both, limits.tolist()) <= limits
                yield part.select(["a", "b"]).filter(pa.array(near))

    return _both(pairs.select("a", "b"), _words_of(texts, _ends(pairs)), "words").mapInArrow(run, "a bigint, b bigint")


def _limits(sizes: np.ndarray | int) -> np.ndarray:
    """The edits that a link may have if its longer text has so many words."""
    return ((1 - SIMILARITY) * np.asarray(sizes) + 1e-9).astype(np.int64)


GROUP = ("j", "sketch", "tile")


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """A sorted stream cut between the groups of GROUP."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        here = pa.Table.from_batches([batch])
        held = here if held is None else pa.concat_tables([held, here])
        # All but the last group are whole.
        last = held.slice(held.num_rows - 1, 1).to_pylist()[0]
        same = np.ones(held.num_rows, bool)
        for c in GROUP:
            same &= held.column(c).to_numpy() == last[c]
        cut = held.num_rows - int(same.sum())
        if cut:
            yield held.slice(0, cut).combine_chunks()
            held = held.slice(cut)
    if held is not None:
        yield held.combine_chunks()


class _Tiles:
    """Rows of some groups by size, and the pairs of them that sizes and classes leave."""

    def __init__(self, table: pa.Table, sizes: np.ndarray):
        get = lambda c: table.column(c).to_numpy()
        keys = np.stack([get(c) for c in GROUP])
        # Those of a group stand by size: a row is paired with later ones only as long as they are not too long for a link.
        self.order = order = np.lexsort((get("doc_id"), sizes, *keys[::-1]))
        keys, self.sizes = keys[:, order], sizes[order]
        self.ids, self.block = get("doc_id")[order], np.where(get("split"), get("block"), -1)[order]
        _, self.place = np.unique(get("component")[order], return_inverse=True)
        self.name = np.arange(self.place.max() + 1)
        self.limits = _limits(self.sizes)
        first = np.append(0, np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1)
        lengths = np.diff(np.append(first, len(self.ids)))
        # The largest size of a link's longer text: at most a share of its words may be missing in the shorter one.
        longest = (self.sizes / SIMILARITY + 1e-6).astype(np.int64)
        scale = int(self.sizes.max()) + 2
        number = np.repeat(np.arange(len(first)), lengths) * scale
        stop = np.searchsorted(number + self.sizes, number + np.minimum(longest, scale - 1), "right")
        self.later = stop - np.arange(len(self.ids)) - 1

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of different classes, a slice of rows at a time."""
        rows, ends, at = np.arange(len(self.ids)), np.cumsum(self.later), 0
        while at < len(rows):
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + PAIRS, "right")))
            i, j = np.repeat(rows[at:to], self.later[at:to]), ragged(rows[at:to] + 1, self.later[at:to])
            at = to
            good = (self.name[self.place[i]] != self.name[self.place[j]]) & ((self.block[i] < 0) | (self.block[i] != self.block[j]))
            yield i[good], j[good]


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Those rows of the groups whose runs allow a link with another row of the group."""
    for table in _whole_groups(batches):
        sizes = table.column("n").to_numpy()
        tiles = _Tiles(table, sizes)
        runs = [np.frombuffer(x.as_buffer(), np.uint8) for x in table.column("runs").combine_chunks()]
        runs = np.stack([np.minimum(runs[k].reshape(-1, RUN_BINS).sum(axis=0, dtype=np.int64), 255).astype(np.uint8) for k in tiles.order])
        beyond = np.maximum(tiles.sizes - 1, 0) - runs.sum(axis=1, dtype=np.int64)
        useful = np.zeros(len(sizes), bool)
        for i, j in tiles.pairs():
            new = ~(useful[i] & useful[j])
            i, j = i[new], j[new]
            common = np.minimum(runs[i], runs[j]).sum(axis=1, dtype=np.int64) + np.minimum(beyond[i], beyond[j])
            good = tiles.sizes[j] - 1 - common <= 2 * tiles.limits[j]
            useful[i[good]] = useful[j[good]] = True
        rows = np.sort(tiles.order[useful])
        if len(rows):
            yield from table.select([*GROUP, "block", "split", "doc_id", "component"]).take(pa.array(rows)).combine_chunks().to_batches()


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) between classes inside the groups of a sorted stream."""
    for table in _whole_groups(batches):
        texts = [np.frombuffer(x.as_buffer(), "<u4") for x in table.column("words").combine_chunks()]
        tiles = _Tiles(table, np.array([len(x) for x in texts]))
        texts, sizes, ids, place, name = [texts[k] for k in tiles.order], tiles.sizes, tiles.ids, tiles.place, tiles.name
        spread = bags(np.concatenate(texts).astype(np.uint64), np.append(0, np.cumsum(sizes)))
        beyond = sizes - spread.sum(axis=1, dtype=np.int64)
        found = []
        for i, j in tiles.pairs():
            common = np.minimum(spread[i], spread[j]).sum(axis=1, dtype=np.int64) + np.minimum(beyond[i], beyond[j])
            good = sizes[j] - common <= tiles.limits[j]
            i, j = i[good], j[good]
            while len(i):
                here, there = i[:64], j[:64]
                most = tiles.limits[there]
                near = alignment_distances([(texts[x], texts[y]) for x, y in zip(here, there, strict=True)], most.tolist()) <= most
                for x, y in zip(here[near], there[near], strict=True):
                    p, q = name[place[x]], name[place[y]]
                    if p != q:
                        name[name == q] = p
                        found.append((ids[x], ids[y]))
                i, j = i[64:], j[64:]
                good = name[place[i]] != name[place[j]]
                i, j = i[good], j[good]
        a, b = np.array(found, np.int64).reshape(-1, 2).T
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _crowds(touching: DataFrame) -> DataFrame:
    """j, sketch, doc_id and n of all documents of the sketches that three or more share. Two are neighbours, and are compared as such;
    of sketches with the very same documents one is enough."""
    stands = kept(
        touching.select("j", "sketch", F.inline(F.expr("array(struct(a as doc_id, na as n), struct(b as doc_id, nb as n))"))).distinct(),
        "stands",
    )
    groups = (
        stands.groupBy("j", "sketch")
        .agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("doc_id")).alias("x"), F.sum(F.expr("xxhash64(doc_id, 1) >> 24")).alias("y"))
        .where("size > 2")
        .groupBy("size", "x", "y")
        .agg(F.min(F.struct("j", "sketch")).alias("one"))
        .select("one.j", "one.sketch")
    )
    crowds = kept(stands.join(groups, ["j", "sketch"]), "crowds")
    drop(stands)
    return crowds


def _shared(crowds: DataFrame, names: DataFrame, candidates: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) between different classes (doc_id, component) among all documents that share a sketch."""
    stands = kept(
        crowds.join(names.toDF("doc_id", "component"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id")), "stands"
    )
    useful = (
        stands.groupBy("j", "sketch")
        .agg(F.count("*").alias("size"), F.sum("n").alias("n"), F.min("component").alias("low"), F.max("component").alias("high"))
        .where("low <> high")
        .selectExpr("j", "sketch", f"cast(least(size, greatest(ceil(size / {BLOCK}), ceil(n / {WORDS}))) as int) as blocks")
    )
    placed = stands.join(useful, ["j", "sketch"]).withColumn("block", F.expr("cast(pmod(xxhash64(doc_id, j), blocks) as int)"))
    # Rows of block b go to tiles (min(b, x), max(b, x)) for every block x.
    tiles = F.expr("transform(sequence(0, blocks - 1), x -> cast(least(block, x) as bigint) * blocks + greatest(block, x))")
    placed = placed.withColumn("tile", F.explode(tiles)).withColumn("split", F.expr("tile div blocks <> tile % blocks"))
    order = list(GROUP)
    narrow = candidates.select("doc_id", "runs")
    # Counts of runs meet first; texts follow only where these leave a pair.
    near = kept(
        placed.join(_among(narrow, stands.select("doc_id").distinct()).hint("merge"), "doc_id")
        .select(*order, "block", "split", "doc_id", "component", "n", "runs")
        .repartition(*order)
        .sortWithinPartitions(*order, "doc_id")
        .mapInArrow(_near, "j int, sketch bigint, tile bigint, block int, split boolean, doc_id bigint, component bigint"),
        "near",
    )
    sweep(stands.sparkSession)
    links = kept(
        near.join(_words_of(texts, near.select("doc_id").distinct()).hint("merge"), "doc_id")
        .select(*order, "block", "split", "doc_id", "component", "words")
        .repartition(*order)
        .sortWithinPartitions(*order, "doc_id")
        .mapInArrow(_linked, "a bigint, b bigint"),
        "links",
    )
    drop(near)
    drop(stands)
    return links


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        hashes, places = word_hashes(batch.column("text"))
        raw = pa.py_buffer((hashes >> np.uint64(32)).astype("<u4").tobytes())
        held = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer((places * 4).astype(np.int32)), raw])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), held], ["doc_id", "words"])


def _words_of(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id and words of the rows (doc_id, text) among `ids`, and of a few others. Words are made from the texts where they are needed:
    a table of them would be as large as the texts and stand through all steps."""
    return _among(texts, ids, _words, "doc_id bigint, words binary")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        hashes, places = word_hashes(batch.column("text"))
        columns = [batch.column("doc_id"), pa.array(np.diff(places)), pa.array(run_bags(hashes, places), pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "runs"])


def _stars(joined: DataFrame) -> DataFrame:
    """Components as links, which stand for all links found so far."""
    return joined.selectExpr("node as a", "component as b")


def classes(texts: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """doc_id, class_id (the smallest id of the class) and kept (it is the smallest) of every row.

    The result is a table of its own; the others are deleted after their last reader."""
    spark = texts.sparkSession
    bound_batches(spark)
    all_rows = texts.select(F.col(f"`{id_column}`").cast("bigint").alias("doc_id"), F.col(f"`{text_column}`").alias("text"))

    rows = kept(sketch_rows(texts, id_column, text_column), "sketches")
    same = kept(rows.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("first")), "same")
    named = kept(rows.select("doc_id", "n", "h1", "h2"), "named")
    firsts = rows.select("doc_id", "n", "sketches").join(same.select("first").distinct(), F.col("doc_id") == F.col("first"), "left_semi")
    touching, sorted_ = _neighbours(firsts)
    drop(rows)
    sweep(spark)
    crowds = _crowds(touching)
    fits = touching.where(f"abs(na - nb) <= cast(floor({1 - SIMILARITY:.9g} * greatest(na, nb) + 1e-6) as bigint)")
    fitting = kept(fits.groupBy("a", "b").agg(F.count("*").alias("shared")), "fitting")
    drop(sorted_)
    sweep(spark)
    candidates = kept(
        _among(all_rows, _ends(fitting).unionAll(crowds.select("doc_id")).distinct(), _runs, "doc_id bigint, n bigint, runs binary"),
        "candidates",
    )
    pairs = kept(_possible(fitting, candidates), "pairs")
    drop(fitting)
    sweep(spark)

    links = kept(_verified(pairs, all_rows), "links")
    drop(pairs)
    sweep(spark)
    wider = kept(components(links), "joined")
    drop(links)
    most = _shared(crowds, wider, candidates, all_rows)
    drop(crowds, candidates)
    sweep(spark)
    joined = components(_stars(wider).unionAll(most))
    by_class = same.join(joined, F.col("first") == F.col("node"), "left").select(
        "h1", "h2", "n", F.coalesce("component", "first").alias("class_id")
    )
    found = named.join(by_class, ["h1", "h2", "n"]).groupBy("doc_id").agg(F.min("class_id").alias("class_id"))
    result = kept(
        all_rows.select("doc_id")
        .join(found, "doc_id", "left")
        .selectExpr("doc_id", "coalesce(class_id, doc_id) as class_id", "doc_id is null or coalesce(class_id, doc_id) = doc_id as kept"),
        "classes",
    )
    drop(named, same, wider, most)
    sweep(spark)
    return result
