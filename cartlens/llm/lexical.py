"""Ranked lexical search: summed accumulators of short lists as one bounded iterator beside skipping over long lists.

1. Terms are stretches of ASCII letters and digits and of all characters beyond ASCII, A-Z in lower case. One pass over the texts counts
   them and writes, for every document, its length and the query terms in it. Queries are taken in blocks of about BLOCK_TERMS terms,
   so what every task gets of them has a bound; further blocks are further passes.
2. Document numbers and frequencies are counted over all documents.
3. Every task takes its documents in shards of at most SHARD_POSTINGS postings and turns each into an inverted index. For an item,
   the postings of all short lists are added up term at a time. The sums are one more iterator, with a bound, beside the long lists.
4. Documents are visited in ranges of RANGE, those with the highest bounds first. Inside a range the iterators with the lowest bounds,
   which together cannot reach the K-th score so far, are looked up only for documents of the others and only while these can still
   get there; a range whose bounds add up to less is skipped. Equal scores are kept, so nothing depends on the order.
5. A task passes on K documents an item at most; these are ranked by item and part of a hash first, then by item.

Scores are whole numbers. Terms are told apart by 64 bits.

Cases: null and empty texts have no terms and are not documents of the count; a text longer than CHUNK is counted piece by piece, cut between
terms; every row is a document and every row of the items an item, repeated ids too; ties go to the smaller id, null last; empty
tables give an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartlens.llm.storage import kept, small_batches
from cartlens.llm.text import CHUNK, ragged, range_hashes, slices, utf8, words

K = 50
# Terms of the items of one pass, counted once for each item.
BLOCK_TERMS = 1_000_000
SHARD_POSTINGS = 1_500_000
# Documents that are visited at once, and the share of a shard's documents up to which a list is short.
RANGE = 2048
SHORT = 1 / 32
# Parts into which an item's results are cut for a first ranking.
PARTS = 16
# Fixed values of the score.
BASE, SLOPE = 100, 50

_FOLD = np.full(256, 32, np.uint8)
for _low, _high in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    _FOLD[_low:_high] = np.arange(_low, _high)
_FOLD[0x41:0x5B] += 32


def term_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every term, and the n + 1 places where those of each text begin and end."""
    folded = _FOLD[data]
    starts, ends, places = words(folded, offsets)
    return range_hashes(folded, starts, ends), places


def stretches(data: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of about `limit` bytes that end between terms."""
    at = 0
    while at < len(data):
        end = min(at + limit, len(data))
        while end < len(data):
            gaps = np.flatnonzero(_FOLD[data[end : end + limit]] == 32)
            if len(gaps):
                end += int(gaps[0])
                break
            end = min(end + limit, len(data))
        yield at, end
        at = end


class Vocabulary:
    """The terms of a block of items, by number, and the terms of each item."""

    def __init__(self, rows: list[int], hashes: list[np.ndarray]):
        self.rows = np.array(rows, np.int64)
        self.sorted, numbers = np.unique(np.concatenate(hashes), return_inverse=True)
        self.items = np.split(numbers, np.cumsum([len(h) for h in hashes])[:-1])

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each term, -1 for others."""
        at = np.searchsorted(self.sorted, hashes)
        at[at == len(self.sorted)] = 0
        return np.where(self.sorted[at] == hashes, at, -1)

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Terms of every text with repeats; text, term and count of every query term in a text."""
        hashes, places = term_hashes(data, offsets)
        sizes = np.diff(places)
        number = self.numbers(hashes)
        hit = np.flatnonzero(number >= 0)
        text = np.repeat(np.arange(len(sizes)), sizes)[hit]
        pairs, count = np.unique(text * len(self.sorted) + number[hit], return_counts=True)
        return sizes, pairs // len(self.sorted), pairs % len(self.sorted), count

    def long_counts(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The same for one long text, piece by piece."""
        size, terms, counts = 0, np.zeros(0, np.int64), np.zeros(0, np.int64)
        for a, b in stretches(data, CHUNK):
            sizes, _, term, count = self.counts(data[a:b], np.array([0, b - a]))
            size += int(sizes[0])
            terms, inverse = np.unique(np.concatenate([terms, term]), return_inverse=True)
            counts = np.bincount(inverse, np.concatenate([counts, count]), len(terms)).astype(np.int64)
        return np.array([size]), np.zeros(len(terms), np.int64), terms, counts


def _binary(values: np.ndarray, places: np.ndarray) -> pa.Array:
    """Values of 4 bytes, cut at places."""
    raw = pa.py_buffer(values.astype("<i4").tobytes())
    return pa.Array.from_buffers(pa.binary(), len(places) - 1, [None, pa.py_buffer((places * 4).astype(np.int32)), raw])


def counted(texts: DataFrame, id_column: str, text_column: str, known: Vocabulary) -> DataFrame:
    """doc_id, n (terms with repeats), terms and counts (of query terms, 4 bytes each) of every text with a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, offsets = utf8(batch.column("text"))
            if batch.num_rows == 1 and len(data) > CHUNK:
                sizes, text, term, count = known.long_counts(data)
            else:
                sizes, text, term, count = known.counts(data, offsets)
            places = np.searchsorted(text, np.arange(batch.num_rows + 1))
            out = pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes), _binary(term, places), _binary(count, places)], ["doc_id", "n", "terms", "counts"]
            )
            yield out.filter(pa.array(sizes > 0))

    rows = texts.select(F.col(f"`{id_column}`").cast("bigint").alias("doc_id"), F.col(f"`{text_column}`").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n bigint, terms binary, counts binary")


def item_terms(items: DataFrame, text_column: str, id_column: str) -> DataFrame:
    """row (a number), item_id and the distinct terms (8 bytes each) of every item with a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            for k in range(batch.num_rows):
                data, _ = utf8(batch.column("text").slice(k, 1))
                found = [np.unique(term_hashes(data[a:b], np.array([0, b - a]))[0]) for a, b in stretches(data, CHUNK)]
                if found:
                    distinct = np.unique(np.concatenate(found))
                    if len(distinct):
                        yield pa.RecordBatch.from_arrays(
                            [batch.column("row").slice(k, 1), batch.column("item_id").slice(k, 1), pa.array([distinct.tobytes()], pa.binary())],
                            ["row", "item_id", "terms"],
                        )

    rows = items.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_column}`").alias("item_id"), F.col(f"`{text_column}`").alias("text"))
    return rows.mapInArrow(run, f"row bigint, item_id {dict(items.dtypes)[id_column]}, terms binary")


def frequencies(index: DataFrame, terms: int) -> np.ndarray:
    """In how many documents each of the block's terms occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(terms, np.int64)
        for batch in batches:
            found += np.bincount(_flat(batch.column("terms"))[0], minlength=terms)
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(found[some])], ["term", "df"])

    rows = index.select("terms").mapInArrow(run, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    found = np.zeros(terms, np.int64)
    found[rows.column("term").to_numpy()] = rows.column("df").to_numpy()
    return found


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a column of 4-byte numbers, and how many each row has."""
    data, offsets = utf8(column)
    return np.frombuffer(data.tobytes(), "<i4"), np.diff(offsets) // 4


def weights(df: np.ndarray, documents: int) -> np.ndarray:
    return np.floor(1000 * np.log((2 * documents + 2) / (2 * df + 1))).astype(np.int64)


def length_norms(n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    if len(n) and SLOPE * int(n.max()) * documents >= 2**63:
        return np.array([BASE - SLOPE + SLOPE * int(x) * documents // terms for x in n], np.int64)
    return BASE - SLOPE + SLOPE * n * documents // terms


class Shard:
    """An inverted index over some documents, with the part of the score that each posting gives."""

    def __init__(self, n: np.ndarray, doc: np.ndarray, term: np.ndarray, count: np.ndarray, weight: np.ndarray, documents: int, terms: int):
        norm = length_norms(n, documents, terms)
        gives = weight[term] * ((1_000_000_000 * count) // (1000 * count + 20 * norm[doc]))
        order = np.argsort(term, kind="stable")
        self.size, self.docs, self.gives = len(n), doc[order], gives[order]
        self.begin = np.searchsorted(term[order], np.arange(len(weight) + 1))
        self.length = np.diff(self.begin)
        self.edges = np.arange(0, self.size + RANGE, RANGE)
        self.short = max(64, int(self.size * SHORT))
        self._cut: dict[int, tuple] = {}

    def _in_ranges(self, docs: np.ndarray, gives: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each range begins in a list, and the most that one of its postings gives."""
        places = np.searchsorted(docs, self.edges)
        most = np.zeros(len(places) - 1, np.int64)
        some = np.flatnonzero(np.diff(places))
        most[some] = np.maximum.reduceat(gives, places[some]) if len(some) else 0
        return places, most

    def _long(self, term: int) -> tuple:
        if term not in self._cut:
            here = slice(self.begin[term], self.begin[term + 1])
            docs, gives = self.docs[here], self.gives[here]
            self._cut[term] = (docs, gives, *self._in_ranges(docs, gives))
        return self._cut[term]

    def _accumulators(self, terms: np.ndarray) -> tuple | None:
        """The short lists added up, as a list of its own."""
        at = ragged(self.begin[terms], self.length[terms])
        if not len(at):
            return None
        docs, gives = self.docs[at], self.gives[at]
        order = np.argsort(docs, kind="stable")
        docs = docs[order]
        first = np.append(0, np.flatnonzero(np.diff(docs)) + 1)
        docs, gives = docs[first], np.add.reduceat(gives[order], first)
        return docs, gives, *self._in_ranges(docs, gives)

    def search(self, terms: np.ndarray, least: int, found) -> None:
        """Calls `found` with documents and scores of at least `least`, which is what it returns from then on."""
        terms = terms[self.length[terms] > 0]
        brief = self.length[terms] <= self.short
        lists = [self._long(int(t)) for t in terms[~brief]]
        sums = self._accumulators(terms[brief])
        if sums is not None:
            lists.append(sums)
        if not lists:
            return
        most = np.stack([x[3] for x in lists])
        bound = most.sum(axis=0)
        for r in np.argsort(-bound, kind="stable"):
            if bound[r] < max(least, 1):
                return
            low = np.argsort(most[:, r], kind="stable")
            upto = np.cumsum(most[low, r])
            # The first lists together stay below: their documents alone are of no use.
            spare = int(np.searchsorted(upto, max(least, 1)))
            parts = [(lists[i][0][a:b], lists[i][1][a:b]) for i in low for a, b in [lists[i][2][r : r + 2]]]
            docs = np.unique(np.concatenate([d for d, _ in parts[spare:]]))
            score = np.zeros(len(docs), np.int64)
            for d, gives in parts[spare:]:
                score[np.searchsorted(docs, d)] += gives
            for i in range(spare - 1, -1, -1):
                open_ = score + upto[i] >= least
                docs, score = docs[open_], score[open_]
                d, gives = parts[i]
                if len(docs) and len(d):
                    at = np.minimum(np.searchsorted(d, docs), len(d) - 1)
                    score += np.where(d[at] == docs, gives[at], 0)
            good = score >= max(least, 1)
            if good.any():
                least = found(docs[good], score[good])


class Best:
    """The K best documents of one item so far."""

    __slots__ = ("k", "score", "ids", "none", "least")

    def __init__(self, k: int):
        self.k, self.least = k, 0
        self.score, self.ids, self.none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, score: np.ndarray, ids: np.ndarray, none: np.ndarray) -> int:
        score, ids, none = np.append(self.score, score), np.append(self.ids, ids), np.append(self.none, none)
        best = np.lexsort((ids, none, -score))[: self.k]
        self.score, self.ids, self.none = score[best], ids[best], none[best]
        if len(best) == self.k:
            self.least = int(self.score[-1])
        return self.least


def _ranked(index: DataFrame, known: Vocabulary, df: np.ndarray, documents: int, terms: int, k: int) -> DataFrame:
    """row, doc_id and score of the k best documents of each item in each task."""
    weight = weights(df, documents)
    items, rows = known.items, known.rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in items]
        held, postings = [], 0

        def searched():
            table = pa.Table.from_batches(held).combine_chunks()
            columns = {c: table.column(c).combine_chunks() for c in table.column_names}
            columns = {c: x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for c, x in columns.items()}
            term, sizes = _flat(columns["terms"])
            count, _ = _flat(columns["counts"])
            none = pc.is_null(columns["doc_id"]).to_numpy(zero_copy_only=False)
            ids = pc.fill_null(columns["doc_id"], 0).to_numpy()
            doc = np.repeat(np.arange(len(sizes)), sizes)
            shard = Shard(columns["n"].to_numpy(), doc, term.astype(np.int64), count.astype(np.int64), weight, documents, terms)
            for item, top in zip(items, best):
                shard.search(item, top.least, lambda docs, score, top=top: top.add(score, ids[docs], none[docs]))

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            postings += len(utf8(batch.column("terms"))[0]) // 4 + batch.num_rows
            if postings >= SHARD_POSTINGS:
                searched()
                held, postings = [], 0
        if held:
            searched()
        for at in range(0, len(best), 1000):
            some = best[at : at + 1000]
            sizes = [len(x.score) for x in some]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(rows[at : at + 1000], sizes)),
                    pa.array(np.concatenate([x.ids for x in some]), mask=np.concatenate([x.none for x in some])),
                    pa.array(np.concatenate([x.score for x in some])),
                ],
                ["row", "doc_id", "score"],
            )

    return index.mapInArrow(run, "row bigint, doc_id bigint, score bigint")


def search(texts: DataFrame, id_column: str, text_column: str, items: DataFrame, item_column: str, item_text: str, k: int = K) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of the k best documents, with a score above 0, of every item."""
    spark = texts.sparkSession
    with small_batches(spark):
        asked = kept(item_terms(items, item_text, item_column), "items")
        pairs = asked.agg(F.sum(F.expr("length(terms) div 8"))).first()[0] or 0
        blocks = -(-pairs // BLOCK_TERMS)
        found = []
        for block in range(blocks):
            part = asked.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == block).select("row", "terms").orderBy("row").toArrow()
            if not part.num_rows:
                continue
            known = Vocabulary(part.column("row").to_pylist(), [np.frombuffer(x, np.uint64) for x in part.column("terms").to_pylist()])
            index = kept(counted(texts, id_column, text_column, known), "index")
            documents, terms = index.agg(F.count("*"), F.sum("n")).first()
            if documents:
                found.append(kept(_ranked(index, known, frequencies(index, len(known.sorted)), documents, terms, k), "ranked"))
    if not found:
        return asked.where("false").selectExpr("item_id", "1 as rank", "0L as doc_id", "0L as score")
    every = found[0]
    for more in found[1:]:
        every = every.unionAll(more)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    # An item has k rows from every task. They are ranked in parts first.
    every = every.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)))
    every = every.withColumn("rank", F.row_number().over(Window.partitionBy("row", "part").orderBy(*order))).where(F.col("rank") <= k)
    every = every.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy(*order))).where(F.col("rank") <= k)
    return every.join(asked.select("row", "item_id"), "row").select("item_id", "rank", "doc_id", "score")
