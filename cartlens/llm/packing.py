"""Packing of documents into training sequences by lexical retrieval.

1. Every document becomes its token ids and one end id, in the tasks that read it.
2. Documents move once. A signature (the smallest hash of two adjacent ids) brings lexically close documents
   together; the rebalancing exchange cuts partitions that grow too large, so a group of copies may hold any
   share of the rows. Where the session cuts them smaller than a shard, a task reads several pieces.
3. Each partition is a run of index shards of bounded size. A shard has a BM25 inverted index over token ids. The
   document that is cut by the end of a window (or the next one in order) is the seed of the window that
   follows; its best unused neighbours fill the window, and the last of them is cut and becomes the next seed.
   The rest of a shard is cut into sequences whose lengths are powers of two, so there is no padding at all.

The query for the index is the seed's QUERY_TERMS most telling ids (inverse document frequency times saturated frequency);
every posting of these is scored. A seed without any unused neighbour is followed by the next unused document.

Cases: a null or empty text is a document of the end id alone; copies and repeated ids are documents of their own; ties of score go
to the document that comes first by (signature, id); a text longer than a shard is a shard of its own; an empty
table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartlens.llm.bpe import Encoder, Vocabulary, read_vocabulary
from cartlens.llm.storage import ROWS_PER_BATCH
from cartlens.llm.text import mixed, ragged, slices, utf8

WINDOW = 1024
END_ID = 0
# Ids of one index shard; a worker holds one shard at a time.
SHARD_IDS = 3_000_000
QUERY_TERMS = 24
K1, B = 1.2, 0.75

PIECES = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, `offset` bigint"

_encoders: dict[int, Encoder] = {}


def _encoder(content: str) -> Encoder:
    key = hash(content)
    if key not in _encoders:
        _encoders.clear()
        vocabulary = Vocabulary(content)
        merge = tiktoken.Encoding(
            "words", pat_str=r"[\s\S]+", mergeable_ranks=vocabulary.ids, special_tokens={}
        )._core_bpe.encode_single_piece
        _encoders[key] = Encoder(vocabulary, lambda words: [merge(w) if w else [] for w in words])
    return _encoders[key]


def signatures(ids: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The smallest hash of two adjacent ids of every text."""
    found = np.full(len(places) - 1, np.iinfo(np.int64).max)
    if len(ids):
        pairs = ids.astype(np.uint64) << np.uint64(32)
        pairs[:-1] |= ids[1:].astype(np.uint64)
        full = np.flatnonzero(np.diff(places) > 0)
        pairs[places[full + 1] - 1] &= np.uint64(0xFFFFFFFF << 32)
        hashes = (mixed(pairs) >> np.uint64(1)).astype(np.int64)
        lone = np.diff(places)[full] > 1
        hashes[places[full + 1][lone] - 1] = np.iinfo(np.int64).max
        found[full] = np.minimum.reduceat(hashes, places[full])
    return found


def token_rows(texts: DataFrame, id_column: str, text_column: str, vocabulary: str | None = None) -> DataFrame:
    """doc_id, ids (little-endian, two or four bytes each) and signature of every row."""
    content = read_vocabulary(texts.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _encoder(content.value)
        kind = np.dtype("<u2" if len(known.vocabulary.lengths) <= 1 << 16 else "<u4")
        for batch in slices(batches, "text"):
            ids, places = known.encode(*utf8(batch.column("text")))
            raw = pa.py_buffer(ids.astype(kind).tobytes())
            held = pa.Array.from_buffers(
                pa.binary(), len(places) - 1, [None, pa.py_buffer((places * kind.itemsize).astype(np.int32)), raw]
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), held, pa.array(np.full(len(places) - 1, kind.itemsize, np.int32)), pa.array(signatures(ids, places))],
                ["doc_id", "ids", "width", "signature"],
            )

    return texts.selectExpr(f"`{id_column}` as id", f"`{text_column}` as text").mapInArrow(
        run, f"doc_id {dict(texts.dtypes)[id_column]}, ids binary, width int, signature bigint"
    )


class Shard:
    """Documents of one shard and the inverted index over their ids."""

    def __init__(self, ids: np.ndarray, places: np.ndarray):
        n = len(places) - 1
        sizes = np.diff(places)
        doc = np.repeat(np.arange(n), sizes)
        pairs, count = np.unique(doc << 32 | ids, return_counts=True)
        doc, term = pairs >> 32, pairs & 0xFFFFFFFF
        _, term, held = np.unique(term, return_inverse=True, return_counts=True)
        idf = np.log1p((n - held + 0.5) / (held + 0.5))
        mean = max(sizes.mean(), 1.0)
        weight = idf[term] * count * (K1 + 1) / (count + K1 * (1 - B + B * sizes[doc] / mean))
        # The most telling terms of each document.
        best = np.lexsort((term, -weight, doc))
        first = np.searchsorted(doc, np.arange(n + 1))
        rank = np.arange(len(doc)) - first[doc]
        chosen = best[(rank < QUERY_TERMS)]
        self.query = term[chosen]
        self.query_at = np.searchsorted(doc[chosen], np.arange(n + 1))
        # Postings by term.
        order = np.argsort(term, kind="stable")
        self.docs, self.weights = doc[order], weight[order]
        self.term_at = np.append(0, np.cumsum(held))
        self.held = held
        self.sizes = sizes
        self.free = np.ones(n, bool)

    def scores(self, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """Unused documents that share terms with the seed, and their BM25."""
        terms = self.query[self.query_at[seed] : self.query_at[seed + 1]]
        at = ragged(self.term_at[terms], self.held[terms])
        at = at[self.free[self.docs[at]]]
        docs, place = np.unique(self.docs[at], return_inverse=True)
        return docs, np.bincount(place, self.weights[at], len(docs))

    def order(self) -> list[int]:
        """All documents, each window's seed followed by its neighbours."""
        n, sizes = len(self.free), (self.sizes + 1).tolist()
        found, filled, ahead = [0], sizes[0], 0
        self.free[0] = False
        while len(found) < n:
            room = WINDOW - filled % WINDOW
            docs, scores = self.scores(found[-1])
            # Neighbours of the seed until its window is full, the best first; then the next unused documents.
            neighbours = iter(docs[np.lexsort((docs, -scores))].tolist())
            while room > 0 and len(found) < n:
                best = next(neighbours, -1)
                if best < 0:
                    while not self.free[ahead]:
                        ahead += 1
                    best = ahead
                self.free[best] = False
                found.append(best)
                filled += sizes[best]
                room -= sizes[best]
        return found


def cuts(total: int) -> np.ndarray:
    """Where sequences of one shard begin, and its end: whole windows, then powers of two."""
    whole = np.arange(0, total - total % WINDOW + 1, WINDOW)
    rest = [1 << k for k in range(WINDOW.bit_length(), -1, -1) if total % WINDOW >> k & 1]
    return np.append(whole, whole[-1] + np.cumsum(rest)) if rest else whole


def pack_shard(doc_ids: list, ids: list[np.ndarray], first_sequence: int) -> tuple[pa.RecordBatch, int]:
    """The pieces of one shard, and how many sequences they fill."""
    places = np.append(0, np.cumsum([len(x) for x in ids]))
    shard = Shard(np.concatenate(ids).astype(np.int64), places)
    order = np.array(shard.order())
    stream = np.concatenate([part for k in order for part in (ids[k], [END_ID])]).astype("<u4")
    ends = np.cumsum(shard.sizes[order] + 1)
    begins = ends - shard.sizes[order] - 1
    windows = cuts(int(ends[-1]))
    starts = np.union1d(begins, windows[:-1])
    stops = np.append(starts[1:], ends[-1])
    of = np.searchsorted(ends, starts, "right")
    window = np.searchsorted(windows, starts, "right") - 1
    raw = pa.py_buffer(stream.tobytes())
    held = pa.Array.from_buffers(
        pa.binary(), len(starts), [None, pa.py_buffer((np.append(starts, ends[-1]) * 4).astype(np.int32)), raw]
    )
    columns = [
        pa.array([doc_ids[k] for k in order[of]], pa.int64()),
        pa.array(starts - begins[of]),
        pa.array(stops - starts),
        held,
        pa.array(shard.sizes[order[of]] + 1),
        pa.array(first_sequence + window),
        pa.array(starts - windows[window]),
    ]
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    return pa.RecordBatch.from_arrays(columns, names), len(windows) - 1


def parts(found: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The pieces in batches of bounded size: a piece has at most WINDOW ids."""
    for start in range(0, found.num_rows, ROWS_PER_BATCH):
        yield found.slice(start, ROWS_PER_BATCH)


def size_of(setting: str) -> int:
    """Bytes in a size as Spark's settings give it: 64MB, 16k, 67108864b."""
    number, unit = re.match(r"\s*(\d+)\s*([kmgtp]?)", setting.lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


def gathered(rows: DataFrame) -> DataFrame:
    """Rows of equal signature side by side, except that large groups of them are cut.

    The exchange cuts by the session's advisory size. Where that is less than a shard's ids take, there are at most as many tasks as
    shuffle partitions, each with several of the pieces: a piece alone makes a small shard, and a task and a file of its own."""
    conf = rows.sparkSession.conf
    dealt = rows.hint("rebalance", F.col("signature"))
    if size_of(conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")) >= SHARD_IDS * 2:
        return dealt
    return dealt.coalesce(int(conf.get("spark.sql.shuffle.partitions")))


def pack(texts: DataFrame, id_column: str, text_column: str, vocabulary: str | None = None) -> DataFrame:
    """The pieces of all sequences: doc_id, start, length, ids (binary, four little-endian bytes each), doc_tokens, sequence_id, offset."""
    rows = token_rows(texts, id_column, text_column, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 36
        docs, held, size = [], [], 0
        for batch in batches:
            kinds = batch.column("width").to_numpy()
            for doc, raw, width in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), kinds):
                ids = np.frombuffer(raw.as_buffer(), "<u2" if width == 2 else "<u4").copy()
                if docs and size + len(ids) + 1 > SHARD_IDS:
                    found, n = pack_shard(docs, held, sequence)
                    sequence += n
                    docs, held, size = [], [], 0
                    yield from parts(found)
                docs.append(doc)
                held.append(ids)
                size += len(ids) + 1
        if docs:
            yield from parts(pack_shard(docs, held, sequence)[0])

    return (
        gathered(rows)
        .sortWithinPartitions("signature", "doc_id")
        .select("doc_id", "ids", "width")
        .mapInArrow(run, PIECES)
    )
