"""A trie of conversations by their turns, from adaptive radix trees over fixed-width turn ids.

1. Every distinct turn (role, text) has an id of WIDTH bytes, so a conversation is a key of WIDTH bytes a turn, and equal prefixes of
   conversations are equal prefixes of keys.
2. Keys are range-sorted, those of one key by conversation id, so a key or a first turn that a third of all conversations have
   in common is cut like any other stretch. A task takes its partition in runs of at most RUN_ROWS conversations and RUN_BYTES of keys.
3. A run is a tree of nodes with 4, 16, 48 or 256 places that grow as they fill, and with the bytes that all keys below share held in the
   node. Bytes are an order of the keys only; the nodes of the result stand at whole turns.
4. What continues in a neighbouring run is told from the turns that a run's first and last keys share with the keys next to them.
   A node all of whose members are in one run is done there. The others, at most two paths a run, give sums that add up over
   runs: members, children and leaves begun or ended here, bytes times members, and bytes once where the node begins.
5. The digest of members that end at a node is one stream of numbers by definition. Where they lie in several runs, each run writes its
   piece of the stream, and one task hashes the pieces in order, one at a time.

Sizes: turns of one conversation, without texts, are sorted in one task and make one key (24 bytes a turn), so memory is bounded by the
longest conversation, not by how many there are or how alike they are.

Cases: null role or text counts as empty; turns are ordered by number, null first, then role, then text; repeated turns are turns of their own;
rows without a conversation id belong to no conversation; an empty table has no node, not even a root; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartlens.llm.storage import kept, small_batches
from cartlens.session import freeze

WIDTH = 16
RUN_ROWS = 20_000
RUN_BYTES = 16_000_000
# Nodes of one batch of the result.
OUT_ROWS = 20_000

NODES = (
    "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved bigint, "
    "ends_sha256 string, id binary, parent binary, first bigint, piece string"
)
_NAMES = [x.split()[0] for x in NODES.split(", ")]
_TYPES = [pa.binary() if n in ("id", "parent") else pa.string() if n in ("ends_sha256", "piece") else pa.int64() for n in _NAMES]
NOTHING = hashlib.sha256(b"").hexdigest()


class Node4:
    """Up to 4 children: their bytes in order, and the children."""

    places = 4
    __slots__ = ("path", "ends", "sizes", "bytes", "children", "n", "least", "start")

    def __init__(self, path: bytes, start: int, sizes):
        # `path` are the bytes from `start` that all keys below share; `ends` are the conversations whose key ends behind it.
        self.path, self.start, self.sizes, self.ends = path, start, sizes, []
        self.bytes, self.children = bytearray(), []

    def child(self, byte: int):
        at = self.bytes.find(byte)
        return self.children[at] if at >= 0 else None

    def put(self, byte: int, node) -> None:
        at = 0
        while at < len(self.bytes) and self.bytes[at] < byte:
            at += 1
        if at < len(self.bytes) and self.bytes[at] == byte:
            self.children[at] = node
        else:
            self.bytes.insert(at, byte)
            self.children.insert(at, node)

    def full(self) -> bool:
        return len(self.children) == self.places

    def ordered(self):
        return zip(self.bytes, self.children)

    def grown(self):
        """The same node with more places."""
        new = LARGER[type(self)](self.path, self.start, self.sizes)
        new.ends = self.ends
        for byte, node in self.ordered():
            new.put(byte, node)
        return new


class Node16(Node4):
    places = 16
    __slots__ = ()


class Node48(Node4):
    """Up to 48 children behind an index by byte."""

    places = 48
    __slots__ = ()

    def __init__(self, path, start, sizes):
        super().__init__(path, start, sizes)
        self.bytes = bytearray(b"\xff" * 256)

    def child(self, byte):
        at = self.bytes[byte]
        return self.children[at] if at != 255 else None

    def put(self, byte, node):
        if self.bytes[byte] == 255:
            self.bytes[byte] = len(self.children)
            self.children.append(node)
        else:
            self.children[self.bytes[byte]] = node

    def ordered(self):
        return ((byte, self.children[at]) for byte, at in enumerate(self.bytes) if at != 255)


class Node256(Node4):
    """A place for every byte."""

    places = 257
    __slots__ = ()

    def __init__(self, path, start, sizes):
        super().__init__(path, start, sizes)
        self.children = [None] * 256

    def child(self, byte):
        return self.children[byte]

    def put(self, byte, node):
        self.children[byte] = node

    def full(self):
        return False

    def ordered(self):
        return ((byte, node) for byte, node in enumerate(self.children) if node is not None)


LARGER = {Node4: Node16, Node16: Node48, Node48: Node256}


def shared_length(a: bytes, b: bytes) -> int:
    """The number of leading bytes that two keys have in common."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


class Tree:
    """An adaptive radix tree of keys with the conversations that end at each."""

    def __init__(self):
        self.root = Node4(b"", 0, None)

    def insert(self, key: bytes, conv: int, sizes) -> None:
        above, byte, node, at = None, 0, self.root, 0
        while True:
            path = node.path
            if path and not key.startswith(path, at):
                # The path parts here: a new node holds what is shared.
                same = shared_length(path, key[at : at + len(path)])
                top = Node4(path[:same], node.start, node.sizes)
                rest = path[same]
                node.path, node.start = path[same:], node.start + same
                top.put(rest, node)
                above.put(byte, top)
                node = top
                path = top.path
            at += len(path)
            if at == len(key):
                node.ends.append(conv)
                if node.sizes is None or len(node.sizes) < at // WIDTH:
                    node.sizes = sizes
                return
            below = node.child(key[at])
            if below is None:
                leaf = Node4(key[at:], at, sizes)
                leaf.ends.append(conv)
                if node.full():
                    node = node.grown()
                    if above is None:
                        self.root = node
                    else:
                        above.put(byte, node)
                node.put(key[at], leaf)
                return
            above, byte, node = node, key[at], below


class Run:
    """The nodes of one run of sorted conversations: those that are done, and what is known of the others."""

    def __init__(self, rows: list[tuple[bytes, int, np.ndarray]], before: int, after: int, begins: bool, stops: bool):
        """`before` and `after`: turns that the first and last key share with the keys next to the run. `begins` and `stops`: whether
        the first and the last key itself are not also the key next to the run."""
        self.first, self.last = rows[0][0], rows[-1][0]
        self.before, self.after, self.begins, self.stops = before, after, begins, stops
        tree = Tree()
        for key, conv, sizes in rows:
            tree.insert(key, conv, sizes)
        self.out: list[tuple] = []
        self._sum_up(tree.root)

    def _sum_up(self, root) -> None:
        # Nodes from above with whether they stand on the path of the first and of the last key.
        order, todo = [], [(root, True, True, None)]
        while todo:
            node, on_first, on_last, above = todo.pop()
            order.append((node, on_first, on_last, above))
            end = node.start + len(node.path)
            for byte, below in node.ordered():
                todo.append((
                    below,
                    on_first and end < len(self.first) and self.first[end] == byte,
                    on_last and end < len(self.last) and self.last[end] == byte,
                    len(order) - 1,
                ))
        # From below: members, smallest member, and for the topmost turns below each node their number, leaves and bytes saved.
        n = [0] * len(order)
        least: list = [None] * len(order)
        below = [[0, 0, 0, 0] for _ in order]
        told: list[list] = [[] for _ in order]
        for k in range(len(order) - 1, -1, -1):
            node, on_first, on_last, above = order[k]
            n[k] += len(node.ends)
            if node.ends and (least[k] is None or node.ends[0] < least[k]):
                least[k] = min(node.ends)
            end = node.start + len(node.path)
            # begun: topmost turns below that begin in this run; any: whether there is one at all.
            begun, leaves, saved, any_ = below[k]
            low = -1 if above is None else node.start // WIDTH
            for depth in range(end // WIDTH, low, -1):
                from_before = on_first and depth <= self.before
                goes_on = on_last and depth <= self.after
                size = int(node.sizes[depth - 1]) if depth else 0
                if not any_ and not goes_on:
                    leaves += 1
                saved += (n[k] - (0 if from_before else 1)) * size
                told[k].append((depth, from_before or goes_on or depth == 0, begun, leaves, saved, size))
                begun, any_ = (0 if from_before else 1), 1
            if above is not None:
                n[above] += n[k]
                if least[above] is None or least[k] < least[above]:
                    least[above] = least[k]
                up = below[above]
                up[0] += begun
                up[1] += leaves
                up[2] += saved
                up[3] |= any_
        # From above: the nodes themselves, with the smallest member of the parent where it is known here.
        known: list = [None] * len(order)
        for k, (node, on_first, on_last, above) in enumerate(order):
            parent = known[above] if above is not None else (None, None)
            end = node.start + len(node.path)
            for depth, open_, children, leaves, saved, _ in reversed(told[k]):
                name = None
                if open_:
                    key = self.first if on_first and depth * WIDTH <= len(self.first) else self.last
                    name = node_name(key, depth)
                digest, piece, first = NOTHING, None, None
                if node.ends and depth * WIDTH == end:
                    text = ",".join(map(str, node.ends))
                    here = (not on_first or len(self.first) != end or self.begins) and (not on_last or len(self.last) != end or self.stops)
                    if here:
                        digest = hashlib.sha256(text.encode()).hexdigest()
                    else:
                        digest, piece, first = None, text, node.ends[0]
                elif open_:
                    digest = None
                self.out.append((least[k], depth, parent[0], n[k], children, leaves, saved, digest, name, parent[1], first, piece))
                # A parent that is not done is found by its name later.
                parent = (None, name) if open_ else (least[k], None)
            known[k] = parent


def node_name(key: bytes, depth: int) -> bytes:
    """A name for the first turns of a key; the root has none of its turns."""
    return hashlib.sha256(key[: depth * WIDTH]).digest()[:WIDTH] + depth.to_bytes(8, "big") if depth else b""


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], _NAMES)


def conversation_keys(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """conv_id, key and sizes (bytes of every text, eight bytes each) of every conversation."""
    text_, role_ = (F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in (text, role))
    rows = turns.where(F.col(f"`{conv}`").isNotNull()).select(
        F.col(f"`{conv}`").cast("bigint").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), role_.alias("role"), text_.alias("text")
    )
    # The length of the role tells where the text begins.
    digest = F.unhex(F.substring(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256), 1, 2 * WIDTH))
    sized = rows.withColumn("id", digest).withColumn("size", F.octet_length("text").cast("bigint"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "key", "sizes"]
        held, keys, sizes = None, [], []

        def row():
            return pa.RecordBatch.from_arrays(
                [pa.array([held]), pa.array([b"".join(keys)], pa.binary()), pa.array([np.concatenate(sizes).astype("<i8").tobytes()], pa.binary())], names
            )

        for batch in batches:
            convs = batch.column("conv_id").to_numpy()
            if not len(convs):
                continue
            ids = b"".join(batch.column("id").to_pylist())
            size = batch.column("size").to_numpy()
            starts = np.append(0, np.flatnonzero(np.diff(convs)) + 1)
            ends = np.append(starts[1:], len(convs))
            whole = []
            for a, b in zip(starts.tolist(), ends.tolist()):
                here = int(convs[a])
                if held is not None and here != held:
                    whole.append((held, b"".join(keys), np.concatenate(sizes).astype("<i8").tobytes()))
                    keys, sizes = [], []
                held = here
                keys.append(ids[a * WIDTH : b * WIDTH])
                sizes.append(size[a:b])
            if whole:
                a, b, c = zip(*whole)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.binary()), pa.array(c, pa.binary())], names)
        if held is not None:
            yield row()

    return (
        sized.repartition("conv_id")
        .sortWithinPartitions(*order)
        .select("conv_id", "id", "size")
        .mapInArrow(run, "conv_id bigint, key binary, sizes binary")
    )


def rebuilt(keys: DataFrame, group: int, heads: int) -> DataFrame:
    """Every conversation with its first h turns taken from the first conversation of its group; h is its checksum modulo `heads`."""
    with small_batches(keys.sparkSession):
        keys = kept(keys, "keys")
    keys = keys.withColumn("h", (F.crc32(F.col("conv_id").cast("string")) % heads).cast("int"))
    most = heads - 1
    tops = keys.where(f"conv_id % {group} = 0").selectExpr(
        "conv_id as top", f"substring(key, 1, {most * WIDTH}) as top_key", f"substring(sizes, 1, {most * 8}) as top_sizes"
    )
    return (
        keys.withColumn("top", F.expr(f"conv_id - conv_id % {group}"))
        .join(tops, "top", "left")
        .selectExpr(
            "conv_id",
            f"concat(substring(coalesce(top_key, X''), 1, h * {WIDTH}), substring(key, h * {WIDTH} + 1)) as key",
            "concat(substring(coalesce(top_sizes, X''), 1, h * 8), substring(sizes, h * 8 + 1)) as sizes",
        )
    )


def _ends_of_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    first = last = None
    for batch in batches:
        if batch.num_rows:
            first = batch.column("key")[0].as_py() if first is None else first
            last = batch.column("key")[batch.num_rows - 1].as_py()
    if first is not None:
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([first], pa.binary()), pa.array([last], pa.binary())], ["part", "first", "last"])


def _seams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The turns that the last key of a partition shares with the first one of the next, and whether they are one key."""
    before = None
    for batch in batches:
        for part, first, last in zip(*(batch.column(c).to_pylist() for c in ("part", "first", "last"))):
            if before is not None:
                same = shared_length(before[1], first) // WIDTH
                yield pa.RecordBatch.from_arrays(
                    [pa.array([before[0]]), pa.array([part]), pa.array([same]), pa.array([before[1] == first])], ["left", "right", "same", "equal"]
                )
            before = part, last


def trie(keyed: DataFrame) -> DataFrame:
    """The nodes of the trie of all conversations (conv_id, key, sizes)."""
    spark = keyed.sparkSession
    with small_batches(spark):
        parts = freeze(keyed.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id"))
        # A row for each partition.
        ends = kept(parts.select("key").mapInArrow(_ends_of_parts, "part long, first binary, last binary"), "ends")
        seams = ends.coalesce(1).sortWithinPartitions("part").mapInArrow(_seams, "left long, right long, same long, equal boolean").collect()
        to_left = {r["right"]: (r["same"], not r["equal"]) for r in seams}
        to_right = {r["left"]: (r["same"], not r["equal"]) for r in seams}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part = TaskContext.get().partitionId()
            before, begins = to_left.get(part, (0, True))
            rows: list[tuple] = []
            held, out = 0, []
            for batch in batches:
                for conv, key, sizes in zip(*(batch.column(c) for c in ("conv_id", "key", "sizes"))):
                    conv, key = conv.as_py(), key.as_py()
                    if rows and (len(rows) >= RUN_ROWS or held >= RUN_BYTES):
                        same, equal = shared_length(rows[-1][0], key) // WIDTH, rows[-1][0] == key
                        out += Run(rows, before, same, begins, not equal).out
                        before, begins, rows, held = same, not equal, [], 0
                    rows.append((key, conv, np.frombuffer(sizes.as_buffer(), "<i8") if len(key) else np.zeros(0, np.int64)))
                    held += len(key)
                    while len(out) >= OUT_ROWS:
                        yield _batch(out[:OUT_ROWS])
                        out = out[OUT_ROWS:]
            if rows:
                after, stops = to_right.get(part, (0, True))
                out += Run(rows, before, after, begins, stops).out
            for at in range(0, len(out), OUT_ROWS):
                yield _batch(out[at : at + OUT_ROWS])

        nodes = kept(parts.mapInArrow(run, NODES), "nodes")
        pieces = nodes.where("piece is not null").select("id", "first", "piece")

        def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            name, digest = None, None
            for batch in batches:
                for here, piece in zip(batch.column("id").to_pylist(), batch.column("piece").to_pylist()):
                    if here == name:
                        digest.update(b"," + piece.encode())
                        continue
                    if name is not None:
                        yield pa.RecordBatch.from_pydict({"id": pa.array([name], pa.binary()), "hashed": [digest.hexdigest()]})
                    name, digest = here, hashlib.sha256(piece.encode())
            if name is not None:
                yield pa.RecordBatch.from_pydict({"id": pa.array([name], pa.binary()), "hashed": [digest.hexdigest()]})

        hashed = kept(pieces.repartition("id").sortWithinPartitions("id", "first").select("id", "piece").mapInArrow(digests, "id binary, hashed string"), "hashed")
    merged = kept(
        nodes.where("id is not null")
        .groupBy("id", "depth")
        .agg(
            F.min("conv_id").alias("conv_id"),
            *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")],
            F.max("ends_sha256").alias("found"),
            F.max("parent").alias("parent"),
        )
        .join(hashed, "id", "left")
        .withColumn("ends_sha256", F.coalesce("hashed", "found", F.lit(NOTHING))),
        "merged",
    )
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", "ends_sha256"]
    root = merged.where("depth = 0").select("conv_id").first()
    names = merged.where("depth > 0").select(F.col("id").alias("parent"), F.col("conv_id").alias("of_parent"))
    done = nodes.where("id is null and parent is null").select(*columns)
    # Children of the root need no join: it is one row.
    rest = nodes.where("id is null and parent is not null").select("parent", *columns).unionByName(
        merged.withColumn("parent_conv_id", F.lit(None).cast("bigint")).select("parent", *columns)
    )
    top = rest.where("parent is null or parent = X''").withColumn(
        "parent_conv_id", F.when(F.col("depth") > 0, F.lit(root[0] if root else None)).cast("bigint")
    )
    lower = rest.where("parent <> X''").join(names.hint("merge"), "parent").withColumn("parent_conv_id", F.col("of_parent"))
    return done.unionByName(top.select(*columns)).unionByName(lower.select(*columns)).withColumnRenamed("saved", "saved_tokens")
