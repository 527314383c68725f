"""Exact duplicates found by Patricia tries that own length-and-hash partitions.

Every text is lower-cased (A-Z only) and inserted, byte for byte, in the trie of
its bucket: its length in bytes and some bits of its SHA-256.  The bucket only
chooses the trie; whether two texts are equal is decided by the trie alone.

1. Each task inserts the texts it reads and passes one row per distinct text on:
   the rows it stands for, their number and the best of them.
2. Texts that repeat inside a task meet first in tries salted by groups of tasks,
   so that a text every task holds doesn't reach its owner once per task.
3. Owners insert what is left.  A task's rows come sorted by bucket, so a trie is
   emitted and freed when its bucket ends.  A trie that outgrows its budget
   spills its heaviest subtree: that subtree's texts, and later ones that lead
   into it, go to an owner of their own in the next round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Workspace

#: Bytes of labels and nodes that one trie, or the tries of a reading task, may hold.
TRIE_BYTES = 64 << 20
#: Bits of the content hash that choose a bucket among texts of one length.
HASH_BITS = 16
#: Tasks whose repeated texts meet in one salted trie.
TASKS_PER_SALT = 64
#: What a node costs besides its label.
NODE_BYTES = 400

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")

_TEXT_ROW = "owns array<long>, copies long, best_id long, best_row long, n_bytes long, code int, path long, part int, sha binary, body binary"


class Node:
    """An edge label with the children below it; ``end`` is set where a text ends."""

    __slots__ = ("children", "end", "label", "spilled")

    def __init__(self, label: bytes):
        self.label, self.children, self.end, self.spilled = label, {}, None, None


class Entry:
    """What is known of one text: the classes it stands for, its rows, the best row."""

    __slots__ = ("best", "copies", "owns", "sha")

    def __init__(self, sha: bytes):
        self.owns, self.copies, self.best, self.sha = [], 0, None, sha

    def add(self, owns: list[int], copies: int, best: tuple, largest: bool) -> None:
        self.owns += owns
        self.copies += copies
        if self.best is None or _better(best, self.best, largest):
            self.best = best


def _better(a: tuple, b: tuple, largest: bool) -> bool:
    """Is (id, row) ``a`` to be kept before ``b``: a row with an id before one
    without, then the larger (or smaller) id, then the earlier row."""
    if (a[0] is None) != (b[0] is None):
        return b[0] is None
    if a[0] != b[0]:
        return (a[0] > b[0]) == largest
    return a[1] < b[1]


def common(label: bytes, text: bytes, at: int) -> int:
    """How many leading bytes of ``label`` stand in ``text`` from ``at`` on."""
    if text.startswith(label, at):
        return len(label)
    low, step = 0, 16
    while text.startswith(label[low : low + step], at + low):
        low, step = low + step, step * 2
    while step > 1:
        step //= 2
        if text.startswith(label[low : low + step], at + low):
            low += step
    return low


class Patricia:
    """A compressed radix trie over byte strings."""

    def __init__(self):
        self.root, self.size = Node(b""), 0

    def find(self, text: bytes) -> Node:
        """The node where ``text`` ends, made if it is new, or the spilled node
        on the way to it."""
        node, at = self.root, 0
        while node.spilled is None and at < len(text):
            child = node.children.get(text[at])
            if child is None:
                child = node.children[text[at]] = Node(text[at:])
                self.size += NODE_BYTES + len(child.label)
                return child
            n = common(child.label, text, at)
            if n < len(child.label):
                upper = Node(child.label[:n])
                child.label = child.label[n:]
                upper.children[child.label[0]] = child
                node.children[text[at]] = child = upper
                self.size += NODE_BYTES
            node, at = child, at + n
        return node

    def texts(self, node: Node | None = None, before: bytes = b"") -> Iterator[tuple[bytes, Entry]]:
        """The texts below a node and their entries."""
        stack = [(node or self.root, before)]
        while stack:
            x, path = stack.pop()
            path += x.label
            if x.end is not None:
                yield path, x.end
            stack += [(c, path) for c in x.children.values()]

    def spill(self) -> tuple[Node, bytes] | None:
        """The heaviest subtree below the first node with several ways on, and the
        bytes above it; None if the trie is a single path."""
        node, path = self.root, b""
        while True:
            live = [c for c in node.children.values() if c.spilled is None]
            if len(live) > 1:
                return max(live, key=_weight), path
            if not live:
                return None
            node = live[0]
            path += node.label


def _weight(node: Node) -> int:
    total, stack = 0, [node]
    while stack:
        x = stack.pop()
        total += NODE_BYTES + len(x.label)
        stack += x.children.values()
    return total


class _Rows:
    """Text rows on their way out, in batches of bounded size."""

    def __init__(self, schema: pa.Schema, most: int = 8 << 20):
        self.schema, self.most, self.rows, self.size = schema, most, [], 0

    def add(self, *row) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.size += 200 + 8 * len(row[0] or ()) + len(row[-1] or b"")
        if self.size > self.most:
            yield self.batch()

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [()] * len(self.schema)
        self.rows, self.size = [], 0
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, self.schema)], schema=self.schema)


_SCHEMA = pa.schema([
    ("owns", pa.list_(pa.int64())), ("copies", pa.int64()), ("best_id", pa.int64()), ("best_row", pa.int64()), ("n_bytes", pa.int64()), ("code", pa.int32()),
    ("path", pa.int64()), ("part", pa.int32()), ("sha", pa.binary()), ("body", pa.binary()),
])
_DOC_SCHEMA = pa.schema([("row", pa.int64()), ("own", pa.int64()), ("doc_id", pa.int64())])


def _read(largest: bool, bits: int, most: int):
    """Rows in, document rows (row, own, doc_id) and text rows of this task out."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        tries: dict[tuple[int, int], Patricia] = {}
        held, row = 0, part << 40
        out = _Rows(_SCHEMA)
        docs_none = {f.name: f.type for f in _DOC_SCHEMA}
        text_none = {f.name: f.type for f in _SCHEMA}

        def both(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, have = batch.num_rows, set(batch.schema.names)
            every = docs_none | text_none
            return pa.record_batch([batch.column(k) if k in have else pa.nulls(n, t) for k, t in every.items()], names=list(every))

        def flush() -> Iterator[pa.RecordBatch]:
            for (n, code), trie in tries.items():
                for text, e in trie.texts():
                    for b in out.add(e.owns, e.copies, *e.best, n, code, 0, part, e.sha, text):
                        yield both(b)
            tries.clear()

        for batch in batches:
            rows, owns = [], []
            ids = batch.column(0).to_pylist()
            for doc_id, text in zip(ids, batch.column(1).cast(pa.large_binary())):
                body = (text.as_py() or b"").translate(LOWER)
                sha = hashlib.sha256(body).digest()
                bucket = (len(body), int.from_bytes(sha[:4], "big") >> (32 - bits) if bits else 0)
                trie = tries.get(bucket)
                if trie is None:
                    trie = tries[bucket] = Patricia()
                    held += NODE_BYTES
                before = trie.size
                node = trie.find(body)
                held += trie.size - before
                if node.end is None:
                    node.end = Entry(sha)
                    node.end.owns.append(row)
                node.end.add([], 1, (doc_id, row), largest)
                rows.append(row)
                owns.append(node.end.owns[0])
                row += 1
                if held > most:
                    yield from flush()
                    held = 0
            if rows:
                yield both(pa.record_batch([pa.array(rows, pa.int64()), pa.array(owns, pa.int64()), pa.array(ids, pa.int64())], schema=_DOC_SCHEMA))
        yield from flush()
        yield both(out.batch())

    return run


def _own(largest: bool, most: int, texts_too: bool):
    """Text rows sorted by bucket in; one row per text out, without its body unless
    ``texts_too`` or its subtree was spilled (then ``path`` names the subtree)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Rows(_SCHEMA)
        now, trie, part = None, Patricia(), 0

        def finish() -> Iterator[pa.RecordBatch]:
            for text, e in trie.texts():
                yield from out.add(e.owns, e.copies, *e.best, now[0], now[1], 0, part, e.sha, text if texts_too else None)

        for batch in batches:
            columns = {name: batch.column(name) for name in batch.schema.names}
            for i in range(batch.num_rows):
                r = {name: c[i].as_py() for name, c in columns.items()}
                bucket = (r["n_bytes"], r["code"], r["path"], r["salt"])
                if bucket != now:
                    if now is not None:
                        yield from finish()
                    now, trie, part = bucket, Patricia(), r["part"]
                body, best = r["body"], (r["best_id"], r["best_row"])
                node = trie.find(body)
                if node.spilled is not None:
                    yield from out.add(r["owns"], r["copies"], *best, *now[:2], node.spilled, r["part"], r["sha"], body)
                    continue
                if node.end is None:
                    node.end = Entry(r["sha"])
                node.end.add(r["owns"], r["copies"], best, largest)
                while trie.size > most and (heavy := trie.spill()) is not None:
                    top, path = heavy
                    top.spilled = int.from_bytes(hashlib.sha256(repr(now).encode() + path + top.label[:1]).digest()[:8], "big", signed=True) or 1
                    trie.size -= _weight(top)
                    for text, e in trie.texts(top, path):
                        yield from out.add(e.owns, e.copies, *e.best, *now[:2], top.spilled, part, e.sha, text)
                    top.children, top.end = {}, None
        if now is not None:
            yield from finish()
        yield out.batch()

    return run


def exact_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep: str = "largest", hash_bits: int = HASH_BITS, trie_bytes: int = TRIE_BYTES,
    tasks_per_salt: int = TASKS_PER_SALT,
) -> DataFrame:
    """Groups of documents whose texts are equal after A-Z went to lower case.

    One row per row of ``docs``: doc_id, keep_id (the largest id of the group, or
    with ``keep="smallest"`` the smallest), group_size (rows of the group), kept
    and text_sha256 (hex, of the lower-cased text in UTF-8).  Exactly one row of
    each group is kept, also when rows or ids repeat.

    A null text counts as empty, and all empty texts are one group.  A row
    without id counts in its group; it is kept only if no row of the group has
    an id, and keep_id is null then.  Other columns are ignored, so their names
    don't matter.  An empty table gives no rows.  A text must fit a task's memory.
    """
    ws = Workspace(docs.sparkSession)
    largest = {"largest": True, "smallest": False}[keep]
    read = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    seen = ws.keep(read.mapInArrow(_read(largest, hash_bits, trie_bytes), f"row long, own long, doc_id long, {_TEXT_ROW}"))
    texts = seen.where("copies is not null").drop("row", "own", "doc_id")

    def owners(rows: DataFrame, texts_too: bool) -> DataFrame:
        key = ["n_bytes", "code", "path", "salt"]
        return ws.keep(rows.repartition(*key).sortWithinPartitions(*key).mapInArrow(_own(largest, trie_bytes, texts_too), _TEXT_ROW))

    salted = owners(texts.where("copies > 1").withColumn("salt", F.floor(F.col("part") / tasks_per_salt).cast("int")), True).withColumn("path", F.lit(0).cast("long"))
    left, done = texts.where("copies = 1").unionByName(salted), None
    while True:
        found = owners(left.withColumn("salt", F.lit(0)), False)
        now = found.where("body is null")
        done = now if done is None else done.unionByName(now)
        left = found.where("body is not null")
        if left.isEmpty():
            break
    groups = done.select(F.explode("owns").alias("own"), F.col("best_id").alias("keep_id"), "best_row", F.col("copies").alias("group_size"), F.lower(F.hex("sha")).alias("text_sha256"))
    return seen.where("row is not null").select("row", "own", "doc_id").join(groups, "own").select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("best_row")).alias("kept"), "text_sha256"
    )
