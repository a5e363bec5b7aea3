"""Exact deduplication by Patricia-trie owners.

Texts are equal when they agree after white space is deleted.  Map tasks
combine their rows in a trie of their own, so that a text held by a third of
all rows leaves each task once.  What is left goes to the owner of its (length,
content hash), who inserts the full byte strings into a compressed radix trie;
terminal nodes store the smallest identifier.  Owners read their rows sorted by
(length, hash), so when memory runs out every subtree below the current prefix
is complete and is shed; Spark's external sort is what spills.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Groups are joined to their rows by (digest, salt): one row of the result of owners serves at most 1 / SALTS of a hot group.
SALTS = 1024
#: Bytes of keys in a trie before it sheds.
TRIE_BYTES = 48 << 20


class Node:
    __slots__ = ("label", "children", "value")

    def __init__(self, label: bytes, children: dict | None = None, value=None):
        self.label, self.children, self.value = label, children, value


class PatriciaTrie:
    """A compressed radix trie over byte strings."""

    def __init__(self) -> None:
        self.root, self.held = Node(b"", {}), 0

    def terminal(self, key: bytes) -> Node:
        """The node at which key ends, made if need be."""
        node, pos, n = self.root, 0, len(key)
        while pos < n:
            children = node.children
            if children is None:
                children = node.children = {}
            child = children.get(key[pos])
            if child is None:
                child = children[key[pos]] = Node(key[pos:])
                self.held += n - pos + 120
                return child
            label = child.label
            if key.startswith(label, pos):
                pos += len(label)
                node = child
                continue
            lo, hi = 1, min(len(label), n - pos)  # they agree on 1 byte and not on the whole label
            while lo < hi:
                mid = (lo + hi + 1) // 2
                if key.startswith(label[:mid], pos):
                    lo = mid
                else:
                    hi = mid - 1
            fork = Node(label[:lo], {label[lo]: child})
            child.label = label[lo:]
            children[key[pos]] = fork
            self.held += 120
            pos += lo
            node = fork
        return node

    def items(self) -> Iterator[tuple[bytes, object]]:
        """(key, value) of the terminal nodes."""
        stack = [(b"", self.root)]
        while stack:
            prefix, node = stack.pop()
            prefix += node.label
            if node.value is not None:
                yield prefix, node.value
            if node.children:
                stack.extend((prefix, x) for x in node.children.values())


_PART = pa.schema([("size", pa.int64()), ("route", pa.int64()), ("digest", pa.binary()), ("body", pa.binary()), ("best_chars", pa.int64()), ("best_id", pa.int64()), ("best_null", pa.bool_()), ("n", pa.int64()), ("salts", pa.binary())])
_PART_DDL = "size long, route long, digest binary, body binary, best_chars long, best_id long, best_null boolean, n long, salts binary"
_OWNED = pa.schema([("digest", pa.binary()), ("salt", pa.int32()), ("keep_id", pa.int64()), ("group_size", pa.int64())])
_OWNED_DDL = "digest binary, salt int, keep_id long, group_size long"


def _rank(chars: int, null: bool, doc: int) -> tuple:
    """Smallest wins: most code points, then smallest id, null ids last."""
    return (-chars, null, doc)


def _combine(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    trie = PatriciaTrie()

    def flush():
        rows = [(len(k), int.from_bytes(v[3][:8], "big", signed=True), v[3], k, -v[0][0], v[0][2], v[0][1], v[1], b"".join(x.to_bytes(2, "big") for x in v[2])) for k, v in trie.items()]
        for a in range(0, len(rows), 1000):
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows[a : a + 1000]), _PART)], schema=_PART)

    for batch in batches:
        chars = pc.utf8_length(batch.column("text")).to_pylist()
        data, at = C.utf8_view(batch.column("text"))
        whole = data.tobytes()
        ids, salts = batch.column("doc_id").to_pylist(), batch.column("salt").to_pylist()
        for i, doc in enumerate(ids):
            body = whole[at[i] : at[i + 1]].translate(None, C.WHITE)
            node = trie.terminal(body)
            rank = _rank(chars[i], doc is None, doc or 0)
            if (v := node.value) is None:
                node.value = [rank, 1, {salts[i]}, hashlib.sha256(body).digest()]
            else:
                if rank < v[0]:
                    v[0] = rank
                v[1] += 1
                v[2].add(salts[i])
            if trie.held > TRIE_BYTES:
                yield from flush()
                trie = PatriciaTrie()
    yield from flush()


def _own(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    trie, done = PatriciaTrie(), None

    def shed():
        out: list[tuple] = []
        for _, (rank, n, salts, digest) in trie.items():
            keep = None if rank[1] else rank[2]
            out.extend((digest, s, keep, n) for s in sorted(salts))
            if len(out) >= 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), _OWNED)], schema=_OWNED)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), _OWNED)], schema=_OWNED)

    for batch in batches:
        for size, route, digest, body, chars, doc, null, n, salts in zip(*(c.to_pylist() for c in batch.columns)):
            if (size, route) != done:
                if trie.held > TRIE_BYTES:
                    yield from shed()
                    trie = PatriciaTrie()
                done = (size, route)
            node = trie.terminal(size.to_bytes(8, "big") + (route & (1 << 64) - 1).to_bytes(8, "big") + body)
            rank = _rank(chars, null, doc)
            found = {int.from_bytes(salts[i : i + 2], "big") for i in range(0, len(salts), 2)}
            if (v := node.value) is None:
                node.value = [rank, n, found, digest]
            else:
                v[0], v[1] = min(v[0], rank), v[1] + n
                v[2] |= found
    yield from shed()


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text), n_points and text_key (of the text itself: its code points and a hash).

    Of equal texts the row with the most code points in its original text, then
    the smallest doc_id, stays; texts of any length are compared as a whole.  A null text counts as empty; a null doc_id
    counts as larger than every other (keep_id is then null where only such rows
    hold the text).  Rows repeated with the same doc_id count in group_size, and
    each of them has kept = (doc_id is keep_id).  An empty table gives an empty
    result; other columns of docs are ignored.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), C.text_or_empty(text_col).alias("text"))
    base = base.withColumn("salt", F.pmod(F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(0))), F.lit(SALTS)).cast("int"))
    parts = base.mapInArrow(_combine, _PART_DDL)
    owned = parts.repartition("size", "route").sortWithinPartitions("size", "route").mapInArrow(_own, _OWNED_DDL)
    plain = F.translate("text", C.WHITE.decode(), "")
    links = base.select("doc_id", "salt", F.unhex(F.sha2(F.encode(plain, "UTF-8"), 256)).alias("digest"), F.length("text").cast("long").alias("n_points"), F.xxhash64("text").alias("text_key"))
    return links.join(owned, ["digest", "salt"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "n_points", "text_key"
    )


def representatives(docs: DataFrame) -> DataFrame:
    """doc_id and text_key of the row that stays of each group of equal texts; of rows that repeat a doc_id the longest, then the one of the smallest text_key."""
    first = F.min_by(F.struct("doc_id", "text_key"), F.struct(-F.col("n_points"), "text_key")).alias("first")
    return exact_dedup(docs).where("kept").groupBy("text_sha256").agg(first).select("first.doc_id", "first.text_key")
