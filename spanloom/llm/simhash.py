"""SimHash near-duplicates by random bit sampling.

A document's 256-bit SimHash is the majority, bit by bit, over the hashes of its
distinct lower-case words; runs without separators, as of scripts that don't
write any, count by their overlapping windows.  Several tables group documents by
a random sample of coordinates.  Tables come in families that share some of their
coordinates: a fingerprint is sent once for each family, by the shared bits, and
the task that gets the bucket divides it by the additional bits of each of the
family's tables in turn.  Buckets of more than BUCKET fingerprints are sent by the
additional bits, too, once for each table; what is larger than pairing.BLOCK even
then is cut into blocks that are compared block by block.  So no cap loses a pair.
A pair that shares a table's bucket is a link when the full fingerprints differ
in at most MAX_DISTANCE bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .components import connected_components
from .pairing import BLOCK, FEW, Kernel, hinted, link_pairs, oversized, sample_of, with_blocks

BITS, MAX_DISTANCE, SEED = 256, 48, 11
#: Share of differing bits of documents that have nothing to do with each other.
FAR = 0.41
#: Such documents that share a family's bucket, and a table's, with a given one at most, on average.
FAMILY_CHANCE, CHANCE = 50_000, 500
#: Bits that a family shares at least, and additional bits of a table at least.
LEAST_SHARED, LEAST_MORE = 6, 2
#: Probability at most that a pair at the largest distance meets in no table, whatever the number of fingerprints, and in no table of a family whose shared bits agree.
MISS, FAMILY_MISS = 1e-3, 0.1
#: Fingerprints of a family's bucket beyond which its tables are sent one by one.
BUCKET = 150_000
#: Places of groups that are compared side by side, about.
SLOTS = 1 << 14
#: What stands in places without a row.
_PADS = np.random.default_rng(SEED).integers(0, 1 << 64, 4 * SLOTS, np.uint64, endpoint=False)
#: Rows of a group from which links that met before are left out before they are listed.
DENSE = 128
#: Where the number of the family stands in a key, above the shared bits.
TAG = 44

_INK = np.ones(256, bool)
_INK[: 0x30] = False
_INK[0x3A:0x41] = False
_INK[0x5B:0x61] = False
_INK[0x7B:0x80] = False
#: Bytes of a run beyond which its windows of WINDOW bytes, one from the start of every character, stand for it.
LONG, WINDOW = 48, 12
#: Ones that a byte can count.
LANE = 255
_SALT = np.array([0x1B873593A5A5A5A5, 0x2545F4914F6CDD1D, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93], np.uint64)


class Plan(NamedTuple):
    shared: int
    more: int
    families: int
    tables: int  # of a family


def plan_tables(n: int, max_distance: int = MAX_DISTANCE) -> Plan:
    """Tables for n distinct fingerprints: bits grow so that chance meetings don't.

    The tables are as many as it takes for a pair at max_distance to be missed
    with probability MISS at most, at every n; nearer pairs are missed less.
    """
    grow = lambda chance: math.ceil(math.log(max(n, 1) / chance) / -math.log(1 - FAR))
    shared = max(LEAST_SHARED, grow(FAMILY_CHANCE))
    more = max(LEAST_MORE, grow(CHANCE) - shared)
    same = BITS - max_distance
    meet = math.comb(same, shared) / math.comb(BITS, shared)
    then = math.comb(same - shared, more) / math.comb(BITS - shared, more)
    tables = times(then, FAMILY_MISS)
    return Plan(shared, more, times(meet * (1 - (1 - then) ** tables), MISS), tables)


def times(p: float, miss: float) -> int:
    """How often something of probability p must be tried to fail with probability miss at most."""
    return max(1, math.ceil(math.log(miss) / math.log1p(-p))) if 0 < p < 1 else 1


def samples(plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """(coordinates of each family, additional ones of each of its tables)."""
    rng = np.random.default_rng(SEED)
    drawn = [rng.permutation(BITS) for _ in range(plan.families)]
    return np.array([x[: plan.shared] for x in drawn]), np.array([[rng.choice(x[plan.shared :], plan.more, replace=False) for _ in range(plan.tables)] for x in drawn])


def fingerprints(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """SimHashes, 4 words of 64 bits each, of lower-case UTF-8 rows."""
    n = len(at) - 1
    out = np.zeros((n, 4), np.uint64)
    for a, b in C.row_chunks(at, 1 << 20):
        edges = at[a : b + 1]
        start, end, count = C.words_of(data, edges, _INK)
        if not len(start):
            continue
        row = np.repeat(np.arange(b - a), count)
        if (long := end - start > LONG).any():
            start, end, row = _windows(data[edges[0] : edges[-1]], start, end, row, long)
        h = C.word_hashes(data, int(edges[0]), start, end)
        first = np.unique(C.mix64(h + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
        first.sort()
        row, h = row[first], h[first]
        counts = np.bincount(row, minlength=b - a)
        ends = np.cumsum(counts)
        for lo, hi in _runs(counts, 1 << 16):  # distinct words of whole rows at a time
            w = slice(ends[lo] - counts[lo], ends[hi - 1])
            if w.start == w.stop:
                continue
            bits = np.unpackbits(C.mix64(h[w][:, None] ^ _SALT[None, :]).view(np.uint8), axis=1, bitorder="little")
            full = np.flatnonzero(counts[lo:hi])
            major = 2 * _sums(bits, counts[lo:hi][full]) > counts[lo:hi][full][:, None]
            out[a + lo + full] = np.packbits(major, axis=1, bitorder="little").view(np.uint64)
    return out


def _sums(bits: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of runs of rows of zeros and ones, counts[k] > 0 rows each: eight columns at once, as a byte holds the sum of LANE rows."""
    parts = -(-counts // LANE)
    first = np.cumsum(parts) - parts
    starts = np.repeat(np.cumsum(counts) - counts, parts) + LANE * (np.arange(parts.sum()) - np.repeat(first, parts))
    total = np.add.reduceat(bits.view(np.uint64), starts, axis=0).view(np.uint8)
    return np.add.reduceat(total, first, axis=0, dtype=np.int32) if len(total) > len(counts) else total.astype(np.int32)


def _windows(data: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray, long: np.ndarray):
    """(start, end, row) with windows in place of long runs, by row."""
    size = (end - start)[long] - WINDOW + 1
    at = np.arange(size.sum()) + np.repeat(start[long] - (np.cumsum(size) - size), size)
    owner = np.repeat(row[long], size)
    lead = (data[at] & 0xC0) != 0x80
    at, owner = at[lead], owner[lead]
    start, end, row = np.concatenate([start[~long], at]), np.concatenate([end[~long], at + WINDOW]), np.concatenate([row[~long], owner])
    order = np.lexsort((start, row))
    return start[order], end[order], row[order]


def _runs(counts: np.ndarray, most: int):
    ends, a = np.cumsum(counts), 0
    while a < len(counts):
        base = ends[a] - counts[a]
        b = max(a + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield a, b
        a = b


_FP = [f"f{i}" for i in range(4)]


def _fingerprint(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = C.utf8_view(pc.utf8_lower(batch.column("text")))
        f = fingerprints(data, at).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), *(pa.array(f[:, k]) for k in range(4))], names=["doc_id", "text_key", *_FP])


def simhash(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (a hash of the text) and the four words f0 .. f3 of each row's SimHash; null and empty texts have the SimHash 0."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), C.text_or_empty()).withColumn("text_key", F.xxhash64("text"))
    return base.mapInArrow(_fingerprint, "doc_id long, text_key long, " + ", ".join(f"{f} long" for f in _FP))


def _bits(f: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(f).view(np.uint8), axis=1, bitorder="little")


def _code(on: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Numbers that the bits at some coordinates, the same for all rows or of each row its own, make up."""
    picked = on[:, at] if at.ndim == 1 else np.take_along_axis(on, at, 1)
    return picked.astype(np.uint64) @ (np.uint64(1) << np.arange(at.shape[-1], dtype=np.uint64))


def _words(batch: pa.RecordBatch | pa.Table) -> np.ndarray:
    return np.stack([batch.column(f).to_numpy() for f in _FP], axis=1).view(np.uint64)


class _State(NamedTuple):
    words: list[np.ndarray]  # of the fingerprints, one array each
    family: np.ndarray
    only: np.ndarray  # the one table that a row is sent for, or -1
    runs: list[tuple[int, np.ndarray | slice]]  # rows of each family


class _Kernel(Kernel):
    held = 1 << 17

    def __init__(self, shared: np.ndarray, more: np.ndarray, most: int):
        self.shared, self.more, self.most, self.divisions = shared, more, most, more.shape[1]
        self.shared_masks, self.more_masks = _masks(shared), _masks(more)

    def load(self, table: pa.Table) -> _State:
        f, family = _words(table), table.column("family").to_numpy().astype(np.int64)
        if (family[1:] < family[:-1]).any():
            runs = [(int(k), np.flatnonzero(family == k)) for k in np.unique(family)]
        else:
            at = np.flatnonzero(np.diff(family, prepend=-1))
            runs = [(int(family[a]), slice(a, b)) for a, b in zip(at.tolist(), [*at[1:].tolist(), len(family)])]
        return _State([np.ascontiguousarray(f[:, k]) for k in range(4)], family, table.column("table").to_numpy(), runs)

    def divide(self, state: _State, group: np.ndarray, first: np.ndarray, s: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, bits = len(group), self.more.shape[2]
        code = np.zeros(n, np.uint64)
        for k, rows in state.runs:
            code[rows] = _number([w[rows] for w in state.words], self.more[k, s])
        code |= group.astype(np.uint64) << np.uint64(bits)
        width = np.uint64(n.bit_length())
        taken = np.flatnonzero((state.only < 0) | (state.only == s))
        if int(group[-1]).bit_length() + bits + n.bit_length() <= 64:  # rows in the low bits: the sort is stable, and faster than one of indices
            packed = np.sort(code[taken] << width | taken.astype(np.uint64))
            order, code = (packed & ((np.uint64(1) << width) - np.uint64(1))).astype(np.int64), packed >> width
        else:
            order = taken[np.argsort(code[taken], kind="stable")]
            code = code[order]
        starts = np.flatnonzero(np.diff(code, prepend=~code[:1]))
        return order, starts, np.append(starts[1:], len(order))

    def pairs(self, state: _State, order: np.ndarray, starts: np.ndarray, ends: np.ndarray, middles, s: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Links only. Groups of about one size are compared side by side, those of which there are few one by one."""
        size = ends - starts
        starts, size = starts[size > 1], size[size > 1]
        by = np.argsort(size, kind="stable")
        starts, size = starts[by], size[by]
        a = 0
        while a < len(size):
            least = int(size[a])
            b = min(int(np.searchsorted(size, least + least // 6, side="right")), a + max(1, SLOTS // least))
            if least > FEW and (least >= DENSE or (b - a) * least < SLOTS // 4):
                for start, n in zip(starts[a:b].tolist(), size[a:b].tolist()):
                    rows = order[start : start + n]
                    yield from self._within(state, rows, middles(rows), s)
            else:
                yield from self._abreast(state, order, starts[a:b], size[a:b])
            a = b

    def _abreast(self, state: _State, order: np.ndarray, starts: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of groups sorted by size: an array has a row for each place in a group, so rows o places apart are compared at once for all groups."""
        least, height, wide = int(size[0]), int(size[-1]), len(size)
        place = np.arange(height)[:, None]
        rows = order[np.minimum(starts + place, len(order) - 1)]
        words = [w.take(rows) for w in state.words]
        if height > least:
            empty = (place[least:] >= size).ravel().nonzero()[0] + least * wide
            pads = np.resize(_PADS, (4, len(empty)))
            for w, x in zip(words, pads):  # far from everything; a place without a row is no pair if it ever were near
                w.ravel()[empty] = x
            rows.ravel()[empty] = -1
        rows, words = rows.ravel(), [w.ravel() for w in words]
        buffer, one, count = np.empty(len(rows), np.uint64), np.empty(len(rows), np.uint8), np.empty(len(rows), np.uint8)
        near, apart = [], []
        for o in range(wide, len(rows), wide):
            m = len(rows) - o
            np.bitwise_count(np.bitwise_xor(words[0][:m], words[0][o:], out=buffer[:m]), out=count[:m])
            for w in words[1:3]:  # hardly a pair that is no link is left by then
                np.bitwise_count(np.bitwise_xor(w[:m], w[o:], out=buffer[:m]), out=one[:m])
                np.add(count[:m], one[:m], out=count[:m])
            x = (count[:m] <= self.most).nonzero()[0]
            if len(x):
                near.append(x)
                apart.append(o)
        if near:
            x = np.concatenate(near)
            y = x + np.repeat(apart, [len(k) for k in near])
            ok = np.bitwise_count(np.stack([w[x] ^ w[y] for w in words])).sum(0, dtype=np.int64) <= self.most
            i, j = rows[x[ok]], rows[y[ok]]
            ok = (i >= 0) & (j >= 0)
            yield i[ok], j[ok]

    def _within(self, state: _State, rows: np.ndarray, middle: int, s: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of one group; where most are links, as among many near copies of a text, those that met in a table before are left out by its codes."""
        n = len(rows)
        words = [w[rows] for w in state.words]
        step = max(1, 2 * SLOTS // n)
        before = self._before(words, int(state.family[rows[0]]), s)
        known: list[np.ndarray] = []
        most = min(step, middle) * n
        buffer, one, total = np.empty(most, np.uint64), np.empty(most, np.uint8), np.empty(most, np.uint8)
        for r in range(0, middle, step):
            to, begin = min(r + step, middle), r if middle == n else middle
            differ, bits, count = (x[: (to - r) * (n - begin)].reshape(to - r, n - begin) for x in (buffer, one, total))
            np.bitwise_count(np.bitwise_xor(words[0][r:to, None], words[0][begin:], out=differ), out=count)
            for w in words[1:3]:
                np.bitwise_count(np.bitwise_xor(w[r:to, None], w[begin:], out=differ), out=bits)
                np.add(count, bits, out=count)
            hit = count <= self.most
            if n >= DENSE:
                t = 0
                while np.count_nonzero(hit) > hit.size // 32:
                    if t == len(known):
                        if (code := next(before, None)) is None:
                            break
                        known.append(code)
                    hit &= known[t][r:to, None] != known[t][begin:]
                    t += 1
            x, y = np.divmod(np.flatnonzero(hit), n - begin)
            x, y = x + r, y + begin
            x, y = x[y > x], y[y > x]
            if len(x):
                ok = np.bitwise_count(np.stack([w[x] ^ w[y] for w in words])).sum(0, dtype=np.int64) <= self.most
                yield rows[x[ok]], rows[y[ok]]

    def _before(self, words: list[np.ndarray], k: int, s: int) -> Iterator[np.ndarray]:
        """Codes of rows of family k in tables that come before its table s: those of the family, then some of the first families."""
        bits = self.shared.shape[1] + self.more.shape[2]
        small = np.uint16 if bits <= 16 else np.uint32 if bits <= 32 else np.uint64
        for t in range(s):
            yield _number(words, self.more[k, t]).astype(np.uint16 if self.more.shape[2] <= 16 else small)
        for j in range(min(k, 8)):
            shared = _number(words, self.shared[j])
            for t in range(min(self.divisions, 5)):
                yield (shared << np.uint64(self.more.shape[2]) | _number(words, self.more[j, t])).astype(small)

    def match(self, state: _State, i: np.ndarray, j: np.ndarray, s: np.ndarray) -> np.ndarray:
        x = np.stack([w[i] ^ w[j] for w in state.words])
        family, new = state.family[i], np.ones(len(i), bool)

        def drop(left: np.ndarray, own: np.ndarray, k: int, tables: int) -> None:
            """Pairs that met in one of the family's first tables, s (in own) being the first that doesn't count."""
            for t in range(tables):
                keep = own > t
                left, own = left[keep], own[keep]
                if not len(left):
                    return
                met = _agree(x[:, left], self.more_masks[k, t])
                new[left[met]] = False
                left, own = left[~met], own[~met]

        for k in np.unique(family).tolist():
            own = np.flatnonzero(family == k)
            drop(own, s[own], k, self.divisions)
        left = np.flatnonzero(new)
        for k in range(int(family.max())):
            left = left[new[left] & (family[left] > k)]
            if not len(left):
                break
            both = left[_agree(x[:, left], self.shared_masks[k])]
            drop(both, np.full(len(both), self.divisions), k, self.divisions)
        return new


def _masks(at: np.ndarray) -> np.ndarray:
    """Fingerprints with the bits at the coordinates of the last axis."""
    on = np.zeros((*at.shape[:-1], BITS), np.uint8)
    np.put_along_axis(on, at, 1, -1)
    return np.packbits(on, axis=-1, bitorder="little").view(np.uint64)


def _number(words: list[np.ndarray], at: np.ndarray) -> np.ndarray:
    """_code() of fingerprints that are given as an array for each word."""
    code = np.zeros(len(words[0]), np.uint64)
    for j, c in enumerate(at.tolist()):
        code |= (words[c >> 6] >> np.uint64(c & 63) & np.uint64(1)) << np.uint64(j)
    return code


def _agree(x: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Which columns of x, 4 words of differing bits each, have none in mask."""
    differ = np.zeros(x.shape[1], np.uint64)
    for w, m in zip(x, mask):
        if m:
            differ |= w & m
    return differ == 0


_KEYED = "key long, family int, table int, id long, n long, " + ", ".join(f"{f} long" for f in _FP)
_NAMES = ["key", "family", "table", "id", "n", *_FP]


def _send(key: np.ndarray, family: np.ndarray, table: np.ndarray, batch: pa.RecordBatch, rows: np.ndarray) -> pa.RecordBatch:
    own = [batch.column(c).take(pa.array(rows)) for c in _NAMES[3:]]
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(family.astype(np.int32)), pa.array(table.astype(np.int32)), *own], names=_NAMES)


def _by_family(shared: np.ndarray):
    """Each fingerprint once for each family."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(shared)
        for whole in batches:
            for a in range(0, whole.num_rows, 4000):
                b = whole.slice(a, 4000)
                on = _bits(_words(b))
                key = np.stack([_code(on, at) | np.uint64(k << TAG) for k, at in enumerate(shared)], axis=1).ravel()
                yield _send(key, np.tile(np.arange(n), b.num_rows), np.full(len(key), -1), b, np.repeat(np.arange(b.num_rows), n))

    return run


def _by_table(more: np.ndarray):
    """Each row of a family once for each of its tables."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = more.shape[1]
        for whole in batches:
            for a in range(0, whole.num_rows, 4000):
                b = whole.slice(a, 4000)
                on, family, key = _bits(_words(b)), b.column("family").to_numpy().astype(np.int64), b.column("key").to_numpy().view(np.uint64)
                with np.errstate(over="ignore"):
                    keys = np.stack([C.mix64(C.mix64(key + np.uint64(s + 1) * np.uint64(0x9E3779B97F4A7C15)) + _code(on, more[family, s])) for s in range(n)], axis=1).ravel()
                yield _send(keys, np.repeat(family, n), np.tile(np.arange(n), b.num_rows), b, np.repeat(np.arange(b.num_rows), n))

    return run


def _keyed(classes: DataFrame, n: int, shared: np.ndarray, more: np.ndarray, bucket: int, block: int) -> DataFrame:
    """Rows of classes by bucket, with_blocks()'s columns included."""
    by_family = lambda rows: rows.mapInArrow(_by_family(shared), _KEYED)
    plain, found = by_family(classes), 0
    if n > bucket:
        share = min(16, max(1, bucket // 64))
        big, found = oversized(by_family(sample_of(classes, share)).select("key"), share, bucket)
    if not found:
        return with_blocks(plain, None, 0, block)
    by_table = lambda rows: rows.join(hinted(big.select("key"), found), "key", "left_semi").mapInArrow(_by_table(more), _KEYED)
    share = min(16, max(1, block // 64))
    blocks = oversized(by_table(by_family(sample_of(classes, share))).select("key"), share, block)
    small = plain.join(hinted(big.select("key"), found), "key", "left_anti")
    return with_blocks(small, None, 0, block).unionByName(with_blocks(by_table(plain), *blocks, block))


def simhash_groups(docs: DataFrame, max_distance: int = MAX_DISTANCE, plan: Plan | None = None, bucket: int = BUCKET, block: int = BLOCK) -> DataFrame:
    """One row per row of docs: doc_id, class_id, n_links, copy_id, kept, text_key.

    class_id is the smallest doc_id that links reach, n_links the number of other
    rows linked directly (copies included), copy_id the smallest doc_id with the
    same SimHash, kept whether class_id is the row's own.  Null and empty texts
    are copies of each other; rows with a null doc_id take part, and are kept
    where their class holds no doc_id.  Repeated rows are copies, each kept if its
    doc_id is; text_key tells rows of one doc_id apart.  Texts count with all of
    their words, however long.  An empty table gives an
    empty result; other columns of docs are ignored.  plan: tables to use in place
    of plan_tables()'s; bucket, block: sizes beyond which work is divided, which
    change no result.
    """
    rows = C.materialize(simhash(docs), "simhash")
    classes = rows.groupBy(*_FP).agg(F.min("doc_id").alias("copy_id"), F.count("*").alias("n"))
    classes = C.materialize(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    n = classes.count()
    shared, more = samples(plan or plan_tables(n, max_distance))
    blocked = _keyed(classes.select("id", "n", *_FP), n, shared, more, bucket, block)
    found = C.materialize(link_pairs(blocked, ["family", "table", *_FP], _Kernel(shared, more, max_distance)), "links")
    degree = found.where("other is null").groupBy("id").agg(F.sum("links").alias("links"))
    component = connected_components(found.where("other is not null"), "id", "other")
    linked = classes.join(degree, "id", "left").join(component, "id", "left").withColumn("component", F.coalesce("component", "id"))
    smallest = linked.groupBy("component").agg(F.min("copy_id").alias("class_id"))
    linked = linked.join(smallest, "component").select(*_FP, "copy_id", "n", "class_id", "component", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    return rows.join(linked, _FP).select("doc_id", "class_id", "n_links", "copy_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"), "text_key", "component")


def near_representatives(docs: DataFrame) -> DataFrame:
    """doc_id and text_key of the row that stays of each group of near duplicates: the smallest doc_id (null last), then text_key."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("first")
    return simhash_groups(docs).where("kept").groupBy("component").agg(first).select("first.doc_id", "first.text_key")
