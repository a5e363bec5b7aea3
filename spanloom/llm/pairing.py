"""Verified pairs within hash buckets, without emitting them.

Rows that share a bucket key are compared with each other; what comes out is the
number of links of each row (weighted by the copies that the other row stands
for) and the edges of a spanning forest.  Buckets of more than BLOCK rows are
split into blocks, and every pair of blocks is a group of its own: no bucket is
one task's, and no pair is lost.  A pair that meets in several tables counts in
the first of them only, which the rows' codes tell without any shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a group that are compared in one task at most, about: a bucket of n rows is cut into 2 n / BLOCK blocks.
BLOCK = 32768
#: Oversized keys that are broadcast at most; with more of them the join shuffles.
BROADCAST_KEYS = 50_000
#: Rows that are held before their groups are compared, and pairs that a kernel compares at once.
HELD, PAIRS = 1 << 14, 1 << 17
#: Rows that are compared one by one at most; more of them are compared as a matrix.
FEW = 32

OUT = pa.schema([("id", pa.int64()), ("other", pa.int64()), ("links", pa.int64())])
OUT_DDL = "id long, other long, links long"


class Kernel:
    """How rows of a group are compared; load() is given a table of groups, the others what it returns."""

    #: How often the rows of a group are divided, each time by other codes, before those that stay together are compared.
    divisions = 1
    #: Rows that are held before their groups are compared.
    held = HELD

    def load(self, table: pa.Table):
        raise NotImplementedError

    def divide(self, state, group: np.ndarray, first: np.ndarray, s: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(order, starts, ends): the rows that stay together in division s, each group's from starts to ends of order, rows of a block together; undivided by default."""
        starts = np.flatnonzero(first)
        return np.arange(len(group)), starts, np.append(starts[1:], len(group))

    def near(self, state, rows: np.ndarray) -> Callable:
        """A function of two ranges of rows: a matrix that is true where a row of the one may be a link with a row of the other."""
        raise NotImplementedError

    def pairs(self, state, order: np.ndarray, starts: np.ndarray, ends: np.ndarray, middles: Callable, s: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (i, j) of rows that stay together in division s and may be links, each once, those that met before or not; middles(rows): how many of them, the first, meet the others only, or all of them."""
        size = ends - starts
        end_of = np.repeat(ends, size)
        small = np.flatnonzero(np.repeat(size <= FEW, size))
        o = 1
        while len(small):
            small = small[small + o < end_of[small]]
            yield order[small], order[small + o]
            o += 1
        for a, b in zip(starts[size > FEW].tolist(), ends[size > FEW].tolist()):
            rows = order[a:b]
            may_link = self.near(state, rows)
            middle = middles(rows)
            step = max(1, 16 * PAIRS // (b - a))
            for r in range(0, middle, step):
                to, begin = min(r + step, middle), r if middle == b - a else middle
                x, y = np.nonzero(may_link(r, to, begin, b - a))
                x, y = x + r, y + begin
                later = y > x
                yield rows[x[later]], rows[y[later]]

    def match(self, state, i: np.ndarray, j: np.ndarray, s: np.ndarray) -> np.ndarray:
        """The mask of the pairs (i, j) that are links and meet here, in division s of each, for the first time."""
        raise NotImplementedError


def oversized(keyed: DataFrame, share: int, most: int) -> tuple[DataFrame, int]:
    """(key, n_key), about, of the keys that more than `most` rows have, and their number up to BROADCAST_KEYS + 1; keyed holds one of every `share` rows."""
    big = keyed.groupBy("key").agg((F.count("*") * share).alias("n_key")).where(F.col("n_key") > most)
    return big, big.limit(BROADCAST_KEYS + 1).count()


def sample_of(rows: DataFrame, share: int) -> DataFrame:
    """One of every `share` rows, by a hash of id."""
    return rows.where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(share)) == 0) if share > 1 else rows


def hinted(big: DataFrame, found: int) -> DataFrame:
    return F.broadcast(big) if found <= BROADCAST_KEYS else big


def with_blocks(keyed: DataFrame, big: DataFrame, found: int, block: int) -> DataFrame:
    """keyed with lo, hi (the pair of blocks a row takes part in) and block; big, found: oversized()'s."""
    if not found:
        return keyed.withColumns({"block": F.lit(0), "lo": F.lit(0), "hi": F.lit(0)})
    big = big.select("key", F.ceil(F.col("n_key") / F.lit(max(1, block // 2))).cast("int").alias("blocks"))
    df = keyed.join(hinted(big, found), "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    df = df.withColumn("block", F.pmod(F.xxhash64("id", F.lit(2)), F.col("blocks").cast("long")).cast("int"))
    df = df.withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return df.withColumns({"lo": F.least("block", "_j"), "hi": F.greatest("block", "_j")}).drop("_j", "blocks")


def _labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index that each of n rows reaches by the pairs (i, j)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def compare(batches: Iterable[pa.RecordBatch], kernel: Kernel) -> Iterator[pa.RecordBatch]:
    """Run over rows sorted by (key, lo, hi, block)."""
    held: list[pa.Table] = []
    rows, full = 0, kernel.held
    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        rows += batch.num_rows
        if rows < full:
            continue
        table = pa.concat_tables(held).combine_chunks()
        cut = _last_start(table)
        if cut:
            yield from _groups(table.slice(0, cut), kernel)
        held, rows = [table.slice(cut)], table.num_rows - cut
        full = max(kernel.held, 2 * rows)
    if held:
        yield from _groups(pa.concat_tables(held).combine_chunks(), kernel)


def _ints(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _last_start(table: pa.Table) -> int:
    """Where the last group begins."""
    same = np.ones(table.num_rows, bool)
    for name in ("key", "lo", "hi"):
        x = _ints(table, name)
        same &= x == x[-1]
    other = np.flatnonzero(~same)
    return int(other[-1]) + 1 if len(other) else 0


def _groups(table: pa.Table, kernel: Kernel) -> Iterator[pa.RecordBatch]:
    n = table.num_rows
    if not n:
        return
    key, lo, hi, block, ids, weight = (_ints(table, c) for c in ("key", "lo", "hi", "block", "id", "n"))
    new = np.ones(n, bool)
    new[1:] = (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
    group = np.cumsum(new)
    state = kernel.load(table)
    links = np.zeros(n, np.int64)
    found_i, found_j = [], []
    wait: list = []
    waiting = 0

    def middles(rows: np.ndarray) -> int:
        return int((block[rows] == lo[rows[0]]).sum()) if lo[rows[0]] < hi[rows[0]] else len(rows)  # of two blocks the first's rows meet the second's

    def test() -> None:
        nonlocal found_i, found_j, wait, waiting
        i, j, division = map(np.concatenate, zip(*wait))
        wait, waiting = [], 0
        for a in range(0, len(i), PAIRS):
            x, y, s = i[a : a + PAIRS], j[a : a + PAIRS], division[a : a + PAIRS]
            ok = (lo[x] == hi[x]) | (block[x] != block[y])  # pairs within a block belong to that block's own group
            x, y, s = x[ok], y[ok], s[ok]
            if len(x):
                ok = kernel.match(state, x, y, s)
                x, y = x[ok], y[ok]
                np.add.at(links, x, weight[y])
                np.add.at(links, y, weight[x])
                if len(x):
                    found_i.append(x)
                    found_j.append(y)
        if sum(map(len, found_i)) > 4 * PAIRS:  # a dense bucket: keep a forest of what was found so far
            found_i, found_j = _forest(n, found_i, found_j)

    for s in range(kernel.divisions):
        for i, j in kernel.pairs(state, *kernel.divide(state, group, new, s), middles, s):
            wait.append((i, j, np.full(len(i), s, np.int16)))
            waiting += len(i)
            if waiting > PAIRS or len(wait) > 4096:
                test()
    if wait:
        test()
    if not found_i:
        return
    i, j = (x[0] for x in _forest(n, found_i, found_j))
    who = np.flatnonzero(links)
    out_id = np.concatenate([ids[i], ids[who]])
    other = pa.concat_arrays([pa.array(ids[j]), pa.nulls(len(who), pa.int64())])
    yield pa.RecordBatch.from_arrays([pa.array(out_id), other, pa.array(np.concatenate([np.zeros(len(i), np.int64), links[who]]))], schema=OUT)


def _forest(n: int, found_i: list, found_j: list) -> tuple[list, list]:
    i, j = np.concatenate(found_i), np.concatenate(found_j)
    used = np.zeros(n, bool)
    used[i] = used[j] = True
    nodes, place = np.flatnonzero(used), np.cumsum(used) - 1
    label = _labels(len(nodes), place[i], place[j])
    child = np.flatnonzero(label != np.arange(len(nodes)))
    return [nodes[child]], [nodes[label[child]]]


def link_pairs(blocked: DataFrame, columns: list[str], kernel: Kernel) -> DataFrame:
    """(id, other, links): forest edges (links 0), and rows whose `other` is null with links to add up. blocked: with_blocks()'s rows."""
    ordered = blocked.select("key", "lo", "hi", "block", "id", "n", *columns).repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "block")
    return ordered.mapInArrow(lambda batches: compare(batches, kernel), OUT_DDL)
