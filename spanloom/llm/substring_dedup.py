"""Repeated-span removal by De Bruijn compaction of token k-mers.

Every window of WINDOW words is an edge of a De Bruijn graph, from the node of
its first words to that of its last ones.

1. Edges are partitioned by minimizers: a window belongs to the smallest hash
   among its ANCHOR-word k-mers, so equal windows meet in one partition, and the
   windows of a minimizer travel together, CODE_BYTES each, with their source
   coordinates once.  Partitions find the edges that occur again and join them to
   fragments: chains in which each edge always follows the one before.
2. Spark joins compact fragments of different partitions: a node is nonbranching
   when the fragment that ends there, the fragment that begins there and the
   places where the one follows the other are equally many.  Fragments glued at
   such nodes are paths; all occurrences of a path are equally long.
3. Source coordinates verify them: each occurrence's words are digested where
   they stand, and a path counts only if all of its occurrences agree.  Where
   hashes collided, every window of the path is digested and compared by itself,
   so hashes decide on candidates only.

An anchor that is hot in a sample of documents is not partitioned by its own
hash but by those of its windows, of which a task sends each once, however often
it holds it.  The sample decides on routes only, never on results.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

WINDOW, ANCHOR = 35, 12
#: Bytes of a window's own hash that go with its minimizer's hash and place.
CODE_BYTES = 3
#: An anchor is hot if about HOT_RUNS documents or more hold it; it is looked for among SAMPLE_DOCS documents or 40 times the
#: root of their number.  LEAST sightings, and a share of 1 / MOST_HOT, are asked of it too: the latter bounds the list that is broadcast.
HOT_RUNS, SAMPLE_DOCS, LEAST, MOST_HOT = 2000, 20_000, 8, 50_000
#: Windows that an owner holds, about.
OWNER_WINDOWS = 4 << 20
#: Words of a long text that are worked on at once, and bytes beyond which a text is long.
PIECE_WORDS, LONG_BYTES = 1 << 22, 4 * C.CHUNK_BYTES

_BASE = np.uint64(0xD1342543DE82EF95)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_STEP = np.uint64(0x9E3779B97F4A7C15)
_POSITION = 26  # bits of a word's place in a chunk
_BLOCK = pa.schema([("bucket", pa.int32()), ("local", pa.bool_()), ("runs", pa.binary()), ("windows", pa.binary())])
_BLOCK_DDL = "bucket int, local boolean, runs binary, windows binary"
#: A row of documents: its doc_id (0 where null), whether that is null, and the hash of its text.
KEY = ["doc", "no_id", "text_key"]
_SPAN = pa.schema([("doc", pa.int64()), ("no_id", pa.bool_()), ("text_key", pa.int64()), ("start", pa.int32()), ("length", pa.int32()), ("fragment", pa.int64()), ("n", pa.int64())])
_SPAN_DDL = "doc long, no_id boolean, text_key long, start int, length int, fragment long, n long"
#: A run: consecutive windows of one document that share their minimizer. offset: from the first window to the minimizer; again: its one window stands for several of its task.
RUN = np.dtype([("anchor", "<u8"), ("doc", "<i8"), ("text_key", "<i8"), ("start", "<i4"), ("offset", "u1"), ("count", "u1"), ("no_id", "u1"), ("again", "u1")])


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all runs of k word hashes."""
    n = len(h)
    if n < k:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(h * C.powers(_BASE, n), out=total[1:])
        return C.mix64((total[k:] - total[:-k]) * C.powers(_BASE_INV, n)[: n - k + 1])


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of x[i : i + width] for every i with that many."""
    done, now = 1, x
    while 2 * done <= width:
        now = np.minimum(now[:-done], now[done:])
        done *= 2
    return np.minimum(now[: len(x) - width + 1], now[width - done : width - done + len(x) - width + 1]) if width > done else now


def windows_of(h: np.ndarray, counts: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR):
    """For word hashes of several documents on end: (starts of all windows, their hashes, places of their minimizers, hashes of all anchors)."""
    none = np.zeros(0, np.int64)
    if len(h) < window:
        return none, none.astype(np.uint64), none, none.astype(np.uint64)
    ends = np.repeat(np.cumsum(counts), counts)
    starts = np.flatnonzero(np.arange(len(h)) + window <= ends)
    anchors = rolling(h, anchor)
    low = np.uint64((1 << _POSITION) - 1)
    ranked = (anchors & ~low) | np.arange(len(anchors), dtype=np.uint64)
    place = (_sliding_min(ranked, window - anchor + 1)[starts] & low).astype(np.int64)
    return starts, rolling(h, window)[starts], place, anchors


def _long_hashes(data: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Word hashes of one long text, from pieces of it that end at white space."""
    white, out = C.is_white, []
    while lo < hi:
        end = min(lo + C.CHUNK_BYTES, hi)
        if end < hi:
            gaps = np.flatnonzero(white[data[lo:end]])
            while not len(gaps) and end < hi:  # within a word that is longer than a piece
                more = min(end + C.CHUNK_BYTES, hi)
                gaps = np.flatnonzero(white[data[end:more]]) + end - lo
                end = more
            end = lo + int(gaps[-1]) + 1 if len(gaps) else hi
        start, stop, _ = C.words_of(data, np.array([lo, end]))
        out.append(C.word_hashes(data, lo, start, stop))
        lo = end
    return np.concatenate(out)


def _chunks(batch: pa.RecordBatch):
    """(rows, word hashes, words of each row, place of the first of them in its text) of parts of a batch; parts of a long text overlap by WINDOW - 1 words."""
    data, at = C.utf8_view(batch.column("text"))
    for a, b in C.row_chunks(at):
        edges = at[a : b + 1]
        if edges[-1] - edges[0] > LONG_BYTES:
            h = _long_hashes(data, int(edges[0]), int(edges[-1]))
            for s in range(0, max(1, len(h) - WINDOW + 1), PIECE_WORDS):
                part = h[s : s + PIECE_WORDS + WINDOW - 1]
                yield np.arange(a, b), part, np.array([len(part)]), np.array([s])
            continue
        start, end, counts = C.words_of(data, edges)
        yield np.arange(a, b), C.word_hashes(data, int(edges[0]), start, end), counts, np.zeros(b - a, np.int64)


def _anchors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, times); the row whose anchor is null counts windows."""
    for batch in batches:
        for _, h, counts, _ in _chunks(batch):
            starts, _, place, anchors = windows_of(h, counts)
            a, n = np.unique(anchors[np.unique(place)], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([*a.view(np.int64).tolist(), None], pa.int64()), pa.array([*n.tolist(), len(starts)], pa.int64())], names=["anchor", "n"])


def survey(docs: DataFrame, hot_runs: int = HOT_RUNS) -> tuple[np.ndarray, int]:
    """(hot anchors, sorted; about how many windows docs has), from a sample of documents.

    The list is bounded whatever the input: an anchor makes up a share of 1 /
    MOST_HOT documents of the sample at least.
    """
    n = docs.count()
    size = max(SAMPLE_DOCS, int(40 * n**0.5))
    share = min(1.0, size / max(1, n))
    least = max(LEAST, math.ceil(hot_runs * share), min(n, size) // MOST_HOT)
    some = docs.select("text")
    some = some.sample(share, seed=3) if share < 1 else some
    found = some.mapInArrow(_anchors, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    rows = found.where(F.col("anchor").isNull() | (F.col("n") >= least)).toArrow()
    anchors, times = rows.column("anchor").combine_chunks(), rows.column("n").to_pylist()
    windows = sum(t for t, null in zip(times, anchors.is_null().to_pylist()) if null)
    return np.sort(anchors.drop_null().to_numpy().view(np.uint64)), int(windows / share)


def _edge_keys(anchor: np.ndarray, offset: np.ndarray, code: np.ndarray) -> np.ndarray:
    """What tells edges apart: minimizer, place of it in the window (may wrap around), bytes of the window's own hash."""
    with np.errstate(over="ignore"):
        return C.mix64(C.mix64(anchor + offset.astype(np.uint64) * _STEP) + code)


def _fragment_ids(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return C.mix64(first + length.astype(np.uint64) * _STEP).view(np.int64)


def _blocks(buckets: int, hot: np.ndarray, code_bytes: int):
    mask = np.uint64((1 << 8 * code_bytes) - 1)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, no_id, text_key = (batch.column(c).to_numpy(zero_copy_only=False) for c in KEY)
            for rows, h, counts, base in _chunks(batch):
                starts, hashes, place, anchors = windows_of(h, counts)
                if not len(starts):
                    continue
                first_word = np.cumsum(counts) - counts - base
                row = np.repeat(np.arange(len(rows)), counts)[starts]
                is_hot = np.isin(anchors[place], hot) if len(hot) else np.zeros(len(starts), bool)
                new = np.ones(len(starts), bool)
                new[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1]) | is_hot[1:]
                at = np.flatnonzero(new)
                runs = np.zeros(len(at), RUN)
                runs["anchor"] = anchors[place[at]]
                runs["doc"], runs["no_id"], runs["text_key"] = doc[rows[row[at]]], no_id[rows[row[at]]], text_key[rows[row[at]]]
                runs["start"] = starts[at] - first_word[row[at]]
                runs["offset"] = place[at] - starts[at]
                runs["count"] = np.diff(np.append(at, len(starts)))
                route, send = runs["anchor"].copy(), np.ones(len(at), bool)
                if is_hot.any():  # one window a run: each goes to its own owner, once from here
                    single = np.flatnonzero(is_hot[at])
                    w = hashes[at[single]]
                    route[single] = w
                    code = w & mask
                    key = _edge_keys(runs["anchor"][single], runs["offset"][single], code)
                    _, first, back, times = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
                    runs["again"][single] = times[back] > 1
                    keep = np.zeros(len(single), bool)
                    keep[first] = True
                    send[single] = keep
                    if not keep.all():
                        rest, ids = runs[single[~keep]], _fragment_ids(key[~keep], np.ones(int((~keep).sum()), np.int64))
                        yield pa.RecordBatch.from_arrays([pa.array([int(route[0] % np.uint64(buckets))], pa.int32()), pa.array([True]), pa.array([rest.tobytes()], pa.binary()), pa.array([ids.tobytes()], pa.binary())], schema=_BLOCK)
                bucket = (C.mix64(route) % np.uint64(buckets)).astype(np.int32)
                order = np.flatnonzero(send)
                order = order[np.argsort(bucket[order], kind="stable")]
                yield from _cut(runs, at, hashes, bucket, order, code_bytes)

    return run


def _cut(runs, at, hashes, bucket, order, code_bytes: int) -> Iterator[pa.RecordBatch]:
    """One row per bucket: its runs, and code_bytes of the hash of each of their windows."""
    count = runs["count"].astype(np.int64)[order]
    window = np.repeat(at[order] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    w = np.ascontiguousarray(hashes[window][:, None].view(np.uint8)[:, :code_bytes]).tobytes()
    mine, runs = bucket[order], runs[order]
    cut = np.flatnonzero(np.append(True, mine[1:] != mine[:-1])) if len(mine) else np.zeros(0, np.int64)
    edge = np.append(cut, len(mine))
    byte = code_bytes * np.concatenate([[0], np.cumsum(count)])[edge]
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(mine[cut], pa.int32()), pa.array(np.zeros(len(cut), bool)),
            pa.array([runs[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:])], pa.binary()), pa.array([w[a:b] for a, b in zip(byte[:-1], byte[1:])], pa.binary()),
        ],
        schema=_BLOCK,
    )


def _spans(runs: np.ndarray, start: np.ndarray, length: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of fragments; those of a row that is repeated, at the same place, are one with their number."""
    if not len(runs):
        return
    doc, text_key, no_id = (np.ascontiguousarray(runs[c]) for c in ("doc", "text_key", "no_id"))
    order = np.lexsort((start, text_key, doc, no_id))
    doc, text_key, no_id, start, length, ids = (x[order] for x in (doc, text_key, no_id, start, length, ids))
    new = np.append(True, (start[1:] != start[:-1]) | (text_key[1:] != text_key[:-1]) | (doc[1:] != doc[:-1]) | (no_id[1:] != no_id[:-1]))
    at = np.flatnonzero(new)
    n = np.diff(np.append(at, len(new)))
    for a in range(0, len(at), 50_000):
        k = at[a : a + 50_000]
        columns = [doc[k], no_id[k].astype(bool), text_key[k], start[k].astype(np.int32), length[k].astype(np.int32), ids[k], n[a : a + 50_000]]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SPAN)], schema=_SPAN)


def _own(code_bytes: int):
    """Fragments: chains of repeated edges of a run, cut where an edge doesn't always follow the one before."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_runs, all_windows, locals_, ids = [], [], [], []
        for batch in batches:
            for local, runs, windows in zip(*(batch.column(c).to_pylist() for c in ("local", "runs", "windows"))):
                runs = np.frombuffer(runs, RUN)
                if local:
                    locals_.append(runs)
                    ids.append(np.frombuffer(windows, np.int64))
                else:
                    all_runs.append(runs)
                    all_windows.append(np.frombuffer(windows, np.uint8))
        if locals_:
            own, ids = np.concatenate(locals_), np.concatenate(ids)
            del locals_
            yield from _spans(own, own["start"], np.ones(len(own), np.int32), ids)
            del own, ids
        if all_runs:
            joined = [np.concatenate(all_runs), np.concatenate(all_windows)]
            del all_runs, all_windows
            yield from _fragments(joined, code_bytes)

    return run


def _fragments(joined: list[np.ndarray], code_bytes: int) -> Iterator[pa.RecordBatch]:
    """joined: runs and the bytes of their windows, which are taken out of it, so that they go as soon as they aren't needed."""
    windows, runs = joined.pop(), joined.pop()
    count = runs["count"].astype(np.int64)
    first = np.cumsum(count) - count
    _, back, times = np.unique(runs["anchor"], return_inverse=True, return_counts=True)
    keep = (times[back] > 1) | (runs["again"] > 0)  # other minimizers occur once: so do their windows
    runs, first, count = runs[keep], first[keep], count[keep]
    if not len(runs):
        return
    run = np.repeat(np.arange(len(runs)), count)
    step = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
    code = np.zeros((len(run), 8), np.uint8)
    code[:, :code_bytes] = windows.reshape(-1, code_bytes)[np.repeat(first, count) + step] if code_bytes else 0
    del windows
    key = _edge_keys(runs["anchor"][run], runs["offset"][run].astype(np.int64) - step, code.view(np.uint64)[:, 0])
    del code
    _, back, times = np.unique(key, return_inverse=True, return_counts=True)
    times = times[back]
    again = times > 1
    again |= runs["again"][run] > 0
    same = run[1:] == run[:-1]
    with np.errstate(over="ignore"):
        pair = C.mix64(key[:-1] * _STEP + key[1:])
    pair[~same] = np.arange(int((~same).sum()), dtype=np.uint64)  # no edge follows here
    _, back, follows = np.unique(pair, return_inverse=True, return_counts=True)
    follows = follows[back]
    chain = same & again[1:] & again[:-1] & (follows == times[1:]) & (follows == times[:-1])
    at = np.flatnonzero(np.append(True, ~chain))
    length = np.diff(np.append(at, len(run)))
    at, length = at[again[at]], length[again[at]]
    own, start, ids = runs[run[at]], runs["start"][run[at]] + step[at], _fragment_ids(key[at], length)
    del runs, run, step, key, pair, back, times, follows, same, chain, again, at
    yield from _spans(own, start, length, ids)


def repeated_fragments(docs: DataFrame, hot_runs: int = HOT_RUNS, code_bytes: int = CODE_BYTES) -> DataFrame:
    """(doc, no_id, text_key, start, length, fragment, n) of documents with their KEY and text: start counts words, length windows, n rows that are the same."""
    hot, windows = survey(docs, hot_runs)
    n = max(C.partitions(docs.sparkSession), math.ceil(windows / OWNER_WINDOWS))
    blocks = docs.mapInArrow(_blocks(n, hot, code_bytes), _BLOCK_DDL)
    return C.materialize(blocks.repartitionById(n, F.col("bucket")).mapInArrow(_own(code_bytes), _SPAN_DDL), "fragments")


def compact(fragments: DataFrame) -> DataFrame:
    """(doc, no_id, text_key, start, length, path): occurrences of paths, fragments glued at nonbranching nodes."""
    by_row = Window.partitionBy(*KEY).orderBy("start")
    # a row that is repeated has each fragment several times at the same place; owners have combined most of them
    e = fragments.repartition(*KEY).groupBy(*KEY, "start", "length", "fragment").agg(F.sum("n").alias("n"))
    e = e.withColumn("next", F.when(F.lead("start").over(by_row) == F.col("start") + F.col("length"), F.lead("fragment").over(by_row)))
    times = e.groupBy("fragment").agg(F.sum("n").alias("times"))
    follows = e.where("next is not null").groupBy("fragment", "next").agg(F.sum("n").alias("follows"))
    glued = follows.join(times, "fragment").where("follows = times").drop("times")
    glued = glued.join(times.withColumnRenamed("fragment", "next"), "next").where("follows = times").select("fragment", "next", F.lit(True).alias("glued"))
    e = e.join(glued, ["fragment", "next"], "left").withColumn("glued", F.coalesce("glued", F.lit(False)))
    e = e.withColumn("head", ~F.coalesce(F.lag("glued").over(by_row), F.lit(False)))
    e = e.withColumn("k", F.sum(F.col("head").cast("int")).over(by_row))
    return e.groupBy(*KEY, "k").agg(F.min("start").alias("start"), F.sum("length").cast("int").alias("length"), F.min_by("fragment", "start").alias("path")).drop("k")


def _digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


_SPANS = "array<struct<start:int,length:int,path:long>>"
_CHECK = pa.list_(pa.struct([("path", pa.int64()), ("digest", pa.binary())]))
_DONE = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), *(_SPAN.field(k) for k in KEY), ("checks", _CHECK)])
_DONE_DDL = "doc_id long, n_words long, n_removed long, kept_sha256 string, doc long, no_id boolean, text_key long, checks array<struct<path:long,digest:binary>>"


def _rows_with_spans(batches: Iterable[pa.RecordBatch]):
    """(row's batch, its number, words, starts, lengths, paths)"""
    for batch in batches:
        data, at = C.utf8_view(batch.column("text"))
        spans = batch.column("spans")
        edges, flat = spans.offsets.to_numpy(), spans.values  # offsets count from the start of values
        begin, length, path = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("start", "length", "path"))
        for i in range(batch.num_rows):
            s = slice(edges[i], edges[i + 1])
            yield batch, i, data[at[i] : at[i + 1]].tobytes().split(), begin[s], length[s], path[s]


def _remove(with_text: bool):
    schema = _DONE.append(pa.field("kept_text", pa.string())) if with_text else _DONE

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, _, words, begin, length, path in _rows_with_spans([batch]):
                kept, checks = words, []
                if len(begin):
                    cover = np.zeros(len(words) + 1, np.int32)
                    ends = begin + length + WINDOW - 1
                    np.add.at(cover, begin, 1)
                    np.add.at(cover, ends, -1)
                    kept = [words[k] for k in np.flatnonzero(np.cumsum(cover[:-1]) == 0)]
                    checks = [{"path": p, "digest": _digest(words[a:b])} for a, b, p in zip(begin.tolist(), ends.tolist(), path.tolist())]
                text = b" ".join(kept)
                row = (len(words), len(words) - len(kept), hashlib.sha256(text).hexdigest(), checks)
                out.append((*row, text.decode()) if with_text else row)
            cols = list(zip(*out)) if out else [[]] * (5 if with_text else 4)
            arrays = dict(zip(["n_words", "n_removed", "kept_sha256", "checks", "kept_text"], cols))
            yield pa.RecordBatch.from_arrays([pa.array(arrays[f.name], f.type) if f.name in arrays else batch.column(f.name) for f in schema], schema=schema)

    return run


def _window_digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, i, words, begin, length, _ in _rows_with_spans(batches):
        at = np.concatenate([np.arange(a, a + n) for a, n in zip(begin, length)]).tolist()
        keys = [pa.array([batch.column(k)[i].as_py()] * len(at), _SPAN.field(k).type) for k in KEY]
        yield pa.RecordBatch.from_arrays([*keys, pa.array(at, pa.int32()), pa.array([_digest(words[a : a + WINDOW]) for a in at], pa.binary())], names=[*KEY, "start", "digest"])


def _base(docs: DataFrame) -> DataFrame:
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), C.text_or_empty())
    return d.select("doc_id", "text", F.coalesce("doc_id", F.lit(0).cast("long")).alias("doc"), F.col("doc_id").isNull().alias("no_id"), F.xxhash64("text").alias("text_key"))


def _with_spans(base: DataFrame, spans: DataFrame, how: str) -> DataFrame:
    """base's rows with their spans; how: "left" for all of them, "inner" for those that have some."""
    lists = spans.groupBy(*KEY).agg(F.collect_list(F.struct("start", "length", "path")).alias("spans"))  # as many as a text has windows at most
    return base.join(lists, KEY, how).select("doc_id", "text", *KEY, F.coalesce("spans", F.array().cast(_SPANS)).alias("spans"))


def remove_repeats(docs: DataFrame, with_text: bool = False, hot_runs: int = HOT_RUNS, code_bytes: int = CODE_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, with_text, kept_text; one row per row of docs.

    A window is WINDOW consecutive words of one document; every word that is
    covered by a window whose words also start anywhere else goes, in all the
    places.  Null and empty texts have no words, and the hash of the empty
    string.  Rows are told apart by doc_id (null included) and text, so a
    repeated row counts as another place: its windows are all repeated.  Texts
    of fewer than WINDOW words stay as they are but for white space; texts of any
    length are cut in overlapping pieces.  An empty table gives no rows; other
    columns of docs are ignored.  code_bytes: the fewer, the more candidates that
    the words at their coordinates refute.
    """
    base = _base(docs)
    paths = compact(repeated_fragments(base, hot_runs, code_bytes))
    ddl, columns = _DONE_DDL + ", kept_text string" * with_text, ["doc_id", "n_words", "n_removed", "kept_sha256", *["kept_text"] * with_text]
    done = C.materialize(_with_spans(base, paths, "left").mapInArrow(_remove(with_text), ddl), "removed")
    checks = done.select(*KEY, F.explode("checks").alias("check")).select(*KEY, "check.path", "check.digest")
    kinds = checks.groupBy("path", "digest").agg(F.count("*").alias("n")).groupBy("path").agg(F.count("*").alias("kinds"))
    refuted = C.materialize(kinds.where("kinds > 1").select("path"), "refuted")
    if not refuted.limit(1).count():
        return done.select(*columns)
    # hashes collided: the windows of such paths are compared by their words, the rows that hold them done again
    paths = C.materialize(paths, "paths")
    again = C.materialize(checks.join(refuted, "path", "left_semi").select(*KEY).distinct(), "rows")
    digests = _with_spans(base, paths.join(refuted, "path", "left_semi"), "inner").mapInArrow(_window_digests, "doc long, no_id boolean, text_key long, start int, digest binary")
    digests = C.materialize(digests, "digests")
    twice = digests.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")
    found = digests.join(twice, "digest", "left_semi").select(*KEY, "start").distinct().select(*KEY, "start", F.lit(1).alias("length"), F.lit(0).cast("long").alias("path"))
    spans = paths.join(refuted, "path", "left_anti").join(again, KEY, "left_semi").unionByName(found)
    anew = _with_spans(base.join(again, KEY, "left_semi"), spans, "left").mapInArrow(_remove(with_text), ddl)
    return done.join(again, KEY, "left_anti").select(*columns).unionByName(anew.select(*columns))
