"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

Pieces and their log scores come from a public model file.  A unigram model's
scores are log probabilities; those of a BPE model are the ranks of its merges,
from which Zipf's law gives log probabilities without any training.  As no piece
of such files holds the white-space marker after another character, the best path
splits at markers, and within long words wherever no piece goes across; every
distinct word is encoded once, many words at a time.
"""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

MARK = "▁"
UNK_PENALTY = 10.0
CACHE_WORDS = 500_000
#: Mandelbrot's shift of ranks in Zipf's law.
SHIFT = 2.7
#: Characters of a word beyond which it is cut, and bytes of what is left uncut beyond which it is encoded by itself.
LONG_WORD, ALONE = 48, 256
BPE = 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_LONG = re.compile(f"[^{MARK}]{{{LONG_WORD}}}|{MARK}{{{LONG_WORD}}}")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _fields(b: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of a protocol-buffer message."""
    i, n = 0, len(b)

    def varint() -> int:
        nonlocal i
        x = shift = 0
        while True:
            c = b[i]
            i += 1
            x |= (c & 127) << shift
            shift += 7
            if c < 128:
                return x

    while i < n:
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            size = varint()
            yield tag >> 3, b[i : i + size]
            i += size
        else:
            size = 4 if kind == 5 else 8
            yield tag >> 3, b[i : i + size]
            i += size


def log_scores(scores: np.ndarray, types: np.ndarray, model_type: int) -> np.ndarray:
    """Log probabilities of pieces, in steps of 2**-16 so that sums of them are exact: a BPE model's scores are negated ranks r, whose share is 1 / (r + SHIFT)."""
    normal = types == NORMAL
    if model_type == BPE and normal.any():
        share = np.where(normal, 1 / (scores[normal].max() - scores + SHIFT), 0)
        scores = np.where(normal, np.log(share / share.sum(), where=normal, out=np.zeros(len(share))), scores)
    return np.round(scores * 65536) / 65536


def read_model(path: str) -> dict:
    """Pieces (as bytes), scores, types and switches of a SentencePiece model file."""
    with open(path, "rb") as f:
        blob = f.read()
    pieces, scores, types = [], [], []
    flags = {"byte_fallback": False, "dummy_prefix": True, "squeeze": True, "escape": True, "charsmap": b"", "model_type": 1}
    for k, v in _fields(blob):
        if k == 1:
            d = dict(_fields(v))
            pieces.append(d[1])
            scores.append(struct.unpack("<f", d[2])[0] if 2 in d else 0.0)
            types.append(d.get(3, NORMAL))
        elif k == 2:
            d = dict(_fields(v))
            flags["byte_fallback"], flags["model_type"] = bool(d.get(35, 0)), d.get(3, 1)
        elif k == 3:
            d = dict(_fields(v))
            flags |= {"charsmap": d.get(2, b""), "dummy_prefix": bool(d.get(3, 1)), "squeeze": bool(d.get(4, 1)), "escape": bool(d.get(5, 1))}
    if flags["charsmap"] or flags["squeeze"] or not flags["escape"]:
        raise ValueError("only models that leave their text as it is are read")
    types = np.array(types)
    return {"pieces": pieces, "scores": log_scores(np.array(scores), types, flags["model_type"]), "types": types, **flags}


class DoubleArray:
    """A double-array trie over byte strings: the child of s by byte c is base[s] + c + 1 where check says s; value is the key's number or -1."""

    def __init__(self, keys: list[bytes], values: list[int]):
        order = sorted(range(len(keys)), key=keys.__getitem__)
        keys, values = [keys[i] for i in order], [values[i] for i in order]
        size = 1 << 16
        self.base, self.check, self.value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        used = np.zeros(size, bool)
        used[0] = True
        self.check[0] = 0
        low, crowded = 1, 0  # no free slot is below low; nodes with several children are looked for from crowded on
        stack = [(0, 0, len(keys), 0)]
        while stack:
            node, a, b, depth = stack.pop()
            if a < b and len(keys[a]) == depth:
                self.value[node] = values[a]
                a += 1
            if a == b:
                continue
            heads: list[tuple[int, int]] = []
            for i in range(a, b):
                c = keys[i][depth]
                if not heads or heads[-1][0] != c:
                    heads.append((c, i))
            codes = np.array([c + 1 for c, _ in heads])
            while used[low]:
                low += 1
            at, seen = -1, low if len(codes) == 1 else max(low, crowded)
            while at < 0:
                while seen + 5000 > len(used):
                    grow = len(used)
                    self.base = np.concatenate([self.base, np.zeros(grow, np.int32)])
                    self.check = np.concatenate([self.check, np.full(grow, -1, np.int32)])
                    self.value = np.concatenate([self.value, np.full(grow, -1, np.int32)])
                    used = np.concatenate([used, np.zeros(grow, bool)])
                first = seen + np.flatnonzero(~used[seen : seen + 4096]) - codes[0]
                first = first[first >= 0]
                fits = np.flatnonzero(~used[first[:, None] + codes[None, :]].any(1)) if len(codes) > 1 else np.arange(min(1, len(first)))
                if len(fits):
                    at = int(first[fits[0]])
                else:
                    seen += 4096
            if len(codes) > 1:
                crowded = max(crowded, at + int(codes[0]) - 2048)
            self.base[node] = at
            used[at + codes] = True
            self.check[at + codes] = node
            ends = [i for _, i in heads[1:]] + [b]
            stack.extend((at + c + 1, i, e, depth + 1) for (c, i), e in zip(heads, ends))
        pad = np.full(300, -1, np.int32)
        self.base, self.check, self.value = np.concatenate([self.base, np.zeros(300, np.int32)]), np.concatenate([self.check, pad]), np.concatenate([self.value, pad])


class Unigram:
    """A model ready to encode and decode."""

    def __init__(self, path: str, trie: DoubleArray | None = None):
        m = read_model(path)
        self.pieces, self.types, self.scores = m["pieces"], m["types"], m["scores"]
        self.dummy_prefix, self.byte_fallback = m["dummy_prefix"], m["byte_fallback"]
        normal = [i for i, t in enumerate(self.types) if t in (NORMAL, USER)]
        mark = MARK.encode()
        if any(mark in self.pieces[i].lstrip(b"\xe2\x96\x81") for i in normal):
            raise ValueError("a piece holds the white-space marker after another character")
        self.unk = int(np.flatnonzero(self.types == UNKNOWN)[0])
        self.unk_score = float(self.scores[normal].min()) - UNK_PENALTY
        self.byte_id = np.full(256, self.unk, np.int64)
        for i in np.flatnonzero(self.types == BYTE):
            self.byte_id[int(self.pieces[i][3:-1], 16)] = i
        self.trie = trie or DoubleArray([self.pieces[i] for i in normal], normal)
        self.out = [b"" if t == CONTROL else " ⁇ ".encode() if t == UNKNOWN else bytes([int(p[3:-1], 16)]) if t == BYTE else p.replace(mark, b" ") for p, t in zip(self.pieces, self.types)]
        self.longest = max(len(self.pieces[i]) for i in normal)
        self.lists: tuple | None = None
        self._reset()

    def _reset(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 20, np.int32), 0
        self.starts, self.lens = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def viterbi(self, words: list[bytes]) -> list[list[int]]:
        """Ids of the best path of every word; of equal paths the one whose last piece is longest, as in lattice order."""
        ids, counts = self.paths(words)
        ends = np.cumsum(counts).tolist()
        flat = ids.tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def paths(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words on end, number of ids of each)."""
        by_size = sorted(range(len(words)), key=lambda i: len(words[i]))
        parts: list[tuple] = []
        while by_size and len(words[by_size[-1]]) > ALONE:
            i = by_size.pop()
            ids = self._one(words[i])
            parts.append(([i], ids, [len(ids)]))
        a = 0
        while a < len(by_size):
            size = len(words[by_size[a]])
            b = a
            while b < len(by_size) and b - a < 50_000 and len(words[by_size[b]]) <= size + size // 8:
                b += 1
            parts.append((by_size[a:b], *self._batch([words[i] for i in by_size[a:b]])))
            a = b
        if not parts:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        who, ids, n = (np.concatenate([np.asarray(p[k], np.int64) for p in parts]) for k in range(3))
        counts, starts = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        counts[who], starts[who] = n, np.cumsum(n) - n
        ends = np.cumsum(counts)
        return ids[np.arange(ends[-1]) + np.repeat(starts - (ends - counts), counts)].astype(np.int32), counts

    def _batch(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        n, lens = len(words), np.array([len(w) for w in words])
        width = int(lens.max()) if n else 0
        text = np.zeros((width + 1, n), np.int32)
        for i, w in enumerate(words):
            text[: len(w), i] = np.frombuffer(w, np.uint8)
        best = np.full((width + 1, n), -np.inf)
        best[0] = 0
        back = np.zeros((width + 1, n), np.int32)
        piece = np.zeros((width + 1, n), np.int32)
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        for s in range(width):
            c = text[s]
            live = np.flatnonzero((s < lens) & ((c & 0xC0) != 0x80) & (best[s] > -np.inf))
            if not len(live):
                continue
            lead = c[live]
            step = np.where(lead < 0x80, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4)))
            single = np.zeros(len(live), bool)
            who, state, slot = live, np.zeros(len(live), np.int32), np.arange(len(live))
            for j in range(s, width):
                nxt = base[state] + text[j, who] + 1
                ok = (check[nxt] == state) & (j < lens[who])
                who, state, slot = who[ok], nxt[ok], slot[ok]
                if not len(who):
                    break
                v = value[state]
                hit = np.flatnonzero(v >= 0)
                if len(hit):
                    w, p = who[hit], v[hit]
                    single[slot[hit]] |= step[slot[hit]] == j + 1 - s
                    score = best[s, w] + self.scores[p]
                    up = score > best[j + 1, w]
                    w = w[up]
                    best[j + 1, w], back[j + 1, w], piece[j + 1, w] = score[up], s, p[up]
            for k in np.unique(step[~single]):
                w = live[~single & (step == k)]
                to = s + int(k)
                score = best[s, w] + self.unk_score
                up = score > best[to, w]
                w = w[up]
                best[to, w], back[to, w], piece[to, w] = score[up], s, self.unk
        return self._trace(words, lens, back, piece)

    def _trace(self, words: list[bytes], lens: np.ndarray, back: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The paths of a batch, all words one piece further back at a time; unknown characters become the pieces of their bytes."""
        at, who = lens.copy(), np.flatnonzero(lens)
        owners, ids, keys = [], [], []
        while len(who):
            end, p = at[who], piece[at[who], who]
            at[who] = begin = back[end, who]
            if self.byte_fallback and (lost := np.flatnonzero(p == self.unk)).size:
                own = [(who[i], words[who[i]][begin[i] : end[i]], begin[i]) for i in lost.tolist()]
                owners.append(np.repeat([o for o, _, _ in own], [len(b) for _, b, _ in own]))
                ids.append(self.byte_id[np.frombuffer(b"".join(b for _, b, _ in own), np.uint8)])
                keys.append(np.concatenate([np.arange(k, k + len(b)) for _, b, k in own]))
                known = p != self.unk
                owners.append(who[known])
                ids.append(p[known])
                keys.append(begin[known])
            else:
                owners.append(who)
                ids.append(p)
                keys.append(begin)
            who = who[at[who] > 0]
        if not owners:
            return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
        owner, found, key = np.concatenate(owners), np.concatenate(ids), np.concatenate(keys)
        order = np.lexsort((key, owner))
        return found[order], np.bincount(owner, minlength=len(words))

    def _one(self, word: bytes) -> list[int]:
        """_batch() for one long word, by plain loops."""
        if self.lists is None:
            self.lists = (self.trie.base.tolist(), self.trie.check.tolist(), self.trie.value.tolist(), self.scores.tolist())
        base, check, value, scores = self.lists
        n, low = len(word), -math.inf
        best, back, piece = [0.0] + [low] * n, [0] * (n + 1), [0] * (n + 1)
        for s in range(n):
            c = word[s]
            here = best[s]
            if c & 0xC0 == 0x80 or here == low:
                continue
            single = s + (1 if c < 0x80 else 2 if c < 0xE0 else 3 if c < 0xF0 else 4)
            state, known = 0, False
            for e in range(s + 1, n + 1):
                nxt = base[state] + word[e - 1] + 1
                if check[nxt] != state:
                    break
                state = nxt
                p = value[state]
                if p >= 0:
                    known |= e == single
                    if here + scores[p] > best[e]:
                        best[e], back[e], piece[e] = here + scores[p], s, p
            if not known and here + self.unk_score > best[single]:
                best[single], back[single], piece[single] = here + self.unk_score, s, self.unk
        return self._path(word, back, piece)

    def _path(self, word: bytes, back, piece) -> list[int]:
        ids, at = [], len(word)
        while at:
            s, p = int(back[at]), int(piece[at])
            ids.extend([int(self.byte_id[x]) for x in reversed(word[s:at])] if p == self.unk and self.byte_fallback else [p])
            at = s
        return ids[::-1]

    def cuts(self, word: bytes) -> list[int]:
        """Places within a word that no piece goes across, so that the best path has an edge there."""
        c = np.frombuffer(word, np.uint8).astype(np.int32)
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        out, far = [], 0
        for a in range(0, len(c), 1 << 20):
            b = min(a + (1 << 20), len(c))
            lead = c[a:b]
            who = a + np.flatnonzero((lead & 0xC0) != 0x80)
            first = c[who]
            reach = np.zeros(b - a, np.int64)
            reach[who - a] = who + np.where(first < 0x80, 1, np.where(first < 0xE0, 2, np.where(first < 0xF0, 3, 4)))
            state, at = np.zeros(len(who), np.int32), who.copy()
            while len(who):
                nxt = base[state] + c[np.minimum(at, len(c) - 1)] + 1
                ok = (at < len(c)) & (check[nxt] == state)
                who, state, at = who[ok], nxt[ok], at[ok] + 1
                hit = value[state] >= 0
                reach[who[hit] - a] = np.maximum(reach[who[hit] - a], at[hit])
            reach[0] = max(reach[0], far)
            reach = np.maximum.accumulate(reach)
            far = int(reach[-1])
            place = np.arange(a + 1, b + 1)
            out.append(place[(reach <= place) & (place < len(c))])
        return np.concatenate(out).tolist() if out else []

    def words(self, text: str) -> list[str]:
        """The text with markers, cut where a marker follows another character; long words are cut further."""
        if not text:
            return []
        text = text.replace(" ", MARK)
        text = MARK + text if self.dummy_prefix else text
        found = _WORD.findall(text)
        if not _LONG.search(text):
            return found
        out: list[str] = []
        for w in found:
            if len(w) <= LONG_WORD:
                out.append(w)
            else:
                b = w.encode("utf-8", "surrogatepass")
                edges = [0, *self.cuts(b), len(b)]
                out += [b[x:y].decode("utf-8", "surrogatepass") for x, y in zip(edges, edges[1:])]
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts on end, number of ids of each)."""
        if len(self.index) > CACHE_WORDS:
            self._reset()
        flat: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            some = self.words(t)
            counts[i] = len(some)
            flat += some
        look = self.index
        if missing := list(dict.fromkeys(w for w in flat if w not in look)):
            fresh, n = self.paths([w.encode("utf-8", "surrogatepass") for w in missing])
            while self.used + len(fresh) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(fresh)), np.int32)])
            self.flat[self.used : self.used + len(fresh)] = fresh
            look.update(zip(missing, range(len(look), len(look) + len(missing))))
            self.starts, self.lens = np.concatenate([self.starts, self.used + np.cumsum(n) - n]), np.concatenate([self.lens, n])
            self.used += len(fresh)
        at = np.fromiter(map(look.__getitem__, flat), np.int64, len(flat))
        lens, starts = self.lens[at], self.starts[at]
        ends = np.cumsum(lens)
        ids = self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lens), lens)]
        return ids, np.diff(np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])])

    def decode(self, ids: Iterable[int]) -> str:
        """Text of ids: markers become spaces, the prefix's space goes, runs of byte pieces are read as UTF-8 (U+FFFD where they aren't)."""
        text = b"".join(map(self.out.__getitem__, ids))
        if self.dummy_prefix and text[:1] == b" ":
            text = text[1:]
        return text.decode("utf-8", "replace")


_models: dict[str, Unigram] = {}


def model(path: str, trie: DoubleArray | None = None) -> Unigram:
    """The model of a file, kept for the life of a Python process; trie: one built elsewhere."""
    if path not in _models:
        _models[path] = Unigram(path, trie)
    return _models[path]


_OUT = pa.schema([("doc_id", pa.int64()), ("n_pieces", pa.int64()), ("n_byte_pieces", pa.int64()), ("ids_crc32", pa.int64()), ("round_trip", pa.bool_())])
_DDL = "doc_id long, n_pieces long, n_byte_pieces long, ids_crc32 long, round_trip boolean"


def encode_documents(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, n_pieces, n_byte_pieces, ids_crc32 (little-endian 32-bit ids), round_trip and, with_ids, ids; a row per row of docs.

    round_trip says whether decoding gives the text again; a text that holds the
    marker U+2581 doesn't.  Null and empty texts have no pieces; texts of any
    length, without spaces too, take time in proportion.  Null doc_ids
    and repeated rows are encoded like any other; nothing is shuffled; an empty
    table gives no rows; other columns of docs are ignored.
    """
    import zlib

    where = path or default_path()
    trie = docs.sparkSession.sparkContext.broadcast(model(where).trie)  # as large as the model, whatever the input
    schema = _OUT.append(pa.field("ids", pa.list_(pa.int32()))) if with_ids else _OUT

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(where, trie.value)
        is_byte = m.types == BYTE
        for batch in batches:
            _, at = C.utf8_view(batch.column("text"))
            rows = []
            for a, b in C.row_chunks(at):
                texts = batch.column("text").slice(a, b - a).to_pylist()
                ids, counts = m.encode(texts)
                edge = np.concatenate([[0], np.cumsum(counts)])
                for i, t in enumerate(texts):
                    own = ids[edge[i] : edge[i + 1]]
                    row = (len(own), int(is_byte[own].sum()), zlib.crc32(own.astype("<u4").tobytes()), m.decode(own.tolist()) == t)
                    rows.append((*row, own) if with_ids else row)
            cols = list(zip(*rows)) if rows else [[]] * (len(schema) - 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, f.type) for x, f in zip(cols, list(schema)[1:]))], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), C.text_or_empty()).mapInArrow(run, _DDL + (", ids array<int>" if with_ids else ""))
