"""Embedding near-duplicates by randomised-rotation binary codes.

A unit vector is rotated at random and stored as the signs of its coordinates
with a correction factor, the inner product of the rotated vector with its own
code.  Code and factor give an unbiased estimate of an inner product with a
confidence bound of order 1 / sqrt(bits): pairs whose upper bound is below the
threshold are dropped, all others are recomputed exactly in double precision.
Pairs are looked for where samples of the code agree (see pairing.py); bits and
tables are planned for the number of vectors so that a pair exactly at the
threshold is missed with probability MISS at most.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .components import connected_components
from .pairing import BLOCK, Kernel, link_pairs, oversized, sample_of, with_blocks

THRESHOLD, BITS, SEED, MISS = 0.98, 256, 5, 1e-4
#: Standard deviations (of order 1 / sqrt(BITS)) that the confidence bound allows for.
EPSILON = 4.0


def rotation(dim: int, bits: int = BITS) -> np.ndarray:
    """max(bits, dim) x dim with orthonormal columns: a random rotation of vectors padded with zeros."""
    size = max(bits, dim)
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((size, size)))
    return (q * np.sign(np.diag(r)))[:, :dim]


def encode(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signs as packed bits, correction factors) of unit vectors."""
    y = unit @ rotation(unit.shape[1]).T
    return np.packbits(y > 0, axis=1, bitorder="little"), np.abs(y).sum(1) / math.sqrt(y.shape[1])


def estimate(dot: np.ndarray, factor: np.ndarray, size: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """(unbiased estimates, error bounds) of inner products, from those of the first vectors' signs (as 1 and -1, `size` of them) with the second ones, rotated."""
    return dot / np.sqrt(size) / factor, EPSILON * np.sqrt(np.maximum(1 - factor**2, 0)) / factor / np.sqrt(np.maximum(size - 1, 1))


def plan_tables(n: int, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, int]:
    """(sampled bits, tables) for n distinct vectors."""
    bits = min(40, max(10, math.ceil(math.log2(max(n, 2) / 64))))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log(1 - agree))


def _keys(bits: int, tables: int, sample: np.ndarray, out: pa.Schema):
    weights = np.uint64(1) << np.arange(bits, dtype=np.uint64)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            vectors = whole.column("embedding")
            dims = np.diff(vectors.offsets.to_numpy())
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                for a in range(0, len(at), 1000):
                    take = at[a : a + 1000]
                    values = vectors.take(pa.array(take)).flatten().to_numpy().astype(np.float32).reshape(-1, dim)
                    unit = values.astype(np.float64)
                    unit /= np.sqrt(np.einsum("ij,ij->i", unit, unit))[:, None]
                    code, factor = encode(unit)
                    on = np.unpackbits(code, axis=1, bitorder="little").astype(np.uint64)
                    label = whole.column("label").take(pa.array(take)).to_numpy(zero_copy_only=False).astype(np.int64)
                    base = C.mix64(label.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(dim))
                    key = np.stack([C.mix64(base + (((on[:, s] * weights).sum(1) << np.uint64(8)) | np.uint64(t))) for t, s in enumerate(sample)], axis=1)
                    r = np.repeat(np.arange(len(take)), tables)
                    pick = pa.array(take[r])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(key.ravel().view(np.int64)), pa.array(np.tile(np.arange(tables, dtype=np.int32), len(take))), whole.column("id").take(pick), whole.column("n").take(pick),
                            whole.column("label").cast(pa.int64()).take(pick), pa.array([x.tobytes() for x in code], pa.binary()).take(pa.array(r)),
                            pa.array(factor[r].astype(np.float32)), pa.array([x.tobytes() for x in values], pa.binary()).take(pa.array(r)),
                        ],
                        schema=out,
                    )

    return run


class _Kernel(Kernel):
    def __init__(self, sample: np.ndarray, threshold: float):
        self.sample, self.threshold = sample, threshold

    def load(self, table: pa.Table) -> dict:
        vectors = table.column("vector").to_pylist()
        dims = np.fromiter((len(v) // 4 for v in vectors), np.int64, len(vectors))
        width = int(dims.max())
        unit = np.zeros((len(vectors), width))
        rotated = np.zeros((len(vectors), max(BITS, width)), np.float32)
        bits = np.zeros(rotated.shape, np.uint8)
        packed = table.column("code").to_pylist()
        for dim in np.unique(dims):
            at = np.flatnonzero(dims == dim)
            size = max(BITS, int(dim))
            x = np.frombuffer(b"".join(vectors[i] for i in at), np.float32).reshape(-1, dim).astype(np.float64)
            unit[at, :dim] = x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
            rotated[at, :size] = unit[at, :dim] @ rotation(int(dim)).T
            bits[at, :size] = np.unpackbits(np.frombuffer(b"".join(packed[i] for i in at), np.uint8).reshape(len(at), -1), axis=1, bitorder="little")[:, :size]
        return {"unit": unit, "dims": dims, "size": np.maximum(BITS, dims), "bits": bits, "rotated": rotated, "factor": table.column("factor").to_numpy().astype(np.float64), "label": table.column("label").to_numpy(), "t": table.column("t").to_numpy()}

    def near(self, s: dict, rows: np.ndarray):
        signs, rotated = s["bits"][rows].astype(np.float32) * 2 - 1, s["rotated"][rows]

        def may_link(r: int, to: int, first: int, last: int) -> np.ndarray:
            value, bound = estimate(signs[r:to] @ rotated[first:last].T, s["factor"][rows[r:to], None], s["size"][rows[r:to], None])
            return value + bound >= self.threshold

        return may_link

    def match(self, s: dict, i: np.ndarray, j: np.ndarray, _: int) -> np.ndarray:
        ok, sample = np.zeros(len(i), bool), self.sample
        for a in range(0, len(i), 1 << 13):
            x, y = i[a : a + (1 << 13)], j[a : a + (1 << 13)]
            same = (s["label"][x] == s["label"][y]) & (s["dims"][x] == s["dims"][y])
            dot = np.einsum("ij,ij->i", s["bits"][x].astype(np.float32) * 2 - 1, s["rotated"][y])
            value, bound = estimate(dot, s["factor"][x], s["size"][x])
            near = np.flatnonzero(same & (value + bound >= self.threshold))
            near = near[np.einsum("ij,ij->i", s["unit"][x[near]], s["unit"][y[near]]) >= self.threshold]
            for t in range(len(sample)):
                p, q = x[near], y[near]
                near = near[(s["t"][p] <= t) | (s["bits"][p][:, sample[t]] != s["bits"][q][:, sample[t]]).any(1)]
            ok[a + near] = True
        return ok


def vector_groups(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept.

    Rows are linked when their labels are equal and not null, their vectors have
    as many components, and the cosine, in double precision over components as
    single-precision floats, is >= threshold.  Vectors that are null, empty, zero
    or hold null or non-finite components link with nothing; such a row is its
    own component.  Equal vectors are one class internally: a repeated row counts
    as another vector.  A row with a null vec_id links, and is kept where its
    component holds no vec_id.  Codes that agree, however many, are cut into
    blocks by a hash of the row (see pairing.py).  An empty table gives an empty result; other
    columns are ignored.
    """
    v = F.col("embedding")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<float>").alias("embedding"), F.col(label_col).cast("long").alias("label"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = rows.withColumn("linkable", F.coalesce(v.isNotNull() & F.col("label").isNotNull() & (F.size(v) > 0) & finite, F.lit(False)))
    classes = rows.where("linkable").groupBy("label", "embedding").agg(F.min("vec_id").alias("class_id"), F.count("*").alias("n"))
    classes = C.materialize(classes.withColumn("id", F.monotonically_increasing_id()), "vectors")
    n = classes.count()
    bits, tables = plan_tables(n, threshold)
    rng = np.random.default_rng(SEED + 1)
    sample = np.array([rng.choice(BITS, bits, replace=False) for _ in range(tables)])
    out = pa.schema([("key", pa.int64()), ("t", pa.int32()), ("id", pa.int64()), ("n", pa.int64()), ("label", pa.int64()), ("code", pa.binary()), ("factor", pa.float32()), ("vector", pa.binary())])
    ddl = "key long, t int, id long, n long, label long, code binary, factor float, vector binary"
    rows_in = classes.select("id", "n", "label", "embedding")
    keys = lambda rows: rows.mapInArrow(_keys(bits, tables, sample, out), ddl)
    big = oversized(keys(sample_of(rows_in, share := min(16, max(1, block // 64)))).select("key"), share, block) if n > block else (None, 0)
    found = link_pairs(with_blocks(keys(rows_in), *big, block), ["t", "label", "code", "factor", "vector"], _Kernel(sample, threshold))
    found = C.materialize(found, "links")
    degree = found.where("other is null").groupBy("id").agg(F.sum("links").alias("links"))
    component = connected_components(found.where("other is not null"), "id", "other")
    linked = classes.join(degree, "id", "left").join(component, "id", "left").withColumn("component", F.coalesce("component", "id"))
    smallest = linked.groupBy("component").agg(F.min("class_id").alias("component_id"))
    linked = linked.join(smallest, "component").select("label", "embedding", "component_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    alone = rows.where(~F.col("linkable")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    done = rows.where("linkable").join(linked, ["label", "embedding"]).select("vec_id", "n_links", "component_id").unionByName(alone)
    return done.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
