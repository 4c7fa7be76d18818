"""Two tables dealt into blocks that meet in cells, and the numpy kernels that compare a cell.

Every row of the left meets every row of the right in exactly one cell. A block is one row with an
array; a cell is one task's work, so that nothing is broadcast and no key is hot.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

#: A tile of keys that are compared at once: small enough for a core's cache.
ROWS, COLUMNS = 8, 8192
#: Pairs that a task gathers before it sends or merges them.
FLUSH = 1 << 20


def pack(df: DataFrame, n: int, key: str) -> DataFrame:
    """(block, items): the rows of df as structs, dealt by key into n blocks."""
    return df.groupBy(F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias("block")).agg(F.collect_list(F.struct(*df.columns)).alias("items"))


def cells(left: DataFrame, n: int, right: DataFrame, m: int, upper: bool = False) -> DataFrame:
    """(same, l, r) of every cell of two packed tables of n and m blocks; upper: cells i <= j of one table with itself."""

    def dealt(df: DataFrame, i: Column, j: Column, name: str) -> DataFrame:
        # an own number of partitions is not coalesced: the bytes of a block say little about its work
        return df.select((i * m + j).alias("cell"), (i == j).alias("same"), F.col("items").alias(name)).repartition(min(10_000, n * (n + 1) if upper else 2 * n * m), "cell")

    one = F.col("block")
    a = left.withColumn("other", F.explode(F.sequence(one if upper else F.lit(0), F.lit(m - 1))))
    b = right.withColumn("other", F.explode(F.sequence(F.lit(0), one if upper else F.lit(n - 1))))
    pairs = dealt(a, one, F.col("other"), "l").join(dealt(b, F.col("other"), one, "r").drop("same").hint("merge"), "cell")
    return pairs.select((F.col("same") if upper else F.lit(False)).alias("same"), "l", "r")


def _each(run: Callable[[bool, list[pa.Array], list[pa.Array]], Iterator[list]], names: list[str]) -> Callable[[Iterator], Iterator]:
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same, left, right = batch.columns
            for k in range(batch.num_rows):
                for out in run(same[k].as_py(), left[k].values.flatten(), right[k].values.flatten()):
                    yield pa.RecordBatch.from_arrays(out, names)

    return over


def _near(left: np.ndarray, right: np.ndarray, radius: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, distance) of all 64-bit keys within the radius, i < j where both sides are the same."""
    for c in range(0, len(right), COLUMNS):
        r = right[c : c + COLUMNS]
        x, d = np.empty((ROWS, len(r)), np.uint64), np.empty((ROWS, len(r)), np.uint8)
        for a in range(0, min(len(left), c + len(r)) if same else len(left), ROWS):
            of = left[a : a + ROWS]
            np.bitwise_xor(of[:, None], r[None], out=x[: len(of)])
            np.bitwise_count(x[: len(of)], out=d[: len(of)])
            hit = np.flatnonzero(d[: len(of)] <= radius)
            if len(hit):
                i, j, near = hit // len(r) + a, hit % len(r) + c, d.ravel()[hit]
                if same:
                    later = i < j
                    i, j, near = i[later], j[later], near[later]
                yield i, j, near


def _gathered(parts: Iterator[tuple[np.ndarray, ...]]) -> Iterator[list[np.ndarray]]:
    held: list[tuple[np.ndarray, ...]] = []
    size = 0
    for p in parts:
        held.append(p)
        size += len(p[0])
        if size >= FLUSH:
            yield [np.concatenate(x) for x in zip(*held, strict=True)]
            held, size = [], 0
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _keys(a: pa.Array) -> np.ndarray:
    return a.to_numpy(zero_copy_only=False).view(np.uint64)


def near_pairs(keys: DataFrame, n: int, radius: int) -> DataFrame:
    """(x, y, distance) of all pairs of rows (id, k) whose 64-bit keys k lie within the radius, each once."""

    def run(same: bool, left: list[pa.Array], right: list[pa.Array]) -> Iterator[list]:
        for i, j, d in _gathered(_near(_keys(left[1]), _keys(right[1]), radius, same)):
            yield [left[0].take(pa.array(i)), right[0].take(pa.array(j)), pa.array(d.astype(np.int32))]

    of = keys.schema["id"].dataType
    packed = pack(keys, n, "id")
    return cells(packed, n, packed, n, True).mapInArrow(_each(run, ["x", "y", "distance"]), StructType([StructField("x", of), StructField("y", of), StructField("distance", IntegerType())]))


def merged(labels: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Component labels after the edges (u, v): each the smallest node, labels[x] <= x."""
    while True:
        a, b = labels[u], labels[v]
        apart = a != b
        if not apart.any():
            return labels
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(further := labels[labels], labels):
            labels = further


def near_forest(keys: DataFrame, n: int, radius: int) -> DataFrame:
    """(a, b): edges that connect what ``near_pairs`` connects, at most one for each row of a cell."""

    def run(same: bool, left: list[pa.Array], right: list[pa.Array]) -> Iterator[list]:
        a, b = _keys(left[1]), _keys(right[1])
        both = np.concatenate([a] if same else [a, b])
        distinct, first, inverse = np.unique(both, return_index=True, return_inverse=True)
        labels = first[inverse]  # equal keys are one node
        a, at = np.unique(a, return_index=True)
        b, bt = (a, at) if same else np.unique(b, return_index=True)
        for i, j, _ in _gathered(_near(a, b, radius, same)):
            labels = merged(labels, at[i], bt[j] + (0 if same else len(left[0])))
        ids = left[0] if same else pa.concat_arrays([left[0], right[0]])
        other = np.flatnonzero(labels != np.arange(len(labels)))
        yield [ids.take(pa.array(other)), ids.take(pa.array(labels[other]))]

    of = keys.schema["id"].dataType
    packed = pack(keys, n, "id")
    return cells(packed, n, packed, n, True).mapInArrow(_each(run, ["a", "b"]), StructType([StructField("a", of), StructField("b", of)]))


def _matrix(vectors: pa.Array) -> np.ndarray:
    lengths = pc.list_value_length(vectors)
    values = vectors.flatten()
    if lengths.null_count or values.null_count or len(pc.unique(lengths)) > 1:
        raise ValueError("vectors differ in dimension")
    return values.to_numpy().reshape(len(vectors), -1)


def best_scores(queries: DataFrame, n: int, refs: DataFrame, m: int) -> DataFrame:
    """Each cell's best (query_id, entity, similarity, ref_id): queries (query_id, qv), refs (ref_id, entity, rv), vectors of doubles.

    A matrix product finds what may be best. Only those get their similarity, summed from the first
    dimension to the last, so that equal vectors tie wherever they lie; the larger ref_id wins ties.
    """

    def run(same: bool, left: list[pa.Array], right: list[pa.Array]) -> Iterator[list]:
        code = right[1].dictionary_encode(null_encoding="encode")
        by = np.argsort(code.indices.to_numpy(zero_copy_only=False), kind="stable")
        codes = code.indices.to_numpy(zero_copy_only=False)[by]
        starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
        counts = np.diff(np.r_[starts, len(codes)])
        group = np.repeat(np.arange(len(starts)), counts)
        place = np.empty(len(by), np.int64)
        place[pc.sort_indices(right[0], null_placement="at_start").to_numpy()] = np.arange(len(by))
        q, r = _matrix(left[1]), _matrix(right[2])[by]
        if q.shape[1] != r.shape[1]:
            raise ValueError("vectors differ in dimension")
        with np.errstate(all="ignore"):
            slack = 8 * (q.shape[1] + 1) * np.finfo(np.float64).eps * np.sqrt((q * q).sum(1)) * np.sqrt((r * r).sum(1).max())
            slack = np.where(np.isfinite(slack), slack, 0)
            step = max(1, (1 << 21) // len(r))
            for a in range(0, len(q), step):
                s = q[a : a + step] @ r.T
                top = np.maximum.reduceat(s, starts, axis=1)
                if np.isnan(top).any():  # not a number counts as largest
                    s = np.where(np.isnan(s), np.inf, s)
                    top = np.maximum.reduceat(s, starts, axis=1)
                i, j = np.nonzero(s >= np.repeat(top - slack[a : a + step, None], counts, axis=1))
                exact = np.zeros(len(i))
                for k in range(q.shape[1]):
                    exact += q[a + i, k] * r[j, k]
                order = np.lexsort((place[by[j]], exact, group[j], i))  # sorts not a number last
                i, j, exact = i[order], j[order], exact[order]
                last = np.flatnonzero(np.r_[(i[1:] != i[:-1]) | (group[j[1:]] != group[j[:-1]]), True])
                i, j = i[last], by[j[last]]
                yield [left[0].take(pa.array(a + i)), right[1].take(pa.array(j)), pa.array(exact[last]), right[0].take(pa.array(j))]

    schema = StructType([StructField("query_id", queries.schema["query_id"].dataType), StructField("entity", refs.schema["entity"].dataType), StructField("similarity", DoubleType()), StructField("ref_id", refs.schema["ref_id"].dataType)])
    met = cells(pack(queries.select("query_id", "qv"), n, "query_id"), n, pack(refs.select("ref_id", "entity", "rv"), m, "ref_id"), m)
    return met.mapInArrow(_each(run, schema.names), schema)
