"""N-gram Jaccard join by chosen paths: split on sampled shared tokens until buckets are small.

Every distinct shingle set gets a sketch of min-hashes, the tokens of the chosen-path tree. A node
samples one coordinate, or two with probability 1/4 (1 / 0.8 on average), and sends each set to the
child of its token there, so two sets at the threshold keep meeting in one child on average. Nodes
of more than LEAF sets split again; smaller buckets are brute-forced on sketches, one matrix
comparison each. Runs repeat, for the sets whose leaves lay deep, until a pair at the threshold is
met with the target probability.

Sets of a leaf that sketches above the floor connect form a block; whole shingle sets meet there, all
pairs of a block are compared exactly, and blocks found again by other runs are compared once. A node
that splitting hardly makes smaller holds near copies: such nodes are pooled, their sets dealt into
blocks, and all sets of different classes meet, once however many runs found them. Classes are
connected components of true links; link counts are computed exactly within classes. Blocks are
bounded in sets and in shingles, whatever the length of the texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, key_bitmap, lean, read, remove_keys, settled, with_membership
from .graph import components

SHINGLE, THRESHOLD = 5, 0.8
#: Min-hashes of a sketch, sets of a leaf, runs of a round, depth at which splitting ends.
COORDS, LEAF, RUNS, DEEPEST = 64, 2048, 6, 24
#: A child with this share of its parent's sets or more is not split again.
DENSE = 0.8
#: Probability to meet a pair at the threshold, sketch similarity under which it is no candidate.
RECALL, SKETCH_FLOOR = 0.98, 0.65
#: Sets and shingles of half a block.
HALF_SETS, HALF_SHINGLES = 1024, 400_000

_MIX = np.uint64(0xBF58476D1CE4E5B9)
_rng = np.random.default_rng(7)
_A = (_rng.integers(1, 1 << 32, COORDS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_B = _rng.integers(0, 1 << 32, COORDS, dtype=np.uint64).astype(np.uint32)


class Shingler:
    """text -> sorted distinct 64-bit hashes of its lower-cased word 5-grams; shorter texts are one shingle."""

    def __init__(self, k: int = SHINGLE, most: int = 100_000) -> None:
        self.k, self.most, self.seen = k, most, {}

    def __call__(self, text: str) -> np.ndarray:
        words = text.lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        new = set(words).difference(self.seen)
        if new:
            if len(self.seen) > self.most:
                self.seen, new = {}, set(words)
            h = xxhash.xxh3_64_intdigest
            self.seen.update((w, h(w.encode("utf-8", "replace"))) for w in new)
        w = np.array(list(map(self.seen.__getitem__, words)), np.uint64)
        n = max(1, len(w) - self.k + 1)
        s = w[:n].copy()
        for j in range(1, min(self.k, len(w))):
            s = (s ^ (s >> np.uint64(29))) * _MIX + w[j : n + j]
        s = (s ^ (s >> np.uint64(32))) * _MIX
        return np.unique(s ^ (s >> np.uint64(29)))


def sketch(shingles: np.ndarray) -> np.ndarray:
    """COORDS min-hashes, in blocks of shingles so that long texts stay small."""
    low = np.full(COORDS, 0xFFFFFFFF, np.uint32)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    for a in range(0, len(x), 2048):
        low = np.minimum(low, (x[a : a + 2048, None] * _A + _B).min(axis=0))
    return low


def digest(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.astype("<u8").tobytes())


@lean
def _sketches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    cut_up = Shingler()
    for pdf in frames:
        rows = []
        for text in pdf["text"]:
            s = cut_up(text)
            rows.append((digest(s), len(s), sketch(s).view(np.int32)))
        names, sizes, low = zip(*rows, strict=True) if rows else ((), (), ())
        yield pd.DataFrame({"id": pdf["id"], "th": pdf["th"], "digest": names, "w": sizes, "mh": low})


@lean
def _sets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    cut_up, rows, size = Shingler(), [], 0
    for pdf in frames:
        for text in pdf["text"]:
            s = cut_up(text)
            rows.append((digest(s), s.astype("<u8").tobytes()))
            size += len(s)
            if size > HALF_SHINGLES:
                yield pd.DataFrame(rows, columns=["digest", "sh"])
                rows, size = [], 0
    yield pd.DataFrame(rows, columns=["digest", "sh"])


def _grouped(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The groups of frames sorted by keys; a group may lie across frames."""
    rest: pd.DataFrame | None = None
    for pdf in frames:
        if not len(pdf):
            continue
        rest = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        key = rest[keys].to_numpy()
        change = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
        starts = [0, *change.tolist()]
        for a, b in zip(starts, starts[1:], strict=False):
            yield rest.iloc[a:b]
        rest = rest.iloc[starts[-1] :].reset_index(drop=True)
    if rest is not None and len(rest):
        yield rest


def agreements(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many coordinates every sketch of x agrees with every one of y."""
    out = np.zeros((len(x), len(y)), np.uint8)
    for c in range(x.shape[1]):
        out += x[:, c, None] == y[None, :, c]
    return out


def neighbours(x: np.ndarray, w: np.ndarray, label: np.ndarray | None = None, floor: float = SKETCH_FLOOR) -> np.ndarray:
    """Matrix of the pairs of a leaf that may be links: sketches above the floor, sizes within the threshold, labels that differ."""
    least, out = int(np.ceil(floor * x.shape[1])), np.zeros((len(x), len(x)), bool)
    for a in range(0, len(x), 256):
        b = slice(a, a + 256)
        out[b] = (agreements(x[b], x) >= least) & (5 * np.minimum(w[b, None], w) >= 4 * np.maximum(w[b, None], w))
        if label is not None:
            out[b] &= label[b, None] != label
    np.fill_diagonal(out, False)
    return out


def parts(near: np.ndarray) -> np.ndarray:
    """Connected components of a symmetric matrix: the smallest index of each row's component."""
    label = np.arange(len(near))
    for root in range(len(near)):
        if label[root] != root or not near[root].any():
            continue
        fresh = near[root] & (label > root)
        while fresh.any():
            label[fresh] = root
            fresh = near[fresh].any(axis=0) & (label > root)
    return label


def dealt(w: np.ndarray) -> np.ndarray:
    """Numbers of consecutive half blocks for sets of ``w`` shingles each."""
    out, at, sets, size = np.zeros(len(w), np.int64), 0, 0, 0
    for i, x in enumerate(w.tolist()):
        if sets and (sets >= HALF_SETS or size + x > HALF_SHINGLES):
            at, sets, size = at + 1, 0, 0
        out[i], sets, size = at, sets + 1, size + x
    return out


@lean
def _blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(block, digest): the sets to compare exactly, so that no pair of a leaf above the sketch floor is left out.

    Sets that such pairs connect share a block; where they are too many, or too long, they are dealt
    into half blocks that meet where a pair lies. Frames with a label leave out pairs of one label. A
    block is named after its sets, so that runs that find it again repeat its rows.
    """
    rows: list[tuple[int, bytes]] = []

    def add(names: np.ndarray) -> None:
        block = xxhash.xxh3_64_intdigest(b"".join(names)) - (1 << 63)
        rows.extend((block, n) for n in names)

    for group in _grouped(frames, ["path"]):
        group = group.drop_duplicates("digest")  # pivots may stand in their own block
        if len(group) < 2:
            continue
        group = group.sort_values("digest")
        names, w = group["digest"].to_numpy(), group["w"].to_numpy().astype(np.int64)
        near = neighbours(np.stack(group["mh"].tolist()), w, pd.factorize(group["label"])[0] if "label" in group else None)
        of = parts(near)
        for root in np.flatnonzero(near.any(axis=1) & (of == np.arange(len(of)))):
            inside = np.flatnonzero(of == root)
            if len(inside) <= 2 * HALF_SETS and w[inside].sum() <= 2 * HALF_SHINGLES:
                add(names[inside])
                continue
            half = dealt(w[inside])
            for p in range(half[-1] + 1):
                for q in range(p, half[-1] + 1):
                    u, v = inside[half == p], inside[half == q]
                    meet = near[np.ix_(u, v)]
                    if meet.any():
                        add(names[np.unique(np.concatenate([u[meet.any(axis=1)], v[meet.any(axis=0)]]))])
        if len(rows) > 20_000:
            yield pd.DataFrame(rows, columns=["block", "digest"])
            rows.clear()
    yield pd.DataFrame(rows, columns=["block", "digest"])


def survival(depth: int, j: float = THRESHOLD) -> float:
    """Probability that a pair of similarity j still shares a node after ``depth`` splits of one run."""
    q = 1.0
    for _ in range(depth):
        q = 0.75 * j * q + 0.25 * (1 - (1 - j * q) ** 2)
    return q


def _children(path: Column, mh: Column) -> Column:
    """The child paths of a node's set: its tokens at the one or two coordinates that the node samples."""
    c1 = F.pmod(F.xxhash64(path, F.lit("first")), F.lit(COORDS)).cast("int")
    c2 = F.pmod(c1 + 1 + F.pmod(F.xxhash64(path, F.lit("second")), F.lit(COORDS - 1)), F.lit(COORDS)).cast("int")
    one, two = F.xxhash64(path, c1, F.get(mh, c1)), F.xxhash64(path, c2, F.get(mh, c2))
    return F.explode(F.when(F.pmod(F.xxhash64(path, F.lit("fork")), F.lit(4)) == 0, F.array(one, two)).otherwise(F.array(one))).alias("path")


def leaves(sets: DataFrame, leaf: int = LEAF, recall: float = RECALL, deepest: int = DEEPEST) -> tuple[DataFrame, DataFrame | None]:
    """Leaves (path, digest, w, mh) of repeated chosen-path runs over rows (digest, w, mh) of distinct sets.

    The second table has the rows of the nodes, of the same columns, that no split makes small enough.
    """
    cols = ["path", "digest", "w", "mh"]
    active, runs, small, dense = sets, 0, [], []
    while active is not None:
        roots = F.explode(F.array(*(F.xxhash64(F.lit(f"run {runs + r}")) for r in range(RUNS)))).alias("root")
        # The first rows travel without their sketch: most have no company and end here.
        rows = active.select("digest", "mh", roots).select("digest", _children(F.col("root"), F.col("mh")), F.lit(None).cast("long").alias("was"))
        runs += RUNS
        depth, active = 1, None
        enough = next(d for d in range(1, 10_000) if 1 - (1 - survival(d)) ** runs < recall)
        while True:
            sizes = cut(rows.groupBy("path").agg(F.count("*").alias("n")).where("n > 1"), "path-sizes")
            alive = rows.join(sizes, "path")
            alive = cut(alive.join(sets, "digest") if depth == 1 else alive, "path-rows")
            small.append(alive.where(F.col("n") <= leaf).select(cols))
            if sizes.where(F.col("n") > leaf).isEmpty():
                break
            stuck = (F.col("n") > leaf) & (F.lit(depth == deepest) | F.coalesce(F.col("n") >= F.col("was") * DENSE, F.lit(False)))
            dense.append(alive.where(stuck).select(cols))
            if depth == deepest:
                break
            big = alive.where((F.col("n") > leaf) & ~stuck)
            depth += 1
            if depth == enough:
                active = cut(sets.join(big.select("digest").distinct(), "digest", "left_semi"), "deep")
                if active.isEmpty():
                    active = None
            rows = big.select("digest", "w", "mh", _children(F.col("path"), F.col("mh")), F.col("n").alias("was"))
    union = lambda dfs: reduce(DataFrame.union, dfs)
    return union(small), union(dense) if dense else None


def _pooled(dense: DataFrame) -> DataFrame:
    """Dense nodes that share sets as one: a row for every set, path being the pool."""
    dense = cut(dense, "dense")
    heads = dense.groupBy("path").agg(F.min("digest").alias("head"))
    pools = components(dense.join(heads, "path").select(F.col("head").alias("a"), F.col("digest").alias("b")))
    return cut(dense.select("digest", "w", "mh").dropDuplicates(["digest"]).join(pools, F.col("digest") == F.col("node")).select(F.xxhash64("label").alias("path"), "digest", "w", "mh"), "pooled")


def _halves(sets: Column, weight: Column) -> Column:
    return F.ceil(F.greatest(sets / HALF_SETS, weight / HALF_SHINGLES)).cast("long")


def _taken_apart(pooled: DataFrame) -> DataFrame:
    """The pools dealt into blocks, each joined by the pool's two pivots: linear in the pool's size.

    Members meet their block mates and, through the pivots, the rest; what this leaves unlinked meets in ``_crossed``.
    """
    pivots = pooled.groupBy("path").agg(F.min(F.struct("digest", "w", "mh")).alias("low"), F.max(F.struct("digest", "w", "mh")).alias("high"), _halves(F.count("*"), F.sum("w")).alias("blocks"))
    own = pooled.join(pivots.select("path", "blocks"), "path").select(F.xxhash64("path", F.pmod(F.xxhash64("digest"), "blocks")).alias("path"), "digest", "w", "mh")
    shared = pivots.select("path", F.array("low", "high").alias("ps"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("b"))
    return own.unionByName(shared.select(F.xxhash64("path", "b").alias("path"), F.explode("ps").alias("p")).select("path", "p.*"))


def _crossed(named: DataFrame) -> DataFrame:
    """Pools as leaves in which every two sets of different labels meet.

    The sets of a pool's commonest label need not meet each other: their blocks (numbered below
    zero) meet the blocks of the other sets, and those meet one another.
    """
    named = cut(named, "pool-named")
    sizes = named.groupBy("path", "label").agg(F.count("*").alias("n"), F.sum("w").alias("w"))
    sizes = sizes.groupBy("path").agg(F.max(F.struct("n", "label", "w")).alias("top"), F.sum("n").alias("n"), F.sum("w").alias("w")).where("n > top.n")
    sizes = sizes.select("path", F.col("top.label").alias("most"), _halves(F.col("top.n"), F.col("top.w")).alias("tops"), _halves(F.col("n") - F.col("top.n"), F.col("w") - F.col("top.w")).alias("rests"))
    whole, h = named.join(sizes, "path"), F.xxhash64("digest")
    top = F.col("label") == F.col("most")
    others = F.sequence(F.lit(0).cast("long"), F.col("rests") - 1)
    meet = F.when(top, others).otherwise(F.concat(others, F.sequence(-F.col("tops"), F.lit(-1).cast("long"))))
    whole = whole.withColumn("own", F.when(top, -1 - F.pmod(h, F.col("tops"))).otherwise(F.pmod(h, F.col("rests")))).withColumn("other", F.explode(meet))
    return whole.select(F.xxhash64("path", F.least("own", "other"), F.greatest("own", "other")).alias("path"), "digest", "w", "mh", "label")


def blocks_of(leaves: DataFrame) -> DataFrame:
    """(block, digest), every block once."""
    return leaves.repartition("path").sortWithinPartitions("path").mapInPandas(_blocks, "block long, digest binary").distinct()


def overlaps(sets: list[np.ndarray], cells: int = 1 << 20) -> np.ndarray:
    """Sizes of all intersections, from incidence matrices of ``cells`` cells at most.

    Tokens of one set say nothing, and tokens held by the same sets are one column with a weight.
    """
    n = len(sets)
    if n == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        return np.array([[len(sets[0]), both], [both, len(sets[1])]])
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    token = np.concatenate(sets)
    order = np.argsort(token, kind="stable")
    token, row = token[order], row[order]
    first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])[: len(token)])
    held = np.diff(np.append(first, len(token)))
    out = np.zeros((n, n), np.int32)
    if not (held > 1).any():
        return out
    mark = np.random.default_rng(3).integers(0, 1 << 63, n, dtype=np.uint64)
    column = np.add.reduceat(mark[row], first)[held > 1]
    first, held = first[held > 1], held[held > 1]
    _, one, weight = np.unique(column, return_index=True, return_counts=True)
    width = max(1, cells // n)
    for c in range(0, len(one), width):
        at = one[c : c + width]
        m = np.zeros((n, len(at)), np.float32)
        rows = np.concatenate([row[first[k] : first[k] + held[k]] for k in at])
        m[rows, np.repeat(np.arange(len(at)), held[at])] = 1
        both = m @ m.T if (weight[c : c + width] == 1).all() else (m * weight[c : c + width].astype(np.float32)) @ m.T
        out += np.rint(both, out=both).astype(np.int32)
    return out


def _linked(sets: list[np.ndarray]) -> np.ndarray:
    size, both = np.array([len(s) for s in sets]), overlaps(sets)
    linked = np.zeros(both.shape, bool)
    for a in range(0, len(sets), 256):  # in strips: a matrix of whole numbers is eight times as large
        b = slice(a, a + 256)
        linked[b] = (both[b] > 0) & (9 * both[b].astype(np.int64) >= 4 * (size[b, None] + size))
    np.fill_diagonal(linked, False)
    return linked


@lean
def _verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The classes of a block by its true links: (a, b), b the first set of a's class."""
    a, b = [], []
    for g in _grouped(frames, ["block"]):
        names = g["digest"].to_numpy()
        of = parts(_linked([np.frombuffer(x, "<u8") for x in g["sh"]]))
        linked = np.flatnonzero(of != np.arange(len(of)))
        a += names[linked].tolist()
        b += names[of[linked]].tolist()
        if len(a) > 20_000:
            yield pd.DataFrame({"a": a, "b": b})
            a, b = [], []
    yield pd.DataFrame({"a": a, "b": b})


def true_links(blocks: DataFrame, shingles: DataFrame) -> DataFrame:
    met = blocks.join(shingles.select("digest", "sh"), "digest").select("block", "digest", "sh")
    return met.repartition("block").sortWithinPartitions("block").mapInPandas(_verify, "a binary, b binary")


@lean
def _count_links(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names, counts = [], []
    for g in _grouped(frames, ["block"]):
        own, copies = g["own"].to_numpy(), g["copies"].to_numpy()
        if g["cross"].iloc[0] and own.min() == own.max():
            continue
        linked = _linked([np.frombuffer(x, "<u8") for x in g["sh"]])
        if g["cross"].iloc[0]:  # two blocks meet: only pairs across them are new
            linked &= own[:, None] != own[None, :]
        names += g["digest"].tolist()
        counts += [int(copies[row].sum()) for row in linked]
        if len(names) > 20_000:
            yield pd.DataFrame({"digest": names, "links": counts})
            names, counts = [], []
    yield pd.DataFrame({"digest": names, "links": counts})


def link_counts(shingles: DataFrame, labels: DataFrame) -> DataFrame:
    """(digest, links): the documents linked to each set of a class, from all pairs of its blocks."""
    member = cut(labels.join(shingles.select(F.col("digest").alias("node"), "w"), "node"), "classes-of")
    sizes = member.groupBy("label").agg(_halves(F.count("*"), F.sum("w")).cast("int").alias("blocks"))
    member = member.join(sizes, "label").select(F.col("node").alias("digest"), "label", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("own"))
    meet = member.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    block = F.xxhash64("label", F.least("own", "other"), F.greatest("own", "other"))
    meet = meet.join(shingles, "digest").select(block.alias("block"), "digest", "own", (F.col("own") != F.col("other")).alias("cross"), "copies", "sh")
    return meet.repartition("block").sortWithinPartitions("block").mapInPandas(_count_links, "digest binary, links long").groupBy("digest").agg(F.sum("links").alias("links"))


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF, deepest: int = DEEPEST) -> DataFrame:
    """One row per input row: id, class_id (smallest id of its class), n_links.

    Two documents are linked when their sets of lower-cased word 5-grams have Jaccard similarity 0.8
    or more; a class is a connected component, and n_links counts the documents linked to a row, its
    copies included. A text of fewer than five words is one shingle; texts without words (null and
    empty too) are copies of each other. Repeated rows are copies. Null ids sort last: a class of
    nulls only has a null id.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    id_type = docs.schema[id_col].dataType
    src = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("th"))
    ids_as_text = src.withColumn("id", F.col("id").cast("string"))
    rows = cut(ids_as_text.mapInPandas(_sketches, "id string, th long, digest binary, w int, mh array<int>").withColumn("id", F.col("id").cast(id_type)), "sketches")
    kinds = cut(rows.groupBy("digest").agg(F.min("id").alias("first_id"), F.count("*").alias("copies"), F.min("th").alias("th"), F.first("w").alias("w"), F.first("mh").alias("mh")), "sets")
    found, dense = leaves(kinds.select("digest", "w", "mh"), leaf, deepest=deepest)
    if dense is not None:
        dense = _pooled(dense)
        found = found.union(_taken_apart(dense))
    blocks = cut(blocks_of(found), "blocks")

    nodes = blocks.select("digest")
    nodes = (nodes if dense is None else nodes.union(dense.select("digest"))).distinct()
    wanted = cut(kinds.select("digest", "th", "w", "copies").join(nodes, "digest"), "wanted")
    bitmap = key_bitmap(wanted, "th")
    some = with_membership(src.select("text", "th"), bitmap, F.col("th"), "maybe").where("maybe").select("text")
    # A text for each hash would do, but the rows of one text come from many tasks; the join sees to it.
    whole = some.mapInPandas(_sets, "digest binary, sh binary")
    shingles = cut(whole.groupBy("digest").agg(F.first("sh").alias("sh")).join(wanted.select("digest", "w", "copies"), "digest"), "shingles")
    true = cut(true_links(blocks, shingles), "true-links")
    labels = components(true)
    if dense is not None:
        label = labels.select(F.col("node").alias("digest"), "label")
        more = cut(true_links(blocks_of(_crossed(dense.join(label, "digest", "left").withColumn("label", F.coalesce("label", "digest")))), shingles), "more-links")
        if not more.isEmpty():
            labels = components(true.union(more))
    counted = link_counts(shingles, labels)

    named = kinds.select("digest", "first_id", "copies").join(labels.withColumnRenamed("node", "digest"), "digest", "left").join(counted, "digest", "left")
    named = cut(named.select("digest", "first_id", F.coalesce("label", "digest").alias("label"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "named")
    heads = cut(named.groupBy("label").agg(F.min("first_id").alias("class_id")), "heads")
    final = cut(named.join(heads, "label").select("digest", "class_id", "n_links"), "classes")
    return rows.select("id", "digest").join(final, "digest").select(F.col("id").alias(id_col), "class_id", "n_links")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of every class, the one with the smallest id; all columns stay."""
    classes = settled(lambda: ngram_join(docs, id_col, text_col), "near-classes")
    gone = classes.where(F.col(id_col) != F.col("class_id")).select(id_col)
    heads = classes.where(F.col(id_col) == F.col("class_id")).select(id_col)
    return remove_keys(docs, gone.join(heads, id_col, "left_anti"), id_col)


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(read(spark, sf_dir, "documents"))


QUERIES = {"op7_ngram_jaccard_join": op7_ngram_jaccard_join}
SQL: dict[str, str] = {}
