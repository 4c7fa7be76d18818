"""Language-model scoring with a log-frequency Bloom filter of quantised n-gram counts.

One pass over the training documents counts words and word pairs by 64-bit hash and deals the counts
to segments by the hash's top bits; the number of segments follows the input, so every segment is a
small task. A segment turns its counts into its own slice of the filter: an n-gram of count c enters
once for every level up to log(c). Scoring probes level after level until one is absent and smooths
the counts found. Slices of FILTER_BITS together are broadcast; a larger filter stays whole in the
shared folder, and every segment's slice answers the keys asked of it, with the same result. For that
the tokens of a chunk of documents are written once, as ranks in its words; the keys asked, made from
them, travel as differences and the answers as levels in the order of the keys.

The base score needs exact counts: the most frequent words of every segment, a bounded number, are
broadcast too; the other words' tokens meet the exact counts of their segment in a co-grouped join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, lean, read
from .quality import fold

#: Bits of a filter that is broadcast at most, bits per entry, hash functions, base of the count levels.
FILTER_BITS, BITS_PER_ENTRY, HASHES, BASE = 1 << 30, 10, 3, 1.6
#: Words whose exact counts are broadcast at most (12 bytes each), and tokens counted at once.
FREQUENT, CHUNK = 1 << 20, 1_000_000
#: Documents of a partition whose answers are summed together, as a power of two.
BLOCK_BITS = 12
#: Weight of the word model against a context's count.
BACKOFF = 4.0

#: Bits of a hash that the filter and pairs of words look at, the upper 48; exact counts look at all.
KEEP = np.uint64(~0xFFFF & (1 << 64) - 1)
END = np.uint64(xxhash.xxh3_64_intdigest(b"\n")) & KEEP
_MUL = np.uint64(0x9E3779B97F4A7C15)
_MUL2 = np.uint64(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MUL
    x = (x ^ (x >> np.uint64(29))) * _MUL2
    return x ^ (x >> np.uint64(32))


def pairs(tokens: np.ndarray) -> np.ndarray:
    """Keys of (previous token, token); the first token follows an end."""
    tokens = tokens & KEEP
    before = np.concatenate([[END], tokens[:-1]]).astype(np.uint64)
    return mix(before * _MUL2 + (tokens ^ (tokens >> np.uint64(17))))


class Words:
    """text -> hashes of its A-Z-lower-cased words, then the end token."""

    def __init__(self, most: int = 150_000) -> None:
        self.most, self.seen = most, {}

    def __call__(self, text: str) -> np.ndarray:
        words = text.encode("utf-8", "replace").lower().split()  # bytes: ASCII only, as the contract has it
        new = set(words).difference(self.seen)
        if new:
            if len(self.seen) > self.most:
                self.seen, new = {}, set(words)
            h = xxhash.xxh3_64_intdigest
            self.seen.update((w, h(w)) for w in new)
        out = list(map(self.seen.__getitem__, words))
        out.append(int(END))
        return np.array(out, np.uint64)


def level(counts: np.ndarray) -> np.ndarray:
    """1 for a count of 1, then one more for every factor BASE."""
    return 1 + np.floor(np.log(np.maximum(counts, 1)) / np.log(BASE) + 1e-9).astype(np.int64)


def value(levels: np.ndarray) -> np.ndarray:
    """The count that a level stands for: the geometric middle of its range; 0 for level 0."""
    low = np.ceil(BASE ** (levels - 1.0) - 1e-9)
    high = np.maximum(low, np.ceil(BASE ** levels.astype(float) - 1e-9) - 1)
    return np.where(levels > 0, np.sqrt(low * high), 0.0)


def _places(keys: np.ndarray, lev: int, bits: np.ndarray | int) -> Iterator[np.ndarray]:
    keys = keys & KEEP
    for i in range(HASHES):
        h = mix(keys + np.uint64((lev * HASHES + i + 1) * 0x9E3779B9))
        yield ((h >> np.uint64(32)) * np.asarray(bits, np.uint64)) >> np.uint64(32)


def build_slice(keys: np.ndarray, counts: np.ndarray, most_bits: int | None = None) -> tuple[int, bytes]:
    """(bits, bytes) of one segment's slice, all its n-grams in it; most_bits is no longer a bound."""
    lev = level(counts)
    bits = int(max(64, lev.sum() * BITS_PER_ENTRY + 7 & ~7))
    marks = np.zeros(bits, bool)
    for at in range(1, int(lev.max(initial=0)) + 1):
        for place in _places(keys[lev >= at], at, bits):
            marks[place.astype(np.int64)] = True
    return bits, np.packbits(marks, bitorder="little").tobytes()


def _probe(keys: np.ndarray, bits: int, data: bytes) -> np.ndarray:
    """Levels of keys of one segment by its slice."""
    packed = np.frombuffer(data, np.uint8)
    return Model(63, np.array([bits, bits]), np.zeros(2, np.int64), packed, keys[:0], keys[:0], 0, 0).levels(keys)


@dataclass
class Model:
    shift: int
    bits: np.ndarray
    start: np.ndarray
    data: np.ndarray
    frequent: np.ndarray
    frequent_counts: np.ndarray
    tokens: int
    kinds: int
    #: False where the slices stay in the shared folder; ``ends`` is then the count of the end token.
    whole: bool = True
    ends: float = 0.0

    def counts(self, keys: np.ndarray) -> np.ndarray:
        return value(self.levels(keys))

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Levels of the counts: probe level by level those keys that are still present."""
        found = np.zeros(len(keys), np.int64)
        active = np.arange(len(keys))
        lev = 1
        while len(active):
            k = keys[active]
            seg = (k >> np.uint64(self.shift)).astype(np.int64)
            hit = np.ones(len(k), bool)
            for place in _places(k, lev, self.bits[seg]):
                at = self.start[seg] + place.astype(np.int64)
                hit &= (self.data[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
            active = active[hit]
            found[active] = lev
            lev += 1
        return found

    def log10(self, tokens: np.ndarray) -> np.ndarray:
        """log10 of P(token | previous) for the tokens of whole documents, ends included."""
        distinct, where = np.unique(tokens, return_inverse=True)
        return self.smoothed(tokens, self.counts(distinct)[where], self.counts(pairs(tokens)))

    def smoothed(self, tokens: np.ndarray, single: np.ndarray, both: np.ndarray) -> np.ndarray:
        """The probabilities from the counts of the tokens and of their pairs.

        A context of count c gives its pair counts the weight c / (c + BACKOFF) and the word model,
        add-one over the quantised counts, the rest.
        """
        word = (single + 1) / (self.tokens + self.kinds + 1)
        of = np.where(np.concatenate([[END], tokens[:-1]]) == END, self._ends, np.concatenate([[0.0], single[:-1]]))
        both = np.minimum(both, of)
        return np.log10((both + BACKOFF * word) / (of + BACKOFF))

    def __post_init__(self) -> None:
        if self.whole:
            self._ends = float(self.counts(np.array([END], np.uint64))[0]) if len(self.bits) else 0.0
        else:
            self._ends = self.ends


_COUNTED = "seg int, pair boolean, keys binary, counts binary"


def _counter(shift: int):
    def emit(hashes: list[np.ndarray], pair: bool) -> Iterator[tuple]:
        keys, n = np.unique(np.concatenate(hashes), return_counts=True)
        segs = (keys >> np.uint64(shift)).astype(np.int64)
        at = np.flatnonzero(np.diff(segs, prepend=-1))
        for a, b in zip(at, [*at[1:], len(keys)], strict=True):
            yield int(segs[a]), pair, keys[a:b].tobytes(), n[a:b].astype(np.uint32).tobytes()

    @lean
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, single, double, size = Words(), [], [], 0
        for pdf in frames:
            for text in pdf["text"]:
                t = words(text or "")
                single.append(t)
                double.append(pairs(t))
                size += len(t)
                if size >= CHUNK:
                    for rows in (emit(single, False), emit(double, True)):
                        yield pd.DataFrame(list(rows), columns=["seg", "pair", "keys", "counts"])
                    single, double, size = [], [], 0
        if size:
            for rows in (emit(single, False), emit(double, True)):
                yield pd.DataFrame(list(rows), columns=["seg", "pair", "keys", "counts"])

    return run


def _summed(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([np.frombuffer(x, np.uint64) for x in pdf["keys"]] or [np.zeros(0, np.uint64)])
    counts = np.concatenate([np.frombuffer(x, np.uint32) for x in pdf["counts"]] or [np.zeros(0, np.uint32)])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order].astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


_SLICED = "seg int, keys binary, counts binary, bits long, slice binary, top_keys binary, top_counts binary, tokens long, kinds long"


def _slicer(segments: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        words, n = _summed(pdf[~pdf["pair"]])
        both, m = _summed(pdf[pdf["pair"]])
        bits, data = build_slice(np.concatenate([words, both]), np.concatenate([n, m]))
        top = np.sort(np.argsort(-n, kind="stable")[: FREQUENT // segments])
        row = (int(pdf["seg"].iloc[0]), words.tobytes(), n.tobytes(), bits, data, words[top].tobytes(), n[top].tobytes(), int(n.sum()), len(words))
        return pd.DataFrame([row], columns=[f.split()[0] for f in _SLICED.split(", ")])

    return run


def train(docs: DataFrame, text_col: str = "text") -> tuple[Model, DataFrame]:
    """The model, and by segment the exact word counts and the slice (seg, keys, counts, bits, slice) in the shared folder."""
    parts = docs.rdd.getNumPartitions()
    power = min(16, max(6, int(np.ceil(np.log2(4 * max(1, parts))))))
    segments, shift = 1 << power, 64 - power
    counted = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInPandas(_counter(shift), _COUNTED)
    sliced = cut(counted.groupBy("seg").applyInPandas(_slicer(segments), _SLICED), "lm-slices")
    bits, start = np.full(segments, 64, np.int64), np.zeros(segments, np.int64)
    data, size, tops, tokens, kinds = [bytes(8)], 64, [], 0, 0
    whole = (sliced.agg(F.sum("bits")).first()[0] or 0) <= FILTER_BITS
    for r in sliced.select("seg", "bits", *(["slice"] if whole else []), "top_keys", "top_counts", "tokens", "kinds").toLocalIterator():
        bits[r["seg"]], start[r["seg"]] = r["bits"], size
        if whole:
            data.append(bytes(r["slice"]))
            size += len(r["slice"]) * 8
        tops.append((np.frombuffer(r["top_keys"], np.uint64), np.frombuffer(r["top_counts"], np.int64)))
        tokens += r["tokens"]
        kinds += r["kinds"]
    packed = np.frombuffer(b"".join(data), np.uint8)
    del data
    keys = np.concatenate([k for k, _ in tops] or [np.zeros(0, np.uint64)])
    order = np.argsort(keys)
    counts = np.concatenate([c for _, c in tops] or [np.zeros(0, np.int64)])[order]
    ends = 0.0
    if not whole:
        r = sliced.where(F.col("seg") == int(END >> np.uint64(shift))).select("bits", "slice").first()
        ends = float(value(_probe(np.array([END], np.uint64), r["bits"], r["slice"]))[0]) if r else 0.0
    model = Model(shift, bits, start, packed, keys[order], counts, tokens, kinds, whole, ends)
    return model, sliced.select("seg", "keys", "counts", "bits", "slice")


#: Where the filter is not broadcast: the tokens of a chunk of documents.
_ASKED = "chunk long, rids binary, lengths binary, words binary, counts binary, tokens binary"
_SCORED = "rid long, id string, n long, known long, logs double, score double, seg int, keys binary, rows binary"


def pack(x: np.ndarray) -> bytes:
    """Whole numbers, least bytes first, without the upper bytes that all have empty; compressed."""
    x = np.ascontiguousarray(x, np.uint64)
    width = (int(x.max(initial=0)).bit_length() + 7) // 8
    planes = x.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
    return len(x).to_bytes(4, "little") + bytes([width]) + (pa.compress(planes, "zstd", asbytes=True) if planes else b"")


def unpack(data: bytes) -> np.ndarray:
    n, width = int.from_bytes(data[:4], "little"), data[4]
    out = np.zeros((n, 8), np.uint8)
    if n * width:
        out[:, :width] = np.frombuffer(pa.decompress(data[5:], n * width, "zstd", asbytes=True), np.uint8).reshape(width, n).T
    return out.view(np.uint64).ravel()


def pack_keys(keys: np.ndarray, base: int = 0) -> bytes:
    """Ascending keys of KEEP's bits from ``base`` on, by their differences."""
    return pack(np.diff(keys >> np.uint64(16), prepend=np.uint64(base >> 16)))


def unpack_keys(data: bytes, base: int = 0) -> np.ndarray:
    return (np.cumsum(unpack(data), dtype=np.uint64) + np.uint64(base >> 16)) << np.uint64(16)


def pack_tokens(tokens: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """The words of KEEP's bits, how often each occurs, and the tokens as ranks from frequent to rare."""
    words, where, counts = np.unique(tokens & KEEP, return_inverse=True, return_counts=True)
    rank = np.empty(len(words), np.int64)
    rank[np.argsort(-counts, kind="stable")] = np.arange(len(words))
    return pack_keys(words), pack(counts), pack(rank[where])


def unpack_tokens(words: bytes, counts: bytes, tokens: bytes) -> np.ndarray:
    order = np.argsort(-unpack(counts).astype(np.int64), kind="stable")
    return unpack_keys(words)[order][unpack(tokens).astype(np.int64)]


def _keys(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of a chunk's tokens and pairs, and where those of the tokens, then of the pairs are."""
    return np.unique(np.concatenate([tokens, pairs(tokens)]) & KEEP, return_inverse=True)


def _asker(shift: int):
    @lean
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The keys that chunks ask of segments."""
        for pdf in frames:
            for r in pdf.itertuples():
                keys, _ = _keys(unpack_tokens(r.words, r.counts, r.tokens))
                segs = (keys >> np.uint64(shift)).astype(np.int64)
                cuts = np.flatnonzero(np.diff(segs, prepend=-1))
                asks = [(r.chunk, int(segs[a]), pack_keys(keys[a:b], int(segs[a]) << shift)) for a, b in zip(cuts, [*cuts[1:], len(keys)], strict=True)]
                yield pd.DataFrame(asks, columns=["chunk", "seg", "keys"])

    return run


def _scorer(shared):
    @lean
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m: Model = shared.value
        words, rid = Words(), TaskContext.get().partitionId() << 33
        columns = [f.split()[0] for f in (_SCORED if m.whole else f"{_SCORED}, {_ASKED}").split(", ")]
        for pdf in frames:
            texts, ids = pdf["text"].tolist(), pdf["id"].tolist()
            at = 0
            while at < len(texts):
                docs, size = [], 0
                while at + len(docs) < len(texts) and size < (300_000 if m.whole else CHUNK):
                    docs.append(words(texts[at + len(docs)] or ""))
                    size += len(docs[-1])
                tokens = np.concatenate(docs)
                lengths = np.array([len(d) for d in docs])
                first = np.cumsum(lengths) - lengths
                of = np.repeat(np.arange(len(docs)), lengths)
                score = np.add.reduceat(m.log10(tokens), first) if m.whole else np.full(len(docs), np.nan)
                known, logs = np.zeros(len(docs), np.int64), np.zeros(len(docs))
                if len(m.frequent):
                    place = np.minimum(np.searchsorted(m.frequent, tokens), len(m.frequent) - 1)
                    hit = m.frequent[place] == tokens
                    known = np.bincount(of[hit], minlength=len(docs))
                    logs = np.bincount(of[hit], np.log10(m.frequent_counts[place[hit]] + 1.0), len(docs))
                else:
                    hit = np.zeros(len(tokens), bool)
                main = pd.DataFrame({"rid": rid + np.arange(len(docs)), "id": ids[at : at + len(docs)], "n": lengths, "known": known, "logs": logs, "score": score})
                rest, owner = tokens[~hit], of[~hit] + rid
                order = np.argsort(rest)
                rest, owner = rest[order], owner[order].astype(np.int64)
                segs = (rest >> np.uint64(m.shift)).astype(np.int64)
                cuts = np.flatnonzero(np.diff(segs, prepend=-1)) if len(rest) else np.zeros(0, np.int64)
                asks = [(int(segs[a]), rest[a:b].tobytes(), owner[a:b].tobytes()) for a, b in zip(cuts, [*cuts[1:], len(rest)], strict=False)]
                parts = [main, pd.DataFrame(asks, columns=["seg", "keys", "rows"])]
                if not m.whole:
                    rids = (rid + np.arange(len(docs))).astype(np.int64)
                    main = [(rid, rids.tobytes(), lengths.astype(np.int64).tobytes(), *pack_tokens(tokens))]
                    parts.append(pd.DataFrame(main, columns=[f.split()[0] for f in _ASKED.split(", ")]))
                yield pd.concat(parts, ignore_index=True).reindex(columns=columns).astype({k: "Int64" for k in ("rid", "n", "known", "seg", "chunk") if k in columns})
                rid += len(docs)
                at += len(docs)

    return run


_ANSWER = "block long, rids binary, known binary, logs binary"


def _answer(asks: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
    """The asked words' exact counts, summed by document; a row for every block of documents."""
    columns = ["block", "rids", "known", "logs"]
    if not len(asks) or not len(table):
        return pd.DataFrame(columns=columns)
    keys, counts = np.frombuffer(table["keys"].iloc[0], np.uint64), np.frombuffer(table["counts"].iloc[0], np.int64)
    want = np.concatenate([np.frombuffer(x, np.uint64) for x in asks["keys"]])
    rows = np.concatenate([np.frombuffer(x, np.int64) for x in asks["rows"]])
    place = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
    hit = keys[place] == want
    rid, where = np.unique(rows[hit], return_inverse=True)
    known, logs = np.bincount(where, minlength=len(rid)), np.bincount(where, np.log10(counts[place[hit]] + 1.0), len(rid))
    at = np.flatnonzero(np.diff(rid >> BLOCK_BITS, prepend=-1))
    out = [(int(rid[a] >> BLOCK_BITS), rid[a:b].tobytes(), known[a:b].astype(np.int64).tobytes(), logs[a:b].tobytes()) for a, b in zip(at, [*at[1:], len(rid)], strict=False)]
    return pd.DataFrame(out, columns=columns)


def _answerer(shift: int):
    def run(asks: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        """The levels of the keys asked of a segment, in their order."""
        out = []
        for chunk, seg, data in zip(asks["chunk"], asks["seg"], asks["keys"], strict=True):
            keys = unpack_keys(data, int(seg) << shift)
            found = _probe(keys, int(table["bits"].iloc[0]), table["slice"].iloc[0]) if len(table) else np.zeros(len(keys), np.int64)
            out.append((chunk, seg, pack(found)))
        return pd.DataFrame(out, columns=["chunk", "seg", "levels"])

    return run


def _chunk_scorer(shared):
    def run(main: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        m: Model = shared.value
        tokens = unpack_tokens(*(main[c].iloc[0] for c in ("words", "counts", "tokens")))
        lengths = np.frombuffer(main["lengths"].iloc[0], np.int64)
        keys, where = _keys(tokens)
        levels = np.concatenate([unpack(x) for x in answers.sort_values("seg")["levels"]]).astype(np.int64)
        if len(levels) != len(keys):
            raise ValueError(f"{len(levels)} answers to {len(keys)} keys")
        counts = value(levels)[where]
        logs = m.smoothed(tokens, counts[: len(tokens)], counts[len(tokens) :])
        return pd.DataFrame({"rid": np.frombuffer(main["rids"].iloc[0], np.int64), "whole_score": np.add.reduceat(logs, np.cumsum(lengths) - lengths)})

    return run


def _sum_block(pdf: pd.DataFrame) -> pd.DataFrame:
    join = lambda c, kind: np.concatenate([np.frombuffer(x, kind) for x in pdf[c]])
    rid, where = np.unique(join("rids", np.int64), return_inverse=True)
    return pd.DataFrame({"rid": rid, "more_known": np.bincount(where, join("known", np.int64), len(rid)).astype(np.int64), "more_logs": np.bincount(where, join("logs", np.float64), len(rid))})


def lm_scores(docs: DataFrame, training: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_tokens, n_known, train_tokens, base_score, score.

    base_score is the add-one unigram log10 probability with exact counts of ``training``'s texts;
    score is the Bloom-filter bigram model's. Null texts are empty: one end token. Words are told
    apart by 64-bit hashes. Without training rows every probability is 1 / 1.
    """
    model, table = train(training, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    src = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    scored = cut(src.mapInPandas(_scorer(shared), _SCORED if model.whole else f"{_SCORED}, {_ASKED}"), "lm-scored")
    asks = scored.where("seg is not null").select("seg", "keys", "rows")
    more = asks.groupBy("seg").cogroup(table.select("seg", "keys", "counts").groupBy("seg")).applyInPandas(_answer, _ANSWER)
    more = more.groupBy("block").applyInPandas(_sum_block, "rid long, more_known long, more_logs double")
    out = scored.where("rid is not null").select("rid", "id", "n", "known", "logs", "score").join(more, "rid", "left")
    if not model.whole:
        chunks = scored.where("tokens is not null").select("chunk", "rids", "lengths", "words", "counts", "tokens")
        asked = chunks.select("chunk", "words", "counts", "tokens").mapInPandas(_asker(model.shift), "chunk long, seg int, keys binary")
        levels = asked.groupBy("seg").cogroup(table.select("seg", "bits", "slice").groupBy("seg")).applyInPandas(_answerer(model.shift), "chunk long, seg int, levels binary")
        levels = cut(levels, "lm-levels")  # the keys go with their shuffle
        whole = chunks.groupBy("chunk").cogroup(levels.groupBy("chunk")).applyInPandas(_chunk_scorer(shared), "rid long, whole_score double")
        out = out.join(whole, "rid").drop("score").withColumnRenamed("whole_score", "score")
    size = float(np.log10(model.tokens + model.kinds + 1))
    return out.select(
        F.col("id").cast(docs.schema[id_col].dataType).alias(id_col),
        F.col("n").alias("n_tokens"),
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n") * F.lit(size)).alias("base_score"),
        "score",
    )


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(fold(F.col("doc_id"), 7) == 2, F.lit(False))
    return lm_scores(docs, docs.where(~held)).select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op4_lm_scoring": op4_lm_scoring}
SQL: dict[str, str] = {}
