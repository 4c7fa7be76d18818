"""Best-fit packing of token sequences: bounded-space online best-fit on a bitset of free space.

Each scan partition tokenises its texts and packs their pieces at once, so no text and no token is
shuffled. A fixed number of bins is open; an integer serves as bitset, bit f being set while some
open bin has f tokens free, so the best fit is one shift and one lowest-set-bit. When the bins run
out, the fullest closes. Bins that a partition leaves poorly filled are packed once more, as wholes,
with those of neighbouring partitions.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, held, lean, read
from .word_bpe import WordBpe, batches

SEQUENCE, SEPARATOR = 2048, 0
#: Bins open at once, the fill under which a bin is packed again, and the partitions whose bins meet.
OPEN_BINS, POOR, NEIGHBOURS = 1024, 0.97, 64


class BestFit:
    """Online best-fit with at most ``most`` open bins of ``size`` tokens."""

    def __init__(self, size: int = SEQUENCE, most: int = OPEN_BINS) -> None:
        self.size, self.most = size, most
        self.bits, self.open, self.made = 0, 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(size + 1)]
        self.used: dict[int, int] = {}

    def add(self, length: int) -> tuple[int, int]:
        """Place an item of 1 to size tokens: its bin and its offset in the bin."""
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            at = self._take(free)
        else:
            if self.open >= self.most:  # the fullest has the least free space
                self._take((self.bits & -self.bits).bit_length() - 1)
                self.open -= 1
            at, free = self.made, self.size
            self.made += 1
            self.open += 1
        offset = self.size - free
        left = free - length
        self.used[at] = self.size - left
        if left:
            self.by_free[left].append(at)
            self.bits |= 1 << left
        else:
            self.open -= 1
        return at, offset

    def _take(self, free: int) -> int:
        stack = self.by_free[free]
        at = stack.pop()
        if not stack:
            self.bits &= ~(1 << free)
        return at


def pieces(n: int, size: int = SEQUENCE) -> list[tuple[int, int]]:
    """(start, length) of a document of n tokens; only a document longer than a sequence is cut."""
    return [(s, min(size, n - s)) for s in range(0, n, size)]


PACKED = "doc_id string, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, used int"


def _packer(path: str, size: int, with_ids: bool):
    @lean
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        encoder, fit = held(__name__, path, lambda: WordBpe(path)), BestFit(size)
        docs, parts, starts, lengths, crcs, bins, offsets, ids = ([] for _ in range(8))
        for pdf in frames:
            texts = [x or "" for x in pdf["text"]]
            keys = pdf["id"].tolist()
            for span in batches(texts):
                for doc, own in zip(keys[span], encoder.encode(texts[span]), strict=True):
                    all_ids = np.append(own, np.uint16(SEPARATOR)).astype("<u4")
                    for k, (start, length) in enumerate(pieces(len(all_ids), size)):
                        at, offset = fit.add(length)
                        docs.append(doc)
                        parts.append(k)
                        starts.append(start)
                        lengths.append(length)
                        crcs.append(zlib.crc32(all_ids[start : start + length].tobytes()))
                        bins.append(at)
                        offsets.append(offset)
                        if with_ids:
                            ids.append(all_ids[start : start + length].astype(np.int32))
        for a in range(0, len(docs), 10_000):
            b = slice(a, a + 10_000)
            out = {"doc_id": docs[b], "piece": parts[b], "start": starts[b], "length": lengths[b], "ids_crc32": crcs[b], "sequence_id": [part << 33 | x for x in bins[b]], "offset": offsets[b], "used": [fit.used[x] for x in bins[b]]}
            yield pd.DataFrame(out | ({"ids": ids[b]} if with_ids else {}))

    return run


def _repack(size: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = list(frames)
        if not got:
            return
        rows = pd.concat(got, ignore_index=True)
        rows = rows.drop_duplicates("sequence_id").sort_values(["hood", "used", "sequence_id"], ascending=[True, False, True])
        for hood, group in rows.groupby("hood", sort=False):
            fit, names = BestFit(size), {}
            new, base = [], []
            for seq, used in zip(group["sequence_id"].tolist(), group["used"].tolist(), strict=True):
                at, offset = fit.add(used)
                new.append(names.setdefault(at, seq))
                base.append(offset)
            yield pd.DataFrame({"old": group["sequence_id"], "new": new, "base": base})

    return run


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", size: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    """Pack whole texts into sequences of at most ``size`` tokens; one row per piece.

    A document's tokens are its ids, then id 0, so an empty or null text is one token. Rows that
    repeat an id are packed each on their own. Sequence ids are unique, not consecutive; offsets in a
    sequence run from 0 without gaps. with_ids adds the piece's ids. An empty table gives no rows.
    """
    schema = PACKED + (", ids array<int>" if with_ids else "")
    src = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    first = src.mapInPandas(_packer(tokenizer_path, size, with_ids), schema)
    first = cut(first.withColumn("doc_id", F.col("doc_id").cast(docs.schema[id_col].dataType)), "packed")
    # A partition leaves at most OPEN_BINS poorly filled bins, whatever its size.
    poor = first.where(F.col("used") < int(size * POOR)).select("sequence_id", "used", F.expr(f"shiftright(sequence_id, 33) div {NEIGHBOURS}").alias("hood")).distinct()
    moved = poor.repartition("hood").mapInPandas(_repack(size), "old long, new long, base long").where("old <> new")
    out = first.join(moved, first["sequence_id"] == moved["old"], "left")
    cols = ["doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("new", "sequence_id").alias("sequence_id"), (F.col("offset") + F.coalesce("base", F.lit(0))).alias("offset")]
    return out.select(*cols, *(["ids"] if with_ids else [])).withColumnRenamed("doc_id", id_col)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op5_best_fit_packing": op5_best_fit_packing}
SQL: dict[str, str] = {}
