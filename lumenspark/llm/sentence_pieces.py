"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a Viterbi pass.

The automaton reads a text once; at every end position it follows its output links to all pieces that
end there, and each relaxes the best score of that position. Characters that no piece spells go to
byte pieces at a fixed penalty. When no piece reaches across the start of a word or a line, the best
path of a text is the best paths of its words joined, so words are remembered between texts; the
automaton then only reads words it has not met. The result does not depend on what is remembered.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held, lean, read

SPACE = "▁"
#: Added to the lowest piece score for a character that only bytes can spell.
UNKNOWN_PENALTY = 10.0
#: Stands for a literal U+2581 of a text inside the automaton, which no piece can then match.
_LITERAL = "\uffff"
_BYTES = re.compile("[\uf000-\uf0ff]+")


class Pieces:
    """encode(text) -> ids, decode(ids) -> text, for the vocabulary of a SentencePiece model file."""

    def __init__(self, path: str, most: int = 300_000) -> None:
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        if n >= 0xD800:
            raise ValueError("ids of this vocabulary do not fit one UTF-16 unit")
        self.most, self.seen = most, {}
        self.auto = ahocorasick.Automaton()
        self.byte_ids = [0] * 256
        self.text_of: dict[int, str] = {}
        lowest, self.whole_words, self.runs = 0.0, True, False
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                b = int(piece[3:5], 16)
                self.byte_ids[b] = i
                self.text_of[i] = chr(0xF000 + b)
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.text_of[i] = ""
            else:
                score = sp.get_score(i)
                lowest = min(lowest, score)
                self.auto.add_word(piece, (len(piece), score, i))
                self.text_of[i] = piece
                self.whole_words &= SPACE not in piece.lstrip(SPACE) and "\n" not in piece
                self.runs |= piece.startswith(SPACE * 2)
        self.auto.make_automaton()
        self.unknown = lowest - UNKNOWN_PENALTY

    def best(self, raw: str) -> tuple[str, float]:
        """Ids (a character each) and score of the best path over ``raw``."""
        text = raw.replace(SPACE, _LITERAL).replace(" ", SPACE)
        n = len(text)
        score, back, one = [-1e300] * (n + 1), [(0, -1)] * (n + 1), [False] * (n + 1)
        score[0] = 0.0
        done = 0

        def close(upto: int) -> None:
            """Give the positions before ``upto`` that no one-character piece reaches their byte step."""
            nonlocal done
            while done < upto:
                done += 1
                if not one[done] and score[done - 1] + self.unknown > score[done]:
                    score[done], back[done] = score[done - 1] + self.unknown, (1, -1)

        for end, (length, s, i) in self.auto.iter(text):
            close(end)
            at = end + 1
            if length == 1:
                one[at] = True
            s += score[at - length]
            if s > score[at]:
                score[at], back[at] = s, (length, i)
        close(n)
        out, at = [], n
        while at:
            length, i = back[at]
            if i >= 0:
                out.append(chr(i))
            else:
                c = text[at - 1] if text[at - 1] == SPACE else raw[at - 1]
                out.extend(chr(self.byte_ids[b]) for b in reversed(c.encode("utf-8", "replace")))
            at -= length
        return "".join(reversed(out)), score[n]

    def _word(self, word: str) -> str:
        """word has no space; a leading newline means that no space stands before it."""
        return self.best(word if word.startswith("\n") else " " + word)[0]

    def encode_text(self, text: str) -> str:
        """Ids as characters. A text that is not empty gets one space in front."""
        if not text:
            return ""
        if not self.whole_words:
            return self.best(" " + text)[0]
        if self.runs and ("  " in text or " \n" in text or text[0] == " " or text[-1] == " "):
            return "".join(self.best(p)[0] for p in re.findall(r"\n[^ \n]*| +[^ \n]*", " " + text))
        words = (" " + text).replace("\n", " \n").split(" ")[1:]
        if words and words[0].startswith("\n"):
            words.insert(0, "")
        new = set(words).difference(self.seen)
        if new:
            if len(self.seen) > self.most:
                self.seen, new = {}, set(words)
            word = self._word
            self.seen.update((w, word(w)) for w in new)
        return "".join(map(self.seen.__getitem__, words))

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode_text(text).encode("utf-16-le"), "<u2")

    def decode_text(self, ids: str) -> str:
        """The text of ids given as characters: bytes are joined, the space in front goes."""
        text = ids.translate(self.text_of).replace(SPACE, " ")
        text = _BYTES.sub(lambda m: bytes(ord(c) - 0xF000 for c in m.group()).decode("utf-8", "replace"), text)
        return text[1:] if text.startswith(" ") else text

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_text(ids.astype("<u2").tobytes().decode("utf-16-le"))


def _pieces(path: str) -> Pieces:
    return held(__name__, path, lambda: Pieces(path))


ENCODED = "id string, n_ids long, ids_crc32 long, round_trip boolean, ids array<int>"


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_ids, ids_crc32 (little-endian uint32 ids), round_trip, ids.

    Whole texts; null and empty texts have no ids. round_trip tells whether decoding gives the text
    back. One pass, no shuffle.
    """

    @lean
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sp = _pieces(model_path)
        for pdf in frames:
            rows, size = [], 0
            for doc, text in zip(pdf["id"], pdf["text"], strict=True):
                text = text or ""
                chars = sp.encode_text(text)
                ids = np.frombuffer(chars.encode("utf-16-le"), "<u2")
                rows.append((doc, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), sp.decode_text(chars) == text, ids.astype(np.int32)))
                size += len(ids)
                if size > 1_000_000:
                    yield pd.DataFrame(rows, columns=["id", "n_ids", "ids_crc32", "round_trip", "ids"])
                    rows, size = [], 0
            yield pd.DataFrame(rows, columns=["id", "n_ids", "ids_crc32", "round_trip", "ids"])

    out = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).mapInPandas(run, ENCODED)
    return out.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "n_ids", "ids_crc32", "round_trip", "ids")


def decode_documents(encoded: DataFrame, model_path: str, ids_col: str = "ids") -> DataFrame:
    """encoded plus ``decoded``, the text of its ids; null ids decode to an empty text."""

    @F.pandas_udf("string")
    def udf(s: pd.Series) -> pd.Series:
        sp = _pieces(model_path)
        return pd.Series([sp.decode(np.asarray(x if x is not None else [], np.int64)) for x in s], dtype=object)

    return encoded.withColumn("decoded", udf(F.col(ids_col)))


def op8_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {"op8_sentence_pieces": op8_sentence_pieces}
SQL: dict[str, str] = {}
