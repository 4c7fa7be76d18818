"""Word-level BPE ids, exactly as the tokenizers library gives them, from a bounded word cache.

The vocabulary splits at white space before merging, so a text's ids are its chunks' ids joined.
Chunks of plain Latin characters that the cache lacks are merged by rank with tiktoken, whose core
works on bytes: the word end becomes one marker byte, and a byte with a word end ranks below every
merge, so it forms first. All other chunks (rare scripts, special strings, control characters) go to
the tokenizers library itself.
"""

from __future__ import annotations

import json
import os

import numpy as np
import regex

MARK = "\x01"
#: Stands between words; no id has this value.
GAP = "\uffff"
#: Characters that lower-casing and NFC treat one by one.
PLAIN = regex.compile(r"[\x21-\x7e\xa1-ɏ]+")


def _byte_names() -> dict[str, int]:
    """The public byte-level alphabet: printable bytes stand for themselves, the rest from U+0100 up."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class WordBpe:
    """Ids of whole texts; at most cache_size words are remembered between batches.

    An id fits one UTF-16 unit, so ids travel as strings and the per-word work is joining them.
    """

    def __init__(self, path: str, cache_size: int = 250_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        names = _byte_names()
        end = spec["model"]["end_of_word_suffix"]
        specials = {t["content"] for t in spec["added_tokens"]}
        size = len(spec["model"]["vocab"]) + len(specials)
        if size >= 0xD800:
            raise ValueError("ids of this vocabulary do not fit one UTF-16 unit")
        ranks = {}
        self.ends = np.zeros(size + 2, bool)
        for token, i in spec["model"]["vocab"].items():
            if token not in specials:
                body = token.removesuffix(end)
                self.ends[i] = len(body) < len(token)
                ranks[bytes(names[c] for c in body) + (MARK.encode() if self.ends[i] else b"")] = i
        # The marker byte alone only exists inside a word with an end; its own id moves out of the way.
        ranks[MARK.encode()] = size + 1
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.split = regex.compile(pattern + r"|\n")
        self.core = tiktoken.Encoding("word-bpe", pat_str=f"[^{MARK}]+{MARK}", mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.own = Tokenizer.from_file(path)
        self.specials = tuple(specials)
        self.cache_size = cache_size
        self.words: dict[str, str] = {"": ""}
        self.parts: dict[str, str] = {"\n": GAP}

    def _learn_parts(self, parts: list[str]) -> None:
        ids = np.array(self.core.encode_ordinary(MARK.join(parts) + MARK), "<u2")
        stops = (np.flatnonzero(self.ends[ids]) + 1).tolist()
        text = ids.tobytes().decode("utf-16-le")
        self.parts.update(zip(parts, (text[a:b] for a, b in zip([0, *stops], stops, strict=False)), strict=True))

    def _learn(self, words: list[str]) -> None:
        odd = []
        if not PLAIN.fullmatch("".join(words)) or any(s in w for s in self.specials for w in words if "<" in w):
            plain = [bool(PLAIN.fullmatch(w)) and not any(s in w for s in self.specials) for w in words]
            odd = [w for w, p in zip(words, plain, strict=True) if not p]
            words = [w for w, p in zip(words, plain, strict=True) if p]
        if words:
            parts = self.split.findall("\n".join(words).lower())
            new = list(set(parts).difference(self.parts))
            if new:
                self._learn_parts(new)
            self.words.update(zip(words, "".join(map(self.parts.__getitem__, parts)).split(GAP), strict=True))
        for w, e in zip(odd, self.own.encode_batch(odd, add_special_tokens=False) if odd else [], strict=True):
            self.words[w] = "".join(map(chr, e.ids))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text as uint16; a batch of texts should hold a few million characters at most."""
        if len(self.words) > self.cache_size:
            self.words = {"": ""}
        if len(self.parts) > self.cache_size:
            self.parts = {"\n": GAP}
        chunks = [t.replace("\n", " ").split(" ") for t in texts]
        new: set[str] = set()
        for c in chunks:
            new.update(set(c).difference(self.words))
        if new:
            self._learn(list(new))
        get = self.words.__getitem__
        return [np.frombuffer("".join(map(get, c)).encode("utf-16-le"), "<u2") for c in chunks]


def batches(texts: list[str], most: int = 2_000_000) -> list[slice]:
    """Slices of texts of about ``most`` characters; a longer text stands alone."""
    out, start, total = [], 0, 0
    for i, t in enumerate(texts):
        if total and total + len(t) > most:
            out.append(slice(start, i))
            start, total = i, 0
        total += len(t)
    return [*out, slice(start, len(texts))]
