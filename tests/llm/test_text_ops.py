from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lumenspark.llm import iso_media, lm_scoring, packing, pii, quality, sentence_pieces
from lumenspark.llm.word_bpe import WordBpe

from .conftest import SCHEMA, make

public_tokenizers = pytest.importorskip("public_tokenizers")
TO = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = ["", " ", "\n\n x\n", "it's I'M we'll 12 345½ ²x", "<|endoftext|>hi", "x\x01y \x00", "日本語 ไทย é ﬁ 😀", "▁a▁ ￿", "a" * 3000, "ΣΑΣ İ", "  a  b "]


# ---- quality --------------------------------------------------------------------------------


def test_quality_learns_and_ignores_the_held_out_fold(spark):
    rng = np.random.default_rng(0)
    good = [" ".join(rng.choice(["the", "river", "runs", "deep", "and", "cold"], 40)) for _ in range(150)]
    bad = [" ".join(f"{w}!!" for w in rng.choice(["BUY", "NOW", "CHEAP"], 40)) for _ in range(150)]
    rows = list(enumerate([x for p in zip(good, bad, strict=True) for x in p]))
    docs = make(spark, rows + [(1000, None), (1001, ""), (None, "the river")])
    flip = [(i, (1 - i % 2) if zlib.crc32(str(i).encode()) % 4 != 2 else i % 2, 0) for i, _ in rows]  # held-out labels lie
    labels = spark.createDataFrame(flip + [(5000, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.learn(docs, labels)
    out = quality.score(docs, model).collect()
    assert len(out) == len(rows) + 3 and all(0 <= r.score <= 1 for r in out)
    right = sum(r.predicted == 1 - r.doc_id % 2 for r in out if r.doc_id is not None and r.doc_id < 1000)
    assert right >= 0.98 * len(rows)
    same = {r.score for r in out if r.doc_id in (1000, 1001)}
    assert len(same) == 1


def test_quality_without_labels_is_constant(spark):
    docs = make(spark, [(1, "a"), (2, "b")])
    model = quality.learn(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r.score for r in quality.score(docs, model).collect()} == {0.5}
    assert quality.score(spark.createDataFrame([], SCHEMA), model).count() == 0


# ---- media ----------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 4096, 64 * 256, 64 * 256 + 1, 100_000])
def test_media_round_trip(n):
    raw = bytes(i * 7 % 251 for i in range(n))
    payload = iso_media.pad_payload(raw)
    assert len(payload) % 64 == 0 and len(payload) >= 64 and payload.startswith(raw)
    media = iso_media.write_media(payload)
    track = iso_media.read_track(memoryview(media))
    assert iso_media.stored_payload(memoryview(media), track) == payload
    told = iso_media.describe(media)
    assert told["codec"] == "raw " and told["payload_bytes"] == len(payload) and told["error"] is None
    first = told["keyframes"][0]
    assert media[first["start"] : first["start"] + first["length"]] == payload[:64]


def test_media_survives_bad_bytes(spark):
    media = iso_media.write_media(iso_media.pad_payload(b"x" * 200))
    rows = [(1, bytearray(media)), (2, bytearray(media[:-40])), (3, bytearray(b"no media")), (4, None), (5, bytearray()), (6, bytearray(media.replace(b"stsz", b"skip")))]
    out = {r.k: r.media for r in iso_media.media_columns(spark.createDataFrame(rows, "k int, content binary")).collect()}
    assert out[1].error is None and out[1].n_samples == 4
    assert all(out[k].error for k in (2, 3, 4, 5, 6))


def test_media_with_false_counts_and_bare_boxes_is_an_error():
    media = iso_media.write_media(iso_media.pad_payload(b"x" * 200))
    at = media.index(b"stsz") + 12
    assert media[at : at + 4] == (4).to_bytes(4, "big")
    assert "more samples" in iso_media.describe(media[:at] + (4_000_000_000).to_bytes(4, "big") + media[at + 4 :])["error"]
    tables = [iso_media.box(k, bytes(16)) for k in (b"hdlr", b"stsd", b"stts", b"stsc")]
    bare = iso_media.box(b"moov", iso_media.box(b"trak", *tables, iso_media.box(b"mdhd")))
    assert iso_media.describe(bare)["error"]


def test_stored_features_of_documents(spark, corpus):
    got = iso_media.stored_features(make(spark, corpus)).collect()
    assert len(got) == len(corpus)
    by_text = {}
    for r in got:
        text = next(t for i, t in corpus if i == r.doc_id)
        raw = (text or "").encode()
        pad = iso_media.pad_payload(raw)
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(raw), len(pad), zlib.crc32(pad[-64:]))
        assert by_text.setdefault(text or "", r.feature) == r.feature


# ---- language model --------------------------------------------------------------------------


@pytest.mark.parametrize("frequent", [1 << 20, 64])
def test_lm_base_score_is_exact(spark, corpus, monkeypatch, frequent):
    monkeypatch.setattr(lm_scoring, "FREQUENT", frequent)
    docs = make(spark, corpus)
    train = docs.where("doc_id % 3 <> 0")
    got = lm_scoring.lm_scores(docs, train).collect()
    tok = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(TO)) + ["\n"]
    c = Counter(w for i, t in corpus if i is not None and i % 3 for w in tok(t))
    n, v = sum(c.values()), len(c)
    texts = dict(corpus)
    assert len(got) == len(corpus)
    for r in got:
        t = tok(texts[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(c[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t))
        assert r.score < 0


def test_log_bloom_counts():
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 1 << 63, 20_000, dtype=np.uint64)
    counts = rng.geometric(0.2, 20_000)
    bits, data = lm_scoring.build_slice(keys, counts, 1 << 30)
    m = lm_scoring.Model(63, np.array([bits, bits]), np.array([0, 0]), np.frombuffer(data, np.uint8), keys[:0], counts[:0], 1, 1)
    got = m.counts(keys)
    want = lm_scoring.value(lm_scoring.level(counts))
    assert (got >= want - 1e-9).all() and (got > want + 1e-9).mean() < 0.06  # never under, seldom over
    assert (m.counts(rng.integers(0, 1 << 63, 20_000, dtype=np.uint64)) > 0).mean() < 0.06


def test_lm_score_does_not_depend_on_the_room_for_the_filter(spark, corpus, monkeypatch):
    docs = make(spark, corpus)
    train = docs.where("doc_id % 3 <> 0")
    scores = lambda: sorted((r.doc_id or -1, r.n_known, r.n_tokens, round(r.score, 6)) for r in lm_scoring.lm_scores(docs, train).collect())
    want = scores()
    monkeypatch.setattr(lm_scoring, "FILTER_BITS", 1 << 14)
    assert scores() == want


def test_lm_slice_keeps_rare_ngrams():
    keys = np.arange(1, 2001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    bits, data = lm_scoring.build_slice(keys, np.ones(2000, np.int64), 64)
    assert (lm_scoring._probe(keys, bits, data) > 0).all()


def test_lm_packs_what_a_large_filter_is_asked():
    rng = np.random.default_rng(4)
    kinds = rng.integers(0, 1 << 64, 30_000, dtype=np.uint64)
    tokens = kinds[np.minimum(rng.zipf(1.3, 200_000) - 1, len(kinds) - 1)]
    stored = lm_scoring.pack_tokens(tokens)
    assert (lm_scoring.unpack_tokens(*stored) == tokens & lm_scoring.KEEP).all()
    assert sum(map(len, stored)) < 3 * len(tokens)  # 8 bytes a token as hashes
    keys, where = lm_scoring._keys(tokens)
    assert (keys[where[len(tokens) :]] == lm_scoring.pairs(tokens) & lm_scoring.KEEP).all()
    assert len(lm_scoring.pack_keys(keys)) < 5.5 * len(keys)  # 8 as hashes
    high = keys[keys >= np.uint64(1 << 63)]
    assert (lm_scoring.unpack_keys(lm_scoring.pack_keys(high, 1 << 63), 1 << 63) == high).all()
    for x in ([], [0, 0], [1 << 63, 5]):
        assert lm_scoring.unpack(lm_scoring.pack(np.array(x, np.uint64))).tolist() == x


def test_lm_without_training_rows(spark):
    docs = make(spark, [(1, "a b"), (2, None)])
    got = {r.doc_id: r for r in lm_scoring.lm_scores(docs, docs.where("false")).collect()}
    assert got[1].base_score == 0 and got[1].n_known == 0 and got[2].n_tokens == 1


# ---- packing ---------------------------------------------------------------------------------


def test_word_bpe_equals_the_library(corpus):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    own, lib = WordBpe(path, cache_size=50), Tokenizer.from_file(path)
    texts = ODD + [t for _, t in corpus[:30] if t]
    for t, ids in zip(texts, own.encode(texts), strict=True):
        assert ids.tolist() == lib.encode(t, add_special_tokens=False).ids, t[:40]


def test_packing_is_gapless_and_whole(spark, corpus):
    path = public_tokenizers.path("word_bpe_49k.json")
    out = packing.pack(make(spark, corpus).repartition(3), path, with_ids=True).toPandas()
    own = WordBpe(path)
    assert len(out[out.piece == 0]) == len(corpus)
    texts = {i: t for i, t in corpus if i not in (405, None)}
    for doc, g in out.groupby("doc_id"):
        if doc in texts:
            g = g.sort_values("piece")
            ids = [*own.encode([texts[doc] or ""])[0].tolist(), 0]
            assert np.concatenate(g.ids.tolist()).tolist() == ids
            assert g.start.tolist() == list(range(0, len(ids), 2048))
            assert all(zlib.crc32(np.array(x, "<u4").tobytes()) == c for x, c in zip(g.ids, g.ids_crc32, strict=True))
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert (g.length.cumsum() - g.length).tolist() == g.offset.tolist() and g.length.sum() <= 2048
    assert packing.pack(spark.createDataFrame([], SCHEMA), path).count() == 0


def test_best_fit_takes_the_tightest_bin_and_closes_the_fullest():
    f = packing.BestFit(10, 2)
    a, _ = f.add(4)
    b, _ = f.add(7)
    assert f.add(3) == (b, 7)  # fills b, which closes
    c, _ = f.add(8)
    d, _ = f.add(9)  # no room, two open: the fullest (c) closes
    assert len({a, b, c, d}) == 4 and f.open == 2
    assert f.add(2) == (a, 4)


# ---- sentence pieces -------------------------------------------------------------------------


def test_pieces_are_optimal_and_round_trip(corpus):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp, own = sentencepiece.SentencePieceProcessor(model_file=path), sentence_pieces.Pieces(path, most=20)
    score = {sp.id_to_piece(i): sp.get_score(i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
    longest = max(map(len, score))

    def best(text):
        s = (" " + text).replace("▁", "\x00").replace(" ", "▁") if text else ""
        b = [0.0] + [-1e300] * len(s)
        for e in range(1, len(s) + 1):
            b[e] = b[e - 1] + own.unknown if s[e - 1] not in score else b[e]
            for a in range(max(0, e - longest), e):
                if s[a:e] in score:
                    b[e] = max(b[e], b[a] + score[s[a:e]])
        return b[-1]

    for t in ODD + [t[:800] for _, t in corpus[:6]]:
        ids = own.encode(t)
        assert own.decode(ids) == t
        got, raw = 0.0, b""
        for i in ids.tolist():
            if sp.is_byte(i):
                raw += bytes([int(sp.id_to_piece(i)[3:5], 16)])
            else:
                got += score[sp.id_to_piece(i)]
        assert got + own.unknown * len(raw.decode()) == pytest.approx(best(t))


def test_pieces_of_documents(spark, corpus):
    path = public_tokenizers.path("piece_bpe_32k.model")
    out = sentence_pieces.encode_documents(make(spark, corpus), path)
    assert out.where("not round_trip").count() == 0 and out.count() == len(corpus)
    back = sentence_pieces.decode_documents(out, path).select("doc_id", "decoded").collect()
    texts = dict(corpus)
    assert all(r.decoded == (texts[r.doc_id] or "") for r in back)


# ---- personal data ----------------------------------------------------------------------------

PLAIN = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def _luhn(d):
    return sum((v := int(c) * (1 + i % 2)) - 9 * (v > 9) for i, c in enumerate(reversed(d))) % 10 == 0


def _base(t):
    out = []
    for k, (kind, rx) in enumerate(PLAIN):
        for m in re.finditer(rx, t or ""):
            d = re.sub("[^0-9]", "", m.group())
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")), "card": 14 <= len(d) <= 19 and _luhn(d or "1"), "phone": 10 <= len(d) <= 15}[kind]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_pii_base_spans_match_brute_force(spark):
    texts = ["a@b.co_x@d.ef", "1.2.3.4.5.6.7.8 001.002.003.004 256.1.1.1 0.0.0.0", "4111 1111 1111 1111 x 4111-1111-1111-1112 1 4111111111111111", "+1 (017) 555-7713. +123 +1234567890123456 ++12 345 678 901", "é😀 a.b@c.d.e, 1.2.3.4@x.yz", "a" * 50_000 + "@", "x@y" + ".z" * 9000, None, "", "12  4111111111111111 - 5", "@@a@b..c a@b.c-d. %a@-.-", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" end', "clean words only"]
    docs = make(spark, list(enumerate(texts)) * 2)
    found = pii.find_spans(docs).collect()
    assert len(found) == 2 * len(texts)
    for r in found:
        assert [(x.s, x.k, x.e) for x in r.spans if x.base] == _base(texts[r.doc_id]), r.doc_id
    secret = [[x.k for x in r.spans] for r in found if r.doc_id == 11]
    assert secret == [[pii.KINDS.index("secret")]] * 2
    red = {r.doc_id: r.text for r in pii.redact(pii.find_spans(docs)).collect()}
    assert red[12] == texts[12] and red[7] is None and red[11] == 'token = "[SECRET]" end' and "4111 1111" not in red[2]


def test_pii_query_counts_each_kind(spark, tmp_path):
    texts = ["x a@b.c y", "mail a@b.c or d@e.f", "at 1.2.3.4 and 10.0.0.1, 4111 1111 1111 1111", "+49 (0) 30 1234567", "é a@b.c 1.2.3.4 4111111111111111 +1-202-555-0123 g@h.i 5.6.7.8", None, "", "none"]
    make(spark, list(enumerate(texts))).write.parquet(f"{tmp_path}/documents.parquet")
    for r in pii.op9_pii(spark, str(tmp_path)).collect():
        base = _base(texts[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for _, x, _ in base) for k in range(4)), r.doc_id
        assert r.base_sha256 == hashlib.sha256(",".join(f"{PLAIN[k][0]}:{a}:{b}" for a, k, b in base).encode()).hexdigest()


def test_pii_of_an_empty_table(spark):
    assert pii.find_spans(spark.createDataFrame([], SCHEMA)).count() == 0


def test_dawid_skene_tells_labelers_apart():
    import random

    rng = random.Random(1)
    rows = Counter()
    for _ in range(4000):
        truth = rng.random() < 0.5
        rows[tuple((1 if (rng.random() < p) == truth else -1) for p in (0.95, 0.9, 0.8, 0.75, 0.5))] += 1
    _, table = pii.estimate(sorted(rows.items()))
    right = [t[1][0] for t in table]
    assert right[0] > right[2] > right[4] and abs(right[4] - 0.5) < 0.08
