from __future__ import annotations

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenspark.functions import checks, geocues, payload, pixels, regex
from lumenspark.operators import statistics as st


def values(spark, rows, schema, **cols):
    return spark.createDataFrame(rows, schema).select("*", *(c.alias(n) for n, c in cols.items())).collect()


@pytest.mark.parametrize(
    ("text", "ok"), [("4111111111111111", True), ("4111 1111 1111 1111", True), ("5500005555555559", True), ("4111111111111112", False), ("1234567890123", False), ("123", False)]
)
def test_luhn(spark, text, ok):
    assert values(spark, [(text,)], "t string", v=checks.luhn_valid(F.col("t")))[0].v is ok


def test_iban_brand_entropy_mask(spark):
    rows = [("GB82WEST12345698765432",), ("GB82 WEST 1234 5698 7654 32",), ("GB82WEST12345698765433",), ("NOTANIBAN",)]
    assert [r.v for r in values(spark, rows, "t string", v=checks.iban_valid(F.col("t")))] == [True, True, False, False]
    rows = [("4111111111111111",), ("378282246310005",), ("5500005555555559",), ("2221000000000009",), ("6011000000000004",), ("9",)]
    assert [r.v for r in values(spark, rows, "t string", v=checks.card_brand(F.col("t")))] == ["Visa", "American Express", "Mastercard", "Mastercard", "Discover", "unknown issuer"]
    rows = [("k3J8vN2pQrX9zLmW4tYb",), ("a" * 20,), ("",)]
    got = values(spark, rows, "t string", v=checks.high_entropy(F.col("t")), e=checks.text_entropy(F.col("t")))
    assert [r.v for r in got] == [True, False, False] and got[2].e == 0
    rows = [("ada@example.org", "email"), ("alice@x.de", "email"), ("4111 1111 1111 1111", "credit_card"), ("secret12", "other"), ("abcdefghijklmnopqrst", "other")]
    got = [r.v for r in values(spark, rows, "t string, k string", v=checks.mask(F.col("t"), F.col("k")))]
    assert got == ["a***@example.org", "al***@x.de", "4111********1111", "s*******", "abcd" + "*" * 12 + "qrst"]


def test_spans_and_context(spark):
    rows = [("é😀 ab 12 cd 345",), ("",), (None,), ("12",)]
    got = values(spark, rows, "t string", v=regex.find_spans(F.col("t"), "[0-9]+"))
    assert [(m.start, m.end, m.value) for m in got[0].v] == [(6, 8, "12"), (12, 15, "345")]
    assert got[1].v == [] and not got[2].v and [(m.start, m.end) for m in got[3].v] == [(0, 2)]
    c = values(spark, [("x" * 30 + "HIT" + "y" * 30, 30, 33)], "t string, a int, b int", v=regex.context(F.col("t"), F.col("a"), F.col("b")))[0].v
    assert c == "…" + "x" * 24 + "[…]" + "y" * 24 + "…"


def test_payloads(spark):
    rows = [(r"WIFI:T:WPA;S:my\;net;P:pa\:ss;H:TRUE;;",), ("otpauth://totp/ACME:ada?secret=X&issuer=ACME",), ("BEGIN:VCARD\nFN:Ada L\nTEL;CELL:+1\nEMAIL:a@b.c\nORG:ACME",), ("geo:1.5,-2",), ("https://h.org:99999/",), (None,)]
    got = [r.payload for r in payload.interpret(spark.createDataFrame(rows, "t string"), "t").collect()]
    assert (got[0].wifi.ssid, got[0].wifi.password, got[0].wifi.hidden) == ("my;net", "pa:ss", True)
    assert (got[1].otpauth.label, got[1].otpauth.issuer, got[1].otpauth.secret_present, got[1].otpauth.algorithm) == ("ACME:ada", "ACME", True, "SHA1")
    assert (got[2].contact.name, got[2].contact.phone, got[2].contact.email, got[2].contact.org) == ("Ada L", "+1", "a@b.c", "ACME")
    assert (got[3].geo.latitude, got[3].geo.longitude) == (1.5, -2.0)
    assert got[4].url.port is None and got[4].url.host == "h.org"
    assert got[5].kind == "text"


def test_country_cues(spark):
    rows = [(1, "SW1A 2AA"), (2, "Bahnhofstraße 3"), (3, "+44 20"), (4, "see example.co.uk"), (5, "+1 55"), (6, ""), (7, None), (8, "ACME Inc.")]
    got = {r.k: {(c.country, c.kind) for c in r.v} for r in values(spark, rows, "k int, t string", v=geocues.cues(F.col("t")))}
    assert ("GB", "postcode") in got[1] and ("DE", "address") in got[2] and ("GB", "phone") in got[3] and ("GB", "domain") in got[4]
    assert {("US", "phone"), ("CA", "phone")} <= got[5] and got[6] == got[7] == set() and ("US", "business") in got[8]


def test_pixel_primitives():
    assert pixels.dct2(np.full((8, 8), 10.0))[0, 0] == pytest.approx(80)
    white, black = pixels.lab(np.full((1, 1, 3), 255)), pixels.lab(np.zeros((1, 1, 3)))
    assert white[0, 0, 0] == pytest.approx(100, abs=0.5) and black[0, 0, 0] == pytest.approx(0, abs=0.5)
    assert pixels.laplacian_variance(np.zeros((2, 2))) == 0 and pixels.noise_sigma(np.full((64, 64), 7.0)) == pytest.approx(0, abs=0.01)
    rng = np.random.default_rng(1)
    for sigma in (5, 15):
        assert pixels.noise_sigma(128 + rng.normal(0, sigma, (200, 200))) == pytest.approx(sigma, rel=0.15)
    g = _pink(9, 200, 300)
    far = lambda a, b: bin(int(a, 16) ^ int(b, 16)).count("1")
    for h in (pixels.average_hash, pixels.difference_hash, pixels.perceptual_hash):
        assert len(h(g)) == 16 and far(h(g), h(pixels.resize(g, 150, 100))) <= 6


def _pink(seed, h=256, w=256):
    rng = np.random.default_rng(seed)
    f = np.hypot(np.fft.fftfreq(h)[:, None], np.fft.fftfreq(w)[None, :])
    f[0, 0] = 1
    x = np.fft.ifft2(np.fft.fft2(rng.normal(size=(h, w))) / f).real
    return np.clip(128 + 40 * x / x.std(), 0, 255)


def test_ghosts_localise_a_splice_and_spare_a_clean_picture():
    host = pixels.quantised(_pink(3), 95)
    assert pixels.ghost_map(host) == []
    donor = pixels.quantised(_pink(4), 35)
    spliced = host.copy()
    spliced[64:128, 96:192] = donor[64:128, 96:192]
    found = pixels.ghost_map(pixels.quantised(spliced, 95))
    assert found and all(30 <= q <= 45 and 2 <= r <= 3 and 3 <= c <= 5 for r, c, q in found)


def test_jpeg_quality_and_classes(spark):
    rows = [(q, st.scaled_table(q)) for q in (50, 75, 90, 95)]
    got = values(spark, rows, "q int, t array<int>", v=st.jpeg_quality(F.col("t")))
    assert all(abs(r.v.quality - r.q) <= 3 and r.v.standard for r in got)
    got = values(spark, [(1.0, 10.0), (2.0, 300.0), (7.0, 500.0)], "e double, s double", v=st.content_class(F.col("e"), F.col("s")))
    assert [r.v for r in got] == ["blank", "graphic", "photograph"]


def test_statistics_edges(spark):
    few = spark.createDataFrame([("a", float(i)) for i in range(15)] + [("b", 5.0)] * 20 + [("b", 900.0)], "g string, v double")
    out = st.mad_outliers(few, ["g"], "v").collect()
    assert [(r.g, r.v) for r in out] == [("b", 900.0)]
    rng = random.Random(1)
    bits = st.histogram_entropy(spark.createDataFrame([(rng.randrange(4),) for _ in range(4000)], "s int"), [], "s").first().bits
    assert bits == pytest.approx(2, abs=0.01)
    d = values(spark, [(0.0012,), (950.0,), (-3.0,), (0.0,), (1000.0,)], "v double", d=st.first_digit(F.col("v")))
    assert [r.d for r in d] == [1, 9, 3, None, 1]
    assert math.isclose(sum(math.log10(1 + 1 / i) for i in range(1, 10)), 1)


def test_country_evidence_searches_whole_texts(spark):
    filler = "plain words " * 3000
    rows = [(i, filler + "| " + text + " |", "xx") for i, text, _ in geocues.SAMPLES] + [(11, None, "de"), (12, "Muster GmbH", "de"), (13, "", "en")]
    got = {(r.doc_id, r.country): (r.confidence, r.cue_kinds) for r in geocues.country_evidence(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    best = {}
    for i, text, lang in rows:  # brute force over the same rules
        text, found = text or "", []
        found += [(c, kind, w) for kind, rx, c, w, _ in geocues.PATTERNS for _ in re.finditer(rx, text)]
        for m in re.finditer(r"\+\s?(\d{1,3})[\s\-().]?\d", text):
            code = next((m[1][:n] for n in (3, 2, 1) if m[1][:n] in geocues.DIALLING), None)
            many = geocues.AMBIGUOUS.get(code)
            found += [(c, "phone", 0.35) for c in many] if many else [(geocues.DIALLING[code], "phone", 0.8)] if code else []
        for m in re.finditer(r"(?i)(?:https?://)?(?:[\w-]+\.)+([a-z]{2,})(?:\.([a-z]{2}))?", text):
            country = geocues.DOMAINS.get((m[2] or m[1]).lower())
            found += [(country, "domain", 0.7)] if country else []
        found += [(c, "currency", w) for sign, c, w in geocues.CURRENCIES if sign in text]
        found += [("DE", "language", 0.25)] if lang == "de" else []
        for c, kind, w in found:
            kinds = best.setdefault((i, c), {})
            kinds[kind] = max(w, kinds.get(kind, 0))
    want = {k: (round(1 - math.prod(1 - w for w in v.values()), 4), ", ".join(sorted(v))) for k, v in best.items()}
    assert got.keys() == want.keys()
    assert all(abs(got[k][0] - want[k][0]) < 2e-4 and got[k][1] == want[k][1] for k in want), (got, want)
    assert got[12, "DE"][1] == "business, language" and (6, "KZ") in got
