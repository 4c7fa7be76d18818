from __future__ import annotations

import json
import random
import struct
import zlib
from collections import Counter
from datetime import date
from functools import reduce

import pytest
from pyspark.sql import functions as F

from lumenspark.operators import blocks, detection, report, rules, sensitive, similarity, store
from lumenspark.plans import planner
from lumenspark.sources import images
from lumenspark.streaming import incremental


def test_hamming_pairs_match_brute_force(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(30)]
    keys = base + [b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base] + base[:3]
    df = spark.createDataFrame([(i, f"{k:016x}") for i, k in enumerate(keys)] + [(900, None), (901, "")], "id int, h string")
    for radius in (0, 4, 12):
        want = {(i, j, bin(a ^ b).count("1")) for i, a in enumerate(keys) for j, b in enumerate(keys) if i < j and bin(a ^ b).count("1") <= radius}
        got = [tuple(r) for r in similarity.hamming_pairs(df, "id", "h", radius).collect()]
        assert set(got) == want and len(got) == len(want)


def test_clusters_link_by_any_hash(spark):
    df = spark.createDataFrame([(1, "0" * 16, "f" * 16), (2, "0" * 15 + "3", None), (3, "0" * 15 + "f", None), (4, "f" * 16, "0" * 16), (5, "a" * 16, "0" * 15 + "1")], "id int, p string, d string")
    got = {(r.cluster, r.id): r.distance for r in similarity.cluster_multi(df, "id", ["p", "d"], 2).collect()}
    assert got == {(1, 1): 0, (1, 2): 2, (1, 3): 2, (4, 4): 0, (4, 5): 1}


def test_hamming_blocks_meet_once_and_find_every_pair(spark, monkeypatch):
    rng = random.Random(6)
    keys = [rng.getrandbits(64) for _ in range(90)]
    keys += [k ^ (1 << rng.randrange(64)) for k in keys[:20]] + [keys[0]] * 15
    rows = [(i, f"{k:016x}".upper() if i % 3 else f"{k:016x}") for i, k in enumerate(keys)]
    df = spark.createDataFrame(rows, "id long, h string").repartition(3)
    want = {(i, j, (a ^ b).bit_count()) for i, a in enumerate(keys) for j, b in enumerate(keys) if i < j and (a ^ b).bit_count() <= 24}
    for n in (1, 5):
        monkeypatch.setattr(similarity, "_dealt", lambda df, n=n: n)
        packed = blocks.pack(df, n, "id")
        assert blocks.cells(packed, n, packed, n, True).count() == n * (n + 1) // 2
        got = [tuple(r) for r in similarity.hamming_pairs(df, "id", "h", 24).collect()]
        assert set(got) == want and len(got) == len(want)


def test_clusters_match_brute_force(spark, monkeypatch):
    rng = random.Random(9)
    some = [rng.getrandbits(64) for _ in range(25)]
    near = lambda: rng.choice(some) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5)))
    rows = [(i, near() if rng.random() < 0.5 else rng.getrandbits(64), None if rng.random() < 0.3 else near() if rng.random() < 0.3 else rng.getrandbits(64)) for i in range(70)]
    rows += [(100 + i, some[0], None) for i in range(10)]
    link = {}
    for i, *x in rows:
        for j, *y in rows:
            d = min((a ^ b).bit_count() for a, b in zip(x, y, strict=True) if a is not None and b is not None)
            if i < j and d <= 4:
                link[i, j] = d
    label = {i: i for i, *_ in rows}
    for _ in rows:
        for i, j in link:
            label[i] = label[j] = min(label[i], label[j])
    size = Counter(label.values())
    want = {(c, i, 0 if i == c else link.get((c, i), 4), i == c or (c, i) in link) for i, c in label.items() if size[c] > 1}
    df = spark.createDataFrame([(i, f"{a:016x}", None if b is None else f"{b:016x}") for i, a, b in rows], "id long, p string, d string")
    monkeypatch.setattr(similarity, "_dealt", lambda df: 4)
    got = [tuple(r) for r in similarity.cluster_multi(df, "id", ["p", "d"], 4).collect()]
    assert set(got) == want and len(got) == len(want)


def test_each_hash_has_its_width_checked(spark):
    df = spark.createDataFrame([(1, "0" * 16), (2, "ff")], "id int, h string")
    with pytest.raises(Exception, match="16 hex"):
        similarity.cluster_multi(df, "id", ["h"], 2).collect()


def test_width_mismatch_is_an_error(spark):
    with pytest.raises(Exception, match="16 hex"):
        spark.createDataFrame([("ff", "0" * 16)], "a string, b string").select(similarity.hamming(F.col("a"), F.col("b"))).collect()


def test_entity_verdicts(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 0.0, 1.0])], "query_id int, vector array<double>")
    one = spark.createDataFrame([(1, "a", [1.0, 0.0, 0.0]), (2, "b", [0.999, 0.045, 0.0])], "ref_id int, entity string, vector array<double>")
    got = {r.query_id: r.verdict for r in similarity.entity_verdicts(similarity.entity_scores(q, one)).collect()}
    assert got == {1: "inconclusive", 2: "no match"}
    alone = similarity.entity_verdicts(similarity.entity_scores(q, one.where("entity = 'a'"))).where("query_id = 1").first()
    assert alone.verdict == "match" and alone.margin == 0.0
    blocked = similarity.entity_scores(q, one)
    old, similarity.BROADCAST_BYTES = similarity.BROADCAST_BYTES, 0
    try:
        assert sorted(map(tuple, similarity.entity_scores(q, one, 3).collect())) == sorted(map(tuple, blocked.collect()))
    finally:
        similarity.BROADCAST_BYTES = old


def test_entity_scores_of_blocks_match_brute_force(spark):
    rng = random.Random(8)
    vec = lambda: [rng.choice((-1.0, -0.5, 0.1, 0.3, 0.7)) for _ in range(7)]  # noqa: E731 - many ties
    some = [vec() for _ in range(9)]
    q = [(i, rng.choice(some)) for i in range(23)]
    r = [(i, rng.choice("abc"), rng.choice(some)) for i in range(61)] + [(99, None, vec())]
    dot = lambda a, b: reduce(lambda t, xy: t + xy[0] * xy[1], zip(a, b, strict=True), 0.0)
    want = {}
    for i, v in q:
        for j, e, w in r:
            want[i, e] = max(want.get((i, e), (-9.0, -1)), (dot(v, w), j))
    qs = spark.createDataFrame(q, "query_id int, vector array<double>")
    rs = spark.createDataFrame(r, "ref_id int, entity string, vector array<double>")
    qv, rv = qs.select("query_id", F.col("vector").alias("qv")), rs.select("ref_id", "entity", F.col("vector").alias("rv"))
    for n, m in ((1, 1), (3, 4)):
        met = blocks.best_scores(qv, n, rv, m)
        assert met.count() <= len(want) * m  # no row for a pair leaves its cell
        best = {}
        for x in met.collect():
            best[x.query_id, x.entity] = max(best.get((x.query_id, x.entity), (-9.0, -1)), (x.similarity, x.ref_id))
        assert best == want
    assert {(x.query_id, x.entity): (x.similarity, x.ref_id) for x in similarity.entity_scores(qs, rs).collect()} == want
    with pytest.raises(Exception, match="differ in dimension"):
        similarity.entity_scores(qs, rs.union(spark.createDataFrame([(200, "a", [1.0])], rs.schema))).collect()
    assert similarity.entity_scores(qs, rs.where("false")).count() == 0 and similarity.entity_scores(qs.where("false"), rs).count() == 0


def _embeddings(spark, folder):
    rng = random.Random(12)
    some = [[rng.uniform(-1, 1) for _ in range(64)] for _ in range(12)]
    rows = [(i, [x + rng.uniform(-0.4, 0.4) if i % 3 else x for x in rng.choice(some)], rng.randrange(8)) for i in range(80)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(f"{folder}/embeddings.parquet")
    return [tuple(r) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]


def test_pair_verdicts_of_a_table(spark, tmp_path):
    keys = {i: sum((x >= 0) << b for b, x in enumerate(v)) for i, v, _ in _embeddings(spark, tmp_path)}
    kind = lambda d: "identical pixels" if d == 0 else "near-identical" if d <= 12 else "similar"
    want = {(i, j, kind(d)) for i, a in keys.items() for j, b in keys.items() if i < j and (d := (a ^ b).bit_count()) <= 18}
    out = similarity.pair_verdicts(spark, str(tmp_path))
    assert "posexplode" not in out._jdf.queryExecution().toString()  # no join on bands, whose rows are nearly all pairs
    got = [tuple(r) for r in out.collect()]
    assert set(got) == want and len(got) == len(want) and len({v for *_, v in want}) == 3


def test_entity_top5_of_a_table(spark, tmp_path):
    rows = _embeddings(spark, tmp_path)
    out = similarity.entity_top5(spark, str(tmp_path))
    assert "zip_with" not in out._jdf.queryExecution().toString()  # no row that holds a pair's vectors
    want = set()
    for q, v, _ in rows:
        best = {}
        for r, w, e in rows:
            if q % 10 == 0 and r % 10:
                best[e] = max(best.get(e, (-99.0, -1)), (reduce(lambda t, xy: t + xy[0] * xy[1], zip(v, w, strict=True), 0.0), r))
        for rank, e in enumerate(sorted(best, key=best.get, reverse=True)[:5], 1):
            want.add((q, rank, e, round(best[e][0], 4)))
    got = [tuple(r) for r in out.collect()]
    assert set(got) == want and len(got) == len(want) == 40


def test_planner():
    assert {a.name for a in planner.select(planner.REGISTRY, "standard")} <= {a.name for a in planner.select(planner.REGISTRY, "deep")}
    assert all(a.cost == "cheap" for a in planner.select(planner.REGISTRY, "quick"))
    for p in planner.PROFILES:
        names = {a.name for a in planner.select(planner.REGISTRY, p)}
        assert all(set(a.requires) <= names for a in planner.REGISTRY if a.name in names)
        seen = set()
        for a in planner.order(planner.select(planner.REGISTRY, p)):
            assert set(a.requires) <= seen
            seen.add(a.name)
    A = planner.Analyzer
    with pytest.raises(planner.CycleError):
        planner.order([A("a", requires=("b",)), A("b", requires=("a",))])
    with pytest.raises(planner.SelectionError):
        planner.plan(planner.REGISTRY, only=["nothing"])
    assert [a.name for a in planner.plan(planner.REGISTRY, only=["gps"])] == ["exif", "gps"]
    assert "exif" in {a.name for a in planner.plan(planner.REGISTRY, exclude=("exif",))}


@pytest.mark.parametrize(
    ("body", "says"),
    [("[]", "mapping"), ('{"name": "Bad Name", "rules": []}', "name"), ('{"name": "a", "rules": []}', "at least one"), ('{"name": "a", "rules": [{"id": "x", "label": "l"}]}', "exactly one"), ('{"name": "a", "rules": [{"id": "x", "exif_missing": "a", "text_contains": "b", "label": "l"}]}', "exactly one"), ('{"name": "a", "rules": [{"id": "x", "exif_missing": "a"}]}', "label"), ('{"name": "a", "rules": [{"id": "x", "exif_missing": "a", "label": "l", "severity": "dire"}]}', "severity"), ('{"name": "a", "rules": [{"id": "x", "exif_missing": "a", "label": "l", "confidence": 2}]}', "confidence"), ('{"name": "a", "rules": [{"id": "x", "text_matches": "(", "label": "l"}]}', "regular expression"), ('{"name": "a", "rules": [{"id": "x", "exif_missing": "a", "label": "l"}, {"id": "x", "exif_missing": "a", "label": "l"}]}', "repeat")],
)
def test_malformed_rules_name_their_problem(body, says):
    with pytest.raises(rules.RuleError, match=says):
        rules.parse(body)


def test_manifest_and_store(spark):
    m = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "relpath string, sha256 string")
    f = spark.createDataFrame([("a", "1"), ("b", "x"), ("d", "4")], "relpath string, sha256 string")
    assert {tuple(r) for r in store.manifest_diff(m, f).collect()} == {("b", "modified"), ("c", "missing"), ("d", "unlisted")}
    assert store.manifest_diff(m, m).count() == 0
    jobs = spark.createDataFrame([("p", "done", None, date(2024, 1, 1)), ("q", "failed", "e", date(2024, 1, 1))], "path string, status string, error string, updated_utc date")
    new = store.mark(jobs, spark.createDataFrame([("q", None), ("r", "x")], "path string, error string"), F.lit(date(2024, 2, 1)))
    assert {(r.path, r.status) for r in new.collect()} == {("p", "done"), ("q", "done"), ("r", "failed")}
    assert [r.path for r in store.resume(spark.createDataFrame([("p",), ("r",), ("s",)], "path string"), new).orderBy("path").collect()] == ["r", "s"]


def test_scan_edges(spark):
    d = spark.createDataFrame([(1, None), (2, ""), (3, "a@b.com a@b.com tel: 555-1234567; sk_k3J8vN2pQrX9zLmW4tYb, 219-09-9999; 000-12-3456")], "k int, t string")
    got = [(r.id, r.type) for r in sensitive.scan(d, "k", "t").orderBy("position").collect()]
    assert got == [(3, "email"), (3, "generic_secret"), (3, "us_ssn"), (3, "phone")]
    s = sensitive.summarise(sensitive.findings(sensitive.scan(d, "k", "t"))).first()
    assert s.findings_total == 5 and s.findings_high == 3 and s.top_findings.startswith("API key or secret=")


def test_nms_and_head(spark):
    d = spark.createDataFrame([(1, [0.0, 0.0, 10.0, 10.0], 0.9, 0), (1, [1.0, 1.0, 10.0, 10.0], 0.8, 0), (1, [1.0, 1.0, 10.0, 10.0], 0.7, 1), (1, [50.0, 50.0, 60.0, 60.0], 0.6, 0), (1, [0.0, 0.0, 5.0, 5.0], 0.1, 0)], "image_id int, box array<double>, score double, class_id int")
    assert [r.score for r in detection.nms(d).orderBy("rank").collect()] == [0.9, 0.7, 0.6]
    assert [r.score for r in detection.nms(d, per_class=False).orderBy("rank").collect()] == [0.9, 0.6]
    v = [0.5, 0.5, 0.0, 0.0, 0.8, 0.1, 0.9]
    a = spark.createDataFrame([(1, 9, v), (1, 64 + 16, v)], "image_id int, anchor int, v array<double>")
    got = detection.decode_head(a, 64, 64).orderBy("anchor").collect()
    assert got[0].box == [8.0, 8.0, 16.0, 16.0] and got[0].class_id == 1 and got[0].score == pytest.approx(0.72)
    assert got[1].box == [0.0, 0.0, 32.0, 32.0]
    with pytest.raises(Exception, match="anchor outside"):
        detection.decode_head(spark.createDataFrame([(1, 84, v)], a.schema), 64, 64).collect()


def _png(w, h):
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    raw = b"".join(b"\0" + bytes((x * 7 + y * 3 + c * 50) % 256 for x in range(w) for c in range(3)) for y in range(h))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_image_files_to_measures(spark, tmp_path):
    from lumenspark.functions.pixels import measures

    (tmp_path / "sub").mkdir()
    (tmp_path / "a.png").write_bytes(_png(40, 30))
    (tmp_path / "sub" / "IMG-20230415-WA0007.JPG").write_bytes(_png(40, 30))
    (tmp_path / "b.png").write_bytes(b"not an image")
    (tmp_path / "notes.txt").write_bytes(b"x")
    files = images.find_images(spark, str(tmp_path))
    rows = {r.path.rsplit("/", 1)[-1]: r for r in files.select("path", images.headers(F.col("content")).alias("h"), images.mismatch(F.col("path"), F.col("content")).alias("m"), images.digests(F.col("content")).alias("d")).collect()}
    assert set(rows) == {"a.png", "b.png", "IMG-20230415-WA0007.JPG"}
    assert (rows["a.png"].h.width, rows["a.png"].h.height, rows["a.png"].h.error) == (40, 30, None)
    assert rows["b.png"].h.error and rows["IMG-20230415-WA0007.JPG"].m and not rows["a.png"].m
    assert len(rows["a.png"].d.blake2b) == 64
    px = spark.read.format("image").load(str(tmp_path / "*.png")).select("image.*")
    got = {r.origin.rsplit("/", 1)[-1]: r.m for r in px.select("origin", measures(F.col("data"), F.col("width"), F.col("height"), F.col("nChannels")).alias("m")).collect()}
    assert got["a.png"].error is None and len(got["a.png"].phash) == 16
    assert got.get("b.png") is None or got["b.png"].error


def test_jpeg_header_and_coordinates(spark):
    ifd = struct.pack("<2sHIH", b"II", 42, 8, 1) + struct.pack("<HHI4s", 0x010F, 2, 4, b"ACM\0") + bytes(4)
    seg = lambda k, b: bytes([0xFF, k]) + struct.pack(">H", len(b) + 2) + b
    jpeg = b"\xff\xd8" + seg(0xE1, b"Exif\0\0" + ifd) + seg(0xDB, bytes([0]) + bytes(range(1, 65))) + seg(0xC0, struct.pack(">BHHB", 8, 20, 30, 3)) + b"\xff\xda\0\x02"
    h = images.read_header(jpeg)
    assert (h["width"], h["height"], h["quant"][0][:3]) == (30, 20, [1, 2, 3]) and h["exif"] == [{"tag": 0x010F, "value": "ACM"}]
    assert images.read_header(jpeg[:30])["error"] and images.read_header(b"")["error"] == "empty file"
    r = spark.createDataFrame([("48/1 51/1 3024/100", "N"), ("2/1 17/1 402/10", "W"), ("-5", None), ("x", "N")], "d string, r string").select(images.dms_to_decimal(F.col("d"), F.col("r")).alias("v")).collect()
    assert r[0].v == pytest.approx(48.8584) and r[1].v == pytest.approx(-2.2945) and r[2].v == -5 and r[3].v is None


def test_flat_row_has_its_columns_and_failed_inputs_a_row(spark):
    assert len(report.FLAT_COLUMNS) == len(set(report.FLAT_COLUMNS)) == 66
    bad = report.failed_row(spark.createDataFrame([("x/y.png", "boom")], "path string, error string")).first()
    assert (bad.path, bad.filename, bad.error, bad.width) == ("x/y.png", "y.png", "boom", None) and tuple(bad.asDict()) == report.FLAT_COLUMNS
    blocks = {"target": {"path": "p/a.jpg", "filename": "a.jpg", "size_bytes": 5}, "fileinfo": {"width": 4, "filename_sources": ["WhatsApp", "x"]}, "objects": {"count": 3, "counts_by_label": {"person": 2, "dog": 1}}, "gps": {"place": {"name": "Paris", "admin1": "", "country_code": "FR"}}}
    res = spark.createDataFrame([(1, k, "ok", json.dumps(v), 2.0, None) for k, v in blocks.items()] + [(1, "blur", "error", "{}", 1.0, "e"), (1, "faces", "skipped", None, 0.0, "r")], "image_id int, analyzer string, status string, data string, duration_ms double, error string")
    fin = spark.createDataFrame([(1, "exif", "device", "Camera", "Canon", "info", 1.0, None, 0), (1, "x", "b", "Second", None, "high", 1.0, None, 0), (1, "x", "a", "First", "v", "high", 1.0, None, 0)], "image_id int, analyzer string, category string, label string, value string, severity string, confidence double, detail string, position int")
    row = report.flatten(report.envelope(res, fin)).first()
    assert (row.camera, row.place, row.objects, row.people_count, row.filename_source, row.top_findings) == ("Canon", "Paris, FR", "person x2, dog", 2, "WhatsApp, x", "First=v; Second")
    assert (row.analyzers_ok, row.analyzers_failed, row.findings_high, row.findings_total) == (4, 1, 2, 3)
    page = report.render_html({"filename": "<a>", "findings": [{"severity": "high", "label": "<b>", "value": ["x", 1], "confidence": 0.5, "bbox": [0, 0, 4, 5]}]})
    assert "<b>" not in page and "&lt;b&gt;" in page and "x, 1" in page and "width='4'" in page


def test_stream_upserts_each_batch_once(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    (src / "a.png").write_bytes(b"1")
    analyse = lambda b: b.select("path", "length")
    for name, body in (("a.png", b"1"), ("b.png", b"22")):
        (src / name).write_bytes(body)
        incremental.upsert_stream(incremental.image_stream(spark, str(src)), analyse, str(out), str(tmp_path / "ck")).awaitTermination(60)
    assert sorted(r.length for r in incremental.latest(spark, str(out)).collect()) == [1, 2]


def test_entry_and_catalogue(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
