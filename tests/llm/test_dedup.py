from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import pytest

from lumenspark.llm import exact_dedup, line_dedup, ngram_join

from .conftest import SCHEMA, make

TO = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_exact_dedup_matches_brute_force(spark, corpus):
    got = exact_dedup.exact_dedup(make(spark, corpus), digest_all=True).collect()
    groups = defaultdict(list)
    for i, t in corpus:
        groups[(t or "").translate(TO)].append(i)
    assert len(got) == len(corpus)
    by_digest = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    kept = defaultdict(int)
    for r in got:
        ids = by_digest[bytes(r.text_sha256).hex()]
        assert r.group_size == len(ids) and r.doc_id in ids
        assert r.keep_id == max((i for i in ids if i is not None), default=None)
        kept[bytes(r.text_sha256).hex()] += r.kept
    assert set(kept.values()) == {1}


def test_exact_dedup_drops_all_but_one(spark, corpus):
    out = exact_dedup.drop_exact_copies(make(spark, corpus))
    texts = [(r.text or "").translate(TO) for r in out.select("text").collect()]
    assert len(texts) == len(set(texts)) == len({(t or "").translate(TO) for _, t in corpus})
    assert out.columns == make(spark, []).columns


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.exact_dedup(empty).count() == 0
    assert exact_dedup.drop_exact_copies(empty).count() == 0
    assert ngram_join.ngram_join(empty).count() == 0
    assert line_dedup.line_dedup(empty).count() == 0


def _shingles(t):
    w = (t or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def _brute_force(rows):
    """id -> (class_id, n_links), for distinct ids without nulls."""
    sets = [(i, _shingles(t)) for i, t in rows]
    label, degree = {i: i for i, _ in sets}, {i: 0 for i, _ in sets}
    for x, (i, a) in enumerate(sets):
        for j, b in sets[x + 1 :]:
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                degree[i] += 1
                degree[j] += 1
                low, high = sorted((label[i], label[j]))
                if low != high:
                    label = {k: low if v == high else v for k, v in label.items()}
    return {i: (label[i], degree[i]) for i, _ in sets}


def _edited(base, edits, rng, tag):
    words = list(base)
    for at in rng.sample(range(len(words)), edits):
        words[at] = f"{tag}_{at}"
    return words


def test_ngram_join_of_a_group_around_the_threshold(spark):
    rng = random.Random(11)
    base = [f"w{i}" for i in range(200)]
    rows = [(k, " ".join(_edited(base, 3, rng, f"x{k}"))) for k in range(300)]
    want = _brute_force(rows)
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.ngram_join(make(spark, rows)).collect()}
    wrong = [(i, got[i], want[i]) for i in want if got[i] != want[i]]
    assert not wrong, (len(wrong), len(want), wrong[:5])


def test_ngram_join_of_a_bucket_that_no_split_takes_apart(spark):
    rng = random.Random(12)
    base, rows = [f"w{i}" for i in range(200)], []
    for k in range(60):  # pairs of near copies, each pair under 0.8 to the others
        family = _edited(base, 6, rng, f"x{k}")
        rows += [(2 * k, " ".join(family)), (2 * k + 1, " ".join([*family[:-1], f"y{k}"]))]
    want = _brute_force(rows)
    assert len({c for c, _ in want.values()}) > 50
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.ngram_join(make(spark, rows), leaf=8, deepest=1).collect()}
    wrong = [(i, got[i], want[i]) for i in want if got[i] != want[i]]
    assert not wrong, (len(wrong), len(want), wrong[:5])


def test_ngram_join_matches_brute_force(spark, corpus):
    got = ngram_join.ngram_join(make(spark, corpus)).collect()
    sets = [(i, _shingles(t)) for i, t in corpus]
    near = lambda a, b: a == b or 5 * len(a & b) >= 4 * len(a | b)
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    degree = defaultdict(list)
    for x, (i, a) in enumerate(sets):
        n = 0
        for y, (_, b) in enumerate(sets):
            if x != y and near(a, b):
                n += 1
                parent[root(x)] = root(y)
        degree[i].append(n)
    classes = defaultdict(list)
    for x, (i, _) in enumerate(sets):
        classes[root(x)].append(i)
    want = {}
    for x, (i, _) in enumerate(sets):
        want[i] = min((j for j in classes[root(x)] if j is not None), default=None)
    assert len(got) == len(corpus)
    for r in got:
        assert r.class_id == want[r.doc_id], r
        assert r.n_links in degree[r.doc_id], r


def test_near_copies_leave_one_of_each_class(spark, corpus):
    rows = [r for r in dict(corpus).items() if r[0] is not None]
    out = ngram_join.drop_near_copies(make(spark, rows))
    classes = ngram_join.ngram_join(make(spark, rows))
    assert {r.doc_id for r in out.select("doc_id").collect()} == {r.class_id for r in classes.collect()}


def test_dense_bucket_is_split_and_still_connected(spark):
    base = [f"w{i}" for i in range(120)]
    rows = []
    for k in range(150):
        words = list(base)
        words[(7 * k) % 120] = f"x{k}"
        rows.append((k, " ".join(words)))
    got = ngram_join.ngram_join(make(spark, rows)).collect()
    assert {r.class_id for r in got} == {0}
    assert all(r.n_links == 149 for r in got)


def test_line_dedup_matches_brute_force(spark, corpus):
    rows = [(i, (t or "").replace(" ", "\n", 3) if i is not None and i % 3 == 0 else t) for i, t in dict(corpus).items() if i is not None]
    got = {r.doc_id: r for r in line_dedup.line_dedup(make(spark, rows)).collect()}
    seen, gone = [], defaultdict(set)
    for i, t in sorted(rows):
        for k, line in enumerate((t or "").split("\n")):
            s = frozenset(re.findall(r"[^\x20\x09-\x0D]+", line.translate(TO)))
            if not s:
                continue
            if any(5 * len(s & o) >= 4 * len(s | o) for o in seen):
                gone[i].add(k)
            seen.append(s)
    for i, t in rows:
        want = "\n".join(x for k, x in enumerate((t or "").split("\n")) if k not in gone[i])
        assert got[i].text == want, i
        assert got[i].n_removed == len(gone[i])


def test_line_dedup_around_the_threshold_with_null_ids_and_repeated_rows(spark):
    rng = random.Random(6)
    rows = [(None, "first of all\n\n only words here "), (3, "ONLY words\there"), (4, None), (5, " \n\t")]
    for g in range(4):  # sets of 40 words, many pairs just above 0.8 and many just below
        base = [f"g{g}w{i}" for i in range(40)]
        for k in range(12):
            words = list(base)
            for at in rng.sample(range(40), 2):
                words[at] = f"x{g}_{k}_{at}"
            rows.append((100 * g + 10 + k, f"line {g} {k} of its own\n" + " ".join(words)))
    rows.append((900, "long " + " ".join(f"z{i}" for i in range(20_000))))
    rows.append((901, " ".join(f"z{i}" for i in range(19_000))))
    want, seen = {}, []
    for i, t in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
        kept = []
        for line in (t or "").split("\n"):
            s = frozenset(re.findall(r"[^\x20\x09-\x0D]+", line.translate(TO)))
            if not (s and any(5 * len(s & o) >= 4 * len(s | o) for o in seen)):
                kept.append(line)
            if s:
                seen.append(s)
        want[i] = "\n".join(kept)
    rows.append(rows[4])  # equal in id and text: one document
    got = line_dedup.line_dedup(make(spark, rows)).collect()
    assert len(got) == len(rows)
    wrong = [r.doc_id for r in got if r.text != want[r.doc_id]]
    assert not wrong, wrong


def _join_rows(spark, after=-1):
    """The last execution's id and the most rows that a join has made in executions after the given one."""
    store, most, last = spark._jsparkSession.sharedState().statusStore(), 0, after
    runs = store.executionsList()
    for k in range(runs.size()):
        run = runs.apply(k).executionId()
        last = max(last, run)
        if run <= after:
            continue
        values, pairs = {}, store.executionMetrics(run).iterator()
        while pairs.hasNext():
            pair = pairs.next()
            values[pair._1()] = pair._2()
        nodes = store.planGraph(run).allNodes()
        for node in (nodes.apply(i) for i in range(nodes.size())):
            for m in (node.metrics().apply(i) for i in range(node.metrics().size())):
                if "Join" in node.name() and m.name() == "number of output rows":
                    most = max(most, int(values.get(m.accumulatorId(), "0").replace(",", "")))
    return last, most


def test_line_dedup_does_not_pair_all_lines_of_a_large_group_of_near_copies(spark):
    rng, base = random.Random(17), [f"w{i}" for i in range(60)]
    rows = [(0, " ".join(base))] + [(k, " ".join(_edited(base, 1, rng, f"x{k}"))) for k in range(1, 301)]
    before, _ = _join_rows(spark)
    got = line_dedup.line_dedup(make(spark, rows)).collect()
    assert {r.doc_id for r in got if r.n_removed == 0} == {0}
    _, most = _join_rows(spark, before)
    assert 300 <= most <= 20 * len(rows), most  # pairs: 45,150


def test_line_dedup_settles_near_copies_with_different_numbers_of_own_words(spark):
    rng, base = random.Random(19), [f"w{i}" for i in range(60)]
    rows = [(k, " ".join(_edited(base, rng.randint(0, 5), rng, f"x{k}"))) for k in range(400)]
    want, seen = {}, []
    for i, t in rows:
        s = frozenset(t.split())
        want[i] = any(5 * len(s & o) >= 4 * len(s | o) for o in seen)
        seen.append(s)
    before, _ = _join_rows(spark)
    got = {r.doc_id: r.n_removed == 1 for r in line_dedup.line_dedup(make(spark, rows)).collect()}
    assert got == want
    _, most = _join_rows(spark, before)
    assert 400 <= most <= 20 * len(rows), most


def test_line_dedup_lowers_the_case_of_a_to_z_only(spark):
    kept = ["\u00c9t\u00c9 un", "\u00e9t\u00e9 un", "\u00c3\u00a9t un", "\u0e29 un", "\U000108a9 un", "\u00d7 un", "\u00f7 un", "\u0130 un", "i\u0307 un", "\u212a un", "K un", "\u00df un", "ss un", "\u00a0 un", "un"]
    later = ["UN \u00e9T\u00e9", "\u00c9T\u00c9\tUN", "uN  \u212a", "UN k\x0b", "Un \U000108a9 \U000108a9"]
    rows = [(1, "\n".join(kept)), (2, "\n".join(later))]
    got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.line_dedup(make(spark, rows)).collect()}
    assert got == {1: (rows[0][1], 0), 2: ("", len(later))}


def test_line_dedup_of_lines_on_both_sides_of_a_long_signature(spark):
    rng, rows, seen = random.Random(18), [], []
    for g, n in enumerate((60, 64, 66, 70, 150)):  # words; the signature changes at SHORT
        base = [f"g{g}w{i}" for i in range(n)]
        for k in range(10):
            words = _edited(base, rng.randint(n // 20, n // 10), rng, f"x{g}_{k}")
            rows.append((rng.randrange(10**6), " ".join(words[: n - rng.randint(0, n // 9)])))
    want = {}
    for i, t in sorted(rows):
        s = frozenset(t.split())
        want[i] = any(5 * len(s & o) >= 4 * len(s | o) for o in seen)
        seen.append(s)
    assert 5 < sum(want.values()) < 45
    got = {r.doc_id: r.n_removed == 1 for r in line_dedup.line_dedup(make(spark, rows)).collect()}
    assert got == want


def test_ngram_join_pools_dense_nodes_and_keeps_every_link(spark):
    rng = random.Random(14)
    rows = []
    for g in range(12):  # groups around the threshold: many pairs just above, many just below
        base = [f"g{g}w{i}" for i in range(180)]
        rows += [(100 * g + k, " ".join(_edited(base, 4, rng, f"g{g}x{k}"))) for k in range(25)]
    want = _brute_force(rows)
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.ngram_join(make(spark, rows), leaf=8).collect()}
    wrong = [(i, got[i], want[i]) for i in want if got[i] != want[i]]
    assert not wrong, (len(wrong), len(want), wrong[:5])


def test_sparse_buckets_split_to_the_end_and_meet_the_recall(spark):
    rng, rows = random.Random(15), []
    shared = " ".join(f"s{i}" for i in range(40))  # a passage that all documents hold
    for k in range(150):
        own = [f"p{k}w{i}" for i in range(160)]
        rows += [(2 * k, shared + " " + " ".join(own)), (2 * k + 1, shared + " " + " ".join(_edited(own, 2, rng, f"y{k}")))]
    want = _brute_force(rows)
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.ngram_join(make(spark, rows), leaf=4).collect()}
    assert sum(got[i] == want[i] for i in want) >= ngram_join.RECALL * len(want)


def test_blocks_are_bounded_and_leave_no_pair_out(monkeypatch):
    import pandas as pd

    monkeypatch.setattr(ngram_join, "HALF_SETS", 6)
    monkeypatch.setattr(ngram_join, "HALF_SHINGLES", 1000)
    rng = random.Random(16)
    cut_up, base = ngram_join.Shingler(), [f"w{i}" for i in range(100)]
    sets = [cut_up(" ".join(_edited(base, 2, rng, f"x{k}"))) for k in range(40)]
    group = pd.DataFrame({"path": 1, "digest": [ngram_join.digest(s) for s in sets], "w": [len(s) for s in sets], "mh": [ngram_join.sketch(s).view("int32") for s in sets]})
    out = pd.concat(ngram_join._blocks(iter([group])))
    near = ngram_join.neighbours(__import__("numpy").stack(group["mh"].tolist()), group["w"].to_numpy())
    assert out.groupby("block").size().max() <= 12
    met = {frozenset((a, b)) for _, g in out.groupby("block") for a in g["digest"] for b in g["digest"] if a != b}
    names = group["digest"].tolist()
    assert all(frozenset((names[i], names[j])) in met for i in range(40) for j in range(40) if near[i, j])


def test_overlaps_equal_set_intersections():
    import numpy as np

    rng = np.random.default_rng(2)
    for n in (2, 3, 30):
        sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50))).astype(np.uint64) for _ in range(n)]
        got = ngram_join.overlaps(sets, 64)
        assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(n) for j in range(n) if i != j)


def test_ngram_join_takes_ids_of_text(spark, corpus):
    docs = make(spark, corpus).selectExpr("'d' || doc_id as doc_id", "text")
    got = {r.doc_id: r.class_id for r in ngram_join.ngram_join(docs).collect()}
    assert got["d200"] == min(i for i in got if i and got[i] == got["d200"])


@pytest.mark.parametrize("digest_all", [False, True])
def test_exact_dedup_keeps_different_texts_of_one_id_apart(spark, digest_all):
    rows = [(7, "one text"), (7, "quite another text"), (None, "a third"), (None, "the fourth one"), (8, "Same"), (9, "same"), (9, "same")]
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"), digest_all=digest_all).collect()
    told = sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in got)
    assert told == [(0, 0, 1, True), (0, 0, 1, True), (7, 7, 1, True), (7, 7, 1, True), (8, 9, 3, False), (9, 9, 3, False), (9, 9, 3, True)]
