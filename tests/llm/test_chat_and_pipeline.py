from __future__ import annotations

from lumenspark.llm import chat_format


def test_shared_turns_become_the_prompt(spark):
    rows = [
        (1, 0, 0, "system", "s"), (1, 0, 1, "user", "hi"), (1, 0, 2, "assistant", "good"), (1, 1, 0, "system", "s"), (1, 1, 1, "user", "hi"), (1, 1, 2, "assistant", "bad"), (1, 1, 3, "user", "why"),
        (2, 0, 0, "user", "only"), (3, 0, 0, "user", "same"), (3, 1, 0, "user", "same"), (4, 0, 0, None, None), (4, 1, 0, "unknown", ""), (None, 0, 0, "user", "lost"), (5, 7, 0, "user", "lost"), (6, 0, 0, "user", "a"), (6, 0, 0, "user", "a"), (6, 1, 0, "user", "a"),
    ]
    turns = spark.createDataFrame([(*r, "x", 1) for r in rows], "pair_id long, side int, turn long, role string, text string, prompt string, n int")
    got = {r.pair_id: r for r in chat_format.format_preferences(turns).collect()}
    assert set(got) == {1, 2, 3, 4, 6}
    a = got[1]
    assert a.n_prompt_turns == 2 and a.prompt == "<|system|>\ns<|end|>\n<|user|>\nhi<|end|>\n"
    assert a.chosen == "<|assistant|>\ngood<|end|>\n" and a.rejected == "<|assistant|>\nbad<|end|>\n<|user|>\nwhy<|end|>\n"
    (m,) = a.chosen_mask
    assert a.chosen[m.start : m.end] == "good<|end|>" and len(a.rejected_mask) == 1
    assert got[2].prompt == "" and got[2].rejected == "" and got[2].chosen
    assert got[3].chosen == "" == got[3].rejected and got[3].n_prompt_turns == 1
    assert got[4].n_prompt_turns == 1
    assert got[6].n_prompt_turns == 1 and got[6].chosen == "<|user|>\na<|end|>\n"
    assert chat_format.format_preferences(turns.where("false")).count() == 0


def test_pipeline_runs_over_the_smallest_tables(spark):
    import corpus_pipeline as p
    from lumenspark.llm.common import cut, read

    sf = "/root/testdata/sf0.001"
    docs = read(spark, sf, "documents")
    before, columns = docs.count(), docs.columns
    for name, stage in p.STAGES[:-1]:
        docs = cut(stage(spark, docs, sf), name)
        assert docs.columns == columns
        assert 0 < docs.count() <= before
        before = docs.count()
    packed = p.STAGES[-1][1](spark, docs, sf)
    assert packed.where("piece = 0").count() == before


def test_stages_take_an_empty_table(spark):
    import corpus_pipeline as p
    from lumenspark.llm.common import read

    sf = "/root/testdata/sf0.001"
    empty = read(spark, sf, "documents").where("false")
    for _, stage in p.STAGES[1:]:
        assert stage(spark, empty, sf).count() == 0


def test_cuts_leave_no_shuffles_and_settled_tables_no_cuts(spark):
    import time
    from pathlib import Path

    from pyspark.sql import functions as F

    from lumenspark.llm import common

    dirs = [Path(d.getPath()) for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    shuffles = lambda: {f for d in dirs for f in d.rglob("shuffle_*")}
    shared = Path(common.shared_dir(spark))
    grouped = spark.range(5000).groupBy((F.col("id") % 700).alias("k")).agg(F.count("*").alias("n"))
    shuffles_before, cuts_before = shuffles(), set(shared.iterdir())

    inner = lambda: common.cut(grouped, "inner").where("k < 600")
    out = common.settled(lambda: common.settled(inner, "middle").groupBy("n").agg(F.count("*").alias("ks")), "outer")
    assert sum(r.n * r.ks for r in out.collect()) == sum(5000 // 700 + (k < 5000 % 700) for k in range(600))
    (left,) = set(shared.iterdir()) - cuts_before
    assert left.name.startswith("outer-")
    for _ in range(50):  # deleted in the background
        if not shuffles() - shuffles_before:
            break
        time.sleep(0.1)
    assert not shuffles() - shuffles_before
    assert spark.conf.get(common.SHUFFLE_CLEANUP) == "false"


def test_redaction_writes_the_text_once(spark, monkeypatch):
    import corpus_pipeline as p
    from lumenspark.llm import pii

    written = []
    plain = pii.cut
    monkeypatch.setattr(pii, "cut", lambda df, name: written.append(df.schema.simpleString()) or plain(df, name))
    docs = spark.createDataFrame([(1, "mail a.b@c.de now", "en", "s", 17), (2, None, "en", "s", None), (3, "none", "en", "s", 4)], "doc_id long, text string, lang string, source string, n_chars int")
    out = p.redact_personal_data(spark, docs, "")
    assert out.schema.simpleString() == docs.schema.simpleString()
    assert {tuple(r) for r in out.collect()} == {(1, "mail [EMAIL] now", "en", "s", 16), (2, None, "en", "s", None), (3, "none", "en", "s", 4)}
    assert [w.replace("context:", "").count("text:") for w in written] == [1]
