"""Every word and pair counts for itself, beyond any fixed vocabulary."""

from collections import Counter

import pytest
from pyspark.sql import functions as F
from graphloom.llm import lm
from helpers import docs, plain, plain_losses, prose


def test_rare_words_tell_documents_apart(spark, monkeypatch):
    monkeypatch.setattr(lm, "PACK", 9_000)  # several packs a task
    # 40,000 frequent words fill any table of 32,768; the target and the others differ in rarer ones only
    common = [(k, " ".join(f"c{i}" for i in range(k % 40 * 1000, k % 40 * 1000 + 1000)), "s") for k in range(160)]
    rare = [(1000 + k, " ".join(f"{'t' if k % 2 else 'b'}{i}" for i in range(k % 4 // 2 * 20, k % 4 // 2 * 20 + 20)), "s") for k in range(8)]
    rows = common + rare + [(None, prose(1, 20), "s"), (2000, None, "s"), (2001, " ", "s")]
    d, target = docs(spark, rows), spark.createDataFrame([(1001,), (1003,)], "doc_id long")
    got = {r["doc_id"]: r for r in plain(lm.cross_entropy_difference(d, target))}
    assert len(got) == len(rows)
    assert max(got[1005][c] - got[1004][c] for c in ("ce_diff",)) < -1
    check(rows, {1001, 1003}, got)


def check(rows, targets, got):
    for (i, t, _), want in zip(rows, plain_losses(rows, targets), strict=True):
        assert got[i]["n_tokens"] == len((t or "").split())
        assert (got[i]["background_loss"], got[i]["target_loss"]) == pytest.approx(want, abs=1e-9)
        assert got[i]["ce_diff"] == pytest.approx(want[1] - want[0], abs=1e-9)


def test_a_second_copy_shows(spark, monkeypatch):
    """A row's own counts are taken out, so only text that stands elsewhere too is well known to the background."""
    rows = [(k, prose(k, 60), "s") for k in range(40)] + [(100, prose(3, 60), "s")]
    target = {0, 1, 2, 5}
    table = spark.createDataFrame([(k,) for k in [*target, 5, None]], "doc_id long")
    for most in (16_000_000, 0):  # both ways by which places of targets meet the packs
        with_hits = lm._with_hits
        monkeypatch.setattr(lm, "_with_hits", lambda p, t, f=with_hits, m=most: f(p, t, m))
        got = {r["doc_id"]: r for r in plain(lm.cross_entropy_difference(docs(spark, rows), table))}
        monkeypatch.setattr(lm, "_with_hits", with_hits)
        check(rows, target, got)
        assert min(got[3]["ce_diff"], got[100]["ce_diff"]) > max(r["ce_diff"] for k, r in got.items() if k not in (3, 100)) + 0.5


def test_ranges_and_packs_are_dealt_evenly(spark, monkeypatch):
    """A task holds what it reads at once: one range of keys, and of as many packs as tasks one."""
    rows = [(k, prose(k, 100), "s") for k in range(96)]
    monkeypatch.setattr(lm, "RANGE", 850)  # 96 * 101 tokens: 12 ranges
    d, target = docs(spark, rows, partitions=12), spark.createDataFrame([(1,), (7,)], "doc_id long")
    totals, seen = lm._totals, []
    monkeypatch.setattr(lm, "_totals", lambda *a: seen.append(totals(*a)) or seen[-1])
    scored = lm.cross_entropy_difference(d, target)
    got = {r["doc_id"]: r for r in plain(scored)}
    check(rows, {1, 7}, got)
    for t in seen:
        tasks = t.select("part", F.spark_partition_id().alias("task")).distinct().collect()
        assert len(tasks) == 12 == len({r.task for r in tasks}) == len({r.part for r in tasks})
    docs_ = Counter(r.task for r in scored.select(F.spark_partition_id().alias("task")).collect())
    assert sorted(docs_.values()) == [8] * 12
