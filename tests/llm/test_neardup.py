"""Near-dedup by text similarity, against brute force."""

import random

from graphloom.llm import neardup, simhash
from helpers import DOC_SCHEMA, awkward, docs, prose

import corpus_pipeline


def grams(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """Texts kept in order of least id (nulls last), each unlike all kept before."""
    best = {}
    for d, t, _ in rows:
        key = (d is None, d or 0)
        best[t or ""] = min(best.get(t or "", key), key)
    kept = []
    for t in sorted(best, key=lambda t: best[t]):
        g = grams(t)
        if not any(len(g & k) >= 0.8 * len(g | k) for _, k in kept):
            kept.append((t, g))
    return sorted(t for t, _ in kept)


def test_edited_copies_go_by_similarity(spark):
    rng, rows = random.Random(3), awkward()
    for k in range(40):  # one to nine changed words of 200: similarity 0.95 to 0.64
        w = prose(700 + k % 8, 200).split()
        for i in rng.sample(range(200), 1 + k // 8 * 2):
            w[i] = f"x{k}y{i}"
        rows.append((700 + k, " ".join(w), "s"))
    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    got = stage(spark, docs(spark, rows), "")
    assert got.columns == docs(spark, rows).columns
    assert sorted(r.text or "" for r in got.collect()) == brute(rows)
    far = [(simhash.fingerprint(a) ^ simhash.fingerprint(b)).bit_count() for (_, a, _), (_, b, _) in zip(rows[-40:-32], rows[-32:-24], strict=True)]
    assert max(far) > 4
    assert stage(spark, spark.createDataFrame([], DOC_SCHEMA), "").count() == 0


def test_large_groups_go_in_rounds(spark, monkeypatch):
    """A group beyond one task's size gives what the greedy order gives: leaders first, the others dealt to several tasks."""
    monkeypatch.setattr(neardup, "GROUP_ROWS", 10)
    monkeypatch.setattr(neardup, "LEADERS", 4)
    rng, rows = random.Random(7), awkward()
    base = prose(50, 100).split()
    for k in range(90):  # around one text: some alike, some chained to it by bands but unlike
        w = list(base)
        for i in rng.sample(range(100), rng.choice((0, 1, 2, 4, 6, 9))):
            w[i] = f"y{k}z{i}"
        rows.append((2000 + (k * 37) % 90, " ".join(w), "s"))
    got = neardup.near_dedup(docs(spark, rows))
    assert sorted(r.text or "" for r in got.collect()) == brute(rows)


def test_bands_miss_no_similar_pair():
    rng = random.Random(5)
    for k in range(200):
        w = prose(k, 120).split()
        v = list(w)
        for i in rng.sample(range(0, 120, 5), 2):
            v[i] = "other"
        a, b = (neardup.shingle_set(" ".join(x)) for x in (w, v))
        assert neardup.similar(a, b) == (len(grams(" ".join(w)) & grams(" ".join(v))) >= 0.8 * len(grams(" ".join(w)) | grams(" ".join(v))))
        assert not neardup.similar(a, b) or (neardup.band_keys(a) == neardup.band_keys(b)).any()


def test_null_and_equal_ids_lose_no_text(spark):
    texts = [prose(8000 + k, 60) for k in range(8)]
    rows = [(None, texts[k], "s") for k in range(4)] + [(1, texts[4], "s"), (1, texts[5], "s"), (2, texts[6], "s"), (None, texts[6], "s"), (None, texts[7], "s"), (None, texts[7], "t")]
    got = [(r.doc_id, r.text) for r in neardup.near_dedup(docs(spark, rows)).collect()]
    assert sorted(t for _, t in got) == sorted(texts) and (2, texts[6]) in got


def test_fingerprint_links_bring_candidates(spark):
    """Similar texts that share no band, 4 fingerprint bits apart or fewer, go too; linked texts that are unlike stay."""
    rows = []
    for k in (165143, 180339):
        w = prose(k, 13).split()
        a, b = " ".join(w), " ".join(["x", *w[1:]])
        x, y = (neardup.shingle_set(t) for t in (a, b))
        assert neardup.similar(x, y) and not (neardup.band_keys(x) == neardup.band_keys(y)).any()
        assert (simhash.fingerprint(a) ^ simhash.fingerprint(b)).bit_count() <= 4
        rows += [(k, a, "s"), (k + 1, b, "s")]
    w = prose(9100, 23).split()  # repeats outweigh the ends in the fingerprint, but not among different runs
    u, v, x, y = w[:5], w[5:11], w[11:17], w[17:]
    rows += [(1, " ".join(u * 30 + v * 30 + x), "s"), (2, " ".join(u * 30 + v * 30 + y), "s")]
    got = neardup.near_dedup(docs(spark, rows)).collect()
    assert sorted(r.text for r in got) == brute(rows)
    assert {165143, 180339} <= {r.doc_id for r in got} and not {165144, 180340} & {r.doc_id for r in got}
    fps = [simhash.fingerprint(t) for _, t, _ in rows[-2:]]
    assert (fps[0] ^ fps[1]).bit_count() <= 4 and {1, 2} <= {r.doc_id for r in got}


def test_links_of_texts_match_brute_force(spark):
    """Texts of one fingerprint and of linked ones are connected just as fingerprints at most 4 bits apart connect them."""
    signed = [5, 5, 5, 5 ^ 15, 5 ^ 15 ^ 240, 5 ^ (31 << 20), -1, -1 ^ 7, 1023 << 40]
    rows = [(100 - k, k, fp) for k, fp in enumerate(signed)] * 2
    got = neardup.simhash_links(spark.createDataFrame(rows, "th long, doc_id long, fp long")).collect()
    assert all(r.th > r.least for r in got)
    groups = {t: {t} for t, _, _ in rows}
    for r in got:
        one = groups[r.th] | groups[r.least]
        groups |= dict.fromkeys(one, one)
    assert {frozenset(g) for g in groups.values()} == {frozenset(range(96, 101)), frozenset([95]), frozenset([93, 94]), frozenset([92])}
