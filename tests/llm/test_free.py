import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from graphloom.llm import decontam, lm, pfor, quality, simhash, tokens
from helpers import DOC_SCHEMA, WORD, awkward, docs, plain, plain_losses, prose

import xxhash

public_tokenizers = pytest.importorskip("public_tokenizers")


def plain_fingerprint(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    runs = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    fps = [plain_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 4:
            root[find(i)] = find(j)
    best = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            best[find(i)] = min(best.get(find(i), d), d)
    return Counter((d, f"{fps[i]:016x}", best.get(find(i))) for i, (d, _) in enumerate(rows))


def test_simhash_matches_brute_force(spark):
    rng, rows = random.Random(8), awkward()
    for k in range(30):  # near copies
        w = prose(300 + k % 3, 250).split()
        w[rng.randrange(250)] = f"x{k}"
        rows.append((500 + k, " ".join(w), "s"))
    got = plain(simhash.simhash_components(docs(spark, rows)))
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == brute_components([(d, t) for d, t, _ in rows])
    assert simhash.simhash_components(spark.createDataFrame([], DOC_SCHEMA)).count() == 0


@pytest.mark.parametrize("tile", [1024, 256, 40])
def test_links_in_one_dense_bucket(spark, monkeypatch, tile):
    """More fingerprints about one point than a tile holds: the links must connect what brute force connects."""
    monkeypatch.setattr(simhash, "TILE", tile)
    rng = np.random.default_rng(4)
    base = np.uint64(0x123456789ABCDEF0)
    fps = {int(base)}
    while len(fps) < 900:
        fps.add(int(base) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 8), replace=False)))
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    links = [(r.a, r.b) for r in simhash.fingerprint_links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()]
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 4 for a, b in links)
    parts = []
    arr = np.array(sorted(fps), dtype=np.uint64)
    near = np.bitwise_count(arr[:, None] ^ arr[None, :]) <= 4
    for edges in (zip(*np.nonzero(near), strict=True), [(int(np.searchsorted(arr, np.uint64(a & (2**64 - 1)))), int(np.searchsorted(arr, np.uint64(b & (2**64 - 1))))) for a, b in links]):
        root = list(range(len(arr)))

        def find(x, root=root):
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        for a, b in edges:
            p, q = find(int(a)), find(int(b))
            root[max(p, q)] = min(p, q)
        parts.append([find(i) for i in range(len(arr))])
    assert parts[0] == parts[1]


@pytest.mark.parametrize("n", [2**24 - 1, 2**24, 2**29])
def test_masks_lose_no_pair(n):
    rng = random.Random(n)
    ms = simhash.masks(n)
    for _ in range(300):
        diff = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(diff & m == 0 for m in ms)


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 5000])
def test_token_file_round_trip(n):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, 300, n).astype(np.int64)
    ids[rng.random(n) < 0.05] = 50_000
    if n:
        ids[0] = 2**32 - 1
    cut = np.sort(rng.integers(0, n + 1, 6))
    lengths = np.diff(np.r_[0, cut, n])
    names, valid = np.arange(len(lengths)) - 3, np.arange(len(lengths)) % 3 > 0
    data = pfor.encode(ids, lengths, names, valid)
    got = pfor.read(data)
    assert (got.ids == ids).all() and (got.ends == np.cumsum(lengths)).all() and (got.doc_ids == names).all() and (got.valid == valid).all()
    for _ in range(20):
        a, b = sorted(rng.integers(0, n + 1, 2))
        assert (pfor.read_span(data, a, b) == ids[a:b]).all()
    if n >= 128:
        assert len(data) < 4 * n + 600
        with pytest.raises(ValueError):
            pfor.read(data[:10] + bytes([data[10] ^ 1]) + data[11:])


def test_token_output(spark, monkeypatch):
    from tokenizers import Tokenizer

    rows = awkward() + [(600, "a <|endoftext|> b  c  d \x1c e   f ", "s"), (601, " lead", "s"), (602, "x" * 50_000, "s"), (603, "tab\t \n\n two  spaces it's 12 34!! ünï 你好 \U0001f600", "s")]
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = plain(tokens.tokenize_documents(docs(spark, rows)))
    want = Counter()
    for d, t, _ in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        want[(d, len(ids), zlib.crc32(ids.tobytes()))] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda d: (d is not None, d or 0))
    assert tokens.tokenize_documents(spark.createDataFrame([], DOC_SCHEMA)).count() == 0


def test_word_encoder_with_a_full_cache(monkeypatch):
    monkeypatch.setattr(tokens, "_CACHE", 5)
    enc = tokens.WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    for _ in range(2):
        for t in (prose(1, 80), prose(2, 80), "", "Don't, \"quote\"!! ça-va Ünï... x2 _a_ it's's", "\u00e9t\u00e9\u0301 \u03b1\u03b2 \u4f60\u597d \xad\xa0z ,"):
            assert enc.encode(t).tolist() == enc.tok.encode(t, add_special_tokens=False).ids
    assert len(enc.known[1]) <= 5
    other = tokens.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    assert other.encode("Some  Words here").tolist() == other.tok.encode("Some  Words here", add_special_tokens=False).ids


def labelled(spark):
    rows, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        text = prose(i, 40).upper().replace(" ", "!! ") if bad else prose(i, 40 + i % 30) + ".\n" + prose(i + 9000, 30) + "."
        rows.append((i, text, "s"))
        labels.append((i, 0 if bad else 1, 0))
    labels += [(None, 1, 0), (3, None, 0), (9999, 1, 0), (5, 0, 0)]
    return rows, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_learns_and_handles_all_rows(spark):
    rows, labels = labelled(spark)
    rows = rows + [(700 + i, t, s) for i, (_, t, s) in enumerate(awkward())]
    got = plain(quality.score_quality(docs(spark, rows), labels))
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got if r["doc_id"] is not None)
    test = [r for r in got if r["held_out"] and r["doc_id"] < 600 and r["doc_id"] != 5]
    assert sum(r["predicted"] == (r["doc_id"] % 4 != 0) for r in test) >= 0.97 * len(test)
    kept = quality.drop_low_quality(docs(spark, rows), labels)
    assert kept.columns == docs(spark, rows).columns and Counter(r.doc_id for r in kept.collect()) == Counter(r["doc_id"] for r in got if r["predicted"])
    none = plain(quality.score_quality(docs(spark, rows[:9]), labels.limit(0)))
    assert {r["score"] for r in none} == {0.5}
    assert quality.score_quality(spark.createDataFrame([], DOC_SCHEMA), labels).count() == 0


def test_compiled_rules_equal_the_model(spark):
    rows, labels = labelled(spark)
    d = docs(spark, rows)
    model = quality.train(d, labels)
    assert 1 <= len(model.rules) < 120
    from pyspark.sql import functions as F

    s = quality.statistics(d.select("doc_id", F.col("text").alias("t")), ["doc_id"]).withColumn("score", model.column()).collect()
    x = np.array([[r[f] for f in quality.FEATURES] for r in s])
    assert np.allclose(model.scores(x), [r.score for r in s])


def test_lm_difference_orders_documents_and_matches_plain_losses(spark):
    a = [(i, prose(i % 7, 60), "a") for i in range(60)]
    b = [(100 + i, " ".join(f"zz{(i * 7 + k) % 40}" for k in range(60)), "b") for i in range(60)]
    rows = a + b + [(None if d is None else d + 1000, t, s) for d, t, s in awkward()]
    d, target = docs(spark, rows), spark.createDataFrame([(i,) for i in range(30)] + [(None,), (3,)], "doc_id long")
    got = plain(lm.cross_entropy_difference(d, target))
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert max(by[i]["ce_diff"] for i in range(60)) < min(by[100 + i]["ce_diff"] for i in range(60))
    wants = plain_losses(rows, {*range(30), 3})
    for (i, t, _), (background, wanted) in list(zip(rows, wants, strict=True))[:80]:
        assert by[i]["n_tokens"] == len(WORD.findall(t)) and by[i]["ce_diff"] == pytest.approx(wanted - background, abs=1e-6)
    assert by[1101]["n_tokens"] == 0 and by[1101]["ce_diff"] == 0.0
    assert lm.cross_entropy_difference(spark.createDataFrame([], DOC_SCHEMA), target).count() == 0


def test_wand_equals_exhaustive_scoring():
    rng = random.Random(2)
    items = [(k, [f"w{min(rng.randrange(60), rng.randrange(60))}".encode() for _ in range(rng.randint(8, 15))]) for k in range(80)]
    vocab = {t: n for n, t in enumerate(sorted({t for _, w in items for t in w}))}
    index = decontam.Index(items, vocab)
    for _ in range(300):
        terms = sorted(rng.sample(range(len(vocab)), rng.randint(3, 25)))
        full = Counter()
        for t in terms:
            for k, s in zip(index.postings[t].items, index.postings[t].scores, strict=True):
                full[k] += s
        for threshold in (0.15, 0.4, 0.7):
            want = {k: s for k, s in full.items() if s >= threshold - 1e-9}
            got = dict(index.search(terms, threshold))
            assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_contaminated_finds_planted_items_only(spark):
    items = [(k, prose(5000 + k, 15 + k)) for k in range(30)] + [(90, "what is it ? one two"), (91, None), (None, "null id item text here ok"), (92, "tiny"), (3, prose(5003, 18))]
    rows, want = awkward(), set()
    for k in range(30):
        rows.append((1000 + k, prose(k, 100 * (k % 4)) + "\n" + "".join(c.upper() if c.isascii() else c for c in items[k][1]) + " " + prose(k + 1, 50 * (k % 3)), "s"))
        want.add((1000 + k, k))
    rows.append((1100, "so WHAT is it ? one two three", "s"))
    want.add((1100, 90))
    b = spark.createDataFrame(items, "item_id long, text string")
    got = plain(decontam.contaminated(docs(spark, rows), b))
    assert {(r["doc_id"], r["item_id"]) for r in got} == want
    assert {(r["doc_id"], r["item_id"]) for r in plain(decontam.contaminated(docs(spark, rows), b, bytes_a_part=700))} == want
    kept = decontam.drop_contaminated(docs(spark, rows), b)
    assert Counter(r.doc_id for r in kept.collect()) == Counter(d for d, _, _ in rows if (d or 0) < 1000 or not any(d == x for x, _ in want))
    assert kept.columns == docs(spark, rows).columns
    assert decontam.contaminated(docs(spark, rows), b.limit(0)).count() == 0
    assert decontam.contaminated(spark.createDataFrame([], DOC_SCHEMA), b).count() == 0
