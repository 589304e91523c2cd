"""The pipeline over one small folder: every stage's decision takes effect, from planted documents to token files."""

import zlib
from collections import Counter

import numpy as np
import pytest

from graphloom.llm import mixing, quality
from helpers import DOC_SCHEMA, WORD, docs, plain, prose

import corpus_pipeline

public_tokenizers = pytest.importorskip("public_tokenizers")


def clean(k):
    return prose(k, 40 + k % 30) + ".\n" + prose(k + 9000, 30) + "."


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Clean texts, junk, exact and near copies, leaks, null and empty rows, repeated rows, columns with clashing names."""
    path = tmp_path_factory.mktemp("pipe")
    rows, labels = [], []
    for i in range(480):
        bad = i % 4 == 0
        rows.append((i, prose(i, 40).upper().replace(" ", "!! ") if bad else clean(i), f"s{i % 3}"))
        labels.append((i, 0 if bad else 1, 0))
    item = prose(77_777, 30)
    rows += [(1000 + k, clean(1), "s1") for k in range(5)]  # copies of 1
    near = clean(2).split(" ")
    near[20] = "changed"
    rows += [(1100, " ".join(near), "s2"), (1200, clean(601) + "\n" + item + "\n" + prose(602, 20), "s0")]
    rows += [(1300, None, "s0"), (1301, "", None), (None, clean(603), "s1"), (None, clean(604), "s1"), (5, clean(605), "s1"), (1, clean(1), "s1"), (1400, clean(606) * 60, None)]
    docs(spark, rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), rows, item


def test_stages_from_documents_to_tokens(spark, folder):
    path, rows, item = folder
    table = spark.read.parquet(f"{path}/documents.parquet")
    at, seen = table, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, path)
        if name != "tokens":
            assert out.columns == table.columns
        out.write.parquet(f"{path}/stage-{name}")
        at = seen[name] = spark.read.parquet(f"{path}/stage-{name}")
    scored = plain(quality.score_quality(table, spark.read.parquet(f"{path}/labels.parquet")))
    assert Counter(r.doc_id for r in seen["quality"].collect()) == Counter(r["doc_id"] for r in scored if r["predicted"])
    kept = {r.doc_id for r in seen["quality"].collect()}
    assert {i for i in range(480) if i % 4} - {5} <= kept | {5} and not kept & {i for i in range(0, 480, 4)}
    texts = Counter(r.text for r in seen["near_dedup"].collect())
    assert set(texts.values()) == {1} and texts[clean(1)] == 1 and texts[clean(603)] == 1 and texts[clean(604)] == 1 and texts[clean(605)] == 1
    ids = {r.doc_id for r in seen["near_dedup"].collect()}
    assert 1 in ids and 2 in ids and not ids & {1000, 1001, 1100}
    left = {r.doc_id for r in seen["decontaminate"].collect()}
    assert ids - left == {1200}
    # the mix: each source's words come near its target, no row more than twice
    before = plain(seen["decontaminate"])
    mixed = Counter(r.text for r in seen["mix"].collect())
    assert set(mixed) <= {r["text"] for r in before} and max(mixed.values()) <= 2
    want = {r["doc_id"]: r["target"] for r in plain(mixing.mix_sources(seen["decontaminate"]))}
    words = lambda t: len(WORD.findall(t or ""))
    for s in ("s0", "s1", "s2", None):
        mine = [r for r in before if r["source"] == s]
        if mine:
            taken = sum(mixed[r["text"]] * words(r["text"]) for r in mine)
            assert abs(taken - want[mine[0]["doc_id"]]) <= max(words(r["text"]) for r in mine)
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    made = Counter()
    for r in seen["mix"].collect():
        ids_ = np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        made[(r.doc_id, len(ids_), zlib.crc32(ids_.tobytes()))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in seen["tokens"].collect()) == made
    assert item not in " ".join(r.text or "" for r in seen["mix"].collect())
    whole = Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in corpus_pipeline.run(spark, path).collect())
    assert whole == made


def test_empty_tables(spark, tmp_path):
    docs_ = spark.createDataFrame([], DOC_SCHEMA)
    docs_.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
