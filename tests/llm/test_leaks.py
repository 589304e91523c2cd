"""Leaks that one glued or changed word, an item_id on two texts or a null one must not hide."""

import random

from graphloom.llm import decontam
from helpers import docs, plain, prose


def found(spark, rows, items):
    b = spark.createDataFrame(items, "item_id long, text string")
    return {(r["doc_id"], r["item_id"]) for r in plain(decontam.contaminated(docs(spark, rows), b))}


def test_whole_item_with_a_changed_end(spark):
    item = prose(1, 40).split()
    asks = [*prose(2, 30).split(), "so?", *prose(3, 4).split()]
    items = [(1, " ".join(item)), (2, " ".join(asks))]
    pre, post = prose(4, 80), prose(5, 80)
    rows = [
        (10, f"{pre} {' '.join(item[:-2])} {item[-2]}.%%% {item[-1]}%%% {post}", "s"),
        (11, f"{pre} {' '.join(item[:-2])} changed {item[-1]} {post}", "s"),
        (12, f"{pre} ({' '.join(asks)}!) {post}", "s"),
        (13, f"{pre} {' '.join(asks[:31])} {post}", "s"),  # the question alone
        (14, f"{pre} {' '.join(item[:25])} {post}", "s"),
    ]
    assert found(spark, rows, items) == {(10, 1), (11, 1), (12, 2)}


def test_an_id_on_two_texts_and_a_null_id(spark):
    a, b, c = (prose(20 + k, 30) for k in range(3))
    rows = [(20 + k, f"{prose(30 + k, 60)} {t} {prose(40 + k, 60)}", "s") for k, t in enumerate((a, b, c))] + [(30, prose(50, 90), "s")]
    items = [(1, a), (1, b), (None, c)]
    for size in (4_000_000, 200):
        d, bench = docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")
        assert sorted((r.doc_id, r.item_id) for r in decontam.contaminated(d, bench, bytes_a_part=size).collect()) == [(20, 1), (21, 1)]
        assert [r.doc_id for r in decontam.drop_contaminated(d, bench, bytes_a_part=size).collect()] == [30]


def held(text, item, overlap=0.8):
    """Whether a text holds an item, by the definition, over every pair of text and item."""
    words, parts = decontam.words_of(text), decontam.question_and_answer(item)
    mine = {tuple(words[i : i + n]) for n in range(1, 6) for i in range(len(words) - n + 1)}
    runs = lambda w: [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))]
    share = lambda w: sum(x in mine for x in set(runs(w))) / len(set(runs(w)))
    whole = decontam.words_of(item)
    q = parts[0] if len(parts[0]) >= 5 else whole
    a = parts[1] if len(parts[1]) >= 5 else whole[-max(5, len(parts[1])) :]
    asks = "?" in item and bool(parts[1])
    answered = not asks or (share(a) > 0 and (1 - share(a)) * len(set(runs(a))) <= 5)
    return min(share(q), share(a)) >= overlap or (answered and share(whole) >= overlap)


def test_verdicts_equal_every_pair(spark):
    """Whole, cut, mixed and edited items in texts: what the index finds is what comparing every text with every item finds."""
    rng = random.Random(12)
    items = [(k, prose(900 + k, rng.randint(12, 45)) + (" so? " + prose(950 + k, rng.randint(2, 12)) if k % 4 == 0 else "")) for k in range(24)]
    rows = []
    for k in range(90):
        w = items[rng.randrange(24)][1].split()
        for _ in range(rng.choice((0, 0, 1, 2, 4))):
            w[rng.randrange(len(w))] = f"other{k}"
        keep = rng.choice((1.0, 1.0, 0.9, 0.75, 0.5))
        w = w[: max(4, int(len(w) * keep))]
        rows.append((k, f"{prose(2000 + k, rng.randint(0, 150))} {' '.join(w)} {prose(3000 + k, rng.randint(0, 150))}", "s"))
    want = {(d, i) for d, t, _ in rows for i, x in items if held(t, x)}
    got = found(spark, rows, items)
    assert 20 < len(want) < 90 and got <= want
    assert want - got == set()
