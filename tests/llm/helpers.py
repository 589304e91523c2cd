"""Small inputs that hold every awkward case, and plain forms of what the operators do."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, host string, shard int"


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(["th", "er", "an", "on", "re", "é", "ß"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def docs(spark, rows=None, partitions=3):
    """rows: (doc_id, text, source); extra columns clash with names the operators use."""
    rows = awkward() if rows is None else rows
    full = [(d, t, "en", s, len(t or ""), -1, -1.0, "h", -1) for d, t, s in rows]
    return spark.createDataFrame(full, DOC_SCHEMA).repartition(partitions)


def awkward():
    long = prose(1, 6000)
    rows = [(i, prose(100 + i, 30 + i), f"s{i % 4}") for i in range(40)]
    rows += [(100, None, "s0"), (101, "", "s1"), (102, " \n\t ", None), (103, long, "s2"), (104, "one", None), (105, "A B c\n\nd", "")]
    rows += [(200 + i, prose(5, 60), "s0") for i in range(9)]  # copies
    rows += [(0, rows[0][1], "s0"), (0, rows[0][1], "s0"), (None, "null id here with some words of its own", "s3"), (None, None, None)]
    return rows


def plain(df):
    return [r.asDict() for r in df.collect()]


def plain_losses(rows, targets):
    """(background, target) mean bits of each row's text by models without that row, from plain dictionaries."""
    from collections import Counter
    from math import log2

    words = [[w.lower() for w in (t or "").encode().split()] for _, t, _ in rows]
    hit = [d in targets for d, _, _ in rows]
    one, two = [Counter(), Counter()], [Counter(), Counter()]
    own = []
    for w, h in zip(words, hit, strict=True):
        c1, c2 = Counter(w), Counter(zip([None, *w], w, strict=False))
        c1[None] = 1 if w else 0
        own.append((c1, c2))
        for k in range(1 + h):
            one[k].update(c1)
            two[k].update(c2)
    size = [sum(c.values()) - c[None] for c in one]
    scale = [size[1] / size[0] if size[0] and size[1] else 1.0, 1.0]
    n_words = len([w for w in one[0] if w is not None])
    out = []
    for w, h, (c1, c2) in zip(words, hit, own, strict=True):
        loss = []
        for k in range(2):
            less = 1 if k == 0 or h else 0
            total = 0.0
            for p, x in zip([None, *w], w, strict=False):
                pair, before, word = ((c[k][i] - less * o[i]) * scale[k] for c, o, i in ((two, c2, (p, x)), (one, c1, p), (one, c1, x)))
                alone = (word + 0.5) / ((size[k] - less * len(w)) * scale[k] + 0.5 * (n_words + 2))
                total -= log2((pair + 8 * alone) / (max(before, pair) + 8))
            loss.append(total / max(1, len(w)))
        out.append(tuple(loss))
    return out
