import zlib
from collections import Counter, defaultdict

import pytest

from graphloom.llm import hostrules, linetree, mixing, sharding, urls
from graphloom.llm.components import connected_components
from helpers import DOC_SCHEMA, WORD, awkward, docs, plain, prose


def test_components_match_union_find(spark):
    import random

    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(7, 7), (None, 4)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def base_of(text):
    w = WORD.findall(text or "")
    seen, covered = defaultdict(list), set()
    for i in range(len(w) - 4):
        seen[tuple(w[i : i + 5])].append(i)
    for at in seen.values():
        if len(at) > 1:
            for i in at:
                covered |= set(range(i, i + 5))
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_host_rules_match_plain_form(spark):
    again = "a b c d e f a b c d e f g a b c d e x\nq #1 | $\nq #1 | $\n<*>&%"
    rows = awkward() + [(300, again, "s1"), (301, "w " * 40, "s1"), (302, "a b c d e a b c d e", "s9")]
    rows += [(400 + i, "bad", "junk") for i in range(30)] + [(450, prose(77, 50), "junk")]
    got = plain(hostrules.host_rules(docs(spark, rows)))
    want = Counter()
    for d, t, _ in rows:
        n, c, s, dup, rep = base_of(t)
        want[(d, n, c, s, dup, rep, n < 10 or 100 * rep > 20 * n)] += 1
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got) == want
    assert all(not r["kept"] for r in got if r["base_failed"])
    assert not next(r for r in got if r["doc_id"] == 450)["kept"]  # its host fails
    assert all(r["kept"] for r in got if not r["base_failed"] and r["doc_id"] != 450)
    assert hostrules.host_rules(spark.createDataFrame([], DOC_SCHEMA)).count() == 0


def targets_of(sizes, share=1.5, cap=2.0, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, fixed = share * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        if not free:
            return fixed
        level = (total - sum(fixed.values())) / sum(w[s] for s in free)
        over = [s for s in free if level * w[s] > cap * sizes[s]]
        if not over:
            return fixed | {s: level * w[s] for s in free}
        fixed |= {s: cap * sizes[s] for s in over}


def test_mix_meets_targets(spark):
    rows = awkward() + [(1000 + i, prose(i, 5 + i % 50), f"s{i % 7}" if i % 3 else "big") for i in range(1500)]
    d = docs(spark, rows)
    got = plain(mixing.mix_sources(d))
    assert Counter(r["doc_id"] for r in got) == Counter(x for x, _, _ in rows)
    sizes, source = Counter(), {}
    for i, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
        source[i] = s
    want, taken, largest = targets_of(sizes), Counter(), Counter()
    for r in got:
        if r["doc_id"] is None:
            continue
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s])
        assert r["taken"] in (0, r["size"], 2 * r["size"]) and len(r["shards"]) * r["size"] == r["taken"]
        taken[s] += r["taken"]
        largest[s] = max(largest[s], r["size"])
    for s in sizes:
        if s not in ("s3", None):  # the sources of rows with a null id
            assert abs(taken[s] - want[s]) <= largest[s]
    key = lambda rs: sorted((str(r["doc_id"]), r["size"], r["taken"], r["shards"]) for r in rs)
    assert key(plain(mixing.mix_sources(d.repartition(7)))) == key(got)
    mixed = Counter(r.doc_id for r in mixing.mixed_documents(d).collect())
    assert mixed == Counter(x for r in got for x in [r["doc_id"]] * len(r["shards"]))
    assert mixing.mixed_documents(d).columns == d.columns
    assert mixing.mix_sources(spark.createDataFrame([], DOC_SCHEMA)).count() == 0


def test_mix_counts_every_repeat(spark):
    """A source of equal rows meets its target too: each repeat has a place of its own."""
    rows = [(7, "one two three four", "same")] * 1000 + [(1000 + i, prose(i, 20), f"s{i % 3}") for i in range(300)]
    d = docs(spark, rows)
    got = plain(mixing.mix_sources(d))
    mine = [r for r in got if r["doc_id"] == 7]
    assert len(mine) == 1000 and abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 4
    again = plain(mixing.mix_sources(d.repartition(11)))
    key = lambda rs: Counter((r["doc_id"], r["taken"], tuple(r["shards"])) for r in rs)
    assert key(got) == key(again)
    mixed = mixing.mixed_documents(d).collect()
    assert abs(4 * sum(r.doc_id == 7 for r in mixed) - mine[0]["target"]) <= 4


def test_tree_draws_exact_quotas(spark):
    quotas = [("a", 0, 700), ("b", 0, 41), ("", 1, 3), ("c", 0, 0)]
    seen = Counter()
    for seed in range(3):
        q = spark.createDataFrame(quotas, "sk string, sn int, quota int")
        runs = mixing.split_quotas(q, 7, seed).orderBy("sk", "sn", "first").collect()
        per, at = Counter(), Counter()
        for r in runs:
            assert r.first == at[r.sk]  # the runs of a source follow on each other: disjoint, and nothing left out
            at[r.sk] = r["last"]
            per[r.shard] += r["last"] - r.first
            seen[r.sk, r.shard] += r["last"] - r.first
        assert at == Counter({"a": 700, "b": 41, "": 3})
        assert sorted(per) == list(range(7)) and max(per.values()) - min(per.values()) <= 2  # exact halves of halves
    assert all(70 <= seen["a", s] / 3 <= 130 for s in range(7))


def test_mix_units_spread_over_shards(spark):
    rows = [(i, prose(i, 20), f"s{i % 3}") for i in range(3000)]
    got = plain(mixing.mix_sources(docs(spark, rows), shards=5, block_docs=4, max_blocks=1000))
    n = Counter(s for r in got for s in r["shards"])
    assert sorted(n) == [0, 1, 2, 3, 4] and max(n.values()) < 1.3 * min(n.values())


def test_write_mix(spark, tmp_path):
    d = docs(spark, [(i, prose(i, 20), f"s{i % 3}") for i in range(200)])
    mixing.write_mix(d, f"file://{tmp_path}/mix", shards=4)
    back = spark.read.parquet(f"file://{tmp_path}/mix")
    assert Counter(r.doc_id for r in back.collect()) == Counter(r.doc_id for r in mixing.mixed_documents(d, shards=4).collect())


def test_shards_are_exact(spark):
    rows = awkward() + [(1000 + i, f"t{i % 5}", "s") for i in range(3000)]
    got = plain(sharding.shuffle_into_shards(docs(spark, rows), rows_per_part=100))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, _ in rows)
    per = defaultdict(list)
    for r in got:
        per[r["shard"]].append(r["slot"])
        assert r["law"] == "rows" and r["grown_shard"] is None
    assert sorted(per) == list(range(24)) and max(map(len, per.values())) - min(map(len, per.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in per.values())
    few = plain(sharding.shuffle_into_shards(docs(spark, rows[:3])))
    assert len(few) == 3 and all(r["slot"] == 0 for r in few)
    assert sharding.shuffle_into_shards(spark.createDataFrame([], DOC_SCHEMA)).count() == 0


def test_shards_do_not_depend_on_partitions(spark):
    rows = awkward() + [(7, "same text here", "s")] * 400 + [(1000 + i, f"t{i}", "s") for i in range(500)]
    a, b = (Counter((r["doc_id"], r["text_crc32"], r["shard"], r["slot"]) for r in plain(sharding.shuffle_into_shards(docs(spark, rows, p), rows_per_part=50))) for p in (2, 9))
    assert a == b


def test_communication_matrix_margins():
    rows = [17, 0, 5, 2_000_000_000, 400]
    m = sharding.communication_matrix(rows, 7, 1)
    assert [sum(x) for x in m] == rows
    cols = [sum(x[j] for x in m) for j in range(7)]
    assert max(cols) - min(cols) <= 1 and min(min(x) for x in m) >= 0


def test_hypergeometric_law_beyond_the_library():
    """By inversion: exact probabilities where few good ones make the law countable, and mean and spread where it is wide."""
    import numpy as np
    from math import comb

    rng = np.random.default_rng(5)
    good, bad, draws = 3, 2 * 10**9, 10**9
    got = Counter(sharding.hypergeometric(rng, good, bad, draws) for _ in range(4000))
    p = draws / (good + bad)
    for k in range(4):  # so wide a population leaves the binomial law
        want = comb(3, k) * p**k * (1 - p) ** (3 - k)
        assert abs(got[k] / 4000 - want) < 4 * (want * (1 - want) / 4000) ** 0.5
    good, bad, draws = 6 * 10**8, 14 * 10**8, 10**6
    x = np.array([sharding.hypergeometric(rng, good, bad, draws) for _ in range(400)])
    sd = (draws * 0.3 * 0.7) ** 0.5
    assert abs(x.mean() - 300_000) < 5 * sd / 20 and 0.85 < x.std() / sd < 1.15


def test_write_shards(spark, tmp_path):
    d = docs(spark, [(i % 50, prose(i % 50, 20), "s") for i in range(100)])  # repeated ids; a column named shard
    sharding.write_shards(d, f"file://{tmp_path}/s", shards=3)
    back = spark.read.parquet(f"file://{tmp_path}/s")
    assert sorted(r["count"] for r in back.groupBy("_shard").count().collect()) == [33, 33, 34]
    assert set(back.columns) == {*d.columns, "_shard"} and Counter(r.text for r in back.collect()) == Counter(r.text for r in d.collect())


def judge(url, rules=urls.DEFAULT_RULES):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if c.isascii() else c for c in rest[:end])
    path = rest[end:].split("?")[0].split("#")[0]
    best = max([r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])], key=lambda r: (len(r[1] + r[2]), r[0] == "allow"), default=None)
    return host, path, best and best[1] + best[2], best and best[0]


def test_urls_rules_and_aliases(spark):
    link = lambda u: f"<html><LINK href='{u}' rel=\"canonical\"></html>"
    move = lambda u: f'<meta http-equiv="Refresh" content="0; URL={u}">'
    pages = [
        (1, "https://www.Example.ORG/es/1", ""),
        (2, "https://a.net/x#f", link("https://www.example.org/es/1")),  # alias of a blocked url
        (3, "http://b.net/y?q=1", move("//a.net/x")),  # joined by a redirect to http://a.net/x: another scheme
        (4, "https://b.net/z/", move("../z/w")),
        (5, "https://c.net/k", link("/x2?a=1&amp;b=2")),
        (6, "https://c.net/x2?a=1&b=2", link("https://shop.com/de/1")),
        (7, "https://d.net/k", link("https://shop.com/de/2")),
        (8, "https://d.net/l", link("/k") + move("https://x.com/fr/1")),  # an allow and a block: allow
        (9, "https://shop.com/de/2", None),
        (10, None, link("https://shop.com/de/2")),
        (11, "no scheme", "<link rel=canonical>"),
        (12, "https://x.org?q", ""),
        (13, "ftp://Ä.com/en/1#/de/", ""),
        (14, "https://com/de/", ""),
        (15, "https://example.org/en/12", ""),
        (2, "https://a.net/x#f", link("https://www.example.org/es/1")),
    ]
    df = spark.createDataFrame([(a, b, c, "z", 1) for a, b, c in pages], "page_id long, url string, html string, rule string, node int")
    got = plain(urls.judge_urls(df))
    assert len(got) == len(pages)
    by = {r["page_id"]: r for r in got}
    for i, u, _ in pages:
        host, path, rule, verdict = judge(u)
        assert (by[i]["host"], by[i]["path"], by[i]["rule"]) == (host, path, rule)
        if verdict:
            assert by[i]["verdict"] == verdict
    free = {i: by[i]["verdict"] for i in (2, 3, 4, 5, 6, 7, 8, 10, 11, 12, 13)}
    assert free == {2: "block", 3: "allow", 4: "allow", 5: "block", 6: "block", 7: "allow", 8: "allow", 10: "allow", 11: "allow", 12: "allow", 13: "allow"}
    more = spark.createDataFrame([("https://b.net/z/", "https://a.net/x")], "from_url string, to_url string")
    assert {r["page_id"]: r["verdict"] for r in plain(urls.judge_urls(df, redirects=more))}[4] == "block"
    assert urls.judge_urls(df.limit(0)).count() == 0


def test_alias_verdicts_equal_union_find(spark):
    """Random links among pages: each page's verdict is its own rule's, else its component's, an allow before a block."""
    import random

    rng = random.Random(6)
    site = lambda k: ["https://a.net/p", "https://x.com/fr/p", "https://x.com/de/p", "https://e.example.org/es/p"][0 if k % 7 else 1 + k % 3] + str(k)
    pages, links = [], []
    for k in range(160):
        html = ""
        if rng.random() < 0.55:
            to = rng.randrange(200)  # some lead to urls that are no pages
            links.append((site(k), site(to)))
            html = f'<link rel="canonical" href="{site(to)}">'
        pages.append((k, site(k), html))
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    said = defaultdict(set)
    for u in {u for pair in links for u in pair}:
        said[find(u)].add(judge(u)[3])
    want = {}
    for k, u, _ in pages:
        group = said.get(find(u), set())
        want[k] = judge(u)[3] or ("allow" if "allow" in group else "block" if "block" in group else "allow")
    df = spark.createDataFrame([*pages, (900, None, None), (901, None, None)], "page_id long, url string, html string")
    got = {r["page_id"]: r["verdict"] for r in plain(urls.judge_urls(df))}
    assert got == want | {900: "allow", 901: "allow"} and len(set(want.values())) == 2


def test_lines_recurring_templates_go(spark):
    passage = prose(9, 60)
    rows = []
    for i in range(12):
        rows.append((i, "\n".join([prose(50 + i, 25), f"Posted on 2024-01-{i + 10} by user{i} at site", passage if i < 4 else prose(80 + i, 61), "", prose(90 + i, 12)]), "s"))
    copies = [(100 + i, prose(200, 30) + "\n" + prose(201, 30), "s") for i in range(20)]
    rest = [(200, None, "s"), (201, "", "s"), (202, " \n ", None), (None, passage, "s"), (300, prose(7, 9000), "s")]
    got = {r["doc_id"]: r for r in plain(linetree.dedup_lines(docs(spark, rows + copies + rest)))}
    for i, t, _ in rows:
        lines = t.split("\n")
        want = [lines[0], *([] if i < 4 else [lines[2]]), *lines[3:]]
        assert got[i]["text"] == "\n".join(want) and got[i]["n_dropped"] == 5 - len(want) and got[i]["n_lines"] == 5
    assert all(got[i]["text"] == t and got[i]["n_dropped"] == 0 for i, t, _ in copies)
    assert got[200]["text"] is None and got[200]["n_lines"] == 0 and got[201]["text"] == "" and got[202]["text"] == " \n "
    assert got[None]["text"] == "" and got[300]["n_dropped"] == 0
    assert linetree.dedup_lines(spark.createDataFrame([], DOC_SCHEMA)).count() == 0


def brute_lines(rows, min_docs=3, min_docs_long=2, long_words=50, like=0.8, depth=4):
    """Lines that stand in enough different texts, alone or with lines of their leaf that are alike in most places."""
    at = defaultdict(set)
    for _, t, _ in rows:
        for x in (t or "").split("\n"):
            if WORD.search(x):
                at[x].add(t)
    out = {x for x, ts in at.items() if len(ts) >= (min_docs_long if len(x.split()) >= long_words else min_docs)}
    mask = lambda w: "<*>" if any(c.isdigit() for c in w) or "@" in w else w
    toks = {x: [mask(w) for w in x.split()] for x in at}
    for x, a in toks.items():
        if 2 * sum(w != "<*>" for w in a) < len(a):
            continue
        near = [y for y, b in toks.items() if len(a) == len(b) and a[:depth] == b[:depth] and sum(p == q for p, q in zip(a, b, strict=True)) >= like * len(a)]
        if len(near) > 1 and len(set().union(*(at[y] for y in near))) >= min_docs:
            out.add(x)
    return out


def check_lines(spark, rows):
    drop = brute_lines(rows)
    got = Counter((r["doc_id"], r["text"]) for r in plain(linetree.dedup_lines(docs(spark, rows))))
    assert got == Counter((d, t if t is None else "\n".join(x for x in t.split("\n") if x not in drop)) for d, t, _ in rows)
    return drop


def test_several_templates_of_one_leaf(spark):
    """Templates that share length and leading tokens don't wipe each other out, nor do ordinary lines that begin alike."""
    head = "see also the page"
    a = [f"{head} about the town of {prose(i, 1)} and its many old stone bridges" for i in range(10)]
    b = [f"{head} where people tell {prose(50 + i, 1)} how they came to live there" for i in range(10)]
    plain_ = [f"{head} {prose(900 + i, 10)}" for i in range(40)]
    rows = [(i, f"{prose(2000 + i, 30)}\n{x}", "s") for i, x in enumerate(a + b + plain_)]
    assert check_lines(spark, rows) == {*a, *b}


def test_long_passages_count_from_two_texts(spark):
    long, short = prose(77, 52), prose(78, 20)
    rows = [(k, f"{prose(3000 + k, 15)}\n{long}\n{short}", "s") for k in range(2)] + [(5, prose(9, 60), "s"), (6, prose(9, 60), "s")]
    assert check_lines(spark, rows) == {long}
