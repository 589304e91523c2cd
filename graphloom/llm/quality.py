"""Quality classifier: a sparse rule ensemble over text statistics, compiled to Spark columns."""

from __future__ import annotations

from dataclasses import dataclass, field
from math import log

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .util import count_of, has_word, let, materialize, text_or_empty, words_of

FEATURES = ("log_words", "word_len", "symbol_share", "bang_share", "bar_share", "upper_share", "digit_share", "dup_line_share", "distinct_share", "end_share", "line_words", "repeat_share")


def statistics(rows: DataFrame, keep: list[str]) -> DataFrame:
    """rows (keep, t: text without null) with one double for each of FEATURES; all from the text alone."""
    t, w = F.col("t"), F.col("words")
    rows = rows.select(*keep, "t", words_of(t).alias("words"))
    rows = rows.select(
        *keep,
        F.size(w).alias("n"),
        F.length(F.array_join(w, "")).alias("chars"),
        F.size(F.array_distinct(w)).alias("distinct"),
        let(w, lambda x: F.size(F.filter(x, lambda v, i: (i > 0) & (v == F.get(x, F.greatest(i - 1, F.lit(0))))))).alias("repeats"),
        count_of(t, "#*$%&<>~^{}\\[\\]@=+_/\\\\").alias("symbols"),
        count_of(t, "!").alias("bangs"),
        count_of(t, "|").alias("bars"),
        count_of(t, "\\p{Lu}").alias("upper"),
        count_of(t, "0-9").alias("digits"),
        count_of(t, ".?").alias("ends"),
        let(F.filter(F.split(t, "\n"), has_word), lambda x: F.struct(F.size(x).alias("all"), F.size(F.array_distinct(x)).alias("some"))).alias("lines"),
    )
    per_char = lambda c: F.col(c) / F.greatest("chars", F.lit(1))
    per_word = lambda c: c / F.greatest("n", F.lit(1))
    found = {
        "log_words": F.log1p("n"),
        "word_len": per_word(F.col("chars")),
        "symbol_share": per_char("symbols"),
        "bang_share": per_char("bangs"),
        "bar_share": per_char("bars"),
        "upper_share": per_char("upper"),
        "digit_share": per_char("digits"),
        "dup_line_share": 1 - F.col("lines.some") / F.greatest("lines.all", F.lit(1)),
        "distinct_share": per_word(F.col("distinct")),
        "end_share": per_word(F.col("ends")),
        "line_words": F.col("n") / F.greatest("lines.all", F.lit(1)),
        "repeat_share": per_word(F.col("repeats")),
    }
    # a generator: no filter or projection over it is merged into it, so each statistic is computed once a row
    return rows.select(*keep, F.inline(F.array(F.struct(*[F.coalesce(found[k].cast("double"), F.lit(0.0)).alias(k) for k in FEATURES]))))


#: A rule: (feature, above the value or not, value) for each of its conditions.
Rule = tuple[tuple[int, bool, float], ...]


@dataclass
class RuleModel:
    """Intercept and weights of conjunctive rules; score is the logistic of their sum."""

    intercept: float
    rules: list[tuple[Rule, float]] = field(default_factory=list)

    def column(self) -> Column:
        total = F.lit(float(self.intercept))
        for rule, weight in self.rules:
            holds = F.lit(True)
            for f, above, cut in rule:
                c = F.col(FEATURES[f])
                holds = holds & ((c > cut) if above else (c <= cut))
            total = total + F.when(holds, F.lit(float(weight))).otherwise(0.0)
        return 1 / (1 + F.exp(-total))

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for rule, weight in self.rules:
            total += weight * applies(rule, x)
        return 1 / (1 + np.exp(-total))


def applies(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for f, above, cut in rule:
        out &= (x[:, f] > cut) if above else (x[:, f] <= cut)
    return out


def _tree(x: np.ndarray, grad: np.ndarray, cuts: list[np.ndarray], depth: int, least: int, path: Rule, found: list[Rule]) -> np.ndarray:
    """Fit a regression tree to grad; every node's path below the root goes to found. Returns the fit."""
    fit = np.full(len(x), grad.mean() if len(grad) else 0.0)
    if depth == 0 or len(x) < 2 * least:
        return fit
    best = (1e-9, -1, 0.0)
    total, n = grad.sum(), len(x)
    for f, c in enumerate(cuts):
        if not len(c):
            continue
        bins = np.searchsorted(c, x[:, f], side="left")
        s, k = np.bincount(bins, grad, len(c) + 1).cumsum()[:-1], np.bincount(bins, minlength=len(c) + 1).cumsum()[:-1]
        ok = (k >= least) & (n - k >= least)
        gain = np.where(ok, s**2 / np.maximum(k, 1) + (total - s) ** 2 / np.maximum(n - k, 1) - total**2 / n, -1.0)
        if gain.max() > best[0]:
            best = (gain.max(), f, float(c[gain.argmax()]))
    if best[1] < 0:
        return fit
    for above in (False, True):
        at = (x[:, best[1]] > best[2]) == above
        rule = (*path, (best[1], above, best[2]))
        found.append(rule)
        fit[at] = _tree(x[at], grad[at], cuts, depth - 1, least, rule, found)
    return fit


def fit_rules(x: np.ndarray, y: np.ndarray, *, trees: int = 12, depth: int = 3, penalty: float = 0.002, steps: int = 300, seed: int = 1) -> RuleModel:
    """Boosted trees give rules; an l1-penalised logistic fit (accelerated proximal steps) keeps a few of them."""
    if len(y) == 0:
        return RuleModel(0.0)
    rate = (y.sum() + 1) / (len(y) + 2)
    model = RuleModel(log(rate / (1 - rate)))
    if y.min() == y.max():
        return model
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0.02, 0.98, 49))) for f in range(x.shape[1])]
    cuts = [np.unique(np.r_[c, np.quantile(x[y == 0, f], [0.05, 0.25, 0.5, 0.75, 0.95])]) for f, c in enumerate(cuts)]
    total, found = np.full(len(y), model.intercept), []
    for _ in range(trees):
        some = rng.random(len(y)) < 0.7
        p = 1 / (1 + np.exp(-total))
        mine: list[Rule] = []
        _tree(x[some], (y - p)[some], cuts, depth, max(5, len(y) // 400), (), mine)
        for rule in mine:
            at = applies(rule, x)
            if len(rule) == depth or rule == mine[-1]:
                total[at] += 0.8 * np.clip((y - p)[at].mean() / max((p * (1 - p))[at].mean(), 1e-3), -4, 4)
        found += mine
    rules = list(dict.fromkeys(found))
    hold = np.stack([applies(r, x) for r in rules], axis=1).astype(np.float64)
    scale = np.maximum(hold.std(axis=0), 0.05)
    z = (hold - hold.mean(axis=0)) / scale
    w, v, b, vb, t = np.zeros(z.shape[1]), np.zeros(z.shape[1]), model.intercept, model.intercept, 1.0
    step = 4.0 / max(np.linalg.norm(z, 2) ** 2 / len(y), 1.0)
    for _ in range(steps):
        r = 1 / (1 + np.exp(-(z @ v + vb))) - y
        new = v - step * (z.T @ r) / len(y)
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        nb = vb - min(step, 4.0) * r.mean()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / nt * (new - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = new, nb, nt
    weights = w / scale
    kept = [(r, float(g)) for r, g in zip(rules, weights, strict=True) if abs(g) > 1e-6]
    return RuleModel(float(b - (weights * hold.mean(axis=0)).sum()), kept)


def held_out() -> Column:
    """Whether crc32 of the doc_id's digits is a multiple of 5; false for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_train_rows: int = 6000, **options) -> RuleModel:
    """Fit on at most max_train_rows labelled rows that are not held out (the first by a hash of their id).

    Labels without id or quality are left out; of contradicting ones the lower counts.
    """
    some = labels.filter("doc_id is not null and quality is not null").filter(~held_out())
    some = some.groupBy("doc_id").agg(F.min("quality").alias("_quality"))
    some = some.orderBy(F.xxhash64(F.lit(5), "doc_id"), "doc_id").limit(max_train_rows)
    some = materialize(some.select(F.col("doc_id").alias("_id"), "_quality"), "trainids")
    rows = docs.select("doc_id", text_or_empty().alias("t")).join(F.broadcast(some), F.col("doc_id") == F.col("_id"))  # at most max_train_rows ids
    found = statistics(rows, ["doc_id", "_quality"]).orderBy(F.xxhash64(F.lit(5), "doc_id"), "doc_id", *FEATURES).limit(max_train_rows).collect()
    x = np.array([[r[f] for f in FEATURES] for r in found], dtype=np.float64).reshape(len(found), len(FEATURES))
    y = np.array([float(r["_quality"] > 0) for r in found])
    return fit_rules(x, y, **options)


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs.

    Null text is an empty one; both get the score their statistics (all 0) give. Without
    labels every score is 0.5, with labels of one class their smoothed share. Repeated
    rows are scored alike; an empty table gives an empty one; other columns are ignored.
    """
    model = train(docs, labels, **options)
    rows = statistics(docs.select("doc_id", text_or_empty().alias("t")), ["doc_id"])
    out = rows.select("doc_id", held_out().alias("held_out"), model.column().alias("score"))
    return out.select("*", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_low_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """The rows of docs that the classifier does not reject, with all their columns."""
    model = train(docs, labels, **options)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text_or_empty().alias("t"))
    return statistics(rows, ["row"]).filter(model.column() >= threshold).select("row.*")
