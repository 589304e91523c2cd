"""Line dedup by a fixed-depth template tree: recurring templates across documents are dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .util import has_word, let, materialize, text_or_empty, words_of

#: Tokens with a digit, urls and e-mail addresses are variable fields.
VARIABLE = r"[0-9]|://|^www\.|@"
WILD = "<*>"
#: A line is compared by up to PLACES hashes of runs of its tokens; lines that agree in LIKE of them agree in one of KEYS parts of them.
PLACES, KEYS = 16, 4


def masked(words: Column) -> Column:
    return F.transform(words, lambda w: F.when(w.rlike(VARIABLE), F.lit(WILD)).otherwise(w))


def _pieces(a: Column, n: Column, parts: int) -> Column:
    """Hashes of runs of a (of n values), as many as `parts` at most: each value's own if there are no more."""
    each = F.transform(a, lambda x: F.hash(x))
    runs = let(F.ceil(n / parts).cast("int"), lambda s: F.transform(F.sequence(F.lit(0), F.ceil(n / s).cast("int") - 1), lambda k: F.hash(F.slice(a, k * s + 1, s))))
    return F.when(n <= parts, each).otherwise(runs)


def line_table(docs: DataFrame, depth: int, long_words: int) -> DataFrame:
    """text_hash, leaf, line_hash, long, places: each line of a row once, those without a word left out.

    leaf is the path in the tree: token count, then the leading tokens, variable fields masked. places: hashes of runs of
    the masked tokens; null for a line of which most tokens are variable: it has no template.
    """

    def parsed(words: Column, line: Column, fields: Column) -> Column:
        n = F.size(words)
        leaf = F.xxhash64(n, F.array_join(F.slice(words, 1, depth), "\x01"))
        real = ~fields | (2 * F.size(F.filter(words, lambda w: w != WILD)) >= n)
        return F.struct(leaf.alias("leaf"), F.xxhash64(line).alias("line_hash"), (n >= long_words).alias("long"), F.when(real, _pieces(words, n, PLACES)).alias("places"))

    def line(x: Column) -> Column:
        fields = x.rlike(r"[0-9@]|://|www\.")
        words = F.when(fields, masked(words_of(x))).otherwise(words_of(x))
        return let(words, lambda w: parsed(w, x, fields))

    lines = F.array_distinct(F.filter(F.split(text_or_empty(), "\n"), has_word))
    return docs.select(F.xxhash64(text_or_empty()).alias("text_hash"), F.inline(F.transform(lines, line)))


def _template_lines(lines: DataFrame, min_docs: int, share: float, like: float) -> DataFrame:
    """(group, line_hash): lines that fit the template of a group of similar lines of their leaf.

    lines: leaf, line_hash, places, texts. A leaf may hold many templates. A line is in a group for each of the KEYS parts of
    its places, with the lines of its leaf that agree in that part. A place of a group's template holds the value that
    `share` of its lines (by texts) have, else any value fits; the template counts if `like` of its places hold a
    value, and a line belongs to it if `like` of its places fit. Groups of one line, or of less than min_docs texts, are left out first.
    """
    part = lambda k: F.slice("places", F.floor(k * F.size("places") / KEYS).cast("int") + 1, (F.floor((k + 1) * F.size("places") / KEYS) - F.floor(k * F.size("places") / KEYS)).cast("int"))
    keys = F.filter(F.transform(F.sequence(F.lit(0), F.lit(KEYS - 1)), lambda k: F.when(F.size(part(k)) > 0, F.xxhash64("leaf", k, part(k)))), lambda x: x.isNotNull())
    member = lines.filter("places is not null").select("line_hash", "places", "texts", F.explode(keys).alias("group"))
    groups = member.groupBy("group").agg(F.sum("texts").alias("all"), F.count("*").alias("lines")).filter(f"lines > 1 and `all` >= {min_docs}")
    groups = materialize(groups.drop("lines"), "linegroups")
    member = materialize(member.join(groups, "group"), "linemembers")
    values = member.select("group", "texts", "all", F.posexplode("places").alias("pos", "value"))
    counts = values.groupBy("group", "pos", "value").agg(F.sum("texts").alias("c"), F.max("all").alias("all"))
    best = counts.groupBy("group", "pos").agg(F.max(F.struct("c", "value")).alias("top"), F.max("all").alias("all"))
    best = best.select("group", F.struct("pos", F.when(F.col("top.c") >= F.col("all") * share, F.col("top.value")).alias("value")).alias("place"))
    templates = best.groupBy("group").agg(F.transform(F.array_sort(F.collect_list("place")), lambda x: x["value"]).alias("template"))  # PLACES values a group
    firm = F.size(F.filter("template", lambda x: x.isNotNull())) >= F.size("template") * like
    templates = materialize(templates.filter(firm), "templates")
    fits = F.size(F.filter(F.zip_with("places", "template", lambda a, b: b.isNull() | (a == b)), lambda x: x))
    return member.join(templates, "group").filter(fits >= F.size("places") * like).select("group", "line_hash")


def recurring_lines(pairs: DataFrame, min_docs: int, min_docs_long: int, share: float, like: float) -> DataFrame:
    """line_hash of every line that stands in min_docs different texts (a long one in min_docs_long), or whose template does.

    pairs: line_table with each line of a text once. Leaves in too few texts are dropped first, by counts that are combined before the shuffle.
    """
    counts = materialize(pairs.groupBy("leaf", "line_hash", "long", "places").agg(F.count("*").alias("texts")), "linecounts")
    least = F.when(F.col("long"), min_docs_long).otherwise(min_docs)
    own = counts.filter(F.col("texts") >= least).select("line_hash")
    leaves = counts.groupBy("leaf").agg(F.sum("texts").alias("leaf_texts"), F.count("*").alias("lines")).filter(f"leaf_texts >= {min_docs} and lines > 1")
    busy = counts.join(materialize(leaves.select("leaf"), "leaves"), "leaf", "left_semi")
    mine = materialize(_template_lines(busy, min_docs, share, like), "fits")
    # the texts of a template are counted as different texts, over all of its lines
    spread = pairs.select("text_hash", "line_hash").join(mine, "line_hash").groupBy("group", "text_hash").agg(F.count("*").alias("k"))
    spread = spread.groupBy("group").agg(F.count("*").alias("t")).filter(F.col("t") >= min_docs)
    spread = materialize(spread.select("group"), "recurring")
    return own.unionByName(mine.join(spread, "group", "left_semi").select("line_hash")).distinct()


def dedup_lines(docs: DataFrame, depth: int = 4, min_docs: int = 3, min_docs_long: int = 2, long_words: int = 50, share: float = 0.5, like: float = 0.8) -> DataFrame:
    """doc_id, n_lines, n_dropped and the text without the lines that recur, by themselves or by their template.

    A line recurs if it stands in min_docs different texts, one of long_words words or more in min_docs_long, a template if its
    lines stand in min_docs. Every occurrence goes, the first too; lines without a word
    stay. Exact copies of a text count once, so a document is not emptied for having copies.
    Null text gives null text and no lines; null doc_ids are kept apart from others;
    repeated rows are cleaned alike; other columns are ignored; an empty table gives an
    empty one. One pass reads lines, to hashes; the second takes out what is on its text's list. Texts move once, to meet the lists.
    """
    keys = ["text_hash", "leaf", "line_hash", "long", "places"]
    pairs = materialize(line_table(docs.select("text"), depth, long_words).groupBy(*keys).agg(F.count("*").alias("rows")).drop("rows"), "linetexts")
    found = materialize(recurring_lines(pairs, min_docs, min_docs_long, share, like), "dropped")
    # few rows a text: only lines to drop; texts that are equal share one list
    drop = pairs.select("text_hash", "line_hash").join(found, "line_hash", "left_semi")
    drop = materialize(drop.groupBy(F.col("text_hash").alias("th")).agg(F.collect_set("line_hash").alias("drop")), "droplists")
    rows = docs.select("doc_id", "text", F.xxhash64(text_or_empty()).alias("th"))
    met = rows.join(drop, "th", "left").withColumn("drop", F.coalesce("drop", F.array().cast("array<bigint>")))
    lines = F.split("text", "\n")
    goes = lambda x: F.array_contains("drop", F.xxhash64(x)) & has_word(x)
    kept = F.filter(lines, lambda x: ~goes(x))
    cleaned = met.select("doc_id", "text", F.size("drop").alias("n_drop"), F.when(F.size("drop") > 0, kept).alias("kept"))
    n_lines = F.when(F.col("text").isNull() | (F.col("text") == ""), 0).otherwise(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)
    return cleaned.select(
        "doc_id",
        n_lines.cast("long").alias("n_lines"),
        F.when(F.col("text").isNull() | (F.col("n_drop") == 0), 0).otherwise(n_lines - F.size("kept")).cast("long").alias("n_dropped"),
        F.when(F.col("n_drop") == 0, F.col("text")).otherwise(F.array_join("kept", "\n")).alias("text"),
    )
