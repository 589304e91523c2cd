"""Text expressions: scores of terms, terms of a query, lines, hashes, redaction."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def text_score(value: Column, terms: Iterable[str], weight: float = 1.0) -> Column:
    """Sum over terms: weight if value holds the term in any case, half of it more if value starts with it."""
    v = F.lower(F.coalesce(value, F.lit("")))
    total = F.lit(0.0)
    for t in terms:
        total = total + F.when(v.contains(t), F.lit(float(weight)) + F.when(v.startswith(t), F.lit(weight * 0.5)).otherwise(0.0)).otherwise(0.0)
    return total


def _plain(term: str) -> str:
    return "".join(c for c in term.lower() if c.isascii() and c.isalnum())


def ascii_tokens(value: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(value, F.lit(""))), "[^a-z0-9]+"), "")


def exact_token_score(value: Column, terms: Iterable[str], weight: float = 1.0) -> Column:
    """weight for each term that is a whole alphanumeric token of value."""
    tokens, total = ascii_tokens(value), F.lit(0.0)
    for t in map(_plain, terms):
        if len(t) >= 2:
            total = total + F.when(F.array_contains(tokens, t), float(weight)).otherwise(0.0)
    return total


def camel_split(value: Column) -> Column:
    return F.regexp_replace(value, "([a-z0-9])([A-Z])", "$1 $2")


def path_surface_score(path: Column, terms: Iterable[str]) -> Column:
    """24 for a term that is the stem of the path's basename, 9 for one that is a token of the path; 30 at most."""
    shown = F.lower(F.translate(camel_split(path), "\\", "/"))
    stem, tokens, total = F.regexp_extract(shown, r"([^/.]*)[^/]*$", 1), ascii_tokens(shown), F.lit(0.0)
    for t in map(_plain, terms):
        if len(t) >= 2:
            total = total + F.when(stem == t, 24.0).when(F.array_contains(tokens, t), 9.0).otherwise(0.0)
    return F.least(F.lit(30.0), total)


def raw_terms(value: Column) -> Column:
    """Runs of two or more letters or digits, camel case split."""
    cut = F.regexp_replace(camel_split(F.coalesce(value, F.lit(""))), r"[_.:/\\-]+", " ")
    return F.regexp_extract_all(cut, F.lit(r"[\p{L}\p{N}]{2,}"), F.lit(0))


def line_count(text: Column) -> Column:
    return F.when(text == "", 0).otherwise(F.size(F.split(text, "\r?\n", -1)))


def newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def token_estimate(n_bytes: Column) -> Column:
    return F.ceil(n_bytes / 4)


def route_shape(path: Column) -> Column:
    """A route without query and fragment, its {parameters} nameless."""
    return F.regexp_replace(F.regexp_replace(path, r"[?#].*$", ""), r"\{[^/{}]+\}", "{}")


def normalize_client_path(url: Column) -> Column:
    """Path of a request literal: no query, no fragment, no host, single slashes; null if it isn't a path."""
    p = F.regexp_replace(url, r"[?#].*$", "")
    p = F.regexp_replace(p, r"^https?://[^/]*", "")
    p = F.regexp_replace(p, "/{2,}", "/")
    return F.when(p.startswith("/"), p)


def symbol_hint(symbol_id: Column) -> Column:
    """What stands after the last '::' of a symbol's id."""
    return F.regexp_extract(symbol_id, r"(?s)^(?:.*::)?(.*)$", 1)


# Patterns of secrets; the first group of each stays.
SECRETS = (
    (r"(?i)(authorization\s*:\s*bearer\s+)[^\s\"']+", "$1"),
    (r"\bsk-[A-Za-z0-9_-]{16,}\b", ""),
    (r"\bts_[A-Za-z0-9_-]{12,}\b", ""),
    (r"\bgh[pousr]_[A-Za-z0-9_]{20,}\b", ""),
    (r"(?i)((?:api[_-]?key|token|secret|password|passwd|pwd)\s*[:=]\s*[\"']?)[^\s\"',;]+", "$1"),
)


def redact_secrets(text: Column) -> Column:
    for pattern, keep in SECRETS:
        text = F.regexp_replace(text, pattern, f"{keep}[redacted]")
    return text


def encode_uri_component(value: Column) -> Column:
    out = F.replace(F.url_encode(value), F.lit("+"), F.lit("%20"))
    for mark, code in (("!", "%21"), ("'", "%27"), ("(", "%28"), (")", "%29"), ("~", "%7E")):
        out = F.replace(out, F.lit(code), F.lit(mark))
    return out


def go_base_type(name: Column) -> Column:
    """A Go type without pointers, slices, package and type arguments."""
    return F.regexp_extract(F.regexp_replace(F.regexp_replace(name, r"^[\s*&\[\]]+", ""), r"\[.*$", ""), r"[^.]*$", 0)


def cursor_encode(ts: Column, key: Column) -> Column:
    """A page cursor: base64url of 'timestamp|key' in one line, without padding."""
    raw = F.base64(F.encode(F.concat_ws("|", ts.cast("string"), key.cast("string")), "UTF-8"))
    return F.regexp_replace(F.translate(raw, "+/", "-_"), r"[=\r\n]+", "")  # base64 is broken into lines


def cursor_decode(cursor: Column) -> Column:
    parts = F.split(F.decode(F.unbase64(F.translate(cursor, "-_", "+/")), "UTF-8"), r"\|")
    return F.struct(parts[0].alias("ts"), parts[1].alias("key"))


def stable_hash(*fields: tuple[str, Column]) -> Column:
    """sha256 of the JSON of the named fields in alphabetical order, nulls kept."""
    return F.sha2(F.to_json(F.struct(*[c.alias(n) for n, c in sorted(fields, key=lambda x: x[0])]), {"ignoreNullFields": "false"}), 256)


def safe_text(text: Column, most: int = 512_000) -> Column:
    """The head of a text without its secrets."""
    return redact_secrets(F.substring(text, 1, most))


def keyword_preview(text: Column, terms: Iterable[str], chars: int = 2400, wide: int = 400) -> Column:
    """Windows around the first place of each of twelve terms at most, a third of each in front of it, joined and cut to `chars`; the head if none hits."""
    low = F.lower(text)
    windows = []
    for t in list(dict.fromkeys(x.lower() for x in terms))[:12]:
        at = F.instr(low, t)
        start = F.greatest(F.lit(1), at - int(wide * 0.35))
        windows.append(F.when(at > 0, F.substr(text, start, F.lit(wide))))
    if not windows:
        return redact_secrets(F.substring(text, 1, chars))
    found = F.array_distinct(F.filter(F.array(*windows), lambda w: w.isNotNull()))
    shown = F.when(F.size(found) > 0, F.array_join(found, "\n...\n")).otherwise(text)
    return redact_secrets(F.substring(shown, 1, chars))


def lexical_score(path: Column, preview: Column, terms: Iterable[str], changed: Column | None = None) -> Column:
    """8 for a term in the path, 2 in the preview, 1 more if it is there twice; 6 for a changed file, 3 for a test if the task is about tests."""
    p, body, terms = F.lower(path), F.lower(F.coalesce(preview, F.lit(""))), list(terms)
    total = F.when(changed, 6.0).otherwise(0.0) if changed is not None else F.lit(0.0)
    for t in terms:
        first = F.instr(body, t)
        twice = F.instr(F.substr(body, first + F.length(F.lit(t)), F.length(body)), t) > 0
        total = total + F.when(p.contains(t), 8.0).otherwise(0.0) + F.when(first > 0, F.lit(2.0) + F.when(twice, 1.0).otherwise(0.0)).otherwise(0.0)
    about_tests = any(x in t for t in terms for x in ("test", "accept", "验收", "测试"))
    base = F.regexp_extract(F.translate(p, "\\", "/"), "[^/]*$", 0)
    return total + (F.when(base.rlike("test|spec|acceptance"), 3.0).otherwise(0.0) if about_tests else F.lit(0.0))


def classify_score(probability: Column, must: float, maybe: float) -> Column:
    return F.when(probability >= must, "must_read").when(probability >= maybe, "maybe_read").otherwise("skip")


def json_or(text: Column, schema: str, otherwise: Column) -> Column:
    """JSON of a schema, or something else where the text is none."""
    return F.coalesce(F.from_json(text, schema), otherwise)


def parse_params(signature: Column) -> Column:
    """name and type of each parameter of `a: T = x, ...b?: U`: cut at commas outside of brackets, without defaults, marks and dots."""
    # brackets, commas and what stands between them, so that a step is one of these and not a character
    tokens = F.regexp_extract_all(signature, F.lit(r"[^()\[\]{}<>,]+|[()\[\]{}<>,]"), F.lit(0))
    state = lambda depth, done, last: F.named_struct(F.lit("depth"), depth, F.lit("done"), done, F.lit("last"), last)

    def step(a: Column, c: Column) -> Column:
        depth = a["depth"] + F.when(c.isin("(", "[", "{", "<"), 1).when(c.isin(")", "]", "}", ">"), -1).otherwise(0)
        cut = (c == ",") & (a["depth"] <= 0)
        return F.when(cut, state(a["depth"], F.concat(a["done"], F.array(a["last"])), F.lit(""))).otherwise(state(depth, a["done"], F.concat(a["last"], c)))

    start = state(F.lit(0), F.array().cast("array<string>"), F.lit(""))
    parts = F.filter(F.transform(F.aggregate(tokens, start, step, lambda a: F.concat(a["done"], F.array(a["last"]))), lambda x: F.trim(x)), lambda x: x != "")  # trim alone would take the index as what to trim
    plain = F.transform(parts, lambda x: F.trim(F.regexp_replace(x, r"\s*=(?!>)[\s\S]*$", "")))
    name = lambda x: F.regexp_extract(x, r"^(?:\.\.\.)?\s*([^:?]*[^:?\s])", 1)
    kind = lambda x: F.nullif(F.trim(F.regexp_extract(x, r"^[^:]*:([\s\S]*)$", 1)), F.lit(""))
    return F.transform(plain, lambda x: F.named_struct(F.lit("name"), name(x), F.lit("type"), kind(x)))


def unique_span(line: Column, name: Column) -> Column:
    """first and last (not included) byte of an identifier on a line, null unless it stands there once."""
    whole = F.concat(F.lit(r"(?<![\p{L}\p{N}_$])\Q"), name, F.lit(r"\E(?![\p{L}\p{N}_$])"))
    head = F.get(F.split(line, whole, -1), F.lit(0))
    first = F.octet_length(head)
    return F.when(F.size(F.split(line, whole, -1)) == 2, F.struct(first.alias("first"), (first + F.octet_length(name)).alias("last")))
