"""The code index: files to facts, resolved dependencies and typed edges, all as DataFrames."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .extract import facts as ex
from .extract import registry
from .functions import paths, text
from .operators import edges as build
from .operators import modules as mod
from .operators import resolve
from .operators.cut import cut
from .operators.retrieve import Corpus
from .operators.spread import TEXTS, spread

_SCHEMA = "path string, language string, fact string, name string, ref string, owner string, line_start int, line_end int, extra string, doc string, doc_source string, hash string, meaning string"
#: What a file without an analyzer of its own has been read by.
TEXT_VERSION = "text-1"


def parse(files: DataFrame, analyzers: dict[str, registry.Analyzer] | None = None) -> DataFrame:
    """Facts of files (path, language, text) in languages that have an analyzer; Arrow batches, no shuffle. A file that can't be analyzed is one row, `failed`."""
    known = registry.registry(analyzers)

    def one(path: str, language: str, body: str) -> list[dict]:
        a = known[language]
        try:
            return registry.checked(a.run(path, body))
        except Exception as e:  # one bad file is a diagnostic, its former facts stay
            return [{"fact": "failed", "name": a.parser_version, "extra": f"{type(e).__name__}: {e}"[:400]}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("path", pa.string()), ("language", pa.string()), *[(n, pa.int32() if n.startswith("line") else pa.string()) for n in registry.FIELDS]])
        for b in batches:
            rows = [{"path": p, "language": lang} | {k: f.get(k) for k in registry.FIELDS} for p, lang, t in zip(*(c.to_pylist() for c in b.columns), strict=True) for f in one(p, lang, t)]
            yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    return files.filter(F.col("language").isin(*known)).select("path", "language", "text").mapInArrow(run, _SCHEMA)


@dataclass
class Index:
    files: DataFrame
    symbols: DataFrame
    dependencies: DataFrame
    routes: DataFrame
    entries: DataFrame
    objects: DataFrame
    tests: DataFrame
    edges: DataFrame
    diagnostics: DataFrame


def read_files(files: DataFrame) -> DataFrame:
    """files (path, text) that are sources of at most 4 MiB without NUL, with their attributes; of a path that stands twice one."""
    some = files.filter(paths.is_likely_source(F.col("path")) & F.col("text").isNotNull() & (F.octet_length("text") <= 4_194_304) & (F.instr("text", "\0") == 0)).select("path", "text")
    # only the texts of paths that stand twice are shuffled
    twice = some.groupBy("path").agg(F.count("*").alias("n")).filter("n > 1").select("path")
    once = some.join(twice, "path", "left_semi").groupBy("path").agg(F.min("text").alias("text"))
    some = some.join(twice, "path", "left_anti").unionByName(once)
    return some.select("path", paths.detect_language(F.col("path")).alias("language"), "text", text.content_hash(F.col("text")).alias("content_hash"), text.line_count(F.col("text")).alias("line_count"), paths.is_test_path(F.col("path")).alias("is_test")).withColumn("parser_version", parser_version(F.col("language")))


def parser_version(language: Column, analyzers: dict[str, registry.Analyzer] | None = None) -> Column:
    """What writes the facts of a language: a file whose facts another version wrote is analyzed again."""
    pairs = [F.lit(x) for k, a in registry.registry(analyzers).items() for x in (k, a.parser_version)]
    return F.coalesce(F.create_map(*pairs)[language], F.lit(TEXT_VERSION))


def exports(facts: DataFrame, symbols: DataFrame, modules: DataFrame, rounds: int = 64) -> DataFrame:
    """(path, name, symbol_id): what each module exports, own or passed on; names with several targets are left out by users.

    Rounds are as many as modules that pass a name on in a row; a longer chain is an error, not a part of the result."""
    own = facts.filter("fact = 'export'").join(symbols.select("path", F.col("name").alias("ref"), "symbol_id"), ["path", "ref"]).select("path", "name", "symbol_id")
    via = modules.filter("to_file is not null and fact in ('reexport', 'reexport_all')").select(F.col("path").alias("user"), F.col("to_file").alias("path"), F.col("name").alias("as_name"), F.col("extra").alias("of_name"))
    seen, level = cut(own.distinct()), own.distinct()
    for _ in range(rounds):
        met = level.join(via, "path").filter("of_name is null or of_name = name").filter("of_name is not null or name <> 'default'")
        step = met.select(F.col("user").alias("path"), F.coalesce("as_name", "name").alias("name"), "symbol_id").distinct()
        level = cut(step.join(seen, ["path", "name", "symbol_id"], "left_anti"))
        if level.isEmpty():
            return seen
        seen = cut(seen.unionByName(level))
    raise RuntimeError(f"exports did not end in {rounds} rounds")


def _in_scope(rows: DataFrame, packages: DataFrame, path: str = "path") -> DataFrame:
    """rows with `scope`: a Go file's folder and package, else the file."""
    met = rows.join(packages.select(F.col("path").alias(path), F.col("name").alias("_pkg")), path, "left")
    return met.withColumn("scope", F.when(F.col("_pkg").isNotNull(), F.concat_ws("|", paths.dirname(F.col(path)), "_pkg")).otherwise(F.col(path))).drop("_pkg")


def _base(c: Column) -> Column:
    return text.go_base_type(c)


@dataclass
class Facts:
    """What the text of each file says by itself, in tables with a column path: all that is read again when a file changes."""

    parsed: DataFrame
    objects: DataFrame
    server: DataFrame
    client: DataFrame
    entries: DataFrame


def extract(files: DataFrame) -> Facts:
    """Facts of files (as read_files gives them), without any shuffle of texts."""
    source = files.select("path", "text")
    code = files.filter(F.col("language").isin(*registry.BUILTIN)).select("path", "text")
    entries = ex.entries(code, [], "path")
    return Facts(parse(files), ex.db_objects(source, ["path"]), ex.server_routes(code, ["path"]), ex.client_requests(code, ["path"]), entries)


def build_index(files: DataFrame) -> Index:
    """All relations of the index over files (path, text). A reference with several targets stays unresolved."""
    files = cut(spread(read_files(files), TEXTS))  # parsers and patterns run on all cores, however few row groups hold the texts
    found = extract(files)
    return relate(files, Facts(*[cut(getattr(found, f)) for f in found.__dataclass_fields__]))


def relate(files: DataFrame, found: Facts) -> Index:
    """The relations between facts: everything that depends on more than one file."""
    facts = found.parsed
    packages = facts.filter("fact = 'package'").select("path", "name")
    symbols = facts.filter("fact = 'symbol'").select("path", "language", F.col("ref").alias("symbol_id"), "name", F.col("owner").alias("receiver"), "line_start", "line_end", F.col("extra").alias("signature"), F.col("doc").alias("description"), F.col("doc_source").alias("description_source"), F.col("hash").alias("implementation_hash"), F.col("meaning").alias("semantic_hash"))
    symbols = cut(_in_scope(symbols, packages).withColumn("base", _base(F.coalesce("receiver", F.lit("")))))
    modules = cut(mod.resolve_modules(facts.filter("fact in ('import', 'reexport', 'reexport_all', 'binding', 'dynamic_import')"), files))
    exported = exports(facts, symbols, modules)
    calls = facts.filter("fact = 'call'").select("path", "language", "name", "ref", "owner", "line_start", "extra").distinct()
    calls = _in_scope(calls, packages).withColumn("id", F.xxhash64("path", "ref", F.coalesce("owner", F.lit("")), "line_start"))
    # a package's name in a call leads to its import path, and that to the folder of its files
    go_dirs = cut(mod.go_packages(files, packages))
    root, how, base = F.substring_index("ref", ".", 1), F.substring_index(F.coalesce("extra", F.lit("")), "|", 1), _base(F.substring_index(F.coalesce("extra", F.lit("")), "|", -1))
    parts = F.size(F.split("ref", r"\."))
    bound = modules.filter("fact = 'binding'").select("path", F.col("name").alias("root"), F.col("extra").alias("imported"), "to_file", F.col("ref").alias("import_path"), F.lit(True).alias("is_bound"))
    bound = bound.join(go_dirs.withColumnRenamed("folder", "go_dir"), "import_path", "left").drop("import_path")
    calls = cut(calls.withColumn("root", root).withColumn("how", how).withColumn("base", base).withColumn("parts", parts).join(bound.dropDuplicates(["path", "root"]), ["path", "root"], "left"))
    one = lambda df, keys, tag: df.groupBy(*keys).agg(F.count("*").alias(f"n_{tag}"), F.min("symbol_id").alias(f"t_{tag}"))
    wanted = F.when((F.col("imported") == "*") & (F.col("parts") == 2), F.col("name")).when((F.col("imported") != "*") & (F.col("parts") == 1), F.col("imported"))
    calls = calls.withColumn("wanted", wanted)
    by_export = one(exported.select(F.col("path").alias("to_file"), F.col("name").alias("wanted"), "symbol_id").distinct(), ["to_file", "wanted"], "x")
    by_method = one(symbols.filter("base <> ''"), ["scope", "base", "name"], "m")
    by_name = one(symbols, ["scope", "name"], "s")
    in_dir = symbols.filter("language = 'go' and base = '' and not endswith(path, '_test.go')").withColumn("go_dir", paths.dirname(F.col("path")))
    by_package = one(in_dir, ["go_dir", "name"], "p")
    fields = _in_scope(facts.filter("fact = 'field'").select("path", F.col("owner").alias("base"), F.col("name").alias("field"), F.col("ref").alias("kind")), packages).drop("path").dropDuplicates(["scope", "base", "field"])
    ifaces = _in_scope(facts.filter("fact = 'iface_method'").select("path", "owner", "name", "extra"), packages)
    methods = symbols.filter("base <> ''")
    shape = lambda owner, sig: F.concat_ws("|", "scope", "name", sig)
    needs = ifaces.select(F.concat_ws("|", "scope", "owner").alias("iface"), shape("owner", "extra").alias("shape"))
    has = methods.select(F.concat_ws("|", "scope", "base").alias("owner"), shape("base", "signature").alias("shape"))
    impl = resolve.implementers(needs, has).select(F.col("iface").alias("_iface"), F.col("owner").alias("_impl"))
    met = calls.join(by_export, ["to_file", "wanted"], "left").join(by_method, ["scope", "base", "name"], "left").join(by_name, ["scope", "name"], "left").join(by_package, ["go_dir", "name"], "left")
    met = met.withColumn("field", F.get(F.split("ref", r"\."), 1)).join(fields, ["scope", "base", "field"], "left")
    plain_kind = F.when(~F.col("kind").rlike(r"[.\[\]]"), F.regexp_replace("kind", r"^\*", ""))
    met = met.withColumn("fbase", plain_kind).withColumn("_iface", F.concat_ws("|", "scope", "fbase")).join(impl, "_iface", "left")
    met = met.withColumn("fbase", F.when(F.col("_impl").isNotNull(), F.substring_index("_impl", "|", -1)).otherwise(F.col("fbase")))
    by_field = by_method.select("scope", F.col("base").alias("fbase"), "name", F.col("n_m").alias("n_f"), F.col("t_m").alias("t_f"))
    met = met.join(by_field, ["scope", "fbase", "name"], "left")
    steps = [
        ((F.col("language") == "go") & F.col("go_dir").isNotNull() & (F.col("parts") == 2), "n_p", "t_p", "go_types_object", "go_types_call_ambiguous", "go_types_target_unindexed"),
        (F.col("is_bound") & (F.col("language") != "go"), "n_x", "t_x", "import_binding_symbol", "import_binding_ambiguous", "import_target_missing"),
        (F.col("how") == "receiver_method", "n_m", "t_m", "receiver_type", "receiver_method_ambiguous", "receiver_method_not_found"),
        (F.col("how") == "receiver_field_method", "n_f", "t_f", "receiver_field_type", "receiver_field_ambiguous", "receiver_field_type_unresolved"),
        (F.col("parts") == 1, "n_s", "t_s", "unique_symbol_name", "symbol_name_ambiguous", "symbol_not_found"),
    ]
    target, label = F.lit(None).cast("string"), F.lit("selector_receiver_unresolved")
    for cond, n, t, hit, many, none in reversed(steps):
        target = F.when(cond, F.when(F.col(n) == 1, F.col(t))).otherwise(target)
        label = F.when(cond, F.when(F.col(n) == 1, hit).when(F.col(n) > 1, many).otherwise(none)).otherwise(label)
    call_deps = met.select(F.lit("calls").alias("relation"), F.col("owner").alias("from_symbol_id"), F.col("path").alias("from_file"), F.col("ref").alias("to_ref"), F.lit(None).cast("string").alias("to_file"), target.alias("resolved_symbol_id"), label.alias("resolution"))
    import_deps = modules.filter("fact in ('import', 'reexport', 'reexport_all', 'dynamic_import')")
    to_file = F.when(F.col("fact") != "dynamic_import", F.col("to_file"))
    import_deps = import_deps.select(F.lit("imports").alias("relation"), F.lit(None).cast("string").alias("from_symbol_id"), F.col("path").alias("from_file"), F.col("ref").alias("to_ref"), to_file.alias("to_file"), F.lit(None).cast("string").alias("resolved_symbol_id"), F.when(F.col("fact") == "dynamic_import", "dynamic_import_unresolved").when(F.col("to_file").isNotNull(), F.col("resolution")).when(F.col("ref").startswith("."), "module_unresolved").otherwise("external_or_untracked_module").alias("resolution")).distinct()
    deps = cut(call_deps.unionByName(import_deps))

    keyed = symbols.select(F.col("path").alias("file_path"), "line_start", "line_end", "symbol_id")
    near = lambda rows, keys: resolve.nearest_symbol(rows.withColumnRenamed("path", "file_path"), keyed, keys)
    server = near(found.server, ["method", "route_path", "handler_ref"])
    receivers = symbols.select("symbol_id", F.col("base").alias("owner_type"), "scope")
    server = cut(server.join(receivers, "symbol_id", "left").withColumn("node_id", F.concat_ws(":", F.lit("route:server"), "method", "route_path")))
    client = cut(near(found.client, ["method", "route_path"]).withColumn("id", F.xxhash64("file_path", "line", "method", "route_path")))
    routes = server.select("file_path", "symbol_id", "method", "route_path", F.lit("server").alias("direction"), "line", "handler_ref").unionByName(client.select("file_path", "symbol_id", "method", "route_path", F.lit("client").alias("direction"), "line", F.lit(None).cast("string").alias("handler_ref")))
    entries = near(found.entries, ["entry_kind", "entry_name", "handler_ref", "node_id"])
    mains = symbols.join(packages.filter("name = 'main'").select("path"), "path", "left_semi").filter("name = 'main' and base = ''")
    mains = mains.select(F.lit("cli").alias("entry_kind"), F.lit("main").alias("entry_name"), F.lit("main").alias("handler_ref"), F.concat_ws(":", F.lit("entry:cli"), "path", F.lit("main"), F.col("line_start").cast("string")).alias("node_id"), F.col("path").alias("file_path"), F.col("line_start").alias("line"), "symbol_id")
    entries = entries.unionByName(mains)
    objects = cut(near(found.objects, ["operation", "object_name"]).withColumn("object_type", F.lit("table")))

    # a handler `x.Show`: x is the receiver of the function around it, or a parameter of it, and Show a method of its type; else a unique
    # simple name among functions and methods of Go
    tail, dotted = F.substring_index("handler_ref", ".", -1), F.col("handler_ref").contains(".")
    every = one(symbols.filter("language = 'go'"), ["name"], "a")
    held = facts.filter("fact = 'param'").select(F.col("owner").alias("symbol_id"), F.col("name").alias("var"), _base(F.col("ref")).alias("base"), F.col("extra").alias("held_by")).dropDuplicates(["symbol_id", "var"])
    handled = server.withColumn("name", tail).withColumn("var", F.when(dotted, F.substring_index("handler_ref", ".", 1))).join(held, ["symbol_id", "var"], "left")
    handled = handled.join(by_method, ["scope", "base", "name"], "left").join(every, "name", "left")
    typed = F.col("base").isNotNull() & (F.col("n_m") == 1)
    handler = F.when(typed, F.col("t_m")).when(F.col("n_a") == 1, F.col("t_a"))
    why = F.when(typed & (F.col("held_by") == "receiver"), "method_receiver_type").when(typed, "receiver_parameter_type").when(F.col("n_a") == 1, "unique_symbol_name").when(F.col("n_a") > 1, "handler_not_unique").otherwise("receiver_not_resolved")
    handled = handled.filter("handler_ref is not null").select("node_id", "file_path", "line", "handler_ref", handler.alias("handler_symbol_id"), why.alias("resolution"))
    scoped = _in_scope(entries.withColumnRenamed("file_path", "path"), packages)
    started = scoped.withColumn("name", F.when(~dotted, F.col("handler_ref"))).join(by_name, ["scope", "name"], "left").select("node_id", F.col("path").alias("file_path"), "line", "entry_kind", "entry_name", "symbol_id", "handler_ref", F.when(F.col("n_s") == 1, F.col("t_s")).alias("handler_symbol_id"))
    started = cut(started)

    matched = resolve.match_routes(client.select("id", "method", "route_path"), server.select(F.col("node_id").alias("route_id"), "method", "route_path").distinct())
    nodes = server.select(F.col("node_id").alias("route_id"), "method", "route_path").distinct()
    api = calls.filter(paths.is_page_like(F.col("path")) & paths.is_api_module(F.col("to_file")) & F.col("wanted").isNotNull()).join(by_export, ["to_file", "wanted"], "left")
    page_api = api.select(F.concat(F.lit("file:"), "path").alias("from_node_id"), F.when(F.col("n_x") == 1, F.concat(F.lit("symbol:"), "t_x")).otherwise(F.concat(F.lit("ref:page_api:"), "ref")).alias("to_node_id"), F.lit("page_api").alias("type"), F.when(F.col("n_x") == 1, "static").otherwise("unresolved").alias("confidence"), build.evidence(api, resolution=F.lit("import_binding_symbol"), file_path=F.col("path"), line=F.col("line_start"), reference=F.col("ref")))
    tests = test_targets(files, symbols, deps)
    parts_ = [build.dependency_edges(deps), build.db_edges(objects), build.test_edges(tests), page_api, build.handler_edges("route_handler", handled), build.request_edges(client, matched, nodes), build.handler_edges("entry_handler", started)]
    edges = parts_[0]
    for p in parts_[1:]:
        edges = edges.unionByName(p)
    return Index(files, symbols, deps, routes, started, objects, tests, cut(build.with_id(edges)), diagnostics(facts, modules))


FEATURES = "feature_id string, name string, description string, status string, needs_review boolean, invariants array<string>, steps array<struct<action:string,symbol_id:string,file_path:string>>"


def corpus_of(index: Index, features: DataFrame | None = None) -> Corpus:
    """The index as what a question is asked of."""
    spark = index.files.sparkSession
    symbols = index.symbols.select("symbol_id", F.col("path").alias("file_path"), "name", F.concat_ws(".", F.nullif("receiver", F.lit("")), "name").alias("qualified_name"), "description", "signature", "line_start", "line_end")
    edges = index.edges.select("edge_id", F.col("from_node_id").alias("src"), F.col("to_node_id").alias("dst"), "type", "confidence")
    features = spark.createDataFrame([], FEATURES) if features is None else features
    return Corpus(index.files, symbols, index.routes, index.objects, index.entries, index.dependencies, index.tests, features, edges, index.diagnostics.filter("severity = 'error'").count())


def diagnostics(facts: DataFrame, modules: DataFrame, most: int = 8) -> DataFrame:
    """path, language, severity, analyzer, message: files that could not be analyzed, and of each file the first `most` relative modules that lead nowhere."""
    failed = facts.filter("fact = 'failed'").select("path", "language", F.lit("error").alias("severity"), F.col("name").alias("analyzer"), F.col("extra").alias("message"))
    lost = modules.filter("to_file is null and ref like '.%' and fact in ('import', 'reexport', 'reexport_all') or fact = 'dynamic_import'")
    lost = lost.groupBy("path", "language", "ref", "fact").agg(F.min("line_start").alias("line"))
    place = F.row_number().over(Window.partitionBy("path").orderBy("line", "ref", "fact"))
    lost = lost.withColumn("n", place).filter(F.col("n") <= most)
    what = F.when(F.col("fact") == "dynamic_import", "dynamic import is not resolved: ").otherwise("cannot find module: ")
    return failed.unionByName(lost.select("path", "language", F.lit("warning").alias("severity"), F.lit("modules").alias("analyzer"), F.concat(what, "ref").alias("message")))


def test_targets(files: DataFrame, symbols: DataFrame, deps: DataFrame) -> DataFrame:
    """test_file, target_file, target_symbol_id, reason, confidence: files of the paired name, and symbols that tests call."""
    tests = files.filter("is_test").select(F.col("path").alias("test_file"))
    pair = F.regexp_replace(F.regexp_replace("test_file", r"_test\.go$", ".go"), r"\.(test|spec)\.(ts|tsx|js|jsx)$", ".$2")
    named = tests.withColumn("target_file", pair).filter("target_file <> test_file").join(files.select(F.col("path").alias("target_file")), "target_file", "left_semi")
    named = named.select("test_file", "target_file", F.lit(None).cast("string").alias("target_symbol_id"), F.lit("filename_pair").alias("reason"), F.lit(0.98).alias("confidence"))
    called = deps.filter("relation = 'calls' and resolved_symbol_id is not null").select(F.col("from_file").alias("test_file"), F.col("resolved_symbol_id").alias("symbol_id")).distinct().join(tests, "test_file", "left_semi")
    called = called.join(symbols.select("symbol_id", F.col("path").alias("target_file")), "symbol_id").join(files.filter("not is_test").select(F.col("path").alias("target_file")), "target_file", "left_semi").filter("target_file <> test_file")
    return named.unionByName(called.select("test_file", "target_file", F.col("symbol_id").alias("target_symbol_id"), F.lit("test_calls_symbol").alias("reason"), F.lit(0.9).alias("confidence")))
