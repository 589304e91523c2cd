"""Path expressions: language, tests, blocked and source files, manifests (all JVM-side columns)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extension to language.
LANGUAGES = {
    ".go": "go", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript",
    ".mjs": "javascript", ".cjs": "javascript", ".vue": "vue", ".sql": "sql", ".proto": "proto",
    ".py": "python", ".java": "java", ".rs": "rust", ".cs": "csharp", ".kt": "kotlin",
}
# Extensions and basenames of source files.
SOURCE_EXTENSIONS = (
    ".go", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".vue",
    ".py", ".java", ".kt", ".kts", ".rs", ".cs", ".cpp", ".cc", ".c", ".h", ".hpp",
    ".sql", ".proto", ".graphql", ".gql", ".html", ".css", ".scss", ".sass", ".less",
    ".json", ".jsonc", ".yaml", ".yml", ".toml", ".ini", ".conf", ".properties",
    ".md", ".mdx", ".txt", ".sh", ".bash", ".zsh", ".ps1", ".bat", ".cmd",
    ".xml", ".gradle", ".mod", ".sum",
)
SOURCE_BASENAMES = ("Dockerfile", "Makefile", "Procfile", "go.mod", "go.work")
# Files that are never read.
BLOCKED_BASENAMES = (
    ".env", ".env.local", ".env.production", ".env.development", ".npmrc", ".pypirc",
    "id_rsa", "id_ed25519", "credentials", "credentials.json", "secrets.json", ".context-query-aliases.json",
)
BLOCKED_SUFFIXES = (
    ".pem", ".key", ".p12", ".pfx", ".crt", ".cer", ".jks", ".keystore",
    ".lock", "package-lock.json", "pnpm-lock.yaml", "yarn.lock", "uv.lock",
)
BLOCKED_SEGMENTS = (".git", "node_modules", "vendor")
# Score of a manifest by its basename.
MANIFESTS = {
    "package.json": 20, "pyproject.toml": 18, "cargo.toml": 18, "pom.xml": 18, "build.gradle": 18, "build.gradle.kts": 18,
    "go.mod": 18, "go.work": 16, "composer.json": 16, "gemfile": 16, "mix.exs": 16, "pubspec.yaml": 16, "deno.json": 16,
    "deno.jsonc": 16, "tsconfig.json": 14, "jsconfig.json": 14,
}
DB_INTENT = ("migration", "migrations", "schema", "database", "sql", "table", "数据库", "迁移", "表结构")


# Patterns of test paths, of tools' settings, of migrations, of pages, of API modules and of compilers' settings.
TEST_PATHS = (r"(^|/)(test|tests|__tests__|acceptance)(/|$)", r"(?:^|[._-])(test|spec)(?:[._-]|$)", r"_test\.go$")
TOOL_CONFIG = r"^(vite|webpack|rollup|eslint|prettier|babel|jest|vitest)\.config\.[^.]+$"
MIGRATIONS, DOWN = r"(^|/)migrations?/", r"\.down\.sql$"
PAGES = (r"(^|/)(views?|pages?)(/|$)", r"(view|page)\.vue$")
API_MODULES = r"(^|/)api(/|$)"
CONFIGS = r"^(?:tsconfig|jsconfig)(?:\.[^/]*)?\.json$"


def slashes(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def basename(path: Column) -> Column:
    return F.regexp_extract(slashes(path), r"[^/]*$", 0)


def dirname(path: Column) -> Column:
    return F.regexp_replace(slashes(path), r"/?[^/]*$", "")


def extension(path: Column) -> Column:
    """Lower-case extension with its dot; a leading dot alone makes none."""
    return F.lower(F.regexp_extract(basename(path), r"[^.](\.[^.]*)$", 1))


def _lookup(values: dict, key: Column) -> Column:
    pairs = [F.lit(x) for k, v in values.items() for x in (k, v)]
    return F.create_map(*pairs)[key]


def detect_language(path: Column) -> Column:
    return F.coalesce(_lookup(LANGUAGES, extension(path)), F.lit("text"))


def is_test_path(path: Column) -> Column:
    p = F.lower(slashes(path))
    return reduce(Column.__or__, [p.rlike(x) for x in TEST_PATHS])


def is_blocked(path: Column) -> Column:
    base = F.lower(basename(path))
    inside = F.arrays_overlap(F.split(slashes(path), "/"), F.array(*[F.lit(x) for x in BLOCKED_SEGMENTS]))
    ends = F.lit(False)
    for suffix in BLOCKED_SUFFIXES:
        ends = ends | base.endswith(suffix)
    return base.isin(*BLOCKED_BASENAMES) | inside | ends


def is_likely_source(path: Column) -> Column:
    p, base = slashes(path), basename(path)
    built = p.rlike(r"^(dist|build|coverage|target)/") | F.lower(p).endswith(".min.js") | F.lower(p).endswith(".map")
    return ~is_blocked(path) & ~built & (extension(path).isin(*SOURCE_EXTENSIONS) | base.isin(*SOURCE_BASENAMES))


def manifest_score(path: Column) -> Column:
    base = F.lower(basename(path))
    return F.coalesce(_lookup(MANIFESTS, base), F.when(base.rlike(TOOL_CONFIG), 14), F.lit(0))


def path_multiplier(path: Column, terms: list[str]) -> Column:
    """Weight of a file's score: migrations count less unless the task is about the database."""
    if any(t in DB_INTENT for t in terms):
        return F.lit(1.0)
    p = F.lower(slashes(path))
    return F.when(p.rlike(MIGRATIONS), F.when(p.rlike(DOWN), F.lit(0.12)).otherwise(0.25)).otherwise(F.lit(1.0))


def is_page_like(path: Column) -> Column:
    p = F.lower(slashes(path))
    return reduce(Column.__or__, [p.rlike(x) for x in PAGES])


def is_api_module(path: Column) -> Column:
    return F.lower(slashes(path)).rlike(API_MODULES)


def is_config(path: Column) -> Column:
    return F.lower(basename(path)).rlike(CONFIGS)
