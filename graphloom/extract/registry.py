"""Analyzers by language: what parses a file, which version it is, and how sure its facts are. Users add their own."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from . import golang, script

# How sure an analyzer is of what it says.
CAPABILITIES = ("unsupported", "heuristic", "static", "exact")
FIELDS = ("fact", "name", "ref", "owner", "line_start", "line_end", "extra", "doc", "doc_source", "hash", "meaning")
FACTS = ("symbol", "call", "import", "dynamic_import", "reexport", "reexport_all", "binding", "export", "package", "field", "iface_method", "param")


@dataclass(frozen=True)
class Analyzer:
    """run: path, text to rows of FIELDS. It must be picklable, for it runs on the executors."""

    name: str
    version: str
    capability: str
    run: Callable[[str, str], list[dict]]

    @property
    def parser_version(self) -> str:
        return f"{self.name}-{self.version}"


def _script(language: str) -> Callable[[str, str], list[dict]]:
    return lambda path, text: script.facts(path, text, language)


BUILTIN = {
    "go": Analyzer("go", "3", "static", golang.facts),
    "typescript": Analyzer("script", "2", "static", _script("typescript")),
    "javascript": Analyzer("script", "2", "static", _script("javascript")),
    "vue": Analyzer("vue", "2", "static", script.vue_facts),
}


def registry(extra: dict[str, Analyzer] | None = None) -> dict[str, Analyzer]:
    """The analyzers that come with the engine, with a user's own in their place or beside them."""
    for language, a in (extra or {}).items():
        if a.capability not in CAPABILITIES or a.capability == "unsupported":
            raise ValueError(f"{language}: capability is one of {CAPABILITIES[1:]}")
        if not a.name or not a.version or not callable(a.run):
            raise ValueError(f"{language}: an analyzer has a name, a version and a function")
    return BUILTIN | (extra or {})


def checked(rows: list[dict]) -> list[dict]:
    """rows, if each is a fact with known fields, and a symbol has its id, name and lines."""
    for r in rows:
        if r.get("fact") not in FACTS or set(r) - set(FIELDS):
            raise ValueError(f"no such fact: {str(r)[:80]}")
        if r["fact"] == "symbol" and not (r.get("ref") and r.get("name") and 1 <= r.get("line_start", 0) <= r.get("line_end", 0)):
            raise ValueError(f"not a whole symbol: {str(r)[:80]}")
    return rows
