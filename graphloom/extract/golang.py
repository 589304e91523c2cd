"""Facts of Go files: package, imports, functions and methods, calls, struct fields, interface methods."""

from __future__ import annotations

import json
import re

from .lexer import Lines, blank, close_of, comment_before, described, digest, split_list

_FUNC = re.compile(r"^func\s*(?:\(\s*([A-Za-z_]\w*)?\s*([^)]*)\)\s*)?([A-Za-z_]\w*)\s*(?:\[[^\]]*\])?\s*\(", re.M)
_TYPE = re.compile(r"^(?:type\s+|\t)([A-Za-z_]\w*)\s*(?:\[[^\]]*\])?\s+(struct|interface)\s*\{", re.M)
_CALL = re.compile(r"(?<![\w.])((?:[A-Za-z_]\w*\.)*[A-Za-z_]\w*)\s*(?:\[[^\]()]*\])?\(")
_IMPORT = re.compile(r"^import\s+(?:\(([\s\S]*?)\)|((?:[\w.]+\s+)?\"[^\"\n]+\"))", re.M)
# Words and builtin functions that are no calls of symbols.
BUILTIN = frozenset((
    "if", "for", "switch", "select", "func", "return", "range", "go", "defer", "append", "cap", "clear", "close", "complex", "copy",
    "delete", "imag", "len", "make", "max", "min", "new", "panic", "print", "println", "real", "recover",
))


def _types(text: str) -> list[str]:
    """Types of a parameter or result list, one for each name."""
    parts = split_list(text)
    named = any(re.match(r"[A-Za-z_]\w*\s+\S", p) for p in parts)
    out, waiting = [], 0
    for p in parts:
        m = re.match(r"[A-Za-z_]\w*\s+(\S.*)$", p) if named else None
        if named and not m:
            waiting += 1
            continue
        kind = re.sub(r"\s+", " ", m.group(1) if m else p)
        out += [kind] * (waiting + 1)
        waiting = 0
    return out + ["?"] * waiting


def _named(text: str) -> list[tuple[str, str]]:
    """(name, type) of a parameter list whose parameters have names."""
    parts, out, waiting = split_list(text), [], []
    for p in parts:
        name, _, kind = p.strip().partition(" ")
        waiting.append(name)
        if kind.strip():
            out += [(w, kind.strip()) for w in waiting]
            waiting = []
    return out


def _results(code: str, at: int) -> tuple[list[str], int]:
    """Result types after a parameter list, and where they end."""
    m = re.compile(r"\s*").match(code, at)
    at = m.end()
    if at < len(code) and code[at] == "(":
        end = close_of(code, at)
        return _types(code[at + 1 : end]), end + 1
    m = re.compile(r"[^\n{]*").match(code, at)
    return ([m.group().strip()] if m.group().strip() else []), m.end()


def facts(path: str, text: str) -> list[dict]:
    code, lines, out = blank(text), Lines(text), []
    shown = blank(text, strings=False)
    if m := re.search(r"^package\s+(\w+)", code, re.M):
        out.append({"fact": "package", "name": m.group(1)})
    for m in _IMPORT.finditer(shown):
        for x in re.finditer(r"(?:([\w.]+)\s+)?\"([^\"\n]+)\"", m.group(1) or m.group(2)):
            out.append({"fact": "import", "ref": x.group(2), "line_start": lines.of(m.start())})
            out.append({"fact": "binding", "name": x.group(1) or x.group(2).rsplit("/", 1)[-1], "ref": x.group(2), "extra": "*"})
    seen: dict[str, dict] = {}
    for m in _FUNC.finditer(code):
        var, receiver, name = m.group(1), re.sub(r"\s|\[.*?\]", "", m.group(2) or ""), m.group(3)
        if var and not receiver and m.group(2) is not None:
            var, receiver = None, var
        end = close_of(code, m.end() - 1)
        params = _types(code[m.end() : end])
        results, after = _results(code, end + 1)
        brace = code.find("{", after - 1)
        stop = close_of(code, brace) if brace >= 0 else after
        sid = f"go:{path}::{receiver + '.' if receiver else ''}{name}"
        row = {"fact": "symbol", "name": name, "ref": sid, "owner": receiver, "line_start": lines.of(m.start()), "line_end": lines.of(stop), "extra": f"({','.join(params)})({','.join(results)})"}
        out += [{"fact": "param", "owner": sid, "name": n, "ref": kind, "extra": how} for how, pairs in (("receiver", [(var, receiver)] if var else []), ("parameter", _named(code[m.end() : end]))) for n, kind in pairs]
        names = {}
        for c in _CALL.finditer(code, brace, stop):
            if c.group(1) not in BUILTIN:
                names.setdefault(c.group(1), c.start())
        doc, called = comment_before(text, m.start()), sorted(names)[:100]
        row |= {"doc": doc or described(name, params, path, called), "doc_source": "comment" if doc else "derived", "hash": digest(text[m.start() : stop + 1]), "meaning": digest(json.dumps([receiver, name, params, results, called]))}
        seen[sid] = row  # of two with one id the last stays
        for c in called:
            root, _, rest = c.partition(".")
            how = "receiver_method" if var and root == var and "." not in rest and rest else "receiver_field_method" if var and root == var and rest.count(".") == 1 else ""
            out.append({"fact": "call", "name": c.split(".")[-1], "ref": c, "owner": sid, "line_start": lines.of(names[c]), "extra": f"{how}|{receiver}"})
    out += seen.values()
    for m in _TYPE.finditer(code):
        body = code[m.end() : close_of(code, m.end() - 1)]
        for x in re.finditer(r"^\s*([A-Za-z_]\w*)\s*([^\n]*)$", body, re.M):
            if m.group(2) == "struct" and x.group(2).strip():
                out.append({"fact": "field", "owner": m.group(1), "name": x.group(1), "ref": x.group(2).strip()})
            elif m.group(2) == "interface" and x.group(2).startswith("("):
                end = close_of(x.group(2), 0)
                out.append({"fact": "iface_method", "owner": m.group(1), "name": x.group(1), "extra": f"({','.join(_types(x.group(2)[1:end]))})({','.join(_results(x.group(2), end + 1)[0])})"})
    return out
