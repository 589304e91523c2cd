"""Facts of JavaScript, TypeScript and Vue files: top-level functions, calls, imports, exports."""

from __future__ import annotations

import json
import re

from .lexer import Lines, blank, close_of, comment_before, depth_zero, described, digest, split_list

# Words before a bracket that are no calls, and compiler macros of Vue.
KEYWORDS = frozenset(("if", "for", "while", "switch", "catch", "function", "return", "typeof", "new"))
VUE_MACROS = frozenset(("defineProps", "defineEmits", "defineExpose", "defineOptions", "defineSlots", "defineModel", "withDefaults"))
MAX_CALLS = 80  # fixed value

_DECLARED = re.compile(r"\b(?:(export)\s+)?(default\s+)?(?:async\s+)?function\s*\*?\s*([A-Za-z_$][\w$]*)\s*(?:<[^>(]*>)?\(")
_ASSIGNED = re.compile(r"\b(?:(export)\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*(?::[^=;]+)?=\s*(?:async\s*)?(?:function\b[^(]*\(|(?:<[^>(]*>\s*)?\(|([A-Za-z_$][\w$]*)\s*=>)")
_CALL = re.compile(r"(?<![\w$.])((?:[A-Za-z_$][\w$]*\s*\.\s*)*[A-Za-z_$][\w$]*)\s*(?:<[^>()]*>)?\(")
_FROM = re.compile(r"\b(import|export)\s+(?:type\s+)?([^;'\"`()]*?)\s*\bfrom\s*(['\"])([^'\"\n]*)\3")
_BARE = re.compile(r"\bimport\s*(['\"])([^'\"\n]+)\1")
_DYNAMIC = re.compile(r"\b(import|require)\s*\(\s*(['\"])([^'\"\n]+)\2\s*\)")
_LOCAL = re.compile(r"\bexport\s*\{([^}]*)\}(?!\s*from)")
_SCRIPT = re.compile(r"<script\b([^>]*)>([\s\S]*?)</script>", re.I)


def _names(text: str) -> list[tuple[str, str]]:
    """(original, local) of a list like `a, b as c`."""
    out = []
    for part in split_list(text):
        a, _, b = part.replace("type ", "", 1).partition(" as ")
        out.append((a.strip(), (b or a).strip()))
    return out


def _bindings(clause: str) -> list[tuple[str, str]]:
    """(imported name, local name) of an import clause: default, * and names."""
    out = []
    if m := re.search(r"\{([^}]*)\}", clause):
        out += _names(m.group(1))
        clause = clause.replace(m.group(), "")
    if m := re.search(r"\*\s*as\s+([A-Za-z_$][\w$]*)", clause):
        out.append(("*", m.group(1)))
        clause = clause.replace(m.group(), "")
    if (d := clause.strip().strip(",").strip()) and re.fullmatch(r"[A-Za-z_$][\w$]*", d):
        out.append(("default", d))
    return out


def calls(code: str, skip: frozenset = frozenset()) -> list[tuple[str, int]]:
    """(dotted name, place) of calls, each name once."""
    seen: dict[str, int] = {}
    for m in _CALL.finditer(code):
        name = re.sub(r"\s", "", m.group(1))
        if name.split(".")[0] not in KEYWORDS and name not in skip and not re.search(r"\bfunction\s*\*?\s*$", code[: m.start()][-24:]):
            seen.setdefault(name, m.start())
    return list(seen.items())[:MAX_CALLS]


def facts(path: str, text: str, language: str = "typescript", first_line: int = 1, skip: frozenset = frozenset()) -> list[dict]:
    """Facts as rows: fact, name, ref, owner (symbol id), line_start, line_end, extra."""
    kind = "vue" if language == "vue" else language
    code, shown, lines, out, zero = blank(text), blank(text, strings=False), Lines(text), [], {}
    line = lambda at: lines.of(at) + first_line - 1
    spans, seen = [], set()
    for m in sorted([*_DECLARED.finditer(code), *_ASSIGNED.finditer(code)], key=lambda m: m.start()):
        if not depth_zero(code, m.start(), zero):
            continue
        declared = m.re is _DECLARED
        name = m.group(3) if declared else m.group(2)
        at = code.find("(", m.end() - 1) if code[m.end() - 1] == "(" else -1
        end = close_of(code, m.end() - 1) if at >= 0 else m.end()
        params = text[m.end() : end] if at >= 0 else m.group(3)
        if not declared and at >= 0 and "function" not in m.group() and not re.match(r"\s*(?::[^={]+)?=>", code[end + 1 :]):
            continue  # a bracket that is no parameter list
        brace = re.compile(r"\{|;|\n\s*\n").search(code, end)
        stop = close_of(code, brace.start()) if brace and brace.group() == "{" else (brace.start() if brace else len(code))
        sid = f"{kind}:{path}::{name}"
        if sid in seen:
            continue
        seen.add(sid)
        spans.append((m.start(), stop, sid))
        called = calls(code[end:stop], skip)
        names = split_list(params or "")
        doc = comment_before(text, m.start())
        semantic = json.dumps([name, names, [c for c, _ in called]])
        out.append({"fact": "symbol", "name": name, "ref": sid, "line_start": line(m.start()), "line_end": line(max(stop, m.start())), "extra": ",".join(names)[:400], "doc": doc or described(name, names, path, [c for c, _ in called]), "doc_source": "comment" if doc else "derived", "hash": digest(text[m.start() : stop + 1]), "meaning": digest(semantic)})
        if m.group(1):
            out.append({"fact": "export", "name": "default" if declared and m.group(2) else name, "ref": name})
        for c, _ in called:
            out.append({"fact": "call", "name": c.split(".")[-1], "ref": c, "owner": sid, "line_start": line(m.start())})
    if kind == "vue":
        rest = list(code)
        for a, b, _ in spans:
            rest[a:b] = " " * (b - a)
        out += [{"fact": "call", "name": c.split(".")[-1], "ref": c, "line_start": line(at)} for c, at in calls("".join(rest), skip)]
    for m in _FROM.finditer(shown):
        if not depth_zero(code, m.start(), zero):
            continue
        word, clause, target = m.group(1), m.group(2), m.group(4)
        if word == "import":
            out.append({"fact": "import", "ref": target, "line_start": line(m.start())})
            out += [{"fact": "binding", "name": local, "ref": target, "extra": name} for name, local in _bindings(clause)]
        elif clause.strip() == "*":
            out.append({"fact": "reexport_all", "ref": target, "line_start": line(m.start())})
        else:
            out += [{"fact": "reexport", "name": local, "ref": target, "extra": name, "line_start": line(m.start())} for name, local in _names(clause.strip().strip("{}"))]
    out += [{"fact": "import", "ref": m.group(2), "line_start": line(m.start())} for m in _BARE.finditer(shown)]
    for m in _DYNAMIC.finditer(shown):
        out.append({"fact": "dynamic_import" if m.group(1) == "import" else "import", "ref": m.group(3), "line_start": line(m.start())})
    for m in _LOCAL.finditer(code):
        out += [{"fact": "export", "name": local, "ref": name} for name, local in _names(m.group(1))]
    return out


def vue_facts(path: str, text: str) -> list[dict]:
    """Facts of all script blocks of a single-file component; macros are no calls, src= is an import."""
    out = []
    for m in _SCRIPT.finditer(re.sub(r"<!--[\s\S]*?-->", lambda c: re.sub(r"[^\n]", " ", c.group()), text)):
        first = text.count("\n", 0, m.start(2)) + 1
        if src := re.search(r"\bsrc\s*=\s*[\"']([^\"']+)", m.group(1)):
            out.append({"fact": "import", "ref": src.group(1), "line_start": first})
        out += facts(path, m.group(2), "vue", first, VUE_MACROS)
    names = [x["ref"] for x in out if x["fact"] == "symbol"]
    if len(names) != len(set(names)):
        raise ValueError(f"{path}: a symbol stands twice")
    return out
