"""What the language parsers share: comments and strings blanked in place, brackets matched, lines counted."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right

_TOKEN = re.compile(r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`")


def blank(text: str, strings: bool = True) -> str:
    """text of the same length with comments (and what strings hold) as spaces; newlines stay."""

    def hide(m: re.Match) -> str:
        t = m.group()
        if t[0] == "/":
            return re.sub(r"[^\n]", " ", t)
        return t[0] + re.sub(r"[^\n]", " ", t[1:-1]) + t[-1] if strings else t

    return _TOKEN.sub(hide, text)


def close_of(text: str, at: int) -> int:
    """Place of the bracket that closes the one at `at`; the end of the text if there is none."""
    pairs, depth = {"{": "}", "(": ")", "[": "]"}, 0
    a, b = text[at], pairs[text[at]]
    for m in re.compile(f"[{re.escape(a + b)}]").finditer(text, at):
        depth += 1 if m.group() == a else -1
        if not depth:
            return m.start()
    return len(text) - 1


_BLOCK = re.compile(r"/\*\*?([\s\S]*?)\*/\s*\Z")


def comment_before(text: str, at: int, reach: int = 800) -> str:
    """The comment that ends right in front of a place: a block, or lines of // that follow on each other; '' if there is none."""
    head = text[max(0, at - reach) : at]
    if m := _BLOCK.search(head[head.rfind("/*") :] if "/*" in head else ""):
        return " ".join(x.strip().lstrip("*").strip() for x in m.group(1).splitlines()).strip()
    lines = text[:at].rstrip(" \t").removesuffix("\n").split("\n") if at else []
    found = []
    while lines and (x := lines.pop().strip()).startswith("//"):
        found.append(x[2:].strip())
    return " ".join(reversed(found)).strip()


def described(name: str, params: list[str], path: str, calls: list[str]) -> str:
    """What is said of a symbol without a comment."""
    return f"{name}({', '.join(params)}) in {path}" + (f"; calls {', '.join(calls[:8])}." if calls else ".")


def digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


class Lines:
    def __init__(self, text: str) -> None:
        self.starts = [0, *[m.end() for m in re.finditer("\n", text)]]

    def of(self, at: int) -> int:
        return bisect_right(self.starts, at)


def depth_zero(code: str, at: int, cache: dict) -> bool:
    """Whether a place lies outside all braces."""
    if not cache:
        depth, marks = 0, []
        for m in re.finditer(r"[{}]", code):
            depth = max(0, depth + (1 if m.group() == "{" else -1))
            marks.append((m.start(), depth))
        cache["places"], cache["depths"] = [x for x, _ in marks], [d for _, d in marks]
    i = bisect_right(cache["places"], at) - 1
    return i < 0 or cache["depths"][i] == 0


def split_list(text: str) -> list[str]:
    """Parts at commas outside brackets."""
    out, depth, part = [], 0, ""
    for c in text:
        depth += c in "([{<"
        depth -= c in ")]}>"
        if c == "," and depth <= 0:
            out.append(part.strip())
            part = ""
        else:
            part += c
    return [p for p in [*out, part.strip()] if p]
