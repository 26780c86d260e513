"""MATLAB by lines and keywords: classes, properties, functions, scripts.

Block ends are matched by keyword, so code that hides them (in eval strings, say) is read as written.
"""

from __future__ import annotations

import re

from lodegraph.sources.frontends.base import Facts, unique

_MASK = re.compile(rb"%\{[ \t]*\n.*?\n[ \t]*%\}|%[^\n]*|\.\.\.[^\n]*\n|\"(?:[^\"\n]|\"\")*\"|(?<![\w)\]}.'])'(?:[^'\n]|'')*'", re.S)
_WORD = re.compile(rb"(?<![.\w])(classdef|function|properties|methods|events|enumeration|if|for|while|switch|try|parfor|spmd|end)\b")
_FUNCTION = re.compile(rb"function[ \t]+(?:(?:\[[^\]]*\]|[A-Za-z]\w*)[ \t]*=[ \t]*)?([A-Za-z][\w.]*)[ \t]*(?:\(([^)]*)\))?")
_CLASS = re.compile(rb"classdef[ \t]*(?:\([^)]*\)[ \t]*)?([A-Za-z]\w*)(?:[ \t]*<[ \t]*([^\n]*))?")
_CALL = re.compile(rb"([A-Za-z]\w*(?:\.[A-Za-z]\w*)*)[ \t]*\(")
_IMPORT = re.compile(rb"^[ \t]*import[ \t]+([\w.*]+)", re.M)
_KEYWORDS = frozenset(b"if for while switch elseif case otherwise catch return parfor function end properties methods".split())


def _blank(m: re.Match) -> bytes:
    return bytes(10 if b == 10 else 32 for b in m.group())


def read(path: str, source: bytes) -> Facts:
    f = Facts("matlab", path, source)
    code = _MASK.sub(_blank, source)
    blocks, stack, depth_paren, last = [], [], 0, 0
    for m in _WORD.finditer(code):
        depth_paren += sum(1 if b in b"([{" else -1 if b in b")]}" else 0 for b in code[last : m.start()])
        last = m.start()
        if depth_paren > 0:
            continue  # an index's ``end``
        if m[1] == b"end":
            if stack:
                blocks.append((*stack.pop(), m.end()))
        else:
            if m[1] == b"function" and stack and stack[-1][0] == b"function" and not any(b[0] == b"classdef" for b in stack):
                blocks.append((*stack.pop(), m.start()))  # functions of a file that closes none
            stack.append((m[1], m.start()))
    closing = len(code.rstrip())
    blocks += [(*b, closing) for b in stack]
    blocks.sort(key=lambda b: b[1])
    callables, pending, classes = [], [], []
    for m in _IMPORT.finditer(code):
        f.refer("import", "imports", m[1].decode(), m.span(1), m.span(), source=None, target=None, confidence=0.7)
    for word, lo, hi in blocks:
        if word == b"classdef" and (m := _CLASS.match(code, lo)):
            name = m[1].decode()
            key = f.define("type", name, name, (lo, hi), m.span(1), meta={"declaration_kind": "class_definition"})
            classes.append((name, key, lo, hi))
            at = m.start(2) if m[2] else 0
            for base in (m[2] or b"").split(b"&"):
                text = base.strip()
                if text:
                    start = code.index(text, at)
                    f.refer("type_reference", "uses_type", text.decode(), (start, start + len(text)), (start, start + len(text)), source=key, target=None, confidence=0.5, meta={"reference_kind": "superclass"})
    types = unique((n, k) for n, k, _, _ in classes)
    owner_of = lambda lo: next(((n, k) for n, k, a, b in classes if a < lo < b), (None, None))
    for word, lo, hi in blocks:
        name, owner = owner_of(lo)
        if word == b"properties" and owner:
            first = code.index(b"\n", lo) if b"\n" in code[lo:hi] else hi
            for m in re.finditer(rb"^[ \t]*([A-Za-z]\w*)[^\n]*", code[first:hi], re.M):
                if m[1] != b"end":
                    a, b = first + m.start(1), first + m.end()
                    f.define("field", m[1].decode(), f"{name}.{m[1].decode()}", (a, a + len(code[a:b].rstrip())), (a, first + m.end(1)), meta={"declaration_kind": "property"}, owner=owner)
        elif word == b"function" and (m := _FUNCTION.match(code, lo)):
            if any(w == b"function" and a < lo < b for w, a, b in blocks):
                continue
            args = [a.strip().decode() for a in (m[2] or b"").split(b",") if a.strip()]
            scope = (name,) if name else ()
            short = m[1].decode()
            key = f.define("callable", short, ".".join((*scope, f"{short}({','.join(args)})")), (lo, hi), m.span(1), meta={"callable_kind": "method" if name else "function"}, owner=owner)
            callables.append(((scope, short, len(args)), key))
            pending.append((key, scope, m.end(), hi))
    index = unique(callables)
    for key, scope, lo, hi in pending:
        _calls(f, code, key, scope, lo, hi, index, types)
    if not f.rows["nodes"] and code.strip():  # a script
        _calls(f, code, None, (), 0, len(code), index, types)
    if not f.rows["chunks"] and source.strip():
        f.chunk(None, "source", (0, len(source)), {"fallback": True})
    return f


def _calls(f: Facts, code: bytes, key: str | None, scope: tuple, lo: int, hi: int, index: dict, types: dict) -> None:
    at = lo
    while m := _CALL.search(code, at, hi):
        at = m.end()
        text = m[1].decode()
        head = text.split(".")[0].encode()
        if head in _KEYWORDS:
            continue
        depth, end, commas, seen = 1, m.end(), 0, False
        while end < hi and depth:
            b = code[end : end + 1]
            depth += (b in (b"(", b"[", b"{")) - (b in (b")", b"]", b"}"))
            commas += b == b"," and depth == 1
            seen = seen or (depth > 0 and not b.isspace())
            end += 1
        n = commas + 1 if seen else 0
        found = None
        if "." not in text:
            found = index.get((scope, text, n + 1)) or index.get((scope, text, n)) or index.get(((), text, n))
        meta = {"argument_count": n, "call_kind": "call"}
        confidence = 0.35 if key is None else 0.75 if found else 0.45
        f.refer("call", "calls", text, m.span(1), (m.start(), end), source=key, target=found, confidence=confidence, meta=meta, edge_meta=meta | {"call_text": text})
        if key is not None and text in types:
            f.refer("type_reference", "uses_type", text, m.span(1), (m.start(), end), source=key, target=types[text], confidence=0.6, meta={"reference_kind": "constructor_call"})
        at = end
