"""Python, over the standard library's syntax tree.

Nodes are top-level and class-level definitions and simple class-level assignments. Calls inside
another call's target or arguments aren't facts of their own.
"""

from __future__ import annotations

import ast

from lodegraph.sources.frontends.base import Facts, unique

_DEFS = (ast.FunctionDef, ast.AsyncFunctionDef)


class _Reader:
    def __init__(self, path: str, source: bytes):
        self.f = Facts("python", path, source)
        self.bom = 3 if source.startswith(b"\xef\xbb\xbf") else 0
        self.starts = [0, *(i + 1 for i, b in enumerate(source) if b == 10)]

    def offset(self, line: int, col: int) -> int:
        return self.starts[line - 1] + col + (self.bom if line == 1 else 0)

    def span(self, node) -> tuple[int, int]:
        return self.offset(node.lineno, node.col_offset), self.offset(node.end_lineno, node.end_col_offset)

    def find(self, name: str, lo: int, hi: int) -> tuple[int, int]:
        at = self.f.source.find(name.encode(), lo, hi)
        return (at, at + len(name.encode())) if at >= 0 else (lo, lo)

    def read(self) -> Facts:
        try:
            tree = ast.parse(self.f.source.decode("utf-8-sig"))
        except (SyntaxError, ValueError, RecursionError) as e:
            line = min(max(getattr(e, "lineno", None) or 1, 1), len(self.f.starts))
            start = self.f.starts[line - 1]
            self.f.problem((start, min(len(self.f.source), start + 1)), "Python parse error", "parse_error")
            return self.f
        self.callables = unique(((scope, d.name, len(_names(d.args))), self.f.key(_local(scope, d))) for scope, d in _definitions(tree.body, ()) if isinstance(d, _DEFS))
        self.types = unique((d.name, self.f.key(".".join((*scope, d.name)))) for scope, d in _definitions(tree.body, ()) if isinstance(d, ast.ClassDef))
        for node in tree.body:
            if isinstance(node, ast.Import | ast.ImportFrom):
                self.imports(node)
            elif isinstance(node, ast.ClassDef):
                self.type(node, (), None)
            elif isinstance(node, _DEFS):
                self.callable(node, (), None)
        return self.f

    def imports(self, node) -> None:
        lo, hi = self.span(node)
        if isinstance(node, ast.Import):
            targets = [(a.name, a.name, a.asname) for a in node.names]
        else:
            module = "." * node.level + (node.module or "")
            stars = any(a.name == "*" for a in node.names)
            join = lambda n: n if not module else module + n if module.endswith(".") else f"{module}.{n}"
            targets = [(module, module, None)] if stars else [(join(a.name), a.name, a.asname) for a in node.names]
        at = lo + (self.f.source[lo:hi].find(b"import") if isinstance(node, ast.ImportFrom) and targets[0][0] != targets[0][1] else 0)
        for text, shown, alias in targets:
            span = self.find(shown, at, hi)
            at = max(at, span[1])
            self.f.refer("import", "imports", text, span, (lo, hi), source=None, target=None, confidence=0.8, meta={"alias": alias})

    def whole(self, node) -> tuple[int, int]:
        return self.span(node)

    def named(self, node) -> tuple[int, int]:
        lo, hi = self.span(node)
        word = b"class" if isinstance(node, ast.ClassDef) else b"def"
        return self.find(node.name, self.f.source.find(word, lo, hi) + len(word), hi)

    def type(self, node: ast.ClassDef, scope: tuple[str, ...], owner: str | None) -> None:
        parts = (*scope, node.name)
        key = self.f.define("type", node.name, ".".join(parts), self.whole(node), self.named(node), meta={"declaration_kind": "class_definition"}, owner=owner)
        for base in [*node.bases, *node.keywords]:
            span = self.span(base)
            text = self.f.text(span)
            target = self.types.get(text)
            self.f.refer("type_reference", "uses_type", text, span, span, source=key, target=target, confidence=0.7 if target else 0.5, meta={"reference_kind": "base_class"})
        for child in node.body:
            if isinstance(child, _DEFS):
                self.callable(child, parts, key)
            elif isinstance(child, ast.ClassDef):
                self.type(child, parts, key)
            elif isinstance(child, ast.Assign | ast.AnnAssign):
                target = child.targets[0] if isinstance(child, ast.Assign) else child.target
                if isinstance(target, ast.Name):
                    self.f.define("field", target.id, ".".join((*parts, target.id)), self.span(child), self.span(target), confidence=0.9, meta={"declaration_kind": "class_assignment"}, owner=key)

    def callable(self, node, scope: tuple[str, ...], owner: str | None) -> None:
        kind = "async_function" if isinstance(node, ast.AsyncFunctionDef) else "function"
        key = self.f.define("callable", node.name, _local(scope, node), self.whole(node), self.named(node), meta={"callable_kind": kind}, owner=owner)
        for call in _calls([*node.args.defaults, *[d for d in node.args.kw_defaults if d], *node.body]):
            target = call.func
            if not isinstance(target, ast.Name | ast.Attribute):
                continue
            n = len(call.args) + len(call.keywords)
            span = self.span(target)
            text, simple = self.f.text(span), target.id if isinstance(target, ast.Name) else target.attr
            found = None
            if isinstance(target, ast.Name):
                found = self.callables.get((scope, simple, n)) or self.callables.get(((), simple, n))
            elif self.f.text(self.span(target.value)) == "self" and scope:
                found = self.callables.get((scope, simple, n + 1))
            meta = {"argument_count": n, "call_kind": "call"}
            whole = self.span(call)
            self.f.refer("call", "calls", text, span, whole, source=key, target=found, confidence=0.75 if found else 0.45, meta=meta, edge_meta=meta | {"call_text": text})
            if isinstance(target, ast.Name) and simple in self.types:
                self.f.refer("type_reference", "uses_type", simple, span, whole, source=key, target=self.types[simple], confidence=0.6, meta={"reference_kind": "constructor_call"})


def _definitions(body, scope):
    for d in body:
        if isinstance(d, _DEFS):
            yield scope, d
        elif isinstance(d, ast.ClassDef):
            yield scope, d
            yield from _definitions(d.body, (*scope, d.name))


def _names(a: ast.arguments) -> list[str]:
    plain = [x.arg for x in (*a.posonlyargs, *a.args)] + ([f"*{a.vararg.arg}"] if a.vararg else []) + [x.arg for x in a.kwonlyargs]
    return plain + ([f"**{a.kwarg.arg}"] if a.kwarg else [])


def _local(scope: tuple[str, ...], d) -> str:
    return ".".join((*scope, f"{d.name}({','.join(_names(d.args))})"))


def _calls(nodes):
    for node in nodes:
        if isinstance(node, ast.Call):
            yield node
        elif not isinstance(node, (ast.ClassDef, *_DEFS)):
            yield from _calls(ast.iter_child_nodes(node))


def read(path: str, source: bytes) -> Facts:
    return _Reader(path, source).read()
