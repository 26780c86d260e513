"""Facts that a language's frontend reads from one file, as plain rows."""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Callable

FACTS = ("nodes", "edges", "occurrences", "chunks", "diagnostics")


class Facts:
    """Collects the facts of one file. Spans are byte offsets, end exclusive; lines are counted from 1."""

    def __init__(self, language: str, path: str, source: bytes):
        self.language, self.path, self.source = language, path, source
        self.extractor = f"{language}-frontend"
        self.starts = [0, *(i + 1 for i, b in enumerate(source) if b == 10 and i + 1 < len(source))]
        self.rows: dict[str, list[dict]] = {k: [] for k in FACTS}

    def key(self, local: str) -> str:
        return f"{self.language}:{self.path}#{local}"

    def text(self, span: tuple[int, int]) -> str:
        return self.source[span[0] : span[1]].decode("utf-8", "replace")

    def line(self, offset: int) -> int:
        return bisect_right(self.starts, offset)

    def place(self, span: tuple[int, int]) -> dict:
        start, end = span
        return {"start_byte": start, "end_byte": end, "start_line": self.line(start), "end_line": self.line(max(start, end - 1))}

    def add(self, table: str, span: tuple[int, int] | None, **fact) -> None:
        meta = {k: v for k, v in (fact.pop("meta", None) or {}).items()}
        row = {"extractor": self.extractor, "metadata_json": json.dumps(meta, sort_keys=True, separators=(",", ":"))} | fact
        self.rows[table].append(row | (self.place(span) if span else {}))

    def define(self, kind: str, name: str, local: str, span: tuple[int, int], name_span: tuple[int, int], *, chunk: tuple[int, int] | None = None, qualified: str | None = None, confidence: float = 1.0, meta: dict | None = None, owner: str | None = None) -> str:
        """A node with its definition occurrence, its chunk and, below an owner, the edge that contains it."""
        key = self.key(local)
        self.add("nodes", span, kind=kind, language=self.language, name=name, qualified_name=qualified or local, symbol_key=key, confidence=confidence, meta=meta)
        self.add("occurrences", name_span, role="definition", text=self.text(name_span), node_key=key, resolved_key=key, confidence=1.0, meta={"node_kind": kind})
        self.chunk(key, "definition", chunk or span, {"node_kind": kind})
        if owner is not None:
            self.edge("contains", span, src=owner, dst=key, confidence=1.0)
        return key

    def chunk(self, key: str | None, kind: str, span: tuple[int, int], meta: dict) -> None:
        text = self.text(span)
        self.add("chunks", span, node_key=key, kind=kind, text=text, token_estimate=(len(text) + 3) // 4, meta=meta)

    def edge(self, kind: str, span: tuple[int, int], *, src: str | None = None, dst: str | None = None, unresolved_src: str | None = None, unresolved_dst: str | None = None, confidence: float = 1.0, meta: dict | None = None) -> None:
        self.add("edges", span, kind=kind, src_key=src, dst_key=dst, unresolved_src=unresolved_src, unresolved_dst=unresolved_dst, confidence=confidence, weight=1.0, meta=meta)

    def refer(self, role: str, edge: str, text: str, span: tuple[int, int], edge_span: tuple[int, int], *, source: str | None, target: str | None, confidence: float, meta: dict | None = None, edge_meta: dict | None = None) -> None:
        """An occurrence of ``text`` and the edge it stands for, to ``target`` or unresolved."""
        self.add("occurrences", span, role=role, text=text, node_key=source, resolved_key=target, confidence=confidence, meta=meta)
        self.edge(edge, edge_span, src=source, dst=target, unresolved_src=None if source else self.path, unresolved_dst=None if target else text, confidence=confidence, meta=edge_meta if edge_meta is not None else meta)

    def problem(self, span: tuple[int, int] | None, message: str, code: str) -> None:
        self.add("diagnostics", span, severity="error", message=message, code=code)

    def to_json(self) -> str:
        return json.dumps(self.rows, separators=(",", ":"), ensure_ascii=False)


Frontend = Callable[[str, bytes], Facts]


def unique(pairs) -> dict:
    """Keys that were given exactly one value."""
    held: dict = {}
    for k, v in pairs:
        held.setdefault(k, []).append(v)
    return {k: v[0] for k, v in held.items() if len(v) == 1}
