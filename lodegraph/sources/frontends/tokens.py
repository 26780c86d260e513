"""Tokens of languages with brackets, and what can be told from them: matching brackets, lists, calls."""

from __future__ import annotations

import re
from dataclasses import dataclass

_COMMON = r"""(?P<skip>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<str>{strings})|(?P<id>[^\W\d]\w*{mark})|(?P<num>\d[\w.]*)|(?P<op>::|->|=>|\.\.\.|==|<=|>=|!=|&&|\|\||[^\s\w])"""
_STRINGS = {
    "java": r'"""(?:\\.|[^\\])*?"""|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'',
    "cpp": r'R"(?P<d>[^()\s]{0,16})\(.*?\)(?P=d)"|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'',
    "go": r'`[^`]*`|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'',
    "rust": r'b?r(?P<h>#*)".*?"(?P=h)|b?"(?:\\.|[^"\\])*"|b?\'(?:\\[^\']+|[^\'\\])\'|\'[^\W\d]\w*',
}
_PAIRS = {"(": ")", "[": "]", "{": "}"}


@dataclass(frozen=True)
class Token:
    text: str
    start: int
    end: int
    kind: str


class Tokens:
    """Significant tokens of a source with byte offsets. ``pair[i]`` is the partner of the bracket at i; ``broken`` the first one without."""

    def __init__(self, language: str, source: bytes):
        text = source.decode("utf-8", "replace")
        offsets = None if len(text) == len(source) else [0]
        if offsets is not None:
            for c in text:
                offsets.append(offsets[-1] + len(c.encode()))
        at = (lambda i: i) if offsets is None else offsets.__getitem__
        pattern = re.compile(_COMMON.format(strings=_STRINGS[language], mark="!?" if language == "rust" else ""), re.S)
        self.all: list[Token] = []
        for m in pattern.finditer(text):
            if m.lastgroup == "skip" or m["skip"] is not None:
                continue
            kind = "str" if m["str"] is not None else "id" if m["id"] is not None else "num" if m["num"] is not None else "op"
            word = m.group()
            if kind == "id" and word.endswith("!") and text[m.end() : m.end() + 1] == "=":
                word = word[:-1]  # a != b
                self.all.append(Token(word, at(m.start()), at(m.end() - 1), "id"))
                self.all.append(Token("!", at(m.end() - 1), at(m.end()), "op"))
                continue
            self.all.append(Token(word, at(m.start()), at(m.end()), kind))
        self.pair: dict[int, int] = {}
        self.broken: int | None = None
        open_: list[int] = []
        for i, t in enumerate(self.all):
            if t.kind != "op":
                continue
            if t.text in _PAIRS:
                open_.append(i)
            elif t.text in _PAIRS.values():
                if open_ and _PAIRS[self.all[open_[-1]].text] == t.text:
                    j = open_.pop()
                    self.pair[j], self.pair[i] = i, j
                elif self.broken is None:
                    self.broken = i
        if open_ and self.broken is None:
            self.broken = open_[0]
        for i in open_:
            self.pair[i] = len(self.all) - 1

    def __len__(self) -> int:
        return len(self.all)

    def text(self, i: int) -> str:
        return self.all[i].text if 0 <= i < len(self.all) else ""

    def is_name(self, i: int) -> bool:
        return 0 <= i < len(self.all) and self.all[i].kind == "id"

    def span(self, lo: int, hi: int) -> tuple[int, int]:
        """Bytes from token lo to token hi, inclusive."""
        return self.all[lo].start, self.all[hi].end

    def skip(self, i: int) -> int:
        """The token after i, or after the bracket pair that opens at i."""
        return self.pair[i] + 1 if self.text(i) in _PAIRS and i in self.pair else i + 1

    def angle(self, i: int) -> int:
        """The token after the angle brackets that open at i, or i itself if they don't close as types do."""
        depth, j = 0, i
        while j < len(self.all) and j < i + 200:
            t = self.text(j)
            if t == "<":
                depth += 1
            elif t == ">":
                depth -= 1
                if not depth:
                    return j + 1
            elif t in (";", "{", "}", "&&", "||") or self.all[j].kind == "str":
                return i
            j = self.skip(j) if t in ("(", "[") else j + 1
        return i

    def pieces(self, lo: int, hi: int, comma: str = ",") -> list[tuple[int, int]]:
        """(first, last) of the comma-separated pieces of the tokens from lo up to hi, hi excluded."""
        out, start, i = [], lo, lo
        while i < hi:
            if self.text(i) == comma:
                if i > start:
                    out.append((start, i - 1))
                start = i = i + 1
                continue
            i = max(self.angle(i), i + 1) if self.text(i) == "<" else self.skip(i)
        if hi > start:
            out.append((start, hi - 1))
        return out


@dataclass(frozen=True)
class Call:
    first: int  # where the expression begins
    name: int  # the called name
    paren: int  # its opening parenthesis
    last: int
    receiver: tuple[int, int] | None
    made: bool  # an object creation


def calls(t: Tokens, lo: int, hi: int, keywords: frozenset[str], joints: tuple[str, ...]):
    """Outermost calls among tokens lo to hi; what stands in a call's arguments or before its last name isn't looked at."""
    i = lo
    while i < hi:
        if not t.is_name(i) or (t.text(i) in keywords and t.text(i) not in ("new", "this", "self", "super")):
            i += 1
            continue
        first, j, found, name, made = i, i, None, i, False
        if t.text(i) == "new" and t.is_name(i + 1):
            j, made = i + 1, True
            while t.text(j + 1) in (".", "::") and t.is_name(j + 2):
                j += 2
            name = j
            if t.text(j + 1) == "<":
                j = t.angle(j + 1) - 1
            if t.text(j + 1) == "(":
                found, j = Call(first, i + 1, j + 1, t.pair.get(j + 1, hi), None, True), t.pair.get(j + 1, hi)
            if t.text(j + 1) == "{":  # an anonymous body
                j = t.pair.get(j + 1, hi)
        while j < hi:
            nxt = t.text(j + 1)
            if nxt in joints and t.is_name(j + 2):
                name, j, made = j + 2, j + 2, False
            elif nxt in joints and t.text(j + 2) == "<":
                j = max(t.angle(j + 2) - 1, j + 2)
            elif nxt == "<" and t.text(t.angle(j + 1)) == "(" and t.angle(j + 1) > j + 1:
                j = t.angle(j + 1) - 1
            elif nxt == "(" and not (made and found):
                end = t.pair.get(j + 1, hi)
                found = Call(first, name, j + 1, end, (first, name - 2) if name > first + 1 else None, False)
                j = end
            elif nxt == "[":
                j = t.pair.get(j + 1, hi)
            else:
                break
        if found:
            yield found
        i = j + 1
