"""Java, C++, Go and Rust over bracketed tokens.

These read declarations and calls without a full grammar, so malformed input yields one diagnostic a
file instead of one a broken node, and code that a preprocessor or macro makes is read as written.
"""

from __future__ import annotations

from lodegraph.sources.frontends.base import Facts, unique
from lodegraph.sources.frontends.tokens import Call, Tokens, calls

_JAVA_WORDS = frozenset("if for while switch catch return new synchronized try do else throw assert case default class interface enum record instanceof this super".split())
_CPP_WORDS = frozenset("if for while switch catch return new delete sizeof throw do else case default alignof decltype static_cast dynamic_cast const_cast reinterpret_cast noexcept operator this".split())
_GO_WORDS = frozenset("if for switch return go defer select case func range else type struct interface map chan var const import package".split())
_RUST_WORDS = frozenset("if for while match return loop else let fn impl struct enum trait mod use where in move unsafe as self super crate".split())
_PRIMITIVE = {
    "java": frozenset("boolean byte char double float int long short void var String Object".split()),
    "go": frozenset("any bool byte comparable complex64 complex128 error float32 float64 int int8 int16 int32 int64 rune string uint uint8 uint16 uint32 uint64 uintptr".split()),
    "rust": frozenset("bool char f32 f64 i8 i16 i32 i64 i128 isize str u8 u16 u32 u64 u128 usize Self String".split()),
    "cpp": frozenset("auto bool char double float int long short signed unsigned void size_t string".split()),
}


_SPECIFIERS = frozenset("& * mut const [ ] final dyn impl explicit virtual static inline constexpr extern volatile typename struct class".split())


class _Reader:
    language = ""
    words: frozenset[str] = frozenset()
    joints: tuple[str, ...] = (".",)

    def __init__(self, path: str, source: bytes):
        self.f, self.t = Facts(self.language, path, source), Tokens(self.language, source)
        self.pending: list[tuple] = []
        self.arity: list[tuple] = []
        self.fields: dict[tuple, str] = {}
        self.types: list[tuple[str, str]] = []

    def read(self) -> Facts:
        if self.t.broken is not None:
            tok = self.t.all[self.t.broken]
            self.f.problem((tok.start, tok.end), f"{self.language} parse error", "parse_error")
        self.top()
        self.callables, self.type_keys = unique(self.arity), unique(self.types)
        for key, scope, lo, hi, receiver in self.pending:
            self.body(key, scope, lo, hi, receiver)
        return self.f

    def joined(self, lo: int, hi: int) -> str:
        """Tokens as text, with a space only between two words."""
        out = ""
        for i in range(lo, hi + 1):
            x = self.t.text(i)
            out += (" " if out and out[-1].isalnum() and x[:1].isalnum() else "") + x
        return out

    def arguments(self, c: Call) -> int:
        return len(self.t.pieces(c.paren + 1, c.last))

    def is_call(self, c: Call) -> bool:
        return True

    def resolve(self, scope: tuple, c: Call, n: int, receiver: str | None) -> str | None:
        raise NotImplementedError

    def body(self, key: str, scope: tuple, lo: int, hi: int, receiver: str | None) -> None:
        for c in calls(self.t, lo, hi, self.words, self.joints):
            if not self.is_call(c):
                continue
            n = self.arguments(c)
            lead = c.name if c.receiver and self.joined(*c.receiver) == "this" else c.first if not c.made else c.name
            span = self.t.span(lead, c.paren - 1) if not c.made else self.t.span(c.name, c.paren - 1)
            text = self.f.text(span)
            macro = text.endswith("!")
            found = None if macro or c.made else self.resolve(scope, c, n, receiver)
            n = 0 if macro else n
            kind = "macro" if macro else "object_creation" if c.made else "call"
            meta = {"argument_count": n, "call_kind": kind}
            self.f.refer("call", "calls", text, span, self.t.span(c.first, min(c.last, len(self.t) - 1)), source=key, target=found, confidence=0.75 if found else 0.35 if macro else 0.45, meta=meta, edge_meta=meta | {"call_text": text})

    def use_type(self, key: str, lo: int, hi: int, kind: str, resolved: bool = True) -> None:
        while lo < hi and self.t.text(lo) in _SPECIFIERS or self.t.text(lo).startswith("'"):
            lo += 1
        end = lo
        while end + 2 <= hi and self.t.text(end + 1) in (".", "::") and self.t.is_name(end + 2):
            end += 2
        if lo > hi or not self.t.is_name(lo) or self.t.text(lo) in _SPECIFIERS:
            return
        text = self.joined(lo, end)
        if text in _PRIMITIVE[self.language]:
            return
        target = self.type_now.get(text) if resolved else None
        span = self.t.span(lo, end)
        self.f.refer("type_reference", "uses_type", text, span, span, source=key, target=target, confidence=0.7 if target else 0.5, meta={"reference_kind": kind})

    @property
    def type_now(self) -> dict:
        return unique(self.types)

    def import_(self, text: str, span: tuple[int, int], whole: tuple[int, int], role: str = "import", edge: str = "imports", meta: dict | None = None) -> None:
        self.f.refer(role, edge, text, span, whole, source=None, target=None, confidence=0.8, meta=meta)


class Java(_Reader):
    language, words, joints = "java", _JAVA_WORDS, (".",)

    def top(self) -> None:
        t, i, self.package = self.t, 0, ""
        while i < len(t):
            w = t.text(i)
            if w in ("package", "import"):
                j = i
                while j < len(t) and t.text(j) != ";":
                    j += 1
                first = i + 2 if t.text(i + 1) == "static" else i + 1
                if first < j:
                    text = self.joined(first, j - 1)
                    if w == "package":
                        self.package = text
                    else:
                        self.import_(text, t.span(first, j - 1), t.span(i, min(j, len(t) - 1)), meta={"static": first == i + 2})
                i = j + 1
                continue
            start = i
            while i < len(t) and t.text(i) not in ("class", "interface", "enum", "record", ";", "{"):
                i = t.skip(i)
            if t.text(i) in ("class", "interface", "enum", "record") and t.is_name(i + 1):
                i = self.type(start, i, ()) + 1
            else:
                i = t.skip(i)

    def _modifiers(self, i: int) -> int:
        t = self.t
        while t.text(i) == "@" and t.text(i + 1) != "interface" or t.text(i) in ("public", "protected", "private", "static", "final", "abstract", "synchronized", "native", "default", "transient", "volatile", "strictfp", "sealed"):
            if t.text(i) == "@":
                i += 2
                while t.text(i) == "." and t.is_name(i + 1):
                    i += 2
                i = t.skip(i) if t.text(i) == "(" else i
            else:
                i += 1
        return i

    def type(self, start: int, at: int, parents: tuple[str, ...]) -> int:
        """A type whose keyword is at ``at``; gives its last token."""
        t = self.t
        name = t.text(at + 1)
        parts = (*parents, name)
        local = ".".join(parts)
        i = at + 2
        while i < len(t) and t.text(i) != "{":
            i = t.skip(i)
        if i >= len(t):
            return len(t) - 1
        end = t.pair[i]
        key = self.f.define("type", name, local, t.span(start, end), t.span(at + 1, at + 1), qualified=f"{self.package}.{local}" if self.package else local, meta={"declaration_kind": f"{t.text(at)}_declaration", "package": self.package}, owner=self.f.key(".".join(parents)) if parents else None)
        self.types.append((name, key))
        j = i + 1
        if t.text(at) == "enum":
            while j < end and t.text(j) != ";":
                j = t.skip(j)
        while j < end:
            j = self.member(j, end, parts, key)
        return end

    def member(self, start: int, end: int, parts: tuple[str, ...], owner: str) -> int:
        t = self.t
        i = self._modifiers(start)
        if t.text(i) in ("class", "interface", "enum") and t.is_name(i + 1) or t.text(i) == "record" and t.is_name(i + 1) and t.text(i + 2) in ("(", "<"):
            return self.type(start, i, parts) + 1
        if t.text(i) in (";", "{"):
            return t.skip(i)
        if t.text(i) == "<":
            i = max(t.angle(i), i + 1)
        j, paren = i, None
        while j < end and t.text(j) not in (";", "{", "="):
            if t.text(j) == "(" and t.is_name(j - 1) and paren is None:
                paren = j
            j = max(t.angle(j), j + 1) if t.text(j) == "<" else t.skip(j)
        if paren is not None and t.text(j) != "=":
            last = t.pair[j] if t.text(j) == "{" else j
            params = t.pieces(paren + 1, t.pair[paren])
            spans = []
            for lo, hi in params:
                lo = self._modifiers(lo)
                spread = any(t.text(k) == "..." for k in range(lo, hi))
                top = hi - 1 - spread
                spans.append((lo, top, self.joined(lo, top) + ("..." if spread else "")))
            name = t.text(paren - 1)
            made = paren - 1 == i
            local = ".".join((*parts, f"{'<init>' if made else name}({','.join(s[2] for s in spans)})"))
            key = self.f.define("callable", name, local, t.span(start, min(last, len(t) - 1)), t.span(paren - 1, paren - 1), qualified=f"{self.package}.{local}" if self.package else local, meta={"callable_kind": "constructor_declaration" if made else "method_declaration"}, owner=owner)
            if not made:
                self.arity.append(((parts, name, len(params)), key))
                self.use_type(key, i, paren - 2, "return_or_parameter", False)
            for lo, hi, _ in spans:
                self.use_type(key, lo, hi, "return_or_parameter", False)
            if t.text(j) == "{":
                self.pending.append((key, parts, j + 1, last, None))
            return last + 1
        names_end = j
        while j < end and t.text(j) != ";":
            j = t.skip(j)
        k = names_end - 1
        if names_end > i and t.is_name(k):
            local = ".".join((*parts, t.text(k)))
            key = self.f.define("field", t.text(k), local, t.span(start, min(j, end)), t.span(k, k), qualified=f"{self.package}.{local}" if self.package else local, meta={"declaration_kind": "field_declaration"}, owner=owner)
            self.fields[parts, t.text(k)] = key
            self.use_type(key, i, k - 1, "field_type", False)
        return j + 1

    def resolve(self, scope, c, n, receiver):
        if c.receiver and self.joined(*c.receiver) != "this":
            return None
        return self.callables.get((scope, self.t.text(c.name), n))

    def body(self, key, scope, lo, hi, receiver) -> None:
        super().body(key, scope, lo, hi, receiver)
        t = self.t
        inside = lo
        for i in range(lo, hi):
            if t.text(i) == "new" and t.is_name(i + 1) and i >= inside:  # one made in another's arguments isn't looked at
                self.use_type(key, i + 1, i + 1, "body", False)
                end = max(t.angle(i + 2), i + 2) if t.text(i + 2) == "<" else i + 2
                inside = t.pair.get(end, i) if t.text(end) == "(" else i
            if t.text(i) == "." and t.is_name(i + 1) and t.text(i + 2) != "(" and (t.is_name(i - 1) or t.text(i - 1) in (")", "]")):
                name = t.text(i + 1)
                found = self.fields.get((scope, name)) if t.text(i - 1) == "this" else None
                self.f.refer("field_reference", "references", name, t.span(i + 1, i + 1), t.span(i - 1, i + 1), source=key, target=found, confidence=0.6 if found else 0.4, meta={"reference_kind": "field_access"})


class Go(_Reader):
    language, words, joints = "go", _GO_WORDS, (".",)

    def top(self) -> None:
        t, i, self.package = self.t, 0, None
        while i < len(t):
            w = t.text(i)
            if w == "package" and t.is_name(i + 1):
                self.package = self.f.define("namespace", t.text(i + 1), t.text(i + 1), t.span(i, i + 1), t.span(i + 1, i + 1), meta={"declaration_kind": "package_clause"})
                i += 2
            elif w == "import":
                end = t.pair[i + 1] if t.text(i + 1) == "(" else None
                j = i + 2 if end else i + 1
                while j < len(t) and (j < end if end else j <= i + 2):
                    if t.all[j].kind == "str":
                        alias = t.text(j - 1) if t.is_name(j - 1) and t.text(j - 1) != "import" or t.text(j - 1) in ("_", ".") else None
                        first = j - 1 if alias else j
                        self.import_(t.text(j).strip('"`'), t.span(j, j), t.span(first, j), meta={"alias": alias})
                        if not end:
                            break
                    j += 1
                i = (end or j) + 1
            elif w == "type":
                if t.text(i + 1) == "(":
                    for lo, hi in self._specs(i + 2, t.pair[i + 1]):
                        self.type(lo, lo, hi)
                    i = t.pair[i + 1] + 1
                else:
                    j = i + 2
                    while j < len(t) and t.text(j) not in ("{",) and self.f.line(t.all[j].start) == self.f.line(t.all[i].start):
                        j += 1
                    end = t.pair[j] if j < len(t) and t.text(j) == "{" else j - 1
                    self.type(i, i + 1, end)
                    i = end + 1
            elif w == "func":
                i = self.func(i)
            else:
                i = t.skip(i)

    def _specs(self, lo: int, hi: int):
        t, i = self.t, lo
        while i < hi:
            j = i
            while j < hi and self.f.line(t.all[j].start) == self.f.line(t.all[i].start):
                j = t.skip(j)
            yield i, j - 1
            i = j

    def type(self, start: int, at: int, end: int) -> None:
        t = self.t
        name = t.text(at)
        key = self.f.define("type", name, name, t.span(start, end), t.span(at, at), meta={"declaration_kind": "type_spec"}, owner=self.package)
        self.types.append((name, key))
        if t.text(at + 1) == "struct" and t.text(at + 2) == "{":
            for lo, hi in self._specs(at + 3, t.pair[at + 2]):
                embedded = hi == lo or t.text(lo) == "*" or t.text(lo + 1) == "."
                k = hi if embedded else lo
                if t.is_name(k):
                    fkey = self.f.define("field", t.text(k), f"{name}.{t.text(k)}", t.span(lo, hi), t.span(k, k), meta={"declaration_kind": "field_declaration"}, owner=key)
                    self.use_type(fkey, lo if embedded else lo + 1, hi, "field_type")

    def _params(self, lo: int, hi: int) -> list[tuple[int, int]]:
        """Type tokens of every parameter; names that share a type repeat it."""
        parts, out = self.t.pieces(lo, hi), []
        named = any(b > a and self.t.is_name(a) and self.t.text(a + 1) not in (".",) for a, b in parts)
        held = 0
        for a, b in parts:
            if named and b == a:
                held += 1
                continue
            span = (a + 1, b) if named else (a, b)
            out += [span] * (held + 1)
            held = 0
        return out + [(a, b) for a, b in parts[len(parts) - held :]] if held else out

    def func(self, i: int) -> int:
        t, j, receiver, scope = self.t, i + 1, None, ()
        if t.text(j) == "(":
            inner = range(j + 1, t.pair[j])
            names = [k for k in inner if t.is_name(k)]
            if names:
                receiver = t.text(names[0]) if len(names) > 1 else None
                scope = (t.text(names[1] if len(names) > 1 else names[0]),)
            j = t.pair[j] + 1
        if not t.is_name(j):
            return j + 1
        name, at = t.text(j), j
        j = t.pair[j + 1] + 1 if t.text(j + 1) == "[" else j + 1
        if t.text(j) != "(":
            return j + 1
        params = self._params(j + 1, t.pair[j])
        k = t.pair[j] + 1
        while k < len(t) and t.text(k) != "{" and self.f.line(t.all[k].start) == self.f.line(t.all[t.pair[j]].start):
            k = t.skip(k)
        end = t.pair[k] if t.text(k) == "{" else k - 1
        local = ".".join((*scope, f"{name}({','.join(self.joined(*p) for p in params)})"))
        owner = self.f.key(scope[0]) if scope else self.package
        key = self.f.define("callable", name, local, t.span(i, end), t.span(at, at), meta={"callable_kind": "method" if scope else "function"}, owner=owner)
        self.arity.append(((scope, name, len(params)), key))
        for p in dict.fromkeys(params):
            self.use_type(key, *p, "parameter")
        for lo, hi in t.pieces(t.pair[j] + 2, t.pair[t.pair[j] + 1]) if t.text(t.pair[j] + 1) == "(" else [(t.pair[j] + 1, k - 1)]:
            if hi >= lo:
                self.use_type(key, lo, hi, "result")
        if t.text(k) == "{":
            self.pending.append((key, scope, k + 1, end, receiver))
        return end + 1

    def resolve(self, scope, c, n, receiver):
        name = self.t.text(c.name)
        if c.receiver:
            return self.callables.get((scope, name, n)) if receiver and self.joined(*c.receiver) == receiver else None
        return self.callables.get((scope, name, n)) or self.callables.get(((), name, n))


class Rust(_Reader):
    language, words, joints = "rust", _RUST_WORDS, (".", "::")

    def top(self) -> None:
        self.items(0, len(self.t), (), None)

    def items(self, i: int, hi: int, scope: tuple[str, ...], owner: str | None) -> None:
        t = self.t
        while i < hi:
            start = i
            while t.text(i) == "#" and t.text(i + 1) in ("[", "!"):
                i = t.skip(i + 1 if t.text(i + 1) == "[" else i + 2)
            while t.text(i) in ("pub", "async", "unsafe", "const", "extern", "default") and i < hi and t.text(i + 1) not in ("=",):
                i = t.skip(i + 1) if t.text(i) == "pub" and t.text(i + 1) == "(" else i + 1
                if i < hi and t.all[i].kind == "str":
                    i += 1
            w = t.text(i)
            if w == "use":
                j = i
                while j < hi and t.text(j) != ";":
                    j = t.skip(j)
                if j > i + 1:
                    self.import_(self.joined(i + 1, j - 1), t.span(i + 1, j - 1), t.span(start, min(j, hi - 1)))
                i = j + 1
            elif w in ("struct", "enum", "trait", "union") and t.is_name(i + 1):
                i = self.type(start, i)
            elif w == "impl":
                j = i + 1
                j = max(t.angle(j), j) if t.text(j) == "<" else j
                name = None
                while j < hi and t.text(j) != "{":
                    if t.text(j) == "for":
                        name = None
                    elif t.text(j) == "where":
                        while j < hi and t.text(j) != "{":
                            j = t.skip(j)
                        break
                    elif t.is_name(j):
                        name = t.text(j)
                    j = max(t.angle(j), j + 1) if t.text(j) == "<" else t.skip(j)
                if j < hi and name:
                    self.items(j + 1, t.pair[j], (name,), self.f.key(name))
                i = t.skip(j)
            elif w == "mod" and t.is_name(i + 1):
                if t.text(i + 2) == "{":
                    self.f.define("namespace", t.text(i + 1), t.text(i + 1), t.span(start, t.pair[i + 2]), t.span(i + 1, i + 1), meta={"declaration_kind": "mod_item"})
                    self.items(i + 3, t.pair[i + 2], (), None)
                    i = t.pair[i + 2] + 1
                else:
                    i += 3
            elif w == "fn" and t.is_name(i + 1):
                i = self.func(start, i, scope, owner)
            else:
                i = t.skip(i) if i > start or t.text(i) in ("(", "[", "{") else i + 1

    def type(self, start: int, at: int) -> int:
        t, name = self.t, self.t.text(at + 1)
        j = at + 2
        j = max(t.angle(j), j) if t.text(j) == "<" else j
        while j < len(t) and t.text(j) not in ("{", ";", "("):
            j += 1
        end = t.pair.get(j, j)
        if t.text(j) == "(" and t.text(end + 1) == ";":
            end += 1
        end = min(end, len(t) - 1)
        key = self.f.define("type", name, name, t.span(start, end), t.span(at + 1, at + 1), meta={"declaration_kind": f"{t.text(at)}_item"})
        self.types.append((name, key))
        if t.text(at) == "trait" and t.text(j) == "{":
            self.items(j + 1, t.pair[j], (name,), key)
        elif t.text(j) in ("{", "("):
            for n, (lo, hi) in enumerate(t.pieces(j + 1, t.pair[j])):
                while t.text(lo) == "#":
                    lo = t.skip(lo + 1)
                lo = t.skip(lo + 1) if t.text(lo) == "pub" and t.text(lo + 1) == "(" else lo + 1 if t.text(lo) == "pub" else lo
                named = t.text(j) == "{"
                label = t.text(lo) if named else str(n)
                fkey = self.f.define("field", label, f"{name}.{label}", t.span(lo, hi), t.span(lo, lo), meta={"declaration_kind": "enum_variant" if t.text(at) == "enum" else "field_declaration"}, owner=key)
                if t.text(at) != "enum" and hi >= (lo + 2 if named else lo):
                    self.use_type(fkey, lo + 2 if named else lo, hi, "field_type")
        return end + 1

    def func(self, start: int, at: int, scope: tuple[str, ...], owner: str | None) -> int:
        t, j = self.t, at + 2
        j = max(t.angle(j), j) if t.text(j) == "<" else j
        if t.text(j) != "(":
            return j + 1
        texts, uses = [], []
        for lo, hi in t.pieces(j + 1, t.pair[j]):
            colon = next((k for k in range(lo, hi) if t.text(k) == ":"), None)
            texts.append(self.joined(colon + 1, hi) if colon is not None else self.joined(lo, hi))
            if colon is not None:
                uses.append((colon + 1, hi))
        k = t.pair[j] + 1
        result = (k + 1) if t.text(k) == "->" else None
        while k < len(t) and t.text(k) not in ("{", ";"):
            k = t.skip(k)
        end = min(t.pair.get(k, k), len(t) - 1)
        name = t.text(at + 1)
        key = self.f.define("callable", name, ".".join((*scope, f"{name}({','.join(texts)})")), t.span(start, end), t.span(at + 1, at + 1), meta={"callable_kind": "function_item", "owner": scope[0] if scope else None}, owner=owner)
        self.arity.append(((scope, name, len(texts)), key))
        for lo, hi in uses:
            self.use_type(key, lo, hi, "parameter")
        if result is not None and result < k:
            self.use_type(key, result, k - 1, "return")
        if t.text(k) == "{":
            self.pending.append((key, scope, k + 1, end, "self"))
        return end + 1

    def resolve(self, scope, c, n, receiver):
        name = self.t.text(c.name)
        if c.receiver:
            return self.callables.get((scope, name, n + 1)) if self.joined(*c.receiver) == "self" else None
        return self.callables.get((scope, name, n)) or self.callables.get(((), name, n))


class Cpp(_Reader):
    language, words, joints = "cpp", _CPP_WORDS, (".", "->", "::")

    def top(self) -> None:
        t = self.t
        for i in range(len(t)):  # includes, wherever they stand
            if t.text(i) == "#" and t.text(i + 1) == "include" and i + 2 < len(t):
                end = i + 2
                if t.text(end) == "<":
                    while end + 1 < len(t) and t.text(end) != ">":
                        end += 1
                span = t.span(i + 2, end)
                self.import_(self.f.text(span).strip('"'), span, t.span(i, end), "include", "includes")
        self.scope(0, len(t), (), None)

    def _line_end(self, i: int) -> int:
        line = self.f.line(self.t.all[i].start)
        while i < len(self.t) and self.f.line(self.t.all[i].start) == line:
            i += 1
        return i

    def scope(self, i: int, hi: int, parts: tuple[str, ...], owner: str | None, in_class: bool = False) -> None:
        t = self.t
        while i < hi:
            w = t.text(i)
            if w == "#":
                i = self._line_end(i)
            elif w == "namespace" and (t.is_name(i + 1) or t.text(i + 1) == "{"):
                j, names = i + 1, []
                while j < hi and t.text(j) not in ("{", ";", "="):
                    if t.is_name(j):
                        names.append(t.text(j))
                    j += 1
                if t.text(j) == "{":
                    inner = (*parts, *names)
                    key = self.f.define("namespace", "::".join(names), "::".join(inner), t.span(i, t.pair[j]), t.span(i + 1, max(i + 1, j - 1)), meta={"declaration_kind": "namespace_definition"}, owner=owner) if names else owner
                    self.scope(j + 1, t.pair[j], inner, key)
                i = t.skip(j)
            elif w == "template" and t.text(i + 1) == "<":
                i = max(t.angle(i + 1), i + 2)
            elif w in ("class", "struct", "union") and t.is_name(i + 1) and self._opens(i, hi):
                i = self.type(i, hi, parts, owner)
            elif w in ("public", "private", "protected") and t.text(i + 1) == ":":
                i += 2
            elif w in ("using", "typedef", "friend", "enum", "static_assert"):
                while i < hi and t.text(i) != ";":
                    i = t.skip(i)
                i += 1
            elif w == ";":
                i += 1
            else:
                i = self.declaration(i, hi, parts, owner, in_class)

    def _opens(self, i: int, hi: int) -> bool:
        while i < hi and t_not(self.t.text(i)):
            i += 1
        return self.t.text(i) == "{"

    def type(self, start: int, hi: int, parts: tuple[str, ...], owner: str | None) -> int:
        t, j = self.t, start + 2
        while t.text(j) != "{":
            j += 1
        name, end = t.text(start + 1), t.pair[j]
        inner = (*parts, name)
        key = self.f.define("type", name, "::".join(inner), t.span(start, end), t.span(start + 1, start + 1), meta={"declaration_kind": f"{t.text(start)}_specifier"}, owner=owner)
        self.types.append((name, key))
        self.scope(j + 1, end, inner, key, True)
        return end + 1

    def declaration(self, start: int, hi: int, parts: tuple[str, ...], owner: str | None, in_class: bool) -> int:
        t, i, paren = self.t, start, None
        while i < hi and t.text(i) not in (";", "{", "="):
            if t.text(i) == "(" and paren is None and t.is_name(i - 1) and i > start:
                paren = i
            if t.text(i) == ":" and paren is not None and t.text(i + 1) != ":":  # constructor initialisers
                while i < hi and not (t.text(i) == "{" and t.text(i - 1) in (")", "}")):
                    i = t.skip(i) if t.text(i) in ("(",) or (t.text(i) == "{" and t.is_name(i - 1)) else i + 1
                break
            i = max(t.angle(i), i + 1) if t.text(i) == "<" else t.skip(i)
        stop = i
        if paren is None:
            while i < hi and t.text(i) != ";":
                i = t.skip(i)
            if in_class and stop - 1 > start and t.is_name(stop - 1) and t.text(stop - 2) not in ("*", "&", "&&"):
                name = t.text(stop - 1)
                key = self.f.define("field", name, "::".join((*parts, name)), t.span(start, min(i, hi - 1)), t.span(stop - 1, stop - 1), meta={"declaration_kind": "field_declaration"}, owner=owner)
                self.use_type(key, start, stop - 2, "field_type", False)
            return i + 1
        if t.text(stop) == "=":  # = default, = delete, = 0
            while i < hi and t.text(i) != ";":
                i = t.skip(i)
        has_body = t.text(i) == "{"
        end = min(t.pair[i] if has_body else i, len(t) - 1)
        first = paren - 1
        scope = list(parts)
        while t.text(first - 1) == "::" and t.is_name(first - 2):
            scope.append(t.text(first - 2))
            first -= 2
        if len(scope) > len(parts):  # the qualifiers came last first
            scope = list(parts) + scope[len(parts) :][::-1]
        name = ("~" if t.text(paren - 2) == "~" else "") + t.text(paren - 1)
        types = []
        for lo, up in t.pieces(paren + 1, t.pair[paren]):
            cut = next((k for k in range(lo, up + 1) if t.text(k) == "="), up + 1) - 1
            named = cut > lo and t.is_name(cut) and (t.is_name(cut - 1) or t.text(cut - 1) in ("&", "*", ">", "&&"))
            types.append((lo, cut - 1 if named else cut))
        signature = ",".join("".join(t.text(k) for k in range(lo, up + 1)) for lo, up in types if "".join(t.text(k) for k in range(lo, up + 1)) != "void")
        local = "::".join((*scope, f"{name}({signature})"))
        shown = "::".join((*scope[len(parts) :], name))
        key = self.f.define("callable", shown, local, t.span(start, end), t.span(first, paren - 1), meta={"declaration_kind": "function_definition" if has_body else "declaration"}, owner=owner)
        self.arity.append(((tuple(scope), name, len(types)), key))
        self.use_type(key, start, first - 1, "return_or_parameter", False)
        for lo, up in types:
            self.use_type(key, lo, up, "return_or_parameter", False)
        if has_body:
            self.pending.append((key, tuple(scope), i + 1, end, None))
        return end + 1

    def is_call(self, c: Call) -> bool:
        """A name right after a type's name declares an object."""
        before = self.t.text(c.first - 1)
        return not (self.t.is_name(c.first - 1) and before not in self.words)

    def body(self, key, scope, lo, hi, receiver) -> None:
        super().body(key, scope, lo, hi, receiver)
        t = self.t
        for i in range(lo, hi):
            if t.text(i) in (".", "->") and t.is_name(i - 1) and t.is_name(i + 1) and t.text(i - 2) not in (".", "->", "::") and t.text(i - 1) != "this":
                name = t.text(i - 1)
                found = self.fields.get((scope, name))
                self.f.refer("field_reference", "references", name, t.span(i - 1, i - 1), t.span(i - 1, i + 1), source=key, target=found, confidence=0.6 if found else 0.4, meta={"reference_kind": "field_expression"})

    def resolve(self, scope, c, n, receiver):
        if c.receiver:
            return None
        for k in range(len(scope), -1, -1):
            if found := self.callables.get((scope[:k], self.t.text(c.name), n)):
                return found
        return None


def t_not(text: str) -> bool:
    return text not in ("{", ";", "(", "=")


def java(path: str, source: bytes) -> Facts:
    return Java(path, source).read()


def go(path: str, source: bytes) -> Facts:
    return Go(path, source).read()


def rust(path: str, source: bytes) -> Facts:
    return Rust(path, source).read()


def cpp(path: str, source: bytes) -> Facts:
    return Cpp(path, source).read()
