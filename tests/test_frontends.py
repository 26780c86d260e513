from collections import Counter

import pytest

from lodegraph.sources.frontends import FRONTENDS

JAVA = b"""package shop;
import static java.util.List.of;
import java.util.*;
@Deprecated public class Cart<T> extends Base {
  private final Map<String, Item> items = new HashMap<>();
  enum Mode { A, B; int code() { return 1; } }
  public Cart(Item first, int... more) { add(first, 1); this.items.clear(); }
  void add(Item i, int n) throws Oops { add(i, n); other.add(helper(i)); int x = this.items; }
  <R> R pick(List<R> from) { return from.get(new Random().nextInt(3)); }
}
"""


def facts(language, source, path="src/x"):
    return FRONTENDS[language](path, source).rows


def local(key):
    return key.split("#", 1)[1] if key else None


def test_java():
    rows = facts("java", JAVA, "Cart.java")
    assert [(n["kind"], local(n["symbol_key"])) for n in rows["nodes"]] == [
        ("type", "Cart"), ("field", "Cart.items"), ("type", "Cart.Mode"), ("callable", "Cart.Mode.code()"), ("callable", "Cart.<init>(Item,int...)"), ("callable", "Cart.add(Item,int)"), ("callable", "Cart.pick(List<R>)"),
    ]
    assert rows["nodes"][0]["qualified_name"] == "shop.Cart" and rows["diagnostics"] == []
    imports = [(e["unresolved_dst"], e["metadata_json"]) for e in rows["edges"] if e["kind"] == "imports"]
    assert imports == [("java.util.List.of", '{"static":true}'), ("java.util.*", '{"static":false}')]
    calls = [(local(e["src_key"]), local(e["dst_key"]), e["unresolved_dst"], e["confidence"]) for e in rows["edges"] if e["kind"] == "calls"]
    assert calls == [
        ("Cart.<init>(Item,int...)", "Cart.add(Item,int)", None, 0.75), ("Cart.<init>(Item,int...)", None, "this.items.clear", 0.45), ("Cart.add(Item,int)", "Cart.add(Item,int)", None, 0.75),
        ("Cart.add(Item,int)", None, "other.add", 0.45), ("Cart.pick(List<R>)", None, "from.get", 0.45),
    ]
    refs = [(e["unresolved_dst"], local(e["dst_key"])) for e in rows["edges"] if e["kind"] == "references"]
    assert (None, "Cart.items") in refs
    uses = Counter(e["unresolved_dst"] for e in rows["edges"] if e["kind"] == "uses_type")
    assert uses["Item"] == 2 and uses["Map"] == 1 and uses["List"] == 1


def test_python():
    source = b'import os.path as p, sys\nfrom ..a import b as c, d\nfrom m import *\n@dec\nclass A(Base, metaclass=M):\n    x: int = 1\n    y = z = 2\n    def f(self, a, *r, k=1, **kw):\n        self.g(h(1))\n        return B(2).run()\n    async def g(self, v): A()\n\ndef h(n):\n    """\xc3\xa9"""\n    def inner(): h(1)\n    return h(n)\n'
    rows = facts("python", source, "a.py")
    assert [local(n["symbol_key"]) for n in rows["nodes"]] == ["A", "A.x", "A.y", "A.f(self,a,*r,k,**kw)", "A.g(self,v)", "h(n)"]
    assert [e["unresolved_dst"] for e in rows["edges"] if e["kind"] == "imports"] == ["os.path", "sys", "..a.b", "..a.d", "m"]
    calls = [(local(e["src_key"]), local(e["dst_key"]), e["unresolved_dst"]) for e in rows["edges"] if e["kind"] == "calls"]
    assert calls == [("A.f(self,a,*r,k,**kw)", "A.g(self,v)", None), ("A.f(self,a,*r,k,**kw)", None, "B(2).run"), ("A.g(self,v)", None, "A"), ("h(n)", "h(n)", None)]
    assert [local(e["dst_key"]) for e in rows["edges"] if e["kind"] == "uses_type" and e["dst_key"]] == ["A"]
    for o in rows["occurrences"]:
        assert source[o["start_byte"] : o["end_byte"]].decode().endswith(o["text"].split(".")[-1]) or o["role"] == "import"
    assert facts("python", b"def broken(:\n")["diagnostics"][0]["code"] == "parse_error"


def test_go():
    source = b'package pay\nimport (\n  "fmt"\n  al "x/y"\n)\ntype Svc struct {\n  gw *Gateway\n  Base\n}\ntype Gateway interface { Charge(r Req) error }\nfunc (s *Svc) Run(a, b int, r *Req) (bool, error) {\n  s.check(a)\n  s.gw.Charge(r)\n  helper(1)\n  return true, nil\n}\nfunc (s *Svc) check(a int) {}\nfunc helper(n int) Svc { return Svc{} }\n'
    rows = facts("go", source, "p.go")
    assert [(n["kind"], local(n["symbol_key"])) for n in rows["nodes"]] == [
        ("namespace", "pay"), ("type", "Svc"), ("field", "Svc.gw"), ("field", "Svc.Base"), ("type", "Gateway"), ("callable", "Svc.Run(int,int,*Req)"), ("callable", "Svc.check(int)"), ("callable", "helper(int)"),
    ]
    calls = [(local(e["dst_key"]), e["unresolved_dst"]) for e in rows["edges"] if e["kind"] == "calls"]
    assert calls == [("Svc.check(int)", None), (None, "s.gw.Charge"), ("helper(int)", None)]
    assert [(e["unresolved_dst"], e["metadata_json"]) for e in rows["edges"] if e["kind"] == "imports"] == [("fmt", '{"alias":null}'), ("x/y", '{"alias":"al"}')]


def test_rust():
    source = b"use std::fmt::{self, Debug};\n#[derive(Clone)]\npub struct S<'a> { pub a: &'a T, b: u8 }\nenum E { A, B(i32) }\nstruct P(pub T, u8);\nimpl<'a> S<'a> {\n  pub fn new(x: T) -> Self { helper(x) }\n  fn go(&self, n: u32) -> Option<T> { self.go(n); other.go(1); println!(\"{}\", n != 1); None }\n}\nmod m { pub fn f() { g(); } fn g() {} }\nfn helper(x: T) -> S<'static> { S::new(x) }\n"
    rows = facts("rust", source, "l.rs")
    assert [local(n["symbol_key"]) for n in rows["nodes"]] == ["S", "S.a", "S.b", "E", "E.A", "E.B", "P", "P.0", "P.1", "S.new(T)", "S.go(&self,u32)", "m", "f()", "g()", "helper(T)"]
    calls = [(local(e["dst_key"]), e["unresolved_dst"], e["confidence"]) for e in rows["edges"] if e["kind"] == "calls"]
    assert calls == [("helper(T)", None, 0.75), ("S.go(&self,u32)", None, 0.75), (None, "other.go", 0.45), (None, "println!", 0.35), ("g()", None, 0.75), (None, "S::new", 0.45)]


def test_cpp():
    source = b'#include <vector>\n#include "a/b.hpp"\nnamespace n { class C : public B {\n public:\n  explicit C(T* t) : t_(t) {}\n  virtual int run(const T& x, int k = 3) const;\n private:\n  int size_;\n};\nint C::run(const T& x, int k) const { helper(k); C c(x); return c.size_ + x.get(); }\nvoid helper(int a) {}\n}\n'
    rows = facts("cpp", source, "c.cpp")
    assert [(n["kind"], local(n["symbol_key"])) for n in rows["nodes"]] == [
        ("namespace", "n"), ("type", "n::C"), ("callable", "n::C::C(T*)"), ("callable", "n::C::run(constT&,int)"), ("field", "n::C::size_"), ("callable", "n::C::run(constT&,int)"), ("callable", "n::helper(int)"),
    ]
    assert [e["unresolved_dst"] for e in rows["edges"] if e["kind"] == "includes"] == ["<vector>", "a/b.hpp"]
    calls = [(local(e["dst_key"]), e["unresolved_dst"]) for e in rows["edges"] if e["kind"] == "calls"]
    assert calls == [("n::helper(int)", None), (None, "x.get")]


def test_matlab():
    source = b"classdef Svc < handle & Base\n  properties\n    gw % comment (with call())\n    n = 1;\n  end\n  methods\n    function obj = Svc(gw)\n      obj.gw = gw(end);\n      check(obj, 'it''s (');\n    end\n    function check(obj, x)\n      if x, disp(x); end\n    end\n  end\nend\n"
    rows = facts("matlab", source, "Svc.m")
    assert [local(n["symbol_key"]) for n in rows["nodes"]] == ["Svc", "Svc.gw", "Svc.n", "Svc.Svc(gw)", "Svc.check(obj,x)"]
    calls = [(local(e["src_key"]), local(e["dst_key"]), e["unresolved_dst"]) for e in rows["edges"] if e["kind"] == "calls"]
    assert ("Svc.Svc(gw)", "Svc.check(obj,x)", None) in calls and ("Svc.check(obj,x)", None, "disp") in calls
    script = facts("matlab", b"x = load('a');\nplot(x);\n", "s.m")
    assert [c["kind"] for c in script["chunks"]] == ["source"] and {e["confidence"] for e in script["edges"]} == {0.35} and script["edges"][0]["unresolved_src"] == "s.m"


@pytest.mark.parametrize("language", sorted(FRONTENDS))
def test_odd_sources_never_fail(language):
    for source in (b"", b"\n", b"((((", b"}}}}", b"class", b"func (", b"fn", b"\xef\xbb\xbfx", b"'", b'"', b"/*", b"a<b<c<d", b"#include", b"impl<", b"import ", b"package", b"type X", b"x" * 5000, JAVA[:200], JAVA[:333]):
        rows = facts(language, source)
        for table in rows.values():
            for r in table:
                if "start_byte" in r:
                    assert 0 <= r["start_byte"] <= r["end_byte"] <= max(len(source), 1)
