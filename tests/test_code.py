import re

import pytest

from strataquill.operators import references, scanner, symbols
from strataquill.plans import registry

PYTHON = (
    "import os\nimport sys\nfrom pathlib import Path\n\n\ndef add(x, y):\n    return x + y\n\n\ndef sub(x, y):\n    return x - y\n\n\n"
    + "def long_one(data):\n" + "".join(f"    v{k} = data[{k}]\n" for k in range(16)) + "    return data\n\n\nLIMIT = 3\n\n\n"
    + "class Store:\n    def __init__(self, label):\n        self.label = label\n\n    async def push(self, record):\n        self.records.append(record)\n\n    def total(self):\n        return long_one(self.records)\n"
)


def test_python_symbols():
    got = {(r[0], r[1], r[4], r[5]) for r in symbols.file_symbols(PYTHON, "python")[0]}
    assert ("add", "function", "add(x, y)", None) in got and ("Store", "class", None, None) in got
    assert ("push", "method", "async push(self, record)", "Store") in got
    rows, failed = symbols.file_symbols("def broken(:\n  pass\ndef fine(x):\n", "python")
    assert failed and [r[0] for r in rows] == ["broken", "fine"]


@pytest.mark.parametrize(
    ("language", "code", "want"),
    [
        ("typescript", "export class A {}\ninterface B {}\ntype C = string\nenum D {}\nexport const f = (x) => x\nasync function g() {}", {("A", "class"), ("B", "interface"), ("C", "type"), ("D", "enum"), ("f", "function"), ("g", "function")}),
        ("javascript", "class A {}\nconst h = async () => 1\n", {("A", "class"), ("h", "function")}),
        ("go", "type S struct {\n}\ntype I interface {\n}\nfunc F(a int) {}\nfunc (s *S) M() {}\n", {("S", "class"), ("I", "interface"), ("F", "function"), ("M", "method")}),
        ("rust", "pub struct S;\ntrait T {}\nenum E {}\npub async fn f() {}\nmod m {}\n", {("S", "class"), ("T", "interface"), ("E", "enum"), ("f", "function")}),
        ("java", "public class A {\n  public static int f(int x) {\n  }\n}\ninterface B {}\nenum C {}\n", {("A", "class"), ("f", "method"), ("B", "interface"), ("C", "enum")}),
        ("c", "struct S {\n};\nint main(int argc) {\n}\n", {("S", "class"), ("main", "function")}),
        ("ruby", "module M\n class A\n  def f?\n  end\n  def self.g\n", {("M", "module"), ("A", "class"), ("f?", "method"), ("g", "method")}),
        ("lua", "function T:m()\nend\nlocal function f()\nend\nT = {}\n", {("m", "method"), ("f", "function"), ("T", "class")}),
        ("haskell", "module M where\nf :: Int -> Int\nf x = x\ndata D = D\n", {("M", "module"), ("f", "function"), ("D", "type")}),
        ("elixir", "defmodule A.B do\n  def f(x) do\n  end\n", {("A.B", "module"), ("f", "function")}),
        ("kotlin", "class A\nfun f(x: Int) {}\ninterface I\n", {("A", "class"), ("f", "function"), ("I", "interface")}),
        ("sql", "CREATE TABLE IF NOT EXISTS t (x int);\ncreate view v as select 1;", {("t", "class"), ("v", "class")}),
        ("toml", "[tool]\n[tool.x]\n[[arr]]\n", {("tool", "module"), ("arr", "module")}),
        ("yaml", "name: x\n  inner: y\nother: z\n", {("name", "variable"), ("other", "variable")}),
        ("markdown", "# One\n### Two\n", {("One", "module"), ("Two", "function")}),
        ("html", "<h1>Hi</h1><p id='x'>", {("Hi", "module"), ("#x", "variable")}),
        ("bash", "f() {\n}\nfunction g {\n}\n", {("f", "function"), ("g", "function")}),
        (None, "function foo(x) {}\nstruct Bar {}\n", {("foo", "function"), ("Bar", "class")}),
    ],
)
def test_pattern_symbols(language, code, want):
    assert want <= {(r[0], r[1]) for r in symbols.file_symbols(code, language)[0]}


TS = """import { a } from "./a";
export class A<T> extends B {
  private x = { y: 1 };
  constructor(private repo: Repo) { super(); }
  async get(id: string): Promise<void> {
    if (id) { return foo(id) } // class Fake {
    const s = "function no() {";
    return this.repo.find(id);
  }
}
interface B { run(x: number): void; }
const g = async x => x + 1;
export default function h() { return `class Z {`; }
"""
GO = """package main
import (
\t"fmt"
)
type S struct {
\ta int
}
type T int
func (s *S) M() {
\tx := func() {}
}
func F(a int) (int, error) {
\treturn 0, nil // }
}
"""
JAVA = """package x;
import java.util.*;
public class A extends B {
  private final int x = foo(1);
  public A(int x) { this.x = x; }
  @Override
  public static <T> List<T> f(int x) throws E {
    for (int i = 0; i < 3; i++) { g(i); }
    return new ArrayList<>();
  }
  class Inner { void m() {} }
}
interface I { int q(String s); }
"""
RUST = """use std::fmt;
pub struct S<'a> { x: &'a str }
trait T { fn sig(&self); fn def(&self) { } }
impl<'a> S<'a> {
    pub fn new(x: &'a str) -> Self { S { x } }
}
impl fmt::Display for E { fn fmt(&self) -> R { write!(f, "{}", '}') } }
"""
CPP = """#include <stdio.h>
#define LOOP(x) for (;;) { x }
namespace n {
template <typename T> class K : public B {
 public:
  K() : x_(0) {}
  int get() const { return x_; }
  void set(int v);
};
void K::set(int v) { x_ = v; }
}
typedef struct { int b; } U;
static int *f(int a, char *b)
{
    if (a) { return g(a); }
    return 0;
}
int declared(int);
"""


@pytest.mark.parametrize(
    ("language", "code", "want"),
    [
        ("typescript", TS, [("A", "class", None, 2, 10), ("constructor", "method", "A", 4, 4), ("get", "method", "A", 5, 9), ("B", "interface", None, 11, 11), ("run", "method", None, 11, 11), ("g", "function", None, 12, 12), ("h", "function", None, 13, 13)]),
        ("go", GO, [("S", "class", None, 5, 7), ("T", "type", None, 8, 8), ("M", "method", "S", 9, 11), ("F", "function", None, 12, 14)]),
        ("java", JAVA, [("A", "class", None, 3, 12), ("A", "method", "A", 5, 5), ("f", "method", "A", 7, 10), ("Inner", "class", "A", 11, 11), ("m", "method", "Inner", 11, 11), ("I", "interface", None, 13, 13), ("q", "method", None, 13, 13)]),
        ("rust", RUST, [("S", "class", None, 2, 2), ("T", "interface", None, 3, 3), ("def", "function", None, 3, 3), ("new", "method", "S<'a>", 5, 5), ("fmt", "method", "E", 7, 7)]),
        ("cpp", CPP, [("K", "class", None, 4, 9), ("K", "function", None, 6, 6), ("get", "function", None, 7, 7), ("set", "function", None, 10, 10), ("U", "type", None, 12, 12), ("f", "function", None, 13, 17)]),
        ("kotlin", "class A(val x: Int) : B() {\n  fun f(x: Int): Int = x + 1\n  fun g() {\n  }\n}\nfun top() {}\nenum class E { X }\n", [("A", "class", None, 1, 5), ("f", "method", "A", 2, 2), ("g", "method", "A", 3, 4), ("top", "function", None, 6, 6), ("E", "enum", None, 7, 7)]),
        ("scala", "object O {\n  def f(x: Int): Int = x\n}\ntrait T { def q: Int }\n", [("O", "class", None, 1, 3), ("f", "method", "O", 2, 2), ("T", "interface", None, 4, 4), ("q", "method", "T", 4, 4)]),
        ("csharp", "namespace N {\n  public class A : B {\n    public A(int x) { }\n    public async Task<int> F(string s) { await G(s); return 1; }\n    private int P { get; set; }\n  }\n  enum E { X }\n}\n", [("N", "module", None, 1, 8), ("A", "class", None, 2, 6), ("A", "method", "A", 3, 3), ("F", "method", "A", 4, 4), ("E", "enum", None, 7, 7)]),
        ("php", "<?php\nclass K extends B { public function f($x) { return function() {}; } }\nfunction g() {}\n", [("K", "class", None, 2, 2), ("f", "method", "K", 2, 2), ("g", "function", None, 3, 3)]),
        ("groovy", "class A {\n  def f(x) { x }\n}\ndef h() { }\n", [("A", "class", None, 1, 3), ("f", "method", "A", 2, 2), ("h", "function", None, 4, 4)]),
        ("zig", "pub const S = struct {\n  pub fn m(self: S) void {}\n};\nfn f() void {}\n", [("S", "class", None, 1, 3), ("m", "function", None, 2, 2), ("f", "function", None, 4, 4)]),
        ("bash", "f() {\n  echo \"}\" # }\n}\nfunction g {\n}\n", [("f", "function", None, 1, 3), ("g", "function", None, 4, 5)]),
        ("ruby", "module M\n  class A < B\n    def f?(x)\n      while x do\n        y\n      end\n      xs.each do |z|\n      end\n      return 1 if x\n    end\n    def self.g; end\n  end\nend\ndef top\nend\n", [("M", "module", None, 1, 13), ("A", "class", "M", 2, 12), ("f?", "method", "A", 3, 10), ("g", "method", "A", 11, 11), ("top", "function", None, 14, 15)]),
        ("lua", "local function f(x)\n  if x then return 1 end\n  for i = 1, 2 do end\nend\nT = {}\nfunction T:m(a)\nend\n", [("f", "function", None, 1, 4), ("T", "class", None, 5, 5), ("m", "method", "T", 6, 7)]),
        ("elixir", "defmodule A.B do\n  def f(x) do\n    if x do\n      1\n    end\n  end\n  defp g(x), do: x\nend\n", [("A.B", "module", None, 1, 8), ("f", "function", "A.B", 2, 6), ("g", "function", "A.B", 7, 7)]),
        ("julia", "module M\nstruct S\n  x\nend\nfunction f(x)\n  for i in 1:2\n  end\nend\ng(x) = x + 1\nend\n", [("M", "module", None, 1, 10), ("S", "class", "M", 2, 4), ("f", "method", "M", 5, 8), ("g", "method", "M", 9, 9)]),
        ("haskell", "f :: Int -> Int\nf 0 = 1\nf n = n\n  where k = 1\ndata D = D Int\nclass C a where\n  m :: a\n", [("f", "function", None, 2, 4), ("D", "type", None, 5, 5), ("C", "class", None, 6, 7)]),
        ("ocaml", "let f x =\n  x + 1\nlet v = 3\ntype t = A | B\nmodule M = struct\n  let g a = a\nend\n", [("f", "function", None, 1, 2), ("v", "variable", None, 3, 3), ("t", "type", None, 4, 4), ("M", "module", None, 5, 6), ("g", "function", "M", 6, 6)]),
        ("yaml", "# c\nname: x\n  inner: y\nother:\n  - a: 1\n---\nz: 1\n", [("name", "variable", None, 2, 3), ("other", "variable", None, 4, 5), ("z", "variable", None, 7, 7)]),
        ("toml", "[tool]\na=1\n\n[tool.x]\nb = 1\n[[arr]]\nb = 2\n", [("tool", "module", None, 1, 2), ("arr", "module", None, 6, 7)]),
        ("json", '{"a": {"b": 1}, "c": [1,\n2]}', [("a", "variable", None, 1, 1), ("c", "variable", None, 1, 2)]),
        ("html", '<div id="x">\n<h1>Hi <b>there</b> you</h1></div><br id=\'y\'><script>var a = "<h1>no</h1>"</script>', [("#x", "variable", None, 1, 2), ("Hi you", "module", None, 2, 2), ("#y", "variable", None, 2, 2)]),
        ("css", '/* a{ */ .a, .b { c: d }\n@media (x) { .z {} }\n@keyframes k { from {} }\n@import "u";\n', [(".a", "class", None, 1, 1), ("@media", "module", None, 2, 2), ("@keyframes k", "function", None, 3, 3), ('@import "u";', "variable", None, 4, 4)]),
        ("markdown", "# One\n## Two\n```\n# no\n```\nSet\n===\n", [("One", "module", None, 1, 1), ("Two", "function", None, 2, 2), ("Set", "module", None, 6, 7)]),
        ("sql", "CREATE TABLE IF NOT EXISTS t (x int);\n-- create table no\ncreate index i on t (x);\ncreate or replace function f() returns int as $$ select 1; $$;", [("t", "class", None, 1, 1), ("t", "variable", None, 3, 3), ("f", "function", None, 4, 4)]),
        ("cmake", "function(foo a)\n if(x)\n endif()\nendfunction()\nmacro(bar)\nendmacro()\n", [("foo", "function", None, 1, 4), ("bar", "function", None, 5, 6)]),
        ("svelte", "<script>\nexport let a;\nfunction f() {}\nexport function g() {}\n</script>\n<style>a{}</style>", [("a", "variable", None, 2, 2), ("f", "function", None, 3, 3), ("g", "variable", None, 4, 4), ("<style>", "module", None, 6, 6)]),
    ],
)
def test_scanners_know_owners_and_last_lines(language, code, want):
    rows, failed = symbols.file_symbols(code, language)
    assert not failed and [(r[0], r[1], r[5], r[2], r[3]) for r in rows] == want


@pytest.mark.parametrize(
    ("language", "code", "target", "want"),
    [
        ("typescript", "import { E } from 'e';\nimport { r } from 'f';\n\nexport class Box {\n  open(): string { return r(this.p, 'x}'); }\n" + "  more(): void { }\n" * 9 + "}\n\nexport function a(x: string[]): string[] {\n  return x.map(l => l.trim());\n}\n\nexport function b(t: string): number {\n  return t.split(/\\s+/).length;\n}\n", 260, [("import_group", []), ("block", ["Box"]), ("block", ["a", "b"])]),
        ("cpp", "#include <a>\n#include <b>\n\nnamespace u {\n    int t(int s) { return s; }\n" + "    // more\n" * 20 + "}\n\nclass P {\npublic:\n    P(int s) : s_(s) {}\n" + "    int v;\n" * 20 + "};\n\nint sum(int v) {\n" + "    v += 1;\n" * 20 + "    return v;\n}\n", 200, [("import_group", []), ("block", ["u"]), ("class", ["P"]), ("function", ["sum"])]),
        ("go", "package m\n\nimport (\n\t\"fmt\"\n)\n\ntype C struct {\n\tN string\n}\n\nfunc (c *C) S() string {\n\treturn fmt.Sprintf(\"{%s}\", c.N)\n}\n\nfunc j(p []string) string {\n\treturn p[0]\n}\n", 70, [("import_group", []), ("block", ["C"]), ("function", ["S"]), ("function", ["j"])]),
        ("rust", "use a::b;\n\npub struct S { x: u8 }\n\nimpl T for S {\n    fn f(&self) -> u8 { self.x }\n}\n\nfn free() -> u8 { 1 }\n", 50, [("import_group", []), ("class", ["S"]), ("block", ["S"]), ("function", ["free"])]),
        ("java", "import a.b;\nimport c.d;\n\npublic class K {\n  int f() { return 1; }\n}\n\nenum E { A, B, C }\n\ninterface I { int q(); }\n", 50, [("import_group", []), ("class", ["K"]), ("block", ["E", "I"])]),
    ],
)
def test_chunks_of_scanned_languages(language, code, target, want):
    out = symbols.chunk_file(code, language, target)
    assert [(c[1], c[2]) for c in out] == want
    assert all(c[0].strip() and c[0] in code for c in out)


def test_large_declarations_give_those_inside():
    code = "class Big {\n" + "".join(f"  int f{k}(int x) {{\n    return \"é}}\" + x;\n  }}\n" for k in range(80)) + "}\n"
    parts = symbols.chunk_file(code, "java", 400)
    assert len(parts) > 5 and all("class Big" not in c[0] for c in parts) and sum(len(c[2]) for c in parts) == 80


def test_lines_and_repeats():
    rows, _ = symbols.file_symbols("\n\nfunc A() {}\nfunc A() {}\n", "go")
    assert [(r[0], r[2]) for r in rows] == [("A", 3), ("A", 4)]
    assert len(symbols.file_symbols("".join(f"func F{k}() {{}}\n" for k in range(2500)), "go")[0]) == 2000


def test_chunks_along_definitions():
    out = symbols.chunk_file(PYTHON, "python", 200)
    assert [c[1] for c in out] == ["import_group", "block", "function", "class"]
    assert all("LIMIT" not in c[0] for c in out) and "import sys" in out[0][0] and out[1][2] == ["add", "sub"]
    assert symbols.chunk_file(PYTHON, "python", 5000)[0][1] == "file"
    flat = symbols.chunk_file("x = 1\n" * 500, "python", 1000)
    assert len(flat) > 1 and {c[1] for c in flat} == {"block"} and flat[-1][0].endswith("x = 1\n")
    code = "package m\n\nimport \"fmt\"\n\n" + "".join(f"func F{k}(x int) int {{\n\tif x > 0 {{\n\t\treturn x\n\t}}\n\treturn {k}\n}}\n\n" for k in range(12))
    parts = symbols.chunk_file(code, "go", 200)
    assert parts[0][1] == "import_group" and sum(c[0].count("func F") for c in parts) == 12


@pytest.mark.parametrize(("sizes", "want"), [([], []), ([(0, 400), (400, 800)], [2]), ([(0, 1600)], [1]), ([(0, 750), (750, 1500)], [2]), ([(0, 600), (600, 1200), (1200, 1900)], [2, 1])])
def test_merging_spans(sizes, want):
    assert [len(g) for g in symbols.merge_spans([(a, b, "function", "f") for a, b in sizes], 1500)] == want


def resolved(spark, **files):
    rows = [(k.replace("__", ".", 1), v) for k, v in files.items()]
    out = references.symbol_edges(spark.createDataFrame(rows, "rel_path string, content string")).collect()
    return {(r["src_symbol"], r["dst_symbol"]): r["confidence"] for r in out}


def test_calls_of_held_services(spark):
    services = "".join(f"class {n}:\n    async def build(self, x): ...\n    async def summary(self): ...\n\n" for n in ("Graph", "Store"))
    user = "from services import Graph, Store\n\nclass User:\n    def __init__(self):\n        self._g = Graph()\n        self._s = Store()\n\n    async def run(self):\n        await self._g.build(1)\n        await self._s.build(2)\n"
    got = resolved(spark, services__py=services, user__py=user)
    assert got[("user.py::User.run", "services.py::Graph.build")] == got[("user.py::User.run", "services.py::Store.build")] == "high"
    assert ("user.py::User.run", "services.py::Graph.summary") not in got


def test_reassigned_attributes_are_uncertain(spark):
    code = "class A:\n    def run(self): ...\nclass B:\n    def run(self): ...\nclass R:\n    def __init__(self):\n        self.w = A()\n    def switch(self):\n        self.w = B()\n    def go(self):\n        self.w.run()\n"
    got = resolved(spark, m__py=code)
    assert got[("m.py::R.go", "m.py::A.run")] == got[("m.py::R.go", "m.py::B.run")] == "low"


def test_imported_and_inherited(spark):
    got = resolved(
        spark, utils__py="def make(d): ...\n", auth__py="def check(t): ...\n", billing__py="def check(t): ...\n",
        use__py="import billing\nfrom utils import make\nfrom auth import check\n\ndef go(x):\n    check(x)\n    billing.check(x)\n    return make(x)\n",
        base__py="class Base:\n    def ok(self): ...\nclass Mid(Base): ...\nclass Kid(Mid):\n    def go(self):\n        self.ok()\n        return free(self)\n",
        star__py="from utils import *\n\ndef h():\n    make(1)\n", duck__py="def f(obj):\n    obj.build()\n",
    )
    assert {("use.py::go", "utils.py::make"), ("use.py::go", "auth.py::check"), ("use.py::go", "billing.py::check"), ("base.py::Kid.go", "base.py::Base.ok")} == set(got)


def test_scripts(spark):
    repo = "interface Repo {\n  find(id: string): any;\n}\nclass UserRepo implements Repo {\n  async find(id: string) { return null; }\n}\nclass OrderRepo implements Repo {\n  async find(id: string) { return null; }\n}\n"
    service = "import { Repo, UserRepo } from './repo';\nclass Service {\n  constructor(private repo: Repo) {}\n  async get(id: string) {\n    return this.repo.find(id);\n  }\n}\nfunction wrap<T>(v: T): T { return v; }\nfunction caller() {\n  const x = wrap<string>('hi');\n}\n"
    got = resolved(spark, repo__ts=repo, service__ts=service)
    assert got.get(("service.ts::caller", "service.ts::wrap")) == "high"
    # An injected interface is any of its implementors, with low confidence.
    assert got.get(("service.ts::Service.get", "repo.ts::OrderRepo.find")) == got.get(("service.ts::Service.get", "repo.ts::UserRepo.find")) == "low"


def test_classes_of_one_name_are_told_apart_by_file(spark):
    one = "class Base:\n    def ok(self): ...\nclass Kid(Base):\n    def go(self):\n        self.ok()\n"
    two = "class Base:\n    def other(self): ...\n    def ok(self): ...\n"
    user = "from two import Base\nclass User(Base):\n    def __init__(self):\n        self.b = Base()\n    def run(self):\n        self.b.ok()\n        self.other()\n"
    got = resolved(spark, one__py=one, two__py=two, user__py=user)
    assert got == {("one.py::Kid.go", "one.py::Base.ok"): "high", ("user.py::User.run", "two.py::Base.ok"): "high", ("user.py::User.run", "two.py::Base.other"): "high"}


def test_imports_mean_one_file_by_its_whole_path(spark):
    files = {
        "a/utils.py": "def go(): ...\ndef only_a(): ...\nclass K:\n    def m(self): ...\n", "b/utils.py": "def go(): ...\nclass K:\n    def m(self): ...\n", "utils.py": "def go(): ...\n", "c/d/utils.py": "def go(): ...\ndef deep(): ...\n",
        "x.py": "from a.utils import go\ndef f():\n    go()\n", "y.py": "from b.utils import go as g, K\nclass Y(K):\n    def f(self):\n        g()\n        self.m()\n",
        "b/rel.py": "from .utils import go\nfrom ..a import utils as u\nfrom . import utils\ndef f():\n    go()\n    u.only_a()\ndef h():\n    utils.go()\n",
        "z.py": "import a.utils as au\nfrom c.d import utils\ndef f():\n    au.go()\n    utils.deep()\n", "w.py": "from utils import go\ndef f():\n    go()\n", "v.py": "from src.b.utils import go\ndef f():\n    go()\n",
        "u.py": "from utils import deep\ndef f():\n    deep()\n", "t.py": "from a.utils import go\nfrom b.utils import go\ndef f():\n    go()\n", "s.py": "from nowhere import go\ndef go(): ...\ndef f():\n    go()\n",
        "p/index.ts": "export function run() {}\n", "q/index.ts": "export function run() {}\n", "q/r.ts": "export function run() {}\n",
        "q/m.ts": "import { run } from '../p/index';\nfunction f() {\n  run();\n}\n", "q/n.ts": "import { run } from '../p';\nfunction f() {\n  run();\n}\n", "q/o.ts": "import { run } from './r';\nfunction f() {\n  run();\n}\n",
        "q/k.ts": "import { run } from 'index';\nfunction f() {\n  run();\n}\n",
    }
    out = references.symbol_edges(spark.createDataFrame(list(files.items()), "rel_path string, content string")).collect()
    assert {(r["src_symbol"], r["dst_symbol"], r["confidence"]) for r in out} == {
        ("x.py::f", "a/utils.py::go", "high"), ("y.py::Y.f", "b/utils.py::go", "high"), ("y.py::Y.f", "b/utils.py::K.m", "high"), ("b/rel.py::f", "b/utils.py::go", "high"), ("b/rel.py::f", "a/utils.py::only_a", "high"),
        ("b/rel.py::h", "b/utils.py::go", "high"), ("z.py::f", "a/utils.py::go", "high"), ("z.py::f", "c/d/utils.py::deep", "high"), ("w.py::f", "a/utils.py::go", "high"), ("v.py::f", "b/utils.py::go", "high"),
        ("u.py::f", "c/d/utils.py::deep", "high"), ("t.py::f", "b/utils.py::go", "high"), ("q/m.ts::f", "p/index.ts::run", "high"), ("q/n.ts::f", "p/index.ts::run", "high"), ("q/o.ts::f", "q/r.ts::run", "high"),
    }


def test_first_base_comes_first(spark):
    code = "class A:\n    pass\nclass Deep(A):\n    pass\nclass Other:\n    def f(self): ...\n" + "class Root:\n    def f(self): ...\nclass Left(Root):\n    pass\nclass Kid(Left, Other):\n    def go(self):\n        self.f()\n"
    assert resolved(spark, m__py=code) == {("m.py::Kid.go", "m.py::Root.f"): "high"}


def test_nesting_too_deep_for_the_parser():
    deep = "(" * 5000 + "\nclass A:\n  pass\n"
    assert symbols.file_symbols(deep, "python")[1] and symbols.chunk_file(deep, "python", 1000) and references.python_facts("a.py", deep) == [] and symbols.python_imports(deep) == []


def test_calls_are_resolved_without_broadcasts(spark):
    """Tables made of small files aren't small: their estimates come from the files' table."""
    rows = spark.createDataFrame([("a/x.py", "class K:\n    def go(self):\n        return self.on()\n\n    def on(self):\n        return 1\n"), ("a/y.py", "from a.x import K\n\ndef f():\n    return f2()\n\ndef f2():\n    return 1\n")], "rel_path string, content string")
    edges = references.symbol_edges(rows)
    assert {(r["src_symbol"], r["dst_symbol"]) for r in edges.collect()} == {("a/x.py::K.go", "a/x.py::K.on"), ("a/y.py::f", "a/y.py::f2")}
    assert "Broadcast" not in edges._jdf.queryExecution().executedPlan().toString()


def test_narrow_tables_of_sources_are_dealt_out(spark, sf_dir):
    """A table of parts is one split; the sources made of it are parsed by all cores."""
    assert registry.QUERIES["code_chunks"](spark, sf_dir).rdd.getNumPartitions() == 4
    assert registry.QUERIES["declared_symbols"](spark, sf_dir).rdd.getNumPartitions() == 4


def test_blanks_are_as_long_as_what_they_hide():
    """Each comment is blanked in one step; a nested substitution took most of the time on files with many comments."""
    code = "func a() {\n" + "\t// it's } func b() {\n" * 3 + "\tx := `one\n } two`\n}\n"
    blank = scanner.blanked(code, scanner.LANGUAGES["go"])
    assert [len(x) for x in blank.split("\n")] == [len(x) for x in code.split("\n")] and "two" not in blank and "func b" not in blank
    assert scanner._hidden(re.match(r"[\s\S]*", "a\n\nbc")) == " \n\n  "
