"""Entities of sources whose comments and strings have brackets and words of their own."""

import random

from strata.functions import lexing
from strata.operators import ingest

TS = '''import { a } from "x"; // function no() {
/* class Not { } */
export async function outer(x: number, y = "}{"): Promise<void> {
  for (const i of [1, 2]) { if (x) { helper.call(i); } else other(i) }
  const inner = (z: string): string => { return `{ ${z} }` + outer(z) };
  while (x) y();
  do { x-- } while (x > 0);
}
class A<T> extends B<T> { constructor(private q: T) { super(q) } get name(): string { return this.q } async run(cb: () => void) { switch (cb) { case 1: await cb(); } } }
interface I { f(x: number): void; g: string }
const short = x => x + 1;
'''
CPP = '''#include <map> // {
struct P { int x; int get() const { return x; } };
template <typename T> class Q : public R { public: void go(int n) { for (int i = 0; i < n; ++i) { while (n) { n--; } } } };
int Q::add(int a, int b) { if (a) return add(a - 1, b); return f(a) + std::max(a, b); }
static const char* s = "{ not ( a } block"; void decl(int);
'''


def told(path, source, language):
    return [(e["kind"], e["name"], e["startLine"], e["endLine"]) for e in lexing.entities(path, source, language)]


def test_typescript():
    assert told("a.ts", TS, "typescript") == [
        ("function", "outer", 3, 8), ("loop", "i", 4, 4), ("branch", "x", 4, 4), ("function", "inner", 5, 5), ("loop", "x", 6, 6), ("loop", "x", 7, 7), ("class", "A", 9, 9), ("method", "constructor", 9, 9), ("method", "name", 9, 9), ("method", "run", 9, 9), ("branch", "cb", 9, 9), ("interface", "I", 10, 10), ("function", "short", 11, 11),
    ]
    by = {(e["kind"], e["name"]): e for e in lexing.entities("a.ts", TS, "typescript")}
    assert by["function", "outer"]["dependencies"] == ["helper.call", "other", "outer"] and by["function", "outer"]["complexityHint"] == "likely O(n^3) due to nested loops"
    assert by["branch", "x"]["signature"] == "if (x)" and by["method", "run"]["dependencies"] == ["cb"]
    e = by["class", "A"]
    assert TS[e["startIndex"] : e["endIndex"]].startswith("class A<T>") and TS[e["startIndex"] : e["endIndex"]].endswith("} } }") and e["signature"] == "class A<T> extends B<T>"


def test_cpp():
    assert told("a.cpp", CPP, "cpp") == [("struct", "P", 2, 2), ("function", "get", 2, 2), ("function", "go", 3, 3), ("loop", "int", 3, 3), ("loop", "n", 3, 3), ("function", "add", 4, 4), ("branch", "a", 4, 4)]
    by = {e["name"]: e for e in lexing.entities("a.cpp", CPP, "cpp")}
    assert by["add"]["signature"] == "int Q::add(int a, int b)" and by["add"]["complexityHint"].startswith("recursive") and by["add"]["dependencies"] == ["add", "std::max"]


def test_other_files():
    assert told("a.py", "class X:\n    def f(self, a) :\n        pass\n  def g(\n", "python") == [("function", "f", 2, 2)]
    assert told("d/a.py", "x = 1\n", "python") == [("module", "a.py", 1, 2)] and told("a.go", "func x() {}", "go") == [("module", "a.go", 1, 1)]
    assert told("a.ts", " \n", "typescript") == [] and told("a.ts", None, "typescript") == []
    many = lexing.entities("a.ts", "function f() { " + " ".join(f"call{i}();" for i in range(40)) + " }", "typescript")
    assert len(many[0]["dependencies"]) == 16 and len(lexing.entities("a.ts", f"function f({'a' * 900}) {{ }}", "typescript")[0]["signature"]) == 220


def test_any_text_is_read():
    """Broken sources give something, in time that doesn't run away."""
    rng = random.Random(3)
    parts = ["{", "}", "(", ")", "[", "]", "function f", "class A ", "if ", "else ", "do ", "while ", "for ", "=>", "x = ", ";", '"', "'", "`", "//", "/*", "*/", "\n", "é", "struct S", "#if", "a.b(", "switch"]
    for _ in range(400):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 60)))
        for language in ("typescript", "cpp"):
            for e in lexing.entities("x", text, language):
                assert 0 <= e["startIndex"] < e["endIndex"] <= len(text) and e["startLine"] <= e["endLine"]
    assert len(lexing.entities("x", "{" * 100_000, "typescript")) == 0 and len(lexing.entities("x", "if (a) " * 500 + ";", "typescript")) == 500


def test_entities_of_files(spark):
    rows = [("src/a.ts", TS), ("src/a.cpp", CPP), ("b.py", "def f(a):\n  pass"), ("c.rs", "fn x() {}"), ("d.ts", ""), ("e.ts", None)]
    got = ingest.entities(spark.createDataFrame(rows, "path string, source string")).collect()
    assert len(got) == 13 + 7 + 1 + 1 and len({r["id"] for r in got}) == len(got)
    one = next(r for r in got if r["path"] == "b.py")
    assert (one["kind"], one["signature"], one["complexityHint"]) == ("function", "def f(a)", "inspect implementation for complexity") and one["summary"].startswith("FUNCTION f\nsignature: def f(a)\n")
