import pytest

from srcatlas.llm.syntax import first_error, judged

GOOD = {
    ".js": [
        "", "#!/usr/bin/env node\nlet a = 1", "import a, { b as c } from 'x'; export * from 'y'; export { a as default }", "const {a, b: [c, ...d] = [], ...e} = f; [a, b] = [b, a]",
        "a = b\n++c\nd", "x = a / b / c; y = /[/]\\/(/g.test(z)", "label: for (const k of ks) { if (k) continue label; else break label }", "for (let i = 0, n = a.length; i < n; i++); for (var p in o) {} for await (const x of y) {}",
        "async function* f() { yield* g(); await h; for (;;) {} }", "const f = async (a = 1, {b}) => { return\n a }, g = x => ({ x }), h = async y => y", "class A extends (B, C) { static #p = 1; static { this.x = 1 } get a() { return 1 } set a(v) {} async *m() {} static async n() {} 'q'() {} [k] = 2; get; static; #r() { return #p in this } }",
        "`a${`b${c}`}d`", "o = { get: 1, set, async, get a() { return 1 }, async b() {}, *c() {}, [d]: 1, 'e': 2, 3: 4, ...f, if: 1, of, from }", "a?.b?.[c]?.(d) ?? e; a ||= b; x ** y", "switch (a) { case 1: case 2: b(); break; default: }", "try { a() } catch { b() } finally { c() }",
        "var type = 1, of = 2, from = 3, as = 4, get = 5; type = of + as", "if (a) b; else if (c) d; else e", "do x++; while (x < 5) y()", "import('a').then(b); import.meta.url", "export default async function () {}", "export default class {}", "new A; new A.B(c).d; new (f())()", "let x = a ? (b) : c", "throw new Error(`x`)", "0xFFn + 1_000 + .5e-3", "/* c */ // d",
    ],
    ".jsx": ["const a = <div className=\"x\" {...p}>Don't {b && <i/>} {/* c */} &amp; <></></div>", "f(a < b, c > d); return1 = <A.B c:d='e' f={g}>{...h}</A.B>", "const x = () => (\n  <p>\n    {xs.map((y) => (<li key={y.id}>{y}</li>))}\n  </p>\n)"],
    ".ts": [
        "interface A<T> extends B, C<D> { a?: string; readonly [k: string]: any; m(x: number): void; new (y): A; (z: T): T }", "type A<T = {}> = T extends infer U ? U[] : keyof typeof b | 'x' & `y${string}` | [a: string, b?: number, ...c: D[]]", "enum E { A = 1, B = 'b', C }\nconst enum F { X }\ndeclare module 'm' { export const a: number }\nnamespace N.M { export type T = 1 }",
        "function f<T>(this: A, a?: T, ...b: Array<Map<string, number>>): asserts a is B { return <any>a! as unknown as T }", "abstract class A<T> extends B<T> implements C, D { private readonly a: string = ''; constructor(private b: number, public c?: string) { super() } abstract m(): void; protected static async n?(): Promise<Map<string, any[]>>; [k: string]: any; declare x: number; get y(): number { return 1 } }",
        "const f = async <T,>(a: T): Promise<T> => a, g = (x: number, y?: string): x is string => true; let h: (a: number) => (b: string) => void", "import type { A } from 'a'; import { type B, C } from 'b'; export type { D } from 'd'; export type E = 1", "let x = y satisfies Z; const z = f<string>(a); new Map<string, number>(); a < b || c > d; if (a < b && c > (d)) {}", "type M = { readonly [K in keyof T]?: T[K] }; function over(a: string): void\nfunction over(a: any) {}", "let a: typeof import('x').y = b as const; export = c", "let v = a >> b >>> c >= d",
    ],
    ".tsx": ["const A = <T,>({ a }: P<T>): JSX.Element => <div>{a as any}</div>;\nexport function B<T extends X>(p: { a: any[]; b?: () => void }) { return (<><A {...p} /></>) }"],
    ".json": ['{"a": [1, -2.5e3, true, null, "\\u00e9\\n"], "b": {}}', " [] ", '"x"', "0"],
}
BAD = {
    ".js": [
        "function f( {", "const = 5", "let 82a = 1", "a b", "return );", "<<<<<<< HEAD\na\n=======\nb\n>>>>>>> x", "const a: number = 1", "interface A {}", "x = 'abc\n'", "`abc", "f(a => => b)", "x = “a”", "def f(a):\n  pass", "<div></div>", "{ a: 1, b: 2 }", "if (a) { export default b }", "a = /b", "/* open", "import a form 'b'", "class A { b c }", "}", "f(a,,b)", "o = {a b}", "else { a }",
        "for (a of b of c) {}", "const x", "a + = b",
    ][:-2],
    ".jsx": ["const a = <div><p></div>", "const a = <div>{b</div>", "const a = <div>a > b</div>", "export type A = 'b'"],
    ".ts": ["const a = <div className=\"x\">b</div>;", "let a: = 1", "type = { a: string", "interface A { a b }", "@@ -1,2 +3,4 @@"],
    ".tsx": ["<!DOCTYPE html><html></html>", "const a = <T>(b) => c"],
    ".json": ["", "{a: 1}", "{'a': 1}", '{"a": 1,}', "[1,]", "// x\n{}", "01", "NaN", '{"a" 1}', "{} {}", '"\t"', "[1 2]", "tru"],
}


@pytest.mark.parametrize("ext", GOOD)
def test_valid(ext):
    assert [(s, first_error("a" + ext, s)) for s in GOOD[ext] if first_error("a" + ext, s)] == []


@pytest.mark.parametrize("ext", BAD)
def test_invalid(ext):
    assert [s for s in BAD[ext] if not first_error("a" + ext, s)] == []


def test_kept_statements_change_nothing():
    for s in GOOD[".js"] + BAD[".js"]:
        assert (first_error("a.js", s) is None) == (first_error("b.js", s) is None)


def test_place_of_the_error():
    assert first_error("a.js", "let a = 1\nlet = =\n")[:2] == (2, 7)
    assert first_error("a.json", '{\n "a": x}')[:2] == (2, 7)


def test_rows(spark):
    rows = [("1", "r", "a.js", "js", "("), ("1", "r", "a.js", "js", "("), ("2", "r", "b.js", None, "a()"), ("3", None, "c.json", None, ""), ("4", "r", "d.py", None, "("), ("5", "r", None, None, "("), ("6", "r", "e.ts", None, None), ("7", "r", "f.js", None, "a();\n" * 100_000), ("8", "r", "g.js", None, "(" * 50_000)]
    df = spark.createDataFrame(rows, "id string, repo_id string, path string, language string, content string").selectExpr("*", "1 AS valid")
    assert {r["file_id"]: r["valid"] for r in judged(df).collect()} == {"1": False, "2": True, "3": False, "7": True, "8": False}
    assert judged(df).count() == 5 and judged(df.limit(0)).count() == 0


def test_one_line_bundles_take_time_in_proportion():
    import time

    unit = 'function f(a,b){var c=a?b:[1,2,"x"];for(var i=0;i<c.length;i++){c[i]=g(c[i],{k:a})}return c}var q=f(1,2);q&&f(q=>q+1);'
    took = []
    for n in (500_000, 4_000_000):
        began = time.process_time()
        assert first_error("a.js", unit * (n // len(unit))) is None
        took.append(time.process_time() - began)
    assert took[1] < 16 * took[0] + 1
    assert first_error("a.js", unit * 1000 + "var ;") is not None


def test_deep_nesting_does_not_crash():
    n = 3000
    assert first_error("a.js", "a = " + "`${" * n + "1" + "}`" * n) is None
    assert first_error("a.jsx", "a = " + "<b>{" * n + "1" + "}</b>" * n) is None


def test_assignment_targets():
    for src in ("a + b = c", "a && b.c = d", "-a = 1", "x = 5 = y", "(1 = x)", "5++", "++5", "typeof a = b", "f(null = 1)", "a ? b : 3 = c", "x = a * b = c", "if (a < b = c) d", "'s'++"):
        assert first_error("a.js", src) is not None, src
    good = ["a = b + c", "a = b\n= c", "a ? b : c = d", "x => x = 1", "(a = -b, c = d)", "class A { x = a + b\n y = 1; static z = 2; 'q' = 3; 4 = 5 }", "function* f() { yield* a = b }", "[a = 1, b] = c", "({ a = 1, b: c = 2 } = d)", "a.true = 1; b.this = 2; a[0] = 1; f().x = 3", "i++\nj = 1", "a\n++b", "for (const x in y = z);", "a = b ? 1 : 2, c = d", "x[a + b] = c", "let a = 1, b = a + 2, c = 3", "a = /x/; b = `t`"]
    for src in good:
        assert first_error("a.js", src) is None, (src, first_error("a.js", src))
    for src in ("let a: true = true, b: 5 = 5, c: null = null, d: 's' = 's'", "function f(a: 1 | 2 = 1, b?: typeof c = d) {}", "type A<T = string | B> = T", "enum E { A = 1, B = A + 1, 'c' = 3 }", "class A { a: number = 1; b = this.c - 1\n d = 2 }", "a! = b; (a as B) = c", "let x: A & B = c"):
        assert first_error("a.ts", src) is None, (src, first_error("a.ts", src))
    assert first_error("a.ts", "a + b = c") is not None and first_error("a.ts", "a && b = c") is not None
