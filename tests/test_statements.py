"""Statements of scripts against hand-written values."""

from srcatlas.operators.statements import extract, parse


def names(src, jsx=False):
    items, imports, exports, error = parse(src, jsx)
    assert error is None
    return [(x["name"], x["type"]) for x in items], [(x["source"], x["type"], x["line_imported"]) for x in imports], [(x["name"], x["type"]) for x in exports]


def one(src):
    return parse(src)[0][0]


def test_component():
    src = "import React from 'react';\nimport { Button } from \"./components/Button\";\n\nexport function Title({ text }) {\n  return <h1>{text} don't (stop</h1>;\n}\n\nexport default function App() {\n  const x = require('nested');\n  return (<div className=\"a\"><Title text=\"hi\" />{a < b}</div>);\n}\n"
    assert names(src, True) == ([("Title", "function"), ("App", "function")], [("react", "package", 1), ("./components/Button", "file", 2)], [("Title", "function"), ("App", "function"), ("default", "function")])
    title = one(src.replace("don't (stop", ""))
    assert (title["signature"], title["line_start"], title["line_end"], title["parameters"], title["exports"]) == ("export function Title({ text })", 4, 6, ["{ text }"], True)


def test_commonjs():
    src = "const jwt = require('jsonwebtoken');\nconst { findUser } = require(\"../db/users\"), other = 5;\nrequire('./boot');\nrequire('dotenv').config();\nasync function authenticate(req, res, next) { next(); }\nmodule.exports = { authenticate };\nexports.foo = 1;\nmodule.exports.bar = 2;\n"
    assert names(src) == ([("jwt", "constant"), ("other", "constant"), ("authenticate", "function")], [("jsonwebtoken", "package", 1), ("../db/users", "file", 2), ("./boot", "file", 3)], [("default", "reference")])
    assert parse(src)[0][2]["signature"] == "async function authenticate(req, res, next)"


def test_api_route():
    x = one("export default async function handler(req: Req, res: Res<{ a: 1 }>): Promise<void> {\n}\n")
    assert (x["signature"], x["return_type"], x["parameters"]) == ("export async function handler(req: Req, res: Res<{ a: 1 }>): Promise<void>", "Promise<void>", ["req: Req", "res: Res<{ a: 1 }>"])


def test_types():
    src = "export interface User<T extends object> extends Base { id: string; f(): void }\nexport type Role = 'admin'\n  | 'user';\nexport class UserService<T> extends Base<Map<string, T>> implements A, B {\n  find(id: string): User { return null }\n}\nexport const VERSION: string = '1.0';\nexport const enum E { A, B }\ndeclare function h(a: string): void;\nfunction over(a: string): string;\nfunction over(a: number): { x: number } | null { return null }\nabstract class Abs {}\nexport { a as b, c, default as d, type T } from './x'\nexport * from './y'; export * as ns from './z'\nimport old = require('old')\n"
    items, imports, exports = names(src)
    assert items == [("User", "interface"), ("Role", "type"), ("UserService", "class"), ("VERSION", "constant"), ("E", "enum"), ("over", "function"), ("Abs", "class")]
    assert [s for s, _, _ in imports] == ["./x", "./y", "./z"]
    assert exports == [("User", "interface"), ("Role", "type"), ("UserService", "class"), ("VERSION", "constant"), ("E", "enum"), ("b", "reference"), ("c", "reference"), ("d", "reference"), ("T", "reference")]
    signs = [x["signature"] for x in parse(src)[0]]
    assert signs == ["interface User", "type Role = 'admin' | 'user';", "class UserService<T> extends Base<Map<string, T>> implements A, B", "VERSION: string = '1.0'", "enum E", "function over(a: number): { x: number } | null", "abstract class Abs"]
    assert (parse(src)[0][1]["line_start"], parse(src)[0][1]["line_end"]) == (2, 3)


def test_declarators():
    src = "export const f = <T,>(a: Map<string, number>, b = (x, y) => x): Promise<void> => { return }, g = async y => { await y };\nlet h = function* (x) { return x }, i = function () {}(), q = new Map<string, number>(), r = a < b ? 1 : 2\nvar long = '" + "x" * 300 + "'\n"
    assert names(src)[0] == [("f", "function"), ("g", "function"), ("h", "function"), ("i", "constant"), ("q", "constant"), ("r", "constant"), ("long", "constant")]
    items = parse(src)[0]
    assert items[0]["signature"] == "export const f = (a: Map<string, number>, b = (x, y) => x): Promise<void> =>" and items[0]["return_type"] == "Promise<void>"
    assert items[1]["signature"] == "export const g = async (y) =>" and items[2]["signature"] == "const h = function*(x)" and len(items[6]["signature"]) == 240


def test_default_exports():
    assert names("export default () => 1")[2] == [("default", "function")]
    assert names("export default class extends X {}")[2] == [("default", "class"), ("default", "class")]
    assert names("export default function (a) {}")[2] == [("default", "function"), ("default", "function")]
    assert names("const a = 1\nexport default a\n")[2] == [("default", "reference")]
    assert one("export default {\n a: 1\n};")["signature"] == "{ a: 1 }" and one("export default {a}")["type"] == "constant"


def test_minified():
    src = '"use strict";var a=require("x"),b=function(){return/[/"]/.test("a")},c=`t ${`n ${1}`} }`;function d(){}class e{}if(a){}const f=1;module.exports=d'
    assert names(src) == ([("a", "constant"), ("b", "function"), ("c", "constant"), ("d", "function"), ("e", "class"), ("f", "constant")], [("x", "package", 1)], [("default", "reference")])
    assert [x["line_imported"] for x in parse("import a from 'a'\n\n\nimport './b'")[1]] == [1, 4]


def test_broken_and_odd():
    for src in ("function (", "a = `x ${", "/* never", "}", "x = (]"):
        assert parse(src)[3] and parse(src)[:3] == ([], [], [])
    assert parse("") == ([], [], [], None) and parse("\n// only\n")[3] is None
    deep = "x = " + "[" * 5000 + "]" * 5000
    assert names(deep + "\nconst a = 1")[0] == [("a", "constant")]
    assert parse("x = " + "`${" * 3000 + "1" + "}`" * 3000)[3] is None


def test_table(spark):
    rows = [("file_001", "a.js", "const a = 1, b = 2"), ("file_002", "b.md", "const a = 1"), ("file_003", "c.ts", None), (None, "d.js", "("), ("file_001", "a.js", "const a = 1, b = 2"), ("x", None, "const c = 1")]
    got = extract(spark.createDataFrame(rows, "id string, path string, content string").selectExpr("*", "1 AS items"), "path").collect()
    assert [[f["id"] for f in r["functions"]] for r in got] == [["func_001_01", "func_001_02"], [], [], [], ["func_001_01", "func_001_02"], []]
    assert [r["error"] is None for r in got] == [True, True, True, False, True, True]
    assert extract(spark.createDataFrame([], "id string, path string, content string")).count() == 0
