"""Top-level statements of scripts: symbols, imports and exports with signatures, parameters, return types and lines.

A text becomes a list of tokens with the partner of each bracket; the statements are then read at bracket depth 0, so
whatever nests deeper (calls of require, dynamic imports) stays unseen, as it should. Each text is read on its own and
whole, below any exchange; equal texts of a batch are read once. Texts whose brackets, strings or comments don't close
give an error and no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules

ITEM = "array<struct<name:string,type:string,signature:string,line_start:int,line_end:int,exports:boolean,parameters:array<string>,return_type:string>>"
IMPORT = "array<struct<source:string,type:string,line_imported:int>>"
EXPORT = "array<struct<name:string,type:string,item:int>>"
PARSED = f"items {ITEM}, imports {IMPORT}, exports {EXPORT}, error string"

_LONG = 240  # characters of a constant's or type's signature
_TOKEN = re.compile(
    r"""\s+|//[^\n]*|/\*[\s\S]*?\*/
    |(?P<s>"(?:[^"\\\n]|\\[\s\S])*"|'(?:[^'\\\n]|\\[\s\S])*')
    |(?P<w>\#?(?:[^\W\d]|[$\\])[\w$\\]*)
    |(?P<n>\.?\d[\w.]*)
    |(?P<p>=>|\.\.\.|\?\.(?!\d)|\+\+|--|[^\s])""",
    re.X,
)
_REGEX = re.compile(r"/(?![*/>])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[A-Za-z]*")
# A tag, unless it looks like the type parameters of an arrow.
_ELEMENT = re.compile(r"<\s*(?:>|[A-Za-z_$](?!\w*\s*(?:,|=\s|extends\s)))")
_KIDS = re.compile(r"[^<{]*")
_TAG = re.compile(r"\s+|//[^\n]*|/\*[\s\S]*?\*/|\"[^\"]*\"|'[^']*'|<[\w$.\[\], |]+>|/>|[^\s]")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*")
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}
# After these words a slash begins a regular expression, and a line end doesn't end a statement.
_PREFIX = {"return", "typeof", "instanceof", "in", "of", "new", "delete", "void", "throw", "case", "do", "else", "yield", "await", "extends", "default", "as", "satisfies", "keyof", "implements", "from"}
# Words that carry on the statement on a new line.
_CARRY = {"in", "instanceof", "as", "satisfies", "extends", "implements", "from", "of", "is"}
_TYPE_PREFIX = {"keyof", "typeof", "readonly", "unique", "infer", "asserts", "new", "abstract"}


class Broken(Exception):
    pass


class Script:
    """Tokens (kind, start, end), texts and bracket partners of one source."""

    def __init__(self, src: str, jsx: bool = False):
        self.src, self.jsx = src, jsx
        self.kind: list[str] = []
        self.text: list[str] = []
        self.at: list[int] = []
        self.to: list[int] = []
        self.pair: dict[int, int] = {}
        self.ends = [m.start() for m in re.finditer("\n", src)]
        self._scan()
        self.n = len(self.text)

    def _scan(self) -> None:
        src, pos, n, stack = self.src, 0, len(self.src), []
        if src.startswith("#!"):
            pos = (src.find("\n") + 1) or n
        while pos < n:
            m = _TOKEN.match(src, pos)
            kind = m.lastgroup
            start, pos = pos, m.end()
            if kind is None:
                continue
            t = m[0]
            if kind == "p":
                if t == "`":
                    pos = self._template(start)
                    kind, t = "t", src[start:pos]
                elif t == "/" and src.startswith("*", pos):
                    raise Broken("unterminated comment")
                elif t in "/<" and self._due(start, self.kind[-1] if self.kind else "", self.text[-1] if self.text else ""):
                    if t == "/" and (r := _REGEX.match(src, start)):
                        pos, kind, t = r.end(), "r", r[0]
                    elif t == "<":
                        pos = self._element(start)
                        kind, t = "t", src[start:pos]
                elif t in _OPEN:
                    stack.append(len(self.text))
                elif t in _CLOSE:
                    if not stack or _OPEN[self.text[stack[-1]]] != t:
                        raise Broken("unbalanced brackets")
                    self.pair[stack.pop()] = len(self.text)
            self.kind.append(kind)
            self.text.append(t)
            self.at.append(start)
            self.to.append(pos)
        if stack:
            raise Broken("unbalanced brackets")

    def _due(self, at: int, kind: str, text: str) -> bool:
        """Whether behind the token (kind, text) an operand is due, so that the slash or angle at `at` begins a regular expression or an element."""
        if self.src[at] == "<" and not (self.jsx and _ELEMENT.match(self.src, at)):
            return False
        return text in _PREFIX if kind == "w" else not kind or kind == "p" and text not in (")", "]", "}", "<", "++", "--")

    def _element(self, pos: int) -> int:
        """Behind the JSX element at pos. Tags, children and braces within lie on a list: ["tag"], ["kids", open tags], ["expr", open braces, kind and text before]."""
        src, n, modes = self.src, len(self.src), [["tag"]]
        pos += 1
        while modes:
            if pos >= n:
                raise Broken("unterminated element")
            mode = modes[-1]
            if mode[0] == "kids":
                pos = _KIDS.match(src, pos).end()
                if src.startswith("{", pos):
                    modes.append(["expr", 0, "", ""])
                    pos += 1
                elif src.startswith("</", pos):
                    pos = (src.find(">", pos) + 1) or n
                    mode[1] -= 1
                    if not mode[1]:
                        modes.pop()
                elif src.startswith("<", pos):
                    modes.append(["tag"])
                    pos += 1
            elif mode[0] == "tag":
                m = _TAG.match(src, pos)
                t, pos = m[0], m.end()
                if t == "{":
                    modes.append(["expr", 0, "", ""])
                elif t == "<":
                    modes.append(["tag"])
                elif t == "/>":
                    modes.pop()
                elif t == ">":
                    modes.pop()
                    if modes and modes[-1][0] == "kids":
                        modes[-1][1] += 1
                    else:
                        modes.append(["kids", 1])
            else:
                m = _TOKEN.match(src, pos)
                kind, t = m.lastgroup, m[0]
                start, pos = pos, m.end()
                if kind is None:
                    continue
                if t == "`":
                    pos = self._template(start)
                elif t in ("/", "<") and self._due(start, mode[2], mode[3]):
                    if t == "<":
                        modes.append(["tag"])
                        kind = "t"
                    elif r := _REGEX.match(src, start):
                        pos, kind = r.end(), "r"
                elif t == "{":
                    mode[1] += 1
                elif t == "}":
                    mode[1] -= 1
                    if mode[1] < 0:
                        modes.pop()
                        continue
                mode[2], mode[3] = kind, t
        return pos

    def _template(self, pos: int) -> int:
        """The end of the template that begins at pos; nested ones lie on a list."""
        src, depth, pos = self.src, [0], pos + 1
        while depth:
            if not depth[-1]:  # in the template's text
                pos = _TEMPLATE.match(src, pos).end()
                if src.startswith("${", pos):
                    depth[-1], pos = 1, pos + 2
                elif src.startswith("`", pos):
                    depth.pop()
                    pos += 1
                else:
                    raise Broken("unterminated template")
                continue
            m = _TOKEN.match(src, pos)
            if not m:
                raise Broken("unterminated template")
            t, pos = m[0], m.end()
            if t == "`":
                depth.append(0)
            elif t == "{":
                depth[-1] += 1
            elif t == "}":
                depth[-1] -= 1
        return pos

    def line(self, i: int, end: bool = False) -> int:
        """The line token i begins or ends on, from 1."""
        return bisect_right(self.ends, self.to[i] - 1 if end else self.at[i]) + 1

    def is_(self, i: int, *texts: str) -> bool:
        return i < self.n and self.text[i] in texts and self.kind[i] in "wp"

    def word(self, i: int) -> bool:
        return i < self.n and self.kind[i] == "w"

    def fresh_line(self, i: int) -> bool:
        return i > 0 and "\n" in self.src[self.to[i - 1] : self.at[i]]

    def slice(self, i: int, j: int) -> str:
        """Source of the tokens i to j - 1, with single blanks."""
        return " ".join(self.src[self.at[i] : self.to[j - 1]].split()) if j > i else ""

    def skip(self, i: int) -> int:
        """Behind the token or bracket group at i."""
        return self.pair[i] + 1 if i in self.pair else i + 1

    def angle(self, i: int) -> int:
        """Behind the type arguments that open at i, or i where it is no such bracket."""
        depth, j = 0, i
        while j < self.n:
            t = self.text[j]
            if t == "<":
                depth += 1
            elif t == ">":
                depth -= 1
                if not depth:
                    return j + 1
            elif t in self.OUT or self.kind[j] in "rt":
                return i
            j = self.skip(j)
        return i

    OUT = {";", "+", "*", "/", "%", "!", "^", "~", "++", "--", ")", "]", "}"}

    def type(self, i: int) -> int:
        """Behind the type that begins at i."""
        while i < self.n:
            while self.is_(i, "|", "&") or self.is_(i, *_TYPE_PREFIX) and (self.word(i + 1) or self.is_(i + 1, "(", "[", "{")):
                i += 1
            if self.is_(i, "<"):
                i = max(self.angle(i), i + 1)
            group = self.is_(i, "(")
            if i >= self.n or not (self.is_(i, "(", "[", "{", "-") or self.kind[i] in "wsnt"):
                return i
            i = self.skip(i)
            while i < self.n:
                if self.is_(i, ".") or self.is_(i, "is") and not self.fresh_line(i):
                    i += 2
                elif self.is_(i, "<") and self.angle(i) > i:
                    i = self.angle(i)
                elif self.is_(i, "[") and not self.fresh_line(i):
                    i = self.skip(i)
                else:
                    break
            if group and self.is_(i, "=>"):
                i += 1
            elif not self.is_(i, "|", "&"):
                return i
        return i

    def over(self, i: int) -> bool:
        """Whether a statement that may end before token i does."""
        if i >= self.n or self.is_(i, ";"):
            return True
        if not self.fresh_line(i):
            return False
        k, t = self.kind[i - 1], self.text[i - 1]
        if k == "p" and t not in (")", "]", "}", "++", "--") or k == "w" and t in _PREFIX and not self.is_(i - 2, "."):
            return False
        if self.kind[i] == "p":
            return self.text[i] in ("{", "@", "++", "--", "...", "~", "!", "#") and not (self.text[i] == "{" and t == ")")
        return self.kind[i] != "t" and not (self.kind[i] == "w" and self.text[i] in _CARRY)

    def expression(self, i: int, comma: bool = True) -> int:
        """Behind the expression at i; a comma ends it if `comma`."""
        start = i
        while i < self.n and not (i > start and self.over(i)) and not self.is_(i, ";"):
            if comma and self.is_(i, ","):
                break
            if self.is_(i, "<") and (j := self.angle(i)) > i and self.is_(j, "(", ">", ")"):
                i = j
                continue
            block = self.is_(i, "{")
            i = self.skip(i)
            # A declaration behind a block on the same line: the block ended the statement.
            if block and self.is_(i, "function", "class", "const", "let", "var", "export", "import") and not self.is_(i - 1, ")"):
                break
        return i

    def parts(self, i: int) -> list[str]:
        """What stands between the brackets at i, cut at commas."""
        out, end, a, j = [], self.pair[i], i + 1, i + 1
        while j < end:
            if self.is_(j, ","):
                out.append(self.slice(a, j))
                a = j + 1
            elif self.is_(j, "<") and (k := self.angle(j)) > j and k <= end and self.is_(k, ",", ")", "=", "|", "&", "[", "{", "("):
                j = k
                continue
            j = self.skip(j)
        out.append(self.slice(a, end))
        return [x for x in out if x]

    def function(self, i: int) -> dict | None:
        """The function expression or arrow at i: its parts and where it ends."""
        j, is_async = i, False
        if self.is_(j, "async") and not self.fresh_line(j + 1) and (self.is_(j + 1, "function", "(", "<") or self.word(j + 1)):
            is_async, j = True, j + 1
        if self.is_(j, "function"):
            j += 1
            star = self.is_(j, "*")
            j += star
            name = self.text[j] if self.word(j) else None
            j += name is not None
            if self.is_(j, "<"):
                j = self.angle(j)
            if not self.is_(j, "("):
                return None
            params, j = self.parts(j), self.skip(j)
            returns = None
            if self.is_(j, ":"):
                k = self.type(j + 1)
                returns, j = self.slice(j + 1, k), k
            body = self.is_(j, "{")
            return {"arrow": False, "async": is_async, "star": star, "name": name, "params": params, "returns": returns, "body": body, "end": self.skip(j) if body else j}
        if self.is_(j, "<"):
            j = self.angle(j)
        returns = None
        if self.is_(j, "("):
            params, j = self.parts(j), self.skip(j)
            if self.is_(j, ":"):
                k = self.type(j + 1)
                returns, j = self.slice(j + 1, k), k
        elif self.word(j):
            params, j = [self.text[j]], j + 1
        else:
            return None
        if not self.is_(j, "=>"):
            return None
        return {"arrow": True, "async": is_async, "star": False, "name": None, "params": params, "returns": returns, "body": True, "end": self.skip(j + 1) if self.is_(j + 1, "{") else self.expression(j + 1)}


def _string(t: str) -> str:
    return re.sub(r"\\([\s\S])", r"\1", t[1:-1])


def _signature(f: dict, name: str, exported: bool, const: bool) -> str:
    """Fixed formats: what the map shows of a function."""
    out, run = "export " if exported else "", "async " if f["async"] else ""
    args = f"({', '.join(f['params'])})" + (f": {f['returns']}" if f["returns"] else "")
    if not const:
        return f"{out}{run}function{'*' if f['star'] else ''} {name}{args}"
    return f"{out}const {name} = {run}{args} =>" if f["arrow"] else f"{out}const {name} = {run}function{'*' if f['star'] else ''}{args}"


class Reader:
    def __init__(self, src: str, jsx: bool = False):
        self.s = Script(src, jsx)
        self.items: list[dict] = []
        self.imports: list[dict] = []
        self.exports: list[dict] = []

    def read(self) -> None:
        s, i = self.s, 0
        while i < s.n:
            if i == 0 or s.is_(i - 1, ";", "}") or s.over(i):
                nxt = self.statement(i)
                if nxt > i:
                    i = nxt
                    continue
            i = s.skip(i)

    def source(self, t: str, i: int) -> None:
        v = _string(t)
        self.imports.append({"source": v, "type": "file" if v[:1] in (".", "/") else "package", "line_imported": self.s.line(i)})

    def item(self, name: str, kind: str, signature: str, a: int, b: int, exported: bool, params: list[str] | None = None, returns: str | None = None) -> int:
        """Add the item of tokens a to b - 1; its number, from 1."""
        s = self.s
        self.items.append({"name": name, "type": kind, "signature": signature, "line_start": s.line(a), "line_end": s.line(max(a, b - 1), True), "exports": exported, "parameters": params or [], "return_type": returns})
        if exported:
            self.export(name, kind, len(self.items))
        return len(self.items)

    def export(self, name: str, kind: str, item: int | None = None) -> None:
        self.exports.append({"name": name, "type": kind, "item": item})

    def required(self, i: int, end: int) -> str | None:
        """The literal of `require('…')`, if tokens i to end - 1 are that call."""
        s = self.s
        while s.is_(i, "(") and s.pair[i] == end - 1:
            i, end = i + 1, end - 1
        return s.text[i + 2] if s.is_(i, "require") and s.is_(i + 1, "(") and s.pair[i + 1] == end - 1 and s.kind[i + 2] == "s" and s.is_(i + 3, ")", ",") else None

    def statement(self, i: int) -> int:
        """Read the statement at i if it tells anything; behind it, or i."""
        s = self.s
        while s.is_(i, "@") and s.word(i + 1):  # decorators
            i += 2
            while s.is_(i, "."):
                i += 2
            if s.is_(i, "("):
                i = s.skip(i)
        if s.is_(i, "import"):
            return self.imported(i)
        if s.is_(i, "export"):
            return self.exported(i)
        if s.is_(i, "require") and s.is_(i + 1, "("):
            end = s.expression(i)
            if t := self.required(i, end):
                self.source(t, i)
            return end
        if s.is_(i, "module") and s.is_(i + 1, ".") and s.is_(i + 2, "exports") and s.is_(i + 3, "=") and not s.is_(i + 4, "="):
            self.export("default", "reference")
            return s.expression(i + 4, False)
        return self.declaration(i, False)

    def imported(self, i: int) -> int:
        s, j = self.s, i + 1
        if s.is_(j, "(", "."):
            return s.expression(i, False)
        while j < s.n and not s.is_(j, ";", "=") and s.kind[j] != "s":
            j = s.skip(j)
        if j < s.n and s.kind[j] == "s":
            self.source(s.text[j], i)
            j += 1
            while s.is_(j, "with", "assert") and s.is_(j + 1, "{"):
                j = s.skip(j + 1)
            return j
        return s.expression(j, False)

    def exported(self, i: int) -> int:
        s, j = self.s, i + 1
        if s.is_(j, "default"):
            return self.default(i, j + 1)
        if s.is_(j, "type") and s.is_(j + 1, "{", "*"):
            j += 1
        if s.is_(j, "*"):
            j = s.skip(j)
            if s.is_(j, "as"):
                j += 2
        elif s.is_(j, "{"):
            for part in self.specifiers(j):
                self.export(part, "reference")
            j = s.skip(j)
        else:
            end = self.declaration(j, True)
            return end if end > j else s.expression(j, False)
        if s.is_(j, "from") and j + 1 < s.n and s.kind[j + 1] == "s":
            self.source(s.text[j + 1], i)
            j += 2
        return j

    def specifiers(self, i: int) -> list[str]:
        """The outward names in the braces at i: of each part the last word or literal."""
        s, out, last = self.s, [], None
        for j in range(i + 1, s.pair[i] + 1):
            if j == s.pair[i] or s.is_(j, ","):
                if last is not None:
                    out.append(_string(s.text[last]) if s.kind[last] == "s" else s.text[last])
                last = None
            else:
                last = j
        return out

    def default(self, i: int, j: int) -> int:
        s = self.s
        f = s.function(j)
        if f and not f["arrow"] and f["body"]:
            name = f["name"] or "default"
            self.export("default", "function", self.item(name, "function", _signature(f, name, True, False), j, f["end"], True, f["params"], f["returns"]))
            return f["end"]
        if s.is_(j, "class") or s.is_(j, "abstract") and s.is_(j + 1, "class"):
            end = self.declaration(j, True)
            self.export("default", "class", len(self.items))
            return end
        end = s.expression(j, False)
        if end == j + 1 and s.word(j):
            self.export("default", "reference")
            return end
        inner = j + 1 if s.is_(j, "(") and s.pair[j] == end - 1 else j
        f = s.function(inner)
        kind = "function" if f else "class" if inner > j and s.is_(inner, "class") else "constant"
        text = " ".join(s.src[s.at[j] : min(s.to[end - 1], s.at[j] + _LONG)].split()) if end > j else ""
        n = len(self.items) + 1
        self.items.append({"name": "default", "type": kind, "signature": text, "line_start": s.line(i), "line_end": s.line(max(i, end - 1), True), "exports": True, "parameters": f["params"] if f else [], "return_type": f["returns"] if f else None})
        self.export("default", kind, n)
        return end

    def declaration(self, i: int, exported: bool) -> int:
        s, j = self.s, i
        if s.is_(j, "declare") and s.word(j + 1) and not s.fresh_line(j + 1):
            j += 1
        if s.is_(j, "function") or s.is_(j, "async") and s.is_(j + 1, "function"):
            f = s.function(j)
            if not f:
                return i
            if f["body"] and j == i:
                name = f["name"] or "default"
                self.item(name, "function", _signature(f, name, exported, False), j, f["end"], exported, f["params"], f["returns"])
            return f["end"]
        k = j + 1 if s.is_(j, "abstract") else j
        if s.is_(k, "class"):
            body = k + 1
            name = s.text[body] if s.word(body) and not s.is_(body, "extends", "implements") else "default"
            while body < s.n and not s.is_(body, "{"):
                body = max(s.angle(body), body + 1) if s.is_(body, "<") else s.skip(body)
            end = s.skip(body)
            self.item(name, "class", s.slice(i, body), i, min(end, s.n), exported)
            return end
        k = j + 1 if s.is_(j, "const") else j
        if s.is_(k, "enum") and s.word(k + 1) and s.is_(k + 2, "{"):
            end = s.skip(k + 2)
            self.item(s.text[k + 1], "enum", f"enum {s.text[k + 1]}", i, end, exported)
            return end
        if s.is_(j, "const", "let", "var") and (s.word(j + 1) or s.is_(j + 1, "{", "[")):
            return self.variables(j, exported)
        if s.is_(j, "interface") and s.word(j + 1):
            body = j + 2
            while body < s.n and not s.is_(body, "{", ";", "="):
                body = max(s.angle(body), body + 1) if s.is_(body, "<") else s.skip(body)
            if not s.is_(body, "{"):
                return i
            end = s.skip(body)
            self.item(s.text[j + 1], "interface", f"interface {s.text[j + 1]}", i, end, exported)
            return end
        if s.is_(j, "type") and s.word(j + 1) and not s.fresh_line(j + 1):
            k = s.angle(j + 2) if s.is_(j + 2, "<") else j + 2
            if not s.is_(k, "="):
                return i
            end = s.expression(k + 1, False)
            end += s.is_(end, ";")
            self.item(s.text[j + 1], "type", s.slice(i, end)[:_LONG], i, end, exported)
            return end
        return i

    def variables(self, i: int, exported: bool) -> int:
        s, j = self.s, i + 1
        while j < s.n:
            a, name = j, s.text[j] if s.word(j) else None
            j = s.skip(j)
            j += s.is_(j, "!")
            if s.is_(j, ":"):
                j = s.type(j + 1)
                while j < s.n and not s.is_(j, "=", ",", ";") and not s.over(j):  # conditional and other odd types
                    j = s.skip(j)
            f = None
            if s.is_(j, "="):
                first, end = j + 1, s.expression(j + 1)
                if t := self.required(first, end):
                    self.source(t, i)
                inner = first + 1 if s.is_(first, "(") and s.pair[first] == end - 1 else first
                f = s.function(inner)
                if f and f["end"] != (end - 1 if inner > first else end):
                    f = None if not f["arrow"] else f
                j = end
            if name is not None:
                if f:
                    self.item(name, "function", _signature(f, name, exported, True), a, j, exported, f["params"], f["returns"])
                else:
                    self.item(name, "constant", s.slice(a, j)[:_LONG], a, j, exported)
            if not s.is_(j, ","):
                return j
            j += 1
        return j


def parse(src: str, jsx: bool = False) -> tuple[list[dict], list[dict], list[dict], str | None]:
    """(items, imports, exports, error) of a source."""
    try:
        r = Reader(src, jsx)
        r.read()
    except Broken as e:
        return [], [], [], str(e)
    return r.items, r.imports, r.exports, None


def _run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        seen: dict[tuple[str, bool], tuple] = {}
        rows = []
        for key in zip(b.pop("_content"), b.pop("_jsx")):
            if key[0] is None:
                rows.append(([], [], [], None))
                continue
            if key not in seen:
                seen[key] = parse(*key)
            rows.append(seen[key])
        yield b.assign(**{n: pd.Series([r[k] for r in rows], index=b.index, dtype=object) for k, n in enumerate(("items", "imports", "exports", "error"))})


def parsable(path: Column) -> Column:
    return path.rlike(r"\.(?:" + "|".join(e[1:] for e in rules.CODE_EXTS) + ")$")


def extract(files: DataFrame, *keep: str) -> DataFrame:
    """keep plus functions (with ids), imports, exported and error for every row of files (id, path, content).

    Null contents and files that are no scripts get empty arrays, as do texts that don't parse (error tells why). Columns
    of files called items, imports, exports or error are not read; those in keep must have other names.
    """
    kinds = dict(files.dtypes)
    asked = files.select(F.col("id").alias("_id"), *keep, F.when(parsable(F.col("path")), F.col("content")).alias("_content"), F.coalesce(F.col("path").rlike(r"\.[jt]sx$"), F.lit(False)).alias("_jsx"))
    schema = f"_id {kinds['id']}, " + "".join(f"`{c}` {kinds[c]}, " for c in keep) + PARSED
    got = asked.mapInPandas(_run, schema)
    number = lambda n: F.concat(F.regexp_replace("_id", "^file_", "func_"), F.lit("_"), F.format_string("%02d", n))
    functions = F.transform(
        "items",
        lambda x, n: F.struct(number(n + 1).alias("id"), x["name"].alias("name"), x["type"].alias("type"), x["signature"].alias("signature"), x["line_start"].alias("line_start"), x["line_end"].alias("line_end"), F.lit("").alias("description"), x["exports"].alias("exports"), x["parameters"].alias("parameters"), x["return_type"].alias("return_type")),
    )
    exported = F.transform("exports", lambda e: F.struct(e["name"].alias("name"), e["type"].alias("type"), F.when(e["item"].isNotNull(), number(e["item"])).alias("id")))
    return got.select(F.col("_id").alias("id"), *keep, functions.alias("functions"), "imports", exported.alias("exported"), "error")
