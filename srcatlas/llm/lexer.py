"""Token streams of scripts (JavaScript, TypeScript, with or without JSX) and of JSON.

A stream is one character per token, with a line feed where line ends stand between two tokens; what
the parser needs is in these characters alone, so equal streams parse alike. Whatever takes more than
one token of lookahead in the grammar is told apart here: regular expressions from division by the
token before, arrow parameters by the arrow behind their closing bracket, type arguments by what can
stand in them, contextual words by their neighbours.
"""

from __future__ import annotations

import re

NL, EOF, BAD = "\n", "\0", "\1"

_WORDS = """break case catch class const continue debugger default delete do else export extends finally for function if import in
instanceof new return super switch this throw try typeof var void while with null true false yield await enum""".split()  # fixed values: reserved words
_SOFT = """async get set static let of from as satisfies type interface namespace module declare abstract readonly public private
protected override accessor keyof unique infer asserts is implements""".split()  # fixed values: words reserved by position

KINDS: dict[str, str] = {c: c for c in "(){}[];,.<>=+-*/%&|^!~?:@"}
KINDS |= {"IDENT": "I", "NUMBER": "N", "STRING": "S", "TEMPLATE": "T", "REGEX": "R", "PRIVATE": "P", "EOF": EOF}
_CLASSES = """=> ... ?. INC BINOP ASSIGNOP ARROW( ARROWID GENERIC( ASYNCFN ASYNCAR ASYNCM GETSET STATIC LET OF FROM AS TYPE TYPEMOD INTERFACE
NAMESPACE DECLARE ABSTRACT MOD TPFX IS IMPL INDEX MAPPED FOR3 FOREACH IMPORTX BANGNL PREINC T< T> QHEAD QMID QTAIL JBEGIN JOPEN JCLOSE JEND""".split()
KINDS |= {t: chr(0xE000 + i) for i, t in enumerate([*_CLASSES, *_WORDS])}
_SOFTK = {t: chr(0xE200 + i) for i, t in enumerate(_SOFT)}
K = KINDS
KEYWORDS = "".join(K[w] for w in _WORDS) + K["FOR3"] + K["FOREACH"] + K["IMPORTX"]
SOFT = "".join(_SOFTK.values())
_NAME = "I" + KEYWORDS + SOFT
_BINOPS = "== != === !== <= >= << && || ?? ** % ^".split()
_SHIFTS = ">> >>>".split()
_ASSIGNS = "+= -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split()

_BLANK = r"[ \t\v\f ﻿  -   　]*"
_NUM = r"(?:0[xX][\da-fA-F_]+n?|0[bB][01_]+n?|0[oO][0-7_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?)(?![\w$])"
_ID = r"(?:[A-Za-z_$]|[^\W\d]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})(?:[\w$‌‍]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})*"
_STR = r"'(?:[^'\\\r\n]|\\(?:\r\n|[\s\S]))*'" + r'|"(?:[^"\\\r\n]|\\(?:\r\n|[\s\S]))*"'
_TPL = r"`(?:[^`\\$]|\\[\s\S]|\$(?!\{))*`"
_COMMENT = r"//[^\r\n  ]*|/\*[\s\S]*?\*/"


def _ops(shifts: bool) -> str:
    ops = [*_BINOPS, *_ASSIGNS, "=>", "...", "++", "--", *(_SHIFTS if shifts else [])]
    return "|".join(re.escape(o) for o in sorted(ops, key=len, reverse=True)) + r"|\?\.(?!\d)"


def _master(ts: bool, jsx: bool) -> re.Pattern:
    stop = r"[`/" + ("<" if jsx else "") + "]"
    single = r"[(){}\[\];,.=+\-*%&|^!~?:@>" + ("" if jsx else "<") + "]"
    ops = _ops(not ts)
    if jsx:
        ops = "|".join(o for o in ops.split("|") if not o.startswith(("<", "/")))
    else:
        ops = "|".join(o for o in ops.split("|") if not o.startswith("/"))
    return re.compile(rf"{_BLANK}((?:[\r\n  ]\s*)|{_ID}|{_NUM}|{_STR}|{_TPL}|{_COMMENT}|{ops}|{single}|#{_ID}|{stop}|[^\s]|$)")


_REGEX = re.compile(r"/(?:[^/\\\[\r\n  ]|\\[^\r\n  ]|\[(?:[^\]\\\r\n  ]|\\[^\r\n  ])*\])+/[A-Za-z]*")
_TPL_PART = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*")
_JSX_NAME = re.compile(r"[A-Za-z_$][\w$-]*(?:[.:][A-Za-z_$][\w$-]*)*")
_JSX_GAP = re.compile(r"(?:\s|/\*[\s\S]*?\*/|//[^\r\n]*)*")
_JSX_TEXT = re.compile(r"[^<{>}]*")
_JSX_STR = re.compile(r"'[^']*'|\"[^\"]*\"")


class _Map(dict):
    """Token text to its character; names seen are kept, up to a bound."""

    def __missing__(self, t: str) -> str:
        c = t[:1]
        if c in "\r\n  ":
            return NL if c else ""
        if c == "/":
            return "" if t[1:2] == "/" else (NL if "\n" in t or "\r" in t else "") if t[1:2] == "*" else BAD
        if c in "'\"":
            return "S" if len(t) > 1 else BAD
        if c == "`":
            return "T" if len(t) > 1 else BAD
        if c.isdigit() or c == "." and len(t) > 1:
            return "N" if not t.endswith("_") and "__" not in t else BAD
        if c == "#":
            return "P" if len(t) > 1 else BAD
        if c.isalpha() or c in "_$\\" and (len(t) > 1 or c != "\\"):
            if len(self) < 100_000:
                self[t] = "I"
            return "I"
        return BAD


TOKENS = _Map(KINDS_ := {w: K[w] for w in _WORDS} | _SOFTK | {c: c for c in "(){}[];,.<>=+-*%&|^!~?:@/"})
TOKENS |= {o: K["BINOP"] for o in [*_BINOPS, *_SHIFTS, "%", "^"]} | {o: K["ASSIGNOP"] for o in _ASSIGNS}
TOKENS |= {"=>": K["=>"], "...": K["..."], "?.": K["?."], "++": K["INC"], "--": K["INC"]}
KINDS["%"] = KINDS["^"] = K["BINOP"]

#: After these a slash divides and an angle bracket compares.
_ENDS = frozenset("INSTRP)]}" + SOFT + K["JEND"] + K["QTAIL"] + "".join(K[w] for w in "this super null true false".split()) + K["INC"])
_MASTERS = {(ts, jsx): _master(ts, jsx) for ts in (False, True) for jsx in (False, True)}


class LexError(Exception):
    def __init__(self, at: int, why: str):
        super().__init__(why)
        self.at = at


class _Lexer:
    def __init__(self, src: str, ts: bool, jsx: bool):
        self.src, self.ts, self.jsx = src, ts, jsx
        self.match = _MASTERS[ts, jsx].match
        self.out: list[str] = []
        self.at: list[int] = []

    def last(self) -> str:
        for k in reversed(self.out):
            if k and k != NL:
                return k
        return ""

    def code(self, pos: int, closing: bool) -> int:
        """Tokens from pos to the end, or to the brace that closes what surrounds them."""
        src, match, out, at, tokens, n = self.src, self.match, self.out, self.at, TOKENS, len(self.src)
        depth = 0
        while pos < n:
            m = match(src, pos)
            t = m[1]
            end = m.end()
            start = end - len(t)
            k = tokens[t]
            if k == "/" or k == BAD or k == "<" and self.jsx:
                if k == "/":
                    if self.last() in _ENDS:
                        if src.startswith("/=", start):
                            k, end = K["ASSIGNOP"], start + 2
                        out.append(k)
                        at.append(start)
                        pos = end
                        continue
                    r = _REGEX.match(src, start)
                    if not r:
                        raise LexError(start, "unterminated regular expression")
                    out.append("R")
                    at.append(start)
                    pos = r.end()
                    continue
                if k == "<":
                    if self.last() not in _ENDS and not (self.ts and re.compile(r"<\s*[A-Za-z_$][\w$]*\s*(,|extends\s|=\s)").match(src, start)):
                        pos = self.element(start)
                        continue
                    for o in ("<<=", "<<", "<="):
                        if src.startswith(o, start):
                            k, end = tokens[o], start + len(o)
                            break
                    out.append(k)
                    at.append(start)
                    pos = end
                    continue
                if t == "`":
                    pos = self.template(start)
                    continue
                raise LexError(start, "unexpected character" if t not in "'\"" else "unterminated string")
            if closing:
                if k == "{":
                    depth += 1
                elif k == "}":
                    if not depth:
                        return start
                    depth -= 1
            if k:
                out.append(k)
                at.append(start)
            pos = end
        if closing:
            raise LexError(n, "unexpected end")
        return pos

    def template(self, pos: int) -> int:
        src, head = self.src, True
        pos += 1
        while True:
            end = _TPL_PART.match(src, pos).end()
            if src.startswith("${", end):
                self.put(K["QHEAD"] if head else K["QMID"], end)
                head = False
                pos = self.code(end + 2, True) + 1
            elif src.startswith("`", end):
                self.put("T" if head else K["QTAIL"], end)
                return end + 1
            else:
                raise LexError(len(src), "unterminated template")

    def put(self, k: str, at: int) -> None:
        self.out.append(k)
        self.at.append(at)

    def gap(self, pos: int) -> int:
        return _JSX_GAP.match(self.src, pos).end()

    def element(self, pos: int) -> int:
        """A JSX element or fragment with its children; nesting is kept on a list, not on the call stack."""
        src, open_tags = self.src, []
        while True:
            # An opening tag at pos.
            self.put(K["JBEGIN"], pos)
            at = self.gap(pos + 1)
            m = _JSX_NAME.match(src, at)
            name = m[0] if m else ""
            at = self.gap(m.end()) if m else at
            closed = False
            while not src.startswith(">", at):
                if name and src.startswith("/", at) and src.startswith(">", self.gap(at + 1)):
                    at, closed = self.gap(at + 1), True
                    break
                if name and src.startswith("{", at):
                    at = self.container(at)
                elif name and (a := _JSX_NAME.match(src, at)):
                    at = self.gap(a.end())
                    if src.startswith("=", at):
                        at = self.gap(at + 1)
                        if s := _JSX_STR.match(src, at):
                            at = s.end()
                        elif src.startswith("{", at):
                            at = self.container(at)
                        elif src.startswith("<", at):
                            at = self.element(at)
                        else:
                            raise LexError(at, "bad attribute")
                else:
                    raise LexError(at, "bad tag")
                at = self.gap(at)
            pos = at + 1
            if closed:
                self.put(K["JEND"], at)
                if not open_tags:
                    return pos
            else:
                open_tags.append(name)
            while open_tags:
                pos = _JSX_TEXT.match(src, pos).end()
                if src.startswith("{", pos):
                    pos = self.container(pos)
                elif src.startswith("<", pos):
                    at = self.gap(pos + 1)
                    if not src.startswith("/", at):
                        break
                    at = self.gap(at + 1)
                    m = _JSX_NAME.match(src, at)
                    if (m[0] if m else "") != open_tags[-1]:
                        raise LexError(at, "closing tag doesn't match")
                    at = self.gap(m.end()) if m else at
                    if not src.startswith(">", at):
                        raise LexError(at, "bad closing tag")
                    open_tags.pop()
                    self.put(K["JEND"], at)
                    pos = at + 1
                    if not open_tags:
                        return pos
                else:
                    raise LexError(pos, "unexpected end" if pos >= len(src) else "brace or angle in text")

    def container(self, pos: int) -> int:
        self.put(K["JOPEN"], pos)
        end = self.code(pos + 1, True)
        self.put(K["JCLOSE"], end)
        return end + 1


_PAIRS = {")": "(", "]": "[", "}": "{", K["JCLOSE"]: K["JOPEN"], K["QMID"]: K["QHEAD"], K["QTAIL"]: K["QHEAD"]}
_OPEN = frozenset("([{" + K["JOPEN"] + K["QHEAD"])
_DROP_SOFT = {ord(c): "I" for c in SOFT}
_TYPEISH = frozenset("INST.,|&[]{}:;?()=-" + NL + SOFT + "".join(K[x] for x in "=> ... extends null true false this void typeof new in const ARROW( IMPORTX QHEAD QMID QTAIL".split()))
_TYPE_START = "ISNT{([" + SOFT + "<" + "".join(K[x] for x in "this null void typeof const true false new QHEAD T< ARROW( GENERIC(".split())


def _matching(k: list[str]) -> list[int]:
    """For each opening bracket its closing one and the reverse; -1 without."""
    out, stack = [-1] * len(k), []
    for i, c in enumerate(k):
        if c in _OPEN:
            stack.append(i)
        elif c in _PAIRS and stack:
            if k[stack[-1]] == _PAIRS[c] or c in (K["QMID"], K["QTAIL"]) and k[stack[-1]] == K["QMID"]:
                j = stack.pop()
                out[i], out[j] = j, i
                if c == K["QMID"]:
                    stack.append(i)
    return out


def _prev(k: list[str], i: int) -> int:
    i -= 1
    return i - 1 if i >= 0 and k[i] == NL else i


def _next(k: list[str], i: int) -> int:
    i += 1
    return i + 1 if k[i] == NL else i


def _types(k: list[str], jsx: bool) -> None:
    """Angle brackets around types."""
    done = -1  # up to here the brackets belong to the types found last
    for i, c in enumerate(k):
        if c != "<" or i <= done:
            continue
        depth, j, opened, pairs, nest = 1, i + 1, [i], [], []
        while True:
            c = k[j]
            if c == "<":
                opened.append(j)
            elif c == ">":
                pairs.append((opened.pop(), j))
                if not opened:
                    break
            elif c not in _TYPEISH:
                break
            elif c in "([{":
                nest.append(c)
            elif c in ")]}":
                if not nest or nest.pop() != _PAIRS[c]:
                    break
            elif c == ";" and "{" not in nest:
                break
            j += 1
        if opened:
            continue
        p, n = _prev(k, i), _next(k, j)
        operand = k[n] in "INSR" or k[n] == "!" or k[n] in (K["this"], K["new"], K["null"], K["true"], K["false"], K["typeof"])
        prefix = p < 0 or k[p] not in _ENDS and k[p] != K["T>"]
        if not prefix and operand and k[j + 1] != NL:
            continue
        if prefix and jsx and k[n] != "(":
            continue
        for a, b in pairs:
            k[a], k[b] = K["T<"], K["T>"]
        done = j
        if k[n] == "(" and (prefix or k[p] == _SOFTK["async"]):
            k[i] = K["T<"] + "?"  # settled once arrows are known


def _arrows(k: list[str], match: list[int], ts: bool) -> None:
    for i, c in enumerate(k):
        if c != K["=>"]:
            continue
        p = _prev(k, i)
        if p < 0:
            continue
        if k[p] == ")" and match[p] >= 0:
            k[match[p]] = K["ARROW("]
            q = _prev(k, match[p])
            if q < 0 or not (ts and k[q] == ":"):
                continue
            # What ends in `(...) =>` may itself be the return type of an arrow before it; that one gets its own `=>`.
            continue
        if ts and (q := _return_type(k, match, p)) >= 0:
            k[q] = K["ARROW("]
        elif k[p] == "I" or k[p] in SOFT:
            k[p] = K["ARROWID"]


def _return_type(k: list[str], match: list[int], p: int) -> int:
    """The opening bracket of arrow parameters whose return type ends at p, or -1."""
    angle = 0
    while p >= 0:
        c = k[p]
        if c == ":" and not angle:
            q = _prev(k, p)
            return match[q] if q >= 0 and k[q] == ")" else -1
        if c == K["T>"]:
            angle += 1
        elif c[0] == K["T<"]:
            angle -= 1
            if angle < 0:
                return -1
        elif c in ")]}" and match[p] >= 0:
            p = match[p]
        elif c in "INST.|&-?" or c in SOFT or c in (NL, K["null"], K["this"], K["void"], K["true"], K["false"], K["typeof"], K["extends"], K["=>"]) or angle and c in ",:":
            pass
        else:
            return -1
        p = _prev(k, p)
    return -1


def _fors(k: list[str], match: list[int]) -> None:
    for i, c in enumerate(k):
        if c != K["for"]:
            continue
        o = _next(k, i)
        if k[o] == K["await"]:
            o = _next(k, o)
        if k[o] != "(" or match[o] < 0:
            continue
        j, of, semi = o + 1, -1, False
        while j < match[o]:
            if k[j] in _OPEN and match[j] > 0:
                j = match[j]
            elif k[j] == ";":
                semi = True
                break
            elif of < 0 and j > o + 1 and k[j] in (_SOFTK["of"], K["in"]):
                of = j
            j += 1
        if semi:
            k[i] = K["FOR3"]
        elif of > 0:
            k[i] = K["FOREACH"]
            if k[of] != K["in"]:
                k[of] = K["OF"]


_IDS = "I" + SOFT
_KEYS = _NAME + "SNP"


def _soft(k: list[str], match: list[int], ts: bool) -> None:
    """Words reserved by position."""
    S, n = _SOFTK, len(k)
    mods = {S[w] for w in "readonly public private protected override accessor declare abstract".split()}
    pfx = {S[w] for w in "keyof unique infer asserts".split()}
    lead = "{,;}" + NL + K["MOD"] + K["STATIC"]
    for i, c in enumerate(k):
        if c not in SOFT or not c:
            continue
        raw = k[i + 1]
        nx = k[_next(k, i)] if raw == NL else raw
        pi = _prev(k, i)
        pv = k[pi] if pi >= 0 else ""
        new = "I"
        if pv == "." or pv == K["?."]:
            pass
        elif c == S["async"]:
            if raw == K["function"]:
                new = K["ASYNCFN"]
            elif raw in (K["ARROWID"], K["ARROW("], K["GENERIC("]):
                new = K["ASYNCAR"]
            elif raw in _KEYS and raw not in (K["in"], K["instanceof"], K["of"] if "of" in K else "") and pv in "{,;}" + K["STATIC"] + K["MOD"] + ")" or raw in "*[" and (pv in ("{", ",", ";", "}", K["STATIC"], K["MOD"])):
                new = K["ASYNCM"]
        elif c == S["get"] or c == S["set"]:
            if raw in _KEYS and raw not in (K["in"], K["instanceof"]) or raw == "[" and pv in ("{", ",", "}", K["STATIC"]):
                new = K["GETSET"]
        elif c == S["static"]:
            if raw in _KEYS or raw in "{*[":
                new = K["STATIC"]
        elif c == S["let"]:
            if nx in _IDS or nx in "[{" or nx in (K["yield"], K["await"]):
                new = K["LET"]
        elif c == S["from"]:
            if nx == "S" and (pv in _IDS + "*}"):
                new = K["FROM"]
        elif c == S["as"]:
            if pv == "*" or pv and (pv in _NAME or pv == "S") and nx and (nx in _NAME or nx == "S") and _in_spec(k, i, match):
                new = K["AS"]
            elif ts and raw != NL and pv in _ENDS | {"!", K["T>"], K["ASYNCAR"]} and k[i - 1] != NL and nx and nx in _TYPE_START:
                new = K["AS"]
        elif not ts:
            pass
        elif c == S["satisfies"]:
            if pv in _ENDS and k[i - 1] != NL and nx in _TYPE_START:
                new = K["AS"]
        elif c == S["type"]:
            if pv in (K["import"], K["export"]) and (raw in _IDS or raw in "{*") and not (raw == S["from"]):
                new = K["TYPEMOD"] if raw in "{*" or pv == K["import"] else K["TYPE"]
            elif raw in _IDS and pv in ("{", ",") and _in_spec(k, i, match):
                new = K["TYPEMOD"]
            elif raw in _IDS and k[_next(k, i + 1)][0] in ("=", K["T<"]):
                new = K["TYPE"]
        elif c == S["interface"]:
            if raw in _IDS:
                new = K["INTERFACE"]
        elif c in (S["namespace"], S["module"]):
            if raw in _IDS + "S" and k[_next(k, i + 1)] in ("{", "."):
                new = K["NAMESPACE"]
        elif c == S["declare"] and raw in (K["const"], K["var"], K["function"], K["class"], K["enum"], *(S[w] for w in "let abstract interface type namespace module async".split())):
            new = K["DECLARE"]
        elif c == S["declare"] and raw == "I" and k[_next(k, i + 1)] == "{":
            new = K["DECLARE"]
        elif c == S["abstract"] and raw == K["class"]:
            new = K["ABSTRACT"]
        elif c in mods:
            if raw in _KEYS and raw not in (K["in"], K["instanceof"]) or raw in "[{*" and (pv in "{;,}(:|" or k[i - 1] == NL) or c == S["readonly"] and raw in "[(" or raw in (K["INDEX"], K["MAPPED"]):
                new = K["MOD"]
        elif c in pfx:
            if raw in _TYPE_START:
                new = K["TPFX"]
        elif c == S["is"]:
            if (pv == "I" or pv == K["this"]) and raw in _TYPE_START:
                new = K["IS"]
        elif c == S["implements"]:
            if nx in _IDS and (pv in _IDS or pv in (")", "}", K["T>"], K["class"])):
                new = K["IMPL"]
        k[i] = new


def _in_spec(k: list[str], i: int, match: list[int]) -> bool:
    """Within the braces of an import or export."""
    while i >= 0:
        c = k[i]
        if c == "{":
            p = _prev(k, i)
            return p >= 0 and (k[p] in (K["import"], K["export"], K["TYPEMOD"], _SOFTK["type"]) or k[p] == ",")
        if c in "}();=" or c in (K["=>"], ":"):
            return False
        i -= 1
    return False


_ANGLE, _ARROW, _FOR, _IMPORT = "<", K["=>"], K["for"], K["import"]
_BANG = re.compile(NL + "!")
_PRE = re.compile(NL + K["INC"])


def script_kinds(src: str, ts: bool, jsx: bool) -> tuple[str, list[int]]:
    """The token stream, ended by a line feed and EOF, and where each token starts. Raises LexError."""
    lex = _Lexer(src, ts, jsx)
    start = 0
    if src.startswith("#!"):
        m = re.compile(r"[^\r\n]*").match(src)
        start = m.end()
    lex.code(start, False)
    raw, at = lex.out, lex.at
    # One line feed between two tokens.
    k: list[str] = []
    pos: list[int] = []
    was = NL
    for c, p in zip(raw, at):
        if c == NL:
            if was == NL:
                continue
        k.append(c)
        pos.append(p)
        was = c
    if was != NL:
        k.append(NL)
        pos.append(len(src))
    k += [EOF, EOF]
    pos += [len(src), len(src)]
    text = "".join(k)
    ts_angle = ts and _ANGLE in text
    if ts_angle:
        _types(k, jsx)
    arrows = _ARROW in text
    fors = _FOR in text
    soft = not text.isascii() and any(c in text for c in SOFT)
    if arrows or fors or soft or ts_angle or _IMPORT in text or ts and "[" in text:
        match = _matching(k)
        if arrows:
            _arrows(k, match, ts)
        if ts_angle:
            for i, c in enumerate(k):
                if len(c) > 1:
                    o = next(j for j in range(i + 1, len(k)) if k[j] == K["T>"] and _closes(k, i, j))
                    k[i] = K["GENERIC("] if k[_next(k, o)] == K["ARROW("] else K["T<"]
        if fors:
            _fors(k, match)
        if ts and "[" in text:
            for i, c in enumerate(k):
                if c == "[" and match[i] > 0:
                    a = _next(k, i)
                    if k[a] == "I" or k[a] in SOFT:
                        b = k[_next(k, a)]
                        if b == ":" and k[_next(k, match[i])] == ":" and (i == 0 or k[i - 1] in "{;,}" + NL + SOFT):
                            k[i] = K["INDEX"]
                        elif b == K["in"] and k[_prev(k, i)] in "{+-" + SOFT:
                            k[i] = K["MAPPED"]
        if soft:
            _soft(k, match, ts)
        if _IMPORT in text:
            for i, c in enumerate(k):
                if c == _IMPORT and k[_next(k, i)] in "(.":
                    k[i] = K["IMPORTX"]
    text = "".join(k)
    if _BANG.search(text):
        text = _BANG.sub(NL + K["BANGNL"], text)
    if _PRE.search(text):
        text = _PRE.sub(NL + K["PREINC"], text)
    return text, pos


def _closes(k: list[str], i: int, j: int) -> bool:
    depth = 0
    for x in range(i, j + 1):
        if k[x][0] == K["T<"] or k[x] == K["GENERIC("]:
            depth += 1
        elif k[x] == K["T>"]:
            depth -= 1
            if not depth:
                return x == j
    return False


JSON_KINDS = {c: c for c in "{}[],:"} | {"STRING": "S", "NUMBER": "N", "true": "t", "false": "f", "null": "n", "EOF": EOF}
_JSON = re.compile(r'[ \t\r\n]*("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"|-?(?:0|[1-9]\d*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?(?![\w.])|true|false|null|[{}\[\],:]|[\s\S]|$)', re.ASCII)


def json_kinds(src: str) -> tuple[str, list[int]]:
    """The token stream of a JSON text, ended by EOF, and where each token starts."""
    k, at, pos, n = [], [], 0, len(src)
    while pos < n:
        m = _JSON.match(src, pos)
        t = m[1]
        if not t:
            break
        c = t[0]
        if c == '"' and len(t) > 1:
            k.append("S")
        elif c in "-0123456789" and t != "-":
            k.append("N")
        elif t in ("true", "false", "null"):
            k.append(c)
        elif c in "{}[],:":
            k.append(c)
        else:
            raise LexError(m.start(1), "unexpected character")
        at.append(m.start(1))
        pos = m.end()
    return "".join(k) + EOF, [*at, n]
