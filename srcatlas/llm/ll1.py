"""LL(1) parse tables from a bundled grammar text.

Notation: `Name : alternative | alternative ;` with ( ) ? * on items, 'x' for a token by its text, UPPER
for token classes, <flag> in front of an alternative that only exists where the flag is set. Where two
alternatives start with the same token the first one listed holds.

A table maps (nonterminal, token) to what remains once the token is consumed: the leftmost chain of
expansions is done when the table is built, so parsing does one lookup a token and pops what turns out
empty. A nonterminal without an entry for the token and without an empty alternative is the error.
"""

from __future__ import annotations

import re

_ITEM = re.compile(r"'[^']*'|<\w+>|[A-Z]+[(<>]|\w+|[()?*|:;]")
_CLASS = re.compile(r"[A-Z][A-Z0-9]*[(<>]?$")


class Grammar:
    def __init__(self, text: str, flags: frozenset[str], kinds: dict[str, str], sets: dict[str, str], specials: dict[str, int], eager: frozenset[str] = frozenset()):
        """kinds: token text or class -> its character; sets: class -> its characters (several tokens); specials: symbols
        the parser decides at run time, which count as possibly empty; eager: those that decide on the whole of what follows."""
        self.kinds, self.sets, self.specials, self.eager = kinds, sets, specials, eager
        self.rules: dict[str, list[list]] = {}
        self.start = ""
        self._n = 0
        self._read(text, flags)
        self.first, self.empty = self._first()
        self.tables: dict[str, dict] = {n: {} for n in self.rules}
        for n in self.rules:
            self._fill(n)

    def _read(self, text: str, flags: frozenset[str]) -> None:
        toks = _ITEM.findall(re.sub(r"(?m)^#.*", "", text))
        at = 0

        def alternatives(end: str) -> list[list]:
            nonlocal at
            alts: list[list] = []
            seq: list = []
            keep = True
            while True:
                t = toks[at]
                at += 1
                if t == "|" or t == end:
                    if keep:
                        alts.append(seq)
                    seq, keep = [], True
                    if t == end:
                        return alts
                elif t[0] == "<":
                    keep = keep and t[1:-1] in flags
                elif t == "(":
                    seq.append(self._new(alternatives(")")))
                elif t == "?":
                    seq.append(self._new([[seq.pop()], []]))
                elif t == "*":
                    x, name = seq.pop(), self._new([])
                    self.rules[name] = [[x, name], []]
                    seq.append(name)
                else:
                    seq.append(t)

        while at < len(toks):
            name = toks[at]
            at += 2
            self.rules[name] = alternatives(";")
            self.start = self.start or name
        for n, alts in self.rules.items():
            for a in alts:
                for s in a:
                    if not (s in self.rules or s in self.specials or s in self.sets or self._char(s)):
                        raise ValueError(f"{n}: unknown symbol {s}")

    def _new(self, alts: list[list]) -> str:
        self._n += 1
        name = f"_{self._n}"
        self.rules[name] = alts
        return name

    def _char(self, s: str) -> str | None:
        return self.kinds.get(s[1:-1] if s[0] == "'" else s)

    def _first(self):
        first: dict[str, set] = {n: set() for n in self.rules}
        empty: set[str] = set()
        changed = True
        while changed:
            changed = False
            for n, alts in self.rules.items():
                for a in alts:
                    f, e = self._of(a, first, empty)
                    if not f <= first[n] or (e and n not in empty):
                        first[n] |= f
                        changed = True
                        if e:
                            empty.add(n)
        return first, empty

    def _of(self, seq: list, first: dict, empty: set) -> tuple[set, bool]:
        out: set = set()
        for s in seq:
            if s in self.rules:
                out |= first[s]
                if s not in empty:
                    return out, False
            elif s in self.specials:
                if s in self.eager:
                    return out, True
                if s == "SEMI":
                    out |= {";"}
            else:
                return out | set(self.sets.get(s) or self._char(s)), False
        return out, True

    def _symbol(self, s: str):
        if s in self.rules:
            return self.tables[s]
        if s in self.specials:
            return self.specials[s]
        return frozenset(self.sets[s]) if s in self.sets else self._char(s)

    def _pick(self, n: str, k: str) -> list | None:
        fallback = None
        for a in self.rules[n]:
            f, e = self._of(a, self.first, self.empty)
            if k in f:
                return a
            if e and fallback is None:
                fallback = a
        return fallback

    def _fill(self, n: str) -> None:
        """table[k]: tuple, what remains after k, or list, what to push without consuming k; table['']: what an empty one leaves."""
        t = self.tables[n]
        for k in self.first[n]:
            rest, todo = [], list(self._pick(n, k) or [])
            while todo:
                s = todo[0]
                if s in self.rules:
                    f = self.first[s]
                    if k not in f and s in self.empty:
                        if any(x in self.specials for a in self.rules[s] for x in a):
                            rest = None
                            break
                        todo = todo[1:]
                        continue
                    todo = list(self._pick(s, k) or []) + todo[1:]
                elif s in self.specials:
                    rest = None
                    break
                else:
                    todo = todo[1:]
                    rest = todo
                    break
            if rest is None:
                t[k] = [self._symbol(s) for s in reversed(todo)]
            else:
                t[k] = tuple(self._symbol(s) for s in reversed(rest))
        if n in self.empty:
            a = next(a for a in self.rules[n] if self._of(a, self.first, self.empty)[1])
            t[""] = tuple(self._symbol(s) for s in reversed(a))
