"""Entities of TypeScript and C++ sources, from one pass over tokens and a stack of brackets.

Comments and strings are single tokens, so braces and words inside them count for nothing. Every bracket knows its
partner, and statements end where their block, their semicolon or the block around them does. What needs types or a
grammar is left out: an entity is a function, method, class, interface, struct, loop or branch that can be told by
its words and brackets.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

TOKEN = re.compile(
    r"""(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?|`(?:\\.|[^`\\])*`?)|(?P<directive>^[ \t]*\#[^\n]*)|(?P<word>[A-Za-z_$][\w$]*)|(?P<number>\d[\w.]*)|(?P<mark>=>|->|::|\?\.|\?\?|&&|\|\||[-+*/%=!<>]=+|[{}()\[\];,.?:=<>!&|+*/%~^@#-])""",
    re.S | re.M | re.X,
)
CLOSES = {"(": ")", "[": "]", "{": "}"}

# Words that are no names, words that begin loops and branches, hints of complexity, and bounds.
WORDS = frozenset("if else for while do switch case return new delete throw typeof await yield catch try finally in of instanceof sizeof static_cast const let var void function class interface struct import export from async".split())
LOOPS, BRANCHES = ("for", "while", "do"), ("if", "switch")
HINTS = ("likely O(n^{}) due to nested loops", "likely O(n) with branching", "likely O(n)", "recursive, inspect stack growth and termination", "branch-heavy, data-dependent cost", "structural helper, cost likely linear in its input size")
SIGNATURE, DEPENDENCIES = 220, 16


def normalized(text: str) -> str:
    """Line ends as line feeds, runs of blanks as one, nothing at the ends."""
    return re.sub(r"[ \t]+", " ", text.replace("\r\n", "\n")).strip()


class Source:
    """Tokens of a source and the partner of each bracket; a bracket that nothing closes ends with the source."""

    def __init__(self, text: str):
        self.text = text
        self.kinds, self.words, self.starts, self.ends = [], [], [], []
        self.partner: dict[int, int] = {}
        open_at: list[int] = []
        for m in TOKEN.finditer(text):
            if m.lastgroup in ("comment", "directive"):
                continue
            k, w = len(self.words), m.group()
            self.kinds.append(m.lastgroup)
            self.words.append(w)
            self.starts.append(m.start())
            self.ends.append(m.end())
            if m.lastgroup == "mark" and w in CLOSES:
                open_at.append(k)
            elif m.lastgroup == "mark" and w in CLOSES.values():
                while open_at and CLOSES[self.words[open_at[-1]]] != w and w == "}" and self.words[open_at[-1]] != "{":
                    self.partner[open_at.pop()] = k  # an open parenthesis ends with the block
                if open_at and CLOSES[self.words[open_at[-1]]] == w:
                    self.partner[open_at.pop()] = k
        for k in open_at:
            self.partner[k] = len(self.words)
        self.opened = {b: a for a, b in self.partner.items()}
        self.lines = [m.start() for m in re.finditer("\n", text)]

    def word(self, k: int) -> str:
        return self.words[k] if 0 <= k < len(self.words) and self.kinds[k] != "string" else ""

    def named(self, k: int) -> bool:
        return 0 <= k < len(self.words) and self.kinds[k] == "word" and self.words[k] not in WORDS

    def after(self, k: int) -> int:
        """The token after a bracket's partner."""
        return min(self.partner.get(k, len(self.words)) + 1, len(self.words))

    def statement(self, k: int) -> int:
        """The token after the statement that begins at ``k``; nested ones are gone through without recursion."""
        n, pending = len(self.words), []
        while True:
            w = self.word(k)
            if k >= n or w == "}":
                end = min(k, n)
            elif w in ("for", "while", "if", "switch"):
                pending.append(w)
                k = k + 1 + (self.word(k + 1) == "await")
                k = self.after(k) if self.word(k) == "(" else k
                continue
            elif w == "do":
                pending.append(w)
                k += 1
                continue
            elif w == "{":
                end = self.after(k)
            else:
                end = k
                while end < n and self.word(end) not in (";", "}"):
                    end = self.after(end) if self.word(end) in CLOSES else end + 1
                end += self.word(end) == ";"
            while pending:
                last = pending.pop()
                if last == "if" and self.word(end) == "else":
                    pending.append("else")
                    k = end + 1
                    break
                if last == "do" and self.word(end) == "while":
                    end = self.after(end + 1) if self.word(end + 1) == "(" else end + 1
                    end += self.word(end) == ";"
            else:
                return end

    def body_after(self, k: int, most: int = 200) -> int | None:
        """The ``{`` of a body after a parameter list, past a type, initialisers or qualifiers; None where there is none."""
        for _ in range(most):
            w = self.word(k)
            if w == "{":
                return k
            if w in (";", "}", ")", "]", ",", "=", "=>", "") and not (0 <= k < len(self.words) and self.kinds[k] == "string"):
                return None
            k = self.after(k) if w in ("(", "[") else k + 1
        return None

    def entities(self, language: str) -> Iterator[tuple[str, str, int, int]]:
        """(kind, name, first token, token after) in the order of their beginnings."""
        classes: list[int] = []  # ends of the bodies of classes around a token
        bodies: list[int] = []  # and of all blocks that are no class
        for k in range(len(self.words)):
            while classes and classes[-1] <= k:
                classes.pop()
            while bodies and bodies[-1] <= k:
                bodies.pop()
            in_class = bool(classes) and (not bodies or classes[-1] < bodies[-1])
            w, before = self.word(k), self.word(k - 1)
            if self.kinds[k] != "word" or before in (".", "?.", "->"):
                continue
            if w in LOOPS and not (w == "while" and self.ends_do(k)) or w in BRANCHES:
                yield "loop" if w in LOOPS else "branch", self.first_name(k + 1), k, self.statement(k)
            elif w in ("class", "interface", "struct") and self.named(k + 1):
                body = self.body_after(k + 2)
                if body is not None and (w == "struct") == (language == "cpp" and w == "struct") and not (language == "cpp" and w == "class"):
                    yield w, self.word(k + 1), k, self.after(body)
                if body is not None:
                    classes.append(self.partner[body])
            elif w == "function":
                at = k + 1 + (self.word(k + 1) == "*")
                called = self.named(at)
                body = self.body_after(self.after(at + called)) if self.word(at + called) == "(" else None
                if body is not None:
                    yield "function", self.word(at) if called else "anonymous", k - (before == "async"), self.after(body)
                    bodies.append(self.partner[body])
            elif self.named(k) and self.word(k + 1) == "(" and before not in ("new", "function", "=", "return", "(", ",", "!", "&&", "||", "?", ":"):
                body = self.body_after(self.after(k + 1))
                member = in_class or language == "cpp"
                if body is not None and member:
                    first = self.back(k) if language == "cpp" or in_class else k
                    yield "method" if in_class and language != "cpp" else "function", self.word(k), first, self.after(body)
                    bodies.append(self.partner[body])
            elif self.named(k) and self.word(k + 1) == "=" and language != "cpp":
                at = k + 2 + (self.word(k + 2) == "async")
                arrow = self.after(at) if self.word(at) == "(" else at + 1
                while self.word(arrow) not in ("=>", ";", "{", "}", "=", ",", "") and arrow < k + 60:
                    arrow = self.after(arrow) if self.word(arrow) in ("(", "[") else arrow + 1
                if self.word(arrow) == "=>" and (self.word(at) == "(" or self.named(at)):
                    end = self.after(arrow + 1) if self.word(arrow + 1) == "{" else self.statement(arrow + 1)
                    yield "function", self.word(k), k + 2, end

    def ends_do(self, k: int) -> bool:
        """Whether a ``while`` belongs to a ``do`` before it."""
        if self.word(k - 1) != "}":
            return False
        return self.word(self.opened.get(k - 1, 0) - 1) == "do"

    def line(self, at: int) -> int:
        """The number of the line that a place is on, from 1."""
        return bisect_left(self.lines, at) + 1

    def first_name(self, k: int) -> str:
        return next((self.words[j] for j in range(k, min(k + 200, len(self.words))) if self.named(j)), "anonymous")

    def back(self, k: int) -> int:
        """The first token of the declaration that has its name at ``k``."""
        while k > 0 and self.word(k - 1) not in (";", "{", "}", ")", ",", "=>", "=", "(", "]") and (self.kinds[k - 1] == "word" or self.word(k - 1) in ("*", "&", "::", "<", ">", "~")):
            k -= 1
        return k


def described(s: Source, path: str, kind: str, name: str, first: int, after: int) -> dict:
    """What is told of an entity: place, signature, hint, what it calls, and hashes."""
    a, b = s.starts[first], s.ends[min(after, len(s.words)) - 1]
    piece = s.text[a:b]
    inside = range(first, min(after, len(s.words)))
    loops = sum(s.word(j) in LOOPS and not (s.word(j) == "while" and s.ends_do(j)) for j in inside)
    branches = sum(s.word(j) in BRANCHES or s.word(j) == "?" for j in inside)
    again = sum(s.word(j) == name and s.kinds[j] == "word" for j in inside) > 1
    hint = HINTS[0].format(min(loops, 3)) if loops > 1 else HINTS[1] if loops and branches else HINTS[2] if loops else HINTS[3] if again and kind in ("function", "method") else HINTS[4] if branches else HINTS[5]
    calls: dict[str, None] = {}
    for j in inside:
        if s.word(j) == "(" and s.named(j - 1) and s.word(j - 2) not in ("function", "new") and not (s.body_after(s.after(j)) is not None and s.word(j - 2) not in (".", "?.", "->")):
            at = j - 1
            while at - 2 >= first and s.word(at - 1) in (".", "?.", "->", "::") and s.kinds[at - 2] == "word":
                at -= 2
            called = normalized(s.text[s.starts[at] : s.ends[j - 1]])
            if len(called) > 1:
                calls.setdefault(called)
    flat = normalized(piece)
    return {
        "kind": kind, "name": name, "signature": normalized(piece.split("{")[0].split("=>")[0])[:SIGNATURE], "complexityHint": hint, "dependencies": list(calls)[:DEPENDENCIES], "startLine": s.line(a),
        "endLine": s.line(b), "startIndex": a, "endIndex": b, "sourceHash": hashlib.sha256(flat.encode()).hexdigest(), "id": hashlib.sha256(f"{path}:{a}:{b}:{flat}".encode()).hexdigest()[:24], "preview": piece[:400], "tokens": -(-len(piece) // 4),
    }


PYTHON_DEF = re.compile(r"^\s*def\s+([A-Za-z_][A-Za-z0-9_]*)\s*\((.*?)\)\s*:")


def python_entities(path: str, text: str) -> Iterator[dict]:
    for n, line in enumerate(re.split(r"\r?\n", text)):
        if m := PYTHON_DEF.match(line):
            signature = f"def {m[1]}({m[2]})"
            yield {
                "kind": "function", "name": m[1], "signature": signature, "complexityHint": "inspect implementation for complexity", "dependencies": [], "startLine": n + 1, "endLine": n + 1, "startIndex": 0, "endIndex": len(line),
                "sourceHash": hashlib.sha256(line.encode()).hexdigest(), "id": hashlib.sha256(f"{path}:py:def:{n}:{signature}".encode()).hexdigest()[:24], "preview": line, "tokens": -(-len(line) // 4),
            }


def module(path: str, text: str, hint: str) -> dict:
    whole = hashlib.sha256(text.encode()).hexdigest()
    name = re.split(r"[/\\]", path)[-1]
    return {"kind": "module", "name": name, "signature": "module", "complexityHint": hint, "dependencies": [], "startLine": 1, "endLine": text.count("\n") + 1, "startIndex": 0, "endIndex": len(text), "sourceHash": whole, "id": hashlib.sha256(f"{path}:module:{whole}".encode()).hexdigest()[:24], "preview": text[:240], "tokens": -(-len(text) // 4)}


def entities(path: str, text: str | None, language: str | None) -> list[dict]:
    """The entities of a file; of a language that isn't read, the module alone; of a blank file none."""
    if not (text or "").strip():
        return []
    if language == "python":
        return list(python_entities(path, text)) or [module(path, text, "n/a")]
    if language not in ("typescript", "tsx", "cpp"):
        return [module(path, text, "parser-unavailable fallback")]
    s = Source(text)
    found = {(k, a, b): described(s, path, k, name, a, b) for k, name, a, b in s.entities("cpp" if language == "cpp" else "typescript")}
    return list(found.values())
