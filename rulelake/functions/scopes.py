"""What a source text defines, binds and uses: its forms with their places, walked with a scope of local names.

`events` is the one step that isn't relational; which namespace a name belongs to is left to joins (operators/sourcing.py)."""

from __future__ import annotations

import re
import sys
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

#: kind, ns, var (the definition it lies in), name, target, id (of a local), row, col, end_row, end_col.
EVENT = "kind string, ns string, var string, name string, target string, id int, row int, col int, end_row int, end_col int"

_TOKEN = re.compile(r"""[\s,]+|;[^\n]*|(?P<text>\#?"(?:\\.|[^"\\])*"?)|(?P<char>\\(?:[A-Za-z0-9]+|.))|(?P<prefix>\#_|\#'|\#\^|~@|['`~@^])|(?P<open>\#\?@?\(|\#[({]|[(\[{])|(?P<close>[)\]}])|(?P<name>[^\s,()\[\]{}"';`~@^\\][^\s,()\[\]{}";`~@^\\]*)|.""", re.S)
_NAME = re.compile(r"(?!(?:nil|true|false)$)(?:[^:#0-9\"\\+\-.%&]|[+\-.][^0-9]|[+\-&.]$)")
#: Forms that bind names in a vector of pairs, one after the other.
LETS = frozenset("let loop let* loop* when-let if-let when-some if-some when-first with-open with-local-vars dotimes doseq for with-redefs-fn".split())
FUNCTIONS = frozenset(("fn", "fn*", "defn", "defn-", "defmacro", "defmethod"))
#: Forms that define a name and hold code.
DEFINES = frozenset("def defonce defmulti defrule defquery defsession defn defn- defmacro defrecord deftype defprotocol declare definterface".split())
RECORDS = frozenset(("defrecord", "deftype"))


@dataclass(slots=True)
class Form:
    kind: str  # name, text, quote, meta, or an opening bracket
    at: int
    end: int
    text: str = ""
    inside: list[Form] = field(default_factory=list)


def parsed(text: str) -> list[Form]:
    """The forms of a text. What isn't closed ends with the text; a bracket too many is passed over."""
    top: list[Form] = []
    stack = [Form("top", 0, len(text), inside=top)]

    def add(f: Form) -> None:
        stack[-1].inside.append(f)
        # a prefix takes the one form after it; metadata takes two
        while stack[-1].kind in ("'", "`", "~", "~@", "@", "#'", "#_", "^", "#^") and len(stack[-1].inside) == (2 if stack[-1].kind in ("^", "#^") else 1):
            done = stack.pop()
            done.end = done.inside[-1].end
            if done.kind == "#_":
                return
            stack[-1].inside.append(done if done.kind in ("'", "`") else done.inside[-1])

    for m in _TOKEN.finditer(text):
        kind = m.lastgroup
        if kind == "prefix":
            stack.append(Form(m[0], m.start(), m.end()))
        elif kind == "open":
            stack.append(Form(m[0], m.start(), m.end()))
        elif kind == "close":
            while len(stack) > 1 and stack[-1].kind[-1] not in "([{":
                stack.pop()  # a prefix without a form
            if len(stack) > 1:
                done = stack.pop()
                done.end = m.end()
                add(done)
        elif kind is not None:
            add(Form(kind, m.start(), m.end(), m[0]))
    while len(stack) > 1:
        done = stack.pop()
        if done.kind[-1] in "([{":
            done.end = len(text)
            add(done)
    return top


def single(text: str | None) -> bool:
    """Whether a text is one form, and a whole one."""
    depth, top, wanted, waits = 0, 0, 1, False
    for m in _TOKEN.finditer(text or ""):
        kind = m.lastgroup
        if kind == "prefix":
            waits = True
            wanted += not depth and m[0] in ("^", "#^", "#_")  # another form comes first
        elif kind is None:
            if not m[0].isspace() and m[0][0] not in ";,":
                return False
        elif kind == "text" and not (len(m[0]) > 1 and m[0].endswith('"')):
            return False
        else:
            top += not depth and kind != "close"
            depth += (kind == "open") - (kind == "close")
            waits = False
        if depth < 0:
            return False
    return depth == 0 and top == wanted and not waits


class Walk:
    """The events of a text. A scope maps local names to the ids of their bindings."""

    def __init__(self, text: str):
        self.lines = [0, *(m.end() for m in re.finditer("\n", text))]
        self.ns: str | None = None
        self.var: str | None = None
        self.ids, self.out = 0, []
        for f in parsed(text):
            self.walk(f, {})

    def place(self, at: int) -> tuple[int, int]:
        row = bisect_right(self.lines, at)
        return row, at - self.lines[row - 1] + 1

    def tell(self, kind: str, f: Form, name: str | None, target: str | None = None, ident: int | None = None) -> None:
        self.out.append((kind, self.ns, self.var, name, target, ident, *self.place(f.at), *self.place(f.end)))

    def every(self, forms: list[Form], scope: dict) -> None:
        for f in forms:
            self.walk(f, scope)

    def bind(self, f: Form, scope: dict) -> dict:
        """scope with the names of a binding form: a name, or a vector or map that takes a value apart."""
        if f.kind == "name":
            if f.text != "&" and _NAME.match(f.text):
                self.ids += 1
                self.tell("local", f, f.text, ident=self.ids)
                return scope | {f.text: self.ids}
        elif f.kind == "[":
            for x in f.inside:
                scope = self.bind(x, scope)
        elif f.kind == "{":
            for k, v in zip(f.inside[::2], f.inside[1::2], strict=False):
                if k.kind == "name" and k.text.rpartition("/")[2].lstrip(":") in ("keys", "strs", "syms") and k.text.startswith(":"):
                    scope = self.bind(v, scope)
                elif k.kind == "name" and k.text == ":as":
                    scope = self.bind(v, scope)
                elif k.kind == "name" and k.text == ":or":
                    self.every(v.inside[1::2], scope)
                else:
                    self.walk(v, scope)
                    scope = self.bind(k, scope)
        return scope

    def pairs(self, f: Form, scope: dict) -> dict:
        """scope after a vector of binding forms and values; :let holds another vector, other keywords a condition."""
        for k, v in zip(f.inside[::2], f.inside[1::2], strict=False):
            if k.kind == "name" and k.text == ":let":
                scope = self.pairs(v, scope)
            else:
                self.walk(v, scope)
                scope = scope if k.text.startswith(":") else self.bind(k, scope)
        return scope

    def arities(self, forms: list[Form], scope: dict) -> None:
        """Parameters and bodies of a function, of one arity or several."""
        for i, f in enumerate(forms):
            if f.kind == "[":
                self.every(forms[i + 1 :], self.bind(f, scope))
                return
            if f.kind == "(" and f.inside and f.inside[0].kind == "[":
                self.every(f.inside[1:], self.bind(f.inside[0], scope))
            else:
                self.walk(f, scope)

    def walk(self, f: Form, scope: dict) -> None:
        if f.kind == "name":
            if _NAME.match(f.text):
                if f.text in scope:
                    self.tell("local-usage", f, f.text, ident=scope[f.text])
                else:
                    self.tell("usage", f, f.text)
        elif f.kind in ("(", "#("):
            self.list(f, scope)
        elif f.kind.startswith("#?"):  # a reader conditional: what the JVM reads
            self.every([v for k, v in zip(f.inside[::2], f.inside[1::2], strict=False) if k.text in (":clj", ":default")][:1], scope)
        elif f.kind in ("[", "{", "#{"):
            self.every(f.inside, scope)

    def list(self, f: Form, scope: dict) -> None:
        if not f.inside:
            return
        head, rest = f.inside[0], f.inside[1:]
        if head.kind != "name" or not _NAME.match(head.text) or head.text in scope:
            self.every(f.inside, scope)
            return
        word = head.text.rpartition("/")[2] or head.text
        if word == "ns" and rest and self.var is None:
            self.ns = rest[0].text or None
            self.tell("ns", f, self.ns)
            self.clauses(rest[1:])
            return
        if word in ("require", "use", "import") and self.var is None:
            self.clauses([Form("(", f.at, f.end, inside=[Form("name", f.at, f.at, ":" + word), *[x.inside[0] if x.kind == "'" else x for x in rest]])])
            return
        self.tell("usage", f, head.text)
        outer = self.var
        named = bool(rest) and rest[0].kind == "name"
        if word in DEFINES and named and outer is None:
            for x in rest if word == "declare" else rest[:1]:
                self.tell("definition", f if word != "declare" else x, x.text, word)
            self.var, rest = rest[0].text, rest[1:]
        elif word == "defmethod" and named and outer is None:
            self.var, rest = rest[0].text, rest[1:]
        if word in RECORDS:
            for mark in ("->", "map->") if word == "defrecord" else ("->",):
                self.tell("definition", f, f"{mark}{self.var}", "constructor")
            self.methods(rest, self.bind(rest[0], scope) if rest and rest[0].kind == "[" else scope)
        elif word == "defprotocol":
            for x in rest:
                if x.kind == "(" and x.inside:
                    self.tell("definition", x, x.inside[0].text, "method")
        elif word in LETS and rest and rest[0].kind == "[":
            self.every(rest[1:], self.pairs(rest[0], scope))
        elif word in FUNCTIONS:
            inner = scope
            if word in ("fn", "fn*") and named:
                inner, rest = self.bind(rest[0], scope), rest[1:]
            self.arities(rest, inner)
        elif word in ("reify", "extend-type", "extend-protocol", "extend", "proxy"):
            self.methods(rest, scope)
        elif word == "letfn" and rest:
            for x in rest[0].inside:
                scope = self.bind(x.inside[0], scope) if x.inside else scope
            for x in rest[0].inside:
                self.arities(x.inside[1:], scope)
            self.every(rest[1:], scope)
        elif word == "catch" and len(rest) > 1:
            self.walk(rest[0], scope)
            self.every(rest[2:], self.bind(rest[1], scope))
        elif word == "as->" and len(rest) > 1:
            self.walk(rest[0], scope)
            self.every(rest[2:], self.bind(rest[1], scope))
        elif word not in ("quote", "declare", "comment"):
            self.every(rest, scope)
        self.var = outer

    def methods(self, forms: list[Form], scope: dict) -> None:
        """Lists with a name, parameters and a body; anything else is code."""
        for f in forms:
            if f.kind == "(" and len(f.inside) > 1 and f.inside[1].kind in ("[", "("):
                self.arities(f.inside[1:], scope)
            elif f.kind != "[":
                self.walk(f, scope)

    def clauses(self, forms: list[Form]) -> None:
        """What a namespace requires, calls by another name, takes over and imports."""
        for c in forms:
            word = c.inside[0].text.lstrip(":") if c.kind == "(" and c.inside else ""
            if word in ("require", "use", "require-macros"):
                for x in c.inside[1:]:
                    self.library(x, "", word == "use")
            elif word == "import":
                for x in c.inside[1:]:
                    if x.kind in ("(", "[") and x.inside:
                        for y in x.inside[1:]:
                            self.tell("import", y, y.text, f"{x.inside[0].text}.{y.text}")
                    elif x.kind == "name":
                        self.tell("import", x, x.text.rpartition(".")[2], x.text)

    def library(self, x: Form, prefix: str, whole: bool) -> None:
        if x.kind == "name" and not x.text.startswith(":"):
            self.tell("require", x, None, prefix + x.text)
            if whole:
                self.tell("refer-all", x, None, prefix + x.text)
        elif x.kind in ("[", "(") and x.inside:
            ns, more = prefix + x.inside[0].text, x.inside[1:]
            if more and not more[0].text.startswith(":"):  # a prefix list
                for y in more:
                    self.library(y, ns + ".", whole)
                return
            self.tell("require", x.inside[0], None, ns)
            options = {k.text: v for k, v in zip(more[::2], more[1::2], strict=False)}
            for k in (":as", ":as-alias"):
                if k in options:
                    self.tell("alias", options[k], options[k].text, ns)
            names = options.get(":refer") or options.get(":only")
            renamed = options[":rename"].inside if ":rename" in options else []
            other = {a.text: b.text for a, b in zip(renamed[::2], renamed[1::2], strict=False)}
            for y in names.inside if names else []:
                self.tell("refer", y, other.get(y.text, y.text), f"{ns}/{y.text}")
            if (names is not None and names.text == ":all") or (whole and names is None):
                self.tell("refer-all", x.inside[0], None, ns)


def events(text: str | None) -> Iterator[tuple]:
    """The events of a text in their order; none for a null or empty one. Nesting has no limit."""
    most = sys.getrecursionlimit()
    sys.setrecursionlimit(max(most, 1_000_000))
    try:
        yield from Walk(text or "").out
    finally:
        sys.setrecursionlimit(most)
