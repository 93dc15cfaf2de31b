"""The outline of a token list: which tokens are TypeScript's types, which scopes there are, and what names mean in them.

Types are found by trial: where a type may stand, a type is read; if what follows cannot follow a type, nothing is
taken. Regions between brackets wait on a list, so deep nesting needs no deep recursion.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass, field

#: Keywords after which an expression starts (fixed values).
BEFORE_EXPRESSION = frozenset("return typeof instanceof in of new delete void throw case do else yield await default".split())
#: Words that no type starts with, words before a type, and words before a member or parameter (fixed values).
NO_TYPE = frozenset("if for while switch case return throw delete function class await yield else do try finally var let const export instanceof in of".split())
TYPE_PREFIXES = frozenset("keyof unique readonly infer asserts".split())
MODIFIERS = frozenset("public private protected readonly abstract override declare accessor".split())
PLAIN_MODIFIERS = frozenset("static async get set".split())
#: Words that start a statement of types, or of imports and exports; other words with a meaning of their own here.
STATEMENTS = frozenset("import export interface type declare abstract global namespace module const enum".split())
MARKED = frozenset("const let var function class catch for as satisfies".split())
#: What stands before and after a word that is a key, a label or a parameter.
BEFORE_NAMED, AFTER_NAMED = frozenset((".", "?.", "break", "continue")), frozenset(("=>", ":"))
DECLARED = frozenset("const let var function class abstract enum namespace module global interface type async".split())
BINARY = frozenset("&& || ?? == === != !== = * / % , ; ) ] } : ? . ?. | & ^ => ** += -= *= /= &&= ||= ??= ...".split())
OPEN, CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}


@dataclass(slots=True)
class Scope:
    start: int
    end: int
    is_function: bool
    parent: "Scope | None" = None
    names: dict[str, "Name"] = field(default_factory=dict)


@dataclass(slots=True)
class Name:
    """A declared name: its token, its scope, and how it is declared: import, function, class, var, let, param."""

    at: int
    how: str
    scope: Scope | None = None


class Outline:
    def __init__(self, tokens: list) -> None:
        self.t, self.n = tokens, len(tokens)
        self.words = [t.text if t.kind == "word" else "" for t in tokens]
        self.texts = [t.text if t.kind == "word" or t.kind == "punct" else "" for t in tokens]
        self.scopes: list[Scope] | None = None
        self.close: dict[int, int] = {}
        opened: list[int] = []
        for i, x in enumerate(self.texts):  # words are no brackets
            if x in OPEN:
                opened.append(i)
            elif x in CLOSE and opened:
                self.close[opened.pop()] = i
        self.close |= {i: self.n - 1 for i in opened}
        self.dropped = bytearray(self.n + 1)
        self.keys: set[int] = set()
        self.declared: list[tuple[int, str]] = []
        self.intervals: list[tuple[int, int, bool]] = [(-1, self.n, True)]
        self.waiting: list[tuple[int, int, str, str]] = [(0, self.n, "block", "")]
        while self.waiting:
            self.scan(*self.waiting.pop())

    # --- tokens

    def text(self, i: int) -> str:
        return self.texts[i] if 0 <= i < self.n else ""

    def word(self, i: int) -> str:
        return self.words[i] if 0 <= i < self.n else ""

    def new_line(self, i: int) -> bool:
        """Whether token i stands on a later line than the one before it."""
        return i >= self.n or i > 0 and self.t[i].line > self.t[i - 1].line

    def before(self, i: int) -> int:
        """The last token before i that stays."""
        i -= 1
        while i >= 0 and self.dropped[i]:
            i -= 1
        return i

    def ended(self, i: int) -> bool:
        """Whether a value may end with token i."""
        if i < 0:
            return False
        t = self.t[i]
        if t.kind == "word":
            return t.text not in BEFORE_EXPRESSION or self.text(i - 1) == "."
        return t.kind != "punct" or t.text in (")", "]", "}", "++", "--")

    def drop(self, a: int, b: int) -> int:
        for i in range(a, min(b, self.n)):
            self.dropped[i] = 1
        return b

    def close_angle(self, a: int, end: int) -> int:
        """Drops a list in angle brackets that ends before `end`; what was read with its last bracket stays."""
        self.drop(a, end)
        if self.text(end - 1) == ">=":
            self.t[end - 1].text = self.texts[end - 1] = "="
            self.dropped[end - 1] = 0
            return end - 1
        return end

    def wait(self, opened: int, mode: str, how: str = "") -> int:
        """Leaves the inside of a bracket for later; the token after it."""
        self.waiting.append((opened + 1, self.close[opened], mode, how))
        return self.close[opened] + 1

    # --- types: each gives the token after what it has read, or -1

    def type_(self, k: int, conditional: bool = True) -> int:
        k += self.text(k) in ("|", "&")
        while True:
            k = self.unary(k)
            if k < 0 or self.text(k) not in ("|", "&"):
                break
            k += 1
        if k > 0 and conditional and self.word(k) == "extends":
            e = self.type_(k + 1, False)
            if e > 0 and self.text(e) == "?":
                a = self.type_(e + 1)
                b = self.type_(a + 1) if a > 0 and self.text(a) == ":" else -1
                if b > 0:
                    return b
        return k

    def unary(self, k: int) -> int:
        if k >= self.n:
            return -1
        t, w = self.t[k], self.word(k)
        if w in TYPE_PREFIXES and not self.new_line(k + 1) and (self.word(k + 1) or self.text(k + 1) in ("(", "[", "{") or self.t[min(k + 1, self.n - 1)].kind == "string"):
            k = self.unary(k + 1)
            if w == "infer" and k > 0 and self.word(k) == "extends" and (e := self.type_(k + 1, False)) > 0 and self.text(e) != "?":
                return e
            return k
        if w == "abstract" and self.word(k + 1) == "new":
            return self.unary(k + 1)
        if w == "new":
            k += 1
            if self.text(k) == "<":
                k = self.type_parameters(k)
            return self.type_(self.close[k] + 2) if k > 0 and self.text(k) == "(" and self.text(self.close[k] + 1) == "=>" else -1
        if w == "typeof":
            return self.unary(k + 1) if self.word(k + 1) else -1
        if w == "import" and self.text(k + 1) == "(":
            return self.entity(self.close[k + 1] + 1)
        if w:
            if w in NO_TYPE:
                return -1
            k = self.entity(k + 1)
            if k > 0 and self.word(k) == "is" and not self.new_line(k):
                return self.type_(k + 1)
            return k
        if t.kind in ("string", "number"):
            return self.arrays(k + 1)
        if t.kind == "template":
            k += 1
            while self.text(k) == "(" and self.t[k].parts:
                k = self.close[k] + 1
            return self.arrays(k)
        x = self.text(k)
        if x == "-" and self.t[min(k + 1, self.n - 1)].kind == "number":
            return k + 2
        if x == "<":
            k = self.type_parameters(k)
            return self.type_(self.close[k] + 2) if k > 0 and self.text(k) == "(" and self.text(self.close[k] + 1) == "=>" else -1
        if x == "(":
            c = self.close[k]
            if self.text(c + 1) == "=>":
                return self.type_(c + 2)
            return self.arrays(c + 1) if self.type_(k + 1) == c else -1
        if x in ("[", "{"):
            return self.arrays(self.close[k] + 1)
        return -1

    def entity(self, k: int) -> int:
        """What may follow a type's name: members, arguments, brackets."""
        while self.text(k) == "." and self.word(k + 1):
            k += 2
        if self.text(k) == "<" and not self.new_line(k):
            k = self.type_arguments(k)
            if k < 0:
                return -1
        return self.arrays(k)

    def arrays(self, k: int) -> int:
        while self.text(k) == "[" and not self.new_line(k):
            k = self.close[k] + 1
        return k

    def type_arguments(self, k: int) -> int:
        """After the > of a list of types that opens at k."""
        k += 1
        while True:
            k = self.type_(k)
            if k < 0:
                return -1
            if self.text(k) in (">", ">="):
                return k + 1
            if self.text(k) != ",":
                return -1
            k += 1

    def type_parameters(self, k: int) -> int:
        """After the > of a list of declared type names that opens at k."""
        k += 1
        while self.text(k) not in (">", ">="):
            while self.word(k) in ("const", "in", "out") and self.word(k + 1):
                k += 1
            if not self.word(k) or self.word(k) in NO_TYPE:
                return -1
            k += 1
            for sign in ("extends", "="):
                if self.text(k) == sign:
                    k = self.type_(k + 1)
                    if k < 0:
                        return -1
            if self.text(k) == ",":
                k += 1
            elif self.text(k) not in (">", ">="):
                return -1
        return k + 1

    def annotation(self, k: int) -> int:
        """Drops a colon and the type after it."""
        if self.text(k) == ":" and (e := self.type_(k + 1)) > 0:
            if self.text(e - 1) == ">=":
                return self.close_angle(k, e)
            return self.drop(k, e)
        return k

    def may_follow_arguments(self, k: int) -> bool:
        """Whether type arguments before token k are arguments, and no comparison."""
        if k >= self.n or self.text(k - 1) == ">=":
            return True
        t = self.t[k]
        if t.text == "(" and t.kind == "punct" or t.kind == "template":
            return True
        if t.text in ("<", ">", "+", "-") and t.kind == "punct":
            return False
        return self.new_line(k) or t.kind == "punct" and t.text in BINARY or self.word(k) in ("instanceof", "in", "as", "satisfies", "extends", "implements")

    # --- regions

    def scan(self, a: int, b: int, mode: str, how: str) -> None:
        """One region. Modes: block, list, object, class, params, pattern, array (a pattern); how names in patterns are declared."""
        i, questions, declares, fresh = a, 0, "", True
        entry = {"object": self.property, "class": self.member, "params": self.parameter, "pattern": self.target, "array": self.target}.get(mode)
        tokens, texts, last = self.t, self.texts, self.n - 1
        while i < b:
            t, x = tokens[i], texts[i]
            if mode == "class" and not fresh and i > a and self.new_line(i) and self.ended(self.before(i)) and (t.kind != "punct" or x in ("[", "@", "#", "*")) and x not in ("in", "instanceof", "as", "satisfies"):
                fresh = True
            if fresh and entry and x not in (",", ";"):
                i, fresh = entry(i, b, how or "param", mode)
                questions = 0
                continue
            if t.kind == "word":
                if x not in STATEMENTS and x not in MARKED and 0 < i < last and texts[i + 1] not in AFTER_NAMED and texts[i - 1] not in BEFORE_NAMED:  # as most are
                    i += 1
                    continue
                i, declares, ends = self.worded(i, b, mode, a, questions, declares)
                questions = 0 if ends else questions
                continue
            if t.kind != "punct":
                i += 1
            elif x == "(":
                i = self.parenthesis(i, questions)
            elif x == "[":
                i = self.wait(i, "list")
            elif x == "{":
                i = self.brace(i, mode, a, questions)
            elif x == "<":
                i = self.angle(i)
            elif x == "!" and self.ended(self.before(i)) and not self.new_line(i):
                # x!.y() and x!() are no calls of a name, so there the mark stays
                i = i + 1 if self.text(i + 1) in (".", "(", "[", "?.") else self.drop(i, i + 1)
            elif x == "," and declares:
                i = self.binding(i + 1, declares)
            else:
                questions = max(0, questions + (x == "?") - (x == ":"))
                if x == ";":
                    questions, declares = 0, ""
                fresh = fresh or x == "," and mode in ("object", "params", "pattern", "array") or x == ";" and mode == "class"
                i += 1

    def statement_starts(self, i: int, a: int) -> bool:
        k = self.before(i)
        return k < a or self.text(k) in (";", "{", "}", ")", "else", "do", ":", "export", "default", "declare") or self.new_line(i) and self.ended(k)

    def worded(self, i: int, b: int, mode: str, a: int, questions: int, declares: str) -> tuple[int, str, bool]:
        """(next token, how names are declared until the statement ends, whether a statement ended)."""
        w, after = self.word(i), self.text(i + 1)
        if self.text(i - 1) in (".", "?."):
            self.keys.add(i)
            return i + 1, declares, False
        if mode == "block" and w in STATEMENTS and (e := self.type_statement(i, a)) > 0:
            return e, "", True
        if w not in MARKED:
            pass
        elif w in ("const", "let", "var") and (self.word(i + 1) or after in ("{", "[")) and self.word(i + 1) not in ("in", "of", "instanceof"):
            how = "var" if w == "var" else "let"
            return self.binding(i + 1, how), how, True
        elif w == "function" and after != ":":
            return self.function(i, a), declares, False
        elif w == "class" and after not in (":", ",", ")", "=", "."):
            return self.class_(i, a), declares, False
        elif w == "catch" and after == "(":
            self.wait(i + 1, "params", "let")
            c = self.close[i + 1]
            if self.text(c + 1) == "{":
                self.intervals.append((i + 1, self.close[c + 1], False))
            return c + 1, "", True
        elif w == "for" and (k := i + 1 + (self.word(i + 1) == "await")) and self.text(k) == "(":
            c = self.close[k]
            self.intervals.append((k, self.close[c + 1] if self.text(c + 1) == "{" else self.value_end(c + 1, b), False))
            return self.wait(k, "block"), "", True
        elif w in ("as", "satisfies") and self.ended(self.before(i)) and not self.new_line(i) and after not in ("(", "=", ".", ",", ";", ")", "?."):
            e = i + 2 if self.word(i + 1) == "const" else self.type_(i + 1)
            if e > 0:
                return (self.close_angle(i, e) if self.text(e - 1) == ">=" else self.drop(i, e)), declares, False
        if after == "=>":
            self.declared.append((i, "param"))
            self.intervals.append((i, self.arrow_end(i + 1, b), True))
        elif after == ":" and mode == "block" and not questions and self.statement_starts(i, a) and w not in ("default", "case"):
            self.keys.add(i)  # a label
        elif self.word(i - 1) in ("break", "continue") and not self.new_line(i):
            self.keys.add(i)
        return i + 1, declares, False

    def type_statement(self, i: int, a: int) -> int:
        """After a statement of types, or of imports and exports, that starts at i; else -1."""
        w, after = self.word(i), self.text(i + 1)
        if w == "import" and after not in ("(", ".") and self.statement_starts(i, a):
            return self.import_(i)
        if w == "export" and self.statement_starts(i, a):
            return self.export(i)
        if not self.word(i + 1) and not (w in ("declare", "module", "global") and after == "{") and not (w == "module" and i + 1 < self.n and self.t[i + 1].kind == "string") or self.new_line(i + 1):
            return -1
        if w == "interface" and self.text(i + 2) in ("{", "extends", "<"):
            k = i + 2
            while k < self.n and self.text(k) != "{":
                e = self.type_arguments(k) if self.text(k) == "<" else -1
                if e < 0 and self.text(k) == "<":
                    e = self.type_parameters(k)
                k = e if e > 0 else k + 1
            return self.gone(i, self.close.get(k, k) + 1)
        if w == "type" and self.text(i + 2) in ("=", "<"):
            k = self.type_parameters(i + 2) if self.text(i + 2) == "<" else i + 2
            if k > 0 and self.text(k) == "=" and (e := self.type_(k + 1)) > 0:
                return self.gone(i, e + (self.text(e) == ";"))
            return -1
        if w == "declare" and self.word(i + 1) in DECLARED or w == "abstract" and self.word(i + 1) == "class":
            return self.drop(i, i + 1)
        if w == "global" and after == "{" and self.word(i - 1) == "declare":
            self.drop(i, i + 1)
            return self.inner(i + 1)
        if w in ("namespace", "module") and (self.word(i + 1) or self.t[i + 1].kind == "string"):
            k = i + 2
            while self.text(k) == "." and self.word(k + 1):
                k += 2
            if self.text(k) == "{":
                self.gone(i, k)
                return self.inner(k)
            return -1
        k = i + (w == "const")
        if w in ("const", "enum") and self.word(k) == "enum" and self.word(k + 1) and self.text(k + 2) == "{":
            self.declared.append((k + 1, "let"))
            self.gone(i, k + 2)
            self.waiting.append((k + 3, self.close[k + 2], "object", "enum"))
            return self.close[k + 2] + 1
        return -1

    def gone(self, i: int, end: int) -> int:
        """Drops a statement with the words before it that belong to it."""
        k = i - 1
        while self.word(k) in ("export", "declare", "default") and self.text(k - 1) not in (".", "?."):
            self.drop(k, k + 1)
            k -= 1
        return self.drop(i, end)

    def inner(self, opened: int) -> int:
        self.intervals.append((opened, self.close[opened], True))
        return self.wait(opened, "block")

    def import_(self, i: int) -> int:
        """Binds what an import declares; an import of a namespace's member (import a = b.c) is a type statement."""
        k = i + 1
        if self.word(k) == "type" and (self.word(k + 1) and self.word(k + 1) != "from" or self.text(k + 1) in ("{", "*")):
            k += 1
        if self.word(k) and self.text(k + 1) == "=":
            self.declared.append((k, "let"))
            e = self.close[k + 3] + 1 if self.word(k + 2) == "require" and self.text(k + 3) == "(" else self.entity(k + 3)
            return self.gone(i, max(e, k + 3) + (self.text(e) == ";"))
        while k < self.n and self.t[k].kind != "string" and self.text(k) != ";":
            if self.text(k) == "{":
                for j in range(k + 1, self.close[k]):
                    if self.word(j) and self.text(j + 1) in (",", "}") and self.text(j - 1) in ("{", ",", "as", "type"):
                        self.declared.append((j, "import"))
                    self.keys.add(j)
                k = self.close[k]
            elif self.word(k) and self.word(k) not in ("from", "as") and self.text(k - 1) in ("import", ",", "as", "type"):
                self.declared.append((k, "import"))
            self.keys.add(k)
            k += 1
        if self.word(k + 1) in ("with", "assert") and self.text(k + 2) == "{":  # attributes
            k = self.drop(k + 1, self.close[k + 2] + 1) - 1
        return k + 1

    def export(self, i: int) -> int:
        """Only lists and re-exports are passed over; a declaration after `export` is read as such."""
        k = i + 1
        if self.word(k) == "type" and self.text(k + 1) in ("{", "*"):
            self.drop(k, k + 1)
            k += 1
        if self.word(k) == "as" and self.word(k + 1) == "namespace":
            return self.gone(i, k + 3 + (self.text(k + 3) == ";"))
        if self.text(k) not in ("{", "*"):
            return i + 1
        end = self.close[k] if self.text(k) == "{" else k + 2 * (self.word(k + 1) == "as")
        if self.text(k) == "{" and not self.from_(end):
            for j in range(k + 1, end):  # local names are uses, but exported ones are none
                if self.word(j - 1) == "as":
                    self.keys.add(j)
        else:
            self.keys.update(range(k, end + 1))
        return end + (3 if self.from_(end) else 1)

    def from_(self, k: int) -> bool:
        return self.word(k + 1) == "from" and k + 2 < self.n and self.t[k + 2].kind == "string"

    def binding(self, i: int, how: str) -> int:
        """A name or pattern after const, let, var or in parameters, with its type; the token after."""
        if self.word(i):
            if self.word(i) != "this":
                self.declared.append((i, how))
            i += 1
        elif self.text(i) in ("{", "["):
            i = self.wait(i, "pattern" if self.text(i) == "{" else "array", how)
        if self.text(i) in ("?", "!") and self.text(i + 1) in (":", ",", ")", "="):
            i = self.drop(i, i + 1)
        return self.annotation(i)

    def parameter(self, i: int, b: int, how: str, mode: str) -> tuple[int, bool]:
        while self.text(i) == "@":
            i = self.decorator(i)
        while self.word(i) in MODIFIERS and (self.word(i + 1) or self.text(i + 1) in ("{", "[")):
            i = self.drop(i, i + 1)
        i += self.text(i) == "..."
        return max(i + (not self.word(i) and self.text(i) not in ("{", "[")), self.binding(i, how)), False

    def decorator(self, i: int) -> int:
        i += 2 if self.word(i + 1) else 1
        while self.text(i) == "." and self.word(i + 1):
            self.keys.add(i + 1)
            i += 2
        if self.text(i) == "<":
            i = self.angle(i)
        return self.wait(i, "list") if self.text(i) == "(" else i

    def target(self, i: int, b: int, how: str, mode: str) -> tuple[int, bool]:
        """One entry of a pattern."""
        if self.text(i) == "...":
            i += 1
        elif mode == "pattern":
            k = self.wait(i, "list") if self.text(i) == "[" else i + 1
            if self.text(k) == ":":
                self.keys.add(i)
                i = k + 1
        if self.word(i):
            self.declared.append((i, how))
            return i + 1, False
        if self.text(i) in ("{", "["):
            return self.wait(i, "pattern" if self.text(i) == "{" else "array", how), False
        return i + 1, False

    def property(self, i: int, b: int, how: str, mode: str) -> tuple[int, bool]:
        """The key of an entry of an object; a method whole."""
        if self.text(i) == "...":
            return i + 1, False
        while (self.word(i) in PLAIN_MODIFIERS and self.text(i + 1) not in (",", ":", "(", "}", "=", "<") or self.text(i) == "*") and i + 1 < b:
            self.keys.add(i)
            i += 1
        k = self.wait(i, "list") if self.text(i) == "[" else i + 1
        if self.text(k) in (":", "(", "<") or how == "enum":
            self.keys.add(i)
        if self.text(k) in ("(", "<") and (e := self.method(k)) > 0:
            return e, True
        return k, False

    def member(self, i: int, b: int, how: str, mode: str) -> tuple[int, bool]:
        """A member of a class: a method whole, or a field up to its value."""
        start = i
        while self.text(i) == "@":
            i = self.decorator(i)
        while (self.word(i) in MODIFIERS or self.word(i) in PLAIN_MODIFIERS or self.text(i) == "*") and self.text(i + 1) not in ("(", "=", ";", ":", "?", "!", "<", "}", ","):
            if self.word(i) in MODIFIERS:
                self.drop(i, i + 1)
            elif self.word(i) == "static" and self.text(i + 1) == "{":
                self.keys.add(i)
                return self.inner(i + 1), True
            self.keys.add(i)
            i += 1
        if self.text(i) == "[" and self.word(i + 1) and self.text(i + 2) == ":":  # an index signature
            e = self.annotation(self.close[i] + 1)
            return self.drop(i, max(e, self.close[i] + 1)), True
        i += self.text(i) == "#"
        k = self.wait(i, "list") if self.text(i) == "[" else i + 1
        self.keys.add(i)
        if self.text(k) in ("?", "!"):
            k = self.drop(k, k + 1)
        if self.text(k) in ("(", "<"):
            e = self.method(k)
            if e > 0:
                return e, True
            # an overload or an abstract method: no body, and no call
            c = self.type_parameters(k) if self.text(k) == "<" else k
            return self.drop(start, max(self.annotation(self.close.get(c, c) + 1), k + 1)), True
        k = self.annotation(k)
        return k, k < b and self.text(k) not in ("=", ";") and self.new_line(k)

    def method(self, k: int) -> int:
        """A function from its type parameters or parameters on; after its body, or -1 where it has none."""
        angle = k if self.text(k) == "<" else -1
        if angle >= 0:
            k = self.type_parameters(k)
        if k < 0 or self.text(k) != "(":
            return -1
        c = self.close[k]
        r = c + 1
        if self.text(r) == ":":
            r = self.type_(r + 1)
        if r < 0 or self.text(r) != "{":
            return -1
        if angle >= 0:
            self.drop(angle, k)
        self.drop(c + 1, r)
        self.wait(k, "params", "param")
        self.wait(r, "block")
        self.intervals.append((k, self.close[r], True))
        return self.close[r] + 1

    def function(self, i: int, a: int) -> int:
        begin = i - (self.word(i - 1) == "async")
        k = i + 1 + (self.text(i + 1) == "*")
        statement = self.statement_starts(begin, a)
        named = bool(self.word(k))
        e = self.method(k + named)
        if e < 0:  # an overload
            c = self.type_parameters(k + named) if self.text(k + named) == "<" else k + named
            if not statement or self.text(c) != "(":
                return i + 1
            end = max(self.annotation(self.close[c] + 1), self.close[c] + 1)
            self.gone(begin, begin)
            return self.drop(begin, end + (self.text(end) == ";"))
        if named:
            self.declared.append((k, "function"))
            if not statement:  # its name is known inside alone
                self.intervals.append((k, e - 1, True))
        return e

    def class_(self, i: int, a: int) -> int:
        k = i + 1
        if self.word(k) and self.word(k) not in ("extends", "implements"):
            self.declared.append((k, "class"))
            if self.text(self.before(i)) in ("=", "(", ",", ":", "return", "=>", "?", "[", "new"):
                self.intervals.append((k, self.close.get(self.braced(k), k), False))
            k += 1
        while k < self.n and self.text(k) != "{":
            if self.text(k) == "<":
                e = self.type_parameters(k)
                e = e if e > 0 else self.type_arguments(k)
                k = self.drop(k, e) if e > 0 else k + 1
            elif self.word(k) == "implements":
                e = self.braced(k)
                k = self.drop(k, e)
            elif self.text(k) in ("(", "["):
                k = self.wait(k, "list")
            else:
                if self.text(k - 1) == "." or self.word(k) == "extends":
                    self.keys.add(k)
                k += 1
        return self.wait(k, "class") if k < self.n else k

    def braced(self, k: int) -> int:
        """The { of a class's body after token k: types between may hold braces too."""
        while k < self.n and self.text(k) != "{":
            e = self.type_arguments(k) if self.text(k) == "<" else -1
            if e < 0 and self.text(k) == "<":
                e = self.type_parameters(k)
            k = e if e > 0 else self.close[k] + 1 if k in self.close else k + 1
        return k

    def parenthesis(self, i: int, questions: int) -> int:
        """Parameters of an arrow function, or anything else in parentheses."""
        c = self.close[i]
        arrow = -1
        if self.t[i].parts:  # a hole of a template or of JSX
            return self.wait(i, "list")
        if self.text(c + 1) == "=>":
            arrow = c + 1
        elif self.text(c + 1) == ":":
            e = self.type_(c + 2)
            # in a?(b):c=>d the colon belongs to the question, unless another one follows
            if e > 0 and self.text(e) == "=>" and (not questions or self.text(self.arrow_end(e, self.n) + 1) == ":"):
                self.drop(c + 1, e)
                arrow = e
        if arrow < 0:
            return self.wait(i, "list")
        self.wait(i, "params", "param")
        self.intervals.append((i, self.arrow_end(arrow, self.n), True))
        return arrow

    def arrow_end(self, k: int, b: int) -> int:
        """The last token of the function whose => is token k."""
        return self.close[k + 1] if self.text(k + 1) == "{" else max(k, self.value_end(k + 1, b) - 1)

    def value_end(self, k: int, b: int) -> int:
        first, questions = k, 0
        while k < b:
            x = self.text(k)
            if self.t[k].kind == "punct" and (x in (",", ";", ")", "]", "}") or x == ":" and not questions):
                return k
            questions += (x == "?") - (x == ":")
            if k > first and self.new_line(k) and self.ended(k - 1) and (self.t[k].kind != "punct" or self.t[k].text in ("{", "++", "--", "@")) and self.word(k) not in ("in", "of", "instanceof", "as", "satisfies"):
                return k
            k = self.close[k] + 1 if k in self.close else k + 1
        return k

    def brace(self, i: int, mode: str, a: int, questions: int) -> int:
        k = self.before(i)
        x = self.text(k)
        block = x in (")", "=>", "else", "try", "finally", "do", "catch") or mode == "block" and not questions and (k < a or x in (";", "{", "}", ":") or self.new_line(i) and self.ended(k))
        if not block:
            return self.wait(i, "object")
        self.intervals.append((i, self.close[i], False))
        return self.wait(i, "block")

    def angle(self, i: int) -> int:
        """Type arguments after a value, type parameters or a cast where a value starts; else a comparison."""
        k = self.before(i)
        if self.text(k) == "?." or self.ended(k) and self.t[k].kind in ("word", "punct") and self.text(k) != "}":
            e = self.type_arguments(i)
            if e > 0 and self.may_follow_arguments(e):
                return self.close_angle(i, e)
            if self.word(k) == "async" and (e := self.type_parameters(i)) > 0 and self.text(e) == "(":
                return self.drop(i, e)
            return i + 1
        e = self.type_parameters(i)
        e = e if e > 0 else self.type_arguments(i)
        return self.drop(i, e) if e > 0 else i + 1

    # --- names

    def bind(self) -> None:
        """Scopes as a tree, and every declared name in the scope that it belongs to."""
        self.scopes = [Scope(*x) for x in sorted(set(self.intervals), key=lambda x: (x[0], -x[1]))]
        above: list[Scope] = []
        for s in self.scopes:
            while above and above[-1].end < s.start:
                above.pop()
            s.parent = above[-1] if above else None
            above.append(s)
        self._starts = [s.start for s in self.scopes]
        for at, how in sorted(self.declared):
            s = self.scope(at)
            while how == "var" and not s.is_function and s.parent:
                s = s.parent
            self.keys.add(at)
            name = self.t[at].text
            if name not in s.names or how != "var":
                s.names[name] = Name(at, how, s)

    def scope(self, i: int) -> Scope:
        if self.scopes is None:
            self.bind()
        s = self.scopes[bisect_right(self._starts, i) - 1]
        while s.parent and s.end < i:
            s = s.parent
        return s

    def meaning(self, name: str, i: int) -> Name | None:
        """What a name used at token i is bound to, wherever in its scope it is declared; None for globals."""
        s = self.scope(i)
        while s:
            if name in s.names:
                return s.names[name]
            s = s.parent
        return None

    def at_top(self, name: Name) -> bool:
        return name.scope is self.scopes[0]

    def uses(self):
        """(token, name it is bound to) of every identifier that is used."""
        for i, t in enumerate(self.t):
            if t.kind == "word" and not self.dropped[i] and i not in self.keys and self.text(i - 1) not in (".", "?.") and (found := self.meaning(t.text, i)):
                yield i, found
