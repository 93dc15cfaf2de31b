"""Facts about JavaScript and TypeScript sources: a tokenizer, and what a token stream declares, imports, calls and uses.

Types are taken out first (see outline), whatever a file is named; what is left is read as JavaScript.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field

from .outline import BEFORE_EXPRESSION, CLOSE, OPEN, Outline

WORD = re.compile(r"[A-Za-z_$\u0080-\uffff][\w$\u0080-\uffff]*")
NUMBER = re.compile(r"(?:0[xXbBoO][\da-fA-F_]+|\d[\d_]*(?:\.[\d_]*)?(?:[eE][+-]?\d+)?|\.\d[\d_]*(?:[eE][+-]?\d+)?)n?")
PUNCTUATION = re.compile(r"[(){}\[\];,:@#~]|=>|\?\.(?!\d)|\.\.\.|===|!==|==|!=|<=|>=|&&=|\|\|=|\?\?=|&&|\|\||\?\?|\+\+|--|\*\*=?|[-+*/%&|^]=|.", re.S)
REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
ESCAPE = re.compile(r"\\(u\{[\da-fA-F]+\}|u[\da-fA-F]{4}|x[\da-fA-F]{2}|\r?\n|.)", re.S)
#: White space, and the word, number, sign or plain string after it unless a quote, a slash or an angle opens something else there: most tokens are one match.
NEXT = re.compile(rf"([\s\ufeff]*)(?:({WORD.pattern})|({NUMBER.pattern})|(?!['\"`/<])({PUNCTUATION.pattern})|\"([^\"\\\n]*)\"|'([^'\\\n]*)')?", re.S)
KINDS = (None, None, "word", "number", "punct", "string", "string")
SPACE = re.compile(r"[\s\ufeff]+")
#: The inside of a string, up to its quote or the end of the line; the plain parts of templates and of what stands between tags.
QUOTED = {q: re.compile(rf"(?:[^{q}\\\n]+|\\.?)*", re.S) for q in "'\""}
PLAIN, CHILDREN = re.compile(r"[^`\\$]+"), re.compile(r"[^{<]+")
TAG, NAME, ATTRIBUTE = re.compile(r"<([A-Za-z_$][\w$.:-]*|(?=>))"), re.compile(r"\s*([\w$.:-]*)"), re.compile(r"([\w$:-]+)\s*(=)?\s*")
#: What opens type parameters where JSX could stand: <T,> or <T extends U> or <T = U>.
PARAMETERS = re.compile(r"<\s*(?:const\s+)?[A-Za-z_$][\w$]*\s*(?:,|extends\s+(?![=>/])|=(?!>))")
#: Keywords whose parentheses are no call (fixed values).
NO_CALL = frozenset("if for while switch catch function return typeof await yield super import with constructor void delete new throw case in of instanceof do else".split())
#: Stands for what a template puts in (fixed value).
HOLE = "${…}"


@dataclass(slots=True)
class Token:
    kind: str  # word, number, string, template, regex, punct, jsx
    text: str
    line: int
    parts: dict | None = None


def _unescape(text: str) -> str:
    plain = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0"}

    def one(m: re.Match) -> str:
        e = m[1]
        if e[0] in "ux" and len(e) > 1:
            return chr(int(e.strip("ux{}"), 16))
        return "" if e in ("\n", "\r\n") else plain.get(e, e)

    return ESCAPE.sub(one, text) if "\\" in text else text


class Lexer:
    def __init__(self, source: str, past: int = -1) -> None:
        """past: where the last import may start, if nothing after it is to be read."""
        self.s, self.at, self.line, self.past = source, 0, 1, past
        self.out: list[Token] = []
        self.counted, self.open = 0, 0

    def add(self, kind: str, text: str, line: int | None = None, parts: dict | None = None) -> Token:
        self.out.append(t := Token(kind, text, line or self.line, parts))
        return t

    def move(self, to: int) -> str:
        text = self.s[self.at : to]
        self.line += text.count("\n")
        self.at = to
        return text

    def value_ended(self) -> bool:
        """Whether the last token ends a value, so that / divides and < compares."""
        if not self.out:
            return False
        t = self.out[-1]
        if t.kind == "word":
            return t.text not in BEFORE_EXPRESSION
        return t.kind != "punct" or t.text in (")", "]", "}", "++", "--")

    def skip_space(self) -> None:
        while self.at < len(self.s):
            if m := SPACE.match(self.s, self.at):
                self.move(m.end())
            elif self.s.startswith("//", self.at) or (self.at == 0 and self.s.startswith("#!")):
                end = self.s.find("\n", self.at)
                self.move(len(self.s) if end < 0 else end)
            elif self.s.startswith("/*", self.at):
                end = self.s.find("*/", self.at + 2)
                self.move(len(self.s) if end < 0 else end + 2)
            else:
                return

    def run(self, closing: str | None = None) -> None:
        """Tokens up to the bracket that closes what the caller opened, or the end."""
        depth, s, out, past = 0, self.s, self.out, self.past
        self.skip_space()
        while True:
            line = self.line
            for m in NEXT.finditer(s, self.at):
                space, k = m[1], m.lastindex
                if space and space != " ":
                    line += space.count("\n")
                if k == 1:
                    break
                text = m[k]
                if k == 4:
                    if closing:
                        if not depth and text == closing:
                            self.at, self.line = m.start(4), line
                            return
                        depth += (text in OPEN) - (text in CLOSE)
                out.append(Token(KINDS[k], text, line))
                if past >= 0 and not closing and (k > 4 or text == ";") and m.end() > past and self.balanced():
                    self.at, self.line = len(s), line
                    return
            self.at, self.line = m.end(), line
            if s.startswith(("//", "/*"), self.at):
                self.skip_space()
                continue
            if self.at >= len(s):
                return
            c = s[self.at]
            if c in "'\"":
                self.quoted(c)
            elif c == "`":
                self.template()
            elif c == "/" and (not self.value_ended() or self.out[-1].text == "}") and (m := REGEX.match(self.s, self.at)):
                self.add("regex", m[0])
                self.move(m.end())
            elif c == "<" and (not self.value_ended() or self.out[-1].text == "}") and self.tried_element():
                pass
            else:
                m = PUNCTUATION.match(self.s, self.at)
                self.add("punct", m[0])
                self.move(m.end())

    def balanced(self) -> bool:
        """Whether all brackets are closed, so that no import is open after its string or semicolon."""
        for t in self.out[self.counted :]:
            if t.kind == "punct":
                self.open += (t.text in OPEN) - (t.text in CLOSE)
        self.counted = len(self.out)
        return not self.open

    def quoted(self, quote: str) -> str:
        line = self.line
        end = QUOTED[quote].match(self.s, self.at + 1).end()
        text = _unescape(self.s[self.at + 1 : end])
        self.move(min(end + 1, len(self.s)))
        self.add("string", text, line)
        return text

    def template(self) -> None:
        line, pieces, start = self.line, [], self.at + 1
        own = self.add("template", "", line)
        self.move(self.at + 1)
        while self.at < len(self.s) and self.s[self.at] != "`":
            if self.s[self.at] == "\\":
                self.move(self.at + 2)
            elif self.s.startswith("${", self.at):
                pieces.append(self.s[start : self.at])
                self.move(self.at + 2)
                self.add("punct", "(", parts={"hole": True})
                self.run("}")
                self.add("punct", ")")
                self.move(min(self.at + 1, len(self.s)))
                start = self.at
            else:
                self.move(m.end() if (m := PLAIN.match(self.s, self.at)) else self.at + 1)
        pieces.append(self.s[start : self.at])
        self.move(min(self.at + 1, len(self.s)))
        own.text = HOLE.join(map(_unescape, pieces))
        own.parts = {"holes": len(pieces) - 1}

    def braces(self) -> None:
        """{expression} in JSX, as a parenthesis of its own."""
        self.move(self.at + 1)
        self.add("punct", "(", parts={"hole": True})
        self.run("}")
        self.add("punct", ")")
        self.move(min(self.at + 1, len(self.s)))

    def tried_element(self) -> bool:
        """A JSX element at a <, if it is closed; else nothing is read, as types may stand there."""
        m = TAG.match(self.s, self.at)
        if not m or PARAMETERS.match(self.s, self.at):
            return False
        if self.s.find("/>", self.at) < 0 and self.s.find(f"</{m[1]}", self.at) < 0:
            return False
        before = self.at, self.line, len(self.out)
        if self.element():
            return True
        self.at, self.line = before[:2]
        del self.out[before[2] :]
        return False

    def type_arguments(self) -> None:
        """Passes over <...> after a tag's name."""
        depth, end = 0, self.at
        while end < len(self.s):
            depth += (self.s[end] == "<") - (self.s[end] == ">" and self.s[end - 1] != "=")
            end += 1
            if not depth:
                break
        self.move(end)

    def element(self) -> bool:
        """One JSX element with its children: a jsx token for each opening tag, tokens of expressions in parentheses. Whether it is closed."""
        line = self.line
        self.move(self.at + 1)
        m = NAME.match(self.s, self.at)
        self.move(m.end())
        tag = self.add("jsx", m[1], line, {})
        if self.s[self.at : self.at + 1] == "<":
            self.type_arguments()
        while self.at < len(self.s):
            self.skip_space()
            if self.s.startswith("/>", self.at):
                self.move(self.at + 2)
                return True
            c = self.s[self.at : self.at + 1]
            if c == ">":
                self.move(self.at + 1)
                break
            if c == "{":
                self.braces()
            elif m := ATTRIBUTE.match(self.s, self.at):
                self.move(m.end())
                if m[2] and self.s[self.at : self.at + 1] in ("'", '"'):
                    quote = self.s[self.at]
                    end = self.s.find(quote, self.at + 1)
                    end = len(self.s) if end < 0 else end
                    tag.parts[m[1]] = self.s[self.at + 1 : end]
                    self.move(min(end + 1, len(self.s)))
                elif m[2] and self.s[self.at : self.at + 1] == "{":
                    self.braces()
                elif m[2] and self.s[self.at : self.at + 1] == "<" and not self.element():
                    return False
            elif c in "=(;),":  # no attribute: this is no tag
                return False
            else:
                self.move(self.at + 1)
        while self.at < len(self.s):
            if self.s.startswith("</", self.at):
                end = self.s.find(">", self.at)
                closed = end >= 0 and self.s[self.at + 2 : end].strip() == tag.text
                self.move(len(self.s) if end < 0 else end + 1)
                return closed
            c = self.s[self.at]
            if c == "{":
                self.braces()
            elif c == "<":
                if not self.element():
                    return False
            else:
                self.move(CHILDREN.match(self.s, self.at).end())
        return False


def tokenize(source: str, imports: bool = False) -> list[Token]:
    """Tokens of a source; imports: up to the end of the statement with the last word that can be an import, as no later one tells of any."""
    past = source.rfind("import") if imports else -1
    if imports and past < 0:
        return []
    lexer = Lexer(source, past)
    while lexer.at < len(source):
        lexer.run()
    return lexer.out


#: Facts for which the rest of a source after its last import need not be read.
IMPORTS = frozenset(("import",))


@dataclass(slots=True)
class Fact:
    """One thing a source says. `what`: import, export, reexport, function, arrow, variable, class, call, jsx, use, and element for a tag like <ns.Row>.

    bound: what the called, shown or used name means where it stands: import, top (declared in the file's outermost
    scope), local, or nothing that the file declares. A use of ns.x has x as its arg, and is a member if that is called. imported and locals: the names on both sides of an import
    (the module's, the file's), an export (the file's, the module's) or a re-export (theirs, the module's); * is all.
    """

    what: str
    name: str = ""
    line: int = 0
    end_line: int | None = None
    caller: str | None = None
    object: str | None = None
    member: bool = False
    exported: bool = False
    is_async: bool = False
    arg: str | None = None
    arg_name: str | None = None
    url: str | None = None
    method: str | None = None
    action: str | None = None
    init: str | None = None
    super: str | None = None
    catches: bool = False
    env_key: str | None = None
    names: list[str] = field(default_factory=list)
    bound: str | None = None
    imported: list[str] = field(default_factory=list)
    locals: list[str] = field(default_factory=list)
    seq: int = 0


class Reader:
    """Facts of the tokens that an outline leaves. wanted: the kinds of facts to give, with no meaning of names (bound); by default all."""

    def __init__(self, outline: Outline, wanted: frozenset[str] | None = None) -> None:
        self.outline, self.wanted = outline, wanted
        self.exports: list[tuple[int, str]] = []
        self.scopes: list[tuple[int, int, str]] = []
        self.methods: set[int] = set()
        self.facts: list[tuple[int, Fact]] = []
        if 1 not in outline.dropped:  # nothing is taken out, so all that the outline knows of its tokens holds
            self.places, self.t, self.n, self.words, self.texts, self.close = range(outline.n), outline.t, outline.n, outline.words, outline.texts, outline.close
            return
        self.places = [i for i in range(outline.n) if not outline.dropped[i]]
        self.t = tokens = [outline.t[i] for i in self.places]
        self.n = len(tokens)
        self.words = [t.text if t.kind == "word" else "" for t in tokens]
        self.texts = [t.text if t.kind == "word" or t.kind == "punct" else "" for t in tokens]
        self.close: dict[int, int] = {}
        opened: list[int] = []
        for i, t in enumerate(tokens):
            if t.kind == "punct":
                if t.text in OPEN:
                    opened.append(i)
                elif t.text in CLOSE and opened:
                    self.close[opened.pop()] = i
        for i in opened:
            self.close[i] = len(tokens) - 1

    def text(self, i: int) -> str:
        return self.texts[i] if 0 <= i < self.n else ""

    def word(self, i: int) -> str:
        return self.words[i] if 0 <= i < self.n else ""

    def wants(self, *whats: str) -> bool:
        return self.wanted is None or not self.wanted.isdisjoint(whats)

    def read(self) -> list[Fact]:
        handlers = {"import": self.import_, "export": self.export, "function": self.function, "class": self.class_, "const": self.variables, "let": self.variables, "var": self.variables}
        if not self.wants("import"):
            del handlers["import"]
        if self.wanted == IMPORTS:
            handlers = {"import": self.import_}
        for i, w in enumerate(self.words):
            if w in handlers and self.text(i - 1) not in (".", "?.") and self.text(i + 1) != ":":
                handlers[w](i)
        texts, end = self.texts, self.n - 1
        for i, t in enumerate(self.t) if self.wants("call", "jsx", "element", "use") else ():
            if t.kind == "word":
                if i < end and texts[i + 1] == "(" and (t.text not in NO_CALL or self.text(i - 1) == ".") and i not in self.methods:
                    self.call(i)
            elif t.kind != "jsx":
                continue
            elif "." in t.text and not t.text[:1].isupper():
                self.facts.append((i, Fact("element", t.text, t.line, bound=self.meaning(t.text.partition(".")[0], i))))
            elif t.text[:1].isupper():
                self.facts.append((i, Fact("jsx", t.text, t.line, arg=t.parts.get("name"), bound=self.meaning(t.text.partition(".")[0], i))))
        if self.wanted is None:
            self.bind()
        else:
            self.facts = [x for x in self.facts if x[1].what in self.wanted]
        self.scopes.sort()
        exported: dict[str, int] = {}
        for at, name in self.exports:
            exported[name] = min(at, exported.get(name, at))
        starts = [a for a, _, _ in self.scopes]
        out = []
        for seq, (i, f) in enumerate(sorted(self.facts, key=lambda x: x[0])):
            k = bisect_right(starts, i) - 1
            while k >= 0 and self.scopes[k][1] < i:
                k -= 1
            f.caller = self.scopes[k][2] if k >= 0 and f.what in ("call", "jsx", "element", "use") else None
            # a name counts as exported if its export comes no later than the declaration
            f.exported = exported.get(f.name, i + 1) <= i
            f.seq = seq
            out.append(f)
        return out

    def import_(self, i: int) -> None:
        if self.text(i + 1) in ("(", "."):
            return
        names, imported, locals_, k = [], [], [], i + 1
        if self.word(k) == "type" and self.text(k + 1) != "from":
            k += 1
        while k < len(self.t) and self.t[k].kind != "string":
            t = self.t[k]
            if t.text == "{" and t.kind == "punct":
                pairs = self.specifiers(k)
                names += [a for a, _ in pairs]
                imported += [a for a, _ in pairs]
                locals_ += [b for _, b in pairs]
                k = self.close[k]
            elif t.text == "*" or (t.kind == "word" and t.text not in ("from", "as") and self.text(k - 1) != "as"):
                names.append("default")
                imported.append("*" if t.text == "*" else "default")
                locals_.append(self.word(k + 2) if t.text == "*" else t.text)
            elif t.text == ";":
                return
            k += 1
        if k < len(self.t):
            self.facts.append((i, Fact("import", self.t[k].text, self.t[i].line, names=names, imported=imported, locals=locals_)))

    def specifiers(self, opened: int) -> list[tuple[str, str]]:
        """The pairs of names in { a, b as c }."""
        out = []
        for j in range(opened + 1, self.close[opened]):
            if self.t[j].kind in ("word", "string") and self.text(j - 1) in ("{", ",", "type") and self.text(j + 1) in (",", "}", "as"):
                other = j + 2 if self.text(j + 1) == "as" else j
                out.append((self.t[j].text, self.t[min(other, len(self.t) - 1)].text))
        return out

    def exporting(self, i: int) -> None:
        """What other files can take from this one, under which name; exports inside a namespace are none."""
        k, line = i + 1, self.t[i].line
        if not self.wants("export", "reexport") or self.outline.scope(self.places[i]).parent:
            return
        if self.text(k) == "*" or self.text(k) == "{":
            end = self.close[k] if self.text(k) == "{" else k + 2 * (self.word(k + 1) == "as")
            pairs = self.specifiers(k) if self.text(k) == "{" else [("*", self.word(end) or "*")]
            if self.word(end + 1) == "from" and end + 2 < len(self.t) and self.t[end + 2].kind == "string":
                self.facts.append((i, Fact("reexport", self.t[end + 2].text, line, imported=[a for a, _ in pairs], locals=[b for _, b in pairs])))
                return
        else:
            default = self.word(k) == "default"
            k += default
            k += self.word(k) == "async" and self.word(k + 1) == "function"
            names = []
            if self.word(k) in ("function", "class"):
                k += 1 + (self.text(k + 1) == "*")
                names = [self.word(k)] if self.word(k) and self.word(k) != "extends" else []
            elif self.word(k) in ("const", "let", "var"):
                names = [name for name, *_ in self.declarators(k)]
            elif default and self.word(k) and (self.text(k + 1) in ("", ";", "}") or k + 1 < len(self.t) and self.t[k + 1].line > self.t[k].line):
                names = [self.word(k)]
            pairs = [(name, "default" if default else name) for name in names]
        if pairs:
            self.facts.append((i, Fact("export", "", line, imported=[a for a, _ in pairs], locals=[b for _, b in pairs])))

    def meaning(self, name: str, i: int) -> str | None:
        found = self.outline.meaning(name, self.places[i]) if self.wanted is None else None
        if not found:
            return None
        return ("import" if found.how == "import" else "top") if self.outline.at_top(found) else "local"

    def bind(self) -> None:
        """Facts about uses of names that the outermost scope declares or imports, other than calls."""
        new = {old: i for i, old in enumerate(self.places)}
        kinds = {}  # token of a declared name: where its node's id comes from
        for i, f in self.facts:
            if f.what in ("function", "class"):
                kinds[self.places[i + 1 + (self.text(i + 1) == "*")]] = "symbol"
            elif f.what in ("arrow", "variable"):
                kinds[self.places[i]] = "symbol" if f.what == "arrow" else "variable"
        called = {i for i, f in self.facts if f.what == "call" and not f.member}
        for old, name in list(self.outline.uses()):
            kind = "import" if name.how == "import" else kinds.get(name.at)
            if kind and self.outline.at_top(name) and new[old] not in called:
                t, i = self.outline.t[old], new[old]
                taken = self.word(i + 2) if self.text(i + 1) == "." else None
                self.facts.append((i, Fact("use", t.text, t.line, action=kind, bound="import" if kind == "import" else "top", arg=taken or None, member=bool(taken) and self.text(i + 3) == "(")))

    def export(self, i: int) -> None:
        self.exporting(i)
        k = i + 1
        if self.word(k) == "default":
            k += 1
            k += self.word(k) == "async"
            if self.word(k) in ("function", "class"):
                k += 1 + (self.text(k + 1) == "*")
                if self.word(k) and self.word(k) != "extends":
                    self.exports.append((i, self.word(k)))
            elif self.word(k) and self.text(k + 1) not in ("(", ".", "=>", "?."):
                self.exports.append((i, self.word(k)))
        elif self.text(k) == "{":
            for j in range(k + 1, self.close[k]):
                if self.word(j) and self.text(j + 1) in (",", "}") and self.word(j) != "as":
                    self.exports.append((i, self.word(j)))
        else:
            k += self.word(k) == "async"
            if self.word(k) in ("function", "class"):
                k += 1 + (self.text(k + 1) == "*")
                self.exports.append((i, self.word(k)))
            elif self.word(k) in ("const", "let", "var"):
                self.exports += [(i, name) for name, *_ in self.declarators(k)]

    def body(self, k: int) -> int:
        """Index of the { of a function whose parameters open at k, or -1."""
        k = self.close.get(k, len(self.t)) + 1
        if self.text(k) == ":":  # a return type; an object type is a pair of braces before the body's
            k, angles = k + 1, 0
            while k < len(self.t) and (angles or self.text(k) not in ("{", ";", "=>")):
                angles += (self.text(k) == "<") - (self.text(k) == ">")
                k = self.close[k] + 1 if k in self.close else k + 1
            if self.text(k) == "{" and self.text(self.close[k] + 1) == "{":
                k = self.close[k] + 1
        return k if self.text(k) == "{" else -1

    def function(self, i: int) -> None:
        before = i - (self.word(i - 1) == "async")
        k = i + 1 + (self.text(i + 1) == "*")
        name, last = self.word(k), self.text(before - 1)
        statement = before == 0 or last in (";", "{", "}", ")", "export", "default", "else") or self.t[before - 1].kind in ("string", "template", "number") or (self.t[before - 1].kind == "word" and last not in BEFORE_EXPRESSION)
        if not name or not statement or self.text(k + 1) not in ("(", "<"):
            self.methods.add(k)
            return
        self.methods.add(k)
        while self.text(k) != "(" and k < len(self.t) - 1:
            k += 1
        start = self.body(k)
        if start >= 0:
            end = self.close[start]
            self.scopes.append((i, end, name))
            self.facts.append((i, Fact("function", name, self.t[before].line, self.t[end].line, is_async=before < i)))

    def class_(self, i: int) -> None:
        name = self.word(i + 1)
        if not name or name == "extends" or self.text(i - 1) in ("=", "(", ",", ":", "return"):
            name = ""
        k, parent = i + 1 + bool(name), None
        while k < len(self.t) and self.text(k) != "{":
            if self.word(k) == "extends":
                parent = self.word(k + 1) or None
                if parent and self.text(k + 2) == ".":
                    parent = f"{parent}.{self.word(k + 3)}" if self.text(k + 4) != "." else None
                elif self.text(k + 2) == "(":
                    parent = None
            k = self.close[k] + 1 if self.text(k) in ("(", "[") else k + 1
        if k >= len(self.t):
            return
        end, j, catches = self.close[k], k + 1, False
        while j < end:  # members stand directly in the body
            if self.word(j) and self.text(j + 1) == "(" and self.text(j - 1) not in (".", "=", "new"):
                start = self.body(j + 1)
                if start >= 0:
                    self.methods.add(j)
                    catches |= self.word(j) == "componentDidCatch"
                    j = self.close[start] + 1
                    continue
            j = self.close[j] + 1 if j in self.close else j + 1
        if name:
            self.facts.append((i, Fact("class", name, self.t[i].line, self.t[end].line, super=parent, catches=catches)))

    def declarators(self, i: int) -> list[tuple[str, int, int, int]]:
        """(name, its index, first index of the value or -1, end of the value) of each plain name after const, let or var."""
        out, k = [], i + 1
        while k < len(self.t):
            name, at = self.word(k), k
            k = self.close[k] + 1 if k in self.close else k + 1
            if self.text(k) == "!":
                k += 1
            if self.text(k) == ":":
                while k < len(self.t) and self.text(k) not in ("=", ",", ";", ")", "of", "in"):
                    k = self.close[k] + 1 if k in self.close else k + 1
            start = -1
            if self.text(k) == "=":
                start = k + 1
                k = self.value_end(start)
            if name:
                out.append((name, at, start, k))
            if self.text(k) != ",":
                break
            k += 1
        return out

    def value_end(self, k: int) -> int:
        start = k
        while k < len(self.t):
            t = self.t[k]
            if t.kind == "punct" and t.text in (",", ";", ")", "]", "}"):
                return k
            if k > start and t.line > self.t[k - 1].line and self.ends_value(k - 1) and (t.kind != "punct" or t.text in ("{", "++", "--", "@")) and t.text not in ("in", "of", "instanceof", "as"):
                return k
            k = self.close[k] + 1 if k in self.close else k + 1
        return k

    def ends_value(self, i: int) -> bool:
        t = self.t[i]
        return t.text in (")", "]", "}") if t.kind == "punct" else t.text not in BEFORE_EXPRESSION

    def variables(self, i: int) -> None:
        for name, at, start, end in self.declarators(i):
            line, k = self.t[at].line, start
            is_async = start >= 0 and self.word(k) == "async" and self.text(k + 1) != "=>"
            k += is_async
            arrow = -1
            if start >= 0 and self.word(k) == "function":
                while self.text(k) != "(" and k < len(self.t) - 1:
                    k += 1
                arrow = self.body(k)
                last = self.close.get(arrow, arrow)
            elif start >= 0:
                if self.text(k) == "<":
                    while k < end and self.text(k) != "(":
                        k += 1
                j = self.close[k] + 1 if self.text(k) == "(" else k + 1 if self.word(k) else -1
                if j >= 0 and self.text(k) == "(" and self.text(j) == ":":
                    while j < end and self.text(j) != "=>":
                        j = self.close[j] + 1 if j in self.close else j + 1
                if j >= 0 and self.text(j) == "=>":
                    arrow, last = j, self.close[j + 1] if self.text(j + 1) == "{" else max(j, end - 1)
            if arrow >= 0:
                self.scopes.append((start, last, name))
                self.facts.append((at, Fact("arrow", name, line, self.t[min(last, len(self.t) - 1)].line, is_async=is_async)))
                continue
            f = Fact("variable", name, line)
            if start >= 0 and self.word(start) and self.text(start + 1) == "(":
                f.init = self.word(start)
                if self.text(self.close[start + 1] + 1) == "(":
                    f.init += "()"
            if start >= 0 and [self.text(start + n) for n in range(4)] == ["process", ".", "env", "."]:
                f.env_key = self.word(start + 4)
            self.facts.append((at, f))

    def call(self, i: int) -> None:
        t, opened = self.t[i], i + 1
        before, end = self.text(i - 1), self.close[opened]
        if before in ("new", "function", "?.") or self.text(end + 1) in ("{", "=>") and (before in ("", "{", ",", "}", ";", "async", "get", "set", "static", "*") or self.text(end + 1) == "=>"):
            return
        member = before == "."
        obj = self.word(i - 2) if member and self.text(i - 3) not in (".", "?.") else None
        if self.word(i - 2) == "new" or (member and self.text(i - 3) == "new"):
            return
        f = Fact("call", t.text, t.line, object=obj or None, member=member)
        f.bound = self.meaning(obj, i - 2) if obj else None if member else self.meaning(t.text, i)
        if member and obj:
            f.line = self.t[i - 2].line
        args = self.arguments(opened)
        if args:
            a, b = args[0]
            first = self.t[a]
            if b - a == 1 and first.kind == "string":
                f.arg = first.text
            elif b - a == 1 and first.kind == "word":
                f.arg_name = first.text
            elif self.text(a) == "{":
                f.action = self.property(a, "type")
        for a, b in args[:2]:
            if b - a == 1 and self.t[a].kind == "string" or self.t[a].kind == "template" and (a, b) == args[0] and self.holes_only(a, b):
                f.url = self.t[a].text
                break
        if len(args) > 1 and self.text(args[1][0]) == "{" and (m := self.property(args[1][0], "method")):
            f.method = m.upper()
        self.facts.append((i, f))

    def holes_only(self, a: int, b: int) -> bool:
        k, holes = a + 1, 0
        while k < b and self.text(k) == "(":
            k, holes = self.close[k] + 1, holes + 1
        return k == b and holes == self.t[a].parts["holes"]

    def arguments(self, opened: int) -> list[tuple[int, int]]:
        out, start, k, end = [], opened + 1, opened + 1, self.close[opened]
        while k < end:
            if self.text(k) == ",":
                out.append((start, k))
                start = k + 1
            k = self.close[k] + 1 if k in self.close else k + 1
        return [(a, b) for a, b in [*out, (start, end)] if a < b]

    def property(self, opened: int, name: str) -> str | None:
        k, end = opened + 1, self.close[opened]
        while k < end:
            if self.word(k) == name and self.text(k + 1) == ":" and self.t[k + 2].kind == "string":
                return self.t[k + 2].text
            k = self.close[k] + 1 if k in self.close else k + 1
        return None


def facts(source: str, path: str = "", wanted: frozenset[str] | None = None) -> list[Fact]:
    """Facts in source order, all or those whose `what` is wanted (bound is null then); a source that cannot be read to its end gives those of what was read."""
    return Reader(Outline(tokenize(source, wanted == IMPORTS)), wanted).read()
