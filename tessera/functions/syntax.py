"""Declarations, scopes, imports, calls, references and conditions of one source text.

A reader of brackets and statements, not a full grammar: it knows the forms that declare names in each dialect and takes
all other identifiers as uses. What it covers is stated by the tables below and the tests; what it can't read is still
read as uses, never as declarations, and unbalanced brackets make the parse partial.
"""

from __future__ import annotations

import hashlib
import time
from bisect import bisect_right
from collections import deque
from dataclasses import dataclass, field

from tessera.functions.lexing import ECMA, Offsets, Token, pairs, tokens

#: Largest source, observations, nodes and diagnostics of a file.
SOURCE_BYTES, OBSERVATIONS, NODES, DIAGNOSTICS = 2 << 20, 20_000, 200_000, 256
#: Seconds that a file may take, and characters of a place in the tree before its hash stands for it.
SECONDS, PLACE = 30.0, 2048

_COMMON = "if else for while do switch case default break continue return try catch finally throw new this super null true false in is as void static const var let final"
KEYWORDS = {
    "rust": "as async await box break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type union unsafe use where while",
    "go": "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var nil true false iota",
    "java": f"{_COMMON} abstract assert boolean byte char class double enum extends float implements import instanceof int interface long native package private protected public short strictfp synchronized throws transient volatile yield sealed permits non",
    "csharp": f"{_COMMON} abstract async await base bool byte char class checked decimal delegate double enum event explicit extern fixed float foreach get goto implicit init int interface internal lock long namespace object operator out override params partial private protected public readonly record ref required sbyte sealed set short sizeof stackalloc string struct typeof uint ulong unchecked unsafe ushort using value virtual volatile when where with yield add remove",
    "dart": f"{_COMMON} abstract assert async await base class covariant deferred dynamic enum export extends extension external factory Function get hide implements import interface late library mixin on operator part required rethrow sealed set show sync typedef when with yield bool int double num",
    "ecma": f"{_COMMON} async await class debugger delete export extends from function import instanceof of typeof with yield undefined get set",
}
KEYWORDS = {k: frozenset(v.split()) for k, v in KEYWORDS.items()}
_TYPED = frozenset("interface type enum namespace module declare abstract readonly public private protected implements keyof infer is asserts satisfies override any unknown never string number boolean object symbol bigint".split())
#: Words that may stand before a declaration.
MODIFIERS = frozenset(
    "pub public private protected internal static final abstract sealed virtual override async unsafe extern readonly partial export default declare const native synchronized "
    "transient volatile strictfp default new required external covariant late base interface mixin ref fixed event file record".split()
)
_TYPES = {
    "rust": {"struct": "struct", "enum": "enum", "union": "union", "trait": "trait", "type": "type_alias", "mod": "module"},
    "java": {"class": "class", "interface": "interface", "enum": "enum", "record": "record", "@interface": "annotation_type"},
    "csharp": {"class": "class", "struct": "struct", "interface": "interface", "enum": "enum", "record": "record", "namespace": "namespace"},
    "dart": {"class": "class", "mixin": "mixin", "enum": "enum", "extension": "extension", "typedef": "type_alias"},
    "ecma": {"class": "class", "interface": "interface", "enum": "enum", "namespace": "namespace", "module": "namespace", "type": "type_alias"},
}
_SCOPE_OF = {"module": "module", "namespace": "namespace"}


@dataclass
class Observation:
    category: str
    kind: str
    spelling: str
    start: int
    end: int
    syntax_start: int
    syntax_end: int
    scope: str | None = None
    container: str | None = None
    signature: str | None = None
    receiver: str | None = None
    alias: str | None = None
    attributes: list[str] = field(default_factory=list)
    limitations: list[str] = field(default_factory=list)
    id: str = ""


class Reader:
    def __init__(self, text: str, language: str, path: str, seconds: float = SECONDS):
        self.text, self.language, self.path = text, language, path
        self.until, self.faults = time.monotonic() + seconds, []
        self.todo: deque[tuple[int, int, Context]] = deque()
        self.family = "ecma" if language in ECMA else language
        self.typed = language in ("typescript", "tsx")
        self.keywords = KEYWORDS[self.family] | (_TYPED if self.typed else frozenset())
        self.t = [x for x in tokens(text, language) if x.kind != "pound"]
        self.pound = [x for x in tokens(text, language) if x.kind == "pound"] if language == "csharp" else []
        if len(self.t) > NODES:
            self.fault("node_limit_reached", f"read up to node {NODES}", NODES, NODES + 1)
            self.t = self.t[:NODES]
        self.partner, alone = pairs(self.t)
        for i in alone:
            self.fault("syntax_error", f"{self.t[i].text} without a partner", i, i + 1)
        self.n = len(self.t)
        self.t += [Token("end", "", len(text), len(text), True)] * 8  # a construct that is cut off looks past the end
        self.out: list[Observation] = []
        self.declared: set[int] = set()
        self.seen: dict[tuple, int] = {}
        self.full = False

    # -- records

    def fault(self, code: str, message: str, a: int, b: int) -> None:
        """A diagnostic of tokens a..b (end exclusive)."""
        self.faults.append((code, message, self.t[a].start, self.t[b - 1].end))

    def put(self, category: str, kind: str, spelling: str, a: int, b: int, sa: int, sb: int, scope: str | None, where: str, **more) -> Observation:
        """Adds an observation of tokens a..b, of which the construct spans tokens sa..sb (ends exclusive)."""
        t, n = self.t, len(self.text)
        at = lambda i: t[i].start if i < len(t) else n
        end = lambda i: t[i - 1].end if 0 < i <= len(t) else n
        o = Observation(category, kind, spelling, at(a), end(b), at(sa), end(sb), scope, **more)
        # the place in the tree, not in the file: an id survives lines that are put in above
        key = (category, kind, spelling, where)
        self.seen[key] = turn = self.seen.get(key, -1) + 1
        o.id = hashlib.sha256("\0".join((self.language, self.path, category, kind, spelling, where, str(turn), "")).encode()).hexdigest()
        if len(self.out) < OBSERVATIONS:
            self.out.append(o)
        elif not self.full:
            self.full = True
            self.faults.append(("observation_limit_reached", f"read up to observation {OBSERVATIONS}", o.start, o.end))
        return o

    def declare(self, kind: str, i: int, sa: int, sb: int, ctx: Context, **more) -> Observation:
        self.declared.add(i)
        body = next((j for j in range(i, min(sb, self.n)) if self.t[j].text == "{" and self.t[j].kind == "op"), sb)
        signature = self.text[self.t[sa].start : self.t[body - 1].end if body > sa else self.t[i].end].strip()
        more.setdefault("container", ctx.container)
        return self.put("symbol", kind, self.t[i].text, i, i + 1, sa, sb, ctx.scope, ctx.where, signature=signature, **more)

    def scope(self, kind: str, a: int, b: int, ctx: Context, name: str = "") -> Context:
        o = self.put("scope", kind, name or kind, a, a + 1, a, b, ctx.scope, ctx.where)
        where = f"{ctx.where}/{kind}:{name}"
        return Context(o.id, where if len(where) <= PLACE else hashlib.sha256(where.encode()).hexdigest(), ctx.container, ctx.body)

    # -- statements

    def read(self) -> list[Observation]:
        n = self.n
        o = Observation("scope", "file", "file", 0, len(self.text), 0, len(self.text))
        o.id = hashlib.sha256("\0".join((self.language, self.path, "scope", "file", "")).encode()).hexdigest()
        self.out.append(o)
        ctx = Context(o.id, "", None, "file")
        for p in self.pound:
            word = p.text.strip().lstrip("#").strip()
            if word.startswith(("if", "elif")):
                c = self.put("condition", "preprocessor", word, 0, 0, 0, 0, ctx.scope, "", limitations=["active_configuration_not_inferred"])
                c.start, c.end, c.syntax_start, c.syntax_end = p.start, p.end, p.start, p.end
        self.block(0, n, ctx)
        while self.todo:
            self._statements(*self.todo.popleft())
        return self.out

    def block(self, i: int, hi: int, ctx: Context) -> None:
        """Puts off the statements of tokens i..hi, so that nested blocks need no nested calls."""
        self.todo.append((i, hi, ctx))

    def _statements(self, i: int, hi: int, ctx: Context) -> None:
        start = True
        while i < hi:
            if time.monotonic() > self.until:
                self.todo.clear()
                self.fault("time_limit_reached", "the rest of the file is not read", i, i + 1)
                return
            t = self.t[i]
            if start or (t.first and self._new_line_starts(i)):
                after = self.statement(i, hi, ctx)
                if after is not None and after > i:
                    i, start = after, True
                    continue
            if t.kind == "op" and t.text == "{":
                end = min(self.partner.get(i, hi), hi)
                inner = self.scope("block", i, end + 1, ctx)
                inner.body = "function" if ctx.body in ("function", "file") else ctx.body
                self.block(i + 1, end, inner)
                i, start = end + 1, True
                continue
            start = t.kind == "op" and t.text in (";", "}") or (t.kind == "op" and t.text == "," and ctx.body in ("enum", "fields"))
            i = self.use(i, hi, ctx)

    def _new_line_starts(self, i: int) -> bool:
        before = self.t[i - 1] if i else None
        return self.family in ("go", "ecma") and (before is None or not (before.kind == "op" and before.text not in (")", "]", "}", ";")))

    def statement(self, i: int, hi: int, ctx: Context) -> int | None:
        return getattr(self, f"_{self.family}")(i, hi, ctx)

    # -- helpers

    def text_of(self, a: int, b: int) -> str:
        return self.text[self.t[a].start : self.t[b - 1].end] if a < b else ""

    def is_name(self, i: int, hi: int) -> bool:
        return i < hi and self.t[i].kind == "id" and self.t[i].text not in self.keywords

    def find(self, i: int, hi: int, *stops: str) -> int:
        """The first of these operators outside of brackets, or hi."""
        while i < hi:
            t = self.t[i]
            if t.kind == "op" and t.text in stops:
                return i
            i = self.partner.get(i, i) + 1 if t.kind == "op" and t.text in "([{" else i + 1
        return hi

    def generics(self, i: int, hi: int) -> int:
        """Past <...> at i, if it is there and closes."""
        if i >= hi or self.t[i].text != "<":
            return i
        depth = 0
        for j in range(i, min(hi, i + 200)):
            x = self.t[j].text
            depth += {"<": 1, "<<": 2, ">": -1, ">>": -2}.get(x, 0)
            if depth <= 0:
                return j + 1
            if x in (";", "{", "}"):
                return i
        return i

    def type_parameters(self, a: int, b: int, ctx: Context) -> None:
        for j in range(a + 1, b - 1):
            if self.is_name(j, b) and self.t[j - 1].text in ("<", ",") and self.t[j].text not in ("extends", "in", "out"):
                self.declare("type_parameter", j, j, j + 1, ctx)

    def end_of(self, i: int, hi: int) -> int:
        """Past the end of the statement that tokens i.. begin: after ';', or before the line that begins the next."""
        j = i
        while j < hi:
            t = self.t[j]
            if t.kind == "op" and t.text == ";":
                return j + 1
            if j > i and t.first and self._new_line_starts(j):
                return j
            j = min(self.partner.get(j, j), hi - 1) + 1 if t.kind == "op" and t.text in "([{" else j + 1
        return hi

    def uses(self, i: int, hi: int, ctx: Context) -> None:
        while i < hi:
            if self.t[i].kind == "op" and self.t[i].text == "{":
                end = min(self.partner.get(i, hi), hi)
                inner = self.scope("block", i, end + 1, ctx)
                inner.body = "function"
                self.block(i + 1, end, inner)
                i = end + 1
            else:
                i = self.use(i, hi, ctx)

    def use(self, i: int, hi: int, ctx: Context) -> int:
        """One token of an expression: a call, a reference, or nothing."""
        t = self.t[i]
        after = self.t[i + 1].text if i + 1 < hi else ""
        if self.family == "ecma" and t.text in ("require", "import") and after == "(" and (t.text == "import" or t.kind == "id"):
            return self._dynamic_import(i, hi, ctx)
        if self.family == "ecma" and t.text in ("function", "class") and t.kind == "id":
            got = self._ecma(i, hi, ctx, nested=True)
            if got:
                return got
        if self.family == "rust" and t.text == "|" and i and self.t[i - 1].text in ("(", ",", "=", "move", "{", ";", "=>"):
            end = self.find(i + 1, hi, "|")
            for j in range(i + 1, end):
                if self.is_name(j, end) and self.t[j - 1].text in ("|", ",", "(", "mut", "&"):
                    self.declare("parameter", j, j, j + 1, ctx)
            return end + 1 if end < hi else i + 1
        if t.kind != "id" or i in self.declared:
            return i + 1
        if t.text in self.keywords:
            if t.text in ("match", "if", "for", "while") and self.family == "rust":
                return i + 1
            return i + 1
        receiver, chain, crossed = None, i, False
        while chain >= 2 and self.t[chain - 1].text in (".", "?.", "::") and self.t[chain - 2].kind in ("id", "op", "str", "num"):
            before = self.t[chain - 2]
            if before.kind == "op":
                if before.text not in (")", "]"):
                    break
                opening = self.partner.get(chain - 2)
                if opening is None:
                    break
                chain, crossed = opening, True
                if chain and self.t[chain - 1].kind == "id":
                    chain -= 1
            else:
                chain -= 2
        if chain < i:
            receiver = self.text_of(chain, i - 1)
        elif i and self.t[i - 1].text in (".", "?."):
            receiver = ""
        after_generics = self.generics(i + 1, hi) if self.family != "go" else i + 1
        turbofish = i + 1
        if self.family == "rust" and after == "::" and i + 2 < hi and self.t[i + 2].text == "<":
            turbofish = self.generics(i + 2, hi)
        attributes, limits = [], []
        if receiver is not None:
            attributes.append("member_selector")
            if not (self.family == "rust" and self.t[i - 1].text == "::"):
                limits.append("receiver_type_not_inferred")
        spelling = t.text
        if self.family == "rust" and receiver is not None and self.t[i - 1].text == "::":
            spelling, receiver, attributes = f"{receiver}::{t.text}", None, []
        shown = receiver or None
        if self.family == "rust" and after == "!" and i + 2 < hi and self.t[i + 2].text in "([{" and self.t[i + 2].kind == "op":
            end = min(self.partner.get(i + 2, hi), hi)
            self.put("call_site", "macro", spelling, i, i + 1, i, end + 1, ctx.scope, ctx.where, attributes=["resolution:unresolved"], limitations=["macro_not_expanded"])
            return end + 1
        made = not crossed and chain > 0 and self.t[chain - 1].text == "new"
        call_at = next((j for j in (i + 1, after_generics, turbofish) if j < hi and self.t[j].text == "(" and self.t[j].kind == "op"), None)
        if call_at is not None and (call_at == i + 1 or self._is_generic_call(i + 1, call_at)):
            end = min(self.partner.get(call_at, hi), hi)
            kind = "constructor" if made else "method" if receiver is not None and self.family != "go" else "method" if self.family == "java" else "function"
            if self.family == "dart" and receiver is None and t.text[:1].isupper():
                kind = "constructor_like"
            if self.family == "go" and t.text[:1].isupper():
                attributes.append("constructor_like_syntax")
            self.put("call_site", kind, spelling, i, i + 1, chain, end + 1, ctx.scope, ctx.where, receiver=shown, attributes=attributes, limitations=limits)
            return i + 1
        if made:
            self.put("call_site", "constructor", spelling, i, i + 1, chain, i + 1, ctx.scope, ctx.where, receiver=shown, attributes=attributes, limitations=limits)
            return i + 1
        if self.family == "dart" and after == ":" and i and self.t[i - 1].text in ("(", ","):
            return i + 1  # the label of a named argument
        if t.text == "_" or (self.family == "ecma" and after == ":" and i and self.t[i - 1].text in ("{", ",")):
            return i + 1  # a key of an object
        if self.language in ("jsx", "tsx") and i and self.t[i - 1].text == "<" and t.text[:1].isupper():
            limits = [*limits, "jsx_tag_not_a_call_edge"]
        kind = "type" if i and self.t[i - 1].text in (":", "extends", "implements", "with", "on", "->") and self.family != "go" else "identifier"
        if kind == "type":
            attributes = [*attributes, "role:type"]
        self.put("reference", kind, spelling, i, i + 1, chain, i + 1, ctx.scope, ctx.where, receiver=shown, attributes=attributes, limitations=limits)
        return i + 1

    def _is_generic_call(self, a: int, b: int) -> bool:
        return self.t[a].text in ("<", "::") and all(x.kind == "id" or x.text in ("<", ">", ",", ".", "::", "?", "[", "]", ">>", "&") for x in self.t[a:b])

    # -- shared parts

    def parameters(self, i: int, hi: int, ctx: Context, kind: str = "parameter") -> None:
        """Parameters between the brackets i..hi."""
        j = i + 1
        typed = self.family == "go" and self._has_typed(j, hi)
        while j < hi:
            end = min(self.find(j, hi, ","), hi)
            name = j if typed and end == j + 1 and self.is_name(j, hi) else self._parameter_name(j, end)
            if name is not None:
                self.declare(kind, name, j, end, ctx)
            elif self.t[j].kind == "op" and self.t[j].text in "{[":  # a pattern, or Dart's named parameters
                self.parameters(j, min(self.partner.get(j, end), end), ctx, kind)
            for k in range(j, end):
                if k not in self.declared and not (self.t[j].text in "{[" and self.t[j].kind == "op"):
                    self.use(k, end, ctx)
            j = end + 1

    def _has_typed(self, j: int, hi: int) -> bool:
        """Whether a parameter has a name and a type: then those of one word are names that share the next type."""
        while j < hi:
            end = min(self.find(j, hi, ","), hi)
            if self._parameter_name(j, end) is not None:
                return True
            j = end + 1
        return False

    def _parameter_name(self, a: int, b: int) -> int | None:
        if self.family in ("rust", "ecma"):
            j = a
            while j < b and self.t[j].text in ("mut", "&", "ref", "...", "public", "private", "protected", "readonly"):
                j += 1
            ok = self.is_name(j, b) and (j + 1 >= b or self.t[j + 1].text in (":", "=", "?", ","))
            return j if ok and self.t[j].text != "self" else None
        if self.family == "go":
            return a if self.is_name(a, b) and (b - a > 1 and self.t[a + 1].text not in (".", ",")) else None
        equal = min(self.find(a, b, "="), self.find(a, b, ":") if self.family == "dart" else b)
        names = [j for j in range(a, equal) if self.t[j].kind == "id" and (j + 1 == equal or self.t[j + 1].text in (")",))]
        name = names[-1] if names else None
        if name is None or not self.is_name(name, b):
            return None
        if self.family != "dart" and name == a:
            return None
        return name

    def function(self, kind: str, name: int, sa: int, open_: int, hi: int, ctx: Context, **more) -> int:
        """A function with parameters at open_; its body is what follows in braces, or up to the end of the statement."""
        close = min(self.partner.get(open_, hi), hi)
        j = close + 1
        while j < hi and not (self.t[j].kind == "op" and self.t[j].text in ("{", ";", "=>", "=")) and not (j > close + 1 and self.t[j].first and self._new_line_starts(j)):
            j = min(self.partner.get(j, j), hi - 1) + 1 if self.t[j].kind == "op" and self.t[j].text in "([" else j + 1
        body_end = j
        if j < hi and self.t[j].text == "{":
            body_end = min(self.partner.get(j, hi), hi) + 1
        elif j < hi and self.t[j].text in ("=>", "="):
            body_end = self.end_of(j, hi)
        elif j < hi and self.t[j].text == ";":
            body_end = j + 1
        own = self.declare(kind, name, sa, body_end, ctx, **more)
        inner = self.scope("function", open_, body_end, ctx, self.t[name].text)
        inner.body, inner.container = "function", own.spelling
        generic = self.generics(name + 1, open_ + 1)
        if generic > name + 1:
            self.type_parameters(name + 1, generic, inner)
        self.parameters(open_, close, inner)
        self.uses(close + 1, min(j, hi), ctx)
        if j < hi and self.t[j].text == "{":
            self.block(j + 1, body_end - 1, inner)
        elif j < body_end:
            self.uses(j + 1, body_end, inner)
        return body_end

    def type_body(self, kind: str, name: int, sa: int, hi: int, ctx: Context, body: str = "type", **more) -> int:
        """A type with its members in the braces that follow, or none up to ';'."""
        open_ = name + 1
        while open_ < hi and not (self.t[open_].kind == "op" and self.t[open_].text in ("{", ";")) and not (open_ > name + 1 and self.t[open_].first and self._new_line_starts(open_)):
            open_ = min(self.partner.get(open_, open_), hi - 1) + 1 if self.t[open_].kind == "op" and self.t[open_].text in "([" else open_ + 1
        braces = open_ < hi and self.t[open_].text == "{"
        end = min(self.partner.get(open_, hi), hi) + 1 if braces else min(open_ + 1, hi) if open_ < hi and self.t[open_].text == ";" else open_
        own = self.declare(kind, name, sa, end, ctx, **more)
        inner = self.scope(_SCOPE_OF.get(kind, "type"), name, end, ctx, own.spelling)
        inner.container, inner.body = own.spelling, body
        generic = self.generics(name + 1, open_)
        if generic > name + 1:
            self.type_parameters(name + 1, generic, inner)
        if self.family in ("java", "csharp", "dart") and generic < open_ and self.t[generic].text == "(":
            self.parameters(generic, min(self.partner.get(generic, open_), open_), inner)
        self.uses(generic, min(open_, hi), ctx)
        if braces:
            self.block(open_ + 1, end - 1, inner)
        return end

    def entries(self, kind: str, i: int, hi: int, ctx: Context) -> None:
        """Names before commas: constants of an enum."""
        j = i
        while j < hi:
            while j < hi and self.t[j].text in ("@", "#") or (j < hi and self.t[j].kind == "op" and self.t[j].text == "["):
                j = self.partner.get(j, j) + 1
            end = self.find(j, hi, ",", ";")
            if self.is_name(j, hi):
                self.declare(kind, j, j, max(end, j + 1), ctx)
                self.uses(j + 1, end, ctx)
            if end < hi and self.t[end].text == ";":
                self.block(end + 1, hi, Context(ctx.scope, ctx.where, ctx.container, "type"))
                return
            j = end + 1

    # -- dialects

    def _rust(self, i: int, hi: int, ctx: Context) -> int | None:
        t = self.t
        if t[i].text == "#" and i + 1 < hi and (t[i + 1].text == "[" or t[i + 1].text == "!"):
            open_ = i + 1 if t[i + 1].text == "[" else i + 2
            end = min(self.partner.get(open_, open_), hi)
            body = self.text_of(open_ + 1, end)
            if body.startswith(("cfg", "cfg_attr")):
                self.put("condition", "cfg", body, open_ + 1, end, i, end + 1, ctx.scope, ctx.where, limitations=["active_configuration_not_inferred"])
            return end + 1
        sa, j = i, i
        while j < hi and t[j].text in ("pub", "unsafe", "async", "extern", "default", "const") and not (t[j].text == "const" and not (j + 1 < hi and t[j + 1].text in ("fn", "unsafe", "async", "extern"))):
            j += 1
            if j < hi and t[j].text == "(" and t[j - 1].text == "pub":
                j = self.partner.get(j, j) + 1
            if j < hi and t[j].kind == "str":
                j += 1
        if j >= hi:
            return None
        word = t[j].text
        if word == "use":
            end = self.find(j, hi, ";")
            attributes = ["exported"] if j > sa else []
            for names, alias, at in self._use_tree(j + 1, end, []):
                self.put("import", "use", "::".join(names), at, at + 1, sa, min(end + 1, hi), ctx.scope, ctx.where, alias=alias, attributes=attributes)
            return end + 1
        if word == "fn" and self.is_name(j + 1, hi):
            kind = {"impl": "method", "trait": "trait_method"}.get(ctx.body, "function")
            open_ = self.find(j + 2, hi, "(", "{", ";")
            return self.function(kind, j + 1, sa, open_, hi, ctx) if open_ < hi and t[open_].text == "(" else None
        if word == "impl":
            open_ = self.find(j + 1, hi, "{", ";")
            if open_ >= hi or t[open_].text != "{":
                return None
            end, header = min(self.partner.get(open_, hi), hi), self.text_of(j, open_)
            target = max((k for k in range(j + 1, open_) if t[k].text == "for"), default=j)
            name = next((k for k in range(max(target + 1, self.generics(j + 1, open_)), open_) if self.is_name(k, open_)), j)
            self.put("symbol", "impl", t[name].text, name, name + 1, sa, end + 1, ctx.scope, ctx.where, signature=header, container=ctx.container)
            self.uses(j + 1, open_, ctx)
            inner = self.scope("type", j, end + 1, ctx, header)
            inner.container, inner.body = header, "impl"
            self.block(open_ + 1, end, inner)
            return end + 1
        if word in _TYPES["rust"] and self.is_name(j + 1, hi):
            kind = _TYPES["rust"][word]
            if word == "type":
                end = self.find(j, hi, ";")
                self.declare("type_alias", j + 1, sa, min(end + 1, hi), ctx)
                self.uses(j + 2, end, ctx)
                return end + 1
            if word == "enum":
                open_ = self.find(j + 2, hi, "{")
                end = min(self.partner.get(open_, hi), hi)
                own = self.declare(kind, j + 1, sa, end + 1, ctx)
                inner = self.scope("type", j + 1, end + 1, ctx, own.spelling)
                inner.container, inner.body = own.spelling, "enum"
                self.entries("enum_variant", open_ + 1, end, inner)
                return end + 1
            return self.type_body(kind, j + 1, sa, hi, ctx, {"struct": "fields", "union": "fields", "trait": "trait", "mod": "file"}[word])
        if word == "macro_rules" and j + 2 < hi and t[j + 1].text == "!":
            end = min(self.partner.get(j + 3, hi), hi)
            self.declare("macro", j + 2, sa, end + 1, ctx)
            return end + 1
        if word in ("const", "static"):
            k = j + 2 if j + 1 < hi and t[j + 1].text == "mut" else j + 1
            if self.is_name(k, hi):
                end = self.find(k, hi, ";")
                self.declare(word, k, sa, min(end + 1, hi), ctx)
                self.uses(k + 1, end, ctx)
                return end + 1
        if word == "let":
            end = self.find(j, hi, "=", ";")
            colon = self.find(j + 1, end, ":")
            for k in range(j + 1, min(colon, end)):
                if self.is_name(k, end) and t[k].text[:1].islower() and (k + 1 >= hi or t[k + 1].text not in ("(", "::", "{")):
                    self.declare("local", k, sa, min(end, hi), ctx)
            self.uses(colon, end, ctx)
            return end
        if ctx.body == "fields" and self.is_name(j, hi) and j + 1 < hi and t[j + 1].text == ":":
            end = self.find(j, hi, ",")
            self.declare("field", j, sa, end, ctx)
            self.uses(j + 2, end, ctx)
            return end + 1
        return None

    def _use_tree(self, i: int, hi: int, prefix: list[str]) -> list[tuple[list[str], str | None, int]]:
        out, j = [], i
        while j < hi:
            end = self.find(j, hi, ",")
            names, k, alias, group = list(prefix), j, None, None
            while k < end:
                x = self.t[k]
                if x.text == "as" and k + 1 < end:
                    alias = self.t[k + 1].text
                    break
                if x.text == "{":
                    group = k
                    break
                if x.kind == "id" or x.text == "*":
                    names.append(x.text)
                k += 1
            if group is not None:
                out += self._use_tree(group + 1, min(self.partner.get(group, end), end), names)
            elif len(names) > len(prefix):
                if names[-1] == "self" and prefix:
                    names, alias = names[:-1], alias or "self"
                out.append((names, alias, j))
            j = end + 1
        return out

    def _go(self, i: int, hi: int, ctx: Context) -> int | None:
        t, word = self.t, self.t[i].text
        if word == "package" and self.is_name(i + 1, hi):
            self.put("import", "package", t[i + 1].text, i + 1, i + 2, i, i + 2, ctx.scope, ctx.where)
            return i + 2
        if word == "import":
            grouped = i + 1 < hi and t[i + 1].text == "("
            end = min(self.partner.get(i + 1, hi), hi) if grouped else self.end_of(i + 1, hi)
            for k in range(i + 1, end):
                if t[k].kind == "str":
                    path = t[k].text.strip("\"`")
                    named = k - 1 > i and t[k - 1].kind == "id" or t[k - 1].text == "."
                    alias = t[k - 1].text if named else path.rsplit("/", 1)[-1]
                    self.put("import", "import", path, k, k + 1, k - 1 if named else k, k + 1, ctx.scope, ctx.where, alias=alias, attributes=[] if named else ["derived_alias"])
            return end + 1 if grouped else end
        if word == "func":
            j, container = i + 1, None
            if j < hi and t[j].text == "(":
                close = min(self.partner.get(j, hi), hi)
                container = self.text_of(j + 1, close).split()[-1] if close > j + 1 else None
                if not self.is_name(close + 1, hi):
                    return None
                name = close + 1
                open_ = name + 1 if t[name + 1].text == "(" else self.find(name + 1, hi, "(")
                end = self.function("method", name, i, open_, hi, ctx, container=container)
                if self.is_name(j + 1, close) and close - j > 2:
                    self.declare("parameter", j + 1, j + 1, close, ctx)
                return end
            if self.is_name(j, hi):
                open_ = self.find(j + 1, hi, "(") if t[j + 1].text != "[" else self.find(self.partner.get(j + 1, j) + 1, hi, "(")
                return self.function("function", j, i, open_, hi, ctx)
            return None
        if word == "type":
            if i + 1 < hi and t[i + 1].text == "(":
                end, j = min(self.partner.get(i + 1, hi), hi), i + 2
                while j < end:
                    got = self._go_type(j, end, j, ctx) if self.is_name(j, end) else None
                    j = got or j + 1
                return end + 1
            return self._go_type(i + 1, hi, i, ctx)
        if word in ("const", "var"):
            kind = word if word == "const" else "variable"
            kind = "local" if ctx.body == "function" and word == "var" else kind
            grouped = i + 1 < hi and t[i + 1].text == "("
            end = min(self.partner.get(i + 1, hi), hi) if grouped else self.end_of(i + 1, hi)
            j = i + 2 if grouped else i + 1
            while j < end:
                stop = self.end_of(j, end)
                k = j
                while self.is_name(k, stop):
                    if t[k].text != "_":
                        self.declare(kind, k, i if not grouped else j, stop, ctx)
                    if k + 1 < stop and t[k + 1].text == ",":
                        k += 2
                    else:
                        break
                self.uses(k + 1, stop, ctx)
                j = max(stop, j + 1)
            return end + 1 if grouped else end
        if ctx.body == "fields" and t[i].kind == "id" and t[i].first or (ctx.body == "fields" and t[i].text == "*" and t[i].first):
            end = self.end_of(i, hi)
            if end == i + 1 or t[i].text == "*" or (i + 1 < hi and (t[i + 1].text == "." or t[i + 1].kind == "str")):
                name = max(k for k in range(i, end) if t[k].kind == "id") if any(t[k].kind == "id" for k in range(i, end)) else i
                self.declare("embedded_field", name, i, end, ctx)
            else:
                k = i
                while self.is_name(k, end):
                    self.declare("field", k, i, end, ctx)
                    if k + 1 < end and t[k + 1].text == ",":
                        k += 2
                    else:
                        break
                self.uses(k + 1, end, ctx)
            return end
        if ctx.body == "methods" and self.is_name(i, hi) and i + 1 < hi and t[i + 1].text == "(":
            end = self.end_of(i, hi)
            self.declare("interface_method", i, i, end, ctx)
            self.uses(i + 1, end, ctx)
            return end
        k = i
        names = []
        if word in ("for", "if", "switch"):
            k = i + 1
        while self.is_name(k, hi):
            names.append(k)
            if k + 1 < hi and t[k + 1].text == ",":
                k += 2
            else:
                break
        if names and k + 1 < hi and t[k + 1].text == ":=":
            for n in names:
                if t[n].text != "_":
                    self.declare("local", n, i, n + 1, ctx)
            return k + 2
        return None

    def _go_type(self, name: int, hi: int, sa: int, ctx: Context) -> int | None:
        if not self.is_name(name, hi):
            return None
        j = name + 1
        if j < hi and self.t[j].text == "[" and self.is_name(j + 1, hi):
            j = self.partner.get(j, j) + 1
        if j < hi and self.t[j].text == "=":
            end = self.end_of(name, hi)
            self.declare("type_alias", name, sa, end, ctx)
            self.uses(j + 1, end, ctx)
            return end
        if j + 1 < hi and self.t[j].text in ("struct", "interface") and self.t[j + 1].text == "{":
            end = min(self.partner.get(j + 1, hi), hi)
            own = self.declare("type", name, sa, end + 1, ctx)
            inner = self.scope("type", name, end + 1, ctx, own.spelling)
            inner.container, inner.body = own.spelling, "fields" if self.t[j].text == "struct" else "methods"
            self.block(j + 2, end, inner)
            return end + 1
        end = self.end_of(name, hi)
        self.declare("type", name, sa, end, ctx)
        self.uses(j, end, ctx)
        return end

    def _modifiers(self, i: int, hi: int) -> int:
        j = i
        while j < hi:
            if self.t[j].kind == "op" and self.t[j].text == "[" and self.family == "csharp":
                j = self.partner.get(j, j) + 1
            elif self.t[j].kind == "id" and self.t[j].text.startswith("@") and self.t[j].text != "@interface":
                j += 1
                while j + 1 < hi and self.t[j].text == ".":
                    j += 2
                if j < hi and self.t[j].text == "(":
                    j = self.partner.get(j, j) + 1
            elif self.t[j].text in MODIFIERS and self.t[j].kind == "id" and not (self.t[j].text in _TYPES.get(self.family, ()) and self.is_name(j + 1, hi)) and not (self.family == "dart" and self.t[j].text in ("const", "static") and ctx_is_expression(self.t, j)):
                j += 1
            else:
                return j
        return j

    def _dotted(self, i: int, hi: int) -> int:
        j = i
        while j < hi and (self.t[j].kind == "id" or self.t[j].text in (".", "*")):
            j += 1
        return j

    def _c_like(self, i: int, hi: int, ctx: Context) -> int | None:
        """Members and locals of Java, C# and Dart: a type, a name, and what follows it."""
        t = self.t
        j = self._modifiers(i, hi)
        for k in range(i, min(j, hi)):
            if t[k].kind == "id" and t[k].text.startswith("@"):
                self.put("reference", "annotation", t[k].text[1:], k, k + 1, k, k + 1, ctx.scope, ctx.where)
                self.declared.add(k)
        if j >= hi:
            return None
        types = _TYPES[self.family]
        word = t[j].text
        if word in types and (self.is_name(j + 1, hi) or (word == "record" and j + 1 < hi and t[j + 1].text in ("class", "struct")) or (self.family == "dart" and word in ("extension", "mixin"))):
            name, kind = j + 1, types[word]
            if word == "record" and t[name].text in ("class", "struct"):
                name += 1
            if self.family == "dart":
                if word == "mixin" and t[name].text == "class":
                    name, kind = name + 1, "class"
                if word == "extension" and t[name].text == "type":
                    name, kind = name + 1, "extension_type"
                if word == "typedef":
                    end = self.find(j, hi, ";")
                    equal = self.find(j, end, "=")
                    named = [k for k in range(j + 1, equal) if self.is_name(k, hi)]
                    if named:
                        self.declare("type_alias", named[0] if equal < end else named[-1], i, min(end + 1, hi), ctx)
                    self.uses(j + 1, end, ctx)
                    return end + 1
                if not self.is_name(name, hi):
                    return None
            if kind == "namespace":
                end = self._dotted(name, hi)
                spelling = self.text_of(name, end)
                whole = end < hi and t[end].text == ";"
                stop = hi if whole else min(self.partner.get(end, hi), hi)
                own = self.put("symbol", "namespace", spelling, name, end, i, stop if whole else stop + 1, ctx.scope, ctx.where, signature=self.text_of(i, end))
                self.declared |= set(range(name, end))
                inner = self.scope("namespace", name, stop if whole else stop + 1, ctx, own.spelling)
                inner.container = spelling
                self.block(end + 1, stop, inner)
                return stop if whole else stop + 1
            if kind == "enum":
                open_ = self.find(name, hi, "{")
                end = min(self.partner.get(open_, hi), hi)
                own = self.declare("enum", name, i, end + 1, ctx)
                inner = self.scope("type", name, end + 1, ctx, own.spelling)
                inner.container, inner.body = own.spelling, "type"
                self.uses(name + 1, open_, ctx)
                self.entries("enum_member" if self.family == "csharp" else "enum_constant", open_ + 1, end, inner)
                return end + 1
            attributes = ["nested_type"] if ctx.body == "type" else []
            if "partial" in {x.text for x in t[i:j]}:
                attributes.append(f"partial_group:{ctx.container or ''}.{t[name].text}")
            return self.type_body(kind, name, i, hi, ctx, attributes=attributes)
        return self._member(i, j, hi, ctx)

    def _member(self, sa: int, i: int, hi: int, ctx: Context) -> int | None:
        t = self.t
        inside = ctx.body == "type"
        if self.family == "dart" and t[i].text == "factory":
            name = i + 1
            open_ = self.find(name, hi, "(")
            last = open_ - 1
            redirect = t[min(self.partner.get(open_, hi), hi - 1) + 1 if self.partner.get(open_, hi) + 1 < hi else hi - 1].text == "="
            return self.function("redirecting_factory_constructor" if redirect else "factory_constructor", last, sa, open_, hi, ctx)
        if self.family == "dart" and t[i].text in ("get", "set") and self.is_name(i + 1, hi):
            return self._getter(i, sa, hi, ctx)
        # a type: names, dots, generics, arrays, or nothing before a constructor
        j = i
        if self.family == "java" and t[j].text == "<":
            j = self.generics(j, hi)
        first = j
        if not (t[j].kind == "id" and (self.is_name(j, hi) or t[j].text in _PRIMITIVES)):
            if self.family == "dart" and t[j].text in ("var", "final", "const") and self.is_name(j + 1, hi):
                return self._fields(j + 1, sa, hi, ctx, inside)
            if self.family in ("java", "csharp") and t[j].text == "var" and self.is_name(j + 1, hi):
                return self._fields(j + 1, sa, hi, ctx, inside)
            return None
        if inside and t[j].text == ctx.container and j + 1 < hi and (t[j + 1].text == "(" or (self.family == "dart" and t[j + 1].text == "." and j + 3 < hi and t[j + 3].text == "(")):
            name = j if t[j + 1].text == "(" else j + 2
            return self.function("constructor", name, sa, name + 1, hi, ctx)
        j += 1
        while j < hi:
            if t[j].text in (".", "?.") and j + 1 < hi and t[j + 1].kind == "id":
                j += 2
            elif t[j].text == "<":
                k = self.generics(j, hi)
                if k == j:
                    return None
                j = k
            elif t[j].text == "[" and (self.partner.get(j, j) == j + 1 or (self.family == "csharp" and self.partner.get(j, j) <= j + 3)):
                j = self.partner[j] + 1
            elif t[j].text in ("?", "...") and j + 1 < hi:
                j += 1
            else:
                break
        if self.family == "dart" and j == first + 1 and j < hi and t[j].text == "(" and ctx.body != "function" and self.is_name(first, hi):
            return self.function("method" if inside else "function", first, sa, j, hi, ctx)
        if self.family == "dart" and j < hi and t[j].text in ("get", "set") and self.is_name(j + 1, hi):
            self.uses(first, j, ctx)
            return self._getter(j, sa, hi, ctx)
        if self.family == "csharp" and j < hi and t[j].text == "operator" or (self.family == "dart" and j < hi and t[j].text == "operator"):
            open_ = self.find(j + 1, hi, "(")
            return self.function("method" if self.family == "csharp" else "operator", j, sa, open_, hi, ctx)
        if not self.is_name(j, hi):
            return None
        name, after = j, t[j + 1].text if j + 1 < hi else ""
        called = self.generics(j + 1, hi) if after == "<" else j + 1
        if called < hi and t[called].text == "(" and t[called].kind == "op":
            close = self.partner.get(called, hi)
            ahead = t[close + 1].text if close + 1 < hi else ""
            if inside or ctx.body == "file" or ahead in ("{", "=>"):
                kind = "method" if inside else "local_function" if self.family == "csharp" else "function" if self.family == "dart" else "method"
                if kind == "method" and self.family == "java" and ctx.kind_is_annotation:
                    kind = "annotation_element"
                self.uses(first, name, ctx)
                more = {"attributes": ["extension_receiver"]} if self.family == "csharp" and called + 1 < hi and t[called + 1].text == "this" else {}
                return self.function(kind, name, sa, called, hi, ctx, **more)
            return None
        if self.family == "csharp" and inside and after in ("{", "=>"):
            end = min(self.partner.get(j + 1, hi), hi) + 1 if after == "{" else self.end_of(j + 1, hi)
            own = self.declare("property", name, sa, end, ctx)
            self.uses(first, name, ctx)
            inner = self.scope("function", j + 1, end, ctx, own.spelling)
            inner.body = "function"
            self.uses(j + 2, end - 1, inner)
            if end < hi and t[end].text == "=":
                stop = self.end_of(end, hi)
                self.uses(end, stop, ctx)
                return stop
            return end
        if after in ("=", ";", ",") or (after == ":" and self.family == "java") or (after in ("in", ":") and i and t[sa - 1].text == "("):
            self.uses(first, name, ctx)
            return self._fields(name, sa, hi, ctx, inside)
        return None

    def _getter(self, i: int, sa: int, hi: int, ctx: Context) -> int:
        kind, name = "getter" if self.t[i].text == "get" else "setter", i + 1
        if name + 1 < hi and self.t[name + 1].text == "(":
            return self.function(kind, name, sa, name + 1, hi, ctx)
        open_ = self.find(name, hi, "{", "=>", ";")
        end = min(self.partner.get(open_, hi), hi) + 1 if open_ < hi and self.t[open_].text == "{" else self.end_of(open_, hi)
        self.declare(kind, name, sa, end, ctx)
        inner = self.scope("function", name, end, ctx, self.t[name].text)
        inner.body = "function"
        self.block(open_ + 1, end - 1, inner)
        return end

    def _fields(self, name: int, sa: int, hi: int, ctx: Context, inside: bool) -> int:
        """Names of one declaration, with their values, up to ';'."""
        kind = "field" if inside else "local" if ctx.body == "function" else "variable"
        end = self.find(name, hi, ";")
        j = name
        while self.is_name(j, end):
            stop = self.find(j, end, ",")
            self.declare(kind, j, sa, min(end + 1, hi), ctx)
            self.uses(j + 1, stop, ctx)
            j = stop + 1
        return min(end + 1, hi)

    def _java(self, i: int, hi: int, ctx: Context) -> int | None:
        t = self.t
        if t[i].text in ("package", "import") and ctx.body == "file":
            j = i + 2 if i + 1 < hi and t[i + 1].text == "static" else i + 1
            end = self._dotted(j, hi)
            spelling = self.text_of(j, end)
            attributes = (["static_import"] if j == i + 2 else []) + (["wildcard_import"] if spelling.endswith(".*") else [])
            self.put("import", t[i].text, spelling.removesuffix(".*"), j, end, i, min(end + 1, hi), ctx.scope, ctx.where, attributes=attributes)
            return end + 1
        return self._c_like(i, hi, ctx)

    def _csharp(self, i: int, hi: int, ctx: Context) -> int | None:
        t = self.t
        j = i + 1 if t[i].text == "global" else i
        if j < hi and t[j].text == "using" and j + 1 < hi and t[j + 1].text not in ("(", "var") and ctx.body == "file":
            attributes = ["global_using"] if j > i else []
            k, alias = j + 1, None
            if t[k].text == "static":
                attributes.append("static_import")
                k += 1
            if k + 1 < hi and t[k + 1].text == "=":
                alias, k = t[k].text, k + 2
            end = self.find(k, hi, ";")
            self.put("import", "using", self.text_of(k, end), k, end, i, min(end + 1, hi), ctx.scope, ctx.where, alias=alias, attributes=attributes)
            return end + 1
        return self._c_like(i, hi, ctx)

    def _dart(self, i: int, hi: int, ctx: Context) -> int | None:
        t, word = self.t, self.t[i].text
        if ctx.body == "file" and word in ("import", "export", "part", "library"):
            end = self.find(i, hi, ";")
            of = word == "part" and i + 1 < hi and t[i + 1].text == "of"
            at = next((k for k in range(i + 1, end) if t[k].kind == "str"), None)
            spelling = t[at].text.strip("'\"") if at is not None else self.text_of(i + (2 if of else 1), end)
            attributes, alias, k = [], None, i
            while k < end:
                if t[k].text == "as" and k + 1 < end:
                    alias = t[k + 1].text
                if t[k].text in ("show", "hide"):
                    names, m = [], k + 1
                    while self.is_name(m, end):
                        names.append(t[m].text)
                        m += 2
                    attributes.append(f"{t[k].text}:{','.join(names)}")
                if t[k].text == "if" and k + 1 < end:
                    close = self.partner.get(k + 1, end)
                    self.put("condition", "conditional_import", self.text_of(k + 2, close), k + 2, close, k, close + 1, ctx.scope, ctx.where, limitations=["active_configuration_not_inferred"])
                k += 1
            place = at if at is not None else i + 1
            self.put("import", "part_of" if of else word, spelling, place, place + 1, i, min(end + 1, hi), ctx.scope, ctx.where, alias=alias, attributes=attributes)
            return end + 1
        return self._c_like(i, hi, ctx)

    def _ecma(self, i: int, hi: int, ctx: Context, nested: bool = False) -> int | None:
        t = self.t
        sa, j, exported = i, i, False
        while j < hi and t[j].kind == "id" and t[j].text.startswith("@"):
            self.put("reference", "decorator", t[j].text[1:], j, j + 1, j, j + 1, ctx.scope, ctx.where)
            self.declared.add(j)
            j += 1
            if j < hi and t[j].text == "(":
                close = self.partner.get(j, j)
                self.uses(j + 1, close, ctx)
                j = close + 1
        if j >= hi:
            return None
        if t[j].text == "export" and ctx.body in ("file",):
            got = self._export(j, hi, ctx)
            if got is not None:
                return got
            exported, j = True, j + 1
            if j < hi and t[j].text == "default":
                j += 1
        attributes = ["exported"] if exported else []
        while j < hi and t[j].text in ("declare", "abstract", "async", "const") and j + 1 < hi and t[j + 1].text in ("class", "function", "enum", "namespace", "module", "interface", "abstract", "type"):
            j += 1
        if j >= hi:
            return None
        word = t[j].text
        if word == "import" and j + 1 < hi and t[j + 1].text not in ("(", "."):
            return self._import(j, hi, ctx)
        if word == "function":
            k = j + 2 if j + 1 < hi and t[j + 1].text == "*" else j + 1
            if self.is_name(k, hi):
                open_ = self.find(k + 1, hi, "(") if t[k + 1].text != "<" else self.generics(k + 1, hi)
                close = self.partner.get(open_, hi)
                overload = self.typed and self.find(close + 1, hi, "{", ";") < hi and t[self.find(close + 1, hi, "{", ";")].text == ";"
                return self.function("function_overload" if overload else "function", k, sa, open_, hi, ctx, attributes=attributes)
            open_ = self.find(k, hi, "(")
            return self._anonymous(open_, hi, ctx) if open_ < hi else None
        if word == "class" or (self.typed and word in ("interface", "enum", "namespace", "module", "type") and self.is_name(j + 1, hi)):
            if not self.is_name(j + 1, hi):
                return None
            kind = _TYPES["ecma"][word]
            if kind == "type_alias":
                end = self.end_of(j, hi)
                self.declare(kind, j + 1, sa, end, ctx, attributes=[*attributes, "role:type"])
                self.uses(j + 2, end, ctx)
                return end
            if kind == "enum":
                open_ = self.find(j, hi, "{")
                end = min(self.partner.get(open_, hi), hi) + 1
                self.declare(kind, j + 1, sa, end, ctx, attributes=attributes)
                return end
            role = {"interface": ["role:type"], "namespace": ["role:namespace"]}.get(kind, [])
            return self.type_body(kind, j + 1, sa, hi, ctx, {"namespace": "file", "interface": "interface"}.get(kind, "type"), attributes=[*attributes, *role])
        if word in ("const", "let", "var"):
            end = self.end_of(j, hi)
            k = j + 1
            while k < end:
                stop = self.find(k, end, ",")
                if self.is_name(k, end):
                    equal = self.find(k, stop, "=")
                    bound = equal + 1 < stop and self._binds_function(equal + 1, stop)
                    kind = "function_binding" if bound else "variable"
                    self.declare(kind, k, sa, end, ctx, attributes=attributes)
                    self.uses(k + 1, equal, ctx)
                    self._value(equal + 1, stop, ctx)
                elif t[k].kind == "op" and t[k].text in "{[":
                    close = min(self.partner.get(k, stop), stop)
                    for m in range(k + 1, close):
                        if self.is_name(m, close) and (m + 1 == close or t[m + 1].text in (",", "=", "}", "]")):
                            self.declare("variable", m, sa, end, ctx, attributes=attributes)
                    self._value(close + 1, stop, ctx)
                k = stop + 1
            return end
        if ctx.body in ("type", "interface") and not nested:
            return self._ecma_member(sa, j, hi, ctx)
        if word in ("module", "exports") and j + 2 < hi and t[j + 1].text == ".":
            end = self.find(j, hi, "=", ";")
            if end < hi and t[end].text == "=" and self.text_of(j, end).startswith(("module.exports", "exports.")) and all(x.kind == "id" or x.text == "." for x in t[j:end]):
                name = t[end - 1].text
                self.put("import", "commonjs_export", name, end - 1, end, j, self.end_of(end, hi), ctx.scope, ctx.where)
                self.declared |= set(range(j, end))
                return end + 1
        return None

    def _value(self, i: int, hi: int, ctx: Context) -> None:
        """The value of a binding; functions in it open scopes of their own."""
        while i < hi:
            if self.t[i].kind == "op" and self.t[i].text == "(" and self._arrow(i, hi):
                i = self._anonymous(i, hi, ctx)
            elif self.is_name(i, hi) and i + 1 < hi and self.t[i + 1].text == "=>":
                inner = self.scope("function", i, hi, ctx)
                inner.body = "function"
                self.declare("parameter", i, i, i + 1, inner)
                self.uses(i + 2, hi, inner)
                return
            elif self.t[i].kind == "op" and self.t[i].text == "{":
                end = min(self.partner.get(i, hi), hi)
                self._value(i + 1, end, ctx)
                i = end + 1
            else:
                i = self.use(i, hi, ctx)

    def _arrow(self, i: int, hi: int) -> bool:
        close = self.partner.get(i, hi)
        j = close + 1
        if j < hi and self.t[j].text == ":":
            j = self.find(j, hi, "=>", ",", ";")
        return j < hi and self.t[j].text == "=>"

    def _binds_function(self, i: int, hi: int) -> bool:
        if self.t[i].text == "async" and i + 1 < hi:
            i += 1
        i = self.generics(i, hi)
        return i < hi and (self.t[i].text == "function" or (self.t[i].text == "(" and self._arrow(i, hi)) or (self.is_name(i, hi) and i + 1 < hi and self.t[i + 1].text == "=>"))

    def _anonymous(self, open_: int, hi: int, ctx: Context) -> int:
        close = min(self.partner.get(open_, hi), hi)
        inner = self.scope("function", open_, hi, ctx)
        inner.body = "function"
        self.parameters(open_, close, inner)
        body = self.find(close + 1, hi, "{", "=>")
        if body < hi and self.t[body].text == "=>":
            body += 1
        if body < hi and self.t[body].text == "{":
            end = min(self.partner.get(body, hi), hi)
            self.block(body + 1, end, inner)
            return end + 1
        end = self.find(body, hi, ",", ";")
        self.uses(body, end, inner)
        return end

    def _ecma_member(self, sa: int, i: int, hi: int, ctx: Context) -> int | None:
        t, j = self.t, i
        while j < hi and t[j].text in ("public", "private", "protected", "static", "readonly", "async", "get", "set", "abstract", "override", "declare", "*", "#") and j + 1 < hi and t[j + 1].text not in ("(", "=", ";", ":"):
            j += 1
        if j >= hi or t[j].kind != "id":
            return None
        called = self.generics(j + 1, hi)
        if called < hi and t[called].text == "(":
            kind = "constructor" if t[j].text == "constructor" else "method_signature" if ctx.body == "interface" else "method"
            return self.function(kind, j, sa, called, hi, ctx)
        end = self.end_of(j, hi)
        self.declare("variable" if ctx.body == "type" else "field", j, sa, end, ctx)
        self._value(j + 1, end, ctx)
        return end

    def _import(self, i: int, hi: int, ctx: Context) -> int:
        t = self.t
        end = self.end_of(i, hi)
        at = next((k for k in range(i + 1, end) if t[k].kind == "str"), None)
        if at is None:
            return end
        end = min(at + 2, hi) if at + 1 < hi and t[at + 1].text == ";" else at + 1
        spec, type_only = t[at].text.strip("'\"`"), t[i + 1].text == "type" and t[i + 2].text != "from"
        role = ["role:type"] if type_only else []
        rows: list[tuple[str, str | None]] = []
        k = i + (2 if type_only else 1)
        if k == at:
            rows.append(("<side-effect>", None))
        while k < at:
            if t[k].text == "*" and k + 2 < at:
                rows.append(("*", t[k + 2].text))
                k += 3
            elif t[k].text == "{":
                close = self.partner.get(k, at)
                m = k + 1
                while m < close:
                    stop = self.find(m, close, ",")
                    names = [x.text for x in t[m:stop] if x.kind == "id" and x.text not in ("as",)]
                    if names and names[0] == "type" and len(names) > 1:
                        names = names[1:]
                    if names:
                        rows.append((names[0], names[-1]))
                    m = stop + 1
                k = close + 1
            elif t[k].kind == "id" and t[k].text != "from":
                rows.append(("default", t[k].text))
                k += 1
            else:
                k += 1
        for imported, local in rows:
            self.put("import", "esm_import", spec, at, at + 1, i, end, ctx.scope, ctx.where, alias=local, attributes=[f"imported:{imported}", *role])
        self.declared |= set(range(i, end))
        return end

    def _export(self, i: int, hi: int, ctx: Context) -> int | None:
        t = self.t
        k = i + 2 if i + 2 < hi and t[i + 1].text == "type" and t[i + 2].text in ("{", "*") else i + 1
        if k >= hi or t[k].text not in ("{", "*"):
            return None
        end = self.end_of(i, hi)
        source = next((m for m in range(k, end) if t[m].kind == "str" and t[m - 1].text == "from"), None)
        rows: list[tuple[str, str | None]] = []
        if t[k].text == "*":
            rows.append(("*", t[k + 2].text if k + 2 < end and t[k + 1].text == "as" else None))
        else:
            close, m = self.partner.get(k, end), k + 1
            while m < close:
                stop = self.find(m, close, ",")
                names = [x.text for x in t[m:stop] if x.kind == "id" and x.text != "as"]
                if names:
                    rows.append((names[0], names[-1]))
                m = stop + 1
        for name, alias in rows:
            if source is not None:
                shown = [] if name == "*" else [f"local:{name}"]
                self.put("import", "reexport", t[source].text.strip("'\"`"), source, source + 1, i, end, ctx.scope, ctx.where, alias=alias, attributes=[f"imported:{name}", *shown])
            else:
                self.put("import", "export", name, k, k + 1, i, end, ctx.scope, ctx.where, alias=alias, attributes=[f"local:{name}"])
        self.declared |= set(range(i, end))
        return end

    def _dynamic_import(self, i: int, hi: int, ctx: Context) -> int:
        t = self.t
        close = min(self.partner.get(i + 1, hi), hi)
        literal = close == i + 3 and t[i + 2].kind == "str" and not t[i + 2].text.startswith("`")
        kind = "commonjs_require" if t[i].text == "require" else "dynamic_import"
        spelling = t[i + 2].text.strip("'\"") if literal else "<missing>" if close == i + 2 else self.text_of(i + 2, close)
        attributes = [] if literal else ["dynamic_specifier"]
        alias = t[i - 2].text if kind == "commonjs_require" and i >= 2 and t[i - 1].text == "=" and t[i - 2].kind == "id" else None
        self.put("import", kind, spelling, i + 2, max(close, i + 3), i, close + 1, ctx.scope, ctx.where, alias=alias, attributes=[*attributes, "imported:*"], limitations=[] if literal else ["dynamic_module_specifier_not_resolved"])
        self.put("call_site", "require" if kind == "commonjs_require" else "dynamic_import", t[i].text, i, i + 1, i, close + 1, ctx.scope, ctx.where, attributes=attributes, limitations=[] if literal else ["dynamic_module_specifier_not_resolved"])
        self.uses(i + 2, close, ctx)
        return close + 1


_PRIMITIVES = frozenset("void int long short byte char boolean bool float double decimal string object uint ulong ushort sbyte num dynamic Function var".split())


def ctx_is_expression(t: list[Token], j: int) -> bool:
    return j > 0 and t[j - 1].text in ("(", ",", "=", "return", "=>")


@dataclass
class Context:
    """Where a statement stands: its scope, its place in the tree, what contains it, and what kind of body that is."""

    scope: str
    where: str
    container: str | None
    body: str
    kind_is_annotation: bool = False


#: Order of the buckets in which a file's observations come.
CATEGORIES = ("symbol", "scope", "import", "reference", "call_site", "condition")


def extract(text: str, language: str, path: str, seconds: float = SECONDS) -> tuple[list[dict], str, list[tuple[str, str, int | None, int | None]]]:
    """(rows, parse status, diagnostics) of one source: rows by category, place, kind and spelling, each id once.

    Uses inside of an import or a condition, or at the name of a declaration, are none. Diagnostics are (code, message, first
    byte, byte past the last), in order: brackets without a partner, and limits of nodes, observations and time that cut
    the parse off; any makes it partial. A construct that is nested too deep to be read fails the file.
    """
    if len(text.encode()) > SOURCE_BYTES:
        return [], "failed", [("source_too_large", path, None, None)]
    reader = Reader(text, language, path, seconds)
    try:
        found = reader.read()
    except RecursionError:
        return [], "failed", [("nested_too_deep", path, None, None)]
    byte = Offsets(text)
    names = {(o.start, o.end) for o in found if o.category == "symbol"}
    closed = sorted((o.syntax_start, o.syntax_end) for o in found if o.category in ("import", "condition") and o.kind not in ("commonjs_require", "dynamic_import", "commonjs_export"))
    starts, reach = [a for a, _ in closed], []  # the furthest end of the closed ranges that begin before
    for _, b in closed:
        reach.append(max(b, reach[-1]) if reach else b)
    in_closed = lambda o: (k := bisect_right(starts, o.start)) > 0 and reach[k - 1] >= o.end
    rows, ids = [], set()
    for o in sorted(found, key=lambda o: (CATEGORIES.index(o.category), o.start, o.end, o.kind, o.spelling)):
        if o.id in ids or (o.category == "reference" and ((o.start, o.end) in names or in_closed(o))):
            continue
        ids.add(o.id)
        rows.append({
            "category": o.category, "observation_id": o.id, "kind": o.kind, "spelling": o.spelling, "start_byte": byte(o.start), "end_byte": byte(o.end),
            "syntax_start_byte": byte(o.syntax_start), "syntax_end_byte": byte(o.syntax_end), "scope_id": o.scope, "container": o.container, "signature": o.signature,
            "receiver": o.receiver, "alias": o.alias, "attributes": o.attributes, "limitations": o.limitations,
        })
    faults = sorted(((code, message, byte(a), byte(b)) for code, message, a, b in reader.faults), key=lambda f: (f[2], f[3], f[0]))
    return rows, "partial" if faults else "complete", faults[:DIAGNOSTICS]


def fingerprint() -> str:
    """A hash of what decides how a text is read: the dialects' words and the bounds."""
    parts = [sorted(KEYWORDS.items(), key=lambda kv: kv[0]), sorted(_TYPES.items()), sorted(MODIFIERS), SOURCE_BYTES, OBSERVATIONS, NODES]
    return hashlib.sha256(repr([(k, sorted(v)) if isinstance(v, frozenset) else (k, v) for k, v in parts[0]] + parts[1:]).encode()).hexdigest()[:16]
