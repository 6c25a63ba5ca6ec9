"""Declarations of source files, from tokens whose brackets are matched.

Every language has a rule that looks at one token and says which declaration it begins: kind,
name, first token, body and last token. One pass over the tokens asks it everywhere; open
declarations with a name are the owners of what is found inside. A rule that can't make out a
declaration whole (no name, an unmatched bracket) says nothing, and the pass goes on with the
next token, so that an error costs the declaration it is in and no other.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from hayrick.sources.lexer import Tokens, tokens


@dataclass
class Found:
    kind: str | None  # None: nothing to report, but a body to know about
    name: str | None
    first: int
    last: int
    body: int | None = None  # the token that begins it
    inside: str = ""  # what kind of body it is


class Reader:
    """Tokens with the steps that rules share. `bodies`: open braces and what they are the body of."""

    def __init__(self, text: str, lang: str):
        self.t: Tokens = tokens(text, lang)
        self.lang, self.bodies = lang, {}
        self.v, self.word, self.pair = self.t.value, self.t.is_word, self.t.pair

    def within(self, i: int) -> str | None:
        """What body a token is directly in; "" for the file itself."""
        outer = self.t.outer[i]
        return "" if outer < 0 else self.bodies.get(outer)

    def angle(self, i: int) -> int:
        """The token after a list in angle brackets, or i if there is none."""
        if self.v(i) != "<":
            return i
        depth = 0
        while i < len(self.t.kinds) and self.v(i) not in (";", "}"):
            depth += (self.v(i) == "<") - (self.v(i) == ">" and self.v(i - 1) not in ("-", "="))
            if self.v(i) in ("(", "[", "{"):
                i = self.pair.get(i, len(self.t.kinds))
            i += 1
            if not depth:
                break
        return i

    def until(self, i: int, stops: tuple[str, ...]) -> int | None:
        """The next of the stops at the same depth of brackets."""
        while i < len(self.t.kinds):
            if self.v(i) in stops and self.t.kinds[i] != "str":
                return i
            if self.v(i) in ("(", "[", "{"):
                if i not in self.pair:
                    return None
                i = self.pair[i]
            elif self.v(i) in (")", "]", "}"):
                return None
            i += 1
        return None

    def back(self, i: int, words: frozenset[str]) -> int:
        """The first of the modifiers, annotations and attributes before a token."""
        while i > 0:
            p = i - 1
            if self.v(p) in words:
                i = p
            elif self.v(p) == ")" and self.v(self.pair.get(p, 0) - 1) in words:  # pub(crate)
                i = self.pair[p] - 1
            elif self.lang in ("java", "php", "csharp"):
                if self.v(p) == ")" and p in self.pair:
                    p = self.pair[p] - 1
                q = p
                while self.word(q) and self.v(q - 1) == ".":
                    q -= 2
                if self.lang == "java" and self.word(q) and self.v(q - 1) == "@":
                    i = q - 1
                elif self.v(i - 1) == "]" and i - 1 in self.pair and (self.lang == "csharp" and self.v(self.pair[i - 1] - 1) in (";", "{", "}", "]", "") or self.v(self.pair[i - 1] - 1) == "#"):
                    i = self.pair[i - 1] - (self.lang == "php")
                else:
                    return i
            else:
                return i
        return i

    def block(self, kind: str | None, name: str | None, first: int, at: int | None, inside: str) -> Found | None:
        """A declaration whose body is the braces at `at`."""
        if at is None or self.v(at) != "{" or at not in self.pair:
            return None
        return Found(kind, name, first, self.pair[at], at, inside)


# ---------------------------------------------------------------- scripts

_SCRIPT_MODIFIERS = frozenset("public private protected static async get set readonly override accessor abstract declare".split())
_CONTROL = frozenset("if for while switch catch with function return await do else new typeof throw case import super".split())
_GOES_ON = frozenset("= + - * / % & | ^ ! ~ ? : , . ( [ < > =>".split())


def _statement(r: Reader, i: int) -> bool:
    """Whether a token begins a statement."""
    p = r.v(i - 1)
    return i == 0 or p in (";", "{", "}", "export", "default", "declare", "else", "do", ")") or r.t.after_break(i) and p not in _GOES_ON


def _typed(r: Reader, i: int) -> int:
    """The token after a return type, or i if there is none."""
    if r.v(i) != ":":
        return i
    i += 1
    while i < len(r.t.kinds):
        v = r.v(i)
        if v == "{" and r.v(i - 1) not in (":", "|", "&", "is") and (r.v(i - 2), r.v(i - 1)) != ("=", ">") or v in (";", ",", ")", "}") or v == "=" and r.v(i + 1) != ">":
            return i
        if v == ">" and r.v(i - 1) == "=":  # a function's type goes on with its own result
            i += 1
            continue
        i = r.angle(i) if v == "<" else r.pair.get(i, i) + 1
    return i


def script(r: Reader, i: int) -> Found | None:
    v, nxt = r.v(i), r.v(i + 1)
    if r.t.kinds[i] == "word" and r.v(i - 1) != ".":
        if v == "class" and nxt not in (":", "(", "=", ",", ")", "."):
            name = nxt if r.word(i + 1) and nxt not in ("extends", "implements") else None
            at = i + 1
            while at < len(r.t.kinds) and r.v(at) not in ("{", ";"):
                at = r.angle(at) if r.v(at) == "<" else r.pair.get(at, at) + 1 if r.v(at) in ("(", "[") else at + 1
            return r.block(None if r.v(i - 1) == "abstract" else "class", name, i, at, "class")
        if v == "function" and r.word(i + 1):
            first = i - 1 if r.v(i - 1) == "async" else i
            params = r.angle(i + 2)
            if _statement(r, first) and r.v(params) == "(" and params in r.pair:
                return r.block("function", nxt, first, _typed(r, r.pair[params] + 1), "function")
        if v in ("interface", "enum", "module") and (r.word(i + 1) or v == "module" and r.t.kinds[i + 1 : i + 2] == ["str"]):
            first = i - 1 if v == "enum" and r.v(i - 1) == "const" else i
            if _statement(r, first):
                return r.block(v, nxt, first, r.until(i + 2, ("{", ";", "=")), v)
        if v == "type" and r.word(i + 1) and _statement(r, i) and r.v(eq := r.angle(i + 2)) == "=":
            last = eq
            while last + 1 < len(r.t.kinds):
                n = last + 1
                if r.v(n) in (";", ")", "}", "]"):
                    last = n if r.v(n) == ";" else last
                    break
                if n > eq + 1 and r.t.after_break(n) and r.v(n) not in ("|", "&", "=", ".", "?", ":", ")", "extends") and r.v(last) not in ("|", "&", "=", "=>", "?", ":", ",", "extends", "keyof"):
                    break
                last = r.pair.get(n, n) if r.v(n) in ("(", "[", "{") else n
            return Found("type_alias", nxt, i, last)
    # A method, of a class or an object.
    named = r.t.kinds[i] in ("word", "str", "num") or v == "[" and i in r.pair
    if not named or v in _CONTROL or r.v(i - 1) == "." or r.v(r.t.outer[i]) != "{" or r.within(i) == "enum":
        return None
    end = r.pair[i] if v == "[" else i
    params = r.angle(end + 1 + (r.v(end + 1) == "?"))
    if r.v(params) != "(" or params not in r.pair:
        return None
    first = i - 1 if r.v(i - 1) == "*" else i
    while r.v(first - 1) in _SCRIPT_MODIFIERS and r.v(first) not in ("(", ":"):
        first -= 1
    if r.v(first - 1) in ("{", ",", ";", "}", ")") or r.t.after_break(first) and r.v(first - 1) not in _GOES_ON - {">"}:
        return r.block("method", r.t.slice(i, end), first, _typed(r, r.pair[params] + 1), "function")
    return None


# ---------------------------------------------------------------- Go and Rust


def go(r: Reader, i: int) -> Found | None:
    v = r.v(i)
    if v == "func" and r.t.outer[i] < 0 and r.t.after_break(i):
        at, kind = i + 1, "function"
        if r.v(at) == "(" and at in r.pair:
            at, kind = r.pair[at] + 1, "method"
        params = at + 1
        if r.v(params) == "[" and params in r.pair:
            params = r.pair[params] + 1
        if not r.word(at) or r.v(params) != "(" or params not in r.pair:
            return None
        last = r.pair[params]
        while last + 1 < len(r.t.kinds) and not r.t.after_break(last + 1):
            n = last + 1
            if r.v(n) == "{" and r.v(last) not in ("struct", "interface"):
                return r.block(kind, r.v(at), i, n, "function")
            last = r.pair.get(n, n)
        return Found(kind, r.v(at), i, last)
    # A type of its own, or one of a group.
    outer = r.t.outer[i]
    single = r.v(i - 1) == "type" and (r.t.after_break(i - 1) or r.v(i - 2) in (";", "{"))
    grouped = outer >= 0 and r.v(outer) == "(" and r.v(outer - 1) == "type" and (r.t.after_break(i) or r.v(i - 1) in (";", "("))
    if not r.word(i) or not (single or grouped):
        return None
    of = i + 1
    if r.v(of) == "[" and of in r.pair and r.word(of + 1) and r.pair[of] > of + 2:  # parameters, not an array
        of = r.pair[of] + 1
    of += r.v(of) == "="
    if r.v(of) in ("struct", "interface") and r.v(of + 1) == "{" and of + 1 in r.pair:
        return Found(r.v(of), r.v(i), i, r.pair[of + 1])
    last = of
    while last < len(r.t.kinds):
        last = r.pair.get(last, last) if r.v(last) in ("(", "[", "{") else last
        if last + 1 >= len(r.t.kinds) or r.t.after_break(last + 1) or r.v(last + 1) in (")", ";", "}"):
            break
        last += 1
    return Found("type_alias", r.v(i), i, last) if of < len(r.t.kinds) else None


_RUST_MODIFIERS = frozenset("pub const async unsafe extern default".split())


def rust(r: Reader, i: int) -> Found | None:
    v, name = r.v(i), r.v(i + 1)
    if r.v(i + 1) == "!" and r.word(i):  # a macro's arguments are no declarations
        at = i + 2 + r.word(i + 2)
        return Found(None, None, i, r.pair[at], at, "macro") if r.v(at) in ("(", "[", "{") and at in r.pair else None
    if v not in ("fn", "struct", "enum", "trait", "impl"):
        return None
    first = i
    while first and (r.v(first - 1) in _RUST_MODIFIERS or r.t.kinds[first - 1] == "str" and r.v(first - 2) == "extern" or r.v(first - 1) == ")" and r.v(r.pair.get(first - 1, 0) - 1) == "pub"):
        first = r.pair[first - 1] - 1 if r.v(first - 1) == ")" else first - 1
    if r.v(first - 1) not in ("", ";", "{", "}", "]"):
        return None
    if v == "impl":
        at, names = r.angle(i + 1), []
        body = r.until(at, ("{", ";"))
        if body is None:
            return None
        for part in _split(r, at, body, "for"):
            k = part[0] + (r.v(part[0]) == "!")
            if k < body and r.word(k) and r.v(k + 1) not in ("<", ":"):
                names.append(r.v(k))
        return r.block("impl" if names else None, names[0] if names else None, first, body, "impl")
    if not r.word(i + 1):
        return None
    at = r.angle(i + 2)
    if v == "fn":
        return r.block("function", name, first, r.until(r.pair[at] + 1, ("{", ";")), "function") if r.v(at) == "(" and at in r.pair else None
    if v == "struct":
        end = r.until(at, (";", "{"))
        if end is None:
            return None
        if r.v(end) == "{":
            return r.block("struct", name, first, end, "struct")
        return Found("struct", name, first, end, at if r.v(at) == "(" else None)
    return r.block(v, name, first, r.until(at, ("{", ";")), v)


def _split(r: Reader, lo: int, hi: int, word: str) -> list[tuple[int, int]]:
    """Ranges of tokens between a word at the same depth, up to a where clause."""
    out, begin, i = [], lo, lo
    while i < hi and r.v(i) != "where":
        if r.v(i) == word and r.v(i + 1) != "<":
            out.append((begin, i))
            begin = i + 1
        i = r.angle(i) if r.v(i) == "<" else r.pair.get(i, i) + 1
    return [*out, (begin, i)]


# ---------------------------------------------------------------- Java, C#, PHP

_MODIFIERS = {
    "java": frozenset("public private protected static final abstract native synchronized transient volatile strictfp default sealed non".split()),
    "csharp": frozenset("public private protected internal static sealed abstract virtual override async partial readonly unsafe extern new ref file required".split()),
    "php": frozenset("public private protected static final abstract readonly var".split()),
}
_TYPES = {"java": ("class", "interface", "enum"), "csharp": ("class", "interface", "enum", "struct"), "php": ("class", "interface", "enum", "trait")}


def classes(r: Reader, i: int) -> Found | None:
    v, lang = r.v(i), r.lang
    if v in _TYPES[lang] and r.t.kinds[i] == "word" and r.v(i - 1) not in (".", ":", "@", "new", "where", ",", ">") and r.word(i + 1):
        body = r.until(i + 2, ("{", ";"))
        kind = None if v == "trait" else v
        return r.block(kind, r.v(i + 1), r.back(i, _MODIFIERS[lang]), body, "type")
    if v == "class" and lang == "php" and r.v(i - 1) == "new":
        body = r.until(i + 1, ("{", ";"))
        return r.block(None, None, i, body, "type")
    if v == "{" and i not in r.bodies and i in r.pair:  # bodies without a name of their own
        close = r.v(i - 1) == ")" and r.pair.get(i - 1)
        before = (close or i) - 1
        while r.word(before) and r.v(before - 1) == "." or r.v(before) == ">":
            before -= 2 if r.v(before) != ">" else 1
            while r.v(before + 1) == ">" and before > 0 and r.v(before + 1 - 1) != "<":
                before -= 1
        constant = r.word(before) and r.v(before - 1) in ("{", ",") and r.within(i) == "type" and lang == "java"
        if close and r.v(before - 1) == "new" and lang == "java" or constant or r.v(i - 1) == "record":
            return Found(None, None, i, r.pair[i], i, "type")
    if lang == "php":
        if v == "function":
            at = i + 1 + (r.v(i + 1) == "&")
            if not r.word(at) or r.v(at + 1) != "(" or at + 1 not in r.pair:
                return None
            end = r.until(r.pair[at + 1] + 1, ("{", ";"))
            if r.within(i) == "type":
                first = r.back(i, _MODIFIERS[lang])
                return r.block("method", r.v(at), first, end, "function") or (Found("method", r.v(at), first, end) if end else None)
            return r.block("function", r.v(at), i, end, "function")
        return None
    # A method: in a type's body, a type and then a name with parameters.
    if v != "(" or r.within(i) != "type" or i not in r.pair:
        return None
    name = i - 1
    if r.v(name) == ">":
        depth = 0
        while name > 0:
            depth += (r.v(name) == ">") - (r.v(name) == "<")
            name -= 1
            if not depth:
                break
    kind_end = name - 1
    while lang == "csharp" and r.v(kind_end) == "." and r.word(kind_end - 1):  # an interface's method by its full name
        kind_end -= 2
    if not r.word(name) or not (r.word(kind_end) or r.v(kind_end) in (">", "]", "?", "*", ")")) or r.v(kind_end) in _MODIFIERS[lang] | {"new", "return", "operator", "delegate", "record", "throw", "else"}:
        return None
    begin = kind_end  # of the type
    while begin > 0 and r.v(begin - 1) not in (";", "{", "}"):
        if r.v(begin - 1) in ("=", "=>") or r.v(begin - 1) == "," and r.v(begin) not in (">",) and not _in_angle(r, begin - 1):
            return None
        begin = r.pair[begin - 1] if r.v(begin - 1) in (")", "]") and begin - 1 in r.pair else begin - 1
    if r.v(begin) == "@" and begin == kind_end - 1:
        return None  # an annotation and then a constructor
    k = begin
    while k < name:  # what is left of the type when modifiers, attributes and annotations are taken away
        if r.v(k) in _MODIFIERS[lang] or r.v(k) == "-":
            k += 1
        elif r.v(k) == "[" and lang == "csharp" and k in r.pair:
            k = r.pair[k] + 1
        elif r.v(k) == "@":
            k += 2
            while r.v(k) == "." and r.word(k + 1):
                k += 2
            k = r.pair[k] + 1 if r.v(k) == "(" and k in r.pair else k
        elif r.v(k) == "<" and lang == "java":
            k = r.angle(k)
        else:
            break
    if k >= name:
        return None
    end = r.until(r.pair[i] + 1, ("{", ";", "="))
    if end is None:
        return None
    if r.v(end) == "=":  # => expression;
        end = r.until(end, (";",))
        return Found("method", r.v(name), begin, end) if end else None
    return r.block("method", r.v(name), begin, end, "function") or Found("method", r.v(name), begin, end)


def _in_angle(r: Reader, i: int) -> bool:
    """Whether a comma is in a list in angle brackets that a member's type has."""
    depth = 0
    while i > 0 and r.v(i) not in (";", "{", "}"):
        depth += (r.v(i) == ">") - (r.v(i) == "<")
        if depth < 0:
            return True
        i -= 1
    return False


# ---------------------------------------------------------------- C and C++

_NO_TYPE = frozenset("void int char short long float double bool signed unsigned auto const static inline extern virtual explicit constexpr consteval constinit volatile register friend typename mutable restrict _Bool size_t".split()) - {"size_t"}
_NO_NAME = frozenset("if for while switch return sizeof alignas alignof decltype noexcept throw requires catch __attribute__ __declspec defined static_assert _Static_assert".split())


def native(r: Reader, i: int) -> Found | list[Found] | None:
    """A definition and a type may begin with the same token."""
    return [f for f in (_definition(r, i), _named_type(r, i)) if f]


def _named_type(r: Reader, i: int) -> Found | None:
    v = r.v(i)
    if v in ("struct", "class") and (r.lang == "cpp" or v == "struct") and r.v(i - 1) not in ("enum", "friend", ".") and not (r.v(i - 1) in ("<", ",") and v == "class"):
        at = i + 1
        while r.v(at) in ("__attribute__", "alignas", "__declspec") or r.v(at) == "[" and at in r.pair:
            at = r.pair.get(at if r.v(at) == "[" else at + 1, at) + 1
        begin = at
        while r.word(at) and r.v(at + 1) == ":" and r.v(at + 2) == ":":
            at += 3
        if not r.word(at):
            return r.block(None, None, i, at, "type") if r.v(at) == "{" else None
        end = at
        special = r.angle(at + 1)
        after = special + (r.v(special) == "final")
        body = after if r.v(after) == "{" else r.until(after, ("{", ";", "(", ")", "=")) if r.v(after) == ":" and r.v(after + 1) != ":" else None
        if body is not None and r.v(body) == "{" and body in r.pair:
            name = r.t.slice(begin, special - 1)
            return Found("struct" if v == "struct" else "class", name, i, r.pair[body], body, "type")
        return Found("struct" if v == "struct" else "class", r.t.slice(begin, end), i, end)
    if v == "{" and i not in r.bodies and i in r.pair:
        head = i - 1
        while head >= 0 and r.v(head) not in (";", "{", "}") and i - head < 12:
            head -= 1
        words = {r.v(k) for k in range(head + 1, i)}
        if "namespace" in words or words and words <= {"extern", '"C"', '"C++"'} or "union" in words and "=" not in words and "(" not in words:
            return Found(None, None, i, r.pair[i], i, "type")
    return None


def _definition(r: Reader, i: int) -> Found | None:
    """A function: a statement of the file, a namespace or a type."""
    v = r.v(i)
    if r.within(i) not in ("", "type") or not (i == 0 or r.v(i - 1) in (";", "{", "}", ">", '"C"') or r.v(i - 1) == ":" and r.v(i - 2) in ("public", "private", "protected") or r.t.after_break(i) and r.v(i - 1) in (")",)):
        return None
    if r.v(i - 1) == ">" and not _template(r, i - 1) or v in ("template", "namespace", "using", "typedef", "public", "private", "protected") or not (r.word(i) or v in ("~", "[")):
        return None
    return _function(r, i)


def _template(r: Reader, i: int) -> bool:
    """Whether a closing angle bracket ends `template <...>`."""
    depth = 0
    while i > 0 and r.v(i) not in (";", "{", "}"):
        depth += (r.v(i) == ">") - (r.v(i) == "<")
        if not depth:
            return r.v(i - 1) == "template"
        i -= 1
    return False


def _function(r: Reader, first: int) -> Found | None:
    params = first
    while True:  # the brackets of the parameters are the first after a name
        params = r.until(params, ("(", ";", "{", "="))
        if params is not None and r.v(params) == "=" and "operator" in (r.v(params - 1), r.v(params - 2)):
            params += 1
            continue
        if params is None or r.v(params) != "(" or params not in r.pair:
            return None
        before = r.v(params - 1)
        if before == "operator" and r.v(params + 1) == ")":
            params += 2
            continue
        if before in _NO_NAME:
            params = r.pair[params] + 1
            continue
        break
    name_end, close = params - 1, r.pair[params]
    if r.v(params + 1) in ("*", "&") and r.v(close + 1) == "(":  # (*name(...))(...): the chain of declarators goes inside
        inner = r.until(params + 1, ("(",))
        if inner is None or inner >= close or inner not in r.pair or not r.word(inner - 1):
            return None
        name_end, close = inner - 1, r.pair.get(close + 1, close)
    marks = name_end
    while marks > first and r.t.kinds[marks] == "mark" and r.v(marks) not in (">", "]", "~"):
        marks -= 1
    operator = next((k for k in range(max(first, name_end - 4), name_end + 1) if r.v(k) == "operator"), None)
    begin = operator if operator is not None else name_end
    if operator is None and not r.word(name_end):
        return None
    plain = operator is None
    if r.v(begin - 1) == "~":
        begin, plain = begin - 1, False
    qualified = False
    while r.v(begin - 1) == ":" and r.v(begin - 2) == ":":
        begin -= 3
        qualified = True
        if r.v(begin) == ">":
            depth = 0
            while begin > first:
                depth += (r.v(begin) == ">") - (r.v(begin) == "<")
                begin -= 1
                if not depth:
                    break
    if begin < first:
        return None
    end = _function_body(r, close + 1)
    if end is None:
        return None
    name = r.t.slice(begin, name_end) if plain or qualified else None
    if name is None or r.v(begin - 1) == "&":  # the name is not in the chain: a plain type's stands in for it
        kind = next((k for k in range(first, begin) if r.word(k) and r.v(k) not in _NO_TYPE), None)
        name = r.v(kind) if kind is not None and r.v(kind + 1) not in ("<", ":") else None
    if r.v(end) == "{":
        return Found("function" if name else None, name, first, r.pair[end], end, "function")
    return Found("function", name, first, end) if name else None


def _function_body(r: Reader, i: int) -> int | None:
    """The brace that begins the body, or the end of `= default;`, after the parameters."""
    starting = False  # in the list of a constructor's initial values
    while i < len(r.t.kinds):
        v = r.v(i)
        if v == "{":
            if i not in r.pair:
                return None
            if starting and (r.word(i - 1) or r.v(i - 1) == ">") and r.v(r.pair[i] + 1) in (",", "{"):
                i = r.pair[i] + 1
                continue
            return i
        if v == "=":
            return i + 2 if r.v(i + 1) in ("default", "delete") and r.v(i + 2) == ";" else None
        if v in (";", ")", "}", ",") and not (v == "," and starting):
            return None
        if v == ":" and r.v(i + 1) != ":" and r.v(i - 1) != ":":
            starting = True
        i = r.pair[i] + 1 if v in ("(", "[") and i in r.pair else i + 1
    return None


# ---------------------------------------------------------------- Ruby

_OPENS = frozenset("class module def begin do case".split())
_MAY_OPEN = frozenset("if unless while until for".split())


def _ruby_ends(r: Reader) -> dict[int, int]:
    """For each word that opens a block, its `end`."""
    ends, stack, loop_line = {}, [], -1
    for i, v in enumerate(r.t.values):
        if r.t.kinds[i] != "word" or r.v(i - 1) in (".", ":") and not r.t.after_break(i) or r.v(i - 1) == "def":
            continue
        begins = r.t.after_break(i) or r.v(i - 1) in (";", "=", "(", "[", ",", "|", "then", "do", "else", "return", "{", "&", ">", "!", "begin", "ensure")
        if v in _MAY_OPEN and begins:
            stack.append(i)
            loop_line = r.t.lines[i] if v in ("while", "until", "for") else loop_line
        elif v in _OPENS:
            if v == "do" and r.t.lines[i] == loop_line:
                loop_line = -1
                continue
            if v == "def" and _endless(r, i):
                continue
            stack.append(i)
        elif v == "end":
            if stack:
                ends[stack.pop()] = i
            else:
                r.t.wrong = r.t.wrong or f"end closes nothing in line {r.t.lines[i] + 1}"
    if stack:
        r.t.wrong = r.t.wrong or f"nothing ends {r.v(stack[-1])} of line {r.t.lines[stack[-1]] + 1}"
    return ends


def _method_name(r: Reader, i: int) -> tuple[str, int] | None:
    """Name of the method that `def` at i begins, and the token after it."""
    at = i + 1
    if r.word(at) and r.v(at + 1) == ".":
        at += 2
    if at >= len(r.t.kinds):
        return None
    end = at
    if not r.word(at):
        while r.t.kinds[end + 1 : end + 2] == ["mark"] and r.t.starts[end + 1] == r.t.ends[end] and r.v(end + 1) not in ("(", ";"):
            end += 1
    elif r.v(at + 1) == "=" and r.t.starts[at + 1] == r.t.ends[at] and r.v(at + 2) in ("(",):
        end += 1
    return r.t.slice(at, end), end + 1


def _endless(r: Reader, i: int) -> bool:
    found = _method_name(r, i)
    if not found:
        return False
    at = r.pair[found[1]] + 1 if r.v(found[1]) == "(" and found[1] in r.pair else found[1]
    return r.v(at) == "=" and not r.t.after_break(at)


def ruby_rule(r: Reader) -> Callable[[Reader, int], Found | None]:
    ends = _ruby_ends(r)

    def rule(r: Reader, i: int) -> Found | None:
        v = r.v(i)
        if v in ("class", "module") and i in ends and r.word(i + 1):
            last = i + 1
            while r.v(last + 1) == ":" and r.v(last + 2) == ":":
                last += 3
            head = last
            while head + 1 < ends[i] and not r.t.after_break(head + 1) and r.v(head + 1) != ";":
                head += 1
            return Found(v, r.t.slice(i + 1, last), i, ends[i], head + 1 if head + 1 < ends[i] else None)
        if v == "def" and r.v(i - 1) not in (".", ":") and (found := _method_name(r, i)):
            after = r.pair[found[1]] + 1 if r.v(found[1]) == "(" and found[1] in r.pair else found[1]
            if i in ends:
                while after < ends[i] and not r.t.after_break(after) and r.v(after) != ";":
                    after += 1
                return Found("method", found[0], i, ends[i], after if after < ends[i] else None)
            if _endless(r, i):
                last = after
                while last + 1 < len(r.t.kinds) and not r.t.after_break(last + 1):
                    last = r.pair.get(last + 1, last + 1)
                return Found("method", found[0], i, last)
        return None

    return rule


RULE: dict[str, Callable[[Reader, int], Found | list[Found] | None] | None] = {"javascript": script, "typescript": script, "tsx": script, "go": go, "rust": rust, "java": classes, "csharp": classes, "php": classes, "c": native, "cpp": native, "ruby": None}


def declarations(text: str, lang: str) -> tuple[Reader, list[tuple[list[str], Found]], str | None]:
    """The reader, every declaration with the names of its owners, and what is wrong with the text (None: nothing)."""
    r = Reader(text, lang)
    rule = RULE[lang] or ruby_rule(r)
    out: list[tuple[list[str], Found]] = []
    owners: list[tuple[str | None, int]] = []
    i = 0
    begun: set[int] = set()  # first tokens: a rule may come upon a declaration twice
    while i < len(r.t.kinds):
        owners = [o for o in owners if o[1] >= i]
        some = rule(r, i)
        for found in some if isinstance(some, list) else [some] if some else []:
            if found.kind and found.name and (found.first, found.kind, found.name) in begun:
                continue
            if found.body is not None and found.inside:
                r.bodies[found.body] = found.inside
            if found.kind and found.name:
                begun.add((found.first, found.kind, found.name))
                out.append(([name for name, last in owners if last >= found.last], found))
                owners.append((found.name, found.last))
            elif found.inside == "macro":
                i = found.last
        i += 1
    return r, out, r.t.wrong
