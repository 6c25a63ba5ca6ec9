"""Tokens of source files in eleven languages: words, marks, and strings as one token each.

One pattern a language, and modes where a pattern can't do: templates with code inside, regular
expressions by what comes before them, here-documents that begin on the next line, nested
comments. Comments and preprocessor lines make no tokens. Brackets are matched; a bracket
without a partner is noted; a closing one takes the nearest open one of its kind, and braces that
are left open end with the file.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_LINE, _BLOCK = r"//[^\n]*", r"/\*.*?(?:\*/|\Z)"
_DOUBLE, _SINGLE = r'"(?:\\.|[^"\\\n])*"', r"'(?:\\.|[^'\\\n])*'"
_NUMBER = r"\.?\d(?:[eEpP][+-]|['\w.])*"
_WORD = r"[^\W\d]\w*"

#: Comments, strings and words of each language, in the order in which they are tried.
RULES: dict[str, tuple[str, str, str]] = {
    "javascript": (rf"{_LINE}|{_BLOCK}", rf"{_DOUBLE}|{_SINGLE}", r"[#$]?[^\W\d][\w$]*|\$[\w$]*"),
    "go": (rf"{_LINE}|{_BLOCK}", rf"`[^`]*`|{_DOUBLE}|{_SINGLE}", _WORD),
    "rust": (_LINE, rf"b?r(?P<hash>\#*)\".*?\"(?P=hash)|b?\"(?:\\.|[^\"\\])*\"|b?'(?:\\[^']+|[^'\\\n])'|'{_WORD}", rf"(?:r\#)?{_WORD}"),
    "java": (rf"{_LINE}|{_BLOCK}", rf'"""(?:\\.|.)*?"""|{_DOUBLE}|{_SINGLE}', r"[^\W\d][\w$]*|\$[\w$]*"),
    "csharp": (rf"{_LINE}|{_BLOCK}|^[ \t]*\#[^\n]*", rf'\$*"""(?:.*?)"""|(?:\$@|@\$|@)"(?:""|[^"])*"|\$?{_DOUBLE}|{_SINGLE}', rf"@?{_WORD}"),
    "c": (rf"{_LINE}|{_BLOCK}|^[ \t]*\#(?:\\\r?\n|[^\n])*", rf'(?:u8|[uUL])?R"(?P<raw>[^(\s]*)\(.*?\)(?P=raw)"|(?:u8|[uUL])?{_DOUBLE}|(?:u8|[uUL])?{_SINGLE}', _WORD),
    "php": (rf"{_LINE}|{_BLOCK}|\#(?!\[)[^\n]*", r'"(?:\\.|[^"\\])*"|' + r"'(?:\\.|[^'\\])*'|<<<[ \t]*(?P<q>[\"']?)(?P<doc>\w+)(?P=q)\n.*?^[ \t]*(?P=doc)\b", rf"\$*{_WORD}"),
    "ruby": (r"\#[^\n]*|^=begin\b.*?^=end\b[^\n]*|^__END__\n.*", rf"{_SINGLE}|`[^`\n]*`|:\"(?:\\.|[^\"\\\n])*\"", r"@{0,2}[^\W\d]\w*[?!]?|(?<!:):[^\W\d]\w*[?!=]?(?!:)"),
}
RULES |= {"typescript": RULES["javascript"], "tsx": RULES["javascript"], "cpp": RULES["c"]}
_PATTERNS = {
    lang: re.compile(rf"(?P<skip>[^\S\n]+|\\\n|{skip})|(?P<nl>\n)|(?P<str>{strings})|(?P<num>{_NUMBER})|(?P<word>{words})|(?P<mark>.)", re.DOTALL | re.MULTILINE)
    for lang, (skip, strings, words) in RULES.items()
}
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/\w*")
#: Words after which a value begins, so that a slash begins a regular expression.
_BEFORE_VALUE = {"return", "typeof", "case", "in", "of", "do", "else", "void", "delete", "throw", "new", "await", "yield", "if", "unless", "while", "until", "when", "and", "or", "not", "then", "puts"}
_PARTNER = {")": "(", "]": "[", "}": "{"}
_CALLED = {"(": "a parenthesis", "[": "a bracket", "{": "a brace"}


@dataclass
class Tokens:
    text: str
    kinds: list[str] = field(default_factory=list)  # word, mark, str, num
    values: list[str] = field(default_factory=list)
    starts: list[int] = field(default_factory=list)
    ends: list[int] = field(default_factory=list)
    lines: list[int] = field(default_factory=list)  # of the beginning
    pair: dict[int, int] = field(default_factory=dict)  # of brackets, either way
    outer: list[int] = field(default_factory=list)  # the innermost open bracket around a token, or -1
    wrong: str | None = None

    def value(self, i: int) -> str:
        return self.values[i] if 0 <= i < len(self.values) else ""

    def is_word(self, i: int) -> bool:
        return 0 <= i < len(self.kinds) and self.kinds[i] == "word"

    def after_break(self, i: int) -> bool:
        """Whether a token is the first of its line."""
        return i == 0 or self.lines[i] != self.lines[i - 1] + self.values[i - 1].count("\n")

    def slice(self, first: int, last: int) -> str:
        return self.text[self.starts[first] : self.ends[last]]


def _nested(text: str, at: int, quote: str, opening: str) -> int:
    """Where a string ends that begins at `at` and holds code between `opening` and a closing brace; the end of the text if nowhere."""
    i = at + 1
    while i < len(text):
        if text[i] == "\\":
            i += 2
        elif text[i] == quote:
            return i + 1
        elif text.startswith(opening, i):
            depth, i = 1, i + len(opening)
            while i < len(text) and depth:
                if text[i] == quote and quote == "`" or text[i] in "\"'" and quote != text[i]:
                    i = _nested(text, i, text[i], opening if text[i] == "`" else "\0")
                    continue
                depth += (text[i] == "{") - (text[i] == "}")
                i += 1
        else:
            i += 1
    return len(text)


def tokens(text: str, lang: str) -> Tokens:
    out, pattern, i, line = Tokens(text), _PATTERNS[lang], 0, 0
    docs: list[str] = []  # here-documents that begin on the next line
    script = lang in ("javascript", "typescript", "tsx")
    if lang == "php":
        i = m.end() if (m := re.search(r"<\?(?:php\b|=)?", text)) else len(text)
        line = text.count("\n", 0, i)

    def add(kind: str, end: int) -> None:
        nonlocal i, line
        out.kinds.append(kind), out.values.append(text[i:end]), out.starts.append(i), out.ends.append(end), out.lines.append(line)
        line += text.count("\n", i, end)
        i = end

    while i < len(text):
        c, value_before = text[i], bool(out.kinds) and (out.kinds[-1] != "mark" and out.values[-1] not in _BEFORE_VALUE or out.values[-1] in (")", "]", "}"))
        if script and c == "`" or lang == "ruby" and c == '"':
            add("str", _nested(text, i, c, "${" if c == "`" else "#{"))
            continue
        if c == "/" and (script or lang == "ruby") and not value_before and (m := _REGEX.match(text, i)):
            add("str", m.end())
            continue
        if lang == "rust" and text.startswith("/*", i):
            depth, end = 0, i
            for m in re.compile(r"/\*|\*/").finditer(text, i):
                depth, end = depth + (1 if m[0] == "/*" else -1), m.end()
                if not depth:
                    break
            line, i = line + text.count("\n", i, end), end if not depth else len(text)
            continue
        if lang == "ruby" and (m := re.compile(r"<<[~-]([\"'`]?)(\w+)\1").match(text, i)):
            docs.append(m[2])
            add("str", m.end())
            continue
        if lang == "ruby" and c == "%" and not value_before and (m := re.compile(r"%[qQwWiIrsx]?([\[({<|!/])").match(text, i)):
            close = {"[": "]", "(": ")", "{": "}", "<": ">"}.get(m[1], m[1])
            end = text.find(close, m.end())
            add("str", len(text) if end < 0 else end + 1)
            continue
        if lang == "php" and text.startswith("?>", i):
            m = re.compile(r"<\?(?:php\b|=)?").search(text, i)
            end = m.end() if m else len(text)
            line, i = line + text.count("\n", i, end), end
            continue
        m = pattern.match(text, i)
        kind = m.lastgroup if m.lastgroup in ("skip", "nl", "str", "num", "word", "mark") else next(k for k in ("skip", "str") if m[k])
        if kind == "nl":
            line, i = line + 1, i + 1
            for name in docs:
                stop = re.compile(rf"^[ \t]*{re.escape(name)}[ \t]*$\n?", re.MULTILINE).search(text, i)
                end = stop.end() if stop else len(text)
                line, i = line + text.count("\n", i, end), end
            docs = []
        elif kind == "skip":
            line, i = line + m[0].count("\n"), m.end()
        else:
            add(kind, m.end())
    _match(out)
    return out


def _match(out: Tokens) -> None:
    stack: list[int] = []
    for i, (kind, value) in enumerate(zip(out.kinds, out.values, strict=True)):
        if kind == "mark" and value in ")]}":
            if any(out.values[k] == _PARTNER[value] for k in stack):
                while out.values[k := stack.pop()] != _PARTNER[value]:
                    out.wrong = out.wrong or f"{_CALLED[out.values[k]]} is left open in line {out.lines[k] + 1}"
                out.pair[k], out.pair[i] = i, k
            else:
                out.wrong = out.wrong or f"{_CALLED[_PARTNER[value]]} closes nothing in line {out.lines[i] + 1}"
        out.outer.append(stack[-1] if stack else -1)
        if kind == "mark" and value in "([{":
            stack.append(i)
    for k in stack:
        out.wrong = out.wrong or f"{_CALLED[out.values[k]]} is left open in line {out.lines[k] + 1}"
        if out.values[k] == "{":
            out.pair[k] = len(out.values) - 1
