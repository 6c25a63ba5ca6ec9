"""Symbols of source files: a table function over (path, content).

Python is parsed by its own grammar; files that don't parse are looked through line by line
and are `partial` if that finds anything. The other languages have a lexer and rules of
declarations (lexer.py, declarations.py). Files with a bracket, a block or a string without
its end are `partial`, or `error` without any symbol; what a full grammar calls an error
inside of matching brackets goes unseen.

One row a symbol, and one status row a file (with a null qualname), so that files without
symbols are not lost.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from hayrick.functions.roles import LANGUAGES
from hayrick.sources import declarations

SCHEMA = "path string, lang string, status string, detail string, name string, qualname string, kind string, line int, end_line int, signature string, full_signature string, docstring string, body string"
SIGNATURE, DOCSTRING = 200, 500
#: Tasks of a core that files are dealt to.
DEALT = 4

#: Lines that declare something in Python files that can't be parsed.
_PYTHON = [(kind, re.compile(p)) for kind, p in (("class", r"^\s*class\s+(?P<name>\w+)"), ("function", r"^\s*(?:async\s+)?def\s+(?P<name>\w+)"))]
PARSED = ("python", *declarations.RULE)


#: A declaration of each language that its parser must find.
_PROBES = {"python": "def f():\n  pass\n", "go": "func F() {\n}\n", "rust": "fn f() {\n}\n", "ruby": "def f\nend\n", "php": "<?php\nfunction f() {\n}\n", "c": "int f(int a) {\n}\n", "cpp": "int f(int a) {\n}\n"}


def preflight(languages: list[str]) -> dict[str, str]:
    """Languages whose parser can't be used, each with the reason."""
    out = {}
    for lang in languages:
        if lang not in PARSED:
            out[lang] = "no declarations are known of this language"
            continue
        try:
            found, status, detail = parse_source(_PROBES.get(lang, "class A {\n}\n").encode(), lang)
            if not found:
                out[lang] = f"nothing is found in a plain declaration ({status}: {detail})"
        except Exception as e:  # whatever a parser fails with is the answer
            out[lang] = str(e)[:200]
    return out


def language(path: str) -> str | None:
    m = re.search(r"\.[^./]+$", path)
    return LANGUAGES.get(m.group()) if m else None


def _row(lines: list[str], kind: str, name: str, owners: list[str], first: int, last: int, head_end: int | None, doc: str) -> dict:
    signature = lines[first].strip()[:SIGNATURE]
    full = "\n".join(lines[first:head_end]).strip() if head_end and head_end > first else signature
    return {"name": name, "qualname": ".".join([*owners, name]), "kind": kind, "line": first + 1, "end_line": last + 1, "signature": signature, "full_signature": full or signature, "docstring": doc.strip()[:DOCSTRING], "body": "\n".join(lines[first : last + 1])}


def _python(text: str, lines: list[str]) -> list[dict]:
    out: list[dict] = []

    def walk(node: ast.AST, owners: list[str]) -> None:
        for child in ast.iter_child_nodes(node):
            inner = owners
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                kind = "class" if isinstance(child, ast.ClassDef) else "function"
                doc = ast.get_docstring(child, clean=False) or ""
                out.append(_row(lines, kind, child.name, owners, child.lineno - 1, child.end_lineno - 1, child.body[0].lineno - 1, doc))
                inner = [*owners, child.name]
            walk(child, inner)

    walk(ast.parse(text), [])
    return out


def _by_lines(lines: list[str]) -> list[dict]:
    """Declarations of a broken Python file, by their lines and indents."""
    out, owners = [], []
    for i, line in enumerate(lines):
        owners = [o for o in owners if o[1] >= i]
        for kind, pattern in _PYTHON:
            if m := pattern.match(line):
                indent, last = len(line) - len(line.lstrip()), i
                for k in range(i + 1, len(lines)):
                    if lines[k].strip():
                        if len(lines[k]) - len(lines[k].lstrip()) <= indent:
                            break
                        last = k
                out.append(_row(lines, kind, m["name"], [o[0] for o in owners], i, last, None, ""))
                owners.append((m["name"], last))
                break
    return out


def _declared(text: str, lines: list[str], lang: str) -> tuple[list[dict], str | None]:
    """Symbols by the rules of a language, and what is wrong with the text."""
    reader, found, wrong = declarations.declarations(text, lang)
    out = []
    for owners, d in found:
        t = reader.t
        first, last = t.lines[d.first], t.lines[d.last] + t.values[d.last].count("\n")
        signature = text[t.starts[d.first] : t.ends[d.last]].split("\n", 1)[0][:SIGNATURE]
        head = text[t.starts[d.first] : t.starts[d.body]].strip() if d.body is not None else ""
        out.append({"name": d.name, "qualname": ".".join([*owners, d.name]), "kind": d.kind, "line": first + 1, "end_line": last + 1, "signature": signature, "full_signature": head or signature, "docstring": "", "body": "\n".join(lines[first : last + 1])})
    return out, wrong


def parse_source(content: bytes, lang: str | None) -> tuple[list[dict], str, str | None]:
    """Symbols, status (ok, partial, empty, unsupported, error) and detail of one file."""
    if lang not in PARSED:
        return [], "unsupported", f"no parser for {lang}"
    text = content.decode("utf-8", "replace")
    lines = text.split("\n")
    if lang == "python":
        try:
            found = _python(text, lines)
            return found, "ok" if found else "empty", None
        except (SyntaxError, ValueError, RecursionError) as e:
            found = _by_lines(lines)
            return found, "partial" if found else "error", str(e)[:200]
    found, wrong = _declared(text, lines, lang)
    if wrong:
        return found, "partial" if found else "error", wrong
    return found, "ok" if found else "empty", None


def parse(files: DataFrame) -> DataFrame:
    """files: path and content (binary; null if it couldn't be read)."""
    kinds = {"string": pa.string(), "int": pa.int32()}
    fields = pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in SCHEMA.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(*(batch.column(k).to_pylist() for k in (0, 1)), strict=True):
                lang = language(path)
                found, status, detail = ([], "unreadable", None) if content is None else parse_source(content, lang)
                file = {"path": path, "lang": lang, "status": status, "detail": detail}
                rows += [file, *(file | s for s in found)]
            yield pa.RecordBatch.from_pylist(rows, fields)

    # Files that are small together can lie in one split and yet take long to parse: they are dealt to all cores.
    dealt = files.select("path", "content").repartition(DEALT * files.sparkSession.sparkContext.defaultParallelism)
    return dealt.mapInArrow(run, SCHEMA)
