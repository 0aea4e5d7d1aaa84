"""Table functions from files to symbols, one parser a language, chosen by a registry that callers can extend."""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam import schemas
from loam.functions import text as T
from loam.operators.declarations import declared

Parser = Callable[[DataFrame], DataFrame]
#: Files and symbols that a parser holds at once as Python objects, however many a batch has.
FILES_HELD, ROWS_HELD = 200, 5000
NAME = r"[A-Za-z_][A-Za-z0-9_]*"
COLUMNS = [x.strip().split(" ")[0] for x in schemas.SYMBOLS.split(",")]


def _import_names(tree: ast.AST) -> list[str]:
    """``import a.b`` gives ``a.b``; ``from .x import y`` gives ``.x`` and ``.x.y``; ``from . import y`` gives ``.y``."""
    names = []
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            names += [a.name for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            base = "." * node.level + (node.module or "")
            names += [base] if node.module else []
            names += [base + ("." if node.module else "") + a.name for a in node.names if a.name != "*"]
    return names


def _python_rows(path: str, text: str) -> Iterator[tuple]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return
    imports = list(dict.fromkeys(_import_names(tree)))
    kinds = {ast.FunctionDef: "function", ast.AsyncFunctionDef: "function", ast.ClassDef: "class"}
    for n, node in enumerate(x for x in ast.walk(tree) if type(x) in kinds):
        kind, name, calls = kinds[type(node)], node.name, []
        if kind == "function":
            heads = [c.func for c in ast.walk(node) if isinstance(c, ast.Call)]
            calls = [h.id if isinstance(h, ast.Name) else h.attr for h in heads if isinstance(h, ast.Name | ast.Attribute)]
            signature = f"{'async ' * isinstance(node, ast.AsyncFunctionDef)}def {name}({', '.join(a.arg for a in node.args.args)})"
        else:
            signature = f"class {name}"
        doc = ast.get_docstring(node) or ""
        yield f"{path}::{name}:{node.lineno}", kind, name, path, node.lineno, node.end_lineno, signature, doc, calls, imports, n


def _parsed(files: DataFrame, language: str, symbols: Callable[[str, str], Iterator[tuple]]) -> DataFrame:
    """The symbol rows of a language's files; a task holds few of them at once, so its memory hangs on no batch size."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, held = [], 0
            for path, text in zip(batch["path"], batch["text"]):
                rows.extend(symbols(path, text))
                held += 1
                if held >= FILES_HELD or len(rows) >= ROWS_HELD:
                    yield pd.DataFrame(rows, columns=COLUMNS)
                    rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=COLUMNS)

    return files.where(F.col("lang") == language).select("path", "text").mapInPandas(run, schemas.SYMBOLS)


def parse_python(files: DataFrame) -> DataFrame:
    """Functions and classes of Python files, breadth first, by the interpreter's own parser.

    A file's imports are attached to each of its symbols; functions carry the names they call, nested ones included.
    Files that do not parse have no symbols.
    """
    return _parsed(files, "python", _python_rows)


def _symbol(kind: str, name: Column, start: Column, end: Column, signature: Column, calls: Column | None = None) -> Column:
    none = F.array().cast("array<string>")
    return F.struct(F.lit(kind).alias("kind"), name.alias("name"), start.alias("start_line"), end.alias("end_line"), signature.alias("signature"), (none if calls is None else calls).alias("calls"))


def _emit(files: DataFrame, found: Column, imports: Column) -> DataFrame:
    rows = files.select("path", imports.alias("imports"), F.posexplode(found).alias("ord", "s"))
    symbol_id = F.concat("path", F.lit("::"), F.col("s.name"), F.lit(":"), F.col("s.start_line"))
    return rows.select(
        symbol_id.alias("id"), "s.kind", "s.name", "path", "s.start_line", "s.end_line", "s.signature", F.lit("").alias("docstring"), "s.calls", "imports", "ord"
    )


def parse_script(files: DataFrame) -> DataFrame:
    """Functions and classes of JavaScript and TypeScript files, the first of each on a line, with the file's imports."""
    own = files.where(F.col("lang").isin("javascript", "typescript"))
    lines = T.split_lines("text")
    imports = F.regexp_extract_all("text", F.lit(r"(?m)^\s*import\s+.*?from\s+[\"']([^\"']+)[\"']"), F.lit(1))

    def on_line(line: Column, i: Column) -> Column:
        at = (i + 1).cast("int")
        f, k = (F.regexp_extract(line, rf"(?:export\s+)?{w}\s+({NAME})", 1) for w in ("function", "class"))
        return F.array(_symbol("function", f, at, at, F.concat(F.lit("function "), f, F.lit("(...)"))), _symbol("class", k, at, at, F.concat(F.lit("class "), k)))

    found = F.filter(F.flatten(F.transform(lines, on_line)), lambda s: s["name"] != "")
    return _emit(own, found, imports)


def parse_declarations(language: str) -> Parser:
    """A parser by tokens and brackets (:mod:`loam.operators.declarations`) of ``java``, ``go`` or ``csharp``.

    Types and functions at any depth, with their ends, the names that functions call, and the file's imports. Lines
    of annotations or attributes above a declaration are not its own. Broken text is read as far as brackets pair.
    """

    return lambda files: _parsed(files, language, lambda path, text: declared(path, text, language))


#: Parsers by name; each takes all files and reads those of its languages.
PARSERS: dict[str, Parser] = {
    "python": parse_python,
    "script": parse_script,
    "java": parse_declarations("java"),
    "go": parse_declarations("go"),
    "csharp": parse_declarations("csharp"),
}


def parse_symbols(files: DataFrame, parsers: dict[str, Parser] = PARSERS) -> DataFrame:
    """Symbols of all files: the union of the parsers' rows."""
    parts = [parse(files) for parse in parsers.values()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
