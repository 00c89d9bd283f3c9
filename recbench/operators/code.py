"""Python sources: files out of lines, the functions they import and call, their docstrings.

Parsing needs Python's own parser, so it runs as a table function, one source at a time. Sources are parsed, never run or
imported; one that doesn't parse gives no rows.
"""

from __future__ import annotations

import ast

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..functions.text import function_name
from ..shared import ship


def files(lines: DataFrame, *keys: str, number: str = "line_num", line: str = "line") -> DataFrame:
    """(keys, source): the lines of each file in the order of their numbers."""
    ordered = F.array_sort(F.collect_list(F.struct(number, line)))
    return lines.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda x: x[line]), "\n").alias("source"))


def _dotted(node: ast.expr) -> str | None:
    """a.b.c of plain names and attributes; None for anything called or indexed on the way."""
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *reversed(parts)]) if isinstance(node, ast.Name) else None


def names_used(source: str | None) -> list[tuple[int, str]]:
    """(line, dotted name) of every import and every call of a plain name, in the order of the tree.

    A name imported under another one counts under its own. A line that declares the encoding is blanked first, so that
    line numbers hold.
    """
    lines = ["" if "coding:" in x else x for x in (source or "").split("\n")]
    try:
        tree = ast.parse("\n".join(lines))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    renamed: dict[str, str] = {}
    out: list[tuple[int, str]] = []
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            for name in node.names:
                renamed[name.asname or name.name] = name.name
                out.append((node.lineno, name.name))
        elif isinstance(node, ast.ImportFrom) and node.module:
            for name in node.names:
                renamed[name.asname or name.name] = f"{node.module}.{name.name}"
                out.append((node.lineno, f"{node.module}.{name.name}"))
    for node in ast.walk(tree):
        if isinstance(node, ast.Call) and (name := _dotted(node.func)):
            head, dot, rest = name.partition(".")
            out.append((node.lineno, renamed.get(head, head) + dot + rest))
    return sorted(set(out))


@udtf(returnType="line_num int, function string")
class UsedNames:
    def eval(self, source: str):
        yield from names_used(source)


def docstrings(source: str | None) -> list[tuple[str, str]]:
    """(name, docstring) of the module, its functions, classes and methods that have one."""
    try:
        tree = ast.parse(source or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    kinds = (ast.Module, ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
    return [(getattr(x, "name", ""), doc) for x in ast.walk(tree) if isinstance(x, kinds) and (doc := ast.get_docstring(x))]


@udtf(returnType="name string, docstring string")
class Docstrings:
    def eval(self, source: str):
        yield from docstrings(source)


def functions_of(sources: DataFrame, *keys: str) -> DataFrame:
    """(keys, line_num, function): short lower-case names of what each source imports and calls."""
    ship(sources.sparkSession)
    out = sources.lateralJoin(UsedNames(F.col("source").outer()))
    return out.select(*keys, "line_num", function_name(F.col("function")).alias("function"))


def docstrings_of(sources: DataFrame, *keys: str) -> DataFrame:
    ship(sources.sparkSession)
    return sources.lateralJoin(Docstrings(F.col("source").outer())).select(*keys, "name", "docstring")
