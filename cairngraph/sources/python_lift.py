"""Python sources to nodes and edges, file by file, with the standard library's parser.

One Arrow-batched pass over (uri, text): a file is parsed where it is read, and what
comes out are plain rows.  A file that does not parse gives one row of kind
``PyError`` instead of failing the job.
"""

from __future__ import annotations

import ast
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = "uri string, ordinal int, parent int, kind string, name string, start_line int, end_line int, payload string"
_SCOPES = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
_COMPREHENSIONS = (ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp)


def _all_of(tree: ast.Module) -> list[str] | None:
    for node in tree.body:
        if isinstance(node, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "__all__" for t in node.targets):
            try:
                return [str(x) for x in ast.literal_eval(node.value)]
            except ValueError:
                return None
    return None


def lift(text: str) -> list[tuple[int, int, str, str, int, int, dict]]:
    """(ordinal, parent, kind, name, first line, last line, payload), the module first with parent -1."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError) as e:
        return [(0, -1, "PyError", "", 1, 1, {"error": str(e)})]
    exports = _all_of(tree)
    out = [(0, -1, "PyModule", "", 1, text.count("\n") + 1, {} if exports is None else {"all_exports": exports})]

    def emit(node: ast.AST, parent: int) -> int | None:
        payload: dict = {}
        name = getattr(node, "name", "") or ""
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            kind = "PyFunction"
            payload = {
                "decorators": [ast.unparse(d) for d in node.decorator_list], "is_async": isinstance(node, ast.AsyncFunctionDef),
                "has_walrus": any(isinstance(x, ast.NamedExpr) for b in node.body for x in ast.walk(b)), "args": [a.arg for a in node.args.args],
            }
        elif isinstance(node, ast.ClassDef):
            kind = "PyClass"
            payload = {"decorators": [ast.unparse(d) for d in node.decorator_list], "bases": [ast.unparse(b) for b in node.bases], "keywords": {k.arg: ast.unparse(k.value) for k in node.keywords if k.arg}}
        elif isinstance(node, ast.Import):
            kind, payload = "PyImport", {"modules": [[a.name, a.asname] for a in node.names]}
        elif isinstance(node, ast.ImportFrom):
            kind, name, payload = "PyImport", node.module or "", {"level": node.level, "names": [[a.name, a.asname] for a in node.names]}
        elif isinstance(node, ast.Match):
            kind, payload = "PyMatchStatement", {"cases": len(node.cases)}
        elif isinstance(node, ast.TypeAlias):
            kind, name = "PyTypeAlias", node.name.id
        elif isinstance(node, _COMPREHENSIONS):
            kind, payload = "PyComprehension", {"form": type(node).__name__}
        elif isinstance(node, ast.Lambda):
            kind, payload = "PyLambda", {"args": [a.arg for a in node.args.args]}
        else:
            return None
        out.append((len(out), parent, kind, name, node.lineno, node.end_lineno or node.lineno, payload))
        return len(out) - 1

    stack: list[tuple[ast.AST, int]] = [(child, 0) for child in reversed(tree.body)]
    while stack:  # no recursion: deeply nested files are read too
        node, parent = stack.pop()
        own = emit(node, parent)
        below = own if own is not None and isinstance(node, (*_SCOPES, *_COMPREHENSIONS, ast.Lambda)) else parent
        stack += [(child, below) for child in reversed(list(ast.iter_child_nodes(node)))]
    return out


def lift_files(files: DataFrame) -> DataFrame:
    """Rows of every file of (uri, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for pdf in batches:
            rows = [(uri, *row[:6], json.dumps(row[6], sort_keys=True)) for uri, text in zip(pdf["uri"], pdf["text"]) for row in lift(text or "")]
            yield pd.DataFrame(rows, columns=names)

    return files.select("uri", "text").mapInPandas(run, SCHEMA)


def module_name(uri: str, packages: set[str]) -> str:
    """Dotted name of a file below its outermost directory known to hold a package."""
    parts = uri.removesuffix(".py").split("/")
    start = len(parts) - 1
    while start > 0 and "/".join(parts[:start]) in packages:
        start -= 1
    return ".".join(p for p in parts[start:] if p != "__init__")


def resolve_relative(consumer: str, level: int, module: str, is_package: bool) -> str | None:
    """What ``from <level dots><module>`` means in a module; None where there are more dots than packages."""
    if level == 0:
        return module
    parts = consumer.split(".") if consumer else []
    drop = level - 1 if is_package else level
    if drop > len(parts):
        return None
    return ".".join([*parts[: len(parts) - drop], *([module] if module else [])]) or None
