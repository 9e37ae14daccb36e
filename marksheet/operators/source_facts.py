"""Facts of Python sources, one row each; sources are parsed on the executors and never run."""

from __future__ import annotations

import ast
from collections.abc import Collection, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marksheet.sources.tables import spread

#: Tasks for each core at least, sources of a task on average and rows of a frame at most, but for the last source's own.
TASKS_A_CORE, SOURCES_A_TASK, ROWS_A_FRAME = 4, 50_000, 100_000
CONSTRUCTS = {
    ast.For: "for", ast.While: "while", ast.If: "if", ast.Try: "try", ast.With: "with", ast.Lambda: "lambda", ast.ListComp: "comprehension",
    ast.SetComp: "comprehension", ast.DictComp: "comprehension", ast.GeneratorExp: "comprehension", ast.ClassDef: "class",
}

#: Nodes that are no facts and have no statements or expressions below them: not worth a visit.
LEAVES = {ast.Name, ast.Constant, ast.alias, *(leaf for kind in (ast.expr_context, ast.boolop, ast.operator, ast.unaryop, ast.cmpop) for leaf in kind.__subclasses__())}
COLUMNS = ["file_id", "fact", "name", "line", "in_function"]


def _dotted(node: ast.expr) -> str:
    """a.b.c; an empty part stands for any other expression."""
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id if isinstance(node, ast.Name) else "", *reversed(parts)])


def _facts(source: str) -> Iterator[tuple[str, str, int, str | None]]:
    try:
        todo = [(ast.parse(source), None)]
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        yield "error", getattr(e, "msg", None) or type(e).__name__, getattr(e, "lineno", None) or 1, None
        return
    while todo:
        node, inside = todo.pop()
        kind = type(node)
        if kind is ast.FunctionDef or kind is ast.AsyncFunctionDef:
            yield "function", node.name, node.lineno, inside
            todo += [(d, inside) for d in node.decorator_list]
            todo += [(n, node.name) for n in (node.args, *node.body)]
            continue
        if kind is ast.Call:
            if name := _dotted(node.func):
                yield ("method" if "." in name else "call"), name, node.lineno, inside
        elif kind is ast.Import:
            yield from (("import", a.name, node.lineno, inside) for a in node.names)
        elif kind is ast.ImportFrom:
            yield "import", "." * node.level + (node.module or ""), node.lineno, inside
        elif kind in CONSTRUCTS:
            yield "construct", CONSTRUCTS[kind], node.lineno, inside
        for value in vars(node).values():
            if isinstance(value, list):
                todo += [(n, inside) for n in value if isinstance(n, ast.AST) and type(n) not in LEAVES]
            elif isinstance(value, ast.AST) and type(value) not in LEAVES:
                todo.append((value, inside))


def source_facts(sources: DataFrame, only: Collection[str] = ()) -> DataFrame:
    """sources(file_id, source) to (file_id, fact, name, line, in_function).

    fact: function, call, method, import, construct, or error where the source can't be parsed; those in only, if it names any. Null
    sources are empty and give no row; in_function is null at the level of the module."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for i, s in zip(frame.file_id, frame.source, strict=True):
                rows += [(i, *f) for f in _facts(s or "") if not only or f[0] in only]
                if len(rows) >= ROWS_A_FRAME:
                    yield pd.DataFrame(rows, columns=COLUMNS)
                    rows = []
            yield pd.DataFrame(rows, columns=COLUMNS)

    kind = sources.schema["file_id"].dataType.simpleString()
    # Sources are dear by their length, and may come in a few small files: dealt out anew, so that all cores parse.
    dealt = spread(sources.select("file_id", "source"), "file_id", rows=SOURCES_A_TASK, a_core=TASKS_A_CORE)
    return dealt.mapInPandas(work, f"file_id {kind}, fact string, name string, line int, in_function string")


def call_sites(facts: DataFrame) -> DataFrame:
    """Calls by file and name: how many, on which lines, in which functions."""
    return facts.where("fact = 'call'").groupBy("file_id", "name").agg(
        F.count("*").alias("n_calls"), F.sort_array(F.collect_set("line")).alias("lines"), F.sort_array(F.collect_set("in_function")).alias("functions"),
    )
