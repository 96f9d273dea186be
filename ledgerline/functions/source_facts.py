"""Facts of Python sources, by the standard library's parser; other languages go behind the same function.

Each file gives its branches (ordinary 1.0, guards and cases 0.3), nesting, functions, calls and imports.
A file that doesn't parse gives an error and no facts; the others aren't affected.
"""

from __future__ import annotations

import ast
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.shipping import ship
from ledgerline.sources.tables import spread

ORDINARY, LIGHT = 1.0, 0.3
FACTS = (
    "path string, error string, loc int, branch_count int, weighted_branch_total double, top_level_branch double, nesting_depth int, function_count int, max_func_branch double, "
    "functions array<struct<name: string, line: int, branch: double, calls: array<string>, call_counts: map<string, int>>>, imports array<struct<source: string, level: int>>, "
    "declarations array<struct<id: string, kind: string, is_public: boolean, signature: string, body: string>>, assertions array<int>, tests array<struct<name: string, start: int, end: int>>"
)
_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
_JUMPS = (ast.Return, ast.Raise, ast.Break, ast.Continue)


def _weight(node: ast.AST) -> float | None:
    """The weight of a branch node, or None. A match is ordinary, its cases are light; an if whose body begins with a jump is a guard."""
    if isinstance(node, ast.If):
        return LIGHT if isinstance(node.body[0], _JUMPS) else ORDINARY
    if isinstance(node, ast.Match):
        return ORDINARY
    return LIGHT if isinstance(node, ast.match_case) else None


def _walk(node: ast.AST, depth: int, nested: bool, visit) -> None:
    for child in ast.iter_child_nodes(node):
        w = _weight(child)
        deeper = depth + (w is not None and not isinstance(child, ast.match_case))
        visit(child, w, deeper)
        if nested or not isinstance(child, _FUNCTIONS):
            _walk(child, deeper, nested, visit)


def _name(node: ast.AST) -> str | None:
    return node.id if isinstance(node, ast.Name) else node.attr if isinstance(node, ast.Attribute) else None


def python_facts(source: str) -> dict:
    """The facts of one file, without its path. Raises SyntaxError."""
    tree = ast.parse(source)
    every = list(ast.walk(tree))
    branches: list[float] = []
    deepest = 0

    def count(_: ast.AST, w: float | None, depth: int) -> None:
        nonlocal deepest
        if w is not None:
            branches.append(w)
            deepest = max(deepest, depth)

    _walk(tree, 0, True, count)
    top: list[float] = []
    _walk(tree, 0, False, lambda _, w, __: top.append(w) if w is not None else None)
    functions = []
    for f in (n for n in every if isinstance(n, _FUNCTIONS)):
        own, calls = [0.0], Counter()

        def see(n: ast.AST, w: float | None, _: int, own: list[float] = own, calls: Counter = calls) -> None:
            own[0] += w or 0.0
            if isinstance(n, ast.Call) and (name := _name(n.func)):
                calls[name] += 1

        _walk(f, 0, False, see)
        functions.append({"name": f.name, "line": f.lineno, "branch": round(own[0], 10), "calls": sorted(calls), "call_counts": dict(calls)})
    imports = [{"source": a.name, "level": 0} for n in every if isinstance(n, ast.Import) for a in n.names]
    imports += [{"source": n.module or "", "level": n.level} for n in every if isinstance(n, ast.ImportFrom)]
    declarations = []

    def declare(body: list[ast.stmt], prefix: str, public: bool) -> None:
        for n in body:
            if isinstance(n, (*_FUNCTIONS, ast.ClassDef)):
                own = public and not n.name.startswith("_")
                kind = "class" if isinstance(n, ast.ClassDef) else "function"
                signature = f"({ast.unparse(n.args)})" if kind == "function" else "(" + ", ".join(map(ast.unparse, n.bases)) + ")"
                declarations.append({"id": prefix + n.name, "kind": kind, "is_public": own, "signature": signature, "body": "\n".join(map(ast.unparse, n.body)) if kind == "function" else None})
                if kind == "class":
                    declare(n.body, f"{prefix}{n.name}.", own)
            elif isinstance(n, (ast.Assign, ast.AnnAssign)):
                for t in n.targets if isinstance(n, ast.Assign) else [n.target]:
                    if isinstance(t, ast.Name):
                        declarations.append({"id": prefix + t.id, "kind": "field", "is_public": public and not t.id.startswith("_"), "signature": ast.unparse(n.annotation) if isinstance(n, ast.AnnAssign) else "", "body": None})

    declare(tree.body, "", True)
    asserts = sorted({n.lineno for n in every if isinstance(n, ast.Assert) or (isinstance(n, ast.Call) and (_name(n.func) or "").startswith("assert"))})
    tests = [{"name": n.name, "start": n.lineno, "end": n.end_lineno} for n in every if isinstance(n, _FUNCTIONS) and n.name.startswith("test")]
    return {
        "loc": len(source.splitlines()), "branch_count": len(branches), "weighted_branch_total": round(sum(branches), 10), "top_level_branch": round(sum(top), 10), "nesting_depth": deepest, "function_count": len(functions),
        "max_func_branch": max((f["branch"] for f in functions), default=0.0), "functions": functions, "imports": imports, "declarations": declarations, "assertions": asserts, "tests": tests,
    }


def file_facts(files: DataFrame) -> DataFrame:
    """A row of facts for each Python file (path, content)."""
    ship(files.sparkSession)
    names = [f.split(" ")[0] for f in ("path", "error", "loc", "branch_count", "weighted_branch_total", "top_level_branch", "nesting_depth", "function_count", "max_func_branch", "functions", "imports", "declarations", "assertions", "tests")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows.append({"path": path, "error": None} | python_facts(content or ""))
                except (SyntaxError, ValueError, RecursionError) as e:
                    rows.append(dict.fromkeys(names) | {"path": path, "error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame({n: pd.Series([r[n] for r in rows], dtype=object) for n in names})

    return spread(files.select("path", "content"), "path").mapInPandas(run, FACTS)


def import_candidates(files: DataFrame) -> DataFrame:
    """(importer, source, candidates): for each import of a file of facts the paths to try: from the root, or by dots from the importer's folder."""
    own = files.select(F.col("path").alias("importer"), F.explode("imports").alias("i")).select("importer", F.concat(F.repeat(F.lit("."), F.col("i.level")), F.col("i.source")).alias("source"), "i.level", F.regexp_replace("i.source", r"\.", "/").alias("tail"))
    folder = F.split("importer", "/")
    up = F.slice(folder, F.lit(1), F.greatest(F.size(folder) - F.greatest(F.col("level"), F.lit(1)), F.lit(0)))
    base = F.when(F.col("level") > 0, F.array_join(F.filter(F.concat(up, F.array("tail")), lambda x: x != ""), "/")).otherwise(F.col("tail"))
    return own.withColumn("base", base).select("importer", "source", F.array(F.concat("base", F.lit(".py")), F.concat("base", F.lit("/__init__.py"))).alias("candidates"))


def findings(facts: DataFrame) -> DataFrame:
    """Test cases without an assertion, and with an empty body: (file, test, line, kind)."""
    tests = facts.select("path", "assertions", F.explode("tests").alias("t"))
    has = F.exists("assertions", lambda x: (x >= F.col("t.start")) & (x <= F.col("t.end")))
    return tests.where(~has).select(F.col("path").alias("file"), F.col("t.name").alias("test"), F.col("t.start").alias("line"), F.lit("missing_assertion").alias("kind"))


#: Rules over a declaration's or block's text, by name: what a body without blanks must be.
EMPTY_BODIES = {"go": (r"^\{\}$",), "java": (r"^\{\}$",), "rust": (r"^\{\}$",), "typescript": (r"^\{\}$",), "python": (r"^(pass|\.\.\.|raiseNotImplementedError(\(.*\))?)$",)}


def placeholder_bodies(declarations: DataFrame, language: str, body: str = "body") -> DataFrame:
    """Declarations whose body does nothing yet."""
    bare = F.regexp_replace(F.col(body), r"\s", "")
    out = F.lit(False)
    for pattern in EMPTY_BODIES[language]:
        out = out | bare.rlike(pattern)
    return declarations.where(out)


def async_without_await(declarations: DataFrame, text: str = "text") -> DataFrame:
    return declarations.where(F.col(text).rlike(r"^\s*async\b") & ~F.col(text).rlike(r"\bawait\b"))


def prohibited_imports(before: DataFrame, after: DataFrame, authorities: DataFrame) -> DataFrame:
    """Imports (file, source) that are new, on a protected file (authority, file, prohibited) and prohibited there."""
    added = after.distinct().join(before, ["file", "source"], "left_anti")
    return added.join(authorities.withColumnRenamed("prohibited", "source"), ["file", "source"]).select("authority", "file", "source")


def forbidden_imports(imports: DataFrame, authorities: DataFrame) -> DataFrame:
    """Imports (file, source), new or not, that are prohibited (authority, file, prohibited) where they stand."""
    return imports.distinct().join(authorities.withColumnRenamed("prohibited", "source"), ["file", "source"]).select("authority", "file", "source")


def silent_handlers(handlers: DataFrame, language: str, body: str = "body") -> DataFrame:
    """Error handlers whose body does nothing: empty braces, or a lone pass."""
    own = F.trim(F.regexp_replace(F.col(body), r"\s+", " "))
    return handlers.where(own.isin("pass", "...") if language == "python" else F.regexp_replace(own, " ", "").isin("{}", ""))


def empty_functions(declarations: DataFrame, body: str = "body") -> DataFrame:
    """Functions with empty braces; constructors may have them."""
    return declarations.where((F.regexp_replace(F.col(body), r"\s", "") == "{}") & (F.col("name") != "constructor"))


def project_shapes(literals: DataFrame, prefix: str = "packages/", text: str = "text") -> DataFrame:
    """String literals that name a place in this project's own layout."""
    return literals.where(F.col(text).rlike("^[\"'`]" + prefix))
