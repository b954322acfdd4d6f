"""Symbol index over files of several languages."""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, functions as F

from lumenspan.functions.workers import flat_map, line_starts
from lumenspan.operators.select import keep_first, top_n
from lumenspan.schemas import LIMITS, SYMBOL_INDEX

# Patterns of references in SQL, templates and scripts.
SQL_DEFINITION = re.compile(r"\bCREATE\s+(?:OR\s+REPLACE\s+)?(?:TABLE|VIEW)\s+(?:IF\s+NOT\s+EXISTS\s+)?([\w.]+)", re.I)
SQL_REFERENCE = re.compile(r"\b(?:FROM|JOIN|INTO|UPDATE)\s+([\w.]+)", re.I)
TEMPLATE = re.compile(r"\{\{[^}]*\}\}|\{%[^%]*%\}")
MODEL_REFERENCE = re.compile(r"\{\{\s*ref\(\s*['\"]([^'\"]+)['\"]\s*\)\s*\}\}")
MODEL_SOURCE = re.compile(r"\{\{\s*source\(\s*['\"]([^'\"]+)['\"]\s*,\s*['\"]([^'\"]+)['\"]\s*\)\s*\}\}")
SCRIPT_SKIP = re.compile(r"//[^\n]*|/\*.*?\*/|'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\"|`(?:\\.|[^`\\])*`", re.S)
SCRIPT_DEFINITION = re.compile(r"\b(?:function\s*\*?|class)\s+([A-Za-z_$][\w$]*)")
SCRIPT_VALUE = re.compile(r"\b(?:const|let)\s+([A-Za-z_$][\w$]*)\s*(?::[^=;]+)?=")
SCRIPT_CALL = re.compile(r"(?<![.\w$])([A-Za-z_$][\w$]*)\s*\(")
SCRIPT_IMPORT = re.compile(r"\bimport\s+(?:type\s+)?(?:([A-Za-z_$][\w$]*)\s*,?\s*)?(?:\{([^}]*)\})?\s*from\b")
SCRIPT_WORDS = frozenset(("if", "for", "while", "switch", "catch", "function", "return", "typeof", "await", "super", "import", "new", "class", "constructor"))


def _blank(pattern: re.Pattern, text: str) -> str:
    return pattern.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def python_names(text: str) -> Iterator[tuple[str, int, str]]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return
    for node in ast.walk(tree):
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            yield node.name, node.lineno, "py.def"
        elif isinstance(node, ast.Call) and isinstance(node.func, ast.Name | ast.Attribute):
            name = node.func.id if isinstance(node.func, ast.Name) else node.func.attr
            yield name, node.func.end_lineno, "py.call"
        elif isinstance(node, ast.ImportFrom):
            for alias in node.names:
                if alias.name != "*":
                    yield alias.name, alias.lineno, "py.import"


def _found(text: str, pattern: re.Pattern, kind: str, upper: bool = False) -> Iterator[tuple[str, int, str]]:
    starts = line_starts(text)
    for m in pattern.finditer(text):
        yield m[1].upper() if upper else m[1], bisect_right(starts, m.start()), kind


def sql_names(text: str) -> Iterator[tuple[str, int, str]]:
    """Tables that SQL defines or refers to, in upper case; templates are blanked, lines kept."""
    plain = _blank(TEMPLATE, text)
    yield from _found(plain, SQL_DEFINITION, "sql.table_def", upper=True)
    yield from _found(plain, SQL_REFERENCE, "sql.table_ref", upper=True)


def model_names(text: str) -> Iterator[tuple[str, int, str]]:
    yield from _found(text, MODEL_REFERENCE, "dbt.ref")
    starts = line_starts(text)
    for m in MODEL_SOURCE.finditer(text):
        for name in (m[2], f"{m[1]}.{m[2]}"):
            yield name, bisect_right(starts, m.start()), "dbt.source"


def model_yaml_names(text: str) -> Iterator[tuple[str, int, str]]:
    """Models, and tables of sources, that a YAML file describes; ``name`` keys are told by indentation."""
    section, source, inner, levels = "", "", "", {}
    for n, line in enumerate(text.split("\n"), 1):
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        indent = len(line) - len(line.lstrip(" "))
        body = line.strip()
        if indent == 0 and not body.startswith("-"):
            section, source, inner, levels = body.rstrip(":").strip(), "", "", {}
            continue
        key = re.match(r"(-\s*)?([\w.-]+)\s*:\s*['\"]?([^'\"#]*)['\"]?", body)
        if not key:
            continue
        at = indent + len(key[1] or "")
        levels = {k: v for k, v in levels.items() if k < at}
        inner = next((v for k, v in sorted(levels.items(), reverse=True)), "")
        name, value = key[2], key[3].strip()
        if not value:
            levels[at] = name
        elif name == "name" and section == "models" and inner == "":
            yield value, n, "dbt.model_def"
        elif name == "name" and section == "sources" and inner == "":
            source = value
        elif name == "name" and section == "sources" and inner == "tables":
            yield value, n, "dbt.source"
            if source:
                yield f"{source}.{value}", n, "dbt.source"


def script_names(text: str) -> Iterator[tuple[str, int, str]]:
    """Definitions, calls and imports of JavaScript or TypeScript by a scan of its words.

    There is no parser here: strings and comments are blanked, values count up to one brace deep.
    """
    imports = re.sub(r"//[^\n]*", "", text)
    starts = line_starts(imports)
    for m in SCRIPT_IMPORT.finditer(imports):
        names = [m[1]] if m[1] else []
        names += [x.split(" as ")[0].strip().removeprefix("type ").strip() for x in (m[2] or "").split(",")]
        for name in filter(None, names):
            yield name, bisect_right(starts, m.start()), "js.import"
    plain = _blank(SCRIPT_SKIP, text)
    yield from _found(plain, SCRIPT_DEFINITION, "js.def")
    starts, depth, at = line_starts(plain), 0, 0
    for m in SCRIPT_VALUE.finditer(plain):
        depth += plain.count("{", at, m.start()) - plain.count("}", at, m.start())
        at = m.start()
        if depth <= 0:
            yield m[1], bisect_right(starts, m.start(1)), "js.def"
    for m in SCRIPT_CALL.finditer(plain):
        if m[1] not in SCRIPT_WORDS and not re.search(r"\b(function|class)\s*\*?\s*$", plain[max(0, m.start() - 12) : m.start()]):
            yield m[1], bisect_right(starts, m.start()), "js.call"


def extractor(path: str) -> Callable[[str], Iterator[tuple[str, int, str]]] | None:
    """What reads a file, by its ending and folders; None for files that aren't indexed."""
    low, folders = path.lower(), set(path.replace("\\", "/").split("/")[:-1])
    if low.endswith(".py"):
        return python_names
    if low.endswith(".sql"):
        return model_names if "models" in folders else sql_names
    if low.endswith((".yml", ".yaml")):
        return model_yaml_names if folders & {"models", "sources"} else None
    return script_names if low.endswith((".js", ".jsx", ".ts", ".tsx")) else None


def _names(row: dict) -> Iterator[dict]:
    read, text = extractor(row["path"]), row["content"] or ""
    lines = text.split("\n")
    for name, line, kind in read(text) if read else ():
        yield {"repo": row["repo"], "name": name, "file": row["path"], "line": line, "kind": kind, "snippet": lines[line - 1].strip()[: LIMITS.snippet_chars]}


def build(files: DataFrame, n_files: int | None = LIMITS.index_files, matches: int = LIMITS.index_matches, size: int = LIMITS.index_file_bytes) -> DataFrame:
    """The index of ``(repo, ord, path, content)``: each place once, ``matches`` places of a name.

    Files are picked before their contents are read: not in skipped folders, of a kind that is
    indexed, not over ``size`` bytes, the first ``n_files`` of each repository (all of them if None).
    """
    kinds = F.lower("path").rlike(r"\.(py|sql|ya?ml|jsx?|tsx?)$") & ~F.col("path").rlike(r"(^|/)(node_modules|vendor|\.git|__pycache__|dist|build|\.venv|venv)/")
    read = files.where(kinds & (F.octet_length("content") <= size))
    if n_files is not None:
        picked = top_n(read.select("repo", "ord", "path"), ["repo"], n_files, "ord", "path")
        read = files.select("repo", "ord", "path", "content").join(picked, ["repo", "ord", "path"], "left_semi")
    places = keep_first(flat_map(read.select("repo", "path", "content"), _names, SYMBOL_INDEX), ["repo", "name", "file", "line", "kind"], "snippet")
    return top_n(places, ["repo", "name"], matches, "file", "line", "kind")


def search(index: DataFrame, names: DataFrame, shown: int = LIMITS.shown_matches) -> DataFrame:
    """``(repo, name, total, matches)`` of wanted names, the first places listed."""
    found = index.join(names.select("name").distinct(), "name", "left_semi")
    first = top_n(found, ["repo", "name"], shown, "file", "line", "kind")
    listed = F.array_sort(F.collect_list(F.struct("file", "line", "kind", "snippet"))).alias("matches")
    return found.groupBy("repo", "name").agg(F.count("*").alias("total")).join(first.groupBy("repo", "name").agg(listed), ["repo", "name"])


def definitions(index: DataFrame) -> DataFrame:
    """Names that the index knows as defined."""
    return index.where(F.col("kind").isin("py.def", "js.def", "sql.table_def", "dbt.model_def")).select("repo", "name").distinct()


def candidate_files(index: DataFrame, names: DataFrame, known: DataFrame, n: int) -> DataFrame:
    """Up to ``n`` files of each repository that use the names and aren't ``known(repo, file)``."""
    used = index.join(names, "name", "left_semi").select("repo", "file").distinct()
    return top_n(used.join(known, ["repo", "file"], "left_anti"), ["repo"], n, "file")
