"""Python definitions and calls, and what changed between two versions."""

from __future__ import annotations

import ast
import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window, functions as F

from lumenspan.functions.workers import flat_map
from lumenspan.operators import joins
from lumenspan.operators.select import keep_first
from lumenspan.schemas import SIGNATURE

_KEYS = "repo string, ref string, file string"
SYMBOLS = f"{_KEYS}, line int, end_line int, qualified string, signature {SIGNATURE}, body_hash string, parse_error string"
CALLS = f"{_KEYS}, name string, line int, snippet string"


def _source(row: dict) -> tuple[str, ast.Module | None, str | None]:
    text = row["content"] or ""
    try:
        return text, ast.parse(text), None
    except (SyntaxError, ValueError, RecursionError) as error:
        return text, None, str(error)


def _text(text: str, node: ast.AST | None) -> str | None:
    return None if node is None else ast.get_source_segment(text, node)


def _parameters(text: str, args: ast.arguments) -> list[str]:
    plain = [*args.posonlyargs, *args.args]
    defaults = [None] * (len(plain) - len(args.defaults)) + list(args.defaults)
    show = lambda a, d: (_text(text, a) or a.arg) + ("" if d is None else f"={_text(text, d)}")
    out = [show(a, d) for a, d in zip(plain, defaults, strict=True)]
    out[len(args.posonlyargs) : len(args.posonlyargs)] = ["/"] if args.posonlyargs else []
    out += [f"*{_text(text, args.vararg)}"] if args.vararg else ["*"] if args.kwonlyargs else []
    out += [show(a, d) for a, d in zip(args.kwonlyargs, args.kw_defaults, strict=True)]
    return out + ([f"**{_text(text, args.kwarg)}"] if args.kwarg else [])


def definitions(row: dict) -> Iterator[dict]:
    """Functions, methods and classes of one file; a row with ``parse_error`` if it can't be parsed."""
    text, tree, error = _source(row)
    keys = {"repo": row.get("repo"), "ref": row.get("ref"), "file": row["path"]}
    if tree is None:
        yield keys | {"parse_error": error}
        return
    lines = text.split("\n")

    def visit(node: ast.AST, outer: tuple[str, ...], in_class: bool) -> Iterator[dict]:
        for child in ast.iter_child_nodes(node):
            if not isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                yield from visit(child, outer, in_class)
                continue
            is_class = isinstance(child, ast.ClassDef)
            first, last = child.body[0], child.body[-1]
            body = "\n".join(lines[first.lineno - 1 : last.end_lineno])[first.col_offset :] if first.lineno > child.lineno else _text(text, first) or ""
            signature = {
                "name": child.name,
                "kind": "class" if is_class else "method" if in_class else "function",
                "params": [] if is_class else _parameters(text, child.args),
                "return_type": None if is_class else _text(text, child.returns),
                "decorators": [f"@{_text(text, d)}" for d in child.decorator_list],
                "is_async": isinstance(child, ast.AsyncFunctionDef),
                "bases": [_text(text, b) for b in child.bases] if is_class else [],
            }
            yield keys | {
                "line": child.lineno, "end_line": child.end_lineno, "qualified": ".".join((*outer, child.name)),
                "signature": signature, "body_hash": hashlib.sha1(body.encode()).hexdigest(), "parse_error": None,
            }  # noqa: S324
            yield from visit(child, (*outer, child.name), is_class)

    yield from visit(tree, (), False)


def call_sites(row: dict) -> Iterator[dict]:
    """Calls by plain name or attribute, each line and name once."""
    text, tree, _ = _source(row)
    lines, seen = text.split("\n"), set()
    for node in ast.walk(tree) if tree else ():
        if isinstance(node, ast.Call):
            name = node.func.id if isinstance(node.func, ast.Name) else node.func.attr if isinstance(node.func, ast.Attribute) else None
            line = node.func.end_lineno if isinstance(node.func, ast.Attribute) else node.lineno
            if name and (line, name) not in seen:
                seen.add((line, name))
                yield {"repo": row.get("repo"), "ref": row.get("ref"), "file": row["path"], "name": name, "line": line, "snippet": lines[line - 1].strip()[:100]}


def python_symbols(files: DataFrame) -> DataFrame:
    """Definitions of the ``.py`` files of ``(repo, ref, path, content)``."""
    return flat_map(files.where(F.col("path").endswith(".py")).select("repo", "ref", "path", "content"), definitions, SYMBOLS)


def python_calls(files: DataFrame) -> DataFrame:
    return flat_map(files.where(F.col("path").endswith(".py")).select("repo", "ref", "path", "content"), call_sites, CALLS)


def touched_symbols(symbols: DataFrame, cursor: DataFrame) -> DataFrame:
    """Symbols that hold an added line of the same file."""
    lines = cursor.where("change = 'added'").select("file", "new_line")
    hit = joins.touched(symbols.where("parse_error is null").drop("parse_error"), lines, ["file"], "line", "end_line", "new_line")
    return hit.dropDuplicates(["qualified", "file", "line"])


def callers(calls: DataFrame, names: DataFrame) -> DataFrame:
    """Call sites of ``names(name)``, each file and line once, in order."""
    found = calls.join(names.select("name").distinct(), "name", "left_semi")
    return keep_first(found, ["name", "file", "line"], "snippet").select("name", "file", "line", "snippet").orderBy("name", "file", "line")


def symbol_changes(base: DataFrame, head: DataFrame) -> DataFrame:
    """``(file, qualified, kind, old, new)``: added, removed, renamed, sig_changed, body_changed.

    A removed and an added symbol of one file with equal body and kind are a rename, matched in
    the order of lines.
    """
    good = lambda df: df.where("parse_error is null").select("file", "qualified", F.struct("line", "signature", "body_hash").alias("s"))
    once = lambda df: keep_first(good(df), ["file", "qualified"], F.desc("s.line"))
    both = joins.changes(once(base), once(head), ["file", "qualified"], "s").where("change <> 'same'")
    old, new = F.col("old"), F.col("new")
    single = both.where(F.col("change").isin("added", "removed")).withColumn("s", F.coalesce(old, new))
    key = single.select("file", "qualified", "change", "s", F.col("s.body_hash").alias("hash"), F.col("s.signature.kind").alias("of"))
    rank = Window.partitionBy("file", "hash", "of", "change").orderBy("s.line", "qualified")
    ranked = key.withColumn("k", F.row_number().over(rank))
    gone = ranked.where("change = 'removed'").select("file", "hash", "of", "k", F.col("qualified").alias("_gone"), F.col("s").alias("old"))
    come = ranked.where("change = 'added'").select("file", "hash", "of", "k", F.col("qualified").alias("_come"), F.col("s").alias("new"))
    renamed = gone.join(come, ["file", "hash", "of", "k"])
    used = renamed.select("file", F.explode(F.array("_gone", "_come")).alias("qualified"))
    kind = F.when(F.col("change") != "changed", F.col("change")).when(old["signature"] == new["signature"], "body_changed").otherwise("sig_changed")
    moved = F.when(F.col("change") == "changed", (old["signature"] == new["signature"]) & (old["body_hash"] == new["body_hash"])).otherwise(False)
    rest = both.where(~moved).join(used, ["file", "qualified"], "left_anti").select("file", "qualified", kind.alias("kind"), "old", "new")
    return rest.unionByName(renamed.select("file", F.col("_come").alias("qualified"), F.lit("renamed").alias("kind"), "old", "new"))


def risks(old: Column, new: Column) -> Column:
    """What a changed signature may break, as texts."""
    a, b = old["signature"], new["signature"]
    ra, rb = a["return_type"], b["return_type"]
    listed = lambda x, y: F.array_join(F.sort_array(F.array_except(x, y)), ", ")
    more, less = listed(b["decorators"], a["decorators"]), listed(a["decorators"], b["decorators"])
    return F.array_compact(
        F.array(
            F.when(a["is_async"] & ~b["is_async"], "No longer async: callers must not await it.").when(~a["is_async"] & b["is_async"], "Now async: callers must await it."),
            F.when(ra.contains("Optional[") & ~rb.contains("Optional["), "Return type narrowed: checks for None are dead.")
            .when(ra != rb, F.concat(F.lit("Return type changed: "), ra, F.lit(" -> "), rb))
            .when(ra.isNotNull() & rb.isNull(), F.concat(F.lit("Return type removed: "), ra))
            .when(ra.isNull() & rb.isNotNull(), F.concat(F.lit("Return type added: "), rb)),
            F.when(F.size(a["params"]) < F.size(b["params"]), "Parameter added.").when(F.size(a["params"]) > F.size(b["params"]), "Parameter removed."),
            F.when(more != "", F.concat(F.lit("Decorators added: "), more)),
            F.when(less != "", F.concat(F.lit("Decorators removed: "), less)),
        )
    )


def names_changed(changes: DataFrame) -> DataFrame:
    """Old and new names of all changes, each once."""
    return changes.select(F.explode(F.array_compact(F.array("old.signature.name", "new.signature.name"))).alias("name")).distinct().orderBy("name")
