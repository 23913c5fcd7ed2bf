"""Source files to metadata: symbols, components and comments of Python, TypeScript/JavaScript and Rust files."""

from __future__ import annotations

import ast
import os
import re
import subprocess
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Larger files are listed without symbols.
LARGEST = 500_000
# Folders that no source list enters.
IGNORED = (
    "node_modules", ".git", "__pycache__", ".venv", "venv", ".tox", ".nox", ".mypy_cache", ".pytest_cache", ".ruff_cache",
    "target", "dist", "build", ".next", ".nuxt", ".output", "coverage", ".coverage", ".cache", "vendor",
)
SYMBOLS = "path string, name string, kind string, line_start int, line_end int, doc string"


def tracked_files(root: str, extensions: tuple[str, ...] = ()) -> list[str] | None:
    """Paths under root that git tracks, and those that it neither tracks nor ignores, without IGNORED folders; None where
    root is in no work tree. Hand them to spark.read as paths."""
    listed = subprocess.run(["git", "-C", root, "ls-files", "-z", "--cached", "--others", "--exclude-standard"], capture_output=True, check=False)
    if listed.returncode:
        return None
    paths = sorted({p for p in listed.stdout.decode("utf-8", "surrogateescape").split("\0") if p})
    fits = lambda p: not extensions or p.endswith(tuple(extensions))
    return [os.path.join(root, p) for p in paths if fits(p) and not set(p.split("/")) & set(IGNORED) and os.path.exists(os.path.join(root, p))]


def ignored(path: Column) -> Column:
    """True where a component of a path is an ignored folder."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, IGNORED)))


def read_tree(spark: SparkSession, root: str, extensions: list[str], exclude: tuple[str, ...] = ()) -> DataFrame:
    """path, mtime, size, content of the files below root with one of the extensions; invalid bytes are replaced."""
    glob = "*.{" + ",".join(extensions) + "}"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    files = raw.select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), F.decode("content", "UTF-8").alias("content")).where(~ignored(F.col("path")))
    return reduce(lambda df, x: df.where(~F.contains("path", F.lit(x))), exclude, files)


def stale(found: DataFrame, known: DataFrame) -> DataFrame:
    """Files that are new, newer or of another size than the known ones (path, mtime, size)."""
    old = known.select(F.col("path").alias("_p"), F.col("mtime").alias("_m"), F.col("size").alias("_s"))
    return found.join(old, F.col("path") == F.col("_p"), "left").where("_p is null or mtime > _m or size <> _s").drop("_p", "_m", "_s")


def python_symbols(content: str) -> list[tuple]:
    """Top-level classes, public functions and constants, with lines and the first line of the docstring."""
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    out = []
    for node in tree.body:
        if isinstance(node, ast.ClassDef):
            kind, name = "class", node.name
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)) and not node.name.startswith("_"):
            kind, name = "async function" if isinstance(node, ast.AsyncFunctionDef) else "function", node.name
        elif isinstance(node, ast.Assign):
            out += [(t.id, "const", node.lineno, node.end_lineno, None) for t in node.targets if isinstance(t, ast.Name) and not t.id.startswith("_")]
            continue
        else:
            continue
        doc = ast.get_docstring(node)
        out.append((name, kind, node.lineno, node.end_lineno, doc.strip().split("\n")[0] if doc else None))
    return out


def python_components(content: str) -> list[str]:
    """Classes that render, can be called or have a forward pass."""
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    return [c.name for c in tree.body if isinstance(c, ast.ClassDef) and any(isinstance(m, ast.FunctionDef) and m.name in ("render", "__call__", "forward") for m in c.body)]


SCRIPT = re.compile(r"^export\s+(?:default\s+)?(?:async\s+)?(function|class|const|let|var|interface|type|enum)\s+\*?\s*([A-Za-z_$][\w$]*)")
RUST = re.compile(r"^\s*pub(?:\([^)]*\))?\s+(?:async\s+|unsafe\s+)*(struct|enum|fn|trait|type|const|static)\s+(\w+)")


def _block_end(lines: list[str], at: int) -> int:
    """Line where the braces that open on or after a line are closed; the line itself without braces."""
    depth, opened = 0, False
    for i in range(at, len(lines)):
        for c in lines[i]:
            if c == "{":
                depth, opened = depth + 1, True
            elif c == "}":
                depth -= 1
        if opened and depth <= 0:
            return i + 1
        if not opened and lines[i].rstrip().endswith(";"):
            return i + 1
    return at + 1 if not opened else len(lines)


def braced_symbols(content: str, pattern: re.Pattern) -> list[tuple]:
    lines = content.split("\n")
    return [(m[2], m[1], i + 1, _block_end(lines, i), None) for i, line in enumerate(lines) if (m := pattern.match(line))]


def symbols_of(path: str, content: str) -> list[tuple]:
    ext = path.rpartition(".")[2]
    if content is None or len(content) > LARGEST:
        return []
    if ext in ("py", "pyi"):
        return python_symbols(content)
    if ext in ("ts", "tsx", "js", "jsx", "mjs", "cjs"):
        return braced_symbols(content, SCRIPT)
    return braced_symbols(content, RUST) if ext == "rs" else []


def scan_symbols(files: DataFrame) -> DataFrame:
    """path, name, kind, line_start, line_end, doc of all files (path, content), file by file in Arrow batches."""

    def scan(frames):
        for f in frames:
            rows = [(p, *s) for p, c in zip(f["path"], f["content"], strict=True) for s in symbols_of(p, c)]
            yield pd.DataFrame(rows, columns=["path", "name", "kind", "line_start", "line_end", "doc"])

    return files.select("path", "content").mapInPandas(scan, SYMBOLS)


def embedding_text(path: Column, exports: Column, comments: Column) -> Column:
    """What stands for a file in an embedding: its path, stem, exports and comments."""
    stem = F.regexp_replace(F.substring_index(path, "/", -1), r"(.)\.[^.]*$", "$1")
    return F.concat_ws(" ", path, stem, F.array_join(exports, " "), F.array_join(comments, " "))
