"""Manifests and lock files of package managers to (file, name, version) rows. Parsing is a driver-size matter per file,
so it runs in Arrow batches over a table of files."""

from __future__ import annotations

import json
import re
import tomllib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "path string, name string, version string, kind string"
REQUIREMENT = re.compile(r"^\s*([A-Za-z0-9][A-Za-z0-9._-]*)(?:\[[^\]]*\])?\s*([^;#]*)")


def requirement(line: str) -> tuple[str, str] | None:
    m = REQUIREMENT.match(line)
    return (m[1], m[2].strip() or "*") if m and not line.lstrip().startswith(("#", "-")) else None


def _toml_version(spec) -> str:
    return str(spec.get("version", "*")) if isinstance(spec, dict) else str(spec)


def _at(spec: str) -> tuple[str, str]:
    """Name and version of name@version; a scope's @ belongs to the name."""
    name, _, version = spec.rpartition("@")
    return (name, version) if name else (spec, "")


def parse(path: str, content: str) -> list[tuple[str, str, str]]:
    """(name, version, manifest or lock) of a file, by its name; unknown or broken files give nothing."""
    file = path.rpartition("/")[2]
    try:
        if file == "package.json" or file == "composer.json":
            data, keys = json.loads(content), ("dependencies", "devDependencies", "peerDependencies", "require", "require-dev")
            return [(n, str(v), "manifest") for k in keys for n, v in (data.get(k) or {}).items()]
        if file == "package-lock.json":
            return [(p.rpartition("node_modules/")[2], v.get("version", ""), "lock") for p, v in json.loads(content).get("packages", {}).items() if p]
        if file == "deno.json":
            specs = [re.match(r"(?:npm|jsr):(@?[^@]+)@?(.*)", v) for v in json.loads(content).get("imports", {}).values()]
            return [(m[1], m[2] or "*", "manifest") for m in specs if m]
        if file == "pyproject.toml":
            data = tomllib.loads(content)
            rows = [requirement(x) for x in data.get("project", {}).get("dependencies", [])]
            return [(*r, "manifest") for r in rows if r] + [(n, _toml_version(v), "manifest") for n, v in data.get("tool", {}).get("poetry", {}).get("dependencies", {}).items() if n != "python"]
        if file == "bun.lock":
            bare = re.sub(r",(\s*[}\]])", r"\1", content)
            return [(_at(v[0])[0], _at(v[0])[1], "lock") for v in json.loads(bare).get("packages", {}).values() if v]
        if file == "pnpm-lock.yaml":
            return [(m[1], m[2], "lock") for m in re.finditer(r"^  ['\"]?/?(@?[^@\s'\"(]+)@([^\s:'\"(]+)[^\n]*:\s*$", content, re.M)]
        if file == "Pipfile.lock":
            data = json.loads(content)
            return [(n, str(v.get("version", "")).removeprefix("=="), "lock") for k in ("default", "develop") for n, v in data.get(k, {}).items()]
        if file == "go.sum":
            return [(m[1], m[2], "lock") for m in re.finditer(r"^(\S+) (v[^\s/]+) h1:", content, re.M)]
        if file == "Gemfile.lock":
            return [(m[1], m[2], "lock") for m in re.finditer(r"^    ([\w.-]+) \(([^)]+)\)$", content, re.M)]
        if file == "composer.lock":
            data = json.loads(content)
            return [(p["name"], p.get("version", ""), "lock") for k in ("packages", "packages-dev") for p in data.get(k, [])]
        if file == "deno.lock":
            data = json.loads(content)
            return [(*_at(x), "lock") for k in ("npm", "jsr") for x in (data.get(k) or data.get("packages", {}).get(k) or {})]
        if file in ("uv.lock", "poetry.lock", "Cargo.lock"):
            return [(p["name"], p.get("version", ""), "lock") for p in tomllib.loads(content).get("package", [])]
        if file == "Cargo.toml":
            data = tomllib.loads(content)
            return [(n, _toml_version(v), "manifest") for k in ("dependencies", "dev-dependencies") for n, v in data.get(k, {}).items()]
        if file == "Pipfile":
            data = tomllib.loads(content)
            return [(n, _toml_version(v), "manifest") for k in ("packages", "dev-packages") for n, v in data.get(k, {}).items()]
        if re.fullmatch(r"requirements.*\.txt", file):
            return [(*r, "manifest") for line in content.splitlines() if (r := requirement(line))]
        if file == "go.mod":
            return [(m[1], m[2], "manifest") for m in re.finditer(r"^\s*(?:require\s+)?([\w./-]+\.[\w./-]+)\s+(v\S+)", content, re.M)]
        if file == "Gemfile":
            return [(m[1], m[2] or "*", "manifest") for m in re.finditer(r"""^\s*gem\s+["']([^"']+)["'](?:\s*,\s*["']([^"']+)["'])?""", content, re.M)]
        if file == "yarn.lock":
            return [(m[1], m[2], "lock") for m in re.finditer(r'^"?(@?[^@"\n]+)@[^\n]*:\n\s+version:? "?([^"\n]+)"?', content, re.M)]
    except (ValueError, AttributeError, KeyError, TypeError):
        return []
    return []


def dependencies(files: DataFrame) -> DataFrame:
    """path, name, version, kind of all files (path, content)."""

    def scan(frames):
        for f in frames:
            yield pd.DataFrame([(p, *r) for p, c in zip(f["path"], f["content"], strict=True) for r in parse(p, c or "")], columns=["path", "name", "version", "kind"])

    return files.select("path", "content").mapInPandas(scan, SCHEMA)


# Lock files in the order in which the first that can be read counts.
LOCK_ORDER = ["bun.lock", "bun.lockb", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "deno.lock", "uv.lock", "poetry.lock", "Pipfile.lock", "Cargo.lock", "go.sum", "Gemfile.lock", "composer.lock"]


def resolved(files: DataFrame) -> DataFrame:
    """root, lock, lock_hash (16 hex digits of sha256), name, version: of each folder the first lock file of LOCK_ORDER that
    can be read. files (path, content); other files are ignored."""
    order = F.array_position(F.array(*[F.lit(x) for x in LOCK_ORDER]), F.substring_index("path", "/", -1))
    locks = files.where(order > 0).select("path", "content")
    found = dependencies(locks).where("kind = 'lock'")
    place = found.select("path", "name", "version", F.regexp_replace("path", "/?[^/]*$", "").alias("root"), F.substring_index("path", "/", -1).alias("lock"), order.alias("_order"))
    best = place.groupBy(F.col("root").alias("_root")).agg(F.min("_order").alias("_best"))
    first = place.join(best, (F.col("root") == F.col("_root")) & (F.col("_order") == F.col("_best")))
    hashes = locks.select("path", F.substring(F.sha2(F.col("content").cast("binary"), 256), 1, 16).alias("lock_hash"))
    return first.join(hashes, "path").select("root", "lock", "lock_hash", "name", "version")
