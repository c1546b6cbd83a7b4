"""File sources: project scans with ignore rules, diaries, mega-file splits, chunking."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Defaults of a project scan; fixed values.
EXTENSIONS = ("txt", "md", "rst", "py", "js", "ts", "tsx", "jsx", "rs", "go", "java", "c", "h", "cpp", "cs", "rb", "php", "sh", "sql", "json", "yaml", "yml", "toml", "html", "css")
SKIP_DIRS = (".git", "node_modules", "target", "dist", "build", "__pycache__", ".venv", "venv", ".idea", ".vscode")
SKIP_FILES = ("package-lock.json", "yarn.lock", "Cargo.lock", "poetry.lock", ".DS_Store")
MOST_BYTES = 10 << 20
MANIFESTS = ("package.json", "Cargo.toml", "pyproject.toml", "go.mod")


def ignore_pattern(rule: str) -> tuple[str, bool] | None:
    """An ignore rule as a regular expression on relative paths, and whether it lets in again what earlier rules left out."""
    rule = rule.rstrip()
    if not rule or rule.startswith("#"):
        return None
    negated, rule = rule.startswith("!"), rule.lstrip("!")
    folder, anchored = rule.endswith("/"), "/" in rule.rstrip("/")
    rule = rule.strip("/")
    out, k = "", 0
    while k < len(rule):
        if rule.startswith("**/", k):
            out, k = out + "(?:.*/)?", k + 3
        elif rule.startswith("**", k):
            out, k = out + ".*", k + 2
        elif rule[k] == "*":
            out, k = out + "[^/]*", k + 1
        elif rule[k] == "?":
            out, k = out + "[^/]", k + 1
        else:
            out, k = out + re.escape(rule[k]), k + 1
    return ("^" if anchored else "(?:^|.*/)") + out + ("/.*$" if folder else "(?:/.*)?$"), negated


def ignored(path, rules: Sequence[str]):
    """Column: is the relative path ignored? The last rule that matches decides."""
    out = F.lit(False)
    for parsed in map(ignore_pattern, rules):
        if parsed:
            pattern, negated = parsed
            out = F.when(path.rlike(pattern), F.lit(not negated)).otherwise(out)
    return out


def scan_project(spark: SparkSession, root: str, rules: Sequence[str] = (), extensions: Sequence[str] = EXTENSIONS) -> DataFrame:
    """(path, relative, length, modified, content) of text files that no rule leaves out. Names are filtered before contents are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = re.sub(r"^[a-z]+:/*", "/", root).rstrip("/") + "/"
    relative = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*", "/"), f"^{re.escape(base)}", "")
    kept = files.withColumn("relative", relative).where(F.col("length") <= MOST_BYTES)
    kept = kept.where(F.lower(F.regexp_extract("relative", r"\.([^./]+)$", 1)).isin(*extensions))
    kept = kept.where(~F.regexp_extract("relative", r"([^/]+)$", 1).isin(*SKIP_FILES) & ~F.col("relative").rlike(r"(^|/)(" + "|".join(map(re.escape, SKIP_DIRS)) + r")/"))
    return kept.where(~ignored(F.col("relative"), rules)).select("path", "relative", "length", F.col("modificationTime").alias("modified"), F.col("content").cast("string").alias("content"))


def chunk_text(text: str, size: int = 800, overlap: int = 100, least: int = 50) -> list[str]:
    """Windows of ``size`` bytes that prefer to end at a blank line, then at a line end, past their middle; whole characters."""
    raw, out, start = text.encode(), [], 0
    while start < len(raw):
        end = min(start + size, len(raw))
        if end < len(raw):
            for mark in (b"\n\n", b"\n"):
                at = raw.rfind(mark, start + size // 2, end)
                if at > start:
                    end = at
                    break
        while end < len(raw) and raw[end] & 0xC0 == 0x80:
            end -= 1
        piece = raw[start:end].decode("utf-8", "ignore").strip()
        if len(piece.encode()) >= least:
            out.append(piece)
        if end >= len(raw):
            break
        start = max(end - overlap, start + 1)
        while raw[start] & 0xC0 == 0x80:
            start += 1
    return out


def chunks(rows: DataFrame, id_: str = "id", content: str = "content", most: int = 50_000) -> DataFrame:
    """(id, chunk_index, chunk); a text with more than ``most`` chunks is left out whole (0: no limit). Cut points depend on the cut before, hence Python."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(i, k, c) for i, t in zip(batch[id_], batch[content], strict=True) if t for cs in [chunk_text(t)] if not most or len(cs) <= most for k, c in enumerate(cs)]
            yield pd.DataFrame(found, columns=["id", "chunk_index", "chunk"])

    kind = dict(rows.dtypes)[id_]
    return rows.select(id_, content).mapInPandas(run, f"id {kind}, chunk_index int, chunk string")


def split_sessions(rows: DataFrame, header: str = r"^(=== )?Session (started|start)\b", restore: str = r"context restored") -> DataFrame:
    """(id, session, text): a concatenated transcript cut at session headers that are not restores; what precedes the first is a session. The lines of one file are one row's array."""
    lines = F.split("content", "\n")
    places = F.sequence(F.lit(0), F.size(lines) - 1)
    starts = F.filter(places, lambda k: (k == 0) | (F.get(lines, k).rlike(header) & ~F.get(lines, k).rlike(restore)))
    part = lambda k, n: F.array_join(F.slice(lines, k + 1, F.coalesce(F.get(starts, n + 1), F.size(lines)) - k), "\n")
    return rows.select("id", F.posexplode(F.transform(starts, part)).alias("session", "text"))


def projects(files: DataFrame) -> DataFrame:
    """(folder, project, manifest): names that package manifests state; ``files`` is (path, content). Of several manifests in a folder the first in order of MANIFESTS counts."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    module = F.regexp_extract(F.regexp_extract("content", r"(?m)^module\s+(\S+)", 1), r"([^/]+)$", 1)
    stated = (
        F.when(name == "package.json", F.get_json_object("content", "$.name"))
        .when(name == "Cargo.toml", F.regexp_extract("content", r"(?sm)^\[package\][^\[]*?^\s*name\s*=\s*[\"']([^\"']+)", 1))
        .when(name == "pyproject.toml", F.regexp_extract("content", r"(?sm)^\[(?:project|tool\.poetry)\][^\[]*?^\s*name\s*=\s*[\"']([^\"']+)", 1))
        .when(name == "go.mod", module)
    )
    rank = F.array_position(F.array(*map(F.lit, MANIFESTS)), name)
    found = files.select(F.regexp_extract("path", r"^(.*?)/?[^/]+$", 1).alias("folder"), stated.alias("project"), name.alias("manifest"), rank.alias("rank")).where("coalesce(project, '') <> ''")
    return found.groupBy("folder").agg(F.min_by(F.struct("project", "manifest"), "rank").alias("m")).select("folder", "m.project", "m.manifest")


def diaries(files: DataFrame, seen: DataFrame, least: int = 50) -> DataFrame:
    """Diary days that are new or changed: (path, date, content, hash) without those in ``seen`` (path, hash)."""
    d = files.where(F.col("path").endswith(".md") & (F.octet_length("content") >= least))
    d = d.select("path", F.substring(F.regexp_extract("path", r"([^/]+)\.md$", 1), 1, 10).alias("date"), "content", F.sha2("content", 256).alias("hash"))
    return d.where(F.try_to_timestamp("date", F.lit("yyyy-MM-dd")).isNotNull()).join(seen, ["path", "hash"], "left_anti")
