"""Files as rows: path, name, suffix, size, content; readers, decoding, and which files each scanner takes."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Suffixes, directory names and file names that scanners leave out or take.
SKIPPED_SUFFIXES = (".pyc", ".pyo", ".pyd", ".so", ".dll", ".exe", ".bin", ".jpg", ".jpeg", ".png", ".gif", ".bmp", ".ico", ".svg", ".pdf", ".zip", ".tar", ".gz", ".rar", ".7z", ".mp3", ".mp4", ".avi", ".mov", ".wmv", ".flv", ".woff", ".woff2", ".ttf", ".eot", ".otf")
SKIPPED_DIRECTORIES = ("__pycache__", ".git", ".svn", ".hg", ".bzr", "node_modules", ".venv", "venv", "env", ".env", "build", "dist", ".pytest_cache", ".tox", ".coverage", ".mypy_cache", ".DS_Store", "Thumbs.db")
LLM_SUFFIXES = (".py", ".js", ".ts", ".tsx", ".jsx", ".ipynb", ".yaml", ".yml", ".json", ".env", ".toml", ".cfg", ".ini")
DEVSECOPS_SUFFIXES = (".tf", ".tfvars", ".yaml", ".yml", ".sh", ".dockerfile")
DEVSECOPS_NAMES = ("Dockerfile", "docker-compose.yml", "docker-compose.yaml")
ENTROPY_SKIPPED_SUFFIXES = (".min.js", ".min.css", ".html", ".htm", ".svg", ".lock", ".sum", ".mod", ".pyc", ".pyo")
SIZE_LIMIT = 10 * 1024 * 1024


def suffix_of(name: Column) -> Column:
    """The last suffix as pathlib has it, lower-cased: none for a name that begins with its only dot."""
    return F.lower(F.regexp_extract(name, r"^.+(\.[^.]+)$", 1))


def with_names(files: DataFrame) -> DataFrame:
    """files (path, size, content) -> (path, name, suffix, size, content)."""
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", name.alias("name"), suffix_of(name).alias("suffix"), "size", "content")


def decoded(raw: Column) -> Column:
    """UTF-8, or Latin-1 where it isn't valid; all line ends as \\n."""
    text = F.coalesce(F.try_validate_utf8(raw.cast("string")), F.decode(raw, "ISO-8859-1"))
    return F.regexp_replace(text, "\r\n?", "\n")


def read_tree(spark: SparkSession, root: str, prune: bool = True, relative: bool = True) -> DataFrame:
    """All files below a directory, or one file; paths relative to it. Larger files aren't read, pruned directories' are left out."""
    found = os.path.exists(root) if "://" not in root else True
    if not found:
        raise FileNotFoundError(f"Directory not found: {root}")
    single = "://" not in root and os.path.isfile(root)
    top = root if "://" in root else "file:" + os.path.abspath(root)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(top).where(F.col("length") <= SIZE_LIMIT)
    inner = F.regexp_replace(F.col("path"), "^file:/+", "/").substr(F.lit(len(os.path.abspath(root).rstrip("/")) + 2), F.length("path"))
    if "://" in root:
        inner = F.col("path").substr(F.lit(len(root.rstrip("/")) + 2), F.length("path"))
    path = F.lit(root) if single else inner if relative else F.concat(F.lit(root.rstrip("/") + "/"), inner)
    files = with_names(raw.select(path.alias("path"), F.col("length").alias("size"), decoded(F.col("content")).alias("content")))
    if not prune or single:
        return files
    return files.where(not_pruned(F.col("path")) if relative else not_pruned(F.col("path").substr(F.lit(len(root.rstrip("/")) + 2), F.length("path"))))


def not_pruned(path: Column) -> Column:
    """No directory of a relative path is one of those that a walk leaves out; the file's own name doesn't count."""
    parts = F.split(path, "/")
    return ~F.exists(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda d: d.isin(*SKIPPED_DIRECTORIES))


def takes_secrets() -> Column:
    return ~F.col("suffix").isin(*SKIPPED_SUFFIXES) & (F.col("size") <= SIZE_LIMIT)


def takes_llm() -> Column:
    return (F.col("suffix").isin(*LLM_SUFFIXES) | (F.col("name") == ".env")) & takes_secrets()


def takes_devsecops(directory: bool = True) -> Column:
    """In a directory by name or suffix; a file that is asked for itself only by size."""
    known = F.col("name").isin(*DEVSECOPS_NAMES) | F.col("suffix").isin(*DEVSECOPS_SUFFIXES) if directory else F.lit(True)
    return known & (F.col("size") <= SIZE_LIMIT)


def takes_entropy() -> Column:
    return ~F.col("suffix").isin(*ENTROPY_SKIPPED_SUFFIXES) & ~F.lower("name").contains(".min.") & (F.col("size") <= SIZE_LIMIT)


def notebook_text(content: Column) -> Column:
    """The cells' sources of a notebook, by lines; the raw text where it isn't JSON. Lists of strings are joined, other kinds left out."""
    cells = F.from_json(content, "cells ARRAY<STRUCT<source: STRING>>")["cells"]
    lists = F.from_json(F.get_json_object(content, "$"), "cells ARRAY<STRUCT<source: ARRAY<STRING>>>")["cells"]
    joined = F.transform(F.arrays_zip(cells.alias("one"), lists.alias("many")), lambda c: F.coalesce(F.array_join(c["many"]["source"], ""), c["one"]["source"]))
    text = F.array_join(F.filter(joined, lambda s: s.isNotNull()), "\n")
    return F.when(F.try_parse_json(content).isNull(), content).otherwise(F.coalesce(text, F.lit("")))
