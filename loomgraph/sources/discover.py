"""Which files of a source tree are read: globs, exclusion rules, and the scan."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .extract import EXTENSIONS

#: Folders that are never read (fixed values; the last is this package's own).
IGNORED_DIRS = (
    "node_modules", ".expo", "android", "ios", "assets", ".git", "__tests__", "__mocks__", "__snapshots__", "dist", "build", ".cache", ".next", "coverage", ".vscode", ".idea", ".loomgraph",
)
MAX_FILE_SIZE = 1_000_000
IGNORE_FILE, CONFIG_FILE, TRACES_FILE = ".graphignore", "graph.config.json", "graph.traces.json"


def glob_regex(pattern: str, loose: bool = False) -> str:
    """A case-insensitive regular expression for a gitignore-like glob over paths relative to the root.

    ** stands for anything, * and ? for what a segment may hold, a / at the end for all below. A pattern without a
    slash fits at any depth; one with a leading slash at the root only. A match covers the whole path, or a folder
    above it; loose matches end anywhere, and start anywhere for patterns with a slash.
    """
    folder = pattern.endswith("/")
    rooted = pattern.startswith("/")
    body = pattern.strip("/")
    out, i = "", 0
    while i < len(body):
        if body.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif body.startswith("**", i):
            out, i = out + ".*", i + 2
        elif body[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif body[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(body[i]), i + 1
    if loose:
        return f"(?i){'' if '/' in body else '(?:^|/)'}{out}{'/' if folder else ''}"
    start = "^" if rooted or "/" in body else "(?:^|/)"
    return f"(?i){start}{out}{'/' if folder else '(?:/|$)'}"


def ignore_lines(text: str) -> tuple[list[str], list[str]]:
    """(exclude, include) patterns of an ignore file: # starts a comment, ! takes back."""
    lines = [line.strip() for line in text.splitlines()]
    lines = [line for line in lines if line and not line.startswith("#")]
    return [line for line in lines if not line.startswith("!")], [line[1:] for line in lines if line.startswith("!")]


def load_config(root: str) -> dict:
    """Settings of the config file; {} if there is none or it is malformed."""
    try:
        with open(os.path.join(root, CONFIG_FILE), encoding="utf-8") as f:
            found = json.load(f)
    except (OSError, ValueError):
        return {}
    return found if isinstance(found, dict) else {}


@dataclass(frozen=True)
class Rules:
    """What to leave out. include wins over exclude; only, if given, restricts to its patterns."""

    exclude: tuple[str, ...] = ()
    include: tuple[str, ...] = ()
    only: tuple[str, ...] = ()
    exclude_dirs: tuple[str, ...] = ()
    exclude_extensions: tuple[str, ...] = ()
    only_dirs: tuple[str, ...] = ()
    max_file_size: int = MAX_FILE_SIZE
    loose: bool = False
    #: Whether hidden files, and files with a name of ignored_dirs, are left out as such folders are.
    files_too: bool = False
    ignored_dirs: tuple[str, ...] = field(default=IGNORED_DIRS)

    def _any(self, path: Column, patterns: tuple[str, ...]) -> Column:
        return path.rlike("|".join(f"(?:{glob_regex(p, self.loose)})" for p in patterns)) if patterns else F.lit(False)

    def excluded(self, path: Column) -> Column:
        """Whether rules leave a path out."""
        return ~self._any(path, self.include) & (self._any(path, self.exclude) | (F.lit(bool(self.only)) & ~self._any(path, self.only)))

    def skipped_dir(self, path: Column) -> Column:
        """Whether a folder above the path is ignored, hidden (but .env), or outside only_dirs."""
        parts = F.split(path, "/")
        dirs = parts if self.files_too else F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
        named = F.arrays_overlap(dirs, F.array(*map(F.lit, (*self.ignored_dirs, *self.exclude_dirs))))
        hidden = F.exists(dirs, lambda d: d.startswith(".") & (d != ".env"))
        outside = F.lit(False)
        if self.only_dirs:
            inside = F.lit(False)
            for d in self.only_dirs:
                inside = inside | path.startswith(d.strip("/") + "/")
            outside = ~inside
        return named | hidden | outside

    def skipped_extension(self, path: Column) -> Column:
        out = F.lit(False)
        for e in self.exclude_extensions:
            out = out | path.endswith(e if e.startswith(".") else f".{e}")
        return out


def rules(root: str, exclude: list[str] | None = None, only: list[str] | None = None, only_dirs: list[str] | None = None, max_file_size: int | None = None) -> Rules:
    """Rules of the config file, the ignore file and the command line; of single values, the last named wins."""
    config = load_config(root)
    try:
        with open(os.path.join(root, IGNORE_FILE), encoding="utf-8") as f:
            ignored, taken_back = ignore_lines(f.read())
    except OSError:
        ignored, taken_back = [], []
    listed = lambda k: list(config.get(k) or [])
    return Rules(
        exclude=(*listed("exclude"), *ignored, *(exclude or [])),
        include=(*listed("include"), *taken_back),
        only=tuple(only or []),
        exclude_dirs=tuple(listed("excludeDirs")),
        exclude_extensions=tuple(listed("excludeExtensions")),
        only_dirs=(*listed("onlyDirs"), *(only_dirs or [])),
        max_file_size=max_file_size or config.get("maxFileSize") or MAX_FILE_SIZE,
    )


#: Rules without any setting: what the first version of the command line went by.
PLAIN = Rules(files_too=True)


def _files(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.{" + ",".join(e[1:] for e in EXTENSIONS) + "}").option("recursiveFileLookup", True).load(list(paths))


def _relative(root: str) -> Column:
    """The path of a file below root."""
    top = re.sub(r"^[a-z]+:/*(?=/)", "", root).rstrip("/") + "/"
    return F.substring(F.regexp_replace("path", r"^[a-z]+:/*(?=/)", ""), len(top) + 1, 1 << 20)


def listed(spark: SparkSession, root: str) -> DataFrame:
    """(path relative to root, size, file) of all files with a source extension; none is opened."""
    return _files(spark, root).select(_relative(root).alias("path"), F.col("length").alias("size"), F.col("path").alias("file"))


def judged(found: DataFrame, by: Rules) -> DataFrame:
    """found with reason: null for files to read, else the first rule against them."""
    path = F.col("path")
    reason = F.when(by.skipped_dir(path), "directory").when(by.skipped_extension(path), "extension").when(by.excluded(path), "rule").when(F.col("size") > by.max_file_size, "size")
    return found.withColumn("reason", reason)


def discover(spark: SparkSession, root: str, by: Rules | None = None) -> DataFrame:
    """(path, content) of the files to read: all are listed, the rules judge paths and sizes, and what they keep is read.

    The list of kept files comes to the driver, where Spark keeps the list of any scan's files. Bytes that are no
    UTF-8 become U+FFFD, so one bad file stops nothing.
    """
    kept = [r.file for r in judged(listed(spark, root), by or rules(root)).filter("reason IS NULL").select("file").collect()]
    if not kept:
        return spark.createDataFrame([], "path string, content string")
    # names such as [id].tsx are no globs
    raw = _files(spark, *(re.sub(r"([\\\[\]{}*?])", r"\\\1", f) for f in kept))
    return raw.select(_relative(root).alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"))


def exclusion_counts(spark: SparkSession, root: str, by: Rules | None = None) -> DataFrame:
    """Files per reason."""
    return judged(listed(spark, root), by or rules(root)).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
