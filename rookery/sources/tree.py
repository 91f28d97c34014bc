"""Source trees as DataFrames of files."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VENDORED, BUILD = ["node_modules", ".git"], ["target", "build", "out", "bin"]
CONFIG_NAME = r"(?i)^(application|bootstrap)(?:-(.+))?\.(ya?ml|properties)$"
CONFIG_BYTES = 256 * 1024


def is_source_path(path: Column) -> Column:
    """Not vendored, not build output above the first src, not src/test; path is relative to the tree's root, with slashes."""
    dirs = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    src = F.array_position(dirs, "src")
    build = F.array_min(F.filter(F.transform(dirs, lambda d, i: F.when(d.isin(BUILD), i + 1)), lambda i: i.isNotNull()))
    built = build.isNotNull() & ((src == 0) | (build < src))
    test = (src > 0) & (F.coalesce(F.get(dirs, src.cast("int")), F.lit("")) == "test")
    return ~F.exists(F.split(path, "/"), lambda s: s.isin(VENDORED)) & ~built & ~test


def walk_order(path: Column) -> Column:
    """Sort key of a depth-first walk with sorted entries."""
    return F.split(path, "/")


def config_name(name: Column) -> Column:
    """struct(is_config, bootstrap, profile, format) of a file name."""
    part = lambda g: F.regexp_extract(name, CONFIG_NAME, g)
    return F.struct(name.rlike(CONFIG_NAME).alias("is_config"), (F.lower(part(1)) == "bootstrap").alias("bootstrap"), F.nullif(part(2), F.lit("")).alias("profile"), F.when(F.lower(part(3)) == "properties", "properties").otherwise("yaml").alias("format"))


def any_case(pattern: str) -> str:
    """A file name glob that does not mind case."""
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in pattern)


#: Globs of file names, so that each use of a tree reads its own files only.
JAVA, CONFIG, BUILD_FILES = "*.java", any_case("{application,bootstrap}*.{yml,yaml,properties}"), "{*.[xX][mM][lL],build.gradle,build.gradle.kts}"


def _links(root: str) -> list[str]:
    """Links below a local root, relative; a store has none."""
    found: list[str] = []
    for here, dirs, files in os.walk(root, followlinks=False):
        found += [os.path.relpath(os.path.join(here, x), root) for x in [*dirs, *files] if os.path.islink(os.path.join(here, x))]
    return found


def scan_tree(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """repo, path, name, size, text of the regular files under a root that is_source_path keeps; unreadable and linked ones are left out.

    Text is read only for rows and queries that ask for it, and a condition on size reaches the scan. Links are recognised where the
    driver sees the tree.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
    local = root.removeprefix("file://")
    base = os.path.abspath(local) if os.path.isdir(local) else root.rstrip("/")
    path = F.url_decode(F.replace(F.regexp_replace("path", "^file:/*", "/"), F.lit("+"), F.lit("%2B")))
    files = reader.load(root).select(F.lit(os.path.basename(base)).alias("repo"), path.substr(F.lit(len(base) + 2), F.length(path)).alias("path"), F.col("length").alias("size"), F.decode("content", "UTF-8").alias("text"))
    links = _links(local) if os.path.isdir(local) else []
    if links:
        parts = F.split("path", "/")
        above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
        files = files.where(~F.arrays_overlap(above, F.array(*map(F.lit, links))))
    return files.where(is_source_path(F.col("path"))).withColumn("name", F.element_at(F.split("path", "/"), -1))


def config_files(spark: SparkSession, root: str) -> DataFrame:
    """scan_tree for configuration files: every one has a row; text is null where it is larger than the limit (never read) or unreadable."""
    listed = scan_tree(spark, root, CONFIG).where(config_name(F.col("name"))["is_config"])
    read = listed.where(F.col("size") <= CONFIG_BYTES).select("repo", "path", "text")
    return listed.select("repo", "path", "name", "size").join(read, ["repo", "path"], "left")
