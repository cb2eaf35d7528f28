"""Ranked choices of files where plain rules find none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolith.functions import patterns
from repolith.functions.predicates import entry_point_path, has_any


def _slashes(path):
    return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))


def fallback_entry_points(files: DataFrame, k: int = 5) -> DataFrame:
    """The k first of ``files`` (ord, path, name) by score and ord: those with entry-like names or paths, else those with
    one slash at most. Depth and common names lower the score and the lowest come first, so deeper paths lead."""
    name, path = F.lower("name"), F.lower("path")
    marked = files.withColumn("hit", has_any(name, patterns.FALLBACK_WORDS) | entry_point_path(path))
    score = -_slashes(path) - F.when(has_any(name, ("main", "app", "index")), 10).otherwise(0) - F.when(has_any(name, (".py", ".js", ".go", ".rs")), 5).otherwise(0)
    # Shallow files count only if nothing hits: tier 0 has all hits, and a tier is dropped by the least one there is.
    tiered = marked.filter(F.col("hit") | (_slashes(F.col("path")) <= 1)).withColumn("tier", F.when(F.col("hit"), 0).otherwise(1)).withColumn("score", score.cast("long"))
    best = tiered.agg(F.min("tier").alias("tier"))
    return tiered.join(F.broadcast(best), "tier").orderBy("score", "ord").limit(k).select("ord", "path", "name", "score")


def fallback_connected_files(files: DataFrame, k: int = 10) -> DataFrame:
    """The k first of ``files`` (ord, path, name): those in source folders, then other source files that are no tests."""
    name = F.lower("name")
    other = has_any(name, patterns.ENTRY_EXTENSIONS) & ~has_any(name, ("test", "spec", "_test"))
    tier = F.when(has_any(F.lower("path"), patterns.FALLBACK_DIRS), 0).when(other, 1)
    return files.withColumn("tier", tier).filter("tier is not null").orderBy("tier", "ord").limit(k).select("ord", "path", "name", "tier")
