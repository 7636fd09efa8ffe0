"""A folder tree from a list of files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def directory_tree(files: DataFrame, depth: int = 3) -> DataFrame:
    """path, name, level, kind, truncated, files, bytes, modified: a row for
    each file and folder above `depth`, and at `depth` what is left off there;
    files and bytes are of all that lies below.

    files: path (parts joined by /), size, modified.  Each file counts for the
    folders above it, at most `depth` of them, and folders add up before they
    are shuffled.  Hidden parts (with a dot in front) leave out all below them;
    a path without parts is left out; null sizes count 0."""
    parts = F.filter(F.split(F.coalesce("path", F.lit("")), "/"), lambda p: p != "")
    own = files.select(parts.alias("parts"), F.coalesce(F.col("size").cast("long"), F.lit(0)).alias("size"), "modified")
    own = own.where((F.size("parts") > 0) & ~F.exists("parts", lambda p: p.startswith(".")))
    levels = F.explode(F.sequence(F.lit(1), F.least(F.size("parts"), F.lit(depth))))
    nodes = own.withColumn("level", levels).select(F.array_join(F.slice("parts", 1, F.col("level")), "/").alias("path"), F.element_at("parts", F.col("level")).alias("name"), "level", (F.size("parts") == F.col("level")).alias("is_file"), "size", "modified")
    cut = F.col("level") == depth
    # a name that is a file and a folder as well counts as a folder
    kind = F.when(cut | ~F.min("is_file"), "directory").otherwise("file")
    found = nodes.groupBy("path", "name", "level").agg(kind.alias("kind"), F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), F.max("modified").alias("modified"))
    return found.select("path", "name", "level", "kind", cut.alias("truncated"), "files", "bytes", "modified")
