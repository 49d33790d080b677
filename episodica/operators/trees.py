"""Hash trees over files by path.

A file's place in the tree is given by the first hexadecimal digits of the MD5 of its path, so a node has sixteen children
at most and a leaf holds ``files / 16 ** depth`` files, whatever the paths look like. A node's hash is that of the names
and hashes below it in order. Levels are combined one by one, each on a sixteenth of the rows of the one below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episodica.sources.shared import written


def _combined(df: DataFrame, keys: list[str], node: Column) -> DataFrame:
    lines = F.array_sort(F.collect_list(F.concat_ws(":", "name", "sha")))
    return df.groupBy(*keys, node.alias("node")).agg(F.sha2(F.array_join(lines, "\n"), 256).alias("sha"), F.sum("files").alias("files"))


def nodes(files: DataFrame, keys: list[str], path: str, sha: str, depth: int) -> DataFrame:
    """keys, level (0 is the root), node (digits from the root), sha and files of every node of each group's tree."""
    digits = F.substring(F.md5(F.col(path).cast("string")), 1, depth)
    level = _combined(files.select(*keys, F.col(path).cast("string").alias("name"), F.col(sha).alias("sha"), F.lit(1).cast("long").alias("files"), digits.alias("_node")), keys, F.col("_node"))
    levels = []
    for up in range(depth, -1, -1):
        level = written(level, "tree")
        levels.append(level.select(*keys, F.lit(up).alias("level"), "node", "sha", "files"))
        if up:
            level = _combined(level.withColumnRenamed("node", "name"), keys, F.substring("name", 1, up - 1))
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return out


def roots(tree: DataFrame, keys: list[str]) -> DataFrame:
    return tree.where("level = 0").select(*keys, F.col("sha").alias("tree"), "files")


def changed(a: DataFrame, b: DataFrame, keys: list[str], path: str, sha: str, depth: int) -> DataFrame:
    """keys, path and change (added, removed, altered) from the files of ``a`` to those of ``b``.

    The trees are compared from the root down; below a node that is the same in both nothing is read, so the files that
    meet are those of leaves that differ.
    """
    old, new = nodes(a, keys, path, sha, depth), nodes(b, keys, path, sha, depth)
    differ = None
    for level in range(depth + 1):
        sides = []
        for tree, name in ((old, "_old"), (new, "_new")):
            side = tree.where(F.col("level") == level).select(*keys, "node", F.col("sha").alias(name))
            if differ is not None:
                side = side.withColumn("_up", F.substring("node", 1, level - 1)).join(differ.withColumnRenamed("node", "_up"), [*keys, "_up"], "left_semi").drop("_up")
            sides.append(side)
        differ = sides[0].join(sides[1], [*keys, "node"], "full").where(~F.col("_old").eqNullSafe(F.col("_new"))).select(*keys, "node")
        differ = written(differ, "differ")
    files = []
    for df, name in ((a, "_old"), (b, "_new")):
        named = df.select(*keys, F.col(path).cast("string").alias("path"), F.col(sha).alias(name))
        files.append(named.withColumn("node", F.substring(F.md5("path"), 1, depth)).join(differ, [*keys, "node"], "left_semi").drop("node"))
    both = files[0].join(files[1], [*keys, "path"], "full").where(~F.col("_old").eqNullSafe(F.col("_new")))
    return both.select(*keys, "path", F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").otherwise("altered").alias("change"))
