"""Directed graphs: small ones in one task each, others by rounds of joins with rows in proportion to nodes and edges."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodica.sources.shared import dealt, written


#: A graph of no more edges is worked out within a task.
LOCAL_EDGES = 1 << 16


def _within_task(edges: pd.DataFrame) -> pd.DataFrame:
    """graph, node, component of one small graph, by two searches in depth: by time of leaving, then against the edges."""
    out, back = {}, {}
    for a, b in zip(edges["a"], edges["b"], strict=True):
        out.setdefault(a, []).append(b)
        back.setdefault(b, []).append(a)
    left, seen = [], set()
    for first in out:
        stack = [] if first in seen else [(first, iter(out[first]))]
        seen.add(first)
        while stack:
            v, more = stack[-1]
            w = next((w for w in more if w not in seen), None)
            if w is None:
                left.append(stack.pop()[0])
            else:
                seen.add(w)
                stack.append((w, iter(out.get(w, ()))))
    rows, loops, done = [], {a for a, b in zip(edges["a"], edges["b"], strict=True) if a == b}, set()
    for first in reversed(left):
        if first in done:
            continue
        members, stack = [], [first]
        done.add(first)
        while stack:
            v = stack.pop()
            members.append(v)
            new = [w for w in back.get(v, ()) if w not in done]
            done.update(new)
            stack += set(new)
        if len(members) > 1 or first in loops:
            least = min(members)
            rows += [(edges["graph"].iloc[0], v, least) for v in members]
    return pd.DataFrame(rows, columns=["graph", "node", "component"])


def _peeled(edges: DataFrame) -> DataFrame:
    """Distinct edges between nodes that have edges in and out, again and again until none goes."""
    core, size = edges.select("graph", "a", "b"), -1
    while (left := core.count()) != size and left:
        size = left
        # written, so that few nodes go to the edges and not the edges by node to one place
        ends, starts = (written(core.select("graph", F.col(x).alias(y)).distinct(), "ends") for x, y in ("ba", "ab"))
        core = written(core.join(ends, ["graph", "a"], "left_semi").join(starts, ["graph", "b"], "left_semi"), "core")
    return core


def _least(edges: DataFrame, source: str, target: str, name: str) -> DataFrame:
    """graph, v, ``name``: the least node from which ``v`` is reached along the edges, itself included.

    Each round takes the least label of the nodes before, and then the label of the node a label names, which halves the
    way along a path of falling names.
    """
    labels = edges.select("graph", F.explode(F.array("a", "b")).alias("v")).distinct().withColumn("l", F.col("v"))
    labels, moved = written(labels, "labels"), 1
    while moved:
        over = edges.select("graph", F.col(source).alias("v"), F.col(target).alias("w")).join(labels, ["graph", "v"]).groupBy("graph", F.col("w").alias("v")).agg(F.min("l").alias("m"))
        stepped = written(labels.join(over, ["graph", "v"], "left").select("graph", "v", F.col("l").alias("old"), F.least("l", "m").alias("l")), "stepped")
        far = stepped.select("graph", F.col("v").alias("l"), F.col("l").alias("m"))
        labels = written(stepped.join(far, ["graph", "l"], "left").select("graph", "v", "old", F.least("l", "m").alias("l")), "labels")
        moved = labels.where("l <> old").count()
        labels = labels.select("graph", "v", "l")
    return labels.withColumnRenamed("l", name)


def strong_components(edges: DataFrame) -> DataFrame:
    """graph, node, component (its least node) of all nodes of (graph, a, b) on a cycle; names are not null."""
    edges = written(dealt(written(edges.select("graph", "a", "b"), "steps"), "graph", "a", "b").distinct(), "edges")
    # large graphs are at most a LOCAL_EDGES-th of the edges; a join by graph alone would bring each to one task
    big = F.broadcast(written(edges.groupBy("graph").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > LOCAL_EDGES), "big"))
    small = dealt(edges.join(big, "graph", "left_anti"), "graph")
    kinds = dict(edges.dtypes)
    found = small.groupBy("graph").applyInPandas(_within_task, f"graph {kinds['graph']}, node {kinds['a']}, component {kinds['a']}")
    large = written(edges.join(big, "graph", "left_semi"), "large")
    return found.unionByName(_by_labels(large)) if large.head(1) else found


def _by_labels(edges: DataFrame) -> DataFrame:
    """Components by least labels, without bringing a graph to one task.

    Two nodes of one component are reached from the same least node and reach the same one, so edges between nodes that
    differ in one of these are in no component and go. A node whose two labels agree is in the component of that node;
    components found go, and the rest takes new labels until no edge is left.
    """
    rest, found = _peeled(edges), []
    loops = written(edges.where("a = b").select("graph", F.col("a").alias("node"), F.col("a").alias("component")).distinct(), "loops")
    while rest.head(1):
        labels = _least(rest, "a", "b", "from").join(_least(rest, "b", "a", "to"), ["graph", "v"])
        labels = written(labels, "pairs")
        found.append(labels.where("`from` = `to`").select("graph", F.col("v").alias("node"), F.col("from").alias("component")))
        open_ = labels.where("`from` <> `to`")
        a = open_.select("graph", F.col("v").alias("a"), F.struct("from", "to").alias("_pa"))
        b = open_.select("graph", F.col("v").alias("b"), F.struct("from", "to").alias("_pb"))
        rest = _peeled(written(rest.join(a, ["graph", "a"]).join(b, ["graph", "b"]).where("_pa = _pb"), "rest"))
    out = loops
    for part in found:
        out = out.unionByName(part)
    # nodes that stand alone in what was left are on no cycle, unless they loop
    sizes = out.groupBy("graph", "component").agg(F.count_distinct("node").alias("_n"))
    real = sizes.where("_n > 1").drop("_n").unionByName(loops.select("graph", "component")).distinct()
    members = out.groupBy("graph", "node").agg(F.min("component").alias("component"))
    return members.join(real, ["graph", "component"], "left_semi").select("graph", "node", "component")
