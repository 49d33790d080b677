"""N-gram Jaccard self-join by chosen paths.

Texts are sets of hashed runs of ``WORDS`` words; equal sets collapse to one representative. A set is embedded by
``SLOTS`` min-hashes, so that a pair of Jaccard similarity s shares about s * SLOTS of its (slot, value) tokens. In each
run a set picks tokens by a hash of the path so far, each with probability 1 / (LAMBDA * SLOTS), and goes down every path
it picks: sets that share tokens share paths. Paths of depth ``DEPTH`` are the first buckets; a bucket of more than
``BUCKET`` sets is split again, down to depth ``DEEPEST``. Runs are repeated until a pair at the threshold meets with
probability ``RECALL`` even in buckets of the greatest depth (``runs_for``); more alike pairs meet nearly always.

Small buckets are compared by brute force: sketches rule out most pairs, then the sets themselves give the exact
similarity. The sets of buckets that are still large (groups of many near copies) first meet a few leaders: Jaccard
distance is a metric, so sets within ``RADIUS`` of one leader are all linked, and such a ball counts its links from its
size, in work that grows with its rows. The other pairs of these sets are dealt once to blocks of at most about
``BLOCK`` sets, and every two blocks that meet in any large bucket, but for blocks of one ball, are compared once, by
products of their incidence over shared members. So the members of such a group are shipped once for each block of it,
not once for each bucket, run and group; nothing is capped, and no task holds more than two blocks.

A pair within a ball is counted there, one that shares a large bucket by its blocks, any other by the least small bucket,
so links are counted without listing all pairs; buckets and blocks hand on the number of links of each set and a
spanning forest of them, which are as many rows as they have sets. Classes are the connected components of the forests.

Defined cases: null text is empty; texts without a word are equal to each other and like nothing else; a text of fewer
words than ``WORDS`` is one run; exact copies, and texts of equal sets, share a class and count each other as links;
null ids are kept, a class is named by its least id; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from . import common, textvec

WORDS = 5
THRESHOLD = 0.8
SLOTS = 128
#: Least probability that a pair at the threshold meets.
RECALL = 0.985
LAMBDA = 0.75
DEPTH, DEEPEST = 2, 4
BUCKET = 256
#: Sets of a block of large buckets, and members of its sets, about.
BLOCK = 1_024
BLOCK_MEMBERS = 1 << 21
#: Similarity to a leader from which a set is in its ball: two such sets are at most twice that distance apart.
RADIUS = (1 + THRESHOLD) / 2
LEADERS = 4
#: Bytes of all leaders' sets up to which they may be broadcast.
LEADER_BYTES = 1 << 25
#: Standard errors by which a sketch may fall below the threshold before its pair is ruled out.
MARGIN = 5.0
EMPTY = 0
_SEEDS = [pow(0x9E3779B97F4A7C15, k + 2, 1 << 64) | 1 for k in range(SLOTS)]


# ---------------------------------------------------------------- sets and sketches


def _unique_sets(run: np.ndarray, text: np.ndarray, count: int) -> list[np.ndarray]:
    bounds = np.searchsorted(text, np.arange(count + 1))
    return [np.unique(run[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def _digest(values: np.ndarray) -> int:
    """A signed 64-bit name of a set (0 for the empty one), from the sum and the count of its members' mixes."""
    if not len(values):
        return EMPTY
    with np.errstate(over="ignore"):
        h = int(textvec.mix(textvec.mix(values + np.uint64(0x2545F4914F6CDD1D)).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(values)))[0]) or 1
    return h - (1 << 64) if h >> 63 else h


def _minhashes(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    out = np.empty((len(starts), SLOTS), np.uint64)
    for k, seed in enumerate(_SEEDS):
        out[:, k] = np.minimum.reduceat(values * np.uint64(seed), starts)
    return textvec.mix(out)


def meeting(runs: int, depth: int, similarity: float = THRESHOLD) -> float:
    """Probability that a pair shares a path of ``depth`` in one of ``runs``: a branching process over its shared slots."""
    shared = np.arange(SLOTS + 1)
    log_choose = np.array([math.lgamma(SLOTS + 1) - math.lgamma(k + 1) - math.lgamma(SLOTS - k + 1) for k in range(SLOTS + 1)])
    weight = np.exp(log_choose + shared * math.log(similarity) + (SLOTS - shared) * math.log1p(-similarity))
    lost = np.zeros(SLOTS + 1)  # by the number of shared slots
    for _ in range(depth):
        lost = (1 - (1 - lost) / (LAMBDA * SLOTS)) ** shared
    return float((weight * (1 - lost**runs)).sum())


def runs_for(recall: float, depth: int = DEEPEST) -> int:
    """The least number of runs in which a pair at the threshold meets with probability ``recall``."""
    runs = 1
    while meeting(runs, depth) < recall:
        runs += 1
    return runs


def roots(n: int, runs: int) -> tuple[np.ndarray, np.ndarray]:
    """For ``n`` sets, (set, path): the root of every run."""
    start = textvec.mix(np.arange(1, runs + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))
    return np.repeat(np.arange(n), runs), np.tile(start, n)


def longer(sketches: np.ndarray, of: np.ndarray, path: np.ndarray, each: int = 8_192) -> tuple[np.ndarray, np.ndarray]:
    """(set, path) one token longer than each (set, path) given: the tokens that the set picks on that path."""
    slots = np.arange(1, SLOTS + 1, dtype=np.uint64) << np.uint64(16)
    limit = np.uint64(int((1 << 64) / (LAMBDA * SLOTS)))
    owners, paths = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for k in range(0, len(of), each):
        own, at = of[k : k + each], path[k : k + each]
        tokens = (sketches[own].astype(np.uint64) | slots) * np.uint64(0xD6E8FEB86659FD93)
        h = textvec.mix(tokens + at[:, None])
        row, slot = np.nonzero(h < limit)
        owners.append(own[row])
        paths.append(textvec.mix(h[row, slot] + at[row]))
    return np.concatenate(owners), np.concatenate(paths)


def paths_of(sketches: np.ndarray, depth: int = DEPTH, runs: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(set, path) of all paths of ``depth`` tokens, over all runs."""
    of, path = roots(len(sketches), runs or runs_for(RECALL))
    for _ in range(depth):
        of, path = longer(sketches, of, path)
    return of, path


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, SLOTS)


def _leaves(names: pa.Array, of: np.ndarray, path: np.ndarray) -> pa.RecordBatch:
    """Distinct (leaf, set)."""
    pairs = np.unique(np.stack([path.view(np.int64), names.to_numpy()[of]]), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["leaf", "set"])


def _sketches(sets: list[np.ndarray]) -> list[bytes | None]:
    """The low 16 bits of the min-hash of each slot, for each set that has a member."""
    filled = [x for x in sets if len(x)]
    if not filled:
        return [None] * len(sets)
    starts = np.concatenate([[0], np.cumsum([len(x) for x in filled])[:-1]])
    rows = iter((_minhashes(np.concatenate(filled), starts) & np.uint64(0xFFFF)).astype(np.uint16))
    return [next(rows).tobytes() if len(x) else None for x in sets]


# ---------------------------------------------------------------- buckets


def _tasks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole tasks from batches that are sorted by task (the first column)."""
    carry = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if carry is None else pa.concat_tables([carry, table])
        task = table.column(0).to_numpy()
        if not len(task):
            continue
        cut = int(np.searchsorted(task, task[-1], side="left"))
        if cut:
            yield table.slice(0, cut)
        carry = table.slice(cut)
    if carry is not None and carry.num_rows:
        yield carry


def _alike_pairs(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places (i, j) of the pairs to verify, and their bucket's first place: alike by sketch, and sharing no lesser bucket."""
    leaf = table.column("leaf").to_numpy()
    sketches = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint16).reshape(-1, SLOTS)
    leaves, large = table.column("leaves").to_pylist(), table.column("large").to_pylist()
    balls = table.column("ball").to_pylist() if "ball" in table.column_names else [None] * len(leaf)
    starts = np.flatnonzero(np.concatenate([[True], leaf[1:] != leaf[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(leaf)]]))
    least = (THRESHOLD - MARGIN * (THRESHOLD * (1 - THRESHOLD) / SLOTS) ** 0.5) * SLOTS
    known: dict[int, tuple[set[int], set[int]]] = {}

    def own(i: int) -> tuple[set[int], set[int]]:
        if i not in known:
            known[i] = set(leaves[i]), set(large[i] or ())
        return known[i]

    def counted_here(x: int, y: int) -> bool:
        (small_x, large_x), (small_y, large_y) = own(x), own(y)
        apart = balls[x] is None or balls[x] != balls[y]
        return apart and min(small_x & small_y) == leaf[x] and large_x.isdisjoint(large_y)

    left, right, first = [], [], []
    for size in np.unique(sizes).tolist():
        of = starts[sizes == size]
        a, b = np.triu_indices(size, 1)
        each = max(1, 100_000 // max(1, len(a)))  # buckets of this size compared at once
        for k in range(0, len(of) if size > 1 else 0, each):
            here = of[k : k + each]
            i, j = (here[:, None] + a).reshape(-1), (here[:, None] + b).reshape(-1)
            of_bucket = np.repeat(here, len(a))
            alike = np.concatenate([(sketches[i[s : s + 50_000]] == sketches[j[s : s + 50_000]]).sum(axis=1) >= least for s in range(0, len(i), 50_000)])
            i, j, of_bucket = i[alike], j[alike], of_bucket[alike]
            real = np.fromiter((counted_here(x, y) for x, y in zip(i.tolist(), j.tolist(), strict=True)), bool, len(i))
            left.append(i[real])
            right.append(j[real])
            first.append(of_bucket[real])
    if not left:
        return (np.zeros(0, np.int64),) * 3
    return np.concatenate(left), np.concatenate(right), np.concatenate(first)


def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by bucket, those that have a pair to verify."""
    for table in _tasks_of(batches):
        i, j, _ = _alike_pairs(table)
        kept = table.select(["leaf", "set"]).take(pa.array(np.union1d(i, j).astype(np.int64)))
        yield from kept.combine_chunks().to_batches()


_LINKS = "set long, links long, to long"


def _links(out: list[tuple[int, int, int]]) -> pa.RecordBatch:
    columns = list(zip(*out, strict=True)) if out else [()] * 3
    return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], ["set", "links", "to"])


def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each set in a small bucket (in copies), and a forest that spans them: rows (set, links, to)."""
    for table in _tasks_of(batches):
        left, right, first = _alike_pairs(table)
        names, copies, shingles = table.column("set").to_numpy(), table.column("copies").to_numpy(), table.column("shingles")
        out: list[tuple[int, int, int]] = []
        order = np.argsort(first, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(first[order])) + 1) if len(order) else []:
            i, j = left[part], right[part]
            rows, at = np.unique(np.concatenate([i, j]), return_inverse=True)
            i, j = at[: len(i)], at[len(i) :]
            sets = [np.frombuffer(shingles[int(r)].as_py(), np.uint64) for r in rows]
            size = np.array([len(x) for x in sets])
            if len(i) <= 4 * len(rows):
                inter = np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(i, j, strict=True)])
            else:
                inter = _intersections(sets, sets)[i, j]
            real = inter >= THRESHOLD * (size[i] + size[j] - inter) - 1e-9
            i, j = i[real], j[real]
            if not len(i):
                continue
            own, of = names[rows], copies[rows]
            links = np.bincount(i, weights=of[j], minlength=len(rows)) + np.bincount(j, weights=of[i], minlength=len(rows))
            out += [(int(own[r]), int(links[r]), int(own[r])) for r in np.flatnonzero(links)]
            out += [(int(own[x]), 0, int(own[y])) for x, y in _forest(i.tolist(), j.tolist(), len(rows))]
        yield _links(out)


def verify_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``verify`` for rows sorted by a pair of blocks: of the pairs across (or within a lone block) that share a large bucket."""
    for table in _tasks_of(batches):
        names, copies, side = (table.column(c).to_numpy() for c in ("set", "copies", "side"))
        tasks = table.column("task").to_numpy()
        for rows in np.split(np.arange(len(tasks)), np.flatnonzero(np.diff(tasks)) + 1):
            left, right = rows[side[rows] == 0], rows[side[rows] == 1]
            within = not len(right)
            own = {int(r): np.frombuffer(table.column("shingles")[int(r)].as_py(), np.uint64) for r in rows}
            a = [own[int(r)] for r in left]
            b = a if within else [own[int(r)] for r in right]
            met = [np.unique(np.asarray(table.column("large")[int(r)].as_py(), np.int64)).view(np.uint64) for r in rows]
            of = dict(zip(rows.tolist(), met, strict=True))
            meet = _intersections([of[r] for r in left.tolist()], [of[r] for r in (left if within else right).tolist()]) > 0
            inter = _intersections(a, b)
            size_a, size_b = (np.array([len(x) for x in sets]) for sets in (a, b))
            real = meet & (inter >= THRESHOLD * (size_a[:, None] + size_b[None, :] - inter) - 1e-9)
            near = np.zeros((len(rows), len(rows)), bool)  # both ways, lone block or two
            if within:
                np.fill_diagonal(real, False)
                near |= real
                every = left
            else:
                near[: len(left), len(left) :] = real
                near[len(left) :, : len(left)] = real.T
                every = np.concatenate([left, right])
            links = near @ copies[every]
            out = [(int(names[every[r]]), int(links[r]), int(names[every[r]])) for r in np.flatnonzero(links)]
            out += [(int(names[every[x]]), 0, int(names[every[y]])) for x, y in _spanning(near)]
            yield _links(out)


def _spanning(near: np.ndarray) -> Iterator[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric matrix."""
    new = np.ones(len(near), bool)
    for start in range(len(near)):
        if not new[start]:
            continue
        new[start] = False
        todo = [start]
        while todo:
            x = todo.pop()
            found = np.flatnonzero(near[x] & new)
            new[found] = False
            todo += found.tolist()
            yield from ((x, y) for y in found.tolist())


def _forest(left: list[int], right: list[int], n: int) -> list[tuple[int, int]]:
    """Of the pairs, those that join two trees."""
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    for i, j in zip(left, right, strict=True):
        a, b = root(i), root(j)
        if a != b:
            parent[b] = a
            out.append((i, j))
    return out


def _intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of sets, by products of their incidence over shared members, some members at a time."""
    a, b = np.concatenate(left), np.concatenate(right)
    members, times = np.unique(a, return_counts=True)
    shared = np.intersect1d(members[times > 1] if left is right else members, b)  # of one side, a set meets itself
    out = np.zeros((len(left), len(right)), np.int64)
    row_a = np.repeat(np.arange(len(left)), [len(s) for s in left])
    row_b = np.repeat(np.arange(len(right)), [len(s) for s in right])
    for s in range(0, len(shared), 4096):
        some = shared[s : s + 4096]
        sides = []
        for values, rows, n in ((a, row_a, len(left)), (b, row_b, len(right))):
            at = np.searchsorted(some, values)
            hit = (at < len(some)) & (some[np.minimum(at, len(some) - 1)] == values)
            on = np.zeros((n, len(some)), np.float32)
            on[rows[hit], at[hit]] = 1
            sides.append(on)
        out += (sides[0] @ sides[1].T).astype(np.int64)
    return out  # the diagonal of one side counts shared members only


# ---------------------------------------------------------------- the join


def _homes(heavy: DataFrame, sketches: DataFrame) -> DataFrame:
    """set, home (the largest of its large buckets), large (all of them), copies, members; ``heavy`` is leaf, set, size."""
    home = heavy.groupBy("set").agg(F.max(F.struct("size", "leaf"))["leaf"].alias("home"), F.collect_list("leaf").alias("large"))  # a set has few paths
    slim = sketches.select(F.col("set").alias("own"), "copies", "members")
    return common.materialize(home.join(slim, F.col("set") == F.col("own")).drop("own"), "join-homes")


def _balls(heavy: DataFrame, homes: DataFrame, sets: DataFrame) -> DataFrame:
    """set, ball: of the leaders of its home within the radius, the one of most sets; in balls of more than ``BUCKET``.

    Jaccard distance is a metric: two sets of similarity ``RADIUS`` or more to one leader are linked, so the links within
    a ball are counted from its size, without a comparison. A bucket has a few leaders, those of least hash, so that buckets
    of much the same sets have the same ones. ``heavy`` is leaf, set, size; ``homes`` that of ``_homes``.
    """
    picks = F.array_distinct(F.array(*[F.min_by("set", F.xxhash64("set", F.lit(k))) for k in range(LEADERS)]))
    asked = homes.select(F.col("home").alias("leaf")).distinct()
    picked = heavy.join(asked, "leaf", "left_semi").groupBy("leaf").agg(picks.alias("leaders")).select(F.col("leaf").alias("h"), F.explode("leaders").alias("leader"))
    led = picked.join(sets.withColumnRenamed("set", "named"), F.col("leader") == F.col("named"))
    led = led.groupBy("h").agg(F.array_sort(F.collect_list(F.struct("leader", "shingles"))).alias("leaders"))  # ``LEADERS`` at most
    led = common.materialize(led, "join-leaders")
    size = led.agg(F.sum(F.aggregate("leaders", F.lit(0).cast("long"), lambda s, x: s + F.octet_length(x["shingles"])))).first()[0] or 0

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int, int]] = []
            for name, members, leaders in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                own = np.frombuffer(members, np.uint64)
                for x in leaders:
                    other = np.frombuffer(x["shingles"], np.uint64)
                    inter = len(np.intersect1d(own, other, assume_unique=True))
                    if inter >= RADIUS * (len(own) + len(other) - inter):
                        found.append((name, x["leader"]))
            columns = list(zip(*found, strict=True)) if found else [()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], ["set", "ball"])

    rows = homes.select("set", "home").join(sets.withColumnRenamed("set", "named"), F.col("set") == F.col("named"))
    rows = rows.join(common.maybe_broadcast(led, size, LEADER_BYTES), F.col("home") == F.col("h")).select("set", "shingles", "leaders")
    near = common.materialize(rows.mapInArrow(close, "set long, ball long"), "join-near")
    # small balls are not worth blocks of their own
    large = near.groupBy("ball").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BUCKET).withColumnRenamed("ball", "b")
    large = common.materialize(large, "join-large-balls")
    inside = near.join(common.maybe_broadcast(large, large.count()), F.col("ball") == F.col("b"))
    return common.materialize(inside.groupBy("set").agg(F.max(F.struct("n", "ball"))["ball"].alias("ball")), "join-balls")


def _ball_links(homes: DataFrame) -> DataFrame:
    """set, links, to: the links within each ball, and its members' edges to the leader; ``homes`` has ball."""
    inside = homes.where("ball is not null").select("set", "ball", "copies")
    totals = inside.groupBy("ball").agg(F.sum("copies").alias("total")).withColumnRenamed("ball", "b")
    totals = common.materialize(totals, "join-ball-sizes")
    each = inside.join(common.maybe_broadcast(totals, totals.count()), F.col("ball") == F.col("b"))
    own = each.select("set", (F.col("total") - F.col("copies")).alias("links"), F.col("set").alias("to")).where("links > 0")
    return own.unionByName(inside.where("set <> ball").select("set", F.lit(0).cast("long").alias("links"), F.col("ball").alias("to")))


def _block_tasks(homes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sets of large buckets in blocks (set, copies, large, block), and the pairs of blocks that meet (task, side, block).

    A set goes to a block of its ball, or else of its home, dealt by its hash; blocks of one ball do not meet.
    """
    dealt = homes.withColumn("place", F.when(F.col("ball").isNotNull(), F.xxhash64(F.lit("ball"), "ball")).otherwise(F.xxhash64(F.lit("home"), "home")))
    parts = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("members") / BLOCK_MEMBERS))
    sizes = common.materialize(dealt.groupBy("place").agg(parts.alias("parts")).withColumnRenamed("place", "p"), "join-place-parts")
    dealt = dealt.join(common.maybe_broadcast(sizes, sizes.count()), F.col("place") == F.col("p"))
    block = F.xxhash64("place", F.pmod(F.xxhash64("set", F.lit("block")), F.col("parts")))
    blocks = common.materialize(dealt.select("set", "copies", "large", "ball", block.alias("block")), "join-blocks")
    met = common.materialize(blocks.select("block", "ball", F.explode("large").alias("leaf")).distinct(), "join-met")
    other = met.select(F.col("block").alias("other"), F.col("ball").alias("other_ball"), F.col("leaf").alias("l"))
    apart = F.col("ball").isNull() | F.col("other_ball").isNull() | (F.col("ball") != F.col("other_ball"))
    pairs = met.join(other, F.col("leaf") == F.col("l")).where(F.col("block") <= F.col("other")).where(apart).select("block", "other").distinct()
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("block").alias("of")), F.struct(F.lit(1).alias("side"), F.col("other").alias("of")))
    sides = F.when(F.col("block") == F.col("other"), F.slice(sides, 1, 1)).otherwise(sides)
    tasks = pairs.select(F.xxhash64("block", "other").alias("task"), F.explode(sides).alias("s"))
    return blocks, common.materialize(tasks.select("task", "s.side", F.col("s.of").alias("of")), "join-block-tasks")


def links_of(sketches: DataFrame, shingles: Callable[[DataFrame], DataFrame], recall: float = RECALL) -> DataFrame:
    """set, links, to: verified links and forests, from ``sketches`` (set, sketch, copies, members).

    ``shingles`` gives (set, shingles), once each, for a table of sets.
    """
    runs = runs_for(recall)

    def root_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _leaves(batch.column(0), *paths_of(_matrix(batch.column(1)), runs=runs))

    def longer_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = batch.column(0).to_numpy().view(np.uint64)
                yield _leaves(batch.column(1), *longer(_matrix(batch.column(2)), np.arange(batch.num_rows), at))

    own = sketches.select("set", "sketch")
    members = common.materialize(own.mapInArrow(root_paths, "leaf long, set long"), "join-paths")
    leaves, used = None, []
    for depth in range(DEPTH, DEEPEST + 1):
        sizes = common.materialize(members.groupBy("leaf").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "join-counts")
        # only buckets that hold a pair are met again
        sized = members.join(sizes.withColumnRenamed("leaf", "sized_leaf"), F.col("leaf") == F.col("sized_leaf")).drop("sized_leaf")
        sized = common.materialize(sized, "join-buckets")
        common.discard(members, sizes)
        used.append(sized)
        heavy = sized.where(F.col("size") > BUCKET)
        small = sized.where(F.col("size") <= BUCKET).select("leaf", "set")
        leaves = small if leaves is None else leaves.unionByName(small)
        any_heavy = not heavy.isEmpty()
        if depth == DEEPEST or not any_heavy:
            break
        deeper = heavy.join(own.withColumnRenamed("set", "own"), F.col("set") == F.col("own")).select("leaf", "set", "sketch")
        members = common.materialize(deeper.mapInArrow(longer_paths, "leaf long, set long"), "join-paths")
    leaves = common.materialize(leaves, "join-leaves")
    homes = _homes(heavy, sketches)
    of_set = leaves.groupBy("set").agg(F.collect_list("leaf").alias("leaves"))  # a set has few paths
    known = sketches.join(of_set.withColumnRenamed("set", "own"), F.col("set") == F.col("own")).drop("own")
    large = homes.select(F.col("set").alias("own"), "large")
    known = known.join(large, F.col("set") == F.col("own"), "left").select("set", "sketch", "copies", "leaves", "large")
    known = common.materialize(known, "join-known")
    of = known.withColumnRenamed("set", "own")
    asked = leaves.join(of.drop("copies"), F.col("set") == F.col("own")).select("leaf", "set", "sketch", "leaves", "large")
    asked = asked.repartition("leaf").sortWithinPartitions("leaf").mapInArrow(screen, "leaf long, set long")
    asked = common.materialize(asked, "join-candidates")
    needed = common.materialize(asked.select("set").unionByName(homes.select("set")).distinct(), "join-needed")
    found = common.materialize(shingles(needed), "join-shingles")
    sets = found.withColumnRenamed("set", "named")
    balls = _balls(heavy, homes, found).withColumnRenamed("set", "own")
    homes_of = common.materialize(homes.join(balls, F.col("set") == F.col("own"), "left").drop("own"), "join-dealt")
    blocks, tasks = _block_tasks(homes_of)
    full = asked.join(of, F.col("set") == F.col("own")).drop("own").join(sets, F.col("set") == F.col("named"))
    full = full.join(balls, F.col("set") == F.col("own"), "left").select("leaf", "set", "sketch", "leaves", "large", "copies", "shingles", "ball")
    links = full.repartition("leaf").sortWithinPartitions("leaf").mapInArrow(verify, _LINKS)
    if any_heavy:
        whole = blocks.join(sets, F.col("set") == F.col("named"))
        pairs = tasks.join(whole, F.col("of") == F.col("block")).select("task", "side", "set", "copies", "large", "shingles")
        links = links.unionByName(pairs.repartition("task").sortWithinPartitions("task").mapInArrow(verify_blocks, _LINKS)).unionByName(_ball_links(homes_of))
    links = common.materialize(links, "join-links")
    common.discard(*used, leaves, homes, homes_of, blocks, tasks, known, asked, needed, found)
    return links


def components(edges: DataFrame) -> DataFrame:
    """node, root: the least node of each connected component, from edges (a, b), by alternating star contraction."""
    both = lambda e: e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = common.materialize(both(edges).where("a <> b").distinct(), "cc")
    before = None
    while True:
        # large star: neighbours above a node move to its least neighbour
        around = edges.union(edges.select("b", "a"))
        least = common.materialize(around.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), "cc-least")
        large = around.join(least.withColumnRenamed("a", "n"), F.col("a") == F.col("n")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = common.materialize(large.where("a <> b").distinct(), "cc-large")
        # small star: a node and its lesser neighbours move to the least of them
        low = common.materialize(large.groupBy("a").agg(F.min("b").alias("m")), "cc-low")
        small = large.join(low.withColumnRenamed("a", "n"), F.col("a") == F.col("n"))
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        used, edges = (edges, least, large, low), common.materialize(small.where("a <> b").distinct(), "cc")
        common.discard(*used)
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state


def _described(words: int, sketched: bool):
    """The function that reads (doc, key, text) and gives doc, key, set, sketch and members, or set and shingles."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = textvec.Hasher()
        for batch in batches:
            names, values, sizes = [], [], []
            for first, last, found in hasher.spans(batch.column(2).to_pylist()):
                sets = _unique_sets(*found.shingles(words), last - first)
                names += [_digest(x) for x in sets]
                sizes += [len(x) for x in sets]
                values += _sketches(sets) if sketched else [x.tobytes() for x in sets]
            names, values = pa.array(names, pa.int64()), pa.array(values, pa.binary())
            if sketched:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), names, values, pa.array(sizes, pa.int64())], ["doc", "key", "set", "sketch", "members"])
            else:
                yield pa.RecordBatch.from_arrays([names, values], ["set", "shingles"])

    return describe


def _limit(df: DataFrame, id_col: str) -> int:
    """Rows of (id, hash) that may be broadcast: more where the id is a number and so of a known size."""
    return 1_000_000 if isinstance(df.schema[id_col].dataType, NumericType) else common.BROADCAST_ROWS


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id (least id of its class) and n_links (rows of similarity 0.8 or more, itself not counted)."""
    return _classed(docs, id_col, text_col, words, recall).select("doc_id", "class_id", "n_links")


def _classed(docs: DataFrame, id_col: str, text_col: str, words: int = WORDS, recall: float = RECALL) -> DataFrame:
    """``near_duplicates`` with the hash of the text (key) and the name of the class (root), as ids may be null or repeat."""
    slim = docs.select(docs[id_col].alias("doc"), F.xxhash64(docs[text_col]).alias("key"), docs[text_col].alias("text"))
    kind = slim.schema["doc"].dataType.simpleString()
    described = slim.mapInArrow(_described(words, True), f"doc {kind}, key long, set long, sketch binary, members long")
    described = common.materialize(described, "join-sets")
    first = described.groupBy("set").agg(
        F.min(F.struct("doc", "key")).alias("least"), F.min("doc").alias("least_doc"), F.count(F.lit(1)).alias("copies"), F.min("sketch").alias("sketch"),
        F.min("members").alias("members"),
    )
    first = common.materialize(first.select("set", "least", "least_doc", "copies", "sketch", "members"), "join-first")

    def shingles(needed: DataFrame) -> DataFrame:
        # one row of the corpus stands for each set; only the texts asked for are hashed again
        rows = first.join(needed.withColumnRenamed("set", "n"), F.col("set") == F.col("n")).select(F.col("least.doc").alias("least_doc"), F.col("least.key").alias("least_key"))
        rows = common.maybe_broadcast(rows, needed.count(), _limit(slim, "doc"))
        texts = slim.join(rows, (F.col("key") == F.col("least_key")) & F.col("doc").eqNullSafe(F.col("least_doc")))
        found = texts.select("doc", "key", "text").mapInArrow(_described(words, False), "set long, shingles binary")
        return found.dropDuplicates(["set"])  # rows that repeat an id and its text give their set twice

    links = links_of(first.where("sketch is not null").select("set", "sketch", "copies", "members"), shingles, recall)
    counts = links.groupBy("set").agg(F.sum("links").alias("links")).withColumnRenamed("set", "n")
    roots = components(links.select(F.col("set").alias("a"), F.col("to").alias("b")))
    named = first.select("set", "least_doc", "copies").join(roots, F.col("set") == F.col("node"), "left")
    named = common.materialize(named.select("set", F.coalesce("root", "set").alias("root"), "least_doc", "copies"), "join-roots")
    class_of = common.materialize(named.groupBy("root").agg(F.min("least_doc").alias("class_id")), "join-names").withColumnRenamed("root", "r")
    per_set = named.join(class_of, F.col("root") == F.col("r")).join(counts, F.col("set") == F.col("n"), "left")
    per_set = per_set.select(F.col("set").alias("s"), "root", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    per_set = common.materialize(per_set, "join-classes")
    return described.select("doc", "key", "set").join(per_set, F.col("set") == F.col("s")).select(F.col("doc").alias("doc_id"), "key", "root", "class_id", "n_links")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row left of each class: the one of least id, null ids last, and of one id that of least text hash."""
    found = common.materialize(_classed(docs, id_col, text_col).select("doc_id", "key", "root"), "join-kept")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))
    several = found.groupBy("root").agg(F.count(F.lit(1)).alias("rows"), least.alias("kept")).where("rows > 1").select(F.col("root").alias("r"), "kept")
    several = common.materialize(several, "join-several")
    rows = found.join(common.maybe_broadcast(several, several.count(), _limit(found, "doc_id")), F.col("root") == F.col("r"))
    # an id and a text make a row; rows that repeat both are told apart by nothing
    rows = rows.groupBy("doc_id", "key", "kept").agg(F.count(F.lit(1)).alias("rows"))
    is_kept = F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.col("key") == F.col("kept.key"))
    rows = common.materialize(rows.select(F.col("doc_id").alias("met_id"), F.col("key").alias("met_key"), is_kept.alias("is_kept"), "rows"), "join-extra")
    extra = rows.where("NOT is_kept").select("met_id", "met_key")
    match = docs[id_col].eqNullSafe(F.col("met_id")) & (F.xxhash64(docs[text_col]) == F.col("met_key"))
    kept = docs.join(common.maybe_broadcast(extra, extra.count(), _limit(found, "doc_id")), match, "left_anti")
    again = rows.where("is_kept AND rows > 1").select("met_id", "met_key")
    if again.isEmpty():
        return kept
    again = common.maybe_broadcast(again, again.count(), _limit(found, "doc_id"))
    # the first of each stays
    return kept.join(again, match, "left_anti").unionByName(kept.join(again, match, "left_semi").dropDuplicates([id_col, text_col]))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.read(spark, sf_dir, "documents"))
