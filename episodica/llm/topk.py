"""Exact top-k search by inner product, a block at a time.

Vectors are quantised to integers and dealt to blocks of a document range: rows are ordered by the nearest of some
centres (fitted on a bounded sample) and then by id, so that a block's terms, its components, lie close together. A block
has the largest and smallest value of each term; the summed term maxima of a query bound its score on the block. For each
query, blocks are taken by falling bound and scored through their forward index (the block's rows) until the bounds
fall below the k-th score. The k-th score starts from the same bounded sample, which is a valid floor since its rows are
candidates; it is computed once for each query.

Stretches of blocks and chunks of queries are named where they are written, so the result is whole however Spark deals
the rows. First the bounds alone meet the queries: panels of the term maxima of many stretches, and every panel meets
every chunk under a key of its own. A panel hands on, for each of its stretches, only the queries whose bound reaches
their floor; only these meet the stretch's rows, and each gives at most k rows a query.

Defined cases: vectors that are null or hold a null or a non-finite component take no part; shorter vectors count as
ending in zeros; ties go to the smaller id; equal vectors are candidates each; rows that share an id are rows of their own,
each with its list as a query and each a candidate of the others; fewer candidates than k give all of them;
an empty table gives an empty result. Components are exact up to 2^53 in a score; beyond that they wrap as longs do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from episodica.operators.sequence import global_rank

from . import common

K = 20
SCALE = 64
BLOCK = 256
#: Rows of a stretch of blocks, and queries of a chunk: what is scored together.
STRETCH = 4_096
CHUNK = 2_048
#: Blocks of a panel of bounds.
PANEL = 2_048
#: Bytes of rows that go to a worker at once, about.
AT_ONCE = 1 << 26
SAMPLE = 8_192
CENTRES = 64


def quantised(table: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """id, v (array of long) of the vectors that take part."""
    x = table[vector_col]
    real = x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != F.lit(float("inf"))))
    v = F.transform(x, lambda e: F.floor(F.lit(float(scale)) * e.cast("double")).cast("long"))
    return table.where(real).select(table[id_col].cast("long").alias("id"), v.alias("v")).where("id is not null")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column as rows of ``width``, zeros behind the shorter ones."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    if (sizes == width).all():
        return values[offsets[0] : offsets[-1]].reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        out[i, : b - a] = values[a:b]
    return out


def centres_of(sample: np.ndarray, k: int = CENTRES, rounds: int = 8) -> np.ndarray:
    """A few rounds of k-means on the sample, from rows at even steps."""
    x = sample.astype(np.float64)
    centres = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        near = _nearest(x, centres)
        for c in range(len(centres)):
            if (own := near == c).any():
                centres[c] = x[own].mean(axis=0)
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(axis=1) - 2 * (x @ centres.T), axis=1)


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products as long: in doubles where they are exact, else in longs."""
    top = (float(np.abs(q).max(initial=0)) + 1) * (float(np.abs(x).max(initial=0)) + 1) * max(1, q.shape[1])
    if top < 2**53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return np.einsum("ij,kj->ik", q, x)


_LOW = np.iinfo(np.int64).min


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k first of each row by falling score, then by id."""
    order = np.lexsort((ids, np.where(scores == _LOW, np.iinfo(np.int64).max, -scores)), axis=1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def bounds_of(x: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest and the smallest value of each term in each block of rows."""
    starts = range(0, len(x), block)
    return np.stack([x[s : s + block].max(axis=0) for s in starts]), np.stack([x[s : s + block].min(axis=0) for s in starts])


def upper(q: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """What no row of a block (columns) scores above for each query: summed term maxima."""
    wide = q.astype(np.float64)
    return np.nextafter(np.maximum(wide, 0) @ high.T.astype(np.float64) + np.minimum(wide, 0) @ low.T.astype(np.float64), np.inf)


def search(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, floor: np.ndarray, k: int = K, block: int = BLOCK):
    """The k best of the rows ``x`` for each query, without those below ``floor``: (query place, id, score)."""
    bounds = upper(q, *bounds_of(x, block))
    order = np.argsort(-bounds, axis=1, kind="stable")
    scores = np.full((len(q), k), _LOW, np.int64)
    ids = np.full((len(q), k), np.iinfo(np.int64).max, np.int64)
    floor = floor.copy()
    active = np.arange(len(q))
    for turn in range(order.shape[1]):
        blocks = order[active, turn]
        keep = bounds[active, blocks] >= floor[active]
        active, blocks = active[keep], blocks[keep]
        if not len(active):
            break
        by = np.argsort(blocks, kind="stable")
        for part in np.split(by, np.flatnonzero(np.diff(blocks[by])) + 1):
            b, rows = blocks[part[0]], active[part]
            here = slice(b * block, (b + 1) * block)
            got = _scores(q[rows], x[here])
            got[(q_ids[rows][:, None] == x_ids[here][None, :]) | (got < floor[rows][:, None])] = _LOW
            hit = (got > _LOW).any(axis=1)
            if not hit.any():
                continue
            rows, got = rows[hit], got[hit]
            new_ids = np.where(got == _LOW, np.iinfo(np.int64).max, x_ids[here][None, :])
            scores[rows], ids[rows] = _best(np.hstack([scores[rows], got]), np.hstack([ids[rows], new_ids]), k)
            floor[rows] = np.maximum(floor[rows], scores[rows, -1])
    at, place = np.nonzero(scores > _LOW)
    return at, ids[at, place], scores[at, place]


def floors(q: np.ndarray, q_ids: np.ndarray, seeds: np.ndarray, seed_ids: np.ndarray, k: int) -> np.ndarray:
    """The k-th score of each query among the sample, a floor of its k-th score among all rows."""
    out = np.full(len(q), _LOW, np.int64)
    for s in range(0, len(q) if len(seed_ids) > k else 0, 512):
        got = _scores(q[s : s + 512], seeds)
        got[q_ids[s : s + 512][:, None] == seed_ids[None, :]] = _LOW
        out[s : s + 512] = np.partition(got, len(seed_ids) - k, axis=1)[:, len(seed_ids) - k]
    return out


def _narrow(x: np.ndarray) -> np.ndarray:
    return x.astype(np.int16 if np.abs(x).max(initial=0) < 2**15 else np.int64)


def _packed(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names)


def _in_parts(batches: Iterator[pa.RecordBatch], width: int, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, rows) of ``size`` consecutive rows of id and v, and of what is left at the end."""
    ids, rows, held = [], [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        ids.append(batch.column(0).to_numpy())
        rows.append(np.asarray(_matrix(batch.column(1), width), np.int64))
        held += batch.num_rows
        if held >= size:
            all_ids, all_rows = np.concatenate(ids), np.concatenate(rows)
            cut = held - held % size
            for s in range(0, cut, size):
                yield all_ids[s : s + size], all_rows[s : s + size]
            ids, rows, held = [all_ids[cut:]], [all_rows[cut:]], held - cut
    if held:
        yield np.concatenate(ids), np.concatenate(rows)


def top_k(table: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of ``table`` for each row that ``is_query`` (of the column id) picks."""
    spark = table.sparkSession
    rows = common.materialize(quantised(table, id_col, vector_col, scale).withColumn("asked", F.coalesce(is_query, F.lit(False))), "topk-vectors")
    names = None
    if rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").head(1):  # rows get names in the order of their ids
        named = common.materialize(global_rank(rows, ["id"], "name"), "topk-named")
        common.discard(rows)
        names, rows = named.select("name", "id"), named.select(F.col("name").alias("id"), "v", "asked")
        rows.written_to = named.written_to
    queries = rows.where("asked").select("id", "v")
    shape = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("width"), F.count_if("asked").alias("q")).first()
    result = "query_id long, rank int, vec_id long, score long"
    if not shape["n"] or not shape["q"]:
        return spark.createDataFrame([], result)
    width = max(1, shape["width"])
    stretch, block, chunk, panel = STRETCH, BLOCK, CHUNK, PANEL
    sample = rows.limit(SAMPLE).toArrow()  # bounded; any rows serve
    sample_ids, sample_rows = sample.column("id").to_numpy(), _matrix(sample.column("v"), width)
    shared = spark.sparkContext.broadcast((sample_ids, sample_rows, centres_of(sample_rows)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value[2]
        for batch in batches:
            if batch.num_rows:
                near = _nearest(_matrix(batch.column(1), width).astype(np.float64), centres)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int32())], ["id", "v", "centre"])

    def name(k: int) -> int:
        return (TaskContext.get().partitionId() << 32) + k

    def index_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, (ids, x) in enumerate(_in_parts(batches, width, stretch)):
            high, low = bounds_of(x, block)
            x = _narrow(x)
            row = (name(k), ids.tobytes(), x.tobytes(), x.dtype.str, len(high), high.tobytes(), low.tobytes())
            yield _packed([row], ["stretch", "ids", "rows", "kind", "blocks", "high", "low"], [pa.int64(), pa.binary(), pa.binary(), pa.string(), pa.int32(), pa.binary(), pa.binary()])

    def chunks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seed_ids, seeds, _ = shared.value
        for n, (ids, q) in enumerate(_in_parts(batches, width, chunk)):
            floor = floors(q, ids, seeds, seed_ids, k)
            q = _narrow(q)
            yield _packed([(name(n), ids.tobytes(), q.tobytes(), q.dtype.str, floor.tobytes())], ["chunk", "q_ids", "q_rows", "q_kind", "floor"], [pa.int64(), pa.binary(), pa.binary(), pa.string(), pa.binary()])

    def panels_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def whole() -> pa.RecordBatch:
            high, low = (b"".join(r[c] for r in held) for c in ("high", "low"))
            row = (name(made), [r["stretch"] for r in held], [r["blocks"] for r in held], high, low)
            return _packed([row], ["panel", "stretches", "blocks", "high", "low"], [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary()])

        made = 0
        for batch in batches:
            for row in batch.to_pylist():
                held.append(row)
                if sum(r["blocks"] for r in held) >= panel:
                    yield whole()
                    held, made = [], made + 1
        if held:
            yield whole()

    stretches, chunks = -(-shape["n"] // stretch), -(-shape["q"] // chunk)
    near = rows.select("id", "v").mapInArrow(place, "id long, v array<long>, centre int")
    index = near.repartitionByRange(stretches, "centre", "id").sortWithinPartitions("centre", "id").select("id", "v")
    index = common.materialize(index.mapInArrow(index_of, "stretch long, ids binary, rows binary, kind string, blocks int, high binary, low binary"), "topk-index")
    asked = queries.repartitionByRange(chunks, "id").sortWithinPartitions("id")
    asked = common.materialize(asked.mapInArrow(chunks_of, "chunk long, q_ids binary, q_rows binary, q_kind string, floor binary"), "topk-queries")
    panels = index.select("stretch", "blocks", "high", "low").repartition(-(-stretches * stretch // (block * panel)))
    panels = common.materialize(panels.mapInArrow(panels_of, "panel long, stretches array<long>, blocks array<int>, high binary, low binary"), "topk-panels")
    # names only, a row for thousands of queries or a million vectors: every panel meets every chunk under a key of their own
    panel_names = [r[0] for r in panels.select("panel").collect()]
    chunk_names = [r[0] for r in asked.select("chunk").collect()]
    left = panels.withColumn("chunk", F.explode(F.lit(chunk_names)))
    right = asked.withColumn("panel", F.explode(F.lit(panel_names)))
    pairs = left.join(right.hint("shuffle_hash"), ["panel", "chunk"]).select("stretches", "blocks", "high", "low", "q_ids", "q_rows", "q_kind", "floor")

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                q_ids, floor = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["floor"], np.int64)
                q = np.frombuffer(row["q_rows"], row["q_kind"]).reshape(-1, width)
                high, low = (np.frombuffer(row[c], np.int64).reshape(-1, width) for c in ("high", "low"))
                ends = np.cumsum(row["blocks"])
                for name_of, a, b in zip(row["stretches"], ends - row["blocks"], ends, strict=True):
                    best = upper(q, high[a:b], low[a:b]).max(axis=1)
                    own = np.flatnonzero(best >= floor)
                    if len(own):
                        yield _packed([(name_of, q_ids[own].tobytes(), q[own].tobytes(), row["q_kind"], floor[own].tobytes())], ["asked", "q_ids", "q_rows", "q_kind", "floor"], [pa.int64(), pa.binary(), pa.binary(), pa.string(), pa.binary()])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                q_ids, q = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["q_rows"], row["q_kind"]).reshape(-1, width).astype(np.int64)
                x_ids, x = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["rows"], row["kind"]).reshape(-1, width).astype(np.int64)
                place, ids, scores = search(q, q_ids, x, x_ids, np.frombuffer(row["floor"], np.int64), k, block)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[place], pa.int64()), pa.array(ids, pa.int64()), pa.array(scores, pa.int64())], ["query_id", "vec_id", "score"])

    # rows are large here, so few go to a worker at once
    key, row_bytes = "spark.sql.execution.arrow.maxRecordsPerBatch", 8 * width * (max(stretch, 2 * panel) + chunk)
    before = spark.conf.get(key)
    spark.conf.set(key, str(max(1, AT_ONCE // row_bytes)))
    try:
        reached = common.materialize(pairs.mapInArrow(reach, "asked long, q_ids binary, q_rows binary, q_kind string, floor binary"), "topk-reached")
        met = reached.join(index.select("stretch", "ids", "rows", "kind").hint("shuffle_hash"), F.col("asked") == F.col("stretch"))
        met = met.select("q_ids", "q_rows", "q_kind", "floor", "ids", "rows", "kind")
        found = common.materialize(met.mapInArrow(score, "query_id long, vec_id long, score long"), "topk-found")
    finally:
        spark.conf.set(key, before)
    common.discard(*([rows] if names is None else []), index, asked, panels, reached)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    ranked = ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    for column in ("query_id", "vec_id") if names is not None else ():
        ranked = ranked.join(names.select(F.col("name").alias(column), F.col("id").alias("_own")), column).drop(column).withColumnRenamed("_own", column)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op9_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(common.read(spark, sf_dir, "embeddings"), F.pmod("id", F.lit(20)) == 0)


OP9_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, [floor(64 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, k::INT AS rank, vec_id, score FROM r WHERE k <= 20
"""
