"""Mixing sources to target weights.

Tokens are aggregated per source, a weighted share with a cap gives each source a target, and a document is emitted
``floor(rate)`` times plus one hash-seeded Bernoulli copy with probability equal to the fraction of the rate. A document's
hash is a place on a circle, and it is copied if it lies in an arc as long as the fraction. Each of ``SEEDS`` seeds turns
the arc by another step; a source takes the seed whose words come nearest its target, so that a source of few or uneven
documents meets its target too. For every one seed the probability of a copy is the fraction; that of the chosen seed is
not, for a long document, since seeds that suit the sum are preferred. Emission is map-only; only sums per source and
step are shuffled.

Defined cases: null text has size 0, a long one is counted whole; a null source is a source of its own, last in order; a
source without words has target 0 and emits nothing; rows that are alike in every column draw one by one (they are counted,
and each place in the count has a draw of its own), as do rows that share an id alone; an empty table gives an empty
result; other columns pass through ``mix_sources``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

WORD = r"[^\x20\x09-\x0D]+"
#: Seeds that a source may take, and the bits of a hash and of a seed's step.
SEEDS = 1024
BITS, STEP_BITS = 52, 42
#: Weights that the sources take in turn.
WEIGHTS = (1, 2, 3)
#: A target stops at so many times its source's size.
MAX_REPEAT = 3
SEED = "mix"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, text: Column, seed: str = SEED, rest: Column | None = None, place: Column | None = None) -> Column:
    """A place on a circle of 2^52 steps, by id, text, a hash of the other columns, and the place among equal rows."""
    other = F.lit("") if rest is None else rest
    return common.hash_bits(F.lit(seed), doc_id, F.md5(text), other, F.lit(1) if place is None else place)


def source_plan(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """One row per source: source_size, target, whole copies, arc and seed of the extra copy.

    ``sized`` has source, size and h (see ``draw``), and is read twice. Sums are partial on the map side; the rows that
    meet are sources times seeds.
    """
    src = common.materialize(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    # the windows without a partition run over sources, not documents
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))).cast("int")
    src = src.withColumn("weight", F.element_at(F.array(*[F.lit(w).cast("double") for w in weights]), turn + 1))
    cap = F.lit(float(max_repeat)) * F.col("source_size")
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    src = (
        src.withColumn("cap", cap)
        .withColumn("before", F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("rest", F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("total", F.sum("source_size").over(fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("before")) / F.col("rest"))
        .withColumn("open_level", F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level")))
        .withColumn("water", F.first("open_level", ignorenulls=True).over(fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .withColumn("target", F.least(F.col("cap"), F.col("weight") * F.col("water")))
        .withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
        .withColumn("whole", F.floor("rate").cast("int"))
        .withColumn("wanted", (F.col("rate") - F.col("whole")) * F.col("source_size"))
        .withColumn("arc", F.floor((F.col("rate") - F.col("whole")) * F.lit(float(1 << BITS))).cast("long"))
        .select("source", "source_size", "target", "whole", "wanted", "arc")
    )
    src = common.materialize(src, "mix-targets")
    named = src.select(F.col("source").alias("s"), "arc")
    of = sized.join(common.maybe_broadcast(named, src.count()), F.col("source").eqNullSafe(F.col("s")))
    step, rest = F.shiftright("h", STEP_BITS).cast("int"), lambda c: F.col(c).bitwiseAND((1 << STEP_BITS) - 1)
    cells = of.groupBy("source", step.alias("step")).agg(F.sum("size").alias("words"), F.sum(F.when(rest("h") < rest("arc"), F.col("size")).otherwise(0)).alias("part"))
    cells = common.materialize(cells.withColumnRenamed("source", "s").withColumnRenamed("step", "at"), "mix-cells")
    steps = src.select("*", F.explode(F.sequence(F.lit(0), F.lit(SEEDS - 1))).alias("step"))
    steps = steps.join(cells, F.col("source").eqNullSafe(F.col("s")) & (F.col("step") == F.col("at")), "left").drop("s", "at")
    run = Window.partitionBy("source").orderBy("step")
    every = Window.partitionBy("source")
    steps = steps.withColumns({"words": F.coalesce("words", F.lit(0)), "part": F.coalesce("part", F.lit(0))})
    steps = common.materialize(steps.withColumns({"before": F.sum("words").over(run) - F.col("words"), "total": F.sum("words").over(every)}), "mix-steps")
    # an arc from step k takes whole steps up to another one, and of that a part
    last = F.col("step") + F.shiftright("arc", STEP_BITS)
    arcs = steps.withColumns({"last": F.pmod(last, F.lit(SEEDS)), "turn": F.when(last >= SEEDS, F.col("total")).otherwise(0)})
    ends = steps.select(F.col("source").alias("s"), F.col("step").cast("long").alias("at"), (F.col("before") + F.col("part")).alias("end"))
    arcs = arcs.join(ends, F.col("source").eqNullSafe(F.col("s")) & (F.col("last") == F.col("at")))
    miss = F.abs(F.col("turn") + F.col("end") - F.col("before") - F.col("wanted"))
    best = F.min_by(F.struct("source_size", "target", "whole", "arc", F.col("step").alias("seed")), F.struct(miss, F.col("step")))
    return arcs.groupBy("source").agg(best.alias("b")).select("source", "b.*")


def with_copies(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """``docs`` (source, h and any other columns) with ``copies``, the times each document is emitted."""
    plan = common.materialize(plan.withColumnRenamed("source", "plan_source"), "mix-plan")
    joined = docs.join(common.maybe_broadcast(plan, plan.count()), docs["source"].eqNullSafe(plan["plan_source"]), "left")
    turned = F.pmod(F.col("h") - F.shiftleft(F.col("seed").cast("long"), STEP_BITS), F.lit(1 << BITS))
    return joined.withColumn("copies", F.col("whole") + (turned < F.col("arc")).cast("int"))


#: Equal rows that one step of counting out makes at once.
RUN = 1 << 16


def _rest(docs: DataFrame) -> Column:
    """A hash of the columns beside doc_id, text and source; empty where there are none."""
    others = [docs[c] for c in docs.columns if c not in ("doc_id", "text", "source")]
    return F.xxhash64(*others).cast("string") if others else F.lit("")


def sized_rows(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, h and (md5, rest, n) of ``docs``, a row for each of its rows, written.

    Equal rows are counted (partly on the map side, so a row that fills a third of the table is one key) and counted out
    again, each with the draw of its place.
    """
    md5, size = F.md5(docs["text"]).alias("md5"), word_count(docs["text"]).alias("size")
    kinds = docs.select("doc_id", "source", md5, _rest(docs).alias("rest"), size).groupBy("doc_id", "source", "md5", "rest", "size").agg(F.count(F.lit(1)).alias("n"))
    runs = kinds.withColumn("run", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / RUN).cast("int"))))
    first = F.col("run").cast("long") * RUN + 1
    rows = runs.withColumn("place", F.explode(F.sequence(first, F.least(first + (RUN - 1), F.col("n")))))
    h = common.hash_bits(F.lit(seed), "doc_id", "md5", "rest", "place")
    return common.materialize(rows.select("doc_id", "source", "size", h.alias("h"), "md5", "rest", "n"), "mix-sizes")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT, seed: str = SEED) -> DataFrame:
    """Emit every document of ``docs`` (doc_id, text, source, ...) as often as the mix takes it, columns unchanged.

    Rows without an equal are decided where they lie. Of rows that have equals one stands for all of them, and is emitted
    as often as they are together.
    """
    sized = sized_rows(docs, seed)
    plan = source_plan(sized, weights, max_repeat)
    key = ["doc_id", "source", "md5", "rest"]
    many = with_copies(sized.where("n > 1"), plan).groupBy(*key).agg(F.sum("copies").alias("all_copies"))
    many = common.materialize(many.select(*[F.col(k).alias(f"m{i}") for i, k in enumerate(key)], "all_copies"), "mix-equal")
    n_many = many.count()
    named = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "source", F.md5(docs["text"]).alias("md5"), _rest(docs).alias("rest"), draw(docs["doc_id"], docs["text"], seed, _rest(docs)).alias("h"))
    same = lambda d: [d[k].eqNullSafe(many[f"m{i}"]) for i, k in enumerate(key)]
    single = with_copies(named.join(common.maybe_broadcast(many, n_many), same(named), "left_anti"), plan).select("row", "copies")
    # of equal rows one is kept by task, then by key
    alike = named.join(common.maybe_broadcast(many, n_many), same(named), "left_semi").groupBy(*key).agg(F.any_value("row").alias("row"))
    alike = alike.join(common.maybe_broadcast(many, n_many), same(alike)).select("row", F.col("all_copies").alias("copies"))
    taken = single.unionAll(alike).where("copies > 0")
    runs = taken.withColumn("run", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / RUN).cast("int"))))
    left = F.least(F.lit(RUN).cast("long"), F.col("copies") - F.col("run").cast("long") * RUN)
    return runs.select("row", F.explode(F.sequence(F.lit(1).cast("long"), left)).alias("copy")).select("row.*")


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = sized_rows(common.read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    out = with_copies(sized, source_plan(sized))
    return out.select(
        "doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target",
        (F.col("size") * F.col("copies")).cast("long").alias("taken"), "source", "copies",
    )


OP3_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(md5(text), '') || '||' ||
           row_number() OVER (PARTITION BY doc_id, source, text)), 1, 13))::BIGINT AS h
  FROM documents),
src0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
src1 AS (SELECT *, ((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight FROM src0),
src2 AS (SELECT *, 3.0::DOUBLE * source_size AS cap FROM src1),
src3 AS (
  SELECT *, coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS before,
         sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest,
         sum(source_size) OVER () AS total
  FROM src2 WINDOW w AS (ORDER BY cap / weight, encode(source) NULLS LAST)),
src4 AS (SELECT *, ((total - before) / rest)::DOUBLE AS level FROM src3),
water AS (SELECT arg_min(level, cap / weight) AS water FROM (
  SELECT *, row_number() OVER (ORDER BY cap / weight, encode(source) NULLS LAST) AS k FROM src4 WHERE level <= cap / weight) WHERE k = 1),
src5 AS (SELECT source, source_size, least(cap, weight * water) AS target FROM src4, water),
src6 AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM src5),
src7 AS (
  SELECT *, floor(rate)::INT AS whole, (rate - floor(rate)) * source_size AS wanted,
         floor((rate - floor(rate)) * 4503599627370496.0::DOUBLE)::BIGINT AS arc
  FROM src6),
cells AS (
  SELECT d.source, (d.h >> 42)::INT AS step, sum(d.size)::BIGINT AS words,
         sum(CASE WHEN d.h & 4398046511103 < s.arc & 4398046511103 THEN d.size ELSE 0 END)::BIGINT AS part
  FROM sized d JOIN src7 s ON d.source IS NOT DISTINCT FROM s.source GROUP BY ALL),
steps AS (
  SELECT s.*, t.step, coalesce(c.words, 0) AS words, coalesce(c.part, 0) AS part,
         coalesce(sum(c.words) OVER (PARTITION BY s.source ORDER BY t.step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         coalesce(sum(c.words) OVER (PARTITION BY s.source), 0) AS total
  FROM src7 s CROSS JOIN range(1024) t(step) LEFT JOIN cells c ON c.source IS NOT DISTINCT FROM s.source AND c.step = t.step),
arcs AS (
  SELECT a.source, a.source_size, a.target, a.whole, a.arc, a.step AS seed,
         row_number() OVER (PARTITION BY a.source ORDER BY abs(
           CASE WHEN a.step + (a.arc >> 42) >= 1024 THEN a.total ELSE 0 END + e.before + e.part - a.before - a.wanted), a.step) AS k
  FROM steps a JOIN steps e ON a.source IS NOT DISTINCT FROM e.source AND (a.step + (a.arc >> 42)) % 1024 = e.step),
plan AS (SELECT * FROM arcs WHERE k = 1),
taken AS (
  SELECT d.*, p.source_size, p.target,
         (p.whole + ((d.h - (p.seed::BIGINT << 42) + 4503599627370496) % 4503599627370496 < p.arc)::INT)::INT AS copies
  FROM sized d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken, source, copies FROM taken
"""
