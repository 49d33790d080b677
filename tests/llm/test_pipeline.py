import corpus_pipeline
from episodica.llm import mixing, packing, quality, toxicity

from .helpers import rows_of

DATA = "/root/testdata/sf0.01"


def test_stages_keep_columns_and_decide(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, docs
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, DATA).cache()
        assert after.columns == columns, name
        kept.append((name, before, after))
        before = after
    ids = lambda df: {r["doc_id"] for r in rows_of(df.select("doc_id"))}
    _, a, b = kept[0]
    assert ids(b) == {r["doc_id"] for r in rows_of(quality.with_quality(a).where(f"quality >= {quality.KEEP}"))}
    _, a, b = kept[1]
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    assert ids(b) == {r["doc_id"] for r in rows_of(toxicity.with_severity(a, labels).where(f"severity.toxic < {toxicity.TOXIC}"))}
    from .test_ngram_join import brute

    _, a, b = kept[2]
    rows = rows_of(a.select("doc_id", "text"))
    want = {c for c, _ in brute([r["doc_id"] for r in rows], [r["text"] for r in rows]).values()}
    assert ids(b) == want and b.count() == len(want)
    _, a, b = kept[3]
    plan = {r["doc_id"]: r["copies"] for r in rows_of(_copies(a))}
    got = {r["doc_id"]: r["count"] for r in rows_of(b.groupBy("doc_id").count())}
    assert got == {k: v for k, v in plan.items() if v}
    last = corpus_pipeline.STAGES[-1][1](spark, before, DATA)
    pieces = packing.tokenized_pieces(before)
    assert last.count() == pieces.count() and last.agg({"length": "sum"}).first()[0] == pieces.agg({"length": "sum"}).first()[0]


def _copies(df):
    sized = mixing.sized_rows(df)
    return mixing.with_copies(sized, mixing.source_plan(sized))


def test_empty(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, DATA).count() == 0


def test_rows_of_every_kind_go_through(spark):
    """Null and repeated ids, null, empty and very long texts, null sources, and columns named as the stages' own."""
    line = "The text of number {} and what it is for. It was read by the staff in the town, and by others of the place. "
    rows = [(i, line.format(i) * (1 + i % 3), "en", "a" if i % 3 else None, 9) for i in range(60)]
    rows += [(None, line.format("none"), None, "b", None), (None, line.format("other") * 2, "en", "b", 1), (7, line.format("seven again"), "en", "b", 1)]
    rows += [(100, None, "en", "a", 0), (101, "", "en", "a", 0), (102, "long words of a text. " * 40_000, "en", "c", 1), (3, line.format(3), "en", "a", 9)]
    extra = "1 AS quality, 2 AS severity, 3 AS h, 4 AS copies, 5 AS seed, 6 AS size, 7 AS length, 8 AS `set`, 9 AS class_id"
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", *extra.split(", "))
    columns, before = docs.columns, docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = stage(spark, before, DATA)
        assert before.columns == columns
    ids = {r["doc_id"] for r in rows_of(before.select("doc_id"))}
    assert not ids & {100, 101} and len(ids) > 20
    last = rows_of(corpus_pipeline.STAGES[-1][1](spark, before, DATA))
    places = {}
    for r in last:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in places.values():
        ends = [0] + [a + n for a, n in sorted(parts)]
        assert [a for a, _ in sorted(parts)] == ends[:-1] and ends[-1] <= packing.CAPACITY
