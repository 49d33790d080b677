"""Small tables for the operators' tests."""


def docs(spark, rows, extra=""):
    """rows of (doc_id, text, source)."""
    return spark.createDataFrame(rows, "doc_id long, text string, source string" + extra)


def rows_of(df):
    return [r.asDict() for r in df.collect()]
