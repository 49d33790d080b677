"""The telemetry source: round trips, what it refuses, and what a failed job leaves."""

import io
import json
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from episodica.sources import archives


@pytest.fixture(scope="module")
def source(spark):
    spark.dataSource.register(archives.Telemetry)
    return spark


def save(df, path):
    df.write.format("telemetry").mode("append").save(str(path))


def load(spark, path, schema=None):
    reader = spark.read.format("telemetry")
    return (reader.schema(schema) if schema else reader).load(str(path))


def rows(df):
    return sorted(map(tuple, df.collect()))


def sample(spark, n=300):
    return spark.range(n).select("id", (F.col("id") / 3).alias("x"), (F.col("id") % 2 == 0).alias("even"), F.array(F.col("id").cast("float"), F.lit(1).cast("float")).alias("v"))


def test_round_trip(source, tmp_path, monkeypatch):
    df = sample(source)
    save(df.repartition(3), tmp_path / "a")
    back = load(source, tmp_path / "a")
    assert rows(back) == rows(df) and [f.dataType for f in back.schema] == [f.dataType for f in df.schema]
    assert rows(load(source, "file://" + str(tmp_path / "a"), "id long")) == rows(df.select("id"))
    save(df, tmp_path / "a")  # a second job adds to the first
    assert load(source, tmp_path / "a").count() == 600
    save(df.limit(0), tmp_path / "none")
    assert load(source, tmp_path / "none").count() == 0


def test_archives_are_bounded(source, tmp_path):
    save(source.range(archives.ROWS * 2 + 5).coalesce(1), tmp_path / "a")
    (listed,) = (tmp_path / "a" / archives.PUBLISHED).glob("*.json")
    parts = json.loads(listed.read_text())["parts"]
    assert sum(p["rows"] for p in parts) == archives.ROWS * 2 + 5 and max(p["rows"] for p in parts) <= archives.ROWS


def test_refused_on_writing(source, tmp_path):
    df = sample(source)
    save(df, tmp_path / "a")
    with pytest.raises(Exception, match="never replaced"):
        df.write.format("telemetry").mode("overwrite").save(str(tmp_path / "a"))
    for bad, why in (
        (df.select(F.col("id").cast("string").alias("t")), "not numeric"),
        (df.select(F.when(F.col("id") > 5, F.col("id")).alias("x")), "nulls"),
        (df.select(F.sequence(F.lit(0), F.col("id") % 3).alias("v")), "unequal length"),
    ):
        with pytest.raises(Exception, match=why):
            save(bad, tmp_path / "b")
        assert not list((tmp_path / "b").rglob("*.json"))
    assert rows(load(source, tmp_path / "a")) == rows(df)


def test_a_failed_task_leaves_nothing(source, tmp_path):
    broken = sample(source).repartition(4).withColumn("x", F.when(F.col("id") == 299, F.raise_error(F.lit("lost")).cast("double")).otherwise(F.col("x")))
    with pytest.raises(Exception, match="lost"):
        save(broken, tmp_path / "a")
    assert not list(Path(tmp_path).rglob("*.json"))
    with pytest.raises(Exception, match="nothing is published"):
        load(source, tmp_path / "a").count()
    save(sample(source), tmp_path / "a")
    (tmp_path / "a" / "stray.npz").write_bytes(b"not listed")
    assert load(source, tmp_path / "a").count() == 300


def archive(**arrays):
    packed = io.BytesIO()
    np.savez_compressed(packed, **arrays)
    return packed.getvalue()


def test_refused_on_reading(source, tmp_path):
    save(source.range(3).coalesce(1), tmp_path / "a")
    (part,) = (tmp_path / "a").glob("*.npz")
    told = np.array(json.dumps({"fields": ["id"], "rows": 3}))
    for content in (
        b"PK broken",
        archive(manifest=told, id=np.array([{}, {}, {}], dtype=object)),  # a pickle
        archive(manifest=told, id=np.arange(3), more=np.arange(3)),
        archive(manifest=told),
        archive(manifest=told, id=np.arange(2)),
        archive(manifest=told, id=np.array(["a", "b", "c"])),
        archive(manifest=np.array('{"fields": ["id"], "rows": NaN}'), id=np.arange(3)),
    ):
        part.write_bytes(content)
        with pytest.raises(Exception, match=part.name):
            load(source, tmp_path / "a").count()
    part.write_bytes(archive(manifest=told, id=np.arange(3)))
    assert rows(load(source, tmp_path / "a")) == [(0,), (1,), (2,)]
