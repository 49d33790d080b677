"""Numeric columns as NPZ archives: a data source, ``telemetry``, whose writer publishes all of a job's files or none.

    spark.dataSource.register(Telemetry)
    df.write.format("telemetry").mode("append").save(path)
    spark.read.format("telemetry").load(path)                       # every column
    spark.read.format("telemetry").schema("vec_id long").load(path)  # only arrays asked for are decompressed

A task writes archives of at most ``ROWS`` rows under names of their own; ``commit`` writes one manifest that lists them,
and readers see nothing else, so parts of failed, repeated or speculative tasks stay invisible. ``abort`` removes the
parts it is told of. Nothing is ever replaced: mode overwrite is refused.

An archive holds one array for each column and ``manifest``, a strict JSON text (fields, rows). Columns are booleans,
integers, floats, or arrays of these of one length within an archive; nulls and ragged arrays are refused on writing.
On reading, another set of arrays than the fields, arrays of objects (pickles), arrays of unequal length and broken files
fail the task with the file's name. Paths are URIs that pyarrow's file systems know, or folders that all tasks share.
"""

from __future__ import annotations

import io
import json
import uuid
from dataclasses import dataclass

from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

ROWS = 1 << 16
PUBLISHED = "_published"
_NUMBERS = (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)


def _system(path: str):
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path[5:])
    return fs.LocalFileSystem(), path


def _strict(text: str) -> dict:
    def refuse(name):
        raise ValueError(f"{name} in a manifest")

    return json.loads(text, parse_constant=refuse)


def _checked(schema: T.StructType) -> T.StructType:
    for f in schema.fields:
        kind = f.dataType.elementType if isinstance(f.dataType, T.ArrayType) else f.dataType
        if not isinstance(kind, _NUMBERS) or f.name == "manifest":
            raise ValueError(f"column {f.name} is not numeric")
    return schema


def _manifests(path: str) -> list[dict]:
    from pyarrow import fs

    system, root = _system(path)
    found = system.get_file_info(fs.FileSelector(f"{root}/{PUBLISHED}", allow_not_found=True))
    out = []
    for info in sorted(found, key=lambda i: i.path):
        if info.path.endswith(".json"):
            with system.open_input_stream(info.path) as f:
                out.append(_strict(f.readall().decode()))
    return out


class Telemetry(DataSource):
    @classmethod
    def name(cls) -> str:
        return "telemetry"

    def schema(self) -> T.StructType:
        found = _manifests(self.options["path"])
        if not found:
            raise ValueError(f"nothing is published in {self.options['path']}")
        if any(m["schema"] != found[0]["schema"] for m in found):
            raise ValueError("the published parts differ in their columns")
        return T.StructType.fromJson(found[0]["schema"])

    def reader(self, schema: T.StructType) -> Reader:
        return Reader(self.options["path"], schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> Writer:
        if overwrite:
            raise ValueError("published archives are never replaced")
        return Writer(self.options["path"], _checked(schema))


@dataclass
class Archive(InputPartition):
    path: str
    fields: list[str]
    rows: int


class Reader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType):
        self.path, self.schema = path, schema

    def partitions(self) -> list[InputPartition]:
        # one partition an archive, whose rows are bounded
        return [Archive(p["name"], [f["name"] for f in m["schema"]["fields"]], p["rows"]) for m in _manifests(self.path) for p in m["parts"]]

    def read(self, partition: Archive | None):
        if partition is None:  # what the engine asks for where no archive is listed
            return
        import numpy as np
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        system, root = _system(self.path)
        with system.open_input_file(f"{root}/{partition.path}") as f:
            content = io.BytesIO(f.readall())
        target = to_arrow_schema(self.schema)
        try:
            with np.load(content, allow_pickle=False) as archive:
                if set(archive.files) != {*partition.fields, "manifest"}:
                    raise ValueError("another set of arrays than the published fields")
                manifest = _strict(str(archive["manifest"]))
                if manifest != {"fields": partition.fields, "rows": partition.rows}:
                    raise ValueError("its manifest is not the published one")
                columns = []
                for field in target:
                    values = archive[field.name]
                    if values.dtype.kind not in "biuf" or values.ndim not in (1, 2) or len(values) != partition.rows:
                        raise ValueError(f"{field.name} is no numeric array of {partition.rows} rows")
                    if values.ndim == 2:
                        flat = pa.array(values.reshape(-1))
                        values = pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), flat)
                    columns.append(pa.array(values).cast(field.type))
        except Exception as error:
            raise ValueError(f"{partition.path}: {error}") from error
        yield pa.RecordBatch.from_arrays(columns, schema=target)


@dataclass
class Parts(WriterCommitMessage):
    parts: list[dict]


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str, schema: T.StructType):
        self.path, self.kind, self.job = path, schema.jsonValue(), uuid.uuid4().hex

    def write(self, iterator) -> Parts:
        system, root = _system(self.path)
        system.create_dir(root, recursive=True)
        parts, held, rows = [], [], 0
        try:
            for batch in iterator:
                for at in range(0, batch.num_rows, ROWS):
                    piece = batch.slice(at, ROWS)
                    if held and rows + piece.num_rows > ROWS:
                        parts.append(self._archive(system, root, held))
                        held, rows = [], 0
                    held.append(piece)
                    rows += piece.num_rows
            if held:
                parts.append(self._archive(system, root, held))
        except BaseException:
            self._remove(system, root, parts)
            raise
        return Parts(parts)

    def _archive(self, system, root: str, batches) -> dict:
        import numpy as np
        import pyarrow as pa

        table = pa.Table.from_batches(batches).combine_chunks()
        arrays = {}
        for name, column in zip(table.column_names, table.columns, strict=True):
            whole = column.combine_chunks()
            whole = whole.chunk(0) if isinstance(whole, pa.ChunkedArray) else whole
            wide = pa.types.is_list(whole.type)
            if wide and len(whole.value_lengths().unique()) > 1:
                raise ValueError(f"{name} holds arrays of unequal length")
            flat = whole.flatten() if wide else whole
            if whole.null_count or flat.null_count:
                raise ValueError(f"{name} holds nulls")
            values = flat.to_numpy(zero_copy_only=False)
            arrays[name] = values.reshape(len(whole), -1) if wide else values
        manifest = json.dumps({"fields": table.column_names, "rows": table.num_rows}, allow_nan=False)
        packed = io.BytesIO()
        np.savez_compressed(packed, manifest=np.array(manifest), **arrays)
        name = f"{self.job}-{uuid.uuid4().hex}.npz"
        with system.open_output_stream(f"{root}/{name}") as f:
            f.write(packed.getvalue())
        return {"name": name, "rows": table.num_rows}

    @staticmethod
    def _remove(system, root: str, parts: list[dict]) -> None:
        for part in parts:
            system.delete_file(f"{root}/{part['name']}")

    def commit(self, messages) -> None:
        system, root = _system(self.path)
        parts = [p for m in messages if m is not None for p in m.parts]
        system.create_dir(f"{root}/{PUBLISHED}", recursive=True)
        text = json.dumps({"schema": self.kind, "parts": parts}, allow_nan=False).encode()
        # written aside and moved, so that no reader meets half a manifest
        aside, place = f"{root}/{self.job}.part", f"{root}/{PUBLISHED}/{self.job}.json"
        with system.open_output_stream(aside) as f:
            f.write(text)
        system.move(aside, place)

    def abort(self, messages) -> None:
        system, root = _system(self.path)
        self._remove(system, root, [p for m in messages if m is not None for p in m.parts])
