"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Text handed to one call of a column function; a single longer text still goes as one.
SLICE_BYTES = 4 << 20

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def utf8(text: str | None) -> bytes:
    """The text's UTF-8 bytes; null counts as empty."""
    return text.encode("utf-8", "surrogatepass") if text else b""


def lower_ascii(data: bytes) -> bytes:
    """A-Z to a-z, every other byte as it is."""
    return data.translate(_LOWER)


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts come to about `limit` bytes."""
    start, held = 0, 0
    for i, value in enumerate(column):
        held += value.as_buffer().size if value.is_valid else 0
        if held >= limit:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(column):
        yield start, len(column)


def append_columns(docs: DataFrame, fields: Sequence[T.StructField], make: Callable[[], Callable[[list], Sequence]], text: str = "text", also: Sequence[str] = (), slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """`docs` with `fields` added, computed from the text column inside the tasks; rows neither move nor merge.

    `make` runs once a task and returns a function from a list of texts (None for null), and a list for each column of
    `also`, to one list for each field.
    An input column that has the name of a new field is replaced."""
    names = {f.name for f in fields}
    kept = [f for f in docs.schema.fields if f.name not in names]
    added = to_arrow_schema(T.StructType(list(fields)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            compute = compute or make()
            at = batch.schema.get_field_index(text)
            for lo, hi in slices(batch.column(at), slice_bytes):
                part = batch.slice(lo, hi - lo)
                made = compute(part.column(at).to_pylist(), *[part.column(batch.schema.get_field_index(c)).to_pylist() for c in also])
                arrays = [part.column(batch.schema.get_field_index(f.name)) for f in kept]
                arrays += [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(made, added, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in kept] + added.names)

    return docs.mapInArrow(run, T.StructType(kept + list(fields)))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the folder of spark.checkpoint.dir; sets one only where the session has none."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    return df.checkpoint(eager=True)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not context.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="dimtrail-")
        context.setCheckpointDir(folder)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
