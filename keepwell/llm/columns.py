"""Small helpers that all operators of this package share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows handed to a per-batch function at once; batches of long texts are cut further by bytes.
SLICE_BYTES = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_HELD: dict[object, object] = {}


def held(key: object, make: Callable[[], object]):
    """``make()``, kept by this Python worker until another key is asked for.

    Tasks of one stage share it; what a worker built for an earlier stage goes
    when the next large table is built, so that such tables do not add up.
    """
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Exactly two columns, ``id`` and ``text`` (as UTF-8 bytes, null stays null); all others are left behind."""
    return docs.select(docs[id_col].alias("id"), docs[text_col].cast("binary").alias("text"))


def schema_of(frame: DataFrame, column: str, *more: tuple[str, str]) -> T.StructType:
    """``column`` with the type it has in ``frame``, then ``more`` as (name, DDL type)."""
    out = T.StructType([T.StructField(column, frame.schema[column].dataType, True)])
    for name, kind in more:
        out = out.add(name, T._parse_datatype_string(kind), True)
    return out


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``most`` bytes of text, or of one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        start = held = 0
        for row, size in enumerate(sizes):
            if held and held + size > most:
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)


def per_text(docs: DataFrame, schema: T.StructType, make: Callable[[], Callable[[bytes | None], tuple]]) -> DataFrame:
    """One row per document: its ``id``, then the values that ``make()(text)`` returns.

    ``make`` runs once per task, so that tables it builds are built once.
    """
    names = schema.names
    kinds = [pa_type(f.dataType) for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = make()
        for batch in slices(batches):
            rows = [one(x) for x in batch.column("text").to_pylist()]
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in names[1:]]
            arrays = [batch.column("id"), *(pa.array(c, type=k) for c, k in zip(cols, kinds[1:], strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.mapInArrow(run, schema)


def pa_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def crc32_mod(id_col: str, m: int):
    """crc32 of the id as text, modulo ``m`` (null for a null id)."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(m))
