"""Columns that only Python can make, beside columns that pass as they are, and tables that are worked out once."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..session import ship


def added(rows: DataFrame, name: str, kind: T.DataType, f: Callable, *columns: str) -> DataFrame:
    """rows with a column of f of the named columns, in Python by Arrow batches; all other columns pass as they are."""
    ship(rows.sparkSession)
    names, arrow = [*rows.columns, name], to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [f(*x) for x in zip(*(b.column(c).to_pylist() for c in columns), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, arrow)], names=names)

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(name, kind)]))


#: Bytes of a table that is broadcast at most.
BROADCAST_BYTES = 16 << 20


def blocks_of(rows: DataFrame, most: int = BROADCAST_BYTES) -> int:
    """How many blocks of `most` bytes the rows' texts and numbers make, which are measured; one if they may be broadcast as a whole."""
    width = lambda f: F.octet_length(F.col(f"`{f.name}`")) if isinstance(f.dataType, (T.StringType, T.BinaryType)) else F.lit(8)
    total = rows.agg(F.sum(sum((F.coalesce(width(f), F.lit(0)) for f in rows.schema), F.lit(16)).cast("long"))).first()[0] or 0
    return max(1, -(-total // most))


def kept(rows: DataFrame) -> DataFrame:
    """rows worked out once and written to the checkpoint folder, which all hosts share (a local session without one gets its own)."""
    sc = rows.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        base = rows.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not base and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set: intermediate tables need a folder that all hosts share")
        sc.setCheckpointDir(base or "file://" + tempfile.mkdtemp(prefix="folioforge-"))
    return rows.checkpoint()
