"""Row-wise maps over a text column with bounded memory, shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

#: Rows that are turned into Python objects and answered at a time.
SLICE_ROWS = 128


def map_rows(df: DataFrame, keys: list[str], inputs: list[str], make: Callable[[], Callable], schema: StructType) -> DataFrame:
    """One output row for each row of ``df``: the ``keys`` as they are, then the fields of ``schema``.

    ``make`` runs once a task and returns a function from the values of ``inputs`` to a tuple for ``schema``. Only the
    named columns travel, so whatever else the table holds, clashing names included, plays no part.
    """
    out = StructType([StructField(f"k{i}", df.schema[c].dataType) for i, c in enumerate(keys)] + list(schema.fields))
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = to_arrow_schema(out)
    nk, n = len(keys), len(keys) + len(inputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                rows = [f(*x) for x in zip(*(part.column(i).to_pylist() for i in range(nk, n)), strict=True)]
                cols = [part.column(i).cast(fields.field(i).type) for i in range(nk)]
                cols += [pa.array([r[j] for r in rows], type=fields.field(nk + j).type) for j in range(len(schema.fields))]
                yield pa.RecordBatch.from_arrays(cols, schema=fields)

    narrow = df.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keys)], *[F.col(f"`{c}`").alias(f"v{i}") for i, c in enumerate(inputs)])
    return narrow.mapInArrow(run, out).withColumnsRenamed({f"k{i}": c for i, c in enumerate(keys)})


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until ``df`` has no column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def let(value, body):
    """``body(value)`` with ``value`` computed once for a row, inside one expression."""
    return F.element_at(F.transform(F.array(value), body), 1)
