"""One pass over whole texts that adds columns, without a shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from rxcover.llm.textvec import text_chunks

Compute = Callable[[np.ndarray, np.ndarray], Sequence]


def with_text_columns(
    docs: DataFrame,
    carry: Sequence[str],
    added: Sequence[StructField],
    prepare: Callable[[], Compute],
    text: str = "text",
) -> DataFrame:
    """The `carry` columns and the `added` ones.

    `prepare()` is called once per task and gives a function that gets the bytes
    and row offsets of about half a MB of texts and returns the added values, a
    sequence per column. Carried columns named like an added one are replaced.
    The text column goes to the tasks once, carried or not.
    """
    names = [f.name for f in added]
    carry = [c for c in carry if c not in names]
    fields = {f.name: f for f in docs.schema.fields}
    schema = StructType([*[fields[c] for c in carry], *added])
    kinds = [_arrow(f) for f in added]
    source = text if text in carry else "_text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = prepare()
        for batch in batches:
            for first, data, offsets in text_chunks(batch.column(source)):
                n = len(offsets) - 1
                out = [pa.array(v, kind) for v, kind in zip(compute(data, offsets), kinds)]
                kept = [batch.column(c).slice(first, n) for c in carry]
                yield pa.RecordBatch.from_arrays([*kept, *out], [*carry, *names])

    return docs.select(*carry, *([] if text in carry else [F.col(text).alias("_text")])).mapInArrow(run, schema)


def _arrow(field: StructField) -> pa.DataType:
    kinds = {"double": pa.float64(), "bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
    return kinds[field.dataType.simpleString()]
