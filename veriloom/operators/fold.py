"""Ordered folds over the rows of a key: what a window cannot say, since each step needs the last."""

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

Step = Callable[[tuple | None, tuple], tuple[tuple, object]]


def fold(df: DataFrame, keys: Sequence[str], order: Sequence[str], read: Sequence[str], step: Step, name: str, kind: str) -> DataFrame:
    """``df`` with a column ``name`` of the type ``kind`` (int, long or boolean): the rows of each key
    are read in ``order``, and ``step(state, row)`` gives the next state and the row's value; ``row``
    holds the columns ``read``, and the state of a key's first row is None.

    Rows are dealt out by key and sorted, and each task goes once over its rows with one state, so a
    key of any number of rows needs no more memory than one of few, and time in proportion.
    """
    kinds = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            values = []
            of = zip(*(batch.column(c).to_pylist() for c in keys))
            for key, row in zip(of, zip(*(batch.column(c).to_pylist() for c in read))):
                if key != last:
                    last, state = key, None
                state, value = step(state, row)
                values.append(value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, kinds[kind])], [*batch.schema.names, name])

    dealt = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return dealt.mapInArrow(run, f"{columns}, `{name}` {kind}")
