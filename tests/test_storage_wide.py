"""Rows of up to megabytes on their way through the shared folder and Arrow."""

import random

import pyarrow as pa
import pyarrow.parquet as pq

from shelfspark.sources.storage import few_rows_at_once, stage


def test_large_rows_are_held_a_few_at_a_time(spark):
    def large(batches):
        for batch in batches:
            for i in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_pydict({"id": [i], "x": [random.Random(i).randbytes(500_000)]})

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"rows": pa.array([batch.num_rows], pa.int64())})

    staged = stage(spark.range(0, 40, 1, 1).mapInArrow(large, "id LONG, x BINARY"), wide=True)
    file = pq.ParquetFile(staged.inputFiles()[0].removeprefix("file://"))
    assert file.metadata.num_rows == 40 and file.metadata.num_row_groups > 1
    with few_rows_at_once(spark):
        held = [r["rows"] for r in staged.mapInArrow(sizes, "rows LONG").collect()]
    assert sum(held) == 40 and max(held) < 20
    assert max(r["rows"] for r in staged.coalesce(1).mapInArrow(sizes, "rows LONG").collect()) == 40
