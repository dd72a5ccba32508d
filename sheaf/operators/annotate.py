"""Run user-supplied enrichment functions over payloads."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

from sheaf.schemas import SERVICE_VERSION

# Bytes of rows that a function is called with at most; a single larger row comes alone.
BATCH_BYTES = 64_000_000


def slices(batch: pa.RecordBatch, most: int):
    """Consecutive slices of at most ``most`` bytes each; a row above that is a slice of its own."""
    start = 0
    while start < batch.num_rows:
        rows = batch.num_rows - start
        while rows > 1 and batch.slice(start, rows).nbytes > most:
            rows = -(-rows // 2)
        yield batch.slice(start, rows)
        start += rows


def annotate(
    files: DataFrame,
    services: dict[str, Callable],
    partitions: int | None = None,
    batch_bytes: int = BATCH_BYTES,
) -> DataFrame:
    """``(uuid, service, version)`` from the functions named in ``services``.

    ``files`` has a column ``service``; each function takes a pandas frame of that service's rows, of
    at most ``batch_bytes`` bytes, and gives a frame with ``uuid`` and ``version``. A service without
    a function, or none at all, fails the job. Rows are spread over tasks as they come, not by
    service: there are few services, and one task each would be the bottleneck.
    """
    import pandas as pd

    columns, types = SERVICE_VERSION.names, to_arrow_schema(SERVICE_VERSION)

    def run(batches):
        for batch in batches:
            for part in slices(batch, batch_bytes):
                for service, rows in part.to_pandas().groupby("service", sort=True, dropna=False):
                    if pd.isna(service) or service not in services:
                        raise ValueError(f"no function for service {service!r}")
                    out = pd.DataFrame(services[service](rows.reset_index(drop=True)))
                    out = out[["uuid", "version"]].assign(service=service)[columns]
                    yield pa.RecordBatch.from_pandas(out, schema=types, preserve_index=False)

    if partitions:
        files = files.repartition(partitions)
    return files.mapInArrow(run, SERVICE_VERSION)
