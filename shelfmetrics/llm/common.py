"""Small helpers shared by the operators."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A new folder under the one that all executors share: spark.checkpoint.dir, or where that is unset one of the warehouse.

    A warehouse on the driver's own disk serves only a session on one machine; elsewhere it is refused.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            folder = f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"
            if not context.master.startswith("local") and (folder.startswith(("/", "file:"))):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder)
    return f"{context._jsc.sc().getCheckpointDir().get()}/stored-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: it is computed once, whatever executors are lost later."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()
ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Gives the executors this subpackage, once a session, so that they need no installation of the library.

    Documents are long rows: where the session leaves the number of rows in a batch at its default, batches become smaller.
    """
    if spark.conf.get(ROWS) == "10000":
        spark.conf.set(ROWS, "2000")
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        here = Path(__file__).parent
        path = Path(tempfile.mkdtemp(prefix="ship-")) / f"{here.name}.zip"
        with zipfile.ZipFile(path, "w") as z:
            z.write(here.parent / "__init__.py", f"{here.parent.name}/__init__.py")
            for f in sorted(here.glob("*.py")):
                z.write(f, f"{here.parent.name}/{here.name}/{f.name}")
        spark.sparkContext.addPyFile(str(path))
        _SHIPPED.add(app)


def texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text), null text as the empty string; other columns play no part."""
    ship(df.sparkSession)
    return df.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))


def by_bytes(batches: Iterator[pa.RecordBatch], most: int, text: str = "text") -> Iterator[pa.RecordBatch]:
    """The rows of the batches in slices of about `most` bytes of text, so that a worker's memory does not follow the batch size."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pa.compute.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False).cumsum()
        at = 0
        while at < n:
            done = sizes[at - 1] if at else 0
            upto = max(at + 1, int(sizes.searchsorted(done + most, "right")))
            yield batch.slice(at, upto - at)
            at = upto


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


Query = Callable[[SparkSession, str], DataFrame]
