"""What the training-data operators share: the shared folder, staged tables, Arrow maps and what a worker keeps."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CHECKPOINT_DIR = "spark.checkpoint.dir"
#: Bytes of input that an explicitly dealt partition should have.
PARTITION_BYTES = 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """A new folder name under the cluster's shared folder.

    The cluster names that folder in ``spark.checkpoint.dir``. Where it is unset a local session, as
    in tests, gets one on this machine; on a cluster that is an error, as executors share no disk.
    """
    root = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(CHECKPOINT_DIR)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError(f"{CHECKPOINT_DIR} must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="lagweave-")
        spark.conf.set(CHECKPOINT_DIR, root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again: lineage ends, executors may be lost."""
    path = f"{shared_dir(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_staged(df: DataFrame) -> None:
    """Delete the files of a staged table that is no longer read."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()[:1]}:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def col(name: str) -> Column:
    """A column by its whole name, dots and all."""
    return F.col(quoted(name))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def fresh(prefix: str, *taken: str) -> str:
    """``prefix``, lengthened until no name in ``taken`` is like it."""
    lower = {t.lower() for t in taken}
    while prefix.lower() in lower:
        prefix += "_"
    return prefix


def partitions(df: DataFrame, each: int = PARTITION_BYTES, growth: int = 1) -> int:
    """Partitions for an explicit deal of what ``df`` grows to: those of the session, or more where the tables that it reads are larger."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-growth * sum(s for s in sizes if s < 1 << 50) // each))  # what has no statistics counts as endless


def join_spread(rows: DataFrame, table: DataFrame, key: str, n: str, total: int, hot: int = 1000) -> DataFrame:
    """``rows`` with ``table``'s columns by ``key``; ``table`` has every key once, and in ``n`` how many of the ``total`` rows have it.

    Keys of over a ``hot``-th of all rows, fewer than ``hot`` of them whatever the size, are broadcast:
    their rows stay where they are, and no task gets more than a ``hot``-th of the rows for one key.
    """
    often = F.broadcast(table.filter(F.col(n) * hot > total))
    return rows.join(often.drop(n), key).unionByName(rows.join(often.select(key), key, "left_anti").join(table.filter(F.col(n) * hot <= total).drop(n), key))


_kept: dict = {}


def kept(name: tuple, make: Callable[[], object]):
    """What ``make`` gives, kept by a worker from task to task; asking for another name drops what was kept before."""
    if name not in _kept:
        _kept.clear()
        release()
        _kept[name] = make()
    return _kept[name]


def forget() -> None:
    """Drop what earlier stages kept in this worker."""
    if _kept:
        _kept.clear()
        release()


def release() -> None:
    """Give freed memory back to the system, so that a worker that waits for tasks holds only what it keeps."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # other systems' libraries do without it
        return


def slices(batches: Iterator[pa.RecordBatch], text: str, most_bytes: int = 4_000_000, arrow: bool = False) -> Iterator[tuple[pa.RecordBatch, list | pa.Array]]:
    """Slices of Arrow batches whose ``text`` column holds about ``most_bytes`` at most (one row at least), with its values as a list or, if ``arrow``, as they are."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        step = batch.num_rows if column.nbytes <= most_bytes else max(1, batch.num_rows * most_bytes // column.nbytes)
        for at in range(0, batch.num_rows, max(step, 1)):
            part = batch.slice(at, step)
            found = part.column(part.schema.get_field_index(text))
            yield part, found if arrow else found.to_pylist()


def runs_by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Runs of whole groups of a stream that is sorted by its first column, as lists of columns."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=pa.types.is_integer(c.type)) for c in batch.columns]
        if not len(columns[0]):
            continue
        cut = int(np.searchsorted(columns[0], columns[0][-1], "left"))
        if held and (cut or columns[0][0] != held[-1][0][-1]):
            yield [np.concatenate(c) for c in zip(*held, [c[:cut] for c in columns], strict=True)]
            held, columns = [], [c[cut:] for c in columns]
        elif cut:
            yield [c[:cut] for c in columns]
            columns = [c[cut:] for c in columns]
        held.append(columns)
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def arrow_map(df: DataFrame, text: str, row_columns: list[str], work: Callable[[list], dict] | None, schema: str, setup: Callable | None = None, arrow: bool = False) -> DataFrame:
    """``row_columns`` of ``df`` beside the columns that ``work(texts)`` makes, one value a row.

    ``setup`` makes ``work`` in the worker if given; ``work`` gets a list, or an Arrow array if
    ``arrow``. Whole texts go through, in slices bounded by bytes.
    """
    # Columns go through under names of their own: Spark's maps don't take names with dots.
    source = df.select(*(col(c).alias(f"c{k}") for k, c in enumerate(row_columns)), col(text).alias("text"))
    own = source.schema.fields[: len(row_columns)]
    new = StructType.fromDDL(schema).fields

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        do = setup() if setup else work
        for part, texts in slices(batches, "text", arrow=arrow):
            made = do(texts)
            columns = [*part.columns[:-1], *(made[f.name] for f in new)]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c) for c in columns], names=[f.name for f in (*own, *new)])
        release()

    return source.mapInArrow(run, StructType([*own, *new])).toDF(*row_columns, *(f.name for f in new))
