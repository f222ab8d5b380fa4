"""What the operators of this subpackage share: the shared folder, and cutting texts into chunks."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A blank after white space: only there does cutting at blanks need care.
_SPACE_THEN_BLANK = re.compile(r"[\s\x1c-\x1f] ")


def small_batches(spark: SparkSession) -> None:
    """Batches that go to Python hold 4 MB from now on, or one row: thousands of rows of text would count twice, in the JVM and in the worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, which must be set on a cluster.

    Where it is unset and all runs in this one process's JVM, as in tests, a temporary folder.
    """
    small_batches(spark)
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = sc.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def run_dir(spark: SparkSession, name: str) -> str:
    """A new path for one run under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, group_rows: int | None = None) -> DataFrame:
    """df written once to the shared folder and read back: cuts the lineage and survives lost executors.

    group_rows: rows that are buffered at most as they are written and read, for rows of several MB.
    """
    spark = df.sparkSession
    path = run_dir(spark, name)
    df.write.options(**{"parquet.block.row.count.limit": group_rows} if group_rows else {}).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Removes the files of a df that stored() gave, once what was made of it is stored itself."""
    sc = df.sparkSession.sparkContext
    for file in df.inputFiles()[:1]:
        folder = sc._jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)


def byte_slices(texts: pa.Array, most: int = 4 << 20) -> Iterator[pa.Array]:
    """texts in slices of so many bytes; a longer text is alone, and whole."""
    held = start = 0
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).tolist()
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield texts.slice(start, i - start)
            held, start = 0, i
        held += n
    if start < len(sizes):
        yield texts.slice(start)


_HOLDER: list = ["", lambda: None]


def hold(owner: str, release: Callable[[], None]) -> None:
    """In a worker: owner's caches may stay from now on; those of the operator that held some before are released.

    Workers outlive tasks, and what one operator keeps is memory that the next one lacks.
    """
    if _HOLDER[0] != owner:
        _HOLDER[1]()
        _HOLDER[:] = [owner, release]
        gc.collect()
        # what was freed goes back to the system, where the C library can do that
        getattr(ctypes.CDLL(None), "malloc_trim", int)(0)


def chunked(text: str) -> tuple[list[str], bool]:
    """text cut at blanks, so that no match of the pre-token pattern is cut apart.

    Returns the chunks and whether they are regular: regular chunks, joined by
    one blank each, are the text; the others, joined by nothing. A cut lies
    only between a non-space character and a blank that a non-space character
    follows; there the pattern always starts a new match with the blank.
    """
    parts = text.split(" ")
    if len(parts) == 1 or not (text[0] == " " or text[-1] == " " or "  " in text or _SPACE_THEN_BLANK.search(text)):
        return parts, True
    out: list[str] = []
    run: list[str] = []
    for i, part in enumerate(parts):
        piece = part if i == 0 else " " + part
        if run and not run[-1][-1:].isspace() and run[-1] != "":
            out.append("".join(run))
            run = []
        run.append(piece)
    out.append("".join(run))
    return [c for c in out if c], False


def joined_by_hot_key(left: DataFrame, right: DataFrame, key: str, weight: str, share: int = 1000) -> DataFrame:
    """left with right's columns; right has one row per key of left and weight, the number of left's rows with it.

    Keys with more than one in share of left's rows are at most share in number: they
    are broadcast. The others' rows are dealt by key; none of those keys is large. Rows of
    hot keys go along under random-looking keys of their own that match nothing.
    """
    total = right.agg(F.sum(weight)).first()[0] or 0
    columns = [c for c in right.columns if c != key]
    hot = right.where(F.col(weight) * share > total)
    named = hot.select(F.col(key).alias("__key"), F.struct(*columns).alias("__hot"))
    with_hot = left.join(F.broadcast(named), F.col(key) == F.col("__key"), "left").drop("__key")
    spread = F.when(F.col("__hot").isNull(), F.concat(F.lit("k"), F.col(key))).otherwise(F.concat(F.lit("h"), F.xxhash64(*left.columns).cast("string")))
    cold = right.where(F.col(weight) * share <= total).select(F.concat(F.lit("k"), F.col(key)).alias("__key"), F.struct(*columns).alias("__cold"))
    both = with_hot.withColumn("__at", spread).join(cold, F.col("__at") == F.col("__key"), "left")
    return both.select(*left.columns, F.coalesce("__hot", "__cold").alias("__got")).select(*left.columns, "__got.*")
