"""What the text operators share: table access, cut lineage, shared files."""

from __future__ import annotations

import atexit
import ctypes
import os
import re
import tempfile
import uuid
from contextlib import contextmanager, suppress
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the operators' contracts fix it: space and \x09-\x0D.
SPACES = "[\\x20\\x09-\\x0D]+"
BATCH_ROWS, SLICE_ROWS = 1000, 250

_made: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of this machine's own only where none is set (tests, local mode)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = getattr(shared_dir, "own", None)
        if base is None:
            base = shared_dir.own = "file://" + tempfile.mkdtemp(prefix="emberline-")
    return base.rstrip("/")


def shared_path(spark: SparkSession, what: str) -> str:
    """A fresh place in the shared folder. It is deleted when the driver exits."""
    path = f"{shared_dir(spark)}/emberline/{what}-{uuid.uuid4().hex[:12]}"
    _made.append((spark, path))
    return path


@atexit.register
def _sweep() -> None:
    for spark, path in _made:
        try:
            drop_path(spark, path)
        except Exception:  # the JVM may have gone first
            return


def drop_path(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def short_batches(spark: SparkSession, rows: int = BATCH_ROWS):
    """Meanwhile Python workers get at most so many rows at once: documents are long, and a worker keeps the memory of
    its largest batch."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(old)) if int(old) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, old)


def thrifty(f):
    """f, a function of batches for mapInArrow, with batches of at most SLICE_ROWS rows, whoever runs the plan; what it took
    is given back to the system at its end, since workers live on and their memory adds up."""

    def run(batches):
        yield from f(part for batch in batches for at in range(0, batch.num_rows, SLICE_ROWS) for part in (batch.slice(at, SLICE_ROWS),))
        pa.default_memory_pool().release_unused()
        with suppress(OSError, AttributeError):  # glibc's
            ctypes.CDLL(None).malloc_trim(0)

    return run


def cut(df: DataFrame, what: str) -> DataFrame:
    """df as a table written to the shared folder and read back: later jobs neither recompute it nor
    depend on any executor's disk."""
    path = shared_path(df.sparkSession, what)
    with short_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def local_form(uri: str) -> str | None:
    """The POSIX path of a file: URI or plain path, None for any other store."""
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]+:", uri):
        parsed = urlparse(uri)
        return unquote(parsed.path) if parsed.scheme == "file" else None
    return uri


def put_file(uri: str, chunks) -> int:
    """Writes chunks to uri and returns the bytes written. The file appears whole or not at all, so a
    repeated or speculative task replaces it by the same bytes."""
    path, size = local_form(uri), 0
    if path is None:
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(uri)
        store.create_dir(os.path.dirname(at), recursive=True)
        draft = f"{at}.{uuid.uuid4().hex[:8]}.draft"
        with store.open_output_stream(draft) as out:
            for x in chunks:
                size += out.write(x) or len(x)
        store.move(draft, at)
        return size
    os.makedirs(os.path.dirname(path), exist_ok=True)
    draft = f"{path}.{uuid.uuid4().hex[:8]}.draft"
    try:
        with open(draft, "wb") as out:
            for x in chunks:
                out.write(x)
                size += len(x)
        os.replace(draft, path)
    finally:
        if os.path.exists(draft):
            os.unlink(draft)
    return size


def text_or_empty(df: DataFrame, column: str = "text"):
    return F.coalesce(df[column].cast("string"), F.lit(""))


#: The column that numbered() adds.
ROW = "__emberline_row"
FILE_BITS = 40
#: Rows of a mask; masks of at most so many bytes together are sent to every executor.
MASK_ROWS, MASKS_BYTES = 1 << 15, 64 << 20


def _is_scan(plan) -> bool:
    """Whether rows of the plan are rows of files, each at most once."""
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    return plan.nodeName() == "LogicalRelation"


def numbered(docs: DataFrame) -> DataFrame:
    """docs with the column ROW, a number that belongs to the row for good: its file's number, in order of paths, and its place
    in the file. It doesn't depend on how the files are split into tasks, so a lost executor or another number of
    executors changes nothing. A table that isn't read from Parquet files is written first."""
    spark = docs.sparkSession
    try:
        if not _is_scan(docs._jdf.queryExecution().analyzed()):
            raise AnalysisException("not a scan")
        meta = docs.metadataColumn("_metadata")
        placed = docs.select("*", meta["file_path"].alias("__emberline_path"), meta["row_index"].alias("__emberline_at"))
    except AnalysisException:
        docs = cut(docs, "rows")
        meta = docs.metadataColumn("_metadata")
        placed = docs.select("*", meta["file_path"].alias("__emberline_path"), meta["row_index"].alias("__emberline_at"))
    # the scan's files, which the driver lists anyway
    files = sorted(r[0] for r in placed.select("__emberline_path").distinct().collect())
    if len(files) < 2:
        number = F.lit(0).cast("long")
        return placed.select(*(placed[c] for c in docs.columns), (F.shiftleft(number, FILE_BITS) + F.col("__emberline_at")).alias(ROW))
    names = F.broadcast(spark.createDataFrame(list(zip(files, range(len(files)), strict=True)), "__emberline_file string, __emberline_number long"))
    joined = placed.join(names, F.col("__emberline_path") == F.col("__emberline_file"))
    return joined.select(*(placed[c] for c in docs.columns), (F.shiftleft(F.col("__emberline_number"), FILE_BITS) + F.col("__emberline_at")).alias(ROW))


def only(df: DataFrame, column: str, wanted: DataFrame, masks_bytes: int | None = None) -> DataFrame:
    """The rows of df whose row number (see numbered) in `column` is in the one-column table `wanted`. The wanted numbers
    become bit masks, one for MASK_ROWS rows that follow one another; these are counted, and sent to all executors if they
    are small, so that df isn't shuffled. Otherwise the numbers are joined."""
    w = wanted.toDF("__emberline_w").where("__emberline_w is not null")
    part, place = lambda c: F.shiftright(c, 15), lambda c: c.bitwiseAND(F.lit(MASK_ROWS - 1))
    masks = w.groupBy(part(F.col("__emberline_w")).alias("__emberline_part")).agg(F.bitmap_construct_agg(place(F.col("__emberline_w"))).alias("__emberline_bits"))
    masks = cut(masks, "masks")
    if masks.count() * MASK_ROWS // 8 > (MASKS_BYTES if masks_bytes is None else masks_bytes):
        return df.join(w, df[column] == w["__emberline_w"], "left_semi")
    at = place(df[column])
    byte = F.conv(F.hex(F.col("__emberline_bits").substr((F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = F.pmod(byte / F.pow(F.lit(2), at.bitwiseAND(F.lit(7))), F.lit(2)) >= 1
    joined = df.join(F.broadcast(masks), part(df[column]) == masks["__emberline_part"])
    return joined.where(bit).select(*(df[c] for c in df.columns))
