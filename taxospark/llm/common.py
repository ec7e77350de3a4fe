"""Helpers that all operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import kept, shared_dir  # noqa: F401 (kept is used by the operators from here)

#: Bytes of text that a vectorised step holds as arrays at a time.
BLOCK_BYTES = 4_000_000
#: Bytes of rows from which on Spark begins a new batch for a Python worker (a little less than the power of 2 to which a buffer grows).
BATCH_BYTES = 4_000_000
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


#: What empties the caches that a Python worker keeps between tasks; an operator's module adds its own.
CACHES: list[Callable[[], None]] = []


def free_caches() -> None:
    """Give back the memory of all caches of this worker, which outlive the stage that filled them."""
    for clear in CACHES:
        clear()
    trim_memory()


def trim_memory() -> None:
    """Give back what this worker's allocators keep of freed memory: an idle worker counts beside the JVM's next stage."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library keeps its free memory


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The same map over batches, after which its worker gives back the memory that it took."""

    def outer(batches: Iterator) -> Iterator:
        yield from run(batches)
        trim_memory()  # run's own variables are gone here

    return outer


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_path(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def fenced(df: DataFrame, *columns) -> DataFrame:
    """df.select(*columns), each made once: no later filter or projection is merged into a generator's input.

    Else a filter on a result of a higher-order function would put its inputs, too, inside the function's lambda.
    """
    return df.select(F.inline(F.array(F.struct(*columns))))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores in front until no column of df has it (in whatever case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def short_batches(spark: SparkSession) -> None:
    """Let rows go to Python workers in batches of about BATCH_BYTES, where the session does not say otherwise.

    By number alone a batch has 10,000 texts; executor and worker hold it whole, the former in a buffer of up to twice its size.
    """
    if _BATCH_CONF not in spark.conf.getAll:
        spark.conf.set(_BATCH_CONF, BATCH_BYTES)


def doc_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id (long) and the text, a null text as the empty one, in batches of bounded size where Python reads them."""
    short_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def safe_cuts(text: str, limit: int) -> Iterator[str]:
    """Cut a long text before a single blank between two non-blanks, so each part tokenizes by itself.

    A part grows beyond the limit where the text has no such blank.
    """
    at = 0
    while len(text) - at > limit:
        cut = at + limit
        while True:
            cut = text.find(" ", cut)
            if cut < 0 or cut + 1 >= len(text):
                cut = -1
                break
            if not text[cut - 1].isspace() and not text[cut + 1].isspace():
                break
            cut += 1
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def blocks(ids: pa.Array, texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[list, list[str]]]:
    """Rows of an Arrow batch in runs of bounded text size."""
    rows, held, size = [], [], 0
    for i, t in zip(ids.to_pylist(), texts):
        t = t.as_py()
        rows.append(i)
        held.append(t)
        size += len(t)
        if size >= limit:
            yield rows, held
            rows, held, size = [], [], 0
    if rows:
        yield rows, held
