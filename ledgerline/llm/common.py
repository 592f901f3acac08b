"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 (pa.compute)
from pyspark.sql import DataFrame, SparkSession

from ledgerline.functions.lineage import cut, ensure_checkpoint_dir  # noqa: F401 (for the operators)

#: Bytes of text handled at once inside an Arrow batch; bounds a worker's temporaries.
SLICE_BYTES = 1 << 20
#: Bytes in an Arrow batch between Spark and Python.
BATCH = "8m"

#: A word of the contracts: a run of anything but space, tab, newlines and form feeds.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the folder ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions_for(spark: SparkSession) -> int:
    """The session's shuffle width, which the cluster sizes to the input."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into row ranges whose ``column`` holds about ``limit`` bytes; a longer text stays whole."""
    if pa.default_memory_pool().backend_name != "system":
        pa.set_memory_pool(pa.system_memory_pool())  # it keeps no freed memory
    n = batch.num_rows
    if not n:
        return
    lengths = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0), dtype=np.int64)
    ends = np.cumsum(lengths)
    start = 0
    while start < n:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def release() -> None:
    """Give freed memory back to the system at a task's end: workers live on, and an executor's limit counts them all."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def bounded_batches(spark: SparkSession) -> None:
    """Let Arrow batches hold BATCH of data, where the session has Spark's own default, so that long texts don't fill an executor's memory."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, "1").rstrip("b") in ("67108864", "64m"):
        spark.conf.set(name, BATCH)


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str, column: str = "text", limit: int = SLICE_BYTES) -> DataFrame:
    """``mapInArrow`` of ``fn`` over slices of bounded size; ``fn`` returns record batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column, limit):
                yield from fn(part)
        release()

    bounded_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string column (null: empty) and the n+1 offsets of its rows."""
    column = pa.compute.fill_null(column, "").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words (WORD) of each text: code of every word, the distinct words, and the n+1 offsets of the rows."""
    return split_bytes(*text_bytes(texts))


def split_bytes(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """split_words of texts given as bytes and offsets."""
    space = (flat == 32) | ((flat >= 9) & (flat <= 13))
    inside = ~space
    edge = np.empty(len(flat), bool)
    if len(flat):
        edge[0] = inside[0]
        edge[1:] = inside[1:] & space[:-1]
        head = offsets[:-1][offsets[:-1] < len(flat)]
        edge[head] = inside[head]
    starts = np.flatnonzero(edge)
    last = np.empty(len(flat), bool)
    if len(flat):
        last[-1] = inside[-1]
        last[:-1] = inside[:-1] & edge_after(space, offsets, len(flat))
    ends = np.flatnonzero(last) + 1
    rows = np.searchsorted(starts, offsets)
    gathered, bounds = ragged(flat, starts, ends - starts)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(gathered)])
    coded = words.dictionary_encode()
    return np.asarray(coded.indices), coded.dictionary, rows


def edge_after(space: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """Whether a word that holds byte i ends there: a space or another row follows."""
    follows = space[1:].copy()
    heads = offsets[1:-1]
    heads = heads[(heads > 0) & (heads < n)]
    follows[heads - 1] = True
    return follows


def ragged(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate the pieces of ``flat``; also their n+1 offsets."""
    bounds = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths, out=bounds[1:])
    index = np.repeat(starts - bounds[:-1], lengths)
    index += np.arange(bounds[-1])
    return flat[index], bounds
