"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch.  Whole documents are sent, so a batch is kept to a
#: thousand of them; Spark also ends a batch at ``BATCH_BYTES``.
BATCH_ROWS = 1000
BATCH_BYTES = 4 << 20
#: Distinct words whose hashes one Python worker holds at most, and bytes of the longest that it holds.
WORDS, LONG_WORD = 100_000, 64
#: Bytes of a text whose words are split at once.
SEGMENT = 1 << 20
#: Ids that are broadcast at most; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def tune(spark: SparkSession) -> None:
    """Bound the memory of Arrow batches for operators that read whole texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one in local mode."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        path = tempfile.mkdtemp(prefix="vellum-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def session_dir(spark: SparkSession) -> str:
    """The folder of this application's tables below the shared one."""
    return f"{shared_dir(spark)}/vellum-{spark.sparkContext.applicationId}"


def clean(spark: SparkSession) -> None:
    """Remove all tables that this application has written; results that read them are void then."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(session_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    It cuts the lineage: a lost executor costs a reread, not a recomputation.  The
    table stays until ``clean``, as results are lazy.
    """
    spark = df.sparkSession
    path = f"{session_dir(spark)}/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_bytes(col: str | Column = "text") -> Column:
    """The UTF-8 bytes of a text; a null text is empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")).cast("binary")


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text's bytes, under names that clash with nothing."""
    return df.select(F.col(id_col).cast("long").alias("_id"), text_bytes(text_col).alias("_text"))


def few(rows: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
    """Rows of a few numbers, to be broadcast if they are counted to be few; else a join shuffles both sides."""
    return F.broadcast(rows) if rows.count() <= most else rows


class WordHashes(dict):
    """64-bit hashes of words, kept while they fit."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        found = xxhash.xxh64_intdigest(word)
        if len(word) <= LONG_WORD:
            self[word] = found
        return found


#: The one cache of word hashes in a worker, whichever operators it runs.
_words = WordHashes()
#: What an operator keeps in a worker from task to task, by its name: the next operator's first task empties it.
kept: dict[str, dict] = {}


def segments(text: bytes) -> Iterator[bytes]:
    """The text in parts that end at white space."""
    at = 0
    while len(text) - at > SEGMENT:
        found = _SPACE.search(text, at + SEGMENT)
        if not found:
            break
        yield text[at : found.end()]
        at = found.end()
    yield text[at:] if at else text


def hash_words(texts: Iterable[bytes]) -> np.ndarray:
    """The hashes of the words of consecutive texts, in order; ASCII white space parts words."""
    out = []
    for text in texts:
        words = text.split()
        if len(_words) > WORDS:
            _words.clear()
        out.append(np.fromiter(map(_words.__getitem__, words), np.uint64, len(words)))
    return out[0] if len(out) == 1 else np.concatenate([np.zeros(0, np.uint64), *out])


Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def trim() -> None:
    """Give free pages back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back:
        give_back(0)


def releasing(run: Run) -> Run:
    """``run``, which finds no other operator's cache in its worker and leaves no cache and no free pages behind there."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Imported by name: a closure would bring a copy of the module's cache along.
        from vellum.llm import _util

        if _util.kept:
            for cache in _util.kept.values():
                cache.clear()
            _util.kept.clear()
            _util.trim()
        try:
            yield from run(batches)
        finally:
            _util._words.clear()
            _util.trim()

    return task


def keep_rows(docs: DataFrame, judge: Callable[[list[bytes]], np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows whose text ``judge`` keeps, and those without an id: one pass over the rows, no join."""
    names = docs.columns
    at_id, at_text = names.index(id_col), names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column(at_text).cast(pa.binary()).to_pylist()]
            loose = batch.column(at_id).is_null().to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(judge(texts) | loose))

    return docs.mapInArrow(releasing(run), docs.schema)
