"""What the operators share: words of a text, columns computed from texts, staged tables."""

from __future__ import annotations

import ctypes
import gc
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from figtrace.session import staging_path

SLICE = 4 << 20
# Byte tables: A-Z in lower case; bytes of UTF-8 sequences stay as they are.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
# ... and every other ASCII byte that is neither a letter nor a digit becomes a space.
WORDY = bytes(32 if c < 48 or 58 <= c <= 64 or 91 <= c <= 96 or 123 <= c <= 127 else LOWER[c] for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    """Lower-cased words ``[^\\x20\\x09-\\x0D]+``; none for a null text."""
    return text.translate(LOWER).split() if text else []


def plain_words(text: bytes | None) -> list[bytes]:
    """Lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``; none for a null text."""
    return text.translate(WORDY).split() if text else []


def fold(ids: Column, n: int) -> Column:
    """crc32 of the id's text, modulo ``n``."""
    return F.crc32(ids.cast("string").cast("binary")) % n


def fold_of(doc_id: int, n: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % n


Texts = list  # of bytes, None for a null text
Batches = Iterator[pa.RecordBatch]


def from_texts(
    docs: DataFrame,
    schema: str,
    make: Callable[[], Callable[[Texts], Sequence]],
    *,
    text: str = "text",
    keep: Sequence[str] | None = None,
    also: Sequence[str] = (),
    size: int = SLICE,
) -> DataFrame:
    """``docs`` with columns computed from its texts, one row each.

    ``make`` runs once in every task and returns a function from the texts of a batch (bytes, None for
    null), and its values of the columns ``also``, to one list or array per field of ``schema``. ``keep`` names the columns that stay (all by
    default); one that has the name of a new column is replaced. Texts come ``size`` bytes at a time.
    """
    new = StructType.fromDDL(schema)
    kept = [c for c in (docs.columns if keep is None else keep) if c not in new.names]
    source = docs.select(*[F.col(_quoted(c)) for c in kept], F.col(_quoted(text)).cast("binary").alias("_text"), *[F.col(_quoted(a)).alias(f"_also_{i}") for i, a in enumerate(also)])
    out = StructType([*docs.select(*[_quoted(c) for c in kept]).schema.fields, *new.fields])
    n = len(kept)

    def run(batches: Batches) -> Batches:
        compute = make()
        fields = None
        for batch in slices(batches, n, size):
            columns = compute(*[batch.column(i).to_pylist() for i in range(n, n + 1 + len(also))])
            if fields is None:
                from pyspark.sql.pandas.types import to_arrow_schema

                fields = list(to_arrow_schema(new))
            arrays = [c if isinstance(c, pa.Array) else pa.array(c, f.type, from_pandas=False) for c, f in zip(columns, fields)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:n], *arrays], schema=pa.schema([*list(batch.schema)[:n], *fields])
            )
        # The worker goes on to other tasks, of other stages too.
        del compute
        give_back(collect=False)

    return source.mapInArrow(run, out)


def slices(batches: Batches, column: int, size: int = SLICE) -> Batches:
    """The same rows in batches of about ``size`` bytes of text, so that what is made of them stays small."""
    for batch in batches:
        sizes = np.nan_to_num(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)).astype(np.int64)
        share = (np.cumsum(sizes) - sizes) // size
        cuts = [0, *(np.flatnonzero(np.diff(share)) + 1).tolist(), len(sizes)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, and safe from lost executors."""
    path = staging_path(df.sparkSession, name)
    df.write.parquet(path)
    held = df.sparkSession.read.schema(df.schema).parquet(path)
    held._staged = path
    return held


def give_back(*, collect: bool = True) -> None:
    """Return memory that was freed to the system. A driver or a worker that lives on would keep it otherwise, and with
    it what its largest step so far has taken."""
    if collect:
        gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def release(*frames: DataFrame) -> None:
    """Delete staged tables that nothing reads any more; frames that were not staged stay as they are."""
    for df in frames:
        if path := getattr(df, "_staged", None):
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def bit_table(spots: DataFrame, size: int) -> np.ndarray:
    """A table of ``size`` bits in 64-bit words, in which those that the column ``s`` of ``spots`` names are set. It reaches the
    driver as one small result, at most a row a word; partition by partition it would be a job each."""
    words = spots.groupBy(F.shiftright("s", 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(s & 63 AS int)))").alias("w")).toArrow()
    held = np.zeros(size // 64, dtype=np.int64)
    held[words["at"].to_numpy()] = words["w"].to_numpy()
    return held.view(np.uint64)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions ``start, start + 1, ...`` of every range, one range after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)
