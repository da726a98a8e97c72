"""Shared helpers: the shared folder, written tables, and vectorised views of text columns."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Bytes of text that a vectorised step handles at once; a longer text is handled alone, in pieces of so many bytes.
SLICE_BYTES = 1 << 19
#: Words that a vectorised step handles at once in a text that is handled alone.
SLICE_WORDS = 1 << 17
#: Bytes of a batch that JVM and Python exchange.
BATCH_BYTES = 8 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.default_rng(20_240_607).integers(1, 2**63, 256, dtype=np.uint64)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_R = U64(0x9E3779B97F4A7C15)
_R_INV = U64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share. Where it is unset and driver and executors are
    one process (as in tests), a temporary one is made and set; on a cluster that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tarnmill-")
        spark.conf.set("spark.checkpoint.dir", path)
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table written to the shared folder: lineage ends here and survives the loss of executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tarnmill_path = path
    return out


def drop_written(*tables: DataFrame) -> None:
    """Deletes written tables that nothing lazy reads any more."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._tarnmill_path)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def bound_batches(spark: SparkSession) -> None:
    """Lets an Arrow batch hold at most BATCH_BYTES (or one row): long texts else make batches of 64 MB, of which JVM
    and Python hold several copies each. A lower setting of the session stays. Spark reads it when a plan starts, which
    is after these operators return, so it stays set for the session."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(spark.conf.get(name).rstrip("b"))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def columns(df: DataFrame) -> list[Column]:
    """All columns of df, whatever signs are in their names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def bit_table(keys: DataFrame, name: str, count: int, most: int = 28) -> np.ndarray:
    """Bits, 16 or more for each of `count` keys but never over 2^most, with bit (key mod their number) set for every
    value of the long column `name`: a filter of bounded size that lets all keys pass, and others the more the more there
    are. It is built by tasks; the driver puts 4 KB pieces together."""
    log2 = min(most, max(16, (16 * max(count, 1) - 1).bit_length()))
    bit = F.col(name).bitwiseAND(F.lit((1 << log2) - 1))
    parts = keys.select(F.shiftright(bit, 15).alias("part"), bit.bitwiseAND(F.lit((1 << 15) - 1)).alias("bit")).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = np.zeros(1 << (log2 - 3), np.uint8)
    for r in parts.toLocalIterator():
        out[r["part"] * 4096 : (r["part"] + 1) * 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def text_buffer(arr: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; a null is an empty text."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    arr = arr.cast(pa.large_binary())
    if arr.null_count:
        arr = pc.fill_null(arr, b"")
    _, offsets, data = arr.buffers()
    off = np.frombuffer(offsets, np.int64)[arr.offset : arr.offset + len(arr) + 1]
    if data is None or off[-1] == off[0]:
        return np.empty(0, np.uint8), np.zeros(len(arr) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes of text each; a longer text comes alone."""
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(size.tolist()):
        if held and held + n > limit:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(size):
        yield start, len(size)


def text_of(data: np.ndarray) -> pa.Array:
    """One text of these bytes, which are not copied."""
    return pa.Array.from_buffers(pa.large_string(), 1, [None, pa.py_buffer(np.array([0, len(data)], np.int64)), pa.py_buffer(data)])


def pieces(data: np.ndarray, limit: int | None = None) -> Iterator[tuple[int, int]]:
    """Ranges of about `limit` bytes of a text, each but the last cut after ASCII white space; a run without any makes
    a longer one."""
    limit = limit or SLICE_BYTES
    at, n = 0, len(data)
    while n - at > limit:
        spaces = np.flatnonzero(_SPACE[data[at : at + limit]])
        cut = at + int(spaces[-1]) + 1 if len(spaces) else 0
        look = at + limit
        while not cut and look < n:
            spaces = np.flatnonzero(_SPACE[data[look : look + limit]])
            cut = look + int(spaces[0]) + 1 if len(spaces) else 0
            look += limit
        if not cut:
            break
        yield at, cut
        at = cut
    if at < n:
        yield at, n


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) <= n:
        size = max(n + 1, SLICE_BYTES + 1)
        with np.errstate(over="ignore"):
            _powers[0] = np.cumprod(np.concatenate([np.ones(1, U64), np.full(size, _R, U64)]), dtype=U64)
            _powers[1] = np.cumprod(np.concatenate([np.ones(1, U64), np.full(size, _R_INV, U64)]), dtype=U64)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


class Words:
    """The words (runs without ASCII white space, or of `keep` bytes) of a slice of texts, as arrays."""

    def __init__(self, column: pa.Array, keep: np.ndarray | None = None, lower: bool = False):
        self.data, self.offsets = text_buffer(column)
        data, off = self.data, self.offsets
        inside = ~_SPACE[data] if keep is None else keep[data]
        n = len(data)
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0], before[1:] = False, inside[:-1]
            after[-1], after[:-1] = False, inside[1:]
            edges = off[:-1][np.diff(off) > 0]
            before[edges] = False
            after[off[1:][np.diff(off) > 0] - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        #: The words of text i are first[i]:first[i + 1].
        self.first = np.searchsorted(self.start, off)
        self.doc = np.repeat(np.arange(len(off) - 1), np.diff(self.first))
        self._table = _LOWER if lower else _BYTE
        self._sums: np.ndarray | None = None

    def hashes(self, start: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """64-bit hashes of byte ranges in ascending order, by default of the words."""
        start = self.start if start is None else start
        end = self.end if end is None else end
        if len(self.data) > 4 * SLICE_BYTES:
            return self._long_hashes(start, end)
        power, inverse = _power(len(self.data))
        with np.errstate(over="ignore"):
            if self._sums is None:
                self._sums = np.zeros(len(self.data) + 1, U64)
                np.cumsum(self._table[self.data] * power[: len(self.data)], dtype=U64, out=self._sums[1:])
            return mix((self._sums[end] - self._sums[start]) * inverse[start])

    def _long_hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The same numbers from sums over bounded stretches."""
        out = np.empty(len(start), U64)
        power, inverse = _power(4 * SLICE_BYTES)
        i = 0
        with np.errstate(over="ignore"):
            while i < len(start):
                base = int(start[i])
                j = max(i + 1, int(np.searchsorted(start, base + SLICE_BYTES)))
                if end[j - 1] - base > 4 * SLICE_BYTES:  # the last of them is a very long word
                    j -= 1
                    total = 0
                    for at in range(int(start[j]), int(end[j]), SLICE_BYTES):
                        block = self._table[self.data[at : min(at + SLICE_BYTES, int(end[j]))]]
                        total += int((block * power[: len(block)]).sum(dtype=U64)) * pow(int(_R), at - int(start[j]), 2**64)
                    out[j] = mix(np.array([total % 2**64], U64))[0]
                    following = j + 1
                else:
                    following = j
                if j > i:
                    here = self.data[base : int(end[j - 1])]
                    sums = np.zeros(len(here) + 1, U64)
                    np.cumsum(self._table[here] * power[: len(here)], dtype=U64, out=sums[1:])
                    out[i:j] = mix((sums[end[i:j] - base] - sums[start[i:j] - base]) * inverse[start[i:j] - base])
                i = following
        return out


def word_hashes(texts: pa.Array, keep: np.ndarray | None = None, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words of a slice of texts, first word of each text and the end). `lower`: of the texts in lower
    case. One long text is worked through in pieces."""

    def words(part: pa.Array) -> Words:
        return Words(pc.utf8_lower(part) if lower else part, keep=keep)

    data, off = text_buffer(texts)
    if len(texts) != 1 or len(data) <= SLICE_BYTES:
        w = words(texts)
        return w.hashes(), w.first
    parts = [words(text_of(data[a:b])).hashes() for a, b in pieces(data)]
    h = np.concatenate(parts)
    return h, np.array([0, len(h)])


def ngram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive word hashes (len(words) - k + 1 of them), irrespective of texts."""
    n = len(words)
    if n < k:
        return np.empty(0, U64)
    power, inverse = _power(n)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, U64)
        np.cumsum(words * power[:n], dtype=U64, out=sums[1:])
        return mix((sums[k:] - sums[:-k]) * inverse[: n - k + 1])
