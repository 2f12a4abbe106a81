"""What the operators of this subpackage share: shared storage, Arrow text blocks, words and hashes in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timeloom.storage import brief_shuffles, cut, discard, new_folder  # noqa: F401

#: Bytes of text that one numpy step handles; a longer text is a block of its own.
BLOCK_BYTES = 1_000_000
#: Bytes of a batch between JVM and Python; the session's own setting counts if it is lower.
BATCH_BYTES = 8 << 20
#: Bytes of a literal that may be broadcast; what grows with the data is joined instead.
BROADCAST_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(df: DataFrame) -> DataFrame:
    """The same rows; batches to Python workers are bounded by bytes, as texts have no bound of their own."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(conf.get(name, "67108864").rstrip("b")) > BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return df


def store(df: DataFrame, name: str, compression: str = "zstd", path: str | None = None) -> DataFrame:
    """Write a table into the shared folder (path: a folder of new_folder()) and read it back."""
    path = path or new_folder(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables that go together as soon as no later step reads them; shuffle files of each go when it is written."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def store(self, df: DataFrame, name: str) -> DataFrame:
        self.paths.append(new_folder(self.spark, name))
        with brief_shuffles(self.spark):
            return store(df, name, path=self.paths[-1])

    def discard(self) -> None:
        discard(self.spark, self.paths)
        self.paths = []


def one_text_each(docs: DataFrame, sample: DataFrame, label: str) -> DataFrame:
    """Rows (doc_id, text, label) of a sample of labelled ids, the least text of each, in a table of its own: as many as the sample
    has ids, however many rows of docs carry one of them."""
    rows = docs.select("doc_id", "text").join(F.broadcast(sample.select("doc_id", label)), "doc_id")  # the sample has a bound
    return store(rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.min(label).alias(label)), "labelled")


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Cut an Arrow string column into (first row, byte offsets from 0, bytes); a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        last = min(last, n)
        yield first, offsets[first : last + 1] - offsets[first], data[offsets[first] : offsets[last]]
        first = last


WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each run of bytes that are not white space; a word ends with its text."""
    solid = ~WHITE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    if len(data):
        edges = offsets[:-1][np.diff(offsets) > 0]
        first[edges] |= solid[edges]
        edges = offsets[1:][np.diff(offsets) > 0] - 1
        last[edges] |= solid[edges]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of any slices of a byte array, from prefix sums of random byte values times powers of an odd base.

    Sums modulo 2 ** 64 give some long texts of two letters one hash whatever the base. Where a hash alone decides, `prime` adds a
    second sum modulo a prime, where such texts differ as others do. Powers are shared by all seeds of a worker, so they cost 16
    bytes (with a prime 32) for each byte of the largest block once.
    """

    base = int(mix(np.array([978], np.uint64))[0]) | 5
    modulus = (1 << 31) - 1
    prime_base = base % modulus
    _up, _down = np.ones(1, np.uint64), np.ones(1, np.uint64)
    _prime_up, _prime_down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def __init__(self, seed: int = 1, prime: bool = False) -> None:
        self.values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed * 7919))
        self.prime = prime

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(Rolling._up) < n:
            size = n + n // 8
            up, down = np.full(size, self.base, np.uint64), np.full(size, pow(self.base, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            Rolling._up, Rolling._down = np.cumprod(up), np.cumprod(down)
        return Rolling._up[:n], Rolling._down[:n]

    def prime_powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(Rolling._prime_up) < n:
            found = []
            for base in (self.prime_base, pow(self.prime_base, -1, self.modulus)):
                out = np.ones(1, np.uint64)
                while len(out) < n + n // 8:  # twice as many each time
                    out = np.concatenate((out, out * np.uint64(pow(base, len(out), self.modulus)) % np.uint64(self.modulus)))
                found.append(out)
            Rolling._prime_up, Rolling._prime_down = found
        return Rolling._prime_up[:n], Rolling._prime_down[:n]

    def prefix(self, data: np.ndarray) -> np.ndarray:
        """Prefix sums over bytes, or over code points; those modulo a prime are a second row."""
        out = np.zeros((2, len(data) + 1) if self.prime else len(data) + 1, np.uint64)
        values = self.values[data] if data.dtype == np.uint8 else mix(data.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        np.cumsum(values * self.powers(len(data) + 1)[0][:-1], out=out[0, 1:] if self.prime else out[1:])
        if self.prime:  # 2 ** 33 terms below 2 ** 31 have room
            np.cumsum((values >> np.uint64(33)) * self.prime_powers(len(data) + 1)[0][:-1] % np.uint64(self.modulus), out=out[1, 1:])
        return out

    def slices(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        long = prefix[0] if self.prime else prefix
        out = mix((long[ends] - long[starts]) * self.powers(len(long))[1][starts] + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        if self.prime:
            rest = (prefix[1, ends] - prefix[1, starts]) % np.uint64(self.modulus) * self.prime_powers(len(long))[1][starts] % np.uint64(self.modulus)
            out = mix(out ^ mix(rest + np.uint64(1)))
        return out


#: Masks of the lowest bytes of a number.
_EIGHTS = 8  # numbers of eight bytes that are compared at once; what goes on behind them is compared slice by slice
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


class SliceCache:
    """Results (rows of numbers) of slices of bytes, found by 64-bit hash in an open-addressing table and compared byte by byte.

    A slice that is not there is computed once; one whose hash belongs to another slice is computed apart. When the table or what
    it holds would grow beyond its bound, it starts anew, so memory is bounded.
    """

    #: Numbers and bytes of long slices that are held at most, but for those of one block.
    most_held = 1 << 24

    def __init__(self, compute, bits: int = 20) -> None:
        self.compute, self.bits, self.most = compute, bits, (1 << bits) // 2
        self.clear()

    def clear(self) -> None:
        self.keys, self.entry = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
        self.flat, self.used, self.filled, self.held = np.zeros(1 << 14, np.uint32), 0, 0, 0
        # of each entry: where its numbers start and how many they are, its length and its first bytes, eight in a number
        self.starts, self.counts, self.sizes = (np.zeros(1 << 12, np.int64) for _ in range(3))
        self.eights = [np.zeros(1 << 12, np.uint64) for _ in range(_EIGHTS)]
        self.long: dict[int, bytes] = {}

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Number of the entry of each hash, or -1."""
        mask = (1 << self.bits) - 1
        at = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        found = self.keys[at]
        out = np.where(found == hashes, self.entry[at], -1)
        left = np.flatnonzero((found != hashes) & (found != 0))
        while len(left):
            at[left] = (at[left] + 1) & mask
            found = self.keys[at[left]]
            hit = found == hashes[left]
            out[left[hit]] = self.entry[at[left[hit]]]
            left = left[~hit & (found != 0)]
        return out

    def _insert(self, hashes: np.ndarray, entries: np.ndarray) -> None:
        mask = (1 << self.bits) - 1
        at = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(hashes):
            free = self.keys[at] == 0
            self.keys[at[free]] = hashes[free]
            mine = self.keys[at] == hashes
            self.entry[at[mine]] = entries[mine]
            hashes, entries, at = hashes[~mine], entries[~mine], (at[~mine] + 1) & mask

    @staticmethod
    def _eight(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
        """Bytes 8 * k and following of slices longer than that, as numbers, zero where one ends. raw: a number for each byte and its next seven."""
        return raw[starts + 8 * k] & _LOW[np.minimum(sizes - 8 * k, 8)]

    @staticmethod
    def _overlapping(raw: bytes) -> np.ndarray:
        return np.ndarray((len(raw) + 1,), "<u8", raw + bytes(8), strides=(1,))

    def _learn(self, slices: list[bytes]) -> np.ndarray:
        """Entries of different slices."""
        flat, counts = self.compute(slices)
        n = self.used + len(counts)
        while len(self.starts) < n:
            self.starts, self.counts, self.sizes, *self.eights = (np.concatenate((x, x)) for x in (self.starts, self.counts, self.sizes, *self.eights))
        while len(self.flat) < self.filled + len(flat):
            self.flat = np.concatenate((self.flat, self.flat))
        sizes = np.fromiter(map(len, slices), np.int64, len(slices))
        mine = slice(self.used, n)
        self.starts[mine] = self.filled + np.cumsum(counts) - counts
        self.counts[mine], self.sizes[mine] = counts, sizes
        whole, begin = self._overlapping(b"".join(slices)), np.cumsum(sizes) - sizes
        for k, eights in enumerate(self.eights):
            some = np.flatnonzero(sizes > 8 * k)
            eights[self.used + some] = self._eight(whole, begin[some], sizes[some], k)
        for i in np.flatnonzero(sizes > 8 * _EIGHTS).tolist():
            self.long[self.used + i] = slices[i]
        self.flat[self.filled : self.filled + len(flat)] = flat
        self.held += len(flat) + int(sizes[sizes > 8 * _EIGHTS].sum())
        self.used, self.filled = n, self.filled + len(flat)
        return np.arange(n - len(counts), n, dtype=np.int32)

    def _differ(self, at: np.ndarray, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Which slices are not those of their entries."""
        sizes, whole = ends - starts, self._overlapping(raw)
        same = self.sizes[at] == sizes
        some = np.flatnonzero(same)
        for k, eights in enumerate(self.eights):
            some = some[sizes[some] > 8 * k]
            if not len(some):
                break
            same[some] &= eights[at[some]] == self._eight(whole, starts[some], sizes[some], k)
        long = np.flatnonzero(same & (sizes > 8 * _EIGHTS))
        if len(long):
            same[long] = [raw[a:b] == self.long[i] for a, b, i in zip(starts[long].tolist(), ends[long].tolist(), at[long].tolist())]
        return np.flatnonzero(~same)

    def rows(self, hashes: np.ndarray, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The results of all slices in a row, and how many numbers each has."""
        hashes = np.maximum(hashes, np.uint64(1))
        if self.held > self.most_held or self.used > self.most:
            self.clear()
        at = self.find(hashes)
        new = np.flatnonzero(at < 0)
        if len(new):
            unique, first = np.unique(hashes[new], return_index=True)
            if self.used + len(unique) > self.most:
                self.clear()
                unique, first = np.unique(hashes, return_index=True)
                new = np.arange(len(hashes))
                while len(unique) > self.most:
                    self.bits += 1
                    self.most *= 2
                    self.clear()
            chosen = new[first]
            self._insert(unique, self._learn([raw[a:b] for a, b in zip(starts[chosen].tolist(), ends[chosen].tolist())]))
            at[new] = self.find(hashes[new])
        apart = self._differ(at, raw, starts, ends)
        if len(apart):
            slices = [raw[a:b] for a, b in zip(starts[apart].tolist(), ends[apart].tolist())]
            entries = dict(zip(different := list(dict.fromkeys(slices)), self._learn(different).tolist()))
            at[apart] = [entries[s] for s in slices]
        counts = self.counts[at]
        ends_out = np.cumsum(counts)
        total = int(ends_out[-1]) if len(ends_out) else 0
        return self.flat[np.arange(total) + np.repeat(self.starts[at] - (ends_out - counts), counts)], counts


def per_text(counts: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where the numbers of each text start and end, from the count of each slice and the texts' bounds among slices."""
    return np.concatenate(([0], np.cumsum(counts)))[bounds]


def append_columns(df: DataFrame, text_col: str, keep: list[str], schema: str, compute) -> DataFrame:
    """Columns that compute(offsets, bytes) gives for each block of texts, beside those kept.

    schema: DDL of the new columns, none of whose types holds a comma; a kept column of the same name gives way to the new one.
    """
    names = [x.split()[0] for x in schema.split(",")]
    keep = [c for c in keep if c not in names]
    rows = df.select(*keep) if text_col in keep else df.select(*keep, text_col)
    at = rows.columns.index(text_col)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, offsets, data in blocks(batch.column(at)):
                n = len(offsets) - 1
                kept = [batch.column(i).slice(first, n) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*kept, *compute(offsets, data)], names=[*keep, *names])

    return small_batches(rows).mapInArrow(run, ", ".join([kinds, schema] if kinds else [schema]))


def count_in(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many bytes of each text a mask holds."""
    return np.diff(np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))[offsets])


def bounded_share(total: int, most: int) -> float:
    """Share of rows that keeps a hash sample near a documented number of rows."""
    return 1.0 if total <= most else most / total
