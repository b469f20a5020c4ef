"""Helpers that several operators share: lineage cuts, blocks of documents, connected components."""

from __future__ import annotations

import contextlib
import ctypes
import math
import tempfile
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def cut(df: DataFrame) -> DataFrame:
    """Materialise `df` with checkpoint() in the cluster's shared folder and forget its lineage."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """`df` written as compressed Parquet in the shared folder and read again: a lineage cut that keeps columns apart."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`; where that is unset, a new local one in local mode and an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    named = named or spark.sparkContext.getCheckpointDir()
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named or "file://" + tempfile.mkdtemp(prefix="annulus-")


def blocks_for(docs: DataFrame, text: str, per_block: int) -> tuple[int, int]:
    """(bytes of all texts, number of blocks of about `per_block` bytes)."""
    total = docs.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    return total, max(1, math.ceil(total / per_block))


def block_of(key: str, n: int, text: str | None = None):
    """The block of a row, from its key (or the text where that is null) alone, so that every pass and every retry agrees."""
    h = F.xxhash64(F.col(key)) if text is None else F.when(F.col(key).isNull(), F.xxhash64(F.col(text))).otherwise(F.xxhash64(F.col(key)))
    return F.pmod(h, F.lit(n)).cast("int")


def lean(result=None):
    """`result`, after what a task no longer needs has gone back to the system: workers stay alive between tasks, and with them what they once held."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)
    return result


def lean_batches(batches):
    """The batches of a task, then `lean`."""
    yield from batches
    lean()


def squeeze_bytes(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(3).compress(raw)


def unsqueeze_bytes(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)


def squeeze(x: np.ndarray) -> bytes:
    """Bytes of 64-bit numbers, all lowest bytes first, compressed."""
    return zstandard.ZstdCompressor(3).compress(np.ascontiguousarray(x.reshape(-1).view(np.uint8).reshape(-1, 8).T).tobytes())


def unsqueeze(raw, kind) -> np.ndarray:
    """The numbers of an Arrow scalar that `squeeze` made."""
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw.as_py()), dtype=np.uint8).reshape(8, -1)
    return np.ascontiguousarray(flat.T).reshape(-1).view(kind)


def deal(docs: DataFrame, n: int, key: str = "id", text: str = "text") -> DataFrame:
    """Rows (block, rows): `docs` shuffled to `n` blocks by `key`, rows without one by `text`.

    What an Arrow batch holds of a block is one compressed Arrow stream, so long texts cross the shuffle at the size of a
    strong compression and not at that of Spark's fast one. `undeal` reads them.
    """

    def pack(batches):
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))
        for b in batches:
            block = b.column("block").to_numpy()
            order = np.argsort(block, kind="stable")
            names, starts = np.unique(block[order], return_index=True)
            t = b.drop_columns(["block"]).take(pa.array(order))
            out = []
            for start, end in zip(starts, [*starts[1:], len(order)]):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, t.schema, options=options) as w:
                    w.write_batch(t.slice(start, end - start))
                out.append(sink.getvalue().to_pybytes())
            del t
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(out, pa.binary())], names=["block", "rows"])
            del b, out
            pa.default_memory_pool().release_unused()

    return docs.withColumn("block", block_of(key, n, text)).mapInArrow(lambda b: lean_batches(pack(b)), "block int, rows binary").repartition("block")


def undeal(table: pa.Table) -> pa.Table:
    """The rows of a block that `deal` packed; at least one stream."""
    return pa.concat_tables([pa.ipc.open_stream(r.as_buffer()).read_all() for r in table.column("rows")])


#: For each byte, whether it is one of the six ASCII white-space characters.
SPACE = np.isin(np.arange(256), np.frombuffer(b" \t\n\x0b\x0c\r", dtype=np.uint8))
#: Odd bases of the polynomial hashes of words, and the multipliers that join words to windows.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
JOINS = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


@lru_cache(maxsize=4)
def powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, base, dtype=np.uint64)]), dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """The bits of 64-bit numbers, mixed."""
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Words:
    """The words of a list of texts (bytes), without an object per word: where each starts and ends, and 64 bits of hash per base.

    The hash of a word is its polynomial in the base over the ring of 64 bits, read off the prefix sums of its text, then mixed.
    Texts are read in runs of about `run` bytes, so that the sums stay small.
    """

    def __init__(self, texts: list[bytes], hashes: int = 2, run: int = 1 << 20):
        self.texts = texts
        counts, starts, ends, found = [], [], [], [[] for _ in range(hashes)]
        k = 0
        while k < len(texts):
            j, size = k, 0
            while j < len(texts) and (j == k or size + len(texts[j]) < run):
                size += len(texts[j]) + 1
                j += 1
            raw = np.frombuffer(b" " + b" ".join(texts[k:j]) + b" ", dtype=np.uint8)
            space = SPACE[raw]
            edge = np.nonzero(space[1:] != space[:-1])[0] + 1
            start, end = edge[::2], edge[1::2]
            begin = np.cumsum([1, *(len(t) + 1 for t in texts[k:j])])
            doc = np.searchsorted(begin, start, side="right") - 1
            counts.append(np.bincount(doc, minlength=j - k))
            starts.append((start - begin[doc]).astype(np.int32))
            ends.append((end - begin[doc]).astype(np.int32))
            room = 1 << (len(raw)).bit_length()
            for h in range(hashes):
                sums = np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers(BASES[h], room)[: len(raw)], dtype=np.uint64)
                back = powers(pow(BASES[h], -1, 1 << 64), room)
                found[h].append(mixed((sums[end - 1] - sums[start - 1]) * back[start]))
            k = j
        self.counts = np.concatenate(counts).astype(np.int64) if counts else np.empty(0, dtype=np.int64)
        #: Number of the first word of each text, and of all words at the end.
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        none = np.empty(0, dtype=np.int32)
        self.start, self.end = np.concatenate([*starts, none]), np.concatenate([*ends, none])
        self.hashes = [np.concatenate([*f, np.empty(0, dtype=np.uint64)]) for f in found]

    def windows(self, n: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """(first words, hashes per base) of all runs of n words inside one text, in order."""
        total = max(0, len(self.start) - n + 1)
        last = np.repeat(self.first[1:], self.counts)[:total]
        at = np.nonzero(np.arange(n, total + n) <= last)[0]
        out = []
        for h, join in zip(self.hashes, JOINS):
            x = np.zeros(total, dtype=np.uint64)
            for j in range(n):
                x *= np.uint64(join)
                x += h[j : j + total]
            out.append(mixed(x[at]))
        return at, out


def portions(batch: pa.RecordBatch, text: str, size: int = 2 << 20):
    """Slices of a batch whose texts hold about `size` bytes each, at least one row."""
    bytes_of = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(bytes_of, (bytes_of[at - 1] if at else 0) + size, side="right")))
        yield batch.slice(at, end - at)
        at = end


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest index reachable from each of n nodes over the pairs (a, b)."""
    label = np.arange(n)
    while len(a):
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while not np.array_equal(label, label[label]):
            label = label[label]
        if np.array_equal(before, label):
            break
    return label


#: Edges that a part of a round of `components` holds.
PART = 250_000


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the edges (a, b): rows (node, root), root the smallest node reachable.

    Alternates large-star and small-star steps, each a grouped minimum and a join, until the edges are
    stars around the smallest nodes. A round is written in as many parts as its edges need at `PART` each. Roots themselves and nodes without edges get no row. The stars of a
    hub are rows of a plain equi-join, which adaptive execution splits when they are skewed.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    mark = None
    while True:
        found = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if found["n"] == 0 or (found["n"], found["x"]) == mark:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = (found["n"], found["x"])
        both = e.select(F.col("u").alias("a"), F.col("v").alias("b")).union(e.select("v", "u"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        e = cut(small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", "m")).distinct().coalesce(1 + found["n"] // PART))
