"""Line dedup that can be undone: sharded cuckoo filters before exact tables of which document holds which line."""

from __future__ import annotations

import uuid
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mixed, portions, shared_folder, stored

#: The six ASCII white-space characters.
SPACES = b" \t\n\x0b\x0c\r"
#: Fingerprints that a bucket holds, and the share of all places that is filled before a layer is added.
SLOTS, FULL = 4, 0.9


class CuckooFilter:
    """A multiset of keys by fingerprints of 16 bits in one of two buckets each; all calls take arrays of keys (n, 2) of 64 bits.

    `copies` never says too little. A copy that finds no place goes to a further layer with as many buckets, so adding never fails
    and needs none of the keys that are there.
    """

    def __init__(self, raw: bytes = b"", buckets: int = 0):
        if raw:
            buckets = int.from_bytes(raw[:8], "little")
        self.buckets = buckets
        self.layers = list(np.frombuffer(raw[8:], dtype=np.uint16).reshape(-1, buckets, SLOTS).copy()) if raw else []

    @classmethod
    def sized(cls, n: int) -> CuckooFilter:
        """A filter whose first layer has room for n copies."""
        return cls(buckets=1 << max(4, int(n / (SLOTS * 0.75))).bit_length())

    def to_bytes(self) -> bytes:
        return self.buckets.to_bytes(8, "little") + b"".join(x.tobytes() for x in self.layers)

    def other(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return bucket ^ (mixed(mark.astype(np.uint64)) & np.uint64(self.buckets - 1)).astype(np.int64)

    def at(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first bucket, fingerprint); zero marks an empty place, so no fingerprint is zero."""
        mark = (keys[:, 1] & np.uint64(0xFFFF)).astype(np.uint16)
        return (keys[:, 0] & np.uint64(self.buckets - 1)).astype(np.int64), np.where(mark == 0, np.uint16(1), mark)

    def copies(self, keys: np.ndarray) -> np.ndarray:
        first, mark = self.at(keys)
        second = self.other(first, mark)
        n = np.zeros(len(keys), dtype=np.int64)
        for layer in self.layers:
            n += (layer[first] == mark[:, None]).sum(1) + np.where(first == second, 0, (layer[second] == mark[:, None]).sum(1))
        return n

    def add(self, keys: np.ndarray) -> None:
        """Put one copy of each key, which may repeat."""
        bucket, mark = self.at(keys)
        k = 0
        while len(bucket):
            if k == len(self.layers):
                self.layers.append(np.zeros((self.buckets, SLOTS), dtype=np.uint16))
            room = max(0, int(FULL * self.layers[k].size) - np.count_nonzero(self.layers[k]))
            left = self.place(self.layers[k], bucket[:room], mark[:room])
            bucket, mark, k = np.concatenate([left[0], bucket[room:]]), np.concatenate([left[1], mark[room:]]), k + 1

    def place(self, layer: np.ndarray, bucket: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Put fingerprints in free places of either bucket, else in those of others, which move on; returns what is left."""
        for turn in range(128):
            for s in range(SLOTS):
                free = np.nonzero(layer[bucket, s] == 0)[0]
                put = free[np.unique(bucket[free], return_index=True)[1]]
                layer[bucket[put], s] = mark[put]
                bucket, mark = np.delete(bucket, put), np.delete(mark, put)
            if not len(bucket):
                break
            if turn:
                one, s = np.unique(bucket, return_index=True)[1], turn % SLOTS
                layer[bucket[one], s], mark[one] = mark[one], layer[bucket[one], s]
            bucket = self.other(bucket, mark)
        return bucket, mark

    def remove(self, keys: np.ndarray) -> None:
        """Take one copy of each key, which may repeat; all must be there."""
        first, mark = self.at(keys)
        for layer in reversed(self.layers):
            for s in range(SLOTS):
                for side in (0, 1):
                    bucket = self.other(first, mark) if side else first
                    hit = np.nonzero(layer[bucket, s] == mark)[0]
                    gone = hit[np.unique(bucket[hit], return_index=True)[1]]
                    layer[bucket[gone], s] = 0
                    first, mark = np.delete(first, gone), np.delete(mark, gone)
        if len(first):
            raise ValueError("a key that the filter does not hold can't be removed")


def line_keys(text: bytes, least: int) -> dict[bytes, list[int]]:
    """Digests of 128 bits of the keys of at least `least` code points, with the numbers of their lines."""
    out: dict[bytes, list[int]] = {}
    for k, line in enumerate(text.split(b"\n")):
        key = line.strip(SPACES).lower()
        if len(key) >= least and (len(key) >= 4 * least or len(key.decode()) >= least):
            out.setdefault(blake2b(key, digest_size=16).digest(), []).append(k)
    return out


def read_keys(table: pa.Table) -> np.ndarray:
    """The column `key` as numbers (n, 2)."""
    return np.frombuffer(b"".join(table.column("key").to_pylist()), dtype=np.uint64).reshape(-1, 2)


def counted(references: DataFrame) -> DataFrame:
    """Rows (key, documents, none, first) of the keys that documents still hold: how many do, whether one has no id, the smallest id."""
    held = references.groupBy("key", "id").agg(F.sum("n").alias("n")).where("n > 0")
    return held.groupBy("key").agg(F.count("*").alias("documents"), F.bool_or(F.col("id").isNull()).alias("none"), F.min("id").alias("first"))


class LineIndex:
    """Which documents hold which lines: tables in the folder that driver and executors share.

    `log` are exact reference counts, rows (key, id, n) that add up: a document that comes adds one for each of its keys, one that goes
    takes it back. `filters` has a cuckoo filter for each shard of keys, with one copy of a key that one document holds and
    two of a key that more hold. A key without a copy is new, and one with a single copy is in no two documents: neither is looked up
    in the exact tables. Both are written once and never changed; `insert` and `delete` return the next index, so a failed one leaves this as it is.
    """

    def __init__(self, spark: SparkSession, shards: int, *, least: int = 10, log: tuple[str, ...] = (), filters: str | None = None):
        self.spark, self.shards, self.least, self.paths, self.filters = spark, shards, least, log, filters

    def write(self, df: DataFrame) -> str:
        path = f"{shared_folder(self.spark)}/lines-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        return path

    @property
    def log(self) -> DataFrame:
        return self.spark.read.parquet(*self.paths)

    def references(self, docs: DataFrame, id: str, text: str) -> DataFrame:
        """Rows (id, content, key, at): the keys of each row of `docs`, with the numbers of their lines; equal rows give equal ones."""
        least = self.least
        d = docs.select(F.col(id).alias("id"), content(id, text), F.encode(F.coalesce(text, F.lit("")), "utf-8").alias("text"))

        def keys(batches):
            for batch in batches:
                for b in portions(batch, "text"):
                    row, key, at = [], [], []
                    for k, raw in enumerate(b.column("text").to_pylist()):
                        found = line_keys(raw, least)
                        row += [k] * len(found)
                        key += found
                        at += found.values()
                    rest = b.select(["id", "content"]).take(pa.array(row, pa.int64()))
                    yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(key, pa.binary()), pa.array(at, pa.list_(pa.int32()))], names=["id", "content", "key", "at"])

        return d.mapInArrow(keys, f"id {docs.schema[id].dataType.simpleString()}, content long, key binary, at array<int>")

    def shard(self) -> F.Column:
        return F.pmod(F.xxhash64("key"), F.lit(self.shards)).cast("int").alias("shard")

    def held(self, keys: DataFrame, copies: int) -> DataFrame:
        """Of the distinct `keys` those that the filters hold in so many copies: all that really are held, and few others."""

        def probe(_, table: pa.Table, filters: pa.Table) -> pa.Table:
            if not filters.num_rows or not table.num_rows:
                return pa.table({"key": pa.array([], pa.binary())})
            x = CuckooFilter(filters.column("cuckoo")[0].as_py())
            return table.select(["key"]).filter(pa.array(x.copies(read_keys(table)) >= copies))

        filters = self.spark.read.parquet(self.filters)
        return keys.select(self.shard(), "key").groupBy("shard").cogroup(filters.groupBy("shard")).applyInArrow(probe, "key binary")

    def change(self, delta: DataFrame) -> LineIndex:
        """The index after the rows (key, id, n) of `delta`, n below zero for what goes."""
        path = self.write(delta)
        delta = self.spark.read.parquet(path)
        both = delta.select("key", "id", F.lit(0).cast("long").alias("old"), F.col("n").alias("new"))
        if self.filters:
            known = self.held(delta.select("key").distinct(), 1)
            both = both.union(self.log.join(known, "key", "left_semi").select("key", "id", "n", F.lit(0).cast("long")))
        each = both.groupBy("key", "id").agg(F.sum("old").alias("old"), F.sum("new").alias("new"))
        n = lambda c: F.least(F.count_if(c), F.lit(2))
        moves = each.groupBy("key").agg((n(F.col("old") + F.col("new") > 0) - n(F.col("old") > 0)).cast("int").alias("move")).where("move <> 0")

        def update(key, table: pa.Table, filters: pa.Table) -> pa.Table:
            table = table.take(pc.sort_indices(table.column("key"))) if table.num_rows else table
            keys, move = read_keys(table), table.column("move").to_numpy()
            x = CuckooFilter(filters.column("cuckoo")[0].as_py()) if filters.num_rows else CuckooFilter.sized(int(np.maximum(move, 0).sum()))
            for least in (1, 2):
                x.remove(keys[move <= -least])
                x.add(keys[move >= least])
            return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "cuckoo": pa.array([x.to_bytes()], pa.binary())})

        moves = moves.select(self.shard(), "key", "move")
        filters = self.spark.read.parquet(self.filters) if self.filters else self.spark.createDataFrame([], "shard int, cuckoo binary")
        filters = moves.groupBy("shard").cogroup(filters.groupBy("shard")).applyInArrow(update, "shard int, cuckoo binary")
        return LineIndex(self.spark, self.shards, least=self.least, log=(*self.paths, path), filters=self.write(filters))

    def insert(self, references: DataFrame) -> LineIndex:
        """The index with the documents of these `references`."""
        return self.change(references.groupBy("key", "id").agg(F.count("*").alias("n")))

    def delete(self, ids: DataFrame) -> LineIndex:
        """The index without the documents whose ids `ids` (one column, each id once) names, as if they had never come; their texts are not needed."""
        gone = self.log.join(ids.toDF("gone"), F.col("id").eqNullSafe(F.col("gone")), "left_semi")
        return self.change(gone.groupBy("key", "id").agg((-F.sum("n")).alias("n")).where("n <> 0"))

    def repeats(self, references: DataFrame) -> DataFrame:
        """Rows (id, content, gone): the numbers of the lines of each row that a document of smaller id holds too."""
        maybe = self.held(references.select("key").distinct(), 2)
        # Dealt anew by key and document, so that the join can split the references of a frequent key.
        held = self.log.join(maybe, "key", "left_semi").repartition("key", "id")
        shared = stored(counted(held).where("documents > 1").select("key", "none", "first"))
        later = references.join(shared, "key").where(F.col("id").isNotNull() & (F.col("none") | (F.col("first") < F.col("id")))).repartition("id", "content")
        each = later.groupBy("id", "content", "key").agg(F.first("at").alias("at"))
        return each.groupBy("id", "content").agg(F.flatten(F.collect_list("at")).alias("gone"))


def content(id: str, text: str) -> F.Column:
    """64 bits of an id and a text, which with the id name a row's contents."""
    return F.xxhash64(id, text).alias("content")


def strip_lines(docs: DataFrame, gone: DataFrame, *, id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows (id, n_lines, n_dropped, kept, *carry): each text without the lines that `gone`, made by `LineIndex.repeats`, numbers."""
    gone = stored(gone).select(F.col("id").alias("g"), F.col("content").alias("c"), "gone")
    d = docs.select(F.col(id).alias("id"), content(id, text), F.encode(F.coalesce(text, F.lit("")), "utf-8").alias("text"), *[F.col(c).alias(f"carry_{c}") for c in carry])
    d = d.join(gone, F.col("id").eqNullSafe(F.col("g")) & (F.col("content") == F.col("c")), "left").drop("g", "c", "content")
    fields = "".join(f", `carry_{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)

    def strip(batches):
        for batch in batches:
            for b in portions(batch, "text"):
                n, dropped, kept = [], [], []
                for raw, gone in zip(b.column("text").to_pylist(), b.column("gone").to_pylist()):
                    lines = raw.split(b"\n")
                    out = set(gone or ())
                    n.append(len(lines))
                    dropped.append(len(out))
                    kept.append(b"\n".join([x for k, x in enumerate(lines) if k not in out]) if out else raw)
                rest = [b.column(f"carry_{c}") for c in carry]
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.binary()), *rest], names=["id", "n_lines", "n_dropped", "kept", *(f"carry_{c}" for c in carry)])

    out = d.mapInArrow(strip, f"id {docs.schema[id].dataType.simpleString()}, n_lines long, n_dropped long, kept binary{fields}")
    return out.select(F.col("id").alias(id), "n_lines", "n_dropped", F.decode("kept", "utf-8").alias("kept"), *[F.col(f"carry_{c}").alias(c) for c in carry])


def dedup_lines(docs: DataFrame, *, id: str = "doc_id", text: str = "text", least: int = 10, carry: tuple[str, ...] = (), per_shard: int = 1 << 14) -> tuple[DataFrame, LineIndex]:
    """(rows (id, n_lines, n_dropped, kept, *carry), index): `docs` without the lines that a document of smaller id holds, and the index of all.

    A text is split at newlines. The key of a line is the line without ASCII white space at both ends, A-Z lower-cased. A key of
    at least `least` code points that several documents hold stays, as often as it is there, in the one of smallest id; the others lose
    all its lines. The rest of each text stays as it was. Later batches go on from the index: `insert` their references, take `repeats`,
    `strip_lines`; `delete` takes documents out again.

    Lines are told apart by 128 bits and counted exactly per document; shards of about `per_shard` references each keep the filters, whatever
    keys are frequent, as a shard gets each key once. A null text is empty and has one empty line; a null id is the smallest;
    rows of one id are one document; equal rows give equal results; other columns, whatever their names, matter only if named in `carry`.
    An empty table gives no rows.
    """
    empty = LineIndex(docs.sparkSession, 1, least=least)
    references = stored(empty.references(docs, id, text))
    index = LineIndex(docs.sparkSession, 1 + references.count() // per_shard, least=least).insert(references)
    return strip_lines(docs, index.repeats(references), id=id, text=text, carry=carry), index


OP11_SQL = """WITH l AS (SELECT doc_id, k, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS k FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))),
f AS (SELECT key, min(doc_id) AS first FROM l WHERE length(key) >= 10 GROUP BY key),
m AS (SELECT l.*, coalesce(f.first < doc_id, false) AS gone FROM l LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id"""


def op11_lines(spark, sf_dir: str) -> DataFrame:
    kept, _ = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
