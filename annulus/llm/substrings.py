"""Substring dedup: windows of words that occur before, found by a count-min prefilter and an exact grouping."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import Words, block_of, blocks_for, lean

#: Odd multipliers of the sketch's rows.
ROWS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Cells of the sketch that one group merges.
SEGMENT_BITS = 24


def joined(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """64 bits made of both hashes of a window."""
    return (low ^ (high.astype(np.uint64) << np.uint64(17))) * np.uint64(ROWS[0]) + high


def planes(x: np.ndarray) -> bytes:
    """Bytes of the numbers, all lowest bytes first: small numbers compress well in the shuffle."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def unplanes(raw: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(width, -1).T).reshape(-1).view(kind)


class Windows:
    """The windows of a block of documents, in the order of (doc_id, row): their hashes, documents and starts."""

    def __init__(self, table: pa.Table, n: int):
        ids = table.column("id")
        self.null = np.asarray(ids.is_null())
        ids = ids.fill_null(np.iinfo(np.int64).min).to_numpy()
        self.order = np.argsort(ids, kind="stable")
        self.ids = ids[self.order]
        texts = table.column("text")
        self.missing = np.asarray(texts.is_null())[self.order]
        self.words = Words([(texts[int(k)].as_py() or "").encode() for k in self.order])
        self.first = self.words.first
        self.at, self.hashes = self.words.windows(n)
        self.doc = np.searchsorted(self.first, self.at, side="right") - 1
        self.start = self.at - self.first[self.doc]
        #: Windows in the order of (doc_id, start): where rows repeat an id, an earlier start in a later row comes first.
        ids = self.ids[self.doc]
        repeated = len(ids) and (self.ids[1:] == self.ids[:-1]).any()
        self.places = np.lexsort((self.start, ids)) if repeated else np.arange(len(ids))
        #: First window of the block with the same words, told apart by both hashes.
        self.same = self.number(self.hashes[0])
        if len(self.same) and (self.hashes[1] != self.hashes[1][self.earliest][self.same]).any():
            both = np.stack([self.same, self.number(self.hashes[1])])
            self.same = self.number(both[0] << 32 | both[1])

    def number(self, key: np.ndarray) -> np.ndarray:
        """Numbers of equal keys; their first places in the order of (doc_id, start) go to `earliest`."""
        same, _ = pd.factorize(key)
        self.earliest = np.zeros(same.max() + 1 if len(same) else 0, dtype=np.int64)
        last = self.places[::-1]
        self.earliest[same[last]] = last
        return same

    def cells(self, row: int, bits: int) -> np.ndarray:
        return (self.hashes[0][self.earliest] * np.uint64(ROWS[row])) >> np.uint64(64 - bits)


def repeated_words(docs: DataFrame, *, id: str = "doc_id", text: str = "text", window: int = 20, carry: tuple[str, ...] = (), original: bool = False, per_block: int = 8 << 20) -> DataFrame:
    """Rows (id, n_words, n_removed, kept, *carry): the words of each document outside windows that occur before.

    A window is `window` consecutive words; one whose words also start earlier (in a smaller id, or earlier in the same document)
    is removed from the document, whatever else is removed. Documents are dealt to blocks of about `per_block` bytes by the
    hash of their id, once, and each of three passes reads a block whole:

    1. A block sends the cells that its windows hit in a count-min sketch of two rows, each about as many cells
       as the texts have bytes. The sketches are merged segment by segment, and each block learns which of its cells are
       hit more than once. The counts can only be too high, so every repeated window passes.
    2. A block sends the windows that pass by 96 bits of hash and the shard that further bits choose (inside a block
       128 bits tell windows apart), each once with its earliest place. They are grouped exactly, and each block learns which of its
       windows start earlier elsewhere.
    3. A block removes those and its own repeats.

    Messages hold one entry per block and window, so a passage that many documents share is a row per block, not
    per document. A null text has no words; texts shorter than a window keep all; a null id counts as
    the smallest, and such rows are dealt by their text; rows that repeat an id, or have none, are the same document's place, so of
    them only an earlier start precedes. Each row gives one, with its columns `carry` as they are, whatever their names. kept has one space
    between words, but with `original` a text that loses nothing is returned as it was. Empty tables give no rows.
    """
    total, n = blocks_for(docs, text, per_block)
    bits = max(16, int(total).bit_length())
    segment = min(SEGMENT_BITS, bits)
    shards = max(1, n // 4)
    carried = [F.col(c).alias(f"carry_{c}") for c in carry]
    d = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"), *carried).withColumn("block", block_of("id", n, "text")).repartition("block")
    fields = "".join(f", `carry_{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)

    def ask(table: pa.Table) -> pa.Table:
        w = Windows(table, window)
        out = {"block": [], "line": [], "segment": [], "cells": []}
        for row in range(len(ROWS)):
            cells = np.unique(w.cells(row, bits))
            part = (cells >> np.uint64(segment)).astype(np.int64)
            for k in np.unique(part):
                a, b = np.searchsorted(part, (k, k + 1))
                gaps = np.diff((cells[a:b] & np.uint64((1 << segment) - 1)).astype(np.uint32), prepend=np.uint32(0))
                for name, v in zip(out, (table.column("block")[0].as_py(), row, int(k), planes(gaps))):
                    out[name].append(v)
        return pa.table(out, schema=pa.schema({"block": pa.int32(), "line": pa.int32(), "segment": pa.int64(), "cells": pa.binary()}))

    def merge(table: pa.Table) -> pa.Table:
        counts = np.zeros(1 << segment, dtype=np.uint8)
        sketches = [np.cumsum(unplanes(c.as_py(), np.uint32), dtype=np.int64) for c in table.column("cells")]
        for cells in sketches:
            counts[cells] = np.minimum(counts[cells] + 1, 2)
        hit = [np.packbits(counts[cells] > 1).tobytes() for cells in sketches]
        return table.drop_columns(["cells"]).append_column("hit", pa.array(hit, pa.binary()))

    def estimated(w: Windows, answers: pa.Table) -> np.ndarray:
        """Of the block's distinct windows, those that the merged sketch counts more than once."""
        many = np.bincount(w.same) > 1 if len(w.same) else np.zeros(0, dtype=bool)
        passed = np.ones(len(w.earliest), dtype=bool)
        lines = answers.column("line").to_numpy()
        for row in range(len(ROWS)):
            own = w.cells(row, bits)
            cells, counts = np.unique(own, return_counts=True)
            part = (cells >> np.uint64(segment)).astype(np.int64)
            flag = np.zeros(len(cells), dtype=bool)
            for k in np.nonzero(lines == row)[0]:
                a, b = np.searchsorted(part, (answers.column("segment")[int(k)].as_py(), answers.column("segment")[int(k)].as_py() + 1))
                flag[a:b] = np.unpackbits(np.frombuffer(answers.column("hit")[int(k)].as_py(), dtype=np.uint8), count=b - a).astype(bool)
            passed &= (flag | (counts > 1))[np.searchsorted(cells, own)]
        return passed | many

    def send(key, table: pa.Table, answers: pa.Table) -> pa.Table:
        w = Windows(table, window) if table.num_rows else None
        out = {"block": [], "shard": [], "low": [], "high": [], "id": [], "start": []}
        if w is not None and len(w.earliest):
            at = w.earliest[estimated(w, answers)]
            shard = (w.hashes[1][at] >> np.uint64(32)) % np.uint64(shards)
            at = at[np.argsort(shard, kind="stable")]
            shard = np.sort(shard)
            for k in np.unique(shard):
                a, b = np.searchsorted(shard, (k, k + np.uint64(1)))
                x = at[a:b]
                high = (w.hashes[1][x] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                for name, v in zip(out, (key[0].as_py(), int(k), planes(w.hashes[0][x]), planes(high), planes(w.ids[w.doc[x]]), planes(w.start[x].astype(np.uint32)))):
                    out[name].append(v)
        return pa.table(out, schema=pa.schema({"block": pa.int32(), "shard": pa.int32(), "low": pa.binary(), "high": pa.binary(), "id": pa.binary(), "start": pa.binary()}))

    def group(table: pa.Table) -> pa.Table:
        read = lambda name, kind: [unplanes(c.as_py(), kind) for c in table.column(name)]
        low = read("low", np.uint64)
        block = np.repeat(table.column("block").to_numpy(), [len(x) for x in low])
        low, high, ids, start = np.concatenate(low), np.concatenate(read("high", np.uint32)), np.concatenate(read("id", np.int64)), np.concatenate(read("start", np.uint32))
        order = np.lexsort((start, ids, high, low))
        low, high, ids, start, block = low[order], high[order], ids[order], start[order], block[order]
        new = np.ones(len(low), dtype=bool)
        new[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
        head = np.nonzero(new)[0][np.cumsum(new) - 1]
        later = (ids > ids[head]) | (start > start[head])
        low, high, block = low[later], high[later], block[later]
        order = np.argsort(block, kind="stable")
        block, low, high = block[order], low[order], high[order]
        names = np.unique(block)
        of = lambda x, k: x[slice(*np.searchsorted(block, (k, k + 1)))].tobytes()
        return pa.table({"block": pa.array(names, pa.int32()), "low": pa.array([of(low, k) for k in names], pa.binary()), "high": pa.array([of(high, k) for k in names], pa.binary())})

    def strip(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return kept_schema.empty_table()
        w = Windows(table, window)
        gone = np.zeros(len(w.same), dtype=bool)
        if len(gone):
            head = w.earliest[w.same]
            gone = (w.ids[w.doc] > w.ids[w.doc[head]]) | (w.start > w.start[head])
            if answers.num_rows:
                low, high = (np.concatenate([np.frombuffer(x.as_py(), dtype=k) for x in answers.column(c)]) for c, k in (("low", np.uint64), ("high", np.uint32)))
                own_low, own_high = w.hashes[0][w.earliest], (w.hashes[1][w.earliest] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                gone |= (np.isin(own_low, low) & np.isin(joined(own_low, own_high), joined(low, high)))[w.same]
        cover = np.zeros(int(w.first[-1]) + 1, dtype=np.int64)
        np.add.at(cover, w.at[gone], 1)
        np.add.at(cover, w.at[gone] + window, -1)
        cover = np.cumsum(cover) > 0
        cover = cover[:-1]
        removed = np.add.reduceat(np.append(cover, False).astype(np.int64), w.first[:-1]) * (w.words.counts > 0)
        kept = []
        for k, raw in enumerate(w.words.texts):
            if removed[k]:
                at = w.first[k] + np.nonzero(~cover[w.first[k] : w.first[k + 1]])[0]
                kept.append(b" ".join([raw[a:b] for a, b in zip(w.words.start[at].tolist(), w.words.end[at].tolist())]).decode())
            elif original and w.missing[k]:
                kept.append(None)
            else:
                kept.append((raw if original else b" ".join(raw.split())).decode())
        ids = pa.array(w.ids, mask=w.null[w.order])
        rest = table.take(pa.array(w.order)) if carry else table
        return pa.table([ids, pa.array(w.words.counts), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), *(rest.column(f"carry_{c}") for c in carry)], schema=kept_schema)

    kept_schema = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), *to_arrow_schema(d.select(*[f"carry_{c}" for c in carry]).schema)])
    cells = d.groupBy("block").applyInArrow(lambda t: lean(ask(t)), "block int, line int, segment long, cells binary")
    hits = cells.groupBy("line", "segment").applyInArrow(lambda t: lean(merge(t)), "block int, line int, segment long, hit binary")
    sent = d.groupBy("block").cogroup(hits.groupBy("block")).applyInArrow(lambda k, t, a: lean(send(k, t, a)), "block int, shard int, low binary, high binary, id binary, start binary")
    later = sent.groupBy("shard").applyInArrow(lambda t: lean(group(t)), "block int, low binary, high binary")
    return d.groupBy("block").cogroup(later.groupBy("block")).applyInArrow(lambda t, a: lean(strip(t, a)), f"id long, n_words long, n_removed long, kept string{fields}").select(F.col("id").alias(id), "n_words", "n_removed", "kept", *[F.col(f"carry_{c}").alias(c) for c in carry])


def op8_substrings(spark, sf_dir: str) -> DataFrame:
    r = repeated_words(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return r.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
