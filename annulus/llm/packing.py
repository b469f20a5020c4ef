"""Best-fit packing by a configuration linear program over the length histogram."""

from __future__ import annotations

import base64
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, lean_batches

SPECIAL = "<|endoftext|>"


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """The byte-level BPE of `path`, a file of tiktoken ranks or of the tokenizers library."""
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        return lambda text: t.encode(text, add_special_tokens=False).ids
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    t = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: len(ranks)})
    return lambda text: t.encode(text, allowed_special="all")


def cut_points(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: all of `size` but the first, which may be shorter."""
    first = n % size or size
    return [(0, first), *((s, size) for s in range(first, n, size))]


def pieces(docs: DataFrame, path: str, *, id: str = "doc_id", text: str = "text", size: int = 1024, end: int = 2) -> DataFrame:
    """Rows (id, piece, start, length, ids_crc32) of each document's ids followed by `end`."""

    def run(batches):
        encode = tokenizer(path)
        for b in batches:
            out: list[list[int]] = [[], [], [], [], []]
            for i, t in zip(b.column("id").to_pylist(), b.column("text")):
                ids = np.array([*encode(t.as_py() or ""), end], dtype="<u4")
                for k, (s, n) in enumerate(cut_points(len(ids), size)):
                    for c, v in zip(out, (i, k, s, n, zlib.crc32(ids[s : s + n].tobytes()))):
                        c.append(v)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(lambda b: lean_batches(run(b)), "id long, piece int, start long, length long, ids_crc32 long")


def knapsack(value: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(value, first length) of the best configuration of each capacity, by dynamic programming; of equals the one with the longest piece."""
    have = np.nonzero(value > 0)[0][::-1]
    fits = np.searchsorted(-have, -np.arange(size + 1))
    best, first = np.zeros(size + 1), np.zeros(size + 1, dtype=np.int64)
    for c in range(1, size + 1):
        k = fits[c]
        if k < len(have):
            gains = value[have[k:]] + best[c - have[k:]]
            i = int(gains.argmax())
            best[c], first[c] = gains[i], have[k + i]
    return best, first


def with_piece(length: int, first: np.ndarray, size: int) -> list[int]:
    """The best configuration that holds a piece of this length."""
    out, room = [length], size - length
    while room > 0 and first[room]:
        out.append(int(first[room]))
        room -= out[-1]
    return out


def prices(count: np.ndarray, size: int, *, rounds: int = 24, rate: float = 0.005, power: float = 1.05) -> tuple[np.ndarray, float]:
    """(price of each length, lower bound of the number of sequences) by multiplicative weights.

    The linear program is: least total of configurations such that each length is covered; its dual: prices of the lengths such that no
    configuration costs more than 1. A round prices configurations by a knapsack, covers each length in demand by the best one that holds it,
    and lowers the prices of lengths that are covered beyond their share. Prices start a little steeper than the lengths, as
    long pieces are harder to place. The mean of the rounds' prices, each scaled to be feasible, is the solution of the dual.
    """
    need = np.nonzero(count)[0]
    demand = (count[need] * need).astype(float)
    weight, total = power * np.log(need / size), np.zeros(size + 1)
    for _ in range(rounds):
        y = np.zeros(size + 1)
        y[need] = np.exp(weight)
        best, first = knapsack(y, size)
        total += y / best[size]
        covered = np.zeros(size + 1)
        for ell in need.tolist():
            for k in with_piece(ell, first, size):
                covered[k] += count[ell]
        share = covered[need] * need
        weight -= rate * np.clip(share / share.sum() / (demand / demand.sum()) - 1, -1, 1)
    y = total / rounds
    return y, float((count * y).sum() / knapsack(y, size)[0][size])


def dive(left: np.ndarray, y: np.ndarray, size: int) -> list[tuple[np.ndarray, int]]:
    """Whole numbers of configurations that hold all pieces of `left`, priced by y.

    The best configuration that holds the longest piece left is taken the greatest number of times that the pieces left allow, until none is left.
    A knapsack is solved again when a length that it uses has run out.
    """
    out, left, first = [], left.copy(), None
    while left.any():
        longest = int(np.nonzero(left)[0][-1])
        held = with_piece(longest, first, size) if first is not None else None
        if held is None or (left[held] == 0).any():
            first = knapsack(np.where(left > 0, y, 0.0), size)[1]
            held = with_piece(longest, first, size)
        config = np.minimum(np.bincount(held, minlength=size + 1), left)
        room = size - int((config * np.arange(size + 1)).sum())
        while room > 0:  # a length asked for more often than there are pieces leaves room
            fits = np.nonzero(left[: room + 1] > config[: room + 1])[0]
            if not len(fits):
                break
            config[fits[-1]] += 1
            room -= int(fits[-1])
        used = np.nonzero(config)[0]
        times = int((left[used] // config[used]).min())
        left[used] -= times * config[used]
        out.append((config, times))
    return out


def plan(count: np.ndarray, size: int, *, powers: tuple[float, ...] = (1.05, 1.1, 1.02)) -> list[tuple[np.ndarray, int]]:
    """Configurations and their numbers that hold `count[l]` pieces of each length l, in few sequences.

    The configuration program is solved for prices (`prices`) and rounded by diving (`dive`), from up to three starts of the weights until the
    number of sequences is the least that the tokens allow; the fewest are kept. All of it
    works on `size` numbers, whatever the number of documents.
    """
    whole = np.zeros(size + 1, dtype=np.int64)
    whole[size] = 1
    full, left = int(count[size]), count.copy()
    left[size] = 0
    out = [(whole, full)] if full else []
    if not left.any():
        return out
    least, best = -(-int((left * np.arange(size + 1)).sum()) // size), None
    for power in powers:
        found = dive(left, prices(left, size, power=power)[0], size)
        if best is None or sum(n for _, n in found) < sum(n for _, n in best):
            best = found
        if sum(n for _, n in best) == least:
            break
    return out + best


def places(solution: list[tuple[np.ndarray, int]], size: int) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length the runs of ranks that one configuration holds: (first rank, per sequence, first sequence, offset)."""
    runs: dict[int, list] = {}
    seen, sequence = np.zeros(size + 1, dtype=np.int64), 0
    for config, n in solution:
        offset = 0
        for ell in np.nonzero(config)[0][::-1]:
            a = int(config[ell])
            runs.setdefault(int(ell), []).append((int(seen[ell]), a, sequence, offset))
            seen[ell] += a * n
            offset += a * int(ell)
        sequence += n
    return {ell: tuple(np.array(c, dtype=np.int64) for c in zip(*r)) for ell, r in runs.items()}


def pack(cut_pieces: DataFrame, *, size: int = 1024, per_slice: int = 50_000) -> DataFrame:
    """`cut_pieces` (id, piece, start, length, ids_crc32) with sequence_id and offset.

    The histogram of lengths (at most `size` rows) goes to the driver, the plan comes back as a table of ranks,
    and each piece finds its place from its rank among the pieces of its length. Ranks come from counts per
    (length, slice of the row's hash) and a window inside each; a slice holds about `per_slice` pieces of the
    commonest length, so a length that most pieces share is spread at any size.
    Repeated rows and rows with a null id are packed once each. An empty table gives none.
    """
    count = np.zeros(size + 1, dtype=np.int64)
    for r in cut_pieces.groupBy("length").count().collect():
        count[r["length"]] = r["count"]
    slices = int(count.max()) // per_slice + 1
    p = cut_pieces.withColumn("slice", F.pmod(F.xxhash64("id", "piece", "start", "ids_crc32"), F.lit(slices)).cast("int"))
    where = places(plan(count, size), size)
    per = p.groupBy("length", "slice").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.select("length", "slice", before.alias("before"))
    rank = F.row_number().over(Window.partitionBy("length", "slice").orderBy("id", "piece", "start", "ids_crc32")) - 1
    p = p.join(per, ["length", "slice"]).withColumn("rank", F.col("before") + rank).drop("slice", "before")
    names = [c for c in p.columns if c != "rank"]

    def put(batches):
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            sequence, offset = np.empty(len(rank), dtype=np.int64), np.empty(len(rank), dtype=np.int64)
            for ell in np.unique(length):
                at = np.nonzero(length == ell)[0]
                first, each, base, start = where[int(ell)]
                k = np.searchsorted(first, rank[at], side="right") - 1
                inside = rank[at] - first[k]
                sequence[at] = base[k] + inside // each[k]
                offset[at] = start[k] + inside % each[k] * ell
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return p.mapInArrow(put, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in p.schema if f.name != "rank") + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, *, id: str = "doc_id", text: str = "text", size: int = 1024, end: int = 2) -> DataFrame:
    """Pack the tokens of `docs` into sequences of at most `size`; a null text is an empty one. Each text is encoded once."""
    packed = pack(cut(pieces(docs, path, id=id, text=text, size=size, end=end)), size=size)
    return packed.select(F.col("id").alias(id), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def default_tokenizer() -> str:
    """Ranks of the 50k byte-level BPE: the same ids as the JSON file of that vocabulary, in a sixth of the time."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op10_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer())
