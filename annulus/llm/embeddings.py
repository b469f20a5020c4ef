"""Embedding near-duplicates by sorted projection passes."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, forest


def rows_of(column, kind: str) -> list[np.ndarray | None]:
    """The vectors of an Arrow list column in the precision `kind`, None where one is null or has a null component."""
    out = []
    for v in column:
        values = v.values
        out.append(None if values is None or values.null_count else values.to_numpy(zero_copy_only=False).astype(kind))
    return out


def planes_of(dim: int, passes: int, bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, passes * bits))


def units_of(column, at: np.ndarray, kind: str) -> np.ndarray:
    """The unit vectors, in double precision, of those stored at the given rows, which all have the same length."""
    x = np.frombuffer(b"".join(column.take(pa.array(at)).to_pylist()), dtype=kind).reshape(len(at), -1).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def passes_for(n: int, window: int, miss: float) -> int:
    """Passes after which two vectors at cosine 0.98 of n have not met with a chance of `miss` at most; a sign of theirs differs with probability 0.064."""
    meet = 0.936 ** max(0.0, math.log2(max(n, 1) / window))
    return max(1, math.ceil(math.log(miss) / math.log(1 - meet))) if meet < 1 - miss else 1


def near_vectors(
    vectors: DataFrame, *, id: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = 0.98,
    passes: int | None = None, miss: float = 1e-3, window: int = 64, bits: int = 64, seed: int = 42, tile: int = 1024, per_group: int = 20_000,
) -> DataFrame:
    """Rows (id, n_links, component_id, kept) of vectors linked by cosine >= `least` under equal labels.

    Equal vectors of one label form a class, which is compared once. Each pass gives a class a key, the signs of `bits`
    random projections in order, and sorts the classes of a label by it; each is compared with the `window` next ones
    of its range in double precision. The verified links of all passes are united into components. The window bounds the work of a
    pass, not the links: within a component all pairs are then compared exactly in squares of `tile`
    classes, which count the links of every member and return no pairs. What can be missed is a component that no pass joins: at a cosine of 0.98
    a sign differs with probability 0.064, so two vectors of a label with n others meet within a window in a pass with a chance of 0.936 ** log2(n / window);
    `passes` is chosen from the largest label so that two such vectors are missed with a chance of `miss` at most (5,000: 7 passes; 2**20: 14; 4e7: 22).
    Passes carry the vectors in their own precision and compare in double.

    Vectors that are null, zero or hold null or non-finite components, and vectors with a null label, link with
    nothing: n_links 0, component_id their own id, kept. Vectors of different lengths do not link. Each input row
    is one vector, so repeated rows are linked copies. An empty table gives none.
    """

    def prepare(batches):
        for b in batches:
            ids, labels, digests, units, dims = b.column("id").to_pylist(), b.column("label").to_pylist(), [], [], []
            for raw, lab in zip(rows_of(b.column("vector"), store), labels):
                x = None if raw is None else raw.astype(np.float64)
                norm = 0.0 if x is None or not len(x) or not np.isfinite(x).all() else float(np.linalg.norm(x / max(np.abs(x).max(), 1e-300)))
                if lab is None or norm == 0.0:
                    digests.append(None), units.append(None), dims.append(None)
                    continue
                x = (x + 0.0) / np.abs(x).max()  # + 0.0: no negative zeros
                digests.append(hashlib.blake2b(repr(lab).encode() + b"\0" + x.tobytes(), digest_size=16).digest())
                units.append(raw.tobytes())
                dims.append(len(x))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(labels, b.column("label").type), pa.array(dims, pa.int32()), pa.array(digests, pa.binary()), pa.array(units, pa.binary())], names=["id", "label", "dim", "digest", "unit"])

    store = "<f4" if vectors.schema[vector].dataType.elementType.typeName() == "float" else "<f8"
    kind = vectors.schema[label].dataType.simpleString()
    v = vectors.select(F.col(id).cast("long").alias("id"), F.col(vector).alias("vector"), F.col(label).alias("label"))
    v = cut(v.mapInArrow(prepare, f"id long, label {kind}, dim int, digest binary, unit binary"))
    fair = v.where("digest is not null")
    classes = fair.groupBy("digest", "label", "dim").agg(F.min(F.struct("id", "unit")).alias("m"), F.count("*").alias("copies"))
    classes = cut(classes.select("digest", "label", "dim", F.xxhash64("digest").alias("cls"), F.col("m.id").alias("first_id"), "m.unit", "copies"))

    def keys(batches):
        for b in batches:
            dim = b.column("dim").to_numpy()
            for d in np.unique(dim):
                at = np.nonzero(dim == d)[0]
                x = units_of(b.column("unit"), at, store)
                sign = (x @ planes_of(int(d), passes, bits, seed) > 0).reshape(len(at), passes, bits)
                packed = np.packbits(sign, axis=2)
                sub = b.take(pa.array(at))
                for p in range(passes):
                    key = pa.array([k.tobytes() for k in packed[:, p]], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), p, dtype=np.int32)), sub.column("label"), sub.column("dim"), key, sub.column("cls"), sub.column("unit")], names=["pass", "label", "dim", "key", "cls", "unit"])

    def sweep(batches):
        """Compare each row of a sorted range with the rows of the window before it; keep the last of them between batches."""
        tail = None
        for b in batches:
            t = pa.Table.from_batches([b])
            old = 0 if tail is None else tail.num_rows
            t = pa.concat_tables([tail, t]).combine_chunks() if old else t
            run, lab, dim = t.column("pass").to_numpy(), t.column("label").to_pylist(), t.column("dim").to_numpy()
            code = {}
            group = np.array([code.setdefault(k, len(code)) for k in zip(run.tolist(), lab, dim.tolist())])
            cls = t.column("cls").to_numpy()
            units = t.column("unit").combine_chunks()
            pairs = [np.empty((2, 0), dtype=np.int64)]
            for g in range(len(code)):
                at = np.nonzero(group == g)[0]
                x = units_of(units, at, store)
                for s in range(1, min(window + 1, len(at))):
                    hit = np.nonzero((np.einsum("ij,ij->i", x[s:], x[:-s]) >= least) & (at[s:] >= old))[0]
                    pairs.append(np.stack([at[hit], at[hit + s]]))
            a, c = np.concatenate(pairs, axis=1)
            root = forest(a, c, len(cls))
            k = np.nonzero(root != np.arange(len(root)))[0]
            yield pa.RecordBatch.from_arrays([pa.array(cls[k]), pa.array(cls[root[k]])], names=["a", "b"])
            tail = t.slice(max(0, t.num_rows - window))

    if passes is None:
        passes = passes_for(classes.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 1, window, miss)
    n = classes.count()
    ranges = max(1, n * passes // 50_000)
    spread = classes.select("label", "dim", "cls", "unit").mapInArrow(keys, f"pass int, label {kind}, dim int, key binary, cls long, unit binary")
    ordered = spread.repartitionByRange(ranges, "pass", "label", "dim", "key", "cls").sortWithinPartitions("pass", "label", "dim", "key", "cls")
    roots = components(ordered.mapInArrow(sweep, "a long, b long"))
    members = roots.union(roots.select("root", "root").distinct())
    members = cut(members.join(classes, members["node"] == classes["cls"]).select("root", "cls", "first_id", "copies", "unit"))

    # Exact counts inside the components: squares of the large ones, and groups of whole small ones.
    size = members.groupBy("root").agg(F.ceil(F.count("*") / tile).cast("int").alias("parts"), F.min("first_id").alias("component_id"))
    batches_of = max(1, members.count() // per_group + 1)
    m = members.join(size, "root").withColumn("part", F.pmod(F.xxhash64("cls"), "parts").cast("int"))
    group = F.when(F.col("parts") > 1, F.col("root")).otherwise(F.pmod(F.xxhash64("root"), F.lit(batches_of)))
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    columns = ["root", "cls", "copies", "unit", (F.col("parts") > 1).alias("large"), group.alias("grp")]
    left = m.select(*columns, F.lit(True).alias("left"), F.col("part").alias("i"), every.alias("j"))
    right = m.select(*columns, F.lit(False).alias("left"), every.alias("i"), F.col("part").alias("j"))

    def square(t: pa.Table) -> pa.Table:
        units = t.column("unit").combine_chunks()
        root, cls, copies, is_left = (t.column(c).to_numpy() for c in ("root", "cls", "copies", "left"))
        order = np.argsort(root, kind="stable")
        bounds = np.nonzero(np.diff(root[order], prepend=root[order][0] - 1))[0].tolist() + [len(order)]
        names, counts = [], []
        for s, e in zip(bounds, bounds[1:]):
            at = order[s:e]
            a, b = at[is_left[at]], at[~is_left[at]]
            if not len(a) or not len(b):
                continue
            hit = units_of(units, a, store) @ units_of(units, b, store).T >= least
            hit &= cls[a][:, None] != cls[b][None, :]
            names.append(cls[a])
            counts.append(hit @ copies[b])
        if not names:
            return pa.table({"cls": pa.array([], pa.int64()), "links": pa.array([], pa.int64())})
        return pa.table({"cls": np.concatenate(names), "links": np.concatenate(counts).astype(np.int64)})

    links = left.union(right).groupBy("large", "grp", "i", "j").applyInArrow(square, "cls long, links long").groupBy("cls").agg(F.sum("links").alias("links"))
    found = m.select("cls", "component_id").join(links, "cls", "left")
    each = classes.select("digest", "cls", "first_id", "copies").join(found, "cls", "left").select("digest", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "first_id").alias("component_id"))
    out = v.select("id", "digest").join(each, "digest", "left").select(F.col("id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.select(F.col("id").alias(id), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op1_embeddings(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
