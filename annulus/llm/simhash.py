"""SimHash near-duplicates by tiled exact comparison of fingerprints."""

from __future__ import annotations

import itertools
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, components, cut, forest, lean, lean_batches, mixed, portions, stored

#: Quarters of a fingerprint whose population counts name its tile.
PARTS, WIDTH = 4, 16


def fingerprint(text: str | None, k: int = 3, seed: int = 42) -> bytes:
    """SimHash of a text: big-endian bytes of 64 majority bits over the XXH64 of its k-word shingles."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and the six white-space characters only
    if not words:
        return bytes(8)
    if len(words) <= k:
        return xxhash.xxh64_digest(b" ".join(words), seed)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - np.array([len(w) + 1 for w in words]))[: len(words) - k + 1].tolist()
    digest = xxhash.xxh64_digest
    h = b"".join([digest(line[a:b], seed) for a, b in zip(starts, (ends[k - 1 :] - 1).tolist())])
    ones = np.zeros(64, dtype=np.int64)
    n = len(h) // 8
    rows = np.frombuffer(h, dtype=np.uint8).reshape(-1, 8)
    for at in range(0, n, 255):  # sums of bytes that can't overflow, and few bits unpacked at a time
        ones += np.unpackbits(rows[at : at + 255], axis=1).sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > n).tobytes()


def fingerprints(docs: DataFrame, *, id: str = "doc_id", text: str = "text", k: int = 3) -> DataFrame:
    """Rows (id, fp) with fp the fingerprint as a signed 64-bit number."""

    def run(batches):
        for b in batches:
            fp = b"".join([fingerprint(t.as_py(), k) for t in b.column("text")])
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(np.frombuffer(fp, dtype=">i8").astype(np.int64))], names=["id", "fp"])

    return docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, "id long, fp long")


def neighbours(radius: int) -> list[int]:
    """Offsets between tile numbers whose counts differ by at most `radius` in all, one of each pair of opposites, and 0."""
    steps = [s for s in itertools.product(range(-radius, radius + 1), repeat=PARTS) if sum(map(abs, s)) <= radius]
    return sorted({o for s in steps if (o := sum(x * (WIDTH + 1 + 2 * radius) ** i for i, x in enumerate(s))) >= 0})


def close_pairs(fps: DataFrame, *, radius: int = 2, tile: int = 4096) -> DataFrame:
    """Edges (a, b) that join all different fingerprints of `fps` (fp) at `radius` or fewer differing bits.

    A tile holds the fingerprints with equal population counts in each of four quarters; two fingerprints
    within the radius have counts that differ by at most the radius in all, so other pairs of tiles are
    skipped. Each fingerprint is sent to its own tile and to the following near ones, tiles are cut into squares of
    `tile` by 2 * `tile` fingerprints, and each square is compared whole by exclusive-or and bit counts. A square returns a
    spanning forest of its links, not the links, so a group of copies yields no more rows than it has members.
    """
    base = WIDTH + 1 + 2 * radius
    number = sum(((F.bit_count(F.shiftrightunsigned("fp", WIDTH * i).bitwiseAND(F.lit(0xFFFF))) + radius) * base**i for i in range(PARTS)), F.lit(0)).cast("int")
    f = fps.withColumn("own", number)
    # At most (16 + 1) ** 4 rows, whatever the input.
    tiles = f.groupBy("own").count().select(F.col("own").alias("cell"), F.ceil(F.col("count") / tile).cast("int").alias("rows"))
    offsets = F.array(*[F.lit(o) for o in neighbours(radius)])
    sent = f.withColumn("cell", F.explode(F.transform(offsets, lambda o: F.col("own") + o)))
    columns = sent.groupBy("cell").count().select("cell", F.ceil(F.col("count") / (2 * tile)).cast("int").alias("columns"))
    tiles = F.broadcast(tiles.join(columns, "cell"))
    part = F.xxhash64("fp")
    left = f.join(tiles, f["own"] == tiles["cell"]).select("fp", "cell", F.lit(True).alias("left"), F.pmod(part, "rows").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("columns") - 1)).alias("j"))
    right = sent.join(tiles, "cell").select("fp", "cell", F.lit(False).alias("left"), F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("i"), F.pmod(part, "columns").cast("int").alias("j"))

    def square(table: pa.Table) -> pa.Table:
        fp, is_left = table.column("fp").to_numpy(), table.column("left").to_numpy()
        all_fp = np.unique(fp)
        a, b = fp[is_left], fp[~is_left]
        pairs = []
        step = max(1, (1 << 21) // max(1, len(b)))
        for at in range(0, len(a), step):
            i, j = np.nonzero(np.bitwise_count(a[at : at + step, None].view(np.uint64) ^ b[None, :].view(np.uint64)) <= radius)
            x, y = a[at + i], b[j]
            pairs.append(np.stack([x, y])[:, x != y])
        x, y = np.concatenate(pairs, axis=1) if pairs else np.empty((2, 0), dtype=np.int64)
        root = forest(np.searchsorted(all_fp, x), np.searchsorted(all_fp, y), len(all_fp))
        k = np.nonzero(root != np.arange(len(root)))[0]
        return pa.table({"a": all_fp[k], "b": all_fp[root[k]]})

    return left.union(right).groupBy("cell", "i", "j").applyInArrow(square, "a long, b long")


def near_duplicates(docs: DataFrame, *, id: str = "doc_id", text: str = "text", k: int = 3, radius: int = 2) -> DataFrame:
    """Rows (id, fp, component_id): documents linked by fingerprints within `radius` bits, directly or in steps.

    Texts of fewer than k words have one shingle, their whole sequence; null and empty texts and texts of white space have fingerprint
    zero and link like others. Equal fingerprints are one node, so a group of copies of any size is one row of
    the comparison. Null ids never name a component unless all its ids are null. Empty tables give no rows.
    """
    fp = cut(fingerprints(docs, id=id, text=text, k=k))
    nodes = fp.groupBy("fp").agg(F.min("id").alias("least"))
    roots = components(close_pairs(nodes.select("fp"), radius=radius))
    nodes = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = nodes.join(nodes.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return fp.join(named, "fp").select(F.col("id").alias(id), "fp", "component_id")


#: Share of equal bits that the wide fingerprints of two texts at similarity 0.8 have at least (sets of 4 and 5 shingles; large sets 0.848).
AGREE = 0.835
#: 64-bit words of a wide fingerprint that are compared inside a bucket; the others are its bands.
HEAD = 3
#: Share of pairs at similarity 0.8 that meet in no band.
MISS = 5e-7


def band_plan(n: int) -> tuple[int, int]:
    """(bands, bits of a band) for n texts: buckets hold some 8,192 unrelated texts at most, and a pair that agrees in a share `AGREE` of all bits meets in none with probability `MISS`."""
    width = min(24, max(10, math.ceil(math.log2(max(n, 1))) - 13))
    return math.ceil(math.log(MISS) / math.log(1 - AGREE**width)), width


def most_bits(bits: int) -> int:
    """Bits in which fingerprints of that many bits may differ: five standard deviations beyond the mean at `AGREE`."""
    return math.floor(bits * (1 - AGREE) + 5 * math.sqrt(bits * AGREE * (1 - AGREE)))


@lru_cache(maxsize=4)
def further(words: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and offsets that make of one hash two further ones for each word."""
    a, b = np.random.default_rng(42).integers(0, 1 << 64, (2, 2 * words), dtype=np.uint64)
    return a | np.uint64(1), b


def wide_fingerprint(hashes: np.ndarray, words: int) -> np.ndarray:
    """SimHash of a set of 64-bit hashes: 64 * words majority bits as bytes.

    Each member votes on each bit by one and by three, from two bits of further hashes, for and against: with plain votes, ties of small sets
    would move more bits than the angle between the sets. No members give zero.
    """
    a, b = further(words)
    ones = np.zeros(128 * words, dtype=np.int64)
    for at in range(0, len(hashes), 255):  # sums of bytes that can't overflow
        x = mixed((hashes[at : at + 255, None] ^ b) * a)
        ones += np.unpackbits(x.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * (2 * ones[: 64 * words] + ones[64 * words :]) > 3 * len(hashes))


def bucket_links(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j) that connect all rows of w (words of fingerprints) within `most_bits` of each other.

    All are compared with the first row; what is not linked to it is compared with all, so a group of copies costs little.
    """
    most, first = most_bits(64 * w.shape[1]), most_bits(64)
    to_first = np.bitwise_count(w ^ w[0]).sum(axis=1, dtype=np.int64) <= most
    near = np.nonzero(to_first)[0][1:]
    rest = np.nonzero(~to_first)[0]
    links = [np.stack([np.zeros(len(near), dtype=np.int64), near])]
    order = np.concatenate([rest, near])  # a pair of two of the rest is compared once
    x, heads = w[order], np.ascontiguousarray(w[order, 0])
    at = 0
    while at < len(rest):
        step = max(1, (1 << 20) // (len(order) - at))
        end = min(at + step, len(rest))
        i, j = np.nonzero(np.bitwise_count(heads[at:end, None] ^ heads[None, at:]) <= first)
        i, j = i + at, j + at
        i, j = i[i < j], j[i < j]
        ok = np.bitwise_count(x[i] ^ x[j]).sum(axis=1, dtype=np.int64) <= most
        links.append(np.stack([order[i[ok]], order[j[ok]]]))
        at = end
    i, j = np.concatenate(links, axis=1)
    return i, j


#: Bands whose links are united before the others are searched.
FIRST = 6


def simhash_classes(nodes: DataFrame, n: int) -> DataFrame:
    """Rows (node, root) of the `nodes` (node, bands, w0, ...) joined, directly or in steps, by wide fingerprints that share a band and differ in few bits of their head.

    A bucket is a band's number and bits. Buckets of one band that begin alike are compared in one task, each bucket for itself, and give a spanning forest of
    their links, not the links. A group of near copies spans nearly the same forest in each band, so the first bands are united by themselves, and the others only give
    links between what is still apart: links grow with the members of a group, not with members times bands. Roots have no row themselves.
    """
    bands, width = band_plan(n)
    shift = width - min(width, max(0, math.ceil(math.log2(max(n, 1))) - 17))
    heads = [f"w{i}" for i in range(HEAD)]

    def compare(table: pa.Table) -> pa.Table:
        bucket, node = table.column("bucket").to_numpy(), table.column("node").to_numpy()
        order = np.lexsort((node, bucket))
        label = table.column("label").to_numpy()[order]
        w = np.stack([table.column(c).to_numpy().view(np.uint64) for c in heads], axis=1)[order]
        starts = np.nonzero(np.diff(bucket[order], prepend=-1))[0]
        a, b = [], []
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(order)]):
            if (label[s:e] == label[s]).all():
                continue
            i, j = bucket_links(w[s:e])
            names, at = np.unique(label[s:e], return_inverse=True)
            root = forest(at[i], at[j], len(names))
            k = np.nonzero(root != np.arange(len(names)))[0]
            a.append(names[k])
            b.append(names[root[k]])
        none = [np.empty(0, dtype=np.int64)]
        return pa.table({"a": np.concatenate(a or none), "b": np.concatenate(b or none)})

    def united(labelled: DataFrame, some) -> DataFrame:
        rows = labelled.select("node", "label", *heads, F.explode(some).alias("bucket")).withColumn("cell", F.shiftright("bucket", shift))
        return components(rows.groupBy("cell").applyInArrow(lambda t: lean(compare(t)), "a long, b long"))

    begun = united(nodes.withColumn("label", F.col("node")), F.slice("bands", 1, FIRST)).select("node", F.col("root").alias("label"))
    labelled = nodes.join(begun, "node", "left").withColumn("label", F.coalesce("label", "node"))
    more = united(labelled, F.slice("bands", FIRST + 1, bands))
    # Labels are roots of the first bands, or nodes without a link there, so none has a row in `begun`.
    into = more.select(F.col("node").alias("label"), "root")
    return begun.join(into, "label", "left").select("node", F.coalesce("root", "label").alias("root")).union(more.select("node", "root"))


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """For each text the different 64-bit hashes of its runs of k words, A-Z lower-cased, in rising order; of fewer words, of the whole sequence."""
    w = Words([(t or "").encode().lower() for t in texts], hashes=1)
    at, (x,) = w.windows(k)
    first = np.searchsorted(at, w.first)
    out = [np.unique(x[a:b]) for a, b in zip(first[:-1], first[1:])]
    for n in range(1, k):
        short = np.nonzero(w.counts == n)[0]
        if len(short):
            at, (x,) = w.windows(n)
            for i, h in zip(short, x[np.searchsorted(at, w.first[short])]):
                out[i] = np.array([h ^ np.uint64(n)])
    return out


def node_of(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes())


def with_nodes(docs: DataFrame, text: str, k: int, *, keep_text: bool = True) -> DataFrame:
    """`docs` with `node`, the hash of a text's different k-word shingles; without `keep_text` the text stays behind."""
    kept = [f for f in docs.schema.fields if keep_text or f.name != text]

    def number(batches):
        for batch in (part for b in batches for part in portions(b, text)):
            node = np.array([node_of(h) for h in shingle_sets(batch.column(text).to_pylist(), k)], dtype=np.uint64)
            yield batch.select([f.name for f in kept]).append_column("node", pa.array(node.view(np.int64)))

    return docs.mapInArrow(lambda b: lean_batches(number(b)), "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept) + "node long")


def similar_texts(docs: DataFrame, *, text: str = "text", k: int = 5, least: float = 0.8, tile: int = 512) -> DataFrame:
    """Rows (columns of `docs`, root): every row, repeated ones too, with the component of its text by `text_roots`."""
    roots = text_roots(docs, text=text, k=k, least=least, tile=tile)
    return with_nodes(docs, text, k).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).drop("node")


def first_of_similar(docs: DataFrame, *, id: str = "doc_id", text: str = "text", k: int = 5, least: float = 0.8, tile: int = 512) -> DataFrame:
    """Of each component of `text_roots` one row of `docs`: that of smallest id, null ids last, among equal ids that of the smallest digest.

    Ids and digests of whole rows choose, so texts cross one shuffle only. Rows that are equal in all columns are one row; an empty table gives none.
    """
    roots = text_roots(docs, text=text, k=k, least=least, tile=tile)
    # A digest of all columns, nulls told apart from texts.
    digest = F.md5(F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), F.md5(F.col(f"`{c}`").cast("string"))), F.lit("-")) for c in docs.columns]))
    rows = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("row"), digest.alias("digest"))
    keys = with_nodes(docs.select(F.col(text).alias("text"), F.col(id).alias("id"), digest.alias("digest")), "text", k, keep_text=False)
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "digest")).alias("first")
    chosen = keys.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(first).select(F.col("first.digest").alias("digest"))
    return rows.join(chosen, "digest").dropDuplicates(["digest"]).select("row.*")


def text_roots(docs: DataFrame, *, text: str = "text", k: int = 5, least: float = 0.8, tile: int = 512) -> DataFrame:
    """Rows (node, root) of the texts linked to others by a Jaccard similarity of `least` or more of their k-word shingles, directly or in steps.

    A node is one set of shingles (`with_nodes`); those that are linked to none, or are the root of the others, may have no row.

    Equal shingle sets are one node, so copies cost nothing more. Nodes are first joined to classes by SimHash (`simhash_classes`), with fingerprints wide enough for
    similarities of 0.8: there 64 bits differ in about 10, and a radius of 10 in 64 bits would compare all with all, while some hundred bits in bands find the pairs by equal bits. Inside a class each link is then confirmed by
    the exact similarity, where whole fingerprints differ in few enough bits. In each class all are compared with the smallest node, twice. What is still in different
    components is compared in squares of `tile` members, fingerprints first and then whole shingle sets, and a square returns one link per component that it joins: the members of a class's largest component with the others, and those with
    one another, in one group for all classes with the same largest component; so no pair of a class is left out and a group of copies costs little. A class whose many members are alike but not linked is still compared whole. The bands'
    recall holds for similarities of 0.8 or more. Null and empty texts and those of white space are one node.
    """
    n = docs.count()
    bands, width = band_plan(n)
    words = HEAD + math.ceil(bands * width / 64)

    def sign(batches):
        for batch in (part for b in batches for part in portions(b, text)):
            sets = shingle_sets(batch.column(text).to_pylist(), k)
            node = np.array([node_of(h) for h in sets], dtype=np.uint64).view(np.int64)
            fp = np.stack([wide_fingerprint(h, words) for h in sets])
            bits = np.unpackbits(fp[:, 8 * HEAD :], axis=1)[:, : bands * width].reshape(-1, bands, width)
            bucket = bits @ (1 << np.arange(width)[::-1]) + (np.arange(bands) << width)
            heads = np.ascontiguousarray(fp[:, : 8 * HEAD]).view(np.int64)
            columns = [pa.array(node), pa.array([len(h) for h in sets], pa.int32()), pa.array(bucket.tolist(), pa.list_(pa.int64())), *[pa.array(heads[:, i]) for i in range(HEAD)], pa.array([x.tobytes() for x in fp], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "size", "bands", *[f"w{i}" for i in range(HEAD)], "signature"])

    def confirm(batches):
        for batch in (part for b in batches for part in portions(b, "x")):
            x, y = (shingle_sets(batch.column(c).to_pylist(), k) for c in ("x", "y"))
            ok = []
            for p, q in zip(x, y):
                both = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(both >= least * (len(p) + len(q) - both))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    def matrix(column) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint64).reshape(-1, words)

    most = most_bits(64 * words)

    def screen(batches):
        for batch in batches:
            near = np.bitwise_count(matrix(batch.column("a_signature")) ^ matrix(batch.column("b_signature"))).sum(axis=1, dtype=np.int64) <= most
            yield batch.select(["a", "b"]).filter(pa.array(near))

    def hashes(batches):
        for batch in (part for b in batches for part in portions(b, "t")):
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([h.tobytes() for h in shingle_sets(batch.column("t").to_pylist(), k)], pa.binary())], names=["node", "hashes"])

    def square(table: pa.Table) -> pa.Table:
        """Links that join different roots: each left node with all right ones, exactly where the signatures let it; one link per root."""
        node, size, root, left = (table.column(c).to_numpy() for c in ("node", "size", "root", "left"))
        m, column, out = matrix(table.column("signature")), table.column("hashes").combine_chunks(), []
        root = np.unique(root, return_inverse=True)[1]
        q = np.nonzero(~left)[0]
        for i in np.nonzero(left)[0]:
            j = q[(root[q] != root[i]) & (np.minimum(size[q], size[i]) >= least * np.maximum(size[q], size[i]))]
            j = j[np.bitwise_count(m[j] ^ m[i]).sum(axis=1, dtype=np.int64) <= most]
            own = np.frombuffer(column[int(i)].as_py(), dtype=np.uint64)
            if not len(j) or not len(own):
                continue
            others = np.frombuffer(b"".join(column.take(pa.array(j)).to_pylist()), dtype=np.uint64)
            hit = own[np.minimum(np.searchsorted(own, others), len(own) - 1)] == others
            both = np.add.reduceat(hit.astype(np.int64), np.cumsum(size[j]) - size[j])
            j = j[both >= least * (size[i] + size[j] - both)]
            for x in j[np.unique(root[j], return_index=True)[1]]:
                out.append((min(node[i], node[x]), max(node[i], node[x])))
                root[root == root[x]] = root[i]
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    heads = ", ".join(f"w{i} long" for i in range(HEAD))
    nodes = stored(docs.select(text).mapInArrow(lambda b: lean_batches(sign(b)), f"node long, size int, bands array<long>, {heads}, signature binary").dropDuplicates(["node"]))
    signatures = nodes.select("node", "signature")
    classes = simhash_classes(nodes, n).select("node", F.col("root").alias("bucket"))
    classes = classes.union(classes.select("bucket", "bucket").distinct())
    members = stored(nodes.select("node", "size").join(classes, "node").withColumn("root", F.col("node")))
    wanted = members.select("node").distinct()
    texts = stored(with_nodes(docs.select(text), text, k).join(wanted, "node").groupBy("node").agg(F.min(text).alias("t")))

    def confirmed(near):
        near = near.distinct()
        near = near.join(texts.select(F.col("node").alias("a"), F.col("t").alias("x")), "a").join(texts.select(F.col("node").alias("b"), F.col("t").alias("y")), "b")
        return stored(near.select("a", "b", "x", "y").mapInArrow(lambda b: lean_batches(confirm(b)), "a long, b long"))

    edges = None
    for last in (False, True):
        pivots = members.groupBy("bucket").agg(F.min(F.struct("node", "size", "root")).alias("m")).select("bucket", *[F.col(f"m.{c}").alias(f"a_{c}") for c in ("node", "size", "root")])
        pairs = members.join(pivots, "bucket").where((F.least("size", "a_size") >= least * F.greatest("size", "a_size")) & F.expr("node <> a_node and root <> a_root"))
        pairs = pairs.select(F.least("node", "a_node").alias("a"), F.greatest("node", "a_node").alias("b")).distinct()
        for side in ("a", "b"):
            pairs = pairs.join(signatures.select(F.col("node").alias(side), F.col("signature").alias(f"{side}_signature")), side)
        found = confirmed(pairs.select("a", "b", "a_signature", "b_signature").mapInArrow(lambda b: lean_batches(screen(b)), "a long, b long"))
        edges = found if edges is None else edges.union(found)
        # Nodes of one root are connected. After the first pass the least pivot that a node is linked to will do.
        roots = components(edges) if last else found.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))
        rest = members.drop("root").join(pivots.select("bucket", "a_node"), "bucket").where("node <> a_node").drop("a_node")
        rest = rest.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        open_ = rest.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("bucket")
        members = stored(rest.join(open_, "bucket"))

    # Buckets with the same largest component are compared as one group, so that a node goes there once.
    per = members.groupBy("bucket", "root").count().groupBy("bucket").agg(F.max(F.struct("count", "root")).alias("m")).select("bucket", F.col("m.root").alias("main"))
    groups = stored(members.join(per, "bucket").select("main", "node", "size", "root").distinct())
    parts = groups.groupBy("main").agg(F.ceil(F.sum((F.col("root") != F.col("main")).cast("int")) / tile).cast("int").alias("lefts"), F.ceil(F.count("*") / tile).cast("int").alias("rights")).where("lefts > 0")
    sets = texts.join(groups.select("node").distinct(), "node").mapInArrow(lambda b: lean_batches(hashes(b)), "node long, hashes binary")
    m = groups.join(parts, "main").join(signatures, "node").join(sets, "node").withColumn("part", F.xxhash64("node"))
    columns = ["main", "node", "size", "root", "signature", "hashes"]
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = m.where("root <> main").select(*columns, F.lit(True).alias("left"), F.pmod("part", "lefts").cast("int").alias("i"), every("rights").alias("j"))
    right = m.select(*columns, F.lit(False).alias("left"), every("lefts").alias("i"), F.pmod("part", "rights").cast("int").alias("j"))
    more = left.union(right).groupBy("main", "i", "j").applyInArrow(lambda t: lean(square(t)), "a long, b long").distinct()
    for side in ("a", "b"):  # links between components
        more = more.join(roots.select(F.col("node").alias(side), F.col("root").alias(f"{side}_root")), side, "left").withColumn(side, F.coalesce(f"{side}_root", side)).drop(f"{side}_root")
    merged = components(more).select(F.col("node").alias("of"), F.col("root").alias("into"))
    # Roots that are joined to others have no row among `roots` themselves.
    linked = roots.select("node", F.col("root").alias("of")).union(merged.select("of", "of"))
    return linked.join(merged, "of", "left").select("node", F.coalesce("into", "of").alias("root"))


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    n = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return n.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
