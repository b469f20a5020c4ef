"""Toxicity: class-conditional Kneser-Ney models with shared backoff counts."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASES, block_of, blocks_for, cut, deal, mixed, squeeze, undeal, unsqueeze

TOKEN = re.compile(r"\w+")

#: Constants of the model, chosen by five-fold cross-validation inside the rows that may be learned from; see `log_ratio`.
STEM, SIGMAS, SHARE, FLOOR = 5, 2.0, 0.5, 0.05
#: Of the labelled texts, each `CALIBRATE`-th by the hash of its id gives no counts and serves to turn values into probabilities.
CALIBRATE = 5


class Tokens:
    """The lower-cased words of a block of texts as numbers, and its different words in the order of their stems."""

    def __init__(self, texts):
        lists = [TOKEN.findall((t or "").lower()) for t in texts]
        self.counts = np.array([len(x) for x in lists], dtype=np.int64)
        self.doc = np.repeat(np.arange(len(lists)), self.counts)
        code, distinct = pd.factorize(np.array([w for ws in lists for w in ws], dtype=object)) if self.counts.sum() else (np.empty(0, dtype=np.int64), [])
        stem = np.array([xxhash.xxh64_intdigest(w[:STEM].encode(), 1) for w in distinct], dtype=np.uint64)
        word = np.array([xxhash.xxh64_intdigest(w.encode()) for w in distinct], dtype=np.uint64)
        order = np.lexsort((word, stem))
        #: Number of each token's word in the order of (stem, word), and the hashes in that order.
        self.word = np.argsort(order)[code] if len(order) else code
        self.stems, self.words = stem[order], word[order]


def soften(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """`seen` less its absolute discount, towards what is expected and never beyond it, but at least `FLOOR` of that."""
    d = SIGMAS * np.sqrt(expected + 1) + SHARE * expected
    moved = np.where(seen - d > expected, seen - d, np.where(seen + d < expected, seen + d, expected))
    return np.maximum(moved, FLOOR * expected)


def log_ratio(stems: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray, all_toxic: int, all_ordinary: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(different stems, their log-ratio, log-ratio of each word) from the continuation counts of words in either class.

    Both classes back off to the counts that they share: a stem is expected in a class as often as its shared count times the
    share of the class, and a word as often as the shared share of the word in its stem says. A class's count is discounted
    towards that by `SIGMAS` chance deviations and `SHARE` of the expectation, and only what
    stands out beyond is the class's own, so that a word which neither class has
    more often than chance explains has the ratio of its stem, and one of a rare stem none.
    """
    names, at = np.unique(stems, return_inverse=True)
    seen = np.stack([np.bincount(at, weights=toxic, minlength=len(names)), np.bincount(at, weights=ordinary, minlength=len(names))])
    both, share = seen.sum(axis=0), np.array([[all_toxic], [all_ordinary]]) / max(all_toxic + all_ordinary, 1)
    expected = both * share
    own = soften(seen, expected)
    of_stem = np.log(own[0] / expected[0]) - np.log(own[1] / expected[1])
    each = toxic + ordinary
    expected = own[:, at] * (each / own.sum(axis=0)[at])
    kept = soften(np.stack([toxic, ordinary]).astype(float), expected)
    return names, of_stem, of_stem[at] + np.log(kept[0] / expected[0]) - np.log(kept[1] / expected[1])


def toxicity(docs: DataFrame, labels: DataFrame, *, id: str = "doc_id", text: str = "text", least: float = 0.7, per_block: int = 8 << 20) -> DataFrame:
    """Rows (id, value, score, predicted): how likely each whole text is toxic, from the texts that `labels` (id, toxic) marks.

    Two Kneser-Ney models whose histories are the class and a word's stem, its first `STEM` letters: a word counts once for
    each different pair of words around it in the texts of a class (its continuation count, exact up to chance agreement of 32 bits of hash), so a passage
    copied from text to text is no evidence of its words; rare words take the ratio of their stem, rare stems
    that of the counts which both classes share (`log_ratio`). `value` is the mean over all words of a text
    of the log-likelihood under the toxic model less that under the ordinary one. A rising step curve, fitted to the values of
    labelled texts that gave no counts, makes it a probability.

    Documents are dealt once to blocks of about `per_block` bytes. A block tells, in one message per shard of stems, the words and
    their surroundings in its labelled texts; a shard keeps the counts of its stems; a block then asks the shards for all its words and
    scores its texts with the answers, which hold only what weighs something. A stem's words lie in one shard; they
    are different words, not occurrences.

    Null and empty texts have value 0; ids with contradicting labels count as toxic; labels without an id or a mark are not read; repeated rows
    are scored alike; rows with a null id are dealt by their text and never labelled; without labels of both classes the curve has two
    fixed steps; an empty table gives no rows. Other columns are not read.
    """
    _, n = blocks_for(docs, text, per_block)
    shards = max(1, n // 4)
    d = deal(docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")), n)
    marks = labels.select(F.col(id).cast("long").alias("train"), "toxic").where("train is not null and toxic is not null").groupBy("train").agg(F.max("toxic").alias("toxic"))
    held = F.pmod(F.crc32(F.concat(F.lit("calibrate "), F.col("train").cast("string"))), F.lit(CALIBRATE)) == 0
    learn = marks.where(~held).withColumn("block", block_of("train", n))
    told_schema = pa.schema({"shard": pa.int32(), "stems": pa.binary(), "words": pa.binary(), "kinds": pa.binary(), "befores": pa.binary()})

    def by_shard(stems: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(shard, positions) of the words of each shard, in their order."""
        shard = ((stems >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        first = np.searchsorted(shard[order], np.arange(shards + 1))
        return [(k, order[first[k] : first[k + 1]]) for k in range(shards) if first[k] < first[k + 1]]

    def tell(table: pa.Table, trained: pa.Table) -> pa.Table:
        if not table.num_rows or not trained.num_rows:
            return told_schema.empty_table()
        table = undeal(table)
        cls = pd.Series(trained.column("toxic").to_numpy(), index=trained.column("train").to_numpy(), dtype="float64").reindex(table.column("id").to_pylist()).to_numpy()
        labelled = ~np.isnan(cls)
        t = Tokens(table.column("text").filter(pa.array(labelled)).to_pylist())
        m = len(t.words)
        if not m:
            return told_schema.empty_table()
        # 32 bits of the words before and after, with nothing beyond the ends of a text.
        own, edge = t.words[t.word], np.diff(t.doc, prepend=-1, append=-1) != 0
        left, right = np.where(edge[:-1], np.uint64(0), np.roll(own, 1)), np.where(edge[1:], np.uint64(0), np.roll(own, -1))
        before = (mixed(left * np.uint64(BASES[0]) + right) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        toxic = cls[labelled][t.doc] == 1
        pairs = np.unique((t.word << 33) | (toxic.astype(np.int64) << 32) | before)
        first = np.searchsorted(pairs >> 33, np.arange(m + 1))
        toxics = np.bincount(pairs >> 33, weights=pairs >> 32 & 1, minlength=m).astype(np.int64)
        rows = []
        for k, at in by_shard(t.stems):
            counts = first[at + 1] - first[at]
            run = np.repeat(first[at] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
            rows.append((k, squeeze(t.stems[at]), squeeze(t.words[at]), squeeze(np.stack([counts, toxics[at]])), (pairs[run] & 0xFFFFFFFF).astype(np.uint32).tobytes()))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), told_schema)], schema=told_schema)

    def tally(table: pa.Table) -> pa.Table:
        parts = []
        for kinds, befores in zip(table.column("kinds"), table.column("befores")):
            counts, toxics = unsqueeze(kinds, np.int64).reshape(2, -1)
            # Of a word the ordinary predecessors come first.
            side = np.arange(counts.sum()) >= np.repeat(np.cumsum(counts) - toxics, counts)
            parts.append((counts, side, np.frombuffer(befores.as_py(), dtype=np.uint32)))
        counts, side, before = (np.concatenate(c) for c in zip(*parts))
        stem, word = (np.concatenate([unsqueeze(x, np.uint64) for x in table.column(c)]) for c in ("stems", "words"))
        order = np.lexsort((word, stem))
        stem, word = stem[order], word[order]
        new = np.ones(len(word), dtype=bool)
        new[1:] = (stem[1:] != stem[:-1]) | (word[1:] != word[:-1])
        at = np.empty(len(word), dtype=np.int64)
        at[order] = np.cumsum(new) - 1
        stem, word, at = stem[new], word[new], np.repeat(at, counts)
        pairs = np.unique((at << 33) | (side.astype(np.int64) << 32) | before)
        toxic = np.bincount(pairs >> 33, weights=pairs >> 32 & 1, minlength=len(word)).astype(np.int64)
        every = np.bincount(pairs >> 33, minlength=len(word))
        return pa.table({"shard": [table.column("shard")[0].as_py()], "stems": [squeeze(stem)], "words": [squeeze(word)], "counts": [squeeze(np.stack([toxic, every - toxic]))], "toxic": [int(toxic.sum())], "ordinary": [int((every - toxic).sum())]}).cast(tally_schema)

    tally_schema = pa.schema({"shard": pa.int32(), "stems": pa.binary(), "words": pa.binary(), "counts": pa.binary(), "toxic": pa.int64(), "ordinary": pa.int64()})

    def ask(table: pa.Table) -> pa.Table:
        t, rows = Tokens(undeal(table).column("text").to_pylist()), []
        for k, at in by_shard(t.stems):
            stems, sizes = np.unique(t.stems[at], return_counts=True)
            rows.append((table.column("block")[0].as_py(), k, squeeze(stems), squeeze(sizes), t.words[at].view(np.uint8).reshape(-1, 8)[:, :6].tobytes()))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), ask_schema)], schema=ask_schema) if rows else ask_schema.empty_table()

    ask_schema = pa.schema({"block": pa.int32(), "shard": pa.int32(), "stems": pa.binary(), "sizes": pa.binary(), "words": pa.binary()})

    def answer(key, asks: pa.Table, known: pa.Table) -> pa.Table:
        out = {"block": [], "shard": [], "at": [], "llr": []}
        if asks.num_rows and known.num_rows:
            stem, word = (unsqueeze(known.column(c)[0], np.uint64) for c in ("stems", "words"))
            toxic, ordinary = unsqueeze(known.column("counts")[0], np.int64).reshape(2, -1)
            all_toxic, all_ordinary = (known.column(c)[0].as_py() for c in ("all_toxic", "all_ordinary"))
            names, of_stem, of_word = log_ratio(stem, toxic, ordinary, all_toxic, all_ordinary)
            stands = pd.Series(of_stem[of_stem != 0], index=names[of_stem != 0], dtype="float64")
            # Words are told apart by 48 bits inside their stem.
            pick = (of_word != 0) | np.isin(stem, stands.index.to_numpy())
            own = pd.Series(of_word[pick], index=pd.MultiIndex.from_arrays([stem[pick], word[pick] & np.uint64((1 << 48) - 1)]), dtype="float64")
            heavy = np.unique(stem[pick])
            for block, stems, sizes, words in zip(*(asks.column(c) for c in ("block", "stems", "sizes", "words"))):
                s = np.repeat(unsqueeze(stems, np.uint64), unsqueeze(sizes, np.int64))
                k = np.nonzero(np.isin(s, heavy))[0]
                if not len(k):
                    continue
                w = np.zeros((len(s), 8), dtype=np.uint8)
                w[:, :6] = np.frombuffer(words.as_py(), dtype=np.uint8).reshape(-1, 6)
                w = w.view(np.uint64).reshape(-1)
                llr = own.reindex(pd.MultiIndex.from_arrays([s[k], w[k]])).to_numpy()
                llr = np.where(np.isnan(llr), np.nan_to_num(stands.reindex(s[k]).to_numpy()), llr)
                k, llr = k[llr != 0], llr[llr != 0]
                for name, v in zip(out, (block.as_py(), key[0].as_py(), k.astype(np.uint32).tobytes(), llr.tobytes())):
                    out[name].append(v)
        return pa.table(out, schema=pa.schema({"block": pa.int32(), "shard": pa.int32(), "at": pa.binary(), "llr": pa.binary()}))

    def score(table: pa.Table, answers: pa.Table) -> pa.Table:
        table = undeal(table)
        t = Tokens(table.column("text").to_pylist())
        llr, places = np.zeros(len(t.words)), dict(by_shard(t.stems))
        for shard, at, x in zip(*(answers.column(c) for c in ("shard", "at", "llr"))):
            llr[places[shard.as_py()][np.frombuffer(at.as_py(), dtype=np.uint32)]] = np.frombuffer(x.as_py(), dtype=np.float64)
        value = np.bincount(t.doc, weights=llr[t.word], minlength=len(t.counts)) / np.maximum(t.counts, 1)
        return pa.table({"id": table.column("id"), "value": np.round(value, 9)})

    told = d.groupBy("block").cogroup(learn.groupBy("block")).applyInArrow(tell, "shard int, stems binary, words binary, kinds binary, befores binary")
    known = told.groupBy("shard").applyInArrow(tally, "shard int, stems binary, words binary, counts binary, toxic long, ordinary long")
    total = known.agg(F.coalesce(F.sum("toxic"), F.lit(0)).alias("all_toxic"), F.coalesce(F.sum("ordinary"), F.lit(0)).alias("all_ordinary"))  # one row
    known = known.join(F.broadcast(total.where("all_toxic > 0 and all_ordinary > 0")))
    asks = d.groupBy("block").applyInArrow(ask, "block int, shard int, stems binary, sizes binary, words binary")
    answers = asks.groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(answer, "block int, shard int, at binary, llr binary")
    values = cut(d.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, "id long, value double"))
    # Bins of the value that are finer near nought, where long texts lie: some 2,000 at most.
    step = F.round(F.asinh(F.col("value") * 1000), 2)
    pairs = values.join(marks.where(held).select(F.col("train").alias("id"), "toxic"), "id").groupBy(step.alias("v"), (F.col("toxic") == 1).alias("y")).count()
    steps = isotonic([(r["v"], r["y"], r["count"]) for r in pairs.collect()])
    edges, levels = F.array(*[F.lit(e) for e, _ in steps]), F.array(*[F.lit(p) for _, p in steps])
    level = F.element_at(levels, F.greatest(F.lit(1), F.size(F.filter(edges, lambda e: e <= step))))
    s = F.lit(0.995) * level + F.lit(0.005) / (1 + F.exp(-F.col("value")))
    return values.select(F.col("id").alias(id), "value", s.alias("score"), (s >= least).cast("int").alias("predicted"))


def isotonic(histogram: list[tuple[float, bool, int]]) -> list[tuple[float, float]]:
    """(lowest value, probability) of the steps of the rising curve that fits P(toxic | value) best, by pooling neighbours that fall."""
    seen: dict[float, list[float]] = {}
    for v, y, n in histogram:
        seen.setdefault(v, [0.0, 0.0])[0 if y else 1] += n
    if not seen or not any(t for t, _ in seen.values()) or not any(o for _, o in seen.values()):
        return [(-1e9, 0.1), (1.0, 0.9)]
    steps: list[list[float]] = []
    for v in sorted(seen):
        steps.append([v, *seen[v]])
        while len(steps) > 1 and steps[-2][1] * (steps[-1][1] + steps[-1][2]) >= steps[-1][1] * (steps[-2][1] + steps[-2][2]):
            _, t, o = steps.pop()
            steps[-1][1] += t
            steps[-1][2] += o
    return [(v, (t + 0.5) / (t + o + 1)) for v, t, o in steps]


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~out)
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels).select("doc_id", out.alias("held_out"), "score", "predicted")
