"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import block_of, blocks_for, cut, deal, lean, squeeze_bytes, undeal, unsqueeze_bytes

#: Symbols of the model beside the characters of a text: before its start, after its end, and for a word that repeats the one before.
START, END, AGAIN = "\ue000", "\ue001", "\ue002"
#: Symbols are of the private use area; where a text holds one of these three itself, it is read as the replacement character.
FOREIGN = str.maketrans(dict.fromkeys((START, END, AGAIN), "\ufffd"))


class Grams:
    """The character n-grams of a block of texts, each ending at one character or at the end of a text."""

    def __init__(self, texts, order: int):
        lines = []
        for t in texts:
            t = t or ""
            words = (t.translate(FOREIGN) if START in t or END in t or AGAIN in t else t).split()
            marked = [" " + w if w != before else AGAIN for w, before in zip(words, ["", *words])]
            lines.append(START * (order - 1) + "".join(marked) + END)
        self.text = "".join(lines)
        lengths = np.array([len(x) for x in lines])
        symbols, alphabet = pd.factorize(np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), dtype="<u4"))
        symbols = symbols.astype(np.int32)
        #: How many symbols each text has, of which text each is, and where the n-gram of each starts. 32 bits do for a block.
        self.counts = lengths - order + 1
        self.doc = np.repeat(np.arange(len(lines), dtype=np.int32), self.counts)
        start = np.arange(len(self.doc), dtype=np.int32)
        start += self.doc * np.int32(order - 1)
        code = np.zeros(len(start), dtype=np.int64)
        seen = 1
        for k in range(order):
            if seen * len(alphabet) >= 2**62:
                code, kinds = pd.factorize(code)
                seen = len(kinds)
            code *= len(alphabet)
            code += symbols[start + np.int32(k)]
            seen *= len(alphabet)
        del symbols
        gram, distinct = pd.factorize(code)
        del code
        self.gram = gram.astype(np.int32)
        first = np.zeros(len(distinct), dtype=np.int64)
        first[gram[::-1]] = start[::-1]
        self.distinct = [self.text[i : i + order] for i in first.tolist()]


def kneser_ney(counts: DataFrame, order: int) -> DataFrame:
    """Rows (gram, logp): log-probability of the last character of each n-gram given the others.

    `counts` has (gram, c), every n-gram that is asked for once, with c = 0 where it was never seen in
    training. Orders below the highest count the different characters seen before a gram (continuation counts). Each order has
    three discounts, from how many of its grams have counts 1 to 4; each probability is interpolated with the
    one of the gram without its first character, down to a uniform one.
    """
    level = {order: counts}
    for k in range(order - 1, 0, -1):
        level[k] = level[k + 1].groupBy(F.substring("gram", 2, k).alias("gram")).agg(F.sum((F.col("c") > 0).cast("long")).alias("c"))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    probability = None
    for k in range(1, order + 1):
        # One row; joined by an equality on the order, so that it is broadcast by Spark's own size check.
        seen = level[k].agg(*[F.coalesce(F.sum((F.col("c") == i).cast("double")), F.lit(0.0)).alias(f"n{i}") for i in range(1, 5)], F.sum((F.col("c") > 0).cast("double")).alias("kinds"))
        y = F.when(F.col("n1") > 0, F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(0.5)
        of = [F.least(F.greatest(F.lit(i) - (i + 1) * y * ratio(f"n{i + 1}", f"n{i}"), F.lit(0.1)), F.lit(float(i))) for i in (1, 2, 3)]
        seen = seen.select(F.lit(k).alias("k"), "kinds", *[d.alias(f"d{i}") for i, d in enumerate(of, 1)])
        t = level[k].withColumn("k", F.lit(k)).join(F.broadcast(seen), "k")
        discount = F.when(F.col("c") == 0, 0.0).when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        context = Window.partitionBy("context")
        t = t.withColumn("context", F.substring("gram", 1, k - 1)).withColumn("d", discount)
        t = t.withColumn("all", F.sum("c").over(context)).withColumn("freed", F.sum("d").over(context))
        if k == 1:
            t = t.withColumn("lower", 1 / (F.coalesce("kinds", F.lit(0.0)) + 1))
        else:
            t = t.withColumn("suffix", F.substring("gram", 2, k - 1)).join(probability.select(F.col("gram").alias("suffix"), F.col("p").alias("lower")), "suffix")
        probability = t.select("gram", F.when(F.col("all") > 0, (F.col("c") - F.col("d") + F.col("freed") * F.col("lower")) / F.col("all")).otherwise(F.col("lower")).alias("p"))
    return probability.select("gram", F.log("p").alias("logp"))


def by_shard(grams: list[str], shards: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, first): the positions of grams in shards, each in the order of the grams themselves, and where each shard starts.

    The rows of a block reach each pass in whatever order the shuffle delivers them, so their order must not count.
    """
    order = np.array(sorted(range(len(grams)), key=grams.__getitem__), dtype=np.int64)
    shard = np.array([zlib.crc32(grams[i].encode()) % shards for i in order.tolist()], dtype=np.int64)
    return order[np.argsort(shard, kind="stable")], np.concatenate([[0], np.cumsum(np.bincount(shard, minlength=shards))])


def perplexities(docs: DataFrame, train: DataFrame, *, id: str, text: str, keep: list[str], order: int, per_block: int) -> DataFrame:
    """`docs` columns (id, *keep) with nll, the mean negative log-probability of a symbol under the model of the texts in `train` (id).

    Documents are dealt once to blocks of about `per_block` bytes. A block asks for its different n-grams, with
    how often its training texts hold them, in one compressed message per shard of n-grams; the messages of a shard
    are summed into its counts, and answered, in the order of the grams, with the probabilities made of all counts; a block then scores
    its texts with its own answers. So the model is sharded by n-gram and nothing of it is held whole anywhere.
    """
    _, n = blocks_for(docs, text, per_block)
    shards = max(1, n // 4)
    d = deal(docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"), *[F.col(c).alias(f"keep_{c}") for c in keep]), n)
    train = train.select(F.col(id).cast("long").alias("train")).distinct().withColumn("block", block_of("train", n))
    asked = pa.schema({"block": pa.int32(), "shard": pa.int32(), "grams": pa.binary(), "counts": pa.binary()})

    def ask(key, table: pa.Table, trained: pa.Table) -> pa.Table:
        if not table.num_rows:
            return asked.empty_table()
        table = undeal(table)
        g = Grams(table.column("text").to_pylist(), order)
        ids = table.column("id")
        chosen = np.isin(ids.fill_null(0).to_numpy(), trained.column("train").to_numpy()) & np.asarray(ids.is_valid())
        c = np.bincount(g.gram[chosen[g.doc]], minlength=len(g.distinct)).astype(np.int64)
        at, first = by_shard(g.distinct, shards)
        out = {name: [] for name in asked.names}
        for k in range(shards):
            own = at[first[k] : first[k + 1]]
            if len(own):
                grams = squeeze_bytes("".join([g.distinct[i] for i in own]).encode())
                for name, v in zip(out, (key[0].as_py(), k, grams, squeeze_bytes(c[own].tobytes()))):
                    out[name].append(v)
        return pa.table(out, schema=asked)

    def grams_of(message) -> list[str]:
        line = unsqueeze_bytes(message.as_py()).decode()
        return [line[i : i + order] for i in range(0, len(line), order)]

    def count(table: pa.Table) -> pa.Table:
        total: dict[str, int] = {}
        for grams, counts in zip(table.column("grams"), table.column("counts")):
            for g, c in zip(grams_of(grams), np.frombuffer(unsqueeze_bytes(counts.as_py()), dtype=np.int64).tolist()):
                total[g] = total.get(g, 0) + c
        return pa.table({"gram": pa.array(list(total), pa.string()), "c": pa.array(list(total.values()), pa.int64())})

    def answer(table: pa.Table, model: pa.Table) -> pa.Table:
        logp = dict(zip(model.column("gram").to_pylist(), model.column("logp").to_pylist()))
        out = [np.array([logp[g] for g in grams_of(grams)], dtype=np.float32).tobytes() for grams in table.column("grams")]
        return table.select(["block", "shard"]).append_column("logp", pa.array(out, pa.binary()))

    def score(table: pa.Table, answers: pa.Table) -> pa.Table:
        table = undeal(table)
        g = Grams(table.column("text").to_pylist(), order)
        at, _ = by_shard(g.distinct, shards)
        replies = [answers.column("logp")[int(k)].as_py() for k in np.argsort(answers.column("shard").to_numpy())]
        logp = np.empty(len(at))
        logp[at] = np.frombuffer(b"".join(replies), dtype=np.float32)
        nll = -np.bincount(g.doc, weights=logp[g.gram], minlength=table.num_rows) / np.maximum(g.counts, 1)
        return pa.table({"id": table.column("id"), **{f"keep_{c}": table.column(f"keep_{c}") for c in keep}, "n": pa.array(g.counts, pa.int64()), "nll": pa.array(nll, pa.float64())})

    asks = d.groupBy("block").cogroup(train.groupBy("block")).applyInArrow(lambda k, t, a: lean(ask(k, t, a)), "block int, shard int, grams binary, counts binary").repartition("shard")
    model = kneser_ney(cut(asks.groupBy("shard").applyInArrow(lambda t: lean(count(t)), "gram string, c long")), order)
    model = model.withColumn("shard", F.pmod(F.crc32(F.col("gram").cast("binary")), F.lit(shards)).cast("int"))
    answers = asks.groupBy("shard").cogroup(model.groupBy("shard")).applyInArrow(lambda t, m: lean(answer(t, m)), "block int, shard int, logp binary")
    fields = ", ".join(["id long", *[f"`keep_{c}` {docs.schema[c].dataType.simpleString()}" for c in keep], "n long", "nll double"])
    return d.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lambda t, a: lean(score(t, a)), fields)


def classify(
    docs: DataFrame, labels: DataFrame, *, id: str = "doc_id", text: str = "text", lang: str = "lang", order: int = 4,
    carry: tuple[str, ...] = (), held: int = 5, middle: float = 0.5, high: float = 0.9, reach: float = 8.0, least: int = 5, per_block: int = 4 << 20,
) -> DataFrame:
    """Rows (id, lang, *carry, n, perplexity, limit, kept): the perplexity of each whole text and whether it is within the limit of its language.

    The model is a character model of `order` trained on all texts that `labels` (id, quality) calls trusted (no row
    with quality other than 1), but for each `held`-th by the hash of its id. A word that repeats the one before
    is one symbol, so repetition is unusual rather than easy. The limit of a language comes from quantiles of its held-out
    trusted texts: the `middle` one plus `reach` times the way to the `high` one, in log-perplexity, which lies beyond
    nearly all of them. Languages with fewer than `least` such texts, the null language included, take the limit of all languages.
    Without any trusted text everything is kept. Short texts spread more, so the way is divided by the square
    root of a text's share of a typical length when it is shorter than that.

    Null and empty texts are one end symbol and are judged like others; repeated rows are scored alike; an
    empty table gives none; rows with a null id are judged but never trusted. Columns of `docs` other than these three and `carry` are not read.
    """
    ids = F.col(id).cast("long")
    trusted = labels.select(ids.alias(id), "quality").where(F.col(id).isNotNull()).groupBy(id).agg(F.min("quality").alias("a"), F.max("quality").alias("b")).where("a = 1 and b = 1").select(id)
    test = F.pmod(F.crc32(F.col(id).cast("string")), F.lit(held)) == 0
    scored = cut(perplexities(docs, trusted.where(~test), id=id, text=text, keep=[lang, *carry], order=order, per_block=per_block))
    sample = scored.join(trusted.where(test).select(F.col(id).alias("id")), "id").select(F.col(f"keep_{lang}").alias("lang"), F.round("nll", 3).alias("v"))
    limits = quantiles(sample, (middle, high))
    limits = limits.groupBy("lang").agg(F.max("total").alias("total"), *[F.max(F.when(F.col("q") == q, F.col("v"))).alias(c) for q, c in ((middle, "mid"), (high, "up"))]).where((F.col("total") >= least) | F.col("lang").isNull())
    own = limits.where("lang is not null").select(F.col("lang").alias("l"), F.struct("mid", "up").alias("own"))
    every = limits.where("lang is null").select(F.lit(1).alias("one"), F.struct("mid", "up").alias("every"))
    s = scored.withColumn("one", F.lit(1)).join(F.broadcast(every), "one", "left").join(own, F.col(f"keep_{lang}") == F.col("l"), "left")
    pick = F.coalesce("own", "every")
    short = F.greatest(F.lit(1.0), F.sqrt(F.lit(1000.0) / F.col("n")))
    limit = pick["mid"] + F.lit(reach) * (pick["up"] - pick["mid"]) * short
    return s.select(F.col("id").alias(id), F.col(f"keep_{lang}").alias(lang), *[F.col(f"keep_{c}").alias(c) for c in carry], "n", F.exp("nll").alias("perplexity"), F.exp(limit).alias("limit"), (limit.isNull() | (F.col("nll") <= limit)).alias("kept"))


def quantiles(sample: DataFrame, at: tuple[float, ...]) -> DataFrame:
    """Rows (lang, q, v, total) for each language, and for all as the null one, from a histogram of the rounded values `v`."""
    h = sample.where("lang is not null").groupBy("lang", "v").count().union(sample.groupBy(F.lit(None).cast("string"), "v").count())
    w = Window.partitionBy("lang")
    h = h.withColumn("upto", F.sum("count").over(w.orderBy("v"))).withColumn("total", F.sum("count").over(w))
    q = h.withColumn("q", F.explode(F.array(*[F.lit(x) for x in at]))).where(F.col("upto") >= F.col("q") * F.col("total"))
    return q.groupBy("lang", "q").agg(F.min("v").alias("v"), F.max("total").alias("total"))


def op3_quality(spark, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
