"""Fill-in-middle: texts cut between units at places that the document's id draws, by relational units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: The marks of prefix, suffix and middle, and the percentages of plain texts and of texts with the suffix first.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_FROM, SUFFIX_FIRST = 90, 20
#: One code point.
CODE_POINT = "(?s)."


def draws(id: Column, salt: str) -> list[Column]:
    """Four numbers of 32 bits from a document's id; a null id is an empty text."""
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def unit_runs(docs: DataFrame, unit: str, run: int) -> DataFrame:
    """Rows (id, content, ordinal, units, bytes, units_before, bytes_before): the text of each (id, content) as runs of `run` units.

    The matches of a run of units are exploded with their positions, their lengths alone cross the shuffle, and running
    sums over the positions tell what precedes each. Equal rows of `docs` (id, content, text) count once.
    """
    runs = F.regexp_extract_all("text", F.lit(f"(?:{unit}){{1,{run}}}"), F.lit(0))
    sized = F.transform("runs", lambda x, k: F.struct(F.when(k + 1 < F.size("runs"), F.lit(run)).otherwise(F.regexp_count(x, F.lit(unit))).alias("units"), F.octet_length(x).alias("bytes")))
    d = docs.withColumn("runs", runs).select("id", "content", F.posexplode(sized).alias("ordinal", "r"))
    d = d.groupBy("id", "content", "ordinal").agg(F.first("r.units").alias("units"), F.first("r.bytes").alias("bytes"))
    before = Window.partitionBy("id", "content").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    return d.withColumns({"units_before": total("units"), "bytes_before": total("bytes")})


def infilled(docs: DataFrame, *, id: str = "doc_id", text: str = "text", salt: str = "1", unit: str = CODE_POINT, run: int = 256) -> DataFrame:
    """Rows (id, n, form, prefix, middle, suffix, output): each text cut at two drawn places between its `n` units.

    Units are what `unit`, a Java expression whose matches must tile each text, matches from left to right. The prefix ends after the
    smaller and the middle after the larger of two draws among 0 ... n. form is plain (empty texts, texts that hold a mark, and one in ten by a
    third draw; the output is the text and the parts are null), spm (one in five of the rest: suffix, prefix, middle) or psm.

    A relational unit is a run of `run` units: the matches of runs are exploded by ordinal, running sums of their lengths are made in a window, the
    two cuts of a text are joined by the ordinal of the run that holds them, and their offsets, aggregated per document, are joined to the
    texts, which cross the shuffle once. A cut inside a run is found in that run alone. With runs of one unit the same relations hold
    for each unit; code points by the hundred keep them to a four-hundredth of the rows.

    A null text is empty. Rows are told apart by id and contents, so repeated ids, null ids and equal rows all keep their own text. Other
    columns, whatever their names, are not read. An empty table gives no rows.
    """
    d = docs.select(F.col(id).alias("id"), F.xxhash64(id, text).alias("content"), F.coalesce(text, F.lit("")).alias("text"))
    runs = stored(unit_runs(d, unit, run))
    h = draws(F.col("id"), salt)
    sizes = runs.groupBy("id", "content").agg(F.sum("units").alias("n"))
    places = [F.pmod(h[k], F.col("n") + 1) for k in (0, 1)]
    cuts = F.posexplode(F.array(F.least(*places), F.greatest(*places))).alias("cut", "at")
    requests = sizes.select("id", "content", "n", cuts).withColumn("ordinal", F.floor(F.least(F.col("at"), F.col("n") - 1) / run).cast("int"))
    held = requests.alias("q").join(runs.alias("r"), F.col("q.id").eqNullSafe(F.col("r.id")) & (F.col("q.content") == F.col("r.content")) & (F.col("q.ordinal") == F.col("r.ordinal")))
    found = F.struct(F.col("bytes_before").alias("start"), F.col("bytes").alias("size"), (F.col("at") - F.col("units_before")).cast("int").alias("rest"))
    offsets = held.groupBy("q.id", "q.content").agg(F.first("n").alias("n"), *[F.max(F.when(F.col("cut") == k, found)).alias(f"cut{k}") for k in (0, 1)])
    offsets = stored(offsets.select(F.col("id").alias("o_id"), F.col("content").alias("o_content"), "n", "cut0", "cut1"))
    d = d.join(offsets, F.col("id").eqNullSafe(F.col("o_id")) & (F.col("content") == F.col("o_content")), "left")

    raw = F.encode("text", "utf-8")
    slice_of = lambda start, size: F.decode(raw.substr(start, size), "utf-8")
    marked = F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    form = F.when((F.col("text") == "") | marked | (h[2] % 100 >= PLAIN_FROM), "plain").when(h[3] % 100 < SUFFIX_FIRST, "spm").otherwise("psm")
    inside = lambda c: F.octet_length(F.array_join(F.slice(F.regexp_extract_all(slice_of(F.col(f"{c}.start") + 1, F.col(f"{c}.size")), F.lit(unit), F.lit(0)), F.lit(1), F.col(f"{c}.rest")), ""))
    d = d.select("id", F.coalesce("n", F.lit(0)).cast("long").alias("n"), form.alias("form"), "text", *[(F.col(f"{c}.start") + inside(c)).cast("int").alias(c) for c in ("cut0", "cut1")])
    part = lambda start, size: F.when(F.col("form") != "plain", slice_of(start, size))
    d = d.select("id", "n", "form", "text", part(F.lit(1), F.col("cut0")).alias("prefix"), part(F.col("cut0") + 1, F.col("cut1") - F.col("cut0")).alias("middle"), part(F.col("cut1") + 1, F.octet_length("text")).alias("suffix"))
    p, s, m = (F.concat(F.lit(mark), F.col(c)) for mark, c in ((PREFIX, "prefix"), (SUFFIX, "suffix"), (MIDDLE, "middle")))
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", F.concat(p, s, m)).otherwise(F.concat(s, p, m))
    return d.select(F.col("id").alias(id), "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text from an output and its form alone. No part holds a mark, so the first of each kind is the one put there."""
    p, s, m = F.locate(PREFIX, output), F.locate(SUFFIX, output), F.locate(MIDDLE, output)
    width = len(PREFIX)
    between = lambda a, b: F.substring(output, a + width, b - a - width)
    tail = F.substring(output, m + width, F.char_length(output))
    return F.when(form == "plain", output).when(form == "psm", F.concat(between(p, s), tail, between(s, m))).otherwise(F.concat(between(p, m), tail, between(s, p)))


OP12_SQL = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
h AS (SELECT doc_id, text, n, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS a, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS b, ('0x' || substr(h, 17, 8))::BIGINT % 100 AS c, ('0x' || substr(h, 25, 8))::BIGINT % 100 AS e FROM d),
f AS (SELECT *, least(a, b) AS lo, greatest(a, b) AS hi, CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR c >= {PLAIN_FROM} THEN 'plain' WHEN e < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substr(text, 1, lo) AS prefix, substr(text, lo + 1, hi - lo) AS middle, substr(text, hi + 1) AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars, CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle ELSE '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle END) AS output_sha256, sha256(text) AS restored_sha256 FROM p"""


def op12_infill(spark, sf_dir: str) -> DataFrame:
    d = infilled(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    digest = lambda c: F.sha2(F.encode(c, "utf-8"), 256)
    chars = lambda c: F.char_length(c).cast("long").alias(f"{c}_chars")
    return d.select("doc_id", "n", "form", chars("prefix"), chars("middle"), digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))
