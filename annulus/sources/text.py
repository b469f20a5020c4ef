"""Text tables with located headers, fields at fixed places and strict lines, read by Spark's text scan; bad lines are kept apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def placed_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Rows (file, block, seq, value): the lines of text files; (block, seq) is their order in a file, and seq has no gap inside a block."""
    d = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    return d.withColumn("seq", F.monotonically_increasing_id()).select("file", "block", "seq", F.regexp_replace("value", "\r$", "").alias("value"))


def fields(sep: str) -> Column:
    """The trimmed parts of a line; sep is a Java expression."""
    return F.transform(F.split("value", sep, -1), lambda x: F.trim(x))


def located_table(spark: SparkSession, path: str | list[str], first: str, *, skip: int = 2, sep: str = "\t", comment: str = "#") -> tuple[DataFrame, DataFrame]:
    """(rows of strings, bad lines (file, value)) of files whose header is the first line that begins with `first`.

    What stands before the header, the `skip` lines after it, blank lines and comments are no rows; a line with more or fewer fields than the header is bad.
    Each file has its own header, the same in all, which with the skipped lines lies in the file's first block; else it is refused.
    """
    lines = placed_lines(spark, path)
    head = lines.where(F.col("value").startswith(first)).groupBy("file").agg(F.min(F.struct("block", "seq", "value")).alias("h"))
    headers = head.groupBy("h.value").agg(F.max("h.block").alias("block")).limit(2).collect()  # of all files one, or the read is refused
    if len(headers) != 1:
        raise ValueError("no header line was found" if not headers else "files have different headers")
    if headers[0]["block"]:
        raise ValueError("a header lies beyond the first block of its file")
    names = [x.strip() for x in headers[0]["value"].split(sep)]
    d = lines.join(head.select("file", F.col("h.seq").alias("start")), "file").where((F.col("block") > 0) | (F.col("seq") > F.col("start") + skip))
    d = d.where((F.trim("value") != "") & ~F.col("value").startswith(comment)).withColumn("f", fields(sep))
    rows = d.where(F.size("f") == len(names)).select(*[F.col("f")[k].alias(c) for k, c in enumerate(names)])
    return rows, d.where(F.size("f") != len(names)).select("file", "value")


def positioned_table(spark: SparkSession, path: str | list[str], places: dict[str, tuple[int, str]], *, sep: str, comment: str = "#", key: str | None = None, required: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(rows, bad lines (file, value)) of files without a header: `places` gives each column its field, from 0, and its type.

    A value that is no such type, or a field beyond the end, is null; a line that has null in `required` or `key` is bad. With `key` the last line of a key in
    the order of files and lines stands for it. Blank lines and comments are no rows.
    """
    d = placed_lines(spark, path).where((F.trim("value") != "") & ~F.col("value").startswith(comment))
    d = d.withColumn("f", F.transform(F.split(F.trim("value") if sep == r"\s+" else F.col("value"), sep, -1), lambda x: F.trim(x)))
    d = d.select("file", "block", "seq", "value", *[F.get("f", F.lit(k)).try_cast(kind).alias(c) for c, (k, kind) in places.items()])
    ok = F.lit(True)
    for c in {*required, *([key] if key else [])}:
        ok = ok & F.col(c).isNotNull()
    rows, bad = d.where(ok), d.where(~ok).select("file", "value")
    if key:
        rest = [c for c in places if c != key]
        rows = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct("file", "block", "seq")).alias("r")).select(key, "r.*")
    return rows.select(*places), bad


def tycho(rows: DataFrame) -> DataFrame:
    """A deep catalogue from its strings: numbers, V and B - V from the two bands (V alone where the blue one is missing), motions 0 where unknown, one id."""
    number = lambda c: F.col(c).try_cast("double")
    d = rows.select(number("_RAJ2000").alias("ra"), number("_DEJ2000").alias("dec"), number("BTmag").alias("bt"), number("VTmag").alias("vt"), number("pmRA").alias("pm_ra"), number("pmDE").alias("pm_dec"), F.col("HIP").try_cast("int").alias("hip"), F.concat_ws("-", "TYC1", "TYC2", "TYC3").alias("tyc"))
    d = d.where("vt is not null and ra is not null and dec is not null")
    # The colour terms of the two bands.
    both = F.col("bt") - F.col("vt")
    return d.select("tyc", "hip", "ra", "dec", F.when(F.col("bt").isNotNull(), F.col("vt") - 0.090 * both).otherwise(F.col("vt")).alias("v"), (0.850 * both).alias("bv"), F.coalesce("pm_ra", F.lit(0.0)).alias("pm_ra"), F.coalesce("pm_dec", F.lit(0.0)).alias("pm_dec"))


def detections(rows: DataFrame, classes: tuple[str, ...] = ("A", "B")) -> DataFrame:
    """Detections of some classes under common names, ids as V and at least two digits."""
    named = {"x_px": "x", "y_px": "y", "flux_G_ADUs": "flux", "SNR_pila": "snr"}
    d = rows.where(F.col("classe").isin(*classes)).withColumnsRenamed(named)
    return d.withColumn("id", F.concat(F.lit("V"), F.when(F.length(F.col("id").cast("string")) < 2, F.lpad(F.col("id").cast("string"), 2, "0")).otherwise(F.col("id").cast("string"))))
