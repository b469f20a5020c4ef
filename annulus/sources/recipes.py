"""JSON recipes and geometries with strict keys, and receipts of what a product was made from."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The fields of a geometry in order, those that must be there, and their types.
GEOMETRY = "shape array<int>, sun_xy array<double>, sun_radius_px double, moon_xy array<double>, moon_radius_px double, north_deg double, mirrored boolean, arcsec_per_px double, note string"
REQUIRED = ("shape", "sun_xy", "sun_radius_px")


def strict(text: Column, allowed: tuple[str, ...], label: str, required: tuple[str, ...] = ()) -> Column:
    """The JSON object, unless it is none, has keys besides `allowed` or lacks some of `required`: the query then fails when it runs and names them."""
    keys = F.json_object_keys(text)
    unknown, missing = F.array_sort(F.array_except(keys, F.array(*map(F.lit, allowed)))), F.array_except(F.array(*map(F.lit, required)).cast("array<string>"), keys)
    fail = lambda what, c: F.raise_error(F.concat(F.lit(f"{what} {label} keys: "), F.array_join(c, ", "))).cast("string")
    return F.when(keys.isNull(), F.raise_error(F.lit(f"no {label} object")).cast("string")).when(F.size(unknown) > 0, fail("unknown", unknown)).when(F.size(missing) > 0, fail("missing", missing)).otherwise(text)


def geometry(text: Column) -> Column:
    """A geometry struct from JSON, north 0, not mirrored and without a note unless it says so."""
    names = tuple(f.split()[0] for f in GEOMETRY.split(", "))
    parsed = F.from_json(strict(text, names, "geometry", REQUIRED), GEOMETRY)
    filled = {"north_deg": F.lit(0.0), "mirrored": F.lit(False), "note": F.lit("")}
    # Inside a function of an array's element the JSON is parsed once, and not once for each field.
    return F.transform(F.array(parsed), lambda g: F.struct(*[(F.coalesce(g[c], filled[c]) if c in filled else g[c]).alias(c) for c in names]))[0]


def geometry_json(g: Column) -> Column:
    return F.to_json(g)


def digests(inputs: DataFrame, keys: tuple[str, ...], name: str, content: str) -> DataFrame:
    """Rows (*keys, inputs, bytes, sha256): how many inputs a product of each key was made from, their bytes, and a digest of their names and digests in order."""
    raw = F.coalesce(F.col(content).cast("binary"), F.lit("").cast("binary"))
    each = inputs.select(*keys, F.coalesce(F.col(name).cast("string"), F.lit("")).alias("name"), F.octet_length(raw).alias("bytes"), F.sha2(raw, 256).alias("sha256"))
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("name", "sha256"))), lambda x: F.concat_ws(" ", x["name"], x["sha256"])), "\n")
    return each.groupBy(*keys).agg(F.count("*").alias("inputs"), F.sum("bytes").alias("bytes"), F.sha2(listed, 256).alias("sha256"))


def receipt(spark: SparkSession, product: str, inputs: dict[str, str], *, parameters: dict | None = None, gates: dict | None = None, notes: str = "") -> DataFrame:
    """One row (receipt), a JSON text: product, inputs by label with path, bytes and digest as read by Spark, parameters, gates and notes.

    A path that is no file is listed without a digest. A file is read as one row, so it is below Spark's limit of 2 GB.
    """
    rows = spark.createDataFrame([(k, v) for k, v in sorted(inputs.items())] or [], "label string, wanted string")
    pattern = [v for v in inputs.values()]
    d = spark.read.format("binaryFile").option("ignoreMissingFiles", True)
    found = None
    for p in pattern:
        one = d.load(p.rsplit("/", 1)[0]).where(F.element_at(F.split("path", "/"), -1) == p.rsplit("/", 1)[1]).select(F.lit(p).alias("at"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
        found = one if found is None else found.union(one)
    listed = rows.join(found, F.col("wanted") == F.col("at"), "left") if found is not None else rows.withColumns({"bytes": F.lit(None).cast("long"), "sha256": F.lit(None).cast("string")})
    entry = F.struct("label", F.struct(F.col("wanted").alias("path"), "bytes", "sha256").alias("file"))
    made = listed.agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("inputs"))
    fixed = lambda x: F.parse_json(F.lit(json.dumps(x or {}, sort_keys=True)))
    return made.select(F.to_json(F.struct(F.lit(product).alias("product"), "inputs", fixed(parameters).alias("parameters"), fixed(gates).alias("gates"), F.lit(notes).alias("notes"))).alias("receipt"))
