"""Text DXF as tables: a tokenizer in DataFrame functions, a typed entity table, and writers.

A file is pairs of lines, a group code and a value. One file is one row of ``spark.read.text(wholetext)``; the pairs
become rows by posexplode, and records, which start at code 0, are numbered by a running sum inside each file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from plotweave.sources.dxf_stream import BINARY, CODE_KINDS


def is_binary(content):
    """Whether a file's bytes start with the sentinel of binary files."""
    return F.substring(content, 1, len(BINARY)) == F.lit(bytearray(BINARY))


def code_type(code):
    """Type of a group code's value."""
    out = None
    for kind, spans in CODE_KINDS:
        test = None
        for a, b in spans:
            one = code.between(a, b)
            test = one if test is None else test | one
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return out.otherwise("unknown")


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """file, pos, code, value of every pair of lines."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return pairs(text)


def pairs(files: DataFrame) -> DataFrame:
    """The pairs of files given as (file, value)."""
    lines = files.select("file", F.split("value", r"\r\n|\n|\r").alias("lines"))
    halves = F.expr("transform(sequence(0, greatest(0, size(lines) div 2 - 1)), i -> struct(get(lines, 2 * i) AS code, get(lines, 2 * i + 1) AS value))")
    each = lines.select("file", F.posexplode(halves).alias("pos", "pair"))  # the pairs alone become rows, not the file beside each
    return each.select("file", "pos", F.expr("try_cast(trim(pair.code) AS INT)").alias("code"), "pair.value").where("code is not null")


def records(found: DataFrame) -> DataFrame:
    """file, section, record, type, pos, code, value: pairs with the record and section they belong to."""
    w = W.partitionBy("file").orderBy("pos")
    out = found.withColumn("record", F.sum(F.when(F.col("code") == 0, 1).otherwise(0)).over(w))
    out = out.withColumn("type", F.first("value").over(W.partitionBy("file", "record").orderBy("pos")))
    opened = F.when((F.col("type") == "SECTION") & (F.col("code") == 2), F.col("value"))
    return out.withColumn("section", F.last(opened, ignorenulls=True).over(w))


def _value(code: int, kind: str):
    """The record's value of a code; null if there is none or it isn't of the kind."""
    return F.max(F.when(F.col("code") == code, F.trim("value"))).try_cast(kind)


def entities(found: DataFrame, section: str = "ENTITIES") -> DataFrame:
    """One row for each entity of a section: type, handle, layer, colour, linetype and its first coordinates."""
    rows = records(found).where((F.col("section") == section) & ~F.col("type").isin("SECTION", "ENDSEC", "EOF"))
    return rows.groupBy("file", "record", "type").agg(
        F.conv(_value(5, "string"), 16, 10).cast("long").alias("handle"), _value(8, "string").alias("layer"), _value(62, "int").alias("aci"), _value(6, "string").alias("linetype"),
        _value(10, "double").alias("x"), _value(20, "double").alias("y"), _value(11, "double").alias("x2"), _value(21, "double").alias("y2"), _value(40, "double").alias("radius"), _value(1, "string").alias("text"))


def header(found: DataFrame) -> DataFrame:
    """file, variable, values of the header section."""
    rows = records(found).where("section = 'HEADER' and type = 'SECTION' and code <> 0")
    w = W.partitionBy("file").orderBy("pos")
    named = rows.withColumn("variable", F.last(F.when(F.col("code") == 9, F.col("value")), ignorenulls=True).over(w))
    return named.where("code <> 9 and variable is not null").groupBy("file", "variable").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "value"))), lambda v: v["value"]).alias("values"))


def layers(found: DataFrame) -> DataFrame:
    """file, name, aci, linetype of the layer table."""
    rows = records(found).where("section = 'TABLES' and type = 'LAYER'")
    return rows.groupBy("file", "record").agg(_value(2, "string").alias("name"), _value(62, "int").alias("aci"), _value(6, "string").alias("linetype")).drop("record")


def as_dxf(lines: DataFrame) -> DataFrame:
    """file, value: a text DXF with the LINE entities (file, handle, layer, x, y, x2, y2)."""
    pair = lambda code, c: F.concat(F.lit(f"{code}\n"), c.cast("string"), F.lit("\n"))
    one = F.concat(F.lit("0\nLINE\n"), pair(5, F.hex("handle")), pair(8, F.col("layer")), pair(10, F.col("x")), pair(20, F.col("y")), pair(11, F.col("x2")), pair(21, F.col("y2")))
    body = lines.groupBy("file").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("handle", one.alias("t")))), lambda v: v["t"]), "").alias("body"))
    return body.select("file", F.concat(F.lit("0\nSECTION\n2\nENTITIES\n"), F.col("body"), F.lit("0\nENDSEC\n0\nEOF\n")).alias("value"))
