"""Headerless edge files in, result files out and in again, and a graph's text dump."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a C number parser takes from the front of a token.
_WHOLE, _REAL = r"^\s*([+-]?\d+)", r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"


def _number(token: Column, pattern: str, kind: str) -> Column:
    """The number at the token's front, 0 where there is none."""
    return F.coalesce(F.regexp_extract(token, pattern, 1).try_cast(kind), F.lit(0).cast(kind))


def parse_edge_lines(lines: DataFrame, delimiter: str = ",", strict: bool = True) -> DataFrame:
    """(value) lines of id, source, target, cost and, if there are exactly five fields, reverse_cost, as rows of these.

    Blank lines and lines of fewer than four fields are dropped; a trailing empty field does not
    count; any but five fields close the reverse direction with -1. With ``strict`` a line whose ids
    are not numbers, such as a header, is dropped too; else they read as 0.
    """
    raw = F.split(F.regexp_replace("value", "\r$", ""), f"\\Q{delimiter}\\E", -1)
    tokens = F.when(F.element_at(raw, -1) == "", F.slice(raw, 1, F.size(raw) - 1)).otherwise(raw)
    rows = lines.where(F.length("value") > 0).select(tokens.alias("t")).where(F.size("t") >= 4)
    if strict:
        rows = rows.where(F.forall(F.slice("t", 1, 3), lambda x: x.rlike(_WHOLE)))
    ids = [_number(F.get("t", F.lit(i)), _WHOLE, "bigint").alias(n) for i, n in enumerate(("id", "source", "target"))]
    reverse = F.when(F.size("t") == 5, _number(F.get("t", F.lit(4)), _REAL, "double")).otherwise(-1.0)
    return rows.select(*ids, _number(F.get("t", F.lit(3)), _REAL, "double").alias("cost"), reverse.alias("reverse_cost"))


def read_edges(spark: SparkSession, path: str, delimiter: str = ",", strict: bool = True) -> DataFrame:
    """An edge file's rows; a missing file raises."""
    return parse_edge_lines(spark.read.text(path), delimiter, strict)


def directed(rows: DataFrame) -> DataFrame:
    """(id, source, target, cost): up to two directed edges a row, both of its id; a cost of zero counts, a negative one closes."""
    forward, backward = (F.struct(F.lit(k).alias("way"), F.col(s).alias("source"), F.col(t).alias("target"), F.col(c).alias("cost")) for k, s, t, c in ((0, "source", "target", "cost"), (1, "target", "source", "reverse_cost")))
    return rows.select("id", F.explode(F.array(forward, backward)).alias("e")).select("id", "e.source", "e.target", "e.cost").where("cost >= 0")


def loaded_vertices(rows: DataFrame) -> DataFrame:
    """(id): every end that a file names, even if both directions are closed."""
    return rows.select(F.explode(F.array("source", "target")).alias("id")).distinct()


def six_digits(value: Column) -> Column:
    """A double as a C++ stream writes it: six significant digits, no zeros at the end, an exponent below 1e-4 and from 1e6 on. Halves are rounded by the shortest decimal spelling."""
    value = value.cast("double")
    size = F.floor(F.log10(F.abs(value)))
    # a value that rounds up to the next power of ten has one digit more before its point
    size = F.when(F.round(F.abs(value) / F.pow(F.lit(10.0), size), 5) >= 10, size + 1).otherwise(size)
    bare = lambda text: F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    scaled = bare(F.round(value / F.pow(F.lit(10.0), size), 5).cast("decimal(20,5)").cast("string"))
    exponent = F.concat(F.when(size < 0, "e-").otherwise("e+"), F.lpad(F.abs(size).cast("string"), 2, "0"))
    plain = F.lit(None).cast("string")
    for k in range(-4, 6):
        plain = F.when(size == k, bare(F.round(value, 5 - k).cast("decimal(20,10)").cast("string"))).otherwise(plain)
    special = F.when(F.isnan(value), "nan").when(value == float("inf"), "inf").when(value == float("-inf"), "-inf").when(value == 0, "0")
    return F.when(special.isNotNull(), special).when(size.between(-4, 5), plain).otherwise(F.concat(scaled, exponent))


def brace_list(values: Column) -> Column:
    """An array as {1, 2, 3}."""
    return F.concat(F.lit("{"), F.array_join(values.cast("array<string>"), ", "), F.lit("}"))


def parse_brace_list(text: Column) -> Column:
    inside = F.trim(F.regexp_replace(text, r"[{}]", ""))
    return F.when(inside == "", F.array().cast("array<int>")).otherwise(F.transform(F.split(inside, r"\s*,\s*"), lambda x: x.cast("int")))


def write_results(edges: DataFrame, path: str, levels: int = 10, digits: int | None = None) -> None:
    """id, source, target, betweenness, level, "{1, 1, ...}" without a header; with digits=6 betweenness is written as C++ streams write it."""
    if digits not in (None, 6):
        raise ValueError("digits must be None or 6")
    value = F.col("betweenness") if digits is None else six_digits(F.col("betweenness"))
    ones = brace_list(F.array_repeat(F.lit(1), levels))
    edges.select("id", "source", "target", value.alias("betweenness"), "level", ones.alias("component")).write.mode("overwrite").csv(path, quote='"', escape='"')


def print_results(edges: DataFrame) -> DataFrame:
    """(id, source, target, line): each edge's result as a line to print."""
    named = [F.concat(F.lit(f"{c}: "), F.col(c).cast("string")) for c in ("id", "source", "target")]
    return edges.select("id", "source", "target", F.concat_ws(", ", *named, F.concat(F.lit("betweenness: "), six_digits(F.col("betweenness")))).alias("line"))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """(id, source, target, betweenness, level, component) of a result file."""
    rows = spark.read.schema("id long, source long, target long, betweenness double, level int, component string").csv(path, quote='"', escape='"')
    return rows.withColumn("component", parse_brace_list(F.col("component")))


def adjacency(edges: DataFrame) -> DataFrame:
    """(source, degree, edges): each vertex with its outgoing edges in order of (target, id, cost)."""
    out = F.array_sort(F.collect_list(F.struct("target", "id", "cost")))
    return edges.groupBy("source").agg(F.count("*").alias("degree"), out.alias("edges"))


def adjacency_text(edges: DataFrame) -> DataFrame:
    """(source, line): the dump's line of each vertex, "source: target(id,cost) ..."."""
    one = lambda e: F.concat(e["target"].cast("string"), F.lit("("), e["id"].cast("string"), F.lit(","), six_digits(e["cost"]), F.lit(")"))
    return adjacency(edges).select("source", F.concat(F.col("source").cast("string"), F.lit(": "), F.array_join(F.transform("edges", one), " ")).alias("line"))
