import pytest
from pyspark.sql import functions as F

from graphloom import schema
from graphloom.functions import arrays
from graphloom.functions.ranking import first_in_order, ordered, quantiles, ranked
from graphloom.plans import cli
from graphloom.sources.edge_files import adjacency_text, directed, loaded_vertices, parse_edge_lines, print_results, read_edges, read_results, six_digits, write_results
from graphloom.sources.tables import insert

LINES = ["", "1,1,2", "2,1,2,5", "3,2,3,5,6", "4,3,4,5,6,7", "5,8,9,-1,-1", "6,1,3,0", "id,source,target,cost", "7,1,4,2.5e1x,", "8 ,1,5,abc"]


def lines_of(spark):
    return spark.createDataFrame([(x,) for x in LINES], "value string")


def test_edge_lines(spark):
    got = {r.id: (r.source, r.target, r.cost, r.reverse_cost) for r in parse_edge_lines(lines_of(spark)).collect()}
    assert got == {2: (1, 2, 5, -1), 3: (2, 3, 5, 6), 4: (3, 4, 5, -1), 5: (8, 9, -1, -1), 6: (1, 3, 0, -1), 7: (1, 4, 25, -1), 8: (1, 5, 0, -1)}
    loose = parse_edge_lines(lines_of(spark), strict=False)
    assert {r.id for r in loose.collect()} == {*got, 0}
    rows = parse_edge_lines(lines_of(spark))
    assert {(r.id, r.source, r.target) for r in directed(rows).collect()} == {(2, 1, 2), (3, 2, 3), (3, 3, 2), (4, 3, 4), (6, 1, 3), (7, 1, 4), (8, 1, 5)}
    assert {8, 9} <= {r.id for r in loaded_vertices(rows).collect()}


def test_other_delimiters_are_literal(spark):
    assert parse_edge_lines(spark.createDataFrame([("1|2|3|4",)], "value string"), "|").count() == 1


def test_a_missing_file_raises(spark, tmp_path):
    from pyspark.errors import AnalysisException

    with pytest.raises(AnalysisException):
        read_edges(spark, str(tmp_path / "none.csv")).count()


def test_result_files(spark, tmp_path):
    edges = spark.createDataFrame([(1, 1, 2, 6.5, 2), (2, 2, 3, 1234567.891, 1)], "id long, source long, target long, betweenness double, level int")
    write_results(edges, str(tmp_path / "out"), 3)
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert '1,1,2,6.5,2,"{1, 1, 1}"' in text
    got = {r.id: (r.betweenness, r.level, list(r.component)) for r in read_results(spark, str(tmp_path / "out")).collect()}
    assert got == {1: (6.5, 2, [1, 1, 1]), 2: (1234567.891, 1, [1, 1, 1])}
    write_results(edges, str(tmp_path / "short"), 3, digits=6)
    assert {r.betweenness for r in read_results(spark, str(tmp_path / "short")).collect()} == {6.5, 1234570.0}


def test_adjacency_text(spark):
    edges = spark.createDataFrame([(2, 1, 3, 4.0), (1, 1, 2, 5.0), (3, 2, 1, 6.0)], "id long, source long, target long, cost double")
    assert {r.source: r.line for r in adjacency_text(edges).collect()} == {1: "1: 2(1,5) 3(2,4)", 2: "2: 1(3,6)"}


def test_schema_helpers(spark):
    rows = spark.createDataFrame([(1,), (1,)], "id long")
    out = schema.conform(rows, schema.VERTICES)
    assert out.first().component == [] and out.first().the_geom is None
    with pytest.raises(schema.DuplicateKey):
        schema.check_key(rows, "id")
    assert schema.check_key(rows.distinct(), "id").count() == 1
    assert insert(out, rows).count() == 4


def test_arrays(spark):
    one = spark.range(1).select(F.array(F.lit(5), F.lit(6)).alias("a"), F.lit("{1, 20}").alias("t"), F.lit("{}").alias("e"))
    r = one.select(arrays.at("a", 2).alias("x"), arrays.at("a", 3).alias("y"), arrays.put("a", 1, F.lit(9)).alias("p"), arrays.filled(0, 2).alias("f"), arrays.brackets("t").alias("b"), arrays.long_list("t").alias("l"), arrays.long_list("e").alias("m")).first()
    assert (r.x, r.y, list(r.p), list(r.f), r.b, list(r.l), list(r.m)) == (6, None, [9, 6], [0, 0], "[1, 20]", [1, 20], [])


def frame(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "k long, v double")


@pytest.mark.parametrize(
    ("method", "want"),
    [("min", [1, 2, 2, 4]), ("max", [1, 3, 3, 4]), ("average", [1, 2.5, 2.5, 4]), ("ordinal", [1, 2, 3, 4]), ("anything", [1, 2, 3, 4])],
)
def test_ranks(spark, method, want):
    got = [r["rank"] for r in ranked(frame(spark, [1.0, 2.0, 2.0, 3.0]), "v", "k", method).orderBy("k").collect()]
    assert got == want


def test_partial_ranks_cut_ties(spark):
    rows = frame(spark, [5.0, 1.0, 5.0, 5.0, 0.0])
    ranks = lambda m, d=False: [r["rank"] for r in ranked(rows, "v", "k", m, d, 3).orderBy("k").collect()]
    assert ranks("average") == [3, 2, 0, 0, 1]
    assert ranks("max") == [3, 2, 0, 0, 1]
    assert ranks("average", True) == [2, 0, 2, 2, 0]
    assert ranks("ordinal", True) == [1, 0, 2, 3, 0]


def test_orders(spark):
    rows = frame(spark, [3.0, 1.0, 3.0])
    assert [r.k for r in ordered(rows, "v", "k").orderBy("position").collect()] == [1, 0, 2]
    assert [r.k for r in ordered(rows, "v", "k", descending=True).orderBy("position").collect()] == [0, 2, 1]
    assert [r.k for r in first_in_order(rows, "v", "k", 99, descending=True).collect()] == [0, 2, 1]
    assert [r.k for r in first_in_order(rows, "v", "k", 1).collect()] == [1]


def test_null_values_are_ranked_among_themselves(spark):
    rows = spark.createDataFrame([(1, None), (2, None), (3, 1.0)], "k long, v double")
    assert {r.k: r["rank"] for r in ranked(rows, "v", "k", "min").collect()} == {1: 1.0, 2: 1.0, 3: 3.0}


def test_ranks_in_groups(spark):
    rows = spark.createDataFrame([(1, "a", 2.0), (2, "a", 1.0), (3, "b", 9.0), (4, None, 5.0), (5, "a", 2.0), (6, None, 4.0)], "k long, g string, v double")
    ranks = lambda m, **kw: {r.k: r["rank"] for r in ranked(rows, "v", "k", m, by=("g",), **kw).collect()}
    assert ranks("average") == {1: 2.5, 2: 1, 3: 1, 4: 2, 5: 2.5, 6: 1}
    assert ranks("ordinal", descending=True) == {1: 1, 2: 3, 3: 1, 4: 1, 5: 2, 6: 2}
    assert ranks("max", num=2) == {1: 2, 2: 1, 3: 1, 4: 2, 5: 0, 6: 1}


def test_ranks_of_nothing(spark):
    assert ranked(frame(spark, [1.0]).where("false"), "v", "k", "average", num=3).isEmpty()


def test_quantiles(spark):
    q = lambda values, at: quantiles(values, "v", at).first().q
    assert q(frame(spark, [1.0, 2.0, 4.0, 8.0, 16.0]), [-1, 0.1, 0.25, 0.9, 2]) == pytest.approx([1, 1.4, 2, 12.8, 16])
    assert q(frame(spark, [7.0]), [0.3]) == [7.0]
    assert q(frame(spark, [7.0]).where("false"), [0.3, 1]) == [0.0, 0.0]


def test_six_digits(spark):
    values = [0.0, 0.5, 0.75, 10.0, -3.25, 1234567.891, 999999.5, 999999.4, 123456.7, 0.0001, 0.00012345678, 0.00001, 1e-7, 99999.96, 1e21, 2 / 3, -1e6, 100.0, float("inf"), float("nan")]
    got = [r.t for r in frame(spark, values).select("k", six_digits(F.col("v")).alias("t")).orderBy("k").collect()]
    assert got == ["%g" % v for v in values]


def test_printed_results_and_fractional_costs(spark):
    edges = spark.createDataFrame([(1, 1, 2, 0.5, 2 / 3), (2, 1, 3, 0.75, 4.0)], "id long, source long, target long, cost double, betweenness double")
    assert {r.id: r.line for r in print_results(edges).collect()} == {1: "id: 1, source: 1, target: 2, betweenness: 0.666667", 2: "id: 2, source: 1, target: 3, betweenness: 4"}
    assert adjacency_text(edges).first().line == "1: 2(1,0.5) 3(2,0.75)"


def test_command_line(spark, tmp_path):
    rows = ["1,1,2,1,1", "2,2,3,1,1", "3,3,1,2,2", "4,3,4,1"]
    (tmp_path / "streets.csv").write_text("\n".join(rows))
    cli.main([str(tmp_path / "streets.csv"), str(tmp_path / "out"), "--levels", "5"], spark)
    assert spark.read.parquet(str(tmp_path / "out/edges")).count() == 6
    assert read_results(spark, str(tmp_path / "out/results_csv")).count() == 6
