import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.llm import entries
from tests.conftest import same_rows
from tests.llm import cases

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A small corpus with planted cases: toxic rows, boilerplate, copies, near copies, a benchmark passage, clean rows."""
    rng = random.Random(11)
    at = str(tmp_path_factory.mktemp("corpus"))
    rows, marks, text = [], [], {}
    for i in range(300):
        words = cases.prose(1000 + i, rng.randint(30, 90), 3000).split(" ")
        toxic = i % 6 == 0
        if toxic:
            words[5] = "scumbag"
        text[i] = " ".join(words)
        rows.append((i, text[i], f"s{i % 15}"))
        if i < 240:
            marks.append((i, 1, int(toxic)))
    item = cases.prose(5, 30, 3000)
    base = cases.prose(77, 150, 3000).split(" ")
    near = [*base]
    near[70] = "changed"
    rows += [(400, " ".join(base), "s1"), (401, " ".join(base), "s2"), (402, " ".join(near), "s3"), (410, f"{cases.prose(8, 20)} {item} {cases.prose(9, 20)}", "s4")]
    rows += [(500 + i, f"{cases.prose(300 + i, 40, 3000)}\nAll rights reserved here", f"s{i}") for i in range(15)]
    rows += [(600, None, "s1"), (601, "", "s2")]
    docs = cases.docs_frame(spark, rows)
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        out.write.mode("overwrite").parquet(f"{folder}/stage{k}")
        docs = spark.read.parquet(f"{folder}/stage{k}")
        if k < 4:
            assert sorted(docs.columns) == sorted(columns)
        seen[name] = {r.doc_id: r for r in docs.collect()}
    toxic = {i for i in range(300) if i % 6 == 0}
    left = set(seen["toxicity"])
    assert len(toxic - left) >= 45 and len(left & (set(range(300)) - toxic)) >= 245
    assert {400, 401, 402, 410, 600, 601} <= left
    lines = seen["line_dedup"]
    assert all("reserved" not in lines[500 + i].text for i in range(15) if 500 + i in lines) and lines[600].text is None
    assert all(lines[d].n_chars == len(lines[d].text) for d in lines if lines[d].text is not None)
    kept = set(seen["near_duplicates"])
    assert 400 in kept and not {401, 402} & kept
    clean = set(seen["decontamination"])
    assert clean == kept - {410}
    assert set(seen["packing"]) == clean


def test_stages_take_empty_tables_and_clashing_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id >= 400")
    odd = cases.docs_frame(spark, cases.odd_docs(9))
    wide = docs.unionByName(odd)
    for name in ("row", "gone", "t1", "t2", "node", "id", "class", "least", "token", "w", "score", "toxic", "_part", "length", "keys"):
        wide = wide.withColumn(name, F.lit("mine"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, docs.where("false"), folder).isEmpty()
        out = stage(spark, wide, folder)
        if k < 4:
            assert out.columns == wide.columns and {r[0] for r in out.select("token").distinct().collect()} == {"mine"}
            assert out.where("doc_id is null").count() == 2
        else:
            assert out.where("piece = 0").count() == wide.count()


def test_run_leaves_one_table(spark, folder, tmp_path):
    from pathlib import Path

    from graphloom.llm.store import shared_folder

    at = Path(shared_folder(spark).removeprefix("file:"))
    before = {p for p in at.glob("table-*")}
    assert corpus_pipeline.run(spark, folder).count() > 0
    assert len({p for p in at.glob("table-*")} - before) == 1


def test_run_equals_the_stages(spark, folder):
    ours = corpus_pipeline.run(spark, folder)
    assert corpus_pipeline.ORACLE_SQL is None
    got = {(r.doc_id, r.piece, r.length, r.ids_crc32) for r in ours.collect()}
    want = {(r.doc_id, r.piece, r.length, r.ids_crc32) for r in spark.read.parquet(f"{folder}/stage4").collect()}
    assert got == want


def test_there_is_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in entries.QUERIES) == list(range(1, 11))


@pytest.mark.parametrize("name", sorted(entries.ORACLE_SQL))
def test_query_equals_its_sql(spark, sf_dir, name):
    from pathlib import Path

    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    same_rows(entries.QUERIES[name](spark, sf_dir).toPandas(), con.execute(entries.ORACLE_SQL[name]).df())


def test_queries_return_every_row(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for name in ("op3_toxicity", "op4_tiff_media", "op8_repeated_windows", "op9_token_counts", "op10_bagminhash"):
        assert entries.QUERIES[name](spark, sf_dir).count() == n
    assert entries.QUERIES["op5_language"](spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/pages.parquet").count()
    assert entries.QUERIES["op1_chat_turns"](spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/conversations.parquet").count()
    assert entries.QUERIES["op6_best_fit"](spark, sf_dir).agg(F.countDistinct("doc_id")).first()[0] == n
