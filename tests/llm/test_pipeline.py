import corpus_pipeline
from storelens.llm.catalog import QUERIES
from tests.llm.conftest import rows_of
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_near_dedup import brute_classes

SF = "/root/testdata/sf0.001"


def test_stages_take_effect_and_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["language_id", "line_dedup", "near_dedup", "source_mixing", "packing"]
    kept = stage["language_id"](spark, docs, SF)
    assert kept.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    assert {d for d, _ in rows} == {r.doc_id for r in docs.collect() if r.text and any(map(str.isalpha, r.text))}

    lines = stage["line_dedup"](spark, kept, SF)
    assert lines.columns == docs.columns
    after = {r.doc_id: r.text for r in lines.collect()}
    assert after == {d: t for d, t, *_ in brute_lines(rows)}

    near = stage["near_dedup"](spark, lines, SF)
    assert near.columns == docs.columns
    assert {r.doc_id for r in near.collect()} == set(brute_classes(list(after.items())).values())

    mixed = stage["source_mixing"](spark, near, SF)
    assert mixed.columns == docs.columns
    tokens = stage["packing"](spark, mixed, SF).agg({"length": "sum"}).first()[0]
    whole = corpus_pipeline.run(spark, SF)
    assert whole.agg({"length": "sum"}).first()[0] == tokens


def test_stages_take_odd_rows_clashing_names_and_an_empty_table(frame, odd_texts, spark):
    rows = rows_of(odd_texts + odd_texts[:4]) + [(3, "a text of its own under a known id", None, None, *[None] * 6), (None, None, *[None] * 8)]
    docs = frame(rows)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "packing":
            assert out.columns == docs.columns
            assert {r._row for r in out.collect()} <= {7, None}
        assert out.count() > 0
        assert stage(spark, frame([]), SF).count() == 0


def test_every_query_is_registered():
    import __spark_entry__ as entry
    names = list(entry.queries())
    assert [n for n in QUERIES if n not in names] == []
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)) and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)


def test_oracle_sql_matches(spark):
    import duckdb

    from storelens.llm.catalog import ORACLE
    from tests.helpers import canon
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    for name, sql in ORACLE.items():
        assert canon(QUERIES[name](spark, SF).toPandas()) == canon(con.execute(sql).df()), name
