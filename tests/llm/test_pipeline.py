import corpus_pipeline as P
from ledgercheck.llm.common import learned, settled
from ledgercheck.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in P.STAGES[:-1]:
        docs = settled(stage(spark, docs, FOLDER), name)
        assert docs.columns == columns and 0 < docs.count() <= before
        before = docs.count()
    last = P.STAGES[-1][1](spark, docs, FOLDER)
    rows = last.collect()
    assert len(rows) == before == len({r["position"] for r in rows})
    assert set(columns) < set(last.columns)


def test_awkward_rows_and_decisions(spark, make_docs, awkward):
    english = [(100 + i, f"the of and that with from thing {i} the and of {i * 7}", "en", "a")
               for i in range(40)]
    german = [(200 + i, f"der die und schön über nicht zu {i} der und die {i * 7}", "de", None)
              for i in range(40)]
    passage = spark.read.parquet(f"{FOLDER}/benchmark.parquet").first()["text"]
    planted = [(300, passage, "en", "a"),
               (301, english[0][1] + " reach me at a.b@c.example now", "en", "a")]
    docs = make_docs(english + german + planted + [(*r, "en", "b") for r in awkward])
    for name, stage in P.STAGES:
        docs = settled(stage(spark, docs, FOLDER), name)
    got = {r["doc_id"]: r for r in docs.collect()}
    assert not {1, 2, 3, 4, 300} & set(got)
    assert {r[0] for r in english + german} <= set(got)
    assert "[EMAIL]" in got[301]["text"] and got[301]["slot"] == f"slot-{81}"


def test_empty_documents(spark, make_docs):
    docs = make_docs([])
    for name, stage in P.STAGES:
        docs = settled(stage(spark, docs, FOLDER), name)
    assert docs.count() == 0


def test_every_query_runs(spark):
    assert len(QUERIES) == 13
    for name, query in QUERIES.items():
        assert query(spark, FOLDER).count() > 0, name


def test_rows_to_learn_from(spark):
    df = spark.range(8).withColumnRenamed("id", "doc_id").withColumn("l", learned())
    import zlib
    assert all(r["l"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2) for r in df.collect())
