"""Sources, sinks, engine, command line and stream ingest over files written here."""

import gzip
import io
import json
import re

import pytest
from pyspark.sql import functions as F

from impactspark import cli, sinks
from impactspark.engine import Engine
from impactspark.operators import evaluation, index, search
from impactspark.sources import ciff, documents, tables
from impactspark.streaming import current, ingest

TEN = "ten nine eight seven six five four three two one".split()
TREC = "".join(f"<DOC>\n<DOCNO> d{i} </DOCNO>\n{' '.join(TEN[:i])}\n</DOC>\n" for i in range(1, 11))


def _keys(df):
    return sorted((r.primary_key, r.contents) for r in df.collect())


def test_trec(spark, tmp_path):
    (tmp_path / "a.txt").write_text("<DOC><DOCNO> 1 </DOCNO>one</DOC>\n<DOC>two</DOC>\nx<DOC><DOCNO>3</DOCNO>three</DOC>")
    with gzip.open(tmp_path / "b.txt.gz", "wt") as f:
        f.write("<DOC><DOCNO>4</DOCNO>four</DOC>")
    got = _keys(documents.trec(spark, str(tmp_path)))
    assert [k for k, _ in got] == ["1", "3", "4", "Unknown"] and got[0][1] == "<DOC><DOCNO> 1 </DOCNO>one</DOC>"


def test_broken_documents(spark, tmp_path):
    """An unterminated document is none, at the end of a file or before another; a broken key is no key."""
    (tmp_path / "a").write_text("preamble <DOC><DOCNO>10</DOCNO>ten</DOC>\n<DOC><DOCNO>13 thirteen</DOC>\n<DOC><DOCNO>12</DOCNO>twelve\n")
    (tmp_path / "b").write_text("<DOC><DOCNO>12</DOCNO>twelve <DOC><DOCNO>1</DOCNO>one</DOC> tail <DOC><DOCNO>11")
    (tmp_path / "c").write_text("nothing here")
    assert [k for k, _ in _keys(documents.trec(spark, str(tmp_path)))] == ["1", "10", "Unknown"]


def test_large_files_are_many_tasks(spark, tmp_path):
    """Records of files cut into splits: each comes once, wherever the cuts are."""
    record = lambda i: f"WARC/1.0\r\nWARC-TREC-ID: w-{i}\r\nContent-Length: {len(str(i)) + 300}\r\n{i}{'x' * 300}\r\n"
    (tmp_path / "w").write_text("".join(map(record, range(400))), newline="")
    (tmp_path / "f").write_text("".join(f">k{i}\n{'ACGT' * 50}\n" for i in range(400)))
    (tmp_path / "t").write_text("".join(f"<DOC><DOCNO>{i}</DOCNO>{'x ' * 100}</DOC>\n" for i in range(400)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        for reader, name, key in ((documents.warc, "w", "w-{}"), (documents.fasta, "f", ">k{}"), (documents.trec, "t", "{}")):
            found = reader(spark, str(tmp_path / name))
            assert found.rdd.getNumPartitions() > 4
            assert sorted(r.primary_key for r in found.collect()) == sorted(key.format(i) for i in range(400))
        assert {len(r.contents) for r in documents.warc(spark, str(tmp_path / "w")).collect()} == {301, 302, 303}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_custom_tags_and_html(spark, tmp_path):
    (tmp_path / "a.html").write_text("<html lang='en'><title>T</title>x</html><html><title>U</title></html><html>open")
    assert [k for k, _ in _keys(documents.html(spark, str(tmp_path)))] == ["T", "U"]


def test_warc(spark, tmp_path):
    record = lambda head, body: f"WARC/1.0\r\n{head}Content-Length: {len(body)}\r\n{body}\r\n"
    (tmp_path / "w").write_text(record("", "skip me") + record("WARC-TREC-ID: w-13\r\n", "\nHTTP/1.1") + record("WARC-TREC-ID: w-27\r\n", "\nHTTP/1.1 200 OK"), newline="")
    assert _keys(documents.warc(spark, str(tmp_path / "w"))) == [("w-13", "\nHTTP/1.1"), ("w-27", "\nHTTP/1.1 200 OK")]


def test_fasta(spark, tmp_path):
    (tmp_path / "f").write_text(">one\nACGT\nAC\n>two x\nGG\n")
    assert _keys(documents.fasta(spark, str(tmp_path / "f"))) == [(">one", ">one\nACGT\nAC"), (">two x", ">two x\nGG")]


def test_sparse_json(spark, tmp_path):
    lines = [{"id": "0", "vector": {"the": 94, "zero": 0, "big": 5000}}, {"vector": {"a": 1}}]
    (tmp_path / "s.json").write_text("\n".join(map(json.dumps, lines)))
    assert sorted(tuple(r) for r in documents.sparse_json(spark, str(tmp_path)).collect()) == [("0", "big", 1024), ("0", "the", 94), ("AnonymousDocument", "a", 1)]


def test_ciff_round_trip(spark, tmp_path):
    data = ciff.encode([("a", [(0, 1), (2, 3)]), ("b", [(1, 2000)])], [("x", 4), ("y", 5), ("z", 6)], "test")
    (tmp_path / "c.ciff").write_bytes(data)
    rows = ciff.read(spark, str(tmp_path / "c.ciff"))
    assert sorted(tuple(r) for r in ciff.postings(rows).collect()) == [("a", 1, 1), ("a", 3, 3), ("b", 2, 1024)]
    assert sorted(tuple(r) for r in ciff.documents(rows).collect()) == [(1, "x", 4), (2, "y", 5), (3, "z", 6)]
    assert ciff.header(data)["description"] == "test" and ciff.header(data)["average_doclength"] == 5.0 and ciff.zigzag(3) == -2


def test_topics():
    news = "<top>\n<num> Number: 698\n<title> literacy rates Africa\n<desc> Description:\nwhat\n</top>\n<top><num>700<title>gasoline tax, u.s.</top>"
    assert tables.topics_of(news, "t") == [("698", "literacy rates africa"), ("700", "gasoline tax u s")]
    assert tables.topics_of("<topic number='51' type='x'><query>Horse Hooves</query><description>d</description></topic>") == [("51", "horse hooves")]


def test_query_and_judgement_files(spark, tmp_path):
    (tmp_path / "q").write_text("1 one two  \n\n2:three\n")
    assert [tuple(r) for r in tables.query_file(spark, str(tmp_path / "q")).collect()] == [("1", "one two"), ("2", "three")]
    (tmp_path / "r").write_text("PRICE 0 a 3.5\n1 0 a 1\nshort\n1  0  b 0\n")
    assert tables.qrels(spark, str(tmp_path / "r")).count() == 2 and tables.prices(spark, str(tmp_path / "r")).first().price == 3.5
    (tmp_path / "k").write_text("1 20\n")
    assert tuple(tables.known_scores(spark, str(tmp_path / "k")).first()) == ("1", 20)


def test_wide_tables(spark):
    wide = spark.createDataFrame([("a", 1, 0), ("b", 2, 1)], "doc_id string, q1 int, q2 int")
    assert sorted((r.query_id, r.doc_id, r.score) for r in tables.assessments(wide).collect()) == [("q1", "a", 1.0), ("q1", "b", 0.0), ("q2", "a", 0.0), ("q2", "b", 1.0)]


def test_dense_ids(spark):
    df = index.dense_ids(spark.range(1000).select(F.format_string("k%04d", F.col("id")).alias("key")).repartition(7), "key")
    assert [(r.key, r.doc_id) for r in df.orderBy("key").collect()] == [(f"k{i:04d}", i + 1) for i in range(1000)]


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "docs").write_text(TREC)
    (tmp_path / "queries").write_text("7 five two\n")
    cli.main(["index", str(tmp_path / "docs"), str(tmp_path / "index")])
    cli.main(["search", str(tmp_path / "index"), str(tmp_path / "queries"), str(tmp_path / "run"), "-k", "3"])
    lines = sorted(r.value for r in spark.read.text(str(tmp_path / "run")).collect())
    assert len(lines) == 3 and any(x.startswith("7 Q0 d9 1 ") for x in lines)
    (tmp_path / "qrels").write_text("PRICE 0 d9 2\nPRICE 0 d10 1\n7 0 d10 1\n")
    cli.main(["evaluate", str(tmp_path / "qrels"), str(tmp_path / "run"), "--t-test", "--spearman", "--per-query"])
    assert "bp_ndcg" in capsys.readouterr().out
    for to in ("human", "dictionary", "forward", "binary"):
        cli.main(["convert", str(tmp_path / "index"), str(tmp_path / to), "--to", to])
    assert spark.read.text(str(tmp_path / "dictionary")).count() > 10


def test_binary_dump(spark, tmp_path):
    impacts = spark.createDataFrame([("a", 1, 5), ("a", 3, 5), ("a", 2, 9)], "term string, doc_id long, impact int")
    rows = sinks.dumped(index.segments(impacts)).orderBy("impact", ascending=False).collect()
    (tmp_path / "d").write_bytes(b"".join(bytes(r.data) for r in rows))
    assert [r.ids for r in documents.postings_dump(spark, str(tmp_path / "d")).collect()] == [[1], [0, 2]]


def test_lists_are_stored_by_ranges(spark):
    """A term of all documents is many rows; gaps go on from range to range."""
    posts = spark.range(1, 101).select(F.lit("all").alias("term"), (F.col("id") * F.col("id")).alias("doc_id"), F.lit(1).alias("tf"))
    cut = index.segments(posts.withColumnRenamed("tf", "impact"), 1000).orderBy("chunk").collect()
    assert len(cut) == 11 and [d for r in cut for d in r.doc_ids] == [i * i for i in range(1, 101)]
    gaps = index.gaps(posts, 1000)
    assert [r.gap for r in gaps.orderBy("doc_id").collect()] == [2, *(2 * i + 1 for i in range(1, 100))]
    back = index.ungapped(gaps.withColumnRenamed("doc_id", "place"), 1000)
    assert sorted(r.doc_id for r in back.collect()) == [i * i for i in range(1, 101)]
    assert "".join(r.listed for r in index.human(posts, 1000).orderBy("chunk").collect()) == "".join(f"<{i * i},1>" for i in range(1, 101))


def test_engine(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"{i} {' '.join(TEN[:i])}") for i in range(1, 11)], "doc_id long, text string")
    engine = Engine(spark).build(docs).top(3)
    assert engine.search("q five two") == [("q", 9, 1, 807), ("q", 10, 2, 787), ("q", 6, 3, 264)] and engine.statistics.queries == 1
    engine.index.write(str(tmp_path / "i"))
    again = Engine(spark, mode="u8").load(str(tmp_path / "i")).top(3)
    assert [r[3] for r in again.search("q five two")] == [248, 242, 81]
    assert len(again.limit(percent_of_documents=40).search("q five two")) == 3
    with pytest.raises(ValueError):
        engine.top(0)
    with pytest.raises(RuntimeError):
        Engine(spark).search("x")


def test_queries_are_folded_as_the_index(spark):
    docs = spark.createDataFrame([(1, "un café noir"), (2, "½ हिन्दी"), (3, "motoring caresses"), (4, "other words")], "doc_id long, text string")
    engine = Engine(spark).build(docs, mode="full")
    found = lambda q: [r[1] for r in engine.search(q)]
    assert found("q café") == found("q CAFE") == [1] and found("q 12") == found("q ½") == [2] and found("q हिन्दी") == [2]
    stemmed = Engine(spark).build(docs, stem=True)
    assert [r[1] for r in stemmed.search("q motor")] == [r[1] for r in stemmed.search("q motoring")] == [3]


def test_a_query_reads_its_buckets_only(spark, tmp_path):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * 7 + j) % 300}" for j in range(20))) for i in range(200)], "doc_id long, text string")
    engine = Engine(spark).build(docs, str(tmp_path / "i")).top(5)
    terms = engine.terms(spark.createDataFrame([("q", "w1")], "query_id string, query string"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    try:
        plan = search.search(engine.index, terms, 5)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    scan = next(line for line in plan.split("\n") if "FileScan" in line and "bucket" in line)
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ (IN|=)", scan) and "PushedFilters: [In(term, [1,w])" in scan
    assert engine.index.buckets == 4 and engine.index.vocabulary.count() == 301  # w and the numbers
    assert sorted(engine.search("q w1 w2")) == sorted(Engine(spark).load(str(tmp_path / "i")).top(5).search("q w1 w2"))


def test_runs_and_statistics_files(spark, tmp_path, capsys, monkeypatch):
    docs = spark.createDataFrame([(i, f"{i} {' '.join(TEN[:i])}", f"d{i}") for i in range(1, 11)], "doc_id long, text string, primary_key string")
    engine = Engine(spark).build(docs, str(tmp_path / "i")).top(2).limit(absolute=4)
    engine.run_to(spark.createDataFrame([("7", "five two")], "query_id string, query string"), str(tmp_path / "run"), str(tmp_path / "stats"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "run")).collect())[1].startswith("7 Q0 d9 1 564 ")
    line = spark.read.text(str(tmp_path / "stats")).first().value
    assert line.startswith("<id>7</id><query>five two</query><postings>4</postings><time_ns>") and engine.statistics.postings == 4 and engine.statistics.mean_seconds > 0
    docs.select("doc_id", "primary_key").write.parquet(str(tmp_path / "i" / "keys"))
    monkeypatch.setattr("sys.stdin", io.StringIO("8 one\n\n"))
    cli.main(["search", str(tmp_path / "i"), "-", "-"])
    assert "8 Q0 d10 1 " in capsys.readouterr().out


def test_index_about_some_terms(spark, tmp_path):
    (tmp_path / "docs").write_text(TREC)
    (tmp_path / "topics").write_text("7 five Two\n")
    cli.main(["index", str(tmp_path / "docs"), str(tmp_path / "index"), "--about", str(tmp_path / "topics"), "--full"])
    found = index.Index.read(spark, str(tmp_path / "index"))
    assert sorted(r.term for r in found.vocabulary.collect()) == ["five", "two"] and found.mode == "full"


def test_evaluation_in_file_order(spark):
    lines = "1 Q0 b 2 1 r\n1 Q0 a 1 2 r\n2 Q0 a 1 1 r\n1 Q0 c 1 9 r\n"
    runs = tables.runs_in(spark.createDataFrame([(x,) for x in lines.split("\n")], "value string").coalesce(1))
    rels = spark.createDataFrame([("1", "b", 1.0), ("2", "a", 1.0)], "query_id string, doc_id string, score double")
    place = lambda **o: {(r.query_id, r.doc_id): r.pos for r in evaluation.judged(runs, rels, **o).collect()}
    assert place(file_order=True) == {("1", "b"): 1, ("1", "a"): 2, ("2", "a"): 1}
    assert place() == {("1", "a"): 1, ("1", "c"): 2, ("1", "b"): 3, ("2", "a"): 1}


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"{' '.join(TEN[:i])} é") for i in range(1, 11)], "doc_id long, text string").repartition(5)
    docs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    ingest(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    got, want = current(spark, str(tmp_path / "out")), index.build(docs)
    assert sorted(got.impacts.collect()) == sorted(want.impacts.collect())
