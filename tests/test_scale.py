"""What keeps the queries' cost in proportion to their input: batches against lists, exchanges and partitions counted."""

import re

import numpy as np
import pytest
from conftest import DATA, rows_of

from impactspark.functions import codecs
from impactspark.operators import index as build
from impactspark.plans.registry import QUERIES


@pytest.fixture(scope="module")
def some_lists():
    rng = np.random.default_rng(11)
    found = [np.array([x], np.int64) for x in (0, 1, 127, 128, 2**16 - 1, 2**16, 2**28 - 1, 2**28, 2**30, 2**32 - 1)]
    for i in range(150):
        v = rng.integers(0, int(rng.choice([2, 4, 20, 300, 70_000, 2**29, 2**32])), int(rng.integers(1, 500 if i % 7 == 0 else 30)))
        found.append(np.where(rng.random(len(v)) < 0.9, v % 5, v) if i % 3 == 0 else v)
    return [*found, np.zeros(600, np.int64), np.ones(5000, np.int64)]


@pytest.mark.parametrize("name", codecs.CODECS)
def test_batches_are_lists(name, some_lists):
    from impactspark.functions.codec_batches import BATCHES

    there, back = BATCHES[name]
    v, n = np.concatenate(some_lists), np.array([len(x) for x in some_lists])
    data, sizes = there(v, n)
    want = [codecs.CODECS[name][0](x) for x in some_lists]
    assert sizes.tolist() == [len(x) for x in want]
    assert data.tobytes() == b"".join(want)
    assert np.array_equal(back(data, sizes, n), v)


def test_tallies(monkeypatch, some_lists):
    """Lists are counted as often as they stand for, empty ones and damaged ones too, whatever is coded together."""
    from impactspark.functions import codec_batches

    lists = [*some_lists[:20], np.zeros(0, np.int64), *some_lists[20:], np.zeros(0, np.int64)]
    n, times = np.array([len(x) for x in lists]), np.arange(1, len(lists) + 1)
    there, back = codec_batches.BATCHES["variable_byte"]
    monkeypatch.setitem(codec_batches.BATCHES, "variable_byte", (there, lambda d, s, n: back(d, s, n) + (np.arange(n.sum()) == 0)))
    for together in (100, 1 << 16):
        monkeypatch.setattr(codec_batches, "TOGETHER", together)
        found = {name: rest for name, *rest in codec_batches.tallies(np.concatenate(lists), n, times)}
        for name, (encode, _) in codecs.CODECS.items():
            assert found[name][:2] == [times.sum(), sum(len(encode(x)) * t for x, t in zip(lists, times.tolist(), strict=True))]
            assert (found[name][2] > 0) == (name == "variable_byte")


def test_roundtrips_of_equal_lists(spark):
    df = spark.createDataFrame([([1, 2, 3],), ([1, 2, 3],), ([70_000],)], "gaps array<long>")
    found = {r.codec: (r.lists, r.bytes, r.failures) for r in codecs.roundtrips(df, "gaps").collect()}
    assert set(found) == set(codecs.CODECS)
    assert found["none"] == (3, 28, 0) and found["variable_byte"] == (3, 9, 0)


@pytest.fixture(scope="module")
def posts(spark):
    """Postings of some terms with holes and over several ranges of 8 ids."""
    rows = [(t, d) for t, step in (("a", 1), ("b", 3), ("c", 17)) for d in range(step - 1, 60, step) if not (t == "a" and 16 <= d < 33)]
    return spark.createDataFrame(rows, "term string, doc_id long"), rows


def _gap_rows(rows):
    last, out = {}, []
    for t, d in rows:
        out.append((t, d, d - last.get(t, -1)))
        last[t] = d
    return sorted(out)


@pytest.mark.parametrize("span, one", [(8, False), (1 << 20, False), (1 << 20, True)])
def test_gaps_over_ranges(posts, span, one):
    df, rows = posts
    again = df.unionByName(df.where("doc_id % 5 = 2"))  # postings that come again count once
    found = build.ranged_gaps(again, span, one)
    assert sorted((r.term, r.doc_id, r.gap) for r in found.collect()) == _gap_rows(rows)
    back = build.ungapped(found.withColumnRenamed("doc_id", "place"), span, one)
    assert sorted((r.term, r.doc_id) for r in back.collect()) == sorted(rows)
    plain = build.ungapped(build.gaps(again, span, one).withColumnRenamed("doc_id", "place"), span, one)
    assert sorted((r.term, r.doc_id) for r in plain.collect()) == sorted(rows)
    chunks = {}
    for t, d, g in _gap_rows(rows):
        chunks.setdefault((t, d // span), []).append(g)
    assert {(r.term, r.chunk): r.gaps for r in build.lists(again, span, one).collect()} == chunks


def test_ids_in_one_range(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "doc_id long")
    assert build.one_range(ids(0, 7), 8) and build.one_range(ids(), 8) and not build.one_range(ids(7, 8), 8)


def exchanges(df):
    """Exchanges of the plan before it runs."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(r"(?<!Broadcast)Exchange (?!SinglePartition)", plan))


def test_gap_encode_deals_rows_once(spark):
    """No index is made for it, and where all ids are in one range its rows are dealt once."""
    assert exchanges(QUERIES["gap_encode"](spark, f"{DATA}/sf0.001")) == 1


def test_gap_decode_deals_rows_once(spark):
    assert exchanges(QUERIES["gap_decode"](spark, f"{DATA}/sf0.001")) == 1


@pytest.fixture(scope="module")
def odd_docs(spark):
    texts = ["one two two", None, "", "été ÉTÉ <b>x</b> ½3 ﬁ", "a" * 1500 + " " + "a" * 1400, "É e ß1 我 x́", "<a href='x>y'>one</a>two <!-- z", "two " * 1100]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


@pytest.mark.parametrize("mode", ["plain", "full"])
def test_counted_is_postings_and_lengths(odd_docs, mode):
    """Counted where the texts are: the postings and lengths that are counted from rows, empty texts too."""
    found = build.counted(odd_docs, mode)
    rows = build.token_rows(odd_docs, mode)
    assert rows_of(found.where("term is not null").select("term", "doc_id", "tf")) == rows_of(build.postings(rows))
    assert rows_of(found.select("doc_id", "length").distinct()) == rows_of(build.doc_lengths(odd_docs, rows))


def test_bm25_shuffles_no_postings(spark, odd_docs):
    """Postings with their lengths and broadcast frequencies are scored where they are, and alike if rare terms' frequencies
    are not broadcast."""
    posts = build.postings(build.token_rows(odd_docs)).localCheckpoint()
    counts, lengths = build.counted(odd_docs).where("term is not null").localCheckpoint(), build.doc_lengths(odd_docs).localCheckpoint()
    df = build.document_frequency(posts).localCheckpoint()
    want = rows_of(build.scored(posts, lengths))
    found = build.scored(counts, lengths, frequencies=df)
    assert rows_of(found) == want
    assert exchanges(found.drop("score")) == 0
    both = build._with_df(counts, df, 2)
    assert build._least_frequent(df, 2) > 1 and rows_of(both.select("term", "doc_id", "df")) == rows_of(build._with_df(posts, None).select("term", "doc_id", "df"))


@pytest.mark.parametrize("repeated", [False, True])
def test_index_of_a_folder(spark, duck, tmp_path, repeated):
    """The same as the SQL where ids repeat; frequencies and bounds are stored once and no impacts are."""
    from impactspark.plans import store
    from impactspark.plans.registry import ORACLES

    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").where("doc_id < 60")
    docs = docs.unionByName(docs.where("doc_id = 7")) if repeated else docs
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    duck.execute(f"CREATE SCHEMA IF NOT EXISTS s{repeated}")
    duck.execute(f"CREATE OR REPLACE VIEW s{repeated}.documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    duck.execute(f"SET schema = 's{repeated}'")
    try:
        for name in ("postings", "document_frequency", "bm25_bounds", "bm25_scores", "impacts"):
            sql = duck.execute(ORACLES[name])
            names = [d[0] for d in sql.description]
            want = sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in sql.fetchall()), key=repr)
            assert sorted((tuple(r[n] for n in names) for r in QUERIES[name](spark, str(tmp_path)).collect()), key=repr) == want, name
    finally:
        duck.execute("SET schema = 'main'")
    made = {key[2].split()[1] for key in store._built if key[1] == str(tmp_path)}
    assert made == {"repeated", "counted", "frequencies", "bounds"} | ({"lengths"} if repeated else set())


def test_partitions_follow_the_stored_input(spark, posts, monkeypatch):
    """The session's at least; frames of unknown size have no more."""
    own, stored = int(spark.conf.get("spark.sql.shuffle.partitions")), spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    assert build.tasks_for(posts[0]) == build.tasks_for(stored) == own
    monkeypatch.setattr(build, "TASK_BYTES", 10_000)
    assert build.tasks_for(posts[0]) == own < build.tasks_for(stored) < 100


def test_union_deals_postings_first(spark):
    """No table of a whole file's postings before the exchange."""
    some = spark.createDataFrame([("a", 1, 1000), ("b", 1, 1)], "term string, doc_id long, tf int")
    plan = build.union_postings(some, some)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("HashAggregate") < plan.rindex("HashAggregate") < plan.index("Exchange")
    found = build.union_postings(some, some.where("term = 'a'"))
    assert rows_of(found) == rows_of(spark.createDataFrame([("a", 1, 1024), ("b", 1, 1)], "term string, doc_id long, tf int"))


def test_joined_runs(odd_docs):
    from impactspark.functions import text

    for row in odd_docs.collect():
        assert text.joined_runs(row.text or "").split("\n") == (text.indexed(row.text or "") or [""])


def test_full_tokens_leave_python_as_strings(spark, monkeypatch):
    """A slice of texts at a time, one string a text."""
    import pyarrow as pa

    from impactspark.functions import text

    monkeypatch.setattr(text, "SLICE", 3)
    given = ["Été un", None, "", "½", "x y", "z", "<i>w</i>"]
    out = text._joined.func(pa.array(given))
    assert out.to_pylist() == ["ete\nun", "", "", "12", "x\ny", "z", "w"]
    df = spark.createDataFrame([(t,) for t in given], "t string").select(text.full_tokens("t").alias("ws"))
    assert [r.ws for r in df.collect()] == [["ete", "un"], [], [], ["12"], ["x", "y"], ["z"], ["w"]]
