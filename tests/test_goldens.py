"""Fixed expected values: tokenizer, stemmer, metrics, gaps, checksums."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from impactspark.functions import bits, checksums, codecs, text
from impactspark.functions.text import fold, indexed, kmers, porter, query_id, query_text, query_tokens, segment
from impactspark.operators import evaluation, index, search, statistics

TEN = "ten nine eight seven six five four three two one".split()


@pytest.fixture(scope="module")
def ten(spark):
    """Ten documents: the first i words, and the number of the document, which is indexed as well."""
    return spark.createDataFrame([(i, f"{i} {' '.join(TEN[:i])}") for i in range(1, 11)], "doc_id long, text string")


@pytest.fixture(scope="module")
def built(ten):
    found = index.build(ten)
    return index.Index(found.postings.cache(), found.lengths.cache(), found.impacts.cache())


def test_segments_before_folding():
    text = "abc123 αβγ①②③ aβc1②3 αbγ①2③ ab℃½3 αβγ½③"
    assert [w for _, w in segment(text)] == ["abc", "123", "αβγ", "123", "aβc", "123", "αbγ", "123", "ab", "℃", "123", "αβγ", "123"]


@pytest.mark.parametrize("text, want", [("Example", ["example"]), ("Example QUERY", ["example", "query"]), ("À", ["a"]), ("我", ["我"]), ("𩸽", ["𩸽"]), ("12345", ["12345"]), ("", []), ("½", ["12"]), ("हिन्दी", ["हिन", "दी"]), ("x" * 2000, ["x" * 1024]), ("é" * 600 + "我" * 400, ["e" * 600 + "我" * 141])])
def test_query_words(text, want):
    assert query_tokens(text) == want


def test_folding():
    assert [fold(c) for c in ("½", "é", "ß", "ﬁ", "Ⅸ", "œ")] == ["12", "e", "ss", "fi", "ix", "œ"]


def test_markup_is_not_indexed():
    assert indexed("<a href='x>y'>one</a><!-- two --><![CDATA[three]]><?four?> five") == ["one", "five"]


@pytest.mark.parametrize("word, stem", [("sized", "size"), ("hopping", "hop"), ("happy", "happi"), ("sky", "sky"), ("relational", "relat"), ("vietnamization", "vietnam"), ("controll", "control"), ("roll", "roll"), ("caresses", "caress"), ("ponies", "poni"), ("agreed", "agre"), ("falling", "fall"), ("filing", "file"), ("electriciti", "electr"), ("adoption", "adopt"), ("rate", "rate"), ("cease", "ceas")])
def test_porter(word, stem):
    assert porter(word) == stem


def test_kmers(spark):
    df = spark.createDataFrame([("G GTC\nTTA TAxGxxGATTCAx",)], "s string").select(kmers(F.col("s"), 5).alias("k"))
    assert df.first().k == "ggtct gtctt tctta cttat ttata gattc attca".split()


def test_query_ids(spark):
    df = spark.createDataFrame([("7 apple pie",), ("alone",), ('a:"b',)], "q string").select(query_id(F.col("q")).alias("i"), query_text(F.col("q")).alias("t"))
    assert [tuple(r) for r in df.collect()] == [("7", "apple pie"), ("", "alone"), ("a", "b")]


def test_ten_postings(built):
    found = {r.term: sorted(r.ids) for r in built.postings.groupBy("term").agg(F.collect_list("doc_id").alias("ids")).collect()}
    assert all(found[w] == list(range(i, 11)) for i, w in enumerate(TEN, 1)) and found["7"] == [7]


def test_ten_bounds_and_impacts(built):
    low = index.bounds(index.scored(built.postings, built.lengths)).first()
    assert low.low == 0.0 and low.high == pytest.approx(2.650226085598925)
    impacts = {(r.term, r.doc_id): r.impact for r in built.impacts.collect()}
    assert [impacts["nine", d] for d in range(2, 11)] == [46, 44, 43, 42, 41, 39, 38, 37, 36]
    assert [impacts["five", d] for d in range(6, 11)] == [264, 257, 250, 243, 237]
    assert impacts["one", 10] == 786 and impacts["1", 1] == 1024


@pytest.mark.parametrize("text, options, want", [
    ("five two", {}, [(9, 807), (10, 787), (6, 264)]),
    ("five two", {"absolute": 4}, [(9, 564), (10, 550), (6, 264)]),
    ("five two", {"mode": "u8"}, [(9, 248), (10, 242), (6, 81)]),
    ("two two nine zebra", {}, [(9, 1165), (10, 1136), (2, 46)]),
])
def test_ten_search(spark, built, text, options, want):
    terms = search.query_terms(spark.createDataFrame([("q", text)], "query_id string, query string"))
    found = search.search(built.impacts, terms, 3, **options).orderBy("rank").collect()
    assert [(r.doc_id, r.rsv) for r in found] == want


def test_no_budget_is_exhaustive(spark, built):
    terms = search.query_terms(spark.createDataFrame([("q", "five two nine")], "query_id string, query string"))
    every = search.search(built.impacts, terms, 10).collect()
    assert sorted(every) == sorted(search.search(built.impacts, terms, 10, absolute=10**6).collect()) == sorted(search.search(built.impacts, terms, 10, relative=1.0).collect())


def _oracle(postings, k, bound):
    """The heap's rule over postings in reading order."""
    sums, crossed = {}, set()
    for doc, value in postings:
        sums[doc] = sums.get(doc, 0) + value
        if bound > 1 and sums[doc] >= bound:
            crossed.add(doc)
            if len(crossed) == k:
                return sorted(((d, sums[d]) for d in crossed), key=lambda x: (-x[1], -x[0]))
    return sorted(sums.items(), key=lambda x: (-x[1], -x[0]))[:k]


def test_oracle_stop(spark, built):
    rng = np.random.default_rng(3)
    impacts, terms, known, want = [], [], [], {}
    for q in range(40):
        parts = []
        for t in range(int(rng.integers(1, 5))):
            for i in rng.choice(30, int(rng.integers(1, 4)), replace=False) + 1:
                docs = sorted(set(rng.integers(1, 9, int(rng.integers(1, 6))).tolist()))
                parts.append((int(i), len(docs), f"q{q}t{t}", docs))
        impacts += [(t, d, i) for i, _, t, docs in parts for d in docs]
        terms += [(f"q{q}", t, 1) for t in {p[2] for p in parts}]
        bound = int(rng.integers(2, 40))
        known.append((f"q{q}", bound))
        want[f"q{q}"] = _oracle([(d, i) for i, _, _, docs in sorted(parts, key=lambda p: (-p[0], p[1], p[2])) for d in docs], 3, bound)
    frame = spark.createDataFrame(impacts, "term string, doc_id long, impact int")
    found = search.search_oracle(frame, spark.createDataFrame(terms, "query_id string, term string, qf int"), spark.createDataFrame(known, "query_id string, bound int"), 3)
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.doc_id, r.rsv))
    assert got == want


def _judged(spark, lists, qrels, prices=None):
    runs = spark.createDataFrame([("r", q, d, i) for q, docs in lists.items() for i, d in enumerate(docs, 1)], "run_id string, query_id string, doc_id string, rank int")
    rels = spark.createDataFrame([(q, d, float(s)) for q, ds in qrels.items() for d, s in ds.items()], "query_id string, doc_id string, score double")
    cost = spark.createDataFrame(list(prices.items()), "doc_id string, price double") if prices else None
    return evaluation.judged(runs, rels, cost), rels, cost


def test_plain_measures(spark):
    rows, _, _ = _judged(spark, {"1": ["0026", "0139", "0161", "0169", "0030"]}, {"1": {"0026": 0, "0139": 1, "0169": 0, "0030": 0}})
    m = evaluation.measures(rows).first()
    assert (m.p, m.r, m.ap, m.rr, m.esl, m.relevant_returned) == (pytest.approx(0.2), 1, 0.5, 0.5, 1, 1) and m.f1 == pytest.approx(0.4 / 1.2)


def test_rank_biased_precision(spark):
    docs = [f"d{i}" for i in range(1, 21)]
    rows, _, _ = _judged(spark, {"1": docs}, {"1": {f"d{i}": 1 for i in (1, 2, 6, 11, 17)}})
    assert evaluation.measures(rows).first().rbp == pytest.approx(0.1881, abs=5e-4)


def test_price_measures(spark):
    prices = dict(zip("one two three four five six seven eight nine ten".split(), map(float, range(1, 11)), strict=True))
    qrels = {"1": {"one": 0, "two": 1, "three": 0, "four": 0, "five": 0}, "2": {"six": 0, "seven": 1, "eight": 1, "nine": 1, "ten": 0}}
    one = lambda lists, **o: {r.query_id: r for r in evaluation.price_measures(*_judged(spark, lists, qrels, prices), **o).collect()}
    bp = one({"1": ["one", "three", "two", "four", "five"], "2": ["ten", "nine", "eight", "seven", "six"]}, k=2)
    assert bp["1"].bp == pytest.approx(2 / 6) and bp["2"].bp == pytest.approx(7 / 19) and bp["1"].bp2 == 0 and bp["2"].bp2 == pytest.approx(15 / 27)
    five = one({"1": ["one", "two", "three", "four", "five"], "2": ["six", "seven", "eight", "nine", "ten"]}, depth=5)
    assert five["1"].sp == 0 and five["2"].sp == pytest.approx(2 / 3)
    assert five["1"].pb_ndcg == pytest.approx(0.63093, abs=1e-5) and five["2"].pb_ndcg == pytest.approx(0.66635, abs=1e-5)
    assert five["1"].bp_ndcg == pytest.approx(0.63093, abs=1e-5) and five["2"].bp_ndcg == pytest.approx(0.723047, abs=1e-6)
    cheap = one({"1": ["one", "two", "three", "four", "five"], "2": ["six", "seven", "eight", "ten", "eleven"]}, depth=5)
    assert cheap["1"].cheapest_p == pytest.approx(1 / 5) and cheap["2"].cheapest_p == pytest.approx(2 / 5)


def test_statistics(spark):
    df = spark.createDataFrame([(x,) for x in (1, 1, 2, 3, 3, 4, 5, 5, 5)], "x int")
    assert sorted(r[0] for r in df.select(statistics.fractional_rank("x")).collect()) == [1.5, 1.5, 3, 4.5, 4.5, 6, 8, 8, 8]
    assert statistics.t_test([1, 2, 3], [1, 2, 3]) == 1.0 and statistics.t_test([1.0], [2.0]) == 1.0
    assert statistics.student_cdf(2.0, 10) == pytest.approx(0.963306, abs=1e-6) and statistics.student_cdf(1.96, 1e6) == pytest.approx(0.975, abs=1e-4)


def test_bm25_golden(spark):
    """Five documents, two with the term; 1.635 with the mean over four, the published expectation."""
    row = spark.range(1).select(index.bm25(F.lit(12), F.lit(2), F.lit(40.0), F.lit(5), F.lit(250 / 4)).alias("s")).first()
    assert row.s == pytest.approx(1.635, abs=2e-3)


def test_t_tests(spark):
    rows = [(r, f"q{i}", m) for r, values in {"a": (0.1, 0.5, 0.3, 0.9), "b": (0.2, 0.4, 0.6, 0.3), "c": (0.2, 0.6, 0.4, 1.0), "d": (0.1, 0.5, 0.3, 0.9)}.items() for i, m in enumerate(values)]
    per = spark.createDataFrame(rows, "run_id string, query_id string, ap double").withColumn("rr", F.round(F.col("ap") * 8))
    found = {(r.measure, r.run_a, r.run_b): r for r in statistics.t_test_matrices(per, ["ap", "rr"]).collect()}
    assert found["ap", "a", "d"].p == 1.0 and found["ap", "a", "d"].t is None
    assert found["ap", "a", "c"].p == pytest.approx(0, abs=1e-9) and found["ap", "a", "b"].p == pytest.approx(statistics.t_test([0.1, 0.5, 0.3, 0.9], [0.2, 0.4, 0.6, 0.3], 1))
    assert statistics.p_value(4, 0.5, 0.0) == 0.0 and statistics.t_test([2, 3, 4], [1, 2, 3]) == 0.0
    assert statistics.t_test_matrix(per, "ap", 2).where("run_a = 'a' and run_b = 'b'").first().p == pytest.approx(2 * found["ap", "a", "b"].p)


def test_long_tokens_are_cut(spark):
    df = spark.createDataFrame([(1, "é" * 600 + " " + "x" * 1024 + " " + "我" * 342)], "doc_id long, text string")
    assert sorted((len(r.term), len(r.term.encode())) for r in index.token_rows(df).collect()) == [(341, 1023), (512, 1024), (1024, 1024)]
    assert sorted(len(r.term.encode()) for r in index.token_rows(df, "full").collect()) == [600, 1023, 1024]


def test_median_sketch(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("length"), F.col("id").cast("double").alias("value"))
    both = [{r.length: r.median for r in statistics.by_length(rows, exact).collect()} for exact in (True, False)]
    assert all(abs(both[0][k] - both[1][k]) <= 3 for k in both[0])


def test_utf8(spark):
    row = spark.createDataFrame([("aé我𩸽", [97, 233, 25105, 171581], bytearray(b"\xff"))], "t string, c array<int>, b binary")
    got = row.select(text.to_codepoints(F.col("t")), text.from_codepoints(F.col("c")), text.is_utf8(F.col("b")), text.is_utf8(F.encode("t", "utf-8")), F.transform("c", text.utf8_bytes)).first()
    assert tuple(got) == ([97, 233, 25105, 171581], "aé我𩸽", False, True, [1, 2, 3, 4])


def test_gaps():
    v = np.array([4, 5, 7, 9, 12])
    assert codecs.gaps(v).tolist() == [4, 1, 2, 2, 3] and codecs.gaps(v, 2).tolist() == [4, 5, 3, 4, 5]
    assert codecs.ungaps(codecs.gaps(v, 2), 2).tolist() == v.tolist()


@pytest.mark.parametrize("name", sorted(codecs.CODECS))
def test_codecs(name):
    there, back = codecs.CODECS[name]
    rng = np.random.default_rng(5)
    lists = [np.full(1024, (1 << b) - 1, np.int64) for b in range(33)] + [np.zeros(n, np.int64) for n in (0, 1, 241)] + [rng.integers(0, 1 << int(b), int(n)) for b, n in zip(rng.integers(1, 33, 40), rng.integers(0, 90, 40), strict=True)]
    assert all(np.array_equal(back(there(v), len(v)), v) for v in lists)


def test_codecs_of_rising_values():
    rng = np.random.default_rng(6)
    for there, back in codecs.RISING.values():
        for n in (0, 1, 3, 4, 500):
            v = np.cumsum(rng.integers(1, 90, n))
            assert np.array_equal(back(there(v), n), v)


def test_codecs_do_what_they_are_named_for():
    """Bytes by hand, and no codec under two names but the published twins."""
    assert codecs.lyck_encode(np.array([1, 2, 3, 0, 1, 2, 3, 0, 9, 10, 11, 12, 200, 3, 60000])) == bytes([0, 0b01101100, 0b01101100][:1]) + (0b0110110001101100).to_bytes(2, "little") + bytes([1]) + (0x9ABC).to_bytes(2, "little") + bytes([2]) + ((200 << 8) | 3).to_bytes(2, "little") + bytes([3]) + (60000).to_bytes(2, "little")
    gamma, delta = codecs.CODECS["elias_gamma_bitwise"][0], codecs.CODECS["elias_delta_bitwise"][0]
    assert gamma(np.array([0, 1, 4])) == bytes([0b10100010, 0b10000000]) and delta(np.array([0, 1, 16])) == bytes([0b10100001, 0b01000100])
    relative = codecs.Relative(32, (1, 2, 3, 4, 5, 6, 7, 10, 15, 30))
    assert relative.encode(np.ones(30, np.int64)) == (((1 << 30) - 1) << 2).to_bytes(4, "little")
    assert relative.encode(np.array([1 << 29])) == (1 << 31 | 3).to_bytes(4, "little")
    # Nine bits left behind three sevens: the next word's selector is there and its fields take all 32 bits.
    carried = codecs.Relative(32, (1, 2, 3, 4, 5, 6, 7, 8, 10, 15, 16, 28), True)
    words = carried.encode(np.array([1 << 27, 1 << 27]))
    assert len(words) == 8 and int.from_bytes(words[:4], "little") == (1 << 29 | 3 | 3 << 30) and int.from_bytes(words[4:], "little") == 1 << 27
    rng = np.random.default_rng(1)
    v = rng.integers(0, 40, 500)
    sizes = {n: there(v) for n, (there, _) in codecs.CODECS.items()}
    assert len({sizes[n] for n in ("simple_9", "relative_10", "carryover_12", "carry_8b", "simple_8b", "lyck_16", "bitpack_32", "qmx", "qmx_improved")}) == 9
    assert len(sizes["carryover_12"]) <= len(sizes["simple_9"]) and len(sizes["qmx_improved"]) < len(sizes["qmx"])


def test_checksums():
    assert [checksums.fletcher(x) for x in (b"", b"a", b"z")] == [0, 0x6161, 0x7A7A]
    assert checksums.pearson(b"abc", 8, list(range(256))) == ord("a") ^ ord("b") ^ ord("c")
    assert checksums.pearson(b"abc", 32) >> 16 != checksums.pearson(b"abc", 32) & 0xFFFF and sorted(checksums.permutation().tolist()) == list(range(256))


def test_bits(spark):
    row = spark.range(1).select(F.lit(0b101100).cast("long").alias("x"))
    got = row.select(bits.first_set(F.col("x")), bits.floor_log2(F.col("x")), bits.ceiling_log2(F.col("x")), bits.nth_set(F.col("x"), 1), bits.get_bit(F.col("x"), 5), bits.set_bit(F.col("x"), 63), bits.unset_bit(F.col("x"), 2)).first()
    assert tuple(got) == (2, 5, 6, 3, 1, 0b101100 - (1 << 63), 0b101000)
