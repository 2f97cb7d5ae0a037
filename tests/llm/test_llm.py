"""Training-data operators: brute force, round trips, gradients, edge cases."""

import collections
import hashlib
import itertools
import math
import re
import threading
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from conftest import DATA, rows_of, rows_of_sql
from pyspark.sql import functions as F

from impactspark.llm import chat, decontaminate, lm, mixing, pii, quality, rules, simhash, toxicity, urls
from impactspark.llm import _fit, _shared
from impactspark.llm.queries import ORACLES, QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, term string, key string"
ODD = [
    (1, None, "en", "a", 0, 1, "x", "k"),
    (2, "", "en", None, None, None, None, None),
    (3, " \t\n ", None, "a", 3, 3, "y", "k"),
    (4, "one two three four five six seven eight nine ten eleven", "en", "b", 9, 1, "z", "k"),
    (5, "one two three four five six seven eight nine ten eleven", "en", "b", 9, 1, "z", "k"),
    (5, "one two three four five six seven eight nine ten eleven", "en", "b", 9, 1, "z", "k"),
    (None, "é ü ñ 𩸽 Ünïcödé", "de", "b", 9, 1, "z", "k"),
    (7, "word " * 20000, "en", "c", 100000, 1, "z", "k"),
    (8, "x" * 100000, "en", "c", 100000, 1, "z", "k"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").orderBy("doc_id").collect()]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(name, spark, duck):
    df = QUERIES[name](spark, f"{DATA}/sf0.001")
    names, want = rows_of_sql(duck, ORACLES[name])
    assert sorted(df.columns) == names and rows_of(df) == want


# -- 2: SimHash ---------------------------------------------------------------------------------------------------


def _simhash(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not ws:
        return 0
    shingles = [" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] or [" ".join(ws)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _classes(fps, bits=2):
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(parent), 2):
        if (a ^ b).bit_count() <= bits:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    return {f: find(f) for f in parent}


def test_simhash_brute_force(spark, docs):
    fps = {i: _simhash(t) for i, t in docs}
    roots = _classes(set(fps.values()))
    least = {}
    for i, f in fps.items():
        least[roots[f]] = min(least.get(roots[f], i), i)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op2_simhash_near_dedup"](spark, f"{DATA}/sf0.001").collect()}
    assert got == {i: (f"{f:016x}", least[roots[f]]) for i, f in fps.items()}


def test_one_of_each_component_stays(spark):
    """A component of most rows, repeated rows, null ids."""
    rows = [(i % 50 if i % 3 else None, "the same words in each of these rows") for i in range(300)] + [(i, f"row {i} " + " ".join(f"w{i}x{j}" for j in range(30))) for i in range(1000, 1040)] + [(1001, f"row 1001 " + " ".join(f"w1001x{j}" for j in range(30)))]
    kept = simhash.drop_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in kept) == [0, *range(1000, 1040)]


@pytest.mark.parametrize("long", [2, 32])
@pytest.mark.parametrize("bits", [1, 2])
def test_links_keep_all_components(spark, long, bits):
    """Crowded lists, chains and lone fingerprints; long=2 sends nearly all through the stars."""
    rng = np.random.default_rng(2)
    fps = {int(x) for x in rng.integers(0, 1 << 63, 40)}
    for centre in list(fps)[:4]:
        for _ in range(60):
            x = centre
            for b in rng.integers(0, 64, int(rng.integers(1, 6))):
                x ^= 1 << int(b)
            fps.add(x)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    frame = spark.createDataFrame(signed, "fp long")
    found = {r.node: r.root for r in simhash.components(simhash.links(frame, bits, long)).collect()}
    found |= {r: r for r in found.values()}
    want = _classes(fps, bits)
    groups = lambda m: sorted(sorted(k for k, v in m.items() if v == r) for r in set(m.values()) if sum(v == r for v in m.values()) > 1)
    assert groups({k & (1 << 64) - 1: v for k, v in found.items()}) == groups(want)


def test_simhash_odd(odd, none):
    rows = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_duplicates(odd).collect()}
    assert simhash.near_duplicates(odd).count() == len(ODD) and rows[1, "0" * 16] == 1 and rows[3, "0" * 16] == 1
    assert simhash.near_duplicates(none).count() == 0
    kept = [r.doc_id for r in simhash.drop_copies(odd).collect()]
    assert sorted(kept, key=repr) == sorted([1, 4, None, 7, 8], key=repr) and simhash.drop_copies(none).count() == 0


# -- 9: decontamination -------------------------------------------------------------------------------------------


def _phrases(docs, items, window=10):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = {}
    for i, (d, t) in enumerate(docs):
        ws, hit, names = cut(t), set(), set()
        for k, (item, text) in enumerate(items):
            iw = cut(text)
            n = min(window, len(iw))
            if not n:
                continue
            grams = {tuple(iw[j : j + n]) for j in range(len(iw) - n + 1)}
            for j in range(len(ws) - n + 1):
                if tuple(ws[j : j + n]) in grams:
                    hit |= set(range(j, j + n))
                    names.add(str(item))
        out[i] = (d, len(ws), len(hit), ",".join(sorted(names)))
    return sorted(out.values(), key=repr)


def test_phrases_brute_force(spark):
    rng = np.random.default_rng(4)
    words = ["a", "b", "c", "É", "é", "Dd", "e1"]
    text = lambda n: " ".join(rng.choice(words, n)) + rng.choice(["", ".", " "])
    items = [(1, "A B"), (2, "c"), (3, None), (4, " ,"), (5, text(14)), (6, text(12)), (6, text(4)), (7, "a b c É Dd")]
    docs = [(i, rng.choice(["", "-", "  "]) + text(int(rng.integers(0, 40)))) for i in range(40)] + [(100, None), (101, ""), (102, "x " + items[4][1] + " y " + items[4][1]), (102, "x " + items[4][1] + " y " + items[4][1]), (None, items[5][1].upper())]
    for window in (10, 3, 1):
        got = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), window)
        assert sorted(((r.doc_id, r.n_words, r.n_hit, ",".join(r.item_ids)) for r in got.collect()), key=repr) == _phrases(docs, items, window)


def test_phrases_odd(odd, none, spark):
    items = spark.createDataFrame([(1, "three four five six seven eight nine ten eleven twelve"), (None, None)], "item_id long, text string")
    assert decontaminate.contamination(odd, items).count() == len(ODD)
    assert decontaminate.contamination(none, items).count() == 0 and decontaminate.contamination(odd, items.limit(0)).where("contaminated").count() == 0
    near = spark.createDataFrame([(1, "two three four five six seven eight nine ten eleven")], "item_id long, text string")
    assert sorted(r.doc_id for r in decontaminate.drop_contaminated(odd, near).collect() if r.doc_id) == [1, 2, 3, 7, 8]


def test_proximity(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa")], "item bigint, text string")
    docs = spark.createDataFrame([(1, "alpha beta gamma and delta epsilon zeta eta theta iota kappa"), (2, "alpha beta"), (3, "kappa iota theta")], "doc_id bigint, text string")
    terms, words = decontaminate.item_words(items)
    postings = decontaminate.index(docs.withColumn("doc", F.col("doc_id")), terms)
    assert {r.doc for r in decontaminate.proximity(postings, words).collect()} == {1} and decontaminate.matches(postings, words).count() == 0


def _near(docs, items, window=10, slack=5, share=0.8):
    """{(doc_id, item_id): words met} by looking at every diagonal that two neighbours name, or a lone word."""
    cut = lambda t: [w.lower() for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", t) if w]
    out = {}
    for d, text in docs:
        ws = cut(text)
        for i, t in items:
            iw = cut(t)
            n = min(window, len(iw))
            named = {p - k for p in range(len(ws)) for k in range(len(iw)) if (ws[p : p + 2] == iw[k : k + 2] if k + 1 < len(iw) else False) or (ws[p] == iw[k] and (len(iw) == 1 or window == 1))}
            for at in named:
                met = [w in ws[max(0, at + k - slack) : max(0, at + k + slack + 1)] for k, w in enumerate(iw)]
                most = max(sum(met[a : a + n]) for a in range(len(iw) - n + 1))
                if most >= math.ceil(share * n):
                    out[d, str(i)] = max(out.get((d, str(i)), 0), most)
    return out


def test_near_matches_reach_the_query_and_the_pipeline(spark, tmp_path):
    rng = np.random.default_rng(9)
    words = [f"w{chr(97 + k)}" for k in range(20)]
    text = lambda n: " ".join(rng.choice(words, n))
    quoted = text(30).split()
    edits = [quoted[:k] + new + quoted[k + 1 :] for k in (4, 9, 12) for new in ([], ["other"], [quoted[k], "more"])]
    changed = " ".join("other" if k % 8 == 4 else w for k, w in enumerate(quoted))
    items = [(1, " ".join(quoted)), (2, text(12)), (3, text(5)), (4, "wa wb"), (5, "lone")]
    docs = [(k, "x y " * k + " ".join(e[:18])) for k, e in enumerate(edits)] + [(50, changed), (51, "nothing at all"), (52, "a lone word")] + [(60 + k, text(int(rng.integers(1, 60)))) for k in range(30)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for window in (10, 3, 1):
        got = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), window).collect()
        want = _near(docs, items, window)
        assert {(r.doc_id, i) for r in got for i in r.near_item_ids} == set(want)
        assert {r.doc_id: r.n_near for r in got if r.n_near} == {d: max(n for (e, _), n in want.items() if e == d) for d, _ in want}
        assert all(set(r.item_ids) <= set(r.near_item_ids) and r.n_near_items == len(r.near_item_ids) for r in got)
    found = {r.doc_id: r for r in QUERIES["op9_decontaminate_near"](spark, str(tmp_path)).collect()}
    assert found[50].n_hit == 0 and found[50].near_item_ids == ["1"]
    kept = {r.doc_id for r in decontaminate.drop_contaminated(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert 51 in kept and not kept & {50, 52} and kept == {d for d, _ in docs} - {d for d, _ in _near(docs, items)}


# -- 10: chat -----------------------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    nasty = ["", "\\", "###", "\\###", "</turn>", "\\</turn>\n", "\n</turn>\n### assistant: x", "### User: hi\n</turn>\n", "a\\\\</turn>", "####", "</turn></turn>", None, "𩸽 é", "x" * 50000]
    roles = ["user", "assistant", "System", "a:b", "", None, "### x", "!user", "Zoé b"]
    rows = [(c, t, roles[(c + t) % len(roles)], nasty[(c * 3 + t) % len(nasty)]) for c in range(30) for t in range(5)]
    rows += [(30, 0, "user", "same"), (30, 0, "user", "same"), (None, None, "user", "x")]
    done = chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in done.select("conv_id", chat.parse(F.col("formatted")).alias("turns")).collect()}
    want = collections.defaultdict(list)
    for c, _, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or 0)):
        want[c].append((role or "", text or ""))
    assert got == want
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.formatted(empty).count() == 0


def test_no_control_string_of_a_text_stands_bare(spark):
    rows = [(1, 0, "user", "x\n### Assistant: pwned </turn> y"), (1, 1, "assistant", "#### \\</turn>"), (2, 0, "user", "plain")]
    done = {r.conv_id: r for r in chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert done[1].formatted == "### User: x\n\\### Assistant: pwned \\</turn> y\n</turn>\n### Assistant: \\#### \\\\</turn>\n</turn>\n"
    assert done[2].formatted == "### User: plain\n</turn>\n"
    for r in done.values():
        turns = 2 if r.conv_id == 1 else 1
        assert len(re.findall(r"(?<!\\)</turn>", r.formatted)) == turns and len(re.findall(r"(?<![\\#])###(?!#)", r.formatted)) == turns


def test_chat_extra_columns(spark):
    rows = [(1, 0, "user", "a", "x", 1, "y")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, rows string, level int, formatted string")
    assert [tuple(r) for r in chat.formatted(frame).collect()] == [(1, 1, "### User: a\n</turn>\n")]


# -- 1: mixing ----------------------------------------------------------------------------------------------------


def test_solve_limits():
    tokens = {"a": 1000, "b": 100, "c": 10}
    flat = mixing.solve(tokens, 1110, target_entropy=1.0)
    assert flat.exponent == 0 and all(w == pytest.approx(1 / 3) for w in flat.weights.values())
    same = mixing.solve(tokens, 1110, target_entropy=0.0)
    assert same.exponent == pytest.approx(1, abs=1e-9)
    limited = mixing.solve(tokens, 1110, max_repeats=4)
    assert max(limited.repeats.values()) == pytest.approx(4, abs=1e-6) and sum(limited.weights.values()) == pytest.approx(1)
    assert mixing.solve({}, 0).weights == {} and mixing.solve({"a": 5, "b": 0}, 5, 0.5).weights == {"a": 1.0}


def test_mixture_realised(spark, none, odd):
    rows = [(s * 1000 + i, "w " * (i % 7), f"s{s}") for s, n in ((0, 300), (1, 60), (2, 9)) for i in range(n)]
    got = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string"), block_tokens=40).collect()
    tokens = {s: sum(len(t.split()) for _, t, x in rows if x == s) for s in ("s0", "s1", "s2")}
    plan = mixing.solve(tokens, sum(tokens.values()), 0.5, 4.0)
    for s in tokens:
        mine = [r for r in got if r.source == s]
        assert abs(sum(r.mix_tokens for r in mine) - plan.weights[s] * sum(tokens.values())) <= 7
        seen = collections.Counter((r.mix_epoch, r.doc_id) for r in mine)
        assert set(seen.values()) == {1}
        whole = int(plan.repeats[s])
        for e in range(whole):
            assert sum(r.mix_epoch == e for r in mine) == sum(x == s for _, _, x in rows)
        first = {r.mix_order: r.mix_block for r in mine if r.mix_epoch == 0}
        assert len(set(first.values())) == len(first)
    assert mixing.mixed(none).count() == 0 and mixing.mixed(odd).where("source = 'c'").count() > 0
    assert mixing.mixed(odd.withColumn("mix_epoch", F.lit("x")).withColumn("size", F.lit(1))).count() > 0


def test_many_sources_are_weighed_in_spark(spark):
    tokens = {f"s{i}": int(t) for i, t in enumerate(np.random.default_rng(1).integers(1, 9000, 300))} | {"none": 0}
    totals = spark.createDataFrame(list(tokens.items()), "mix_source string, t long")
    for goal, limit in ((0.5, 4.0), (1.0, None), (0.3, None), (None, 2.0)):
        plan = mixing.solve(tokens, 0.7 * sum(tokens.values()), goal, limit)
        for few in (1000, 10):
            found, total = mixing.targets_of(totals, 0.7, goal, limit, few)
            assert {r.mix_source: r.mix_target for r in found.collect()} == pytest.approx({k: 0.7 * total * plan.weights.get(k, 0.0) for k in tokens}, rel=1e-9)


def test_mixing_query_whole(spark):
    """Each source's words in op1 are those of its target, to the last document; shares from brute force."""
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").toPandas()
    words = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in docs.itertuples()}
    source = {r.doc_id: r.source or "" for r in docs.itertuples()}
    tokens = collections.Counter()
    for d, n in words.items():
        tokens[source[d]] += n
    plan = mixing.solve(dict(tokens), sum(tokens.values()), 0.5, 4.0)
    flat = lambda a: {s: t**a / sum(x**a for x in tokens.values()) for s, t in tokens.items()}
    entropy = lambda w: -sum(x * math.log(x) for x in w.values())
    assert plan.weights == pytest.approx(flat(plan.exponent))
    limited = max(plan.repeats.values()) == pytest.approx(4.0)
    assert limited or entropy(plan.weights) == pytest.approx(entropy(flat(1)) + 0.5 * (math.log(len(tokens)) - entropy(flat(1))))
    rows = QUERIES["op1_mix_sources"](spark, f"{DATA}/sf0.001").collect()
    got = collections.Counter()
    for r in rows:
        assert r.mix_tokens == words[r.doc_id] and (r.source or "") == source[r.doc_id]
        got[source[r.doc_id]] += r.mix_tokens
    for s in tokens:
        last = max((r.mix_tokens for r in rows if (r.source or "") == s), default=0)
        assert abs(got[s] - plan.weights[s] * sum(tokens.values())) <= last
    assert max(collections.Counter((r.mix_epoch, r.doc_id) for r in rows).values()) == 1


# -- 5: personal data ---------------------------------------------------------------------------------------------


def _base(text):
    kinds = []
    plain = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= sum(c.isdigit() for c in m) <= 19 and pii.luhn(re.sub("[ -]", "", m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= sum(c.isdigit() for c in m) <= 15),
    }
    for k, (pattern, good) in enumerate(plain.values()):
        kinds += [(k, m.start(), m.end()) for m in re.finditer(pattern, text) if good(m[0])]
    return kinds


def test_base_spans(docs):
    rng = np.random.default_rng(6)
    pieces = ["a@b.c", "@", ".", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "4111111111111111", "+1 (555) 123-4567", " ", "x", "-", "é", "12", "a.b@c-d.e_f@g.h", "+", "5"]
    made = ["".join(rng.choice(pieces, int(rng.integers(1, 14)))) for _ in range(4000)]
    for text in [*made, *(t or "" for _, t in docs)]:
        assert sorted(pii.base_spans(text)) == sorted(_base(text)), text


def test_contexts_find_unseen_identifiers(spark, none, odd):
    seeds = [(i, f"mail me call: +1 555 {100 + i} 2000 now number {i}") for i in range(30)]
    hidden = [(100, "please call: 555-123-4567 or wait 20 minutes"), (101, "it took call of 555 things")]
    rows = {r.doc_id: r for r in pii.extract(spark.createDataFrame(seeds + hidden, "doc_id long, text string")).collect()}
    assert [(s.k, s.s, s.e) for s in rows[100].spans] == [(3, 13, 25)] and rows[100].base == [] and rows[101].spans == []
    assert all(set(map(tuple, r.base)) <= set(map(tuple, r.spans)) for r in rows.values())
    assert pii.extract(odd).count() == len(ODD) and pii.extract(none).count() == 0 and pii.redact(none).count() == 0
    red = {r.doc_id: r.text for r in pii.redact(spark.createDataFrame(seeds + hidden, "doc_id long, text string")).collect()}
    assert red[100] == "please call: <PHONE> or wait 20 minutes" and "+1" not in red[0]
    assert pii.redact(odd).columns == odd.columns and pii.replaced("ab12cd", [(1, 2, 4), (2, 3, 5)]) == "ab<IP>d"


def test_pii_query_whole(spark, docs):
    """Every column of op5: counts and digest of the base by brute force, spans hold the base and more."""
    got = {r.doc_id: r for r in QUERIES["op5_pii"](spark, f"{DATA}/sf0.001").collect()}
    names = ["email", "ip", "card", "phone"]
    for i, text in docs:
        base = [f"{names[k]}:{a}:{b}" for k, a, b in sorted(_base(text or ""))]
        r = got[i]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(n) for x in base) for n in names]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        spans = [x.split(":") for x in r.spans.split(",") if x]
        assert set(base) <= set(r.spans.split(",")) and [(names.index(k), int(a)) for k, a, _ in spans] == sorted((names.index(k), int(a)) for k, a, _ in spans)


def _found(text):
    found = pii.Found()
    found.read(text)
    return [dict(zip(("instance", "seed", "may", "start", "end", "left", "right"), r, strict=True)) for r in zip(*found.seen, strict=True)]


def test_pii_contexts_have_no_caps():
    far = _found("." * 500 + "id=" + "." * 500 + "4539148803436468 " + "-" * 3000 + "x" * 900)
    assert [(r["instance"], r["left"], r["right"]) for r in far] == [("4539148803436468", "id", "x" * 900)]
    assert [r["instance"] for r in _found("a" * 500 + ".".join(["b"] * 600) + " 415-555-0199")] == ["415-555-0199"]
    assert [r["instance"] for r in _found("." * 401 + "415-555-0199")] == ["415-555-0199"]
    assert [r["instance"] for r in _found('{"k":"4539 1488 0343 6468","p":"(415) 555-0199","m":"' + "q" * 99 + '@h"}')] == ["4539 1488 0343 6468", "(415) 555-0199", "q" * 99 + "@h"]


def test_pii_is_linear():
    import time

    for made in (lambda n: "1 " + "x" * n, lambda n: "+1 555 100 2000 " * (n // 16), lambda n: "1234567890123," * (n // 14), lambda n: "a@" * (n // 2), lambda n: "1 " * (n // 2), lambda n: "(" * n + "1"):
        began = time.perf_counter()
        _found(made(1_000_000))
        assert time.perf_counter() - began < 20


# -- 6: language model --------------------------------------------------------------------------------------------


def test_elias_fano():
    rng = np.random.default_rng(0)
    for n, top in [(1, 5), (10, 100), (1000, 5000), (5000, 1 << 50), (64, 64), (1000, 1000)]:
        v = np.unique(rng.integers(0, top, n)).astype(np.uint64)
        e = lm.EliasFano.build(v)
        q = np.concatenate([v, rng.integers(0, top + 100, 500).astype(np.uint64), v + np.uint64(1)])
        assert (e.access(np.arange(len(v))) == v).all() and (e.successor(q) == np.searchsorted(v, q)).all()
        assert set(e.find(q)[: len(v)]) == set(range(len(v)))
    assert (lm.EliasFano.build(np.zeros(0, np.uint64)).find(np.arange(3).astype(np.uint64)) == -1).all()


def _lm(texts, order):
    """Brute force: token, type and text counts, and a function from a text to what the trie says of it."""
    tok = lambda t: [*re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()), b"\n"]
    one, more, n = collections.Counter(), collections.Counter(), len(texts)
    for t in texts:
        ws = [b"^", *tok(t)]
        one.update(ws[1:])
        more.update(tuple(ws[i : i + k]) for k in range(2, order + 1) for i in range(len(ws) - k + 1))
    total, types = sum(one.values()), len(one)
    p1 = lambda w: (one[w] + 1) / (total + types + 1)
    often = lambda h: n if h == (b"^",) else one[h[0]] if len(h) == 1 else more[h]

    def p(h, w):
        if not h:
            return p1(w)
        mu = lm.MU if len(h) == 1 else lm.MU_LONG
        return (more[*h, w] + mu * p(h[1:], w)) / (often(h) + mu)

    def said(t):
        ws = [b"^", *tok(t)]
        at = range(1, len(ws))
        return len(at), sum(one[ws[i]] > 0 for i in at), total, sum(math.log10(p1(ws[i])) for i in at), sum(math.log10(p(tuple(ws[max(0, i - order + 1) : i]), ws[i])) for i in at)

    return said


def _close(r, want):
    assert (r.n_tokens, r.n_known, r.train_tokens) == want[:3]
    assert r.base_score == pytest.approx(want[3], abs=1e-6) and r.score == pytest.approx(want[4], abs=3e-4 * want[0])


def test_lm_brute_force(spark, docs):
    out = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    said = _lm([t for i, t in docs if not out(i)], lm.ORDER)
    got = {r.doc_id: r for r in QUERIES["op6_lm_score"](spark, f"{DATA}/sf0.001").collect()}
    for i, t in docs:
        assert got[i].held_out == out(i)
        _close(got[i], said(t))


@pytest.mark.parametrize("order, shards", [(2, 1), (3, 7), (4, 3)])
def test_lm_orders_and_hot_contexts(spark, order, shards, monkeypatch):
    rng = np.random.default_rng(order)
    words = ["the", "a", "b", "c", "é", "Dd", "dd"]
    train = [" ".join(rng.choice(words, int(rng.integers(0, 30)))) for _ in range(60)] + [" ".join(f"the w{i}" for i in range(400)), "the " * 500]
    monkeypatch.setattr(lm, "TOGETHER", 300)
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(train)], "doc_id long, text string")
    model = lm.learn(frame, shards, order)
    said = _lm(train, order)
    for r, t in zip(lm.score(frame, model).orderBy("doc_id").collect(), train, strict=True):
        _close(r, said(t))


def _thue_morse(n):
    text = "a"
    while len(text) < n:
        text += text.translate(str.maketrans("ab", "ba"))
    return text


def test_equal_means_equal_bytes(spark):
    """Texts that collide under every polynomial modulo a power of two."""
    a = _thue_morse(2048)
    b = a.translate(str.maketrans("ab", "ba"))
    counts = rules.counts_of(pa.array([f"{a}\n{b}\n{a}", " ".join([a] * 8 + [b] * 8), " ".join([a] * 16)]))
    assert counts["n_dup_lines"].tolist() == [1, 0, 0] and counts["n_repeat_words"].tolist() == [0, 0, 16]
    frame = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    rows = lm.score(frame, lm.learn(frame.where("doc_id = 1"), 2)).orderBy("doc_id").collect()
    assert [r.n_known for r in rows] == [2, 1] and rows[1].base_score < rows[0].base_score


def test_words_of_one_hash_are_told_by_their_checks(spark, monkeypatch):
    """All words get one hash; only the check bits tell them apart."""
    model = lm.Vocabulary("", ["x"], [lm.FIRST], 10, 4, 1)
    hashes = np.array([5, 9, 9, 9], np.uint64)
    ef = lm.EliasFano.build(hashes - np.uint64(5))
    arrays = [*ef.arrays(), *lm._coded(np.array([1, 2, 3, 4])), np.array([7, 1, 2, 3], np.uint32)]
    monkeypatch.setitem(lm._mapped, "x", ({"base": 5, "hashes": (ef.n, ef.width)}, arrays))
    asked = np.array([[9, 3 << 32], [9, 4 << 32], [5, 7 << 32], [4, 7 << 32], [9, 1 << 32], [10, 1 << 32]], np.uint64)
    assert model.numbers(asked).tolist() == [lm.FIRST + 3, -1, lm.FIRST, -1, lm.FIRST + 1, -1]
    assert model.counts(model.numbers(asked)).tolist() == [4, 0, 1, 0, 2, 0]


def test_lm_files_that_cannot_be_mapped(spark, monkeypatch):
    """Copies for the worker, few of them mapped at a time, score as the files do."""
    texts = [(i, f"a b c w{i} d{i % 3}") for i in range(40)]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    model = lm.learn(frame, 5)
    column = pa.array([t for _, t in texts])
    want = [x.to_pylist() for x in lm.score_column(model, column)]
    monkeypatch.setattr(lm, "MAPPED", 1)
    monkeypatch.setattr(lm, "_mapped", {})
    monkeypatch.setattr(lm.pafs, "LocalFileSystem", tuple)
    assert [x.to_pylist() for x in lm.score_column(model, column)] == want and len(lm._copies) > 5


def test_lm_looks_every_order_up_once(monkeypatch, spark):
    """Scoring finds the grams of each order once for a group of texts, and no more often than there are orders."""
    frame = spark.createDataFrame([(i, f"a b c w{i} d{i % 3}") for i in range(20)], "doc_id long, text string")
    model = lm.learn(frame, 3, 4)
    asked, find = [], lm.Level.find
    monkeypatch.setattr(lm.Level, "find", lambda self, *a: asked.append(model.levels.index(self)) or find(self, *a))
    lm.score_column(model, pa.array(["a b c w1 d1", None, "x"]))
    assert asked == [0, 1, 2]


def test_lm_counts_pairs_and_threes_in_one_pass(spark, monkeypatch):
    """The texts are read twice to learn three orders: for the words, and for all grams; hot contexts are still spread."""
    train = [f"{'the of ' * 30}the of w{i} a{i % 7} b" for i in range(80)] + ["", None, "the", "of the of"]
    frame = spark.createDataFrame(list(enumerate(train)), "doc_id long, text string")
    passes, built = [], lm._shards_built
    monkeypatch.setattr(lm, "_shards_built", lambda *a: passes.append(1) or built(*a))
    model = lm.learn(frame, 5)
    assert len(passes) == 2 and len(model.levels) == 2
    home, spread = model.levels[1].paths[:5], model.levels[1].paths[5:]
    assert any(home) and sum(map(bool, spread)) > 1
    heads = [lm._load(model.vocabulary.folder, x)[0] for x in spread if x]
    assert sum(h["successors"][0] for h in heads) > 80 and max(h["contexts"][0] for h in heads) <= 4
    said = _lm(train, 3)
    for r, t in zip(lm.score(frame, model).orderBy("doc_id").collect(), train, strict=True):
        _close(r, said(t))


def test_lm_groups_are_alike(monkeypatch):
    """Texts a little more than two groups hold make three of like size, each text in one of them."""
    monkeypatch.setattr(lm, "TOGETHER", 6 << 20)
    found = list(lm._groups(pa.array(["ab " * 33000] * 130)))
    sizes = [int(t.per_doc.sum()) for _, t in found]
    assert len(sizes) == 3 and sum(sizes) == 130 * 33000 and max(sizes) < 1.3 * min(sizes)
    assert [at for at, _ in found] == [0, *np.cumsum([len(t.per_doc) for _, t in found])[:-1]]


def test_lm_merges_by_one_number_or_by_two(monkeypatch):
    """Blocks of counts merge alike whether or not both keys fit in one number; those that fit are sorted once."""
    rng = np.random.default_rng(5)
    for top, calls in ((1 << 20, 0), (1 << 63, 1)):
        blocks = [np.unique(rng.integers(0, 40, (200, 2)), axis=0) for _ in range(5)]
        keys = [(b[:, 0].astype(np.uint64) * np.uint64(top // 40), b[:, 1].astype(np.uint64)) for b in blocks]
        parts = [next(lm._packed(np.zeros(len(u), np.int64), u, w, np.full(len(u), i + 1)))[1] for i, (u, w) in enumerate(keys)]
        want = collections.Counter()
        for i, (u, w) in enumerate(keys):
            for k in zip(u.tolist(), w.tolist(), strict=True):
                want[k] += i + 1
        sorts, lexsort = [], np.lexsort
        monkeypatch.setattr(lm.np, "lexsort", lambda k: sorts.append(1) or lexsort(k))  # noqa: B023
        upper, lower, counts = lm._merged(parts)
        monkeypatch.undo()
        assert list(zip(upper.tolist(), lower.tolist(), counts.tolist(), strict=True)) == [(*k, want[k]) for k in sorted(want)] and len(sorts) == calls


def test_elias_fano_crowded_buckets():
    """Repeated values and full buckets: the first of equal values, and none beside them."""
    v = np.sort(np.concatenate([np.repeat([3, 3, 1000], 50), np.arange(5000, 5200), [1 << 30]])).astype(np.uint64)
    e, q = lm.EliasFano.build(v), np.concatenate([v, v + np.uint64(1), np.array([0, 1 << 40], np.uint64)])
    at = np.searchsorted(v, q)
    assert (e.successor(q) == at).all()
    assert (e.find(q) == np.where(np.isin(q, v), at, -1)).all()


def test_lm_odd(odd, none):
    model = lm.learn(odd, 3)
    rows = lm.score(odd, model).collect()
    assert len(rows) == len(ODD) and rows[0].n_tokens == 1 and lm.score(none, model).count() == 0
    with pytest.raises(ValueError):
        lm.learn(odd, 3, 1)
    empty = lm.score(odd, lm.learn(none, 2)).collect()
    assert len(empty) == len(ODD) and all(r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in empty)


# -- 3, 4, 8: classifiers -----------------------------------------------------------------------------------------


def test_gradients():
    net = toxicity.Network.new(3, hidden=4, dtype=np.float64)
    rng = np.random.default_rng(1)
    v, at = rng.standard_normal((7, 4)), rng.integers(0, 8, (5, 3))
    mask = (at < 7).astype(np.float64)
    mask[0] = 1
    at[0] = np.minimum(at[0], 6)
    g = rng.standard_normal(3)

    def loss(vectors):
        return float(net.forward(net.gates(vectors), at, mask) @ g)

    keep: dict = {}
    net.forward(net.gates(v), at, mask, keep)
    grad, dv = net.backward(v, at, mask, keep, g)
    eps = 1e-6
    for name, want in grad.items():
        p = net.p[name]
        for i in list(np.ndindex(*p.shape))[:6]:
            was = p[i]
            p[i] = was + eps
            up = loss(v)
            p[i] = was - eps
            down = loss(v)
            p[i] = was
            assert want[i] == pytest.approx((up - down) / (2 * eps), abs=1e-5), name
    for i in np.ndindex(*v.shape):
        w = v.copy()
        w[i] += eps
        up = loss(w)
        w[i] -= 2 * eps
        assert dv[i] == pytest.approx((up - loss(w)) / (2 * eps), abs=1e-5)


def _word_vector(net, word):
    """A word's input by the definition: its embedding and the mean of its character n-grams'."""
    v = net.p["word"][int.from_bytes(xxhash.xxh3_128_digest(word)[:8], "big") >> (64 - toxicity.WORD_BITS)].astype(float)
    marked, rows = b"<" + word + b">", []
    for i in range(len(marked) - 2):
        rows.append((int.from_bytes(marked[i : i + 3], "little") * 2654435761 & 0xFFFFFFFF) >> (32 - toxicity.CHAR_BITS))
    for i in range(len(marked) - 3):
        rows.append(((int.from_bytes(marked[i : i + 4], "little") ^ 0x5BD1E995) * 2246822519 & 0xFFFFFFFF) >> (32 - toxicity.CHAR_BITS))
    return v + net.p["char"][rows].astype(float).mean(axis=0)


def test_toxicity_scores_by_hand():
    """Every window of some texts, word by word, against the blocks' scores."""
    net = toxicity.Network.new(5)
    rng = np.random.default_rng(5)
    net.p["word"] = (rng.standard_normal(net.p["word"].shape) * 0.3).astype(np.float32)
    net.scale, net.shift, net.empty = 1.3, -0.2, 0.4
    words = ["Alpha", "beta", "é", "x", "gamma,", "delta-epsilon", "Z"]
    texts = [" ".join(rng.choice(words, n)) for n in (1, 2, 31, 32, 33, 70, 107)] + ["", " \n"]
    p = {k: v.astype(float) for k, v in net.p.items()}
    s = lambda x: 1 / (1 + np.exp(-x))

    def logit(vectors):
        states = []
        for d, run in (("f", vectors), ("b", vectors[::-1])):
            h, out = np.zeros(toxicity.HIDDEN), []
            for v in run:
                x = {g: v @ p[f"x{g}{d}"] + p[f"b{g}{d}"] for g in "zrh"}
                z, r = s(x["z"] + h @ p[f"uz{d}"]), s(x["r"] + h @ p[f"ur{d}"])
                h = z * h + (1 - z) * np.tanh(x["h"] + r * (h @ p[f"uh{d}"]))
                out.append(h)
            states.append(out if d == "f" else out[::-1])
        both = np.hstack(states)
        e = np.tanh(both @ p["att"]) @ p["pick"]
        w = np.exp(e - e.max())
        return float((w / w.sum()) @ both @ p["out"] + p["bias"][0])

    got = toxicity.score_column(net, pa.array(texts))
    for text, score in zip(texts, got, strict=True):
        vectors = [_word_vector(net, re.sub("[A-Z]", lambda m: m[0].lower(), w).encode()) for w in text.split()]
        n = len(vectors)
        begins = sorted({min(b, max(0, n - toxicity.WINDOW)) for b in range(0, max(1, n), toxicity.STRIDE)})
        want = s(net.scale * max(logit(np.array(vectors[b : b + toxicity.WINDOW])) for b in begins) + net.shift) if n else net.empty
        assert score == pytest.approx(want, abs=1e-4)


def test_windows_cover_all_words():
    counts = np.array([0, 1, 31, 32, 33, 56, 57, 200])
    doc, begin = toxicity.windows(counts)
    for d, n in enumerate(counts):
        seen = set(itertools.chain.from_iterable(range(b, min(b + toxicity.WINDOW, n)) for b in begin[doc == d]))
        assert seen == set(range(n))


def _made(rng, n, mark):
    return [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega", "sigma"], 60).tolist() + mark(i)) for i in range(n)]


def test_long_passages_are_whole_in_a_window_at_every_offset():
    long = toxicity.WINDOW - toxicity.STRIDE + 1
    assert long >= 21
    for n in (21, 32, 33, 50, 100, 101, 107):
        _, begin = toxicity.windows(np.array([n]))
        for at in range(n - 21 + 1):
            assert any(b <= at and at + 21 <= b + toxicity.WINDOW for b in begin)


def test_toxicity_learns():
    rng = np.random.default_rng(0)
    texts = [t.encode() for t in _made(rng, 120, lambda i: [f"loath{rng.integers(99)}ing"] if i % 2 else [])]
    y = np.arange(120) % 2
    net = toxicity.train(texts, y, epochs=8)
    fresh = _made(rng, 60, lambda i: [f"loath{rng.integers(100, 999)}er", "alpha"] if i % 2 else [])
    p = toxicity.score_column(net, pa.array(fresh))
    assert ((p >= 0.5) == (np.arange(60) % 2 == 1)).mean() > 0.95
    assert toxicity.score_column(net, pa.array([None, "", " ", "x" * 100000]))[0] == pytest.approx(0.5)
    lone = toxicity.train([b"a"], np.array([1]))
    assert 0.9 < toxicity.score_column(lone, pa.array(["a b"]))[0] <= 1 and len(toxicity.score_column(toxicity.train([], np.zeros(0)), pa.array(["a"]))) == 1


def test_rules_counts():
    rng = np.random.default_rng(9)
    texts = ["", None, "  \n ", "a\na\n\nb\r\na", "#x $y é|ü <z>", "a b c d e f g h i a b c d e f g h"] + ["".join(rng.choice(["aa ", "b\n", "c\td ", "é ", "## ", "\n", "a b c d e f g h "], int(rng.integers(0, 40)))) for _ in range(200)]
    got = rules.counts_of(pa.array(texts))
    for i, t in enumerate(texts):
        t = t or ""
        ws = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        spans = collections.Counter(tuple(ws[j : j + 8]) for j in range(len(ws) - 7))
        hit = set(itertools.chain.from_iterable(range(j, j + 8) for j in range(len(ws) - 7) if spans[tuple(ws[j : j + 8])] > 1))
        want = {"n_words": len(ws), "word_chars": sum(map(len, ws)), "n_symbols": len(re.findall(r"[#*$%&|<>]", t)), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(hit)}
        assert {k: int(got[k][i]) for k in want} == want, t


def test_rules_query_whole(spark):
    """base_failed is checked by SQL; the verdict is its own or the score's."""
    rows = QUERIES["op8_quality_rules"](spark, f"{DATA}/sf0.001").collect()
    assert any(r.kept for r in rows) and all(r.kept == (not r.base_failed and r.score >= rules.THRESHOLD) and 0 <= r.score <= 1 for r in rows)


def test_prior_and_positive_unlabelled(spark):
    rng = np.random.default_rng(5)
    good = lambda n: [" ".join(rng.choice(["the", "of", "and", "river", "stone", "light"], 40)).encode() for _ in range(n)]
    bad = lambda n: [" ".join(rng.choice(["BUY!!", "$$$", "NOW!!", "###"], 40)).encode() for _ in range(n)]
    positive, halves = good(200), [good(70) + bad(30), good(70) + bad(30)]
    models = quality.first_models(positive, halves)
    corpus = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(good(600) + bad(400))], "doc_id long, text string")
    bins = quality.corpus_bins(corpus, models)
    prior = quality.class_prior(quality.unseen(models, positive), bins)
    assert bins.sum() == 1000 and 0.5 < prior < 0.75
    model = quality.train(positive, halves[0] + halves[1], prior, good(30) + bad(30), np.repeat([1.0, 0.0], 30))
    p = model.scores(pa.array(good(50) + bad(50), pa.large_binary()))
    assert (p[:50] >= 0.3).all() and (p[50:] < 0.3).all()
    assert np.isfinite(model.scores(pa.array([None, b"", b"x" * 100000], pa.large_binary()))).all()


def test_quality_fit_gives_its_memory_back(spark):
    """Of what a fit took, the driver's Python keeps little; the rest once stayed in free lists for all later stages."""
    held = lambda: sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024
    docs, labels = (spark.read.parquet(f"{DATA}/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    quality.fit(docs, labels)  # imports and connections
    _shared.released()
    before, most, done = held(), [0.0], threading.Event()

    def watch():
        while not done.wait(0.02):
            most[0] = max(most[0], held())

    watcher = threading.Thread(target=watch)
    watcher.start()
    model = quality.fit(docs, labels)
    done.set()
    watcher.join()
    assert model.tables and held() - before < max(8, 0.2 * (most[0] - before))


def test_unlabelled_sample_keeps_its_bounds(spark):
    rows = [(i, "x" * (i % 50)) for i in range(500)] + [(1000, "y" * 5000), (1001, None), (1001, None)]
    keys, texts = _fit.unlabelled_sample(spark.createDataFrame(rows, "doc_id long, text string"), 100, 2000)
    assert 20 < len(texts) <= 100 and sum(map(len, texts)) <= 2000 and len(set(keys.tolist())) == len(keys)
    assert _fit.unlabelled_sample(spark.createDataFrame([], "doc_id long, text string"), 100, 2000)[1] == []


def test_characters_are_whole():
    texts = ["aé𩸽b", "", "éé", "plain"]
    for _, block in _shared.blocks(pa.array(texts)):
        codes, at = _fit.characters(block)
        assert np.diff(at).tolist() == [4, 0, 2, 5] and len(set(codes[[1, 4, 5]].tolist())) == 1


def test_calibration():
    rng = np.random.default_rng(0)
    x = rng.standard_normal(4000) * 3
    y = rng.random(4000) < _fit.sigmoid(2 * x - 1)
    a, b = _fit.platt(x, y)
    assert a == pytest.approx(2, abs=0.3) and b == pytest.approx(-1, abs=0.3)


@pytest.mark.parametrize("name, column", [("op3_toxicity", "toxic"), ("op4_quality_classifier", "quality")])
def test_held_out_accuracy(spark, name, column):
    found = QUERIES[name](spark, f"{DATA}/sf0.01").join(spark.read.parquet(f"{DATA}/sf0.01/labels.parquet"), "doc_id").toPandas()
    held = found[found.held_out]
    assert set(found.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in found.doc_id]) == {True}
    assert ((held.score >= 0) & (held.score <= 1)).all() and (held.predicted == held[column]).mean() > 0.85


def test_classifiers_on_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 1), (5, 0, 1), (None, 1, None), (7, None, 1)], "doc_id long, quality int, toxic int")
    net, pu, rule = toxicity.fit(odd, labels), quality.fit(odd, labels), rules.fit(odd, labels)
    for found in (toxicity.score(odd, net), quality.score(odd, pu), rules.judge(odd, rule)):
        rows = found.collect()
        assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    for found in (toxicity.score(none, net), quality.score(none, pu), rules.judge(none, rule), quality.keep(none, pu)):
        assert found.count() == 0
    assert toxicity.fit(none, labels.limit(0)).scale == 0 and quality.keep(odd, pu).columns == odd.columns


# -- 7: URLs ------------------------------------------------------------------------------------------------------


def test_temporal_join(spark):
    day = lambda d: f"2024-01-{d:02d}"
    entries = [("example.org", "block", day(5)), ("example.org", "allow", day(10)), ("a.example.org/x", "allow", day(6)), ("a.example.org", "block", day(12)), ("a.example.org", "allow", day(12)), (None, "block", day(1)), ("late.net", "block", None)]
    captures = [(1, "http://example.org/", day(4)), (2, "https://u:p@A.Example.org:80/y?q", day(5)), (3, "http://a.example.org/x/y", day(7)), (4, "http://b.example.org", day(10)), (5, "http://a.example.org/", day(20)), (6, None, day(5)), (7, "no url", day(5)), (8, "http://example.org/", None), (2, "https://u:p@A.Example.org:80/y?q", day(5))]
    c = spark.createDataFrame(captures, "id long, url string, d string").select("id", "url", F.to_date("d").alias("fetched"), F.lit(1).alias("rank"), F.lit("x").alias("pattern"))
    e = spark.createDataFrame(entries, "pattern string, action string, d string").select("pattern", "action", F.to_date("d").alias("effective"))
    got = sorted((r.id, r.verdict, r.pattern or "") for r in urls.judged(c, e).collect())
    assert got == [(1, "none", ""), (2, "block", "example.org"), (2, "block", "example.org"), (3, "allow", "a.example.org/x"), (4, "allow", "example.org"), (5, "block", "a.example.org"), (6, "none", ""), (7, "none", ""), (8, "none", "")]
    assert urls.judged(c.limit(0), e).count() == 0 and urls.judged(c, e.limit(0)).where("verdict != 'none'").count() == 0


def test_urls_of_any_depth_and_labels(spark):
    deep = "/".join("abcdefghijkl")
    entries = [("com", "block"), (f"x.org/{deep}", "allow"), ("org", "block"), ("a.b.c.d.e.net", "block")]
    e = spark.createDataFrame(entries, "pattern string, action string").withColumn("effective", F.lit("2024-01-01").cast("date"))
    captures = [(1, "http://any.com/x"), (2, f"http://x.org/{deep}/m"), (3, "http://x.org/a"), (4, "http://z.a.b.c.d.e.net"), (5, "http://b.c.d.e.net"), (6, "http://com")]
    c = spark.createDataFrame(captures, "id long, url string").withColumn("fetched", F.lit("2024-02-01").cast("date"))
    assert [(r.id, r.verdict) for r in urls.judged(c, e).orderBy("id").collect()] == [(1, "block"), (2, "allow"), (3, "block"), (4, "block"), (5, "none"), (6, "block")]


# -- Names --------------------------------------------------------------------------------------------------------

#: Every name the operators and stages use for columns of their own.
TAKEN = (
    "row row_ key key_ __key __pk pk more __more __doc doc u f best asked pattern action since until rank verdict mix_source mix_key mix_blocks mix_block mix_row mix_tokens mix_target "
    "mix_total mix_epoch mix_order place last room size begin fp root node first least stays gone n word term next item ipos diag pos n_words base seen spans k s e score half bin y"
).split()


@pytest.fixture(scope="module")
def clashing(spark):
    """Documents whose other columns have the operators' own names."""
    rows = [(1, "mail a@b.cd one two three four five six seven eight nine ten", "s", 60, *range(len(TAKEN))), (2, None, None, None, *range(len(TAKEN))), (3, "x y", "t", 3, *range(len(TAKEN)))]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, " + ", ".join(f"{c} int" for c in TAKEN))


def test_columns_of_any_name(spark, clashing):
    items = spark.createDataFrame([(1, "three four five six seven eight nine ten eleven twelve")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 1)], "doc_id long, quality int, toxic int")
    same = [simhash.drop_copies(clashing), decontaminate.drop_contaminated(clashing, items), pii.redact(clashing), quality.keep(clashing, quality.fit(clashing, labels))]
    for found in same:
        assert found.columns == clashing.columns
        for r in found.collect():
            assert [r[c] for c in TAKEN] == list(range(len(TAKEN)))
    mixed = mixing.mixed(clashing)
    own = [c for c in TAKEN if c not in mixing.COLUMNS]
    assert mixed.count() >= 3 and all([r[c] for c in own] == [TAKEN.index(c) for c in own] for r in mixed.collect())
    captures = clashing.withColumn("url", F.lit("http://a.org/x")).withColumn("fetched", F.lit("2024-01-02").cast("date"))
    entries = spark.createDataFrame([("a.org", "block")], "pattern string, action string").withColumn("effective", F.lit("2024-01-01").cast("date"))
    own = [c for c in TAKEN if c not in ("verdict", "pattern", "since")]
    assert [(r.verdict, r.pattern, *(r[c] for c in own)) for r in urls.judged(captures, entries).collect()] == [("block", "a.org", *(TAKEN.index(c) for c in own))] * 3
    for found in (simhash.near_duplicates(clashing), pii.extract(clashing), decontaminate.contamination(clashing, items), lm.score(clashing, lm.learn(clashing, 2)), quality.score(clashing, quality.fit(clashing, labels)), toxicity.score(clashing, toxicity.fit(clashing, labels)), rules.judge(clashing, rules.fit(clashing, labels))):
        assert found.count() == 3


def test_scratch_needs_a_shared_folder():
    class Conf:
        get = staticmethod(lambda *_: None)

    class Context:
        master = "spark://somewhere:7077"
        getConf = staticmethod(Conf)
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext, conf = Context, Conf

    with pytest.raises(RuntimeError):
        _shared.shared_dir(Session)


# -- Pipeline -----------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    names = docs.columns
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = _shared.written(stage(spark, before, f"{DATA}/sf0.001"), name)
        if name != "mixing_sources":
            assert after.columns == names
        if name == "quality_classifier":
            scores = quality.score(before, quality.fit(before, spark.read.parquet(f"{DATA}/sf0.001/labels.parquet"))).collect()
            assert {r.doc_id for r in after.collect()} == {r.doc_id for r in scores if r.score >= quality.THRESHOLD} and len(scores) == before.count()
        if name == "mixing_sources":
            tokens = collections.Counter()
            for r in before.collect():
                tokens[r.source or ""] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
            plan, got, last = mixing.solve(dict(tokens), sum(tokens.values()), 0.5, 4.0), collections.Counter(), collections.Counter()
            for r in after.collect():
                got[r.source or ""] += r.mix_tokens
                last[r.source or ""] = max(last[r.source or ""], r.mix_tokens)
            assert all(abs(got[s] - plan.weights.get(s, 0) * sum(tokens.values())) <= last[s] for s in tokens)
        if name == "near_dedup":
            ids = {r.component_id for r in simhash.near_duplicates(before).collect()}
            assert {r.doc_id for r in after.collect()} == ids
        if name == "benchmark_decontamination":
            hit = {r.doc_id for r in decontaminate.contamination(before, spark.read.parquet(f"{DATA}/sf0.001/benchmark.parquet")).where("contaminated").collect()}
            assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()} - hit
        if name == "personal_data":
            assert not any(pii.base_spans(r.text) for r in after.collect()) and after.count() == before.count()
        before = after
    assert before.count() > 0


def test_chat_digests(spark):
    rows = {r.conv_id: r for r in QUERIES["op10_chat_format"](spark, f"{DATA}/sf0.001").collect()}
    text = "\\### Assistant: </turn> ok"
    assert rows[-7].turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest() and rows[-7].loss_chars == len(text)
