from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomspan.llm import mixing, packing, quality, tokens


# ---- tokens -----------------------------------------------------------------------------------------------
def test_token_counts(spark):
    texts = [None, "", " ", "Hello <|endoftext|> wörld  \n\n2025", "😀 ok", "x" * 50_000]
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)] + [(0, None, "c")], "doc_id bigint, text string, n_tokens string")
    enc = tokens.load(tokens.TOKENIZER)
    got = sorted(map(tuple, tokens.count_tokens(df).collect()))
    assert got == sorted([(i, len(enc.encode_ordinary(t)) if t else 0) for i, t in enumerate(texts)] + [(0, 0)])
    import tokenizers

    t = tokenizers.Tokenizer.from_file(tokens.TOKENIZER.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    assert [len(t.encode(x or "", add_special_tokens=False).ids) for x in texts[:5]] == [n for _, n in sorted(got)[1:6]]


# ---- packing ----------------------------------------------------------------------------------------------
@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60), st.integers(40, 64))
def test_plan_places_every_length(lengths, capacity):
    counts = {x: lengths.count(x) for x in lengths}
    got: dict[int, int] = {}
    for p in packing.plan(counts, capacity):
        assert sum(p.lengths) <= capacity and p.times > 0 and p.exact == (sum(p.lengths) == capacity)
        for x in p.lengths:
            got[x] = got.get(x, 0) + p.times
    assert got == counts


def test_plan_finds_exact_combinations():
    assert all(p.exact for p in packing.plan({60: 3, 40: 3}, 100))
    assert all(p.exact for p in packing.plan({50: 2, 30: 2, 20: 2}, 100))
    assert all(p.exact for p in packing.plan({40: 1, 35: 1, 15: 1, 10: 1}, 100))
    with pytest.raises(ValueError):
        packing.plan({101: 1}, 100)


def test_pack_keeps_all_and_cuts_only_what_must(spark):
    rnd = random.Random(1)
    n = [rnd.choice([0, 7, 7, 7, rnd.randint(1, 100), 250, 300]) for _ in range(400)]
    df = spark.createDataFrame([(i, x, "c") for i, x in enumerate(n)] + [(0, n[0], "c")], "doc_id bigint, n_tokens bigint, bin_id string")
    rows = packing.pack(df, 100).collect()
    total: dict = {}
    fill: dict = {}
    for r in rows:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["length"]
        fill[r["bin_id"]] = fill.get(r["bin_id"], 0) + r["length"]
        assert (r["n_pieces"] > 1) == (n[r["doc_id"]] > 100)
    assert total == {i: x * (2 if i == 0 else 1) for i, x in enumerate(n)}
    assert max(fill.values()) <= 100 and sorted(fill) == list(range(len(fill)))
    assert len(fill) <= -(-sum(total.values()) // 100) + 3
    assert packing.pack(df.limit(0), 100).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_no_exact_pair_or_triple_is_left_over(seed):
    rnd = random.Random(seed)
    capacity = 300
    counts = {x: rnd.randint(1, 2) for x in rnd.sample(range(1, capacity), 120)}
    exact = [p for p in packing.plan(counts, capacity) if p.exact and len(p.lengths) <= 3]
    left = dict(counts)
    for p in exact:
        for x in p.lengths:
            left[x] -= p.times
    have = [x for x, n in left.items() for _ in range(n)]
    assert not any(a + b == capacity for i, a in enumerate(have) for b in have[i + 1 :])


def test_large_capacities_are_planned_in_seconds():
    rnd = random.Random(7)
    counts: dict[int, int] = {}
    for _ in range(60_000):
        x = min(131_072, int(rnd.lognormvariate(8, 1.5)) + 1)
        counts[x] = counts.get(x, 0) + 1
    t = __import__("time").time()
    bins = sum(p.times for p in packing.plan(counts, 131_072))
    assert __import__("time").time() - t < 30 and bins <= -(-sum(x * n for x, n in counts.items()) // 131_072) + 2


# ---- mixing -----------------------------------------------------------------------------------------------
def test_mix_reaches_shares(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.choice(["a", "A ", " b", "b", "c", None, "other"]), rnd.randint(0, 400)) for i in range(3000)]
    rows += [(10_000 + i, "rare", 300) for i in range(40)] + [(None, "a", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([("a", 0.4, 2), ("b", 0.3, 3), ("c", 0.1, 1), ("rare", 0.1, 4), ("absent", 0.1, 2)], "source string, target_share double, max_repeats int")
    chosen = mixing.mix(docs, targets)
    caps = {"a": 2, "b": 3, "c": 1, "rare": 4}
    got = chosen.collect()
    assert all(1 <= r["copies"] <= caps[r["source"]] and r["n_tokens"] > 0 for r in got)
    assert all(r["copies"] == 4 for r in got if r["source"] == "rare")
    s = {r["source"]: r for r in mixing.shares(chosen, targets).collect()}
    assert s["absent"]["actual_share"] == 0.0 and s["absent"]["tokens"] == 0
    for k, w in (("a", 4 / 9), ("b", 3 / 9), ("c", 1 / 9), ("rare", 1 / 9)):
        assert s[k]["actual_share"] == pytest.approx(w, abs=2e-3)
    assert mixing.mix(docs.limit(0), targets).count() == 0 and mixing.mix(docs, targets.limit(0)).count() == 0


def test_rates_solve_the_dual(spark):
    docs = spark.createDataFrame([(i, "a", 10 + i % 50) for i in range(500)] + [(1000 + i, "b", 20) for i in range(10)], "doc_id bigint, source string, n_tokens bigint")
    lam, wanted, scale = mixing.solve(mixing.histogram(docs), {"a": (0.9, 1), "b": (0.1, 4)})
    t = np.array([10 + i % 50 for i in range(500)], dtype=float)
    assert np.minimum(1, np.exp(lam["a"] * t / scale)).dot(t) == pytest.approx(wanted["a"], rel=1e-6)
    assert lam["b"] == float("inf") and wanted["b"] == 800


# ---- quality ----------------------------------------------------------------------------------------------
PROSE = "The rollup worker drops the final turn because the start event comes late, so the graph shows a gap. It is harmless in practice. "


def test_tails_are_exact_ranks(spark):
    rnd = random.Random(4)
    v = np.array([[float(rnd.choice([0, 1, 1, 2, rnd.random(), 10 ** rnd.randint(-6, 9)])) for _ in quality.STATISTICS] for _ in range(200)])
    langs = [rnd.choice(["en", "de"]) for _ in range(200)]
    code = quality.codes(v)
    assert all((np.sign(code[:, k][:, None] - code[:, k][None]) * np.sign(v[:, k][:, None] - v[:, k][None]) >= 0).all() for k in range(v.shape[1]))
    df = spark.createDataFrame([(i, g, c.tolist()) for i, (g, c) in enumerate(zip(langs, code))], "doc_id bigint, lang string, codes array<int>")
    ranked = quality.ranks(df)
    joined = {r["doc_id"]: r for r in quality.tails(df, ranked).collect()}
    looked_up = quality.Table(ranked.toPandas()).tails(__import__("pandas").Series(langs), code)
    for i, g in enumerate(langs):
        own = np.array([x == g for x in langs])
        low, high = -np.log((code[own] <= code[i]).mean(0)), -np.log((code[own] >= code[i]).mean(0))
        assert np.allclose(joined[i]["low"], low) and np.allclose(joined[i]["high"], high)
        assert np.allclose(looked_up[i], np.append(low, high))


def test_near_values_have_ranks_of_their_own(spark):
    n = len(quality.STATISTICS)
    v = np.array([[1000.0 + i] * n for i in range(4)] + [[0.12345 + i * 1e-9] * n for i in range(4)] + [[1003.0] * n])
    code = quality.codes(v)
    assert (code[:, 0] == [4, 5, 6, 7, 0, 1, 2, 3, 7]).all()
    df = spark.createDataFrame([(i, "en", c.tolist()) for i, c in enumerate(v)], "doc_id bigint, lang string, codes array<double>")
    ranked = quality.ranks(df)
    low = -np.log((v[:, 0] <= v[:, :1]).mean(1))
    assert np.allclose([r["low"][-1] for r in sorted(quality.tails(df, ranked).collect(), key=lambda r: r["doc_id"])], low)
    assert np.allclose(quality.Table(ranked.toPandas()).tails(__import__("pandas").Series(["en"] * 9), v)[:, n - 1], low)


def test_documents_are_ranked_by_unrounded_values(spark):
    docs = spark.createDataFrame([(i, "word " * (1000 + i), "en") for i in range(5)], "doc_id bigint, text string, lang string")
    words, labels = spark.createDataFrame([("en", "the")], "lang string, word string"), spark.createDataFrame([], "doc_id bigint, rater string, is_prose int")
    r = sorted(quality.judge(docs, words, labels).collect(), key=lambda x: x["doc_id"])
    assert len({x["outlier"] for x in r}) > 1


def test_odd_texts(spark):
    texts = [None, "", " \n", "word", PROSE, PROSE * 400, "- a\n- b", "\x00\ud83d\ude00", "a,b,c\n1,2,3", PROSE]
    docs = spark.createDataFrame([(i, t, l, "c") for i, (t, l) in enumerate(zip(texts, [None, "", "EN-us", "xx", "en", "en", "en", "und", "en", "en"]))], "doc_id bigint, text string, lang string, word_count string")
    words = spark.createDataFrame([("en", "the"), ("en", "is"), (None, None)], "lang string, word string")
    labels = spark.createDataFrame([(4, "r", 1), (4, "r", 0), (5, None, 1), (99, "r", 0), (None, None, None)], "doc_id bigint, rater string, is_prose int")
    r = {x["doc_id"]: x for x in quality.judge(docs, words, labels).collect()}
    assert len(r) == 10 and not any(r[i]["is_prose"] for i in (0, 1, 2)) and r[4]["lang"] == "en" and r[2]["lang"] == "en" and r[0]["lang"] == "und"
    assert r[5]["word_count"] == 400 * r[4]["word_count"]
    assert quality.judge(docs.limit(0), words, labels).count() == 0


def test_held_out_accuracy():
    rnd = np.random.default_rng(5)
    x = rnd.exponential(size=(1200, 12))
    y = (x[:, 0] + 0.5 * x[:, 3] > 2).astype(float)
    noisy = np.where(rnd.random(1200) < 0.05, 1 - y, y)
    m = quality.Weights(12).fit(x[:800], noisy[:800])
    assert (m.w >= 0).all() and ((m.score(x[800:]) > 0) == (y[800:] > 0.5)).mean() > 0.95


def test_without_labels_all_tails_weigh_the_same():
    m = quality.Weights(4).fit(np.zeros((0, 4)), np.zeros(0))
    assert len(set(m.w)) == 1 and m.score(np.full((1, 4), 1.0))[0] < 0 < m.score(np.full((1, 4), 1.5))[0]


def test_ranks_beyond_the_limit_are_joined(spark, monkeypatch):
    t = lambda n: spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet")
    args = [t(n) for n in ("documents", "common_words", "quality_labels")]
    want = sorted((r["doc_id"], round(r["outlier"], 6)) for r in quality.judge(*args).collect())
    monkeypatch.setattr(quality, "RANK_LIMIT", 10)
    assert sorted((r["doc_id"], round(r["outlier"], 6)) for r in quality.judge(*args).collect()) == want


def test_held_out_labels_agree(spark):
    d = "/root/testdata/sf0.1"
    t = lambda n: spark.read.parquet(f"{d}/{n}.parquet")
    known, held_out = t("quality_labels").where("doc_id % 2 = 0"), t("quality_labels").where("doc_id % 2 = 1")
    r = {x["doc_id"]: x["is_prose"] for x in quality.judge(t("documents"), t("common_words"), known).collect()}
    rows = held_out.collect()
    bad = [x for x in rows if x["is_prose"] == 0]
    assert sum(r[x["doc_id"]] == (x["is_prose"] == 1) for x in rows) / len(rows) > 0.93
    assert sum(not r[x["doc_id"]] for x in bad) / len(bad) > 0.8  # a few marks are wrong
