import random

import pytest
from pyspark.sql import functions as F

from notarium.llm import mixing as mx

T = mx.Target


def docs_of(spark, sizes):
    rows, k = [], 0
    for source, docs in sizes.items():
        for n in docs:
            rows.append((k, "word " * n, source, 7, "b"))
            k += 1
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, n_tokens int, bin string")


def mix_of(spark, rows):
    return spark.createDataFrame(rows, "source string, weight double, max_repeats int")


def test_shares_and_caps(spark):
    rng = random.Random(0)
    docs = docs_of(spark, {"big": [rng.randrange(5, 60) for _ in range(600)], "mid": [rng.randrange(5, 60) for _ in range(200)], "small": [rng.randrange(5, 30) for _ in range(30)], None: [9] * 5, "other": [9] * 5})
    chosen, shares = mx.mixed(docs, mix_of(spark, [("big", 5.0, 1), ("mid", 3.0, 2), ("small", 1.0, 4), ("none", 1.0, 3)]))
    s = {r.source: r for r in shares.collect()}
    assert s["none"].actual_share == 0 and s["none"].target_share == pytest.approx(0.1)
    for k in ("big", "mid", "small"):
        assert s[k].actual_share == pytest.approx(s[k].reachable_share, abs=0.01)
    got = chosen.groupBy("source").agg(F.max("n_uses").alias("m"), F.countDistinct("id").alias("d"), F.count("*").alias("c")).collect()
    assert {r.source: r.m for r in got}["small"] == 4 and all(r.m <= s[r.source].max_repeats and r.d == r.c for r in got)
    assert sum(r.actual_share for r in s.values()) == pytest.approx(1)
    again = {tuple(r) for r in mx.mixed(docs.repartition(7), mix_of(spark, [("big", 5.0, 1), ("mid", 3.0, 2), ("small", 1.0, 4), ("none", 1.0, 3)]))[0].collect()}
    assert again == {tuple(r) for r in chosen.collect()}


def test_overlapping_sources_share_their_documents(spark):
    docs = spark.createDataFrame([(i, "word " * 10, ["a"] if i < 50 else ["a", "b"] if i < 100 else ["b", "c", None]) for i in range(150)], "doc_id bigint, text string, of array<string>")
    chosen, shares = mx.mixed(docs, mix_of(spark, [("a", 1.0, 1), ("b", 1.0, 1), ("c", 1.0, 1)]), sources=F.col("of"))
    s = {r.source: r.actual_share for r in shares.collect()}
    assert all(v == pytest.approx(1 / 3, abs=0.03) for v in s.values())
    assert chosen.groupBy("id").agg(F.sum("n_uses").alias("n")).agg(F.max("n")).first()[0] == 1
    assert chosen.count() >= 140


def brute_total(patterns, targets):
    """The largest total by scipy-free search: all subsets of sources must be able to cover their quotas (max-flow, min-cut)."""
    from itertools import combinations

    weights = sum(t.weight for t in targets)
    best = None
    names = [t.source for t in targets]
    cap = {t.source: t.max_repeats for t in targets}
    for n in range(1, len(names) + 1):
        for some in combinations(names, n):
            supply = sum(min(v * max(cap[s] for s in p), sum(v * cap[s] for s in p if s in some)) for p, v in patterns.items() if set(p) & set(some))
            need = sum(t.weight for t in targets if t.source in some) / weights
            best = min(best, supply / need) if best is not None else supply / need
    return best


def test_flow_against_min_cuts():
    rng = random.Random(3)
    for _ in range(20):
        targets = [T(s, rng.randrange(1, 9), rng.randrange(1, 4)) for s in "abcd"]
        patterns = {tuple(sorted(rng.sample("abcd", rng.randrange(1, 4)))): rng.randrange(100, 9000) for _ in range(5)}
        some = [t for t in targets if any(t.source in p for p in patterns)]
        kept = {p: n for p, n in patterns.items()}
        total = sum(mx.plan(kept, targets).values())
        assert total == pytest.approx(brute_total(kept, some), rel=0.01, abs=20)


def test_repeats_are_spread():
    tokens = mx.route({("a",): 100, ("a", "b"): 100}, [T("a", 1, 3), T("b", 1, 3)], 200)[1]
    assert tokens == {(("a",), "a"): 100, (("a", "b"), "b"): 100}


def test_gaps(spark):
    docs = docs_of(spark, {"a": [3, 4]})
    assert mx.mixed(docs.limit(0), mix_of(spark, [("a", 1.0, 1)]))[0].count() == 0
    none, shares = mx.mixed(docs, mix_of(spark, []))
    assert none.count() == 0 and shares.count() == 0
    odd = docs.unionByName(docs).unionByName(spark.createDataFrame([(None, "x", "a", 1, "b"), (77, None, "a", 1, "b"), (78, "", "a", 1, "b")], docs.schema))
    chosen, shares = mx.mixed(odd, mix_of(spark, [("a", 1.0, 2), ("a", 1.0, 2), (None, 1.0, 1), ("z", None, None)]))
    assert {(r.id, r.n_uses) for r in chosen.collect()} == {(0, 2), (1, 2)}
    assert {r.source for r in shares.collect()} == {"a", "z"}


def test_tokens_are_those_of_the_tokenizer(spark):
    df = spark.createDataFrame([(1, "Hello wörld, Привет!"), (2, None)], "id bigint, text string")
    assert {tuple(r) for r in mx.token_counts(df, "id", "text").collect()} == {(1, len(mx._encoder(mx.TOKENIZER).encode_ordinary("Hello wörld, Привет!"))), (2, 0)}
