import os
import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from notarium import runtime
from notarium.llm import near_dup as nd
from notarium.llm import words

WORDS = nd.Similarity(kind="words", width=3, least=5, threshold=0.5)


def shingles(text, width=3, least=5):
    w = words.split(text)
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= least else set()


def brute(rows, threshold=0.5, make=shingles):
    sets = {i: s for i, t in rows if i is not None and (s := make(t))}
    return {(a, b) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


def variants(seed=3, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(n):
        base = [rng.choice(vocabulary) for _ in range(60)]
        rows.append((len(rows), " ".join(base)))
        for _ in range(rng.randrange(3)):
            edited = list(base)
            for _ in range(rng.randrange(8)):
                edited[rng.randrange(len(edited))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(edited)))
    return rows


def found(spark, rows, spec=WORDS):
    df = spark.createDataFrame(rows, "id bigint, text string")
    return {tuple(r) for r in nd.record_pairs(nd.class_links([nd.Field("f", df, "id", "text", spec)])).select("id_a", "id_b").collect()}


def test_against_brute_force(spark):
    rows = variants()
    assert found(spark, rows) == brute(rows)


def test_crowded_buckets_lose_nothing(spark):
    rows = variants(5, 20)
    small = nd.Similarity(kind="words", width=3, least=5, threshold=0.5, bucket_cap=1, broadcast_rows=3)
    assert found(spark, rows, small) == brute(rows)


def test_titles(spark):
    rows = [(1, "Cache flush: Abcdefgh Ijklmnop"), (2, "cache flush — abcdefgh/ijklmnop v2"), (3, "Queue drain"), (4, "ab"), (5, ""), (6, None), (None, "Queue drain")]
    spec = nd.Similarity(kind="chars", width=3, threshold=0.5)

    def make(t):
        s = " ".join(words.split(t))
        return {s[i : i + 3] for i in range(len(s) - 2)}

    assert found(spark, rows, spec) == brute([r for r in rows if r[1]], 0.5, make) == {(1, 2)}


def test_gaps_repeats_and_other_columns(spark):
    long = "x y z " * 50_000
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "A, b; c d e f!"), (3, None), (4, ""), (5, "a b"), (6, long), (7, long), (None, "a b c d e f")]
    df = spark.createDataFrame([(i, t, 0, "k", [1]) for i, t in rows], "id bigint, text string, node int, key string, bits array<int>")
    own = nd.Field("f", df, "id", "text", WORDS)
    assert [tuple(r) for r in nd.record_pairs(nd.class_links([own])).orderBy("id_a").collect()] == [("f", 1, 2), ("f", 6, 7)]
    assert {r.id: r.group_id for r in nd.groups([own]).collect()} == {1: 1, 2: 1, 6: 6, 7: 6}
    assert nd.groups([nd.Field("f", df.limit(0), "id", "text", WORDS)]).count() == 0


def test_many_copies_cost_no_pairs(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, F.lit("one and the same text of eight words")).otherwise(F.concat(F.lit("its own "), F.expr("repeat(concat(' w', id), 9)"))).alias("text"))
    linked = nd.class_links([nd.Field("f", df, "id", "text", WORDS)])
    assert linked.links.count() == 0 and linked.members.groupBy("node").count().where("count > 1").collect()[0]["count"] == 1000
    assert nd.record_pairs(linked).distinct().count() == nd.record_pairs(linked).count() == 1000 * 999 // 2
    assert nd.groups([nd.Field("f", df, "id", "text", WORDS)]).where("group_id = 0").count() == 1000


def test_defaults_are_five_words_and_four_fifths():
    assert (nd.Similarity().width, nd.Similarity().threshold, nd.Similarity().kind) == (5, 0.8, "words")


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)] + [(500, i) for i in range(501, 560)]
    root = {x: x for e in edges for x in e}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        root[y] = x
    want = {x: top(x) for a, b in edges if a != b for x in (a, b)}
    got = {r.node: r.root for r in nd.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == want


@pytest.mark.parametrize("most", [1, 50, 10_000])
@pytest.mark.parametrize("step", [1, 7, 300])
def test_pairing_is_the_same_however_the_stream_is_cut(step, most):
    rng = np.random.default_rng(1)
    key, node = rng.integers(0, 40, 300).astype(np.uint32), rng.integers(0, 1000, 300)
    packs = [key[i : i + step].tobytes() + node[i : i + step].tobytes() for i in range(0, 300, step)]
    batches = [pa.RecordBatch.from_arrays([pa.array(packs[i : i + 3], pa.binary())], names=["pack"]) for i in range(0, len(packs), 3)]
    out = [tuple(r.values()) for b in nd._pairing(8, most)(iter(batches)) for r in b.to_pylist()]
    pairs, crowd = {(a, b) for a, b, c in out if not c}, {(a, b) for a, b, c in out if c}
    want, crowds = set(), []
    for k in np.unique(key):
        own = sorted(set(node[key == k].tolist()))
        if len(own) > 8:
            crowds.append(set(own))
        else:
            want |= set(combinations(own, 2))
    assert pairs == want
    assert {x for p in crowd for x in p} == set().union(*crowds)
    for own in crowds:  # one of them meets all others
        assert any(own - {a} <= {y for x, y in crowd if x == a} for a in own)


def test_pairs_within_a_key_come_block_by_block(spark, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 4)
    rows = [(k, i) for k in range(3) for i in range(5 * k + 1)]
    df = spark.createDataFrame(rows, "k int, i int")
    want = sorted((k, a, b) for k in range(3) for a, b in combinations(range(5 * k + 1), 2))
    assert sorted(tuple(r) for r in nd.pairs_within(df, "k", "i", ("k",)).select("k", "a", "b").collect()) == want
    few = df.where("i in (2, 3)")
    got = {tuple(r) for r in nd.pairs_within(df, "k", "i", ("k",), few).select("k", "a", "b").collect()}
    assert got == {p for p in want if {2, 3} & set(p[1:])}


def test_groups_of_crowded_buckets_against_brute_force(spark):
    rows = variants(5, 25)
    spec = nd.Similarity(kind="words", width=3, least=5, threshold=0.5, bucket_cap=1, broadcast_rows=3)
    root = {i: i for i, _ in rows}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in brute(rows):
        x, y = sorted((top(a), top(b)))
        root[y] = x
    df = spark.createDataFrame(rows, "id bigint, text string")
    assert {r.id: r.group_id for r in nd.groups([nd.Field("f", df, "id", "text", spec)]).collect()} == {i: top(i) for i in root}


def test_many_variants_of_one_template_are_grouped(spark):
    """20,000 texts that are all alike: no bucket is paired out."""
    same = " ".join(f"word{i}" for i in range(60))
    df = spark.range(20_000).select("id", F.concat(F.lit(same), F.lit(" of number "), F.col("id").cast("string")).alias("text"))
    got = nd.groups([nd.Field("f", df, "id", "text", WORDS)])
    assert got.groupBy("group_id").count().collect()[0]["count"] == 20_000


def test_fields_do_not_meet(spark):
    df = spark.createDataFrame([(1, "one two three four five six"), (2, "one two three four five six")], "id bigint, text string")
    fields = [nd.Field("a", df, "id", "text", WORDS), nd.Field("b", df.where("id = 2"), "id", "text", WORDS)]
    assert [tuple(r) for r in nd.record_pairs(nd.class_links(fields)).collect()] == [("a", 1, 2)]


def test_pairs_at_the_threshold_are_found(spark):
    """Of pairs at a similarity of exactly one half, at least 0.97 (0.984 is expected)."""
    rng = random.Random(9)
    rows = []
    for _ in range(2000):
        base = [f"w{rng.randrange(10**9)}" for _ in range(62)]
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(base[:42] + [f"x{rng.randrange(10**9)}" for _ in range(20)]))]
    assert len(shingles(rows[0][1]) & shingles(rows[1][1])) * 2 == len(shingles(rows[0][1]) | shingles(rows[1][1]))
    assert len(found(spark, rows)) >= 0.97 * 2000


def test_no_step_moves_the_keys_of_all_bands(spark, monkeypatch):
    """A step shuffles a few bands' keys with their nodes (12 bytes each, 64 of them a set), and none is kept in a cache that spills to disk."""
    sc, n = spark.sparkContext._jsc.sc(), 4000
    df = spark.range(0, n, 1, 2).select("id", F.expr("array_join(transform(sequence(1, 30), i -> sha1(concat(id, ' ', i))), ' ')").alias("text"))
    moved = []

    def written():
        sc.listenerBus().waitUntilEmpty(30_000)
        return sc.statusStore().executorList(True).apply(0).totalShuffleWrite()

    def cut(x):
        before = written()
        out = runtime.cut(x)
        moved.append(written() - before)
        return out

    monkeypatch.setattr(nd, "cut", cut)
    monkeypatch.setattr(type(df), "persist", lambda *a: pytest.fail("persisted"))
    assert nd.class_links([nd.Field("f", df, "id", "text", WORDS)]).links.count() == 0
    assert sum(moved) > 64 * 4 * n and max(moved) < 16 * 12 * n


def test_what_is_released_is_gone(spark):
    at = lambda df: df._jdf.queryExecution().analyzed().rdd().getCheckpointFile().get().removeprefix("file:")
    kept, gone = runtime.cut(spark.range(10)), runtime.cut(spark.range(10))
    runtime.release(gone)
    assert not os.path.exists(at(gone)) and os.path.exists(at(kept)) and kept.count() == 10
