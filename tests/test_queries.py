"""Every query of the core against its SQL, and the parts that SQL doesn't reach."""

import os
import random
from collections import Counter

import duckdb
import pytest

from notarium.operators import digest, enrich, facets, search
from notarium.operators import index as ix
from notarium.plans import registry
from notarium.sources import completion

SF = "/root/testdata/sf0.001"


def rounded(v):
    return round(v, 7) if isinstance(v, float) else v


def compare(spark, query, sql, root=SF):
    con = duckdb.connect()
    for f in os.listdir(root):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{root}/{f}'")
    df = query(spark, root)
    names = sorted(df.columns)
    got = Counter(tuple(map(rounded, r)) for r in df.select(*names).collect())
    found = con.execute(sql)
    own = [d[0] for d in found.description]
    assert sorted(own) == names
    want = Counter(tuple(rounded(r[own.index(n)]) for n in names) for r in found.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query(spark, name):
    compare(spark, registry.QUERIES[name], registry.SQL[name])


def test_written_out_tokens_are_those_asked():
    from notarium.functions import terms
    from notarium.plans import reference_sql

    assert {q: text for q, (text, _) in reference_sql._ASKED.items()} == registry.ASKED
    assert all(toks.split() == terms.tokenize(text) for text, toks in reference_sql._ASKED.values())
    assert [(q, n, lit, toks.split()) for q, n, lit, toks in reference_sql._LITERALS] == [(q, n, lit, terms.tokenize(lit)) for q, text in registry.ASKED.items() if terms.tokenize(text) for n, lit in enumerate(terms.literal_terms(text))]


def test_every_query_has_sql():
    assert registry.SQL.keys() == registry.QUERIES.keys()


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_empty_tables(spark):
    index = ix.empty(spark)
    assert search.search(index, "anything at all").count() == 0
    assert search.search(index, "0xFF", k=0).count() == 0
    assert facets.facets(index.notes).count() == 0
    assert "".join(digest.render(index.notes, digest.DigestOptions())).endswith("Files: 0._\n\n")
    assert enrich.pending(index.notes).count() == 0 and enrich.inputs(index.notes, index.chunks).count() == 0
    assert ix.corpus_stats(index.notes, index.chunks, index.postings).first().avg_len == 0.0
    got, changed = ix.refreshed(index, spark.createDataFrame([], "path string, hash string, mtime timestamp, text string"))
    assert got.chunks.count() == 0 and changed.count() == 0


def test_nulls(spark):
    notes = spark.createDataFrame([("a.md", None, None, None, None, None, None, None, None), ("b/c.md", "h", None, "T", {"k": None, "status": ["x", "x"]}, ["A"], None, "", "h")], ix.NOTES)
    chunks = spark.createDataFrame([(1, "a.md", 0, None, None, None), (2, "b/c.md", 0, "B", 1, "word " * 3), (None, None, None, None, None, "word")], ix.CHUNKS)
    posted = ix.postings(chunks)
    index = ix.Index(notes, chunks, posted, ix.doc_lengths(posted), ix.corpus_stats(notes, chunks, posted))
    assert [r.path for r in search.search(index, "word").collect()] == ["b/c.md"]
    assert {tuple(r) for r in facets.value_counts(notes).collect()} == {("status", "x", 2)}
    text = "".join(digest.render(notes, digest.DigestOptions()))
    assert "### [](a.md)" in text and "`status: x, x`" in text
    assert enrich.inputs(notes, chunks).count() == 2


@pytest.mark.parametrize("most", [0, 9, 40, 200, 24_000])
def test_summary_limits(spark, most):
    notes = spark.createDataFrame([(f"{i}.md", "Tü", "lead", ["A", "B"]) for i in range(3)] + [("none.md", None, None, None)], "path string, title string, lead string, headings array<string>")
    rows = [(100 * i + k, f"{i}.md", "A > B", "ы" * (k % 7) + "x" * i) for i in range(3) for k in range(90)]
    chunks = spark.createDataFrame(rows, "chunk_id bigint, path string, breadcrumb string, body string")
    want = {"none.md": "\n\n\n\n"}
    for i in range(3):
        text = "Tü\n\nlead\n\nA\nB"
        for _, path, crumb, body in rows:
            if path == f"{i}.md" and len(text.encode()) <= most:
                text += f"\n\n{crumb}\n{body}"
        want[f"{i}.md"] = text
    assert {r.path: r.text for r in enrich.inputs(notes, chunks, most).collect()} == want


def test_long_text(spark):
    chunks = spark.createDataFrame([(1, "a.md", 0, "", 1, "Wort " * 200_000)], ix.CHUNKS)
    assert {r.term: r.tf for r in ix.postings(chunks).collect()}["wort"] == 200_000


def test_completion():
    def answering(raw):
        return completion.Completion("u", "k", "m", send=lambda *a: raw)

    assert answering(b'{"content": [{"type": "text", "text": "hi"}]}')("p") == "hi"
    for raw, error in ((b"<html>", completion.NotJson), (b"[]", completion.NotJson), (b'{"error": {"message": "no"}}', completion.ServiceError), (b'{"stop_reason": "refusal"}', completion.Refused), (b'{"content": []}', completion.EmptyAnswer)):
        with pytest.raises(error):
            answering(raw)("p")

    def unreachable(*a):
        raise OSError("no route")

    with pytest.raises(completion.TransportError):
        completion.Completion("u", "k", "m", send=unreachable)("p")
    with pytest.raises(ValueError):
        completion.Completion("u", "", "m")
    with pytest.raises(ValueError):
        enrich.checked_prompt("no place")
    with pytest.raises(ValueError):
        enrich.checked_prompt("%s %s")


@pytest.mark.parametrize("few", [True, False])
def test_places_are_counted_where_the_hits_are(spark, few):
    """Places behind the first ones equal those of the sorted list, ties included; few steps go to the hits, not the hits to one task a query."""
    rng = random.Random(6)
    rows = [(q, c, float(rng.randrange(12))) for q in (1, 2, 3) for c in rng.sample(range(1000), 300)]
    hits = spark.createDataFrame(rows, "query_id bigint, chunk_id bigint, score double")
    every = {(r.query_id, r.chunk_id): r.rank for r in search.ranked(hits).collect()}
    asked = [(q, c) for q, c, _ in rng.sample(rows, 120)] + [(1, 5000)]
    got = search._places(hits, search.ranked(hits, 20), spark.createDataFrame(asked, "query_id bigint, chunk_id bigint"), few)
    assert {(r.query_id, r.chunk_id): r.rank for r in got.collect()} == {k: every[k] for k in asked if k in every}
    if few:
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin [query_id" in plan and not any("SortMergeJoin [query_id#" in line and "score" in line for line in plan.split("\n"))


@pytest.mark.parametrize("shared", [0, 25, 10**9])
def test_first_hits_are_those_of_all_hits(spark, monkeypatch, shared):
    """However many terms count as shared, ties included; queries alike are scored once, by no more chunks than needed."""
    rng = random.Random(4)
    words = [f"word{chr(97 + i)}" for i in range(8)] + [f"name{chr(97 + i)}q" for i in range(20)]
    bodies = [" ".join(rng.choices(words[:8], k=rng.randrange(1, 7)) + rng.sample(words[8:], rng.randrange(2))) for _ in range(300)]
    chunks = spark.createDataFrame([(i, f"{i % 40}.md", 0, "", 1, b) for i, b in enumerate(bodies)], ix.CHUNKS)
    notes = spark.createDataFrame([(f"{i}.md", None, None, None, None, None, None, None, None) for i in range(35)], ix.NOTES)
    posted = ix.postings(chunks)
    posted = posted.unionByName(posted.where("chunk_id % 7 = 0").withColumn("tf", posted["tf"] + 1))
    index = ix.Index(notes, chunks, posted, ix.doc_lengths(posted), ix.corpus_stats(notes, chunks, posted))
    texts = [" ".join(rng.choices(words[:8], k=3) + rng.sample(words[8:], rng.randrange(3))) for _ in range(30)]
    asked = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, *texts[:9], "", "absent", None])], "query_id bigint, text string")
    live = search.live_chunks(index)
    monkeypatch.setattr(search, "SHARED", shared)
    scored = []
    monkeypatch.setattr(search, "_summed", lambda hits, f=search._summed: (scored.append(hits), f(hits))[1])
    got = sorted(tuple(r) for r in search.first_of(index, asked, live, 5).collect())
    n = scored[0].select("query_id", "chunk_id").distinct().count()
    assert got == sorted(tuple(r) for r in search.ranked(search.bm25_of(index, asked, live), 5).select("query_id", "chunk_id", "score", "rank").collect())
    assert n <= 30 * 5 if shared == 0 else n > 30 * 5


def test_titles_do_not_score_all_hits(spark, monkeypatch):
    monkeypatch.setattr(search, "SHARED", 100)
    monkeypatch.setattr(search, "bm25_of", lambda *a: pytest.fail("all hits"))
    compare(spark, registry.QUERIES["search_titles"], registry.SQL["search_titles"])
