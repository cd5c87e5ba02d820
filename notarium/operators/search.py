"""Ranked search: BM25 and literal matches, fused by reciprocal ranks, one query or many at a time.

Statistics (document frequencies, chunk count, average length) always come from
the whole index; filters only choose which chunks may be hits. Queries are
small: their terms are broadcast after a check of their number.

Only the first ``60 + 2k`` places of either list can reach the first ``k`` of
the fused one, so each task keeps that many rows a query before anything is
sorted (a grouped limit), and the few candidates' places in the other list are
counted, not sorted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from datetime import datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from notarium.functions import dates, terms
from notarium.functions import text as tx
from notarium.operators.index import Index, dense_ids
from notarium.runtime import cut

#: Fixed values of the ranking formulas.
K1, B, RRF = 1.2, 0.75, 60
BROADCAST_TERMS = 200_000
#: Up to so many terms are named in a predicate.
FEW_TERMS = 500
#: A term whose postings times the queries that have it are more is shared: what queries have in common of such terms is scored once.
SHARED = 20_000
#: Scores are compared to so many decimals, so that the order of additions can't decide.
DECIMALS = 9


@dataclass(frozen=True)
class Filters:
    """All that is set must hold: every ``meta`` value, ``path`` as part of the path whatever the case, a date from ``since`` on."""

    meta: dict[str, str] = field(default_factory=dict)
    path: str = ""
    since: datetime | None = None

    def condition(self) -> Column:
        """Over a table with path, meta and mtime."""
        out = F.lit(True)
        if self.path:
            out = out & F.lower("path").contains(self.path.lower())
        for k, v in self.meta.items():
            out = out & dates.meta_has(F.col("meta"), k, v)
        if self.since:
            out = out & F.coalesce(dates.note_date(F.col("meta"), F.col("mtime")) >= F.lit(self.since), F.lit(False))
        return out

    def any(self) -> bool:
        return bool(self.path or self.meta or self.since)


def live_chunks(index: Index, filters: Filters | None = None) -> DataFrame:
    """(chunk_id, path) of the chunks that have a note that passes."""
    notes = index.notes.where(filters.condition()) if filters and filters.any() else index.notes
    return index.chunks.select("chunk_id", "path").join(notes.select("path").distinct(), "path", "left_semi")


def _table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    df = spark.createDataFrame(rows, schema)
    return F.broadcast(df) if len(rows) <= BROADCAST_TERMS else df


def query_terms(spark: SparkSession, queries: dict[int, str]) -> DataFrame:
    """(query_id, pos, term): distinct terms of each query; a query without any has no rows."""
    return _table(spark, [(q, i, t) for q, text in queries.items() for i, t in enumerate(terms.tokenize(text))], "query_id bigint, pos int, term string")


def _posted(index: Index, wanted: set[str]) -> DataFrame:
    """The postings of the wanted terms; for few of them by a predicate that prunes row groups."""
    p = index.postings
    if len(wanted) <= FEW_TERMS:
        return p.where(F.col("term").isin(*sorted(wanted)))
    return p.join(_table(p.sparkSession, [(t,) for t in sorted(wanted)], "term string"), "term", "left_semi")


def _own_terms(queries: dict[int, str]) -> set[str]:
    return {t for text in queries.values() for t in terms.tokenize(text)}


def _literal_rows(queries: dict[int, str]) -> list[tuple[int, int, str, int, str]]:
    """(query, number of the literal, literal, place of the token, token); queries without any term look up nothing."""
    return [(q, n, lit, i, t) for q, text in queries.items() if terms.tokenize(text) for n, lit in enumerate(terms.literal_terms(text)) for i, t in enumerate(terms.tokenize(lit))]


def narrowed(index: Index, queries: dict[int, str]) -> Index:
    """``index`` with the postings of the queries' terms only, read once; document lengths and totals stay those of the whole."""
    wanted = _own_terms(queries) | {r[-1] for r in _literal_rows(queries)}
    return replace(index, postings=cut(_posted(index, wanted)))


def bm25(index: Index, queries: dict[int, str], live: DataFrame) -> DataFrame:
    """(query_id, chunk_id, score) of all live chunks with a term of the query."""
    spark = index.postings.sparkSession
    return _scored(index, query_terms(spark, queries), _posted(index, _own_terms(queries)), live, sum(map(len, queries.values())) <= BROADCAST_TERMS)


def bm25_of(index: Index, asked: DataFrame, live: DataFrame) -> DataFrame:
    """The same for a table of queries (query_id, text) of any size."""
    q = asked.select("query_id", F.posexplode(F.array_distinct(tx.tokenize(F.col("text")))).alias("pos", "term"))
    q = cut(q.dropDuplicates(["query_id", "term"]))
    return _scored(index, q, index.postings.join(q.select("term").distinct(), "term", "left_semi"), live, False)


def _scored(index: Index, q: DataFrame, p: DataFrame, live: DataFrame, few: bool) -> DataFrame:
    df = p.groupBy("term").agg(F.count("*").alias("df"))
    totals = F.broadcast(index.corpus_stats.select("n_chunks", "avg_len"))  # one row
    idf = F.log(1 + (F.col("n_chunks") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = df.join(totals, F.lit(True)).select("term", idf.alias("idf"), "avg_len")
    weighted = q.join(weighted, "term")
    hits = p.join(live.select("chunk_id"), "chunk_id", "left_semi").join(index.doc_len, "chunk_id", "left")
    hits = hits.join(F.broadcast(weighted) if few else weighted, "term")
    return _summed(hits)


def _summed(hits: DataFrame) -> DataFrame:
    """(query_id, chunk_id, score) of ``hits`` (query_id, chunk_id, pos, idf, tf, len, avg_len)."""
    tf, length = F.col("tf").cast("double"), F.coalesce(F.col("len"), F.lit(0)).cast("double")
    part = F.col("idf") * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * length / F.col("avg_len")))
    parts = hits.groupBy("query_id", "chunk_id").agg(F.array_sort(F.collect_list(F.struct("pos", part.alias("s")))).alias("x"))  # at most a query's terms
    return parts.select("query_id", "chunk_id", F.round(F.aggregate("x", F.lit(0.0), lambda a, y: a + y["s"]), DECIMALS).alias("score"))


def _firsts(sets: list[tuple[int, list[int], list[float]]], avg_len: float, k: int):
    """(query_id, chunk_id, s) of rows (chunk_id, len, x): the chunks of each batch that may be the first ``k`` of each of the ``sets`` (id, terms, their idf).

    x holds 32 bits of term and 32 of tf each, sorted. Scores that differ by
    less than their decimals may stand in any order here: all of them come out,
    of equal ones the first ``k`` chunks.
    """
    idf = dict(x for _, terms_, idfs in sets for x in zip(terms_, idfs, strict=True))
    known = np.array(sorted(idf), np.int64)
    weight = np.array([idf[t] for t in known.tolist()])
    members = [(i, np.searchsorted(known, np.array(terms_, np.int64)).tolist()) for i, terms_, _ in sets]
    slack = 2 * 10.0**-DECIMALS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, length, x = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(float), batch.column(2)
            flat = x.flatten().to_numpy()
            owner = np.repeat(np.arange(len(ids)), np.diff(x.offsets.to_numpy()))
            term, tf = flat >> 32, (flat & 0xFFFFFFFF).astype(float)
            at = np.minimum(np.searchsorted(known, term), len(known) - 1)
            keep = known[at] == term
            at, owner, tf = at[keep], owner[keep], tf[keep]
            part = weight[at] * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * length[owner] / avg_len))
            order = np.argsort(at, kind="stable")
            at, owner, part = at[order], owner[order], part[order]
            ends = np.searchsorted(at, np.arange(len(known) + 1))
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for i, own in members:
                score = np.zeros(len(ids))
                for t in own:
                    np.add.at(score, owner[ends[t] : ends[t + 1]], part[ends[t] : ends[t + 1]])
                hit = np.flatnonzero(score)
                if len(hit) > k:
                    hit = hit[score[hit] >= np.partition(score[hit], -k)[-k] - slack]
                if len(hit):
                    hit = hit[np.lexsort((ids[hit], -score[hit]))]
                    start = np.concatenate([[True], score[hit][1:] != score[hit][:-1]])
                    n = np.arange(len(hit))
                    hit = hit[n - np.maximum.accumulate(np.where(start, n, 0)) < k]
                    out.append((np.full(len(hit), i), ids[hit], score[hit]))
            if out:
                q, c, z = map(np.concatenate, zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(c, pa.int64()), pa.array(z)], names=["query_id", "chunk_id", "s"])

    return run


def first_of(index: Index, asked: DataFrame, live: DataFrame, k: int) -> DataFrame:
    """(query_id, chunk_id, score, rank): the first ``k`` (positive) of ``bm25_of``, without the hits of all terms of all queries.

    Queries with the same terms are asked once. Parts of a score are positive,
    so a chunk is among the first only if it has a term that isn't shared, or is
    among the first by the shared terms alone; these are looked for once a set
    of shared terms. Only such chunks are scored by all terms. The postings are
    read once, into a row a chunk.
    """
    q = asked.select("query_id", F.posexplode(F.array_distinct(tx.tokenize(F.col("text")))).alias("pos", "term")).dropDuplicates(["query_id", "term"])
    lists = cut(q.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "term"))), lambda x: x["term"]).alias("terms")).withColumnRenamed("query_id", "id"))
    ids = lists.groupBy("terms").agg(F.min("id").alias("query_id"))
    each = cut(ids.select("query_id", F.posexplode("terms").alias("pos", "term")))
    named = cut(dense_ids(each.groupBy("term").agg(F.count("*").alias("n")), ["term"], "t"))
    few = named.count() <= BROADCAST_TERMS
    hint = lambda df: F.broadcast(df) if few else df
    x = F.array_sort(F.collect_list(F.shiftleft("t", 32).bitwiseOR(F.col("tf").cast("bigint"))))
    rows = index.postings.join(hint(named.select("term", "t")), "term", "left").groupBy("chunk_id").agg(F.sum("tf").alias("len"), x.alias("x"))
    rows = cut(rows.join(live.select("chunk_id", F.lit(True).alias("live")).distinct(), "chunk_id", "left"))
    n_chunks, total = index.chunks.select("chunk_id").distinct().count(), rows.agg(F.sum("len")).first()[0] or 0
    avg_len = total / n_chunks if n_chunks else 0.0
    here = rows.where("live and size(x) > 0").select("chunk_id", "len", "x")
    df = rows.select(F.explode("x").alias("v")).groupBy(F.shiftright("v", 32).alias("t")).agg(F.count("*").alias("df"))
    idf = F.log(1 + (n_chunks - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = named.join(df, "t").select("term", "t", idf.alias("idf"), (F.col("df") * F.col("n") > SHARED).alias("shared"))
    each = cut(each.join(hint(weighted), "term").select("query_id", "pos", "t", "idf", "shared"))
    posted = here.select("chunk_id", F.explode("x").alias("v")).select("chunk_id", F.shiftright("v", 32).alias("t"))
    candidates = posted.join(hint(each.where("not shared").select("query_id", "t")), "t").select("query_id", "chunk_id")
    own = each.where("shared").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", "t", "idf"))).alias("y")).select("query_id", F.col("y.t").alias("ts"), F.col("y.idf").alias("idfs"))
    sets = cut(own.groupBy("ts").agg(F.first("idfs").alias("idfs"), F.min("query_id").alias("id")))
    if (sets.agg(F.sum(F.size("ts"))).first()[0] or 0) > BROADCAST_TERMS:
        return ranked(bm25_of(index, asked, live), k)
    if told := [(r.id, r.ts, r.idfs) for r in sets.collect()]:
        firsts = here.mapInArrow(_firsts(told, avg_len, k), "query_id bigint, chunk_id bigint, s double").select("query_id", "chunk_id", F.round("s", DECIMALS).alias("score"))
        firsts = ranked(firsts, k).select(F.col("query_id").alias("id"), "chunk_id")
        candidates = candidates.unionByName(own.join(sets.select("ts", "id"), "ts").select("query_id", "id").join(firsts, "id").select("query_id", "chunk_id"))
    hits = candidates.distinct().join(here, "chunk_id").select("query_id", "chunk_id", "len", F.explode("x").alias("v")).select("query_id", "chunk_id", "len", F.shiftright("v", 32).alias("t"), F.col("v").bitwiseAND(0xFFFFFFFF).alias("tf"))
    hits = hits.join(hint(each.select("query_id", "pos", "t", "idf")), ["query_id", "t"]).withColumn("avg_len", F.lit(avg_len))
    top = ranked(_summed(hits), k).withColumnRenamed("query_id", "first")
    same = lists.join(ids, "terms").select(F.col("id").alias("query_id"), F.col("query_id").alias("first"))
    return same.join(top, "first").select("query_id", "chunk_id", "score", "rank")


def literal_candidates(index: Index, queries: dict[int, str]) -> DataFrame:
    """(query_id, n, literal, token): each literal term's rarest token, where all its tokens are in the index; the first of equally rare ones.

    A term that is part of a longer word only has a token that needn't exist, and then no candidates.
    """
    spark = index.postings.sparkSession
    rows = _literal_rows(queries)
    wanted = _table(spark, rows, "query_id bigint, n int, literal string, pos int, term string")
    df = _posted(index, {r[-1] for r in rows}).groupBy("term").agg(F.count("*").alias("df"))
    each = wanted.join(df, "term", "left").groupBy("query_id", "n", "literal")
    best = each.agg(F.min_by("term", F.struct("df", "pos")).alias("token"), F.count_if(F.col("df").isNull()).alias("absent"))
    return best.where("absent = 0").select("query_id", "n", "literal", "token")


def literal(index: Index, queries: dict[int, str], live: DataFrame) -> DataFrame:
    """(query_id, chunk_id, score): occurrences of the literal terms in body, breadcrumb and path, weighted by their bytes."""
    best = literal_candidates(index, queries)
    p = _posted(index, {r[-1] for r in _literal_rows(queries)})
    at = p.join(best, p["term"] == best["token"]).select("query_id", "n", "literal", "chunk_id").join(live.select("chunk_id"), "chunk_id", "left_semi")
    c = at.join(index.chunks.select("chunk_id", "path", "breadcrumb", "body"), "chunk_id")
    n = sum((tx.count_fold(F.coalesce(F.col(k), F.lit("")), F.col("literal")) for k in ("body", "breadcrumb", "path")), F.lit(0))
    return c.select("query_id", "chunk_id", (n * F.octet_length("literal")).cast("double").alias("s")).where("s > 0").groupBy("query_id", "chunk_id").agg(F.sum("s").alias("score"))


def ranked(hits: DataFrame, most: int | None = None) -> DataFrame:
    """``hits`` (query_id, chunk_id, score) with ``rank``: by falling score, then chunk; only the first ``most``, if given."""
    at = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    out = hits.withColumn("rank", at)
    return out.where(F.col("rank") <= most) if most else out


def _places(hits: DataFrame, top: DataFrame, wanted: DataFrame, few: bool) -> DataFrame:
    """(query_id, chunk_id, rank) of the ``wanted`` (query_id, chunk_id) in ``hits``, of which ``top`` has the first places.

    Those behind the first places cut their query's list into steps. Each hit
    falls into one step, steps are counted in the tasks and summed up, so that
    no query's hits meet in one task. ``few`` steps are broadcast.
    """
    inside = top.join(wanted, ["query_id", "chunk_id"], "left_semi").select("query_id", "chunk_id", "rank")
    far = wanted.join(top, ["query_id", "chunk_id"], "left_anti").join(hits, ["query_id", "chunk_id"])
    at = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    steps = cut(far.select("query_id", "chunk_id", F.col("score").alias("s"), F.lag("score").over(at).alias("s0"), F.lag("chunk_id").over(at).alias("c0"), F.row_number().over(at).alias("step")))
    ends = steps.withColumnRenamed("chunk_id", "c")
    ahead = lambda s, c: f"(score > {s} or (score = {s} and chunk_id < {c}))"
    within = hits.join(F.broadcast(ends) if few else ends, "query_id").where(f"{ahead('s', 'c')} and (s0 is null or not {ahead('s0', 'c0')})")
    sizes = within.groupBy("query_id", "step").agg(F.count("*").alias("n"))
    up = F.coalesce(F.sum("n").over(Window.partitionBy("query_id").orderBy("step")), F.lit(0))
    return inside.unionByName(steps.join(sizes, ["query_id", "step"], "left").select("query_id", "chunk_id", (up + 1).cast("int").alias("rank")))


def fused(bm: DataFrame, lit: DataFrame, k: int, n_queries: int) -> DataFrame:
    """(query_id, chunk_id, score, exact, rank): both lists of ``n_queries`` queries fused, the first ``k`` (all if it isn't positive)."""
    keys = ["query_id", "chunk_id"]
    if k > 0:
        bm, lit = cut(bm), cut(lit)
        most = RRF + 2 * k
        top_b, top_l = ranked(bm, most), ranked(lit, most)
        wanted = top_b.select(*keys).union(top_l.select(*keys)).distinct()
        few = 2 * most * n_queries <= BROADCAST_TERMS
        a, b = _places(bm, top_b, wanted, few), _places(lit, top_l, wanted, few)
    else:
        a, b = ranked(bm), ranked(lit)
    both = a.select(*keys, F.col("rank").alias("x")).join(b.select(*keys, F.col("rank").alias("y")), keys, "full_outer")
    score = F.coalesce(1.0 / (RRF + F.col("x")), F.lit(0.0)) + F.coalesce(1.0 / (RRF + F.col("y")), F.lit(0.0))
    return ranked(both.select(*keys, score.alias("score"), F.col("y").isNotNull().alias("exact")), k if k > 0 else None)


def search_many(index: Index, queries: dict[int, str], filters: Filters | None = None, k: int = 10) -> DataFrame:
    """(query_id, rank, path, line, title, breadcrumb, score, exact, snippet, body, meta): the hits of each query in order.

    Queries without any term have no hits. Bodies and notes are joined to the
    hits that are left only.
    """
    spark = index.postings.sparkSession
    index = narrowed(index, queries)
    live = live_chunks(index, filters)
    hits = fused(bm25(index, queries, live), literal(index, queries, live), k, len(queries))
    asked = _table(spark, [(q, text, terms.tokenize(text)) for q, text in queries.items()], "query_id bigint, query string, terms array<string>")
    full = hits.join(index.chunks, "chunk_id").join(index.notes.select("path", "title", "meta"), "path", "left").join(asked, "query_id")
    return full.select("query_id", "rank", "path", "line", "title", "breadcrumb", "score", "exact", tx.snippet(F.col("body"), F.col("query"), F.col("terms")).alias("snippet"), "body", "meta")


def search(index: Index, query: str, filters: Filters | None = None, k: int = 10) -> DataFrame:
    """The hits of one query, in order."""
    if not query.strip():
        raise ValueError("the query is empty")
    return search_many(index, {0: query}, filters, k).drop("query_id").orderBy("rank")
