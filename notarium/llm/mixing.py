"""Sources combined to target shares of all tokens, small ones repeated a capped number of times.

Documents are aggregated by membership pattern (the set of listed sources they
belong to), so what reaches the driver is a row a pattern. There a min-cost flow
routes each pattern's tokens to its sources' quotas; a document's k-th use costs
k - 1, so that repetition spreads evenly. The flow becomes intervals on each
pattern's documents in seeded order, and a document's uses are counted from where its
middle lies in them: prefix sums over hash bins, then within a bin.
"""

from __future__ import annotations

import base64
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notarium.runtime import cut

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: how byte-level BPE vocabularies of this kind split a text before merging.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@cache
def _encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})


def _sized(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path).encode_ordinary
        for batch in batches:
            n = [len(encode(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["id", "n_tokens"])

    return run


def token_counts(docs: DataFrame, id_col: str, text_col: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(id, n_tokens) of each row; null texts have none."""
    x = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).where("id is not null")
    return x.mapInArrow(_sized(tokenizer), "id bigint, n_tokens bigint")


@dataclass(frozen=True)
class Target:
    source: str
    weight: float
    max_repeats: int


class _Flow:
    """Min-cost flow by cheapest augmenting paths, on a graph of patterns and sources."""

    def __init__(self) -> None:
        self.to: list[int] = []
        self.cap: list[int] = []
        self.cost: list[int] = []
        self.out: dict[int, list[int]] = defaultdict(list)

    def edge(self, a: int, b: int, cap: int, cost: int = 0) -> int:
        for x, y, c, w in ((a, b, cap, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.cap.append(c)
            self.cost.append(w)
        return len(self.to) - 2

    def run(self, s: int, t: int, n: int) -> int:
        """The flow from ``s`` to ``t`` over ``n`` nodes; capacities are left as residuals."""
        potential, total = [0] * n, 0
        while True:
            dist: list[float] = [float("inf")] * n
            via = [-1] * n
            dist[s] = 0
            queue: list[tuple[float, int]] = [(0, s)]
            while queue:
                d, x = heappop(queue)
                if d > dist[x]:
                    continue
                for e in self.out[x]:
                    y = self.to[e]
                    if self.cap[e] > 0 and (nd := d + self.cost[e] + potential[x] - potential[y]) < dist[y]:
                        dist[y], via[y] = nd, e
                        heappush(queue, (nd, y))
            if dist[t] == float("inf"):
                return total
            potential = [p + int(d) if d < float("inf") else p for p, d in zip(potential, dist, strict=True)]
            room, x = None, t
            while x != s:
                room = self.cap[via[x]] if room is None else min(room, self.cap[via[x]])
                x = self.to[via[x] ^ 1]
            x = t
            while x != s:
                self.cap[via[x]] -= room
                self.cap[via[x] ^ 1] += room
                x = self.to[via[x] ^ 1]
            total += room


def route(patterns: dict[tuple[str, ...], int], targets: list[Target], total: int, costs: bool = True) -> tuple[int, dict[tuple[tuple[str, ...], str], int]]:
    """(flow, tokens by pattern and source) that fill quotas of ``total`` tokens as far as the patterns' tokens and the caps allow.

    A pattern's tokens may be used as often as the largest cap among its sources
    allows, by one source as often as its own cap; the k-th use costs k - 1.
    Without ``costs`` the flow is as large, by fewer paths.
    """
    names = {t.source: i for i, t in enumerate(targets)}
    weights = sum(t.weight for t in targets)
    flow, start, end = _Flow(), 0, 1
    own = {p: 2 + i for i, p in enumerate(patterns)}
    base = 2 + len(patterns)
    for t in targets:
        flow.edge(base + names[t.source], end, int(total * t.weight / weights))
    edges = {}
    for p, tokens in patterns.items():
        most = max(targets[names[s]].max_repeats for s in p)
        for k in range(most if costs else 1):
            flow.edge(start, own[p], tokens if costs else tokens * most, k)
        for s in p:
            edges[p, s] = flow.edge(own[p], base + names[s], tokens * targets[names[s]].max_repeats)
    got = flow.run(start, end, base + len(targets))
    return got, {k: flow.cap[e ^ 1] for k, e in edges.items() if flow.cap[e ^ 1]}


def plan(patterns: dict[tuple[str, ...], int], targets: list[Target], total: int | None = None) -> dict[tuple[tuple[str, ...], str], int]:
    """Tokens by pattern and source. Without ``total``, the largest mixture that gives every source with tokens its share."""
    have = {s for p, n in patterns.items() if n for s in p}
    some = [t for t in targets if t.source in have and t.weight > 0 and t.max_repeats > 0]
    names = {t.source for t in some}
    kept: dict[tuple[str, ...], int] = defaultdict(int)
    for p, n in patterns.items():
        if q := tuple(s for s in p if s in names):
            kept[q] += n
    if not some:
        return {}
    weights = sum(t.weight for t in some)
    if total is None:
        full = lambda x: route(kept, some, x, costs=False)[0] >= sum(int(x * t.weight / weights) for t in some)
        low, high = 0, sum(n * max(t.max_repeats for t in some) for n in kept.values()) + 1
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if full(mid) else (low, mid)
        total = low
    return route(kept, some, total)[1]


def targets_of(mix: DataFrame, most: int = 10_000) -> list[Target]:
    """The listed sources, repeated rows once; null sources, and weights or caps that are null or not positive, count 0."""
    rows = mix.where("source is not null").select("source", F.col("weight").cast("double"), F.col("max_repeats").cast("int")).dropDuplicates(["source"]).orderBy("source").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} sources")
    return [Target(r.source, max(r.weight or 0.0, 0.0), max(r.max_repeats or 0, 0)) for r in rows]


def mixed(docs: DataFrame, mix: DataFrame, id_col: str = "doc_id", text_col: str = "text", sources: Column | None = None, total: int | None = None, seed: int = 11, tokenizer: str = TOKENIZER, most_patterns: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """(selection, shares).

    selection (id, source, n_tokens, n_uses) has a row for each document and
    source it is used for. shares has a row for each listed source: its
    target_share, reachable_share (of the sources that have tokens),
    actual_share, target_tokens, actual_tokens, available_tokens, n_docs, n_uses
    and the cap max_repeats. ``sources`` is the array of sources of a document,
    by default its column ``source`` alone. Documents of no listed source, or
    without tokens, are never used; repeated ids count once; without ``total``
    the mixture is as large as the caps allow.
    """
    targets = targets_of(mix)
    listed = F.array(*[F.lit(t.source) for t in targets]).cast("array<string>")
    own = sources if sources is not None else F.array("source")
    given = docs.withColumn("\x02p", F.array_sort(F.array_intersect(F.filter(F.coalesce(own, F.array().cast("array<string>")), lambda s: s.isNotNull()), listed))).where(F.size("\x02p") > 0)
    with_pattern = given.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col("\x02p").alias("pattern"))
    sized = cut(_with_tokens(with_pattern, tokenizer).where("id is not null and n_tokens > 0").dropDuplicates(["id"]))
    rows = sized.groupBy("pattern").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("docs")).limit(most_patterns + 1).collect()
    if len(rows) > most_patterns:
        raise ValueError(f"more than {most_patterns} membership patterns")
    patterns = {tuple(r.pattern): r.n for r in rows}
    tokens = plan(patterns, targets, total)
    wanted = {t.source for t in targets if t.weight > 0 and t.max_repeats > 0}
    alike: dict[tuple[str, ...], list[tuple[str, ...]]] = defaultdict(list)
    for p in patterns:
        alike[tuple(x for x in p if x in wanted)].append(p)
    spans, filled = [], defaultdict(int)
    for (p, s), q in sorted(tokens.items()):
        every = sum(patterns[x] for x in alike[p])
        for x in alike[p]:  # patterns that differ in sources of weight 0 only share what the flow gave them
            part = q * patterns[x] // every
            spans.append((list(x), s, filled[x], filled[x] + part, patterns[x]))
            filled[x] += part
    spark = docs.sparkSession
    span = spark.createDataFrame(spans, "pattern array<string>, source string, lo bigint, hi bigint, n bigint")
    bins = 1 << max(0, (max((r.docs for r in rows), default=1) // 2000).bit_length())
    h = sized.withColumn("h", F.xxhash64("id", F.lit(seed))).withColumn("bin", F.shiftrightunsigned("h", 40) % bins)
    sums = h.groupBy("pattern", "bin").agg(F.sum("n_tokens").alias("n"))
    before = sums.withColumn("before", F.sum("n").over(Window.partitionBy("pattern").orderBy("bin")) - F.col("n")).drop("n")
    inner = F.sum("n_tokens").over(Window.partitionBy("pattern", "bin").orderBy("h", "id")) - F.col("n_tokens")
    placed = h.withColumn("inner", inner).join(before, ["pattern", "bin"]).select("id", "pattern", "n_tokens", (F.col("before") + F.col("inner") + F.expr("n_tokens div 2")).alias("at"))
    used = placed.join(F.broadcast(span) if len(spans) <= most_patterns else span, "pattern").withColumn("n_uses", (_ceil_div("hi - at", "n") - _ceil_div("lo - at", "n")).cast("int")).where("n_uses > 0").select("id", "source", "n_tokens", "n_uses")
    actual = used.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("n_uses")).alias("actual_tokens"), F.count("*").alias("n_docs"), F.sum("n_uses").alias("n_uses"))
    avail: dict[str, int] = defaultdict(int)
    for p, n in patterns.items():
        for s in p:
            avail[s] += n
    goal: dict[str, int] = defaultdict(int)
    for (_, s), q in tokens.items():
        goal[s] += q
    weights, reach = sum(t.weight for t in targets), sum(t.weight for t in targets if avail[t.source] and t.max_repeats)
    listing = [(t.source, t.weight / weights if weights else 0.0, t.weight / reach if reach and avail[t.source] and t.max_repeats else 0.0, goal[t.source], avail[t.source], t.max_repeats) for t in targets]
    target = spark.createDataFrame(listing, "source string, target_share double, reachable_share double, target_tokens bigint, available_tokens bigint, max_repeats int")
    both = target.join(actual, "source", "left").fillna(0, ["actual_tokens", "n_docs", "n_uses"])
    every = F.sum("actual_tokens").over(Window.partitionBy(F.lit(0)))  # over the listed sources only
    shares = both.withColumn("every", every).withColumn("actual_share", F.coalesce(F.col("actual_tokens") / F.nullif("every", F.lit(0)), F.lit(0.0)))
    return used, shares.select("source", "target_share", "reachable_share", "actual_share", "target_tokens", "actual_tokens", "available_tokens", "n_docs", "n_uses", "max_repeats")


def _ceil_div(a: str, b: str) -> Column:
    """The least integer not below a / b, for b > 0, in integers."""
    return F.expr(f"(({a}) - pmod({a}, {b})) div {b} + if(pmod({a}, {b}) > 0, 1, 0)")


def _with_tokens(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(id, pattern, n_tokens) of ``docs`` (id, text, pattern)."""
    size = _sized(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for got in size(iter([batch.select([0, 1])])):
                yield pa.RecordBatch.from_arrays([got.column(0), batch.column(2), got.column(1)], names=["id", "pattern", "n_tokens"])

    return docs.select(F.col("id").cast("bigint").alias("id"), F.coalesce("text", F.lit("")).alias("text"), "pattern").mapInArrow(run, "id bigint, pattern array<string>, n_tokens bigint")
