"""Records that share most of their content: MinHash banding, sketch verification, connected components.

Several fields (titles, bodies) go through one plan; nodes never meet across fields.

1. One Python pass over the texts (Arrow batches, numpy) gives each record the
   hash of its shingle set (its node), ``bands * rows`` universal hash minima
   folded into band keys of 32 bits, and a sketch of one bit per minimum. This
   is written out, with keys and sketch only where the task hasn't met the set.
   ``ROUND`` bands at a time are then packed by target partition (one binary row
   holds thousands), paired and reduced to what passes step 4, so that the
   keys of all bands with their nodes are never on disk at once.
2. Records with the same shingle set collapse into one class before anything is
   paired, so a third of all rows being copies costs one aggregation.
3. Each partition of band keys pairs what shares a key. A key held by more than
   ``bucket_cap`` classes isn't paired: each of its classes meets one of them,
   the representative, and for links among the others there is an exact
   prefix-filtered join, so that no link is lost and no bucket is held whole.
4. Candidates are verified by their sketches (XOR and bit counts), the
   survivors by their shingle sets.
5. Groups are found by alternating large-star and small-star.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notarium.llm import words as wd
from notarium.llm.hashing import GOLD, mix64
from notarium.runtime import cut, release

#: Band keys that a task packs at a time, and that a partition of them is made for.
PACKED, PARTITION = 1 << 20, 1 << 21
#: Bands that are paired at a time.
ROUND = 16
#: Members of a class, or holders of a shingle, that meet in one task.
BLOCK = 512
#: Shingle sets that a task remembers, to leave out the bands of their copies.
REMEMBERED = 1_000_000


def word_shingles(texts: list[str | None], width: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, start of each text) of the distinct ``width``-word sequences; none for texts of under ``least`` words."""
    codes, starts = wd.encode(texts)
    return _rolled(codes, starts, width, max(least, width))


def char_shingles(texts: list[str | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The same over ``width``-character substrings of a text's words joined by one space."""
    codes, starts = [], [0]
    for t in texts:
        s = " ".join(wd.split(t))
        codes.append(np.frombuffer(s.encode("utf-32-le"), dtype=np.uint32))
        starts.append(starts[-1] + len(codes[-1]))
    flat = np.concatenate(codes).astype(np.uint64) if codes else np.zeros(0, np.uint64)
    return _rolled(mix64(flat * GOLD + np.uint64(1)), np.array(starts), width, width)


def _rolled(codes: np.ndarray, starts: np.ndarray, width: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``width`` codes within a text, distinct per text, and where each text's begin."""
    n = np.diff(starts)
    if not len(codes) or len(codes) < width:
        return np.zeros(0, np.uint64), np.zeros(len(n) + 1, np.int64)
    h = np.zeros(len(codes) - width + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            h = (h + codes[k : k + len(h)]) * GOLD
            h ^= h >> np.uint64(29)
    h = mix64(h)
    per = np.where(n >= least, np.maximum(n - width + 1, 0), 0)
    owner = np.repeat(np.arange(len(n)), per)
    at = np.repeat(starts[:-1], per) + (np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per))
    h = h[at]
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[new], owner[new]
    return h, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(n)))])


def _family(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return (rng.integers(0, 2**32, count, dtype=np.uint32) | np.uint32(1)), rng.integers(0, 2**32, count, dtype=np.uint32)


def _signer(parts: list[Similarity]):
    """(f, id, node, n, w0, w1, ..., keys) of records (f, id, text), f being the number of a similarity.

    node is the hash of the shingle set, n its size, w the sketch, keys the 32
    bits of each band's key. Of sets that the task has met before w and keys are
    null, and are not worked out.
    """
    one = parts[0]
    a, b = _family(one.bands * one.rows, one.seed)
    longs = one.longs
    names = ["f", "id", "node", "n", *[f"w{k}" for k in range(longs)], "keys"]
    shinglers = [p.shingler() for p in parts]

    def minima(f: int, h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The band keys, a row a set, and the sketches, a column a set, of the sets of hashes that begin ``at``."""
        x = h.astype(np.uint32) ^ ((h >> np.uint64(32)).astype(np.uint32) * np.uint32(0x85EBCA6B))
        keys = np.full((one.bands, len(at)), f, np.uint64)
        bits = np.zeros((longs, len(at)), np.uint64)
        hashed = np.empty_like(x)
        for k in range(one.bands * one.rows):
            np.add(np.multiply(x, a[k], out=hashed), b[k], out=hashed)
            m = np.minimum.reduceat(hashed, at)
            keys[k // one.rows] = mix64(keys[k // one.rows] * GOLD + m + np.uint64(k // one.rows + 1))
            if k < longs * 64:
                bits[k // 64] |= ((m >> np.uint32(12)) & np.uint32(1)).astype(np.uint64) << np.uint64(k % 64)
        return keys.T.astype(np.uint32), bits

    def signed(f: int, ids: np.ndarray, texts: list[str], met: set[int]) -> pa.RecordBatch | None:
        h, starts = shinglers[f](texts)
        sizes = np.diff(starts)
        has = sizes > 0
        if not has.any():
            return None
        sizes = sizes[has]
        node = _node(h, starts[:-1][has], f)
        n = len(node)
        fresh = np.zeros(n, bool)
        for k, v in enumerate(node.tolist()):
            if v not in met:
                fresh[k] = True
                met.add(v)
        sketch, packed = np.zeros((longs, n), np.uint64), np.full(n, None, object)
        if fresh.any():
            ends = np.cumsum(sizes[fresh])
            keys, sketch[:, fresh] = minima(f, h[np.repeat(fresh, sizes)], ends - sizes[fresh])
            packed[fresh] = [k.tobytes() for k in keys]
        words = [pa.array(w.view(np.int64), mask=~fresh) for w in sketch]
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, f, np.int8)), pa.array(ids[has], pa.int64()), pa.array(node.view(np.int64)), pa.array(sizes.astype(np.int32)), *words, pa.array(packed, pa.binary())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for batch in batches:
            fields, ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_pylist()
            edges = [0, *(np.flatnonzero(np.diff(fields)) + 1).tolist(), len(fields)]
            for lo, hi in ((x, min(x + 512, hi)) for lo, hi in pairwise(edges) for x in range(lo, hi, 512)):
                got = signed(int(fields[lo]), ids[lo:hi], texts[lo:hi], met)
                if got:
                    yield got
                if len(met) > REMEMBERED:
                    met.clear()

    return run


def _packer(first: int, bands: int, partitions: int):
    """(part, pack) of rows (node, keys) with the keys of ``bands`` bands from the ``first`` on.

    A pack has what is for one of the ``partitions``: the 32 bits of each key,
    then the 64 bits of each node. Equal keys of different bands go to different
    partitions, if there are as many of these as bands.
    """

    def packs(keys: np.ndarray, nodes: np.ndarray) -> pa.RecordBatch:
        part = (((keys.astype(np.uint64) + np.arange(first, first + bands, dtype=np.uint64)) % np.uint64(partitions)).astype(np.uint16 if partitions < 1 << 16 else np.uint32)).ravel()
        order = np.argsort(part, kind="stable")
        low, nodes = keys.ravel()[order], np.repeat(nodes, bands)[order]
        ends = np.concatenate([[0], np.cumsum(np.bincount(part, minlength=partitions))])
        some = np.flatnonzero(np.diff(ends))
        blobs = [low[ends[p] : ends[p + 1]].tobytes() + nodes[ends[p] : ends[p + 1]].tobytes() for p in some]
        return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "pack"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, nodes, size = [], [], 0
        for batch in batches:
            keys.append(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, bands))
            nodes.append(batch.column(0).to_numpy())
            size += keys[-1].size
            if size >= PACKED:
                yield packs(np.concatenate(keys), np.concatenate(nodes))
                keys, nodes, size = [], [], 0
        if size:
            yield packs(np.concatenate(keys), np.concatenate(nodes))

    return run


def _node(h: np.ndarray, at: np.ndarray, f: int) -> np.ndarray:
    """One hash for each of the sets of hashes that begin ``at``."""
    return mix64((np.add.reduceat(mix64(h + GOLD), at) ^ mix64(np.bitwise_xor.reduceat(mix64(h ^ GOLD), at))) + np.uint64(f))


def _shingled(parts: list[Similarity]):
    """(node, h): the distinct shingle hashes of each record (f, id, text)."""
    shinglers = [p.shingler() for p in parts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fields, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2).to_pylist()
            edges = [0, *(np.flatnonzero(np.diff(fields)) + 1).tolist(), len(fields)]
            for lo, hi in pairwise(edges):
                if lo == hi:
                    continue
                f = int(fields[lo])
                h, starts = shinglers[f](texts[lo:hi])
                has = np.diff(starts) > 0
                if not has.any():
                    continue
                node = _node(h, starts[:-1][has], f)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([starts[:-1][has], starts[-1:]]).astype(np.int32)), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), lists], names=["node", "h"])

    return run


def _pairing(cap: int, most: int = 2 * PARTITION):
    """(a, b, crowded) of the packs of one partition: the nodes that share a key.

    Pairs of a key that at most ``cap`` nodes hold have a < b. Of a key that
    more hold, each node comes out with one of them, its representative a, and
    ``crowded``. Keys are sorted ``most`` at a time; what is known to be crowded
    is given out at once, so a hot key takes no room.
    """

    def out(a: np.ndarray, b: np.ndarray, crowded: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(np.full(len(a), crowded))], names=["a", "b", "crowded"])

    def shared(key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The rows sorted, repeats once, and where each key's begin and how many they are."""
        order = np.lexsort((node, key))
        key, node = key[order], node[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
        key, node = key[new], node[new]
        lo = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
        return key, node, lo, np.diff(np.concatenate([lo, [len(key)]]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, nodes, size, limit = [], [], 0, most
        over: dict[int, int] = {}

        def known(key: np.ndarray, node: np.ndarray) -> Iterator[pa.RecordBatch]:
            """What of the rows belongs to keys known to be crowded; the others are kept."""
            nonlocal size
            if over:
                hot = np.isin(key, np.fromiter(over, np.uint32, len(over)))
                if hot.any():
                    yield out(np.fromiter(map(over.__getitem__, key[hot].tolist()), np.int64, hot.sum()), node[hot], True)
                    key, node = key[~hot], node[~hot]
            keys.append(key)
            nodes.append(node)
            size += len(key)

        def crowds(key: np.ndarray, node: np.ndarray, lo: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for x, m in zip(lo[n > cap], n[n > cap], strict=True):
                over[int(key[x])] = int(node[x])
                yield out(np.full(m - 1, node[x]), node[x + 1 : x + m], True)

        for batch in batches:
            for pack in batch.column(0).to_pylist():
                m = len(pack) // 12
                yield from known(np.frombuffer(pack, np.uint32, m), np.frombuffer(pack, np.int64, m, 4 * m))
                if size > limit:
                    key, node, lo, n = shared(np.concatenate(keys), np.concatenate(nodes))
                    yield from crowds(key, node, lo, n)
                    stay = np.repeat(n <= cap, n)
                    keys, nodes, size = [key[stay]], [node[stay]], int(stay.sum())
                    limit = max(most, 2 * size)
        if not size:
            return
        key, node = np.concatenate(keys), np.concatenate(nodes)
        twice = np.sort(key)
        twice = twice[1:][twice[1:] == twice[:-1]]
        held = np.isin(key, twice)  # keys of one row pair nothing
        if not held.any():
            return
        key, node, lo, n = shared(key[held], node[held])
        yield from crowds(key, node, lo, n)
        for s in np.unique(n[(n > 1) & (n <= cap)]):
            at = lo[n == s]
            i, j = np.triu_indices(s, 1)
            step = max(1, 200_000 // len(i))
            for k in range(0, len(at), step):
                block = node[at[k : k + step, None] + np.arange(s)]
                yield out(block[:, i].ravel(), block[:, j].ravel(), False)

    return run


@dataclass(frozen=True)
class Similarity:
    """What counts as similar: ``kind`` words or chars, shingle ``width``, fewest words ``least``, Jaccard ``threshold``.

    A pair at similarity s is found with probability 1 - (1 - s**rows)**bands,
    at the defaults 0.984 at s = 0.5 and 0.9999 at 0.6.
    """

    kind: str = "words"
    width: int = 5
    least: int = 1
    threshold: float = 0.8
    bands: int = 64
    rows: int = 4
    bucket_cap: int = 256
    seed: int = 7
    #: Row count up to which ids are broadcast; more are joined by a shuffle.
    broadcast_rows: int = 1_000_000

    @property
    def longs(self) -> int:
        """64-bit words of a sketch."""
        return self.bands * self.rows // 64

    @property
    def most_off(self) -> int:
        """Bits in which the sketches of a pair at the threshold may differ: 4.5 standard deviations above the mean."""
        hashes, agree = self.longs * 64, (1 + self.threshold) / 2
        return int(hashes * (1 - agree + 4.5 * math.sqrt(agree * (1 - agree) / hashes))) if hashes else 0

    def shingler(self):
        width, least = self.width, self.least
        if self.kind == "chars":
            return lambda texts: char_shingles(texts, width)
        return lambda texts: word_shingles(texts, width, least)


@dataclass(frozen=True)
class Field:
    """A text column whose records are compared with each other; ``name`` tells its records in results."""

    name: str
    df: DataFrame
    id_col: str
    text_col: str
    spec: Similarity

    def records(self, f: int) -> DataFrame:
        """(f, id, text) of the rows that have both."""
        x = self.df.select(F.lit(f).cast("tinyint").alias("f"), F.col(f"`{self.id_col}`").cast("bigint").alias("id"), F.col(f"`{self.text_col}`").alias("text"))
        return x.where("id is not null and text is not null")


def _sized(df: DataFrame, limit: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``limit`` rows."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def _blocks(rows: DataFrame, key: str) -> DataFrame:
    """(key, blks): in how many blocks of about ``BLOCK`` the rows of a key are paired; keys of one row pair nothing."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key, F.ceil(F.col("n") / BLOCK).cast("int").alias("blks"))


def pairs_within(rows: DataFrame, key: str, item: str, carried: tuple[str, ...] = (), alone: DataFrame | None = None) -> DataFrame:
    """(a, b, the ``carried`` columns of one), a < b: the items of ``rows``, all different by key and item, that share a key.

    A key's items meet block by block, so that no task has more than two blocks
    of one key. Items that share several keys come out as often. Given ``alone``
    (key, item), only pairs with one of these items are made, some of them twice.
    """
    blks = _blocks(rows, key)
    b = rows.join(blks, key).withColumn("blk", F.when(F.col("blks") > 1, F.pmod(F.xxhash64(item), "blks")).otherwise(0).cast("int"))
    if alone is None:
        l = b.select(key, *carried, F.col(item).alias("x"), F.col("blk").alias("i"), F.explode(F.sequence("blk", F.col("blks") - 1)).alias("j"))
        r = b.select(key, F.col(item).alias("y"), F.explode(F.sequence(F.lit(0), "blk")).alias("i"), F.col("blk").alias("j"))
        met = l.join(r, [key, "i", "j"]).where("i < j or x < y")
    else:
        few = alone.join(blks, key).select(key, *carried, F.col(item).alias("x"), F.explode(F.sequence(F.lit(0), F.col("blks") - 1)).alias("blk"))
        met = few.join(b.select(key, F.col(item).alias("y"), "blk"), [key, "blk"]).where("x <> y")
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), *carried)


def _prefixes(sets: DataFrame, thresholds: Column) -> DataFrame:
    """(s, node) of ``sets`` (f, node, h): the rarest shingles of each, of which two sets at the threshold must share one."""
    each = sets.select("f", "node", F.size("h").alias("n"), F.explode("h").alias("s"))
    df = each.groupBy("f", "s").agg(F.count("*").alias("df")).where("df > 1")
    ranked = each.join(df, ["f", "s"]).groupBy("node").agg(F.max("n").alias("n"), F.first("f").alias("f"), F.array_sort(F.collect_list(F.struct("df", "s"))).alias("x"))
    # shingles of one holder come first in every prefix and link nothing, so they only use it up
    keep = (F.col("n") - F.ceil(thresholds * F.col("n")) + 1 - (F.col("n") - F.size("x"))).cast("int")
    return ranked.where(keep > 0).select("node", F.explode(F.slice(F.col("x.s"), F.lit(1), keep)).alias("s"))


@dataclass(frozen=True)
class Linked:
    """members (field, node, id), one row a record; links (a, b, similarity) between nodes, a < b; crowds: whether there were overfull buckets."""

    members: DataFrame
    links: DataFrame
    crowds: bool


def class_links(fields: list[Field], connected: bool = False) -> Linked:
    """The classes of the records of ``fields`` and the links between them.

    A node is the class of all records with one and the same shingle set.
    Records without text, without id or with too few words belong to no class.
    Repeated rows count once. Tables may be empty; their other columns don't
    matter. With ``connected``, links of overfull buckets are left out where
    both ends have one to the bucket's representative, so that what hangs
    together is the same with links of the order of the nodes.
    """
    parts = [x.spec for x in fields]
    one = parts[0]
    if any((p.bands, p.rows, p.bucket_cap, p.seed) != (one.bands, one.rows, one.bucket_cap, one.seed) for p in parts):
        raise ValueError("fields compared together need the same bands, rows, cap and seed")
    per = lambda of: reduce(lambda rest, k: F.when(F.col("f") == k, of(parts[k])).otherwise(rest), range(1, len(parts)), F.lit(of(one)))
    records = reduce(DataFrame.unionByName, [x.records(k) for k, x in enumerate(fields)])
    words = [f"w{k}" for k in range(one.longs)]
    spark = records.sparkSession
    count = sum(x.df.count() for x in fields)
    schema = ", ".join(["f tinyint, id bigint, node bigint, n int", *[f"{w} bigint" for w in words], "keys binary"])
    signed = cut(records.mapInArrow(_signer(parts), schema))
    own, fresh = cut(signed.select("f", "id", "node")), signed.where("keys is not null")
    classes = cut(fresh.groupBy("node").agg(*[F.first(c).alias(c) for c in ("f", "n", *words)], F.min("id").alias("id")))
    l, r = classes.select(F.col("node").alias("a"), "f", "n", *words, F.col("id").alias("id_a")), classes.select(F.col("node").alias("b"), F.col("n").alias("m"), *[F.col(w).alias(f"{w}_b") for w in words], F.col("id").alias("id_b"))
    off = sum((F.bit_count(F.col(w).bitwiseXOR(F.col(f"{w}_b"))) for w in words), F.lit(0))
    like = (F.least("n", "m") >= per(lambda p: p.threshold) * F.greatest("n", "m")) & (off <= per(lambda p: p.most_off))
    rounds = []
    for lo in range(0, one.bands, ROUND):
        bands = min(ROUND, one.bands - lo)
        partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(count * bands / PARTITION))
        packs = fresh.select("node", F.substring("keys", 4 * lo + 1, 4 * bands).alias("keys")).mapInArrow(_packer(lo, bands, partitions), "part int, pack binary").repartitionById(partitions, F.col("part")).select("pack")
        # a pair has one bucket after another in several partitions; they meet where the sketch of a is
        met = packs.mapInArrow(_pairing(one.bucket_cap), "a bigint, b bigint, crowded boolean").repartition("a").groupBy("a", "b").agg(F.max("crowded").alias("crowded"))
        rounds.append(cut(met.join(l, "a").join(r, "b").where(F.col("crowded") | like).select("a", "b", "f", "id_a", "id_b", "crowded")))
    release(signed)
    close = reduce(DataFrame.unionByName, rounds)  # pairs that several rounds found come as often
    members = own.select(F.element_at(F.array(*[F.lit(x.name) for x in fields]), F.col("f") + 1).alias("field"), "node", "id").repartition("node").distinct()

    def sets_of(ids: DataFrame) -> DataFrame:
        """(node, h), several times for repeated rows."""
        return records.join(_sized(ids, one.broadcast_rows), ["f", "id"], "left_semi").mapInArrow(_shingled(parts), "node bigint, h array<bigint>")

    def verified(pairs: DataFrame) -> DataFrame:
        """(a, b, similarity) of the ``pairs`` (a, b, f, id_a, id_b) at their thresholds."""
        sets = sets_of(pairs.select("f", F.explode(F.array("id_a", "id_b")).alias("id")).distinct()).dropDuplicates(["node"])
        both = pairs.select("a", "b", "f").distinct().join(sets.toDF("a", "h"), "a").join(sets.toDF("b", "g"), "b").select("a", "b", "f", F.size("h").alias("x"), F.size("g").alias("y"), F.size(F.array_intersect("h", "g")).alias("z"))
        return both.withColumn("similarity", F.expr("z / (x + y - z)")).where(F.col("similarity") >= per(lambda p: p.threshold)).select("a", "b", "similarity")

    crowd = close.where("crowded").select("f", F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("id_a").alias("id")), F.struct(F.col("b").alias("node"), F.col("id_b").alias("id")))).alias("x")).select("f", "x.*").distinct()
    if crowd.isEmpty():
        return Linked(members, verified(close), False)
    links = cut(verified(close))
    sets = cut(sets_of(crowd.select("f", "id")).dropDuplicates(["node"]).join(crowd, "node").select("f", "node", "h"))
    prefixes = cut(_prefixes(sets, per(lambda p: p.threshold)))
    alone = None
    if connected:
        apart = close.where("crowded").join(links, ["a", "b"], "left_anti").select(F.col("b").alias("node")).distinct()
        alone = prefixes.join(apart, "node", "left_semi")
    more = pairs_within(prefixes, "s", "node", alone=alone).distinct()
    more = more.join(crowd.select(F.col("node").alias("a"), "f", F.col("id").alias("id_a")), "a").join(crowd.select(F.col("node").alias("b"), F.col("id").alias("id_b")), "b")
    every = links.unionByName(verified(cut(more))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity")
    return Linked(members, every.distinct(), True)


def record_pairs(linked: Linked) -> DataFrame:
    """(field, id_a, id_b), id_a < id_b: the links and classes written out record by record.

    The records of a class meet block by block, so that a class of a third of
    all records is no single task; links of such classes are split as skewed joins.
    """
    m = linked.members
    within = pairs_within(m, "node", "id", ("field",)).select("field", "a", "b")
    across = linked.links.join(m.select("field", F.col("node").alias("a"), F.col("id").alias("x")), "a").join(m.select(F.col("node").alias("b"), F.col("id").alias("y")), "b")
    return within.unionByName(across.select("field", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))).withColumnsRenamed({"a": "id_a", "b": "id_b"})


def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node connected with node, for every node of ``edges`` (a, b).

    Alternating large-star and small-star until nothing changes; every round is
    written to the checkpoint folder. Stars are never gathered: each step is a
    minimum per node (combined before the shuffle) joined back to the edges.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    told = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        e = cut(small)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == told:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        told = now


def groups(fields: list[Field]) -> DataFrame:
    """(field, id, group_id): one row a record with shingles; group_id is the smallest id of the records it hangs together with."""
    linked = class_links(fields, connected=True)
    roots = components(linked.links)
    at = linked.members.join(roots, "node", "left").select("field", "id", F.coalesce("root", "node").alias("root"))
    first = at.groupBy("root").agg(F.min("id").alias("group_id"))
    return at.join(first, "root").select("field", "id", "group_id")
