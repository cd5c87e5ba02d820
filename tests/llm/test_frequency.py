import random
from collections import Counter, defaultdict

from notarium.llm import frequency as fr


def brute(rows, live=None):
    total, records = Counter(), defaultdict(set)
    for r, t, n in set(rows):
        if r is not None and t is not None and (live is None or r in live):
            total[t] += n or 0
            records[t].add(r)
    return {t: (total[t], len(s)) for t, s in records.items()}


def count(spark, rows, live=None):
    df = spark.createDataFrame([(*x, "r", [1]) for x in rows], "chunk_id bigint, term string, tf int, range string, terms array<int>").repartition(5)
    keep = None if live is None else spark.createDataFrame([(i,) for i in live], "chunk_id bigint")
    return {r.term: (r.n_total, r.n_records) for r in fr.frequencies(df, "chunk_id", "term", "tf", keep).collect()}


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(rng.randrange(80), rng.choice(["md", f"t{rng.randrange(3000)}", "ё", "", "a\x00b"]), rng.randrange(1, 5)) for _ in range(6000)]
    rows += rows[::7] + [(1, None, 1), (None, "md", 1), (2, "only", None)]
    assert count(spark, rows) == brute(rows)
    live = [*range(0, 60), None, 999]
    assert count(spark, rows, live) == brute(rows, set(live))


def test_repeated_rows_in_several_files(spark, tmp_path):
    rows = [(i, t, 2) for i in range(60) for t in ("md", f"t{i % 20}", f"own{i}")]
    for _ in range(3):
        spark.createDataFrame(rows, "chunk_id bigint, term string, tf int").coalesce(1).write.mode("append").parquet(f"{tmp_path}/rows")
    live = spark.createDataFrame([(i,) for i in range(50)], "chunk_id bigint")
    live.write.parquet(f"{tmp_path}/live")
    got = fr.frequencies(spark.read.parquet(f"{tmp_path}/rows"), "chunk_id", "term", "tf", spark.read.parquet(f"{tmp_path}/live"))
    assert {r.term: (r.n_total, r.n_records) for r in got.collect()} == brute(rows, set(range(50)))


def test_gaps(spark):
    assert count(spark, []) == {}
    long = "x" * 300_000
    assert count(spark, [(1, long, 2), (2, long, 3)]) == {long: (5, 2)}


def test_blocks(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(fr, "_BLOCK", 3)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 1, 2, 2, 3]), pa.array(["a", "b", "a", "a", "c"]), pa.array([1, 2, 3, 4, 5])], names=["r", "t", "n"])
    sums = Counter()
    for b in fr._counted(fr._packed(iter([batch.slice(0, 1), batch.slice(1)]))):
        for r in b.to_pylist():
            sums[r["term"], "n"] += r["n_total"]
            sums[r["term"], "r"] += r["n_records"]
    assert sums == {("a", "n"): 8, ("a", "r"): 2, ("b", "n"): 2, ("b", "r"): 1, ("c", "n"): 5, ("c", "r"): 1}


def test_marks_and_metadata(spark):
    notes = spark.createDataFrame([(i, {"tags": [" A ", "a", None], "owner": None, "title": ["t"], "status": [f"s{i}"]}) for i in [*range(4), 0]] + [(None, {"tags": ["z"]}), (9, None)], "note_id bigint, meta map<string,array<string>>")
    chunks = spark.createDataFrame([(i,) for i in range(4)], "chunk_id bigint")
    postings = spark.createDataFrame([(i, "md", 1) for i in range(4)] + [(7, "stale", 1), (0, "one", 2)], "chunk_id bigint, term string, tf int")
    got = {(r.field, r.val): (r.n_total, r.n_records, r.mark) for r in fr.term_marks(postings, chunks, notes).collect()}
    want = {("term", "md"): (4, 4, "common"), ("term", "one"): (2, 1, "rare"), ("meta.tags", "a"): (8, 4, "common")}
    assert got == want | {("meta.status", f"s{i}"): (1, 1, "rare") for i in range(4)}
