import pytest
from pyspark.sql import functions as F

from notarium.functions import terms
from notarium.functions import text as tx
from notarium.runtime import table


def column(spark, values, make, kind="string"):
    df = spark.createDataFrame([(v,) for v in values], f"v {kind}")
    return [r[0] for r in df.select(make(F.col("v"))).collect()]


def test_identifiers_split(spark):
    got = dict(zip(["MirrorLedgerXML", "flush_old_pages", "TCPProbe7", "0x7C1E22"], column(spark, ["MirrorLedgerXML", "flush_old_pages", "TCPProbe7", "0x7C1E22"], tx.expand_token), strict=True))
    assert {"mirrorledgerxml", "mirror", "ledger", "xml"} <= set(got["MirrorLedgerXML"])
    assert {"flush_old_pages", "flush", "old", "pages"} <= set(got["flush_old_pages"])
    assert {"tcpprobe7", "tcp", "probe"} <= set(got["TCPProbe7"])
    assert got["0x7C1E22"] == ["0x7c1e22", "7c1e22"]


@pytest.mark.parametrize(("a", "b"), [("перегрузки", "перегрузка"), ("compacting", "compacted")])
def test_inflections_share_a_term(spark, a, b):
    x, y = column(spark, [a, b], tx.expand_token)
    assert set(x) & set(y)


def test_identifier_test(spark):
    words = ["0X0b1", "SweepPages", "old_page", "disk::seek", "mirror", "Io", "буфер"]
    assert column(spark, words, tx.ident_like) == [True] * 4 + [False] * 3
    assert [terms.ident_like(w) for w in words] == [True] * 4 + [False] * 3


def test_special_casing_and_separators(spark):
    assert column(spark, ["İΣ", "ΑΣ"], tx.lower) == ["iσ", "ας".replace("ς", "σ")]
    assert column(spark, ["áb c_d Ⅷ x2"], tx.raw_tokens) == [["a", "b", "c_d", "x2"]]


@pytest.mark.parametrize("word", ["", "_", "__", "a", "aB", "ABc1a1", "İstanbul", "ΟΔΟΣ", "x2yZ", "bus", "buses", "glass", "бегущими", "ёлками", "Éclair_ÀLaCarte", "0x", "0X1f", "0xZZ", "camelCaseHTTPServer", "ab12cd_34"])
def test_both_forms_agree_on_odd_tokens(spark, word):
    assert tuple(column(spark, [word], tx.expand_token)[0]) == terms.expand(word)


def test_both_forms_agree_on_the_table(spark, sf):
    raw = table(spark, sf, "chunks").select(F.explode(tx.raw_tokens(F.col("body"))).alias("t")).distinct()
    rows = raw.select("t", tx.expand_token(F.col("t")).alias("x"), tx.stem(tx.lower(F.col("t"))).alias("s")).collect()
    assert len(rows) > 1000
    assert all(tuple(r.x) == terms.expand(r.t) and r.s == terms.stem(terms.lower(r.t)) for r in rows)


def test_counting(spark):
    df = spark.createDataFrame([("aAaA", "aa"), ("x", ""), ("Канал канал", "КАНАЛ"), ("a\nb", "a b")], "h string, n string")
    assert [r[0] for r in df.select(tx.count_fold(F.col("h"), F.col("n"))).collect()] == [2, 0, 2, 0]


def test_literal_terms(spark):
    queries = ["one word", "channel", "кот", "a_b, 'x::y' 0x1", "  ab ", "go"]
    assert column(spark, queries, tx.literal_terms) == [terms.literal_terms(q) for q in queries]
    assert terms.literal_terms("one word") == ["one word"]
    assert terms.literal_terms("ко go") == ["ко go"]
    assert terms.literal_terms("ко") == []
    assert terms.literal_terms("кот") == ["кот"]


def test_snippet(spark):
    def snip(body, query, toks):
        df = spark.createDataFrame([(body, query, toks)], "b string, q string, t array<string>")
        return df.select(tx.snippet(F.col("b"), F.col("q"), F.col("t"))).first()[0]

    long = "filler " * 100 + "needle here"
    got = snip(long, "needle", ["needle"])
    assert "needle" in got and got.startswith("…") and not got.endswith("…")
    assert snip("a\n\n b", "zzz", ["zzz"]) == "a b"
    assert snip(None, "x", ["x"]) == ""
    assert snip("я " * 200 + "цель", "цель", []).endswith("цель")
    assert len(snip("w " * 500, "", [])) == 260


def test_globs(spark):
    names = ["INDEX.md", "a.md", "ab.md", "x[1].md"]
    df = spark.createDataFrame([(n,) for n in names], "v string")
    hits = lambda g: [r.v for r in df.where(tx.matches_glob(F.col("v"), g)).collect()]
    assert hits("?.md") == ["a.md"]
    assert hits("[a-i]*.md") == ["a.md", "ab.md"]
    assert hits("[") == []
    assert hits("INDEX.md") == ["INDEX.md"]


def test_no_ending_hides_a_later_one():
    for endings, n in ((tx.RU_ENDINGS, 43), (tx.EN_ENDINGS, 7)):
        assert len(endings) == n and not [(a, b) for k, b in enumerate(endings) for a in endings[:k] if b.endswith(a)]
