import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from notarium.llm import split

TEXTS = ["a", "x" * 95, "para one. More.\n\npara two is here.\n\n" * 3, "line\n" * 30, "Sentence one. And two! " * 6, "word " * 40, "y" * 300, "é😀" * 60, "\n \nlead\r\nnext\r\n" + "t. " * 50 + "\n\n  \n", "a\n   \nb" * 12]


def cut(spark, texts, **kw):
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "id int, body string, line int")
    out = {}
    for r in sorted(split.pieces(df, **kw).collect(), key=lambda r: (r.id, r.piece)):
        out.setdefault(r.id, []).append(r)
    return out


def plain(t):
    lines = t.replace("\r\n", "\n").split("\n")
    while lines and not lines[0].strip(" "):
        lines.pop(0)
    while lines and not lines[-1].strip(" "):
        lines.pop()
    return "\n".join(lines)


def check(text, rows, limit, overlap):
    want = plain(text)
    if not want:
        assert rows is None
        return
    assert "".join(r.text[r.shared :] for r in rows) == want
    assert [r.piece for r in rows] == list(range(1, len(rows) + 1)) and {r.n_pieces for r in rows} == {len(rows)}
    assert (len(rows) > 1) == (len(want) > limit)
    lf = text.replace("\r\n", "\n")
    for r, before in zip(rows, [None, *rows], strict=False):
        assert len(r.text) <= limit and 0 <= r.shared <= overlap and want[r.start : r.start + len(r.text)] == r.text
        assert r.shared == 0 or before.text.endswith(r.text[: r.shared])
        assert r.line_start == 5 + lf[: lf.index(want) + r.start].count("\n")


def test_round_trip(spark):
    for limit, overlap in ((40, 10), (100, 0), (64, 63)):
        got = cut(spark, TEXTS, limit=limit, overlap=overlap)
        for i, t in enumerate(TEXTS):
            check(t, got.get(i), limit, overlap)


@settings(max_examples=6, deadline=None)
@given(st.lists(st.text(alphabet="ab .!\n\r é", max_size=200), min_size=10, max_size=30))
def test_any_text(spark, texts):
    got = cut(spark, texts, limit=30, overlap=7)
    for i, t in enumerate(texts):
        check(t, got.get(i), 30, 7)


def test_boundaries(spark):
    (rows,) = cut(spark, ["one two.\n\nthree four. five six\nseven eight nine"], limit=25, overlap=0).values()
    assert [r.text for r in rows] == ["one two.\n\n", "three four. five six\n", "seven eight nine"]
    (rows,) = cut(spark, ["aaaa bbbb cccc dddd eeee"], limit=12, overlap=5).values()
    assert all(r.text.endswith(" ") for r in rows[:-1])
    assert [r.text for r in rows] == ["aaaa ", "aaaa bbbb ", "bbbb cccc ", "cccc dddd ", "dddd eeee"]


def test_gaps(spark):
    df = spark.createDataFrame([(1, None, 3, 9), (2, "", 3, 9), (3, " \n ", 3, 9), (4, "x" * 5000, 0, 9), (5, "y", None, 9)], "id int, body string, line int, piece int")
    got = {r.id: r for r in split.pieces(df).where("piece = 1").collect()}
    assert set(got) == {4, 5} and got[4].line_start is None and got[5].line_start is None and got[4].n_pieces == 3
    assert split.pieces(df.limit(0)).count() == 0
    assert "line_start" in split.pieces(df.drop("line"), line_col=None).columns
    with pytest.raises(ValueError):
        split.pieces(df, limit=10, overlap=10)


def test_very_long(spark):
    for text in ("z" * 1_000_000, "w " * 500_000):
        (rows,) = cut(spark, [text]).values()
        assert sum(len(r.text) - r.shared for r in rows) == len(text)


def test_very_many_pieces(spark):
    """40,000 pieces of one body, each where it belongs."""
    text = "".join(f"line {i:06} of it\n" for i in range(40_000))
    rows = cut(spark, [text], limit=24, overlap=0)[0]
    assert len(rows) == 40_000 and "".join(r.text for r in rows) + "\n" == text or "".join(r.text for r in rows) == text.rstrip("\n")
    assert all(r.line_start == 5 + k and r.start == 18 * k for k, r in enumerate(rows))
