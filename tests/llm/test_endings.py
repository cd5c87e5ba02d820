import random

from notarium.llm import endings, truncated

NOUNS = ["cache", "journal", "socket", "packet", "mirror", "ledger", "splitter", "window", "follower", "breadcrumb"]
FRAMES = ["The {a} merges faster than the {b}, so the alarm stays off.", "Nothing in the {a} depends on the {b} any more.", "There are {n} ways to reach the {a}, most of them partial.", "Turning the {a} off costs {n} ms per {b} after a restart."]


def corpus(n=300, seed=2):
    rng = random.Random(seed)
    s = lambda: rng.choice(FRAMES).format(a=rng.choice(NOUNS), b=rng.choice(NOUNS), n=rng.randrange(9, 99))
    return [(i, f"# Title\n\n{s()} {s()}\n\n- {s()}\n- {s()}\n\n{s()}", "en", "s1") for i in range(n)]


def judge(spark, rows):
    df = spark.createDataFrame([(*r, 1, "f") for r in [*corpus(), *rows]], "doc_id bigint, text string, lang string, source string, id int, frame string")
    return {r.id: r.cut for r in truncated.truncated(df).collect()}


def test_cut_or_whole(spark):
    cut = ["The cache merges faster than the", "Nothing in the cache depends on the jour", "Nothing in the cache depends…", "There are 12 ways to re [...]", "```\ncode", "| a | b |\n| --- | --- |\n| x | y", "See `cod", "half a charact�", "Turning the socket off costs"]
    whole = ["The cache merges faster than the ledger, so the alarm stays off", "Nothing in the cache depends on the journal any more…", "```\ncode\n```", "| a | b |\n| --- | --- |\n| x | y |", "# A heading", "Nothing in the cache depends on the journal any more.\n\n-- crew 12", "", " \n", "Fine!", "-", "See also: `code`"]
    rows = [(1000 + i, t, "en", "s2") for i, t in enumerate(cut + whole)]
    got = judge(spark, rows)
    assert [t for i, t in enumerate(cut) if not got[1000 + i]] == []
    assert [t for i, t in enumerate(whole, len(cut)) if got[1000 + i]] == []
    assert not any(got[i] for i in range(300))


def test_items_without_stops_end_as_they_are(spark):
    rows = [(4000 + i, f"# T\n\n- [ ] check the {a} of {b}\n- [ ] check the {b} of {a}\n- [ ] check the {a} of {a}", "en", "s3") for i, (a, b) in enumerate((a, b) for a in NOUNS for b in NOUNS)]
    rows += [(4500 + i, f"Please check the cache of the {b} before the {b} is moved.", "en", "s3") for i, b in enumerate(NOUNS)]
    rows += [(4600, "- [ ] check the cache of the ledger\n- [ ] check the cache of", "en", "s3"), (4601, "- [ ] check the cache of the brea", "en", "s3")]
    got = judge(spark, rows)
    assert not any(got[4000 + i] for i in range(100)) and not any(got[4500 + i] for i in range(10)) and got[4600] and got[4601]


def test_length_evidence(spark):
    # cut at 80 characters, where one of them happens to look whole
    s = "There are 10 ways to reach the breadcrumb, most of them partial. " * 2
    rows = [(2000 + i, (f"{i} " + s)[:80], "en", "field") for i in range(6)]
    last = "Turning the cache off costs 10 ms per window after a restart"
    rows.append((2100, "A" * (79 - len(last)) + " " + last, "en", "field"))
    rows.append((2101, last, "en", "field"))
    got = judge(spark, rows)
    assert all(got[2000 + i] for i in range(6)) and got[2100] and not got[2101]


def test_length_evidence_after_rows_headings_and_fences(spark):
    s = "There are 10 ways to reach the breadcrumb, most of them partial. " * 2
    rows = [(2000 + i, (f"{i} " + s)[:80], "en", "field") for i in range(6)]
    ends = ["\n\n| a | b |\n| - | - |\n| x | y |", "\n\n## A heading", "\n\n```\ncode\n```"]
    rows += [(2100 + i, "A" * (80 - len(e)) + e, "en", "field") for i, e in enumerate(ends)]
    rows += [(2200 + i, "A" * (70 - len(e)) + e, "en", "field") for i, e in enumerate(ends)]
    rows += [(2300 + i, "A" * (80 - len(e)) + e, "en", "other") for i, e in enumerate(ends)]
    got = judge(spark, rows)
    assert all(got[2100 + i] for i in range(3))
    assert not any(got[2200 + i] or got[2300 + i] for i in range(3))


def test_pieces_of_very_long_words(spark):
    long = "donaudampfschifffahrtselektrizitaetenhauptbetriebswerkbauunterbeamtengesellschaft"
    rows = [(5000 + i, f"Please move it to the {n}.", "en", "s4") for i, n in enumerate(NOUNS * 2)]
    rows += [(5100, f"Please move it to the {long}. Nothing in the cache depends on the journal any more.", "en", "s4")]
    rows += [(5200 + k, f"Please move it to the {long[:k]}", "en", "s5") for k in (12, 39, 40, 41, 42, 60, len(long) - 1)]
    rows += [(5300, f"Please move it to the {long}", "en", "s5"), (5301, f"Please move it to the {long[:50]}q", "en", "s5"), (5302, f"Please move it to the {long[:10]}q", "en", "s5")]
    got = judge(spark, rows)
    assert [k for k in (12, 39, 40, 41, 42, 60, len(long) - 1) if not got[5200 + k]] == []
    assert not any(got[k] for k in (5300, 5301, 5302))


def test_beginnings_against_brute_force(spark):
    rng = random.Random(7)
    known = {"".join(rng.choice("ab") for _ in range(rng.randrange(1, 12))) for _ in range(150)}
    asked = {"".join(rng.choice("ab") for _ in range(rng.randrange(1, 12))) for _ in range(150)}
    df = lambda w: spark.createDataFrame([(x,) for x in sorted(w)], "word string")
    want = {t for t in asked if any(w != t and w.startswith(t) for w in known)}
    got = [r.word for r in endings.beginnings(df(asked), df(known)).collect()]
    assert set(got) == want and len(got) == len(want)


def test_prefixes_against_brute_force(spark):
    rng = random.Random(8)
    units = [" ".join(rng.choice("ab_") for _ in range(rng.randrange(1, 9))) for _ in range(200)]
    asked = {" ".join(rng.choice("ab_") for _ in range(rng.randrange(1, 7))) for _ in range(60)}
    frames = {u: units.count(u) for u in units}
    want = {a: n for a in asked if (n := sum(m for u, m in frames.items() if u.startswith(a + " ")))}
    f = spark.createDataFrame(list(frames.items()), "frame string, went bigint")
    got = endings.prefixes(f, spark.createDataFrame([(a,) for a in sorted(asked)], "frame string")).collect()
    assert {r.frame: r.goes_on for r in got} == want and len(got) == len(want)


def test_marks_at_the_end():
    for mark in ("…", " ...", " [...]", " [ truncated ]", "(More)", "…\n\n [cut]  ", "\ufffd\ufffd", " …" * 5000, "." * 9000, " " * 3000 + "…"):
        assert endings.without_marks("some words" + mark) == "some words"
    for whole in ("some words", "some words.", "", "a [link]", "x" * 1000 + " cut", "ends.."):
        assert endings.without_marks(whole) == whole
    assert endings.without_marks("…" * 10_000) == ""


def test_a_sentence_of_very_many_words(spark):
    """Linear in its words: 200,000 of them, and a last unit that stops inside the same sentence."""
    words = [f"w{i % 997}" for i in range(200_000)]
    got = judge(spark, [(7000, " ".join(words) + ".", "en", "s"), (7001, " ".join(words[:100_000]), "en", "s")])
    assert set(got) >= {7000, 7001} and not got[7000]


def test_gaps(spark):
    got = judge(spark, [(None, "The cache", "en", None), (3000, None, "en", "s"), (3001, "x" * 300_000, None, None), (3002, "- [ ] a\n" * 50_000, "", ""), (3001, "x" * 300_000, None, None)])
    assert 3000 not in got and None not in got and {3001, 3002} <= set(got)
    empty = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string")
    found = truncated.truncated(empty)
    assert found.count() == 0 and truncated.rates(found).count() == 0


def test_rates(spark):
    df = spark.createDataFrame([(1, "a", True), (2, "a", False), (3, None, False)], "id bigint, source string, cut boolean")
    assert {tuple(r) for r in truncated.rates(df).collect()} == {("a", 2, 1, 0.5), (None, 1, 0, 0.0)}


def test_paragraphs():
    assert endings.paragraphs("---\na: 1\n---\n# H\n\none\ntwo\n\n- x\n- [ ] y\n> q") == ([("one two", False), ("x", True), ("y", True), ("q", False)], "")
    assert endings.paragraphs("~~~\n```\nx")[1] == "fence" and endings.paragraphs("| a | b |\n| c |")[1] == "row"
