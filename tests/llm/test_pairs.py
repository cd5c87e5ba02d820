import random

import pytest
from pyspark.sql import functions as F

from notarium.llm import neighbours, pairs

LEAD = "The limit of twelve was chosen for the cache, because nobody set it. Nothing depends on the journal any more."
SCHEMA = "note_id bigint, lead string, summary string, sum_hash string, id int, text string"


def judge(spark, rows, fill=True):
    whole = ["The note studies how the cache drops the journal at startup.", "Explains the rebuild of the journal on slow links.", "It compares the cache with the socket in the test rack."]
    filler = [(1000 + i, LEAD, whole[i % 3], "h") for i in range(90)] if fill else []
    df = spark.createDataFrame([(*r, 1, "t") for r in [*rows, *filler]], SCHEMA)
    return {r.note_id: r.defect for r in pairs.defects(df).collect()}


def test_defects(spark):
    rows = [
        (1, LEAD, "—", "h"), (2, LEAD, None, "h"), (3, LEAD, "", "h"), (4, LEAD, None, None),
        (5, LEAD, "I cannot help with that request.", "h"), (6, LEAD, "К сожалению, я не вправе описывать это.", "h"),
        (7, LEAD, "Lists refusal phrases such as “I cannot help with this” that the journal counts.", "h"),
        (8, LEAD, "Requests to the cache are declined until the journal is confirmed.", "h"),
        (9, LEAD, "Summary: Nothing depnds on the journal any more.", "h"), (10, LEAD, LEAD.lower(), "h"),
        (11, LEAD, "Nothing depends on the journal any more. The note studies how the cache drops the journal at startup.", "h"),
        (12, LEAD, "Die Notiz beschreibt, wie der Puffer den Schlüssel nach einem Neustart verdrängt.", "h"),
        (13, LEAD, "The note studies how the cache drops the journ", "h"), (14, LEAD, "It compares the cache with the", "h"),
        (15, LEAD, "The note studies how the cache drops the journal at startup", "h"), (15, LEAD, "The note studies how the cache drops the journal at startup", "h"),
        (None, LEAD, "", "h"), (16, None, "It compares the cache with the socket in the test rack.", "h"), (17, "", "", "h"),
    ]
    want = {1: "empty", 2: "empty", 3: "empty", 5: "refusal", 6: "refusal", 9: "copy", 10: "copy", 12: "language", 13: "truncated", 14: "truncated", 17: "empty"}
    assert judge(spark, rows) == want


def test_shortened_versions_over_many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        texts = [f"{i:03} some words that go on" for i in range(50)]
        df = spark.createDataFrame([(t,) for t in texts] + [(t[: len(t) - 1 - i % 9],) for i, t in enumerate(texts)], "text string")
        assert {r.text for r in pairs.shortened(df).collect()} == {t[: len(t) - 1 - i % 9] for i, t in enumerate(texts)}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_gaps_and_long_texts(spark):
    assert judge(spark, [], fill=False) == {}
    long = "word " * 200_000
    assert judge(spark, [(1, long, long, "h"), (2, long, "x" * 500_000, "h")])[1] == "copy"


@pytest.mark.parametrize("parts", [1, 2, 7, 40])
def test_neighbours_against_brute_force(spark, parts):
    rng = random.Random(parts)
    texts = [("".join(rng.choice("ab .") for _ in range(rng.randrange(1, 7))), rng.randrange(1, 4), rng.random() < 0.6) for _ in range(150)]
    texts += [("a" * k, 1, True) for k in range(1, 30)]
    n, asked = {}, set()
    for t, k, a in texts:
        n[t] = n.get(t, 0) + k
        asked |= {t} if a else set()
    df = spark.createDataFrame([*texts, (None, 1, True), ("", 1, True)], "text string, n bigint, asked boolean")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        for allowed in (lambda c: c == " ", lambda c: c not in ".!?…", lambda c: True):
            want = {t: k for t in asked if (k := sum(m for u, m in n.items() if u != t and u.startswith(t) and allowed(u[len(t)])))}
            got = neighbours.followed(df, allowed).collect()
            assert {r.text: r.good for r in got} == want and len(got) == len(want)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_a_later_neighbour_may_go_on(spark):
    df = spark.createDataFrame([("abc",), ("abc. next",), ("abcdef",), ("xy",), ("xy!",)], "text string")
    assert [r.text for r in pairs.shortened(df).collect()] == ["abc"]


def test_spikes_of_lengths(spark):
    sizes = [n for n in range(40, 120) for _ in range(1 + n % 3)] + [100] * 40
    df = spark.createDataFrame([(n,) for n in sizes], "size int")
    assert [r.size for r in pairs.spikes(df).collect()] == [100]
    assert pairs.spikes(df.limit(0)).count() == 0


DECLINED = [
    "I must decline this one.", "I'm afraid I won't be able to describe this note.", "As an AI model I have no view on this.", "Apologies, but this is outside of what I may write about.", "Unfortunately, I cannot answer.", "We cannot summarize this document.", "My apologies, but no.", "That is not something I can help with.",
    "Leider kann ich diese Notiz nicht wiedergeben.", "Es tut mir leid, das geht nicht.", "Ich bin nicht befugt, den Inhalt zu nennen.", "Das darf ich nicht zusammenfassen.",
    "Désolé, je ne peux pas résumer ce texte.", "Je dois refuser cette demande.", "Il m'est impossible de répondre.", "Lo siento, no puedo resumir esta nota.", "Me temo que no es posible.", "Lamentablemente no me está permitido.",
    "Извините, это невозможно.", "К сожалению, я не могу пересказать заметку.", "Мне не разрешено об этом писать.", "Я вынужден отказаться.",
]
INNOCENT = [
    "We will not retry the request more than twice.", "Unfortunately the cache was dropped at startup.", "Our regrets list: the socket pool was too small.", "Leider fiel der Puffer nach dem Neustart aus.", "Ich bin mit dem Ergebnis zufrieden, aber nicht fertig.",
    "We cannot reach the mirror after a restart.", "We are not able to see the second counter.", "The author apologises for the late fix.", "К сожалению, кэш был сброшен.", "Lamentablemente el disco se llenó.", "Nous ne pouvons pas joindre le miroir.", "It says “I cannot help with this” in the log.", "The request is declined until the lease expires.",
]


def test_refusals_in_other_words(spark):
    df = spark.createDataFrame([(t,) for t in [*DECLINED, *INNOCENT]], "t string").select("t", pairs.refuses(F.col("t")).alias("r"))
    got = {r.t: r.r for r in df.collect()}
    assert [t for t in DECLINED if not got[t]] == [] and [t for t in INNOCENT if got[t]] == []


def test_languages(spark):
    texts = {"The note is about the cache.": "en", "un total": None, "La nota es de un disco": "es", "Кэш": "ru", "": None, "`the the`": None, "Die Notiz ist kurz und für alle": "de", "Kubernetes": None}
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", pairs.language(F.col("t")).alias("l"))
    assert {r.t: r.l for r in df.collect()} == texts
