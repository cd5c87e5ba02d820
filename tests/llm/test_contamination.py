import random
import re
from collections import Counter

from notarium.llm import contamination as ct
from notarium.llm import words
from notarium.llm import words as wd
from notarium.runtime import cut, table


def item(rng):
    return f"Suppose {rng.choice('abcdef')}{rng.randrange(99)}x loses its {rng.choice(['bridge', 'ledger'])} in the test rack while {rng.randrange(500)} writers wait for the {rng.choice(['late', 'deep'])} mount and name the first record that must be replayed before 0x{rng.randrange(9**6)} is freed"


def found(spark, docs, items, **kw):
    d = spark.createDataFrame([(*x, 1, "p") for x in docs], "doc_id bigint, text string, item_id int, key string")
    i = spark.createDataFrame([(*x, "s", 2) for x in items], "item_id bigint, text string, suite string, doc_id int")
    return ct.matches(d, i, **kw)


def brute(docs, items, width=13):
    grams = lambda t: {tuple(w[k : k + width]) for w in [words.split(t)] for k in range(len(w) - width + 1)}
    own = {i: grams(t) for i, t in items if i is not None}
    return {(d, i) for d, t in docs if d is not None for i, g in own.items() if g & grams(t)}


def setup():
    rng = random.Random(1)
    items = [(i, item(rng)) for i in range(40)]
    filler = lambda n: " ".join(rng.choice(["alpha", "beta", "the", "of", "cache"]) for _ in range(n))
    docs = [(i, filler(80)) for i in range(60)]
    for i in range(20):
        w = items[i][1].split()
        a = rng.randrange(8)
        docs.append((100 + i, f"{filler(9)} *{' '.join(w[a : a + 10 + i % 8])}* {filler(9)}"))
    docs.append((200, item(random.Random(99))))
    return docs, items


def test_against_brute_force(spark):
    docs, items = setup()
    want = brute(docs, items)
    assert want
    assert {tuple(r) for r in ct.leaks(found(spark, docs, items)).collect()} == want
    assert {tuple(r) for r in ct.leaks(found(spark, docs, items, broadcast_windows=5)).collect()} == want


def test_other_numbers_and_names(spark):
    docs, items = setup()
    got = ct.reparameterised(found(spark, docs, items)).collect()
    assert 200 in {r.doc_id for r in got}
    assert all(r.n_changed > 0 and r.n_words >= 20 for r in got)
    leaked = brute(docs, items)
    assert not {(r.doc_id, r.item_id) for r in got} & leaked


def test_gaps(spark):
    docs, items = setup()
    odd = [(None, items[0][1]), (300, None), (301, ""), (302, "a b"), (303, "w " * 300_000 + items[3][1]), (303, "w " * 300_000 + items[3][1])]
    got = {tuple(r) for r in ct.leaks(found(spark, odd, [*items, (None, "x"), (99, None), (98, ""), (97, "too short")])).collect()}
    assert {d for d, _ in got} == {303} and (303, 3) in got
    assert ct.leaks(found(spark, [], items)).count() == 0
    assert ct.leaks(found(spark, docs, [])).count() == 0


def test_names_of_another_number_of_words(spark):
    def text(name, left="first", right="last"):
        return f"In the second trial of this old rack we suppose that the {left} mount is lost to {name} while the other writers wait for a new record of the {right} queue at the end"

    items = [(i, text(f"kor{'abcdefghij'[i]}", f"le{'abcdefghij'[i]}", f"ri{'abcdefghij'[i]}")) for i in range(9)] + [(9, text("tall vorn", "same", "same"))]
    docs = [(1, "So it says. " + text("anna berg", "ux", "vy")), (2, text("berg", "ux", "ux")), (3, text("anna maria berg", "ux", "vy")), (4, text("berg", "ux", "vy"))]
    got = {(r.doc_id, r.item_id): r for r in ct.reparameterised(found(spark, docs, items)).collect()}
    # (1 and 3) more words for one; (2) one for two; (4) one for two, but "same" became two words
    assert {i for d, i in got if d == 1} == set(range(9)) and {i for d, i in got if d == 3} == set(range(9))
    assert (2, 9) in got and (4, 9) not in got
    assert all(r.n_words >= 30 for (d, i), r in got.items() if d in (1, 3))


def test_planted_items_with_other_numbers(spark, sf):
    """Every item with each number, and each word that only this item has, replaced by one other, in a text of its own: recall and precision over all pairs."""
    rng = random.Random(5)
    items = [(r.item_id, r.text) for r in table(spark, sf, "eval_items").collect()]
    filler = [r.text for r in table(spark, sf, "documents").where("length(text) < 2000").orderBy("doc_id").limit(80).collect()]
    holders = Counter(w for _, t in items for w in set(wd.split(t)))
    rows, want = [], set()
    for k, (item, text) in enumerate(items):
        told, changed, out = {}, 0, []
        for w in re.split(r"([^\W_]+)", text):
            low = w.lower()
            if low.isdecimal():
                changed += 1
                w = told.setdefault(low, str(rng.randrange(10_000, 99_999)))
            elif re.search(r"\d", low):
                changed += 1
                w = told.setdefault(low, f"x{rng.randrange(10_000, 99_999)}q7")
            elif holders[low] == 1:
                changed += 1
                w = told.setdefault(low, "".join(rng.choice("bdfklmnrst") + rng.choice("aeiou") for _ in range(4)))
            out.append(w)
        rows.append((k, f"{filler[k % len(filler)]}\n\n{''.join(out)}\n"))
        words = wd.split("".join(out))
        verbatim = any(words[i : i + 13] == wd.split(text)[i : i + 13] for i in range(len(words) - 12))
        if changed and not verbatim and len(words) >= 20:
            want.add((k, item))
    rows += [(1000 + k, t) for k, t in enumerate(filler)]
    found = cut(ct.matches(spark.createDataFrame(rows, "doc_id bigint, text string"), table(spark, sf, "eval_items")))
    got = {(r.doc_id, r.item_id) for r in ct.reparameterised(found).collect()}
    planted = {k for k, _ in enumerate(items)}
    assert len(want) >= 5
    assert len(got & want) >= 0.95 * len(want)
    assert sum(d in planted for d, _ in got) >= 0.9 * len(got)
