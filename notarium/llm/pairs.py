"""Prompt and response pairs whose response is missing, declined, copied, in another language or cut short.

Responses are sorted by text and compared with their neighbours (``neighbours``):
one that others go on from is a shortened version. As most responses differ in
names and numbers, their units are sorted and compared as frames too
(``endings``): a last unit that others go on from, and that never ends like
this, is shortened. Lengths that very many responses have are limits. The rules
for empty, declined, copied and foreign responses apply in that order before;
the first defect counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notarium.llm import words as wd
from notarium.llm.endings import judged
from notarium.llm.neighbours import followed

#: Frequent function words by language.
FUNCTION_WORDS = {
    "en": "the a an of to is was were and that this it its in for with not but no are be been by from has have how only then about which there their they what why who when while yet i my your you we our do did does must will would can cannot without before after between during",
    "de": "der die das den dem des ein eine einen einem einer und ist war wird wurde nicht mit von zu zum zur auf im in bei für sich als auch aber noch es dass wie warum ich wir sie ihr mein kein keine keinen nach vor zwischen während ohne über",
    "fr": "le la les l un une des du de et est sont dans pour pas ne que qui sur avec au aux ce cette ces il elle nous vous je mon sans par plus n d s se en été être avant après pendant entre pourquoi comment où",
    "es": "el la los las un una unos y es son de del en que no se por para con al lo su sus como más pero sin qué cómo cada este esta yo me mi nos fue antes después entre durante todavía",
    "ru": "и в во не на что с со по из к ко как это а но для от за я мы вы он она оно они его её их мне меня без до при под между же ли уже ещё почему около после перед",
}
#: What an answerer declines to do, and what about, in English.
_TASK = r"(summari[sz]e|describe|help|assist|answer|write|discuss|provide|share|comment|explain|comply|respond|continue|complete|fulfil+|process|produce|offer|repeat|paraphrase|do (that|this|so|it))"
_MATTER = r"(request|note|content|text|topic|question|document|passage|message|task)"
#: How an answerer declines, by language, in lower case and outside quotation marks.
REFUSALS = (
    rf"\bi (can ?not|can['’]t|won['’]t|will not|wouldn['’]t|must (decline|refuse|pass)|(have|need) to (decline|refuse|pass)|decline|refuse|do(n['’]t| not) feel (comfortable|able)|am (not (able|allowed|permitted|in a position)|unable))\b",
    rf"\bwe ((can ?not|can['’]t|won['’]t|will not|are (unable|not able|not allowed) to) {_TASK}|must decline|(have|need) to decline|decline (this|that|the {_MATTER}|to {_TASK}))\b",
    r"\bi['’]m (sorry|afraid|unable|not (able|allowed|permitted|in a position))\b",
    r"\bi['’]?m? ?(have been |was )?(not |un)(able|permitted|allowed)\b",
    r"\bi am allowed to\b|\b(is|it['’]s|be) (impossible|not possible) for me\b|\bnot something i (can|am|may|could|will)\b",
    r"\bas an? (ai|artificial|large|language)\b",
    r"\b(against|violates?) (my|our) (guidelines|policy|policies|rules|programming)\b",
    r"(^|[.!?]\W+)(my|our) (apologies|regrets)\b(?! list)\W*(but|,|\.|!|:|$)",
    rf"^\W*(sorry|apologies)\b|^\W*unfortunately\W+(i\b|this {_MATTER} (is|can|falls|goes)|that is not something|my\b)",
    r"(^|\P{L})я (не (могу|вправе|имею права|в состоянии|смогу|буду|готов)|вынужден|отказываюсь)",
    r"(^|\P{L})мне (не разрешено|невозможно|не позволено|нельзя|запрещено|очень жаль)",
    r"(^|\P{L})вынужден\w* (отказаться|отклонить)|^\W*(извините|простите|прошу прощения|как языковая модель)|^\W*к сожалению[^.!?]*\P{L}(я|мне|мой|моих|мои)\P{L}",
    r"tut mir leid|\bmir (nicht|leider nicht) (möglich|erlaubt|gestattet)\b|\b(kann|darf|möchte|werde|muss) ich\b[^.!?]*\b(nicht|kein\w*|ablehnen|verweigern)|\bich (kann|darf|möchte|werde)\b[^.!?]*\b(nicht|keine?\w*)\b|\bich bin (leider )?(nicht (befugt|berechtigt|in der lage|imstande|autorisiert|bereit)|außerstande)|\bich bin\b[^.!?]*\bnicht (befugt|berechtigt|in der lage|imstande|autorisiert)\b|\bmuss (ich|das|dies\w*)\b[^.!?]*\bablehnen|\bich muss\b[^.!?]*\b(ablehnen|verweigern|passen)|^\W*leider\b[^.!?]*\b(ich|mir|mich|meine\w*)\b|als sprachmodell",
    r"^\W*désolée?\b|\bje (ne (peux|suis|saurais|puis|veux)|dois (refuser|décliner)|refuse|regrette|suis désolée?|suis (incapable|dans l['’]impossibilité))|\bdois refuser\b|\bil m['’]est (impossible|interdit|défendu)\b|en tant que modèle",
    r"\blo siento\b|\b(no (puedo|podré|podría|estoy autorizad\w|se me permite|me está permitido|me es posible))\b|^\W*(lamento|me temo)\b|^\W*(lamentablemente|por desgracia)\b[^.!?]*\b(no (puedo|podré|debo|se me|me)|me|mis?|debo)\b|\bme (es|resulta) imposible\b|\bdebo (rechazar|negarme|declinar|decir que no)\b|\btengo que (rechazar|negarme|declinar|decir que no)\b|como modelo de lenguaje",
)
_SENTENCES = re.compile(r"(?<=[.!?…])\s+")
_QUOTED = r"“[^”]*”|„[^“”]*[“”]|«[^»]*»|\"[^\"]*\"|`[^`]*`|‘[^’]*’"


def language(text: Column) -> Column:
    """The key of ``FUNCTION_WORDS`` with most words in ``text``, null if two have as many; without any, ru for Cyrillic letters, else null."""
    plain = F.lower(F.regexp_replace(text, r"`[^`]*`", " "))
    found = F.regexp_extract_all(plain, F.lit(r"(\p{L}+)"), 1)
    votes = F.sort_array(F.array(*[F.struct(F.size(_members(found, listed.split())).alias("n"), F.lit(k).alias("lang")) for k, listed in FUNCTION_WORDS.items()]), asc=False)
    return F.when(votes[0]["n"] > votes[1]["n"], votes[0]["lang"]).when((votes[0]["n"] == 0) & plain.rlike("[а-яё]"), "ru")


def _members(found: Column, own: list[str]) -> Column:
    return F.filter(found, lambda w: w.isin(*own))


def refuses(text: Column) -> Column:
    """Whether a text declines; what it quotes doesn't count."""
    said = F.lower(F.regexp_replace(text, _QUOTED, " "))
    out = F.lit(False)
    for p in REFUSALS:
        out = out | said.rlike(p)
    return F.coalesce(out, F.lit(False))


def _covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, share): of the answer's sentence that is least taken from the lead, the share of words in pairs, of neighbours or with one word between, that the lead has too."""
    for batch in batches:
        shares = []
        for lead, answer in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            a = wd.split(lead)
            near, far, least = set(pairwise(a)), set(zip(a, a[2:], strict=False)), None
            for words in filter(lambda w: len(w) > 2, map(wd.split, _SENTENCES.split(answer))):
                kept = [False] * len(words)
                for gap, known in ((1, near), (2, far)):
                    for k, pair in enumerate(zip(words, words[gap:], strict=False)):
                        if pair in known:
                            kept[k] = kept[k + gap] = True
                share = sum(kept) / len(words)
                least = share if least is None else min(least, share)
            shares.append(least or 0.0)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shares, pa.float64())], names=["id", "share"])


def copies(pairs: DataFrame, covered: float = 0.65, shared: float = 0.5) -> DataFrame:
    """(id) of ``pairs`` (id, lead, answer) whose answer is nothing but sentences of the lead.

    Of each sentence of three or more words, ``covered`` of the words must stand
    next or next but one to the same word in the lead, so that typing errors
    don't matter.
    Only answers that share ``shared`` of their different words with the lead
    are looked at; the work is linear in the texts.
    """
    bag = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}]+)"), 1))
    x = pairs.withColumn("a", bag("lead")).withColumn("b", bag("answer")).where(F.size("b") > 0).where(F.size(F.array_intersect("a", "b")) >= shared * F.size("b"))
    return x.select("id", "lead", "answer").mapInArrow(_covered, "id bigint, share double").where(F.col("share") >= covered).select("id")


def shortened(answers: DataFrame) -> DataFrame:
    """(text) of the ``answers`` (text) that others start with and go on from, not just with the end of the sentence."""
    rows = answers.select("text", F.lit(1).cast("bigint").alias("n"), F.lit(True).alias("asked"))
    return followed(rows, lambda c: c not in ".!?…").select("text")


def continued(frames: DataFrame, asked: DataFrame) -> DataFrame:
    """(frame, goes_on) of ``asked`` (frame): how many units of ``frames`` (frame, went) go on from it, by comparing sorted neighbours."""
    rows = frames.where("went > 0").select(F.col("frame").alias("text"), F.col("went").alias("n"), F.lit(False).alias("asked"))
    rows = rows.unionByName(asked.select(F.col("frame").alias("text"), F.lit(0).cast("bigint").alias("n"), F.lit(True).alias("asked")))
    return followed(rows, lambda c: c == " ").select(F.col("text").alias("frame"), F.col("good").alias("goes_on"))


def spikes(lengths: DataFrame, around: int = 8, times: float = 4.0, least: int = 12) -> DataFrame:
    """(size) of ``lengths`` (size), one row a response: lengths that at least ``least`` responses have, and ``times`` as many as a length nearby has on average."""
    n = lengths.groupBy("size").agg(F.count("*").alias("n"))
    near = F.sum("n").over(Window.orderBy("size").rangeBetween(-around, around)) - F.col("n")  # a row a length
    return n.withColumn("near", near / (2 * around)).where((F.col("n") >= least) & (F.col("n") >= times * F.col("near"))).select("size")


def defects(notes: DataFrame, covered: float = 0.65) -> DataFrame:
    """(note_id, defect) for each note with a summary made (``sum_hash`` not null) that is defective, the first defect only.

    ``notes`` needs note_id, lead, summary and sum_hash; other columns are
    ignored and repeated rows count once. Notes without id are left out. A null
    or wordless summary is ``empty``; without a lead nothing is a copy or in a
    foreign language; languages count only where both sides tell theirs.
    """
    made = notes.where("sum_hash is not null and note_id is not null").select(F.col("note_id").alias("id"), "lead", F.col("summary").alias("answer")).dropDuplicates(["id"])
    made = made.withColumn("empty", ~F.coalesce(F.col("answer").rlike(r"[\p{L}\p{N}]"), F.lit(False)))
    said = made.where("not empty")
    own, theirs = language(F.col("answer")), language(F.col("lead"))
    texts = said.select((F.col("id") * 2).alias("id"), F.col("answer").alias("text"), own.alias("lang"), F.lit("answer").alias("source")).unionByName(
        said.where("lead is not null").select((F.col("id") * 2 + 1).alias("id"), F.col("lead").alias("text"), theirs.alias("lang"), F.lit("lead").alias("source"))
    )
    ended = judged(texts, continued=continued).where("source = 'answer'").select(F.shiftright("id", 1).alias("id"), "cut", "how")
    sized = said.select("id", F.length("answer").alias("size"))
    full = sized.join(spikes(sized), "size", "left_semi").select("id", F.lit(True).alias("full"))
    bare = F.regexp_replace("answer", r"[^\p{L}\p{N}]+\z", "")
    short = said.select("id", bare.alias("text"))
    short = short.join(shortened(short.select("text")), "text", "left_semi").select("id", F.lit(True).alias("shortened"))
    copied = copies(said.where("lead is not null").select("id", "lead", "answer"), covered).distinct().withColumn("copied", F.lit(True))
    x = made.join(copied, "id", "left").join(ended, "id", "left").join(short, "id", "left").join(full, "id", "left")
    defect = (
        F.when(F.col("empty"), "empty")
        .when(refuses(F.col("answer")), "refusal")
        .when(F.col("copied"), "copy")
        .when(own != theirs, "language")
        .when(F.col("cut") | ((F.col("shortened") | F.col("full")) & (F.col("how") == "loose")), "truncated")
    )
    return x.select(F.col("id").alias("note_id"), defect.alias("defect")).where("defect is not null")
