"""Items larger than a limit, cut into overlapping pieces at natural boundaries, inside the JVM.

One regular expression with bounded quantifiers takes an item apart: its
alternatives, ordered by the strength of the boundary they end at, each consume
as much as fits, and the last one falls back to characters. The offset of a
piece is the sum of the lengths before it; the overlap is looked back from
there into the piece before, to the earliest boundary of the strongest kind
within reach. Everything
is array functions over one row, so nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Boundaries by falling strength, as lookbehinds: a blank line, a line end, a sentence end, a space.
BOUNDARIES = (r"(?<=\n {0,40}\n)", r"(?<=\n)", r"(?<=[.!?…。！？][\"'”’»)\]]{0,3}\s)", r"(?<=\s)")

#: Pieces whose offsets are summed up together.
_BLOCK = 128


def taker(room: int) -> str:
    """The expression for the next piece: what is left if that is at most ``room`` characters, else as much as ends at the strongest boundary within them, else ``room`` characters."""
    return "(?s)" + "|".join([rf".{{1,{room}}}\z", *[rf".{{1,{room}}}{b}" for b in BOUNDARIES], rf".{{1,{room}}}"])


def trimmed(body: Column) -> Column:
    """``body`` with LF line ends, without the blank lines before and after its text."""
    lf = F.regexp_replace(body, "\r\n", "\n")
    return F.regexp_replace(F.regexp_replace(lf, r"\A(?: *\n)+", ""), r"(?:\n *)+\z|\A *\z", "")


def pieces(items: DataFrame, body_col: str = "body", line_col: str | None = "line", limit: int = 2000, overlap: int = 200) -> DataFrame:
    """One row a piece: the columns of ``items`` but the body, then piece, n_pieces, start, line_start, shared, text.

    ``piece`` counts from 1; ``start`` is the offset (from 0) of the piece in the
    trimmed body, ``shared`` the number of its first characters that the piece
    before ends with (at most ``overlap``), ``line_start`` the line it starts at:
    ``line_col`` is the line of the body's first line, null or less than 1 (or
    no column) leaves it null. A piece ends at a blank line, else a line end,
    else a sentence end, else a space, else anywhere, and has at most ``limit``
    characters; a CRLF counts as one. Without their shared parts the pieces make
    up the trimmed body, whatever it holds. Items within the limit are one
    piece; null bodies, and bodies without text, are left out. Columns named
    like the ones added are replaced.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be at least 0 and less than the limit")
    room = limit - overlap
    added = ["piece", "n_pieces", "start", "line_start", "shared", "text"]
    keep = [F.col(f"`{c}`") for c in items.columns if c != body_col and c not in added]
    own = lambda name: F.col(f"`\x02{name}`")
    lf = F.regexp_replace(F.col(f"`{body_col}`"), "\r\n", "\n")
    first = F.when(F.col(f"`{line_col}`") >= 1, F.col(f"`{line_col}`")) if line_col else F.lit(None).cast("int")
    x = items.select(*keep, trimmed(F.col(f"`{body_col}`")).alias("\x02t"), _newlines(F.regexp_extract(lf, r"\A((?: *\n)+)", 1)).alias("\x02blank"), first.alias("\x02line")).where(F.length(own("t")) > 0)
    # the first piece has no overlap, but the same room, so that equal texts are cut alike
    cores = F.when(F.length(own("t")) > limit, F.regexp_extract_all(own("t"), F.lit(taker(room)), F.lit(0))).otherwise(F.array(own("t")))
    x = x.withColumn("\x02c", cores).drop("\x02t")
    size = lambda c: F.struct(F.length(c).alias("n"), _newlines(c).alias("lines"))
    x = x.withColumn("\x02z", F.transform(own("c"), size)).withColumn("\x02d", _before(own("z")))
    previous = F.concat(F.array(F.lit("")), F.slice(own("c"), F.lit(1), F.size(own("c")) - 1))
    zipped = F.arrays_zip(own("c").alias("core"), previous.alias("previous"), own("d").alias("at"))
    x = x.select(*keep, own("blank"), own("line"), F.size(own("c")).alias("\x02n"), F.posexplode(zipped).alias("\x02k", "\x02p"))
    piece = lambda f: F.col(f"`\x02p`.{f}")
    x = x.withColumn("\x02s", _overlap(F.when(F.lit(overlap > 0), F.expr(f"right(`\x02p`.previous, {max(overlap, 1)})")).otherwise("")))
    shared = own("s")
    return x.select(
        *keep,
        (own("k") + 1).alias("piece"), own("n").alias("n_pieces"), (piece("at.n") - F.length(shared)).alias("start"),
        (own("line") + own("blank") + piece("at.lines") - _newlines(shared)).cast("int").alias("line_start"), F.length(shared).alias("shared"),
        F.concat(shared, piece("core")).alias("text"),
    )


def _before(sizes: Column) -> Column:
    """For each of ``sizes`` (n, lines) the sum of those before it: within blocks, and over blocks, so that many pieces don't cost their square."""
    none = F.struct(F.lit(0).alias("n"), F.lit(0).alias("lines"))
    plus = lambda a, b: F.struct((a["n"] + b["n"]).alias("n"), (a["lines"] + b["lines"]).alias("lines"))
    sums = lambda xs: F.slice(F.aggregate(xs, F.array(none), lambda acc, s: F.concat(acc, F.array(plus(F.element_at(acc, -1), s)))), F.lit(1), F.size(xs))
    blocks = F.transform(F.sequence(F.lit(1), F.size(sizes), F.lit(_BLOCK)), lambda k: F.slice(sizes, k, F.lit(_BLOCK)))
    starts = sums(F.transform(blocks, lambda b: F.aggregate(b, none, plus)))
    return F.flatten(F.zip_with(starts, blocks, lambda start, b: F.transform(sums(b), lambda s: plus(start, s))))


def _newlines(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))


def _overlap(back: Column) -> Column:
    """The part of ``back`` after its first boundary of the strongest kind that it has; all of it if it has none."""
    after = [F.regexp_extract(back, rf"(?s){b}(?!\A)(.+)\z", 1) for b in BOUNDARIES]
    return F.coalesce(*[F.nullif(a, F.lit("")) for a in after], back)
