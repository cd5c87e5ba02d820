"""Counts of metadata values, as one long table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notarium.operators.index import dense_ids

#: Fields that are no facets by themselves.
NO_FACETS = ("title", "date", "created", "updated", "aliases")
UNSET = "(not set)"


def entries(notes: DataFrame) -> DataFrame:
    """(path, field, values) of each note's fields that have a value."""
    return notes.select("path", F.explode("meta").alias("field", "values")).where(F.coalesce(F.size("values"), F.lit(0)) > 0)


def presence(notes: DataFrame) -> DataFrame:
    """(field, present): notes that have a value under the field."""
    return entries(notes).groupBy("field").agg(F.count("*").alias("present"))


def value_counts(notes: DataFrame) -> DataFrame:
    """(field, value, n): a value twice in one list counts twice."""
    return entries(notes).select("field", F.explode("values").alias("value")).groupBy("field", "value").agg(F.count("*").alias("n"))


def facets(notes: DataFrame, fields: list[str] | None = None, max_values: int = 30) -> DataFrame:
    """(field_rank, field, value_rank, value, n): the counts in the order of the report, with the notes that lack the field.

    Without ``fields`` all those count that have at most ``max_values`` values
    and are in more than one note, those in most notes first. Named fields come
    in the order given, whatever their size. ``notes`` has one row a note.
    """
    counts, present = value_counts(notes), presence(notes)
    total = notes.agg(F.count("*").alias("n_notes"))  # one row
    if fields:
        order = {f.lower(): i + 1 for i, f in reversed(list(enumerate(fields)))}
        chosen = present.where(F.col("field").isin(*order)).withColumn("field_rank", F.element_at(F.create_map(*[F.lit(x) for kv in order.items() for x in kv]), F.col("field")))
    else:
        few = counts.groupBy("field").agg(F.count("*").alias("n_values")).where(F.col("n_values") <= max_values)
        chosen = present.where((F.col("present") > 1) & ~F.col("field").isin(*NO_FACETS)).join(few.select("field"), "field", "left_semi")
        chosen = chosen.withColumn("field_rank", F.row_number().over(Window.orderBy(F.desc("present"), "field")))  # a row a field
    shown = counts.join(chosen.select("field", "field_rank"), "field")
    if fields:  # of any size, so that they are ranked by sorted ranges
        placed = dense_ids(shown.withColumn("\x02n", -F.col("n")), ["field", "\x02n", "value"], "place")
        first = placed.groupBy("field").agg(F.min("place").alias("first"))
        shown = placed.join(first, "field").withColumn("value_rank", (F.col("place") - F.col("first") + 1).cast("int"))
    else:
        shown = shown.withColumn("value_rank", F.row_number().over(Window.partitionBy("field").orderBy(F.desc("n"), "value")))
    unset = chosen.join(F.broadcast(total), F.lit(True)).select("field", "field_rank", F.lit(UNSET).alias("value"), (F.col("n_notes") - F.col("present")).alias("n")).where("n > 0")
    last = F.lit(2_147_483_647)
    return shown.select("field_rank", "field", "value_rank", "value", "n").unionByName(unset.select("field_rank", "field", last.alias("value_rank"), "value", "n"))


def report_lines(stats: DataFrame, shown: DataFrame) -> DataFrame:
    """(field_rank, value_rank, line): the printed form, one line of totals, then each field's name (place 0) and its values."""
    total = stats.select(F.lit(0).alias("field_rank"), F.lit(0).alias("value_rank"), F.format_string("files %d · chunks %d · terms %d · avg chunk length %.0f tokens", "n_notes", "n_chunks", "n_terms", "avg_len").alias("line"))
    names = shown.select("field_rank", F.lit(0).alias("value_rank"), F.concat("field", F.lit(":")).alias("line")).distinct()
    padded = F.when(F.length("value") < 24, F.rpad("value", 24, " ")).otherwise(F.col("value"))
    return total.unionByName(names).unionByName(shown.select("field_rank", "value_rank", F.concat(F.lit("  "), padded, F.lit(" "), F.col("n").cast("string")).alias("line")))


def report(stats: DataFrame, shown: DataFrame) -> str:
    """The printed form as text; its length is bounded by the fields and values shown."""
    rows = report_lines(stats, shown).orderBy("field_rank", "value_rank").toLocalIterator()
    return "".join("\n" * (r.field_rank > 0 and r.value_rank == 0) + r.line + "\n" for r in rows)
