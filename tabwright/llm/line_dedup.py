"""Delete repeated runs of lines, found by winnowing over line hashes.

Of every ``run`` consecutive lines the least line hash is a fingerprint, so two equal runs of
that length hold the same fingerprint at the same place: sharing one is guaranteed. Positions
of fingerprints that occur more than once are joined; from such a position a match is extended
both ways over all runs of lines around it whose fingerprint it is, and each later occurrence
of a run is joined to its first one. Lines of later occurrences are deleted. A longer repeat is
a chain of such runs, so it goes as a whole.

Everything is DataFrame functions. Fingerprints and runs are aggregated to their first position
before anything is joined, so a line that occurs in a third of all documents makes one row to
join with, and the many rows of its key are split by adaptive skew joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

RUN_LINES = 3
# A line goes with the blank lines that follow it.
_LINE_START = r"(?<=\n)(?=[^\S\n]*\S)"
_BLANKS = " \t\n\r\x0b\x0c"


def lines_of(text: Column) -> Column:
    """The lines with their breaks; joined they are the text again. Blank lines belong to
    the line before them; those that lead a text are a line of their own."""
    return F.split(text, _LINE_START)


def _hashes(lines: Column) -> Column:
    return F.transform(lines, lambda x: F.xxhash64(F.trim(x, F.lit(_BLANKS))))


def runs(docs: DataFrame, run: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every run of ``run`` lines: ``id, th, at``, its fingerprint ``f`` with place ``p``, its hash ``h``."""
    rows = docs.where(F.col(text).isNotNull()).select(
        F.col(doc_id).alias("id"), F.xxhash64(F.col(text)).alias("th"), _hashes(lines_of(F.col(text))).alias("hs")
    )
    rows = rows.where(F.size("hs") >= run)

    def one(at: Column) -> Column:
        own = F.slice("hs", at + 1, run)
        least = F.array_min(own)
        return F.struct(
            at.alias("at"),
            least.alias("f"),
            (at + F.array_position(own, least) - 1).cast("int").alias("p"),
            F.xxhash64(own).alias("h"),
        )

    windows = F.transform(F.sequence(F.lit(0), F.size("hs") - run), one)
    return rows.select("id", "th", F.explode(windows).alias("w")).select("id", "th", "w.*")


def later_runs(found: DataFrame) -> DataFrame:
    """Runs that occurred before, at a smaller ``(id, th, at)``; null ids come first."""
    place = F.struct("id", "th", "p")
    repeated = (
        found.groupBy("f")
        .agg(F.min(place).alias("first"), F.max(place).alias("last"))
        .where("first <> last")
        .select("f")
    )
    around = found.join(repeated, "f", "left_semi")
    at = F.struct("id", "th", "at")
    firsts = (
        around.groupBy("f", "h").agg(F.min(at).alias("first"), F.max(at).alias("last")).where("first <> last")
    )
    return around.join(firsts.select("f", "h", "first"), ["f", "h"]).where(at > F.col("first")).select("id", "th", "at")


def drop_repeated_lines(
    docs: DataFrame,
    run: int = RUN_LINES,
    doc_id: str = "doc_id",
    text: str = "text",
    counted: tuple[str, str] = ("n_lines", "n_removed"),
) -> DataFrame:
    """The columns of ``docs`` with repeated lines deleted, and two counts: lines before, lines deleted.

    A line is deleted if it lies in ``run`` consecutive lines of its document that occurred
    before: in a document with a smaller id, or further up in the same one (the first
    occurrence stays). Lines are compared without white space at their ends. Null texts
    stay null and have no lines; empty ones have one. Documents of fewer than ``run`` lines
    stay as they are. Rows with equal id and text are one document and get the same text;
    rows with equal ids only are ordered by a hash of the text. Columns of ``docs`` named
    like the two counts (``counted``) are replaced.
    """
    found = cut_lineage(runs(docs, run, doc_id, text))
    starts = later_runs(found).groupBy("id", "th").agg(F.collect_set("at").alias("__starts"))
    starts = starts.select(F.col("id").alias("__id"), F.col("th").alias("__th"), "__starts")
    rows = docs.withColumn("__hash", F.xxhash64(F.col(text)))
    joined = rows.join(
        starts, F.col(doc_id).eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__th")), "left"
    )
    lines = lines_of(F.col(text))
    gone = F.array_distinct(
        F.flatten(F.transform("__starts", lambda s: F.sequence(s, s + (run - 1))))
    )
    kept = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__gone"))
    marked = joined.withColumn("__lines", lines).withColumn("__gone", gone)
    clean = F.when(F.col("__gone").isNull(), F.col(text)).otherwise(
        F.array_join(F.transform(kept, lambda k: F.get("__lines", k)), "")
    )
    counts = {
        counted[0]: F.when(F.col(text).isNull(), 0).otherwise(F.size("__lines")).cast("long"),
        counted[1]: F.when(F.col("__gone").isNull(), 0).otherwise(F.size("__gone")).cast("long"),
    }
    others = [c for c in docs.columns if c not in counts]
    return marked.select(
        *(clean.alias(c) if c == text else F.col(c) for c in others), *(v.alias(k) for k, v in counts.items())
    )
