"""Mix sources to target weights: hash-random keys, prefix sums of word counts, exact cuts.

Every document gets a random-looking key, a digest of its id and text. Inside a source the
documents stand in the order of their keys, and the mix takes them from the front until the
source's budget is spent; a budget above the source's own words takes whole epochs first and
cuts the remainder. Keys are uniform, so equal parts of the key space are ranges of equal
size, and a large source simply has more of them. The prefix sum of a source is found in two
levels: sums per range, then sums per key inside the one range that holds the cut. No level
orders more than a source's ranges or one range's keys in a task, and documents themselves
are neither sorted nor shuffled: each is compared with its source's cut.

Everything is DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from ..functions.columns import quoted
from ..functions.lookup import attach, prepare
from ..functions.ordering import numbered
from ..session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
RANGE_ROWS = 100_000
WEIGHTS = (1, 2, 3)
MOST_EPOCHS = 3
_WIDE = DecimalType(38, 0)
_SOURCE = ["src", "no_src"]
_BEFORE = (Window.unboundedPreceding, -1)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_key(doc_id: Column, text: Column, seed: int) -> Column:
    """A digest that orders the documents of a source at random, the same in every run."""
    own = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    named = F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), own)
    return F.md5(named.cast("binary"))


def _ranked(sources: DataFrame) -> DataFrame:
    """Adds the place ``nth`` of each source by code point, the null source last.

    A distributed sort; each partition's first number is the count of rows in those before it.
    """
    ordered = cut_lineage(
        sources.orderBy("no_src", "src").withColumn("at", F.monotonically_increasing_id())
    )
    part = F.shiftright("at", 33)
    counts = ordered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    starts = counts.select(
        "part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(*_BEFORE)), F.lit(0)).alias("start")
    )
    # One row per task of the sort.
    joined = ordered.withColumn("part", part).join(F.broadcast(starts), "part")
    return joined.withColumn("nth", F.col("start") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).drop(
        "part", "start", "at"
    )


def targets(sources: DataFrame, weights: Sequence[int], most: int, total: int | None = None) -> DataFrame:
    """Adds ``weight``, ``target`` and the whole ``budget`` to sources (``src, no_src, source_size``).

    Sources share ``total`` (all words, if not given) by weight. A share stops at ``most`` times
    the source's size and what is over is shared again among the others, until none is above.
    Each round is one aggregation; the driver holds two sums. The last round's shares are exact
    fractions, so doubles do not depend on the order of the rounds.
    """
    if not weights or any(w < 1 for w in weights) or most < 1:
        raise ValueError("weights and the most epochs are positive integers")
    turn = F.pmod("nth", F.lit(len(weights))).cast("int")
    named = cut_lineage(
        _ranked(sources)
        .withColumn("weight", F.get(F.array(*[F.lit(int(w)) for w in weights]), turn).cast("long"))
        .withColumn("cap", F.col("source_size") * most)
    )
    first = named.agg(F.sum("source_size").alias("t"), F.sum("weight").alias("w")).first()
    total = int(first["t"] or 0) if total is None else total
    held, weight = 0, int(first["w"] or 0)
    while True:
        free = F.lit(total - held).cast(_WIDE) * F.col("weight")
        full = F.col("cap").cast(_WIDE) * F.lit(weight).cast(_WIDE) <= free
        got = named.agg(
            F.sum(F.when(full, F.col("cap"))).alias("c"), F.sum(F.when(~full, F.col("weight"))).alias("w")
        ).first()
        now = int(got["c"] or 0), int(got["w"] or 0)
        if now == (held, weight) or not now[1]:
            break
        held, weight = now
    rest = total - held
    share = (F.col("weight") * rest).cast("double") / F.lit(float(max(weight, 1)))
    whole = F.expr(f"(cast(weight as decimal(20,0)) * {2 * rest} + {weight}) div {max(2 * weight, 1)}")
    return named.select(
        *_SOURCE,
        "source_size",
        "rows",
        "weight",
        F.when(full, F.col("cap").cast("double")).otherwise(share).alias("target"),
        F.when(full, F.col("cap")).otherwise(whole).alias("budget"),
    )


def _cut(parts: DataFrame, by: str, rest: str) -> DataFrame:
    """Of each source's parts (``by``, ``size``) the one in which ``rest`` words end, and what is left there."""
    before = F.coalesce(F.sum("size").over(Window.partitionBy(*_SOURCE).orderBy(by).rowsBetween(*_BEFORE)), F.lit(0))
    placed = parts.withColumn("before", before)
    inside = (F.col("before") <= F.col(rest)) & (F.col(rest) < F.col("before") + F.col("size"))
    return placed.where(inside).withColumn("left", F.col(rest) - F.col("before"))


def cuts(slim: DataFrame, shares: DataFrame, range_rows: int) -> DataFrame:
    """Where each source's budget ends: ``epochs`` whole ones, then keys below ``cut_key`` and ``left`` words of it.

    ``copies`` rows have that key. Budgets that end with an epoch have no cut.
    """
    size = F.greatest("source_size", F.lit(1))
    epochs = F.expr("budget div greatest(source_size, 1)")
    plan = shares.select(
        *_SOURCE,
        "source_size",
        "target",
        epochs.alias("epochs"),
        (F.col("budget") - epochs * size).alias("rest"),
        F.ceil(F.col("rows") / range_rows).cast("long").alias("ranges"),
    )
    plan = cut_lineage(plan)
    at_range = F.shiftright(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.col("ranges"), 32)
    held = attach(slim, prepare(plan.where("rest > 0").select(*_SOURCE, "ranges", "rest")), _SOURCE)
    held = held.where("rest is not null").withColumn("range", at_range)
    sums = held.groupBy(*_SOURCE, "range", "rest").agg(F.sum("size").alias("size"))
    found = prepare(_cut(sums, "range", "rest").select(*_SOURCE, F.col("range").alias("at_range"), F.col("left").alias("want")))
    inside = attach(held, found, _SOURCE).where("range = at_range")
    keys = inside.groupBy(*_SOURCE, "key", "want").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("copies"))
    ends = _cut(keys, "key", "want").select(*_SOURCE, F.col("key").alias("cut_key"), "left", "copies")
    # One row per source at most on either side.
    return plan.drop("rest", "ranges").join(ends, _SOURCE, "left")


def mix(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    most: int = MOST_EPOCHS,
    total: int | None = None,
    seed: int = 0,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    keep_text: bool = True,
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """The columns of ``docs`` and ``size, source_size, target, taken``: words, and words the mix takes.

    ``weights`` go round over the sources in code-point order, the null source last. ``taken``
    counts repeats: three times the size is three epochs, and the one document of a source in
    which its budget ends is taken in part (its first words, see ``epochs``), so that the words
    taken of a source are its target, rounded. Null and empty texts have no words and take none;
    sources without words have the target 0. Rows of equal id and text have one key and are
    neighbours; where the budget ends among such copies, they are numbered and those first in
    number are taken. Equal keys of one source are the only ties. An empty table gives an empty
    one. Columns of ``docs`` named like the four new ones are replaced. Without ``keep_text`` the
    text goes and the others are written once, so that texts are read once.
    """
    new = ("size", "source_size", "target", "taken")
    kept = [c for c in docs.columns if c not in new and (keep_text or c != text)]
    rows = docs.select(
        F.struct(*[quoted(c).alias(f"c{i}") for i, c in enumerate(kept)], F.lit(0).alias("none")).alias("row"),
        F.coalesce(quoted(source).cast("string"), F.lit("")).alias("src"),
        quoted(source).isNull().alias("no_src"),
        word_count(quoted(text)).alias("size"),
        random_key(quoted(doc_id), quoted(text), seed).alias("key"),
    )
    if not keep_text:
        rows = cut_lineage(rows)
    slim = rows.drop("row")
    if keep_text:
        slim = cut_lineage(slim)
    sums = slim.groupBy(*_SOURCE).agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    plan = cut_lineage(cuts(slim, targets(sums, weights, most, total), range_rows))
    placed = attach(rows, prepare(plan), _SOURCE)

    def result(df: DataFrame, extra: Column) -> DataFrame:
        taken = (F.col("epochs") * F.col("size") + extra).cast("long")
        columns = [F.col(f"row.c{i}").alias(c) for i, c in enumerate(kept)]
        return df.select(*columns, "size", "source_size", "target", taken.alias("taken"))

    at_cut = F.col("key").eqNullSafe(F.col("cut_key"))
    extra = F.when(F.col("key") < F.col("cut_key"), F.col("size")).when(at_cut, F.col("left")).otherwise(F.lit(0))
    if plan.where("copies > 1").isEmpty():
        return result(placed, extra)
    many = at_cut & (F.col("copies") > 1)
    ties = cut_lineage(placed.where(many).withColumn("at", F.monotonically_increasing_id()))
    ties = numbered(ties, _SOURCE, ["at"], "nth")
    own = F.least(F.greatest(F.col("left") - F.col("nth") * F.col("size"), F.lit(0)), F.col("size"))
    return result(placed.where(~many), extra).unionByName(result(ties, own))


def epochs(mixed: DataFrame, text: str = "text") -> DataFrame:
    """The mixed corpus: one row per document and epoch with the ``words`` taken, from epoch 0 on.

    The columns are those of ``mixed`` (the result of ``mix``), with ``epoch`` and ``words``. A
    document taken in part ends after the last word taken; documents of which nothing is taken
    have no row, nor have those without words.
    """
    size, taken = F.col("size"), F.col("taken")
    turns = F.sequence(F.lit(0), F.expr("(taken + size - 1) div size - 1").cast("int"))
    rows = mixed.where("taken > 0").withColumn("epoch", F.explode(turns))
    words = F.least(size, taken - F.col("epoch") * size).cast("long")
    # Possessive repeats: the pattern is matched without recursion, however many words it takes.
    head = F.concat(F.lit(r"^(?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++){"), words.cast("string"), F.lit("}+"))
    cut = F.when(words == size, quoted(text)).otherwise(F.call_function("regexp_extract", quoted(text), head, F.lit(0)))
    return rows.withColumn("words", words).withColumn(text, cut)
