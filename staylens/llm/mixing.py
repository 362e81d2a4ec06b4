"""Mixing sources to target weights by entropy balancing, with DataFrame functions alone.

Of all rates (copies of a document, from 0 to ``cap``) whose words meet each source's target, those
nearest to 1 in relative entropy are r = min(cap, exp(l * s)): an exponential tilt by the document's
size s with one multiplier l a source. The multipliers solve the convex dual; Newton's iterations
run for all sources at once over a histogram (source, size, documents), kept in a bracket that each
iteration narrows. Rates are the same within a class of source and size, so whole copies are dealt
to classes first and to the documents of a class by hash.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from staylens.operators.ranking import rank_by_order
from staylens.sources.durable import durable, release

WEIGHTS = (1, 2, 3)
CAP = 3
# Fixed value: what a word is.
WORD = r"[^\x20\x09-\x0D]+"
# Newton's iterations end when each source is this near to its target, in words or relatively.
NEAR_WORDS, NEAR_SHARE = 0.25, 1e-9
# Each iteration at least halves the bracket, so this many reach double precision.
ITERATIONS = 120
# Passes that correct what rounding leaves of a source's target.
CORRECTIONS = 3


def word_count(text: str = "text") -> Column:
    """Column: words of the whole text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _exact(value: Column) -> Column:
    """Sum of doubles that does not depend on the order of rows."""
    return F.sum(value.cast("decimal(38,6)")).cast("double")


def source_targets(classes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``source``, ``source_size`` and ``target`` (words) of each source of ``source``, ``size``, ``n``.

    Sources by code point, null last, weigh ``weights`` in turn and share the words of all; a target
    stops at ``cap`` times its source's words, and the excess is shared again by weight until none
    is above. Only sums over all sources reach the driver.
    """
    sums = classes.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    ranked = rank_by_order(sums, [], [F.col("source").asc_nulls_last()])
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    sources = durable(ranked.select("source", "source_size", weight.cast("long").alias("weight")))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    capped, rest, share = -1, total, 0
    full = F.lit(False)
    while True:
        # The level only rises, so a source that is full once stays full.
        held = sources.agg(
            F.count_if(full).alias("capped"),
            F.sum(F.when(full, cap * F.col("source_size")).otherwise(0)).alias("words"),
            F.sum(F.when(~full, F.col("weight"))).alias("weights"),
        ).first()
        if held["capped"] == capped or not held["weights"]:
            break
        capped, rest, share = held["capped"], total - held["words"], held["weights"]
        full = cap * F.col("source_size") * F.lit(share) < F.col("weight") * F.lit(rest)
    open_target = F.col("weight") * F.lit(float(rest)) / F.lit(float(share or 1))
    target = F.when(full, (cap * F.col("source_size")).cast("double")).otherwise(open_target)
    found = durable(sources.select("source", "source_size", target.alias("target")))
    release(sources)
    return found


def _by_source(left: DataFrame, right: DataFrame, *columns: str) -> DataFrame:
    """The left rows with these columns of their source's row on the right."""
    other = right.select(F.col("source").alias("_source"), *columns)
    return left.join(other, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")


def _rate(multiplier: Column, cap: int) -> Column:
    return F.least(F.lit(float(cap)), F.exp(multiplier * F.col("size") / F.col("scale")))


def tilted_rates(classes: DataFrame, targets: DataFrame, cap: int = CAP) -> DataFrame:
    """The classes (``source``, ``size``, ``n``) with ``target`` and ``rate``: Newton on the dual.

    ``targets`` has ``source``, ``source_size`` and ``target``, at most ``cap`` times the source's
    words. Sources at that limit have rate ``cap``, sources without words or target rate 0. What
    each iteration brings to the driver is the number of sources that are not there yet.
    """
    counts = classes.groupBy("source").agg(F.sum("n").alias("docs"))
    size, target = F.col("source_size"), F.col("target")
    full = target >= size * F.lit(cap * (1 - 1e-12))
    state = durable(
        _by_source(targets, counts, "docs").select(
            "source", "source_size", "target",
            (size / F.col("docs")).alias("scale"),
            # At a rate common to all: the start.
            F.when((size > 0) & (target > 0) & ~full, F.log(target / size)).alias("l"),
            F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"),
            F.when(size == 0, 0.0).when(full, float(cap)).when(target <= 0, 0.0).alias("fixed"),
            F.lit(False).alias("done"),
        )
    )
    for _ in range(ITERATIONS):
        rows = _by_source(classes, state.where("fixed is null and not done"), "scale", "l").where("l is not null")
        rate = _rate(F.col("l"), cap)
        words = F.col("n") * F.col("size") * rate
        sums = rows.groupBy("source").agg(
            _exact(words).alias("words"),
            _exact(F.when(rate < cap, words * F.col("size") / F.col("scale")).otherwise(0.0)).alias("slope"),
        )
        gap = F.col("words") - target
        there = F.abs(gap) <= F.greatest(F.lit(NEAR_WORDS), NEAR_SHARE * target)
        low = F.when(gap <= 0, F.col("l")).otherwise(F.col("low"))
        high = F.when(gap >= 0, F.col("l")).otherwise(F.col("high"))
        newton = F.when(F.col("slope") > 0, F.col("l") - gap / F.col("slope"))
        inside = F.coalesce((newton > low) | low.isNull(), F.lit(False)) & F.coalesce(
            (newton < high) | high.isNull(), F.lit(False)
        )
        # Out of the bracket, halve it; where it is open, go further out.
        halved = F.coalesce((low + high) / 2, high - F.abs(high) - log(2), low + F.abs(low) + log(2))
        stuck = F.coalesce((halved <= low) | (halved >= high), F.lit(False))
        moved = _by_source(state, sums, "words", "slope")
        active = F.col("words").isNotNull()
        step = durable(
            moved.select(
                "source", "source_size", "target", "scale",
                F.when(active & ~there, F.when(inside, newton).otherwise(halved)).otherwise(F.col("l")).alias("l"),
                F.when(active, low).otherwise(F.col("low")).alias("low"),
                F.when(active, high).otherwise(F.col("high")).alias("high"),
                "fixed",
                (F.col("done") | F.coalesce(there | stuck, F.lit(False))).alias("done"),
            )
        )
        release(state)
        state = step
        if state.where("fixed is null and not done").isEmpty():
            break
    rates = _by_source(classes, state, "source_size", "target", "scale", "l", "fixed")
    found = durable(
        rates.select(
            "source", "size", "n", "source_size", "target",
            F.coalesce("fixed", _rate(F.col("l"), cap)).alias("rate"),
        )
    )
    release(state)
    return found


def whole_copies(rated: DataFrame, cap: int = CAP) -> DataFrame:
    """The rated classes with ``copies``, whole, for all their documents together.

    Along a source's classes from the largest size down, copies are the whole steps of the rates'
    running sum, so a source is off by at most half its largest size; then the largest size that
    fits into what is missing (or over) gives or takes copies, ``CORRECTIONS`` times.
    """
    down = Window.partitionBy("source").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, 0)
    running = F.sum(F.col("n") * F.col("rate")).over(down)
    earlier = F.coalesce(F.lag("running").over(Window.partitionBy("source").orderBy(F.col("size").desc())), F.lit(0.0))
    steps = F.floor(F.col("running") + 0.5) - F.floor(F.col("earlier") + 0.5)
    dealt = durable(
        rated.withColumn("running", running).withColumn("earlier", earlier)
        .withColumn("copies", F.least(steps, cap * F.col("n")).cast("long")).drop("running", "earlier")
    )
    for _ in range(CORRECTIONS):
        missing = dealt.groupBy("source").agg(
            F.round(F.first("target") - F.sum(F.col("copies") * F.col("size"))).cast("long").alias("missing")
        )
        owed = _by_source(dealt, missing, "missing")
        room = F.when(F.col("missing") > 0, cap * F.col("n") - F.col("copies")).otherwise(F.col("copies"))
        fits = (F.col("size") > 0) & (F.col("size") <= F.abs("missing")) & (room > 0)
        chosen = owed.where(fits).groupBy("source").agg(
            F.max("size").alias("chosen"),
            F.max_by(
                F.signum("missing").cast("long")
                * F.least(room, F.floor(F.abs(F.col("missing")) / F.col("size"))), "size"
            ).cast("long").alias("change"),
        )
        change = F.when(F.col("size") == F.col("chosen"), F.col("change")).otherwise(0)
        mended = durable(
            _by_source(dealt, chosen, "chosen", "change")
            .withColumn("copies", F.col("copies") + F.coalesce(change, F.lit(0))).drop("chosen", "change")
        )
        release(dealt)
        dealt = mended
    return dealt


def mix(
    documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, keep: list[str] | None = None
) -> DataFrame:
    """Columns ``keep`` (default: all), ``size``, ``source_size``, ``target``, ``rate``, ``copies``, ``taken``.

    ``size`` is the number of words of the whole text (null: none), ``taken`` the words that the mix
    takes of the document: ``copies`` times its size, at most ``cap`` times. Sources may be null.
    Each row is a document of its own, ids may be null or repeat; documents without words are taken
    0 words. An empty table gives no rows. Results depend on the rows alone, not on their order:
    sums are exact, and the documents of a class take turns by a hash of id and text.
    """
    added = ["size", "source_size", "target", "rate", "copies", "taken"]
    columns = [c for c in (documents.columns if keep is None else keep) if c.lower() not in added]
    carried = [F.col(f"`{c}`").alias(f"_keep_{i}") for i, c in enumerate(columns)]
    rows = documents.select(
        *carried, "source", word_count().alias("size"), F.xxhash64("doc_id", "text").alias("turn"),
        F.col("doc_id").alias("id"),
    )
    turns = ["turn", "id"]
    ranked = durable(rank_by_order(rows, ["source", "size"], [F.col(c) for c in turns], "place"))
    classes = durable(ranked.groupBy("source", "size").agg(F.count("*").alias("n")))
    targets = source_targets(classes, weights, cap)
    rated = tilted_rates(classes, targets, cap)
    dealt = whole_copies(rated, cap)
    release(classes, targets, rated)
    of_class = dealt.withColumnsRenamed({"source": "_source", "size": "_size"})
    joined = ranked.join(
        of_class, F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size"))
    )
    every = F.floor(F.col("copies") / F.col("n"))
    copies = (every + F.when(F.col("place") <= F.col("copies") - every * F.col("n"), 1).otherwise(0)).cast("int")
    return joined.select(
        *[F.col(f"_keep_{i}").alias(c) for i, c in enumerate(columns)], "size", "source_size", "target", "rate",
        copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"),
    )


def repeated(mixed: DataFrame) -> DataFrame:
    """A row of the mix for each copy, with its number from 1; documents without copies go."""
    return mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
