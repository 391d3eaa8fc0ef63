"""Mixing sources to target shares by entropy balancing; DataFrame operations only.

Document rates are the ones nearest to 1 in relative entropy, none above the limit, under which
every source's words reach its target. The convex dual gives rate = min(limit, exp(lambda * z)) with
z the document's words over its source's mean and one multiplier per source; Newton iterations, kept
inside a bracket, find the multipliers. Every iteration is a distributed aggregate over the counts
of documents by source and size, which hold all that the dual sees of the corpus.

Rates become whole copies per size band of a source. Bands are taken from the longest documents to
the shortest, each one's copies make up what the bands before left over, so a source's words end
within about one short document of the target. Inside a band copies are dealt out evenly over all
its documents by rank; ranks are counted in salted buckets, so a hot source or size needs no task
of its own.

Defined results: a null text has no words and is never taken. A null source is a source of its own,
last in order. Repeated rows are rows like others. If the corpus has no words all targets are 0. An
empty table gives an empty result. Reruns agree: the order is a hash of identifier and text.
Texts of any length count whole, and long ones are taken whole or not at all. Extra columns are carried with
``carry``, whatever their names.
The table of sources is taken to be small enough for one task's sort; documents are not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import word_count
from tidemark.session import staged

KEY = ["absent", "source"]
TOLERANCE = 1e-7
LEAST_SALTS, ROWS_PER_SALT = 64, 20_000


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, limit: float) -> DataFrame:
    """Adds ``target`` to rows (absent, source, source_size): proportional to weight, stopped at limit x size.

    Sources reach their stop in the order of stop over weight, so the level at which the others
    share what is left follows from running sums in that order.
    """
    place = F.row_number().over(Window.orderBy("absent", "source")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(place, F.lit(len(weights))) + 1)
    rows = sizes.withColumn("weight", weight).withColumn("stop", F.col("source_size") * F.lit(float(limit)))
    order = Window.orderBy(F.col("stop") / F.col("weight"), "absent", "source")
    level = rows.select(
        "*",
        F.coalesce(F.sum("stop").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("stopped"),
        F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)).alias("rest"),
        (F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share))).alias("all"),
    ).withColumn("level", (F.col("all") - F.col("stopped")) / F.col("rest"))
    first = F.min(F.when(F.col("stop") / F.col("weight") >= F.col("level"), F.struct(F.col("stop") / F.col("weight"), "absent", "source", "level")))
    found = level.withColumn("found", first.over(Window.partitionBy()).getField("level"))
    return found.select(*KEY, "source_size", F.least("stop", F.coalesce(F.col("found"), F.lit(float("inf"))) * F.col("weight")).alias("target"))


def _rate(lam: Column, size: Column, mean: Column, limit: float) -> Column:
    """The tilted rate; a missing multiplier stands for the limit itself."""
    return F.when(lam.isNull(), F.lit(float(limit))).otherwise(F.least(F.lit(float(limit)), F.exp(F.least(F.lit(700.0), lam * size / mean))))


def multipliers(hist: DataFrame, targets: DataFrame, limit: float, most: int = 200) -> DataFrame:
    """One row per source with its dual multiplier ``lam`` (null where the target is the limit)."""
    counts = hist.groupBy(*KEY).agg(F.sum("n").alias("docs"))
    free = (F.col("target") > 0) & (F.col("target") < F.col("source_size") * limit * (1 - 1e-12))
    state = staged(targets.join(counts, KEY).select(
        *KEY, "target", "source_size", (F.greatest("source_size", F.lit(1)) / F.col("docs")).alias("mean"),
        F.when(F.col("target") > 0, F.when(free, F.lit(0.0))).otherwise(F.lit(-1e6)).alias("lam"),
        F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"), (~free).alias("done"),
    ), "mix-state")
    for _ in range(most):
        if state.filter("NOT done").isEmpty():
            break
        z = F.col("size") / F.col("mean")
        words, rate = F.col("n") * F.col("size"), _rate(F.col("lam"), F.col("size"), F.col("mean"), limit)
        sums = hist.join(state.filter("NOT done"), KEY).groupBy(*KEY).agg(
            F.sum(words * rate).alias("g"), F.sum(F.when(rate < limit, words * rate * z).otherwise(0.0)).alias("h"),
        )
        low = F.when(F.col("g") < F.col("target"), F.col("lam")).otherwise(F.col("lo"))
        high = F.when(F.col("g") > F.col("target"), F.col("lam")).otherwise(F.col("hi"))
        step = state.join(sums, KEY, "left").withColumn("lo", low).withColumn("hi", high).withColumn(
            "newton", F.when(F.col("h") > 0, F.col("lam") + (F.col("target") - F.col("g")) / F.when(F.col("h") > 0, F.col("h")))
        )
        inside = (F.col("lo").isNull() | (F.col("newton") > F.col("lo"))) & (F.col("hi").isNull() | (F.col("newton") < F.col("hi")))
        halved = F.when(F.col("hi").isNull(), F.col("lo") * 2 + 1).when(F.col("lo").isNull(), F.col("hi") * 2 - 1).otherwise((F.col("lo") + F.col("hi")) / 2)
        met = F.abs(F.col("g") - F.col("target")) <= F.col("target") * TOLERANCE
        tight = F.coalesce((F.col("hi") - F.col("lo")) <= 1e-13 * F.greatest(F.abs("hi"), F.lit(1e-3)), F.lit(False))
        over = F.col("done") | met | tight
        state = staged(step.select(
            *KEY, "target", "source_size", "mean",
            F.when(over, F.col("lam")).when(F.coalesce(inside, F.lit(False)) & F.col("newton").isNotNull(), F.col("newton")).otherwise(halved).alias("lam"),
            "lo", "hi", over.alias("done"),
        ), "mix-state")
    return state


def _band(size: Column) -> Column:
    """Eight bands to a doubling; documents without words are apart."""
    return F.when(size > 0, F.floor(F.log2(size) * 8).cast("int")).otherwise(F.lit(-1))


def band_copies(hist: DataFrame, state: DataFrame, limit: float) -> DataFrame:
    """Copies of each (source, band): from long to short, carrying on what was left over."""
    rate = _rate(F.col("lam"), F.col("size"), F.col("mean"), limit)
    bands = hist.join(state, KEY).withColumn("rate", rate).groupBy(*KEY, _band(F.col("size")).alias("band")).agg(
        F.sum("n").alias("docs"), F.sum(F.col("n") * F.col("size")).alias("words"), F.sum(F.col("n") * F.col("size") * F.col("rate")).alias("want"),
    )
    # At most eight bands per doubling of a document's length: a short array whatever the corpus holds.
    listed = bands.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("band", "docs", "words", "want")), asc=False).alias("bands"))
    fold = F.expr(f"""aggregate(bands,
        named_struct('carry', 0D, 'out', CAST(array() AS array<struct<band:int,docs:bigint,copies:bigint>>)),
        (acc, b) -> named_struct(
            'carry', acc.carry + b.want - IF(b.words = 0, 0D, b.words / b.docs * greatest(0, least({int(limit)} * b.docs, round((acc.carry + b.want) * b.docs / b.words)))),
            'out', concat(acc.out, array(named_struct('band', b.band, 'docs', b.docs, 'copies',
                IF(b.words = 0, 0L, CAST(greatest(0, least({int(limit)} * b.docs, round((acc.carry + b.want) * b.docs / b.words))) AS bigint)))))),
        acc -> acc.out)""")
    return listed.select(*KEY, F.inline(fold))


def mix(
    df: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, limit: int = 2,
    ident: str = "doc_id", text: str = "text", source: str = "source", carry: bool = False,
) -> DataFrame:
    """Per row: identifier, ``size``, ``source_size``, ``target``, ``taken``, ``copies``; with ``carry`` also the input ``row``.

    Weights repeat over the sources in code-point order, null last. ``limit`` is a whole number.
    """
    if int(limit) != limit or limit < 1 or share > limit:
        raise ValueError("limit is a whole number of copies, at least 1 and the share")
    name = F.col(source)
    docs = df.select(
        F.col(ident).alias("id"), name.isNull().alias("absent"), F.coalesce(name, F.lit("")).alias("source"), word_count(F.col(text)).alias("size"),
        F.xxhash64(F.col(ident), F.col(text)).alias("deal"), *([F.struct("*").alias("row")] if carry else []),
    )
    if not carry:
        docs = staged(docs, "mix-docs")
    hist = staged(docs.groupBy(*KEY, "size").agg(F.count("*").alias("n")), "mix-sizes")
    sizes = hist.groupBy(*KEY).agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    targets = staged(source_targets(sizes, weights, share, limit), "mix-targets")
    state = multipliers(hist, targets, limit)
    plan = staged(band_copies(hist, state, limit).join(targets, KEY), "mix-bands")
    total = hist.agg(F.sum("n").alias("n")).first()["n"] or 0
    salts = max(LEAST_SALTS, total // ROWS_PER_SALT)
    salted = docs.withColumn("band", _band(F.col("size"))).withColumn("salt", F.pmod(F.xxhash64("deal"), F.lit(salts)).cast("int"))
    group = [*KEY, "band", "salt"]
    slim = (docs if not carry else docs.drop("row")).withColumn("band", _band(F.col("size"))).withColumn("salt", F.pmod(F.xxhash64("deal"), F.lit(salts)).cast("int"))
    counts = slim.groupBy(*group).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(*KEY, "band").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    buckets = counts.withColumn("before", F.coalesce(before, F.lit(0))).drop("n").join(plan, [*KEY, "band"])
    rank = F.row_number().over(Window.partitionBy(*group).orderBy("size", "deal", "id")) - 1
    ranked = salted.withColumn("inside", rank).join(buckets, group).withColumn("rank", F.col("inside") + F.col("before"))
    return ranked.withColumn("copies", F.expr("((rank + 1) * copies) div docs - (rank * copies) div docs")).select(
        F.col("id").alias(ident), "size", "source_size", F.col("target").cast("double").alias("target"), (F.col("size") * F.col("copies")).alias("taken"),
        "copies", *(["row"] if carry else []),
    )
