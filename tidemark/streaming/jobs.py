"""Incremental forms of the operators on Structured Streaming.

Time always means event time: windows close when the newest observed time passes them. What must be
remembered lives in keyed tables that merge rows in any order, so results do not depend on how rows are
dealt to files, nor on the order in which files arrive.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidemark.functions.timecol import bucket_of, micros
from tidemark.operators import study as st
from tidemark.streaming.keyed import KeyedTable, table_or_none


def file_stream(spark: SparkSession, path: str, pattern: str = "*.parquet", files_per_batch: int = 64) -> DataFrame:
    """Stream of the parquet files of a folder, with the ``file`` of each row; the schema is taken from the files already there."""
    schema = spark.read.option("pathGlobFilter", pattern).parquet(path).schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return stream.select("*", F.col("_metadata.file_path").alias("file"))


def each_batch(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Run a foreachBatch job over everything available now; restarts resume from the checkpoint."""
    (
        stream.writeStream.outputMode(mode).foreachBatch(handle).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start().awaitTermination()
    )


# ---- trade windows ------------------------------------------------------------------------------


def _add_up(keys: Sequence[str], sums: Sequence[str], newest: Sequence[str]) -> Callable[[DataFrame], DataFrame]:
    def merge(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums], *[F.max(c).alias(c) for c in newest])

    return merge


class TradeWindows:
    """Trade statistics of tumbling or sliding windows, the same for every order in which files arrive.

    The table holds partial sums per window, pool and address, so a hot pool is spread over its addresses,
    distinct counts need no sets, and rows that come late are added like others. The frontier is the
    newest time that all files of a batch have reached, and never goes back; windows that end up to it
    are closed. A row of a window that was closed when it arrived is listed in the late table; its
    window is then published again with a higher ``version``, the last batch that changed it.
    """

    KEYS = ("window_start", "window_end", "pool", "address")

    def __init__(self, spark: SparkSession, root: str, width: str = "5 minutes", slide: str | None = None, pool_type: str = "string", every: int = 8):
        self.spark, self.root, self.width, self.slide = spark, root, width, slide
        self.table = KeyedTable(
            spark, f"{root}/windows", f"window_start timestamp, window_end timestamp, pool {pool_type}, address string, b long, s long, bv double, sv double, version long",
            self.KEYS, _add_up(self.KEYS, ("b", "s", "bv", "sv"), ("version",)), every=every,
        )
        self.frontier = KeyedTable(spark, f"{root}/frontier", "name string, reached timestamp", ("name",), _add_up(("name",), (), ("reached",)), buckets=1, every=every)

    def consume(self, trades: DataFrame, checkpoint: str, source: str = "file") -> None:
        """Run over everything available; ``source`` names the column that tells the file of a row."""
        buy, sell, usd = F.col("side") == "buy", F.col("side") == "sell", F.col("volume_usd")
        span = F.window("traded_at", self.width, self.slide) if self.slide else F.window("traded_at", self.width)

        def handle(batch: DataFrame, batch_id: int) -> None:
            if self.frontier.holds(batch_id):  # written last
                return
            rows = batch.withColumn("w", span).select("w.start", "w.end", *batch.columns).withColumnsRenamed({"start": "window_start", "end": "window_end"})
            reached = self.reached(batch_id)
            if reached is not None:
                late = rows.filter(F.col("window_end") <= F.lit(reached))
                late.write.mode("overwrite").parquet(f"{self.root}/late/batch_id={batch_id}")
            sums = rows.groupBy(*self.KEYS).agg(
                F.count_if(buy).alias("b"), F.count_if(sell).alias("s"),
                F.sum(F.when(buy, usd).otherwise(0.0)).alias("bv"), F.sum(F.when(sell, usd).otherwise(0.0)).alias("sv"),
            )
            self.table.apply(sums.withColumn("version", F.lit(batch_id).cast("long")), batch_id)
            newest = batch.groupBy(source).agg(F.max("traded_at").alias("t")).agg(F.min("t").alias("reached"))
            self.frontier.apply(newest.select(F.lit("trades").alias("name"), "reached"), batch_id)

        each_batch(trades, handle, checkpoint)

    def reached(self, before: int | None = None):
        """The frontier, of the batches before a number if one is given; None at the beginning."""
        row = self.frontier.read(before).first()
        return row["reached"] if row else None

    def closed(self) -> DataFrame:
        """Statistics per pool of the windows that end up to the frontier."""
        total = F.sum(F.col("bv") + F.col("sv"))
        return self.table.read().filter(F.col("window_end") <= F.lit(self.reached())).groupBy("window_start", "window_end", "pool").agg(
            F.sum("b").alias("buys"), F.sum("s").alias("sells"), F.count_if(F.col("b") > 0).alias("unique_buyers"),
            F.count_if(F.col("s") > 0).alias("unique_sellers"), F.sum("bv").alias("buy_volume_usd"), F.sum("sv").alias("sell_volume_usd"),
            F.when(total > 0, F.max(F.col("bv") + F.col("sv")) / total).otherwise(0.0).alias("top_share"), F.max("version").alias("version"),
        )

    def late(self) -> DataFrame | None:
        """Rows that came after their window had been closed, with the batch they came in; None where no batch has followed another."""
        return table_or_none(self.spark, f"{self.root}/late")


def with_previous_window(stats: DataFrame) -> DataFrame:
    """Attach the window that ends where each one starts."""
    before = stats.select(
        "pool", F.col("window_end").alias("window_start"), F.col("unique_buyers").alias("previous_unique_buyers"),
        (F.col("buy_volume_usd") + F.col("sell_volume_usd")).alias("previous_volume_usd"),
    )
    return stats.join(before, ["pool", "window_start"], "left")


# ---- signals ------------------------------------------------------------------------------------


def _first_signals(rows: DataFrame) -> DataFrame:
    cols = [c for c in rows.columns if c not in st.SIGNAL_KEY]
    return rows.groupBy(*st.SIGNAL_KEY).agg(F.min_by(F.struct(*cols), "signal_snapshot_id").alias("r")).select(*st.SIGNAL_KEY, "r.*")


def signal_table(spark: SparkSession, path: str, every: int = 8) -> KeyedTable:
    """First crossings ever: of a key the lowest snapshot id stays, whenever it comes."""
    schema = ("token_id string, score_version string, threshold long, chain string, signal_source string, signal_snapshot_id long, "
              "signal_at timestamp, price_usd double, raw_score double, evidence_confidence string")
    return KeyedTable(spark, path, schema, st.SIGNAL_KEY, _first_signals, every=every)


def signal_stream(
    scores: DataFrame, table: KeyedTable, checkpoint: str, activation_id: int, thresholds: Sequence[int] = st.THRESHOLDS
) -> None:
    """Merge the first crossings of each micro-batch into the table."""
    each_batch(scores, lambda batch, batch_id: table.apply(st.first_crossings(batch, activation_id, thresholds), batch_id), checkpoint)


# ---- outcomes -----------------------------------------------------------------------------------

OUTCOME_KEY = (*st.SIGNAL_KEY, "horizon")


def _earliest(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*OUTCOME_KEY).agg(F.min(F.struct("obs_at", "obs_id", "obs_price")).alias("s")).select(*OUTCOME_KEY, "s.*")


class Outcomes:
    """Selected price of pending outcomes while snapshots stream by.

    A batch's valid prices meet the pending outcomes of their token in time buckets of ``width`` and are
    folded to one candidate per outcome before anything is written; of candidates the earliest stays,
    whenever it comes. The frontier is the newest observed time of any snapshot. ``pending`` gives the
    outcomes as they are when a batch begins; those must be stored before the prices of their windows.
    """

    def __init__(self, spark: SparkSession, root: str, every: int = 8):
        kinds = "token_id string, score_version string, threshold long, horizon string, obs_at timestamp, obs_id long, obs_price double"
        self.table = KeyedTable(spark, f"{root}/selected", kinds, OUTCOME_KEY, _earliest, every=every)
        self.frontier = KeyedTable(spark, f"{root}/frontier", "name string, reached timestamp", ("name",), _add_up(("name",), (), ("reached",)), buckets=1, every=every)

    def consume(self, snapshots: DataFrame, pending: Callable[[], DataFrame], checkpoint: str, width: int) -> None:
        def handle(batch: DataFrame, batch_id: int) -> None:
            if self.frontier.holds(batch_id):
                return
            prices = st.price_observations(batch, F.lit(2**62)).withColumn("slot", bucket_of(micros("obs_at"), width))
            ends = batch.agg(F.min("collected_at").alias("first"), F.max("collected_at").alias("last")).first()
            if ends["last"] is not None:
                # Windows that no price of the batch can fall into are not read.
                open_ = pending().filter((F.col("window_end_at") >= F.lit(ends["first"])) & (F.col("target_at") <= F.lit(ends["last"])))
                slots = F.sequence(bucket_of(micros("target_at"), width), bucket_of(micros("window_end_at"), width))
                spread = open_.select(*OUTCOME_KEY, "signal_at", "signal_snapshot_id", "target_at", "window_end_at", F.explode(slots).alias("slot"))
                rule = (
                    (F.col("obs_at") >= F.col("target_at")) & (F.col("obs_at") <= F.col("window_end_at"))
                    & (F.col("obs_at") > F.col("signal_at")) & (F.col("obs_id") > F.col("signal_snapshot_id"))
                )
                self.table.apply(_earliest(spread.join(prices, ["token_id", "slot"]).filter(rule)), batch_id)
            self.frontier.apply(batch.agg(F.max("collected_at").alias("reached")).select(F.lit("snapshots").alias("name"), "reached"), batch_id)

        each_batch(snapshots, handle, checkpoint)

    def settled(self, pending: DataFrame) -> DataFrame:
        """One row per outcome: matured with its price, insufficient once the frontier is strictly past its window, else pending."""
        row = self.frontier.read().first()
        past = F.lit(row["reached"] if row else None) > F.col("window_end_at")
        out = pending.select(*OUTCOME_KEY, "entry_price_usd", "window_end_at").join(self.table.read(), list(OUTCOME_KEY), "left")
        status = F.when(F.col("obs_id").isNotNull(), "MATURED").when(F.coalesce(past, F.lit(False)), "INSUFFICIENT_DATA").otherwise("PENDING")
        return out.select(
            *OUTCOME_KEY, status.alias("status"), F.col("obs_id").alias("selected_snapshot_id"), (F.col("obs_price") / F.col("entry_price_usd") - 1).alias("return_decimal")
        )


# ---- latest state -------------------------------------------------------------------------------


def state_table(spark: SparkSession, path: str, schema: str, every: int = 8) -> KeyedTable:
    """Monotonic latest observation per token: an older one, or an equally old one of a higher number, never replaces it."""

    def newest(rows: DataFrame) -> DataFrame:
        cols = F.struct(*[c for c in rows.columns if c != "token_id"])
        return rows.groupBy("token_id").agg(F.max_by(cols, F.struct("observed_at", -F.col("seq"))).alias("s")).select("token_id", "s.*")

    return KeyedTable(spark, path, schema, ("token_id",), newest, every=every)


def latest_state_stream(observations: DataFrame, table: KeyedTable, checkpoint: str) -> None:
    """Merge each micro-batch, reduced to one row per token, into the table."""
    each_batch(observations, lambda batch, batch_id: table.apply(table.merge(batch), batch_id), checkpoint)


def state_before(state: DataFrame, at: Column) -> DataFrame:
    """States usable as a baseline: strictly earlier than the observation boundary."""
    return state.filter(F.col("observed_at") < at)


# ---- count-gap episodes -------------------------------------------------------------------------

INSTRUMENT = ("asset_class", "instrument_id")


def episode_table(spark: SparkSession, path: str, max_gap: int = 3, every: int = 8) -> KeyedTable:
    """Listing episodes per instrument, by number of missed scans instead of time.

    An episode ends when the instrument is absent from ``max_gap`` scans in a row. It keeps the runs of
    consecutive scans it consists of: presences that come late, or twice, fall into the runs, extend or
    join them, and bridge two episodes where the gap closes. An instrument has one presence per scan at
    most, so its rows grow with time alone, and a run stands for all its presences.
    """

    def merge(rows: DataFrame) -> DataFrame:
        order = Window.partitionBy(*INSTRUMENT).orderBy("a", "b")
        runs = rows.select(*INSTRUMENT, F.inline("runs"))
        gap = F.col("a") - F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
        upto = order.rowsBetween(Window.unboundedPreceding, 0)
        begins = lambda most: F.when(gap.isNull() | (gap > most), 1).otherwise(0)
        marked = runs.withColumn("new_run", begins(1)).withColumn("new_episode", begins(max_gap))
        numbered = marked.withColumn("run", F.sum("new_run").over(upto)).withColumn("episode", F.sum("new_episode").over(upto))
        joined = numbered.groupBy(*INSTRUMENT, "episode", "run").agg(F.min("a").alias("a"), F.max("b").alias("b"))
        return joined.groupBy(*INSTRUMENT, "episode").agg(
            F.min("a").alias("first_seq"), F.max("b").alias("last_seq"), F.sum(F.col("b") - F.col("a") + 1).alias("appearances"),
            F.sort_array(F.collect_list(F.struct("a", "b"))).alias("runs"),
        ).drop("episode")

    schema = "asset_class string, instrument_id string, first_seq long, last_seq long, appearances long, runs array<struct<a:bigint,b:bigint>>"
    return KeyedTable(spark, path, schema, INSTRUMENT, merge, every=every)


def presence_stream(presences: DataFrame, table: KeyedTable, checkpoint: str) -> None:
    """Merge the presences (asset_class, instrument_id, seq) of each micro-batch into the episodes of their instruments."""
    seq = F.col("seq").cast("long")
    one = presences.select(*INSTRUMENT, seq.alias("first_seq"), seq.alias("last_seq"), F.lit(1).cast("long").alias("appearances"), F.array(F.struct(seq.alias("a"), seq.alias("b"))).alias("runs"))
    each_batch(one, lambda batch, batch_id: table.apply(table.merge(batch), batch_id), checkpoint)


def read_episodes(table: KeyedTable) -> DataFrame:
    """Episodes with ``closed``, whether a later one of the instrument has begun; the last one is still open."""
    last = F.max("first_seq").over(Window.partitionBy(*INSTRUMENT))
    return table.read().withColumn("closed", F.col("first_seq") < last).drop("runs")
