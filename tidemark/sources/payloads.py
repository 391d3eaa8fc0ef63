"""Typed ingestion of landed API payloads.

A payload frame has one document per row: ``payload`` (JSON text) plus the columns that say where
it came from (``file``, ``chain``, ``source``, ``page``, ``collected_at`` as the job needs). Every
function is row-wise on documents, so the same code serves batch folders and streams; look-ups
inside a document use array functions instead of joins. Documents that break a rule go to a
quarantine frame with the reason and never turn into partial rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidemark.functions import quality as q
from tidemark.functions.identity import canonical_address, token_id
from tidemark.functions.timecol import HOUR, micros, plus
from tidemark.operators.bars import FRAMES
from tidemark.operators.candidates import SOURCE_BOOST
from tidemark.session import staged

# Payload shapes and limits.
_WINDOWS = "m5:string,h1:string,h6:string,h24:string"
_TX = "struct<buys:int,sells:int,buyers:int,sellers:int>"
POOLS = (
    "struct<data:array<struct<id:string,type:string,attributes:struct<address:string,pool_created_at:string,"
    "base_token_price_usd:string,fdv_usd:string,market_cap_usd:string,reserve_in_usd:string,"
    f"price_change_percentage:struct<{_WINDOWS}>,transactions:struct<m5:{_TX},h1:{_TX},h6:{_TX},h24:{_TX}>,"
    f"volume_usd:struct<{_WINDOWS}>>,relationships:struct<base_token:struct<data:struct<id:string>>>>>,"
    "included:array<struct<id:string,attributes:struct<address:string,name:string,symbol:string>>>>"
)
TRADES = (
    "struct<data:array<struct<id:string,type:string,attributes:struct<tx_from_address:string,kind:string,"
    "volume_in_usd:string,block_timestamp:string>>>>"
)
_PTX = "struct<buys:int,sells:int>"
_NUM = "m5:double,h1:double,h6:double,h24:double"
PAIRS = (
    "array<struct<chainId:string,pairAddress:string,baseToken:struct<address:string,name:string,symbol:string>,"
    f"priceUsd:string,txns:struct<m5:{_PTX},h1:{_PTX},h6:{_PTX},h24:{_PTX}>,volume:struct<{_NUM}>,"
    f"priceChange:struct<{_NUM}>,liquidity:struct<usd:double>,fdv:double,marketCap:double,pairCreatedAt:bigint,"
    "info:struct<websites:array<struct<label:string,url:string>>,socials:array<struct<type:string,url:string>>>,"
    "boosts:struct<active:int>>>"
)
BOOSTS = "array<struct<chainId:string,tokenAddress:string>>"
INSTRUMENTS = (
    "struct<code:string,msg:string,data:array<struct<instId:string,baseCcy:string,instCategory:string,ruleType:string,"
    "state:string,listTime:string,tickSz:string>>>"
)
TICKERS = (
    "struct<code:string,msg:string,data:array<struct<instId:string,last:string,open24h:string,volCcy24h:string,ts:string>>>"
)
OPEN_INTEREST = "struct<code:string,msg:string,data:array<struct<instId:string,oiUsd:string>>>"
FUNDING = "struct<code:string,msg:string,data:array<struct<instId:string,fundingRate:string>>>"
CANDLES = "struct<code:string,msg:string,data:array<array<string>>>"
MAX_POOL_AGE = 6 * HOUR
TRADE_PAGE = 300  # a page this full may have been cut by the sender
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"
POOL_NUMBERS = {
    "price_usd": ("base_token_price_usd",), "market_cap_usd": ("market_cap_usd",), "fdv_usd": ("fdv_usd",),
    "liquidity_usd": ("reserve_in_usd",),
    "volume_m5_usd": ("volume_usd", "m5"), "volume_h1_usd": ("volume_usd", "h1"), "volume_h6_usd": ("volume_usd", "h6"),
    "volume_24h_usd": ("volume_usd", "h24"),
    "price_change_m5": ("price_change_percentage", "m5"), "price_change_h1": ("price_change_percentage", "h1"),
    "price_change_h6": ("price_change_percentage", "h6"), "price_change_h24": ("price_change_percentage", "h24"),
}
TRANSACTION_FIELDS = {"buys": "buys", "sells": "sells", "buyers": "aggregate_buyers", "sellers": "aggregate_sellers"}
SPANS = ("m5", "h1", "h6", "h24")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole JSON documents of a folder with their file name."""
    return spark.read.text(path, wholetext=True).select(
        F.col("value").alias("payload"), F.col("_metadata.file_path").alias("file")
    )


def parse(payloads: DataFrame, shape: str) -> DataFrame:
    """Parse each document once.

    The one-element generator keeps the optimizer from copying the parser into every filter and
    field that refers to the document. The outer form keeps it from testing the array beforehand,
    which would parse the document a second time.
    """
    return payloads.select("*", F.inline_outer(F.array(F.struct(F.from_json("payload", shape).alias("doc")))))


def judge(docs: DataFrame, reason: Column) -> DataFrame:
    """Attach the rejection reason, evaluated once per document."""
    return docs.select("*", F.inline_outer(F.array(F.struct(reason.alias("reason")))))


def number(text: Column) -> Column:
    """Double from plain decimal text; NULL for anything else, blanks and type suffixes included."""
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def unusable(shape: str) -> Column:
    """Why a parsed document cannot be used at all: unreadable, or answered with an error code; NULL if it can."""
    reason = F.when(F.col("doc").isNull(), "unreadable")
    if shape.startswith("struct"):
        if "code:string" in shape:
            reason = reason.when(F.col("doc.code") != "0", "refused")
        reason = reason.when(F.col("doc.data").isNull(), "unreadable")
    return reason


def _split(payloads: DataFrame, shape: str) -> tuple[DataFrame, DataFrame]:
    """(usable parsed documents, refused documents with the reason)."""
    judged = judge(parse(payloads, shape), unusable(shape))
    return judged.filter(F.col("reason").isNull()).drop("reason"), judged.filter(F.col("reason").isNotNull()).drop("doc")


def instant(text: Column) -> Column:
    """Timestamp from RFC 3339 text; NULL for anything else."""
    return F.when(text.rlike(RFC3339), text.try_cast("timestamp"))


def _field(base: Column, path: Sequence[str]) -> Column:
    for part in path:
        base = base[part]
    return base


def pool_market(numbers: dict[str, Column], counters: dict[str, Column], at: Column, source: str = "pools") -> dict[str, Column]:
    """Tagged numbers and counters of one pool; absent windows and nulls are missing."""
    return {name: q.fresh_or_missing(value, source, at) for name, value in (numbers | counters).items()}


def flat_pools(docs: DataFrame) -> DataFrame:
    """One row per pool with its base token looked up inside the same document; a document without pools, or with a reason, is one row."""
    pools = F.when(F.col("reason").isNull(), F.col("doc.data")) if "reason" in docs.columns else F.col("doc.data")
    flat = docs.select("*", F.posexplode_outer(pools).alias("pos", "pool"))
    ref = F.col("pool.relationships.base_token.data.id")
    matches = F.filter("doc.included", lambda t: t["id"] == ref)
    token = F.get(matches, F.size(matches) - 1)["attributes"]
    prefix = F.concat(F.col("chain"), F.lit("_"))
    stripped = F.when(F.startswith(ref, prefix), F.substr(ref, F.length(prefix) + 1)).otherwise(ref)
    raw = F.when(F.coalesce(token["address"], F.lit("")) != "", token["address"]).otherwise(stripped)
    address = canonical_address(F.col("chain"), raw)
    return (
        flat.withColumn("address", address).withColumn("name", F.coalesce(token["name"], F.lit("")))
        .withColumn("symbol", F.coalesce(token["symbol"], F.lit("")))
        .withColumn("token_id", token_id(F.col("chain"), F.col("address")))
        .withColumn("pool_address", canonical_address(F.col("chain"), F.col("pool.attributes.address")))
    )


_NUMBERS = tuple(POOL_NUMBERS)
_COUNTERS = {f"{name}_{span}": (span, raw) for span in SPANS for raw, name in TRANSACTION_FIELDS.items()}


def _read_pools(payloads: DataFrame) -> DataFrame:
    """Pools with typed numbers, written once: one pass parses a document, judges it and reads every number of it once.

    ``__late`` marks documents with a pool whose creation time does not parse, ``bad_number`` pools of which a number does not; the text of a document stays with its first row.
    """
    meta = [c for c in payloads.columns if c != "payload"]
    docs = judge(parse(payloads.withColumn("__doc", F.monotonically_increasing_id()), POOLS), unusable(POOLS))
    late = F.exists("doc.data", lambda p: instant(p["attributes"]["pool_created_at"]).isNull())
    flat = flat_pools(docs.withColumn("late", F.col("reason").isNull() & F.coalesce(late, F.lit(False))))
    read = flat.withColumns({f"__{name}": number(_field(F.col("pool.attributes"), path)) for name, path in POOL_NUMBERS.items()})
    bad = F.lit(False)
    for name, path in POOL_NUMBERS.items():
        bad = bad | (_field(F.col("pool.attributes"), path).isNotNull() & F.col(f"__{name}").isNull())
    counters = [F.col("pool.attributes.transactions")[span][raw].cast("double").alias(f"__{name}") for name, (span, raw) in _COUNTERS.items()]
    rows = read.select(
        *meta, "__doc", F.when(F.coalesce(F.col("pos"), F.lit(0)) == 0, F.col("payload")).alias("payload"), "reason", F.col("late").alias("__late"), "pos", "token_id", "address", "name", "symbol",
        "pool_address", instant(F.col("pool.attributes.pool_created_at")).alias("pool_created_at"), bad.alias("bad_number"),
        *[f"__{name}" for name in _NUMBERS], *counters,
    )
    return staged(rows, "landed-pools")


def _market(at: Column) -> list[Column]:
    values = pool_market({n: F.col(f"__{n}") for n in _NUMBERS}, {n: F.col(f"__{n}") for n in _COUNTERS}, at)
    return [v.alias(k) for k, v in values.items()]


def new_pools(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidates, quarantine) of new-pool documents with chain, page, run_id and collected_at.

    Pools older than six hours are dropped and the first pool per token and run stands for it, in the
    order of pages and positions and before its numbers are looked at. A document with a bad creation
    time, or a bad number in a pool that stands for its token, is quarantined whole; the tokens its pools
    stand for go with it, while what is wrong with a repeated pool does not matter.
    """
    rows = _read_pools(payloads)
    # A document is one page of an interface, so its pools are few.
    document = Window.partitionBy("__doc")
    recent = rows.filter(~F.col("__late") & (F.col("pool_created_at") >= F.timestamp_micros(micros("collected_at") - MAX_POOL_AGE)))
    first = recent.groupBy("run_id", "token_id").agg(F.min_by(F.struct(*[c for c in rows.columns if c not in ("run_id", "token_id", "payload", "__late")]), F.struct("page", "pos")).alias("r"))
    chosen = first.select("run_id", "token_id", "r.*").withColumn("__bad", F.max(F.col("bad_number").cast("int")).over(document) == 1)
    candidates = chosen.filter(~F.col("__bad")).select(
        "run_id", "chain", "page", "pos", "collected_at", "token_id", "address", "name", "symbol", "pool_address",
        "pool_created_at", F.lit("LAUNCH").alias("origin"), *_market(F.col("collected_at")),
    )
    meta = payloads.columns
    heads = rows.filter(F.col("pos").isNull() | (F.col("pos") == 0))
    wrong = heads.withColumn("reason", F.when(F.col("__late"), "bad_pool_created_at").otherwise(F.col("reason"))).filter(F.col("reason").isNotNull())
    numbers = heads.join(chosen.filter("__bad").select("__doc").distinct(), "__doc").withColumn("reason", F.lit("bad_number"))
    return candidates, wrong.select(*meta, "reason").unionByName(numbers.select(*meta, "reason"))


def momentum_pools(payloads: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(candidates, report, refused) of trending and top-volume documents: no age cut, bad rows are skipped.

    The first good pool per token, source and run wins. The report counts returned and distinct items per
    chain, source and run with the first error; a bad number behind the token's good pool is none.
    """
    rows = _read_pools(payloads)
    place = F.struct("page", "pos")
    untimed = F.col("pool_created_at").isNull()
    good = ~untimed & ~F.col("bad_number")
    kept = F.struct(*[c for c in rows.columns if c not in ("run_id", "chain", "source", "token_id", "payload", "__late")])
    tokens = rows.filter(F.col("pos").isNotNull()).groupBy("run_id", "chain", "source", "token_id").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.when(untimed, place)).alias("untimed"), F.min(F.when(~untimed & F.col("bad_number"), place)).alias("wrong"),
        F.min(F.when(good, place)).alias("at"), F.min_by(kept, F.when(good, place)).alias("r"),
    )
    errors = F.least(
        F.when(F.col("untimed").isNotNull(), F.struct(F.col("untimed").alias("at"), F.lit("bad_pool_created_at").alias("code"))),
        F.when(F.col("wrong").isNotNull() & F.coalesce(F.col("wrong") < F.col("at"), F.lit(True)), F.struct(F.col("wrong").alias("at"), F.lit("bad_number").alias("code"))),
    )
    report = tokens.groupBy("run_id", "chain", "source").agg(
        F.sum("n").alias("returned_items"), F.count("at").alias("unique_candidates"), F.min(errors)["code"].alias("first_error"),
    )
    candidates = tokens.filter(F.col("at").isNotNull()).select("run_id", "chain", "source", "token_id", "r.*").select(
        "run_id", "chain", "source", "collected_at", "token_id", "address", "name", "symbol",
        F.col("pool_address").alias("trigger_pool_address"), F.col("pool_created_at").alias("trigger_pool_created_at"),
        F.lit("MOMENTUM").alias("origin"), F.array("source").alias("momentum_sources"), *_market(F.col("collected_at")),
    )
    return candidates, report, rows.filter(F.col("reason").isNotNull()).select(*payloads.columns, "reason")


def pool_trades(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(trades, quarantine): every trade of each document; ``truncated`` marks documents that fill a page.

    One bad trade rejects the document.
    """
    docs = parse(payloads, TRADES)

    def some(test) -> Column:
        return F.exists("doc.data", lambda t: test(t["attributes"]))

    reason = (
        F.when(F.col("doc").isNull() | F.col("doc.data").isNull(), "unreadable")
        .when(some(lambda a: F.coalesce(F.trim(a["tx_from_address"]), F.lit("")) == ""), "missing_address")
        .when(some(lambda a: ~F.coalesce(a["kind"].isin("buy", "sell"), F.lit(False))), "unknown_side")
        .when(some(lambda a: number(a["volume_in_usd"]).isNull()), "bad_volume")
        .when(some(lambda a: instant(a["block_timestamp"]).isNull()), "bad_time")
    )
    judged = judge(docs, reason)
    good = judged.filter(F.col("reason").isNull()).withColumn("truncated", F.size("doc.data") >= TRADE_PAGE)
    flat = good.select("*", F.posexplode("doc.data").alias("pos", "t"))
    trades = flat.select(
        "chain", "pool", "collected_at", "truncated", "pos",
        canonical_address(F.col("chain"), F.col("t.attributes.tx_from_address")).alias("address"),
        F.col("t.attributes.kind").alias("side"), number(F.col("t.attributes.volume_in_usd")).alias("volume_usd"),
        instant(F.col("t.attributes.block_timestamp")).alias("traded_at"),
    )
    return trades, judged.filter(F.col("reason").isNotNull()).drop("doc")


def links(info: Column) -> Column:
    """Website and social links with their kind; empty addresses are dropped."""
    def link(kind: Column, url: Column) -> Column:
        return F.struct(kind.alias("kind"), url.alias("url"))

    def social(s: Column) -> Column:
        t = F.lower(s["type"])
        return link(F.when(t.isin("twitter", "x"), "x").when(t == "telegram", "telegram").otherwise("other"), s["url"])

    none = F.array().cast("array<struct<kind:string,url:string>>")
    sites = F.transform(F.filter(info["websites"], lambda w: w["url"] != ""), lambda w: link(F.lit("website"), w["url"]))
    others = F.transform(F.filter(info["socials"], lambda s: s["url"] != ""), social)
    return F.concat(F.coalesce(sites, none), F.coalesce(others, none))


def token_pairs(payloads: DataFrame, source: str = "pairs") -> tuple[DataFrame, DataFrame]:
    """(pairs, refused documents): a pair has tagged fields, links and boosts; ``bad_price`` marks an unparsable price."""
    docs, refused = _split(payloads, PAIRS)
    flat = docs.select("*", F.posexplode("doc").alias("pos", "p"))
    at = F.col("collected_at")
    chain = F.col("p.chainId")
    tag = lambda v: q.fresh_or_missing(v.cast("double"), source, at)
    cols = {
        "price_usd": tag(number(F.col("p.priceUsd"))), "market_cap_usd": tag(F.col("p.marketCap")),
        "fdv_usd": tag(F.col("p.fdv")), "liquidity": tag(F.col("p.liquidity.usd")),
        "volume_m5_usd": tag(F.col("p.volume.m5")), "volume_h1_usd": tag(F.col("p.volume.h1")),
        "volume_h6_usd": tag(F.col("p.volume.h6")), "volume_24h_usd": tag(F.col("p.volume.h24")),
        "boosts_active": tag(F.col("p.boosts.active")),
    }
    for span in SPANS:
        cols[f"price_change_{span}"] = tag(F.col(f"p.priceChange.{span}"))
        cols[f"buys_{span}"] = tag(F.col(f"p.txns.{span}.buys"))
        cols[f"sells_{span}"] = tag(F.col(f"p.txns.{span}.sells"))
    address = canonical_address(chain, F.col("p.baseToken.address"))
    pairs = flat.filter(F.coalesce(F.col("p.baseToken.address"), F.lit("")) != "").select(
        "file", "collected_at", "pos", chain.alias("chain"), token_id(chain, address).alias("token_id"), address.alias("address"),
        F.col("p.baseToken.name").alias("name"), F.col("p.baseToken.symbol").alias("symbol"),
        canonical_address(chain, F.col("p.pairAddress")).alias("pair_address"),
        F.timestamp_millis(F.col("p.pairCreatedAt")).alias("pair_created_at"), F.col("p.liquidity.usd").alias("liquidity_usd"),
        links(F.col("p.info")).alias("links"),
        (F.col("p.priceUsd").isNotNull() & number(F.col("p.priceUsd")).isNull()).alias("bad_price"),
        *[v.alias(k) for k, v in cols.items()],
    )
    return pairs, refused


def boost_seeds(payloads: DataFrame, chains: Sequence[str] = ("bsc", "solana")) -> tuple[DataFrame, DataFrame]:
    """(addresses named by boosts on known chains, refused documents); the addresses carry no market evidence."""
    docs, refused = _split(payloads, BOOSTS)
    flat = docs.select("*", F.posexplode("doc").alias("pos", "b"))
    chain = F.col("b.chainId")
    ok = chain.isin(*chains) & (F.coalesce(F.col("b.tokenAddress"), F.lit("")) != "")
    address = canonical_address(chain, F.col("b.tokenAddress"))
    seeds = flat.filter(ok).select(
        "collected_at", "pos", chain.alias("chain"), address.alias("address"), token_id(chain, address).alias("token_id"),
        F.lit("MOMENTUM").alias("origin"), F.array(F.lit(SOURCE_BOOST)).alias("momentum_sources"),
    )
    return seeds, refused


def derivatives_batch(
    instruments: DataFrame, tickers: DataFrame, open_interest: DataFrame, funding: DataFrame, on: Sequence[str] = ("batch",)
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(snapshots with listing metadata, warnings, refused documents by kind) from four document kinds of the same batch.

    Inner join of instruments and tickers, left joins for the optional measures. Instruments must
    be live, not pre-market, of category 1 (crypto) or 3 (stock).
    """
    on = list(on)
    key = [*on, "instId"]
    kinds = {"instruments": (instruments, INSTRUMENTS), "tickers": (tickers, TICKERS), "open_interest": (open_interest, OPEN_INTEREST), "funding": (funding, FUNDING)}
    items, refused = {}, None
    for kind, (payloads, shape) in kinds.items():
        docs, wrong = _split(payloads, shape)
        items[kind] = docs.select(*on, *(["collected_at"] if kind == "instruments" else []), F.inline("doc.data"))
        wrong = wrong.select(*on, F.lit(kind).alias("kind"), "payload", "reason")
        refused = wrong if refused is None else refused.unionByName(wrong)
    cls = F.when(F.col("instCategory") == "1", "crypto").when(F.col("instCategory") == "3", "stock")
    live = (F.col("state") == "live") & ~F.coalesce(F.col("ruleType") == "pre_market", F.lit(False))
    inst = items["instruments"].withColumn("asset_class", cls).filter(live & F.col("asset_class").isNotNull())
    tick = items["tickers"]
    oi = items["open_interest"].withColumn("open_interest_usd", number(F.col("oiUsd"))).drop("oiUsd")
    rate = items["funding"].withColumn("funding_rate", number(F.col("fundingRate"))).drop("fundingRate")
    rows = inst.join(tick, key).join(oi, key, "left").join(rate, key, "left")
    last, opened, volume = number(F.col("last")), number(F.col("open24h")), number(F.col("volCcy24h"))
    source_ms = F.col("ts").try_cast("bigint")
    listed_ms, tick_size = F.col("listTime").try_cast("bigint"), number(F.col("tickSz"))
    no = lambda test: ~F.coalesce(test, F.lit(False))
    warning = (
        F.when(no(last > 0), "bad_last_price").when(no(opened > 0), "bad_24h_open").when(no(volume >= 0), "bad_24h_volume")
        .when(source_ms.isNull(), "bad_timestamp")
    )
    listing_ok = F.coalesce((listed_ms > 0) & (tick_size > 0) & (tick_size != float("inf")), F.lit(False))
    judged = rows.withColumn("warning", warning)
    symbol = F.when(F.coalesce(F.col("baseCcy"), F.lit("")) != "", F.col("baseCcy")).otherwise(
        F.split_part(F.col("instId"), F.lit("-"), F.lit(1))
    )
    snapshots = judged.filter(F.col("warning").isNull()).select(
        *on, "asset_class", F.col("instId").alias("instrument_id"), symbol.alias("symbol"), "collected_at",
        F.timestamp_millis(source_ms).alias("source_time"), last.alias("price_usd"),
        ((last / opened - 1) * 100).alias("change_24h_pct"), (volume * last).alias("turnover_24h_usd"),
        "open_interest_usd", "funding_rate",
        F.when(listing_ok, F.timestamp_millis(listed_ms)).alias("listed_at"), F.when(listing_ok, tick_size).alias("tick_size"),
    )
    listing = judged.filter(F.col("warning").isNull() & ~listing_ok).withColumn("warning", F.lit("bad_listing"))
    warned = judged.filter(F.col("warning").isNotNull()).unionByName(listing)
    return snapshots, warned.select(*on, F.col("instId").alias("instrument_id"), "warning"), refused


def candle_rows(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candles, quarantine) of candle documents with instrument_id and timeframe.

    A row has nine texts: time, open, high, low, close, base volume at 5, quote volume at 7 and the
    completed flag; one bad row or a repeated time rejects the document.
    """
    docs = parse(payloads, CANDLES)

    def bad(r: Column) -> Column:
        nums = [number(r[i]) for i in range(1, 8)]
        finite = F.lit(True)
        for v in nums:
            finite = finite & v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
        fine = (
            (F.size(r) == 9) & (r[0].try_cast("bigint") > 0) & finite & (nums[0] > 0) & (nums[1] > 0) & (nums[2] > 0)
            & (nums[3] > 0) & (nums[4] >= 0) & (nums[5] >= 0) & (nums[6] >= 0) & (nums[1] >= nums[2]) & r[8].isin("0", "1")
        )
        return F.when(F.size(r) != 9, True).otherwise(~F.coalesce(fine, F.lit(False)))

    width: Column | None = None
    for name, us in FRAMES.items():
        test = F.col("timeframe") == name
        width = F.when(test, F.lit(us)) if width is None else width.when(test, F.lit(us))
    times = F.transform("doc.data", lambda r: r[0])
    reason = (
        F.when(F.col("doc").isNull() | (F.col("doc.code") != "0") | F.col("doc.data").isNull(), "unreadable")
        .when(width.isNull(), "unknown_timeframe").when(F.exists("doc.data", bad), "bad_row")
        .when(F.size(F.array_distinct(times)) < F.size(times), "repeated_time")
    )
    judged = judge(docs, reason).withColumn("width", width)
    flat = judged.filter(F.col("reason").isNull()).select("instrument_id", "timeframe", "width", F.explode("doc.data").alias("r"))
    r = F.col("r")
    open_time = F.timestamp_millis(r[0].try_cast("bigint"))
    candles = flat.select(
        "instrument_id", "timeframe", open_time.alias("open_time"), plus(open_time, F.col("width")).alias("close_time"),
        number(r[1]).alias("open"), number(r[2]).alias("high"), number(r[3]).alias("low"), number(r[4]).alias("close"),
        number(r[5]).alias("volume_base"), number(r[7]).alias("volume_quote"), (r[8] == "1").alias("confirmed"),
    )
    return candles, judged.filter(F.col("reason").isNotNull()).drop("doc", "width")


def latest_candles(candles: DataFrame, ingested: str) -> DataFrame:
    """Newest delivery of each bar when frames are refreshed piece by piece."""
    keys = ("instrument_id", "timeframe", "open_time")
    cols = F.struct(*[c for c in candles.columns if c not in keys])
    return candles.groupBy(*keys).agg(F.max_by(cols, ingested).alias("r")).select(*keys, "r.*")


# ---- stored rows --------------------------------------------------------------------------------

SNAPSHOT_JSON = {
    "score_breakdown_json": "struct<version:string,raw_score:double,final:double,evidence_available:int>",
    "risk_flags_json": "array<string>",
    "data_quality_json": "map<string,string>",
    "momentum_sources_json": "array<string>",
}


def decode_snapshot(rows: DataFrame) -> DataFrame:
    """Decode the JSON columns of stored snapshots; scalar columns override what the JSON repeats.

    A NULL measure is missing whatever its stored quality says.
    """
    out = rows
    for column, shape in SNAPSHOT_JSON.items():
        if column in rows.columns:
            out = out.withColumn(column.removesuffix("_json"), F.from_json(column, shape)).drop(column)
    if "score_breakdown" in out.columns and "raw_score" in out.columns:
        part = F.col("score_breakdown")
        out = out.withColumn(
            "score_breakdown", part.withField("raw_score", F.coalesce(F.col("raw_score"), part["raw_score"]))
        )
    if "data_quality" in out.columns and "price_usd" in out.columns:
        stored = F.coalesce(F.col("data_quality")["price_usd"], F.lit(q.FRESH))
        out = out.withColumn("price_quality", F.when(F.col("price_usd").isNull(), q.MISSING).otherwise(q.canonical_quality(stored)))
    return out


def evolve(older: DataFrame, newer: DataFrame) -> DataFrame:
    """Old and new rows under the union of their columns; added columns are NULL in old rows."""
    return older.unionByName(newer, allowMissingColumns=True)
