"""Schemas of the panels and their invariants, checked in one aggregation pass for each table."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FAMILIES = {"int": (T.ByteType, T.ShortType, T.IntegerType, T.LongType), "float": (T.FloatType, T.DoubleType, T.DecimalType), "text": (T.StringType,), "bool": (T.BooleanType,), "time": (T.DateType, T.TimestampType, T.TimestampNTZType)}


class SchemaViolation(ValueError):
    """A table that is not what its schema says."""


@dataclass(frozen=True)
class Schema:
    """Required columns by family, the key, columns without nulls, and rules: a name and a test that a good row passes (null passes)."""

    name: str
    columns: dict[str, str]
    key: tuple[str, ...] = ()
    required: tuple[str, ...] = ()
    rules: dict[str, str] = field(default_factory=dict)


def _schema(name, columns, key, required=(), **rules):
    return Schema(name, dict(c.split(":") for c in columns.split()), tuple(key.split()), tuple(required), rules)


KEY = "symbol:text date:time "
DAILY = _schema("daily_bar", KEY + "open:float high:float low:float close:float volume:int amount:float", "symbol date", ("symbol", "date", "volume", "amount"), price_positive="close > 0 and open > 0", order_high="high >= greatest(open, close, low) - 1e-6", order_low="low <= least(open, close, high) + 1e-6", volume_positive="volume >= 0", amount_positive="amount >= 0")
UNIVERSE = _schema("universe", KEY + "in_universe:bool weight:float", "symbol date", ("symbol", "date", "in_universe"), weight_range="weight between 0 and 1 + 1e-6")
EVENT = _schema("event", "event_id:text symbol:text event_start:time t1:time target:float side:float", "event_id", ("event_id", "symbol", "event_start", "target"), target_positive="target > 0", ends_after_start="t1 > event_start", side_sign="side in (-1, 1)")
LABEL = _schema("label", "event_id:text symbol:text event_start:time t1:time touch_time:time touch_type:text ret:float bin:int", "event_id", ("event_id", "bin"), bin_known="bin in (-1, 0, 1)", touch_inside="touch_time between event_start and t1", type_known="touch_type in ('upper', 'lower', 'vertical', 'no_data', 'invalid')")
WEIGHT = _schema("sample_weight", "event_id:text uniqueness:float final_weight:float", "event_id", ("final_weight",), weight_positive="final_weight >= 0", uniqueness_range="uniqueness between 0 and 1 + 1e-6")
CONCEPT = _schema("concept", "symbol:text concept_code:text effective_date:time expired_date:time", "symbol concept_code effective_date", ("symbol", "effective_date"), ends_after_start="expired_date >= effective_date")
INDUSTRY = _schema("industry", KEY + "system:text level:int industry_code:text parent_code:text", "symbol date system level", ("symbol", "date"), parent_known="level = 1 or parent_code is not null")
FUNDAMENTAL = _schema("fundamental", "symbol:text report_period:time announce_date:time available_at:time report_type:text forecast_min:float forecast_max:float", "", ("symbol", "report_period"), range_order="forecast_min <= forecast_max", announced_after_period="report_type = 'forecast' or announce_date >= report_period", available_after_announced="available_at >= announce_date")
MARGIN = _schema("margin_trading", KEY + "available_at:time fin_balance:float", "symbol date", ("fin_balance",), balance_positive="fin_balance >= 0", available_later="available_at > date")
MONEY_FLOW = _schema("money_flow", KEY + "available_at:time net_amount_main:float net_amount_xl:float net_amount_l:float", "symbol date", (), main_is_sum="abs(net_amount_main - net_amount_xl - net_amount_l) <= 1", available_later="available_at > date")
AUCTION = _schema("call_auction", KEY + "available_at:time auction_volume:float auction_amount:float bid1_price:float ask1_price:float", "symbol date", (), volume_positive="auction_volume >= 0 and auction_amount >= 0", book_order="bid1_price <= ask1_price", available_same_day="to_date(available_at) = to_date(date)")
BILLBOARD = _schema("billboard", KEY + "direction:text buy_value:float sell_value:float net_value:float", "", (), direction_known="direction in ('BUY', 'SELL', 'ALL')", net_is_difference="abs(net_value - buy_value + sell_value) <= 1")
INTRADAY = _schema("intraday_bar", "symbol:text ts:time close:float volume:int session:text adj_factor:float", "symbol ts", ("session", "adj_factor"), session_known="session in ('morning', 'afternoon')")
FACTOR = _schema("factor_exposure", KEY + "factor:text value:float", "symbol date factor", ("factor",))
SCHEMAS = {s.name: s for s in (DAILY, UNIVERSE, EVENT, LABEL, WEIGHT, CONCEPT, INDUSTRY, FUNDAMENTAL, MARGIN, MONEY_FLOW, AUCTION, BILLBOARD, INTRADAY, FACTOR)}


def check_types(df: DataFrame, schema: Schema) -> None:
    have = {f.name: f.dataType for f in df.schema}
    for name, family in schema.columns.items():
        if name not in have:
            raise SchemaViolation(f"{schema.name}: no column {name}")
        if not isinstance(have[name], FAMILIES[family]):
            raise SchemaViolation(f"{schema.name}: {name} is {have[name].simpleString()}, not of family {family}")


def _bad(test: Column) -> Column:
    return F.count_if(~F.coalesce(test, F.lit(True)))


def report(df: DataFrame, schema: Schema) -> DataFrame:
    """(rule, bad): rows that break each rule; the key costs one more aggregation, as it shuffles on the key."""
    check_types(df, schema)
    tests = {f"{c}_null": F.count_if(F.col(c).isNull()) for c in schema.required} | {n: _bad(F.expr(e)) for n, e in schema.rules.items()}
    one = df.agg(*(t.cast("long").alias(n) for n, t in tests.items()))
    out = one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(n).alias("bad")) for n in tests))).alias("r")).select("r.rule", "r.bad")
    if schema.key:
        twice = df.groupBy(*schema.key).agg((F.count(F.lit(1)) - 1).alias("k")).agg(F.coalesce(F.sum("k"), F.lit(0)).cast("long").alias("bad"))
        out = out.union(twice.select(F.lit("key_repeats"), "bad"))
    return out


def validate(df: DataFrame, schema: Schema) -> DataFrame:
    """The table itself, or SchemaViolation with the counts of what is broken."""
    broken = {r["rule"]: r["bad"] for r in report(df, schema).where("bad > 0").collect()}
    if broken:
        raise SchemaViolation(f"{schema.name}: {broken}")
    return df


def weights_sum_to_one(universe: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """(date, total): dates whose weights do not."""
    return universe.groupBy("date").agg(F.sum("weight").alias("total")).where(F.abs(F.col("total") - 1) > tolerance)


def one_factor_a_day(bars: DataFrame) -> DataFrame:
    """(symbol, date, factors): days whose intraday bars have more than one adjustment factor."""
    return bars.groupBy("symbol", F.to_date("ts").alias("date")).agg(F.count_distinct("adj_factor").alias("factors")).where("factors > 1")


def weights_sum_to_count(weights: DataFrame, slack: float = 0.05) -> DataFrame:
    """(total, n, fine): whether final weights add up to their number, within ``slack`` of it and one."""
    one = weights.agg(F.coalesce(F.sum("final_weight"), F.lit(0.0)).alias("total"), F.count("*").alias("n"))
    return one.withColumn("fine", F.abs(F.col("total") - F.col("n")) <= slack * F.col("n") + 1)
