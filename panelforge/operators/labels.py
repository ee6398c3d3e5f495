"""Event labels by three barriers, and weights for labels that overlap in time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.ordering import running_sum


def held_bars(spans: DataFrame, bars: DataFrame, how: str = "inner") -> DataFrame:
    """Spans (symbol, event_start, t1, ...) beside each bar (symbol, date, ...) that they hold, both ends closed; an absent t1 is the last bar's date.

    A range join on (symbol, month): spans go to the months that they touch, so an event meets the bars of those months
    and not its symbol's whole history.
    """
    last = F.broadcast(bars.agg(F.max("date").alias("_last")))  # one row
    month = lambda c: F.trunc(c, "month")
    until = F.greatest("event_start", F.coalesce("t1", "_last"))
    dealt = spans.join(last).withColumn("_until", F.coalesce("t1", "_last")).withColumn("_month", F.explode(F.sequence(month(F.col("event_start")), month(until), F.expr("INTERVAL 1 MONTH"))))
    right = bars.withColumnRenamed("symbol", "_s").withColumn("_m", month(F.col("date")))
    on = (F.col("symbol") == F.col("_s")) & (F.col("_month") == F.col("_m")) & (F.col("date") >= F.col("event_start")) & (F.col("date") <= F.col("_until"))
    return dealt.join(right, on, how).drop("_last", "_until", "_month", "_s", "_m")


def triple_barrier(events: DataFrame, bars: DataFrame, pt: float, sl: float, entry: str = "close", drop: bool = False, meta: bool | str | None = None) -> DataFrame:
    """Labels of events (event_id, symbol, event_start, t1, target, side) over bars (symbol, date, close and, for entry at the open, open).

    Entry at the first close of the path, or at the open of event_start, where a missing one makes the event invalid.  The
    path is closed at both ends; the earliest touch decides, upper before lower before vertical; without t1 there is no
    vertical barrier.  The touched return is the path's at that date, the path's last where the date has no bar.  Meta
    bins are 1 for a return above 0 and else 0, plain ones the touch's sign, or the return's without barriers; ``meta`` says
    which, "any" takes meta bins for all where any event has a side, and None for each event that has one.  ``drop`` leaves out events without a return.
    """
    bars = bars.where("close is not null").select("symbol", "date", "close", *(["open"] if entry == "open" else []))
    path = held_bars(events, bars, "left")
    side = F.coalesce(F.col("side"), F.lit(1.0))
    w = W.partitionBy("event_id").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    if entry == "open":
        opened = F.max(F.when((F.col("date") == F.col("event_start")) & (F.col("open") > 0), F.col("open"))).over(w)
        least = 1
    else:
        opened, least = F.first("close", ignorenulls=True).over(w.orderBy("date")), 2
    path = path.withColumn("entry", opened).withColumn("r", (F.col("close") / F.col("entry") - 1) * side)
    none = F.lit(None).cast("date")
    touch_up = F.min(F.when(F.col("r") >= pt * F.col("target"), F.col("date"))) if pt else none
    touch_down = F.min(F.when(F.col("r") <= -sl * F.col("target"), F.col("date"))) if sl else none
    keys = ["event_id", "symbol", "event_start", "t1", "target", "side"]
    own = path.groupBy(*keys).agg(touch_up.alias("up"), touch_down.alias("down"), F.count("close").alias("n"), F.max("entry").alias("entry"), F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("date").isNotNull(), F.struct("date", "r"))))).alias("rs"), F.max_by("r", "date").alias("last_r"))
    touch = F.least("up", "down", "t1")
    invalid = F.col("target").isNull() | (F.col("target") <= 0)
    if entry == "open":
        invalid = invalid | F.col("entry").isNull()
    kind = F.when(invalid, "invalid").when(F.col("n") < least, "no_data").when(F.col("up") == touch, "upper").when(F.col("down") == touch, "lower").otherwise("vertical")
    out = own.withColumn("touch_time", touch).withColumn("touch_type", kind)
    out = out.withColumn("ret", F.when(~F.col("touch_type").isin("invalid", "no_data"), F.coalesce(F.try_element_at("rs", "touch_time"), F.col("last_r"))))
    plain = F.when(F.col("touch_type") == "upper", 1).when(F.col("touch_type") == "lower", -1).otherwise(0) if pt or sl else F.coalesce(F.signum("ret").cast("int"), F.lit(0))
    if meta == "any":  # one row: whether any event has a side
        out = out.join(F.broadcast(events.agg(F.coalesce(F.bool_or(F.col("side").isNotNull()), F.lit(False)).alias("_meta"))))
    told = {"any": F.col("_meta"), None: F.col("side").isNotNull()}.get(meta, F.lit(meta))
    out = out.withColumn("bin", F.when(told, meta_bin(F.col("ret"))).otherwise(plain)).select(*keys, "touch_time", "touch_type", "ret", "bin")
    return out.where("ret is not null and touch_type <> 'no_data'") if drop else out


def meta_bin(ret):
    """1 for a return above 0, else 0, also for none."""
    return F.when(ret > 0, 1).otherwise(0)


def with_side(events: DataFrame, sides: DataFrame) -> DataFrame:
    """Events with the side (symbol, event_start, side) of their key; a key that has several sides is an error when it is met."""
    one = sides.groupBy("symbol", "event_start").agg(F.count("*").alias("_n"), F.max("side").alias("side"))
    checked = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("several sides for "), F.col("symbol"))).cast("double")).otherwise(F.col("side").cast("double"))
    return events.drop("side").join(one, ["symbol", "event_start"], "left").withColumn("side", checked).drop("_n").select(*[c for c in events.columns if c != "side"], "side")


def concurrency(spans: DataFrame, bars: DataFrame) -> DataFrame:
    """(symbol, date, c): events (symbol, event_start, t1) that hold on each bar, by a sweep of +1 and -1 instead of a range join."""
    on = spans.select("symbol", F.col("event_start").alias("date"), F.lit(1).alias("d"), F.lit(0).alias("bar"))
    off = spans.where("t1 is not null").select("symbol", F.date_add("t1", 1).alias("date"), F.lit(-1).alias("d"), F.lit(0).alias("bar"))
    rows = bars.select("symbol", "date", F.lit(0).alias("d"), F.lit(1).alias("bar"))
    w = W.partitionBy("symbol").orderBy("date", "bar").rowsBetween(W.unboundedPreceding, 0)
    return on.union(off).union(rows).select("symbol", "date", "bar", F.sum("d").over(w).alias("c")).where("bar = 1").select("symbol", "date", "c")


def uniqueness(spans: DataFrame, bars: DataFrame) -> DataFrame:
    """(event_id, uniqueness, attribution): mean of 1/c over an event's bars, and the absolute sum of log returns over c; null for events without t1."""
    c = concurrency(spans, bars)
    r = bars.withColumn("_r", F.ln("close") - F.lag(F.ln("close")).over(W.partitionBy("symbol").orderBy("date"))).select("symbol", "date", "_r")
    held = held_bars(spans.where("t1 is not null"), c.join(r, ["symbol", "date"]))
    return held.groupBy("event_id", "symbol", "event_start").agg(F.avg(1 / F.nullif(F.col("c"), F.lit(0))).alias("uniqueness"), F.abs(F.sum(F.col("_r") / F.nullif(F.col("c"), F.lit(0)))).alias("attribution"))


def sample_weights(spans: DataFrame, bars: DataFrame, by: str = "uniqueness", decay: float | None = None, to_n: bool = True) -> DataFrame:
    """(event_id, uniqueness, attribution, decay, weight) of labels (event_id, symbol, event_start, t1).

    ``by``: "uniqueness" or "attribution", one of them, as attribution already divides by concurrency.  Absent factors
    count as 1.  ``decay``: weight of the oldest, linear in cumulative uniqueness (in rows, for attribution), in the order of
    event_start.  Weights sum to their number where their sum is above 0.
    """
    if by not in ("uniqueness", "attribution"):
        raise ValueError(by)
    known = spans.select("event_id", "symbol", "event_start").join(uniqueness(spans, bars), ["event_id", "symbol", "event_start"], "left")
    one = F.lit(1.0)
    if decay is None:
        rows = known.withColumn("decay", one)
    else:
        base = F.coalesce("uniqueness", one) if by == "uniqueness" else one
        aged = time_decay(known.select("event_id", "event_start", base.alias("uniqueness")), decay).select("event_id", "decay")
        rows = known.join(aged, "event_id")
    rows = rows.withColumn("weight", F.coalesce(by, one) * F.coalesce("decay", one))
    return (normalise(rows, "weight") if to_n else rows).select("event_id", "uniqueness", "attribution", "decay", "weight")


def time_decay(weighted: DataFrame, last: float = 1.0) -> DataFrame:
    """Adds ``decay``: linear in cumulative uniqueness in event order, 1 at the newest."""
    total = weighted.agg(F.sum("uniqueness").alias("_all"))
    cum = running_sum(weighted, "event_start", ["event_id"], "uniqueness", "_cum").join(F.broadcast(total))
    slope = (1 - last) / F.col("_all") if last >= 0 else 1 / ((last + 1) * F.col("_all"))
    return cum.withColumn("decay", F.greatest(F.lit(0.0), 1 - slope * F.col("_all") + slope * F.col("_cum"))).drop("_cum", "_all")


def normalise(weighted: DataFrame, column: str) -> DataFrame:
    """Weights that sum to the number of rows, where their sum is above zero."""
    total = weighted.agg(F.sum(column).alias("_s"), F.count("*").alias("_n"))
    return weighted.join(F.broadcast(total)).withColumn(column, F.when(F.col("_s") > 0, F.col(column) * F.col("_n") / F.col("_s")).otherwise(F.col(column))).drop("_s", "_n")
