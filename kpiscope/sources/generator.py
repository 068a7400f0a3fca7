"""A seeded structural model of the business, with planted effects and a counterfactual.

Every cell-day is a row of ``spark.range`` crossed with small dimensions; noise is a hash of the
cell and day, so any part of the data can be made anywhere and is the same each time.
"""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiscope.functions.calendar import days, promo_id


@dataclass(frozen=True)
class World:
    start: dt.date = dt.date(2026, 1, 1)
    end: dt.date = dt.date(2026, 8, 25)
    regions: tuple[str, ...] = ("North", "South", "East", "West")
    lines: Mapping[str, float] = field(default_factory=lambda: {"Apparel": 900.0, "Electronics": 6500.0, "Home": 2100.0, "SmartHome": 4200.0})
    warehouses: Mapping[str, str] = field(default_factory=lambda: {"WH-N1": "North", "WH-N2": "North", "WH-S1": "South", "WH-E1": "East", "WH-W1": "West"})
    new_line: str = "SmartHome"
    new_region: str = "South"
    launch: dt.date = dt.date(2026, 8, 7)
    seed: int = 20260826
    treated: str = "North"
    shock_start: dt.date = dt.date(2026, 7, 31)
    shock_end: dt.date = dt.date(2026, 8, 23)
    effect: float = 0.86
    rival_line: str = "Electronics"
    rival_start: dt.date = dt.date(2026, 7, 25)
    rival_end: dt.date = dt.date(2026, 8, 12)
    rival_effect: float = 0.90


def noise(seed: int, *keys: Column | str) -> Column:
    """A standard normal number from a hash of the keys (Box-Muller on two hashes)."""
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    u = [(F.pmod(F.xxhash64(*cols, F.lit(seed + i)), F.lit(2**31 - 1)) + 1) / F.lit(float(2**31)) for i in (0, 1)]
    return F.sqrt(-2 * F.log(u[0])) * F.cos(2 * math.pi * u[1])


def uniform(seed: int, *keys: Column | str) -> Column:
    return F.pmod(F.xxhash64(*[F.col(k) if isinstance(k, str) else k for k in keys], F.lit(seed)), F.lit(2**31 - 1)) / F.lit(float(2**31 - 1))


def cell_days(spark: SparkSession, w: World) -> DataFrame:
    """Units and prices of each cell and day, with the units there would have been without the
    shock (``counterfactual_units``)."""
    cells = spark.createDataFrame([(r, p, price, 120.0 / (1 + i)) for r in w.regions for i, (p, price) in enumerate(w.lines.items())], "region string, product_line string, list_price double, level double")
    grid = days(spark, w.start, w.end).join(F.broadcast(cells), how="cross")
    d = F.col("date")
    sold_here = (F.col("product_line") != w.new_line) | ((F.col("region") == w.new_region) & (d >= F.lit(w.launch)))
    season = 1 + 0.10 * F.sin(2 * math.pi * F.dayofyear(d) / 182) + F.when(F.weekday(d) >= 5, 0.15).otherwise(0.0) + F.when(promo_id(d).isNotNull(), 0.20).otherwise(0.0)
    rival = F.when((F.col("product_line") == w.rival_line) & d.between(F.lit(w.rival_start), F.lit(w.rival_end)), w.rival_effect).otherwise(1.0)
    # A region's day-to-day dispatch quality reaches its orders three days later.
    lagged = noise(w.seed + 30, F.date_sub(d, 3), "region")
    plain = F.col("level") * season * rival * F.exp(0.03 * noise(w.seed, d, "region", "product_line") + 0.06 * lagged)
    hit = (F.col("region") == w.treated) & d.between(F.lit(w.shock_start), F.lit(w.shock_end))
    return grid.where(sold_here).withColumns({"counterfactual_units": F.round(plain), "units_shipped": F.round(plain * F.when(hit, w.effect).otherwise(1.0)), "hit": hit})


def orders(spark: SparkSession, w: World = World()) -> DataFrame:
    c = cell_days(spark, w)
    gross = F.round(F.col("units_shipped") * F.col("list_price"), 2)
    return c.select(
        F.concat_ws("-", F.lit("O"), "date", "region", "product_line").alias("source_row_id"), "date", "region", "product_line", "units_shipped",
        F.floor(F.col("units_shipped") * 0.02).cast("double").alias("units_returned"), gross.alias("gross_sales"), F.round(gross * (0.04 + 0.02 * uniform(w.seed + 5, "date", "region", "product_line")), 2).alias("discounts"),
        "list_price", F.lit(0.34).alias("gross_margin_pct"), F.when(F.col("product_line") == "SmartHome", F.col("units_shipped") * 49).otherwise(0.0).alias("monthly_subscription_revenue"),
        F.round(gross * 0.01 * noise(w.seed + 6, "date", "region"), 2).alias("deferred_delta"), F.ceil(F.col("units_shipped") / 1.4).cast("int").alias("shipped_orders"),
        (F.col("date").cast("timestamp") + F.expr("INTERVAL 20 HOURS") + F.when(F.col("date") > F.lit(w.end - dt.timedelta(days=3)), F.when(F.col("region") == "West", F.expr("INTERVAL 3 DAYS")).otherwise(F.expr("INTERVAL 0 DAYS"))).otherwise(F.expr("INTERVAL 0 DAYS"))).alias("ingested_at"),
    )


def refunds(spark: SparkSession, w: World = World()) -> DataFrame:
    o = orders(spark, w)
    r = F.round(F.col("gross_sales") * 0.015 * (1 + 0.3 * uniform(w.seed + 7, "date", "region", "product_line")), 2)
    return o.where(F.pmod(F.xxhash64("date", "region", "product_line"), F.lit(240)) > 0).select(F.concat(F.lit("R"), "source_row_id").alias("source_row_id"), "date", "region", "product_line", r.alias("refunds"), (r * 0.1).alias("refund_liability_inr"), "ingested_at")


def dispatch(spark: SparkSession, w: World = World(), a_day: int = 25) -> DataFrame:
    """Events with three timestamp conventions (60 / 25 / 15 %) and 4.5 % missing durations."""
    wh = spark.createDataFrame(list(w.warehouses.items()), "warehouse string, region string")
    e = days(spark, w.start, w.end).join(F.broadcast(wh), how="cross").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(a_day))))
    u = {n: uniform(w.seed + 20 + i, "date", "warehouse", "k") for i, n in enumerate(("at", "late", "form", "gone"))}
    bad = (F.col("region") == w.treated) & F.col("date").between(F.lit(w.shock_start - dt.timedelta(days=3)), F.lit(w.shock_end - dt.timedelta(days=3)))
    e = e.withColumns({**u, "ts": (F.col("date").cast("timestamp").cast("long") + F.floor(F.col("k") * 40 + 10_000)).cast("timestamp"), "bad": bad})
    local = F.date_format(F.from_utc_timestamp("ts", "Asia/Kolkata"), "yyyy-MM-dd'T'HH:mm:ss")
    raw = F.when(F.col("form") < 0.60, F.concat(local, F.lit("+05:30"))).when(F.col("form") < 0.85, local).otherwise((F.col("ts").cast("long") * 1000).cast("string"))
    hours = F.round(18 + 10 * F.col("late") - 2.0 * noise(w.seed + 30, "date", "region") + F.when(F.col("bad"), 4.0).otherwise(0.0), 2)
    return e.select(F.concat_ws("-", F.lit("E"), "date", "warehouse", "k").alias("event_id"), raw.alias("ts_raw"), "warehouse", "region", F.lit(26.0).alias("promised_hours"), F.when(F.col("gone") >= 0.045, hours).alias("actual_hours"),
                    F.lit("emp").alias("employee_id"), F.lit("s1").alias("shift_id"), F.lit(0.5).alias("staff_productivity_score"))


def tickets(spark: SparkSession, w: World = World()) -> DataFrame:
    cats = spark.createDataFrame([("LATE",), ("DAMAGED",), ("BILLING",), ("OTHER",)], "ticket_category string")
    reg = spark.createDataFrame([(r,) for r in w.regions], "region string")
    g = days(spark, w.start, w.end).join(F.broadcast(reg), how="cross").join(F.broadcast(cats), how="cross")
    hit = (F.col("region") == w.treated) & F.col("date").between(F.lit(w.shock_start), F.lit(w.shock_end))
    n = (4 + 5 * uniform(w.seed + 40, "date", "region", "ticket_category") + F.when(hit, 6).otherwise(0)).cast("int")
    future = uniform(w.seed + 41, "date", "region", "ticket_category") < 0.015
    return g.select(F.when(future, F.date_add("date", 1)).otherwise(F.col("date")).alias("date"), "region", "ticket_category", n.alias("complaint_tickets"), (n * 2).alias("total_tickets"), F.lit(200).alias("shipped_orders_hint"),
                    F.lit("a@example.com").alias("customer_email"), F.lit("text").alias("ticket_body"), (F.col("date").cast("timestamp") + F.expr("INTERVAL 12 HOURS")).alias("ingested_at"))


def marketing(spark: SparkSession, w: World = World(), absent: str = "South") -> DataFrame:
    reg = spark.createDataFrame([(r,) for r in w.regions if r != absent], "region string")
    weeks = days(spark, w.start, w.end).select(F.date_trunc("week", "date").cast("date").alias("week_start")).distinct()
    camp = spark.createDataFrame([("C1", "search"), ("C2", "social")], "campaign_id string, channel string")
    g = weeks.join(F.broadcast(reg), how="cross").join(F.broadcast(camp), how="cross")
    cut = F.when(F.col("week_start") >= F.lit(dt.date(2026, 7, 27)), 0.78).otherwise(1.0)
    spend = F.round(90_000 * cut * (0.9 + 0.2 * uniform(w.seed + 50, "week_start", "region", "campaign_id")), 2)
    return g.select("week_start", "campaign_id", "region", "channel", spend.alias("spend_inr"), (spend * 11).cast("long").alias("impressions"), F.col("week_start").cast("timestamp").alias("ingested_at"))


def external(spark: SparkSession, w: World = World(), observed: float = 0.6) -> DataFrame:
    lines = spark.createDataFrame([(p,) for p in w.lines], "product_line string")
    g = days(spark, w.start, w.end).join(F.broadcast(lines), how="cross").where(uniform(w.seed + 60, "date", "product_line") < observed)
    on = ((F.col("product_line") == w.rival_line) & F.col("date").between(F.lit(w.rival_start), F.lit(w.rival_end))).cast("int")
    return g.select("date", "product_line", on.alias("promo_active"), F.lit(1).alias("observed"), F.lit("scrape").alias("source_note"))


def price_list(spark: SparkSession, w: World = World()) -> DataFrame:
    rows = [(w.start, p, v, "") for p, v in w.lines.items()] + [(dt.date(2026, 8, 1), "Apparel", w.lines["Apparel"] * 1.03, "increase")]
    return spark.createDataFrame(rows, "effective_from date, product_line string, list_price double, discount_policy_note string")


def inject_defects(o: DataFrame, seed: int = 20260826, missing: float = 0.018, conflicts: int = 12, signs: int = 3) -> DataFrame:
    """1.8 % missing discounts, twelve conflicting later versions, three negative counts."""
    key = ("date", "region", "product_line")
    order = F.xxhash64(*key, F.lit(seed))
    # The rows of smallest hash take the counted defects: a bounded pick.
    picked = o.select(*key).orderBy(order).limit(conflicts + signs).collect()
    def among(rows: list) -> Column:
        return F.concat_ws("|", *key).isin([f"{r['date']}|{r['region']}|{r['product_line']}" for r in rows])

    out = o.withColumn("discounts", F.when(uniform(seed + 70, *key) >= missing, F.col("discounts")))
    out = out.withColumn("units_shipped", F.when(among(picked[conflicts:]), -F.col("units_shipped")).otherwise(F.col("units_shipped")))
    again = o.where(among(picked[:conflicts])).withColumns({"gross_sales": F.round(F.col("gross_sales") * 1.09, 2), "ingested_at": F.col("ingested_at") + F.expr("INTERVAL 6 HOURS"), "source_row_id": F.concat("source_row_id", F.lit("-v2"))})
    return out.unionByName(again)


def bundle(spark: SparkSession, w: World = World()) -> dict[str, DataFrame]:
    return {
        "erp_orders_daily": inject_defects(orders(spark, w), w.seed), "erp_refunds_daily": refunds(spark, w), "erp_price_list": price_list(spark, w),
        "mkt_campaign_weekly": marketing(spark, w), "ops_dispatch_events": dispatch(spark, w), "ops_support_tickets_daily": tickets(spark, w), "ext_competitor_promo": external(spark, w),
    }


def write_bundle(spark: SparkSession, folder: str, w: World = World()) -> None:
    from kpiscope.sources.files import write_csv

    for name, df in bundle(spark, w).items():
        write_csv(df, f"{folder}/{name}.csv")
