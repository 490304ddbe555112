"""Decisions over the three forecast tables. Any of the three may lack a site.

Forecasts have at most 3, 24 and 12 rows per site, so every join and aggregate here is keyed by site with small groups:
one exchange per forecast, and everything after it stays where it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridwise.functions.scalars import LABEL_FORMAT, am_pm, hh_label, round_stable, time_of_label
from gridwise.operators.tariff import HORIZON, tariff_stats
from gridwise.schemas import SITE

NEXT_HOURS = 3
NEXT_HOUR = "next_hour"


def label(ts: Column | str = "ts") -> Column:
    return F.date_format(ts, LABEL_FORMAT)


def first_extreme(value: Column, step: Column, pick: list[str], highest: bool) -> Column:
    """Struct of the row with the first highest or lowest value."""
    rest = F.struct(*pick)
    if highest:
        return F.max_by(rest, F.struct(value, -step))
    return F.min_by(rest, F.struct(value, step))


def site_inputs(solar: DataFrame, consumption: DataFrame, tariff: DataFrame) -> DataFrame:
    """One row per site with what the decisions need from each forecast; a missing forecast leaves nulls.

    Full outer joins of three one-row-per-site aggregates, with `has_*` flags and their count.
    """
    tar = tariff_stats(tariff, prices=_by_step(F.col("step"), F.col("tariff"))).withColumn("has_tariff", F.lit(1))
    joined = solar_inputs(solar).join(energy_inputs(consumption), SITE, "full").join(tar, SITE, "full")
    flags = {c: F.coalesce(c, F.lit(0)) for c in ("has_solar", "has_energy", "has_tariff")}
    joined = joined.withColumns(flags)
    return joined.withColumn("inputs_ready", F.col("has_solar") + F.col("has_energy") + F.col("has_tariff"))


def solar_inputs(solar: DataFrame) -> DataFrame:
    """What the decisions need from the solar forecast; `makes` has all its steps."""
    first = F.col("step") == 1
    return solar.groupBy(SITE).agg(
        F.max(F.when(first, F.col("energy_kwh"))).alias("solar_1h"),
        F.max(F.when(first, label())).alias("solar_label"),
        round_stable(F.sum("energy_kwh"), 4).alias("solar_total"),
        first_extreme(F.col("energy_kwh"), F.col("step"), ["ts", "energy_kwh"], True).alias("best_solar"),
        _by_step(F.col("step"), F.col("ts"), F.col("energy_kwh")).alias("makes"),
        F.lit(1).alias("has_solar"),
    )


def energy_inputs(consumption: DataFrame) -> DataFrame:
    """What the decisions need from the consumption forecast; `uses` has its steps up to the tariff's horizon."""
    first = F.col("step") == 1
    return consumption.groupBy(SITE).agg(
        F.max(F.when(first, F.col("kwh"))).alias("energy_1h"),
        F.max(F.when(first, label())).alias("energy_label"),
        first_k_sum(NEXT_HOURS).alias("consumption_3h"),
        _by_step(F.col("step"), F.col("ts"), F.col("kwh"), where=F.col("step") <= HORIZON).alias("uses"),
        F.lit(1).alias("has_energy"),
    )


def _by_step(*columns: Column, where: Column | None = None) -> Column:
    """The rows of a site as an array of structs in step order; a forecast has at most 24."""
    row = F.struct(*columns)
    return F.sort_array(F.collect_list(row if where is None else F.when(where, row)))


def first_k_sum(k: int) -> Column:
    return F.sum(F.when(F.col("step") <= k, F.col("kwh")))


def join_next_hour(solar: DataFrame, consumption: DataFrame, by: str = "step") -> DataFrame:
    """Next solar hour with next consumption hour: by position (default) or, with `by="ts"`, by time."""
    sol = solar.select(SITE, "step", "ts", F.col("energy_kwh").alias("solar_kwh"))
    con = consumption.select(SITE, "step", "ts", "kwh")
    if by == "step":
        return sol.join(con.drop("ts"), [SITE, "step"]).where("step = 1")
    return sol.where("step = 1").join(con.drop("step"), [SITE, "ts"])


def surplus_deficit(inputs: DataFrame) -> DataFrame:
    """Next-hour balance with what to do: sell at the peak price, or the cost of importing.

    An exact balance counts as a deficit of 0. Sites without solar or consumption have no state.
    """
    net = F.col("solar_1h") - F.col("energy_1h")
    surplus = F.when(net > 0, net)
    deficit = F.when(net <= 0, F.abs(net))
    return inputs.withColumns({
        "state": F.when(net > 0, "surplus").when(net <= 0, "deficit"),
        "surplus_kwh": surplus,
        "deficit_kwh": deficit,
        "sell_hour": F.when(net > 0, am_pm("peak_hour")),
        "sell_revenue": sell_revenue(surplus, F.col("max_tariff")),
        "import_cost": import_cost(deficit, F.col("next_tariff")),
        "cheap_hour_label": F.when(net <= 0, am_pm("cheap_hour")),
    })


def sell_revenue(surplus: Column, peak_tariff: Column) -> Column:
    return surplus * peak_tariff


def import_cost(deficit: Column, next_tariff: Column) -> Column:
    return deficit * next_tariff


def next_hour_decision(solar: DataFrame, consumption: DataFrame, tariff: DataFrame) -> DataFrame:
    return surplus_deficit(site_inputs(solar, consumption, tariff))


def balance_3h(inputs: DataFrame, keep: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """Solar total against the first three consumption hours; a missing side is 0, an exact balance is a surplus."""
    generated = F.coalesce("solar_total", F.lit(0.0))
    used = F.coalesce("consumption_3h", F.lit(0.0))
    return inputs.where("has_solar + has_energy > 0").select(
        SITE,
        generated.alias("generated_kwh"),
        used.alias("used_kwh"),
        (generated - used).alias("net_kwh"),
        F.when(generated - used >= 0, "Surplus").otherwise("Deficit").alias("state"),
        *keep,
    )


def balance_hours(inputs: DataFrame) -> DataFrame:
    """`balance_full_outer` for sites held in one row with `makes` and `uses`; without both, one row of nulls."""
    uses = F.filter("uses", lambda u: u["step"] <= NEXT_HOURS)
    number = lambda xs: F.transform(xs, lambda x: x["step"])
    both = (F.size("makes") > 0) & (F.size(uses) > 0)
    steps = F.when(both, F.array_distinct(F.concat(number(F.col("makes")), number(uses))))
    each = inputs.withColumn("step", F.explode_outer(steps))
    at = lambda name: F.get(F.filter(name, lambda x: x["step"] == F.col("step")), 0)
    made, used, known = at("makes"), at("uses"), F.col("step").isNotNull()
    return each.withColumns({
        "label": label(F.coalesce(used["ts"], made["ts"])),
        "solar_kwh": F.when(known, F.coalesce(made["energy_kwh"], F.lit(0.0))),
        "use_kwh": F.when(known, F.coalesce(used["kwh"], F.lit(0.0))),
    })


def balance_full_outer(solar: DataFrame, consumption: DataFrame) -> DataFrame:
    """Hour by hour: solar steps against the first three consumption steps, the shorter side padded with 0.

    For sites with both forecasts. The time comes from consumption, else from solar.
    """
    sol = solar.select(SITE, "step", F.col("ts").alias("solar_ts"), "energy_kwh")
    con = consumption.where(F.col("step") <= NEXT_HOURS).select(SITE, "step", F.col("ts").alias("use_ts"), "kwh")
    w = Window.partitionBy(SITE)
    joined = (
        sol.join(con, [SITE, "step"], "full")
        .withColumns({"solar_steps": F.count("energy_kwh").over(w), "use_steps": F.count("kwh").over(w)})
        .where("solar_steps > 0 AND use_steps > 0")
    )
    return joined.select(
        SITE,
        "step",
        label(F.coalesce("use_ts", "solar_ts")).alias("label"),
        F.coalesce("energy_kwh", F.lit(0.0)).alias("solar_kwh"),
        F.coalesce("kwh", F.lit(0.0)).alias("use_kwh"),
    )


def timeline_outer(solar: DataFrame, consumption: DataFrame) -> DataFrame:
    """Solar and consumption on one label axis."""
    sol = solar.select(SITE, label().alias("label"), F.col("step").alias("solar_step"), "energy_kwh")
    con = consumption.select(SITE, label().alias("label"), F.col("step").alias("use_step"), "kwh")
    return sol.join(con, [SITE, "label"], "full")


def timeline_tariff_match(axis: DataFrame, tariff: DataFrame) -> DataFrame:
    """Put each price at the first label of its hour (solar labels before consumption labels, then step order).

    A price without such a label gets a row of its own under `Hhh:00`.
    """
    rank = F.struct(F.col("solar_step").isNull(), F.coalesce("solar_step", "use_step"))
    prices = tariff.select(SITE, hh_label("hour").alias("clock"), "tariff")
    w = Window.partitionBy(SITE, "clock").orderBy(rank)
    first = F.row_number().over(w) == 1
    marked = axis.withColumn("clock", time_of_label("label")).withColumn("takes_price", first)
    # A full join on (site, clock) with the flag inside the key: other labels of the hour find no partner.
    joined = marked.join(prices.withColumn("takes_price", F.lit(True)), [SITE, "clock", "takes_price"], "full")
    return joined.select(
        SITE,
        F.coalesce("label", F.concat(F.lit("H"), "clock")).alias("label"),
        "energy_kwh",
        "kwh",
        "tariff",
    )


def timeline(solar: DataFrame, consumption: DataFrame, tariff: DataFrame) -> DataFrame:
    """The three series on one label axis for sites with at least two forecasts; missing values are 0."""
    axis = timeline_tariff_match(timeline_outer(solar, consumption), tariff)
    w = Window.partitionBy(SITE)
    ready = sum(
        F.when(F.count(c).over(w) > 0, 1).otherwise(0) for c in ("energy_kwh", "kwh", "tariff")
    )
    return (
        axis.withColumn("inputs_ready", ready).where("inputs_ready >= 2")
        .select(
            SITE,
            "label",
            F.coalesce("energy_kwh", F.lit(0.0)).alias("solar_kwh"),
            F.coalesce("kwh", F.lit(0.0)).alias("use_kwh"),
            F.coalesce("tariff", F.lit(0.0)).alias("tariff"),
        )
    )


def timeline_sort(timeline: DataFrame) -> DataFrame:
    """By label text, so the `Hhh:00` rows come after the dated ones."""
    return timeline.orderBy(SITE, "label")


def join_cost_by_step(consumption: DataFrame, tariff: DataFrame) -> DataFrame:
    """Cost of each of the first 12 hours: consumption times price at the same step."""
    con = consumption.where(F.col("step") <= HORIZON)
    joined = con.join(tariff.select(SITE, "step", "tariff"), [SITE, "step"])
    return joined.withColumn("cost", F.col("kwh") * F.col("tariff"))


def lowest_cost_hour(consumption: DataFrame, tariff: DataFrame) -> DataFrame:
    cheapest = first_extreme(F.col("cost"), F.col("step"), ["step", "ts", "cost"], False)
    costs = join_cost_by_step(consumption, tariff).groupBy(SITE).agg(cheapest.alias("low"))
    return costs.select(SITE, F.col("low.step").alias("step"), label("low.ts").alias("label"), F.col("low.cost").alias("cost"))


def lowest_cost_of_arrays(uses: Column, prices: Column) -> Column:
    """`lowest_cost_hour` for a site held in one row: struct (cost, step, ts) of the first cheapest step."""
    def cost(use: Column) -> Column:
        price = F.get(F.filter(prices, lambda p: p["step"] == use["step"]), 0)
        return F.struct((use["kwh"] * price["tariff"]).alias("cost"), use["step"].alias("step"), use["ts"].alias("ts"))

    costs = F.transform(uses, cost)
    return F.array_min(F.filter(costs, lambda c: c["cost"].isNotNull()))


# Title, text format and class of each recommendation.
TEXTS = {
    "sell": (
        "💹 Sell Extra Solar Energy — Primary Decision",
        "Next hour (%s): solar generates %.4f kWh but you only need %.4f kWh. Surplus: %.4f kWh. Tariff model says "
        "price peaks at %s (₹%.2f/kWh). Export at that hour → estimated revenue ₹%.2f.",
        "recommendation",
    ),
    "export": (
        "🔋 Export Opportunity",
        "Next hour solar surplus: %.4f kWh. Run the Tariff tab to find the best sell hour.",
        "recommendation",
    ),
    "import": (
        "⚠️ Grid Import Required",
        "Next hour deficit: %.4f kWh. Solar cannot cover demand — defer non-critical loads.",
        "warning",
    ),
    "peak_solar": (
        "☀️ Peak Solar Window (3h)",
        "Best solar output at %s — %.4f kWh. Run high-power appliances then.",
        "recommendation",
    ),
    "cheap_tariff": (
        "🟢 Cheapest Tariff — Buy / Import Window",
        "Lowest tariff at %s (₹%.2f/kWh). Ideal for EV charging, water heaters, washing machines.",
        "recommendation",
    ),
    "peak_tariff": (
        "🔴 Peak Tariff — Best Sell / Avoid Buying",
        "Highest tariff at %s (₹%.2f/kWh). Sell excess solar here for maximum revenue; defer grid-powered loads.",
        "warning",
    ),
    "low_cost": (
        "💰 Lowest Cost Hour",
        "Minimum electricity cost at %s — ₹%.2f for that hour. Ideal for heavy loads.",
        "recommendation",
    ),
}


def recommendations(solar: DataFrame, consumption: DataFrame, tariff: DataFrame) -> DataFrame:
    """Up to five rows per site from four independent rules, in `priority` order.

    All rules read one row per site, so each forecast is computed once and the rules are an exploded array.
    """
    inputs = next_hour_decision(solar, consumption, tariff)
    rows = inputs.withColumn("low", lowest_cost_of_arrays(F.col("uses"), F.col("prices")))
    has_tariff = F.col("has_tariff") == 1
    surplus = F.col("state") == "surplus"
    rules = [
        (1, "sell", surplus & has_tariff,
         ["solar_label", "solar_1h", "energy_1h", "surplus_kwh", "sell_hour", "max_tariff", "sell_revenue"]),
        (1, "export", surplus & ~has_tariff, ["surplus_kwh"]),
        (1, "import", F.col("state") == "deficit", ["deficit_kwh"]),
        (2, "peak_solar", F.col("has_solar") == 1, [label("best_solar.ts"), "best_solar.energy_kwh"]),
        (3, "cheap_tariff", has_tariff, [hh_label("cheap_hour"), "min_tariff"]),
        (4, "peak_tariff", has_tariff, [hh_label("peak_hour"), "max_tariff"]),
        (5, "low_cost", F.col("low").isNotNull(), [label("low.ts"), "low.cost"]),
    ]
    records = []
    for priority, key, applies, values in rules:
        title, text, box = TEXTS[key]
        record = F.struct(
            F.lit(priority).alias("priority"),
            F.lit(title).alias("title"),
            F.format_string(text, *values).alias("body"),
            F.lit(box).alias("box"),
        )
        records.append(F.when(applies, record))
    return (
        rows.select(SITE, F.explode(F.array_compact(F.array(*records))).alias("r")).select(SITE, "r.*")
    )


def best_solar_hour(solar: DataFrame) -> DataFrame:
    best = first_extreme(F.col("energy_kwh"), F.col("step"), ["step", "ts", "energy_kwh"], True)
    return solar.groupBy(SITE).agg(best.alias("best")).select(
        SITE, F.col("best.step").alias("step"), label("best.ts").alias("label"), F.col("best.energy_kwh").alias("energy_kwh")
    )


def price_windows(tariff: DataFrame) -> DataFrame:
    return tariff_stats(tariff).select(
        SITE,
        hh_label("cheap_hour").alias("cheapest_hour"),
        "min_tariff",
        hh_label("peak_hour").alias("dearest_hour"),
        "max_tariff",
    )


def solar_chart(solar: DataFrame) -> DataFrame:
    return solar.select(SITE, time_of_label(label()).alias("hour"), "ghi_wm2", "energy_kwh")


def consumption_chart(consumption: DataFrame) -> DataFrame:
    return consumption.select(SITE, label().alias("hour"), "kwh")


def tariff_chart(tariff: DataFrame) -> DataFrame:
    return tariff.select(SITE, am_pm("hour").alias("time"), round_stable("tariff", 4).alias("tariff"))


def next_hour_chart(next_hour: DataFrame) -> DataFrame:
    """From `join_next_hour` rows: solar and consumption as two bars per site."""
    return next_hour.unpivot(SITE, ["solar_kwh", "use_kwh"], "source", "kwh")


def chart_tables(solar: DataFrame, consumption: DataFrame, tariff: DataFrame) -> DataFrame:
    """All charts in one long table (site_id, chart, label, y). Each forecast is computed once.

    The two bars of the next hour are marked among the rows of their forecasts and stay where a site has both.
    """
    first = F.col("step") == 1

    def points(forecast: DataFrame, *charts: tuple[str, Column, Column, Column | None]) -> DataFrame:
        rows = [
            (lambda p: p if where is None else F.when(where, p))(F.struct(F.lit(chart).alias("chart"), at.alias("label"), y.alias("y")))
            for chart, at, y, where in charts
        ]
        return forecast.select(SITE, F.explode(F.array_compact(F.array(*rows))).alias("p")).select(SITE, "p.*")

    hour = time_of_label(label())
    parts = [
        points(
            solar, ("ghi_wm2", hour, F.col("ghi_wm2"), None), ("energy_kwh", hour, F.col("energy_kwh"), None),
            (NEXT_HOUR, F.lit("solar_kwh"), F.col("energy_kwh"), first),
        ),
        points(consumption, ("consumption", label(), F.col("kwh"), None), (NEXT_HOUR, F.lit("use_kwh"), F.col("kwh"), first)),
        points(tariff, ("tariff", am_pm("hour"), round_stable("tariff", 4), None)),
    ]
    bar = F.col("chart") == NEXT_HOUR
    # A site has at most 3, 24 and 12 steps.
    sources = F.collect_set(F.when(bar, F.col("label"))).over(Window.partitionBy(SITE))
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("sources", F.size(sources))
    return rows.where(~bar | (F.col("sources") == 2)).drop("sources")
