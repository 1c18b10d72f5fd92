"""Validation, plausibility and price thresholds of listings: one ordered CASE over native columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import exceeds_decimals, js_round, number_prefix
from ..functions.text import availability
from .lookup import with_target


@dataclass(frozen=True)
class Limits:
    """Bounds of prices, acreages and dollars an acre, and the thresholds over a county's target."""

    min_price: float = 1_000
    max_price: float = 100_000_000
    price_decimals: int = 2
    max_acres: float = 25_000
    acres_decimals: int = 3
    min_cpa: float = 150
    max_cpa: float = 50_000
    min_acres: float = 40
    new_lead: float = 0.20
    watch: float = 0.30
    max_discrepancy: float = 50


LIMITS = Limits()


def hard_problems(price: Column, acres: Column, lim: Limits = LIMITS) -> Column:
    """All impossible single values; missing ones are no problem."""
    return F.array_compact(F.array(
        F.when((price < lim.min_price) | (price > lim.max_price), "price out of range"),
        F.when(exceeds_decimals(price, lim.price_decimals), "price decimals"),
        F.when(~(acres > 0) | (acres > lim.max_acres), "acres out of range"),
        F.when(exceeds_decimals(acres, lim.acres_decimals), "acres decimals"),
        F.when(price == acres, "price equals acres"),
    ))


def per_acre_problems(price: Column, acres: Column, lim: Limits = LIMITS) -> Column:
    """Whether dollars an acre are out of range; nothing to say if a part is missing or acres are not above 0."""
    return F.array_compact(F.array(F.when((acres > 0) & ~(price / acres).between(lim.min_cpa, lim.max_cpa), "price per acre out of range")))


def problems(price: Column, acres: Column, lim: Limits = LIMITS) -> Column:
    return F.concat(hard_problems(price, acres, lim), per_acre_problems(price, acres, lim))


def missing(c: Column) -> Column:
    """Null, empty, zero and below count as missing."""
    return c.isNull() | (c <= 0)


def validation_errors() -> Column:
    text = lambda c, what: F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(what))
    return F.array_compact(F.array(F.when(missing(F.col("price")), "Missing or invalid price"), F.when(missing(F.col("acres")), "Missing or invalid acreage"), text("county", "Missing county"), text("state", "Missing state"), text("url", "Missing listing URL")))


def classify(listings: DataFrame, counties: DataFrame, lim: Limits = LIMITS) -> DataFrame:
    """listings with the outcome of the first check that fails, or of the thresholds.

    Adds cpa_target, computed_cpa, over_percent, verdict, passed, stage and validation_errors. Checks in order: required
    fields, impossible values, acreage floor, county with a target, dollars an acre, thresholds (all bounds inclusive).
    listings need price, acres, county, state and url; a column price_per_acre adds a warning where it is far off.
    """
    price, acres, target = F.col("price"), F.col("acres"), F.col("cpa_target")
    d = with_target(listings, counties).withColumn("validation_errors", validation_errors())
    cpa = price / acres
    over = (cpa - target) / target
    verdict = (
        F.when(F.size("validation_errors") > 0, "invalid")
        .when(F.size(hard_problems(price, acres, lim)) > 0, "implausible")
        .when(acres < lim.min_acres, "below_min_acres")
        .when(target.isNull(), "not_target")
        .when(F.size(per_acre_problems(price, acres, lim)) > 0, "implausible_cpa")
        .when(cpa <= target, "at_below")
        .when(over <= lim.new_lead, "within")
        .when(over <= lim.watch, "watch")
        .otherwise("over")
    )
    d = d.withColumn("verdict", verdict).withColumn("passed", F.col("verdict").isin("at_below", "within", "watch"))
    reached = F.col("passed") | (F.col("verdict") == "over")
    d = d.withColumn("stage", F.when(F.col("verdict").isin("at_below", "within"), "New Lead").when(F.col("verdict") == "watch", "Watch For Price Drop"))
    d = d.withColumn("computed_cpa", F.when(reached, js_round(cpa, 2))).withColumn("over_percent", F.when(reached, over))
    if "price_per_acre" in listings.columns:
        off = reached & (F.abs(cpa - F.col("price_per_acre")) > lim.max_discrepancy)
        d = d.withColumn("validation_errors", F.when(off, F.array_append("validation_errors", F.lit("price per acre discrepancy"))).otherwise(F.col("validation_errors")))
    return d


def reason(lim: Limits = LIMITS) -> Column:
    """What classify decided, in words."""
    num = lambda c: F.regexp_replace(F.col(c).cast("string"), r"\.0$", "")
    percent = js_round(F.col("over_percent") * 100).cast("int").cast("string")
    per = F.concat(F.lit("$"), js_round(F.col("price") / F.col("acres")).cast("bigint").cast("string"), F.lit("/ac"))
    said = {
        "invalid": F.concat(F.lit("Data validation failed: "), F.array_join("validation_errors", "; ")),
        "implausible": F.concat(F.lit("Implausible data: "), F.array_join(hard_problems(F.col("price"), F.col("acres"), lim), "; ")),
        "implausible_cpa": F.concat(F.lit("Implausible data: "), per, F.lit(" is out of range")),
        "below_min_acres": F.concat(F.lit("Below minimum acreage: "), num("acres"), F.lit(f"ac < {lim.min_acres:g}ac")),
        "not_target": F.concat(F.lit("County not in target list: "), "county", F.lit(", "), "state"),
        "at_below": F.concat(F.lit("At/below target: "), per, F.lit(" vs $"), num("cpa_target"), F.lit("/ac target ("), percent, F.lit("%)")),
        "within": F.concat(F.lit("Within threshold: "), per, F.lit(" is "), percent, F.lit("% over $"), num("cpa_target"), F.lit("/ac target")),
        "watch": F.concat(F.lit("Watch zone: "), per, F.lit(" is "), percent, F.lit("% over $"), num("cpa_target"), F.lit("/ac target")),
        "over": F.concat(F.lit("Over threshold: "), per, F.lit(" is "), percent, F.lit("% over $"), num("cpa_target"), F.lit("/ac target")),
    }
    out = F.lit(None).cast("string")
    for k, v in said.items():
        out = F.when(F.col("verdict") == k, v).otherwise(out)
    return out


def final_guard(survivors: DataFrame, min_acres: float = LIMITS.min_acres) -> DataFrame:
    """survivors with outcome: skipped if name or description say unavailable, rejected below the floor, else kept."""
    text = F.concat_ws(" ", "name", "description")
    return survivors.withColumn("outcome", F.when(F.size(availability(text)) > 0, "skipped").when(F.col("acres") < min_acres, "rejected").otherwise("kept"))


def intake_rejection(price: Column, acres: Column, flags: Column, min_acres: float = LIMITS.min_acres, lim: Limits = LIMITS) -> Column:
    """Why a submitted listing is refused, null if it is not; a missing acreage passes the floor."""
    hard, per = hard_problems(price, acres, lim), per_acre_problems(price, acres, lim)
    return F.coalesce(
        F.when(F.size(flags) > 0, F.concat(F.lit("listing is "), F.try_element_at(flags, F.lit(1)))),
        F.when(F.size(hard) > 0, F.concat(F.lit("Implausible data: "), F.array_join(hard, "; "))),
        F.when(acres < min_acres, F.lit("below the minimum acreage")),
        F.when(F.size(per) > 0, F.concat(F.lit("Implausible data: "), F.array_join(per, "; "))),
    )


def write_guard(price: Column, acres: Column, county_id: Column | None = None) -> Column:
    """Why a row must not be written, null if it may: implausible values, then a county that has no row."""
    found = problems(price, acres)
    refusal = F.when(F.size(found) > 0, F.concat(F.lit("implausible: "), F.array_join(found, "; ")))
    return refusal if county_id is None else F.coalesce(refusal, F.when(county_id.isNull(), F.lit("county link unresolvable")))


def lacks_critical_field() -> Column:
    """Any of price, acres, county and state missing; zero and empty count."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    number = lambda c: F.coalesce(F.col(c), F.lit(0)) == 0
    return number("price") | number("acres") | text("county") | text("state")


def filled(listings: DataFrame, details: DataFrame, key: str = "url", only_missing: bool = True) -> DataFrame:
    """listings with price, acres, county and state from their detail page where they lack them; nothing is overwritten.

    Listings that lack nothing are not joined at all unless only_missing is off.
    """
    fields = ["price", "acres", "county", "state"]
    d = details.select(key, *[F.col(c).alias(f"_d_{c}") for c in fields])
    rows = listings.withColumn("_k", F.when(lacks_critical_field(), F.col(key))) if only_missing else listings.withColumn("_k", F.col(key))
    out = rows.join(d.withColumnRenamed(key, "_k"), "_k", "left").drop("_k")
    empty = {"price": F.nullif(F.col("price"), F.lit(0.0)), "acres": F.nullif(F.col("acres"), F.lit(0.0)), "county": F.nullif(F.col("county"), F.lit("")), "state": F.nullif(F.col("state"), F.lit(""))}
    return out.withColumns({c: F.coalesce(empty[c], F.col(f"_d_{c}")) for c in fields}).drop(*[f"_d_{c}" for c in fields]).select(*listings.columns)


def floor_of(setting: Column, default: float = LIMITS.min_acres) -> Column:
    """An acreage floor from a setting's text: a number of 0 or more, else the default."""
    n = number_prefix(setting)
    return F.when(n >= 0, n).otherwise(F.lit(float(default)))


def url_floor(n: Column) -> Column:
    """A floor as whole acres in a URL; 40 unless above 0."""
    return F.when(n > 0, F.floor(n)).otherwise(F.lit(40)).cast("bigint")
