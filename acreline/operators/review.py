"""Scores and classes of leads from text and numbers, and the lists a reader gets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.numbers import js_round
from ..functions.pages import high_risk_zone
from .classify import problems

# Sizes and days of a review.
PREFERRED, SMALL, LARGE, NEGOTIABLE_DAYS = 150, 100, 400, 180


def flood_of(notes: Column, looked_up: Column) -> Column:
    """The flood zone that the notes hold from an earlier review, else the one looked up."""
    return F.coalesce(F.nullif(F.regexp_extract(notes, "FEMA Flood: Zone ([A-Z0-9]+)", 1), F.lit("")), looked_up)


def review(leads: DataFrame) -> DataFrame:
    """leads with dealbreakers, yellow_flags, positives, availability_flags, over_percent, score, price_class, size_class, dom_opportunity and implausible.

    leads: name, notes, human_note, price, acres, cpa, target, days_on_market, zone. The notes below the analysis marker are
    not read. Unknown dollars an acre or target give no price score.
    """
    c = F.col
    text = F.concat_ws(" ", F.coalesce("name", F.lit("")), F.substring_index(F.coalesce("notes", F.lit("")), T.MARKER, 1), F.coalesce("human_note", F.lit("")))
    d = leads.withColumn("_text", text).withColumn("over_percent", F.when((c("target") > 0) & (c("cpa") > 0), (c("cpa") - c("target")) / c("target")))
    flood = F.when(high_risk_zone(c("zone")), F.array(F.concat(F.lit("fema flood zone "), F.lower("zone"), F.lit(" (high risk)")))).otherwise(F.array().cast("array<string>"))
    d = d.withColumns({"dealbreakers": T.present(c("_text"), T.DEALBREAKERS), "yellow_flags": F.concat(T.present(c("_text"), T.YELLOW_FLAGS), flood), "positives": T.present(c("_text"), T.POSITIVES), "availability_flags": F.transform(T.availability(c("_text")), lambda k: F.concat(F.lit("listed as "), k))})
    over, acres = c("over_percent"), F.coalesce("acres", F.lit(0.0))
    by_price = F.when(over <= -0.10, 2.0).when(over <= 0, 1.5).when(over <= 0.10, 1.0).when(over <= 0.20, 0.5).otherwise(0.0)
    by_size = F.when(acres >= PREFERRED, 1.0).when(acres >= SMALL, 0.5).otherwise(0.0)
    by_words = F.when(F.size("positives") >= 3, 1.0).when(F.size("positives") >= 1, 0.5).otherwise(0.0)
    score = F.greatest(F.lit(0.0), F.least(F.lit(5.0), by_price + by_size + by_words - F.size("yellow_flags") * 0.25))
    price_class = F.when(over.isNull(), "unknown").when(over <= -0.10, "excellent").when(over <= 0, "good").when(over <= 0.10, "acceptable").when(over <= 0.20, "needs_negotiation").otherwise("over_threshold")
    size_class = F.when(acres < SMALL, "small").when((acres >= PREFERRED) & (acres <= LARGE), "preferred").when(acres > LARGE, "large").otherwise("acceptable")
    return d.withColumns({"score": score, "price_class": price_class, "size_class": size_class, "dom_opportunity": F.coalesce((F.coalesce("days_on_market", F.lit(0)) >= NEGOTIABLE_DAYS) & (over > 0), F.lit(False)), "implausible": F.size(problems(c("price"), c("acres"))) > 0}).drop("_text")


def analysis_text() -> Column:
    """A review as text: the score in stars, then a section for each list that is not empty."""
    section = lambda title, column, mark: F.when(F.size(column) > 0, F.concat(F.lit(f"\n{title}:\n"), F.array_join(F.transform(column, lambda x: F.concat(F.lit(f"  {mark} "), x)), "\n")))
    return F.concat_ws("\n", F.concat(F.lit("Score: "), T.stars(F.col("score")), F.lit(" ("), F.format_number("score", 1), F.lit("/5)")), F.concat(F.lit("Price: "), "price_class"), F.concat(F.lit("Size: "), "size_class"), section("AVAILABILITY", "availability_flags", "-"), section("DEALBREAKERS", "dealbreakers", "-"), section("Yellow Flags", "yellow_flags", "-"), section("Positives", "positives", "+"))


def flagged_by_name(reviewed: DataFrame) -> DataFrame:
    """(name, flags): all dealbreakers and availability flags of the leads of a name, each once, in order."""
    d = reviewed.select("name", F.explode(F.concat("dealbreakers", "availability_flags")).alias("flag")).distinct()
    return d.groupBy("name").agg(F.array_sort(F.collect_list("flag")).alias("flags"))


def standouts(reviewed: DataFrame, least: float = 3.0) -> DataFrame:
    """Leads of a high score without dealbreakers, availability flags or impossible values."""
    return reviewed.where((F.col("score") >= least) & (F.size("dealbreakers") == 0) & (F.size("availability_flags") == 0) & ~F.col("implausible"))


def awaiting(records: DataFrame, now: Column, order: list[Column]) -> DataFrame:
    """The records waiting for a decision, each id once, with their age in whole days."""
    w = Window.partitionBy("id").orderBy(*order)
    first = records.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    return first.withColumn("age_days", F.floor((F.unix_micros(now) - F.unix_micros("created")) / 86_400_000_000))


def oldest(waiting: DataFrame, n: int = 15) -> DataFrame:
    return waiting.orderBy(F.col("age_days").desc_nulls_last(), "id").limit(n)


def rounded_stars(score: Column) -> Column:
    return js_round(score).cast("int")
