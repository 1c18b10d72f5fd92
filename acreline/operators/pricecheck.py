"""Price checks, rechecks and audits of stored records against live readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import host
from ..functions.numbers import js_round, money
from ..functions.text import status_kind
from .classify import LIMITS, missing, problems

GONE = (404, 410)


def price_check(watched: DataFrame, now: Column, tolerance: float = 5, expires: float = 90, threshold: float = LIMITS.new_lead) -> DataFrame:
    """watched with action, new_price, new_stage and dropped: exactly one action a record, first rule wins.

    watched: url, stored, current, acres, target, created, http_status. Actions: error (no url or price), skipped (no
    acres), fetch_error, removed, manual_check (nothing read, or far off), implausible_skipped, expired, unchanged, promoted,
    price_drop, increase.
    """
    stored, cur, acres, target = (F.col(c) for c in ("stored", "current", "acres", "target"))
    changed = F.abs(stored - cur) >= tolerance * acres
    dropped = changed & (cur < stored)
    over = (cur / acres - target) / target
    promotable = F.coalesce(dropped & (target > 0) & (over <= threshold), F.lit(False))
    age = (F.unix_micros(now) - F.unix_micros("created")) / 86_400_000_000
    action = (
        F.when((F.coalesce("url", F.lit("")) == "") | missing(stored), "error")
        .when(missing(acres), "skipped")
        .when(F.col("http_status").isin(*GONE), "removed")
        .when(F.col("http_status") >= 400, "fetch_error")
        .when(cur.isNull() | (cur < stored * 0.2) | (cur > stored * 5), "manual_check")
        .when(F.size(problems(cur, acres)) > 0, "implausible_skipped")
        .when(~promotable & F.coalesce(age >= expires, F.lit(False)), "expired")
        .when(~changed, "unchanged")
        .when(promotable, "promoted")
        .when(dropped, "price_drop")
        .otherwise("increase")
    )
    d = watched.withColumn("action", action)
    stage = F.when(F.col("action") == "removed", "Off Market").when(F.col("action") == "manual_check", "Manual Check").when(F.col("action") == "expired", "Not Interested").when(F.col("action") == "promoted", "Price Drop")
    return d.withColumn("new_price", F.when(F.col("action").isin("promoted", "price_drop", "increase"), cur)).withColumn("new_stage", stage).withColumn("dropped", F.col("action").isin("promoted", "price_drop"))


def price_note() -> Column:
    """What a price check writes into a record's log."""
    return F.when(F.col("dropped"), F.concat(F.lit("Price drop: "), money(F.col("stored")), F.lit(" → "), money(F.col("current")), F.lit(" (-"), money(F.col("stored") - F.col("current")), F.lit(")"))).when(F.col("action") == "increase", F.concat(F.lit("Price increase: "), money(F.col("stored")), F.lit(" → "), money(F.col("current")))).when(F.col("action") == "removed", F.lit("Listing removed (404)")).when(F.col("action") == "manual_check", F.lit("Could not read the price"))


def price_mismatch(recorded: Column, live: Column, share: float = 0.01) -> Column:
    """The recorded price is missing or more than a share off; without a live one there is none."""
    return F.when(live.isNull(), False).when(missing(recorded), True).otherwise(F.abs(recorded - live) / recorded > share)


def acreage_mismatch(recorded: Column, live: Column, floor: float = LIMITS.min_acres, share: float = 0.10) -> Column:
    """Both known and a share apart or more, or on different sides of the floor."""
    return F.when(missing(recorded) | missing(live), False).otherwise((F.abs(recorded - live) / recorded >= share) | ((recorded >= floor) != (live >= floor)))


def audit_acreage_mismatch(recorded: Column, live: Column, floor: float = LIMITS.min_acres) -> Column:
    """Like acreage_mismatch, but a missing recorded acreage is a mismatch."""
    return F.when(live.isNull(), False).when(missing(recorded), True).otherwise(acreage_mismatch(recorded, live, floor))


def site_changes(checked: DataFrame, least: int = 3, share: float = 0.5) -> DataFrame:
    """checked (url, http_status) with outcome: gone, or site_change where too many of a host's pages are gone at once."""
    gone = F.col("http_status").isin(*GONE)
    per_host = checked.groupBy(host(F.col("url")).alias("_h")).agg(F.count_if(gone).alias("_g"), F.count("*").alias("_n")).where((F.col("_g") >= least) & (F.col("_g") / F.col("_n") > share)).select("_h", F.lit(True).alias("_c"))
    d = checked.withColumn("_h", host(F.col("url"))).join(per_host, "_h", "left")
    return d.withColumn("outcome", F.when(gone & F.col("_c"), "site_change").when(gone, "removed").when(F.col("http_status") >= 400, "failed").otherwise("checked")).drop("_h", "_c")


def oldest_checked(records: DataFrame, state: DataFrame, n: int = 100) -> DataFrame:
    """The n records (id, seq) checked longest ago (state: id, checked), never checked ones first."""
    return records.join(state, "id", "left").orderBy(F.col("checked").asc_nulls_first(), "seq").limit(n)


def pruned_state(state: DataFrame, candidates: DataFrame) -> DataFrame:
    return state.join(candidates.select("id"), "id", "left_semi")


def structured_status(field: Column, value: Column) -> Column:
    """What a page's status number says about a phrase found on it."""
    said = F.concat(field, F.lit("="), value.cast("int").cast("string"))
    known = field == "marketStatus"
    return F.when(known & (value == 2), F.concat(F.lit("corroborating page data: "), said, F.lit(" (pending)"))).when(known & (value == 1), F.concat(F.lit("page data disagrees with phrase: "), said, F.lit(" (active)"))).otherwise(F.concat(F.lit("page data: "), said, F.lit(" (unmapped)")))


def audit(records: DataFrame, floor: float = LIMITS.min_acres, watch: float = LIMITS.new_lead, remove: float = LIMITS.watch) -> DataFrame:
    """records with live_price, live_acres, over_percent, verdict (OK, FIX, REMOVE, UNVERIFIED), reasons and proposed values.

    records: recorded_price, recorded_acres, recorded_county, recorded_state, county_linked, county_id, cpa_target,
    fetch_error, http_status, ld_price, page_price, body_acres, structured_acres (struct<value,source>), page_county,
    page_state, county_provenance, flags, review_flags (arrays) and market_status. Rules in order: a failed fetch; nothing
    read; grounds to remove (gone, unavailable, below the floor, county not a target by a trusted source, far over the
    target); county unresolved; corrections. A removal proposes nothing.
    """
    c = F.col
    live_price = F.coalesce("ld_price", "page_price")
    prices_disagree = F.coalesce((c("ld_price").isNotNull()) & (c("page_price") > 0) & (F.abs(c("ld_price") - c("page_price")) / c("page_price") > 0.01), F.lit(False))
    sv, ss, body = c("structured_acres.value"), c("structured_acres.source"), c("body_acres")
    acres_disagree = F.coalesce((body > 0) & (F.abs(sv - body) / body > 0.01), F.lit(False))
    live_acres = F.when(sv.isNull(), body).when(body.isNull() | (body <= 0), sv).when(acres_disagree & (ss == "page_load"), sv).otherwise(body)
    lower = lambda x: F.lower(F.trim(x))
    county_differs = c("county_linked") & F.coalesce((lower(c("page_county")) != lower(c("recorded_county"))) | (lower(c("page_state")) != lower(c("recorded_state"))), F.lit(False)) & (F.coalesce("page_county", F.lit("")) != "") & (F.coalesce("recorded_county", F.lit("")) != "")
    d = records.withColumns({"live_price": live_price, "live_acres": live_acres, "live_county": F.coalesce("page_county", "recorded_county"), "live_state": F.coalesce("page_state", "recorded_state"), "_gone": F.coalesce(c("http_status").isin(*GONE), F.lit(False)), "_differs": county_differs})
    d = d.withColumn("live_cpa", F.when(c("live_acres") > 0, c("live_price") / c("live_acres"))).withColumn("over_percent", (c("live_cpa") - c("cpa_target")) / c("cpa_target"))
    number = lambda x: F.regexp_replace(x.cast("string"), r"\.0$", "")
    recorded = lambda x, f: F.when(x.isNotNull(), f(x)).otherwise("missing")
    price_off, acres_off = price_mismatch(c("recorded_price"), c("live_price")), audit_acreage_mismatch(c("recorded_acres"), c("live_acres"), floor)
    price_said = F.when(price_off, F.concat(F.lit("price: recorded "), recorded(c("recorded_price"), money), F.lit(", live "), money(c("live_price"))))
    acres_said = F.when(acres_off, F.concat(F.lit("acres: recorded "), recorded(c("recorded_acres"), number), F.lit(", live "), number(c("live_acres"))))
    place = F.concat(c("live_county"), F.lit(", "), c("live_state"))
    no_target, known_place = c("cpa_target").isNull(), place.isNotNull()
    trusted = F.coalesce(c("county_provenance").isin("url", "record"), F.lit(False))
    notes = F.array_compact(F.concat(
        F.array(F.when(prices_disagree, F.concat(F.lit("price sources disagree: page "), money(c("page_price")), F.lit(" vs structured "), money(c("ld_price"))))),
        F.array(F.when(acres_disagree, F.concat(F.lit("acres sources disagree: "), ss, F.lit(" "), number(sv), F.lit(" ac vs page "), number(body), F.lit(" ac")))),
        F.array(F.when(c("_differs"), F.concat(F.lit("county mismatch: recorded "), c("recorded_county"), F.lit(", "), F.coalesce("recorded_state", F.lit("")), F.lit(", live "), c("page_county"), F.lit(", "), F.coalesce("page_state", "recorded_state", F.lit(""))))),
        F.transform(F.coalesce("review_flags", F.array().cast("array<string>")), lambda f: F.concat(F.lit("availability phrase outside subject listing: "), f)),
        F.array(F.when(c("market_status").isNotNull() & ((F.size(F.coalesce("flags", F.array().cast("array<string>"))) > 0) | (F.size(F.coalesce("review_flags", F.array().cast("array<string>"))) > 0)), structured_status(F.lit("marketStatus"), c("market_status")))),
    ))
    flags = F.coalesce("flags", F.array().cast("array<string>"))
    grounds = F.array_compact(F.array(
        F.when(c("_gone"), F.concat(F.lit("listing gone (HTTP "), c("http_status").cast("string"), F.lit(")"))),
        F.when(F.size(flags) > 0, F.concat(F.lit("now "), F.try_element_at(flags, F.lit(1)))),
        F.when(c("live_acres") < floor, F.concat(F.lit(f"below {floor:g}-acre floor: live "), number(c("live_acres")), F.lit(" ac"))),
        F.when(no_target & known_place & trusted, F.when(c("county_id").isNotNull(), F.concat(F.lit("county has no CPA Target in Airtable: "), place)).otherwise(F.concat(F.lit("county not a target: "), place))),
        F.when(c("over_percent") > remove, F.concat(F.lit("$/ac over threshold: "), money(c("live_cpa")), F.lit("/ac vs "), money(c("cpa_target")), F.lit("/ac target (+"), js_round(c("over_percent") * 100).cast("int").cast("string"), F.lit("%)"))),
    ))
    unresolved = no_target & ~known_place
    untrusted = F.array_compact(F.array(F.when(no_target & known_place & ~trusted, F.concat(F.lit("county (from page text) not a target: "), place))))
    link_said = F.when(~c("county_linked") & c("county_id").isNotNull(), F.concat(F.lit("county link missing; resolvable to "), place))
    watched = F.when((c("over_percent") > watch) & (c("over_percent") <= remove), F.concat(F.lit("watch zone: "), money(c("live_cpa")), F.lit("/ac is "), js_round(c("over_percent") * 100).cast("int").cast("string"), F.lit("% over "), money(c("cpa_target")), F.lit("/ac target")))
    fixes = F.array_compact(F.array(price_said, acres_said, link_said, watched))
    must_fix = price_off | acres_off | link_said.isNotNull() | c("_differs")
    failed = c("fetch_error").isNotNull() & ~c("_gone")
    nothing = ~c("_gone") & c("live_price").isNull() & c("live_acres").isNull() & (F.size(flags) == 0)
    d = d.withColumns({"_notes": notes, "_grounds": grounds, "_fixes": fixes, "_untrusted": untrusted})
    verdict = F.when(failed | nothing, "UNVERIFIED").when(F.size("_grounds") > 0, "REMOVE").when(unresolved, "UNVERIFIED").when(must_fix, "FIX").otherwise("OK")
    one = lambda t: F.array(t)
    reasons = (
        F.when(failed, F.concat(c("_notes"), one(F.concat(F.lit("fetch failed: "), c("fetch_error")))))
        .when(nothing, F.concat(c("_notes"), one(F.lit("could not extract price or acreage from the live page"))))
        .when(F.size("_grounds") > 0, F.concat("_notes", "_untrusted", "_grounds", F.array_compact(F.array(price_said, acres_said))))
        .when(unresolved, F.concat(c("_notes"), one(F.lit("county could not be determined from the page or the record"))))
        .otherwise(F.concat("_notes", "_untrusted", "_fixes"))
    )
    d = d.withColumn("verdict", verdict).withColumn("reasons", reasons)
    fix = c("verdict") == "FIX"
    return d.withColumn("proposed_price", F.when(fix & price_off, c("live_price"))).withColumn("proposed_acres", F.when(fix & acres_off, c("live_acres"))).withColumn("proposed_county_id", F.when(fix & (link_said.isNotNull() | c("_differs")), c("county_id"))).drop("_gone", "_differs", "_notes", "_grounds", "_fixes", "_untrusted")


def intake_outcome() -> Column:
    """The next status of a submitted row: rejection and duplicate are final, a first error retries, a second fails."""
    return F.when(F.col("rejection").isNotNull(), "Failed").when(F.col("duplicate_of").isNotNull(), "Duplicate").when(F.col("error").isNull(), "Added").when(F.col("status") == "Retry", "Failed").otherwise("Retry")


def price_changes(observations: DataFrame, key: str = "user_id", price: str = "price", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """observations with the price before (stored) and the key's first time (created)."""
    w = Window.partitionBy(key).orderBy(*order)
    return observations.withColumn("stored", F.lag(price).over(w)).withColumn("created", F.min(order[0]).over(Window.partitionBy(key)))


def kind_of(c: Column) -> Column:
    return status_kind(c)
