"""Counters, rankings and diagnoses of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fraction

# Kinds of failures in the order that breaks ties, refusals' statuses, and the share that makes a cause.
CATEGORIES = ["not_found", "bot_wall", "drift", "server_error", "other_error"]
REFUSALS = (400, 403, 429, 503)
DOMINANT = 0.6


def totals(rows: DataFrame, by: str, **counts: Column) -> DataFrame:
    """A row for each value of by and one (null) for all, with the named conditions counted."""
    return rows.rollup(by).agg(F.count("*").alias("checked"), *[F.count_if(c).alias(k) for k, c in counts.items()])


def refusals(refused: DataFrame) -> DataFrame:
    """(site, kind, n): refused writes by the beginning of their reason."""
    kind = F.when(F.col("reason").startswith("implausible"), "implausible").when(F.col("reason").startswith("county link"), "county_link").otherwise("other")
    return refused.groupBy("site", kind.alias("kind")).agg(F.count("*").alias("n"))


def refusal_status(status: Column) -> Column:
    return F.coalesce(status.isin(*REFUSALS), F.lit(False))


def retryable(status: Column) -> Column:
    """No answer, too many requests, or the server's fault."""
    return status.isNull() | (status == 429) | (status >= 500)


def ambiguous(status: Column) -> Column:
    """A failure that may have written all the same."""
    return status.isNull() | (status == 408) | (status >= 500)


def issue_category(kind: Column, error: Column) -> Column:
    status = F.nullif(F.regexp_extract(error, r"HTTP (\d{3})", 1), F.lit("")).cast("int")
    network = error.rlike("(?i)timeout|timed out|ETIMEDOUT|ECONNRESET|ECONNREFUSED|network")
    return (
        F.when(kind == "blocked", "bot_wall").when(kind == "markup_drift", "drift").when(kind != "fetch_or_parse_error", "other_error")
        .when(status == 404, "not_found").when(status.isin(*REFUSALS), "bot_wall").when((status >= 500) | network, "server_error").otherwise("other_error")
    )


def tally(issues: DataFrame, site: str = "site") -> DataFrame:
    """(site, one column a category): issues (type, error) counted."""
    d = issues.withColumn("_c", issue_category(F.col("type"), F.coalesce("error", F.lit(""))))
    return d.groupBy(site).agg(*[F.count_if(F.col("_c") == c).alias(c) for c in CATEGORIES])


def with_dominant(counts: DataFrame) -> DataFrame:
    """counts with issues, dominant (the largest category, ties by the fixed order) and ratio."""
    total = sum((F.col(c) for c in CATEGORIES[1:]), F.col(CATEGORIES[0]))
    best = F.greatest(*[F.struct(F.col(c).alias("n"), F.lit(-i).alias("o"), F.lit(c).alias("c")) for i, c in enumerate(CATEGORIES)])
    d = counts.withColumn("issues", total).withColumn("_b", best)
    return d.withColumn("dominant", F.when(F.col("issues") > 0, F.col("_b.c"))).withColumn("ratio", F.when(F.col("issues") > 0, F.col("_b.n") / F.col("issues"))).drop("_b")


def diagnose(sites: DataFrame) -> DataFrame:
    """sites with diagnosis: the cause that a site's issues show, null if none does.

    sites: dominant, ratio, drift, issues, parsed, planned and status. Sites that crashed or were not asked have none.
    """
    big = lambda c: (F.col("dominant") == c) & (F.col("ratio") >= DOMINANT)
    cause = F.when(F.col("status") == "error", None).when((F.col("planned") == 0) & (F.col("issues") == 0), None).when(big("not_found"), "not_found").when(big("bot_wall"), "bot_wall").when(F.col("drift") > 0, "drift").when(big("server_error"), "server_error").when(F.coalesce("parsed", F.lit(0)) == 0, "nothing_parsed")
    return sites.withColumn("diagnosis", cause)


def diagnosis_text(requests: Column) -> Column:
    """A diagnosis in words; requests: all requests of the site."""
    of = lambda c, unit: fraction(F.col(c), requests, unit)
    return F.when(F.col("diagnosis") == "not_found", F.concat(of("not_found", "request"), F.lit(" returned HTTP 404"))).when(F.col("diagnosis") == "bot_wall", F.concat(of("bot_wall", "request"), F.lit(" blocked"))).when(F.col("diagnosis") == "drift", F.concat(of("drift", "page"), F.lit(" without listings"))).when(F.col("diagnosis") == "server_error", F.concat(of("server_error", "request"), F.lit(" timed out or errored"))).when(F.col("diagnosis") == "nothing_parsed", "0 listings parsed")


def stopped_after(error: Column) -> Column:
    return F.nullif(F.regexp_extract(error, r"Aborted after (\d+)", 1), F.lit("")).cast("int")


def dominant_label(errors: DataFrame, by: str, label: str = "label", order: str = "seq") -> DataFrame:
    """(by, label): each group's most frequent label, of equals the one seen first."""
    d = errors.groupBy(by, label).agg(F.count("*").alias("n"), F.min(order).alias("f"))
    return d.groupBy(by).agg(F.max_by(F.col(label), F.struct("n", -F.col("f"))).alias(label))


def silent_counties(targets: DataFrame, sightings: DataFrame, since: Column) -> DataFrame:
    """targets (key) that no sighting (date, counties array) names since a time."""
    seen = sightings.where(F.col("date") >= since).select(F.explode("counties").alias("key")).distinct()
    return targets.join(seen, "key", "left_anti")


def top(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows, with remainder: how many more there are."""
    more = rows.agg(F.greatest(F.count("*") - n, F.lit(0)).alias("remainder"))
    return rows.orderBy(*order).limit(n).crossJoin(F.broadcast(more))  # the joined side is one row


def by_acres(c: str = "acres") -> Column:
    return F.coalesce(F.col(c), F.lit(0.0)).desc()


def breaker(log: DataFrame, order: list[Column], blocked_most: int = 5, errors_most: int = 10) -> DataFrame:
    """log (source, outcome) with stopped: whether the source had its fill of blocked or error pages before the row."""
    w = Window.partitionBy("source").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    n = lambda o: F.coalesce(F.count_if(F.col("outcome") == o).over(w), F.lit(0))
    return log.withColumn("stopped", (n("blocked") >= blocked_most) | (n("error") >= errors_most))


def series_cut(log: DataFrame, ends: Column, order: list[Column], key: str = "series") -> DataFrame:
    """Rows of a series up to and with the first row that ends it."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return log.withColumn("_e", F.coalesce(F.bool_or(F.coalesce(ends, F.lit(False))).over(w), F.lit(False))).where("NOT _e").drop("_e")


def more_pages(total: Column, last: Column, cards: Column, full: Column, parsed: Column) -> Column:
    """Whether results go on after a page: by the site's total, else by a full page of cards."""
    return F.when(total.isNotNull() & last.isNotNull(), total > last).otherwise(F.coalesce((parsed > 0) & (cards >= full), F.lit(False)))


def genuine_failures(failed: Column, unknown: Column, unreadable: Column) -> Column:
    return F.greatest(F.lit(0), failed - unknown - unreadable)


def noteworthy(runs: DataFrame, by: str) -> DataFrame:
    """(by, noteworthy): any row aborted, with writes, write errors, abandoned or crashed."""
    any_of = F.col("aborted") | (F.col("written") > 0) | (F.col("write_errors") > 0) | F.col("abandoned") | F.col("crashed")
    return runs.groupBy(by).agg(F.bool_or(any_of).alias("noteworthy"))


def skipped_steps(dry_run: Column, price: Column, review: Column, recheck: Column) -> Column:
    """The steps that an aborted run leaves out, those already off not named."""
    step = lambda off, name: F.when(~dry_run & ~off, F.lit(name))
    return F.array_compact(F.array(step(price, "price check"), step(review, "review"), step(recheck, "lead recheck")))


def subject_line(aborted: Column, dry_run: Column, errors: Column, written: Column, duplicates: Column) -> Column:
    s = lambda c: c.cast("string")
    return F.when(aborted, F.lit("SCRAPE DID NOT RUN")).when(dry_run, F.concat(F.lit("dry run — "), s(written), F.lit(" would write"))).when((errors > 0) & (written == 0), F.concat(F.lit("ERRORS — "), s(errors), F.lit(" failures"))).when(errors > 0, F.concat(s(written), F.lit(" new leads, "), s(errors), F.lit(" errors"))).when(written == 0, F.concat(F.lit("No new leads ("), s(duplicates), F.lit(" dupes caught)"))).otherwise(F.concat(s(written), F.lit(" new leads found")))


def retry_text(status: Column, again: Column, minutes: Column, parsed: Column) -> Column:
    after = F.concat(F.lit("; retried after a "), minutes.cast("string"), F.lit("-minute cooldown"))
    return F.when(status != "retried_after_cooldown", "").when(again, F.concat(after, F.lit(" but was blocked again"))).otherwise(F.concat(after, F.lit(" and got through ("), parsed.cast("string"), F.lit(" found)")))


def per_pass(log: DataFrame) -> DataFrame:
    """(site, pass, n, failed) of a fetch log: each pass is counted alone, so a retry's report does not add up earlier ones."""
    return log.groupBy("site", "pass").agg(F.count("*").alias("n"), F.count_if(F.col("category") != "ok").alias("failed"))
