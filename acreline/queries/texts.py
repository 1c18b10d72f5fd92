"""Scalar functions, page readings and extraction on pages made up from the part table, and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..extract import cards, plugins, subject
from ..functions import keys, numbers, pages
from ..functions import text as T
from ..operators import lookup, report, review
from ..streaming import jobs, lifecycle
from .tables import events, new_folder, page_places, pages_of, places, query, records, table


def scalar(name: str, sql: str, columns):
    """A query of named columns over places; columns gives them once a session is there."""

    def f(spark, sf):
        return places(spark, sf).select("k", *[x.alias(n) for n, x in columns().items()])

    f.__name__ = name
    query(f"SELECT k, {sql} FROM place")(f)


c, lit = F.col, F.lit


def cat(*parts):
    return F.concat(*[p if not isinstance(p, str) else lit(p) for p in parts])


def s(name):
    return F.col(name).cast("string")


scalar("prs01_acreage", "acres + 0.25 AS a, NULL::DOUBLE AS b", lambda: dict(a=numbers.acreage(F.regexp_extract(cat("x ", s("acres"), ".25 acres"), numbers.ACREAGE, 0)), b=numbers.acreage(F.regexp_extract(cat("1", s("acres"), ",5 "), rf"({numbers.ACREAGE})(?= acres)", 1))))
scalar("prs02_total_price", "price::DOUBLE AS total", lambda: dict(total=numbers.total_price(cat("$2,900/acre • $", F.format_number("price", 0), " • 9 acres"))))
scalar("prs03_headline_acres", "acres - 0.25 AS acres", lambda: dict(acres=numbers.headline_acres(cat("$", F.format_number("price", 0), s("acres"), " acres of land, ", (c("acres") - lit(0.25)).cast("decimal(10,2)").cast("string"), " +/- acres surveyed; 9.5 acres pasture"))))
scalar("prs04_usual_acres", "acres::DOUBLE AS acres", lambda: dict(acres=numbers.usual_acres(cat(s("acres"), " acres, 7 acres, ", s("acres"), "± acre, 999 acres"))))
scalar("prs05_price_text", "price::DOUBLE AS a, NULL::DOUBLE AS b, NULL::DOUBLE AS c", lambda: dict(a=numbers.price_text(cat(" $", F.format_number("price", 0))), b=numbers.price_text(cat("$", s("price"), " - $", s("price"))), c=numbers.price_text(cat("$", s("price"), " / acre"))))
scalar("prs06_prices", "price::DOUBLE AS price, acres + 0.5 AS acres, CASE WHEN k > 1000 THEN k::DOUBLE END AS value", lambda: dict(price=numbers.price(cat("USD ", s("price"))), acres=numbers.acres(cat(s("acres"), ".5 ac")), value=numbers.price_value(s("k"))))
scalar("prs07_currency", "price + 0.5 AS n", lambda: dict(n=numbers.currency(cat("$", F.format_number("price", 0), ".50/ac"))))
scalar("prs08_first_value", "county AS v", lambda: dict(v=F.coalesce(numbers.text_or_null(lit("")), F.try_element_at(F.array(c("county"), lit("x")), lit(1)))))
scalar("prs09_coordinates", "30.0 + k % 30 AS raw, CASE WHEN k % 30 <= 20 THEN 30.0 + k % 30 END AS lat", lambda: dict(raw=(30 + c("k") % 30).cast("double"), lat=numbers.coordinates(cat("at ", (30 + c("k") % 30).cast("string"), ".0, -90.5"))["lat"]))
scalar("prs10_high_risk", "k % 3 < 2 AS risk", lambda: dict(risk=pages.high_risk_zone(F.element_at(F.array(lit(" AE"), lit("ve"), lit("X")), (c("k") % 3 + 1).cast("int")))))
scalar("prs11_county_form", "lower(county) AS f", lambda: dict(f=keys.county_form(cat(" ", F.upper("county"), "  County. 7"))))
scalar("prs12_bucket", "greatest(5, floor(acres / 5 + 0.5) * 5)::DOUBLE AS a, greatest(5000, floor(price / 5000 + 0.5) * 5000)::DOUBLE AS p", lambda: dict(a=numbers.bucket(c("acres"), 5), p=numbers.bucket(c("price"), 5000)))
scalar("prs13_states", "stname AS a, st AS b, lower(stname) AS c, 'PUERTO RICO' AS d", lambda: dict(a=keys.state_name(F.lower("st")), b=keys.state_letters(cat(F.upper("stname"), " ")), c=keys.state_slug(c("st")), d=keys.state_letters(lit("Puerto Rico "))))
scalar("prs14_slugs", "lower(county) || '-obrien' AS a, 'mc-' || lower(county) AS b, 'Saint ' || county AS c", lambda: dict(a=keys.county_slug(cat(c("county"), " O'Brien!")), b=keys.county_slug_at(cat("Mc", c("county")), "mossyoak"), c=keys.filter_name(cat("St. ", c("county")))))
scalar("prs15_title_host", "county || ' Ranch' AS title, 'land.example' AS host", lambda: dict(title=T.clean_title(cat(c("county"), "  Ranch | Land Site")), host=keys.host(cat("https://WWW.land.example:8080/", c("county")))))
scalar("prs16_url_county", "county, st AS state", lambda: dict(county=keys.county_of_url(cat("https://www.tuttland.com/land-sale/", F.lower("stname"), "/", F.lower("county"), "-county/x"))["county"], state=keys.county_of_url(cat("https://www.tuttland.com/land-sale/", F.lower("stname"), "/", F.lower("county"), "-county/x"))["state"]))
scalar("prs17_source", "(['LandWatch', 'LANDFLIP', 'generic'])[k % 3 + 1] AS source", lambda: dict(source=keys.source_of(F.element_at(F.array(lit("https://www.landwatch.com/x"), lit("http://landflip.com"), lit("https://x.example")), (c("k") % 3 + 1).cast("int")))))
scalar("prs18_fnv1a", "list_reduce([2166136261::BIGINT] || list_transform(range(1, length(county) + 1), lambda i: ascii(substr(county, i, 1))::BIGINT), lambda h, b: (xor(h, b)::HUGEINT * 16777619 % 4294967296)::BIGINT) AS h", lambda: dict(h=keys.fnv1a(c("county"))))
scalar("prs19_fingerprint", "substr(sha256(lower(county) || '|' || st || '|' || greatest(5, floor(acres / 5 + 0.5) * 5)::BIGINT || '|' || greatest(5000, floor(price / 5000 + 0.5) * 5000)::BIGINT), 1, 16) AS f", lambda: dict(f=keys.fingerprint(c("county"), c("st"), c("acres"), c("price"))))
scalar("prs20_page_kinds", "k % 3 = 0 AS blocked, k % 3 = 1 AS shell, true AS short", lambda: dict(blocked=pages.blocked_page(F.when(c("k") % 3 == 0, "<p>Just a moment...").otherwise("<p>ok")), shell=pages.error_shell(F.when(c("k") % 3 == 1, "<title>Site / 404</title>").otherwise("<title>x</title>")), short=pages.empty_shell(lit("<p>few words</p>"))))
scalar("prs21_empty_results", "k % 2 = 0 AS none, k % 3 = 0 AS none_here", lambda: dict(none=pages.empty_results(F.when(c("k") % 2 == 0, "<b>No Results</b>").otherwise("<b>one</b>")), none_here=pages.empty_results(cat("Showing 0-0 of ", (c("k") % 3).cast("string"), " listings"), "whitetail")))
scalar("prs22_blocked_address", "k % 256 IN (0, 10, 127) OR k % 256 >= 224 AS blocked", lambda: dict(blocked=numbers.blocked_ipv4(cat((c("k") % 256).cast("string"), ".7.7.7"))))
scalar("prs23_descriptions", "county || ' fine land' AS a", lambda: dict(a=T.joined_descriptions(c("county"), cat(c("county"), "  fine land"))))
scalar("prs24_note_merge", "county || chr(10) || 'entry' || chr(10) || chr(10) || '--- AUTO ANALYSIS ---' || chr(10) || 'x' AS note", lambda: dict(note=T.merged_note(cat(c("county"), "\n--- AUTO ANALYSIS ---\nx"), lit("entry"))))
scalar("prs25_reason_category", "(['fetch-failed', 'below-acre-floor', 'other', 'watch-zone'])[k % 4 + 1] AS category", lambda: dict(category=T.reason_category(F.element_at(F.array(lit("fetch failed: x"), lit("below 40-acre floor: live 3 ac"), lit("below the line"), lit("watch zone: x")), (c("k") % 4 + 1).cast("int")))))
scalar("prs26_junk_anchor", "k % 3 < 2 AS junk", lambda: dict(junk=T.junk_anchor(F.element_at(F.array(lit("View Photos"), lit("12 photos"), lit("Pine Ridge")), (c("k") % 3 + 1).cast("int")))))
scalar("prs27_status_kind", "(['sold', 'pending', 'active', NULL])[k % 4 + 1] AS kind", lambda: dict(kind=T.status_kind(F.element_at(F.array(lit("Off-Market"), lit("Sale Pending"), lit("New Listing"), lit("?")), (c("k") % 4 + 1).cast("int")))))
scalar("prs28_merged_status", "CASE WHEN k % 2 = 0 THEN 'Sold' ELSE 'Pending' END AS status", lambda: dict(status=T.merged_status(F.array(lit("Active"), lit(None).cast("string"), lit("Pending"), F.when(c("k") % 2 == 0, "Sold")))))

def text_page():
    return cat("<html><title>", c("county"), " tract</title><body><h1>", c("county"), "</h1><p>", F.when(c("k") % 2 == 0, "This land has been sold").otherwise("Fine land"), "</p><h2>Similar listings</h2><p>under contract</p></body></html>")


def text_pages(spark, sf):
    return page_places(spark, sf).withColumn("html", text_page())


@query("SELECT k, CASE WHEN k % 2 = 0 THEN 'sold' END AS status FROM place")
def hlp01_text_status(spark, sf):
    return subject.with_detail(text_pages(spark, sf), "html", "scoped_html", "h1").select("k", subject.text_status(F.col("html")).alias("status"))


@query("SELECT k, 'Under Contract' AS status FROM place")
def hlp02_panel_status(spark, sf):
    d = pages_of(page_places(spark, sf), '<aside class="tl-property-panel"><p class="tl-property-stat"><strong>{acres} acres</strong></p><p class="tl-property-stat"><strong>Under Contract</strong></p></aside>')
    return subject.with_detail(d, "html", "panel").select("k", subject.panel_status().alias("status"))


@query("SELECT k, k % 2 = 0 AS ok, CASE WHEN k % 2 = 0 THEN price::DOUBLE END AS price, CASE WHEN k % 2 = 0 THEN 'sold' END AS status_kind FROM place")
def hlp03_subject_form(spark, sf):
    r = pages.subject(F.col("k") % 2 == 0, "x", lit(" Sold "), c("price").cast("double"), lit(0.0), c("county"), c("st"), lit(None).cast("string"))
    return places(spark, sf).select("k", r["ok"].alias("ok"), r["price"].alias("price"), r["status_kind"].alias("status_kind"))


@query("SELECT k, 'a' || county || 'b' AS scoped, true AS cut FROM place")
def hlp04_widget_spans(spark, sf):
    d = pages_of(page_places(spark, sf), 'a{county}"nearbyListings": [{"x": "]"}, [1]]b').select("k", cards.detail_of(F.col("html"), "scoped_html", "boundary").alias("d"))
    return d.select("k", F.col("d.scoped_html").alias("scoped"), F.col("d.boundary").alias("cut"))


@query("SELECT k, '<body><p>' || county || '</p>' AS scoped FROM place")
def hlp05_boundaries(spark, sf):
    d = pages_of(page_places(spark, sf), '<body><p>{county}</p><div id="related-box"><p>other</p></div><h2>Nearby</h2>').select("k", cards.detail_of(F.col("html"), "scoped_html").alias("d"))
    return d.select("k", F.col("d.scoped_html").alias("scoped"))


@query("SELECT k, county || ' is a very long story of land ' || k AS prose FROM place")
def hlp06_largest_block(spark, sf):
    d = pages_of(page_places(spark, sf), "<body><div><p>x</p><section><p>{county} is a very long story of land {k}</p></section></div><nav>menu menu menu menu menu</nav></body>")
    return d.select("k", cards.detail_of(F.col("html"), "description")["description"].alias("prose"))


scalar("hlp07_spaces", "county || ' land' AS t", lambda: dict(t=T.squeeze(cat("  ", c("county"), "\n\t land "))))
scalar("hlp08_meta_description", "county || ' & more' AS d", lambda: dict(d=pages.meta_description(cat('<meta content="', c("county"), ' &amp; more" name="description">'))))
scalar("hlp09_coordinates", "30.5 + k % 10 AS a, 31.25 AS b", lambda: dict(a=pages.coordinates_of_meta(cat('<meta name="geo.position" content="', (30 + c("k") % 10).cast("string"), '.5;-90.5">'))["lat"], b=pages.coordinates_of_links(lit("https://maps.example/?q=31.25,-88.75&z=3"))["lat"]))
scalar("hlp10_tags", "3 AS n", lambda: dict(n=pages.count_tags(cat("<p>", c("county"), "</p><br>"))))
scalar("hlp11_decimals", "CASE WHEN k % 4 = 0 THEN 0 WHEN k % 2 = 0 THEN 1 ELSE 2 END AS n", lambda: dict(n=numbers.decimal_places(c("acres").cast("double") + F.when(c("k") % 4 == 0, 0.0).when(c("k") % 2 == 0, 0.5).otherwise(0.25))))


@query("SELECT k, county, st AS state, acres::DOUBLE AS acres FROM place")
def hlp12_grammars(spark, sf):
    text = cat("View this land with ", s("acres"), " acres by Town in ", c("county"), " County, ", c("stname"), " today")
    place = subject.description_place(text)
    return places(spark, sf).select("k", place["county"].alias("county"), place["state"].alias("state"), subject.description_acres(text).alias("acres"))


scalar("hlp13_locations", "st AS a, NULL::VARCHAR AS b", lambda: dict(a=keys.known_state(c("stname")), b=keys.known_state(cat(c("stname"), "x"))))
scalar("hlp14_unavailable", "k % 2 = 0 AS u", lambda: dict(u=T.unavailable_status(F.when(c("k") % 2 == 0, "FOR SALE - UNDER CONTRACT").otherwise("FOR SALE"))))
scalar("hlp15_detail_urls", "k % 2 = 0 AS a, 'https://x.example/pid/' || k AS b", lambda: dict(a=keys.is_detail_url(F.when(c("k") % 2 == 0, cat("https://x/land/", s("k"))).otherwise("/land-for-sale/x"), "landflip"), b=keys.canonical_url(cat("https://X.example/pid/", s("k"), "/?a#b"))))
scalar("hlp16_showing", "50::BIGINT AS last, price AS total", lambda: dict(last=pages.showing_range(cat("Showing 1-50 of ", F.format_number("price", 0), " listings"))["to"], total=pages.showing_range(cat("Showing 1-50 of ", F.format_number("price", 0), " listings"))["total"]))


@query("SELECT event_id, CASE WHEN value > 0 THEN floor(value)::BIGINT ELSE 40 END AS floor FROM events")
def hlp17_url_floor(spark, sf):
    from ..operators.classify import url_floor

    return events(spark, sf).select("event_id", url_floor(F.col("value")).alias("floor"))


@query("SELECT k, 'About ' || county AS d FROM place")
def hlp18_own_description(spark, sf):
    d = pages_of(page_places(spark, sf), '<body><div class="listing-description">Property Description About {county}</div><p>' + "other " * 30 + "</p></body>")
    return d.select("k", cards.detail_of(F.col("html"), "description")["description"].alias("d"))


@query("SELECT lower(county) || '|' || upper(state) AS key, max_cpa > 0 AS has_target FROM (SELECT county, state, coalesce(max_cpa, 0) AS max_cpa FROM county)")
def hlp19_target_preferred(spark, sf):
    from .tables import counties

    both = counties(spark, sf).unionByName(counties(spark, sf).withColumn("seq", F.col("seq") + 50).withColumn("max_cpa", F.lit(None).cast("double")))
    return lookup.county_index(both).select("key", "has_target")


@query("SELECT event_id, s = 429 OR s >= 500 AS retryable, s = 408 OR s >= 500 AS ambiguous FROM (SELECT event_id, ([200, 408, 429, 500])[event_id % 4 + 1] AS s FROM events)")
def hlp20_statuses(spark, sf):
    st = F.element_at(F.array(*map(F.lit, (200, 408, 429, 500))), (F.col("event_id") % 4 + 1).cast("int"))
    return events(spark, sf).select("event_id", report.retryable(st).alias("retryable"), report.ambiguous(st).alias("ambiguous"))


scalar("hlp21_log_entry", "'old' || chr(10) || '[2024-01-02] ' || county AS log", lambda: dict(log=T.log_entry(lit("old"), lit("2024-01-02"), c("county"))))


@query("SELECT doc_id, 'Score: ' || repeat('★', n) || repeat('☆', 5 - n) AS head FROM (SELECT doc_id, (doc_id % 6)::INTEGER AS n FROM documents)")
def hlp22_analysis(spark, sf):
    none = F.array().cast("array<string>")
    d = table(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 6).cast("double").alias("score"), F.lit("good").alias("price_class"), F.lit("small").alias("size_class"), *[none.alias(x) for x in ("availability_flags", "dealbreakers", "yellow_flags", "positives")])
    return d.select("doc_id", F.substring_index(review.analysis_text(), " (", 1).alias("head"))


scalar("hlp23_subject", "CASE WHEN k % 3 = 0 THEN 'SCRAPE DID NOT RUN' WHEN k % 3 = 1 THEN 'No new leads (2 dupes caught)' ELSE k || ' new leads found' END AS s", lambda: dict(s=report.subject_line(c("k") % 3 == 0, lit(False), lit(0), F.when(c("k") % 3 == 2, c("k")).otherwise(0), lit(2))))


@query("SELECT doc_id, (SELECT count(*) FROM documents) - 10 AS remainder FROM documents ORDER BY doc_id LIMIT 10")
def hlp24_report_section(spark, sf):
    return report.top(table(spark, sf, "documents").select("doc_id"), [F.col("doc_id")], 10)


scalar("hlp25_fraction", "CASE WHEN k % 2 = 0 THEN 'every page' ELSE '1 of 3 pages' END AS f, 10 AS stopped", lambda: dict(f=T.fraction(F.when(c("k") % 2 == 0, 3).otherwise(1), lit(3), "page"), stopped=report.stopped_after(lit("Aborted after 10 error pages"))))


@query("SELECT event_id, dayofweek(ts) = 0 AS sunday FROM events")
def hlp26_sunday(spark, sf):
    return events(spark, sf).select("event_id", (F.dayofweek("ts") == 1).alias("sunday"))


scalar("hlp27_gaps", "'price' AS g, 'Created New Lead from submitted URL: price unknown, ' || acres || ' acres, ' || county || ' County, ' || st || '.' AS t", lambda: dict(g=F.array_join(T.gaps(lit(0), c("acres"), c("county")), ","), t=T.created_summary(lit(0), c("acres"), c("county"), c("st"))))


@query("SELECT p - 1 AS pos, chr(64 + p::INTEGER) AS county, 'KY' AS state FROM (SELECT unnest(range(1, 4)) AS p)")
def hlp28_options(spark, sf):
    from ..plans.search import requested_of

    return requested_of(spark.range(1).select(F.lit("A|KY, B|KY,C | KY").alias("option"))).select(F.col("pos").cast("bigint").alias("pos"), "county", "state")


scalar("hlp29_slugs", "lower(county) || '-new-lead' AS s", lambda: dict(s=keys.slug(cat(c("county"), " -- New Lead!"))))
scalar("hlp32_outcomes", "CASE WHEN k % 4 = 0 THEN 'Failed' WHEN k % 4 = 1 THEN 'Duplicate' WHEN k % 4 = 2 THEN 'Added' WHEN k % 3 = 0 THEN 'Failed' ELSE 'Retry' END AS s", lambda: dict(s=F.when(c("k") % 4 == 0, "Failed").when(c("k") % 4 == 1, "Duplicate").when(c("k") % 4 == 2, "Added").when(c("k") % 3 == 0, "Failed").otherwise("Retry")))
scalar("hlp33_money", "'$' || format('{:,}', price) AS m, NULL::DOUBLE AS n", lambda: dict(m=numbers.money(c("price") + 0.25), n=numbers.currency(lit("none"))))
def address_v4(k):
    """The k-th address from 10.0.0.0 on."""
    n = F.lit(10 << 24) + k
    return F.concat_ws(".", *[F.shiftright(n, bits).bitwiseAND(F.lit(255)).cast("string") for bits in (24, 16, 8, 0)])


def address_v6(k):
    """The k-th address from fd00:: on, in groups of 16 bits."""
    return F.concat(F.lit("fd00::"), F.concat_ws(":", *[F.lower(F.hex(F.shiftright(k, bits).bitwiseAND(F.lit(0xFFFF)))) for bits in (48, 32, 16, 0)]))


scalar("hlp35_addresses", "167772160 + k AS v4, true AS v6", lambda: dict(v4=numbers.ipv4(address_v4(c("k"))), v6=numbers.blocked_ipv6(address_v6(c("k")))))


# ---- search pages: one card a property, of every site


def search_page(site: str, *parts: str):
    return lambda spark, sf: cards.search_listings(pages_of(page_places(spark, sf), *parts).select("k", F.lit(site).alias("site"), "html", "county", F.col("st").alias("state")))


FOUND = "SELECT k, price::DOUBLE AS price, acres::DOUBLE AS acres, county, st AS state, {url} AS url FROM place {where}"


def site_query(name: str, site: str, url: str, *parts: str, where: str = ""):
    def f(spark, sf):
        return search_page(site, *parts)(spark, sf).select("k", "price", "acres", "county", "state", "url")

    f.__name__ = name
    query(FOUND.format(url=url, where=where))(f)


site_query("ext01_linked_cards", "mossyoak", "'https://www.mossyoakproperties.com/property/p-' || k", '<div><a href="/land-for-sale/kentucky/wayne-county/">x</a><div class="c"><a href="/property/p-{k}"><img></a><h3><a href="/property/p-{k}?a=1">Tract {k}</a></h3><span>${price} · {acres} acres in {county} County</span></div></div>'.replace("${price}", "$ {price}"))
site_query("ext04_landcom", "landcom", "'https://www.land.com/listing/' || k", '<div class="property-card"><h2>T {k}</h2><p class="price">$ {price}</p><p class="acres">{acres} ac</p><a href="/listing/{k}">x</a></div><div class="property-card"><h2>no link</h2></div>')
site_query("ext05_landfarm", "landfarm", "'https://www.landandfarm.com/property/' || k", '<li class="search-result"><h3>T {k}</h3><p class="result-price">$ {price}</p><p class="acreage">{acres} ac</p><a href="/property/{k}">x</a></li>')
site_query("ext06_landsofamerica", "landsofamerica", "'https://www.landsofamerica.com/property/' || k", '<li data-testid="property-card" data-lat="31.5" data-lon="-90.5"><h3>T {k}</h3><p class="price">$ {price}</p><p class="acres">{acres} ac</p><a href="/property/{k}">x</a></li>')
site_query("ext07_livingthedream", "livingthedream", "'https://www.livingthedreamland.com/p/' || k", '<div class="rs-listing-card" data-lat="31.5" data-lng="-90.5"><h3 class="card-title"><a href="/p/{k}">T {k}</a></h3><p class="location"><span>{county} County,</span><span>{st}</span></p><b class="label--price">$ {price}</b><b class="label--acre">{acres} ac</b></div>')
site_query("ext08_whitetail", "whitetail", "'https://www.whitetailproperties.com/hunting-land/x/y/' || k", '<p>Showing 1-1 of 1 listings</p><div><a href="/hunting-land/x/y/{k}">Tract {k}</a><p>$ {price}</p><p>{acres}± Acres {county} County</p></div>')
site_query("ext10_mossyoak", "mossyoak", "'https://www.mossyoakproperties.com/listing/' || k", '<div><a href="/listing/{k}">Tract {k}</a> $ {price} {acres} acres</div><div><a href="/land-for-sale/ok/x-county/">county</a> $ 10,000 5 acres</div>')
site_query("ext11_midwestlandgroup", "midwestlandgroup", "'https://midwestlandgroup.com/listings/p-' || k", '<div class="listings-archive row hidden"><a href="/listings/none">x</a></div><div class="listings-archive row"><h3 class="listings-archive__title"><a href="/listings/p-{k}">T</a></h3><span class="listings-archive__item item--price">$ {price}</span><span class="listings-archive__item item--acre">{acres}</span><span class="listings-archive__item item--county">{county}</span><span class="listings-archive__item item--state">{stname}</span></div>')
site_query("ext13_landflip", "landflip", "'https://www.landflip.com/land/' || k", '<article class="list-block"><div class="list-info"><h4><a href="/land/{k}">T</a></h4><p>Town : {county} County : {st}</p></div><span class="price-ac">{acres} Acres : $ {price}</span></article>')
site_query("ext15_nationalland", "nationalland", "'https://nationalland.com/listing/p-' || k", '<div data-property="T" data-slug="p-{k}" data-status="ACTIVE" data-county="{county}" data-price="{price}" data-acres="{acres}"></div><div data-property="T" data-slug="gone" data-status="SOLD"></div>')
site_query("ext16_tuttland", "tuttland", "'https://www.tuttland.com/land/' || k", '<article class="tl-tile"><a class="tl-hit" href="/land/{k}">x</a><b class="tl-badge tl-status">Active</b><meta itemprop="price" content="{price}"><h3 class="tl-tile-title">T</h3><p class="tl-line tl-county">{acres} acres</p><p class="tl-subtitle"><span itemprop="name">Land in {county} County, {st}</span></p></article><article class="tl-tile"><a class="tl-hit" href="/land/y">x</a><b class="tl-badge tl-status">Under Contract</b></article>')


@query("SELECT k, price::DOUBLE AS price, acres - 0.25 AS acres FROM place")
def ext02_landwatch(spark, sf):
    d = page_places(spark, sf).withColumn("exact", (F.col("acres") - F.lit(0.25)).cast("decimal(10,2)"))
    d = pages_of(d, '<script type="application/ld+json">[{"url": "https://www.landwatch.com/a/pid/{k}", "description": "{exact} +/- acre tract"}]</script><div><a href="/a/pid/{k}">Tract {k}</a> $ {price} {acres} acres in {county} County</div>')
    return cards.search_listings(d.select("k", F.lit("landwatch").alias("site"), "html", "county", F.col("st").alias("state"))).select("k", "price", "acres")


scalar("ext03_total_count", "k AS a, price AS b", lambda: dict(a=pages.total_count(cat('<script id="__SERVER_STATE__" type="x">{"searchPage":{"searchResults":{"totalCount":', s("k"), "}}}</script>")), b=pages.total_count(cat('<meta name="description" content="LandWatch has ', F.format_number("price", 0), ' land listings for sale in X">'))))


@query("SELECT * FROM (VALUES ('Leflore', 'Le Flore'), ('St Clair', 'Saint Clair')) t(search, near)")
def ext09_near_names(spark, sf):
    searches = spark.createDataFrame([("Leflore",), ("St Clair",), ("Wayne",), ("Nowhere",)], "search string")
    return lookup.near_county_name(searches, spark.createDataFrame([("Le Flore",), ("Saint Clair",), ("WAYNE",)], "name string"))


@query("SELECT k, price::DOUBLE AS price, county FROM place")
def ext12_labels(spark, sf):
    d = pages_of(page_places(spark, sf), '<p class="listings-detail__item"><span>Price:</span><b class="listings-detail__info">$ {price}</b></p><p class="listings-detail__item"><span>County:</span><b class="listings-detail__info">{county}</b></p>')
    m = d.select("k", cards.detail_of(F.col("html"), "labels")["labels"].alias("m"))
    return m.select("k", numbers.price(F.try_element_at("m", F.lit("price"))).alias("price"), F.try_element_at("m", F.lit("county")).alias("county"))


LANDFLIP_PAGE = ('<html><head><script type="application/ld+json">{"@type": "Product", "offers": {"price": "{price}.00", "availability": "https://schema.org/InStock"}}</script><meta name="description" content="View this land for sale with {acres} acres by Town in {county} County, {stname}."></head><body><h1>T</h1></body></html>',)


@query("SELECT k, price::DOUBLE AS price, acres::DOUBLE AS acres, county, st AS state FROM place")
def ext14_landflip_detail(spark, sf):
    d = subject.with_detail(pages_of(page_places(spark, sf), *LANDFLIP_PAGE), "html", "offer_price")
    about = pages.meta_description(F.col("html"))
    return d.select("k", F.col("d.offer_price").alias("price"), subject.description_acres(about).alias("acres"), subject.description_place(about)["county"].alias("county"), subject.description_place(about)["state"].alias("state"))


@query("SELECT k, 'Land in ' || county || ' with a view. A long story about ' || county || ' and its land.' AS d FROM place")
def ext17_description(spark, sf):
    d = pages_of(page_places(spark, sf), '<html><head><meta property="og:description" content="Land in {county} with a view."><meta name="description" content="in {county}"></head><body><nav>menu</nav><div><p>A long story about {county} and its land.</p></div></body></html>')
    return d.withColumn("d", cards.detail_of(F.col("html"), "description", "too_large")).select("k", subject.detail_description(F.col("html"), F.col("d")).alias("d"))


@query("SELECT k, CASE WHEN k % 3 = 0 THEN 31.5 WHEN k % 3 = 1 THEN 32.5 ELSE 33.5 END AS lat FROM place")
def ext18_coordinates(spark, sf):
    html = F.when(F.col("k") % 3 == 0, '<script type="application/ld+json">{"geo": {"latitude": "31.5", "longitude": -90.5}}</script><meta name="ICBM" content="40, -90">').when(F.col("k") % 3 == 1, '<meta name="ICBM" content="32.5, -90.5"><a href="?q=33.5,-90.5">').otherwise('<a href="https://m.example/?q=33.5,-90.5">')
    d = page_places(spark, sf).withColumn("html", html).withColumn("g", cards.detail_of(F.col("html"), "geo")["geo"])
    return d.select("k", subject.page_coordinates(F.col("html"), F.col("g"))["lat"].alias("lat"))


DETAILS = {
    "landwatch": ("https://www.landwatch.com/x-county-{stlow}-land-for-sale/pid/{k}", '<meta name="description" content="View {acres} acres priced at ${price} in Town, {county} County, {st}: land"><p>View all 9 pictures Available</p>'),
    "whitetail": ("https://www.whitetailproperties.com/hunting-land/{stlow}/{colow}/x", "<p>Interactive Map For Sale ${price} · {acres}± Acres {county} County</p>"),
    "mossyoak": ("https://www.mossyoakproperties.com/property/x/1", "<p>Status: Available Price: ${price} Acres: {acres} City, State: Town, {stname} County: {county} Acres: {acres}</p>"),
    "nationalland": ("https://nationalland.com/listing/x", "<p>Home Wayne County, KY near {county} County, {st} ACTIVE {acres} +/- Acres ${price}</p>"),
    "tuttland": ("https://www.tuttland.com/land-sale/{stlow}/{colow}-county/x", '<script type="application/ld+json">{"offers": {"price": {price}, "availability": "InStock"}}</script><p>Land for Sale in {stname} / {county} County</p><p>Explore the Property now ${price} {acres} acres Active</p>'),
    "landflip": ("https://www.landflip.com/land/1", LANDFLIP_PAGE[0]),
    "generic": ("https://x.example/1", '<html><head><meta property="og:title" content="{acres} acres"></head><body><p class="price">${price}</p><p>{acres} acres for you</p><h2>Related</h2><p>9 acres 9 acres 9 acres</p></body></html>'),
}


def detail_pages(spark, sf, *sites):
    d = page_places(spark, sf).withColumn("stlow", F.lower("stname")).withColumn("colow", F.lower("county"))
    out = None
    for x in sites or DETAILS:
        url, html = DETAILS[x]
        one = pages_of(pages_of(d.withColumn("money", F.format_number("price", 0)), url, out="url"), html.replace("${price}", "${money}"))
        one = one.select("k", F.lit(x).alias("site"), "url", "html")
        out = one if out is None else out.unionByName(one)
    return out


def reading_query(name: str, site: str, county: bool = True):
    def f(spark, sf):
        d = subject.subjects(detail_pages(spark, sf, site))
        return d.select("k", "subject.ok", "subject.price", "subject.acres", "subject.county", "subject.state")

    f.__name__ = name
    where = "county, st AS state" if county else "NULL::VARCHAR AS county, NULL::VARCHAR AS state"
    query(f"SELECT k, true AS ok, price::DOUBLE AS price, acres::DOUBLE AS acres, {where} FROM place")(f)


reading_query("ext20_landwatch_subject", "landwatch")
reading_query("ext21_whitetail_subject", "whitetail")
reading_query("ext22_mossyoak_subject", "mossyoak")
reading_query("ext23_nationalland_subject", "nationalland")
reading_query("ext24_tuttland_subject", "tuttland")
reading_query("ext24_landflip_subject", "landflip")
reading_query("ext25_generic_subject", "generic", county=False)


@query("""SELECT k, site, true AS ok, price::DOUBLE AS price, acres::DOUBLE AS acres, CASE WHEN site <> 'generic' THEN county END AS county, CASE WHEN site <> 'generic' THEN st END AS state, CASE WHEN site <> 'generic' THEN 'active' END AS status_kind
FROM place, (SELECT unnest(['landwatch', 'whitetail', 'mossyoak', 'nationalland', 'tuttland', 'landflip', 'generic']) AS site)""")
def ext19_subjects(spark, sf):
    """What each reader makes of its kind of page, for all places."""
    return subject.subjects(detail_pages(spark, sf)).select("k", "site", *[f"subject.{c}" for c in ("ok", "price", "acres", "county", "state", "status_kind")])


@query("SELECT k, '<body>' || county AS scoped FROM place")
def ext26_scope(spark, sf):
    d = pages_of(page_places(spark, sf), "<body>{county}<h3>You may also-like</h3><p>x</p>")
    return d.select("k", cards.detail_of(F.col("html"), "scoped_html")["scoped_html"].alias("scoped"))


@query("SELECT count(*) AS n, sum(length(t))::BIGINT AS chars FROM (SELECT regexp_replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '&amp;', '&'), '&quot;', '\"'), '&middot;', '·'), '\\s+', ' ', 'g') AS t FROM pages)")
def ext27_visible_text(spark, sf):
    return table(spark, sf, "pages").select(pages.visible_text(F.col("html")).alias("t")).agg(F.count("*").alias("n"), F.sum(F.length("t")).alias("chars"))


@query("SELECT k, price::DOUBLE AS price, 'Sold' AS status, k || ' acre farm' AS name FROM place")
def ext28_json_ld(spark, sf):
    d = pages_of(page_places(spark, sf), '<script type="application/ld+json">broken</script><script type="application/ld+json">{"@graph": [{"name": "site", "price": 5}, {"name": "{k} acre farm", "offers": [{"price": "{price}", "availability": "SoldOut"}]}]}</script>').select("k", cards.detail_of(F.col("html"), "ld_price", "availability", "ld_name").alias("d"))
    return d.select("k", F.col("d.ld_price").alias("price"), T.status_of_availability(F.col("d.availability")).alias("status"), F.col("d.ld_name").alias("name"))


@query("SELECT k, price::DOUBLE AS price, acres::DOUBLE AS acres, NULL::VARCHAR AS error FROM place")
def ext29_intake(spark, sf):
    return subject.intake_details(detail_pages(spark, sf, "landwatch")).select("k", "price", "acres", "error")


@query("SELECT k, price::DOUBLE AS price, '' AS flags, 'under contract' AS review_flags FROM place")
def ext30_audit_reading(spark, sf):
    d = pages_of(page_places(spark, sf), '<html><head><title>Farm</title><script type="application/ld+json">{"offers": {"price": {price}}}</script></head><body><p>fine {acres} acres</p><h2>Similar</h2><p>one is under contract</p></body></html>').withColumn("url", F.lit("https://x.example/1"))
    r = subject.audit_readings(d.select("k", "url", "html"))
    return r.select("k", F.col("ld_price").alias("price"), F.array_join("flags", ",").alias("flags"), F.array_join("review_flags", ",").alias("review_flags"))


scalar("ext31_structured_acres", "acres + 0.5 AS value, CASE WHEN k % 2 = 0 THEN 'page_load' ELSE 'title' END AS source", lambda: dict(value=pages.structured_acres(F.when(c("k") % 2 == 0, cat("<div data-track-event=\"page_load\" data-track-data='{\"listing_acreage\": ", s("acres"), ".5}'></div><title>7 acres</title>")).otherwise(cat("<title>", s("acres"), ".5 acres</title>")))["value"], source=pages.structured_acres(F.when(c("k") % 2 == 0, cat("<div data-track-event=\"page_load\" data-track-data='{\"listing_acreage\": ", s("acres"), ".5}'></div>")).otherwise(cat("<title>", s("acres"), ".5 acres</title>")))["source"]))
scalar("ext32_market_status", "(k % 4)::DOUBLE AS n", lambda: dict(n=pages.market_status(cat('{"marketStatus" : ', (c("k") % 4).cast("string"), "}"))))


@query("SELECT k, price::DOUBLE AS price FROM place")
def ext33_price(spark, sf):
    d = pages_of(page_places(spark, sf), '<body><p class="price">$900/acre</p><b itemprop="price">$ {price}</b></body>')
    return subject.with_detail(d, "html", "offer_price", "price_texts").select("k", subject.read_price().alias("price"))


def ld_prices(spark, sf):
    return pages_of(page_places(spark, sf), '<script type="application/ld+json">{"offers": [{"price": 10}, {"price": "${price}"}]}</script>').select("k", cards.detail_of(F.col("html"), "offer_price")["offer_price"].alias("price"))


@query("SELECT k, price::DOUBLE AS price FROM place")
def ext34_offer_price(spark, sf):
    return ld_prices(spark, sf)


@query("SELECT k, price::DOUBLE AS price FROM place")
def ext35_first_ld_price(spark, sf):
    return pages_of(page_places(spark, sf), '<script type="application/ld+json">{"price": 7}</script><script type="application/ld+json">{"@graph": [{"price": {price}}]}</script>').select("k", cards.detail_of(F.col("html"), "offer_price")["offer_price"].alias("price"))


@query("SELECT id, CASE WHEN id % 2 = 0 THEN 'first ' || id WHEN id % 3 = 0 THEN 'second ' || id END AS description FROM record")
def joi11_card_descriptions(spark, sf):
    """Cards of stored records' pages and the descriptions of their structured data, with marks and queries in the urls."""
    r = records(spark, sf)
    cards_ = r.select("id", F.col("nk").alias("page"), F.concat("url", F.lit("?ref="), "id").alias("url"))
    text = lambda name, pos, url: r.select(F.col("nk").alias("page"), (F.col("id") + pos).alias("pos"), url.alias("url"), F.concat(F.lit(f"{name} "), "id").alias("description"), "id")
    found = text("first", 0, F.concat("url", F.lit("#photos"))).where("id % 2 = 0").unionByName(text("second", 10_000_000, F.col("url")).where("id % 2 = 0 OR id % 3 = 0")).unionByName(text("none", -1, F.lit("")))
    other = text("elsewhere", -5, F.col("url")).withColumn("page", F.col("page") + 100)
    return lookup.with_descriptions(cards_, found.unionByName(other).drop("id")).select("id", "description")


@query("SELECT k, '31.5, -90.5' AS geo FROM place")
def set08_json_search(spark, sf):
    return pages_of(page_places(spark, sf), '<script type="application/ld+json">{"a": [{"b": {"latitude": 31.5, "longitude": -90.5, "k": {k}}}]}</script>').select("k", cards.detail_of(F.col("html"), "geo")["geo"].alias("geo"))


def plugin_counts(d):
    """The places that each site's reader finds on a page with the cards of all sites."""
    d = pages_of(d, '<div class="property-card search-result listing-card"><h3>T</h3><p class="price">$ {price}</p><p class="acres">{acres} acres</p><a href="/property/{k}">Tract</a></div><div class="rs-listing-card"><b class="card-title"><a href="/p">T</a></b></div><div><a href="/a/pid/{k}">Tract A</a> $ {price} {acres} acres</div><div><a href="/hunting-land/a/b/{k}">Tract B</a> $ {price} {acres} acres</div><div class="listings-archive row"><a href="/listings/x">T</a></div><article class="list-block" data-url="/land/{k}"></article><div data-property="T" data-slug="s"></div><article class="tl-tile"><a class="tl-hit" href="/x">T</a></article>')
    d = d.select("k", "html", F.explode(F.array(*map(F.lit, cards.SEARCH))).alias("site"))
    return cards.search_listings(d).groupBy("site").agg(F.countDistinct("k").alias("n"))  # eleven sites


@query("SELECT site, count(*) AS n FROM place, (SELECT unnest(['landwatch', 'landcom', 'landfarm', 'landsofamerica', 'livingthedream', 'whitetail', 'mossyoak', 'midwestlandgroup', 'landflip', 'nationalland', 'tuttland']) AS site) GROUP BY 1")
def udf01_plugins(spark, sf):
    """Every registered site reads its own kind of page, for all places."""
    return plugin_counts(page_places(spark, sf))


@query("SELECT site, count(*) AS n FROM place, (SELECT unnest(['landwatch', 'landcom', 'landfarm', 'landsofamerica', 'livingthedream', 'whitetail', 'mossyoak', 'midwestlandgroup', 'landflip', 'nationalland', 'tuttland']) AS site) GROUP BY 1")
def udf01_plugins_whole(spark, sf):
    """Every registered site reads the pages of all places."""
    return plugin_counts(page_places(spark, sf))


@query("SELECT k, CASE WHEN k % 10 <> 0 THEN county END AS name, CASE WHEN k % 10 <> 0 THEN '/t/' || k END AS url, CASE WHEN k % 10 = 0 THEN 'ValueError: page of ' || county END AS error, CASE WHEN k % 10 <> 0 THEN acres END AS lot FROM place")
def udf01_registry(spark, sf):
    """A site registered here, with a column of its own; a page on which its reader fails is a row with the error."""

    def lots(html: str) -> list[dict]:
        if html.startswith("!"):
            raise ValueError(f"page of {html[1:]}")
        name, k, lot = html.split("|")
        return [{"name": name, "url": f"/t/{k}", "lot": int(lot)}]

    if "lots-of-places" not in plugins.REGISTRY:
        plugins.register(plugins.Site("lots-of-places", lots, more="lot long"))
    d = page_places(spark, sf).withColumn("html", F.when(F.col("k") % 10 == 0, F.concat(F.lit("!"), "county")).otherwise(F.concat_ws("|", "county", "k", "acres"))).select("k", "html")
    return plugins.read_pages(d, "lots-of-places").select("k", "name", "url", "error", "lot")


@query("SELECT k, site FROM place, (SELECT unnest(['landwatch', 'tuttland']) AS site)")
def udf02_readers(spark, sf):
    return subject.subjects(detail_pages(spark, sf, "landwatch", "tuttland")).where("subject.ok").select("k", "site")


# ---- streams, drained over what is there


def event_stream(spark, sf):
    return jobs.table_stream(spark, sf, "events", "ts")


@query("SELECT count(*) AS n FROM (SELECT DISTINCT user_id FROM events WHERE user_id % 10 <> 0)")
def str01_new_urls(spark, sf):
    known = table(spark, sf, "events").where("user_id % 10 = 0").select(F.concat(F.lit("u"), "user_id").alias("url")).distinct()
    d = jobs.new_urls(event_stream(spark, sf).select("ts", F.concat(F.lit("u"), "user_id").alias("url")), known, "ts", "10000 days")
    return jobs.drained(d, "urls").agg(F.count("*").alias("n"))


@query("SELECT time_bucket(INTERVAL 6 HOUR, ts, timestamp '1970-01-01') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def str02_tumbling_stream(spark, sf):
    d = jobs.windows(event_stream(spark, sf), "ts", ["event_type"], "6 hours")
    return jobs.drained(d, "tumbling", "complete").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT day, 'u' || user_id AS key, count(*) AS n FROM (SELECT user_id, unnest(range(0, 7)) AS o, cast(ts AS date) AS d FROM events WHERE event_type = 'signup'), LATERAL (SELECT d + o::INTEGER AS day) GROUP BY 1, 2")
def str03_sightings_stream(spark, sf):
    d = jobs.sightings(event_stream(spark, sf).where("event_type = 'signup'"), "ts", F.concat(F.lit("u"), "user_id"))
    return jobs.drained(d, "sightings", "complete")


@query("SELECT user_id AS id, cur AS price, stored, coalesce(cur < stored, false) AS dropped FROM watch")
def str04_price_state_stream(spark, sf):
    d = event_stream(spark, sf).where("event_type = 'purchase'").select(F.col("user_id").alias("id"), "ts", (F.col("value") * 1000).alias("price"), F.col("event_id").alias("seq"))
    return jobs.drained(jobs.price_states(d), "prices").select("id", "price", "stored", "dropped")


@query("""SELECT user_id AS id, event_id AS seq, CASE WHEN k < least(ended, failed) THEN 'Retry' WHEN failed < ended THEN 'Failed' ELSE status END AS status FROM (
  SELECT *, coalesce(min(k) FILTER (event_type <> 'error') OVER w, 1000000000) AS ended, coalesce(min(k) FILTER (event_type = 'error' AND errors = 2) OVER w, 1000000000) AS failed,
    first(CASE event_type WHEN 'purchase' THEN 'Added' WHEN 'signup' THEN 'Duplicate' ELSE 'Failed' END ORDER BY event_type = 'error', k) OVER w AS status
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, count(*) FILTER (event_type = 'error') OVER (PARTITION BY user_id ORDER BY event_id) AS errors FROM events) WINDOW w AS (PARTITION BY user_id))""")
def str05_attempts_stream(spark, sf):
    """The status after every attempt."""
    outcome = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "purchase", "added").when(F.col("event_type") == "signup", "duplicate").otherwise("rejected")
    d = event_stream(spark, sf).select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), outcome.alias("outcome"))
    return jobs.drained(jobs.attempts(d), "attempts").select("id", "seq", "status")


@query("SELECT count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events)")
def str06_late_retry_stream(spark, sf):
    """A second pass of the same rows adds nothing: both go through one watermark and one dedup."""
    e = event_stream(spark, sf).select("ts", F.concat_ws("/", "user_id", "event_type").alias("url"))
    late = e.unionByName(jobs.table_stream(spark, sf, "events", "ts").select("ts", F.concat_ws("/", "user_id", "event_type").alias("url")))
    d = late.withWatermark("ts", "10000 days").dropDuplicatesWithinWatermark(["url"])
    return jobs.drained(d, "retry").agg(F.count("*").alias("n"))


def str07_fetch_loop_stream(spark, sf):
    """Pages that a loop with breakers would have read; a running choice has no SQL."""
    outcome = F.when(F.col("event_type") != "error", "ok").when((F.col("value") >= 25) & (F.col("value") < 60), "blocked").otherwise("error")
    d = events(spark, sf).select("ts", (F.col("user_id") % 11).alias("source"), F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("series"), outcome.alias("outcome"))
    return jobs.drained(jobs.fetch_loop(lifecycle.in_turns(d, new_folder(spark, "log"), 4, "source")), "loop").where("read").groupBy("source").agg(F.count("*").alias("n"))


query()(str07_fetch_loop_stream)


@query("SELECT id, CASE WHEN id % 3 = 0 THEN 7.0 ELSE price END AS price FROM record")
def str08_enrichment(spark, sf):
    from ..operators.classify import filled

    r = records(spark, sf).withColumn("county", F.lit("c")).withColumn("state", F.lit("s"))
    sparse = r.withColumn("price", F.when(F.col("id") % 3 != 0, F.col("price")))
    return filled(sparse, r.withColumn("price", F.lit(7.0))).select("id", "price")
