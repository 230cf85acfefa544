"""The projection of raw listings to events, with the three outcomes event, review and excluded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.functions.classify import exclusion_reason, is_lottery, type_tag
from marquee.functions.dates import parse_date
from marquee.functions.price import on_sale_at, plain_text, price_from_text, price_from_tiers
from marquee.functions.status import status_from_tiers, text_status
from marquee.functions.text import host_label, let, squash, utrim
from marquee.operators.match import are_few, dictionary_words, match_dictionary, matched_here, resolve_city
from marquee.operators.relations import overriding

LINKS = r"(?U)\s*📍?\s*https?://\S+"


def clean_venue(venue: Column, title: Column, addresses: tuple[tuple[str, str], ...] = ()) -> Column:
    """A venue field "name / address" without links and pins.

    A name that only repeats the title gives way to the venue known for its address, by the
    first of the addresses (pattern, venue) found in it, else to the address alone.
    """
    given = F.coalesce(venue, F.lit(""))
    stripped = F.regexp_replace(F.regexp_replace(given, LINKS, ""), r"(?U)\s*📍\s*$", "")
    bare = utrim(F.when(given.contains("://") | given.contains("📍"), stripped).otherwise(given))
    venue_at = lambda address: F.coalesce(*[F.when(address.rlike(p), F.lit(v)) for p, v in addresses], F.lit(None).cast("string"))

    def read(plain):
        parts = F.transform(F.split(plain, "/"), utrim)
        address = F.array_join(F.slice(parts, F.lit(2), F.size(parts)), " / ")
        known = venue_at(address)
        promo = (parts[0] != "") & (squash(parts[0]) == squash(F.coalesce(title, F.lit(""))))
        return F.when(promo & known.isNotNull(), F.concat(known, F.lit(" / "), address)).when(promo & (address != ""), address).otherwise(plain)

    # without an address nothing is known of it, but by a pattern that finds the empty one
    return F.when(bare.contains("/") | venue_at(F.lit("")).isNotNull(), let(bare, read)).otherwise(bare)


#: Fixed value: the word of a title that makes a festival.
FESTIVAL = "音樂祭"


def _with_acts(rows: DataFrame, names: DataFrame) -> DataFrame:
    """rows with headliners and origins: the acts in each title by position, and the distinct origins that the dictionary gives them.

    A dictionary of few names is read in each row's place; with more, acts come by a join on id.
    """
    known = names if "origin" in names.columns else names.withColumn("origin", F.lit(None).cast("string"))
    origin = known.groupBy("canonical").agg(F.min_by("origin", "entry_ord").alias("origin"))
    words = dictionary_words(names)
    if are_few(words):
        found = matched_here(rows, words.join(origin, "canonical", "left"), "_acts").withColumn("_acts", F.when(F.col("id").isNotNull(), F.col("_acts")))
    else:
        acts = match_dictionary(rows.select("id", "title"), names).join(origin, "canonical", "left")
        found = rows.join(acts.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "canonical", "origin"))).alias("_acts")), "id", "left")
    origins = F.filter(F.transform("_acts", lambda a: F.nullif(a["origin"], F.lit(""))), lambda o: o.isNotNull())
    return found.withColumns({"headliners": F.transform("_acts", lambda a: a["canonical"]), "origins": F.array_distinct(origins)}).drop("_acts")


def listing_outcomes(listings: DataFrame, names: DataFrame, venue_rules: DataFrame, *, grammars: dict[str, str], today: Column, rules: dict | None = None, account_suffix: str | None = None,
                     addresses: tuple[tuple[str, str], ...] = (), overrides: DataFrame | None = None, hedge: str = "(?!)", tiered: tuple[str, ...] = ()) -> DataFrame:
    """One row a listing with `outcome` (event, needs_review, excluded), `reason`, `detail`, and the fields of the event.

    listings: id (source and raw_id, unique), source, title, venue, address, date_text,
    price_text, status_text, url, signal, tiers; raw_id, category, run_key and on_sale_text
    may be there or not. No row can stop the job: a text that can't be read gives nulls, a
    listing without a date goes to review (date_unparseable, with the text as detail), and
    so does one without a title or with an on_sale_text that is no moment (normalize_error,
    with what failed). Exclusion goes before both, but for a missing title. An event
    whose acts are unknown stays one; review_queue has it besides.

    account_suffix: the host behind which a label names the account of a listing's URL.
    Venues are cleaned (clean_venue with addresses) but for exclusion, which judges them as
    given. overrides (field, key, value): a venue, date or category that replaces what
    listing `key` (an id) has; an overriding date has no time, an empty category takes
    category and run_key away. A category is the event's type, whatever its title says. The
    moment of sale given by the source goes before one read from texts. hedge: words
    behind a general sale that undo a lottery (is_lottery). tiered: sources whose listings
    have tiers as soon as they are sold, so that one without is announced, whatever its
    texts say; of other sources the texts decide. The dictionary and
    the city rules are read in each row's place if they are few, else they meet rows by equi-joins
    on id, as the overrides do, once for all fields; everything else is one projection.
    """
    grammar = F.create_map(*[F.lit(x) for kv in grammars.items() for x in kv])[F.col("source")]
    none = F.lit(None).cast("string")
    rows = listings.withColumns({c: none for c in ("raw_id", "category", "run_key", "on_sale_text") if c not in listings.columns})
    if overrides is not None:
        rows = overriding(rows, overrides, ("venue", "category", "date"), "id")
    else:
        rows = rows.withColumns({f"_new_{c}": none for c in ("venue", "category", "date")})
    rows = rows.withColumns({"_given": F.col("venue"), "venue": F.coalesce("_new_venue", clean_venue(F.col("venue"), F.col("title"), addresses))})
    if overrides is not None:
        rows = rows.withColumn("category", F.coalesce("_new_category", "category")).withColumn("run_key", F.when(F.coalesce(F.col("category") != "", F.lit(True)), F.col("run_key")))
    rows = resolve_city(_with_acts(rows, names), venue_rules)
    strings = F.array().cast("array<string>")
    rows = rows.withColumns({
        "headliners": F.coalesce("headliners", strings), "origins": F.coalesce("origins", strings), "category": F.nullif("category", F.lit("")), "_d": parse_date(F.col("date_text"), grammar), "_plain": plain_text(F.col("price_text")),
        "_excluded": exclusion_reason(F.col("title"), F.col("url"), host_label(F.col("url"), account_suffix) if account_suffix else none, F.col("_given"), **(rules or {})),
        "_tier_price": price_from_tiers(F.col("tiers")), "_moment": F.try_to_timestamp("on_sale_text")})
    rows = rows.withColumns({
        "_text_price": price_from_text(F.col("price_text"), F.col("_plain")), "_sale": on_sale_at(F.col("price_text"), F.col("_plain")),
        "date": F.coalesce(F.col("_new_date").cast("date"), "_d.date"), "time": F.when(F.col("_new_date").isNull(), F.col("_d.time"))})
    untiered = F.coalesce(F.size("tiers"), F.lit(0)) <= 0
    tierless = untiered & F.col("signal").isNull() & ~F.coalesce(F.col("source").isin(*tiered), F.lit(False))
    sale = F.coalesce(F.when(F.col("_moment").isNotNull(), F.col("on_sale_text")), F.col("_sale"))
    price = lambda end: F.when(untiered, F.col(f"_text_price.{end}")).otherwise(F.col(f"_tier_price.{end}")).alias(f"price_{end}")
    state = F.when(tierless, text_status(F.col("status_text"), sale, F.col("date"), today)).otherwise(status_from_tiers(F.col("tiers"), F.col("signal"), F.col("date"), today, sale))
    # each test in order: outcome, reason and what was wrong
    told = lambda outcome, reason, detail: F.struct(F.lit(outcome).alias("outcome"), reason.alias("reason"), detail.alias("detail"))
    judged = (
        F.when(F.col("title").isNull(), told("needs_review", F.lit("normalize_error"), F.lit("title is missing")))
        .when(F.col("_excluded").isNotNull(), told("excluded", F.col("_excluded"), none))
        .when(F.col("on_sale_text").isNotNull() & F.col("_moment").isNull(), told("needs_review", F.lit("normalize_error"), F.concat(F.lit("on_sale_text: "), "on_sale_text")))
        .when(F.col("date").isNull(), told("needs_review", F.lit("date_unparseable"), F.col("date_text"))).otherwise(told("event", none, none)))
    rows = rows.withColumns({"_state": state, "_judged": judged})
    source = F.struct(F.col("source").alias("name"), "url", "raw_id")
    return rows.select(
        "id", "source", "_judged.*", "title", "venue", "city", "date", "time", price("min"), price("max"), "_state.status", "_state.on_sale_at", "headliners", F.col("headliners").alias("lineup"),
        F.coalesce(F.col("title").contains(FESTIVAL), F.lit(False)).alias("is_festival"),
        F.array(F.coalesce("category", type_tag(F.col("title"), F.col("headliners")))).alias("types"), "origins",
        F.coalesce(is_lottery(F.col("title"), F.col("price_text"), hedge), F.lit(False)).alias("is_lottery"), "category", "run_key", F.array(source).alias("sources"), "url")


def review_queue(outcomes: DataFrame) -> DataFrame:
    """(id, source, title, url, reason, detail): listings in review, and events without known acts (artist_unrecognized).

    The latter are events all the same, and only wait for their acts to be known; events
    of a category, whose names are no acts, aren't among them.
    """
    unknown = F.when((F.col("outcome") == "event") & (F.size("headliners") == 0) & F.col("category").isNull(), "artist_unrecognized")
    reason = F.when(F.col("outcome") == "needs_review", F.col("reason")).otherwise(unknown)
    # as a generated column, so that the filter doesn't work out the whole projection once more
    return outcomes.select("id", "source", "title", "url", F.explode_outer(F.array(reason)).alias("reason"), "detail").where("reason is not null")


def split_outcomes(outcomes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(events, review queue, excluded). Settle or persist outcomes first if all three are read."""
    of = lambda x: outcomes.where(F.col("outcome") == x)
    return of("event").drop("outcome", "reason", "detail"), review_queue(outcomes), of("excluded")


def review_pending(queue: DataFrame, dismissed: DataFrame) -> DataFrame:
    """The review queue without what was dismissed."""
    return queue.join(dismissed.select("raw_id"), "raw_id", "left_anti")


def listed_only(df: DataFrame) -> DataFrame:
    """Listings that are on show: no merchandise, hidden or withdrawn ones."""
    return df.where(~F.coalesce(F.col("merch"), F.lit(False)) & ~F.coalesce(F.col("hidden"), F.lit(False)) & F.coalesce(F.col("state") != "withdrawn", F.lit(True)))


def venue_predicates(df: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows found by a keyword that has venue patterns stay only if one matches; other keywords' rows stay.

    rules: keyword, pattern (a regular expression over the venue).
    """
    ruled = rules.select("keyword").distinct().withColumn("_ruled", F.lit(True))
    ok = df.join(rules, "keyword").where(F.regexp_like("venue", F.col("pattern"))).select("id").distinct().withColumn("_ok", F.lit(True))
    return df.join(ruled, "keyword", "left").join(ok, "id", "left").where("_ruled is null or _ok").drop("_ruled", "_ok")
