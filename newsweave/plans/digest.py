"""The daily digest: newest unique articles of all sources, images filled in."""

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsweave import settings
from newsweave.functions.dates import newest_first_key
from newsweave.functions.text import present
from newsweave.operators.images import (
    count_feed_lookups,
    enrich_few,
    enrich_images,
    with_images_first,
)
from newsweave.operators.ranking import (
    keep_first,
    newest_first,
    number_rows,
    with_published_time,
)
from newsweave.schema import ARRIVAL
from newsweave.session import broadcast_if_small, materialize, write_out
from newsweave.sources.api import api_articles
from newsweave.sources.dims import category_dim, source_rows
from newsweave.sources.feeds import feed_articles
from newsweave.sources.listing import listing_articles

# Rows of an address, a date and an arrival that one task may sort and hold.
ONE_TASK = 100_000
# Rows looked at for each one wanted, before addresses are known to be unique.
MARGIN = 4
# Planned size of addresses and dates from which on a cut looks for candidates first.
WORTH_NARROWING = 1 << 30


def _planned_bytes(df: DataFrame) -> int:
    """How large Spark's planner takes the rows to be."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def union_sources(parts: list[DataFrame]) -> DataFrame:
    """All articles of all sources, duplicates kept."""
    return reduce(lambda left, right: left.unionByName(right, allowMissingColumns=True), parts)


def collect_articles(
    feeds: DataFrame,
    api: DataFrame,
    listings: DataFrame,
    run_ts: datetime,
    override: int | None = None,
) -> DataFrame:
    """Articles of landed feed documents, API responses and listing pages.

    Source ranks set the arrival order: feeds, then listings, then the API.
    """
    after_feeds = len(source_rows())
    from_api = api_articles(api, category_dim(api.sparkSession), run_ts, override)
    from_listings = listing_articles(listings, run_ts, source_rank=after_feeds - 1)
    return union_sources(
        [
            feed_articles(feeds).withColumn("from_feed", F.lit(True)),
            from_listings.withColumn("from_feed", F.lit(False)),
            from_api.withColumns(
                {"source_rank": F.col("source_rank") + after_feeds, "from_feed": F.lit(False)}
            ),
        ]
    )


def digest_order(arrival: list = ARRIVAL) -> list[Column]:
    """Newest first, undated last, ties by arrival."""
    return [newest_first_key(F.col("published_ts")).desc(), *[F.col(name) for name in arrival]]


def newest_candidates(dated: DataFrame, size: int, arrival: list) -> DataFrame | None:
    """First arrivals of which ``size`` at least are as new as a date that none else reaches.

    ``dated`` has url, published_ts and the arrival columns. Some of the newest rows name the
    date; the addresses of rows from it on are the candidates, and only their rows are shuffled
    to find the first arrival of each. An address whose first arrival is older leaves. The date is put
    back until enough stay; None if the rows end before.
    """
    wanted = MARGIN * size
    while True:
        newest = dated.where(F.col("published_ts").isNotNull()).orderBy(F.desc("published_ts")).limit(wanted)
        since, found = newest.agg(F.min("published_ts"), F.count("*")).first()
        if found < wanted:
            return None
        late = F.col("published_ts") >= F.lit(since)
        candidates = materialize(dated.where(late).select("url").distinct())
        own = dated.join(broadcast_if_small(candidates), "url", "left_semi")
        first = materialize(keep_first(own, arrival).where(late))
        if first.count() >= size:
            return first
        wanted *= MARGIN


def newest_unique(
    articles: DataFrame,
    size: int | None,
    arrival: list,
    parse_rfc822: bool,
    by_candidates: bool | None = None,
) -> DataFrame:
    """The ``size`` newest of the first arrivals per address; all of them without a size.

    The choice is made on addresses and dates alone, and the chosen rows are then picked
    from a second scan: no text is sorted or shuffled for it. A cut that one task may hold
    is a distributed top N; a larger one is made by numbering a range sort. For the former a large
    table (or as ``by_candidates`` says) is first narrowed to the addresses that
    may make the cut, so that the others are not shuffled; in a small one that is not worth its jobs.
    """
    narrow = articles.select("url", "published", *arrival).where(present(F.col("url")))
    if by_candidates is None:
        by_candidates = _planned_bytes(narrow) >= WORTH_NARROWING
    unique = None
    if by_candidates and size and size <= ONE_TASK:
        dated = with_published_time(narrow, parse_rfc822)
        unique = newest_candidates(dated, size, arrival)
    if unique is None:
        unique = with_published_time(keep_first(narrow, arrival), parse_rfc822)
    if size is not None and size <= ONE_TASK:
        unique = newest_first(unique, arrival).limit(size)
    elif size is not None:
        numbered = number_rows(unique.drop("published"), digest_order(arrival), "_place")
        unique = numbered.where(F.col("_place") <= size)
    # Arrival ids of files may meet by chance, so the address is part of the key.
    chosen = materialize(unique.select("url", "published_ts", *arrival))
    return articles.join(broadcast_if_small(chosen), ["url", *arrival])


def digest(
    articles: DataFrame,
    pages: DataFrame,
    size: int | None = settings.DIGEST_SIZE,
    arrival: list = ARRIVAL,
    domains: list[str] = settings.TRUSTED_DOMAINS,
    newest_page: list | None = None,
    parse_rfc822: bool = False,
    reread: bool = False,
    by_candidates: bool | None = None,
) -> DataFrame:
    """The ``size`` newest unique articles with images filled in.

    First arrival per address, newest first, then cut, then enriched: pages are
    only looked up for rows that made the cut. Rows that had an image come
    first. Freshly parsed articles are first written to a working table, so that they
    are parsed once; ``reread`` says that ``articles`` is a stored table already. The
    arrival columns name a row.

    No size gives all unique articles, unsorted: ``had_image``, ``published_ts`` and
    the arrival columns tell their order without one more shuffle of the table.
    """
    stored = articles if reread else write_out(articles, "collected")[0]
    top = newest_unique(stored, size, arrival, parse_rfc822, by_candidates)
    enrich = enrich_images if size is None else enrich_few
    counted = count_feed_lookups(enrich(top, pages, domains, newest_page))
    return counted if size is None else with_images_first(counted, digest_order(arrival))
