"""Article links of landed listing pages."""

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsweave import settings
from newsweave.functions.anchors import images_near, links
from newsweave.functions.text import or_blank
from newsweave.functions.urls import absolutize_href, first_valid_image, normalize_image_url
from newsweave.schema import ARRIVAL_FIELDS, ARTICLE_FIELDS, conform

# How an article link is told from other links.
ARTICLE_LINK_PARTS = ["/p/", "/@"]
MIN_TITLE_CHARS = 11


def _article_link(text: Column) -> Column:
    first, second = ARTICLE_LINK_PARTS
    return text.contains(first) | text.contains(second)


def harvest_links(pages: DataFrame, base: str, cap: int | None = None) -> DataFrame:
    """On-site article links of pages ``page_id, html``: the first ``cap`` of each.

    Pages without any such link are dropped before the parser sees them, and
    the cap is a slice of the page's own links: no shuffle. Images are looked for
    around the links that are kept, and no others.
    """
    kept = F.filter(
        F.col("found.links"),
        lambda link: _article_link(link["href"])
        & absolutize_href(link["href"], base).isNotNull()
        & (link["end"] - link["start"] >= MIN_TITLE_CHARS),
    )
    if cap is not None:
        kept = F.slice(kept, 1, cap)
    chosen = (
        pages.where(_article_link(F.col("html")))
        .select("page_id", "html", links(F.col("html")).alias("found"))
        .select("page_id", "html", F.col("found.text").alias("text"), kept.alias("kept"))
        .where(F.size("kept") > 0)
    )
    near = images_near(F.col("html"), F.transform("kept", lambda link: link["at"]))
    found = chosen.select("page_id", "text", "kept", near.alias("near")).select(
        "page_id", "text", F.posexplode(F.arrays_zip("kept", "near")).alias("position", "link")
    )
    start, end = F.col("link.kept.start"), F.col("link.kept.end")
    return found.select(
        "page_id",
        "position",
        F.substring("text", start + 1, end - start).alias("title"),
        absolutize_href(F.col("link.kept.href"), base).alias("url"),
        or_blank(normalize_image_url(first_valid_image(F.col("link.near")))).alias("image"),
    )


def listing_rejects(pages: DataFrame, base: str = settings.LISTING_BASE) -> DataFrame:
    """Pages that gave no article: page_id and reason."""
    given = harvest_links(pages, base, 1).select("page_id").distinct()
    return pages.select("page_id").join(given, "page_id", "left_anti").select(
        "page_id", F.lit("no links").alias("reason")
    )


def listing_articles(
    pages: DataFrame,
    run_ts: datetime,
    source_rank: int,
    base: str = settings.LISTING_BASE,
    cap: int | None = settings.LISTING_CAP,
) -> DataFrame:
    """Articles of listing pages; the run's time stands in for a publication date."""
    articles = harvest_links(pages, base, cap).select(
        "title",
        "url",
        F.lit(run_ts.isoformat()).alias("published"),
        F.lit("").alias("summary"),
        F.lit(settings.LISTING_SOURCE).alias("source"),
        F.array(F.lit(settings.LISTING_TAG)).alias("tags"),
        "image",
        F.lit(source_rank).alias("source_rank"),
        F.col("page_id").alias("payload_id"),
        "position",
    )
    return conform(articles, {**ARTICLE_FIELDS, **ARRIVAL_FIELDS})
