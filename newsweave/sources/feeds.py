"""Feed documents (RSS, Atom, RDF) to articles.

One landed row holds one whole feed document, so taking its first entries is a
``slice`` before the explode: the job is a map over payloads with no shuffle,
and a source with very many payloads is spread like any other rows.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsweave.functions.html import first_image
from newsweave.functions.text import first_of, let, or_blank, present, strip
from newsweave.functions.urls import first_valid_image, source_host
from newsweave.schema import ARRIVAL_FIELDS, ARTICLE_FIELDS, conform

# Element names that may carry an image, in the order tried.
IMAGE_ELEMENTS = ["image", "featured_image", "thumbnail", "img", "picture"]

_NAMED = "struct<_VALUE: string, _href: string, href: string, url: string>"
_MEDIA = "array<struct<_url: string>>"
_ENTRY = ", ".join(
    [
        "title: string",
        "link: array<struct<_VALUE: string, _href: string, _rel: string, _type: string>>",
        "guid: struct<_VALUE: string, _isPermaLink: string>",
        "pubDate: string",
        "published: string",
        "description: string",
        "summary: string",
        "content: array<string>",
        "`content:encoded`: array<string>",
        "category: array<struct<_VALUE: string, _term: string>>",
        "`dc:subject`: array<string>",
        "enclosure: array<struct<_url: string, _type: string>>",
        "`itunes:image`: struct<_href: string>",
        f"`media:content`: {_MEDIA}",
        f"`media:thumbnail`: {_MEDIA}",
        f"`media:group`: array<struct<`media:content`: {_MEDIA}, `media:thumbnail`: {_MEDIA}>>",
        *[f"{name}: {_NAMED}" for name in IMAGE_ELEMENTS],
    ]
)
_ENTRIES = f"array<struct<{_ENTRY}>>"
FEED_SCHEMA = (
    f"channel struct<item: {_ENTRIES}>, item {_ENTRIES}, entry {_ENTRIES}, _unreadable string"
)


def _all(array: Column) -> Column:
    """The array itself, or an empty one in place of null."""
    return F.coalesce(array, F.array())


def _media(entry: Column, name: str) -> Column:
    direct = F.transform(entry[name], lambda media: media["_url"])
    grouped = F.flatten(
        F.transform(
            entry["media:group"],
            lambda group: _all(F.transform(group[name], lambda media: media["_url"])),
        )
    )
    return F.concat(_all(direct), _all(grouped))


def _named_image(element: Column) -> Column:
    """Address of an image element: its text, else its ``href`` or ``url``."""
    return F.when(present(strip(element["_VALUE"])), element["_VALUE"]).otherwise(
        F.coalesce(element["_href"], element["href"], element["url"])
    )


# Where a feed that breaks off can be cut, and how it is closed again.
LAST_ENTRY = r"(?s)^(.*</(?:item|entry)\s*>).*$"
ROOT = r"<(rss|feed|rdf:RDF)\b"
STRAY_AMPERSAND = r"&(?!(?:amp|lt|gt|quot|apos|#[0-9]+|#[xX][0-9A-Fa-f]+);)"


def _mended(payload: Column) -> Column:
    """A feed document with the usual faults put right: space before the
    declaration, unescaped or undefined references, and a missing end."""

    def close(text: Column) -> Column:
        root = F.regexp_extract(text, ROOT, 1)
        end = F.concat(F.lit("</"), root, F.lit(">"))
        inner = F.when(root == "rss", "</channel>").otherwise("")
        cut = F.concat(F.regexp_replace(text, LAST_ENTRY, "$1"), inner, end)
        return F.when(F.endswith(text, end), text).otherwise(cut)

    return let(F.regexp_replace(strip(payload), STRAY_AMPERSAND, "&amp;"), close)


def _read(payload: Column) -> Column:
    return F.from_xml(payload, FEED_SCHEMA, {"columnNameOfCorruptRecord": "_unreadable"})


def parse_feeds(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Add ``entries`` (all entries of the document, in order), ``faulty`` and
    ``unreadable``.

    A faulty document is mended and read once more; only what even then cannot
    be read yields nothing.
    """
    kept = [name for name in payloads.columns if name != payload]
    first = payloads.select(*kept, payload, _read(F.col(payload)).alias("_feed"))
    faulty = F.col("_feed._unreadable").isNotNull()
    read = first.select(
        *kept,
        faulty.alias("faulty"),
        F.when(faulty, _read(_mended(F.col(payload)))).otherwise(F.col("_feed")).alias("_feed"),
    )
    return read.select(
        *kept,
        _all(F.coalesce("_feed.channel.item", "_feed.item", "_feed.entry")).alias("entries"),
        "faulty",
        F.col("_feed._unreadable").isNotNull().alias("unreadable"),
    )


def entry_record(entry: Column) -> Column:
    """A feed entry in the common vocabulary: one struct for all feed formats."""
    web_links = F.filter(
        entry["link"], lambda link: F.coalesce(link["_rel"], F.lit("alternate")) == "alternate"
    )
    linked = first_of(
        F.transform(web_links, lambda link: strip(F.coalesce(link["_href"], link["_VALUE"])))
    )
    permanent = F.when(
        F.coalesce(entry["guid"]["_isPermaLink"], F.lit("true")) == "true",
        entry["guid"]["_VALUE"],
    )
    contents = F.concat(
        _all(entry["content"]),
        _all(entry["content:encoded"]),
    )
    attached = F.concat(
        _all(
            F.transform(
                entry["enclosure"],
                lambda file: F.struct(
                    file["_type"].alias("type"), file["_url"].alias("href")
                ),
            )
        ),
        _all(
            F.transform(
                entry["link"],
                lambda link: F.struct(
                    link["_type"].alias("type"), link["_href"].alias("href")
                ),
            )
        ),
    )
    return F.struct(
        entry["title"].alias("title"),
        F.coalesce(linked, permanent).alias("link"),
        F.coalesce(entry["pubDate"], entry["published"]).alias("published"),
        F.coalesce(entry["description"], entry["summary"], first_of(contents)).alias("summary"),
        entry["description"].alias("description"),
        contents.alias("contents"),
        F.concat(
            _all(
                F.transform(
                    entry["category"], lambda tag: F.coalesce(tag["_term"], tag["_VALUE"])
                )
            ),
            _all(entry["dc:subject"]),
        ).alias("tags"),
        _media(entry, "media:content").alias("media_content"),
        _media(entry, "media:thumbnail").alias("media_thumbnail"),
        attached.alias("attached"),
        F.array(
            *[_named_image(entry[name]) for name in IMAGE_ELEMENTS[:1]],
            entry["itunes:image"]["_href"],
            *[_named_image(entry[name]) for name in IMAGE_ELEMENTS[1:]],
        ).alias("image_fields"),
    )


def entry_image(record: Column) -> Column:
    """First acceptable image of an entry, or ''.

    Attached media come first, as written; images inside the entry's HTML
    come last, normalised. ``coalesce`` stops at the first hit, so the HTML is
    only searched when nothing is attached.
    """
    attached_images = F.transform(
        F.filter(record["attached"], lambda file: file["type"].startswith("image/")),
        lambda file: file["href"],
    )
    inside = F.concat(
        F.array(record["summary"]), record["contents"], F.array(record["description"])
    )
    found_inside = first_of(
        F.filter(F.transform(inside, first_image), lambda image: image != "")
    )
    return F.coalesce(
        first_valid_image(record["media_content"]),
        first_valid_image(record["media_thumbnail"]),
        first_valid_image(attached_images),
        first_valid_image(record["image_fields"]),
        found_inside,
        F.lit(""),
    )


def with_source(payloads: DataFrame, sources: DataFrame) -> DataFrame:
    """Add ``feed_url, cap, source_rank`` of the configured source ``name``.

    Payloads of a source that is not configured are left out; ``unconfigured_feeds``
    lists them.
    """
    configured = sources.select("name", F.col("url").alias("feed_url"), "cap", "source_rank")
    return payloads.join(F.broadcast(configured), "name")


def unconfigured_feeds(payloads: DataFrame, sources: DataFrame) -> DataFrame:
    """Payloads filed under a name that no source has: name, payload_id and reason."""
    known = F.broadcast(sources.select("name"))
    return payloads.join(known, "name", "left_anti").select(
        "name", "payload_id", F.lit("unconfigured").alias("reason")
    )


def feed_articles(payloads: DataFrame) -> DataFrame:
    """Articles of landed feed documents.

    ``payloads`` has ``feed_url, source_rank, cap, payload_id, payload``; each
    document contributes its first ``cap`` entries.
    """
    entries = parse_feeds(payloads).select(
        "feed_url",
        "source_rank",
        "payload_id",
        F.posexplode(F.slice("entries", 1, F.col("cap"))).alias("position", "entry"),
    )
    records = entries.withColumn("record", entry_record(F.col("entry"))).drop("entry")
    record = F.col("record")
    articles = records.select(
        F.coalesce(record["title"], F.lit("No Title")).alias("title"),
        or_blank(record["link"]).alias("url"),
        or_blank(record["published"]).alias("published"),
        or_blank(record["summary"]).alias("summary"),
        source_host(F.col("feed_url")).alias("source"),
        record["tags"].alias("tags"),
        entry_image(record).alias("image"),
        "source_rank",
        "payload_id",
        "position",
    )
    return conform(articles, {**ARTICLE_FIELDS, **ARRIVAL_FIELDS})


def feed_rejects(payloads: DataFrame) -> DataFrame:
    """Documents that yielded no entries, with the reason."""
    return (
        parse_feeds(payloads)
        .where(F.size("entries") == 0)
        .select(
            "feed_url",
            "payload_id",
            F.when(F.col("unreadable"), "unreadable").otherwise("empty").alias("reason"),
        )
    )
