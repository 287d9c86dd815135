"""Feeds, API responses, listing pages and configuration."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from newsweave.operators import statistics
from newsweave.sources import api, dims, feeds, listing

RUN_TS = datetime(2025, 1, 13, 15, 30)
RSS = (
    '<rss xmlns:media="http://search.yahoo.com/mrss/" '
    'xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel>{}</channel></rss>'
)


@pytest.fixture
def feed(spark):
    def make(*documents, cap=5, url="https://feeds.example.com/rss"):
        rows = [(url, 0, cap, place, document) for place, document in enumerate(documents)]
        return spark.createDataFrame(
            rows, "feed_url string, source_rank int, cap int, payload_id bigint, payload string"
        )

    return make


def rows(frame, *order):
    return sorted(frame.collect(), key=lambda row: [row[name] for name in order])


def items(frame):
    return rows(frame, "payload_id", "position")


def test_feed_mapping_and_defaults(feed):
    full = (
        "<item><title>Test Article</title><link>https://example.com/test</link><pubDate>2025-01-01</pubDate>"
        "<description>Test summary</description><category>a</category><category>b</category></item>"
    )
    first, second = items(feeds.feed_articles(feed(RSS.format(full + "<item><guid>g</guid></item>"))))
    assert first.asDict() | {"image": ""} == first.asDict()
    assert (first.title, first.url, first.published, first.summary) == (
        "Test Article", "https://example.com/test", "2025-01-01", "Test summary")
    assert first.source == "feeds.example.com" and first.tags == ["a", "b"]
    assert (second.title, second.url, second.published, second.summary, second.tags) == ("No Title", "g", "", "", [])


def test_feed_cap_keeps_document_order(feed):
    body = "".join(f"<item><title>{n}</title></item>" for n in "cab")
    found = items(feeds.feed_articles(feed(RSS.format(body), RSS.format(body), cap=2)))
    assert [(row.payload_id, row.position, row.title) for row in found] == [
        (0, 0, "c"), (0, 1, "a"), (1, 0, "c"), (1, 1, "a")]


def test_atom_and_rdf(feed):
    atom = (
        '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title type="html">A</title>'
        '<link rel="self" href="https://e.com/self"/><link href="https://e.com/a"/>'
        '<link rel="enclosure" type="image/png" href="https://e.com/a.png"/>'
        '<published>2025-01-01T00:00:00Z</published><category term="t"/>'
        '<content type="html">&lt;b&gt;body&lt;/b&gt;</content></entry></feed>'
    )
    rdf = (
        '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><channel/>'
        '<item><title>R</title><link>https://e.com/r</link><dc:subject xmlns:dc="d">s</dc:subject></item></rdf:RDF>'
    )
    first, second = items(feeds.feed_articles(feed(atom, rdf)))
    assert (first.title, first.url, first.image, first.summary, first.tags) == (
        "A", "https://e.com/a", "https://e.com/a.png", "<b>body</b>", ["t"])
    assert (second.title, second.url, second.tags) == ("R", "https://e.com/r", ["s"])


def test_feed_image_order(feed):
    media = '<media:content url="https://e.com/media.jpg"/>'
    group = '<media:group><media:content url="https://e.com/group.jpg"/></media:group>'
    thumb = '<media:thumbnail url="//e.com/thumb.jpg"/>'
    enclosure = '<enclosure type="image/jpeg" url="https://e.com/enclosed.jpg"/>'
    audio = '<enclosure type="audio/mpeg" url="https://e.com/sound.ogg"/>'
    image = "<image><url>https://e.com/field.jpg</url></image>"
    picture = "<picture>https://e.com/picture.jpg</picture>"
    summary = '<description>&lt;img src="//e.com/summary.jpg"&gt;</description>'
    content = '<content:encoded><![CDATA[<img src="https://e.com/content.jpg">]]></content:encoded>'
    podcast = '<itunes:image xmlns:itunes="i" href="https://e.com/podcast.jpg"/>'
    bad = '<media:content url="https://localhost/x.jpg"/>'
    expected = [
        (content + summary + picture + image + enclosure + thumb + media, "https://e.com/media.jpg"),
        (thumb + enclosure, "//e.com/thumb.jpg"),
        (audio + enclosure + image, "https://e.com/enclosed.jpg"),
        (audio + picture + image, "https://e.com/field.jpg"),
        (picture + podcast, "https://e.com/podcast.jpg"),
        (picture + summary, "https://e.com/picture.jpg"),
        (content + summary, "https://e.com/summary.jpg"),
        (bad + content, "https://e.com/content.jpg"),
        (bad + group, "https://e.com/group.jpg"),
        (audio, ""),
    ]
    documents = [RSS.format(f"<item>{body}</item>") for body, _ in expected]
    found = items(feeds.feed_articles(feed(*documents)))
    assert [row.image for row in found] == [image for _, image in expected]


def test_faulty_feeds_are_mended(feed):
    one = "<item><title>A&nbsp;B & C</title><link>https://e.com/?a=1&b=2</link></item>"
    documents = ["\n " + '<?xml version="1.0"?>' + RSS.format(one), RSS.format(one + one + "<item><title>cut")[:-16],
                 '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>A&amp;B</title></entry><entry><tit',
                 "<rdf:RDF xmlns:rdf='r'><channel/><item><title>R</title></item><item>"]
    found = items(feeds.feed_articles(feed(*documents)))
    assert [(row.payload_id, row.title) for row in found] == [
        (0, "A&nbsp;B & C"), (1, "A&nbsp;B & C"), (1, "A&nbsp;B & C"), (2, "A&B"), (3, "R")]
    assert found[0].url == "https://e.com/?a=1&b=2"
    assert all(row.faulty for row in feeds.parse_feeds(feed(*documents)).collect())


def test_feed_rejects(feed):
    found = feeds.feed_rejects(feed("<rss><channel><item>", RSS.format(""), RSS.format("<item/>"), "", None))
    assert {(row.payload_id, row.reason) for row in found.collect()} == {
        (0, "unreadable"), (1, "empty"), (3, "unreadable"), (4, "empty")}


ITEM = {
    "hash_id": "test-hash-1", "title": "Test", "content": "Content", "source_name": "Test Source",
    "source_url": "https://example.com/test", "image_url": "https://example.com/image.jpg",
    "created_at": "2025-01-01T00:00:00Z", "tags": ["test"],
}


@pytest.fixture
def response(spark):
    def make(*answers):
        texts = [(category, n, body if isinstance(body, str) else json.dumps({"data": {"news_list": body}}))
                 for n, (category, body) in enumerate(answers)]
        return spark.createDataFrame(texts, "category string, payload_id bigint, payload string")

    return make


def test_api_item(spark, response):
    (row,) = api.api_articles(response(("top_stories", [ITEM])), dims.category_dim(spark), RUN_TS).collect()
    assert (row.title, row.url, row.summary, row.source) == (
        "Test", "https://example.com/test", "Content", "inshorts.com")
    assert row.published == "2025-01-01T00:00:00+00:00"
    assert row.tags == ["test", "top_stories"]
    assert (row.inshorts_id, row.original_source) == ("test-hash-1", "Test Source")


def test_api_bad_answers_yield_nothing(spark, response):
    given = response(("a", "no json"), ("b", "{}"), ("c", [{"hash_id": "only"}]), ("d", [ITEM | {"title": ""}]),
                     ("e", '{"data": {"news_list": [{"title": '))
    assert api.api_articles(given, dims.category_dim(spark), RUN_TS).count() == 0
    items_in = api.api_items(api.with_category_cap(given, dims.category_dim(spark)))
    assert {(r.category, r.rejected) for r in api.api_rejects(items_in).collect()} == {("c", 1), ("d", 1)}


def test_api_null_tags_and_times(spark, response):
    given = response(("x", [ITEM | {"tags": None, "created_at": None}, ITEM | {"created_at": "Tuesday"}]))
    first, second = items(api.api_articles(given, dims.category_dim(spark), RUN_TS))
    assert first.tags == ["x"] and first.published == second.published == RUN_TS.isoformat()


@pytest.mark.parametrize("override,expected", [(None, {"science": 5, "unheard_of": 5, "trending": 12}),
                                               (2, {"science": 2, "unheard_of": 2, "trending": 2}),
                                               (0, {})])
def test_api_caps(spark, response, override, expected):
    many = [ITEM] * 20
    given = response(("science", many), ("unheard_of", many), ("trending", many))
    found = api.api_articles(given, dims.category_dim(spark), RUN_TS, override).withColumn(
        "category", F.element_at("tags", -1))
    assert {r.category: r["count"] for r in found.groupBy("category").count().collect()} == expected


def test_topics(spark):
    texts = ['{"data": {"topics": [{"name": "Technology"}, {"id": 1}]}}', '{"trending_topics": ["a", "b"]}', "{}", "x"]
    given = spark.createDataFrame(list(enumerate(texts)), "payload_id bigint, payload string")
    found = items(api.trending_topics(given))
    assert [(r.payload_id, r.position, r.topic) for r in found] == [
        (0, 0, "Technology"), (0, 1, ""), (1, 0, "a"), (1, 1, "b")]


def test_listing(spark):
    page = (
        '<a href="/p/one">Long enough one</a><a href="/about">Long but elsewhere</a>'
        '<a href="https://medium.com/@w/two">Long enough two</a><a href="https://x.com/p/3">Long other site</a>'
        '<div><p><a href="/p/four">Long enough four</a></p><img src="//e.com/four.jpg"></div><a href="/p/5">Short</a>'
    )
    given = spark.createDataFrame([(1, page), (2, "<p>no links</p>"), (3, None)], "page_id bigint, html string")
    found = items(listing.listing_articles(given, RUN_TS, source_rank=36, cap=2))
    assert [(r.title, r.url) for r in found] == [
        ("Long enough one", "https://medium.com/p/one"), ("Long enough two", "https://medium.com/@w/two")]
    assert {(r.published, r.summary, r.source, tuple(r.tags)) for r in found} == {
        (RUN_TS.isoformat(), "", "medium.com", ("trending",))}
    everything = items(listing.listing_articles(given, RUN_TS, source_rank=36, cap=None))
    assert everything[2].image == "https://e.com/four.jpg"


def test_configuration(spark):
    sources = dims.source_dim(spark)
    assert {r.kind: (r["count"], r.cap) for r in sources.groupBy("kind", "cap").count().collect()} == {
        "news_feed": (24, 3), "publication_feed": (12, 2), "listing": (1, 5)}
    (capacity,) = statistics.category_capacity(dims.category_dim(spark)).collect()
    assert (capacity.categories, capacity.max_articles) == (10, 78)
    first = statistics.categories_by_priority(dims.category_dim(spark)).collect()
    assert [r.category for r in first] == ["top_stories", "trending", "business", "technology", "world"]
