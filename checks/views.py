"""Input tables of the checks, derived by Spark from the driver's tables.

Documents, events and pages become articles, page metadata, and landed feed, API,
listing and topic payloads. Everything grows with the given tables; payloads
hold a bounded number of items each.
"""

from datetime import datetime
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = datetime(2024, 1, 31)
RUN_TS = datetime(2024, 1, 31, 12)
SPLIT = datetime(2024, 1, 16)
RETENTION_DAYS = 14
OLD_DAYS = 20
CAP = 3
DOMAINS = ["example.net", "example.org"]
CATEGORIES = (
    "top_stories trending business technology world sports entertainment science automobile "
    "politics local"
).split()

ARTICLE_COLUMNS = """
select d.doc_id as ord, substr(d.text, 1, 60) as title,
  case when d.doc_id % 23 = 0 then '' when d.doc_id % 5 = 0 then p.url
       else concat('https://', d.source, '.example.com/a/', cast(d.doc_id % 149 as string)) end as url,
  case d.doc_id % 6
    when 0 then concat(substr(cast(e.ts as string), 1, 10), 'T', substr(cast(e.ts as string), 12, 8), 'Z')
    when 1 then concat(substr(cast(e.ts as string), 1, 10), 'T', substr(cast(e.ts as string), 12, 8), '+05:30')
    when 2 then substr(cast(e.ts as string), 1, 10)
    when 3 then '' when 4 then 'not a date'
    else concat(substr(cast(e.ts as string), 1, 10), 'T', substr(cast(e.ts as string), 12, 8)) end as published,
  d.text as summary, concat(d.source, '.example.com') as source, {array_open}d.lang, d.source{array_close} as tags,
  case when d.doc_id % 3 = 0 then '' when d.doc_id % 11 = 0 then 'https://localhost/x.png'
       when d.doc_id % 13 = 0 then '//cdn.example.com/i.png'
       when d.doc_id % 17 = 0 then 'https://cdn.example.com/f.PDF'
       else concat('https://cdn.example.com/', cast(d.doc_id as string), '.jpg') end as image,
  e.ts as scraped_at
"""

ARTICLES = ARTICLE_COLUMNS.rstrip() + """
from (select *, (doc_id * 37) % (select count(*) from {events}) as ev_id,
             doc_id % (select count(*) from {pages}) as pg_id from {documents}) d
join {events} e on e.event_id = d.ev_id
join {pages} p on p.page_id = d.pg_id
"""

PAGES_META = """
select page_id, url, concat('<html><head>', case page_id % 4
    when 0 then concat('<meta property="og:image" content="https://cdn.example.com/og/', cast(page_id as string), '.jpg">')
    when 1 then concat('<meta name="twitter:image" content="//cdn.example.com/tw/', cast(page_id as string), '.jpg">')
    when 2 then concat('<meta property="og:image" content="https://cdn.example.com/x.pdf">',
                       '<meta name="featured-image" content="https://cdn.example.com/ft/', cast(page_id as string), '.jpg">')
    else '' end, '</head></html>') as html
from {pages}
"""


@cache
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# The same rows for Spark: an article's event and page follow from its number alone, so numbers meet
# them, and the text travels once, to its number; the title is cut before it does.
ARTICLES_BY_NUMBER = (
    ARTICLE_COLUMNS.replace("substr(d.text, 1, 60)", "d.title").replace("e.ts", "m.ts").replace("p.url", "m.url").rstrip()
    + """
from (select doc_id, text, lang, source, substr(text, 1, 60) as title from {documents}) d
join (select n.doc_id, e.ts, p.url
      from (select doc_id, (doc_id * 37) % (select count(*) from {events}) as ev_id,
                   doc_id % (select count(*) from {pages}) as pg_id
            from (select distinct doc_id from {documents})) n
      join {events} e on e.event_id = n.ev_id
      join {pages} p on p.page_id = n.pg_id) m on m.doc_id = d.doc_id
"""
)


@cache
def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(
        ARTICLES_BY_NUMBER.replace("{array_open}", "array(").replace("{array_close}", ")"),
        events=table(spark, sf_dir, "events"),
        pages=table(spark, sf_dir, "pages"),
        documents=table(spark, sf_dir, "documents"),
    )


def pages_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(PAGES_META, pages=table(spark, sf_dir, "pages"))


def _escaped(text: Column) -> Column:
    for plain, written in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def _tag(name: str, body: Column) -> Column:
    return F.concat(F.lit(f"<{name}>"), body, F.lit(f"</{name}>"))


def _pick(number: Column, cases: dict[int, Column], otherwise: str = "") -> Column:
    chosen = F.lit(otherwise)
    for value, result in cases.items():
        chosen = F.when(number == value, result).otherwise(chosen)
    return chosen


def _img(attributes: str, image: Column, tail: str = "") -> Column:
    return F.concat(F.lit(f'<p><img alt="a>b" {attributes}="'), image, F.lit(f'{tail}"></p>'))


def feed_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One feed document per source and hundred documents: RSS, Atom or RDF in
    turn, some not well formed. Where an item carries its image varies with ``ord``."""
    a = articles(spark, sf_dir)
    chunk = F.floor(F.col("ord") / 100).cast("bigint")
    number = F.regexp_extract("source", r"^src(\d+)\.", 1).cast("bigint")
    a = a.withColumns({"payload_id": chunk * 1000 + number, "source_rank": number.cast("int")})
    kind, place = F.col("payload_id") % 3, F.col("ord") % 9
    image, atom = F.col("image"), F.col("payload_id") % 3 == 1
    written = _escaped(image)
    media = _pick(
        place,
        {
            0: F.concat(F.lit('<media:content medium="image" url="'), written, F.lit('"/>')),
            1: F.concat(F.lit('<media:thumbnail url="'), written, F.lit('"/>')),
            2: F.when(
                atom,
                F.concat(F.lit('<link rel="enclosure" type="image/jpeg" href="'), written, F.lit('"/>')),
            ).otherwise(
                F.concat(F.lit('<enclosure type="image/jpeg" length="1" url="'), written, F.lit('"/>'))
            ),
            3: F.when(
                atom,
                F.lit('<link rel="enclosure" type="audio/mpeg" href="https://cdn.example.com/a.ogg"/>'),
            ).otherwise(
                F.lit('<enclosure type="audio/mpeg" length="1" url="https://cdn.example.com/a.ogg"/>')
            ),
            4: _tag("image", _tag("url", written)),
            5: _tag("featured_image", written),
        },
    )
    summary = F.concat(
        F.col("summary"),
        _pick(place, {3: _img("src", image), 6: _img("data-src", image)}),
    )
    content = F.when(place == 7, _img("srcset", image, " 1x, https://cdn.example.com/big.jpg 2x"))
    tags = F.array_join(
        F.transform(
            "tags",
            lambda tag: F.when(
                atom, F.concat(F.lit('<category term="'), _escaped(tag), F.lit('"/>'))
            ).otherwise(_tag("category", _escaped(tag))),
        ),
        "",
    )
    title = F.when(F.col("ord") % 29 == 0, "").otherwise(_tag("title", _escaped(F.col("title"))))
    link = (
        F.when(
            atom, F.concat(F.lit('<link rel="alternate" href="'), _escaped(F.col("url")), F.lit('"/>'))
        )
        .when(F.col("ord") % 31 == 0, _tag("guid", _escaped(F.col("url"))))
        .otherwise(_tag("link", _escaped(F.col("url"))))
    )
    body = F.concat(
        title,
        link,
        F.when(atom, _tag("published", F.col("published"))).otherwise(
            _tag("pubDate", F.col("published"))
        ),
        F.when(atom, _tag("summary", _escaped(summary))).otherwise(
            _tag("description", _escaped(summary))
        ),
        F.coalesce(
            F.when(atom, _tag("content", _escaped(content))).otherwise(
                F.concat(F.lit("<content:encoded><![CDATA["), content, F.lit("]]></content:encoded>"))
            ),
            F.lit(""),
        ),
        tags,
        media,
    )
    item = F.when(atom, _tag("entry", body)).otherwise(_tag("item", body))
    spaces = (
        'xmlns:media="http://search.yahoo.com/mrss/" '
        'xmlns:content="http://purl.org/rss/1.0/modules/content/"'
    )
    items = F.col("items")
    document = (
        F.when(
            kind == 0,
            F.concat(F.lit(f'<rss version="2.0" {spaces}><channel><title>f</title>'), items, F.lit("</channel></rss>")),
        )
        .when(kind == 1, F.concat(F.lit(f'<feed xmlns="http://www.w3.org/2005/Atom" {spaces}>'), items, F.lit("</feed>")))
        .otherwise(
            F.concat(
                F.lit(f'<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" {spaces}><channel><title>f</title></channel>'),
                items,
                F.lit("</rdf:RDF>"),
            )
        )
    )
    broken = F.col("payload_id") % 7 == 3
    return (
        a.select("payload_id", "source_rank", "source", "ord", item.alias("item"))
        .groupBy("payload_id", "source_rank", "source")
        .agg(F.array_sort(F.collect_list(F.struct("ord", "item"))).alias("sorted"))
        .withColumn("items", F.array_join("sorted.item", ""))
        .select(
            F.concat(F.lit("https://"), "source", F.lit("/feed/"), F.col("payload_id").cast("string")).alias("feed_url"),
            "source_rank",
            F.when(F.col("payload_id") % 2 == 0, 3).otherwise(2).alias("cap"),
            "payload_id",
            F.when(broken, F.concat(F.lit("<broken>"), document)).otherwise(document).alias("payload"),
        )
    )


def api_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One response per category and 200 documents, some not JSON."""
    a = articles(spark, sf_dir)
    names = F.array(*[F.lit(name) for name in CATEGORIES])
    place = (F.col("ord") % len(CATEGORIES)).cast("int")
    item = F.struct(
        "ord",
        F.concat(F.lit("h"), F.col("ord").cast("string")).alias("hash_id"),
        F.when(F.col("ord") % 19 == 0, "").otherwise(F.col("title")).alias("title"),
        F.col("summary").alias("content"),
        F.col("source").alias("source_name"),
        F.col("url").alias("source_url"),
        F.col("image").alias("image_url"),
        F.when(F.col("ord") % 13 == 0, "Tomorrow").otherwise(F.col("published")).alias("created_at"),
        F.when(F.col("ord") % 9 != 0, F.col("tags")).alias("tags"),
    )
    whole = F.to_json(F.struct(F.struct(F.col("news_list")).alias("data")))
    return (
        a.select(
            names[place].alias("category"),
            (F.floor(F.col("ord") / 200).cast("bigint") * 100 + place).alias("payload_id"),
            item.alias("item"),
        )
        .groupBy("category", "payload_id")
        .agg(F.array_sort(F.collect_list("item")).alias("news_list"))
        .select(
            "category",
            "payload_id",
            F.when(F.col("payload_id") % 13 == 5, F.concat(F.lit("<html>"), whole))
            .otherwise(whole)
            .alias("payload"),
        )
    )


def topic_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One response per ten documents, in the two shapes or with neither."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    chunk = F.floor(F.col("doc_id") / 10).cast("bigint")
    topic = F.struct(
        "doc_id",
        F.when(F.col("doc_id") % 8 != 0, F.concat_ws("-", "lang", "source")).alias("name"),
    )
    topics = F.col("topics")
    return (
        d.select(chunk.alias("payload_id"), topic.alias("topic"))
        .groupBy("payload_id")
        .agg(F.array_sort(F.collect_list("topic")).alias("topics"))
        .select(
            "payload_id",
            F.when(F.col("payload_id") % 7 == 6, "{}")
            .when(F.col("payload_id") % 2 == 0, F.to_json(F.struct(F.struct(topics).alias("data"))))
            .otherwise(
                F.to_json(F.struct(F.transform(topics, lambda t: F.coalesce(t["name"], F.lit(""))).alias("trending_topics")))
            )
            .alias("payload"),
        )
    )


# Sections added to each listing page: {n} is the page number.
GALLERY = [
    '<div><p><a href="/p/{n}-0">Story zero of page {n}</a><img src="https://cdn.example.com/l/{n}-0.jpg"></p></div>',
    '<div><img data-src="//cdn.example.com/l/{n}-1.jpg"><p><a href="/@w/{n}-1">Story one of page {n}</a></p></div>',
    "<div><span style=\"background-image: url('https://cdn.example.com/l/{n}-2.jpg')\"></span>"
    '<p><a href="https://medium.com/p/{n}-2">Story two of page {n}</a></p></div>',
    '<div><picture><source srcset="https://cdn.example.com/l/{n}-3.jpg 1x, y 2x"></picture>'
    '<p><a href="/p/{n}-3"><b>Story three</b> <i>of page {n}</i></a></p></div>',
    '<div><p><a href="https://other.example/p/{n}-4">Story elsewhere of page {n}</a></p></div>',
    '<div><p><a href="/p/{n}-5">Short one</a></p></div>',
    '<div><img src="https://cdn.example.com/l/{n}-6.jpg">'
    '<p><a href="/p/{n}-6">Story six of page {n}</a><img src="https://cdn.example.com/x.pdf"></p></div>',
]


def listing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose site links lead to articles, with a gallery of links added."""
    p = table(spark, sf_dir, "pages")
    lead = _pick(
        F.col("page_id") % 3, {0: F.lit('href="/p/'), 1: F.lit('href="/@')}, 'href="https://elsewhere.example/p/'
    )
    gallery = F.replace(
        F.lit("<section>" + "".join(GALLERY) + "</section>"), F.lit("{n}"), F.col("page_id").cast("string")
    )
    return p.select(
        "page_id", "url", F.concat(F.replace(F.col("html"), F.lit('href="/'), lead), gallery).alias("html")
    )


def image_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HTML around each document's text, with images in several guises."""
    d = table(spark, sf_dir, "documents")
    n = F.col("doc_id").cast("string")
    address = F.concat(F.lit("https://cdn.example.com/d/"), n, F.lit(".jpg"))
    tail = _pick(
        F.col("doc_id") % 7,
        {
            0: F.concat(F.lit('<IMG SRC="'), address, F.lit('">')),
            1: F.concat(F.lit("<!-- <img src='https://cdn.example.com/hidden.jpg'> --><img data-src='//cdn.example.com/d/"), n, F.lit(".png'>")),
            2: F.concat(F.lit('<img src="/local.png" srcset=" '), address, F.lit(' 1x, https://cdn.example.com/b.jpg 2x">')),
            3: F.concat(F.lit('<img src="https://cdn.example.com/x.zip"><img src='), address, F.lit("?a=1&amp;b=&#50;>")),
            4: F.lit('<script>var s = "<img src=\'https://cdn.example.com/s.jpg\'>";</script>'),
            5: F.concat(F.lit('<img alt="src=https://cdn.example.com/alt.jpg > x" src="'), address, F.lit('">')),
        },
    )
    return d.select("doc_id", F.concat(F.lit("<div><p>"), "text", F.lit("</p>"), tail, F.lit("</div>")).alias("html"))
