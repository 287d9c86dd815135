"""Scalar expressions against known values and plain Python."""

import random
import time
from datetime import datetime, timezone
from html import unescape as plain_unescape
from html.parser import HTMLParser

import pytest

from newsweave.functions import dates, html, text, urls
from newsweave.functions.anchors import link_images, page_anchors, page_links

RUN_TS = datetime(2025, 1, 13, 15, 30, 0, 250000)


def test_valid_image_url_prefixes(evaluate):
    rest = "pics.test/cat"
    given = [prefix + rest for prefix in ("https://", "http://", "//", "/", "", "ftp://", "HTTPS://", "data:")]
    assert evaluate(urls.is_valid_image_url, given) == [True] * 3 + [False] * 5


def test_valid_image_url_endings(evaluate):
    for ending in ("pdf", "doc", "docx", "zip", "mp4", "avi", "mp3"):
        shown = [f"https://pics.test/{name}" for name in
                 (f"a.{ending}", f"a.{ending.upper()}", f"a.{ending} \n", f"a.{ending}?w=9", f"a.{ending}z", f"a{ending}")]
        assert evaluate(urls.is_valid_image_url, shown) == [False] * 3 + [True] * 3


def test_valid_image_url_forbidden_parts(evaluate):
    for part in ("localhost", "LocalHost", "127.0.0.1"):
        given = [f"https://{part}/cat", f"//pics.test/{part}", f"https://pics.test/?of={part}&w=1"]
        assert evaluate(urls.is_valid_image_url, given) == [False] * 3
    assert evaluate(urls.is_valid_image_url, ["https://local.host/", "https://127.0.0.2/"]) == [True] * 2


def test_valid_image_url_lengths(evaluate):
    assert evaluate(urls.is_valid_image_url, ["//" + "c" * n for n in (0, 6, 7, 8, 9)]) == [False] * 3 + [True] * 2
    assert evaluate(urls.is_valid_image_url, ["  //ccccccc\t", " \n//cccccccc ", "", " ", None]) == [False, True, False, False, False]


def test_valid_image_url_by_brute_force(evaluate):
    pieces = ["http://", "https://", "//", "/", ".pdf", ".Zip", ".doc", ".docx", "localhost", "127.0.0.1",
              "a", "é", " ", "\n", "x.jpg", "LOCALHOST", ".mp3", "?", "127x0.0.1"]
    rng = random.Random(1)
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 5))) for _ in range(3000)]

    def expected(given):
        trimmed = given.strip()
        folded = trimmed.lower()
        return (
            trimmed.startswith(tuple(urls.IMAGE_PREFIXES))
            and not folded.endswith(tuple(urls.NOT_IMAGE_ENDINGS))
            and all(part not in folded for part in urls.NOT_IMAGE_PARTS)
            and len(trimmed) >= 10
        )

    wanted = [expected(given) for given in texts]
    assert evaluate(urls.is_valid_image_url, texts) == wanted
    assert any(wanted) and not all(wanted)


def test_normalize_image_url(evaluate):
    given = [" //cdn.example.com/a.jpg ", "/relative.jpg", "https://example.com/a", "", None]
    wanted = ["https://cdn.example.com/a.jpg", "", "https://example.com/a", "", ""]
    assert evaluate(urls.normalize_image_url, given) == wanted


def test_strip_equals_python(evaluate):
    given = ["  a b \xa0", "\x1c\x85x　", "plain", "\t\n"]
    assert evaluate(text.strip, given) == [one.strip() for one in given]


def test_srcset_first(evaluate):
    given = [" https://e.com/a.jpg 1x, https://e.com/b.jpg 2x", "https://e.com/a.jpg", "", ",b"]
    assert evaluate(urls.srcset_first, given) == ["https://e.com/a.jpg", "https://e.com/a.jpg", "", ""]


def test_source_host(evaluate):
    given = ["https://user@feeds.example.com:80/rss?x#y", "//h/p", "http://a b/c", "no url", "", None]
    assert evaluate(urls.source_host, given) == ["user@feeds.example.com:80", "h", "a b", "", "", ""]


def test_absolutize_href(evaluate):
    given = ["/p/1", "https://site.example/p/2", "https://else.example/p/3", "p/4"]
    wanted = ["https://site.example/p/1", "https://site.example/p/2", None, None]
    assert evaluate(lambda c: urls.absolutize_href(c, "https://site.example"), given) == wanted


def test_page_guard(evaluate):
    given = ["https://www.BBC.com/x", "https://else.example/?q=bbc.com", "ftp://bbc.com/x",
             "https://bbc.com/" + "x" * 200, "https://else.example/", "https://bbcXcom/", None]
    result = evaluate(lambda c: urls.may_have_page_image(c, ["bbc.com"], 200), given)
    assert [bool(one) for one in result] == [True, True, False, False, False, False, False]


def test_preview(evaluate):
    given = ["a" * 150, "b" * 151, "", None]
    assert evaluate(lambda c: text.preview(c, 150), given) == ["a" * 150, "b" * 150 + "...", "", ""]


DATES = [
    "2025-01-13T12:00:00Z", "2025-01-13T12:00:00+05:30", "2025-01-13T12:00:00-0800", "2025-01-13",
    "2025-01-13 12:00", "2025-01-13T12", "2025-01-13T12:00:00.5", "2025-01-13T12:00:00,123456789",
    "2025-01-13T12:00:00GMT", "2025-01-13T12:00:00UTC", "2025-01-13T12:00:00 UTC", "2025-01-13x12:00",
    "2025-01-13T12:00:00+23:59", "2025-01-13T12:00:00+05:30:10", "2025-01-13T12:00:00+24:00",
    "2025-02-30", "2025-01-13T24:00:00", "2025-01-13T12:60:00", "2025-01-13T12:00:00.", "2025-01-13T",
    "0000-01-01", "0001-01-01", "9999-12-31T23:59:59Z", "not a date", "", "2025", "2025-01", "2025-1-3",
    "T12:30", "12:30", "Mon, 13 Jan 2025 12:00:00 GMT", "2025-01-13\x0112\x01\x01\x01\x01\x01\x01\x01",
]


def _python_time(published):
    spelled = published.replace("Z", "+00:00").replace("GMT", "+00:00").replace("UTC", "+00:00")
    try:
        parsed = datetime.fromisoformat(spelled)
    except ValueError:
        return None
    if parsed.tzinfo is None:
        return parsed
    return parsed.astimezone(timezone.utc).replace(tzinfo=None)


def test_published_time_equals_python(evaluate):
    assert evaluate(dates.published_time, DATES) == [_python_time(given) for given in DATES]


def test_published_time_rfc822_is_an_option(evaluate):
    given = ["Mon, 13 Jan 2025 12:00:00 GMT", "3 Feb 2025 04:05 +0530", "Mon, 13 Foo 2025 12:00:00 GMT"]
    assert evaluate(dates.published_time, given) == [None, None, None]
    parsed = evaluate(lambda c: dates.published_time(c, parse_rfc822=True), given)
    assert parsed == [datetime(2025, 1, 13, 12), datetime(2025, 2, 2, 22, 35), None]


def test_normalize_published(evaluate):
    given = ["2025-01-13T12:00Z", "2025-01-13T12:00:00.5+0530", "2025-01-13", "yesterday", "Tomorrow", "", None,
             "2025-01-13T12:00:00-05:00:30"]
    now = RUN_TS.isoformat()
    wanted = ["2025-01-13T12:00:00+00:00", "2025-01-13T12:00:00.500000+05:30", "2025-01-13", "yesterday",
              now, now, now, "2025-01-13T12:00:00-05:00:30"]
    assert evaluate(lambda c: dates.normalize_published(c, RUN_TS), given) == wanted


def test_first_image_known_values(evaluate):
    given = [
        '<p>Some text</p><img src="https://example.com/test.jpg" alt="test"><p>More text</p>',
        "<p>Some text without images</p>",
        "<img src='/local.png' data-src='//cdn.example.com/a.png'>",
        '<img srcset=" https://example.com/a.jpg 1x, https://example.com/b.jpg 2x">',
        '<!-- <img src="https://example.com/no.jpg"> --><IMG SRC=https://example.com/yes.jpg>',
        '<img alt="src=\'https://example.com/no.jpg\'" src="https://example.com/a.jpg?x=1&amp;y=&#x32;">',
        '<div title="<img src=https://example.com/no.jpg>"></div>',
        "<script>'<img src=\"https://example.com/no.jpg\">'</script>",
        None,
        "",
    ]
    wanted = [
        "https://example.com/test.jpg", "", "https://cdn.example.com/a.png", "https://example.com/a.jpg",
        "https://example.com/yes.jpg", "https://example.com/a.jpg?x=1&y=2", "", "", "", "",
    ]
    assert evaluate(html.first_image, given) == wanted


class _Images(HTMLParser):
    def __init__(self, source):
        super().__init__()
        self.found = []
        self.feed(source)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag == "img":
            self.found.append(dict(attrs))


def test_first_image_equals_stdlib_parser(evaluate):
    rng = random.Random(2)
    values = ["https://e.com/{n}.jpg", "//e.com/long/{n}.png", "/x.png", "https://e.com/{n}.pdf",
              "https://e.com/{n}?a=1&amp;b=2", "", "https://e.com/{n}.jpg 1x, https://e.com/b 2x"]

    def attribute():
        name = rng.choice(["src", "data-src", "SRCSET", "alt", "class"])
        value = rng.choice(values).format(n=rng.randint(100, 999))
        return f"{name}={rng.choice(['%s', chr(34) + '%s' + chr(34), chr(39) + '%s' + chr(39)])}" % (
            value if " " not in value else value.split(" ")[0])

    def piece():
        return rng.choice([
            lambda: f"<img {' '.join(attribute() for _ in range(rng.randint(0, 3)))}>",
            lambda: f"<IMG\n{attribute()} />",
            lambda: f"<!-- <img {attribute()}> -->",
            lambda: f"<p title='a > b \" c'>it's 5 < 6 &amp; so</p>",
            lambda: f"<script>if (a<b) '<img {attribute()}>'</script>",
            lambda: "<a href=x>text</a><br/>",
        ])()

    texts = ["".join(piece() for _ in range(rng.randint(0, 6))) for _ in range(1500)]

    def expected(source):
        for tag in _Images(source).found:
            offered = [tag.get("src"), tag.get("data-src")]
            offered.append((tag.get("srcset") or "").split(",")[0].strip().split(" ")[0])
            for address in offered:
                address = (address or "").strip()
                fit = address.startswith(("http://", "https://", "//")) and len(address) >= 10
                if fit and not address.endswith(".pdf"):
                    return "https:" + address if address.startswith("//") else address
        return ""

    wanted = [expected(source) for source in texts]
    assert evaluate(html.first_image, texts) == wanted
    assert 300 < sum(one != "" for one in wanted) < 1500


def test_long_text_is_read_whole(evaluate):
    filler = "<p class='x' title=\"a>b\">words and more words</p>" * 40_000
    broken = "<!-- never closed " + "<i a='" * 20_000
    given = [filler + "<img src='https://example.com/last.jpg'>", broken]
    assert evaluate(html.first_image, given)[0] == "https://example.com/last.jpg"


def test_page_image_order(evaluate):
    og = '<meta property="og:image" content="https://example.com/og.jpg">'
    twitter = '<meta name="twitter:image" content="//example.com/tw.jpg">'
    featured = "<meta content='https://example.com/ft.jpg?a=1&amp;b=2' name=featured-image />"
    bad_og = '<meta property="og:image" content="https://example.com/x.pdf">'
    given = [twitter + og, featured + twitter, bad_og + og + featured, bad_og + og,
             '<meta property="og:image:width" content="https://example.com/1.jpg">',
             '<meta name="og:image" content="https://example.com/1.jpg">', ""]
    wanted = ["https://example.com/og.jpg", "https://example.com/tw.jpg",
              "https://example.com/ft.jpg?a=1&b=2", "", "", "", ""]
    assert evaluate(html.page_image, given) == wanted


def test_unescape(evaluate):
    given = ["a&amp;b", "&#8364;&#x1F600;", "&amp;#39;", "&#38;amp;", "&lt;&quot;&apos;&gt;", "plain", "&copy=1"]
    wanted = ["a&b", "€😀", "&#39;", "&amp;", "<\"'>", "plain", "&copy=1"]
    assert evaluate(html.unescape, given) == wanted


def test_unescape_like_the_standard(evaluate):
    given = ["&#9999999;", "&#99999999999999999999;", "&#xD800;x", "&#0;&#0000;", "&#x110000;", "&#xFFFFFFFFFFF;", "caf&eacute;.jpg",
             "&hellip;&NotEqualTilde;&nosuchname;", "&#150;&#x80;&#129;", "&#1;&#xFFFF;&#13;", "&#0000000000065;", "&AMP;lt;", "&#x26;eacute;"]
    wanted = [plain_unescape(one) for one in given]
    assert evaluate(html.unescape, given) == wanted


def test_bad_references_end_no_job(evaluate):
    given = ['<img src="https://example.com/a&#9999999;.jpg">', '<img src="https://example.com/a&#xD800;&#0;.jpg">']
    assert all(image.startswith("https://example.com/a\ufffd") for image in evaluate(html.first_image, given))


class _Tree(HTMLParser):
    """Nested nodes [name, attributes, children, parent], built the plain way."""

    def __init__(self, source):
        super().__init__()
        self.root = self.at = ["", {}, [], None]
        self.new_text = True
        self.feed(source)
        self.close()

    def handle_comment(self, data):
        self.new_text = True

    def handle_starttag(self, tag, attrs):
        self.new_text = True
        node = [tag, {k: v or "" for k, v in attrs}, [], self.at]
        self.at[2].append(node)
        if tag not in ("img", "br", "source"):
            self.at = node

    def handle_endtag(self, tag):
        self.new_text = True
        node = self.at
        while node[3] is not None and node[0] != tag:
            node = node[3]
        if node[3] is not None:
            self.at = node[3]

    def handle_data(self, data):
        if self.at[0] == "script":
            return
        if self.new_text or not self.at[2] or not isinstance(self.at[2][-1], str):
            self.at[2].append("")
        self.at[2][-1] += data
        self.new_text = False

    def walk(self, node):
        for child in node[2]:
            if not isinstance(child, str):
                yield child
                yield from self.walk(child)

    def words(self, node):
        return "".join(child.strip() if isinstance(child, str) else self.words(child) for child in node[2])


def _plain_anchors(source):
    tree = _Tree(source)
    for link in tree.walk(tree.root):
        if link[0] != "a" or "href" not in link[1]:
            continue
        near = [one for one in (link[3], link[3][3]) if one is not None]
        offered = []
        for box in near:
            for img in [one[1] for one in tree.walk(box) if one[0] == "img"][:1]:
                offered += [img.get("src"), img.get("data-src"), img.get("srcset", "").split(",")[0].strip().split(" ")[0]]
        for one in tree.walk(near[-1]):
            if one[0] in ("div", "span") and "background-image" in one[1].get("style", ""):
                offered += [one[1]["style"].split("url(")[1].split(")")[0].strip("'")]
        for picture in [one for one in tree.walk(near[-1]) if one[0] == "picture"][:1]:
            for img in [one[1] for one in tree.walk(picture) if one[0] == "source"][:1]:
                offered.append(img.get("srcset", "").split(" ")[0])
        yield link[1]["href"], tree.words(link), [one for one in offered if one]


def test_anchors_equal_a_plain_tree():
    rng = random.Random(3)
    pieces = [
        "<div>", "</div>", "<p>", "</p>", "<ul><li>", "</li>", "</ul>", "<a href='/p/{n}?a=1&amp;b=2'>", "<A HREF=/@w/{n}>",
        "</a>", "<a>", "word {n} &amp; more", " <b> bold </b> ", "<img src='{n}.jpg' data-src=d{n}.jpg>", "<br/>",
        "<img srcset='s{n}.jpg 1x, t.jpg'/>", "<span style=\"background-image: url('b{n}.jpg')\">", "</span>",
        "<picture><source srcset='p{n}.jpg 2x'></picture>", "<!-- <a href='no'>no</a> -->", "<script>'<a href=no>'</script>",
        "<div style='color:red'>", "a < b", "<div title='x > y'/>",
    ]
    for _ in range(3000):
        source = "".join(rng.choice(pieces).format(n=rng.randint(1, 99)) for _ in range(rng.randint(0, 25)))
        source = source.replace("/>", ">")
        found = [(one["href"], one["text"], one["image_candidates"]) for one in page_anchors(source)]
        assert found == list(_plain_anchors(source)), source


def test_anchor_context():
    page = (
        "<div><img src='/outer.jpg'><p><a href='/p/1'> One <b> two </b><script>no</script></a>"
        "<img data-src='x.jpg' srcset='y.jpg 1x, z.jpg'></p>"
        "<span style='background-image: url(\"bg.jpg\")'></span><span style='color: red'></span>"
        "<picture><source srcset='pic.jpg 2x'></picture></div><a>no address</a><a href>empty</a>"
    )
    first, second = page_anchors(page)
    assert first["text"] == "Onetwo"
    assert first["image_candidates"] == ["x.jpg", "y.jpg", "/outer.jpg", "bg.jpg", "pic.jpg"]
    assert second == {"href": "", "text": "empty", "image_candidates": ["/outer.jpg", "bg.jpg", "pic.jpg"]}


def test_anchor_background_only_from_outer_element():
    page = "<section style='background-image:url(own.jpg)'><p><a href='/p/1'>t</a></p></section>"
    assert page_anchors(page)[0]["image_candidates"] == []


def test_anchors_survive_broken_markup():
    page = "</p></div><ul><li><a href='1'>a<li><a href='2'>b</ul><p>" + "<b>" * 5000 + "<a href='3'>c"
    assert [(one["href"], one["text"]) for one in page_anchors(page)] == [("1", "ab"), ("2", "b"), ("3", "c")]


def test_wide_pages_take_time_in_proportion():
    def seconds(count):
        page = "<div>" + "".join(f"<p><a href='/p/{i}'>title of {i}</a><img src='{i}.jpg'></p>" for i in range(count))
        page += "<a href='/p/x'>flat" * count
        start = time.perf_counter()
        found = page_links(page)
        link_images(page, [link["at"] for link in found["links"]])
        return time.perf_counter() - start

    seconds(1000)
    assert seconds(32_000) < 24 * max(seconds(4000), 0.05)


def test_unclosed_links_keep_one_copy_of_the_text():
    page = "".join(f"<a href='/p/{i}'>text {i} " for i in range(8000))
    found = page_links(page)
    assert len(found["text"]) < len(page)
    assert found["links"][7999]["end"] - found["links"][7999]["start"] == len("text 7999")
