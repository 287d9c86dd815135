"""Links of an HTML page with the images standing near them.

Which images stand near a link depends on its parent and grandparent element,
which regular expressions cannot follow, so this one step runs in Python on
Arrow batches. It only reports what is on the page; deciding which links and
images count stays in Spark expressions.
"""

import re
import sys
from bisect import bisect_right
from collections import Counter
from functools import cached_property
from html import unescape
from operator import itemgetter

import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

# Executors get this module's code with the job; they need not have it installed.
register_pickle_by_value(sys.modules[__name__])

LINKS = StructType(
    [
        StructField("text", StringType()),
        StructField(
            "links",
            ArrayType(
                StructType(
                    [
                        StructField("at", IntegerType()),
                        StructField("href", StringType()),
                        StructField("start", IntegerType()),
                        StructField("end", IntegerType()),
                    ]
                )
            ),
        ),
    ]
)

FOUND = pa.struct(
    [
        ("text", pa.string()),
        (
            "links",
            pa.list_(
                pa.struct([("at", pa.int32()), ("href", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
            ),
        ),
    ]
)
NEAR = pa.list_(pa.list_(pa.string()))
# Pages of a batch whose links are Python objects at once.
ROWS = 100

# Elements that never have content, those whose style may name a
# background image, and how the style names it.
VOID = set(
    "area base basefont bgsound br col command embed frame hr image img input isindex "
    "keygen link menuitem meta nextid param source spacer track wbr".split()
)
STYLED = ["div", "span", "section", "article"]
BACKGROUND = re.compile(r"url\([\"']?(.*?)[\"']?\)")

MARKUP = re.compile(
    r"<(?:!--.*?(?:-->|\Z)"
    r"|[!?][^>]*+>"
    r"|(?P<unread>script|style)\b[^>]*+>.*?(?=</(?P=unread)\b|\Z)"
    r"|/(?P<closing>[a-z][^\s/>]*+)[^>]*+>"
    r"|(?P<opening>[a-z][^\s/>]*+)(?P<attributes>(?:[^>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+)>)",
    re.IGNORECASE | re.DOTALL,
)
ATTRIBUTE = re.compile(r"([^\s=/>\"'<]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?")


class _Page:
    """Elements in document order; each knows its parent and where it ends.

    The text of all links is kept once; a link knows its part of it.
    """

    def __init__(self, html: str):
        self.names, self.written, self.parents, self.ends = ["#page"], [""], [-1], [None]
        self.by_kind, self.parts, self.length = {}, [], 0
        self.text_from, self.text_to = {}, {}
        self.open, self.open_count, self.open_links = [0], Counter(), []
        read = 0
        for token in MARKUP.finditer(html):
            if self.open_links:
                self._read(html[read : token.start()])
            read = token.end()
            if token["opening"]:
                self._enter(token["opening"].lower(), token["attributes"])
            elif token["closing"]:
                self._leave(token["closing"].lower())
        self._read(html[read:])
        while self.open:
            self._close_innermost()

    def _read(self, text: str):
        if self.open_links:
            self.parts.append(unescape(text).strip())
            self.length += len(self.parts[-1])

    def _enter(self, name: str, written: str):
        here = len(self.names)
        self.names.append(name)
        self.written.append(written)
        self.parents.append(self.open[-1])
        self.ends.append(here + 1)
        self.by_kind.setdefault(name, []).append(here)
        if name in VOID:
            return
        self.open.append(here)
        self.open_count[name] += 1
        if name == "a":
            self.text_from[here] = self.length
            self.open_links.append(here)
        if written.endswith("/"):
            self._close_innermost()

    def _leave(self, name: str):
        if self.open_count[name]:
            while self.names[self.open[-1]] != name:
                self._close_innermost()
            self._close_innermost()

    def _close_innermost(self):
        at = self.open.pop()
        self.ends[at] = len(self.names)
        self.open_count[self.names[at]] -= 1
        if self.open_links[-1:] == [at]:
            self.text_to[at] = self.length
            self.open_links.pop()

    def attributes(self, at: int) -> dict[str, str]:
        return {
            name.lower(): unescape(double or single or bare)
            for name, double, single, bare in ATTRIBUTE.findall(self.written[at])
        }

    def first(self, container: int, kind: str) -> int | None:
        """The first element of a kind inside a container."""
        found = self.by_kind.get(kind, [])
        at = bisect_right(found, container)
        return found[at] if at < len(found) and found[at] < self.ends[container] else None

    @cached_property
    def backgrounds(self) -> list[tuple[int, str]]:
        """Elements with a background image in their style, and its address, in order."""
        found = []
        for at in sorted(at for kind in STYLED for at in self.by_kind.get(kind, [])):
            if "background-image" in self.written[at].lower():
                style = self.attributes(at).get("style", "")
                if "background-image" in style:
                    found += [(at, address) for address in BACKGROUND.findall(style)[:1]]
        return found

    def backgrounds_within(self, container: int) -> list[str]:
        first = bisect_right(self.backgrounds, container, key=itemgetter(0))
        last = bisect_right(self.backgrounds, self.ends[container] - 1, key=itemgetter(0))
        return [address for _, address in self.backgrounds[first:last]]


def _srcset_first(srcset: str) -> str:
    return srcset.split(",")[0].strip().split(" ")[0]


def _images_near(page: _Page, parent: int) -> list[str]:
    """Addresses to try for a link, in order: an image of the parent, then of the
    grandparent, then background images and a picture of the outer one only."""
    containers = [at for at in (parent, page.parents[parent]) if at >= 0]
    outer = containers[-1]
    offered = []
    for container in containers:
        if (at := page.first(container, "img")) is not None:
            image = page.attributes(at)
            offered += [image.get("src"), image.get("data-src")]
            offered.append(_srcset_first(image.get("srcset", "")))
    offered += page.backgrounds_within(outer)
    if (picture := page.first(outer, "picture")) is not None:
        if (source := page.first(picture, "source")) is not None:
            offered.append(_srcset_first(page.attributes(source).get("srcset", "")))
    return [address for address in offered if address]


def page_links(html: str | None) -> dict | None:
    """Every link with an address, in document order, and the text of all links once."""
    if html is None:
        return None
    page = _Page(html)
    links = []
    for at in page.by_kind.get("a", []):
        href = page.attributes(at).get("href")
        if href is not None:
            links.append(
                {"at": at, "href": href, "start": page.text_from[at], "end": page.text_to[at]}
            )
    return {"text": "".join(page.parts), "links": links}


def link_images(html: str | None, wanted: list[int]) -> list[list[str]]:
    """Addresses of images near the links at these places; links of one parent share them."""
    if html is None or not len(wanted):
        return []
    page = _Page(html)
    parents = [page.parents[at] for at in wanted]
    near = {parent: _images_near(page, parent) for parent in set(parents)}
    return [near[parent] for parent in parents]


def page_anchors(html: str | None) -> list[dict] | None:
    """Every link with its text and the images near it."""
    found = page_links(html)
    if found is None:
        return None
    images = link_images(html, [link["at"] for link in found["links"]])
    return [
        {
            "href": link["href"],
            "text": found["text"][link["start"] : link["end"]],
            "image_candidates": near,
        }
        for link, near in zip(found["links"], images, strict=True)
    ]


def _in_slices(found, results: pa.DataType, *columns: pa.Array) -> pa.Array:
    """What ``found`` gives for each row. A slice's objects are let go before the next one's are made."""
    parts = [pa.array([], results)]
    for start in range(0, len(columns[0]), ROWS):
        given = zip(*(column.slice(start, ROWS).to_pylist() for column in columns), strict=True)
        parts.append(pa.array([found(*one) for one in given], results))
    return pa.concat_arrays(parts)


@F.arrow_udf(LINKS)
def _links(html: pa.Array) -> pa.Array:
    return _in_slices(lambda one: page_links(one) or {"text": None, "links": None}, FOUND, html)


@F.arrow_udf(ArrayType(ArrayType(StringType())))
def _images(html: pa.Array, wanted: pa.Array) -> pa.Array:
    return _in_slices(lambda one, at: link_images(one, at or []), NEAR, html, wanted)


def links(html: Column) -> Column:
    """``text`` and ``links``: for every link its place, ``href`` and part of the text."""
    return _links(html)


def images_near(html: Column, wanted: Column) -> Column:
    """For each wanted link (by its place) the image addresses near it."""
    return _images(html, wanted)
