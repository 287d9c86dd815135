"""URL expressions: validity, normal form, host, and absolute links."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsweave.functions.text import first_of, or_blank, strip

# What makes an address fit or unfit to be an image.
IMAGE_PREFIXES = ["http://", "https://", "//"]
NOT_IMAGE_ENDINGS = [".pdf", ".doc", ".docx", ".zip", ".mp4", ".avi", ".mp3"]
NOT_IMAGE_PARTS = ["localhost", "127.0.0.1"]
MIN_IMAGE_URL_CHARS = 10


def _either(texts: list[str]) -> str:
    return "|".join(re.escape(text) for text in texts)


# All of it as one pattern, so that one pass over the address decides.
IMAGE_URL = (
    rf"(?s)^(?=.{{{MIN_IMAGE_URL_CHARS}}})(?:{_either(IMAGE_PREFIXES)})"
    rf"(?!.*(?i:{_either(NOT_IMAGE_PARTS)}))(?!.*(?i:{_either(NOT_IMAGE_ENDINGS)})\z)"
)

# Network location: what follows '//' up to the path, query or fragment.
AUTHORITY = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)"


def is_valid_image_url(url: Column) -> Column:
    """Whether the trimmed address may be an image; null is false."""
    return F.coalesce(strip(url).rlike(IMAGE_URL), F.lit(False))


def normalize_image_url(url: Column) -> Column:
    """Trim, give protocol-relative addresses https, blank out relative ones."""
    absolute = F.regexp_replace(strip(or_blank(url)), "^//", "https://")
    return F.regexp_replace(absolute, "(?s)^/.*", "")


def first_valid_image(candidates: Column) -> Column:
    """The first acceptable candidate as written, or null."""
    return first_of(F.filter(candidates, is_valid_image_url))


def srcset_first(srcset: Column) -> Column:
    """The address of the first ``srcset`` candidate."""
    head = strip(F.substring_index(srcset, ",", 1))
    return F.substring_index(head, " ", 1)


def source_host(url: Column) -> Column:
    """Network location of an address (user info and port kept), '' if none."""
    return F.regexp_extract(or_blank(url), AUTHORITY, 1)


def absolutize_href(href: Column, base: str) -> Column:
    """Absolute form of an on-site link, null for a link to another site."""
    return F.when(href.startswith("/"), F.concat(F.lit(base), href)).when(
        href.startswith(base), href
    )


def may_have_page_image(url: Column, domains: list[str], max_chars: int) -> Column:
    """Whether a page is worth a look: short http(s) address at a trusted domain."""
    anywhere = "|".join(re.escape(domain) for domain in domains)
    return (
        (F.length(or_blank(url)) <= max_chars)
        & url.rlike("^https?://")
        & url.rlike(f"(?i){anywhere}")
    )
