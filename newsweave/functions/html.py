"""Images named by HTML text, found with built-in expressions only.

One regular expression walks the text and yields comments, script and style
bodies, and start tags as whole tokens, so that a tag inside a comment, a script
or a quoted attribute is never taken for a real one. All quantifiers over
unbounded input are possessive or reluctant over single classes: no
backtracking and no recursion, however long the text.
"""

import re
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsweave.functions.text import first_of, let, or_blank
from newsweave.functions.urls import (
    first_valid_image,
    normalize_image_url,
    srcset_first,
)

TOKEN = (
    r"(?is)<(?:!--.*?-->"
    r"|script\b.*?</script"
    r"|style\b.*?</style"
    r"|[a-z][^\s/>]*+(?:[^>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+>)"
)
ATTRIBUTE = r"(?s)([^\s=/>\"'<]++)\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s>]*+)"
NAME_PART = r"(?s)^[^=]*=\s*"
QUOTES = r"(?s)^([\"'])(.*)\1$"

REFERENCE = r"&(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]{1,31});"
REPLACEMENT = "\ufffd"
# Characters of the old Windows code page for 0x80 to 0x9F; its gaps stand for themselves.
OLD_PAGE = "".join(bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(0x80, 0xA0))

# The standard's named references and their one or two characters, as one text of lines;
# '&' itself is resolved last. A literal text is far cheaper to plan with than a literal map.
NAMED = "\n".join(
    ["", *[f"&{name}\t{value}" for name, value in html5.items() if name.endswith(";") and value != "&"], ""]
)


def _named(reference: Column) -> Column:
    """The characters of a named reference, or the reference itself."""
    line = F.concat(F.lit("\n"), reference, F.lit("\t"))

    def found(at: Column) -> Column:
        value = F.substring(F.lit(NAMED), at + F.length(line), F.lit(2))
        return F.when(at == 0, reference).otherwise(F.rtrim(value, F.lit("\n")))

    return let(F.position(line, F.lit(NAMED)), found)


def _numbered(reference: Column) -> Column:
    """The character a numeric reference stands for.

    By the standard, numbers that are no character give the replacement character, those of
    the old Windows code page its characters, and control characters nothing.
    """
    digits = F.ltrim(F.regexp_extract(reference, r"^&#[xX]?([0-9A-Fa-f]+);$", 1), F.lit("0"))
    base = F.when(F.lower(reference).startswith("&#x"), F.conv(digits, 16, 10)).otherwise(digits)
    number = F.when(digits == "", F.lit("0")).when(F.length(digits) <= 7, base).try_cast("bigint")
    old = F.substring(F.lit(OLD_PAGE), (number - 0x7F).cast("int"), F.lit(1))
    plain = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    control = (
        number.between(1, 8) | (number == 11) | number.between(14, 31) | (number == 127)
        | number.between(0xFDD0, 0xFDEF) | (number.bitwiseAND(0xFFFE) == 0xFFFE)
    )
    return (
        F.when(
            number.isNull() | (number == 0) | number.between(0xD800, 0xDFFF) | (number > 0x10FFFF),
            REPLACEMENT,
        )
        .when(number.between(0x80, 0x9F), old)
        .when(control, "")
        .otherwise(plain)
    )


def unescape(text: Column) -> Column:
    """Resolve numeric and named character references that end with a semicolon."""

    def resolve(done: Column, reference: Column) -> Column:
        character = F.when(reference.startswith("&#"), _numbered(reference)).otherwise(
            _named(reference)
        )
        return F.replace(
            done, reference, F.when(character == "&", "&amp;").otherwise(character)
        )

    references = F.array_distinct(F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0)))
    resolved = F.aggregate(F.array_remove(references, "&amp;"), text, resolve)
    resolved = F.replace(F.replace(resolved, F.lit("&AMP;"), F.lit("&")), F.lit("&amp;"), F.lit("&"))
    return F.when(text.contains("&"), resolved).otherwise(text)


def start_tags(html: Column, names: list[str]) -> Column:
    """Start tags with one of ``names``, whole and in document order."""
    wanted = r"(?i)^<(?:" + "|".join(names) + r")[\s/>]"
    tokens = F.regexp_extract_all(html, F.lit(TOKEN), F.lit(0))
    found = F.filter(tokens, lambda token: token.rlike(wanted))
    # A plain search first: most texts hold none of the tags.
    return F.when(html.rlike(wanted.replace("^", "", 1)), found).otherwise(
        F.array().cast("array<string>")
    )


def _attributes(tag: Column) -> Column:
    """The attributes of a start tag as written, name and value."""
    return F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(0))


def _written_value(attributes: Column, name: str) -> Column:
    """Value of an attribute (its last one) as written, '' when absent."""
    named = F.filter(attributes, lambda pair: pair.rlike(rf"(?is)^{name}\s*="))
    value = F.regexp_replace(or_blank(F.try_element_at(named, F.lit(-1))), NAME_PART, "")
    return F.regexp_replace(value, QUOTES, "$2")


def _image_addresses(tag: Column) -> Column:
    def written(attributes: Column) -> Column:
        return F.array(*[_written_value(attributes, name) for name in ("src", "data-src", "srcset")])

    return let(
        F.transform(let(_attributes(tag), written), unescape),
        lambda values: F.array(values[0], values[1], srcset_first(values[2])),
    )


def image_candidates(html: Column) -> Column:
    """Addresses an HTML text offers for images, in the order they are tried."""
    return F.flatten(F.transform(start_tags(html, ["img"]), _image_addresses))


def first_image(html: Column) -> Column:
    """Normalised address of the first acceptable image in the text, or ''."""
    chosen = first_valid_image(image_candidates(or_blank(html)))
    return F.coalesce(normalize_image_url(chosen), F.lit(""))


# Metadata that names a page's image, in the order tried.
IMAGE_METADATA = [
    ("property", "og:image"),
    ("name", "twitter:image"),
    ("name", "featured-image"),
]


def _first_meta(metas: Column, key: str, value: str) -> Column:
    """Attributes of the first meta tag with exactly this key."""
    pair = rf"(?s)^(?i:{key})\s*=\s*([\"']?){re.escape(value)}\1$"
    found = first_of(F.filter(metas, lambda tag: F.exists(tag, lambda p: p.rlike(pair))))
    return F.coalesce(found, F.array().cast("array<string>"))


def page_image(html: Column) -> Column:
    """Image a page names in its metadata: the first of each kind, in order."""

    def choose(metas: Column) -> Column:
        firsts = F.array(*[_first_meta(metas, key, value) for key, value in IMAGE_METADATA])
        offered = F.transform(firsts, lambda tag: let(_written_value(tag, "content"), unescape))
        return normalize_image_url(or_blank(first_valid_image(offered)))

    return let(F.transform(start_tags(or_blank(html), ["meta"]), _attributes), choose)
