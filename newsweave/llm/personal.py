"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, schemes, digits, plus signs and words
that announce an identifier. At each anchor a local parser expands to the boundaries of an
address, a number or an account and checks it. The cost is linear in the text; a parser
starts at an anchor once and never before the end of its last match.

Null and empty texts hold nothing. Spans are code points, the end exclusive.
"""

import re
import string
from collections.abc import Callable, Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsweave.llm.columns import joined_spans

KINDS = ["email", "ip", "card", "phone", "login", "account"]
BASE = KINDS[:4]
SPANS = "array<struct<start:long,place:int,end:long,kind:string>>"

# What the local parsers read at an anchor.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOGIN = re.compile(r"://[^\s:/?#@]+:[^\s:/?#@]+@")
ACCOUNT = re.compile(r"(?:[ ]?(?:no|nr|number|id))?\.?[ ]?[:#=]?[ ]?([A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]){11,30}|[0-9]{8,34})")
# Characters of an IBAN by its country; others have 15 to 34.
IBAN_SIZES = {
    country: size
    for size, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK",
        21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
        24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
        28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC",
        32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}
CUES = ("account", "iban", "konto", "compte", "cuenta", "passport")
# A scheme is a letter and more of these.
LETTERS = frozenset(string.ascii_letters)
SCHEME = LETTERS | frozenset(string.digits + "+.-")


def _anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for mark in ("@", "://", "+", *"0123456789"):
        found.add_word(mark, "digit" if mark.isdigit() else mark)
    for cue in CUES:
        for form in {cue, cue.upper(), cue.capitalize()}:
            found.add_word(form, "cue")
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for at, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + at % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def iban(text: str) -> bool:
    moved = text[4:] + text[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def account_end(text: str, start: int, end: int) -> int:
    """Where the account that begins at ``start`` ends, by its check digits, or 0.

    ``end`` is that of the run of capitals, digits and single blanks, which what follows the
    account may be part of. The country's size goes first, then the whole run, then, where the
    country is not known, the run's blanks from the last.
    """
    ends = [at + 1 for at in range(start, end) if text[at] != " "]
    size = IBAN_SIZES.get(text[start : start + 2])
    tried = [ends[size - 1]] if size and size <= len(ends) else []
    tried.append(end)
    if not size:
        tried += [at for at in reversed(ends[14:-1]) if text[at] == " "]
    return next((at for at in tried if iban(text[start:at].replace(" ", ""))), 0)


def find(text: str, anchors: ahocorasick.Automaton) -> list[tuple[int, int, int, str]]:
    """Spans of a text as (start, place of the kind, end, kind), in order.

    ``after`` holds, per kind, where its last match ended: failing matches count as well,
    as a scan without overlaps goes on behind them.
    """
    out: list[tuple[int, int, int, str]] = []
    after = dict.fromkeys(KINDS, 0)

    def keep(kind: str, start: int, end: int, good: bool = True) -> None:
        after[kind] = end
        if good:
            out.append((start, KINDS.index(kind), end, kind))

    for last, anchor in anchors.iter(text):
        if anchor == "digit":
            if last >= after["ip"] and not (last > after["ip"] and _digit(text, last - 1)):
                if m := IP.match(text, last):
                    keep("ip", last, m.end(), all(_byte(part) for part in m.groups()))
            if last >= after["card"] and (m := CARD.match(text, last)):
                digits = m[0].replace(" ", "").replace("-", "")
                keep("card", last, m.end(), 12 <= len(digits) <= 19 and luhn(digits))
        elif anchor == "@":
            start = last
            while start > after["email"] and text[start - 1] in LOCAL:
                start -= 1
            if start < last and (m := DOMAIN.match(text, last)):
                keep("email", start, m.end())
        elif anchor == "+":
            if last >= after["phone"] and (m := PHONE.match(text, last)):
                keep("phone", last, m.end(), 9 <= sum(map(_is_digit, m[0])) <= 15)
        elif anchor == "://":
            start = last - 2
            if start >= after["login"] and (m := LOGIN.match(text, start)):
                first = start
                while first and text[first - 1] in SCHEME:
                    first -= 1
                while first < start and text[first] not in LETTERS:
                    first += 1
                keep("login", first, m.end(), first < start)
        elif last + 1 >= after["account"] and (m := ACCOUNT.match(text, last + 1)):
            end = m.end(1) if m[1].isdigit() else account_end(text, m.start(1), m.end(1))
            if end:
                keep("account", m.start(1), end)
    out.sort()
    return out


def _is_digit(char: str) -> bool:
    return "0" <= char <= "9"


def _digit(text: str, at: int) -> bool:
    return at >= 0 and _is_digit(text[at])


def _byte(part: str) -> bool:
    return len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or "0") <= 255


def find_personal(documents: DataFrame) -> DataFrame:
    """``documents`` with ``found``: spans by start, then by kind. A map over the rows."""
    others = [name for name in documents.columns if name != "found"]

    @F.pandas_udf(SPANS)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        anchors = _anchors()
        for texts in batches:
            yield pd.Series([find(text, anchors) if text else [] for text in texts], dtype=object)

    return documents.select(*others).withColumn("found", scan("text"))


def mask_personal(documents: DataFrame) -> DataFrame:
    """``documents`` with each found span of its text replaced by its kind in brackets.

    Spans that overlap are masked together under the first one's kind. A null text stays
    null; ``n_chars``, where there is one, is counted again.
    """

    @F.pandas_udf("string")
    def masked(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        anchors = _anchors()
        for texts in batches:
            yield pd.Series([mask(text, anchors) if text else text for text in texts], dtype=object)

    out = documents.withColumn("text", masked("text"))
    if "n_chars" in documents.columns:
        out = out.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType))
    return out


def mask(text: str, anchors: ahocorasick.Automaton) -> str:
    parts, at = [], 0
    for start, _, end, kind in find(text, anchors):
        if start >= at:
            parts += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def _of(kind: str) -> Callable[[Column], Column]:
    return lambda span: span["kind"] == kind


def personal_digest(found: DataFrame) -> DataFrame:
    """Counts, the hash of the base spans and all spans as text, per row with ``found``."""
    counts = [
        F.size(F.filter("found", _of(kind))).cast("long").alias(f"n_{kind}")
        for kind in BASE
    ]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(joined_spans(F.filter("found", lambda s: s["kind"].isin(BASE))), 256).alias("base_sha256"),
        joined_spans(F.col("found")).alias("spans"),
    )
