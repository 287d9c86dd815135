import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from newsweave.llm import personal

ANCHORS = personal._anchors()
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def check_digit(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(digits[::-1])) % 10 == 0


def base(text):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if max(map(int, m[0].split("."))) <= 255]
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and check_digit(digits):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


PARTS = ["@", "a", "b1", ".", "1", "23", "255", "256", "0001", " ", "-", "+", "(", ")", "4111111111111111", "://", ":", "account ", "%é🙂", "\n"]


@settings(max_examples=3000, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=30).map("".join))
def test_base(text):
    found = personal.find(text, ANCHORS)
    assert [f[:3] for f in found if f[1] < 4] == base(text)
    assert found == sorted(found)


def test_added():
    def shown(text):
        return [(kind, text[start:end]) for start, _, end, kind in personal.find(text, ANCHORS)]

    assert shown("see ftp://me:pw@host now") == [("login", "ftp://me:pw@")]
    assert shown("see verylongschemenameabcdefghij://user:pass@host") == [("login", "verylongschemenameabcdefghij://user:pass@")]
    assert shown("1.-a+b://u:p@h") == [("login", "a+b://u:p@")]
    assert shown("12://u:p@h ://u:p@h") == []
    assert shown("IBAN: GB82 WEST 1234 5698 7654 32.") == [("account", "GB82 WEST 1234 5698 7654 32")]
    assert shown("IBAN: GB82 WEST 1234 5698 7654 33.") == []
    assert shown("account no. 123456789") == [("account", "123456789")]
    assert shown("on account of it, 1 2 3") == []


def test_account_before_capitals_and_digits():
    def shown(text):
        return [text[start:end] for start, _, end, kind in personal.find(text, ANCHORS) if kind == "account"]

    spaced, plain = "DE89 3704 0044 0532 0130 00", "DE89370400440532013000"
    for after in (" BIC COBADEFFXXX", " 12 May", " A new", " X", " 1", " GB82 WEST 1234 5698 7654 32", ".", "", "x", "BIC", "12"):
        assert shown(f"IBAN: {spaced}{after}") == [spaced]
        assert shown(f"IBAN {plain}{after}") == [plain]
    assert shown("IBAN: NO93 8601 1117 947 BIC DNBANOKK") == ["NO93 8601 1117 947"]
    assert shown("IBAN DE89370400440532013001 A new") == []
    assert personal.mask(f"IBAN: {spaced} BIC COBADEFFXXX", ANCHORS) == "IBAN: [account] BIC COBADEFFXXX"


def test_long_texts_are_linear():
    for text in ("1" * 300_000, "a@" * 100_000, "+1(" * 100_000, "1.2.3." * 50_000, "://a:" * 60_000, "a" * 300_000 + "://u:p@h", "a://u:p@" * 40_000):
        personal.find(text, ANCHORS)


def test_frames(spark, tables):
    frame = spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (None, "x@y.z"), (-3, "x@y.z")], frame.schema)
    every = frame.unionByName(odd).selectExpr("*", "1 AS found")
    texts = {r.doc_id: r.text or "" for r in every.collect()}
    rows = personal.personal_digest(personal.find_personal(every)).collect()
    assert len(rows) == frame.count() + 4
    for row in rows:
        spans = base(texts[row.doc_id])
        listed = ",".join(f"{personal.KINDS[k]}:{s}:{e}" for s, k, e in spans)
        assert row.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        counts = [sum(k == kind for _, k, _ in spans) for kind in range(4)]
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == counts
    assert sum(r.n_email for r in rows) > 4
    assert personal.find_personal(every.limit(0)).collect() == []


def test_masks(spark):
    rows = [(1, "to x@y.z, 1.2.3.4!", 18), (2, None, None), (3, "clean", 5), (4, "é 4111111111111111", 18)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in personal.mask_personal(frame).collect()}
    assert got == {1: ("to [email], [ip]!", 17), 2: (None, None), 3: ("clean", 5), 4: ("é [card]", 8)}
