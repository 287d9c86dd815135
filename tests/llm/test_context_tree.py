"""Context-tree scores against a direct recursion over all nodes of small corpora."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from newsweave.llm import context_tree as tree

TEXTS = ["", None, "a", "abab", "ABAB abab", "the cat the", "é\x00 \t x", "the  dog\n" * 30, "zz top"]


def steps(text, depth):
    """(context, bits before, bit) of every decision of a text and its end."""
    data = bytes(depth) + (text or "").encode().lower() + b"\0"
    for at in range(depth, len(data)):
        bits = f"{data[at]:08b}"
        for i in range(8):
            yield data[at - depth : at], bits[:i], int(bits[i])


def brute(learned, texts, depth):
    counts = Counter()
    for text in learned:
        for context, before, bit in steps(text, depth):
            for length in range(depth + 1):
                counts[context[depth - length :], before, bit] += 1
    below = {}
    for context, before, _ in counts:
        if context:
            below.setdefault((context[1:], before), set()).add(context)

    def kt(context, before):
        a, b = counts[context, before, 0], counts[context, before, 1]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - 2 * math.lgamma(0.5)

    memo = {}

    def weighted(context, before):
        """log P of a node, and of its children together."""
        if (context, before) not in memo:
            own = kt(context, before)
            if len(context) == depth:
                memo[context, before] = own, None
            else:
                more = sum(weighted(c, before)[0] for c in below.get((context, before), ()))
                high = max(own, more)
                memo[context, before] = (
                    math.log(0.5) + high + math.log(math.exp(own - high) + math.exp(more - high)),
                    more,
                )
        return memo[context, before]

    def predicted(context, before, length):
        own = context[depth - length :]
        a, b = counts[own, before, 0], counts[own, before, 1]
        p = (b + 0.5) / (a + b + 1)
        if length == depth:
            return p
        whole, _ = weighted(own, before)
        stop = math.exp(math.log(0.5) + kt(own, before) - whole)
        return stop * p + (1 - stop) * predicted(context, before, length + 1)

    out = []
    for text in texts:
        total = 0.0
        for context, before, bit in steps(text, depth):
            p = predicted(context, before, 0)
            total += math.log10(p if bit else 1 - p)
        out.append(total)
    return out


def words(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]


@pytest.mark.parametrize("depth", [1, 4])
def test_brute_force(spark, depth):
    rows = [(i if i != 3 else None, t, 1.0, i) for i, t in enumerate(TEXTS * 2)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, score double, block int")
    held = F.coalesce("doc_id", F.lit(0)) % 5 == 1
    got = tree.score_documents(frame, held, depth).collect()
    assert len(got) == len(rows)
    learned = [t for i, t, _, _ in rows if (i or 0) % 5 != 1]
    counts = Counter(w for t in learned for w in [*words(t), None])
    total, distinct = sum(counts.values()), len(counts)
    scores = brute(learned, [t for _, t, _, _ in rows], depth)
    want = {i: (t, s) for (i, t, _, _), s in zip(rows, scores, strict=True)}
    for row in got:
        text, score = want[row.doc_id]
        own = [*words(text), None]
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in own)
        assert row.held_out == ((row.doc_id or 0) % 5 == 1)
        assert (row.n_tokens, row.train_tokens) == (len(own), total)
        assert row.n_known == sum(counts[w] > 0 for w in own)
        assert math.isclose(row.base_score, base, rel_tol=1e-9)
        assert math.isclose(row.score, score, rel_tol=1e-9)
        assert math.isclose(row.bits_per_byte, -score / math.log10(2) / (len((text or "").encode()) + 1), rel_tol=1e-9)


def test_split_and_many_blocks(spark, tables, monkeypatch):
    monkeypatch.setattr(tree, "BLOCK", 1 << 16)
    monkeypatch.setattr(tree, "BUCKET", 1 << 16)
    frame = spark.read.parquet(f"{tables}/documents.parquet")
    got = {r.doc_id: r for r in tree.context_tree_scores(frame).collect()}
    monkeypatch.undo()
    again = {r.doc_id: r for r in tree.context_tree_scores(frame).collect()}
    assert len(got) == frame.count() and got.keys() == again.keys()
    for number, row in got.items():
        assert row.held_out == (zlib.crc32(str(number).encode()) % 5 == 1)
        assert math.isclose(row.score, again[number].score, rel_tol=1e-9)
        assert row.n_known == again[number].n_known
        assert 0.02 < row.bits_per_byte < 10


def test_nothing_to_learn_from(spark):
    frame = spark.createDataFrame([(1, "ab"), (2, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in tree.score_documents(frame, F.lit(True)).collect()}
    assert math.isclose(rows[1].score, 24 * math.log10(0.5)) and rows[2].n_known == 0
    assert rows[1].base_score == 0 and rows[1].train_tokens == 0
    assert tree.context_tree_scores(frame.limit(0)).collect() == []
    with pytest.raises(ValueError):
        tree.score_documents(frame, F.lit(True), 9)


def test_default_depth():
    """The model is not made smaller to fit a limit."""
    assert tree.DEPTH >= 5


def block_group(texts, depth, buckets):
    """A block of texts with answers: the count of a word, and of a byte string minus a tenth of its last byte."""
    block = tree.Block(depth)
    for at, text in enumerate(texts):
        block.add(at, 0, text)
    names = tree.PACK.replace(",", "").split()[::2]
    rows = [dict(zip(names, row, strict=True)) for row in block.rows("b", buckets)]
    for row in rows:
        if row["kind"] == tree.GRAMS:
            row["counts"] = tree.squeeze(-(tree.spread_keys(row["keys"]) & 255) / 10)
        if row["kind"] != tree.DOCS:
            row["kind"] += tree.WORD_VALUES - tree.WORDS
            row["keys"] = None
    return pd.DataFrame(rows)


def test_a_byte_string_is_looked_up_once_for_all_its_places(monkeypatch):
    texts = [b"abcdefghijklmnopqrstuvwxyz " * 2000, b"", b"a-long-word-that-repeats " * 3000]
    group, looked, search = block_group(texts, 5, 3), [], np.searchsorted

    def counted(into, needles, **more):
        looked.append(np.size(needles) if np.asarray(needles).dtype == np.int64 else 0)
        return search(into, needles, **more)

    monkeypatch.setattr(tree.np, "searchsorted", counted)
    got = tree.block_scores(group, 5, 3, 10, 5)
    monkeypatch.undo()
    # Words may be looked up for each place; there are far fewer of them.
    assert sum(looked) < sum(map(len, texts)) / 2
    assert got["score"].tolist() == pytest.approx([-sum(text) / 10 for text in texts])
    assert got["n_tokens"].tolist() == [2001, 1, 3001]


def test_words_are_hashed_as_split_finds_them(monkeypatch):
    """Words of all sizes, beside every blank; those of the same bytes share a key, others do not."""
    texts = [b"", b" \t\n\x0b\x0c\r ", b"a" * 64 + b"\x0b" + b"a" * 65 + b" " + b"a" * 66, b"\x1c \x1c\x85 \xc2\xa0", b"x", b"x\x00 x"]
    texts += [b" ".join(b"abcdefghij"[:n] * m for n in range(1, 11) for m in (1, 2, 3)), b"ab abc" * 40, b"\n"]
    for own in (texts, texts[::-1], [b"one"], [b""]):
        keys, at = tree.word_keys(own)
        wanted = [(number, word) for number, text in enumerate(own) for word in [*text.split(), None]]
        assert Counter(at.tolist()) == Counter(number for number, _ in wanted)
        by_text = [Counter(keys[at == number].tolist()) for number in range(len(own))]
        named = {}
        for number, text in enumerate(own):
            alone, _ = tree.word_keys([text])
            assert by_text[number] == Counter(alone.tolist())
            for key, word in zip(alone.tolist(), [*text.split(), None], strict=True):
                assert named.setdefault(word, key) == key
        assert len(set(named.values())) == len(named)


@pytest.mark.parametrize("depth", [1, 2, 5, 6])
def test_byte_strings_of_texts_together_are_those_of_each(depth):
    texts = [b"", b"ab", b"", b"abcdefghij", b"\x00\x00"]
    keys, at = tree.gram_keys(texts, depth)
    for number, text in enumerate(texts):
        padded = bytes(depth) + text + b"\0"
        wanted = [int.from_bytes(padded[i : i + depth + 1], "big") for i in range(len(text) + 1)]
        assert keys[at == number].tolist() == wanted


def test_texts_beyond_the_number_that_fits_beside_a_byte_string(spark):
    """With six bytes of context 256 texts at most are scored together."""
    rows = [(i, f"text {i % 7}" if i % 3 else None) for i in range(700)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = tree.score_documents(frame, F.lit(False), 6).collect()
    assert sorted(r.doc_id for r in got) == list(range(700))
    assert len({(len(rows[r.doc_id][1] or ""), rows[r.doc_id][1], round(r.score, 9)) for r in got}) == 8
