"""Language-model scores by context-tree weighting.

Every byte is eight binary decisions, each with a binary tree of its own over the bytes
before it. A node of such a tree holds a Krichevsky-Trofimov estimate of its decision; the model
weights all depths: P(node) = 1/2 KT(node) + 1/2 product of P(children), and predicts with
the posterior weights that follow. Beside it stands the unigram score of the text's words.

How it is spread: documents are packed into blocks of bounded size. A block names
each of its words (by a 64-bit hash) and byte strings once; these are dealt by hash into
buckets, whose number follows the input, summed there, and the answers return to the
blocks in the order asked. Only the number of words and of distinct words reach the driver.
Byte strings with the same context share a bucket, which therefore has the deepest nodes
whole; the levels above are tables of nodes, summed from those below.

Byte strings that occur only in held-out texts take part with a count of 0, so every text can
be scored. Null texts count as empty: no words, one end. A null id counts as the empty text
for the split. With nothing to learn from, all decisions are even.
"""

from collections.abc import Iterator
from math import lgamma

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsweave.llm.language import fold
from newsweave.session import write_out

DEPTH = 5
# Bytes of text in a block, unless one text alone is longer, and of input for each bucket.
BLOCK = 12 << 20
BUCKET = 6 << 20
# Rows read from a batch at once.
ROWS = 500
# Bytes of texts whose words and byte strings are sorted at once, unless one text alone is longer.
TOGETHER = 1 << 20
# Distinct keys that wait at most before a block sums them, unless it has summed more already.
SUMMED = 1 << 19
# Words of more bytes are hashed one by one.
LONG = 64
# Nodes whose logarithms are Python objects at once.
LOGS = 10_000
# Stands for what precedes a text and for its end.
EDGE = b"\0"
WORDS, GRAMS, DOCS, WORD_VALUES, GRAM_VALUES = range(5)
PART = "block string, kind int, bucket int, keys binary, counts binary"
PACK = "block string, kind int, bucket int, keys binary, counts binary, sizes binary, ids binary, flags binary"


BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
# The first bytes of eight that belong to a word, by how many are left of it.
FIRST_BYTES = np.array([(1 << 8 * left) - 1 for left in range(9)], np.uint64)


def mixed(values: np.ndarray) -> np.ndarray:
    """Well-spread 64-bit values, worked on in place; different values stay different."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        values ^= values >> np.uint64(shift)
        values *= np.uint64(factor)
    values ^= values >> np.uint64(31)
    return values


# The end counts as a word; no word is empty.
END_KEY = int(mixed(np.zeros(1, np.uint64) + np.uint64(0x9E3779B97F4A7C15)).view(np.int64)[0])


def word_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of some texts, with an end for each text, and the text each is of.

    All words take their next eight bytes at once.
    """
    data = b" ".join([b"", *texts, bytes(8)])
    joined = np.frombuffer(data, np.uint8)[:-8]
    blank = BLANK[joined]
    edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    sizes = ends - starts
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    keys = mixed(sizes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    more = np.flatnonzero(sizes <= LONG)
    for at in range(0, LONG, 8):
        more = more[sizes[more] > at]
        if not len(more):
            break
        part = eight[starts[more] + at]
        part &= FIRST_BYTES[np.minimum(sizes[more] - at, 8)]
        keys[more] = mixed(keys[more] ^ part)
    for word in np.flatnonzero(sizes > LONG).tolist():
        keys[word] = xxhash.xxh3_64_intdigest(data[starts[word] : ends[word]])
    begins = np.cumsum([1, *(len(text) + 1 for text in texts)])[:-1]
    text = np.searchsorted(begins, starts, side="right") - 1
    every = np.arange(len(texts))
    return np.r_[keys.view(np.int64), np.full(len(texts), END_KEY, np.int64)], np.r_[text, every]


def gram_keys(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Every byte of some texts and their ends, each with the ``depth`` bytes before it, and the text each is of."""
    padded = np.frombuffer(EDGE * depth + (EDGE * depth).join(texts) + EDGE, dtype=np.uint8)
    size = len(padded) - depth
    keys = np.zeros(size, dtype=np.int64)
    for back in range(depth + 1):
        keys <<= 8
        keys |= padded[back : back + size]
    sizes = np.array([len(text) for text in texts])
    # Between two texts stand depth edges, of which the first is an end.
    between = (np.cumsum(sizes[:-1] + depth) - depth + 1)[:, None] + np.arange(depth - 1)
    if between.size:
        kept = np.ones(size, bool)
        kept[between] = False
        keys = keys[kept]
    return keys, np.repeat(np.arange(len(texts)), sizes + 1)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each is there; sorts ``keys`` in place."""
    keys.sort()
    return lengths(keys)


def lengths(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of keys in order, and how often each is there."""
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
    return keys[first], np.diff(np.append(first, len(keys)))


def together(texts: Iterator[bytes], most: int) -> Iterator[list[bytes]]:
    """Texts in runs of about ``TOGETHER`` bytes and ends, at most ``most`` of them."""
    waiting, held = [], 0
    for text in texts:
        waiting.append(text)
        held += len(text) + 1
        if held >= TOGETHER or len(waiting) == most:
            yield waiting
            waiting, held = [], 0
    if waiting:
        yield waiting


def squeeze(values: np.ndarray) -> bytes:
    """Compressed 64-bit values: all first bytes, then all second ones, and so on."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8).T.tobytes()
    return len(values).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def spread(data: bytes, kind: type = np.int64) -> np.ndarray:
    count = int.from_bytes(data[:8], "little")
    planes = pa.decompress(data[8:], decompressed_size=8 * count, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).view(kind).ravel()


def squeeze_keys(keys: np.ndarray) -> bytes:
    """Compressed keys in rising order, by their differences."""
    return squeeze(np.diff(keys, prepend=np.int64(0)))


def spread_keys(data: bytes) -> np.ndarray:
    return np.cumsum(spread(data))


class Tally:
    """Keys with their training counts; kept short by summing what has piled up."""

    def __init__(self) -> None:
        self.keys, self.counts, self.waiting, self.summed = [], [], 0, 0

    def add(self, keys: np.ndarray, learned: bool) -> None:
        keys, counts = distinct(keys)
        self.keys.append(keys)
        self.counts.append(counts if learned else np.zeros(len(keys), np.int64))
        self.waiting += len(keys)
        if self.waiting >= max(SUMMED, self.summed):
            self.sums()

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = summed(np.concatenate(self.keys), np.concatenate(self.counts))
        self.keys, self.counts, self.waiting, self.summed = [keys], [counts], 0, len(keys)
        return keys, counts


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(counts[order], first)


class Block:
    """Documents gathered until they fill a block."""

    def __init__(self, depth: int) -> None:
        self.depth, self.bytes = depth, 0
        self.data, self.ids, self.flags = [], [], []

    def add(self, number: int, flags: int, data: bytes) -> None:
        self.data.append(data)
        self.ids.append(number)
        self.flags.append(flags)
        self.bytes += len(data)

    def rows(self, name: str, buckets: int) -> Iterator[tuple]:
        words, grams = Tally(), Tally()
        for learned in (True, False):
            own = (d for d, flags in zip(self.data, self.flags, strict=True) if learned != flags & 1)
            for texts in together(own, TOGETHER):
                words.add(word_keys(texts)[0], learned)
                grams.add(gram_keys(texts, self.depth)[0], learned)
        for kind, tally in ((WORDS, words), (GRAMS, grams)):
            keys, counts = tally.sums()
            dealt, order = asked_order(keys, kind, buckets)
            edges = np.searchsorted(dealt[order], np.arange(buckets + 1))
            for bucket in np.flatnonzero(np.diff(edges)):
                part = order[edges[bucket] : edges[bucket + 1]]
                yield (name, kind, int(bucket), squeeze_keys(keys[part]), squeeze(counts[part]), None, None, None)
        text = b"".join(self.data)
        sizes = np.array([len(d) for d in self.data], np.int64)
        yield (
            name, DOCS, None, pa.compress(text, codec="zstd", asbytes=True), None, sizes.tobytes(),
            np.array(self.ids, np.int64).tobytes(), np.array(self.flags, np.uint8).tobytes(),
        )


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    mixed = keys.astype(np.uint64)  # a copy, worked on in place
    mixed *= np.uint64(0x9E3779B97F4A7C15)
    mixed >>= np.uint64(33)
    mixed %= np.uint64(buckets)
    return mixed.view(np.int64)


def asked_order(keys: np.ndarray, kind: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a block's distinct keys, which rise, and the order in which the block asks for them."""
    dealt = bucket_of(keys >> 8 if kind == GRAMS else keys, buckets)
    # Numbers of 16 bits are sorted by their digits.
    return dealt, np.argsort(dealt.astype(np.uint16) if buckets <= 1 << 16 else dealt, kind="stable")


def pack(documents: DataFrame, held_out: Column, depth: int, buckets: int) -> DataFrame:
    """The blocks of all documents and what they ask for: rows of ``PACK``."""

    kinds = [pa.string(), pa.int32(), pa.int32(), *[pa.binary()] * 5]
    names = PACK.replace(",", "").split()[::2]

    def packed(block: Block, name: str) -> pa.RecordBatch:
        columns = zip(*block.rows(name, buckets), strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, task, made = Block(depth), TaskContext.get().partitionId(), 0
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                rows = batch.slice(start, ROWS).to_pylist()
                for row in rows:
                    block.add(row["id"], row["flags"], (row["text"] or "").encode().lower())
                    if block.bytes >= BLOCK:
                        yield packed(block, f"{task}-{made}")
                        block, made = Block(depth), made + 1
        if block.ids:
            yield packed(block, f"{task}-{made}")

    number = F.col("doc_id").cast("long")
    flags = held_out.cast("int") + 2 * number.isNull().cast("int")
    rows = documents.select(F.coalesce(number, F.lit(0)).alias("id"), flags.alias("flags"), "text")
    return rows.mapInArrow(run, PACK)


def _totals(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return summed(
        np.concatenate([spread_keys(own) for own in group["keys"]]),
        np.concatenate([spread(own) for own in group["counts"]]),
    )


def word_answers(group: pd.DataFrame) -> pd.DataFrame:
    """For each block of a bucket the training counts of its words, and one row of sums."""
    keys, counts = _totals(group)
    rows = [
        (block, WORD_VALUES, bucket, None, squeeze(counts[np.searchsorted(keys, spread_keys(own))]), 0, 0)
        for block, bucket, own in zip(group["block"], group["bucket"], group["keys"], strict=True)
    ]
    rows.append((None, None, None, None, None, int(counts.sum()), int((counts > 0).sum())))
    return pd.DataFrame(rows, columns=["block", "kind", "bucket", "keys", "counts", "total", "known"])


def decisions(grams: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The node and the bit of each of the eight decisions; nodes rise as the strings do."""
    context, byte = grams >> 8 << 8, grams & 255
    for i in range(8):
        yield context + (1 << i) + (byte >> (8 - i)), byte >> (7 - i) & 1


def deepest_nodes(group: pd.DataFrame) -> pd.DataFrame:
    """The nodes of a bucket's contexts, with how often each decision was 0 and 1, and ``log_kt`` of it.

    The task that counts them takes the logarithms too: a second Python worker beside it would hold as much.
    """
    grams, counts = _totals(group)
    parts = []
    for node, bit in decisions(grams):
        first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        ones = np.add.reduceat(counts * bit, first)
        zeros = np.add.reduceat(counts, first) - ones
        nodes = {"bucket": group["bucket"].iloc[0], "node": node[first], "zeros": zeros, "ones": ones}
        parts.append(pd.DataFrame(nodes | {"pw": _log_kt(zeros, ones)}))
    return pd.concat(parts)


def gram_answers(asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
    """For each block of a bucket the log10 probabilities of its byte strings."""
    known = known.sort_values("node")
    nodes, ones = known["node"].to_numpy(), known["p"].to_numpy()
    rows = []
    for block, bucket, own in zip(asked["block"], asked["bucket"], asked["keys"], strict=True):
        grams = spread_keys(own)
        total = np.zeros(len(grams))
        for node, bit in decisions(grams):
            p = ones[np.searchsorted(nodes, node)]
            total += np.log10(np.where(bit == 1, p, 1 - p))
        rows.append((block, GRAM_VALUES, bucket, None, squeeze(total)))
    return pd.DataFrame(rows, columns=["block", "kind", "bucket", "keys", "counts"])


def _log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    log_gamma, out = np.frompyfunc(lgamma, 1, 1), np.empty(len(zeros))
    for at in range(0, len(zeros), LOGS):
        own = slice(at, at + LOGS)
        terms = log_gamma(zeros[own] + 0.5) + log_gamma(ones[own] + 0.5) - log_gamma(zeros[own] + ones[own] + 1.0)
        out[own] = terms.astype(float) - 2 * lgamma(0.5)
    return out


@F.pandas_udf(T.DoubleType())
def log_kt(zeros: pd.Series, ones: pd.Series) -> pd.Series:
    """Natural logarithm of the Krichevsky-Trofimov probability of a node's decisions."""
    return pd.Series(_log_kt(zeros.to_numpy(), ones.to_numpy()))


def weighted_tree(deepest: DataFrame, depth: int) -> DataFrame:
    """Probability that a decision is 1, at every deepest node: (bucket, node, p).

    A node is its bytes, latest last, and the bits already decided. Sums go up the tree one
    depth at a time; a parent has at most 256 children. On the way down each level adds its
    weighted estimate to those above it, so that a deepest node needs its parent alone. The
    two topmost levels have at most 255 and 65,280 nodes, which is why they may be broadcast.
    """
    one = (F.col("ones") + 0.5) / (F.col("zeros") + F.col("ones") + 1)
    lowest, _ = write_out(deepest, "tree")
    levels = [lowest]
    for level in range(depth - 1, -1, -1):
        own = F.col("kt") - F.col("below")
        grown = (
            levels[-1]
            .groupBy(_suffix(F.col("node"), level).alias("node"))
            .agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("pw").alias("below"))
            .withColumn("kt", log_kt("zeros", "ones"))
            .withColumn("stop", F.when(own > 0, 1 / (1 + F.exp(-own))).otherwise(F.exp(own) / (1 + F.exp(own))))
            .withColumn("pw", F.greatest("kt", "below") + F.log1p(F.exp(-F.abs(own))) - float(np.log(2)))
        )
        levels.append(write_out(grown, "tree")[0])
    # Of a node: the sum of the weighted estimates down to it, and the weight left below.
    above = None
    for level, table in enumerate(reversed(levels[1:])):
        mixed = table.select("node", "stop", one.alias("one"))
        if above is None:
            placed = mixed.withColumns({"sum": F.lit(0.0), "rest": F.lit(1.0)})
        else:
            placed = mixed.join(above, _suffix(F.col("node"), level - 1) == F.col("upper"))
        above = placed.select(
            F.col("node").alias("upper"),
            (F.col("sum") + F.col("rest") * F.col("stop") * F.col("one")).alias("sum"),
            (F.col("rest") * (1 - F.col("stop"))).alias("rest"),
        )
        above = F.broadcast(above) if level <= 1 else above
    return lowest.join(above, _suffix(F.col("node"), depth - 1) == F.col("upper")).select(
        "bucket", "node", (F.col("sum") + F.col("rest") * one).alias("p")
    )


def _suffix(node: Column, level: int) -> Column:
    """The node of the same decision with the latest ``level`` bytes alone."""
    return node.bitwiseAND((1 << 8 * (level + 1)) - 1)


def block_scores(group: pd.DataFrame, depth: int, buckets: int, total: int, distinct_words: int) -> pd.DataFrame:
    """The documents of a block with their scores.

    Answers come without the keys: the block finds these again in its text, in the order asked.
    """
    parts = {kind: rows.sort_values("bucket") for kind, rows in group.groupby("kind")}
    docs = parts[DOCS].iloc[0]
    sizes = np.frombuffer(docs["sizes"], np.int64)
    text = pa.decompress(docs["keys"], decompressed_size=int(sizes.sum()), codec="zstd", asbytes=True)
    ids, flags = np.frombuffer(docs["ids"], np.int64), np.frombuffer(docs["flags"], np.uint8)
    ends = np.cumsum(sizes)
    # A string of bytes and the number of its text are one value of 64 bits.
    bits = np.uint64(64 - 8 * (depth + 1))

    def runs() -> Iterator[list[bytes]]:
        return together((text[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)), 1 << int(bits))

    def table(kind: int, values: int, dtype: type) -> tuple[np.ndarray, np.ndarray]:
        found = (word_keys(texts) if kind == WORDS else gram_keys(texts, depth) for texts in runs())
        keys = distinct(np.concatenate([distinct(own)[0] for own, _ in found]))[0]
        answers = np.empty(len(keys), dtype)
        order, at = asked_order(keys, kind, buckets)[1], 0
        for packed in parts[values]["counts"]:
            own = spread(packed, dtype)
            answers[order[at : at + len(own)]] = own
            at += len(own)
        return keys, answers

    words, counts = table(WORDS, WORD_VALUES, np.int64)
    grams, logs = table(GRAMS, GRAM_VALUES, np.float64)
    unigram = np.log10((counts + 0.5) / (total + 0.5 * (distinct_words + 1)))
    scored = []
    for texts in runs():
        keys, at = word_keys(texts)
        own = np.searchsorted(words, keys)
        scored.append([np.bincount(at, each, len(texts)) for each in (np.ones(len(at)), counts[own] > 0, unigram[own])])
        keys, at = gram_keys(texts, depth)
        keys = keys.view(np.uint64)
        keys <<= bits
        keys |= at.view(np.uint64)
        # In order, each byte string is looked up once for all the places where it stands.
        keys.sort()
        at = (keys & np.uint64((1 << int(bits)) - 1)).view(np.int64)
        keys >>= bits
        own, times = lengths(keys)
        own = logs[np.searchsorted(grams, own.view(np.int64))]
        scored[-1].append(np.bincount(at, np.repeat(own, times), len(texts)))
    tokens, known, base, score = (np.concatenate(each) for each in zip(*scored, strict=True))
    return pd.DataFrame(
        {
            "doc_id": pd.arrays.IntegerArray(ids.copy(), flags & 2 > 0),
            "held_out": flags & 1 > 0,
            "n_tokens": tokens.astype(np.int64),
            "n_known": known.astype(np.int64),
            "train_tokens": total,
            "base_score": base,
            "score": score,
            "bits_per_byte": -score / np.log10(2) / (sizes + 1),
        }
    )


SCORES = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long,"
    " base_score double, score double, bits_per_byte double"
)


def score_documents(documents: DataFrame, held_out: Column, depth: int = DEPTH) -> DataFrame:
    """Scores of all documents by a model of those that are not held out.

    bits_per_byte is the code length of the lower-cased text and its end per byte.
    """
    if not 1 <= depth <= 6:
        raise ValueError("a context has one to six bytes")
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = 1 + size // BUCKET
    packed, _ = write_out(pack(documents, held_out, depth, buckets), "blocks")
    words = packed.where(F.col("kind") == WORDS).select(*PART.replace(",", "").split()[::2])
    grams = packed.where(F.col("kind") == GRAMS).select(*PART.replace(",", "").split()[::2])
    counted, _ = write_out(
        words.groupBy("bucket").applyInPandas(word_answers, f"{PART}, total long, known long"), "words"
    )
    total, distinct = counted.agg(F.sum("total"), F.sum("known")).first()
    nodes = grams.groupBy("bucket").applyInPandas(deepest_nodes, "bucket int, node long, zeros long, ones long, pw double")
    tree = weighted_tree(nodes, depth)
    answers = grams.groupBy("bucket").cogroup(tree.groupBy("bucket")).applyInPandas(gram_answers, PART)
    returned = counted.where("block is not null").drop("total", "known").unionByName(answers)
    total, distinct = total or 0, distinct or 0

    def score(group: pd.DataFrame) -> pd.DataFrame:
        return block_scores(group, depth, buckets, total, distinct)

    # A block's text and the answers alone: what it asked for it can find again.
    texts = packed.where(F.col("kind") == DOCS).drop("counts")
    every = texts.unionByName(returned.drop("keys"), allowMissingColumns=True)
    return every.groupBy("block").applyInPandas(score, SCORES)


def context_tree_scores(documents: DataFrame) -> DataFrame:
    """Scores of all documents; the fold whose remainder is 1 is held out."""
    return score_documents(documents.select("doc_id", "text"), fold(F.col("doc_id")) == 1)
