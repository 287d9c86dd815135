"""N-gram Jaccard join by trees of count vectors.

A document is the set of its word n-grams, as 64-bit hashes. Documents with equal sets are
one class, and every class is a point, its n-grams counted by hashed group. Classes that can
link are brought together exactly: sets that overlap enough differ in at most D elements,
so when the elements are dealt by hash into more than D groups, one non-empty group is the
same in both. Classes that agree in a group meet in a bucket.

A tree of boxes over points bounds the overlap of two boxes, and of two points, by the sum of
the smaller coordinates. In a bucket, pairs that the bound lets through make families (a
bucket too large for one task is one family). Families too large for one task are split by the same
bound on points of more coordinates. Within a family the same tree finds the
pairs again, which are then verified on their sets. A large family is cut into tiles of sets of like
size, joined within and then with the tiles of the same and the next sizes, and pairs already
connected are not compared again. Links are
never listed pair by pair: a bucket or tile gives a star for each of its components.

Documents without words or text have an empty set and link with nothing. Those without an
id take no part: their component is null. Rows that share an id share their component
if their texts do; a component is named by its smallest doc_id.
"""

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsweave.llm.graph import components
from newsweave.llm.words import Hashes
from newsweave.session import broadcast_if_small, write_out

# Coordinates of a point, and children of a box.
GROUPS = 32
FAN = 16
# Coordinates of a fine point, and classes in a tile of these.
FINE = 256
FINE_TILE = 4096
# Growth of the size bands that share a number of groups.
BAND = 1.5
# Classes and n-grams in a tile, and n-grams in a task of small families.
TILE = 1024
TILE_GRAMS = 2_000_000
# Rows of buckets in a task.
BUCKET_ROWS = 50_000
# Pairs whose bounds are computed at once.
PAIRS = 1 << 16
# Fine points compared with a tile at once.
TOGETHER = 64
ROWS = 500


def mixed(values: np.ndarray, salt: int = 0) -> np.ndarray:
    """Well-spread 64-bit values of 64-bit values."""
    v = values.astype(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
    v = (v ^ (v >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    v = (v ^ (v >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return v ^ (v >> np.uint64(31))


def gram_set(text: str | None, words: int, hashes: Hashes) -> np.ndarray:
    """Sorted hashes of the distinct word n-grams; of all words together if they are fewer."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    own = np.fromiter(map(hashes.__getitem__, found), np.int64, len(found)).astype(np.uint64)
    size = min(words, len(own))
    grams = np.full(len(own) - size + 1, size, np.uint64)
    for at in range(size):
        grams = mixed(grams + own[at : at + len(grams)], 1)
    return np.unique(grams)


class Bands:
    """Bands of set sizes, with the groups that bring two linked sets together.

    Band ``j`` serves pairs whose smaller set lies in it. With sizes a <= b, overlap I and
    union U, den * I >= num * U leaves at most a * (den - num) / num elements to one side alone.
    """

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den, self.starts = num, den, [1]

    def band(self, size: int) -> int:
        while self.starts[-1] <= size:
            last = self.starts[-1]
            self.starts.append(max(last + 1, int(last * BAND)))
        return int(np.searchsorted(self.starts, size, side="right")) - 1

    def differ(self, band: int) -> int:
        self.band(self.starts[min(band, len(self.starts) - 1)])
        return (self.starts[band + 1] - 1) * (self.den - self.num) // self.num

    def groups(self, band: int) -> int:
        """Enough groups that over ``differ`` of them are nearly always non-empty."""
        least, wanted = self.starts[band], self.differ(band) + 1
        groups = wanted
        while groups < 4 * least + 8:
            empty = groups * math.exp(-least / groups)
            if groups - empty - 3 * math.sqrt(empty) >= wanted:
                break
            groups += 1 + groups // 50
        return groups

    def keys(self, grams: np.ndarray) -> np.ndarray:
        """The keys of a set: one for each non-empty group, in every band it can pair in.

        Were there no more of these than elements may differ, the empty groups have keys too.
        """
        size, out = len(grams), []
        if size:
            for band in range(self.band(-(-size * self.num // self.den)), self.band(size) + 1):
                wanted = self.differ(band)
                if wanted == 0:
                    continue  # such sets are equal, and one class
                groups = self.groups(band)
                place = (mixed(grams, 2) >> np.uint64(20)) % np.uint64(groups)
                order = np.argsort(place, kind="stable")
                held, first = np.unique(place[order], return_index=True)
                content = np.add.reduceat(mixed(grams, 3)[order], first)
                if len(held) <= wanted:
                    rest = np.setdiff1d(np.arange(groups, dtype=np.uint64), held)
                    held = np.concatenate([held, rest])
                    content = np.concatenate([content, np.zeros(len(rest), np.uint64)])
                out.append(mixed(content + mixed(held, 100 + band), 4))
        return np.concatenate(out) if out else np.zeros(0, np.uint64)


def class_of(grams: np.ndarray) -> int:
    """A class's number, from its set."""
    with np.errstate(over="ignore"):
        total = mixed(np.array([mixed(grams, 5).sum(dtype=np.uint64) + np.uint64(len(grams))]), 6)
    return int(total.view(np.int64)[0])


def point(grams: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    return np.bincount((mixed(grams, 7) >> np.uint64(40)).astype(np.int64) % groups, minlength=groups)


def _sketches(documents: DataFrame, words: int) -> DataFrame:
    """doc_id, size, class and point of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                rows = batch.slice(start, ROWS)
                found = []
                for text in rows.column("text"):  # a set is let go before the next is made
                    grams = gram_set(text.as_py(), words, hashes)
                    found.append((len(grams), class_of(grams), point(grams).astype(np.int32).tobytes()))
                sizes, classes, points = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), pa.array(points, pa.binary())],
                    ["doc_id", "size", "class", "point"],
                )

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, size long, class long, point binary")


def _keys(documents: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """key and class; a class that a task has met before is not listed again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, bands, met = Hashes(), Bands(num, den), set()
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                keys, classes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
                for text in batch.column("text").slice(start, ROWS):
                    grams = gram_set(text.as_py(), words, hashes)
                    if (own := class_of(grams)) not in met:
                        met.add(own)
                        keys.append(bands.keys(grams))
                        classes.append(np.full(len(keys[-1]), own))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(classes))],
                    ["key", "class"],
                )

    kept = documents.where("doc_id is not null and text is not null").select("text")
    return kept.mapInArrow(run, "key long, class long")


def _texts(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """Texts of the documents named by ``wanted`` (class, doc_id), with its columns.

    A class comes from one id; only rows that repeat it with another text do not belong, and are
    told by their set.
    """
    return documents.select("doc_id", "text").join(broadcast_if_small(wanted), "doc_id").drop("doc_id")


def _with_sets(frame: pd.DataFrame, words: int) -> pd.DataFrame:
    """The rows of ``class`` and ``text`` whose text is of the class, with its set."""
    hashes = Hashes()
    sets = [gram_set(text, words, hashes) for text in frame["text"]]
    own = [class_of(grams) == known for grams, known in zip(sets, frame["class"], strict=True)]
    return frame.drop(columns="text").assign(grams=sets)[own]


def _fine_points(documents: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """``wanted`` (class, doc_id and others) with ``fine``, the compressed fine point of the class."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), ROWS):
                own = _with_sets(frame.iloc[start : start + ROWS], words)
                counts = [point(grams, FINE).astype(np.int32).tobytes() for grams in own["grams"]]
                fine = [pa.compress(each, codec="zstd", asbytes=True) for each in counts]
                yield own.drop(columns="grams").assign(fine=fine)

    texts = _texts(documents, wanted)
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in texts.schema if f.name != "text")
    return texts.mapInPandas(run, f"{kept}, fine binary")


class Forest:
    """Disjoint sets of numbers 0 to n - 1."""

    def __init__(self, labels: np.ndarray) -> None:
        first: dict[int, int] = {}
        self.up = [first.setdefault(label, at) for at, label in enumerate(labels.tolist())]

    def root(self, at: int) -> int:
        while self.up[at] != at:
            self.up[at] = self.up[self.up[at]]
            at = self.up[at]
        return at


def candidates(points: np.ndarray, sizes: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs i < j whose bound allows a link, from a tree of boxes over the points.

    A box knows the largest count per coordinate and the smallest set below it. Points are
    packed by size. Pairs of boxes are opened level by level from the top.
    """
    order = np.lexsort((*points.T[:4], sizes))
    levels = [(points[order], sizes[order])]
    while len(levels[-1][0]) > FAN:
        tops, least = levels[-1]
        fill = -len(tops) % FAN
        tops = np.concatenate([tops, np.zeros((fill, tops.shape[1]), tops.dtype)])
        least = np.concatenate([least, np.full(fill, least.max())])
        levels.append((tops.reshape(-1, FAN, tops.shape[1]).max(axis=1), least.reshape(-1, FAN).min(axis=1)))
    top = len(levels[-1][0])
    left, right = np.triu_indices(top)
    for depth in range(len(levels) - 1, -1, -1):
        tops, least = levels[depth]
        kept = []
        for at in range(0, len(left), PAIRS):
            a, b = left[at : at + PAIRS], right[at : at + PAIRS]
            bound = np.minimum(tops[a], tops[b]).sum(axis=1)
            kept.append(bound * (num + den) >= num * (least[a] + least[b]))
        passed = np.concatenate(kept) if kept else np.zeros(0, bool)
        left, right = left[passed], right[passed]
        if depth:
            below = len(levels[depth - 1][0])
            a, b = np.meshgrid(np.arange(FAN), np.arange(FAN), indexing="ij")
            left, right = (left[:, None] * FAN + a.ravel()).ravel(), (right[:, None] * FAN + b.ravel()).ravel()
            good = (left <= right) & (right < below)
            left, right = left[good], right[good]
    real = left < right
    return order[left[real]], order[right[real]]


def bucket_stars(frame: pd.DataFrame, num: int, den: int) -> pd.DataFrame:
    """Stars of the classes whose bound allows a link with another of their bucket."""
    frame = frame.drop_duplicates(["key", "class"]).sort_values("key")
    keys, classes, sizes = (frame[name].to_numpy() for name in ("key", "class", "size"))
    points = np.frombuffer(b"".join(frame["point"]), np.int32).reshape(len(frame), -1)
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
    counts = np.diff(np.append(starts, len(keys)))
    two = starts[counts == 2]
    bound = np.minimum(points[two], points[two + 1]).sum(axis=1)
    two = two[bound * (num + den) >= num * (sizes[two] + sizes[two + 1])]
    found = set(zip(classes[two].tolist(), classes[two + 1].tolist(), strict=True))
    for start, count in zip(starts[counts > 2].tolist(), counts[counts > 2].tolist(), strict=True):
        own = slice(start, start + count)
        forest = Forest(classes[own])
        left, right = candidates(points[own], sizes[own], num, den)
        for a, b in zip(left.tolist(), right.tolist(), strict=True):
            one, other = forest.root(a), forest.root(b)
            if one != other:
                forest.up[other] = one
        found |= {(int(classes[start + a]), int(classes[start + forest.root(a)])) for a in range(count) if forest.root(a) != a}
    return pd.DataFrame(list(found), columns=["a", "b"], dtype=np.int64)


def _families(buckets: DataFrame, sketches: DataFrame, num: int, den: int) -> DataFrame:
    """class and family of every class that may link with another."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return bucket_stars(frame, num, den)

    points = sketches.groupBy("class").agg(F.any_value("size").alias("size"), F.any_value("point").alias("point"))
    fitting = buckets.where(F.col("n") <= TILE)
    tasks = 8 + fitting.count() // BUCKET_ROWS
    task = F.pmod(F.xxhash64("key"), F.lit(tasks))
    near = fitting.join(points, "class").groupBy(task.alias("task")).applyInPandas(run, "a long, b long")
    large = buckets.where((F.col("n") > TILE) & (F.col("class") != F.col("first")))
    links = near.unionByName(large.select(F.col("class").alias("a"), F.col("first").alias("b")))
    return components(links).select(F.col("node").alias("class"), F.col("component").alias("family"))


def fine_stars(frame: pd.DataFrame, num: int, den: int) -> pd.DataFrame:
    """Stars of the classes whose fine points allow a link: within a tile, or between the two given.

    ``side`` tells the tiles apart. Each point of the first meets those of like size of the other.
    """
    frame = frame.drop_duplicates("class").sort_values(["side", "size", "class"])
    classes, sizes = frame["class"].to_numpy(), frame["size"].to_numpy()
    width = 4 * FINE
    data = b"".join(pa.decompress(each, decompressed_size=width, codec="zstd", asbytes=True) for each in frame["fine"])
    points = np.frombuffer(data, np.int32).reshape(-1, FINE)
    # A bound is at most the smaller set's size.
    points = points.astype(np.uint16 if len(sizes) and sizes.max() < 1 << 16 else np.int64)
    first = int((frame["side"].to_numpy() == frame["side"].iloc[0]).sum()) if len(frame) else 0
    other = first if first < len(frame) else 0
    across, far = np.ascontiguousarray(points[other:].T), sizes[other:]
    labels = np.arange(len(frame))
    for at in range(0, first, TOGETHER):
        own = sizes[at : min(at + TOGETHER, first)]
        low = int(np.searchsorted(far, own[0] * num // den, side="left"))
        high = int(np.searchsorted(far, -(-own[-1] * den // num), side="right"))
        bound = np.zeros((len(own), high - low), points.dtype)
        for group in range(FINE):
            bound += np.minimum(points[at : at + len(own), group, None], across[group, low:high])
        passing = bound.astype(np.int64) * (num + den) >= num * (own[:, None] + far[low:high])
        for row in np.flatnonzero(passing.any(axis=1)):
            met = np.unique(np.append(labels[other + low + np.flatnonzero(passing[row])], labels[at + row]))
            if len(met) > 1:
                labels[np.isin(labels, met)] = met[0]
    away = np.flatnonzero(labels != np.arange(len(labels)))
    return pd.DataFrame({"a": classes[away], "b": classes[labels[away]]}, dtype=np.int64)


def _size_band(num: int, den: int) -> Column:
    """Sets whose bands are no neighbours cannot link."""
    return F.floor(F.log("size") / (math.log(den / num) + 1e-6))


def _tile_pairs(tiles: DataFrame) -> DataFrame:
    """Pairs of tiles (family, band, at, and band2, at2) of the same and the next band of a family."""
    other = tiles.select("family", *[F.col(name).alias(f"{name}2") for name in tiles.columns if name != "family"])
    return tiles.join(other, "family").where("band2 = band + 1 or band2 = band and at <= at2")


def _refined(documents: DataFrame, sized: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """``sized`` with families of more than one tile split into those that fine points allow.

    A large bucket is one family, and the bound of coarse points lets many through; a fine point is
    far smaller than a text, so tiles of these meet before any text travels. Classes whose bound
    allows no link leave.
    """
    weights = sized.groupBy("family").agg(F.count("*").alias("n"), F.sum("size").alias("grams"))
    large = weights.where((F.col("n") > TILE) | (F.col("grams") > TILE_GRAMS)).select("family")
    large, _ = write_out(large, "large")
    if large.isEmpty():
        return sized
    own = sized.join(broadcast_if_small(large), "family").withColumn("band", _size_band(num, den))
    fill = own.groupBy("family", "band").agg(F.ceil(F.count("*") / FINE_TILE).cast("long").alias("fill"))
    placed = own.join(fill, ["family", "band"]).withColumn("at", F.pmod(F.xxhash64("class"), F.col("fill"))).drop("fill")
    points, _ = write_out(_fine_points(documents, placed, words), "points")
    names = ["family", "band", "at"]
    pairs = _tile_pairs(points.select(*names).distinct()).withColumn("tile", F.concat_ws("/", *names, "band2", "at2"))
    same = (F.col("band") == F.col("band2")) & (F.col("at") == F.col("at2"))
    ends = pairs.select(*names, "tile", F.lit(0).alias("side")).unionByName(
        pairs.where(~same).select("family", F.col("band2").alias("band"), F.col("at2").alias("at"), "tile", F.lit(1).alias("side"))
    )

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return fine_stars(frame, num, den)

    met = points.join(broadcast_if_small(write_out(ends, "ends")[0]), names).select("tile", "side", "class", "size", "fine")
    found = components(met.groupBy("tile").applyInPandas(run, "a long, b long"))
    found = found.select(F.col("node").alias("class"), F.col("component").alias("family"))
    split = sized.drop("family").join(found, "class").select(*sized.columns)
    return sized.join(broadcast_if_small(large), "family", "left_anti").select(*sized.columns).unionByName(split)


def linked(group: pd.DataFrame, num: int, den: int) -> list[tuple[int, int]]:
    """Stars of the components among the classes of a group, given what is connected."""
    group = group.drop_duplicates("class")
    classes = group["class"].to_numpy()
    sets = group["grams"].tolist()
    sizes = np.array([len(s) for s in sets])
    forest = Forest(group["label"].to_numpy())
    left, right = candidates(np.array([point(s) for s in sets]), sizes, num, den)
    for a, b in zip(left.tolist(), right.tolist(), strict=True):
        one, other = forest.root(a), forest.root(b)
        if one != other:
            both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
            if both * (num + den) >= num * int(sizes[a] + sizes[b]):
                forest.up[other] = one
    return [(int(classes[at]), int(classes[forest.root(at)])) for at in range(len(classes)) if forest.root(at) != at]


def _link(tiles: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Links (a, b) within each group of ``task`` and ``tile``; sets are made anew from the texts.

    A text is smaller than its set, and shuffles compress it.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        found = [pair for _, own in frame.groupby("tile") for pair in linked(_with_sets(own, words), num, den)]
        return pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)

    return tiles.groupBy("task").applyInPandas(run, "a long, b long")


def _links(documents: DataFrame, sketches: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Links (a, b) that connect every pair of classes whose sets overlap enough."""
    shared = _keys(documents, words, num, den)
    by_key = {"first": "min(class)", "last": "max(class)", "n": "count(*)"}
    held = shared.select("*", *[F.expr(f"{what} over (partition by key)").alias(name) for name, what in by_key.items()])
    buckets, _ = write_out(held.where("first != last").drop("last"), "buckets")
    members, _ = write_out(_families(buckets, sketches, num, den), "families")
    chosen = sketches.join(members, "class").groupBy("class", "family")
    sized, _ = write_out(chosen.agg(F.min("doc_id").alias("doc_id"), F.any_value("size").alias("size")), "chosen")
    sized, _ = write_out(_refined(documents, sized, words, num, den), "refined")
    weights = sized.groupBy("family").agg(F.count("*").alias("n"), F.sum("size").alias("grams"))
    weights = weights.select(
        "family", F.ceil(F.greatest(F.col("n") / TILE, F.col("grams") / TILE_GRAMS)).cast("long").alias("tiles")
    )
    total = sized.agg(F.sum("size")).first()[0] or 0
    # A small family is one tile, and a task takes many of them; a tile of a large one has its own. Tiles
    # of a large one hold sets of like size: those of bands that are no neighbours cannot link.
    band = F.when(F.col("tiles") > 1, _size_band(num, den)).otherwise(-1)
    banded = sized.join(weights, "family").withColumn("band", band)
    fill = banded.groupBy("family", "band").agg(
        F.ceil(F.greatest(F.count("*") / TILE, F.sum("size") / TILE_GRAMS)).cast("long").alias("fill")
    )
    tile = F.pmod(F.xxhash64("class"), F.col("fill"))
    placed, _ = write_out(
        banded.join(fill, ["family", "band"]).select("class", "doc_id", "family", "tiles", "band", tile.alias("at")), "placed"
    )
    joined = _texts(documents, placed).withColumn("label", F.col("class"))
    small = F.pmod(F.xxhash64("family"), F.lit(8 + total // TILE_GRAMS)).cast("string")
    alone = F.concat_ws("/", "family", "band", "at")
    inner, _ = write_out(
        _link(
            joined.select(
                F.when(F.col("tiles") == 1, small).otherwise(alone).alias("task"), alone.alias("tile"), "class", "label", "text"
            ),
            words,
            num,
            den,
        ),
        "inner",
    )
    large = placed.where("tiles > 1")
    if large.isEmpty():
        return inner
    # Between tiles: only pairs of tiles that are not wholly one component yet.
    known = components(inner).select(F.col("node").alias("class"), "component")
    labelled, _ = write_out(
        large.join(known, "class", "left").select(
            "class", "doc_id", "family", "band", "at", F.coalesce("component", "class").alias("label")
        ),
        "labelled",
    )
    spread = labelled.groupBy("family", "band", "at").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    open_pairs = (
        _tile_pairs(spread)
        .where("not (band = band2 and at = at2) and not (low = high and low2 = high2 and low = low2)")
        .select("family", "band", "at", "band2", "at2", F.concat_ws("/", "family", "band", "at", "band2", "at2").alias("tile"))
    )
    ends = open_pairs.select("family", "band", "at", "tile").unionByName(
        open_pairs.select("family", F.col("band2").alias("band"), F.col("at2").alias("at"), "tile")
    )
    pairs = _texts(documents, labelled.join(ends, ["family", "band", "at"]).select("class", "doc_id", "label", "tile"))
    between = _link(pairs.select(F.col("tile").alias("task"), "tile", "class", "label", "text"), words, num, den)
    return inner.unionByName(between)


def _placed_rows(documents: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Per document: doc_id, size, class and the component of its class (its smallest doc_id)."""
    sketches, _ = write_out(_sketches(documents, words), "sketches")
    links = _links(documents, sketches.where("doc_id is not null and size > 0"), words, num, den)
    joined = components(links).select(F.col("node").alias("class"), F.col("component").alias("root"))
    least = sketches.where("size > 0 and doc_id is not null").groupBy("class").agg(F.min("doc_id").alias("least"))
    rooted = least.join(joined, "class", "left").withColumn("root", F.coalesce("root", "class"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_class = rooted.join(named, "root").select("class", "component_id")
    return sketches.join(by_class, "class", "left")


def similar_documents(documents: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Per document: doc_id, n_shingles and component_id, linking where den * I >= num * U."""
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _placed_rows(documents, words, num, den).select(
        "doc_id",
        F.col("size").alias("n_shingles"),
        F.when(F.col("size") == 0, F.col("doc_id"))
        .when(F.col("doc_id").isNotNull(), F.col("component_id"))
        .alias("component_id"),
    )


def one_of_each(documents: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``documents`` with one row of each component; columns stay.

    Rows are told apart by a key of their own, so repeated rows, rows that share an id and rows
    without one take part each with its text. The row with the smallest doc_id stays, then that
    of the smallest class; a row with an id goes before one without. Of rows without shingles one
    for each id stays, and all that have no id.
    """
    keyed = documents.withColumn("_row", F.monotonically_increasing_id())
    rows, _ = write_out(keyed, "rows")
    texts = rows.select(F.col("_row").alias("doc_id"), "text")
    found = _placed_rows(texts, words, num, den).select(
        F.col("doc_id").alias("_row"), "class", F.when(F.col("size") > 0, F.col("component_id")).alias("_component")
    )
    ids = rows.select("_row", F.col("doc_id").cast("long").alias("_id"))
    members, _ = write_out(found.join(ids, "_row").where("_component is not null or _id is not null"), "members")
    # Without shingles the id stands for the component.
    alone = F.when(F.col("_component").isNull(), F.col("_id"))
    first = F.min(F.struct(F.col("_id").isNull(), "_id", "class", "_row"))["_row"]
    kept = members.groupBy("_component", alone).agg(first.alias("_row")).select("_row")
    gone = members.select("_row").join(kept, "_row", "left_anti")
    return rows.join(broadcast_if_small(write_out(gone, "gone")[0]), "_row", "left_anti").select(*documents.columns)
