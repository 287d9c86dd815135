"""Embedding near-duplicates by hierarchical navigable small-world graphs.

Equal vectors are one point with a weight. Points of one length are compared in one room, or, if they are more than a shard
holds, in overlapping regions (``regions.py``): near points share a region, and a link counts in the first region that its ends
share. A point so meets a bounded number of others, and not all of them.

The points of a room are dealt to shards by hash, of which most regions have one; a shard's task
builds a layered graph whose links are chosen for diversity, and every point of the room queries every
shard: greedily down the layers, then with a beam over the lowest. Where the room is one shard, a point has done so when it went into the
graph. Two audits widen the beam until
the wanted share of links is found: when a shard is built, queries planted at the least cosine from drawn
points must find these; when queries meet it, a drawn number of them is compared with the whole shard.
A query that finds many links in a shard is compared with all of it, so that its number of links there is exact, and a
beam as wide as a good part of the shard is the shard itself, compared point by point. What is found is
verified by its cosine in double precision.

A link that either end found counts for both: a query lists what it found where that is little, and tells
points that few queries of its part have found. So the lists stay short, and a group of equal or near vectors never becomes
all its pairs; their counts in a room are exact on their own. One star link per query and shard connects the
component of what it found.

Null, zero and non-finite vectors and null ids link with nothing: no links, a component of
their own. Vectors link within their own length. Rows that repeat an id stay rows of their own, in the component of
their vectors. Vectors are named by 64-bit hashes (a second hash keeps rows apart that share one), so
reruns build the same shards and graphs.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from newsweave.llm.graph import components
from newsweave.llm.regions import DRAWN, Regions, learn
from newsweave.llm.vectors import SHARD_ROWS, meet, parts_of, shards_of, usable, usable_rows
from newsweave.session import write_out

# Links of a point in a layer (twice as many in the lowest), and the beam while building.
LINKS = 12
BUILD_BEAM = 48
BEAM = 48
# A beam over this share of a shard costs more than all of its points.
WHOLE = 1 / 8
# Points put into the graph, or searched for, at once.
TOGETHER = 256
# Beam entries opened in one step.
STEP = 4
# Links in a shard from which on a query is compared with all of it.
MANY = 24
# Queries planted in a shard, queries of a part compared with a whole shard, and the share of links to be found.
PLANTED = 256
AUDITED = 512
RECALL = 0.995
# A beam's empty place, and the bits of an entry that hold its point.
NONE, POINT = -4.0, (1 << 29) - 2
# Links verified at once, and the longest answer that is a list of points and not bits.
VERIFIED = 65_536
LISTED = 4_096
# A length has several shards only if they hold so many vectors.
FILL = 1024
BLOCK = "room int, at int, ids binary, weights binary, vectors binary, homes binary, single boolean"
GRAPH = BLOCK + ", layers array<binary>, beam int"
# ``length`` is the room: a length, or a region.
FOUND = (
    "id long, weight long, length int, shard int, whole boolean, n long, star long,"
    " others array<long>, weights array<long>, told array<boolean>"
)


def _keys(cosines: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Cosines in single precision as doubles whose lowest bits hold the points, and a last one for those opened.

    They sort by cosine, and one sort moves all that is known of a beam's entry.
    """
    keys = cosines.astype(np.float32).astype(np.float64)
    keys.view(np.int64)[...] |= points.astype(np.int64) << 1
    return keys


def _unkeyed(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The points (-1 for none) and cosines of keys."""
    bits = keys.view(np.int64)
    points = np.where(keys > NONE, (bits & POINT) >> 1, -1)
    return points, np.where(points < 0, -2.0, (bits & ~(POINT | 1)).view(np.float64)).astype(np.float32)


def search_layer(
    vectors: np.ndarray, links: np.ndarray, queries: np.ndarray, entries: np.ndarray, beam: int
) -> tuple[np.ndarray, np.ndarray]:
    """The beams of many queries at once: points (-1 for none) and cosines, best first."""
    count, width, size = len(queries), max(beam, entries.shape[1]), len(vectors) + 1
    held = np.full((count, width), NONE)
    held[:, : entries.shape[1]] = _keys(np.einsum("qd,qed->qe", queries, vectors[entries]), entries)
    done, live = held.copy(), np.arange(count)
    # Places of a query's points in tables of all queries; the one in front of them stands for no point.
    first = np.arange(count)[:, None] * size + 1
    seen, claims = np.zeros(count * size, bool), np.empty(count * size, np.int32)
    seen[first - 1] = True
    seen[first + entries] = True
    step = min(STEP, width)
    while True:
        waiting = np.where(held.view(np.int64) & 1, NONE, held)
        chosen = np.partition(waiting, width - step, axis=1)[:, width - step :]
        some = chosen[:, -step:].max(axis=1) > NONE
        if not some.all():
            done[live[~some]] = held[~some]
            live, queries, first = live[some], queries[some], first[some]
            held, waiting, chosen = held[some], waiting[some], chosen[some]
        if not len(live):
            break
        held.view(np.int64)[(waiting >= chosen.min(axis=1, keepdims=True)) & (waiting > NONE)] |= 1
        own = links.take((chosen.view(np.int64) & POINT) >> 1, axis=0)
        own[chosen <= NONE] = -1
        own = own.reshape(len(live), -1)
        places = (own + first).ravel()
        new = np.flatnonzero(~seen.take(places))
        # A point that two opened ones lead to is met once.
        turn, there = np.arange(len(new), dtype=np.int32), places.take(new)
        claims[there] = turn
        new = new[claims.take(there) == turn]
        seen[places.take(new)] = True
        each = np.bincount(new // own.shape[1], minlength=len(live))
        met = np.full((len(live), int(each.max())), -1, np.int64)
        met[np.arange(met.shape[1]) < each[:, None]] = own.ravel().take(new)
        near = np.matmul(vectors.take(np.maximum(met, 0), axis=0), queries[:, :, None])[:, :, 0]
        every = np.concatenate([held, np.where(met < 0, NONE, _keys(near, np.maximum(met, 0)))], axis=1)
        held = every if not met.shape[1] else np.partition(every, met.shape[1], axis=1)[:, met.shape[1] :]
        held = np.ascontiguousarray(held)
    return _unkeyed(-np.sort(-done, axis=1))


def diverse(vectors: np.ndarray, points: np.ndarray, cosines: np.ndarray, keep: int) -> np.ndarray:
    """Of candidates, best first, half the places for the nearest, and the other half for
    those nearer to their point than to one kept before.

    The nearest hold a dense group together, the others lead out of it. Places left over go
    to the best of the rest. Returns ``keep`` columns, -1 for none.
    """
    near = vectors.take(np.maximum(points, 0), axis=0)
    between = np.matmul(near, near.transpose(0, 2, 1))
    kept = points >= 0
    kept[:, keep // 2 :] = False
    for at in range(keep // 2, points.shape[1]):
        closest = np.where(kept, between[:, at], -2.0).max(axis=1)
        kept[:, at] = (points[:, at] >= 0) & (cosines[:, at] > closest) & (kept.sum(axis=1) < keep)
    rank = np.where(points < 0, 2, np.where(kept, 0, 1)) * points.shape[1] + np.arange(points.shape[1])
    order = np.argsort(rank, axis=1)[:, :keep]
    out = np.take_along_axis(points, order, axis=1)
    if out.shape[1] < keep:
        out = np.pad(out, ((0, 0), (0, keep - out.shape[1])), constant_values=-1)
    return out


def _bits(points: np.ndarray, count: int) -> np.ndarray:
    marks = np.zeros(count, bool)
    marks[points] = True
    return np.packbits(marks)


def listed(answer: np.ndarray, count: int) -> np.ndarray:
    """The points of an answer, which a long one holds as bits."""
    return np.flatnonzero(np.unpackbits(answer, count=count)) if answer.dtype == np.uint8 else answer


class Graph:
    """Layers of links over a shard's points; the lowest layer is the first.

    Beams go by cosines in single precision; what they find is verified in double precision.
    """

    top = 0
    beam = BEAM
    # Per point, those at the least cosine that it met as it went in, or that met it.
    met: list[np.ndarray] | None = None

    def __init__(self, vectors: np.ndarray, layers: list[np.ndarray]) -> None:
        self.vectors, self.layers = vectors, layers
        self.single = vectors.astype(np.float32)
        # More than single precision can be off.
        self.slack = (vectors.shape[1] + 8) * 1.2e-7

    @classmethod
    def build(cls, vectors: np.ndarray, seed: int = 1, least: float | None = None) -> "Graph":
        """Points go in from the highest layer down, many at once in each step.

        With ``least`` the graph keeps which points met at this cosine.
        """
        count = len(vectors)
        height = np.floor(-np.log(np.random.default_rng(seed).random(count)) / np.log(LINKS)).astype(int)
        height[0] = max(1, height.max())
        order = np.lexsort((np.arange(count), -height))
        place = np.empty(count, np.int64)
        place[order] = np.arange(count)
        # Points are renumbered while building: a layer holds a prefix of them.
        own, tall = vectors[order], height[order]
        # While building, a point has room for some links more, so that not each new one makes it choose again.
        widths = [LINKS * (2 if level == 0 else 1) for level in range(tall[0] + 1)]
        graph, done = cls(own, [np.full((count, width + LINKS), -1, np.int32) for width in widths]), 1
        meetings: list[np.ndarray] | None = None if least is None else []
        while done < count:
            batch = np.arange(done, min(count, done + min(done, TOGETHER)))
            graph._insert(batch, tall, least, meetings)
            done += len(batch)
        for level, width in enumerate(widths):
            crowded = np.flatnonzero((graph.layers[level] >= 0).sum(axis=1) > width)
            for at in range(0, len(crowded), TOGETHER):
                graph._choose(level, crowded[at : at + TOGETHER], graph.layers[level][crowded[at : at + TOGETHER]])
            graph.layers[level] = graph.layers[level][:, :width]
        graph._reach_all()
        mapped = [np.where(layer >= 0, order[layer], -1).astype(np.int32)[place] for layer in graph.layers]
        built = cls(vectors, mapped)
        built.top = int(order[0])
        if meetings is not None:
            built.met = built._each(order[np.concatenate(meetings)] if meetings else np.zeros((0, 2), np.int64), least)
        return built

    def _each(self, pairs: np.ndarray, least: float) -> list[np.ndarray]:
        """For each point the others that ``pairs`` give it, verified."""
        pairs = pairs[self._sure(self.vectors, pairs[:, 0], pairs[:, 1], least)]
        ends = np.concatenate([pairs, pairs[:, ::-1]])
        ends = ends[np.lexsort((ends[:, 1], ends[:, 0]))]
        return np.split(ends[:, 1].astype(np.int32), np.searchsorted(ends[:, 0], np.arange(1, len(self.vectors))))

    def _sure(self, queries: np.ndarray, rows: np.ndarray, points: np.ndarray, least: float) -> np.ndarray:
        """Which points are at ``least`` or more from their queries, in double precision."""
        sure = np.zeros(len(rows), bool)
        for at in range(0, len(rows), VERIFIED):
            one = slice(at, at + VERIFIED)
            sure[one] = np.einsum("nd,nd->n", queries[rows[one]], self.vectors[points[one]]) >= least
        return sure

    def _insert(self, batch: np.ndarray, tall: np.ndarray, least: float | None, meetings: list[np.ndarray] | None) -> None:
        queries = self.single[batch]
        entries = np.full((len(batch), 1), self.top, np.int64)
        for level in range(len(self.layers) - 1, -1, -1):
            # The batch begins with its tallest. Points only pass the layers they do not stay in.
            stay = int((tall[batch] >= level).sum())
            if stay < len(batch):
                entries[stay:] = search_layer(self.single, self.layers[level], queries[stay:], entries[stay:], STEP)[0][:, :1]
            if stay:
                points, cosines = search_layer(self.single, self.layers[level], queries[:stay], entries[:stay], BUILD_BEAM)
                entries[:stay] = points[:, :1]
                mates = self._link(level, batch[:stay], points, cosines)
                if level == 0 and meetings is not None:
                    rows, columns = np.nonzero(cosines >= least - self.slack)
                    meetings.append(np.stack([batch[rows], points[rows, columns]], axis=1))
                    rows, columns = np.nonzero(np.triu(mates >= least - self.slack, 1))
                    meetings.append(np.stack([batch[rows], batch[columns]], axis=1))

    def _link(self, level: int, batch: np.ndarray, points: np.ndarray, cosines: np.ndarray) -> np.ndarray:
        """Links new points with some they have found and some of each other; returns the cosines of these."""
        layer = self.layers[level]
        size, count = layer.shape[1] - LINKS, len(batch)
        mates = self.single[batch] @ self.single[batch].T
        near = _keys(mates, np.broadcast_to(batch, mates.shape))
        np.fill_diagonal(near, NONE)
        few = min(size, count)
        near = np.partition(near, count - few, axis=1)[:, count - few :]
        found = np.where(points < 0, NONE, _keys(cosines, np.maximum(points, 0)))
        every, close = _unkeyed(-np.sort(-np.concatenate([found, near], axis=1), axis=1))
        chosen = diverse(self.single, every, close, LINKS)
        layer[batch, :LINKS] = chosen
        # The chosen points link back, but for mates that chose each other.
        source, target = np.repeat(batch, chosen.shape[1]), chosen.ravel()
        back = target >= 0
        mate = np.flatnonzero(target >= batch[0])
        back[mate] &= (chosen[target[mate] - batch[0]] != source[mate, None]).all(axis=1)
        source, target = source[back], target[back]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        targets, start, each = np.unique(target, return_index=True, return_counts=True)
        held = (layer[targets] >= 0).sum(axis=1)
        rank = np.arange(len(target)) - np.repeat(start, each)
        fits = held + each <= layer.shape[1]
        fit = np.repeat(fits, each)
        layer[target[fit], (np.repeat(held, each) + rank)[fit]] = source[fit]
        # One with too many keeps a diverse choice.
        crowded = np.flatnonzero(~fits)
        for at in range(0, len(crowded), TOGETHER):
            some = crowded[at : at + TOGETHER]
            every = np.full((len(some), layer.shape[1] + int(each[some].max())), -1, np.int64)
            every[:, : layer.shape[1]] = layer[targets[some]]
            for row, one in enumerate(some.tolist()):
                every[row, layer.shape[1] : layer.shape[1] + each[one]] = source[start[one] : start[one] + each[one]]
            self._choose(level, targets[some], every)
        return mates

    def _choose(self, level: int, targets: np.ndarray, every: np.ndarray) -> None:
        """Leaves points with a diverse choice of these links."""
        layer = self.layers[level]
        size = layer.shape[1] - LINKS
        close = np.matmul(self.single.take(np.maximum(every, 0), axis=0), self.single[targets][:, :, None])[:, :, 0]
        keys = np.where(every < 0, NONE, _keys(close, np.maximum(every, 0)))
        every, close = _unkeyed(-np.sort(-keys, axis=1)[:, : 2 * BUILD_BEAM])
        layer[targets] = -1
        layer[targets, :size] = diverse(self.single, every, close, size)

    def _reach_all(self) -> None:
        """Give every point that no path of the lowest layer leads to a link from its nearest."""
        layer, seen = self.layers[0], np.zeros(len(self.vectors), bool)

        def follow(start: int) -> None:
            seen[start], edge = True, np.array([start])
            while len(edge):
                own = layer[edge]
                edge = np.unique(own[(own >= 0) & ~seen[own]])
                seen[edge] = True

        follow(self.top)
        extra: dict[int, list[int]] = {}
        while not seen.all():
            lost = int(np.argmin(seen))
            near = np.where(seen, self.single @ self.single[lost], -2.0)
            extra.setdefault(int(np.argmax(near)), []).append(lost)
            follow(lost)
        if extra:
            more = np.full((len(layer), max(map(len, extra.values()))), -1, np.int64)
            for source, targets in extra.items():
                more[source, : len(targets)] = targets
            self.layers[0] = np.concatenate([layer, more], axis=1)

    def query(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        queries = queries.astype(np.float32)
        entries = np.full((len(queries), 1), self.top, np.int64)
        for layer in self.layers[:0:-1]:
            entries = search_layer(self.single, layer, queries, entries, STEP)[0][:, :1]
        return search_layer(self.single, self.layers[0], queries, entries, min(beam, len(self.vectors)))

    def _split(self, queries: np.ndarray, rows: np.ndarray, points: np.ndarray, sure: np.ndarray, least: float) -> list[np.ndarray]:
        """Points by query; those not ``sure`` are verified first."""
        open_ = np.flatnonzero(~sure)
        sure[open_] = self._sure(queries, rows[open_], points[open_], least)
        return np.split(points[sure].astype(np.int32), np.searchsorted(rows[sure], np.arange(1, len(queries))))

    def whole(self, queries: np.ndarray, least: float) -> list[np.ndarray]:
        """Points at a cosine of ``least`` or more, by comparison with each."""
        found: list[np.ndarray] = []
        for at in range(0, len(queries), TOGETHER):
            some = queries[at : at + TOGETHER]
            cosines = some.astype(np.float32) @ self.single.T
            rows, points = np.nonzero(cosines >= least - self.slack)
            for own in self._split(some, rows, points, cosines[rows, points] >= least + self.slack, least):
                found.append(own if len(own) <= LISTED else _bits(own, len(self.vectors)))
        return found

    def within(self, queries: np.ndarray, least: float, beam: int) -> list[np.ndarray]:
        """Points at a cosine of ``least`` or more that a beam finds, and all of them where they are many."""
        if beam > WHOLE * len(self.vectors):
            return self.whole(queries, least)
        found: list[np.ndarray] = []
        for at in range(0, len(queries), TOGETHER):
            some = queries[at : at + TOGETHER]
            points, cosines = self.query(some, beam)
            rows, columns = np.nonzero(cosines >= least - self.slack)
            found += self._split(some, rows, points[rows, columns], np.zeros(len(rows), bool), least)
        return self._where_many(queries, least, found)

    def _where_many(self, queries: np.ndarray, least: float, found: list[np.ndarray]) -> list[np.ndarray]:
        many = np.array([at for at, own in enumerate(found) if len(own) >= MANY], np.int64)
        for at, own in zip(many.tolist(), self.whole(queries[many], least), strict=True):
            found[at] = own
        return found

    def entered(self, queries: np.ndarray, least: float, own: np.ndarray) -> list[np.ndarray]:
        """``within`` for points of the graph: what their beams met as they went in."""
        return self._where_many(queries, least, [np.append(self.met[point], np.int32(point)) for point in own.tolist()])

    def settle(self, least: float, seed: int = 2) -> None:
        """Widen the beam until queries planted at a cosine of ``least`` from drawn points find these.

        Real links may be too rare to judge a beam by; a planted one is of the hardest kind.
        """
        rng = np.random.default_rng(seed)
        drawn = rng.permutation(len(self.vectors))[:PLANTED]
        points = self.vectors[drawn]
        aside = rng.standard_normal(points.shape)
        aside -= np.einsum("nd,nd->n", aside, points)[:, None] * points
        size = np.linalg.norm(aside, axis=1, keepdims=True)
        aside = np.where(size > 1e-9, aside / np.maximum(size, 1e-9), 0.0)
        queries = _unit(least * points + np.sqrt(max(0.0, 1 - least * least)) * aside)
        while self.beam <= WHOLE * len(self.vectors):
            found, cosines = self.query(queries, self.beam)
            shown = (found == drawn[:, None]).any(axis=1) | ((cosines >= least).sum(axis=1) >= MANY)
            if shown.mean() >= RECALL:
                break
            self.beam *= 2

    def audited(self, queries: np.ndarray, least: float, own: np.ndarray | None = None) -> list[np.ndarray]:
        """``within``, with a beam that finds the wanted share of the links of drawn queries.

        ``own`` is a query's own point, or -1: it is no link. ``AUDITED`` queries are compared with the
        whole shard; each that has links weighs the same. All others are answered by the beam. ``listed`` gives an answer's points.
        """
        own = np.full(len(queries), -1) if own is None else own
        found: list[np.ndarray] = [np.zeros(0, np.int64)] * len(queries)

        def answers(which: np.ndarray, beam: int) -> list[np.ndarray]:
            # Building has used a beam of this width already.
            if self.met is not None and beam <= BUILD_BEAM and (own[which] >= 0).all():
                return self.entered(queries[which], least, own[which])
            return self.within(queries[which], least, beam)

        drawn = np.random.default_rng(len(queries)).permutation(len(queries))
        audit, rest = drawn[:AUDITED], drawn[AUDITED:]
        for query, true in zip(audit.tolist(), self.whole(queries[audit], least), strict=True):
            found[query] = true
        linked = np.array([q for q in audit.tolist() if (listed(found[q], len(self.vectors)) != own[q]).any()], np.int64)
        beam = self.beam
        while len(rest) and len(linked) and beam <= WHOLE * len(self.vectors):
            shown = answers(linked, beam)
            shares = []
            for query, got in zip(linked.tolist(), shown, strict=True):
                true = listed(found[query], len(self.vectors))
                shares.append(np.isin(true, listed(got, len(self.vectors)))[true != own[query]].mean())
            if np.mean(shares) >= RECALL:
                break
            beam *= 2
        for query, got in zip(rest.tolist(), answers(rest, beam), strict=True):
            found[query] = got
        return found

    def packed(self) -> list[bytes]:
        return [np.array([self.top], np.int64).tobytes(), *[layer.astype(np.int32).tobytes() for layer in self.layers]]

    @classmethod
    def unpacked(cls, vectors: np.ndarray, layers: list[bytes]) -> "Graph":
        read = [np.frombuffer(layer, np.int32).reshape(len(vectors), -1) for layer in layers[1:]]
        graph = cls(vectors, read)
        graph.top = int(np.frombuffer(layers[0], np.int64)[0])
        return graph


def _unit(vectors: np.ndarray) -> np.ndarray:
    # Scaled first, so that no square of a component overflows or vanishes.
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _unpacked(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None, int | None]:
    """Ids, weights, vectors, homes (the rooms of each point) and room of blocks, by id."""
    single = "single" in frame and bool(frame["single"].iloc[0])
    ids = np.frombuffer(b"".join(frame["ids"]), np.int64)
    weights = np.frombuffer(b"".join(frame["weights"]), np.int64)
    vectors = np.frombuffer(b"".join(frame["vectors"]), np.float32 if single else np.float64).reshape(len(ids), -1)
    order = np.lexsort((weights, ids))
    homes = np.frombuffer(b"".join(frame["homes"]), np.int32).reshape(len(ids), -1)[order] if "homes" in frame else None
    room = int(frame["room"].iloc[0]) if "room" in frame else None
    return ids[order], weights[order], vectors[order].astype(np.float64), homes, room


def build_shard(frame: pd.DataFrame, least: float) -> pd.DataFrame:
    ids, weights, vectors, homes, room = _unpacked(frame)
    graph = Graph.build(_unit(vectors))
    graph.settle(least)
    single = "single" in frame and bool(frame["single"].iloc[0])
    row = {
        "at": int(frame["at"].iloc[0]),
        "ids": ids.tobytes(),
        "weights": weights.tobytes(),
        "vectors": (vectors.astype(np.float32) if single else vectors).tobytes(),
        "layers": graph.packed(),
        "beam": graph.beam,
    }
    if homes is not None:
        row |= {"room": room, "homes": homes.tobytes(), "single": single}
    return pd.DataFrame([row])


def solve_room(frame: pd.DataFrame, least: float) -> pd.DataFrame:
    """``find_links`` of a room that is one shard: its points query the graph they are in."""
    ids, weights, vectors, homes, room = _unpacked(frame)
    graph = Graph.build(_unit(vectors), least=least)
    graph.settle(least)
    hits = graph.audited(graph.vectors, least, np.arange(len(ids)))
    return _found(int(frame["at"].iloc[0]), room, ids, weights, homes, ids, weights, homes, hits)


def find_links(shard: pd.DataFrame, part: pd.DataFrame, least: float) -> pd.DataFrame:
    """Per query that links with points of a shard: one row of ``FOUND``.

    ``whole`` says that ``n``, the weight of its links there, is exact. Else ``others`` lists its links. Among
    them, or alone, are those to be ``told``: points that few of the part's queries have found, so that
    they may have missed a link themselves. What one query links with is connected through it, so each needs one star link.
    """
    if not len(shard) or not len(part):
        return pd.DataFrame([], columns=[field.split()[0] for field in FOUND.split(", ")])
    ids, weights, vectors, homes, room = _unpacked(shard)
    query_ids, query_weights, queries, query_homes, _ = _unpacked(part)
    place = np.minimum(np.searchsorted(ids, query_ids), len(ids) - 1)
    own_points = np.where(ids[place] == query_ids, place, -1)
    graph = Graph.unpacked(_unit(vectors), shard["layers"].iloc[0])
    graph.beam = int(shard["beam"].iloc[0])
    hits = graph.audited(_unit(queries), least, own_points)
    room = queries.shape[1] if room is None else room
    return _found(int(shard["at"].iloc[0]), room, ids, weights, homes, query_ids, query_weights, query_homes, hits)


def _found(
    at: int,
    room: int,
    ids: np.ndarray,
    weights: np.ndarray,
    homes: np.ndarray | None,
    query_ids: np.ndarray,
    query_weights: np.ndarray,
    query_homes: np.ndarray | None,
    hits: list[np.ndarray],
) -> pd.DataFrame:
    out, count = [], len(ids)
    # The least point that each is connected with, and those that have it.
    least, members = np.arange(count), {}
    times = np.zeros(count, np.int64)
    for own in (listed(hit, count) for hit in hits):
        times[own] += 1
        if len(own) < 2:
            continue
        roots = least[own]
        first = int(roots.min())
        if first != roots.max():
            joined = [members.pop(root, np.array([root])) for root in np.unique(roots).tolist()]
            members[first] = np.concatenate(joined)
            least[members[first]] = first
    # A point found this often links with many of every shard, and is compared whole itself.
    few = times < 2 * MANY * max(1.0, len(query_ids) / count)
    inside: dict[int, np.ndarray] = {}
    for query, (query_id, weight, hit) in enumerate(zip(query_ids.tolist(), query_weights.tolist(), hits, strict=True)):
        own = listed(hit, count)
        others = own[ids[own] != query_id]
        if not len(others):
            continue
        whole, star = len(own) >= MANY, int(ids[least[others[0]]])
        if homes is not None and homes.shape[1] > 1:
            others = others[_met_first(room, query_homes[query], homes, others, inside)]
        n = int(weights[others].sum())
        told_to = others[few[others]] if whole else others
        told = few[told_to].tolist()
        out.append((query_id, weight, room, at, whole, n, star, ids[told_to].tolist(), weights[told_to].tolist(), told))
    return pd.DataFrame(out, columns=[field.split()[0] for field in FOUND.split(", ")])


def _met_first(room: int, own: np.ndarray, homes: np.ndarray, others: np.ndarray, inside: dict[int, np.ndarray]) -> np.ndarray:
    """Which of the others share no room with a query before this one: a link counts in the first room of both."""
    before = own[own < room]
    if len(others) * len(before) < len(homes):
        return ~(homes[others][:, :, None] == before).any(axis=(1, 2))
    shared = np.zeros(len(homes), bool)
    for home in before.tolist():
        if home not in inside:
            inside[home] = np.flatnonzero((homes == home).any(axis=1))
        shared[inside[home]] = True
    return ~shared[others]


def link_counts(found: DataFrame, places: DataFrame) -> DataFrame:
    """id and n, the weight of all it links with by a search of its own or by another's."""
    homes = F.broadcast(places.select("length", F.col("shard").alias("_first"), F.col("shards").alias("_count")))
    each = found.select(
        "id", "weight", "length", "shard", "whole", F.explode(F.arrays_zip("others", "weights", "told")).alias("link")
    )
    listed = each.where(~F.col("whole")).select("id", "shard", F.col("link.others").alias("other"), F.col("link.weights").alias("weight"))
    home = F.col("_first") + F.pmod(F.xxhash64("id"), F.col("_count")).cast("int")
    told = (
        each.where(F.col("link.told"))
        .join(homes, "length")
        .select(F.col("link.others").alias("id"), home.alias("shard"), F.col("id").alias("other"), "weight")
    )
    exact = found.where("whole").select("id", "shard", "n")
    known = listed.union(told).groupBy("id", "shard", "other").agg(F.max("weight").alias("n"))
    open_ends = known.join(exact.select("id", "shard"), ["id", "shard"], "left_anti").select("id", "n")
    return open_ends.union(exact.select("id", "n")).groupBy("id").agg(F.sum("n").alias("n"))


class Rooms:
    """Where vectors are compared: a room for each length, or overlapping regions if it has many."""

    def __init__(self, lengths: list[tuple[int, int, Regions | None]]) -> None:
        self.lengths = {length: (first, regions) for length, first, regions in lengths}

    def homes(self, vectors: np.ndarray) -> np.ndarray:
        """The rooms of vectors of one length, smallest first."""
        first, regions = self.lengths[vectors.shape[1]]
        return np.full((len(vectors), 1), first, np.int32) if regions is None else first + regions.of(_unit(vectors))

    def each(self, batch: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
        """The rows of each length, their vectors and their rooms."""
        for _, own in batch.groupby(batch["vector"].map(len)):
            vectors = np.stack(own["vector"]).astype(np.float64)
            yield own, vectors, self.homes(vectors)


def draw_rooms(points: DataFrame, least: float) -> tuple[Rooms, dict[int, int], int]:
    """Rooms, the rows of those that are a whole length, and the number of rooms.

    One row per length and, of each that has more vectors than a shard holds, a bounded number of drawn vectors reach the driver.
    """
    lengths, rows, first = [], {}, 0
    for length, count in sorted(map(tuple, points.groupBy(F.size("vector")).count().collect())):
        regions = None
        if count > SHARD_ROWS:
            drawn = points.where(F.size("vector") == length).orderBy("id").limit(DRAWN).select(F.col("vector").cast("array<double>"))
            flat = drawn.toArrow().column(0).combine_chunks().flatten().to_numpy()
            regions = learn(_unit(flat.reshape(-1, length)), count, least)
        lengths.append((length, first, regions))
        if regions is None:
            rows[first] = count
        first += 1 if regions is None else len(regions.pivots)
    return Rooms(lengths), rows, first


def place_rooms(points: DataFrame, rooms: Rooms, rows: dict[int, int], count: int) -> list[tuple[int, int, int, int, int]]:
    """Per room its first shard and part, and how many of each it has."""
    whole = set(rows)
    if len(whole) < count:

        def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for _, _, homes in rooms.each(batch):
                    found, each = np.unique(homes, return_counts=True)
                    yield pd.DataFrame({"room": found, "n": each})

        each = points.select("vector").mapInPandas(counted, "room int, n long").groupBy("room").agg(F.sum("n"))
        rows = rows | {room: n for room, n in each.collect() if room not in whole}
    placed, shard, part = [], 0, 0
    for room, n in sorted(rows.items()):
        shards = shards_of(n, FILL) if room in whole else -(-n // SHARD_ROWS)
        parts = parts_of(n) if shards > 1 else 1
        placed.append((room, shard, shards, part, parts))
        shard, part = shard + shards, part + parts
    return placed


def room_blocks(points: DataFrame, rooms: Rooms, placed: list[tuple[int, int, int, int, int]], kind: str, single: bool) -> DataFrame:
    """Points packed by shard or part, once for each room they are in.

    ``kind`` is ``own`` for rooms of one shard, and ``shard`` or ``part`` for all others.
    """
    table = np.full((max((place[0] for place in placed), default=0) + 1, 2), 0, np.int64)
    for room, shard, shards, part, parts in placed:
        if (shards == 1) == (kind == "own"):
            table[room] = (part, parts) if kind == "part" else (shard, shards)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            packed = []
            for own, vectors, homes in rooms.each(batch):
                ids, weights, deal = (own[name].to_numpy(np.int64) for name in ("id", "weight", "deal"))
                vectors = vectors.astype(np.float32) if single else vectors
                row, room = np.repeat(np.arange(len(own)), homes.shape[1]), homes.ravel()
                row, room = row[table[room, 1] > 0], room[table[room, 1] > 0]
                at = table[room, 0] + deal[row] % table[room, 1]
                order = np.argsort(at, kind="stable")
                for rows in np.split(order, np.flatnonzero(np.diff(at[order])) + 1) if len(order) else []:
                    some = row[rows]
                    each = (ids[some], weights[some], vectors[some], homes[some])
                    packed.append((int(room[rows[0]]), int(at[rows[0]]), *[values.tobytes() for values in each], single))
            yield pd.DataFrame(packed, columns=[field.split()[0] for field in BLOCK.split(", ")])

    return points.select("id", "weight", "vector", F.xxhash64("id").alias("deal")).mapInPandas(run, BLOCK)


def similar_vectors(embeddings: DataFrame, least: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id and kept, one row per row of ``embeddings``."""
    # Zeros of either sign are equal.
    plain = F.transform(F.col("embedding"), lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x))
    exact = F.col("embedding").cast("array<double>")
    hashes = {"id": F.xxhash64(exact), "mark": F.hash(exact)}
    # What came in single precision travels in it.
    single = embeddings.schema["embedding"].dataType.elementType == FloatType()
    narrow = plain.cast("array<float>" if single else "array<double>")
    rows = usable_rows(embeddings).select("vec_id", narrow.alias("embedding"))
    grouped = rows.groupBy("embedding").agg(F.count("*").alias("weight"), F.min("vec_id").alias("least"))
    points, _ = write_out(grouped.withColumns(hashes), "points")
    packed = points.select("id", "weight", F.col("embedding").alias("vector"))
    rooms, lone, count = draw_rooms(packed, least)
    placed = place_rooms(packed, rooms, lone, count)
    names = "length int, shard int, shards int, part int, parts int"
    places = embeddings.sparkSession.createDataFrame(placed, names)

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        return solve_room(frame, least)

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        return build_shard(frame, least)

    def run(shard: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        return find_links(shard, part, least)

    own = room_blocks(packed, rooms, placed, "own", single).groupBy("at").applyInPandas(solve, FOUND)
    found, _ = write_out(own, "found")
    if any(shards > 1 for _, _, shards, _, _ in placed):
        several = places.where("shards > 1")
        shards = room_blocks(packed, rooms, placed, "shard", single)
        graphs, _ = write_out(shards.groupBy("at").applyInPandas(build, GRAPH), "graphs")
        queries = room_blocks(packed, rooms, placed, "part", single)
        met, _ = write_out(meet(graphs, queries, several, run, FOUND), "found")
        found = found.unionByName(met)
    joined = components(found.select(F.col("id").alias("a"), F.col("star").alias("b")))
    rooted = (
        points.drop("embedding")
        .join(link_counts(found, places), "id", "left")
        .join(joined.withColumnRenamed("node", "id"), "id", "left")
        .withColumn("root", F.coalesce("component", "id"))
    )
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    n_links = F.coalesce("n", F.lit(0)) + F.col("weight") - 1
    by_point = rooted.join(named, "root").select("id", "mark", n_links.alias("n_links"), "component_id")
    mine = embeddings.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")
    )
    # Rows that take no part have no partner here: they stand alone.
    taking = F.col("vec_id").isNotNull()
    component = F.when(taking, F.coalesce("component_id", "vec_id"))
    keys = mine.select("vec_id", F.when(usable(F.col("embedding")), plain).alias("embedding")).select(
        "vec_id", *[F.when(F.col("embedding").isNotNull(), key).alias(name) for name, key in hashes.items()]
    )
    return keys.join(by_point, ["id", "mark"], "left").select(
        "vec_id",
        F.when(taking, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
