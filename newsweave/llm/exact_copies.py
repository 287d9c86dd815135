"""Exact deduplication by a tree merge of sorted runs of digests.

A run is the digests of some documents in order, each with the identifier that stays and
a count. Runs stand at addresses 0, 1, 2 ...; in each round those whose addresses differ in
their lowest digit only exchange pieces, as along the edges of a binomial tree: every piece
covers one part of the digests, and whoever holds that part merges the pieces of all. After
round r a run covers as many documents as ``FAN`` ** r runs did, over that fraction of
the digests, so a task never holds more than one run's worth, and equal digests shrink to one entry
at every level. The last round holds each digest once.

An entry is a SHA-256 digest, verified at every merge by the text's length and by a second
hash: entries that agree in the digest alone stay apart. Of entries that agree in all, the wanted
identifier stays (the largest or the smallest) and the counts add up.

The answers return by the documents' runs, not by digest alone, so a text held by a third
of all rows comes back to as many tasks as it came from.

Null texts count as empty, and empty texts are copies of each other. A row without an id stays
only if no copy has one. Of rows that repeat the id that stays, one stays. An empty table gives
none. Other columns take no part here; ``drop_copies`` keeps them, whatever their names.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsweave.llm.words import plain_row_name
from newsweave.session import write_out

# Runs merged at once, as a power of two, and entries of a run before the first round.
DIGIT = 4
FAN = 1 << DIGIT
RUN_ROWS = 1 << 16

# Columns of an entry: a digest in four parts, length and second hash; these tell texts apart.
TEXT = 6
# Then whether there is an id, the id (order kept, unsigned), the row (likewise) and the count.
HAS, ID, ROW, COUNT = 6, 7, 8, 9
SIGN = np.uint64(1 << 63)
ANSWERS = "digest binary, length long, second long, keep_id long, keep_row long, group_size long"


def entries(rows: pa.RecordBatch) -> np.ndarray:
    """Rows of digest, length, second, id and row as entries that count one each."""
    out = np.ones((rows.num_rows, COUNT + 1), np.uint64)
    digests = b"".join(rows.column("digest").to_pylist())
    out[:, :4] = np.frombuffer(digests, ">u8").reshape(-1, 4)
    out[:, 4] = rows.column("length").to_numpy().view(np.uint64)
    out[:, 5] = rows.column("second").to_numpy().view(np.uint64)
    ids = rows.column("id")
    out[:, HAS] = ids.is_valid().to_numpy(zero_copy_only=False)
    out[:, ID] = ids.fill_null(0).to_numpy().view(np.uint64) ^ SIGN
    out[:, ROW] = rows.column("row").to_numpy().view(np.uint64)
    return out


def merged(parts: list[np.ndarray], largest: bool) -> np.ndarray:
    """Sorted runs merged into one, an entry for each text.

    The sort is stable and finds stretches in order, so it merges sorted parts.
    """
    held = np.concatenate(parts)
    # Of a text's entries that which stays comes first: with an id, by the id, by the first row.
    wanted = ~held[:, ID] if largest else held[:, ID]
    keys = (held[:, ROW], wanted, np.uint64(1) - held[:, HAS], *(held[:, at] for at in range(TEXT - 1, -1, -1)))
    held = held[np.lexsort(keys)]
    new = np.ones(len(held), bool)
    new[1:] = (held[1:, :TEXT] != held[:-1, :TEXT]).any(axis=1)
    first = np.flatnonzero(new)
    out = held[first]
    out[:, COUNT] = np.add.reduceat(held[:, COUNT], first) if len(first) else 0
    return out


def pieces(run: np.ndarray, address: int, covers: int, level: int) -> list[tuple[int, bytes]]:
    """A run cut for the next round: the slot that merges each piece, and the piece.

    The run holds the digests that begin with the ``level`` digits ``covers``. A slot is the
    address without its lowest digit, then the digits its digests begin with.
    """
    top = run[:, 0] >> np.uint64(64 - DIGIT * (level + 1)) & np.uint64(FAN - 1)
    ends = np.searchsorted(top, np.arange(FAN + 1, dtype=np.uint64))
    slot = (address >> DIGIT << DIGIT * (level + 1)) + (covers << DIGIT)
    return [(slot + at, run[a:b].tobytes()) for at, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if a < b]


def _sent(found: list[tuple[int, bytes]]) -> dict[str, pa.Array]:
    slots, runs = zip(*found, strict=True) if found else ((), ())
    return {"slot": pa.array(slots, pa.int64()), "run": pa.array(runs, pa.binary())}


def _first_runs(digests: DataFrame, partitions: int, largest: bool) -> DataFrame:
    """Sorted runs of the stored digests, cut for the first round. A map over the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        count, address = 0, 0

        def cut() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict(_sent(pieces(merged(held, largest), address, 0, 0)))

        for batch in batches:
            if not count and batch.num_rows:
                # The partition a run's first row was written by, then its place there: small and steady numbers.
                row = batch.column("row")[0].as_py()
                address = (row >> 33) + partitions * ((row & (1 << 33) - 1) // RUN_ROWS)
            held.append(entries(batch))
            count += batch.num_rows
            if count >= RUN_ROWS:
                yield cut()
                held, count = [], 0
        if count:
            yield cut()

    return digests.select("digest", "length", "second", "id", "row").mapInArrow(run, "slot long, run binary")


def _round(sent: DataFrame, level: int, last: bool, largest: bool) -> DataFrame:
    """One round: merge the pieces of every slot; cut again, or give the answers of repeated texts."""

    def run(group: pa.Table) -> pa.Table:
        slot = group.column("slot")[0].as_py()
        parts = [np.frombuffer(piece, np.uint64).reshape(-1, COUNT + 1) for piece in group.column("run").to_pylist()]
        held = merged(parts, largest)
        address, covers = slot >> DIGIT * level, slot & (1 << DIGIT * level) - 1
        if not last:
            return pa.table(_sent(pieces(held, address, covers, level)))
        held = held[held[:, COUNT] > 1]
        digests = np.ascontiguousarray(held[:, :4].astype(">u8")).tobytes()
        ids = pa.array((held[:, ID] ^ SIGN).view(np.int64), mask=held[:, HAS] == 0)
        numbers = {name: np.ascontiguousarray(held[:, at]).view(np.int64) for name, at in (("length", 4), ("second", 5))}
        return pa.table(
            {
                "digest": pa.array([digests[at : at + 32] for at in range(0, len(digests), 32)], pa.binary()),
                **numbers,
                "keep_id": ids,
                "keep_row": np.ascontiguousarray(held[:, ROW]).view(np.int64),
                "group_size": np.ascontiguousarray(held[:, COUNT]).view(np.int64),
            }
        )

    return sent.groupBy("slot").applyInArrow(run, ANSWERS if last else "slot long, run binary")


def rounds(runs: int) -> int:
    """Rounds until runs at addresses below ``runs`` are one."""
    return max(1, -(-(runs - 1).bit_length() // DIGIT))


def repeated_texts(digests: DataFrame, largest: bool = True) -> DataFrame:
    """Of stored rows (digest, length, second, id, row): what stays of every text held twice or more.

    ``row`` is monotonically_increasing_id() as it was when the rows were written.
    """
    place = F.col("row").bitwiseAND((1 << 33) - 1)
    partitions, chunks = digests.agg(
        F.coalesce(F.max(F.shiftright("row", 33)) + 1, F.lit(0)),
        F.coalesce(F.max(F.floor(place / RUN_ROWS)) + 1, F.lit(0)),
    ).first()
    sent = _first_runs(digests, partitions, largest)
    last = rounds(partitions * chunks)
    for level in range(1, last + 1):
        sent = _round(sent, level, level == last, largest)
    return sent


def _copies(digests: DataFrame, largest: bool) -> DataFrame:
    """The stored rows with keep_id, keep_row and group_size."""
    key = ["digest", "length", "second"]
    rows = digests.withColumn("part", F.floor(F.col("row") / RUN_ROWS))
    # A text returns once to each part that holds it, and there to its rows.
    known = rows.select("part", *key).distinct().join(repeated_texts(digests, largest), key)
    found = rows.join(known, ["part", *key], "left")
    single = F.col("group_size").isNull()
    return found.withColumns(
        {
            "keep_id": F.when(single, F.col("id")).otherwise(F.col("keep_id")),
            "keep_row": F.coalesce("keep_row", "row"),
            "group_size": F.coalesce("group_size", F.lit(1).cast("long")),
        }
    )


def _digests(rows: DataFrame, text: Column, row: Column) -> DataFrame:
    whole = F.coalesce(text, F.lit(""))
    return rows.select(
        F.col("doc_id").cast("long").alias("id"),
        F.unhex(F.sha2(whole, 256)).alias("digest"),
        F.octet_length(whole).cast("long").alias("length"),
        F.xxhash64(whole).alias("second"),
        row.alias("row"),
    )


def exact_copies(documents: DataFrame, text: Column | None = None, largest: bool = True) -> DataFrame:
    """Per document: doc_id, keep_id, group_size, kept and text_sha256.

    ``text`` is what is compared: the text itself, or an expression that normalises it.
    """
    text = F.col("text") if text is None else text
    digests, _ = write_out(_digests(documents, text, F.monotonically_increasing_id()), "digests")
    return _copies(digests, largest).select(
        F.col("id").alias("doc_id"),
        "keep_id",
        "group_size",
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(documents: DataFrame, text: Column | None = None, largest: bool = True) -> DataFrame:
    """``documents`` with one row of each text; columns stay."""
    text = F.col("text") if text is None else text
    own = plain_row_name(documents.columns)
    rows, _ = write_out(documents.withColumn(own, F.monotonically_increasing_id()), "rows")
    digests, _ = write_out(_digests(rows, text, F.col(own)), "digests")
    gone = _copies(digests, largest).where("row != keep_row").select(F.col("row").alias(own))
    return rows.join(gone, own, "left_anti").select(*[F.col(f"`{name}`") for name in documents.columns])
