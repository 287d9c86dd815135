"""SentencePiece encoding and decoding for merge-type (BPE) models, exact by backtracking.

A text's encoding is the one sequence of pieces in which every piece merges back to itself
and every neighbouring pair merges back to that pair. Longest matches found by Aho-Corasick
are tried first; a position from which no sequence goes on is marked in a bitfield
and the piece before it gives way to its next shorter match.

No piece holds a blank behind another character, so no merge crosses the start of a blank
run: texts are encoded in such chunks, and the chunks of recent texts are remembered.

Null texts count as empty; an empty text is the end id alone. The vocabulary is handed to
the tasks as bytes: its size is that of the model file.
"""

import re
from array import array
from collections.abc import Callable, Iterator
from functools import cached_property
from weakref import proxy

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece.sentencepiece_model_pb2 as model_format
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLANK = "▁"
CHUNK = re.compile(" *[^ ]+| +")
# Short chunks that a Python worker remembers: twice so many at most, some 200 bytes each.
REMEMBERED = 300_000
# A longer chunk is not worth remembering.
LONGEST = 64
# Pairs of pieces remembered; older ones are worked out again.
PAIRS = 400_000
# Rows of a batch returned to Spark.
ROWS = 500


class Vocabulary:
    """The pieces of a model and the two directions between texts and ids."""

    def __init__(self, model: bytes) -> None:
        read = model_format.ModelProto()
        read.ParseFromString(model)
        kinds = model_format.ModelProto.SentencePiece
        cut = read.normalizer_spec
        if (
            read.trainer_spec.model_type != model_format.TrainerSpec.BPE
            or cut.precompiled_charsmap
            or cut.remove_extra_whitespaces
            or not cut.add_dummy_prefix
            or not read.trainer_spec.byte_fallback
            or read.trainer_spec.treat_whitespace_as_suffix
            or any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in read.pieces)
        ):
            raise ValueError("only merge-type models with byte fallback and plain text are handled")
        self.end = read.trainer_spec.eos_id
        self.ids, self.scores, self.bytes = {}, {}, []
        self.byte_ids = [0] * 256
        for number, piece in enumerate(read.pieces):
            shown = piece.piece.replace(BLANK, " ").encode()
            if piece.type == kinds.NORMAL:
                self.ids[piece.piece] = number
                self.scores[piece.piece] = piece.score
                if BLANK in piece.piece.lstrip(BLANK):
                    raise ValueError("a piece holds a blank behind another character")
            elif piece.type == kinds.BYTE:
                value = int(piece.piece[1:-1], 16)
                self.byte_ids[value] = number
                shown = bytes([value])
            elif piece.type == kinds.CONTROL:
                shown = b""
            self.bytes.append(shown)
        self.pairs: dict[tuple[str, str], bool] = {}
        self.chunks = Chunks(self)

    @cached_property
    def found(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for piece in self.ids:
            found.add_word(piece, len(piece))
        found.make_automaton()
        return found

    def merged(self, text: str) -> list[str]:
        """The merges of a short text, best score first, leftmost among equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def fits(self, before: str, piece: str) -> bool:
        """Whether both stay apart when merged together; ``before`` may be empty."""
        key = (before, piece)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.merged(before + piece) == ([before, piece] if before else [piece])
            self.pairs[key] = known
        return known

    def split(self, text: str) -> list[str]:
        """The pieces of a text of ``BLANK`` and other characters."""
        size, known = len(text), self.pairs
        # Ends of the matches from each position, longest last; a character alone always is one.
        ends = [[at + 1] for at in range(size)]
        for last, length in self.found.iter(text):
            if length > 1:
                ends[last + 1 - length].append(last + 1)
        failed = bytearray(size // 8 + 1)
        pieces, before, at = [], "", 0
        while at < size:
            left = ends[at]
            while left:
                end = left.pop()
                if failed[end >> 3] >> (end & 7) & 1:
                    continue
                piece = text[at:end]
                fit = known.get((before, piece))
                if self.fits(before, piece) if fit is None else fit:
                    pieces.append(piece)
                    before, at = piece, end
                    break
            else:
                failed[at >> 3] |= 1 << (at & 7)
                at -= len(pieces.pop())
                before = pieces[-1] if pieces else ""
        return pieces

    def chunk_ids(self, chunk: str) -> bytes:
        """Ids of a blank and a chunk, as packed 32-bit numbers."""
        pieces = self.split(BLANK + chunk.replace(" ", BLANK))
        try:
            return array("i", [self.ids[piece] for piece in pieces]).tobytes()
        except KeyError:  # a character that is no piece is written as its bytes
            parts = ([self.ids[p]] if p in self.ids else [self.byte_ids[b] for b in p.encode()] for p in pieces)
            return array("i", [number for part in parts for number in part]).tobytes()

    def encode(self, text: str | None) -> bytes:
        """Packed ids of a text, with the end id."""
        end = array("i", [self.end]).tobytes()
        if not text:
            return end
        text = text.replace(BLANK, " ")
        if "  " in text or text[0] == " " or text[-1] == " ":
            chunks = [chunk[1:] for chunk in CHUNK.findall(" " + text)]
        else:
            chunks = text.split(" ")
        return b"".join([self.chunks[chunk] for chunk in chunks]) + end

    def decode(self, ids: list[int]) -> str:
        shown = b"".join(map(self.bytes.__getitem__, ids))
        return shown.decode("utf-8", "replace").removeprefix(" ")


class Chunks(dict):
    """Packed ids by chunk, filled when asked; keeps those used since it was last half renewed."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        super().__init__()
        # No circle of references: what a worker remembers goes when the broadcast does.
        self.vocabulary, self.before = proxy(vocabulary), {}

    def __missing__(self, chunk: str) -> bytes:
        packed = self.before.get(chunk)
        if packed is None:
            packed = self.vocabulary.chunk_ids(chunk)
        if len(chunk) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.before = dict(self)
                self.clear()
            self[chunk] = packed
        return packed


class Shared:
    """A model as it is handed to the workers; each reads it once for all its tasks."""

    def __init__(self, model: bytes) -> None:
        self.model = model

    def __getstate__(self) -> dict:
        return {"model": self.model}

    @cached_property
    def vocabulary(self) -> Vocabulary:
        return Vocabulary(self.model)


def read_model(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def _mapped(documents: DataFrame, model: bytes, added: dict[str, T.DataType], work: Callable) -> DataFrame:
    """``documents`` with columns added by ``work`` from some rows and the vocabulary. A map over the rows."""
    others = [name for name in documents.columns if name not in added]
    schema = T.StructType([documents.schema[n] for n in others] + [T.StructField(n, t) for n, t in added.items()])
    shared = documents.sparkSession.sparkContext.broadcast(Shared(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value.vocabulary
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                rows = batch.slice(start, ROWS)
                yield pa.RecordBatch.from_arrays([*[rows.column(n) for n in others], *work(vocabulary, rows)], schema.names)

    return documents.select(*others).mapInArrow(run, schema)


def _encoded(vocabulary: Vocabulary, rows: pa.RecordBatch) -> tuple[pa.Array, list[np.ndarray]]:
    packed = [np.frombuffer(vocabulary.encode(text), np.int32) for text in rows.column("text").to_pylist()]
    ends = np.cumsum([0, *map(len, packed)], dtype=np.int32)
    values = np.concatenate(packed) if packed else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values)), packed


def encode_documents(documents: DataFrame, model: bytes, column: str = "ids") -> DataFrame:
    """``documents`` with the ids of its ``text``, an end id last."""
    return _mapped(documents, model, {column: T.ArrayType(T.IntegerType())}, lambda v, rows: [_encoded(v, rows)[0]])


def decode_documents(encoded: DataFrame, model: bytes, column: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ``ids``; null ids give null."""

    def work(vocabulary: Vocabulary, rows: pa.RecordBatch) -> list[pa.Array]:
        each = (v.values.to_numpy().tolist() if v.is_valid else None for v in rows.column("ids"))
        return [pa.array([None if ids is None else vocabulary.decode(ids) for ids in each], pa.string())]

    return _mapped(encoded, model, {column: T.StringType()}, work)


def round_trip(documents: DataFrame, model: bytes) -> DataFrame:
    """``documents`` with the ``ids`` of its ``text`` and their text, ``decoded``."""

    def work(vocabulary: Vocabulary, rows: pa.RecordBatch) -> list[pa.Array]:
        ids, packed = _encoded(vocabulary, rows)
        return [ids, pa.array([vocabulary.decode(own.tolist()) for own in packed], pa.string())]

    return _mapped(documents, model, {"ids": T.ArrayType(T.IntegerType()), "decoded": T.StringType()}, work)


def encoding_digest(documents: DataFrame, model: bytes) -> DataFrame:
    """doc_id, n_tokens and the hashes of the ids and of the decoded text."""
    listed = F.array_join(F.transform("ids", lambda i: i.cast("string")), " ")
    return round_trip(documents.select("doc_id", "text"), model).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(listed, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
