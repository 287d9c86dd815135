"""Encoding and decoding against the sentencepiece library."""

import hashlib

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from newsweave.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
MODEL = pieces.read_model(PATH)
OWN = pieces.Vocabulary(MODEL)
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
TEXTS = [
    "",
    " ",
    "  a  b ",
    "a\tb\nc",
    "▁x ▁",
    "éÀ́ ﬁ　x",
    "\x00a<s>hi</s><unk><0x41>",
    "日本語🙂​ ãã",
    "aaaaaaaaaaaaaaaaaaa" * 40,
    "thth" * 2000,
    "1234567890.99 http://x.y/z?q=1",
]


def packed(ids):
    return list(memoryview(ids).cast("i"))


@pytest.mark.parametrize("text", TEXTS)
def test_fixed_texts(text):
    ids = packed(OWN.encode(text))
    assert ids == LIBRARY.encode(text, add_eos=True)
    assert OWN.decode(ids) == LIBRARY.decode(ids)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from("abcdeinorst hlTHE.,é▁ñß🙂\n\t日本"), max_size=60))
def test_any_text(text):
    ids = packed(OWN.encode(text))
    assert ids == LIBRARY.encode(text, add_eos=True)
    assert OWN.decode(ids) == LIBRARY.decode(ids)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=30))
def test_any_character(text):
    ids = packed(OWN.encode(text))
    assert ids == LIBRARY.encode(text, add_eos=True)
    assert OWN.decode(ids) == LIBRARY.decode(ids)


def test_other_models_are_refused():
    model = pieces.model_format.ModelProto()
    model.ParseFromString(MODEL)
    model.trainer_spec.model_type = pieces.model_format.TrainerSpec.UNIGRAM
    with pytest.raises(ValueError):
        pieces.Vocabulary(model.SerializeToString())


def test_frames(spark):
    texts = [*TEXTS, None]
    rows = [(i, t, i, "x") for i, t in enumerate(texts)] + [(0, "", 0, "x"), (None, "a b", 1, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, ids long, decoded string")
    done = pieces.decode_documents(pieces.encode_documents(frame, MODEL), MODEL)
    assert done.count() == len(rows)
    for row in done.collect():
        assert row.ids == LIBRARY.encode(row.text or "", add_eos=True)
        assert row.decoded == LIBRARY.decode(row.ids)
    digest = {r.doc_id: r for r in pieces.encoding_digest(frame.where("doc_id > 3"), MODEL).collect()}
    ids = LIBRARY.encode(TEXTS[5], add_eos=True)
    assert digest[5].n_tokens == len(ids)
    assert digest[5].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert digest[5].decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()
    assert pieces.encoding_digest(frame.limit(0), MODEL).collect() == []


def test_documents(spark, tables):
    frame = spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text")
    done = pieces.decode_documents(pieces.encode_documents(frame, MODEL), MODEL).collect()
    expected = LIBRARY.encode([row.text for row in done], add_eos=True)
    assert [list(row.ids) for row in done] == expected
    assert [row.decoded for row in done] == [row.text for row in done]
