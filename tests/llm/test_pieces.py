"""SentencePiece encoding with offsets, and decoding, against the library."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from panelkit.llm import piece_codec
from panelkit.llm.common import documents
from panelkit.llm.queries import queries

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "   ", "a  b   c    ", "\n\t x", "日本語テキスト", "a▁b", "▁", "<s> </s> <unk> <0x0A>", "😀😀é", "a" * 5000, "ab" * 3000, " " * 1000,
       "ＡＢＣ　ﬁ ½ ﷺ  Ⅷ x́", " 　 ", "ſtraße İstanbul  ", "ガギ", "\r\n\x01​ a", "​ \x01゙x"]


def texts(seed, n=600):
    rng = random.Random(seed)
    letters = "aeinrst lo▁ \n日😀é1ＡﬁガⅧ　​\x01½"
    return ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def check(path, some):
    codec, library = piece_codec.PieceCodec(path), sentencepiece.SentencePieceProcessor(model_file=path)
    for text in some:
        want = library.encode(text, return_type="proto").pieces
        ids, begins, ends = (a.tolist() for a in codec.encode(text))
        assert list(zip(ids, begins, ends)) == [(p.id, p.begin, p.end) for p in want], text
        assert codec.decode(ids) == library.decode(ids), text


def test_pieces_and_spans_equal_the_library():
    check(PATH, texts(1, 2000))


@pytest.mark.parametrize("trim", [True, False])
@pytest.mark.parametrize("prefix", [True, False])
@pytest.mark.parametrize("fallback", [True, False])
def test_character_map_and_spaces(tmp_path, trim, prefix, fallback):
    model, rules = sentencepiece_model_pb2.ModelProto(), sentencepiece_model_pb2.ModelProto()
    with open(PATH, "rb") as f:
        model.ParseFromString(f.read())
    rules.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc_cf").serialized_model_proto())
    spec = model.normalizer_spec
    spec.precompiled_charsmap, spec.remove_extra_whitespaces, spec.add_dummy_prefix = rules.normalizer_spec.precompiled_charsmap, trim, prefix
    if not fallback:
        model.trainer_spec.byte_fallback = False
        for piece in model.pieces:
            piece.type = 1 if piece.type == piece_codec.BYTE else piece.type
    path = tmp_path / "own.model"
    path.write_bytes(model.SerializeToString())
    check(str(path), texts(2))


def test_decoding_any_ids():
    codec, library, rng = piece_codec.PieceCodec(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH), random.Random(3)
    for _ in range(5000):
        ids = [rng.randrange(32000) if rng.random() < 0.5 else rng.randrange(259) for _ in range(rng.randint(0, 12))]
        assert codec.decode(ids) == library.decode(ids), ids


def test_long_run_without_a_cut():
    codec = piece_codec.PieceCodec(PATH)
    text = "ab" * 200_000
    assert codec.encode(text)[0].tolist() == sentencepiece.SentencePieceProcessor(model_file=PATH).encode(text)


def test_query_equals_the_library(spark, small):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    known = {r["doc_id"]: r["text"] or "" for r in documents(spark, small).collect()}
    got = {r["doc_id"]: r for r in queries()["op11_piece_codec"](spark, small).collect()}
    assert got.keys() == known.keys()
    for doc_id, text in known.items():
        ids, row = library.encode(text), got[doc_id]
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (row["n_tokens"], row["ids_sha256"], row["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))
        assert row["end_byte"] == len(text.encode())


def test_odd_rows(spark):
    rows = [(None, "null id", 1, 2), (1, None, 1, 2), (1, None, 1, 2), (2, "", 1, 2), (3, "x " * 40_000, 1, 2)]
    table = spark.createDataFrame(rows, "doc_id long, text string, ids int, pieces int")
    coded = piece_codec.encode(table, PATH)
    assert coded.columns == table.columns and coded.count() == 5
    back = coded.select("doc_id", "text", piece_codec.decode(F.col("pieces.ids"), PATH).alias("back")).collect()
    assert all(r["back"] == (r["text"] or "") for r in back)
    assert piece_codec.round_trips(table, PATH).count() == 5
    assert piece_codec.round_trips(table.limit(0), PATH).count() == 0
    assert spark.range(1).select(piece_codec.decode(F.lit(None).cast("array<int>"), PATH).alias("x")).first()["x"] is None
