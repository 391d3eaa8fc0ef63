"""Piece ids against a plain search, the sentencepiece library and the round trip."""

from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.data import DOCS, clashing, documents, frame
from tidemark.llm import pieces

MODEL = pieces.PieceModel.load()
CODEC = pieces.Codec(MODEL)
SCORES = {text: (score, i) for text, score, i in MODEL.pieces}


def ids(text):
    import numpy as np

    return np.frombuffer(CODEC.encode(text), np.int32).tolist()


def best_score(text):
    unknown = min(s for s, _ in SCORES.values()) - pieces.UNKNOWN_PENALTY
    best = [0.0]
    for i in range(1, len(text) + 1):
        options = [best[j] + SCORES[text[j:i]][0] for j in range(max(0, i - 48), i) if text[j:i] in SCORES]
        best.append(max(options + ([best[i - 1] + unknown] if text[i - 1] not in SCORES else [])))
    return best[-1]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abc the ingé▁\n🙂ß  xyz漢", max_size=25))
def test_round_trip_and_best_score(text):
    got = ids(text)
    assert CODEC.decode(got) == text.encode()
    if text:
        score_of = {i: s for s, i in SCORES.values()}
        unknown = min(score_of.values()) - pieces.UNKNOWN_PENALTY
        total, k, whole = 0.0, 0, (" " + text)
        raw = [i for i in got]
        while k < len(raw):
            if raw[k] in score_of:
                total, k = total + score_of[raw[k]], k + 1
            else:  # the bytes of one character
                first = MODEL.byte_ids.index(raw[k])
                total, k = total + unknown, k + (1 if first < 128 else 2 if first < 224 else 3 if first < 240 else 4)
        assert abs(total - best_score(whole)) <= 1e-6 * max(1, abs(total))


def test_equals_the_library_on_a_unigram_model():
    """The same pieces with distinct scores, as a unigram model of the library."""
    import math
    import random

    import sentencepiece as sp
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(open(pieces.MODEL, "rb").read())
    rng = random.Random(2)
    for p in proto.pieces:
        if p.type == pb.ModelProto.SentencePiece.NORMAL:
            p.score = -math.log(2 + rng.random() * 30000)
    proto.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
    lib = sp.SentencePieceProcessor(model_proto=proto.SerializeToString())
    own = [(lib.id_to_piece(i).replace(pieces.BLANK, " "), lib.get_score(i), i) for i in range(lib.vocab_size()) if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i))]
    codec = pieces.Codec(pieces.PieceModel(tuple(own), MODEL.byte_ids, MODEL.unknown, MODEL.decode_table, True))
    import numpy as np

    for _ in range(200):
        text = "".join(rng.choice(["the", " ", "in", "g", "é", "ß", "qu", "eau", "\n", "z", "漢", "🙂"]) for _ in range(rng.randint(1, 30)))
        assert np.frombuffer(codec.encode(text), np.int32).tolist() == lib.encode(text)


def test_frames(spark):
    df = clashing(frame(spark))
    done = pieces.encode(df, MODEL, verify=True)
    rows = done.collect()
    assert len(rows) == len(documents()) and all(r["round_trip"] for r in rows)
    assert all((r["piece_ids"] == []) == (not r["row"]["text"]) for r in rows)
    back = pieces.decode(done.select("row.doc_id", "row.text", "piece_ids"), MODEL).collect()
    assert all(r["decoded"] == (r["row"]["text"] or "") for r in back)
    assert pieces.encode(spark.createDataFrame([], DOCS), MODEL).count() == 0
    nulls = spark.createDataFrame([(1, None), (2, [300, 268])], "doc_id long, piece_ids array<int>")
    assert {r["row"]["doc_id"]: r["decoded"] for r in pieces.decode(nulls, MODEL).collect()}[1] == ""


def test_cache_limit_changes_nothing(monkeypatch):
    monkeypatch.setattr(pieces, "CACHE", 2)
    small = pieces.Codec(MODEL)
    text = "the ending of that thing and the rest of it " * 3
    assert small.encode(text) == CODEC.encode(text) and len(small.ids_of) <= 2


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abc theingé▁\n🙂ßxyz漢qu", min_size=1, max_size=40), min_size=1, max_size=30))
def test_words_side_by_side_equal_single_ones(words):
    import numpy as np

    got = CODEC.automaton.best_paths(words)
    assert [np.frombuffer(p, np.int32).tolist() for p, _ in got] == [CODEC.automaton.best_path(w) for w in words]
    assert [b for _, b in got] == [w.encode() for w in words]
