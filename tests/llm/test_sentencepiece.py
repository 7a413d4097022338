import hashlib
import random
from pathlib import Path

import numpy as np
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2

from lectern.llm import sentencepiece_scan as S
from lectern.llm.entry import MODEL

BPE = Path(MODEL).read_bytes()


def unigram_model() -> bytes:
    """A model file with chosen pieces and scores (nothing is trained)."""
    m = sentencepiece_model_pb2.ModelProto()
    m.trainer_spec.model_type, m.trainer_spec.byte_fallback, m.trainer_spec.unk_id = m.trainer_spec.UNIGRAM, True, 0
    m.normalizer_spec.name, m.normalizer_spec.add_dummy_prefix = "identity", True
    m.normalizer_spec.remove_extra_whitespaces, m.normalizer_spec.escape_whitespaces = False, True
    m.pieces.add(piece="<unk>", score=0, type=2)
    for b in range(256):
        m.pieces.add(piece=f"<0x{b:02X}>", score=0, type=6)
    rng = random.Random(3)
    texts = {"".join(rng.choice("abe th") for _ in range(rng.randint(1, 6))).replace(" ", "▁") for _ in range(300)} | set("abeth▁")
    for t in sorted(t for t in texts if "▁" not in t.lstrip("▁")):
        m.pieces.add(piece=t, score=-rng.uniform(1, 3) - len(t) * rng.uniform(0.7, 1.0), type=1)
    return m.SerializeToString()


UNIGRAM = unigram_model()
VOCABULARIES = {"bpe": S.Vocabulary(BPE), "unigram": S.Vocabulary(UNIGRAM)}
NATIVE = {"bpe": sentencepiece.SentencePieceProcessor(model_proto=BPE), "unigram": sentencepiece.SentencePieceProcessor(model_proto=UNIGRAM)}
ALPHABETS = ["ab", "a b", "the ", "aeiou st", "  x", "abe th", "aéß\n中🚀 x", "er in\n", "<s>0xA ", "<unk> ", "\x00\x01 a\t\r\x0b", "aaaa", "ing the of\n  "]


def by_chunks(v, text, size):
    parts = list(v.parts(" " + text, size))
    path = S.states([v.transfer(*p) for p in parts])
    return [i for p, a, b in zip(parts, path[:-1], path[1:], strict=True) for i in v.trace(*p, a, b)]


def spelt(model, ids):
    table = S.spellings(model)
    return b"".join(table[i] for i in ids)


def same(v, ids, expected):
    """Equal ids; for a unigram model also another path of the same score."""
    score = {i: s for i, s in v.pieces.values()}
    if v.merges:
        assert ids == expected
    elif ids != expected:
        assert spelt(UNIGRAM, ids) == spelt(UNIGRAM, expected)
        assert abs(sum(score.get(i, 0) for i in ids) - sum(score.get(i, 0) for i in expected)) < 1e-3


@pytest.mark.parametrize("kind", ["bpe", "unigram"])
def test_ids_are_those_of_the_model(kind):
    v, rng = VOCABULARIES[kind], random.Random(4)
    for alphabet in ALPHABETS:
        for _ in range(12):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 400)))
            expected = NATIVE[kind].encode(text)
            same(v, v.encode(text), expected)
            for size in (2 * v.longest + 2, 64):
                same(v, by_chunks(v, text, size), expected)


@pytest.mark.parametrize("kind", ["bpe", "unigram"])
def test_one_giant_word(kind):
    """No place in it falls apart, so whole matrices are combined."""
    v, rng = VOCABULARIES[kind], random.Random(5)
    text = "".join(rng.choice("abeth") for _ in range(5000))
    assert v.cuts(text, 0, 5000) == (0, 0)
    same(v, by_chunks(v, text, 300), NATIVE[kind].encode(text))


def test_literal_marks_round_trip():
    v = VOCABULARIES["bpe"]
    for text in ("▁", "a▁ ▁b", "▁▁ x", " ▁" * 60):
        ids = v.encode(text)
        assert spelt(BPE, ids) == b" " + text.encode()
        assert by_chunks(v, text, 40) == ids


def test_products_are_associative():
    rng = np.random.default_rng(1)
    a, b, c = (rng.integers(-9, 9, s).astype(float) for s in ((3, 5), (5, 4), (4, 6)))
    assert (S.times(S.times(a, b), c) == S.times(a, S.times(b, c))).all()


def test_models_that_change_texts_are_refused():
    m = sentencepiece_model_pb2.ModelProto.FromString(UNIGRAM)
    m.normalizer_spec.remove_extra_whitespaces = True
    with pytest.raises(ValueError):
        S.Vocabulary(m.SerializeToString())


def test_operator_on_nulls_repeats_and_giants(spark):
    giant = "the ends of it, und größer\n" * 3000 + "x" * 20_000 + " 中 ▁" * 200
    plain = "the ends of it, und größer\n" * 3000 + "xyz" * 9_000
    rows = [(1, None, 0), (2, "", 0), (2, "", 0), (None, "a b", 0), (3, giant, 0), (3, giant, 0), (4, "  \n", 0), (5, plain, 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids int").repartition(2)
    got = S.decode(S.encode(docs, MODEL, chunk=4096), MODEL).collect()
    assert sorted((r["doc_id"] or 0, r["decoded"], r["n_chars"]) for r in got) == sorted((i or 0, t or "", len(t or "")) for i, t, _ in rows)
    assert all(r["ids"] == [] for r in got if not r["decoded"])
    assert [r["ids"] for r in got if r["doc_id"] == 5] == [NATIVE["bpe"].encode(plain)]
    assert S.decode(S.encode(docs.limit(0), MODEL), MODEL).count() == 0


def test_decode_defined_results(spark):
    rows = spark.createDataFrame([(1, None, "x"), (2, [], "y"), (3, [None, -5, 99_999_999], "z")], "doc_id int, ids array<int>, decoded string")
    assert {r["doc_id"]: r["decoded"] for r in S.decode(rows, MODEL).collect()} == {1: None, 2: "", 3: ""}


def test_pipeline_stage_decodes_too(spark):
    import corpus_pipeline

    texts = {1: "A quiet mill, é ß ▁ 漢\n", 2: "", 3: "grain " * 20_000}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in corpus_pipeline.encode(spark, docs, "").collect()}
    assert {i: r["decoded_sha256"] for i, r in got.items()} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in texts.items()}
    assert all(r["n_tokens"] == len(r["ids"]) for r in got.values())
