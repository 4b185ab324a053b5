"""Encoding against the library, BPE and unigram; decoding as a round trip."""

import random

import corpus
import pytest
import sentencepiece
from lexiquarry.llm import sentencepiece_sa as S
from sentencepiece import sentencepiece_model_pb2 as pb

ODD = ["", None, "  a  b ", "x▁y ▁", "▁", "▁▁▁▁ a", "aaa aaaa aaaaaaa", "日本語 テキスト 😀😀", "\n\n a\tb\n", "a b 　", "<s> </s> <0x0A> <unk>", "ééé", " ", "a" * 3000, "\x00a\x00 b", "ﬀ ǅ \U0010ffff", "     " * 9]


def frame(spark, texts):
    return corpus.frame(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)])


def test_bpe(spark):
    rng = random.Random(4)
    texts = ODD + [r[1] for r in corpus.rows()] + ["".join(rng.choice("abe ▁.\nthinger ") for _ in range(80)) for _ in range(150)]
    docs = corpus.clashing(frame(spark, texts))
    library = sentencepiece.SentencePieceProcessor(model_file=S.MODEL)
    coded = S.encode(docs).cache()
    got = {r.doc_id: r for r in coded.collect()}
    for i, t in enumerate(texts):
        assert got[i].ids == library.encode(t or ""), repr(t)[:80]
        assert got[i].n_tokens == len(got[i].ids)
    back = {r.doc_id: r.text for r in S.decode(coded).collect()}
    for i, t in enumerate(texts):
        assert back[i] == (t or "").replace("▁", " ")
    assert S.encode(docs.limit(0)).count() == 0


@pytest.mark.parametrize("fallback", [True, False])
def test_unigram(spark, tmp_path, fallback):
    """A hand-made unigram model."""
    rng = random.Random(1)
    proto = pb.ModelProto()
    proto.trainer_spec.model_type = 1
    proto.trainer_spec.byte_fallback = fallback
    proto.normalizer_spec.name = "identity"
    proto.normalizer_spec.remove_extra_whitespaces = False
    add = lambda t, s, k=1: proto.pieces.add(piece=t, score=s, type=k)
    add("<unk>", 0, 2)
    if fallback:
        for b in range(256):
            add(f"<0x{b:02X}>", 0, 6)
    pieces = set("abcdeé▁") | {"".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 11))) for _ in range(300)} | {"▁" + "".join(rng.choice("abcde") for _ in range(rng.randint(1, 9))) for _ in range(80)}
    for t in sorted(pieces):
        add(t, -rng.uniform(3, 12) - 0.3 * (len(t) == 1))
    path = tmp_path / "m.model"
    path.write_bytes(proto.SerializeToString())
    library = sentencepiece.SentencePieceProcessor(model_file=str(path))
    texts = ["", None, "a", "zz q"] + ["".join(rng.choice("abcdeabcdeé ") for _ in range(rng.randint(1, 60))) for _ in range(200)] + ["abz dé😀e"]
    got = {r.doc_id: r.ids for r in S.encode(frame(spark, texts), model=str(path)).collect()}
    for i, t in enumerate(texts):
        want = library.encode(t or "")
        # the library joins neighbouring unknown signs into one
        squeeze = lambda ids: [x for j, x in enumerate(ids) if x != 0 or j == 0 or ids[j - 1] != 0]
        own, want = squeeze(got[i]), squeeze(want)
        if own != want:  # equal paths up to the library's rounding to single precision
            score = lambda ids: sum(proto.pieces[x].score for x in ids)
            assert abs(score(own) - score(want)) < 1e-3 and library.decode(own) == library.decode(want), t
