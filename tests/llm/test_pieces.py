import random
import time

import numpy as np
import pytest

from tests.llm.data import awkward, empty
from vertexloom.llm import pieces, queries

TEXTS = ["", " ", "a", "Hello  world\n", " lead", "tail ", "don't stop: 3.14%", "ÀÉ Straße 中文 \U0001f600", "tabs\tand\r\n\n\nlines", "x" * 3000, "▁ literal", "of of of of", "².²x_y__z"]


@pytest.fixture(scope="module")
def vocab():
    return pieces.vocabulary()


def brute_best(word, vocab):
    """The best log-probability of all segmentations, by recursion over the first piece."""
    memo = {"": 0.0}

    def best(rest):
        if rest not in memo:
            options = [vocab.byte_score * len(rest[0].encode()) + best(rest[1:])]
            options += [vocab.table[rest[:i]][1] + best(rest[i:]) for i in range(1, min(len(rest), vocab.longest) + 1) if rest[:i] in vocab.table]
            memo[rest] = max(options)
        return memo[rest]

    return best(word)


def score_of(ids, vocab):
    by_id = {i: s for i, s in vocab.table.values()}
    return sum(by_id.get(i, vocab.byte_score) for i in ids)


def test_best_segmentation_with_shared_prefixes(vocab):
    rng = random.Random(1)
    parts = ["an", "ti", "the", "tion", "es", "é", "中", "\U0001f600", "q", "x", "▁", "1", "_", "."]
    made = sorted({"".join(rng.choice(parts) for _ in range(rng.randrange(1, 7))) for _ in range(400)})
    for word, ids in pieces.encode_words(made, vocab):
        assert score_of(ids, vocab) == pytest.approx(brute_best(word, vocab), abs=1e-6)
        assert b"".join(vocab.bytes_of[i] for i in ids) == word.replace("▁", " ").encode()


@pytest.mark.parametrize("text", TEXTS)
def test_round_trip(vocab, text):
    ids = np.frombuffer(pieces.Encoder()([text])[0], dtype=np.int32).tolist()
    assert pieces.decode(ids, vocab) == text.replace("▁", " ")
    assert bool(ids) == bool(text)


def test_cuts_never_hurt(vocab):
    """Words encoded apart are as good as the whole marked text at once."""
    for text in ("in the, end (of it).", "a-b c_d e²f", "x\n\ny"):
        marked = "▁" + text.replace(" ", "▁")
        apart = sum(score_of(ids, vocab) for w in vocab.cut(text) for _, ids in pieces.encode_words([w], vocab))
        assert "".join(vocab.cut(text)) == marked
        assert apart == pytest.approx(brute_best(marked, vocab), abs=1e-6)


def test_frames(spark):
    df = awkward(spark)
    coded = pieces.encode(df, check="ok").collect()
    assert len(coded) == df.count() and all(r["ok"] for r in coded)
    by = {r["doc_id"]: r for r in coded}
    assert by[2]["pieces"] is None and by[3]["pieces"] == []
    back = pieces.decode_column(pieces.encode(df)).collect()
    assert all(r["decoded"] == r["text"] for r in back)


def test_clashing_names_and_empty_table(spark):
    df = spark.createDataFrame([("a b", "old", 1)], "text string, pieces string, decoded int")
    out = pieces.decode_column(pieces.encode(df))
    assert out.first()["decoded"] == "a b"
    assert pieces.encode(empty(spark)).count() == 0


def test_query_against_brute_force(spark, tmp_path, vocab):
    """The whole query: every text's pieces are as likely as the best segmentation of its marked text, and decode to it."""
    rng = random.Random(4)
    letters = "abcdefghijklmnop éß中.,1_\n"
    texts = [*TEXTS[:9], *TEXTS[10:], None, *("".join(rng.choice(letters) for _ in range(rng.randrange(1, 60))) for _ in range(60))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r["doc_id"]: r for r in queries.op9_pieces(spark, str(tmp_path)).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        if text is None:
            assert rows[i]["pieces"] is None
            continue
        marked = "▁" + text.replace(" ", "▁") if text else ""
        assert score_of(rows[i]["pieces"], vocab) == pytest.approx(brute_best(marked, vocab), abs=1e-6)
        assert rows[i]["n_pieces"] == len(rows[i]["pieces"]) and rows[i]["round_trip"]
        assert pieces.decode(rows[i]["pieces"], vocab) == text.replace("▁", " ")


def test_long_words_take_linear_time():
    encoder, word = pieces.Encoder(), "".join(random.Random(5).choices("abcdefghijklmnopqrstuvwxyz", k=4_000_000))
    began = time.perf_counter()
    (coded,) = encoder([word])
    took = time.perf_counter() - began
    assert took < 120 and pieces.decode(np.frombuffer(coded, np.int32).tolist(), encoder.vocab) == word


def test_agreement_with_the_librarys_merge_order(vocab):
    """The README's share: words of mixed languages that the Zipf law segments as the library's merges do."""
    sentencepiece = pytest.importorskip("sentencepiece")
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    plain = [p.lstrip("▁") for p in vocab.table if p.startswith("▁") and p[1:].isalpha()]
    rng = random.Random(6)
    made = sorted({rng.choice(plain) + rng.choice(["", rng.choice(plain).lower()]) for _ in range(3000)})
    coded = pieces.Encoder()(made)
    same = sum(np.frombuffer(c, np.int32).tolist() == model.encode(w) for w, c in zip(made, coded, strict=True)) / len(made)
    assert 0.6 < same <= 1
