import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from docweave.llm import token_counts as T

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def compiled():
    return T.load_tokenizer(PATH)


def wanted(library, texts):
    return [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_contractions_spaces_and_specials(library, compiled):
    texts = [
        "", " ", "  ", "\n", "a", "don't", "'tis 's 're 've 'll 'd 'm ''s '' 'r 'v 'l 'lx 'rx 'e", "it's'll've'r", "x'",
        "a  b\n\n c \t d   ", "  lead", "trail  ", "1234 567,89", "é'sß 't", "a b  c\u0085d\x1ce", "日本語テキスト 🎉🎉 ok",
        "<|endoftext|>", "a<|endoftext|>b", " <|endoftext|> <|endoftext|><|endoftext|>", "<|endoftext|", "\x00\x00 a\x00", "'R'S",
        "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "=" * 999, " " * 777, "the" * 500,
    ]
    assert compiled.counts(texts) == wanted(library, texts)
    for text in texts:
        assert compiled.counts([text]) == wanted(library, [text])


def test_random_texts(library, compiled, monkeypatch):
    rng = random.Random(3)
    alphabet = list("stmdrvle'' \n\t019.,!-aZé  ü漢🎉") + ["'re", "'ll", "the", "ing", "  ", "<|endoftext|>", "tion"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.choice([1, 5, 40, 700]))) for _ in range(600)]
    assert compiled.counts(texts) == wanted(library, texts)
    monkeypatch.setattr(T, "CHUNK", 3)
    monkeypatch.setattr(T, "MOST_STATES", 50)
    assert compiled.counts(texts) == wanted(library, texts)


def test_operator_over_documents(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(8001, None), (8002, ""), (8002, ""), (None, "x " * 50000)]
    frame = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, n_tokens int")
    got = sorted(map(tuple, T.count_tokens(frame, PATH).collect()), key=str)
    texts = [t or "" for _, t in rows]
    want = [
        (i, len(t.encode()), n, n > 1024) for (i, _), t, n in zip(rows, texts, wanted(library, texts), strict=True)
    ]
    assert got == sorted(want, key=str)
    assert T.count_tokens(frame.where("false"), PATH).collect() == []


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        T.load_tokenizer(public_tokenizers.path("word_bpe_49k.json"))
