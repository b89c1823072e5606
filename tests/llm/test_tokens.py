import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import tokens
from tidemark.llm.common import vocabulary_path

PATH = vocabulary_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def reference(library, text):
    return len(library.encode(text, add_special_tokens=False).ids)


@given(st.text(max_size=80))
@settings(max_examples=300, deadline=None)
def test_equals_the_library_on_any_text(text):
    from tokenizers import Tokenizer

    global _lib
    try:
        lib = _lib
    except NameError:
        lib = _lib = Tokenizer.from_file(PATH)
    assert tokens.count_tokens(text, PATH) == reference(lib, text)


@pytest.mark.parametrize("text", ["", "a<|endoftext|> b  c\n\n<|endoftext|>", "<|endoftext|><|endoftext|>", " " * 300 + "x", "é" * 400, "a" * 5000, "don't I'LL 123abc", "日本語 テキスト", "\x1c\x1d a\u0085b"])
def test_equals_the_library_on_hard_texts(text, library):
    assert tokens.count_tokens(text, PATH) == reference(library, text)


def test_whole_tokens_are_one_token_each(library):
    whole = list(tokens.vocabulary(PATH).whole)
    assert len(whole) > 49_000
    for text in whole[::97]:
        assert reference(library, text) == 1


def test_long_and_short_merging_agree():
    vocab = tokens.vocabulary(PATH)
    for piece in (b"thereupon", b"aaaaaaaaaaaaaaa", b"internationalisation" * 4, bytes(range(200))):
        assert vocab.merge_count(piece) == vocab._merge_long(piece)


def test_rows_of_every_kind(spark, library):
    rows = [(1, "hello world", "x"), (1, "hello world", "x"), (None, None, "y"), (2, "", "z"), (3, "word " * 3000, "w")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string")
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.token_counts(df).collect()), key=str)
    want = sorted(((d, len((t or "").encode()), reference(library, t or ""), reference(library, t or "") > 1024) for d, t, _ in rows), key=str)
    assert got == want
    assert tokens.token_counts(df.where("doc_id = 99")).count() == 0
