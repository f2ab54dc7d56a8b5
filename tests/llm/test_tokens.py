import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from calypile.llm import tokens as T

pytestmark = pytest.mark.skipif(not os.path.isdir(T.FOLDER), reason="needs the tokenizer files")


@given(st.lists(st.one_of(st.text(max_size=12), st.sampled_from(["\n", "\n\n", "  ", " a", "\t", "'s", " don't", "héllo ", "日本", "\r\n", "x" * 30, "\x85", "　", "12 34"])), max_size=40), st.integers(1, 30))
@settings(max_examples=300, deadline=None)
def test_safe_parts_encode_as_the_whole(pieces, limit):
    text = "".join(pieces)
    encode = T.encoding(T.rank_bytes()).encode_ordinary
    parts = T.safe_parts(text, limit)
    assert "".join(parts) == text
    assert [i for p in parts for i in encode(p)] == encode(text)


def test_ids_counts_and_round_trip(spark):
    texts = ["Hello world", "", None, "<|endoftext|> is text", "ünï ☃ 日本語\r\n\x00end", "word " * 60_000, "no break" * 40_000, "Hello world"]
    df = spark.createDataFrame([(i, t, "clash", 5) for i, t in enumerate(texts)], "doc_id bigint, text string, ids string, n_tokens int")
    encode = T.encoding(T.rank_bytes()).encode_ordinary
    got = {r["doc_id"]: r["ids"] for r in T.encode_ids(df, "doc_id", "text").collect()}
    assert got == {i: encode(t or "") for i, t in enumerate(texts)}
    assert {r["doc_id"]: r["n_tokens"] for r in T.count_tokens(df, "doc_id", "text").collect()} == {i: len(x) for i, x in got.items()}
    back = {r["doc_id"]: bytes(r["bytes"]) for r in T.decode_bytes(spark, T.encode_ids(df, "doc_id", "text"), "doc_id").collect()}
    assert back == {i: (t or "").encode() for i, t in enumerate(texts)}
    assert all(r["same"] for r in T.round_trip(df, "doc_id", "text").collect())
    assert T.encode_ids(df.limit(0), "doc_id", "text").collect() == []


def test_agrees_with_the_other_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{T.FOLDER}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    texts = ["From: A <a@b.c>\r\n\r\nIt's  10 000 µg → ok\n\n  indented\tTab", "ΑΒΓ абв 你好 👍🏽", "a" * 500]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = [r["ids"] for r in T.encode_ids(df, "doc_id", "text").orderBy("doc_id").collect()]
    assert got == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_invalid_utf8_and_large_files(spark, tmp_path):
    df = spark.sql("select 1L doc_id, cast(x'41ff42' as string) text")
    assert T.encode_ids(df, "doc_id", "text").first()["ids"] == T.encoding(T.rank_bytes()).encode_ordinary("A�B")
    (tmp_path / "big.tiktoken").write_bytes(b" " * (T.MAX_RANK_FILE + 1))
    with pytest.raises(ValueError):
        T.rank_bytes(str(tmp_path), "big")
