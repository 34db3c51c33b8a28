"""Counts through the cache equal the library's, and known texts are not encoded again."""

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from letterflow.llm import token_cache

SCHEMA = "doc_id long, text string, n_tokens string, digest int"
TEXTS = ["Hello there, world.", "", None, "</s> <s> <unk>", "  two  blanks\n\n", "Hello there, world.", "日本 😀 é",
         "word " * 30_000, "<|endoftext|>"]


def rows():
    return [(k, t, "clash", 1) for k, t in enumerate(TEXTS)] + [(None, "no id", None, None), (3, TEXTS[3], None, None)]


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json"])
def test_counts_and_appends(spark, tmp_path, name):
    path = public_tokenizers.path(name)
    if name.endswith(".json"):
        library = Tokenizer.from_file(path)
        count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    else:
        library = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(library.encode(t))
    cache = str(tmp_path / "cache")
    docs = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    want = sorted((str(d), len((t or "").encode()), count(t or "")) for d, t, *_ in rows())
    got = lambda out: sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in out.collect())
    first = token_cache.count_tokens(docs, path, cache)
    assert first.columns == ["doc_id", "digest", "n_bytes", "n_tokens"]
    assert got(first) == want
    stored = token_cache.read_cache(spark, cache)
    distinct = len({t or "" for _, t, *_ in rows()})
    assert stored.count() == distinct

    # a second run encodes only what is new, and takes the rest from the cache as it stands
    more = docs.unionAll(spark.createDataFrame([(50, "new text", None, None)], SCHEMA))
    assert got(token_cache.count_tokens(more, path, cache)) == sorted(want + [("50", 8, count("new text"))])
    assert token_cache.read_cache(spark, cache).count() == distinct + 1


def test_versions_are_apart(spark, tmp_path):
    cache = str(tmp_path / "cache")
    docs = spark.createDataFrame([(1, "Hello there", None, None)], SCHEMA)
    for k, name in enumerate(["piece_bpe_32k.model", "byte_bpe_50k.json", "piece_bpe_32k.model"]):
        token_cache.count_tokens(docs, public_tokenizers.path(name), cache)
        assert token_cache.read_cache(spark, cache).count() == min(k + 1, 2)


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], SCHEMA)
    out = token_cache.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"), str(tmp_path / "cache"))
    assert out.collect() == []
