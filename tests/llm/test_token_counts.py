"""Counts against the library on odd and ordinary texts, and the proof of the shortcut."""

import random

from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millwright.llm import token_counts as tc
from millwright.llm.queries import vocabulary

PATH = vocabulary("byte_bpe_50k.json")
ODD = "abcXYZ éñßüÄÖ   \n\n\t\r\x1c\x1f\x85\xa0'sdtlm0123½²ªº!?$%&<|>_-—“”…中文かなбвгαβςσΣİ 　​́eİıſKÅ𝒳😀"


def test_counts_equal_the_library():
    rng = random.Random(1)
    rows = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    rows += ["", " ", "<|endoftext|>", "a <|endoftext|>  b<|endoftext", "we'll don't  they've\n\n\n x", "Q" * 5000, " " * 3000, "the of and " * 3000]
    tokenizer = Tokenizer.from_file(PATH)
    for text, e in zip(rows, tokenizer.encode_batch(rows, add_special_tokens=False), strict=True):
        assert tc.count(text, PATH) == len(e.ids), repr(text)


def test_whole_tokens_are_one_token():
    tokenizer = Tokenizer.from_file(PATH)
    whole = list(tc.whole_tokens(tokenizer))
    assert len(whole) > 40_000 and " the" in whole
    assert all(len(e.ids) == 1 for e in tokenizer.encode_batch(random.Random(2).sample(whole, 2000), add_special_tokens=False))


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(tc, "CACHE", 10)
    tokenizer = Tokenizer.from_file(PATH)
    costs = tc.Costs(tokenizer, {" the": 1})
    words = [f" zqx{i}" for i in range(100)]
    assert [costs[w] for w in words] == [len(tokenizer.encode(w).ids) for w in words] and len(costs) <= 12


def test_rows(spark, docs):
    df = docs([(1, "hello world"), (1, "hello world"), (2, None), (3, ""), (None, "é")]).withColumn("n_tokens", F.lit("x"))
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in tc.token_counts(df, PATH, limit=1).collect()), key=str)
    assert got == [(1, 11, 2, True), (1, 11, 2, True), (2, 0, 0, False), (3, 0, 0, False), (None, 2, 1, False)]
    assert tc.token_counts(df.limit(0), PATH).count() == 0
