"""Token counts of a byte-level BPE by the whole-token shortcut.

`whole_tokens` proves once per process which vocabulary strings are a single pre-token that encodes alone as one token.
A text is cut into pre-tokens; those strings count one, only the others are merged by the library, and each of them
once per process. Texts with characters whose class may differ between Unicode versions, or with a special string
inside, are encoded whole by the library.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import texts

CACHE = 400_000
"""Merged pre-tokens that a process keeps; beyond it the table starts anew from the proven ones."""

# The pre-token pattern of the vocabulary, white space by the Unicode property.
PATTERN = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: Characters whose class no Unicode version has changed: Latin, Greek, Cyrillic, general punctuation, kana, ideographs.
UNSURE = regex.compile(r"[^\x00-ɏΑ-ΡΣ-ϿЀ-џ -⁯぀-ゖァ-ヺ一-龥]")


class Costs(dict):
    """Pre-token -> number of tokens; a missing one is merged by the library."""

    def __init__(self, tokenizer, proven: dict[str, int]):
        super().__init__(proven)
        self.tokenizer, self.proven = tokenizer, proven

    def __missing__(self, pre_token: str) -> int:
        n = len(self.tokenizer.encode(pre_token, add_special_tokens=False).ids)
        if len(self) > CACHE:
            self.clear()
            self.update(self.proven)
        self[pre_token] = n
        return n


def whole_tokens(tokenizer) -> dict[str, int]:
    """The vocabulary strings that are one pre-token and encode alone as one token."""
    special = {x.content for x in tokenizer.get_added_tokens_decoder().values()}
    words = [tokenizer.decode([i], skip_special_tokens=False) for i in range(tokenizer.get_vocab_size())]
    words = [w for w in dict.fromkeys(words) if w and "�" not in w and w not in special and PATTERN.fullmatch(w)]
    found = tokenizer.encode_batch(words, add_special_tokens=False)
    return {w: 1 for w, x in zip(words, found, strict=True) if len(x.ids) == 1 and PATTERN.findall(w) == [w]}


@lru_cache(maxsize=2)
def _loaded(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    marks = [x.content for x in tokenizer.get_added_tokens_decoder().values()]
    return tokenizer, Costs(tokenizer, whole_tokens(tokenizer)), marks


def count(text: str, path: str) -> int:
    """Tokens of one text."""
    tokenizer, costs, marks = _loaded(path)
    if UNSURE.search(text) or any(m in text for m in marks):
        return len(tokenizer.encode(text, add_special_tokens=False).ids)
    return sum(map(costs.__getitem__, PATTERN.findall(text)))


def token_counts(df: DataFrame, path: str, limit: int = 512, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of every row; one narrow pass, no shuffle.

    Null and empty texts have 0 tokens; repeated rows are counted each; other columns are not read; an empty table
    gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = texts(batch.column(1))
            n = [count(x, path) for x in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x.encode()) for x in rows], pa.int64()), pa.array(n, pa.int64()),
                 pa.array([x > limit for x in n], pa.bool_())],
                [key, "n_bytes", "n_tokens", "over_limit"],
            )

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
