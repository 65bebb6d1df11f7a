"""Text sizes in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.runtime import spread

#: Rank file of a byte-level BPE; a parameter everywhere, never copied.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern by which this vocabulary's public tokenizer cuts a text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def load(path: str, pattern: str = PATTERN) -> Any:
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def count_tokens(docs: DataFrame, path: str = TOKENIZER, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_tokens of the whole text (NULL text: 0) and the columns to ``keep``; one row per row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = load(path)
        for b in batches:
            # what looks like a special token in a text is ordinary text
            n = [len(enc.encode_ordinary(t)) if isinstance(t, str) and t else 0 for t in b["text"]]
            yield b.drop(columns=["text"]).assign(n_tokens=n)[["doc_id", *keep, "n_tokens"]]

    kinds = dict(docs.dtypes)
    schema = "doc_id bigint, " + "".join(f"{c} {kinds[c]}, " for c in keep) + "n_tokens bigint"
    return spread(docs.select(F.coalesce("doc_id", F.lit(-1)).alias("doc_id"), *keep, "text")).mapInPandas(run, schema)
