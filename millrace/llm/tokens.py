"""Token counts by a public tokenizer whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary lies here: lines of a token in base 64 and its rank.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the split of byte-level tokenizers into words, numbers, signs and blanks.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(4)
def encoding(vocabulary: bytes):  # noqa: ANN201
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count(text: str | None, vocabulary: bytes) -> int:
    if not text:
        return 0
    try:
        return len(encoding(vocabulary).encode_ordinary(text))
    except UnicodeEncodeError:  # lone surrogates
        return len(encoding(vocabulary).encode_ordinary(text.encode("utf-8", "replace").decode("utf-8")))


def with_tokens(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, tokens): a row for each document id; 0 tokens for null and empty texts, the most for an id that has several texts."""
    with open(vocabulary, "rb") as f:
        sent = documents.sparkSession.sparkContext.broadcast(f.read())

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "source": b["source"], "tokens": [count(t, sent.value) for t in b["text"]]})

    rows = documents.where("doc_id is not null").select("doc_id", "source", "text").mapInPandas(counted, "doc_id long, source string, tokens long")
    return rows.groupBy("doc_id").agg(F.max_by("source", "tokens").alias("source"), F.max("tokens").alias("tokens"))
