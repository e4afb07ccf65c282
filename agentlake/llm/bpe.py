"""Byte-level BPE of a public vocabulary file, loaded once in each Python worker."""

from __future__ import annotations

import base64
import functools

import numpy as np
import tiktoken

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.cache
def encoding(vocabulary: str = VOCABULARY) -> tiktoken.Encoding:
    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.cache
def token_bytes(vocabulary: str = VOCABULARY) -> np.ndarray:
    """Number of bytes of every token."""
    known = encoding(vocabulary)
    lengths = np.zeros(known.max_token_value + 1, np.int64)
    for token in known.token_byte_values():
        lengths[known.encode_single_token(token)] = len(token)
    return lengths
