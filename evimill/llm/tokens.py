"""Token ids of byte-level BPE vocabularies in the tokenizers library's format."""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import tiktoken
from tokenizers import Tokenizer

#: How byte-level BPE splits a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Beyond these letters and signs the two libraries may know different versions of Unicode.
UNUSUAL = re.compile("[^\x00-\u02ff\u0370-\u04ff\u2000-\u206f]")


def byte_symbols() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


@lru_cache(maxsize=2)
def defining(path: str) -> Tokenizer:
    """The vocabulary in the library whose counts and ids it stands for; loaded where a text needs it."""
    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def _fast(path: str) -> tiktoken.Encoding:
    """The same vocabulary in the faster library, merges ranked by id."""
    with open(path, encoding="utf-8") as file:
        vocabulary = json.load(file)
    symbols = byte_symbols()
    special = {token["content"]: token["id"] for token in vocabulary["added_tokens"]}
    ranks = {
        bytes(symbols[c] for c in token): number
        for token, number in vocabulary["model"]["vocab"].items()
        if token not in special
    }
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


def token_ids(path: str, text: str) -> np.ndarray:
    """Ids as the tokenizers library gives them without added special tokens."""
    if text.isascii() or not UNUSUAL.search(text):
        return _fast(path).encode_to_numpy(text, allowed_special="all").astype(np.uint32, copy=False)
    return np.array(defining(path).encode(text, add_special_tokens=False).ids, dtype=np.uint32)
