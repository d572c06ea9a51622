"""Token counts by a compiled tokenizer.

A BPE vocabulary is compiled into a deterministic transducer that reads a word byte by byte and
writes numbers of tokens. What decides about the tokens to come is, for each place at which a token
may still be open, how far it has come in the trie of tokens, which token ends right before it, and
how many tokens that makes. These open places are a state; a transition reads a byte, and emits the
tokens that all of its open places have in common. A token may follow another one if the two,
merged on their own, stay as they are; of all segmentations one has that property at every border,
and it is the one that merging the word gives. States are made when a text first needs them.

Long texts are cut into chunks. The map of a chunk says what it does to any state before it: up to
its first border the text is left open, then comes a number of tokens, after the last border the
text is open again. Maps compose associatively, so they are combined pairwise, level by level.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache
from typing import NamedTuple

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evimill.llm.texts import per_text
from evimill.llm.tokens import UNUSUAL, byte_symbols, defining

#: Code points that white space patterns of the vocabulary's library take.
SPACE = r"\x09-\x0d\x20\x85\xa0  -     　"
ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d|"
ASCII_WORDS = re.compile(ENDINGS + r"[a-z]+|[0-9]|[^\x09-\x0d\x20a-z0-9]+")
WORDS = regex.compile(ENDINGS + rf"[\p{{L}}]+|[\p{{N}}]|[^{SPACE}\p{{L}}\p{{N}}]+")
#: No word, special token or combined character reaches over one of these.
BORDER = re.compile(r"[\x09-\x0d\x20]")
#: States, and words with their counts, that a Python worker keeps before it starts anew.
MOST_STATES, MOST_WORDS = 500_000, 300_000


class Transducer:
    """Counts the tokens of byte strings under BPE ``merges`` with an end-of-word suffix."""

    def __init__(self, merges: list[tuple[str, str]], suffix: str):
        symbols = byte_symbols()
        self.suffix = suffix
        self.rank = {pair: k for k, pair in enumerate(merges)}
        self.character = {b: c for c, b in symbols.items()}
        # a node is a map from bytes to nodes; 256 leads to its token, 257 to its token at the end of a word
        self.trie: list[dict[int, int]] = [{}]
        self.tokens: list[str] = []
        for token in [*symbols, *(c + suffix for c in symbols), *(a + b for a, b in merges)]:
            final = token.endswith(suffix)
            node = 0
            for c in token.removesuffix(suffix):
                node = self.trie[node].setdefault(symbols[c], len(self.trie))
                if node == len(self.trie):
                    self.trie.append({})
            if self.trie[node].setdefault(256 + final, len(self.tokens)) == len(self.tokens):
                self.tokens.append(token)
        self.borders: dict[tuple[int, int], bool] = {}
        self.restart()

    def restart(self) -> None:
        self.number: dict[tuple, int] = {}
        self.places: list[tuple] = []
        self.step: dict[int, tuple[int, int]] = {}
        self.last: dict[int, int] = {}
        self.start = self._state([(0, -1, 0)])[0]

    def merged(self, token: str) -> list[str]:
        """Plain BPE over the characters of one or two tokens."""
        body = token.removesuffix(self.suffix)
        parts = [*body[:-1], token[len(body) - 1 :]]
        while len(parts) > 1:
            best, at = min((self.rank.get(pair, len(self.rank)), k) for k, pair in enumerate(zip(parts, parts[1:])))
            if best == len(self.rank):
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follows(self, left: int, right: int) -> bool:
        if left < 0:
            token = self.tokens[right]
            return self.borders.setdefault((left, right), self.merged(token) == [token])
        key = (left, right)
        if key not in self.borders:
            pair = [self.tokens[left], self.tokens[right]]
            self.borders[key] = self.merged("".join(pair)) == pair
        return self.borders[key]

    def _state(self, places: list[tuple[int, int, int]]) -> tuple[int, int]:
        """Number of the state of (node, token before, count) places, and what they have in common."""
        common = min(count for _, _, count in places)
        key = tuple(sorted((node, before, count - common) for node, before, count in places))
        if key not in self.number:
            self.number[key] = len(self.places)
            self.places.append(key)
        return self.number[key], common

    def _transition(self, state: int, byte: int) -> tuple[int, int]:
        moved, ended = [], None
        for node, before, count in self.places[state]:
            reached = self.trie[node].get(byte)
            if reached is None:
                continue
            token = self.trie[reached].get(256)
            if ended is None and token is not None and self.follows(before, token):
                ended = (0, token, count + 1)
            moved.append((reached, before, count))
        if ended is None:
            raise ValueError("the vocabulary lacks a byte")
        return self._state([*moved, ended])

    def _final(self, state: int) -> int:
        for node, before, count in self.places[state]:
            token = self.trie[node].get(257)
            if token is not None and self.follows(before, token):
                return count + 1
        raise ValueError("the vocabulary lacks a byte at the end of words")

    def count(self, word: bytes) -> int:
        """Tokens of a word; the empty word has none."""
        if not word:
            return 0
        if len(self.places) > MOST_STATES:
            self.restart()
        state, total, step = self.start, 0, self.step
        for byte in word:
            key = state << 8 | byte
            move = step.get(key)
            if move is None:
                move = step[key] = self._transition(state, byte)
            state = move[0]
            total += move[1]
        if state not in self.last:
            self.last[state] = self._final(state)
        return total + self.last[state]


class _Counted(dict):
    """Counts by word, filled by the transducer."""

    def __init__(self, transducer: Transducer):
        self.transducer = transducer

    def __missing__(self, word: str) -> int:
        if len(self) >= MOST_WORDS:
            self.clear()
        n = self[word] = self.transducer.count(word.encode("utf-8", "surrogatepass"))
        return n


class ChunkMap(NamedTuple):
    """What a chunk does to the open text before it. Without a border all of it is ``head``."""

    head: str
    border: bool
    tokens: int
    tail: str


class Counter:
    """Token counts of texts under one vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)
        model = vocabulary["model"]
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        self.words = _Counted(Transducer(merges, model["end_of_word_suffix"]))
        self.path = path
        special = sorted((token["content"] for token in vocabulary["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special)))
        self.bytes_of = byte_symbols()

    def closed(self, text: str) -> int:
        """Tokens of a text between borders; special tokens written in it are one each."""
        parts = self.special.split(text) if "<|" in text else [text]
        return len(parts) - 1 + sum(map(self._plain, parts))

    def _plain(self, text: str) -> int:
        counted = self.words.__getitem__
        if text.isascii():
            return sum(map(counted, ASCII_WORDS.findall(text.lower())))
        if not UNUSUAL.search(text):
            text = unicodedata.normalize("NFC", text)
            # the library lowers letter by letter, without the form of sigma at the end of words
            return sum(map(counted, WORDS.findall(text.replace("Σ", "σ").lower())))
        library = defining(self.path)
        words = library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(text))
        count = self.words.transducer.count
        return sum(count(bytes(self.bytes_of[c] for c in word)) for word, _ in words)

    def chunk(self, text: str) -> ChunkMap:
        first = BORDER.search(text)
        if first is None:
            return ChunkMap(text, False, 0, "")
        last = max(map(text.rfind, " \n\t\r\x0b\x0c"))
        return ChunkMap(text[: first.start()], True, self.closed(text[first.start() : last + 1]), text[last + 1 :])

    def composed(self, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        if not a.border:
            return b._replace(head=a.head + b.head)
        if not b.border:
            return a._replace(tail=a.tail + b.head)
        return ChunkMap(a.head, True, a.tokens + self.closed(a.tail + b.head) + b.tokens, b.tail)

    def count(self, text: str, size: int = 1 << 16) -> int:
        maps = [self.chunk(text[at : at + size]) for at in range(0, len(text), size)] or [ChunkMap("", False, 0, "")]
        while len(maps) > 1:
            pairs = [self.composed(a, b) for a, b in zip(maps[::2], maps[1::2])]
            maps = pairs + maps[len(pairs) * 2 :]
        whole = maps[0]
        return self.closed(whole.head) + whole.tokens + self.closed(whole.tail)


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One per Python worker and vocabulary."""
    return Counter(path)


def token_count(content: Column, vocabulary: str) -> Column:
    """bigint; null counts as empty, which has no tokens."""
    return per_text(lambda text: counter(vocabulary).count(text), "bigint", content)


def count_tokens(files: DataFrame, vocabulary: str, limit: int = 2048) -> DataFrame:
    """One row per file: file_id, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit``).

    ``files``: file_id, content; other columns are not read, repeated rows are counted alike.
    ``vocabulary`` is a BPE file of the tokenizers library with an end-of-word suffix.
    """
    counted = files.select(
        "file_id",
        F.coalesce(F.octet_length("content"), F.lit(0)).cast("bigint").alias("n_bytes"),
        token_count(F.col("content"), vocabulary).alias("n_tokens"),
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
