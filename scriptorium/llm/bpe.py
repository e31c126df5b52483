"""Byte-level BPE under a public tokenizer's vocabulary file.

A piece is merged with a priority queue of merge ranks over a doubly linked list of symbols; queue entries that no longer
describe two living neighbours are skipped when they surface. Decoding concatenates the vocabulary's byte strings.
The vocabulary (about 50,000 entries, roughly 1 MB) has a size fixed by its file, so it is broadcast.
"""

from __future__ import annotations

import base64
import heapq
import os
from array import array

import regex

#: The pre-splitting pattern that belongs to the vocabulary, and the folder of the vocabulary files.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
TOKENIZERS = "/opt/tokenizers"

#: Distinct pieces kept per Python worker; the memo is emptied when full, which changes speed only.
MEMO = 400_000


def load_ranks(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> dict[bytes, int]:
    """The vocabulary ``<folder>/<name>.tiktoken`` as byte string -> rank, which is also the token id."""
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as lines:
        return {base64.b64decode(word): int(rank) for word, rank in (line.split() for line in lines if line.strip())}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one pre-split piece."""
    symbols: list[bytes | None] = [piece[i : i + 1] for i in range(len(piece))]
    n = len(symbols)
    if n == 1:
        return [ranks[piece]]
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    queue = [(rank, i) for i in range(n - 1) if (rank := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(queue)
    while queue:
        rank, left = heapq.heappop(queue)
        right = after[left]
        if symbols[left] is None or right >= n or ranks.get(joined := symbols[left] + symbols[right]) != rank:
            continue  # stale: one side was merged away since the entry was queued
        symbols[left], symbols[right] = joined, None
        after[left] = right = after[right]
        if right < n:
            before[right] = left
            if (next_rank := ranks.get(joined + symbols[right])) is not None:
                heapq.heappush(queue, (next_rank, left))
        if (previous := before[left]) >= 0 and (next_rank := ranks.get(symbols[previous] + joined)) is not None:
            heapq.heappush(queue, (next_rank, previous))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[symbols[i]])
        i = after[i]
    return ids


class Encoder:
    """Encodes texts piece by piece and remembers each distinct piece's ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = SPLIT, memo: int = MEMO):
        self.ranks, self.memo_size = ranks, memo
        self.split = regex.compile(pattern).findall
        self.memo: dict[str, array] = {}

    def piece(self, text: str) -> array:
        ids = self.memo.get(text)
        if ids is None:
            if len(self.memo) >= self.memo_size:
                self.memo.clear()
            ids = array("i", merge_piece(text.encode("utf-8"), self.ranks))
            if len(text) <= 256:
                self.memo[text] = ids
        return ids

    def encode(self, text: str | None) -> array:
        """Ids without special tokens; null and empty texts both give an empty array."""
        out = array("i")
        if text:
            memo, piece, extend = self.memo, self.piece, out.extend
            for p in self.split(text):
                extend(memo.get(p) or piece(p))
        return out


class Decoder:
    """Token ids back to text by concatenating vocabulary strings."""

    def __init__(self, ranks: dict[bytes, int]):
        self.words = [b""] * (max(ranks.values()) + 1)
        for word, rank in ranks.items():
            self.words[rank] = word

    def decode(self, ids) -> str:
        return b"".join([self.words[i] for i in ids]).decode("utf-8", errors="replace")
