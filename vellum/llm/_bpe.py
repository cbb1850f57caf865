"""Merge tables of a byte-pair vocabulary, and which two tokens may stand side by side.

A sequence of tokens is what merging gives for its text exactly when every two
neighbours are: no merge across their boundary would have come before the
merges that built them. That makes encoding a search over neighbours, with no
merging of whole texts.
"""

from __future__ import annotations

import base64
import json
from functools import lru_cache

#: Entries of a memo's young half; a worker's memory stays bounded.
MEMO = 400_000


class Memo(dict):
    """Keeps what ``make`` gives for short keys. When it is full, its entries become the old half,
    and what the old half then doesn't serve is forgotten."""

    def __init__(self, make):
        super().__init__()
        self._make, self._old = make, {}

    def __missing__(self, key):
        value = self._old.get(key)
        if value is None:
            value = self._make(key)
            if len(key) > 64:
                return value
        if len(self) >= MEMO:
            self._old = dict(self)
            self.clear()
        self[key] = value
        return value


def byte_alphabet() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    chars, extra = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in chars:
            chars[b] = chr(extra)
            extra += 1
    return [chars[b] for b in range(256)]


class Merges:
    """``left``/``right``: the two tokens a token is merged from (-1: none). Token numbers are merge ranks."""

    def __init__(self, n: int, triples):
        self.left, self.right, self.pair = [-1] * n, [-1] * n, {}
        for a, b, made in triples:
            self.left[made], self.right[made], self.pair[a, b] = a, b, made
        self._memo: dict[int, bool] = {}

    def adjacent(self, a: int, b: int) -> bool:
        """Whether merging the text of ``a`` then ``b`` ends in just these two tokens."""
        key = a << 20 | b
        known = self._memo.get(key)
        if known is None:
            if len(self._memo) >= MEMO:
                self._memo.clear()
            known = self._memo[key] = self._undo(a, b)
        return known

    def reachable(self) -> list[bool]:
        """For each token, whether merging its own text gives it back."""
        ok = [True] * len(self.left)
        for t, a in enumerate(self.left):
            if a >= 0:
                b = self.right[t]
                ok[t] = ok[a] and ok[b] and self._undo(a, b, t)
        return ok

    def _undo(self, a: int, b: int, limit: int | None = None) -> bool:
        # Take back the later of the two merges at the boundary, again and again. At each
        # moment the pieces that meet there must not merge before that later one came:
        # of equal ranks the left one goes first.
        limit = len(self.left) + 1 if limit is None else limit
        while True:
            made = self.pair.get((a, b))
            if made is not None and made < limit:
                return False
            whole_a, whole_b = self.left[a] < 0, self.left[b] < 0
            if whole_a and whole_b:
                return True
            if not whole_a and (whole_b or a > b):
                limit, a = a, self.right[a]
            else:
                limit, b = b + 1, self.left[b]


@lru_cache(maxsize=4)
def read_ranks(path: str) -> tuple[list[bytes], Merges]:
    """A ``.tiktoken`` file: the bytes of each token, and its merges.

    The file names no merges; those of a token are found by merging its bytes with
    the ranks below its own until two parts are left.
    """
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    words = sorted(ranks, key=ranks.__getitem__)
    assert [ranks[w] for w in words] == list(range(len(words)))

    def halves(word: bytes, own: int):
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 2:
            found = [(ranks.get(x + y, own), i) for i, (x, y) in enumerate(zip(parts, parts[1:], strict=False))]
            rank, i = min(found)
            if rank >= own:
                return None
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return ranks[parts[0]], ranks[parts[1]], own

    triples = [t for w in words if len(w) > 1 and (t := halves(w, ranks[w]))]
    return words, Merges(len(words), triples)


@lru_cache(maxsize=4)
def read_merges(path: str) -> tuple[dict[str, int], Merges, list[int]]:
    """A ``tokenizers`` JSON file with word ends: rank of each symbol, merges, and the id of each rank.

    Ranks order the symbols that are not merged first, then the merges as listed.
    """
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    made = [a + b for a, b in pairs]
    base = sorted(set(model["vocab"]) - set(made), key=model["vocab"].__getitem__)
    rank: dict[str, int] = {}
    for s in [*base, *made]:
        rank.setdefault(s, len(rank))
    merges = Merges(len(rank), [(rank[a], rank[b], rank[a + b]) for a, b in pairs])
    ids = [0] * len(rank)
    for s, r in rank.items():
        ids[r] = model["vocab"][s]
    return rank, merges, ids
