"""Words, prefix counts and ids of a byte-level vocabulary with word ends, as its library gives them."""

from __future__ import annotations

import re
import unicodedata
from array import array
from functools import lru_cache

import public_tokenizers

from ._bpe import Memo, byte_alphabet, read_merges

DEFAULT = "word_bpe_49k.json"
WORD_END = "</w>"
#: The added tokens, which the library finds in the raw text, and the contractions of the word pattern.
SPECIAL = ["<|startoftext|>", "<|endoftext|>"]
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"

#: Below U+0180 (but for U+0130) composing changes nothing and lower case stays below it.
_PLAIN_END = 0x180
_SPACE = "\t\n\x0b\x0c\r \x85\xa0"


def _of(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(_PLAIN_END) if unicodedata.category(chr(c))[0] == kind)


_UNUSUAL = re.compile(f"[^\\x00-{chr(_PLAIN_END - 1)}]|İ")
_WORDS = re.compile(f"[{_of('L')}]+|{CONTRACTIONS}|[{_of('N')}]|[^{re.escape(_SPACE)}{_of('L')}{_of('N')}]+")
_SPECIAL = re.compile("(" + "|".join(map(re.escape, SPECIAL)) + ")")




class WordVocabulary:
    """Exact prefix counts by dynamic programming over the prefixes of each word.

    The last token of a prefix is the one token that ends there and may stand beside
    the last token of what comes before it; the count is one more than there. A text's
    count is the sum over its words, since no token crosses from word to word.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.rank, self.merges, self.ids = read_merges(path)
        library = Tokenizer.from_file(path)
        self._normal, self._pre = library.normalizer, library.pre_tokenizer
        self._special_ids = {s: library.token_to_id(s) for s in SPECIAL}
        ok = self.merges.reachable()
        self.rank = {s: r for s, r in self.rank.items() if ok[r]}
        self._longest = max(len(s.removesuffix(WORD_END)) for s in self.rank)
        self._bytes = byte_alphabet()
        # the count of a word is that of its last prefix
        self._counts = Memo(lambda w: self.word_prefixes(self._symbols(w))[1][-1])
        self._packed = Memo(lambda w: self._pack(self._symbols(w)))
        self._apart = Memo(self._apart_words)

    def _symbols(self, word: str) -> str:
        return "".join(self._bytes[b] for b in word.encode())

    def word_prefixes(self, symbols: str) -> tuple[list[int], list[int], list[int]]:
        """For each prefix of a word (its length in symbols - 1): the last token and the count if the
        word ended there, and the last token if it went on."""
        n, rank, beside = len(symbols), self.rank, self.merges.adjacent
        inner, counts = [-1] * (n + 1), [0] * (n + 1)
        ends, end_counts = [], []
        for e in range(1, n + 1):
            for last, suffix in ((True, WORD_END), (False, "")):
                for s in range(e - 1, max(0, e - self._longest) - 1, -1):
                    token = rank.get(symbols[s:e] + suffix)
                    if token is not None and (s == 0 or beside(inner[s], token)):
                        break
                else:
                    raise ValueError(f"no token ends at {e} of {symbols!r}")
                if last:
                    ends.append(token)
                    end_counts.append(counts[s] + 1)
                else:
                    inner[e], counts[e] = token, counts[s] + 1
        return ends, end_counts, inner

    def _whole(self, symbols: str) -> list[int]:
        """The tokens of a word, by the dynamic programme over its prefixes."""
        n, rank, beside, longest = len(symbols), self.rank, self.merges.adjacent, self._longest
        inner, back = [-1] * (n + 1), [0] * (n + 1)
        for e in range(1, n):
            for s in range(e - 1, e - longest - 1 if e > longest else -1, -1):
                token = rank.get(symbols[s:e])
                if token is not None and (s == 0 or beside(inner[s], token)):
                    inner[e], back[e] = token, s
                    break
        tail = symbols + WORD_END
        for s in range(n - 1, n - longest - 1 if n > longest else -1, -1):
            token = rank.get(tail[s:])
            if token is not None and (s == 0 or beside(inner[s], token)):
                break
        else:
            raise ValueError(f"no token ends {symbols!r}")
        out = [token]
        while s:
            out.append(inner[s])
            s = back[s]
        return out[::-1]

    def _pack(self, symbols: str) -> bytes:
        return array("I", [self.ids[t] for t in self._whole(symbols)]).tobytes()

    def _unusual_words(self, text: str) -> list[str]:
        return [w for w, _ in self._pre.pre_tokenize_str(self._normal.normalize_str(text))]

    def count(self, text: str) -> int:
        if "<|" in text and _SPECIAL.search(text):
            return sum(1 if i % 2 else self.count(part) for i, part in enumerate(_SPECIAL.split(text)))
        if _UNUSUAL.search(text):
            return sum(self.word_prefixes(w)[1][-1] for w in self._unusual_words(text))
        return sum(map(self._counts.__getitem__, _WORDS.findall(text.lower())))

    def packed_ids(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if "<|" in text and _SPECIAL.search(text):
            parts = _SPECIAL.split(text)
            return b"".join(self._special_ids[p].to_bytes(4, "little") if i % 2 else self.packed_ids(p) for i, p in enumerate(parts))
        if _UNUSUAL.search(text):
            return b"".join(map(self._pack, self._unusual_words(text)))
        return b"".join(map(self._packed.__getitem__, _WORDS.findall(text.lower())))

    def _parts(self, text: str) -> list[str]:
        """``text`` (without added tokens) cut where no word and no composed character of any prefix crosses."""
        clusters = []
        for c in text:
            if clusters and unicodedata.category(c)[0] == "M":
                clusters[-1] += c
            else:
                clusters.append(c)
        out, before = [], None
        for cluster in clusters:
            if before is not None and self._apart[before, cluster[0]]:
                out.append(cluster)
            elif before is not None:
                out[-1] += cluster
            else:
                out.append(cluster)
            before = cluster
        return out

    def _apart_words(self, pair: tuple[str, str]) -> bool:
        """Whether a cluster of marks and what comes next are words apart; an apostrophe may begin a contraction."""
        a, b = pair
        words = self._unusual_words(a)
        return not self._normal.normalize_str(a).endswith("'") and self._unusual_words(a + b) == words + self._unusual_words(b)

    def _part_counts(self, part: str) -> list[int]:
        """The count of each prefix of a part, from one character on."""
        pieces = [self._normal.normalize_str(c) for c in part]
        symbols = self._symbols("".join(pieces))
        if len(part) > 1 and pieces[0][:1] != "'" and self._unusual_words(part) == [symbols]:
            by_symbol, n, out = self.word_prefixes(symbols)[1], 0, []
            for piece in pieces:
                n += len(piece.encode())
                out.append(by_symbol[n - 1])
            return out
        return [self.count(part[:i]) for i in range(1, len(part) + 1)]

    def prefix_counts(self, text: str) -> tuple[list[int], list[int]]:
        """Ends (characters) of all prefixes of ``text`` and their exact counts, in order of the ends."""
        if not (_UNUSUAL.search(text) or _SPECIAL.search(text)):
            return self._plain_prefix_counts(text)
        counts, last = [0], ""
        for k, piece in enumerate(_SPECIAL.split(text)):
            if k % 2:
                # cut inside, an added token is running text after the part before it
                start = counts[-1 - len(last)]
                whole = counts[-1] + 1
                counts += [start + self.count(last + piece[:i]) for i in range(1, len(piece))]
                counts.append(whole)
                last = ""
                continue
            for chunk in re.split(f"([{re.escape(_SPACE)}]+)", piece):
                for last in [chunk] if chunk.strip(_SPACE) == "" and chunk else self._parts(chunk):
                    done = counts[-1]
                    own = [0] * len(last) if last.strip(_SPACE) == "" else self._part_counts(last)
                    counts += [done + x for x in own]
        return list(range(len(text) + 1)), counts

    def _plain_prefix_counts(self, text: str) -> tuple[list[int], list[int]]:
        counts, done = [0] * (len(text) + 1), 0
        at = 0
        for m in _WORDS.finditer(text.lower()):
            counts[at : m.start() + 1] = [done] * (m.start() + 1 - at)
            word = m.group()
            if len(word) > 1 and word[0] == "'" and word[1].isalpha():
                own = [sum(map(self._counts.__getitem__, _WORDS.findall(word[:i]))) for i in range(1, len(word) + 1)]
            else:
                stops, n = [], 0
                for c in word:
                    n += len(c.encode())
                    stops.append(n - 1)
                by_symbol = self.word_prefixes(self._symbols(word))[1]
                own = [by_symbol[i] for i in stops]
            counts[m.start() + 1 : m.end() + 1] = [done + x for x in own]
            done, at = done + own[-1], m.end()
        counts[at:] = [done] * (len(text) + 1 - at)
        return list(range(len(text) + 1)), counts


@lru_cache(maxsize=2)
def vocabulary(path: str | None = None) -> WordVocabulary:
    return WordVocabulary(path or public_tokenizers.path(DEFAULT))
