"""Byte-level BPE encoding and decoding by backtracking over longest matches.

Defined results: a null text is the empty text (no ids); repeated rows each give
a row; an empty table gives an empty table; extra columns are ignored, whatever their names. A text is
handled whole in one task; a piece costs time in proportion to its length; memos
are bounded.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from array import array
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._bpe import Memo, read_ranks
from ._common import documents, small_batches

DEFAULT = "byte_bpe_multi_50k.tiktoken"

_PLAIN_END = 0x200
_SPACE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def _of(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(_PLAIN_END) if unicodedata.category(chr(c))[0] == kind)


def _pattern(letters: str, numbers: str) -> str:
    other = f"[^{_SPACE}{letters}{numbers}]"
    return public_tokenizers.PATTERN.replace(r"[^\s\p{L}\p{N}]", other).replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]").replace(r"\s", f"[{_SPACE}]").replace(r"\S", f"[^{_SPACE}]")


_UNUSUAL = re.compile(f"[^\\x00-{chr(_PLAIN_END - 1)}]")
_PIECES = re.compile(_pattern(_of("L"), _of("N")))


@lru_cache(maxsize=1)
def _unusual_pieces():
    import regex

    return regex.compile(_pattern(r"\p{L}", r"\p{N}"), regex.V1)


class ByteVocabulary:
    """Encodes pieces with an automaton of all tokens and the rule of neighbours."""

    def __init__(self, path: str):
        import ahocorasick

        self.tokens, self.merges = read_ranks(path)
        self._lengths = [len(t) for t in self.tokens]
        self._automaton = ahocorasick.Automaton()
        for token, ok in enumerate(self.merges.reachable()):
            if ok:
                self._automaton.add_word(self.tokens[token].decode("latin-1"), token)
        self._automaton.make_automaton()
        self._memo = Memo(lambda piece: array("I", self.encode_piece(piece.encode())).tobytes())

    def encode_piece(self, piece: bytes) -> list[int]:
        """Take the longest match that may stand beside the token before; where none fits, step back.

        A position from which the rest can't be reached is closed for good, so each is left once at most.
        """
        n, lengths, beside = len(piece), self._lengths, self.merges.adjacent
        found: list[list[int]] = [[] for _ in range(n)]
        for end, token in self._automaton.iter(piece.decode("latin-1")):
            found[end + 1 - lengths[token]].append(token)
        open_, out, picks, at = [True] * (n + 1), [], [], 0
        k = len(found[0]) - 1 if n else -1
        while at < n:
            here = found[at]
            while k >= 0:
                token = here[k]
                if open_[at + lengths[token]] and (not out or beside(out[-1], token)):
                    break
                k -= 1
            if k >= 0:
                out.append(token)
                picks.append(k)
                at += lengths[token]
                k = len(found[at]) - 1 if at < n else -1
            else:
                open_[at] = False
                at -= lengths[out.pop()]
                k = picks.pop() - 1
        return out

    def packed_ids(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        pieces = (_unusual_pieces() if _UNUSUAL.search(text) else _PIECES).findall(text)
        return b"".join(map(self._memo.__getitem__, pieces))

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, memoryview(packed).cast("I")))


@lru_cache(maxsize=2)
def vocabulary(path: str | None = None) -> ByteVocabulary:
    return ByteVocabulary(path or public_tokenizers.path(DEFAULT))


def _mapped(df: DataFrame, column: str, kind: str, id_col: str, out: str, make) -> DataFrame:
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(column), F.lit("" if kind == "string" else b"")).alias("x"))

    def run(batches):
        for b in batches:
            yield pa.record_batch([b.column("id"), *make(b.column("x").to_pylist())], ["id", *[f.split()[0] for f in out.split(", ")]])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, {out}").withColumnRenamed("id", id_col)


def encode(docs: DataFrame, *, vocabulary_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and ``ids``, binary: little-endian unsigned 32-bit integers."""

    def make(texts):
        vocab = vocabulary(vocabulary_path)
        return [pa.array([vocab.packed_ids(t) for t in texts], pa.binary())]

    return _mapped(docs, text_col, "string", id_col, "ids binary", make)


def decode(encoded: DataFrame, *, vocabulary_path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: id and ``bytes``, what the ids of :func:`encode` stand for."""

    def make(ids):
        vocab = vocabulary(vocabulary_path)
        return [pa.array([vocab.decode(x) for x in ids], pa.binary())]

    return _mapped(encoded, ids_col, "binary", id_col, "bytes binary", make)


def encode_digests(docs: DataFrame, *, vocabulary_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, decode and digest in one pass: ``n_tokens``, ``ids_sha256``, ``decoded_sha256``. No shuffle."""

    def make(texts):
        vocab, n, ids, back = vocabulary(vocabulary_path), [], [], []
        for text in texts:
            packed = vocab.packed_ids(text)
            n.append(len(packed) // 4)
            ids.append(hashlib.sha256(packed).hexdigest())
            back.append(hashlib.sha256(vocab.decode(packed)).hexdigest())
        return [pa.array(n, pa.int64()), pa.array(ids), pa.array(back)]

    return _mapped(docs, text_col, "string", id_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", make)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return encode_digests(documents(spark, sf_dir))
