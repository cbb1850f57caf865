"""Removal of repeated passages, by merging Burrows-Wheeler transforms of shards.

A byte goes if a 50-byte string that covers it also starts in a document with a
smaller id. Strings are judged on the input; matches never cross documents.

1. Documents are bound into batches of a few MB, written once to the shared folder.
2. The least hash of the 16-byte strings in a 50-byte window is the same wherever the
   window occurs. Windows in a row with the same least hash are a run; there are about
   1/18 as many runs as bytes. Runs whose hash occurs once can't repeat and are left
   out. This takes 5 bytes and a bit for each different hash of a batch, dealt out by the
   hash: a passage that very many documents share is sent once a batch.
3. The text under the other runs is dealt out by the same hash, each different string
   once a batch with the least document id. So equal windows meet in one bucket, which
   a passage that is common adds to once for each batch, of a few MB of text, at most.
4. In a bucket, strings are put in shards. Each shard has its own transform; they are
   merged by refining their interleave one character at a time (stable distribution by
   the transforms' characters). The blocks of the interleave after p rounds are the
   suffixes with p characters in common, so the 50th gives all repeated intervals, and
   the least document id of each.
5. Each batch gets back one bit per window, and writes its documents' results.

Defined results: a null text is the empty text; texts under 50 bytes lose nothing; a
null id counts as larger than any; rows of the same id don't remove from each other;
an empty table gives an empty table; extra columns are ignored, whatever their names;
a text is handled whole, and a very long one is a batch.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import documents, materialise, release, small_batches

LENGTH = 50
KMER = 16
BATCH_BYTES = 4 << 20
#: Raw bytes of text per bucket that the number of buckets aims at.
BUCKET_BYTES = 1 << 20
SHARDS = 8
_LAST = np.iinfo(np.int64).max

_TABLE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
_FACTOR = 0x9E3779B97F4A7C15


def _runs(text: np.ndarray, ends: np.ndarray, length: int):
    """Runs of windows with the same least hash: first window, windows, hash, number of the document."""
    none = np.empty(0, dtype=np.int64)
    if len(text) < length:
        return none, none, none.astype(np.uint64), none
    h, power = _TABLE[text], _FACTOR
    size = 1
    while size < KMER:
        h = h[:-size] * np.uint64(power) + h[size:]
        power = power * power & (1 << 64) - 1
        size *= 2
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    span, width = length - KMER + 1, 1
    while width * 2 <= span:
        h = np.minimum(h[:-width], h[width:])
        width *= 2
    if width < span:
        h = np.minimum(h[: len(h) - (span - width)], h[span - width :])
    # windows that reach into the next document are none
    valid = np.ones(len(h), dtype=bool)
    for e in ends[:-1]:
        valid[max(0, e - length + 1) : e] = False
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | ~valid[:-1]
    new[ends[:-1][ends[:-1] < len(h)]] = True
    new &= valid
    first = np.flatnonzero(new)
    stop = np.flatnonzero(np.append(valid[:-1] & (new[1:] | ~valid[1:]), valid[-1])) + 1
    return first, stop - first, h[first], np.searchsorted(ends, first, side="right")


def _bind(docs: DataFrame, batch_bytes: int) -> DataFrame:
    """Rows of about ``batch_bytes``: ``batch``, ``ids`` and ``ends`` (64-bit integers), ``size``, ``text`` one after another (zstd)."""

    def bind(batches):
        part, n = TaskContext.get().partitionId() << 32, 0
        held, size = [], 0

        def row():
            ids = np.array([_LAST if i is None else i for i, _ in held], dtype=np.int64)
            null = np.array([i is None for i, _ in held], dtype=np.uint8)
            ends = np.cumsum([len(t) for _, t in held], dtype=np.int64)
            text = b"".join(t for _, t in held)
            return pa.record_batch([pa.array([part + n]), pa.array([ids.tobytes()], pa.binary()), pa.array([null.tobytes()], pa.binary()), pa.array([ends.tobytes()], pa.binary()), pa.array([len(text)]), pa.array([zstandard.compress(text)], pa.binary())], ["batch", "ids", "nulls", "ends", "size", "text"])

        for b in batches:
            for i, t in zip(b.column("id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), strict=True):
                held.append((i, t))
                size += len(t)
                if size >= batch_bytes:
                    yield row()
                    held, size, n = [], 0, n + 1
        if held:
            yield row()

    return docs.mapInArrow(bind, "batch long, ids binary, nulls binary, ends binary, size long, text binary")


class _Batch:
    """A batch with its runs in the order of their buckets."""

    def __init__(self, row: dict, buckets: int, length: int):
        self.ids, self.ends = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["ends"], np.int64)
        self.text, self.length = zstandard.decompress(row["text"]), length
        first, n, h, doc = _runs(np.frombuffer(self.text, np.uint8), self.ends, length)
        bucket = (h % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        self.first, self.n, self.hash, self.doc, self.bucket = first[order], n[order], h[order] // np.uint64(buckets), doc[order], bucket[order]
        self.at = np.searchsorted(self.bucket, np.arange(buckets + 1))

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The different hashes with their buckets, in order; which of them each run has; which come again in the batch."""
        order = np.lexsort((self.hash, self.bucket))
        h, b = self.hash[order], self.bucket[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (b[1:] != b[:-1])
        which = np.empty(len(order), dtype=np.int64)
        which[order] = np.cumsum(new) - 1
        own = np.stack([b[new].astype(np.uint64), h[new]], axis=1) if len(order) else np.empty((0, 2), np.uint64)
        return own, which, np.bincount(which, minlength=len(own)) > 1

    def repeated(self, parts: list) -> np.ndarray:
        """By run: whether its hash comes again, from the bits that the buckets sent for the different hashes."""
        own, which, _ = self.distinct()
        return _bits(parts, np.bincount(own[:, 0].astype(np.int64), minlength=len(self.at) - 1))[which]

    def strings(self, repeated: np.ndarray):
        """The runs with their bucket and, for each, the number of the first run with the same string in its bucket."""
        runs = np.flatnonzero(repeated)
        reach = self.length - 1
        known: dict = {}
        own = self.ids[self.doc[runs]].tolist()
        strings, least, which = [], [], []
        for a, n, b, i in zip(self.first[runs].tolist(), self.n[runs].tolist(), self.bucket[runs].tolist(), own, strict=True):
            key = (b, self.text[a : a + n + reach])
            k = known.setdefault(key, len(strings))
            if k == len(strings):
                strings.append(key)
                least.append(i)
            elif i < least[k]:
                least[k] = i
            which.append(k)
        return runs, np.array(which, dtype=np.int64), strings, np.array(least, dtype=np.int64)


def _bits(parts: list, n_of_bucket: np.ndarray) -> np.ndarray:
    """The bits that the buckets sent back, in the order of the buckets."""
    sent = {p["bucket"]: p["bits"] for p in parts or []}
    out = [np.unpackbits(np.frombuffer(sent[b], np.uint8), count=n).astype(bool) if b in sent else np.zeros(n, bool) for b, n in enumerate(n_of_bucket.tolist()) if n]
    return np.concatenate(out) if out else np.zeros(0, bool)


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``text`` (read in a circle) in order of what follows, to at least ``depth`` bytes.

    Eight bytes are compared at first; then what is still tied by the ranks so far, twice as far each time.
    """
    n = len(text)
    around = np.resize(text, n + 16).tobytes()
    word = np.empty(n, dtype=np.uint64)
    for a in range(min(8, n)):
        word[a::8] = np.frombuffer(around, ">u8", count=len(range(a, n, 8)), offset=a)
    order = np.argsort(word)
    key = word[order]
    new = np.ones(n + 1, dtype=bool)
    new[1:-1] = key[1:] != key[:-1]
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(new[:-1], np.arange(n), 0))
    size = 8
    while size < depth:
        t = np.flatnonzero(~(new[:-1] & new[1:]))
        if not len(t):
            break
        at = order[t]
        key = rank[at] * n + rank[(at + size) % n]
        sub = np.argsort(key)
        key, at = key[sub], at[sub]
        order[t] = at
        new[t[1:]] = key[1:] != key[:-1]
        rank[at] = t[np.maximum.accumulate(np.where(new[t], np.arange(len(t)), 0))]
        size *= 2
    return order


def merge_transforms(transforms: list[np.ndarray], depth: int, steps: list[np.ndarray] | None = None, starts: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Refine the interleave of the shards' suffixes, one character more in common a round.

    A suffix is its place in its shard's transform (shards one after another). ``steps`` gives, by shard,
    the place of the suffix one character longer (if not given, the transforms tell it); ``starts`` the places
    from which ``depth`` such steps lead to a suffix that is asked for (else all). A round takes each suffix one character longer: a stable distribution
    by the transforms' characters keeps the order of the shards and of the rounds before. Suffixes alone in
    their block are settled, and so are all that end in them; they are left out. Returns the suffixes that
    share ``depth`` characters with others, and the number of the block of each.
    """
    base = np.cumsum([0, *map(len, transforms)])
    every = np.concatenate(transforms)
    steps = steps or [np.argsort(np.argsort(t, kind="stable")) for t in transforms]
    starts = starts or [np.arange(len(t)) for t in transforms]
    step = np.concatenate([s + b for s, b in zip(steps, base, strict=False)]).astype(np.int32)
    suffix = np.concatenate([s + b for s, b in zip(starts, base, strict=False)]).astype(np.int32)
    block = np.zeros(len(suffix), dtype=np.int32)
    for _ in range(depth):
        c = every[suffix]
        order = np.argsort(c, kind="stable")
        suffix, c, block = step[suffix[order]], c[order], block[order]
        new = np.ones(len(c) + 1, dtype=bool)
        new[1:-1] = (c[1:] != c[:-1]) | (block[1:] != block[:-1])
        shared = ~(new[:-1] & new[1:])
        block = np.cumsum(new[:-1], dtype=np.int32)[shared]
        suffix = suffix[shared]
    if len(block):
        block = np.cumsum(np.append(False, block[1:] != block[:-1]), dtype=np.int32)
    return suffix, block


def _seen_before(strings: list[bytes], ids: list[np.ndarray], which: list[np.ndarray], length: int) -> list[np.ndarray]:
    """``strings``: different ones; ``ids``/``which``: per batch, the ids and numbers of its strings. Per batch,
    a bit for each window of each of its strings: whether it starts in a document with a smaller id."""
    count = np.array([len(s) for s in strings])
    starts = np.cumsum(count + 1) - count - 1
    text = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8)
    shards = min(SHARDS, len(strings))
    cuts = [*starts[(np.arange(shards) * len(strings)) // shards], len(text)]
    parts = [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    asked = np.zeros(len(text) + length, dtype=bool)  # where ``length`` characters before a window starts
    change = np.zeros(len(text) + length + 1, dtype=np.int8)
    change[starts + length], change[starts + count + 1] = 1, -1
    asked[:] = np.cumsum(change[:-1], dtype=np.int8) > 0
    arrays, transforms, steps, begin = [suffix_array(p, length) for p in parts], [], [], []
    for a, p, base in zip(arrays, parts, cuts, strict=False):
        place = np.empty(len(p), dtype=np.int32)
        place[a] = np.arange(len(p), dtype=np.int32)
        transforms.append(p[a - 1])
        steps.append(place[a - 1])
        begin.append(np.flatnonzero(asked[base : base + len(p)][a]))
    suffix, block = merge_transforms(transforms, length, steps, begin)
    at = np.full(len(text), -1, dtype=np.int32)  # block of each place in the text, -1 where it is alone
    at[np.concatenate([a + base for a, base in zip(arrays, cuts, strict=False)])[suffix]] = block

    windows = count - length + 1
    total = int(windows.sum())
    of = np.repeat(np.arange(len(strings)), windows)
    first = np.cumsum(windows) - windows
    where = at[np.arange(total) - first[of] + starts[of]]
    least_of = np.full(len(strings), _LAST)
    for i, w in zip(ids, which, strict=True):
        np.minimum.at(least_of, w, i)
    seen = least_of[of]
    shared = np.flatnonzero(where >= 0)
    least = np.full(int(block[-1]) + 1 if len(block) else 0, _LAST)
    np.minimum.at(least, where[shared], seen[shared])
    seen[shared] = least[where[shared]]
    out = []
    for i, w in zip(ids, which, strict=True):
        n = windows[w]
        place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[w], n)
        out.append(seen[place] < np.repeat(i, n))
    return out


def remove_repeats(docs: DataFrame, *, length: int = LENGTH, buckets: int | None = None, batch_bytes: int = BATCH_BYTES, with_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` (and ``kept``, binary)."""
    if length < KMER:
        raise ValueError(f"length must be {KMER} at least")
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    bound = materialise(_bind(rows, batch_bytes), "batches")
    if buckets is None:
        total = bound.agg(F.sum("size")).first()[0] or 0
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // BUCKET_BYTES + 1)

    def send_hashes(batches):
        for rb in batches:
            for row in rb.to_pylist():
                b = _Batch(row, buckets, length)
                own, _, twice = b.distinct()
                at = np.searchsorted(own[:, 0], np.arange(buckets + 1))
                packed = np.ascontiguousarray(own[:, 1]).view(np.uint8).reshape(-1, 8)[:, :5]
                some = np.flatnonzero(np.diff(at))
                yield pa.record_batch([
                    pa.array(some), pa.array([row["batch"]] * len(some), pa.int64()), pa.array([packed[at[k] : at[k + 1]].tobytes() for k in some], pa.binary()),
                    pa.array([np.packbits(twice[at[k] : at[k + 1]]).tobytes() for k in some], pa.binary()),
                ], ["bucket", "batch", "hashes", "twice"])

    def repeated(table: pa.Table) -> pa.Table:
        sent = table.column("hashes").to_pylist()
        sizes = [len(x) // 5 for x in sent]
        wide = np.zeros((sum(sizes), 8), dtype=np.uint8)
        wide[:, :5] = np.frombuffer(b"".join(sent), np.uint8).reshape(-1, 5)
        h = wide.view(np.uint64).ravel()
        s = np.sort(h)
        twice = np.unique(s[1:][s[1:] == s[:-1]])
        found = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(table.column("twice").to_pylist(), sizes, strict=True)]).astype(bool) if sizes else np.zeros(0, bool)
        if len(twice):
            found |= twice[np.minimum(np.searchsorted(twice, h), len(twice) - 1)] == h
        return pa.table({"batch": table.column("batch"), "bucket": table.column("bucket"), "bits": pa.array([np.packbits(x).tobytes() for x in np.split(found, np.cumsum(sizes)[:-1])], pa.binary())})

    def per_batch(bits: DataFrame, name: str) -> DataFrame:
        return materialise(bits.groupBy("batch").agg(F.collect_list(F.struct("bucket", "bits")).alias(name)), name)

    reply = "batch long, bucket long, bits binary"
    hashes = bound.mapInArrow(send_hashes, "bucket long, batch long, hashes binary, twice binary")
    twice = per_batch(hashes.groupBy("bucket").applyInArrow(repeated, reply), "twice")
    release(spark)

    def send_strings(batches):
        for rb in batches:
            for row in rb.to_pylist():
                b = _Batch(row, buckets, length)
                _, _, strings, least = b.strings(b.repeated(row["twice"]))
                of = np.array([k for k, _ in strings], dtype=np.int64)
                some, at = np.unique(of, return_index=True)
                at = np.append(at, len(of))
                size = np.array([len(s) for _, s in strings], dtype=np.int32)
                yield pa.record_batch([
                    pa.array(some, pa.int64()), pa.array([row["batch"]] * len(some), pa.int64()), pa.array([least[x:y].tobytes() for x, y in zip(at, at[1:], strict=False)], pa.binary()),
                    pa.array([size[x:y].tobytes() for x, y in zip(at, at[1:], strict=False)], pa.binary()), pa.array([zstandard.compress(b"".join(s for _, s in strings[x:y])) for x, y in zip(at, at[1:], strict=False)], pa.binary()),
                ], ["bucket", "batch", "ids", "sizes", "strings"])

    def seen(table: pa.Table) -> pa.Table:
        known: dict[bytes, int] = {}
        ids, which = [], []
        for i, sizes, text in zip(*(table.column(c).to_pylist() for c in ("ids", "sizes", "strings")), strict=True):
            ids.append(np.frombuffer(i, np.int64))
            text, stops = zstandard.decompress(text), np.cumsum(np.frombuffer(sizes, np.int32), dtype=np.int64).tolist()
            which.append(np.array([known.setdefault(text[x:y], len(known)) for x, y in zip([0, *stops], stops, strict=False)], dtype=np.int64))
        bits = _seen_before(list(known), ids, which, length)
        return pa.table({"batch": table.column("batch"), "bucket": table.column("bucket"), "bits": pa.array([np.packbits(x).tobytes() for x in bits], pa.binary())})

    strings = bound.join(twice, "batch").mapInArrow(send_strings, "bucket long, batch long, ids binary, sizes binary, strings binary")
    before = per_batch(strings.groupBy("bucket").applyInArrow(seen, reply), "before")
    release(spark)

    def finish(batches):
        for rb in batches:
            for row in rb.to_pylist():
                yield _results(row, _Batch(row, buckets, length), with_text)

    out = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return bound.join(twice, "batch", "left").join(before, "batch", "left").mapInArrow(finish, out).withColumnRenamed("id", id_col)


def _results(row: dict, b: _Batch, with_text: bool) -> pa.RecordBatch:
    length, text = b.length, b.text
    runs, which, strings, least = b.strings(b.repeated(row["twice"]))
    change = np.zeros(len(text) + 1, dtype=np.int32)
    if len(runs):
        windows = np.array([len(s) - length + 1 for _, s in strings], dtype=np.int64)
        n_of_bucket = np.bincount([k for k, _ in strings], weights=windows, minlength=len(b.at) - 1).astype(np.int64)
        bits = _bits(row["before"], n_of_bucket)
        start = np.cumsum(windows) - windows
        n = b.n[runs]
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        # a later document of the batch repeats the batch's first with this string
        gone = bits[np.repeat(start[which], n) + step] | np.repeat(b.ids[b.doc[runs]] > least[which], n)
        place = (np.repeat(b.first[runs], n) + step)[gone]
        np.add.at(change, place, 1)
        np.add.at(change, place + length, -1)
    removed = np.cumsum(change[:-1]) > 0
    total = np.concatenate([[0], np.cumsum(removed)])
    rises = removed.copy()
    rises[1:] &= ~removed[:-1]
    whole, columns = np.frombuffer(text, np.uint8), [[] for _ in range(6)]
    ids = [None if null else i for i, null in zip(b.ids.tolist(), row["nulls"], strict=True)]
    for i, a, e in zip(ids, [0, *b.ends[:-1].tolist()], b.ends.tolist(), strict=True):
        gone = int(total[e] - total[a])
        spans = int(rises[a:e].sum()) + int(gone and removed[a] and not rises[a])
        kept = text[a:e] if not gone else whole[a:e][~removed[a:e]].tobytes()
        for column, x in zip(columns, (i, e - a, gone, spans, hashlib.sha256(kept).hexdigest(), kept), strict=True):
            column.append(x)
    kinds, names = [pa.int64()] * 4 + [pa.string(), pa.binary()], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    used = 6 if with_text else 5
    return pa.record_batch([pa.array(x, k) for x, k in zip(columns[:used], kinds, strict=False)], names[:used])


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark, rows=1000, size=4 << 20)
    return remove_repeats(documents(spark, sf_dir))
