"""Suffix-array dedup: remove what an earlier document already holds.

A byte goes if a ``LENGTH``-byte string covering it also starts in a document
with a smaller doc_id. Matches are decided by longest-previous-factor (LPF)
lengths: in the suffix order of a shard, the nearest suffixes before and after
that come from a smaller document (previous and next smaller positions) give
the longest earlier match; strings with an LPF of ``LENGTH`` or more go, the
first document keeps its copy.

Suffixes that could match must meet in one shard, and most of the corpus
shouldn't be shuffled at all:

1. Documents are packed into blocks of ``BLOCK_BYTES``, a table bucketed by
   block that later steps read without a shuffle. Whole texts that an earlier
   document repeats are recognised by their 128-bit hash and need no search.
2. The window starting at a byte is owned by the least ``GRAM``-byte hash
   inside it, so equal windows have equal owners. Blocks send their distinct
   owner hashes to shards; shards return those that two documents share.
3. Blocks send the texts of shared owners' windows, each distinct one once
   with its smallest doc_id, to the owner's shard. The shard sorts these
   suffixes, computes LPF lengths and returns a bit per window. An owner with
   more than ``HOT_TEXTS`` distinct texts (a passage between texts that differ)
   is too much for one shard: its windows are sent singly, to shards by their
   own hash, where equal ones still meet.
4. Blocks turn bits into removal spans and digests.

Each exchange moves at most one row per (block, shard), so a group of copies of
any size weighs no more than one text per block, and equal windows no more than
one window per block.

Edge cases: null text is empty; texts shorter than ``LENGTH`` lose nothing;
rows with equal doc_ids don't remove each other; a null doc_id is neither
earlier nor later than any; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadshape.llm.shared import bound_batches, shared_path, whole_groups, write_shared

LENGTH = 50
GRAM = 16
BLOCK_BYTES = 8 << 20
SHARD_BYTES = 8 << 20
#: Text per task: the number of buckets grows with the input, so that a bucket doesn't.
BUCKET_BYTES = 32 << 20
#: Windows per piece of text sent to a shard: one bit each in a 64-bit mask.
PIECE = 32
#: Distinct texts of one owner, added up over blocks, beyond which its windows go singly.
HOT_TEXTS = 16_384

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_SHIFT = [np.uint64(x) for x in (29, 31, 30)]


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Hash of the ``gram`` bytes (a power of two) from each position."""
    h = (data.astype(np.uint64) + np.uint64(1)) * _MIX[0]
    h ^= h >> _SHIFT[0]
    size = 1
    while size < gram:
        h = h[:-size] * _MIX[1 + (size & 1)] + h[size:]
        h ^= h >> _SHIFT[2]
        size *= 2
    return h


def window_owners(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """Least gram hash of each ``length``-byte window."""
    least, span, width = gram_hashes(data, gram), 1, length - gram + 1
    while span < width:
        step = min(span, width - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    return least


def pieces(data: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, first window, windows) of runs of windows with one owner, at
    most PIECE windows each."""
    if len(data) < length:
        nothing = np.zeros(0, np.int64)
        return nothing.astype(np.uint64), nothing, nothing
    owner = window_owners(data, length)
    start = np.concatenate([[0], np.flatnonzero(owner[1:] != owner[:-1]) + 1])
    size = np.diff(np.append(start, len(owner)))
    parts = -(-size // PIECE)
    if parts.max() > 1:
        run = np.repeat(np.arange(len(start)), parts)
        nth = np.arange(len(run)) - np.repeat(np.cumsum(parts) - parts, parts)
        first = start[run] + nth * PIECE
        size = np.minimum(size[run] - nth * PIECE, PIECE)
        start = first
    return owner[start], start, size


def text_keys(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each run of bytes [start, end), of eight or more."""
    key = (end - start).astype(np.uint64)
    words = np.lib.stride_tricks.sliding_window_view(data, 8)
    for at in range(0, int((end - start).max(initial=0)), 8):
        key = key * _MIX[1] ^ words[np.minimum(start + at, end - 8)].view(np.uint64).ravel()
        key = (key ^ key >> _SHIFT[0]) * _MIX[0]
    return key


def distinct_texts(data: np.ndarray, owner: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct owners, in order, and the number of distinct texts of each."""
    found, of, times = np.unique(owner, return_inverse=True, return_counts=True)
    again = np.flatnonzero(times[of] > 1)
    of, key = of[again], text_keys(data, start[again], end[again])
    order = np.lexsort((key, of))
    of, key = of[order], key[order]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (key[1:] != key[:-1])
    texts = np.bincount(of[new], minlength=len(found))
    return found, np.maximum(texts, 1).astype(np.uint32)


def smaller_neighbour_lengths(rank: np.ndarray, lcp: np.ndarray, enough: int) -> np.ndarray:
    """For suffixes in order with document ranks, the common prefix with the
    nearest earlier suffix of strictly smaller rank (0: none, or below
    ``enough``). ``lcp[i]`` is that of i - 1 and i.

    Pointers to the suffix before jump over pointers until they meet a smaller
    rank; all that lies between is never smaller."""
    before = np.arange(len(rank)) - 1
    common = lcp.copy()
    common[:1] = 0
    open_ = np.flatnonzero(common >= enough)
    while len(open_):
        at = before[open_]
        open_ = open_[rank[at] >= rank[open_]]
        at = before[open_]
        common[open_], before[open_] = np.minimum(common[open_], common[at]), before[at]
        open_ = open_[common[open_] >= enough]
    return np.where(common >= enough, common, 0)


def earlier_factor_lengths(text: np.ndarray, starts: np.ndarray, rank: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """LPF per start: the longest prefix (up to ``length``) that also starts in
    a document of smaller rank, from previous and next smaller ranks in suffix
    order. Lengths below ``length`` are reported as 0."""
    if not len(starts):
        return np.zeros(0, np.int64)
    # rows of whole words, the last one filled up, so that neighbours are compared word by word
    wide = -(-length // 8) * 8
    rows = np.zeros((len(starts), wide), np.uint8)
    rows[:, :length] = np.lib.stride_tricks.sliding_window_view(text, length)[starts]
    order = np.argsort(rows.view(f"S{wide}").ravel(), kind="stable")
    ranked = rank[order]
    lcp = np.zeros(len(order), np.int64)
    for at in range(1, len(order), 1 << 16):  # in slices: the comparison is as large as the text
        words = rows[order[at - 1: at + (1 << 16)]].view(">u8").astype(np.uint64)
        differ = words[1:] ^ words[:-1]
        word = (differ != 0).argmax(axis=1)
        first = differ[np.arange(len(differ)), word]
        same = np.zeros(len(differ), np.int64)   # equal bytes at the start of the first word that differs
        for k in range(1, 8):
            same += first < (np.uint64(1) << np.uint64(8 * k))
        lcp[at: at + len(differ)] = np.where(first == 0, length, np.minimum(8 * word + same, length))
    del rows
    back = smaller_neighbour_lengths(ranked, lcp, length)
    ahead = smaller_neighbour_lengths(ranked[::-1], np.concatenate([[0], lcp[:0:-1]]), length)[::-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.maximum(back, ahead)
    return out


# ---- blocks ---------------------------------------------------------------

def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length(F.col("text").cast("binary")).cast("long"))).first()[0] or 0


def tasks_for(spark: SparkSession, total: int, bucket_bytes: int = BUCKET_BYTES) -> int:
    """Buckets, and shuffle partitions, for ``total`` bytes of text: never
    fewer than the session's, never more than Spark allows a table."""
    most = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))
    return min(most, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // bucket_bytes)))


def pack_blocks(docs: DataFrame, block_bytes: int, buckets: int) -> DataFrame:
    """Bucketed table of blocks (block, doc_ids, sizes, keys, data). A block's
    id is unique per task and position."""
    spark = docs.sparkSession
    source = docs.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("data"),
                         F.spark_partition_id().alias("part"))

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, texts, held, made = [], [], 0, 0

        def block(part):
            return pd.DataFrame({
                "block": [(int(part) << 32) + made], "doc_ids": [list(ids)], "sizes": [[len(t) for t in texts]],
                "keys": [[xxhash.xxh3_128_digest(t) for t in texts]], "data": [b"".join(texts)]})

        part = 0
        for frame in frames:
            for doc, text, part in zip(frame["doc_id"].astype("Int64"), frame["data"], frame["part"]):
                ids.append(None if doc is pd.NA else int(doc))
                texts.append(bytes(text))
                held += len(text) + 64
                if held >= block_bytes:
                    yield block(part)
                    ids, texts, held, made = [], [], 0, made + 1
        if ids:
            yield block(part)

    name = f"blocks_{uuid.uuid4().hex}"
    (source.mapInPandas(pack, "block long, doc_ids array<long>, sizes array<int>, keys array<binary>, data binary")
     .write.bucketBy(buckets, "block").option("path", shared_path(spark, "blocks")).option("compression", "zstd")
     .saveAsTable(name))
    table = spark.table(name)
    table.schema  # resolved: the files stay, the catalog's entry needn't
    spark.sql(f"DROP TABLE {name}")
    return table


def repeated_texts(blocks: DataFrame) -> DataFrame:
    """(block, skip): numbers of documents whose whole text is in a document
    with a smaller doc_id."""
    each = write_shared(
        blocks.select("block", F.posexplode(F.arrays_zip("doc_ids", "keys")).alias("nth", "d"))
        .where("d.doc_ids is not null").select("block", "nth", F.col("d.doc_ids").alias("doc_id"), F.col("d.keys").alias("text_key")),
        "copies-texts")
    first = write_shared(
        each.groupBy("text_key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
        .where("first < last").select(F.col("text_key").alias("of_key"), "first"), "copies-first")
    later = each.join(first, each.text_key == first.of_key).where("doc_id > first")
    return later.groupBy("block").agg(F.sort_array(F.collect_list("nth")).alias("skip"))


def same_texts(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of each run's text among the distinct ones, and the first run of
    each: by hash, then byte for byte against the first run."""
    _, first, text = np.unique(text_keys(data, start, end), return_index=True, return_inverse=True)
    words, a, b = np.lib.stride_tricks.sliding_window_view(data, 8), start, start[first][text]
    size = end - start
    same = size == (end - start)[first][text]
    for at in range(0, int(size.max(initial=0)), 8):
        to = np.minimum(at, size - 8)
        same &= (words[a + to].view(np.uint64) == words[np.minimum(b + to, len(data) - 8)].view(np.uint64)).ravel()
    if same.all():
        return text, first
    number: dict[bytes, int] = {}   # two texts with one hash
    text = np.array([number.setdefault(data[x:y].tobytes(), len(number)) for x, y in zip(start.tolist(), end.tolist())])
    return text, np.unique(text, return_index=True)[1]


@dataclass
class Pieces:
    """Distinct texts (owner, place, bytes, least doc_id) and all occurrences
    (number of the text, document, first window, windows)."""

    owner: np.ndarray
    at: np.ndarray
    length: np.ndarray
    least: np.ndarray
    text: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    windows: np.ndarray


def joined_bytes(data: np.ndarray, at: np.ndarray, length: np.ndarray, rows: int = 1 << 16) -> np.ndarray:
    """The bytes of runs, one behind the other, gathered ``rows`` runs at a time."""
    widest = int(length.max(initial=0))
    padded = np.concatenate([data, np.zeros(widest, np.uint8)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, max(widest, 1))
    inside = np.arange(widest)
    return np.concatenate([np.zeros(0, np.uint8), *[
        windows[at[k: k + rows]][inside < length[k: k + rows, None]] for k in range(0, len(at), rows)]])


class Block:
    """A block's documents, and the pieces of those that need a search."""

    def __init__(self, row):
        sizes = np.asarray(row.sizes, np.int64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.data = np.frombuffer(row.data, np.uint8)
        self.raw = row.data
        self.ids = [None if d is None or d != d else int(d) for d in row.doc_ids]
        self.skip = set() if row.skip is None else {int(i) for i in row.skip}

    def searched(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        for i, doc in enumerate(self.ids):
            if doc is not None and i not in self.skip:
                owner, start, size = pieces(self.data[self.starts[i]: self.ends[i]])
                if len(owner):
                    yield i, owner, start, size

    def shared_pieces(self, shared: np.ndarray, hot: np.ndarray, length: int = LENGTH) -> Pieces:
        """The pieces with a shared owner, and the single windows of those with
        a hot one, by distinct text in order of its key."""
        owners, starts, sizes, docs = [], [], [], []
        for i, owner, start, size in self.searched():
            if not len(shared):
                break
            hit = shared[np.minimum(np.searchsorted(shared, owner), len(shared) - 1)] == owner
            owner, start, size = owner[hit], self.starts[i] + start[hit], size[hit]
            if len(hot) and len(owner):
                single = hot[np.minimum(np.searchsorted(hot, owner), len(hot) - 1)] == owner
                many = size[single]
                nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                first = np.repeat(start[single], many) + nth
                own = text_keys(self.data, first, first + length)
                owner, start = np.concatenate([owner[~single], own]), np.concatenate([start[~single], first])
                size = np.concatenate([size[~single], np.ones(len(first), np.int64)])
            if len(owner):
                owners.append(owner)
                starts.append(start)
                sizes.append(size)
                docs.append(np.full(len(owner), i))
        if not owners:
            nothing = np.zeros(0, np.int64)
            return Pieces(nothing.astype(np.uint64), nothing, nothing, nothing, nothing, nothing, nothing, nothing)
        owner, start, size, doc = map(np.concatenate, (owners, starts, sizes, docs))
        text, first = same_texts(self.data, start, start + size + length - 1)
        ids = np.array([d if d is not None else 0 for d in self.ids], np.int64)
        least = np.full(len(first), np.iinfo(np.int64).max)
        np.minimum.at(least, text, ids[doc])
        return Pieces(owner[first], start[first], size[first] + length - 1, least, text, doc, start, size)


def packed(values: np.ndarray) -> bytes:
    return zstandard.compress(values.tobytes(), 3)


def unpacked(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), kind)


def merged_lists(blobs, kind) -> np.ndarray:
    if blobs is None or not len(blobs):
        return np.zeros(0, kind)
    return np.concatenate([unpacked(bytes(b), kind) for b in blobs])


def by_shard(owner: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """The shards that owners fall in, with the places of theirs."""
    shard = (owner % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    cuts = np.flatnonzero(np.diff(shard[order])) + 1
    for at in np.split(order, cuts):
        if len(at):
            yield int(shard[at[0]]), at


def shared_owners(blocks: DataFrame, shards: int, tasks: int, hot_texts: int = HOT_TEXTS) -> DataFrame:
    """(block, owners, hot): packed owner hashes of the block that two documents
    of the corpus share, and those of them with more than ``hot_texts`` texts."""

    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                own = Block(row)
                hashes, docs, owners, starts, ends = [], [], [], [], []
                for i, owner, start, size in own.searched():
                    owners.append(owner)
                    starts.append(own.starts[i] + start)
                    ends.append(starts[-1] + size + LENGTH - 1)
                    owner = np.unique(owner)
                    hashes.append(owner)
                    docs.append(np.full(len(owner), own.ids[i]))
                if not hashes:
                    continue
                _, texts = distinct_texts(own.data, *map(np.concatenate, (owners, starts, ends)))
                del owners, starts, ends
                h, d = np.concatenate(hashes), np.concatenate(docs)
                order = np.lexsort((d, h))
                h, d = h[order], d[order]
                new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
                several = np.maximum.reduceat(d, new) != d[new]
                h = h[new]
                rows = [(s, row.block, h[at].tobytes(), np.packbits(several[at]).tobytes(), packed(texts[at]))
                        for s, at in by_shard(h, shards)]
                yield pd.DataFrame(rows, columns=["shard", "block", "hashes", "several", "texts"])

    def match(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(frames, ["shard"]):
            for _, part in frame.groupby("shard"):
                lists = [np.frombuffer(x, np.uint64) for x in part["hashes"]]
                sizes = [len(x) for x in lists]
                several = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n)
                                          for x, n in zip(part["several"], sizes)]).astype(bool)
                _, at, times = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
                shared = times > 1
                shared[at[several]] = True
                texts = np.bincount(at, weights=np.concatenate([unpacked(x, np.uint32) for x in part["texts"]]))
                hot = shared & (texts > hot_texts)
                cuts = np.cumsum(sizes)[:-1]
                for block, own, keep, many in zip(part["block"], lists, np.split(shared[at], cuts), np.split(hot[at], cuts)):
                    if keep.any():
                        yield pd.DataFrame({"block": [block], "owners": [packed(own[keep])],
                                            "hot": [packed(own[many]) if many.any() else None]})

    sent = blocks.mapInPandas(send, "shard int, block long, hashes binary, several binary, texts binary")
    back = (sent.repartition(tasks, "shard").sortWithinPartitions("shard")
            .mapInPandas(match, "block long, owners binary, hot binary"))
    return write_shared(back, "copies-owners").groupBy("block").agg(
        F.collect_list("owners").alias("owners"), F.collect_list("hot").alias("hot"))


def sent_texts(blocks: DataFrame, shards: int) -> DataFrame:
    """Per (block, shard) the texts to search there: packed text numbers,
    least doc_ids, sizes and bytes. With shard -1, once per block, what the
    last step needs of its pieces: the occurrences, and the texts' least ids.
    Written, so that pieces are formed once."""

    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                own = Block(row)
                found = own.shared_pieces(np.sort(merged_lists(row.owners, np.uint64)), np.sort(merged_lists(row.hot, np.uint64)))
                if not len(found.owner):
                    continue
                rows = []
                for shard, at in by_shard(found.owner, shards):
                    text = joined_bytes(own.data, found.at[at], found.length[at])
                    rows.append((shard, row.block, packed(at.astype(np.int32)), packed(found.least[at]),
                                 packed(found.length[at].astype(np.int32)), packed(text)))
                each = np.stack([found.text, found.doc, found.start, found.windows]).astype(np.int32)
                rows.append((-1, row.block, None, packed(found.least), None, packed(each)))
                yield pd.DataFrame(rows, columns=["shard", "block", "nth", "docs", "sizes", "texts"])

    return write_shared(blocks.mapInPandas(
        send, "shard int, block long, nth binary, docs binary, sizes binary, texts binary"), "copies-pieces")


def earlier_windows(sent: DataFrame, tasks: int) -> DataFrame:
    """(block, marks): packed (text number, window mask) pairs of the windows
    that another block's smaller document holds."""

    def order(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(frames, ["shard"]):
            for _, part in frame.groupby("shard"):
                nth = [unpacked(x, np.int32) for x in part["nth"]]
                docs = np.concatenate([unpacked(x, np.int64) for x in part["docs"]])
                sizes = np.concatenate([unpacked(x, np.int32) for x in part["sizes"]]).astype(np.int64)
                text = np.frombuffer(b"".join([zstandard.decompress(x) for x in part["texts"]]), np.uint8)
                windows = sizes - (LENGTH - 1)
                piece = np.repeat(np.arange(len(sizes)), windows)
                inside = np.arange(len(piece)) - np.repeat(np.cumsum(windows) - windows, windows)
                starts = np.repeat(np.cumsum(sizes) - sizes, windows) + inside
                earlier = earlier_factor_lengths(text, starts, docs[piece]) >= LENGTH
                masks = np.zeros(len(sizes), np.uint64)
                np.bitwise_or.at(masks, piece[earlier], np.uint64(1) << inside[earlier].astype(np.uint64))
                cuts = np.cumsum([len(x) for x in nth])[:-1]
                for block, n, m in zip(part["block"], nth, np.split(masks, cuts)):
                    if m.any():
                        pairs = np.stack([n[m > 0].astype(np.uint64), m[m > 0]], axis=1)
                        yield pd.DataFrame({"block": [block], "marks": [packed(pairs)]})

    back = (sent.where("shard >= 0").repartition(tasks, "shard").sortWithinPartitions("shard")
            .mapInPandas(order, "block long, marks binary"))
    return write_shared(back, "copies-marks").groupBy("block").agg(F.collect_list("marks").alias("marks"))


def spans_of(covered: np.ndarray) -> np.ndarray:
    edge = np.diff(np.concatenate([[0], covered.astype(np.int8), [0]]))
    return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], axis=1)


def earlier_copies(docs: DataFrame, block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES, *,
                   hot_texts: int = HOT_TEXTS) -> DataFrame:
    """Per row of ``docs``: doc_id, data (the UTF-8 bytes) and spans, the
    maximal removed byte runs as [start, end) pairs."""
    spark = docs.sparkSession
    bound_batches(spark)
    total = text_bytes(docs)
    tasks = tasks_for(spark, total)
    blocks = pack_blocks(docs, block_bytes, tasks)
    shards = max(tasks, -(-total // shard_bytes))
    skipping = blocks.join(repeated_texts(blocks), "block", "left")
    owners = shared_owners(skipping, shards, tasks, hot_texts)
    searching = skipping.join(owners, "block", "left")
    sent = sent_texts(searching, shards)
    marks = earlier_windows(sent, tasks)
    placed = sent.where("shard < 0").select("block", F.col("docs").alias("least"), F.col("texts").alias("each"))

    def finish(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                own = Block(row)
                edges = np.zeros(len(own.data) + 1, np.int32)
                if row.each is not None:
                    k, i, start, n = unpacked(row.each, np.int32).reshape(4, -1).astype(np.int64)
                    least = unpacked(row.least, np.int64)
                    mask = np.zeros(len(least), np.uint64)
                    pairs = merged_lists(row.marks, np.uint64).reshape(-1, 2)
                    mask[pairs[:, 0].astype(np.int64)] = pairs[:, 1]
                    ids = np.array([d if d is not None else 0 for d in own.ids], np.int64)
                    bits = np.where(ids[i] > least[k], ~np.uint64(0), mask[k])
                    some = np.flatnonzero(bits)
                    bits, start, n = bits[some], start[some], n[some]
                    for step in range(PIECE):
                        on = ((bits >> np.uint64(step)) & np.uint64(1)).astype(bool) & (step < n)
                        at = start[on] + step
                        edges[at] += 1   # a window occurs once
                        edges[at + LENGTH] -= 1
                for i in own.skip:
                    if own.ends[i] - own.starts[i] >= LENGTH:
                        edges[own.starts[i]] += 1
                        edges[own.ends[i]] -= 1
                covered = np.cumsum(edges[:-1]) > 0
                rows = []
                for i, (a, b) in enumerate(zip(own.starts.tolist(), own.ends.tolist())):
                    rows.append((own.ids[i], own.raw[a:b], spans_of(covered[a:b]).tolist()))
                for at in range(0, len(rows), 512):
                    out = pd.DataFrame(rows[at: at + 512], columns=["doc_id", "data", "spans"])
                    yield out.astype({"doc_id": "Int64"})

    return skipping.join(placed, "block", "left").join(marks, "block", "left").mapInPandas(
        finish, "doc_id long, data binary, spans array<array<long>>")


def copy_report(docs: DataFrame) -> DataFrame:
    """Per document: byte counts, removed runs and the digest of the rest."""

    @F.pandas_udf("string")
    def kept(data: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for raw, cuts in zip(data, spans):
            digest, upto = hashlib.sha256(), 0
            for a, b in cuts:
                digest.update(raw[upto:int(a)])
                upto = int(b)
            digest.update(raw[upto:])
            out.append(digest.hexdigest())
        return pd.Series(out, dtype=object)

    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s[1] - s[0])
    return earlier_copies(docs).select(
        "doc_id", F.length("data").cast("long").alias("n_bytes"), removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), kept("data", "spans").alias("kept_sha256"))
