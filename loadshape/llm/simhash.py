"""SimHash near-duplicates with pigeonring filtering.

A text's fingerprint has a bit set where over half of its shingle hashes have
it. Fingerprints at most ``max_bits`` apart link; components of links are the
near-duplicate groups.

Candidate search follows the pigeonring principle: cut the 64 bits into
m = max_bits + 1 segments on a ring. If two fingerprints differ in at most
max_bits bits, some segment starts a chain whose every prefix of l segments
holds at most l * max_bits / m differences. So that first segment is equal and
the next one differs in at most one bit, hence has an equal half. Fingerprints
are therefore bucketed by (segment, its bits, half of the next segment, its
bits): exact, and 24-bit keys instead of 16-bit ones at 3 bits. Inside a bucket
the whole chain condition prunes pairs before the full Hamming check.

Equal fingerprints are one node (a group of copies is one row before anything
is shuffled by bucket), buckets above ``block_rows`` are split into pairs of
blocks dealt to different tasks, and a bucket returns one star per component,
never its pairs.

Edge cases: a null or blank text has fingerprint zero and links like any
other; a null doc_id takes part but never names a group (the id of a group of
null ids alone is null); repeated rows give repeated results; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadshape.llm.shared import bound_batches, components, packed_rows, star_edges, unpacked, whole_groups, write_shared

SHINGLE_WORDS = 3
MAX_BITS = 3
HASH_SEED = 42
BLOCK_ROWS = 1024


def fingerprint(text: str | None, shingle: int = SHINGLE_WORDS, seed: int = HASH_SEED) -> int:
    """Unsigned 64-bit SimHash of one text."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) < shingle:
        hashes = np.array([xxhash.xxh64_intdigest(line, seed)], np.uint64)
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        ends = np.cumsum(sizes)
        starts = (ends - sizes).tolist()
        parts = [line[i:j] for i, j in zip(starts, (ends[shingle - 1:] - 1).tolist())]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(seed)), np.uint64, len(parts))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        block = hashes[at: at + 65536].astype(">u8")
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes))
    return int.from_bytes(bits.tobytes(), "big")


def with_fingerprint(docs: DataFrame, shingle: int = SHINGLE_WORDS, name: str = "fp") -> DataFrame:
    """Add the fingerprint of ``text`` as a long (two's complement)."""
    bound_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def simhash(texts: pd.Series) -> pd.Series:
        prints = np.fromiter((fingerprint(t, shingle) for t in texts), np.uint64, len(texts))
        return pd.Series(prints.view(np.int64))

    return docs.withColumn(name, simhash("text"))


def segment_bounds(max_bits: int) -> list[tuple[int, int]]:
    """(shift, width) of the ring's max_bits + 1 segments."""
    m = max_bits + 1
    edges = [64 * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def viable_chain(diff: np.ndarray, max_bits: int) -> np.ndarray:
    """Pigeonring condition on XORs: some start on the ring has every prefix of
    l segments with at most l * max_bits / m differing bits."""
    m = max_bits + 1
    counts = np.stack([
        np.bitwise_count((diff >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.int64)
        for shift, width in segment_bounds(max_bits)
    ])
    found = np.zeros(len(diff), bool)
    for start in range(m):
        total = np.zeros(len(diff), np.int64)
        good = np.ones(len(diff), bool)
        for step in range(m):
            total += counts[(start + step) % m]
            good &= total * m <= (step + 1) * max_bits
        found |= good
    return found


def linked_in_groups(prints: np.ndarray, group: np.ndarray, side: np.ndarray, both: np.ndarray,
                     max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Star edges of the links inside runs of equal ``group``. A group made of
    two blocks (``both`` false) compares rows of different sides only."""
    a, b = [], []
    rows = np.arange(len(prints))
    step = 0
    while True:
        step += 1
        rows = rows[rows + step < len(prints)]
        rows = rows[group[rows] == group[rows + step]]
        if not len(rows):
            break
        left = rows[both[rows] | (side[rows] != side[rows + step])]
        diff = prints[left] ^ prints[left + step]
        keep = viable_chain(diff, max_bits)
        keep[keep] = np.bitwise_count(diff[keep]) <= max_bits
        if keep.any():
            a.append(prints[left[keep]])
            b.append(prints[left[keep] + step])
            if sum(map(len, a)) > 1_000_000:
                x, y = star_edges(np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64))
                a, b = [x.view(np.uint64)], [y.view(np.uint64)]
    if not a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return star_edges(np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64))


def bucket_keys(max_bits: int):
    """The pigeonring keys of ``fp`` as an array of longs."""
    bounds = segment_bounds(max_bits)
    keys = []
    for i, (shift, width) in enumerate(bounds):
        own = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1)) if width < 64 else F.col("fp")
        if max_bits == 0:
            keys.append(own)
            continue
        next_shift, next_width = bounds[(i + 1) % len(bounds)]
        for half, (s, w) in enumerate(((next_shift, next_width // 2),
                                       (next_shift + next_width // 2, next_width - next_width // 2))):
            part = F.shiftrightunsigned("fp", s).bitwiseAND(F.lit((1 << w) - 1))
            keys.append(F.xxhash64(F.lit(2 * i + half), own, part))
    return F.array(*keys)


def near_duplicates(prints: DataFrame, max_bits: int = MAX_BITS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(fp, root_fp) for every distinct fingerprint of ``prints`` that links
    with another one; the roots themselves are left out."""
    keyed = write_shared(
        prints.select("fp").distinct().select("fp", F.explode(bucket_keys(max_bits)).alias("bucket")), "simhash-keys")
    sizes = (
        keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        .select(F.col("bucket").alias("of"), F.ceil(F.col("n") / F.lit(block_rows)).alias("blocks"))
    )
    sizes = write_shared(sizes, "simhash-buckets")
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    parted = (
        keyed.join(sizes, keyed.bucket == sizes.of)
        .withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("bucket", F.least("mine", "other").alias("b0"), F.greatest("mine", "other").alias("b1"),
                F.col("mine").alias("side"), "fp")
    )

    def verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(frames, ["bucket", "b0", "b1"]):
            key = frame[["bucket", "b0", "b1"]].to_numpy()
            group = np.concatenate([[0], np.cumsum((key[1:] != key[:-1]).any(axis=1))])
            node, root = linked_in_groups(
                frame["fp"].to_numpy().view(np.uint64), group, frame["side"].to_numpy(),
                key[:, 1] == key[:, 2], max_bits)
            if len(node):
                yield pd.DataFrame({"a": node, "b": root})

    links = (
        parted.repartition("bucket", "b0", "b1").sortWithinPartitions("bucket", "b0", "b1")
        .mapInPandas(verify, "a long, b long")
    )
    found = components(links, "simhash")
    return found.select(F.col("node").alias("fp"), F.col("root").alias("root_fp"))


def group_members(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Per distinct fingerprint of ``prints`` (doc_id, fp): of_fp, root_fp (one
    per component) and component_id, the smallest doc_id reachable by links."""
    each = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    linked = near_duplicates(prints, max_bits)
    rooted = each.join(linked, "fp", "left").withColumn("root_fp", F.coalesce("root_fp", "fp"))
    rooted = write_shared(rooted, "simhash-roots")
    names = rooted.groupBy("root_fp").agg(F.min("least").alias("component_id"))
    return write_shared(
        rooted.join(names, "root_fp").select(F.col("fp").alias("of_fp"), "root_fp", "component_id"), "simhash-members")


def simhash_groups(docs: DataFrame, shingle: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """Every row of ``docs``: doc_id, ``fp``, ``root_fp`` and ``component_id``."""
    prints = write_shared(with_fingerprint(docs.select("doc_id", "text"), shingle).select("doc_id", "fp"), "simhash-prints")
    member = group_members(prints, max_bits)
    return prints.join(member, prints.fp == member.of_fp).drop("of_fp")


def keep_one_of_each(docs: DataFrame, shingle: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the smallest doc_id
    (nulls last); of repeated rows of that id, one. Rows are written once with
    their number and fingerprint; groups are formed from these alone, and a
    semi join takes the rows that stay."""
    rows = packed_rows(docs).withColumn("row", F.monotonically_increasing_id())
    rows = write_shared(with_fingerprint(rows, shingle).select("doc_id", "row", "fp", "data"), "simhash-rows")
    prints = rows.select("doc_id", "row", "fp")
    member = group_members(prints, max_bits)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row"))
    picked = prints.join(member, prints.fp == member.of_fp).groupBy("root_fp").agg(first.alias("pick"))
    return unpacked(rows.join(picked.select(F.col("pick.row").alias("row")), "row", "left_semi"), docs.columns)
