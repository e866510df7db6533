"""Benchmark decontamination with one FM-index per training shard.

Words are maximal runs of 0-9, a-z (A-Z lower-cased) and characters above
U+007F. A window is ``window`` consecutive words of a benchmark item (the whole
item if it is shorter). Every task cuts its documents into shards of bounded
size and builds an FM-index over each: the words of the benchmark vocabulary
are the symbols, every other word ends a run (no window can cross it), and runs
shorter than the shortest window hold none. All windows are searched backwards
at once through the ranks of a wavelet matrix over the Burrows-Wheeler
transform, located by LF steps to sampled suffix positions, and the located
spans of a document are merged into removal spans.

The benchmark is read by the driver in blocks of at most ``block_words`` words
(a fixed bound); the documents pass once per block, without any shuffle.

Edge cases: a null or empty text has no words and is clean; null or empty
benchmark items have no window; items with equal texts or ids each count by
their item_id once (null item_ids never); repeated documents give repeated
rows; an empty benchmark leaves every document clean; other columns pass.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadshape.llm.shared import bound_batches, packed_rows, unpacked

WINDOW_WORDS = 13
SHARD_WORDS = 2_000_000
BLOCK_WORDS = 2_000_000
SAMPLE_STEP = 8
#: A document is contaminated if at least one of this many words is hit.
SHARE_DENOMINATOR = 20

#: Byte table: A-Z to a-z, bytes of words as they are (0-9, a-z, all of a
#: multi-byte character), the rest to a space.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 32
              for b in range(256))


def words_of(text: str | bytes | None) -> list[bytes]:
    """The words of a text, as UTF-8."""
    data = text.encode() if isinstance(text, str) else text or b""
    return data.translate(_FOLD).split()


class Windows:
    """The distinct windows of a block of items, over a word vocabulary."""

    def __init__(self, items: list[tuple[int | None, str | None]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[int]] = {}
        for item, text in items:
            codes = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            if item is None or not codes:
                continue
            size = min(window, len(codes))
            for i in range(len(codes) - size + 1):
                found.setdefault(tuple(codes[i: i + size]), set()).add(item)
        self.patterns = list(found)
        self.items = [np.array(sorted(found[p]), np.int64) for p in self.patterns]
        self.lengths = np.array([len(p) for p in self.patterns], np.int64)
        self.shortest = int(self.lengths.min()) if self.patterns else 0


class WaveletMatrix:
    """Rank of any symbol in a sequence, by one bit plane per symbol bit."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits = bits
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        for level in range(bits - 1, -1, -1):
            plane = ((symbols >> level) & 1).astype(bool)
            self.ones.append(np.concatenate([[0], np.cumsum(plane, dtype=np.int32)]))
            self.zeros.append(int(len(symbols) - self.ones[-1][-1]))
            symbols = np.concatenate([symbols[~plane], symbols[plane]])

    def _steps(self):
        return zip(range(self.bits - 1, -1, -1), self.ones, self.zeros)

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often symbol occurs before position end (vectors of queries)."""
        low, high = np.zeros_like(end), end.copy()
        for level, ones, zeros in self._steps():
            bit = ((symbol >> level) & 1).astype(bool)
            low = np.where(bit, zeros + ones[low], low - ones[low])
            high = np.where(bit, zeros + ones[high], high - ones[high])
        return high - low

    def access(self, at: np.ndarray) -> np.ndarray:
        symbol = np.zeros_like(at)
        for level, ones, zeros in self._steps():
            bit = ones[at + 1] - ones[at]
            symbol |= bit.astype(at.dtype) << level
            at = np.where(bit == 1, zeros + ones[at], at - ones[at])
        return symbol


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; symbols end with a unique 0."""
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        ahead = np.zeros(len(rank), np.int64)
        ahead[: len(rank) - step] = rank[step:] + 1
        key = rank * (len(rank) + 1) + ahead
        order = np.argsort(key, kind="stable")
        fresh = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        rank = np.empty_like(rank)
        rank[order] = fresh
        if fresh[-1] == len(rank) - 1:
            return order
        step *= 2


class FMIndex:
    """Backward search and location over a word-code sequence. Runs are
    separated by code 0 in ``runs``; the separators get distinct ranks, so no
    pattern crosses one and suffix sorting stops at it."""

    def __init__(self, codes: np.ndarray, step: int = SAMPLE_STEP):
        ends = codes == 0
        self.shift = int(ends.sum())
        symbols = codes.astype(np.int64) + self.shift
        symbols[ends] = np.arange(self.shift, 0, -1) - 1  # the last separator is the least
        self.size = len(symbols)
        order = suffix_array(symbols)
        last = codes[order - 1].astype(np.int64)  # separators collapse to 0: they are never searched
        self.top = int(codes.max()) + 1
        self.first = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=self.top))])
        self.ranks = WaveletMatrix(last, max(1, (self.top - 1).bit_length()))
        self.sampled = order % step == 0
        # a run's first word has a separator before it, where LF cannot go: sample it too
        self.sampled |= last == 0
        self.sample_rank = np.concatenate([[0], np.cumsum(self.sampled)])
        self.samples = order[self.sampled]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix interval [low, high) per pattern (rows padded on the left)."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.size, np.int64)
        width = patterns.shape[1]
        for back in range(width):
            symbol = patterns[:, width - 1 - back]
            live = np.flatnonzero((back < lengths) & (low < high))
            if not len(live):
                break
            known = symbol[live] < self.top
            high[live[~known]] = low[live[~known]]
            live = live[known]
            c = symbol[live]
            low[live] = self.first[c] + self.ranks.rank(c, low[live])
            high[live] = self.first[c] + self.ranks.rank(c, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows, by LF steps to a sampled one."""
        rows, out = rows.copy(), np.empty_like(rows)
        open_, moved = np.arange(len(rows)), 0
        while len(open_):
            done = self.sampled[rows[open_]]
            at = open_[done]
            out[at] = self.samples[self.sample_rank[rows[at]]] + moved
            open_ = open_[~done]
            c = self.ranks.access(rows[open_])
            rows[open_] = self.first[c] + self.ranks.rank(c, rows[open_])
            moved += 1
        return out


def kept_runs(codes: np.ndarray, shortest: int) -> np.ndarray:
    """Mask of the positions in runs of at least ``shortest`` known words."""
    known = np.concatenate([[0], (codes > 0).astype(np.int8), [0]])
    edge = np.diff(known)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long_ = end - start >= shortest
    mark = np.zeros(len(codes) + 1, np.int32)
    mark[start[long_]] += 1
    mark[end[long_]] -= 1
    return np.cumsum(mark[:-1]) > 0


def shard_hits(texts: list[np.ndarray], windows: Windows) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each document's word codes: the merged hit spans [n, 2] in words and
    the sorted item ids."""
    nothing = (np.zeros((0, 2), np.int64), np.zeros(0, np.int64))
    out = [nothing] * len(texts)
    if not windows.patterns:
        return out
    pieces, where, owner = [], [], []
    for i, codes in enumerate(texts):
        at = np.flatnonzero(kept_runs(codes, windows.shortest))
        if not len(at):
            continue
        gap = np.flatnonzero(np.diff(at) > 1) + 1  # separators between runs and after the document
        pieces.append(np.append(np.insert(codes[at], gap, 0), 0))
        where.append(np.append(np.insert(at, gap, -1), -1))
        owner.append(np.full(len(pieces[-1]), i))
    if not pieces:
        return out
    codes, where, owner = np.concatenate(pieces), np.concatenate(where), np.concatenate(owner)
    index = FMIndex(codes)
    width = int(windows.lengths.max())
    table = np.zeros((len(windows.patterns), width), np.int64)
    for row, p in zip(table, windows.patterns):
        row[width - len(p):] = p
    low, high = index.search(table, windows.lengths)
    found = np.flatnonzero(high > low)
    counts = (high - low)[found]
    pattern = np.repeat(found, counts)
    rows = np.repeat(low[found] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
    position = index.locate(rows)
    doc, start = owner[position], where[position]
    end = start + windows.lengths[pattern]
    by_doc = np.lexsort((end, start, doc))
    doc, start, end, pattern = doc[by_doc], start[by_doc], end[by_doc], pattern[by_doc]
    cuts = np.flatnonzero(np.diff(doc)) + 1
    for s, e, p, d in zip(*(np.split(x, cuts) for x in (start, end, pattern, doc))):
        if not len(d):
            continue
        reach = np.maximum.accumulate(e)
        new = np.concatenate([[True], s[1:] > reach[:-1]])
        spans = np.stack([s[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(s) - 1)]], axis=1)
        out[d[0]] = (spans, np.unique(np.concatenate([windows.items[x] for x in np.unique(p)])))
    return out


def merged(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([int(a), int(b)])
    return out


def _benchmark_blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[int | None, str | None]]]:
    """The benchmark in blocks of at most about ``block_words`` words, each
    small enough for the driver and every task; one block is held at a time."""
    block, words = [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        n = len(row.text or "") // 2 + 1
        if words and words + n > block_words:
            yield block
            block, words = [], 0
        block.append((row.item_id, row.text))
        words += n
    yield block


HIT_TYPE = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
    T.StructField("items", T.ArrayType(T.LongType())),
])


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW_WORDS,
                       shard_words: int = SHARD_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with ``hit``: n_words, the merged removal spans in words
    ([start, end) pairs) and the ids of the items with a window in the text."""
    spark = docs.sparkSession
    bound_batches(spark)
    out = docs.withColumn("hit", F.struct(
        F.lit(0).cast("long").alias("n_words"), F.array().cast(HIT_TYPE["spans"].dataType).alias("spans"),
        F.array().cast("array<long>").alias("items")))
    for items in _benchmark_blocks(benchmark, block_words):
        windows = spark.sparkContext.broadcast(Windows(items, window))  # at most block_words words
        out = out.withColumn("hit", block_search(windows, shard_words)(F.col("text").cast("binary"), F.col("hit")))
    return out


def block_search(windows, shard_words: int):
    """Pandas UDF (text, hits so far) -> hits with those of one benchmark block."""

    @F.pandas_udf(HIT_TYPE)
    def search(batches: Iterator[tuple[pd.Series, pd.DataFrame]]) -> Iterator[pd.DataFrame]:
        for texts, before in batches:
            sizes, found = batch_hits(texts, windows.value, shard_words)
            spans, items = [s.tolist() for s, _ in found], [i.tolist() for _, i in found]
            for k, (s, i) in enumerate(zip(before["spans"], before["items"])):
                if len(s):
                    spans[k] = merged([*spans[k], *[list(x) for x in s]])
                if len(i):
                    items[k] = sorted({*items[k], *map(int, i)})
            yield pd.DataFrame({"n_words": sizes, "spans": spans, "items": items})

    return search


def batch_hits(texts, windows: Windows, shard_words: int) -> tuple[list[int], list[tuple[np.ndarray, np.ndarray]]]:
    """Word counts and hits of a batch of texts, cut into shards of about
    ``shard_words`` words; a shard has at least one whole document."""
    sizes, found, shard, held = [], [], [], 0
    for text in texts:
        words = words_of(text)
        sizes.append(len(words))
        shard.append(np.fromiter(map(windows.vocabulary.get, words, repeat(0)), np.int64, len(words)))
        held += len(words)
        if held >= shard_words:
            found += shard_hits(shard, windows)
            shard, held = [], 0
    return sizes, found + shard_hits(shard, windows)


def contamination_report(hits: DataFrame) -> DataFrame:
    """Per document: word counts, items digest and the contamination verdict."""
    n_hit = F.aggregate("hit.spans", F.lit(0).cast("long"), lambda acc, s: acc + s[1] - s[0])
    names = F.array_join(F.array_sort(F.transform("hit.items", lambda i: i.cast("string"))), ",")
    out = hits.select(
        "doc_id", F.col("hit.n_words").alias("n_words"), n_hit.alias("n_hit"),
        F.size("hit.items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (SHARE_DENOMINATOR * F.col("n_hit") >= F.col("n_words")))


def cut_words(text: str, spans: list[list[int]]) -> str:
    """``text`` without the words of ``spans`` (word numbers) and what stands
    between them."""
    data = text.encode()
    at = [m.span() for m in re.finditer(b"[^ ]+", data.translate(_FOLD))]
    out, upto = [], 0
    for a, b in spans:
        out.append(data[upto: at[a][0]])
        upto = at[b - 1][1]
    return b"".join([*out, data[upto:]]).decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW_WORDS) -> DataFrame:
    """Drop contaminated documents; cut the removal spans out of the rest."""
    hits = find_contamination(packed_rows(docs), benchmark, window)
    n_hit = F.aggregate("hit.spans", F.lit(0).cast("long"), lambda acc, s: acc + s[1] - s[0])
    clean = hits.where(~((n_hit > 0) & (SHARE_DENOMINATOR * n_hit >= F.col("hit.n_words"))))

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or s is None or not len(s) else cut_words(t, [list(map(int, x)) for x in s])
                          for t, s in zip(texts, spans)], dtype=object)

    hit = F.size("hit.spans") > 0
    text = F.when(hit, cut("text", "hit.spans")).otherwise(F.col("text"))
    changed = {"text": text}
    if "n_chars" in docs.columns:
        n_chars = docs.schema["n_chars"].dataType
        changed["n_chars"] = F.when(hit, F.length(text).cast(n_chars)).otherwise(F.col("data")["n_chars"])
    return unpacked(clean, docs.columns, changed)
