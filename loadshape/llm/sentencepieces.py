"""SentencePiece encoding and decoding on the tokenizers library.

The model file is parsed and rebuilt (``piece_model``) once per Python worker.
Where the vocabulary shows that no piece crosses the start of a marked word,
a batch of texts is cut into its words, the words that the worker hasn't seen
are encoded by multithreaded ``encode_batch`` calls on lists of them, and texts
are put together from the words' ids: the same ids as encoding whole texts, at
a fraction of the work. Other vocabularies encode whole texts.

All ids are the rebuilt tokenizer's. Parity: the sentencepiece library is the
judge of every word (or whole text) that a worker sees for the first time; a
text's ``parity`` is false if the judge differs on one of its words. As words
encode on their own, that is the parity of the whole text.

Edge cases: null text gives null ids, zero tokens and null decoded text; an
empty text has no ids and decodes to itself; very long texts hold one id array
and no per-token objects; repeated rows repeat; other columns pass, and a new
column whose name is taken gets underscores behind it.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadshape.llm.piece_model import MARK, PieceModel
from loadshape.llm.shared import bound_batches, free_name

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
THREADS = 2
#: Bytes of words and their ids that a worker keeps, about.
CACHE_BYTES = 64 << 20
#: What an entry of the cache takes beside its characters and ids.
ENTRY_BYTES = 230
CALL_CHARS = 200_000
#: New words that are encoded as one text.
TOGETHER = 64

ENCODED = T.StructType([
    T.StructField("ids", T.ArrayType(T.IntegerType())),
    T.StructField("parity", T.BooleanType()),
    T.StructField("round_trip", T.BooleanType()),
])


def batches_of(texts: list[str], most: int) -> Iterator[list[str]]:
    """Cut a list so that each part has about ``most`` characters."""
    part, held = [], 0
    for t in texts:
        part.append(t)
        held += len(t)
        if held >= most:
            yield part
            part, held = [], 0
    if part:
        yield part


class PieceTable:
    """What decoding needs of a model file: the bytes of every piece."""

    def __init__(self, model: PieceModel):
        self.bytes = np.array(model.piece_bytes(), object)
        self.dummy_prefix = model.dummy_prefix

    def decode(self, ids: np.ndarray | None) -> str | None:
        if ids is None:
            return None
        text = b"".join(self.bytes[ids]).decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text[:1] == " " else text


class Codec:
    """Encoder and decoder of one model file in one process."""

    def __init__(self, path: str, threads: int = THREADS, cache_bytes: int = CACHE_BYTES):
        # read by the library's thread pool when it first runs in this process
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        with open(path, "rb") as f:
            data = f.read()
        self.model = PieceModel.read(data)
        self.backend = self.model.tokenizer()
        self.judge = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.pieces = PieceTable(self.model)
        plain = not self.model.charsmap and not self.model.squeeze_spaces
        self.by_word = plain and self.model.escape_spaces and self.model.dummy_prefix and self.model.splits_at_marks()
        self.starts = np.array([p.startswith(MARK) for p in self.model.pieces])
        self.word = re.compile("[ ▁]+[^ ▁]*|[^ ▁]+")
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.odd: set[str] = set()
        self.held, self.cache_bytes = 0, cache_bytes

    def _encode(self, texts: list[str]) -> Iterator[tuple[bytes, bool]]:
        """Ids (int32 bytes) per text and whether the judge agrees."""
        for part in batches_of(texts, CALL_CHARS):
            ours = self.backend.encode_batch_fast(part, add_special_tokens=False)
            theirs = self.judge.encode(part, num_threads=1)
            for mine, other in zip(ours, theirs):
                ids = mine.ids
                yield array("i", ids).tobytes(), ids == other

    def _keep(self, word: str, ids: bytes, same: bool) -> None:
        self.cache[word] = ids
        self.held += ENTRY_BYTES + 2 * len(word) + len(ids)
        if not same:
            self.odd.add(word)

    def _age(self) -> None:
        """Forget the words that weren't met since the last time; those met
        since then stay, and come back to the cache when they're met again."""
        self.older, self.cache, self.held = self.cache, {}, 0
        self.odd.intersection_update(self.older)

    def _learn(self, words: list[str]) -> None:
        # " word" as a text of its own would carry one mark more; the dummy prefix adds it back.
        # A lone trailing space would be an empty text, so it is encoded behind a letter.
        lone = [w for w in words if w in (" ", MARK)]
        if lone:
            ours, theirs = ([encode(t) for t in ("a", "a ")] for encode in (
                lambda t: self.backend.encode(t, add_special_tokens=False).ids, self.judge.encode))
            for w in lone:
                self._keep(w, np.array(ours[1][len(ours[0]):], np.int32).tobytes(), ours == theirs)
        words = [w for w in words if w not in (" ", MARK)]
        once = [w for w in words if w[0] in (" ", MARK) and w[1] not in (" ", MARK)]
        words = [w for w in words if w[0] not in (" ", MARK) or w[1] in (" ", MARK)] + self._learn_together(once)
        for word, (ids, same) in zip(words, self._encode([w[1:] if w[0] in (" ", MARK) else w for w in words])):
            self._keep(word, ids, same)

    def _learn_together(self, words: list[str]) -> list[str]:
        """Learn words of one mark and what follows it, several to a text. Only
        a word's first piece begins with a mark, so the ids are cut there. The
        words of texts that the judge encodes otherwise, or whose pieces don't
        show their words, are given back to be encoded one by one."""
        left: list[str] = []
        groups = [words[at: at + TOGETHER] for at in range(0, len(words), TOGETHER)]
        for (ids, same), group in zip(self._encode(["".join(g)[1:] for g in groups]), groups):
            starts = np.flatnonzero(self.starts[np.frombuffer(ids, np.int32)])
            if not same or len(starts) != len(group) or starts[0]:
                left += group
                continue
            cuts = [*(starts * 4).tolist(), len(ids)]
            for word, begin, end in zip(group, cuts, cuts[1:]):
                self._keep(word, ids[begin:end], True)
        return left

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray | None, bool]]:
        if not self.by_word:
            whole = [t for t in texts if t]
            found = iter(list(self._encode(whole)))
            out = [next(found) if t else (b"", True) for t in texts]
        else:
            out = []
            todo = iter(texts)
            while part := list(islice(todo, 64)):
                cut = [self.word.findall(" " + t) if t else [] for t in part]
                fresh = {w for words in cut for w in words}.difference(self.cache)
                if fresh:
                    if self.held > self.cache_bytes // 2:
                        self._age()
                        fresh = {w for words in cut for w in words}
                    known = self.older.keys() & fresh
                    for w in known:
                        self._keep(w, self.older.pop(w), w not in self.odd)
                    self._learn(list(fresh - known))
                get = self.cache.__getitem__
                for words in cut:
                    out.append((b"".join(map(get, words)), not self.odd or self.odd.isdisjoint(words)))
        return [(None if t is None else np.frombuffer(ids, np.int32), same) for t, (ids, same) in zip(texts, out)]

    def decode(self, ids: np.ndarray | None) -> str | None:
        return self.pieces.decode(ids)


_codecs: dict[tuple[str, int], Codec] = {}


def codec(path: str, threads: int = THREADS) -> Codec:
    if (path, threads) not in _codecs:
        _codecs[path, threads] = Codec(path, threads)
    return _codecs[path, threads]


_tables: dict[str, PieceTable] = {}


def piece_table(path: str) -> PieceTable:
    if path not in _tables:
        with open(path, "rb") as f:
            _tables[path] = PieceTable(PieceModel.read(f.read()))
    return _tables[path]


def encoded(text: Column, path: str = MODEL, threads: int = THREADS) -> Column:
    """Struct of the token ids of a text column, the parity verdict and
    whether decoding gives the text back, all from one pass."""

    @F.pandas_udf(ENCODED)
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = codec(path, threads)
        for texts in batches:
            found = own.encode(list(texts))
            yield pd.DataFrame({"ids": [i for i, _ in found], "parity": [p for _, p in found],
                                "round_trip": [own.decode(i) == t for t, (i, _) in zip(texts, found)]})

    return encode(text)


def decoded(ids: Column, path: str = MODEL) -> Column:
    """Text of a column of token ids; a worker holds the piece table only."""

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = piece_table(path)
        for rows in batches:
            yield pd.Series([own.decode(None if r is None else np.asarray(r, np.int64)) for r in rows], dtype=object)

    return decode(ids)


def tokenize(docs: DataFrame, path: str = MODEL, threads: int = THREADS) -> DataFrame:
    """``docs`` with ``token_ids``, ``parity`` and ``round_trip``."""
    bound_batches(docs.sparkSession)
    piece = free_name(docs, "piece")
    out = docs.withColumn(piece, encoded(F.col("text"), path, threads))
    for field, name in (("ids", "token_ids"), ("parity", "parity"), ("round_trip", "round_trip")):
        out = out.withColumn(free_name(docs, name), F.col(piece)[field])
    return out.drop(piece)


REPORT = T.StructType([
    T.StructField("n_tokens", T.LongType()),
    T.StructField("n_bytes", T.LongType()),
    T.StructField("ids_sha256", T.StringType()),
    T.StructField("round_trip", T.BooleanType()),
    T.StructField("parity", T.BooleanType()),
])


def encoding_report(docs: DataFrame, path: str = MODEL, threads: int = THREADS) -> DataFrame:
    """Per document: token and byte counts, SHA-256 of the ids (comma-joined
    decimals), whether decoding gives the text back, and parity."""
    bound_batches(docs.sparkSession)

    @F.pandas_udf(REPORT)
    def report(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = codec(path, threads)
        names = np.array([str(i).encode() for i in range(len(own.pieces.bytes))], object)
        for texts in batches:
            rows = []
            for text, (ids, same) in zip(texts, own.encode(list(texts))):
                ids = np.zeros(0, np.int32) if ids is None else ids
                rows.append((len(ids), len((text or "").encode()), hashlib.sha256(b",".join(names[ids])).hexdigest(),
                             own.decode(ids) == (text or "").replace(MARK, " "), same))
            yield pd.DataFrame(rows, columns=REPORT.names)

    return docs.select("doc_id", report("text").alias("r")).select("doc_id", "r.*")
