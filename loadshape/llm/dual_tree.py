"""Vector code compression by dual-tree Lloyd rounds.

Components become integers floor(1024 c), vectors are cut into four parts, and
each part position has a codebook of 256 entries. A round assigns every part to
its nearest entry and moves entries to the floored means of their parts.

Rows are gathered into blocks. Per block and part a tree halves the parts at
the median of the widest dimension; its nodes keep their box, count and the sum
of their parts, so a tree is built once and serves all rounds. A codebook is a
small tree of the same kind. Both are walked together: of all pairs (node of
parts, node of entries) those remain whose least box distance isn't above the
least of the node's greatest ones, and among single entries those that the best
one doesn't beat in the whole box. A node of parts with one entry left is
assigned whole, by its cached sum; leaves that stay uncertain compare integer
distances with their remaining entries. All bounds are exact integers and ties
survive them, so the result equals plain assignment.

A task returns one row of sums per entry and position. The driver holds the
codebooks, 256 entries per length of vector.

Edge cases: rows whose vector is null or holds null or non-finite components
are dropped; vectors of different length have codebooks of their own; lengths
that four doesn't divide are cut at the floors of their quarters; with fewer
than 256 rows the codebook is that much shorter; null vec_ids come last in the
first codebook, repeated ones by their components; components beyond 2^52 in
size count as 2^52 of their sign, ``error`` and ``label_error`` are null where
they don't fit a long; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadshape.llm.shared import bound_batches, with_group_values, write_shared

SCALE = 1024
MOST_COMPONENT = 2.0 ** 52
PARTS = 4
ENTRIES = 256
ROUNDS = 4
BLOCK_ROWS = 8192
LEAF_ROWS = 32
#: Components of all pairs that a walk may hold at once, about.
WALK_CELLS = 1 << 20

Codebooks = dict[int, list[np.ndarray]]


def scaled_rows(vectors: DataFrame) -> DataFrame:
    """Rows with a whole, finite vector, as integers: vec_id, label, dim, x."""
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c) < float("inf")))
    bounded = lambda c: F.greatest(F.least(c.cast("double"), F.lit(MOST_COMPONENT)), F.lit(-MOST_COMPONENT))
    return vectors.where(F.coalesce(finite, F.lit(False))).select(
        "vec_id", "label", F.size("embedding").alias("dim"),
        F.transform("embedding", lambda c: F.floor(bounded(c) * SCALE)).alias("x"))


def cuts(dim: int) -> list[slice]:
    return [slice(k * dim // PARTS, (k + 1) * dim // PARTS) for k in range(PARTS)]


def exact(x: np.ndarray) -> np.ndarray:
    """As longs if squared distances fit, else as Python integers."""
    most = max(int(x.max(initial=0)), -int(x.min(initial=0)))
    return x.astype(np.int64) if 4 * most * most * max(x.shape[1], 1) < 1 << 60 else x.astype(object)


@dataclass
class Tree:
    """Boxes, sums and row ranges of a balanced tree; ``order`` sorts rows so
    that every node is a range. ``left`` is -1 for a leaf, else the right child
    follows the left one."""

    order: np.ndarray
    points: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    left: np.ndarray
    low: np.ndarray
    high: np.ndarray
    sums: np.ndarray

    @staticmethod
    def build(points: np.ndarray, leaf_rows: int) -> Tree:
        order = np.arange(len(points))
        begin, end, left, low, high = [0], [len(points)], [], [], []
        for node in iter_growing(begin):
            a, b = begin[node], end[node]
            held = points[order[a:b]]
            lo, hi = held.min(axis=0), held.max(axis=0)
            low.append(lo)
            high.append(hi)
            extent = hi - lo
            if b - a <= leaf_rows or not extent.any():  # equal parts need no halving
                left.append(-1)
                continue
            widest = int(extent.argmax())
            middle = (b - a) // 2
            order[a:b] = order[a:b][held[:, widest].argsort(kind="stable")]
            left.append(len(begin))
            begin += [a, a + middle]
            end += [a + middle, b]
        begin, end = np.array(begin), np.array(end)
        points = points[order]
        totals = np.concatenate([np.zeros((1, points.shape[1]), points.dtype), np.cumsum(points, axis=0)])
        return Tree(order, points, begin, end, np.array(left), np.array(low, points.dtype), np.array(high, points.dtype),
                    totals[end] - totals[begin])

    def extent(self) -> np.ndarray:
        size = self.high - self.low
        return (size * size).sum(axis=1)


def iter_growing(items: list) -> Iterator[int]:
    """Numbers of the items of a list that grows meanwhile."""
    at = 0
    while at < len(items):
        yield at
        at += 1


@dataclass
class EntryTree:
    """Tree over the distinct entries of a codebook; of equal entries the first
    stands for all."""

    entries: np.ndarray
    tree: Tree
    number: np.ndarray  # of the entry in a leaf node, else -1

    @staticmethod
    def build(entries: np.ndarray) -> EntryTree:
        seen: dict[tuple, int] = {}
        for k, e in enumerate(entries.tolist()):
            seen.setdefault(tuple(e), k)
        first = np.array(list(seen.values()), int)
        tree = Tree.build(entries[first], 1)
        number = np.where(tree.left < 0, first[tree.order[tree.begin]], -1)
        return EntryTree(entries, tree, number)


@dataclass
class Assigned:
    """Nearest entry per row in tree order, and the entries' counts and sums."""

    entry: np.ndarray
    counts: np.ndarray
    sums: np.ndarray
    compared: int = 0  # integer distances computed


def first_of_each(groups: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))


def assign(parts: Tree, book: EntryTree) -> Assigned:
    """Nearest entry of every part by walking both trees together."""
    tree, number = book.tree, book.number
    k = len(book.entries)
    done = Assigned(np.zeros(len(parts.points), np.int64), np.zeros(k, np.int64), np.zeros((k, parts.points.shape[1]), parts.points.dtype))
    part_extent, entry_extent = parts.extent(), tree.extent()
    p, e = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while len(p):
        plow, phigh, elow, ehigh = parts.low[p], parts.high[p], tree.low[e], tree.high[e]
        gap = np.maximum(np.maximum(elow - phigh, plow - ehigh), 0)
        far = np.maximum(ehigh - plow, phigh - elow)
        least, most = (gap * gap).sum(axis=1), (far * far).sum(axis=1)
        starts = first_of_each(p)
        group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(p))))
        keep = least <= np.minimum.reduceat(most, starts)[group]
        keep &= ~beaten(parts, book, p, e, most, group)
        p, e = p[keep], e[keep]

        starts = first_of_each(p)
        sizes = np.diff(np.append(starts, len(p)))
        node, group = p[starts], np.repeat(np.arange(len(starts)), sizes)
        single = number[e] >= 0
        whole = (sizes == 1) & single[starts]
        settle(done, parts, node[whole], number[e[starts[whole]]])
        all_single = np.logical_and.reduceat(single, starts)
        leaf = parts.left[node] < 0
        compare(done, parts, book, p, e, starts, sizes, np.flatnonzero(~whole & all_single & leaf))

        # the larger side is halved: the node of parts, or all its nodes of entries
        widest = np.maximum.reduceat(np.where(single, 0, entry_extent[e]), starts)
        halve = ~whole & ~leaf & (all_single | (part_extent[node] > widest))
        open_ = ~whole & ~halve & ~all_single
        on = halve[group]
        p1, e1 = np.concatenate([parts.left[p[on]], parts.left[p[on]] + 1]), np.concatenate([e[on], e[on]])
        on = open_[group]
        p2, e2, s2 = p[on], e[on], single[on]
        p = np.concatenate([p1, p2[s2], p2[~s2], p2[~s2]])
        e = np.concatenate([e1, e2[s2], tree.left[e2[~s2]], tree.left[e2[~s2]] + 1])
        by = np.lexsort((e, p))
        p, e = p[by], e[by]
    return done


def beaten(parts: Tree, book: EntryTree, p: np.ndarray, e: np.ndarray, most: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Pairs whose single entry is, for every place in the node's box, further
    away than the group's best single entry, or as far with a higher number."""
    out = np.zeros(len(p), bool)
    at = np.flatnonzero(book.number[e] >= 0)
    if not len(at):
        return out
    by = at[np.lexsort((book.number[e[at]], most[at], group[at]))]
    best = by[first_of_each(group[by])]
    rival = np.full(group[-1] + 1, -1)
    rival[group[best]] = best
    rival = rival[group[at]]
    near, other = book.number[e[rival]], book.number[e[at]]
    a, b = book.entries[near], book.entries[other]
    towards = b - a
    corner = np.where(towards > 0, parts.high[p[at]], parts.low[p[at]])
    # |x - a|^2 - |x - b|^2 at the corner of the box that favours b most
    worst = ((2 * corner - a - b) * towards).sum(axis=1)
    out[at] = (worst < 0) | ((worst == 0) & (near < other))
    return out


def settle(done: Assigned, parts: Tree, nodes: np.ndarray, entries: np.ndarray) -> None:
    """Whole nodes to one entry each, by their cached sums."""
    np.add.at(done.counts, entries, parts.end[nodes] - parts.begin[nodes])
    np.add.at(done.sums, entries, parts.sums[nodes])
    for a, b, entry in zip(parts.begin[nodes], parts.end[nodes], entries):
        done.entry[a:b] = entry


def compare(done: Assigned, parts: Tree, book: EntryTree, p, e, starts, sizes, uncertain: np.ndarray) -> None:
    """Leaves with several entries left: integer distances, lowest number on ties."""
    for g in uncertain:
        a, b = parts.begin[p[starts[g]]], parts.end[p[starts[g]]]
        left = np.sort(book.number[e[starts[g]: starts[g] + sizes[g]]])
        held, rivals = parts.points[a:b], book.entries[left]
        # without |x|^2, the same for all entries
        distance = (rivals * rivals).sum(axis=1) - 2 * (held @ rivals.T)
        done.entry[a:b] = left[distance.argmin(axis=1)]
        done.compared += distance.size
        np.add.at(done.counts, done.entry[a:b], 1)
        np.add.at(done.sums, done.entry[a:b], held)


def block_rows_for(dim: int, most: int) -> int:
    """Rows of a block so that a walk that prunes nothing stays in bounds."""
    return max(2 * LEAF_ROWS, min(most, WALK_CELLS // max(-(-dim // PARTS), 1)))


def blocks_of(rows: DataFrame, block_rows: int) -> DataFrame:
    """Rows gathered into blocks with one tree per part, written once."""
    ids, labels = rows.schema["vec_id"].dataType, rows.schema["label"].dataType
    schema = T.StructType([
        T.StructField("dim", T.IntegerType()), T.StructField("vec_ids", T.ArrayType(ids)),
        T.StructField("labels", T.ArrayType(labels)), T.StructField("trees", T.BinaryType())])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema
        arrow = to_arrow_schema(schema)
        held: dict[int, list[pa.Table]] = {}

        def out(dim: int) -> Iterator[pa.RecordBatch]:
            table = pa.concat_tables(held.pop(dim)).combine_chunks()
            for at in range(0, len(table), block_rows_for(dim, block_rows)):
                part = table.slice(at, block_rows_for(dim, block_rows)).combine_chunks()
                flat = part.column("x").combine_chunks().flatten().to_numpy().reshape(len(part), dim)
                trees = [Tree.build(exact(flat[:, c]), LEAF_ROWS) for c in cuts(dim)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v], f.type) for v, f in zip(
                        (dim, part.column("vec_id").to_pylist(), part.column("labels").to_pylist(), pickle.dumps(trees, 5)), arrow)],
                    schema=arrow)

        count: dict[int, int] = {}
        for batch in batches:
            table = pa.Table.from_batches([batch]).rename_columns(["vec_id", "labels", "dim", "x"])
            for dim in table.column("dim").unique().to_pylist():
                held.setdefault(dim, []).append(table.filter(pc.equal(table.column("dim"), dim)))
                count[dim] = count.get(dim, 0) + len(held[dim][-1])
                if count[dim] >= block_rows_for(dim, block_rows):
                    yield from out(dim)
                    count[dim] = 0
            if sum(count[d] * (d + 4) for d in held) > 4 * WALK_CELLS:  # many lengths, few rows of each
                for dim in list(held):
                    yield from out(dim)
                    count[dim] = 0
        for dim in list(held):
            yield from out(dim)

    return write_shared(rows.mapInArrow(gather, schema), "code-blocks")


def first_codebooks(rows: DataFrame, entries: int) -> Codebooks:
    """The parts of the smallest ids' vectors, per length of vector."""
    place = F.row_number().over(Window.partitionBy("dim").orderBy(F.col("vec_id").asc_nulls_last(), "x"))
    found = rows.select("dim", "x", place.alias("place")).where(F.col("place") <= entries).orderBy("dim", "place").toLocalIterator()
    out = {}
    for dim, chosen in groupby(found, key=lambda r: r.dim):
        x = [r.x for r in chosen]
        x = np.array(x, np.int64).reshape(len(x), dim)
        out[dim] = [x[:, c] for c in cuts(dim)]
    return out


def walk(trees: list[Tree], books: list[np.ndarray]) -> Iterator[tuple[Tree, EntryTree, Assigned]]:
    for tree, book in zip(trees, books):
        entries = exact(book)
        if tree.points.dtype == object or entries.dtype == object:
            tree = Tree(tree.order, *(getattr(tree, n) if n in ("begin", "end", "left") else getattr(tree, n).astype(object)
                                      for n in ("points", "begin", "end", "left", "low", "high", "sums")))
            entries = entries.astype(object)
        built = EntryTree.build(entries)
        yield tree, built, assign(tree, built)


def moved(blocks: DataFrame, books: Codebooks, name: str) -> Codebooks:
    """The codebooks after one round."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], list] = {}
        for batch in batches:
            for dim, trees in zip(batch.column("dim").to_pylist(), batch.column("trees")):
                for part, (_, _, done) in enumerate(walk(pickle.loads(trees.as_py()), books[dim])):
                    held = total.setdefault((dim, part), [0, 0])
                    held[0], held[1] = held[0] + done.counts, held[1] + done.sums.astype(object)
        for (dim, part), (counts, sums_) in total.items():
            used = np.flatnonzero(counts)
            if not sums_.shape[1]:  # vectors of fewer than four components have empty parts
                continue
            entry, place = np.repeat(used, sums_.shape[1]), np.tile(np.arange(sums_.shape[1]), len(used))
            yield pa.RecordBatch.from_pandas(pd.DataFrame({
                "dim": dim, "part": part, "entry": entry, "place": place, "n": counts[entry],
                "total": [Decimal(int(v)) for v in sums_[used].ravel()]}), schema=pa.schema([
                    ("dim", pa.int32()), ("part", pa.int32()), ("entry", pa.int32()), ("place", pa.int32()),
                    ("n", pa.int64()), ("total", pa.decimal128(38, 0))]), preserve_index=False)

    told = blocks.select("dim", "trees").mapInArrow(sums, "dim int, part int, entry int, place int, n long, total decimal(38,0)")
    means = write_shared(told.groupBy("dim", "part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")), name)
    out = {dim: [b.astype(object) for b in parts] for dim, parts in books.items()}
    for r in means.toLocalIterator():  # at most one per component of a codebook
        out[r.dim][r.part][r.entry, r.place] = int(r.total) // r.n
    return {dim: [b.astype(np.int64) for b in parts] for dim, parts in out.items()}


def codes_of(blocks: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id, label, code, error, codebooks_sha256 of every row."""
    ids, labels = (blocks.schema[c].dataType.elementType for c in ("vec_ids", "labels"))
    schema = T.StructType([
        T.StructField("vec_id", ids), T.StructField("label", labels), T.StructField("code", T.StringType()),
        T.StructField("error", T.LongType()), T.StructField("codebooks_sha256", T.StringType())])
    digest = {dim: hashlib.sha256(",".join(str(v) for b in parts for v in b.ravel().tolist()).encode()).hexdigest()
              for dim, parts in books.items()}

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema
        for batch in batches:
            for i, dim in enumerate(batch.column("dim").to_pylist()):
                numbers, error = [], 0
                for tree, book, done in walk(pickle.loads(batch.column("trees")[i].as_py()), books[dim]):
                    away = tree.points - book.entries[done.entry]
                    back = np.argsort(tree.order)
                    numbers.append(done.entry[back])
                    error = error + (away * away).sum(axis=1)[back].astype(object)
                codes = ["".join("%02x" % k for k in row) for row in np.column_stack(numbers).tolist()]
                fits = [int(v) if v < 1 << 63 else None for v in error]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_ids")[i].values, batch.column("labels")[i].values, pa.array(codes, pa.string()),
                     pa.array(fits, pa.int64()), pa.array([digest[dim]] * len(codes), pa.string())],
                    schema=to_arrow_schema(schema))

    return write_shared(blocks.mapInArrow(code, schema), "codes")


def compressed(vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per kept vector: vec_id, code, error, label_error, codebooks_sha256."""
    bound_batches(vectors.sparkSession)
    rows = scaled_rows(vectors.select("vec_id", "label", "embedding"))
    blocks = blocks_of(rows, block_rows)
    books = first_codebooks(rows, entries)
    for k in range(rounds):
        books = moved(blocks, books, f"code-means-{k}")
    coded = codes_of(blocks, books)
    return with_group_values(coded, "label", {"label_error": F.expr("if(bool_or(error IS NULL), NULL, try_sum(error))")}).select(
        "vec_id", "code", "error", "label_error", "codebooks_sha256")


def _round_sql(k: int) -> str:
    """Assignment a{k} of parts to the entries c{k}, and the entries c{k+1}."""
    return f"""
a{k} AS MATERIALIZED (
  SELECT p.vec_id, p.part, min(list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * 256 + c.entry) AS best
  FROM p JOIN c{k} c USING (part) GROUP BY ALL),
s{k} AS (
  SELECT part, (best % 256)::BIGINT AS entry, i, sum(v[i])::HUGEINT AS total, count(*)::HUGEINT AS n
  FROM a{k} JOIN p USING (vec_id, part), unnest(range(1, len(v) + 1)) AS r(i) GROUP BY ALL),
m{k} AS (
  SELECT part, entry, list(((total - ((total % n) + n) % n) // n)::BIGINT ORDER BY i) AS v FROM s{k} GROUP BY ALL),
c{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m.v, c.v) AS v FROM c{k} c LEFT JOIN m{k} m USING (part, entry)),"""


CODES_SQL = f"""
WITH x AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda c: floor({SCALE} * c::DOUBLE)::BIGINT) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0),
p AS MATERIALIZED (
  SELECT vec_id, label, part, list_slice(x, part * (len(x) // 4) + 1, (part + 1) * (len(x) // 4)) AS v
  FROM x, unnest(range({PARTS})) AS r(part)),
c0 AS MATERIALIZED (
  SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, v
  FROM p QUALIFY row_number() OVER (PARTITION BY part ORDER BY vec_id) <= {ENTRIES}),
{"".join(map(_round_sql, range(ROUNDS)))}
f AS (
  SELECT vec_id, part, min(list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * 256 + c.entry) AS best
  FROM p JOIN c{ROUNDS} c USING (part) GROUP BY ALL),
g AS (
  SELECT vec_id, string_agg(printf('%02x', (best % 256)::INT), '' ORDER BY part) AS code, sum(best // 256)::BIGINT AS error
  FROM f GROUP BY ALL)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) FROM c{ROUNDS}) AS codebooks_sha256
FROM g JOIN x USING (vec_id)
"""
