"""Vector codes, whitening and content sort against plain versions, and their
edge cases: nulls, empty and very long texts, ties, repeated rows, empty
tables, clashing extra columns."""

import hashlib
import math
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loadshape.llm import content_sort, dual_tree, queries, whitening

from .conftest import SF

VECTORS = "vec_id long, label int, embedding array<float>"


def finite_rows(rows):
    return [r for r in rows if r[2] is not None and all(c is not None and math.isfinite(c) for c in r[2])]


def table(spark, name):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/{name}.parquet").collect()]


# ---- 11: dual-tree codes ----

def brute_codes(rows, entries=256, rounds=4):
    rows = finite_rows(rows)
    x = np.array([[math.floor(1024 * c) for c in r[2]] for r in rows], np.int64)
    first = sorted(range(len(rows)), key=lambda k: rows[k][0])[:entries]
    w = x.shape[1] // 4
    parts = [x[:, k * w:(k + 1) * w] for k in range(4)]
    books = [p[first].copy() for p in parts]

    def nearest(p, book):
        d = ((p[:, None] - book[None]) ** 2).sum(axis=2)
        return d.argmin(axis=1), d.min(axis=1)

    for _ in range(rounds):
        for p, book in zip(parts, books):
            at, _d = nearest(p, book)
            for e in np.unique(at):
                book[e] = p[at == e].sum(axis=0) // (at == e).sum()
    found = [nearest(p, b) for p, b in zip(parts, books)]
    error = sum(d for _, d in found)
    by_label = {}
    for r, e in zip(rows, error):
        by_label[r[1]] = by_label.get(r[1], 0) + int(e)
    digest = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel()).encode()).hexdigest()
    return sorted(((r[0], "".join("%02x" % at[i] for at, _ in found), int(error[i]), by_label[r[1]], digest)
                   for i, r in enumerate(rows)), key=str)


def test_codes_equal_plain_lloyd(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8))
    rows = [(int(i), None if i % 7 == 0 else int(i % 3), (centres[i % 12] + rng.normal(size=8) * rng.choice([0, .01, .5])).tolist())
            for i in rng.permutation(900)]
    rows += [(1000 + i, 1, rows[5][2]) for i in range(300)]  # copies
    rows += [(2000, 1, None), (2001, 1, [None] * 8), (2002, None, [math.nan] * 8), (2003, 2, [math.inf] + [0.0] * 7)]
    df = spark.createDataFrame(rows, VECTORS)
    want = brute_codes([tuple(r) for r in df.collect()], entries=20)
    clash = df.repartition(5).select("*", *[F.lit("x").alias(c) for c in ("x", "dim", "code", "of_key", "trees", "labels")])
    for block_rows in (8192, 64):
        got = dual_tree.compressed(clash, entries=20, block_rows=block_rows)
        assert sorted((tuple(r) for r in got.collect()), key=str) == want


def test_codes_query_equals_plain_lloyd_and_sql(spark):
    got = sorted((tuple(r) for r in queries.op11_code_compression(spark, SF).collect()), key=str)
    assert got == brute_codes(table_vectors(spark))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    assert sorted(con.execute(dual_tree.CODES_SQL).fetchall(), key=str) == got


def table_vectors(spark):
    return [(r.vec_id, r.label, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]


def test_codes_edge_vectors(spark):
    rows = [(1, 1, None), (4, None, []), (5, None, [1.0, 2.0, 3.0, 4.0, 5.0]), (6, 2, [1.0, 2.0, 3.0, 4.0]),
            (7, 2, [3.0, -2.0, 1.0, 1.0]), (8, 1, [1e30, 4.0, 1.0, 1.0]), (9, 1, [1.0]), (None, 1, [-0.5, 2.25, 1.0, 1.0]),
            (6, 2, [1.0, 2.0, 3.0, 4.0])]
    out = {(r.vec_id, len(r.code)): (r.code, r.error, r.label_error)
           for r in dual_tree.compressed(spark.createDataFrame(rows, VECTORS)).collect()}
    # equal entries: the first of them; each length of vector has its own codebook; null ids come last
    assert out == {(4, 8): ("00000000", 0, 0), (5, 8): ("00000000", 0, 0), (6, 8): ("00000000", 0, 0), (7, 8): ("02020202", 0, 0),
                   (8, 8): ("03030202", 0, 0), (9, 8): ("00000000", 0, 0), (None, 8): ("04040202", 0, 0)}
    far = spark.createDataFrame([(1, 1, [0.0] * 4), (2, 1, [1e30] * 4), (3, 1, [1e29] * 4)], VECTORS)
    errors = {r.vec_id: (r.error, r.label_error) for r in dual_tree.compressed(far, entries=1, rounds=0).collect()}
    assert errors == {1: (0, None), 2: (None, None), 3: (None, None)}
    assert dual_tree.compressed(spark.createDataFrame(rows[:1], VECTORS)).collect() == []


@pytest.mark.parametrize("scale", [3, 1000, 1 << 40])
def test_dual_tree_walk_equals_plain_distances(scale):
    rng = np.random.default_rng(scale)
    points = rng.integers(-scale, scale, (700, 3))
    points[::5] = points[0]
    entries = rng.integers(-scale, scale, (40, 3))
    entries[7] = entries[31]
    tree = dual_tree.Tree.build(dual_tree.exact(points), 8)
    (tree, _, done), = dual_tree.walk([tree], [entries])
    d = ((points[:, None].astype(object) - entries[None]) ** 2).sum(axis=2)
    want = np.array([min(range(40), key=lambda k: (row[k], k)) for row in d])
    assert (done.entry[np.argsort(tree.order)] == want).all()
    assert (done.counts == np.bincount(want, minlength=40)).all()
    for e in range(40):
        assert (done.sums[e] == points[want == e].sum(axis=0)).all()


def test_dual_tree_prunes_clustered_parts():
    rng = np.random.default_rng(1)
    centres = rng.integers(-100_000, 100_000, (32, 16))
    points = centres[rng.integers(0, 32, 8000)] + rng.integers(-200, 200, (8000, 16))
    (_, _, done), = dual_tree.walk([dual_tree.Tree.build(points, dual_tree.LEAF_ROWS)], [centres])
    assert done.counts.sum() == len(points)
    assert done.compared < 0.1 * len(points) * len(centres)


# ---- 12: whitening ----

def brute_whitening(rows, k=16):
    rows = finite_rows(rows)
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in r[2]] for r in rows], np.int64)
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(axis=0)
    centred = fit - total / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    z = ((x * n - total) / n) @ axes[:, ::-1][:, :k] / np.sqrt(values[::-1][:k])
    deviation = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, total)) for row in x]
    return n, dict(zip([r[0] for r in rows], deviation)), dict(zip([r[0] for r in rows], z)), values[::-1][:k] / values.sum()


def check_whitening(got, rows):
    n, deviation, z, explained = brute_whitening(rows)
    assert len(got) == sum(map(len, z.values()))
    sign = {}
    for r in got:
        k = r.component - 1
        want = z[r.vec_id][k]
        sign.setdefault(k, None)
        if sign[k] is None and abs(want) > 1e-3:
            sign[k] = np.sign(want) * np.sign(r.whitened)
        assert r.n == n and r.deviation == deviation[r.vec_id] and r.identity_error < 1e-9
        assert abs(r.explained - explained[k]) <= 1e-9 * explained[k]
        assert sign[k] is None or abs(r.whitened * sign[k] - want) < 1e-8


def test_whitening_query_equals_eigenvectors(spark):
    check_whitening(queries.op12_whitening(spark, SF).collect(), table_vectors(spark))


def test_whitening_skewed_copies_and_clashing_columns(spark):
    rng = np.random.default_rng(5)
    mix = rng.normal(size=(6, 6)) * [50, 20, 8, 4, 2, 1]
    rows = [(i, i % 2, (rng.normal(size=6) @ mix + 1000).tolist()) for i in range(400)]
    rows += [(1000 + i, None, rows[3][2]) for i in range(500)]
    rows += [(2000, 1, None), (2001, 1, [None] * 6), (2002, 1, [math.nan] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(4)
    clash = df.select("*", *[F.lit("x").alias(c) for c in ("x", "dim", "n", "i", "value", "component", "place")])
    check_whitening(whitening.whitened(clash).collect(), rows)


def test_whitening_edge_vectors(spark):
    rows = [(1, 1, None), (4, 1, []), (5, 1, [1.0, 2.0]), (5, 1, [1.0, 2.0]), (7, 1, [3.0, -2.0]), (9, 1, [1.0]),
            (None, 1, [-0.5, 2.25])]
    got = whitening.whitened(spark.createDataFrame(rows, VECTORS)).collect()
    assert sorted((r.vec_id or 0, r.component, r.n) for r in got) == sorted(
        (v, c, 3) for v in (5, 5, 7, 0) for c in (1, 2))  # one vector of length 1: no variance, no rows
    one = spark.createDataFrame([(1, 1, [2.0, 2.0]), (2, 1, [2.0, 2.0])], VECTORS)
    assert whitening.whitened(one).collect() == []
    assert whitening.whitened(one.limit(0)).collect() == []
    huge = whitening.whitened(spark.createDataFrame([(1, 1, [1e30]), (2, 1, [0.0])], VECTORS)).collect()
    assert [(r.deviation, round(abs(r.whitened), 9)) for r in huge] == [(None, 1.0)] * 2


def test_cholesky_and_jacobi_of_low_rank_and_ill_scaled_scatter():
    rng = np.random.default_rng(2)
    b = rng.normal(size=(9, 4)) * [1e6, 1e3, 1, 1e-3]
    a = b @ b.T
    factor = whitening.pivoted_cholesky(a)
    assert factor.shape[1] <= 5 and np.allclose(factor @ factor.T, a, rtol=1e-12, atol=1e-12 * a.max())
    turned = whitening.one_sided_jacobi(factor)
    gram = turned.T @ turned
    norms = np.sqrt(gram.diagonal())
    assert np.abs(gram / np.outer(norms, norms) - np.eye(len(gram))).max() < 1e-14
    values = np.sort(norms ** 2)[::-1]
    # the matrix itself is rounded at 1e-16 of its largest eigenvalue
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1][:len(values)], rtol=0, atol=1e-14 * values[0])


def test_products_are_exact_at_any_size():
    for most in (10, 1 << 20, 1 << 30, 1 << 50):
        d = np.random.default_rng(0).integers(-most, most, (300, 4))
        assert (whitening.exact_products(d) == d.astype(object).T @ d.astype(object)).all()


# ---- 13: content sort ----

def brute_groups(rows):
    groups = {}
    for k, (doc, text) in enumerate(rows):
        groups.setdefault(re.sub("[\x20\x09-\x0d]", "", text or ""), []).append((-len(text or ""), doc is None, doc or 0, k, doc))
    out = []
    for content, members in groups.items():
        members.sort()
        out += [(m[4], members[0][4], len(members), k == 0, hashlib.sha256(content.encode()).hexdigest())
                for k, m in enumerate(members)]
    return sorted(out, key=str)


def content_texts():
    rng = random.Random(1)
    rows = []
    for i in range(1500):
        kind = rng.random()
        text = (None if kind < .02 else "" if kind < .04 else "hot text" + " \t" * rng.randrange(3) if kind < .4
                else "shared beginning " * 9 + rng.choice("ab é𝒳") * rng.randrange(4) if kind < .9 else f"one {i} ")
        rows.append((i if rng.random() > .01 else None, text))
    return rows + rows[:40] + [(5, "x" * 300_000), (6, "x" * 299_999 + " x"), (7, "x" * 300_000 + "y")]


def test_content_groups_brute_force(spark, frame):
    rows = content_texts()
    docs = frame(rows).withColumn("content", F.lit(1)).withColumn("part", F.lit(None).cast("int"))
    for tasks in (None, 1, 40):  # 40: the hot group spans partitions
        got = content_sort.content_groups(docs, tasks=tasks)
        assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
        assert sorted((tuple(r) for r in got.collect()), key=str) == brute_groups(rows)


def test_hot_group_is_split(spark, frame):
    runs = content_sort.sorted_runs(frame([(i, "copy") for i in range(4000)], False), False, 1 << 20, 20)
    sizes = [r["count"] for r in runs.groupBy("part").count().collect()]
    assert len(sizes) >= 15 and max(sizes) <= 600
    whole = content_sort.content_groups(frame([(i, "copy") for i in range(4000)], False), tasks=20)
    assert {(r.keep_id, r.group_size) for r in whole.collect()} == {(0, 4000)} and whole.where("kept").count() == 1


def test_drop_copies_keeps_rows_and_columns(spark, frame):
    rows = content_texts()
    docs = frame(rows).withColumn("content", F.lit("own")).withColumn("kept", F.col("doc_id") * 2)
    out = content_sort.drop_copies(docs, tasks=9)
    assert out.columns == docs.columns
    want = [(d, t) for d, t in rows]
    got = [(r.doc_id, r.text) for r in out.collect()]
    kept = [(d, k) for d, k, _, on, _ in brute_groups(rows) if on]
    assert len(got) == len(kept) and set(got) <= set(want)
    assert sorted((d for d, _ in got), key=str) == sorted((d for d, _ in kept), key=str)
    assert all(r.content == "own" and r.kept == (None if r.doc_id is None else 2 * r.doc_id) for r in out.collect())


def test_content_query_equals_sql_and_empty_table(spark, frame):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = queries.op13_content_sort(spark, SF)
    cols = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    sql = con.execute(f"SELECT {', '.join(cols)} FROM ({content_sort.CONTENT_GROUPS_SQL})").fetchall()
    assert sorted(tuple(r) for r in got.select(cols).collect()) == sorted(sql)
    assert content_sort.content_groups(frame([]), tasks=3).count() == 0
