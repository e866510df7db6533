"""Line dedup by a log-template tree, in DataFrame functions only.

A line's tokens (runs of characters other than space, tab and carriage return)
are masked: a token with a digit is a variable field. Parsing has a fixed
depth: a leaf is the token count and the first ``DEPTH`` masked tokens. Below
its leaf a line has one exact template and, from ``MIN_WILD`` further tokens
on, ``GROUPS`` generalised ones, in each of which one run of a quarter of the
tokens is a variable field. A template needs constant tokens: at least
``MIN_CONSTANT`` and half of the line; lines without them, such as rows of
numbers, are compared as they stand. Beside its templates every line also has
its own trimmed text as a key.

What recurs in ``min_docs`` documents or more is boilerplate, and so is an equal
line of ``LONG_TOKENS`` tokens or more in two documents: such lines are dropped
from every document but the first (the smallest doc_id, nulls last), so no
content is lost altogether.

Lines are hashed in the scan, only hashes are shuffled; lines of leaves that
too few lines share never get templates; counts are combined on the map side,
joins on template and leaf have a unique side and are split where skewed. A
text's lines are cut once and its kept lines put together from slices, so the
work is linear in the lines of a text.

Edge cases: null text has no lines and stays null; lines of fewer than
``MIN_CHARS`` characters without their blanks at the ends are never dropped;
rows equal in doc_id and text count as one document and are treated alike; a
repeated line counts once per document; null doc_ids are documents of their own
text; other columns pass, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadshape.llm.shared import free_name, packed_rows, unpacked, write_shared

DEPTH = 3
GROUPS = 4
MIN_CHARS = 12
MIN_CONSTANT = 4
MIN_WILD = 8
MIN_DOCS = 5
LONG_TOKENS = 30
FIELD = "<*>"


def masked_tokens(line: Column) -> Column:
    masked = F.when(line.rlike("[0-9]"), F.regexp_replace(line, "[^ \t\r]*[0-9][^ \t\r]*", FIELD)).otherwise(line)
    return F.split(masked, "[ \t\r]+")


def constants(tokens: Column) -> Column:
    return F.size(F.array_remove(tokens, FIELD))


def hashed_lines(lines: DataFrame) -> DataFrame:
    """Trimmed lines (doc, line_no, line) as their own hash, leaf and group
    hashes, the token count ``n``, and the constants of the line and its groups.
    Tokens and groups are columns of a projection before, so that each is
    formed once."""
    rest = F.size("tokens") - DEPTH
    edge = [F.floor(rest * j / GROUPS).cast("int") for j in range(GROUPS + 1)]
    cut = lines.select("doc", "line_no", F.xxhash64("line").alias("own"), masked_tokens(F.col("line")).alias("tokens")).select(
        "doc", "line_no", "own", "tokens", *[
            F.slice("tokens", edge[j] + DEPTH + 1, F.greatest(edge[j + 1] - edge[j], F.lit(0))).alias(f"group{j}")
            for j in range(GROUPS)])
    groups = [F.col(f"group{j}") for j in range(GROUPS)]
    return cut.select(
        "doc", "line_no", "own", F.size("tokens").alias("n"),
        F.xxhash64(F.size("tokens"), F.slice("tokens", 1, DEPTH)).alias("leaf"),
        F.array(*[F.xxhash64(F.lit(j), g) for j, g in enumerate(groups)]).alias("groups"),
        constants(F.col("tokens")).alias("n_constant"), F.array(*[constants(g) for g in groups]).alias("group_constants"))


def enough(constant: Column) -> Column:
    return (constant >= MIN_CONSTANT) & (2 * constant >= F.col("n"))


def template_keys() -> Column:
    """The exact template of (leaf, groups), and the generalised ones, as far
    as they have constant tokens enough."""
    keys = [F.when(enough(F.col("n_constant")), F.xxhash64(F.lit(-1), "leaf", "groups"))]
    for j in range(GROUPS):
        others = F.array(*[F.col("groups")[k] for k in range(GROUPS) if k != j])
        constant = F.col("n_constant") - F.col("group_constants")[j]
        keys.append(F.when((F.col("n") >= DEPTH + MIN_WILD) & enough(constant), F.xxhash64(F.lit(j), "leaf", others)))
    return F.array_compact(F.array(*keys))


def document_key() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id"), F.xxhash64("text").alias("text_hash"))


def dropped_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, text_hash, lines): the numbers, from 0 and rising, of the lines to drop."""
    cut = docs.where("text IS NOT NULL").select(document_key().alias("doc"), F.split("text", "\n").alias("lines"))
    lines = (
        cut.select("doc", F.posexplode_outer("lines").alias("line_no", "line"))
        .select("doc", "line_no", F.btrim("line", F.lit(" \t\r")).alias("line")).where(F.length("line") >= MIN_CHARS)
    )
    lines = write_shared(hashed_lines(lines), "lines")
    leaves = write_shared(
        lines.groupBy("leaf").agg(F.count(F.lit(1)).alias("n_lines")).where(F.col("n_lines") >= min_docs)
        .select(F.col("leaf").alias("of_leaf")), "line-leaves")
    texts = write_shared(
        lines.groupBy("own").agg(F.count(F.lit(1)).alias("n_lines"), F.max("n").alias("n"))
        .where(F.col("n_lines") >= F.when(F.col("n") >= LONG_TOKENS, 2).otherwise(min_docs))
        .select(F.col("own").alias("of_own")), "line-texts")
    of_leaves = lines.join(leaves, lines.leaf == leaves.of_leaf, "left_semi") \
                     .select("doc", "line_no", F.lit(min_docs).alias("need"), F.explode(template_keys()).alias("template"))
    alike = lines.join(texts, lines.own == texts.of_own, "left_semi").select(
        "doc", "line_no", F.when(F.col("n") >= LONG_TOKENS, F.least(F.lit(2), F.lit(min_docs))).otherwise(min_docs).alias("need"),
        F.xxhash64(F.lit(-2), "own").alias("template"))
    keyed = write_shared(of_leaves.unionByName(alike), "line-templates")
    recurring = write_shared(
        keyed.select("doc", "template", "need").distinct()
        .groupBy("template").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc").alias("first"), F.min("need").alias("need"))
        .where(F.col("n_docs") >= F.col("need")).select(F.col("template").alias("of_template"), "first"), "line-recurring")
    hit = (
        keyed.join(recurring, (keyed.template == recurring.of_template) & ~F.col("doc").eqNullSafe(F.col("first")))
        .select("doc", "line_no").distinct()
    )
    return hit.groupBy("doc").agg(F.array_sort(F.collect_set("line_no")).alias("lines")).select(
        F.col("doc.doc_id").alias("doc_id"), F.col("doc.text_hash").alias("text_hash"), "lines")


def kept_lines(lines: Column, gone: Column) -> Column:
    """``lines`` without the numbers ``gone`` (from 0, rising): the slices between them."""
    after = lambda j: F.when(j == 0, F.lit(0)).otherwise(F.get(gone, j - 1) + 1)
    upto = lambda j: F.coalesce(F.get(gone, j), F.size(lines))
    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(gone)), lambda j: F.slice(lines, after(j) + 1, upto(j) - after(j))))


def cut_rows(docs: DataFrame, min_docs: int) -> DataFrame:
    """Rows of ``docs`` (``data``) with the remaining ``text``, ``n_lines`` and ``n_dropped``."""
    drops = dropped_lines(docs.select("doc_id", "text"), min_docs).select(
        F.col("doc_id").alias("of_doc"), F.col("text_hash").alias("of_text"), F.col("lines").alias("gone"))
    rows = packed_rows(docs)
    out = rows.join(drops, F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.xxhash64("text") == F.col("of_text")), "left")
    lines = F.split("text", "\n")
    return out.select(
        "data", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept_lines(lines, F.col("gone")), "\n")).alias("text"),
        F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_dropped"))


def without_recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with the recurring lines cut out of ``text``, and ``n_lines``
    and ``n_dropped``."""
    fields = [F.col("text") if c == "text" else F.col("data")[c].alias(c) for c in docs.columns]
    return cut_rows(docs, min_docs).select(*fields, *[F.col(c).alias(free_name(docs, c)) for c in ("n_lines", "n_dropped")])


def keep_first_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` without recurring lines; a document that loses lines and has
    none of ``MIN_CHARS`` characters left goes."""
    lines_left = F.exists(F.split("text", "\n"), lambda line: F.length(F.btrim(line, F.lit(" \t\r"))) >= MIN_CHARS)
    out = cut_rows(docs, min_docs).where((F.col("n_dropped") == 0) | lines_left)
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        own = F.col("data")["n_chars"]
        changed["n_chars"] = F.when(F.col("n_dropped") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(own)
    return unpacked(out, docs.columns, changed)


def line_report(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """Per document: line counts and the digest of the remaining text."""
    return without_recurring_lines(docs.select("doc_id", "text"), min_docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


#: DuckDB twin of ``line_report``: whole strings instead of hashes.
LINE_REPORT_SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, text,
         dense_rank() OVER (ORDER BY doc_id IS NULL, doc_id, text) AS doc
  FROM documents),
lines AS (
  SELECT DISTINCT doc, line_no, lines[line_no] AS line
  FROM (SELECT doc, string_split(text, chr(10)) AS lines, unnest(generate_series(1, len(string_split(text, chr(10))))) AS line_no
        FROM docs WHERE text IS NOT NULL)),
trimmed AS (
  SELECT doc, line_no, trim(line, ' ' || chr(9) || chr(13)) AS line FROM lines
  WHERE length(trim(line, ' ' || chr(9) || chr(13))) >= {MIN_CHARS}),
parsed AS (
  SELECT doc, line_no, line, string_split_regex(
    regexp_replace(line, '[^ \\t\\r]*[0-9][^ \\t\\r]*', '{FIELD}', 'g'), '[ \\t\\r]+') AS t
  FROM trimmed),
cut AS (
  SELECT doc, line_no, line, len(t) AS n, len(list_filter(t, lambda x: x <> '{FIELD}')) AS n_constant,
         t[1:{DEPTH}] AS lead, list_transform(range(0, {GROUPS}), lambda j:
    t[CAST({DEPTH} + 1 + (len(t) - {DEPTH}) * j // {GROUPS} AS BIGINT) : CAST({DEPTH} + (len(t) - {DEPTH}) * (j + 1) // {GROUPS} AS BIGINT)]) AS g
  FROM parsed),
wild AS (
  SELECT *, n_constant - CASE WHEN w < 0 THEN 0 ELSE len(list_filter(g[w + 1], lambda x: x <> '{FIELD}')) END AS constant
  FROM (SELECT *, unnest(CASE WHEN n >= {DEPTH + MIN_WILD} THEN range(-1, {GROUPS}) ELSE [CAST(-1 AS BIGINT)] END) AS w FROM cut)),
keyed AS (
  SELECT doc, line_no, n, lead, w, list_filter(list_transform(range(0, {GROUPS}), lambda j:
    CASE WHEN j = w THEN NULL ELSE g[j + 1] END), lambda x: x IS NOT NULL) AS rest, {MIN_DOCS} AS need
  FROM wild WHERE constant >= {MIN_CONSTANT} AND 2 * constant >= n
  UNION ALL
  SELECT doc, line_no, n, [line], -2, [], CASE WHEN n >= {LONG_TOKENS} THEN 2 ELSE {MIN_DOCS} END FROM cut),
recurring AS (
  SELECT n, lead, w, rest, min(doc) AS first FROM keyed GROUP BY n, lead, w, rest HAVING count(DISTINCT doc) >= min(need)),
dropped AS (
  SELECT DISTINCT k.doc, k.line_no FROM keyed k JOIN recurring r USING (n, lead, w, rest) WHERE k.doc <> r.first),
per_doc AS (SELECT doc, list(line_no) AS gone FROM dropped GROUP BY doc)
SELECT d.doc_id,
       CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END AS n_lines,
       coalesce(len(gone), 0) AS n_dropped,
       sha256(coalesce(CASE WHEN gone IS NULL THEN text ELSE
         array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: NOT list_contains(gone, i)), chr(10)) END, '')) AS kept_sha256
FROM docs d LEFT JOIN per_doc USING (doc)
"""
