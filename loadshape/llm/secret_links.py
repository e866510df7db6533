"""Secret scan with multipart credential linking, in DataFrame functions only.

Base findings (assignments, access identifiers, hex runs) are reported as they
are. Weak candidates (short assigned values, short access or user identifiers,
short hex runs, bare 40-character tokens, endpoints) are only reported if
complementary parts lie within ``SCOPE`` code points in the same text:

* a weak secret needs an identifier or an endpoint,
* a weak identifier needs a secret,
* an endpoint needs an identifier and a secret.

Matches of one kind come from ``regexp_extract_all`` and ``split`` on the same
pattern: the text between matches and the matches alternate, so running sums
of their lengths are the positions. The interval join puts parts into buckets
of ``SCOPE`` code points and keeps the first start and last end per (row,
class, bucket): that decides co-occurrence exactly and no pair is ever listed.
The text is scanned once and never shuffled.

Edge cases: null and empty texts have no spans; repeated rows repeat; a null
doc_id stays null; other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from loadshape.llm.shared import write_shared

SCOPE = 200

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]{16,}"
BARE = "[A-Za-z0-9+/]{40,}"
USER = r"""(?i)(username|user|login|client_?id|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@+/_.-]+"""
ENDPOINT = r"""(https?|wss?|ftp|ssh|postgres|postgresql|mysql|mongodb|redis|amqps?|s3)://[^\x00-\x20"'<>]+"""

#: kind, pattern, cheap test that any text with a match passes
KINDS = [
    ("assign", ASSIGN, ["passw", "secret", "token", "api"]),
    ("access", ACCESS, ["akia"]),
    ("hex", HEX, None),
    ("bare", BARE, None),
    ("user", USER, ["user", "login", "client", "account"]),
    ("endpoint", ENDPOINT, ["://"]),
]
ORDER = [k for k, *_ in KINDS]
IDENTIFIER, SECRET, PLACE = "identifier", "secret", "endpoint"

PART = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("i", T.IntegerType()), T.StructField("gap", T.IntegerType()),
    T.StructField("len", T.IntegerType()), T.StructField("value_len", T.IntegerType())]))


def kind_parts(kind: str, pattern: str, hints: list[str] | None) -> Column:
    """All matches of one kind with the length of the text before each."""
    text, low = F.col("text"), F.col("low")
    if hints:
        maybe = F.lit(False)
        for h in hints:
            maybe = maybe | F.contains(low, F.lit(h))
    else:
        maybe = text.rlike(pattern)
    gaps = F.split(text, pattern, -1)
    value = (lambda m: F.length(F.regexp_extract(m, pattern, 2))) if kind == "assign" else F.length
    found = F.transform(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda m, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.length(F.get(gaps, i)).alias("gap"),
                              F.length(m).alias("len"), value(m).alias("value_len")))
    return F.when(maybe, found).otherwise(F.array().cast(PART))


def located_parts(rows: DataFrame) -> DataFrame:
    """(rid, kind, start, end, value_len) of every match."""
    each = rows.select("rid", F.explode("parts").alias("p")).select("rid", "p.*")
    before = Window.partitionBy("rid", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("len")).over(before)
    return each.withColumn("end", end).select("rid", "kind", (F.col("end") - F.col("len")).alias("start"), "end", "value_len")


def graded(parts: DataFrame) -> DataFrame:
    """Add class and ``weak``; matches too short for either are dropped."""
    kind, size = F.col("kind"), F.col("value_len")
    strong = ((kind == "assign") & (size >= 8)) | ((kind == "access") & (size >= 16)) | ((kind == "hex") & (size >= 32))
    weak = (((kind == "assign") & size.between(4, 7)) | ((kind == "access") & size.between(12, 15))
            | ((kind == "hex") & size.between(16, 31)) | ((kind == "bare") & (size == 40)) | kind.isin("user", "endpoint"))
    of = (F.when(kind.isin("access", "user"), IDENTIFIER).when(kind == "endpoint", PLACE).otherwise(SECRET))
    return parts.where(strong | weak).withColumn("weak", weak).withColumn("class", of)


def near_classes(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Weak parts with the set of the classes that lie within ``scope``."""
    buckets = F.sequence(F.floor(F.col("start") / scope), F.floor((F.col("end") - 1) / scope))
    there = (
        parts.withColumn("bucket", F.explode(buckets))
        .groupBy("rid", "bucket", "class")
        .agg(F.min("start").alias("least_start"), F.max("end").alias("most_end"))
        .select(F.col("rid").alias("of_rid"), F.col("bucket").alias("of_bucket"), F.col("class").alias("near"),
                "least_start", "most_end")
    )
    reach = parts.where("weak").select(
        "rid", "kind", "start", "end",
        F.explode(F.sequence(F.floor(F.greatest(F.col("start") - scope, F.lit(0)) / scope),
                             F.floor((F.col("end") + scope) / scope))).alias("bucket"))
    close = (F.col("least_start") <= F.col("end") + scope) & (F.col("most_end") >= F.col("start") - scope)
    return (
        reach.join(there, (reach.rid == there.of_rid) & (reach.bucket == there.of_bucket) & close)
        .groupBy("rid", "kind", "start", "end").agg(F.collect_set("near").alias("near"))
    )


def linked(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The weak parts that complementary parts support."""
    has = {c: F.array_contains("near", c) for c in (IDENTIFIER, SECRET, PLACE)}
    kind = F.col("kind")
    support = (
        F.when(kind.isin("access", "user"), has[SECRET])
        .when(kind == "endpoint", has[IDENTIFIER] & has[SECRET])
        .otherwise(has[IDENTIFIER] | has[PLACE]))
    return near_classes(parts, scope).where(support).select("rid", "kind", "start", "end", F.lit(True).alias("weak"))


def find_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Per row of ``docs``: doc_id, counts of base findings, ``base`` and
    ``all_spans``: arrays of (start, kind number, kind, end) in order."""
    low = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("low", F.lower("text"))
    rows = write_shared(
        low.select("doc_id", F.monotonically_increasing_id().alias("rid"),
                   F.concat(*[kind_parts(*k) for k in KINDS]).alias("parts")), "secret-parts")
    parts = write_shared(graded(located_parts(rows)), "secret-spans")
    strong = parts.where("not weak").select("rid", "kind", "start", "end", "weak")
    number = F.array_position(F.lit(ORDER), F.col("kind"))
    span = F.struct("start", number.alias("kind_no"), "kind", "end")
    spans = strong.unionByName(linked(parts, scope)).groupBy("rid").agg(
        F.array_sort(F.collect_list(F.when(~F.col("weak"), span))).alias("base"),
        F.array_sort(F.collect_list(span)).alias("all_spans"))
    return rows.select("rid", "doc_id").join(spans, "rid", "left").drop("rid")


def secret_report(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    found = find_secrets(docs, scope)

    def text_of(name: str) -> Column:
        one = F.transform(name, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
        return F.coalesce(F.array_join(one, ","), F.lit(""))

    def count(kind: str) -> Column:
        return F.coalesce(F.size(F.filter("base", lambda s: s["kind"] == kind)), F.lit(0)).cast("long")

    return found.withColumn("base", F.coalesce("base", F.array().cast(found.schema["base"].dataType))).select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(text_of("base"), 256).alias("base_sha256"), text_of("all_spans").alias("spans"))


def _ascii_folded(pattern: str) -> str:
    """Letters of either case as classes: DuckDB's (?i) also folds letters
    beyond ASCII (long s, Kelvin sign), Java's doesn't."""
    if not pattern.startswith("(?i)"):
        return pattern
    one = lambda m: m[0] if len(m[0]) > 1 else f"[{m[0].upper()}{m[0]}]"
    return re.sub(r"\\x[0-9A-F]{2}|\[[^\]]*\]|[a-z]", one, pattern[4:])


def _matches_sql(kind: str, pattern: str) -> str:
    quoted = _ascii_folded(pattern).replace("'", "''")
    group = f"len(regexp_extract(m[i], '{quoted}', 2))" if kind == "assign" else "len(m[i])"
    return f"""SELECT rid, '{kind}' AS kind, {ORDER.index(kind) + 1} AS kind_no,
      CAST(list_sum(list_transform(g[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: len(x))), 0) AS BIGINT) AS s,
      len(m[i]) AS size, {group} AS v
    FROM (SELECT rid, m, g, unnest(generate_series(1, len(m))) AS i FROM (
      SELECT rid, regexp_extract_all(text, '{quoted}') AS m, string_split_regex(text, '{quoted}') AS g FROM docs))"""


#: DuckDB twin of ``secret_report``.
SECRET_REPORT_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
matches AS ({' UNION ALL '.join(_matches_sql(k, p) for k, p, _ in KINDS)}),
parts AS (
  SELECT rid, kind, kind_no, s, s + size AS e,
    CASE WHEN kind IN ('access', 'user') THEN 'identifier' WHEN kind = 'endpoint' THEN 'endpoint' ELSE 'secret' END AS class,
    (kind = 'assign' AND v >= 8) OR (kind = 'access' AND v >= 16) OR (kind = 'hex' AND v >= 32) AS strong,
    (kind = 'assign' AND v BETWEEN 4 AND 7) OR (kind = 'access' AND v BETWEEN 12 AND 15) OR (kind = 'hex' AND v BETWEEN 16 AND 31)
      OR (kind = 'bare' AND v = 40) OR kind IN ('user', 'endpoint') AS weak
  FROM matches),
near AS (
  SELECT w.rid, w.kind, w.kind_no, w.s, w.e, bool_or(p.class = 'identifier') AS id, bool_or(p.class = 'secret') AS sec, bool_or(p.class = 'endpoint') AS place
  FROM parts w JOIN parts p ON w.rid = p.rid AND (p.strong OR p.weak) AND p.s <= w.e + {SCOPE} AND p.e >= w.s - {SCOPE}
  WHERE w.weak GROUP BY ALL),
spans AS (
  SELECT rid, kind, kind_no, s, e, true AS base FROM parts WHERE strong
  UNION ALL
  SELECT rid, kind, kind_no, s, e, false FROM near
  WHERE CASE WHEN kind IN ('access', 'user') THEN sec WHEN kind = 'endpoint' THEN id AND sec ELSE id OR place END),
per_doc AS (
  SELECT rid, count(*) FILTER (base AND kind = 'assign') AS n_assign, count(*) FILTER (base AND kind = 'access') AS n_access,
    count(*) FILTER (base AND kind = 'hex') AS n_hex,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, kind_no) FILTER (base) AS base,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, kind_no) AS spans
  FROM spans GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN per_doc USING (rid)
"""
