"""Names of extra columns that operators use themselves, line dedup against a
plain version of its rules, and scores against plain features."""

import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loadshape.llm import content_sort, decontaminate, line_templates, quality, sentencepieces, simhash, toxicity

from .conftest import SF

CLASHES = ["hit", "fp", "root_fp", "of_fp", "component_id", "row", "__row", "data", "n_lines", "n_dropped", "of_doc", "of_text",
           "gone", "__drop", "lines", "score", "predicted", "token_ids", "parity", "round_trip", "piece", "spans", "doc", "n",
           "member", "unnamed", "pick", "block", "template"]


@pytest.fixture
def clashing(spark):
    text = "the quick brown fox jumps over the lazy dog while some other words of this document go on and on"
    rows = [(1, text), (2, text), (3, text + " with another end"), (4, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for k, name in enumerate(CLASHES):
        docs = docs.withColumn(name, F.concat(F.lit(f"{name}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("?"))))
    return docs.withColumn("n_chars", F.length("text"))


def unchanged(before, after):
    """The caller's columns of the rows that are left."""
    own = {r.doc_id: r for r in before.collect()}
    rows = after.collect()
    for r in rows:
        for name in CLASHES:
            assert r[name] == own[r.doc_id][name], name
    return rows


def test_filters_return_the_callers_columns(spark, clashing):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "with another end")], "item_id long, text string")
    for out in (quality.keep_good(clashing, quality.fit(clashing, none)), line_templates.keep_first_lines(clashing),
                simhash.keep_one_of_each(clashing), decontaminate.decontaminate(clashing, bench),
                content_sort.drop_copies(clashing)):
        assert out.columns == clashing.columns
        assert len(unchanged(clashing, out)) >= 2
    cut = {r.doc_id: r for r in decontaminate.decontaminate(clashing, bench).collect()}
    assert 3 not in cut and cut[1].n_chars == len(cut[1].text)


def test_added_columns_get_free_names(spark, clashing):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for module in (quality, toxicity):
        out = module.with_score(clashing, module.fit(clashing, none))
        rows = unchanged(clashing, out)
        assert out.columns == [*clashing.columns, "score_", "predicted_"] and all(r.score_ == 0.5 and r.predicted_ == 1 for r in rows)
    out = sentencepieces.tokenize(clashing)
    rows = unchanged(clashing, out)
    assert out.columns == [*clashing.columns, "token_ids_", "parity_", "round_trip_"]
    assert all(r.parity_ and r.round_trip_ for r in rows)
    out = line_templates.without_recurring_lines(clashing, 2)
    rows = {r.doc_id: r for r in unchanged(clashing, out)}
    assert (rows[1].n_lines_, rows[1].n_dropped_, rows[2].n_dropped_) == (1, 0, 1)


# ---- 2: ids come from the rebuilt tokenizer ----

def test_ids_are_the_backends(monkeypatch):
    codec = sentencepieces.Codec(sentencepieces.MODEL, cache_bytes=2000)

    class Liar:
        def encode(self, texts, num_threads=1):
            return [[1, 2]] * len(texts) if isinstance(texts, list) else [1, 2]

    judge, codec.judge = codec.judge, Liar()
    calls = []
    backend = codec.backend

    class Seen:
        encode = staticmethod(backend.encode)

        @staticmethod
        def encode_batch_fast(texts, **options):
            calls.append(len(texts))
            return backend.encode_batch_fast(texts, **options)

    codec.backend = Seen()
    texts = ["several words in one text", "and some more of them", None, ""]
    found = codec.encode(texts)
    assert [None if i is None else i.tolist() for i, _ in found] == [judge.encode(t) if t is not None else None for t in texts]
    assert [p for _, p in found] == [False, False, True, True] and max(calls) > 1
    for k in range(30):   # the cache is bounded by bytes
        codec.encode([f"fresh{k} words{k} of{k} text{k}"])
    assert codec.held < 4000


# ---- 8: line dedup ----

def plain_keys(line):
    """(key, documents that make it recur) of one trimmed line."""
    raw = [t for t in re.split("[ \t\r]+", line)]
    tokens = ["<*>" if re.search("[0-9]", t) else t for t in raw]
    n, field = len(tokens), "<*>"
    keys = [(("own", line), 2 if n >= line_templates.LONG_TOKENS else 5)]
    lead, rest = tuple(tokens[:3]), n - 3
    edge = [int(np.floor(rest * j / 4)) for j in range(5)]
    groups = [tuple(tokens[3 + edge[j]: 3 + max(edge[j + 1], edge[j])]) if rest > 0 else () for j in range(4)]
    for wild in range(-1, 4):
        constant = sum(t != field for t in tokens) - (sum(t != field for t in groups[wild]) if wild >= 0 else 0)
        if constant >= 4 and 2 * constant >= n and (wild < 0 or n >= 11):
            keys.append(((n, lead, wild, tuple(g for j, g in enumerate(groups) if j != wild)), 5))
    return keys


def plain_first_lines(docs):
    order = sorted(set(docs), key=lambda d: (d[0] is None, d[0] or 0, d[1] or ""))
    seen, first, need = {}, {}, {}
    cut = {d: [] for d in order}
    for d in order:
        for k, line in enumerate((d[1] or "").split("\n")):
            line = line.strip(" \t\r")
            if len(line) >= line_templates.MIN_CHARS:
                for key, least in plain_keys(line):
                    cut[d].append((k, key))
                    seen.setdefault(key, set()).add(d)
                    first.setdefault(key, d)
                    need[key] = least
    out = {}
    for d in order:
        gone = {k for k, key in cut[d] if len(seen[key]) >= need[key] and first[key] != d}
        left = [line for k, line in enumerate((d[1] or "").split("\n")) if k not in gone]
        if not gone:
            out[d] = d[1]
        elif any(len(x.strip(" \t\r")) >= line_templates.MIN_CHARS for x in left):
            out[d] = "\n".join(left)
    return out


def test_unique_lines_of_numbers_stay(spark, frame):
    numbers = [" ".join(str(1000 + 17 * i * j) for j in range(1, 5)) for i in range(1, 9)]
    docs = [(i, f"an introduction of its own, number {w}\n{x}") for i, (x, w) in enumerate(zip(numbers, "abcdefgh"))]
    out = {r.doc_id: r.text for r in line_templates.keep_first_lines(frame(docs)).collect()}
    assert all(numbers[i] in out[i] for i in out) and len(out) == 8
    only = [(i, x) for i, x in enumerate(numbers)]
    assert {r.doc_id: r.text for r in line_templates.keep_first_lines(frame(only)).collect()} == dict(only)
    same = [(i, numbers[0] + "\nown words of document " + "abcdefgh"[i] * 4) for i in range(8)]
    out = {r.doc_id: r.text for r in line_templates.keep_first_lines(frame(same)).collect()}
    assert numbers[0] in out[0] and not any(numbers[0] in out[i] for i in range(1, 8))


def test_long_equal_lines_and_short_ones(spark, frame):
    long = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80))
    docs = [(i, f"own beginning of text {'abcd'[i]}{'wxyz'[i]}\n{long}") for i in range(4)]
    docs += [(10 + i, f"Terms of use\nok\nanother text {'pqrstu'[i] * 5} here") for i in range(6)]
    out = {r.doc_id: r.text for r in line_templates.keep_first_lines(frame(docs)).collect()}
    assert long in out[0] and all(long not in out[i] and "own beginning" in out[i] for i in (1, 2, 3))
    assert "Terms" in out[10] and all("Terms" not in out[i] and "ok" in out[i] for i in range(11, 16))


def test_line_stage_equals_plain_rules(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.line_dedup(spark, docs, SF)
    assert out.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    line = "This very notice stands at the end of pages, see chapter {} of {} for all of its details and more words"
    rows += [(10_000 + i, f"text {'abcdefghij'[i] * 6}\n{line.format(i, 'abcdefghij'[i] * 3)}\n{line.format(i, 'x')}") for i in range(9)]
    more = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.text) for r in line_templates.keep_first_lines(more).collect())
    plain = plain_first_lines(rows)
    assert got == Counter((d[0], plain[d]) for d in rows if d in plain)
    assert {r.doc_id: len(r.text) for r in out.where("text is not null").collect()} == {
        r.doc_id: r.n_chars for r in out.where("text is not null").collect()}


def test_lines_of_one_text_take_linear_time(spark, frame):
    took = []
    for n in (20_000, 80_000):
        text = "\n".join(f"line of words number {k} and more {k % 7}" for k in range(n))
        docs = frame([(1, text), (2, text)], False)
        start = time.time()
        rows = line_templates.line_report(docs).collect()
        took.append(time.time() - start)
        assert [r.n_lines for r in rows] == [n, n]
    assert took[1] < 8 * took[0] + 5


# ---- 6: the score, from plain features ----

def plain_score(text, table, intercept, bits):
    mask, mix, step = 2 ** 32 - 1, 2654435761, 16777619
    bucket = lambda v: (v * mix & mask) >> (32 - bits)
    sound = lambda c: (c * mix & mask) ^ (c >> 3)

    def rolled(chars):
        h = sound(ord(chars[0]))
        for c in chars[1:]:
            h = (h * step & mask) ^ sound(ord(c))
        return h

    found = [bucket(rolled(text[i:i + n]) + n & mask) for n in (3, 4) for i in range(len(text) - n + 1) if "\0" not in text[i:i + n]]
    before = None
    for word in re.findall(r"[^\x00-\x20]+", text):
        h = sum(sound(ord(c)) * pow(step, k, 2 ** 32) for k, c in enumerate(word)) & mask
        found.append(bucket(h))
        if h == before:
            found.append(0)
        before = h
    return intercept + (sum(float(table[b]) for b in found) / len(found) if found else 0.0)


def test_quality_score_equals_plain_features():
    rng = np.random.default_rng(1)
    table = rng.normal(size=1 << 12).astype(np.float32)
    texts = ["", "a", "ab ab ab  xyz", "Der Text, the text\n\nкот 日本語 𝒳", "x" * 500, "one\0two two", "tab\tand  é é"]
    texts += ["".join(rng.choice(list("ab cd\n é"), 60)) for _ in range(40)]
    got = quality.log_odds(texts, table, 0.25)
    assert got == pytest.approx([plain_score(t, table, 0.25, 12) for t in texts], abs=1e-6)
    assert quality.log_odds([None], table, 0.25).tolist() == [0.25]


# ---- 10: the score, from plain edit distances ----

def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def plain_edits(word, lexicon):
    found = []
    for term, stem in lexicon.terms:
        most = 0 if len(term) < 5 else 1 if len(term) < 9 else 2
        d = min(distance(word[:n], term) for n in range(len(word) + 1)) if stem else distance(word, term)
        found += [d] if d <= most else []
    best = min(found, default=None)
    return None if best and word in lexicon.benign else best


def plain_toxicity(text, model):
    low, lexicon, out = (text or "").lower(), model.lexicon, np.zeros(8)
    spans = list(re.finditer(r"[^\W_]+", low))
    words = [m[0] for m in spans]
    hits = [(k, e) for k, w in enumerate(words) if (e := plain_edits(w, lexicon)) is not None]
    for k, e in hits:
        near, before = set(words[max(0, k - 6): k + 7]), set(words[max(0, k - 6): k])
        left, right = low[max(0, spans[k].start() - 2): spans[k].start()], low[spans[k].end(): spans[k].end() + 2]
        marks = any(q in left for q in toxicity.QUOTES) and any(q in right for q in toxicity.QUOTES)
        quoted = marks or bool(before & toxicity.REPORTING)
        out[2 * quoted + (e > 0)] += 1
        out[4] += bool(near & toxicity.ADDRESS) and not quoted
    if hits:
        out[5], out[6], out[7] = min(len(hits) / len(words) * 20, 3.0), out[0] > 0, out[0] + out[1] > 0
        out[:5] = np.log1p(out[:5])
    return 1 / (1 + np.exp(-(out @ model.weights[:-1] + model.weights[-1])))


def test_toxicity_score_equals_plain_distances(spark):
    rng = np.random.default_rng(9)
    lexicon = toxicity.Lexicon([("scumbag", True), ("vile", False), ("worthless", False), ("idiot", True)], {"idiom"})
    model = toxicity.Model(lexicon, rng.normal(size=9))
    pool = ["you", "scumbag", "scumbags", "scambag", "vile", "vila", "worthles", "wortless", "wrthles", "idiot", "idiotic", "idiom",
            "he", "said", '"idiot"', "«vile»", "fine", "words", "dich", "x" * 40, "É1", "a_b"]
    texts = [None, "", "   ", *[" ".join(rng.choice(pool, rng.integers(1, 40))) for _ in range(120)]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = toxicity.with_score(docs, model).orderBy("doc_id").collect()
    want = [plain_toxicity(t, model) for t in texts]
    assert [r.score for r in rows] == pytest.approx(want, abs=1e-12)
    assert [r.predicted for r in rows] == [int(v >= 0.5) for v in want]


def test_words_learned_together_or_again_have_their_own_ids():
    """Words met again outlive a full cache, and new ones are encoded several to a text."""
    codec = sentencepieces.Codec(sentencepieces.MODEL, cache_bytes=60_000)
    asked = []
    plain = codec._encode
    codec._encode = lambda texts: (asked.append(list(texts)), plain(texts))[1]
    texts = [f"common wörter {'x' * (k % 5)}  two{k} ▁mark{k} 日本{k}\t<0x41>\n{k * 7919} ​ a▁▁b{k} " for k in range(600)]
    for text in texts:
        (ids, same), = codec.encode([text])
        assert ids.tolist() == codec.backend.encode(text, add_special_tokens=False).ids
        assert same == (ids.tolist() == codec.judge.encode(text))
    assert codec.held < 60_000 and codec.older
    sent = [t for texts in asked for t in texts]
    assert sum("common" in t for t in sent) == 1 and any(" " in t for t in sent)
