"""Each numbered operator against a brute-force version, and its edge cases:
nulls, empty and very long texts, ties, repeated rows, empty tables, clashing
extra columns."""

import hashlib
import re

import duckdb
import numpy as np
import pytest
import xxhash

from loadshape.llm import (
    decontaminate,
    earlier_copies,
    line_templates,
    personal_data,
    pivot_index,
    quality,
    queries,
    secret_links,
    sentencepieces,
    simhash,
    toxicity,
)
from loadshape.llm.shared import components, local_components

from .conftest import SF

EDGE = [(1, None), (2, ""), (None, "the end"), (3, "same words here"), (3, "same words here"), (4, "x" * 200_000),
        (5, "\x00   é 𝒳"), (None, None), (6, "a b c d e f " * 3000)]


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


# ---- 1: decontamination ----

def brute_hits(text, items, window=13):
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    doc = words(text)
    covered, found = np.zeros(len(doc), bool), set()
    for item, t in items:
        w = words(t)
        k = min(window, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            for j in range(len(doc) - k + 1):
                if doc[j:j + k] == w[i:i + k]:
                    covered[j:j + k] = True
                    found.add(item)
    return len(doc), int(covered.sum()), len(found), sha(",".join(sorted(map(str, found))))


def test_decontamination_brute_force(spark, frame):
    rng = np.random.default_rng(0)
    pool = ["ab", "cd", "É1", "x9", "zz"]
    items = [(i, " ".join(rng.choice(pool, n))) for i, n in enumerate([1, 3, 13, 14, 20, 30])] + [(7, ""), (8, None)]
    docs = [(i, " ".join(rng.choice([*pool, "Other"], rng.integers(0, 60)))) for i in range(40)]
    docs += [(99, f"Start, {items[4][1].upper()}! end {items[5][1]}"), *EDGE]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block_words in (decontaminate.BLOCK_WORDS, 20):
        hits = decontaminate.find_contamination(frame(docs, False), bench, block_words=block_words)
        got = [tuple(r)[1:] for r in decontaminate.contamination_report(hits).collect()]
        for (_, text), row in zip(docs, got):
            n, hit, m, digest = brute_hits(text, items)
            assert row == (n, hit, m, digest, hit > 0 and 20 * hit >= n)


def test_decontamination_cuts_and_drops(spark, frame):
    passage = " ".join(f"w{i}" for i in range(20))
    filler = " ".join(f"f{i}" for i in range(600))
    docs = frame([(1, f"{filler} {passage}. {filler}"), (2, passage), (3, filler), (4, None)])
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    out = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, bench).collect()}
    assert out == {1: f"{filler} . {filler}", 3: filler, 4: None}
    empty = decontaminate.decontaminate(docs, bench.limit(0))
    assert empty.count() == 4 and empty.columns == docs.columns


# ---- 2: SentencePiece ----

def test_sentencepiece_parity_and_round_trip(spark, frame):
    docs = EDGE + [(7, " lead"), (8, "trail "), (9, "two  spaces\n\tand tab"), (10, "日本語 кот ▁mark")]
    codec = sentencepieces.codec(sentencepieces.MODEL)
    rows = sentencepieces.tokenize(frame(docs)).collect()
    for (_, text), r in zip(docs, rows):
        assert (r.token_ids is None) == (text is None)
        if text is not None:
            assert r.token_ids == codec.judge.encode(text)
            assert r.parity
    back = spark.createDataFrame([(r.token_ids,) for r in rows], "ids array<int>")
    texts = [r.t for r in back.select(sentencepieces.decoded(back.ids).alias("t")).collect()]
    assert texts == [t if t is None else t.replace("▁", " ") for _, t in docs]
    assert all(r.round_trip and r.parity for r in queries.op2_sentencepiece(spark, SF).collect())


def test_piece_model_unigram_scores():
    def field(n, data):
        return bytes([n << 3 | 2, len(data)]) + data
    pieces = [("<unk>", 0.0, 2), ("▁a", -1.0, 1), ("b", -2.0, 1), ("▁ab", -1.5, 1)]
    data = b"".join(field(1, field(1, p.encode()) + b"\x15" + np.float32(s).tobytes() + bytes([0x18, t])) for p, s, t in pieces)
    from loadshape.llm.piece_model import PieceModel
    model = PieceModel.read(data + field(2, bytes([3 << 3, 1])) + field(3, bytes([4 << 3, 0])))
    assert model.kind == 1 and model.scores[3] == -1.5
    assert model.tokenizer().encode("ab a").ids == [3, 1]


# ---- 3: suffix-array dedup ----

def brute_copies(docs, length=50):
    data = [(d, (t or "").encode()) for d, t in docs]
    first = {}
    for d, b in data:
        for p in range(len(b) - length + 1) if d is not None else ():
            k = b[p:p + length]
            first[k] = min(first.get(k, d), d)
    out = []
    for d, b in data:
        cut = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1) if d is not None else ():
            if first[b[p:p + length]] < d:
                cut[p:p + length] = True
        kept = np.frombuffer(b, np.uint8)[~cut].tobytes()
        out.append((d, len(b), int(cut.sum()), len(earlier_copies.spans_of(cut)), sha(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_bytes", [2000, 1 << 20])
def test_suffix_dedup_brute_force(spark, frame, block_bytes, monkeypatch):
    rng = np.random.default_rng(1)
    word = lambda n: "".join(rng.choice(list("abé "), n))
    passage, whole = word(120), word(300)
    docs = [(int(i), word(60) + (passage[rng.integers(0, 40):] if i % 3 else "") + word(80)) for i in rng.permutation(30)]
    docs += [(40, whole), (41, whole), (42, whole[1:]), (43, "ab" * 400), (44, "ab" * 300), (45, "ab" * 10), (3, passage),
             (None, passage), *[e for e in EDGE if not e[1] or len(e[1]) < 1000]]
    monkeypatch.setattr(earlier_copies.earlier_copies, "__defaults__", (block_bytes, 500))
    got = sorted((tuple(r) for r in earlier_copies.copy_report(frame(docs)).collect()), key=str)
    assert got == brute_copies(docs)


@pytest.mark.parametrize("hot_texts", [0, 3])
def test_suffix_dedup_hot_owners_brute_force(spark, frame, hot_texts, monkeypatch):
    rng = np.random.default_rng(8)
    word = lambda n: "".join(rng.choice(list("abé "), n))
    passage = word(90)
    docs = [(int(i), word(60) + passage[rng.integers(0, 30):] + word(70)) for i in rng.permutation(30)]
    docs += [(40, "ab" * 400), (41, "ab" * 300), (3, passage), (None, passage), (50, docs[0][1])]
    monkeypatch.setattr(earlier_copies.earlier_copies, "__defaults__", (2000, 500))
    monkeypatch.setattr(earlier_copies.earlier_copies, "__kwdefaults__", {"hot_texts": hot_texts})
    got = sorted((tuple(r) for r in earlier_copies.copy_report(frame(docs)).collect()), key=str)
    assert got == brute_copies(docs)


def test_suffix_dedup_spreads_a_hot_passage(spark, frame):
    rng = np.random.default_rng(9)
    word = lambda n: "".join(rng.choice(list("abcdefghijklmnop"), n))
    passage = word(50)
    blocks = earlier_copies.pack_blocks(frame([(i, word(40) + passage + word(40)) for i in range(400)]), 4000, 4)
    blocks = blocks.join(earlier_copies.repeated_texts(blocks), "block", "left")
    most = {}
    for hot_texts in (10 ** 9, 50):
        owners = earlier_copies.shared_owners(blocks, 16, 4, hot_texts)
        windows = np.zeros(16)
        for r in earlier_copies.sent_texts(blocks.join(owners, "block", "left"), 16).where("shard >= 0").collect():
            windows[r.shard] += (earlier_copies.unpacked(r.sizes, np.int32) - earlier_copies.LENGTH + 1).sum()
        most[hot_texts] = windows.max() / windows.sum()
    assert most[10 ** 9] > 0.25 and most[50] < 0.125


def test_distinct_texts():
    data = np.frombuffer(b"0123456789abcdef" * 2 + b"0123456789abcdeX", np.uint8)
    start, end = np.array([0, 16, 32, 0]), np.array([16, 32, 48, 9])
    found, texts = earlier_copies.distinct_texts(data, np.array([7, 7, 7, 5], np.uint64), start, end)
    assert found.tolist() == [5, 7] and texts.tolist() == [1, 2]


def test_texts_with_one_hash_are_told_apart(monkeypatch):
    data = np.frombuffer(b"0123456789abcdef" * 2 + b"0123456789abcdeX" + b"0123456789", np.uint8)
    start, end = np.array([0, 16, 32, 48, 0]), np.array([16, 32, 48, 58, 10])
    for _ in range(2):
        text, first = earlier_copies.same_texts(data, start, end)
        groups = [sorted(np.flatnonzero(text == k).tolist()) for k in range(len(first))]
        assert sorted(groups) == [[0, 1], [2], [3, 4]] and sorted(first.tolist()) == [0, 2, 3]
        monkeypatch.setattr(earlier_copies, "text_keys", lambda d, s, e: np.zeros(len(s), np.uint64))
    joined = earlier_copies.joined_bytes(data, start, end - start, rows=2)
    assert joined.tobytes() == b"".join(data[a:b].tobytes() for a, b in zip(start, end))


def test_neighbours_common_prefixes():
    rng = np.random.default_rng(2)
    text = rng.integers(0, 2, 400).astype(np.uint8)
    starts, rank = np.arange(351), rng.integers(0, 9, 351)
    rows = [text[a: a + 50].tobytes() for a in starts]
    got = earlier_copies.earlier_factor_lengths(text, starts, rank, 50)
    assert got.tolist() == [50 if any(r == q and rank[j] < rank[i] for j, q in enumerate(rows)) else 0 for i, r in enumerate(rows)]


def test_suffix_dedup_tasks_grow_with_input(spark, frame):
    few = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert earlier_copies.tasks_for(spark, 0) == few
    assert earlier_copies.tasks_for(spark, 30 << 30) == 30 * 1024 // 32
    assert earlier_copies.tasks_for(spark, 100 << 40) == int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))
    assert earlier_copies.text_bytes(frame([(1, "é" * 10), (2, None), (3, "ab")])) == 22


def test_longest_previous_factor():
    text = np.frombuffer(b"abcdeabcdxabcde", np.uint8)
    got = earlier_copies.earlier_factor_lengths(text, np.array([0, 5, 10]), np.array([1, 2, 2]), 5)
    assert got.tolist() == [0, 0, 5]


# ---- 4 and 8: DuckDB twins ----

def twin(spark, tmp_path, docs, report, sql):
    got = sorted(map(str, (tuple(r) for r in report(docs).collect())))
    path = str(tmp_path / "documents.parquet")
    docs.write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/*.parquet')")
    return got, sorted(map(str, con.sql(sql).fetchall()))


def test_secrets_twin(spark, frame, tmp_path):
    key, token = "AKIA" + "Z" * 12, "A1b2" * 10
    docs = [(10, f"password = 'hunter2hunter' {key} secret:abc"), (11, "token=secret:abcdefghi"), (12, "token: abcd"),
            (13, f"user=bob token: abcd https://h.example/x {'0a' * 9}"), (14, f"{token} " + "é" * 300 + key),
            (15, f"{token} é {key}"), (16, "https://h.example/x " + " " * 250 + " pass"), (17, "API_KEY==" + "f" * 40), *EDGE,
            (18, "pa\u017f\u017fword = 'hunter2hunter' to\u212aen=secretsecret"), (19, "PaSsWoRd = 'hunter2hunter' ToKeN=longvalue")]
    got, want = twin(spark, tmp_path, frame(docs), secret_links.secret_report, secret_links.SECRET_REPORT_SQL)
    assert got == want
    spans = {r.doc_id: r.spans for r in secret_links.secret_report(frame(docs)).collect()}
    assert "bare" in spans[15] and "bare" not in spans[14]      # linked within the scope only
    assert spans[18] == "" and spans[19].count("assign") == 2   # letters of either case are ASCII ones
    assert spans[12] == "" and "assign" in spans[13] and "user" in spans[13] and "endpoint" in spans[13]


def test_lines_twin(spark, frame, tmp_path):
    line = "Copyright notice number {} of this very site all rights are kept here now"
    docs = [(i, f"own text {chr(97 + i) * 3} of {'abc'[i % 3]}\n{line.format(i)}\nshort one\n" + ("same four words line" if i % 2 else ""))
            for i in range(20)]
    docs += [(30, docs[1][1]), (31, "wild a b c d e f g h i j k"), *[(32 + i, f"wild a b c d e f g h i {w} k") for i, w in
                                                                  enumerate("pqrst")], *EDGE]
    got, want = twin(spark, tmp_path, frame(docs), line_templates.line_report, line_templates.LINE_REPORT_SQL)
    assert got == want
    kept = {r.doc_id: r.text for r in line_templates.keep_first_lines(frame(docs)).collect()}
    assert "Copyright" in kept[0] and "Copyright" not in kept[7] and "own text hhh" in kept[7] and "short one" in kept[7]
    assert 33 not in kept and 31 in kept  # generalised template, first kept


# ---- 5: personal data ----

def test_personal_brute_force(spark, frame):
    rng = np.random.default_rng(2)
    alphabet = list("0123456789.+-() @ab:/é1234567890")
    texts = ["".join(rng.choice(alphabet, rng.integers(0, 80))) for _ in range(3000)]
    texts += ["4111 1111 1111 1111", "a@b.c@d.e", "+1 (555) 010-9999.", "1.2.3.4.5.6.7.8", "300.1.2.3", "x" * 100_000 + "a@b.co"]
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
                "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    for text in texts:
        want = []
        for number, (kind, p) in enumerate(patterns.items()):
            for m in re.finditer(p, text):
                digits = re.sub("[^0-9]", "", m[0])
                ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else False,
                      "card": 12 <= len(digits) <= 19 and personal_data.luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
                if ok:
                    want.append((m.start(), number, m.end()))
        assert [s for s in personal_data.find_spans(text) if s[1] < 4] == sorted(want), text
    rows = personal_data.personal_report(frame(EDGE)).collect()
    assert len(rows) == len(EDGE) and all(r.base_sha256 == sha("") and r.spans == "" for r in rows)
    assert personal_data.listed(personal_data.find_spans("https://bob:pw@h.example IBAN: GB82 WEST 1234 5698 7654 32")) \
        == "login:8:14,email:12:24,iban:31:58"


@pytest.mark.parametrize("after", ["", " BIC: COBADEFFXXX", " BIC", " Bank", " 12 34", ", x", " A1 B2 C3 D4 E5 F6 G7 H8"])
@pytest.mark.parametrize("number", ["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "NO93 8601 1117 947",
                                    "XX49 1234 5678 9012 345"])
def test_iban_ends_before_what_follows(number, after):
    if number.startswith("XX"):
        check = next(c for c in range(2, 99) if personal_data.iban_valid(f"XX{c:02d}{number[4:]}"))
        number = f"XX{check:02d}{number[4:]}"
    text = f"IBAN: {number}{after}"
    assert f"iban:6:{6 + len(number)}" in personal_data.listed(personal_data.find_spans(text)).split(",")


def test_ip_parts_with_leading_zeros():
    found = lambda t: personal_data.listed(s for s in personal_data.find_spans(t) if s[1] == 1)
    assert found("1.2.3.00999") == found("1.2.3.00256") == found("1.2.3." + "9" * 5000) == ""
    assert found("1.2.3.00255") == "ip:0:11" and found("1.2.3.00000") == "ip:0:11" and found("1.2.3." + "0" * 5000) == "ip:0:5006"


# ---- 6 and 10: held-out accuracy ----

@pytest.mark.parametrize("query,label", [(queries.op6_quality, "quality"), (queries.op10_toxicity, "toxic")])
def test_classifiers_held_out(spark, query, label):
    sf = "/root/testdata/sf0.1"
    rows = query(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    truth, said = np.array([r[label] for r in rows]), np.array([r.predicted for r in rows])
    for v in (0, 1):
        assert (said[truth == v] == v).mean() >= (0.97 if label == "quality" or v == 0 else 0.9)


@pytest.mark.parametrize("module", [quality, toxicity])
def test_classifier_edges(spark, frame, module):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    label = "quality" if module is quality else "toxic"
    model = module.fit(frame(EDGE), none, label)
    docs = frame(EDGE, False)
    rows = module.with_score(docs, model).collect()
    assert len(rows) == len(EDGE) and all(r.score == 0.5 and r.predicted == 1 for r in rows)
    assert module.with_score(docs.limit(0), model).count() == 0


def test_levenshtein_product_against_dynamic_programming():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]
    rng = np.random.default_rng(3)
    terms = [("abcab", False), ("bcabcabca", False), ("cab", False), ("aabbc", True)]
    lexicon = toxicity.Lexicon(terms)
    matcher = toxicity.Matcher(lexicon)
    for _ in range(3000):
        word = "".join(rng.choice(list("abcd"), rng.integers(1, 12)))
        found = [d for t, stem in terms for d in [min(distance(word[:n], t) for n in range(len(word) + 1)) if stem
                                                   else distance(word, t)] if d <= lexicon.edits(t)]
        assert matcher.edits(word) == min(found, default=None), word


def test_quotation_is_not_abuse():
    matcher = toxicity.Matcher(toxicity.Lexicon([("idiot", False)]))
    assert toxicity.document_features("you idiot", matcher)[0] > 0
    quoted = toxicity.document_features('he used "idiot" there', matcher)
    assert quoted[0] == 0 and quoted[2] > 0
    assert toxicity.document_features("you idiott", matcher)[1] > 0


# ---- 7: pivot index ----

def test_pivots_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 16))
    rows = []
    for i in range(600):
        v = base[i % 60] + rng.normal(size=16) * (0.15 if i % 2 else 0.6)
        rows.append((i, [float(x) for x in v], i % 3))
    rows += [(700 + i, rows[0][1], 0) for i in range(5)]
    rows += [(800, None, 0), (801, [0.0] * 16, 0), (802, [float("nan")] * 16, 0), (803, rows[0][1], None), (804, [None] * 16, 0),
             (805, rows[0][1][:8], 0), (806, [], 0), (None, rows[0][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 AS node", "2 AS pivots")
    for block_rows in (1024, 16):
        got = {r.vec_id: r for r in pivot_index.near_vectors(df, block_rows=block_rows).collect()}
        valid = [r for r in rows if r[2] is not None and r[1] and len(r[1]) == 16 and all(
            x is not None and x == x for x in r[1]) and any(r[1])]
        x = np.array([r[1] for r in valid])
        x /= np.linalg.norm(x, axis=1)[:, None]
        lab = np.array([r[2] for r in valid])
        near = (x @ x.T >= 0.93) & (lab[:, None] == lab[None])
        np.fill_diagonal(near, False)
        links = near.sum(axis=1)
        found = sum(got[r[0]].n_links for r in valid)
        assert 0.9 * links.sum() <= found <= links.sum()
        for v in (800, 801, 802, 803, 804, 805, 806):
            assert tuple(got[v])[1:] == (0, v, True)
        assert got[704].component_id == got[0].component_id and not got[704].kept
    assert pivot_index.near_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("point_bytes", [pivot_index.POINT_BYTES, 0])
def test_pivots_rare_dimensions(spark, point_bytes):
    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in rng.normal(size=16)], 0) for i in range(300)]
    rows += [(300 + i, [float(x) for x in np.full(4 + i // 2, 1.0) + 0.01 * i], 0) for i in range(8)]
    rows += [(400, rows[0][1][:15], 0), (401, [x * 1.01 for x in rows[0][1]], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in pivot_index.near_vectors(df, sample_rows=20, point_bytes=point_bytes).collect()}
    assert len(got) == len(rows)
    for i in range(8):  # four dimensions of two parallel vectors each
        assert tuple(got[300 + i])[1:] == (1, 300 + i // 2 * 2, i % 2 == 0)
    assert tuple(got[400])[1:] == (0, 400, True) and got[401].component_id == 0


# ---- 9: SimHash ----

def brute_print(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_brute_force(spark, frame):
    rng = np.random.default_rng(5)
    base = [" ".join(f"w{x}" for x in rng.integers(0, 500, 150)) for _ in range(12)]
    docs = [(i, base[i % 12] + (f" Extra{i}" if i % 4 else "")) for i in range(60)] + [e for e in EDGE]
    rows = simhash.simhash_groups(frame(docs)).collect()
    prints = [brute_print(t) for _, t in docs]
    got = sorted((str(r.doc_id), r.fp % 2 ** 64, str(r.component_id)) for r in rows)
    u = np.array(prints, np.uint64)
    i, j = np.nonzero(np.bitwise_count(u[:, None] ^ u[None]) <= 3)
    label = local_components(i, j, len(u))
    least = {}
    for k, (d, _) in zip(label, docs):
        if d is not None:
            least[k] = min(d, least.get(k, d))
    assert got == sorted((str(d), p, str(least.get(k))) for (d, _), p, k in zip(docs, prints, label))
    kept = simhash.keep_one_of_each(frame(docs))
    assert kept.count() == len(set(label))


def test_bucket_split_and_pigeonring_lose_no_link(spark):
    rng = np.random.default_rng(6)
    seed = rng.integers(0, 2 ** 63, 20, dtype=np.uint64)
    flips = [s ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False))) for s in seed for _ in range(30)]
    prints = np.unique(np.array(flips, np.uint64)).view(np.int64)
    df = spark.createDataFrame([(int(p),) for p in prints], "fp long")
    u = prints.view(np.uint64)
    i, j = np.nonzero(np.bitwise_count(u[:, None] ^ u[None]) <= 3)
    label = local_components(i, j, len(u))
    want = {int(p): int(prints[k]) for p, k in zip(prints, label)}
    got = {r.fp: r.root_fp for r in simhash.near_duplicates(df, block_rows=4).collect()}
    root = {p: got.get(p, p) for p in want}
    groups = {}
    for p in want:
        groups.setdefault(root[p], set()).add(want[p])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(label))


def test_components_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (5, 5)], "a long, b long")
    got = {r.node: r.root for r in components(edges, "chain").collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100}
