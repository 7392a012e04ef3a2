"""Every operator against brute force on small tables, with nulls, empties, ties, repeated rows and odd columns."""

import base64
import hashlib
import re
import zipfile
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import chat, common, components, covertree, licenses, minhash, mixing, packing, quality, sstable, textcore, tokens, toxicity, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, source string, row long, rep string, __content int, part int, length string"


def documents(spark, rows):
    """Rows (doc_id, text, source) with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, 0, "x", 1, 2, "y") for r in rows], DOCS)


@pytest.fixture(scope="module")
def corpus(spark):
    r = np.random.default_rng(5)
    words = [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(r.choice(words, n))
    base = [text(n) for n in (80, 120, 60, 300)]
    near = [" ".join(w if k != 7 else f"new{j}" for k, w in enumerate(b.split())) for j, b in enumerate(base)]
    rows = [(i, t, f"s{i % 3}") for i, t in enumerate(base + near + base[:2] + [text(90) for _ in range(20)])]
    long = text(9000)
    rows += [(100, None, None), (101, "", "s1"), (102, " \t\n", "s1"), (103, "one", "s0"), (104, "ONE", "s0"), (None, "a null id here", None), (5, rows[5][1], rows[5][2]), (105, long, "s2"), (106, "Ünï cødé text 日本 \U0001f600 'S don't", "s2")]
    return rows


def frame(spark, corpus):
    return documents(spark, corpus)


def empty(spark):
    return spark.createDataFrame([], DOCS)


# --- hashing and components -----------------------------------------------------


def test_word_hashes():
    items = [b"The cat the  cat", b"", "é the".encode(), b"THE"]
    chunk = textcore.Chunk(items, lower=True)
    h = chunk.word_hashes()
    words = [w.lower() for x in items for w in x.split()]
    assert list(chunk.n_words) == [4, 0, 2, 1]
    assert len(set(h.tolist())) == len(set(words)) and h[0] == h[2] == h[5] == h[6]


def test_components(spark):
    r = np.random.default_rng(0)
    pairs = [(int(a), int(b)) for a, b in r.integers(0, 300, (180, 2))] + [(1000, k) for k in range(400, 500)] + [(None, 1), (7, 7)]
    union = components.UnionFind()
    for a, b in pairs:
        if a is not None:
            union.union(a, b)
    for bound in (0, components.ONE_TASK):
        got = {x["node"]: x["component"] for x in components.components(spark.createDataFrame(pairs, "a long, b long"), one_task=bound).collect()}
        assert got == {n: union.find(n) for n in got} and {n for p in pairs if p[0] not in (None, 7) for n in p if p[0] != p[1]} <= set(got)


# --- 1 and 10: tokens -----------------------------------------------------------


def expected_ids(text):
    memo = tokens.memo(tokens.default_path())
    return np.array([*memo.tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


def test_word_memo_is_exact(corpus):
    odd = ["a | b", "x\x1cy z", "don't 's Ω Σας #|# <|endoftext|> a", "　a\xa0b", "é ́e", "A,B c., d). f_ g__ h!'s ", "<|ENDOFTEXT|> x", "İstanbul ẞ K"]
    for limit in (3, 50, 10_000):
        memo = tokens.WordMemo(tokens.default_path(), limit=limit)
        for items in ([t or "" for _, t, _ in corpus], odd, odd[::-1]):
            ids, at = memo.ids(items)
            for k, t in enumerate(items):
                assert list(ids[at[k] : at[k + 1]]) == memo.tokenizer.encode(t, add_special_tokens=False).ids, t


def odd_texts(n, seed):
    """Short texts over all code points, marks and characters with odd case or composition drawn often."""
    r = np.random.default_rng(seed)
    marks = [*range(0x300, 0x370), 0x130, 0x131, 0x49, 0x69, 0x4B, 0x212A, 0x3A3, 0x3C2, 0x1E9E, 0xC5, 0x212B, 0x2126, 0x344, 0x1100, 0x1161, 0xAC00, 0xFB01, 0xA0, 0x85, 0x3000, 0x1F80]
    for _ in range(n):
        kind = r.integers(0, 4, int(r.integers(1, 9)))
        points = [int(r.integers(1, 0x110000)) if k == 0 else int(r.choice(marks)) if k == 1 else int(r.integers(32, 127)) if k == 2 else int(r.choice([32, 10, 46, 39, 0x49])) for k in kind]
        yield "".join(chr(c) for c in points if not 0xD800 <= c < 0xE000)


def test_word_memo_on_all_code_points():
    memo = tokens.WordMemo(tokens.default_path())
    items = [*odd_texts(30_000, 11), "\u0130\u0326", "I\u0307\u0326", "x I\u0326\u0307. y"]
    ids, at = memo.ids(items)
    want = memo.tokenizer.encode_batch_fast(items, add_special_tokens=False)
    assert [t for k, t in enumerate(items) if list(ids[at[k] : at[k + 1]]) != want[k].ids] == []


def test_word_memo_in_slices(monkeypatch):
    """The tokenizer gets a bounded number of words at once, however many are new, and the ids are the same."""
    monkeypatch.setattr(tokens, "SLICE", 50, raising=False)
    memo, sizes = tokens.WordMemo(tokens.default_path()), []
    encode_all = memo.encode_all
    monkeypatch.setattr(memo, "encode_all", lambda words, letters: (sizes.append(len(words)), encode_all(words, letters))[1])
    texts = [" ".join(f"{'abcdefghij'[i % 10] * (1 + i // 10)}{'' if i % 3 else i}" for i in range(400)), "", "caf\u00e9 x1"]
    flat, at = memo.ids(texts)
    assert max(sizes) <= 50 and sum(sizes) == len(memo.index) > 400
    for k, t in enumerate(texts):
        assert flat[at[k] : at[k + 1]].tolist() == memo.tokenizer.encode(t, add_special_tokens=False).ids


def test_local_tables(spark):
    """Tables of the driver's rows come without tasks in Python workers."""
    docs = common.written(spark.createDataFrame([(i, f"text {i}") for i in range(9)], "doc_id long, text string"), "docs")
    labels = common.written(spark.createDataFrame([(i, i % 2) for i in range(9)], "doc_id long, toxic int"), "labels")
    assert "LogicalRDD" not in toxicity.training_sample(docs, labels)._jdf.queryExecution().optimizedPlan().toString()
    rows = [("a", 1, 2, 0.5), (None, None, -(1 << 63), None)]
    made = common.local(spark, rows, "s string, i int, l long, d double")
    assert [tuple(r) for r in made.collect()] == rows and made.dtypes == [("s", "string"), ("i", "int"), ("l", "bigint"), ("d", "double")]
    assert common.local(spark, [], "a long, b long").collect() == []


def test_release(spark):
    """Heap that a stage no longer uses goes back to the system."""
    runtime = spark._jvm.java.lang.Runtime.getRuntime()
    spark.range(0, 8, 1, 4).select(F.sum(F.length(F.repeat(F.lit("x"), 50_000_000 + F.col("id").cast("int"))))).collect()
    before = runtime.totalMemory()
    common.release(spark)
    assert runtime.totalMemory() < before


def test_packing(spark, corpus):
    rows = packing.pack(frame(spark, corpus), tokens.default_path()).collect()
    want = Counter()
    for i, t, _ in corpus:
        ids = expected_ids(t)
        for p, s in enumerate(range(0, len(ids), 4096)):
            want[i, p, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(by) <= -(-sum(r["length"] for r in rows) // 4096) + 1
    assert packing.pack(empty(spark), tokens.default_path()).collect() == []


def test_pattern_plan():
    r = np.random.default_rng(1)
    lengths = np.minimum(4096, (r.lognormal(6, 1, 5000)).astype(int) + 1)
    plan = packing.plan(dict(Counter(lengths.tolist())))
    packed = Counter()
    for run, n in plan.runs:
        assert sum(run) <= 4096
        for x in run:
            packed[x] += n
    assert packed == Counter(lengths.tolist())
    assert sum(n for _, n in plan.runs) <= 1.01 * lengths.sum() / 4096 + 1
    a = r.random((6, 9))
    x = packing.nnls(a, a @ np.array([0, 1, 0, 2, 0, 0, 3.0, 0, 0]))
    assert (x >= 0).all() and np.allclose(a @ x, a @ np.array([0, 1, 0, 2, 0, 0, 3.0, 0, 0]), atol=1e-6)


def test_sstable(spark, corpus, tmp_path):
    shards = common.written(sstable.write_shards(frame(spark, corpus), f"file://{tmp_path}/s", tokens.default_path()), "m")
    got = sorted(((-1 if r["doc_id"] is None else r["doc_id"]), r["start"], r["n_tokens"], r["ids_crc32"]) for r in sstable.read_shards(shards).collect())
    at, want = 0, []
    for i, t, _ in sorted(corpus, key=lambda x: (-1 if x[0] is None else x[0], x[1] or "")):
        ids = expected_ids(t)
        want.append((-1 if i is None else i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want
    tables = [sstable.Table(r["path"]) for r in shards.collect()]
    for i, t, _ in corpus:
        assert any(x is not None and (x == expected_ids(t)).all() for x in (s.get(i) for s in tables) if x is None or len(x) == len(expected_ids(t)))
    assert all(s.get(99_999) is None for s in tables)
    assert sstable.read_shards(sstable.write_shards(empty(spark), f"file://{tmp_path}/e", tokens.default_path())).count() == 0


def test_sstable_blocks(tmp_path):
    out = sstable.Writer(f"{tmp_path}/x.sst", block_bytes=64)
    values = {k: np.arange(k % 7, dtype="<u4") * 40_000 for k in range(-50, 200, 3)}
    for k, v in values.items():
        out.add(sstable.key_of(k), v)
    with pytest.raises(ValueError):
        out.add(sstable.key_of(-100), np.empty(0, "<u4"))
    out.close()
    table = sstable.Table(f"{tmp_path}/x.sst")
    assert len(table.blocks) > 3 and all((table.get(k) == v).all() for k, v in values.items())
    assert sum(table.bloom.__contains__(sstable.key_of(k)) for k in range(1000, 3000)) < 100


# --- 2: toxicity ----------------------------------------------------------------


def test_toxicity(spark):
    r = np.random.default_rng(2)
    stem, vocabulary = "zorg", ["".join(r.choice(list("abcdefghi"), 5)) for _ in range(200)]

    def text(bad):
        words = list(r.choice(vocabulary, int(r.integers(20, 120))))
        if bad:
            for k in r.integers(0, len(words), 3):
                words[k] = stem + words[k]
        return " ".join(words)

    rows = [(i, text(i % 3 == 0), "s") for i in range(360)] + [(1000, None, None), (1001, "", "s"), (None, "no id", "s"), (3, text(True), "s")]
    labels = spark.createDataFrame([(i, int(i % 3 == 0), 1) for i in range(360)] + [(None, 1, 1), (5, None, 1)], "doc_id long, toxic int, quality int")
    got = {x["doc_id"]: x for x in toxicity.score_documents(documents(spark, rows), labels).collect()}
    assert all(x["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, x in got.items() if i is not None)
    held = [i for i in range(360) if got[i]["held_out"]]
    assert np.mean([got[i]["predicted"] == (i % 3 == 0) for i in held]) >= 0.9
    assert all(0 <= x["score"] <= 1 and x["predicted"] == (x["score"] >= 0.5) for x in got.values())
    assert got[1000]["score"] == got[1001]["score"] == 0
    none = toxicity.score_documents(documents(spark, rows[:3]), labels.where("false")).collect()
    assert [x["score"] for x in none] == [0, 0, 0]
    assert toxicity.score_documents(empty(spark), labels).collect() == []


def test_gradients():
    r = np.random.default_rng(0)
    net = toxicity.Network(1)
    words = ["abc", "de", "fghij", "k"]
    slots = np.array([toxicity.word_slot(w) for w in words])
    grams, counts = toxicity.gram_slots(words)
    rows, mask = r.integers(0, 4, (3, 5)), (np.arange(5)[None] < np.array([5, 3, 1])[:, None]).astype(np.float32)
    loss = lambda: float(net.run(net.project(net.features(slots, grams, counts)), rows, mask).astype(float).sum())
    keep: dict = {}
    gates = net.project(net.features(slots, grams, counts))
    net.run(gates, rows, mask, keep)
    g, _ = net.backward(np.ones(3, np.float32), rows, mask, keep, 4)
    for name, at in (("uf", (1, 3)), ("ub", (0, 20)), ("attend", (2,)), ("out", (9,))):
        p, e = net.p[name], 1e-2
        p[at] += e
        up = loss()
        p[at] -= 2 * e
        down = loss()
        p[at] += e
        assert (up - down) / (2 * e) == pytest.approx(float(g[name][at]), rel=0.08, abs=2e-3), name


def test_windows_share_half():
    """Every span of 17 words lies whole in one window, wherever it begins."""
    for n in (33, 48, 49, 200, 1001):
        at = toxicity.window_rows(n)
        assert all(any(a <= k and k + 17 <= a + toxicity.WINDOW for a in at) for k in range(n - 16))
    assert toxicity.PER_CLASS >= 1200


def test_scoring_pass_equals_training_pass():
    r = np.random.default_rng(6)
    net, gates = toxicity.Network(2), r.standard_normal((50, 6 * toxicity.HIDDEN)).astype(np.float32)
    rows = r.integers(0, 50, (9, toxicity.WINDOW))
    mask = np.arange(toxicity.WINDOW)[None] < r.integers(1, toxicity.WINDOW + 1, 9)[:, None]
    assert np.allclose(net.logits(gates, rows, None), net.run(gates, rows, None), atol=1e-5)
    assert np.allclose(net.logits(gates, rows, mask), net.run(gates, rows, mask.astype(np.float32)), atol=1e-5)


def test_gram_slots_by_word():
    words = ["abc", "(de)", "", "!", "fghij", "é", "abc"]
    grams, counts = toxicity.gram_slots(words)
    alone = [toxicity.gram_slots([w]) for w in words]
    assert list(counts) == [len(g) for g, _ in alone] and list(grams) == [x for g, _ in alone for x in g]

# --- 3: archives ----------------------------------------------------------------


def test_warc(spark, tmp_path):
    pages = [(i, f"http://h/{i}\r\nX: y é", f"<p>{i % 4}é</p>" if i % 5 else None) for i in range(40)] + [(None, None, "<p>1é</p>"), (50, "u", "x" * 200_000), (50, "u", "x" * 200_000), (None, "u", "only null ids")]
    df = spark.createDataFrame([(*p, 1, "d") for p in pages], "page_id long, url string, html string, top int, digest string")
    packages = common.written(warc.write_archives(df, f"file://{tmp_path}/w"), "p")
    got = Counter(tuple(r) for r in warc.read_archives(packages).collect())
    top = {}
    for i, _, h in pages:
        if i is not None:
            top[h or ""] = max(i, top.get(h or "", -1))
    shared = Counter(h or "" for _, _, h in pages)
    want = Counter()
    for i, _, h in pages:
        body = (h or "").encode()
        revisit = shared[h or ""] > 1 and h or "" in top
        t = top.get(h or "")
        revisit = shared[h or ""] > 1 and t is not None and i != t
        want[i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", t if revisit else None] += 1
    assert got == want
    for r in packages.collect():
        with zipfile.ZipFile(common.local_name(r["path"])) as z:
            assert z.testzip() is None and set(z.namelist()) == {warc.DATA, warc.INDEX}
    assert warc.read_archives(warc.write_archives(df.where("false"), f"file://{tmp_path}/n")).count() == 0


def test_zip_reader(tmp_path):
    from sparkloom.llm.zipio import ZipReader, ZipWriter

    with zipfile.ZipFile(f"{tmp_path}/a.zip", "w", zipfile.ZIP_STORED) as z:
        z.comment = b"PK\x05\x06 a comment that holds the signature"
        z.writestr("one.txt", "hello world")
        with z.open("two", "w", force_zip64=True) as f:
            f.write(b"x" * 1000)
    reader = ZipReader(f"{tmp_path}/a.zip")
    assert reader.read("one.txt", 6, 5) == b"world" and reader.read("two") == b"x" * 1000
    for force in (None, True):
        out = ZipWriter(f"{tmp_path}/b.zip", force)
        out.open("m")
        out.write(b"abc")
        out.write(b"def")
        out.end_member()
        out.close()
        assert ZipReader(f"{tmp_path}/b.zip").read("m", 2, 3) == b"cde" and zipfile.ZipFile(f"{tmp_path}/b.zip").read("m") == b"abcdef"
    (tmp_path / "c.zip").write_bytes(b"not a zip file at all")
    with pytest.raises(ValueError):
        ZipReader(f"{tmp_path}/c.zip")


# --- 4: licenses ----------------------------------------------------------------


def test_licenses(spark):
    rows = [
        (0, "Licensed under the Apache License, Version 2.0 (the License)", "s"), (1, "CC-BY 4.0; mit\nLicense; GNU  General Public License v3 and cc by", "s"), (2, None, None), (3, "", "s"), (4, "mit der license accby xgnu general public license", "s"),
        (5, "SPDX-License-Identifier: GPL-2.0-only", "s"), (6, "x " * 50_000 + "MIT license", "s"), (None, "apache licensé apache license", "s"), (1, "CC-BY 4.0; mit\nLicense; GNU  General Public License v3 and cc by", "s"),
    ]
    got = licenses.scan_licenses(documents(spark, rows)).collect()
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    for i, t, _ in rows:
        r = by[i][0]
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places, labels = [], set()
        for p, label in phrases.items():
            q = p.split()
            at = [k for k in range(len(words)) if words[k : k + len(q)] == q]
            places += at
            labels |= {label} if at else set()
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
        assert labels <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert "apache-2.0" in by[0][0]["labels"] and "apache" in by[0][0]["labels"].split(",") and "spdx-tag" in by[5][0]["labels"]
    assert len(licenses.rules()) > 200 and licenses.scan_licenses(empty(spark)).collect() == []


def matches(tree):
    """Texts that a parsed regex matches: every alternation, and each repeat at its least number and one more."""
    out = [""]
    for op, x in tree:
        match str(op):
            case "LITERAL":
                own = [chr(x)]
            case "ANY":
                own = ["a"]
            case "IN":
                own = [chr(v if str(kind) == "LITERAL" else v[0]) for kind, v in x]
            case "SUBPATTERN":
                own = matches(x[3])
            case "BRANCH":
                own = [m for b in x[1] for m in matches(b)]
            case "MAX_REPEAT" | "MIN_REPEAT":
                own = [m * n for n in range(x[0], min(x[0] + 1, x[1]) + 1) for m in matches(x[2])]
            case "ASSERT_NOT":
                own = [""]
        out = [a + b for a in out for b in dict.fromkeys(own)]
    return out


def test_license_keywords_are_in_every_match():
    for r in licenses.rules():
        for text in matches(re._parser.parse(r.regex.pattern)):
            assert r.regex.fullmatch(text), (r.label, text)
            assert r in licenses.candidates(text), (r.label, text)


def test_license_intervals():
    r = np.random.default_rng(2)
    for _ in range(200):
        held, taken = licenses.Intervals(), []
        for _ in range(30):
            a = int(r.integers(0, 30))
            b = a + int(r.integers(1, 12))
            inside = any(s <= a and b <= e for s, e in taken)
            assert held.hold(a, b) == inside
            if not inside:
                held.add(a, b)
                taken.append((a, b))


def test_licenses_in_a_very_long_text():
    text = "mit license " * 170_000
    places, labels = licenses.base_places(text[:-1])
    assert places == list(range(0, 340_000, 2)) and labels == {"mit"}
    found = licenses.scan(text[:-1], licenses.candidates(text))
    assert [x[1:3] for x in found] == [(k, k + 2) for k in range(0, 340_000, 2)]


def test_licenses_without_former_keywords(spark):
    texts = {"X Consortium License": "x11-distribute", "responsible AI license": "rail", "JSR-175 specification license": "jsr", "ASL 2.0": "apache", "open rail license": "openrail", "gnu.org/copyleft/gpl": "gpl-url", "You should have received a copy of the GNU General Public License": "gpl", "This software is provided by the copyright holders and contributors as is and any express or implied warranties": "bsd-warranty", "FreeBSD license": "bsd-2-clause", "X.Net license": "xnet"}
    got = {r["doc_id"]: r["labels"].split(",") for r in licenses.scan_licenses(documents(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    assert all(label in got[i] for i, label in enumerate(texts.values())), got


# --- 5: vectors -----------------------------------------------------------------


def brute_vectors(rows, cosine):
    good = [(i, l, np.array(v, float)) for i, v, l in rows if l is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, union = Counter(), components.UnionFind()
    for a in range(len(good)):
        for b in range(a):
            (i, p, x), (j, q, y) = good[a], good[b]
            if p == q and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                links[i] += 1
                links[j] += 1
                union.union(i, j)
    return links, union


@pytest.mark.parametrize(("block", "broadcast"), [(3, -1), (7, common.BROADCAST_ROWS), (2048, common.BROADCAST_ROWS)])
def test_vectors(spark, monkeypatch, block, broadcast):
    monkeypatch.setattr(common, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(covertree, "CHUNK", 40)
    r = np.random.default_rng(4)
    centres = r.standard_normal((6, 8))
    rows = [(i, (centres[i % 6] + r.standard_normal(8) * r.choice([0.02, 0.1, 1.0])).astype("float32").tolist(), i % 2) for i in range(120)]
    rows += [(200 + k, rows[0][1], 0) for k in range(5)] + [(300, None, 0), (301, [0.0] * 8, 0), (302, [None] + [1.0] * 7, 0), (303, [float("nan")] * 8, 0), (304, [float("inf")] * 8, 0), (305, rows[0][1], None), (306, rows[0][1][:4], 0), (307, [], 1)]
    rows += [(400 + i, (centres[i % 6] * (1 + i % 3) + r.standard_normal(8) * 1e-3).tolist(), 3) for i in range(90)]  # tight cells
    rows += [(500 + i, (centres[0] + r.standard_normal(8) * 0.15).tolist(), 4) for i in range(90)]  # links across cells
    df = spark.createDataFrame([(*x, "c", 1.5) for x in rows], "vec_id long, embedding array<double>, label int, cell string, n double")
    links, union = brute_vectors(rows, 0.98)
    got = {x["vec_id"]: (x["n_links"], x["component_id"], x["kept"]) for x in covertree.near_vectors(df, block=block, fan=4).collect()}
    assert got == {i: (links[i], union.find(i), union.find(i) == i) for i, _, _ in rows}
    if block == 7:
        assert covertree.near_vectors(df.where("false")).collect() == []


def test_dual_traversal():
    r = np.random.default_rng(9)
    tight = r.standard_normal(16)
    x = np.concatenate([r.standard_normal((60, 16)), tight + r.standard_normal((200, 16)) * 0.03, np.repeat(tight[None], 40, 0)])
    u = x / np.linalg.norm(x, axis=1)[:, None]
    c = u @ u.T >= 0.98
    np.fill_diagonal(c, False)
    w = r.integers(1, 4, len(x))
    assert (covertree.DualTraversal(x, w, None, None, 0.98).x_links == c @ w).all()
    half = covertree.DualTraversal(x[:150], w[:150], x[150:], w[150:], 0.98)
    assert (half.x_links == c[:150, 150:] @ w[150:]).all() and (half.y_links == c[150:, :150] @ w[:150]).all()


# --- 6: documents ---------------------------------------------------------------


def brute_documents(rows, k, percent):
    def shingles(t):
        w = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())

    sets = [shingles(t) for _, t, _ in rows]
    group = components.UnionFind()
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                group.union(a, b)
    least = defaultdict(list)
    for a, (i, *_) in enumerate(rows):
        if i is not None:
            least[group.find(a)].append(i)
    return [(i, len(s), min(least[group.find(a)], default=None)) for a, ((i, *_), s) in enumerate(zip(rows, sets, strict=True))]


@pytest.mark.parametrize("k", [2, 5])
def test_minhash(spark, corpus, k):
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(frame(spark, corpus), k=k).collect())
    assert got == Counter((i, n, c, i is not None and i == c) for i, n, c in brute_documents(corpus, k, 80))
    if k == 2:
        assert minhash.near_duplicates(empty(spark)).collect() == []


def test_minhash_dense_group(spark):
    """A group whose members are near each other and partly not linked goes through the rounds and the full comparison."""
    r = np.random.default_rng(8)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(f"x{i}_{k}" if r.random() < 0.09 else w for k, w in enumerate(base)), "s") for i in range(60)]
    got = {x["doc_id"]: x["component_id"] for x in minhash.near_duplicates(documents(spark, rows), k=1).collect()}
    assert got == {i: c for i, _, c in brute_documents(rows, 1, 80)}


def test_block_compares_low_agreement():
    """A pair at similarity 0.8 whose signatures agree in 0.62 of the slots only is still compared exactly."""
    p = np.arange(9, dtype=np.uint64)
    same = int(0.62 * 252) + 1
    sketches = [bytes(252), bytes(same) + b"\x01" * (252 - same)]
    frame = pd.DataFrame({"part": [1, 2], "own": [0, 0], "rep": [1, 2], "n": [9, 9], "sketch": sketches, "items": [p.tobytes(), (p + (p == 8)).astype("<u8").tobytes()]})
    assert minhash._block((0, 0, 0), frame, 80).values.tolist() == [[1, 2]]
    batch = pa.RecordBatch.from_pandas(frame.drop(columns="items").assign(key=5, lo=0, hi=0))
    assert [b.to_pylist() for b in minhash._forest([batch.slice(0, 1), batch.slice(1)], 80)] == [[{"a": 1, "b": 2}]]
    other = pa.RecordBatch.from_pandas(frame.drop(columns="items").assign(key=[5, 6], lo=0, hi=0))
    assert list(minhash._forest([other], 80)) == []


@pytest.mark.parametrize("broadcast", [-1, common.BROADCAST_ROWS])
def test_minhash_in_many_blocks(spark, monkeypatch, broadcast):
    """Without rounds all is left to the comparison by blocks, here of a few rows each."""
    monkeypatch.setattr(minhash, "ROUNDS", 0)
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 4)
    monkeypatch.setattr(common, "BROADCAST_ROWS", broadcast)
    r = np.random.default_rng(9)
    rows = []
    for g in range(3):
        base = [f"w{g}_{i}" for i in range(100)]
        rows += [(100 * g + i, " ".join(f"x{i}_{k}" if r.random() < 0.08 else w for k, w in enumerate(base)), "s") for i in range(20)]
    got = {x["doc_id"]: x["component_id"] for x in minhash.near_duplicates(documents(spark, rows), k=1).collect()}
    assert got == {i: c for i, _, c in brute_documents(rows, 1, 80)}


def test_distinct_documents(spark, corpus):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a, "s"), (1, a, "s"), (2, a + " z", "s"), (2, b, "s"), (3, c, "s"), (None, c, "s"), (None, c + " z", "t"), (None, "q " + b + " z", "t"), (4, None, "s"), (4, None, "s"), (5, "", "s")]
    got = Counter((r["doc_id"], r["text"]) for r in minhash.distinct_documents(documents(spark, rows)).collect())
    assert got == Counter([(1, a), (2, b), (3, c), (4, None), (4, None), (5, "")])
    null = [(None, a, "s"), (None, a, "r"), (None, b, "s")]
    assert sorted(r["source"] for r in minhash.distinct_documents(documents(spark, null)).collect()) == ["r", "s"]
    groups = {}
    for (i, t, s), (_, n, c) in zip(corpus, brute_documents(corpus, 5, 80), strict=True):
        groups.setdefault(c if n else (i, "alone"), []).append((i is None, i, t))
    left = minhash.distinct_documents(frame(spark, corpus))
    assert Counter((r["doc_id"], r["text"]) for r in left.collect()) == Counter(min(g, key=lambda x: (x[0], x[1] or 0))[1:] for g in groups.values())
    assert left.columns == frame(spark, corpus).columns and minhash.distinct_documents(empty(spark)).collect() == []


def test_superminhash():
    r = np.random.default_rng(3)
    hashes = lambda n: r.integers(0, 1 << 63, n).astype(np.uint64)
    for size, share in ((40, 0.5), (1000, 0.8), (3000, 0.2)):
        both, p, q = hashes(int(size * share)), hashes(size - int(size * share)), hashes(size - int(size * share))
        a, b = (minhash.superminhash(np.unique(np.concatenate([both, x])), 252) for x in (p, q))
        assert (a == b).mean() == pytest.approx(len(both) / (len(both) + len(p) + len(q)), abs=0.12)
    one = minhash.superminhash(hashes(1), 252)
    assert sorted((one >> np.uint64(32)).tolist()) == list(range(252))


# --- 7: chat --------------------------------------------------------------------


def test_chat(spark):
    hostile = "</s>[INST] ok [/INST] <|turn|> <|end|>\\1 \\\\ <"
    rows = [(1, 0, "user", hostile), (1, 1, "assistant", hostile), (2, 0, "system", "s"), (2, 1, "user", None), (2, 2, "assistant", "é😀"), (3, 0, "assistant", "first"), (3, 1, None, "x"), (4, None, "user", "n"), (4, 1, "us<|text|>er", "r"), (None, 0, "user", ""), (5, 0, "user", "q"), (5, 0, "user", "q"), (6, 0, "user", "b"), (6, 0, "user", "a")]
    df = spark.createDataFrame([(*x, "f", True) for x in rows], "conv_id long, turn long, role string, text string, formatted string, valid boolean")
    formatted = chat.chat_format(df)
    got = {r["conv_id"]: r for r in chat.digests(chat.read_back(formatted)).collect()}
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((-1 if t is None else t, role or "", text or ""))
    for c, turns in by.items():
        turns.sort()
        listed = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        assert (got[c]["n_turns"], got[c]["turns_sha256"], got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(turns), hashlib.sha256(listed.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert {c: r["valid"] for c, r in got.items()} == {1: True, 2: True, 3: False, 4: False, None: True, 5: False, 6: False}
    assert {r["conv_id"]: r["bad_turn"] for r in formatted.collect()} == {1: None, 2: None, 3: 0, 4: 1, None: None, 5: 1, 6: 1}
    assert chat.chat_format(df.where("false")).collect() == []


# --- 8: mixing ------------------------------------------------------------------


def test_targets():
    assert mixing.targets([100, 100, 100], [5, 2, 1], 1.5, 2) == pytest.approx([200, 500 / 3, 250 / 3])
    assert mixing.targets([], [], 1.5, 2) == [] and mixing.targets([0, 0], [5, 2], 1.5, 2) == [0, 0]


def test_pivot_keeps_mass():
    r = np.random.default_rng(0)
    sizes, parts = r.integers(1, 1000, 300).tolist(), [0.3] * 300
    before = sum(s * p for s, p in zip(sizes, parts, strict=True))
    left = mixing.pivot(sizes, parts, r.random(300).tolist())
    assert sum(s * p for s, p in zip(sizes, parts, strict=True)) == pytest.approx(before)
    assert all(p in (0.0, 1.0) for k, p in enumerate(parts) if k != left)
    hits = [0, 0]
    for t in range(4000):
        p = [0.3, 0.6]
        mixing.pivot([10, 20], p, r.random(2).tolist())
        hits = [h + x for h, x in zip(hits, p, strict=True)]
    assert np.allclose(np.array(hits) / 4000, [0.3, 0.6], atol=0.03)


@pytest.mark.parametrize(("bucket", "sources"), [(8, 0), (1024, mixing.BROADCAST_SOURCES)])
def test_mixing(spark, monkeypatch, bucket, sources):
    monkeypatch.setattr(mixing, "BUCKET", bucket)
    monkeypatch.setattr(mixing, "RUN", 3)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", sources)
    monkeypatch.setattr(mixing, "FAN_IN", 3)
    r = np.random.default_rng(1)
    rows = [(i, " ".join(["w"] * int(r.integers(1, 60))), f"s{int(r.integers(0, 4))}" if i % 9 else None) for i in range(400)] + [(900, None, "s0"), (901, "", None), (7, "w w", "s1"), (7, "w w", "s1"), (None, "w", "only"), *[(902, "w w w", "s2")] * 25, (903, "", "empty")]
    rows = [x for x in rows]
    df = documents(spark, rows)
    got = [r.asDict() for r in mixing.mix_sources(df).collect()]
    again = [r.asDict() for r in mixing.mix_sources(df.repartition(5)).collect()]
    key = lambda x: (str(x["doc_id"]), x["size"], x["copies"])
    assert sorted(got, key=key) == sorted(again, key=key) and len(got) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    goal = dict(zip(order, mixing.targets([sizes[s] for s in order], [(5, 2, 1)[k % 3] for k in range(len(order))], 1.5, 2), strict=True))
    taken = Counter()
    for x in got:
        assert x["source_size"] == sizes[x["source"]] and x["target"] == pytest.approx(goal[x["source"]]) and 0 <= x["taken"] <= 2 * x["size"]
        taken[x["source"]] += x["taken"]
    assert all(abs(taken[s] - goal[s]) <= 30 for s in order)
    repeated = Counter(r["doc_id"] for r in mixing.mixture(df).collect())
    assert repeated == Counter({k: v for k, v in ((i, sum(x["copies"] for x in got if x["doc_id"] == i)) for i in {x["doc_id"] for x in got}) if v})
    assert mixing.mixture(df).columns == df.columns and mixing.mix_sources(empty(spark)).collect() == []


@pytest.mark.parametrize("seed", range(6))
def test_targets_in_tasks(spark, seed):
    r = np.random.default_rng(seed)
    sizes = np.where(r.random(40) < 0.2, 0, r.integers(1, 10 ** int(r.integers(1, 6)), 40)).tolist()
    names = [None, *(f"s{k}é" for k in range(39))]
    stats = spark.createDataFrame([(n, s, 1) for n, s in zip(names, sizes, strict=True)], "source string, source_size long, n long").repartition(5)
    order = sorted(range(40), key=lambda k: (names[k] is None, names[k] or ""))
    want = mixing.targets([sizes[k] for k in order], [(5, 2, 1)[i % 3] for i in range(40)], 1.5, 2)
    got = {x["source"]: x["target"] for x in mixing.targets_in_tasks(stats, (5, 2, 1), 1.5, 2).collect()}
    assert [got[names[k]] for k in order] == pytest.approx(want)


# --- 9: quality -----------------------------------------------------------------


def test_quality(spark, corpus, monkeypatch):
    boiler = "Click here to subscribe NOW"
    rows = corpus + [(2000 + i, f"{' '.join(f'own{i}_{k}' for k in range(60))}\n{boiler if i % 2 else boiler.upper()}\n\nsame\nsame", "hot") for i in range(30)]
    rows += [(3000 + i, "\n".join([boiler] * 12 + [f"{i} left"]), "hot") for i in range(3)] + [(4000, "a b c " * 40, "hot")]
    got = quality.assess(documents(spark, rows), docs_limit=20).collect()
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    assert len(got) == len(rows)
    for i, t, _ in rows:
        t = t or ""
        w = WORD.findall(t)
        c = Counter(zip(w, w[1:], w[2:], strict=False))
        cover = {j for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        r = by[i][0]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(cover) > 50 * len(w))
    assert all(by[2000 + i][0]["kept"] and by[2000 + i][0]["words_removed"] == 7 for i in range(30))
    assert not any(by[3000 + i][0]["kept"] for i in range(3))
    cleaned = {r["doc_id"]: r["text"] for r in quality.clean(documents(spark, rows), docs_limit=20).collect()}
    assert boiler not in cleaned[2001] and "own1_0" in cleaned[2001] and cleaned[0] == rows[0][1] and 4000 not in cleaned
    monkeypatch.setattr(quality, "BROADCAST_LINES", -1)
    assert {r["doc_id"]: r["text"] for r in quality.clean(documents(spark, rows), docs_limit=20).collect()} == cleaned
    assert quality.assess(empty(spark)).collect() == [] and quality.clean(empty(spark)).collect() == []


def test_quality_long_lines(spark, monkeypatch):
    """A line of 60 words above the limit counts, goes and depletes as a short one does."""
    passage = " ".join(f"passage{k}" for k in range(60))
    own = lambda i: " ".join(f"own{i}_{k}" for k in range(60))
    rows = [(i, f"{own(i)}\n{passage if i % 2 else passage.upper()}", "hot") for i in range(30)] + [(100, passage, "hot"), (101, f"{own(101)}\n{passage}", "cold")]
    got = {r["doc_id"]: (r["words_removed"], r["kept"]) for r in quality.assess(documents(spark, rows)).collect()}
    assert got == {i: (60, True) for i in range(30)} | {100: (60, False), 101: (0, True)}
    want = {i: own(i) for i in range(30)} | {101: rows[31][1]}
    for lines in (quality.BROADCAST_LINES, -1):
        monkeypatch.setattr(quality, "BROADCAST_LINES", lines)
        assert {r["doc_id"]: r["text"] for r in quality.clean(documents(spark, rows)).collect()} == want


# --- very long texts ---------------------------------------------------------------


def test_very_long_texts(spark):
    """Texts of a megabyte, of one word or of many, are handled whole."""
    r = np.random.default_rng(3)
    many = " ".join(r.choice([f"word{k}" for k in range(5000)], 120_000))
    one = "x" * 1_000_000
    lines = "\n".join(["the same line of seven words here"] * 30_000)
    rows = [(1, many, "s"), (2, many + " end", "s"), (3, one, "s"), (4, one, "s"), (5, lines, "s")]
    near = {x["doc_id"]: x["component_id"] for x in minhash.near_duplicates(documents(spark, rows), k=2).collect()}
    assert near == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}
    facts = {x["doc_id"]: x for x in quality.assess(documents(spark, rows)).collect()}
    assert [facts[i]["n_words"] for i in range(1, 6)] == [120_000, 120_001, 1, 1, 210_000] and facts[5]["n_dup_lines"] == 29_999 and facts[5]["n_repeat_words"] == 210_000
    assert facts[3]["word_chars"] == 1_000_000 and facts[3]["base_failed"] and facts[5]["base_failed"] and facts[1]["kept"]
    net = toxicity.Network(1)
    words = many.split()[:2000]
    parts = np.array([toxicity.Scorer(net).score([" ".join(words[a : a + toxicity.WINDOW])])[0] for a in toxicity.window_rows(len(words))])
    logits = np.log(parts / (1 - parts))
    assert toxicity.Scorer(net).score([" ".join(words), one])[0] == pytest.approx(1 / (1 + np.exp(-toxicity.pooled_logit(logits)[0])), abs=1e-4)
    turns = spark.createDataFrame([(1, 0, "user", many), (1, 1, "assistant", one + "<\\")], "conv_id long, turn long, role string, text string")
    got = chat.digests(chat.read_back(chat.chat_format(turns))).first()
    assert got["loss_chars"] == 1_000_002 and got["loss_sha256"] == hashlib.sha256((one + "<\\").encode()).hexdigest()
    assert licenses.scan_licenses(documents(spark, [(1, many + " MIT license", "s")])).first()["first_word"] == 120_000
