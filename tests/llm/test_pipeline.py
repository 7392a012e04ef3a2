"""The pipeline's stages against brute force."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from sparkloom.llm import common, components, mixing, tokens, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, rep string, content long, part int"
CLASH = (7, "r", 8, 9)


def filler(i, n=80):
    return " ".join(f"word{i}x{k}" for k in range(n))


@pytest.fixture(scope="module")
def rows():
    boiler = "Subscribe to our newsletter today"
    out = [(i, filler(i) + (f"\n{boiler}" if i < 24 else ""), "en", f"s{i % 2}" if i >= 24 else "s0", None) for i in range(40)]
    out += [(50, filler(1) + " extra", "en", "s1", 0), (51, None, None, None, None), (52, "short", "en", "s0", 5), (1, filler(1), "en", "s1", 0), (1, filler(1), "en", "s1", 0)]
    out += [(2, filler(60), "en", None, 1), (None, filler(60) + " more", "de", None, 2), (None, filler(61), "de", None, 2), (53, "", "en", "s1", 0), (54, "a b c " * 40, "en", "s1", 0), (55, boiler * 2, "en", "s0", 0), (56, filler(99, 9000), "en", "s1", 0)]
    out += [(300 + i, f"{filler(300 + i)} vile{i % 3}gunk vile{i % 3}gunk vile{i % 3}gunk", "en", "s1", None) for i in range(30)]
    return [(*r[:4], len(r[1] or ""), *CLASH) for r in out]


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    at = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{at}/documents.parquet")
    labels = [(i, 1, 0) for i in range(40)] + [(300 + i, 1, 1) for i in range(30)] + [(None, 1, 1), (3, None, None), (9999, 0, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def listed(df):
    return Counter((r["doc_id"], r["text"], r["source"]) for r in df.collect())


def clean(rows):
    """Quality rules by plain Python."""
    norm = lambda x: b" ".join(x.encode().lower().split())
    holders = defaultdict(set)
    for _, t, _, s, *_ in rows:
        for x in (t or "").split("\n"):
            if norm(x):
                holders[s, norm(x)].add(t)
    out = []
    for i, t, _, s, *_ in rows:
        words = WORD.findall(t or "")
        c = Counter(zip(words, words[1:], words[2:], strict=False))
        cover = {j for k in range(len(words) - 2) if c[tuple(words[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
        if len(words) < 50 or 100 * len(cover) > 50 * len(words):
            continue
        left = [x for x in t.split("\n") if not norm(x) or len(holders[s, norm(x)]) <= 20]
        kept = len(WORD.findall("\n".join(left)))
        if kept == len(words) or kept >= 20 and kept >= 0.3 * len(words):
            out.append((i, "\n".join(left), s))
    return out


def distinct(rows):
    """One row of each group at five words and 0.8, by plain Python."""
    def shingles(t):
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())

    sets, group = [shingles(t) for _, t, _ in rows], components.UnionFind()
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                group.union(a, b)
    by = defaultdict(list)
    for a, r in enumerate(rows):
        by[group.find(a) if sets[a] else ("alone", a)].append(r)
    return Counter(min(g, key=lambda r: (r[0] is None, r[0] or 0, r[2] or "")) for g in by.values())


def test_stages(spark, rows, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    schema = docs.schema.simpleString()
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality rules", "toxicity", "near duplicates", "mixing", "packing"]

    passed = common.written(stages["quality rules"](spark, docs, folder), "q")
    want = clean([r[:4] for r in rows])
    assert listed(passed) == Counter(want) and passed.schema.simpleString() == schema
    assert {r["n_chars"] == len(r["text"]) for r in passed.collect()} == {True}

    mild = common.written(stages["toxicity"](spark, passed, folder), "t")
    net = toxicity.trained(passed, common.table(spark, folder, "labels"))
    assert listed(mild) == Counter(r for r in want if plain_score(net, r[1]) < 0.5) and mild.schema.simpleString() == schema
    left = {r["doc_id"] for r in mild.collect()}
    assert len(set(range(40)) - left) <= 3 and len(left & set(range(300, 330))) <= 3

    single = common.written(stages["near duplicates"](spark, mild, folder), "n")
    assert listed(single) == distinct([(r["doc_id"], r["text"], r["source"]) for r in mild.collect()]) and single.schema.simpleString() == schema

    mixed = common.written(stages["mixing"](spark, single, folder), "m")
    size, taken, copies = Counter(), Counter(), listed(mixed)
    for i, t, s in listed(single):
        size[s] += len(WORD.findall(t))
    for (i, t, s), n in copies.items():
        taken[s] += n * len(WORD.findall(t))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    goal = mixing.targets([size[s] for s in order], [(5, 2, 1)[k % 3] for k in range(len(order))], 1.5, 2)
    longest = max(len(WORD.findall(t)) for _, t, _ in listed(single))
    assert set(copies) <= set(listed(single)) and max(copies.values()) <= 2 and mixed.schema.simpleString() == schema
    assert all(abs(taken[s] - g) <= longest for s, g in zip(order, goal, strict=True))

    packed = stages["packing"](spark, mixed, folder).collect()
    pieces = Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed)
    tokenizer, plain = tokens.memo(tokens.default_path()).tokenizer, Counter()
    for (i, t, _), n in copies.items():
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4")
        for p, k in enumerate(range(0, len(ids), 4096)):
            plain[i, p, k, len(ids[k : k + 4096]), zlib.crc32(ids[k : k + 4096].tobytes())] += n
    assert pieces == plain
    total = {r["sequence_id"] for r in packed}
    assert len(total) <= -(-sum(r["length"] for r in packed) // 4096) + 1


def plain_score(net, text):
    """A text's score, window by window and step by step."""
    words = toxicity.words_of(text)
    if net.constant is not None or not words:
        return net.constant or 0.0
    p, h = net.p, toxicity.HIDDEN
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    inputs = []
    for w in words:
        grams, _ = toxicity.gram_slots([w])
        inputs.append(np.concatenate([p["word"][toxicity.word_slot(w)], p["gram"][grams].mean(0)]).astype(float))
    logits = []
    for start in sorted({*range(0, max(1, len(words) - toxicity.WINDOW), toxicity.STRIDE), max(0, len(words) - toxicity.WINDOW)}):
        window = inputs[start : start + toxicity.WINDOW]
        states = np.zeros((len(window), 2 * h))
        for side, order in (("f", range(len(window))), ("b", reversed(range(len(window))))):
            state = np.zeros(h)
            for k in order:
                g, s = window[k] @ p["w" + side] + p["c" + side], state @ p["u" + side]
                z, r = sigmoid(g[:h] + s[:h]), sigmoid(g[h : 2 * h] + s[h : 2 * h])
                state = (1 - z) * np.tanh(g[2 * h :] + r * s[2 * h :]) + z * state
                states[k, (0 if side == "f" else h) : (h if side == "f" else 2 * h)] = state
        e = states @ p["attend"]
        a = np.exp(e - e.max())
        logits.append((a / a.sum()) @ states @ p["out"] + p["bias"][0])
    logits = np.array(logits)
    soft = np.exp(toxicity.SHARPNESS * (logits - logits.max()))
    return float(sigmoid(net.scale * (soft / soft.sum() * logits).sum() + net.shift))


def test_scores_equal_plain_scores(spark):
    r = np.random.default_rng(1)
    words = [f"{a}{b}" for a in "abcdefgh" for b in ("ing", "ed", "!", "é")]
    rows = [(" ".join(r.choice(words, int(r.integers(5, 90)))) + (" awful" if k % 2 else ""), k % 2) for k in range(60)]
    net = toxicity.train(rows, epochs=1)
    texts = [t for t, _ in rows[:12]] + ["", "one", " ".join(r.choice(words, 500)), " ".join(words[:32]), " ".join([*words[:32], "x"])]
    got = toxicity.Scorer(net, limit=20).score(texts)
    assert got == pytest.approx([plain_score(net, t) for t in texts], abs=1e-4)


def test_empty_tables(spark, folder, tmp_path):
    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).collect() == [], name
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_the_five_rows(spark, folder):
    a, b, c = filler(1), filler(2), filler(3)
    rows = [(1, a), (1, a), (2, a + " z"), (2, b), (3, c)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, *CLASH) for i, t in rows], SCHEMA)
    assert sorted((r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicate_stage(spark, docs, folder).collect()) == [(1, a), (2, b), (3, c)]
