"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

Inputs. A word enters as the sum of a hashed word embedding and the mean of its hashed
character n-gram embeddings, side by side, so unseen forms of known stems are seen.

Network. Gated recurrent units read each window of words in both directions; attention
pools their states; a linear layer gives the window's logit. A document's logit is
the mean of its windows' logits under a sharp softmax, close to the maximum, so a
single passage is enough. All overlapping windows of the whole text are scored.

Training. Back-propagation through time with Adam, on at most ``per_class`` labelled
documents of each class (smallest id hashes first), in one task, taken only from ids whose
crc32 mod 5 is not 0; the others are held out. Labels, language, source and id are never
inputs. The fitted parameters (about 1 MB, whatever the data) are broadcast.

Nulls: a null text is empty; a text without words scores 0. Null labels are not used.
Without labels of both classes every score is the share of label 1, or 0. Repeated
rows get equal rows. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import pickle
import uuid
from functools import partial
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW, STRIDE, HIDDEN = 32, 16, 8
WORDS, WORD_DIM, GRAMS, GRAM_DIM = 1 << 13, 8, 1 << 14, 12
#: Every ^word$ has a 2-gram, so no word is without grams.
GRAM_SIZES = (2, 3, 4, 5)
SHARPNESS = 4.0
#: Most labelled documents of each class that training reads.
PER_CLASS = 1200
#: Most bytes of them: one task holds the training texts.
CLASS_BYTES = 32_000_000
EPOCHS = 6
EMBEDDING_RATE, DECAY, DROPOUT = 2.0, 0.2, 0.5
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
_STRIP = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


def words_of(text: str) -> list[str]:
    return text.lower().split()


def word_slot(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.strip(_STRIP).encode()) % WORDS


def gram_slots(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character n-grams of ``^word$`` for all words in a row, and the number of each word's."""
    marked = [f"^{w.strip(_STRIP)}$" for w in words]
    joined = np.frombuffer("".join(marked).encode("utf-32-le"), "<u4").astype(np.uint64)
    length = np.fromiter(map(len, marked), np.int64, len(marked))
    word = np.repeat(np.arange(len(words)), length)
    own = [np.maximum(length - n + 1, 0) for n in GRAM_SIZES]
    counts = sum(own)
    # a word's n-grams lie together, sizes in order: place of its first of this size, less what precedes it in a size's list
    to = np.cumsum(counts) - counts
    out = np.empty(int(counts.sum()), np.int64)
    for n, many in zip(GRAM_SIZES, own, strict=True):
        if len(joined) >= n:
            h = np.full(len(joined) - n + 1, n, np.uint64)
            for i in range(n):
                h = (h ^ joined[i : len(joined) - n + 1 + i]) * np.uint64(0x100000001B3)
                h ^= h >> np.uint64(29)
            inside = word[: len(h)] == word[n - 1 :]
            place = np.repeat(to - (np.cumsum(many) - many), many)
            out[place + np.arange(len(place))] = h[inside] % np.uint64(GRAMS)
        to += many
    return out, counts


def window_rows(n: int) -> np.ndarray:
    """First words of the windows of n words: every STRIDE, the last one flush with the end."""
    if n <= WINDOW:
        return np.zeros(1 if n else 0, np.int64)
    starts = np.arange(0, n - WINDOW, STRIDE)
    return np.append(starts, n - WINDOW)


class Network:
    """Parameters; gates are kept as (update, reset, new), each HIDDEN wide."""

    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)
        d, h = WORD_DIM + GRAM_DIM, HIDDEN
        put = lambda *shape, scale: (r.standard_normal(shape) * scale).astype(np.float32)
        self.p = {"word": put(WORDS, WORD_DIM, scale=0.1), "gram": put(GRAMS, GRAM_DIM, scale=0.3), "attend": put(2 * h, scale=0.3), "out": put(2 * h, scale=0.5), "bias": np.zeros(1, np.float32)}
        for side in "fb":
            self.p |= {f"w{side}": put(d, 3 * h, scale=d**-0.5), f"u{side}": put(h, 3 * h, scale=h**-0.5), f"c{side}": np.zeros(3 * h, np.float32)}
        self.scale, self.shift, self.constant, self.name = 1.0, 0.0, None, uuid.uuid4().hex

    def features(self, slots: np.ndarray, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Inputs of distinct words."""
        at = np.cumsum(counts) - counts
        sums = np.add.reduceat(self.p["gram"][grams], at) if len(grams) else np.zeros((len(counts), GRAM_DIM), np.float32)
        return np.concatenate([self.p["word"][slots], sums / counts[:, None].astype(np.float32)], 1)

    def project(self, x: np.ndarray) -> np.ndarray:
        """Both directions' gate inputs of distinct words."""
        return np.concatenate([x @ self.p["wf"] + self.p["cf"], x @ self.p["wb"] + self.p["cb"]], 1)

    def run(self, gates: np.ndarray, rows: np.ndarray, mask: np.ndarray | None, keep: dict | None = None) -> np.ndarray:
        """Logits of windows: rows (windows, WINDOW) index ``gates``; mask tells real words where windows are padded.

        Both directions go at once: at step k the one reads word k, the other word k from the end.
        """
        n, t = rows.shape
        h = HIDDEN
        states, u = np.empty((t, n, 2 * h), np.float32), np.stack([self.p["uf"], self.p["ub"]])
        own = np.ascontiguousarray(gates[:, : 3 * h]), np.ascontiguousarray(gates[:, 3 * h :])
        state = np.zeros((2, n, h), np.float32)
        for k in range(t):
            g = np.stack([own[0][rows[:, k]], own[1][rows[:, t - 1 - k]]])
            s = np.matmul(state, u)
            zr = g[..., : 2 * h] + s[..., : 2 * h]
            zr *= 0.5
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            z, r = zr[..., :h], zr[..., h:]
            new = np.tanh(g[..., 2 * h :] + r * s[..., 2 * h :])
            if keep is not None:
                keep[k] = (state, z, r, new, s[..., 2 * h :])
            after = new + z * (state - new)
            if mask is not None:
                m = np.stack([mask[:, k], mask[:, t - 1 - k]])[..., None]
                after = after * m + state * (1 - m)
            state = after
            states[k, :, :h], states[t - 1 - k, :, h:] = state
        e = states @ self.p["attend"]
        if mask is not None:
            e = np.where(mask.T > 0, e, -1e9)
        a = np.exp(e - e.max(0))
        a /= a.sum(0)
        pooled = (states * a[:, :, None]).sum(0)
        if keep is not None:
            keep |= {"states": states, "a": a, "pooled": pooled}
        return pooled @ self.p["out"] + self.p["bias"][0]

    def logits(self, gates: np.ndarray, rows: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
        """As ``run``, without training's records and with a state's units as rows, so that every step is on whole arrays."""
        n, t = rows.shape
        h = HIDDEN
        states = np.empty((t, 2 * h, n), np.float32)
        for side, (first, order) in enumerate(((0, range(t)), (3 * h, range(t - 1, -1, -1)))):
            u = np.ascontiguousarray(self.p["uf" if side == 0 else "ub"].T)
            own = np.ascontiguousarray(gates[:, first : first + 3 * h])
            state, s = np.zeros((h, n), np.float32), np.empty((3 * h, n), np.float32)
            for k in order:
                g = np.ascontiguousarray(own[rows[:, k]].T)
                np.matmul(u, state, out=s)
                zr = g[: 2 * h]
                zr += s[: 2 * h]
                zr *= 0.5
                np.tanh(zr, out=zr)
                zr *= 0.5
                zr += 0.5
                new = s[2 * h :]
                new *= zr[h:]
                new += g[2 * h :]
                np.tanh(new, out=new)
                after = state - new
                after *= zr[:h]
                after += new
                state = after if mask is None else np.where(mask[:, k] > 0, after, state)
                states[k, side * h : (side + 1) * h] = state
        e = np.matmul(self.p["attend"], states)
        if mask is not None:
            e = np.where(mask.T > 0, e, np.float32(-1e9))
        a = np.exp(e - e.max(0))
        a /= a.sum(0)
        return (a * np.matmul(self.p["out"], states)).sum(0) + self.p["bias"][0]

    def backward(self, d_logit: np.ndarray, rows: np.ndarray, mask: np.ndarray, keep: dict, n_words: int) -> tuple[dict, np.ndarray]:
        """Gradients of the parameters, and of the distinct words' gate inputs."""
        h, t = HIDDEN, rows.shape[1]
        states, a, pooled = keep["states"], keep["a"], keep["pooled"]
        g = {"out": pooled.T @ d_logit, "bias": np.array([d_logit.sum()], np.float32)}
        d_pooled = d_logit[:, None] * self.p["out"][None, :]
        d_a = (states * d_pooled[None]).sum(2)
        d_e = a * (d_a - (a * d_a).sum(0))
        g["attend"] = np.tensordot(d_e, states, ([0, 1], [0, 1]))
        d_states = a[:, :, None] * d_pooled[None] + d_e[:, :, None] * self.p["attend"]
        u = np.stack([self.p["uf"], self.p["ub"]])
        g_u, carry, steps = np.zeros_like(u), np.zeros((2, len(rows), h), np.float32), np.empty((t, len(rows), 6 * h), np.float32)
        for k in reversed(range(t)):
            before, z, r, new, sn = keep[k]
            d = carry + np.stack([d_states[k, :, :h], d_states[t - 1 - k, :, h:]])
            m = np.stack([mask[:, k], mask[:, t - 1 - k]])[..., None]
            d_after, d_before = d * m, d * (1 - m)
            d_new = d_after * (1 - z) * (1 - new * new)
            d_z = d_after * (before - new) * z * (1 - z)
            d_r = d_new * sn * r * (1 - r)
            d_s = np.concatenate([d_z, d_r, d_new * r], 2)
            g_u += np.matmul(before.transpose(0, 2, 1), d_s)
            carry = d_before + d_after * z + np.matmul(d_s, u.transpose(0, 2, 1))
            d_s[..., 2 * h :] = d_new
            steps[k, :, : 3 * h], steps[t - 1 - k, :, 3 * h :] = d_s
        g["uf"], g["ub"] = g_u
        return g, summed(rows.T.ravel(), steps.reshape(-1, 6 * h), n_words)


def summed(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """n rows, each the sum of the values that are ``at`` it."""
    out = np.empty((values.shape[1], n), np.float32)
    for column, total in zip(np.ascontiguousarray(values.T, np.float64), out, strict=True):
        total[:] = np.bincount(at, column, n)
    return out.T


def pooled_logit(logits: np.ndarray) -> tuple[float, np.ndarray]:
    """A document's logit, and its derivative by each window's."""
    p = np.exp(SHARPNESS * (logits - logits.max()))
    p /= p.sum()
    s = float((p * logits).sum())
    return s, p * (1 + SHARPNESS * (logits - s))


def train(rows: list[tuple[str, int]], epochs: int = EPOCHS, batch: int = 32, rate: float = 0.01, seed: int = 3) -> Network:
    """Fit to (text, label) rows."""
    net = Network(seed)
    index: dict[str, int] = {}
    coded = []
    for text, y in rows:
        if words := words_of(text or ""):
            ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int32, len(words))
            at = window_rows(len(ids))
            place = at[:, None] + np.arange(WINDOW)[None, :]
            coded.append((ids[np.minimum(place, len(ids) - 1)], place < len(ids), y))
    share = sum(y for _, y in rows) / len(rows) if rows else 0.0
    if len({c[2] for c in coded}) < 2:
        net.constant = share
        return net
    names = list(index)
    slots = np.fromiter(map(word_slot, names), np.int16, len(names))
    parts = [gram_slots(names[k : k + 8192]) for k in range(0, len(names), 8192)]
    grams, counts = np.concatenate([p[0].astype(np.int16) for p in parts]), np.concatenate([p[1] for p in parts])
    del index, names, parts
    begin = np.cumsum(counts) - counts
    ratio = float(np.mean([c[2] for c in coded]))
    weight = {1: 0.5 / ratio, 0: 0.5 / (1 - ratio)}
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    r, step = np.random.default_rng(seed), 0
    steps = max(epochs * -(-len(coded) // batch), 150)  # few documents are seen more often
    order: list[int] = []
    for step in range(1, steps + 1):
        if len(order) < min(batch, len(coded)):
            order += r.permutation(len(coded)).tolist()
        picked, order = order[:batch], order[batch:]
        part = [coded[i] for i in picked]
        rows_, mask = np.concatenate([p[0] for p in part]), np.concatenate([p[1] for p in part]).astype(np.float32)
        words, inverse, own, own_counts = distinct(rows_, grams, begin, counts)
        x = net.features(slots[words], own, own_counts)
        drop = (r.random(x.shape, np.float32) >= DROPOUT).astype(np.float32) / (1 - DROPOUT)
        x *= drop
        keep: dict = {}
        logits = net.run(net.project(x), inverse, mask, keep)
        d_logit, k = np.zeros(len(rows_), np.float32), 0
        for p in part:
            n = len(p[0])
            s, slope = pooled_logit(logits[k : k + n])
            d_logit[k : k + n] = (1 / (1 + np.exp(-s)) - p[2]) * weight[p[2]] * slope / len(part)
            k += n
        g, d_gates = net.backward(d_logit, inverse, mask, keep, len(words))
        h = 3 * HIDDEN
        g |= {"wf": x.T @ d_gates[:, :h], "wb": x.T @ d_gates[:, h:], "cf": d_gates[:, :h].sum(0), "cb": d_gates[:, h:].sum(0)}
        d_x = d_gates[:, :h] @ net.p["wf"].T + d_gates[:, h:] @ net.p["wb"].T
        d_x *= drop
        for name, at_, value in (("word", slots[words], d_x[:, :WORD_DIM]), ("gram", own, np.repeat(d_x[:, WORD_DIM:] / own_counts[:, None].astype(np.float32), own_counts, 0))):
            g[name] = summed(at_, value, len(net.p[name]))
        norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
        clip = min(1.0, 5.0 / max(norm, 1e-9))
        lr = rate * min(1.0, 2.0 * (1 - (step - 1) / steps) + 0.05)
        for name, v in g.items():
            m, q = moments[name]
            v = v * clip
            if name in ("word", "gram"):
                # one scale for a whole table: what is rare moves little, so single words are not learnt by heart
                m += 0.1 * (v - m)
                q += 0.01 * (float((v * v).sum()) / max(1, np.count_nonzero(v.any(1)) * v.shape[1]) - q)
                net.p[name] -= (EMBEDDING_RATE * lr * (m / (1 - 0.9**step)) / (np.sqrt(q / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
                net.p[name] *= 1 - DECAY * lr
                continue
            m += 0.1 * (v - m)
            q += 0.01 * (v * v - q)
            net.p[name] -= (lr * (m / (1 - 0.9**step)) / (np.sqrt(q / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    calibrate(net, coded, slots, grams, begin, counts)
    return net


def distinct(rows: np.ndarray, grams: np.ndarray, begin: np.ndarray, counts: np.ndarray) -> tuple:
    """Distinct words of windows, the windows in terms of them, and their n-grams."""
    words, inverse = np.unique(rows, return_inverse=True)
    n = counts[words]
    own = grams[np.repeat(begin[words] - (np.cumsum(n) - n), n) + np.arange(n.sum())].astype(np.int64)
    return words, inverse.reshape(rows.shape), own, n


def calibrate(net: Network, coded: list, slots, grams, begin, counts) -> None:
    """Scale and shift of document logits by regularised logistic regression on the training documents."""
    s = np.empty(len(coded))
    for k, (rows, mask, _) in enumerate(coded):
        words, inverse, own, n = distinct(rows, grams, begin, counts)
        s[k] = pooled_logit(net.run(net.project(net.features(slots[words], own, n)), inverse, mask.astype(np.float32)))[0]
    y = np.array([c[2] for c in coded], float)
    w = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * s + b, -30, 30)))
        ga, gb = (w * (p - y) * s).sum() + 0.01 * (a - 1), (w * (p - y)).sum()
        v = w * p * (1 - p) + 1e-9
        haa, hab, hbb = (v * s * s).sum() + 0.01, (v * s).sum(), v.sum() + 1e-6
        det = haa * hbb - hab * hab
        a, b = a - np.clip((hbb * ga - hab * gb) / det, -1, 1), b - np.clip((haa * gb - hab * ga) / det, -1, 1)
    net.scale, net.shift = max(float(a), 0.05), float(b)


class Scorer:
    """Scores texts; gate inputs of words are remembered, ``limit`` words at most besides those of one call."""

    def __init__(self, net: Network, limit: int = 150_000):
        self.net, self.limit = net, limit
        self.index: dict[str, int] = {}
        self.gates = np.zeros((1 << 12, 6 * HIDDEN), np.float32)

    def learn(self, words: list[str]) -> None:
        n, rows = len(self.index), len(self.gates)
        if n + len(words) > rows:
            rows = max(n + len(words), min(2 * rows, self.limit))
            self.gates = np.concatenate([self.gates[:n], np.zeros((rows - n, self.gates.shape[1]), np.float32)])
        for k in range(0, len(words), 8192):
            part = words[k : k + 8192]
            grams, counts = gram_slots(part)
            slots = np.fromiter(map(word_slot, part), np.int64, len(part))
            self.gates[n + k : n + k + len(part)] = self.net.project(self.net.features(slots, grams, counts))
        self.index.update(zip(words, range(n, n + len(words)), strict=True))

    def score(self, items: list[str]) -> np.ndarray:
        if self.net.constant is not None:
            return np.full(len(items), float(self.net.constant))
        split = [words_of(t) for t in items]
        flat = [w for ws in split for w in ws]
        ids = np.fromiter(map(self.index.get, flat, repeat(-1)), np.int64, len(flat))
        if (ids < 0).any():
            new = list({flat[i] for i in np.flatnonzero(ids < 0).tolist()})
            if len(self.index) + len(new) > self.limit:
                self.index = {}
                new = list(set(flat))
            self.learn(new)
            ids = np.fromiter(map(self.index.__getitem__, flat), np.int64, len(flat))
        first = np.cumsum([0, *map(len, split)])
        windows = [window_rows(len(ws)) for ws in split]
        count = np.array([len(w) for w in windows])
        edge = np.concatenate([[0], np.cumsum(count)])
        doc = np.repeat(np.arange(len(items)), count)
        start = np.concatenate([w + first[d] for d, w in enumerate(windows)]) if len(doc) else np.empty(0, np.int64)
        short = np.diff(first)[doc] < WINDOW
        logits, gates = np.empty(len(doc), np.float32), self.gates[: len(self.index)]
        for rows, padded in ((np.flatnonzero(~short), False), (np.flatnonzero(short), True)):
            for k in range(0, len(rows), 2048):
                r = rows[k : k + 2048]
                place = start[r][:, None] + np.arange(WINDOW)[None, :]
                if padded:
                    end = first[doc[r] + 1][:, None]
                    logits[r] = self.net.logits(gates, ids[np.minimum(place, end - 1)], place < end)
                else:
                    logits[r] = self.net.logits(gates, ids[place], None)
        out = np.zeros(len(items))
        for d in np.flatnonzero(count).tolist():
            s = pooled_logit(logits[edge[d] : edge[d + 1]].astype(float))[0]
            out[d] = 1 / (1 + np.exp(-np.clip(self.net.scale * s + self.net.shift, -30, 30)))
        return out


def held_out(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


SAMPLE = "doc_id long, text string, toxic int"


def training_sample(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, class_bytes: int = CLASS_BYTES) -> DataFrame:
    """SAMPLE rows: at most ``per_class`` labelled texts of each class with ``class_bytes`` bytes (but the first), none of them held out."""
    spark = docs.sparkSession
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    own = own.where(~held_out(F.col("doc_id")))
    present = own.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_semi")
    chosen: dict[int, int] = {}
    for y in (0, 1):
        for r in present.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).collect():
            chosen[r["doc_id"]] = y
    ids = F.broadcast(common.local(spark, list(chosen.items()), "l_id long, toxic int"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = common.written(texts.join(ids, F.col("doc_id") == F.col("l_id")).select("doc_id", "text", "toxic", F.xxhash64("text").alias("content")), "labelled")
    rows, held = [], {0: 0, 1: 0}
    for r in found.select("doc_id", "content", "toxic", F.octet_length("text").alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id", "content").collect():
        if not held[r["toxic"]] or held[r["toxic"]] + r["n"] <= class_bytes:
            held[r["toxic"]] += r["n"]
            rows.append((r["doc_id"], r["content"]))
    wanted = F.broadcast(common.local(spark, rows, "w_id long, w_content long").distinct())
    return found.join(wanted, (F.col("doc_id") == F.col("w_id")) & (F.col("content") == F.col("w_content")), "left_semi").select("doc_id", "text", "toxic")


def _fit(batches):
    rows = sorted((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)), key=lambda r: r[:2])
    if rows:
        common.held("training", object)  # nothing is kept, but what an earlier operator kept goes
        fitted = pickle.dumps(train([r[1:] for r in rows]))
        del rows
        common.trim()
        yield pa.RecordBatch.from_arrays([pa.array([fitted], pa.binary())], ["network"])


def trained(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Network:
    """Fitted by one task, which is done again if its executor is lost; the driver sees parameters only."""
    common.small_batches(docs.sparkSession)
    fitted = training_sample(docs, labels, per_class).coalesce(1).mapInArrow(_fit, "network binary").collect()
    return pickle.loads(fitted[0]["network"]) if fitted else train([])


def _scorer(sent) -> Scorer:
    """The worker's scorer for a broadcast network, kept between tasks."""
    net = sent.value
    return common.held(f"toxicity {net.name}", lambda: Scorer(net))


def _score(batches, sent):
    for batch in batches:
        items = [t or "" for t in batch.column(2).to_pylist()]
        scores = [_scorer(sent).score(items[a:b]) for a, b in common.chunks(items, 1 << 19)]
        s = np.concatenate(scores) if scores else np.empty(0)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])


def score_documents(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """One row per document, see SCHEMA."""
    spark = docs.sparkSession
    common.small_batches(spark)
    sent = spark.sparkContext.broadcast(trained(docs, labels, per_class))
    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), F.col("text").cast("string")).mapInArrow(partial(_score, sent=sent), SCHEMA)


def _filter(batches, sent, place: int, limit: float):
    for batch in batches:
        items = [t or "" for t in batch.column(place).to_pylist()]
        scores = [_scorer(sent).score(items[a:b]) for a, b in common.chunks(items, 1 << 19)]
        if scores:
            yield batch.filter(pa.array(np.concatenate(scores) < limit))


def non_toxic(docs: DataFrame, net: Network, limit: float = 0.5) -> DataFrame:
    """The documents that score below the limit, with all their columns, without a join."""
    spark = docs.sparkSession
    common.small_batches(spark)
    sent = spark.sparkContext.broadcast(net)
    return docs.mapInArrow(partial(_filter, sent=sent, place=docs.columns.index("text"), limit=limit), docs.schema)
