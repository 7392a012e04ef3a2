"""Near-duplicate documents by SuperMinHash, banding, exact verification and union-find.

1. Signatures. A document's word shingles are hashed to 64 bits. Each shingle
   draws a random permutation of the signature's slots step by step and puts
   step + fraction into the slot it reaches; a slot keeps its minimum (Ertl,
   2017). Values of step j are below those of step j + 1, so drawing stops as soon as
   every slot is filled: for most documents after one or two steps.
2. Every row has a number of its own. Rows with equal shingle sets form a class; its smallest
   number stands for it.
3. Slots are banded; representatives that share a band meet in a bucket. In each of
   a few rounds a bucket has one hub (first the document that meets most others), and every document that meets hubs of other
   components is compared with one of them: one pair a document. Set sizes and
   whole-signature agreement sift the pairs, full sets decide, links merge components.
4. Documents in buckets that are still not of one component are compared in full. Buckets are cut
   into blocks, whose signatures alone are compared first; a spanning forest of the pairs
   that may be similar leaves a task. The forests' components are compared with full
   sets, block by block, and only links leave. Most near copies are one component by then, and
   no pair is ever a row.
5. Components of the verified links give the groups.

The only loss is a pair that shares no band: with 42 bands of 6 slots that is
3e-6 of the pairs at similarity 0.8 exactly, and less above.

Nulls and empty texts: no shingles, linked with nothing. Repeated rows, and rows that share an
id but not a text, are rows of their own. Rows with a null id take part, but cannot name a
group. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import UnionFind, components
from .textcore import U64, Chunk, mix, shingle_set

BANDS, ROWS = 42, 6
#: Signature agreement below similarity minus this margin (almost 8 standard errors) is not verified.
MARGIN = 0.2
#: Rounds of one pair a document before the rest is compared in full; a round that leaves more than this share of the bucket entries is the last.
ROUNDS, FRUITLESS = 4, 0.75
#: Documents, and bytes of their sets, that a block of a cluster holds at most on average.
BLOCK_ROWS, BLOCK_BYTES = 1024, 1 << 24
_GOLD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
SIGNATURES = "row long, doc_id long, content long, n long, set_a long, set_b long, bands array<long>, sketch binary"


def superminhash(elements: np.ndarray, slots: int) -> np.ndarray:
    """Slot minima of a non-empty set of distinct 64-bit hashes; slots <= 256."""
    n = len(elements)
    h = np.full(slots, _MASK, U64)
    permutation, first, rows = None, None, None
    for j in range(slots):
        x = mix(elements + U64(j * _GOLD & _MASK))
        at = (((x & U64(0xFFFFFFFF)) * U64(slots - j)) >> U64(32)).astype(np.int64) + j
        value = (x >> U64(32)) | U64(j << 32)
        if j == 0:
            slot = first = at
        else:
            if permutation is None:
                rows = np.arange(n) * slots
                permutation = np.tile(np.arange(slots, dtype=np.uint8), n)
                permutation[rows + first] = 0
            slot = permutation[rows + at]
            permutation[rows + at] = permutation[rows + j]
        np.minimum.at(h, slot, value)
        if int(h.max()) < (j + 1) << 32:
            break
    return h


def band_keys(h: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.arange(1, bands + 1, dtype=U64) * U64(_GOLD)
    for r in range(rows):
        out = mix(out + h[: bands * rows].reshape(bands, rows)[:, r])
    return out.view(np.int64)


def sets_of(items: list[bytes], k: int):
    """Sorted distinct shingle hashes of each text."""
    for a, b in common.chunks(items):
        chunk = Chunk(items[a:b], lower=True)
        h = chunk.word_hashes()
        for d in range(b - a):
            yield shingle_set(h[chunk.first[d] : chunk.first[d + 1]], k)


def _sign(batches, k: int, bands: int, rows: int):
    common.held("minhash", object)  # nothing is kept, but what an earlier operator kept goes
    row = TaskContext.get().partitionId() << 33
    for batch in batches:
        out: list[tuple] = []
        for doc_id, content, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), sets_of(common.texts(batch.column(2)), k), strict=True):
            if len(s):
                h = superminhash(s, bands * rows)
                a, b = int(np.bitwise_xor.reduce(mix(s))), int(mix(s + U64(_GOLD)).sum(dtype=U64))
                out.append((row, doc_id, content, len(s), a - (a >> 63 << 64), b - (b >> 63 << 64), band_keys(h, bands, rows), (mix(h) & U64(255)).astype(np.uint8).tobytes()))
            else:
                out.append((row, doc_id, content, 0, 0, 0, None, None))
            row += 1
        if out:
            types = (*[pa.int64()] * 6, pa.list_(pa.int64()), pa.binary())
            names = [x.split()[0] for x in SIGNATURES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names)


def _sets(batches, k: int):
    for batch in batches:
        found = [s.tobytes() for s in sets_of(common.texts(batch.column(1)), k)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["node", "items"])


def _verify(batches, percent: int):
    for batch in batches:
        keep = [similar(np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64), percent) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _sift(batches, least: float):
    for batch in batches:
        n = len(batch)
        if n:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(n, -1) for c in (2, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array((x == y).mean(1) >= least))


def _sketches(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(len(column), -1)


class Block:
    """Two blocks of a group of documents, or one block with itself: rows with their part, block, size and signature."""

    def __init__(self, part: np.ndarray, own: np.ndarray, n: np.ndarray, sketch: np.ndarray, percent: int):
        self.part, self.own, self.n, self.sketch, self.percent = part, own, n, sketch, percent
        self.between = len(own) > 0 and own.min() != own.max()
        self.end = np.searchsorted(100 * n, 100 * n * 100 // percent + 1, "right")  # sizes up to n * 100 / percent

    def near(self, i: int) -> list[int]:
        """Rows after i (rows are in order of size) of another part, and of the other block if there are two, that may be similar to it."""
        rows = np.arange(i + 1, self.end[i])
        rows = rows[(self.part[rows] != self.part[i]) & ((self.own[rows] != self.own[i]) if self.between else True)]
        if not len(rows):
            return []
        return rows[(self.sketch[rows] == self.sketch[i]).mean(1) >= self.percent / 100 - MARGIN].tolist()


def _block(key, frame: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links between the parts of two blocks of a cluster, or inside one."""
    frame = frame.sort_values(["n", "rep"], kind="stable")
    part, rep = frame["part"].to_numpy(), frame["rep"].to_numpy()
    block = Block(part, frame["own"].to_numpy(), frame["n"].to_numpy(), _sketches(frame["sketch"]), percent)
    items = [np.frombuffer(x, U64) for x in frame["items"]]
    joined, out = UnionFind(), []
    for i in range(len(frame)):
        for j in block.near(i):
            if joined.find(int(part[i])) != joined.find(int(part[j])) and similar(items[i], items[j], percent):
                joined.union(int(part[i]), int(part[j]))
                out.append((int(rep[i]), int(rep[j])))
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _forest(batches, percent: int):
    """Of rows in order of (key, lo, hi): a spanning forest of the pairs in each block that may be similar."""

    def pairs(table: pa.Table):
        if len(table) < 2:
            return
        table = table.sort_by([("n", "ascending"), ("rep", "ascending")])
        rep = table["rep"].to_pylist()
        block = Block(*(table[c].to_numpy() for c in ("part", "own", "n")), _sketches(table["sketch"].to_pylist()), percent)
        joined = UnionFind()
        for i in range(len(rep)):
            for j in block.near(i):
                if joined.find(i) != joined.find(j):
                    joined.union(i, j)
                    yield rep[i], rep[j]

    for table in common.runs(batches, ["key", "lo", "hi"]):
        if found := list(pairs(table)):
            a, b = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def similar(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    """Exact similarity of two sorted sets of distinct hashes."""
    if 100 * min(len(p), len(q)) < percent * max(len(p), len(q)):
        return False
    both = np.sort(np.concatenate([p, q]))
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * shared >= percent * (len(p) + len(q) - shared)


def picked(table: DataFrame, on: str, ids: DataFrame) -> DataFrame:
    """Rows of a table whose ``on`` is among the ids (one distinct column, already written)."""
    return table.join(common.small(ids.toDF(on)), on, "left_semi")


class Comparison:
    """What pairs of representatives are compared by."""

    def __init__(self, traits: DataFrame, sets: DataFrame, percent: int):
        self.traits, self.sets, self.percent = traits, sets, percent

    def links(self, pairs: DataFrame) -> DataFrame:
        """Of distinct pairs (a, b) those that reach the similarity."""
        pairs = common.written(pairs, "pairs")
        ids = pairs.select("a").union(pairs.select("b")).distinct()
        traits = picked(self.traits, "node", common.written(ids, "ids"))
        sifted = pairs.join(traits.toDF("a", "n_a", "s_a"), "a").join(traits.toDF("b", "n_b", "s_b"), "b")
        sifted = sifted.where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * self.percent).select("a", "b", "s_a", "s_b")
        near = common.written(sifted.mapInArrow(partial(_sift, least=self.percent / 100 - MARGIN), "a long, b long"), "sifted")
        ids = near.select("a").union(near.select("b")).distinct()
        sets = picked(self.sets, "node", common.written(ids, "ids"))
        full = near.join(sets.toDF("b", "y"), "b").join(sets.toDF("a", "x"), "a").select("a", "b", "x", "y")
        return full.mapInArrow(partial(_verify, percent=self.percent), "a long, b long")

    def rest(self, members: DataFrame) -> DataFrame:
        """Spanning links (a, b) between parts among documents that share a bucket (key, rep, part).

        A bucket is cut into blocks of bounded rows and every two of them are compared by size and
        signature; what may be similar makes clusters. A cluster is cut into blocks of bounded
        rows and bytes, and every two of them are compared by full sets too.
        """
        ids = common.written(members.select("rep").distinct(), "ids")
        traits = common.written(picked(self.traits, "node", ids).toDF("rep", "n", "sketch"), "sketches")
        blocks = common.written(members.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks")), "sizes")
        dealt = self.dealt(members.join(common.small(traits, 10), "rep"), blocks, "key").select("key", "lo", "hi", "rep", "part", "own", "n", "sketch")
        ordered = dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
        near = common.written(ordered.mapInArrow(partial(_forest, percent=self.percent), "a long, b long"), "forest")

        clusters = common.written(components(near).toDF("rep", "cluster"), "clusters")
        ids = clusters.select("rep")
        full = members.select("rep", "part").distinct().join(common.small(clusters), "rep").join(common.small(traits, 10), "rep").join(picked(self.sets, "node", ids).toDF("rep", "items"), "rep")
        full = common.written(full, "rest")
        blocks = full.groupBy("cluster").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("s")).select("cluster", F.ceil(F.greatest(F.col("m") / BLOCK_ROWS, F.col("s") * 8 / BLOCK_BYTES)).cast("int").alias("blocks"))
        dealt = self.dealt(full, common.written(blocks, "blocks"), "cluster").select("cluster", "lo", "hi", "own", "rep", "part", "n", "sketch", "items")
        return dealt.groupBy("cluster", "lo", "hi").applyInPandas(partial(_block, percent=self.percent), "a long, b long")

    @staticmethod
    def dealt(rows: DataFrame, blocks: DataFrame, key: str) -> DataFrame:
        """Rows to every two blocks of their group that hold them: own block, and the pair (lo, hi)."""
        own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
        dealt = rows.join(common.small(blocks), key).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        return dealt.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")})


def relabelled(label: DataFrame, links: DataFrame) -> DataFrame:
    """Components (node, component) after more links."""
    sides = links.join(label.toDF("a", "c_a"), "a", "left").join(label.toDF("b", "c_b"), "b", "left").select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b"))
    merged = components(sides)
    moved = label.join(merged.toDF("component", "whole"), "component", "left").select("node", F.coalesce("whole", "component").alias("component"))
    new = merged.join(label.select("node"), "node", "left_anti").select("node", "component")
    return common.written(moved.union(new), "components")


def grouped(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row a document: row, doc_id, content, n and grp.

    ``content`` is xxhash64 of the text, n the number of shingles; ``grp`` is the least row of the group, or null for a
    document without any other of its group.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    text = F.col("text").cast("string")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("content"), text.alias("text"))
    signed = common.written(texts.mapInArrow(partial(_sign, k=k, bands=bands, rows=rows), SIGNATURES), "signatures")
    worded = signed.where("n > 0")
    copies = worded.groupBy("set_a", "set_b", "n").agg(F.min("row").alias("rep"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies")
    same = [F.col(f"s.{c}") == F.col(f"c.{c}") for c in ("set_a", "set_b", "n")]
    classed = worded.alias("s").join(common.small(common.written(copies, "copies")).alias("c"), same, "left").select("s.row", "s.doc_id", "s.content", "s.n", "s.bands", "s.sketch", F.col("c.rep").alias("copy_of"))
    first = F.col("copy_of").isNull() | (F.col("copy_of") == F.col("row"))
    classed = common.written(classed.withColumns({c: F.when(first, F.col(c)) for c in ("bands", "sketch")}), "classes")
    reps = classed.where(F.col("bands").isNotNull()).withColumnRenamed("row", "rep")

    buckets = reps.select(F.explode("bands").alias("key"), "rep")
    shared = buckets.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("top"), F.count(F.lit(1)).alias("size")).where("low <> top").select("key", "size")
    shared = common.written(shared, "shared")
    met = common.written(buckets.join(common.small(shared), "key").select("key", "rep", "size"), "buckets")
    # the first hub is the document that meets most others: of a group of edited copies the least edited
    degree = common.written(met.groupBy("rep").agg(F.sum("size").alias("degree")), "degrees")
    wanted = common.written(reps.select("rep", "doc_id", "content").join(common.small(degree.select("rep")), "rep", "left_semi"), "ids").toDF("node", "w_id", "w_content")
    own = F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("content") == F.col("w_content"))
    sets = common.written(texts.join(common.small(wanted), own).select("node", "text").mapInArrow(partial(_sets, k=k), "node long, items binary"), "sets")
    if sets.count() > wanted.count():  # rows that are repeated, id and text
        sets = common.written(sets.dropDuplicates(["node"]), "sets")
    compare = Comparison(reps.select(F.col("rep").alias("node"), F.col("n").alias("size"), "sketch"), sets, percent)

    label = common.local(spark, [], "node long, component long")
    met, before = met.select("key", "rep"), 0
    for turn in range(ROUNDS + 1):
        placed = met.join(common.small(label), met["rep"] == label["node"], "left").select("key", "rep", F.coalesce("component", "rep").alias("part"))
        mixed = common.written(placed.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("top")).where("low <> top").select("key"), "mixed")
        members = common.written(placed.join(common.small(mixed), "key").select("key", "rep", "part"), "members")
        met, left = members.select("key", "rep"), members.count()
        if turn == ROUNDS or not left or turn and left > FRUITLESS * before:
            break
        before = left
        order = F.xxhash64(F.lit(turn), "rep") if turn else -F.col("degree")
        chosen = members if turn else members.join(common.small(degree), "rep")
        hubs = chosen.groupBy("key").agg(F.min(F.struct(order.alias("h"), F.col("rep").alias("hub"), F.col("part").alias("hub_part"))).alias("x"))
        facing = members.join(common.small(common.written(hubs, "hubs")), "key").where("part <> x.hub_part").groupBy("rep").agg(F.min(F.struct("x.h", "x.hub")).alias("y"))
        label = relabelled(label, compare.links(facing.select(F.least("rep", "y.hub").alias("a"), F.greatest("rep", "y.hub").alias("b")).distinct()))

    linked = relabelled(label, compare.rest(members)) if not members.isEmpty() else label
    rep = F.coalesce("copy_of", "row")
    out = classed.join(common.small(linked), rep == F.col("node"), "left").select("row", "doc_id", "content", "n", F.coalesce("component", "copy_of").alias("grp"))
    empty = signed.where("n = 0").select("row", "doc_id", "content", "n", F.lit(None).cast("long").alias("grp"))
    return common.written(out.union(empty), "groups")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, kept."""
    found = grouped(docs, k, percent, bands, rows)
    names = common.written(found.where("grp is not null").groupBy(F.col("grp").alias("named")).agg(F.min("doc_id").alias("component_id")), "names")
    alone = found.where("grp is null").withColumn("component_id", F.col("doc_id"))
    others = found.where("grp is not null").join(common.small(names), F.col("grp") == F.col("named")).drop("named")
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    return alone.unionByName(others).select("doc_id", F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"))


def distinct_documents(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """The documents, one row of each group, with all columns of ``docs``.

    Of a group the row with the smallest id stays (rows without an id come last, then the smallest hash of the text decides);
    of rows that share id and text, the one whose columns are first as JSON text. Rows without words all stay.
    """
    found = grouped(docs, k, percent, bands, rows).where("grp is not null")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "content")
    stays = found.groupBy("grp").agg(F.min(order).alias("x"), F.count(F.lit(1)).alias("rows")).select(F.col("grp").alias("s_grp"), "x")
    stays = common.written(stays, "stays")
    stay = F.col("doc_id").eqNullSafe(F.col("x.doc_id")) & (F.col("content") == F.col("x.content"))
    judged = found.join(common.small(stays), F.col("grp") == F.col("s_grp")).groupBy("doc_id", "content").agg(F.first(stay).alias("stay"), F.count(F.lit(1)).alias("rows"))
    x = common.fresh(docs, "near_")
    judged = common.written(judged.toDF(f"{x}id", f"{x}content", f"{x}stay", f"{x}rows").where(f"not {x}stay or {x}rows > 1"), "judged")
    own = F.col("doc_id").cast("long").eqNullSafe(F.col(f"{x}id")) & (F.xxhash64(F.col("text").cast("string")) == F.col(f"{x}content"))
    out = docs.join(common.small(judged), own, "left_anti")
    repeated = judged.where(f"{x}stay")
    if not repeated.isEmpty():
        one = docs.join(common.small(repeated), own).groupBy(f"{x}id", f"{x}content").agg(F.min_by(F.struct(*docs.columns), F.to_json(F.struct(*docs.columns))).alias(f"{x}row"))
        out = out.union(one.select(f"{x}row.*"))
    return out
