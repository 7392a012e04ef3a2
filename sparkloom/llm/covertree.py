"""Embedding near-duplicates by dual traversal of cover trees.

Equal vectors of a label form a class with one representative. The top levels of the tree
are built by rounds over all labels at once: a cell (at first a label) of more than ``block``
vectors draws up to ``fan`` pivots by hash and every vector goes home to its nearest one.
It is also a guest in the cell of another pivot if a vector at home there can be near
enough: its distance to that pivot is at most that to its nearest plus twice the
threshold distance, and at most the cell's radius plus the threshold distance. Of two cells only
the one with the higher number sends guests, so a pair meets once. Cells are rows of tables:
nothing about labels or cells goes to the driver.

In a cell, blocks of bounded size are compared: each gets a cover tree, nested levels whose radii
halve, each node with its real covering radius. Pairs of nodes are walked from the
top: pruned when too far apart for any link, taken whole when so close that all
their pairs are links, else opened. What is left is decided by the cosine in
double precision, so the links are exactly the pairs at or above the threshold. Links
leave a task as counts per vector and a spanning forest, never as pairs. A cell so small that
all its vectors are linked needs no comparison.

Nulls: a vector that is null, zero, or has null or non-finite components, and a row
without a label, is linked with nothing. Vectors of other lengths are not
compared. Rows that share an id are one node for components. An empty table gives
no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

BLOCK, FAN, LEAF = 2048, 64, 24
#: Rounds of splitting cells; what is still large then is compared by blocks.
LEVELS = 8
#: Vectors of one cell that a task splits.
CHUNK = 1 << 16
SLACK = 1e-6
FOUND = "a long, b long, links long"
PLACES = "cell string, home boolean, rep long, n long, salt long, vec binary, gap double"


class Node:
    __slots__ = ("center", "radius", "members", "children")

    def __init__(self, center: int, radius: float, members: np.ndarray, children: list[Node]):
        self.center, self.radius, self.members, self.children = center, radius, members, children


class CoverTree:
    """Over the rows of a matrix of unit vectors."""

    def __init__(self, unit: np.ndarray):
        self.unit = unit
        everyone = np.arange(len(unit))
        self.root = self.build(everyone, 0, self.gaps(0, everyone), 2.0) if len(unit) else None

    def gaps(self, center: int, rows: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, 2 - 2 * (self.unit[rows] @ self.unit[center])))

    def build(self, rows: np.ndarray, center: int, gap: np.ndarray, cover: float) -> Node:
        radius = float(gap.max())
        if len(rows) <= LEAF or radius <= SLACK:
            return Node(center, radius, rows, [])
        while cover / 2 >= radius:
            cover /= 2
        half, children = cover / 2, []
        while len(rows):
            near = gap <= half
            children.append(self.build(rows[near], center, gap[near], half))
            rows = rows[~near]
            if len(rows):
                center = int(rows[0])
                gap = self.gaps(center, rows)
        return Node(center, radius, np.concatenate([c.members for c in children]), children)


class DualTraversal:
    """Links between two blocks, or inside one (other is None)."""

    def __init__(self, x: np.ndarray, w: np.ndarray, y: np.ndarray | None, v: np.ndarray | None, cosine: float):
        self.cosine, self.reach = cosine, math.sqrt(max(0.0, 2 - 2 * cosine))
        self.x, self.w = x, w
        self.nx = np.sqrt((x * x).sum(1))
        self.own = y is None
        self.y, self.v, self.ny = (x, w, self.nx) if self.own else (y, v, np.sqrt((y * y).sum(1)))
        self.left = CoverTree(x / self.nx[:, None])
        self.right = self.left if self.own else CoverTree(y / self.ny[:, None])
        self.x_links, self.y_links = np.zeros(len(x), np.int64), np.zeros(len(self.y), np.int64)
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []
        if self.left.root and self.right.root:
            if self.own:
                self.inside(self.left.root)
            else:
                self.between(self.left.root, self.right.root)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        """Pairs of rows of x and y, each once."""
        if len(i):
            np.add.at(self.x_links, i, self.v[j])
            np.add.at(self.x_links if self.own else self.y_links, j, self.w[i])
            self.pairs.append((i, j))

    def test(self, rows: np.ndarray, cols: np.ndarray, upper: bool = False) -> None:
        c = (self.x[rows] @ self.y[cols].T) / np.outer(self.nx[rows], self.ny[cols]) >= self.cosine
        i, j = np.nonzero(np.triu(c, 1) if upper else c)
        self.link(rows[i], cols[j])

    def whole(self, a: Node, b: Node) -> None:
        """All pairs between two nodes, as sums and a star."""
        self.x_links[a.members] += self.v[b.members].sum()
        (self.x_links if self.own else self.y_links)[b.members] += self.w[a.members].sum()
        self.pairs.append((a.members, np.repeat(b.members[:1], len(a.members))))
        self.pairs.append((np.repeat(a.members[:1], len(b.members)), b.members))

    def distances(self, a: list[Node], b: list[Node]) -> np.ndarray:
        p = self.left.unit[[n.center for n in a]]
        q = self.right.unit[[n.center for n in b]]
        return np.sqrt(np.maximum(0.0, 2 - 2 * (p @ q.T)))

    def inside(self, node: Node) -> None:
        if 2 * node.radius <= self.reach - SLACK:
            m = node.members
            self.x_links[m] += self.w[m].sum() - self.w[m]
            self.pairs.append((m[1:], np.repeat(m[:1], len(m) - 1)))
            return
        if not node.children:
            self.test(node.members, node.members, upper=True)
            return
        for c in node.children:
            if len(c.members) > 1:
                self.inside(c)
        self.cross(node.children, node.children, upper=True)

    def between(self, a: Node, b: Node) -> None:
        if not a.children and not b.children:
            self.test(a.members, b.members)
        else:
            self.cross(a.children or [a], b.children or [b])

    def cross(self, a: list[Node], b: list[Node], upper: bool = False, step: int = 512) -> None:
        ra, rb = np.array([n.radius for n in a]), np.array([n.radius for n in b])
        for k in range(0, len(a), step):
            d = self.distances(a[k : k + step], b)
            both = ra[k : k + step, None] + rb[None, :]
            keep = d <= both + self.reach + SLACK
            if upper:
                keep &= np.arange(k, k + len(d))[:, None] < np.arange(len(b))[None, :]
            i, j = np.nonzero(keep)
            for p, q in zip(i.tolist(), j.tolist(), strict=True):
                m, n = a[k + p], b[q]
                if d[p, q] + m.radius + n.radius <= self.reach - SLACK:
                    self.whole(m, n)
                elif len(m.members) * len(n.members) <= LEAF * LEAF:
                    self.test(m.members, n.members)
                else:
                    self.between(m, n)

    def forest(self) -> list[tuple[int, int]]:
        """(node, root) over rows of x, then of y (offset by len(x) when y is another block)."""
        if not self.pairs:
            return []
        shift = 0 if self.own else len(self.x)
        i = np.concatenate([p[0] for p in self.pairs])
        j = np.concatenate([p[1] for p in self.pairs]) + shift
        label = np.arange(shift + len(self.y))
        while True:
            low = np.minimum(label[i], label[j])
            new = label.copy()
            np.minimum.at(new, i, low)
            np.minimum.at(new, j, low)
            new = new[new]
            if (new == label).all():
                break
            label = new
        other = np.flatnonzero(label != np.arange(len(label)))
        return list(zip(other.tolist(), label[other].tolist(), strict=True))


def matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<f8").reshape(len(column), -1)


def _units(vectors: list) -> np.ndarray:
    m = matrix(vectors)
    return m / np.sqrt((m * m).sum(1))[:, None]


def _compare(batches, cosine: float):
    """Counts and forests of every two blocks that lie together."""
    for table in common.runs(batches, ["cell", "kind", "lo", "hi"]):
        table = table.sort_by("rep")
        second, same = table["second"].to_numpy(), table["kind"][0].as_py() == 0 and table["lo"][0].as_py() == table["hi"][0].as_py()
        rep, n, vec = table["rep"].to_numpy(), table["n"].to_numpy(), table["vec"].to_pylist()
        x, y = np.flatnonzero(~second), np.flatnonzero(second)
        if len(x) < 1 + same or not (same or len(y)):
            continue
        own = matrix([vec[i] for i in x])
        dual = DualTraversal(own, n[x], None if same else matrix([vec[i] for i in y]), None if same else n[y], cosine)
        ids = rep[x] if same else np.concatenate([rep[x], rep[y]])
        links = dual.x_links if same else np.concatenate([dual.x_links, dual.y_links])
        some, pairs = np.flatnonzero(links), dual.forest()
        a, b = np.array(pairs, np.int64).reshape(-1, 2).T
        if len(some):
            null = pa.nulls(len(some), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), null, pa.array(links[some])], ["a", "b", "links"])
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b]), pa.array(np.zeros(len(a), np.int64))], ["a", "b", "links"])


def _split(batches, reach: float):
    """Rows in order of (cell, part), each part led by its cell's pivots: every vector to its home and where it is a guest."""
    at, pivots = None, None
    for batch in batches:
        for table in common.runs([batch], ["cell", "part"]):
            key = (table["cell"][0].as_py(), table["part"][0].as_py())
            lead = table["pivots"][0].as_py()
            if lead is not None:
                at, pivots, table = key, _units(lead), table.slice(1)
            if at != key:
                raise ValueError("a part without its pivots")
            for k in range(0, len(table), 256):
                part = table.slice(k, 256)
                home = part["home"].to_numpy()
                d = np.sqrt(np.maximum(0.0, 2 - 2 * (_units(part["vec"].to_pylist()) @ pivots.T)))
                near, own = d.argmin(1), d.min(1)
                reached = d <= own[:, None] + 2 * reach + SLACK
                reached &= ~home[:, None] | (np.arange(len(pivots))[None] <= near[:, None])
                i, j = np.nonzero(reached)
                out = part.take(pa.array(i))
                cells = pa.array([f"{key[0]}.{x}" for x in j.tolist()])
                columns = [cells, pa.array(home[i] & (near[i] == j)), *(out[c].combine_chunks() for c in ("rep", "n", "salt", "vec")), pa.array(d[i, j])]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in PLACES.split(", ")])


def _pack(batches):
    for batch in batches:
        vectors = [np.asarray(v, "<f8").tobytes() for v in batch.column("v").to_pylist()]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("cell", "home", "rep", "n", "salt")), pa.array(vectors, pa.binary()), batch.column("gap")], [x.split()[0] for x in PLACES.split(", ")])


def measured(places: DataFrame) -> DataFrame:
    """Of every cell: vectors at home and their radius, representatives (with copies) and the least of them, and guests."""
    home = F.when(F.col("home"), F.lit(1))
    return common.written(places.groupBy("cell").agg(F.count(home).alias("h"), F.max(F.when(F.col("home"), F.col("gap"))).alias("radius"), F.sum(F.when(F.col("home"), F.col("n"))).alias("copies"), F.min(F.when(F.col("home"), F.col("rep"))).alias("least"), F.count_if(~F.col("home")).alias("g")), "cells")


def split(places: DataFrame, cells: DataFrame, block: int, fan: int, reach: float) -> DataFrame:
    """The places in the cells' children."""
    how = cells.select("cell", F.least(F.lit(fan), F.ceil(F.col("h") / block)).alias("many"), F.ceil((F.col("h") + F.col("g")) / CHUNK).alias("parts"))
    inside = places.join(common.small(how), "cell")
    drawn = inside.where("home").groupBy("cell", "parts", F.pmod("salt", "many").alias("j")).agg(F.min(F.struct("salt", "vec")).alias("x"))
    pivots = drawn.groupBy("cell", "parts").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "x.vec"))), lambda x: x["vec"]).alias("pivots"))
    lead = pivots.select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "pivots")
    rest = inside.withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts"))).drop("many", "parts")
    both = lead.unionByName(rest, allowMissingColumns=True).select("cell", "part", "pivots", "home", "rep", "n", "salt", "vec")
    ordered = both.repartition("cell", "part").sortWithinPartitions("cell", "part", F.col("pivots").isNull())
    return common.written(ordered.mapInArrow(partial(_split, reach=reach), PLACES), "places")


def blocks_of(places: DataFrame, cells: DataFrame, block: int) -> DataFrame:
    """Rows to every two blocks of their cell that hold them: kind 0 for two blocks at home, 1 for one of guests."""
    sized = cells.where("h + g > 1 and h > 0").select("cell", F.ceil(F.col("h") / block).alias("hb"), F.ceil(F.col("g") / block).alias("gb"), "tight")
    own = F.pmod(F.xxhash64("rep"), F.when(F.col("home"), F.col("hb")).otherwise(F.col("gb")))
    rows = places.join(common.small(sized), "cell").withColumn("own", own)
    place = lambda kind, lo, hi, second: F.struct(F.lit(kind).alias("kind"), lo.alias("lo"), hi.alias("hi"), second.alias("second"))
    each = lambda many, f: F.when(many > 0, F.transform(F.sequence(F.lit(0).cast("long"), many - 1), f)).otherwise(F.array().cast("array<struct<kind:int,lo:bigint,hi:bigint,second:boolean>>"))
    o, hb, gb = F.col("own"), F.col("hb"), F.col("gb")
    at_home = F.concat(each(F.when(F.col("tight"), F.lit(0)).otherwise(hb), lambda x: place(0, F.least(o, x), F.greatest(o, x), o > x)), each(gb, lambda x: place(1, o, x, F.lit(False))))
    as_guest = each(hb, lambda x: place(1, x, o, F.lit(True)))
    dealt = rows.withColumn("x", F.explode(F.when(F.col("home"), at_home).otherwise(as_guest)))
    return dealt.select("cell", "x.kind", "x.lo", "x.hi", "x.second", "rep", "n", "vec")


def near_vectors(vectors: DataFrame, cosine: float = 0.98, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """One row a vector: vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    common.small_batches(spark)
    reach = math.sqrt(max(0.0, 2 - 2 * cosine))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    good = F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0)
    classes = rows.where(good).groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    packed = classes.where("rep is not null").select(F.concat_ws("/", "label", F.size("v").cast("string")).alias("cell"), F.lit(True).alias("home"), "rep", "n", F.pmod(F.xxhash64("v"), F.lit(1 << 30)).alias("salt"), "v", F.lit(2.0).alias("gap"))
    places = common.written(packed.mapInArrow(_pack, PLACES), "vectors")

    found = []
    for level in range(LEVELS + 1):
        tight = F.col("radius") <= reach / 2 - SLACK
        cells = measured(places).withColumn("tight", F.coalesce(tight, F.lit(False)))
        large = (F.col("h") > block) & ~F.col("tight") & F.lit(level < LEVELS)
        if level:  # guests beyond the reach of the vectors at home
            near = common.small(cells.select("cell", "radius"))
            places = places.join(near, "cell").where(F.col("home") | (F.col("gap") <= F.col("radius") + reach + SLACK)).drop("radius")
        leaves = cells.where(~large)
        ordered = blocks_of(places, leaves, block).repartition("cell", "kind", "lo", "hi").sortWithinPartitions("cell", "kind", "lo", "hi")
        found.append(common.written(ordered.mapInArrow(partial(_compare, cosine=cosine), FOUND), "found"))
        close = leaves.where("tight and h > 1").select(F.col("cell").alias("t_cell"), "copies", "least")
        if not close.isEmpty():
            own = places.where("home").join(common.small(close), F.col("cell") == F.col("t_cell"))
            found.append(common.written(own.select(F.col("rep").alias("a"), F.lit(None).cast("long").alias("b"), (F.col("copies") - F.col("n")).alias("links")).union(own.select("rep", "least", F.lit(0).cast("long"))), "close"))
        open_ = cells.where(large)
        if open_.isEmpty():
            break
        places = split(places, open_, block, fan, reach)
    links = found[0]
    for more in found[1:]:
        links = links.union(more)

    counts = links.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    groups = components(links.where("b is not null").select("a", "b")).toDF("c_node", "component")
    known = classes.where("rep is not null").join(counts, F.col("rep") == F.col("node"), "left").join(groups, F.col("rep") == F.col("c_node"), "left")
    known = known.select(F.col("label").alias("k_label"), F.col("v").alias("k_v"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.join(known, (F.col("label") == F.col("k_label")) & (F.col("v") == F.col("k_v")), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
