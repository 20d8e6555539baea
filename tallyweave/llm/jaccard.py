"""N-gram Jaccard join in the metric space of shingle sets (distance = 1 - Jaccard similarity).

1. Every document becomes the set of its distinct word n-gram hashes; documents with equal sets are one point (a class).
   A point's sketch is its SKETCH lowest hashes.
2. Sparse distances. Two sets share a hash among their sketches or are apart: hashes are uniform, so of the first SKETCH
   elements of the union each is shared with probability J. For J >= 0.75 and SKETCH = 64, fewer than NEED = 17 shared
   ones have probability 6e-17, which is below that of a collision of 64-bit hashes; for unions of up to 64 elements the
   count is exact. So a point with fewer than min(NEED, 0.75 n) sketch elements found elsewhere has no link (most documents go
   here), and of the others the min(NEED, 0.75 n) - 1 commonest elements need not be looked at: of the rest one at least is shared.
3. Regions. Each of those elements elects a pivot among its points; a point belongs to the region of every pivot that its elements
   elected, i.e. the boundary points of neighbouring regions are replicated. A region all of whose points are in another one is dropped.
4. In a region, all distances are exact. Points which share less than 0.75 of their own elements with the rest of the region leave.
   Then pivots are taken one after another: links to the pivot join components, and by the triangle inequality
   d(y, z) >= d(z, p) - d(y, p) every point y of the pivot's component whose window d(y, p) + 0.25 ends before the nearest point
   of any other component is closed: it cannot link there. Only points in overlapping windows go on to the next pivot.
   A region above LEAF elements goes through rounds of the same step over slices of its points with PIVOTS pivots each, until
   what is open fits into a leaf.
5. Links between classes give components.

No pairs of a group are listed: a group of m near copies costs about m distances, not m * m. Results are complete up to hash collisions.

Defined results: a null or empty text, or one without words, has an empty set: n_shingles 0 and its own id as component. Repeated rows
and equal texts share a component. A null id is never the least id of a component; if all ids of a component are null, so is
component_id. Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textvec as tv
from .components import components
from .scratch import Scratch, fresh, map_batches, own

SKETCH, NEED = 64, 17
LEAF = 2_000_000
PIVOTS = 32
SLICE = 500_000
#: Rows of the table of candidates (a place and a few region names each, under 100 bytes) up to which it is sent to all executors
SENT = 100_000


def shingle_sets(texts: pa.Array, n: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """First row and the sorted distinct hashes of each row of a run of rows."""
    for w in tv.words(texts, tv.SPACED):
        rows = w.last - w.first
        count = np.diff(w.at)
        i, h = tv.windows(w, n)
        at = np.searchsorted(w.row[i], np.arange(rows + 1))
        out = [np.unique(h[at[r] : at[r + 1]]) for r in range(rows)]
        for m in range(1, n):  # fewer words: all of them are the one shingle
            few = np.flatnonzero(count == m)
            if len(few):
                for r, x in zip(few, tv.mix(tv.combine(w.hash, w.at[few], m)), strict=True):
                    out[r] = np.array([x])
        yield w.first, out


def _lists(sets: list[np.ndarray]) -> pa.Array:
    offs = np.zeros(len(sets) + 1, np.int32)
    np.cumsum([len(s) for s in sets], out=offs[1:])
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)))


def points(docs: DataFrame, n: int) -> DataFrame:
    """_row, _id, n, class (c1, c2) and sketch of each document (_row, _id, _text)."""
    chosen = docs.select("_row", "_id", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, c1, c2, sketch = [], [], [], []
            for _, sets in shingle_sets(b.column(2), n):
                for s in sets:
                    sizes.append(len(s))
                    c1.append(np.bitwise_xor.reduce(tv.mix(s ^ np.uint64(0xA5A5))) if len(s) else np.uint64(0))
                    c2.append(np.add.reduce(tv.mix(s + np.uint64(0x5F5E)), dtype=np.uint64) if len(s) else np.uint64(0))
                    sketch.append(s[:SKETCH])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array(np.array(c1, np.uint64).view(np.int64)), pa.array(np.array(c2, np.uint64).view(np.int64)), _lists(sketch)], names=["_row", "_id", "n", "c1", "c2", "sketch"]
            )

    return map_batches(chosen, run, f"_row long, _id {chosen.schema['_id'].dataType.simpleString()}, n long, c1 long, c2 long, sketch array<long>")


def candidates(classes: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """node, n, regions (array<long>) of the points that can have a link."""
    entries = classes.select("node", "n", F.explode("sketch").alias("h"))
    blocks = entries.groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.min(F.xxhash64("node")).alias("p")).where("c > 1")
    need = F.least(F.lit(NEED), F.ceil(F.col("n") * percent / 100)).cast("int")
    shared = entries.join(blocks, "h").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("c", "h", "p"))).alias("e"))  # up to SKETCH
    shared = shared.where(F.size("e") >= need).select("node", "n", F.array_distinct(F.transform(F.slice("e", 1, F.size("e") - need + 1), lambda x: x["p"])).alias("regions"))
    shared = scratch.put("shared", shared)
    # regions of one point go, and those all of whose points are in a region of a lower name
    size = shared.select(F.explode("regions").alias("p"), "n").groupBy("p").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("elements"))
    pair = shared.select(F.explode("regions").alias("p"), "regions").select("p", F.explode("regions").alias("q")).where("q < p").groupBy("p", "q").agg(F.count(F.lit(1)).alias("both"))
    inside = pair.join(size, "p").where("both = m").select("p").distinct()
    live = size.where("m > 1").join(inside, "p", "left_anti").select("p", "elements")
    kept = shared.select("node", "n", F.explode("regions").alias("p")).join(live, "p")
    split = lambda big: F.collect_list(F.when((F.col("elements") > LEAF) == F.lit(big), F.col("p")))
    return scratch.put("candidates", kept.groupBy("node", "n").agg(split(False).alias("leaves"), split(True).alias("large")))


def _distances(inv: np.ndarray, offs: np.ndarray, size: np.ndarray, pivot: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shared elements and union size of the sets inv[offs[i]:offs[i+1]] with the set pivot; no set is empty."""
    mark = np.zeros(width, np.int32)
    mark[pivot] = 1
    both = np.add.reduceat(mark[inv], offs[:-1])
    return both, size + len(pivot) - both


def join_leaf(nodes: np.ndarray, values: np.ndarray, offs: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that connect exactly the components of the given sets."""
    _, inv = np.unique(values, return_inverse=True)
    width = int(inv.max()) + 1 if len(inv) else 0
    alive = np.arange(len(nodes))
    size = np.diff(offs)

    def only(keep: np.ndarray) -> None:
        nonlocal alive, inv, offs, size
        inv = inv[np.repeat(keep, size)]
        alive, size = alive[keep], size[keep]
        offs = np.concatenate([[0], np.cumsum(size)])

    while len(alive) > 1:  # points whose shared elements are too few for any link here
        count = np.bincount(inv, minlength=width)
        found = np.add.reduceat((count[inv] > 1).astype(np.int64), offs[:-1])
        keep = 100 * found >= percent * size
        if keep.all():
            break
        only(keep)
    root = np.arange(len(nodes))
    open_ = np.ones(len(nodes), bool)
    links, theta = [], 1 - percent / 100
    while len(alive) > 1:
        comp = root[alive]
        wait = np.flatnonzero(open_[alive])
        if not len(wait) or (comp == comp[0]).all():
            break
        k = wait[0]
        both, union = _distances(inv, offs, size, inv[offs[k] : offs[k + 1]], width)
        for j in np.flatnonzero(100 * both >= percent * union):
            if root[alive[j]] != root[alive[k]]:
                links.append((int(nodes[alive[k]]), int(nodes[alive[j]])))
                root[root == root[alive[j]]] = root[alive[k]]
        comp, d = root[alive], 1 - both / union
        mine = comp == comp[k]
        nearest = d[~mine].min(initial=9.0)
        closed = mine & (d + theta + 1e-9 < nearest)
        closed[k] = True
        open_[alive[closed]] = False
        only(~closed)
    return links


def _leaf(percent: int):
    def run(t: pa.Table) -> pa.Table:
        order = np.argsort(t.column("node").to_numpy(), kind="stable")
        t = t.take(pa.array(order)).combine_chunks()
        sets = t.column("set").combine_chunks() if isinstance(t.column("set"), pa.ChunkedArray) else t.column("set")
        sets = sets.chunk(0) if isinstance(sets, pa.ChunkedArray) else sets
        offs = sets.offsets.to_numpy().astype(np.int64)
        links = join_leaf(t.column("node").to_numpy(), sets.values.to_numpy()[offs[0] : offs[-1]], offs - offs[0], percent)
        return pa.table({"u": pa.array([a for a, _ in links], pa.int64()), "v": pa.array([b for _, b in links], pa.int64())})

    return run


def _with_sets(docs: DataFrame, wanted: DataFrame, column: str, n: int, sent: bool) -> DataFrame:
    """node, n, set, p: the sets of the wanted points, once for each region in the given column."""
    wanted = wanted.where(F.size(column) > 0).select(F.col("node").alias("_row"), F.col(column).alias("_p"))
    rows = docs.select("_row", "_text")
    found = rows.join(F.broadcast(wanted) if sent else wanted, "_row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, sets in shingle_sets(b.column(1), n):
                part = b.slice(first, len(sets))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), _lists(sets), part.column(2)], names=["node", "n", "set", "_p"])

    made = map_batches(found.select("_row", "_text", "_p"), run, "node long, n long, set array<long>, _p array<long>")
    return made.select("node", "n", "set", F.explode("_p").alias("p"))


def _rounds(rows: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Links of large regions. rows: p, node, n, set."""
    theta = 1 - percent / 100
    one = rows.select("p", "node", F.explode("set").alias("h"))
    common = one.groupBy("p", "h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("p", "h")
    enough = one.join(common, ["p", "h"]).groupBy("p", "node").agg(F.count(F.lit(1)).alias("c"))
    rows = rows.join(enough, ["p", "node"]).where(F.col("c") * 100 >= F.col("n") * percent).select("p", "node", "n", "set", F.lit(True).alias("open"))
    rows = scratch.put("round0", rows)
    links, k = scratch.put("links0", rows.sparkSession.createDataFrame([], "u long, v long")), 0
    while True:
        size = rows.groupBy("p").agg(F.sum("n").alias("elements"), F.max("open").alias("more")).where("more")
        leaf = rows.join(size.where(F.col("elements") <= LEAF), "p").select("p", "node", "set").groupBy("p").applyInArrow(_leaf(percent), "u long, v long")
        links = scratch.put(f"leaf{k}", links.unionByName(leaf))
        large = size.where(F.col("elements") > LEAF).withColumn("parts", F.ceil(F.col("elements") / SLICE).cast("long"))
        if large.isEmpty():
            return links
        active = rows.join(large, "p")
        first = Window.partitionBy("p").orderBy(F.xxhash64("node"), "node")
        pivots = active.where("open").withColumn("_k", F.row_number().over(first)).where(F.col("_k") <= PIVOTS)
        slices = active.withColumn("part", F.pmod(F.xxhash64("node", F.lit(3)), F.col("parts"))).withColumn("pivot", F.lit(False))
        copies = pivots.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).withColumn("pivot", F.lit(True))
        cols = ["p", "part", "pivot", "node", "set"]

        def measure(t: pa.Table) -> pa.Table:
            flag = t.column("pivot").to_numpy(zero_copy_only=False)
            node = t.column("node").to_numpy()
            sets = [np.array(s.values.to_numpy(zero_copy_only=False)) for s in t.column("set").combine_chunks()] if len(t) else []
            values = np.concatenate(sets)
            _, inv = np.unique(values, return_inverse=True)
            offs = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
            width = int(inv.max()) + 1
            mine = np.flatnonzero(~flag)
            out: dict[str, list] = {"p": [], "node": [], "pivot": [], "d": [], "link": []}
            for j in np.flatnonzero(flag):
                both, union = _distances(inv, offs, np.diff(offs), inv[offs[j] : offs[j + 1]], width)
                out["p"].append(np.full(len(mine), t.column("p")[0].as_py()))
                out["node"].append(node[mine])
                out["pivot"].append(np.full(len(mine), node[j]))
                out["d"].append(1 - both[mine] / union[mine])
                out["link"].append(100 * both[mine] >= percent * union[mine])
            return pa.table({c: np.concatenate(x) if x else [] for c, x in out.items()})

        far = slices.select(*cols).unionByName(copies.select(*cols)).groupBy("p", "part").applyInArrow(measure, "p long, node long, pivot long, d double, link boolean")
        far = scratch.put(f"far{k}", far)
        links = scratch.put(f"links{k + 1}", links.unionByName(far.where("link and node <> pivot").select(F.col("node").alias("u"), F.col("pivot").alias("v"))).distinct())
        comp = components(links, scratch, f"round{k}cc")
        of = lambda c: comp.select(F.col("node").alias(c), F.col("component").alias(f"{c}_c"))
        both = far.join(of("node"), "node", "left").join(of("pivot"), "pivot", "left").withColumn("same", F.coalesce("node_c", "node") == F.coalesce("pivot_c", "pivot"))
        both = scratch.put(f"same{k}", both.select("p", "node", "pivot", "d", "same"))
        nearest = both.groupBy("p", "pivot").agg(F.min(F.when(~F.col("same"), F.col("d"))).alias("nearest"))
        window = F.col("same") & (F.col("nearest").isNull() | (F.col("d") + theta + 1e-9 < F.col("nearest")))
        shut = both.join(nearest, ["p", "pivot"]).where(window | (F.col("node") == F.col("pivot"))).select("p", "node").distinct()
        rows = scratch.put(f"round{k + 1}", active.select("p", "node", "n", "set", "open").join(shut, ["p", "node"], "left_anti"))
        scratch.drop(f"round{k}", f"far{k}", f"same{k}", f"leaf{k}")
        k += 1


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 75) -> DataFrame:
    """Per row of docs: _row (its place in docs), _component (one number for each component), id, n_shingles, component_id. Texts link when 100 * shared >= percent * union (percent >= 75)."""
    if percent < 75:
        raise ValueError("the sketch's bounds hold for 75 percent and more")
    scratch = Scratch(docs.sparkSession)
    rows = scratch.numbered(docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")))
    return _join(rows, scratch, n, percent).withColumnRenamed("_id", id_col)


def _join(docs: DataFrame, scratch: Scratch, n: int, percent: int) -> DataFrame:
    all_points = scratch.put("points", points(docs, n))
    classes = all_points.where("n > 0").groupBy("c1", "c2", "n").agg(F.min("_row").alias("node"), F.min("_id").alias("least"))
    classes = scratch.put("classes", classes)
    # the sketch is read from the one row that stands for its class
    stand = all_points.join(classes.select(F.col("node").alias("_row")), "_row", "left_semi").select(F.col("_row").alias("node"), "n", "sketch")
    wanted = candidates(stand, percent, scratch)
    sent = wanted.count() <= SENT
    links = _with_sets(docs, wanted, "leaves", n, sent).select("p", "node", "set").groupBy("p").applyInArrow(_leaf(percent), "u long, v long")
    links = scratch.put("links", links)
    if not wanted.where(F.size("large") > 0).isEmpty():
        links = links.unionByName(_rounds(_with_sets(docs, wanted, "large", n, sent), percent, scratch))
    found = components(links, scratch)
    least = found.join(classes, "node").groupBy("component").agg(F.min("least").alias("component_id"))
    named = found.join(least, "component").select("node", "component", "component_id")
    by_class = classes.join(named, "node", "left").select("c1", "c2", "n", F.coalesce("component", "node").alias("_component"), F.when(F.col("component").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"))
    by_class = scratch.put("named", by_class)
    out = all_points.drop("sketch").join(by_class, ["c1", "c2", "n"], "left")
    some = F.col("n") > 0
    return out.select(
        "_row", F.coalesce("_component", "_row").alias("_component"), "_id", F.col("n").alias("n_shingles"), F.when(some, F.col("component_id")).otherwise(F.col("_id")).alias("component_id")
    )


def distinct(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 75) -> DataFrame:
    """docs with one row of each component: the one with the least id (nulls last), of equal ids the first; each row without words is its own component.

    All columns stay, whatever their names."""
    scratch, row = Scratch(docs.sparkSession), fresh("_row", docs.columns)
    rows = scratch.numbered(docs, row)
    found = _join(rows.select(F.col(row).alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")), scratch, n, percent)
    keep = found.groupBy("_component").agg(F.min(F.struct(F.col("_id").isNull().alias("z"), "_id", "_row")).alias("x")).select(F.col("x._row").alias(row))
    return rows.join(keep, row, "left_semi").select(*own(docs))
