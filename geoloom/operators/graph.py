"""Connected water, bounded distance over cells, and what is known of each component."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoloom.operators.ranges import EIGHT, carried, neighbors
from geoloom.operators.storage import by_shuffle, drop_stored, stored

C = F.col


def merge_labels(edges: DataFrame) -> DataFrame:
    """(node, root) from edges (a, b): the least label reachable, by hooking and jumping until nothing changes."""
    links = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    count = None
    while True:
        both = links.union(links.select(C("b").alias("a"), C("a").alias("b")))
        least = both.groupBy("a").agg(F.least(C("a"), F.min("b")).alias("m"))
        # all higher neighbours of a node link to the least around it, then each node's links to its least
        up = both.join(by_shuffle(least), "a").filter("b > a").select(C("b").alias("a"), C("m").alias("b")).filter("a <> b").distinct()
        low = up.groupBy("a").agg(F.min("b").alias("m"))
        down = up.join(by_shuffle(low), "a").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).filter("a <> b").union(low.select("a", C("m").alias("b"))).distinct()
        after = stored(down)
        drop_stored(links)
        links = after
        before, count = count, links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if before == count:
            return links.select(C("a").alias("node"), C("b").alias("root")).union(links.select("b", "b").distinct())


#: Side of the blocks whose cells one task labels, and blocks a side whose borders one task joins.
BLOCK, SUPER = 1024, 16


class Forest:
    """Union-find over numbers below n, by path halving; the least number of a set is its root."""

    def __init__(self, n: int) -> None:
        self.parent = list(range(n))

    def find(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    def join(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Join a[k] to b[k] for every k; the root of every number."""
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            i, j = self.find(i), self.find(j)
            if i != j:
                self.parent[max(i, j)] = min(i, j)
        return np.array([self.find(i) for i in range(len(self.parent))], np.int64)


def label_block(x: np.ndarray, y: np.ndarray, width: int) -> np.ndarray:
    """Of each cell, the row-major number of the first cell of its 4-connected component among these cells."""
    x, y = x.astype(np.int64), y.astype(np.int64)
    by = np.lexsort((x, y))
    x, y = x[by], y[by]
    starts = np.ones(len(x), bool)
    starts[1:] = (y[1:] != y[:-1]) | (x[1:] - x[:-1] > 1)
    run = np.cumsum(starts) - 1  # unbroken stretches of a row, in row-major order
    side = int(x.max() - x.min()) + 2
    key = (y - y.min()) * side + (x - x.min())
    at = np.searchsorted(key, key + side)
    under = (at < len(key)) & (key[np.minimum(at, len(key) - 1)] == key + side)
    pairs = np.unique(np.stack([run[under], run[at[under]]]), axis=1)
    root = Forest(int(run[-1]) + 1).join(*pairs)
    first = np.flatnonzero(starts)
    out = np.empty(len(x), np.int64)
    out[by] = (y[first] * width + x[first])[root[run]]
    return out


def components(cells: DataFrame, width: int, block: int = BLOCK) -> DataFrame:
    """Adds comp: the row-major number (x + y * width, for x from 0 to width - 1) of the first cell of the 4-connected component.

    A task labels the cells of a block. Labels that touch across block borders are joined by one task for each square of ``SUPER`` blocks, and what
    touches across those squares by star rounds, so the rounds see border labels of large squares only.
    """
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cells.schema.fields)
    at = lambda c, size: F.floor(C(c) / size)

    def label(table: pa.Table) -> pa.Table:
        table = table.drop_columns(["_bx", "_by"])
        labels = label_block(table["x"].to_numpy(), table["y"].to_numpy(), width)
        return table.append_column("_label", pa.array(labels))

    placed = stored(cells.withColumns({"_bx": at("x", block), "_by": at("y", block)}).groupBy("_bx", "_by").applyInArrow(label, f"{kinds}, _label long"))
    # cells at the right and lower border of a block, and the cells beyond it
    last, first = (lambda c: F.pmod(c, F.lit(block)) == block - 1), (lambda c: F.pmod(c, F.lit(block)) == 0)
    edges = None
    for c, dx, dy in (("x", 1, 0), ("y", 0, 1)):
        here = placed.filter(last(c)).select((C("x") + dx).alias("x"), (C("y") + dy).alias("y"), C("_label").alias("a"))
        beyond = placed.filter(first(c)).select("x", "y", C("_label").alias("b"))
        met = here.join(by_shuffle(beyond), ["x", "y"]).select("a", "b", *[at(v, block * SUPER).alias(f"_s{v}") for v in "xy"], F.pmod(c, F.lit(block * SUPER)).alias("_in")).withColumn("_outer", C("_in") == 0).drop("_in").distinct()
        edges = met if edges is None else edges.union(met)
    edges = stored(edges)

    def join(table: pa.Table) -> pa.Table:
        nodes, places = np.unique(np.concatenate([table["a"].to_numpy(), table["b"].to_numpy()]), return_inverse=True)
        root = Forest(len(nodes)).join(places[: len(table)], places[len(table) :])
        return pa.table({"_label": nodes, "_up": nodes[root]})

    inner = edges.filter(~C("_outer")).groupBy("_sx", "_sy").applyInArrow(join, "_label long, _up long")
    outer = edges.filter(C("_outer")).select("a", "b")
    if outer.isEmpty():
        roots = inner.withColumnRenamed("_up", "root")
    else:
        inner = stored(inner)
        up = lambda c: F.coalesce(C(f"_up_{c}"), C(c)).alias(c)
        raised = outer.join(by_shuffle(inner.select(C("_label").alias("a"), C("_up").alias("_up_a"))), "a", "left").join(by_shuffle(inner.select(C("_label").alias("b"), C("_up").alias("_up_b"))), "b", "left")
        top = stored(merge_labels(raised.select(up("a"), up("b"))))
        own = outer.select(C("a").alias("_label")).union(outer.select("b")).distinct().join(by_shuffle(inner), "_label", "left_anti").withColumn("_up", C("_label"))
        roots = inner.union(own).join(by_shuffle(top.withColumnRenamed("node", "_up")), "_up", "left").select("_label", F.coalesce("root", "_up").alias("root"))
    return placed.join(by_shuffle(roots), "_label", "left").withColumn("comp", F.coalesce("root", "_label")).select(*cells.columns, "comp")


def number_components(labelled: DataFrame) -> DataFrame:
    """(comp, number): dense numbers in order of first cells; one row for each component, null left out.

    Counts of lower components are carried over levels of 4,096 nodes each, so no task ranks all of them.
    """
    nodes = stored(labelled.select(C("comp").alias("k"), F.lit(1).cast("bigint").alias("v")).filter("k is not null").distinct())
    below = carried(nodes, "sum")
    return below.select(C("k").alias("comp"), (F.coalesce("b", F.lit(0)) + 1).cast("bigint").alias("number"))


def component_stats(cells: DataFrame, width: int, sea: int = 0) -> DataFrame:
    """One row per comp: cells, sum, below-sea and land cells, box, least and greatest height with their cells, no data."""
    at = C("x") + C("y") * width
    return cells.groupBy("comp").agg(
        F.count("*").alias("cells"), F.sum("elev_m").alias("total"), F.count_if(C("elev_m") < sea).alias("below"), F.count_if(C("land") == 1).alias("on_land"),
        F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"),
        F.min("elev_m").alias("low"), F.min(F.struct("elev_m", at.alias("i")))["i"].alias("low_at"), F.max("elev_m").alias("high"), (-F.max(F.struct("elev_m", (-at).alias("i")))["i"]).alias("high_at"),
        F.bool_or(C("cover") == 0).alias("no_data"), F.floor(F.sum("elev_m") / F.count("*") + 0.5).alias("average"),
    )


def border_percentile(water: DataFrame, cells: DataFrame, p: float = 0.1) -> DataFrame:
    """(comp, spill): height at sorted place floor(p * (n - 1)) of the land beside a component, once for each touching side; else the average."""
    sides = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1))]))
    near = water.select("comp", "x", "y", sides.alias("o")).select("comp", (C("x") + C("o.dx")).alias("x"), (C("y") + C("o.dy")).alias("y"))
    land = cells.join(by_shuffle(water.select("x", "y")), ["x", "y"], "left_anti").select("x", "y", C("elev_m").alias("h"))
    # heights are few whole numbers: counting them first keeps a huge border from meeting in one task
    heights = near.join(by_shuffle(land), ["x", "y"]).groupBy("comp", "h").agg(F.count("*").alias("n"))
    order = Window.partitionBy("comp").orderBy("h")
    ranked = heights.withColumns({"upto": F.sum("n").over(order), "all": F.sum("n").over(Window.partitionBy("comp"))})
    spill = ranked.filter(C("upto") > F.floor(p * (C("all") - 1))).groupBy("comp").agg(F.min("h").alias("spill"))
    average = water.groupBy("comp").agg(F.floor(F.sum("elev_m") / F.count("*") + 0.5).alias("average"))
    return average.join(spill, "comp", "left").select("comp", F.coalesce("spill", "average").alias("spill"))


def ratio_flags(stats: DataFrame) -> DataFrame:
    return stats.withColumns({"below_sea": C("below") / C("cells") >= 0.9, "land_inland": C("on_land") / C("cells") >= 0.6})


def classify_components(stats: DataFrame, spill: DataFrame, inland: DataFrame, sea: int = 0) -> DataFrame:
    """Adds is_ocean and surface; ``inland`` lists the comps that touch known inland water."""
    out = ratio_flags(stats).join(spill, "comp").join(inland.select("comp", F.lit(True).alias("_in")), "comp", "left")
    ocean = ~C("land_inland") & (C("no_data") | (C("below_sea") & C("_in").isNull()))
    return out.withColumns({"is_ocean": ocean, "surface": F.when(ocean, F.lit(sea)).otherwise(C("spill")).cast("bigint")}).drop("_in")


def is_river(stats: DataFrame, min_length: int, max_width: int) -> DataFrame:
    """Adds river: long, narrow and not a filled lake."""
    w, h = C("max_x") - C("min_x") + 1, C("max_y") - C("min_y") + 1
    long, thin = F.greatest(w, h), F.greatest(F.lit(1), F.least(w, h))
    aspect = long / thin
    shape = (long >= min_length) & (thin <= max_width) & (aspect >= 3)
    lake = (aspect < 4.5) & (thin >= max(12, int(max_width * 0.75 + 0.5))) & (C("cells") / (w * h) >= 0.6)
    return stats.withColumn("river", shape & ~lake)


def flood(labelled: DataFrame, seeds: DataFrame) -> DataFrame:
    """Cells of the components that hold a seed (x, y)."""
    hit = labelled.join(by_shuffle(seeds.select("x", "y")), ["x", "y"], "left_semi").select("comp").distinct()
    return labelled.join(hit, "comp", "left_semi")


def shore_cells(water: DataFrame) -> DataFrame:
    """Water cells with a side that isn't water."""
    inner = neighbors(water, 4).groupBy("x", "y").agg(F.count("*").alias("n")).filter("n = 4")
    return water.join(by_shuffle(inner), ["x", "y"], "left_anti")


def cliff_edges(water: DataFrame, land: DataFrame, threshold: int) -> DataFrame:
    """(x, y, is_water): both cells of each side where land stands ``threshold`` or more over the water level."""
    sides = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1))]))
    near = water.select(C("x").alias("wx"), C("y").alias("wy"), "level", sides.alias("o")).select("wx", "wy", "level", (C("wx") + C("o.dx")).alias("x"), (C("wy") + C("o.dy")).alias("y"))
    high = near.join(by_shuffle(land.select("x", "y", "h")), ["x", "y"]).filter(C("h") - C("level") >= threshold)
    return high.select("x", "y", F.lit(False).alias("is_water")).union(high.select("wx", "wy", F.lit(True))).distinct()


def allocate(cells: DataFrame, sources: DataFrame, limit: int, block: int = 512) -> DataFrame:
    """(x, y, cost, source): least cost over ``cells`` from sources (x, y, source), sides 10, corners 14, from 10 on, up to limit * 10.

    Of equal costs the lowest source wins. Each block gets the cells within ``limit`` of it, so its own
    cells' answers don't depend on any other block. Sources are cells or stand beside them. A task takes cells from buckets
    by cost, lowest first, and settles each once, so its work follows the cells that are reached.
    """
    marks = cells.select("x", "y", F.lit(True).alias("open"), F.lit(0).cast("bigint").alias("source")).union(sources.select("x", "y", F.lit(False), "source"))
    span = lambda c: F.explode(F.sequence(F.floor((C(c) - limit) / block), F.floor((C(c) + limit) / block)))
    copies = marks.select("*", span("x").alias("bx")).select("*", span("y").alias("by"))

    def settle(table: pa.Table) -> pa.Table:
        x, y, is_open = (table[c].to_numpy() for c in ("x", "y", "open"))
        bx, by = table["bx"][0].as_py() * block, table["by"][0].as_py() * block
        side = np.int64(block + 2 * limit + 3)  # one more than the cells of a row, so that steps don't wrap around
        key = (y - (by - limit - 1)) * side + (x - (bx - limit - 1))
        nodes, place = np.unique(key, return_inverse=True)
        open_ = np.zeros(len(nodes), bool)
        open_[place[is_open]] = True
        # sources as their ranks in the block, so that any number of theirs fits beside the cost
        names, rank = np.unique(table["source"].to_numpy()[~is_open], return_inverse=True)
        best = np.full(len(nodes), np.int64(1) << 62)
        np.minimum.at(best, place[~is_open], (np.int64(10) << 40) + rank)
        buckets = {10: [np.unique(place[~is_open])]}
        for cost in range(10, limit * 10 + 1, 2):  # steps are 10 and 14
            if cost not in buckets:
                continue
            now = np.unique(np.concatenate(buckets.pop(cost)))
            now = now[best[now] >> 40 == cost]
            for dx, dy, step in EIGHT:
                if cost + step > limit * 10:
                    continue
                aim = nodes[now] + dy * side + dx
                at = np.minimum(np.searchsorted(nodes, aim), len(nodes) - 1)
                value = best[now] + (np.int64(step) << 40)
                better = (nodes[at] == aim) & open_[at] & (value < best[at])
                if better.any():
                    np.minimum.at(best, at[better], value[better])
                    buckets.setdefault(cost + step, []).append(at[better])
        x, y = nodes % side + bx - limit - 1, nodes // side + by - limit - 1
        own = open_ & (best < np.int64(1) << 62) & (x >= bx) & (x < bx + block) & (y >= by) & (y < by + block)
        return pa.table({"x": x[own], "y": y[own], "cost": best[own] >> 40, "source": names[best[own] & ((1 << 40) - 1)] if own.any() else best[own]})

    return copies.groupBy("bx", "by").applyInArrow(settle, "x long, y long, cost long, source long")
