"""Range, interval and neighbourhood joins, planned as equi-joins on bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.operators.sampling import offsets
from geoloom.operators.storage import by_shuffle, stored

C = F.col


LEVEL_BITS = 12


def carried(nodes: DataFrame, what: str, by: tuple[str, ...] = (), bits: int | None = None) -> DataFrame:
    """Adds b to (by, k, v), different k in each ``by``: of all lower k, the ``last`` v that isn't null, or the ``sum`` of v.

    Windows only span nodes that share the upper bits of k; what came before is carried the same way
    over the parents, which are ever fewer. So a window holds 4,096 rows at most, whatever the gaps.
    """
    if bits is None:
        least, most = nodes.agg(F.min("k"), F.max("k")).first()
        bits = max(abs(least or 0), abs(most or 0)).bit_length() + 1
    top = bits <= LEVEL_BITS
    parent = F.lit(0).cast("bigint") if top else F.shiftright(C("k").cast("bigint"), LEVEL_BITS)
    placed = nodes.withColumn("_up", parent)
    window = Window.partitionBy(*by, "_up").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("b", F.last("v", ignorenulls=True).over(window) if what == "last" else F.sum("v").over(window))
    if top:
        return placed.drop("_up")
    one = F.max_by("v", F.when(C("v").isNotNull(), C("k"))) if what == "last" else F.sum("v")
    above = carried(placed.groupBy(*by, C("_up").alias("k")).agg(one.alias("v")), what, by, bits - LEVEL_BITS)
    above = above.select(*by, C("k").alias("_up"), C("b").alias("_b"))
    both = F.coalesce("b", "_b") if what == "last" else F.coalesce("b", F.lit(0)) + F.coalesce("_b", F.lit(0))
    return placed.join(by_shuffle(above), [*by, "_up"]).withColumn("b", both).drop("_up", "_b")


def asof_lookup(ids: DataFrame, directory: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Entry of the greatest id at or under each tile_id, of the same ``by``, and whether it covers the id.

    A leaf pointer (run_length 0) covers all ids up to the next entry. Adds entry_id and hit, and the
    entry's run_length and other columns as a struct ``entry``. Of entries with one id the greatest
    stays; null ids and ids before the first entry have none. Each different id is looked up once.
    """
    others = [c for c in directory.columns if c not in (*by, "tile_id")]
    entry = F.struct(C("tile_id").alias("entry_id"), *others)
    entries = directory.filter("tile_id is not null").groupBy(*by, C("tile_id").alias("k")).agg(F.max(entry).alias("v"))
    wanted = ids.filter("tile_id is not null").select(*by, C("tile_id").alias("k")).distinct()
    nodes = stored(entries.join(wanted.withColumn("_w", F.lit(True)), [*by, "k"], "full"))
    found = carried(nodes, "last", by).filter("_w").select(*by, C("k").alias("tile_id"), F.coalesce("v", "b").alias("entry"))
    out = ids.join(found, [*by, "tile_id"], "left").select(*ids.columns, "entry")
    hit = (C("tile_id") == C("entry.entry_id")) | (C("entry.run_length") == 0) | (C("tile_id") - C("entry.entry_id") < C("entry.run_length"))
    return out.withColumns({"entry_id": C("entry.entry_id"), "hit": F.coalesce(hit, F.lit(False))})


def archive_lookup(ids: DataFrame, directories: DataFrame, levels: int = 4) -> DataFrame:
    """Adds depth and entry_id: the tile entry that covers each tile_id, found from the root directory (0) down; null if none does.

    ``directories``: rows (directory, tile_id, run_length, leaf), where an entry of run_length 0 points
    to the directory ``leaf``. Each level is one look-up by directory and id, at most ``levels`` of them.
    """
    names = ids.columns
    now, directories = ids.withColumn("directory", F.lit(0).cast("bigint")), stored(directories)
    done = None
    for depth in range(levels):
        met = stored(asof_lookup(now, directories, ("directory",)))
        leaf = C("hit") & (C("entry.run_length") == 0)
        end = met if depth == levels - 1 else met.filter(~leaf)
        part = end.select(*names, F.when(C("hit") & ~leaf, F.lit(depth)).cast("bigint").alias("depth"), F.when(C("hit") & ~leaf, C("entry_id")).alias("entry_id"))
        done = part if done is None else done.union(part)
        now = met.filter(leaf).select(*names, C("entry.leaf").alias("directory"))
    return done


def bins(low: str, high: str, size: int) -> Column:
    return F.explode(F.sequence(F.floor(C(low) / size), F.floor(C(high) / size)))


def apply_box_caps(cells: DataFrame, boxes: DataFrame, min_y: int, height: str = "elev_m") -> DataFrame:
    """Cells under the kept boxes lowered to one below the lowest box; lowered tells where.

    A box lies in the quadtree level whose nodes are at least as wide and high as it is, where it touches four nodes at most, and cells look up
    the node that holds them at every level that has boxes (every other power of two). So a box of any size is four rows.
    """
    side = F.greatest(C("max_x") - C("min_x"), C("max_y") - C("min_y")) + 1
    level = F.greatest(F.lit(4), 2 * F.ceil(F.log2(side.cast("double")) / 2)).cast("int")
    ranked = boxes.filter("min_x <= max_x and min_y <= max_y").select("min_x", "max_x", "min_y", "max_y", F.greatest(F.lit(min_y), C("base") - 1).alias("_cap"), level.alias("_level"))
    levels = sorted(r[0] for r in ranked.select("_level").distinct().collect())  # up to 30
    node = lambda c, at: F.shiftright(C(c).cast("bigint"), at)
    spread = lambda low, high: F.explode(F.sequence(F.call_function("shiftright", C(low).cast("bigint"), C("_level")), F.call_function("shiftright", C(high).cast("bigint"), C("_level"))))
    binned = ranked.select("*", spread("min_x", "max_x").alias("_bx")).withColumn("_by", spread("min_y", "max_y"))
    nodes = F.explode(F.array(*[F.struct(F.lit(n).alias("_level"), node("x", n).alias("_bx"), node("y", n).alias("_by")) for n in levels])) if levels else F.lit(None).cast("struct<_level:int,_bx:bigint,_by:bigint>")
    placed = cells.select("x", "y", nodes.alias("_n")).select("x", "y", "_n.*")
    caps = placed.join(by_shuffle(binned), ["_level", "_bx", "_by"]).filter("x between min_x and max_x and y between min_y and max_y").groupBy("x", "y").agg(F.min("_cap").alias("cap"))
    out = cells.join(by_shuffle(caps), ["x", "y"], "left")
    return out.withColumns({"lowered": F.coalesce(C("cap") < C(height), F.lit(False)), height: F.least(C(height), "cap")}).drop("cap")


def tiles_near(tiles: DataFrame, cells: DataFrame, size: int, pad: int) -> DataFrame:
    """Tiles that have one of ``cells`` inside or within ``pad`` of them."""
    reach = cells.select(F.explode(F.sequence(F.floor((C("x") - pad) / size), F.floor((C("x") + pad) / size))).alias("tx"), "y")
    reach = reach.select("tx", F.explode(F.sequence(F.floor((C("y") - pad) / size), F.floor((C("y") + pad) / size))).alias("ty")).distinct()
    return tiles.join(by_shuffle(reach), ["tx", "ty"], "left_semi")


def exclude_near(sites: DataFrame, cells: DataFrame, r: int) -> DataFrame:
    """Sites with none of ``cells`` in the square of radius r around them."""
    size = 2 * r + 1
    reach = sites.select("x", "y", bins_of("x", r, size).alias("_bx")).withColumn("_by", bins_of("y", r, size))
    close = by_shuffle(reach).join(cells.select(C("x").alias("_x"), C("y").alias("_y"), F.floor(C("x") / size).alias("_bx"), F.floor(C("y") / size).alias("_by")), ["_bx", "_by"]).filter((F.abs(C("x") - C("_x")) <= r) & (F.abs(C("y") - C("_y")) <= r))
    return sites.join(by_shuffle(close.select("x", "y").distinct()), ["x", "y"], "left_anti")


def bins_of(c: str, r: int, size: int) -> Column:
    return F.explode(F.sequence(F.floor((C(c) - r) / size), F.floor((C(c) + r) / size)))


def nearest_site(points: DataFrame, sites: DataFrame, size: int, key: str = "point_id") -> DataFrame:
    """(key, site_id, dist): the L1-nearest site within its radius among those of the own and the 8 bins around.

    ``sites``: one or no site for each bin (bx, bz) with site_id, sx, sz, radius. Of equally near sites,
    the first in scan order of the bins wins.
    """
    nine = [(dx, dz, k) for k, (dz, dx) in enumerate((dz, dx) for dz in (-1, 0, 1) for dx in (-1, 0, 1))]
    # sites are sent to the bins that see them: they are fewer than the points
    seen = sites.select("*", offsets(nine, "dx", "dz", "k").alias("o")).select((C("bx") - C("o.dx")).alias("bx"), (C("bz") - C("o.dz")).alias("bz"), "site_id", "sx", "sz", "radius", "o.k")
    placed = points.select(key, "x", "y", F.floor(C("x") / size).alias("bx"), F.floor(C("y") / size).alias("bz"))
    met = placed.join(by_shuffle(seen), ["bx", "bz"]).withColumn("d", F.abs(C("x") - C("sx")) + F.abs(C("y") - C("sz"))).filter("d <= radius")
    best = met.groupBy(key).agg(F.min(F.struct("d", "k", "site_id")).alias("b")).select(key, C("b.site_id").alias("site_id"), C("b.d").alias("dist"))
    return points.select(key).join(by_shuffle(best), key, "left")


def k_ring(keys: DataFrame, r: int) -> DataFrame:
    """Tiles of the square ring of radius r around each key, held inside the zoom, each once."""
    side = F.call_function("shiftleft", F.lit(1).cast("bigint"), C("z").cast("int")) - 1
    span = lambda c: F.explode(F.sequence(F.greatest(C(c) - r, F.lit(0)), F.least(C(c) + r, side)))
    return keys.filter(C("x").between(-r, side + r) & C("y").between(-r, side + r)).select("z", span("x").alias("x"), "y").select("z", "x", span("y").alias("y")).distinct()


def geo_k_ring(keys: DataFrame, r: int, step: int = 3, lat: tuple[float, float] = (-60, 84)) -> DataFrame:
    """As ``k_ring`` for tiles of whole degrees (tlat, tlon), inside the latitude bounds."""
    span = lambda c: F.explode(F.sequence(C(c) - r * step, C(c) + r * step, F.lit(step)))
    out = keys.select(span("tlat").alias("tlat"), "tlon").select("tlat", span("tlon").alias("tlon")).distinct()
    return out.filter(C("tlat").between(lat[0], lat[1] - step) & C("tlon").between(-180, 180 - step))


def ancestor_fallback(keys: DataFrame, have: DataFrame, stop_zoom: int = 2) -> DataFrame:
    """For each key the finest stored tile of itself and its parents down to ``stop_zoom``: az, ax, ay."""
    side = F.call_function("shiftleft", F.lit(1).cast("bigint"), C("z").cast("int"))
    ok = C("x").between(0, side - 1) & C("y").between(0, side - 1)
    up = keys.filter(ok).select("z", "x", "y", F.explode(F.sequence(F.lit(0), F.greatest(C("z") - stop_zoom, F.lit(0)).cast("int"))).alias("k"))
    up = up.select("z", "x", "y", (C("z") - C("k")).alias("az"), F.call_function("shiftright", "x", "k").alias("ax"), F.call_function("shiftright", "y", "k").alias("ay"))
    met = by_shuffle(up).join(have.select(C("z").alias("az"), C("x").alias("ax"), C("y").alias("ay")), ["az", "ax", "ay"])
    return met.groupBy("z", "x", "y").agg(F.max(F.struct("az", "ax", "ay")).alias("b")).select("z", "x", "y", "b.*")


EIGHT = [(dx, dy, 14 if dx and dy else 10) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dx or dy]


def neighbors(cells: DataFrame, k: int = 8) -> DataFrame:
    """(x, y, nx, ny, cost): pairs of cells that touch, at sides (k = 4) or also corners."""
    table = [o for o in EIGHT if k == 8 or o[2] == 10]
    out = cells.select("x", "y", offsets(table, "dx", "dy", "c").alias("o")).select("x", "y", (C("x") + C("o.dx")).alias("nx"), (C("y") + C("o.dy")).alias("ny"), C("o.c").alias("cost"))
    return by_shuffle(out).join(cells.select(C("x").alias("nx"), C("y").alias("ny")), ["nx", "ny"]).select("x", "y", "nx", "ny", "cost")


def viewport_tiles(df: DataFrame, key: str, cam_x: Column, cam_y: Column, width: Column, height: Column, px: int = 256) -> DataFrame:
    """Tiles that a window of pixels shows."""
    span = lambda c, n: F.sequence(F.floor(c / px), F.ceil((c + n) / px) - 1)
    rows = df.select(key, span(cam_x, width).alias("_xs"), span(cam_y, height).alias("_ys"))
    return rows.select(key, F.explode("_xs").alias("x"), "_ys").select(key, "x", F.explode("_ys").alias("y"))


def named_by_rules(ids: DataFrame, rules: DataFrame, col: str = "id") -> DataFrame:
    """(_id): the different ids that a rule names: kind equals, prefix or contains, with a pattern.

    Ids meet rules on the first three letters of a pattern (all of them, if it is shorter), which stand
    somewhere in the id; so rules may be many, and no id meets all of them. Empty patterns, which name every id or only the empty one, are asked once for all ids.
    """
    names = ids.select(C(col).alias("_id")).filter("_id is not null").distinct()
    empty = rules.filter("pattern = ''").agg(F.coalesce(F.bool_or(C("kind").isin("prefix", "contains")), F.lit(False)).alias("_all"), F.coalesce(F.bool_or(C("kind") == "equals"), F.lit(False)).alias("_none"))
    plain = names.crossJoin(F.broadcast(empty)).filter("_all or (_none and _id = '')").select("_id")  # one row
    off = rules.filter("pattern <> ''").select("kind", "pattern", F.substring("pattern", 1, 3).alias("_gram")).distinct()
    length = F.length("_id")
    starts = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(length - n + 1, F.lit(1))), lambda i: F.substring(C("_id"), i, F.lit(n)))
    grams = names.select("_id", F.explode(F.array_distinct(F.concat(starts(1), starts(2), starts(3)))).alias("_gram"))
    match = ((C("kind") == "equals") & (C("_id") == C("pattern"))) | ((C("kind") == "prefix") & F.startswith("_id", "pattern")) | ((C("kind") == "contains") & F.contains("_id", "pattern"))
    return by_shuffle(grams).join(off, "_gram").filter(match).select("_id").union(plain).distinct()


def filter_by_rules(ids: DataFrame, rules: DataFrame, col: str = "id") -> DataFrame:
    """Ids that no switched-off rule names. Null ids stay."""
    return ids.join(named_by_rules(ids, rules, col), C(col) == C("_id"), "left_anti")


def filter_sets_by_rules(members: DataFrame, rules: DataFrame, key: str, col: str = "id") -> DataFrame:
    """The rows (key, id) of sets of which no member is named by a switched-off rule: one named member takes its whole set. Null members name nothing.

    Ids are judged once each, however many sets hold them; the keys of named members then leave with all their rows.
    """
    gone = members.join(named_by_rules(members, rules, col), C(col) == C("_id")).select(C(key).alias("_gone")).distinct()
    return members.join(gone, C(key).eqNullSafe(C("_gone")), "left_anti")
