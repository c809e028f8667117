"""Grouping tiles into size-bounded packs, manifests and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Pack sizes in bytes and spans in tiles.
END_RECORD_BYTES = 22
TARGET_BYTES = 7 * 1024 * 1024
SOFT_MAX_BYTES = 8 * 1024 * 1024
HARD_MAX_BYTES = 10 * 1024 * 1024
DENSE_BYTES = 512 * 1024
MAX_GAP_TILES = 8
MAX_SPAN_TILES = 8
SEED_TILES = 8

PACKED = "tx long, ty long, zip_bytes long, dense boolean, pack_no int, seed_x long, seed_y long"


class SeedGrid:
    """The tiles of one 8 x 8 seed square, in the order of a quadtree.

    Bit by bit, x before y, the two coordinates are woven into a code of 0 to 63. Every aligned
    square of side 4, 2 or 1 is then a range of codes, and its bytes are a
    difference of two prefix sums.
    """

    def __init__(self, x, y, size):
        import numpy as np

        bits = [(x >> k & 1) << 2 * k + 1 | (y >> k & 1) << 2 * k for k in range(3)]
        code = bits[0] | bits[1] | bits[2]
        self.order = np.argsort(code)
        self.code, self.x, self.y, self.size = (v[self.order] for v in (code, x, y, size))
        self.sums = np.concatenate([[0], np.cumsum(self.size)])

    def bytes(self, a: int, b: int) -> int:
        return END_RECORD_BYTES + int(self.sums[b] - self.sums[a])

    def quarters(self, a: int, b: int, codes: int):
        """The parts of the tiles a to b by the ``codes`` a square covers."""
        import numpy as np

        cuts = a + np.flatnonzero(np.diff(self.code[a:b] // codes)) + 1
        return zip([a, *cuts.tolist()], [*cuts.tolist(), b])

    def fitting(self, a: int, b: int, codes: int, limit: int):
        """Ranges of tiles within the limit: squares of a quarter the area, at last halves of a 2 x 2 square."""
        if self.bytes(a, b) <= limit or b - a == 1:
            yield a, b
        elif codes > 4:
            for c, d in self.quarters(a, b, codes // 4):
                yield from self.fitting(c, d, codes // 4, limit)
        else:
            middle = (a + b + 1) // 2
            yield from self.fitting(a, middle, codes, limit)
            yield from self.fitting(middle, b, codes, limit)


def _merged(box, size, target: int, limit: int):
    """Group number of each part after joining, again and again, the pair with the least gap, then the size nearest to the target.

    ``box`` has min x, min y, max x, max y per part. All pairs of the at most 64
    parts are weighed at once in square tables.
    """
    import numpy as np

    group, box, size = np.arange(len(size)), box.copy(), size.copy()
    alive = np.ones(len(size), bool)
    while True:
        low, high = np.minimum(box[:, None, :2], box[None, :, :2]), np.maximum(box[:, None, 2:], box[None, :, 2:])
        apart = np.maximum(0, np.maximum(box[:, None, :2] - box[None, :, 2:], box[None, :, :2] - box[:, None, 2:]) - 1)
        gap = np.hypot(apart[..., 0], apart[..., 1])
        total = size[:, None] + size[None, :] - END_RECORD_BYTES
        fits = ((total <= limit) & ((high - low).max(axis=2) < MAX_SPAN_TILES) & (gap <= MAX_GAP_TILES)
                & (np.minimum(size[:, None], size[None, :]) < target) & alive[:, None] & alive[None, :])
        i, j = np.nonzero(np.triu(fits, 1))
        if not len(i):
            return group
        # Equal gap and size: the pair whose corners come first.
        corner = box[i, 0] * 64 + box[i, 1], box[j, 0] * 64 + box[j, 1]
        k = np.lexsort((j, i, corner[1], corner[0], np.abs(target - total[i, j]), gap[i, j]))[0]
        a, b = i[k], j[k]
        group[group == b], alive[b] = a, False
        size[a] = total[a, b]
        box[a] = np.concatenate([low[a, b], high[a, b]])


def refused_tiles(tiles: DataFrame, hard_max: int = HARD_MAX_BYTES) -> DataFrame:
    """Tiles that no pack may hold, with the reason; a build must not go on with any."""
    over = F.col("zip_bytes") + END_RECORD_BYTES > hard_max
    return tiles.filter(over | F.col("zip_bytes").isNull()).withColumn(
        "reason", F.when(over, "TILE_OVER_HARD_LIMIT").otherwise("TILE_SIZE_UNKNOWN"))


def assign_packs(tiles: DataFrame, target: int = TARGET_BYTES, soft_max: int = SOFT_MAX_BYTES,
                 dense: int = DENSE_BYTES, hard_max: int = HARD_MAX_BYTES) -> DataFrame:
    """Give every tile (tx, ty, zip_bytes) a pack within its 8 x 8 seed square.

    Squares of 2 x 2 tiles holding 512 KiB or more stay on their own; the rest of
    a seed is split to fit the soft limit and merged towards the target. A seed
    never holds more than 64 distinct tiles, so the groups stay small. Tiles over
    the hard limit get no pack (``refused_tiles`` lists them, ``coverage_check``
    misses them); of a repeated tile the largest row is packed and
    ``coverage_check`` reports the repetition.
    """
    import numpy as np
    import pandas as pd

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y, size = (pdf[c].to_numpy(np.int64) for c in ("tx", "ty", "zip_bytes"))
        grid = SeedGrid(x % SEED_TILES, y % SEED_TILES, size)
        crowded = np.zeros(len(x), bool)
        ranges = []
        for a, b in grid.quarters(0, len(x), 4):
            if grid.bytes(a, b) >= dense:
                crowded[a:b] = True
                ranges += [(np.arange(c, d), True) for c, d in grid.fitting(a, b, 4, soft_max)]
        rest = np.flatnonzero(~crowded)
        if len(rest):
            sparse = SeedGrid(grid.x[rest], grid.y[rest], grid.size[rest])
            parts = list(sparse.fitting(0, len(rest), 64, soft_max))
            box = np.array([[sparse.x[a:b].min(), sparse.y[a:b].min(), sparse.x[a:b].max(), sparse.y[a:b].max()] for a, b in parts])
            group = _merged(box, np.array([sparse.bytes(a, b) for a, b in parts]), target, soft_max)
            own = np.repeat(group, [b - a for a, b in parts])
            ranges += [(rest[sparse.order][own == g], False) for g in np.unique(group)]
        ranges.sort(key=lambda r: (grid.x[r[0]].min(), grid.y[r[0]].min(), grid.x[r[0]].max(), grid.y[r[0]].max()))
        done = pd.concat([pdf.iloc[grid.order[at]].assign(dense=d, pack_no=n) for n, (at, d) in enumerate(ranges)])
        return done[["tx", "ty", "zip_bytes", "dense", "pack_no", "seed_x", "seed_y"]]

    seeds = tiles.select("tx", "ty", F.col("zip_bytes").cast("long").alias("zip_bytes"),
                         F.floor(F.col("tx") / SEED_TILES).alias("seed_x"), F.floor(F.col("ty") / SEED_TILES).alias("seed_y"))
    seeds = seeds.filter(F.col("zip_bytes") + END_RECORD_BYTES <= hard_max)
    single = seeds.groupBy("tx", "ty", "seed_x", "seed_y").agg(F.max("zip_bytes").alias("zip_bytes"))
    return single.groupBy("seed_x", "seed_y").applyInPandas(plan, PACKED)


def pack_table(assigned: DataFrame) -> DataFrame:
    """One row per pack with bounds, size and a key from its sorted tiles.

    A pack holds at most 64 tiles, so its key list is small.
    """
    from ..functions.geo import tile_key

    keys = F.transform(F.sort_array(F.collect_list(F.struct("tx", "ty"))), lambda t: tile_key(t["tx"], t["ty"]))
    packs = assigned.groupBy("seed_x", "seed_y", "pack_no").agg(
        F.array_join(keys, "|").alias("_tiles"), F.count(F.lit(1)).alias("tiles"), F.bool_or("dense").alias("dense"),
        (F.sum("zip_bytes") + END_RECORD_BYTES).alias("bytes"), F.min("tx").alias("min_x"), F.min("ty").alias("min_y"),
        F.max("tx").alias("max_x"), F.max("ty").alias("max_y"))
    return packs.withColumn("pack", group_key("min_x", "min_y", "max_x", "max_y", "_tiles")).withColumn(
        "content_hash", F.sha2("_tiles", 256)).drop("_tiles")


def group_key(min_x, min_y, max_x, max_y, tiles) -> Column:
    """Bounds and the first ten hex digits of the hash of the sorted tile keys."""
    c = lambda v: F.col(v) if isinstance(v, str) else v
    return F.concat(c(min_x).cast("string"), F.lit("_"), c(min_y).cast("string"), F.lit("-"),
                    c(max_x).cast("string"), F.lit("_"), c(max_y).cast("string"), F.lit("-"),
                    F.substring(F.sha2(c(tiles), 256), 1, 10))


def manifest(assigned: DataFrame, packs: DataFrame, settings: dict[str, str]) -> DataFrame:
    """Tile-to-pack table with the manifest's content hash.

    The hash combines per-tile hashes independent of order, and the settings;
    it needs no list of tiles in one place. Works on planned sizes as well.
    """
    tiles = assigned.join(packs.select("seed_x", "seed_y", "pack_no", "pack"), ["seed_x", "seed_y", "pack_no"])
    tiles = tiles.select("tx", "ty", "zip_bytes", "dense", "pack")
    part = F.conv(F.substring(F.sha2(F.concat_ws("|", "tx", "ty", "pack", "zip_bytes"), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    total = tiles.agg(F.count(F.lit(1)).alias("n"), F.sum(part).alias("s"))
    fixed = "|".join(f"{k}={settings[k]}" for k in sorted(settings))
    digest = total.select(F.sha2(F.concat_ws("|", F.lit(fixed), "n", "s"), 256).alias("manifest_hash"))
    return tiles.withColumn("manifest_hash", digest.scalar())


def group_relation(a: tuple, b: tuple) -> tuple[Column, Column, Column]:
    """(gap, span_x, span_y) of two groups given as (min_x, min_y, max_x, max_y)."""
    c = lambda v: F.col(v) if isinstance(v, str) else v
    a, b = [c(v) for v in a], [c(v) for v in b]
    dx = F.greatest(F.lit(0), a[0] - b[2] - 1, b[0] - a[2] - 1)
    dy = F.greatest(F.lit(0), a[1] - b[3] - 1, b[1] - a[3] - 1)
    return (F.hypot(dx.cast("double"), dy.cast("double")), F.greatest(a[2], b[2]) - F.least(a[0], b[0]) + 1,
            F.greatest(a[3], b[3]) - F.least(a[1], b[1]) + 1)


def coverage_check(source: DataFrame, packed: DataFrame) -> DataFrame:
    """Tiles not packed exactly once, or repeated in the source; empty if right."""
    s = source.groupBy("tx", "ty").agg(F.count(F.lit(1)).alias("in_source"))
    p = packed.groupBy("tx", "ty").agg(F.count(F.lit(1)).alias("in_packs"))
    both = s.join(p, ["tx", "ty"], "full_outer").fillna(0, ["in_source", "in_packs"])
    return both.filter((F.col("in_source") != 1) | (F.col("in_packs") != 1))


def floor_quantiles(rows: DataFrame, value: str, fractions: dict[str, float], buckets: int = 4096) -> DataFrame:
    """The sorted value at index floor((n - 1) f) for each named fraction.

    No sort of the whole column: a histogram of ``buckets`` equal ranges tells
    in which range each index falls, and only the distinct values of those
    ranges are counted and accumulated. Repeated values count as one row.
    """
    known = rows.filter(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("_v"))
    ends = known.agg(F.struct(F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.count(F.lit(1)).alias("n")).alias("e"))
    wide = known.withColumn("_e", ends.scalar())
    width = (F.col("_e.hi") - F.col("_e.lo")) / buckets
    slot = F.when(width > 0, F.least(F.lit(buckets - 1), F.floor((F.col("_v") - F.col("_e.lo")) / width))).otherwise(F.lit(0))
    placed = wide.withColumn("_b", slot.cast("int"))
    counts = placed.groupBy("_b").agg(F.count(F.lit(1)).alias("_c"), F.max("_e.n").alias("_n"))
    # At most ``buckets`` rows reach this window.
    before = counts.withColumn("_before", F.coalesce(F.sum("_c").over(
        Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), F.floor((F.col("_n") - 1) * F.lit(f)).alias("i"))
                       for name, f in fractions.items()])
    hit = before.withColumn("_w", F.explode(F.filter(wanted, lambda w: (w["i"] >= F.col("_before")) & (
        w["i"] < F.col("_before") + F.col("_c"))))).select("_b", "_before", "_w.name", "_w.i")
    # One row per fraction: small enough to broadcast.
    inside = placed.join(F.broadcast(hit.select("_b").distinct()), "_b").groupBy("_b", "_v").agg(F.count(F.lit(1)).alias("_k"))
    w = Window.partitionBy("_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    run = inside.withColumn("_to", F.sum("_k").over(w))
    found = run.join(F.broadcast(hit), "_b").filter(
        (F.col("i") - F.col("_before") >= F.col("_to") - F.col("_k")) & (F.col("i") - F.col("_before") < F.col("_to")))
    picks = [F.max(F.when(F.col("name") == n, F.col("_v"))).alias(n) for n in fractions]
    return found.agg(*picks)


def pack_stats(packs: DataFrame, value: str = "bytes") -> DataFrame:
    """Count, total, least, greatest, median and 95th percentile of pack sizes."""
    whole = packs.agg(F.count(F.lit(1)).alias("packs"), F.coalesce(F.sum(value), F.lit(0)).alias("total_bytes"),
                      F.coalesce(F.min(value), F.lit(0)).alias("min_bytes"),
                      F.coalesce(F.max(value), F.lit(0)).alias("max_bytes"))
    q = floor_quantiles(packs, value, {"p50_bytes": 0.5, "p95_bytes": 0.95})
    pair = q.select(F.struct("p50_bytes", "p95_bytes").alias("q")).scalar()
    return whole.withColumn("_q", pair).select("packs", "total_bytes", "min_bytes", "max_bytes", "_q.*")


def file_differences(expected: DataFrame, present: DataFrame, key: list[str]) -> DataFrame:
    """Missing and extra entries, and entries listed or present more than once."""
    e = expected.groupBy(*key).agg(F.count(F.lit(1)).alias("listed"))
    p = present.groupBy(*key).agg(F.count(F.lit(1)).alias("found"))
    both = e.join(p, key, "full_outer").fillna(0, ["listed", "found"])
    state = (F.when(F.col("found") == 0, "missing").when(F.col("listed") == 0, "extra")
             .when((F.col("found") > 1) | (F.col("listed") > 1), "repeated").otherwise("ok"))
    return both.withColumn("state", state)


def release_check(packs: DataFrame, assets: DataFrame, hard_max: int = HARD_MAX_BYTES) -> DataFrame:
    """One row per pack with the first failed check, or ``ok``.

    ``packs``: file, bytes, sha256. ``assets``: file, bytes, sha256 as found.
    """
    a = assets.select("file", F.col("bytes").alias("_bytes"), F.col("sha256").alias("_sha"))
    state = (F.when(F.col("_bytes").isNull(), "missing").when(F.col("bytes") != F.col("_bytes"), "byte count mismatch")
             .when(F.col("sha256") != F.col("_sha"), "checksum mismatch")
             .when(F.col("_bytes") > hard_max, "over hard limit").otherwise("ok"))
    return packs.join(a, "file", "left").withColumn("state", state).drop("_bytes", "_sha")


def tile_quality(tiles: DataFrame, buildings: DataFrame, expected: DataFrame) -> DataFrame:
    """Counters over written tiles against their manifest entries.

    ``tiles``: tx, ty, fingerprint, building_ground, tunnels, terrain.
    ``buildings``: tx, ty, id, ground and the height envelope, min_height_adjusted.
    ``expected``: tx, ty, fingerprint, buildings, tunnels, terrain.
    """
    c = F.col
    names = ("height", "height_lower", "height_upper", "min_height", "min_height_lower", "min_height_upper")
    whole = c(names[0]).isNotNull()
    for n in names[1:]:
        whole = whole & c(n).isNotNull()
    valid = whole & (c("min_height") <= c("height")) & (c("min_height_lower") <= c("height_lower")) & (
        c("min_height_upper") <= c("height_upper"))
    per_id = buildings.groupBy("tx", "ty", "id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(c("ground").isNull()).alias("no_ground"),
        F.count_if("min_height_adjusted").alias("adjusted"), F.count_if(~F.coalesce(valid, F.lit(False))).alias("bad"))
    per_tile = per_id.groupBy("tx", "ty").agg(
        F.sum("n").alias("_buildings"), F.sum("no_ground").alias("_no_ground"), F.sum("adjusted").alias("_adjusted"),
        F.sum("bad").alias("_bad"), F.sum(c("n") - 1).alias("_repeated"))
    e = expected.select("tx", "ty", c("fingerprint").alias("_f"), c("buildings").alias("_eb"),
                        c("tunnels").alias("_et"), c("terrain").alias("_ee"))
    rows = tiles.join(per_tile, ["tx", "ty"], "left").fillna(
        0, ["_buildings", "_no_ground", "_adjusted", "_bad", "_repeated"]).join(e, ["tx", "ty"], "full_outer")
    wrong = ((c("fingerprint") != c("_f")) | (c("_buildings") != c("_eb")) | (c("tunnels") != c("_et"))
             | (c("terrain") != c("_ee")))
    ground = c("building_ground") != (c("_no_ground") == 0)
    both = c("fingerprint").isNotNull() & c("_f").isNotNull()
    n = lambda cond: F.count_if(F.coalesce(cond, F.lit(False)))
    return rows.agg(
        n(both).alias("tiles"), n(c("fingerprint").isNull()).alias("missing_files"), n(c("_f").isNull()).alias("extra_files"),
        (n(both & wrong) + n(both & ground)).alias("metadata_errors"),
        F.sum("_buildings").alias("buildings"), F.sum("tunnels").alias("tunnels"), F.sum("terrain").alias("terrain"),
        F.sum("_no_ground").alias("missing_ground"), F.sum("_adjusted").alias("adjusted_min_heights"),
        F.sum("_bad").alias("invalid_envelopes"), F.sum("_repeated").alias("duplicate_ids"))
