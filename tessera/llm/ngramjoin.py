"""Near-duplicate documents by a join in the metric space of Jaccard distance.

Documents are sets of five-word shingles; two link at a distance of r = 0.25 or less.

1. Equal sets share a class, and a class goes on as one document.
2. A set can only have a partner if at most n/4 of its shingles occur in no other class. A fixed
   part of the space of hashes is enough to rule out most documents without loss.
3. What is left is dealt to cells by its rarest shingles, so that two documents that link share a
   cell (all but its n - ceil(0.75 n) + 1 rarest shingles may differ). Far more than all distances
   between texts are 1, so pivots of the whole corpus would part nothing; those of a cell do.
4. In each cell some documents are pivots, the more the larger it is, and the distance of each document to
   each pivot is computed. Documents of one pivot's ball of radius r are linked by it. Each document belongs to the
   Voronoi region of its nearest pivot q, and visits the region of a pivot p if d(x, p) <= d(x, q) + 2r: by the
   triangle inequality two documents that link meet in the region of one of them.
5. Regions are cells again, with pivots of their own, until they are small or until the windows no longer part them.
6. In what is left, documents of different components are compared where their distances to the pivot
   differ by r at most and their sketches (parities of shingles by hash) by no more bits than sets that link may
   differ in shingles, and exactly. Documents that a common pivot links need no look at each other.

Components come from stars. Neither pairs of a cell nor of a region are written, but for those of step 6.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordsets
from .components import connected_components
from .scratch import drop, release, save

#: Share of hashes that step 2 looks at; size of a small region; members for each pivot, and most pivots of a region;
#: share of a region's size from which the windows count as not parting it; most documents of a block.
EIGHTHS, SMALL, MEMBERS, PIVOTS, PARTED, BLOCK = 3, 16, 32, 4, 0.75, 256
#: So many ids at most go to all executors, to pick texts or sets before these are shuffled.
BROADCAST_IDS = 1_000_000
RADIUS = 0.25 + 1e-9


def _needed(n):
    return F.ceil(n * 3 / F.lit(4))


def _few(ids: DataFrame) -> DataFrame:
    """``ids``, which was saved, to be broadcast if it has few rows."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b), repeated or not -> each pair's a, b, d (Jaccard distance) and link (exact, in whole numbers), written."""
    pairs = save(pairs.distinct())
    ids = save(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct())
    sets = sets.join(_few(ids), "rep", "left_semi")
    x, y = (sets.select(F.col("rep").alias(c), F.col("s").alias(f"s{c}")) for c in "ab")
    both = pairs.join(x, "a").join(y, "b")
    common = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - common
    out = save(both.select("a", "b", (1 - common / union).alias("d"), (common * 100 >= union * 75).alias("link")))
    drop(pairs)
    drop(ids)
    return out


def _cells(sets: DataFrame) -> DataFrame:
    """(cell, rep, n, u, i): each set at its rarest shared shingles; i is the shingle's place in the set's order, behind the u that no other set has."""
    df = sets.select(F.explode("s").alias("h")).groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    # rarity by powers of two and the hash's upper 58 bits as one number: its order is the sets' order
    key = F.shiftleft(F.floor(F.log2("df")).cast("long"), 58).bitwiseOR(F.shiftrightunsigned("h", 6))
    own = sets.select("rep", "n", F.explode("s").alias("h")).join(df.select("h", key.alias("key")), "h").groupBy("rep", "n").agg(F.sort_array(F.collect_list("key")).alias("o"))
    unique = F.col("n") - F.size("o")
    length = F.col("n") - _needed(F.col("n")) + 1 - unique
    own = own.where(length > 0).select("rep", "n", unique.alias("u"), F.posexplode(F.slice("o", F.lit(1), length.cast("int"))).alias("i", "cell"))
    return own.select("cell", "rep", "n", "u", (F.col("i") + F.col("u")).alias("i"))


def _may_link(x: str, y: str):
    """Length and positional filters for two rows of one cell."""
    nx, ny, ix, iy, ux, uy = (F.col(f"{t}.{c}") for c in ("n", "i", "u") for t in (x, y))
    # before this shingle only those can be common that other sets have too
    return (nx * 4 >= ny * 3) & (ny * 4 >= nx * 3) & (F.least(nx - ix, ny - iy) + F.least(ix - ux, iy - uy) >= F.ceil((nx + ny) * 3 / F.lit(7)))


def _close(x: str, y: str):
    """Whether the sketches of two rows differ in no more bits than their sets may in shingles; true for all that link."""
    differ = sum((F.bit_count(F.col(f"{x}.sketch")[k].bitwiseXOR(F.col(f"{y}.sketch")[k])) for k in range(wordsets.SKETCH)), F.lit(0))
    return differ * 7 <= F.col(f"{x}.n") + F.col(f"{y}.n")


def _apart(every: DataFrame) -> DataFrame:
    """``every`` and m, the size of its cell, for one of the cells that hold the same sets; cells of one set are left out.

    Near copies share all their rare shingles, so most cells tell nothing that another one does not. The cells' members are compared by 128 bits.
    """
    alike = every.groupBy("cell").agg(F.count("*").alias("m"), *(F.bit_xor(F.xxhash64("rep", F.lit(k))).alias(f"x{k}") for k in (0, 1))).where("m > 1")
    kept = alike.groupBy("m", "x0", "x1").agg(F.min("cell").alias("cell")).select("cell", "m")
    return every.join(kept, "cell")


def _parted(regions: DataFrame, sets: DataFrame, level: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``regions`` (region, cell, rep, n, u, i, mask, m) -> links (a, b), leaves and regions of the next level.

    Bit k of ``mask`` tells that a row visits its region of level k; of two rows that are compared, one must be at home at every level.
    """
    share = F.pmod(F.xxhash64("rep"), F.least(F.ceil(F.col("m") / MEMBERS), F.lit(PIVOTS)))
    pivots = regions.groupBy("region", share.alias("k")).agg(F.min("rep").alias("p")).select("region", "p")
    met = regions.join(pivots, "region")
    dist = _measured(met.where("rep <> p").select(F.col("rep").alias("a"), F.col("p").alias("b")), sets)
    own = save(met.join(dist.withColumnsRenamed({"a": "rep", "b": "p"}), ["rep", "p"], "left"))
    # a pivot's pairs are all measured now, so it goes no further
    near = own.groupBy("region", "rep").agg(F.min("d").alias("least"), F.min_by("p", F.struct("d", "p")).alias("q"), F.max(F.col("rep") == F.col("p")).alias("pivot")).where("not pivot")
    at = own.join(near, ["region", "rep"]).where((F.col("p") == F.col("q")) | ((F.col("p") < F.col("q")) & (F.col("d") <= F.col("least") + 2 * RADIUS)))
    visit = F.when(F.col("p") != F.col("q"), F.lit(1 << level)).otherwise(F.lit(0)).cast("long")
    new = at.select(F.xxhash64("region", "p", F.lit(level)).alias("region"), "cell", "rep", "n", "u", "i", F.col("mask").bitwiseOR(visit).alias("mask"), "d", "link", F.col("m").alias("of"))
    new = save(new)
    drop(own)
    sizes = new.groupBy("region").agg(F.count("*").alias("m"), F.min(F.col("link").cast("int")).alias("linked"), F.bit_and("mask").alias("away"))
    every, new = new, save(new.join(sizes.where("m > 1 and linked = 0 and away = 0").select("region", "m"), "region"))
    drop(every)
    leaf = (F.col("m") <= SMALL) | (F.col("m") > F.col("of") * PARTED)
    return dist.where("link").select("a", "b"), new.where(leaf), new.where(~leaf).drop("d", "link", "of")


def set_links(sets: DataFrame) -> DataFrame:
    """``sets`` (rep, n, s), all different -> edges (a, b) that leave the components of all linked pairs."""
    cells = save(_cells(sets))
    every = save(_apart(cells))
    drop(cells)
    regions = every.select(F.col("cell").alias("region"), "cell", "rep", "n", "u", "i", F.lit(0).cast("long").alias("mask"), "m")
    links, leaves, level = None, None, 0
    while level == 0 or not regions.isEmpty():
        found, small, regions = _parted(regions, sets, level)
        links = found if links is None else links.union(found)
        leaves = small if leaves is None else leaves.union(small)
        level += 1
        release(sets.sparkSession)
    comp = save(connected_components(links))
    rows = leaves.select("region", "cell", "rep", "n", "u", "i", "mask", "d").join(comp.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    # only pairs of different components are open, and one of them is outside of the region's largest
    sizes = rows.groupBy("region", "component").agg(F.count("*").alias("m"))
    main = sizes.groupBy("region").agg(F.max_by("component", F.struct("m", "component")).alias("main"), F.sum("m").alias("all"), F.count("*").alias("parts")).where("parts > 1")
    rows = save(rows.join(main.select("region", "main", F.ceil(F.col("all") / BLOCK).alias("nb")), "region"))
    prefixes = every.join(rows.select("rep").distinct(), "rep", "left_semi").groupBy("rep").agg(F.collect_list("cell").alias("cells"))
    rows = rows.join(prefixes.join(sets.select("rep", "sketch"), "rep"), "rep")
    few = rows.where("component <> main").withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)))
    x, y = few.alias("x"), rows.withColumn("b", F.pmod(F.xxhash64("rep"), F.col("nb"))).alias("y")
    open_ = (F.col("x.component") != F.col("y.component")) & ((F.col("y.component") == F.col("y.main")) | (F.col("x.rep") < F.col("y.rep")))
    window = (F.abs(F.col("x.d") - F.col("y.d")) <= RADIUS) & (F.col("x.mask").bitwiseAND(F.col("y.mask")) == 0) & _may_link("x", "y") & _close("x", "y")
    # a pair may share many cells; it is looked at in the first of them
    here = F.array_min(F.array_intersect("x.cells", "y.cells")) == F.col("x.cell")
    both = x.join(y, (F.col("x.region") == F.col("y.region")) & (F.col("x.b") == F.col("y.b")) & open_ & window & here)
    pairs = both.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b"))
    return save(links.union(_measured(pairs, sets).where("link").select("a", "b")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) for every row of ``docs``: component_id is the smallest id reached by links.

    Texts without words (null, empty, blank) have no shingles and link with nothing, and so do rows
    without an id. Repeated rows are one class and give a row each; rows of one id with different texts are
    documents of their own, which only share their id. Other columns are ignored.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    read = save(own.mapInArrow(wordsets.keys(EIGHTHS), "doc bigint, n bigint, k1 bigint, k2 bigint, part array<bigint>"))
    known = F.expr("n > 0 and doc is not null")
    seen = read.where(known).select(F.explode("part").alias("h"), "k1")
    unique = seen.groupBy("h").agg(F.min("k1").alias("k1"), F.max("k1").alias("b")).where("k1 = b").groupBy("k1").agg(F.count("*").alias("u"))
    unique = save(unique)
    keyed = save(read.drop("part"))
    drop(read)
    release(docs.sparkSession)
    # a class is known by 64 bits of its set's hash
    classes = save(keyed.where(known).groupBy("k1", "k2", "n").agg(F.min("doc").alias("first")))
    maybe = save(classes.join(unique, "k1", "left").where(F.coalesce("u", F.lit(0)) <= F.col("n") - _needed(F.col("n"))).select("first", "k1"))
    drop(unique)
    # a document's texts may give other sets than that of its class
    ids = save(maybe.select(F.col("first").alias("doc")).distinct())
    got = own.join(_few(ids), "doc", "left_semi").select("doc", "text").mapInArrow(wordsets.sets, "first bigint, rep bigint, n bigint, s array<bigint>, sketch array<bigint>")
    sets = save(got.join(_few(maybe.withColumnRenamed("k1", "rep")), ["first", "rep"], "left_semi").select("rep", "n", "s", "sketch"))
    drop(ids)
    if not sets.groupBy("rep").agg(F.count("*").alias("rows")).where("rows > 1").isEmpty():
        every, sets = sets, save(sets.dropDuplicates(["rep"]))
        drop(every)
    drop(maybe)
    release(docs.sparkSession)
    comp = save(connected_components(set_links(sets)).withColumnRenamed("id", "k1"))
    drop(sets)
    least = classes.join(comp, "k1").groupBy("component").agg(F.min("first").alias("least"))
    reps = classes.join(comp.join(least, "component").select("k1", "least"), "k1", "left").select("k1", "k2", "n", F.coalesce("least", "first").alias("component"))
    out = keyed.join(reps, ["k1", "k2", "n"], "left")
    return out.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("doc").isNull(), None).otherwise(F.coalesce("component", "doc")).alias("component_id"))
