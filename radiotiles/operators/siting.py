"""Base-station sites by greedy coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from radiotiles.functions.radio import predict_db
from radiotiles.sources.scratch import stage

#: Steps after which what is left to cover is written.
KEPT = 4


def cover_edges(sites: DataFrame, points: DataFrame, radius: float) -> DataFrame:
    """(candidate_id, point_id) closer than `radius`: a range join on square cells of that size, in which
    each site meets the points of its own and the eight cells around."""
    cell = lambda v: F.floor(F.col(v) / radius)
    near = F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))
    spread = sites.withColumn("i", near).withColumn("i", cell("sx") + F.col("i")).withColumn("j", near).withColumn("j", cell("sy") + F.col("j"))
    placed = points.withColumn("i", cell("px")).withColumn("j", cell("py"))
    d2 = F.pow(F.col("sx") - F.col("px"), F.lit(2)) + F.pow(F.col("sy") - F.col("py"), F.lit(2))
    return spread.join(placed, ["i", "j"]).where(d2 < radius * radius).select("candidate_id", "point_id")


def places_of(rows: DataFrame, unit: str, x: str, y: str) -> DataFrame:
    """(`unit`, `x`, `y`, weight): one row for all units at the same place, with the least of their ids and their number.  A unit
    with several places keeps them all to itself."""
    own = rows.select(unit, x, y).where(F.col(x).isNotNull() & F.col(y).isNotNull()).distinct()
    several = own.groupBy(unit).agg(F.count("*").alias("places"))
    alone = F.when(F.col("places") > 1, F.col(unit))
    merged = own.join(several, unit).groupBy(x, y, alone.alias("alone")).agg(F.min(unit).alias(unit), F.count("*").alias("weight"))
    return merged.select(unit, x, y, "weight")


def disc_counts(sites: DataFrame, points: DataFrame, radius: float) -> DataFrame:
    """(candidate_id, n): how many pairs `cover_edges` has of each site.  Rows at one place meet as one, so the work
    grows with the places and not with the pairs of rows."""
    held = points.groupBy("px", "py").agg(F.count("*").alias("weight")).withColumn("point_id", F.struct("px", "py"))
    stood = sites.groupBy("sx", "sy").agg(F.count("*").alias("many")).withColumn("candidate_id", F.struct("sx", "sy"))
    near = cover_edges(stood, held.select("point_id", "px", "py"), radius).join(held.select("point_id", "weight"), "point_id").groupBy("candidate_id").agg(F.sum("weight").alias("n"))
    found = near.select("candidate_id.*", "n")
    return sites.select("candidate_id", "sx", "sy").join(found, ["sx", "sy"]).groupBy("candidate_id").agg(F.sum("n").alias("n"))


def disc_places(sites: DataFrame, points: DataFrame, radius: float) -> DataFrame:
    """Edges (candidate_id, point_id, weight) for `greedy_cover` with the steps of all edges: a point stands for those at its place, and
    a site for those at its own, of which only the least id can be taken as the others cover nothing after it."""
    held = places_of(points, "point_id", "px", "py")
    edges = cover_edges(places_of(sites, "candidate_id", "sx", "sy"), held, radius)
    return edges.join(held.select("point_id", "weight").distinct(), "point_id")


def power_places(sites: DataFrame, points: DataFrame, threshold_dbm: float, d0: float = 1.0) -> DataFrame:
    """Edges (candidate_id, point_id, weight) for `greedy_cover` with the steps of all edges of `cover_by_power`.  A point stands for
    those at its place.  What sites at one place cover is nested, as power falls with distance: a site that covers no more than
    another one of a lesser id there gains no more at any step, so it is never taken and goes."""
    held = places_of(points, "point_id", "px", "py")
    edges = stage(cover_by_power(sites, held, threshold_dbm, d0).select("candidate_id", "point_id"), "power")
    own = sites.groupBy("candidate_id").agg(F.count("*").alias("rows"), F.min("sx").alias("sx"), F.min("sy").alias("sy"))
    sizes = edges.groupBy("candidate_id").agg(F.count("*").alias("n")).join(own, "candidate_id")
    alone = F.when(F.col("rows") > 1, F.col("candidate_id"))  # several rows of a site cover what is not nested
    least = sizes.groupBy("sx", "sy", "n", alone.alias("alone")).agg(F.min("candidate_id").alias("candidate_id"))
    larger = Window.partitionBy("sx", "sy", "alone").orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each number of places
    before = least.withColumn("before", F.min("candidate_id").over(larger))
    kept = before.where(F.col("before").isNull() | (F.col("candidate_id") < F.col("before"))).select("candidate_id")
    return edges.join(kept, "candidate_id").join(held.select("point_id", "weight").distinct(), "point_id")


def power_counts(sites: DataFrame, points: DataFrame, threshold_dbm: float, d0: float = 1.0) -> DataFrame:
    """(candidate_id, n, points, least_dbm): number, sum of ids and least power of the pairs of `cover_by_power`.  Points at one place
    meet sites as one."""
    held = points.groupBy("px", "py").agg(F.count("*").alias("weight"), F.sum("point_id").alias("ids")).withColumn("point_id", F.struct("px", "py"))
    near = cover_by_power(sites, held.select("point_id", "px", "py"), threshold_dbm, d0).join(held.select("point_id", "weight", "ids"), "point_id")
    return near.groupBy("candidate_id").agg(F.sum("weight").alias("n"), F.sum("ids").alias("points"), F.min("power_dbm").alias("least_dbm"))


def power_reach(sites: DataFrame, threshold_dbm: float, d0: float = 1.0) -> DataFrame:
    """`sites` (p_tx_dbm, gamma, pl0, margin_db) with reach_m: the distance within which the lower bound of the received
    power, p_tx - (pl0 + gamma x) - margin, passes the threshold.  Sites that do not pass it at d0, and sites
    without a positive gamma, have no reach and go."""
    spare = F.col("p_tx_dbm") - F.col("margin_db") - F.col("pl0") - threshold_dbm
    return sites.where((F.col("gamma") > 0) & (spare >= 0)).withColumn("reach_m", d0 * F.pow(F.lit(10.0), spare / (10 * F.col("gamma"))))


def cover_by_power(sites: DataFrame, points: DataFrame, threshold_dbm: float, d0: float = 1.0) -> DataFrame:
    """(candidate_id, point_id, power_dbm): the points at which the lower bound of a site's received power passes the
    threshold.  A range join with a radius of its own for each row: sites fall into classes of reach by powers of two,
    each class has square cells of that size, and a site meets the points of nine cells of its class.  Points are
    copied once for each class that some site is of (a few dozen at most, as reaches are distances on Earth)."""
    reach = power_reach(sites, threshold_dbm, d0).withColumn("k", F.ceil(F.log2(F.col("reach_m") * (1 + 1e-9))).cast("int"))
    cell = lambda v: F.floor(F.col(v) / F.pow(F.lit(2.0), F.col("k")))
    near = F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))
    spread = reach.withColumn("i", near).withColumn("i", cell("sx") + F.col("i")).withColumn("j", near).withColumn("j", cell("sy") + F.col("j"))
    classes = reach.select("k").distinct()
    placed = points.crossJoin(F.broadcast(classes)).withColumn("i", cell("px")).withColumn("j", cell("py"))  # a row for each power of two
    d = F.hypot(F.col("sx") - F.col("px"), F.col("sy") - F.col("py"))
    power = F.col("p_tx_dbm") - F.col("margin_db") - predict_db(d, F.col("gamma"), F.col("pl0"), d0)
    edges = spread.join(placed, ["k", "i", "j"]).select("candidate_id", "point_id", power.alias("power_dbm"))
    return edges.where(F.col("power_dbm") >= threshold_dbm)


#: Rows of stale bounds that the driver holds, how many of them are recounted at once, and steps after which the covered
#: points are written.
HEAD, AT_ONCE, COVERED = 4096, 16, 12
#: After a pass that took no step, so many times more bounds are lowered before the next.
WIDE = 16


def greedy_cover(edges: DataFrame, k: int | None = None, head: int = HEAD, at_once: int = AT_ONCE) -> DataFrame:
    """(step, candidate_id, gain, recounted, recounted_edges): the site with most uncovered points, k times or until none
    gains; ties go to the least id.  With a column weight an edge's point counts for so many (the same in all its edges).

    Lazy: gains only fall, so a gain of an earlier step is an upper bound.  Bounds with the step that they were counted in
    are a table; the driver holds its `head` best rows and the bound of the next.  Of the head, the `at_once` best are
    recounted together; edges of other sites are not read (edges are written in the order of sites, so a filter by id skips
    the other files).  The recount tells how many uncovered points each set of these sites shares, so as long as the best
    of them is not behind the bound of another site, step after step is taken without a further pass.  When the best falls
    behind the bound of the first row outside the head, the head goes back into the table and a new one is taken."""
    spark, rows = edges.sparkSession, []
    weight = F.col("weight") if "weight" in edges.columns else F.lit(1)
    edges = stage(edges.select("candidate_id", "point_id", weight.cast("long").alias("weight")).distinct().repartitionByRange("candidate_id", "point_id").sortWithinPartitions("candidate_id"), "edges")
    bounds = edges.groupBy("candidate_id").agg(F.sum("weight").alias("gain"), F.count("*").alias("n")).select("candidate_id", "gain", F.lit(0).alias("step"), "n")
    bounds = stage(bounds, "bounds")
    own: dict[int, tuple[int, int, int]] = {}  # the head: site -> gain, the step that it was counted in, edges
    rest = None  # the best row outside the head, as its rank
    covered, recent, taken, recounted, read, stuck = None, [], [], 0, 0, False
    rank = lambda c: (-own[c][0], c)

    def points_of(sites: list[int]) -> DataFrame:
        return edges.where(F.col("candidate_id").isin(sites)).select("point_id")

    def uncovered(sites: list[int]) -> DataFrame:
        """The sites' edges to points that no site taken so far is near."""
        open_ = edges.where(F.col("candidate_id").isin(sites))
        if covered is None and not recent:
            return open_
        gone = covered if not recent else points_of(recent) if covered is None else covered.unionByName(points_of(recent))
        return open_.join(gone, "point_id", "left_anti")

    while k is None or len(rows) < k:
        best = min(own, key=rank, default=None)
        if best is None and rest is None and rows:
            break  # all sites were in the head
        if best is None or (rest is not None and rank(best) > rest):
            if taken:
                bounds, taken = bounds.where(~F.col("candidate_id").isin(taken)), []
            if own:
                held = spark.createDataFrame([(c, g, t) for c, (g, t, _) in own.items()], "candidate_id long, g long, t int")
                bounds = bounds.join(F.broadcast(held), "candidate_id", "left").select("candidate_id", F.coalesce("g", "gain").alias("gain"), F.coalesce("t", "step").alias("step"), "n")  # `head` rows
                bounds = stage(bounds.where("gain > 0"), "bounds")
            top = bounds.orderBy(F.desc("gain"), "candidate_id").limit(head + 1).collect()
            if not top:
                break
            own = {r["candidate_id"]: (r["gain"], r["step"], r["n"]) for r in top[:head]}
            rest = (-top[head]["gain"], top[head]["candidate_id"]) if len(top) > head else None
            continue
        if own[best][0] == 0:
            break
        if stuck:  # many stale bounds are ahead: lower more of them, by counts alone
            wide = sorted(own, key=rank)[: WIDE * at_once]
            counts = dict(uncovered(wide).groupBy("candidate_id").agg(F.sum("weight")).collect())
            recounted, read = recounted + len(wide), read + sum(own[c][2] for c in wide)
            own |= {c: (counts.get(c, 0), len(rows), own[c][2]) for c in wide}
        batch = sorted(own, key=rank)[:at_once]
        bit = F.create_map(*[F.lit(x) for i, c in enumerate(batch) for x in (c, 1 << i)])[F.col("candidate_id")]
        # uncovered points by the set of these sites that they are near: 2 ** at_once rows at most
        shared = uncovered(batch).groupBy("point_id").agg(F.sum(bit).alias("sites"), F.first("weight").alias("weight")).groupBy("sites").agg(F.sum("weight")).collect()
        recounted, read = recounted + len(batch), read + sum(own[c][2] for c in batch)
        others = min((rank(c) for c in own if c not in batch), default=rest)
        others = others if rest is None else min(others, rest)
        here, before = {c: 1 << i for i, c in enumerate(batch)}, len(rows)
        while k is None or len(rows) < k:
            for c, own_bit in here.items():
                own[c] = (sum(n for mask, n in shared if mask & own_bit), len(rows), own[c][2])
            best = min(here, key=rank, default=None)
            if best is None or own[best][0] == 0 or (others is not None and rank(best) > others):
                break
            rows.append((len(rows), best, own.pop(best)[0], recounted, read))
            gone = here.pop(best)
            shared = [(mask, n) for mask, n in shared if not mask & gone]
            recent, taken, recounted, read = [*recent, best], [*taken, best], 0, 0
        stuck = len(rows) == before
        if len(recent) >= COVERED:
            new = points_of(recent).distinct()
            covered = stage(new if covered is None else covered.unionByName(new.join(covered, "point_id", "left_anti")), "covered")
            recent = []
    return spark.createDataFrame(rows, "step int, candidate_id long, gain long, recounted int, recounted_edges long")


def greedy_set_cover(edges: DataFrame, required: DataFrame) -> DataFrame:
    """Sites until every required point that can be covered is."""
    return greedy_cover(edges.join(required.select("point_id"), "point_id", "left_semi"))


def compare(steps: dict[str, DataFrame]) -> DataFrame:
    """(method, step, candidate_id, covered): how many points each method covers after each of its steps."""
    stacked = [df.select(F.lit(name).alias("method"), "step", "candidate_id", "gain") for name, df in steps.items()]
    both = stacked[0]
    for df in stacked[1:]:
        both = both.unionByName(df)
    so_far = Window.partitionBy("method").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return both.select("method", "step", "candidate_id", F.sum("gain").over(so_far).alias("covered"))


def median_placement(sites: DataFrame, points: DataFrame, radius: float | None = None, max_steps: int | None = None, threshold_dbm: float | None = None, station: dict[str, float] | None = None) -> DataFrame:
    """(step, candidate_id, x, y, gain): around the uncovered point nearest to the median of all uncovered
    ones, the unused site that is strongest there and covers it, or else a new station (null id) at the median itself.
    With `radius`, a site covers the points nearer than that and the nearest is the strongest; with `threshold_dbm`
    the lower bound of received power counts, by the sites' p_tx_dbm, gamma, pl0 and margin_db, and new stations have those of
    `station`.  Ties go to the least id.  Ends when all points are covered, or with a new station that covers none, as all
    steps after it would be the same, or after `max_steps`; one row reaches the driver in each step."""
    spark, rows = points.sparkSession, []
    # points at one place are a row with their number, and both tables are written once, not made anew in each step
    left = stage(points.groupBy("px", "py").agg(F.min("point_id").alias("point_id"), F.count("*").alias("weight")), "left")
    used: list[int] = []
    before, step = 0, 0
    own = ("p_tx_dbm", "gamma", "pl0", "margin_db") if radius is None else ()
    if radius is None:
        if threshold_dbm is None or station is None:
            raise ValueError("give a radius, or a threshold and what a new station has")
        sites = power_reach(sites, threshold_dbm)
    sites = stage(sites, "sites")

    def strength(d: Column, site: dict) -> Column:
        if radius is not None:
            return -d
        return F.lit(site["p_tx_dbm"]) - F.lit(site["margin_db"]) - predict_db(d, F.lit(site["gamma"]), F.lit(site["pl0"]))

    covers = lambda power: power > -radius if radius is not None else power >= threshold_dbm
    off = lambda a, b, at: F.sqrt(F.pow(F.col(a) - at[0], F.lit(2)) + F.pow(F.col(b) - at[1], F.lit(2)))
    while True:
        med = left.agg(F.percentile("px", F.lit(0.5), F.col("weight")).alias("x"), F.percentile("py", F.lit(0.5), F.col("weight")).alias("y"), F.coalesce(F.sum("weight"), F.lit(0)).alias("n")).first()
        stuck = False
        if rows:
            rows[-1] = (*rows[-1][:4], before - med["n"])
            stuck = rows[-1][1] is None and not rows[-1][4]
        if not med["n"] or stuck or step == max_steps:
            break
        before = med["n"]
        star = left.agg(F.min(F.struct(off("px", "py", (med["x"], med["y"])).alias("d"), "point_id", "px", "py")).alias("p")).first()["p"]
        free = sites.where(~F.col("candidate_id").isin(used)) if used else sites
        near = free.withColumn("power", strength(off("sx", "sy", (star["px"], star["py"])), {c: F.col(c) for c in own})).where(covers(F.col("power")))
        best = near.agg(F.min(F.struct((-F.col("power")).alias("low"), "candidate_id", "sx", "sy", *own)).alias("s")).first()["s"]
        at = (best["sx"], best["sy"]) if best else (med["x"], med["y"])
        if best:
            used.append(best["candidate_id"])
        left = left.where(~covers(strength(off("px", "py", at), best if best else station)))
        rows.append((step, best["candidate_id"] if best else None, float(at[0]), float(at[1]), 0))
        step += 1
        if step % KEPT == 0:
            left = stage(left, "left")
    return spark.createDataFrame(rows, "step int, candidate_id long, x double, y double, gain long")


def with_uncovered(steps: DataFrame, points: DataFrame) -> DataFrame:
    """The steps of a placement with how many points each leaves uncovered."""
    so_far = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return steps.withColumn("uncovered", F.lit(points.count()) - F.sum("gain").over(so_far))


def rooftop_sites(buildings: DataFrame, n_sites: int, mast_m: float, min_sep_m: float = 250.0, cell_m: float = 25.0, least_m: float = 6.0, seed: int = 0) -> DataFrame:
    """(city, rank, structure_id, cx, cy, z): of the tallest roof of each cell, from the tallest down, those that
    keep their distance from all taken before; where fewer than n_sites do, others in the order of a seeded
    hash.  Ties go to the least id.

    A roof that precedes all open roofs within the distance is taken, and those around it fall out; so on in rounds
    over all cities at once, in which roofs meet those of the cells around by an equi-join."""
    cell = lambda v, size: F.floor(F.col(v) / size)
    roof = F.struct((-F.col("height")).alias("low"), "structure_id", "cx", "cy")
    best = buildings.where(F.col("height") > least_m).groupBy("city", cell("cx", cell_m).alias("i"), cell("cy", cell_m).alias("j")).agg(F.min(roof).alias("roof"))
    roofs = stage(best.select("city", "roof.*").withColumn("i", cell("cx", min_sep_m)).withColumn("j", cell("cy", min_sep_m)), "roofs")
    names = ("low", "structure_id", "cx", "cy")
    around = F.explode(F.sequence(F.lit(-1), F.lit(1)))

    def near(open_: DataFrame, others: DataFrame) -> DataFrame:
        """Open roofs with each other roof (o_...) within the distance."""
        spread = others.withColumn("di", around).withColumn("dj", around)
        spread = spread.select("city", (F.col("i") + F.col("di")).alias("i"), (F.col("j") + F.col("dj")).alias("j"), *[F.col(c).alias(f"o_{c}") for c in names])
        return open_.join(spread, ["city", "i", "j"]).where((F.col("structure_id") != F.col("o_structure_id")) & (F.hypot(F.col("cx") - F.col("o_cx"), F.col("cy") - F.col("o_cy")) < min_sep_m))

    left, taken = roofs, None
    while not left.isEmpty():
        before = F.struct("o_low", "o_structure_id") < F.struct(F.col("low").alias("o_low"), F.col("structure_id").alias("o_structure_id"))
        keys = ["city", "structure_id"]
        first = stage(left.join(near(left, left).where(before).select(*keys), keys, "left_anti"), "taken")
        taken = first if taken is None else taken.unionByName(first)
        open_ = left.join(first.select(*keys), keys, "left_anti")
        left = stage(open_.join(near(open_, first).select(*keys), keys, "left_anti"), "open")
    if taken is None:
        taken = roofs
    apart = taken.withColumn("rank", F.row_number().over(Window.partitionBy("city").orderBy("low", "structure_id"))).where(F.col("rank") <= n_sites)
    turn = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("structure_id").cast("string")))
    rest = roofs.join(apart.select("city", "structure_id"), ["city", "structure_id"], "left_anti").withColumn("turn", turn)
    more = rest.withColumn("rank", F.row_number().over(Window.partitionBy("city").orderBy("turn", *names))).where(F.col("rank") <= n_sites)
    counts = apart.groupBy("city").agg(F.count("*").alias("n"))
    more = more.join(counts, "city").withColumn("rank", F.col("rank") + F.col("n")).where(F.col("rank") <= n_sites)
    out = apart.select("city", "rank", *names).unionByName(more.select("city", "rank", *names))
    return out.select("city", (F.col("rank") - 1).cast("int").alias("rank"), "structure_id", "cx", "cy", (mast_m - F.col("low")).alias("z"))
