"""Self-exciting event intensity and shock cascades.

Times are hours everywhere.  events(entity_id, entity_type, ts, intensity), alpha(entity_id, alpha).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplegraph.operators.common import HotJoin, round_js, scalar, top_k
from ripplegraph.operators.timeline import decayed_prefix
from ripplegraph.session import materialize

# Default process parameters and cascade constants.
MU, BETA, GAMMA = 0.01, 0.1, 0.001
DEFAULT_ALPHA = 0.01
DRIVER_WINDOW_HOURS, DRIVER_FLOOR, DRIVERS = 168, 0.001, 5
CASCADE_CAP, CASCADE_FLOOR, CASCADE_DAMPING = 100, 0.05, 0.7
EARTH_RADIUS_KM = 6371.0
HOUR_US = 3_600_000_000


def _us(col: str) -> Column:
    return F.unix_micros(F.col(col).cast("timestamp"))


def exponential_kernel(tau: Column, beta: float = BETA) -> Column:
    """Beta e^(-beta tau) for tau >= 0, else 0."""
    return F.when(tau < 0, 0.0).otherwise(F.lit(float(beta)) * F.exp(tau * -float(beta)))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """C12"""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return F.lit(EARTH_RADIUS_KM) * 2 * F.atan2(F.sqrt(a), F.sqrt(F.lit(1.0) - a))


def half_life(beta: float = BETA) -> Column:
    return F.log(F.lit(2.0)) / float(beta)


def recent(events: DataFrame, asof: Column, window_hours: int = 720, min_events: int | None = None) -> DataFrame:
    """events newer than the window; with ``min_events``, none when there are not more than that."""
    hit = events.filter(F.col("ts") >= asof - F.make_dt_interval(hours=F.lit(window_hours)))
    if min_events is None:
        return hit
    enough = scalar(hit.agg(F.count(F.lit(1)).alias("n")))
    return hit.filter(enough > min_events)


def estimate_alpha(events: DataFrame) -> DataFrame:
    """alpha = count / max(1, N (N - 1) / 2) / ln(count + 2) per entity."""
    per = events.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n_events"))
    n = scalar(events.agg(F.count(F.lit(1)).cast("double").alias("n")))
    pairs = F.greatest(F.lit(1.0), n * (n - 1) / 2)
    return per.withColumn("alpha", F.col("n_events") / pairs / F.log(F.col("n_events") + 2))


def estimate_params(events: DataFrame, window_hours: float) -> DataFrame:
    """One row (n_events, mu, beta, gamma); mu falls back to .01 without events."""
    x = events.agg(F.count(F.lit(1)).alias("n_events"))
    return x.select(
        "n_events", F.when(F.col("n_events") > 0, F.col("n_events") / float(window_hours)).otherwise(MU).alias("mu"),
        F.lit(BETA).alias("beta"), F.lit(GAMMA).alias("gamma"),
    )


def branching(alpha: DataFrame) -> DataFrame:
    """R_j = sum of all alpha - own alpha, with the tipping flag and its band."""
    x = alpha.withColumn("branching_ratio", scalar(alpha.agg(F.sum("alpha"))) - F.col("alpha"))
    r = F.col("branching_ratio")
    band = F.when(r > 1, "super-critical").when(r > 0.5, "elevated").otherwise("stable")
    return x.withColumn("is_tipping", r > 1).withColumn("band", band)


def _excitation(events: DataFrame, alpha: DataFrame, default_alpha: float) -> DataFrame:
    """Events with their mass alpha * intensity; a missing alpha takes the given default."""
    a = alpha.select("entity_id", "alpha")
    return events.join(a, "entity_id", "left").withColumn(
        "mass", F.coalesce("alpha", F.lit(float(default_alpha))) * F.col("intensity")
    )


def intensity_now(events: DataFrame, alpha: DataFrame, asof: Column, mu: float = MU, beta: float = BETA, default_alpha: float = DEFAULT_ALPHA) -> DataFrame:
    """Intensity of every entity at ``asof``.

    The kernel does not depend on the target, so each entity's own share is aggregated once and
    the target takes the global total minus its own: two aggregations, no pair join.
    """
    tau = (F.unix_micros(asof.cast("timestamp")) - _us("ts")) / float(HOUR_US)
    x = _excitation(events.filter(F.col("ts") < asof), alpha, default_alpha)
    own = x.groupBy("entity_id").agg(F.sum(F.col("mass") * float(beta) * F.exp(tau * -float(beta))).alias("own"))
    # every entity of the event table gets a row, also one whose events all lie after asof
    all_ = events.select("entity_id").distinct().join(own, "entity_id", "left")
    total = F.coalesce(scalar(own.agg(F.sum("own"))), F.lit(0.0))
    return all_.select("entity_id", (F.lit(float(mu)) + total - F.coalesce("own", F.lit(0.0))).alias("intensity"))


def intensity_at_events(events: DataFrame, alpha: DataFrame, mu: float = MU, beta: float = BETA, default_alpha: float = DEFAULT_ALPHA) -> DataFrame:
    """Intensity seen by each entity at each of its event times, (entity_id, ms, intensity).

    Global decayed prefix minus the entity's own decayed prefix at the same millisecond.
    """
    x = _excitation(events, alpha, default_alpha).withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))
    x = x.select("entity_id", "ms", (F.col("mass") * float(beta)).alias("mass"))
    everyone = decayed_prefix(x, [], "ms", "mass", beta)
    own = decayed_prefix(x, ["entity_id"], "ms", "mass", beta)
    return own.withColumnRenamed("prefix", "own").join(everyone, "ms").select(
        "entity_id", "ms", (F.lit(float(mu)) + F.col("prefix") - F.col("own")).alias("intensity")
    )


def intensity_grid(events: DataFrame, alpha: DataFrame, mu: float = MU, beta: float = BETA, default_alpha: float = DEFAULT_ALPHA) -> DataFrame:
    """I8: background intensity at the start of every hour that has events, (hour_ms, intensity)."""
    x = _excitation(events, alpha, default_alpha).withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))
    hours = x.select((F.floor(F.col("ms") / 3.6e6) * 3_600_000).cast("long").alias("ms")).distinct().withColumn("mass", F.lit(0.0))
    ticks = x.select("ms", (F.col("mass") * float(beta)).alias("mass")).unionByName(hours)
    return decayed_prefix(ticks, [], "ms", "mass", beta).join(hours.select("ms"), "ms", "left_semi").select(
        F.col("ms").alias("hour_ms"), (F.lit(float(mu)) + F.col("prefix")).alias("intensity")
    )


#: Levels of the place tree below its root, each with 16 times the cells; cells of the levels that are few enough to be sent to all tasks.
TREE_LEVELS, SMALL_LEVELS = 7, 3


def _cell(level: int) -> Column:
    """Number of the cell of (lat, lon) on a level."""
    n = 4**level
    at = lambda c, low, width: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((F.col(c) - low) / (width / n)))).cast("long")
    return at("lat", -90.0, 180.0) * n + at("lon", -180.0, 360.0)


def place_tree(place: DataFrame, levels: int = TREE_LEVELS) -> list[DataFrame]:
    """Cells (cell, parent, lat, lon, radius, m) of places (lat, lon, m) per level, the root first.

    A cell stands at the middle of its places' box; ``radius`` (km) is the way from there along the
    parallel and the meridian to a corner, so no place is further off.
    """
    box = [F.min("a0").alias("a0"), F.max("a1").alias("a1"), F.min("o0").alias("o0"), F.max("o1").alias("o1"), F.sum("m").alias("m")]
    n = 4**levels
    own = place.select(_cell(levels).alias("cell"), F.col("lat").alias("a0"), F.col("lat").alias("a1"), F.col("lon").alias("o0"), F.col("lon").alias("o1"), "m")
    cells = own.groupBy("cell").agg(*box)
    out = []
    for level in range(levels, -1, -1):
        parent = F.floor(F.col("cell") / n / 4) * (n // 4) + F.floor((F.col("cell") % n) / 4) if level else F.lit(0)
        cells = materialize(cells.withColumn("parent", parent.cast("long")), "place-cells")
        lat, half = (F.col("a0") + F.col("a1")) / 2, F.radians((F.col("a1") - F.col("a0")) / 2)
        radius = F.lit(EARTH_RADIUS_KM) * (half + F.cos(F.radians(lat)) * F.radians((F.col("o1") - F.col("o0")) / 2))
        out.append(cells.select("cell", "parent", lat.alias("lat"), ((F.col("o0") + F.col("o1")) / 2).alias("lon"), radius.alias("radius"), "m"))
        cells = cells.select(F.col("parent").alias("cell"), "a0", "a1", "o0", "o1", "m").groupBy("cell").agg(*box)
        n //= 4
    return out[::-1]


def spatial_sums(at: DataFrame, place: DataFrame, gamma: float, error: float, levels: int = TREE_LEVELS) -> DataFrame:
    """(lat, lon, all): sum of m * gamma e^(-gamma km) over all places, for each position of ``at``.

    A cell at d km counts as one mass when e^(-gamma d) (e^(gamma radius) - 1) <= ``error``, else its
    children are looked at; at the bottom places count themselves.  Distances inside a cell differ from
    d by at most its radius, so a sum is off by at most error * gamma * total mass.  A position meets
    about 1 / error^2 cells at most, however many places there are; with error = 0 the sum is exact.
    """
    tree = place_tree(place, levels)
    km = haversine_km(F.col("tlat"), F.col("tlon"), F.col("lat"), F.col("lon"))
    front = materialize(at.select(F.col("lat").alias("tlat"), F.col("lon").alias("tlon"), F.lit(0).cast("long").alias("at")), "place-front")
    sums = []
    for level in range(levels + 2):
        last = level > levels
        children = place.select(_cell(levels).alias("at"), "lat", "lon", F.lit(0.0).alias("radius"), "m") if last else tree[level].select(F.col("parent").alias("at"), "cell", "lat", "lon", "radius", "m")
        # at most 16 ** SMALL_LEVELS cells are sent to all tasks
        met = front.join(F.broadcast(children), "at") if level <= SMALL_LEVELS else HotJoin(front, "at").join(children)
        met = met.withColumn("d", km).withColumn("far", F.lit(last) | (F.exp(F.col("d") * -gamma) * (F.exp(F.col("radius") * gamma) - 1.0) <= error))
        met = materialize(met.drop("lat", "lon", "radius"), "place-pairs")
        sums.append(met.filter("far").groupBy("tlat", "tlon").agg(F.sum(F.col("m") * gamma * F.exp(F.col("d") * -gamma)).alias("s")))
        if last:
            break
        front = met.filter("not far").select("tlat", "tlon", F.col("cell").alias("at"))
        if front.isEmpty():
            break
    out = sums[0]
    for x in sums[1:]:
        out = out.unionByName(x)
    return out.groupBy("tlat", "tlon").agg(F.sum("s").alias("all"))


def spatial_intensity(
    targets: DataFrame, events: DataFrame, alpha: DataFrame, asof: Column, mu: float = MU, beta: float = BETA,
    gamma: float = GAMMA, default_alpha: float = DEFAULT_ALPHA, error: float = 0.01, levels: int = TREE_LEVELS,
) -> DataFrame:
    """Intensity with distance decay gamma e^(-gamma km); a missing position counts as distance 0.

    targets(entity_id, lat, lon).  Events collapse to one decayed mass per (entity, place) and per place;
    distinct target places meet the places' tree (see ``spatial_sums``), so an intensity is off by at most
    error * gamma * the mass of all events.  A target's own events are left out exactly.
    """
    tau = (F.unix_micros(asof.cast("timestamp")) - _us("ts")) / float(HOUR_US)
    x = _excitation(events.filter(F.col("ts") < asof), alpha, default_alpha)
    decayed = F.sum(F.col("mass") * float(beta) * F.exp(tau * -float(beta))).alias("m")
    own = materialize(x.groupBy("entity_id", "lat", "lon").agg(decayed), "own-masses")
    place = own.groupBy("lat", "lon").agg(F.sum("m").alias("m"))
    known = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    here = materialize(place.filter(known), "places")
    total = own.agg(F.sum("m")).scalar()
    nowhere = own.filter(~known).agg(F.sum("m")).scalar()
    at = materialize(targets.filter(known).select("lat", "lon").distinct(), "target-places")
    seen = spatial_sums(at, here, float(gamma), float(error), levels)
    spatial = F.lit(float(gamma)) * F.exp(F.coalesce(haversine_km(F.col("tlat"), F.col("tlon"), F.col("lat"), F.col("lon")), F.lit(0.0)) * -float(gamma))
    mine = (
        targets.select(F.col("entity_id").alias("_e"), F.col("lat").alias("tlat"), F.col("lon").alias("tlon")).join(own, F.col("_e") == F.col("entity_id"))
        .groupBy("_e").agg(F.sum(F.col("m") * spatial).alias("own"))
    )
    out = targets.select("entity_id", F.col("lat").alias("tlat"), F.col("lon").alias("tlon")).join(seen, ["tlat", "tlon"], "left")
    out = out.join(mine, F.col("entity_id") == F.col("_e"), "left")
    zero = F.lit(0.0)
    whole = F.coalesce(total, zero) * float(gamma)
    everywhere = F.when(F.col("tlat").isNull() | F.col("tlon").isNull(), whole).otherwise(F.coalesce("all", zero) + F.coalesce(nowhere, zero) * float(gamma))
    return out.select("entity_id", (F.lit(float(mu)) + everywhere - F.coalesce("own", zero)).alias("intensity"))


def contagion_state(
    events: DataFrame, alpha: DataFrame, asof: Column, mu: float = MU, beta: float = BETA, default_alpha: float = DEFAULT_ALPHA
) -> DataFrame:
    """Intensity, branching ratio and up to five strongest driving events of other entities.

    At most five events per source can be among anyone's drivers, and a target's own events can
    displace at most five, so the global best ten of those are all that any target needs.
    """
    tau = (F.unix_micros(asof.cast("timestamp")) - _us("ts")) / float(HOUR_US)
    x = events.filter((F.col("ts") <= asof) & (F.col("ts") >= asof - F.make_dt_interval(hours=F.lit(DRIVER_WINDOW_HOURS))))
    contribution = F.coalesce("alpha", F.lit(0.0)) * F.col("intensity") * exponential_kernel(tau, beta)
    x = x.join(alpha.select("entity_id", "alpha"), "entity_id").select(
        F.col("entity_id").alias("source"), contribution.alias("c"), tau.alias("tau"), _us("ts").alias("us")
    ).filter(F.col("c") > DRIVER_FLOOR)
    order = [F.col("c").desc(), F.col("us").desc(), F.col("source")]
    best = top_k(x, ["source"], order, DRIVERS).orderBy(*order).limit(2 * DRIVERS)
    ten = scalar(
        best.agg(F.sort_array(F.collect_list(F.struct("c", "us", "source", "tau")), asc=False).alias("d"))
    )
    text = lambda d: F.concat_ws(
        ":", d["source"], F.format_string("%.3f", round_js(d["c"], 3)), F.format_string("%.1f", round_js(d["tau"], 1))
    )
    base = intensity_now(events, alpha, asof, mu, beta, default_alpha)
    ratio = branching(alpha).select("entity_id", "branching_ratio", "is_tipping")
    return base.join(ratio, "entity_id", "left").withColumn("_t", ten).select(
        "entity_id", round_js(F.col("intensity"), 3).alias("intensity"), round_js(F.col("branching_ratio"), 3).alias("branching_ratio"),
        F.slice(F.filter("_t", lambda d: d["source"] != F.col("entity_id")), 1, DRIVERS).alias("_d"), "is_tipping",
    ).withColumn("drivers", F.array_join(F.transform("_d", text), ",")).drop("_d")


def activity_days(events: DataFrame) -> DataFrame:
    """First and last event per (entity, day): all that the 24-hour neighbour test needs."""
    return events.groupBy("entity_id", F.floor(_us("ts") / float(24 * HOUR_US)).cast("long").alias("day")).agg(
        F.min(_us("ts")).alias("t0"), F.max(_us("ts")).alias("t1")
    )


def active_neighbours(seeds: DataFrame, days: DataFrame) -> DataFrame:
    """(seed, entity_id) of entities with any event less than 24 hours from an event of the seed.

    Same day always qualifies; across a day border only the last event before and the first
    event after it matter, so the band join runs on one row per entity and day.
    """
    mine = seeds.select(F.col("entity_id").alias("seed")).distinct().join(days.withColumnRenamed("entity_id", "seed"), "seed")
    probe = mine.select("seed", "t0", "t1", F.explode(F.sequence(F.col("day") - 1, F.col("day") + 1)).alias("d"), "day")
    other = days.select("entity_id", F.col("day").alias("d"), F.col("t0").alias("o0"), F.col("t1").alias("o1"))
    width = F.lit(24 * HOUR_US)
    near = (
        F.when(F.col("d") == F.col("day"), F.lit(True))
        .when(F.col("d") > F.col("day"), F.col("o0") - F.col("t1") < width)
        .otherwise(F.col("t0") - F.col("o1") < width)
    )
    return probe.join(other, "d").filter(near & (F.col("seed") != F.col("entity_id"))).select("seed", "entity_id").distinct()


#: Pieces of a day that a busy day is dealt to.
DAY_PIECES = 288


def _strongest_later(points: DataFrame, probes: DataFrame) -> DataFrame:
    """(shock, entity_id, magnitude): for each probe(shock, day, t, entity_id) the largest magnitude of points(shock, day, t, magnitude) with a later t.

    Days are cut into pieces; maxima of whole pieces run over the pieces of a day, and inside the
    probe's own piece over its rows, so a busy day is many short windows and no pair is made.
    """
    piece = F.floor(F.col("t") / (24 * HOUR_US / DAY_PIECES)).cast("long")
    points = points.select("shock", "day", "t", "magnitude", piece.alias("piece"))
    probes = probes.select("shock", "day", "t", "entity_id", piece.alias("piece"))
    keys = ["shock", "day"]
    whole = points.groupBy(*keys, "piece").agg(F.max("magnitude").alias("m"))
    asked = probes.select(*keys, "piece").distinct().withColumn("m", F.lit(None).cast("double"))
    per_piece = whole.unionByName(asked).groupBy(*keys, "piece").agg(F.max("m").alias("m"))
    later = per_piece.withColumn("later", F.max("m").over(Window.partitionBy(*keys).orderBy(F.desc("piece")).rowsBetween(Window.unboundedPreceding, -1))).drop("m")
    both = points.withColumn("entity_id", F.lit(None).cast("string")).unionByName(probes.withColumn("magnitude", F.lit(None).cast("double")))
    # at equal times a probe stands before the points: only later ones count
    order = Window.partitionBy(*keys, "piece").orderBy(F.desc("t"), F.col("entity_id").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    inside = both.withColumn("inside", F.max("magnitude").over(order)).filter("entity_id is not null")
    out = inside.join(later, [*keys, "piece"]).select("shock", "entity_id", F.greatest("inside", "later").alias("magnitude"))
    return out.filter("magnitude is not null")


def strongest_reach(spread: DataFrame, days: DataFrame) -> DataFrame:
    """(shock, entity_id, magnitude): the largest magnitude that spread(shock, from, magnitude) brings to every entity active within 24 hours.

    The same day always counts; across a day's border an entity needs only the largest magnitude among
    the sources whose last (first) event is near enough to its own first (last) one.  Sources get
    themselves back too.  Rows are (shock, active entity and day), never pairs of entities.
    """
    mine = materialize(spread.join(days.withColumnRenamed("entity_id", "from"), "from").select("shock", "day", "t0", "t1", "magnitude"), "spread-days")
    active = materialize(mine.groupBy("shock", "day").agg(F.max("magnitude").alias("magnitude")), "spread-maxima")
    same = HotJoin(days, "day").join(active).select("shock", "entity_id", "magnitude")
    width = 24 * HOUR_US
    after = days.select("entity_id", (F.col("day") - 1).alias("day"), (F.col("t0") - width).alias("t"))
    before = days.select("entity_id", (F.col("day") + 1).alias("day"), (-(F.col("t1") + width)).alias("t"))
    out = same
    for probes, time in ((after, F.col("t1")), (before, -F.col("t0"))):
        asked = HotJoin(probes, "day").join(active.select("shock", "day"))
        out = out.unionByName(_strongest_later(mine.select("shock", "day", time.alias("t"), "magnitude"), asked))
    return out.groupBy("shock", "entity_id").agg(F.max("magnitude").alias("magnitude"))


def simulate_shock(
    shocks: DataFrame, events: DataFrame, alpha: DataFrame, asof: Column, mu: float = MU, beta: float = BETA,
    default_alpha: float = DEFAULT_ALPHA, duration_hours: int = 168, resolution_hours: int = 1, cap: int | None = None,
) -> DataFrame:
    """Cascade of shocks(shock, entity_id, magnitude) over entities active within 24 hours.

    One wave per resolution step; a wave's magnitude is the previous one times R times .7 while
    that stays above .05 and R above .1, within the duration.  With a ``cap``, the first visits of a
    shock count, ordered by wave, then magnitude desc, then entity.
    """
    lam = materialize(
        intensity_now(events, alpha, asof, mu, beta, default_alpha).join(
            branching(alpha).select("entity_id", "branching_ratio"), "entity_id", "left"
        ).join(events.groupBy("entity_id").agg(F.min_by("entity_type", F.struct("ts", "entity_type")).alias("entity_type")), "entity_id", "left"),
        "cascade-intensity",
    )
    days = materialize(activity_days(events), "cascade-days")
    front = materialize(shocks.select("shock", "entity_id", "magnitude").withColumn("wave", F.lit(0)), "cascade")
    done = front
    reach = F.col("magnitude") * F.col("branching_ratio") * CASCADE_DAMPING
    for wave in range(1, duration_hours // resolution_hours + 1):
        spread = (
            front.join(lam.select("entity_id", "branching_ratio"), "entity_id")
            .filter((F.col("branching_ratio") > 0.1) & (reach > CASCADE_FLOOR))
            .select("shock", F.col("entity_id").alias("from"), reach.alias("magnitude"))
        )
        if spread.isEmpty():
            break
        # a source is among the visited, so what it brings to itself never counts
        step = strongest_reach(spread, days).join(done.select("shock", "entity_id"), ["shock", "entity_id"], "left_anti")
        if cap is not None:
            used = done.groupBy("shock").agg(F.count(F.lit(1)).alias("_used"))
            step = top_k(step, ["shock"], [F.col("magnitude").desc(), F.col("entity_id")], cap, rank="_rn").join(used, "shock")
            step = step.filter(F.col("_rn") + F.col("_used") <= cap)
        front = materialize(step.select("shock", "entity_id", "magnitude", F.lit(wave).alias("wave")), "cascade")
        done = done.unionByName(front)
    peak = F.col("magnitude") * F.coalesce("intensity", F.lit(float(mu)))
    x = done.join(lam, "entity_id", "left").withColumn("_p", peak)
    return x.select(
        "shock", "entity_id", F.coalesce("entity_type", F.lit("Unknown")).alias("entity_type"),
        (F.col("wave") * resolution_hours + 1).alias("peak_time_hours"), round_js(F.col("_p"), 3).alias("peak_intensity"),
        round_js(F.col("_p") * half_life(beta) * 2, 3).alias("total_impact"),
    )


def shock_summary(cascade: DataFrame) -> DataFrame:
    """Affected entities, last wave and stability (every peak below .5) per shock."""
    return cascade.groupBy("shock").agg(
        F.count(F.lit(1)).alias("total_affected"), (F.max("peak_time_hours") - 1).alias("max_depth"),
        (F.max("peak_intensity") < 0.5).alias("stable"),
    )
