"""Wind stations: rows of each source in one shape, replies for a box, winds of a point, and the tables that hold fetches for a while."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import geo, headers, labels

#: Minutes after which an observation is stale, seconds for which fetches of tiles and points hold, tiles a reply may take.
STALE_MINUTES, TILE_TTL_S, POINT_TTL_S, MOST_TILES = 180, 300, 900, 16
#: Fixed value: feet a metre.
M_TO_FT = 3.28084


def _even(x: Column) -> Column:
    """Rounded half to even, null for what is no number."""
    return F.bround(x.try_cast("double")).cast("int")


def direction(raw: Column, kt: Column) -> Column:
    """A bearing below 360; null in calm air, for `VRB` and for what is no number."""
    return F.when(F.coalesce(kt != 0, F.lit(True)), F.pmod(_even(raw.cast("string")), F.lit(360)))


def station_rows(rows: DataFrame, source: str, names: bool = True, carry: Sequence[str] = ()) -> DataFrame:
    """(id, source, name, lat, lon, dir_deg, speed_kt, gust_kt, obs_time) out of (id, name, lat, lon, wdir, wspd, wgst, at).

    Rows without id, place or time, and those whose wind sensor is out (neither speed nor direction), are left out. Columns of `carry` come along.
    """
    kt = _even(F.col("wspd"))
    name = headers.squeezed(F.col("name")) if names else F.lit(None).cast("string")
    out = rows.select(
        *carry, F.trim("id").alias("id"), F.lit(source).alias("source"), F.when(name != "", name).alias("name"), F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon"),
        direction(F.col("wdir"), kt).alias("dir_deg"), kt.alias("speed_kt"), _even(F.col("wgst")).alias("gust_kt"), F.col("at").alias("obs_time"),
    )
    return out.where((F.col("id") != "") & F.col("lat").isNotNull() & F.col("lon").isNotNull() & F.col("obs_time").isNotNull() & (F.col("speed_kt").isNotNull() | F.col("dir_deg").isNotNull()))


def merged(stations: DataFrame, west: float, south: float, east: float, north: float, now: Column, order: str = "tile") -> DataFrame:
    """Each station's newest row over the overlapping tiles (of one time the first by `order`), not stale, in the box; the edges belong to it.

    The newest row counts before box and age are asked, so a station that moved out of the box isn't shown at its older place.
    """
    rest = [c for c in stations.columns if c not in ("source", "id", order)]
    best = stations.groupBy("source", "id").agg(F.max_by(F.struct(*rest), F.struct("obs_time", (-F.col(order)).alias("o"))).alias("r")).select("source", "id", "r.*")
    fresh = F.col("obs_time") >= now - F.make_interval(mins=F.lit(STALE_MINUTES))
    return best.where(fresh & F.col("lon").between(west, east) & F.col("lat").between(south, north))


def reply_head(entries: DataFrame, keys: list[str], order: str = "tile") -> DataFrame:
    """keys, fetched_at (the oldest fetch), errors (each once, as first seen by `order` and place) of the entries (fetched_at, errors array)."""
    said = entries.select(*keys, order, F.posexplode("errors").alias("_i", "_e")).groupBy(*keys, "_e").agg(F.min(F.struct(order, "_i")).alias("_at"))
    errors = said.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_e"))), lambda x: x["_e"]).alias("errors"))
    oldest = entries.groupBy(*keys).agg(F.min("fetched_at").alias("fetched_at"))
    return oldest.join(errors, keys, "left").withColumn("errors", F.coalesce("errors", F.array().cast("array<string>")))


def gathered(feeds: dict[str, DataFrame], failures: DataFrame) -> DataFrame:
    """The rows of all feeds (one shape) that have no failure in `failures` (source, error): a feed that fails takes no other with it."""
    rows = None
    for source, feed in feeds.items():
        one = feed.withColumn("source", F.lit(source))
        rows = one if rows is None else rows.unionByName(one, allowMissingColumns=True)
    if rows is None:
        raise ValueError("no feed")
    return rows.join(failures.select("source").distinct(), "source", "left_anti")


def box(words: Column) -> Column:
    """struct(west, south, east, north, error) of a text `west,south,east,north`; error says why it can't be asked, else null."""
    parts = F.split(words, ",")
    numbers = F.transform(parts, lambda p: F.trim(p).try_cast("double"))
    side = lambda i: F.get(numbers, F.lit(i))
    four = F.coalesce(F.size(parts) == 4, F.lit(False))
    whole = four & F.forall(numbers, lambda n: n.isNotNull())
    # The count of tiles, without listing them: a box that ends on a border does not enter the next tile.
    span = lambda low, high: F.greatest(F.ceil(high) - F.floor(low), F.lit(0))
    many = span(side(0), side(2)) * span(side(1), side(3)) > MOST_TILES
    error = F.when(~four, "bbox must be west,south,east,north").when(~whole, "bbox must be four numbers").when(many, "bbox too large")
    return F.struct(*[F.when(whole, side(i)).alias(n) for i, n in enumerate(("west", "south", "east", "north"))], error.alias("error"))


def point_wind(lat: Column, lon: Column, deg: Column, kt: Column, gust: Column, time: Column) -> Column:
    """struct(lat, lon, dir_deg, speed_kt, gust_kt, time, source): the model's wind at the middle of a point's cell of a tenth of a degree."""
    speed = _even(kt)
    at = F.when(F.length(time) == 16, F.concat(time, F.lit(":00"))).when(time != "", time)
    return F.struct(
        F.round(geo.cell(lat, 0.1) * 0.1, 4).alias("lat"), F.round(geo.cell(lon, 0.1) * 0.1, 4).alias("lon"), F.when(F.coalesce(speed != 0, F.lit(True)), _even(deg)).alias("dir_deg"),
        speed.alias("speed_kt"), _even(gust).alias("gust_kt"), F.concat(at, F.lit("Z")).alias("time"), F.lit("model").alias("source"),
    )


def aligned(spine: DataFrame, series: DataFrame, keys: list[str], hour: str) -> DataFrame:
    """keys and arrays dir_deg, speed_kt, gust_kt, model in the order of the spine's hours: an hour has all of its three numbers or none.

    An array holds one key's spine, which is a few days of hours.
    """
    whole = F.col("dir_deg").isNotNull() & F.col("speed_kt").isNotNull() & F.col("gust_kt").isNotNull()
    rows = spine.select(*keys, hour).join(series.select(*keys, hour, "dir_deg", "speed_kt", "gust_kt", "model"), [*keys, hour], "left")
    cell = F.struct(hour, *[F.when(whole, _even(F.col(c))).alias(c) for c in ("dir_deg", "speed_kt", "gust_kt")], F.when(whole, F.col("model")).alias("model"))
    sorted_rows = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(cell)).alias("_h"))
    return sorted_rows.select(*keys, *[F.col("_h")[c].alias(c) for c in ("dir_deg", "speed_kt", "gust_kt", "model")])


def home_airport(raw: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """(id, name, lat, lon, elev_ft, runways) out of (icaoId, faaId, iataId, name, lat, lon, elev, runways); runways without an alignment are left out."""
    kept = F.filter(F.coalesce("runways", F.array()), lambda r: r["alignment"].isNotNull())
    runway = lambda r: F.struct(F.trim(F.coalesce(r["id"], F.lit(""))).alias("id"), F.pmod(_even(r["alignment"]), F.lit(360)).alias("heading"), labels.length_ft(r["dimension"]).alias("length_ft"))
    some = lambda c: F.when(F.col(c) != "", F.col(c))
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    return raw.select(
        *carry, F.coalesce(some("icaoId"), some("faaId"), some("iataId"), F.lit("")).alias("id"), F.initcap(headers.squeezed(F.coalesce("name", F.lit("")))).alias("name"),
        F.bround(zero("lat"), 5).alias("lat"), F.bround(zero("lon"), 5).alias("lon"), _even(zero("elev") * M_TO_FT).alias("elev_ft"), F.transform(kept, runway).alias("runways"),
    )


def kept_entries(fetches: DataFrame, keys: list[str], now: Column, ttl_s: int) -> DataFrame:
    """Each key's newest fetch without `error`, if it is younger than the time to live: failures are never kept."""
    good = fetches.where(F.col("error").isNull())
    rest = [c for c in good.columns if c not in keys]
    best = good.groupBy(*keys).agg(F.max_by(F.struct(*rest), "fetched_at").alias("r")).select(*keys, "r.*")
    return best.where(F.unix_micros(now) - F.unix_micros("fetched_at") < ttl_s * 1_000_000)


def _marked(key: list[str], seconds: float, metres: bool, least_nm: float, ok: str | None):
    import numpy as np

    def nm(a: tuple[float, float], b: tuple[float, float]) -> float:
        p, q = np.radians(a), np.radians(b)
        h = np.sin((q[0] - p[0]) / 2) ** 2 + np.cos(p[0]) * np.cos(q[0]) * np.sin((q[1] - p[1]) / 2) ** 2
        return 2 * 3440.065 * float(np.arcsin(min(1.0, np.sqrt(h))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last_key, last = None, None  # carried from batch to batch, so a key of any size takes no memory
        for b in batches:
            taken = []
            places = zip(b["lat"], b["lon"], strict=True) if metres else [None] * len(b)
            good = b[ok] if ok else [True] * len(b)
            for k, at, place, fine in zip(b[key].itertuples(index=False, name=None), b["_us"], places, good, strict=True):
                take = k != last_key or last is None or (at - last[0] >= seconds * 1e6 and (place is None or nm(last[1], place) >= least_nm))
                if k != last_key:
                    last_key, last = k, None
                if take and fine:
                    last = (at, place)
                taken.append(bool(take))
            yield b.drop(columns="_us").assign(taken=taken)

    return run


def throttled(rows: DataFrame, keys: list[str], at: str, seconds: float, least_nm: float | None = None, ok: str | None = None) -> DataFrame:
    """`rows` with `taken`: whether a row is at least `seconds` (and, if given, `least_nm` of its lat and lon) after the last one taken of its key.

    With a time to live for `seconds` the taken rows are the requests that must fetch, the others are answered from what was kept; where `ok`
    names a boolean column, a taken row that is not ok is a failure that isn't kept, so the next one is taken again. Rows of one time count in
    the order of their other columns. What is taken depends on what was taken before, so no window can say it: each partition is sorted by key
    and time and streamed through with the last taken row as its only state. Keys must not be null.
    """
    rest = [c for c in rows.columns if c not in keys and c != at]
    dealt = rows.withColumn("_us", F.unix_micros(at)).repartition(*keys).sortWithinPartitions(*keys, at, *rest)
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, taken boolean"
    return dealt.mapInPandas(_marked(keys, seconds, least_nm is not None, least_nm or 0.0, ok), schema)


def carried_runs(history: DataFrame, targets: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The history of runs (keys, target_date, at, generated_at): of each key what has its present target date, with `new` instead of equal `at`."""
    same = history.join(targets.select(*keys, "target_date"), [*keys, "target_date"], "left_semi")
    return same.join(new.select(*keys, "at").distinct(), [*keys, "at"], "left_anti").unionByName(new)


def to_record(asks: DataFrame, history: DataFrame, keys: list[str], times_local: list[str], tz: str) -> DataFrame:
    """`asks` (keys, run_at, target_date, now) with `record`: at one of the times, or the first run of the target day by local dates."""
    local_day = lambda c: F.to_date(F.from_utc_timestamp(c, tz))
    seen = history.where(F.col("generated_at").isNotNull()).select(*keys, local_day(F.col("generated_at")).alias("_day"), F.lit(True).alias("_seen")).distinct()
    out = asks.withColumn("_day", local_day(F.col("now"))).join(seen, [*keys, "_day"], "left")
    timed = F.coalesce(F.col("run_at").isin(times_local), F.lit(False))
    return out.withColumn("record", timed | (F.coalesce(F.col("target_date") == F.col("_day"), F.lit(False)) & F.col("_seen").isNull())).select(*asks.columns, "record")


def first_seen(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """keys and place: each key once, in the order in which it is first seen; places are numbered within the first of the keys."""
    once = rows.groupBy(*keys).agg(F.min(order).alias("_o"))
    return once.withColumn("place", F.row_number().over(Window.partitionBy(keys[0]).orderBy("_o", *keys[1:]))).drop("_o")
