"""Distinct members in rolling windows, counted exactly and without keeping sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallgrass.functions.scalars import EPOCH, day_index
from tallgrass.operators.features import WINDOWS

#: Parts that the entities are dealt into, as a multiple of the session's shuffle partitions, so that a task sorts little at once.
PARTS = 4


def rolling_distinct(tx: DataFrame, entity: list[str], member: str, windows=WINDOWS, spine_rows: DataFrame | None = None, prefix: str = "f", epoch: str = EPOCH) -> DataFrame:
    """(entity, day_index, {prefix}_n_{member}s_{w}d): members seen in [d - w, d - 1], each once, on the entity's days or the spine's.

    A sighting on day s counts on the days s + 1 to s + w, or until the member's next sighting
    takes over. So each is a +1 at s + 1 and a -1 at the earlier of s + w + 1 and the next
    sighting's day + 1, and a running sum of these, added up by entity and day, is
    the count. Unlike sums of daily distincts, a member seen on several days counts once;
    unlike sets, what is kept is one number a day. Null members are nobody, a null
    entity is one like any other.
    """
    keys = [*entity, "day_index"]
    rows = tx.select(*entity, F.col(member).alias("__member"), day_index(F.col("t_dat"), epoch).alias("day_index"))
    parts = PARTS * int(tx.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # dealt by entity once: sightings, sums by day and running sums all stay where they are
    rows = rows.repartition(parts, *entity).distinct()
    following = F.lead("day_index").over(Window.partitionBy(*entity, "__member").orderBy("day_index"))
    change = lambda day, flags, wanted: F.struct(day.alias("day_index"), *(F.lit(x).alias(f"__{w}") for w, x in zip(windows, flags)), F.lit(wanted).alias("__wanted"))
    changes = [change(F.col("day_index") + 1, [1] * len(windows), False)]
    for w in windows:
        end = F.least(F.col("day_index") + w + 1, F.col("__next") + 1)  # least passes over a null
        changes.append(change(end, [-1 if v == w else 0 for v in windows], False))
    own = [change(F.col("day_index"), [0] * len(windows), True)] if spine_rows is None else []
    each = F.when(F.col("__member").isNotNull(), F.array(*changes, *own))
    deltas = rows.withColumn("__next", following).select(*entity, F.explode(each.otherwise(F.array(*own)) if own else each).alias("c")).select(*entity, "c.*")
    if spine_rows is not None:
        wanted = spine_rows.select(*keys).distinct().select(*keys, *(F.lit(0).alias(f"__{w}") for w in windows), F.lit(True).alias("__wanted"))
        deltas = deltas.unionByName(wanted)
    daily = deltas.groupBy(*keys).agg(*(F.sum(f"__{w}").alias(f"__{w}") for w in windows), F.max("__wanted").alias("__wanted"))
    running = Window.partitionBy(*entity).orderBy("day_index").rowsBetween(Window.unboundedPreceding, 0)
    name = member.removesuffix("_id")
    out = daily.withColumns({f"{prefix}_n_{name}s_{w}d": F.sum(f"__{w}").over(running) for w in windows}).where("__wanted")
    return out.select(*keys, *(f"{prefix}_n_{name}s_{w}d" for w in windows))
