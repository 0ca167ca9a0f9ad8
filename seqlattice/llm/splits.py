"""Splits that keep related records together.

Records that share an entity, directly or through a chain, form a component. Components come from alternating
large-star and small-star steps over the edge table; each step is grouped joins only, and its result is written to the
shared folder. Components are then hashed into split ranges in the asked proportions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlattice.workspace import lookup_hot, stored

#: Entities become nodes above all records, so that the smallest node of a component is a record.
ENTITY = 1 << 62
#: Slots of the hash range that is cut into splits; their weights go to the driver.
SLOTS = 1 << 14


def numbers(text: Column) -> Column:
    """The numbers named in a label, however written: '#12', 'SCOP:12', '12.0', '12; 13'. 0 and words name none; null gives an empty array."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([0-9]+)(?:\.[0-9]+)?"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, lambda x: x.try_cast("bigint")), lambda x: x > 0))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest of the node and its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return lookup_hot(both.filter("v > u"), least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are tied to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = lookup_hot(down, least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(u, v): every node u that is not the smallest of its component with that smallest node v.

    ``edges`` has bigint columns u and v in any direction; self-loops, repeats and rows with nulls add nothing. An empty
    table gives an empty result. Rounds repeat until no edge changes; the number of rounds grows with the logarithm of
    the longest chain, and it is an error if ``max_rounds`` do not suffice.
    """
    now = stored(edges.select("u", "v").filter("u is not null and v is not null and u <> v").distinct(), "edges")
    before = _state(now)
    for _ in range(max_rounds):
        now = stored(_small_star(stored(_large_star(now), "large")), "small")
        after = _state(now)
        if after == before:
            return now
        before = after
    raise RuntimeError(f"components have not settled after {max_rounds} rounds")


def tied(listings: DataFrame, record: str, entity: str) -> DataFrame:
    """(record, root): every record tied to at least one other by a shared entity, with the smallest record tied to it.

    ``listings`` has one row per listing of bigint record and entity, both at least 0 and below 2^62.
    """
    edges = listings.select(F.col(record).alias("u"), (F.col(entity) + F.lit(ENTITY)).alias("v"))
    rest = components(edges).filter(F.col("u") < ENTITY)
    roots = rest.select("v").distinct().select(F.col("v").alias(record), F.col("v").alias("root"))
    return rest.select(F.col("u").alias(record), F.col("v").alias("root")).unionByName(roots)


def assign(records: DataFrame, component: str, shares: dict[str, float], heavy_share: float = 0.001) -> DataFrame:
    """``records`` with a column split, in place of any they have; records of one component get the same one.

    A component with at least ``heavy_share`` of all records (so at most 1/heavy_share components) is placed, the
    heaviest first, in the split that lacks most. All other components are hashed into SLOTS slots; the splits are ranges
    of slots that hold, by weight, what the heavy ones left of each. A null component is a component of its own. Of an empty table nothing is placed.
    """
    records = records.drop("split")
    key = F.coalesce(F.col(component).cast("string"), F.lit(""))
    at = F.pmod(F.xxhash64(key, F.lit("split")), F.lit(SLOTS))
    weights = records.groupBy(key.alias("_key")).agg(F.count(F.lit(1)).alias("n"))
    total = records.count()
    left = {s: total * p / sum(shares.values()) for s, p in shares.items()}
    heaviness = max(1.0, total * heavy_share)
    placed = {}
    for row in weights.filter(F.col("n") > heaviness).orderBy(F.desc("n"), "_key").collect():  # fewer than 1/heavy_share
        split = max(left, key=lambda s: left[s])
        placed[row["_key"]] = split
        left[split] -= row["n"]
    light = weights.filter(F.col("n") <= heaviness).withColumn("slot", F.pmod(F.xxhash64("_key", F.lit("split")), F.lit(SLOTS)))
    slots = sorted(map(tuple, light.groupBy("slot").agg(F.sum("n")).collect()))  # at most SLOTS rows
    rest = [(s, max(x, 0.0)) for s, x in left.items()]
    scale = sum(n for _, n in slots) / (sum(x for _, x in rest) or 1.0)
    split, wanted, passed, k = None, 0.0, 0, 0
    for name, x in rest[:-1]:
        wanted += x * scale
        while k < len(slots) and passed + slots[k][1] / 2 <= wanted:
            passed += slots[k][1]
            k += 1
        edge = slots[k][0] if k < len(slots) else SLOTS
        split = F.when(at < edge, name) if split is None else split.when(at < edge, name)
    hashed = F.lit(rest[-1][0]) if split is None else split.otherwise(rest[-1][0])
    if not placed:
        return records.withColumn("split", hashed)
    fixed = records.sparkSession.createDataFrame(list(placed.items()), "_key string, _fixed string")
    joined = records.alias("r").join(F.broadcast(fixed.alias("f")), key == F.col("f._key"), "left")
    return joined.select("r.*", F.coalesce("f._fixed", hashed).alias("split"))
