"""Rendezvous placement: every node ranks all members for a key by weight, the same everywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions.hashing import MEMBER_SEEDS, STEPS, key_seed, signed, unsigned_order, with_weight

#: A cluster is a configured list; more members than this are refused, so that broadcasting it stays safe.
MAX_MEMBERS = 10_000


def members(spark: SparkSession, names: list[str], seeds: dict[str, int] | None = None) -> DataFrame:
    """(name, seed) of a cluster. Names are trimmed and must differ and not be empty."""
    names = [n.strip() for n in names]
    if len(set(names)) < len(names) or not all(names):
        raise ValueError("members must have different names that aren't empty")
    if len(names) > MAX_MEMBERS:
        raise ValueError(f"more than {MAX_MEMBERS} members")
    seeds = MEMBER_SEEDS if seeds is None else seeds
    return spark.createDataFrame([(n, signed(seeds[n])) for n in sorted(names)], "name string, seed long")


def scores(keys: DataFrame, cluster: DataFrame, key: str = "key") -> DataFrame:
    """Each key with each member (name) and the pair's weight. The member list is broadcast, so keys don't move."""
    pairs = keys.withColumn("_k", key_seed(F.col(key))).crossJoin(F.broadcast(cluster.select("name", F.col("seed").alias("_m"))))
    return with_weight(pairs, "_k", "_m").drop("_k", "_m")


def _stepped(step):
    return lambda m: F.struct(m["name"].alias("name"), step(m["x"]).alias("x"))


def owners(keys: DataFrame, cluster: DataFrame, key: str = "key") -> DataFrame:
    """keys with `owners`: all member names by descending unsigned weight, then name.

    The members are a constant of the expression and the ranking is made within the row, so no row moves.
    """
    listed = cluster.select("name", "seed").collect()  # a configured list, see MAX_MEMBERS
    members_ = F.array(*[F.struct(F.lit(r["name"]).alias("name"), F.lit(r["seed"]).cast("long").alias("x")) for r in listed])

    def rank(k: Column) -> Column:
        rows = F.transform(members_, lambda m: F.struct(m["name"].alias("name"), m["x"].bitwiseXOR(k).alias("x")))
        for step in STEPS:  # each binds the value before it, so that it is written out once
            rows = F.transform(rows, _stepped(step))
        order = F.sort_array(F.transform(rows, lambda m: F.struct((-1 - unsigned_order(m["x"])).alias("w"), m["name"].alias("name"))))
        return F.transform(order, lambda m: m["name"])

    return keys.withColumn("owners", F.transform(F.array(key_seed(F.col(key))), rank)[0])


def ranked(keys: DataFrame, cluster: DataFrame, key: str = "key") -> DataFrame:
    """One row per row of keys and member: name and `rank` from 1."""
    return owners(keys, cluster, key).select(*keys.columns, F.posexplode("owners").alias("_p", "name")).withColumn("rank", F.col("_p") + 1).drop("_p")


def primary(keys: DataFrame, cluster: DataFrame, key: str = "key") -> DataFrame:
    """Each key with its first owner as `name`."""
    return owners(keys.select(key), cluster, key).select(key, F.col("owners")[0].alias("name"))


def holders(keys: DataFrame, cluster: DataFrame, n: int, key: str = "key") -> DataFrame:
    """The first n members of each key, one a row with `rank`; n is held between 1 and the cluster's size."""
    first = owners(keys, cluster, key).select(*keys.columns, F.posexplode(F.slice("owners", 1, max(1, n))).alias("_p", "name"))
    return first.withColumn("rank", F.col("_p") + 1).drop("_p")


def holder_lists(keys: DataFrame, cluster: DataFrame, n: int, key: str = "key") -> DataFrame:
    """Each key with its holders in order as an array and as joined names."""
    first = F.slice("owners", 1, max(1, n))
    return owners(keys.select(key), cluster, key).select(key, first.alias("holders"), F.array_join(first, ",").alias("holder_names"))


def holds(keys: DataFrame, cluster: DataFrame, node: str, n: int, key: str = "key") -> DataFrame:
    """The keys that a node should hold."""
    return holders(keys, cluster, n, key).where(F.col("name") == node).select(key)


def load(placed: DataFrame, cluster: DataFrame) -> DataFrame:
    """(name, keys) for every member, 0 for idle ones."""
    counts = placed.groupBy("name").agg(F.count("*").alias("n"))
    return cluster.select("name").join(counts, "name", "left").select("name", F.coalesce("n", F.lit(0)).cast("long").alias("keys"))


def imbalance(loads: DataFrame) -> DataFrame:
    """Highest load against the mean over all members, idle ones included."""
    total, most, n = F.sum("keys"), F.max("keys"), F.count("*")
    return loads.agg(n.alias("members"), total.alias("total"), F.min("keys").alias("min_load"), most.alias("max_load"), F.coalesce(F.try_divide((most * n).cast("double"), total.cast("double")), F.lit(0.0)).alias("imbalance"))


def movement(keys: DataFrame, before: DataFrame, after: DataFrame, n: int, key: str = "key") -> DataFrame:
    """What a change of membership moves: primaries, and holder sets whatever their order. Both rankings are made of the same row, so nothing is joined."""
    old = owners(keys.select(key), before, key).withColumnRenamed("owners", "_old")
    both = owners(old, after, key)
    first = lambda c: F.array_sort(F.slice(c, 1, max(1, n)))
    return both.agg(F.count("*").alias("keys"), F.count_if(F.col("_old")[0] != F.col("owners")[0]).alias("moved"), F.count_if(first("_old") != first("owners")).alias("holder_sets_changed"))
