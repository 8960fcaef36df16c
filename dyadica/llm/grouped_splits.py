"""Train, validation and test splits that keep related records together.

Records that share any of several keys, directly or through others, form one group. Groups
are bundled by size and label profile; only the bundles' counts reach the driver, where a
min-cost flow fills the split quotas. Members of a bundle are told apart by hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage, trimmed
from .components import components

#: Spellings of "no person", after cleaning.
NOBODY = ("", "none")
SPLITS = {"train": 0.8, "validation": 0.1, "test": 0.1}
#: Sizes above this share a bundle with those within two per cent, so bundles stay few.
EXACT_SIZE = 2048
MAX_BUNDLES = 200_000
SLOTS = 64


def cleaned(col: Column) -> Column:
    """A trimmed lower-case key; null where it names nobody."""
    key = trimmed(col)
    return F.when(key.isin(*NOBODY), None).otherwise(key)


def linked_groups(df: DataFrame, record: str, owner: str, anchor: str) -> DataFrame:
    """(record, group_key) once per distinct record: the least cleaned ``anchor`` of its group.

    Records belong together when they share a cleaned owner or a cleaned anchor, also by way
    of others. Null, empty and ``none`` keys link nothing. A record without an anchor takes
    its owner's group, and null if that has no anchor either. Rows with a null record are
    left out; repeated rows change nothing; an empty table gives an empty result.
    """
    rows = df.select(F.col(record).alias("r"), cleaned(F.col(owner)).alias("o"), cleaned(F.col(anchor)).alias("a"))
    rows = cut_lineage(rows.filter("r is not null").distinct())
    first = {
        c: rows.filter(f"{c} is not null and a is not null").groupBy(c).agg(F.min("a").alias("m"), F.max("a").alias("x"))
        for c in ("o", "r")
    }
    # Each owner hangs its anchors on its least one: a star, so owners need no nodes.
    edges = None
    for c, least in first.items():
        several = least.filter("m <> x").select(c, "m")
        part = rows.filter("a is not null").join(several, c).select("a", F.col("m").alias("b"))
        edges = part if edges is None else edges.union(part)
    labels = components(edges)
    anchored = rows.join(first["o"].select("o", "m"), "o", "left").select("r", F.coalesce("a", "m").alias("a"))
    keyed = anchored.join(labels.withColumnRenamed("node", "a"), "a", "left").select("r", F.coalesce("label", "a").alias("g"))
    return keyed.groupBy("r").agg(F.min("g").alias("group_key")).withColumnRenamed("r", record)


def _augment(costs: dict[tuple, float], source, sink) -> list | None:
    """The cheapest path in a residual graph with possibly negative arcs (Bellman-Ford)."""
    dist, came = {source: 0.0}, {}
    nodes = {x for arc in costs for x in arc}
    for _ in nodes:
        changed = False
        for (u, v), c in costs.items():
            if u in dist and dist[u] + c < dist.get(v, float("inf")) - 1e-9:
                dist[v], came[v], changed = dist[u] + c, u, True
        if not changed:
            break
    if sink not in dist:
        return None
    path, at = [], sink
    while at != source:
        path.append((came[at], at))
        at = came[at]
    return path[::-1]


def _place(units: dict, size: float, quota: list[float], wish: dict) -> dict:
    """Send each profile's left-over groups of one size to splits, at least deviation.

    Every group is a unit of flow: source -> profile -> split -> sink. An arc's cost is how
    much the next unit worsens the deviation from the profile's wish, or from the split's
    quota; both are convex, so successive cheapest paths give an integral optimum.
    """
    k = len(quota)
    sent = {p: [0] * k for p in units}
    total = [0] * k
    step = lambda left, n: abs(left - (n + 1) * size) - abs(left - n * size)
    for _ in range(sum(units.values())):
        costs = {}
        for p, n in units.items():
            if sum(sent[p]) < n:
                costs["s", ("p", p)] = 0.0
            for s in range(k):
                costs[("p", p), ("k", s)] = step(wish[p][s], sent[p][s]) * 0.5
                if sent[p][s]:
                    costs[("k", s), ("p", p)] = -step(wish[p][s], sent[p][s] - 1) * 0.5
        for s in range(k):
            costs[("k", s), "t"] = step(quota[s], total[s])
        path = _augment(costs, "s", "t")
        if path is None:
            break
        for u, v in path:
            if u != "s" and u[0] == "p" and v[0] == "k":
                sent[u[1]][v[1]] += 1
            elif u[0] == "k" and v != "t":
                sent[v[1]][u[1]] -= 1
            elif v == "t":
                total[u[1]] += 1
    return sent


def allocate(bundles: list[tuple[float, int, int]], shares: list[float]) -> dict[tuple[float, int], list[int]]:
    """How many groups of each (size, profile) bundle go to each split.

    ``bundles`` holds (size, profile, groups). Sizes are gone through from the largest to the
    least. The whole part of a bundle's share of what the splits still lack is given at once,
    so that small groups make up for what a very large one upset; the rest is placed by flow.
    """
    k = len(shares)
    bundles = sorted(bundles)  # ties are settled alike, in whatever order the counts came
    total = sum(a * c for a, _, c in bundles)
    quota = [s * total for s in shares]
    out: dict[tuple[int, int], list[int]] = {}
    wish: dict[int, list[float]] = {}
    for size, profile, n in bundles:
        mine = wish.setdefault(profile, [0.0] * k)
        for s in range(k):
            mine[s] += shares[s] * size * n
    for size in sorted({b[0] for b in bundles}, reverse=True):
        lack = [max(q, 0.0) for q in quota]
        now = [x / sum(lack) for x in lack] if sum(lack) > 0 else shares
        units = {}
        for a, profile, n in bundles:
            if a == size:
                base = [int(n * s + 1e-9) for s in now]
                out[size, profile] = base
                for s in range(k):
                    quota[s] -= size * base[s]
                    wish[profile][s] -= size * base[s]
                if n > sum(base):
                    units[profile] = n - sum(base)
        for profile, placed in _place(units, size, quota, wish).items():
            for s, x in enumerate(placed):
                out[size, profile][s] += x
                quota[s] -= size * x
                wish[profile][s] -= size * x
    return out


def assign_splits(groups: DataFrame, record: str, profile: DataFrame | None = None, splits: dict[str, float] = SPLITS) -> DataFrame:
    """(record, group_key, split): each group whole in one split, sizes close to ``splits``.

    ``profile`` may give (record, value) with a value between 0 and 1 per record; the groups'
    means in quarters are then balanced too. Records without a group key form groups alone.
    Shares are scaled to sum to 1. The driver receives one count per bundle of equal size and
    profile (at most ``MAX_BUNDLES``, checked), never a group. Members are told apart by the
    order of a hash of their key, ranked in slots, so no bundle is sorted in one task.
    """
    names, weights = list(splits), [w / sum(splits.values()) for w in splits.values()]
    keyed = groups.withColumn("g", F.coalesce("group_key", F.concat(F.lit("alone:"), F.col(record).cast("string"))))
    value = F.lit(0.0)
    if profile is not None:
        keyed = keyed.join(profile.toDF(record, "value"), record, "left")
        value = F.coalesce(F.avg("value"), F.lit(0.0))
    sized = keyed.groupBy("g").agg(F.count("*").alias("n"), F.round(value * 4).cast("int").alias("profile"))
    coarse = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.02)))
    size = F.when(F.col("n") <= EXACT_SIZE, F.col("n")).otherwise(F.round(F.pow(F.lit(1.02), coarse + 0.5))).cast("long")
    slot = F.pmod(F.xxhash64("g", F.lit(1)), F.lit(SLOTS)).cast("int")
    sized = cut_lineage(sized.select("g", "n", "profile", size.alias("size"), slot.alias("slot")))
    per_slot = sized.groupBy("size", "profile", "slot").agg(F.count("*").alias("groups"), F.sum("n").alias("records"))
    counts = per_slot.groupBy("size", "profile").agg(F.sum("groups").alias("groups"), F.sum("records").alias("records")).limit(MAX_BUNDLES + 1).collect()
    if len(counts) > MAX_BUNDLES:
        raise ValueError("too many bundles of size and profile")
    # Quotas are filled with the records there are: a shared bundle counts with its mean size.
    held: dict[int, list[int]] = {}
    for r in counts:
        both = held.setdefault(r["size"], [0, 0])
        both[0], both[1] = both[0] + r["records"], both[1] + r["groups"]
    mean = {a: records / groups for a, (records, groups) in held.items()}
    sizes = {(mean[r["size"]], r["profile"]): r["size"] for r in counts}
    plan = allocate([(mean[r["size"]], r["profile"], r["groups"]) for r in counts], weights)
    spark = groups.sparkSession
    rows = [(sizes[a, p], p, *[int(sum(x[: s + 1])) for s in range(len(names))]) for (a, p), x in plan.items()]
    ends = ", ".join(f"e{s} long" for s in range(len(names)))
    ladder = F.broadcast(spark.createDataFrame(rows, f"size long, profile int, {ends}"))
    before = F.sum("groups").over(W.partitionBy("size", "profile").orderBy("slot").rowsBetween(W.unboundedPreceding, -1))
    offsets = per_slot.select("size", "profile", "slot", F.coalesce(before, F.lit(0)).alias("offset"))
    rank = F.row_number().over(W.partitionBy("size", "profile", "slot").orderBy(F.xxhash64("g", F.lit(2)), "g"))
    placed = sized.withColumn("rn", rank).join(offsets, ["size", "profile", "slot"]).join(ladder, ["size", "profile"])
    split = F.coalesce(*[F.when(F.col("rn") + F.col("offset") <= F.col(f"e{s}"), n) for s, n in enumerate(names)])
    return keyed.join(placed.select("g", split.alias("split")), "g").select(record, "group_key", "split")
