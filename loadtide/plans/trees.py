"""Regression trees of many groups at once, grown level by level from histograms.

A group is a series, or a series at an origin. All groups and, in a forest, all trees grow together: one level is one aggregate of
(group, tree, node, feature, bin), a search over at most ``BINS`` bins, and one join that moves the rows to the next nodes. Plans and jobs depend on depth and
rounds, never on the number of groups. Trees are a flat table, a row a node; prediction joins them by group.
"""
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loadtide.operators.ordered import require_keys
from loadtide.session import cut_lineage

#: Quantile bins of a feature.
BINS = 64
#: Our own; results needn't equal another library's draws.
SEED = 7

# Settings of the full and the quick run.
FOREST = {"full": {"trees": 150, "depth": 18, "min_leaf": 2}, "quick": {"trees": 40, "depth": 12, "min_leaf": 5}}
BOOST = {"full": {"rounds": 700, "depth": 8, "step": 0.05}, "quick": {"rounds": 300, "depth": 6, "step": 0.08}}
BOOST_RATES = {"row_rate": 0.8, "column_rate": 0.8, "alpha": 0.1, "penalty": 1.0}

NODE = ["tree", "level", "node", "n", "value", "feature", "threshold", "left", "gain"]


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on nothing but its arguments."""
    return F.pmod(F.xxhash64(F.lit(SEED), *parts), F.lit(1 << 30)) / F.lit(float(1 << 30))


def _poisson(u: Column) -> Column:
    """Bootstrap weight: Poisson with mean one, by inversion."""
    out, mass, total = F.lit(6.0), 0.36787944117144233, 0.0
    steps = []
    for k in range(6):
        total += mass
        steps.append((total, float(k)))
        mass /= k + 1
    for bound, k in reversed(steps):
        out = F.when(u < bound, k).otherwise(out)
    return out


def _numbered(train: DataFrame, keys: list[str], features: list[str], target: str, min_rows: int) -> tuple[DataFrame, DataFrame]:
    """Groups (g, keys, rows, edges: BINS - 1 ascending values a feature at most) and their complete rows (g, r, b: bins, y)."""
    complete = require_keys(train, list(keys)).dropna(subset=[*features, target])
    points = F.array(*[F.lit((i + 1) / BINS) for i in range(BINS - 1)])
    sketch = [F.percentile_approx(F.col(f).cast("double"), points, F.lit(10_000)).alias(f"_e{i}") for i, f in enumerate(features)]
    groups = complete.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.avg(target).alias("level"), *sketch)
    groups = cut_lineage(groups.select(F.monotonically_increasing_id().alias("g"), *keys, "rows", "level",
                                       F.array(*[F.array_sort(F.array_distinct(f"_e{i}")) for i in range(len(features))]).alias("edges")), "groups")
    named = groups.where(F.col("rows") >= min_rows)
    values = F.array(*[F.col(f).cast("double") for f in features])
    bins = F.transform(F.arrays_zip(values.alias("x"), F.col("edges").alias("e")), lambda z: F.size(F.filter(z["e"], lambda e: e < z["x"])).cast("tinyint"))
    rows = complete.join(named.select("g", *keys, "edges", "level"), list(keys))
    rows = rows.select("g", F.monotonically_increasing_id().alias("r"), bins.alias("b"), (F.col(target) - F.col("level")).alias("y"))
    return groups, cut_lineage(rows, "binned")


def _level(state: DataFrame, level: int, last: bool, weight: Column, chosen: Column, min_leaf: float, penalty: float, alpha: float) -> DataFrame:
    """The nodes of a level with their best splits, written: g, tree, level and splits, an array of (node, feature, bin, left, value, n, gain).

    ``state`` has g, r, b, y and nodes (per tree the row's node of this level, 0 where it rests in a leaf above). Sums are taken map-side before the first shuffle; the second
    brings a tree's sums together, at most nodes x features x bins of them, and serves the search, the numbering of children and the array.
    """
    alive = (state.select("g", "r", "b", "y", F.posexplode("nodes").alias("tree", "node")).where("node > 0").withColumn("w", weight).where("w > 0"))
    cells = alive.select("g", "tree", "node", "w", (F.col("w") * F.col("y")).alias("s"), F.posexplode("b").alias("f", "bin")).where(chosen)
    hist = cells.groupBy("g", "tree", "node", "f", "bin").agg(F.sum("w").alias("w"), F.sum("s").alias("s")).repartition("g", "tree")
    node = W.partitionBy("g", "tree", "node", "f")
    upto = node.orderBy("bin").rowsBetween(W.unboundedPreceding, 0)

    def pull(s: Column) -> Column:
        return F.signum(s) * F.greatest(F.abs(s) - alpha, F.lit(0.0))

    def score(s: Column, n: Column) -> Column:
        return pull(s) * pull(s) / (n + penalty)

    both = hist.withColumns({"nl": F.sum("w").over(upto), "sl": F.sum("s").over(upto), "n": F.sum("w").over(node), "t": F.sum("s").over(node)})
    nr, sr = F.col("n") - F.col("nl"), F.col("t") - F.col("sl")
    gain = score(F.col("sl"), F.col("nl")) + score(sr, nr) - score(F.col("t"), F.col("n"))
    fits = (F.col("nl") >= min_leaf) & (nr >= min_leaf) & (gain > 1e-9) & F.lit(not last)
    best = (both.withColumn("k", F.when(fits, F.struct(F.round(gain, 9).alias("gain"), (-F.col("f")).alias("f"), (-F.col("bin")).alias("bin"))))
            .groupBy("g", "tree", "node").agg(F.max("n").alias("n"), F.max("t").alias("t"), F.max("k").alias("k")))
    best = best.select("g", "tree", "node", "n", (pull(F.col("t")) / (F.col("n") + penalty)).alias("value"),
                       (-F.col("k.f")).alias("feature"), (-F.col("k.bin")).alias("bin"), F.col("k.gain").alias("gain"))
    before = W.partitionBy("g", "tree").orderBy("node").rowsBetween(W.unboundedPreceding, 0)
    splits = F.sum(F.col("feature").isNotNull().cast("int")).over(before)
    best = best.withColumn("left", F.when(F.col("feature").isNotNull(), 2 * splits - 1).cast("int"))
    row = F.struct("node", "feature", "bin", "left", "value", "n", "gain")
    return cut_lineage(best.groupBy("g", "tree").agg(F.array_sort(F.collect_list(row)).alias("splits")).withColumn("level", F.lit(level)), "tree-level")


def _moved(state: DataFrame, level: DataFrame, trees: int, keep: list[str]) -> DataFrame:
    """``state`` after a level: rows go to the child of their node, or rest (node 0) and take the leaf's value as ``out``."""
    if trees == 1:
        packed = level.select("g", F.array("splits").alias("splits"))
    else:
        packed = level.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("tree", "splits"))).alias("m"))
        packed = packed.select("g", F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.try_element_at("m", t)).alias("splits"))

    def step(n, t):
        s = F.get(F.get("splits", t), n - 1)
        side = F.when(F.get("b", s["feature"]) <= s["bin"], s["left"]).otherwise(s["left"] + 1)
        return F.when((n > 0) & s["feature"].isNotNull(), side).otherwise(0)

    moved = state.join(packed, "g", "left")
    if "out" in keep:
        at = F.get(F.get("splits", F.lit(0)), F.col("nodes")[0] - 1)
        moved = moved.withColumn("out", F.when((F.col("nodes")[0] > 0) & at["feature"].isNull(), at["value"]).otherwise(F.col("out")))
    return moved.withColumn("nodes", F.transform("nodes", step)).select("g", "r", "b", "y", "nodes", *keep)


def _named(levels: list[DataFrame], groups: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """The flat tree table with keys, feature names and thresholds: rows up to the threshold go left."""
    names = F.array(*[F.lit(f) for f in features])
    nodes = _union(levels).select("g", "tree", "level", F.inline("splits")).join(groups.select("g", *keys, "edges"), "g")
    # A split at the last bin of a feature has no rows behind it, so the edge is always there.
    edge = F.get(F.get("edges", F.col("feature")), F.col("bin").cast("int"))
    return nodes.withColumn("threshold", edge).withColumn("feature", F.get(names, F.col("feature"))).select(*keys, *NODE)


def run_table(groups: DataFrame, keys: list[str], min_rows: int) -> DataFrame:
    """keys, train_rows, status, detail: a row per group that has any complete row."""
    few = F.col("rows") < min_rows
    return groups.select(*keys, F.col("rows").alias("train_rows"), F.when(few, "MODEL_FAILED").otherwise("MODEL_READY").alias("status"),
                         F.when(few, "too few complete training rows").otherwise("").alias("detail"))


def fit_forest(train: DataFrame, keys: list[str], features: list[str], target: str = "y", trees: int = 40, depth: int = 12, min_leaf: float = 5,
               features_a_split: float | None = None, bootstrap: bool = True, min_rows: int = 2000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(trees, groups, run table) of a random forest per group of ``keys``.

    Each tree sees its own bootstrap of the rows and each node about the square root of the features (``features_a_split`` sets their expected
    number). Rows with a null in features or target are left out; groups with fewer than ``min_rows`` others get no trees. A NULL key raises.
    """
    groups, rows = _numbered(train, keys, features, target, min_rows)
    p = len(features)
    want = min(1.0, (features_a_split or p ** 0.5) / p)
    weight = _poisson(_uniform(F.lit("row"), F.col("r"), F.col("tree"))) if bootstrap else F.lit(1.0)
    always = F.pmod(F.xxhash64(F.lit(SEED), F.col("g"), F.col("tree"), F.col("node")), F.lit(p)) == F.col("f")
    state = rows.withColumn("nodes", F.array_repeat(F.lit(1), trees))
    levels = []
    for d in range(depth + 1):
        chosen = (_uniform(F.lit("feature"), F.col("g"), F.col("tree"), F.lit(d), F.col("node"), F.col("f")) < want) | always
        level = _level(state, d, d == depth, weight, chosen, min_leaf, 0.0, 0.0)
        levels.append(level)
        if d == depth or not level.agg(F.max(F.exists("splits", lambda s: s["feature"].isNotNull()))).first()[0]:
            break
        state = cut_lineage(_moved(state, level, trees, []), "forest-rows")
    return cut_lineage(_named(levels, groups, keys, features), "forest"), groups, run_table(groups, keys, min_rows)


def fit_boost(train: DataFrame, keys: list[str], features: list[str], target: str = "y", rounds: int = 300, depth: int = 6, step: float = 0.08, min_leaf: float = 1,
              row_rate: float = 0.8, column_rate: float = 0.8, alpha: float = 0.1, penalty: float = 1.0, min_rows: int = 2000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(trees, groups, run table) of boosted trees per group: each round fits what the rounds before left over.

    Leaf values are pulled towards zero (``alpha``, ``penalty``); a round draws its rows and features. The value column of the trees holds the step already.
    """
    groups, rows = _numbered(train, keys, features, target, min_rows)
    state, levels = rows, []
    for k in range(rounds):
        weight = (_uniform(F.lit("row"), F.col("r"), F.lit(k)) < row_rate).cast("double")
        chosen = (_uniform(F.lit("feature"), F.col("g"), F.lit(k), F.col("f")) < column_rate) | (F.pmod(F.lit(k), F.lit(len(features))) == F.col("f"))
        now = state.withColumns({"nodes": F.array(F.lit(1)), "out": F.lit(0.0)})
        for d in range(depth + 1):
            level = _level(now, d, d == depth, weight, chosen, min_leaf, penalty, alpha)
            stepped = F.transform("splits", lambda s: s.withField("value", s["value"] * step))
            levels.append(level.select("g", F.lit(k).alias("tree"), "level", stepped.alias("splits")))
            now = _moved(now, level, 1, ["out"])
        state = cut_lineage(now.select("g", "r", "b", (F.col("y") - step * F.col("out")).alias("y")), "boost-rows")
        if len(levels) > 60:                                         # keeps the plan of the union short
            levels = [cut_lineage(_union(levels), "boosted")]
    return cut_lineage(_named(levels, groups, keys, features), "boost"), groups, run_table(groups, keys, min_rows)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def packed(trees: DataFrame, groups: DataFrame, keys: list[str], features: list[str], average: bool) -> DataFrame:
    """keys, base, average, forest: per group its trees as arrays of levels of nodes (feature number, threshold, left child, value)."""
    number = F.array_position(F.array(*[F.lit(f) for f in features]), F.col("feature")) - 1
    nodes = trees.select(*keys, "tree", "level", "node", F.when(F.col("feature").isNotNull(), number).cast("int").alias("f"), "threshold", "left", "value")
    levels = nodes.groupBy(*keys, "tree", "level").agg(F.array_sort(F.collect_list(F.struct("node", "f", "threshold", "left", "value"))).alias("nodes"))
    single = levels.groupBy(*keys, "tree").agg(F.transform(F.array_sort(F.collect_list(F.struct("level", "nodes"))), lambda s: s["nodes"]).alias("levels"))
    forest = single.groupBy(*keys).agg(F.collect_list("levels").alias("forest"))
    return forest.join(groups.select(*keys, F.col("level").alias("base")), list(keys)).withColumn("average", F.lit(average))


def predict(rows: DataFrame, forests: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """``rows`` with prediction: one join by group, then a walk down every tree. NULL where a group has no trees or a feature is missing.

    The side of packed trees is a row a group; the optimiser broadcasts it while it is small.
    """
    table = forests.select(*[F.col(k).alias(f"_{k}") for k in keys], "base", "average", "forest")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))

    def down(at, nodes):
        n = F.get(nodes, at["node"] - 1)
        child = F.when(F.get("_x", n["f"]) <= n["threshold"], n["left"]).otherwise(n["left"] + 1)
        stay = at["node"] == 0
        return F.struct(F.when(stay | n["f"].isNull(), 0).otherwise(child).alias("node"), F.when(stay, at["value"]).otherwise(n["value"]).alias("value"))

    start = F.struct(F.lit(1).alias("node"), F.lit(0.0).alias("value"))
    walked = F.transform("forest", lambda levels: F.aggregate(levels, start, down, lambda at: at["value"]))
    total = F.aggregate(walked, F.lit(0.0), lambda a, x: a + x)
    there = F.forall("_x", lambda x: x.isNotNull())
    value = F.when(there, F.col("base") + F.when(F.col("average"), total / F.size("forest")).otherwise(total))
    return (rows.withColumn("_x", F.array(*[F.col(f).cast("double") for f in features])).join(table, same, "left")
            .withColumn("prediction", value).drop("_x", "base", "average", "forest", *[f"_{k}" for k in keys]))


def importance(trees: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """keys, feature, importance: each feature's share of the gain of a group's splits; 0 for a feature no split uses."""
    names = trees.select(*keys).distinct().withColumn("feature", F.explode(F.array(*[F.lit(f) for f in features])))
    gains = trees.where("feature IS NOT NULL").groupBy(*keys, "feature").agg(F.sum("gain").alias("_gain"))
    total = W.partitionBy(*keys)
    got = names.join(gains, [*keys, "feature"], "left").withColumn("_gain", F.coalesce("_gain", F.lit(0.0)))
    return got.withColumn("importance", F.coalesce(F.try_divide(F.col("_gain"), F.sum("_gain").over(total)), F.lit(0.0))).drop("_gain")
