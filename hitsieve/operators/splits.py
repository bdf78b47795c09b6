"""Splits, folds, samples, permutations and augmentation; every choice follows a seeded hash of the row id."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from hitsieve.functions.scalar import seeded_hash
from hitsieve.functions.text import tokens
from hitsieve.operators.joins import skew_safe_join
from hitsieve.operators.ordering import ranked
from hitsieve.session import cut_lineage

HASH_TOP = float(1 << 32)
GROUPS_PER_CELL = 50_000
# How far a hold-out may overfill, the weights of its classes, the cost of a missing class.
OVERFILL = 1.05
POSITIVE_WEIGHT, NEGATIVE_WEIGHT, MISSING_CLASS = 0.75, 0.25, 5.0
SLICES = 256


def stratified_holdout(df: DataFrame, id_col: str, label: str | None, test_size: float, seed: int) -> DataFrame:
    """(id, role): the first round(n_c * f) rows of every class in hash order are external; no label, no strata."""
    by = [label] if label else []
    h = df.select(id_col, *by).withColumn("_h", seeded_hash(seed, F.col(id_col)))
    pos = ranked(h, by, "_h", "_r", ties=[id_col])
    take = F.round(F.col("_r_of") * F.lit(float(test_size)))
    return pos.select(id_col, *by, F.when(F.col("_r") < take, "external").otherwise("dev").alias("role"))


def uniform_sample(df: DataFrame, id_col: str, size: int, seed: int) -> DataFrame:
    """The `size` rows with the smallest seeded hash; a distributed top-k."""
    return (df.withColumn("_h", seeded_hash(seed, F.col(id_col))).orderBy("_h", id_col).limit(size).drop("_h"))


def balanced_sample(df: DataFrame, id_col: str, label: str, size: int, seed: int) -> DataFrame:
    """Class-balanced ids: size // classes per class in hash order, topped up from the rest in hash order.

    `size` is a small fixed sample (background data), so every ordered step keeps at most `size` rows per class.
    """
    rows = df.select(id_col, label).withColumn("_h", seeded_hash(seed, F.col(id_col)))
    classes = df.agg(F.countDistinct(label)).scalar()
    # the smallest `size` of a class are among the smallest `size` of its slices, which tasks share
    slice_ = W.partitionBy(label, "_s").orderBy("_h", id_col)
    few = (rows.withColumn("_s", F.pmod(F.xxhash64(id_col), F.lit(SLICES)))
           .withColumn("_r", F.row_number().over(slice_)).where(F.col("_r") <= size))
    first = W.partitionBy(label).orderBy("_h", id_col)
    head = few.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= size)
    share = F.greatest(F.lit(1), F.floor(F.lit(size) / classes))
    everyone = W.partitionBy(F.lit(0)).orderBy((F.col("_r") > share).cast("int"), "_h", id_col)
    return (head.withColumn("_place", F.row_number().over(everyone)).where(F.col("_place") <= size)
            .select(id_col, label))


def permuted_labels(df: DataFrame, id_col: str, label: str, permutations: int, seed: int) -> DataFrame:
    """(permutation, id, label, permuted): rank by id meets rank by seeded hash; class counts stay."""
    rows = df.select(id_col, label)
    here = ranked(rows, [], id_col, "_r").drop("_r_of")
    runs = rows.select(F.explode(F.sequence(F.lit(1), F.lit(permutations))).alias("permutation"),
                       F.col(label).alias("permuted"), F.col(id_col).alias("_src"))
    runs = runs.withColumn("_h", seeded_hash(F.col("permutation") + seed * 1000, F.col("_src")))
    there = ranked(runs, ["permutation"], "_h", "_r", ties=["_src"])
    return here.join(there.select("permutation", "permuted", "_r"), "_r").drop("_r")


def augment(df: DataFrame, id_col: str, text: str, n: int, split_seed: int, phase_seed: int,
            recompute=None) -> DataFrame:
    """Originals plus n variants per row with tokens in a seeded order; other columns are inherited.

    `recompute` derives the features of the variants from their text; without it the originals' are reused.
    """
    plain = df.withColumn("variant", F.lit(0))
    if n <= 0:
        return plain
    seed = (F.lit(split_seed).cast("bigint") * 10_000_000 + F.lit(phase_seed).cast("bigint") * 100_000
            + F.col("variant"))
    more = df.withColumn("variant", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("_s", seed)
    keyed = F.transform(tokens(F.col(text)), lambda t, i: F.struct(
        F.xxhash64(F.col("_s"), F.col(id_col), i).alias("h"), i.alias("i"), t.alias("t")))
    mixed = F.array_join(F.transform(F.sort_array(keyed), lambda s: s["t"]), " ")
    more = more.withColumn(text, mixed).where(F.length(text) > 0).drop("_s")
    return plain.unionByName(recompute(more) if recompute else more)


# ---- group-disjoint hold-out -----------------------------------------------------------------------------------

def group_table(df: DataFrame, key: str, label: str) -> DataFrame:
    """One row per group; rows without a key form the group ''."""
    return (df.groupBy(F.coalesce(F.col(key), F.lit("")).alias("key"))
            .agg(F.count("*").alias("n"), F.sum((F.col(label) == 1).cast("bigint")).alias("pos")))


def _fill(pdf: pd.DataFrame, room: float) -> np.ndarray:
    """Greedy pass in order: a group enters while it fits."""
    taken = np.zeros(len(pdf), dtype=bool)
    for i, size in enumerate(pdf["n"].to_numpy()):
        if size <= room:
            taken[i] = True
            room -= size
    return taken


def _trial_rows(groups: DataFrame, seed: int, trial: Column, cells: int) -> DataFrame:
    h = F.xxhash64(F.lit(seed).cast("bigint") + F.col("trial"), F.col("key"))
    cell = F.floor((h.cast("double") / F.lit(2.0 ** 64) + 0.5) * cells)
    return (groups.withColumn("trial", trial).withColumn("h", h)
            .withColumn("cell", F.least(cell, F.lit(cells - 1)).cast("int")))


def group_holdout(df: DataFrame, key: str, label: str, test_size: float, seed: int, trials: int = 200,
                  groups_per_cell: int = GROUPS_PER_CELL) -> DataFrame:
    """Rows with `role`: whole groups fill the external part in random order, the best of `trials` orders wins.

    An order visits the groups and takes each one that still fits under 1.05 * target. The order is cut into
    cells of the hash range. A cell that fits whole, or where not even the smallest group fits, is settled by
    its totals; only a cell that fits in part is walked group by group, in one task per trial. The driver holds
    `trials` totals for every `groups_per_cell` groups.
    """
    groups = cut_lineage(group_table(df, key, label))
    total = groups.agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"), F.count("*").alias("g")).first()
    n, pos = int(total["n"] or 0), int(total["pos"] or 0)
    cells = max(1, math.ceil(int(total["g"]) / groups_per_cell))
    target = int(n * test_size)
    cap = target * OVERFILL
    order = _trial_rows(groups, seed, F.explode(F.sequence(F.lit(0), F.lit(trials - 1))), cells)
    sums = (order.groupBy("trial", "cell").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"),
                                               F.min("n").alias("least")).orderBy("trial", "cell").toPandas())
    per = {t: g.set_index("cell") for t, g in sums.groupby("trial")}
    state = {t: {"at": 0, "room": cap, "n": 0, "pos": 0, "whole": [], "walked": {}} for t in range(trials)}
    open_trials = dict.fromkeys(state)
    while open_trials:
        todo = []
        for t in list(open_trials):
            s, tab = state[t], per[t]
            for c in tab.index[tab.index >= s["at"]]:
                row = tab.loc[c]
                s["at"] = int(c) + 1
                if row["least"] > s["room"]:
                    continue
                if row["n"] <= s["room"]:
                    s["whole"].append(int(c))
                    s["room"] -= row["n"]
                    s["n"] += int(row["n"])
                    s["pos"] += int(row["pos"])
                    continue
                s["walked"][int(c)] = float(s["room"])
                todo.append((t, int(c), float(s["room"])))
                break
            else:
                del open_trials[t]
        if not todo:
            break
        spark = df.sparkSession
        want = spark.createDataFrame(todo, "trial int, cell int, room double")

        def walk(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["h", "key"])
            got = pdf[_fill(pdf, float(pdf["room"].iloc[0]))]
            return pd.DataFrame({"trial": [pdf["trial"].iloc[0]], "n": [got["n"].sum()], "pos": [got["pos"].sum()]})

        done = (order.join(F.broadcast(want), ["trial", "cell"]).groupBy("trial", "cell")
                .applyInPandas(walk, "trial int, n bigint, pos bigint").collect())
        for r in done:
            s = state[r["trial"]]
            s["room"] -= r["n"]
            s["n"] += int(r["n"])
            s["pos"] += int(r["pos"])

    goal_pos = int(round(pos * test_size)) if pos else 0
    goal_neg = int(round((n - pos) * test_size)) if n - pos else 0

    def score(s: dict) -> float:
        neg = s["n"] - s["pos"]
        out = abs(s["n"] - target) / max(target, 1)
        out += POSITIVE_WEIGHT * abs(s["pos"] - goal_pos) / goal_pos if goal_pos else 0.0
        out += NEGATIVE_WEIGHT * abs(neg - goal_neg) / goal_neg if goal_neg else 0.0
        return out + MISSING_CLASS * (goal_pos > 0 and s["pos"] < 1) + MISSING_CLASS * (goal_neg > 0 and neg < 1)

    best = min(state, key=lambda t: (score(state[t]), t))
    rows = _trial_rows(groups, seed, F.lit(best), cells)
    chosen = state[best]
    plan = [(c, -1.0) for c in chosen["whole"]] + list(chosen["walked"].items())
    if not plan:
        return df.withColumn("role", F.lit("dev"))
    table = df.sparkSession.createDataFrame([(int(c), float(v)) for c, v in plan], "cell int, room double")
    part = rows.join(F.broadcast(table), "cell")

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "key"])
        return pdf.loc[_fill(pdf, float(pdf["room"].iloc[0])), ["key"]]

    inside = part.where("room < 0").select("key").unionByName(
        part.where("room >= 0").select("key", "n", "h", "cell", "room").groupBy("cell").applyInPandas(pick, "key string"))
    roles = groups.select("key").join(inside.withColumn("role", F.lit("external")), "key", "left")
    return _attach(df, key, roles.withColumn("role", F.coalesce("role", F.lit("dev"))), groups)


def _attach(df: DataFrame, key: str, roles: DataFrame, groups: DataFrame) -> DataFrame:
    keyed = df.withColumn("_key", F.coalesce(F.col(key), F.lit("")))
    sizes = groups.select(F.col("key").alias("_key"), "n")
    return skew_safe_join(keyed, roles.withColumnRenamed("key", "_key"), "_key", sizes=sizes).drop("_key")


# ---- grouped folds ---------------------------------------------------------------------------------------------

def _greedy_folds(profiles: pd.DataFrame, k: int, stratify: bool) -> list[list[int]]:
    """Folds for what is left of each profile after whole rounds, largest imbalance (or size) first.

    Whole rounds give every fold the same and change no comparison. A group goes to the fold it evens out most.
    """
    counts = profiles[["neg", "pos"]].to_numpy(dtype=float)
    totals = (counts * profiles[["m"]].to_numpy()).sum(axis=0)
    weight = counts.std(axis=1) if stratify else counts.sum(axis=1)
    order = np.lexsort((counts[:, 1], counts[:, 0], -weight))
    load, folds = np.zeros((k, 2)), [[] for _ in range(len(profiles))]
    left = (profiles["m"] % k).to_numpy()
    for i in order:
        for _ in range(left[i]):
            if stratify:
                trial = load[None, :, :] + np.eye(k)[:, :, None] * counts[i][None, None, :]
                spread = (trial / np.maximum(totals, 1)[None, None, :]).std(axis=1).mean(axis=1)
                f = int(np.lexsort((load.sum(axis=1), np.round(spread, 12)))[0])
            else:
                f = int(np.argmin(load.sum(axis=1)))
            folds[i].append(f)
            load[f] += counts[i]
    return folds


def assign_folds(groups: DataFrame, k: int, seed: int, stratify: bool = True) -> DataFrame:
    """(key, n, pos, fold) for a group table.

    Groups with the same class counts are interchangeable; they form a profile. One rule holds for every size: the m
    groups of a profile, in hash order, go round the folds m // k times, and the m % k left are placed greedily. The
    driver sees one row per profile, that is per distinct pair of counts, and never the groups.
    """
    g = groups.withColumn("h", seeded_hash(seed, F.col("key"))).withColumn("neg", F.col("n") - F.col("pos"))
    profiles = g.groupBy("neg", "pos").agg(F.count("*").alias("m")).orderBy("neg", "pos").toPandas()
    folds = _greedy_folds(profiles, k, stratify)
    rows = [(int(a), int(b), f) for a, b, f in zip(profiles["neg"], profiles["pos"], folds)]
    placed = groups.sparkSession.createDataFrame(rows, "neg bigint, pos bigint, last array<int>")
    at = ranked(g, ["neg", "pos"], "h", "_r", ties=["key"]).join(placed, ["neg", "pos"])
    rounds = F.col("_r_of") - F.col("_r_of") % k
    start = seeded_hash(seed, F.concat_ws(":", "neg", "pos"))
    fold = F.when(F.col("_r") < rounds, F.pmod(F.col("_r") + start, F.lit(k))).otherwise(
        F.get("last", (F.col("_r") - rounds).cast("int")))
    return at.select("key", "n", "pos", fold.cast("int").alias("fold"))


def fold_balance(df: DataFrame, label: str, fold: str = "fold") -> DataFrame:
    return df.groupBy(fold).agg(F.sum(label).alias("positives"), F.count("*").alias("n"))


def grouped_folds(df: DataFrame, key: str, label: str, k: int, seed: int) -> DataFrame:
    """Rows with `fold`: groups stay together and classes are balanced; without a class in every fold, sizes are."""
    groups = cut_lineage(group_table(df, key, label))
    k = min(k, groups.count())
    if k < 2:
        raise ValueError("not enough groups for folds")
    folds = cut_lineage(assign_folds(groups, k, seed))
    check = folds.groupBy("fold").agg(F.sum("pos").alias("p"), F.sum("n").alias("n")).collect()
    if len(check) < k or any(r["p"] == 0 or r["p"] == r["n"] for r in check):
        folds = cut_lineage(assign_folds(groups, k, seed, stratify=False))
    return _attach(df, key, folds.select("key", "fold"), groups)


def tuning_folds(df: DataFrame, key: str, label: str, k: int, seed: int) -> DataFrame | None:
    """Folds for tuning, or None when a class or the groups are too few for two folds."""
    counts = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}
    if len(counts) < 2 or min(counts.values()) < 2:
        return None
    k = min(k, min(counts.values()))
    groups = df.select(F.countDistinct(F.coalesce(F.col(key), F.lit("")))).first()[0]
    k = min(k, groups)
    return None if k < 2 else grouped_folds(df, key, label, k, seed)
