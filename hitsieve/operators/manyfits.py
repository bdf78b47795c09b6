"""Many models in one Spark job: lanes of models over shards of rows, which exchange sums where there is more than one.

A training table of up to `SHARD_CELLS` numbers is one shard; then every lane is a task of its own and nothing is
exchanged. A larger one is dealt over shards by a hash, and the tasks of the job run as one barrier stage whose shards
add up their sums (Spark answers such a meeting once a second, so it pays where a pass over a shard takes longer). A
lost task repeats its lane or the stage; all random choices follow seeds and row numbers, so the models are the same.
"""

from __future__ import annotations

import base64
import io
import pickle
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import BarrierTaskContext, TaskContext, keyword_only
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, functions as F

from hitsieve.operators import solvers as S, trees as T
from hitsieve.session import scratch_path

SHARD_CELLS = 1 << 26  # rows times features of a shard
KERNEL_CELLS = 1 << 20  # the same, from which kernel machines that are fewer than the slots are dealt over them
MODEL_BYTES = 256 << 20  # a larger model is refused when it is sent to the executors


@dataclass(frozen=True)
class Job:
    """One model: family, settings, seed, the fold it does not see (None: sees all), the column of its labels.

    `first` makes it a part of a forest, with the trees from that number on.
    """

    family: str
    params: dict = field(default_factory=dict)
    seed: int = 42
    skip: int | None = None
    label: int = 0
    first: int | None = None


# ---- models as arrays ------------------------------------------------------------------------------------------

def _packed(family: str, arrays: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez_compressed(out, family=np.array(family), **arrays)
    return out.getvalue()


def _of_trees(trees: Sequence[T.Tree]) -> dict[str, np.ndarray]:
    return {"start": np.concatenate(([0], np.cumsum([len(t.feature) for t in trees]))),
            **{n: np.concatenate([getattr(t, n) for t in trees]) if trees else np.zeros(0) for n in ("feature", "cut", "left", "right", "value")}}


class Fitted:
    """A model read from its bytes."""

    def __init__(self, blob: bytes):
        with np.load(io.BytesIO(blob), allow_pickle=False) as held:
            self.family, self.arrays = str(held["family"]), {k: held[k] for k in held.files if k != "family"}

    @property
    def trees(self) -> list[T.Tree]:
        a = self.arrays
        return [T.Tree(*(a[n][x:y] for n in ("feature", "cut", "left", "right", "value"))) for x, y in zip(a["start"], a["start"][1:])]

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Score before the sigmoid; a forest has its probability."""
        a = self.arrays
        if self.family == "LR":
            return x @ a["weights"][:-1] + a["weights"][-1]
        if self.family == "MLP":
            return S.network_margin([a[f"layer{i}"] for i in range(len(a))], x)
        if self.family == "SVC":
            return S.kernel_sum(x, a["vectors"], a["times"], float(a["gamma"])) + float(a["offset"])
        total = sum((t.predict(x) for t in self.trees), np.zeros(len(x)))
        return total if self.family == "XGBC" else total / max(1, len(a["start"]) - 1)

    def probability(self, margin: np.ndarray) -> np.ndarray:
        if self.family in ("RFC", "ETC"):
            return margin
        slope, offset = self.arrays["sigmoid"] if self.family == "SVC" else (1.0, 0.0)
        return 1.0 / (1.0 + np.exp(-(slope * margin + offset)))


class Predictor:
    """A function from a matrix to probabilities that is sent as the model's bytes and reads them once a task."""

    def __init__(self, blob: bytes):
        self.blob = blob

    def __getstate__(self) -> dict:
        return {"blob": self.blob}

    @cached_property
    def model(self) -> Fitted:
        return Fitted(self.blob)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.model.probability(self.model.margin(x))


class ArrayModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """A fitted model as a Spark ML model: adds `probability`, `prediction` and, for families with a margin, `rawPrediction`."""

    blob = Param(Params._dummy(), "blob", "the model's arrays", typeConverter=TypeConverters.toString)
    features = Param(Params._dummy(), "features", "vector column", typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, *, blob: str | None = None, features: str | None = None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    @property
    def blob_bytes(self) -> bytes:
        return base64.b64decode(self.getOrDefault(self.blob))

    @property
    def fitted(self) -> Fitted:
        return Fitted(self.blob_bytes)

    def predictor(self) -> Predictor:
        """A function from a matrix to probabilities, for use inside tasks."""
        return Predictor(self.blob_bytes)

    @property
    def coefficients(self) -> DenseVector:
        return DenseVector(self.fitted.arrays["weights"][:-1])

    @property
    def intercept(self) -> float:
        return float(self.fitted.arrays["weights"][-1])

    def _transform(self, dataset: DataFrame) -> DataFrame:
        raw, model = self.blob_bytes, self.fitted
        if len(raw) > MODEL_BYTES:
            raise ValueError("the model is too large to be sent to every task")
        sent = dataset.sparkSession.sparkContext.broadcast(raw)
        held: list[Fitted] = []

        @F.pandas_udf("m double, p double")
        def score(v: pd.Series) -> pd.DataFrame:
            if not held:
                held.append(Fitted(sent.value))
            x = np.stack([np.asarray(r, np.float64) for r in v]) if len(v) else np.zeros((0, 1))
            m = held[0].margin(x) if len(v) else np.zeros(0)
            return pd.DataFrame({"m": m, "p": held[0].probability(m)})

        out = dataset.withColumn("_score", score(vector_to_array(self.getOrDefault(self.features))))
        pair = lambda c, other: array_to_vector(F.array(other, F.col(c)))
        out = out.withColumn("probability", pair("_score.p", 1 - F.col("_score.p")))
        if model.family == "SVC":
            out = out.withColumn("rawPrediction", pair("_score.m", -F.col("_score.m")))
        return out.withColumn("prediction", (F.col("_score.p") > 0.5).cast("double")).drop("_score")


# ---- the task --------------------------------------------------------------------------------------------------

def run_alone(fit, exchange: Callable[[str, np.ndarray], np.ndarray] = lambda op, part: part):
    """Runs a grower or solver with an exchange; alone, a shard's part is the whole."""
    try:
        op, part = next(fit)
        while True:
            op, part = fit.send(exchange(op, part))
    except StopIteration as end:
        return end.value


class _Meeting:
    """Sums, minima or concatenations over the shards of a lane; every task of the stage comes to every meeting."""

    def __init__(self, lane: int):
        self.lane, self.context = lane, BarrierTaskContext.get()

    def _say(self, what) -> list:
        return [pickle.loads(base64.b64decode(m)) for m in self.context.allGather(base64.b64encode(pickle.dumps(what)).decode())]

    def __call__(self, op: str, part: np.ndarray) -> np.ndarray:
        parts = [m[1] for m in self._say((self.lane, part)) if m[0] == self.lane]
        if op == "cat":
            return np.concatenate(parts)
        return np.minimum.reduce(parts) if op == "min" else np.sum(parts, 0)

    def leave(self) -> None:
        while any(m[0] >= 0 for m in self._say((-1, None))):
            pass


def _fits(jobs: Sequence[tuple[int, Job]], x, y, rows, fold, exchange, keep: bool, scope: str) -> Iterator[tuple[int, np.ndarray, np.ndarray, bytes | None]]:
    """(job, shown rows, their probabilities, model) of the jobs of a lane, family by family; a forest's part gives the sum of its trees."""
    def use(job: Job) -> np.ndarray:
        return (fold >= 0) & (fold != job.skip) if job.skip is not None else fold >= 0

    def shown(job: Job) -> np.ndarray:
        held = (fold < 0) | (fold == (-1 if job.skip is None else job.skip))
        return np.flatnonzero(held if scope == "held" else np.full(len(fold), scope == "all"))

    def result(k: int, job: Job, arrays: dict[str, np.ndarray]):
        blob = _packed(job.family, arrays)
        model, at = Fitted(blob), shown(job)
        return k, at, model.probability(model.margin(x[at])) if len(at) else np.zeros(0), blob

    for family in dict.fromkeys(j.family for _, j in jobs):
        some = [(k, j) for k, j in jobs if j.family == family]
        seen = np.stack([use(j) for _, j in some])
        target = np.stack([y[:, j.label] for _, j in some])
        if family == "LR":
            n = np.maximum(exchange("sum", seen.sum(1).astype(float)), 1.0)
            strength = 1.0 / (np.array([float(j.params.get("C", 1.0)) for _, j in some]) * n)
            sparse = np.array([j.params.get("penalty", "l2") == "l1" for _, j in some])
            steps = [int(j.params.get("max_iter", 1000)) for _, j in some]
            w = run_alone(S.linear(x, target, seen, strength * sparse, strength * ~sparse, steps), exchange)
            for c, (k, j) in enumerate(some):
                yield result(k, j, {"weights": w[:, c]})
        elif family == "XGBC":
            trees, margin = run_alone(T.boost(x, target, rows, seen, [T.Boost(
                int(j.params.get("n_estimators", 200)), int(j.params.get("max_depth", 6)), float(j.params.get("learning_rate", 0.3)),
                float(j.params.get("subsample", 1.0)), float(j.params.get("colsample_bytree", 1.0)),
                float(j.params.get("min_child_weight", 1)), float(j.params.get("reg_lambda", T.L2)), j.seed) for _, j in some]), exchange)
            for (k, j), t, m in zip(some, trees, margin):
                yield k, shown(j), 1.0 / (1.0 + np.exp(-m[shown(j)])), _packed(family, _of_trees(t)) if keep else None
        elif family in ("RFC", "ETC"):
            want = np.zeros(seen.shape, bool)
            for at, (_, j) in zip(want, some):
                at[shown(j)] = True
            trees, total = run_alone(T.forest(x, target, rows, seen, [T.Forest(
                _trees(j), j.params.get("max_depth"), int(j.params.get("min_samples_split", 2)),
                int(j.params.get("min_samples_leaf", 1)), j.params.get("max_features", "sqrt"), family == "ETC", j.seed, j.first or 0) for _, j in some],
                keep, want=want), exchange)
            for (k, j), t, q in zip(some, trees, total):
                whole = 1 if j.first is not None else max(1, _trees(j))
                yield k, shown(j), q[shown(j)] / whole, _packed(family, _of_trees(t) | {"first": np.array(j.first or 0)}) if keep else None
        elif family == "MLP":
            for (k, j), t, u in zip(some, target, seen):
                layers = run_alone(S.network(x, t, rows, u, j.params.get("hidden_layer_sizes", (256, 128)), float(j.params.get("alpha", 1e-4)),
                                             float(j.params.get("learning_rate_init", 1e-3)), int(j.params.get("max_iter", 500)), j.seed), exchange)
                yield result(k, j, {f"layer{i}": p for i, p in enumerate(layers)})
        elif family == "SVC":
            for (k, j), t, u in zip(some, target, seen):
                v, times, offset, gamma, sigmoid = run_alone(S.machine(x, t, u, float(j.params.get("C", 1.0)), j.params.get("gamma", "scale")), exchange)
                yield result(k, j, {"vectors": v, "times": times, "offset": np.array(offset), "gamma": np.array(gamma), "sigmoid": sigmoid})
        else:
            raise ValueError(f"unknown family: {family}")


def _trees(job: Job) -> int:
    return int(job.params.get("n_estimators", 200))


OUT = "job int, _row long, p double, model binary"


class _Lane:
    """One task: its lane's jobs over its shard's rows."""

    def __init__(self, lanes: list[list[tuple[int, Job]]], shards: int, width: int, labels: int, scope: str, keep: bool):
        self.lanes, self.shards, self.width, self.labels, self.scope, self.keep = lanes, shards, width, labels, scope, keep

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, parts = None, []
        for b in batches:
            if b.num_rows:
                # rows bring their place with them: the number of a task may count other parts of a union as well
                number = int(b.column("_place")[0].as_py())
                parts.append([np.array(c.to_numpy(zero_copy_only=False)) for c in
                              (b.column("_row"), b.column("fold"), b.column("v").flatten(), b.column("y").flatten())])
                del b  # its rows are copied; a task holds its table twice at most, while it is put in order
        if number is None:
            number = TaskContext.get().partitionId() % (len(self.lanes) * self.shards)
            if self.shards == 1:
                return
        lane, shard = divmod(number, self.shards)
        rows, fold, x, y = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0) for i in range(4)) if len(parts) != 1 else parts[0]
        parts.clear()
        rows, fold, x, y = rows.astype(np.int64), fold.astype(np.int64), x.reshape(-1, self.width), y.reshape(-1, self.labels)
        if (np.diff(rows) < 0).any():
            order = np.argsort(rows, kind="stable")
            rows, fold, x, y = rows[order], fold[order], x[order], y[order]
        meeting = _Meeting(lane) if self.shards > 1 else None
        exchange = meeting or (lambda op, part: part)
        for k, at, p, blob in _fits(self.lanes[lane], x, y, rows, fold, exchange, self.keep, self.scope):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(rows[at]), pa.array(p),
                                              pa.nulls(len(at), pa.binary())], ["job", "_row", "p", "model"])
            if self.keep and shard == 0:
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([None], pa.int64()), pa.array([None], pa.float64()),
                                                  pa.array([blob], pa.binary())], ["job", "_row", "p", "model"])
        if meeting:
            meeting.leave()


COST = {"LR": 1.0, "RFC": 4.0, "ETC": 4.0, "XGBC": 6.0, "MLP": 12.0, "SVC": 3.0}


PART = 8  # trees of a part of a forest, at least


def _parts(jobs: Sequence[Job], slots: int) -> list[tuple[int, Job]]:
    """The jobs by number; where they are fewer than the slots, forests in parts that lanes share."""
    out = []
    for k, j in enumerate(jobs):
        size = max(PART, -(-_trees(j) // slots))
        if j.family not in ("RFC", "ETC") or len(jobs) >= slots or _trees(j) <= size:
            out.append((k, j))
            continue
        out += [(k, replace(j, first=low, params={**j.params, "n_estimators": min(size, _trees(j) - low)})) for low in range(0, _trees(j), size)]
    return out


def _dealt(jobs: Sequence[tuple[int, Job]], lanes: int) -> list[list[tuple[int, Job]]]:
    """Jobs over lanes by their guessed cost, the dearest first, each to the lane with least work."""
    out, load = [[] for _ in range(lanes)], [0.0] * lanes
    cost = lambda j: COST.get(j.family, 1.0) * float(j.params.get("n_estimators", 200)) / 200
    for k, j in sorted(jobs, key=lambda t: -cost(t[1])):
        at = load.index(min(load))
        out[at].append((k, j))
        load[at] += cost(j)
    return [sorted(o, key=lambda t: t[0]) for o in out]


def fit_many(rows: DataFrame, features: str, labels: str, jobs: Sequence[Job], fold: str | None = None, scope: str = "held",
             keep: bool = False, row: str = "_row", shard_cells: int = SHARD_CELLS) -> DataFrame:
    """(job, _row, p, model): probabilities of the rows that a job did not see, and its model where it is kept.

    `rows` holds a row number, a vector column, an array of labels (a column for each `Job.label`) and a fold number;
    rows with a fold below 0 are never trained on. `scope` is `held` (rows of the skipped fold and never trained ones), `all` or `none`. The
    rows are copied once for each lane of models, so `rows` is the labelled training table, not a library.
    """
    if len(alone := [k for k, j in enumerate(jobs) if j.family == "SVC"]) < len(jobs) and alone:
        # kernel machines may need more shards than the others
        parts = [(ks, fit_many(rows, features, labels, [jobs[k] for k in ks], fold, scope, keep, row, shard_cells))
                 for ks in ([k for k in range(len(jobs)) if k not in alone], alone)]
        named = [df.withColumn("job", F.get(F.array(*map(F.lit, ks)), F.col("job"))) for ks, df in parts]
        return named[0].unionByName(named[1])
    # a kept model is one row, so its trees stay together; a table of several shards has no lanes to spare
    out, split = _fitted(rows, features, labels, jobs, fold, scope, keep, row, shard_cells, not keep)
    if not split:
        return out
    whole = F.get(F.array(*[F.lit(float(_trees(j)) if k in split else 1.0) for k, j in enumerate(jobs)]), F.col("job"))
    return out.groupBy("job", "_row").agg(F.sum("p").alias("p")).select("job", "_row", (F.col("p") / whole).alias("p"), F.lit(None).cast("binary").alias("model"))


def _fitted(rows: DataFrame, features: str, labels: str, jobs: Sequence[Job], fold: str | None, scope: str, keep: bool, row: str,
            shard_cells: int, parts: bool) -> tuple[DataFrame, set[int]]:
    """What the lanes return, and the jobs that are fitted in parts: their rows hold sums over the trees of a part."""
    spark = rows.sparkSession
    table = rows.select(F.col(row).cast("long").alias("_row"), (F.col(fold) if fold else F.lit(0)).cast("int").alias("fold"),
                        vector_to_array(features).alias("v"), F.transform(labels, lambda v: v.cast("double")).alias("y"))
    facts = table.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d"), F.max(F.size("y")).alias("k")).first()
    if not facts["n"] or not jobs:
        return spark.createDataFrame([], OUT), set()
    shards = max(1, -(-facts["n"] * facts["d"] // shard_cells))
    slots = spark.sparkContext.defaultParallelism
    if all(j.family == "SVC" for j in jobs) and shards <= slots:  # its work grows faster than the rows: machines share idle slots
        shards = max(shards, min(slots // len(jobs), facts["n"] * facts["d"] // KERNEL_CELLS))
    if shards > slots:
        raise ValueError(f"{facts['n']} labelled rows need {shards} tasks at once; there are {slots}")
    dealt = _parts(jobs, slots) if parts and shards == 1 else list(enumerate(jobs))
    split = {k for k, j in dealt if j.first is not None}
    lanes = min(len(dealt), slots // shards if shards > 1 else slots if split else 4 * slots)
    task = _Lane(_dealt(dealt, lanes), shards, facts["d"], facts["k"], scope, keep)
    copies = table.withColumn("_lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    place = F.col("_lane") * shards + F.pmod(F.xxhash64("_row"), F.lit(shards)).cast("int")
    placed = copies.withColumn("_place", place.cast("int")).drop("_lane").repartitionById(lanes * shards, F.col("_place"))
    fits = placed.mapInArrow(task, OUT, barrier=shards > 1)
    if shards > 1:  # a barrier stage can't be part of a union, and a checkpoint of one still counts as one
        path = scratch_path(spark, "fits")
        fits.write.parquet(path)
        fits = spark.read.schema(OUT).parquet(path)
    return fits, split


def fit_models(rows: DataFrame, features: str, labels: str, jobs: Sequence[Job], **options) -> list[ArrayModel]:
    """The fitted models of the jobs, in their order."""
    given = {"fold": None, "row": "_row", "shard_cells": SHARD_CELLS, **options}
    found, _ = _fitted(rows, features, labels, jobs, scope="none", keep=True, parts=True, **given)
    got: dict[int, list[bytes]] = {}
    for r in found.where("model IS NOT NULL").select("job", "model").collect():
        got.setdefault(r["job"], []).append(bytes(r["model"]))
    return [ArrayModel(blob=base64.b64encode(_joined(got[k])).decode(), features=features) for k in range(len(jobs))]


def _joined(parts: Sequence[bytes]) -> bytes:
    """A model from the parts of its forest."""
    if len(parts) == 1:
        return parts[0]
    models = sorted((Fitted(p) for p in parts), key=lambda m: int(m.arrays["first"]))
    return _packed(models[0].family, _of_trees([t for m in models for t in m.trees]))
