"""Error metrics of datasets against a reference."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import ENSEMBLE, aggregate, is_registered
from ..model import Dataset
from .mask import one_frame


def _together(datasets: dict[str, Dataset], names: list[str]) -> DataFrame:
    """The cells of all datasets after each other; as one masked frame if they are its untouched parts."""
    frames = [d.extra.get("frame") for d in datasets.values()]
    if all(f and f[0] is frames[0][0] and f[1] == m and f[2] is d.df for f, (m, d) in zip(frames, datasets.items(), strict=True)):
        keys = next(iter(datasets.values())).keys
        return frames[0][0].where(F.col("model").isin(list(datasets))).select("model", *keys, *[F.col(f"`{v}`") for v in names])
    return one_frame(datasets, names)


def paired(models: dict[str, Dataset], ref: Dataset, variables: Iterable[str], ref_name: str = "") -> DataFrame:
    """``model``, keys, and ``v__a`` and ``v__b`` for each variable: cells that a model and the reference both have.

    All datasets are brought together by one exchange by key; a dataset has a cell once.
    """
    names, keys = list(variables), list(ref.keys)
    every = _together({**models, ref_name: ref}, names)
    own = F.when(F.col("model") == ref_name, F.struct(*[F.col(f"`{v}`") for v in names]))
    both = every.withColumn("_ref", F.max(own).over(Window.partitionBy(*keys))).where((F.col("model") != ref_name) & F.col("_ref").isNotNull())
    return both.select("model", *keys, *[F.col(f"`{v}`").alias(f"{v}__a") for v in names], *[F.col(f"_ref.`{v}`").alias(f"{v}__b") for v in names])


class Metric:
    """A metric of datasets against ``ds_ref``.

    ``inputs`` binds arguments: those that say ``reference`` take the reference and exactly one other
    takes the dataset.  ``dim`` names the keys to reduce over; without it all are.
    """

    def __init__(self, name: str, function: str | Callable, ds_ref: Dataset, inputs: dict[str, str], dim: str | list[str] | None = None, skipna: bool = True):
        predicted = [k for k, v in inputs.items() if v != "reference"]
        if len(predicted) > 1:
            raise ValueError(f"{name}: several predictors {predicted}")
        if not predicted:
            raise IndexError(f"{name}: no predictor")
        # functions take (prediction, reference); the order of arguments says which comes first
        self.name, self.function, self.ref, self.skipna = name, function, ds_ref, skipna
        self.swapped = list(inputs)[0] != predicted[0]
        self.dim = None if dim is None else [dim] if isinstance(dim, str) else list(dim)

    def rest(self, keys: Iterable[str]) -> list[str]:
        """The keys that remain."""
        dims = ["lead_s" if d == "lead_time" else d for d in self.dim or keys]
        return [k for k in keys if k not in dims]

    def columns(self, names: Iterable[str]) -> list[Column]:
        """The metric of each variable over rows of ``paired``."""
        made = []
        for v in names:
            a, b = F.col(f"`{v}__a`"), F.col(f"`{v}__b`")
            made.append(aggregate(self.function, *((b, a) if self.swapped else (a, b)), self.skipna).alias(v))
        return made

    def compute(self, ds: Dataset, variables: list[str] | None = None) -> DataFrame:
        names = variables or sorted(set(ds.variables) & set(self.ref.variables))
        return paired({"0": ds}, self.ref, names).groupBy(*self.rest(ds.keys)).agg(*self.columns(names))


def members_of(ensemble: Dataset, variables: Iterable[str]) -> Dataset:
    """An ensemble with one row for each cell: each variable an array of its members' values, without missing ones."""
    keys = [k for k in ensemble.keys if k != "member"]
    arrays = ensemble.df.groupBy(*keys).agg(*[F.collect_list(F.col(f"`{v}`").cast("double")).alias(v) for v in variables])  # as long as the ensemble is large
    return ensemble.with_df(arrays)


def _cells(ensemble: Dataset, ref: Dataset, variables: list[str]) -> DataFrame:
    """Keys, ``v__a`` (members) and ``v__b`` (reference) of the cells that both have."""
    made = members_of(ensemble, variables)
    keys = list(made.keys)
    if set(keys) != set(ref.keys):
        raise ValueError(f"keys differ: {keys} and {list(ref.keys)}")
    a = made.df.select(*keys, *[F.col(f"`{v}`").alias(f"{v}__a") for v in variables])
    return a.join(ref.df.select(*keys, *[F.col(f"`{v}`").cast("double").alias(f"{v}__b") for v in variables]), keys)


def verify_ensemble(ensemble: Dataset, observation: Dataset, function: str | Callable, dim: str | list[str] | None = None, variables: list[str] | None = None) -> DataFrame:
    """The mean of an ensemble metric over ``dim``: a registered one by name, or a column function of (members, reference).

    Cells without a member's value or without a reference don't count.
    """
    names = variables or sorted(set(ensemble.variables) & set(observation.variables))
    fn = ENSEMBLE[function] if isinstance(function, str) else function
    both = _cells(ensemble, observation, names)
    dims = ["lead_s" if d == "lead_time" else d for d in ([dim] if isinstance(dim, str) else dim or observation.keys)]
    rest = [k for k in observation.keys if k not in dims]
    scores = []
    for v in names:
        a, b = F.col(f"`{v}__a`"), F.col(f"`{v}__b`")
        scores.append(F.avg(F.when(b.isNotNull() & (F.size(a) > 0), fn(a, b))).alias(v))
    return both.groupBy(*rest).agg(*scores)


def rank_histogram(ensemble: Dataset, observation: Dataset, variable: str, dim: str | list[str] | None = None) -> DataFrame:
    """``rank, n``, after the keys that remain: how often how many members are below the reference."""
    dims = [dim] if isinstance(dim, str) else list(dim or observation.keys)
    rest = [k for k in observation.keys if k not in dims]
    both = _cells(ensemble, observation, [variable]).where(F.col(f"`{variable}__b`").isNotNull())
    rank = ENSEMBLE["rank_of_reference"](F.col(f"`{variable}__a`"), F.col(f"`{variable}__b`")).cast("long")
    return both.groupBy(*rest, rank.alias("rank")).agg(F.count("*").alias("n"))


def verify(forecast: Dataset, observation: Dataset, function: str | Callable, inputs: dict[str, str] | None = None, dim: str | list[str] | None = None, skipna: bool = True) -> DataFrame:
    """One metric of one dataset; ``inputs`` uses the names ``forecast`` and ``observation``."""
    bound = {k: "reference" if v == "observation" else v for k, v in (inputs or {"a": "forecast", "b": "observation"}).items()}
    return Metric(str(function), function, observation, bound, dim, skipna).compute(forecast)


def common_variables(datasets: Iterable[Dataset]) -> list[str]:
    return sorted(set.intersection(*(set(d.variables) for d in datasets)))


def stacked_metrics(datasets: dict[str, Dataset], reference: str, metrics: dict[str, dict]) -> DataFrame:
    """All metrics of all datasets but the reference: ``model, metric``, remaining keys, variables."""
    names, ref = common_variables(datasets.values()), datasets[reference]
    if not names:
        raise ValueError("no variable is in all datasets")
    models = {model: d for model, d in datasets.items() if model != reference}
    if not models or not metrics:
        raise ValueError("no metric was computed")
    # all datasets meet the reference by one exchange, and metrics over the same keys are one aggregate
    keys = list(ref.keys)
    both = paired(models, ref, names, reference)
    together: dict[tuple[str, ...], list[Metric]] = {}
    made = []
    for metric, spec in metrics.items():
        m = Metric(metric, spec["function"], ref, spec["inputs"], spec.get("dim"), spec.get("skipna", True))
        rest = m.rest(keys)
        if is_registered(m.function):
            together.setdefault(tuple(rest), []).append(m)
        else:  # functions of arrays don't mix with built-in aggregates
            made.append(both.groupBy("model", *rest).agg(*m.columns(names)).select("model", F.lit(metric).alias("metric"), *rest, *[F.col(f"`{v}`") for v in names]))
    for rest, some in together.items():
        rows = F.array(*[F.struct(F.lit(m.name).alias("metric"), *m.columns(names)) for m in some])
        made.append(both.groupBy("model", *rest).agg(rows.alias("_rows")).select("model", *rest, F.inline("_rows")).select("model", "metric", *rest, *[F.col(f"`{v}`") for v in names]))
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), made)
