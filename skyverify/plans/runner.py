"""Load, transform, align and verify, as a configuration says."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession

from ..model import Dataset
from ..operators import align_time, broadcast_nulls, transform
from ..operators.space_alignment import align_pair
from ..operators.verify import stacked_metrics
from ..sources import load, save_metrics, save_sets
from ..sources.loaders import existing
from .config import Config

log = logging.getLogger(__name__)


def spatial_options(ds: Dataset, reference: Dataset, options: dict) -> dict | None:
    """The part of the options that fits: interpolation to points, regridding between grids."""
    if reference.is_point() and ds.is_grid():
        return options.get("interpolation") or {}
    if reference.is_grid() and ds.is_grid():
        return options.get("regrid") or {}
    return None


class Runner:
    """The steps of a pipeline; ``run`` takes them in order.  Everything is lazy until metrics are read or saved."""

    def __init__(self, config: Config | str | dict, spark: SparkSession | None = None):
        self.config = config if isinstance(config, Config) else Config(config)
        self.spark = spark or SparkSession.builder.getOrCreate()
        self.datasets: dict[str, Dataset] = {}
        self.metrics: DataFrame | None = None

    def run(self) -> DataFrame | None:
        self.load_datasets()
        self.transform_datasets()
        self.align()
        return self.verify()

    def load_datasets(self) -> dict[str, Dataset]:
        if not self.config["datasets"]:
            raise ValueError("no datasets")
        for name, spec in self.config["datasets"].items():
            options = dict(spec)
            loader, files = options.pop("loader"), options.pop("files")
            there = existing(self.spark, files)
            for path in [p for p in dict.fromkeys(files) if p not in there]:
                log.warning("%s: %s isn't there and is left out", name, path)
            if not there:
                raise FileNotFoundError(f"{name}: none of {len(files)} files is there")
            self.datasets[name] = load(self.spark, loader, there, options.pop("variables", None), options.pop("grid_mapping", None), **options)
        return self.datasets

    def transform_datasets(self) -> None:
        steps = self.config["transformations"] or {}
        pairs = [next(iter(s.items())) for s in steps] if isinstance(steps, list) else list(steps.items())
        for name, spec in pairs:
            options = dict(spec or {})
            for d in options.pop("datasets", None) or list(self.datasets):
                self.datasets[d] = transform(name, self.datasets[d], **options)

    def align(self) -> None:
        spec = self.config["alignment"]
        if not spec:
            log.info("no alignment is configured")
            return
        self.align_time(spec.get("time"))
        self.align_space(spec.get("reference"), spec.get("space"))
        if spec.get("broadcast_nans", True):
            self.datasets = broadcast_nulls(self.datasets)
        if save := spec.get("save"):
            save_sets(self.datasets, **save)

    def align_time(self, options: dict | None) -> None:
        if options is None:
            log.info("no alignment in time is configured")
            return
        self.datasets = dict(zip(self.datasets, align_time(self.datasets, **options), strict=True))

    def align_space(self, reference: str | None, options: dict | None) -> None:
        if options is None or reference is None:
            log.info("no alignment in space is configured")
            return
        ref = self.datasets[reference]
        for name, d in self.datasets.items():
            if name != reference:
                self.datasets[name] = align_pair(d, ref, **(spatial_options(d, ref, options) or {}))[0]

    def verify(self) -> DataFrame | None:
        spec = self.config["verification"]
        if not spec:
            log.info("no verification is configured")
            return None
        self.metrics = stacked_metrics(self.datasets, spec["reference"], spec.get("metrics") or {})
        if save := spec.get("save"):
            save_metrics(save["method"], self.metrics, **{k: v for k, v in save.items() if k != "method"})
        return self.metrics
