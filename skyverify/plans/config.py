"""Configuration of a pipeline: a YAML file or a dict."""

from __future__ import annotations

import copy
from typing import Any

import yaml

from ..functions.dates import Dates

_DATES = ("start", "end", "period", "range", "step")


class Config:
    """Sections dates, datasets, transformations, alignment and verification.

    A dataset's ``dates`` override the global ones key by key, and its file template is filled in for
    every run.
    """

    def __init__(self, source: str | dict):
        if isinstance(source, str):
            with open(source, encoding="utf-8") as f:
                self.raw: dict[str, Any] = yaml.safe_load(f) or {}
        elif isinstance(source, dict):
            self.raw = copy.deepcopy(source)
        else:
            raise TypeError(f"a path or a dict, not {type(source).__name__}")
        if "datasets" not in self.raw:
            raise ValueError("the section datasets is missing")
        shared = self.raw.get("dates") or {}
        for name, spec in self.raw["datasets"].items():
            own = {**shared, **(spec.pop("dates", None) or {})}
            files = spec.get("files")
            if isinstance(files, str):
                spec["files"] = [files]
            if own and isinstance(files, str):
                if missing := [k for k in _DATES if k not in own]:
                    raise ValueError(f"dates of {name} lack {', '.join(missing)}")
                spec["files"] = Dates(**{k: own[k] for k in _DATES}).substitute(files)

    def __getitem__(self, section: str) -> Any:
        found = self.raw.get(section)
        return copy.copy(found) if found is not None else None

    def __call__(self) -> dict[str, Any]:
        return self.raw
