"""Loaders of datasets and writers of results."""

from .loaders import available_loaders, get_loader, load, register_loader
from .sinks import dataset_path, modal_date, save_dataset, save_metrics, save_sets

__all__ = ["available_loaders", "dataset_path", "get_loader", "load", "modal_date", "register_loader", "save_dataset", "save_metrics", "save_sets"]
