"""Datasets and transcribers by name, to which a user's own can be added."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from ..operators.transcribe import Server, Transcriber
from .corpus import read_corpus
from .manifest import read_manifest
from .matrix import DEFAULT_ROUTE, ROUTES, canonical_dataset

#: A manifest that is read under a name of its own: its name, its reference's name and its usual place (fixed values).
PRESET, PRESET_REFERENCE, PRESET_PLACE = "ksof", "ref", "manifests/ksof-manifest.jsonl"


def read_preset(spark: SparkSession, path: str | None = None, **params: object) -> DataFrame:
    """The preset manifest, at its usual place unless another is given; its name and reference are fixed."""
    return read_manifest(spark, path or PRESET_PLACE, dataset=PRESET, ref_name=PRESET_REFERENCE, **params)


DATASETS: dict[str, Callable[..., DataFrame]] = {"bas_rvg1": read_corpus, PRESET: read_preset, "manifest": read_manifest}


def add_dataset(name: str, read: Callable[..., DataFrame]) -> None:
    DATASETS[name.lower().replace("-", "_")] = read


def open_dataset(spark: SparkSession, name: str, **params: object) -> DataFrame:
    """The samples of a dataset by its name, whatever its case and dashes; an unknown one raises with those there are."""
    return DATASETS[canonical_dataset(name, dict.fromkeys(DATASETS, "") | {k: k for k in DATASETS})](spark, **params)


#: Makes a transcriber for (model, language, batch size).
Make = Callable[[str, str, int], Transcriber]
TRANSCRIBERS: dict[str, Make] = {"http": lambda model, language, batch_size: Server(model, language, batch_size=batch_size)}


def add_transcriber(backend: str, make: Make) -> None:
    TRANSCRIBERS[backend] = make


def backend_of(model: str) -> str:
    """The back end for one model's name; ``matrix.route`` is the same for a column."""
    name = model.lower()
    if name.startswith(("http://", "https://")):
        return "http"
    return next((backend for backend, ways in ROUTES if any(all(part in name for part in way) for way in ways)), DEFAULT_ROUTE)


def maker(model: str, language: str, batch_size: int = 1) -> Callable[[], Transcriber]:
    """What ``transcribe`` takes to make a model's transcriber in its workers; a back end that nobody added raises."""
    backend = backend_of(model)
    if backend not in TRANSCRIBERS:
        raise KeyError(f"no transcriber for {backend}; there are {', '.join(sorted(TRANSCRIBERS))}")
    return partial(TRANSCRIBERS[backend], model, language, batch_size)
