"""Saving and loading fitted pipelines under names derived from the category hierarchy."""

from __future__ import annotations

from urllib.parse import quote

from pyspark.ml import PipelineModel, Transformer

PREPROCESS = "preProcess"  # fixed value: the name of the shared preprocessing pipeline


def model_name(level: str, parent: str | None = None) -> str:
    """``cat_0`` for the root, ``<parent>-cat_1`` and ``<parent>-cat_2`` below it."""
    return f"{parent}-{level}" if parent else level


def _path(root: str, name: str) -> str:
    """The model's folder; names that differ have folders that differ."""
    return f"{root.rstrip('/')}/{quote(name.strip(), safe=' ')}"


def assemble(*stages: Transformer) -> PipelineModel:
    """Fitted stages as one prediction pipeline."""
    return PipelineModel(stages=list(stages))


def save_model(root: str, name: str, *stages: Transformer, overwrite: bool = True) -> str:
    """Save fitted stages as one pipeline; returns its path."""
    writer = assemble(*stages).write()
    path = _path(root, name)
    (writer.overwrite() if overwrite else writer).save(path)
    return path


def load_model(root: str, name: str) -> PipelineModel:
    return PipelineModel.load(_path(root, name))
