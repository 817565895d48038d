"""Fitted pipelines on disk, one folder per variant."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel


@dataclass(frozen=True)
class Variant:
    """What was fitted: task, model kind, feature set and whether high saturations were left out."""

    task: str
    model: str
    seven_features: bool = False
    filter_spo2: bool = False

    def path(self, root: str) -> str:
        subset = "filtered" if self.filter_spo2 else "whole"
        return f"{root.rstrip('/')}/{self.task}/{subset}/{self.model}/{7 if self.seven_features else 3}f"


def save_model(model: PipelineModel, root: str, variant: Variant) -> str:
    path = variant.path(root)
    model.write().overwrite().save(path)
    return path


def load_model(root: str, variant: Variant) -> PipelineModel:
    return PipelineModel.load(variant.path(root))
