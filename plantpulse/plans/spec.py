"""Layer specification read from YAML."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import yaml

from ..columns import RUN, TIMESTAMP
from ..sources.readings import run_files


@dataclass(frozen=True)
class Condition:
    column: str
    operator: str
    value: Any


@dataclass(frozen=True)
class LayerSpec:
    """One model layer: what to read, how to make features and split, what to train, where to write."""

    name: str
    target: str
    classes: tuple[str, ...]
    normal_paths: tuple[str, ...]
    abnormal_paths: tuple[str, ...]
    output_dir: str
    model_path: str
    metrics_path: str
    predictions_path: str | None = None
    hyperparameters: dict[str, Any] = field(default_factory=dict)
    condition: Condition | None = None
    window: str = "10min"
    extract: bool = True
    time: str = TIMESTAMP
    exclude: tuple[str, ...] = (RUN,)
    by_time: bool = False
    stratified: bool = False
    test_size: float = 0.2
    validation_size: float | None = None
    seed: int = 42
    frequency: str = "1min"
    method: str = "mean"
    labels: bool = True

    @classmethod
    def from_mapping(cls, raw: dict[str, Any]) -> LayerSpec:
        """From the layered layout of the YAML files (a ``model`` section with its parts)."""
        model = raw["model"]
        target, features, data, output = (model[part] for part in ("target", "features", "dataset", "output"))
        condition = model.get("data_filter")
        folder = data.get("datasets_dir", "datasets/datasets_renamed")
        abnormal = [*(data.get("failure_files") or []), *(data.get("warning_files") or [])]
        return cls(
            name=model["name"],
            target=target["column"],
            classes=tuple(target["classes"]),
            normal_paths=tuple(run_files(folder, data.get("normal_files"))),
            abnormal_paths=tuple(run_files(folder, abnormal)),
            output_dir=data.get("output_dir", "datasets/processed_data").replace("\\", "/"),
            model_path=output["model_path"],
            metrics_path=output["metrics_path"],
            predictions_path=output.get("predictions_path"),
            hyperparameters=dict(model.get("hyperparameters") or {}),
            condition=Condition(**condition) if condition else None,
            window=features["window_size"],
            extract=features["extract_features"],
            time=features.get("timestamp_col", TIMESTAMP),
            exclude=tuple(features.get("exclude_cols") or (RUN,)),
            by_time=data["use_timeseries_split"],
            stratified=data["use_stratification"],
            test_size=data["test_size"],
            validation_size=data["validation_size"],
            seed=data["random_state"],
            frequency=data["resample_freq"],
            method=data["resample_method"],
            labels=data.get("add_hierarchical_labels", True),
        )

    @classmethod
    def from_yaml(cls, path: str) -> LayerSpec:
        return cls.from_mapping(yaml.safe_load(Path(path).read_text(encoding="utf-8")))
