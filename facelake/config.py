"""Engine settings: immutable, passed explicitly, never a process-wide state."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, replace


@dataclass(frozen=True)
class ModelSpec:
    """A registered embedding model: where its rows and its weights are."""

    name: str
    collection: str
    weights: str | None = None


@dataclass(frozen=True)
class EngineConfig:
    models: tuple[ModelSpec, ...] = ()
    fallback_collection: str = "face_embeddings"
    base_dim: int = 512
    use_tta: bool = True
    face_detection: bool = True
    confidence: float = 0.35
    select_largest: bool = True
    image_size: int = 112
    max_upload_bytes: int = 50 << 20
    extensions: tuple[str, ...] = ("png", "jpg", "jpeg", "bmp", "tiff")

    @property
    def dim(self) -> int:
        """Length of a stored vector: the flipped image adds as much again."""
        return self.base_dim * (2 if self.use_tta else 1)

    def model(self, name: str) -> ModelSpec:
        for spec in self.models:
            if spec.name == name:
                return spec
        raise KeyError(f"unknown model {name!r}")

    def collection(self, name: str) -> str:
        """The collection of a model, the fallback for any other name."""
        return next((m.collection for m in self.models if m.name == name), self.fallback_collection)

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None, **given) -> EngineConfig:
        """Settings with what the environment overrides."""
        env = os.environ if env is None else env

        def flag(key: str) -> bool:
            return env[key].lower() == "true"

        read = {
            "FACE_DETECTION_ENABLED": ("face_detection", flag),
            "FACE_DETECTION_SELECT_LARGEST": ("select_largest", flag),
            "FACE_DETECTION_CONF_THRESHOLD": ("confidence", lambda k: float(env[k])),
            "USE_TTA": ("use_tta", flag),
            "EMBEDDING_DIM": ("base_dim", lambda k: int(env[k])),
        }
        found = {name: get(key) for key, (name, get) in read.items() if key in env}
        config = replace(cls(**given), **{k: v for k, v in found.items() if k != "base_dim"})
        if "base_dim" in found:  # the variable names the stored length
            config = replace(config, base_dim=found["base_dim"] // (2 if config.use_tta else 1))
        return config
