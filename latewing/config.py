"""Settings, from a YAML file or defaults."""

from __future__ import annotations

import os
import warnings
from dataclasses import asdict, dataclass, fields
from pathlib import Path

from latewing.errors import ConfigError, ConfigWarning


def cache_folder() -> Path:
    """Below XDG_CACHE_HOME, or ~/.cache."""
    return Path(os.environ.get("XDG_CACHE_HOME") or Path.home() / ".cache") / "latewing"


@dataclass(frozen=True)
class Config:
    base_model_id: str = "codebook"
    adapter_id: str | None = None
    visual_prompt: str = "Describe the image."
    embedding_dim: int = 128
    mask_non_image_embeddings: bool = False
    device: str = "auto"
    dtype: str = "float32"
    watch_folder: str = "./documents"
    store: str = ""
    render_dpi: int = 150
    host: str = "127.0.0.1"
    port: int = 8000
    top_k: int = 3
    answer_api_key: str | None = None
    answer_model: str | None = None

    def as_dict(self) -> dict:
        """Everything but the key, of which only whether it is set."""
        out = asdict(self)
        out["answer_api_key_configured"] = bool(out.pop("answer_api_key"))
        return out


def load(path: str | os.PathLike) -> Config:
    """A missing file warns and gives defaults; a broken one, or an empty model id, is an error; a blank key is none."""
    import yaml

    if not Path(path).exists():
        warnings.warn(f"{path} is missing; defaults are used", ConfigWarning, stacklevel=2)
        return Config()
    try:
        found = yaml.safe_load(Path(path).read_text()) or {}
    except yaml.YAMLError as error:
        raise ConfigError(f"{path}: {error}") from error
    if not isinstance(found, dict):
        raise ConfigError(f"{path} holds no settings")
    known = {f.name for f in fields(Config)}
    config = Config(**{k: v for k, v in found.items() if k in known})
    if not str(config.base_model_id or "").strip():
        raise ConfigError("base_model_id is empty")
    if config.answer_api_key is not None and not str(config.answer_api_key).strip():
        config = Config(**(asdict(config) | {"answer_api_key": None}))
    return config
