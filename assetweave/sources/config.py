"""Project configuration: a strict JSON file, with overrides from the environment."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path

from ..errors import AssetError
from ..functions import paths

CONFIG_FILE = "assets.json"
INDEX_DIR = ".assetweave"
DTYPES = ("q8", "fp16", "fp32")


@dataclass
class Config:
    roots: list[str] | None = None
    ignore: list[str] = field(default_factory=list)
    respect_gitignore: bool = False
    default_ignores: bool = True
    max_file_size_mb: float = 256
    processors: dict[str, bool] = field(default_factory=lambda: {"image": True, "audio": True, "model3d": True, "video": False, "text": False})
    models: dict[str, str | None] = field(default_factory=lambda: {"visual": "siglip-base", "dtype": None, "audio": "clap-general", "audioDtype": None})
    views: int = 2

    @property
    def enabled(self) -> list[str]:
        return [k for k in ("image", "audio", "model3d") if self.processors[k]]

    @property
    def unavailable(self) -> list[str]:
        """Kinds that may be asked for but have no processor yet."""
        return [k for k in ("video", "text") if self.processors[k]]


def _list_of_text(x: object) -> bool:
    return isinstance(x, list) and all(isinstance(s, str) for s in x)


def _positive(x: object) -> bool:
    return isinstance(x, int | float) and not isinstance(x, bool) and x > 0


#: JSON key -> (attribute, what it must be).
_KEYS = {
    "roots": ("roots", lambda x: _list_of_text(x) and all(x)),
    "ignore": ("ignore", _list_of_text),
    "respectGitignore": ("respect_gitignore", lambda x: isinstance(x, bool)),
    "defaultIgnores": ("default_ignores", lambda x: isinstance(x, bool)),
    "maxFileSizeMb": ("max_file_size_mb", _positive),
}


def parse(document: object) -> Config:
    """Unknown keys and wrong values are errors, all told at once."""
    config, issues = Config(), []
    if not isinstance(document, dict):
        raise AssetError("USAGE_ERROR", f"Invalid {CONFIG_FILE}: it must hold an object")
    for key, value in document.items():
        if key == "$schema":
            continue
        if key in _KEYS:
            name, valid = _KEYS[key]
            issues += [] if valid(value) else [f"{key}: invalid value"]
            setattr(config, name, value)
        elif key == "processors" and isinstance(value, dict):
            issues += [f"processors.{k}: invalid" for k, v in value.items() if k not in config.processors or not isinstance(v, bool)]
            config.processors = {k: bool(value.get(k, v)) for k, v in config.processors.items()}
        elif key == "models" and isinstance(value, dict):
            issues += [f"models.{k}: invalid" for k, v in value.items() if k not in config.models or not isinstance(v, str) or not v or (k.lower().endswith("dtype") and v not in DTYPES)]
            config.models |= {k: v for k, v in value.items() if k in config.models}
        elif key == "model3d" and isinstance(value, dict) and set(value) <= {"views"}:
            issues += [] if value.get("views", 2) in (1, 2, 4) else ["model3d.views: must be 1, 2 or 4"]
            config.views = value.get("views", 2)
        else:
            issues.append(f"{key}: unknown or not an object")
    if issues:
        raise AssetError("USAGE_ERROR", f"Invalid {CONFIG_FILE}: {'; '.join(issues)}", issues=issues)
    return config


def load(project: str | Path, env: Mapping[str, str] = os.environ) -> Config:
    file = Path(project) / CONFIG_FILE
    config = Config()
    if file.exists():
        try:
            config = parse(json.loads(file.read_text("utf-8-sig")))
        except (OSError, ValueError) as e:
            raise AssetError("USAGE_ERROR", f"Cannot read {CONFIG_FILE}: {e}") from e
    for variable, key in (("ASSETWEAVE_VISUAL_MODEL", "visual"), ("ASSETWEAVE_AUDIO_MODEL", "audio"), ("ASSETWEAVE_MODEL_DTYPE", "dtype")):
        if env.get(variable):
            if key == "dtype" and env[variable] not in DTYPES:
                raise AssetError("USAGE_ERROR", f"Invalid {variable}: {env[variable]}")
            config.models[key] = env[variable]
    return config


def find_project(start: str | Path) -> Path:
    """The nearest folder from ``start`` up that has an index or a configuration, else ``start``."""
    here = Path(start).resolve()
    for folder in (here, *here.parents):
        if (folder / INDEX_DIR).is_dir() or (folder / CONFIG_FILE).is_file():
            return folder
    return here


def choose_roots(given: list[str], recorded: list[str], config: Config) -> list[str]:
    """Roots named in a call, else those of earlier runs, else the configuration's, else the project."""
    chosen = given or recorded or config.roots or [""]
    out = []
    for root in chosen:
        logical = paths.normalize_input(root)
        if logical is None:
            raise AssetError("USAGE_ERROR", f"{root} is outside the project")
        out.append(logical)
    return paths.fold_roots(out)
