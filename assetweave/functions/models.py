"""Names of embedding models, and the spaces they make."""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..errors import AssetError

# Name -> family, repository, weights, dimensions.
VISUAL = {
    "siglip-base": ("siglip", "Xenova/siglip-base-patch16-224", "q8", 768),
    "siglip-large": ("siglip", "Xenova/siglip-large-patch16-256", "q8", 1024),
    "clip-vit-b32": ("clip", "Xenova/clip-vit-base-patch32", "q8", 512),
    "test-hash": ("test-hash", "none", "fp32", 64),
}
AUDIO = {
    "clap-general": ("clap", "Xenova/larger_clap_general", "q8", 512),
    "clap-htsat-unfused": ("clap", "Xenova/clap-htsat-unfused", "q8", 512),
    "test-audio": ("test-audio", "none", "fp32", 16),
}
_FAMILIES = {"visual": "siglip|clip", "audio": "clap"}


@dataclass(frozen=True)
class ModelSpec:
    channel: str
    name: str
    family: str
    repository: str
    dtype: str
    dimensions: int | None
    revision: int = 1

    @property
    def space_id(self) -> str:
        return f"{self.family}:{self.repository}:{self.dtype}:r{self.revision}"


def resolve(channel: str, name: str, dtype: str | None = None) -> ModelSpec:
    """A preset, or a repository of a known family as "family:owner/name"."""
    presets = {"visual": VISUAL, "audio": AUDIO}[channel]
    if name in presets:
        family, repository, weights, dimensions = presets[name]
        return ModelSpec(channel, name, family, repository, dtype or weights, dimensions)
    if custom := re.fullmatch(rf"({_FAMILIES[channel]}):([\w.-]+/[\w.-]+)", name):
        return ModelSpec(channel, custom[2], custom[1], custom[2], dtype or "q8", None)
    raise AssetError("USAGE_ERROR", f'Unknown {channel} model "{name}". Use one of {", ".join(presets)} or "{_FAMILIES[channel].split("|")[0]}:<owner>/<name>".')
