"""Processors: from a file's bytes to metadata, embedding inputs and previews."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Protocol

from . import audio, images, render, scene


@dataclass
class Processed:
    metadata: dict
    inputs: dict[str, list] = field(default_factory=dict)  # channel -> views or windows
    previews: dict[str, bytes] = field(default_factory=dict)
    description: str | None = None
    tags: list[str] | None = None


class Processor(Protocol):
    id: str
    version: str
    kind: str
    channels: Sequence[str]
    extensions: Sequence[str]

    def metadata(self, extension: str, data: bytes, sibling: Callable[[str], bytes | None]) -> dict: ...

    def process(self, extension: str, data: bytes, sibling: Callable[[str], bytes | None]) -> Processed: ...


#: Image formats that have no decoder here but that Spark's image source reads in the JVM.
JVM_IMAGES = ("jpg", "jpeg", "tif", "tiff")


class ImageProcessor:
    id, version, kind, channels, extensions = "image", "1", "image", ("visual",), images.EXTENSIONS

    def metadata(self, extension, data, sibling) -> dict:
        return images.describe(images.decode(data))

    def process(self, extension, data, sibling) -> Processed:
        return self.of(images.decode(data))

    @staticmethod
    def of(image: images.Image) -> Processed:
        return Processed(images.describe(image), {"visual": [images.for_embedding(image)]})


class AudioProcessor:
    id, version, kind, channels, extensions = "audio", "1", "audio", ("audio",), audio.EXTENSIONS

    def metadata(self, extension, data, sibling) -> dict:
        return audio.describe(extension, data)[0]

    def process(self, extension, data, sibling) -> Processed:
        metadata, mono, rate = audio.describe(extension, data)
        return Processed(metadata, {"audio": [(mono, rate)]})


class ModelProcessor:
    id, kind, channels, extensions = "model3d", "model3d", ("visual",), scene.EXTENSIONS

    def __init__(self, views: int = 2):
        self.views = render.VIEW_SETS[views]
        #: The views are part of it: other views mean other vectors.
        self.version = "2+" + ",".join(v.name for v in self.views)

    def metadata(self, extension, data, sibling) -> dict:
        return scene.describe(scene.load(extension, data, sibling))

    def process(self, extension, data, sibling) -> Processed:
        loaded = scene.load(extension, data, sibling)
        if not loaded.triangle_count:
            raise ValueError("Model has no triangles to render")
        shown = [render.render(loaded, v) for v in self.views]
        return Processed(scene.describe(loaded), {"visual": shown}, {"preview": images.encode_png(shown[0])})


class Registry:
    """Processors in order; the first that takes an extension handles the file."""

    def __init__(self, processors: Sequence[Processor] = ()):
        self.processors: list[Processor] = []
        for p in processors:
            self.register(p)

    def register(self, processor: Processor) -> Registry:
        if self.by_id(processor.id):
            raise ValueError(f'Processor "{processor.id}" is already registered')
        self.processors.append(processor)
        return self

    def by_id(self, name: str) -> Processor | None:
        return next((p for p in self.processors if p.id == name), None)

    def for_extension(self, extension: str) -> Processor | None:
        return next((p for p in self.processors if extension in p.extensions), None)

    def may_handle(self, extension: str) -> bool:
        return self.for_extension(extension) is not None

    def rows(self) -> list[tuple[str, str, str, str]]:
        """(extension, processor_id, processor_version, kind): one row an extension, to join a listing with."""
        seen: dict[str, tuple] = {}
        for p in self.processors:
            for e in p.extensions:
                seen.setdefault(e, (e, p.id, p.version, p.kind))
        return list(seen.values())


def registry_for(config) -> Registry:
    made = {"image": ImageProcessor, "audio": AudioProcessor, "model3d": lambda: ModelProcessor(config.views)}
    return Registry([made[kind]() for kind in config.enabled])
