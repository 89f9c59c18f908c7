"""The engine's commands, as functions that return one document each."""

from __future__ import annotations

import json
import time
import unicodedata
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import AssetError
from ..functions import paths
from ..functions.models import ModelSpec
from ..functions.providers import embed_grouped, provider_for, providers_for
from ..operators import catalog, changes, ranking, search
from ..schemas import SCHEMA_VERSION
from ..sources import audio, config, contact_sheet, discovery, ignore
from ..sources.processors import registry_for
from ..sources.store import Store
from .index import _sibling, run_index

# Bounds of a limit: default, most.
LIMIT, MOST = 10, 1000


class Project:
    """A folder with its configuration, processors, models and store."""

    def __init__(self, spark: SparkSession, folder: str | Path, settings: config.Config | None = None):
        self.spark, self.folder = spark, config.find_project(folder) if settings is None else Path(folder).resolve()
        self.config = settings or config.load(self.folder)
        self.registry = registry_for(self.config)
        self.models: dict[str, ModelSpec] = providers_for(self.config)
        self.rules = ignore.IgnoreRules.of(self.folder, self.config)

    @property
    def index_folder(self) -> Path:
        return self.folder / config.INDEX_DIR

    def store(self) -> Store:
        return Store.open(self.spark, self.index_folder)

    def space(self, kind: str) -> ModelSpec:
        return self.models["audio" if kind == "audio" else "visual"]

    # index

    def index(self, *roots: str, retry_failed: bool = False, **options) -> dict:
        store = Store.create(self.spark, self.index_folder)
        chosen = config.choose_roots(list(roots), store.roots(), self.config)
        for root in chosen:
            if not (self.folder / root).is_dir() and roots:
                raise AssetError("PATH_NOT_FOUND", f"{root} is not a folder")
        stats = run_index(self.spark, self.folder, store, self.registry, self.models, self.rules, roots=chosen, max_bytes=int(self.config.max_file_size_mb * 1048576), retry_failed=retry_failed, **options)
        return stats.document() | {"unavailableProcessors": self.config.unavailable}

    # search

    def query_vector(self, store: Store, spec: ModelSpec, text: str) -> tuple[list[float], bool]:
        """(vector, came from the cache)."""
        key = unicodedata.normalize("NFC", text).strip()
        now = int(time.time() * 1000)
        if (known := store.cached_query(spec.space_id, key, now)) is not None:
            return known, True
        vector = provider_for(spec).embed_texts([key])[0].tolist()
        store.cache_query(spec.space_id, key, vector, now)
        return vector, False

    def logical(self, text: str) -> str:
        """A typed path, relative to the project, or an error when it lies outside."""
        found = paths.to_logical(str(self.folder), text) if text.startswith("/") else paths.normalize_input(text)
        if found is None:
            raise AssetError("USAGE_ERROR", f"{text} is outside the project")
        return found

    def search(self, text: str, *, kind: str | None = None, limit: int = LIMIT, within: str | None = None) -> dict:
        """One kind if asked for or if only one has assets; else kinds are fused."""
        self._bounded(limit)
        if kind is not None and kind not in self.config.enabled:
            raise AssetError("USAGE_ERROR", f'Kind "{kind}" is not enabled')
        store = self.store()
        assets, embeddings = store.table("assets"), store.table("embeddings")
        counts = {r["kind"]: r["n"] for r in catalog.count_by_kind(assets).collect()}
        populated = [k for k in self.config.enabled if counts.get(k)]
        folder = self.logical(within) if within else ""
        if kind or len(populated) <= 1:
            kinds = [kind or (populated or self.config.enabled)[0]]
        else:
            kinds = populated
        began, cached, sources = time.time(), True, []
        for k in kinds:
            if not counts.get(k):
                continue  # its model isn't loaded for nothing
            vector, known = self.query_vector(store, self.space(k), text)
            cached &= known
            sources.append((k, self.space(k).space_id, vector))
        if len(kinds) > 1:
            hits = search.search_across_kinds(assets, embeddings, text, sources, limit=limit, within=folder)
            name = ranking.FUSED_RANKING
        else:
            name = ranking.single_ranking(self.space(kinds[0]).channel)
            if not sources:
                return self._results("search", [], name, 0, kinds, False, began)
            hits = search.search_by_text(assets, embeddings, text, sources[0][2], kind=kinds[0], space_id=sources[0][1], limit=limit, within=folder)
        candidates = search.candidates(assets, embeddings, self.space(kinds[0]).space_id, kinds).count() if len(kinds) == 1 else sum(search.candidates(assets, embeddings, s, [k]).count() for k, s, _ in sources)
        return self._results("search", self._rows(hits, assets), name, candidates, kinds, cached, began)

    def similar(self, reference: str, *, kind: str | None = None, limit: int = LIMIT, within: str | None = None) -> dict:
        """Assets like a file, by its stored vector or, failing that, one made on the spot."""
        self._bounded(limit)
        store = self.store()
        assets, embeddings = store.table("assets"), store.table("embeddings")
        path = self.resolve(store, reference)
        processor = self.registry.for_extension(paths.extension_of(path))
        if processor is None:
            raise AssetError("USAGE_ERROR", f"No processor supports {path}")
        target = kind or processor.kind
        spec = self.models[processor.channels[0]]
        if self.space(target).space_id != spec.space_id:
            raise AssetError("USAGE_ERROR", f"{processor.kind} and {target} do not share an embedding space")
        record = catalog.by_path(assets, path).filter("state = 'indexed'").first()
        stored = catalog.embeddings_of(embeddings, record["content_hash"], spec.space_id).first() if record else None
        began = time.time()
        if stored is not None:
            vector, content = list(stored["vector"]), record["content_hash"]
        else:
            native = self.folder / path
            if not native.is_file():
                raise AssetError("PATH_NOT_FOUND", f"{path} does not exist")
            import hashlib

            data = native.read_bytes()
            content = hashlib.sha256(data).hexdigest()
            done = processor.process(paths.extension_of(path), data, _sibling(str(native)))
            vector = embed_grouped(provider_for(spec), [done.inputs[spec.channel]])[0].tolist()
        hits = search.search_by_vector(assets, embeddings, vector, kind=target, space_id=spec.space_id, limit=limit, within=self.logical(within) if within else "", exclude=path)
        rows = self._rows(hits, assets)
        for r in rows:
            r["duplicate"] = r["contentHash"] == content
        return self._results("similar", rows, spec.channel, search.candidates(assets, embeddings, spec.space_id, [target]).count(), [target], stored is not None, began) | {"reference": path}

    @staticmethod
    def _bounded(limit: int) -> None:
        if not 1 <= limit <= MOST:
            raise AssetError("USAGE_ERROR", f"limit must be from 1 to {MOST}")

    def _rows(self, hits: DataFrame, assets: DataFrame) -> list[dict]:
        shown = search.evidence(hits, F.when(F.col("kind") == "audio", "audio").otherwise("visual"))
        full = catalog.summary(search.with_assets(shown, assets)).orderBy("rank")
        out = []
        for r in full.collect():  # a limit's rows
            evidence = {k: r[k] for k in ("visual", "audio", "lexical", "z", "intent") if k in r and r[k] is not None}
            out.append({"rank": r["rank"], "path": r["path"], "kind": r["kind"], "score": r["score"], "evidence": evidence, "contentHash": r["content_hash"], "metadata": json.loads(r["metadata"] or "{}"), "summary": r["summary"]})
        return out

    def _results(self, command: str, rows: list[dict], name: str, candidates: int, kinds: list[str], cached: bool, began: float) -> dict:
        models = {self.space(k).space_id: {"space": self.space(k).space_id, "model": self.space(k).name, "channel": self.space(k).channel} for k in kinds}
        return {"schemaVersion": SCHEMA_VERSION, "command": command, "ranking": name, "candidates": candidates, "models": list(models.values()), "queryCached": cached, "elapsedMs": int((time.time() - began) * 1000), "results": rows}

    # inspect, status

    def resolve(self, store: Store, text: str) -> str:
        """A typed path: as it is, or the only stored one that is equal up to case and composition."""
        logical = self.logical(text)
        if (self.folder / logical).exists() or catalog.by_path(store.table("assets"), logical).limit(1).count():
            return logical
        near = [r["path"] for r in store.table("assets").filter(paths.same_path(F.col("path"), logical)).select("path").limit(2).collect()]
        if len(near) != 1:
            raise AssetError("PATH_NOT_FOUND", f"{text} does not exist")
        return near[0]

    def inspect(self, text: str) -> dict:
        store = self.store()
        path = self.resolve(store, text)
        native = self.folder / path
        extension = paths.extension_of(path)
        processor = self.registry.for_extension(extension)
        record = catalog.by_path(store.table("assets"), path).first()
        stat = native.stat() if native.is_file() else None
        out = {"schemaVersion": SCHEMA_VERSION, "path": path, "kind": record["kind"] if record else processor.kind if processor else None, "extension": extension, "size": stat.st_size if stat else None, "metadata": {}, "embeddings": [], "previews": [], "error": None, "contentHash": None, "indexedAt": None}
        has_vector = True
        if record:
            version = f"{record['processor_id']}@{record['processor_version']}"
            active = {m.space_id for m in self.models.values()}
            for e in catalog.embeddings_of(store.table("embeddings"), record["content_hash"]).collect():
                out["embeddings"].append({"space": e["space_id"], "dimensions": e["dims"], "current": e["space_id"] in active and e["input_version"] == version})
            has_vector = not (processor and processor.channels) or any(e["current"] for e in out["embeddings"])
            out |= {"contentHash": record["content_hash"], "metadata": json.loads(record["metadata"] or "{}"), "error": record["error"], "indexedAt": time.strftime("%Y-%m-%dT%H:%M:%S", time.gmtime(record["indexed_at"] / 1000)) + f".{record['indexed_at'] % 1000:03d}Z"}
        elif processor and stat:
            try:
                out["metadata"] = processor.metadata(extension, native.read_bytes(), _sibling(str(native)))
            except Exception as e:  # noqa: BLE001
                out["error"] = str(e)
        known = [
            (
                stat is not None,
                processor is not None,
                record is not None,
                bool(record and record["state"] == "failed"),
                bool(record and stat and record["size"] == stat.st_size and record["mtime_ms"] == stat.st_mtime_ns // 1_000_000),
                bool(record and (processor is None or processor.version == record["processor_version"])),
                has_vector,
            )
        ]
        schema = "exists boolean, supported boolean, stored boolean, failed boolean, stat_same boolean, version_same boolean, has_vector boolean"
        out["state"] = changes.inspect_state(self.spark.createDataFrame(known, schema)).first()["state"]
        folder = self.index_folder / "previews" / (out["contentHash"] or "-")
        out["previews"] = sorted(str(p) for p in folder.glob("*.png"))
        return out

    def status(self, *, check: bool = True) -> dict:
        store = self.store()
        assets, embeddings = store.table("assets"), store.table("embeddings")
        spaces = {k: self.space(k).space_id for k in self.config.enabled}
        types = {r["kind"]: r["n"] for r in catalog.count_by_kind(assets).collect()}
        out = {
            "schemaVersion": SCHEMA_VERSION,
            "project": str(self.folder),
            "roots": [r or "." for r in store.roots()],
            "assets": sum(types.values()),
            "types": types,
            "states": {r["state"]: r["n"] for r in catalog.count_by_state(assets).collect()},
            "missingEmbeddings": catalog.total_missing(assets, embeddings, spaces).first()["n"],
            "failed": [r.asDict() for r in catalog.failed_assets(assets).collect()],
            "lastIndexedAt": store.get_meta("lastIndexedAt"),
        }
        if check:
            found = discovery.discover(self.spark, str(self.folder), store.roots() or [""], self.rules, lambda p: self.registry.may_handle(paths.extension_of(p)))
            out["stale"] = changes.staleness(found.files, assets, store.roots() or [""]).first().asDict()
        return out

    # contact sheet, models

    def contact_sheet(self, items: list[str] = (), *, search: str | None = None, kind: str = "image", limit: int = 20, thumb: int | None = None, columns: int | None = None, output: str | None = None) -> dict:
        """Results of a search of one kind first, then the paths; at most 100."""
        if not 1 <= limit <= contact_sheet.MOST_ITEMS:
            raise AssetError("USAGE_ERROR", f"limit must be from 1 to {contact_sheet.MOST_ITEMS}")
        listed = [r["path"] for r in self.search(search, kind=kind, limit=limit)["results"]] if search else []
        listed = list(dict.fromkeys([*listed, *(self.logical(i) for i in items)]))[: contact_sheet.MOST_ITEMS]
        if not listed:
            raise AssetError("USAGE_ERROR", "Nothing to show")
        made = []
        for n, path in enumerate(listed, 1):
            item = contact_sheet.Item(str(n), path.rpartition("/")[2])
            native = self.folder / path
            processor = self.registry.for_extension(paths.extension_of(path))
            try:
                data = native.read_bytes()
                if processor and processor.kind == "audio":
                    item.samples = audio.describe(paths.extension_of(path), data)[1]
                elif processor and processor.kind == "model3d":
                    item.image = processor.process(paths.extension_of(path), data, _sibling(str(native))).previews["preview"]
                else:
                    item.image = data
            except Exception:  # noqa: BLE001  the sheet reports it
                item.image = b""
            made.append(item)
        png, told = contact_sheet.sheet(made, thumb, columns)
        target = Path(output) if output else self.index_folder / "sheets" / contact_sheet.file_name([listed, thumb, columns])
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(png)
        return {"schemaVersion": SCHEMA_VERSION, "output": str(target), "items": [{"label": i.label, "path": p} for i, p in zip(made, listed, strict=True)], **told}

    def model_status(self) -> dict:
        out = []
        for spec in self.models.values():
            try:
                ready = provider_for(spec).is_cached()
            except AssetError:
                ready = False
            out.append({"channel": spec.channel, "model": spec.name, "space": spec.space_id, "available": ready})
        return {"schemaVersion": SCHEMA_VERSION, "models": out}
