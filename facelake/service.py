"""Endpoint-shaped functions over DataFrame pipelines: each returns a plain dictionary and never raises for a bad request.

Uploads are (name, bytes) pairs. They are staged to the folder that driver and executors share, so that a
request of many files is one job, and removed when it is answered. `handle` answers any route, as JSON.
"""

from __future__ import annotations

import json
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facelake.config import EngineConfig
from facelake.functions.layers import REGISTRY
from facelake.functions.strings import safe_name
from facelake.operators.collections import Collection
from facelake.operators.embed import embed
from facelake.session import remove, scratch, ship
from facelake.sources.images import read_images

Upload = tuple[str, bytes]
#: What is said of a status that no route has answered itself.
ERRORS = {404: "no such endpoint", 413: "upload too large", 422: "the image cannot be processed", 500: "internal error"}
ROUTES = ("health", "models", "face_detection_status", "embedding", "embeddings_batch", "insert", "search", "stats")


class Service:
    def __init__(self, spark: SparkSession, config: EngineConfig, weights: dict[str, str] | None = None, detector=None):
        """detector: a function of the images DataFrame that adds `faces`."""
        ship(spark)
        self.spark, self.config, self.weights, self.detector = spark, config, weights or {}, detector

    def handle(self, route: str, *args, **named) -> str:
        """The answer of a route as JSON, of any error as well."""
        if route not in ROUTES:
            return json.dumps({"status": 404, "error": ERRORS[404]})
        try:
            answer = getattr(self, route)(*args, **named)
        except Exception as error:
            answer = {"status": 500, "error": ERRORS[500], "message": str(error)[:500]}
        return json.dumps(answer, default=str)

    def _collection(self, model: str) -> Collection:
        return Collection(self.spark, self.config.collection(model), self.config.dim)

    def _refusal(self, files: list[Upload], model: str) -> dict | None:
        """The 400 answer to a request that cannot be served."""
        if not files or not any(name for name, _ in files):
            return {"status": 400, "error": "no image given"}
        if sum(len(data) for _, data in files) > self.config.max_upload_bytes:
            return {"status": 413, "error": ERRORS[413], "max_size_mb": self.config.max_upload_bytes / (1 << 20)}
        if model not in {m.name for m in self.config.models}:
            return {"status": 400, "error": f"unknown model {model!r}"}
        return None

    def _allowed(self, name: str) -> bool:
        return "." in name and name.rpartition(".")[2].lower() in self.config.extensions

    def _embedded(self, files: list[Upload], model: str, given: bool = False) -> list[dict]:
        """filename, status and embedding of each file, in order; given: whether the name as it was given tells the
        extension, or else the safe one."""
        from pyarrow import fs

        kinds = [(name if given else safe_name(name or "")) or "" for name, _ in files]
        files = [(safe_name(name or ""), data) for name, data in files]
        folder = scratch(self.spark, "uploads")
        filesystem, base = fs.FileSystem.from_uri(folder if ":" in folder else Path(folder).absolute().as_uri())
        filesystem.create_dir(base, recursive=True)
        for i, (kind, (_, data)) in enumerate(zip(kinds, files, strict=True)):
            if self._allowed(kind):
                with filesystem.open_output_stream(f"{base}/{i:06d}.{kind.rpartition('.')[2].lower()}") as out:
                    out.write(data)
        images: DataFrame = read_images(self.spark, folder)
        if self.detector and self.config.face_detection:
            images = self.detector(images)
        try:
            done = embed(images, model, self.config, self.weights.get(model, ""))
            found = {int(Path(r["path"]).stem): r for r in done.select("path", "status", "embedding").collect()}  # a request's files
        finally:
            remove(self.spark, folder)
        return [
            {"filename": name, "status": found[i]["status"], "embedding": found[i]["embedding"]}
            if i in found
            else {"filename": name, "status": "extension not allowed", "embedding": None}
            for i, (name, _) in enumerate(files)
        ]

    def health(self) -> dict:
        names = [m.name for m in self.config.models]
        reachable = bool(names) and self.spark.catalog.tableExists(self.config.collection(names[0]))
        now = datetime.now(UTC).isoformat()
        return {"status": "healthy", "timestamp": now, "models": names, "collection_reachable": reachable, "use_tta": self.config.use_tta, "face_detection": self.config.face_detection}

    def models(self) -> dict:
        listed = [
            {"name": m.name, "collection": m.collection, "embedding_dim": self.config.dim, "weights": m.weights, "weights_exist": bool(m.weights) and Path(m.weights).exists(), "loaded": REGISTRY.is_loaded(m.name, self.weights.get(m.name, ""))}
            for m in self.config.models
        ]
        return {"models": listed}

    def face_detection_status(self) -> dict:
        c = self.config
        return {"enabled": c.face_detection, "available": self.detector is not None, "confidence": c.confidence, "select_largest": c.select_largest}

    def embedding(self, file: Upload | None, model: str) -> dict:
        if refused := self._refusal([file] if file else [], model):
            return refused
        if not self._allowed(file[0]):
            return {"status": 400, "error": "extension not allowed"}
        row = self._embedded([file], model, given=True)[0]
        if row["status"] != "ok":
            return {"status": 422, "error": ERRORS[422], "message": row["status"]} if row["status"] == "no_face" else {"status": 500, "error": row["status"]}
        return {"status": 200, "success": True, "embedding": row["embedding"], "embedding_dim": len(row["embedding"]), "model": model, "filename": row["filename"]}

    def embeddings_batch(self, files: list[Upload], model: str) -> dict:
        if refused := self._refusal(files, model):
            return refused
        rows = self._embedded(files, model)
        ok = sum(r["status"] == "ok" for r in rows)
        results = [{"filename": r["filename"], "success": r["status"] == "ok", "embedding": r["embedding"], "error": None if r["status"] == "ok" else r["status"]} for r in rows]
        return {"status": 200, "total": len(rows), "successful": ok, "failed": len(rows) - ok, "no_face_detected": sum(r["status"] == "no_face" for r in rows), "results": results}

    def insert(self, files: list[Upload], model: str, person_id: str | None, image_paths: str | None = None) -> dict:
        if refused := self._refusal(files, model):
            return refused
        if not person_id:
            return {"status": 400, "error": "person_id is missing"}
        try:
            paths = json.loads(image_paths) if image_paths else []
        except ValueError:
            return {"status": 400, "error": "image_paths is not JSON"}
        rows = self._embedded(files, model)
        good = [(r["embedding"], person_id, paths[i] if i < len(paths) else r["filename"]) for i, r in enumerate(rows) if r["status"] == "ok"]
        new = self.spark.createDataFrame(good, "embedding array<float>, person_id string, image_path string")
        n = self._collection(model).insert(new) if good else 0
        errors = [f"{r['filename']}: {r['status']}" for r in rows if r["status"] != "ok"]
        out = {"status": 200, "success": True, "inserted_count": n, "person_id": person_id, "collection": self.config.collection(model)}
        return out | ({"errors": errors, "no_face_count": sum(r["status"] == "no_face" for r in rows)} if errors else {})

    def search(self, file: Upload | None, model: str, top_k: str | int = 5) -> dict:
        try:
            k = int(top_k)
        except ValueError:
            return {"status": 400, "error": "top_k is not a number"}
        if k < 1:
            return {"status": 400, "error": "top_k must be positive"}
        query = self.embedding(file, model)
        if query["status"] != 200:
            return query
        hits = self._collection(model).search(query["embedding"], k).collect()
        return {"status": 200, "success": True, "results": [h.asDict() for h in hits], "total": len(hits), "model": model}

    def stats(self) -> dict:
        found = {}
        for m in self.config.models:
            try:
                found[m.name] = self._collection(m.name).stats()
            except Exception as error:  # one broken collection does not hide the others
                found[m.name] = {"error": str(error)}
        return {"status": 200, "collections": found}


def matching_files(hits: DataFrame, files: DataFrame) -> DataFrame:
    """Hits with the listed file of their path, null where it is gone."""
    return hits.join(files.select(F.col("path").alias("image_path"), "length"), "image_path", "left")
