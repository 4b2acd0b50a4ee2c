"""Command line: python -m facelake.cli ingest|search|stats."""

from __future__ import annotations

import argparse
from dataclasses import replace

from facelake.config import EngineConfig, ModelSpec
from facelake.operators.collections import Collection
from facelake.session import session, ship


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="facelake")
    p.add_argument("command", choices=("ingest", "search", "stats"))
    p.add_argument("--model", default="seeded_projection")
    p.add_argument("--weights", default="")
    p.add_argument("--collection", default="face_embeddings")
    p.add_argument("--dir", help="folder of images, or for search one image's folder")
    p.add_argument("--limit", type=int, default=0, help="most images; 0: all")
    p.add_argument("--top-k", type=int, default=5)
    p.add_argument("--recreate", action="store_true")
    p.add_argument("--no-tta", action="store_true")
    p.add_argument("--batch-size", type=int, default=50, help="images that go through the network at once")
    p.add_argument("--no-face-detection", action="store_true")
    p.add_argument("--skip-no-face", action="store_true", help="kept for scripts that give it: images without a face are left out in any case")
    p.add_argument("--embed-faceless", action="store_true", help="embed images without a face whole")
    p.add_argument("--face-conf", type=float, default=0.35)
    p.add_argument("--select-largest", action=argparse.BooleanOptionalAction, default=True, help="the largest face, else the most confident")
    return p


def config_of(a: argparse.Namespace) -> EngineConfig:
    return EngineConfig(
        models=(ModelSpec(a.model, a.collection, a.weights or None),), use_tta=not a.no_tta, face_detection=not a.no_face_detection,
        confidence=a.face_conf, select_largest=a.select_largest,
    )


def embedded(spark, a: argparse.Namespace, config: EngineConfig, detector=None):
    """The images of --dir, of which no more than --limit are decoded, with their embeddings."""
    from pyspark.sql import functions as F

    from facelake.operators.embed import embed
    from facelake.sources.images import list_images, read_images

    # --limit paths at most
    images = read_images(spark, [r.path for r in list_images(spark, a.dir, a.limit).select("path").collect()] if a.limit else a.dir)
    if not detector or not config.face_detection:
        return embed(images, a.model, config, a.weights, a.batch_size)
    images = detector(images)
    done = embed(images, a.model, config, a.weights, a.batch_size)
    if a.skip_no_face or not a.embed_faceless:
        return done
    # without a face the whole image is what is embedded
    faceless = images.join(done.where("status = 'no_face'").select("path"), "path", "left_semi").withColumn("faces", F.lit(None).cast(images.schema["faces"].dataType))
    whole = embed(faceless, a.model, replace(config, face_detection=False), a.weights, a.batch_size)
    return done.where("status <> 'no_face'").unionByName(whole)


def main(argv: list[str] | None = None, detector=None) -> int:
    from facelake.streaming.ingest import named

    a = parser().parse_args(argv)
    spark = session("facelake-cli")
    ship(spark)
    config = config_of(a)
    collection = Collection(spark, a.collection, config.dim)
    if a.command == "stats":
        print(collection.stats())
        return 0
    done = embedded(spark, a, config, detector)
    if a.command == "ingest":
        if a.recreate:
            collection.recreate()
        print(f"{collection.insert(named(done, a.dir))} rows inserted")
        return 0
    for row in done.where("status = 'ok'").select("path", "embedding").toLocalIterator():
        print(row["path"])
        collection.search(row["embedding"], a.top_k).show(truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
