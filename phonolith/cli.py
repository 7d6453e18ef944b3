"""Command line: doctor, scan, process, verify, calibrate. Ends with 0, 1 for errors, 2 for a failed verify, 130 when interrupted."""

from __future__ import annotations

import argparse
import importlib.util
import shutil
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .errors import LibraryError
from .functions import naming, text
from .operators import catalog
from .plans import process as plans
from .plans.process import Settings
from .sources import collection, logs, scratch


def _spark() -> SparkSession:
    spark = SparkSession.builder.appName("phonolith").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def doctor(_: argparse.Namespace) -> int:
    """What is installed; nothing here is needed for the catalog part."""
    for name, there in [(m, importlib.util.find_spec(m) is not None) for m in ("pyspark", "numpy", "pandas", "pyarrow")] + [
        (p, shutil.which(p) is not None) for p in ("java", "ffmpeg", "ffprobe", "MP4Box")
    ]:
        print(f"{name}: {'yes' if there else 'no'}")
    return 0


def scan(a: argparse.Namespace) -> int:
    spark = _spark()
    settings = Settings(a.music_dir, "", collection=a.collection, library_root=a.library_root, library_app=a.library_app).located(spark)
    tracks = scratch.written(plans.scanned(spark, settings), "scan")
    shown = tracks.orderBy(text.path_order(F.col("path")))
    for row in catalog.listing(shown.limit(a.limit) if a.limit else shown).toLocalIterator():
        print(row[0])
    print(f"total: {tracks.count()}")
    return 0


def process(a: argparse.Namespace) -> int:
    names = Settings.__dataclass_fields__
    settings = Settings(**{k: v for k, v in vars(a).items() if k in names})
    failed = 0
    for row in plans.process(_spark(), settings).orderBy(text.path_order(F.col("path"))).toLocalIterator():
        print(f"{row['status']}\t{row['path']}\t{row['output'] or ''}\t{row['message'] or ''}")
        failed += row["status"] == "error"
    return 1 if failed and not settings.continue_on_error else 0


def verify(a: argparse.Namespace) -> int:
    """Checks a container's boxes, or the PCM stand-in's streams."""
    from .functions import mp4

    with open(a.path, "rb") as f:
        data = f.read()
    if data[:4] == b"RIFF":
        ok = plans._ready(a.path)
        print("5 audio streams" if ok else "expected 5 audio streams")
        return 0 if ok else 2
    found = list(mp4.boxes(data))
    tracks = sum(kind == "trak" for _, _, kind, _, _ in found)
    if tracks != 5:
        print(f"expected 5 audio streams, found {tracks}")
        return 2
    if b'"version":2' in data and any(kind == "stem" for _, _, kind, _, _ in found):
        print("5 audio streams, native metadata v2")
    else:
        print("5 audio streams; warning: missing native metadata")
    return 0


def calibrate(a: argparse.Namespace) -> int:
    spark = _spark()
    where = Settings("", a.output_dir, collection=a.collection, log=a.log, library_root=a.library_root, library_app=a.library_app).located(spark)
    if not where.collection:
        raise LibraryError("collection not found")
    index = catalog.collection_index(collection.read_ordered(spark, where.collection))
    track = catalog.single_track(a.audio, index).where(text.full(F.col("audio_id")).isNotNull())
    log = logs.entries(logs.lines(spark, where.log)) if where.log else spark.createDataFrame([], "line_no bigint, title string, path string, offset string")
    words = naming.hash_words(F.col("audio_id"))
    row = (
        track.join(catalog.latest_logged(log, a.output_dir), "title", "left")
        .withColumn("words", words)
        .select("logged_path", naming.native_path(a.output_dir, F.col("words")).alias("path"), naming.file_name(F.col("words")).alias("name"))
        .first()
    )
    if row is None or row["name"] is None:
        raise LibraryError("track not found in the collection, or without a usable audio id")
    if row["logged_path"]:
        print(f"logged-native-path\t{row['logged_path']}")
    print(f"computed-native-path\t{row['path']}")
    existing = (a.stem_file or "").rsplit("/", 1)[-1]
    print(f"{naming.ALGORITHM}\t{row['name']}" + (f"\t{'match' if existing == row['name'] else 'no'}" if existing else ""))
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="phonolith", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    commands.add_parser("doctor").set_defaults(run=doctor)
    p = commands.add_parser("scan")
    p.add_argument("--music-dir", required=True)
    p.add_argument("--collection")
    p.add_argument("--limit", type=int, default=0)
    p.set_defaults(run=scan)
    p = commands.add_parser("process")
    for name in ("--music-dir", "--output-dir"):
        p.add_argument(name, required=True)
    for name in ("--collection", "--log", "--state-dir"):
        p.add_argument(name)
    p.add_argument("--model", default="linear-stand-in")
    p.add_argument("--native-algorithm", dest="algorithm", default=naming.ALGORITHM)
    p.add_argument("--profile", choices=list(plans.PROFILES), default="ultra")
    for name, kind, default in (
        ("--batch-size", int, 0),
        ("--shifts", int, 0),
        ("--overlap", float, 0.1),
        ("--segment", float, 7.8),
        ("--sample-rate", int, 44100),
        ("--bitrate", int, 256_000),
        ("--limit", int, 0),
    ):
        p.add_argument(name, type=kind, default=default)
    p.add_argument("--codec", choices=list(plans.CODECS), default="pcm")
    for name in ("--force", "--reprocess-existing", "--dry-run", "--continue-on-error"):
        p.add_argument(name, action="store_true")
    p.add_argument("--no-update-collection", dest="update_collection", action="store_false")
    p.set_defaults(run=process)
    p = commands.add_parser("verify")
    p.add_argument("path")
    p.set_defaults(run=verify)
    p = commands.add_parser("calibrate")
    p.add_argument("--collection")
    p.add_argument("--log")
    p.add_argument("--audio", required=True)
    p.add_argument("--output-dir", required=True)
    p.add_argument("--stem-file")
    p.set_defaults(run=calibrate)
    for name in ("scan", "process", "calibrate"):
        for option in ("--library-root", "--library-app"):
            commands.choices[name].add_argument(option)
    return top


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    try:
        return a.run(a)
    except KeyboardInterrupt:
        return 130
    except (LibraryError, OSError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
