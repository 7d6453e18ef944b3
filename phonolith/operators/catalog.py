"""Catalog joins: scanned files with the collection, and the log's latest paths (JN1 to JN6, PRJ5 to PRJ7, SNK6, SNK7).

Build sides are never hinted: Catalyst broadcasts them when their size allows,
otherwise the join shuffles on the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import naming, text

#: Bit of FLAGS that marks a generated file.
GENERATED = 64


def tracks(files: DataFrame, path: str = "path") -> DataFrame:
    """Audio files with title and artist from their names."""
    p = F.col(path)
    return files.where(text.is_audio(p)).select(
        "*", text.title_from_path(p).alias("title"), text.artist_from_path(p).alias("artist")
    )


def collection_index(entries: DataFrame, resolved: str | None = None) -> DataFrame:
    """One row per key: the last entry in document order with that path. ``entries``: pos, path, title, artist, audio_id, flags.

    An entry has the keys of its path and, where given, of its resolved path.
    """
    keys = F.array(text.nfc(F.col("path"))) if resolved is None else F.array_distinct(F.array(text.nfc(F.col("path")), text.nfc(F.col(resolved))))
    exploded = entries.select("*", F.explode(keys).alias("key"))
    kept = F.struct(*[F.col(c) for c in entries.columns])
    return exploded.groupBy("key").agg(F.max_by(kept, "pos").alias("e")).select("key", "e.*")


def enrich(scanned: DataFrame, index: DataFrame) -> DataFrame:
    """Scanned tracks with title, artist and audio id of the collection; empty values fall through, the path stays."""
    e = index.select("key", F.col("title").alias("e_title"), F.col("artist").alias("e_artist"), F.col("audio_id").alias("audio_id"))
    joined = scanned.withColumn("key", text.nfc(F.col("path"))).join(e, "key", "left")
    kept = [c for c in scanned.columns if c not in ("title", "artist", "audio_id")]
    return joined.select(
        *kept,
        F.coalesce(text.full(F.col("e_title")), F.col("title")).alias("title"),
        F.coalesce(text.full(F.col("e_artist")), F.col("artist")).alias("artist"),
        "audio_id",
    )


def enrich_resolved(scanned: DataFrame, index: DataFrame, resolved: str = "resolved") -> DataFrame:
    """``enrich`` where a file is looked up by its path, and by its resolved path only where that finds nothing.

    Both keys go through one join: a file asks with each of its keys, and the answer of the first one counts.
    """
    keys = F.array(F.struct(F.lit(0).alias("turn"), text.nfc(F.col("path")).alias("key")), F.struct(F.lit(1).alias("turn"), text.nfc(F.col(resolved)).alias("key")))
    asked = scanned.select("path", resolved).distinct().select("path", resolved, F.explode(keys).alias("k")).select("path", resolved, "k.turn", "k.key")
    e = index.select("key", F.struct(F.col("title").alias("t"), F.col("artist").alias("a"), F.col("audio_id").alias("i")).alias("e"))
    found = asked.join(e, "key").groupBy("path", resolved).agg(F.min_by("e", "turn").alias("e"))
    kept = [c for c in scanned.columns if c not in ("title", "artist", "audio_id")]
    return scanned.join(found, ["path", resolved], "left").select(
        *kept,
        F.coalesce(text.full(F.col("e.t")), F.col("title")).alias("title"),
        F.coalesce(text.full(F.col("e.a")), F.col("artist")).alias("artist"),
        F.col("e.i").alias("audio_id"),
    )


def single_track(path: str, index: DataFrame) -> DataFrame:
    """``single_tracks`` of one file."""
    return single_tracks(index.sparkSession.createDataFrame([(path,)], "path string"), index)


def single_tracks(one: DataFrame, index: DataFrame) -> DataFrame:
    """Named files (path): the collection's path, its title or the bare stem, its artist as it is; else names from the file."""
    e = index.select("key", F.col("path").alias("e_path"), F.col("title").alias("e_title"), F.col("artist").alias("e_artist"), "audio_id")
    j = one.withColumn("key", text.nfc(F.col("path"))).join(e, "key", "left")
    found, p = F.col("e_path").isNotNull(), F.col("path")
    return j.select(
        F.coalesce("e_path", "path").alias("path"),
        F.when(found, F.coalesce(text.full(F.col("e_title")), text.stem(p))).otherwise(text.title_from_path(p)).alias("title"),
        F.when(found, F.col("e_artist")).otherwise(text.artist_from_path(p)).alias("artist"),
        "audio_id",
    )


def latest_logged(log: DataFrame, root: str) -> DataFrame:
    """(title, logged_path): of each title's stored paths under ``root`` the last. ``log``: line_no, title, path."""
    under = log.where(F.col("path").startswith(root.rstrip("/") + "/"))
    return under.groupBy("title").agg(F.max_by("path", "line_no").alias("logged_path"))


def output_paths(enriched: DataFrame, logged: DataFrame, root: str) -> DataFrame:
    """Adds ``output`` (the logged path, else the one named by the audio id) and ``error`` where there is neither."""
    j = enriched.join(logged, "title", "left").withColumn("words", naming.hash_words(F.col("audio_id")))
    output = F.coalesce(F.col("logged_path"), naming.native_path(root, F.col("words")))
    missing = F.when(text.full(F.col("audio_id")).isNull(), F.concat(F.lit("missing audio id: "), "path")).otherwise(
        F.concat(F.lit("audio id is not 256 bytes: "), "path")
    )
    return j.select(*enriched.columns, output.alias("output"), F.when(output.isNull(), missing).alias("error"))


def flagged(flags: Column) -> Column:
    """Whether the generated bit is set; missing flags have it not."""
    return F.coalesce(flags.cast("int"), F.lit(0)).bitwiseAND(F.lit(GENERATED)) != 0


def mark_generated(entries: DataFrame, done: DataFrame) -> DataFrame:
    """Entries with the bit set where ``done`` (path) names them; ``found`` and ``changed`` say what happened.

    Only the last entry of a path counts, as for lookups.
    """
    keyed = entries.withColumn("key", text.nfc(F.col("path")))
    last = keyed.groupBy("key").agg(F.max("pos").alias("last_pos"))
    hit = done.select(text.nfc(F.col("path")).alias("key")).distinct().withColumn("hit", F.lit(True))
    j = keyed.join(last.join(hit, "key"), "key", "left")
    found = F.coalesce(F.col("hit") & (F.col("pos") == F.col("last_pos")), F.lit(False))
    flags = F.coalesce(F.col("flags").cast("int"), F.lit(0))
    return j.select(
        *[c for c in entries.columns if c != "flags"],
        F.when(found, flags.bitwiseOR(F.lit(GENERATED))).otherwise(F.col("flags").cast("int")).alias("flags"),
        found.alias("found"),
        (found & ~flagged(F.col("flags"))).alias("changed"),
    )


def pick_collection(candidates: DataFrame, app: str) -> DataFrame:
    """The candidate (path, mtime) of the greatest version, then modification time."""
    best = F.max_by("path", F.struct(text.version_key(F.col("path"), app).alias("v"), F.col("mtime")))
    return candidates.agg(best.alias("path"), F.count(F.lit(1)).alias("candidates"))


def listing(enriched: DataFrame) -> DataFrame:
    """Tab-separated lines: whether an id was found, the display name, the path."""
    marker = F.when(text.full(F.col("audio_id")).isNotNull(), "matched").otherwise("no-audio-id")
    return enriched.select(F.concat_ws("\t", marker, text.display_name(F.col("artist"), F.col("title")), F.col("path")).alias("value"))
