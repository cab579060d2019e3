"""The whole search: which picture stands for each disc image, on tables of directory entries and attempts.

Every stage is a join or a choice per (image, view); images are searched side by side, none by a loop.

``entries``: ``image_id, view`` (1 is asked first), ``entry_id, parent_id`` (null for the root), ``pos`` (directory
order), ``name, is_dir, size`` and ``readable`` (whether the content could be read or decoded).
``attempts``: ``image_id, view, stage`` (``dvd`` or ``bluray``), ``attempt`` (order), ``mean, stddev, bad, total`` of the
decoded frame and ``source``; ``saw_video`` tells that the attempt read video.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candex.functions.names import IMAGE_EXTENSIONS, dims_from_name, fold, has_ext, size_rank, split_ext
from candex.operators.filters import quality_band, size_gate
from candex.operators.folds import budget_greedy
from candex.operators.graph import lookup_path
from candex.operators.windows import first_acceptable_else_best
from candex.plans.ordered import first_rows

# Stems of cover pictures in the root folder, first choice first.
COVER_NAMES = ["folder", "cover", "poster", "thumbnail", "thumb", "front", "artwork"]

# Limits on picture files.
MAX_IMAGE_BYTES = 16 << 20
MAX_IMAGES = 64
MAX_JACKET_BYTES = 2 << 20
MAX_JACKET_TOTAL = 4 << 20
MAX_JACKET_FILES = 16

# Fixed value: a frame with more than one bad block in this many is rejected.
MAX_BAD_RATIO = 10

DISC = ["image_id", "view"]


def _files_of(entries: DataFrame, folder: str) -> DataFrame:
    """The files of one folder of each disc, looked up from the root."""
    at = lookup_path(entries, DISC, "entry_id", "parent_id", "name", "is_dir", ["pos", "entry_id"], folder)
    files = entries.where(~F.col("is_dir"))
    return files.join(at.withColumnRenamed("entry_id", "parent_id"), [*DISC, "parent_id"])


def _first_readable(files: DataFrame, order: list, prefix: str) -> DataFrame:
    """First file by ``order`` that is not empty, not too large and readable."""
    good = size_gate(files, "size", MAX_IMAGE_BYTES).where("readable")
    best = first_rows(good, DISC, [*order, "pos", "entry_id"])
    return best.select(*DISC, F.concat(F.lit(prefix), "name").alias("path"), F.lit("encoded").alias("kind"))


def artwork(entries: DataFrame, folder: str) -> DataFrame:
    """The largest picture of a folder, by the size in its name, then by its bytes; the first files count."""
    files = _files_of(entries, folder).where(has_ext("name", IMAGE_EXTENSIONS))
    files = first_rows(files, DISC, ["pos", "entry_id"], MAX_IMAGES)
    files = files.withColumn("area", dims_from_name("name")["area"])
    return _first_readable(files, ["-area", F.coalesce("size", F.lit(0)).desc()], f"{folder}/")


def covers(entries: DataFrame) -> DataFrame:
    """The first readable cover picture of the root folder, by the priority of its name."""
    root = entries.where("parent_id is null").select(*DISC, F.col("entry_id").alias("parent_id"))
    stem = fold(split_ext("name")["stem"])
    files = entries.where(~F.col("is_dir") & has_ext("name", IMAGE_EXTENSIONS) & stem.isin(COVER_NAMES))
    files = first_rows(files.join(root, [*DISC, "parent_id"]), DISC, ["pos", "entry_id"], MAX_IMAGES)
    rank = F.array_position(F.array(*[F.lit(n) for n in COVER_NAMES]), stem)
    return _first_readable(files.withColumn("rank", rank), ["rank"], "")


def jacket(entries: DataFrame) -> DataFrame:
    """The largest jacket picture that decodes, within the bytes allowed for all of them together."""
    files = _files_of(entries, "JACKET_P").withColumn("rank", size_rank("name")).where("rank is not null")
    files = size_gate(first_rows(files, DISC, ["pos", "entry_id"], MAX_JACKET_FILES), "size", MAX_JACKET_BYTES)
    read = budget_greedy(files, DISC, ["rank", "pos", "entry_id"], "size", MAX_JACKET_TOTAL)
    best = first_rows(read.where("readable"), DISC, ["rank", "pos", "entry_id"])
    return best.select(*DISC, F.concat(F.lit("JACKET_P/"), "name").alias("path"), F.lit("picture").alias("kind"))


def video(attempts: DataFrame, stage: str) -> DataFrame:
    """The first presentable frame of a stage, else the one with most detail; damaged frames do not count."""
    whole = (F.col("total") > 0) & (F.col("bad") * MAX_BAD_RATIO <= F.col("total"))
    frames = attempts.where((F.col("stage") == stage) & whole)
    best = first_acceptable_else_best(frames, DISC, ["attempt"], quality_band("mean", "stddev"), "stddev")
    return best.select(*DISC, F.col("source").alias("path"), F.lit("picture").alias("kind"))


def find_pictures(entries: DataFrame, attempts: DataFrame) -> DataFrame:
    """One row per image that has a picture: ``image_id, view, stage, path, kind``.

    Stages in order: two artwork folders, jacket picture, covers, frames of the DVD, frames of the Blu-ray. The
    second view serves images the first left without; where the first already read video, the jacket pictures
    and the frames are not looked at again.
    """
    stages = [
        artwork(entries, "BDMV/META/DL"), artwork(entries, "BDMV/META/TN"), jacket(entries), covers(entries),
        video(attempts, "dvd"), video(attempts, "bluray"),
    ]
    rows = reduce(DataFrame.unionByName, [s.withColumn("stage", F.lit(i + 1)) for i, s in enumerate(stages)])
    searched = attempts.where("view = 1 and saw_video").select("image_id").distinct()
    again = (F.col("view") == 2) & F.col("stage").isin(3, 5, 6) & F.col("_searched").isNotNull()
    rows = rows.join(searched.withColumn("_searched", F.lit(True)), "image_id", "left").where(~again)
    best = first_rows(rows, ["image_id"], ["view", "stage", "path"])
    return best.select("image_id", "view", "stage", "path", "kind")
