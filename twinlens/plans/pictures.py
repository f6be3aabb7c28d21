"""Queries that run on generated pictures: there are none in the tables. Their SQL holds what each picture is known to be."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinlens.functions import hashes as H
from twinlens.functions import vectors as V
from twinlens.operators import classify, images, merge
from twinlens.plans import pipeline
from twinlens.sources import demo, engines
from twinlens.sources.images import normalised
from twinlens.kernels.pixels import png_encode

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _cases(spark: SparkSession) -> DataFrame:
    a = demo.scene()
    rows = [(n, e, bytearray(png_encode(img)), bytearray(png_encode(a)), "", "") for n, (img, e) in demo.variants(a).items()]
    return spark.createDataFrame(rows, "name string, expected string, cand binary, orig binary, sha_a string, sha_b string").repartition(8, "name")


# What the recipe of each case makes it: its label, and the share of the original that a crop shows.
_KNOWN = {
    "identical_bytes": "EXACT_1TO1", "renamed_identical": "EXACT_1TO1", "metadata_stripped": "EXACT_1TO1", "metadata_added": "EXACT_1TO1",
    "resized_down_half": "EXACT_1TO1", "resized_up_double": "EXACT_1TO1", "jpeg_recompressed": "EXACT_1TO1", "png_to_jpeg": "EXACT_1TO1",
    "heavily_compressed": "EXACT_1TO1", "brightness_up": "EDITED_1TO1", "brightness_down": "EDITED_1TO1", "contrast_up": "EDITED_1TO1",
    "colour_shift": "EDITED_1TO1", "watermarked": "EDITED_1TO1", "bordered": "EDITED_1TO1", "blurred": "EDITED_1TO1", "screenshot": "EDITED_1TO1",
    "rotated_90": "EDITED_1TO1", "rotated_180": "EDITED_1TO1", "mirrored": "EDITED_1TO1", "crop_centre": "CROP", "crop_corner": "CROP", "crop_wide": "CROP",
    "grainy": "NEAR_1TO1", "different_photo_same_subject": "VISUALLY_SIMILAR", "lookalike": "VISUALLY_SIMILAR", "unrelated_image": "UNRELATED", "broken_file": "ERROR",
}
_SHOWN = {"crop_centre": 0.25, "crop_corner": 0.4092, "crop_wide": 0.64}


@query(
    "SELECT name, expected AS label, shown IS NOT NULL AS covers_as_cut FROM (VALUES "
    + ", ".join(f"('{n}', '{e}', {_SHOWN.get(n, 'NULL')})" for n, e in _KNOWN.items())
    + ") AS t(name, expected, shown)"
)
def case_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Label of every case of the labelled matrix, files of several formats, judged by pixels alone; for crops whether the share of the
    original they cover is right to three hundredths."""
    a = demo.scene()
    rows = [(n, bytearray(data), bytearray(png_encode(a)), "", "") for n, data, _ in demo.cases(a)]
    files = spark.createDataFrame(rows, "name string, cand binary, orig binary, sha_a string, sha_b string").repartition(8, "name")
    s = images.pair_signals(normalised(files, "cand"), ["name"], "orig", "cand", "sha_a", "sha_b", True)
    judged = classify.verdict_columns(s.where("error IS NULL")).select("name", "label", "overlap")
    failed = classify.error_verdict(s.where("error IS NOT NULL"), F.col("error")).select("name", "label", F.lit(None).cast("double").alias("overlap"))
    shown = F.create_map(*(F.lit(x) for kv in _SHOWN.items() for x in kv))
    right = F.coalesce(F.abs(F.col("overlap") - shown[F.col("name")]) <= 0.03, F.lit(False))
    return judged.unionByName(failed).select("name", "label", right.alias("covers_as_cut"))


# Sizes that the recipes give the pictures.
_SIZES = {
    "resized_half": (320, 240), "resized_double": (1280, 960), "bordered": (696, 536), "screenshot": (544, 481), "rotated_90": (480, 640),
    "crop_centre": (320, 240), "crop_corner": (396, 316), "crop_wide": (512, 384),
}
_NAMES = [
    "identical", "resized_half", "resized_double", "brightness_up", "brightness_down", "contrast_up", "colour_shift", "watermarked", "bordered", "screenshot",
    "blurred", "rotated_90", "rotated_180", "mirrored", "crop_centre", "crop_corner", "crop_wide", "lookalike", "unrelated",
]
_RESIZED = "name IN ('identical', 'resized_half', 'resized_double')"
#: Pictures whose pixels, once turned, are those of the original.
_TURNED = "name IN ('identical', 'rotated_90', 'rotated_180', 'mirrored')"


def _values(row) -> str:
    return "(VALUES " + ", ".join(f"({', '.join(row(n))})" for n in _NAMES) + ") AS t"


@query(
    f"SELECT name, w AS width, h AS height, true AS readable, CASE WHEN {_RESIZED} THEN true WHEN name = 'unrelated' THEN false END AS near FROM "
    + _values(lambda n: (f"'{n}'", *(str(x) for x in _SIZES.get(n, (640, 480)))))
    + "(name, w, h)"
)
def picture_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """Size of each picture, whether all of its hashes were made, and whether they are near those of the original where that
    is known: a resized copy is, another picture isn't."""
    prints = images.fingerprints(_cases(spark), ["name"], "cand")
    own = prints.where("name = 'identical'").select(F.struct(*H.ORDER).alias("o"))
    both = prints.crossJoin(F.broadcast(own))  # one row
    fused = H.compare({h: F.col("o")[h] for h in H.ORDER}, {h: F.col(h) for h in H.ORDER})["fused"]
    known = F.expr(f"{_RESIZED} OR name = 'unrelated'")
    return both.select("name", "width", "height", F.expr("error IS NULL AND phash IS NOT NULL AND dhash IS NOT NULL AND whash IS NOT NULL AND ahash IS NOT NULL").alias("readable"), F.when(known, fused >= 0.9).alias("near"))


@query(f"SELECT name, 368 AS dim, true AS unit, CASE WHEN {_RESIZED} THEN true END AS same FROM " + _values(lambda n: (f"'{n}'",)) + "(name)")
def picture_descriptors(spark: SparkSession, d: str) -> DataFrame:
    """Length of each descriptor, whether it is a unit vector, and for resized copies whether it is the original's."""
    v = images.descriptors(_cases(spark), ["name"], "cand").withColumn("v", F.col("vector").cast("array<double>"))
    own = v.where("name = 'identical'").select(F.col("v").alias("o"))
    both = v.crossJoin(F.broadcast(own))  # one row
    return both.select(
        "name",
        F.size("v").alias("dim"),
        (F.abs(V.norm(F.col("v")) - 1) < 1e-4).alias("unit"),
        F.when(F.expr(_RESIZED), V.cosine(F.col("v"), F.col("o")) > 0.99).alias("same"),
    )


@query(f"SELECT name, {_RESIZED} AS same_picture FROM " + _values(lambda n: (f"'{n}'",)) + "(name)")
def quick_matches(spark: SparkSession, d: str) -> DataFrame:
    """Whether the quick comparison takes a variant for the same rendered picture: resized copies only, no edit, turn or crop."""
    cases = _cases(spark)
    orig, cand = (images.summaries(cases, ["name"], side).drop("error") for side in ("orig", "cand"))
    a, b = (x.toDF("name", *(f"{p}_{c}" for c in x.columns[1:])) for x, p in ((orig, "a"), (cand, "b")))
    q = images.quick_pairs(a.join(b, "name"), ["name"], "a_", "b_")
    return q.select("name", merge.same_picture(F.col("identity"), F.col("changed_fraction"), F.col("edit_labels")).alias("same_picture"))


@query(f"SELECT name, 4::BIGINT AS views, {_TURNED} AS equal FROM " + _values(lambda n: (f"'{n}'",)) + "(name)")
def comparison_views(spark: SparkSession, d: str) -> DataFrame:
    """How many of the four views are pictures of the size asked for, and whether the difference is black throughout: of
    turned copies it is."""
    r = images.renderings(_cases(spark), ["name"], "orig", "cand", 256)
    shown = r.select("name", F.explode(F.create_map(*(x for v in images.VIEWS for x in (F.lit(v), F.col(v))))).alias("view", "png"))
    looked = images.look_at(shown, ["name", "view"], "png")
    sized = F.expr("width = 256 AND height = 256")
    return looked.groupBy("name").agg(F.count_if(sized).alias("views"), F.max(F.when(F.col("view") == "difference", F.col("brightest") == 0)).alias("equal"))


def demo_report(spark: SparkSession) -> pipeline.Report:
    a = png_encode(demo.scene())
    hits, _ = engines.search(spark, a, ["demo"])
    originals = spark.createDataFrame([("q1", bytearray(a))], "query_id string, data binary")
    return pipeline.run(originals, hits.withColumn("query_id", F.lit("q1")))


@query(
    """SELECT * FROM (VALUES ('resized_double', true, 5::BIGINT, 3), """
    + ", ".join(f"('{n}', true, 1::BIGINT, 1)" for n in _NAMES[3:14])
    + ", "
    + ", ".join(f"('{n}', false, 1::BIGINT, 1)" for n in (*_NAMES[14:18], "unrelated_0", "unrelated_1", "unrelated_2"))
    + ") AS t(picture, one_to_one, sources, engines)"
)
def demo_cards(spark: SparkSession, d: str) -> DataFrame:
    """The whole pipeline over a synthetic result set: the copies are one card, shown by the largest and led to by five sources of
    three engines; each edit is a 1:1 card of its own; crops, the lookalike and other pictures aren't 1:1."""
    cards = demo_report(spark).cards
    return cards.select(F.regexp_extract("best_url", r"([^/]+)\.png$", 1).alias("picture"), F.col("label").isin(*merge.ONE_TO_ONE).alias("one_to_one"), "sources", F.size("engines").alias("engines"))
