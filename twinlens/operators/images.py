"""Fingerprints, pair signals and renderings of images held as bytes, as Arrow stages.

Rows never fail a stage: what can't be read or compared gets an ``error``. Batches are small, as a row may
hold a megabyte of image.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlens.kernels import pair as P
from twinlens.kernels.pixels import descriptor, fingerprint, png_encode
from twinlens.operators import classify
from twinlens.sources.images import read_rgb

PRINT = "sha256 string, width int, height int, ahash bigint, dhash bigint, phash bigint, whash bigint, color_hist array<float>, luma_mean double, luma_std double"
SIGNAL = (
    "sha_identical boolean, orientation string, aspect_sim double, hash_sim double, hash_sim_global double, hash_sim_aligned double, hash_best double, hash_worst double, hash_best_name string, hist_corr double, emb_cos double, "
    "feat_sim double, ssim double, ms_ssim double, ssim_raw double, nrmse_sim double, psnr double, grad_corr double, inliers int, inlier_ratio double, trusted boolean, "
    "template_score double, template_direction string, coverage_orig double, coverage_cand double, coverage_source string, align_method string, align_valid_fraction double, "
    "changed_fraction double, localised_fraction double, gain double, offset double, linear_r2 double, residual double, channel_shift double, sharpness_ratio double, "
    "border boolean, border_fraction double"
)
#: What a quick comparison needs of an image: hashes, colours, a thumbnail, and the flat bands at its edges.
SUMMARY = (
    "ahash bigint, dhash bigint, phash bigint, whash bigint, color_hist array<float>, thumb binary, aspect double, band_width int, band_height int, across array<int>, along array<int>"
)
THUMB = 112
QUICK = "identity double, ssim double, changed_fraction double, hash_sim double, edit_labels array<string>"
RENDER = "original binary, candidate binary, difference binary, heatmap binary, align_method string, align_valid_fraction double, coverage_orig double, coverage_cand double, size int"


def _names(ddl: str) -> list[str]:
    return [f.split()[0] for f in ddl.split(", ")]


def _map(df: DataFrame, keys: list[str], inputs: list[str], ddl: str, work) -> DataFrame:
    """``work`` over the input columns of each row; its dictionary becomes columns, its failure an error."""
    names = _names(ddl)
    schema = ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys), ddl, "error string"])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for at in range(0, len(p), 32):
                rows = []
                for r in p.iloc[at : at + 32].itertuples(index=False):
                    key, args = list(r[: len(keys)]), r[len(keys) :]
                    try:
                        got = work(*args)
                        rows.append([*key, *(got[n] for n in names), None])
                    except Exception as e:
                        rows.append([*key, *(None for _ in names), str(e) or type(e).__name__])
                yield pd.DataFrame(rows, columns=[*keys, *names, "error"], dtype=object)

    return df.select(*keys, *inputs).mapInPandas(run, schema)


def fingerprints(df: DataFrame, keys: list[str], data: str = "data") -> DataFrame:
    """keys and the fingerprint of each image."""

    def work(raw: bytes) -> dict:
        rgb = read_rgb(raw)
        return fingerprint(rgb) | {"sha256": hashlib.sha256(raw).hexdigest(), "width": rgb.shape[1], "height": rgb.shape[0]}

    return _map(df, keys, [data], PRINT, work)


def descriptors(df: DataFrame, keys: list[str], data: str = "data", embed: Callable[[np.ndarray], np.ndarray] = descriptor, backend: str = "classical-descriptor") -> DataFrame:
    """keys, backend and vector. Another embedding than the classical one is given as a function of the
    RGB pixels, with the name of its backend (I12); none is bundled."""

    def work(raw: bytes) -> dict:
        return {"backend": backend, "vector": embed(read_rgb(raw))}

    return _map(df, keys, [data], "backend string, vector array<float>", work)


@lru_cache(maxsize=2)
def _picture(raw: bytes, work_size: int) -> P.Picture:
    """An original is met by many candidates in a row; what is made of it is kept."""
    return P.Picture(read_rgb(raw), work_size)


def look_at(df: DataFrame, keys: list[str], data: str = "data") -> DataFrame:
    """keys, size and the brightest value of each image."""

    def work(raw: bytes) -> dict:
        rgb = read_rgb(raw)
        return {"width": rgb.shape[1], "height": rgb.shape[0], "brightest": int(rgb.max())}

    return _map(df, keys, [data], "width int, height int, brightest int", work)


def pair_signals(df: DataFrame, keys: list[str], original: str, candidate: str, sha_a: str, sha_b: str, deep: bool, work_size: int = 512, size: int = 256) -> DataFrame:
    """keys, the signals of each pair, its sizes, and the names of the edits that its measurements speak for."""

    def work(a: bytes, b: bytes, x: str, y: str) -> dict:
        pa, pb = _picture(a, work_size), P.Picture(read_rgb(b), work_size)
        sizes = {"orig_width": pa.rgb.shape[1], "orig_height": pa.rgb.shape[0], "cand_width": pb.rgb.shape[1], "cand_height": pb.rgb.shape[0]}
        return P.signals(pa, pb, x or "", y or "", work_size, size, deep) | sizes

    ddl = SIGNAL + ", orig_width int, orig_height int, cand_width int, cand_height int"
    return classify.with_edit_labels(_map(df, keys, [original, candidate, sha_a, sha_b], ddl, work))


def summaries(df: DataFrame, keys: list[str], data: str = "data") -> DataFrame:
    """keys and the summary of each image, about 40 KB whatever its size."""

    def work(raw: bytes) -> dict:
        s = P.summary(read_rgb(raw), THUMB)
        return s | {"thumb": s["thumb"].tobytes(), "band_width": s["size"][0], "band_height": s["size"][1]}

    return _map(df, keys, [data], SUMMARY, work)


def quick_pairs(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """keys and the quick comparison of two summaries, whose columns stand behind the prefixes ``a`` and ``b``."""
    names = _names(SUMMARY)

    def side(values: tuple) -> dict:
        s = dict(zip(names, values))
        return s | {
            "thumb": np.frombuffer(s["thumb"], dtype=np.uint8).reshape(THUMB, THUMB, 3),
            "color_hist": np.asarray(s["color_hist"], dtype=np.float32),
            "size": (int(s["band_width"]), int(s["band_height"])),
        }

    def work(*values) -> dict:
        return P.quick_pair(side(values[: len(names)]), side(values[len(names) :]))

    return _map(df, keys, [a + n for n in names] + [b + n for n in names], QUICK, work)


def renderings(df: DataFrame, keys: list[str], a: str, b: str, size: int = 720) -> DataFrame:
    """Four pictures as PNG with how they were aligned."""

    def work(x: bytes, y: bytes) -> dict:
        r = P.render(read_rgb(x), read_rgb(y), size)
        return {k: png_encode(v) if isinstance(v, np.ndarray) else v for k, v in r.items()}

    return _map(df, keys, [a, b], RENDER, work)


VIEWS = ["original", "candidate", "difference", "heatmap"]


def view(rendered: DataFrame, name: str) -> DataFrame:
    """One picture of a rendering; an unknown view is an error."""
    if name not in VIEWS:
        raise ValueError(f"unknown view {name!r}")
    return rendered.select(*(c for c in rendered.columns if c not in (*VIEWS, *_names(RENDER))), F.col(name).alias("png"))
