"""Perceptual hashes, logo matching and image decisions."""

from __future__ import annotations

import base64
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Greatest Hamming distances for removal without question and for review.
AUTO_REMOVE, REVIEW = 8, 18


def decode_png(data: bytes) -> np.ndarray | None:
    """(height, width, 3) of a PNG of 8 bits a channel, not interlaced; transparent pixels over white."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        return None
    at, body, palette, alpha = 8, b"", None, b""
    head = None
    while at + 8 <= len(data):
        n, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        part = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = part
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            alpha = part
        elif kind == b"IDAT":
            body += part
        at += 12 + n
    if head is None or head[8] != 8 or head[12] != 0:
        return None
    w, h, colour = int.from_bytes(head[:4], "big"), int.from_bytes(head[4:8], "big"), head[9]
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(colour)
    try:
        raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + w * channels)
    except (zlib.error, ValueError, TypeError):
        return None
    rows = np.zeros((h, w * channels), np.uint8)
    up = np.zeros(w * channels, np.int64)
    for y in range(h):
        line, f = raw[y, 1:].astype(np.int64), raw[y, 0]
        if f == 2:
            line = line + up
        elif f in (1, 3, 4):
            for x in range(len(line)):
                a = line[x - channels] if x >= channels else 0
                c = up[x - channels] if x >= channels else 0
                if f == 1:
                    add = a
                elif f == 3:
                    add = (a + up[x]) // 2
                else:
                    p = a + up[x] - c
                    add = min((abs(p - a), 0, a), (abs(p - up[x]), 1, up[x]), (abs(p - c), 2, c))[2]
                line[x] = (line[x] + add) & 255
        up = line & 255
        rows[y] = up
    px = rows.reshape(h, w, channels).astype(np.float64)
    if colour == 3:
        a = np.frombuffer(alpha.ljust(len(palette), b"\xff"), np.uint8)
        index = rows.reshape(h, w)
        px = np.concatenate([palette[index].astype(np.float64), a[index][..., None].astype(np.float64)], axis=2)
    if px.shape[2] in (2, 4):
        over = px[..., -1:] / 255
        px = px[..., :-1] * over + 255 * (1 - over)
    return np.repeat(px, 3, axis=2) if px.shape[2] == 1 else px


def _shrink(grey: np.ndarray, size: int) -> np.ndarray:
    """Area average to size x size."""
    h, w = grey.shape
    ys, xs = np.linspace(0, h, size + 1), np.linspace(0, w, size + 1)

    def weights(edges, n):
        low, high = edges[:-1, None], edges[1:, None]
        cells = np.arange(n)[None, :]
        cover = np.clip(np.minimum(high, cells + 1) - np.maximum(low, cells), 0, None)
        return cover / cover.sum(axis=1, keepdims=True)

    return weights(ys, h) @ grey @ weights(xs, w).T


def perceptual_hash(data: bytes) -> str | None:
    """64-bit hash, as 16 hex digits, of the low frequencies of a 32 x 32 grey image against their median; None if undecodable."""
    px = decode_png(data)
    if px is None:
        return None
    small = _shrink(px @ np.array([0.299, 0.587, 0.114]), 32)
    k = np.arange(32)
    dct = np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / 64)
    low = (dct @ small @ dct.T)[:8, :8]
    bits = (low > np.median(low)).reshape(-1)
    return f"{int(''.join('1' if b else '0' for b in bits), 2):016x}"


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 16-digit hex hashes, by halves."""
    half = lambda c, at: F.conv(F.substring(c, at, 8), 16, 10).cast("long")
    return (F.bit_count(half(a, 1).bitwiseXOR(half(b, 1))) + F.bit_count(half(a, 9).bitwiseXOR(half(b, 9)))).cast("int")


def image_status(diff: Column, any_logo: Column) -> Column:
    """Without a logo, or without a distance because the picture can't be read, it is for a person to see."""
    return F.when(~any_logo | diff.isNull(), "review").when(diff <= AUTO_REMOVE, "auto_remove").when(diff <= REVIEW, "review").otherwise("keep")


def match_logos(images: DataFrame, logos: DataFrame) -> DataFrame:
    """Add hash_diff, the least distance to a logo, and status; ``logos`` is (project_id, logo_hash), images have project_id.

    A project's logos come as one array by an equi join, so no pair of an image and a logo is a row. Without logos everything is to review.
    """
    per_project = logos.groupBy("project_id").agg(F.collect_set("logo_hash").alias("_logos"))
    joined = images.join(per_project, "project_id", "left").withColumn("_logos", F.coalesce("_logos", F.array().cast("array<string>")))
    diff = F.array_min(F.transform("_logos", lambda h: hamming(F.col("phash"), h)))
    return joined.withColumn("hash_diff", diff).withColumn("status", image_status(F.col("hash_diff"), F.size("_logos") > 0)).drop("_logos")


#: Most hashes on both sides of one task of ``match_many_logos``, on average.
IMAGE_BLOCK, LOGO_BLOCK = 1 << 16, 1 << 13


def match_many_logos(images: DataFrame, logos: DataFrame, image_block: int = IMAGE_BLOCK, logo_block: int = LOGO_BLOCK) -> DataFrame:
    """``match_logos`` for projects with any number of logos: the same rows and columns, without an array of a project's logos.

    Distinct hashes of a project are dealt by their own hash to parts of images and blocks of logos; each part meets each block in a task of bounded size, as numbers, and only each
    image's least distance leaves it. At a distance of 18 in 64 bits bands can't help: by pigeonhole, four bands of 16 bits must be met within 4 bits, which one pair in seven of
    unlike hashes does. Where a project has no logo but null ones its images are to review and have no distance; an image without a hash has none either and stays.
    """
    import pandas as pd

    number = lambda c: F.conv(c, 16, -10).cast("long")
    dealt = lambda n: F.pmod(F.xxhash64("_h"), n).cast("int")
    blocks_for = lambda n, size: F.ceil(n / F.lit(size)).cast("int")
    rows = images.withColumn("_h", number(F.col("phash")))
    theirs = logos.filter("project_id is not null").select("project_id", number(F.col("logo_hash")).alias("_h"))
    have = theirs.groupBy("project_id").agg(F.count("_h").alias("_logos"))
    mine, known = (x.filter("project_id is not null and _h is not null").select("project_id", "_h").distinct() for x in (rows, theirs))
    count = lambda x, name: x.groupBy("project_id").agg(F.count(F.lit(1)).alias(name))
    sizes = count(mine, "_a").join(count(known, "_b"), "project_id").select("project_id", blocks_for(F.col("_a"), image_block).alias("_parts"), blocks_for(F.col("_b"), logo_block).alias("_blocks"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = mine.join(sizes, "project_id").select("project_id", "_h", dealt(F.col("_parts")).alias("_part"), each("_blocks").alias("_block"))
    right = known.join(sizes, "project_id").select(F.col("project_id").alias("_p"), "_h", dealt(F.col("_blocks")).alias("_b"), each("_parts").alias("_a"))

    def least(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        x, y = a["_h"].to_numpy(np.int64).view(np.uint64), b["_h"].to_numpy(np.int64).view(np.uint64)
        if not len(x) or not len(y):
            return pd.DataFrame({"project_id": [], "_h": [], "_d": []})
        best = np.full(len(x), 64, np.int32)
        for at in range(0, len(x), 1024):
            for start in range(0, len(y), 1024):
                bits = np.bitwise_count(x[at : at + 1024, None] ^ y[None, start : start + 1024])
                np.minimum(best[at : at + 1024], bits.min(axis=1), out=best[at : at + 1024])
        return pd.DataFrame({"project_id": a["project_id"], "_h": a["_h"], "_d": best})

    schema = T.StructType([mine.schema["project_id"], T.StructField("_h", T.LongType()), T.StructField("_d", T.IntegerType())])
    found = left.groupBy("project_id", "_part", "_block").cogroup(right.groupBy("_p", "_a", "_b")).applyInPandas(least, schema).groupBy("project_id", "_h").agg(F.min("_d").alias("hash_diff"))
    out = rows.join(found, ["project_id", "_h"], "left").join(have, "project_id", "left").withColumn("status", image_status(F.col("hash_diff"), F.col("_logos") > 0))
    out = out.withColumn("status", F.when(F.col("_logos").isNull(), "review").otherwise(F.col("status")))
    return out.select("project_id", *[c for c in images.columns if c != "project_id"], "hash_diff", "status")


def image_counts(matched: DataFrame) -> DataFrame:
    return matched.groupBy("doc_id").agg(F.count_if(F.col("status") == "auto_remove").alias("auto_removed_count"), F.count_if(F.col("status") == "review").alias("review_count"))


def to_remove(matched: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """Images to replace: sure logos and those a user chose, given as (doc_id, idx)."""
    sure = matched.filter("status = 'auto_remove'")
    if chosen is None:
        return sure
    return matched.join(chosen.withColumn("_chosen", F.lit(True)), ["doc_id", "idx"], "left").filter("status = 'auto_remove' or _chosen").drop("_chosen")


def preview_images(matched: DataFrame) -> DataFrame:
    """One row per document: its images in order, with their numbers, and both counts."""
    row = F.struct("idx", "location", "width", "height", "status", "hash_diff", "source_layer")
    index = F.row_number().over(Window.partitionBy("doc_id").orderBy("idx")) - 1
    rows = matched.withColumn("idx", index.cast("int"))
    return rows.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(row)).alias("images"),
        F.count_if(F.col("status") == "auto_remove").alias("auto_removed_count"),
        F.count_if(F.col("status") == "review").alias("review_count"),
    )


def thumbnail(data: bytes, most: int = 150) -> str | None:
    """Base64 of a PNG thumbnail (the standard library has no JPEG encoder)."""
    from ..sources.ooxml import flat_png

    px = decode_png(data)
    if px is None:
        return None
    scale = min(1.0, most / max(px.shape[:2]))
    mean = tuple(int(v) for v in px.reshape(-1, 3).mean(axis=0))
    return base64.b64encode(flat_png(max(1, round(px.shape[1] * scale)), max(1, round(px.shape[0] * scale)), mean)).decode()


def apply_removals(files: DataFrame, removals: DataFrame) -> DataFrame:
    """Files with the chosen parts neutral; removals are (doc_id, part)."""
    import pandas as pd

    from ..sources.ooxml import scrub

    @F.pandas_udf(T.BinaryType())
    def cut(content: pd.Series, parts: pd.Series) -> pd.Series:
        return pd.Series([scrub(c, set(p)) if p is not None and len(p) else c for c, p in zip(content, parts)], dtype=object)

    chosen = removals.groupBy("doc_id").agg(F.collect_set("part").alias("_parts"))
    return files.join(chosen, "doc_id", "left").withColumn("content", cut("content", "_parts")).drop("_parts")
