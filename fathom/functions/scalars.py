"""Scalar functions as Column expressions, and the few that run on the driver."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Nanoseconds of each unit.
_UNITS = {"ns": 1, "us": 10**3, "ms": 10**6, "s": 10**9, "m": 60 * 10**9}


def parse_duration(text: str) -> int:
    """'250ms' and the like as whole nanoseconds above 0, by exact decimals."""
    m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*(ns|us|ms|s|m)\s*", text)
    value = Decimal(m[1]) * _UNITS[m[2]] if m else Decimal(0)
    if value <= 0 or value != int(value):
        raise ValueError(f"not a whole positive duration: {text!r}")
    return int(value)


def digest(*columns: str | Column, prefix: str = "") -> Column:
    """Content id: the first 16 hex digits of the SHA-1 of the columns as JSON, nulls included, names in order."""
    named = sorted(columns, key=lambda c: c if isinstance(c, str) else str(c))
    return F.concat(F.lit(prefix), F.substring(F.sha1(F.to_json(F.struct(*named), {"ignoreNullFields": "false"}).cast("binary")), 1, 16))


def hash_fraction(key: str | Column) -> Column:
    """int(sha1(key)) mod 10000, over 10000: the 160-bit number folded 20 bits at a time."""
    h = F.sha1((F.col(key) if isinstance(key, str) else key).cast("string").cast("binary"))
    parts = F.sequence(F.lit(1), F.lit(36), F.lit(5))
    fold = F.aggregate(parts, F.lit(0).cast("long"), lambda acc, i: (acc * 1048576 + F.conv(F.substr(h, i, F.lit(5)), 16, 10).cast("long")) % 10000)
    return fold / 10000


def hash_split(key: str | Column, ratios: Mapping[str, float]) -> Column:
    """The split whose cumulative share holds the key's fraction; the last one takes the rest."""
    x, names, upto = hash_fraction(key), list(ratios), 0.0
    out = None
    for name in names[:-1]:
        upto += ratios[name]
        out = F.when(x < upto, name) if out is None else out.when(x < upto, name)
    return F.lit(names[-1]) if out is None else out.otherwise(names[-1])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine over the common length; 0 if either vector has no length."""
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def l2_normalise(a: Column) -> Column:
    n = norm(a)
    return F.when(n == 0, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x.cast("double") / n))


def interpolate(a: Column, b: Column, fraction: Column) -> Column:
    """Elementwise between two arrays; null unless they are equally long."""
    return F.when(F.size(a) == F.size(b), F.zip_with(a, b, lambda x, y: x + (y - x) * fraction))


def slice_label(columns: Sequence[str], missing: str = "unknown") -> Column:
    """dim=value|dim=value in the order given."""
    return F.concat_ws("|", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit(missing))) for c in columns])


def parse_label(label: Column) -> Column:
    return F.str_to_map(label, F.lit("\\|"), F.lit("="))


def tag_value(tags: Column, key: str, missing: str = "unknown") -> Column:
    """The value of the first 'key:value' or 'key=value' tag."""
    hit = F.get(F.filter(tags, lambda t: t.startswith(f"{key}:") | t.startswith(f"{key}=")), F.lit(0))
    return F.coalesce(F.substr(hit, F.lit(len(key) + 2)), F.lit(missing))


def stream_name(c: Column) -> Column:
    """A stream's name for matching: trimmed, without slashes at the ends, lower case, _ as -."""
    return F.translate(F.lower(F.regexp_replace(F.trim(c), "^/+|/+$", "")), "_", "-")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1)


def token_bucket(token: Column, dim: int) -> tuple[Column, Column]:
    """(bucket, sign) of a token in a hashed embedding: the first 4 bytes of its SHA-1 modulo dim, and the lowest bit of the fifth."""
    h = F.sha1(token.cast("binary"))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % dim, F.when(F.conv(F.substring(h, 9, 2), 16, 10).cast("long") % 2 == 0, 1).otherwise(-1)


def pad_vector(a: Column, width: int) -> tuple[Column, Column]:
    """(values, mask): zeros on the right up to a width."""
    n = F.greatest(F.lit(width) - F.size(a), F.lit(0))
    return F.concat(F.transform(a, lambda x: x.cast("double")), F.array_repeat(F.lit(0.0), n)), F.concat(F.transform(a, lambda x: F.lit(True)), F.array_repeat(F.lit(False), n))


#: Parts of topic and schema names, and the modality that each hints at, the first that fits.
HINTS = {"image": "image", "camera": "image", "imu": "imu", "lidar": "pointcloud", "pointcloud": "pointcloud", "point_cloud": "pointcloud", "gps": "gps", "gnss": "gps"}


def modality(name: Column) -> Column:
    """A hint from a topic's or schema's name, else unknown."""
    n, out = F.lower(name), F.lit("unknown")
    for part, kind in reversed(HINTS.items()):
        out = F.when(n.contains(part), kind).otherwise(out)
    return out


def timestamp_ns(value: Column, unit: str = "ns") -> Column:
    """A time as whole nanoseconds: a number of the unit, exactly by decimals, or an ISO text in UTC; null for anything else."""
    number = value.try_cast("decimal(28,9)") * F.lit(_UNITS[unit])
    return F.coalesce(number.try_cast("long"), F.unix_micros(value.try_cast("timestamp")) * 1000)


def ordered_distinct(a: Column, *more: Column) -> Column:
    """The values of arrays put one after the other, each at its first place."""
    return F.array_distinct(F.concat(a, *more))


def image_embedding(data: Column, dim: int) -> Column:
    """Byte means of dim equal stretches over 255, of unit length: a hashed picture of an image's bytes; null for null."""
    @F.pandas_udf("array<double>")
    def embed(batch: pd.Series) -> pd.Series:
        def one(raw):
            if raw is None:
                return None
            x = np.frombuffer(raw, np.uint8).astype(float)
            cuts = np.arange(dim + 1) * len(x) // dim
            v = np.array([x[a:b].mean() / 255 if b > a else 0.0 for a, b in zip(cuts, cuts[1:])])
            n = np.sqrt((v**2).sum())
            return (v / n if n else v).tolist()

        return batch.map(one)

    return embed(data)


def demo_embedding(text: Column, dim: int) -> Column:
    """A unit vector drawn from a text by SHA-256 in counter mode, eight numbers of 32 bits a block, each mapped to -1..1."""
    blocks = F.transform(F.sequence(F.lit(0), F.lit(-(-dim // 8) - 1)), lambda i: F.sha2(F.concat(text.cast("binary"), F.unhex(F.lpad(F.hex(i), 8, "0"))), 256))
    flat = F.flatten(F.transform(blocks, lambda h: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda j: F.conv(F.substr(h, j * 8 + 1, F.lit(8)), 16, 10).cast("double") / 2147483647.5 - 1)))
    return l2_normalise(F.slice(flat, 1, dim))


def image_caption(data: Column) -> Column:
    """brightness, contrast and texture of an image from its first 8,192 bytes; 'empty,unknown-contrast,unknown-texture' without any."""
    @F.pandas_udf("string")
    def caption_of(batch: pd.Series) -> pd.Series:
        def one(raw):
            if raw is None:
                return None
            x = np.frombuffer(raw[:8192], np.uint8).astype(float)
            if not len(x):
                return "empty,unknown-contrast,unknown-texture"
            step = np.abs(np.diff(x)).mean() if len(x) > 1 else 0.0
            light = "dark" if x.mean() < 85 else "bright" if x.mean() > 150 else "mid-tone"
            contrast = "high-contrast" if x.std() > 70 else "low-contrast" if x.std() < 20 else "medium-contrast"
            return ",".join([light, contrast, "striped" if step > 50 else "textured" if step > 15 else "smooth"])

        return batch.map(one)

    return caption_of(data)


def has_secret(payload: Column) -> Column:
    """Does a report's text look as if it held credentials?"""
    return payload.rlike(r"(?i)(api[_-]?key|secret|password|token|authorization)\"?\s*[:=]\s*\"?[^\s\",}]{4,}|AKIA[0-9A-Z]{16}|-----BEGIN [A-Z ]*PRIVATE KEY-----")


def urn(kind: Column, ident: Column, space: str = "fathom") -> Column:
    return F.concat(F.lit(f"urn:{space}:"), F.url_encode(kind), F.lit(":"), F.url_encode(ident))


def parse_urn(c: Column) -> tuple[Column, Column]:
    parts = F.split(c, ":")
    return F.url_decode(F.get(parts, F.lit(2))), F.url_decode(F.get(parts, F.lit(3)))


def caption(n: Column, topics: Column, nanos: Column) -> Column:
    return F.format_string("%d observations on %s over %s ms", n, F.array_join(topics, ", "), F.round(nanos / 1e6, 3).cast("string"))
