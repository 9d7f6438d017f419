"""Typed fields of decoded messages, and decoders of payloads: JSON natively, CBOR and MessagePack by small readers of our own."""

from __future__ import annotations

import json
import math
import struct

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Schema names of known message types, and the type of each.
SCHEMAS = {
    "sensor_msgs/Imu": "imu_ros", "sensor_msgs/msg/Imu": "imu_ros", "IMU": "imu_json",
    "sensor_msgs/NavSatFix": "navsat", "sensor_msgs/msg/NavSatFix": "navsat", "foxglove.LocationFix": "navsat",
    "geometry_msgs/TwistStamped": "twist_stamped", "geometry_msgs/msg/TwistStamped": "twist_stamped", "geometry_msgs/Twist": "twist", "geometry_msgs/msg/Twist": "twist",
    "nav_msgs/Odometry": "odometry", "nav_msgs/msg/Odometry": "odometry", "foxglove.PoseInFrame": "pose_in_frame", "Pose": "pose_json",
    "sensor_msgs/Range": "range", "sensor_msgs/msg/Range": "range",
    "sensor_msgs/Image": "image", "sensor_msgs/msg/Image": "image", "sensor_msgs/CompressedImage": "image", "sensor_msgs/msg/CompressedImage": "image", "foxglove.CompressedImage": "image", "foxglove.CompressedVideo": "image",
    "sensor_msgs/PointCloud2": "cloud", "sensor_msgs/msg/PointCloud2": "cloud", "foxglove.PointCloud": "cloud",
    "radar_driver/RadarTracks": "radar", "diagnostic_msgs/DiagnosticArray": "diagnostic", "diagnostic_msgs/msg/DiagnosticArray": "diagnostic",
}
#: The modality of each type.
MODALITIES = {
    "imu_ros": "imu", "imu_json": "imu", "navsat": "gps", "twist_stamped": "twist", "twist": "twist", "odometry": "odometry", "pose_in_frame": "pose", "pose_json": "pose", "range": "range", "image": "image", "cloud": "pointcloud",
    "radar": "radar", "diagnostic": "diagnostic",
}


def _vec(path: str) -> list[tuple[str, float | None]]:
    return [(f"{path}.{c}", 0.0) for c in "xyz"]


def _quat(path: str) -> list[tuple[str, float | None]]:
    return [*_vec(path), (f"{path}.w", 1.0)]


#: The paths of each type's vectors, with what an absent one reads as (None: it must be there), and the objects that must be there.
STATE = {
    "imu_ros": (_quat("orientation") + _vec("angular_velocity") + _vec("linear_acceleration"), ["orientation", "angular_velocity", "linear_acceleration"]),
    "imu_json": (_quat("q") + _vec("rotation_rate") + _vec("linear_accel"), ["q", "rotation_rate", "linear_accel"]),
    "navsat": ([("latitude", None), ("longitude", None), ("altitude", 0.0)], []),
    "odometry": (_vec("pose.pose.position") + _quat("pose.pose.orientation"), ["pose.pose.position", "pose.pose.orientation"]),
    "pose_in_frame": (_vec("pose.position") + _quat("pose.orientation"), ["pose.position", "pose.orientation"]),
    "pose_json": (_vec("pos") + _quat("orientation"), ["pos", "orientation"]),
    "range": ([("range", None), ("min_range", 0.0), ("max_range", 0.0), ("field_of_view", 0.0)], []),
}
ACTION = {
    "twist_stamped": (_vec("twist.linear") + _vec("twist.angular"), ["twist.linear", "twist.angular"]),
    "twist": (_vec("linear") + _vec("angular"), ["linear", "angular"]),
    "odometry": (_vec("twist.twist.linear") + _vec("twist.twist.angular"), ["twist.twist.linear", "twist.twist.angular"]),
}
#: What tells a type by its fields where the schema's name doesn't, the most particular first; a field after ! must be absent.
SHAPES = [
    ("image", ["data", "width", "height", "encoding"]), ("cloud", ["data", "fields", "point_step"]), ("cloud", ["data", "fields", "point_stride"]), ("image", ["data", "format", "!is_key_frame"]),
    ("range", ["range", "radiation_type", "field_of_view", "min_range", "max_range"]), ("odometry", ["pose", "twist", "child_frame_id"]), ("pose_in_frame", ["pose.position", "pose.orientation", "frame_id"]),
    ("twist_stamped", ["twist.linear", "twist.angular"]), ("imu_ros", ["orientation", "angular_velocity", "linear_acceleration"]), ("imu_json", ["q", "rotation_rate", "linear_accel"]),
    ("navsat", ["latitude", "longitude", "altitude"]), ("pose_json", ["pos", "orientation"]), ("twist", ["linear", "angular"]),
]


def _there(v: Column, path: str) -> Column:
    return F.try_variant_get(v, f"$.{path}", "variant").isNotNull()


def _vector(v: Column, spec) -> Column:
    """The numbers at the paths, or null if an object that must be there isn't, or a value is no number."""
    paths, objects = spec
    good, numbers = F.lit(True), []
    for o in objects:
        good = good & _there(v, o)
    for path, absent in paths:
        x = F.try_variant_get(v, f"$.{path}", "double")
        good = good & (x.isNotNull() if absent is None else x.isNotNull() | ~_there(v, path))
        numbers.append(x if absent is None else F.coalesce(x, F.lit(absent)))
    return F.when(good, F.array(*numbers))


def typed_fields(df: DataFrame, schema: str = "schema", payload: str = "payload_json") -> DataFrame:
    """The rows with modality, state_vector and action_vector: by the schema's name, else by the shape of the JSON payload; nulls where neither tells."""
    v = F.try_parse_json(F.col(payload))
    shape = F.lit(None).cast("string")
    for kind, names in reversed(SHAPES):
        has = F.lit(True)
        for n in names:
            has = has & (~_there(F.col("__v"), n[1:]) if n[0] == "!" else _there(F.col("__v"), n))
        shape = F.when(has, kind).otherwise(shape)
    known = F.create_map(*[F.lit(x) for kv in SCHEMAS.items() for x in kv])
    rows = df.withColumn("__v", v).withColumn("__kind", F.coalesce(known[F.col(schema)], F.when(F.col("__v").isNotNull(), shape)))
    pick = lambda specs: F.coalesce(*[F.when(F.col("__kind") == k, _vector(F.col("__v"), s)) for k, s in specs.items()])
    named = F.create_map(*[F.lit(x) for kv in MODALITIES.items() for x in kv])
    return rows.withColumns({"modality": named[F.col("__kind")], "state_vector": pick(STATE), "action_vector": pick(ACTION)}).drop("__v", "__kind")


def sample_value(state: Column, action: Column, payload: Column) -> Column:
    """The numbers of a sample: its state vector, else its action vector, else the payload's number, list, or entry value, state or action."""
    v = F.try_parse_json(payload)
    one = lambda path: F.coalesce(F.try_variant_get(v, path, "array<double>"), F.when(F.try_variant_get(v, path, "double").isNotNull(), F.array(F.try_variant_get(v, path, "double"))))
    return F.coalesce(state, action, one("$"), one("$.value"), one("$.state"), one("$.action"))


class _Cut(ValueError):
    pass


def cbor(data: bytes):
    """The value of one CBOR item; ValueError if it is damaged or something is left over."""
    at = 0

    def take(n: int) -> bytes:
        nonlocal at
        if at + n > len(data):
            raise _Cut("cut off")
        at += n
        return data[at - n : at]

    def item(depth: int):
        if depth > 64:
            raise ValueError("too deep")
        head = take(1)[0]
        major, info = head >> 5, head & 31
        if major == 7:
            if info in (20, 21, 22, 23):
                return (False, True, None, None)[info - 20]
            if info in (25, 26, 27):
                return struct.unpack({25: ">e", 26: ">f", 27: ">d"}[info], take(1 << (info - 24)))[0]
            if info == 31:
                return _Cut  # the break that ends a list of unknown length
            raise ValueError(f"simple value {info}")
        n = info if info < 24 else int.from_bytes(take(1 << (info - 24)), "big") if info < 28 else None
        if n is None and (info != 31 or major in (0, 1, 6)):
            raise ValueError(f"length {info}")
        if major == 0:
            return n
        if major == 1:
            return -1 - n
        if major in (2, 3):
            if n is None:
                parts = []
                while (p := item(depth + 1)) is not _Cut:
                    parts.append(p)
                return (b"" if major == 2 else "").join(parts)
            return bytes(take(n)) if major == 2 else take(n).decode()
        if major == 6:
            return item(depth + 1)
        values = []
        while n is None or len(values) < n * (major - 3):
            if (x := item(depth + 1)) is _Cut:
                if n is not None:
                    raise ValueError("a break in a list of known length")
                break
            values.append(x)
        return values if major == 4 else dict(zip(map(str, values[::2]), values[1::2], strict=True))

    out = item(0)
    if at != len(data) or out is _Cut:
        raise ValueError("bytes are left over")
    return out


def msgpack(data: bytes):
    """The value of one MessagePack item; ValueError if it is damaged or something is left over."""
    at = 0

    def take(n: int) -> bytes:
        nonlocal at
        if at + n > len(data):
            raise _Cut("cut off")
        at += n
        return data[at - n : at]

    def number(n: int, signed: bool = False) -> int:
        return int.from_bytes(take(n), "big", signed=signed)

    def many(n: int, pairs: bool, depth: int):
        if not pairs:
            return [item(depth + 1) for _ in range(n)]
        return {str(item(depth + 1)): item(depth + 1) for _ in range(n)}

    def item(depth: int):
        if depth > 64:
            raise ValueError("too deep")
        h = take(1)[0]
        if h < 0x80:
            return h
        if h >= 0xE0:
            return h - 256
        if h < 0x90:
            return many(h & 15, True, depth)
        if h < 0xA0:
            return many(h & 15, False, depth)
        if h < 0xC0:
            return take(h & 31).decode()
        if h in (0xC0, 0xC2, 0xC3):
            return {0xC0: None, 0xC2: False, 0xC3: True}[h]
        if 0xC4 <= h <= 0xC6:
            return bytes(take(number(1 << (h - 0xC4))))
        if h in (0xCA, 0xCB):
            return struct.unpack(">f" if h == 0xCA else ">d", take(4 if h == 0xCA else 8))[0]
        if 0xCC <= h <= 0xCF:
            return number(1 << (h - 0xCC))
        if 0xD0 <= h <= 0xD3:
            return number(1 << (h - 0xD0), True)
        if 0xD9 <= h <= 0xDB:
            return take(number(1 << (h - 0xD9))).decode()
        if h in (0xDC, 0xDD):
            return many(number(2 if h == 0xDC else 4), False, depth)
        if h in (0xDE, 0xDF):
            return many(number(2 if h == 0xDE else 4), True, depth)
        raise ValueError(f"type {h:#x}")

    out = item(0)
    if at != len(data):
        raise ValueError("bytes are left over")
    return out


def _plain(x):
    """A value that JSON can hold: bytes as hex, numbers that aren't finite as null."""
    if isinstance(x, bytes):
        return x.hex()
    if isinstance(x, float) and not math.isfinite(x):
        return None
    if isinstance(x, dict):
        return {k: _plain(v) for k, v in x.items()}
    return [_plain(v) for v in x] if isinstance(x, list) else x


READERS = {"cbor": cbor, "msgpack": msgpack, "json": lambda b: json.loads(b)}


def decode_payloads(df: DataFrame, payload: str = "data", encoding: str = "encoding") -> DataFrame:
    """The rows with payload_json and decode_status: decoded, failed (damaged), or raw (no reader for the encoding). Never raises."""
    schema = T.StructType([*df.schema.fields, T.StructField("payload_json", T.StringType()), T.StructField("decode_status", T.StringType())])
    p, e = df.columns.index(payload), df.columns.index(encoding)

    def run(batches):
        for batch in batches:
            texts, states = [], []
            for data, kind in zip(batch.column(p), batch.column(e).to_pylist()):
                reader, text, state = READERS.get(kind), None, "raw"
                if reader and data.as_py() is not None:
                    try:
                        text, state = json.dumps(_plain(reader(data.as_py()))), "decoded"
                    except (ValueError, TypeError, OverflowError, RecursionError, struct.error):
                        state = "failed"
                texts.append(text)
                states.append(state)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string()), pa.array(states, pa.string())], names=schema.names)

    return df.mapInArrow(run, schema)
