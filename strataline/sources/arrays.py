"""Array containers without further packages: Zarr v2 folders, classic NetCDF files, MiniSEED records."""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import functions as F

from strataline.frame import SignalFrame
from strataline.sources import parts
from strataline.sources.formats import FORMATS, Format, Places, Scan, opened


def _place(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def _bytes(path: str) -> bytes | None:
    try:
        with opened(path) as f:
            return f.read()
    except OSError:
        return None


class Zarr(Format):
    """Zarr v2: the array ``data``, ``strain`` or the folder itself, of (time, channel) chunks; zstd, zlib, gzip or plain."""

    name, extensions, priority = "ZARR", (".zarr",), 35

    def _array(self, path: str) -> tuple[str, dict, dict]:
        for p in (f"{path}/data", f"{path}/strain", path):
            raw = _bytes(f"{p}/.zarray")
            if raw:
                attrs = json.loads(_bytes(f"{path}/.zattrs") or b"{}") | json.loads(_bytes(f"{p}/.zattrs") or b"{}")
                return p, json.loads(raw), attrs
        raise ValueError(f"{path} holds no array")

    def can_read(self, path: str) -> bool:
        return path.rstrip("/").lower().endswith(self.extensions) or _bytes(f"{path}/.zarray") is not None

    def scan(self, path: str, **_) -> Scan:
        _, meta, attrs = self._array(path)
        return Scan(path, self.name, *meta["shape"], float(attrs.get("fs", 1000.0)), float(attrs.get("dx", 1.0)), data_unit=attrs.get("units"), attrs={k: str(v) for k, v in attrs.items()})

    @staticmethod
    def _inflate(raw: bytes, compressor: dict | None) -> bytes:
        kind = (compressor or {}).get("id")
        if kind is None:
            return raw
        if kind == "zstd":
            return zstandard.ZstdDecompressor().decompressobj().decompress(raw)
        if kind in ("zlib", "gzip"):
            return zlib.decompress(raw, 47)
        import numcodecs  # other codecs need this package

        return numcodecs.get_codec(compressor).decode(raw)

    def block(self, path: str, start: int, stop: int, **_) -> np.ndarray:
        return self._chunks(path, start, stop, None)

    def cells(self, path: str, start: int, stop: int, channels: np.ndarray, **_) -> np.ndarray:
        return self._chunks(path, start, stop, channels)[:, channels]

    def _chunks(self, path: str, start: int, stop: int, channels: np.ndarray | None) -> np.ndarray:
        """Samples of all channels; only the chunks of those wanted are read."""
        place, meta, _ = self._array(path)
        (n, c), (h, w) = meta["shape"], meta["chunks"]
        wanted = range(-(-c // w)) if channels is None else np.unique(channels // w).tolist()
        out = np.full((stop - start, c), np.nan if meta["fill_value"] in (None, "NaN") else meta["fill_value"], float)
        dot = meta.get("dimension_separator", ".")
        for i in range(start // h, -(-stop // h)):
            for j in wanted:
                raw = _bytes(f"{place}/{i}{dot}{j}")
                if raw is None:
                    continue
                x = np.frombuffer(self._inflate(raw, meta["compressor"]), meta["dtype"]).reshape((h, w), order=meta["order"])
                a, b = max(start, i * h), min(stop, (i + 1) * h, n)
                out[a - start : b - start, j * w : (j + 1) * w] = x[a - i * h : b - i * h, : c - j * w]
        return out


def write_zarr(frame: SignalFrame, path: str, samples: int = 10_000, channels: int = 64) -> None:
    """A frame as a Zarr folder; every chunk is written by the task that holds it, whole or not at all.

    The array's description comes last: a folder that a failed job left is no Zarr array.
    """
    n, c = frame.shape
    fs, place = _place(path)
    fs.create_dir(f"{place}/data", recursive=True)
    if _bytes(f"{path}/data/.zarray") is not None:
        raise ValueError(f"{path} holds an array already")
    compressor = {"id": "zstd", "level": 3}
    meta = {"zarr_format": 2, "shape": [n, c], "chunks": [samples, channels], "dtype": "<f8", "compressor": compressor, "fill_value": "NaN", "order": "C", "filters": None}
    def put(key, rows):
        i, j = (int(k) for k in key)
        x = np.full((samples, channels), np.nan)
        x[rows["ti"].to_numpy() - i * samples, rows["ch"].to_numpy() - j * channels] = rows["v"].to_numpy(float)
        own, where = _place(path)
        made = f"{where}/data/.{i}.{j}.{uuid.uuid4().hex}"  # a second attempt at the task may run beside the first
        with own.open_output_stream(made) as f:
            f.write(zstandard.compress(x.astype("<f8").tobytes(), 3))
        own.move(made, f"{where}/data/{i}.{j}")
        return pd.DataFrame({"i": [i], "j": [j]})

    keyed = frame.df.select("ch", "ti", "v", F.floor(F.col("ti") / samples).alias("i"), F.floor(F.col("ch") / channels).alias("j"))
    keyed.groupBy("i", "j").applyInPandas(put, "i long, j long").count()
    for name, what in ((".zgroup", {"zarr_format": 2}), (".zattrs", {"fs": frame.fs, "dx": frame.dx, "units": frame.unit}), ("data/.zarray", meta)):
        with fs.open_output_stream(f"{place}/{name}") as f:
            f.write(json.dumps(what).encode())


class NetCdf(Format):
    """Classic NetCDF (CDF-1, CDF-2): the first two-dimensional variable of fixed size."""

    name, extensions, priority = "NETCDF", (".nc", ".cdf"), 40
    KINDS = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8"}

    def _head(self, path: str) -> tuple[dict, tuple[int, int], str, int]:
        with opened(path) as f:
            raw = f.read(1 << 20)
        if raw[:3] != b"CDF" or raw[3] not in (1, 2):
            raise ValueError(f"{path} is no classic NetCDF file")
        at = 8

        def number() -> int:
            nonlocal at
            at += 4
            return struct.unpack_from(">i", raw, at - 4)[0]

        def text() -> str:
            nonlocal at
            n = number()
            at += -(-n // 4) * 4
            return raw[at - -(-n // 4) * 4 :][:n].decode()

        def attributes() -> dict:
            nonlocal at
            number()
            out = {}
            for _ in range(number()):
                key, kind, n = text(), number(), number()
                size = n * np.dtype(self.KINDS[kind]).itemsize
                body = raw[at : at + size]
                at += -(-size // 4) * 4
                out[key] = body.decode() if kind == 2 else np.frombuffer(body, self.KINDS[kind]).astype(float)[0]
            return out

        number()
        dims = [(text(), number()) for _ in range(number())]
        attrs = attributes()
        number()
        for _ in range(number()):
            text()
            ids = [number() for _ in range(number())]
            own = attributes()
            kind, _, begin = number(), number(), number()
            if raw[3] == 2:
                begin = (begin << 32) + (number() & 0xFFFFFFFF)
            if len(ids) == 2 and kind != 2 and dims[ids[0]][1]:
                return attrs | own, (dims[ids[0]][1], dims[ids[1]][1]), self.KINDS[kind], begin
        raise ValueError(f"{path} has no two-dimensional variable")

    def scan(self, path: str, **_) -> Scan:
        attrs, shape, _, _ = self._head(path)
        return Scan(path, self.name, *shape, float(attrs.get("fs", 1000.0)), float(attrs.get("dx", 1.0)), data_unit=attrs.get("units"), attrs={k: str(v) for k, v in attrs.items()})

    def block(self, path: str, start: int, stop: int, **_) -> np.ndarray:
        _, (_, c), kind, begin = self._head(path)
        width = c * np.dtype(kind).itemsize
        with opened(path) as f:
            f.seek(begin + start * width)
            return np.frombuffer(f.read((stop - start) * width), kind).reshape(-1, c).astype(float)


def write_netcdf(frame: SignalFrame, path: str) -> None:
    """A frame as a classic NetCDF file; tasks write its parts."""
    rows, n, c = parts.shaped(frame.df)
    parts.write(parts.by_time(rows, c), [path], n * c, n * c, _doubles, head=partial(_netcdf_head, n, c, frame.fs, frame.dx))


def _doubles(first: int, x: np.ndarray) -> bytes:
    return x.astype(">f8").tobytes()


def _netcdf_head(n: int, c: int, fs: float, dx: float) -> Iterator[bytes]:
    text = lambda s: struct.pack(">i", len(s)) + s.encode().ljust(-(-len(s) // 4) * 4, b"\0")
    attrs = b"".join(text(k) + struct.pack(">iid", 6, 1, v) for k, v in (("fs", fs), ("dx", dx)))
    head = b"CDF\x02" + struct.pack(">i", 0) + struct.pack(">ii", 10, 2) + text("time") + struct.pack(">i", n) + text("distance") + struct.pack(">i", c)
    head += struct.pack(">ii", 12, 2) + attrs + struct.pack(">ii", 11, 1) + text("data") + struct.pack(">iii", 2, 0, 1) + struct.pack(">ii", 0, 0) + struct.pack(">ii", 6, min(8 * n * c, 2**31 - 1))
    yield head + struct.pack(">q", len(head) + 8)


#: Differences in a word by (version, code, upper two bits of the word): how many, and of how many bits. (fixed values)
STEIM = {(1, 1, None): (4, 8), (1, 2, None): (2, 16), (1, 3, None): (1, 32), (2, 1, None): (4, 8), (2, 2, 1): (1, 30), (2, 2, 2): (2, 15), (2, 2, 3): (3, 10), (2, 3, 0): (5, 6), (2, 3, 1): (6, 5), (2, 3, 2): (7, 4)}


def _steim(frames: np.ndarray, n: int, version: int) -> np.ndarray:
    """Samples of Steim-compressed frames (rows of 16 words)."""
    words = frames.astype(np.int64)
    first = int(np.int32(words[0, 1] - (1 << 32) if words[0, 1] >> 31 else words[0, 1]))
    code = (words[:, :1] >> (30 - 2 * np.arange(16))) & 3
    code[:, 0] = 0
    diffs = np.zeros((words.size, 7), np.int64)
    counts = np.zeros(words.size, np.int64)
    flat, codes = words.ravel(), code.ravel()
    for (v, c, upper), (count, bits) in STEIM.items():
        if v != version:
            continue
        mine = np.flatnonzero((codes == c) & (True if upper is None else flat >> 30 == upper))
        x = (flat[mine, None] >> (bits * (count - 1 - np.arange(count)))) & ((1 << bits) - 1)
        diffs[mine, :count] = np.where(x >> (bits - 1), x - (1 << bits), x)
        counts[mine] = count
    d = diffs[np.arange(7) < counts[:, None]][:n]
    d[0] = first  # the first difference leads to the sample before the record
    return np.cumsum(d)


class MiniSeed(Format):
    """MiniSEED 2: a channel per stream; gaps are filled by straight lines, channels cut to the time that all have."""

    name, extensions, priority = "MINISEED", (".mseed", ".miniseed"), 50
    by_channel = True
    PLAIN = {1: "i2", 3: "i4", 4: "f4", 5: "f8"}

    def _records(self, path: str) -> dict[str, np.ndarray]:
        """Headers alone: stream, start, rate, samples, byte order, coding, and where the data stand.

        Records that are built like the one before them are read and taken apart together.
        """
        out: list[dict[str, np.ndarray]] = []
        with opened(path) as f:
            size, at, ahead = f.size(), 0, 1
            while at + 48 <= size:
                f.seek(at)
                raw = f.read(256)
                big = 1900 <= struct.unpack_from(">H", raw, 20)[0] <= 2100
                order = ">" if big else "<"
                u = lambda kind, p: struct.unpack_from(order + kind, raw, p)[0]  # noqa: B023, E731
                block, coding, length, chain = u("H", 46), 11, 4096, 0
                first = block
                while block and block + 8 <= len(raw):
                    kind, nxt = u("H", block), u("H", block + 2)
                    if kind == 1000:
                        coding, length = raw[block + 4], 1 << raw[block + 6]
                    block, chain = nxt, chain + 1
                x = np.frombuffer(raw[:48], "u1")[None]
                if chain == 1 and u("H", first) == 1000 and first + 8 <= length and ahead > 1:
                    f.seek(at)
                    more = f.read(ahead * length)
                    more = np.frombuffer(more, "u1", len(more) // length * length).reshape(-1, length)
                    year = more[:, 20:22].copy().view(">u2")[:, 0]
                    like = (((year >= 1900) & (year <= 2100)) == big) & (more[:, 44:48] == x[:, 44:48]).all(1) & (more[:, first : first + 8] == np.frombuffer(raw, "u1")[first : first + 8]).all(1)
                    n_like = len(like) if like.all() else int(np.argmin(like))
                    ahead = ahead * 2 if n_like == len(like) else 1
                    x = more[:n_like, :48] if n_like else x
                else:
                    ahead = 2
                ahead = max(1, min(ahead, (16 << 20) // length))
                places = at + length * np.arange(len(x))
                out.append(self._heads(x, order) | {"big": np.full(len(x), int(big)), "coding": np.full(len(x), coding), "end": places + length})
                out[-1]["begin"] += places
                at += length * len(x)
        found = {k: np.concatenate([h[k] for h in out]) for k in out[0]} if out else {}
        used = {k: v[found["n"] > 0] for k, v in found.items()}
        if not used or not len(used["n"]):
            raise ValueError(f"{path} has no data records")
        for coding in np.unique(used["coding"]).tolist():
            if coding not in self.PLAIN and coding not in (10, 11):
                raise ValueError(f"{path}: encoding {coding} is not known here")
        return used

    @staticmethod
    def _heads(x: np.ndarray, order: str) -> dict[str, np.ndarray]:
        """Fixed headers (rows of bytes) in one byte order."""
        u = lambda kind, p: np.ascontiguousarray(x[:, p : p + 2]).view(order + kind)[:, 0].astype(np.int64)
        year = (u("u2", 20) - 1970).astype("datetime64[Y]").astype("datetime64[s]").astype(np.int64)
        hour, minute, second = (x[:, p].astype(np.int64) for p in (24, 25, 26))
        start = (year + (u("u2", 22) - 1) * 86400 + hour * 3600 + minute * 60 + second) + u("u2", 28) * 1e-4
        factor, multiplier = (np.where(k > 0, k, -1 / np.where(k, k, np.nan)) for k in (u("i2", 32), u("i2", 34)))
        stream = np.ascontiguousarray(x[:, 8:20]).view("S12")[:, 0]
        return {"stream": stream, "start": start, "rate": factor * multiplier, "n": u("u2", 30), "begin": u("u2", 44)}

    def _decode(self, body: bytes, n: int, order: str, coding: int) -> np.ndarray:
        if coding in self.PLAIN:
            return np.frombuffer(body, order + self.PLAIN[coding])[:n].astype(float)
        words = np.frombuffer(body[: len(body) // 64 * 64], order + "u4").reshape(-1, 16)
        return _steim(words, n, coding - 9).astype(float)

    def _plan(self, path: str) -> tuple[Places, float, float, int]:
        """Records of each stream (place of the first sample on the common axis, samples, byte order, coding, bytes); rate, start and length of that axis."""
        return self._kept(path, self._planned)

    def _planned(self, path: str) -> tuple[Places, float, float, int]:
        r = self._records(path)
        codes, code = np.unique(r["stream"], return_inverse=True)
        split = ((k[10:12], k[0:5], k[5:7], k[7:10]) for k in (bytes(c).ljust(12, b"\0") for c in codes))
        names = [".".join(p.decode().strip() for p in words) for words in split]
        number = {name: i for i, name in enumerate(sorted(set(names)))}
        stream = np.array([number[name] for name in names])[code]
        rate = float(r["rate"][0])
        if not np.isfinite(rate) or not rate:
            raise ValueError(f"{path} has no sampling rate")
        begins, ends = np.full(len(number), np.inf), np.full(len(number), -np.inf)
        np.minimum.at(begins, stream, r["start"])
        np.maximum.at(ends, stream, r["start"] + r["n"] / rate)
        first = float(begins.max())
        n = int(np.rint((ends - first) * rate).min())
        place = np.rint((r["start"] - first) * rate).astype(np.int64)
        order = np.lexsort((r["begin"], r["n"], place, stream))
        rows = np.stack([place, r["n"], r["big"], r["coding"], r["begin"], r["end"]], 1)[order]
        return Places(np.concatenate(([0], np.cumsum(np.bincount(stream, minlength=len(number))))), rows), rate, first, max(n, 0)

    def scan(self, path: str, dx: float = 1.0, **_) -> Scan:
        by, rate, first, n = self._plan(path)
        return Scan(path, self.name, n, len(by.first) - 1, rate, float(dx), start_time=str(pd.Timestamp(round(first * 1e6), unit="us")))

    def places(self, path: str, channels: np.ndarray) -> Places:
        return self._plan(path)[0].of(channels)

    def block(self, path: str, start: int, stop: int, **_) -> np.ndarray:
        return self.cells(path, start, stop, None)

    def cells(self, path: str, start: int, stop: int, channels: np.ndarray | None, places: Places | None = None, **_) -> np.ndarray:
        """Only records that touch the range, and the nearest on either side of it for the lines over gaps, are decoded."""
        if places is None:
            places = self._plan(path)[0] if channels is None else self.places(path, channels)
        first = places.first.tolist()
        out = np.empty((stop - start, len(first) - 1))
        with opened(path) as f:
            for i, (a, b) in enumerate(zip(first, first[1:])):
                records = places.rows[a:b]
                began, ended = np.flatnonzero(records[:, 0] <= start), np.flatnonzero(records[:, 0] + records[:, 1] >= stop)
                before = int(began[-1]) if len(began) else 0
                after = int(ended[0]) if len(ended) else len(records) - 1
                at, values = [], []
                for place, n, big, coding, begin, end in records[min(before, after) : max(before, after) + 1].tolist():
                    f.seek(begin)
                    values.append(self._decode(f.read(end - begin), n, ">" if big else "<", coding))
                    at.append(place)
                if len(at) == 1 and at[0] <= start and at[0] + len(values[0]) >= stop:
                    out[:, i] = values[0][start - at[0] : stop - at[0]]
                else:
                    out[:, i] = np.interp(np.arange(start, stop), np.concatenate([p + np.arange(len(v)) for p, v in zip(at, values)]), np.concatenate(values))
        return out


CONTAINERS = (Zarr(), NetCdf(), MiniSeed())
for _fmt in CONTAINERS:
    FORMATS.register(_fmt)
import strataline.sources.tdms  # noqa: E402, F401 - registers itself
