"""A small file format for recordings, so that there are files to read: a header that lists the channels, then their samples.

The header says where each channel's times and values are; a reader takes what it needs and leaves the rest.
"""

from __future__ import annotations

import json
import struct

import numpy as np
import pandas as pd

MAGIC = b"LOOMREC1"


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)


def write_recording(path: str, channels: list[dict]) -> None:
    """``channels``: name, unit, comment, time and value (arrays of equal length), and optionally invalid."""
    header, blocks, at = [], [], 0
    for c in channels:
        parts = [np.asarray(c["time"], "<i8"), np.asarray(c["value"], "<f8")]
        if c.get("invalid") is not None:
            parts.append(np.asarray(c["invalid"], np.uint8))
        header.append(
            {"name": c["name"], "unit": c["unit"], "comment": c.get("comment"), "n": len(parts[0]), "at": at, "marked": len(parts) > 2}
        )
        blocks += [p.tobytes() for p in parts]
        at += sum(map(len, blocks[-len(parts) :]))
    text = json.dumps(header).encode()
    store, name = _store(path)
    with store.open_output_stream(name) as f:
        f.write(MAGIC + struct.pack("<q", len(text)) + text + b"".join(blocks))


def _header(f) -> tuple[list[dict], int]:
    if f.read(8) != MAGIC:
        raise ValueError("not a recording")
    (size,) = struct.unpack("<q", f.read(8))
    return json.loads(f.read(size)), 16 + size


def recording_channels(path: str):
    """The channels of a file, from its header."""
    store, name = _store(path)
    with store.open_input_stream(name) as f:
        header, _ = _header(f)
    for i, c in enumerate(header):
        yield {"group_idx": 0, "channel_idx": i, "channel_name": c["name"], "unit": c["unit"], "sample_count": c["n"], "comment": c["comment"]}


class RecordingDecoder:
    """Reads pieces of channels by their place in the file; the last file stays open, as its next piece follows."""

    def __init__(self) -> None:
        self._path: str | None = None
        self._file = None
        self._header: list[dict] = []
        self._start = 0

    def __call__(self, path: str, group: int, channel: int, first: int, n: int) -> pd.DataFrame:
        if path != self._path:
            if self._file is not None:
                self._file.close()
            store, name = _store(path)
            self._file = store.open_input_file(name)
            self._header, self._start = _header(self._file)
            self._path = path
        c = self._header[channel]
        n = min(n, c["n"] - first)
        out = {}
        for i, (name, kind) in enumerate((("time", "<i8"), ("value", "<f8"))):
            self._file.seek(self._start + c["at"] + 8 * (i * c["n"] + first))
            out[name] = np.frombuffer(self._file.read(8 * n), kind)
        if c["marked"]:
            self._file.seek(self._start + c["at"] + 16 * c["n"] + first)
            out["invalid"] = np.frombuffer(self._file.read(n), np.uint8).astype(bool)
        return pd.DataFrame(out)
