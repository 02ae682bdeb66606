"""Named numpy arrays in one file of the shared folder, memory-mapped for reading."""

from __future__ import annotations

import json
import mmap
import os
import tempfile
import uuid

import numpy as np

_open: dict[str, dict[str, np.ndarray]] = {}


def _local(folder: str) -> str | None:
    if folder.startswith("file:"):
        return "/" + folder[5:].lstrip("/")
    return folder if "://" not in folder else None


def save(folder: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    """Written under a name of its own and then renamed, so that a repeated task does no harm."""
    head, at = {}, 0
    for k, a in arrays.items():
        head[k] = [a.dtype.str, len(a), at]
        at += -(-a.nbytes // 8) * 8
    text = json.dumps(head).encode()
    text += b" " * (-(len(text) + 8) % 8)

    def put(f) -> None:
        f.write(len(text).to_bytes(8, "little") + text)
        for a in arrays.values():
            f.write(np.ascontiguousarray(a).data)
            f.write(b"\0" * (-a.nbytes % 8))

    if (here := _local(folder)) is not None:
        os.makedirs(here, exist_ok=True)
        own = f"{here}/.{name}.{uuid.uuid4().hex}"
        with open(own, "wb") as f:
            put(f)
        os.replace(own, f"{here}/{name}")
    else:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        own = f"{base}/.{name}.{uuid.uuid4().hex}"
        with store.open_output_stream(own) as f:
            put(f)
        store.move(own, f"{base}/{name}")


def load(folder: str, name: str) -> dict[str, np.ndarray]:
    """The file's arrays over a memory map. A store without local paths gives a copy that is unlinked once mapped; only one such is kept."""
    key = f"{folder}/{name}"
    if key not in _open:
        if (here := _local(folder)) is not None:
            with open(f"{here}/{name}", "rb") as f:
                data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
            for old in [k for k in _open if not k.startswith(folder)]:
                del _open[old]
        else:
            from pyarrow import fs

            store, base = fs.FileSystem.from_uri(folder)
            with tempfile.TemporaryFile() as f, store.open_input_stream(f"{base}/{name}") as source:
                while chunk := source.read(1 << 24):
                    f.write(chunk)
                f.flush()
                data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
            _open.clear()
        n = int.from_bytes(data[:8], "little")
        _open[key] = {k: np.frombuffer(data, np.dtype(t), m, 8 + n + at) for k, (t, m, at) in json.loads(data[8 : 8 + n]).items()}
    return _open[key]
