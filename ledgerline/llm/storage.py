"""Files of our own formats in a shared folder, written and read inside tasks."""

from __future__ import annotations

import uuid

from pyarrow import fs


def place(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder or file named by URI (file:, hdfs:, s3:, gs:) or absolute path."""
    return fs.FileSystem.from_uri(uri if ":" in uri else f"file://{uri}")


class NewFile:
    """A file under a name no other attempt uses; a task that is run again leaves at most a file that no manifest names."""

    def __init__(self, folder: str, stem: str, suffix: str):
        where, path = place(folder)
        where.create_dir(path, recursive=True)
        name = f"{stem}-{uuid.uuid4().hex[:12]}{suffix}"
        self.uri, self.size = f"{folder}/{name}", 0
        self._out = where.open_output_stream(f"{path}/{name}", compression=None)  # else a suffix as .zst compresses once more

    def write(self, data) -> int:
        self._out.write(data)
        self.size += len(data)
        return len(data)

    def flush(self) -> None:
        self._out.flush()

    @property
    def closed(self) -> bool:
        return self._out.closed

    def close(self) -> None:
        self._out.close()
