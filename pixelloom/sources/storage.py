"""Files by their addresses, opened where the work is: on the driver for folders, in tasks for what lies in them."""

from __future__ import annotations

from pyarrow import fs


def opened(address: str) -> tuple[fs.FileSystem, str]:
    """The file system of an address (``file:``, ``hdfs:``, ``viewfs:``, ``s3:``, ``gs:`` or a plain path) and the path in it."""
    if "://" in address:
        system, path = fs.FileSystem.from_uri(address)
    else:
        system, path = fs.LocalFileSystem(), address.removeprefix("file:")
    return system, path.rstrip("/") or "/"


def exists(system: fs.FileSystem, path: str) -> bool:
    return system.get_file_info(path).type != fs.FileType.NotFound


def removed(system: fs.FileSystem, path: str, tries: int = 5) -> None:
    """Delete a file or a folder that others may be deleting, too."""
    for k in range(tries):
        kind = system.get_file_info(path).type
        if kind == fs.FileType.NotFound:
            return
        try:
            system.delete_dir(path) if kind == fs.FileType.Directory else system.delete_file(path)
        except OSError:
            if k == tries - 1 and exists(system, path):
                raise


class Counted:
    """A seekable file that counts the bytes that are read from it."""

    def __init__(self, file):
        self.file, self.bytes = file, 0

    def read(self, n: int = -1) -> bytes:
        found = self.file.read(n) if n >= 0 else self.file.read()
        self.bytes += len(found)
        return found

    def seek(self, at: int, whence: int = 0) -> int:
        return self.file.seek(at, whence)

    def tell(self) -> int:
        return self.file.tell()

    def seekable(self) -> bool:
        return True
