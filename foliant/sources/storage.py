"""File systems as executors see them: what an address names, through pyarrow."""

from __future__ import annotations

from pyarrow import fs


def resolve(path: str) -> tuple[fs.FileSystem, str]:
    """File system and name of an address as Hadoop writes it (file:/, s3a:// and others); without a scheme it is local."""
    scheme, _, rest = path.partition(":")
    if not rest or "/" in scheme:
        return fs.LocalFileSystem(), path
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}:{rest}")
