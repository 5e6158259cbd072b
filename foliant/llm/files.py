"""Binary files of the shared folder, read and written by executors through the file system its address names."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs


def resolve(path: str) -> tuple[fs.FileSystem, str]:
    """File system and name of an address as Hadoop writes it (file:/, s3a:// and others); without a scheme it is local."""
    scheme, _, rest = path.partition(":")
    if not rest or "/" in scheme:
        return fs.LocalFileSystem(), path
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}:{rest}")


def save_table(path: str, table: pa.Table) -> None:
    """One Parquet file of sorted keys (key) and numbers (value)."""
    system, name = resolve(path)
    system.create_dir(name.rsplit("/", 1)[0], recursive=True)
    pq.write_table(table, name, filesystem=system, compression="zstd", use_dictionary=False, column_encoding={"key": "DELTA_BINARY_PACKED", "value": "BYTE_STREAM_SPLIT"})


def read_table(path: str, columns: list[str]) -> pa.Table:
    """Columns of a Parquet file, or of a folder that Spark has written."""
    system, name = resolve(path)
    if name.endswith(".parquet"):
        return pq.read_table(name, columns=columns, filesystem=system)
    parts = [f for f in system.get_file_info(fs.FileSelector(name)) if f.is_file and f.base_name.endswith(".parquet")]
    return pa.concat_tables([pq.read_table(f.path, columns=columns, filesystem=system) for f in sorted(parts, key=lambda f: f.path)])
