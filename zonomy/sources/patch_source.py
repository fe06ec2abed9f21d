"""A Spark data source over trees of array files: ``<root>/<dataset>/.../patch_<id>.npy``.

``spark.read.format("npy_patches").option("mode", ...)`` gives the files (``files``), their shapes from the first bytes of each
(``shapes``), or their pixels (``pixels``). A filter on ``dataset`` leaves the other folders unread. The driver lists no
files: a partition is a share of one dataset's folder, by a checksum of the file name, and its task lists that folder.
Files are reached through Arrow's file systems, so any store that Arrow knows by its address will do.
"""

from __future__ import annotations

import io
import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

DATASETS = ("training", "validation", "testing", "unlabeled")
SCHEMAS = {
    "files": "dataset string, patch_id string, path string, length long",
    "shapes": "dataset string, patch_id string, h int, w int, length long, bytes_read long",
    "pixels": "dataset string, patch_id string, row int, col int, v array<double>",
}
#: Bytes that a header read asks for first; a longer header is read on.
HEAD = 128
#: Rows of an Arrow batch of files or shapes.
ROWS = 1024
_NAME = re.compile(r"patch_([^/]+)\.npy$")


def opened(address: str) -> tuple[fs.FileSystem, str]:
    """File system and path of an address; a path without scheme is local."""
    address = re.sub(r"^file:/+", "/", address)
    return (fs.LocalFileSystem(), address) if address.startswith("/") else fs.FileSystem.from_uri(address)


def header_shape(file: pa.NativeFile) -> tuple[tuple[int, ...], int]:
    """(shape, bytes read) of an array file from its header alone."""
    head = file.read(HEAD)
    size = 10 + int.from_bytes(head[8:10], "little") if head[6] == 1 else 12 + int.from_bytes(head[8:12], "little")
    if size > len(head):
        head += file.read(size - len(head))
    f = io.BytesIO(head)
    read = np.lib.format.read_array_header_1_0 if np.lib.format.read_magic(f) == (1, 0) else np.lib.format.read_array_header_2_0
    return read(f)[0], len(head)


class Share(InputPartition):
    def __init__(self, dataset: str, part: int, parts: int):
        self.dataset, self.part, self.parts = dataset, part, parts


class PatchReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.mode = options["path"].rstrip("/"), options.get("mode", "files")
        self.parts, self.datasets = int(options.get("parts", "8")), set(DATASETS)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("dataset",):
                self.datasets &= {f.value} if isinstance(f, EqualTo) else set(f.value)
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        return [Share(d, k, self.parts) for d in DATASETS if d in self.datasets for k in range(self.parts)]

    def _files(self, share: Share) -> Iterator[tuple[fs.FileSystem, fs.FileInfo, str]]:
        store, root = opened(f"{self.root}/{share.dataset}")
        for info in store.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive=True)):
            name = _NAME.search(info.path)
            if info.is_file and name and zlib.crc32(name[0].encode()) % share.parts == share.part:
                yield store, info, name[1]

    def read(self, share: Share) -> Iterator[pa.RecordBatch]:
        if self.mode == "pixels":
            for store, info, name in self._files(share):
                with store.open_input_file(info.path) as f:
                    a = np.load(io.BytesIO(f.read())).astype(np.float64)
                c, h, w = a.shape
                n = h * w
                v = pa.ListArray.from_arrays(pa.array(np.arange(0, n * c + 1, c), pa.int32()), pa.array(a.reshape(c, n).T.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array([share.dataset] * n), pa.array([name] * n), pa.array(np.repeat(np.arange(h, dtype=np.int32), w)), pa.array(np.tile(np.arange(w, dtype=np.int32), h)), v],
                                                 names=["dataset", "patch_id", "row", "col", "v"])
            return
        rows: list[dict] = []
        kind = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
        schema = pa.schema([(f.split()[0], kind[f.split()[1]]) for f in SCHEMAS[self.mode].split(", ")])
        for store, info, name in self._files(share):
            row = {"dataset": share.dataset, "patch_id": name, "path": info.path, "length": info.size}
            if self.mode == "shapes":
                with store.open_input_file(info.path) as f:
                    shape, row["bytes_read"] = header_shape(f)
                row["h"], row["w"] = shape[-2], shape[-1]
            rows.append(row)
            if len(rows) == ROWS:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


class NpyPatches(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npy_patches"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("mode", "files")]

    def reader(self, schema) -> PatchReader:
        return PatchReader(dict(self.options))


def read_patches(spark: SparkSession, root: str, mode: str = "files", parts: int = 8) -> DataFrame:
    """The files, shapes or pixels below ``root``; filters on ``dataset`` choose folders before anything is listed."""
    spark.dataSource.register(NpyPatches)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("npy_patches").option("mode", mode).option("parts", str(parts)).load(root)


def write_patches(df: DataFrame, root: str, dtype: str = "<f4") -> DataFrame:
    """Write (dataset, patch_id, h, w, data: array by channel, row, column) as one array file per row; returns (dataset, n) of what
    was written. A repeated task writes the same files again."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                store, folder = opened(f"{root.rstrip('/')}/{r.dataset}/patches")
                store.create_dir(folder, recursive=True)
                buffer = io.BytesIO()
                np.save(buffer, np.asarray(r.data, dtype).reshape(-1, r.h, r.w))
                with store.open_output_stream(f"{folder}/patch_{r.patch_id}.npy") as f:
                    f.write(buffer.getvalue())
            yield pdf[["dataset"]].assign(n=1)

    done = df.select("dataset", "patch_id", "h", "w", "data").mapInPandas(run, "dataset string, n long")
    return done.groupBy("dataset").sum("n").withColumnRenamed("sum(n)", "n")
