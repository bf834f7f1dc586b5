"""A data source of scenes stored as band files: format ``band_files``, for reading and writing.

A scene is a folder ``<product_id>.data`` of images ``<kind>_<band>.img``, one band each, with text headers of the same
stem.  Rows are image lines.  Reading plans from the listing alone: pieces of files are packed into partitions of about
``partBytes``; a choice of products, kinds and bands drops files before any is opened, one of wavelengths and lines drops
files and lines in the tasks.  Writing has two phases: tasks write under ``_staging-<job>``, which readers pass over, and
the commit moves whole scenes into place; an abort removes the staging folder, and attempts that were lost or repeated
leave nothing, as only files that a successful attempt reports are moved.

Files are opened with Arrow's file systems by URI, so that drivers and executors read the same store.
"""

from __future__ import annotations

import json
import os
import posixpath
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, field
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import datasource as ds
from pyspark.sql.types import StructType

from .products import ENVI_TYPES

FORMAT = "band_files"
SCHEMA = "product_id string, kind string, band int, wavelength double, y int, samples array<double>"
PART_BYTES, BATCH_LINES, SUFFIX, STAGING = 16 << 20, 512, ".data", "_staging-"


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    if urlsplit(path).scheme in ("", "file"):
        return pafs.LocalFileSystem(), os.path.abspath(urlsplit(path).path)
    return pafs.FileSystem.from_uri(path)


def parse_header(text: str) -> dict[str, str]:
    """Fields of a header by lower-case name, without braces."""
    pairs = (line.split("=", 1) for line in text.splitlines() if "=" in line)
    return {k.strip().lower(): v.strip().strip("{}").strip() for k, v in pairs}


@dataclass(frozen=True)
class Piece:
    """Part ``k`` of ``n`` equal parts of a band file's lines."""

    product_id: str
    kind: str
    band: int
    path: str
    k: int
    n: int


class Part(ds.InputPartition):
    def __init__(self, pieces: Sequence[Piece]) -> None:
        self.pieces = list(pieces)


@dataclass(frozen=True)
class Choice:
    """What to read: names and numbers to keep, and inclusive spans of lines and wavelengths; None keeps all."""

    products: list[str] | None = None
    kinds: list[str] | None = None
    bands: list[int] | None = None
    lines: tuple[int, int] | None = None
    wavelengths: tuple[float, float] | None = None

    def by_name(self, product: str, kind: str, band: int) -> bool:
        return all(keep is None or v in keep for keep, v in ((self.products, product), (self.kinds, kind), (self.bands, band)))

    def by_header(self, wavelength: float | None) -> bool:
        return self.wavelengths is None or wavelength is not None and self.wavelengths[0] <= wavelength <= self.wavelengths[1]

    def of(self, first: int, end: int) -> tuple[int, int]:
        """The chosen lines of [first, end), as such a span."""
        return (first, end) if self.lines is None else (max(first, self.lines[0]), min(end, self.lines[1] + 1))


class Reader(ds.DataSourceReader):
    def __init__(self, path: str, part_bytes: int, choice: Choice) -> None:
        self.path, self.part_bytes, self.choice = path, part_bytes, choice

    def partitions(self) -> list[Part]:
        store, root = _store(self.path)
        files = [f for f in store.get_file_info(pafs.FileSelector(root, recursive=True)) if f.type == pafs.FileType.File and f.path.endswith(".img")]
        parts: list[Part] = []
        held: list[Piece] = []
        size = 0
        for f in sorted(files, key=lambda f: f.path):
            inside = posixpath.relpath(f.path, root).split("/")
            if any(p.startswith(("_", ".")) and p != "." for p in inside):
                continue
            kind, _, band = posixpath.splitext(f.base_name)[0].rpartition("_")
            product = posixpath.basename(posixpath.dirname(f.path)).removesuffix(SUFFIX)
            if not kind or not band.isdigit() or not self.choice.by_name(product, kind, int(band)):
                continue
            n = max(1, -(-f.size // self.part_bytes))
            for k in range(n):
                if held and size + f.size // n > self.part_bytes:
                    parts.append(Part(held))
                    held, size = [], 0
                held.append(Piece(product, kind, int(band), f.path, k, n))
                size += f.size // n
        return [*parts, Part(held)] if held or not parts else parts

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        store, _ = _store(self.path)
        for piece in partition.pieces:
            with store.open_input_stream(piece.path.removesuffix(".img") + ".hdr") as f:
                head = parse_header(f.read().decode("utf-8", "replace"))
            if int(head.get("bands", "1")) != 1:
                raise ValueError(f"{piece.path}: a band file has one band")
            wavelength = float(head["wavelength"].split(",")[0]) if head.get("wavelength") else None
            if not self.choice.by_header(wavelength):
                continue
            kind = np.dtype((">" if head.get("byte order", "0") == "1" else "<") + ENVI_TYPES[head["data type"]])
            samples, lines = int(head["samples"]), int(head["lines"])
            gain, offset = (float(head.get(f"data {n} values", d).split(",")[0]) for n, d in (("gain", "1"), ("offset", "0")))
            first, end = self.choice.of(lines * piece.k // piece.n, lines * (piece.k + 1) // piece.n)
            with store.open_input_file(piece.path) as f:
                for lo in range(first, end, BATCH_LINES):
                    own = np.arange(lo, min(end, lo + BATCH_LINES))
                    raw = f.read_at(len(own) * samples * kind.itemsize, int(head.get("header offset", "0")) + lo * samples * kind.itemsize)
                    values = np.frombuffer(raw, kind).astype(np.float64) * gain + offset if len(raw) % kind.itemsize == 0 else ()
                    if len(values) != len(own) * samples:
                        raise ValueError(f"{piece.path}: shorter than its header says")
                    yield _batch(piece, wavelength, own, values, samples)


def _batch(piece: Piece, wavelength: float | None, y: np.ndarray, values: np.ndarray, samples: int) -> pa.RecordBatch:
    n = len(y)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * samples), pa.array(values))
    cols = [pa.array([piece.product_id] * n, pa.string()), pa.array([piece.kind] * n, pa.string()), pa.array([piece.band] * n, pa.int32()), pa.array([wavelength] * n, pa.float64()), pa.array(y.astype(np.int32)), lists]
    return pa.RecordBatch.from_arrays(cols, names=["product_id", "kind", "band", "wavelength", "y", "samples"])


@dataclass
class Written(ds.WriterCommitMessage):
    """Images (product, file name, name in the staging folder) that a task has finished."""

    images: list[tuple[str, str, str]] = field(default_factory=list)


class Writer(ds.DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool, options: dict[str, str]) -> None:
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex
        self.code, self.order = options.get("datatype", "3"), options.get("byteorder", "1")
        self.gain, self.unit = float(options.get("gain", "1")), options.get("unit", "")

    def _staging(self, root: str) -> str:
        return f"{root}/{STAGING}{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = _store(self.path)
        done, at, out, seen = Written(), None, None, (0, 0, None)
        kind = np.dtype((">" if self.order == "1" else "<") + ENVI_TYPES[self.code])
        attempt = uuid.uuid4().hex

        def close() -> None:
            out.close()
            lines, samples, wavelength = seen
            with store.open_output_stream(f"{self._staging(root)}/{done.images[-1][2]}.hdr") as f:
                f.write(self._header(*at, lines, samples, wavelength).encode())

        for batch in iterator:
            cols = [batch.column(n) for n in ("product_id", "kind", "band", "wavelength", "y")]
            for r, row in enumerate(zip(*(c.to_pylist() for c in cols), strict=True)):
                values = np.asarray(batch.column("samples")[r].values.to_numpy(zero_copy_only=False), dtype=np.float64)
                if row[:3] != at:
                    if out is not None:
                        close()
                    at, name = row[:3], f"{attempt}-{len(done.images)}"
                    if None in at or "/" in at[0] + at[1] or at[0].startswith(("_", ".")):
                        raise ValueError(f"no file can be named after {at}")
                    done.images.append((at[0], f"{at[1]}_{at[2]}", name))
                    store.create_dir(self._staging(root), recursive=True)
                    out, seen = store.open_output_stream(f"{self._staging(root)}/{name}.img"), (0, len(values), row[3])
                if row[4] != seen[0] or len(values) != seen[1]:
                    raise ValueError(f"lines of {at} must come whole, from 0, one after the other")
                stored = values / self.gain if kind.kind == "f" else np.rint(values / self.gain)
                if kind.kind != "f" and not (np.isfinite(stored).all() and (stored >= np.iinfo(kind).min).all() and (stored <= np.iinfo(kind).max).all()):
                    raise ValueError(f"a value of {at} doesn't fit the data type")
                out.write(stored.astype(kind).tobytes())
                seen = (seen[0] + 1, seen[1], seen[2])
        if out is not None:
            close()
        return done

    def _header(self, product: str, kind: str, band: int, lines: int, samples: int, wavelength: float | None) -> str:
        fields = {
            "description": f"{{{kind} for band {band} of {product}{' - Unit: ' + self.unit if self.unit else ''}}}", "samples": samples, "lines": lines, "bands": 1, "header offset": 0, "file type": "ENVI Standard",
            "data type": self.code, "interleave": "bsq", "byte order": self.order, "data gain values": f"{{{self.gain!r}}}", "data offset values": "{0.0}",
        } | ({"wavelength": f"{{{wavelength!r}}}"} if wavelength is not None else {})
        return "ENVI\n" + "".join(f"{k} = {v}\n" for k, v in fields.items())

    def commit(self, messages: list[Written | None]) -> None:
        store, root = _store(self.path)
        images = [x for m in messages if m is not None for x in m.images]
        staging = self._staging(root)
        products = sorted({p for p, _, _ in images})
        there = {p for p in products if store.get_file_info(f"{root}/{p}{SUFFIX}").type != pafs.FileType.NotFound}
        try:
            if len({x[:2] for x in images}) < len(images):
                raise ValueError("a band was written by two tasks: its lines must be in one partition")
            if there and not self.overwrite:
                raise ValueError(f"scenes are there already: {', '.join(sorted(there))}")
            for p in products:
                store.create_dir(f"{staging}/new/{p}{SUFFIX}", recursive=True)
            for p, stem, name in images:
                for end in (".img", ".hdr"):
                    store.move(f"{staging}/{name}{end}", f"{staging}/new/{p}{SUFFIX}/{stem}{end}")
        except Exception:
            self.abort(messages)
            raise
        for p in products:  # from here on scenes appear whole, one after the other
            if p in there:
                store.create_dir(f"{staging}/old", recursive=True)
                store.move(f"{root}/{p}{SUFFIX}", f"{staging}/old/{p}{SUFFIX}")
            store.move(f"{staging}/new/{p}{SUFFIX}", f"{root}/{p}{SUFFIX}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        store, root = _store(self.path)
        if store.get_file_info(self._staging(root)).type != pafs.FileType.NotFound:
            store.delete_dir(self._staging(root))


class BandFiles(ds.DataSource):
    """Options: path; reading: partBytes and choice (a ``Choice`` as JSON); writing: dataType (a header's code), byteOrder (0 or 1), gain, unit."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"], int(self.options.get("partBytes", PART_BYTES)), Choice(**json.loads(self.options.get("choice", "{}"))))

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"], overwrite, {k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BandFiles)


def scan_lines(spark: SparkSession, path: str, choice: Choice | None = None, **options: object) -> DataFrame:
    """Image lines (SCHEMA) of the scenes under a folder, or of one scene's folder.

    ``choice`` drops files by name before any is opened, files by wavelength and lines in the tasks.  It is given here and
    not taken from filters: Spark 4.1 keeps what it pushed to a Python source with the frame, so that two filters of one
    frame in one plan would both read what the last one chose.  Filters on the result are right, and read all of it.
    Folders and files that begin with ``_`` or ``.`` and images without a band number are passed over; a file that is
    shorter than its header says is an error; a folder without images gives no rows.  Values are those stored, times the
    header's gain, plus its offset.
    """
    register(spark)
    return spark.read.format(FORMAT).options(choice=json.dumps(asdict(choice or Choice())), **options).load(path)


def write_lines(lines: DataFrame, path: str, overwrite: bool = False, **options: object) -> None:
    """Store image lines (SCHEMA); with ``overwrite`` scenes of the same names are replaced, else they are refused.

    Lines of a band must be whole, from y = 0 on.  A null or a value that the data type can't hold is an error; any error
    leaves the folder as it was.  A band is written by one task.
    """
    register(lines.sparkSession)
    keys = ["product_id", "kind", "band"]
    rows = lines.select("product_id", "kind", F.col("band").cast("int").alias("band"), F.col("wavelength").cast("double").alias("wavelength"), F.col("y").cast("int").alias("y"), F.col("samples").cast("array<double>").alias("samples"))
    sorted_ = rows.repartition(*keys).sortWithinPartitions(*keys, "y")
    sorted_.write.format(FORMAT).options(**options).mode("overwrite" if overwrite else "append").save(path)


def to_lines(cells: DataFrame, fill: float = 0.0) -> DataFrame:
    """Image lines (SCHEMA) of cells (product_id, kind, band, wavelength, y, x, value): from the first line and column to the
    last of the product, with ``fill`` where there is no cell.  One row a line, so that a task holds lines, not images."""
    size = cells.groupBy("product_id").agg(F.max("x").alias("last_x"), F.max("y").alias("last_y"))
    line = F.array_sort(F.collect_list(F.struct("x", F.col("value").cast("double").alias("v"))))
    grouped = cells.groupBy("product_id", "kind", "band", "y").agg(line.alias("line"))
    named = cells.groupBy("product_id", "kind", "band").agg(F.max("wavelength").alias("wavelength")).join(size, "product_id")
    every = named.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("last_y"))))
    found = lambda x: F.get(F.filter("line", lambda s: s["x"] == x), F.lit(0))["v"]
    holes = F.transform(F.sequence(F.lit(0), F.col("last_x")), lambda x: F.coalesce(found(x), F.lit(float(fill))))
    whole = (F.size("line") == F.col("last_x") + 1) & (F.get("line", F.lit(0))["x"] == 0) & (F.array_size(F.array_distinct(F.transform("line", lambda s: s["x"]))) == F.size("line"))
    joined = every.join(grouped, ["product_id", "kind", "band", "y"], "left")
    return joined.select("product_id", "kind", "band", "wavelength", "y", F.when(whole, F.transform("line", lambda s: s["v"])).otherwise(holes).alias("samples"))


def to_cells(lines: DataFrame) -> DataFrame:
    """product_id, kind, band, wavelength, y, x, value of every pixel of image lines."""
    return lines.select("product_id", "kind", "band", "wavelength", "y", F.posexplode("samples").alias("x", "value"))


def to_pixels(lines: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """product_id, y, x and an array by band for each kind (``kinds`` has their types): lines of all bands meet by line, not
    by pixel.  A kind without lines gives arrays of its other kinds' length with zeros."""
    pick = [F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("band", "samples")))), lambda s: s["samples"]).alias(k) for k in kinds]
    met = lines.groupBy("product_id", "y").agg(F.max(F.size("samples")).alias("n"), *pick)
    each = met.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    most = F.greatest(*[F.size(k) for k in kinds], F.lit(0))
    column = lambda k, t: F.when(F.size(k) > 0, F.transform(k, lambda s: F.get(s, F.col("x")).cast(t))).otherwise(F.array_repeat(F.lit(0).cast(t), most)).alias(k)
    return each.select("product_id", "y", "x", *[column(k, t) for k, t in kinds.items()])


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, which driver and executors share; a temporary one on a local master alone."""
    own = spark.conf.get("spark.checkpoint.dir", None)
    made = spark.sparkContext._jsc.sc().getCheckpointDir()
    own = own or (made.get() if made.isDefined() else None)
    if not own:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="scenes-")
    return f"{own.rstrip('/')}/{name}-{uuid.uuid4().hex}"
