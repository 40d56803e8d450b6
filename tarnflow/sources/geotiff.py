"""GeoTIFF layers: headers as rows, internal blocks as partitions of a data source, points sampled block by block.

Files are read by ranges through Arrow's file systems, header and wanted blocks alone. Points are put into the pixels of
a grid, which layers of one shape share; distinct pixels go to the task of their block, which reads it once for each layer.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Tags that are read (fixed values of the format).
WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, SAMPLES, STRIP_ROWS, STRIP_SIZES, PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 317
TILE_WIDTH, TILE_HEIGHT, TILES, TILE_SIZES, FORMAT = 322, 323, 324, 325, 339
PIXEL_SCALE, TIE_POINTS, ROTATION, GEO_KEYS, METADATA, NODATA = 33550, 33922, 34264, 34735, 42112, 42113
#: Geographic and projected reference system among the geo keys (fixed values of the format).
GEOGRAPHIC, PROJECTED = 2048, 3072
_KINDS = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q"}
_TYPES = {1: "u", 2: "i", 3: "f"}
#: Bytes that are read at once for a header.
_HEAD = 1 << 16
#: Metres of half the equator in the spherical projection (fixed value).
_HALF = 20037508.342789244


@dataclass(frozen=True)
class Layer:
    """What a header says of the first band."""

    uri: str
    width: int
    height: int
    block_width: int
    block_height: int
    west: float
    north: float
    pixel_x: float
    pixel_y: float
    crs: str
    kind: str
    samples: int
    compression: int
    predictor: int
    nodata: float | None
    scale: float
    offset: float
    places: tuple[int, ...]
    sizes: tuple[int, ...]

    @property
    def across(self) -> int:
        return -(-self.width // self.block_width)

    @property
    def down(self) -> int:
        return -(-self.height // self.block_height)

    @property
    def grid(self) -> tuple:
        return (self.crs, self.west, self.north, self.pixel_x, self.pixel_y, self.width, self.height, self.block_width, self.block_height)


def open_file(uri: str) -> pa.NativeFile:
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri.removeprefix("file:"))
    return system.open_input_file(path)


def _tags(f: pa.NativeFile) -> tuple[str, dict[int, tuple]]:
    head = f.read_at(min(_HEAD, f.size()), 0)
    at = lambda i, n: head[i : i + n] if i + n <= len(head) else f.read_at(n, i)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    version = struct.unpack(f"{order}H", head[2:4])[0] if order else 0
    if version not in (42, 43):
        raise ValueError("not a TIFF file")
    big = version == 43
    first = struct.unpack(f"{order}Q", head[8:16])[0] if big else struct.unpack(f"{order}I", head[4:8])[0]
    n, start = (struct.unpack(f"{order}Q", at(first, 8))[0], first + 8) if big else (struct.unpack(f"{order}H", at(first, 2))[0], first + 2)
    size, found = 20 if big else 12, {}
    entries = at(start, n * size)
    for i in range(n):
        entry = entries[i * size : (i + 1) * size]
        tag, kind = struct.unpack(f"{order}HH", entry[:4])
        count = struct.unpack(f"{order}Q" if big else f"{order}I", entry[4 : size - (8 if big else 4)])[0]
        if kind not in _KINDS:
            continue
        length, inline = count * struct.calcsize(_KINDS[kind]), entry[size - (8 if big else 4) :]
        raw = inline[:length] if length <= len(inline) else at(struct.unpack(f"{order}Q" if big else f"{order}I", inline)[0], length)
        found[tag] = (raw.split(b"\0")[0].decode("latin-1"),) if kind == 2 else struct.unpack(f"{order}{count}{_KINDS[kind]}", raw)
    return order, found


def read_header(uri: str) -> Layer:
    """The header of a north-up file; what cannot be read is an error that says why."""
    with open_file(uri) as f:
        order, t = _tags(f)
    if PIXEL_SCALE not in t or TIE_POINTS not in t or ROTATION in t:
        raise ValueError("no north-up transform")
    keys = t.get(GEO_KEYS, ())
    codes = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0}
    code = codes.get(PROJECTED) or codes.get(GEOGRAPHIC)
    if not code:
        raise ValueError("raster has no reference system")
    one = lambda tag, otherwise: t.get(tag, (otherwise,))[0]
    if one(COMPRESSION, 1) not in (1, 8, 32946, 50000) or one(PREDICTOR, 1) not in (1, 2):
        raise ValueError(f"compression {one(COMPRESSION, 1)} with predictor {one(PREDICTOR, 1)} is not read")
    (px, py, *_), (i, j, _, x, y, *_) = t[PIXEL_SCALE], t[TIE_POINTS]
    tiled = TILES in t
    said = {m[0]: float(m[1]) for m in re.findall(r'role="(scale|offset)"[^>]*>([^<]*)<', one(METADATA, ""))}
    nodata = one(NODATA, "").strip()
    return Layer(
        uri, t[WIDTH][0], t[HEIGHT][0], t[TILE_WIDTH][0] if tiled else t[WIDTH][0], t[TILE_HEIGHT][0] if tiled else min(one(STRIP_ROWS, t[HEIGHT][0]), t[HEIGHT][0]),
        x - i * px, y + j * py, px, py, f"EPSG:{code}", f"{order}{_TYPES[one(FORMAT, 1)]}{one(BITS, 8) // 8}", one(SAMPLES, 1), one(COMPRESSION, 1), one(PREDICTOR, 1),
        float(nodata) if nodata else None, said.get("scale", 1.0), said.get("offset", 0.0), t[TILES if tiled else STRIPS], t[TILE_SIZES if tiled else STRIP_SIZES],
    )


def read_block(f: pa.NativeFile, layer: Layer, block: int) -> np.ndarray:
    """The raw values of an internal block, row by row; a block that was never written has no data."""
    shape = (layer.block_height, layer.block_width)
    if not layer.sizes[block]:
        return np.full(shape, np.nan if layer.nodata is None else layer.nodata)
    raw = f.read_at(layer.sizes[block], layer.places[block])
    if layer.compression in (8, 32946):
        raw = zlib.decompress(raw)
    elif layer.compression == 50000:
        import zstandard

        raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
    values = np.frombuffer(raw, layer.kind).reshape(-1, layer.block_width, layer.samples)
    if layer.predictor == 2:
        values = np.cumsum(values, axis=1, dtype=values.dtype)
    out = np.full(shape, np.nan)
    out[: len(values)] = values[: shape[0], :, 0]  # the last strip may be short
    return out


def _valued(layer: Layer, raw: np.ndarray, scale: float | None, offset: float | None) -> np.ndarray:
    """Scaled values; what is close to the file's no-data value is none."""
    if layer.nodata is not None:
        raw = np.where(np.isclose(raw, layer.nodata, equal_nan=True), np.nan, raw)
    return raw * (layer.scale if scale is None else scale) + (layer.offset if offset is None else offset)


PROBED = "predictor string, uri string, status string, error string, crs string, width int, height int, resolution_x double, resolution_y double, block_width int, block_height int, nodata double, scale double, offset double"


def probe_layers(layers: DataFrame) -> DataFrame:
    """A row for each row of ``layers`` (predictor, uri): status ``ok`` with what its header says, or ``failed`` and why.

    Headers are read where the rows lie; a layer that cannot be opened is a row, not a failure. A null uri fails.
    """

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in PROBED.split(", ")]
        kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}
        for b in batches:
            rows = []
            for predictor, uri in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    h = read_header(uri)
                    rows.append((predictor, uri, "ok", "", h.crs, h.width, h.height, h.pixel_x, h.pixel_y, h.block_width, h.block_height, h.nodata, h.scale, h.offset))
                except Exception as e:  # noqa: BLE001  whatever is wrong with a layer is its row
                    rows.append((predictor, uri, "failed", f"{type(e).__name__}: {e}", *[None] * 10))
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, kinds[k.split()[1]]) for c, k in zip(columns, PROBED.split(", "), strict=True)], names=names)

    return layers.select(F.col("predictor").cast("string"), F.col("uri").cast("string")).mapInArrow(probe, PROBED)


@dataclass
class _Blocks(InputPartition):
    layer: Layer
    first: int
    last: int


class GeoTiffBlocks(DataSource):
    """``spark.read.format("geotiff_blocks").option("paths", "a.tif,b.tif")``: a row for each internal block of each file,
    (uri, block_row, block_column, height, width, values), values scaled and null where there are none. Partitions are
    runs of ``blocks_per_partition`` blocks; each is read once, by its range of the file."""

    @classmethod
    def name(cls) -> str:
        return "geotiff_blocks"

    def schema(self) -> str:
        return "uri string, block_row int, block_column int, height int, width int, values array<double>"

    def reader(self, schema) -> DataSourceReader:
        return _BlockReader(self.options)


class _BlockReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p.strip() for p in options["paths"].split(",") if p.strip()]
        self.run = int(options.get("blocks_per_partition", "16"))

    def partitions(self) -> Sequence[InputPartition]:
        return [_Blocks(layer, i, min(i + self.run, layer.across * layer.down)) for layer in map(read_header, self.paths) for i in range(0, layer.across * layer.down, self.run)]

    def read(self, partition: _Blocks) -> Iterator[tuple]:
        layer = partition.layer
        with open_file(layer.uri) as f:
            for n in range(partition.first, partition.last):
                row, column = divmod(n, layer.across)
                height = min(layer.block_height, layer.height - row * layer.block_height)
                width = min(layer.block_width, layer.width - column * layer.block_width)
                values = _valued(layer, read_block(f, layer, n)[:height, :width], None, None)
                yield layer.uri, row, column, height, width, [None if np.isnan(v) else float(v) for v in values.ravel()]


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GeoTiffBlocks)


def _placed(crs: str):
    """(x, y) of longitude and latitude in a reference system: degrees, or the spherical projection in metres."""
    lon, lat = F.col("_lon"), F.col("_lat")
    if crs == "EPSG:4326":
        return lon, lat
    if crs == "EPSG:3857":
        return lon * (_HALF / 180.0), F.ln(F.tan(F.radians(lat) / 2 + F.lit(np.pi / 4))) * (_HALF / np.pi)
    raise ValueError(f"no transform from EPSG:4326 to {crs}")


def _sampled(layers: Sequence[tuple[Layer, float | None, float | None]]):
    """Pixels (block, row, column), sorted by block, with an array of every layer's value there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, held, values = [None] * len(layers), None, []
        try:
            for b in batches:
                block, row, column = (c.to_numpy() for c in b.columns)
                out = np.empty((len(block), len(layers)))
                for n in np.unique(block):
                    if n != held:  # a block may go on in the next batch
                        held, values = n, []
                        for i, (layer, scale, offset) in enumerate(layers):
                            files[i] = files[i] or open_file(layer.uri)
                            values.append(_valued(layer, read_block(files[i], layer, int(n)), scale, offset))
                    own = block == n
                    r, c = row[own] % layers[0][0].block_height, column[own] % layers[0][0].block_width
                    out[own] = np.stack([v[r, c] for v in values], axis=1)
                flat = pa.array(out.ravel(), pa.float64(), mask=np.isnan(out.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.FixedSizeListArray.from_arrays(flat, len(layers)).cast(pa.list_(pa.float64()))], names=["_row", "_column", "_values"])
        finally:
            for f in files:
                if f is not None:
                    f.close()

    return run


def sample_layers(points: DataFrame, layers: DataFrame, longitude: str = "longitude", latitude: str = "latitude") -> tuple[DataFrame, DataFrame]:
    """``points`` with a column for each layer, the value of the pixel of band 1 that holds the point, and the probe of the
    layers with the scale and offset that were used.

    ``layers`` (predictor, uri, and scale and offset that replace the file's where they are not null) is a row a layer. A
    layer that cannot be opened, or whose reference system has no transform here, is an error; ``probe_layers`` tells
    before. Values are null outside, where there is no data, and for points without finite coordinates. Points keep their
    number; a column of theirs with a predictor's name is replaced. A pixel is read once however many points lie in it.
    """
    probed = probe_layers(layers)
    given = layers.select("predictor", "uri", *[(F.col(c) if c in layers.columns else F.lit(None)).cast("double").alias(f"_{c}") for c in ("scale", "offset")])
    known = probed.join(given, ["predictor", "uri"]).withColumns({c: F.coalesce(f"_{c}", c) for c in ("scale", "offset")})
    rows = known.orderBy("predictor").collect()  # a row a layer
    if failed := [f"{r.predictor}: {r.error}" for r in rows if r.status != "ok"]:
        raise ValueError("layers cannot be read: " + "; ".join(failed))
    if len({r.predictor for r in rows}) < len(rows):
        raise ValueError("a predictor is named twice")
    grids: dict[tuple, list] = {}
    for r in rows:
        layer = read_header(r.uri)
        grids.setdefault(layer.grid, []).append((r.predictor, (layer, r._scale, r._offset)))
    finite = lambda c: F.when(~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) != float("inf")), F.col(c).cast("double"))
    spark = points.sparkSession
    shown = [c for c in points.columns if c not in {r.predictor for r in rows}]
    out = points.withColumns({"_lon": finite(longitude), "_lat": finite(latitude)})
    spread = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    for (crs, west, north, px, py, width, height, bw, bh), own in grids.items():
        x, y = _placed(crs)
        row, column = F.floor((F.lit(north) - y) / py), F.floor((x - F.lit(west)) / px)
        inside = row.between(0, height - 1) & column.between(0, width - 1)
        out = out.withColumns({"_row": F.when(inside, row).cast("long"), "_column": F.when(inside, column).cast("long")})
        block = F.floor(F.col("_row") / bh) * (-(-width // bw)) + F.floor(F.col("_column") / bw)
        pixels = out.where("_row is not null").select(block.cast("long").alias("_block"), "_row", "_column").distinct().repartition(spread, "_block").sortWithinPartitions("_block")
        values = pixels.mapInArrow(_sampled([x for _, x in own]), "_row long, _column long, _values array<double>")
        out = out.join(values, ["_row", "_column"], "left")
        out = out.withColumns({p: F.get("_values", i) for i, (p, _) in enumerate(own)}).drop("_row", "_column", "_values")
    return out.select(*shown, *[r.predictor for r in rows]), known.drop("_scale", "_offset")
