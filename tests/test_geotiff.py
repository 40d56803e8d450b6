"""Layers of files that the test writes: probing, blocks as a data source, and sampled points."""

import random
import struct
import zlib

import numpy as np
import pytest
import zstandard

from tarnflow.sources import geotiff as G


def write(path, a, west=-180.0, north=90.0, pixel=1.0, tile=16, order="<", big=False, compression=8, predictor=1, nodata=None, epsg=4326, scale=None, strips=None, hole=None):
    """A tiled (or striped) GeoTIFF of a band."""
    h, w = a.shape
    blocks = []
    bw, bh = (w, strips) if strips else (tile, tile)
    for r in range(0, h, bh):
        for c in range(0, w, bw):
            b = a[r : r + bh, c : c + bw]
            if not strips:
                b = np.pad(b, ((0, bh - b.shape[0]), (0, bw - b.shape[1])))
            if predictor == 2:
                b = np.diff(b, axis=1, prepend=b.dtype.type(0))
            raw = b.astype(a.dtype.newbyteorder(order)).tobytes()
            blocks.append({1: lambda x: x, 8: zlib.compress, 50000: zstandard.compress}[compression](raw) if len(blocks) != hole else b"")
    kinds = {"H": 3, "I": 4, "d": 12, "Q": 16, "s": 2}
    bits, form = a.dtype.itemsize * 8, {"u": 1, "i": 2, "f": 3}[a.dtype.kind]
    head = 16 if big else 8
    places = np.cumsum([head] + [len(b) for b in blocks])[:-1].tolist()
    sizes, off = [len(b) for b in blocks], "Q" if big else "I"
    geo = [1, 1, 0, 1, 3072 if epsg == 3857 else 2048, 0, 1, epsg]
    tags = [(256, "I", [w]), (257, "I", [h]), (258, "H", [bits]), (259, "H", [compression]), (277, "H", [1]), (317, "H", [predictor])]
    tags += [(273, off, places), (278, "I", [strips]), (279, off, sizes)] if strips else [(322, "I", [tile]), (323, "I", [tile]), (324, off, places), (325, off, sizes)]
    tags += [(339, "H", [form]), (33550, "d", [pixel, pixel, 0.0]), (33922, "d", [0.0, 0.0, 0.0, west, north, 0.0])]
    tags += [(34735, "H", geo)] if epsg else []
    tags += [(42112, "s", f'<GDALMetadata><Item name="SCALE" sample="0" role="scale">{scale}</Item></GDALMetadata>')] if scale else []
    tags += [(42113, "s", str(nodata))] if nodata is not None else []
    body, start = b"".join(blocks), head + sum(sizes)
    n, size, field = len(tags), 20 if big else 12, 8 if big else 4
    ifd, extra, at = b"", b"", start + (8 if big else 2) + n * size + field
    for tag, kind, value in tags:
        raw = value.encode() + b"\0" if kind == "s" else struct.pack(f"{order}{len(value)}{kind}", *value)
        count = len(raw) if kind == "s" else len(value)
        if len(raw) > field:
            where, extra = at + len(extra), extra + raw
            raw = struct.pack(f"{order}{off}", where)
        ifd += struct.pack(f"{order}HH{off}", tag, kinds[kind], count) + raw.ljust(field, b"\0")
    first = struct.pack(f"{order}HHHQ", 43, 8, 0, start) if big else struct.pack(f"{order}HI", 42, start)
    path.write_bytes((b"II" if order == "<" else b"MM") + first + body + struct.pack(f"{order}{'Q' if big else 'H'}", n) + ifd + bytes(field) + extra)
    return str(path)


@pytest.fixture(scope="module")
def arrays():
    rng = np.random.default_rng(0)
    return {"f": rng.normal(size=(70, 90)).astype("float32"), "i": rng.integers(-500, 500, (70, 90)).astype("int16"), "d": rng.normal(size=(33, 41)), "u": rng.integers(0, 200, (70, 90)).astype("uint8")}


def test_formats(tmp_path, arrays):
    for n, (kind, kwargs) in enumerate([("f", {}), ("i", {"order": ">", "predictor": 2}), ("d", {"big": True, "compression": 50000}), ("u", {"strips": 7, "compression": 1}), ("i", {"strips": 64, "big": True, "order": ">"})]):
        layer = G.read_header(write(tmp_path / f"{n}.tif", arrays[kind], **kwargs))
        got = np.zeros((layer.down * layer.block_height, layer.across * layer.block_width))
        with G.open_file(layer.uri) as f:
            for b in range(layer.across * layer.down):
                r, c = divmod(b, layer.across)
                got[r * layer.block_height : (r + 1) * layer.block_height, c * layer.block_width : (c + 1) * layer.block_width] = G.read_block(f, layer, b)
        assert np.array_equal(got[: layer.height, : layer.width], arrays[kind].astype(float)), (kind, kwargs)


def test_probe(spark, tmp_path, arrays):
    good = write(tmp_path / "good.tif", arrays["i"], nodata=-7, scale=0.1)
    bad = [write(tmp_path / "nocrs.tif", arrays["f"], epsg=0), str(tmp_path / "absent.tif"), None]
    (tmp_path / "text.tif").write_text("no raster at all")
    rows = [("good", good), *zip("abc", bad, strict=True), ("d", str(tmp_path / "text.tif"))]
    got = {r.predictor: r for r in G.probe_layers(spark.createDataFrame(rows, "predictor string, uri string")).collect()}
    assert (got["good"].status, got["good"].crs, got["good"].width, got["good"].height, got["good"].nodata, got["good"].scale, got["good"].block_width) == ("ok", "EPSG:4326", 90, 70, -7.0, 0.1, 16)
    assert all(got[c].status == "failed" and got[c].error for c in "abcd") and "reference system" in got["a"].error and "not a TIFF" in got["d"].error


def test_blocks_are_partitions(spark, tmp_path, arrays):
    a, b = write(tmp_path / "a.tif", arrays["f"]), write(tmp_path / "b.tif", arrays["u"], nodata=7, hole=2)
    G.register(spark)
    got = spark.read.format("geotiff_blocks").option("paths", f"{a},{b}").option("blocks_per_partition", "4").load()
    rows = got.collect()
    assert got.rdd.getNumPartitions() == 16 and len({(r.uri, r.block_row, r.block_column) for r in rows}) == len(rows) == 2 * 5 * 6
    for uri, name in ((a, "f"), (b, "u")):
        out = np.full((70, 90), np.nan)
        for r in rows:
            if r.uri == uri:
                out[r.block_row * 16 : r.block_row * 16 + r.height, r.block_column * 16 : r.block_column * 16 + r.width] = np.array(r["values"], float).reshape(r.height, r.width)
        want = arrays[name].astype(float)
        if name == "u":
            want = np.where(want == 7, np.nan, want)
            want[:16, 32:48] = np.nan
        assert np.array_equal(out, want, equal_nan=True)


def test_sampled_points(spark, tmp_path, arrays, monkeypatch):
    rng = random.Random(1)
    layers = [
        ("warm", write(tmp_path / "1.tif", arrays["f"], west=-45, north=35), None, None), ("wet", write(tmp_path / "2.tif", arrays["i"], west=-45, north=35, nodata=int(arrays["i"][0, 0]), scale=0.5), None, 3.0),
        ("fine", write(tmp_path / "3.tif", arrays["d"], west=0.0, north=2e6, pixel=1e5, epsg=3857), 2.0, None),
    ]
    points = [(i, rng.uniform(-60, 60), rng.uniform(-45, 45), "kept") for i in range(400)] + [(900, None, 1.0, "x"), (901, float("nan"), 1.0, "x"), (902, -45.0, 35.0, "x"), (902, -45.0, 35.0, "x"), (903, 45.0, 0.0, "x")]
    df = spark.createDataFrame(points, "id long, longitude double, latitude double, warm string").repartition(3)
    out, known = G.sample_layers(df, spark.createDataFrame(layers, "predictor string, uri string, scale double, offset double"))
    got = sorted((r.asDict() for r in out.collect()), key=lambda r: r["id"])
    assert len(got) == len(points) and set(out.columns) == {"id", "longitude", "latitude", "warm", "wet", "fine"}

    def at(name, x, y, west, north, pixel):
        if x is None or not np.isfinite(x):
            return None
        r, c = int(np.floor((north - y) / pixel)), int(np.floor((x - west) / pixel))
        a = arrays[name]
        return float(a[r, c]) if 0 <= r < a.shape[0] and 0 <= c < a.shape[1] else None

    seen = 0
    for r, (_, x, y, _) in zip(got, sorted(points, key=lambda p: p[0]), strict=True):
        warm, wet = at("f", x, y, -45, 35, 1.0), at("i", x, y, -45, 35, 1.0)
        mx, my = (None, None) if x is None else (x * 20037508.342789244 / 180, np.log(np.tan(np.radians(y) / 2 + np.pi / 4)) * 20037508.342789244 / np.pi)
        fine = at("d", mx, my, 0.0, 2e6, 1e5)
        wet = None if wet is None or wet == arrays["i"][0, 0] else wet * 0.5 + 3.0
        assert r["warm"] == warm and r["wet"] == wet and r["fine"] == (None if fine is None else fine * 2.0)
        seen += fine is not None
    assert seen > 20 and {r.predictor: (r.scale, r.offset) for r in known.collect()} == {"warm": (1.0, 0.0), "wet": (0.5, 3.0), "fine": (2.0, 0.0)}
    bad = spark.createDataFrame([("x", str(tmp_path / "absent.tif"))], "predictor string, uri string")
    with pytest.raises(ValueError, match="cannot be read"):
        G.sample_layers(df, bad)
    odd = spark.createDataFrame([("x", write(tmp_path / "odd.tif", arrays["f"], epsg=27700))], "predictor string, uri string")
    with pytest.raises(ValueError, match="no transform"):
        G.sample_layers(df, odd)


def test_every_block_is_read_once(spark, tmp_path, arrays):
    layer = G.read_header(write(tmp_path / "once.tif", arrays["f"]))
    import pyarrow as pa

    pixels = [(r // 16 * 6 + c // 16, r, c) for r in range(70) for c in range(90)]
    pixels.sort()
    reads = []
    plain = G.read_block
    try:
        G.read_block = lambda f, x, n: (reads.append(n), plain(f, x, n))[1]
        batches = [pa.RecordBatch.from_arrays([pa.array([p[k] for p in pixels[i : i + 100]], pa.int64()) for k in range(3)], names=["a", "b", "c"]) for i in range(0, len(pixels), 100)]
        rows = sum(b.num_rows for b in G._sampled([(layer, None, None)])(iter(batches)))
    finally:
        G.read_block = plain
    assert rows == len(pixels) and sorted(reads) == list(range(30))
