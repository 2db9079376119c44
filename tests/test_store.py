"""Bundles of stage results, resuming from them, and images read by range."""

import struct
import zlib

import numpy as np
import pytest

from tissuegrid import store
from tissuegrid.operators import cvae, gat
from tissuegrid.plans import state
from tissuegrid.sources import cells as src
from tissuegrid.sources import records, tiles


def test_bundle_round_trip_and_refusals(spark, tmp_path):
    path = str(tmp_path / "b")
    with pytest.raises(FileNotFoundError):
        store.load(spark, path, "kind")
    table = spark.createDataFrame([(1, "a", None), (2, None, [1.5])], "id long, s string, v array<double>")
    arrays = {"m": np.arange(6.0).reshape(2, 3), "flags": np.array([True, False]), "none": np.zeros((0, 4), np.int32)}
    store.save(spark, path, store.Bundle("kind", {"t": table}, arrays, {"x": [1, "two", None], "y": {"z": 1.5}}))
    got = store.load(spark, path, "kind")
    assert got.tables["t"].schema == table.schema and got.tables["t"].orderBy("id").collect() == table.collect()
    assert got.values == {"x": [1, "two", None], "y": {"z": 1.5}}
    assert all(np.array_equal(got.arrays[k], v) and got.arrays[k].dtype == v.dtype and got.arrays[k].shape == v.shape for k, v in arrays.items())
    assert store.holds(spark, path, "kind") and not store.holds(spark, path, "other")
    with pytest.raises(ValueError, match="not other"):
        store.load(spark, path, "other")
    with pytest.raises(ValueError, match="twice"):
        store.save(spark, path, store.Bundle("kind", {"m": table}, arrays, {}))
    # Replaced as a whole: a reader of the old one keeps its files until they are cleaned away.
    store.save(spark, path, store.Bundle("kind", {"t": table.limit(1)}, {}, {}))
    assert got.tables["t"].count() == 2
    assert store.load(spark, path, "kind").tables["t"].count() == 1
    assert len(store.clean(spark, path)) == 1 and store.clean(spark, path) == []
    assert store.load(spark, path, "kind").tables["t"].count() == 1
    store.save(spark, path, store.Bundle("nothing", {}, {}, {}))
    assert store.load(spark, path, "nothing").values == {}


def test_unfinished_and_newer_bundles_are_refused(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "b")
    monkeypatch.setattr(store, "VERSION", 2)
    store.save(spark, path, store.Bundle("kind", {}, {}, {"a": 1}))
    monkeypatch.setattr(store, "VERSION", 1)
    assert not store.holds(spark, path, "kind")
    with pytest.raises(ValueError, match="version 2"):
        store.load(spark, path, "kind")
    (tmp_path / "b" / "manifest" / "_SUCCESS").rename(tmp_path / "b" / "manifest" / "_other")
    with pytest.raises(FileNotFoundError):
        store.load(spark, path, "kind")


def test_models_come_back_as_they_were(spark, tmp_path):
    config = cvae.CvaeConfig(epochs=3, sc_mix=(3, 4))
    model = cvae.new_model(12, 3, config)
    model.scale_sc, model.scale_st, model.losses = (np.ones(12), np.zeros(12)), (np.full(12, 2.0), np.ones(12)), [1.5, 0.25]
    axis = spark.createDataFrame([("g", 0)], "gene string, ix int")
    state.save_autoencoder(spark, str(tmp_path / "a"), model, axis)
    got, genes = state.load_autoencoder(spark, str(tmp_path / "a"), config)
    assert got.config == config and got.losses == model.losses and genes.collect() == axis.collect()
    assert all(np.array_equal(got.params[k], v) for k, v in model.params.items()) and set(got.running) == set(model.running)
    assert np.array_equal(got.scale_st[0], model.scale_st[0])
    with pytest.raises(ValueError, match="epochs"):
        state.load_autoencoder(spark, str(tmp_path / "a"), cvae.CvaeConfig(epochs=4, sc_mix=(3, 4)))
    net = gat.GatConfig(hidden=4)
    params = gat.new_params(5, 3, net)
    state.save_attention(spark, str(tmp_path / "g"), params, net, [0.5])
    back, same, losses = state.load_attention(spark, str(tmp_path / "g"), net)
    assert same == net and losses == [0.5] and all(np.array_equal(back[k], v) for k, v in params.items())


# Images by range -----------------------------------------------------------------------------


def _tiff(path, image, tile=None, rows=None, deflate=False, predictor=1, big=False, order="<"):
    """Write an 8-bit TIFF of tiles or strips."""
    h, w, bands = image.shape
    wide, tall = tile or (w, rows)
    chunks = []
    for y in range(0, h, tall):
        for x in range(0, w, wide):
            part = image[y:y + tall, x:x + wide]
            if tile:
                whole = np.zeros((tall, wide, bands), np.uint8)
                whole[:part.shape[0], :part.shape[1]] = part
                part = whole
            if predictor == 2:
                part = np.diff(part, axis=1, prepend=np.zeros((len(part), 1, bands), np.uint8))
            chunks.append(zlib.compress(part.tobytes()) if deflate else part.tobytes())
    word = "Q" if big else "I"
    head = (b"II" if order == "<" else b"MM") + (struct.pack(order + "HHH", 43, 8, 0) if big else struct.pack(order + "H", 42))
    at = len(head) + struct.calcsize(word)
    offsets = np.cumsum([at] + [len(c) for c in chunks])[:-1].tolist()
    body = b"".join(chunks)
    tags = [(256, "I", [w]), (257, "I", [h]), (258, "H", [8] * bands), (259, "H", [8 if deflate else 1]), (262, "H", [2 if bands > 1 else 1]),
            (277, "H", [bands]), (317, "H", [predictor])]
    tags += [(322, "I", [wide]), (323, "I", [tall]), (324, word, offsets), (325, "I", [len(c) for c in chunks])] if tile else [
        (273, word, offsets), (278, "H", [tall]), (279, "I", [len(c) for c in chunks])]
    entries, extra, base = b"", b"", at + len(body)
    kinds, room = {"B": 1, "H": 3, "I": 4, "Q": 16}, struct.calcsize(word)
    table = base + (8 if big else 2) + len(tags) * (20 if big else 12) + room
    for tag, kind, values in sorted(tags):
        raw = struct.pack(f"{order}{len(values)}{kind}", *values)
        if len(raw) > room:
            pointer = struct.pack(order + word, table + len(extra))
            extra, raw = extra + raw, pointer
        entries += struct.pack(order + "HH" + word, tag, kinds[kind], len(values)) + raw.ljust(room, b"\0")
    count = struct.pack(order + ("Q" if big else "H"), len(tags))
    path.write_bytes(head + struct.pack(order + word, base) + body + count + entries + struct.pack(order + word, 0) + extra)


def test_ranged_tiles_equal_the_whole_image(spark, tmp_path):
    rng = np.random.default_rng(1)
    image = rng.integers(0, 256, (150, 333, 3), dtype=np.uint8)
    grey = image[..., :1]
    (tmp_path / "a.ppm").write_bytes(b"P6\n# made here\n333 150\n255\n" + image.tobytes())
    (tmp_path / "b.pgm").write_bytes(b"P5 333\t150 255\n" + grey.tobytes())
    kinds = {"c": dict(tile=(64, 48)), "d": dict(tile=(32, 32), deflate=True, predictor=2), "e": dict(rows=7), "f": dict(rows=40, deflate=True),
             "g": dict(tile=(64, 64), big=True, order=">"), "h": dict(rows=150, predictor=2, order=">")}
    for name, how in kinds.items():
        _tiff(tmp_path / f"{name}.tif", image, **how)
    _tiff(tmp_path / "i.tif", grey, tile=(50, 50), deflate=True)
    got = {}
    for r in src.read_tiles(spark, str(tmp_path), 64).collect():
        page = got.setdefault(r.image_id, np.full((192, 384, 3), 1, np.uint8))
        page[r.ty * 64:r.ty * 64 + 64, r.tx * 64:r.tx * 64 + 64] = np.frombuffer(r.rgb, np.uint8).reshape(64, 64, 3)
        assert (r.width, r.height) == (333, 150)
    assert len(got) == 9
    for name, page in got.items():
        want = np.full((192, 384, 3), 255, np.uint8)
        want[:150, :333] = grey if name in ("b.pgm", "i.tif") else image
        assert np.array_equal(page, want), name


def test_a_part_reads_only_its_bytes(tmp_path, monkeypatch):
    seen = []
    read = records.RangedFile.read
    monkeypatch.setattr(records.RangedFile, "read", lambda self, a, b: seen.append(b - a) or read(self, a, b))
    amounts = []
    for width in (400, 4000):
        image = np.zeros((300, width, 3), np.uint8)
        (tmp_path / "a.ppm").write_bytes(b"P6\n%d 300\n255\n" % width + image.tobytes())
        _tiff(tmp_path / "b.tif", image, tile=(64, 64))
        for name in ("a.ppm", "b.tif"):
            file = records.RangedFile(str(tmp_path / name))
            at = tiles.layout(file)
            seen.clear()
            tiles.region(file, at, 64, 192, 64, 128)
            amounts.append(sum(seen))
    assert amounts == [2 * 64 * 64 * 3] * 4


def test_unknown_images_are_left_to_the_decoder(spark, tmp_path):
    (tmp_path / "odd.bin").write_bytes(b"raw!" + bytes(range(12)))
    (tmp_path / "a.pgm").write_bytes(b"P5 2 2 255\n" + bytes([1, 2, 3, 4]))
    ranged, others = tiles.ranged_tiles(spark, str(tmp_path), 4)
    assert ranged.count() == 1 and [o.rsplit("/", 1)[1] for o in others] == ["odd.bin"]
    made = src.read_tiles(spark, str(tmp_path / "odd.bin"), 4, decode=lambda b: np.frombuffer(b[4:], np.uint8).reshape(2, 2, 3))
    assert made.first().rgb[:3] == bytes([0, 1, 2])
