"""FeatureCollection files read by byte ranges equal the same files parsed whole."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.sources import features, geojson


def _collection(seed: int, n: int) -> str:
    rng = random.Random(seed)
    names = ["plain", "br{ace", "clo}se", "[arr]", 'quo"te', "back\\slash", "end\\", "é漢😀}", '"features":[{', "", "\\\"}{", "tab\t"]

    def ring():
        x, y = rng.randint(-50, 50), rng.randint(-50, 50)
        return [[x, y], [x + 3.5, y], [x + 3.5, y + 2], [x, y]]

    feats = []
    for i in range(n):
        multi = rng.random() < 0.4
        coords = [[ring()] for _ in range(rng.randint(1, 3))] if multi else [ring() for _ in range(rng.randint(1, 2))]
        f = {"type": "Feature", "id": f"{seed}-{i}{rng.choice(names)}", "properties": {"NAME": rng.choice(names), "ID": i},
             "geometry": {"type": "MultiPolygon" if multi else "Polygon", "coordinates": coords}}
        if rng.random() < 0.3:
            f["properties"]["features"] = [{"id": "inner", "x": rng.choice(names)}, [1, {"features": [{"id": "deep"}]}]]
        if rng.random() < 0.3:
            f = dict(reversed(f.items()))
        feats.append(f)
    doc = {"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "urn:}{", "of": [{"id": "crs"}]}}, "others": [{"id": "other}"}, {"id": "x"}],
           "features": feats, "tail": {"features": [{"id": "not one"}]}, "more": [{"id": "no"}]}
    if rng.random() < 0.5:
        doc = dict(reversed(doc.items()))
    return json.dumps(doc, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]))


@pytest.mark.parametrize("seed", range(8))
def test_every_cut_gives_the_same_features(seed, tmp_path):
    """Any range size, in plain Python: fold the facts, cut, join."""
    text = _collection(seed, 12)
    data = text.encode()
    path = tmp_path / "z.json"
    path.write_bytes(data)
    want = json.loads(text)["features"]
    for size in (1, 2, 3, 7, 64, 300, 5000, len(data), len(data) + 9):
        inside, stack, parts = False, [], {}
        for start in range(0, len(data), size):
            content = features._content(str(path), start, start + size, len(data))
            for owner, seq, piece in features.cut(content, start, inside, stack):
                parts[owner, seq] = parts.get((owner, seq), b"") + piece
            ends, closed, left = features._summary(content, inside)
            inside, stack = ends, stack[:len(stack) - closed] + [(kind, start) for kind in left]
        assert not inside and not stack
        assert [json.loads(parts[k]) for k in sorted(parts, key=lambda k: (k[0], k[1] or 1 << 60))] == want


def _rows(zones):
    return sorted(tuple(map(str, r)) for r in zones.df.withColumn("geom", F.to_json("geom")).collect())


def test_zones_by_ranges(spark, tmp_path, monkeypatch):
    folder = tmp_path / "zones"
    folder.mkdir()
    for i in range(3):
        (folder / f"z{i}.json").write_text(_collection(100 + i, 25), encoding="utf-8")
    want = _rows(geojson.read_zones(spark, str(folder)))
    assert len(want) == 75
    monkeypatch.setattr(geojson, "SPREAD_BYTES", 0)
    seen = []
    texts = features.feature_texts

    def small(spark, path):
        seen.append(path)
        return texts(spark, path, 1500)

    monkeypatch.setattr(features, "feature_texts", small)
    assert _rows(geojson.read_zones(spark, str(folder), validate=False)) == want
    assert seen == [str(folder)]
    assert texts(spark, str(folder), 1500).rdd.getNumPartitions() >= 1
    assert features._ranges(spark, str(folder), 1500).rdd.getNumPartitions() > 10


@pytest.mark.parametrize("change", [lambda t: t[:-1], lambda t: t[:-400], lambda t: t + "}", lambda t: t.replace('"Feature"', '"Feature', 1),
                                    lambda t: t.replace('"coordinates": [', '"coordinates": ', 1)])
def test_broken_files_raise(spark, tmp_path, monkeypatch, change):
    text = json.dumps({"type": "FeatureCollection", "features": [
        {"type": "Feature", "id": str(i), "properties": {}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, i + 1], [0, 0]]]}} for i in range(9)]})
    path = tmp_path / "z.json"
    path.write_text(change(text))
    monkeypatch.setattr(geojson, "SPREAD_BYTES", 0)
    texts = features.feature_texts
    monkeypatch.setattr(features, "feature_texts", lambda spark, path: texts(spark, path, 200))
    with pytest.raises(Exception):
        geojson.read_zones(spark, str(path), validate=False).df.collect()


def test_collections_without_features(spark, tmp_path):
    for i, text in enumerate(('{"type": "FeatureCollection", "features": []}', "{}", '{"features": null, "x": [{"a": 1}]}\n')):
        path = tmp_path / f"{i}.json"
        path.write_text(text)
        assert features.feature_texts(spark, str(path), 8).collect() == []
