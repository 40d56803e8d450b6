"""Trees of contracts with tables beside them."""

import json

import pytest

from tarnflow.sources import tables as T

KINDS = {"fits.csv": "taxon string, score double", "keys.csv": "axis string"}


def _tree(root, workers):
    for name, (contract, files) in workers.items():
        folder = root / name
        folder.mkdir(parents=True)
        (folder / "contract.json").write_text(json.dumps(contract, indent=1))
        for f, text in files.items():
            (folder / f).write_text(text)
    return str(root)


def _contract(panel, group, **more):
    return {"purpose": "fit", "role": "validation", "truth_read": False, "panel": panel, "group": group} | more


FILES = {"fits.csv": "taxon,score\nt1,0.5\nt2,\n", "keys.csv": "axis\nheat\n"}


def test_whole_tree(spark, tmp_path):
    root = _tree(tmp_path, {"a/one": (_contract(1, "x"), FILES), "b/two": (_contract(2, "x"), FILES | {"spare.csv": "taxon,score\nt9,1\n"}), "c": (_contract(3, "x", purpose="other"), {"fits.csv": "taxon,score\nt8,0.1\n"})})
    contracts = T.scan_artifacts(spark, root, "fit", 2, {"role": "validation", "truth_read": False})
    got = T.read_siblings(spark, root, contracts, KINDS | {"spare.csv": "taxon string, score double"}, ["panel", "group"], optional=["spare.csv"])
    assert sorted((r.panel, r.taxon, r.score) for r in got["fits.csv"].collect()) == [(1, "t1", 0.5), (1, "t2", None), (2, "t1", 0.5), (2, "t2", None)]
    assert [(r.panel, r.group, r.axis) for r in got["keys.csv"].orderBy("panel").collect()] == [(1, "x", "heat"), (2, "x", "heat")]
    assert [(r.panel, r.taxon) for r in got["spare.csv"].collect()] == [(2, "t9")]
    with pytest.raises(ValueError, match="expected 3"):
        T.scan_artifacts(spark, root, "fit", 3)
    with pytest.raises(ValueError, match="role"):
        T.scan_artifacts(spark, root, "fit", 2, {"role": "discovery"})


def test_broken_trees(spark, tmp_path):
    missing = _tree(tmp_path / "missing", {"a": (_contract(1, "x"), FILES), "b": (_contract(2, "x"), {"fits.csv": FILES["fits.csv"]})})
    empty = _tree(tmp_path / "empty", {"a": (_contract(1, "x"), FILES), "b": (_contract(2, "x"), FILES | {"keys.csv": "axis\n"})})
    for root in (missing, empty):
        got = T.read_siblings(spark, root, T.scan_artifacts(spark, root, "fit", 2), KINDS, ["panel", "group"])
        assert got["fits.csv"].count() == 4
        with pytest.raises(Exception, match="no rows of keys.csv"):
            got["keys.csv"].select("axis").collect()
    twice = _tree(tmp_path / "twice", {"a": (_contract(1, "x"), FILES), "b": (_contract(1, "x"), FILES)})
    with pytest.raises(Exception, match="share their keys"):
        T.read_siblings(spark, twice, T.scan_artifacts(spark, twice, "fit", 2), KINDS, ["panel", "group"])["fits.csv"].select("score").collect()
