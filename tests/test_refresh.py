"""A store that is brought up to date step by step equals one that is made at once."""

import os
import shutil

import pytest

from annalist.plans import refresh as R

from .savebuilder import islands

TABLES = ["nations", "province", "pops_by_culture", "owners", "gain_total_pop", "growth_total_pop"]


def rows(spark, store, name):
    drop = {"prov_ord", "first_seen"}
    return sorted(str(sorted((k, str(v)) for k, v in r.asDict().items() if k not in drop)) for r in R.stored(spark, store, name).collect())


def compare(spark, saves, store, tmp_path, step):
    whole = str(tmp_path / f"whole{step}")
    R.refresh(spark, saves, whole)
    for name in TABLES:
        assert rows(spark, store, name) == rows(spark, whole, name), (step, name)
    return whole


def put(path, data):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data)


def test_steps(spark, tmp_path, monkeypatch):
    saves, store = tmp_path / "saves", str(tmp_path / "store")
    bigger = lambda d, n, fourth="MIR": islands(d, fourth).replace(b"size=15000", f"size={n}".encode())
    put(saves / "north/a.v2", islands("1836.1.1"))
    put(saves / "north/c.v2", bigger("1838.1.1", 18000, "TOL"))
    put(saves / "south/a.v2", islands("1836.1.1"))
    assert R.refresh(spark, str(saves), store) == {"read": 3, "gone": 0, "touched": 3}
    assert R.refresh(spark, str(saves), store) == {"read": 0, "gone": 0, "touched": 0}
    assert len(rows(spark, store, "owners")) == 9  # four lands with an owner each at first, then one that changes hands

    put(saves / "north/b.v2", bigger("1837.1.1", 16000, "TOL"))  # between the two: the later one's neighbour is another now
    put(saves / "north/broken.v2", islands("1839.1.1")[:700])
    assert R.refresh(spark, str(saves), store) == {"read": 2, "gone": 0, "touched": 1}
    assert {r.reason for r in R.manifest(spark, store).collect()} == {None, "cut off"}

    def crash(*_):
        raise KeyboardInterrupt

    put(saves / "north/c.v2", bigger("1838.1.1", 19000, "TOL") + b"\r\n")  # changed
    put(saves / "north/z.v2", bigger("1836.1.1", 14000))  # another of the first date, the last by name
    with monkeypatch.context() as m:
        m.setattr(R, "_commit", crash)
        with pytest.raises(KeyboardInterrupt):
            R.refresh(spark, str(saves), store)
    assert R.refresh(spark, str(saves), store) == {"read": 2, "gone": 1, "touched": 2}
    compare(spark, str(saves), store, tmp_path, 2)

    os.remove(saves / "north/b.v2")
    os.remove(saves / "north/z.v2")  # the one it stood for stands again, and is not read again
    shutil.rmtree(saves / "south")
    assert R.refresh(spark, str(saves), store) == {"read": 0, "gone": 3, "touched": 3}
    compare(spark, str(saves), store, tmp_path, 3)
