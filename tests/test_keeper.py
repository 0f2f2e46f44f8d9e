"""The keeper: what is whole is copied once, into the folder of its campaign, whatever crashes in between."""

import os
import time

import pytest

from annalist.streaming import keeper as K

from .savebuilder import snapshot



def text(date, tag, flags):
    return snapshot(date, tag, " ".join(flags), [])


EARLY, LATER, OTHER = list("abcdefgh"), list("abcdefghij"), [f"z{i}" for i in range(9)]
HEADS = "path string, modified long, length long, date string, months int, tag string, start_date string, flags array<string>, prefix string"


def heads(spark, rows):
    return spark.createDataFrame([(p, 1, 10, f"{m // 12}.{m % 12 + 1}.1", m, tag, start, flags, "") for p, m, tag, start, flags in rows], HEADS)


def campaigns(spark, rows):
    return spark.createDataFrame([(c, start, "", "", m, "", tag, flags, [], None) for c, m, tag, start, flags in rows], K.CAMPAIGN)


def test_matching(spark):
    c = campaigns(spark, [("one", 100, "PRU", "s", EARLY), ("two", 90, "ENG", "s", OTHER), ("thin", 5, "SWE", "s", ["q"]), ("far", 100, "PRU", "t", EARLY)])
    f = heads(spark, [("formed", 110, "GER", "s", LATER), ("same", 95, "ENG", "s", OTHER), ("strange", 120, "PRU", "s", ["k", "l", "m"]), ("reload", 60, "PRU", "s", EARLY[:4]), ("young", 6, "SWE", "s", []), ("young2", 6, "DEN", "s", ["q"]), ("far", 101, "PRU", "t", LATER)])
    got = {r.path: r.campaign for r in K.matched(f, c).collect()}
    assert got == {"formed": "one", "same": "two", "reload": "one", "young": "thin", "far": "far"}


def test_rounds_of_new_campaigns(spark):
    none = campaigns(spark, [])
    f = heads(spark, [("a1", 10, "PRU", "s", EARLY), ("a2", 20, "GER", "s", LATER), ("b1", 15, "ENG", "s", OTHER), ("b2", 16, "ENG", "s", OTHER), ("c1", 12, "PRU", "t", EARLY), ("a0", 9, "PRU", "s", EARLY[:6])])
    rows = K.assigned(f, none)
    groups = {}
    for r in rows.collect():
        groups.setdefault(r.campaign, set()).add(r.path)
    assert sorted(map(sorted, groups.values())) == [["a0", "a1", "a2"], ["b1", "b2"], ["c1"]]
    t = {r.title: r for r in K.titled(K.updated(none, rows).replace("s", "1836.1.1", ["start_date"]).replace("t", "1861.4.1", ["start_date"])).collect()}
    assert sorted(t) == ["ENG 1836", "PRU 1861", "PRU-GER 1836"] and t["PRU-GER 1836"].tag == "GER" and t["PRU-GER 1836"].months == 20
    again = K.updated(K.updated(none, rows), rows)
    assert sorted(map(str, again.collect())) == sorted(map(str, K.updated(none, rows).collect()))


def test_heads():
    assert K.head_fields(text("1840.2.1", "PRU", "ab")) == ("1840.2.1", "PRU", "1836.1.1", ["a", "b"])
    assert K.head_fields(b"PK date=") is None and K.head_fields(b'date="1840.1.1"') is None and K.head_fields(b"") is None


def test_config(spark, tmp_path):
    (tmp_path / "saves/out").mkdir(parents=True)
    assert K.trouble(str(tmp_path / "saves"), str(tmp_path / "saves/out")) and K.trouble(str(tmp_path / "none"), str(tmp_path)) and not K.trouble(str(tmp_path / "saves"), str(tmp_path / "saves2"))
    with pytest.raises(ValueError, match="outside"):
        K.keep(spark, str(tmp_path / "saves"), str(tmp_path / "saves"), str(tmp_path / "ck"))


def sighted(spark, folder):
    """A batch of the files that are in a folder now."""
    files = [p for p in folder.rglob("*.v2")]
    return spark.createDataFrame([(str(p), p.stat().st_size, p.stat().st_mtime_ns) for p in files], K.SIGHTING)


def held(out):
    return sorted(str(p.relative_to(out)) for p in out.rglob("*") if p.is_file() and ".keeper" not in str(p))


def test_batches_that_are_repeated_torn_or_cut_short(spark, tmp_path, monkeypatch):
    saves, out = tmp_path / "saves", tmp_path / "out"
    (saves / "GFM").mkdir(parents=True)
    (saves / "auto.v2").write_bytes(text("1840.1.1", "PRU", EARLY))
    (saves / "GFM/auto.v2").write_bytes(text("1841.1.1", "ENG", OTHER))
    first = sighted(spark, saves)
    K.keep_batch(first, 0, str(saves), str(out))
    assert held(out) == ["GFM ENG 1836/ENG1841_01_01.v2", "PRU 1836/PRU1840_01_01.v2"]
    stamp = (out / "PRU 1836/PRU1840_01_01.v2").stat().st_mtime_ns
    K.keep_batch(first, 0, str(saves), str(out))  # as after a crash before the batch was recorded
    assert held(out) == ["GFM ENG 1836/ENG1841_01_01.v2", "PRU 1836/PRU1840_01_01.v2"] and (out / "PRU 1836/PRU1840_01_01.v2").stat().st_mtime_ns == stamp
    seen = sighted(spark, saves).cache()
    seen.count()
    (saves / "auto.v2").write_bytes(text("1840.2.1", "PRU", EARLY) + b"\r\n" * 9)  # written on since it was seen
    K.keep_batch(seen.where(seen.path.endswith("saves/auto.v2")), 1, str(saves), str(out))
    assert len(held(out)) == 2
    (saves / "auto.v2").write_bytes(text("1850.1.1", "GER", LATER))
    formed = sighted(spark, saves)

    class Crash(Exception):
        pass

    def crash(*_):
        raise Crash

    with monkeypatch.context() as m:
        m.setattr(K.Ledger, "write", crash)  # folders moved, copies made, the ledger not written
        with pytest.raises(Crash):
            K.keep_batch(formed, 2, str(saves), str(out))
    K.keep_batch(formed, 2, str(saves), str(out))
    assert held(out) == ["GFM ENG 1836/ENG1841_01_01.v2", "PRU-GER 1836/GER1850_01_01.v2", "PRU-GER 1836/PRU1840_01_01.v2"]
    (saves / "auto.v2").write_bytes(text("1845.1.1", "PRU", EARLY + ["i"]))  # an earlier state, loaded again
    K.keep_batch(sighted(spark, saves), 3, str(saves), str(out))
    newest = {r.folder: (r.date, r.tag, [x.tag for x in r.tags]) for r in K.latest(spark, str(out)).collect()}
    assert newest == {"PRU-GER 1836": ("1850.1.1", "GER", ["PRU", "GER"]), "GFM ENG 1836": ("1841.1.1", "ENG", ["ENG"])}
    assert len(held(out)) == 4 and not list(out.rglob("*.part"))


def wait_for(what, seconds=90):
    end = time.time() + seconds
    while time.time() < end:
        if what():
            return
        time.sleep(0.3)
    raise AssertionError("not in time")


def test_stream_goes_on_after_a_stop(spark, tmp_path):
    saves, out = tmp_path / "saves", tmp_path / "out"
    saves.mkdir()
    (saves / "autosave.v2").write_bytes(text("1840.1.1", "PRU", EARLY))
    (saves / "notes.txt").write_bytes(b"no save")
    start = lambda: K.keep(spark, str(saves), str(out), str(tmp_path / "ck"), poll="100 milliseconds")
    q = start()
    wait_for(lambda: out.exists() and held(out) == ["PRU 1836/PRU1840_01_01.v2"])
    q.stop()
    q.awaitTermination(30)
    os.replace(saves / "autosave.v2", saves / "old_autosave.v2")  # rotated: another name, the same state
    (saves / "autosave.v2").write_bytes(text("1840.2.1", "PRU", EARLY))
    q = start()
    try:
        wait_for(lambda: len(held(out)) == 2)
        (saves / "autosave.v2").write_bytes(text("1840.3.1", "PRU", EARLY))  # the same name, another state
        wait_for(lambda: held(out) == [f"PRU 1836/PRU1840_0{m}_01.v2" for m in (1, 2, 3)])
        wait_for(lambda: [(r.date, r.folder) for r in K.latest(spark, str(out)).collect()] == [("1840.3.1", "PRU 1836")])
    finally:
        q.stop()
