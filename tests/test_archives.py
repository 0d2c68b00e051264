"""Tar archives and Arrow files by data sources: round trips, filters, bad members."""

import io
import tarfile

import pyarrow as pa
import pytest
from pyarrow import feather

from lexitide.sources import archives


def packed(path, members, mode="w"):
    with tarfile.open(path, mode) as tar:
        folder = tarfile.TarInfo("texts")
        folder.type = tarfile.DIRTYPE
        tar.addfile(folder)
        for name, data in members.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))


@pytest.fixture
def folder(tmp_path):
    packed(tmp_path / "a.tar", {"texts/1.txt": "one é".encode(), "texts/2.txt": b"", "texts/bad.txt": b"\xff\xfe\x00", "meta.json": b"{}"})
    packed(tmp_path / "b.tar.gz", {"texts/3.txt": b"three " * 50_000, "meta.json": b"[]"}, "w:gz")
    (tmp_path / "note.txt").write_text("no archive")
    return tmp_path


def test_members_come_back(spark, folder):
    df = archives.tar_members(spark, f"file://{folder}")
    got = {r.member if "gz" not in r.path else "gz/" + r.member: (r.size, r.text) for r in df.collect()}
    assert got == {"texts/1.txt": (6, "one é"), "texts/2.txt": (0, ""), "meta.json": (2, "{}"), "gz/texts/3.txt": (300_000, "three " * 50_000), "gz/meta.json": (2, "[]")}
    assert df.rdd.getNumPartitions() == 5  # four members, and a compressed archive
    kept = archives.tar_members(spark, str(folder / "a.tar"), keep=True)
    assert kept.where("text is null").count() == 1 and kept.count() == 4


def test_filters_reach_the_planning(spark, folder):
    df = archives.tar_members(spark, str(folder))
    some = df.where("member like 'texts/%' and member in ('texts/1.txt', 'texts/3.txt', 'meta.json') and size > 1")
    assert sorted(r.text[:5] for r in some.select("text").collect()) == ["one é", "three"]
    reader = archives.TarReader({"path": str(folder)}, df.schema)
    left = list(reader.pushFilters([archives.EqualTo(("member",), "texts/1.txt"), archives.EqualTo(("size",), 3)]))
    assert left == [archives.EqualTo(("size",), 3)] and [p.name for p in reader.partitions()] == ["texts/1.txt", None]
    with pytest.raises(Exception, match="gone"):
        archives.tar_members(spark, str(folder / "gone.tar")).count()


def test_arrow_files(spark, tmp_path):
    t = pa.table({"word": [f"w{i}" for i in range(2500)], "z": [i / 4 for i in range(2500)], "v": [[float(i), None] for i in range(2500)]})
    feather.write_feather(t, tmp_path / "a.feather", chunksize=600)
    feather.write_feather(t.slice(0, 10), tmp_path / "b.feather")
    df = archives.arrow_files(spark, str(tmp_path))
    assert df.rdd.getNumPartitions() == 6 and df.count() == 2510
    assert df.where("word = 'w7'").select("v", "z").distinct().collect() == [([7.0, None], 1.75)]
