"""Packed payloads: batches, replaced payloads, compaction, and reads by path."""

import os

import pytest
from pyspark.sql import functions as F

from sheaf.sinks import packs


def payloads(spark, numbers, say, size=1000, parts=4):
    """A payload for each number that says who wrote it."""
    n = F.col("id")
    content = F.rpad(F.concat(F.lit(say + "-"), n.cast("string")), size, ".").cast("binary")
    ids = spark.createDataFrame([(k,) for k in numbers], "id int").repartition(parts)
    return ids.select(F.format_string("p/%05d.pdf", n).alias("path"), content.alias("content"))


def said(rows):
    return {r.path: bytes(r.content).decode().split("-")[0] for r in rows.collect()}


def names(numbers):
    return [f"p/{k:05d}.pdf" for k in numbers]


def files(root):
    return sorted(f for _, _, found in os.walk(f"{root}/data") for f in found if f.endswith(".parquet"))


def test_a_later_batch_holds(spark, tmp_path):
    root = str(tmp_path / "packs")
    assert packs.scan_packs(spark, root).count() == 0
    packs.append_packs(payloads(spark, range(50), "a"), root, 0)
    packs.append_packs(payloads(spark, range(40, 60), "b"), root, 1)
    want = {p: "a" for p in names(range(40))} | {p: "b" for p in names(range(40, 60))}
    assert said(packs.scan_packs(spark, root)) == want
    packs.append_packs(payloads(spark, range(50), "a"), root, 0)  # a batch that is done again
    got = packs.scan_packs(spark, root)
    assert said(got) == want and got.count() == 60
    assert {r.length for r in got.collect()} == {1000}


def test_compaction(spark, tmp_path):
    root = str(tmp_path / "packs")
    for batch in range(3):
        packs.append_packs(payloads(spark, range(batch * 100, batch * 100 + 150), f"b{batch}"), root, batch)
    want = said(packs.scan_packs(spark, root))
    assert len(want) == 350 and len(files(root)) == 12
    assert packs.compact_packs(spark, root, pack_bytes=100_000) == 12
    assert said(packs.scan_packs(spark, root)) == want
    assert len(files(root)) == 16
    packs.vacuum_packs(spark, root)
    assert len(files(root)) == 4  # 350 KB in packs of 100 KB
    assert said(packs.scan_packs(spark, root)) == want
    assert packs.compact_packs(spark, root, pack_bytes=100_000) == 0
    packs.append_packs(payloads(spark, [0], "new"), root, 3)
    assert said(packs.scan_packs(spark, root)) == want | {"p/00000.pdf": "new"}


def test_broken_off(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "packs")
    packs.append_packs(payloads(spark, range(30), "a"), root, 0)
    want = said(packs.scan_packs(spark, root))
    with monkeypatch.context() as broken:
        broken.setattr(packs, "_publish", lambda *_: 1 / 0)
        for step in (lambda: packs.compact_packs(spark, root), lambda: packs.append_packs(payloads(spark, range(90), "b"), root, 1)):
            with pytest.raises(ZeroDivisionError):
                step()
            assert said(packs.scan_packs(spark, root)) == want
    assert packs.vacuum_packs(spark, root) == 2
    assert packs.compact_packs(spark, root) == 4
    assert packs.vacuum_packs(spark, root) == 4
    assert said(packs.scan_packs(spark, root)) == want


def test_reads_by_path(spark, tmp_path):
    root = str(tmp_path / "packs")
    packs.append_packs(payloads(spark, range(400), "a", parts=40), root, 0)
    assert packs.compact_packs(spark, root, pack_bytes=50_000) == 40
    wanted = spark.createDataFrame([(p,) for p in [*names([3, 5, 5]), "absent", None]], "path string")
    got = packs.read_packed(spark, root, wanted)
    assert sorted(said(got)) == names([3, 5]) and got.count() == 2
    assert len(got.inputFiles()) <= 2 and len(packs.scan_packs(spark, root).inputFiles()) >= 8
    assert packs.read_packed(spark, root, wanted.where("path = 'absent'")).count() == 0


def test_odd_payloads(spark, tmp_path):
    root = str(tmp_path / "packs")
    rows = [("a", b""), ("b", None), (None, b"x"), ("ä b%20", b"y")]
    packs.append_packs(spark.createDataFrame(rows, "path string, content binary"), root, 0)
    got = {r.path: (r.length, r.content) for r in packs.scan_packs(spark, root).collect()}
    assert got == {"a": (0, b""), "b": (None, None), "ä b%20": (1, b"y")}
    packs.append_packs(spark.createDataFrame([], "path string, content binary"), root, 1)
    assert packs.scan_packs(spark, root).count() == 3
    with pytest.raises(ValueError, match="twice"):
        packs.append_packs(spark.createDataFrame([("a", b""), ("a", b"z")], "path string, content binary"), root, 2)
    assert packs.scan_packs(spark, root).count() == 3
