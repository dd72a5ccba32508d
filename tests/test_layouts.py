"""Bloom-split anti-joins, bucketed tables, listing by tasks, and class sets: rows, plans and sizes."""

import os
import random

import pytest
from pyspark.sql import functions as F

from checks import adapters as a
from checks import files as given_files
from checks.queries import QUERIES
from sheaf import session
from sheaf.operators import bloom, class_sets
from sheaf.operators.dedup import harvested_dois
from sheaf.operators.status import apply_versions
from sheaf.plans.manifest import build_manifest
from sheaf.sinks import buckets
from sheaf.sources import listing, objects
from test_skew import final_plan, plan


def dois(spark, low, high):
    return spark.range(low, high).select(F.concat(F.lit("10.1/"), F.col("id").cast("string")).alias("doi"), "id")


def one_of(rows, column="doi"):
    return sorted(r[column] for r in rows.select(column).collect())


# --- Bloom filter


def test_no_key_is_ruled_out(spark):
    keys = dois(spark, 0, 20_000)
    made = bloom.bloom_filter(keys, "doi")
    assert made[1] == bloom.block_count(20_000) == 8
    flagged = bloom.with_maybe(dois(spark, 0, 60_000), "doi", made)
    known = flagged.where("id < 20000")
    assert known.where("__maybe").count() == 20_000
    wrong = flagged.where("id >= 20000 and __maybe").count()
    assert wrong < 40_000 * 0.03


def test_filter_size_is_bounded(monkeypatch):
    assert bloom.block_count(0) == 1
    assert bloom.block_count(10**12) * bloom.BLOCK_BITS // 8 == bloom.FILTER_BYTES
    monkeypatch.setattr(bloom, "FILTER_BYTES", 4096)
    assert bloom.block_count(10**9) == 1


def test_split_anti_join_whatever_the_filter(spark, monkeypatch):
    """A filter far too small lets all pass; the rows are the same."""
    rows = dois(spark, 0, 6_000).unionByName(dois(spark, 0, 500)).unionByName(spark.createDataFrame([(None, -1)], "doi string, id long"))
    keys = dois(spark, 100, 4_000).select("doi")
    want = one_of(rows.where("doi is not null").join(keys, "doi", "left_anti"))
    for expected in (None, 1):
        got = bloom.split_anti_join(rows, keys, "doi", bloom.bloom_filter(keys, "doi", expected))
        assert one_of(got.where("doi is not null")) == want
        assert got.where("doi is null").count() == 1 and got.columns == rows.columns
    for a, b in ((rows.limit(0), keys), (rows, keys.limit(0))):
        got = bloom.split_anti_join(a, b, "doi")
        assert got.count() == a.count()


def test_new_rows_are_not_exchanged(spark, monkeypatch, conf):
    """Only rows that the filter lets pass are in the branch with the exchange."""
    conf(spark__sql__autoBroadcastJoinThreshold="-1")
    monkeypatch.setattr("sheaf.session.BROADCAST_ROWS", 0)
    rows, keys = dois(spark, 0, 9_000), dois(spark, 0, 1_000).select("doi")
    got = bloom.split_anti_join(rows, keys, "doi")
    text = plan(got)
    assert text.count("LeftAnti") == 1 and text.count("BroadcastHashJoin") == 2
    assert text.count("Exchange hashpartitioning(doi") == 2  # the passing rows, and the keys
    made = bloom.bloom_filter(keys, "doi")
    assert bloom.with_maybe(rows, "doi", made).where("__maybe").count() < 1_000 + 8_000 * 0.03
    assert got.count() == 8_000


# --- buckets


def status(spark, rows):
    from sheaf.schemas import STATUS

    n = F.col("id").cast("string")
    values = {"uuid": F.concat(F.lit("u"), n), "doi": F.concat(F.lit("10.1/"), n), "grobid_version": F.lit("0")}
    return spark.range(rows).select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in STATUS])


def test_a_bucketed_status_table_stays_where_it_is(spark, tmp_path, conf):
    conf(spark__sql__autoBroadcastJoinThreshold="-1")
    root = str(tmp_path / "it's a table")
    table = status(spark, 3_000)
    buckets.write_buckets(table, root, "uuid", 5)
    assert len([f for f in os.listdir(f"{root}/data") if f.endswith(".parquet")]) == 5
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("sheaf_")]
    # A third of the events are of one uuid.
    events = spark.range(900).select(
        F.col("id").alias("seq"),
        F.when(F.col("id") % 3 == 0, "u7").otherwise(F.concat(F.lit("u"), (F.col("id") * 4).cast("string"))).alias("uuid"),
        F.lit("grobid").alias("service"),
        F.concat(F.lit("0."), F.col("id").cast("string")).alias("version"),
    )
    got = buckets.apply_versions_buckets(spark, root, events)
    text = final_plan(got)
    final = text.split("Initial Plan")[0]
    assert "Bucketed: true" in final
    scan = next(line for line in final.splitlines() if "Bucketed: true" in line)
    above = [line for line in final.splitlines()[: final.splitlines().index(scan)] if "Exchange" in line]
    assert not above, above
    want = apply_versions(table, events)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    picked = buckets.select_buckets(spark, root, spark.createDataFrame([("u5",), ("u5",), ("none",), (None,)], "x string"))
    assert one_of(picked, "uuid") == ["u5"]
    with pytest.raises(ValueError, match="kept by"):
        buckets.doi_index(table, str(tmp_path / "dois"), 3)
        buckets.apply_versions_buckets(spark, str(tmp_path / "dois"), events)


def test_a_manifest_without_moving_the_index(spark, tmp_path, conf):
    from checks import adapters as a
    from conftest import SF

    conf(spark__sql__autoBroadcastJoinThreshold="-1")
    root, harvested = str(tmp_path / "dois"), a.status(spark, SF)
    buckets.doi_index(harvested, root, int(spark.conf.get("spark.sql.shuffle.partitions")))
    got = build_manifest(a.records(spark, SF), harvested=buckets.scan_buckets(spark, root))
    text = plan(got)
    anti = text[text.index("LeftAnti") :]
    index_side = anti[: anti.index("Bucketed: true")].rsplit("Sort [doi", 1)[1]
    assert "Exchange" not in index_side
    assert one_of(got) == one_of(build_manifest(a.records(spark, SF), harvested=harvested))
    assert harvested_dois(buckets.scan_buckets(spark, root)).count() == harvested.select("doi").distinct().count()


def test_buckets_written_again(spark, tmp_path):
    root = str(tmp_path / "t")
    buckets.write_buckets(dois(spark, 0, 100), root, "doi", 4)
    buckets.write_buckets(dois(spark, 50, 60).select("id", "doi"), root, "id", 2)
    assert buckets.bucket_layout(spark, root)[:2] == ("id", 2)
    assert one_of(buckets.scan_buckets(spark, root), "id") == list(range(50, 60))
    buckets.write_buckets(dois(spark, 0, 0), root, "doi", 3)
    assert buckets.scan_buckets(spark, root).count() == 0
    with pytest.raises(ValueError):
        buckets.write_buckets(dois(spark, 0, 1), root, "doi", 0)


# --- listing


@pytest.fixture
def tree(tmp_path):
    names = ["a/b/x.json", "a/y.tei.xml", "ab/z.pdf", "top.json", "c/d/e/é f.json", "a/_tmp/no.json", "a/.hidden"]
    for name in names:
        path = tmp_path / "tree" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(name)
    (tmp_path / "tree" / "empty" / "deep").mkdir(parents=True)
    return str(tmp_path / "tree"), sorted(names[:5])


@pytest.mark.parametrize("depth", [0, 1, 2, 9])
def test_listing(spark, tree, depth):
    root, names = tree
    for folder in (root, root + "/", "file:" + root, "file://" + root):
        got = listing.list_files(spark, folder, depth=depth)
        assert one_of(got, "path") == names
    assert {r.path: bytes(r.content).decode() for r in listing.read_files(spark, root, depth=depth).collect()} == {n: n for n in names}
    assert one_of(listing.list_files(spark, root, "a", depth), "path") == ["a/b/x.json", "a/y.tei.xml", "ab/z.pdf"]
    assert one_of(listing.list_files(spark, root, "a/", depth), "path") == ["a/b/x.json", "a/y.tei.xml"]
    assert one_of(listing.list_files(spark, root, "a/b/x", depth), "path") == ["a/b/x.json"]
    assert one_of(listing.list_files(spark, root, "", depth, [".xml", ".pdf"]), "path") == ["a/y.tei.xml", "ab/z.pdf"]


def test_a_partition_for_each_shard(tree):
    root, _ = tree

    def shards(prefix, depth):
        reader = listing.FileReader(root, depth, prefix, (), ())
        return sorted((s.folder, s.deep) for s in reader.partitions())

    assert shards("", 0) == [("", True)]
    assert shards("", 1) == [("", False), ("a", True), ("ab", True), ("c", True), ("empty", True)]
    assert shards("a/b", 1) == [("", False), ("a", True)]


def test_batches_are_bounded(tree, monkeypatch):
    root, names = tree
    monkeypatch.setattr(listing, "BATCH_BYTES", 15)
    reader = listing.FileReader(root, 0, "", (), ("",))
    batches = [b for shard in reader.partitions() for b in reader.read(shard)]
    assert sorted(p for b in batches for p in b.column("path").to_pylist()) == names
    assert max(b.num_rows for b in batches) <= 2


def test_grobid_bodies_are_not_read(spark, tree):
    root, _ = tree
    rows = listing.read_service_outputs(spark, root).collect()
    assert [(r.path, r.body) for r in rows] == [("a/y.tei.xml", None)]


# --- sets


def lists(spark, rows):
    return spark.createDataFrame(rows, "class string, doi string")


def test_sets_of_batches(spark, tmp_path):
    root = str(tmp_path / "sets")
    batches = [[("a", "1"), ("a", "2"), ("b", "2"), ("a", None)], [], [("a", "2"), ("b", "3"), ("b", "3"), ("h", "3")]]
    for n, rows in enumerate(batches):
        class_sets.append_sets(lists(spark, rows), root, n)
    class_sets.append_sets(lists(spark, batches[2]), root, 2)  # done again
    merged = class_sets.merged_sets(spark, root)
    assert {r["class"]: r.n for r in class_sets.set_sizes(merged).collect()} == {"a": 2, "b": 2, "h": 1}
    assert {r["class"]: (r.n, r.shared) for r in class_sets.overlap_sizes(merged, "h").collect()} == {"a": (2, 0), "b": (2, 1)}
    assert {r["class"]: r.shared for r in class_sets.overlap_sizes(merged, "none").collect()} == {"a": 0, "b": 0, "h": 0}
    numbers = class_sets.scan_numbers(spark, root)
    assert sorted(r.number for r in numbers.collect()) == [1, 2, 3]
    with pytest.raises(ValueError, match="after"):
        class_sets.append_sets(lists(spark, batches[0]), root, 1)


def test_a_batch_that_broke_off_does_not_count(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "sets")
    class_sets.append_sets(lists(spark, [("a", "1")]), root, 0)
    with monkeypatch.context() as broken:
        broken.setattr(class_sets, "class_sets", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            class_sets.append_sets(lists(spark, [("a", "9")]), root, 1)
    assert one_of(class_sets.scan_numbers(spark, root)) == ["1"]
    class_sets.append_sets(lists(spark, [("a", "2")]), root, 1)
    assert sorted((r.doi, r.number) for r in class_sets.scan_numbers(spark, root).collect()) == [("1", 1), ("2", 2)]
    assert class_sets.set_sizes(class_sets.merged_sets(spark, root)).first().n == 2


def test_sets_over_many_buckets(spark, tmp_path):
    """Three classes of which one lies in the last bitmaps only."""
    root = str(tmp_path / "sets")
    rows = dois(spark, 0, 100_000)
    every = rows.select(F.lit("all").alias("class"), "doi")
    some = rows.where("id % 7 = 0").select(F.lit("seventh").alias("class"), "doi")
    class_sets.append_sets(every.unionByName(some).unionByName(some), root, 0)
    late = dois(spark, 100_000, 140_000).select(F.lit("late").alias("class"), "doi")
    class_sets.append_sets(late.unionByName(some), root, 1)
    merged = class_sets.merged_sets(spark, root)
    assert {r["class"]: r.n for r in class_sets.set_sizes(merged).collect()} == {"all": 100_000, "seventh": 14_286, "late": 40_000}
    shared = {r["class"]: r.shared for r in class_sets.overlap_sizes(merged, "seventh").collect()}
    assert shared == {"all": 14_286, "late": 0}
    assert merged.count() <= 4 + 4 + 2


# --- large folders


def test_contents_of_a_flat_folder_are_read_by_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(listing, "TASK_FILES", 10)
    names = [f"softcite/u{n:03}.software.json" for n in range(95)]
    (tmp_path / "softcite").mkdir()
    for name in names:
        (tmp_path / name).write_text(f'{{"version": "{name[-8:]}"}}')
    files = listing.read_service_outputs(spark, str(tmp_path)).withColumn("task", F.spark_partition_id())
    rows = files.collect()
    assert sorted(r.path for r in rows) == names
    assert len({r.task for r in rows}) == 10


def test_a_task_lists_several_folders_if_there_are_many(spark, tmp_path, monkeypatch):
    names, tasks, durable = [f"s{n:03}/f{n}" for n in range(60)], [], listing.durable
    for name in names:
        (tmp_path / name).parent.mkdir()
        (tmp_path / name).write_text(name)
    monkeypatch.setattr(listing, "durable", lambda files, label: (tasks.append(files.rdd.getNumPartitions()), durable(files, label))[1])
    rows = listing.read_files(spark, str(tmp_path)).collect()
    assert sorted((r.path, bytes(r.content).decode()) for r in rows) == [(name, name) for name in names]
    assert tasks == [listing.LISTING_TASKS * spark.sparkContext.defaultParallelism]


def test_a_local_folder_is_listed_name_by_name(tree, monkeypatch):
    def whole(*args, **kwargs):
        raise AssertionError("a folder's names at once")

    root, names = tree
    monkeypatch.setattr(listing.pafs, "FileSelector", whole)
    reader = listing.FileReader(root, 1, "", (), ())
    assert sorted(p for s in reader.partitions() for b in reader.read(s) for p in b.column("path").to_pylist()) == names


def test_service_outputs_are_not_listed_on_the_driver(spark, tmp_path):
    (tmp_path / "u1.software.json").write_text('{"version": "0.7.2"}')
    (tmp_path / "u2.tei.xml").write_text("<TEI/>")
    found = objects.scan_service_outputs(spark, str(tmp_path))
    assert sorted(map(tuple, found.collect())) == [(f"{tmp_path}/u1.software.json", '{"version": "0.7.2"}'), (f"{tmp_path}/u2.tei.xml", None)]
    assert not [path for path in found.inputFiles() if str(tmp_path) in path]


@pytest.mark.parametrize("name", ["list_files", "read_files"])
def test_only_some_files_are_on_the_disk_at_once(spark, monkeypatch, name):
    sf, most, operator = "/root/testdata/sf0.001", [], getattr(listing, name)
    whole = sorted(map(tuple, QUERIES[name](spark, sf).collect()))

    def counted(spark, folder, *args, **options):
        most.append(sum(len(names) for _, _, names in os.walk(folder.removeprefix("file:"))))
        return operator(spark, folder, *args, **options)

    monkeypatch.setattr(given_files, "FILES_AT_ONCE", 100)
    monkeypatch.setattr(listing, name, counted)
    before = set(session._SCRATCH[spark.sparkContext.applicationId])
    assert sorted(map(tuple, QUERIES[name](spark, sf).collect())) == whole
    made = [p for p in session._SCRATCH[spark.sparkContext.applicationId] if p not in before]
    assert len(most) > 2 and sum(most) == a.status(spark, sf).count() and max(most) < 200
    assert not [p for p in made if "payload-files-" in p and "found" not in p and os.path.exists(p.removeprefix("file:"))]


def test_numbers_and_sets_are_compressed_with_zstd(spark, tmp_path):
    from sheaf.operators import class_sets

    lists = spark.range(50).selectExpr("'oa' as class", "concat('10.1/', id) as doi")
    class_sets.append_sets(lists, str(tmp_path), 0)
    written = [f.name for f in tmp_path.rglob("*.parquet")]
    assert written and all(name.endswith(".zstd.parquet") for name in written)
    assert [tuple(r) for r in class_sets.set_sizes(class_sets.merged_sets(spark, str(tmp_path))).collect()] == [("oa", 50)]


def on_disk(root):
    return {os.path.relpath(os.path.join(at, name), root): open(os.path.join(at, name), "rb").read() for at, _, names in os.walk(root) for name in names}


def test_files_of_a_part_become_those_of_the_next(spark, monkeypatch):
    seen, drops, drop, operator = [], [], given_files.drop_files, listing.list_files

    def counted(spark, folder, *args, **options):
        found = [os.path.join(at, name) for at, _, names in os.walk(folder.removeprefix("file:")) for name in names]
        seen.append({os.stat(path).st_ino for path in found})
        return operator(spark, folder, *args, **options)

    whole = sorted(map(tuple, QUERIES["list_files"](spark, "/root/testdata/sf0.001").collect()))
    monkeypatch.setattr(given_files, "FILES_AT_ONCE", 500)
    monkeypatch.setattr(given_files, "drop_files", lambda spark, folder: (drops.append(folder), drop(spark, folder)))
    monkeypatch.setattr(listing, "list_files", counted)
    assert sorted(map(tuple, QUERIES["list_files"](spark, "/root/testdata/sf0.001").collect())) == whole
    assert len(seen) > 2 and len(drops) == 1
    assert all(len(now & before) > min(len(now), len(before)) // 2 for before, now in zip(seen, seen[1:]))


@pytest.mark.parametrize("name, lanes", [("read_files", 1), ("scan_service_outputs", 2), ("read_service_outputs", 2)])
def test_folders_are_made_and_read_at_the_same_time(spark, monkeypatch, name, lanes):
    sf, roots, write = "/root/testdata/sf0.001", [], given_files.write_files

    def counted(rows, folder, gone=None):
        roots.append(folder)
        write(rows, folder, gone)

    whole = sorted(map(tuple, QUERIES[name](spark, sf).collect()), key=str)
    monkeypatch.setattr(given_files, "FILES_AT_ONCE", 200)
    monkeypatch.setattr(given_files, "write_files", counted)
    assert sorted(map(tuple, QUERIES[name](spark, sf).collect()), key=str) == whole
    assert len(set(roots)) == lanes < len(roots)
    assert not [root for root in roots if os.path.exists(root.removeprefix("file:"))]


def test_renamed_files_are_the_wanted_ones(tmp_path):
    draw, root, held = random.Random(5), str(tmp_path), {}
    for _ in range(30):
        wanted = {}
        for _ in range(draw.randrange(40)):
            folders = [draw.choice("abc") for _ in range(draw.choice([1, 1, 3, 5]))]
            wanted["/".join(["p", *folders, f"f{draw.randrange(30)}"])] = b"x" * draw.randrange(6)
        given_files._replace(root, sorted(held), wanted)
        assert on_disk(root) == wanted
        held = wanted


def test_a_task_that_broke_off_renames_again(tmp_path, monkeypatch):
    root, rename, left = str(tmp_path), os.rename, [3]
    old = {f"p/a{n}/b/c/old{n}": b"long old text" for n in range(4)}
    new = {f"p/z{n}/y/x/new{n}": b"new" for n in range(4)}
    given_files._replace(root, [], old)

    def breaks(*names):
        left[0] -= 1
        if left[0] < 0:
            raise KeyboardInterrupt
        rename(*names)

    with monkeypatch.context() as broken, pytest.raises(KeyboardInterrupt):
        broken.setattr(os, "rename", breaks)
        given_files._replace(root, sorted(old), new)
    given_files._replace(root, sorted(old)[:2], dict(reversed(new.items())))
    given_files._replace(root, sorted(old)[2:], {})
    assert on_disk(root) == new
