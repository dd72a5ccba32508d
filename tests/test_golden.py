"""Vectors with known results."""

import json

import pytest
from pyspark.sql import functions as F

from sheaf.functions import paths, payload, records as r, report, urls
from sheaf.operators import attempts as att
from sheaf.operators import backlog, candidates, dedup, index, ledger, status as st
from sheaf.operators.coverage import classify
from sheaf.plans.manifest import build_manifest
from sheaf.plans.processing import plan_processing
from sheaf.schemas import PUBLICATION, STATUS
from sheaf.sources.publications import parse_lines


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    "url, path",
    [
        ("http://arxiv.org/pdf/1501.00001", "arxiv/1501/1501.00001/1501.00001.pdf.gz"),
        ("https://arxiv.org/pdf/math-co/9901123", "math-co/9901/9901123/9901123.pdf.gz"),
        ("https://arxiv.org/pdf/1501.1.pdf", "arxiv/1501/1501.1.pdf/1501.1.pdf.pdf.gz"),
        ("https://arxiv.org/abs/1501.1", None),
        ("https://arxiv.org/pdf/", None),
        (None, None),
    ],
)
def test_arxiv_mirror_path(spark, url, path):
    assert one(spark, paths.arxiv_mirror_path, url) == path


def test_storage_paths(spark):
    assert one(spark, paths.shard_path, "abcdefghij") == "ab/cd/ef/gh/abcdefghij"
    assert one(spark, paths.storage_path, "uuid_0") == "publication/uu/id/_0//uuid_0/uuid_0.pdf.gz"
    uuid = "0f1e2d3c-4b5a-4978-8675-a4b3c2d1e0f9"
    assert one(spark, paths.storage_path, uuid) == f"publication/0f/1e/2d/3c/{uuid}/{uuid}.pdf.gz"
    assert one(spark, paths.storage_path, None) is None


@pytest.mark.parametrize(
    "text, want",
    [
        ("/a/", "a"),
        ("\\/a\\/", "a"),
        ("//\\\\/a", "a"),
        ("", ""),
        ("/", ""),
        ("\\/\\/a/b\\", "/a/b"),
        ("/\\/\\/a", "/a"),
    ],
)
def test_strip_slashes(spark, text, want):
    assert one(spark, paths.strip_slashes, text) == want


def test_uuid_from_path(spark):
    assert one(spark, paths.uuid_from_path, "a/b/u-1.software.json") == "u-1"
    assert one(spark, paths.uuid_from_path, "u-1") == "u-1"


def test_uuid_from_doi(spark):
    made = one(spark, paths.uuid_from_doi, "10.1/x")
    assert [len(p) for p in made.split("-")] == [8, 4, 4, 4, 12]
    assert made == one(spark, paths.uuid_from_doi, "10.1/x")


def test_publisher_api_urls(spark):
    base = "https://publisher/"
    assert one(spark, lambda x: urls.publisher_api_url(x, "wiley", base), "10.9/p.q") == base + "10.9%2Fp.q"
    assert one(spark, lambda x: urls.publisher_api_url(x, "elsevier", base), "10.9/p.q") == base + "10.9/p.q"
    with pytest.raises(ValueError):
        urls.publisher_api_url(F.lit("x"), "other", base)


@pytest.mark.parametrize(
    "url, both, neither",
    [
        ("http://arxiv.org/pdf/1", "arxiv", "arxiv"),
        ("https://arxiv.org/pdf/1", "arxiv", "arxiv"),
        ("https://x.org/https://arxiv.org", "standard", "standard"),
        ("https://onlinelibrary.wiley.com/x", "wiley", "standard"),
        ("https://api.elsevier.com/x", "elsevier", "standard"),
        ("https://wiley.elsevier.com/x", "wiley", "standard"),
        ("https://WILEY.com", "standard", "standard"),
    ],
)
def test_channels(spark, url, both, neither):
    assert one(spark, urls.channel, url) == both
    assert one(spark, lambda x: urls.channel(x, False, False), url) == neither


def test_user_agent(spark):
    assert one(spark, lambda x: urls.user_agent(x, "agent"), "https://www.cairn.example/x") == "agent"
    assert one(spark, lambda x: urls.user_agent(x, "agent"), "") is None


def test_valid_pdf(spark):
    assert one(spark, payload.valid_pdf, b"%PDF-1.7", "binary") is True
    assert one(spark, payload.valid_pdf, b"%PD", "binary") is False
    assert one(spark, payload.valid_pdf, b"", "binary") is False
    assert one(spark, payload.valid_pdf, b"\xff\xfe\x00\x01\x02", "binary") is False
    assert one(spark, payload.valid_pdf, None, "binary") is False
    assert one(spark, payload.valid_pdf, " %PDF-") is False


@pytest.mark.parametrize(
    "html, target",
    [
        ('<p><a id="redirect" href="u?a=1&amp;b=2">x</a>', "u?a=1&b=2"),
        ("<A class=z HREF='u' ID='redirect'>x</A>", "u"),
        ("<a id=redirect href=u>x</a>", "u"),
        ('<a id="redirect2" href="u">', None),
        ('<a data-id="redirect" href="u">', None),
        ('<a href="other">o</a><a href="u" id="redirect">', "u"),
        ("no links", None),
        ('<!-- <a id="redirect" href="old"> --><a id="redirect" href="new">', "new"),
        ('<!-- <a id="redirect" href="old">', None),
        ('<a title="a > b" id="redirect" href="u">', "u"),
        ("""<a title=' id="redirect" ' href="u">""", None),
        ('<a id="redirect" href="https:&#47;&#x2F;h/?q=&quot;a&quot;&amp;amp;&unknown;&">', 'https://h/?q="a"&amp;&unknown;&'),
        ('<a hidden id="redirect" href="u">', "u"),
        ('<a href="first" id="redirect"><a href="second" id="redirect">', "first"),
    ],
)
def test_redirect_target(spark, html, target):
    assert one(spark, payload.redirect_target, html) == target


def test_latest_key_is_the_greatest(spark):
    details = {k: {"is_oa": True} for k in ("2019", "2021Q4", "2020", "2021", "2021Q1")}
    rows = parse_lines(spark.createDataFrame([(json.dumps({"oa_details": details}),)], "value string"))
    got = rows.select(
        r.latest_key(F.col("oa_details")).alias("greatest"),
        r.nth_key(F.col("oa_details"), -1).alias("last"),
        r.nth_key(F.col("oa_details"), 0).alias("first"),
        r.nth_key(F.col("oa_details"), 4).alias("fifth"),
        r.nth_key(F.col("oa_details"), 5).alias("none"),
        r.nth_key(F.col("oa_details"), -6).alias("none_either"),
    ).first()
    assert tuple(got) == ("2021Q4", "2021Q1", "2019", "2021Q1", None, None)


def location(url, repo="absent", host="repository"):
    loc = {"host_type": host, "url_for_pdf": url}
    if repo != "absent":
        loc["repository_normalized"] = repo
    return loc


def dump(spark, *entries):
    lines = [(json.dumps(entry), n) for n, entry in enumerate(entries)]
    return parse_lines(spark.createDataFrame(lines, "value string, line_no bigint"), PUBLICATION).drop("value")


def entry(doi="10.1/a", publisher="N/A", country=("fr",), **observations):
    return {
        "doi": doi,
        "publisher_normalized": publisher,
        "bso_classification": "Biology",
        "bso_country_corrected": list(country) if country is not None else None,
        "oa_details": {key.lstrip("y"): value for key, value in observations.items()},
    }


def opened(*locations):
    return {"is_oa": True, "oa_locations": list(locations)}


CLOSED = {"is_oa": False}


def test_ranking_order(spark):
    mixed = opened(
        location("https://wiley.com/1", host="publisher"),
        location("https://bmc.com/1", host="publisher"),
        location("https://repo/absent-key", host="repository"),
        location("https://repo/null-key", None),
        location("https://repo/1", "univoak.eu"),
        location(None, "arXiv"),
        location("", "arXiv"),
        location("https://hal/1", "HAL"),
        location("https://pmc/1", "PubMed Central"),
        location("https://hal/2", "HAL"),
        location("http://arxiv.org/pdf/1", "arXiv", "publisher"),
        {"url_for_landing_page": "x"},
        location("https://publisher-with-key", "other", "publisher"),
    )
    got = build_manifest(dump(spark, entry(y2020=CLOSED, y2021=mixed))).first()
    assert got.urls == [
        "http://arxiv.org/pdf/1",
        "https://pmc/1",
        "https://hal/1",
        "https://hal/2",
        "https://repo/null-key",
        "https://repo/1",
        "https://wiley.com/1",
        "https://bmc.com/1",
        "https://repo/absent-key",
        "https://publisher-with-key",
    ]
    assert [loc["url_for_pdf"] for loc in got.oa_locations] == got.urls
    assert "repository_normalized" in got.oa_locations[4]
    assert "repository_normalized" not in got.oa_locations[8]
    assert got.filename == f"data/{got.id}.pdf" and got.domain == "Biology"


def test_missing_host_type_falls_to_next_rule(spark):
    loc = {"url_for_pdf": "https://x/1", "repository_normalized": "r"}
    got = build_manifest(dump(spark, entry(y2021=opened(loc, location("https://wiley.com/1"))))).first()
    assert got.urls == ["https://wiley.com/1", "https://x/1"]


def test_closed_records(spark):
    rows = dump(
        spark,
        entry("10.1/w", "Wiley", y2020=opened(location("u")), y2021=CLOSED),
        entry("10.1/e", "Elsevier", y2021=CLOSED),
        entry("10.1/n", "N/A", y2021=CLOSED),
        entry("10.1/l", "wiley", y2021=CLOSED),
    )
    got = {row.doi: row.urls for row in build_manifest(rows).collect()}
    assert got == {
        "10.1/w": ["https://onlinelibrary.wiley.com/doi/pdfdirect/10.1/w"],
        "10.1/e": ["https://api.elsevier.com/content/article/doi/10.1/e"],
    }


def test_what_the_manifest_leaves_out(spark):
    good = opened(location("https://x/1"))
    rows = dump(
        spark,
        entry(None, y2021=good),
        entry("", y2021=good),
        entry("10.1/cn", country=("cn",), y2021=good),
        entry("10.1/none", country=None, y2021=good),
        entry("10.1/empty"),
        entry("10.1/nolocs", y2021={"is_oa": True}),
        entry("10.1/nourl", y2021=opened(location(None), location(""))),
        entry("10.1/ok", country=("cn", "fr"), y2021=good),
    )
    assert [row.doi for row in build_manifest(rows).collect()] == ["10.1/ok"]


def test_first_occurrence_wins_even_without_url(spark):
    rows = dump(
        spark,
        entry("10.1/a", y2021=opened(location(""))),
        entry("10.1/a", y2021=opened(location("https://x/late"))),
        entry("10.1/b", country=("cn",), y2021=opened(location("https://x/cn"))),
        entry("10.1/b", y2021=opened(location("https://x/fr"))),
        entry("10.1/B", y2021=opened(location("https://x/case"))),
    )
    got = {row.doi: row.urls for row in build_manifest(rows).collect()}
    assert got == {"10.1/b": ["https://x/fr"], "10.1/B": ["https://x/case"]}


def test_custom_rules(spark):
    rows = dump(spark, entry(y2021=opened(location("https://a"), location("https://b", "HAL"))))
    got = build_manifest(rows, rules=["loc['repository_normalized'] = 'HAL'"]).first()
    assert got.urls == ["https://b"]
    none = build_manifest(rows, rules=["loc['repository_normalized'] = 'arXiv'"])
    assert none.count() == 0
    with pytest.raises(ValueError):
        urls.rank_sql([])


def test_reprocess(spark):
    rows = dump(
        spark,
        *[entry(f"10.1/{name}", y2021=opened(location("https://x"))) for name in ("done", "failed", "new")],
    )
    known = spark.createDataFrame([("10.1/done", "u-done"), ("10.1/failed", "u-failed")], "doi string, uuid string")
    entries = spark.createDataFrame(
        [("u-done", ["json", "pdf"]), ("u-failed", ["json"])], "id string, resources array<string>"
    )

    def ids(reprocess):
        built = build_manifest(rows, known=known, ledger=entries, reprocess=reprocess)
        return {row.doi: row.id for row in built.collect()}

    made = one(spark, paths.uuid_from_doi, "10.1/new")
    assert ids(True) == {"10.1/failed": "u-failed", "10.1/new": made}
    assert ids(False) == {"10.1/new": made}
    with pytest.raises(ValueError):
        build_manifest(rows, known=known)


def status_table(spark, rows=10, softcite="0.7.2", grobid="0.7.2", datastet="0.7.2"):
    data = [
        (f"doi_{i}", f"uuid_{i}", "1", softcite, grobid, "standard", "arxiv", "http://arxiv.org/fake", None, datastet)
        for i in range(rows)
    ]
    return spark.createDataFrame(data, STATUS)


@pytest.mark.parametrize("spec, behind", [("0.7.2", 0), ("0.7.0", 0), ("0.7.5", 10)])
def test_version_backlog(spark, spec, behind):
    assert backlog.version_backlog(status_table(spark), {"grobid": spec}).count() == behind


def test_versions_compare_as_text(spark):
    rows = status_table(spark, 1, softcite="0.9.0")
    assert backlog.version_backlog(rows, {"softcite": "0.10.0"}).count() == 0
    assert backlog.version_backlog(rows, {"softcite": "0.10.0"}, semver=True).count() == 1
    missing = status_table(spark, 1, softcite=None)
    assert backlog.version_backlog(missing, {"softcite": "0.1"}).first().version == "0"


def test_plan_processing(spark):
    rows = status_table(spark)
    plan = plan_processing(rows, {"softcite": "0.7.5"}, size=2).orderBy("batch_no").collect()
    assert [len(p.softcite_files) for p in plan] == [2] * 5
    assert plan[1].softcite_files == [
        "publication/uu/id/_2//uuid_2/uuid_2.pdf.gz",
        "publication/uu/id/_3//uuid_3/uuid_3.pdf.gz",
    ]
    assert all(p.grobid_files == [] and p.datastet_files == [] for p in plan)
    assert plan_processing(rows, {"softcite": "0.7.5"}, size=2, first_only=True).count() == 1
    assert plan_processing(rows).count() == 0
    with pytest.raises(ValueError):
        plan_processing(rows, {"other": "1"})


def test_plan_pads_shorter_services(spark):
    rows = status_table(spark, 5).withColumn(
        "grobid_version", F.when(F.col("uuid") == "uuid_3", "0.1").otherwise("0.9")
    )
    plan = plan_processing(rows, {"softcite": "0.8", "grobid": "0.8"}, size=2).orderBy("batch_no").collect()
    assert [len(p.softcite_files) for p in plan] == [2, 2, 1]
    assert [len(p.grobid_files) for p in plan] == [1, 0, 0]


@pytest.mark.parametrize("size, sizes", [(2, [2, 2, 2, 2, 1]), (10, [9]), (9, [9]), (4, [4, 4, 1])])
def test_fixed_batches(spark, size, sizes):
    items = index.global_index(spark.range(1, 10), ["id"])
    got = index.batch_numbers(items, size).groupBy("batch_no").agg(F.array_sort(F.collect_list("id")).alias("b"))
    lists = [row.b for row in got.orderBy("batch_no").collect()]
    assert [len(b) for b in lists] == sizes and sum(lists, []) == list(range(1, 10))
    with pytest.raises(ValueError):
        index.batch_numbers(items, 0)


def test_slices(spark):
    items = index.global_index(spark.range(10), ["id"])

    def sizes(total, mode):
        rows = index.slice_ids(items, total, mode).groupBy("slice_id").count().collect()
        return {row.slice_id: row["count"] for row in rows}

    assert sizes(6, "reference") == {**{k: 1 for k in range(7)}, None: 3}
    assert sizes(6, "complete") == {**{k: 1 for k in range(6)}, 6: 4}
    assert sizes(11, "reference") == {None: 10}
    assert sum(sizes(11, "complete").values()) == 10
    assert sizes(3, "reference") == sizes(3, "complete") == {0: 3, 1: 3, 2: 3, 3: 1}
    assert [row.id for row in index.take_slice(items, 1, 3).orderBy("id").collect()] == [3, 4, 5]
    for bad in ((0, "complete"), (3, "other")):
        with pytest.raises(ValueError):
            index.slice_ids(items, *bad)


@pytest.mark.parametrize("stored", [3, 2, 0])
def test_confirm_uploaded_and_status_rows(spark, stored):
    pairs = spark.createDataFrame([(f"d{i}", f"aaaa{i}-uuid") for i in range(3)], "doi string, uuid string")
    objects = pairs.limit(stored).select(paths.storage_path(F.col("uuid")).alias("path"))
    entries = pairs.select(
        F.col("uuid").alias("id"), F.lit("arxiv").alias("harvester_used"), F.lit("dom").alias("domain"), F.lit("u").alias("url_used")
    )
    rows = st.status_rows(st.confirm_uploaded(pairs, objects), entries, "2022-06-24 19:00:00")
    assert rows.count() == stored and rows.schema.names == STATUS.names
    assert all(row.is_harvested == "1" and row.grobid_version == "0" for row in rows.collect())
    assert st.without_ledger(pairs, entries.limit(1)).count() == 2


def test_confirm_by_prefix(spark):
    pairs = spark.createDataFrame([("d", "uuid_0"), ("e", "uuid_1"), ("f", "uuid_2")], "doi string, uuid string")
    objects = spark.createDataFrame(
        [
            ("publication/uu/id/_0//uuid_0/uuid_0.pdf.gz.bak",),
            ("publication/uu/id/_1//uuid_1/uuid_1.pdf",),
            ("metadata/uu/id/_2//uuid_2/uuid_2.pdf.gz",),
        ],
        "path string",
    )
    assert st.confirm_uploaded(pairs, objects).count() == 0
    assert [row.doi for row in st.confirm_uploaded(pairs, objects, "prefix").collect()] == ["d"]
    with pytest.raises(ValueError):
        st.confirm_uploaded(pairs, objects, "other")


def test_doi_lists(spark):
    rows = spark.createDataFrame([("10.1/a",), ("10.1/b",), (None,), ("",)], "doi string")
    harvested = spark.createDataFrame([("10.1/b",), (None,)], "doi string")
    assert [row.doi for row in dedup.doi_allowlist(rows, ["10.1/a"]).collect()] == ["10.1/a"]
    assert dedup.doi_allowlist(rows, []).count() == 4
    assert dedup.doi_allowlist(rows, ["10.1/A"]).count() == 0
    many = ["10.1/a"] + [f"x{i}" for i in range(2_000)]
    assert [row.doi for row in dedup.doi_allowlist(rows, many).collect()] == ["10.1/a"]
    assert dedup.doi_allowlist(rows, None).count() == 4
    assert dedup.doi_allowlist(rows, rows.limit(0)).count() == 0
    status = status_table(spark)
    for count in (999, 1_000, 1_001, 5_000):
        kept = st.select_by_uuids(status, ["uuid_3"] + [f"x{i}" for i in range(count - 1)])
        assert kept.columns == status.columns and kept.count() == 1
    assert dedup.not_yet_harvested(status, harvested).columns == status.columns
    assert [row.doi for row in dedup.not_yet_harvested(rows, harvested).collect()] == ["10.1/a"]
    assert st.select_by_uuids(status_table(spark), []).count() == 0
    assert st.select_by_uuids(status_table(spark), ["uuid_3", "x"]).count() == 1


def test_upsert(spark):
    current = status_table(spark, 2)
    incoming = status_table(spark, 3, "1", "2", "3").withColumn("domain", F.lit("new"))
    merged = {row.uuid: row for row in st.upsert_status(current, incoming).collect()}
    assert len(merged) == 3
    assert merged["uuid_0"].domain == "arxiv" and merged["uuid_0"].softcite_version == "1"
    assert merged["uuid_2"].domain == "new"
    once = st.upsert_status(current, incoming)
    twice = st.upsert_status(once, incoming)
    assert sorted(once.collect()) == sorted(twice.collect())
    with pytest.raises(Exception, match="uuid twice"):
        st.upsert_status(current, incoming.unionByName(incoming)).collect()


def test_upsert_writes_nulls_over_versions(spark):
    merged = st.upsert_status(status_table(spark, 1), status_table(spark, 1, None, "9", None)).first()
    assert (merged.softcite_version, merged.grobid_version, merged.datastet_version) == (None, "9", None)


def test_apply_versions(spark):
    events = spark.createDataFrame(
        [(1, "uuid_0", "grobid", "1"), (2, "uuid_0", "grobid", "2"), (3, "uuid_1", "softcite", "3"), (4, "nobody", "grobid", "1"), (5, "uuid_0", "unheard", "1")],
        "seq bigint, uuid string, service string, version string",
    )
    rows = {row.uuid: row for row in st.apply_versions(status_table(spark, 3), events).collect()}
    assert rows["uuid_0"].grobid_version == "2" and rows["uuid_0"].softcite_version == "0.7.2"
    assert rows["uuid_1"].softcite_version == "3" and len(rows) == 3
    assert st.changed_rows(status_table(spark, 3), events).count() == 2
    assert [row.uuid for row in st.unknown_uuids(status_table(spark, 3), events).collect()] == ["nobody"]


STEPS = "id string, doi string, url_rank bigint, url string, channel string"


def test_fallback_plan(spark):
    steps = spark.createDataFrame(
        [("a", "d", 1, "https://arxiv.org/pdf/1", "arxiv"), ("a", "d", 2, "https://x", "standard")], STEPS
    )
    plan = candidates.fallback_plan(steps).orderBy("attempt_no").collect()
    assert [(p.url, p.channel) for p in plan] == [
        ("https://arxiv.org/pdf/1", "arxiv"),
        ("https://arxiv.org/pdf/1", "standard"),
        ("https://x", "standard"),
    ]


@pytest.mark.parametrize(
    "captured, want",
    [
        ([("w", "wiley", "success")], ("success", "wiley", "w")),
        ([("w", "wiley", "fail"), ("w", "standard", "success")], ("success", "standard", "w")),
        ([("w", "wiley", "error"), ("w", "standard", "success"), ("x", "standard", "success")], ("success", "standard", "x")),
        ([("w", "wiley", "error"), ("w", "standard", "success")], ("fail", "", "")),
        ([("w", "arxiv", "success"), ("x", "standard", "fail")], ("fail", "", "")),
        ([("x", "standard", "success"), ("w", "standard", "fail")], ("success", "standard", "x")),
        ([("w", "wiley", "fail"), ("w", "wiley", "success")], ("success", "wiley", "w")),
        ([], ("fail", "", "")),
    ],
)
def test_resolve_steps(spark, captured, want):
    steps = spark.createDataFrame([("a", "d", 1, "w", "wiley"), ("a", "d", 2, "x", "standard")], STEPS)
    seen = spark.createDataFrame(captured, "url string, channel string, outcome string")
    got = att.resolve_steps(steps, seen).first()
    assert (got.result, got.harvester_used, got.url_used) == want and got.last_url == "x"


def test_success_needs_a_valid_file(spark):
    steps = spark.createDataFrame([("a", "d", 1, "x", "standard"), ("b", "d", 1, "y", "standard")], STEPS)
    seen = spark.createDataFrame(
        [("x", "standard", "success", True), ("y", "standard", "success", False)],
        "url string, channel string, outcome string, valid_file boolean",
    )
    good, bad = att.split_outcomes(att.resolve_steps(steps, seen))
    assert [row.id for row in good.collect()] == ["a"] and [row.id for row in bad.collect()] == ["b"]
    assert ledger.failure_rows(bad).first().url == "y"
    assert ledger.failure_rows(bad, reference_compat=True).first().url == "no url"


def test_ledger_rows(spark):
    rows = spark.createDataFrame(
        [("a", "d", "std", "u", "dom", True, {"url_for_pdf": "p"}), ("b", None, "", "", "dom", None, {"url": "p"})],
        "id string, doi string, harvester_used string, url_used string, domain string, "
        "valid_fulltext_pdf boolean, best_oa_location map<string, string>",
    )
    a, b = ledger.ledger_rows(rows, "2024-01-02").orderBy("id").collect()
    assert a.resources == ["json", "pdf"] and a.oa_link == "p" and a.harvested_date == "2024-01-02"
    assert b.resources == ["json"] and b.oa_link is None and b.pmid is None


def page(name, target=None):
    return f'<a id="redirect" href="{target}">' if target else ("%PDF-1" if name.startswith("pdf") else "<html>")


def test_redirects(spark):
    chain = [(n, f"p{n}", page(f"p{n}", f"p{n + 1}")) for n in range(7)]
    rows = [*chain, (7, "p7", "%PDF-1"), (8, "loop", page("loop", "loop")), (9, "end", "<html>"), (10, "out", page("out", "gone"))]
    captured = spark.createDataFrame(rows, "page_id bigint, url string, content string")
    got = {row.url: (row.final_url, row.hops, row.reason) for row in att.resolve_urls(captured).collect()}
    assert got == {
        **{f"p{n}": ("p7", 7 - n, "pdf") for n in range(2, 8)},
        "p0": ("p6", 5, "open"),
        "p1": ("p7", 5, "open"),
        "loop": ("loop", 5, "open"),
        "end": ("end", 0, "dead end"),
        "out": ("gone", 1, "dead end"),
    }
    plan = spark.createDataFrame([("a", 1, "p0"), ("a", 2, "p3"), ("a", 3, "p7"), ("b", 1, "end"), ("c", 1, "absent")], "id string, attempt_no int, url string")
    done = {row.id: (row.result, row.url_used, row.hops) for row in att.resolve_fetches(plan, captured).collect()}
    assert done == {"a": ("success", "p3", 4), "b": ("fail", "", None), "c": ("fail", "", None)}


def test_throttle(spark):
    requests = spark.createDataFrame([("w", i) for i in range(4)] + [("e", i) for i in range(3)], "client string, n int")
    plan = candidates.throttle_schedule(requests, "client", ["n"], "2024-01-01 00:00:00", {"w": (2, 15)}, (1, 1))
    got = sorted((row.client, row.n, row.slot, row.not_before.strftime("%S")) for row in plan.collect())
    assert got == [
        ("e", 0, 0, "00"), ("e", 1, 1, "01"), ("e", 2, 2, "02"),
        ("w", 0, 0, "00"), ("w", 1, 0, "00"), ("w", 2, 1, "15"), ("w", 3, 1, "15"),
    ]
    with pytest.raises(ValueError):
        candidates.throttle_schedule(requests, "client", ["n"], "2024-01-01", {"w": (0, 15)})


def test_service_versions(spark):
    outputs = spark.createDataFrame(
        [("o/b.software.json", '{"version": "2"}'), ("o/a.software.json", '{"version": "1"}'), ("o/a.tei.xml", "<TEI/>"), ("o/a.txt", "")],
        "path string, body string",
    )
    found = backlog.output_versions(outputs, "0.8")
    assert sorted((row.uuid, row.service, row.version) for row in found.collect()) == [
        ("a", "grobid", "0.8"), ("a", "softcite", "1"), ("b", "softcite", "2"),
    ]
    one_each = {row.service: row.version for row in backlog.service_batch_version(found).collect()}
    assert one_each == {"grobid": "0.8", "softcite": "1", "datastet": "0"}


def test_classes(spark):
    wiley_pdf = location("https://x.wiley.com/p")
    rows = dump(
        spark,
        entry("closed-wiley", "Wiley", y2021=opened(wiley_pdf), y2020=CLOSED),
        entry("open-wiley", "N/A", y2021=CLOSED, y2020=opened(location(None), wiley_pdf)),
        entry("closed-elsevier", "Elsevier", y2020=CLOSED),
        entry("open", "Wiley", y2020=opened(location("https://hal/1", "HAL"))),
        entry("none", "Wiley"),
    )
    got = {row.doi: [k for k, v in row.asDict().items() if v is True] for row in classify(rows, "location").collect()}
    assert got == {
        "closed-wiley": ["ca", "wiley_ca"],
        "open-wiley": ["oa", "wiley_oa"],
        "closed-elsevier": ["ca", "elsevier_ca"],
        "open": ["oa", "hal"],
    }
    assert {row.doi for row in classify(rows.drop("doi")).collect()} == {"no_doi"}
    with pytest.raises(ValueError):
        classify(rows, "elsewhere")


@pytest.mark.parametrize("ratio, text", [(0.12345, "12.35%"), (1.0, "100.00%"), (0.0, "0.00%"), (12.5, "1250.00%")])
def test_percent(spark, ratio, text):
    assert one(spark, report.percent, ratio, "double") == text == f"{ratio:.2%}"


def test_share_of_nothing(spark):
    assert one(spark, lambda x: report.share(x, F.lit(0)), 5, "bigint") is None


def test_pages_that_did_not_answer(spark):
    rows = [(1, "a", "%PDF-1", 200), (2, "b", "%PDF-1", 404), (3, "c", page("c", "a"), 500), (4, "d", page("d", "a"), 200)]
    captured = spark.createDataFrame(rows, "page_id bigint, url string, content string, status_code int")
    got = {row.url: row.reason for row in att.resolve_urls(captured).collect()}
    assert got == {"a": "pdf", "b": "dead end", "c": "dead end", "d": "pdf"}


def test_the_first_capture_of_a_url_counts(spark):
    rows = [(2, "a", "%PDF-1"), (1, "a", "<html>"), (3, "b", page("b", "a"))]
    captured = spark.createDataFrame(rows, "page_id bigint, url string, content string")
    assert {row.reason for row in att.resolve_urls(captured).collect()} == {"dead end"}
