"""Coverage classes, set operations and report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import adapters as a
from checks.registry import query
from checks.sql import statement
from sheaf.functions import records as r
from sheaf.operators import coverage as c
from sheaf.plans.coverage_report import coverage_report as run_report

BY_DOI = """,
bydoi as (select doi, bool_or(ca) as ca, bool_or(oa) as oa, bool_or(wiley_ca) as wiley_ca, bool_or(wiley_oa) as wiley_oa,
  bool_or(elsevier_ca) as elsevier_ca, bool_or(hal_loc) as hal, doi in (select doi from status) as done
  from classed where doi is not null group by doi)"""


def classified(spark, sf):
    return c.classify(a.records(spark, sf), "location")


def by_doi(spark, sf):
    return c.per_doi(classified(spark, sf))


def universe(spark, sf):
    return c.harvested_universe(by_doi(spark, sf), a.status(spark, sf))


def _flag(name, column, sql_column):
    @query(name, statement(f"select line_no, {sql_column} as flag from classed", "classed"))
    def run(spark, sf):
        found = a.records(spark, sf).where(F.size("oa_details") > 0)
        return found.select("line_no", column(F.col("oa_details"), F.col("publisher_normalized")).alias("flag"))

    return run


_flag("is_closed", lambda details, publisher: r.is_closed(details), "ca")
_flag("wiley_closed", lambda details, publisher: r.is_closed(details) & (publisher == "Wiley"), "wiley_ca")
_flag("wiley_open", lambda details, publisher: ~r.is_closed(details) & r.has_wiley_pdf(details), "wiley_oa")
_flag("elsevier_closed", lambda details, publisher: r.is_closed(details) & (publisher == "Elsevier"), "elsevier_ca")
_flag("hal_hosted", lambda details, publisher: r.on_hal_location(details), "hal_loc")
_flag("hal_hosted_observation", lambda details, publisher: r.on_hal_observation(details), "hal_obs")


LISTS = " union all ".join(f"select '{n}' as class, doi from classed where {n}" for n in c.CLASSES)


@query("class_doi_lists", statement(LISTS, "classed"))
def class_doi_lists(spark, sf):
    return c.class_lists(classified(spark, sf))


@query("classify_all", statement(
    "select doi, ca, oa, wiley_ca, wiley_oa, elsevier_ca, hal_loc as hal from classed", "classed"))
def classify_all(spark, sf):
    return classified(spark, sf)


@query("repo_label", statement(
    """select line_no, case when wiley_ca or wiley_oa then 'Wiley' when hal_obs then 'HAL' else 'NC' end as repo
from classed""", "classed"))
def repo_label(spark, sf):
    details, publisher = F.col("oa_details"), F.col("publisher_normalized")
    wiley = (r.is_closed(details) & (publisher == "Wiley")) | (~r.is_closed(details) & r.has_wiley_pdf(details))
    return (
        a.records(spark, sf)
        .where(F.size("oa_details") > 0)
        .select("line_no", r.repo_label(wiley, r.on_hal_observation(details)).alias("repo"))
    )


@query("harvested_universe", statement("select * from universe", "universe"))
def harvested_universe(spark, sf):
    return universe(spark, sf)


@query("universe_union", statement("select doi, is_oa from universe", "universe"))
def universe_union(spark, sf):
    return c.universe_union(by_doi(spark, sf))


@query("distinct_dois", statement("select distinct doi from classed where oa and doi is not null", "classed"))
def distinct_dois(spark, sf):
    return c.distinct_dois(by_doi(spark, sf), "oa")


@query("intersect_harvested", statement(
    "select doi from classed where oa intersect select doi from status", "classed", "status"))
def intersect_harvested(spark, sf):
    return c.intersect_harvested(by_doi(spark, sf), a.status(spark, sf), "oa")


@query("missing_dois", statement(
    "select doi from classed where ca and doi is not null except select doi from status", "classed", "status"))
def missing_dois(spark, sf):
    return c.missing_dois(by_doi(spark, sf), a.status(spark, sf), "ca")


FLAGGED = """select uuid, doi in (select doi from classed where oa and doi is not null) as oa,
  doi in (select doi from classed where ca and doi is not null) as ca, harvester_used from status"""


@query("harvest_flags", statement(f"select uuid, oa, ca from ({FLAGGED}) x", "classed", "status"))
def harvest_flags(spark, sf):
    return c.harvest_flags(a.status(spark, sf), by_doi(spark, sf)).select("uuid", "oa", "ca")


@query("residual_as_open", statement(
    f"select uuid, oa, ca, oa or (not ca and harvester_used = 'standard') as oa_or_standard from ({FLAGGED}) x",
    "classed", "status"))
def residual_as_open(spark, sf):
    flagged = c.harvest_flags(a.status(spark, sf), by_doi(spark, sf))
    return c.residual_as_open(flagged).select("uuid", "oa", "ca", "oa_or_standard")


TOTALS = """select nb_oa + nb_ca as total_nb, nb_oa, nb_ca, nb_oa / (nb_oa + nb_ca) as oa_share, nb_ca / (nb_oa + nb_ca) as ca_share
from (select count(*) filter (oa) as nb_oa, count(*) filter (ca) as nb_ca from bydoi) x"""


@query("coverage_totals", statement(TOTALS, "classed", "status", more=BY_DOI))
def coverage_totals(spark, sf):
    return c.coverage_totals(by_doi(spark, sf))


@query("percent_format", statement(
    f"""select format('{{:,}}', total_nb) as total_nb, format('{{:,}}', nb_oa) as nb_oa,
  printf('%.2f%%', oa_share * 100) as oa_share, format('{{:,}}', nb_ca) as nb_ca, printf('%.2f%%', ca_share * 100) as ca_share
from ({TOTALS}) t""", "classed", "status", more=BY_DOI))
def percent_format(spark, sf):
    return c.percent_format(c.coverage_totals(by_doi(spark, sf)))


HARVESTED = f"""select harvested, harvested / total_nb as harvested_share, oa_harvested, oa_harvested / nb_oa as oa_share,
  ca_harvested, ca_harvested / nb_ca as ca_share, harvested - oa_harvested - ca_harvested as neither
from ({TOTALS}) t cross join (select count(*) as harvested, count(*) filter (oa) as oa_harvested, count(*) filter (ca) as ca_harvested
  from ({FLAGGED}) f) h"""


@query("coverage_harvested", statement(HARVESTED, "classed", "status", more=BY_DOI))
def coverage_harvested(spark, sf):
    return c.coverage_harvested(by_doi(spark, sf), a.status(spark, sf))


PUBLISHERS = " union all ".join(
    f"select '{g}' as class, count(*) filter (done) as harvested, count(*) as total, "
    f"count(*) filter (done) / count(*) as share from bydoi where {g}"
    for g in ("elsevier_ca", "wiley_oa", "wiley_ca")
)


@query("publisher_coverage", statement(PUBLISHERS, "classed", "status", more=BY_DOI))
def publisher_coverage(spark, sf):
    return c.publisher_coverage(by_doi(spark, sf), a.status(spark, sf))


CUBE = "select is_oa, is_harvested, repo, count(doi) as n from universe group by is_oa, is_harvested, repo"
ROLLUP = """select is_oa, is_harvested, repo, count(doi) as n from universe
group by grouping sets ((is_oa, is_harvested, repo), (is_oa, is_harvested))"""


@query("coverage_cube", statement(CUBE, "universe"))
def coverage_cube(spark, sf):
    return c.coverage_cube(universe(spark, sf))


@query("coverage_rollup", statement(ROLLUP, "universe"))
def coverage_rollup(spark, sf):
    return c.coverage_rollup(universe(spark, sf))


@query("coverage_by_repo", statement(
    "select repo, is_harvested, count(*) as n from universe where repo <> 'NC' group by repo, is_harvested", "universe"))
def coverage_by_repo(spark, sf):
    return c.coverage_by_repo(universe(spark, sf))


@query("coverage_of_repo", statement(
    "select is_oa, is_harvested, count(*) as n from universe where repo = 'Wiley' group by is_oa, is_harvested", "universe"))
def coverage_of_repo(spark, sf):
    return c.coverage_of_repo(universe(spark, sf), "Wiley")


REPORT = f"""select 'totals' as part, 'total' as a, '' as b, '' as c, total_nb as n from ({TOTALS}) t
union all select 'totals', 'oa', '', '', nb_oa from ({TOTALS}) t
union all select 'totals', 'ca', '', '', nb_ca from ({TOTALS}) t
union all select 'harvested', 'all', '', '', harvested from ({HARVESTED}) h
union all select 'harvested', 'oa', '', '', oa_harvested from ({HARVESTED}) h
union all select 'harvested', 'ca', '', '', ca_harvested from ({HARVESTED}) h
union all select 'publisher', class, 'harvested', '', harvested from ({PUBLISHERS}) p
union all select 'publisher', class, 'total', '', total from ({PUBLISHERS}) p
union all select 'rollup', cast(is_oa as varchar), cast(is_harvested as varchar), coalesce(repo, 'all'), n from ({ROLLUP}) r"""


@query("coverage_report", statement(REPORT, "universe", "classed", "status", more=BY_DOI))
def coverage_report(spark, sf):
    report = run_report(a.records(spark, sf), a.status(spark, sf), "location")

    def part(name, df, first, second="", third="", n="n"):
        def text(value):
            return F.lit(value) if isinstance(value, str) else value

        return df.select(
            F.lit(name).alias("part"),
            text(first).alias("a"),
            text(second).alias("b"),
            text(third).alias("c"),
            F.col(n).alias("n"),
        )

    def entries(name, df, **columns):
        pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("a"), F.col(v).alias("n")) for k, v in columns.items()]))
        return part(name, df.select(pairs.alias("p")).select("p.*"), F.col("a"))

    publishers = report.publishers.select(
        "class",
        F.explode(
            F.array(
                F.struct(F.lit("harvested").alias("b"), F.col("harvested").alias("n")),
                F.struct(F.lit("total").alias("b"), F.col("total").alias("n")),
            )
        ).alias("p"),
    ).select("class", "p.*")
    rollup = report.rollup.select(
        F.col("is_oa").cast("string").alias("is_oa"),
        F.col("is_harvested").cast("string").alias("is_harvested"),
        F.coalesce("repo", F.lit("all")).alias("repo"),
        "n",
    )
    return (
        entries("totals", report.totals, total="total_nb", oa="nb_oa", ca="nb_ca")
        .unionByName(entries("harvested", report.harvested, all="harvested", oa="oa_harvested", ca="ca_harvested"))
        .unionByName(part("publisher", publishers, F.col("class"), F.col("b")))
        .unionByName(part("rollup", rollup, F.col("is_oa"), F.col("is_harvested"), F.col("repo")))
    )
