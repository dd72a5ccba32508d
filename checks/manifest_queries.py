"""Records, candidate URLs, manifests and fetch plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import adapters as a
from checks.registry import query
from checks.sql import CLOSED_URL, channel_of, path_of, statement, uuid_of
from sheaf.functions import paths, payload, records as r, urls
from sheaf.operators import arrivals
from sheaf.operators import attempts as att
from sheaf.operators import candidates as cand
from sheaf.operators import dedup
from sheaf.operators.ledger import ledger_rows
from sheaf.plans import manifest as m

START = "2024-01-01 00:00:00"
LIMITS = {"click": (1, 15), "view": (3, 5), "purchase": (2, 1)}


@query("doi_present", statement("select line_no, doi from pubs where doi is not null and doi <> ''", "pubs"))
def doi_present(spark, sf):
    return a.pubs(spark, sf).where(r.has_doi(F.col("doi"))).select("line_no", "doi")


@query("country_filter", statement("select line_no, doi from rec where is_fr", "rec"))
def country_filter(spark, sf):
    return a.records(spark, sf).where(r.in_country(F.col("bso_country_corrected"), "fr")).select("line_no", "doi")


@query("latest_observation", statement("select line_no, obs_key, is_oa from rlatest", "rlatest"))
def latest_observation(spark, sf):
    details = F.col("oa_details")
    return (
        a.records(spark, sf)
        .where(F.size(details) > 0)
        .select(
            "line_no",
            r.latest_key(details).alias("obs_key"),
            r.latest_observation(details)["is_oa"].alias("is_oa"),
        )
    )


@query(
    "latest_observation_doc_order",
    statement(
        """select o.line_no, l.obs_key as last_key, f.obs_key as first_key, s.obs_key as second_key
from (select distinct line_no from robs) o join rlast l using (line_no)
join (select *, row_number() over (partition by line_no order by first_pos) as k from robs) f
  on f.line_no = o.line_no and f.k = 1
left join (select *, row_number() over (partition by line_no order by first_pos) as k from robs) s
  on s.line_no = o.line_no and s.k = 2""",
        "robs",
        "rlast",
    ),
)
def latest_observation_doc_order(spark, sf):
    details = F.col("oa_details")
    return (
        a.records(spark, sf)
        .where(F.size(details) > 0)
        .select(
            "line_no",
            r.nth_key(details, -1).alias("last_key"),
            r.nth_key(details, 0).alias("first_key"),
            r.nth_key(details, 1).alias("second_key"),
        )
    )


@query(
    "rank_candidate_urls",
    statement(
        "select line_no, cast(k as bigint) as url_rank, url from cand",
        "cand",
    ),
)
def rank_candidate_urls(spark, sf):
    latest = r.latest_observation(F.col("oa_details")).alias("obs")
    ranked = (
        a.records(spark, sf)
        .select("line_no", latest)
        .where("obs.is_oa")
        .select("line_no", urls.ranked_locations("obs.oa_locations").alias("located"))
    )
    return ranked.select("line_no", F.posexplode(urls.pdf_urls("located")).alias("pos", "url")).select(
        "line_no", (F.col("pos") + 1).cast("bigint").alias("url_rank"), "url"
    )


@query(
    "rank_flat_locations",
    statement(
        """select line_no, obs_key, url, row_number() over (partition by line_no, obs_key order by
  case when repo = 'arXiv' then 0 when repo = 'PubMed Central' then 1 when repo = 'HAL' then 2
       when repo is not null and host_type = 'repository' then 3 when contains(url, 'wiley') then 4 else 5 end, pos) as url_rank
from locs where coalesce(url, '') <> ''""",
        "locs",
    ),
)
def rank_flat_locations(spark, sf):
    return cand.rank_flat_locations(a.locs(spark, sf), ["line_no", "obs_key"], a.LOC_TIE_BREAK).select(
        "line_no", "obs_key", "url", "url_rank"
    )


@query("assign_ids", statement(f"select line_no, doi, {uuid_of('doi')} as id from pubs where doi is not null", "pubs"))
def assign_ids(spark, sf):
    return dedup.assign_ids(a.pubs(spark, sf).where(r.has_doi(F.col("doi")))).select("line_no", "doi", "id")


@query(
    "closed_access_urls",
    statement(
        f"select line_no, url from (select line_no, {CLOSED_URL} as url from rec join rlatest using (line_no) "
        "where not is_oa and doi is not null) x where url is not null",
        "rec",
        "rlatest",
    ),
)
def closed_access_urls(spark, sf):
    closed = a.records(spark, sf).where(
        ~r.latest_observation(F.col("oa_details"))["is_oa"] & r.has_doi(F.col("doi"))
    )
    url = urls.closed_access_url(F.col("doi"), F.col("publisher_normalized"))
    return closed.select("line_no", url.alias("url")).where("url is not null")


@query(
    "publisher_api_url",
    statement(
        """select line_no, concat('https://api.wiley.example/', replace(doi, '/', '%2F')) as wiley_url,
  concat('https://api.elsevier.example/', doi) as elsevier_url from pubs where doi is not null""",
        "pubs",
    ),
)
def publisher_api_url(spark, sf):
    doi = F.col("doi")
    return (
        a.pubs(spark, sf)
        .where(r.has_doi(doi))
        .select(
            "line_no",
            urls.publisher_api_url(doi, "wiley", "https://api.wiley.example/").alias("wiley_url"),
            urls.publisher_api_url(doi, "elsevier", "https://api.elsevier.example/").alias("elsevier_url"),
        )
    )


@query(
    "build_manifest",
    statement(
        """select id, doi, domain, concat('data/', id, '.pdf') as filename, cast(url_rank as bigint) as url_rank, url
from manifest""",
        "manifest",
    ),
)
def build_manifest(spark, sf):
    built = m.build_manifest(a.records(spark, sf))
    return built.select("id", "doi", "domain", "filename", F.posexplode_outer("urls").alias("pos", "url")).select(
        "id", "doi", "domain", "filename", (F.col("pos") + 1).cast("bigint").alias("url_rank"), "url"
    )


@query(
    "build_manifest_tables",
    statement(
        f"""select doi, domain, cast(k as bigint) as url_rank, url
from kept2 join (
  select l.line_no, url, row_number() over (partition by l.line_no order by
     case when repo = 'arXiv' then 0 when repo = 'PubMed Central' then 1 when repo = 'HAL' then 2
          when repo is not null and host_type = 'repository' then 3
          when contains(url, 'wiley') then 4 else 5 end, pos) k
  from locs l join ob using (line_no, obs_key) where is_oa and coalesce(url, '') <> '') c using (line_no)
union all
select doi, domain, 1, {CLOSED_URL} from kept2 join ob using (line_no)
where not is_oa and publisher_normalized in ('Wiley', 'Elsevier')""",
        "pubs",
        "locs",
        more=""",
kept2 as (select * from (select *, row_number() over (partition by doi order by line_no) rn
                         from pubs where doi is not null and country = 'fr') x where rn = 1),
lk as (select line_no, max(obs_key) obs_key from locs group by 1),
ob as (select l.line_no, l.obs_key, bool_or(loc_oa) is_oa from locs l join lk using (line_no, obs_key) group by 1, 2)""",
    ),
)
def build_manifest_tables(spark, sf):
    return m.build_manifest_tables(a.pubs(spark, sf), a.locs(spark, sf), a.LOC_TIE_BREAK)


@query(
    "route_url",
    statement(
        f"""select url, {channel_of('url')} as channel,
  case when starts_with(url,'http://arxiv.org') or starts_with(url,'https://arxiv.org') then 'arxiv'
       when contains(url,'elsevier') then 'elsevier' else 'standard' end as without_wiley from u""",
        "u",
    ),
)
def route_url(spark, sf):
    url = F.col("url")
    return a.record_urls(spark, sf).select(
        "url",
        urls.channel(url).alias("channel"),
        urls.channel(url, wiley=False).alias("without_wiley"),
    )


@query(
    "request_profile",
    statement("select url, case when contains(url, 'cairn') then 'publication-harvester' end as user_agent from u", "u"),
)
def request_profile(spark, sf):
    return a.record_urls(spark, sf).select(
        "url", urls.user_agent(F.col("url"), "publication-harvester").alias("user_agent")
    )


@query(
    "arxiv_mirror_path",
    statement(
        """select url, case when contains(url, 'arxiv.org/pdf/') then
  concat('arxiv/', substr(split_part(url, '/', 5), 1, 4), '/', split_part(url, '/', 5), '/',
         split_part(url, '/', 5), '.pdf.gz') end as path from u""",
        "u",
    ),
)
def arxiv_mirror_path(spark, sf):
    return a.record_urls(spark, sf).select("url", paths.arxiv_mirror_path(F.col("url")).alias("path"))


@query("storage_path", statement(f"select uuid, {path_of('uuid')} as path from status", "status"))
def storage_path(spark, sf):
    return a.status(spark, sf).select("uuid", paths.storage_path(F.col("uuid")).alias("path"))


@query("uuid_from_path", statement("select path, uuid from outputs", "outputs"))
def uuid_from_path(spark, sf):
    return a.outputs(spark, sf).select("path", paths.uuid_from_path(F.col("path")).alias("uuid"))


@query(
    "ledger_projection",
    statement(
        """select uuid as id, doi, case when line_no % 2 = 0 then concat('PMC', cast(line_no as varchar)) end as pmcid,
  concat('json', case when line_no % 7 <> 0 then ',pdf' else '' end, case when line_no % 4 = 1 then ',thumbnails' else '' end) as resources,
  '2024-03-05' as harvested_date, harvester_used, url_used, domain,
  case when line_no % 3 = 0 and line_no % 5 <> 0 then url_used end as oa_link
from status""",
        "status",
    ),
)
def ledger_projection(spark, sf):
    best = F.expr(
        "case when line_no % 3 = 0 then map('url_for_pdf', if(line_no % 5 <> 0, url_used, null)) end"
    )
    entries = a.status(spark, sf).select(
        F.col("uuid").alias("id"),
        "doi",
        F.expr("case when line_no % 2 = 0 then concat('PMC', cast(line_no as string)) end").alias("pmcid"),
        F.expr("line_no % 7 <> 0").alias("valid_fulltext_pdf"),
        F.expr("line_no % 4 = 1").alias("valid_thumbnails"),
        best.alias("best_oa_location"),
        "harvester_used",
        "url_used",
        "domain",
    )
    return ledger_rows(entries, "2024-03-05 10:00:00").select(
        "id",
        "doi",
        "pmcid",
        F.array_join("resources", ",").alias("resources"),
        "harvested_date",
        "harvester_used",
        "url_used",
        "domain",
        "oa_link",
    )


@query("valid_pdf", statement("select page_id, is_pdf from capture", "capture"))
def valid_pdf(spark, sf):
    return a.capture(spark, sf).select(
        "page_id", payload.valid_pdf(F.col("content").cast("binary")).alias("is_pdf")
    )


@query("ranking_rules", statement(
    """select line_no, pos, case when repo = 'HAL' then 0 when url like '%cairn%' then 1 when host_type = 'publisher' then 2 end as rank
from rlocs where url is not null and url <> '' and
  (repo = 'HAL' or url like '%cairn%' or host_type = 'publisher')""", "rlocs"))
def ranking_rules(spark, sf):
    rules = [
        "loc['repository_normalized'] = 'HAL'",
        "contains(loc['url_for_pdf'], 'cairn')",
        "loc['host_type'] = 'publisher'",
    ]
    # The slot of a location is recovered from its place inside its observation.
    obs = a.records(spark, sf).select("line_no", F.explode("oa_details").alias("obs_key", "obs"))
    ranked = obs.select("line_no", F.explode(urls.ranked_locations("obs.oa_locations", rules)).alias("loc"))
    number = F.regexp_extract(F.col("loc")["url_for_pdf"], r"(\d+)(?:\.pdf)?$", 1).cast("bigint")
    return ranked.select(
        "line_no",
        ((number - F.col("line_no") * 31) / 17).cast("bigint").alias("pos"),
        F.expr(urls.rank_sql(rules)).alias("rank"),
    )


@query(
    "fallback_plan",
    statement(
        f"""select id, doi, cast(url_rank as bigint) as url_rank, url,
  case when k = 0 then {channel_of('url')} else 'standard' end as channel, cast(url_rank * 2 + k as bigint) as attempt_no
from manifest cross join (select 0 as k union all select 1) t
where k = 1 or {channel_of('url')} <> 'standard'""",
        "manifest",
    ),
)
def fallback_plan(spark, sf):
    steps = cand.url_steps(m.build_manifest(a.records(spark, sf)))
    return cand.fallback_plan(steps).select("id", "doi", "url_rank", "url", "channel", "attempt_no")


@query(
    "throttle_schedule",
    """select event_id, client, slot, strftime(timestamp '2024-01-01 00:00:00' + to_seconds(slot * secs), '%Y-%m-%d %H:%M:%S') as not_before
from (select event_id, event_type as client,
  (row_number() over (partition by event_type order by ts, event_id) - 1)
    // case event_type when 'view' then 3 when 'purchase' then 2 else 1 end as slot,
  case event_type when 'click' then 15 when 'view' then 5 else 1 end as secs from events) x""",
)
def throttle_schedule(spark, sf):
    plan = cand.throttle_schedule(a.requests(spark, sf), "client", ["ts", "event_id"], START, LIMITS)
    return plan.select(
        "event_id", "client", "slot", F.date_format("not_before", "yyyy-MM-dd HH:mm:ss").alias("not_before")
    )


# Requests of a client to a window and its seconds.
ARRIVAL_LIMITS = {"click": (2, 7200), "view": (4, 10_800), "purchase": (1, 600), "signup": (3, 4000.5)}


@query(
    "throttle_arrivals",
    """with recursive arrived as (
  select event_id, event_type as client, epoch_us(ts) as a, row_number() over (partition by event_type order by ts, event_id) as i from events
), limits(client, most, span) as (
  values ('click', 2, 7200000000), ('view', 4, 10800000000), ('purchase', 1, 600000000), ('signup', 3, 4000500000), ('error', 1, 3600000000)
), sent(client, i, event_id, start, place, at_us) as (
  select client, i, event_id, a, 1, a from arrived where i = 1
  union all
  select s.client, r.i, r.event_id,
    case when r.a >= s.start + l.span then r.a when s.place < l.most then s.start else s.start + l.span end,
    case when r.a >= s.start + l.span then 1 when s.place < l.most then s.place + 1 else 1 end,
    case when r.a >= s.start + l.span then r.a when s.place < l.most then greatest(r.a, s.at_us) else s.start + l.span end
  from sent s join limits l using (client) join arrived r on r.client = s.client and r.i = s.i + 1
)
select event_id, client, start as window_us, place::bigint as place, at_us as sent_us from sent""",
)
def throttle_arrivals(spark, sf):
    sent = arrivals.throttle_arrivals(a.requests(spark, sf), "client", "ts", ARRIVAL_LIMITS, (1, 3600), ["event_id"])
    return sent.select("event_id", "client", F.unix_micros("window_start").alias("window_us"), "place", F.unix_micros("sent_at").alias("sent_us"))


# Windows of 2 and 3 hours and of 10 minutes for three clients, of one hour for the others.
ANCHORED_SQL = """with recursive limits(client, most, secs) as (
  select distinct event_type, case event_type when 'click' then 2 when 'view' then 4 else 1 end,
    case event_type when 'click' then 7200 when 'view' then 10800 when 'purchase' then 600 else 3600 end from events
), windows(client, start) as (
  select event_type, min(ts) from events group by 1
  union all
  select w.client, min(e.ts) from windows w join limits l using (client) join events e on e.event_type = w.client and e.ts >= w.start + to_seconds(l.secs) group by w.client
)
select w.client, epoch_us(w.start) as window_us, count(*) as n, count(*) > any_value(l.most) as over_limit
from windows w join limits l using (client) join events e on e.event_type = w.client and e.ts >= w.start and e.ts < w.start + to_seconds(l.secs)
group by 1, 2"""
ANCHORED_LIMITS = {"click": (2, 7200), "view": (4, 10_800), "purchase": (1, 600)}


@query("anchored_rate", ANCHORED_SQL)
def anchored_rate(spark, sf):
    counts = arrivals.anchored_rate(a.requests(spark, sf), ANCHORED_LIMITS, 3600)
    return counts.select("client", F.unix_micros("window_start").alias("window_us"), "n", "over_limit")


@query(
    "first_success",
    statement(
        """select key, case when ok then 'success' else 'fail' end as result,
  case when ok then channel else '' end as harvester_used, case when ok then url else '' end as url_used
from (select *, row_number() over (partition by key order by case when ok then 0 else 1 end, ts, event_id) as rn from attempts) x
where rn = 1""",
        "attempts",
    ),
)
def first_success(spark, sf):
    return att.first_success(a.attempts(spark, sf), ["key"], ["ts", "event_id"])


# Attempts in order, one row each, and the first success among them.
def _resolved(channel) -> str:
    """``channel``: URL -> SQL of its channel."""
    return f"""plan as (select id, doi, domain, url_rank, url, k, case when k = 0 then {channel('url')} else 'standard' end as ch
  from manifest cross join (select 0 as k union all select 1) t where k = 1 or {channel('url')} <> 'standard'),
tried as (select p.*, c.outcome, c.valid_file, e.outcome as own_outcome
  from plan p left join captured c on c.url = p.url and c.channel = p.ch
  left join captured e on e.url = p.url and p.k = 1 and e.channel = {channel('p.url')} and e.channel <> 'standard'),
won as (select * from (select *, row_number() over (partition by id order by url_rank, k) as rn from tried
  where outcome = 'success' and (k = 0 or coalesce(own_outcome, '') <> 'error')) x where rn = 1),
entries as (select m.id, m.doi, m.domain, case when w.id is not null then 'success' else 'fail' end as result,
    coalesce(w.ch, '') as harvester_used, coalesce(w.url, '') as url_used,
    coalesce(w.valid_file, false) as valid_fulltext_pdf, m.url as last_url
  from (select *, row_number() over (partition by id order by url_rank desc) as rn from manifest) m
  left join won w on w.id = m.id where m.rn = 1)"""


def plain_channel(url: str) -> str:
    """Without publisher clients."""
    return f"case when starts_with({url},'http://arxiv.org') or starts_with({url},'https://arxiv.org') then 'arxiv' else 'standard' end"


def with_resolved(body: str, *names: str, more: str = "", channel=channel_of) -> str:
    """``body`` over the resolved entries; ``more`` adds WITH items."""
    head = statement("", "manifest", "captured", *names).rstrip("\n")
    return head + ",\n" + _resolved(channel) + more + "\n" + body


@query("entry_split", with_resolved(
    """select id, result, harvester_used, url_used, valid_fulltext_pdf, last_url,
  result = 'success' and valid_fulltext_pdf as good from entries"""))
def entry_split(spark, sf):
    built = m.build_manifest(a.records(spark, sf))
    outcomes = att.resolve_steps(cand.url_steps(built), a.captured_outcomes(spark, sf), built.select("id", "urls"))
    good, bad = att.split_outcomes(outcomes)
    return good.withColumn("good", F.lit(True)).unionByName(bad.withColumn("good", F.lit(False)))


WALK = """,
walk as (select url as start, url, 0 as hops from capture
  union all select w.start, c.redirect, w.hops + 1 from walk w join capture c on c.url = w.url
  where not c.is_pdf and c.redirect is not null and w.hops < 5),
reach as (select w.start as url, w.url as final_url, w.hops from walk w join capture c on c.url = w.url where c.is_pdf)"""


@query(
    "resolve_fetches",
    statement(
        """select key as id, case when n = 0 then 'fail' else 'success' end as result, coalesce(url, '') as url_used, final_url, hops
from (select key, count(final_url) as n, arg_min(url, case when final_url is not null then ord end) as url,
   arg_min(final_url, case when final_url is not null then ord end) as final_url,
   arg_min(hops, case when final_url is not null then ord end) as hops
 from (select e.event_id % 97 as key, e.event_id as ord, p.url, r.final_url, r.hops
       from events e join pages p on e.event_id % (select count(*) from pages) = p.page_id
       left join reach r on r.url = p.url) t group by key) y""",
        "capture",
        more=WALK,
        recursive=True,
    ),
)
def resolve_fetches(spark, sf):
    pages = a.table(spark, sf, "pages").select("page_id", "url")
    size = pages.count()
    events = a.table(spark, sf, "events").select(
        (F.col("event_id") % 97).alias("id"),
        F.col("event_id").alias("attempt_no"),
        (F.col("event_id") % size).alias("page_id"),
    )
    plan = events.join(pages, "page_id").select("id", "attempt_no", "url")
    return att.resolve_fetches(plan, a.capture(spark, sf))


@query(
    "resolve_urls",
    statement(
        """select w.start as url, case when c.is_pdf or c.redirect is null then w.url else c.redirect end as final_url, w.hops,
  case when c.is_pdf then 'pdf' when c.redirect is null then 'dead end' else 'open' end as reason
from walk w join capture c on c.url = w.url where c.is_pdf or c.redirect is null or w.hops = 5""",
        "capture",
        more=WALK,
        recursive=True,
    ),
)
def resolve_urls(spark, sf):
    return att.resolve_urls(a.capture(spark, sf))
