"""The same inputs in flat SQL. Written apart from the Spark forms: locations, observations and
attempts are rows here and nested values there."""

from __future__ import annotations

UUID = "concat(substr({m},1,8),'-',substr({m},9,4),'-',substr({m},13,4),'-',substr({m},17,4),'-',substr({m},21,12))"


def uuid_of(doi: str) -> str:
    return UUID.format(m=f"md5({doi})")


def path_of(uuid: str, prefix: str = "publication", ext: str = ".pdf.gz") -> str:
    return (
        f"concat_ws('/','{prefix}',substr({uuid},1,2),substr({uuid},3,2),substr({uuid},5,2),"
        f"substr({uuid},7,2),{uuid},concat({uuid},'{ext}'))"
    )


def channel_of(url: str) -> str:
    return (
        f"case when starts_with({url},'http://arxiv.org') or starts_with({url},'https://arxiv.org') then 'arxiv' "
        f"when contains({url},'wiley') then 'wiley' when contains({url},'elsevier') then 'elsevier' else 'standard' end"
    )


CLOSED_URL = (
    "case publisher_normalized when 'Wiley' then concat('https://onlinelibrary.wiley.com/doi/pdfdirect/', doi) "
    "when 'Elsevier' then concat('https://api.elsevier.com/content/article/doi/', doi) end"
)

# name -> (names it reads, statement)
CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "pubs": (
        (),
        """select o_orderkey as line_no,
  case when o_orderkey % 97 = 13 then null
       else concat('10.1000/o', cast(o_orderkey - case when o_orderkey % 50 = 1 then 1 else 0 end as varchar)) end as doi,
  case when c_nationkey % 5 = 0 then 'fr' when c_nationkey % 5 = 1 then 'cn' else 'de' end as country,
  case o_orderpriority when '1-URGENT' then 'Wiley' when '2-HIGH' then 'Elsevier'
                       when '3-MEDIUM' then 'Springer' else 'N/A' end as publisher_normalized,
  c_mktsegment as domain, o_orderdate as order_date
from orders join customer on o_custkey = c_custkey""",
    ),
    "locs": (
        (),
        """select l_orderkey as line_no,
  row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey,
                     l_shipdate, l_quantity, l_extendedprice) as pos,
  case when l_linenumber % 3 = 0 then concat(cast(year(l_shipdate) as varchar), 'Q', cast(quarter(l_shipdate) as varchar))
       else cast(year(l_shipdate) as varchar) end as obs_key,
  case l_suppkey % 6 when 0 then 'arXiv' when 1 then 'PubMed Central' when 2 then 'HAL' when 3 then 'univoak.eu' end as repo,
  case when l_suppkey % 6 <= 3 then 'repository' else 'publisher' end as host_type,
  case when l_partkey % 11 = 0 then null when l_partkey % 11 = 1 then ''
       when l_suppkey % 6 = 0 then concat('https://arxiv.org/pdf/1501.', cast(l_partkey as varchar))
       when l_partkey % 5 = 0 then concat('https://onlinelibrary.wiley.com/doi/pdfdirect/p', cast(l_partkey as varchar))
       else concat('https://host', cast(l_suppkey as varchar), '.example.org/p', cast(l_partkey as varchar), '.pdf') end as url,
  l_returnflag <> 'A' as loc_oa
from lineitem""",
    ),
    "rec": (
        ("pubs",),
        """select line_no, doi, publisher_normalized, domain,
  line_no % 10 <> 3 and (country = 'fr' or line_no % 6 = 0) as is_fr
from pubs""",
    ),
    "rlocs": (
        ("pubs",),
        """select line_no, i as pos,
  concat(cast(2018 + h % 4 as varchar), case when h % 3 = 0 then concat('Q', cast(1 + h % 4 as varchar)) else '' end) as obs_key,
  case h % 7 when 0 then 'arXiv' when 1 then 'PubMed Central' when 2 then 'HAL' when 3 then 'univoak.eu' end as repo,
  h % 7 <= 4 as has_repo,
  case when h % 7 <= 5 then 'repository' else 'publisher' end as host_type,
  case when h % 11 = 0 then null when h % 11 = 1 then ''
       when h % 7 = 0 then concat('https://arxiv.org/pdf/1501.', cast(h as varchar))
       when h % 5 = 0 then concat('https://onlinelibrary.wiley.com/doi/pdfdirect/p', cast(h as varchar))
       when h % 13 = 0 then concat('https://www.cairn.info/p', cast(h as varchar))
       else concat('https://host', cast(h % 50 as varchar), '.example.org/p', cast(h as varchar), '.pdf') end as url,
  h % 4 <> 1 as loc_oa
from (select line_no, i, line_no * 31 + i * 17 as h
      from pubs, unnest(range((line_no + line_no // 7) % 7)) as t(i)) x""",
    ),
    "robs": (
        ("pubs", "rlocs"),
        """select line_no, obs_key, bool_or(loc_oa) as is_oa, min(pos) as first_pos,
  coalesce(bool_or(contains(url, 'wiley')), false) as wiley_pdf, coalesce(bool_or(repo = 'HAL'), false) as hal_loc
from rlocs group by line_no, obs_key
union all
select line_no, '2019', false, 0, false, false from pubs
where (line_no + line_no // 7) % 7 = 0 and line_no % 2 = 0""",
    ),
    # Last observation in document order: the one met first latest.
    "rlast": (
        ("robs",),
        """select * from (select *, row_number() over (partition by line_no order by first_pos desc) as rn from robs) x
where rn = 1""",
    ),
    "rlatest": (
        ("robs",),
        """select * from (select *, row_number() over (partition by line_no order by obs_key desc) as rn from robs) x
where rn = 1""",
    ),
    "cand": (
        ("rlocs", "rlatest"),
        """select l.line_no, url, pos, row_number() over (partition by l.line_no order by
    case when repo = 'arXiv' then 0 when repo = 'PubMed Central' then 1 when repo = 'HAL' then 2
         when has_repo and host_type = 'repository' then 3 when contains(url, 'wiley') then 4 else 5 end, pos) as k
from rlocs l join rlatest o on l.line_no = o.line_no and l.obs_key = o.obs_key
where o.is_oa and coalesce(url, '') <> ''""",
    ),
    "kept": (
        ("rec",),
        f"""select *, {uuid_of("doi")} as id from
  (select *, row_number() over (partition by doi order by line_no) as rn from rec where doi is not null and is_fr) x
where rn = 1""",
    ),
    "manifest": (
        ("kept", "cand", "rlatest"),
        f"""select id, doi, domain, k as url_rank, url from kept join cand using (line_no)
union all
select id, doi, domain, 1, {CLOSED_URL} from kept join rlatest using (line_no)
where not is_oa and publisher_normalized in ('Wiley', 'Elsevier')""",
    ),
    "status": (
        ("pubs",),
        f"""select doi, {UUID.format(m='m')} as uuid, '1' as is_harvested,
 case line_no % 5 when 0 then '0' when 1 then '0.7.2' when 2 then '0.7.3' when 3 then '0.7.10' end as softcite_version,
 case line_no % 4 when 0 then '0' when 1 then '0.7.2' when 2 then '0.7.3' else '0.7.10' end as grobid_version,
 case line_no % 4 when 0 then 'arxiv' when 1 then 'wiley' when 2 then 'elsevier' else 'standard' end as harvester_used,
 domain, concat('https://doi.org/', doi) as url_used, order_date as harvesting_date,
 case line_no % 7 when 0 then '0' when 1 then '0.7.2' when 2 then '0.7.3' end as datastet_version, line_no
from (select *, md5(doi) as m, row_number() over (partition by doi order by line_no) as rn
      from pubs where doi is not null and line_no % 3 = 0) t where rn = 1""",
    ),
    "objects": (("status",), f"select {path_of('uuid')} as path from status where line_no % 7 <> 0"),
    "events_v": (
        ("status",),
        """select line_no * 10 + k as seq,
  case when line_no % 11 = 0 then concat('unknown-', cast(line_no as varchar)) else uuid end as uuid,
  service, concat('0.8.', cast(k as varchar)) as version
from status cross join (select 1 as k, 'grobid' as service union all select 2, 'softcite'
                        union all select 3, 'datastet' union all select 4, 'grobid') s
where line_no % 2 = 0""",
    ),
    "newest": (
        ("events_v",),
        """select uuid, max(version) filter (rn = 1 and service = 'grobid') as new_grobid,
  max(version) filter (rn = 1 and service = 'softcite') as new_softcite,
  max(version) filter (rn = 1 and service = 'datastet') as new_datastet
from (select *, row_number() over (partition by uuid, service order by seq desc) as rn from events_v) x group by uuid""",
    ),
    "outputs": (
        ("status",),
        """select concat(service, '/', uuid, suffix) as path, uuid, service,
  case service when 'grobid' then '0.8.9' else concat('0.8.', cast(line_no % 4 as varchar)) end as version
from status cross join (select 'grobid' as service, '.tei.xml' as suffix union all select 'softcite', '.software.json'
                        union all select 'datastet', '.dataset.json') s
where line_no % 2 = 0""",
    ),
    "capture": (
        (),
        """select page_id, url, page_id % 3 = 0 as is_pdf,
  case when page_id % 3 <> 0 and page_id % 5 <> 0 then lead(url) over (order by page_id) end as redirect
from pages""",
    ),
    "attempts": (
        (),
        """select user_id as key, ts, event_id, event_type as channel, event_type <> 'error' as ok,
  concat('https://example.org/e/', cast(event_id as varchar)) as url from events""",
    ),
    "captured": (
        ("u",),
        f"""select url, channel, outcome, substr(d, 3, 1) <> '0' as valid_file from (
  select url, d, 'standard' as channel, case when substr(d,1,1) < '6' then 'success' else 'fail' end as outcome
  from u where substr(d,1,1) <> 'f'
  union all
  select url, d, {channel_of('url')},
    case when substr(d,2,1) < '5' then 'success' when substr(d,2,1) < 'a' then 'fail' else 'error' end
  from u where {channel_of('url')} <> 'standard') x""",
    ),
    "u": (
        ("rlocs", "pubs"),
        f"""select url, md5(url) as d from (select url from rlocs where coalesce(url, '') <> ''
  union select {CLOSED_URL} from pubs where doi is not null and publisher_normalized in ('Wiley', 'Elsevier')) x""",
    ),
    "classed": (
        ("rec", "rlast"),
        """select line_no, doi, not is_oa as ca, is_oa as oa, not is_oa and publisher_normalized = 'Wiley' as wiley_ca,
  is_oa and wiley_pdf as wiley_oa, not is_oa and publisher_normalized = 'Elsevier' as elsevier_ca,
  line_no % 9 = 0 as hal_obs, hal_loc
from rec join rlast using (line_no)""",
    ),
    "universe": (
        ("classed", "status"),
        """select doi, is_oa, doi in (select doi from status) as is_harvested,
  case when doi in (select doi from classed where doi is not null and (wiley_ca or wiley_oa)) then 'Wiley'
       when doi in (select doi from classed where doi is not null and hal_loc) then 'HAL' else 'NC' end as repo
from (select distinct doi, true as is_oa from classed where oa and doi is not null
      union all select distinct doi, false from classed where ca and doi is not null) x""",
    ),
}


def statement(body: str, *names: str, more: str = "", recursive: bool = False) -> str:
    """``body`` after the inputs it names and those they read; ``more`` adds WITH items."""
    order: list[str] = []

    def visit(name: str) -> None:
        for needed in CTES[name][0]:
            visit(needed)
        if name not in order:
            order.append(name)

    for name in names:
        visit(name)
    if not order:
        return body
    items = ",\n".join(f"{name} as ({CTES[name][1]})" for name in order)
    return f"with {'recursive ' if recursive else ''}{items}{more}\n{body}"
