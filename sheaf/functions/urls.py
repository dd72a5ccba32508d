"""Where a full text can be fetched from, and through which channel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Source classes in fetch order; the first that holds gives the rank. ``{repo}``,
# ``{has_repo}``, ``{host}`` and ``{url}`` stand for what a location has. Append or replace entries to
# change the strategy.
SOURCE_CLASSES = (
    "{repo} = 'arXiv'",
    "{repo} = 'PubMed Central'",
    "{repo} = 'HAL'",
    "{has_repo} and {host} = 'repository'",
    "contains({url}, 'wiley')",
    "true",
)


def rules_for(**names: str) -> tuple[str, ...]:
    """The source classes as SQL predicates over a location's own fields."""
    return tuple(rule.format(**names) for rule in SOURCE_CLASSES)


# Over one location map ``loc``, and over a flat location table with columns repo, host_type, url.
LOCATION_RULES = rules_for(
    repo="loc['repository_normalized']",
    has_repo="map_contains_key(loc, 'repository_normalized')",
    host="loc['host_type']",
    url="loc['url_for_pdf']",
)
FLAT_RULES = rules_for(repo="repo", has_repo="repo is not null", host="host_type", url="url")

# Closed-access URL prefix by publisher.
CLOSED_ACCESS_BASE = {
    "Wiley": "https://onlinelibrary.wiley.com/doi/pdfdirect/",
    "Elsevier": "https://api.elsevier.com/content/article/doi/",
}

# Channels.
ARXIV, WILEY, ELSEVIER, STANDARD = "arxiv", "wiley", "elsevier", "standard"


def rank_sql(rules: Sequence[str]) -> str:
    """Fold an ordered list of SQL predicates into one CASE giving the first match's position."""
    if not rules:
        raise ValueError("at least one ranking rule is needed")
    branches = " ".join(f"when {rule} then {rank}" for rank, rule in enumerate(rules))
    return f"case {branches} end"


def ranked_locations(locations: str, rules: Sequence[str] = LOCATION_RULES) -> Column:
    """Locations with a PDF URL, by rank and then by their place in the record.

    ``locations`` is SQL for an array of location maps. The work stays inside the row: no
    explode, no shuffle. A location no rule matches is left out.
    """
    order = (
        f"array_sort(filter(transform({locations}, (loc, pos) -> "
        f"case when coalesce(loc['url_for_pdf'], '') <> '' "
        f"then named_struct('rank', {rank_sql(rules)}, 'pos', pos) end), "
        "o -> o.rank is not null))"
    )
    return F.expr(f"transform({order}, o -> get({locations}, o.pos))")


def pdf_urls(locations: str) -> Column:
    return F.expr(f"transform({locations}, loc -> loc['url_for_pdf'])")


def closed_access_url(doi: Column, publisher: Column) -> Column:
    """URL at the publisher for closed records; null for publishers without one."""
    url = F.lit(None).cast("string")
    for name, base in CLOSED_ACCESS_BASE.items():
        url = F.when(publisher == name, F.concat(F.lit(base), doi)).otherwise(url)
    return url


def publisher_api_url(doi: Column, client: str, base_url: str) -> Column:
    """Download URL of a publisher client; the Wiley client escapes the slashes of the DOI."""
    if client == WILEY:
        return F.concat(F.lit(base_url), F.replace(doi, F.lit("/"), F.lit("%2F")))
    if client == ELSEVIER:
        return F.concat(F.lit(base_url), doi)
    raise ValueError(f"no publisher client {client!r}")


def channel(url: Column, wiley: bool = True, elsevier: bool = True) -> Column:
    """Harvest channel of a URL; a client that is not available falls to ``standard``."""
    is_arxiv = F.startswith(url, F.lit("http://arxiv.org")) | F.startswith(
        url, F.lit("https://arxiv.org")
    )
    picked = F.when(is_arxiv, ARXIV)
    if wiley:
        picked = picked.when(F.contains(url, F.lit("wiley")), WILEY)
    if elsevier:
        picked = picked.when(F.contains(url, F.lit("elsevier")), ELSEVIER)
    return picked.otherwise(STANDARD)


def user_agent(url: Column, agent: str, host: str = "cairn") -> Column:
    """User-agent header for hosts that ask for one, null elsewhere."""
    return F.when(F.contains(url, F.lit(host)), F.lit(agent))
