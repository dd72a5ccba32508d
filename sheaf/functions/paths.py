"""Object-store paths and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Object-store prefixes and file suffixes.
PUBLICATION_PREFIX = "publication"
METADATA_PREFIX = "metadata"
PUBLICATION_EXT = ".pdf"
METADATA_EXT = ".json"
COMPRESSION_EXT = ".gz"
# Suffix of the files each enrichment service writes.
SERVICE_SUFFIX = {
    "grobid": ".tei.xml",
    "softcite": ".software.json",
    "datastet": ".dataset.json",
}
SERVICES = list(SERVICE_SUFFIX)

PAYLOAD_EXT = PUBLICATION_EXT + COMPRESSION_EXT


def strip_slashes(part: Column) -> Column:
    """Drop slashes, backslashes, slashes, backslashes, in that order, from both ends."""
    for char in ("/", "\\", "/", "\\"):
        part = F.btrim(part, F.lit(char))
    return part


def join_path(*parts: Column) -> Column:
    """Join components with ``/``; empty components are kept, a null one gives null."""
    joined = F.concat_ws("/", *[strip_slashes(p) for p in parts])
    known = F.lit(True)
    for part in parts:
        known = known & part.isNotNull()
    return F.when(known, joined)


def shard_path(identifier: Column) -> Column:
    """Four folders named by the first four pairs of characters, then the identifier itself."""
    pairs = [F.substring(identifier, start, 2) for start in (1, 3, 5, 7)]
    return join_path(*pairs, identifier)


def storage_path(
    identifier: Column, prefix: str = PUBLICATION_PREFIX, ext: str = PAYLOAD_EXT
) -> Column:
    """Full object path of one file of a publication."""
    name = F.concat(identifier, F.lit(ext))
    exact = join_path(F.lit(prefix), shard_path(identifier), name)
    if ext[-1:] in ("/", "\\"):
        return exact
    # Without slashes in the identifier there is nothing to strip, and one concatenation is enough.
    slashes = F.contains(identifier, F.lit("/")) | F.contains(identifier, F.lit("\\"))
    pairs = [F.substring(identifier, start, 2) for start in (1, 3, 5, 7)]
    joined = F.concat_ws("/", strip_slashes(F.lit(prefix)), *pairs, identifier, name)
    return F.when((identifier != "") & ~slashes, joined).otherwise(exact)


def shard(identifier: Column, digits: int = 2) -> Column:
    """Partition value: the first ``digits`` characters of the identifier, 256 folders for 2.

    Take as many as give folders of some hundred megabytes.
    """
    return F.substring(identifier, 1, digits)


def uuid_from_path(path: Column) -> Column:
    """File name up to its first dot."""
    return F.substring_index(F.substring_index(path, "/", -1), ".", 1)


def uuid_from_doi(doi: Column) -> Column:
    """The same DOI gives the same id in every run and every retried task."""
    return F.regexp_replace(
        F.md5(doi), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"
    )


def service_of_path(path: Column) -> Column:
    """Service that wrote an output file, by suffix; null for any other file."""
    found = F.lit(None).cast("string")
    for service, suffix in SERVICE_SUFFIX.items():
        found = F.when(F.endswith(path, F.lit(suffix)), F.lit(service)).otherwise(found)
    return found


def arxiv_mirror_path(url: Column, ext: str = PAYLOAD_EXT) -> Column:
    """arXiv PDF URL -> path in the mirror container; null when the URL has another form."""
    ident = F.regexp_extract(url, r"arxiv\.org/pdf/(.*)$", 1)
    name = F.substring_index(url, "/", -1)
    prefix = F.when(ident.rlike("^[0-9]"), F.lit("arxiv")).otherwise(
        F.substring_index(ident, "/", 1)
    )
    path = F.concat_ws("/", prefix, F.substring(name, 1, 4), name, F.concat(name, F.lit(ext)))
    return F.when(ident != "", path)
