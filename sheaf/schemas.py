"""Explicit schemas: nothing in this package infers one."""

from pyspark.sql import types as T

_S, _B = T.StringType(), T.BooleanType()

# Field names of the dumps and of the status table.

# A location stays a map, so that an absent key and a key holding null remain different.
LOCATION = T.MapType(_S, _S)
OBSERVATION = (
    T.StructType()
    .add("is_oa", _B)
    .add("repository_normalized", _S)
    .add("oa_locations", T.ArrayType(LOCATION))
)

PUBLICATION = (
    T.StructType()
    .add("doi", _S)
    .add("publisher_normalized", _S)
    .add("bso_classification", _S)
    .add("bso_country_corrected", T.ArrayType(_S))
    .add("oa_details", T.MapType(_S, OBSERVATION))
)

STATUS = (
    T.StructType()
    .add("doi", _S)
    .add("uuid", _S)
    .add("is_harvested", _S)
    .add("softcite_version", _S)
    .add("grobid_version", _S)
    .add("harvester_used", _S)
    .add("domain", _S)
    .add("url_used", _S)
    .add("harvesting_date", T.TimestampType())
    .add("datastet_version", _S)
)
# The table as it was before the two later columns were added.
STATUS_BASE = T.StructType([f for f in STATUS if f.name not in ("harvesting_date", "datastet_version")])

VERSION_EVENT = (
    T.StructType().add("seq", T.LongType()).add("uuid", _S).add("service", _S).add("version", _S)
)
SERVICE_VERSION = T.StructType().add("uuid", _S).add("service", _S).add("version", _S)
