"""Identities of objects, across prefixes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def object_uuid(prefix: str, oid: Column) -> Column:
    """An object's id as text: stable over states and sessions, and different between prefixes."""
    return F.concat(F.substring(F.sha2(F.lit(prefix), 256), 1, 16), F.lit("-"), F.lpad(F.lower(F.hex(oid)), 16, "0"))


def oid_of(uuid: Column) -> Column:
    """The id that ``object_uuid`` was made from."""
    return F.conv(F.substring_index(uuid, "-", -1), 16, -10).cast("long")
