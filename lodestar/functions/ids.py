"""Identity: length-framed hashes, so that tuples of parts cannot collide; null parts are framed as absent, not as empty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def frame(c: Column | str) -> Column:
    """Eight bytes of big-endian byte length, then the bytes; null frames as the length of all ones."""
    b = col(c).cast("string").cast("binary")
    return F.coalesce(F.concat(F.unhex(F.lpad(F.hex(F.octet_length(b)), 16, "0")), b), F.unhex(F.lit("F" * 16)))


def derived_id(namespace: str, *parts: Column | str) -> Column:
    """Hash of the framed scheme name, namespace and parts."""
    return F.sha2(F.concat(*[frame(F.lit(p)) for p in ("id-v1", namespace)], *[frame(p) for p in parts]), 256)


def content_hash(c: Column | str) -> Column:
    return F.sha2(col(c).cast("binary"), 256)


def list_hash(c: Column | str) -> Column:
    """Hash over an array's elements in their order: every element framed, a 0xFF byte at the end."""
    framed = F.transform(col(c), frame)
    return F.sha2(F.concat(F.unhex(F.concat_ws("", F.transform(framed, F.hex))), F.unhex(F.lit("FF"))), 256)


def plain_hash(*parts: Column | str) -> Column:
    """Hash of the parts' bytes in their order, no frames; the parts hold their own marks. Null parts add nothing."""
    return F.sha2(F.concat(*[F.coalesce(col(p).cast("binary"), F.unhex(F.lit(""))) for p in parts]), 256)


def each(items: Column | str, before: str = "", after: str = "\x00") -> Column:
    """The elements of a list in their order, each between the two marks; empty if it is null."""
    return F.coalesce(F.array_join(F.transform(col(items), lambda x: F.concat(F.lit(before), x, F.lit(after))), ""), F.lit(""))


def set_hash(item: Column | str) -> Column:
    """Aggregate: one hash of a group's items whatever their order, as sums of the items' hashes, word by word; no list is gathered.

    Repeats count. It tells sets apart that differ by chance or change; it is no defence against items made to collide.
    """
    h = F.sha2(col(item).cast("binary"), 256)
    words = [F.sum(F.conv(F.substring(h, 8 * k + 1, 8), 16, 10).cast("decimal(38,0)")).cast("string") for k in range(8)]
    return F.sha2(F.concat_ws(",", F.count(F.lit(1)).cast("string"), *words), 256)


SEVERITIES = ("note", "low", "medium", "high", "critical")


def severity_rank(c: Column | str) -> Column:
    """Severities have no order of their own: rank 0 to 4, null for anything else."""
    out = F.lit(None).cast("int")
    for k, s in enumerate(SEVERITIES):
        out = F.when(col(c) == s, k).otherwise(out)
    return out


def basis_points(n: Column | str, d: Column | str) -> Column:
    """floor(n * 10000 / d) in whole numbers; null if d is 0."""
    top = col(n).cast("long") * 10000
    return F.when(col(d) != 0, ((top - F.pmod(top, col(d))) / col(d)).cast("long"))
