"""String functions of the graph output, as column expressions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartolith import model


def split_literal(s: Column, mark: str) -> Column:
    """Splits at a literal mark and keeps empty parts."""
    quoted = "".join("\\" + c if not c.isalnum() else c for c in mark)
    return F.split(s, quoted, -1)


def replace_all(s: Column, old: str, new: str) -> Column:
    return F.replace(s, F.lit(old), F.lit(new))


def encode_literal(s: Column) -> Column:
    r"""Escapes backslash, tab, quote, line feed and carriage return for a quoted literal."""
    out = s
    for char, name in (("\\", "\\"), ("\t", "t"), ('"', '"'), ("\n", "n"), ("\r", "r")):
        out = replace_all(out, char, "\\" + name)
    return out


def url_encode(s: Column) -> Column:
    """Percent-encodes every UTF-8 byte but letters, digits, ``_`` and ``-``."""
    out = F.url_encode(s)
    for old, new in (("+", "%20"), ("*", "%2A"), (".", "%2E")):
        out = replace_all(out, old, new)
    return out


@F.arrow_udf(T.StringType())
def fixed6(x: pa.Array) -> pa.Array:
    """Six decimals with exact-binary rounding, as C's ``%f`` (Java rounds the shortest decimal)."""
    return pa.array([None if v is None or v != v else "%f" % v for v in x.to_pylist()], pa.string())


@F.arrow_udf(T.ArrayType(T.StringType()))
def fixed6_pairs(points: pa.Array) -> pa.Array:
    """``lon lat`` of each point of an array, six decimals each; a batch's points are formatted as one column."""
    flat = points.flatten()
    lon, lat = (pc.struct_field(flat, i).to_pylist() for i in (0, 1))
    told = pa.array(["%f %f" % p for p in zip(lon, lat)], pa.string())
    ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(points), 0).to_numpy(zero_copy_only=False))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), told, mask=points.is_null())


def tag_objects(key: Column, value: Column) -> Column:
    """The objects of a tag's triples; an empty array where the tag has none.

    The rules in order: Wikidata ids (each of a list), Wikipedia links and titles, other wiki keys
    (none), ``is_in`` lists, links, literals. ``key`` is already encoded. A Wikidata key with an
    empty value gives none.
    """
    underscored = replace_all(value, " ", "_")
    parts = split_literal(replace_all(value, " ", ""), ";")
    wiki, noted = key.contains("wiki"), key.contains("note")
    size = F.octet_length(value)
    data = wiki & key.contains("wikidata") & value.startswith("Q") & ~noted
    pedia = wiki & key.contains("wikipedia") & ~noted
    link = (size > 3) & (value.startswith("http") | value.startswith("www.")) & ~noted
    bracketed = lambda x: F.array(F.concat(F.lit("<"), x, F.lit(">")))
    quoted = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    return (
        F.when(data, F.transform(parts, lambda p: F.concat(F.lit("wd:"), p)))
        .when(pedia & (size > 4) & value.startswith("http"), bracketed(underscored))
        .when(pedia, F.array(F.concat(F.lit("wpd:"), url_encode(underscored))))
        .when(wiki, F.array().cast("array<string>"))
        .when(key == "is_in", F.transform(parts, quoted))
        .when(link, bracketed(url_encode(underscored)))
        .otherwise(F.array(quoted(encode_literal(value))))
    )


def triple_line(s: Column, p: Column, o: Column) -> Column:
    return F.concat_ws(" ", s, p, o, F.lit("."))


def prefix_lines() -> list[str]:
    return [f"@prefix {name} <{iri}> ." for name, iri in model.PREFIXES]
