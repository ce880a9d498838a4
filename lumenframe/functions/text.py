"""String and number parsing as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(c: str, separators: str = r"[ \t\r\n]") -> Column:
    """Split that drops empty tokens."""
    return F.filter(F.split(F.col(c), separators), lambda x: x != "")


def prefix_number(c: Column, kind: str = "double") -> Column:
    """The number a text starts with, 0 where there is none."""
    pattern = r"^\s*([+-]?\d+)" if kind in ("int", "long") else r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"
    return F.coalesce(F.regexp_extract(c, pattern, 1).try_cast(kind), F.lit(0).cast(kind))


def is_yes(c: str) -> Column:
    # Accepted spellings of true.
    return F.col(c).isin("yes", "Yes", "YES", "true", "True", "TRUE")


def path_parts(c: str) -> dict[str, Column]:
    """File name, stem, folder and category (name of the folder) of a path."""
    p = F.col(c)
    return {
        "file_name": F.regexp_extract(p, r"([^/]*)$", 1),
        "stem": F.regexp_replace(F.regexp_extract(p, r"([^/]*)$", 1), r"\.[^.]*$", ""),
        "folder": F.regexp_extract(p, r"^(.*)/[^/]*$", 1),
        "category": F.regexp_extract(p, r"([^/]*)/[^/]*$", 1),
    }


def id_in_name(c: str) -> Column:
    """Between the last underscore and the last dot."""
    return F.regexp_extract(F.col(c), r"_([^_]*)\.[^.]*$", 1)


def plain(c: str) -> Column:
    return F.regexp_replace(F.col(c), "[^a-zA-Z0-9 .]", "")


def underscored(c: str) -> Column:
    return F.replace(F.col(c), F.lit("/"), F.lit("_"))


def url_of_path(c: str, host: str) -> Column:
    """What follows the first slash, up to the last g, behind a host."""
    return F.concat(F.lit(host), F.regexp_extract(F.col(c), r"^[^/]*/(.*g)", 1))


# JSON and XML


def json_members(c: str) -> Column:
    """Names of the members of an object, in their order."""
    return F.json_object_keys(c)


def json_get(c: str, path: str, kind: str, default) -> Column:
    """The value at a path as a type, or the default where it is missing or of another kind."""
    return F.coalesce(F.try_variant_get(F.try_parse_json(c), path, kind), F.lit(default).cast(kind))


def json_kind(c: str, path: str = "$") -> Column:
    """null, number, string, boolean, array or object; missing gives null."""
    v = F.get_json_object(F.concat(F.lit('{"v":['), F.col(c), F.lit("]}")), "$.v[0]" + path[1:])
    raw = F.schema_of_variant(F.try_variant_get(F.try_parse_json(c), path, "variant"))
    return F.when(v.isNull() & raw.isNull(), None).when(raw.startswith("OBJECT"), "object").when(raw.startswith("ARRAY"), "array").when(raw == "STRING", "string").when(raw == "BOOLEAN", "boolean").when(raw == "VOID", "null").otherwise("number")


def json_compact(*columns: str) -> Column:
    return F.to_json(F.struct(*columns))


def json_styled(*columns: str) -> Column:
    """Members on lines of their own, indented by two."""
    return F.to_json(F.struct(*columns), {"pretty": "true"})


def xml_get(c: str, path: str) -> Column:
    return F.xpath_string(F.col(c), F.lit(path))


def xml_set(c: str, tag: str, value: Column) -> Column:
    """The text of every element of that name replaced."""
    escaped = F.replace(F.replace(value, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    quoted = F.replace(F.replace(escaped, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
    return F.regexp_replace(F.col(c), F.lit(f"(<{tag}>)[^<]*(</{tag}>)"), F.concat(F.lit("$1"), quoted, F.lit("$2")))


def cut_at(c: str, mark: str) -> dict[str, Column]:
    """What stands before the first mark, without its last character, and what stands after it."""
    at = F.instr(F.col(c), mark)
    return {"head": F.when(at > 1, F.substring(F.col(c), F.lit(1), at - 2)).otherwise(F.lit("")), "tail": F.when(at > 0, F.substring(F.col(c), at + 1, F.length(c))).otherwise(F.col(c))}
