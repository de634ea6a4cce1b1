"""URI parts and resolution of relative references, as column expressions and, for trees, on strings."""

from __future__ import annotations

from urllib.parse import urljoin, urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

_URI = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def _part(s: Column, n: int) -> Column:
    return F.regexp_extract(s, _URI, n)


def protocol(s: Column) -> Column:
    return _part(s, 1)


def authority(s: Column) -> Column:
    return _part(s, 2)


def host(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(_part(s, 2), r"^[^@]*@", ""), r":[0-9]*$", "")


def user_info(s: Column) -> Column:
    return F.regexp_extract(_part(s, 2), r"^([^@]*)@", 1)


def port(s: Column) -> Column:
    return F.regexp_extract(_part(s, 2), r":([0-9]+)$", 1)


def path(s: Column) -> Column:
    return _part(s, 3)


def query(s: Column) -> Column:
    return _part(s, 4)


def fragment(s: Column) -> Column:
    return _part(s, 5)


def parts(s: Column) -> Column:
    return F.struct(protocol(s).alias("protocol"), host(s).alias("host"), port(s).alias("port"), path(s).alias("path"), query(s).alias("query"), fragment(s).alias("fragment"))


def expand(ref: Column, base: Column) -> Column:
    """A reference resolved against a base: absolute ones stay, others take the base's scheme, host and folder."""
    root = F.concat(protocol(base), F.lit("://"), authority(base))
    folder = F.regexp_replace(path(base), r"[^/]*$", "")
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    joined = F.concat(root, folder, ref)
    joined = F.regexp_replace(joined, r"/\./", "/")
    for _ in range(3):  # up to three folders up, by one pass each
        joined = F.regexp_replace(joined, r"(?<![:/])/(?!\.\./)[^/?#]+/\.\./", "/")
    whole = F.regexp_replace(base, r"#.*$", "")
    return (
        F.when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), ref)
        .when(ref == "", whole)
        .when(ref.startswith("#"), F.concat(whole, ref))
        .when(ref.startswith("//"), F.concat(protocol(base), F.lit(":"), ref))
        .when(ref.startswith("/"), F.concat(root, ref))
        .when(ref.startswith("?"), F.concat(root, path(base), ref))
        .otherwise(joined)
    )


def expand_uri(ref: str, base: str) -> str | None:
    """The same on strings; None for what is no URI."""
    try:
        return urljoin(base, ref)
    except ValueError:
        return None


def mk_abs_uri(ref: str, base: str) -> str:
    return expand_uri(ref, base) or ref


def uri_parts(s: str) -> dict[str, str]:
    u = urlsplit(s)
    return {"protocol": u.scheme, "host": u.hostname or "", "port": str(u.port or ""), "path": u.path, "query": u.query, "fragment": u.fragment}


# the parts by their longer names

get_scheme_from_uri, get_reg_name_from_uri, get_port_from_uri, get_user_info_from_uri = protocol, host, port, user_info
get_path_from_uri, get_query_from_uri, get_fragment_from_uri = path, query, fragment
