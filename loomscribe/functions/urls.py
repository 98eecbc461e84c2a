"""Hosts, sites and company names as join keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Legal forms that may end a company name.
LEGAL_FORMS = (
    "inc incorporated corp corporation co company ltd limited llc llp lp plc gmbh mbh ag kg ug se sa sas sarl "
    "sl slu srl spa bv nv oy oyj ab as aps pty pte kk"
).split()


def host_of(c: Column | str) -> Column:
    """Host of a domain or URL: scheme, user, path, port and trailing dots removed, lower case; blank gives null."""
    c = F.col(c) if isinstance(c, str) else c
    s = F.lower(F.regexp_replace(c, r"(?U)\s+", ""))
    s = F.regexp_replace(s, r"^[a-z][a-z0-9+.\-]*://", "")
    s = F.regexp_replace(F.regexp_replace(s, r"[/?#].*$", ""), r"^.*@", "")
    s = F.regexp_replace(F.regexp_replace(s, r":\d*$", ""), r"^\.+|\.+$", "")
    return F.when(s != "", s)


def site_of(c: Column | str) -> Column:
    """The last two labels of the host name."""
    return F.substring_index(host_of(c), ".", -2)


def company_key(c: Column | str) -> Column:
    """Company name without case, punctuation, blanks and legal form; blank gives null.

    A name that consists of a legal form alone keeps it.
    """
    c = F.col(c) if isinstance(c, str) else c
    s = F.lower(F.regexp_replace(c, r"[.'’]", ""))
    s = F.trim(F.regexp_replace(s, r"(?U)[^\p{L}\p{N}]+", " "))
    s = F.regexp_replace(s, rf"(?: (?:{'|'.join(LEGAL_FORMS)}))+$", "")
    s = F.replace(s, F.lit(" "), F.lit(""))
    return F.when(s != "", s)
