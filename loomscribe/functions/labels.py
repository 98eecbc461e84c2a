"""Canonical forms of labels that are written in several ways."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The verticals, strata and splits of the data, and the short forms of verticals.
VERTICALS = (
    "software_saas",
    "ecommerce_retail",
    "fintech_insurance",
    "healthcare_life",
    "industrial_logistics",
    "media_education",
    "services_other",
)
STRATA = ("funded_directory", "growth_list", "listed_large", "review_site")
SPLITS = ("train", "val", "test")
SHORT_VERTICALS = {
    "saas": "software_saas",
    "ecommerce": "ecommerce_retail",
    "fintech": "fintech_insurance",
    "other": "services_other",
}


def canon_label(c: Column | str) -> Column:
    """Lower case, outer blanks removed, runs of blanks and hyphens as one underscore; blank gives null."""
    c = F.col(c) if isinstance(c, str) else c
    s = F.regexp_replace(F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")), r"(?U)[\s\-]+", "_")
    return F.when(s != "", s)


def canon_vertical(c: Column | str) -> Column:
    s = canon_label(c)
    pairs = [F.lit(x) for kv in SHORT_VERTICALS.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), s), s)


def known(c: Column, values) -> Column:
    """The label if it is one of the given values, else null."""
    return F.when(c.isin(*values), c)


def not_blank(c: Column | str) -> Column:
    """True where the text holds anything but white space (no-break and zero-width blanks count as white space)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.rlike(r"(?U)[^\s​‌‍⁠﻿]"), F.lit(False))
