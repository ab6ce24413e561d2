"""Frame names, label paths and display names."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def stem(path) -> Column:
    """Base name without its last extension."""
    return F.regexp_replace(F.element_at(F.split(_c(path), "/"), -1), r"\.[^.]*$", "")


def video_id(name) -> Column:
    """Everything before the last `_f######`; the whole name when there is none."""
    return F.regexp_replace(_c(name), r"_f\d+$", "")


def frame_index(name) -> Column:
    return F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(_c(name), r"_f(\d+)$", 1), F.lit("")),
                                      F.lit("9999999999")).cast("int"), F.lit(0))


def person_field(name, index: int = 1) -> Column:
    """The `index`-th underscore field of a frame name, or `?`."""
    return F.coalesce(F.get(F.split(_c(name), "_"), F.lit(index)), F.lit("?"))


def safe_id(path) -> Column:
    """Relative video path as an id: no extension, runs of other characters become `_`."""
    return F.regexp_replace(F.regexp_replace(_c(path), r"\.[^./]*$", ""), r"[^A-Za-z0-9_.-]+", "_")


def label_path(path) -> Column:
    """Label file of an image: the last `images` folder becomes `labels`, extension `.txt`."""
    swapped = F.regexp_replace(_c(path), r"^(.*/|)images/((?:(?!(?:^|/)images/).)*)$", "$1labels/$2")
    return F.regexp_replace(swapped, r"\.[^./]*$", ".txt")


def flat_name(path) -> Column:
    """Nested relative path as one name joined by `__`."""
    return F.regexp_replace(F.regexp_replace(_c(path), r"\.[^./]*$", ""), "/", "__")


def parse_frame_name(df: DataFrame, name="name", person_index: int = 1) -> DataFrame:
    return df.withColumns({"video_id": video_id(name), "frame_idx": frame_index(name),
                           "person": person_field(name, person_index)})


def image_name_from_url(url) -> Column:
    """Base name of the `d` query value, or else of the path."""
    url = _c(url)
    query = F.try_parse_url(url, F.lit("QUERY"))
    d = F.nullif(F.regexp_extract(F.concat(F.lit("&"), query), r"&d=([^&#]*)", 1), F.lit(""))
    path = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "")
    target = F.coalesce(F.try_url_decode(F.regexp_replace(d, r"\+", " ")), path)
    return F.element_at(F.split(F.regexp_replace(target, r"/+$", ""), "/"), -1)


def display_name(first, last, email, user_id) -> Column:
    """Full name, or the address, or `user<id>`."""
    full = F.trim(F.concat(F.coalesce(_c(first), F.lit("")), F.lit(" "), F.coalesce(_c(last), F.lit(""))))
    return F.coalesce(F.nullif(full, F.lit("")), _c(email),
                      F.concat(F.lit("user"), _c(user_id).cast("string")))
