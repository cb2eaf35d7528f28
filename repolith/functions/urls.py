"""Repository URLs, ids and cache keys as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SHAPE = r"^(?:(https?)://)?(?:www\.)?github\.com/([^/\s?#]+)/([^/\s?#]+)"


def sanitized(url: Column) -> Column:
    """Owner and repository on the host, http kept as http; ``owner/name`` gets the host; anything else stays as it is."""
    u = F.trim(url)
    name = lambda n: F.regexp_replace(n, r"\.git$", "")
    full = F.concat(F.when(F.regexp_extract(u, _SHAPE, 1) == "http", "http").otherwise("https"), F.lit("://github.com/"), F.regexp_extract(u, _SHAPE, 2), F.lit("/"), name(F.regexp_extract(u, _SHAPE, 3)))
    short = F.concat(F.lit("https://github.com/"), name(u))
    return F.when(u.rlike(_SHAPE), full).when(u.rlike(r"^[\w.-]+/[\w.-]+$"), short).otherwise(url)


def owner_and_name(url: Column) -> Column:
    """struct<owner, name, full_name> of the last two segments; ``.git`` goes wherever it stands in the name."""
    parts = F.split(F.rtrim(url, F.lit("/")), "/")
    owner, name = F.try_element_at(parts, F.lit(-2)), F.replace(F.try_element_at(parts, F.lit(-1)), F.lit(".git"), F.lit(""))
    return F.struct(owner.alias("owner"), name.alias("name"), F.concat(owner, F.lit("/"), name).alias("full_name"))


def repo_info(url: Column) -> Column:
    """struct<owner, repo, full_name, clone_url> of the path's first two segments; ``.git`` goes as a suffix only."""
    parts = F.filter(F.split(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "/"), lambda x: x != "")
    owner, repo = F.get(parts, F.lit(0)), F.regexp_replace(F.get(parts, F.lit(1)), r"\.git$", "")
    full = F.concat(owner, F.lit("/"), repo)
    return F.struct(owner.alias("owner"), repo.alias("repo"), full.alias("full_name"), F.concat(F.lit("https://github.com/"), full, F.lit(".git")).alias("clone_url"))


def normalized(url: Column) -> Column:
    full = repo_info(url)["full_name"]
    return F.coalesce(F.concat(F.lit("https://github.com/"), full), F.lower(F.rtrim(url, F.lit("/"))))


def job_id(full_name: Column) -> Column:
    return F.replace(full_name, F.lit("/"), F.lit("--"))


def full_name(job: Column) -> Column:
    return F.replace(job, F.lit("--"), F.lit("/"))


def cache_key(url: Column) -> Column:
    return F.substring(F.sha2(url, 256), 1, 16)


def pages_url(url: Column) -> Column:
    info = repo_info(url)
    return F.concat(F.lit("https://"), info["owner"], F.lit(".github.io/"), info["repo"], F.lit("/"))


def compare_url(url: Column, branch: Column) -> Column:
    return F.concat(F.lit("https://github.com/"), repo_info(url)["full_name"], F.lit("/compare/"), branch, F.lit("?expand=1"))
