"""Package mining: top list, project documents, stars, records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill import schemas
from corpusmill.functions import text as T
from corpusmill.operators.metrics import release_range
from corpusmill.sources.live import fetched


def top_names(listing: DataFrame, limit: int) -> DataFrame:
    """(name, ordinal): the first `limit` rows of the top list that have a project name. listing: TOP_PACKAGES."""
    rows = listing.select(F.posexplode(F.slice("rows", 1, limit)).alias("ordinal", "r"))
    return rows.select(F.col("r.project").alias("name"), "ordinal").where("name IS NOT NULL AND name <> ''")


def crawl(names: DataFrame, fetch, index_url: str, stars_url: str, fetch_stars=None) -> DataFrame:
    """Records of packages. A project that cannot be fetched or read is dropped; stars that cannot are null.
    The URLs are templates with {name} and {repo}."""
    asked = names.withColumn("url", F.replace(F.lit(index_url), F.lit("{name}"), F.col("name")))
    got = fetched(asked, fetch).withColumn("p", F.from_json("body", schemas.PROJECT)).where("p.info IS NOT NULL")
    return with_stars(records(got.select(F.col("name").alias("asked"), "ordinal", "p.*")), fetch_stars or fetch, stars_url)


def records(projects: DataFrame) -> DataFrame:
    """projects: (asked, ordinal, info, releases)."""
    p = projects.withColumn("name", F.coalesce(F.nullif("info.name", F.lit("")), "asked"))
    urls = F.concat(F.coalesce(F.map_values("info.project_urls"), F.array().cast("array<string>")), F.array("info.home_page"))
    out = p.select("name", "ordinal", F.col("info.summary").alias("summary"), F.col("info.version").alias("latest_version"), T.topics("info.classifiers").alias("topics"), T.repository(urls).alias("github_repo"))
    return out.join(release_range(p), "name", "left")


def with_stars(packages: DataFrame, fetch, stars_url: str) -> DataFrame:
    asked = packages.withColumn("url", F.replace(F.lit(stars_url), F.lit("{repo}"), F.coalesce("github_repo", F.lit(""))))
    got = fetched(asked, fetch)
    return got.withColumn("github_stars", F.when(F.col("github_repo").isNotNull(), F.get_json_object("body", "$.stargazers_count").try_cast("bigint"))).drop("url", "body")
