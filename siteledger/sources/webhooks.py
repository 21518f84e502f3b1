"""Push deliveries: payload projection and changed files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The payload keys that are kept.
KEPT_KEYS = ("ref", "before", "after", "compare")

_FILES = "added:array<string>,modified:array<string>,removed:array<string>"
PAYLOAD = (
    "ref string, before string, after string, compare string, deleted boolean, repository struct<full_name:string>, pusher struct<name:string>, "
    f"sender struct<login:string>, commits array<struct<message:string,{_FILES}>>, head_commit struct<{_FILES}>"
)


def parse(events: DataFrame, payload: str = "payload") -> DataFrame:
    return events.withColumn("p", F.from_json(payload, PAYLOAD))


def changed_files(p: Column | str = "p") -> Column:
    """Distinct added, modified and removed paths of all commits and the head commit, in order."""
    c = F.col(p) if isinstance(p, str) else p
    none = F.array().cast("array<string>")
    lists = lambda x: F.flatten(F.array(*[F.coalesce(x[k], none) for k in ("added", "modified", "removed")]))
    commits = F.flatten(F.transform(F.coalesce(c["commits"], F.array()), lists))
    return F.array_distinct(F.concat(commits, F.coalesce(lists(c["head_commit"]), none)))


def branch_of(ref: Column) -> Column:
    return F.when(ref.startswith("refs/heads/"), F.substring(ref, 12, 1000))


def delivery_log(events: DataFrame) -> DataFrame:
    """One stored row per delivery: branch, commit count, first lines of all messages, all files and the kept payload keys."""
    p = F.col("p")
    messages = F.transform(
        F.coalesce(p["commits"], F.array()),
        lambda c: F.split(F.coalesce(c["message"], F.lit("")), "\r\n|\n|\r")[0],
    )
    kept = F.map_filter(F.create_map(*[x for k in KEPT_KEYS for x in (F.lit(k), p[k])]), lambda k, v: v.isNotNull())
    parsed = parse(events).withColumn("files", changed_files())
    return parsed.select(
        *[c for c in events.columns if c != "payload"],
        p["repository"]["full_name"].alias("repository"),
        branch_of(p["ref"]).alias("branch"),
        F.coalesce(p["deleted"], F.lit(False)).alias("deleted"),
        F.coalesce(p["pusher"]["name"], p["sender"]["login"]).alias("pusher"),
        F.size(F.coalesce(p["commits"], F.array())).alias("commit_count"),
        messages.alias("commit_messages"),
        "files",
        F.col("files").alias("changed_files"),
        F.size("files").alias("changed_file_count"),
        kept.alias("raw_payload"),
    )
