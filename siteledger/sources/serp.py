"""Search result payloads and competitor gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import rnd
from ..operators.ranking import top_per_key

PAYLOAD = (
    "organic_results array<struct<position:int,link:string,title:string,snippet:string>>, "
    "related_questions array<struct<question:string,snippet:string>>, related_searches array<struct<query:string>>"
)


def parse(raw: DataFrame, payload: str = "payload") -> DataFrame:
    keep = [c for c in raw.columns if c != payload]
    return raw.select(*keep, F.from_json(payload, PAYLOAD).alias("p"))


def organic_results(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """Results with a link; a missing position is the row's place among them."""
    keep = [c for c in raw.columns if c != payload]
    linked = F.filter("p.organic_results", lambda r: F.coalesce(r["link"], F.lit("")) != "")
    rows = parse(raw, payload).select(*keep, F.posexplode(linked).alias("i", "r"))
    position = F.when(F.coalesce("r.position", F.lit(0)) != 0, F.col("r.position")).otherwise(F.col("i") + 1)
    return rows.select(*keep, position.alias("position"), F.col("r.link").alias("url"), "r.title", "r.snippet")


def questions(raw: DataFrame, payload: str = "payload") -> DataFrame:
    keep = [c for c in raw.columns if c != payload]
    rows = parse(raw, payload).select(*keep, F.explode("p.related_questions").alias("q"))
    return rows.select(*keep, "q.question", "q.snippet").filter("coalesce(question, '') <> ''")


def related_searches(raw: DataFrame, payload: str = "payload") -> DataFrame:
    keep = [c for c in raw.columns if c != payload]
    rows = parse(raw, payload).select(*keep, F.explode("p.related_searches").alias("q"))
    return rows.select(*keep, "q.query").filter("coalesce(query, '') <> ''")


def competitor_gap(results: DataFrame, headings: DataFrame, own: DataFrame, *, max_subtopics: int | None = None) -> DataFrame:
    """Per keyword: upper median words, mean H2 count, subtopics two or more competitors cover.

    ``results`` is (keyword, url, fetch_status, word_count, h2_count), ``headings`` (keyword, url, level,
    text), ``own`` (keyword, h1, word_count). A keyword has at most the few results a search returns, so its subtopics are few; with
    ``max_subtopics`` only the most covered ones are listed.
    """
    ok = results.filter("fetch_status = 'ok'")
    w = Window.partitionBy("keyword")
    ranked = ok.select("keyword", "url", "word_count", "h2_count").withColumns(
        {"_rn": F.row_number().over(w.orderBy("word_count", "url")), "_n": F.count(F.lit(1)).over(w)}
    )
    middle = F.col("_rn") == F.floor(F.col("_n") / 2) + 1
    stats = ranked.groupBy("keyword").agg(
        F.max(F.when(middle, F.col("word_count"))).alias("median_word_count"),
        rnd(F.avg("h2_count"), 1).alias("avg_h2_count"),
        F.count(F.lit(1)).alias("fetched_count"),
    )
    topic = F.lower(F.trim("text"))
    covered = (
        headings.filter(F.col("level").isin("h2", "h3"))
        .join(ok.select("keyword", "url"), ["keyword", "url"])
        .withColumn("topic", topic)
        .filter("topic <> ''")
        .join(own.select("keyword", F.lower(F.trim("h1")).alias("_own")), "keyword", "left")
        .filter(~F.equal_null("topic", "_own"))
    )
    counted = (
        covered.groupBy("keyword", "topic")
        .agg(F.count_distinct("url").alias("competitors"), F.min(F.trim("text")).alias("label"))
        .filter("competitors >= 2")
    )
    if max_subtopics is not None:
        counted = top_per_key(counted, ["keyword"], [F.col("competitors").desc(), F.col("topic").asc()], max_subtopics)
    entry = F.struct((-F.col("competitors")).alias("o"), "topic", "label")
    missing = counted.groupBy("keyword").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["label"]).alias("missing_subtopics"))
    return (
        own.select("keyword", F.col("word_count").alias("this_word_count"))
        .join(stats, "keyword", "left")
        .join(missing, "keyword", "left")
    )
