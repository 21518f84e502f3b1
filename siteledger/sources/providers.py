"""Provider payloads to typed rows. Every reader is a projection over a text or JSON scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import num, rnd

SEARCH_ROW = "keys array<string>, clicks double, impressions double, ctr double, position double"
GA4_REPORT = (
    "dimensionHeaders array<struct<name:string>>, metricHeaders array<struct<name:string>>, "
    "rows array<struct<dimensionValues:array<struct<value:string>>,metricValues:array<struct<value:string>>>>"
)


def _search_rows(raw: DataFrame, payload: str) -> DataFrame:
    parsed = raw.withColumn("_r", F.from_json(payload, SEARCH_ROW)).filter(F.size("_r.keys") >= 2)
    return parsed.withColumns(
        {
            "clicks": num("_r.clicks").cast("long"),
            "impressions": num("_r.impressions").cast("long"),
            "_first": F.col("_r.keys")[0],
            "_second": F.col("_r.keys")[1],
        }
    )


def gsc_daily(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """(date, page) rows. Rows with fewer than two keys or a date that does not parse are dropped."""
    rows = _search_rows(raw, payload).withColumn("date", F.try_to_date("_first", "yyyy-MM-dd"))
    keep = [c for c in raw.columns if c != payload]
    return rows.filter("date is not null").select(
        *keep, "date", F.col("_second").alias("raw_url"), "clicks", "impressions", num("_r.position").alias("position")
    )


def gsc_queries(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """(page, query) rows with rounded rates."""
    keep = [c for c in raw.columns if c != payload]
    return _search_rows(raw, payload).select(
        *keep,
        F.col("_first").alias("raw_url"),
        F.col("_second").alias("query"),
        "clicks",
        "impressions",
        rnd(num("_r.ctr"), 6).alias("ctr"),
        rnd(num("_r.position"), 2).alias("position"),
    )


def ga4_rows(raw: DataFrame, dimensions: list[str], metrics: list[str], payload: str = "payload") -> DataFrame:
    """Positional report rows to named columns; a metric that is not a number reads as 0."""
    keep = [c for c in raw.columns if c != payload]
    report = raw.withColumn("_p", F.from_json(payload, GA4_REPORT)).select(
        *keep, F.col("_p.dimensionHeaders.name").alias("_d"), F.col("_p.metricHeaders.name").alias("_m"), F.explode("_p.rows").alias("_row")
    )

    def named(names: str, values: Column) -> Column:
        zipped = F.arrays_zip(F.col(names).alias("k"), values.alias("v"))
        return F.map_from_entries(F.filter(zipped, lambda e: e["k"].isNotNull()))

    mapped = report.select(
        *keep,
        named("_d", F.col("_row.dimensionValues.value")).alias("_dim"),
        named("_m", F.col("_row.metricValues.value")).alias("_met"),
    )
    return mapped.select(
        *keep,
        *[F.col("_dim")[d].alias(d) for d in dimensions],
        *[F.coalesce(F.col("_met")[m].try_cast("double"), F.lit(0.0)).alias(m) for m in metrics],
    )


def ga4_date(text: Column | str) -> Column:
    """Report dates are yyyyMMdd; anything else is null."""
    return F.try_to_date(F.substring(text, 1, 8), "yyyyMMdd")


# Long and short header of every keyword report column.
KEYWORD_COLUMNS = {
    "keyword": ("Keyword", "Ph", "string"),
    "position": ("Position", "Po", "int"),
    "volume": ("Search Volume", "Nq", "int"),
    "cpc": ("CPC", "Cp", "double"),
    "competition": ("Competition", "Co", "double"),
    "difficulty": ("Keyword Difficulty Index", "Kd", "double"),
    "traffic_percent": ("Traffic (%)", "Tr", "double"),
}


def report_status(body: Column | str) -> Column:
    """'empty', 'failed' or 'ok' for one report body: services report problems as a plain line."""
    text = F.upper(F.trim(F.col(body) if isinstance(body, str) else body))
    return (
        F.when(text.isNull() | (text == ""), "empty")
        .when(text.startswith("ERROR") & text.contains("NOTHING FOUND"), "empty")
        .when(text.startswith("ERROR"), "failed")
        .otherwise("ok")
    )


def semrush_keywords(bodies: DataFrame, body: str = "body") -> DataFrame:
    """``;``-separated report bodies (one per row) to typed keyword rows.

    Each body carries its own header line, so values are picked by header name: the long name wins,
    then the short alias; numbers that do not parse are 0.
    """
    keep = [c for c in bodies.columns if c != body]
    lines = (
        bodies.filter(report_status(body) == "ok")
        .withColumn("_lines", F.split(F.trim(F.regexp_replace(F.col(body), "\r", "")), "\n"))
        .withColumn("_head", F.split(F.col("_lines")[0], ";"))
        .withColumn("_line", F.explode(F.slice("_lines", 2, F.greatest(F.size("_lines") - 1, F.lit(0)))))
        .filter("_line <> ''")
        .withColumn("_cells", F.split("_line", ";"))
    )

    def cell(name: str) -> Column:
        at = F.array_position("_head", F.lit(name)).cast("int")
        return F.when(at > 0, F.nullif(F.get("_cells", at - 1), F.lit("")))

    def typed(spec) -> Column:
        long, short, kind = spec
        value = F.trim(F.coalesce(cell(long), cell(short)))
        if kind == "string":
            return F.nullif(value, F.lit(""))
        return F.coalesce(value.try_cast("double"), F.lit(0.0)).cast(kind)

    rows = lines.select(*keep, *[typed(s).alias(n) for n, s in KEYWORD_COLUMNS.items()])
    return rows.filter("keyword is not null")


def read_semrush_reports(spark, path: str) -> DataFrame:
    """Report files from storage, one body per row with its file name."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("body"))
