"""Sources of raw postings: JSON and CSV files, scraped pages, and a registry of readers by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW = T.StructType([T.StructField(n, T.StringType()) for n in ("source", "external_id", "title", "company", "description", "city", "state", "country", "date_posted", "employment_type", "experience_level", "salary_raw", "job_url")])
#: Other names under which records have a field.
ALIASES = {"external_id": ("posting_id", "job_id", "id"), "description": ("raw_text", "job_description"), "job_url": ("url", "job_apply_link"), "date_posted": ("timestamp", "job_posted_at"), "company": ("employer_name",), "title": ("job_title",)}
# Signs that a page is a check for robots, and the length below which a page is of no use.
BLOCKED = (
    "cf-ray", "cloudflare", "just a moment", "challenge-platform", "cf-browser-verification", "attention required", "sorry, you have been blocked", "checking your browser", "__cf_bm",
    "enable javascript and cookies", "ddos protection by cloudflare",
)
LEAST_PAGE = 100
# Forms of employment, pay and place in a page's text.
EMPLOYMENT_IN_TEXT = r"(?i)\b(full[- ]time|part[- ]time|contract|temporary|internship|commission)\b"
PAY_IN_TEXT = r"(?i)(\$[\d,]+(?:\.\d{2})?(?:\s*-\s*\$?[\d,]+(?:\.\d{2})?)?(?:\s*/\s*(?:year|yr|hour|hr|annually|per\s+hour))?)"
PLACE_IN_TEXT = r"\b([A-Za-z][A-Za-z\s\.\-]+),\s*([A-Z]{2})\b"
_READERS: dict[str, Callable[..., DataFrame]] = {}


def reader(name: str):
    """Register a reader under a name."""

    def add(f):
        _READERS[name] = f
        return f

    return add


def read(spark: SparkSession, name: str, **options) -> DataFrame:
    """The rows of a registered reader; an unknown name raises with the known ones."""
    if name not in _READERS:
        raise ValueError(f"no reader {name!r}; there are {', '.join(sorted(_READERS))}")
    return _READERS[name](spark, **options)


def as_raw(df: DataFrame, source: str | None = None) -> DataFrame:
    """The frame in RAW's columns: each by its name, else by another name it goes by, else null."""
    have = set(df.columns)
    cols = []
    for f in RAW.fieldNames():
        found = [F.col(c).cast("string") for c in (f, *ALIASES.get(f, ())) if c in have]
        cols.append((F.coalesce(*found) if found else F.lit(source if f == "source" else None).cast("string")).alias(f))
    out = df.select(*cols)
    return out.withColumn("source", F.coalesce("source", F.lit(source))) if source else out


@reader("json")
def read_json(spark: SparkSession, path: str, source: str | None = None, schema: T.StructType | None = None) -> DataFrame:
    """A file with an array of records, or one record in each line."""
    r = spark.read.option("multiLine", True)
    return as_raw((r.schema(schema) if schema else r).json(path), source)


@reader("csv")
def read_csv(spark: SparkSession, path: str, source: str | None = None, schema: T.StructType | None = None) -> DataFrame:
    r = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return as_raw((r.schema(schema) if schema else r).csv(path), source)


@reader("parquet")
def read_parquet(spark: SparkSession, path: str, source: str | None = None) -> DataFrame:
    return as_raw(spark.read.parquet(path), source)


def blocked(html: Column, least: int = LEAST_PAGE) -> Column:
    """Whether a page is a check for robots or too short to be of use; null is too short."""
    low = F.lower(F.trim(F.coalesce(html, F.lit(""))))
    out = F.length(low) < least
    for sign in BLOCKED:
        out = out | low.contains(sign)
    return out


def flatten(df: DataFrame, joint: str = "_") -> DataFrame:
    """The frame with the fields of its structs, at any depth, as columns of their own; arrays and maps stay."""
    while any(isinstance(f.dataType, T.StructType) for f in df.schema):
        cols = []
        for f in df.schema:
            if isinstance(f.dataType, T.StructType):
                cols += [F.col(f"`{f.name}`").getField(x.name).alias(f"{f.name}{joint}{x.name}") for x in f.dataType]
            else:
                cols.append(F.col(f"`{f.name}`"))
        df = df.select(*cols)
    return df


def health(spark: SparkSession, name: str, **options) -> dict:
    """Whether a reader gives rows: {"source", "ok", "error"}; a failure is told, not raised."""
    try:
        read(spark, name, **options).limit(1).collect()
        return {"source": name, "ok": True, "error": None}
    except Exception as e:
        return {"source": name, "ok": False, "error": f"{type(e).__name__}: {e}"[:300]}


def tables_and_columns(spark: SparkSession, database: str | None = None) -> DataFrame:
    """(table_name, position, column_name, data_type) of the catalog's tables, in the order of their columns."""
    rows = [(t.name, i + 1, c.name, c.dataType) for t in spark.catalog.listTables(database) for i, c in enumerate(spark.catalog.listColumns(f"{database}.{t.name}" if database else t.name))]
    return spark.createDataFrame(rows, "table_name string, position int, column_name string, data_type string")


def split_values(text: Column, joint: str = r"\n|\|") -> Column:
    """The different values of a text that has several, trimmed, in the order of their first; blanks left out."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), joint), lambda x: F.trim(x)), lambda x: x != ""))


def _named(kind: str):
    return lambda x: F.struct(x.alias("name"), F.lit(kind).alias("kind"))


def listed_names(listed: DataFrame, entries: DataFrame, uri: str = "conceptUri", names: tuple[str, ...] = ("preferredLabel", "altLabels", "hiddenLabels")) -> DataFrame:
    """(uri, name, kind): every name of the entries that a list of uris has, one row each, by left join; an entry that is not found
    has a null name."""
    each = F.explode_outer(F.flatten(F.array(*[F.transform(split_values(F.col(n)), _named(n)) for n in names]))).alias("x")
    found = entries.select(F.col(uri).alias("uri"), each).select("uri", "x.name", "x.kind")
    return listed.select(F.col(uri).alias("uri")).distinct().join(found, "uri", "left")


def seed(spark: SparkSession, path: str, table: str, keys: list[str], source: str | None = None) -> DataFrame:
    """The state of the Parquet table at `table` with the records of the JSON file at `path`, the file's where a key is in both;
    for a table that isn't there yet, the file's records."""
    from ..operators.upserts import latest_wins

    rows = read_json(spark, path, source)
    p = spark._jvm.org.apache.hadoop.fs.Path(table)
    return latest_wins(spark.read.parquet(table), rows, keys) if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p) else rows.dropDuplicates(keys)


def markdown(df: DataFrame, most: int = 1_000) -> str:
    """The first `most` rows as a Markdown table; nulls are empty, bars are escaped."""
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(v) for v in r) + " |" for r in df.limit(most).collect()])


def report(df: DataFrame, path: str, kind: str = "csv") -> None:
    """Write a report as CSV with a header or as JSON lines."""
    w = df.coalesce(1).write.mode("overwrite")
    w.option("header", True).csv(path) if kind == "csv" else w.json(path)


def job_cards(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """(url, position, link, title) of the job links of list pages; pages that check for robots have none."""
    links = F.regexp_extract_all(F.col(html), F.lit(r"(?is)(<a\b[^>]*class=\"[^\"]*job[^\"]*\"[^>]*>.*?</a>)"), F.lit(1))
    rows = pages.filter(~blocked(F.col(html))).select(F.col(url).alias("url"), F.posexplode(links).alias("position", "a"))
    title = F.trim(F.regexp_replace(F.regexp_replace("a", r"<[^>]+>", " "), r"\s+", " "))
    return rows.select("url", "position", F.regexp_extract("a", r"(?i)href=\"([^\"]+)\"", 1).alias("link"), title.alias("title")).filter("title <> ''")


_LD = "title string, description string, datePosted string, employmentType string, hiringOrganization struct<name: string>, jobLocation struct<address: struct<addressLocality: string, addressRegion: string, addressCountry: string>>, baseSalary struct<currency: string, value: struct<minValue: double, maxValue: double, unitText: string>>"


def posting_pages(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """RAW rows of detail pages: from their JSON-LD posting, else title, text, pay, place and type from the page itself."""
    block = F.regexp_extract(F.col(html), r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>", 1)
    p = pages.filter(~blocked(F.col(html))).select(F.col(url).alias("job_url"), F.from_json(F.nullif(block, F.lit("")), _LD).alias("ld"), F.regexp_extract(F.col(html), r"(?is)<h1[^>]*>(.*?)</h1>", 1).alias("h1"),
                                                   F.trim(F.regexp_replace(F.regexp_replace(F.col(html), r"(?is)<(script|style)\b.*?</\1>|<[^>]+>", " "), r"\s+", " ")).alias("body"))
    v = F.col("ld.baseSalary.value")
    said = lambda pattern, i: F.nullif(F.regexp_extract("body", pattern, i), F.lit(""))
    pay = F.when(v["minValue"].isNotNull(), F.concat_ws(" ", "ld.baseSalary.currency", F.concat_ws("-", v["minValue"].cast("long"), v["maxValue"].cast("long")), v["unitText"])).otherwise(said(PAY_IN_TEXT, 1))
    return as_raw(
        p.select(
            "job_url", F.coalesce("ld.title", F.nullif(F.trim("h1"), F.lit(""))).alias("title"), F.coalesce("ld.description", "body").alias("description"), F.col("ld.datePosted").alias("date_posted"),
            F.coalesce("ld.employmentType", said(EMPLOYMENT_IN_TEXT, 1)).alias("employment_type"), F.col("ld.hiringOrganization.name").alias("company"), F.coalesce("ld.jobLocation.address.addressLocality", F.trim(said(PLACE_IN_TEXT, 1))).alias("city"),
            F.coalesce("ld.jobLocation.address.addressRegion", said(PLACE_IN_TEXT, 2)).alias("state"), F.col("ld.jobLocation.address.addressCountry").alias("country"), pay.alias("salary_raw"),
        )
    )


def fan_out(queries: DataFrame, keyword: str = "keywords", tier: str = "tiers") -> DataFrame:
    """(query, keyword, tier): every query with each of its keywords and tiers; no tiers means one null tier."""
    tiers = F.when(F.size(F.coalesce(tier, F.array())) > 0, F.col(tier)).otherwise(F.array(F.lit(None).cast("string")))
    return queries.select("query", F.explode(keyword).alias("keyword"), tiers.alias("t")).select("query", "keyword", F.explode("t").alias("tier"))


def table_or_empty(spark: SparkSession, name: str, schema: T.StructType) -> tuple[DataFrame, str | None]:
    """A catalog table, or an empty frame and a hint where there is none."""
    if spark.catalog.tableExists(name):
        return spark.table(name), None
    return spark.createDataFrame([], schema), f"table {name} does not exist yet"


def page(df: DataFrame, order: list[Column], limit: int, offset: int, most: int = 500) -> DataFrame:
    """A window of rows in a total order, the limit cut to 1 to `most`, the offset to 0 or more."""
    return df.orderBy(*order).offset(max(0, offset)).limit(max(1, min(limit, most)))
