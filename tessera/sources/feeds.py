"""Readers: tables, lookups, feeds, JSON interfaces, robots files, label files."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import partial
from pathlib import Path
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import constants as C
from tessera.functions.cells import labels
from tessera.session import small_batches

#: Where a JSON interface keeps its list, and the names its fields go by (fixed values).
LIST_PATHS = ["jobs", "results", "items", "data", "positions", "vacancies"]
JSON_FIELDS = {
    "title": ["title", "name", "position", "job_title"],
    "apply_url": ["url", "link", "apply_url", "application_url", "job_url"],
    "location_raw": ["location", "duty_station", "city", "country"],
    "deadline": ["deadline", "closing_date", "end_date", "expires_at"],
    "description_snippet": ["description", "summary", "details"],
}


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def lookups(spark: SparkSession) -> dict[str, DataFrame]:
    """The seed lookup tables as small frames (key) and countries (code, name)."""
    out = {k: spark.createDataFrame([(x,) for x in v], "key string") for k, v in {"levels": C.LEVELS, "missions": C.MISSIONS, "modalities": C.MODALITIES, "contracts": C.CONTRACTS, "org_types": C.ORG_TYPES, "crisis_types": C.CRISES, "clusters": C.CLUSTERS, "phases": C.PHASES, "benefits": C.BENEFITS, "policies": C.POLICIES, "donors": C.DONORS}.items()}
    return out | {"countries": spark.createDataFrame(list(C.COUNTRIES.items()), "code string, name string")}


def synonyms(stored: DataFrame) -> DataFrame:
    """Stored synonyms (type, raw_value, canonical_key), gaps filled by the built-in ones."""
    built = [(t, k, v) for t, m in (("level", C.LEVEL_SYNONYMS), ("mission", C.MISSION_SYNONYMS), ("modality", C.MODALITY_SYNONYMS)) for k, v in m.items()]
    built_in = stored.sparkSession.createDataFrame(built, "type string, raw_value string, canonical_key string")
    own = stored.select("type", F.lower("raw_value").alias("raw_value"), "canonical_key")
    return own.unionByName(built_in.join(own, ["type", "raw_value"], "left_anti"))


def rss_items(spark: SparkSession, path: str) -> DataFrame:
    """title, link and description of the items of RSS files."""
    raw = spark.read.format("xml").option("rowTag", "item").schema("title string, link string, description string").load(path)
    return raw.select(F.trim("title").alias("title"), F.trim("link").alias("apply_url"), F.trim("description").alias("description_snippet")).where("title <> '' and apply_url <> ''")


FEED = (
    "channel struct<item:array<struct<title:string,link:string,description:string,pubDate:string,guid:string,location:string>>>, item array<struct<title:string,link:string,description:string,pubDate:string,guid:string,location:string>>, "
    "entry array<struct<title:string,link:array<struct<_href:string,_rel:string>>,summary:string,content:string,updated:string,published:string,id:string,location:string>>, bad string"
)


def feed_items(documents: DataFrame, column: str) -> DataFrame:
    """The items of feeds in a text column: the columns of ``documents``, position, title, apply_url, description_snippet, location_raw, posted.

    RSS items stand in a channel or beside it, Atom entries in a feed; prefixes of names are ignored. An Atom entry's
    link is the first that is not to something else of the entry; an item without a link takes its id where that is an
    address. Items without a title or an address are left out; the snippet is the description's first 500 letters. Null
    and empty texts, and feeds that are no XML, which :func:`broken_feeds` lists, have no items.
    """
    x = _feed(documents, column)
    rss = F.transform(F.concat(*[F.coalesce(F.col(c), F.array()) for c in ("_feed.channel.item", "_feed.item")]), lambda i: F.struct(i["title"].alias("title"), F.coalesce(_filled(i["link"]), F.when(i["guid"].rlike("^https?://"), i["guid"])).alias("link"), i["description"].alias("description"), i["location"].alias("location"), i["pubDate"].alias("posted")))

    def entry(e: Column) -> Column:
        own = F.filter(e["link"], lambda a: F.coalesce(a["_rel"], F.lit("alternate")) == "alternate")
        link = F.coalesce(_filled(F.get(own, F.lit(0))["_href"]), F.when(e["id"].rlike("^https?://"), e["id"]))
        return F.struct(e["title"].alias("title"), link.alias("link"), F.coalesce(_filled(e["summary"]), e["content"]).alias("description"), e["location"].alias("location"), F.coalesce(e["published"], e["updated"]).alias("posted"))

    items = F.concat(rss, F.transform(F.coalesce("_feed.entry", F.array()), entry))
    rows = x.select(*documents.columns, F.posexplode(items).alias("position", "i"))
    rows = rows.select(*documents.columns, "position", F.trim("i.title").alias("title"), F.trim("i.link").alias("apply_url"), F.substring(F.trim("i.description"), 1, 500).alias("description_snippet"), F.trim("i.location").alias("location_raw"), F.trim("i.posted").alias("posted"))
    return rows.where("title <> '' and apply_url <> ''")


def _filled(text: Column) -> Column:
    return F.when(F.trim(text) != "", text)


def _feed(documents: DataFrame, column: str) -> DataFrame:
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad", "ignoreNamespace": "true"}
    return documents.withColumn("_feed", F.from_xml(F.when(F.trim(column) != "", F.trim(column)), FEED, options))


def broken_feeds(documents: DataFrame, column: str) -> DataFrame:
    """The feeds that are no XML, to be kept aside."""
    return _feed(documents, column).where("_feed.bad is not null").drop("_feed")


def json_items(documents: DataFrame, column: str, base_url: Column | None = None) -> DataFrame:
    """Records of JSON documents: the list is at the root or under one of the known names; fields by any of their names.

    An item without a url gets base_url/id; items without a title are left out.
    """
    lists = [F.when(F.trim(column).startswith("["), F.col(column)), *[F.get_json_object(column, f"$.{p}") for p in LIST_PATHS]]
    items = documents.select("*", F.posexplode(F.from_json(F.coalesce(*lists), "array<string>")).alias("position", "item"))

    def named(names: list[str]) -> Column:
        return F.coalesce(*[F.when(F.trim(x) != "", F.trim(x)) for x in (F.get_json_object("item", f"$.{n}") for n in names)])

    made = F.concat(F.rtrim(base_url, F.lit("/")), F.lit("/"), F.get_json_object("item", "$.id")) if base_url is not None else F.lit(None).cast("string")
    fields = {k: named(v) for k, v in JSON_FIELDS.items()}
    fields["apply_url"] = F.coalesce(fields["apply_url"], made)
    return items.withColumns(fields).where("title is not null").drop("item")


def robots(files: DataFrame, agent: str = "*") -> DataFrame:
    """disallow (array) and crawl_delay_ms of robots files (host, body) for ``agent``, by lines and a running section.

    A section begins at a user-agent line and holds up to the next one.
    """
    lines = files.select("host", F.posexplode(F.split("body", "\n")).alias("n", "line")).withColumn("line", F.trim(F.regexp_replace("line", "\r", "")))
    lines = lines.where(~F.col("line").startswith("#") & F.col("line").contains(":"))
    key, value = F.lower(F.trim(F.substring_index("line", ":", 1))), F.trim(F.regexp_replace("line", "^[^:]*:", ""))
    lines = lines.select("host", "n", key.alias("key"), value.alias("value"))
    mine = F.when(F.col("key") == "user-agent", F.lower("value").isin("*", agent.lower()))
    section = F.last(mine, ignorenulls=True).over(Window.partitionBy("host").orderBy("n"))
    rules = lines.withColumn("mine", section).where("mine")
    ordered = F.array_sort(F.collect_list(F.when((F.col("key") == "disallow") & (F.col("value") != ""), F.struct("n", "value"))))
    delay = F.max_by(F.when(F.col("key") == "crawl-delay", F.floor(F.col("value").try_cast("double") * 1000)), F.when((F.col("key") == "crawl-delay") & F.col("value").try_cast("double").isNotNull(), F.col("n")))
    out = rules.groupBy("host").agg(F.transform(ordered, lambda r: r["value"]).alias("disallow"), delay.cast("int").alias("crawl_delay_ms"))
    return files.select("host").join(out, "host", "left").withColumn("disallow", F.coalesce("disallow", F.array().cast("array<string>")))


def label_file(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def training_rows(labels_: DataFrame, batch: DataFrame) -> DataFrame:
    """Labelled snippets: labels joined to the batch by url, each url once."""
    return labels_.dropDuplicates(["url"]).join(batch.dropDuplicates(["url"]).select("url", "raw_html_snippet"), "url").select("url", F.col("raw_html_snippet").alias("text"), "label")


#: Folders over which stored pages are spread, so that tasks list them.
FOLDERS = 256


def store_pages(pages: DataFrame, path: str) -> None:
    """Keeps each page (page_id, html) as a file of its own under ``path``: its html and a line feed. Of pages with one id each different one is kept.

    In a folder that tasks see as a local one they write the files themselves, page_id=n.digest.html, since Spark's writer takes
    a folder, a checksum and changes of rights for each page; elsewhere Spark's writer does it.
    """
    uri = urlsplit(path)
    scheme = uri.scheme or urlsplit(pages.sparkSession.conf.get("spark.hadoop.fs.defaultFS", "file:///")).scheme
    if scheme != "file":
        pages.select("page_id", F.col("html").alias("value")).write.partitionBy("page_id").text(path)
        return
    small_batches(pages.sparkSession)
    rows = pages.select("page_id", F.pmod(F.hash("page_id"), F.lit(FOLDERS)).alias("folder"), F.col("html").cast("binary").alias("html"))
    rows.mapInArrow(partial(_store, uri.path), "n long").agg(F.sum("n")).collect()


def _store(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    made = set()
    for b in batches:
        for page, folder, html in zip(*(b.column(c).to_pylist() for c in ("page_id", "folder", "html")), strict=True):
            at = Path(path, f"{folder:03d}")
            if folder not in made:
                at.mkdir(parents=True, exist_ok=True)
                made.add(folder)
            # A task that runs twice leaves whole files: names beginning with a dot are not read.
            part = at / f".{page}-{uuid.uuid4().hex}"
            part.write_bytes(html + b"\n")
            part.replace(at / f"page_id={page}.{hashlib.md5(html).hexdigest()}.html")
        yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])


def stored_pages(spark: SparkSession, path: str) -> DataFrame:
    """Whole html files under a folder: path and html."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.input_file_name().alias("path"), F.col("value").alias("html"))


def storage_path(url: Column, source: Column, day: Column) -> Column:
    """domain/source/yyyymmdd/md5[:12].html"""
    return F.concat_ws("/", F.lower(F.regexp_extract(url, r"://([^/?#:]*)", 1)), source, F.date_format(day, "yyyyMMdd"), F.concat(F.substring(F.md5(url), 1, 12), F.lit(".html")))


def snapshots(pages: DataFrame) -> DataFrame:
    """Snapshot rows: name by sha256 of the url, and the rest as JSON metadata."""
    rest = [c for c in pages.columns if c != "html"]
    return pages.select(F.sha2("url", 256).alias("snapshot"), "html", F.to_json(F.struct(*rest)).alias("meta"))
