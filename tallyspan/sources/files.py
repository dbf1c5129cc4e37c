"""Files as tables: typed CSV, checked bytes, manifests, wide statistics, metrics text, synthetic corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspan.functions import text

# Columns of the CSV layouts, in file order.
CSV_SCHEMAS = {
    "mdabbert": "R_fighter string, B_fighter string, date string, R_odds string, B_odds string, Winner string, weight_class string",
    "rankings": "date date, weightclass string, fighter string, rank int",
    "odds_feed": "fight_url string, fighter_1 string, fighter_2 string, odds_1 string, odds_2 string, event_date string, adding_date string, source string, region string",
    "verified": "event_date date, fighter_1 string, fighter_2 string, verdict string, evidence string",
    "aliases": "source string, alias string, ufcstats_id string, note string",
    "distinct": "link_title string, reason string",
}


class BadFile(ValueError):
    """A file isn't what its manifest says, or breaks a rule of its layout."""


def read_csv(spark: SparkSession, path: str, layout: str) -> DataFrame:
    """A CSV with header and a fixed schema; nothing is inferred, blanks around values don't matter."""
    return spark.read.schema(CSV_SCHEMAS[layout]).option("header", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)


def read_odds(spark: SparkSession, path: str) -> DataFrame:
    d = read_csv(spark, path, "mdabbert")
    return d.select(text.squash(F.col("R_fighter")).alias("red_name"), text.squash(F.col("B_fighter")).alias("blue_name"), F.try_to_date("date", "yyyy-MM-dd").alias("bout_date"), text.tolerant_double(F.col("R_odds")).alias("red_odds"), text.tolerant_double(F.col("B_odds")).alias("blue_odds"), F.col("Winner").alias("winner"), "weight_class")


def read_rankings(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, vacant): vacant placeholders (empty or NA) apart from the rows."""
    d = read_csv(spark, path, "rankings")
    vacant = F.coalesce(F.trim("fighter"), F.lit("")).isin("", "NA")
    return d.where(~vacant), d.where(vacant)


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """Daily price feed: blanks are null, dates ISO."""
    d = read_csv(spark, path, "odds_feed")
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return d.select(blank("fight_url").alias("fight_url"), F.col("fighter_1").alias("name_1"), F.col("fighter_2").alias("name_2"), text.tolerant_double(F.col("odds_1")).alias("odds_1"), text.tolerant_double(F.col("odds_2")).alias("odds_2"), blank("event_date").try_cast("date").alias("event_date"), F.replace(blank("adding_date"), F.lit("T"), F.lit(" ")).try_cast("timestamp").alias("added"), "source", "region")


def read_verified(spark: SparkSession, path: str) -> DataFrame:
    """Reviewed disagreements keyed by the unordered pair of names."""
    return read_csv(spark, path, "verified").withColumn("pair", F.array_sort(F.array(F.lower(text.squash(F.col("fighter_1"))), F.lower(text.squash(F.col("fighter_2"))))))


def read_aliases(spark: SparkSession, path: str, entities: DataFrame, key: str = "ufcstats_id") -> DataFrame:
    """Reviewed aliases; a key that no entity has refuses the file."""
    d = read_csv(spark, path, "aliases")
    lost = d.where(F.col(key).isNotNull()).join(entities.select(key), key, "left_anti").select(key).distinct().limit(5).collect()
    if lost:
        raise BadFile(f"aliases of unknown entities: {[r[0] for r in lost]}")
    return d


def only_allowed(df: DataFrame, column: str, allowed: DataFrame, allowed_column: str) -> DataFrame:
    return df.join(allowed.select(F.col(allowed_column).alias(column)).distinct(), column, "left_semi")


def checksums(spark: SparkSession, folder: str) -> DataFrame:
    """(file, path, size_bytes, sha256) of the files of a folder, read by the executors."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return d.select(F.element_at(F.split("path", "/"), -1).alias("file"), "path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"), F.col("modificationTime").alias("modified"))


def build_manifest(spark: SparkSession, folder: str, previous: DataFrame | None = None) -> DataFrame:
    """Manifest of a folder; a file whose bytes are as before keeps its time."""
    now = checksums(spark, folder).select("file", "size_bytes", "sha256", F.col("modified").alias("downloaded_at"))
    if previous is None:
        return now
    old = previous.select("file", F.col("sha256").alias("_old"), F.col("downloaded_at").alias("_at"))
    return now.join(old, "file", "left").select("file", "size_bytes", "sha256", F.when(F.col("sha256") == F.col("_old"), F.col("_at")).otherwise(F.col("downloaded_at")).alias("downloaded_at"))


def verify_files(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """The checked files; raises if one is missing, isn't listed or has other bytes."""
    seen = checksums(spark, folder)
    j = manifest.select("file", F.col("sha256").alias("_want")).join(seen, "file", "full_outer")
    why = F.when(F.col("path").isNull(), "missing").when(F.col("_want").isNull(), "unlisted").when(F.col("_want") != F.col("sha256"), "changed")
    bad = j.withColumn("why", why).where("why is not null").select("file", "why").limit(10).collect()
    if bad:
        raise BadFile("; ".join(f"{r.file}: {r.why}" for r in bad))
    return seen


# Statistics of a side in the wide file.
STATS = ("kd", "sig_str_landed", "sig_str_attempted", "td_landed", "td_attempted", "sub_attempts", "control_sec")


def unpivot_wide(wide: DataFrame, key: str, stats: tuple[str, ...] = STATS, sides: tuple[str, ...] = ("f_1", "f_2"), rounds: int = 5) -> DataFrame:
    """(key, side, round, stats...) of columns named side_rN_stat, in one pass; rows with no statistic are dropped.

    Columns that the file lacks are null; NaN is null.
    """
    have = set(wide.columns)

    def cell(name: str, stat: str):
        if name not in have:
            return F.lit(None).cast("long").alias(stat)
        return text.nan_to_null(F.col(name).try_cast("double")).cast("long").alias(stat)

    rows = [F.struct(F.lit(s).alias("side"), F.lit(r).alias("round"), *(cell(f"{s}_r{r}_{x}", x) for x in stats)) for s in sides for r in range(1, rounds + 1)]
    out = wide.select(key, F.explode(F.array(*rows)).alias("x")).select(key, "x.*")
    return out.where(F.coalesce(*(F.col(x) for x in stats)).isNotNull())


def metric_samples(spark: SparkSession, path: str) -> DataFrame:
    """(name, labels, value) of a text exposition of metrics; comments are left out."""
    d = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#|$)"))
    pattern = r"^([A-Za-z_:][\w:]*)(\{.*\})?\s+(\S+)"
    pairs = F.regexp_extract_all(F.regexp_extract("value", pattern, 2), F.lit(r'(\w+)="((?:[^"\\]|\\.)*)"'), F.lit(0))
    labels = F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.regexp_extract(p, r'^(\w+)=', 1), F.regexp_extract(p, r'="(.*)"$', 1))))
    raw = F.regexp_extract("value", pattern, 3)
    number = F.when(raw == "+Inf", F.lit(float("inf"))).when(raw == "-Inf", F.lit(float("-inf"))).otherwise(raw.try_cast("double"))
    return d.select(F.regexp_extract("value", pattern, 1).alias("name"), labels.alias("labels"), number.alias("sample"))


def synthetic_events(spark: SparkSession, n: int, end: str, template: str) -> DataFrame:
    """``n`` weekly events before ``end``; the id is the start of the SHA-1 of ``template|k``."""
    k = F.col("id")
    return spark.range(n).select(F.substring(F.sha1(F.concat_ws("|", F.lit(template), k)), 1, 16).alias("event_id"), F.date_sub(F.lit(end).cast("date"), (k * 7).cast("int")).alias("event_date"), (F.floor(k / 25) + 1).cast("int").alias("page"))


def follow_redirects(pages: DataFrame, redirects: DataFrame, hops: int = 3) -> DataFrame:
    """(url, target, hops): where each page ends up after at most ``hops`` redirects; a longer chain or loop has a null target."""
    r = redirects.select(F.col("from_url").alias("_from"), F.col("to_url").alias("_to"))
    out = pages.select("url", F.col("url").alias("target"), F.lit(0).alias("hops"))
    for _ in range(hops):
        out = out.join(r, F.col("target") == F.col("_from"), "left").select("url", F.coalesce("_to", "target").alias("target"), (F.col("hops") + F.col("_to").isNotNull().cast("int")).alias("hops"))
    more = r.select("_from")
    return out.join(more, F.col("target") == F.col("_from"), "left").select("url", F.when(F.col("_from").isNull(), F.col("target")).alias("target"), "hops")


def cached_page(pages: DataFrame, source: str) -> DataFrame:
    """Latest copy of each page of one source."""
    return pages.where(F.col("source") == source).groupBy("url").agg(F.max_by(F.struct("fetched_at", "html"), "fetched_at").alias("p")).select("url", "p.*")
