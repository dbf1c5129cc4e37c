"""Saved pages: a Python data source, a robots file reader, and tables of HTML as rows."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PAGE_SCHEMA = "url string, kind string, html string"


class SavedPages(DataSource):
    """``spark.read.format("saved_pages").load(folder)``: one row for each .html file, url from its first comment or its name."""

    @classmethod
    def name(cls) -> str:
        return "saved_pages"

    def schema(self) -> str:
        return PAGE_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _PageReader(self.options)


class _PageReader(DataSourceReader):
    def __init__(self, options):
        self.folder, self.parts = options["path"], int(options.get("partitions", "4"))

    def partitions(self):
        names = sorted(n for n in os.listdir(self.folder) if n.endswith(".html"))
        return [InputPartition(names[i :: self.parts]) for i in range(self.parts) if names[i :: self.parts]]

    def read(self, partition) -> Iterator[tuple]:
        for n in partition.value:
            with open(os.path.join(self.folder, n), encoding="utf-8", errors="replace") as f:
                html = f.read()
            m = re.match(r"\s*<!--\s*url:\s*(\S+)\s*-->", html)
            yield (m[1] if m else n, n.split("_")[0].removesuffix(".html"), html)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SavedPages)


def is_block_page(html: Column) -> Column:
    """Whether a page is a challenge rather than content."""
    h = F.lower(html)
    return h.contains("just a moment") | h.contains("checking your browser") | h.contains("captcha") | (F.length(F.trim(h)) == 0)


def crawl_delay(robots: str, agent: str) -> float | None:
    """Crawl delay, possibly fractional, for an agent; of groups that name it the most specific counts."""
    best, found, agents, opened = None, -1, [], False
    for line in robots.splitlines():
        field, _, value = line.split("#", 1)[0].partition(":")
        field, value = field.strip().lower(), value.strip()
        if field == "user-agent":
            if opened:
                agents, opened = [], False
            agents.append(value.lower())
        elif field:
            opened = True
            if field == "crawl-delay":
                for a in agents:
                    size = 0 if a == "*" else len(a) if a in agent.lower() else -1
                    if size > found:
                        try:
                            best, found = float(value), size
                        except ValueError:
                            continue
    return best


class _Tables(HTMLParser):
    """Rows of all tables, each cell with its text and the targets of its links; definition lists as label rows."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple[int, int, list[str], list[str], bool]] = []
        self.table = -1
        self.stack: list[dict] = []
        self.title, self._in_title = "", False

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "table":
            self.table += 1
            self.stack.append({"no": self.table, "row": -1, "cells": None, "links": [], "head": False})
        elif tag == "title":
            self._in_title = True
        elif self.stack:
            t = self.stack[-1]
            if tag == "tr":
                t["row"] += 1
                t["cells"], t["links"], t["head"] = [], [], False
            elif tag in ("td", "th") and t["cells"] is not None:
                t["cells"].append([])
                t["head"] |= tag == "th"
            elif tag == "a" and t["cells"] and a.get("href"):
                t["links"].append(a["href"])
            elif tag in ("br", "p", "li") and t["cells"]:
                t["cells"][-1].append(" ")

    def handle_endtag(self, tag):
        if tag == "title":
            self._in_title = False
        if not self.stack:
            return
        t = self.stack[-1]
        if tag == "tr" and t["cells"] is not None:
            self.rows.append((t["no"], t["row"], [" ".join("".join(c).split()) for c in t["cells"]], t["links"], t["head"]))
            t["cells"] = None
        elif tag == "table":
            self.stack.pop()

    def handle_data(self, data):
        if self._in_title:
            self.title += data
        if self.stack and self.stack[-1]["cells"]:
            self.stack[-1]["cells"][-1].append(data)


def table_rows(html: str | None) -> list[tuple[int, int, list[str], list[str], bool]]:
    """(table, row, cells, links, header) of every table row of a page."""
    p = _Tables()
    p.feed(html or "")
    p.close()
    return p.rows


class TableRows:
    """User-defined table function: the rows of all tables of a page."""

    def eval(self, html: str):
        yield from table_rows(html)


def register_functions(spark: SparkSession) -> None:
    spark.udtf.register("html_table_rows", F.udtf(TableRows, returnType="table_no int, row_no int, cells array<string>, links array<string>, header boolean"))


def page_tables(pages: DataFrame, key: str = "url", html: str = "html") -> DataFrame:
    """(key, table_no, row_no, cells, links, header) of all pages; pages without tables give no row."""
    import pandas as pd

    schema = f"`{key}` {dict(pages.dtypes)[key]}, table_no int, row_no int, cells array<string>, links array<string>, header boolean"

    def run(batches):
        for b in batches:
            out = [(k, *r) for k, h in zip(b[key], b[html], strict=True) for r in table_rows(h)]
            yield pd.DataFrame(out, columns=[key, "table_no", "row_no", "cells", "links", "header"])

    return pages.select(key, html).mapInPandas(run, schema)


def checked_tables(rows: DataFrame, key: str, headers: list[str]) -> tuple[DataFrame, DataFrame]:
    """(records, errors): body rows of the tables whose header has the columns wanted, as a map from header to cell.

    A page where no table has them, or a row with another number of cells, is an error and never a guess.
    """
    norm = lambda c: F.transform(c, lambda x: F.lower(F.trim(x)))
    want = F.array(*(F.lit(h.lower()) for h in headers))
    heads = rows.where("header").select(key, "table_no", norm("cells").alias("_h")).where(F.size(F.array_except(want, "_h")) == 0).groupBy(key, "table_no").agg(F.first("_h").alias("_h"))
    body = rows.where("not header").join(heads, [key, "table_no"])
    fits = F.size("cells") == F.size("_h")
    good = body.where(fits & (F.size(F.array_distinct("_h")) == F.size("_h"))).select(key, "table_no", "row_no", F.map_from_arrays("_h", "cells").alias("record"), "links")
    short = body.where(~fits).select(key, F.concat(F.lit("layout:row "), F.col("row_no")).alias("error"))
    lost = rows.select(key).distinct().join(heads.select(key), key, "left_anti").select(key, F.lit("layout:no table").alias("error"))
    return good, short.unionByName(lost)


def event_list(pages: DataFrame) -> DataFrame:
    """(url, event_id, name, event_date, location) of list pages with the columns Name/date and Location."""
    from tallyspan.functions import text

    good, _ = checked_tables(page_tables(pages), "url", ["name/date", "location"])
    cell = F.col("record")["name/date"]
    day = F.regexp_extract(cell, r"([A-Z][a-z]+\.? \d{1,2}, \d{4})\s*$", 1)
    link = F.try_element_at(F.filter("links", lambda x: x.contains("/event-details/")), F.lit(1))
    return good.where(link.isNotNull()).select("url", text.strict_id(link).alias("event_id"), F.trim(F.regexp_replace(cell, r"[A-Z][a-z]+\.? \d{1,2}, \d{4}\s*$", "")).alias("name"), text.long_date(day).alias("event_date"), text.optional_text(F.col("record")["location"]).alias("location"))


def event_bouts(pages: DataFrame) -> DataFrame:
    """(url, place, fight_id, fighter_1_id, fighter_2_id, badge, weight_class, method, round, seconds) of event pages.

    Sides come from the links, in page order; a row without two fighters' links gives no bout.
    """
    from tallyspan.functions import text

    good, _ = checked_tables(page_tables(pages), "url", ["fighter", "weight class", "method", "round", "time"])
    ids = F.transform(F.filter("links", lambda x: x.contains("/fighter-details/")), text.strict_id)
    fight = F.try_element_at(F.filter("links", lambda x: x.contains("/fight-details/")), F.lit(1))
    cell = lambda h: text.optional_text(F.col("record")[h])
    bouts = good.where(F.size(ids) >= 2)
    return bouts.select("url", F.col("row_no").alias("place"), text.strict_id(fight).alias("fight_id"), ids[0].alias("fighter_1_id"), ids[1].alias("fighter_2_id"), F.lower(F.try_element_at("record", F.lit("w/l"))).alias("badge"), cell("weight class").alias("weight_class"), cell("method").alias("method"), cell("round").try_cast("int").alias("round"), text.clock_seconds(cell("time")).alias("seconds"))


def labelled_value(html: Column, label: str) -> Column:
    """Text that follows ``label:`` on a page, tags aside; dashes and nothing are null."""
    from tallyspan.functions import text

    plain = F.regexp_replace(F.regexp_replace(html, r"</(li|p|div|tr|dd)>|<br\s*/?>", "\n"), r"<[^>]*>", " ")
    return text.optional_text(F.regexp_extract(plain, rf"(?i)\b{label}\s*:\s*([^\n]*)", 1))


def fighter_bio(pages: DataFrame) -> DataFrame:
    """(url, fighter_id, height_cm, reach_cm, stance, dob): the bio only; career rates on the page aren't read, as
    they know the future."""
    from tallyspan.functions import text

    h = F.col("html")
    return pages.select("url", text.strict_id(F.col("url")).alias("fighter_id"), text.height_cm(labelled_value(h, "Height")).alias("height_cm"), text.inches_cm(labelled_value(h, "Reach")).alias("reach_cm"), labelled_value(h, "STANCE").alias("stance"), text.long_date(labelled_value(h, "DOB")).alias("dob"))


def page_ids(html: Column) -> Column:
    """struct(article_id, revision_id) of the inline configuration of an article."""
    n = lambda key: F.regexp_extract(html, rf'"{key}":\s*(\d+)', 1).try_cast("long")
    return F.struct(n("wgArticleId").alias("article_id"), n("wgRevisionId").alias("revision_id"))


def json_strict(value: dict) -> str:
    """JSON with sorted keys; NaN and infinities are refused."""
    return json.dumps(value, sort_keys=True, allow_nan=False, ensure_ascii=False)


class _Minimise(HTMLParser):
    def __init__(self, drop: set[str]):
        super().__init__(convert_charrefs=False)
        self.drop, self.depth, self.out = drop, 0, []

    def handle_starttag(self, tag, attrs):
        if self.depth or tag in self.drop:
            self.depth += tag in self.drop
            return
        self.out.append(self.get_starttag_text())

    def handle_endtag(self, tag):
        if tag in self.drop:
            self.depth = max(0, self.depth - 1)
        elif not self.depth:
            self.out.append(f"</{tag}>")

    def handle_data(self, data):
        if not self.depth:
            self.out.append(data)

    def handle_entityref(self, name):
        self.handle_data(f"&{name};")

    def handle_charref(self, name):
        self.handle_data(f"&#{name};")


def minimise(html: str, drop: tuple[str, ...] = ("script", "style", "noscript", "svg")) -> str:
    """The page without some elements and comments; what stays is unchanged."""
    p = _Minimise(set(drop))
    p.feed(html)
    p.close()
    return "".join(p.out)
