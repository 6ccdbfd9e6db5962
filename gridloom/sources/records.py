"""Chat exports, mail and calendar records, pages of long texts, year tables in plain text."""
from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from gridloom.functions.dates import parse_stamp
from gridloom.functions.numbers import first_number
from gridloom.operators.fill import LONG, filled
from gridloom.operators.scale import running
from gridloom.session import cut

CHAT_STAMP = r"^(\d{1,2}/\d{1,2}/\d{2,4}),?\s+(\d{1,2}:\d{2}(?:\s?[APap][Mm])?)\s+-\s+"
CHAT_LINE = CHAT_STAMP + r"([^:]{1,60}?):\s(.*)$"


def parse_chat(lines: DataFrame, least: int = 5) -> DataFrame:
    """Chat-export lines (file, line_no, line) to one row per message. Continuation lines join with a newline, a system
    line ends the message, and a file with fewer than `least` messages is not a chat. Message numbers come from a
    two-level running sum, so a file of any length spreads over tasks."""
    kind = F.when(F.col("line").rlike(CHAT_LINE), 1).when(F.col("line").rlike(CHAT_STAMP), 2).otherwise(0)
    marked = lines.withColumn("_kind", kind).filter((F.col("_kind") > 0) | (F.trim("line") != ""))
    placed = running(marked, ["file"], "line_no", sums={"_seg": (F.col("_kind") > 0).cast("long")},
                     carries={"_open": F.when(F.col("_kind") > 0, F.col("_kind"))})
    body = placed.filter("_open = 1").withColumns({
        "date_text": F.regexp_extract("line", CHAT_LINE, 1), "time": F.regexp_extract("line", CHAT_LINE, 2),
        "sender": F.trim(F.regexp_extract("line", CHAT_LINE, 3)),
        "_text": F.when(F.col("_kind") == 1, F.trim(F.regexp_extract("line", CHAT_LINE, 4))).otherwise(F.trim("line"))})
    first = F.when(F.col("_kind") == 1, F.struct("date_text", "time", "sender"))
    msg = body.groupBy("file", "_seg").agg(
        F.max(first).alias("h"), F.min("line_no").alias("line_no"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "_text"))), lambda s: s["_text"]), "\n").alias("message"))
    enough = msg.groupBy("file").agg(F.count("*").alias("_n")).filter(F.col("_n") >= least)
    out = msg.join(enough, "file", "left_semi")
    return out.select("file", "line_no", F.to_date(parse_stamp(F.col("h.date_text"))).alias("date"), F.col("h.time").alias("time"),
                      F.col("h.sender").alias("sender"), "message", first_number(F.col("message")).alias("first_number"),
                      F.col("message").rlike("<Media omitted>|<attached:").alias("media"))


MAIL_SCHEMA = ("id string, threadId string, internalDate string, snippet string, labelIds array<string>, "
               "payload struct<mimeType:string, headers:array<struct<name:string,value:string>>, body:struct<data:string>>")
# Senders and folders that mark bulk mail, subjects that mark calendar notices.
BULK_SENDER = r"(?i)(no-?reply|noreply|notifications?|mailer-daemon|news(letter)?|updates?|digest|info)@"
BULK_LABELS = ("CATEGORY_PROMOTIONS", "CATEGORY_SOCIAL", "CATEGORY_UPDATES", "CATEGORY_FORUMS")
NOTICE = (r"(?i)^(accepted|declined|tentatively accepted|invitation|updated invitation|canceled event|cancelled event|new event"
          r"|invitation from google calendar)\b")
BODY_CAP = 8000


def flatten_mail(df: DataFrame, col: str = "json") -> DataFrame:
    """Nested mail record to a flat row: sender name and address, direction, bulk and notice flags. A notice is not bulk.
    The stored body is capped, as a column of the store."""
    m = df.select(F.from_json(col, MAIL_SCHEMA).alias("m"), F.col(col).alias("_raw"))
    heads = F.transform(F.col("m.payload.headers"), lambda h: F.struct(F.lower(h["name"]).alias("key"), h["value"].alias("value")))
    last = F.aggregate(heads, F.create_map().cast("map<string,string>"),
                       lambda acc, h: F.map_concat(F.map_filter(acc, lambda k, _: k != h["key"]), F.create_map(h["key"], h["value"])))
    r = m.withColumn("h", last)
    sender = F.coalesce(F.col("h")["from"], F.lit(""))
    addr = F.lower(F.coalesce(F.nullif(F.regexp_extract(sender, r"<([^>]*)>", 1), F.lit("")), F.trim(sender)))
    name = F.when(sender.contains("<"), F.trim(F.regexp_replace(F.regexp_extract(sender, r"^([^<]*)<", 1), '"', ""))).otherwise("")
    labels = F.coalesce(F.col("m.labelIds"), F.array().cast("array<string>"))
    subject = F.coalesce(F.col("h")["subject"], F.lit(""))
    notice = subject.rlike(NOTICE) | F.col("_raw").contains("text/calendar")
    bulk = F.col("h")["list-unsubscribe"].isNotNull() | addr.rlike(BULK_SENDER) | F.arrays_overlap(labels, F.array(*[F.lit(x) for x in BULK_LABELS]))
    sent_ms = F.col("m.internalDate").try_cast("bigint")
    return r.select(
        F.col("m.id").alias("id"), F.col("m.threadId").alias("thread_id"), F.timestamp_millis(sent_ms).cast("timestamp_ntz").alias("date"),
        F.when(F.array_contains(labels, "SENT"), "out").otherwise("in").alias("direction"), addr.alias("from_addr"), name.alias("from_name"),
        F.coalesce(F.col("h")["to"], F.lit("")).alias("to_addr"), subject.alias("subject"), F.col("m.snippet").alias("snippet"),
        F.substring(F.coalesce(F.col("m.payload.body.data"), F.lit("")), 1, BODY_CAP).alias("body"), labels.alias("labels"),
        F.array_contains(labels, "UNREAD").alias("is_unread"), (bulk & ~notice).alias("is_bulk"), notice.alias("is_notice"))


EVENT_SCHEMA = ("id string, status string, summary string, location string, description string, start struct<date:string,dateTime:string>, "
                "end struct<date:string,dateTime:string>, organizer struct<email:string,self:boolean>, "
                "attendees array<struct<email:string,self:boolean,responseStatus:string>>")


def _moment(day: Column, stamp: Column, zone: str) -> Column:
    at = F.to_utc_timestamp(F.try_to_timestamp(F.concat(day, F.lit("T00:00:00")), F.lit("yyyy-MM-dd'T'HH:mm:ss")), zone)
    return F.from_utc_timestamp(F.coalesce(stamp.try_cast("timestamp"), at), zone).cast("timestamp_ntz")


def flatten_events(df: DataFrame, col: str = "json", zone: str = "Asia/Kolkata") -> tuple[DataFrame, DataFrame]:
    """Calendar records to (events, guests): cancelled ones skipped, all-day found from the start, own answer or
    `organizer`, guests without oneself as an array and as a child table."""
    e = df.select(F.from_json(col, EVENT_SCHEMA).alias("e")).filter(F.coalesce(F.col("e.status"), F.lit("")) != "cancelled")
    people = F.coalesce(F.col("e.attendees"), F.expr("cast(array() as array<struct<email:string,self:boolean,responseStatus:string>>)"))
    others = F.filter(people, lambda a: ~F.coalesce(a["self"], F.lit(False)))
    me = F.get(F.filter(people, lambda a: F.coalesce(a["self"], F.lit(False))), F.lit(0))
    events = e.select(
        F.col("e.id").alias("id"), _moment(F.col("e.start.date"), F.col("e.start.dateTime"), zone).alias("start"),
        _moment(F.col("e.end.date"), F.col("e.end.dateTime"), zone).alias("end"),
        (F.col("e.start.date").isNotNull() & F.col("e.start.dateTime").isNull()).alias("all_day"), F.coalesce("e.summary", F.lit("")).alias("title"),
        F.coalesce(me["responseStatus"], F.when(F.col("e.organizer.self"), "organizer").otherwise("")).alias("my_response"),
        F.transform(others, lambda a: F.coalesce(a["email"], F.lit(""))).alias("guests"))
    guests = e.select(F.col("e.id").alias("event_id"), F.explode(others).alias("g")).select(
        "event_id", F.coalesce("g.email", F.lit("")).alias("email"), F.coalesce("g.responseStatus", F.lit("")).alias("response"))
    return events, guests


def to_pages(docs: DataFrame, key: str, text: str, size: int = 3000, long: int = LONG) -> DataFrame:
    """Paragraph-preserving pages of about `size` characters: (key, page, text). Blank pages are dropped and keep their
    number. Texts of up to `long` characters are filled where they stand, longer ones by all tasks."""
    def pack(value: str) -> list[str]:
        pages, held, used = [], [], 0
        for para in value.split("\n"):
            if used and used + len(para) > size:
                pages.append("".join(held))
                held, used = [], 0
            held.append(para + "\n")
            used += len(para) + 1
        pages.append("".join(held))
        return pages

    @F.pandas_udf("array<string>")
    def pages(s: pd.Series) -> pd.Series:
        return s.map(lambda v: [] if v is None else pack(v))

    clean = F.regexp_replace(F.replace(F.col(text), F.lit("﻿"), F.lit("")), r"[ \t]+", " ")
    base = docs.select(F.col(key), clean.alias("_t"))
    short = base.filter(F.length("_t") <= long).select(key, F.posexplode(pages("_t")).alias("page", "text"))
    many = cut(base.filter(F.length("_t") > long).withColumn("row", F.monotonically_increasing_id()))
    if not many.isEmpty():
        lines = many.select("row", F.posexplode(F.split("_t", "\n", -1)).alias("pos", "line")).select("row", F.col("pos").cast("long").alias("pos"), F.concat("line", F.lit("\n")).alias("line"))
        # a page may hold `size` up to the end of a paragraph, its line end not counted
        spread = filled(lines, size + 1).join(many.select("row", key), "row").select(key, F.col("page").cast("int").alias("page"), "text")
        short = short.unionByName(spread)
    return short.withColumn("page", F.col("page") + 1).filter(F.trim(F.regexp_replace("text", r"\s+", " ")) != "")


def year_tables(lines: DataFrame) -> DataFrame:
    """Fixed-layout tables in text lines (file, page, line_no, line): a line with two or more years is the header; lines
    `label n n n` below it become (label, year, value) rows until a `Source:` line. The title line is carried along."""
    years = F.regexp_extract_all("line", F.lit(r"\b((?:19|20)\d{2}(?:-\d{2})?)\b"), F.lit(1))
    is_head = (F.size(years) >= 2) & ~F.col("line").rlike(r"(?i)^\s*source\s*:")
    is_end = F.col("line").rlike(r"(?i)^\s*source\s*:")
    is_title = F.col("line").rlike(r"(?i)^\s*table\b")
    marked = lines.withColumns({"_head": F.when(is_title, F.lit(None)).when(is_head, years).when(is_end, F.array().cast("array<string>")),
                                "_title": F.when(is_title, F.trim("line"))})
    placed = running(marked, ["file"], "line_no", carries={"header": F.col("_head"), "table": F.col("_title")})
    row = F.regexp_extract("line", r"^\s*(\S.*?)\s+(-?[\d,]+(?:\.\d+)?(?:\s+-?[\d,]+(?:\.\d+)?)*)\s*$", 1)
    nums = F.split(F.trim(F.regexp_extract("line", r"^\s*(\S.*?)\s+(-?[\d,]+(?:\.\d+)?(?:\s+-?[\d,]+(?:\.\d+)?)*)\s*$", 2)), r"\s+")
    body = placed.filter((F.size("header") >= 2) & F.col("_head").isNull() & F.col("_title").isNull()).withColumns({"label": row, "_n": nums})
    body = body.filter((F.col("label") != "") & (F.size("_n") == F.size("header")))
    cells = body.select("file", "page", "table", "label", "line_no", F.inline(F.arrays_zip(F.col("header").alias("year"), F.col("_n").alias("raw"))))
    return cells.select("file", "page", "table", "label", "line_no", "year", F.regexp_replace("raw", ",", "").cast("double").alias("value"))


def region_overlap(cells: DataFrame) -> DataFrame:
    """Share of categories each pair of regions has in common (of the smaller one), from one equi-join on the category."""
    c = cells.select("region", "category").distinct()
    size = c.groupBy("region").agg(F.count("*").alias("n"))
    other = c.select(F.col("region").alias("other"), "category")
    both = c.join(other, "category").filter("region < other").groupBy("region", "other").agg(F.count("*").alias("shared"))
    return (both.join(size, "region").join(size.select(F.col("region").alias("other"), F.col("n").alias("m")), "other")
            .select("region", "other", (F.col("shared") / F.least("n", "m")).alias("overlap")))


def fold_regions(cells: DataFrame, titles: dict[str, str]) -> DataFrame:
    """Observations from several regions folded to one row per (category, year), long by metric. A metric named in two
    regions takes its region's title word as a prefix; two different values under one key fail the job; categories
    shared by fewer than half of the regions' rows are reported by `region_overlap` and refused by the caller."""
    clash = cells.groupBy("metric").agg((F.min("region") != F.max("region")).alias("_twice"))
    title = F.lit(None).cast("string")
    for region, word in titles.items():
        title = F.when(F.col("region") == region, F.lit(word)).otherwise(title)
    named = cells.join(clash, "metric").withColumn("metric", F.when(F.col("_twice"), F.concat_ws(" ", title, "metric")).otherwise(F.col("metric")))
    got = named.groupBy("category", "year", "metric").agg(F.min("value").alias("value"), F.max("value").alias("_hi"))
    bad = F.assert_true(F.col("value") == F.col("_hi"), F.concat(F.lit("conflicting values for "), F.concat_ws("/", "category", "year", "metric")))
    return got.withColumn("_ok", bad).filter(F.col("_ok").isNull()).drop("_ok", "_hi")
