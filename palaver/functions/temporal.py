"""Time in questions and messages. UTC throughout; the reference date is always an argument."""

from __future__ import annotations

import re
from datetime import date, datetime, time, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that make a question refer to time, found anywhere in it, in words or inside them.
KEYWORDS = (
    "when", "today", "yesterday", "last week", "last month", "this week",
    "this month", "last year", "this year", "ago", "before", "after",
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
    "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday",
    "morning", "afternoon", "evening", "night",
    "recently", "earlier", "later", "during",
)
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
#: Phrases that a question is searched for, the first found counts.
PHRASES = ("today", "yesterday", "last week", "last month", "this week", "this month")
YEAR = r"\b(19|20)\d{2}\b"
SLASHED = r"\b\d{1,2}/\d{1,2}(/\d{2,4})?\b"
FORMATS = ("%Y-%m-%d", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S", "%m/%d/%Y", "%B %d, %Y", "%b %d, %Y", "%d %B %Y")

Range = tuple[datetime, datetime]


def day(begin: date, end: date | None = None) -> Range:
    """From the first instant of a day to the last millisecond of a day."""
    return datetime.combine(begin, time()), datetime.combine(end or begin, time(23, 59, 59, 999000))


def parse(expression: str, reference: date) -> Range | None:
    text = expression.lower().strip()
    month_back = date(reference.year - (reference.month == 1), (reference.month - 2) % 12 + 1, 1) + timedelta(days=reference.day - 1)
    named = {
        "today": (reference, reference),
        "yesterday": (reference - timedelta(days=1),) * 2,
        "last week": (reference - timedelta(days=7), reference),
        "last month": (month_back, reference),  # a day the month lacks rolls over
        "this week": (reference - timedelta(days=reference.isoweekday() % 7), reference),
        "this month": (reference.replace(day=1), reference),
    }
    if text in named and text not in ("this week", "this month"):
        return day(*named[text])
    if m := re.search(r"last (\d+) days?", text):
        return day(reference - timedelta(days=int(m[1])), reference)
    if text in named:
        return day(*named[text])
    for k, name in enumerate(MONTHS):
        if name in text:
            year = int(m[0]) if (m := re.search(r"\d{4}", text)) else reference.year
            return day(date(year, k + 1, 1), date(year + (k == 11), (k + 1) % 12 + 1, 1) - timedelta(days=1))
    for form in FORMATS:
        try:
            return day(datetime.strptime(expression.strip(), form).date())
        except ValueError:
            continue
    return None


def refers(question: str) -> bool:
    text = question.lower()
    return bool(re.search(YEAR, text) or re.search(SLASHED, text)) or any(k in text for k in KEYWORDS)


def refers_column(text: Column) -> Column:
    return F.lower(text).rlike("|".join([YEAR, SLASHED, *KEYWORDS]))


def range_of(question: str, reference: date, structured: tuple[date, date | None] | None = None) -> Range | None:
    """The range a question asks for: a structured one first, else that of the first known phrase in it."""
    if structured:
        begin, end = structured
        return datetime.combine(begin, time()), datetime.combine(end or begin, time(23, 59, 59))
    if refers(question):
        for phrase in PHRASES:
            if phrase in question.lower():
                return parse(phrase, reference)
    return None


def indexed(messages: DataFrame) -> DataFrame:
    """The timestamp index: messages with a time. Files' minimum and maximum values stand in for a sorted list."""
    return messages.where(F.col("ts").isNotNull()).select("conv_id", "message_ordinal", "ts")


def parsed(raw: Column) -> Column:
    """A timestamp, or null where the text is none."""
    return F.coalesce(F.try_to_timestamp(raw), F.try_to_timestamp(raw, F.lit("MMMM d, yyyy")))


def between(messages: DataFrame, begin: datetime, end: datetime | None = None) -> DataFrame:
    inside = F.col("ts") >= F.lit(begin)
    return indexed(messages).where(inside if end is None else inside & (F.col("ts") <= F.lit(end)))


def on_day(messages: DataFrame, when: date) -> DataFrame:
    return indexed(messages).where((F.col("ts") >= F.lit(datetime.combine(when, time()))) & (F.col("ts") < F.lit(datetime.combine(when + timedelta(days=1), time()))))


def before(messages: DataFrame, when: datetime) -> DataFrame:
    return indexed(messages).where(F.col("ts") < F.lit(when))


def after(messages: DataFrame, when: datetime) -> DataFrame:
    return indexed(messages).where(F.col("ts") > F.lit(when))


def by_day(messages: DataFrame) -> DataFrame:
    return indexed(messages).groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n_messages"), F.min("message_ordinal").alias("first_message"), F.max("message_ordinal").alias("last_message"))


def extent(messages: DataFrame) -> DataFrame:
    return indexed(messages).agg(F.min("ts").alias("earliest"), F.max("ts").alias("latest"), F.count(F.lit(1)).alias("n"))


def conversation_extent(messages: DataFrame, key: str = "conv_id") -> DataFrame:
    """Times of a conversation's first and last message, by position; nothing if the first has none."""
    ends = messages.groupBy(key).agg(F.min_by("ts", "message_ordinal").alias("begin"), F.max_by("ts", "message_ordinal").alias("end"))
    return ends.where(F.col("begin").isNotNull())


def extent_text(begin: datetime, end: datetime) -> str:
    return f"ONLY use the following date/time ranges: conversation took place between {begin.isoformat()}Z and {end.isoformat()}Z"
