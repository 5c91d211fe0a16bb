"""iCalendar text to event rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def calendar_id(html) -> Column:
    """Address of the calendar embedded in a page; holiday calendars are ignored."""
    frames = F.regexp_extract_all(T._col(html), F.lit(r"""(?is)<iframe\b[^>]*\bsrc\s*=\s*["']([^"']*calendar\.google\.com[^"']*)["']"""), F.lit(1))
    plain = F.transform(frames, lambda u: F.replace(T.unescape(u), F.lit("&#038;"), F.lit("&")))
    values = F.flatten(F.transform(plain, lambda u: F.regexp_extract_all(u, F.lit(r"[?&]src=([^&#]+)"), F.lit(1))))

    def decode(v: Column) -> Column:
        raw = F.coalesce(F.try_url_decode(v), v)
        padded = F.rpad(raw, F.ceil(F.length(raw) / 4).cast("int") * 4, "=")
        text = F.when(raw.rlike(r"^[A-Za-z0-9+/]+=*$"), F.try_to_binary(padded, F.lit("base64")).cast("string"))
        return F.when(raw.contains("@"), raw).when(text.contains("@") & ~text.contains("holiday"), text)

    return F.get(F.filter(F.transform(values, decode), lambda x: x.isNotNull()), F.lit(0))


def events(calendars: DataFrame, text: str = "text", url: str = "url") -> DataFrame:
    """One row per VEVENT with an id and a start.

    Folded lines are joined; the end of an all-day event is exclusive in the
    format, so one day is taken off.
    """
    unfolded = F.regexp_replace(F.regexp_replace(F.col(text), r"\r\n?", "\n"), r"\n[ \t]", "")
    blocks = F.split(unfolded, r"(?m)^BEGIN:VEVENT")
    e = calendars.select(F.col(url).alias("calendar"), F.explode(F.slice(blocks, F.lit(2), F.size(blocks))).alias("b"))
    e = e.withColumn("b", F.regexp_replace("b", r"(?s)\nEND:VEVENT.*$", "\n"))

    def raw(name: str) -> Column:
        return F.regexp_extract("b", rf"(?im)^{name}(?:;[^:\n]*)?:(.*)$", 1)

    def value(name: str) -> Column:
        v = F.replace(raw(name), F.lit("\\n"), F.lit("\n"))
        for ch in (",", ";", "\\"):
            v = F.replace(v, F.lit("\\" + ch), F.lit(ch))
        return F.nullif(F.trim(v), F.lit(""))

    def stamp(name: str) -> Column:
        v = F.regexp_replace(F.trim(raw(name)), "Z$", "")
        return F.coalesce(F.try_to_timestamp(v, F.lit("yyyyMMdd'T'HHmmss")), F.try_to_timestamp(v, F.lit("yyyyMMdd")))

    whole_day = F.col("b").rlike(r"(?im)^DTSTART;[^:\n]*VALUE=DATE[;:]")
    end_whole = F.col("b").rlike(r"(?im)^DTEND;[^:\n]*VALUE=DATE[;:]")
    start, end = stamp("DTSTART"), stamp("DTEND")
    day = F.to_date(start)
    return e.select(
        value("UID").alias("uid"), value("SUMMARY").alias("titulo"), value("DESCRIPTION").alias("descricao"),
        value("LOCATION").alias("local"), day.alias("data_inicio"),
        F.when(~whole_day, F.date_format(start, "HH:mm:ss")).alias("hora_inicio"), whole_day.alias("dia_inteiro"),
        F.when(end_whole, F.date_sub(F.to_date(end), 1)).otherwise(F.to_date(end)).alias("data_fim"),
        F.year(day).alias("ano"), F.month(day).alias("mes"), T.semester_of(day).alias("semestre"),
        T.long_date(day).alias("data_por_extenso"), stamp("LAST-MODIFIED").alias("atualizado_em"),
        F.lower(value("STATUS")).alias("situacao"), F.col("calendar").alias("url_calendario"),
    ).filter(F.col("uid").isNotNull() & F.col("data_inicio").isNotNull())
