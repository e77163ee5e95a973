"""Chat exports to message rows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatlake.functions import vocabulary as v
from chatlake.functions.masking import MaskingPolicy, pseudonym, with_masked
from chatlake.functions.text import plain_name, plain_name_value, without_bidi

_DATE, _TIME = r"([0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{2,4})", r"([0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?)"
BRACKETED = rf"(?i)^\[{_DATE},?\s+{_TIME}\s*(AM|PM|[ÖöOo][ÖöSs]\.?)?\]\s*(.*)$"
DASHED = rf"(?i)^{_DATE},?\s+{_TIME}\s*(AM|PM|[Öö][ÖöSs])?\s+-\s+(.+)$"
EDITED = r"(?iu)\s*<\s*(?:Bu mesaj düzenlendi|This message was edited)\s*>\s*$"


def is_header(line: Column) -> Column:
    return line.rlike(BRACKETED) | line.rlike(DASHED)


def looks_like_chat(text: Column, head: int = 60) -> Column:
    """Two headers, or half of the lines, among the first lines that are not blank."""
    lines = F.filter(F.slice(F.split(without_bidi(text), r"\r\n|\n|\r", -1), 1, head), lambda x: F.trim(x) != "")
    hits = F.size(F.filter(lines, is_header))
    return F.coalesce((F.size(lines) > 0) & ((hits >= 2) | (hits / F.greatest(F.size(lines), F.lit(1)) >= 0.5)), F.lit(False))


def part(line: Column, n: int) -> Column:
    """Group ``n`` of whichever header matches: 1 date, 2 time, 3 half of the day, 4 the rest."""
    return F.when(line.rlike(BRACKETED), F.regexp_extract(line, BRACKETED, n)).otherwise(F.regexp_extract(line, DASHED, n))


def timestamp_of(date: Column, time: Column, half: Column) -> Column:
    """Day first, then month first; null if neither is a date. Years of two digits are after 2000."""
    d, t = F.split(date, "[./-]"), F.split(time, ":")
    num = lambda x: x.cast("int")
    year = F.when(num(d[2]) > 100, num(d[2])).otherwise(num(d[2]) + 2000)
    folded = F.rtrim(F.translate(F.lower(F.translate(half, "Öö", "oo")), ".", ""))
    hour = F.when(folded.isin("pm", "os"), num(t[0]) % 12 + 12).when(folded != "", num(t[0]) % 12).otherwise(num(t[0]))
    second = F.coalesce(num(F.get(t, F.lit(2))), F.lit(0))
    at = lambda month, day: F.try_make_timestamp_ntz(year, month, day, hour, num(t[1]), second)
    return F.coalesce(at(num(d[1]), num(d[0])), at(num(d[0]), num(d[1])))


def sender_of(rest: Column, longest: int = 80) -> Column:
    head = F.substring_index(rest, ":", 1)
    return F.when(F.contains(rest, F.lit(":")) & (F.char_length(head) <= longest), F.trim(head)).otherwise(F.lit(""))


def body_of(rest: Column, longest: int = 80) -> Column:
    head = F.substring_index(rest, ":", 1)
    split = F.contains(rest, F.lit(":")) & (F.char_length(head) <= longest)
    return F.trim(F.when(split, F.substr(rest, F.char_length(head) + 2)).otherwise(rest))


def is_system_event(sender: Column, body: Column) -> Column:
    return (sender == "") | F.trim(body).rlike("(?iu)" + "|".join(v.SYSTEM_EVENTS))


def is_authority(sender: Column, aliases: Iterable[str] = v.AUTHORITY_ALIASES) -> Column:
    folded = plain_name(sender)
    return F.exists(F.array(*[F.lit(plain_name_value(a)) for a in aliases]), lambda a: F.contains(folded, a))


def raw_messages(texts: DataFrame) -> DataFrame:
    """``source, line_no, date, time, half, sender, body`` of ``texts(source, text)``: lines without a header belong to the message before."""
    clean = F.replace(without_bidi(F.col("text")), F.lit("\r\n"), F.lit("\n"))
    lines = texts.select("source", F.posexplode(F.split(clean, "\n", -1)).alias("pos", "line")).withColumn("head", is_header(F.col("line")))
    so_far = Window.partitionBy("source").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("message", F.sum(F.col("head").cast("int")).over(so_far)).where("message > 0")
    one = lines.groupBy("source", "message").agg(
        F.min("pos").alias("pos"), F.max(F.when(F.col("head"), F.col("line"))).alias("first"),
        F.array_sort(F.collect_list(F.when(~F.col("head"), F.struct("pos", "line")))).alias("more"),
    )
    rest = part(F.col("first"), 4)
    body = F.array_join(F.concat(F.array(body_of(rest)), F.transform("more", lambda m: m["line"])), "\n")
    body = F.regexp_replace(F.regexp_replace(body, EDITED, ""), r"^\s+|\s+$", "")
    return one.select(
        "source", (F.col("pos") + 1).alias("line_no"), part(F.col("first"), 1).alias("date"), part(F.col("first"), 2).alias("time"),
        part(F.col("first"), 3).alias("half"), sender_of(rest).alias("sender"), body.alias("body"),
    )


def messages(texts: DataFrame, aliases: Iterable[str] = v.AUTHORITY_ALIASES, policy: MaskingPolicy = MaskingPolicy(), keep_system: bool = False) -> DataFrame:
    """``source, line_no, ts, sender, role, text, is_system_event, masked_counts``: masked before anything is kept."""
    raw = raw_messages(texts).withColumn("is_system_event", is_system_event(F.col("sender"), F.col("body")))
    if not keep_system:
        raw = raw.where("not is_system_event")
    raw = raw.withColumn("authority", is_authority(F.col("sender"), aliases)).withColumn("ts", timestamp_of(F.col("date"), F.col("time"), F.col("half")))
    done = with_masked(raw, "body", "text", "masked_counts", policy).where("text <> '' or is_system_event")
    role = F.when(F.col("is_system_event"), "system").when(F.col("authority"), "instructor").otherwise("participant")
    shown = F.when(F.col("authority"), F.trim(without_bidi(F.col("sender")))).otherwise(pseudonym(F.col("sender"), policy))
    return done.select("source", "line_no", "ts", shown.alias("sender"), role.alias("role"), "text", "is_system_event", "masked_counts")
