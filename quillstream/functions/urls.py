"""Columns over URLs and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parts(url: Column) -> Column:
    """Struct of scheme and host (lower case, host without www.), path and query."""
    whole = F.when(url.rlike(r"(?i)^https?://"), url).otherwise(F.concat(F.lit("https://"), url))
    pick = lambda n: F.regexp_extract(whole, r"(?s)^([A-Za-z]+)://([^/?#]*)([^?#]*)(?:\?([^#]*))?", n)
    host = F.regexp_replace(F.lower(pick(2)), r"^www\.", "")
    return F.struct(F.lower(pick(1)).alias("scheme"), host.alias("host"), F.trim(F.regexp_replace(pick(3), "^/+|/+$", "")).alias("path"), pick(4).alias("query"))


def first_query_value(query: Column, key: str) -> Column:
    """First value of a key that is not blank once decoded."""
    pairs = F.filter(F.split(query, "&"), lambda x: x.startswith(key + "="))
    values = F.transform(pairs, lambda x: F.try_url_decode(F.regexp_replace(x, f"^{key}=", "")))
    return F.get(F.filter(values, lambda x: x.rlike(r"(?U)[^\s\x1c-\x1f]")), F.lit(0))


def video_id(url: Column) -> Column:
    """The eleven-character id of a video host's URL, else null."""
    url = F.regexp_replace(url, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    p = parts(url)
    second = F.get(F.split(p["path"], "/"), F.lit(1))
    found = F.when(p["host"] == "youtu.be", F.get(F.split(p["path"], "/"), F.lit(0))).when(
        p["host"].isin("youtube.com", "m.youtube.com", "music.youtube.com"),
        F.when(p["path"] == "watch", first_query_value(p["query"], "v")).when(p["path"].rlike("^(?:shorts|embed|live)/"), second),
    )
    sound = (url != "") & ~url.rlike(r"(?U)[\s\x1c-\x1f]") & found.rlike("^[A-Za-z0-9_-]{11}$")
    return F.when(sound, found)


def file_name(name: Column, most: int = 150, most_bytes: int = 120) -> Column:
    """A name fit for a file: forbidden characters, runs of space and ends tidied, at most so many characters and UTF-8 bytes."""
    name = F.regexp_replace(F.trim(name), r"[<>:\"/\\|?*\n\r\t]+", "_")
    name = F.btrim(F.regexp_replace(name, r"\s+", " "), F.lit(" ."))
    name = within_bytes(F.regexp_replace(F.substring(name, 1, most), "[ .]+$", ""), most_bytes)
    return F.coalesce(F.nullif(name, F.lit("")), F.lit("lecture"))


def within_bytes(name: Column, most: int = 120) -> Column:
    """The longest start of a name that takes so many UTF-8 bytes, cut between characters."""
    head = F.substring(name.cast("binary"), 1, most)
    whole = F.coalesce(*(F.when(F.is_valid_utf8(F.substring(head, 1, most - k).cast("string")), F.substring(head, 1, most - k).cast("string")) for k in range(4)))
    return F.when(F.octet_length(name) <= most, name).otherwise(F.regexp_replace(whole, "[ .]+$", ""))


def escaped(text: Column) -> Column:
    """Text with the five characters of HTML replaced."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def lecture_url(url: Column) -> Column:
    """What a page links to for a job's URL: the watch page of a video id, else the URL without its query; null if it is no web address."""
    url = F.trim(url)
    origin = F.regexp_extract(url, r"(?i)^(https?://[^/?#\s]+)", 1)
    host = F.regexp_replace(F.lower(F.regexp_replace(origin, r"(?i)^https?://", "")), r"^.*@|:\d+$", "")
    path = F.regexp_extract(url, r"(?i)^https?://[^/?#]+(/[^?#]*)", 1)
    asked = first_query_value(F.regexp_extract(url, r"\?([^#]*)", 1), "v")
    id = F.coalesce(asked, F.when(host == "youtu.be", F.substring(path, 2, 4096)).otherwise(F.regexp_extract(path, "^/(?:shorts|embed|live)/([^/]+)", 1)))
    whole = F.concat(F.lower(origin), F.when(path == "", "/").otherwise(path))
    return F.when(origin != "", F.when(id.rlike("^[A-Za-z0-9_-]{11}$"), F.concat(F.lit("https://www.youtube.com/watch?v="), id)).otherwise(whole))


def legacy_title(path: Column) -> Column:
    """A title from the old file names <id>_<title>[_english]_transcript[_cleanedv<n>].txt; null for other names."""
    name = F.regexp_extract(path, r"([^/\\]*)$", 1)
    stem = F.regexp_replace(name, r"(?i)(?:_english)?_transcript(?:_cleanedv\d+)?\.txt$", "")
    title = F.trim(F.replace(F.regexp_replace(stem, "^[A-Za-z0-9_-]{11}_", ""), F.lit("_"), F.lit(" ")))
    return F.when(name.rlike(r"(?i)_transcript(?:_cleanedv\d+)?\.txt$"), F.nullif(title, F.lit("")))


def canonical(video: Column) -> Column:
    return F.concat(F.lit("https://www.youtube.com/watch?v="), video)
