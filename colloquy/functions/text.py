"""Text functions; all of them built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: white space as Python's str.strip takes it, at either end.
EDGE_SPACE = r"^[\s\x{1c}-\x{1f}\x{85}\p{Z}]+|[\s\x{1c}-\x{1f}\x{85}\p{Z}]+$"
TITLE_LENGTH = 80
UNTITLED = "Untitled conversation"
REPLY_PREFIX = "Mock assistant reply: "


def strip(text: Column) -> Column:
    return F.regexp_replace(text, EDGE_SPACE, "")


def is_blank(text: Column) -> Column:
    return F.length(strip(text)) == 0


def length_between(text: Column, least: int, most: int) -> Column:
    """By code points, inclusive."""
    return F.length(text).between(least, most)


def title_of(text: Column) -> Column:
    return F.coalesce(F.substring(text, 1, TITLE_LENGTH), F.lit(UNTITLED))


def token_hash(token: Column) -> Column:
    return F.sha2(token, 256)


def is_email(text: Column) -> Column:
    """An approximation: one @, a dotted domain, no white space, 320 characters at most."""
    return text.rlike(r"^[^@\s]+@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+$") & (F.length(text) <= 320)


def is_uuid(text: Column) -> Column:
    """With or without hyphens, braces or the urn prefix."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(text), "^(urn:)?(uuid:)?", ""), r"[{}-]", "")
    return bare.rlike("^[0-9a-f]{32}$")


def without_trailing_slashes(url: Column) -> Column:
    return F.regexp_replace(url, "/+$", "")


def mentions(url: Column, part: str) -> Column:
    """Whether a URL holds a text, as it is written."""
    return url.contains(part)


def is_secure(url: Column) -> Column:
    return url.startswith("https://")


def words_after(text: Column, n: int) -> Column:
    """The words after the first n, joined again (words: split on single spaces)."""
    words = F.split(text, " ", -1)
    return F.array_join(F.slice(words, n + 1, F.greatest(F.size(words) - n, F.lit(0))), " ")


def python_json_string(text: Column) -> Column:
    """A JSON string literal as Python's json.dumps writes it: characters outside ASCII as \\uXXXX."""

    def escaped(ch: Column) -> Column:
        code = F.conv(F.hex(F.encode(ch, "UTF-16BE")), 16, 10).cast("long")
        units = F.hex(F.encode(ch, "UTF-16BE"))
        one = F.concat(F.lit("\\u"), F.lower(F.substring(units, 1, 4)))
        two = F.when(F.length(units) > 4, F.concat(F.lit("\\u"), F.lower(F.substring(units, 5, 4)))).otherwise(F.lit(""))
        named = F.when(ch == '"', F.lit('\\"')).when(ch == "\\", F.lit("\\\\")).when(ch == "\n", F.lit("\\n")).when(ch == "\r", F.lit("\\r")).when(ch == "\t", F.lit("\\t")).when(ch == "\b", F.lit("\\b")).when(ch == "\f", F.lit("\\f"))
        return named.when((code >= 32) & (code < 127), ch).otherwise(F.concat(one, two))

    plain = ~text.rlike(r'[^\x20-\x7e]|["\\]')
    return F.concat(F.lit('"'), F.when(plain, text).otherwise(F.array_join(F.transform(F.split(text, ""), escaped), "")), F.lit('"'))
