"""Typed request bodies: JSON text to columns, with every field's fault.

A body is parsed to a VARIANT and each field's type is looked at before its value is taken, so that a
number, list or object where text is asked for is a fault and never turned into text. Faults are an array
of (field, reason), in the order of the fields and at most one each; a body that is no JSON (a key given
twice is none either) or no object has one fault, of the field ''. Fields that are not asked for are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank, is_email, strip

#: Reasons.
INVALID, NOT_OBJECT, MISSING, NOT_TEXT, SHORT, LONG, VALUE = "json_invalid", "object_type", "missing", "string_type", "string_too_short", "string_too_long", "value_error"
FAULTS = "array<struct<field:string,reason:string>>"


class Text(NamedTuple):
    """A field of text: its bounds in code points, and what else it has to be."""

    name: str
    least: int = 0
    most: int | None = None
    optional: bool = False  # absent or null
    filled: bool = False  # not white space alone
    email: bool = False


CHAT = [Text("message", 1, 4000, filled=True), Text("conversation_id", optional=True)]
CREDENTIALS = [Text("email", email=True), Text("password", 8, 128, filled=True)]
REFRESH = [Text("refresh_token", 32, 512)]


def field_value(parsed: Column, field: Text) -> Column:
    """The field's text; null where it is none."""
    return F.when(kind_of(parsed, field) == "STRING", F.try_variant_get(parsed, f"$.{field.name}", "string"))


def kind_of(parsed: Column, field: Text) -> Column:
    """STRING, VOID (JSON's null), BIGINT and so on; null: there is no such field."""
    return F.schema_of_variant(F.try_variant_get(parsed, f"$.{field.name}", "variant"))


def reason_of(parsed: Column, field: Text) -> Column:
    kind, text = kind_of(parsed, field), F.try_variant_get(parsed, f"$.{field.name}", "string")
    refused = F.when(kind.isNull(), F.lit(None) if field.optional else F.lit(MISSING))
    if field.optional:
        refused = refused.when(kind == "VOID", F.lit(None))
    refused = refused.when(kind != "STRING", NOT_TEXT).when(F.length(text) < field.least, SHORT)
    if field.most is not None:
        refused = refused.when(F.length(text) > field.most, LONG)
    if field.filled:
        refused = refused.when(is_blank(text), VALUE)
    if field.email:
        refused = refused.when(~is_email(text), VALUE)
    return refused


def faults_of(parsed: Column, fields: list[Text]) -> Column:
    found = F.array(*(F.struct(F.lit(f.name).alias("field"), reason_of(parsed, f).alias("reason")) for f in fields))
    whole = F.when(parsed.isNull(), INVALID).when(~F.schema_of_variant(parsed).startswith("OBJECT"), NOT_OBJECT)
    return F.when(whole.isNotNull(), F.array(F.struct(F.lit("").alias("field"), whole.alias("reason")))).otherwise(F.filter(found, lambda x: x["reason"].isNotNull())).cast(FAULTS)


def typed(rows: DataFrame, fields: list[Text], body: str = "body") -> DataFrame:
    """rows with a column for each field (null where it is not text) and faults (empty: accepted)."""
    parsed = rows.withColumn("_parsed", F.try_parse_json(F.col(body)))
    values = [field_value(F.col("_parsed"), f).alias(f.name) for f in fields]
    return parsed.select(*rows.columns, *values, faults_of(F.col("_parsed"), fields).alias("faults"))


def chat_requests(rows: DataFrame, body: str = "body") -> DataFrame:
    """message, conversation_id, faults and error (null: accepted); the message is stripped."""
    done = typed(rows, CHAT, body)
    blank = F.to_json("faults") == F.to_json(F.array(F.struct(F.lit("message").alias("field"), F.lit(VALUE).alias("reason"))))
    error = F.when(blank, "chat_message_empty").when(F.size("faults") > 0, "request_invalid")
    return done.withColumns({"message": strip(F.col("message")), "error": error})


def credential_requests(rows: DataFrame, body: str = "body") -> DataFrame:
    """email, faults and accepted; the password stays where it is."""
    done = typed(rows, CREDENTIALS, body)
    return done.drop("password").withColumn("accepted", F.size("faults") == 0)


def refresh_requests(rows: DataFrame, body: str = "body") -> DataFrame:
    """refresh_token, faults and accepted: a text of 32 to 512 characters."""
    return typed(rows, REFRESH, body).withColumn("accepted", F.size("faults") == 0)


def said_faults(faults: Column) -> Column:
    """`field:reason` of each, one after the other."""
    return F.array_join(F.transform(faults, lambda x: F.concat(x["field"], F.lit(":"), x["reason"])), ",")


def within_body_limit(n_bytes: Column, most: int = 16_384) -> Column:
    """Null (no content-length header) passes."""
    return n_bytes.isNull() | (n_bytes <= most)
