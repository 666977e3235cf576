"""Column expressions for the two wire formats: delimited frames and JSON frames."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parchmill import schemas as S

DELIMITER = "|"


def encode_delimited(*parts: Column) -> Column:
    """``id|text`` or ``id|context|question`` as UTF-8 bytes."""
    joined = parts[0]
    for part in parts[1:]:
        joined = F.concat(joined, F.lit(DELIMITER), part)
    return joined.cast("binary")


def encode_json(request_id: Column, text: Column, question: Column | None = None) -> Column:
    fields = [request_id.alias("request_id"), text.alias("text")]
    if question is not None:
        fields.append(question.alias("question"))
    return F.to_json(F.struct(*fields)).cast("binary")


def split_delimited(value: Column, parts: int) -> Column:
    """array<string> cut at the first ``parts - 1`` delimiters.

    A delimiter inside an earlier field shifts the rest to the right, which is
    what consumers of this format see; JSON frames do not have that problem.
    """
    return F.split(value, "[|]", parts)


def decode_json(value: Column) -> Column:
    return F.from_json(value, S.JSON_FRAME)
