"""Native decoding of plain-text files: UTF-8 first, then windows-1251, then ''."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _cp1251_pairs() -> tuple[str, str]:
    """Upper-half code points as ISO-8859-1 reads them, and what windows-1251 means by them."""
    source, target = [], []
    for byte in range(0x80, 0x100):
        raw = bytes([byte])
        try:
            meaning = raw.decode("cp1251")
        except UnicodeDecodeError:
            continue
        if meaning != raw.decode("latin-1"):
            source.append(raw.decode("latin-1"))
            target.append(meaning)
    return "".join(source), "".join(target)


LATIN1_CHARS, CP1251_CHARS = _cp1251_pairs()
# The one byte windows-1251 leaves undefined.
UNDEFINED_CP1251 = "\u0098"


def decode_text(content: Column) -> Column:
    """Text of a binary column; '' when neither encoding fits, as for a failed extraction."""
    as_utf8 = content.cast("string")
    as_latin1 = F.decode(content, "ISO-8859-1")
    return (
        F.when(F.is_valid_utf8(as_utf8), as_utf8)
        .when(F.instr(as_latin1, UNDEFINED_CP1251) > 0, F.lit(""))
        .otherwise(F.translate(as_latin1, LATIN1_CHARS, CP1251_CHARS))
    )
