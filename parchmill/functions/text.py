"""Column expressions on text: strip, file extension, tokens, sentences, chunks, prompts.

All of them stay inside one row, so no caller has to shuffle text to use them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchmill import schemas as S

# The characters a Unicode-aware strip removes.
_SPACE = r"\t-\r\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
SPACE_CLASS = f"[{_SPACE}]"
NOT_SPACE_CLASS = f"[^{_SPACE}]"

# What ends a token of a budget, and its length at most.
ASCII_SPACE = r" \t\n\x0B\f\r"
TOKEN_CHARS = 32

SENTENCE_BREAK = r"[.!?]+[ \t\r\n]+|[\r\n]+"
TOKEN_BREAK = r"[^\p{L}\p{N}]+"
WORD_OR_GAP = r"\p{L}+|[^\p{L}]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    A column that is used once is inlined by the optimizer; inside another lambda
    that would compute it anew for every element.
    """
    return F.get(F.transform(F.array(value), body), 0)


def computed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """As ``withColumns``, for costly columns that later get filtered on.

    A filter on a plain column is pushed below it by writing the column's expression
    into the filter, which then computes it once more. It does not get past a generator.
    """
    row = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select(*[c for c in df.columns if c not in columns], F.inline(F.array(row)))


def strip(text: Column) -> Column:
    """Remove Unicode whitespace at both ends (``trim`` only removes spaces)."""
    return F.regexp_replace(text, rf"^{SPACE_CLASS}+|{SPACE_CLASS}+\z", "")


def is_blank(text: Column) -> Column:
    return ~text.rlike(NOT_SPACE_CLASS)


def extension(filename: Column) -> Column:
    """Lower-cased extension with its dot, '' if none; leading dots do not start one."""
    base = F.regexp_extract(filename, r"([^/]*)\z", 1)
    return F.lower(F.regexp_extract(base, r"(?s)^\.*[^.].*(\.[^.]*)\z", 1))


def normalize_question(question: Column) -> Column:
    stripped = strip(question)
    return F.when(stripped.endswith("?"), stripped).otherwise(F.concat(stripped, F.lit("?")))


def first_tokens(text: Column, n: int) -> Column:
    """The text up to the end of its ``n``-th token, or to its last one if it has fewer.

    A token is up to ``TOKEN_CHARS`` characters without white space; a longer run counts as several, so
    that a budget bounds texts of any script. The scan stops at the budget and never goes back.
    """
    token = rf"[{ASCII_SPACE}]*+[^{ASCII_SPACE}]{{1,{TOKEN_CHARS}}}+"
    return F.regexp_extract(text, rf"(?s)\A(?:{token}){{0,{n}}}+", 0)


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), TOKEN_BREAK), "")


def sentences(text: Column) -> Column:
    """array<struct<text, words>> of the sentences that hold at least one token."""
    return F.filter(
        F.transform(F.split(text, SENTENCE_BREAK), lambda s: F.struct(s.alias("text"), tokens(s).alias("words"))),
        lambda s: F.size(s["words"]) > 0,
    )


def chunks(text: Column, chunk_chars: int | None = S.CHUNK_CHARS) -> Column:
    """array<string> of consecutive pieces of at most ``chunk_chars`` code points.

    One regular-expression scan; repeated ``substring`` would rescan the text per chunk.
    """
    if chunk_chars is None:
        return F.array(text)
    return F.when(F.length(text) <= chunk_chars, F.array(text)).otherwise(
        F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{chunk_chars}}}"), F.lit(0))
    )


def truncate_context(context: Column, n_chars: int = S.CONTEXT_CHARS) -> Column:
    return F.substring(context, 1, n_chars)


def question_prompt(question: Column, context: Column) -> Column:
    return F.concat(
        F.lit("question: "),
        question,
        F.lit(" context: "),
        context,
        F.lit(" Give a detailed and comprehensive answer based on the context."),
    )


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def stable_id(*parts: Column) -> Column:
    """An id in the form of a UUID that is the same whenever the same parts are seen again."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.regexp_replace(F.sha2(text, 256), "^(.{8})(.{4})(.{4})(.{4})(.{12}).*$", "$1-$2-$3-$4-$5")


def cache_key(sha: Column) -> Column:
    return F.concat(F.lit("filecache:"), sha)


def rate_key(user_id: Column) -> Column:
    return F.concat(F.lit("user:"), user_id.cast("string"), F.lit(":requests"))
