"""Chunked and unchunked translation.

A text is cut into chunks, every chunk is translated, and the results are joined
in order with a space. The chunks stay an array inside their row: no shuffle is
needed to put them back together.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchmill import schemas as S
from parchmill.functions import text as tx
from parchmill.operators.backends import ModelFactory, run_model_on_lists
from parchmill.session import cut_lineage

# A lexicon up to this many entries becomes a literal map in the plan.
INLINE_LEXICON_ROWS = 256
# A larger one is a file of blocks of about this many entries, some megabytes each.
BLOCK_ENTRIES = 250_000


@dataclass(frozen=True)
class Translator:
    """One of: ``identity`` (texts unchanged), ``lexicon`` (word by word from a
    (src, tgt) table), ``model`` (a plug-in)."""

    lexicon: DataFrame | None = field(default=None)
    model: ModelFactory | None = field(default=None)


IDENTITY = Translator()


def translate(
    df: DataFrame,
    translator: Translator,
    text_col: str = "text",
    out_col: str = "translation",
    ok_col: str = "ok",
    chunk_chars: int | None = S.CHUNK_CHARS,
) -> DataFrame:
    """Add the translation and an ok flag; a row with a failing chunk keeps its whole text."""
    pieces = tx.chunks(F.col(text_col), chunk_chars)
    if translator.model is not None:
        budgeted = df.withColumn(
            "_pieces", F.transform(pieces, lambda p: tx.first_tokens(p, S.TRANSLATE_MAX_TOKENS))
        )
        done = run_model_on_lists(budgeted, translator.model, "_pieces", "_done", ok_col)
        joined = F.when(F.col(ok_col), F.array_join("_done", " ")).otherwise(F.col(text_col))
        return done.withColumn(out_col, joined).drop("_pieces", "_done")
    if translator.lexicon is not None:
        return _by_lexicon(df.withColumn("_pieces", pieces), translator.lexicon, out_col, ok_col)
    return df.withColumns({out_col: F.array_join(pieces, " "), ok_col: F.lit(True)})


def _by_lexicon(df: DataFrame, lexicon: DataFrame, out_col: str, ok_col: str) -> DataFrame:
    """Replace known words, keep everything else as it is.

    A key is a lower-cased run of ``WORD_OR_GAP``, a word or what stands between two, whatever
    the size of the lexicon. Entries without a source or a target are left out. No text is
    shuffled, so streams and tables take the same way.
    """
    lexicon = lexicon.where(F.col("src").isNotNull() & F.col("tgt").isNotNull())
    lexicon = lexicon.groupBy("src").agg(F.min("tgt").alias("tgt"))
    entries = lexicon.limit(INLINE_LEXICON_ROWS + 1).collect()
    if len(entries) <= INLINE_LEXICON_ROWS:
        known = F.create_map(*[F.lit(x) for row in entries for x in (row["src"], row["tgt"])])
        work = df.withColumn("_pieces", _map_words(F.col("_pieces"), known) if entries else F.col("_pieces"))
    else:
        work = _look_up_words(df, lexicon)
    return work.withColumns({out_col: F.array_join("_pieces", " "), ok_col: F.lit(True)}).drop("_pieces")


def _map_words(pieces: Column, known: Column) -> Column:
    return F.transform(
        pieces,
        lambda piece: F.array_join(
            F.transform(
                F.regexp_extract_all(piece, F.lit(tx.WORD_OR_GAP), F.lit(0)),
                lambda run: F.coalesce(F.try_element_at(known, F.lower(run)), run),
            ),
            "",
        ),
    )


def _look_up_words(df: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Large lexicon: a file of blocks that every executor fetches once, looked up in whole Arrow
    batches of words. A worker holds one block at a time and the entries that its batch asks for.

    Keys come from the text alone, never from what another block put in its place, so the
    blocks are independent and their number only sets how much a worker holds of each.
    """
    name = _ship_blocks(lexicon)
    runs = F.transform("_pieces", lambda p: F.regexp_extract_all(p, F.lit(tx.WORD_OR_GAP), F.lit(0)))
    work = df.withColumn("_runs", runs)
    keys = F.transform("_runs", lambda piece: F.transform(piece, F.lower))
    found = _lookup(name)(keys)
    done = F.zip_with("_runs", found, lambda a, b: F.zip_with(a, b, lambda run, new: F.coalesce(new, run)))
    joined = F.transform(done, lambda piece: F.array_join(piece, ""))
    # A null text has no pieces and stays null.
    return work.withColumn("_pieces", joined).drop("_runs")


def _ship_blocks(lexicon: DataFrame) -> str:
    """Write the lexicon block by block and hand the file to all executors; its name there."""
    n_blocks = max(1, -(-lexicon.count() // BLOCK_ENTRIES))
    path = Path(tempfile.mkdtemp(prefix="parchmill-")) / f"lexicon-{uuid.uuid4().hex}.arrow"
    schema = pa.schema([("src", pa.string()), ("tgt", pa.string())])
    # Written first: the blocks are read from it one by one.
    lexicon = cut_lineage(lexicon.withColumn("block", F.pmod(F.xxhash64("src"), F.lit(n_blocks))))
    with pa.OSFile(str(path), "wb") as out, pa.ipc.new_file(out, schema) as file:
        for block in range(n_blocks):
            part = lexicon.where(F.col("block") == block).select("src", "tgt").toArrow().cast(schema).combine_chunks()
            file.write_table(part)
    lexicon.sparkSession.sparkContext.addFile(str(path))
    return path.name


def _lookup(name: str) -> Callable[[Column], Column]:
    """Arrow function: the targets of array<array<string>>, null where a word is not in the lexicon."""

    def look_up(keys: pa.Array) -> pa.Array:
        inner = keys.flatten()
        words = inner.flatten().dictionary_encode()
        places = np.full(len(words.dictionary), -1)
        parts, n = [pa.array([], type=pa.string())], 0
        with pa.OSFile(SparkFiles.get(name)) as source, pa.ipc.open_file(source) as file:
            for i in range(file.num_record_batches):
                block = file.get_batch(i)
                asked = pc.index_in(block.column("src"), value_set=words.dictionary)
                rows = np.flatnonzero(asked.is_valid().to_numpy(zero_copy_only=False))
                places[asked.drop_null().to_numpy()] = np.arange(n, n + len(rows))
                parts.append(block.column("tgt").take(pa.array(rows)))
                n += len(rows)
        targets = pa.concat_arrays(parts).take(pa.array(places, mask=places < 0))
        new = targets.take(words.indices)
        # Offsets anew: flattening leaves out what null rows point at.
        pieces = pa.ListArray.from_arrays(_offsets(inner), new)
        return pa.ListArray.from_arrays(_offsets(keys), pieces)

    return F.arrow_udf(look_up, "array<array<string>>")


def _offsets(lists: pa.Array) -> pa.Array:
    sizes = pc.fill_null(pc.list_value_length(lists), 0).cast(pa.int32())
    return pa.concat_arrays([pa.array([0], pa.int32()), pc.cumulative_sum(sizes)]).cast(pa.int32())
