"""Repeated passages by a sparse suffix array.

1. Of all suffixes (from a word to the end of the document) those at content-selected positions
   are retained: where the hash of the first KEY words is the smallest of WINDOW in a row. Any
   KEY + WINDOW - 1 = MIN_WORDS words in a row hold a retained suffix with its key, at the same
   place in every copy. So a match of MIN_WORDS never reaches further from its key than REACH
   words on either side.
2. Suffixes whose key others have too are brought in order of (key, words around it, document):
   the words around are the key with REACH words on its left and right, fewer at an end of the
   text. Neighbours that agree in these are a class, and its first document represents it; the
   matches of all others with it reach as far as any can, and need no further comparison. Where a
   text goes on repeating a few words, the places of a class in it overlap and move as two rows.
3. Where a key stands in several classes, matches between these end within REACH words. The
   representatives alone are looked up in their texts again and extended left and right word by
   word: of the MIN_WORDS words in a row whose smallest key it is, the hashes are brought in order
   with their documents, and each is compared with the first of its run. Other members of a class
   gain nothing there, as step 2 covers them wholly.
4. Overlapping or touching matches of a document are one stretch.

So exactly the words in MIN_WORDS or more that an earlier document has too are cut, whoever else
holds a part of them; no content loses its first copy. Runs are reduced by partial minima, so a
passage in very many documents is no long walk of one task, and a group of copies yields at most
one row a retained suffix, no pairs.

Documents are in order of (doc_id, hash), null first; repetition within one document is left
alone. Rows equal in doc_id and text are one document and give one row. Words are those of
``words``; texts of fewer than MIN_WORDS words (null and empty ones too) hold no repeat. A very
long text is one row here, with at most a match for every retained suffix and for every MIN_WORDS
words of step 3.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from parchmill.llm import words as W
from parchmill.llm.joins import broadcast_if_small
from parchmill.session import cut_lineage

MIN_WORDS = 50
KEY = 30
WINDOW = MIN_WORDS - KEY + 1
REACH = MIN_WORDS - KEY


def document_key(doc_id: Column, text: Column) -> Column:
    return F.xxhash64(doc_id, text)


def retained(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and positions of the retained suffixes of a text."""
    if len(hashes) < MIN_WORDS:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    keys = W.runs(hashes, KEY)
    at = W.minimisers(keys, WINDOW)
    return keys[at], at


def _of_texts(docs: DataFrame, made: str, make: Callable[..., tuple[np.ndarray, ...]], *more: str) -> DataFrame:
    """(doc_id, doc, *made) of what ``make`` finds in the bytes of each text and its columns ``more``."""
    rows = docs.select("doc_id", "doc", "text", *more)
    fields = T.StructType.fromDDL(made)
    schema = T.StructType([rows.schema["doc_id"], rows.schema["doc"], *fields])
    types = [to_arrow_type(field.dataType).to_pandas_dtype() for field in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                inputs = zip(W.text_buffers(batch.column(2)), *batch.columns[3:], strict=True)
                found = [make(*values) for values in inputs]
                owner = pa.array(np.repeat(np.arange(len(found)), [len(columns[0]) for columns in found]))
                columns = [
                    pa.array(np.concatenate(parts).astype(kind, copy=False))
                    for parts, kind in zip(zip(*found, strict=True), types, strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(owner), batch.column(1).take(owner), *columns], names=schema.names
                )

    return rows.mapInArrow(run, schema)


def _keys(data: np.ndarray) -> tuple[np.ndarray, ...]:
    # Once a text: what stands in one text alone is no repeat, however often.
    return (np.unique(retained(W.words_of(data)[0])[0]).view(np.int64),)


def chains(
    keys: np.ndarray, around: np.ndarray, first: np.ndarray, last: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the places that begin and end each row: places of one class that overlap or touch
    in a text cover one range and are one row. The first of them is a row of its own, as its end
    settles which of several earlier documents a stretch names."""
    order = np.lexsort((first, around, keys))
    same = (np.diff(keys[order]) == 0) & (np.diff(around[order]) == 0) & (first[order][1:] <= last[order][:-1])
    opens = np.append(True, ~same)[: len(order)]
    begins = np.flatnonzero(opens | np.append(True, opens[:-1])[: len(order)])
    return order[begins], order[np.append(begins[1:], len(order))[: len(begins)] - 1]


def _places(
    keys: np.ndarray, first: np.ndarray, last: np.ndarray, words: tuple[np.ndarray, np.ndarray, np.ndarray]
) -> tuple[np.ndarray, ...]:
    hashes, starts, stops = words
    around = W.stretches(hashes, first, last)
    begin, end = chains(keys, around, first, last)
    keys, around, first, last = keys[begin], around[begin], first[begin], last[end]
    return keys.view(np.int64), around.view(np.int64), first, last, starts[first], stops[last - 1]


def _suffixes(data: np.ndarray) -> tuple[np.ndarray, ...]:
    words = W.words_of(data)
    keys, at = retained(words[0])
    return _places(keys, np.maximum(at - REACH, 0), np.minimum(at + KEY + REACH, len(words[0])), words)


def _extensions(data: np.ndarray, asked: pa.Scalar) -> tuple[np.ndarray, ...]:
    words = W.words_of(data)
    least = W.window_minima(W.runs(words[0], KEY), WINDOW)
    at = np.flatnonzero(np.isin(least, asked.values.to_numpy(zero_copy_only=False).view(np.uint64)))
    return _places(least[at], at, at + MIN_WORDS, words)


_PLACE = "key long, around long, start_word int, end_word int, start_byte int, end_byte int"


def suffixes(docs: DataFrame) -> DataFrame:
    """Every retained suffix of ``docs`` (doc_id, doc, text): its key, the hash of the words around
    the key, and where these start and end; of ``chains`` of them, where the range does."""
    return _of_texts(docs, _PLACE, _suffixes)


def shared_suffixes(docs: DataFrame) -> DataFrame:
    """The ``suffixes`` whose key stands in more than one row of ``docs``."""
    counts = _of_texts(docs, "key long", _keys).groupBy("key").count()
    # What is joined is written first: with an aggregate below it, a join on a hot key could not be split.
    repeated = cut_lineage(counts.where("count > 1").select("key"))
    return suffixes(docs).join(broadcast_if_small(repeated), "key")


def classes_of(places: DataFrame) -> DataFrame:
    """(key, around, first, shared) of equal places: the first document, and whether there are others."""
    order = F.struct("doc_id", "doc")
    shared = (F.min("doc") < F.max("doc")).alias("shared")
    return places.groupBy("key", "around").agg(F.min(order).alias("first"), shared)


def _repeated(places: DataFrame, classes: DataFrame) -> DataFrame:
    """The places whose words an earlier document has."""
    first = classes.where("shared").select("key", "around", "first")
    found = places.join(first, ["key", "around"]).where("doc <> first.doc")
    return found.select(
        "doc_id", "doc", "start_word", "end_word", "start_byte", "end_byte", F.col("first.doc_id").alias("first_doc_id")
    )


def extensions(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """All MIN_WORDS words in a row, of representatives of keys that stand in several classes, whose
    smallest key is such a key. Columns as in ``suffixes``, ``around`` being the hash of the words."""
    several = cut_lineage(classes.groupBy("key").count().where("count > 1").select("key"))
    members = classes.select("key", F.col("first.doc").alias("doc")).join(broadcast_if_small(several), "key")
    asked = cut_lineage(members.groupBy("doc").agg(F.collect_set("key").alias("keys")))
    n_keys = asked.agg(F.sum(F.size("keys") + 1)).first()[0] or 0
    rows = docs.select("doc_id", "doc", "text").join(broadcast_if_small(asked, values=n_keys), "doc")
    return _of_texts(rows, _PLACE, _extensions, "keys")


def matches(docs: DataFrame) -> DataFrame:
    """(doc_id, doc, start_word, end_word, start_byte, end_byte, first_doc_id): words that an earlier
    document has, MIN_WORDS or more of them."""
    members = cut_lineage(shared_suffixes(docs))
    classes = cut_lineage(classes_of(members))
    extended = cut_lineage(extensions(docs, classes))
    return _repeated(members, classes).unionByName(_repeated(extended, cut_lineage(classes_of(extended))))


def stretches(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the ranges, which are in order of their starts, that begin and end each stretch of
    overlapping or touching ones."""
    if not len(starts):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    reach = np.maximum.accumulate(ends)
    begins = np.append(0, np.flatnonzero(starts[1:] > reach[:-1]) + 1)
    # The range that reaches furthest, among those up to the last of the stretch.
    furthest = np.maximum.accumulate(np.where(ends == reach, np.arange(len(ends)), 0))
    return begins, furthest[np.append(begins[1:], len(starts)) - 1]


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, doc, spans) of each document that repeats passages of earlier ones.

    ``docs`` has doc_id, doc (see ``document_key``) and text. A span has first and last-plus-one
    word, the same in bytes, and the doc_id of an earlier document that has the words it begins with.
    """
    id_field = docs.schema["doc_id"]
    span = T.StructType([
        *T.StructType.fromDDL("start_word int, end_word int, start_byte int, end_byte int"),
        T.StructField("first_doc_id", id_field.dataType),
    ])
    # A set: repeated rows of a document are the same places.
    ranges = F.array_sort(F.collect_set(F.struct(*span.names))).alias("ranges")
    found = matches(docs).groupBy("doc_id", "doc").agg(ranges)
    schema = T.StructType([id_field, docs.schema["doc"], T.StructField("spans", T.ArrayType(span))])
    arrow = pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in schema])

    def join_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, doc, own in zip(*batch.columns, strict=True):
                start, end, start_byte, end_byte, first = own.values.flatten()
                begins, ends = stretches(start.to_numpy(), end.to_numpy())
                columns = [column.take(pa.array(at)).to_pylist() for column, at in
                           [(start, begins), (end, ends), (start_byte, begins), (end_byte, ends), (first, begins)]]
                spans = [dict(zip(span.names, values, strict=True)) for values in zip(*columns, strict=True)]
                out.append({"doc_id": doc_id.as_py(), "doc": doc.as_py(), "spans": spans})
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return found.mapInArrow(join_ranges, schema)


def without_spans(text: Column, spans: Column) -> Column:
    """``text`` without the byte ranges of ``spans``."""
    data = F.encode(text, "UTF-8")
    count = F.size(spans)
    parts = F.transform(
        F.sequence(F.lit(0), count),
        lambda i: F.decode(
            F.substring(
                data,
                F.coalesce(F.get(spans, i - 1)["end_byte"], F.lit(0)) + 1,
                F.coalesce(F.get(spans, i)["start_byte"], F.octet_length(text))
                - F.coalesce(F.get(spans, i - 1)["end_byte"], F.lit(0)),
            ),
            "UTF-8",
        ),
    )
    return F.array_join(parts, "")
