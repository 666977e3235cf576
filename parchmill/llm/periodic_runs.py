"""Periodic runs of words, by an online sparse dynamic program over diagonals.

Diagonal (lag) d matches at word i if word i equals word i-d. A run of period d is a stretch of
consecutive matches of diagonal d, at least ``max(12 - d, d)`` of them, together with the d words before. The words
are read once from left to right. Each word's earlier occurrences open diagonals, a diagonal stays
active while the next words match, its match length growing by one a word, and the word that
does not match ends it: if it was long enough, the run is emitted there and then.

Single words recur too often to be looked up, so a word counts with its context: as that many matches in
a row are needed, the occurrences that matter are those of the last ``size`` words, size 6 for lags 1 to 11, and 12, 24, 48 ... for
lags from the size up to twice the size. Occurrences are found by rolling hashes, sorted, for one size after the other,
and only where the shorter context recurs. Contexts that recur within half their size are inside a run of a smaller period and open nothing:
if all contexts of a diagonal did, its stretch would have the smaller period. Nor does a diagonal open that the hashes
show to end too soon. With that, the openings are at most in proportion to n log n, for a text of
one repeated word too. Every match is counted on exact word numbers; the hashes only say where to look.

A text is worked on whole, in one task; texts are never shuffled.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parchmill.llm.words import mix, powers

LEAST = 12  # words in a run
CONTEXT = 6  # matches that any run has: max(12 - d, d) is 6 or more
BYTES_AT_ONCE = 1 << 21  # of texts worked on together; a longer text is worked on alone

RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
SUMMARY = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_runs", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("period", T.LongType()),
        T.StructField("exponent_milli", T.LongType()),
        T.StructField("runs", T.ArrayType(RUN)),
        T.StructField("runs_sha256", T.StringType()),
        T.StructField("collapsed", T.StringType()),
        T.StructField("collapsed_sha256", T.StringType()),
    ]
)


def _prime_divisors(n: int) -> list[int]:
    found, p = [], 2
    while p * p <= n:
        if n % p == 0:
            found.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return found + [n] * (n > 1)


def _is_smallest(words: np.ndarray, start: int, period: int) -> bool:
    """Has a stretch of at least two periods no smaller one? A smaller one would divide the period."""
    once = words[start : start + period]
    for p in _prime_divisors(period):
        part = period // p
        if (once[part:] == once[: period - part]).all():
            return False
    return True


def _first_match(words: np.ndarray, at: int, lag: int, low: int) -> int:
    """The first word of the matches of a diagonal in a row that end with ``at``."""
    size = 32
    while True:
        lo = max(low + lag, at + 1 - size)
        differ = np.flatnonzero(words[lo : at + 1] != words[lo - lag : at + 1 - lag])
        if len(differ):
            return lo + int(differ[-1]) + 1
        if lo == low + lag:
            return lo
        size *= 2


def _openings(words: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, lag) pairs at which a diagonal may be opened, by word.

    ``words`` are numbers that never recur in another text, ``longest`` the words of the longest text.
    """
    n = len(words)
    none = np.zeros(0, np.int64)
    if n <= CONTEXT:
        return none, none
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(mix(words.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    at, size, below = np.arange(CONTEXT - 1, n), CONTEXT, 2 * CONTEXT
    least = 1
    places, lags = [none], [none]
    while True:
        begin = at + 1 - size
        keys = (sums[at + 1] - sums[begin]) * down[begin]
        order = np.argsort(keys, kind="stable")
        again = keys[order][1:] == keys[order][:-1]
        later, earlier = order[1:][again], order[:-1][again]
        before = np.full(len(at), -1, dtype=np.int64)  # the same context's last occurrence, as a place in ``at``
        before[later] = earlier
        recurs = np.zeros(len(at), dtype=bool)
        recurs[later] = recurs[earlier] = True
        # Words that open: all for the small lags; else none whose context recurs within half its size.
        open_ = np.flatnonzero(before >= 0)
        if least > 1:
            open_ = open_[2 * (at[open_] - at[before[open_]]) > size]
        back = before[open_]
        while len(open_):
            lag = at[open_] - at[back]
            near = lag < below
            open_, back, lag = open_[near], back[near], lag[near]
            wanted = lag >= least
            places.append(at[open_[wanted]])
            lags.append(lag[wanted])
            back = before[back]
            open_, back = open_[back >= 0], back[back >= 0]
        least, size, below = below, 12 if size == CONTEXT else 2 * size, 2 * below
        # A run of this period has two of them; a longer context recurs only where both its halves do.
        if 2 * least > longest:
            break
        kept = np.zeros(n, dtype=bool)
        kept[at[recurs]] = True
        at = at[recurs]
        half = size // 2
        at = at[at >= size - 1]
        at = at[kept[at - half]]
        if len(at) < 2:
            break
    places, lags = np.concatenate(places), np.concatenate(lags)
    # One opening for words in a row on a diagonal: they belong to the same matches.
    order = np.lexsort((places, lags))
    places, lags = places[order], lags[order]
    heads = np.ones(len(places), dtype=bool)
    heads[1:] = (lags[1:] != lags[:-1]) | (places[1:] != places[:-1] + 1)
    places, lags = places[heads], lags[heads]
    long = _matches(sums, down, places, lags) >= np.maximum(LEAST - lags, lags)
    places, lags = places[long], lags[long]
    order = np.argsort(places, kind="stable")
    return places[order], lags[order]


def _matches(sums: np.ndarray, down: np.ndarray, places: np.ndarray, lags: np.ndarray) -> np.ndarray:
    """How many matches in a row surround each place of a diagonal, by the hashes: at least the true number."""

    def same(a: np.ndarray, size: np.ndarray) -> np.ndarray:
        b = a - lags
        return (sums[a + size] - sums[a]) * down[a] == (sums[b + size] - sums[b]) * down[b]

    n = len(sums) - 1
    before, after = np.zeros_like(places), np.zeros_like(places)
    for step in (1 << k for k in range(n.bit_length(), -1, -1)):
        more = np.minimum(before + step, places - lags + 1)
        before = np.where(same(places + 1 - more, more), np.maximum(before, more), before)
        more = np.minimum(after + step, n - 1 - places)
        after = np.where(same(places + 1, more), np.maximum(after, more), after)
    return before + after


def find_runs(words: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(text, start, length, period) of every run, by text, start and period.

    ``words``: word numbers of several texts, text t from ``offsets[t]`` to ``offsets[t + 1]``; equal
    numbers are equal words. Starts count from the text's first word.
    """
    text_of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    # A word of another text is another word, so no diagonal leaves its text.
    own = text_of * (int(words.max(initial=0)) + 1) + words
    places, lags = _openings(own, int(np.diff(offsets).max(initial=0)))
    runs = []
    if not len(places):
        return runs
    texts = text_of[places]
    bounds = [0, *(np.flatnonzero(np.diff(texts)) + 1).tolist(), len(places)]
    for lo, hi in zip(bounds, bounds[1:]):
        text = int(texts[lo])
        first, end = int(offsets[text]), int(offsets[text + 1])
        found = _diagonals(own[first:end], (places[lo:hi] - first).tolist(), lags[lo:hi].tolist())
        runs += [(text, *run) for run in sorted(found, key=lambda r: (r[0], r[2]))]
    return runs


def _diagonals(words: np.ndarray, places: list[int], lags: list[int]) -> list[tuple[int, int, int]]:
    """One pass over a text: (start, length, period) of its runs, as their diagonals end."""
    n, seen, out = len(words), words.tolist(), []
    active: dict[int, int] = {}  # lag -> first of the matches in a row

    def end(lag: int, at: int) -> None:
        begin = active.pop(lag)
        start, length = begin - lag, at - begin + lag
        if length >= max(LEAST, 2 * lag) and _is_smallest(words, start, lag):
            out.append((start, length, lag))

    at, k = places[0], 0
    while at < n:
        word = seen[at]
        for lag in [lag for lag in active if seen[at - lag] != word]:
            end(lag, at)
        while k < len(places) and places[k] == at:
            if lags[k] not in active:
                begin = _first_match(words, at, lags[k], 0)
                if begin <= at:
                    active[lags[k]] = begin
            k += 1
        if active:
            at += 1
        elif k < len(places):
            at = places[k]
        else:
            break
    for lag in list(active):
        end(lag, n)
    return out


def repeat_tails(doc_ids: pa.Array, offsets: np.ndarray) -> np.ndarray:
    """For every word of several texts, which word stands in its place.

    With h = crc32 of the decimal doc_id and g = h // 10: where h % 10 is 0, the words from a = g % n on
    repeat the first p = 1 + (n - a) // (3 + g % 8) of them. Elsewhere, and for a null doc_id, each word stands for itself.
    """
    source = np.arange(offsets[-1], dtype=np.int64)
    for text, doc_id in enumerate(doc_ids.to_pylist()):
        n = int(offsets[text + 1] - offsets[text])
        h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
        if h % 10 or not n:
            continue
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        first = int(offsets[text])
        source[first + a : first + n] = first + a + np.arange(n - a) % p
    return source


def _sliced(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``BYTES_AT_ONCE`` of text, or one row."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    lo, total = 0, 0
    for at, size in enumerate(sizes.tolist()):
        if at > lo and total + size > BYTES_AT_ONCE:
            yield lo, at
            lo, total = at, 0
        total += size
    if lo < len(sizes):
        yield lo, len(sizes)


def _summaries(ids: pa.Array | None, texts: pa.Array) -> list[pa.Array]:
    """The columns of ``SUMMARY`` for some texts; tails repeat by ``ids`` if given."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat, parents = split.flatten(), pc.list_parent_indices(split)
    real = pc.not_equal(flat, "")
    flat, parents = flat.filter(real), parents.filter(real).to_numpy()
    counts = np.bincount(parents, minlength=len(texts)) if len(parents) else np.zeros(len(texts), np.int64)
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    numbers = flat.dictionary_encode().indices.to_numpy().astype(np.int64)
    source = np.arange(len(numbers)) if ids is None else repeat_tails(ids, offsets)
    found = find_runs(numbers[source], offsets)

    runs: list[list[dict]] = [[] for _ in range(len(texts))]
    change = np.zeros(len(numbers) + 1, dtype=np.int64)
    for text, start, length, period in found:
        runs[text].append({"start": start, "length": length, "period": period})
        change[offsets[text] + start + period] += 1
        change[offsets[text] + start + length] -= 1
    kept = np.cumsum(change[:-1]) == 0
    left = np.concatenate([[0], np.cumsum(kept)])[offsets].astype(np.int64)
    lists = pa.LargeListArray.from_arrays(
        pa.array(left, pa.int64()), flat.cast(pa.large_string()).take(pa.array(source[kept]))
    )
    collapsed = pc.binary_join(lists, pa.scalar(" ", pa.large_string()))

    best = [max(r, key=lambda x: (x["length"], -x["start"], -x["period"])) if r else None for r in runs]

    def column(value) -> pa.Array:
        return pa.array([None if b is None else value(b) for b in best], pa.int64())

    def digest(text: bytes) -> str:
        return hashlib.sha256(text).hexdigest()

    lines = ["".join(f"{x['start']},{x['length']},{x['period']}\n" for x in r).encode() for r in runs]
    return [
        pa.array(counts, pa.int64()),
        pa.array([len(r) for r in runs], pa.int64()),
        column(lambda b: b["start"]),
        column(lambda b: b["length"]),
        column(lambda b: b["period"]),
        column(lambda b: 1000 * b["length"] // b["period"]),
        pa.array(runs, pa.list_(pa.struct([(f.name, pa.int64()) for f in RUN]))),
        pa.array([digest(x) for x in lines], pa.string()),
        collapsed.cast(pa.string()),
        pa.array([digest(x.as_buffer()) for x in collapsed], pa.string()),
    ]


def periodic_runs(
    documents: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    tails: bool = False,
    columns: Sequence[str] = tuple(SUMMARY.names),
) -> DataFrame:
    """The periodic runs of every text, and the text with each run reduced to its first period.

    Adds to ``id_column``: n_words, n_runs, the longest run (ties: smallest start, then period; no run: nulls), ``runs`` by start
    and period, ``collapsed`` (kept words joined by one space; a word is dropped if any run holds it
    after its first period) and both digests. Words are split at ASCII white space. ``columns`` says
    which of these leave the tasks.

    A null text is an empty one: no words, no runs, digests of nothing. Rows come out once each, equal
    ones too; a null id is kept; an empty table gives an empty result; other columns are left out. ``tails``: first repeat
    words as ``repeat_tails`` says.
    """
    rows = documents.select(F.col(id_column), F.col(text).alias("_text"))
    fields = [f for f in SUMMARY if f.name in columns]
    names = [id_column, *(f.name for f in fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for lo, hi in _sliced(texts):
                some = ids.slice(lo, hi - lo)
                made = dict(zip(SUMMARY.names, _summaries(some if tails else None, texts.slice(lo, hi - lo))))
                yield pa.RecordBatch.from_arrays([some, *(made[f.name] for f in fields)], names=names)

    return rows.mapInArrow(run, T.StructType([rows.schema[0], *fields]))
