"""Near-duplicates by improved consistent weighted sampling (Ioffe, 2010) over TF-IDF shingles.

1. Every shingle of five words weighs tf * idf. The document frequency is that of the shingle's
   column, one of IDF_COLUMNS, counted over all documents; a column starts near the mean, so a
   shingle of a large part of the corpus stands out at any corpus size.
2. HASHES consistent samples of a text are cut into BANDS bands. Equal texts are one node.
3. In each bucket of a band the members are compared with the bucket's head, its member that
   most others meet anywhere. In a bucket that this leaves in several components all members are
   compared with each other where their samples promise it: AGREE of HASHES or more are equal,
   which a pair of similarity 0.8 misses once in a thousand. That is done inside groups of
   bounded size, in which a comparison of texts that are connected already is left out: a group
   gives links that connect components of it, less than it has members, and no pairs. The members
   of a larger bucket are grouped anew by their PREFIX rarest samples, of which a pair with AGREE
   equal ones shares one at least; what is still larger is dealt into blocks. Each block is looked
   at by itself, then each two blocks of what is still in different components.
4. A comparison is the exact weighted Jaccard similarity of both whole texts.
5. Classes are the connected components of the links, by label propagation and pointer jumps.

Banding is probabilistic: a pair of similarity 0.8 meets in one of 16 bands of 4 with
probability 0.9998. Texts without words (null, empty) are similar to none. Rows are documents:
repeated rows are in one class.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parchmill.llm import words as W
from parchmill.llm.joins import broadcast_if_small
from parchmill.session import cut_lineage

SHINGLE = 5
SIMILARITY = 0.8
IDF_COLUMNS = 1 << 16
HASHES, BANDS = 64, 16
AGREE = 41  # equal samples of a pair that is worth a comparison
PREFIX = HASHES - AGREE + 1  # rarest samples of a text, one of which every such pair shares
GROUP = 1024  # members that are compared with each other in one place
GROUP_BYTES = 16 << 20  # and their texts, if these are several
STEP = 64  # comparisons of a text with others at once
DRAWS = 1 << 16  # prepared triples of random variables
AT_ONCE = 2048  # shingles times HASHES in one step

_U = np.uint64


def _prepared() -> tuple[np.ndarray, ...]:
    rng = np.random.default_rng(97)
    r = rng.gamma(2, 1, DRAWS).astype(np.float32)
    log_c = np.log(rng.gamma(2, 1, DRAWS)).astype(np.float32)
    beta = rng.random(DRAWS, dtype=np.float32)
    spread = rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) * _U(2) + _U(1)
    join = rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) * _U(2) + _U(1)
    return r, log_c, beta, spread, join


_R, _LOG_C, _BETA, _SPREAD, _JOIN = _prepared()


def text_key(text: Column) -> Column:
    """Which rows have equal texts: a 64-bit hash, null for null."""
    return F.when(text.isNotNull(), F.xxhash64(text))


def columns_of(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> _U(48)).astype(np.int64)


def document_frequency(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, int]:
    """In how many documents each column has a shingle, and the number of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(IDF_COLUMNS, dtype=np.int64), 0
        for batch in batches:
            for data in W.text_buffers(batch.column(0)):
                columns = columns_of(W.shingles(W.words_of(data)[0], SHINGLE))
                total[np.unique(columns)] += 1
                n += 1
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(some, -1)), pa.array(np.append(total[some], n))], names=["number", "n"]
        )

    counts = docs.select(text).mapInArrow(run, "number long, n long").groupBy("number").agg(F.sum("n").alias("n"))
    found = counts.toPandas()  # IDF_COLUMNS + 1 rows at most
    frequency = np.zeros(IDF_COLUMNS + 1, dtype=np.int64)
    frequency[found["number"].to_numpy(dtype=np.int64)] = found["n"].to_numpy(dtype=np.int64)
    return frequency[:-1], int(frequency[-1])


def inverse_frequency(frequency: np.ndarray, n: int) -> np.ndarray:
    """log(1 + n / df), above zero for every shingle."""
    return np.log1p(max(n, 1) / np.maximum(frequency, 1)).astype(np.float32)


def weigh(data: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of a text in order, and their weights."""
    shingles, counts = np.unique(W.shingles(W.words_of(data)[0], SHINGLE), return_counts=True)
    return shingles, counts * idf[columns_of(shingles)]


def samples(shingles: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """HASHES consistent weighted samples, each a hash of the shingle drawn and its level."""
    best = np.full(HASHES, np.inf, dtype=np.float32)
    drawn = np.zeros(HASHES, dtype=_U)
    every = np.arange(HASHES)
    log_weights = np.log(weights).astype(np.float32)
    for start in range(0, len(shingles), AT_ONCE):
        own = shingles[start : start + AT_ONCE]
        at = ((own[:, None] * _SPREAD) >> _U(48)).astype(np.int64)
        r, beta = _R[at], _BETA[at]
        level = np.floor(log_weights[start : start + AT_ONCE, None] / r + beta)
        key = _LOG_C[at] - r * (level - beta) - r
        least = key.argmin(axis=0)
        value = key[least, every]
        better = value < best
        best[better] = value[better]
        tag = W.mix(own[least] + level[least, every].astype(np.int64).astype(_U) * _U(0x9E3779B97F4A7C15))
        drawn[better] = tag[better]
    return drawn


def bands_of(drawn: np.ndarray) -> np.ndarray:
    parts = (drawn * _JOIN).reshape(BANDS, -1).sum(axis=1, dtype=_U)
    return W.mix(parts + np.arange(BANDS, dtype=_U))


def signatures(docs: DataFrame, idf: np.ndarray) -> DataFrame:
    """Append ``_bands`` (BANDS longs) and ``_samples`` (binary), null without words, and drop ``text``."""
    shared = docs.sparkSession.sparkContext.broadcast(idf)
    kept = [field for field in docs.schema.fields if field.name != "text"]
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bands, packed = [], []
            for data in W.text_buffers(batch.column(at)):
                shingles, weights = weigh(data, shared.value)
                drawn = samples(shingles, weights) if len(shingles) else None
                bands.append(None if drawn is None else bands_of(drawn).view(np.int64))
                packed.append(None if drawn is None else drawn.astype("<u4").tobytes())
            rest = [batch.column(i) for i in range(batch.num_columns) if i != at]
            arrays = [*rest, pa.array(bands, type=pa.list_(pa.int64())), pa.array(packed, type=pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, [*(f.name for f in kept), "_bands", "_samples"])

    made = [T.StructField("_bands", T.ArrayType(T.LongType())), T.StructField("_samples", T.BinaryType())]
    return docs.mapInArrow(run, T.StructType([*kept, *made]))


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    _, at_a, at_b = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = np.minimum(a[1][at_a], b[1][at_b]).sum(dtype=np.float64)
    total = a[1].sum(dtype=np.float64) + b[1].sum(dtype=np.float64) - common
    return float(common / total) if total else 0.0


def compare(pairs: DataFrame, texts: DataFrame, idf: np.ndarray) -> DataFrame:
    """(head, member, similarity) of pairs of text keys. The member's text is joined first, so
    that a head of many pairs is the only large key, which adaptive execution splits."""
    shared = pairs.sparkSession.sparkContext.broadcast(idf)
    member = texts.select(F.col("_key").alias("member"), F.col("text").alias("member_text"))
    head = texts.select(F.col("_key").alias("head"), F.col("text").alias("head_text"))
    rows = pairs.join(member, "member").join(head, "head").select("head", "member", "head_text", "member_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads: OrderedDict[int, tuple] = OrderedDict()
        for batch in batches:
            keys = batch.column(0).to_pylist()
            found = []
            for key, own, other in zip(
                keys, W.text_buffers(batch.column(2)), W.text_buffers(batch.column(3)), strict=True
            ):
                if key not in heads:
                    heads[key] = weigh(own, shared.value)
                    if len(heads) > 16:
                        heads.popitem(last=False)
                found.append(weighted_jaccard(heads[key], weigh(other, shared.value)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, type=pa.float64())], ["head", "member", "similarity"]
            )

    return rows.mapInArrow(run, "head long, member long, similarity double")


def similar_to(
    own: tuple[np.ndarray, np.ndarray], others: list[tuple[np.ndarray, np.ndarray]], similarity: float
) -> np.ndarray:
    """Which of ``others`` have that ``weighted_jaccard`` with ``own`` or more; none is without shingles."""
    sizes = np.array([len(shingles) for shingles, _ in others])
    shingles, weights = (np.concatenate(parts) for parts in zip(*others, strict=True))
    starts = np.append(0, np.cumsum(sizes)[:-1])
    at = np.minimum(np.searchsorted(own[0], shingles), len(own[0]) - 1)
    common = np.add.reduceat(np.where(own[0][at] == shingles, np.minimum(own[1][at], weights), 0.0), starts)
    found = common / (own[1].sum(dtype=np.float64) + np.add.reduceat(weights.astype(np.float64), starts) - common)
    # Sums in another order differ in their last digits.
    for i in np.flatnonzero(np.abs(found - similarity) < 1e-6).tolist():
        found[i] = weighted_jaccard(own, others[i])
    return found >= similarity


def _connecting(idf: Broadcast, similarity: float) -> Callable[[pa.Table], pa.Table]:
    """For a group: links between its components, enough of them to connect what its promising pairs connect."""

    def run(group: pa.Table) -> pa.Table:
        order = np.argsort(group["_key"].to_numpy(), kind="stable")
        keys, blocks = group["_key"].to_numpy()[order], group["block"].to_numpy()[order]
        packed = np.frombuffer(b"".join(group["_samples"].to_pylist()), dtype="<u4").reshape(-1, HASHES)[order]
        component = np.unique(group["label"].to_numpy()[order], return_inverse=True)[1]
        across = group["low"][0].as_py() != group["high"][0].as_py()
        # The pairs of the largest component are brought by their other sides.
        largest = component == np.bincount(component).argmax()
        weighed: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def weights_of(i: int) -> tuple[np.ndarray, np.ndarray]:
            if i not in weighed:
                text = np.frombuffer(group["text"][int(order[i])].as_buffer(), dtype=np.uint8)
                weighed[i] = weigh(text, idf.value)
            return weighed[i]

        links = []
        for i in np.flatnonzero(~largest).tolist():
            fits = component != component[i]
            fits[: i + 1] &= largest[: i + 1]
            if across:
                fits &= blocks != blocks[i]
            others = np.flatnonzero(fits)
            agree = (packed[others] == packed[i]).sum(axis=1)
            others, agree = others[agree >= AGREE], agree[agree >= AGREE]
            others = others[np.argsort(-agree, kind="stable")]
            while len(others):
                now, others = others[:STEP], others[STEP:]
                alike = similar_to(weights_of(i), [weights_of(j) for j in now.tolist()], similarity)
                for j in now[alike].tolist():
                    if component[j] != component[i]:
                        links.append((keys[min(i, j)], keys[max(i, j)]))
                        component[component == component[j]] = component[i]
                others = others[component[others] != component[i]]
        heads, members = np.array(links, dtype=np.int64).reshape(-1, 2).T
        return pa.table({"head": heads, "member": members})

    return run


def _rarest(wide: DataFrame) -> DataFrame:
    """(bucket, _key): groups by the PREFIX rarest samples of each text of ``wide`` (_key, _samples)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.arange(HASHES, dtype=np.int64) << 32
        for batch in batches:
            packed = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype="<u4").reshape(-1, HASHES)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(np.repeat(np.arange(len(packed)), HASHES))), pa.array((packed + place).ravel())],
                ["_key", "sample"],
            )

    drawn = cut_lineage(wide.select("_key", "_samples").mapInArrow(run, "_key long, sample long"))
    # Written first, so that the join can be split at a sample that very many texts have.
    counts = cut_lineage(drawn.groupBy("sample").agg(F.count("*").alias("n")))
    ordered = F.array_sort(F.collect_list(F.struct("n", "sample")))
    rare = drawn.join(counts, "sample").groupBy("_key").agg(F.slice(ordered, 1, PREFIX).alias("rare"))
    return rare.select(F.explode("rare").alias("at"), "_key").where("at.n > 1").select(
        F.xxhash64("at.sample").alias("bucket"), "_key"
    )


def _mixed(groups: DataFrame, texts: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of groups (bucket, _key) with texts of several components, with their label and in how
    many ``blocks`` the group has to be dealt. Of groups of the same texts one is left."""
    marks = texts.select("_key", "size").join(labels.withColumnRenamed("node", "_key"), "_key", "left")
    own = cut_lineage(groups.join(marks, "_key").withColumn("label", F.coalesce("label", "_key")))
    same = ["n", "bytes", "least", "last", "mark"]
    sizes = own.groupBy("bucket").agg(
        F.count("*").alias("n"), F.sum("size").alias("bytes"), F.min("label").alias("least"), F.max("label").alias("last"),
        F.bit_xor(F.xxhash64("_key")).alias("mark"),
    )
    several = sizes.where("least <> last").groupBy(*same).agg(F.min("bucket").alias("bucket"))
    by_number = F.when(F.col("n") > GROUP, F.ceil(F.col("n") * 2 / GROUP)).otherwise(1)
    by_bytes = F.when((F.col("bytes") > GROUP_BYTES) & (F.col("n") > 2), F.ceil(F.col("bytes") * 2 / GROUP_BYTES)).otherwise(1)
    blocks = F.least(F.greatest(by_number, by_bytes), "n").alias("blocks")
    return own.join(cut_lineage(several.select("bucket", "n", blocks)), "bucket")


def _links_within(mixed: DataFrame, texts: DataFrame, idf: np.ndarray, similarity: float, across: bool) -> DataFrame:
    """(head, member): links between components of the blocks of each group (``across``: of each two blocks)."""
    shared = mixed.sparkSession.sparkContext.broadcast(idf)
    dealt = mixed.withColumn("block", F.pmod(F.xxhash64(F.lit(5), "_key"), F.col("blocks")))
    if across:
        dealt = dealt.where("blocks > 1").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        dealt = dealt.where("block <> other")
    else:
        dealt = dealt.withColumn("other", F.col("block"))
    dealt = dealt.select(
        "bucket", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "_key", "label"
    )
    met = cut_lineage(dealt).join(texts.select("_key", "_samples", "text"), "_key")
    return cut_lineage(
        met.groupBy("bucket", "low", "high").applyInArrow(_connecting(shared, similarity), "head long, member long")
    )


def _groups(met: DataFrame, texts: DataFrame, labels: DataFrame) -> DataFrame:
    """(bucket, _key): groups in which every promising pair of a bucket of ``met`` meets."""
    mixed = cut_lineage(_mixed(met.select("bucket", "_key"), texts, labels))
    # Of two texts one was the head.
    groups = mixed.where(F.col("n").between(3, GROUP)).select("bucket", "_key")
    large = mixed.where(F.col("n") > GROUP)
    if large.isEmpty():
        return groups
    wide = texts.select("_key", "_samples").join(large.select("_key").distinct(), "_key", "left_semi")
    return cut_lineage(groups.unionByName(_rarest(wide)))


def links(signed: DataFrame, docs: DataFrame, idf: np.ndarray, similarity: float = SIMILARITY) -> DataFrame:
    """(head, member) text keys of similar texts, enough of them to connect every class.

    ``signed`` has _key, _bands and _samples, ``docs`` _key and text.
    """
    nodes = signed.where("_bands IS NOT NULL").groupBy("_key").agg(
        F.first("_bands").alias("_bands"), F.first("_samples").alias("_samples")
    )
    rows = nodes.select("_key", F.explode("_bands").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    met = cut_lineage(rows.join(shared, "bucket"))
    degrees = met.groupBy("_key").agg(F.sum("n").alias("degree"))
    ranked = met.join(degrees, "_key").withColumn("order", F.struct(-F.col("degree"), "_key"))
    heads = ranked.groupBy("bucket").agg(F.min("order")["_key"].alias("head"))
    starred = cut_lineage(met.join(heads, "bucket").select("bucket", F.col("_key").alias("member"), "head"))
    starred = starred.where("member <> head")
    needed = broadcast_if_small(cut_lineage(met.select("_key").distinct()))
    texts = docs.select("_key", "text").join(needed, "_key", "left_semi").dropDuplicates(["_key"])
    texts = texts.join(nodes.select("_key", "_samples"), "_key").withColumn("size", F.octet_length("text").cast("long"))
    texts = cut_lineage(texts)

    seen = compare(starred.select("head", "member").distinct(), texts, idf)
    edges = cut_lineage(seen.where(F.col("similarity") >= similarity).select("head", "member"))
    labels = components(edges)
    groups = _groups(met, texts, labels)
    mixed = cut_lineage(_mixed(groups, texts, labels))
    edges = edges.unionByName(_links_within(mixed, texts, idf, similarity, across=False))
    if not mixed.where("blocks > 1").isEmpty():
        mixed = _mixed(groups, texts, components(edges))
        edges = edges.unionByName(_links_within(mixed, texts, idf, similarity, across=True))
    return edges


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of the component of each node of ``edges`` (head, member)."""
    both = cut_lineage(
        edges.select(F.col("head").alias("a"), F.col("member").alias("b"))
        .union(edges.select(F.col("member").alias("a"), F.col("head").alias("b")))
        .distinct()
    )
    labels = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select(
        "node", F.least("node", "b").alias("label")
    ))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("near")), "b")
        least = near.groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        hop = labels.select(F.col("node").alias("label"), F.col("label").alias("hop"))
        moved = cut_lineage(
            labels.join(least, "node")
            .join(hop, "label")
            .select("node", F.least("label", "near", "hop").alias("label"), F.col("label").alias("before"))
        )
        labels = moved.select("node", "label")
        if moved.where("label <> before").isEmpty():
            return labels


def classes(docs: DataFrame, keep: list[str], similarity: float = SIMILARITY) -> DataFrame:
    """The columns ``keep`` of every row of ``docs`` (``_row``: its number in the scan), with

    ``class_id``: smallest doc_id of the class (the row's own without words), ``class_size``:
    rows in it, and ``first``: true for one row of each class, of the smallest doc_id.
    """
    rows = docs.withColumn("_key", text_key(docs["text"])).withColumn("_row", F.monotonically_increasing_id())
    frequency, n = document_frequency(docs)
    idf = inverse_frequency(frequency, n)
    # The row number comes back with the columns of the table that is written here.
    signed = cut_lineage(signatures(rows.select(*dict.fromkeys(["doc_id", "text", *keep, "_key", "_row"])), idf))
    labels = components(links(signed, rows, idf, similarity))
    # Without words a row is on its own; with equal words it is at least with its copies.
    labels = labels.select(F.col("node").alias("_node"), F.col("label").alias("_label"))
    lone = F.col("_bands").isNull()
    placed = (
        signed.drop("_samples").join(labels, F.col("_key") == F.col("_node"), "left")
        .withColumn("_alone", F.when(lone, F.col("_row")))
        .withColumn("_class", F.when(~lone, F.coalesce("_label", "_key")))
    )
    smallest = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col("_row").alias("row")))
    # Rows of one text first, then texts of one class: a large class is summed up before it meets.
    of_class = placed.where(~lone).groupBy("_class").agg(smallest.alias("_first"), F.count("*").alias("_n"))
    # Written first, so that the join below can be split at a large class.
    of_class = cut_lineage(of_class.withColumnRenamed("_class", "_its_class"))
    joined = placed.join(of_class, F.col("_class") == F.col("_its_class"), "left")
    return joined.select(
        *keep,
        F.when(lone, F.col("doc_id")).otherwise(F.col("_first.doc_id")).alias("class_id"),
        F.coalesce("_n", F.lit(1)).alias("class_size"),
        F.when(lone, True).otherwise(F.col("_first.row") == F.col("_row")).alias("first"),
    )
