"""SimHash near-duplicates found through Golay-code keys.

Fingerprint: 64 bits over the XXH64 values of word shingles. The 64 bits are cut into segments of 23, 23 and 18
bits. The (23, 12) binary Golay code is perfect: every 23-bit word lies within 3 bits of exactly one codeword, and
the codewords within 4 bits number one (or six, when the nearest is 3 bits away). Two words that differ in at most
2 bits always share one of these codewords: one that lies within 3 bits of the word midway lies within 4 of both.

Keys: with at most 2 differing bits over three segments, at least one segment is free of errors (pigeonhole) and the
next one has at most 2. A key is therefore one segment as it is, with the index of a nearby codeword of the next: at
most 18 keys a fingerprint, and no pair within 2 bits is missed. Pairs that share a key are verified on all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendwise.llm.common import fresh, small_batches, written
from lendwise.llm.components import connected_components

SEGMENTS = ((0, 23), (23, 23), (46, 18))
MAX_DISTANCE = 2  # the distance the keys are built for
GOLAY_GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1: a fixed value of the code
_CHUNK = 65536


def _remainder(words: np.ndarray) -> np.ndarray:
    """The syndrome: 23-bit polynomials modulo the generator."""
    rest = words.astype(np.int64)
    for bit in range(22, 10, -1):
        rest = np.where((rest >> bit) & 1, rest ^ (GOLAY_GENERATOR << (bit - 11)), rest)
    return rest


def _build_masks() -> np.ndarray:
    """For every syndrome the XOR masks that take a word to its codewords within 4 bits (-1: none)."""
    bits = [1 << i for i in range(23)]
    errors = [0, *bits]
    errors += [bits[i] | bits[j] for i in range(23) for j in range(i)]
    errors += [bits[i] | bits[j] | bits[k] for i in range(23) for j in range(i) for k in range(j)]
    errors = np.array(errors, dtype=np.int64)
    nearest = np.full(2048, -1, dtype=np.int64)
    nearest[_remainder(errors)] = errors
    messages = np.arange(4096, dtype=np.int64) << 11
    codewords = messages ^ _remainder(messages)
    light = codewords[[bin(int(c)).count("1") == 7 for c in codewords]]
    masks = np.full((2048, 6), -1, dtype=np.int64)
    masks[:, 0] = nearest
    for syndrome, error in enumerate(nearest):
        if bin(int(error)).count("1") == 3:
            masks[syndrome, 1:] = light[(light & error) == error] ^ error
    return masks


_MASKS = _build_masks()


def nearby_codewords(words: np.ndarray) -> np.ndarray:
    """12-bit indices of the codewords within 4 bits of each 23-bit word; -1 fills rows with fewer than six."""
    words = words.astype(np.int64)
    masks = _MASKS[_remainder(words)]
    return np.where(masks < 0, -1, (words[:, None] ^ masks) >> 11)


def golay_keys(fingerprints: np.ndarray) -> np.ndarray:
    """Join keys of each 64-bit fingerprint (18 columns, -1 where there is none)."""
    value = fingerprints.astype(np.uint64)
    parts = [((value >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in SEGMENTS]
    near = [nearby_codewords(p) for p in parts]
    keys = []
    for i, part in enumerate(parts):
        fuzzy = near[(i + 1) % len(parts)]
        keys.append(np.where(fuzzy < 0, -1, (i << 40) | (part[:, None] << 12) | fuzzy))
    return np.concatenate(keys, axis=1)


def simhash64(text: str | None, shingle: int = 3) -> int:
    """Fingerprint of one text as a signed 64-bit integer; 0 for a text without words."""
    if not text:
        return 0
    # bytes.lower and bytes.split take exactly A-Z and the six ASCII white-space bytes
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    digest = xxhash.xxh64_digest
    if len(words) <= shingle:
        hashes = [digest(flat, 42)]
    else:
        starts, at = [], 0
        for word in words:
            starts.append(at)
            at += len(word) + 1
        ends = [s - 1 for s in starts[shingle:]] + [len(flat)]
        hashes = [digest(flat[a:b], 42) for a, b in zip(starts, ends)]
    ones = np.zeros(64, dtype=np.int64)
    for lo in range(0, len(hashes), _CHUNK):
        raw = np.frombuffer(b"".join(hashes[lo : lo + _CHUNK]), dtype=np.uint8)
        ones += np.unpackbits(raw).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes)).view(">i8")[0])


def fingerprint(text: Column, shingle: int = 3) -> Column:
    """The 64-bit fingerprint of a text column (bigint)."""

    @F.pandas_udf("bigint")
    def compute(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([simhash64(t, shingle) for t in batch], dtype="int64")

    return compute(text)


def _with_keys(prints: DataFrame) -> DataFrame:
    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            value = batch["fp"].to_numpy(dtype=np.int64)
            keys = golay_keys(value.view(np.uint64))
            row, col = np.nonzero(keys >= 0)
            yield pd.DataFrame({"key": keys[row, col], "fp": value[row]})

    return prints.mapInPandas(explode, "key bigint, fp bigint")


def near_fingerprints(prints: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints ``fp`` that differ in at most ``max_distance`` bits.

    A link may come up under several keys; it is returned once. A fingerprint has at most 2,080 others within 2
    bits, so links grow with the fingerprints, not with their square.
    """
    if not 0 <= max_distance <= MAX_DISTANCE:
        raise ValueError(f"the keys are built for 0 to {MAX_DISTANCE} differing bits")
    keyed = _with_keys(prints)
    left, right = keyed.withColumnRenamed("fp", "a"), keyed.withColumnRenamed("fp", "b")
    close = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_distance)
    return left.join(right, "key").where(close).select("a", "b").distinct()


def simhash_groups(prints: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """``prints(doc_id, fp)`` → ``(fp, component_id)``: the smallest doc_id reachable from each fingerprint.

    Documents with one fingerprint are one class (they differ in no bit), so only classes are joined, and copies are
    never expanded into pairs. A class whose documents all lack an id has a null component_id unless it is linked.
    """
    classes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "classes")
    member = connected_components(near_fingerprints(classes.select("fp"), max_distance))
    named = classes.join(member, classes["fp"] == member["node"], "left").select(
        "fp", "doc_id", F.coalesce("component", "fp").alias("component")
    )
    smallest = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return named.select("fp", "component").join(smallest, "component").select("fp", "component_id")


def simhash_near_duplicates(docs: DataFrame, shingle: int = 3, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """Each row's ``doc_id``, ``fingerprint`` (16 lowercase hex digits) and ``component_id`` (smallest doc_id reachable).

    A null or word-less text has fingerprint zero and is linked like any other; repeated rows and equal texts share a
    fingerprint; rows without doc_id are grouped but never name a group. Other columns are not read. An empty table
    gives an empty result.
    """
    small_batches(docs.sparkSession)
    prints = written(docs.select("doc_id", fingerprint(F.col("text"), shingle).alias("fp")), "prints")
    groups = simhash_groups(prints, max_distance)
    return prints.join(groups, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one_per_group(docs: DataFrame, shingle: int = 3, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """``docs`` (all columns) with the document of smallest doc_id of every near-duplicate group.

    A single copy stays even if that document's row is repeated. A group in which no row has an id keeps one row.
    """
    small_batches(docs.sparkSession)
    fp, row = fresh(docs, "fp"), fresh(docs, "row")
    marked = written(
        docs.withColumn(fp, fingerprint(F.col("text"), shingle)).withColumn(row, F.monotonically_increasing_id()),
        "marked",
    )
    groups = simhash_groups(marked.select("doc_id", F.col(fp).alias("fp")), max_distance)
    # the first row of each fingerprint is picked before groups meet, so a hot group shrinks to its fingerprints
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.col(row).alias("row"))
    firsts = marked.groupBy(F.col(fp).alias("fp")).agg(F.min(order).alias("first"))
    unnamed = F.when(F.col("component_id").isNull(), F.col("fp"))
    keep = firsts.join(groups, "fp").groupBy("component_id", unnamed.alias("unnamed")).agg(F.min("first").alias("first"))
    return marked.join(keep.select(F.col("first.row").alias(row)), row, "left_semi").drop(fp, row)
