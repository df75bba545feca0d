"""Packing of token sequences: first-fit decreasing within randomised groups of pieces.

Documents are tokenised in batches on the executors; a document's ids are cut into pieces of at most one sequence,
pieces are dealt to groups at random (so that a long document or a hot id is spread), and every group is packed on
its own by first-fit decreasing over a tournament tree of bin capacities.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendwise.llm.common import resident, small_batches

SEQ_LEN = 2048
GROUP_PIECES = 4096
END_ID = 1
FLUSH_BYTES = 8 << 20
CACHE_WORDS = 400_000

PIECES = "doc_id {id}, start bigint, length bigint, ids binary, doc_tokens bigint"
#: What a vocabulary file must say for its texts to be encoded word by word, and characters that its normaliser only
#: lower-cases, with their letters and numbers: fixed values.
NORMALISERS = ["NFC", "Replace", "Lowercase"]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"
PLAIN = re.compile("[\x21-\x7e\xa1-\xac\xae-\xff]+")
LETTERS, NUMBERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
#: The pre-tokenizer's own pattern over lower-cased plain words, one word a line.
WORD_PARTS = re.compile(rf"\n|'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^\s{LETTERS}{NUMBERS}]+")
LINE_END = b"\xff" * 4  # no id
UNUSUAL = ("\x1c", "\x1d", "\x1e", "\x1f", "<|")  # white space to str.split alone, and special tokens' strings


def word_wise(path: str) -> bool:
    """Whether a vocabulary file cuts texts at white space and then by ``SPLIT``, in lower case, with marked word ends."""
    with open(path, encoding="utf-8") as file:
        told = json.load(file)
    normalisers = [n["type"] for n in (told["normalizer"] or {}).get("normalizers", [])]
    cuts = (told["pre_tokenizer"] or {}).get("pretokenizers", [])
    split = [(c["pattern"], c["behavior"], c["invert"]) for c in cuts if c["type"] == "Split"]
    levels = [(c["add_prefix_space"], c["use_regex"]) for c in cuts if c["type"] == "ByteLevel"]
    return (
        normalisers == NORMALISERS and split == [({"Regex": SPLIT}, "Removed", True)] and levels == [(False, False)]
        and len(cuts) == 2 and told["model"]["type"] == "BPE" and told["model"].get("end_of_word_suffix") == WORD_END
        and not told["model"].get("dropout")
    )


class WordTokenizer:
    """Ids of whole texts, as little-endian unsigned 32-bit bytes, by a tokenizer file of ``tokenizers``.

    Where the file is word-wise, a text's ids are those of its words, one after the other: words already met come from
    a bounded cache. New words of plain characters are cut into the pre-tokenizer's parts together, one word a line,
    and new parts go to the vocabulary's model together: a part's last token, and no other, bears the end-of-word
    mark. Texts of any other vocabulary go to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.word_wise = word_wise(path)
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {"\n": LINE_END}

    def _direct(self, texts: list[str]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in encoded]

    def _model_ids(self, parts: list[str]) -> list[bytes]:
        ids = np.array(self.model.encode_batch_fast([" ".join(parts)], add_special_tokens=False)[0].ids, dtype="<u4")
        cuts = [0, *((np.nonzero(self.ends[ids])[0] + 1) * 4).tolist()]
        if len(cuts) != len(parts) + 1:
            return self._direct(parts)
        raw = ids.tobytes()
        return [raw[lo:hi] for lo, hi in zip(cuts, cuts[1:])]

    def _learn(self, words: list[str]) -> None:
        plain = [word for word in words if PLAIN.fullmatch(word)]
        if plain:
            parts = WORD_PARTS.findall("\n".join(plain).lower() + "\n")
            new = list(set(parts).difference(self.parts))
            if new:
                self.parts.update(zip(new, self._model_ids(new)))
            raw = b"".join(map(self.parts.__getitem__, parts))
            stops = np.nonzero(np.frombuffer(raw, dtype="<u4") == 0xFFFFFFFF)[0] * 4
            starts = [0, *(stops[:-1] + 4).tolist()]
            self.words.update(zip(plain, [raw[lo:hi] for lo, hi in zip(starts, stops.tolist())]))
        rest = list(set(words).difference(plain)) if len(plain) < len(words) else []
        if rest:
            self.words.update(zip(rest, self._direct(rest)))

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.word_wise:
            return self._direct(texts)
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        if len(self.parts) > CACHE_WORDS:
            self.parts = {"\n": LINE_END}
        odd = [any(u in t for u in UNUSUAL) for t in texts]
        split = [[] if o else t.split() for t, o in zip(texts, odd)]
        unseen = set().union(*split).difference(self.words)
        if unseen:
            self._learn(list(unseen))
        get = self.words.__getitem__
        return [self._direct([t])[0] if o else b"".join(map(get, words)) for t, o, words in zip(texts, odd, split)]


def token_pieces(docs: DataFrame, tokenizer_path: str, seq_len: int = SEQ_LEN, end_id: int = END_ID) -> DataFrame:
    """Pieces ``(doc_id, start, length, ids, doc_tokens)`` of at most ``seq_len`` ids; a null text is empty."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = resident(("tokenizer", tokenizer_path), lambda: WordTokenizer(tokenizer_path))
        for batch in batches:
            row, start, ids, total, held = [], [], [], [], 0

            def flush():
                n = [len(i) // 4 for i in ids]
                return pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(start, pa.int64()),
                     pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(total, pa.int64())],
                    ["doc_id", "start", "length", "ids", "doc_tokens"],
                )

            texts = [t or "" for t in batch.column("text").to_pylist()]
            for at in range(0, len(texts), 64):
                for k, raw in enumerate(tokenizer.encode(texts[at : at + 64])):
                    raw += end
                    for lo in range(0, len(raw), 4 * seq_len):
                        row.append(at + k)
                        start.append(lo // 4)
                        ids.append(raw[lo : lo + 4 * seq_len])
                        total.append(len(raw) // 4)
                    held += len(raw)
                if held > FLUSH_BYTES:
                    yield flush()
                    row, start, ids, total, held = [], [], [], [], 0
            if row:
                yield flush()

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES.format(id=kind))


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item. A tournament tree holds the largest free capacity below each node, so the first
    bin that an item fits into is found on one path from the root."""
    n = len(lengths)
    width = 1
    while width < n:
        width *= 2
    tree = [capacity] * (2 * width)
    bins, offsets = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    for item in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[item])
        node = 1
        while node < width:
            node *= 2
            if tree[node] < size:
                node += 1
        bins[item], offsets[item] = node - width, capacity - tree[node]
        tree[node] -= size
        while node > 1:
            node //= 2
            largest = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == largest:
                break
            tree[node] = largest
    return bins, offsets


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    seq_len: int = SEQ_LEN,
    end_id: int = END_ID,
    group_pieces: int = GROUP_PIECES,
    seed: int = 7,
) -> DataFrame:
    """Pieces with their ids (little-endian unsigned 32-bit) and place: ``sequence_id`` and ``offset``.

    Every id of every document, and its end id, lies in exactly one piece; offsets leave no gap. Null and empty texts
    give a piece of the end id alone; repeated rows and null ids are packed as documents of their own; other columns
    are not read; an empty table gives an empty result. Groups hold about ``group_pieces`` pieces: their number
    follows from the bytes of text, which bound the tokens.
    """
    small_batches(docs.sparkSession)
    size = docs.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    groups = max(1, -(-(size["n"] + size["bytes"] // seq_len) // group_pieces))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def pack(table: pa.Table) -> pa.Table:
        bins, offsets = first_fit_decreasing(table.column("length").to_numpy(), seq_len)
        group = table.column("group").to_numpy()
        table = table.append_column("sequence_id", pa.array((group << 32) + bins, pa.int64()))
        return table.append_column("offset", pa.array(offsets, pa.int64())).drop_columns(["group"])

    dealt = token_pieces(docs, tokenizer_path, seq_len, end_id).withColumn(
        "group", F.pmod(F.xxhash64("doc_id", "start", F.monotonically_increasing_id(), F.lit(seed)), F.lit(groups))
    )
    return dealt.groupBy("group").applyInArrow(pack, PIECES.format(id=kind) + ", sequence_id bigint, offset bigint")
