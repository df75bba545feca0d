"""Operators 11 to 13 against brute force, with nulls, ties, repeats, empty tables and clashing columns."""

import hashlib
import random
import re
import zlib
from heapq import heappop, heappush

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from lendwise.llm import byte_bpe as BB
from lendwise.llm import conversation_repair as CR
from lendwise.llm import hard_negatives as HN
from lendwise.llm import queries as Q


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


# --- 11 hard negatives ----------------------------------------------------------------------------


VECTORS = "vec_id bigint, embedding array<double>, label int, key string, shard int"


def mined(rows, anchor_ids, positives=5, negatives=3):
    """Every anchor against every row, in Python integers."""
    usable = {(i, tuple(int(np.floor(256 * x)) for x in v), label) for i, v, label in rows
              if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    out = set()
    for i, v, label in usable:
        if i not in anchor_ids:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, other) for j, w, other in usable if j != i and len(w) == len(v))
        for p, j, _ in [s for s in scored if s[2] == label][:positives]:
            fits = [s for s in scored if s[2] != label and 50 * -p <= 100 * -s[0] <= 95 * -p][:negatives]
            out |= {(i, j, rank, n, -p, -s) for rank, (s, n, _) in enumerate(fits, 1)}
    return out


def got_mined(frame, anchor_ids, **options):
    found = HN.mine_hard_negatives(frame, frame.where(F.col("vec_id").isin(*anchor_ids)), **options)
    rows = [(r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in found.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_hard_negatives_against_brute_force(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(6, 8))
    rows = []
    for i in range(900):
        v = centres[i % 6] + rng.normal(size=8) * rng.choice([0.05, 0.6, 3.0])
        rows.append((i, [float(x) for x in v], int(rng.integers(0, 4)) if i % 3 else 0))
    rows += [(1000 + i, rows[1][1], rows[1][2]) for i in range(90)]  # copies: ties of every score
    rows += [rows[0], (2000, None, 1), (2001, [], 1), (2002, [1.0, None], 1), (2003, [float("nan")] * 8, 1),
             (2004, [1.0] * 8, None), (None, [1.0] * 8, 1), (2005, [0.0] * 8, 1), (2006, [1.0, 2.0], 1), (2007, [1.0, 1.0], 2),
             (2008, [2.0, 1.5], 1), (2009, [-1.0] * 8, 3), (2010, [0.0] * 8, 2)]
    anchors = [*range(0, 900, 30), 1003, 2002, 2003, 2004, 2005, 2006, 2009]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], VECTORS)
    expect = mined(rows, set(anchors))
    assert len(expect) > 200
    assert got_mined(frame, anchors, shard_components=2000) == expect == got_mined(frame, anchors)
    assert got_mined(frame.limit(0), [1]) == set()


def test_cover_tree_covers_and_finds_windows():
    rng = np.random.default_rng(9)
    values = np.floor(rng.normal(size=(1500, 5)) * 40)
    values[:200] = values[0]
    ids = rng.permutation(1500)
    tree = HN.CoverTree(ids, values)

    def rows_below(node):
        if tree.leaf[node]:
            return list(tree.below[node])
        return [r for child in tree.below[node] for r in rows_below(child)]

    assert sorted(rows_below(0)) == list(range(1500))
    for node in range(len(tree.leaf)):
        spread = values[rows_below(node)] - values[tree.centre[node]]
        assert np.sqrt((spread**2).sum(axis=1)).max() <= tree.radius[node] + 1e-9
    for _ in range(40):
        query = np.floor(rng.normal(size=5) * 30)
        scores = values @ query
        low, high = sorted(rng.integers(-8000, 8000, 2).tolist())
        expect = sorted((-int(s), int(i)) for s, i in zip(scores, ids) if low <= s <= high and i != 7)[:4]
        assert [(-s, i) for s, i in HN.best_rows([tree], 7, query, 4, low, high)] == expect


def test_search_keeps_only_nodes_that_can_matter(monkeypatch):
    """Points far apart are all children of the root; each search used to queue every one of them."""
    rng = np.random.default_rng(10)
    values = np.floor(rng.normal(size=(3000, 64)) * 32)
    values[5] = values[4]
    ids = rng.permutation(3000)
    trees = [HN.CoverTree(ids[at::3], values[at::3]) for at in range(3)]
    queued, push = [], HN.heapq.heappush
    monkeypatch.setattr(HN.heapq, "heappush", lambda heap, entry: (queued.append(entry), push(heap, entry)))
    searches = 0
    for n in range(0, 3000, 100):
        scores, opened = values @ values[n], {}
        for low, high in ((-np.inf, np.inf), (14000, 20000), (-3000, 1500)):
            expect = sorted((-int(s), int(i)) for s, i in zip(scores, ids) if low <= s <= high and i != ids[n])[:5]
            assert [(-s, i) for s, i in HN.best_rows(trees, int(ids[n]), values[n], 5, low, high, opened)] == expect
            searches += 1
    assert len(queued) < 100 * searches


def test_cover_tree_of_points_closer_than_rounding():
    """Distances that products of large numbers cannot tell are taken from the differences."""
    rng = np.random.default_rng(11)
    values = 2.0**31 + np.floor(rng.normal(size=(400, 3)) * 20)
    values[:100] = values[0]
    tree = HN.CoverTree(np.arange(400), values)
    query = np.array([2.0, -1.0, -1.0])
    expect = sorted((-int(s), i) for i, s in enumerate(values @ query))[:7]
    assert [(-s, i) for s, i in HN.best_rows([tree], -1, query, 7)] == expect


def test_scores_beyond_doubles_are_exact():
    values = np.array([[2.0**31, 3.0], [2.0**31, 4.0]])
    tree = HN.CoverTree(np.array([1, 2]), values)
    assert HN.best_rows([tree], 9, np.array([2.0**31, 1.0]), 2) == [(2**62 + 4, 2), (2**62 + 3, 1)]
    with pytest.raises(OverflowError):
        HN.best_rows([tree], 9, np.array([2.0**33, 1.0]), 2)
    assert [HN.window_of(s, 50, 95) for s in (100, 3, 0)] == [(50, 95), (2, 2), (0, 0)]
    low, high = HN.window_of(-10, 50, 95)
    assert low > high


# --- 12 conversation repair ----------------------------------------------------------------------


def cheapest(codes):
    """Uniform-cost search over (cost, edits): the cheapest, of these the first in ASCII order."""
    queue, done = [(0, "", 0, CR.START)], set()
    while queue:
        cost, edits, row, last = heappop(queue)
        if row == len(codes) and last in CR.FINAL:
            return cost, edits
        if (row, last) in done:
            continue
        done.add((row, last))
        write = CR.WRITES[last]
        heappush(queue, (cost + 3, edits + "I", row, write))
        if row < len(codes):
            fault, initial = codes[row] >> 2, codes[row] & 3
            heappush(queue, (cost + 4, edits + "D", row + 1, last))
            if fault != CR.GONE:
                add = 3 if fault == CR.CUT else 0
                heappush(queue, (cost + 3 + add, edits + "R", row + 1, write))
                if initial in CR.FOLLOWS[last]:
                    heappush(queue, (cost + add, edits + "K", row + 1, initial))


def test_cheapest_edits_against_uniform_cost_search():
    rng = random.Random(2)
    for _ in range(3000):
        n = rng.choice([0, 1, 2, 3, 5, 8, 13, 40, 100])
        roles, faults = rng.choice([[0, 1, 2, 3], [1, 2], [1, 1, 2]]), rng.choice([[0, 0, 1, 2], [0], [1, 1, 1, 0]])
        codes = bytes(rng.choice(roles) + 4 * rng.choice(faults) for _ in range(n))
        assert CR.cheapest_edits(codes) == cheapest(codes)
    for codes in (bytes([CR.USER + 4 * CR.CUT] * 30_000), bytes(rng.randrange(12) for _ in range(30_000))):
        cost, edits = CR.cheapest_edits(codes)
        assert len(edits) - edits.count("I") == len(codes) and cost > 0


CONVERSATIONS = "conv_id bigint, turn bigint, role string, text string, place int, part string"


def repaired(rows):
    """Contract of the query for one conversation, row by row."""
    space = lambda x: " " if x is None else str(x)
    seen, codes, counts, messages = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0), []
    for conv, turn, role, text in rows:
        code = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        role, text = space(role), space(text)
        if code:
            text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
            messages += [(turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    messages.sort(key=lambda m: (m[0] is not None, m[0] or 0))
    for _, role, text in messages:
        ends = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not ends else "duplicate" if (role, text) in seen else "truncated" if ends[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        initial = {"s": CR.SYSTEM, "u": CR.USER, "a": CR.ASSISTANT}.get(role[:1], CR.OTHER)
        codes.append(initial + 4 * {"blank": CR.GONE, "duplicate": CR.GONE, "truncated": CR.CUT, None: CR.SOUND}[fault])
    turns = [m[0] for m in messages if m[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(messages, messages[1:]))
    cost, audit = cheapest(codes)
    out, left = [], list(messages)
    for edit in audit:
        role = "assistant" if out and out[-1][0][:1] == "u" else "user"
        if edit == "I":
            out.append((role, ""))
            continue
        message = left.pop(0)
        if edit != "D":
            out.append((message[1] if edit == "K" else role, message[2]))
    assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in out))
    digest = sha("\n".join(f"{r}:{t}" for r, t in out).encode())
    return gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, digest


@pytest.fixture(scope="module")
def conversations(spark, tmp_path_factory):
    rng = random.Random(5)
    rows = []
    for conv in [*range(60), None, -3]:
        for turn in range(rng.choice([1, 2, 4, 9])):
            role = rng.choice(["user", "assistant", "assistant", "user", "system", "tool", "User", "", None, "ua"])
            text = rng.choice(["Hello there.", "Yes", "no \u0085", "Is it?  \n\t", "", "  ", "\x1c", " ", None, f"own {conv} {turn}!"])
            rows.append((conv, rng.choice([turn, turn, turn * 3]) if turn else rng.choice([0, None]), role, text))
    rows += [(100, t, "user" if t % 2 else "assistant", f"Text {t // 5}.") for t in range(500)]  # one long conversation
    path = str(tmp_path_factory.mktemp("conversations"))
    # one row a turn: which of two rows of a turn stands first is this library's own choice
    rows = list({(r[0], r[1]): r for r in rows}.values())
    spark.createDataFrame([(*r, 1, "x") for r in rows], CONVERSATIONS).write.parquet(f"{path}/conversations.parquet")
    return path, rows


def test_repair_query_against_brute_force(spark, conversations):
    path, rows = conversations
    by_conversation = {}
    for r in rows:
        by_conversation.setdefault(r[0], []).append(r)
    got = {r["conv_id"]: tuple(r)[1:] for r in Q.op12_conversation_repair(spark, path).collect()}
    assert got == {c: repaired(rs) for c, rs in by_conversation.items()}
    dropped = next(k for k in range(10_000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    one = spark.createDataFrame([(dropped, 0, "user", "Hi.", 1, "x")], CONVERSATIONS)
    one.write.mode("overwrite").parquet(f"{path}/gone/conversations.parquet")
    assert [tuple(r) for r in Q.op12_conversation_repair(spark, f"{path}/gone").collect()] == [
        (dropped, 0, 0, 0, 0, 0, 0, "", sha(b""))]
    one.limit(0).write.mode("overwrite").parquet(f"{path}/none/conversations.parquet")
    assert Q.op12_conversation_repair(spark, f"{path}/none").count() == 0


def test_repaired_messages(spark):
    rows = [(1, 0, "assistant", "Hm."), (1, 1, "user", "Hi."), (1, 1, "user", "Hi."), (1, 2, "assistant", "Cut"), (2, None, "user", None)]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], CONVERSATIONS)
    audits, messages = CR.repair_conversations(frame)
    assert {r["conv_id"]: (r["cost"], r["audit"]) for r in audits.collect()} == {1: (10, "IKKDK"), 2: (4, "D")}
    assert [(r["place"], r["edit"], r["role"], r["text"]) for r in sorted(messages.collect(), key=lambda r: r["place"])] == [
        (0, "I", "user", ""), (1, "K", "assistant", "Hm."), (2, "K", "user", "Hi."), (3, "K", "assistant", "Cut")]


# --- 13 byte-level BPE ------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def bpe():
    ranks = BB.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return BB.ByteBpe(ranks, public_tokenizers.PATTERN), library


def ids_of(bpe, texts):
    return [np.frombuffer(i, dtype="<i4").tolist() for i in bpe.encode(texts)]


def test_ids_are_those_of_the_library(bpe):
    ours, library = bpe
    rng = random.Random(1)
    texts = ["", " ", "\n\n  x", "<|endoftext|> it's", "a" * 5000, "\u0085   x\x1c\x1d y"]
    texts += ["".join(rng.choice("aaabc  \n\t'stve019!é漢̀🙂\x00") for _ in range(rng.choice([1, 5, 30, 400]))) for _ in range(600)]
    texts += ["".join(rng.choice("ab") for _ in range(100_000)), "".join(rng.choice("abcdefgh xyz") for _ in range(300_000))]
    texts += ["".join(f"a{chr(c)} 1{chr(c)}" for c in range(lo, lo + 1500, 7) if not 0xD800 <= c <= 0xDFFF) for lo in range(0, 0x20000, 1500)]
    assert ids_of(ours, texts) == [library.encode_ordinary(t) for t in texts]


def test_blocks_of_a_long_text(bpe, monkeypatch):
    ours, library = bpe
    monkeypatch.setattr(BB, "BLOCK_CHARS", 100)
    monkeypatch.setattr(BB, "BLOCK_PIECES", 7)
    monkeypatch.setattr(BB, "CACHE_PIECES", 5)
    texts = ["one two  three\n\n four five " * 40, "short", "x" * 1000, ""]
    assert ids_of(ours, texts) == [library.encode_ordinary(t) for t in texts]


def test_rank_order_where_a_merge_makes_a_lower_pair():
    ranks = {bytes([b]): b for b in range(256)} | {b"bc": 300, b"abc": 260, b"abcd": 290, b"cd": 310, b"aa": 270, b"aaa": 265}
    library = tiktoken.Encoding("own", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
    ours, rng = BB.ByteBpe(ranks, r"\S+"), random.Random(3)
    texts = ["".join(rng.choice("abcd ") for _ in range(rng.choice([3, 9, 60]))) for _ in range(800)]
    assert ids_of(ours, texts) == [library.encode_ordinary(t) for t in texts]


def test_rank_queue_gives_least_rank_and_leftmost_position():
    queue, rng, model = BB.RankQueue(300_000), random.Random(4), []
    for _ in range(4000):
        if model and rng.random() < 0.5:
            rank, position = heappop(model)
            assert queue.first() == rank and heappop(queue.buckets[rank]) == position
            if not queue.buckets[rank]:
                queue.remove(rank)
        else:
            entry = (rng.choice([rng.randrange(300_001), rng.randrange(9)]), rng.randrange(1000))
            heappush(model, entry)
            queue.push(*entry)


def test_bpe_query_and_odd_rows(spark, bpe, tmp_path):
    rows = [(1, None), (2, ""), (3, "Whole text, twice."), (3, "Whole text, twice."), (None, "no id\n"), (5, "long " * 60_000), (6, "漢字 🙂")]
    frame = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id bigint, text string, ids string, decoded string")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    expect = []
    for i, t in rows:
        ids = bpe[1].encode_ordinary(t or "")
        expect.append((i or 0, len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode())))
    got = [(r["doc_id"] or 0, *tuple(r)[1:]) for r in Q.op13_byte_bpe(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(expect)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = BB.encode_texts(frame, path, public_tokenizers.PATTERN).withColumn("Decoded", F.lit(1)).withColumn("extra", F.lit("e"))
    decoded = BB.decode_ids(encoded, path)
    assert decoded.columns == ["doc_id", "ids", "extra", "decoded"]
    assert sorted(bytes(r["decoded"]).decode() for r in decoded.collect()) == sorted(t or "" for _, t in rows)
    assert BB.encode_texts(frame.limit(0), path, public_tokenizers.PATTERN).count() == 0
    gaps = spark.createDataFrame([(1, None), (2, [])], "doc_id int, ids array<int>")
    assert [bytes(r["decoded"]) for r in BB.decode_ids(gaps, path).collect()] == [b"", b""]
