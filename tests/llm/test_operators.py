"""Operators against brute force on small fixtures, with nulls, empty and long texts, ties, repeats and extra columns."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lendwise.llm import language_id as LI
from lendwise.llm import license_scan as LS
from lendwise.llm import line_dedup as LD
from lendwise.llm import maxscore as MX
from lendwise.llm import mixing as MI
from lendwise.llm import packing as PK
from lendwise.llm import page_text as PT
from lendwise.llm import simhash_golay as SG
from lendwise.llm import spherical_filters as SF
from lendwise.llm import toxicity_crf as TX
from lendwise.llm.components import connected_components

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, extra string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, rows):
    full = [(i, t, l, s, None if t is None else len(t), "x") for i, t, l, s in rows]
    return spark.createDataFrame(full, DOCS)


ODD = [
    (1, None, "en", "a"), (2, "", "en", None), (3, " \t\n", None, "b"), (4, "word", "en", "a"), (4, "word", "en", "a"),
    (None, "no id here at all", "en", "b"), (6, "123 !!! 456", None, "c"), (7, "long " * 30000, "en", "a"),
]


# --- components --------------------------------------------------------------------------------


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in range(100, 160)} == {100}
    assert got[200] == got[201] == 200 and len(got) == 41 + 60 + 2
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# --- 1 line dedup --------------------------------------------------------------------------------


def test_boilerplate_lines_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(120):
        own = [f"line {rng.integers(0, 60)}" if rng.random() < 0.5 else f"own {i} {k}" for k in range(6)]
        rows.append((i, "\n".join(own + ["  footer \t", ""]), "en", f"s{i % 7}" if i % 9 else None))
    rows += [(500, None, "en", "s1"), (501, "", "en", "s1"), (0, rows[0][1], "en", rows[0][3])]
    sites = {}
    for i, t, _, s in rows:
        for line in (t or "").split("\n"):
            if line.strip(LD.BLANK):
                sites.setdefault(line.strip(LD.BLANK), set()).add(s)
    wide = {x for x, s in sites.items() if len(s) >= 4}
    assert wide and len(wide) < len(sites)
    first = {}
    for i, t, _, _ in sorted(rows, key=lambda r: r[0]):
        for at, line in enumerate((t or "").split("\n")):
            first.setdefault(line.strip(LD.BLANK), (i, at))
    expect = []
    for i, t, _, _ in rows:
        kept = None if t is None else "\n".join(
            x for at, x in enumerate(t.split("\n")) if x.strip(LD.BLANK) not in wide or first[x.strip(LD.BLANK)] == (i, at))
        expect.append((i, kept))
    out = LD.remove_boilerplate_lines(docs(spark, rows), min_sites=4)
    assert out.columns[-1] == "lines_removed" and "extra" in out.columns
    assert sorted((r["doc_id"], r["text"] or "") for r in out.collect()) == sorted((i, t or "") for i, t in expect)
    assert out.where("text IS NULL").count() == 1
    gone = LD.remove_boilerplate_lines(docs(spark, rows), min_sites=4, keep_first=False)
    assert gone.where(F.col("text").contains("footer")).count() == 0


def test_line_dedup_odd_rows_and_empty_table(spark):
    frame = docs(spark, ODD).withColumn("lines_removed", F.lit("clash")).withColumn("_k1", F.lit(1))
    out = LD.remove_boilerplate_lines(frame, min_sites=2)
    assert out.count() == len(ODD) and out.where("lines_removed <> 0").count() == 0
    assert LD.remove_boilerplate_lines(docs(spark, ODD).limit(0)).count() == 0


# --- 2 language identification -------------------------------------------------------------------

LANGS = {
    "en": "the and with from that this have were which their would there could other about",
    "de": "der die und nicht eine wurde schon zwischen haben werden durch gegen auch sich",
    "ru": "это который было если только потому между через после когда также быть более",
}


def language_rows(n=240):
    rng = np.random.default_rng(1)
    names = list(LANGS)
    return [(i, " ".join(rng.choice(LANGS[names[i % 3]].split(), 12)), names[i % 3], "s") for i in range(n)]


def test_languages_of_held_out_rows(spark):
    rows = language_rows()
    got = {r["doc_id"]: r for r in LI.identify_languages(docs(spark, rows + [(1000 + i if i else None, t, None, s) for i, t, _, s in ODD])).collect()}
    for i, _, lang, _ in rows:
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
    held = [i for i, _, _, _ in rows if got[i]["held_out"]]
    assert held and all(got[i]["lang_pred"] == rows[i][2] for i in held)
    assert {got[1000 + i]["lang_pred"] for i in (1, 2, 3, 6)} == {"und"}
    assert all(0.0 <= r["score"] <= 1.0 for r in got.values())


def test_language_spans_of_mixed_text(spark):
    rows = language_rows()
    text = " ".join(LANGS["en"].split() * 2) + " " + " ".join(LANGS["de"].split() * 2) + " " + LANGS["ru"]
    out = LI.identify_languages(docs(spark, rows + [(900, text, None, "s")])).where("doc_id = 900").first()
    assert [s["lang"] for s in out["spans"]] == ["en", "de", "ru"]
    assert out["spans"][0]["start"] == 0 and out["spans"][-1]["end"] == len(text)
    assert text[out["spans"][1]["start"]:].startswith("der")


def test_label_words_equals_viterbi():
    rng = np.random.default_rng(0)
    for _ in range(300):
        scores = -rng.random((rng.integers(1, 30), 3)) * rng.choice([1.0, 6.0])
        a, b = LI.label_words(scores, 4.0), LI.viterbi(scores, 4.0)
        value = [scores[np.arange(len(p)), p].sum() - 4.0 * (np.diff(p) != 0).sum() for p in (a, b)]
        assert value[0] == pytest.approx(value[1])


def test_language_without_training_rows(spark):
    out = LI.identify_languages(docs(spark, [(1, "hello", None, "a")])).collect()
    assert [(r["lang_pred"], r["score"]) for r in out] == [("und", 0.0)]
    assert LI.identify_languages(docs(spark, ODD).limit(0)).count() == 0


# --- 3 license scans -------------------------------------------------------------------------------


def test_license_spans(spark):
    notice = LS.TEMPLATES["Apache-2.0-notice"]
    edited = LS.TEMPLATES["ISC"].replace("with or without fee", "for money or without any fee")
    rows = [(1, f"İntro {notice} end", "en", "a"), (2, f"x\n{edited}", "en", "a"), (3, "license version apache the", "en", "a"),
            (4, notice + " filler words " + notice, "en", "a"), *[(100 + i if i else None, t, l, s) for i, t, l, s in ODD]]
    got = [tuple(r) for r in LS.scan_licenses(docs(spark, rows)).collect()]
    text = dict((r[0], r[1]) for r in rows)
    assert ("Apache-2.0-notice", 1.0) in {(g[1], g[2]) for g in got if g[0] == 1}
    assert all(text[1][g[3]:g[4]] == notice.rstrip(".") for g in got if g[0] == 1)
    isc = [g for g in got if g[0] == 2]
    assert [g[1] for g in isc] == ["ISC"] and 0.9 < isc[0][2] < 1.0 and isc[0][3] == 2
    assert sum(g[0] == 4 and g[1] == "Apache-2.0-notice" for g in got) == 2
    assert {g[0] for g in got} == {1, 2, 4}
    assert LS.scan_licenses(docs(spark, ODD).limit(0)).count() == 0


def test_banded_alignment_against_full_table():
    rng = np.random.default_rng(2)

    def lcs(a, b):
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = max(table[i, j + 1], table[i + 1, j], table[i, j] + (x == y))
        return table[-1, -1]

    for _ in range(100):
        a = rng.integers(1, 6, 10)
        b = np.delete(a, rng.integers(0, 10, 2))
        pad = np.concatenate([np.full(5, 9), b, np.full(5, 9)])
        assert LS.align(a, pad, 5, 5)[0] == lcs(a, pad)


# --- 4 page text -------------------------------------------------------------------------------------


def test_main_text_of_pages(spark):
    article = "<article><h1>T &amp; U</h1><p>one <b>bo</b>ld<br>two <div class='ad'>buy</div><p>three&nbsp;x</article>"
    html = f"<html><head><title>no</title><style>p{{}}</style></head><body><nav>menu</nav>{article}<footer>f</footer><section id='comments'><article><p>me too</p></article></section></body>"
    plain = "<body><div>Site name</div><p>Body {0}.</p><p>More {0} words.</p><p>Third {0}</p><div>All rights</div></body>"
    rows = [(1, "http://a.com/x", html), (2, None, None), (3, "http://a.com/y", ""), (None, "http://a.com/z", "<p>cut &am <p cla"),
            (5, "http://b.com/p/1", plain.format("a")), (6, "http://b.com/p/2", plain.format("b")), (6, "http://b.com/p/2", plain.format("b")),
            (7, "http://[bad", "<nav>open<article><p>kept</p>"), (8, "http://c.com/", "<script>var t='</p>'</script>x < y")]
    pages = spark.createDataFrame([(*r, "e") for r in rows], "page_id bigint, url string, html string, gone string")
    got = {}
    for r in PT.extract_main_text(pages).collect():
        got.setdefault(r["page_id"], []).append(r["text"])
    assert got == {1: ["T & U one bold two three x"], 2: [""], 3: [""], None: ["cut &am"], 5: ["Body a. More a words. Third a"],
                   6: ["Body b. More b words. Third b"] * 2, 7: ["kept"], 8: ["x < y"]}
    assert PT.extract_main_text(pages.limit(0)).count() == 0


def test_common_lines_against_full_table():
    rng = np.random.default_rng(4)
    for _ in range(200):
        a, b = rng.integers(0, 5, rng.integers(0, 15)), rng.integers(0, 5, rng.integers(0, 15))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = max(table[i, j + 1], table[i + 1, j], table[i, j] + (x == y))
        found = PT.common_lines(a, b)
        assert len(found) == table[-1, -1]
        rest = iter(b.tolist())
        assert all(any(y == a[i] for y in rest) for i in found)  # a subsequence of both


# --- 5 spherical filters ---------------------------------------------------------------------------------


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "vec_id bigint, embedding array<float>, label int, cid string")


def test_near_vectors_against_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((60, 32))
    x = np.concatenate([base, base[:30] + 0.05 * rng.standard_normal((30, 32)), base[:20], np.repeat(base[:1], 40, axis=0) + 0.02 * rng.standard_normal((40, 32))])
    x = x.astype(np.float32)
    label = np.arange(len(x)) % 2 * 0
    label[70:80] = 1
    rows = [(i, x[i].tolist(), int(label[i])) for i in range(len(x))]
    odd = [(900, None, 0), (901, [0.0] * 32, 0), (902, [float("nan")] + [1.0] * 31, 0), (903, [None] + [1.0] * 31, 0),
           (904, x[0].tolist(), None), (None, x[0].tolist(), 0), (905, [1.0, 2.0], 0), rows[3]]
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    component = np.arange(len(x))
    for _ in range(len(x)):
        component = np.array([min([component[i], *component[near[i]]]) for i in range(len(x))])
    for block in (1024, 16):
        got = [r for r in SF.near_duplicate_vectors(vectors(spark, rows + odd), block=block).collect()]
        assert len(got) == len(rows) + len(odd)
        by = {r["vec_id"]: r for r in got if r["vec_id"] is not None}
        found = sum(by[i]["n_links"] for i in range(len(x)))
        assert found >= 0.95 * near.sum() and all(by[i]["n_links"] <= near[i].sum() for i in range(len(x)))
        assert sum(by[i]["component_id"] == component[i] for i in range(len(x))) >= 0.95 * len(x)
        assert all(by[i]["n_links"] == 0 and by[i]["kept"] for i in range(900, 906))
        (lost,) = [r for r in got if r["vec_id"] is None]
        assert lost["component_id"] is None and not lost["kept"] and lost["n_links"] == 0
    assert SF.near_duplicate_vectors(vectors(spark, rows).limit(0)).count() == 0


def test_list_decoding_against_all_directions():
    code = SF.ProductCode.design(16, 500, 0.93)
    rng = np.random.default_rng(0)
    x = rng.standard_normal((20, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    width = [len(w) for w in code.words]
    for v, got in zip(x, code.decode(x)):
        parts, at, v = [], 0, v @ code.rotation
        for w in code.words:
            parts.append(w @ v[at : at + w.shape[1]])
            at += w.shape[1]
        total = parts[0]
        for p in parts[1:]:
            total = (total[:, None] + p[None, :]).ravel()
        least = min(code.threshold, total.max() - 1e-12)
        assert got.tolist() == np.nonzero(total >= least)[0].tolist() and len(total) == np.prod(width) == code.directions


# --- 6 exact top-k ---------------------------------------------------------------------------------------------


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(6)
    x = np.round(rng.standard_normal((150, 12)), 1).astype(np.float32)
    x[40:60] = x[0]
    rows = [(i, x[i].tolist(), 0) for i in range(150)]
    odd = [(1000, None, 0), (1100, [None] * 12, 0), (1200, [float("inf")] * 12, 0), (None, x[0].tolist(), 0), rows[5], (1300, [1.0], 0)]
    frame = vectors(spark, rows + odd)
    got = MX.exact_top_k(frame, frame.where("vec_id % 10 = 0"), k=7, shard_rows=16, query_rows=4).collect()
    q = np.floor(1024 * x.astype(float)).astype(int)
    expect = []
    for i in range(0, 150, 10):
        s = q @ q[i]
        best = sorted((-s[j], j) for j in range(150) if j != i)[:7]
        expect += [(i, k + 1, j, -v) for k, (v, j) in enumerate(best)]
    assert sorted(tuple(r) for r in got) == sorted(expect)
    assert MX.exact_top_k(frame.limit(0), frame.limit(0)).count() == 0


# --- 7 packing ---------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    P = pytest.importorskip("public_tokenizers")
    return P.path("word_bpe_49k.json")


def test_packing_round_trip(spark, tokenizer):
    from tokenizers import Tokenizer

    texts = ["Hello, world's END!!", "naïve Œuvre Σας 漢字 é", "a\x1cb <|endoftext|> c", "x y ² ½ don't", "Straße ﬁ İstanbul"]
    rows = [(20 + i, t, "en", "a") for i, t in enumerate(texts)] + ODD
    packed = PK.pack_documents(docs(spark, rows), tokenizer, seq_len=64, group_pieces=50).collect()
    plain = Tokenizer.from_file(tokenizer)
    ids = {i: plain.encode(t or "", add_special_tokens=False).ids + [1] for i, t, _, _ in rows}
    count = {i: sum(r[0] == i for r in rows) for i in ids}
    total = {}
    for p in packed:
        own = np.frombuffer(p["ids"], dtype="<u4").tolist()
        assert own == ids[p["doc_id"]][p["start"] : p["start"] + p["length"]] and len(own) == p["length"]
        assert p["doc_tokens"] == len(ids[p["doc_id"]])
        total[p["doc_id"]] = total.get(p["doc_id"], 0) + p["length"]
    assert total == {i: len(x) * count[i] for i, x in ids.items()}
    sequences = {}
    for p in packed:
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    assert PK.pack_documents(docs(spark, ODD).limit(0), tokenizer).count() == 0


def test_first_fit_decreasing_against_plain_search():
    rng = np.random.default_rng(7)
    for _ in range(50):
        sizes = rng.integers(1, 101, rng.integers(1, 60))
        bins, offsets = PK.first_fit_decreasing(sizes, 100)
        free = []
        for i in np.argsort(-sizes, kind="stable"):
            at = next((k for k, f in enumerate(free) if f >= sizes[i]), len(free))
            if at == len(free):
                free.append(100)
            assert bins[i] == at and offsets[i] == 100 - free[at]
            free[at] -= sizes[i]


# --- 8 mixing -----------------------------------------------------------------------------------------------------------


def targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, target, rest = float(sum(sizes.values())), {}, set(names)
    while rest:
        share = sum(weight[s] for s in rest)
        over = [s for s in rest if left * weight[s] / share > most * sizes[s]]
        if not over:
            target |= {s: left * weight[s] / share for s in rest}
            break
        for s in over:
            target[s] = float(most * sizes[s])
        left -= sum(target[s] for s in over)
        rest -= set(over)
    return target


def mixed_rows():
    rng = np.random.default_rng(8)
    sources = ["a", "b", "c", "Ä", "z", None]
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 300))), "en", sources[int(rng.choice(6, p=[0.02, 0.5, 0.2, 0.2, 0.05, 0.03]))]) for i in range(400)]
    return rows + [(i, t, l, s) for i, t, l, s in ODD] + rows[:3]


def test_mixing_targets_and_limits(spark):
    rows = mixed_rows()
    frame = docs(spark, rows).withColumn("site", F.col("source"))
    out = MI.mix_sources(frame, ("doc_id", "site"), shard_slots=64).collect()
    assert len(out) == len(rows)
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    want, taken = targets(sizes), {s: 0 for s in sizes}
    for r in out:
        assert r["source_size"] == sizes[r["site"]] and r["target"] == pytest.approx(want[r["site"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["site"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(100, 0.01 * want[s])
    again = MI.mix_sources(frame.repartition(7), ("doc_id", "site"), shard_slots=64).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    assert MI.mix_sources(frame.limit(0)).count() == 0


def test_permutation_is_a_bijection(spark):
    for n in (1, 2, 7, 1000):
        df = spark.range(n).withColumn("n", F.lit(n).cast("bigint")).withColumn("k", F.lit(5))
        seen = [r["id"] for r in MI.permuted(df, "id", "n", [F.col("k")]).collect()]
        assert sorted(seen) == list(range(n))
    assert seen != list(range(1000))


def test_repeats_follow_the_mix(spark):
    rows = mixed_rows()
    frame = docs(spark, rows)
    out = MI.repeat_to_mix(frame)
    assert out.columns == frame.columns
    times = {}
    for r in out.collect():
        times[(r["doc_id"], r["text"])] = times.get((r["doc_id"], r["text"]), 0) + 1
    assert all(WORD.search(t) for _, t in times)
    counts = {}
    for i, t, _, _ in rows:
        counts[(i, t)] = counts.get((i, t), 0) + 1
    assert all(n <= 3 * counts[k] for k, n in times.items())
    assert MI.repeat_to_mix(frame.limit(0)).count() == 0


# --- 9 SimHash ------------------------------------------------------------------------------------------------------------


def test_golay_lists_meet_within_two_bits():
    rng = np.random.default_rng(9)
    words = rng.integers(0, 1 << 23, 300)
    own = SG.nearby_codewords(words)
    for i in range(23):
        for j in range(i + 1):
            other = SG.nearby_codewords(words ^ (1 << i) ^ (0 if i == j else 1 << j))
            assert all(set(a[a >= 0]) & set(b[b >= 0]) for a, b in zip(own, other))


def test_simhash_groups_against_brute_force(spark):
    rng = np.random.default_rng(10)
    base = rng.integers(0, 1 << 63, 80).astype(np.uint64)
    prints = [int(b) for b in base]
    for _ in range(400):
        flips = rng.choice(64, rng.integers(0, 4), replace=False)
        x = prints[int(rng.integers(0, len(prints)))]
        for f in flips:
            x ^= 1 << int(f)
        prints.append(x)
    frame = spark.createDataFrame([(i, x - (1 << 64) if x >> 63 else x) for i, x in enumerate(prints)], "doc_id bigint, fp bigint")
    got = {r["fp"] & ((1 << 64) - 1): r["component_id"] for r in SG.simhash_groups(frame).collect()}
    component = list(range(len(prints)))
    changed = True
    near = [[j for j in range(len(prints)) if bin(a ^ prints[j]).count("1") <= 2] for a in prints]
    while changed:
        new = [min(component[j] for j in near[i]) for i in range(len(prints))]
        changed, component = new != component, new
    assert [got[x] for x in prints] == component


def test_simhash_fingerprints_and_odd_rows(spark):
    import xxhash

    rows = ODD + [(30, "One two THREE fourÉ", "en", "a"), (31, "one two three fourÉ", "en", "b"), (32, "  x", "en", "b")]
    out = SG.simhash_near_duplicates(docs(spark, rows)).collect()
    got = {}
    for r in out:
        got.setdefault(r["doc_id"], []).append((r["fingerprint"], r["component_id"]))
    assert len(out) == len(rows)
    for i, t, _, _ in rows:
        words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        bits = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert {g[0] for g in got[i]} == {f"{bits:016x}"}
    assert got[1][0] == got[2][0] == got[3][0] == ("0" * 16, 1) and got[31][0][1] == 30
    kept = SG.keep_one_per_group(docs(spark, rows).withColumn("_fp", F.lit(1)))
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 4, 6, 7, 30, 32] and "_fp" in kept.columns
    assert SG.simhash_near_duplicates(docs(spark, ODD).limit(0)).count() == 0


# --- 10 toxicity -------------------------------------------------------------------------------------------------------------


def test_marginals_against_enumeration():
    import itertools

    rng = np.random.default_rng(11)
    unary, trans = rng.normal(size=(1, 6)) * 2, rng.normal(size=(2, 2))
    norm, expect = 0.0, np.zeros(6)
    for tags in itertools.product((0, 1), repeat=6):
        weight = np.exp(sum(unary[0, t] * tags[t] for t in range(6)) + sum(trans[tags[t], tags[t + 1]] for t in range(5)))
        norm, expect = norm + weight, expect + weight * np.array(tags)
    flat = np.concatenate([unary[0], unary[0]])
    assert np.allclose(TX.marginals(flat, np.array([6, 0, 6]), trans), np.tile(expect / norm, 2))
    assert np.allclose(-TX._log_likelihood_step(unary, np.zeros((1, 6)), trans)[0][0], expect / norm)


def test_toxic_documents_and_spans(spark):
    rng = np.random.default_rng(12)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne") for b in ("ra", "su", "ti", "vo", "we")]
    rows, labels = [], []
    for i in range(400):
        text = rng.choice(words, 30).tolist()
        if i % 4 == 0:
            for at in rng.choice(30, 3, replace=False):
                text[at] = ("badword", "vilething", "grotka" + rng.choice(["ra", "su"]))[rng.integers(0, 3)]
        rows.append((i, " ".join(text), "en", "a"))
        labels.append((i, 1, int(i % 4 == 0)))
    labels += [(9999, 1, 1), (None, 1, 1), (2, 1, None)]
    frame = docs(spark, rows + [(1000 + (i or 50), t, l, s) for i, t, l, s in ODD])
    out = TX.score_toxicity(frame, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()
    got = {r["doc_id"]: r for r in out}
    held = [i for i in range(400) if got[i]["held_out"]]
    assert held and sum(got[i]["predicted"] == (i % 4 == 0) for i in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out)
    spans = [rows[0][1][s["start"] : s["end"]] for s in got[0]["spans"]]
    assert spans and all(re.fullmatch(r"(badword|vilething|grotka\w+)( (badword|vilething|grotka\w+))*", s) for s in spans)
    none = TX.score_toxicity(frame.limit(3), spark.createDataFrame([], "doc_id bigint, quality int, toxic int"))
    assert none.count() == 3
    assert TX.score_toxicity(frame.limit(0), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).count() == 0
