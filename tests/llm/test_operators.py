"""Each operator against brute force, and the odd cases: nulls, empty and long texts, ties, repeated rows, no rows, extra columns."""

import base64
import collections
import hashlib
import random
import re
import time
import zlib

import ahocorasick  # noqa: F401
import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken

from sievecraft.llm import bpe, chat, decontaminate, jpeg, language, nearcopies, queries, repeats, sharding, toxicity, warc
from sievecraft.llm.common import components, documents_in, scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron pi rho sigma tau ypsilon phi chi psi omega".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 40)) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Documents with what is odd: null and blank texts, copies, near copies, shared passages, a long text, non-ASCII, a repeated row."""
    rng = random.Random(5)
    texts = [None, "", "  \n", "a", "Ünï çødé " * 12, "x" * 300, prose(rng, 40_000)]
    base, passage = prose(rng, 150), prose(rng, 30)
    texts += [base, base, base.replace(base.split()[70], "changed"), base + " more", prose(rng, 60) + " " + passage, passage + " " + prose(rng, 50), passage.upper()]
    texts += [prose(rng, rng.randint(1, 80)) for _ in range(60)]
    rows = [(i, t, "en" if i % 2 else "de", "s", len(t or "")) for i, t in enumerate(texts)]
    rows.append(rows[9])
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def cut(texts, width=50):
    """What windows of a smaller document cover: brute force."""
    first, out = {}, {}
    for i in sorted(texts):
        b = (texts[i] or "").encode()
        for s in range(len(b) - width + 1):
            first.setdefault(b[s : s + width], i)
    for i in texts:
        b = (texts[i] or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - width + 1):
            if first[b[s : s + width]] < i:
                gone[s : s + width] = True
        out[i] = (len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone])) == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def test_repeats(odd, none):
    texts = {r.doc_id: r.text for r in odd.collect()}
    found = repeats.remove_repeats(odd)
    assert found.count() == odd.count()
    assert {i: tuple(r)[1:] for i, r in by_id(found).items()} == cut(texts)
    assert repeats.remove_repeats(none).count() == 0
    kept = repeats.without_repeats(odd)
    assert kept.columns == odd.columns and kept.count() == odd.count()


def test_repeats_of_random_bytes(spark):
    rng = random.Random(1)
    texts = {i: "".join(rng.choice("ab") for _ in range(rng.randint(0, 400))) for i in range(30)} | {30: "a" * 500, 31: "ab" * 200, 32: "a" * 49}
    df = spark.createDataFrame([(i, t, "extra") for i, t in texts.items()], "doc_id long, text string, blob string")
    assert {i: tuple(r)[1:] for i, r in by_id(repeats.remove_repeats(df)).items()} == cut(texts)


def test_repeats_round_hot_anchors_and_negative_ids(spark):
    """A line in all documents, each with its own surroundings; some repeat passages; ids below 0; every anchor counts as hot."""
    rng = random.Random(3)
    line = "this line of forty bytes is in all texts"
    texts = {}
    for i in range(-20, 40):
        texts[i] = prose(rng, 8) + line + prose(rng, 8) + (texts[i - 7][20:160] if i % 5 == 0 and i - 7 in texts else "")
    texts |= {100: line * 3, 101: line * 3 + "x", 102: None}
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in texts.items()] + [(None, line * 3, "y", 2), (0, texts[0], "z", 3)], "doc_id long, text string, blob string, shared int")
    for hot in (repeats._HOT, 3):
        found = repeats.remove_repeats(df, hot=hot).collect()
        assert {r.doc_id: tuple(r)[1:] for r in found if r.doc_id is not None} == cut(texts) and len(found) == len(texts) + 2
        assert [r.n_removed for r in found if r.doc_id is None] == [0]
    kept = repeats.without_repeats(df)
    assert kept.columns == df.columns and kept.count() == df.count()


def test_equal_hashes_of_other_bytes():
    """Pieces whose contents' hashes meet are told apart by their bytes."""
    texts = [b"aaaa", b"bbbb", b"aaaa", b"cccc", b"bbbb", b"aaaaa"]
    b = np.frombuffer(b"".join(texts), np.uint8)
    size = np.array([len(t) for t in texts])
    lo = np.cumsum(size) - size
    zero = np.zeros(len(texts), np.uint64)
    _, doc, _, where, n, _, new = repeats._kinds(b, zero, np.arange(len(texts)), np.zeros(len(texts), np.int64), lo, size, zero)
    kinds = np.cumsum(new)
    found = {}
    for k, d, x, m in zip(kinds.tolist(), doc.tolist(), where.tolist(), n.tolist(), strict=True):
        found.setdefault(k, []).append((d, b[x : x + m].tobytes()))
    assert sorted(sorted(d for d, _ in v) for v in found.values()) == [[0, 2], [1, 4], [3], [5]] and all(len({t for _, t in v}) == 1 for v in found.values())


def test_radix_passes():
    rng = np.random.default_rng(2)
    b = rng.integers(0, 3, 3000).astype(np.uint8)
    n = len(b) - 10 + 1
    order, group = repeats.repeated(b, np.arange(n), np.zeros(n, np.int64), 10)
    windows = {}
    for s in range(n):
        windows.setdefault(b[s : s + 10].tobytes(), []).append(s)
    expected = sorted(v for v in windows.values() if len(v) > 1)
    assert sorted(sorted(order[group == g].tolist()) for g in np.unique(group)) == expected


def test_media(odd, none):
    for r, (i, text) in ((r, (r.doc_id, t)) for r, t in zip(jpeg.media_column(odd, keep_media=True).collect(), [x.text for x in odd.collect()], strict=True)):
        raw = (text or "").encode()
        full = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:])), i
        assert r.media_sha256 == hashlib.sha256(r.media).hexdigest() and bytes(r.media[:2]) == b"\xff\xd8"
    assert jpeg.media_column(none).count() == 0
    long = np.random.default_rng(1).integers(0, 256, 64 * 8191 + 128, dtype=np.uint8).tobytes()
    assert b"".join(f[2].tobytes() for f in jpeg.decode(jpeg.encode(long))) == long


def baseline(rng, height, width, parts, interleaved, restart):
    """A baseline stream of random coefficients, written bit by bit, and the first component's DC pixels."""
    dc = {s: (n, c) for s, (n, c) in jpeg._codes(jpeg._DC_COUNTS, jpeg._DC_SYMBOLS).items()}
    ac_counts, ac_symbols = bytes([0, 1, 1, 1, 1, 1] + [0] * 10), bytes([0x00, 0x01, 0x12, 0xF0, 0x73])
    ac = jpeg._codes(ac_counts, ac_symbols)
    most_h, most_v = max(p[0] for p in parts), max(p[1] for p in parts)
    own = [(-(-height * v // (8 * most_v)), -(-width * h // (8 * most_h))) for h, v in parts]
    full = [(-(-height // (8 * most_v)) * v, -(-width // (8 * most_h)) * h) for h, v in parts]
    level = [rng.integers(-100, 100, f) for f in full]

    def signed(v):
        s = abs(v).bit_length()
        return s, format(v if v > 0 else v + (1 << s) - 1, f"0{s}b") if s else ""

    def block(c, y, x, last):
        s, extra = signed(int(level[c][y, x]) - last[c])
        last[c] = int(level[c][y, x])
        out = format(dc[s][1], f"0{dc[s][0]}b") + extra
        k = 1
        while k < 64 and rng.random() < 0.6:
            rs = int(rng.choice([0x01, 0x12, 0xF0, 0x73]))
            if k + (16 if rs == 0xF0 else (rs >> 4) + 1) > 63:
                break
            out += format(ac[rs][1], f"0{ac[rs][0]}b") + "".join(rng.choice(["0", "1"], rs & 15))
            k += 16 if rs == 0xF0 else (rs >> 4) + 1
        return out + format(ac[0][1], f"0{ac[0][0]}b")

    def scan(units):
        out, bits, last, mark = b"", "", [0] * len(parts), 0
        for i, u in enumerate(units):
            if restart and i and i % restart == 0:
                out += packed(bits) + bytes([0xFF, 0xD0 + mark % 8])
                bits, last, mark = "", [0] * len(parts), mark + 1
            bits += "".join(block(c, y, x, last) for c, y, x in u)
        return out + packed(bits)

    def packed(bits):
        bits += "1" * (-len(bits) % 8)
        return int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00")

    stream = b"\xff\xd8" + jpeg._segment(0xDB, bytes([0] + [8] * 64)) + jpeg._segment(0xC4, b"\x00" + jpeg._DC_COUNTS + jpeg._DC_SYMBOLS) + jpeg._segment(0xC4, b"\x10" + ac_counts + ac_symbols)
    stream += jpeg._segment(0xC0, bytes([8, *height.to_bytes(2, "big"), *width.to_bytes(2, "big"), len(parts), *(x for i, (h, v) in enumerate(parts) for x in (i + 1, h << 4 | v, 0))]))
    if restart:
        stream += jpeg._segment(0xDD, restart.to_bytes(2, "big"))
    head = lambda cs: jpeg._segment(0xDA, bytes([len(cs), *(x for c in cs for x in (c + 1, 0)), 0, 63, 0]))
    if interleaved and len(parts) > 1:
        rows, cols = full[0][0] // parts[0][1], full[0][1] // parts[0][0]
        units = [[(c, my * v + y, mx * h + x) for c, (h, v) in enumerate(parts) for y in range(v) for x in range(h)] for my in range(rows) for mx in range(cols)]
        stream += head(list(range(len(parts)))) + scan(units)
    else:
        for c in reversed(range(len(parts))):
            stream += head([c]) + scan([[(c, y, x)] for y in range(own[c][0]) for x in range(own[c][1])])
    return stream + b"\xff\xd9", np.clip(level[0][: own[0][0], : own[0][1]] + 128, 0, 255)


def test_any_baseline_scan():
    rng = np.random.default_rng(6)
    streams, expected = [], []
    for parts in ([(1, 1)], [(2, 2), (1, 1), (1, 1)], [(2, 1), (1, 1)], [(1, 1), (1, 1)]):
        for interleaved in (True, False):
            for restart in (0, 3):
                stream, pixels = baseline(rng, int(rng.integers(1, 60)), int(rng.integers(1, 60)), parts, interleaved, restart)
                streams.append(stream)
                expected.append(pixels)
    for found, pixels in zip(jpeg.thumbnails(streams), expected, strict=True):
        assert found[0][2].tolist() == pixels.tolist()
    payload = rng.integers(0, 256, 640, dtype=np.uint8).tobytes()
    media = jpeg.encode(payload)
    assert jpeg.decode(media)[0][2].tobytes() == payload
    for broken in (media.replace(b"\xff\xc0", b"\xff\xc2"), media[:-40] + media[-2:], b"xx" + media):
        with pytest.raises(ValueError):
            jpeg.decode(broken)


def all_maximal(s):
    """The best segment, then the same on both sides of it: the definition, brute force."""
    sums = np.concatenate([[0], np.cumsum(s)])
    spans = [(sums[j] - sums[i], i, j) for i in range(len(s)) for j in range(i + 1, len(s) + 1)]
    if not spans or max(spans)[0] <= 0:
        return []
    _, i, j = max(spans)
    return all_maximal(s[:i]) + [(i, j)] + [(a + j, b + j) for a, b in all_maximal(s[j:])]


def test_segments_are_maximal():
    rng = np.random.default_rng(7)
    for _ in range(500):
        s = rng.normal(size=rng.integers(0, 18))
        found = toxicity.maximal_segments(s)
        assert [x[:2] for x in found] == all_maximal(s)
        assert all(abs(v - s[a:b].sum()) < 1e-9 for a, b, v in found)


def test_segments_take_linear_time():
    falling = np.tile([1.0, -2.0], 500_000)
    began = time.perf_counter()
    assert len(toxicity.maximal_segments(falling)) == 500_000
    assert len(toxicity.maximal_segments(-falling[::-1] + 0.5)) >= 1
    assert time.perf_counter() - began < 30


def test_calibration_by_extreme_values():
    """Best segments of chance scores exceed a level as often as the fitted rate and scale say."""
    rng = np.random.default_rng(3)
    levels = np.linspace(-3.1, 2.3, 541)
    shares = np.exp(-((levels + 0.4) ** 2))
    shares /= shares.sum()
    rate = toxicity._rate(shares, levels)
    assert abs((shares * np.exp(rate * levels)).sum() - 1) < 1e-6
    n = 400
    best = np.array([max((x[2] for x in toxicity.maximal_segments(rng.choice(levels, n, p=shares))), default=0.0) for _ in range(2000)])
    scale = float(np.exp(np.mean(rate * best - np.log(n)) - toxicity._EULER))
    for q in (0.5, 0.9, 0.98):
        level = np.quantile(best, q)
        expected = 1 - np.exp(-scale * n * np.exp(-rate * level))
        assert abs(expected - (best >= level).mean()) < 0.05


def test_toxicity_finds_planted_words(spark, none):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(600):
        bad = i % 6 == 0
        words = prose(rng, 40).split()
        if bad:
            words[10:10] = ["vilestuff", "nastyword"]
        rows.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, 1, int(bad)))
    rows += [(600, None, None, None, None), (601, "", "en", "s", 0)]
    docs, tags = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, tags)
    found = by_id(toxicity.score(docs, model, passages=True))
    held = [r for r in found.values() if r.held_out and r.doc_id < 600]
    assert len(found) == 602 and held and all(r.predicted == int(r.doc_id % 6 == 0) for r in held)
    r = found[0]
    assert "vilestuff" in rows[0][1].encode()[r.passages[0].start : r.passages[0].end].decode()
    assert found[600].score == found[601].score and 0 <= found[600].score < 0.5
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns and {x.doc_id for x in kept.collect()} == {i for i, r in found.items() if not r.predicted}
    assert toxicity.score(none, toxicity.fit(none, tags)).count() == 0
    # extra columns with the operator's own names, repeated rows, a very long text
    long = " ".join(["alpha1"] * 200_000 + ["vilestuff", "nastyword"])
    extra = docs.where("doc_id < 3").selectExpr("*", "1 as y", "'x' as score", "2 as bucket", "3 as predicted")
    extra = extra.unionByName(extra).unionByName(spark.createDataFrame([(700, long, "en", "s", 0, 1, "x", 2, 3)], extra.schema))
    again = toxicity.score(extra, toxicity.fit(docs.selectExpr("*", "1 as y"), tags.selectExpr("*", "2 as y"))).collect()
    assert len(again) == 7 and all(abs(r.score - found[r.doc_id].score) < 1e-12 for r in again if r.doc_id < 3)
    assert [r.n_words for r in again if r.doc_id == 700] == [200_002] and toxicity.without_toxic(extra, model).columns == extra.columns


def test_toxicity_against_labels(spark):
    """Held-out accuracy on the given labels."""
    d = "/root/testdata/sf0.1"
    found = queries.op3_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out and toxic is not null")
    r = found.selectExpr("avg(cast(predicted = toxic as double)) as right", "count(*) as n").collect()[0]
    assert r.n > 200 and r.right > 0.95


def classes(texts):
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in texts:
        for b in texts:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in texts}


def test_near_duplicates(odd, none):
    found = nearcopies.near_duplicates(odd)
    assert found.count() == odd.count()
    assert {i: tuple(r)[1:] for i, r in by_id(found).items()} == classes({r.doc_id: r.text for r in odd.collect()})
    assert nearcopies.near_duplicates(none).count() == 0


def test_a_large_node_of_near_copies_is_one_class(spark):
    rng = random.Random(2)
    base = prose(rng, 120).split()
    texts = {}
    for i in range(700):
        w = list(base)
        for _ in range(2):
            w[rng.randrange(len(w))] = f"n{rng.randint(0, 10**6)}"
        texts[i] = " ".join(w)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {i: r.component_id for i, r in by_id(nearcopies.near_duplicates(df)).items()} == {i: c[1] for i, c in classes(texts).items()}


def test_structured_words_stay_apart(spark):
    """Thue-Morse words and their complements, which defeat polynomial hashes modulo 2**64."""
    word = lambda n: "".join("xy"[i.bit_count() % 2] for i in range(n))
    texts = {}
    for n in (64, 1024, 2048, 4096):
        for flip in (False, True):
            w = word(n).translate(str.maketrans("xy", "yx")) if flip else word(n)
            texts[len(texts)] = w
            texts[len(texts)] = f"one two three four five {w} six seven eight nine ten"
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {i: tuple(r)[1:] for i, r in by_id(nearcopies.near_duplicates(df)).items()} == classes(texts)
    assert {i: tuple(r)[1:] for i, r in by_id(repeats.remove_repeats(df)).items()} == cut(texts)


def test_exact_sets_survive_hash_collisions(monkeypatch):
    texts = ["a b c d e f", "A  b c d e f g", "b", "", "a b c d e a b c d e", "x y z v w"]
    raw, at = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *map(len, texts)])
    for bits in (64, 1):
        whole = nearcopies.words_hash
        monkeypatch.setattr(nearcopies, "words_hash", lambda *a, bits=bits, whole=whole, **k: whole(*a, **k) >> np.uint64(64 - bits))
        out, places = nearcopies.plain(raw, at)
        number, offsets = nearcopies.exact_sets(out, places, 5)
        sets = [set(number[lo:hi].tolist()) for lo, hi in zip(offsets[:-1], offsets[1:], strict=True)]
        expected = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in (t.lower().split() for t in texts)]
        assert [[len(x & y) for y in sets] for x in sets] == [[len(x & y) for y in expected] for x in expected]
        monkeypatch.undo()


def test_recall_near_the_threshold(spark):
    """Pairs with shared boilerplate at 0.75 to 0.83, all others of their family below 0.72: each pair is found."""
    for seed, (shared, own, twins) in enumerate(((140, 30, 7), (150, 27, 5), (160, 40, 15))):
        texts = family(random.Random(seed), 160, shared, own, twins)
        df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
        assert {i: r.component_id for i, r in by_id(nearcopies.near_duplicates(df)).items()} == {i: c[1] for i, c in classes(texts).items()}


def test_null_ids_and_repeated_rows_of_copies(spark):
    text = "one two three four five six seven"
    df = spark.createDataFrame([(None, text, 1), (5, text, 2), (3, text, 3), (3, text, 4), (None, "alone in the world of words", 5), (9, None, 6)], "doc_id long, text string, first int")
    found = sorted(nearcopies.near_duplicates(df).collect(), key=str)
    assert len(found) == 6 and {(r.doc_id, r.component_id, r.kept) for r in found} == {(None, 3, False), (5, 3, False), (3, 3, True), (None, None, False), (9, 9, True)}


def family(rng, n, shared, own, twins):
    """Texts of one template with `shared` of shared + own shingles in common; two and two have `twins` more."""
    template = [f"t{i}" for i in range(shared + 4)]
    texts = {}
    for i in range(n):
        pair = [f"p{i // 2}w{k}" for k in range(twins)]
        texts[i] = " ".join(template + pair + [f"o{i}w{k}" for k in range(own - twins)])
    ids = list(range(n))
    rng.shuffle(ids)
    return {ids[i]: t for i, t in texts.items()}


def test_true_pairs_in_a_family_just_below_the_threshold(spark):
    texts = family(random.Random(12), 150, 140, 30, 7)  # 0.70, and 75 pairs of 0.76
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {i: r.component_id for i, r in by_id(nearcopies.near_duplicates(df)).items()} == {i: c[1] for i, c in classes(texts).items()}


@pytest.mark.parametrize("sent", [nearcopies.SENT, 0])
def test_shared_shingles_meet_block_against_block(spark, monkeypatch, sent):
    monkeypatch.setattr(nearcopies, "SENT", sent)
    monkeypatch.setattr(nearcopies, "SMALL", 8)
    monkeypatch.setattr(nearcopies, "BLOCK", 1)
    texts = family(random.Random(15), 80, 140, 30, 7) | {200: "a b c d e f", 201: "a b c d e f g", 202: "A b c d e"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {i: r.component_id for i, r in by_id(nearcopies.near_duplicates(df)).items()} == {i: c[1] for i, c in classes(texts).items()}


def test_true_pairs_in_a_large_node(spark):
    texts = family(random.Random(13), 1200, 130, 35, 14)  # 0.65, and 600 pairs of 0.77; all meet in nodes that aren't small
    assert len(texts) > 2 * nearcopies.SMALL
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    first = {}
    for i in sorted(texts):
        first.setdefault(texts[i].split()[134], i)
    assert {i: r.component_id for i, r in by_id(nearcopies.near_duplicates(df)).items()} == {i: first[t.split()[134]] for i, t in texts.items()}


def test_components_of_a_long_chain(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(500, 400), (7, 7)], "a long, b long")
    found = {r.node: r.component for r in components(df).collect()}
    assert found == dict.fromkeys(range(101), 0) | {400: 400, 500: 400}


def test_chat_round_trip(spark):
    nasty = ["### User: </turn>\n", "\\", "\\\\### x", None, "", "</turn></turn>", "a\nb: c", "ok"]
    rows = [(1, i, r, t) for i, (r, t) in enumerate(zip(["system", "user", "assistant", "user", "assistant", "tool:x", None, "assistant"], nasty, strict=True))]
    rows += [(None, 0, "user", "hi"), (None, 1, "assistant", "there")] + [(2, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(100)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumnRenamed("turn", "turn")
    found = {r.conv_id: r for r in chat.format_conversations(df, chat.TurnTemplate(), chat.TurnTemplate.read, chat.unescape, keep=True).collect()}
    for conv in (1, 2, None):
        turns = [(r or "", t or "") for c, _, r, t in rows if c == conv]
        r = found[conv]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (r.n_turns, r.loss_chars, r.loss_sha256, r.formatted_chars) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(r.output))
        assert "".join(chat.unescape(r.output[s:e]) for s, e in r.loss_spans) == loss and not r.rewrites


def test_rewritten_history_is_detected():
    def last_only(turns):
        return "".join(f"<{r}>{t if i == len(turns) - 1 or r == 'user' else '...'}" for i, (r, t) in enumerate(turns))

    spans = chat.locate(last_only, [("user", "q"), ("assistant", "long thought"), ("user", "r")])[1]
    assert [x["rewrites"] for x in spans] == [False, False, True]


def test_any_template_sees_whole_conversations(spark):
    def headed(turns):
        return "[start]\n" + "".join(f"<{i}:{r}>{t}\n" for i, (r, t) in enumerate(turns))

    def last_answers(turns):
        late = [i for i, (r, _) in enumerate(turns) if r == "assistant"][-20:]
        return "".join(f"<{i}:{r}>{t if r == 'user' or i in late else '...'}\n" for i, (r, t) in enumerate(turns))

    turns = [("user" if i % 2 == 0 else "assistant", f"text{i}") for i in range(70)]
    df = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    for template, answers, rewrites in ((headed, [t for r, t in turns if r == "assistant"], False), (last_answers, [t for r, t in turns if r == "assistant"][-20:], True)):
        r = chat.format_conversations(df, template, lambda out: re.findall(r"<\d+:(\w+)>(.*)", out), str, keep=True).collect()[0]
        assert r.output == template(turns) and r.formatted_chars == len(r.output) and r.n_turns == 70 and r.rewrites == rewrites
        assert [r.output[s:e] for s, e in r.loss_spans if s < e] == answers and r.loss_sha256 == hashlib.sha256("".join(answers).encode()).hexdigest()


def test_codewords_and_language(spark, none):
    for n in (2, 4, 9):
        c = nearcodes = language.codewords(n)
        assert len({tuple(x) for x in nearcodes.tolist()}) == n and (n < 3 or min((c[i] != c[j]).sum() for i in range(n) for j in range(i)) >= 2)
    rng = random.Random(4)
    kinds = {"aa": "kalo mira tepu sani".split(), "bb": "schrong zwist pfeld".split(), "cc": "eau oui ceci très".split()}
    rows = [(i, " ".join(rng.choice(kinds[k]) for _ in range(30)), k, "s", 0) for i, k in enumerate(list(kinds) * 60)]
    rows += [(900, None, "aa", "s", 0), (901, "123 -- 4", "aa", "s", 0), (902, "schrong", None, "s", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    found = by_id(language.predict(docs, language.fit(docs)))
    assert all(found[i].lang_pred == k for i, _, k, _, _ in rows[:180])
    assert found[900].lang_pred == found[901].lang_pred == "und" and found[902].lang_pred == "bb"
    assert language.predict(docs, language.fit(none)).where("lang_pred <> 'und'").count() == 0
    assert language.predict(none, language.fit(docs)).count() == 0
    # a text over several chunks, repeated rows, extra columns
    long = docs.where("doc_id in (1, 901)").selectExpr("*", "'x' as ambiguous", "1 as score").unionByName(spark.createDataFrame([(950, "eau oui ceci très " * 80_000, None, None, None, "x", 1)], DOCS + ", ambiguous string, score int"))
    again = language.predict(long.unionByName(long), language.fit(docs)).collect()
    assert sorted((r.doc_id, r.lang_pred) for r in again) == sorted([(1, "bb"), (901, "und"), (950, "cc")] * 2)


def test_nearest_codeword_against_brute_force(spark):
    """Loss-weighted decoding, one text after another in plain Python; equal codewords' losses go to the first language."""
    rng = random.Random(14)
    kinds = {f"l{k}": ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(30)] for k in range(6)}
    rows = [(i, " ".join(rng.choice(kinds[k]) for _ in range(20)), k, "s", 0) for i, k in enumerate(list(kinds) * 30)]
    docs = spark.createDataFrame(rows, DOCS)
    model = language.fit(docs)
    found = by_id(language.predict(docs, model))
    for i, text, _, _, _ in rows[::7]:
        b = np.frombuffer(text.encode(), np.uint8)
        grams = [b[k : k + 3].tobytes() for k in range(len(b) - 2)]
        slot = [int(np.uint32((g[0] << 16 | g[1] << 8 | g[2]) * 2654435761 % (1 << 32)) >> (32 - language.BITS)) for g in grams]
        margin = [min(max((float(sum(model.weights[x, j] for x in slot)) / len(slot) - model.middle[j]) / model.half[j], -6), 6) for j in range(model.codes.shape[1])]
        loss = [sum(model.trust[c][j] * np.exp(-model.codes[c][j] * m) for j, m in enumerate(margin)) for c in range(len(model.languages))]
        assert found[i].lang_pred == model.languages[int(np.argmin(loss))]
        assert abs(found[i].score - 1 / sum(np.exp(-2 * (x - min(loss))) for x in loss)) < 1e-3
    tied = language.Model(["a", "b"], np.array([[1], [1]], np.int8), model.weights[:, :1], np.zeros(1), np.ones(1), np.ones((2, 1)))
    assert {(r.lang_pred, r.ambiguous) for r in language.predict(docs, tied).collect()} == {("a", True)}


def test_language_sample_is_the_first_by_hash(spark):
    df = spark.range(5000).selectExpr("id as doc_id", "case when id % 10 = 0 then 'a' else 'b' end as lang")
    expected = {(r.doc_id, r.lang) for r in df.selectExpr("*", "row_number() over (partition by lang order by xxhash64(doc_id), doc_id) as k").where("k <= 700").collect()}
    assert {(r.doc_id, r.lang) for r in language.first_of_each(df, 700).collect()} == expected


def test_language_on_held_out_documents(spark):
    d = "/root/testdata/sf0.1"
    found = queries.op6_language_id(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out and lang is not null and lang_pred <> 'und'")
    r = found.selectExpr("avg(cast(lang_pred = lang as double)) as right", "count(*) as n").collect()[0]
    assert r.n > 500 and r.right > 0.95


def archived(pages):
    first, out = {}, []
    for i, _, h in sorted(pages, key=lambda x: (x[0] is None, x[0])):
        first.setdefault((h or "").encode(), i)
    for i, _, h in pages:
        b = (h or "").encode()
        kind = ("response", None) if first[b] == i else ("revisit", first[b])
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), *kind))
    return sorted(out, key=str)


TRAP = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"


@pytest.mark.parametrize("split", ["128m", "700"])
def test_warc(spark, split):
    """Magic in payloads, blanks at ends, ties, repeats, nulls; files whole and cut into ranges smaller than a record."""
    rng = random.Random(21)
    bits = ["<p>é</p>", TRAP, "\r\n\r\n" + TRAP, "\r\n", "\r\n\r\n", "\r", "x" * 400, "WARC/1.1\r\n", "Content-Length: 1\r\n\r\n"]
    pages = [(i, f"http://x/{i} \r\n", h) for i, h in enumerate(["<p>é</p>", TRAP, "", None, "<p>é</p>", TRAP * 3, "a\r\n\r\nb", "ends \r\n", "ends \r\n\r", ("\r\n\r\n" + TRAP) * 40])]
    pages += [(i, None, "".join(rng.choices(bits, k=rng.randint(0, 12)))) for i in range(20, 45)]
    pages += [pages[0], (5, "again", "another page 5"), (5, "again", "another page 5"), (None, "n", "<p>é</p>"), (None, None, "only here")]
    rows = [(*x, "resp", 7) for x in pages]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, record_type string, size int").repartition(3)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        found = warc.round_trip(df).collect()
        assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found), key=str) == archived(pages)
        path = warc.write_archives(df, scratch(spark, "warc-test"))
        read = warc.read_archives(spark, path)
        assert sorted(bytes(r.payload) for r in read.collect() if r.record_type == "response") == sorted((h or "").encode() for (i, _, h), x in zip(sorted(pages, key=lambda x: str((x[0], len((x[2] or "").encode()), base64.b32encode(hashlib.sha1((x[2] or "").encode()).digest()).decode()))), archived(pages), strict=True) if x[3] == "response")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_warc_without_pages(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_chain_stops_at_broken_records(spark, tmp_path):
    good = (warc.record(1, None, "x", warc.digest(b"x"), None) + "\r\n\r\n").encode()
    files = {"a": good + good + b"junk" + good, "b": good + good[:-9], "c": b"", "d": b"junk" + good, "e": good + b"WARC/1.1\r\nno length\r\n\r\n" + good, "f": good * 30}
    for name, data in files.items():
        (tmp_path / f"part-{name}").write_bytes(data)
    found = warc.read_archives(spark, str(tmp_path)).collect()
    assert collections.Counter(r.file[-1] for r in found) == {"a": 2, "b": 1, "e": 1, "f": 30}
    assert sorted(r.offset for r in found if r.file.endswith("f")) == [i * len(good) for i in range(30)]


def test_pointer_jumping_inside_a_range():
    rng = np.random.default_rng(12)
    for _ in range(200):
        at = np.unique(rng.integers(0, 60, rng.integers(0, 20)))
        after = np.where(rng.random(len(at)) < 0.15, -1, at + rng.integers(1, 20, len(at)))
        doors = rng.random(len(at)) < 0.2
        where = {x: i for i, x in enumerate(at.tolist())}
        seen, out = set(), []
        for i in range(len(at)):
            k = i
            while k is not None and after[k] in where:
                k = where[after[k]]
            out.append(int(after[k]) if after[k] < 0 or after[k] > at[-1] else -1)
            if doors[i]:
                k = i
                while k is not None:
                    seen.add(k)
                    k = where.get(after[k])
        assert warc.exits(at, after).tolist() == out
        assert set(np.flatnonzero(warc.reachable(at, after, doors)).tolist()) == seen


def test_bpe_equals_the_library(odd, none):
    ranks = bpe.load_ranks(queries.TOKENIZER)
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ours = bpe.vocabulary(queries.TOKENIZER, public_tokenizers.PATTERN)
    rng = random.Random(8)
    for _ in range(3000):
        s = "".join(rng.choices(["a", "e", "é", " ", "the", "ing", "ñ", "中", "1", "'s", "\n", "\t", "😀", "\x85", "\x1c"], k=rng.randint(0, 40)))
        assert ours.encode(s) == theirs.encode_ordinary(s) and ours.decode(ours.encode(s)) == s.encode()
    assert len(ours.encode("a" * 100_000)) == len(theirs.encode_ordinary("a" * 100_000))
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    found = by_id(bpe.encode_column(odd, queries.TOKENIZER, public_tokenizers.PATTERN, keep_ids=True))
    for i, t in texts.items():
        ids = theirs.encode_ordinary(t)
        r = found[i]
        assert r.ids == ids and r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert bpe.encode_column(none, queries.TOKENIZER, public_tokenizers.PATTERN).count() == 0


def test_shard_table(odd, none):
    names = [f"s{i}" for i in range(13)]
    t = sharding.fill(names, 1009)
    n = np.bincount(t)
    assert n.max() - n.min() <= 1 and len(n) == 13
    fewer = sharding.fill(names[:-1], 1009)
    assert (fewer != t).mean() < 0.25
    placed = sharding.place(odd.selectExpr("*", "'x' as shard"), "doc_id", names)
    assert placed.count() == odd.count() and placed.select("doc_id", "shard").distinct().groupBy("doc_id").count().where("count > 1").count() == 0
    assert sharding.place(none, "doc_id", names).count() == 0
    with pytest.raises(ValueError):
        sharding.fill(names, 1000)


def hits(texts, items, size=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = {}
    windows = {(k, tuple(w[i : i + size])) for k, t in items for w in [words(t)] for i in range(max(1, len(w) - size + 1)) if w}
    for i, t in texts.items():
        w, hit, found = words(t), set(), set()
        for k, v in windows:
            for s in range(len(w) - len(v) + 1):
                if tuple(w[s : s + len(v)]) == v:
                    hit |= set(range(s, s + len(v)))
                    found.add(str(k))
        out[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def close_items(texts, items, size=10, slack=5):
    """Items with a window whose words all lie within its length and slack, in any order: brute force."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {(str(k), tuple(w[i : i + size])) for k, t in items if k is not None for w in [words(t)] for i in range(max(1, len(w) - size + 1)) if w}
    out = set()
    for i, t in texts.items():
        w = words(t)
        for k, v in windows:
            need = collections.Counter(v)
            if need.keys() <= set(w) and any(not need - collections.Counter(w[s : s + len(v) + slack]) for s in range(len(w))):
                out.add((k, i))
    return out


@pytest.mark.parametrize("limit", [48 << 20, 0])
def test_decontamination(spark, odd, none, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", limit)
    texts = {r.doc_id: r.text for r in odd.collect()}
    passage, long = texts[12].split(), texts[6].split()
    shuffled = [*passage[:9], "between", "more", passage[9], passage[8]]
    texts |= {300: " ".join(reversed(passage[:12])), 301: " ".join(shuffled), 302: "x " + "rep rep rep " * 5, 303: " ".join(passage[:10] * 3)}
    docs = odd.unionByName(spark.createDataFrame([(i, texts[i], None, None, None) for i in range(300, 304)] + [(None, texts[12], None, None, None)], DOCS)).selectExpr("*", "1 as item_id", "'x' as term", "2 as position")
    items = [(1, " ".join(passage[:14])), (2, "Ünï"), (10, " ".join(passage[3:9]).upper()), (3, None), (4, "--"), (1, " ".join(passage[:14])), (5, "not there at all"), (6, "rep rep rep"), (None, texts[12]), (7, " ".join(long[30_000:30_025])), (8, "x")]
    bench = spark.createDataFrame([(*x, 0) for x in items], "item_id long, text string, doc_id int")
    found = decontaminate.contamination(docs, bench)
    assert found.count() == docs.count() and "Python" not in found._jdf.queryExecution().executedPlan().toString()
    expected = hits(texts, [x for x in items if x[0] is not None])
    assert {i: tuple(r)[1:6] for i, r in by_id(found).items() if i is not None} == expected
    assert [(r.n_hit, r.contaminated) for r in found.collect() if r.doc_id is None] == [(0, False)]
    near = {(r.item_id, r.doc_id) for r in decontaminate.proximity_matches(docs, bench).collect()}
    assert near == close_items({i: t for i, t in texts.items() if i != 6}, items) | {x for x in near if x[1] == 6}
    assert ("7", 6) in near and {r.doc_id: r.n_near_items for r in found.collect() if r.n_near_items} == collections.Counter(i for _, i in near)
    if limit:
        assert decontaminate.contamination(none, bench).count() == 0
        assert decontaminate.contamination(docs, bench.limit(0)).where("contaminated").count() == 0


@pytest.mark.parametrize("name", ["near_items", "op10_decontamination"])
def test_decontamination_queries_have_rows_and_columns_of_their_sql(spark, tmp_path, name):
    rng = random.Random(15)
    few, item = WORDS[:4], [rng.choice(WORDS) for _ in range(24)]
    made = [None, "", "--", *(" ".join(rng.choice(few) for _ in range(rng.randint(1, 60))) for _ in range(20))]
    for _ in range(60):
        part = item[(k := rng.randint(0, 14)) : k + 10]
        if rng.random() < 0.7:
            rng.shuffle(part)
        for _ in range(rng.randint(0, 7)):
            part.insert(rng.randint(1, len(part) - 1), rng.choice(["other", "words"]))
        made.append(prose(rng, 5) + ". " + ", ".join(part).upper() + " " + prose(rng, 20))
    items = [(1, " ".join(item)), (2, " ".join(rng.choice(few) for _ in range(14))), (10, "alpha ALPHA beta"), (3, None), (4, "--"), (5, "nowhere alpha"), (6, " ".join(item[:12]))]
    for table, rows, schema in (("documents", list(enumerate(made)), "doc_id long, text string"), ("benchmark", items, "item_id long, text string")):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{table}.parquet")
    c = duckdb.connect()
    for table in ("documents", "benchmark"):
        c.execute(f"create view {table} as select * from '{tmp_path}/{table}.parquet/*.parquet'")
    df, sql = queries.QUERIES[name](spark, str(tmp_path)), c.execute(queries.ORACLES[name])
    assert df.columns == [x[0] for x in sql.description]
    expected = sorted(sql.fetchall())
    assert sorted(map(tuple, df.collect())) == expected and len({r[-1] for r in expected}) > 1
    if name == "near_items":
        close = close_items(dict(enumerate(made)), items)
        assert dict(expected) == {i: sum(x[1] == i for x in close) for i in range(len(made))}


def contaminated(texts, items, size=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {tuple(w[i : i + size]) for t in items for w in [words(t)] for i in range(max(1, len(w) - size + 1)) if w}
    sizes = {len(w) for w in windows}
    return {i for i, t in texts.items() for w in [words(t)] if any(tuple(w[k : k + n]) in windows for n in sizes for k in range(len(w) - n + 1))}


def without_repeated(texts, width=50):
    """The texts without all bytes that windows of smaller documents cover: brute force."""
    first, out = {}, {}
    for i in sorted(texts):
        b = (texts[i] or "").encode()
        for s in range(len(b) - width + 1):
            first.setdefault(b[s : s + width], i)
    for i, t in texts.items():
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - width + 1):
            if first[b[s : s + width]] < i:
                gone[s : s + width] = True
        out[i] = None if t is None else np.frombuffer(b, np.uint8)[~gone].tobytes().decode("utf-8", "ignore")
    return out


def test_pipeline_equals_brute_force(spark):
    """run() and each stage on what the one before kept, against plain Python on the same rows."""
    import corpus_pipeline as C

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    out = C.run(spark, d)
    before = docs
    for _name, stage in C.STAGES[:-1]:
        after = stage(spark, before, d).cache()
        assert after.columns == docs.columns
        texts, kept = ({r.doc_id: r.text for r in x.collect()} for x in (before, after))
        if stage is C.reject_toxic:
            model = toxicity.fit(before, spark.read.parquet(f"{d}/labels.parquet"))
            assert set(kept) == {r.doc_id for r in toxicity.score(before, model).collect() if r.score < 0.5}
        elif stage is C.drop_near_duplicates:
            assert set(kept) == {i for i, c in classes(texts).items() if c[2]}
        elif stage is C.cut_repeats:
            assert kept == without_repeated(texts)
        else:
            assert set(kept) == set(texts) - contaminated(texts, items)
        before = after
    ours = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(queries.TOKENIZER), special_tokens={})
    ids = {i: ours.encode_ordinary(t or "") for i, t in kept.items()}
    assert {r.doc_id: (r.n_tokens, r.ids_sha256) for r in out.collect()} == {i: (len(x), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for i, x in ids.items()}


def test_stages_on_odd_tables(spark, odd, none):
    """Nulls, repeated rows, no rows, extra columns with the stages' own names."""
    import corpus_pipeline as C

    d = "/root/testdata/sf0.001"
    extra = odd.where("doc_id in (0, 1, 2, 3, 7, 8, 9, 11, 12)").unionByName(spark.createDataFrame([(None, "alone", None, None, None), (None, None, "x", "y", 1)], DOCS)).selectExpr("*", "'a' as term", "1 as component_id", "2 as score", "3 as blob", "4 as position")
    for _name, stage in C.STAGES[:-1]:
        found = stage(spark, extra, d)
        assert found.columns == extra.columns
        ids = [r.doc_id for r in found.collect()]
        assert ids.count(None) == 2 and {0, 1, 2, 3, 7} <= set(ids) and (8 in ids) == (stage is not C.drop_near_duplicates)
        assert ids.count(9) == (0 if stage is C.drop_near_duplicates else 2)
        empty = stage(spark, none, d)
        assert empty.columns == none.columns and empty.count() == 0
    assert C.encode(spark, extra, d).count() == 12 and C.encode(spark, none, d).count() == 0


def test_chat_odd_tables(spark):
    schema = "conv_id long, turn long, role string, text string, output string, n_turns int"
    rows = [(1, None, "user", "b", "x", 1), (1, 0, "assistant", "second", "x", 1), (1, 0, "assistant", "first", "y", 2), (1, 0, "assistant", "first", "y", 2)]
    form = lambda df: chat.format_conversations(df, chat.TurnTemplate(), chat.TurnTemplate.read, chat.unescape, keep=True)
    assert form(spark.createDataFrame([], schema)).count() == 0
    r = form(spark.createDataFrame(rows, schema)).collect()[0]
    assert r.n_turns == 4 and [t for _, t in chat.TurnTemplate.read(r.output)] == ["b", "first", "first", "second"]


def test_shards_by_an_independent_filling(spark):
    """The query's places against a table filled turn by turn in plain Python, and null keys."""
    def fill(names, slots):
        def order(s):
            h = hashlib.sha256(s.encode()).digest()
            start, skip = int.from_bytes(h[:8], "big") % slots, int.from_bytes(h[8:16], "big") % (slots - 1) + 1
            return ((start + k * skip) % slots for k in range(slots))

        prefers, taken = [order(n) for n in names], {}
        while len(taken) < slots:
            for n, p in zip(names, prefers, strict=True):
                if len(taken) < slots:
                    taken[next(k for k in p if k not in taken)] = n
        return taken

    small = fill(["a", "b", "c"], 101)
    assert ["abc"[i] for i in sharding.fill(["a", "b", "c"], 101)] == [small[k] for k in range(101)]
    table = fill(queries.SHARDS, sharding.SLOTS)
    d = "/root/testdata/sf0.001"
    found = queries.op9_sharding(spark, d).collect()
    slots = {r.doc_id: r.slot for r in spark.read.parquet(f"{d}/documents.parquet").selectExpr("doc_id", f"cast(pmod(xxhash64(cast(doc_id as string)), {sharding.SLOTS}) as int) as slot").collect()}
    assert len(found) == len(slots) and all(r.slot == slots[r.doc_id] and r.shard == table[r.slot] for r in found)
    nulls = sharding.place(spark.createDataFrame([(None,), (None,), (1,)], "k long"), "k", ["a", "b"], 101).collect()
    assert len(nulls) == 3 and len({r.shard for r in nulls if r.k is None}) == 1


def test_scratch_is_below_the_shared_folder(spark):
    assert scratch(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
    assert list(documents_in([])) == []
