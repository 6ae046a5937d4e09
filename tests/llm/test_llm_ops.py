"""The operators against brute force and the libraries, with nulls, empty and long texts, ties, repeats, clashing columns."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from pyspark.sql import functions as F  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from sparkloom.llm import bpe_stream, embedding_dedup, knn_join, line_dedup, mixing, ngram_join, suffix_dedup, token_counts, token_files, toxicity  # noqa: E402
from sparkloom.llm.common import connected_components, roots_of  # noqa: E402
from sparkloom.llm.shingles import shingle_set, word_hashes  # noqa: E402
from sparkloom.llm.tokenizer import ByteBpe, WordBpe, load  # noqa: E402

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, row long, doc string, n_tokens int, toxic string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 1, "k", 5, "d", 7, "x") for i, t, s in rows], SCHEMA)


EDGES = [
    (1, "Same line\nother é\n", "a"),
    (1, "Same line\nother é\n", "a"),
    (None, "no id here at all", None),
    (2, None, "b"),
    (3, "", "b"),
    (4, "word " * 30000, "b"),
    (5, "x" * 150_000, "c"),
    (6, "<|endoftext|> ½ 日本語 it's  á", "c"),
    (7, " \t\n\x0b", "c"),
    (8, "same LINE \nmore", ""),
]


@pytest.fixture(scope="module")
def edges(spark):
    return frame(spark, EDGES).cache()


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


def library(path):
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def test_token_counts(edges, none):
    t = library(BYTE)
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(edges, BYTE, chunk=4096, overlap=64).collect())
    want = Counter()
    for i, text, _ in EDGES:
        n = len(t.encode(text or "", add_special_tokens=False).ids)
        want[i, len((text or "").encode()), n, n > 1024] += 1
    assert got == want
    assert token_counts.count_tokens(none, BYTE).count() == 0


def test_splicing_equals_one_piece():
    bpe, rng = load(ByteBpe, BYTE), random.Random(3)
    for _ in range(40):
        text = "".join(rng.choice(["a", "bc", " ", "  ", "\n", ".", "é", "'s", "日", "1"]) for _ in range(rng.randint(0, 900)))
        whole = bpe.library.encode(text, add_special_tokens=False).ids
        assert token_counts.spliced(bpe, text, 64, 8).tolist() == whole
        ids, ends = bpe.encode_with_ends(text)
        assert ids.tolist() == whole and (not len(ends) or ends[-1] == len(text))


def test_engine_equals_library_on_every_safe_character():
    for kind, path in ((ByteBpe, BYTE), (WordBpe, WORD)):
        bpe, t = load(kind, path), library(path)
        for point in range(0x20, 0x250):
            text = f"x{chr(point)} {chr(point)}y 1{chr(point)}{chr(point)}"
            got = bpe.encode(text) if kind is ByteBpe else bpe_stream.encode(bpe, text)
            assert got.tolist() == t.encode(text, add_special_tokens=False).ids, hex(point)


@pytest.mark.parametrize("by_bit", [False, True])
def test_token_files(edges, none, by_bit):
    t, start = library(BYTE), 0
    got = sorted(map(tuple, token_files.token_files(edges, BYTE, block_ids=100, shard_docs=3, by_bit=by_bit).select("start", "doc_id", "n_tokens", "ids_crc32").collect()))
    want = []
    for i, text, _ in sorted(EDGES, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        want.append((start, i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    assert token_files.token_files(none, BYTE).count() == 0


def test_planes_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 7, 1000):
        for top in (2, 255, 50256, 1 << 31):
            ids = rng.integers(0, top, n).astype(np.uint32)
            for by_bit in (False, True):
                assert (token_files.unpack(token_files.pack(ids, by_bit, 3), n, by_bit) == ids).all()


def test_bpe_stream(edges, none):
    t = library(WORD)
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe_stream.encode_documents(edges, WORD).collect())
    want = Counter()
    for i, text, _ in EDGES:
        ids = t.encode(text or "", add_special_tokens=False).ids
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert got == want
    assert bpe_stream.encode_documents(none, WORD).count() == 0
    kept = bpe_stream.encode_documents(edges, WORD, keep_ids=True, keep_text=True).where("doc_id = 6").first()
    assert kept.ids == t.encode(EDGES[7][1], add_special_tokens=False).ids and kept.decoded


def test_streaming_encoder_in_any_slices():
    bpe, rng = load(WordBpe, WORD), random.Random(5)
    texts = ["".join(rng.choice("aeinrst") for _ in range(40_000)), "".join(rng.choice("ab's -.\n1") for _ in range(5_000)), "--" * 15_000]
    for text in texts:
        want = bpe.library.encode(text, add_special_tokens=False).ids
        for size in (313, 5000):
            assert bpe_stream.encode(bpe, text, size).tolist() == want
        back = "".join(bpe_stream.decode_parts(bpe, np.array(want, np.uint32), as_tokens=False, size=7))
        assert back.replace(" ", "") == "".join(text.split()).lower()


def brute_lines(rows, min_docs):
    strip = " \t\n\x0b\x0c\r"
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    keys = [[x.strip(strip).translate(lower) for x in (t or "").split("\n")] for _, t in rows]
    n = Counter(k for ks in keys for k in set(ks) if k)
    out = Counter()
    for (i, t), ks in zip(rows, keys):
        kept = [x for x, k in zip((t or "").split("\n"), ks) if not (k and n[k] >= min_docs)]
        out[i, len(ks), len(ks) - len(kept), "\n".join(kept)] += 1
    return out


@pytest.mark.parametrize("broadcast_keys", [1 << 20, 0])
def test_line_dedup(spark, edges, none, broadcast_keys):
    rng = random.Random(1)
    pool = ["Common line", " common LINE\t", "rare", "é É", "", "   "]
    rows = [(i, "\n".join(rng.choice(pool + [f"own {i}"]) for _ in range(rng.randint(1, 8)))) for i in range(60)] + [(None, "rare\ncommon line"), (5, None)]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), 10, broadcast_keys=broadcast_keys)
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in got.collect()) == brute_lines(rows, 10)
    got = line_dedup.dedup_lines(edges, 3, broadcast_keys=broadcast_keys)
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in got.collect()) == brute_lines([r[:2] for r in EDGES], 3)
    assert line_dedup.dedup_lines(none, 3, broadcast_keys=broadcast_keys).count() == 0


def test_line_index_is_reversible(spark):
    first = spark.createDataFrame([(i, f"a\nb{i}\nc") for i in range(12)], "doc_id long, text string")
    more = spark.createDataFrame([(i, "b1\nz\na") for i in range(20, 32)], "doc_id long, text string")
    index = line_dedup.LineIndex.build(first, 10)
    grown = index.insert(more)
    back = grown.delete(more)
    keys = lambda x: {bytes(r.key) for r in x.frequent().collect()}
    assert keys(grown) == {line_dedup.digest(k) for k in (b"a", b"c", b"b1", b"z")}
    assert keys(back) == keys(index) == {line_dedup.digest(k) for k in (b"a", b"c")}
    assert sorted(map(tuple, back.counts.collect())) == sorted(map(tuple, index.counts.collect()))
    for x in (grown, back):
        tables = {r.shard: np.frombuffer(r.table, np.uint16).reshape(-1, 4) for r in x.filters.collect()}
        found = list(keys(x))
        places = line_dedup._shards(found, x.shards)
        assert all(line_dedup.CuckooFilter(tables[int(p)]).holds(line_dedup._hashes([k]))[0] for k, p in zip(found, places))
    assert sum((np.frombuffer(r.table, np.uint16) > 0).sum() for r in back.filters.collect()) == 2


def test_line_index_outgrows_its_filters(spark):
    text = lambda n: "\n".join(f"line {j}" for j in range(n))
    small, large = (spark.createDataFrame([(i, text(n)) for i in range(3)], "doc_id long, text string") for n in (2, 400))
    index = line_dedup.LineIndex.build(small, 2, shards=2)
    grown = index.insert(large)
    back = grown.delete(large)
    for x, n in ((grown, 400), (back, 2)):
        found = [line_dedup.digest(b"line %d" % j) for j in range(n)]
        assert {bytes(r.key) for r in x.frequent().collect()} == set(found)
        tables = {r.shard: np.frombuffer(r.table, np.uint16).reshape(-1, 4) for r in x.filters.collect()}
        assert all(line_dedup.CuckooFilter(tables[int(p)]).holds(line_dedup._hashes([k]))[0] for k, p in zip(found, line_dedup._shards(found, 2)))
        assert sum((t > 0).sum() for t in tables.values()) == n


def test_cuckoo_filter():
    rng = np.random.default_rng(2)
    h = rng.integers(0, 1 << 63, 5000).astype(np.uint64)
    made = line_dedup.CuckooFilter.of(h)
    assert made.holds(h).all()
    assert made.holds(rng.integers(0, 1 << 63, 20000).astype(np.uint64)).mean() < 0.01
    for x in h[:2500].tolist():
        made.delete(x)
    assert made.holds(h[2500:]).all() and made.holds(h[:2500]).mean() < 0.01


def brute_repeats(rows, length):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for at in range(len(raw) - length + 1):
            piece = raw[at : at + length]
            if piece in seen:
                gone[at : at + length] = True
            seen.add(piece)
        spans = int((np.diff(np.concatenate([[False], gone]).astype(int)) == 1).sum())
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        out[i] = (len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_dedup(spark, edges, none):
    rng = random.Random(7)
    base = "".join(rng.choice("abcd é") for _ in range(1500))
    rows = []
    for i in range(50):
        t = "".join(rng.choice("abcd é") for _ in range(rng.randint(0, 300)))
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, 1400)
            t += base[at : at + rng.randint(60, 260)]
        rows.append((i, t))
    rows += [(100, "ab" * 300), (101, "a" * 700), (102, "a" * 99), (103, None), (104, ""), (105, base), (106, base), (None, base[200:500])]
    got = {r[0]: tuple(r[1:5]) for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_repeats(rows, 100)
    same = suffix_dedup.remove_repeats(edges).where("doc_id = 1").collect()
    assert len(same) == 2 and same[0] == same[1]
    assert suffix_dedup.remove_repeats(edges).count() == len(EDGES)
    assert suffix_dedup.remove_repeats(none).count() == 0


@pytest.mark.parametrize("parts", [1, 12])
def test_equal_rows_keep_their_text(spark, parts):
    rng = random.Random(11)
    a, b, c = ("".join(rng.choice("abcd é") for _ in range(n)) for n in (500, 700, 400))
    rows = [(7, a), (8, c + a[100:400] + b), (None, b), (9, "x" * 300), (10, b)]
    want = brute_repeats(rows, 100)
    df = spark.createDataFrame(rows * 3, "doc_id long, text string").repartition(parts)
    got = sorted((r[0] is not None, r[0] or 0, *r[1:5]) for r in suffix_dedup.remove_repeats(df).collect())
    assert got == sorted((i is not None, i or 0, *want[i]) for i, _ in rows * 3)
    nulls = [(None, b), (None, c + c[:150])]  # two documents without an id that share no window
    df = spark.createDataFrame(nulls * 2, "doc_id long, text string").repartition(parts)
    got = sorted(r[1:5] for r in suffix_dedup.remove_repeats(df).collect())
    assert got == sorted(brute_repeats([n], 100)[None] for n in nulls * 2)


@pytest.mark.parametrize("batch", [1, 2, 3, 10_000])
def test_one_line_in_many_surroundings_meets_over_batches(spark, batch):
    rng = random.Random(5)
    line = "".join(rng.choice("abcd é") for _ in range(90))
    rows = [(i, "".join(rng.choice("ab") for _ in range(rng.choice([3, 6, 40]))) + line + rng.choice("ab") * rng.choice([5, 40])) for i in range(60)]
    rows += [(200, line * 3), (201, None), (202, line + "b" * 300 + line)]
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, batch)
    try:
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        got = {r[0]: tuple(r[1:5]) for r in suffix_dedup.remove_repeats(df).collect()}
    finally:
        spark.conf.set(setting, before)
    assert got == brute_repeats(rows, 100)


def test_long_text_crosses_segments(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 1023)
    monkeypatch.setattr(suffix_dedup, "PLACE_BITS", 10)
    raw = np.random.default_rng(0).integers(0, 3, 5000).astype(np.uint8)
    anchor, first, last, content = suffix_dedup.stretches(raw, 100, 32)
    assert first[0] == 0 and last[-1] == 4900 and (first[1:] == last[:-1] + 1).all()


def test_run_length_index():
    rng = random.Random(4)
    strings = ["".join(rng.choice("ab") for _ in range(rng.randint(5, 60))).encode() for _ in range(30)]
    index = suffix_dedup.RunLengthIndex(strings)
    text = [tuple(s[j:] for j in range(len(s) + 1)) for s in strings]
    suffixes = [x for group in text for x in group]
    order = sorted(range(len(suffixes)), key=lambda p: (suffixes[p] + b"", p))
    # Terminators sort below all symbols and among each other by place, so a plain sort with ties by place is the order.
    assert index.order.tolist() == order
    match = index.matching_statistics()
    for above, below in zip(order, order[1:]):
        a, b = suffixes[above], suffixes[below]
        n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert match[below] == n
    assert len(index.heads) < len(index.text)


def words(t, n):
    w = [x for x in (t or "").encode().lower().split()]
    if not w:
        return set()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))}


def test_ngram_join(spark, edges, none):
    rng = random.Random(9)
    rows, base = [], [[f"w{rng.randint(0, 400)}" for _ in range(rng.randint(1, 120))] for _ in range(12)]
    for i in range(150):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 6])):
            w[rng.randrange(len(w))] = f"x{rng.randint(0, 50)}"
        rows.append((i, " ".join(w)))
    rows += [(500, None), (501, ""), (502, "one"), (503, "ONE"), (504, "one two"), (505, " \n")]
    for n, percent, block, run, sent in ((3, 90, 1024, 64, 1000), (5, 80, 4, 2, 0)):
        sets = [words(t, n) for _, t in rows]
        pairs = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
        roots = roots_of(len(rows), np.array(pairs, np.int64).reshape(-1, 2))
        want = {i: (len(s), rows[r][0]) for (i, _), s, r in zip(rows, sets, roots.tolist())}
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), n, percent, pair_run=run, block=block, broadcast_rows=sent).collect()}
        assert got == want
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_classes(edges).collect()]
    assert len(got) == len(EDGES) and got.count((1, 2, 1)) == 2 and (None, 3, None) in got and (2, 0, 2) in got
    assert ngram_join.jaccard_classes(none).count() == 0


def test_shingles_follow_words():
    assert len(word_hashes(b"")) == len(word_hashes(b" \t\n")) == 0
    a = word_hashes(b"ab cd  ab")
    assert a[0] == a[2] != a[1]
    assert len(shingle_set(b"A b c A b c", 3)) == 3
    assert (shingle_set(b"A b", 3) == shingle_set(b" a\tB ", 3)).all()


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)] + [(7, 7)]
    df = spark.createDataFrame(pairs + [(None, 3)], "a long, b long")
    roots = roots_of(140, np.array(pairs, np.int64))
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert {r.node: r.component for r in connected_components(df).collect()} == {x: int(roots[x]) for x in linked}
    assert connected_components(df.limit(0)).count() == 0


def test_mixing(spark, edges, none):
    rng = random.Random(2)
    rows = [(i, " ".join("w" for _ in range(rng.randint(0, 200))), rng.choice(["b", "a", "é", "hot", "hot", "hot", None])) for i in range(300)] + [(None, "a b", "a"), (7, None, "zero")]
    df = frame(spark, rows)
    got = mixing.mix(df, shards=5, block_words=300, block_rows=10).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    names = sorted((s for s in sizes if s is not None)) + [None]
    weights = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    total, target, free = sum(sizes.values()), {}, set(names)
    while True:
        level = (total - sum(3 * sizes[s] for s in names if s not in free)) / sum(weights[s] for s in free)
        over = {s for s in free if weights[s] * level > 3 * sizes[s]}
        if not over:
            break
        free -= over
    target = {s: weights[s] * level if s in free else 3 * sizes[s] for s in names}
    taken, shards = Counter(), Counter()
    for r in got:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == sizes[r.source]
        assert 0 <= r.taken <= 3 * r.size and r.taken == sum(d.words for d in r.draws)
        taken[r.source] += r.taken
        shards.update(d.shard for d in r.draws)
    assert all(abs(taken[s] - target[s]) <= 1 for s in names)
    assert set(shards) <= set(range(5)) and len(shards) == 5
    again = mixing.mix(df, shards=5, block_words=300, block_rows=10)
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.taken)
    assert sorted(again.collect(), key=key) == sorted(got, key=key)
    assert mixing.mix(none).count() == 0
    assert mixing.mix(edges).count() == len(EDGES)


def test_split_quotas(spark):
    quota = [1000, 50, 0, 7, 333]
    df = spark.createDataFrame([(quota,)], "quota array<long>")
    leaves = [r.quota for r in mixing.split_quotas(df, 7, 3).orderBy("shard").collect()]
    assert len(leaves) == 7 and [sum(x) for x in zip(*leaves)] == quota
    assert max(map(sum, leaves)) - min(map(sum, leaves)) <= 3
    many = spark.range(4000).select(mixing.hypergeometric(F.lit(50), F.lit(20), F.lit(10), (F.col("id") + 0.5) / 4000).alias("k"))
    k = np.array([r.k for r in many.collect()])
    assert abs(k.mean() - 4) < 0.02 and abs(k.var() - 10 * 0.4 * 0.6 * 40 / 49) < 0.05


def test_write_shards(spark, tmp_path):
    df = frame(spark, [(i, "a b c", "s") for i in range(50)])
    mixed = mixing.mix(df, shards=3, block_rows=5)
    mixing.write_shards(mixed, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.agg(F.sum("words")).first()[0] == mixed.agg(F.sum("taken")).first()[0]


def test_embedding_dedup(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((60, 16))
    rows = [(i, base[i].tolist()) for i in range(60)]
    rows += [(100 + i, (base[i % 7] * rng.uniform(0.1, 9) + rng.normal(0, 0.05, 16)).tolist()) for i in range(80)]
    rows += [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] + [1.0] * 15), (904, [None] + [1.0] * 15), (905, [1.0, 2.0]), (906, [1.0, 2.0]), (None, base[0].tolist())]
    df = spark.createDataFrame([(i, e, "x", 1) for i, e in rows], "vec_id long, embedding array<double>, row string, n_links int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df, block=16).collect()}

    def fit(e):
        return e and None not in e and np.isfinite(e).all() and any(e)

    pairs = []
    for a in range(len(rows)):
        for b in range(a):
            x, y = rows[a][1], rows[b][1]
            if fit(x) and fit(y) and len(x) == len(y) and np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y) >= 0.95:
                pairs.append((a, b))
    roots = roots_of(len(rows), np.array(pairs))
    n = Counter(x for p in pairs for x in p)
    for k, (i, _) in enumerate(rows):
        assert got[i] == (n[k], rows[roots[k]][0])
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_code_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(1)
    turn = embedding_dedup.rotations(64, 256, 0) / 2
    x = rng.standard_normal((400, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = 0.8 * x + 0.6 * np.roll(x, 1, 0)
    y /= np.linalg.norm(y, axis=1)[:, None]
    turned = x @ turn
    factor = np.abs(turned).sum(1) / 16
    estimate = (np.where(turned >= 0, 1, -1) / 16 * (y @ turn)).sum(1) / factor
    error = estimate - (x * y).sum(1)
    assert abs(error.mean()) < 0.01
    assert (np.abs(error) <= 5 * np.sqrt(1 - factor**2) / factor / np.sqrt(255)).all()


def test_top_k(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.integers(-2, 3, 6).astype(float).tolist()) for i in range(300)]
    rows += [(1000, None), (1020, [float("inf")] * 6), (1040, [None] * 6), (1060, [1.0]), (1080, []), (None, [1.0] * 6), (20, [2.0] * 6)]
    df = spark.createDataFrame([(i, e, 1) for i, e in rows], "vec_id long, embedding array<double>, score int")
    sound = [(i, np.floor(64 * np.pad(np.array(e, float), (0, 6 - len(e)))).astype(int)) for i, e in rows if i is not None and e is not None and None not in e and np.isfinite(e).all()]
    got = {}
    for r in knn_join.top_k(df, F.col("vec_id") % 20 == 0, 5, group_queries=4, block_rows=50).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.score, r.vec_id)
    first = {}
    for i, e in sound:
        if i % 20 == 0:
            first.setdefault(i, []).append(e)
    assert got.keys() == first.keys()
    for q, vs in first.items():
        options = [[(s, -j) for s, j in sorted(((int(v @ e), -i) for i, e in sound if i != q), reverse=True)[:5]] for v in vs]
        assert [(got[q][r][0], -got[q][r][1]) for r in sorted(got[q])] in [[(s, -j) for s, j in o] for o in options]
    assert knn_join.top_k(df.limit(0), F.col("vec_id") % 20 == 0, 5).count() == 0
    huge = spark.createDataFrame([(0, [1e300, 1.0]), (1, [1e300, 2.0]), (2, [-1e300, 0.0])], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in knn_join.top_k(huge, F.col("vec_id") == 0, 2).orderBy("rank").collect()] == [1, 2]


def test_toxicity(spark, edges, none):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    model = toxicity.fit(docs, labels.where(~held))
    assert (np.diff(model.thresholds) > 0).all()
    out = toxicity.score(docs, model).join(labels.where(held).select("doc_id", F.col("toxic").alias("y")), "doc_id")
    hit = {(r.y, r.toxic): r.n for r in out.groupBy("y", "toxic").agg(F.count("*").alias("n")).collect()}
    # Some labels are noise: held-out rows called toxic whose texts hold nothing of the kind.
    assert hit.get((0, True), 0) <= 0.02 * hit[0, False]
    assert hit[1, True] >= 2 * hit.get((1, False), 0)
    scored = toxicity.score(edges, model)
    assert scored.count() == len(EDGES) and scored.where("doc_id in (2, 3)").where("toxic").count() == 0
    assert toxicity.score(none, model).count() == 0
    clean = toxicity.fit(docs, labels.limit(0))
    assert toxicity.score(edges, clean).where("toxic").count() == 0


def test_severity_rises_with_grade(spark):
    rows = [(i, " ".join(["calm word"] * 20 + ["awful"] * (i % 4) * 2)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 4) for i in range(400)] + [(None, 1), (5, None), (9999, 1)], "doc_id long, grade int")
    scored = toxicity.score(docs, toxicity.fit(docs, labels)).groupBy((F.col("doc_id") % 4).alias("g")).agg(F.avg("severity").alias("s")).orderBy("g").collect()
    s = [r.s for r in scored]
    assert s == sorted(s) and s[3] > s[0] + 1


def test_words_with_equal_polynomials_stay_apart(spark):
    # The Thue-Morse word and its complement have the same polynomial modulo 2**64 for every odd base.
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    b = a.translate(str.maketrans("ab", "ba"))
    assert word_hashes(a.encode())[0] != word_hashes(b.encode())[0]
    rows = [(1, a), (2, b), (3, f"{a} x y"), (4, f"{b} x y"), (5, a)]
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}


def test_line_filters_decide_at_every_size(spark, monkeypatch):
    rows = [(i, f"common\nown {i}\nfew {i % 40}") for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    index = line_dedup.LineIndex.build(df, 10, shards=4)
    want = brute_lines(rows, 10)
    take = lambda out: Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in out.collect())
    for how in ({"indexed": True}, {}, {"broadcast_keys": 0}):
        assert take(line_dedup.drop_frequent_lines(df, index, **how)) == want
    # Without filters nothing may be dropped: they are asked in every way.
    blind = line_dedup.LineIndex(index.counts, index.filters.limit(0), 10, 4, 1)
    for how in ({"indexed": True}, {}, {"broadcast_keys": 0}):
        assert sum(r.n_dropped for r in line_dedup.drop_frequent_lines(df, blind, **how).collect()) == 0
    # Filters that hold everything decide nothing wrong: the exact counts settle what they hold wrongly.
    full = np.arange(1, 65536, dtype=np.uint16)
    tables = [(s, np.tile(full, 4)[: 4 * (1 << 16) // 4 * 4].tobytes()) for s in range(4)]
    monkeypatch.setattr(line_dedup.CuckooFilter, "holds", lambda self, hashes: np.ones(len(hashes), bool))
    assert tables and Counter(line_dedup._passing([line_dedup.digest(b"x")], {s: full for s in range(4)}, 4).tolist()) == {True: 1}
    unseen = spark.createDataFrame([(1, "never seen\ncommon")], "doc_id long, text string")
    assert line_dedup.drop_frequent_lines(unseen, index).first().kept == "never seen"


def test_clashing_columns_of_the_join(spark):
    df = spark.createDataFrame([(i, "a\nb", 1, "x", 2) for i in range(12)], "doc_id long, text string, row int, DROPS string, row_ int")
    out = line_dedup.dedup_lines(df, 10, broadcast_keys=0)
    assert out.columns == [*df.columns, "n_lines", "n_dropped", "kept"]
    assert {tuple(r) for r in out.select("row", "DROPS", "row_", "kept").collect()} == {(1, "x", 2, "")}


def test_every_text_goes_through_the_transducer(spark, monkeypatch):
    bpe = load(WordBpe, WORD)
    fed = []
    real = bpe_stream.StreamEncoder.feed
    monkeypatch.setattr(bpe_stream.StreamEncoder, "feed", lambda self, text: fed.append(text) or real(self, text))
    for text in ("short", "“curly” — ½ 日本語 Σς", "<|endoftext|> x", "y" * 70_000):
        fed.clear()
        assert bpe_stream.encode(bpe, text).tolist() == bpe.library.encode(text, add_special_tokens=False).ids
        assert "".join(fed) == text


def test_streaming_encoder_on_odd_texts():
    bpe, rng = load(WordBpe, WORD), random.Random(8)
    some = ["a", "b", "é", "é", "́", "Σ", "σ", "İ", "日", "本", "。", "’", "'", "s", "ll", " ", "\n", "\t", "　", "\xa0", "1", "½", "-", "<|endoftext|>", "<|", "endoftext", "|>", "\x01", "한", "ᄒ", "ᅡ", "ᆫ", "🙂", "<|ENDOFTEXT|>"]
    for _ in range(400):
        text = "".join(rng.choice(some) for _ in range(rng.randint(0, 60)))
        want = bpe.library.encode(text, add_special_tokens=False).ids
        for size in (3, 17, 1 << 16):
            assert bpe_stream.encode(bpe, text, size).tolist() == want
    for text in ("".join(rng.choice("日本語。中文，a1") for _ in range(30_000)), "日" * 20_000, "-" * 15_000 + "<|endoftext|>" + "a" * 20_000 + "Σ" * 9_000):
        assert bpe_stream.encode(bpe, text, 5000).tolist() == bpe.library.encode(text, add_special_tokens=False).ids


def test_counts_of_long_texts_without_blanks(spark):
    t, rng = library(BYTE), random.Random(6)
    texts = ["".join(rng.choice(x) for _ in range(40_000)) for x in ("日本語。中文，a1", "abcdXYZ0123456789+/", "if(a)b=1;{}'s\"", "aé.\n")]
    texts += ["".join(rng.choice(["<|endoftext|>", "a", "'s", "1", "日", "\t", "_"]) for _ in range(20_000)), "x" * 90_000]
    got = token_counts.count_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), BYTE, chunk=4096, overlap=64)
    assert {r.doc_id: r.n_tokens for r in got.collect()} == {i: len(t.encode(x, add_special_tokens=False).ids) for i, x in enumerate(texts)}
    bpe, largest = load(ByteBpe, BYTE), []
    real = bpe.encode_with_ends
    bpe.encode_with_ends = lambda text: largest.append(len(text)) or real(text)
    for x in texts[:4]:
        token_counts.spliced(bpe, x, 4096, 64)
    del bpe.encode_with_ends
    assert max(largest) <= 3 * 4096  # no text without blanks is encoded in one piece


def test_mix_takes_what_the_tree_deals(spark, monkeypatch):
    rows = [(i, "a b c d", "s" if i % 3 else "t") for i in range(90)]
    df = frame(spark, rows)
    whole = {r.doc_id: r.taken for r in mixing.mix(df, shards=4, block_words=20).collect()}
    real = mixing.split_quotas
    monkeypatch.setattr(mixing, "split_quotas", lambda quotas, shards, seed=0: real(quotas, shards, seed).where("shard < 2"))
    half = mixing.mix(df, shards=4, block_words=20).collect()
    assert 0 < sum(r.taken for r in half) < sum(whole.values())  # draws that no leaf's quota holds are not taken


def test_estimates_by_common_bits():
    rng = np.random.default_rng(4)
    turn = embedding_dedup.rotations(64, 256, 0) / 2
    x = rng.standard_normal((3000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = 0.8 * x + 0.6 * np.roll(x, 1, 0)
    y /= np.linalg.norm(y, axis=1)[:, None]
    code, factor, _, _, _ = embedding_dedup.encoded(x @ turn, np.random.default_rng(0))
    _, _, planes, low, step = embedding_dedup.encoded(y @ turn, np.random.default_rng(1))
    code, planes = (np.ascontiguousarray(a).view("<u8") for a in (code, planes))
    truth = (x * y).sum(1)
    assert abs((embedding_dedup.estimates(code, factor, planes, low, step, 256) - truth).mean()) < 0.005
    assert (embedding_dedup.upper_bounds(code, factor, planes, low, step, 256, 5.0) >= truth).all()


def test_components_travel_only_for_rows_left(spark, monkeypatch):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((400, 64))
    rows = [(i, b.tolist()) for i, b in enumerate(base)] + [(1000 + i, (base[i] + rng.normal(0, 0.01, 64)).tolist()) for i in range(5)]
    seen = {}
    real = embedding_dedup.written
    monkeypatch.setattr(embedding_dedup, "written", lambda df, label: seen.setdefault(label, real(df, label)))
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted(r.vec_id for r in got if r.n_links) == [*range(5), *range(1000, 1005)]
    assert 10 <= seen["vector-candidates"].select("row").distinct().count() < 60


def test_cells_rule_out_what_is_far(spark):
    rng = np.random.default_rng(7)
    centers = 40 * rng.standard_normal((12, 8))
    rows = [(i, (centers[i % 12] + rng.standard_normal(8)).tolist()) for i in range(1200)]
    df, q = spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0
    ints = np.floor(64 * np.array([e for _, e in rows])).astype(np.int64)
    want = {(i, rank): (j, s) for i in range(0, 1200, 20) for rank, (s, j) in enumerate(sorted(((int(ints[i] @ ints[j]), j) for j in range(1200) if j != i), key=lambda x: (-x[0], x[1]))[:5], 1)}
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in knn_join.top_k(df, q, 5, cell_rows=40, block_rows=30).collect()}
    assert got == want
    asked = knn_join.cells_asked(df, q, 5, cell_rows=40)
    assert asked.agg(F.avg("n_rows")).first()[0] < 0.6 * 1200  # fails when every query goes everywhere


def test_ordinal_likelihood_and_gradient():
    """The fit is a stationary point of the penalised likelihood, written out row by row."""
    rng = np.random.default_rng(0)
    n, width, grades, ridge = 300, 3, 4, 1e-2
    x = rng.poisson(1.0, (n, width)).astype(float)
    score = x @ np.array([1.5, -0.5, 0.8]) + rng.logistic(size=n)
    grade = np.searchsorted([0.5, 1.5, 3.0], score)
    row, column = np.nonzero(x)
    weights, bars = toxicity._cumulative_link(row, column, x[row, column], grade, width, grades, ridge, 3000)

    def loss(w, b):
        total = 0.0
        for features, g in zip(x, grade):
            above = [1.0, *(1 / (1 + np.exp(t - features @ w)) for t in b), 0.0]
            total -= np.log(above[g] - above[g + 1]) / n
        return total + ridge * (w**2).sum() / 2 / width**0.5

    least = loss(weights, bars)
    for k in range(width):
        for d in (-0.05, 0.05):
            moved = weights.copy()
            moved[k] += d
            assert loss(moved, bars) > least
    for k in range(grades - 1):
        for d in (-0.05, 0.05):
            moved = bars.copy()
            moved[k] += d
            assert loss(weights, moved) > least


def test_scores_by_hand(spark, edges):
    model = toxicity.SeverityModel({f: i for i, f in enumerate(dict.fromkeys(x for w in ("awful", "line") for x in toxicity.word_features(w)))}, np.linspace(0.5, 1.5, 8), np.array([0.5, 1.0, 2.0]))
    for r in toxicity.score(edges, model).collect():
        counts = Counter(f for w in toxicity.WORD.findall((r.text or "").lower()) for f in toxicity.word_features(w) if f in model.chosen)
        s = sum(model.weights[model.chosen[f]] * np.log1p(n) for f, n in counts.items())
        chances = [1 / (1 + np.exp(b - s)) for b in model.thresholds]
        ladder = [1.0, *chances, 0.0]
        assert r.severity == pytest.approx(sum(chances)) and r.toxic == (chances[0] >= 0.5)
        assert r.grade == max(range(4), key=lambda g: ladder[g] - ladder[g + 1])
