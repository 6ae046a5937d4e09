"""Substring removal, source audit and vector codes against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
from pyspark.sql import functions as F  # noqa: E402

from sparkloom.llm import source_audit, substring_dedup, vector_codes  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, row long, doc string, words int, place string"
SPACE = r"[^\x20\x09-\x0D]+"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, 1, "k", 5, "d", 7, "x") for i, t, lang, s in rows], SCHEMA)


def kept_words(rows, length):
    docs = [re.findall(SPACE, t or "") for _, t, *_ in rows]
    seen = Counter(tuple(w[i : i + length]) for w in docs for i in range(len(w) - length + 1))
    out = []
    for (i, *_), w in zip(rows, docs, strict=True):
        gone = set()
        for at in range(len(w) - length + 1):
            if seen[tuple(w[at : at + length])] > 1:
                gone.update(range(at, at + length))
        left = [x for at, x in enumerate(w) if at not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(left).encode()).hexdigest()))
    return Counter(out)


def removed(df, **how):
    return Counter(tuple(r) for r in substring_dedup.remove_repeats(df, **how).select("doc_id", "n_words", "n_removed", "kept_sha256").collect())


def prose(seed, docs, kinds=400):
    """Texts from passages, shared ones among them, cut at random and changed in places."""
    rng = random.Random(seed)
    shared = [[f"w{rng.randint(0, kinds)}" for _ in range(rng.randint(5, 60))] for _ in range(6)]
    rows = []
    for i in range(docs):
        words = []
        for _ in range(rng.randint(0, 6)):
            if rng.random() < 0.6:
                passage = list(rng.choice(shared))
                if rng.random() < 0.5:
                    passage[rng.randrange(len(passage))] = f"x{rng.randint(0, 3)}"
                words += passage[rng.randint(0, 3) : len(passage) - rng.randint(0, 3)]
            else:
                words += [f"é{rng.randint(0, kinds)}" for _ in range(rng.randint(1, 30))]
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(words), "en", "a"))
    return rows


@pytest.mark.parametrize("crowd,group", [(64, 4096), (1, 4096), (64, 2)])
def test_repeated_windows_go(spark, monkeypatch, crowd, group):
    """Extension, spread anchors and windows all give what brute force gives."""
    monkeypatch.setattr(substring_dedup, "CROWD", crowd)
    monkeypatch.setattr(substring_dedup, "GROUP", group)
    if crowd == 1:
        monkeypatch.setattr(substring_dedup, "SAMPLE_ONE_IN", 1)
    rows = prose(crowd + group, 150)
    assert removed(frame(spark, rows), length=12, k=5) == kept_words(rows, 12)


def test_extension_in_small_alphabets(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 40))), "en", "a") for i in range(120)]
    for length, k in ((6, 2), (6, 6), (9, 4), (3, 5), (1, 1)):
        assert removed(frame(spark, rows), length=length, k=k) == kept_words(rows, length)


def test_repeats_in_odd_rows(spark):
    line = " ".join(map(str, range(40)))
    rows = [(1, line, "en", "a"), (1, line, "en", "a"), (None, line + " z", None, None), (None, line + " z", None, None), (2, None, "en", "b"), (3, "", "en", "b"), (4, "a " * 5000, "en", "b"), (5, "x" * 100_000, None, "b"), (6, " \t\n\x0b\x1c\x85 ", "en", None), (7, "y " * 34, "en", "c")]
    assert removed(frame(spark, rows)) == kept_words(rows, 35)
    assert removed(frame(spark, [])) == Counter()
    kept = substring_dedup.remove_repeats(frame(spark, rows), keep_text=True).where("doc_id = 4").first()
    assert bytes(kept.kept) == b"" and list(kept.spans) == [0, 5000]


def test_equal_windows_share_seeds_across_pieces(monkeypatch):
    """Each window lies in one stretch, and equal windows have equal anchors at equal places, in any piece of a text."""
    monkeypatch.setattr(substring_dedup, "SEGMENT", 127)
    rng = random.Random(3)
    words = [f"{rng.randint(0, 3)}".encode() for _ in range(900)]
    words[300:420] = words[10:130]
    met, windows = defaultdict(set), []
    for key, _, _, first, more, left in substring_dedup.seeds(substring_dedup.word_lanes(b" ".join(words)), 8, 3).T.tolist():
        for w in range(first, first + more + 1):
            windows.append(w)
            met[tuple(words[w : w + 8])].add((key, left - (w - first)))
    assert windows == list(range(893)) and all(len(x) == 1 for x in met.values())


def audited(rows, min_docs, top):
    """The audit with Python's integers."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lower))
        groups[lang or ""].add(source or "")
        counts[lang or "", source or ""].update(words)
        docs[lang or ""].update(set(words))
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        of_lang = {t: sum(counts[lang, s][t] for s in sources) for t in kept}

        def shares(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 2) // (total + 2 * len(kept)) for t in kept}

        def far(p, q):
            return (p - q) ** 2 // (p + q)

        p, q = {s: shares(counts[lang, s]) for s in sources}, shares(of_lang)
        for s in sources:
            pairs = [(-sum(far(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            terms = [(-far(p[s][t], q[t]), t.encode(), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out |= {(lang, s, part, item, -v, rank) for rank, (v, _, item) in enumerate(items, 1)}
    return out


def talk(seed, n):
    rng = random.Random(seed)
    words = ["The", "the", "straße", "É", "é", "x1y", "a-b", "日本", "o'neil"] + [f"{a}{b}" for a in "abcdefgh" for b in "xyzw"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 30))) for _ in range(n // 2)] + [None, "", "12 .. \x00"]
    return [(i, rng.choice(texts), rng.choice(["en", "de", None, "", "fr"]), rng.choice(["s1", "s2", "S", None, "é"])) for i in range(n)] + [(n, "only", "xx", "alone"), (n, "only", "xx", "alone")]


@pytest.mark.parametrize("block,bucket,hold", [(128, 4096, (1 << 16, 1 << 21, 1 << 18)), (2, 7, (3, 20, 5))])
def test_source_audit(spark, block, bucket, hold):
    """Also with several blocks of sources and buckets of terms, and tasks that send early what they hold."""
    rows = talk(block, 300)
    got = source_audit.audit(frame(spark, rows), min_docs=3, top=4, block=block, bucket_terms=bucket, hold=hold).collect()
    assert len(got) == len(set(map(tuple, got)))
    assert {tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in got} == audited(rows, 3, 4)


def test_source_audit_of_nothing(spark):
    assert source_audit.audit(frame(spark, [])).count() == 0
    rows = [(1, None, None, None), (2, "word", "en", "a"), (3, None, "en", "b")]
    assert {tuple(r[:5]) for r in source_audit.audit(frame(spark, rows)).select("lang", "source", "part", "item", "value").collect()} == {("en", "a", "pair", "b", 0), ("en", "b", "pair", "a", 0)}


def test_copies_are_sent_once_a_task(spark):
    rows = [(i, "same text of all", "en", f"s{i % 3}") for i in range(90)]
    sent = source_audit.collapsed(frame(spark, rows).repartition(3)).collect()
    assert sum(r.text is not None for r in sent) <= 3 and sum(sum(r.counts) for r in sent) == 90


def coded(rows, scale=256, rounds=2):
    """Codes with Python's integers."""
    good = [(i, e, lab) for i, e, lab in rows if e and len(e) % 16 == 0 and all(x is not None and np.isfinite(x) for x in e)]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    good = [r for r in good if len(r[1]) == len(good[0][1])]
    if not good:
        return Counter()
    width = len(good[0][1]) // 16
    whole = [[int(x * scale // 1) if abs(x) < 2**50 else int(x) * scale for x in map(float, e)] for _, e, _ in good]
    parts = [[tuple(v[p * width : (p + 1) * width]) for v in whole] for p in range(16)]
    books = [column[:64] for column in parts]

    def near(book, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), i) for i, c in enumerate(book))

    for _ in range(rounds):
        for p, book in enumerate(books):
            members = defaultdict(list)
            for x in parts[p]:
                members[near(book, x)[1]].append(x)
            books[p] = [tuple(sum(c) // len(members[i]) for c in zip(*members[i], strict=True)) if members[i] else old for i, old in enumerate(book)]
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    out, sums = [], Counter()
    top = (1 << 63) - 1
    for r, (i, _, lab) in enumerate(good):
        found = [near(books[p], parts[p][r]) for p in range(16)]
        error = min(top, sum(f[0] for f in found))
        sums[lab] += error
        out.append((i, "".join(f"{f[1]:02x}" for f in found), error, lab))
    return Counter((i, code, e, min(top, sums[lab]), digest) for i, code, e, lab in out)


def compressed(spark, rows, kind="float", **how):
    df = spark.createDataFrame([(i, e, lab, "x", 1) for i, e, lab in rows], f"vec_id long, embedding array<{kind}>, label int, code string, error int")
    return Counter(tuple(r) for r in vector_codes.compress(df, **how).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect())


def test_vector_codes(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(size=32)], int(rng.integers(0, 4)) if i % 5 else None) for i in rng.permutation(300)]
    rows += [(7, rows[0][1], 1), (None, rows[1][1], 2), (900, None, 1), (901, [1.0, None] * 16, 1), (902, [float("nan")] * 32, 1), (903, [float("inf")] * 32, 1), (904, [1.0] * 16, 1), (905, [], 1), (906, [1.0] * 30, 1), (907, [0.0] * 32, 0)]
    assert compressed(spark, rows) == coded(rows)
    assert compressed(spark, rows[:20], rounds=3) == coded(rows[:20], rounds=3)
    assert compressed(spark, []) == Counter()
    assert compressed(spark, [(1, None, 1)]) == Counter()


def test_vector_codes_of_wide_components(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-9, 9, 16) * 10.0 ** rng.choice([0, 3, 5, 6, 7, 9, 30, 300], 16)], i % 3) for i in range(150)]
    assert compressed(spark, rows, "double") == coded(rows)


def test_limbs_are_exact():
    rng = np.random.default_rng(3)
    for width in (1, 4, 7, 64):
        top = vector_codes.widest(width)
        a, b = rng.integers(-top, top + 1, (20, width)), rng.integers(-top, top + 1, (9, width))
        a[0], b[0], b[1] = top, top, -top
        assert (vector_codes.products(a, b).astype(object) == a.astype(object) @ b.astype(object).T).all()
        assert width * (1 << 2 * vector_codes.limb_bits(width)) <= 1 << 53
        at, far = vector_codes.nearest(a, b)
        want = [min((sum((int(x) - int(y)) ** 2 for x, y in zip(r, c, strict=True)), i) for i, c in enumerate(b)) for r in a]
        assert list(zip(far.tolist(), at.tolist(), strict=True)) == want
    for value in (0, 5, -5, 1 << 31, -(1 << 31), (1 << 200) + 17, -(1 << 99) - 1):
        assert sum(x << 31 * i for i, x in enumerate(vector_codes.sum_limbs(value))) == value


def test_codes_take_the_first_of_equal_entries(spark):
    rows = [(i, [0.5] * 16, 0) for i in range(70)]
    assert {r[1] for r in compressed(spark, rows)} == {"00" * 16}
