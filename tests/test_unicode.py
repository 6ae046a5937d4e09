"""Normal forms and repair of wrong decodings against unicodedata and a loop, over all code points."""

import random
import unicodedata

from pyspark.sql import functions as F

from sparkloom.functions import text, unicode


def columns(spark, texts, **of):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return sorted(tuple(r) for r in df.select("i", *(f("t").alias(n) for n, f in of.items())).collect())


def test_forms_of_all_code_points(spark):
    points = [p for p in range(0x110000) if not 0xD800 <= p < 0xE000]
    texts = ["x".join(map(chr, points[i : i + 50])) for i in range(0, len(points), 50)]
    texts += ["e" + chr(p) + "̣́" for p in range(0x250)]
    got = columns(spark, texts, bare=unicode.unmarked, composed=unicode.nfkc)
    assert got == [(i, unicode.without_marks(t), unicodedata.normalize("NFKC", t)) for i, t in enumerate(texts)]


def test_plain_characters_stay_in_the_jvm(spark):
    """What the classes let through is neither changed by NFKC nor drawn together with a neighbour."""
    plain = let_through(unicode.NEEDS_NFKC)
    rng = random.Random(1)
    for _ in range(300):
        s = "".join(chr(rng.choice(plain)) for _ in range(200))
        assert unicodedata.is_normalized("NFKC", s)
    assert len(plain) > 20_000


def let_through(pattern):
    """Code points that a negated class of ranges does not match."""
    runs = pattern.removeprefix("[^\\x00-\\x7F").removesuffix("]").replace("}\\x", "} \\x").split(" ")
    ends = [tuple(int(x, 16) for x in r.replace("\\x{", "").replace("}", "").split("-")) for r in runs]
    return [*range(0x80), *(p for a, b in ends for p in range(a, b + 1))]


def test_fold(spark):
    texts = ["ﬁ ½ Ａ", "  ÀÉ　ß\x1c Œ\n", "Ǻ é é ё й", "", None, "İı ẞ", "日本 が"]
    got = columns(spark, texts, folded=text.fold, canonical=text.canonical)
    assert got[0][1] == "fi 1⁄2 a" and got[1][1] == "ae ß œ" and got[2][1] == "a e e е и" and got[3][1] == "" and got[4][1] is None
    assert got[5][1] == "iı ß" and got[6][1] == "日本 か"
    assert columns(spark, ["a\r\nb\rc\n\n\n\nd \t e  ", None], canonical=text.canonical) == [(0, "a\nb\nc\n\nd e"), (1, "")]


def test_quality_looks_at_the_normal_form(spark):
    df = spark.createDataFrame([("ﬁ" * 10,), ("fi" * 10,)], "t string")
    assert {r.chars for r in df.select(text.quality("t").alias("q")).select("q.chars").collect()} == {20}


def garbled(s, encoding):
    return s.encode().decode(encoding, "replace" if encoding == "cp1252" else "strict")


def test_repair(spark):
    word = "señor über façade älter"
    texts = [word, "“quoted” – text… with euro € and 日本", garbled(word, "latin-1"), garbled(word + " “x” 5 – 7", "cp1252"), "Ã© once", garbled("é à", "latin-1"), "", None, "Ã Ã Ã", "â€™ â€™ â€œ", garbled("naïve 日本 ñ é", "latin-1") + " 日", "Âº 20 Â° Â  x", "��� plain"]
    want = [word, texts[1], word, None, "Ã© once", texts[5], "", None, "Ã Ã Ã", "' ' \"", "naïve 日本 ñ é ", "º 20 °  x", texts[12]]
    got = columns(spark, texts, fixed=unicode.repair)
    for (i, fixed), expected in zip(got, want, strict=True):
        if i not in (3, 8, 11):
            assert fixed == expected, i
    assert got[3][1].startswith(word)
    assert "Â" not in got[11][1]
    rng = random.Random(4)
    odd = ["".join(rng.choice("ÃÂâ€™œ\x80\x81\x9dé日a ”�") for _ in range(rng.randint(0, 30))) for _ in range(400)]
    looped = [unicode.repaired(t) if sum(t.count(m) for m in unicode.MARKERS) >= unicode.LEAST_MARKERS else t for t in odd]
    assert [r[1] for r in columns(spark, odd, fixed=unicode.repair)] == looped


def test_marker_count(spark):
    texts = ["â€™ Ã Â", "plain", "â€“â€”"]
    assert [r[1] for r in columns(spark, texts, n=unicode.count_markers)] == [4, 0, 4]
    assert columns(spark, ["a"], n=lambda c: F.length(unicode.repair(c))) == [(0, 1)]
