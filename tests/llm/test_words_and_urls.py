"""Resampling, spelling variants and URL rules against brute force, with awkward inputs."""

import collections
import hashlib
import math
import random
import re
import zlib

import pyarrow as pa
import pytest

from .test_llm import awkward, empty

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
CLASHES = ", weight double, rank int, score string, word string, n int, host string, path string, rule string, verdict string, prefix string, expression string, n_words int, bucket int, key int, _row int, _shapes int"


def clashing(spark, rows, schema):
    """Rows with further columns named like the operators' own."""
    extra = (0.5, 3, "s", "w", 1, "h", "p", "r", "v", "x", "e", 9, 8, 7, 6, 5)
    return spark.createDataFrame([(*r, *extra) for r in rows], schema + CLASHES)


def odd_texts(seed, n=120):
    rng = random.Random(seed)
    letters = "abcXYZ  ..09é漢\x00\x7f/:@[`{×÷Àß"
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(4, 9))) for _ in range(40)]
    out = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(n // 3)]
    out += [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 80))) for _ in range(n)]
    return [*out, None, "", " ", "É", "A", "x" * 300 + " " + "é" * 99]


# importance resampling


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def grams_of(text):
    w = words_of(text)
    return [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))]


def resampled(docs, target, percent, least, buckets=10_000):
    """(doc_id, n_features, weight, score) of each row, and those of the drawn rows in their order."""
    count = lambda ts: collections.Counter(zlib.crc32(f.encode()) % buckets for t in ts for f in grams_of(t))
    s, t = count(x for _, x in docs), count(target)
    S, T = sum(s.values()), sum(t.values())
    gain = lambda f: math.floor(1000 * math.log((t[f] + 1) * (S + buckets) / ((s[f] + 1) * (T + buckets))))
    rows = []
    for i, text in docs:
        fs = grams_of(text)
        weight = sum(gain(zlib.crc32(f.encode()) % buckets) for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    able = [r for r, (_, text) in zip(rows, docs) if len(words_of(text)) >= least]
    return rows, sorted(able, key=lambda r: (-r[3], r[0] is None, r[0] or 0))[: len(able) * percent // 100]


@pytest.mark.parametrize("seed", [1, 2])
def test_resampling_equals_brute_force(spark, seed):
    from tidemark.llm.resampling import resample

    docs = list(enumerate(odd_texts(seed)))
    docs += [docs[50], docs[50], (50, "another text of the same id " * 9), (None, "no id " * 30), (None, None)]
    target = [*odd_texts(9, 12), None]
    got = resample(clashing(spark, docs, "doc_id bigint, text string"), spark.createDataFrame([(t,) for t in target], "text string"), percent=30, min_words=12)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    got = [tuple(r) for r in got.collect()]
    rows, drawn = resampled(docs, target, 30, 12)
    assert collections.Counter(r[:4] for r in got) == collections.Counter(rows)
    ranked = sorted((r for r in got if r[4] is not None), key=lambda r: r[4])
    assert [r[4] for r in ranked] == list(range(1, len(drawn) + 1)) and [r[3] for r in ranked] == [r[3] for r in drawn]
    assert [r[0] for r in ranked] == [r[0] for r in drawn]


def test_resampling_of_nothing(spark):
    from tidemark.llm.resampling import resample

    none, some = spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame([(1, "a b c d")], "doc_id bigint, text string")
    assert resample(none, some).count() == 0
    r = resample(some, none, min_words=2).collect()
    assert len(r) == 1 and r[0]["rank"] is None  # a quarter of one is none
    assert [x["rank"] for x in resample(some, none, percent=100, min_words=2).collect()] == [1]
    assert all(x["n_features"] == 0 and x["weight"] == 0 and x["rank"] is None for x in resample(spark.createDataFrame([(2, None), (3, "")], "doc_id bigint, text string"), none, percent=100).collect())


def test_features_of_texts_over_many_pieces(monkeypatch):
    from tidemark.llm import resampling as R

    rng = random.Random(4)
    rows = ["a b", " ".join("".join(rng.choice("abcé") for _ in range(rng.randrange(1, 70))) for _ in range(4000)), "y" * 9000 + " zz " + "Q" * 9000, "", "c d e"]
    monkeypatch.setattr(R, "BLOCK", 1000)
    for grams in (1, 2, 3):
        got = [collections.Counter() for _ in rows]
        for piece in R.features(pa.array(rows), 9973, grams):
            for at, found in piece:
                for i, b in zip(at.tolist(), found.tolist()):
                    got[i][b] += 1
        for i, text in enumerate(rows):
            w = words_of(text)
            want = collections.Counter(zlib.crc32(" ".join(w[k : k + n]).encode()) % 9973 for n in range(1, grams + 1) for k in range(len(w) - n + 1))
            assert got[i] == want


def test_kth_and_ranks(spark):
    from tidemark.llm.resampling import kth, ranked

    rng = random.Random(3)
    rows = [(rng.randrange(20), rng.choice([None, 1, 2]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "a bigint, b bigint, c bigint")
    want = sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2]))
    for k in (1, 2, 77, 499, 500):
        assert tuple(kth(df, ["a", "b", "c"], k, pivots=3)) == want[k - 1]
    with pytest.raises(ValueError):
        kth(df, ["a", "b", "c"], 501)
    got = {r["c"]: r["rank"] for r in ranked(df, ["a", "b", "c"]).collect()}
    assert [r[2] for r in want] == sorted(got, key=got.get) and sorted(got.values()) == list(range(1, 501))


# spelling variants


def spelled(docs, least_n=5):
    n = collections.Counter()
    for i, text in docs:
        for run in re.findall("[a-zÀ-ÿ]+", (text or "").translate(UPPER)):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= 6:
                n[run] += 1
    n = {w: k for w, k in n.items() if k >= least_n}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    close = {w: [x for x in n if near(w, x)] for w in n}
    form = {}
    for w, xs in close.items():
        if xs:
            best = min(xs, key=lambda x: (-n[x], x))
            if n[best] >= 5 * n[w]:
                form[w] = best
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(close[w]), n[form[w]] if w in form else None))
    return out


def edited(rng, w):
    i, c = rng.randrange(len(w)), rng.choice("abcé")
    return rng.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :], w])


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_variants_equal_brute_force(spark, seed):
    from tidemark.llm.spelling import variants

    rng = random.Random(seed)
    letters = "ab" if seed == 3 else "abcdeé"
    base = ["".join(rng.choice(letters) for _ in range(rng.randrange(6, 11))) for _ in range(25)] + ["aaaaaaaa", "aaaaaaaaa", "abababab", "ababababa", "ÀÉÎõü×÷ÿ"]
    words = [x for w in base for x in [w] * 9 + [edited(rng, edited(rng, w)) for _ in range(6)] + [edited(rng, w) for _ in range(6)]]
    docs = [(i, rng.choice([" ", ", ", "1"]).join(rng.choice(words) for _ in range(rng.randrange(1, 120)))) for i in range(150)]
    docs += [(1000, " ".join(w * (1 if k else 40) for k, w in enumerate(base))), docs[3], docs[3], (None, "Abcdef " * 7), (7, None), (8, ""), (9, "short wörd " * 20)]
    got = variants(clashing(spark, docs, "doc_id bigint, text string"))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = [tuple(r) for r in got.collect()]
    want = spelled(docs)
    assert len(got) == len(set(got)) and set(got) == want
    assert any(r[1] for r in want) and sum(r[4] for r in want) > 50


def test_variants_follow_chains(spark):
    from tidemark.llm.spelling import variants

    text = " ".join(["abcdefgh"] * 3000 + ["abcdefgi"] * 500 + ["abcdefji"] * 80 + ["abcdekji"] * 10)
    docs = [(1, text)]
    got = {tuple(r) for r in variants(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got == spelled(docs) and {r[2] for r in got} == {"abcdefgh"} and len(got) == 4


def test_variants_of_nothing_and_long_texts(spark, monkeypatch):
    from tidemark.llm import spelling

    assert spelling.variants(empty(spark)).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, None), (2, "a b")], "doc_id bigint, text string")).count() == 0
    rng = random.Random(5)
    docs = [(3, " ".join("".join(rng.choice("ab") for _ in range(7)) for _ in range(200_000)) + " " + "z" * 30_000)]
    assert {tuple(r) for r in spelling.word_counts(spark.createDataFrame(docs, "doc_id bigint, text string")).filter("n >= 5").collect()} == {(r[0], r[3]) for r in spelled(docs)}


def test_pivots_are_disjoint_and_cheapest():
    from tidemark.llm.spelling import disjoint_pair

    rng = random.Random(6)
    for _ in range(500):
        at = sorted(rng.sample(range(12), rng.randrange(3, 8)))
        grams = [(p, rng.randrange(9)) for p in at]
        a, b = disjoint_pair(grams)
        rank = dict(grams)
        assert b - a >= 2 and rank[a] + rank[b] == min(x + y for p, x in grams for q, y in grams if q - p >= 2)


# URL rules

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"), ("block", "a.example.org", ""), ("allow", "Example.COM", "/de/x"), ("block", "", ""), ("block", "net", "/é"), ("allow", "net", "/é")]
URLS = [
    "http://x.example.org/es/1", "https://example.org/en/123?q=1", "https://example.org/en/2", "HTTP://A.EXAMPLE.org/es/", "x://notexample.org/es/9", "http://org", "http://org/", "http://example.com/de/xy#f", "http://fooexample.com/de/xy",
    "http://example.com/fr", "http://example.com/fr/", "http://u:p@example.com:80/fr/", "http://net/é/1", "http://b.net/é", "ftp://c.com?x=/de/", "ftp://c.com#/de/", "//example.org/es/", "example.org/es/", "", None, "http://", "http:///es/", "a://b://c.org/", "http://ÉX.org/é",
    "http://example.org./es/", "http://.com/de/", "x\n://a.org/\n?", "http://" + "a." * 300 + "com/de/" + "b/" * 5000,
]


def judged(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path, host = re.match(r"[^?#]*", rest[len(host) :])[0], host.translate(UPPER)
    fits = [(len(h) + len(p), len(h), v, h.translate(UPPER) + p) for v, h, p in rules if (host == h.translate(UPPER) or host.endswith("." + h.translate(UPPER))) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else "allow"


@pytest.mark.parametrize("most", [100, 2])
def test_url_rules_equal_brute_force(spark, most):
    from tidemark.llm.url_rules import judge, rule_table

    rng = random.Random(7)
    more = ["http://" + ".".join(rng.choice("ab") for _ in range(rng.randrange(1, 4))) + "".join("/" + rng.choice("ab") for _ in range(rng.randrange(4))) for _ in range(200)]
    rules = RULES[: -3 if most == 2 else None] + [(rng.choice(["allow", "block"]), rng.choice(["a", "b", "a.b", "b.a.b"]), rng.choice(["", "/", "/a", "/a/b", "/b/"])) for _ in range(8)]
    rows = [(i, u) for i, u in enumerate([*URLS, *more])]
    rows += [(None, URLS[0]), (None, None), (5, URLS[1]), *[(0, URLS[0])] * 3000]
    got = judge(clashing(spark, rows, "page_id bigint, url string"), rule_table(spark, rules), most_rules=most)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    assert collections.Counter(tuple(r) for r in got.collect()) == collections.Counter((i, *judged(u, rules)) for i, u in rows)


def test_url_rules_of_nothing(spark):
    from tidemark.llm.url_rules import judge, rule_table

    urls = spark.createDataFrame([(1, "http://a.org/")], "page_id bigint, url string")
    assert [tuple(r) for r in judge(urls, rule_table(spark, [])).collect()] == [(1, "a.org", "/", None, "allow")]
    assert judge(urls.limit(0), rule_table(spark, RULES)).count() == 0


def test_url_rules_run_without_python(spark):
    from tidemark.llm.queries import op13_url_rules
    from tests.conftest import SF

    plan = op13_url_rules(spark, SF)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|ExistingRDD", plan)


@pytest.mark.parametrize("name", ["op11_resampling", "op12_spelling", "op13_url_rules"])
def test_sql(spark, duck, name):
    from tests.conftest import SF
    from tidemark.llm.queries import QUERIES, SQL

    got = QUERIES[name](spark, SF)
    want = duck.execute(SQL[name])
    assert sorted(got.columns) == sorted(c[0] for c in want.description)
    rows = [tuple(r) for r in got.select(*[c[0] for c in want.description]).collect()]
    assert rows and collections.Counter(rows) == collections.Counter(want.fetchall())
