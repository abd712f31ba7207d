"""Spelling variants, periodic runs and the quality classifier."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bugsift.llm import common, html_extract, periodic_runs, quality_qda, queries, spelling_variants
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def frame(spark, rows):
    """documents with extra columns whose names clash with internal ones."""
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit("clash")).withColumn(
        "word", F.lit(1)).withColumn("n", F.lit(2.5))


# ---- spelling variants -----------------------------------------------------

def brute_words(rows, every=97, min_length=5, min_count=3):
    n = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = brute.lower_az(run)
            h = zlib.crc32(f"{d}:{run}".encode())
            if d is not None and h % every == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
            if len(run) >= min_length:
                n[run] += 1
    return {w: c for w, c in n.items() if c >= min_count}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(rows, **kw):
    n = brute_words(rows, **kw)
    near = {w: [] for w in n}
    for a in n:
        for b in n:
            if a < b and abs(len(a) - len(b)) < 2 and one_edit(a, b):
                near[a].append(b)
                near[b].append(a)
    form = {}
    for w in n:
        best = min(near[w], key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w
    return {w: (n[w], len(near[w]), form[w], n[form[w]] if form[w] else None, root(w)) for w in n}


def variants(df, **kw):
    rows = spelling_variants.variants(df, **kw).collect()
    out = {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in rows}
    assert len(out) == len(rows)
    return out


def slip_texts():
    rng = random.Random(7)
    base = ["letters", "léttres", "×÷ÿÀà", "aaaaa", "ababab", "abcde", "xabcde", "abcdx"]
    rows = []
    for d in range(120):
        out = []
        for _ in range(rng.randrange(0, 40)):
            w = rng.choice(base)
            for _ in range(rng.choice((0, 0, 1, 1, 2))):
                k = rng.randrange(len(w) + 1)
                w = rng.choice((w[:k] + rng.choice("abeéX") + w[k:], w[:k] + w[k + 1:], w[:k] + "b" + w[k + 1:]))
            out.append(rng.choice((w, w.upper())))
        rows.append((d, rng.choice((" ", ", ", "1", "\n", "Ā", "中")).join(out)))
    return rows + [(500, None), (501, ""), (502, "... 12"), (503, "abcde " * 20_000), (504, "z" * 5000 + " " + "z" * 4999 + " " + "z" * 5000),
                   (505, "z" * 5000 + " " + "z" * 4999), (505, "z" * 4999), (None, "abcde abcdf abcdf abcdf " * 30)]


@pytest.mark.parametrize("every", [97, 3])
def test_spelling_variants_brute(spark, every):
    rows = slip_texts()
    got, want = variants(frame(spark, rows), slip_every=every), brute_variants(rows, every=every)
    assert got == want
    assert sum(v[2] is not None for v in got.values()) > 20 and any(got[v[2]][2] for v in got.values() if v[2])


def test_spelling_variants_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert variants(frame(spark, rows), slip_every=97) == brute_variants(rows)


def test_spelling_variants_frequent_grams(spark, monkeypatch):
    """Every gram frequent, none frequent, and a dictionary cut down to a few."""
    rng = random.Random(3)
    words = sorted({"".join(rng.choice(("th", "e", "re", "in", "on")) for _ in range(rng.randrange(2, 6))) for _ in range(900)})
    rows = [(i, " ".join([w] * rng.randrange(1, 9))) for i, w in enumerate(words)]
    want = brute_variants(rows, every=10**9, min_length=3)
    for least, most in ((0, 10**9), (10**9, 10**9), (0, 40)):
        monkeypatch.setattr(spelling_variants, "MIN_PLACES", least)
        monkeypatch.setattr(spelling_variants, "MAX_GRAMS", most)
        assert variants(frame(spark, rows), min_length=3) == want


def test_lists_to_merge_hold_every_near_word():
    rng = random.Random(5)
    known = {"\x02a": 9, "ab": 50, "aba": 20, "bab": 30, "ba": 40, "b\x03": 60, "abab": 7}
    for _ in range(3000):
        w = "".join(rng.choice("abc") for _ in range(rng.randrange(3, 12)))
        grams = spelling_variants.decompose(w, known, (len(w) + 2) // 2)
        own = spelling_variants.lists_to_merge(grams, known)
        assert spelling_variants.affected(grams, own) <= 1 < len(own)
        k = rng.randrange(len(w) + 1)
        for t in (w[:k] + "x" + w[k:], w[:k] + "b" + w[k + 1:]):
            if len(t) in (len(w), len(w) + 1) and one_edit(w, t):
                other = spelling_variants.decompose(t, known, (len(w) + 2) // 2)
                assert any(other[p] == grams[p] or (len(t) > len(w) and other[p + 1] == grams[p]) for p in own)


def test_spelling_variants_empty(spark):
    df = spelling_variants.variants(frame(spark, []), slip_every=97)
    assert df.columns == ["word", "n", "n_near", "form", "form_n", "root"] and df.collect() == []
    with pytest.raises(ValueError):
        spelling_variants.variants(frame(spark, []), min_length=2)


# ---- periodic runs ---------------------------------------------------------

def brute_runs(w, min_words=6, repeats=4):
    out = []
    n = len(w)
    for q in range(1, n // repeats + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            if size >= max(min_words, repeats * q) and not any(
                    all(w[x] == w[x + d] for x in range(i, i + size - d)) for d in range(1, q)):
                out.append((i, size, q))
            i = j
    return sorted(out)


def brute_looped(d, w):
    h = zlib.crc32(str(d).encode())
    g, n = h // 10, len(w)
    if d is None or h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def collapsed(w, runs):
    gone = {x for s, n, q in runs for x in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def run_row(w):
    runs = brute_runs(w)
    s, n, q = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    return (len(w), len(runs), s, n, q, 1000 * n // q if q else None,
            brute.sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), brute.sha(collapsed(w, runs)))


def periodic_texts():
    rng = random.Random(11)
    rows = []
    for d in range(300):
        w = []
        for _ in range(rng.randrange(0, 7)):
            unit = [rng.choice("abc") for _ in range(rng.randrange(1, 6))]
            w += unit * rng.choice((1, 2, 3, 4, 5, 9)) + unit[:rng.randrange(len(unit) + 1)]
            w += [rng.choice("abcxyz") for _ in range(rng.choice((0, 0, 1, 3)))]
        rows.append((d, rng.choice((" ", "\n", " \t\r")).join(w)))
    return rows + [(900, None), (901, ""), (902, " \x0b\x0c "), (903, "a " * 6), (904, "a " * 5), (905, "a a a a a a b " * 5),
                   (906, "\u00a0 " * 8), (907, "ab ab abab " * 7), (None, "x y " * 9), (903, "a " * 6), (908, "é 漢 " * 4)]


def test_periodic_runs_brute(spark):
    rows = periodic_texts()
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"])
                 for r in periodic_runs.runs(frame(spark, rows).withColumn("runs", F.lit(1))).collect())
    want = []
    for d, t in rows:
        w = brute.WORD.findall(t or "")
        runs = brute_runs(w)
        want.append(((d is None, d or 0), len(w), runs, collapsed(w, runs)))
    assert got == sorted(want)
    assert sum(len(x[2]) for x in got) > 200


def test_periodic_runs_other_settings(spark):
    rows = periodic_texts()[:120]
    for least, repeats in ((2, 2), (5, 2), (3, 3), (12, 4), (7, 5)):
        got = {r["doc_id"]: [tuple(x) for x in r["runs"]] for r in periodic_runs.runs(
            frame(spark, rows), min_words=least, repeats=repeats).collect()}
        assert got == {d: brute_runs(brute.WORD.findall(t), least, repeats) for d, t in rows}, (least, repeats)
    with pytest.raises(ValueError):
        periodic_runs.runs(frame(spark, rows), repeats=1)


def test_periodic_runs_query(spark, tmp_path):
    own = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    own = [(d, t) for d, t in own if len(t or "") < 12_000]
    rows = own + [((d or 0) + 10_000, t) for d, t in periodic_texts()] + [(None, "a b " * 8)]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    cols = ["doc_id", "n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    df = queries.op12_periodic_runs(spark, str(tmp_path))
    assert df.columns == cols
    got = Counter(tuple(r) for r in df.collect())
    assert got == Counter((d, *run_row(brute_looped(d, brute.WORD.findall(t or "")))) for d, t in rows)


def test_periodic_runs_long_texts(spark):
    """Very long periodic texts, several to a sort and one beyond it."""
    rows = [(1, "a " * 300_000), (2, "a b " * 50_000 + "c"), (3, " ".join(str(i % 999) for i in range(60_000))), (4, "x")]
    got = {r["doc_id"]: [tuple(x) for x in r["runs"]] for r in periodic_runs.runs(frame(spark, rows)).collect()}
    assert got == {1: [(0, 300_000, 1)], 2: [(0, 100_000, 2)], 3: [(0, 60_000, 999)], 4: []}


def test_suffix_order():
    rng = random.Random(2)
    for _ in range(200):
        rows = [[rng.randrange(3) for _ in range(rng.randrange(1, 30))] for _ in range(rng.randrange(1, 4))]
        order, lcp = periodic_runs.suffix_order(np.array(sum(rows, [])), np.repeat(np.arange(len(rows)), [len(r) for r in rows]))
        at = [(k, i) for k, r in enumerate(rows) for i in range(len(r))]
        want = sorted(range(len(at)), key=lambda x: (at[x][0], rows[at[x][0]][at[x][1]:] + [9]))
        assert order.tolist() == want
        for x in range(len(want) - 1):
            (a, i), (b, j) = at[want[x]], at[want[x + 1]]
            n = 0
            while a == b and i + n < len(rows[a]) and j + n < len(rows[b]) and rows[a][i + n] == rows[b][j + n]:
                n += 1
            assert lcp[x] == n


def test_periodic_runs_empty(spark):
    assert periodic_runs.digests(periodic_runs.runs(frame(spark, []))).collect() == []


# ---- quality classifier ----------------------------------------------------

def brute_statistics(t):
    t = t or ""
    w = brute.WORD.findall(t)
    b = t.encode()
    n, c, size = len(w) + 1, len(t) + 1, [len(x.encode()) for x in w]
    of = lambda own: sum(x in own for x in t)
    az, up = sum("a" <= x <= "z" for x in t), sum("A" <= x <= "Z" for x in t)
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    lines = [x for x in t.split("\n") if x]
    mean = sum(size) / n
    share = lambda x, y, a=0.01: math.log(x / y + a)
    top = max(Counter(w).values(), default=0)
    out = [math.log1p(len(w)), math.log1p(mean), math.log1p(math.sqrt(max(0, sum(x * x for x in size) / n - mean * mean))),
           share(up, az + up + 5), share(of("#*$%&"), n), share(of("|<>{}[]\\/=_~^@+`"), n), share(of("!"), n),
           share(of("0123456789"), c), share(of(".?"), n), share(of(","), n), share(of("\n"), n),
           share(sum(x >= 0xC0 for x in b), c), math.log1p(len(w)) - math.log1p(len(set(w))), share(top, n),
           share(len(grams) - len(set(grams)), len(grams) + 5), share(len(lines) - len(set(lines)), len(lines) + 2),
           math.log1p(len(w) / (len(lines) + 1)), share(sum(x > 15 for x in size), n), share(sum(x <= 3 for x in size), n, 0.05),
           share(of(";:'\"-()"), n)]
    return [round(max(-15, min(15, x)) * 1024) / 1024 for x in out]


def test_quality_statistics():
    texts = [None, "", " \n\n", "x", "The end. THE END!! a|b\n\nThe end. \u00e9t\u00e9 \u4e2d\U0001f600 12,5% (a-b) 'q'? \x1f",
             "a b c " * 4000, "line\n" * 50 + "tail", "W" * 20_000, "\u00a0 \ufeff"]
    got = quality_qda.statistics(pa.array([t or "" for t in texts], pa.large_string()))
    want = np.array([brute_statistics(t) for t in texts])
    assert got.shape == (len(texts), len(quality_qda.FEATURES))
    assert np.abs(got - want).max() <= 1 / 1024           # the last rounding may fall either way
    part = quality_qda.statistics(pa.array(["drop me"] + [t or "" for t in texts], pa.large_string()).slice(1))
    assert (part == got).all()


def test_discriminant_against_the_formula():
    rng = np.random.default_rng(4)
    d = 5
    x = [rng.normal(k, 1 + k, size=(60, d)) @ rng.normal(size=(d, d)) for k in (0, 1)]
    lam, gam = 0.3, 0.1
    cov = [np.cov(v.T, bias=True) for v in x]
    pooled = (cov[0] * 60 + cov[1] * 60) / 120
    own = [(1 - gam) * ((1 - lam) * c + lam * pooled) + gam * np.diag(np.diag(pooled) + 1e-4) + np.eye(d) * 1e-6 for c in cov]
    probe = rng.normal(size=(9, d)) * 3

    def density(k, v):
        diff = v - x[k].mean(0)
        return -0.5 * diff @ np.linalg.inv(own[k]) @ diff - 0.5 * np.linalg.slogdet(own[k])[1]
    m = quality_qda.discriminant(np.array([60.0, 60.0]), np.array([v.sum(0) for v in x]), np.array([v.T @ v for v in x]), lam, gam)
    want = [density(1, v) - density(0, v) for v in probe]
    assert np.allclose(m.raw(probe), want)


def test_quality_model_is_that_of_all_rows(spark):
    """Sums by Spark equal sums over the collected rows; parts do not matter."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    clash = docs.withColumn("fold", F.lit(9)).withColumn("x", F.lit("x")).withColumn("y", F.lit(1)).withColumn(
        "quality", F.lit(1)).withColumn("_id", F.lit(0))
    got = {}
    for parts in (1, 7):
        table = quality_qda.described(clash.repartition(parts))
        model = quality_qda.fit(table, labels.withColumn("text", F.lit(1)).repartition(parts))
        rows = quality_qda.score(table, model).collect()
        got[parts] = {r["doc_id"]: (r["held_out"], r["score"], r["predicted"]) for r in rows}
        assert len(rows) == docs.count()
    assert got[1] == got[7]
    label = {r["doc_id"]: r["quality"] for r in labels.collect() if r["quality"] is not None}
    x = {r["doc_id"]: r["x"] for r in table.collect()}
    fold = {d: zlib.crc32(str(d).encode()) % 5 for d in x}
    for d, (held, s, p) in got[1].items():
        assert held == (fold[d] == 0) and 0 <= s <= 1 and p == (s >= 0.3)
    train = [d for d in label if fold[d] and d in x]
    count = np.array([sum(label[d] == k for d in train) for k in (0, 1)], float)
    total = np.array([np.sum([x[d] for d in train if label[d] == k], axis=0) for k in (0, 1)])
    assert np.allclose(model.mean, total / count[:, None])
    assert np.allclose(model.base, count[1] / count.sum())
    pairs = [(s, label[d]) for d, (held, s, _) in got[1].items() if held and d in label]
    good, bad = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    assert np.mean([(a > b) + (a == b) / 2 for a in good for b in bad]) > 0.97
    assert np.mean([(s >= 0.3) == bool(y) for s, y in pairs]) > 0.95


def test_quality_edges(spark):
    docs = frame(spark, [(1, None), (2, ""), (3, "a fine text."), (None, "no id"), (3, "a fine text."), (4, "!!")])
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = quality_qda.assess(docs, none).collect()
    assert len(rows) == 6 and {r["score"] for r in rows} == {0.5}
    one = spark.createDataFrame([(1, 1), (2, None), (3, 1), (None, 0), (3, 0)], "doc_id long, quality int")
    assert {r["score"] for r in quality_qda.assess(docs, one).collect()} <= {0.5, 1.0}
    assert quality_qda.assess(frame(spark, []), one).collect() == []
    many = frame(spark, [(i, "word " * (i % 7) + "!" * (i % 2)) for i in range(60)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    got = {r["doc_id"]: r["score"] for r in quality_qda.assess(many, labels).collect()}
    assert all(math.isfinite(s) for s in got.values())
    assert min(s for d, s in got.items() if d % 2) > max(s for d, s in got.items() if not d % 2)


# ---- word codes of the n-gram join -------------------------------------------

def test_word_codes_tell_words_apart():
    rng = random.Random(3)
    words = ["".join(rng.choice("aBé中0") for _ in range(rng.choice([1, 2, 7, 8, 9, 16, 17, 63, 64, 65, 200]))) for _ in range(4000)]
    words += ["x" * k for k in range(1, 140)] + ["\0" * k for k in range(1, 20)]
    texts = [" ".join(words[i::7]) for i in range(7)] + [None, "", " \t\n"]
    code = {}
    for piece in (pa.array(texts, pa.large_string()), pa.array(["skipped"] + texts, pa.large_string()).slice(1)):
        flat, off = common.split_words(piece.fill_null(""), lower=True)
        h, own = common.word_codes(piece.fill_null(""), lower=True)
        assert (off == own).all() and len(h) == off[-1]
        for w, x in zip(flat.to_pylist(), h.tolist()):
            assert code.setdefault(w, x) == x
    assert set(code) == {brute.lower_az(w) for w in words} and len(set(code.values())) == len(code)


# ---- raw elements of pages ------------------------------------------------------

@pytest.mark.parametrize("page, blocks", [
    ("<p>a <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>tex</annotation></math> b", ["a x=2 b"]),
    ("<p>see <object data=x>the film</object> now</p>", ["see the film now"]),
    ("<p>a<svg><svg><text>no</text></svg><text>leak</text></svg>b</p>", ["ab"]),
    ("<template><p>no</p><template>no</template><p>leak</p></template><p>b", ["b"]),
    ("<svg><svg><text>no</text></svg><p>kept", ["kept"]),
    ("<script>for(i=0;i<n;i++)f()</script><p>one</p><p>two</p>", ["one", "two"]),
    ("<p>a<svg/>b</p><SCRIPT>x</SCRIPT >c", ["ab", "c"]),
    ("<p>a<style>p{", ["a"]),
    ("<p>a<svg>b", ["ab"]),
])
def test_raw_elements(page, blocks):
    assert [t for t in html_extract.parse(page).text if t is not None] == blocks


def test_attribute_names_are_whole_words():
    names = lambda page: html_extract.parse(page).names[1]
    assert "against" in names("<div id='header'>x") and "against" not in names("<div data-id='header'>x")


def test_raw_elements_are_linear():
    import time
    began = time.perf_counter()
    for page in ("<svg>" * 40_000, "<template><svg>" * 20_000 + "</svg>" * 10_000, "<noscript>" * 40_000, "<script>" * 40_000):
        html_extract.parse(page)
    assert time.perf_counter() - began < 10
