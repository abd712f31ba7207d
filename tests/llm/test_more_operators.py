import base64
import json
import random
import struct
from collections import Counter

import pytest
from pyspark.sql import functions as F

from bugsift.llm import chat_format, decontaminate, html_extract, secret_scan, sharding, toxicity
from bugsift.llm.queries import QUERIES, chat_events

from . import brute
from .test_text_operators import SF, corpus, frame

SF2 = "/root/testdata/sf0.01"


# ---- decontamination -------------------------------------------------------

def bench_rows():
    rng = random.Random(9)
    vocab = [f"bench{i}" for i in range(80)] + ["the", "of", "and", "a", "in"]
    return [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([9, 15, 30, 50])))) for i in range(12)] + [
        (50, None), (51, ""), (52, "short item of five words"), (53, "...")]


def planted(items, seed):
    rng = random.Random(seed)
    filler = [f"w{i}" for i in range(300)] + ["the", "of", "and", "a", "in"]
    rows = []
    for k in range(120):
        w = [rng.choice(filler) for _ in range(rng.randrange(0, 80))]
        if k % 2:
            item = rng.choice([t for _, t in items if t and len(t.split()) >= 5]).split()
            e = len(item) * rng.choice([0, 5, 10, 20, 35]) // 100
            for _ in range(e):
                p = rng.randrange(len(item))
                rng.choice([lambda: item.__setitem__(p, "zz"), lambda: item.insert(p, "zz"), lambda: item.pop(p)])()
            at = rng.choice([0, len(w), rng.randrange(len(w) + 1)])
            w[at:at] = [x.capitalize() + rng.choice(["", ",", "."]) for x in item]
        rows.append((k, rng.choice([" ", "\n"]).join(w)))
    return rows + [(900, None), (901, ""), (902, "? ! ,")]


def test_decontamination_against_exact_distances(spark):
    items = bench_rows()
    rows = planted(items, 1)
    clean = lambda t: [x.lower().strip(decontaminate._EDGE) for x in brute.WORD.findall(t or "")]
    want = {}
    for d, t in rows:
        for i, q in items:
            m = clean(q)
            if m:
                e = len(m) * decontaminate.MAX_EDIT_PCT // 100 if len(m) >= decontaminate.MIN_ITEM_WORDS else 0
                dist = brute.edit_distance_to_any_window(m, clean(t))
                if dist <= e and len(clean(t)) > 0:
                    want[d, i] = dist
    want = {k: v for k, v in want.items() if k[1] != 53}
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontaminate.hits(frame(spark, rows), bench).collect()}
    got = {k: v for k, v in got.items() if k[1] != 53}
    assert all(got[k] >= want[k] for k in set(got) & set(want))
    assert set(got) <= set(want)
    exact = {k for k, v in want.items() if v == 0}
    assert exact and exact <= set(got)
    assert len(got) >= 0.95 * len(want)
    kept = {r["doc_id"] for r in decontaminate.drop_contaminated(frame(spark, rows), bench).collect()}
    assert not kept & {d for d, _ in got} and {d for d, _ in rows} - {d for d, _ in want} <= kept | {902}


def test_decontamination_edges(spark, monkeypatch):
    empty = spark.createDataFrame([], "item_id long, text string")
    docs = frame(spark, [(1, "a b c"), (2, None)])
    assert decontaminate.hits(docs, empty).collect() == []
    assert decontaminate.drop_contaminated(docs, empty).count() == 2
    bench = spark.createDataFrame(bench_rows(), "item_id long, text string")
    assert decontaminate.hits(frame(spark, []), bench).collect() == []
    rows = planted(bench_rows(), 2)
    whole = {tuple(r) for r in decontaminate.hits(frame(spark, rows), bench).collect()}
    monkeypatch.setattr(decontaminate, "ITEM_BLOCK", 5)
    assert {r[:2] for r in whole} <= {tuple(r)[:2] for r in decontaminate.hits(frame(spark, rows), bench).collect()} | whole
    assert decontaminate.drop_contaminated(docs, bench).columns == docs.columns


# ---- secrets ---------------------------------------------------------------

def der(tag, content):
    n = len(content)
    size = bytes([n]) if n < 128 else (lambda b: bytes([0x80 | len(b)]) + b)(n.to_bytes((n.bit_length() + 7) // 8, "big"))
    return bytes([tag]) + size + content


def pkcs1(rng):
    num = lambda n: der(2, bytes([1]) + rng.randbytes(n))
    return der(0x30, der(2, b"\0") + num(64) + der(2, b"\1\0\1") + b"".join(num(32) for _ in range(6)))


def b64url(x):
    return base64.urlsafe_b64encode(x).decode().rstrip("=")


def secret_texts():
    rng = random.Random(4)
    key = pkcs1(rng)
    pkcs8 = der(0x30, der(2, b"\0") + der(0x30, der(6, b"\x2a\x86\x48\x86\xf7\x0d\1\1\1") + der(5, b"")) + der(4, key))
    field = lambda b: struct.pack(">I", len(b)) + b
    ssh = b"openssh-key-v1\0" + field(b"none") + field(b"none") + field(b"") + struct.pack(">I", 1) + field(
        rng.randbytes(50)) + field(rng.randbytes(120))
    head, body = b64url(json.dumps({"alg": "HS256", "typ": "JWT"}).encode()), b64url(json.dumps({"sub": "x" * 20}).encode())
    armour = lambda kind, x: f"-----BEGIN {kind}PRIVATE KEY-----\n{base64.encodebytes(x).decode()}-----END {kind}PRIVATE KEY-----"
    good = {
        "der64": base64.b64encode(key).decode(), "derhex": pkcs8.hex().upper(), "pem": armour("RSA ", key),
        "pem8": armour("", pkcs8), "ssh": armour("OPENSSH ", ssh), "jwt": f"{head}.{body}.{b64url(rng.randbytes(32))}",
        "twice": base64.b64encode(armour("", pkcs8).encode()).decode(),
    }
    bad = {
        "noise64": base64.b64encode(b"\x30" + rng.randbytes(90)).decode(), "cut": base64.b64encode(key[:-3]).decode()[:-4],
        "nojwt": f"{b64url(b'{}' * 8)}.{body}.abc", "pem": "-----BEGIN RSA PRIVATE KEY-----\nnot a key\n-----END RSA PRIVATE KEY-----",
        "words": "a" * 200, "hex": "zz" + "ab" * 40,
    }
    return good, bad


def test_confirmed_structures():
    good, bad = secret_texts()
    for name, s in good.items():
        text = f"éé before {s} after"
        spans = secret_scan.confirmed_spans(text)
        assert spans and text[spans[0][0]:spans[0][2]] == s, name
        assert s not in secret_scan.masked(text, "[X]") and secret_scan.masked(text, "[X]").startswith("éé before [X]")
    for name, s in bad.items():
        assert secret_scan.confirmed_spans(f"x {s} y") == [], name


def test_tokens_and_keys_in_context():
    good, _ = secret_texts()
    rng = random.Random(5)
    five = ".".join([b64url(json.dumps({"alg": "dir", "enc": "A128GCM"}).encode()), "",
                     *(b64url(rng.randbytes(n)) for n in (12, 40, 16))])
    for s in (good["jwt"], five):
        for before in ("", "x ", ".", "-", "_", "id_token_", '"a\\n', "v1.", "..."):
            for after in ("", " ", ". Next", ", ", "...", "....", ".next", ".a.b", "\u2026", '\\n"'):
                text = f"{before}{s}{after}"
                assert secret_scan.token_spans(text) == [(len(before), len(before) + len(s))], (before, after)
                assert secret_scan.masked(text, "[X]") == f"{before}[X]{after}"
    two = f"{good['jwt']}.{five}.{good['jwt']}."
    assert [two[a:b] for a, b in secret_scan.token_spans(two)] == [good["jwt"], five, good["jwt"]]
    assert secret_scan.token_spans(good["jwt"].rsplit(".", 1)[0] + " Next") == []
    for name in ("pem", "pem8", "ssh"):
        for brk in ("\n", "\r\n", "\\n", "\\r\\n", "\\\\n", "\\n\\\n"):
            s = good[name].replace("\n", brk)
            for key in (s, s.replace("/", "\\/")):
                text = f'{{"key": "{key}"}}'
                assert [text[a:b] for a, _, b, _ in secret_scan.confirmed_spans(text)] == [key], (name, brk)
    for s in ("ey" * 200_000 + ".a.b", "a." * 200_000, "ey.ey" * 100_000):
        assert secret_scan.confirmed_spans(s) == []


def test_armour_in_quotes_literals_and_after_open_headers():
    good, _ = secret_texts()
    found = lambda t: [t[a:b] for a, k, b, _ in secret_scan.confirmed_spans(t) if k == 3]
    for name in ("pem", "pem8", "ssh"):
        key = good[name]
        head = key.split("\n")[0]
        for before in (head + "\n", f"files start with {head} and so on\n", head + "\nabcd\n" + head + " "):
            assert found(before + key + " tail") == [key], name
        for mark in ("> ", ">> ", "# ", "// ", " * ", "| ", "\t"):
            t = mark + key.replace("\n", "\n" + mark)
            assert found(t) == [t[len(mark):]], (name, mark)
        for join in ('\\n" +\n   "', '"\n "', "\\n' \\\n  '", '" . "', '\\n",\n"'):
            t = join[-1] + key.replace("\n", join) + join[-1]
            assert found(t) == [t[1:-1]], (name, join)
    plain = good["der64"]
    for before in ("key/", "K", "MII", "abMCd+", "/"):
        t = f"x {before}{plain} y"
        assert found(t) == [plain], before
    # headers of the two known kinds only, over whole cipher blocks
    body = base64.encodebytes(random.Random(8).randbytes(64)).decode()
    pem = lambda inner: f"-----BEGIN RSA PRIVATE KEY-----\n{inner}-----END RSA PRIVATE KEY-----"
    sealed = pem(f"Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00FF\n\n{body}")
    assert found(sealed) == [sealed]
    for inner in ("note: none\nabcd\n", f"note: none\n{body}", f"Proc-Type: 4,ENCRYPTED\n{body}", body):
        assert found(pem(inner)) == []


def test_armour_search_is_linear():
    import time
    start = time.perf_counter()
    for t in ("-----BEGIN RSA PRIVATE KEY-----\n" * 20_000, "MII" * 200_000, "MIIEpAIBAAKCAQEA" * 20_000,
              "-----BEGIN " + "A " * 200_000, '"' + " " * 200_000 + "-----BEGIN PRIVATE KEY-----" + '" \n' * 100_000
              + "-----END PRIVATE KEY-----"):
        assert [k for _, k, _, _ in secret_scan.confirmed_spans(t)] == []
    assert time.perf_counter() - start < 10


def brute_base(text):
    import re
    pats = (("assign", r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8),
            ("access", r"(AKIA[A-Z0-9]+)", 16), ("hex", r"([0-9a-f]+)", 32))
    out = []
    for k, (kind, p, least) in enumerate(pats):
        out += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(p, text) if len(m[1]) >= least]
    return [x for *_, x in sorted(out)]


def test_secret_scan_rows(spark):
    good, bad = secret_texts()
    rows = [(i, f"é {s} \n tail") for i, s in enumerate([*good.values(), *bad.values()])]
    rows += [(100, None), (101, ""), (102, "PassWord : 'abc' token=token=abcdefgh1 api_key=\"k\" toKen:Kabcdefghij ſecret=abcdefghi"),
             (103, "AKIA" + "A" * 11 + " AKIA" + "B" * 12 + "c"), (104, "0" * 31 + "g" + "f" * 33 + "F"),
             (105, "token:token = \"abcdefgh\" passwd='x.y/z+_-=1'"), (106, "x " * 50_000 + "secret=abcdefgh" + " y" * 50_000)]
    rows += [(1000 + r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r["doc_id"]: r for r in secret_scan.scan(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    for d, t in rows:
        base, r = brute_base(t or ""), got[d]
        assert r["base_sha256"] == brute.sha(",".join(base)), d
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [
            sum(x.startswith(k) for x in base) for k in ("assign", "access", "hex")]
        assert set(base) <= set(r["spans"].split(","))
    assert all("key:" in got[i]["spans"] or "token:" in got[i]["spans"] for i in range(len(good)))
    df = frame(spark, rows)
    red = secret_scan.redact(df)
    assert red.columns == df.columns
    for r in red.collect():
        t = dict(rows)[r["doc_id"]]
        assert r["text"] == (secret_scan.masked(t, "[SECRET]") if t is not None else None)
        assert not any(x.startswith(("access", "hex")) for x in brute_base(r["text"] or ""))
    assert secret_scan.scan(frame(spark, [])).collect() == []


# ---- chat ------------------------------------------------------------------

NASTY = ["\\### Assistant: </turn> ok", "### user: x</turn>\n", "\\e\\l\\h\\c", "", "é漢💩\n\n", "</turn>\n</turn>\n", ": a: b"]


def test_chat_round_trip(spark):
    rng = random.Random(1)
    rows = []
    for c in range(25):
        for t in range(rng.randrange(1, 7)):
            rows.append((c, t, rng.choice(["user", "assistant", "sys: tem", "a\nb", None]),
                         rng.choice([*NASTY, None, "plain text " * rng.randrange(30)])))
    rows += [(None, 0, "user", "x"), (None, 1, "assistant", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("seq", F.lit("clash"))
    turns = chat_format.fold_events(chat_events(df))
    formatted = chat_format.render(turns)
    got = {r["conv_id"]: r for r in chat_format.digests(formatted).collect()}
    texts = {r["conv_id"]: r for r in formatted.collect()}
    convs = {}
    for c, t, role, text in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        convs.setdefault(c, []).append((role or "", text or ""))
    assert set(got) == set(convs)
    for c, ts in convs.items():
        loss = "".join(x for r, x in ts if r == "assistant")
        assert got[c]["n_turns"] == len(ts)
        assert got[c]["turns_sha256"] == brute.sha("".join(f"{r}\n{x}\n" for r, x in ts))
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), brute.sha(loss))
        s = texts[c]["formatted"]
        assert got[c]["formatted_chars"] == len(s)
        parts = [s[x["start"]:x["start"] + x["length"]] for x in texts[c]["loss_spans"]]
        back = "".join(parts).replace("\\h", "#").replace("\\l", "<").replace("\\e", "\\")
        assert back == loss


def test_fold_events(spark):
    e = [(1, 1, "message", 1, "user", "hi"), (1, 2, "message", 2, "assistant", ""), (1, 3, "delta", 2, None, "a"),
         (1, 4, "delta", 2, None, "b"), (1, 5, "regenerate", 2, None, None), (1, 6, "delta", 2, None, "c"),
         (1, 7, "delta", 2, None, "d"), (1, 8, "message", 3, "user", "more"), (1, 9, "edit", 3, None, "less"),
         (2, 1, "message", 1, "user", "q"), (2, 2, "message", 2, "assistant", "r"), (2, 3, "edit", 1, "user", "Q"),
         (2, 4, "message", 2, "assistant", "R"), (2, 5, "delta", 2, None, "!"), (3, 1, "delta", 1, "user", "only")]
    random.Random(1).shuffle(e)
    df = spark.createDataFrame(e, "conv_id long, seq long, kind string, turn long, role string, text string")
    got = {(r["conv_id"], r["turn"]): (r["role"], r["text"]) for r in chat_format.fold_events(df.repartition(4)).collect()}
    assert got == {(1, 1): ("user", "hi"), (1, 2): (None, "cd"), (1, 3): (None, "less"), (2, 1): ("user", "Q"),
                   (2, 2): ("assistant", "R!"), (3, 1): ("user", "only")}
    assert chat_format.digests(chat_format.render(chat_format.fold_events(df.limit(0)))).collect() == []


# ---- toxicity --------------------------------------------------------------

def toxic_corpus(n=600):
    rng = random.Random(3)
    vocab, bad = [f"w{i}" for i in range(200)], ["vile", "awful", "nasty"]
    docs, labels = [], []
    for i in range(n):
        sents = [" ".join(rng.choice(vocab) for _ in range(8)) for _ in range(rng.choice([1, 5, 30, 200]))]
        toxic = i % 7 == 0
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                k = rng.randrange(len(sents))
                sents[k] += f" {rng.choice(bad)}!"
        docs.append((i, "x. ".join(sents).replace("x. ", ". ")))
        if i % 3:
            labels.append((i, 1, int(toxic) if rng.random() > 0.02 else 1 - int(toxic)))
    return docs + [(9000, None), (9001, "")], labels + [(None, 1, 1), (5, 1, None)]


def test_toxicity_learns_and_locates(spark):
    docs, labels = toxic_corpus()
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash"))
    df = frame(spark, docs)
    clash = df.select("*", F.lit(1).alias("label"), F.lit(7).alias("_id"), F.lit(0).alias("toxic"))
    assert sorted(toxicity.labelled(clash, lab).collect()) == sorted(toxicity.labelled(df, lab).collect())
    model = toxicity.fit(toxicity.labelled(df, lab))
    assert {"vile", "awful", "nasty"} <= set(model.cues)
    got = {r["doc_id"]: r for r in toxicity.score(df, model).collect()}
    assert len(got) == len(docs)
    right = [(r["predicted"] == int(d % 7 == 0)) for d, r in got.items() if d < 9000]
    assert sum(right) / len(right) > 0.98
    assert got[9000]["predicted"] == got[9001]["predicted"] == 0
    assert all(r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in got.values())
    import zlib
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in got.items())
    text = dict(docs)
    for r in toxicity.locate(df, model).collect():
        assert text[r["doc_id"]][r["start"]:r["end"]] == r["sentence"]
        assert any(w in r["sentence"] for w in ("vile", "awful", "nasty"))


def test_toxicity_scores_are_noisy_or(spark):
    """Scores from the definition: 1 less the product over all sentences, each
    found word by word, of what a sentence leaves."""
    import math
    import re
    docs, labels = toxic_corpus(200)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    df = frame(spark, docs)
    model = toxicity.fit(toxicity.labelled(df, lab))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(df, model).collect()}
    for d, t in docs:
        left = 1 - model.leak
        for sent in re.split(r"(?<=[.!?])|\n", t or ""):
            words = {w.strip(".,!?;:\"'()").lower() for w in sent.split()}
            cues = words & set(model.cues)
            if cues:
                z = model.bias + sum(model.weights[model.cues.index(c)] for c in cues)
                left *= 1 - 1 / (1 + math.exp(-z))
        assert got[d] == pytest.approx(1 - left, abs=1e-9), d


def test_toxicity_without_labels(spark):
    docs, _ = toxic_corpus(20)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.fit(toxicity.labelled(frame(spark, docs), none))
    assert {r["score"] for r in toxicity.score(frame(spark, docs), model).collect()} == {0.0}
    assert toxicity.score(frame(spark, []), model).collect() == []


def test_toxicity_on_held_out_rows(spark):
    pred = QUERIES["op7_toxicity"](spark, SF2)
    lab = spark.read.parquet(f"{SF2}/labels.parquet")
    docs = spark.read.parquet(f"{SF2}/documents.parquet").select("doc_id", "text")
    rows = pred.join(docs, "doc_id").join(lab, "doc_id", "left").collect()
    held = [r for r in rows if r["held_out"] and r["toxic"] is not None]
    pos, neg = [r["score"] for r in held if r["toxic"]], [r["score"] for r in held if not r["toxic"]]
    auc = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    # a part of the label-1 rows hold no offending word at all (label noise)
    assert auc > 0.75
    assert sum(r["predicted"] == r["toxic"] for r in held) / len(held) > 0.9
    # the fixtures' offending words are found, and nothing else is called toxic
    import re
    offends = re.compile("stupid|trash|worthless|disgusting|scum|pathetic|idiot|loser", re.IGNORECASE)
    agree = [r["predicted"] == bool(offends.search(r["text"])) for r in rows]
    assert sum(agree) / len(agree) > 0.99


# ---- pages -----------------------------------------------------------------

def test_messages_give_exact_marginals():
    rng = random.Random(5)
    for _ in range(30):
        tree = html_extract.Tree()
        tree.add(-1, ("r",))
        for i in range(1, 7):
            tree.add(rng.randrange(i), (f"f{i}",))
        w = {f"f{i}": rng.gauss(0, 2) for i in range(7)} | {"r": rng.gauss(0, 1)} | {
            k: rng.gauss(0, 2) for k in ("pair:00", "pair:01", "pair:10", "pair:11")}
        total, on, both = 0.0, [0.0] * 7, [0.0] * 7
        for bits in range(2 ** 7):
            y = [bits >> i & 1 for i in range(7)]
            e = sum(w[f] for i in range(7) for f in tree.names[i] if y[i]) + sum(
                w[f"pair:{y[tree.parent[i]]}{y[i]}"] for i in range(1, 7))
            p = 2.718281828459045 ** e
            total += p
            for i in range(7):
                on[i] += p * y[i]
                both[i] += p * (i > 0 and y[i] and y[tree.parent[i]])
        m, edges = html_extract.marginals(tree, w)
        assert m == pytest.approx([x / total for x in on], abs=1e-9)
        assert [e[3] for e in edges[1:]] == pytest.approx([x / total for x in both[1:]], abs=1e-9)


PAGE = """<!DOCTYPE html><html><head><title>T &amp; u</title><style>p{}</style><script>var t="</p>";</script></head>
<body class="has-comments"><header class="top"><h1>Site</h1></header><nav><ul><li><a href="/a">Home</a></li></ul></nav>
<div id="cookie-notice"><p>We use cookies, which this notice explains at a length of more than eighty characters.</p></div>
<!-- ad <p>no</p> --><div class="ad">Buy</div><main><article><h1>Title &amp; more</h1><p>First <b>bold</b>&nbsp;text<p>Second<br>
 line <a title="a > b" href=x>link</a>&#33;</p><ul><li>one<li>two</ul><aside class="related"><p>See also</p></aside>
<form><label>Mail</label><input><button>Go</button></form></article><section id="comments"><h2>Comments</h2>
<div class="comment"><p>A reader says something that is longer than eighty characters, at some length, here.</p></div>
</section></main><footer><p>&copy; us</p></footer></body></html>"""


def test_extract_pages(spark):
    pages = spark.read.parquet(f"{SF2}/pages.parquet")
    docs = spark.read.parquet(f"{SF2}/documents.parquet")
    weights = html_extract.train(html_extract.labelled_pages(pages, docs))
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "plain  text"), (5, "u", "<p>a<p>b &lt; c"),
            (6, "u", "<article><p>" + "<div>" * 3000 + "deep" + "</div>" * 3000), (7, "u", "<div class='ad'>x</div>"),
            (8, "u", "<article><p>x <script>if (a < b) { '<p>' }</script>y</p><a title=\"unclosed>z</a>"), (1, "u", PAGE)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = html_extract.extract(df, weights).collect()
    assert len(got) == len(rows)
    text = {r["page_id"]: r["text"] for r in got}
    assert text[1] == "Title & more\n\nFirst bold text\n\nSecond line link!\n\none\n\ntwo"
    assert text[2] == text[3] == text[7] == "" and text[4] == "plain text" and text[5] == "a\n\nb < c"
    assert text[6] == "deep" and text[8] == "x y\n\nz"
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_extract.extract(df.limit(0), weights).collect() == []


def test_extract_given_pages_equals_their_documents(spark):
    """Held-out pages: the body after the headline is the source's lines."""
    source = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF2}/documents.parquet").collect()}
    rows = QUERIES["op8_html_extract"](spark, SF2).collect()
    import re
    same = 0
    for r in rows:
        m = re.search(r"/(\d+)", r["url"].split("://", 1)[1])
        lines = [" ".join(x.split()) for x in source[int(m[1])].split("\n")]
        same += r["text"].split("\n\n")[1:] == [x for x in lines if x]
    assert same >= 0.99 * len(rows)


# ---- shards ----------------------------------------------------------------

def shard_rows():
    rng = random.Random(8)
    rows = [(i, "hot") for i in range(300)] + [(1000 + i, f"t{rng.randrange(60)}") for i in range(300)]
    rows += [(5000 + i, f"own {i} é") for i in range(333)] + [(None, "n"), (None, None), (9000, None), (9001, ""), (9001, "")]
    return rows


@pytest.mark.parametrize("shards", [1, 4, 16])
def test_sharding(spark, shards):
    import zlib
    rows = shard_rows()
    got = sharding.shard_documents(frame(spark, rows), shards=shards).collect()
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == sorted(
        (str(d), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    per = {}
    for r in got:
        per.setdefault(r["shard"], []).append((r["slot"], -1 if r["doc_id"] is None else r["doc_id"]))
    assert set(per) == set(range(shards))
    sizes = [len(v) for v in per.values()]
    assert max(sizes) - min(sizes) <= 1
    for v in per.values():
        assert [s for s, _ in sorted(v)] == list(range(len(v)))
        assert [d for _, d in sorted(v)] == sorted(d for _, d in v)
    assert {r["law"] for r in got} == {"rows"} and {r["grown_shard"] for r in got} == {None}
    if shards == 16:
        # small groups come together; the large one fills whole shards
        by_text, where = {}, {}
        text = {d: t for d, t in rows if d is not None}
        for r in got:
            if r["doc_id"] is not None:
                by_text.setdefault(text[r["doc_id"]], set()).add(r["shard"])
        assert sum(len(by_text[f"t{k}"]) > 1 for k in range(60) if f"t{k}" in by_text) <= 12
        assert len(by_text["hot"]) <= 9


def test_sharding_quotas():
    rng = random.Random(3)
    for _ in range(200):
        n = rng.randrange(1, 17)
        want = {(i, j): rng.randrange(200) for i in range(n) for j in range(n) if i != j and rng.random() < 0.5}
        idle = {s: rng.choice([0, 0, 3, 50]) for s in range(n)}
        got = sharding._quotas(want, idle, n)
        assert set(got) == set(want) and all(0 <= got[k] <= want[k] for k in want)
        for s in range(n):
            assert sum(v for k, v in got.items() if k[1] == s) - sum(v for k, v in got.items() if k[0] == s) <= idle[s]
    assert sharding._quotas({(0, 1): 7, (1, 2): 5, (2, 0): 9}, {}, 3) == {(0, 1): 5, (1, 2): 5, (2, 0): 5}


@pytest.mark.parametrize("size,alone", [(2, 0), (2, 200), (3, 100)])
def test_sharding_mostly_linked(spark, size, alone):
    """Copies meet also where few or no documents are without copies."""
    rows = [(i, f"t{i % (1800 // size)}") for i in range(1800)] + [(5000 + i, f"own {i}") for i in range(alone)]
    placed = {r["doc_id"]: r["shard"] for r in sharding.shard_documents(frame(spark, rows), shards=8).collect()}
    sizes = Counter(placed.values())
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len(placed) == len(rows)
    seen = {}
    for d, t in rows:
        seen.setdefault(t, []).append(placed[d])
    pairs = sum(len(v) * (len(v) - 1) // 2 for v in seen.values())
    whole = sum(n * (n - 1) // 2 for v in seen.values() for n in Counter(v).values())
    print("split", (pairs - whole) / pairs)
    assert pairs - whole <= 0.03 * pairs


def test_sharding_tiny_against_all_placements(spark):
    """Against every level placement of a few rows: the cut lies between the best
    one and that of the deal (propagation need not reach the best)."""
    from itertools import permutations
    from bugsift.llm.sharding import cut_links, propagate
    for groups in ([0, 0, 1, 1], [0, 0, None, None]):
        n = len(groups)

        def split(p):
            return sum(groups[i] is not None and groups[i] == groups[j] and p[i] != p[j] for i in range(n) for j in range(i))
        best = min(map(split, set(permutations([k % 2 for k in range(n)]))))
        placed = spark.createDataFrame([(i, i % 2) for i in range(n)], "node long, shard int")
        links = spark.createDataFrame([(i, g) for i, g in enumerate(groups) if g is not None], "node long, group int")
        out = propagate(placed, links, shards=2)
        count = [r["count"] for r in out.groupBy("shard").count().collect()]
        assert max(count) - min(count) <= 1 and sum(count) == n
        got = split([s for _, s in sorted(out.collect())])
        assert best <= got <= split([k % 2 for k in range(n)]) and cut_links(out, links).first()["split"] == got
        assert None not in groups or got == best


def test_sharding_states_keep_true_sizes(spark):
    """The estimate of a state stays that of its rows, however many rounds made it."""
    from bugsift.llm.sharding import propagate
    n = 120
    placed = spark.createDataFrame([(i, i % 4) for i in range(n)], "node long, shard int").repartition(2)
    links = spark.createDataFrame([(i, i * 7 % n // 3) for i in range(n)], "node long, group int")
    out = propagate(placed, links, shards=4)
    size = int(out._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    assert size < 1 << 20


def test_sharding_few_rows(spark):
    assert sharding.shard_documents(frame(spark, [])).collect() == []
    got = sharding.shard_documents(frame(spark, [(1, "a"), (2, "a"), (3, "a")])).collect()
    assert sorted(r["slot"] for r in got) == [0, 0, 0]
