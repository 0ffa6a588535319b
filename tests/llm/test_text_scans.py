"""PII, secrets, licences, urls: against plain patterns."""

import hashlib
import math
import random
import re
import textwrap
from collections import Counter

import pytest
from pyspark.sql import functions as F

from chronoweave.llm import license_scan, pii, queries, secret_scan, url_filter
from tests.llm import cases


def plain_pii(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)] if "@" in t else []  # the pattern is quadratic
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(d := re.sub(r"\D", "", m[0])) <= 19 and pii.luhn(d)]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub(r"\D", "", m[0])) <= 15]


PIECES = ["a@b.c", "@b.c", "x.y+z@mail-1.example.com", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "0001.02.3.4", "4539 1488 0343 6467", "4539148803436467", "4539-1488-0343-6468", "+1 (523) 555-1055", "+1", "++49 30 1234567", " ", "\n", "é", "word", ".", "-", "@", "12345", "a@b.c@d.e"]


@pytest.mark.parametrize("seed", range(6))
def test_base_spans(seed):
    rnd = random.Random(seed)
    for _ in range(300):
        t = "".join(rnd.choice(PIECES) for _ in range(rnd.randrange(1, 14)))
        assert pii.base_spans(t) == plain_pii(t)


def test_base_spans_are_linear():
    for t in ("1" * 300_000, "a" * 300_000 + "@", "1.1" * 100_000, "+1" * 100_000, "@" * 200_000):
        pii.base_spans(t)


@pytest.fixture(scope="module")
def tagger():
    return queries._tagger()


def test_recall_on_held_out_spans(tagger):
    """Generated examples of another seed: whole spans are found, and few others."""
    hit = total = wrong = 0
    for text, spans in pii.labelled_examples(300, seed=99):
        gold = {s for s in spans if s[0] != "card" or pii.luhn(re.sub(r"\D", "", text[s[1] : s[2]]))}
        got = set(pii.method_spans([text], tagger, [[]])[0])
        hit, total, wrong = hit + len(gold & got), total + len(gold), wrong + len(got - gold)
    assert hit >= 0.9 * total and wrong <= 0.1 * total


def test_network_alone_finds_the_patterns_of_documents(spark, small, tagger):
    texts = [r["text"] for r in spark.read.parquet(f"{small}/../sf0.01/documents.parquet").where("text is not null").collect()]
    base = [pii.base_spans(t) for t in texts]
    alone = pii.method_spans(texts, tagger, [[] for _ in texts])
    total = sum(map(len, base))
    assert total > 50 and sum(len(set(b) & set(o)) for b, o in zip(base, alone, strict=True)) >= 0.9 * total


def slow_additions(text, tagger, base):
    """One window at a time, and a dictionary of characters."""
    label = {}
    for start in pii.windows_of(text):
        x = pii.encode(text[start : start + pii.WINDOW].ljust(pii.WINDOW))
        x[max(0, len(text) - start) :] = pii.FILL
        e = tagger.emissions(x[None])[0][0]
        score, back = e[0] + tagger.p["s"], []
        for row in e[1:]:
            through = score[:, None] + tagger.p["T"]
            back.append(through.argmax(0).tolist())
            score = through.max(0) + row
        path = [int(score.argmax())]
        for b in reversed(back):
            path.append(b[path[-1]])
        for t, k in enumerate(reversed(path)):
            if (16 <= t < 48 or (start == 0 and t < 16)) and start + t < len(text):
                label[start + t] = k
    out, run = [], None
    for p in range(len(text) + 1):
        k = label.get(p, 0)
        if run and (k == 0 or k % 2 or (k - 1) // 2 != run[0]):
            kind, a = pii.KINDS[run[0]], run[1]
            s = text[a:p]
            if re.search(r"[0-9@]|[(\[]at[)\]]", s) and not any(x < p and a < y for _, x, y in base) and (kind != "card" or pii.luhn(re.sub("[^0-9]", "", s))):
                out.append((kind, a, p))
            run = None
        if k and not run:
            run = ((k - 1) // 2, p)
    return out


def test_pii_query_against_brute_force(spark, tmp_path, tagger):
    texts = [r[1] for r in cases.rows()] + [t for t, _ in pii.labelled_examples(16, seed=5)]
    texts += ["Ä" * 40 + " mail bob (at) host.example.org now", "call (523) 555-1055 or a@b.co, 12 Mar 2024, id 7 " * 3, "4539 1488 0343 6467 12 4539148803436467"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").withColumn("base", F.lit("clash")).withColumn("key", F.lit(1))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r.asDict() for r in queries.op7_pii(spark, str(tmp_path)).collect()}
    added = 0
    for i, t in enumerate(texts):
        base = plain_pii(t or "")
        extra = slow_additions(t, tagger, base) if t and len(t) < 5000 else None
        digest = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (pii.KINDS.index(s[0]), s[1])))
        want = {"doc_id": i, **{f"n_{k}": sum(s[0] == k for s in base) for k in pii.KINDS}, "base_sha256": hashlib.sha256(digest(base).encode()).hexdigest()}
        assert {k: got[i][k] for k in want} == want
        if extra is not None:
            added += len(extra)
            assert got[i]["spans"] == digest(base + extra)
    assert added > 5


def test_secret_query_against_brute_force(spark, tmp_path):
    rnd = random.Random(3)
    texts = [r[1] for r in cases.rows()] + planted_secrets(rnd, 80)
    texts += ['Token = "abcdef123456" and password: hunter2x', "AKIA" + "A1" * 9 + " " + "0f" * 14, "api_key=abc secret = 'q7Zp2Lx9Vb4Nc8Mw1Tk6Ys3'"]
    spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, base string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r.asDict() for r in queries.op8_secret_scan(spark, str(tmp_path)).collect()}
    kinds = secret_scan.KINDS
    for i, t in enumerate(texts):
        base = plain_secrets(t or "")
        digest = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], kinds.index(s[0]))))
        want = {"doc_id": i, **{f"n_{k}": sum(s[0] == k for s in base) for k in kinds[:3]}, "base_sha256": hashlib.sha256(digest(base).encode()).hexdigest()}
        assert {k: got[i][k] for k in want} == want
        assert got[i]["spans"] == digest(base + slow_entropy(t or "", base))


def test_gradient():
    import numpy as np

    t = pii.Tagger(hidden=3, seed=1)
    t.p = {k: v.astype(np.float64) for k, v in t.p.items()}
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, pii.CLASSES, (2, 5)), rng.integers(0, pii.LABELS, (2, 5))
    _, grads = t.gradients(x, y)
    for k, g in grads.items():
        flat, i = t.p[k].reshape(-1), int(np.abs(g.reshape(-1)).argmax())
        keep = flat[i]
        flat[i] = keep + 1e-3
        up = t.gradients(x, y)[0]
        flat[i] = keep - 1e-3
        down = t.gradients(x, y)[0]
        flat[i] = keep
        assert abs((up - down) / 2e-3 - g.reshape(-1)[i]) < 1e-2 * max(1, abs(g.reshape(-1)[i]))


def test_method_keeps_base_spans_and_adds_none_that_touch(tagger):
    text = "call (523) 555-1055 or a@b.co, 12 Mar 2024, id 7 " * 3
    base = pii.base_spans(text)
    more = pii.method_spans([text], tagger, [base])[0]
    assert not any(a < f and e < b for _, a, b in more for _, e, f in base)


def plain_secrets(t):
    out = [("assign", *m.span()) for m in re.finditer(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[1]) >= 6]
    out += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return out + [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]


@pytest.mark.parametrize("seed", range(4))
def test_secret_base(seed):
    rnd = random.Random(seed)
    s = secret_scan.Scanner()
    pieces = ["token", "Token = ", 'api_key: "', "secret=", "ſecret=abcdef", "abcdef123456", "AKIA", "ABCDEFGHIJKLMNOP", "0f" * 12, "f" * 23, " ", "\n", "é", '"', "x"]
    for _ in range(400):
        t = "".join(rnd.choice(pieces) for _ in range(rnd.randrange(1, 10)))
        assert sorted(s.spans(t)[0]) == sorted(plain_secrets(t))


def plain_windows(t):
    """Merged windows over the threshold of their class, each counted anew."""
    merged = []
    for i in range(len(t) - 19):
        w = t[i : i + 20]
        kind = "hex" if set(w) <= set("0123456789abcdef") else "alnum" if w.isalnum() else "symbols"
        h = -sum(c / 20 * math.log2(c / 20) for c in Counter(w).values())
        if h >= secret_scan.THRESHOLDS[kind] - 1e-12 and any(c.isalpha() for c in w) and any(c.isdigit() for c in w):
            if merged and i <= merged[-1][1]:
                merged[-1] = (merged[-1][0], i + 20)
            else:
                merged.append((i, i + 20))
    return merged


def slow_entropy(t, base):
    out = []
    for m in re.finditer(r"[A-Za-z0-9+/_.=-]{20,}", t):
        s, scanner = m[0], secret_scan.Scanner()
        if scanner.allowed(s.strip(".=-_/+")):
            continue
        host = re.match(r"/*[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?=/|$)", s)
        parts = [m.span()]
        if host:
            cut = m.start() + host.end()
            parts = [(p.start(), p.end()) for p in re.compile(r"[^./]+").finditer(t, m.start(), cut)] + [(p.start(), p.end()) for p in re.compile("[^/]+").finditer(t, cut, m.end())]
            parts = [(a, b) for a, b in parts if not scanner.allowed(t[a:b].strip(".=-_+"))]
        out += [("entropy", a + x, a + y) for a, b in parts for x, y in plain_windows(t[a:b]) if not any(s < a + y and a + x < e for _, s, e in base)]
    return out


def planted_secrets(rnd, n):
    """Texts with one random token each, in the forms in which tokens are written down."""
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    forms = ["key {} end", "https://hooks.example.com/services/T0/B0/{}", "{}.prod", "x={};", "({})", "see host.example.org/{}/x", "Bearer {}", "{}.com/x"]
    return [cases.passage(rnd, 20) + " " + forms[i % len(forms)].format("".join(rnd.choice(alphabet) for _ in range(rnd.randrange(26, 41)))) + " " + cases.passage(rnd, 20) for i in range(n)]


def test_recall_of_entropy():
    s = secret_scan.Scanner()
    assert sum(bool(s.spans(t)[1]) for t in planted_secrets(random.Random(9), 400)) >= 0.97 * 400
    clean = ["www.example.com/en/articles/2024/how-we-built-it", "docs.example.org/reference/index.html", "the 2024-03-12T10:22:33 report", "well-known-words-of-1-sentence", "a.b.c.d.e.f.g.h.i.j.k.l.example.com"]
    assert not any(s.spans(t)[1] for t in clean)


def test_entropy_windows():
    """Incremental counts against a direct computation."""
    rnd = random.Random(1)
    for _ in range(60):
        t = "".join(rnd.choice("abcdefghij0123456789ABCDXYZ+/") for _ in range(rnd.randrange(15, 60)))
        assert secret_scan.entropy_spans(t) == plain_windows(t)


def test_allow_list():
    s = secret_scan.Scanner()
    assert s.spans("see www.example.com/docs/2024/a1-guide.html and 123e4567-e89b-12d3-a456-426614174000")[1] == []
    assert s.spans("www.example.com/a1b2c3d4e5f6g7h8i9j0k1")[1] == [("entropy", 16, 38)]
    assert s.spans("aB3dE5fG7hI9jK1lM2nO4pQ6.com/x")[1] == [("entropy", 0, 24)]
    assert s.spans("key q7Zp2Lx9Vb4Nc8Mw1Tk6Ys3 end")[1]


@pytest.mark.parametrize("name", ["op7_pii", "op8_secret_scan", "op2_license_scan", "op5_lang_id"])
def test_edge_cases(spark, tmp_path, name):
    for kind, df in (("full", cases.frame(spark)), ("empty", cases.empty(spark))):
        df.write.parquet(f"{tmp_path}/{kind}/documents.parquet")
        got = queries.QUERIES[name](spark, f"{tmp_path}/{kind}").collect()
        if kind == "full" and name != "op2_license_scan":
            assert sorted(r["doc_id"] for r in got if r["doc_id"] is not None) == sorted(r["doc_id"] for r in df.collect() if r["doc_id"] is not None)
        assert len(got) == (0 if kind == "empty" or name == "op2_license_scan" else df.count())


def test_license_bounds():
    """No unit outside the bounds can reach the threshold."""
    for m in (3, 10, 80):
        lo, hi = license_scan.bounds(m, 0.8)
        for n in range(1, 200):
            if not lo - 1e-9 <= n <= hi + 1e-9:
                assert 2 * min(m, n) / (m + n) < 0.8


def test_license_forms(spark):
    rows = [(1, "more words\n  released UNDER the 'MIT' license!  \nafter it"), (2, license_scan.TEMPLATES["gpl-3.0-header"]), (3, "license"), (4, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((r["doc_id"], r["unit"], r["license"], r["dice"]) for r in license_scan.scan_licenses(df).collect())
    assert got == [(1, 1, "mit", 1.0), (2, -1, "gpl-3.0-header", 1.0), (2, 0, "gpl-3.0-header", 1.0)]


@pytest.mark.parametrize(
    ("url", "want"),
    [
        (None, ("", "", None, "allow")), ("no scheme", ("", "", None, "allow")), ("http://EXAMPLE.com/en/x?q", ("example.com", "/en/x", "example.com/en/", "block")),
        ("http://www.example.com/en/", ("www.example.com", "/en/", "www.example.com/en/", "allow")), ("http://a.www.example.com/fr/", ("a.www.example.com", "/fr/", "com/", "allow")),
        ("http://x.net/es/a#b", ("x.net", "/es/a", "net/es/", "block")), ("http://x.net/es", ("x.net", "/es", None, "allow")), ("http://example.com", ("example.com", "", None, "allow")),
        ("http://notcom/", ("notcom", "/", None, "allow")), ("a://b://com/", ("b:", "//com/", None, "allow")), ("http://com/?x", ("com", "/", "com/", "allow")),
    ],
)
def test_urls(spark, url, want):
    df = spark.createDataFrame([(1, url, "h", "clash")], "page_id bigint, url string, html string, rule string")
    assert tuple(url_filter.filter_urls(df, queries.URL_RULES).first())[1:] == want


def test_url_rules_are_checked(spark):
    with pytest.raises(ValueError):
        url_filter.Trie([("a", "/", "allow"), ("a", "/", "block")])
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id bigint, url string"), []).count() == 0


def test_wrapped_license_notices(spark):
    wrap = lambda name, mark: [mark + x for x in textwrap.wrap(license_scan.TEMPLATES[name], 60)]
    before, after = ["import os", "", "def first(): pass"], ["", "a b c d", "the end of the file"]
    rows = [(i, "\n".join([*before, *wrap(name, mark), *after])) for i, (name, mark) in enumerate([("apache-2.0-header", "# "), ("gpl-3.0-header", " * "), ("mit-permission", ""), ("isc", "// ")])]
    rows.append((4, "\n".join([*before, *wrap("isc", "# "), *after, *wrap("mit-permission", "# "), *after])))
    rows += [(5, "\n".join(["own words", license_scan.TEMPLATES["mit"], "other words"])), (6, "\n".join(wrap("isc", "")))]
    rows += [(7, "\n".join([*before, *" \n \n".join(wrap("isc", "# ")).split("\n"), *after]))]
    got = license_scan.scan_licenses(spark.createDataFrame([*rows, rows[0]], "doc_id bigint, text string")).collect()
    wide = sorted((r["doc_id"], r["unit"], r["license"]) for r in got if r["unit"] < -1)
    isc = len(wrap("isc", ""))
    assert wide == [(0, -5, "apache-2.0-header")] * 2 + [(1, -5, "gpl-3.0-header"), (2, -5, "mit-permission"), (3, -5, "isc"), (4, -5 - isc - 3, "mit-permission"), (4, -5, "isc"), (7, -5, "isc")]
    assert all(r["dice"] == 1.0 for r in got if r["unit"] < -1)
    assert [(r["unit"], r["license"]) for r in got if r["doc_id"] == 5] == [(1, "mit")]
    assert [(r["unit"], r["license"]) for r in got if r["doc_id"] == 6] == [(-1, "isc")]


def test_full_license_texts_in_files(spark):
    """Texts of licences, wrapped as they are shipped, with a title and a copyright line, alone and inside a document."""
    names = ["mit-text", "bsd-3-clause-text", "isc-text", "apache-2.0-notice", "zlib", "unlicense"]
    body = lambda name: "\n".join(["A License", "", "Copyright (c) 2024 Some Body", "", *textwrap.wrap(license_scan.TEMPLATES[name], 78)])
    inside = lambda name: "\n".join(["first words of a readme", "", "more of them", *body(name).split("\n"), "", "the last words of the file"] + [cases.passage(random.Random(k), 9) for k in range(40)])
    rows = [(i, body(n)) for i, n in enumerate(names)] + [(10 + i, inside(n)) for i, n in enumerate(names)]
    got = license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    whole = {r["doc_id"]: r["license"] for r in got if r["unit"] == -1}
    wide = {r["doc_id"]: r["license"] for r in got if r["unit"] < -1}
    assert whole == dict(enumerate(names)) and {i: wide[10 + i] for i in range(len(names))} == dict(enumerate(names))
