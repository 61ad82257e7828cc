"""Language identification against its formulas worked out in Python, and its reader of html."""

import math
import re
import time

from pointweave.llm import langid
from pointweave.llm.langid import DOMAIN_PULL, HOST_PULL, LANGUAGES, SLOTS, SMOOTH, TEXT_WEIGHT, WORD, features, visible_text

WORDS = {"en": "the quick house river stone", "de": "der schnelle haus fluss stein", "fr": "la rapide maison riviere pierre", "es": "el rapido casa rio piedra"}


def soft(logs):
    parts = [math.exp(x - max(logs)) for x in logs]
    return [p / sum(parts) for p in parts]


def brute(pages, docs):
    many = range(len(LANGUAGES))
    slots = [[SMOOTH] * SLOTS for _ in many]
    for text, lang in docs:
        if lang in LANGUAGES:
            for word in WORD.findall((text or "").lower()):
                for at in features(word):
                    slots[LANGUAGES.index(lang)][at] += 1
    totals = [sum(s) for s in slots]
    rows = []
    for page_id, url, html in pages:
        at = [x for word in WORD.findall(visible_text(html or "").lower()) for x in features(word)]
        text = [TEXT_WEIGHT * sum(math.log(slots[i][x] / totals[i]) for x in at) / len(at) if at else 0.0 for i in many]
        host = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
        host = host[1].lower() if host else ""
        tag = re.search(r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?\s*([a-z]+)", html or "")
        mark = tag[1].lower() if tag else "none"
        domain = re.search(r"[^.]+\.[^.]+$", host)
        rows.append((page_id, host, domain[0] if domain else "", host.rsplit(".", 1)[-1], mark if mark in (*LANGUAGES, "none") else "other", text, soft(text)))
    whole = [sum(r[6][i] for r in rows) for i in many]
    base = [(w + SMOOTH) / (sum(whole) + SMOOTH * len(LANGUAGES)) for w in whole]
    kinds = len({r[3] for r in rows})
    out = {}
    for r in rows:
        def others(column, r=r):
            return [max(0.0, sum(o[6][i] for o in rows if o[column] == r[column] and (column != 2 or o[3] == r[3])) - r[6][i]) for i in many]

        h, d, s, m = others(1), others(2), others(3), others(4)
        logs = []
        for i in many:
            rest = max(0.0, whole[i] - r[6][i])
            prior = (h[i] + HOST_PULL * (d[i] + DOMAIN_PULL * base[i]) / (sum(d) + DOMAIN_PULL)) / (sum(h) + HOST_PULL)
            logs.append(r[5][i] + math.log((m[i] + SMOOTH) / (rest + SMOOTH * (len(LANGUAGES) + 2))) + math.log((s[i] + SMOOTH) / (rest + SMOOTH * kinds)) + math.log(prior))
        p = soft(logs)
        best = max(many, key=lambda i: (p[i], -i))
        out.setdefault(r[0], []).append((r[1], r[4], LANGUAGES[best], p[best]))
    return out


def test_posteriors_equal_the_formulas(spark):
    docs = [(t, k) for k, t in WORDS.items()] + [(None, "en"), ("xx yy", "xx"), ("", None)]
    pages = []
    for i, (k, t) in enumerate(list(WORDS.items()) * 4):
        mark = ("de", k, "it", "")[i % 4]
        host = ("a.example.org", "b.example.org", f"{k}.blog.{k}", "user@shop.de:80")[i // 4]
        pages.append((i, f"https://{host}/x?y=http://z.fr", f"<html lang='{mark}'><nav>der der</nav><p>{t} {t.split()[i % 5]}</p></html>"))
    pages += [(50, None, None), (51, "https://a.example.org", ""), (52, "no address", "<p>river"), (None, "https://a.example.org", "<p>stein"), pages[0], pages[0], (53, "https://e.org", "stone " * 20_000)]
    d = spark.createDataFrame([(i, t, k, 1) for i, (t, k) in enumerate(docs)], "doc_id long, text string, lang string, host int")
    p = spark.createDataFrame([(*x, "own", 0.5) for x in pages], "page_id long, url string, html string, lang string, probability double")
    got, expected = {}, brute(pages, docs)
    for r in langid.identify(p, d).collect():
        got.setdefault(r["page_id"], []).append((r["host"], r["declared"], r["lang"], r["probability"]))
    assert got.keys() == expected.keys()
    for page_id, own in expected.items():
        for a, b in zip(sorted(own), sorted(got[page_id]), strict=True):
            assert a[:3] == b[:3] and abs(a[3] - b[3]) < 1e-9


def test_empty_tables(spark):
    pages = spark.createDataFrame([(1, "https://a.org", "<p>word")], "page_id long, url string, html string")
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert [r["lang"] for r in langid.identify(pages, docs).collect()] == ["en"]  # equal evidence: the first of the list
    assert langid.identify(pages.limit(0), docs).count() == 0


def test_visible_text():
    squeezed = lambda t: " ".join(visible_text(t).split())
    assert squeezed("<head><title>t</title></head>a<script>x</p></script >b<!-- c -->d<nav>n</nav>&amp;e") == "a b d &e"
    assert squeezed("a<div class='big ad'>no</div>b<div class=\"address\">yes</div><script>open") == "a b yes open"
    assert squeezed("1 < 2 <b>x") == "1 x" and squeezed("x < y") == "x < y" and squeezed("") == ""


def test_broken_html_is_read_in_linear_time():
    began = time.process_time()
    for piece in ("<script ", "<", "<!-- ", "<div class=\"", "<nav></na", "</script ", "&#", "<div class='ad'>"):
        visible_text(piece * (2_000_000 // len(piece)))
    assert time.process_time() - began < 60
