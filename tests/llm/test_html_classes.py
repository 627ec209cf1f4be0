"""Operator 1 against a plain deduction of equivalence classes, host by host, with whole vectors."""

import collections
import random

import pytest
from llm_words import prose
from pyspark.sql import functions as F

from loomlog.llm import html_extract


class Made:
    """A page built element by element: its html and its tokens in order."""

    def __init__(self):
        self.html, self.tokens = [], []

    def element(self, path, *inside):
        name = path.rpartition(">")[2]
        tag, _, label = name.partition(".")
        self.html.append(f"<{tag} class='{label}'>" if label else f"<{tag}>")
        self.tokens.append(("e", path))
        for x in inside:
            if callable(x):
                x(path)
            else:
                self.html.append(x)
                self.tokens.append(("t", path, x))
        self.html.append(f"</{tag}>")


def _page(rng, host, k):
    page = Made()
    put = lambda name, *inside: lambda path: page.element(f"{path}>{name}", *inside)
    paragraphs = [put("p", prose(rng, rng.randint(8, 30))) for _ in range(rng.randint(1, 4))]
    if rng.random() < 0.95:
        paragraphs.append(put("p", "This line stands on nearly every page"))
    parts = [put("div.k1", put("div.k2", "Start"), put("div.k2", "Topics"), put("div.k3", prose(rng, 1)))]
    if host % 2 and k % 2 == 0:  # a class on half of the pages that crosses the one of all pages
        parts += [put("div.v1", "Left"), put("div.u1", "Here"), put("div.v2", "Right"), put("div.u2", "There"), put("div.v3", "Down")]
    else:
        parts += [put("div.u1", "Here"), put("div.u2", "There")]
    if k % 3 == 0:
        parts.append(put("div.q1", put("div.q2", "Buy two"), put("div.q3", "get one")))
    parts.append(put("div.m1", put("h2", prose(rng, 5)), *paragraphs))
    parts.append(put("div.z1", put("div.z2", "Rules of the house"), put("div.z3", prose(rng, 2))))
    put("html", put("body", *parts))("")
    return "".join(page.html), page.tokens


def _nested(a, b):
    """Apart, or one between two neighbours of the other."""
    within = lambda x, y: any(p < x[0] and x[-1] < q for p, q in zip(y, y[1:], strict=False))
    return a[-1] < b[0] or b[-1] < a[0] or within(a, b) or within(b, a)


def _deduced(pages):
    """(number of valid classes, main slot, text of each page) for a host's token lists."""
    n = len(pages)
    counts = [collections.Counter(p) for p in pages]
    classes = collections.defaultdict(list)
    for token in {t for p in pages for t in p}:
        vector = tuple(c[token] for c in counts)
        held = sum(x > 0 for x in vector)
        if held >= 5 and held >= 0.3 * n:
            classes[vector].append(token)
    classes = {v: sorted(ts, key=lambda t: sum(p.index(t) for p in pages if t in p)) for v, ts in classes.items() if len(ts) >= 3}
    weight = {v: (sum(x > 0 for x in v), len(ts)) for v, ts in classes.items()}
    faults = collections.Counter()
    for p in pages:
        bad = {v for v, ts in classes.items() if [t for t in p if t in ts] != ts * (sum(t in ts for t in p) // len(ts))}
        spans = {v: [[k for k, t in enumerate(p) if t in ts][a : a + len(ts)] for a in range(0, sum(t in ts for t in p), len(ts))] for v, ts in classes.items() if v not in bad}
        crossing = set()
        for v in spans:
            for w in spans:
                if v != w and any(not _nested(a, b) for a in spans[v] for b in spans[w]):
                    crossing.add(min(v, w, key=weight.get))
        faults.update(bad | crossing)
    valid = {v for v in classes if faults[v] <= 0.05 * weight[v][0]}
    held = {t for ts in classes.values() for t in ts}
    template = {t for v in valid for t in classes[v]}
    mass = collections.Counter()
    for p in pages:
        for t in p:
            if t[0] == "t" and t not in held:
                slot = t[1].rpartition(">")[0] if t[1].rpartition(">")[2] in ("p", "h2") else t[1]
                while slot and ("e", slot) not in held:
                    slot = slot.rpartition(">")[0]
                mass[slot] += len(t[2])
    main = max((m, s) for s, m in mass.items() if ("e", s) in template)[1]
    constant = {t for v in valid if weight[v][0] >= 0.9 * n for t in classes[v]}
    return len(valid), main, ["\n".join(t[2] for t in p if t[0] == "t" and t not in constant and f"{t[1]}>".startswith(f"{main}>")) for p in pages]


@pytest.fixture(scope="module")
def made(spark):
    rng = random.Random(17)
    pages = {h: [_page(rng, h, k) for k in range(30 + 7 * h)] for h in range(4)}
    rows = [(100 * h + k, f"https://host{h}.example/{k}", html) for h, own in pages.items() for k, (html, _) in enumerate(own)]
    return pages, spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)


def test_op1_equals_a_plain_deduction(made):
    pages, table = made
    got = {r.page_id: r.text for r in html_extract.extract(table).collect()}
    found = {r.host: r for r in html_extract.templates(table.withColumn("host", html_extract.host_of(F.col("url")))).collect()}
    for h, own in pages.items():
        n, main, texts = _deduced([tokens for _, tokens in own])
        told = found[f"host{h}.example"]
        assert (told.classes, told.main) == (n, main) and main.endswith("div.m1")
        assert [got[100 * h + k] for k in range(len(own))] == texts
    # the frequent line shares its vector with no other token, so it is no class and stays
    assert sum("This line stands" in t for t in got.values()) > 0.9 * len(got)
    assert not any("Rules of the house" in t or "Start" in t for t in got.values())


def test_op1_classes_that_cross_lighter_ones():
    a = {"vector": 1, "pages": 10, "tokens": [1, 2, 3]}
    b = {"vector": 2, "pages": 5, "tokens": [7, 8, 9]}
    known = html_extract.Classes([a, b])
    told = lambda tokens: sorted(known.vectors[c] for c in known.faults(tokens))
    assert told([1, 2, 3, 1, 2, 3, 7, 8, 9]) == [] and told([1, 7, 8, 9, 2, 3]) == [] and told([7, 1, 2, 3, 8, 9]) == []
    assert told([1, 7, 2, 8, 3, 9]) == [2] and told([7, 1, 8, 2, 9, 3]) == [2]
    assert told([1, 3, 2]) == [1] and told([1, 2]) == [1] and told([7, 8, 9, 9]) == [2] and told([4, 5]) == []


def test_op1_template_inside_an_article(spark):
    rng = random.Random(19)
    rows = []
    for k in range(40):
        own = "".join(f"<p>{prose(rng, 12)}</p>" for _ in range(rng.randint(1, 5)))
        line = "<p>A line that most pages have</p>" if k % 10 else ""
        rows.append((k, f"https://a.example/{k}", f"<html><body><article><h1>{prose(rng, 4)}</h1><div class=x7><div class=x8>Written by our staff</div></div>{own}{line}</article></body></html>"))
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert not any("Written by our staff" in t for t in got.values())
    assert all(("A line that most pages have" in got[k]) == (k % 10 > 0) for k in got) and all(t.count("\n") >= 1 for t in got.values())
