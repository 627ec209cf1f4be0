"""Operators 1, 5, 6, 7 and 8 against brute force, plain rules or held-out labels."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from llm_words import WORDS, prose
from pyspark.sql import functions as F

from loomlog.llm import common, decontaminate, html_extract, licenses, pii, quality, shingles

# -- 1

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body class="has-sidebar">
<header><h1>Site</h1></header><div class="cookie-notice">We use cookies</div><nav><ul><li>Home<li>About</ul></nav>
{body}<aside>side</aside><form><label>Name</label><input></form><footer>&copy; c</footer><script>if (a<b) "</p>"</script></body></html>"""
PAGES = "page_id long, url string, html string"


@pytest.mark.parametrize(
    ("body", "text"),
    [
        ("<article><h1>A &amp; B</h1><p>One  <b>bold</b>\ntwo<p>Three<br>four</article>", "A & B\nOne bold two\nThree four"),
        ("<article><p>x</p><section class=comments><p>Nice!</p></section><div class='ad banner'>buy</div></article>", "x"),
        ("<main><p>x</p><ul><li>a<li>b</ul></main>", "x\na\nb"),
        ("<div id=content><p>x &lt;y&gt; &#233;&eacute;</p></div>", "x <y> éé"),
        ("<article><p>keep <span hidden>not</span> this</p><!-- <p>no</p> --><noscript>no</noscript></article>", "keep this"),
        ("<article><table><tr><td>a<td>b<tr><td>c</table></article>", "a\nb\nc"),
        ("<article><p>cut of", "cut of"),
        ("<article></article>", ""),
        ("<div class='site-header'><p>Site</p></div><div><div class='entry-header'><h1>T</h1></div><p>x</p><ol class=commentlist><li>hi</ol></div>", "T\nx"),
        ("<article><div class='article-header'><h1>T</h1></div><p>x</p><div class=post-footer>by</div></article>", "T\nx"),
    ],
)
def test_op1_page_shapes(body, text):
    html = PAGE.format(body=body)
    if body.endswith("of"):
        html = html[: html.index("cut of") + 6] + "<div cla"
    assert html_extract.text_of(html, None, frozenset()) == text


def test_op1_template_of_a_host(spark):
    rng = random.Random(1)
    want, rows = {}, []
    for k in range(12):
        own = [prose(rng, 30), prose(rng, 40)]
        body = f"<div class=wrap><div class=top><p>Read our terms today</p></div><div class=story><h2>{own[0]}</h2><p>{own[1]}</p></div><div class=more><p>About us here</p></div></div>"
        rows.append((k, f"https://h.example/{k}?q#f", f"<html><body>{body}</body></html>"))
        want[k] = "\n".join(own)
    pages = spark.createDataFrame([*rows, (90, None, None), (91, "https://one.example", "<p>alone</p>"), (None, "x", ""), (91, "https://one.example", "<p>alone</p>")], PAGES)
    got = [tuple(r) for r in html_extract.extract(pages.withColumn("host", F.lit(1)).withColumn("main", F.lit(1))).collect()]
    assert {p: t for p, _, t, _ in got if p in want} == want
    assert sorted((p, t, n) for p, _, t, n in got if p in (90, 91)) == [(90, "", 0), (91, "alone", 5), (91, "alone", 5)]
    assert all(n == len(t) for _, _, t, n in got) and len(got) == 16
    found = html_extract.templates(pages.withColumn("host", html_extract.host_of(F.col("url"))).fillna({"html": ""})).where("host = 'h.example'").first()
    assert found.main.endswith("div.story") and len(found.constants) == 2
    assert html_extract.extract(pages.where("false")).count() == 0


def test_op1_every_page_of_a_table(spark):
    d = "/root/testdata/sf0.001"
    got = {r.page_id: r.text for r in html_extract.op1_html_extract(spark, d).collect()}
    for r in common.table(spark, d, "pages").collect():
        inner = re.search(r"<article>(.*?)(?:</article>|(?:<[^>]*)?\Z)", r.html, re.S)[1]
        parts = [" ".join(html_extract.entities.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:h1|p)>", inner.replace("<br>", " "))]
        assert got[r.page_id] == "\n".join(x for x in parts if x)


# -- 5


def test_op5_catches_items_and_reparameterised_ones(spark, make):
    rng = random.Random(2)
    plain = [prose(rng, n) for n in (15, 20, 40, 59)]
    slots = "A train leaves the old station with 120 km to go and Alice waits for 30 minutes until Alice and 120 others get on board with 7 bags"
    changed = slots.replace("120", "250").replace("Alice", "Robert").replace("30", "45").replace("7", "9")
    clash = changed.replace("until Robert", "until Emma")
    items = spark.createDataFrame([(k, t) for k, t in enumerate([*plain, slots, "too short", None, "six words that stand right here"])], "item_id long, text string")
    host = lambda t: f"{prose(rng, 40)} {t} {prose(rng, 40)}"
    rows = [(k, host(t)) for k, t in enumerate([*plain, slots, changed, clash])]
    rows += [(10, plain[3].upper()), (11, host("Then six words that stand right here.")), (12, prose(rng, 200)), (13, None), (14, ""), (15, "too short"), (None, plain[0]), (16, " ".join(plain[3].split()[:11])), (17, " ".join(plain[3].split()[20:34]))]
    docs = make(rows).withColumn("item_id", F.lit(3))
    got = decontaminate.contaminated(common.with_row_id(docs, "rid").select("rid", "text").join(common.with_row_id(docs, "rid").select("rid", "doc_id"), "rid").select("rid", common.text_of().alias("text")), items)
    ids = dict(map(tuple, common.with_row_id(docs, "rid").select("rid", "doc_id").collect()))
    found = {(ids[r.rid], r.item_id) for r in got.collect()}
    assert found == {(0, 0), (1, 1), (2, 2), (3, 3), (4, 4), (5, 4), (10, 3), (11, 7), (None, 0), (17, 3)}
    left = decontaminate.decontaminate(docs, items)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [6, 12, 13, 14, 15, 16]
    assert decontaminate.decontaminate(docs.where("false"), items).count() == 0
    assert decontaminate.decontaminate(docs, items.where("false")).count() == docs.count()


def test_op5_equals_brute_force(spark):
    d = "/root/testdata/sf0.001"
    words = re.compile(r"[0-9]+(?:[.,][0-9]+)*|[^\W\d_]+").findall
    items = {r.item_id: words(r.text.lower()) for r in common.table(spark, d, "benchmark").collect()}
    want = set()
    for r in common.table(spark, d, "documents").collect():
        w = words((r.text or "").lower())
        held = {tuple(w[k : k + 8]) for k in range(len(w) - 7)}
        for i, x in items.items():
            own = [tuple(x[k : k + 8]) for k in range(len(x) - 7)]
            if own and sum(g in held for g in own) >= min(0.5 * len(own), 6):
                want.add((r.doc_id, i))
    got = {(r.doc_id, r.item_id) for r in decontaminate.op5_decontaminate(spark, d).collect()}
    assert got == want and want


def test_op5_shuffled_benchmark_gives_the_same(spark, monkeypatch):
    d = "/root/testdata/sf0.001"
    once = sorted(map(tuple, decontaminate.op5_decontaminate(spark, d).collect()))
    monkeypatch.setattr(decontaminate, "MOST_BROADCAST", 0)
    assert sorted(map(tuple, decontaminate.op5_decontaminate(spark, d).collect())) == once


def _held(spark, texts, items):
    docs = spark.createDataFrame(list(enumerate(texts)), "rid long, text string")
    return {(r.rid, r.item_id) for r in decontaminate.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}


def test_op5_one_clean_occurrence_is_enough(spark):
    rng = random.Random(12)
    day = "On {} the baker sold {} loaves of bread and went home late in the evening ."
    twice = f"{day.format('Monday', 12)} {day.format('Tuesday', 15)}"
    one = "A train leaves the old station with 120 km to go and Alice waits for 30 minutes until they get on board with 7 bags"
    other, third = one.replace("120", "250").replace("Alice", "Robert"), one.replace("30", "45").replace("Alice", "Emma")
    cases = [(twice, 0), (f"{one} {prose(rng, 30)} {other}", 1), (f"{other} {prose(rng, 30)} {third}", 1), (f"{one} {prose(rng, 90)} the old station with 99 km to go and Peter waits", 1)]
    assert _held(spark, [x for x, _ in cases], [(0, twice), (1, one)]) == {(k, i) for k, (_, i) in enumerate(cases)}


def test_op5_plain_copies_of_any_kind(spark):
    german = "Der Bauer verkauft am Montag seine Ernte auf dem Markt in Bremen und kauft danach Brot Milch und Butter für die Familie im Dorf"
    items = [(0, german), (1, "What Is The Capital Of France And Which River Runs Through It"), (2, "Solve 12 34 56 78 90 11 13 17 19 23"), (None, "the quick fox jumps over a lazy dog near some old barn")]
    texts = [german.lower(), german.upper(), *(x for _, x in items[1:])]
    assert _held(spark, texts, items) == {(0, 0), (1, 0), (2, 1), (3, 2), (4, None)}


# -- 6

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _luhn(digits):
    return sum(int(c) if k % 2 == 0 else sum(map(int, str(2 * int(c)))) for k, c in enumerate(reversed(digits))) % 10 == 0


def _spans(text):
    out = []
    for k, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(digits) <= 19 and _luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def _told(spans):
    return ",".join(f"{list(PATTERNS)[k]}:{a}:{b}" for a, k, b in spans)


def _check(docs, got):
    want = collections.Counter()
    for r in docs.collect():
        s = _spans(r.text or "")
        want[(r.doc_id, *(sum(x[1] == k for x in s) for k in range(4)), hashlib.sha256(_told(s).encode()).hexdigest())] += 1
    assert collections.Counter(tuple(r)[:6] for r in got) == want


def test_op6_odd_texts(make, odd, empty):
    texts = [
        "a@b.c a@b.c_d@e.f x@y @z.w q@-.- a@b..c", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1112 378282246310005 0", "+1 (743) 555-3824 +12 +1234567890123456 +1..........2 +442079460958.",
        "é😀 me.42@x.org 😀 10.0.0.1", "4" * 3000, "a" * 3000 + "@", "1." * 2000, "+" + "1" * 3000, "+1" + "(" * 3000, "mail:4111111111111111,10.0.0.1;u@h.io", "a" * 5000 + "@b.cc", "\x01 u@h.io\nu@h.io\r\n",
    ]
    docs = make(list(enumerate(texts)))
    _check(docs, pii.report(docs).collect())
    _check(odd, pii.report(odd).collect())
    assert pii.report(empty).count() == 0


def test_op6_random_texts(make):
    rng = random.Random(4)
    docs = make([(k, "".join(rng.choice("0123456789.@+- ()ab_%é\n") for _ in range(rng.randint(0, 120)))) for k in range(300)])
    _check(docs, pii.report(docs).collect())


def test_op6_contexts_lead_to_unseen_identifiers(make):
    rng = random.Random(7)
    rows = []
    for k in range(60):
        mail = f"user{k}@mail.example.com" if k % 3 else f"ZX-{1000 + k}-QQ"
        rows.append((k, f"{prose(rng, 20)} my contact id {mail} {prose(rng, 20)} the room 10234 was {prose(rng, 5)}"))
    rows.append((99, f"{prose(rng, 20)} the room 10.0.0.1 was"))
    got = {r.doc_id: r for r in pii.report(make(rows)).collect()}
    for k, text in rows[:60]:
        at = text.find(f"ZX-{1000 + k}-QQ")
        assert ("id:" in got[k].spans) == (k % 3 == 0)
        if k % 3 == 0:
            assert f"id:{at}:{at + 10}" in got[k].spans.split(",") and got[k].n_email == 0


def test_op6_unrelated_seeds_take_no_finds_away(make):
    rng = random.Random(8)
    rows = [(k, f"my contact id {f'user{k}@mail.example.com' if k < 4 else f'ZX-{1000 + k}-QQ'} {prose(rng, 5)}") for k in range(6)]
    rows.append((99, " ".join(f"x{k}@mail.example.com" for k in range(3000))))
    got = {r.doc_id: r.spans for r in pii.report(make(rows)).collect()}
    assert [got[k] for k in (4, 5)] == ["id:14:24"] * 2


def test_op6_matches_without_two_words_before_them(make):
    rng = random.Random(9)
    rows = [(k, f"{prose(rng, 5)} my contact id {f'user{k}@mail.example.com' if k % 3 else f'ZX-{1000 + k}-QQ'} {prose(rng, 5)}") for k in range(60)]
    lines = ["ZX-1000-QQ", "ID: ZX-1003-QQ", "my contact id ZX-1000-QQ, ZX-1003-QQ and ZX-1006-QQ. ID: ZX-1009-QQ", f"see{' ' * 90}ZX-1012-QQ", f"{'w' * 100} room ZX-1015-QQ 10234"]
    rows += [(100 + k, x) for k, x in enumerate(lines)]
    got = {r.doc_id: r.spans for r in pii.report(make(rows)).collect()}
    for k, x in enumerate(lines):
        assert got[100 + k] == ",".join(f"id:{m.start()}:{m.end()}" for m in re.finditer(r"ZX-\d+-QQ", x))


def test_op6_markers_are_learnt_and_counted(make):
    rows = [(k, f"id: {f'user{k}@mail.example.com' if k < 4 else f'ZX-{1000 + k}-QQ'} by") for k in range(6)]
    got = {r.doc_id: r.spans for r in pii.report(make(rows)).collect()}
    assert [got[k] for k in (4, 5)] == ["id:4:14"] * 2
    more = [(k + 10, "id: unknown") for k in range(90)]  # the same pattern, mostly before plain words
    assert {r.spans for r in pii.report(make(rows + more)).collect() if r.doc_id in (4, 5)} == {""}


# -- 7


def test_op7_holds_out_and_separates(spark):
    d = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in quality.op7_quality(spark, d).collect()}
    labels = dict(map(tuple, common.table(spark, d, "labels").select("doc_id", "quality").collect()))
    assert len(got) == common.table(spark, d, "documents").count()
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    out = [(got[i].predicted, y) for i, y in labels.items() if got[i].held_out]
    assert np.mean([p == y for p, y in out]) >= 0.97


def test_op7_learns_only_from_its_rows(spark, make):
    rng = random.Random(3)
    rows = [(k, prose(rng, 40) if k % 2 else "!! " + "JUNK ## " * 30) for k in range(200)]
    docs = make(rows)
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(200)], "doc_id long, quality int, toxic int")
    # held-out labels turned about, nulls, repeats and other values change nothing
    wrong = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    more = wrong.unionByName(spark.createDataFrame([(None, 1, 0), (1, None, 0), (3, 7, 0), (5, 1, 0)], labels.schema))
    a, b = quality.train(docs, labels), quality.train(docs, more)
    x = np.array([quality.features(t) for _, t in rows])
    assert (a.score(x) == b.score(x)).all() and ((a.score(x) >= 0.3) == np.arange(200) % 2).all()


def test_op7_odd_rows(spark, odd, empty, clashing):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality.train(odd, labels)
    assert {r[0] for r in quality.scored(odd, model).select(quality.SCORE).collect()} == {0.5}
    kept = quality.keep_good(clashing, labels)
    assert kept.columns == clashing.columns and kept.count() == clashing.count()
    assert quality.keep_good(empty, labels).count() == 0
    for text in ("", "\n\n", "a", "é" * 10):
        assert np.isfinite(quality.features(text)).all() and len(quality.features(text)) == len(quality.FEATURES)


def test_op7_pairs_matter():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x, y, rounds=20)
    assert model.pairs[0] == (1, 0) and np.mean((model.score(x) > 0.5) == y) > 0.9


# -- 8


def test_op8_finds_templates_anywhere():
    scan = licenses.Scanner()
    rng = random.Random(9)
    for name, texts in licenses.TEMPLATES.items():
        for text in texts:
            if len(shingles.words(text.lower())) < shingles.SIZE:
                continue
            for lead in (0, 3, 7, 40, 333):
                whole = f"{prose(rng, lead)} {text} {prose(rng, 30)}"
                found = scan.scan(whole)
                n = len(shingles.words(text.lower()))
                assert any(x[0] == name and x[1] == 1 and x[2] <= lead and x[3] >= lead + n for x in found), (name, lead, found)


def test_op8_containment_decides(make, odd, empty):
    text = licenses.TEMPLATES["apache-2.0"][1]
    words = text.split()
    changed = " ".join([*words[:30], "changed", *words[31:]])
    rng = random.Random(1)
    rows = [(1, changed), (2, " ".join(words[:8])), (3, prose(rng, 500)), (4, "Released under the MIT License." * 2), (5, "under the GNU General Public License")]
    got = sorted(map(tuple, licenses.scan(make(rows)).select("doc_id", "license", F.round("containment", 2)).collect()))
    assert [x[:2] for x in got if x[0] == 2] == [(2, "apache-2.0")] and [x[:2] for x in got if x[0] == 4] == [(4, "mit")]
    assert any(x[:2] == (1, "apache-2.0") for x in got) and not any(x[0] in (3, 5) for x in got)
    assert licenses.scan(odd).count() == 0 and licenses.scan(empty).count() == 0


def test_op8_equals_exact_containment(spark):
    d = "/root/testdata/sf0.01"
    got = {(r.doc_id, r.license) for r in licenses.op8_license_scan(spark, d).collect()}
    scan = licenses.Scanner()
    want = set()
    for r in common.table(spark, d, "documents").collect():
        own = shingles.distinct(r.text or "")
        for (name, _), s in zip(scan.names, scan.sets, strict=True):
            if len(s) and len(np.intersect1d(own, s)) == len(s):
                want.add((r.doc_id, name))
    assert want <= got and {x for x, _ in got} == {x for x, _ in want}


def test_words_of_the_prose_are_plain():
    assert all(w.isalpha() for w in WORDS)


def test_op8_bands_retrieve_what_is_contained():
    scan = licenses.Scanner()
    rng = random.Random(31)
    met = asked = 0
    for _ in range(40):
        for k, (name, text) in enumerate(scan.names):
            words = text.split()
            for at in rng.sample(range(len(words)), rng.choice((0, 0, 1, max(1, len(words) // 50)))):
                words[at] = rng.choice(WORDS)
            whole = " ".join([prose(rng, rng.choice((0, 5, 300))), *words, prose(rng, rng.choice((0, 40)))])
            own = shingles.sequence(shingles.word_hashes(whole))
            if len(np.intersect1d(own, scan.sets[k])) >= 0.8 * len(scan.sets[k]):
                asked += 1
                met += any(i == k for i, _, _ in scan.retrieved(own))
    assert asked > 500 and met >= 0.999 * asked


def test_op8_nothing_is_found_without_a_shared_band(monkeypatch):
    scan = licenses.Scanner()
    text = licenses.TEMPLATES["unlicense"][1]
    assert [x[0] for x in scan.scan(text)] == ["unlicense"]
    monkeypatch.setattr(scan, "_looked_up", lambda size, keys: set())
    assert scan.scan(text) == []


def test_op8_tells_licenses_apart():
    scan = licenses.Scanner()
    rng = random.Random(5)
    for name in ("bsd-2-clause", "bsd-3-clause", "isc", "mit", "zlib", "bsl-1.0", "agpl-3.0", "lgpl"):
        text = licenses.TEMPLATES[name][-1]
        found = scan.scan(f"{prose(rng, 5000)} {text} {prose(rng, 50)}")
        assert {x[0] for x in found} == {name} and found[0][1] == 1, (name, found)


def test_op6_rare_patterns_are_learnt_in_a_large_table(spark, make):
    rng = random.Random(41)
    names = [f"{rng.choice(WORDS)}{rng.choice(WORDS)}" for _ in range(30)]
    rows, planted = [], {}
    for group, (name, n) in enumerate(zip(names, [3, 10, 100] * 10, strict=True)):
        for k in range(n):
            rows.append((None, f"{prose(rng, 4)} the {name} number u{group}x{k}@h.example {prose(rng, 4)}"))
        for k in range(max(1, n // 10)):
            value = f"QX-{group}-{k}9"
            planted[len(rows)] = value
            rows.append((None, f"{prose(rng, 4)} the {name} number {value} {prose(rng, 4)}"))
    rows += [(None, f"{prose(rng, 8)} m{k}@other.example {prose(rng, 3)} room {k}") for k in range(20_000)]
    rows = [(k, t) for k, (_, t) in enumerate(rows)]
    got = {r.doc_id: r.spans for r in pii.report(make(rows).repartition(8)).where(F.col("doc_id").isin(list(planted))).collect()}
    want = {k: f"id:{rows[k][1].index(v)}:{rows[k][1].index(v) + len(v)}" for k, v in planted.items()}
    assert sum(want[k] in got[k] for k in want) >= 0.9 * len(want)
