"""HMM scores, fingerprints, chat formatting, HTML extraction and quality rules."""

import collections
import hashlib
import html
import itertools
import json
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest_llm import SCHEMA, clashing, corpus, table  # noqa: F401
from reasonscope.llm import chat, fingerprints, hmm, html_template, quality


def words_of(text):
    return re.findall("[^\x20\x09-\x0D]+", text or "")


# --- hidden Markov model ---

def test_expected_counts_equal_enumeration():
    r = np.random.default_rng(2)
    o = hmm.HmmOptions(states=3, segment=100, together=2)
    model = hmm.Model(r.dirichlet(np.ones(3)), r.dirichlet(np.ones(3), 3), r.dirichlet(np.ones(5), 3).T)
    sequences = [r.integers(0, 5, n) for n in (1, 4, 6, 2)]
    start, move, emit = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))
    logs = []
    for s in sequences:
        total, parts = 0.0, []
        for path in itertools.product(range(3), repeat=len(s)):
            p = model.start[path[0]] * model.emit[s[0], path[0]]
            for i in range(1, len(s)):
                p *= model.move[path[i - 1], path[i]] * model.emit[s[i], path[i]]
            parts.append((path, p))
            total += p
        logs.append(np.log10(total))
        for path, p in parts:
            start[path[0]] += p / total
            for i, k in enumerate(path):
                emit[s[i], k] += p / total
                if i:
                    move[path[i - 1], k] += p / total
    flat, lengths = np.concatenate(sequences), np.array([len(s) for s in sequences])
    for got, want in zip(hmm.expected(model, flat, lengths, o), (start, move, emit)):
        assert np.allclose(got, want)
    assert np.allclose(hmm.likelihoods(model, flat, lengths), logs)


def test_training_raises_the_likelihood():
    r = np.random.default_rng(3)
    o = hmm.HmmOptions(states=2, prior=1.0)
    sequences = [r.integers(0, 10, 50) + 10 * (i % 2) for i in range(20)]
    flat, lengths = np.concatenate(sequences), np.array([50] * 20)
    share = np.full(20, 1 / 20)
    model, seen = hmm.first_model(share, o), []
    for _ in range(8):
        seen.append(hmm.likelihoods(model, flat, lengths).sum())
        model = hmm.improved(*hmm.expected(model, flat, lengths, o), share, o)
    assert all(b >= a - 0.5 for a, b in zip(seen, seen[1:])) and seen[-1] > seen[0] + 100


@pytest.mark.parametrize("dictionary,head", [(1 << 18, 1 << 14), (64, 16), (0, 0)])
def test_scores(spark, corpus, dictionary, head):
    o = hmm.HmmOptions(states=3, passes=2, dictionary=dictionary, head=head, buckets=8)
    rows = hmm.score(clashing(table(spark, corpus), "row", "score"), options=o).collect()
    assert len(rows) == len(corpus)
    key = lambda i: "" if i is None else str(i)
    train = collections.Counter(t for i, x in corpus if zlib.crc32(key(i).encode()) % 10 for t in hmm.tokens((x or "").encode()))
    total, distinct = sum(train.values()), len(train)
    want = []
    for i, x in corpus:
        ts = hmm.tokens((x or "").encode())
        base = sum(np.log10((train[t] + 0.1) / (total + 0.1 * (distinct + 1))) for t in ts)
        want.append((str(i), zlib.crc32(key(i).encode()) % 10 == 0, len(ts), sum(t in train for t in ts), total, round(base, 6)))
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows) == sorted(want)
    assert all(np.isfinite(r.score) and r.score < 0 for r in rows)


def test_next_token_probabilities_sum_to_one(spark):
    """Over all known tokens and one unseen token of each bucket."""
    o = hmm.HmmOptions(states=2, passes=1, head=3, buckets=4, dictionary=6)
    learnt = [i for i in range(60) if zlib.crc32(str(i).encode()) % 10]
    rows = [(i, f"w{i % 11} v{i % 4} u{i}") for i in learnt]
    known = sorted({t for _, x in rows for t in x.split()})
    unseen, n = {}, 0
    while len(unseen) < 4:
        unseen.setdefault(hmm.bucket(f"z{n}".encode(), 4), f"z{n}")
        n += 1
    held = [10**6 + i for i in range(3000) if zlib.crc32(str(10**6 + i).encode()) % 10 == 0]
    asked = [(i, w) for i, w in zip(held, ["", *known, *unseen.values()])]
    out = {r.doc_id: r.score for r in hmm.score(table(spark, rows + asked), options=o).collect()}
    # p(w, end) over all first words w and p(end): the first token's distribution times p(end | w) < 1
    ends = [10 ** out[i] for i, _ in asked]
    assert 0 < sum(ends) <= 1 + 1e-9
    vocabulary_total = 0.0
    docs = table(spark, rows).select("doc_id", "text")
    v = hmm.vocabulary(hmm.token_counts(docs), o)
    counts = collections.Counter(t for _, x in rows for t in hmm.tokens(x.encode()))
    first = hmm.first_model(v.share(), o)
    p = first.start @ first.emit.T
    head = set(v.known[:v.head])
    for i, t in enumerate(v.known[:v.head]):
        vocabulary_total += p[i]
    for t in counts:
        if t not in head:
            b = hmm.bucket(t, 4)
            vocabulary_total += p[v.head + b] * (counts[t] + 0.1) / (v.in_bucket[b] + 0.1 * (v.kinds[b] + 1))
    vocabulary_total += sum(p[v.head + b] * 0.1 / (v.in_bucket[b] + 0.1 * (v.kinds[b] + 1)) for b in range(4))
    assert abs(vocabulary_total - 1) < 1e-9


def test_scores_empty(spark):
    assert hmm.score(spark.createDataFrame([], SCHEMA)).count() == 0


# --- fingerprints ---

def shingles(text):
    w = words_of(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.mark.parametrize("ranges", [None, 1, 2, 7, 300])
def test_fingerprints_and_next(spark, corpus, ranges):
    rows = list({i: t or "" for i, t in corpus if i is not None}.items()) + [(None, "last one")]
    got = {r.doc_id: r for r in fingerprints.with_next(clashing(table(spark, rows), "_range", "fingerprint"), ranges=ranges).collect()}
    order = sorted(rows, key=lambda x: -(2**70) if x[0] is None else x[0], reverse=True)
    assert len(got) == len(rows)
    for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
        changed = fingerprints.edited(t, after)
        cut = len(t) // 3
        assert changed == t[:len(t) - cut] + after[:cut]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(changed.encode()).hexdigest())
        a, b, c = shingles(t), shingles(changed), shingles(after)
        if len(a | b) <= fingerprints.K:
            assert r.near_edited == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
            assert r.distinct_shingles == len(a)
        else:
            assert abs(r.near_edited - len(a & b) / len(a | b)) < 0.25
        assert 0 <= r.near_next <= 1 and (a & c or r.near_next in (0.0, 1.0))


def test_ranges_follow_the_size_of_the_texts(spark, monkeypatch):
    docs = table(spark, [(i, "x" * 1000) for i in range(100)] + [(None, None)])
    assert fingerprints.range_count(docs) == fingerprints.MIN_RANGES
    monkeypatch.setattr(fingerprints, "RANGE_BYTES", 1000)
    assert fingerprints.range_count(docs) == 100
    assert fingerprints.range_count(spark.createDataFrame([], SCHEMA)) == fingerprints.MIN_RANGES


@pytest.mark.parametrize("hot", [None, -(2**63), 2**63 - 1, 50])
def test_one_id_in_most_rows_is_split(spark, hot):
    """Nine rows of ten hold one id: their texts follow each other by hash, over many ranges."""
    rows = [(i if i % 10 == 0 else hot, f"text {i} " + "w " * (i % 7)) for i in range(600)]
    docs = table(spark, rows)
    key = lambda i: -(2**63) if i is None else i
    digests = {r.text: r.d for r in docs.select("text", F.xxhash64("text").alias("d")).collect()}
    order = sorted(rows, key=lambda r: (-key(r[0]), digests[r[1]]))
    want = sorted((str(i), hashlib.sha256(fingerprints.edited(t, after).encode()).hexdigest())
                  for (i, t), (_, after) in zip(order, order[1:] + order[:1]))
    out = fingerprints.with_next(docs, ranges=40)
    assert sorted((str(r.doc_id), r.edited_sha256) for r in out.collect()) == want
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 60  # of 600 rows


def test_repeated_rows_are_each_others_next(spark):
    rows = [(5, "a b c d e f")] * 40 + [(7, "top"), (3, "g h i j k l"), (None, "")] + [(None, "none " * 9)] * 30
    got = fingerprints.with_next(table(spark, rows), ranges=10).collect()
    same = hashlib.sha256(fingerprints.edited("a b c d e f", "a b c d e f").encode()).hexdigest()
    last = hashlib.sha256(fingerprints.edited("a b c d e f", "g h i j k l").encode()).hexdigest()
    assert len(got) == len(rows)
    assert sorted(r.edited_sha256 for r in got if r.doc_id == 5) == sorted([same] * 39 + [last])


def test_one_document_is_its_own_next(spark):
    r = fingerprints.with_next(table(spark, [(4, "a b c d e f g h i")])).collect()
    assert len(r) == 1 and r[0].near_next == 1.0
    assert fingerprints.with_next(spark.createDataFrame([], SCHEMA)).count() == 0


def test_sketches_merge_and_estimate(spark):
    parts = [" ".join(f"w{i}" for i in range(a, a + 900)) for a in (0, 500, 1000)]
    whole = fingerprints.sketches([parts[0].encode()])[0]
    other = fingerprints.sketches([parts[1].encode()])[0]
    true = 396 / (2 * 896 - 396)
    assert abs(fingerprints.resemblance(whole, other) - true) < 0.15
    assert abs(fingerprints.distinct(whole) / 896 - 1) < 0.3
    assert abs(fingerprints.containment(whole, other) - 396 / 896) < 0.2
    assert fingerprints.read(fingerprints.written(whole)).tolist() == whole.tolist()
    prints = fingerprints.fingerprint(table(spark, list(enumerate(parts))))
    got = fingerprints.merged(prints, ["lang"]).first()["hashes"]
    want = fingerprints.sketches([p.encode() for p in parts])
    both = fingerprints.merge(fingerprints.merge(want[0], want[1]), want[2])
    assert [int(h, 16) for h in got] == both.tolist()


# --- chat ---

@given(st.text(alphabet="<|>\\[]/INSTs\n ab", max_size=40), st.text(alphabet="us<|\\\n>", max_size=8))
@settings(max_examples=300, deadline=None)
def test_turns_read_back(text, role):
    turn, low, high = chat.written(role, text)
    assert chat.parsed(turn) == (role, text) and chat.unescape(turn[low:high]) == text
    assert not any(c in turn[low:high] for c in chat.CONTROLS)


LAYOUTS = [
    ({"role": "user", "text": "a"}, "turn", [("user", "a")]),
    ({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": None}], "id": 3}, "messages", [("user", "a"), ("assistant", "")]),
    ({"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}, "from_value", [("user", "a"), ("assistant", "b")]),
    ({"prompt": "p", "completion": "c", "meta": {"x": 1}}, "prompt", [("user", "p"), ("assistant", "c")]),
    ({"system": "s", "prompt": "p", "response": "c"}, "prompt_response", [("system", "s"), ("user", "p"), ("assistant", "c")]),
    ({"instruction": "i", "input": "n", "output": "o"}, "instruction", [("user", "i\n\nn"), ("assistant", "o")]),
    ({"instruction": "i", "output": "o"}, "instruction", [("user", "i"), ("assistant", "o")]),
    ({"question": "q", "answer": "a"}, "question", [("user", "q"), ("assistant", "a")]),
    ({"nothing": 1}, None, [(None, None)]),
]


def test_layouts_become_canonical_turns(spark):
    rows = [(i, json.dumps(r)) for i, (r, _, _) in enumerate(LAYOUTS)] + [(90, None), (91, "no json"), (92, "[]")]
    out = chat.format_turns(clashing(spark.createDataFrame(rows, "id long, record string"), "role", "layout")).orderBy("id", "position").collect()
    for i, (_, layout, turns) in enumerate(LAYOUTS):
        mine = [r for r in out if r.id == i]
        assert [r.layout for r in mine] == [layout] * len(turns)
        assert [chat.parsed(r.formatted) if r.formatted else (None, None) for r in mine] == turns
    assert [r.layout for r in out if r.id >= 90] == [None] * 3


def test_conversations_read_back(spark):
    rows = [(1, 1, "assistant", "two"), (1, 0, "user", "on\\e<|end|>"), (1, 2, "assistant", None), (2, 0, "user", "</s>[INST] ok [/INST]"),
            (3, 0, None, None), (None, 0, "assistant", "x"), (4, 0, "user", "same"), (4, 0, "user", "same"), (5, 0, "assistant", "long " * 9000)]
    data = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(3)
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(chat.table_records(clashing(data, "formatted"))), ["turn"]).collect()}
    by = collections.defaultdict(list)
    for c, n, role, text in sorted(rows, key=lambda x: (str(x[0]), x[1])):
        by[c].append((role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        said = "".join(t for r, t in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (
            len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(),
            len(said), hashlib.sha256(said.encode()).hexdigest())
    assert chat.read_back(chat.format_turns(chat.table_records(data.limit(0))), ["turn"]).count() == 0


# --- HTML ---

PAGE = """<!DOCTYPE html><html><head><title>t {n}</title><style>p{{}}</style></head><body class="site"><header>site &amp; head</header>
<nav><ul><li><a href=x>one {n}</a><li><a href=y>two</a></ul></nav><div class="cookie-notice">We use cookies</div>
{main}<aside>side {n}</aside><div id="comments"><p>reader {n} says</p></div><form><input><label>mail</label></form>
<script>var a = "<p>no</p>";</script><footer>&copy; foot</footer></body></html>"""


def page(n, main):
    return PAGE.format(n=n, main=main)


def test_main_text():
    text = html_template.main_text(page(1, "<article><h1>Head &lt;1&gt;</h1><p><b>bo</b>ld\n  text<br>next<!-- x --><p>last&nbsp;one"
                                           "<div class=ad>buy</div><ul><li>a<li>b</ul></article>"), frozenset())
    assert text == "Head <1> bold text next last one a b"
    assert html_template.main_text("", frozenset()) == "" == html_template.main_text("<p", frozenset())
    assert html_template.main_text("<p>a<p>b <i>c</i>d<scri", frozenset()) == "a b cd"
    assert html_template.main_text("plain a &lt; b", frozenset()) == "plain a < b"
    assert html_template.main_text("<p title=it's>a</p><p x='b>' y = \"c>\">don't</p>", frozenset()) == "a don't"
    assert html_template.main_text("<article class='post comments-open'><p>a</p><article class='comment odd'><p>b</p></article>c</article>",
                                   frozenset()) == "a c"
    assert html_template.main_text("a<a " + 'x="1" ' * 100000, frozenset()) == "a"


def test_template_drops_what_repeats_outside_marked_elements(spark):
    pages = [(n, f"http://h{n % 2}.org/{n}", page(n, f"<div><p>Welcome to this place</p></div><div><p>text of {n}</p><p>more {n * n}</p></div>"
                                                    f"<div><p>All rights kept</p></div>")) for n in range(12)]
    pages += [(50, "https://lone.org/x", page(50, "<main><p>alone</p></main>")), (51, None, None), (52, "", ""), (None, "http://h1.org/q", "<p>odd")]
    data = clashing(spark.createDataFrame(pages, "page_id long, url string, html string"), "text", "template")
    want = {n: f"text of {n} more {n * n}" for n in range(12)} | {50: "alone", 51: "", 52: "", None: "odd"}
    assert {r.page_id: r.text for r in html_template.extract(data).collect()} == want
    small = html_template.BROADCAST
    try:
        html_template.BROADCAST = -1  # the other join
        assert {r.page_id: r.text for r in html_template.extract(data).collect()} == want
    finally:
        html_template.BROADCAST = small
    assert html_template.extract(data.limit(0)).count() == 0


def test_copies_of_a_page_keep_their_text(spark):
    pages = [(n, "http://h.org/a", page(7, "<div><p>copied text</p><p>second</p></div>")) for n in range(4)]
    pages += [(10 + n, f"http://h.org/{n}", page(n, f"<div><p>own {n}</p><p>words {n * 7}</p></div>")) for n in range(9)]
    out = {r.page_id: r.text for r in html_template.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(out[n] == "copied text second" for n in range(4)) and out[12] == "own 2 words 14"


def test_raw_elements_end_where_they_should():
    plain = lambda h: html_template.main_text(h, frozenset())
    assert plain("<article><p>one <svg/> two</p><svg class='i' /><p>three</p></article>") == "one two three"
    assert plain("<p>a<svg x='1/2'><path d='m'/>no</svg>b") == "a b" and plain("<p>a<svg title='>'>no</svg> b") == "a b"
    assert plain("<title-card><p>a</p></title-card><script-y>b</script-y><template-x>c</template-x><p>d<script>no</script>") == "a b c d"


def test_names_are_whole_and_do_not_drop_main_text():
    plain = lambda h: html_template.main_text(h, frozenset())
    assert plain("<div class='layout has-sidebar'><article><p>a</p></article></div>") == "a"
    assert plain("<div class='sidebar'><article><p>a</p></article></div>") == "a" == plain("<form id=f><main>a</main></form>")
    assert plain("<article><header><h1>t</h1></header><div class='post-header'><h2 id='side-effects'>h</h2></div><section id='related-work'>r"
                 "</section><section id='discussion'>d</section><h2 id='comments'>c</h2></article>") == "t h r d c"
    assert plain("<article><p>long text</p></article><div class='sidebar'><article>short</article></div><div class='ad-box'>x</div>") == "long text"


def test_a_named_section_goes_if_its_text_recurs(spark):
    pages = [(n, f"http://h.org/{n}", f"<body><article><p>text {n * n}</p><section id='discussion'><p>talk {n}</p></section>"
              f"<section id='related'><p>see {n // 3}</p></section></article></body>") for n in range(12)]
    out = {r.page_id: r.text for r in html_template.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert out == {n: f"text {n * n} talk {n}" for n in range(12)}


def extracted(spark, bodies):
    pages = [(n, f"http://{host}/{n}", f"<html><body>{body}</body></html>") for n, (host, body) in enumerate(bodies)]
    rows = html_template.extract(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)).collect()
    return [r.text for r in sorted(rows, key=lambda r: r.page_id)]


def test_copies_in_the_majority_keep_their_text(spark):
    bodies = [("a.org", "<div><p>copied text</p><p>second</p></div>")] * 6 + [("a.org", "<div><p>other</p></div>")]
    near = [("b.org", f"<script>{n}</script><nav>{n}</nav><div><p>copied text</p></div>") for n in range(6)]
    edited = [("c.org", "<article>" + "".join(f"<p>long passage {k} of it</p>" for k in range(8) if k != n) + "</article>") for n in range(6)]
    out = extracted(spark, bodies + near + edited)
    assert out[:7] == ["copied text second"] * 6 + ["other"] and out[7:13] == ["copied text"] * 6
    assert out[13:] == [" ".join(f"long passage {k} of it" for k in range(8) if k != n) for n in range(6)]


def test_the_template_decides_inside_main_elements(spark):
    own = lambda n: f"own words of page {n}, {n * n} and more of them to read"
    bodies = [("a.org", f"<article><p>{own(n)}</p><div class='x'>buy number {n % 2}</div><p class='y'>Follow this place</p><p>Said on two hosts</p></article>")
              for n in range(12)] + [("b.org", "<article><p>Said on two hosts</p></article>")]
    assert extracted(spark, bodies) == [f"{own(n)} Said on two hosts" for n in range(12)] + ["Said on two hosts"]


def test_inside_or_outside_by_the_text_that_varies(spark):
    words = lambda n, k: " ".join(f"w{n * 100 + i}" for i in range(k))
    teaser = lambda n: f"<article class='card'>More {n}..</article>"
    bodies = [("a.org", f"<div class='content'><p>{words(n, 40)}</p></div>{teaser(n)}<article></article>") for n in range(6)]
    bodies += [("b.org", f"<article><p>{words(n, 5 if n == 3 else 60)}</p></article><div class='x'>{words(n + 50, 9)}</div>") for n in range(6)]
    bodies += [("lone.org", f"<div>{words(1, 40)}</div>{teaser(1)}")]
    assert extracted(spark, bodies) == [words(n, 40) for n in range(6)] + [words(n, 5 if n == 3 else 60) for n in range(6)] + [words(1, 40)]


# --- quality rules ---

def test_deep_and_hostile_pages_take_linear_time():
    import time
    plain = lambda h: html_template.main_text(h, frozenset())
    began = time.time()
    assert plain("<body>" + '<div class="aa bb">' * 20000 + "deep" + "</div>" * 20000) == "deep"
    assert plain("<p><table>" + "<div>" * 40000 + "x" + "</i></section>" * 20000) == "x"
    assert plain("<ul>" + "<li><p>" * 20000 + "x") == "x"
    html_template.page_tokens(html_template.Page('<div class="aa bb">' * 20000))
    assert time.time() - began < 5


def test_implied_ends_of_elements():
    paths = lambda h: [(p.names[e], p.names[p.parents[e]] if p.parents[e] >= 0 else "") for p in [html_template.Page(h)] for e in range(len(p.names))]
    assert paths("<p>a<div>b") == [("p", ""), ("div", "")]
    assert paths("<p><b>a<p>b") == [("p", ""), ("b", "p"), ("p", "")]
    assert paths("<p><span><div>b") == [("p", ""), ("span", "p"), ("div", "")]
    assert paths("<p><table><tr><td><p>a<td>b<tr><td>c") == [("p", ""), ("table", ""), ("tr", "table"), ("td", "tr"), ("p", "td"), ("td", "tr"), ("tr", "table"), ("td", "tr")]
    assert paths("<ul><li>a<ul><li>b</ul><li>c") == [("ul", ""), ("li", "ul"), ("ul", "li"), ("li", "ul"), ("li", "ul")]
    assert paths("<div><p>a</div><p>b</section><i>c") == [("div", ""), ("p", "div"), ("p", ""), ("i", "p")]


def test_reader_comments_and_adverts_inside_main_text_go(spark):
    plain = lambda h: html_template.main_text(h, frozenset())
    for name in ("user-comments", "comment-list", "google-ads", "article-ad", "share-buttons", "related-posts", "site-notice"):
        for mark in ("class", "id"):
            assert plain(f'<main><article><p>Body.</p></article><section {mark}="{name}"><p>x</p></section></main>') == "Body.", name
            assert plain(f'<article><p>Body.</p><div {mark}="wide {name}">x</div></article>') == "Body.", name
    for name in ("comments-open", "no-comments", "related-work", "side-effects", "post-header", "comment-on-law"):
        assert plain(f'<article><p>Body.</p><div class="{name}">x</div></article>') == "Body. x", name
    bodies = [("h", f'<main><article><p>Text {n} of {n * 7}.</p></article><section class="comment-list"><p>Reader {n}: {n * 13} is long, long.</p></section></main>')
              for n in range(20)]
    pages = [(n, f"http://{host}/{n}", f"<html><body>{body}</body></html>") for n, (host, body) in enumerate(bodies)]
    rows = html_template.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in rows} == {n: f"Text {n} of {n * 7}." for n in range(20)}


def test_a_form_or_name_around_the_whole_text_does_not_drop_it(spark):
    plain = lambda h: html_template.main_text(h, frozenset())
    assert plain("<body><p>Long body text.</p><form>name <input></form></body>") == "Long body text."
    assert plain('<body><div class="news-comment"><p>Long body.</p></div></body>') == "Long body."
    assert plain('<body><article>Short.</article><div class="user-comments">Many long comments of readers.</div></body>') == "Short."
    pages = [(n, f"http://h/{n}", f'<html><head><title>t</title></head><body><form id="aspnetForm"><div><p>Text {n * 31} here.</p><input></div></form></body></html>')
             for n in range(20)]
    rows = html_template.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in rows} == {n: f"Text {n * 31} here." for n in range(20)}


def test_quality_base_columns(spark, corpus):
    rules = quality.QualityRules()
    docs = clashing(table(spark, corpus), "kept", "n_words")
    got = quality.judge(docs, rules)
    assert got.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"] and got.count() == len(corpus)
    for r in got.collect():
        text = r.text or ""
        w = words_of(text)
        lines = [x for x in text.split("\n") if words_of(x)]
        seen = collections.Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
        covered = set(p for i in range(len(w) - 4) if seen[tuple(w[i:i + 5])] > 1 for p in range(i, i + 5))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w)) and not (r.base_failed and r.kept)


def test_jensen_shannon(spark):
    rows = [([3, 1, 0], [3, 1, 0]), ([5, 0, 0], [0, 2, 2]), ([1, 2, 3], [4, 1, 1]), ([0, 0, 0], [1, 1, 1])]
    out = spark.createDataFrame(rows, "p array<long>, q array<long>").select(quality.jensen_shannon(F.col("p"), F.col("q")).alias("d"), "p", "q")

    def distance(p, q):
        if not sum(p) or not sum(q):
            return None
        p, q = np.array(p) / sum(p), np.array(q) / sum(q)
        kl = lambda a, b: sum(x * np.log2(x / y) for x, y in zip(a, b) if x)
        return np.sqrt((kl(p, (p + q) / 2) + kl(q, (p + q) / 2)) / 2)

    for r in out.collect():
        want = distance(r.p, r.q)
        assert r.d is None if want is None else abs(r.d - want) < 1e-9


def test_quality_verdicts_and_empty(spark):
    r = np.random.default_rng(0)
    common = quality.COMMON_WORDS["en"]
    clean = lambda n: " ".join((common[r.integers(18)] if r.random() < 0.45 else "w" + "aeiou"[r.integers(5)] * 3) for _ in range(n)) + "."
    rows = [(i, clean(200)) for i in range(40)] + [(50, clean(300).upper()), (51, " ".join(f"x{i}%%%" for i in range(300))), (52, clean(30))]
    kept = {x.doc_id: x.kept for x in quality.judge(table(spark, rows)).collect()}
    assert all(kept[i] for i in range(40)) and not kept[50] and not kept[51] and kept[52]
    assert quality.judge(spark.createDataFrame([], SCHEMA)).count() == 0
    none = table(spark, rows).withColumn("lang", F.lit(None).cast("string"))
    assert quality.judge(none).where("kept").count() >= 40 and quality.judge(none.drop("lang")).count() == len(rows)


def test_each_language_has_its_own_reference(spark, monkeypatch):
    r = np.random.default_rng(1)
    text = lambda letters: " ".join("".join(r.choice(list(letters), 5)) for _ in range(150)) + "."
    rows = [(i, text("abcdefghilmno"), "it") for i in range(30)] + [(100 + i, text("абвгдежзиклмн"), "ru") for i in range(3)]
    rows += [(200 + i, text("的一是不了人我在有他"), None) for i in range(2)] + [(300, text("абвгд").upper(), "it"), (400, text("abc"), "und")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for limit in (quality.BROADCAST, 0):  # 0: the other join
        monkeypatch.setattr(quality, "BROADCAST", limit)
        kept = {x.doc_id: x.kept for x in quality.judge(docs).collect()}
        assert len(kept) == len(rows) and {i for i, k in kept.items() if not k} == {300}
