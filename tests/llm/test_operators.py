"""Operators against plain Python, the libraries, and held-out labels."""

import hashlib
import io
import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from dimtrail.llm import components, decontaminate, fingerprints, html_text, language_model, line_templates, media, pieces, quality, queries, simhash, token_counts, unit_dedup
from dimtrail.llm.queries import tokenizer


@pytest.fixture(scope="module")
def docs(spark, tiny):
    return spark.read.parquet(f"{tiny}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


# --- token counts


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["the", " and", "'s", "'re", "'r", " 'll", "\n", "  ", "\t", "12", "é", "ß", "<|endoftext|>", "<|endof", "!!!", "a", "I", "日本", " ", "\x1c", "🙂", "\xa0", "\x85"]), max_size=10))
def test_every_prefix_counts_as_the_library_does(parts):
    from tokenizers import Tokenizer

    text, path = "".join(parts), tokenizer("byte_bpe")
    library = test_every_prefix_counts_as_the_library_does.__dict__.setdefault("library", Tokenizer.from_file(path))
    got = [0, *np.cumsum(np.frombuffer(token_counts.counter(path).steps(text), np.int8)).tolist()]
    assert got == [len(library.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]


def test_token_query_and_budgets(spark, tiny, rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer("byte_bpe"))
    for r in queries.op3_token_counts(spark, tiny).collect():
        n = len(library.encode(rows[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(rows[r.doc_id].encode()), n > 512)
    df = token_counts.with_prefix_counts(spark.createDataFrame([(1, "The quick brown fox jumps")], "doc_id int, text string"), tokenizer("byte_bpe"))
    fits = df.select(token_counts.characters_within(3).alias("c"), token_counts.tokens_at(9).alias("t")).first()
    assert fits.c == len("The quick brown") and fits.t == 2


# --- HTML


def plain_article(page):
    """The text of the page's <article>, by regular expressions."""
    from html import unescape

    article = re.search(r"<article>(.*?)(?:</article>|$)", page, re.S)[1]
    parts = (re.sub(r"\s+", " ", unescape(p)).strip() for p in re.split(r"</?(?:p|br|h1)>", re.sub(r"</?[bi]>", "", article)))
    return " ".join(p for p in parts if p)


@pytest.fixture(scope="module")
def pages(spark, tiny):
    return {r.page_id: r.html for r in spark.read.parquet(f"{tiny}/pages.parquet").collect()}


def test_html_query_matches_articles(spark, tiny, pages):
    for r in queries.op2_html_text(spark, tiny).collect():
        assert r.text == plain_article(pages[r.page_id]) and r.n_chars == len(r.text)


def test_html_by_density(pages, monkeypatch):
    """Without <article>, and without any name at all, density finds the same texts; without density nothing does."""
    unnamed = {i: re.sub(r"(</?)(?:nav|footer|article|div)\b[^>]*", r"\1div", p) for i, p in pages.items()}
    right = lambda p: [html_text.main_text(p[i]) == plain_article(pages[i]) for i in pages]
    assert all(right({i: re.sub("article>", "div>", p) for i, p in pages.items()}))
    assert sum(right(unnamed)) >= 0.9 * len(pages)  # on the others two short texts weigh no more than an advert and a footer
    measure = html_text.measure
    monkeypatch.setattr(html_text, "measure", lambda nodes: (measure(nodes), [setattr(n, "density", 0.0) for n in nodes]))
    assert not any(right(unnamed))


def test_html_stray_end_tags_take_no_time():
    import time

    begun = time.perf_counter()
    assert html_text.main_text("<div>" * 20000 + "</section></p>" * 20000 + "<b>" * 5000 + "<hr>" * 5000 + "deep") == "deep"
    assert time.perf_counter() - begun < 20


def test_html_layouts():
    page = "<body><header><a href=x>Home</a></header><div id='cookie-notice'>We use cookies</div><div><div class=sidebar><ul><li><a href=1>a</a><li><a>b</a></ul></div><div class='post-content'><h2>Title</h2><p>First &amp; long paragraph with many more words in it.</p><p>Second <i>para</i>graph is <a href=q>linked</a> too.</p><div class=advert>Buy</div><p>Third</div><section class=comments><p>nice post, says a reader at great length, longer than all of the text above it put together</p></section></div><footer>c</footer>"
    assert html_text.main_text(page) == "Title First & long paragraph with many more words in it. Second paragraph is linked too. Third"
    assert html_text.main_text("plain") == "plain"
    assert html_text.main_text("<script>x()</script>") == ""
    assert html_text.main_text("<div>" * 5000 + "deep") == "deep"


def test_html_without_article_keeps_every_section():
    words = lambda k: (f"word{k} of the text, " * 40)[:500].strip()
    sections = [[words(10 * i + j) for j in range(5)] for i in range(3)]
    body = "".join(f"<h2>Part {i}</h2><section>" + "".join(f"<p>{p}</p>" for p in ps) + "</section>" for i, ps in enumerate(sections))
    page = "<body><div>" + "".join(f"<a href={i}>link {i}</a>" for i in range(30)) + f"</div><div>{body}</div><div><a href=x>more</a> <a href=y>other</a></div></body>"
    want = " ".join(" ".join([*([f"Part {i}"] if i else []), *ps]) for i, ps in enumerate(sections))
    got = html_text.main_text(page)
    assert got in (want, "Part 0 " + want)
    assert html_text.main_text(f"<body><main>{body}</main></body>").count("word") == got.count("word")


PROSE = " ".join(f"Sentence number {i} says something about the matter at hand." for i in range(8))


def article(more):
    return f"<body><nav><a href=1>Home</a><a href=2>News</a></nav><div class=ad>Buy now this fine thing</div><article><h1>Title</h1><p>{PROSE}</p>{more}</article><footer>copyright 2024 by nobody</footer></body>"


@pytest.mark.parametrize("name", ["related-work", "search", "share-prices", "form-of-government", "header-files", "social-history", "notice", "comments-on-method"])
def test_html_keeps_named_sections(name):
    """An id names a place of the text, inside an article or main, and drops nothing that has a heading or is dense."""
    section = f'<section id="{name}"><h2>Part</h2><p>{PROSE} Special.</p></section>'
    assert html_text.main_text(article(section)) == f"Title {PROSE} Part {PROSE} Special."
    assert html_text.main_text(f"<body><nav><a href=1>Home</a></nav><main><h1>Title</h1><p>{PROSE}</p>{section}</main></body>").endswith("Special.")
    assert html_text.main_text(article(f'<h2 id="{name}">Part</h2><p id="{name}">Words.</p>')) == f"Title {PROSE} Part Words."


def test_html_keeps_short_ends_lists_and_labels():
    most = "".join(f"<p>{PROSE}</p>" for _ in range(6))
    for page in (f"<body><article><div>{most}</div><div><p>Closing remark.</p></div></article></body>", f"<body><nav><a href=1>Home</a></nav><div><div>{most}</div><div><p>Closing remark.</p></div></div></body>"):
        assert html_text.main_text(page) == " ".join([PROSE] * 6) + " Closing remark."
    links = "".join(f"<li><a href={k}>{w} reference</a></li>" for k, w in enumerate("one two three".split()))
    assert html_text.main_text(article(f"<ul>{links}</ul>")) == f"Title {PROSE} one reference two reference three reference"
    assert html_text.main_text(article("<p>Press the <label>red</label> knob.</p>")).endswith("Press the red knob.")


@pytest.mark.parametrize("page", [
    article('<section class="comments"><p>nice post</p></section>'),
    article(f'<div id="comments"><p>nice {PROSE}</p></div>'),
    article(f'<section id="comments"><h2>Comments</h2><p>nice {PROSE}</p></section>'),
    article(f'<article class="comment"><p>nice {PROSE}</p></article>'),
    article("").replace("</article>", f'</article><div id="comments"><h2>Comments</h2><p>nice {PROSE}</p></div>'),
    article("").replace("</article>", '</article><section id="comments"><h2>Comments</h2><p>nice post</p></section>'),
    article('<div id="share-buttons"><a href=1>nice</a></div>'),
    article("<form><label>nice</label></form>"),
])
def test_html_leaves_comments_and_furniture_out(page):
    assert html_text.main_text(page) == f"Title {PROSE}"


def test_html_densities_by_a_plain_program(pages):
    """Characters, tags, links, densities and their sums of every node, by recursion over the tree."""

    def counts(node):
        own = [x for x in node.parts if isinstance(x, str)]
        chars = sum(len(re.sub(r"\s+", " ", x).strip()) for x in own)
        link = 0
        up = node
        while up is not None:
            link = link or (up.tag == "a")
            up = up.parent
        out = [chars, 0, chars if link else 0, 0]
        for child in node.parts:
            if not isinstance(child, str) and not child.out:
                c, t, lc, lt = counts(child)
                out = [out[0] + c, out[1] + t + 1, out[2] + lc, out[3] + lt + (child.tag == "a")]
        return out

    def density(node, body):
        c, t, lc, lt = counts(node)
        if c == 0 or node.out:
            return 0.0
        t, lc, lt = max(t, 1), max(lc, 1), max(lt, 1)
        real_lc = counts(node)[2]
        base = math.log(c / max(c - real_lc, 1) * real_lc + body[2] / max(body[0], 1) * c + math.e)
        value = c / t * math.log(max(c / lc * t / lt, 1.0))
        return value / math.log(max(base, 1 + 1e-9)) if base > 1 else value

    for page in list(pages.values())[:12]:
        nodes = html_text.parse(page)
        html_text.measure(nodes)
        body = counts(nodes[0])
        for node in nodes:
            assert node.density == pytest.approx(density(node, body)), node.tag
            assert [node.chars, node.tags, node.link_chars, node.link_tags] == counts(node) or node.out


# --- unit dedup


def plain_sentences(line):
    """(start, end) of the sentences: up to and with a run of .!? and the blanks after it."""
    out, start, i = [], 0, 0
    while i < len(line):
        while i < len(line) and line[i] not in ".!?":
            i += 1
        while i < len(line) and line[i] in ".!?":
            i += 1
        while i < len(line) and line[i].isspace():
            i += 1
        if line[start:i].strip():
            out.append((start, i))
        start = i
    return out


def plain_dedup(rows):
    """{id: (text, spans, n_removed)} for (id, text) rows with distinct ids: by comparing the units' words, one character of the text at a time."""
    seen, out = {}, {}
    for doc_id, text in sorted(rows):
        gone, removed, at = [False] * len(text), [], 0
        for line in text.split("\n"):
            words = tuple(line.lower().split())
            end = at + len(line) + 1
            line_goes = bool(words) and words in seen
            if words:
                seen.setdefault(words, doc_id)
            if line_goes:
                removed.append((at, end))
            parts = [(x, y, tuple(line[x:y].lower().split())) for x, y in plain_sentences(line)]
            if len(words) >= 8 and len(parts) > 1:
                for i, (x, y, own) in enumerate(parts):
                    keys = [own] if len(own) >= 8 else []
                    if not keys:
                        for side in (-1, 1):
                            run, k = [own], i
                            while sum(map(len, run)) < 8 and 0 <= k + side < len(parts):
                                k += side
                                run = [parts[k][2], *run] if side < 0 else [*run, parts[k][2]]
                            if sum(map(len, run)) >= 8:
                                keys.append((side, sum(run, ())))
                    if any(k in seen for k in keys) and not line_goes:
                        removed.append((at + x, at + y))
                    for k in keys:
                        seen.setdefault(k, doc_id)
            at = end
        for x, y in removed:
            gone[x:y] = [True] * (min(y, len(text)) - x)
        out[doc_id] = ("".join(c for c, g in zip(text, gone, strict=True) if not g), len(removed))
    return out


def test_units_against_plain_python(spark, docs, rows):
    want = plain_dedup(rows.items())
    got = unit_dedup.with_units_removed(docs).collect()
    assert any(n for _, n in want.values())
    for r in got:
        assert (r.text, r.n_removed) == want[r.doc_id]
        assert "".join(rows[r.doc_id][a:b] for a, b in zip([0, *[s.end for s in r.removed]], [*[s.start for s in r.removed], len(rows[r.doc_id])], strict=True)) == r.text


def test_units_of_repeated_rows_and_ids(spark):
    line = "One line of the text. Another sentence of it has a few more words in it."
    rows = [(0, line), (1, "x\n" + line), (1, "x\n" + line), (1, "x\n" + line), (2, "y y\ny y"), (3, "z z"), (3, "z z\nw"), (None, "v v"), (4, "V  v"), (None, None), (5, "")]
    out = unit_dedup.with_units_removed(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(out) == len(rows)
    got = {(r.doc_id, r.text, r.n_removed, tuple(tuple(s) for s in r.removed)) for r in out}
    second = {x for x in got if x[0] == 3}
    assert got - second == {(0, line, 0, ()), (1, "x\n", 1, ((2, 2 + len(line), 0),)), (2, "y y\n", 1, ((4, 7, 2),)), (None, "v v", 0, ()), (4, "", 1, ((0, 4, None),)), (None, None, 0, ()), (5, "", 0, ())}
    assert sorted(n for _, _, n, _ in second) == [0, 1]  # z z stays in one of the two


def test_short_units(spark):
    passage = "The first sentence of the passage has quite enough words. So it goes. Another one of them follows here with many more words. It ends."
    rows = [(1, f"Opening words of one document. {passage}\nAll rights reserved.\nSo it goes."), (2, f"Quite another opening. {passage} Not so there.\nAll rights  reserved."), (3, "A third text stands alone with words of its own. So it goes. Nothing else of it has been seen before.\n\nALL RIGHTS RESERVED.")]
    out = {r.doc_id: r for r in unit_dedup.with_units_removed(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert out[1].text == rows[0][1] and out[1].n_removed == 0
    assert out[2].text == "Quite another opening. Not so there.\n" and out[2].n_removed == 5
    assert out[3].text == rows[2][1][: rows[2][1].index("ALL")] and out[3].n_removed == 1


# --- decontamination


def plain_verdict(text, items):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate({c: c + 32 for c in range(65, 91)}))
    hit, found = set(), set()
    for item, other in items:
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", other.translate({c: c + 32 for c in range(65, 91)}))
        if not own:
            continue
        n = min(13, len(own))
        windows = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)}
        for i in range(len(words) - n + 1):
            if tuple(words[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                found.add(str(item))
    ids = sorted(found)
    return len(words), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words)


@pytest.mark.parametrize("limit", [1 << 18, 900])
def test_contamination_against_plain_python(spark, tiny, docs, rows, limit):
    bench = spark.read.parquet(f"{tiny}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    out = decontaminate.with_contamination(docs.select("doc_id", "text"), bench, limit=limit).collect()
    assert any(r.contaminated for r in out)
    for r in out:
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == plain_verdict(rows[r.doc_id], items)
        assert all(r.text[s.start : s.end].strip() == r.text[s.start : s.end] for s in r.spans)


# --- line templates


def test_templates_drop_boilerplate_and_leave_copies(spark):
    rng = random.Random(3)
    prose = lambda n: " ".join("".join(rng.choice("aeioubdkmr") for _ in range(6)) for _ in range(n))
    rows = []
    for i in range(12):
        lines = [prose(rng.randint(20, 40)), f"Posted on 2024-0{i % 9 + 1}-11 by user {i} in news today", prose(rng.randint(20, 40)), "All rights reserved."]
        rows.append((i, "\n".join(lines)))
    copy = "\n".join(prose(25 + k) for k in range(5))
    rows += [(100 + i, copy + "x" * i) for i in range(8)]
    out = {r.doc_id: r for r in line_templates.with_line_drops(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for i in range(12):
        assert out[i].dropped_lines == [1, 3] and out[i].n_lines == 4
        assert out[i].text.split("\n") == [rows[i][1].split("\n")[k] for k in (0, 2)]
    assert all(out[100 + i].dropped_lines == [] for i in range(8))


def test_templates_beside_many_copies_and_other_boilerplate(spark):
    rng = random.Random(4)
    prose = lambda n: " ".join("".join(rng.choice("aeioubdkmr") for _ in range(6)) for _ in range(n))
    licence, notice = "Released under the licence of this place.", "This notice is longer than all other lines " + prose(60)
    rows = [(i, "\n".join([prose(rng.randint(20, 40)), prose(rng.randint(20, 40)), licence])) for i in range(60)]
    core = [prose(20 + 3 * k) for k in range(6)]
    for i in range(1000):  # near copies: one word of the longest line differs; in every tenth another line is a new one
        lines = [*core[:5], core[5] + str(i), licence]
        if i % 10 == 0:
            lines[i // 10 % 6] = prose(rng.randint(20, 40))
        rows.append((100 + i, "\n".join(lines)))
    rows += [(2000 + i, "\n".join([prose(rng.randint(20, 40)), notice, "Short line beside it."])) for i in range(12)]
    rows += [(3000 + i, f"Page {i} stands all by itself") for i in range(5)]
    out = {r.doc_id: r.dropped_lines for r in line_templates.with_line_drops(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()}
    assert all(out[i] == [2] for i in range(60))
    assert all(out[100 + i] == [6] for i in range(1000))
    assert all(out[2000 + i] == [1, 2] for i in range(12))
    assert all(out[3000 + i] == [] for i in range(5))


def plain_drops(texts, min_docs=3, constant=0.7):
    """{text: numbers of its dropped lines}, by the rules for templates and companies over all lines of all texts."""
    digit = lambda t: any(c.isdigit() for c in t)
    leaf = lambda t: (len(t), *("<*>" if digit(x) else x for x in t[:3]))
    texts = set(texts)
    lines = {t: [tuple(x.split()) for x in t.split("\n")] for t in texts}
    held = {t: Counter() for t in texts}
    with_line, in_leaf = {}, {}
    for t in texts:
        for line in lines[t]:
            if line:
                held[t][leaf(line)] += len(line)
                with_line.setdefault(line, set()).add(t)
                in_leaf.setdefault(leaf(line), set()).add(t)
    often = {k for k, v in in_leaf.items() if len(v) >= min_docs}
    cells = Counter()
    for line, v in with_line.items():
        cells.update({(leaf(line), i, x): len(v) for i, x in enumerate(line) if not digit(x)})
    shape = {}
    for line in with_line:
        kept = [cells[leaf(line), i, x] >= min_docs for i, x in enumerate(line)]
        if leaf(line) in often and sum(kept) >= constant * len(line):
            shape[line] = (leaf(line), tuple(x if k else "<*>" for x, k in zip(line, kept, strict=True)))
    seen = {}
    for line, key in shape.items():
        seen.setdefault(key, set()).update(with_line[line])
    total = {t: sum(map(len, lines[t])) for t in texts}
    common = {t: sum(n for k, n in held[t].items() if k in often) for t in texts}
    alone = lambda t, k, common, total: 2 * (common[t] - held[t][k]) < total[t] - held[t][k]
    first = {key for key, v in seen.items() if sum(alone(t, key[0], common, total) for t in v) >= min_docs}
    known = {key[0] for key in first}
    left = {t: {k: n for k, n in held[t].items() if k in often and k not in known} for t in texts}
    total = {t: total[t] - sum(held[t][k] for k in known) for t in texts}
    common = {t: sum(left[t].values()) for t in texts}
    number = lambda k: language_hash(k)
    longest = {t: sorted(left[t], key=lambda k: (left[t][k], number(k)), reverse=True)[:2] for t in texts}
    heads = Counter(k for t in texts for k in longest[t])
    heads = {k for k, n in heads.items() if 2 * n >= len(in_leaf[k])}
    second = set()
    for key, v in seen.items():
        if key not in first:
            company = set()
            for t in v:
                if alone(t, key[0], common, total):
                    company.add(t)
                else:
                    head = next((k for k in longest[t] if k != key[0]), None)
                    if head in heads:
                        company.add(head)
            if len(company) >= min_docs:
                second.add(key)
    return {t: [i for i, line in enumerate(lines[t]) if shape.get(line) in first | second] for t in texts}


def language_hash(leaf):
    """The leaf's number, which settles ties between equally long lines."""
    return xxhash.xxh64_intdigest(f"{leaf[0]}\x00" + "\x00".join(leaf[1:])) - (1 << 63)


def test_digits_of_all_scripts_are_variable(spark):
    """A token with a digit of any script is no constant, neither for a leaf nor at its place in it."""
    rows = [(i, f"Seite {d} von vielen Seiten\n" + " ".join(chr(97 + i) * n for n in range(1, 12))) for i, d in enumerate("\u0661\u0662\u06633")]
    out = line_templates.with_line_drops(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert [r.dropped_lines for r in out] == [[0]] * 4 and [r.repeated_lines for r in out] == [[0]] * 4


def test_templates_against_plain_python(spark, docs, rows):
    rng = random.Random(9)
    prose = lambda n: " ".join("".join(rng.choice("aeioubdkmr") for _ in range(6)) for _ in range(n))
    made = []
    core = [prose(9 + k) for k in range(5)]
    for i in range(60):
        lines = [prose(rng.randint(4, 15)) for _ in range(rng.randint(0, 4))] + rng.sample(core, rng.randint(0, 5))
        lines += rng.sample(["All rights reserved.", "Menu", "", f"Posted on 2024-0{i % 9 + 1}-11 by user {i}", f"Page {i % 4} of the news", "to."], rng.randint(0, 4))
        rng.shuffle(lines)
        made.append((1000 + i, "\n".join(lines)))
    both = [*rows.items(), *made]
    want = plain_drops([t for _, t in both])
    out = line_templates.with_line_drops(spark.createDataFrame(both, "doc_id bigint, text string")).collect()
    texts = dict(both)
    assert sum(map(len, want.values())) > 20
    for r in out:
        assert r.dropped_lines == want[texts[r.doc_id]], r.doc_id
        assert r.text == "\n".join(x for i, x in enumerate(texts[r.doc_id].split("\n")) if i not in r.dropped_lines)
    copies = spark.createDataFrame([(i, "\n".join(core) + "x" * i) for i in range(5)], "doc_id bigint, text string")
    assert all(r.dropped_lines == [] and r.repeated_lines == list(range(5)) for r in line_templates.with_line_drops(copies).collect())
    # the last line differs in its last token alone, which becomes <*>: it is of one template too
    assert all(r.dropped_lines == list(range(5)) for r in line_templates.with_line_drops(copies, companies=False).collect())


# --- SimHash


def plain_components(values, distance):
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= distance:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(values))]


def test_simhash_against_plain_python(spark, tiny, rows):
    ids = sorted(rows)
    values = [fingerprints.simhash(rows[i]) for i in ids]
    want = dict(zip(ids, (ids[c] for c in plain_components(values, 4)), strict=True))
    for r in queries.op7_simhash(spark, tiny).collect():
        assert r.component_id == want[r.doc_id] and int(r.fingerprint, 16) == values[ids.index(r.doc_id)]


def test_simhash_of_a_dense_group(spark):
    rng = random.Random(5)
    center = rng.getrandbits(64)
    values = {center ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(300)} | {rng.getrandbits(64) for _ in range(100)}
    values = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    got = {r.node: r.component for r in simhash.fingerprint_components(spark.createDataFrame([(v,) for v in values], "fp long")).collect()}
    want = plain_components([v & (1 << 64) - 1 for v in values], 4)
    groups = Counter(want)
    assert {frozenset(v for v, c in got.items() if c == k) for k in set(got.values())} >= {frozenset(values[i] for i, c in enumerate(want) if c == k) for k, n in groups.items() if n > 1}


def test_heavy_labels_in_one_bucket(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HEAVY", 3)
    rng = random.Random(6)
    values = set()
    for _ in range(6):  # groups that share buckets, some of them linked with each other
        center = rng.getrandbits(10)
        values |= {center ^ sum(1 << b for b in rng.sample(range(12, 64), rng.randint(0, 3))) for _ in range(40)}
    values = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    got = {r.node: r.component for r in simhash.fingerprint_components(spark.createDataFrame([(v,) for v in values], "fp long")).collect()}
    want = plain_components([v & (1 << 64) - 1 for v in values], 4)
    groups = Counter(want)
    assert {frozenset(v for v, c in got.items() if c == k) for k in set(got.values())} == {frozenset(values[i] for i, c in enumerate(want) if c == k) for k, n in groups.items() if n > 1}


def plain_fingerprint(text):
    words = [w for w in re.split(rb"[\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())) if w]
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_against_plain_python(rows):
    texts = [*list(rows.values())[:40], "", "A", "b c", "one two Three four", "x\u00a0y Ä z w v", "a a a a a a a a"]
    for t in texts:
        assert fingerprints.simhash(t) == plain_fingerprint(t)


def test_keep_one_judges_rows_by_their_text(spark):
    rng = random.Random(8)
    t = [" ".join(str(rng.random()) for _ in range(60)) for _ in range(9)]
    rows = [(0, t[0]), (1, t[1]), (1, t[0])]  # t[1] stands nowhere else
    rows += [(5, t[2]), (5, t[3])]  # unlike texts under one id
    rows += [(16, t[4]), (16, t[4]), (13, t[4]), (13, t[4]), (17, t[5])]  # repeated rows
    rows += [(None, t[6]), (None, t[6]), (None, t[7]), (22, t[7])]  # nulls come last
    rows += [(31, t[8] + " end"), (30, t[8])]  # near copies
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    want = [(0, t[0]), (1, t[1]), (5, t[2]), (5, t[3]), (13, t[4]), (17, t[5]), (None, t[6]), (22, t[7]), (30, t[8])]
    assert sorted(map(repr, ((r.doc_id, r.text) for r in got))) == sorted(map(repr, want))


def test_plan_thresholds_cover_the_distance():
    assert all(t <= 0 for _, t in simhash.search_plan(0, np.zeros((64, 64))))
    for n in (100, 10_000, 10_000_000):
        plan = simhash.search_plan(n, np.full((64, 64), n / 4) + np.eye(64) * n / 4)
        assert sum(t + 1 for _, t in plan) == simhash.DISTANCE + 1
        assert sorted(b for g, _ in plan for b in g) == list(range(64))


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (5, 5), (None, 1), (2, 1), *[(100 + i, 101 + i) for i in range(40)]]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8} | {100 + i: 100 for i in range(41)}


# --- media


@settings(max_examples=30, deadline=None)
@given(st.text(max_size=700))
def test_media_round_trip(text):
    data = media.payload(text)
    assert len(data) % 192 == 0 and data and data.rstrip(b" ") == text.encode("utf-8", "surrogatepass").rstrip(b" ")
    stored = media.encode_png(data)
    assert media.decode_png(stored).tobytes() == data
    with pytest.raises((ValueError, struct.error)):
        media.decode_png(stored[:60] + bytes([stored[60] ^ 1]) + stored[61:])


@pytest.mark.parametrize("kind", range(5))
def test_every_filter_is_undone(kind):
    rng = np.random.default_rng(kind)
    image = rng.integers(0, 256, (5, 12), dtype=np.uint8)
    lines = np.zeros((5, 13), np.uint8)
    for y in range(5):
        for x in range(12):
            a, b = (int(image[y, x - 3]) if x >= 3 else 0), (int(image[y - 1, x]) if y else 0)
            c = int(image[y - 1, x - 3]) if y and x >= 3 else 0
            p = a + b - c
            paeth = min((abs(p - v), k, v) for k, v in enumerate((a, b, c)))[2]
            lines[y, x + 1] = (int(image[y, x]) - (0, a, b, (a + b) // 2, paeth)[kind]) % 256
        lines[y, 0] = kind
    assert (media.unfilter(lines, 3) == image).all()


def test_media_query(spark, tiny, rows):
    for r in queries.op8_media(spark, tiny).limit(50).collect():
        data = media.payload(rows[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(rows[r.doc_id].encode()), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]))
    assert io.BytesIO(media.encode_png(b" " * 192)).read(8) == media.SIGNATURE


def plain_hash(image):
    """The cosine hash by its sums, coefficient by coefficient."""
    h, w, _ = image.shape
    cell = lambda n, i: range(i * n // 32, max((i + 1) * n // 32, i * n // 32 + 1))
    grey = [[sum(int(image[y, x].sum()) for y in cell(h, i) for x in cell(w, j)) / (len(cell(h, i)) * len(cell(w, j))) for j in range(32)] for i in range(32)]
    cos = [[math.cos(math.pi * k * (2 * x + 1) / 64) for x in range(32)] for k in range(8)]
    low = [round(sum(cos[u][i] * cos[v][j] * grey[i][j] for i in range(32) for j in range(32)), 6) for u in range(8) for v in range(8)]
    middle = sorted(low[1:])[31]
    return f"{sum(1 << 63 - i for i, c in enumerate(low) if i and c > middle):016x}"


def test_features_against_plain_python(spark, tiny, rows):
    assert (media.SIDE, media.LOW) == (32, 8)
    for r in queries.op8_media(spark, tiny).limit(25).collect():
        stored = media.encode_png(media.payload(rows[r.doc_id]))
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert r.feature == plain_hash(media.decode_png(stored))


# --- pieces


def plain_lattice(model, unit):
    """Edges (start, end, ids, weight) of a unit, from the pieces' bytes alone."""
    ids = {b.decode(): i for i, b in enumerate(model.bytes_of) if i > max(model.byte_id) and b}
    out = []
    for i in range(len(unit)):
        for j in range(i + 1, min(len(unit), i + model.longest) + 1):
            if unit[i:j] in ids:
                out.append((i, j, (ids[unit[i:j]],), math.log(model.weight[ids[unit[i:j]]])))
        if unit[i] not in ids:
            spelled = unit[i].encode("utf-8", "surrogatepass")
            out.append((i, i + 1, tuple(model.byte_id[b] for b in spelled), len(spelled) * math.log(model.byte_weight)))
    return out


@pytest.fixture(scope="module")
def model():
    return pieces.Lattice(tokenizer("pieces"))


@pytest.mark.parametrize("word", ["then", "a", "Zeit", "the🙂n", "ñandú", "x" * 9, "12ab", "日本語", "end.", "\tto"])
def test_sampling_follows_the_lattice(model, word):
    edges = plain_lattice(model, " " + word)

    def paths(i):
        if i > len(word):
            yield (), 0.0
        for a, b, ids, w in edges:
            if a == i:
                for rest, v in paths(b):
                    yield (*ids, *rest), w + v

    every = {}
    for p, w in paths(0):
        every[p] = every.get(p, 0) + math.exp(w)
    n, scale = 20000, sum(every.values())
    drawn, at = model.sample([word] * n, list(range(n)))
    seen = Counter(tuple(drawn[a:b].tolist()) for a, b in zip(at, at[1:], strict=False))
    assert set(seen) <= set(every)
    for p, w in every.items():
        assert abs(seen[p] - n * w / scale) < 6 * math.sqrt(n * w / scale) + 3


def plain_sample(model, text, key, seed=pieces.SEED):
    """Forward filtering and backward sampling of one text, step by step."""
    mask = (1 << 64) - 1

    def mix(x):
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & mask
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & mask
        return x ^ (x >> 31)

    out, row = [], mix(pieces.hash_key(key) ^ seed)
    for k, unit in enumerate(re.findall(" +[^ ]*", " " + text) if text else []):
        edges, total = plain_lattice(model, unit), {0: 0.0}
        for j in range(1, len(unit) + 1):
            into = [total[a] + w for a, b, _, w in edges if b == j]
            most = max(into)
            total[j] = most + math.log(sum(math.exp(x - most) for x in into))
        own, at, step = mix((row + k) * 0x9E3779B97F4A7C15 & mask), len(unit), 0
        drawn = []
        while at:
            u, run = (mix((own + step) & mask) >> 32) / 2**32, 0.0
            for a, _, ids, w in sorted((e for e in edges if e[1] == at), key=lambda e: -e[0]):
                run += math.exp(total[a] + w - total[at])
                if u < run:
                    break
            drawn.insert(0, ids)
            at, step = a, step + 1
        out += [i for ids in drawn for i in ids]
    return out


MIXED = st.text(st.sampled_from("🙂😀👩ab cdeñ 日本語\n\t▁\x00 thenZ."), max_size=60)


@settings(max_examples=60, deadline=None)
@given(st.lists(MIXED, max_size=4))
def test_samples_against_plain_python(model, texts):
    with np.errstate(all="raise"):
        ids, at = model.sample(texts, list(range(len(texts))))
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [plain_sample(model, t, k) for k, t in enumerate(texts)]
    assert model.same_texts(ids, at, texts).all()


def test_long_units_do_not_underflow(model):
    texts = ["🙂" * 3000 + "abc" * 100, "🙂🙂🙂abcdefghijklm" + "🙂" * 40, "ñ" * 500, None, ""]
    with np.errstate(all="raise"):
        ids, at = model.sample(texts, [1, 2, 3, 4, 5])
    assert model.same_texts(ids, at, texts).all()
    wrong = ids.copy()
    wrong[0] ^= 1
    assert model.same_texts(wrong, at, texts).tolist() == [False, True, True, True, True]


def test_samples_do_not_depend_on_the_memo(model, monkeypatch):
    texts = [f"some words of text {i} and number {i * i}" for i in range(50)]
    want = model.sample(texts, list(range(50)))[0].tolist()
    monkeypatch.setattr(pieces, "MEMO_EDGES", 100)
    other = pieces.Lattice(tokenizer("pieces"))
    assert [x for i, t in enumerate(texts) for x in other.sample([t], [i])[0].tolist()] == want


def test_pieces_repeat_and_decode(spark, docs, rows):
    path = tokenizer("pieces")
    one = {r.doc_id: r.pieces for r in pieces.with_pieces(docs.select("doc_id", "text"), path).collect()}
    two = pieces.with_decoded(pieces.with_pieces(docs.select("doc_id", "text").repartition(7), path), path)
    for r in two.collect():
        assert r.pieces == one[r.doc_id] and r.decoded == rows[r.doc_id]
    for r in pieces.with_round_trip(docs.select("doc_id", "text"), path).collect():
        assert r.lossless and r.n_pieces == len(one[r.doc_id])
        assert r.pieces_sha256 == hashlib.sha256(np.array(one[r.doc_id], "<i4").tobytes()).hexdigest()


# --- quality


def test_quality_against_labels(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = [(r.keep, labels[r.doc_id]) for r in queries.op1_quality(spark, folder).collect() if r.doc_id in labels]
    bad = [k for k, q in got if q == 0]
    good = [k for k, q in got if q == 1]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_quality_query_against_plain_python(spark, tiny, rows):
    """Votes, posteriors by plain expectation-maximisation, and scores of the scorer that they train."""
    vote = {i: quality.votes(t) for i, t in rows.items()}
    good = {v: (0.95, 0.4, 0.1)[min(v.count(-1), 2)] for v in vote.values()}
    for _ in range(quality.EM_ROUNDS):
        share = {}
        for c in (0, 1):
            for k in range(12):
                n = {x: 1 + sum(good[v] if c else 1 - good[v] for v in vote.values() if v[k] == x) for x in (-1, 1)}
                share |= {(c, k, x): n[x] / sum(n.values()) for x in n}
        mass = sum(good[v] for v in vote.values())
        odds = math.log((mass + 1) / (len(vote) - mass + 1))
        good = {v: 1 / (1 + math.exp(-max(-30, min(30, odds + sum(math.log(share[1, k, x] / share[0, k, x]) for k, x in enumerate(v) if x))))) for v in good}
    out = {r.doc_id: r for r in queries.op1_quality(spark, tiny).collect()}
    for i, r in out.items():
        assert tuple(r.votes) == vote[i] and abs(r.weak_label - good[vote[i]]) < 1e-6
    pairs = sorted((np.float64(good[vote[i]]), quality.features(t).astype(np.float16).tobytes()) for i, t in rows.items())  # all rows: there are fewer than TRAIN_ROWS
    w = quality.fit_scorer(np.stack([np.frombuffer(x, np.float16) for _, x in pairs]).astype(np.float32), np.array([y for y, _ in pairs]))
    for i, r in out.items():
        want = 1 / (1 + math.exp(-float(quality.features(rows[i]) @ w[:-1] + w[-1]))) if rows[i].strip() else 0.0
        assert abs(r.score - want) < 1e-3 and r.keep == (r.score >= quality.KEEP)


def test_label_model_finds_the_good_labellers():
    rng = random.Random(1)
    counts = Counter()
    for _ in range(4000):
        truth = rng.random() < 0.8
        v = [(1 if (truth if rng.random() < 0.9 else not truth) else -1) if i < 3 else 0 for i in range(len(quality.LABELLERS))]
        counts[sum((x + 1) * 3**i for i, x in enumerate(v))] += 1
    _, shares = quality.label_model(counts)
    assert all(abs(shares[i, 1, 2] - 0.9) < 0.03 and abs(shares[i, 0, 0] - 0.9) < 0.05 for i in range(3))


# --- language model


def plain_tokens(text):
    return [w for w in re.split(rb"[\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())) if w] + [b""]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from("aAbBzZ éß日🙂 \t\n\x0b\x1c.[`{"), max_size=30)), max_size=6), st.integers(1, 40))
def test_token_hashes(texts, size):
    slice_size, language_model.SLICE = language_model.SLICE, size
    try:
        got, lengths = language_model.token_hashes(pa.array(texts, pa.string()))
        part, _ = language_model.token_hashes(pa.array(["x y", *texts], pa.string()).slice(1))
    finally:
        language_model.SLICE = slice_size
    want = [plain_tokens(t) for t in texts]
    assert lengths.tolist() == [len(w) for w in want] and (part == got).all()
    words = [w for ws in want for w in ws]
    pairs = set(zip(words, got.tolist(), strict=True))
    assert len({w for w, _ in pairs}) == len({h for _, h in pairs}) == len(pairs)


@given(st.lists(st.integers(0, 2**64 - 1), max_size=20))
def test_packed_numbers_come_back(values):
    values = np.array(values, np.uint64)
    assert (language_model.unpacked(language_model.packed(values)) == values).all()


def test_counts_beyond_32_bits():
    """Two blocks that have one word 3e9 times each: the totals don't wrap."""
    keys = [np.array([7], np.uint64)] * 3
    rows = [(b, k, 0, *[language_model.packed(x) for x in keys], *[language_model.packed(np.array([n]))] * 3) for b, k, n in ((0, language_model.KEPT_BLOCK, 3_000_000_000), (1, language_model.DELETED_BLOCK, 3_000_000_000))]
    out = language_model.answers_of(language_model._table(rows, language_model.REQUEST)).to_pylist()
    assert [language_model.unpacked(r["n2"]).tolist() for r in out[:2]] == [[6_000_000_000]] * 2
    assert out[0]["kept0"] is None and language_model.unpacked(out[1]["kept0"]).tolist() == [3_000_000_000]
    assert out[2]["totals"] == [6_000_000_000, 1, 3_000_000_000, 1]


def plain_model(tokens, fold):
    """Scores by deleted interpolation from counters of word n-grams, with the weights learned on every deleted token."""
    grams = lambda t, k: [tuple([None, None, *t][i + 3 - k : i + 3]) for i in range(len(t))]

    def counts(folds):
        return [Counter(g for i, t in tokens.items() if fold[i] in folds for g in grams(t, k)) for k in (1, 2, 3)]

    def parts(c, t):
        n, v, starts = sum(c[0].values()), len(c[0]), c[0][(b"",)]
        for i, (one, two, three) in enumerate(zip(grams(t, 1), grams(t, 2), grams(t, 3), strict=True)):
            of_one = c[0][(t[i - 1],)] if i else starts
            of_two = c[1][two[:1] and tuple([None, None, *t][i : i + 2])] if i else starts
            p = [1 / (v + 1), c[0][one] / n, c[1][two] / of_one if of_one else 0, c[2][three] / of_two if of_two else 0]
            yield (2, of_two.bit_length()) if of_two else (1, of_one.bit_length()) if of_one else (0, 0), p

    kept, whole = counts({1, 3, 4, 5, 6}), counts({0, 1, 3, 4, 5, 6})
    by = {}
    for i, t in tokens.items():
        if fold[i] == 0:
            for b, p in parts(kept, t):
                by.setdefault(b, []).append(p)
    weights = {}
    for b, ps in by.items():
        k = b[0] + 2
        w = np.array([1 / k] * k + [0] * (4 - k))
        p = np.array(ps).T
        for _ in range(language_model.ROUNDS):
            share = w[:, None] * p
            w = (share / share.sum(axis=0)).sum(axis=1) / len(ps)
        weights[b] = w
    out = {}
    for i, t in tokens.items():
        score = 0.0
        for b, p in parts(whole, t):
            near = b if b in weights else min((x for x in weights if x[0] == b[0]), key=lambda x: abs(x[1] - b[1]), default=None)
            w = weights[near] if near else np.array([1 / (b[0] + 2)] * (b[0] + 2) + [0] * (2 - b[0]))
            score += math.log10(float(np.dot(w, p)))
        out[i] = score
    return out


def test_scores_against_plain_python(spark, docs, rows):
    tokens = {i: plain_tokens(t) for i, t in rows.items()}
    fold = {i: zlib.crc32(str(i).encode()) % 7 for i in rows}
    count = Counter(w for i, t in tokens.items() if fold[i] != 2 for w in t)
    n, v = sum(count.values()), len(count)
    out = {r.doc_id: r for r in language_model.with_scores(docs, block_bytes=40_000).collect()}
    want = plain_model(tokens, fold)
    for i, t in tokens.items():
        base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t)
        r = out[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (fold[i] == 2, len(t), sum(count[w] > 0 for w in t), n)
        assert abs(r.base_score - base) < 1e-7 * abs(base)
        assert abs(r.score - want[i]) < 1e-3 * abs(want[i])  # the weights come from cells, not from single tokens
    assert abs(sum(out[i].score - want[i] for i in want)) < 1e-3 * abs(sum(want.values()))
    held = [r for r in out.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_model_is_a_distribution():
    """The probabilities that a context gives to all words and the unknown one come to one, in every bucket."""
    texts = [b"a b a c", b"b a", b"c c a b", b"a"]
    tokens = [plain_tokens(t.decode()) for t in texts]
    one = Counter(w for t in tokens for w in t)
    two = Counter(p for t in tokens for p in zip([None, *t], t, strict=False))
    three = Counter(p for t in tokens for p in zip([None, None, *t], [None, *t], t, strict=False))
    weights = language_model.em_weights([((b << 33) | c, 5 + c, 3.0 * c, 1.0 + c, 0.5) for b in (0, 65, 66, 129) for c in (0, 2)])
    assert np.allclose(weights.sum(axis=1), 1)
    n, v = sum(one.values()), len(one)
    for u, w in [(None, None), (None, b"a"), (b"a", b"b"), (b"z", b"a"), (b"z", b"z")]:
        of_one = one[w] if w else one[b""]
        of_two = two[u, w] if w else one[b""]
        b = 128 + int(math.log2(of_two)) if of_two else 64 + int(math.log2(of_one)) if of_one else 0
        total = sum(weights[b] @ [1 / (v + 1), one[x] / n, two[w, x] / max(of_one, 1), three[u, w, x] / max(of_two, 1)] for x in [*one, b"unknown"])
        assert abs(total - 1) < 1e-9
