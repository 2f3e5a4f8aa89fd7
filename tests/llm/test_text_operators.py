"""Search, pages, token counts, fingerprints and chat against brute force."""

import collections
import hashlib
import math
import random

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlens.llm import chat, metric, pages, phrases, queries, tokens

SF01 = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in ("embeddings", "conversations", "documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF01}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF01)
    cursor = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(tuple(r) for r in got.select(*columns).collect()) == sorted(cursor.fetchall())


def naive_top(rows, k, every, scale=64):
    v = {}
    for i, x in rows:
        if i is not None and x is not None and all(c is not None and math.isfinite(c) for c in x):
            v.setdefault(i, []).append([math.floor(scale * float(c)) for c in x])
    out = set()
    for i in v:
        if i % every == 0:
            q = min(v[i])
            best = sorted((-sum(a * b for a, b in zip(q, c)), j) for j in v if j != i for c in v[j])[:k]
            out |= {(i, r, j, -s) for r, (s, j) in enumerate(best, 1)}
    return out


@pytest.mark.parametrize("shard_rows, block", [(7, 5), (1000, 1000)])
def test_search_odd_rows(spark, shard_rows, block):
    rng = np.random.default_rng(1)
    one = rng.normal(size=6)
    rows = [(i, (one + rng.normal(size=6) * (0.02 if i % 3 else 2.0)).tolist()) for i in range(300)]
    rows += [(1000 + i, one.tolist()) for i in range(60)]  # one vector many times: ties by id
    rows += [(2000, None), (2020, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2040, [float("nan")] * 6), (2060, [float("inf")] * 6), (2080, [0.0] * 6), (None, [1.0] * 6), (2100, []), (2120, [1.0, 2.0])]
    rows += [(40, rows[40][1]), (41, rows[41][1]), (41, rows[41][1])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, score int, rank string")
    got = {tuple(r) for r in metric.top_products(df, pivots=4, shard_rows=shard_rows, block=block).collect()}
    assert got == naive_top(rows, 20, 20)
    assert metric.top_products(df.limit(0)).count() == 0
    few = {tuple(r) for r in metric.top_products(df.where("vec_id < 5")).collect()}
    assert few == naive_top(rows[:5], 20, 20)


def test_tree_skips_work_and_stays_exact():
    rng = np.random.default_rng(2)
    centres = rng.integers(-60, 60, (20, 8))
    v = np.vstack([c + rng.integers(-2, 3, (300, 8)) for c in centres]).astype(float)
    tree = metric.Tree(np.arange(len(v)), v, float((v * v).sum(1).max()))
    seen = 0

    class Counting(np.ndarray):
        def __getitem__(self, key):
            nonlocal seen
            out = np.asarray(self)[key]
            seen += len(out) if out.ndim == 2 else 0
            return out

    tree.v = np.array(tree.v).view(Counting)
    for q in range(0, len(v), 300):
        best = sorted(tree.search(q, v[q], 10, -np.inf), reverse=True)
        want = sorted(((s, -i) for i, s in enumerate((v @ v[q]).tolist()) if i != q), reverse=True)[:10]
        assert [(s, -i) for s, i in best] == [(s, -i) for s, i in want]
    assert seen < 0.5 * 20 * len(v)


PAGE = """<!DOCTYPE html><html lang=en><head><title>T &amp; x</title><style>p{}</style><script>var a="</p><p>no";</script></head>
<body><header><a href=/>Home</a> Site name</header><nav><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></nav>
<div class="cookie-notice">We use cookies to make this site work as you would expect it to work every day.</div>
<article><h1>Head  line</h1><p>First&nbsp;para &lt;with&gt; <b>bold</b> and a <a href=x>link</a> inside
 of it, long enough to be text.<aside>Related: <a href=z>other story</a></aside><p>Short.</p>
<!-- <p>gone</p> --><div class=ad>Buy this now, it is a very good thing to buy today.</div><p>caf&eacute; &#x1F600; end of the piece</article>
<section id="comments"><p>A reader writes a rather long comment here that is no part of the article at all, really.</p></section>
<form><label>Name</label><input name=n><textarea>typed</textarea></form><footer>&copy; 2024 Someone and company</footer></body></html>"""


def test_main_text():
    tree = pages.train()
    assert pages.main_text(PAGE, tree) == ("Head line\nFirst para <with> bold and a link inside of it, long enough to be text.\nShort.\ncafé 😀 end of the piece")
    plain = "<body><ul><li><a href=a>One</a></li><li><a href=a>Two</a></li></ul>" + "".join(f"<p>{'word ' * 30}{k}</p>" for k in range(3)) + "<div>Imprint</div>"
    assert pages.main_text(plain, tree) == "\n".join("word " * 30 + str(k) for k in range(3))
    for odd in ("", "<", "<<<>>", "<p", "</p></div>", "<!-- x", "<a><a>", "<script>x", "plain words only", "<p>" * 5000, "\x00&#0;&bogus;"):
        assert isinstance(pages.main_text(odd, tree), str)


def test_main_text_in_wrappers():
    """Elements around the whole page are no side elements, whatever they are called."""
    tree = pages.train()
    body = [f"{'word ' * 40}{k}" for k in range(4)]
    article = "".join(f"<p>{x}</p>" for x in body)
    sides = "<div class=sidebar><p>Side text that stands beside all of it, of some length.</p></div>"
    notice = "<div class='cookie-notice'><div class=content><p>We use cookies to make this site work as you expect it to work every day.</p></div></div>"
    for wrapper in ("<div class='layout has-sidebar'>", "<div class='content-with-sidebar'>", "<div class='page has-header'>", "<form action=x>", "<div class='site-header-wrap header'>", "<div id=widget-page class=widget>"):
        for inner in ("<div class='post-content'>", "<div class=content>", "<div>"):
            page = f"<html><body>{wrapper}{sides}{notice}{inner}{article}</div></body></html>"
            assert pages.main_text(page, tree) == "\n".join(body), (wrapper, inner)
    small = f"<body><div class=widget><div class='post-content'>{article}</div></div><ul>{'<li>entry of a list ' * 200}</ul></body>"
    assert "\n".join(body) in pages.main_text(small, tree)
    comments = f"<body><article><h1>Head</h1>{article}</article><div class=comments>{article * 3}</div></body>"
    assert pages.main_text(comments, tree) == "Head\n" + "\n".join(body)
    assert pages.main_text(f"<body><div hidden>{article}</div><p>seen</p></body>", tree).count("word") == 0


def test_tree_learns_the_table():
    table = np.array(pages.LABELLED, float)
    right = 0
    for k in range(5):  # held out: every fifth row
        out = np.arange(len(table)) % 5 == k
        tree = pages.grow(table[~out, :-1], table[~out, -1])
        right += (pages.judge(tree, table[out, :-1]) == (table[out, -1] > 0.5)).sum()
    assert right >= 0.85 * len(table)


def test_pages_table(spark):
    source = {r.page_id: r for r in spark.read.parquet(f"{SF01}/pages.parquet").collect()}
    got = queries.op2_main_text(spark, SF01).collect()
    assert len(got) == len(source)
    for r in got:
        html = source[r.page_id].html
        assert r.url == source[r.page_id].url and r.n_chars == len(r.text)
        article = html[html.index("<article>"):html.index("</article>")]
        want = [" ".join(x.split()) for x in __import__("re").sub(r"<(?!/?(?:b|br)\b)[^>]*>", "\n", article).replace("<b>", "").replace("</b>", "").replace("<br>", " ").split("\n")]
        assert r.text == "\n".join(x for x in map(__import__("html").unescape, want) if x)


def test_pages_odd_rows(spark):
    df = spark.createDataFrame([(1, None, None, "t"), (2, "u", "", "t"), (None, "u", PAGE, "t"), (None, "u", PAGE, "t")], "page_id long, url string, html string, text string")
    got = pages.extract(df).collect()
    assert sorted((r.page_id is None, r.page_id or 0, r.n_chars) for r in got) == [(False, 1, 0), (False, 2, 0), (True, 0, len(got[-1].text)), (True, 0, len(got[-1].text))]
    assert pages.extract(df.limit(0)).count() == 0


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_tokenizer())


def counted(machine, texts):
    import pyarrow as pa

    from ledgerlens.llm.common import row_slices, text_buffer

    raw, at = text_buffer(pa.array(texts, pa.string()))
    return [n for lo, hi in row_slices(at, 5000) for n in machine.count(raw, at[lo:hi + 1]).tolist()]


ODD_TEXTS = ["", None, "a", "don't we'll 's 't's 'sx '''s \n's  's they've  I'm\t\tx   ", "  lead", "trail   ", " \n\n  x\n", "<|endoftext|>", "a <|endoftext|>  b  <|endoftext|>",
             "x  <|endoftext|>'s", "a" * 3001, "  " * 700 + "x", "1234 ½ ² ٣ 𝟘 漢字かな", " éàü ñ 👍🏽  x 　y \x1c\x1d x\x85y", "=====---- " * 100, "'RE 'Re're", "é" * 3000, "\x00\x01 \x7f", "word " * 40_000]


def test_token_counts_odd_texts(spark, library):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(ODD_TEXTS)], "doc_id long, text string, n_tokens int")
    got = {r.doc_id: r for r in tokens.token_counts(df).collect()}
    for i, t in enumerate(ODD_TEXTS):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 512)
    assert tokens.token_counts(df.limit(0)).count() == 0


def test_token_counts_whole_table(spark, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()}
    got = queries.op6_token_counts(spark, SF01).collect()
    want = [len(e.ids) for e in library.encode_batch([texts[r.doc_id] for r in got], add_special_tokens=False)]
    assert [r.n_tokens for r in got] == want and len(got) == len(texts)


MACHINE = []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab 's\n\t<|>é1½'´漢  ,.-=rtvelmd́"), max_size=60), max_size=6))
def test_token_counts_random_texts(texts):
    from tokenizers import Tokenizer

    if not MACHINE:
        MACHINE.extend([tokens.Transducer(tokens.default_tokenizer()), Tokenizer.from_file(tokens.default_tokenizer())])
    assert counted(MACHINE[0], texts) == [len(MACHINE[1].encode(t, add_special_tokens=False).ids) for t in texts]


def test_token_chunk_maps_compose(library):
    """Words longer than a chunk: the maps of their chunks are composed."""
    machine = tokens.Transducer(tokens.default_tokenizer())
    rng = random.Random(7)
    texts = ["".join(rng.choice("abcdeinrst") for _ in range(n)) for n in (511, 512, 513, 2500, 4000)]
    assert counted(machine, texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_fingerprints_whole_table(spark):
    docs = sorted(spark.read.parquet(f"{SF01}/documents.parquet").collect(), key=lambda r: r.doc_id)
    got = {r.doc_id: r for r in queries.op9_fingerprints(spark, SF01).collect()}
    assert len(got) == len(docs)
    near = []
    by_text = {}
    for k, r in enumerate(docs):
        after, text = docs[(k + 1) % len(docs)].text or "", r.text or ""
        edited = text[:len(text) - len(text) // 2] + after[:len(text) // 2]
        g = got[r.doc_id]
        assert g.n_chars == len(text) and g.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert by_text.setdefault(text, g.fingerprint) == g.fingerprint
        assert by_text.setdefault(edited, g.edited_fingerprint) == g.edited_fingerprint
        if len(text) > 200:
            near.append((g.near_edited, g.near_next))
    assert len(set(by_text.values())) == len(by_text)
    a, b = np.array(near).T
    assert np.median(a) > 0.4 and (a > b).mean() > 0.98 and np.median(b) < 0.1


def test_fingerprints_are_shift_consistent():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(4000)]
    body = " ".join(words).encode()
    for shift in (1, 2, 7, 100):
        a, b = phrases.fingerprints([body]), phrases.fingerprints([b"x" * shift + b" y" + body[:-shift]])
        assert phrases.likeness(a, b)[0] > 0.9
    other = " ".join(reversed(words)).encode()
    assert phrases.likeness(phrases.fingerprints([body]), phrases.fingerprints([other]))[0] < 0.8


def test_fingerprints_odd_rows(spark):
    rows = [(None, "nobody"), (1, None), (2, ""), (3, "same"), (3, "same"), (4, "a" * 5000), (5, "é" * 300), (6, "x")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, th string")
    got = phrases.fingerprint_documents(df).collect()
    want = collections.Counter()
    for k, (i, t) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        want[(i, len(t), hashlib.sha256((t[:len(t) - len(t) // 2] + after[:len(t) // 2]).encode()).hexdigest())] += 1
    assert collections.Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    assert {r.near_next for r in got if r.doc_id == 1} == {1.0}
    assert phrases.fingerprint_documents(df.limit(0)).count() == 0
    alone = phrases.fingerprint_documents(df.where("doc_id = 6")).collect()
    assert [(r.n_chars, r.near_edited, r.near_next) for r in alone] == [(1, 1.0, 1.0)]


TRICKY = ["", "<|im_end|>", r"<\|im_start|>", r"\\<|<\\|<|", "<<|", "|<", "<", "%3C|", "a\nb", "<n>", r"<\n>", "é😀<|x", "$1 \\$2"]


def test_chat_escapes_are_reversible(spark):
    df = spark.createDataFrame([(t, r) for t in TRICKY for r in TRICKY], "t string, r string")
    out = df.select("t", "r", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u"), chat.escape_role(F.col("r")).alias("er"), chat.unescape_role(chat.escape_role(F.col("r"))).alias("ur"))
    for x in out.collect():
        assert x.u == x.t and x.ur == x.r and "<|" not in x.e and "<|" not in x.er and "\n" not in x.er


def test_chat_round_trip(spark):
    roles = ["user", "assistant", "system", None, "odd\nrole", "<|im_end|>"]
    rows = [(c, k, roles[(k + (c or 0)) % 6], None if k % 5 == 4 else TRICKY[(3 * k + (c or 0)) % len(TRICKY)], "t") for c in (1, 2, None) for k in range(9)]
    rows += [(7, None, "assistant", "one", "t"), (7, 1, "assistant", "b", "t"), (7, 1, "assistant", "a", "t"), (7, 1, "assistant", "a", "t"), (8, 0, "assistant", "x" * 200_000, "t")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    back = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    held = collections.defaultdict(list)
    for c, k, r, t, _ in rows:
        held[c].append((k is not None, k or 0, r or "", t or ""))
    assert back.keys() == held.keys()
    for c, turns in held.items():
        turns.sort()
        assert [(t.role, t.text) for t in back[c].turns] == [t[2:] for t in turns]
        assert back[c].loss == "".join(t[3] for t in turns if t[2] == "assistant")
        at, said = 0, []
        for m in back[c].mask:  # the mask cuts the formatted text itself
            at += m.skip
            said.append(back[c].formatted[at:at + m.take])
            at += m.take
        assert __import__("re").sub(r"<\\(\\*)\|", r"<\1|", "".join(said)) == back[c].loss
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_chat_records_of_rows(spark):
    """Rows become nested records of several layouts; the fingerprint selects each one's mapping."""
    says = {1: ["user", "assistant"], 2: ["system", "user", "assistant"], 3: ["system", "user"], 4: ["system"], 5: ["user"], 6: ["assistant", "user"],
            7: ["system", "system", "user"], 8: ["system", "user", "assistant", "user", "assistant"], 9: [None, "user"], 10: ["user", "assistant", "assistant"]}
    rows = [(c, k, r, None if (c + k) % 4 == 0 else f"{c} {k} <|im_end|>") for c, roles in says.items() for k, r in enumerate(roles)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_conversations(df)
    assert {r.conv_id: r.layout for r in out.collect()} == {c: "prompt and response" if c in (1, 2) else "messages" for c in says}
    records = {r.conv_id: r for r in chat.conversation_records(df).collect()}
    assert records[2].system is not None and records[2].messages is None and records[4].system is None and len(records[8].messages) == 4 and records[7].system is not None
    back = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.read_back(out).collect()}
    assert back == {c: [(r or "", "" if (c + k) % 4 == 0 else f"{c} {k} <|im_end|>") for k, r in enumerate(roles)] for c, roles in says.items()}


def test_chat_nested_records(spark):
    """Records of any layout beside each other, in clashing columns, formatted and read back."""
    records = ['{"id":1,"prompt":"p","response":"r <|im_start|>"}', '{"id":2,"conversations":[{"from":"human","value":"a"},{"from":"gpt","value":"b"}],"system":"s"}',
               '{"id":3,"messages":[{"role":"assistant","content":"x"}],"mask":"m"}', '{"id":4,"odd":{"deep":1}}']
    df = spark.read.json(spark.sparkContext.parallelize(records))
    back = {r.id: ([tuple(t) for t in r.turns], r.loss) for r in chat.read_back(chat.format_records(df)).collect()}
    assert back == {1: ([("user", "p"), ("assistant", "r <|im_start|>")], "r <|im_start|>"), 2: ([("system", "s"), ("user", "a"), ("assistant", "b")], "b"),
                    3: ([("assistant", "x")], "x"), 4: ([], "")}


def test_chat_layouts(spark):
    records = ['{"id":1,"prompt":"p","response":"r"}', '{"id":2,"instruction":"i","input":"n","output":"o"}', '{"id":3,"instruction":"i","output":"o"}',
               '{"id":4,"messages":[{"role":"user","content":"a"},{"role":"assistant","content":null}]}', '{"id":5,"conversations":[{"from":"human","value":"a"},{"from":"gpt","value":"b"}]}',
               '{"id":6,"strange":"x"}', '{"id":7,"system":"s","question":"q","answer":"a"}', '{"id":8,"prompt":"p"}']
    df = spark.read.json(spark.sparkContext.parallelize(records))
    got = {r.id: (r.layout, [tuple(t) for t in r.turns]) for r in chat.canonical_turns(df).collect()}
    assert got == {
        1: ("prompt and response", [("user", "p"), ("assistant", "r")]), 2: ("instruction", [("user", "i\n\nn"), ("assistant", "o")]),
        3: ("instruction", [("user", "i"), ("assistant", "o")]), 4: ("messages", [("user", "a"), ("assistant", "")]),
        5: ("from and value", [("user", "a"), ("assistant", "b")]), 6: (None, []), 7: ("question", [("system", "s"), ("user", "q"), ("assistant", "a")]), 8: (None, [])}


BODY = "<p>" + "Long text of the piece with words. " * 8 + "</p>"


@pytest.mark.parametrize("name", "share-price related-work social-history search-engines form-of-government menu-planning ad-astra reply-to-critics".split())
def test_main_text_keeps_article_parts_with_side_words(name):
    """A class inside an article counts only if all its words tell a side element."""
    tree = pages.train()
    page = f"<body><nav><a>x</a></nav><article><h1><a href=x>Title here</a></h1>{BODY}<div class='{name}'>{BODY}Short {name} note.</div>{BODY}</article></body>"
    text = pages.main_text(page, tree)
    assert text.startswith("Title here\n") and f"Short {name} note." in text and text.count("Long text") == 24
    links = "".join(f"<li><a href=x>one {name} link</a></li>" for _ in range(4))
    assert name not in pages.main_text(f"<body><article><h1>T</h1>{BODY}<div class='{name}'><ul>{links}</ul></div>{BODY}</article></body>", tree)


def test_main_text_blocks_of_several_templates():
    """Precision and recall of blocks over templates: marked blocks (M) are main text, the others (S) are not."""
    tree = pages.train()
    item = lambda k: f"<li><a href=r{k}>M reference {k} by its author</a></li>"
    side = "".join(f"<li><a href=s{k}>S link {k}</a></li>" for k in range(6))
    text = lambda k: f"<p>M paragraph {k} " + "of running text " * 9 + "</p>"
    body = "<h1><a href=x>M heading</a></h1>" + text(1) + "<h2>M part</h2>" + text(2) + "<ol>" + "".join(map(item, range(5))) + "</ol>" + text(3)
    templates = [
        f"<body><nav><ul>{side}</ul></nav><article>{body}<div class='ad'>S buy this now</div>{text(4)}</article><footer>S all rights</footer></body>",
        f"<body><div id=menu><ul>{side}</ul></div><main>{body}<aside>S see also this piece of news</aside><div class='social-share'>S tell your friends</div></main><div class=comments><p>S {'a reader says ' * 9}</p></div></body>",
        f"<body class=has-sidebar><div class=wrapper><div class='post-content'>{body}</div><div class='sidebar widget-area'><ul>{side}</ul><p>S {'about this site ' * 8}</p></div></div></body>",
        f"<body><header><h1>S site name</h1></header><div role=main>{body}<form>S your address <input></form></div><div class='cookie-notice'>S {'we store things ' * 10}</div></body>",
        f"<body><article><header><h1><a>M heading</a></h1></header>{text(1)}<div class=related-posts><ul>{side}</ul></div>{text(2)}<section class='form-of-government'>{text(3)}</section></article></body>",
    ]
    found = kept = marked = 0
    for page in templates:
        lines = pages.main_text(page, tree).split("\n")
        want = [b[0] for b in pages.page_blocks(page) if b[0].startswith("M ")]
        found += sum(x in lines for x in want)
        marked, kept = marked + len(want), kept + len(lines)
    assert found == marked == kept


def test_main_text_of_a_long_page():
    page = "<body><nav><a>S</a></nav><article>" + "".join(f"<p>word {k} of a long page, told again</p>" for k in range(30_000)) + "</article></body>"
    assert pages.main_text(page, pages.train()).count("\n") == 29_999
