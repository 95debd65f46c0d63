"""Operators 11 to 13 against brute force on small fixtures with odd rows."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quartermill.llm import blocks, divergence, maintext, prefixes

# 11 ------------------------------------------------------------------------------------

TERM = re.compile(divergence.TERM)
DOC = "doc_id long, text string, lang string, source string, n int, v int, salt int, term string"


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def audit(rows, least, top):
    seen, counts, groups = defaultdict(set), defaultdict(Counter), set()
    for k, (text, lang, source) in enumerate(rows):
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        for term in TERM.findall(lowered(text or "")):
            seen[lang, term].add(k)
            counts[lang, source][term] += 1
    out = set()
    for lang, source in groups:
        kept = [t for (l, t), docs in seen.items() if l == lang and len(docs) >= least]
        others = [s for l, s in groups if l == lang]
        total = Counter()
        for s in others:
            total.update(counts[lang, s])

        def p(count):
            return {t: 1 + 10**9 * (count[t] + 5) // (sum(count[x] for x in kept) + 5 * len(kept)) for t in kept}

        own, q = p(counts[lang, source]), p(total)
        parts = {"pair": {}, "term": {t: own[t] - q[t] for t in kept if counts[lang, source][t] and own[t] > q[t]}}
        for s in others:
            if s != source:
                there = p(counts[lang, s])
                parts["pair"][s] = sum(abs(own[t] - there[t]) for t in kept)
        for part, values in parts.items():
            for rank, (item, value) in enumerate(sorted(values.items(), key=lambda x: (-x[1], x[0].encode())), 1):
                if part == "pair" or rank <= top:
                    out.add((lang, source, part, item, value, rank))
    return out


def audited(spark, rows, least, top=50):
    docs = spark.createDataFrame([(i, *r, 1, 2, 3, "x") for i, r in enumerate(rows)], DOC).repartition(3)
    got = divergence.divergence(docs, least, top)
    assert dict(got.dtypes) == {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"}
    found = [tuple(r) for r in got.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(found) == len(set(found))
    return set(found)


def test_divergence_equals_brute_force(spark):
    rng = random.Random(3)
    words = "The the été ÉTÉ 日本 a-b ß ﬁ x1y \U0001d538z stone RIVER light".split()
    rows = [(" ".join(rng.choice(words) for _ in range(rng.randint(0, 40))), rng.choice(["en", "en", "de", None]), rng.choice(["a", "b", "é", "\U0001d538", None])) for _ in range(120)]
    rows += [(None, "en", "empty"), ("", None, "a"), ("1 2 3", "fr", "only"), ("one", "it", "x"), ("two", "it", "y"), ("the " * 5000, "en", "a")] + [("same text", "en", "b")] * 9
    for least, top in ((8, 50), (1, 2)):
        assert audited(spark, rows, least, top) == audit(rows, least, top)


def test_divergence_of_nothing_and_without_kept_terms(spark):
    assert audited(spark, [], 1) == set()
    assert audited(spark, [("a b", "en", "x"), ("c", "en", "y")], 5) == {("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)}


def test_divergence_breaks_ties_by_bytes(spark):
    rows = [("z é a \U0001d538 ﬁ", "en", "s"), ("other", "en", "t")]
    got = [x for x in audited(spark, rows, 1) if x[1:3] == ("s", "term")]
    assert [x[3] for x in sorted(got, key=lambda x: x[5])] == sorted(["z", "é", "a", "\U0001d538", "ﬁ"], key=str.encode)


# 12 ------------------------------------------------------------------------------------

TURN = "conv_id long, turn long, role string, text string, depth int, points string, up int"


def digest(role, text):
    return hashlib.sha256((hashlib.sha256(role.encode()).hexdigest() + hashlib.sha256(text.encode()).hexdigest()).encode()).hexdigest()


def trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", digest(role or "", text or ""), text or ""))
    own = {c: [(t[2], t[4]) for t in sorted(v)] for c, v in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(own.get(c - int(np.fmod(c, 100)), [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, path in built.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, convs in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(convs) - 1) * len(p[-1][1]) if p else 0
    ends = {p: ",".join(map(str, sorted(c for c in convs if built[c] == p))) for p, convs in members.items()}
    return sorted((min(v), len(p), min(members[p[:-1]]) if p else None, len(v), children[p], leaves[p], saved[p], hashlib.sha256(ends[p].encode()).hexdigest()) for p, v in members.items())


def found_trie(spark, rows, **parameters):
    table = spark.createDataFrame([(*r, 7, "x", 1) for r in rows], TURN).repartition(3)
    got = prefixes.prefix_trie(table, **parameters)
    assert dict(got.dtypes) == dict.fromkeys("conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens".split(), "bigint") | {"ends_sha256": "string"}
    return sorted(tuple(r) for r in got.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect())


def odd_conversations():
    rng = random.Random(5)
    rows = []
    for c in [*range(0, 30), *range(100, 130), *range(205, 230), -3, -150]:
        for t in range(rng.randint(1, 9)):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["hi", "hé \U0001d538", "", None, "longer text of a turn"])))
    rows += [(3, None, "user", "first"), (3, 2, "user", "tie"), (3, 2, "user", "tie"), (3, 2, "assistant", "tie"), (None, 1, "user", "nobody"), (901, 0, "user", "alone")]
    return rows


def test_trie_equals_brute_force(spark):
    rows = odd_conversations()
    assert found_trie(spark, rows) == trie(rows)
    # stretches of three turns and pieces of a few bytes: the same nodes
    assert found_trie(spark, rows, chunk=3, piece=4) == trie(rows)


def test_trie_of_many_copies_and_one_long_conversation(spark):
    rows = [(100 + c, t, "user", f"turn {t}") for c in range(60) for t in range(7)] + [(7, t, "user", str(t % 5)) for t in range(900)]
    assert found_trie(spark, rows, chunk=50, piece=16) == trie(rows)


def test_turnless_conversations_and_none(spark):
    alone = [c for c in range(500, 600) if c % 100 and zlib.crc32(str(c).encode()) % 6][:3]
    rows = [(c, 0, "user", "x") for c in alone]
    assert trie(rows)[0][3] == 3 and found_trie(spark, rows) == trie(rows)
    assert found_trie(spark, []) == []


# 13 ------------------------------------------------------------------------------------

PRIOR = maintext.fit(np.zeros(len(maintext.GRID)), np.zeros(len(maintext.GRID)))
LONG = "It was a long day in the valley, and the river was quiet. Nobody had seen the boats that usually came by."
PAGE = "page_id long, url string, html string, text string, n_chars string, cell int"


def cost(gain, edges, label):
    return sum(max(g, 0) for g, x in zip(gain, label) if not x) + sum(max(-g, 0) for g, x in zip(gain, label) if x) + sum(w for i, j, w in edges if label[i] != label[j])


def test_cut_is_the_least_of_all_labellings():
    rng = random.Random(1)
    for _ in range(600):
        n = rng.randint(0, 9)
        gain = [rng.randint(-6, 6) for _ in range(n)]
        edges = [(i, j, rng.randint(1, 5)) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.4]
        least = min(cost(gain, edges, x) for x in itertools.product([False, True], repeat=n))
        assert cost(gain, edges, maintext.cut_labels(gain, edges)) == least
        assert cost(gain, edges, maintext._source_side(gain, edges)) == least  # the flow alone, nothing settled before


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (f"<nav>a</nav><article><h1>T</h1><p>{LONG}<p>b</article><footer>f</footer>", f"T\n{LONG}\nb"),
        (f"<header><h1>Site</h1></header><main><article><header><h1>T</h1></header><p>{LONG}</p><div class='ad-slot'>Buy</div><form>Mail <input></form></article></main>", f"T\n{LONG}"),
        (f"<div><a>Home</a> <a>News</a></div><div><p>{LONG}</p><p>Short one.</p><p>{LONG}</p></div><div>&copy; 2024. All rights reserved.</div>", f"{LONG}\nShort one.\n{LONG}"),
        (f"<article><p>{LONG}</p><section id=comments><article class=comment><p>{LONG}</p></article></section></article><div class=sidebar>{LONG}</div>", LONG),
        (f"<form id=all><div class=menu><a>m</a></div><div class=content><p>{LONG}</p></div></form><div class='cookie-notice'>{LONG}</div>", LONG),
        ("<article><p>a&nbsp;&amp;\n&lt;b&gt;  &#233;&notin;<br>c<b>d</b>e</p><pre>x\n y</pre></article>", "a & <b> é∉ cde\nx y"),
        (f"<article><script>var t='</p>';</script><style>p{{}}</style><!-- <p>no</p> --><p hidden>no</p><p style='display: none'>no</p><svg><text>no</text></svg><p>{LONG}</p></article>", LONG),
        ("<article><ul><li>one<li>two</ul><table><tr><td>1<td>2<tr><td>3</table></article>", "one\ntwo\n1\n2\n3"),
        (f'<article><p>{LONG}</p><p class="open>rest', LONG),
        ("<article>a < b </ b> <3 </article>", "a < b <3"),
        ("", ""),
        ("<nav>only a menu</nav>", ""),
        ("<p>Short.</p>", "Short."),
    ],
)
def test_pages(html, text):
    assert maintext.page_text(html, PRIOR) == text


def test_broken_and_deep_pages_take_linear_time():
    deep = "<div>" * 5_000 + f"<p>{LONG}</p>"
    assert maintext.page_text(deep, PRIOR) == LONG and max(len(b.path) for b in blocks.blocks(deep)) == blocks.DEEPEST
    for page in ("<" * 50_000, '<a "' * 20_000, "<!--" * 20_000, "<script>" * 20_000, "</ul></p>" * 20_000, "<a b= " * 20_000, "<p>" + ". " * 50_000):
        maintext.page_text(page, PRIOR)


def test_fit_follows_counts_and_rests_on_the_prior():
    content, boilerplate = np.zeros((2, len(maintext.GRID)))
    assert np.allclose(maintext.fit(content, boilerplate), PRIOR)
    cells = [maintext.cell(maintext.Block(t, (), tag, linked, "")) for t, tag, linked in ((LONG, "p", 0), ("Home", "li", 4))]
    content[cells[0]], boilerplate[cells[1]] = 10, 90
    odds = maintext.fit(content, boilerplate)
    assert odds[cells[0]] > PRIOR[cells[0]] and odds[cells[0]] - odds[cells[1]] > PRIOR[cells[0]] - PRIOR[cells[1]]
    assert np.allclose(odds, maintext.fit(content * 1_000, boilerplate * 1_000))  # alike at every size


def test_main_text_of_odd_rows(spark):
    page = f"<nav><ul><li><a>x</a></ul></nav><article><p>{LONG}</p></article>"
    rows = [(1, "u", page), (1, "u", page), (None, None, page), (2, "v", None), (3, "w", ""), (4, "x", f"<article><p>{LONG * 3_000}</p></article>")]
    table = spark.createDataFrame([(*r, "text", "n", 1) for r in rows], PAGE).repartition(3)
    got = sorted((tuple(r) for r in maintext.main_text(table).collect()), key=repr)
    want = [(p, u, t, len(t)) for p, u, t in [(1, "u", LONG), (1, "u", LONG), (None, None, LONG), (2, "v", ""), (3, "w", ""), (4, "x", LONG * 3_000)]]
    assert got == sorted(want, key=repr)
    counts = {r.cell: r for r in maintext.cell_counts(table).collect()}
    labelled = Counter((maintext.cell(b), b.says) for _, _, h in rows for b in blocks.blocks(h or ""))
    assert {(c, k) for c, r in counts.items() for k in ("content", "boilerplate") if r[k]} == {(c, "boilerplate" if s == "outer" else "content") for c, s in labelled}
    assert sum(r.content + r.boilerplate for r in counts.values()) == sum(labelled.values())
    assert maintext.main_text(table.limit(0)).collect() == []
