"""Plain functions of the training-data operators against brute force."""

import gzip
import random

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rosterline.llm import ann, common, embed_dedup, html_extract, packing, sharding, simhash, toxicity, warc


@pytest.fixture(scope="module")
def enc():
    return common.encoder(None)


def test_encoder_equals_the_library(enc):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    texts = ["", " ", "a", "It's  two\n\n lines \t x", "naïve 東京 <|endoftext|> end", "tab\tx  y", "a  b c", "\x1c x\x85y  ", "don't we'll 123 4.5!?"]
    for text in texts:
        assert enc.ids(text) == t.encode(text, add_special_tokens=False).ids


def brute_cost(at, cost, width):
    f = [0.0]
    for j in range(1, len(at)):
        best = float("inf")
        for i in range(j):
            n = at[j] - at[i]
            if n <= width:
                best = min(best, f[i] + (0 if n & (n - 1) == 0 else width - n))
        f.append(best + cost[j] + packing.SEQUENCE)
    return f[-1]


def test_packing_is_optimal():
    rng = random.Random(1)
    for _ in range(60):
        gaps = [rng.randint(1, 9) for _ in range(rng.randint(1, 40))]
        at = np.cumsum([0, *gaps])
        cost = np.array([0.0, *[rng.choice([0.0, 3.0, 8.0]) for _ in gaps]])
        cuts = packing.best_cuts(at, cost, 16)
        ends, total = [0, *cuts.tolist()], 0.0
        for a, b in zip(ends, ends[1:]):
            assert 0 < b - a <= 16
            total += (0 if (b - a) & (b - a - 1) == 0 else 16 - (b - a)) + cost[np.searchsorted(at, b)] + packing.SEQUENCE
        assert ends[-1] == at[-1] and total == pytest.approx(brute_cost(at.tolist(), cost, 16))


@given(st.lists(st.integers(0, 50), min_size=1, max_size=12), st.integers(1, 5))
@settings(max_examples=80, deadline=None)
def test_smallest_capacity(sizes, shards):
    capacity = sharding.smallest_capacity(sizes, shards)
    assert sharding.feasible(sizes, capacity, shards)
    assert not capacity or not sharding.feasible(sizes, capacity - 1, shards)
    of = sharding.cut(sizes, shards)
    assert of == sorted(of) and max(of) < shards
    assert all(sum(s for s, o in zip(sizes, of) if o == k) <= capacity for k in range(shards))


def test_fingerprint():
    def plain(text, k=3):
        words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).encode().split()
        shingles = [b" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    for text in ["", " \n", "One", "one two", "A b C d É é", "x " * 70000, "a b c\x1cd e f", "le le le le le"]:
        assert simhash.fingerprint(text) & (2**64 - 1) == plain(text)
    assert simhash.fingerprint(None) == 0


def test_tree_search_and_masks():
    rng = random.Random(2)
    values = list({rng.getrandbits(12) for _ in range(300)})
    root = simhash.Node(values[0], 0)
    for row, v in enumerate(values[1:], 1):
        simhash.insert(root, v, row)
    for q in [rng.getrandbits(12) for _ in range(50)]:
        for radius in (0, 1, 2, 5):
            want = {r for r, v in enumerate(values) if (v ^ q).bit_count() <= radius}
            assert {r for _, r in simhash.search(root, q, radius)} == want
    for n in (0, 1, 1024, 1025, 230_000, 10**9, 10**12):
        masks = simhash.exact_masks(n, 2)
        assert len(masks) <= 3
        for _ in range(500):
            a = rng.getrandbits(64)
            b = a ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))
            assert any(a & m == b & m for m in masks)


def test_shard_trees_prune():
    """Shards hold about as many values at every n, and a search compares few nodes of its tree."""
    rng = random.Random(8)
    for n in (3_000, 50_000):
        values = [rng.getrandbits(64) for _ in range(n)]
        visited = of = 0
        for mask in simhash.exact_masks(n, 2):
            shards = {}
            for row, v in enumerate(values):
                shards.setdefault(v & mask, []).append((row, v))
            assert 256 < min(map(len, shards.values())) and max(map(len, shards.values())) < simhash.BLOCK
            part = shards[min(shards)]
            root = simhash.Node(part[0][1], part[0][0])
            for row, v in part[1:]:
                simhash.insert(root, v, row)
            for row, v in part[:100]:
                visited += sum(1 for _ in simhash.visits(root, v, 2))
                of += len(part)
                assert (0, row) in simhash.search(root, v, 2)
        assert visited < 0.1 * of


def test_local_roots():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 200, 120), rng.integers(0, 200, 120)
    root = list(range(200))
    for _ in range(200):
        for x, y in zip(a, b):
            root[x] = root[y] = min(root[x], root[y])
    assert common.local_roots(200, a, b).tolist() == root


def test_link_cell_counts_each_pair_once():
    rng = np.random.default_rng(4)
    base = rng.standard_normal((6, 16))
    x = embed_dedup.unit([(v + rng.normal(0, 0.2, 16)).astype("<f4").tobytes() for v in base for _ in range(5)])
    planes = embed_dedup.hyperplanes(16, 8, 4, 1)
    sig = embed_dedup.signatures(x, planes)
    links = np.zeros(30, dtype=int)
    for t in range(8):
        for s in set(sig[:, t].tolist()):
            rows = np.flatnonzero(sig[:, t] == s)
            found = embed_dedup.link_cell(rows, np.ones(len(rows), dtype=np.int64), np.zeros(len(rows)), x[rows], t, planes, 0.9, 0, 0)
            if found:
                links[found[0]] += found[1]
    shared = (sig[:, None, :] == sig[None, :, :]).any(2)
    assert links.tolist() == (((x @ x.T >= 0.9) & shared).sum(1) - 1).tolist()


def test_tree_visits_leaves_in_order():
    rng = np.random.default_rng(5)
    points = rng.standard_normal((700, 4))
    tree = ann.Tree(points, 16)
    assert sorted(np.concatenate(tree.members).tolist()) == list(range(700))
    leaf = tree.leaves(points)
    q = rng.standard_normal(4)
    gaps = list(tree.nearest_first(q))
    assert [g for g, _ in gaps] == sorted(g for g, _ in gaps)
    for gap, number in gaps:
        rows = tree.members[number]
        assert set(leaf[rows]) <= {number}
        assert ((points[rows] - q) ** 2).sum(1).min() >= gap - 1e-9
    assert ann.chi_square_quantile(8, 0.95) == pytest.approx(15.507, abs=1e-3)


def test_warc_records():
    bodies = [b"", b"a\r\n\r\nWARC/1.1\r\nb", "é".encode() * 700_000]
    raw = b"".join(b"WARC/1.1\r\nWARC-Type: resource\r\nX: y\r\nContent-Length: %d\r\n\r\n%b\r\n\r\n" % (len(b), b) for b in bodies)
    for content in (raw, gzip.compress(raw), gzip.compress(raw[:500]) + gzip.compress(raw[500:])):
        assert [b for _, b in warc.split_records(warc.inflate(memoryview(content), 1000))] == bodies
    with pytest.raises(ValueError):
        list(warc.split_records(iter([raw[:-900]])))


def text_of(page, region=None, fixed=()):
    return html_extract.main_text(html_extract.read_page(page)[0], region, set(fixed), hash)


@pytest.mark.parametrize("page, want", [
    (None, ""), ("", ""), ("plain &amp; text", "plain & text"), ("a < b", "a < b"),
    ("<article><h1>T</h1><p><b>One.<br><p>Two&nbsp; 2.</p></article><footer>f</footer>", "T\nOne.\nTwo 2."),
    ("<nav><ul><li><a href=x>m</a></ul></nav><main><p>x<!-- <p>no</p> -->y</p><div class='share-bar'>s</div></main>", "xy"),
    ("<div class=\"ad\">buy<div>this</div></div><p>keep</p><form><p>name</p></form>", "keep"),
    ("<body><p>one<script>var t=\"</p>\";</script> two<style>p{}</style></p><aside>x</aside>", "one two"),
    ("<article><p>a</p><section class='comments'><p>no</p></section><p>b</p></article>", "a\nb"),
    ("<article><ul><li>a<li>b</ul><table><tr><td>1<td>2</table></article>", "a\nb\n1\n2"),
    ("<p title='a>b'>x</p><p title=\"unclosed>y</p>", "x\ny"),
    ("<div id=cookie-notice>ok?</div><div hidden>h</div><div style='display: none'>h</div><p>t</p>", "t"),
    ("<p>unclosed <i>tags <p>next", "unclosed tags\nnext"),
    ("<p title=\"a hidden gem\">text one</p><p data-x=hidden>two</p><p class=x HIDDEN>three</p>", "text one\ntwo"),
    ("<p>the sum <math><mi>x</mi><mo>+</mo><mn>1</mn></math> end</p>", "the sum x+1 end"),
    ("<article><section id=\"search-algorithms\"><p>a</p></section><div class=\"related work\"><p>b</p></div></article>", "a\nb"),
    ("<article><div class='ad box'>buy</div><p>a</p><div class=share-bar>s</div><div id=comments>c</div></article>", "a"),
])
def test_main_text(page, want):
    assert text_of(page) == want


def test_host_slot_and_template_text():
    page = "<div class=top>Site name</div><div class=body><p>story</p></div><div class=end>All rights</div>"
    assert text_of(page) == "Site name\nstory\nAll rights"
    assert text_of(page, region=">div.body") == "story"
    assert text_of(page, fixed={hash("Site name"), hash("All rights")}) == "story"


def test_chain_learns_from_earlier_categories():
    rng = np.random.default_rng(6)
    n = 400
    first = rng.random(n) < 0.4
    second = first & (rng.random(n) < 0.9)
    rows = [np.array([0] if f else [1], dtype=np.int64) for f in first]
    models, held = toxicity.train_chain(rows, np.column_stack([first, second]), np.arange(n) % toxicity.FOLDS, 2)
    assert held.shape == (n, 2) and (held[first, 1].mean() > 0 > held[~first, 1].mean())
    assert models[1][1][0] > 0  # the second model weighs the first category
    one = toxicity.fit(rows, np.zeros((n, 0)), np.zeros(n), 2)
    assert not one[0].any() and one[2] < -5
