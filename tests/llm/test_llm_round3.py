"""Periodic runs, tokenizer alignment and exact top-k against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rosterline.llm import align, maxscore, queries, runs

ODD = "doc_id long, text string"


# --- periodic runs -----------------------------------------------------------------------------------------------


def plain_runs(words, factor=4, shortest=6):
    """Every run by its definition: each period, each maximal stretch, its smallest period checked."""
    n, out = len(words), []
    for q in range(1, n // factor + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            part = words[i:i + length]
            if length >= max(shortest, factor * q) and not any(part[d:] == part[:-d] for d in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out)


def random_words(rng):
    kind = rng.randrange(4)
    if kind == 0:
        return [rng.choice("ab") for _ in range(rng.randrange(40))]
    if kind == 1:
        return [rng.choice("abc") for _ in range(rng.randrange(60))]
    out = [rng.choice("abcdefgh") for _ in range(rng.randrange(12))]
    for _ in range(rng.randrange(1, 5)):
        unit = [rng.choice("abc") for _ in range(rng.randrange(1, 7))]
        out += unit * rng.randrange(1, 9) + unit[: rng.randrange(len(unit))]
        out += [rng.choice("abcdefgh") for _ in range(rng.randrange(6))]
    return out


@pytest.mark.parametrize("factor, shortest", [(4, 6), (2, 2), (2, 6), (3, 10)])
def test_runs_plain(factor, shortest):
    rng = random.Random(factor * 31 + shortest)
    for _ in range(400):
        words = random_words(rng)
        code = np.array([ord(w) - 97 for w in words], dtype=np.int64)
        assert runs.runs_of(code, factor, shortest) == plain_runs(words, factor, shortest), words


def test_suffixes_and_prefixes():
    rng = random.Random(5)
    for n in (1, 2, 3, 7, 60, 300):
        x = np.array([rng.randrange(2) for _ in range(n)], dtype=np.int64)
        order = runs.suffix_array(x)
        assert order.tolist() == sorted(range(n), key=lambda i: x[i:].tolist())
        want = [0] + [next((d for d in range(n) if max(i, j) + d >= n or x[i + d] != x[j + d]), n) for i, j in zip(order[1:], order[:-1])]
        assert runs.lcp_array(x, order).tolist() == want


def plain_row(doc_id, text):
    words = [w.decode() for w in queries.stretched(doc_id, (text or "").encode().split())] if doc_id is not None else (text or "").encode().decode().split()
    found = plain_runs(words)
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2])) if found else (None, None, None)
    inside = {i for s, n, q in found for i in range(s + q, s + n)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None,
            sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in inside)))


def as_tables(df, folder, name):
    df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_runs_query(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, " ".join(random_words(rng))) for i in range(300)]
    rows += [(400, None), (401, ""), (402, " \t\n\x0b\x0c\r "), (403, "x " * 50), (404, "a b " * 9 + "\x1c c"), (405, "x " * 5), (None, "y " * 9), (403, "x " * 50)]
    rows += [(500, " ".join(rng.choice("abc") for _ in range(3000)))]
    df = spark.createDataFrame(rows, ODD).selectExpr("*", "'z' AS kept", "1 AS runs").repartition(3)
    want = [plain_row(i, t) for i, t in rows]
    got = [tuple(r) for r in queries.op11_periodic_runs(spark, as_tables(df, tmp_path, "documents")).collect()]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert runs.find_runs(df.limit(0)).count() == 0


def test_runs_long_text(spark):
    """A hundred thousand words of one long period, and of one word."""
    unit = " ".join(f"w{i}" for i in range(5000))
    df = spark.createDataFrame([(1, " ".join([unit] * 20)), (2, "go " * 100_000)], ODD)
    got = {r["doc_id"]: r for r in runs.find_runs(df).collect()}
    assert [tuple(r) for r in got[1]["runs"]] == [(0, 100_000, 5000)] and got[1]["kept"].decode() == unit
    assert [tuple(r) for r in got[2]["runs"]] == [(0, 100_000, 1)] and got[2]["kept"] == b"go"


def test_runs_do_not_shuffle(spark, capsys):
    runs.find_runs(spark.createDataFrame([(1, "a")], ODD)).explain()
    assert "Exchange" not in capsys.readouterr().out


# --- alignment ---------------------------------------------------------------------------------------------------


def plain_alignment(rows):
    """The contract word by word, by the public tokenizers themselves."""
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    a_tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a_tok.encode_special_tokens = True
    b_tok = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    alphabet = {}
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    extra = 256
    for b in range(256):
        alphabet[chr(b) if b in printable else chr(extra)] = b
        extra += b not in printable
    docs, count = [], Counter()
    for doc_id, text in rows:
        a_ids, b_ids = [], []
        if text:
            a_ids, b_ids = a_tok.encode(" " + text, add_special_tokens=False).ids, b_tok.encode(text)
            a_bytes = [bytes(alphabet[c] for c in a_tok.id_to_token(i)) for i in a_ids]
            pieces = [b_tok.id_to_piece(i) for i in b_ids]
            b_bytes = [bytes([int(p[3:5], 16)]) if b_tok.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b_ids, pieces)]
            if not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
                a_ids, b_ids = [], []
        groups = []
        if a_ids:
            i = j = at = bt = 0
            left, right = [], []
            while i < len(a_ids) or j < len(b_ids):
                if at <= bt and i < len(a_ids):
                    left.append(a_ids[i])
                    at += len(a_bytes[i])
                    i += 1
                else:
                    right.append(b_ids[j])
                    bt += len(b_bytes[j])
                    j += 1
                if at == bt:
                    groups.append((left, right))
                    left, right = [], []
        pairs = Counter((a, b) for left, right in groups for a in left for b in right)
        count.update(pairs.keys())
        docs.append((doc_id, len(a_ids), len(b_ids), groups, pairs))
    best = {}
    for (a, _), n in count.items():
        best[a] = max(best.get(a, 0), n)
    out = []
    for doc_id, n_a, n_b, groups, pairs in docs:
        told = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((doc_id, n_a, n_b, len(groups), sum(pairs.values()), sum(m for p, m in pairs.items() if count[p] == best[p[0]]),
                    sum(m * count[p] for p, m in pairs.items()), hashlib.sha256(told.encode()).hexdigest() if told else ""))
    return out


def alignment_rows():
    rng = random.Random(11)
    vocabulary = [f"{a}{b}" for a in ("un", "re", "token", "Größe", "naïve", "x", "läuft ", "\n", "数据", "1234") for b in ("ization", "s", "7", "", "é", ".", "’s")]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 60)))) for i in range(120)]
    rows += [(200 + i, rows[3][1]) for i in range(90)]
    rows += [(300, None), (301, ""), (302, " "), (303, "  a  b\t\n"), (304, "<s> <|endoftext|> <0x41>"), (305, "a▁b"), (306, "ab\x00c"), (307, "é ﬁ"),
             (308, "abcdefghij" * 3000), (309, "数" * 2000), (None, "plain words"), (5, rows[5][1]), (310, " ".join(rng.choice(vocabulary) for _ in range(20_000)))]
    return rows


@pytest.mark.parametrize("head, links, row", [(1 << 20, 1 << 22, 1 << 16), (40, 300, 50), (0, 1 << 22, 1 << 16)])
def test_alignment(spark, tmp_path, monkeypatch, head, links, row):
    """With the counts of all pairs, of few and of none sent to the tasks, and with long texts cut into slices of pairs."""
    for name, value in (("HEAD", head), ("LINKS", links), ("ROW", row), ("SHARE", 5)):
        monkeypatch.setattr(align, name, value)
    rows = alignment_rows()
    df = spark.createDataFrame(rows, ODD).selectExpr("*", "'z' AS key", "1 AS copies", "2 AS salt", "3 AS n").repartition(3)
    got = queries.op12_tokenizer_alignment(spark, as_tables(df, tmp_path, "documents"))
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(got.columns) == sorted(columns)
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=key) == sorted(plain_alignment(rows), key=key)


def test_alignment_texts(spark):
    df = spark.createDataFrame([(1, "tokenization"), (2, None)], ODD)
    got = {r["doc_id"]: r for r in align.align(df, digest=False).collect()}
    assert got[1]["groups"].count("|") == got[1]["n_groups"] > 0 and got[2]["groups"] == ""
    assert align.align(df.limit(0)).count() == 0


# --- exact top k -------------------------------------------------------------------------------------------------


def plain_top(rows, every, k, scale=1024):
    import math

    vec = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(scale * x) for x in v)]
    out = set()
    for q in {i for i, _ in vec if i % every == 0}:
        best = {}
        for i, v in vec:
            if i != q:
                score = max(sum(a * b for a, b in zip(u, v)) for j, u in vec if j == q)
                best[i] = max(best.get(i, -(10**38 - 1)), min(max(score, -(10**38 - 1)), 10**38 - 1))
        for r, (i, s) in enumerate(sorted(best.items(), key=lambda t: (-t[1], t[0]))[:k], 1):
            out.add((q, r, i, min(max(s, -(2**63)), 2**63 - 1)))
    return out


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(maxscore, "SHARD", 50)
    monkeypatch.setattr(maxscore, "PILOT", 60)
    monkeypatch.setattr(maxscore, "TOGETHER", 7)
    monkeypatch.setattr(maxscore, "BLOCK_BYTES", 900)
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(12).tolist()) for i in range(500)]
    rows += [(1000 + i, rows[20][1]) for i in range(150)] + [(20, rows[21][1]), (30, rows[30][1])]
    rows += [(2000 + i, [float(x) if rng.random() < 0.2 else 0.0 for x in rng.integers(-3, 4, 12)]) for i in range(60)]
    rows += [(3000, None), (3010, [float("nan")] * 12), (3020, [None] + [1.0] * 11), (3030, []), (3040, [2.0, -1.0]), (3050, [0.0] * 12), (None, [9.0] * 12), (3060, [float("inf")] * 12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS rank", "'z' AS block").repartition(5)
    got = [tuple(r) for r in maxscore.top(df, every=10, k=7).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_top(rows, 10, 7)
    assert maxscore.top(df.limit(0)).count() == 0
    assert {tuple(r) for r in maxscore.top(df.filter("vec_id < 3"), every=1, k=10).collect()} == plain_top([r for r in rows if r[0] is not None and r[0] < 3], 1, 10)


def test_top_k_large_numbers(spark):
    """Sums that doubles or longs do not hold are still compared exactly."""
    rng = np.random.default_rng(6)
    rows = [(i, (rng.standard_normal(6) * 10.0 ** rng.integers(0, 9)).tolist()) for i in range(80)]
    rows += [(100, [1e300] * 6), (110, [-1e300] * 6), (120, [1.7e308] * 6), (130, [2.0**43 + 1.0] * 6), (140, [2.0**43] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = {tuple(r) for r in maxscore.top(df, every=10, k=5).collect()}
    assert got == plain_top(rows, 10, 5)


def test_maxscore_prunes():
    """Few rows are probed once the score to beat is known."""
    rng = np.random.default_rng(8)
    x = np.floor(1024 * rng.standard_normal((4000, 64)))
    q = np.floor(1024 * rng.standard_normal((5, 64)))
    score = x @ q.T
    beat = np.sort(score, axis=0)[-10]
    row, k, value = maxscore.competitive(x, q, beat)
    assert len(row) == 50 and (value == score[row, k]).all()


def test_top_k_query(spark, sf):
    from tools.compare import compare, connect

    text, _, ok = compare(spark, connect(sf), "op13_exact_top_k", queries.op13_exact_top_k, queries.ORACLES["op13_exact_top_k"], sf)
    assert ok, text
