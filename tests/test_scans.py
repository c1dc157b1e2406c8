"""Sequential scans against plain definitions on random texts."""

import random
import re

from pyspark.sql import functions as F

from rosterline.operators import entities, patterns, sections, tables

LINES = [
    "", "", "   ", "Provider: Dr. Ann Lee", "Provider 2: x", "Doctor: y", "NPI: 1234567890", "License: A12345", "TIN 12-3456789",
    "npi 1234567890 License B777", "Provider Name | NPI | TIN", "Name NPI TIN  x", "Ann Lee | 1234567890 | 5", "a\tB12345",
    "plain words", "please add", "terminate it", "update: now", "Name: Ann", "- NPI: 5", "Phone:", "Other: thing", "one  two", "a | b | c | d",
    "Provider | NPI", "tin\tnpi", "x\ty", "license  name",
]


def texts(n, seed, most=30):
    rnd = random.Random(seed)
    return ["\n".join(rnd.choice(LINES) for _ in range(rnd.randint(1, most))) for _ in range(n)]


# --- plain definitions -----------------------------------------------------

HARD = re.compile(r"\s*(provider(\s+name|\s+\d+)?|doctor|physician)\s*:", re.I)
SOFT = [re.compile(p, re.I) for p in (r"NPI[:\s]*\d{10}", r"License[:\s]*[A-Z]\d+", r"TIN[:\s]*\d{2}-?\d{7}")]
HEAD = re.compile(r"Provider.*Name.*NPI|Name.*NPI.*TIN|NPI.*Provider.*Specialty", re.I)
SCOPES = [("add", "add|new|include|enroll|join"), ("term", "term|terminate|remove|discontinue|end"),
          ("update", "update|change|modify|revise|correct|move")]


def block_end(t, s, reach):
    end = s
    for i in range(s + 1, min(len(t), s + reach + 1)):
        if t[i] == "":
            if i + 1 >= len(t) or t[i + 1] == "":
                break
        elif HARD.match(t[i]):
            break
        else:
            end = i
    return end


def plain_blocks(text, gap):
    lines = text.split("\n")
    t = [x.strip() for x in lines]
    found = []
    for i in range(len(t)):
        if HARD.match(t[i]):
            e = block_end(t, i, 10)
            found.append((i, 1, e, 0.9, "\n".join(lines[i:e + 1])))
    for h in range(len(t)):
        if HEAD.search(lines[h]):
            for i in range(h + 1, min(len(t), h + 20)):
                if re.search(r"\||\t|  ", t[i]) and re.search(r"\d{10}|[A-Z]\d{5}", t[i]):
                    found.append((i, 2, i, 0.8, t[i]))
    last = -1
    for i in range(len(t)):
        if i > last and SOFT[0].search(t[i]):
            score = sum(bool(p.search(x)) for x in t[max(0, i - 3):i + 4] for p in SOFT)
            if score >= 2:
                last = block_end(t, i, 5)
                found.append((i, 3, last, min(score * 0.2, 0.7), "\n".join(lines[i:last + 1])))
    found.sort(key=lambda b: b[:2])
    merged = []
    for s, _, e, conf, body in found:
        if merged and s <= merged[-1][1] + gap:
            m = merged[-1]
            merged[-1] = (m[0], max(m[1], e), max(m[2], conf), m[3] + "\n" + body)
        else:
            merged.append((s, e, conf, body))
    out = []
    for s, e, conf, body in merged:
        scope = None
        for i in range(s + 1):
            hit = [k for k, w in SCOPES if re.search(rf"\b(?:{w})\b", lines[i], re.I)]
            scope = hit[0] if hit else scope
        out.append((s, e, round(conf, 9), body, scope))
    return out


WORDS = "provider name npi tin specialty license organization phone fax address ppg date reason type lob group effective termination".split()


def split_row(line, sep):
    cells = re.split(r"\s{2,}", line) if sep == "gap" else line.split(sep)
    return [c.strip() for c in cells if c.strip()]


def separator(line):
    return "|" if "|" in line else "\t" if "\t" in line else "gap" if re.search(r"\s{2,}", line) else None


def is_row(line, sep):
    return bool(re.search(r"\s{2,}", line)) if sep == "gap" else sep in line


def label(line):
    name, _, value = line.partition(":")
    name = name.strip()
    name = name[1:].strip() if name.startswith("-") else name
    return name, value.strip(), any(w in name.lower() for w in WORDS)


def plain_tables(text):
    t = [x.strip() for x in text.split("\n")]
    out, i = [], 0
    while i < len(t):
        low = t[i].lower()
        words = sum(w in low for w in ("provider", "name", "npi", "tin", "specialty", "license"))
        if words >= 2 and re.search(r"\||\t|  ", t[i]):
            sep = separator(t[i])
            heads = split_row(t[i], sep)
            data, j = [], i + 1
            while j < len(t) and t[j] and is_row(t[j], sep):
                cells = split_row(t[j], sep)
                if 0 < len(cells) <= len(heads):
                    data.append(cells + [""] * (len(heads) - len(cells)))
                j += 1
            if data:
                out.append(("horizontal", i, heads, data))
                i += len(data) + 2
            else:
                i += 1
            continue
        ok = False
        if ":" in t[i] and label(t[i])[2]:
            for j in range(i + 1, min(i + 8, len(t))):
                if t[j] and ":" not in t[j]:
                    break
                if t[j] and label(t[j])[2]:
                    ok = True
        if ok:
            pairs, j = [], i
            while j < len(t):
                if t[j]:
                    if ":" not in t[j]:
                        break
                    name, value, known = label(t[j])
                    if name and value:
                        if not known:
                            break
                        pairs.append((name, value))
                j += 1
            if len(pairs) >= 2:
                out.append(("vertical", i, [p[0] for p in pairs], [[p[1] for p in pairs]]))
                i = j
                continue
        i += 1
    return out


def run(spark, items, expr):
    df = spark.createDataFrame(list(enumerate(items)), "i int, text string").select("i", F.expr(expr).alias("x"))
    return [r.x for r in df.orderBy("i").collect()]


def test_blocks_equal_plain_scan(spark):
    items = texts(400, 1)
    for gap in (2, 0):
        got = run(spark, items, sections.blocks("text", gap))
        for text, bs in zip(items, got):
            assert [(b.start_line, b.end_line, round(b.confidence, 9), b.text, b.transaction_type) for b in bs] == plain_blocks(text, gap), text


def test_text_tables_equal_plain_scan(spark):
    items = texts(600, 2)
    got = run(spark, items, tables.text_tables("text"))
    for text, ts in zip(items, got):
        assert [(t.kind, t.start, t.headers, t.rows) for t in ts] == plain_tables(text), text


def test_scans_cross_chunk_borders(spark):
    """More lines than one chunk of the scan holds."""
    items = ["\n".join(random.Random(s).choice(LINES) for _ in range(1500)) for s in range(3)]
    for text, bs in zip(items, run(spark, items, sections.blocks("text", 0))):
        assert [(b.start_line, b.end_line, round(b.confidence, 9), b.text, b.transaction_type) for b in bs] == plain_blocks(text, 0)
    for text, ts in zip(items, run(spark, items, tables.text_tables("text"))):
        assert [(t.kind, t.start, t.headers, t.rows) for t in ts] == plain_tables(text)


def test_positions_and_contexts(spark):
    items = ["é NPI: 1234567893 x\nNPI#1111111111NPI 2222222222 end", "none", "call provider id: 1234567890"] + texts(50, 3)
    got = run(spark, items, patterns.scan_with_positions("text", "npi"))
    for text, cs in zip(items, got):
        want = []
        for i, p in enumerate(patterns.NPI[:3]):
            for m in re.finditer(p, text, re.I):
                s = m.start()
                want.append((i, s, text[max(0, s - 20):s + 20].replace("\n", " ").strip()))
        assert [(c.pattern_ord, c.position, c.context) for c in cs if c.pattern_ord < 3] == want


def test_one_message_with_many_lines(spark):
    """A very long message stays near linear; quadratic scans would need minutes here."""
    n = 20000
    text = "\n".join(f"Provider {i}: Dr. Ann Lee | NPI: {1000000000 + i} | License: A{10000 + i}" for i in range(n))
    blocks = run(spark, [text], f"size({sections.blocks('text', 0)})")
    hits = run(spark, [text], f"size({patterns.scan_with_positions('text', 'npi')})")
    assert blocks == [n] and hits == [n]


def test_long_runs_do_not_overflow(spark):
    text = "Dr. " + "Ann Lee " * 20000 + "\n" + "word " * 20000
    assert run(spark, [text], f"size({entities.provider_names('text')})") == [1]
    assert run(spark, [text], f"size({entities.specialty_synonyms('text')})") == [0]
