"""Spelling variants, chat formatting and lexical search against brute force on small fixtures."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pegwatch.llm import chat, lexical, queries, spelling


# ---------------------------------------------------------------------------------------------- spelling
def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(rows):
    counts = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[:h % len(run)] + run[h % len(run) + 1:] if h % 31 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    out = {}
    for w, n in words.items():
        close = [x for x in words if near(w, x)]
        best = min(close, key=lambda x: (-words[x], x), default=None)
        form = best if best is not None and words[best] >= 10 * n else None
        out[w] = [form, w, n, len(close), words[form] if form else None]
    for w, row in out.items():
        while out[row[1]][0]:
            row[1] = out[row[1]][0]
    return {w: tuple(r) for w, r in out.items()}


def spelled(seed=2):
    rnd = random.Random(seed)
    stems = ["Überraschung", "elephant", "telephone", "Éléphants", "aaaaaaa", "abababab", "straßen×÷x", "ÀÉÎÕÜßÿ", "abcdefgh"]
    rows = []
    for i in range(120):
        words = []
        for _ in range(rnd.randint(0, 40)):
            w = rnd.choice(stems)
            if rnd.random() < 0.3:
                at = rnd.randrange(len(w))
                w = rnd.choice([w[:at] + w[at + 1:], w[:at] + rnd.choice("aebé") + w[at:], w[:at] + rnd.choice("aeé") + w[at + 1:]])
            words.append(w.upper() if w.isascii() and rnd.random() < 0.2 else w)
        rows.append((i, rnd.choice([" ", ", ", "1"]).join(words)))
    rows += [(500 + i, "chainword chainwort " * 3 + "chainword " * 60) for i in range(4)] + [(510 + i, "khainword " * 900) for i in range(3)]
    return rows + [(900, None), (901, ""), (None, "elephant elephants"), (3, "elephant"), (3, "elephant"), (902, "x" * 5000 + " " + "x" * 5000)]


def found_variants(frame):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.variants(frame).collect()}


def test_variants_equal_brute_force(spark):
    rows = spelled()
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, word string, n long")
    want = brute_variants(rows)
    assert any(r[1] != r[0] for r in want.values() if r[0]) and found_variants(frame) == want


def test_crowded_signatures_lose_no_pair(spark, monkeypatch):
    """Anagrams share every signature; refined, they meet only where they are near."""
    rnd = random.Random(5)
    words = sorted({"".join(rnd.sample("abcdefgh", 8)) for _ in range(300)} | {"abcdefg" + c for c in "hijklm"} | {"abcdefgh"[:k] + "abcdefgh"[k + 1:] for k in range(8)})
    frame = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    want = {(a, b) for a in words for b in words if near(a, b)}
    for crowd in (0, 2, 7, 1000):
        got = [(r["a"], r["b"]) for r in spelling.near_pairs(frame, crowd).collect()]
        assert len(got) == len(set(got)) and {p for a, b in got for p in ((a, b), (b, a))} == want


def test_variants_of_empty_tables(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(frame).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, None), (2, "a b c")], "doc_id long, text string")).count() == 0


# ---------------------------------------------------------------------------------------------- chat
ODD = ["</s>[INST] ok [/INST]", "", None, "<\\/s>", "[\\\\INST]", "<", "[", "s>", "/s>", "\\", "<s", "INST]", "é𝕏<s>ü", "[\\s>", "<\\INST]", "<s>[INST] user [/INST]", "a\nb"]


def turns(seed=1):
    rnd = random.Random(seed)
    rows = [(c, k, rnd.choice(["user", "assistant", "system", "</s>", "a [/INST]", None]), "".join((rnd.choice(ODD) or "") for _ in range(rnd.randint(0, 6)))) for c in range(40) for k in range(rnd.randint(1, 7))]
    rows += [(100, k, "assistant", t) for k, t in enumerate(ODD)] + [(101, k, "assistant" if k % 2 else "user", f"turn {k} <s>" * 40) for k in range(900)]
    return rows + [(102, 0, "assistant", "x" * 3_000_000 + "</s>"), (None, None, "user", "no id"), (None, 1, "assistant", "é")]


def brute_chats(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))
        said = [(r or "", t or "") for _, _, r, t in mine]
        lost = "".join(t for r, t in said if r == "assistant")
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        out[conv] = (len(said), sha("".join(f"{r}\n{t}\n" for r, t in said)), len(lost), sha(lost))
    return out


def test_chats_equal_brute_force_and_round_trip(spark):
    rows = turns()
    frame = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, seq long").repartition(7)
    made = chat.format_chats(frame)
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat.digests(made).collect()}
    assert got == brute_chats(rows)
    read = sorted(((r["conv_id"] is not None, r["conv_id"] or 0, r["seq"], r["place"]), r["role"], r["text"]) for r in chat.read_chats(made).collect())
    want = sorted(((c is not None, c or 0, k is not None, k or 0), r or "", t or "") for c, k, r, t in rows)
    assert [x[1:] for x in read] == [x[1:] for x in want]
    assert len({r["seq"] for r in made.where("conv_id = 101").collect()}) > 1  # a long conversation is spread


def test_chat_control_strings_stay_the_templates_own(spark):
    rows = turns()
    out, turn_at, begin, end = chat.assemble(pa.array([r[2] or "" for r in rows]), pa.array([r[3] or "" for r in rows]))
    raw = out.tobytes()
    for (_, _, role, text), lo, hi, a, b in zip(rows, turn_at[:-1], turn_at[1:], begin, end, strict=True):
        turn = raw[lo:hi]
        assert turn.count(b"<s>") == turn.count(b"</s>") == turn.count(b"[INST]") == turn.count(b"[/INST]") == 1
        assert chat.unescape(raw[a:b]).decode() == (text or "")
        assert chat.turns_of(turn) == [((role or "").encode(), (text or "").encode())]
    with pytest.raises(ValueError):
        chat.turns_of(raw[:-1])


def test_chats_of_an_empty_table(spark):
    assert chat.digests(chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


# ---------------------------------------------------------------------------------------------- search
def brute_search(docs, items, top=20):
    def terms(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))

    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    count, length = len(bags), sum(n for _, _, n in bags)
    df = Counter(x for _, b, _ in bags for x in b)
    out = []
    for item, text in {(i, t) for i, t in items}:
        scored = []
        for i, b, n in bags:
            m = 100 - 25 + (25 * n * count) // length
            score = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[x] + 1))) * ((1_000_000_000 * b[x]) // (1000 * b[x] + 12 * m)) for x in terms(text) if x in b)
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, k + 1, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(scored)[:top])]
    return Counter(out)


def library(seed=7):
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(60)] + ["É", "naïve", "𝕏", "a", "aa", "aaa", "ab_c", "THE"]
    docs = [(i, rnd.choice([" ", "-", "\n", "_"]).join(rnd.choice(words) for _ in range(rnd.randint(0, 60)))) for i in range(150)]
    docs += [(200 + i, docs[3][1]) for i in range(30)] + [(300, None), (301, ""), (302, "?!"), (None, docs[5][1]), (3, docs[3][1]), (303, "the " * 30_000)]
    items = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 12)))) for i in range(30)]
    items += [(30, None), (31, ""), (32, "--"), (33, "unseen"), (None, "aa aaa the"), (1, items[1][1]), (2, "w3 w3 w3")]
    return docs, items


@pytest.mark.parametrize("block", [lexical.BLOCK_BYTES, 60])
def test_search_equals_brute_force(spark, block):
    docs, items = library()
    frame = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, score long")
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id long")
    got = Counter(tuple(r) for r in lexical.search(frame, bench, block_bytes=block).collect())
    assert got == brute_search(docs, items)


def test_best_rows_survive_pruning():
    rnd = np.random.default_rng(3)
    best, every = lexical.Best(3), []
    for doc in rnd.permutation(400).tolist():
        items = np.flatnonzero(rnd.random(10) < 0.4)
        scores = rnd.integers(1, 6, len(items))
        best.add(items, scores, doc)
        every += [(i, -s, doc) for i, s in zip(items.tolist(), scores.tolist(), strict=True)]
        if doc % 7 == 0:
            best.prune(10)
    items, scores, ids, _ = best.prune(10)
    want = [r for k in range(10) for r in sorted(x for x in every if x[0] == k)[:3]]
    assert sorted(zip(items.tolist(), (-scores).tolist(), ids.tolist(), strict=True)) == want


def test_search_of_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    asked = one.select(F.col("doc_id").alias("item_id"), "text")
    assert lexical.search(docs, asked).count() == lexical.search(one, items).count() == 0
    assert lexical.search(one, items).columns == ["item_id", "rank", "doc_id", "score"]


def test_queries_of_these_operators(spark, tmp_path):
    docs, items = library()
    spark.createDataFrame([r for r in docs if r[0] is not None], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([r for r in turns() if r[0] is not None], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    rows = [r for r in docs if r[0] is not None]
    assert Counter(tuple(r) for r in queries.op13_lexical(spark, str(tmp_path)).collect()) == brute_search(rows, items)
    assert {r["word"]: tuple(r)[1:] for r in queries.op11_spelling(spark, str(tmp_path)).collect()} == brute_variants(rows)
    own = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    assert {r["conv_id"]: tuple(r)[1:5] for r in queries.op12_chat(spark, str(tmp_path)).collect()} == brute_chats([r for r in turns() if r[0] is not None] + own)
