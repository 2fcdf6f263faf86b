"""Packing, ranked search and the Merkle manifest, against brute force, the tokenizer's library and SQL."""

from collections import Counter
import hashlib
import math
import random
import re
import zlib

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scrubjay.llm import lexical_search, merkle, packing, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
FILES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def table(spark, rows, schema, folder, name, parts=3):
    df = spark.createDataFrame(rows, schema).repartition(parts)
    df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return df


def by_sql(folder, tables, sql, names):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    return con.execute(f"select {', '.join(names)} from ({sql})").fetchall()


# --- packing ---


@pytest.fixture(scope="module")
def coder():
    return packing.Ids(*FILES)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILES[0])


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from(list("ab '<|>\t\n 1é日\u0085 ")), st.characters(codec="utf-8")), max_size=60) | st.lists(st.sampled_from(["<|endoftext|>", "the ", "don't", " " * 9, "word", "ééé", "\r\n"]), max_size=9).map("".join))
def test_ids_are_the_librarys(coder, library, text):
    assert coder.of(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_ids_of_long_runs(coder, library):
    for text in (" " * 300_000, "a" * 50_000 + "\n" * 6000, "x" + " " * 4999, "<|endoftext|>" * 3000):
        assert coder.of(text).tolist() == library.encode(text, add_special_tokens=False).ids
    assert coder.of(None).tolist() == coder.of("").tolist() == []


def check_pack(rows, docs, library, window):
    """Every id in one piece, sequences without gaps and without padding."""
    sequences, own = {}, {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append(r)
        own.setdefault(r.doc_id, []).append(r)
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += len(r.ids) // 4
        assert at <= window and at & (at - 1) == 0
    assert set(own) == set(docs)
    for doc, pieces in own.items():
        want = library.encode(docs[doc] or "", add_special_tokens=False).ids + [0]
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            ids = np.frombuffer(r.ids, "<u4").tolist()
            assert r.start == at and r.doc_tokens == len(want) and ids == want[at : at + len(ids)]
            at += len(ids)
        assert at == len(want)
    return sequences


def test_packing_keeps_every_id(spark, library):
    rng = random.Random(1)
    words = ["one", "zwei", "trois", "quatro", "fünf", "六", "<|endoftext|>"]
    docs = {i: " ".join(rng.choices(words, k=rng.choice((0, 1, 5, 40, 60, 400)))) for i in range(150)} | {1000: None, 1001: "", 1002: "a" * 5000}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").withColumn("chunk", F.lit("x")).repartition(3)
    for window, shard in ((64, 16), (1024, 1024), (1, 4)):
        rows = packing.pack(df.where("doc_id % 5 = 0") if window == 1 else df, FILES, window=window, shard=shard).collect()
        check_pack(rows, {k: v for k, v in docs.items() if window > 1 or k % 5 == 0}, library, window)
    assert packing.pack(df.limit(0), FILES).collect() == []


def test_packing_query(spark, tmp_path, library):
    docs = [(i, "some words of text " * (i * 7 % 300), "en", "s", 1) for i in range(60)]
    table(spark, docs, DOCS, tmp_path, "documents")
    rows = queries.op11_packing(spark, str(tmp_path)).collect()
    for r in rows:
        ids = library.encode(docs[r.doc_id][1], add_special_tokens=False).ids + [0]
        part = np.array(ids[r.start : r.start + r.length], "<u4").tobytes()
        assert r.ids_crc32 == zlib.crc32(part) and r.doc_tokens == len(ids)


def test_windows_take_like_texts(spark):
    rng = random.Random(2)
    topics = [[f"{a}{b}" for b in ("ing", "ed", "er", "est", "ness", "ful")] for a in ("walk", "paint", "cook", "read", "sail", "garden")]
    docs = [(i, " ".join(rng.choices(topics[i % 6], k=20))) for i in range(240)]
    rows = packing.pack(spark.createDataFrame(docs, "doc_id long, text string").repartition(2), FILES, window=128).collect()
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, set()).add(r.doc_id % 6)
    alone = sum(len(x) == 1 for x in sequences.values()) / len(sequences)
    assert alone > 0.7, alone


def test_bm25_scores():
    parts = [np.array(x, np.uint32) for x in ([1, 2, 2, 3], [2, 9], [7, 8, 9, 9, 9], [1])]
    index, mean = packing.Index(parts), 3.0
    df = Counter(t for x in parts for t in set(x.tolist()))
    for seed in range(4):
        want = []
        for x in parts:
            tf = Counter(x.tolist())
            idf = {t: math.log(1 + (4 - df[t] + 0.5) / (df[t] + 0.5)) for t in df}
            want.append(sum(idf[t] * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(x) / mean)) for t in set(parts[seed].tolist()) if tf[t]))
        assert np.allclose(index.scores(seed), want)


def test_last_window_is_cut_in_powers_of_two():
    got = list(packing.powers([(0, 5, 10), (1, 0, 3), (2, 0, 10)]))
    assert [sum(n for _, _, n in row) for row in got] == [16, 4, 2, 1]
    assert got[0] == [(0, 5, 10), (1, 0, 3), (2, 0, 3)] and got[1] == [(2, 3, 4)]


# --- search ---


def slow_search(docs, items, k):
    terms = lambda text: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    held = [(i, Counter(t)) for i, text in docs if (t := terms(text))]
    n_docs, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in held:
            m = 100 - 50 + (50 * sum(c.values()) * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if c[t])
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, rank, None if none else i, -score) for rank, (score, none, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("k, first", [(3, 5000), (3, 0), (50, 40), (1, 10)])
def test_search_equals_brute_force(spark, k, first):
    rng = random.Random(k)
    words = [f"w{i}" for i in range(300)]
    often = [1 / (i + 1) for i in range(300)]
    docs = [(i, " ".join(rng.choices(words, often, k=rng.choice((1, 5, 30, 300))))) for i in range(250)]
    docs += [(300 + i, "The SAME text, w250 w251!") for i in range(80)] + [(7, "w250"), (7, "w250"), (None, "w250 w251"), (900, None), (901, ""), (902, "!?"), (903, "Äö w299 ÉA")]
    items = [(i, " ".join(rng.choices(words, often, k=12))) for i in range(15)] + [(50, "w250 same"), (51, None), (52, ""), (53, "nowhere at all"), (54, "äö ÉA Äö"), (55, "w0"), (55, "w0")]
    got = lexical_search.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string"), k=k, first_postings=first)
    assert sorted(map(tuple, got.collect()), key=str) == slow_search(docs, items, k)


def test_search_prunes(spark):
    """Common words bring no candidates where rare ones have raised the threshold."""
    docs = [(i, "the of and " + (f"rare{i % 40} " * 2 if i < 400 else "")) for i in range(4000)]
    own = spark.createDataFrame([(1, "the of and rare3 rare4 rare5 rare6 rare7")], "item_id long, text string")
    wanted = lexical_search.item_terms(own, "item_id", "text").cache()
    index = lexical_search.build(spark.createDataFrame(docs, "doc_id long, text string"), wanted, "doc_id", "text", 10)
    terms = wanted.join(index.terms, "term").cache()
    least = lexical_search.thresholds(index, terms, 10, 5000)
    assert lexical_search.candidates(index, terms, least, 10).count() == 50
    stored = {r.term: (r.df, r.kth <= r.most) for r in index.terms.collect()}
    assert stored["the"] == (4000, True) and stored["rare3"] == (10, True)


def test_search_query_equals_sql(spark, tmp_path):
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choices(["The", "cat", "sat", "ON", "été", "x-1", "mat", "dog", "ran"], k=rng.randrange(30))), "en", "s", 1) for i in range(120)]
    table(spark, docs, DOCS, tmp_path, "documents")
    table(spark, [(1, "the cat"), (2, "été dog x"), (3, "")], "item_id long, text string", tmp_path, "benchmark")
    got = queries.op12_lexical_search(spark, str(tmp_path)).collect()
    want = by_sql(tmp_path, ["documents", "benchmark"], queries.OP12_SQL, ["item_id", "rank", "doc_id", "score"])
    assert sorted(map(tuple, got)) == sorted(want) and got


# --- manifest ---


def sha(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def slow_tree(leaves):
    """Root, and for each leaf its runs' (siblings before, siblings after)."""
    steps, at, nodes = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(nodes) > 1:
        for own, i in zip(steps, at, strict=True):
            start = i // 8 * 8
            own.append((nodes[start:i], nodes[i + 1 : start + 8]))
        nodes, at = [sha(nodes[i : i + 8]) for i in range(0, len(nodes), 8)], [i // 8 for i in at]
    return nodes[0], steps


def slow_manifest(rows):
    def leaf(r, lower=False):
        doc_id, text, lang, source, n_chars = r
        if lower and text is not None:
            text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        return sha("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text))

    by_lang = {}
    for r in rows:
        by_lang.setdefault(r[2], []).append(r)
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for lang in langs:
        own = sorted(by_lang[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees.append((own, *slow_tree([leaf(r) for r in own])))
    root, above = slow_tree([t[1] for t in trees])
    out = []
    for (own, subroot, steps), upper in zip(trees, above, strict=True):
        for r, mine in zip(own, steps, strict=True):
            path = mine + upper
            now = leaf(r, r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0)
            for before, after in path:
                now = sha([*before, now, *after])
            out.append((r[0], leaf(r), subroot, root, sha(x for b, a in path for x in b + a), now, now == root))
    return sorted(out, key=str)


def manifest_rows(n, langs, seed=0):
    rng = random.Random(seed)
    return [(i * 3, rng.choice(["Text", "text", None, "", "Ünï A"]), rng.choice(langs), rng.choice([None, "s"]), rng.choice([None, 4])) for i in range(n)]


@pytest.mark.parametrize("n, langs", [(1, ["en"]), (9, [None]), (700, ["en"]), (1500, ["en", "en", "en", None, "de", "Zz", "é"]), (60, [f"l{i}" for i in range(40)])])
def test_manifest_equals_brute_force(spark, tmp_path, n, langs):
    rows = manifest_rows(n, langs)
    rows += rows[:1] + [(None, "no id", langs[0], None, None), (rows[0][0], "another", langs[0], "x", 1)]
    table(spark, rows, DOCS, tmp_path, "documents")
    got = sorted(map(tuple, queries.op13_merkle(spark, str(tmp_path)).collect()), key=str)
    assert got == slow_manifest(rows)
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(by_sql(tmp_path, ["documents"], queries.op13_sql(), names), key=str) == got


def test_rounds_of_blocks(spark, monkeypatch):
    """More leaves than a block of blocks holds."""
    n = 3000
    rows = spark.range(n).select("id", F.lit("a").alias("g"), F.sha2(F.col("id").cast("string"), 256).alias("leaf"), F.when(F.col("id") == 17, F.sha2(F.lit("x"), 256)).alias("now")).repartition(5)
    leaves = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(n)]
    root, _ = slow_tree(leaves)
    got = merkle.manifest(rows, "id", "g", "leaf", "now").collect()
    assert len(got) == n and {r.root for r in got} == {r.subroot for r in got} == {root}
    assert [r.id for r in got if not r.verified] == [17]


def test_frontiers_meet_in_any_order():
    rng = random.Random(4)
    for size in (1, 7, 8, 9, 65, 512):
        leaves = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(size)]
        parts = [merkle.Frontier() for _ in range(5)]
        for i in rng.sample(range(size), size):
            part = rng.choice(parts)
            part.add(0, i, leaves[i], size)
            part.carried[i] = (i, None)
        rng.shuffle(parts)
        whole = parts[0]
        for other in parts[1:]:
            whole = whole.merge(other, size)
        levels = whole.levels()
        assert levels[0] == leaves and levels[-1] == [slow_tree(leaves)[0]] and len(whole.carried) == size
