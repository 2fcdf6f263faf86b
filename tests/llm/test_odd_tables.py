"""Every query on tables with nulls, empty and very long texts, repeated rows and clashing columns, and on empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scrubjay.llm import queries

CLASHING = ("payload", "media", "file", "payload_bytes", "n_tokens", "tokens", "host", "path", "rule", "odds", "decided", "base", "added", "spans", "score", "label", "found", "fp", "root", "component_id", "coded", "ids", "data", "digest", "first", "n", "refers_to", "held_out", "doc", "__scrubjay_fp", "row", "item", "term", "terms", "share", "w", "chunk", "signature", "start", "gid", "idx", "size", "leaf", "tampered", "id", "g", "a.b", "c`d")
LONG = "word " * 40_000 + "a@b.co " + "x" * 200_000
TEXTS = [None, "", " ", "the same words again", "the same words again", LONG, "1.2.3.4 und +49 (30) 1234567", "日本語 テキスト", "\x00\x01", "idiot"]
SCHEMAS = {
    "documents": ("doc_id long, text string, lang string, source string, n_chars long", [(i, t, "en" if i % 2 else None, None, None) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "en", "s", 1), (3, TEXTS[3], "en", "s", 1), (None, "no id at all here", "de", "s", 1), (None, None, None, None, None)]),
    "pages": ("page_id long, url string, html string", [(0, None, None), (1, "", ""), (2, "http://a.org/x", "<title>the bird</title>"), (2, "http://a.org/x", "<title>the bird</title>"), (None, "http://b.net/?q", "p"), (5, "https://thebird.example.com/de/1", LONG)]),
    "benchmark": ("item_id long, text string", [(1, "the same words again and more of it"), (None, None), (2, ""), (3, "word " * 50)]),
    "labels": ("doc_id long, quality int, toxic int", [(1, 1, 0), (3, 0, 0), (9, 0, 1), (9, 0, None), (None, 1, 1), (4, None, None)]),
}


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    odd, empty = tmp_path_factory.mktemp("odd"), tmp_path_factory.mktemp("empty")
    for name, (schema, rows) in SCHEMAS.items():
        df = spark.createDataFrame(rows, schema)
        for extra in (c for c in CLASHING if c not in df.columns):
            df = df.withColumn(extra, F.lit(7))
        df.write.parquet(f"{odd}/{name}.parquet")
        df.limit(0).write.parquet(f"{empty}/{name}.parquet")
    return {"odd": str(odd), "empty": str(empty)}


@pytest.mark.parametrize("name", [*queries.queries(), "pipeline"])
def test_query_on_odd_and_empty_tables(spark, folders, name):
    run = corpus_pipeline.run if name == "pipeline" else queries.queries()[name]
    got = run(spark, folders["odd"]).collect()
    assert run(spark, folders["empty"]).collect() == []
    n = len(SCHEMAS["pages" if name in ("op2_warc", "op4_url_filter") else "documents"][1])
    if name not in ("op10_decontaminate", "op11_packing", "op12_lexical_search", "pipeline"):
        assert len(got) == n  # one row for each of the table's
    if name == "pipeline":
        assert sorted((r.doc_id if r.doc_id is not None else -1) for r in got) == [-1, 3, 6, 7, 9]
    if name == "op10_decontaminate":
        assert {(r.doc_id, r.item_id) for r in got} == {(5, 3)}
    by_id = {}
    for r in got:
        by_id.setdefault(r[0], []).append(r[1:])
    if name not in ("op10_decontaminate", "op11_packing", "op12_lexical_search", "op13_merkle", "pipeline"):
        repeated = 2 if name in ("op2_warc", "op4_url_filter") else 3
        assert len(set(by_id[repeated])) == 1 < len(by_id[repeated])  # repeated rows are equal
    if name in ("op1_matroska", "op3_token_counts", "op5_pii", "op9_byte_bpe"):
        assert by_id[0] == by_id[1]  # null is taken for empty
    if name == "op1_matroska":
        assert by_id[0][0][:2] == (0, 576) and by_id[2][0][:2] == (1, 576)
    if name == "op2_warc":
        none = "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"  # of no bytes
        assert by_id[0][0][:2] == by_id[1][0][:2] == (0, none) and (by_id[0][0][2:4], by_id[1][0][2:4]) == (("revisit", 1), ("response", None))
        assert all(r.error is None and r.digest_ok is not False for r in got)
    if name == "op3_token_counts":
        assert by_id[0] == [(0, 0, False)] and by_id[5][0][2] and by_id[7][0][0] == len(TEXTS[7].encode())
    if name == "op4_url_filter":
        assert by_id[0][0][:3] == by_id[1][0][:3] == ("", "", None)
        assert by_id[2][0] == ("a.org", "/x", "org/", "allow") and by_id[5][0] == ("thebird.example.com", "/de/1", "com/de/", "block") and by_id[None][0][:3] == ("b.net", "/", None)
    if name == "op5_pii":
        assert by_id[0][0][:4] == (0, 0, 0, 0) and by_id[0][0][5] == "" and by_id[5][0][:4] == (1, 0, 0, 0)
        assert by_id[6][0][:4] == (0, 1, 0, 1) and by_id[6][0][5] == "ip:0:7,phone:12:28"
    if name == "op6_toxicity":
        assert by_id[0][0][1:] == by_id[1][0][1:] == by_id[2][0][1:] and all(0 <= r.score <= 1 for r in got) and {r.held_out for r in got if r.doc_id is None} == {True}
    if name == "op9_byte_bpe":
        assert by_id[0][0][0] == 0 and by_id[0][0][2] == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    if name == "op8_simhash":
        component = {(r.doc_id, r.component_id) for r in got}
        assert {(0, 0), (1, 0), (2, 0), (3, 3), (4, 3), (None, 0)} <= component
    if name == "op7_language_id":
        assert {r.lang_pred for r in got if r.doc_id in (0, 1, 2)} == {"und"}
    if name == "op11_packing":
        whole = sum(r.doc_tokens for r in got if r.start == 0)
        assert sum(r.length for r in got) == whole and sum(r.start == 0 for r in got) == n
        assert [x[:2] + x[3:4] for x in by_id[0] + by_id[1]] == [(0, 1, 1), (0, 1, 1)] and len(by_id[5]) > 39
    if name == "op12_lexical_search":
        of = lambda item: [(r.rank, r.doc_id) for r in got if r.item_id == item]
        assert sorted(of(1))[:4] == [(1, 3), (2, 3), (3, 3), (4, 4)] and of(None) == of(2) == [] and of(3) == [(1, 5)]
    if name == "op13_merkle":
        assert len({r.root for r in got}) == 1 and len({r.subroot for r in got}) == 3 and all(r.verified for r in got)
        assert len({r.leaf for r in got if r.doc_id == 3 and r.subroot}) == 2  # the same rows twice, each with a proof of its own
