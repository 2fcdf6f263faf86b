"""Media, tokens and languages: round trips, and the libraries as brute force."""

import random

import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scrubjay.llm import byte_bpe, language_id, matroska, queries, token_counts

ODD = [None, "", " ", "  ", "a", " a  b ", "a\tb\nc\r\n", "▁▁a ▁", "ﬁ é é 　x", "​ x\x00y", "<s>x</s> <|endoftext|>", "x" * 5000, "the " * 3000, "  " * 400 + "end", "1.2.3 日本語 テキスト 😀😀", "don't we'll I'm", "ab" * 3000]


def documents(spark, texts, **more):
    rows = [(i, t, "en", "s", 0, 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, ids int")


# --- Matroska ---


@given(st.binary(max_size=6000), st.sampled_from(matroska.LACINGS))
@settings(max_examples=60, deadline=None)
def test_pcm_round_trip(payload, lacing):
    if lacing == "fixed":
        payload += b"\xff" * (-len(payload) % matroska.FRAME)
    data = matroska.write_pcm(payload, lacing)
    found = matroska.read_file(data)
    assert found["error"] is None and found["doc_type"] == "matroska"
    assert b"".join(data[p[2] : p[2] + p[3]] for p in found["packets"]) == payload
    assert [p[1] for p in found["packets"]] == [72_000_000 * i for i in range(len(found["packets"]))]
    clusters = sorted({p[6] for p in found["packets"]})
    assert [c[2] for c in found["cues"]] == clusters


def test_laces_groups_and_unknown_sizes():
    frames = [b"a" * 300, b"b" * 7, b"c" * 700, b"d"]
    blocks = []
    for lacing in ("xiph", "ebml"):
        blocks.append(matroska.element(matroska.SIMPLE_BLOCK, matroska.block_data(2, -5, frames, lacing)))
    group = matroska.element(matroska.BLOCK, matroska.block_data(1, 3, [b"e" * 9], "none", 0)) + matroska.element(matroska.REFERENCE_BLOCK, b"\xff")
    body = matroska.element(matroska.TIMESTAMP, b"\x64") + b"".join(blocks) + matroska.element(matroska.BLOCK_GROUP, group)
    unknown = b"\x01" + b"\xff" * 7
    cluster = matroska.CLUSTER.to_bytes(4) + unknown + body
    head = matroska.element(matroska.EBML, matroska.element(matroska.DOC_TYPE, b"webm"))
    data = head + matroska.SEGMENT.to_bytes(4) + unknown + cluster + cluster
    found = matroska.read_file(data)
    assert found["error"] is None and found["doc_type"] == "webm"
    assert [data[p[2] : p[2] + p[3]] for p in found["packets"]] == (frames * 2 + [b"e" * 9]) * 2
    assert [p[1] for p in found["packets"][:9]] == [95_000_000] * 8 + [103_000_000]
    assert [p[4] for p in found["packets"][:9]] == [True] * 8 + [False]
    assert len({p[6] for p in found["packets"]}) == 2


def test_damaged_files_give_an_error():
    data = matroska.write_pcm(bytes(range(256)) * 9)
    whole = matroska.read_file(data)["packets"]
    for cut in range(0, len(data), 97):
        found = matroska.read_file(data[:cut])
        assert found["error"] and found["packets"] == whole[: len(found["packets"])]
    assert matroska.read_file(b"no file at all")["error"]


def test_packet_table_and_query(spark, tmp_path):
    rows = [(1, matroska.write_pcm(b"x" * 1000)), (2, None), (3, b"junk"), (4, matroska.write_pcm(b""))]
    files = spark.createDataFrame(rows, "id long, media binary").withColumn("track", F.lit("clash"))
    table = matroska.packet_table(files, "id", "media").orderBy("id", "packet_no").collect()
    assert [(r.id, r.packet_no, r.size) for r in table] == [(1, 0, 576), (1, 1, 424), (2, None, None), (3, None, None), (4, None, None)]
    assert [bool(r.error) for r in table] == [False, False, False, True, False]
    cues = matroska.cue_table(files.union(spark.createDataFrame([(9, matroska.write_pcm(b"y" * 2_000_000), "x")], files.schema)), "id", "media").collect()
    assert all(r.n_packets > 0 for r in cues) and sum(r.id == 9 for r in cues) > 1
    both = files.select("id", matroska.parse_with_track(F.col("media")).alias("f")).orderBy("id").collect()
    assert [r.f and bytes(r.f.payload) for r in both] == [b"x" * 1000, None, b"", b""] and both[2].f.error
    documents(spark, [*ODD, *ODD]).write.parquet(str(tmp_path / "documents.parquet"))
    import hashlib
    import zlib

    got = {r.doc_id: r for r in queries.op1_matroska(spark, str(tmp_path)).collect()}
    assert {r.error for r in got.values()} == {None}
    assert len(got) == 2 * len(ODD)
    for i, text in enumerate([*ODD, *ODD]):
        data = (text or "").encode()
        payload = data + b"\xff" * (max(576, -(-len(data) // 576) * 576) - len(data))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-32:])
        assert r.media_sha256 == hashlib.sha256(matroska.write_pcm(payload)).hexdigest()
        packets = matroska.read_file(matroska.write_pcm(payload))["packets"]
        joined = ",".join(f"{track}:{when}:{at}:{size}" for track, when, at, size, *_ in packets)
        assert r.feature.endswith(f"clusters_cued={len({p[6] for p in packets})};packet_table={hashlib.sha1(joined.encode()).hexdigest()}")


# --- tokens ---


def library(name):
    if name == "piece":
        model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
        return lambda t: len(model.encode(t))
    ranks = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def mixed(rng):
    return "".join(rng.choice(["the", " ", "  ", "in", "ß", "\n", "日", "x9", ".", "▁", "'s", "ation", "Z", "\t", "é", "00"]) for _ in range(rng.randrange(60)))


def test_piece_counts_equal_the_library(spark):
    rng = random.Random(1)
    texts = [*ODD, *(mixed(rng) for _ in range(400))]
    count = library("piece")
    got = documents(spark, texts).select("doc_id", token_counts.token_count(F.col("text"), public_tokenizers.path("piece_bpe_32k.model"), cache_size=32_100).alias("n")).collect()
    assert {r.doc_id: r.n for r in got} == {i: count(t or "") for i, t in enumerate(texts)}


def test_models_are_judged_by_their_description():
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    token_counts.check_model(model)
    data = model.serialized_model_proto()

    class Changed:
        def __init__(self, extra):
            self.extra = extra

        def __getattr__(self, name):
            return getattr(model, name)

        def serialized_model_proto(self):
            return self.extra + data if self.extra[:1] == b"\x1a" else data + self.extra

    for extra in (b"\x1a\x02\x20\x01", b"\x1a\x03\x12\x01x", b"\x0a\x05\x0a\x01x\x18\x04"):
        with pytest.raises(ValueError):
            token_counts.check_model(Changed(extra))


def test_whole_tokens_are_proved():
    counter = token_counts.TokenCounter(public_tokenizers.path("piece_bpe_32k.model"))
    assert 10_000 < len(counter.whole) < 32_000
    assert all(len(counter.model.encode(w)) == 1 for w in list(counter.whole)[::50])


@pytest.fixture(scope="module")
def coder():
    return byte_bpe._coder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def test_bpe_equals_the_library(spark, coder, tmp_path):
    rng = random.Random(2)
    texts = [*ODD, *(mixed(rng) for _ in range(400))]
    encode = library("bytes")
    assert [coder.encode(t or "").tolist() for t in texts] == [encode(t or "") for t in texts]
    docs = documents(spark, texts)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.bpe_digests(docs).collect()}
    import hashlib

    for i, t in enumerate(texts):
        assert got[i].ids == encode(t or "") and got[i].n_tokens == len(got[i].ids)
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, got[i].ids)).encode()).hexdigest()
    assert queries.op9_byte_bpe(spark, str(tmp_path)).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


@given(st.text(max_size=60))
@settings(max_examples=200, deadline=None)
def test_bpe_equals_the_library_on_any_text(coder, text):
    assert coder.encode(text).tolist() == library_bytes()(text)
    assert coder.decode(coder.encode(text)) == text.encode()


def library_bytes(kept=[]):  # noqa: B006
    if not kept:
        kept.append(library("bytes"))
    return kept[0]


def test_bpe_every_token_is_found(coder):
    tokens = [t for t in list(coder.ranks)[::7]]
    encode = library_bytes()
    for token in tokens:
        try:
            text = token.decode()
        except UnicodeDecodeError:
            continue
        assert coder.encode(text).tolist() == encode(text)


# --- language ---


def slow_profile(texts, size):
    from collections import Counter

    grams = Counter()
    for text in texts:
        line = [1]
        for c in text.lower():
            if c.isalpha():
                line.append(ord(c))
            elif line[-1] != 1:
                line.append(1)
        if line[-1] != 1:
            line.append(1)
        if len(line) == 1:
            continue
        for n in (1, 2, 3):
            for i in range(len(line) - n + 1):
                g = line[i : i + n]
                if g == [1] or (n == 3 and g[1] == 1):
                    continue
                grams[sum(x << 21 * (n - 1 - k) for k, x in enumerate(g))] += 1
    return [g for g, _ in sorted(grams.items(), key=lambda x: (-x[1], x[0]))[:size]]


def test_language_equals_brute_force(spark):
    rows = [("the cat and the dog, the end", "en"), ("der hund und die katze", "de"), ("le chat et le chien l'été", "fr"), (None, "en"), ("12", "fr"), ("nothing here", None), ("the cat and the dog, the end", "en")]
    learn = spark.createDataFrame(rows, "text string, lang string").withColumn("n", F.lit(3))
    profiles = language_id.learn_profiles(learn, profile_size=40)
    for lang in ("en", "de", "fr"):
        assert profiles[lang].tolist() == slow_profile([t for t, k in rows if k == lang and t], 40)
    texts = [*ODD, "und der", "le été", "the", "ÉTÉ"]
    got = documents(spark, texts).select("doc_id", language_id.language(F.col("text"), profiles, 40).alias("r")).select("doc_id", "r.*").collect()
    for r in got:
        own = slow_profile([texts[r.doc_id] or ""], 40)
        if not own:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        far = {}
        for lang in sorted(profiles):
            ranks = {g: i for i, g in enumerate(profiles[lang].tolist())}
            far[lang] = sum(abs(ranks[g] - i) if g in ranks else 40 for i, g in enumerate(own))
        best = min(far, key=lambda k: (far[k], k))
        assert r.lang_pred == best and abs(r.score - (1 - far[best] / (40 * len(own)))) < 1e-12
    with pytest.raises(ValueError):
        language_id.learn_profiles(learn, max_languages=2)


def test_language_query(spark, tmp_path):
    held = [r for r in queries.op7_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").collect() if r.held_out]
    assert len(held) > 200 and sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held)
    documents(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    assert queries.op7_language_id(spark, str(tmp_path)).collect() == []
    none = documents(spark, ["a", None]).withColumn("lang", F.lit(None).cast("string"))
    none.write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert {r.lang_pred for r in queries.op7_language_id(spark, str(tmp_path)).collect()} == {"und"}
