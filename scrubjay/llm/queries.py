"""The queries that apply each operator to its whole table with production parameters."""

from __future__ import annotations

import string

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrubjay.llm import byte_bpe, decontaminate, language_id, lexical_search, matroska, merkle, packing, pii, simhash, token_counts, toxicity, url_filter, warc
from scrubjay.llm.common import bound_batches, id_mod, materialize, text_or_empty


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text as 8-bit samples of a Matroska file, read back from the file's packets."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.encode(text_or_empty(F.col("text")), "UTF-8").alias("data"))
    size = F.octet_length("data")
    unit = matroska.FRAME
    padding = F.greatest(F.ceil(size / F.lit(unit)) * unit, F.lit(unit)) - size
    padded = docs.select("doc_id", size.cast("long").alias("n_bytes"), F.concat("data", F.unhex(F.repeat(F.lit("ff"), padding.cast("int")))).alias("payload"))
    stored = matroska.store_pcm(padded, "payload", "media")
    back = stored.select("*", matroska.parse_with_track(F.col("media")).alias("file")).withColumn("payload", F.col("file.payload"))
    return back.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(
            ";",
            F.concat(F.lit("codec="), F.element_at("file.tracks", 1)["codec"]),
            F.concat(F.lit("packets="), F.size("file.packets")),
            F.concat(F.lit("cues="), F.size("file.cues")),
            F.concat(F.lit("duration_ms="), (F.col("file.duration_ns") / 1_000_000).cast("long")),
            F.concat(F.lit("last_packet_ms="), (F.element_at("file.packets", -1)["timestamp_ns"] / 1_000_000).cast("long")),
            F.concat(F.lit("clusters_cued="), matroska.clusters_cued(F.col("file"))),
            F.concat(F.lit("packet_table="), matroska.packet_digest(F.col("file"))),
        ).alias("feature"),
        F.col("file.error").alias("error"),
    )


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record per page written to archives in the shared folder, and all of them read back and verified."""
    pages = _table(spark, sf_dir, "pages")
    payload = F.encode(text_or_empty(F.col("html")), "UTF-8")
    archives = materialize(warc.write_archives(pages, "page_id", F.col("url"), payload, least_bytes=0), "archives")
    records = warc.read_archives(archives)
    return records.select(
        F.col("record_id").cast("long").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
        "digest_ok",
        "error",
    )


OP2_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS k FROM pages
), m AS (
  SELECT k, max(page_id) AS first FROM p GROUP BY k
), b AS (
  SELECT p.page_id, p.payload_bytes, unhex(p.k)::BIT::VARCHAR AS bits, m.first FROM p JOIN m USING (k)
)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
    16 * CAST(substr(bits, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INT) + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INT)
    + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INT) + CAST(substr(bits, 5 * i + 5, 1) AS INT) AS INT), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first IS NULL OR page_id = first THEN NULL ELSE first END AS refers_to,
  CASE WHEN first IS NULL OR page_id = first THEN true END AS digest_ok, CAST(NULL AS VARCHAR) AS error
FROM b
"""


def op3_token_counts(spark: SparkSession, sf_dir: str, limit: int = 4096) -> DataFrame:
    """Tokens of each text by the 32k piece model."""
    docs = _table(spark, sf_dir, "documents")
    counted = docs.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        token_counts.token_count(F.col("text"), public_tokenizers.path("piece_bpe_32k.model")).alias("n_tokens"),
    )
    return counted.select("*", (F.col("n_tokens") > limit).alias("over_limit"))


#: The rules of the URL query, as given.
URL_RULES = ("allow org/", "block example.org/es/", "block example.org/en/1", "allow com/fr/", "block com/de/")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's URL by the rules, or by naive Bayes where none fits."""
    return url_filter.judge(_table(spark, sf_dir, "pages"), [url_filter.parse_rule(x) for x in URL_RULES])


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in each text: base spans, and those that boosted trees add."""
    docs = _table(spark, sf_dir, "documents")
    model = pii.learn(docs)
    found = pii.find(docs.select("doc_id", "text"), model)
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(number, pii.KINDS), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.array_sort(F.concat("base", "added"))).alias("spans"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of each text by a machine learned from four fifths of the labelled rows."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    fold = id_mod(F.col("doc_id"), 5)
    machine = toxicity.learn(docs, labels.where(fold != 0))
    scored = docs.select("doc_id", F.coalesce(fold == 0, F.lit(True)).alias("held_out"), toxicity.score(F.col("text"), machine).alias("score"))
    return scored.select("*", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of each text by profiles learned from three quarters of the documents."""
    docs = _table(spark, sf_dir, "documents")
    fold = id_mod(F.col("doc_id"), 4)
    profiles = language_id.learn_profiles(docs.where(fold != 2))
    judged = docs.select("doc_id", F.coalesce(fold == 2, F.lit(True)).alias("held_out"), language_id.language(F.col("text"), profiles).alias("found"))
    return judged.select("doc_id", "held_out", "found.lang_pred", "found.score")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of each document."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text encoded by the 50k byte-level ranks, and decoded again."""
    docs = _table(spark, sf_dir, "documents")
    return bpe_digests(docs).drop("ids")


def bpe_digests(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``ids`` and digests of the ids and of what they decode to."""
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    coded = docs.select("doc_id", byte_bpe.round_trip(F.col("text"), *vocabulary).alias("coded")).select("doc_id", "coded.*")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("data", 256).alias("decoded_sha256"),
        "ids",
    )


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold a benchmark item, with the item and how much of it."""
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed with their neighbours into sequences of 1024 ids."""
    files = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    pieces = packing.pack(_table(spark, sf_dir, "documents"), files)
    return pieces.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of each benchmark item."""
    return lexical_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), held AS (
  SELECT row_number() OVER () AS k, doc_id, terms, len(terms) AS n FROM d WHERE len(terms) > 0
), total AS (
  SELECT count(*) AS nd, sum(n)::BIGINT AS l FROM held
), own AS (
  SELECT item_id, unnest(list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term FROM benchmark
), each AS (
  SELECT k, doc_id, n, unnest(terms) AS term FROM held
), tf AS (
  SELECT k, doc_id, n, term, count(*) AS tf FROM each WHERE term IN (SELECT term FROM own) GROUP BY ALL
), w AS (
  SELECT term, floor(1000 * ln((2.0::DOUBLE * any_value(nd) + 2) / (2.0::DOUBLE * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY term
), scores AS (
  SELECT item_id, k, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nd) // l))))::BIGINT AS score
  FROM own JOIN tf USING (term) JOIN w USING (term), total GROUP BY item_id, k, doc_id
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scores WHERE score > 0
)
SELECT * FROM ranked WHERE rank <= 50
"""


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest, proof and check of each document in a tree by language."""
    docs = _table(spark, sf_dir, "documents")
    columns = lambda text: [F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text]
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, merkle.leaf(columns(lowered)))
    rows = docs.select("doc_id", "lang", merkle.leaf(columns(F.col("text"))).alias("leaf"), tampered.alias("tampered"))
    return merkle.manifest(rows, "doc_id", "lang", "leaf", "tampered").withColumnRenamed("id", "doc_id")


def op13_sql(levels: int = 10, upper: int = 4) -> str:
    """The same trees level by level, for up to 8 ** levels rows a language and 8 ** upper languages."""
    crc = "list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))"
    value = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE concat(strlen({c}::VARCHAR), ':', {c}) END"
    leaf = lambda text: f"sha256(concat({', '.join(map(value, ('doc_id', 'source', 'lang', 'n_chars', text)))}))"
    lowered = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    run = "OVER (PARTITION BY g, i // 8 ORDER BY i ROWS BETWEEN"
    parts = [
        f"""d AS (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, xor({crc}, 4294967295) % 3 = 0 AS altered, {leaf("text")} AS leaf, {leaf(lowered)} AS changed FROM documents)""",
        "e AS (SELECT doc_id, g, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, leaf, CASE WHEN altered THEN changed ELSE leaf END AS now FROM d)",
        "l0 AS (SELECT g, i, leaf AS h, count(*) OVER (PARTITION BY g) AS n FROM e)",
    ]

    def climb(name: str, n: int) -> None:
        for k in range(n):
            parts.append(f"{name}{k}s AS (SELECT g, i, n, coalesce(string_agg(h, '') {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b, coalesce(string_agg(h, '') {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS a FROM {name}{k})")
            parts.append(f"{name}{k + 1} AS (SELECT g, i // 8 AS i, CASE WHEN n = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h, (n + 7) // 8 AS n FROM {name}{k} GROUP BY g, i // 8, n)")

    climb("l", levels)
    parts.append(f"t0 AS (SELECT 0 AS g, g AS i, h, count(*) OVER () AS n FROM l{levels})")
    climb("t", upper)
    parts.append("p0 AS (SELECT doc_id, g, i, leaf, now, '' AS proof FROM e)")
    fold = "CASE WHEN n = 1 THEN now ELSE sha256(concat(b, now, a)) END AS now, CASE WHEN n = 1 THEN proof ELSE concat(proof, b, a) END AS proof"
    for k in range(levels):
        parts.append(f"p{k + 1} AS (SELECT doc_id, p.g, i // 8 AS i, leaf, {fold} FROM p{k} p JOIN l{k}s s USING (g, i))")
    parts.append(f"q0 AS (SELECT doc_id, g AS i, g AS own, leaf, now, proof FROM p{levels})")
    for k in range(upper):
        parts.append(f"q{k + 1} AS (SELECT doc_id, i // 8 AS i, own, leaf, {fold} FROM q{k} JOIN t{k}s USING (i))")
    return f"WITH {', '.join(parts)} SELECT doc_id, leaf, s.h AS subroot, r.h AS root, sha256(proof) AS proof_sha256, now AS folded_root, now = r.h AS verified FROM q{upper} q JOIN l{levels} s ON s.g = q.own, t{upper} r"


_ALL = (op1_matroska, op2_warc, op3_token_counts, op4_url_filter, op5_pii, op6_toxicity, op7_language_id, op8_simhash, op9_byte_bpe, op10_decontaminate, op11_packing, op12_lexical_search, op13_merkle)


def queries() -> dict:
    """Each query by its name."""
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    """SQL for the query that SQL can express; the others are tested by brute force."""
    return {"op2_warc": OP2_SQL, "op12_lexical_search": OP12_SQL, "op13_merkle": op13_sql()}
