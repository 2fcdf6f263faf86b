"""Archives, URLs, personal data, toxicity, near duplicates, benchmarks and the pipeline, against brute force."""

import gzip
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scrubjay.llm import decontaminate, pii, queries, simhash, toxicity, url_filter, warc
from scrubjay.llm.common import id_mod, join_hot

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows, schema, folder, name):
    df = spark.createDataFrame(rows, schema).withColumn("fp", F.lit("clash")).withColumn("root", F.lit(1))
    df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return df


# --- WARC ---


def test_warc_query_equals_sql(spark, tmp_path):
    html = ["<p>a</p>", "", None, "ü" * 70_000, "x\r\n\r\ny", "<p>a</p>"]
    rows = [(i, f"http://h/{i}\r\nX: y", html[i % len(html)]) for i in range(40)] + [(41, None, None), (None, "u", "only"), (50, "a", "tie"), (50, "b", "tie")]
    table(spark, rows, "page_id long, url string, html string", tmp_path, "pages")
    got = [tuple(r) for r in queries.op2_warc(spark, str(tmp_path)).fillna(-1).collect()]
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    names = "page_id, payload_bytes, payload_digest, record_type, refers_to, digest_ok, error"
    want = con.execute(f"select {names} from ({queries.OP2_SQL})").fetchall()
    assert sorted(got, key=str) == sorted((tuple(-1 if x is None and k < 5 else x for k, x in enumerate(r)) for r in want), key=str)
    assert {r[3] for r in got if r[0] == 50} == {"response"}


def test_warc_reader(spark):
    rng = random.Random(3)
    payloads = [b"", b"x", bytes(rng.randrange(256) for _ in range(300_000)), b"a" * 5_000_000]
    data = b"".join(warc.record(str(i), f"http://h/{i}", p) for i, p in enumerate(payloads)) + warc.record("9", "u", b"x", refers_to="1")
    found = list(warc.read_archive(data, keep_payload=True))
    assert [f.get("payload") for f in found] == [*payloads, None] and not any(f.get("error") for f in found)
    assert [f.get("digest_ok") for f in found] == [True] * 4 + [None] and found[4]["refers_to"] == "1"
    assert sum(f["length"] for f in found) == len(data) and found[4]["payload_bytes"] == 1
    text = gzip.decompress(data[: found[0]["length"]]).decode()
    assert text.startswith("WARC/1.1\r\nWARC-Type: response\r\n") and text.endswith("\r\n\r\n\r\n\r\n")
    bad = gzip.compress(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n")
    wrong = gzip.compress(b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Payload-Digest: sha1:AAAA\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n")
    none = gzip.compress(b"hello\r\n\r\n")
    odd = list(warc.read_archive(bad + wrong + none + data[:200]))
    assert [bool(f.get("error")) for f in odd] == [True, False, True, True] and odd[1]["digest_ok"] is False
    assert list(warc.read_archive(b"")) == [] and next(iter(warc.read_archive(b"junk")))["error"]
    rows = spark.createDataFrame([("a", data), ("b", None), ("c", b"")], "archive string, data binary")
    assert [(r.archive, r.payload_bytes) for r in warc.read_archives(rows).collect()] == [("a", len(p)) for p in payloads] + [("a", 1)]


def test_warc_files(spark, tmp_path):
    payloads = [b"hello", b"", bytes(range(256)) * 9000]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.warc.gz").write_bytes(b"".join(warc.record(str(i), "u", p) for i, p in enumerate(payloads)))
    (tmp_path / "in" / "b.warc.gz").write_bytes(warc.record("9", "u", b"tail")[:-20])
    got = warc.read_files(spark, str(tmp_path / "in"), keep_payload=True).orderBy("archive", "offset").collect()
    assert [r.payload for r in got[:3]] == payloads and all(r.digest_ok for r in got[:3]) and got[3].error
    assert warc.read_files(spark, str(tmp_path / "in"), opener=lambda path: open(path.removeprefix("file:"), "rb")).count() == 4


def test_warc_is_read_in_pieces():
    """However large an archive is, only a piece of it is asked for at a time, and heads are bounded."""
    data = b"".join(warc.record(str(i), "u", random.Random(i).randbytes(400_000)) for i in range(5))
    asked = []

    class Source:
        at = 0

        def read(self, n):
            asked.append(n)
            self.at += n
            return data[self.at - n : self.at]

    found = list(warc.read_stream(Source().read))
    assert [f["payload_bytes"] for f in found] == [400_000] * 5 and all(f["digest_ok"] for f in found)
    assert max(asked) <= 1 << 16 and sum(f["length"] for f in found) == len(data)
    head = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Type: application/http\r\nContent-Length: 3000000\r\n\r\n"
    endless = gzip.compress(head + b"x" * 3_000_000 + b"\r\n\r\n")
    after = warc.record("1", "u", b"next")
    one, two = warc.read_archive(endless + after)
    assert "head" in one["error"] and two["digest_ok"] and two["payload_bytes"] == 4


# --- URLs ---


def test_url_rules(spark, tmp_path):
    urls = ["http://A.Example.ORG/es/x?q#f", "http://example.org/en/12", "http://example.org/en/2", "http://xexample.org/es/1", "x://org", "x://org/", "http://a.com/de/1", "http://a.com/fr/", "http://com/fr/x", "no url", None, "", "http://h?x/y", "http://Ä.com/DE/", "a://b://c/d", "http://b.net/en/1\nx"]
    rows = [(i, u, "<title>The blue bird sings</title>") for i, u in enumerate(urls)] + [(None, urls[0], None)]
    table(spark, rows, "page_id long, url string, html string", tmp_path, "pages")
    got = {r.page_id: r for r in queries.op4_url_filter(spark, str(tmp_path)).collect()}
    rules = [x.split(" ", 1) for x in queries.URL_RULES]
    for i, url in enumerate(urls):
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest).group()
            path = re.match(r"[^?#]*", rest[len(host) :]).group()
            host = re.sub("[A-Z]", lambda m: m.group().lower(), host)
        fits = [(len(t), t, v) for v, t in rules if (host == t.split("/")[0] or host.endswith("." + t.split("/")[0])) and path.startswith(t[t.index("/") :])]
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, max(fits)[1] if fits else None), url
        assert got[i].verdict == max(fits)[2] if fits else got[i].verdict in ("allow", "block")
    assert len(got) == len(urls) + 1
    table(spark, [], "page_id long, url string, html string", tmp_path, "pages")
    assert queries.op4_url_filter(spark, str(tmp_path)).collect() == []


def url_words(spark, rows):
    return {r.word: r.log for r in url_filter.learn_words(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_url_words_and_bayes(spark):
    said = "<title>blue birds</title><script>var hidden = 1</script><!-- unseen --><p class='styled'>sing&nbsp;and <b>birds</b> fly"
    logs = url_words(spark, [(i, f"http://x{i}.org/", said) for i in range(3)])
    assert set(logs) == {"blue", "birds", "sing", "and", "fly"} and abs(logs["birds"] - np.log(2 / 6)) < 1e-12
    assert url_filter.split("bluebirdssing", logs) == ("blue", "birds", "sing") and url_filter.split("", logs) == ()

    def slow(label):
        if not label:
            return 0.0, ()
        options = []
        for i in range(1, len(label) + 1):
            rest = slow(label[i:])
            options.append((logs.get(label[:i], -9 - 2.5 * i) + rest[0], (label[:i], *rest[1])))
        return max(options)

    for label in ("birdsfly", "andxblue", "singing", "zz"):
        found = url_filter.split(label, logs)
        assert "".join(found) == label and abs(sum(logs.get(w, -9 - 2.5 * len(w)) for w in found) - slow(label)[0]) < 1e-9
    rows = spark.createDataFrame([([1, 2], "block"), ([1], "block"), ([2, 3], "allow")], "t array<int>, v string")
    odds = url_filter.learn_bayes(rows, "t", "v")
    assert abs(odds[1] - (np.log(3 / 6) - np.log(1 / 5))) < 1e-12 and odds[9] == 0 and abs(odds[-1] - np.log(2)) < 1e-12


def test_url_names_of_many_pages_are_split(spark):
    rows = [(i, f"http://www.bluebirds.org/{i}", "<title>Home of bluebirds</title>") for i in range(300)]
    rows += [(1000 + i, f"http://x{i}.net/fly", "<p>blue birds sing, they fly") for i in range(5)]
    logs = url_words(spark, rows)
    assert url_filter.split("bluebirds", logs) == ("blue", "birds") and url_filter.split("bluebirdsfly", logs) == ("blue", "birds", "fly")


def test_url_fragments_are_no_words(spark):
    text = "blue birds sing " * 20_000
    rows = [(i, f"http://{h}.org/", f"<title>{text} ta ir &amp; &#65;</title>") for i, h in enumerate("xy")] + [(3, "http://z.org/", "onsh onsh onsh"), (4, "http://y.org/", None)]
    logs = url_words(spark, rows)
    assert set(logs) == {"blue", "birds", "sing"}  # onsh is what one host says
    assert url_filter.split("taonshir", logs) == ("taonshir",) and url_filter.split("blue" * 16, logs) == ("blue" * 16,) and url_filter.split("bluebirds" * 7, logs) == ("blue", "birds") * 7


def test_url_splits_of_copies(spark):
    """Ten copies of a table split its hosts as the table does, and a rare word counts in either."""
    rng = random.Random(3)
    words = [f"{a}{b}" for a in ("ba", "ke", "mi", "so", "tu") for b in ("lor", "men", "tis", "vak")]
    rows = [(i, f"http://{''.join(rng.sample(words, 2))}.org/{i}", " ".join(rng.choices(words, k=60)) + (" quorum" if i < 2 else "")) for i in range(80)] + [(90, "http://quorumbalor.net/", "")]

    def splits(copies):
        pages = spark.createDataFrame(rows * copies, "page_id long, url string, html string")
        hosts = pages.select(url_filter.host_of(F.col("url")).alias("host")).distinct()
        return {r.host: r.pieces for r in url_filter.split_hosts(hosts, url_filter.learn_words(pages)).collect()}

    once = splits(1)
    assert once == splits(10) and once["quorumbalor.net"] == ["quorum", "balor", "net"]
    assert sum(len(x) == 3 for x in once.values()) > 0.9 * len(once)


def test_url_verdicts_equal_brute_force(spark, tmp_path):
    """Words, splits, counts and verdicts by plain Python, from the same table."""
    rng = random.Random(12)
    words = ["blue", "birds", "sing", "river", "stone", "casino", "poker", "win", "cash"]
    rows = []
    for i in range(400):
        bad = rng.random() < 0.5
        own = words[5:] if bad else words[:5]
        name = "".join(rng.sample(own, 2))
        host, path = rng.choice([(f"www.{name}.org", "/es/"), (f"{name}.com", "/de/" if bad else "/fr/"), (f"{name}.net", "/x/"), ("example.org", "/en/1")])
        rows.append((i, f"http://{host}{path}{rng.choice(own)}{rng.randrange(9)}", f"<p><TITLE>The {' '.join(rng.choices(own, k=6))}</title>"))
    table(spark, rows, "page_id long, url string, html string", tmp_path, "pages")
    got = {r.page_id: r for r in queries.op4_url_filter(spark, str(tmp_path)).collect()}
    counts, hosts = {}, {}
    for _, url, html in rows:
        host = re.match(r"http://([^/]*)", url).group(1)
        for w in re.findall(r"[a-z]+", re.sub("<[^>]*>", " ", html).lower()):
            if w not in re.findall(r"[a-z]+", host):
                counts[w] = counts.get(w, 0) + 1
                hosts.setdefault(w, set()).add(host)
    total = sum(counts.values())
    logs = {w: np.log(n / total) for w, n in counts.items() if len(hosts[w]) > 1 and n >= total * {1: 1e-2, 2: 1e-3}.get(len(w), 0)}

    def split(label):
        best = {0: (0.0, ())}
        for end in range(1, len(label) + 1):
            best[end] = max(((best[k][0] + logs.get(label[k:end], -9 - 2.5 * (end - k)), (*best[k][1], label[k:end])) for k in range(end)), key=lambda x: x[0])
        return best[len(label)][1]

    def tokens(host, path):
        parts = [w for label in re.findall(r"[a-z0-9]+", host) for w in split(label)]
        return ["h:" + w for w in parts] + ["p:" + t for t in re.findall(r"[a-z0-9]+", path.lower()) if not t.isdigit()]

    learned = {"block": {}, "allow": {}}
    n = {"block": 0, "allow": 0}
    for r in got.values():
        if r.rule:
            n[r.verdict] += 1
            for t in tokens(r.host, r.path):
                learned[r.verdict][t] = learned[r.verdict].get(t, 0) + 1
    known = {*learned["block"], *learned["allow"]}
    assert len({zlib.crc32(t.encode()) >> 16 for t in known}) == len(known)
    share = lambda v, t: (learned[v].get(t, 0) + 1) / (sum(learned[v].values()) + len(known))
    by_bayes = [r for r in got.values() if not r.rule]
    for r in by_bayes:
        odds = np.log(n["block"] / n["allow"]) + sum(np.log(share("block", t) / share("allow", t)) for t in tokens(r.host, r.path) if t in known)
        assert r.verdict == ("block" if odds > 0 else "allow"), r
    assert len(by_bayes) > 50 and {r.verdict for r in by_bayes} == {"allow", "block"}
    assert any(len(split(label)) > 1 for r in by_bayes for label in r.host.split("."))


# --- personal data ---

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def stands(kind, hit):
    digits = re.sub("[^0-9]", "", hit)
    if kind == "ip":
        return all(int(x) <= 255 for x in hit.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def base(text):
    return sorted((m.start(), k, m.end(), kind) for k, kind in enumerate(pii.KINDS) for m in re.finditer(PLAIN[kind], text or "") if stands(kind, m.group()))


def test_pii_base_equals_plain_patterns(spark):
    rng = random.Random(5)
    pieces = ["a@b.c", "x.y@", "@", "1.2.3.4", "300.1.1.1", "00012.3.4.5", ".", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (212) 555-0100", "+", "5", " ", "é", "😀", "-", "__", "a@b.c_d@e.f.g", "(", "٣", "\n", "word "]
    texts = [None, "", *("".join(rng.choice(pieces) for _ in range(rng.randrange(30))) for _ in range(400)), "1.2.3.4 " * 3000, "a" * 60_000, "1 " * 20_000, "a@" + "b." * 20_000, "+1" * 9000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for r in docs.select("doc_id", pii.base_spans(F.col("text")).alias("s")).collect():
        assert [tuple(x) for x in r.s] == base(texts[r.doc_id]), texts[r.doc_id]


def test_pii_takes_zero_parts(spark):
    rng = random.Random(8)
    pieces = ["10.0.0.1", "0.0.0.0", "1.00.2.3", "0255.0.0.1", "0256.0.0.1", "0999.1.1.1", "1.2.3.4", "0", "00", ".", " ", "x", "000" * 500]
    texts = ["10.0.0.1", "127.0.0.1 and 192.168.0.1", "0" * 4000 + ".0.0.0", "0.0.0.256", *("".join(rng.choice(pieces) for _ in range(rng.randrange(12))) for _ in range(300))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    none = pii.CLOSED
    holds = pii._holds_base("ip", F.col("text"))
    red = pii.redact(docs.withColumn("t", F.col("text")), none, "t")
    for r in red.select("doc_id", pii.base_spans(F.col("text")).alias("s"), "t", holds.alias("holds")).collect():
        want = base(texts[r.doc_id])
        assert [tuple(x) for x in r.s] == want, texts[r.doc_id]
        assert r.holds == any(kind == "ip" for *_, kind in want)
        if r.doc_id < 4:
            assert r.t == ["[IP]", "[IP] and [IP]", "[IP]", "0.0.0.256"][r.doc_id]


def test_pii_prefilter_loses_no_candidate(spark):
    rng = random.Random(9)
    pieces = ["jane", "example", "com", "a-b", " at ", " (at) ", "[at]", "(@)", "@", ".", " dot ", "(dot)", "[.]", " (.) ", " ", "mail ", "1", " 1.2.3.4 ", " 1(dot)2.3.4 ", "+1 212 555-0100", "4111 1111 1111 1111", "(212) 555-0100", "\n", "é"]
    texts = ["mail jane at example.com today", "x@y.org and jane at example.com today", *("".join(rng.choice(pieces) for _ in range(rng.randrange(14))) for _ in range(1500))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    hits = lambda p: F.regexp_extract_all("text", F.lit(p), F.lit(0))
    columns = [c for k in pii.KINDS for p in (pii.BASE[k], pii.LOOSE[k]) for c in (hits(p), pii._if_needed(k, F.col("text"), hits(p), F.array().cast("array<string>")))]
    seen = [0] * len(columns)
    for r in docs.select(*(c.alias(str(i)) for i, c in enumerate(columns))).collect():
        assert r[0::2] == r[1::2]
        seen = [n + len(x) for n, x in zip(seen, r, strict=True)]
    assert all(seen)
    model = {kind: [kind == "email"] * pii.CELLS for kind in pii.KINDS}
    few = docs.where("doc_id < 2").withColumn("red", F.col("text"))
    got = pii.redact(pii.find(few, model), model, "red").orderBy("doc_id").select("added", "red").collect()
    assert [[tuple(x) for x in r[0]] for r in got] == [[(5, 0, 24, "email")], [(12, 0, 31, "email")]]
    assert [r[1] for r in got] == ["mail [EMAIL] today", "[EMAIL] and [EMAIL] today"]


def plain(pattern):
    return re.compile(pattern.replace(r"\z", r"\Z"), re.ASCII)


def slow_grades(kind, hit, left, right):
    has = lambda text, p: bool(plain(p).search(text))
    left, right, near = left.lower(), right.lower(), pii._NEAR[kind]
    digits = re.sub("[^0-9]", "", hit)
    context = 3 if has(left, rf"(?:{near})\W{{0,3}}\z") else 2 if has(left, near) else 1 if has(right, near) else 0
    luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0
    labels = plain(rf"\A[A-Za-z0-9._%+-]++{pii._AT}").sub("", hit)
    part = rf"{pii._PART}(?:{pii._DOT}{pii._PART}){{3}}"
    cuts, rest = {
        "email": ((12, 24, 40), [has(hit, r"[A-Za-z]{2,6}\z"), has(labels, "[A-Za-z]"), has(hit, r"\A[A-Za-z]"), has(labels, "[A-Za-z0-9-]{3}")]),
        "ip": ((6, 8, 10), [bool(re.fullmatch(part, hit)), not has(hit, "(?<![0-9])0[0-9]"), hit[0] in "123456789", has(left, r"(?<![a-z0-9])v(?:er(?:sion)?)?\.?\x20?\z")]),
        "card": ((14, 16, 17), [luhn, digits[:1] in tuple("3456"), len(digits) < len(hit), has(hit, r"\A(?:[0-9]{4}[^0-9]+)+[0-9]{1,4}\z")]),
        "phone": ((8, 10, 13), [has(hit, r"\([0-9]{2,4}\)"), has(hit, r"[^0-9][0-9]{4}\z"), has(hit, r"[0-9]{3}[\x20.-][0-9]{4}\z"), not left or left[-1] in " \t\n\x0b\f\r"]),
    }[kind]
    length = sum((len(hit) if kind == "email" else len(digits)) >= c for c in cuts)
    return [context, int(not right or right[0] in ".,;:!?)] \n"), length, min(3, len(digits) * 4 // len(hit)), *map(int, rest)]


def slow_added(text, model):
    """Candidates one kind after the other, where neither a base match nor an earlier span is."""
    rest = list(text)
    for start, _, end, _ in base(text):
        rest[start:end] = "\x01" * (end - start)
    out = []
    for k, kind in enumerate(pii.KINDS):
        now = "".join(rest)
        hits = list(plain(pii.LOOSE[kind]).finditer(now))
        for i, m in enumerate(hits):
            left = now[hits[i - 1].end() if i else 0 : m.start()][-24:]
            right = now[m.end() : hits[i + 1].start() if i + 1 < len(hits) else len(now)][:24]
            cell = 0
            for n, grade in zip(pii._GRADES, slow_grades(kind, m.group(), left, right), strict=True):
                cell = cell * n + grade
            if model[kind][cell]:
                out.append((m.start(), k, m.end(), kind))
                rest[m.start() : m.end()] = "\x01" * (m.end() - m.start())
    return out


def slow_redact(text, spans):
    out, at = "", 0
    for start, _, end, kind in sorted(spans):
        if start >= at:
            out += text[at:start] + f"[{kind.upper()}]"
        at = max(at, end)
    return out + text[at:]


def test_pii_added_spans_equal_brute_force(spark):
    rng = random.Random(10)
    pieces = ["jane", "mail ", "example", "com", " at ", " (at) ", "@", ".", " dot ", "(dot)", " ", "call ", "tel: ", "+1 212 555-0100", "(212) 555-0100", "4111.1111.1111.1111", "4111 1111 1111 1111", "10 dot 0 dot 0 dot 1", "1.2.3.4", "version 1.2.3", "0", "77", "-", "é", "😀", "host ", ", ", "+49 4111 1111 1111 11"]
    texts = ["", *("".join(rng.choice(pieces) for _ in range(rng.randrange(25))) for _ in range(600)), "".join(rng.choice(pieces) for _ in range(3000)), "é" * 1020 + "a@b.co and 1.2.3.4@" + "x" * 3000 + ".org tail"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for share in (0.5, 1.0):
        model = {kind: [rng.random() < share for _ in range(pii.CELLS)] for kind in pii.KINDS}
        n = 0
        for r in pii.redact(pii.find(docs.withColumn("red", F.col("text")), model), model, "red").collect():
            want = slow_added(r.text, model)
            assert sorted(map(tuple, r.added)) == sorted(want), r.text
            assert r.red == slow_redact(r.text, base(r.text) + want)
            n += len(want)
        assert n > 200


def test_pii_trees_catch_obfuscated_data(spark):
    """Labelled examples: spelled-out addresses and numbers without a plus, beside versions, dates, prices and parts."""
    rng = random.Random(11)
    name = lambda: "".join(rng.choice("aeioulmnrst") for _ in range(rng.randrange(4, 9)))
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    phone = lambda: f"({digits(3)}) {digits(3)}-{digits(4)}"
    plain_text = lambda: rng.choice([f"please mail {name()}@{name()}.com today", f"call +1 {phone()} now", f"phone: +1 {phone()}, thanks", f"see version {digits(1)}.{digits(2)}.{digits(1)}", f"order {digits(8)} of {digits(4)}-{digits(2)}-{digits(2)}", f"part no {digits(3)}.{digits(3)}.{digits(3)} for {digits(3)} dollars", f"meet {name()} at home. {name()} will come"])
    docs = spark.createDataFrame([(i, plain_text()) for i in range(3000)], "doc_id long, text string")
    model = pii.learn(docs)
    hidden = [(f"please mail {name()} (at) {name()} (dot) com today", "email") for _ in range(50)] + [(f"call {phone()} now", "phone") for _ in range(50)]
    clean = [f"see version {digits(1)}.{digits(2)}.{digits(1)}" for _ in range(40)] + [f"order {digits(8)} of {digits(4)}-{digits(2)}-{digits(2)}" for _ in range(40)]
    shown = spark.createDataFrame([(i, t) for i, t in enumerate([t for t, _ in hidden] + clean)], "doc_id long, text string")
    got = {r.doc_id: [s.kind for s in r.added] for r in pii.find(shown, model).collect()}
    assert sum(got[i] == [kind] for i, (_, kind) in enumerate(hidden)) >= 90
    assert sum(bool(got[len(hidden) + i]) for i in range(len(clean))) <= 4


def test_pii_adds_likely_spans(spark, tmp_path):
    rng = random.Random(6)
    number = lambda: f"({rng.randrange(100, 999)}) {rng.randrange(100, 999)}-{rng.randrange(1000, 9999)}"
    rows = [(i, f"please call +1 {number()} or write to name{i}@mail.example.com today {i}", "en", "s", 0) for i in range(200)]
    rows += [(500, f"please call {(n := number())} or write to name (at) mail (dot) example (dot) com today", "en", "s", 0), (501, None, None, None, None), (502, "", "", "", 0), (500, "repeated", "", "", 0)]
    docs = table(spark, rows, DOCS, tmp_path, "documents")
    got = {(r.doc_id, r.spans): r for r in queries.op5_pii(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    (odd,) = [r for (i, s), r in got.items() if i == 500 and s]
    at = 12
    assert f"phone:{at}:{at + len(n)}" in odd.spans and "email:" in odd.spans and odd.n_phone == odd.n_email == 0
    assert odd.base_sha256 == hashlib.sha256(b"").hexdigest()
    for r in got.values():
        text = next((t for i, t, *_ in rows if i == r.doc_id and (i != 500)), None)
        if text:
            assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, e, k in base(text)).encode()).hexdigest()
    model = pii.learn(docs)
    red = {r.doc_id: r.t for r in pii.redact(docs, model).select("doc_id", F.col("text").alias("t")).where("t <> 'repeated' or t is null").collect()}
    assert red[0] == "please call [PHONE] or write to [EMAIL] today 0" and red[501] is None and red[502] == ""
    assert red[500] == "please call [PHONE] or write to [EMAIL] today"
    assert not any(any(x) for x in pii.learn(docs.limit(0)).values())


# --- toxicity ---


def margin_of(machine, terms):
    """The machine's log odds by the formula, every pair by itself."""
    found = [machine.rows[h] for h in terms if h in machine.rows]
    v = machine.vectors[found]
    return machine.bias + machine.weights[found].sum() + sum(float(v[i] @ v[j]) for i in range(len(found)) for j in range(i))


def test_toxicity_step_by_hand():
    """One step of fit over all rows is the gradient of the loss, worked out term by term."""
    rng = random.Random(5)
    terms = [11, 12, 13, 14]
    texts = [np.array(rng.choices([*terms, 99], k=rng.randrange(1, 6)), np.int64) for _ in range(6)]
    labels, odds = np.array([1, 0, 0, 1, 0, 0], float), {11: 0.5, 12: -0.2, 13: 0.0, 14: 1.0}
    factors, rate, decay, n = 3, 0.1, 1e-3, len(labels)
    got = toxicity.fit(texts, labels, odds, factors=factors, steps=1, batch=n, rate=rate, decay=decay, seed=7)
    start = np.random.default_rng(7).normal(0, 0.01, (4, factors))
    w, v, bias = {t: odds[t] for t in terms}, {t: start[i].tolist() for i, t in enumerate(terms)}, math.log((2 / 6) / (4 / 6))
    db, dw, dv = 0.0, {t: decay * w[t] / n for t in terms}, {t: [decay * x / n for x in v[t]] for t in terms}
    for text, label in zip(texts, labels, strict=True):
        own = [t for t in text.tolist() if t in w]
        margin = bias + sum(w[t] for t in own)
        margin += sum(sum(a * b for a, b in zip(v[own[i]], v[own[j]], strict=True)) for i in range(len(own)) for j in range(i + 1, len(own)))
        error = (1 / (1 + math.exp(-margin)) - label) / n
        db += error
        for i, t in enumerate(own):
            dw[t] += error
            for k in range(factors):
                dv[t][k] += error * sum(v[u][k] for j, u in enumerate(own) if j != i)
    step = lambda x, d: x - rate * d / math.sqrt(1e-8 + d * d)  # noqa: E731  Adagrad's first step
    assert abs(got.bias - step(bias, db)) < 1e-9
    for i, t in enumerate(terms):
        assert abs(got.weights[i] - step(w[t], dw[t])) < 1e-9 and np.allclose(got.vectors[i], [step(a, d) for a, d in zip(v[t], dv[t], strict=True)], atol=1e-9)


def test_toxicity_learns_pairs(spark):
    """A label that only a pair of words tells, with the query's own settings."""
    rng = random.Random(1)
    docs, labels = [], []
    for i in range(4000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words = [f"w{rng.randrange(300)}" for _ in range(12)] + ["awful"] * a + ["folk"] * b
        rng.shuffle(words)
        docs.append((i, " ".join(words)))
        labels.append((i, int(a == b)))  # no additive score can tell these apart
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    machine = toxicity.learn(frame, spark.createDataFrame(labels[:3000], "doc_id long, toxic int"))
    right = sum((machine.score(t) >= 0.5) == bool(y) for (_, t), (_, y) in zip(docs[3000:], labels[3000:], strict=True))
    assert right > 900
    alone = toxicity.Machine(machine.rows, machine.bias, machine.weights, machine.vectors * 0)
    assert sum((alone.score(t) >= 0.5) == bool(y) for (_, t), (_, y) in zip(docs[3000:], labels[3000:], strict=True)) < 700
    for _, text in docs[3000:3050]:
        assert abs(machine.score(text) - 1 / (1 + np.exp(-margin_of(machine, toxicity.terms_of(text))))) < 1e-9


def test_toxicity_terms_are_chosen_by_the_test(spark):
    hits, seen = np.array([16.0, 0, 5, 16, 8]), np.array([16.0, 16, 10, 400, 300])
    got = toxicity.telling(hits, seen, 16, 400)

    def slow(k, s):
        out = 0.0
        for part, n in ((k, 16), (s - k, 384)):
            for x, p in ((part, s / 400), (n - part, 1 - s / 400)):
                out += x * np.log(x / n / p) if x else 0.0
        return 2 * out

    assert np.allclose(got, [slow(k, s) for k, s in zip(hits, seen, strict=True)])
    docs = spark.createDataFrame([(i, "bad thing here" if i % 4 == 0 else "good thing here") for i in range(400)] + [(0, "other text")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(0, None)], "doc_id long, toxic int")
    first, second = (toxicity.learn(d, labels) for d in (docs, docs.orderBy(F.desc("doc_id"))))
    assert first.rows == second.rows and np.array_equal(first.vectors, second.vectors)
    assert first.score("a bad day") > 0.5 > first.score("a good day")


def test_toxicity_query(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "toxic")
    got = queries.op6_toxicity(spark, "/root/testdata/sf0.1").where("held_out").join(labels, "doc_id").collect()
    caught, missed, wrong = (sum(r.predicted == p and r.toxic == t for r in got) for p, t in ((1, 1), (0, 1), (1, 0)))
    assert caught >= 0.9 * (caught + missed) and caught >= 0.95 * (caught + wrong)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    fold = id_mod(F.col("doc_id"), 5)
    machine = toxicity.learn(docs, labels.where(fold != 0))
    texts = {r.doc_id: r.text for r in docs.join(labels, "doc_id").where(fold == 0).select("doc_id", "text").collect()}
    for r in got[:200]:
        assert abs(r.score - 1 / (1 + np.exp(-np.clip(margin_of(machine, toxicity.terms_of(texts[r.doc_id])), -40, 40)))) < 1e-9
    table(spark, [(1, None, "", "", 0), (1, None, "", "", 0), (2, "", "", "", 0), (None, "x", "", "", 0)], DOCS, tmp_path, "documents")
    table(spark, [], "doc_id long, quality int, toxic int", tmp_path, "labels")
    assert sorted((r.doc_id or 0, r.predicted) for r in queries.op6_toxicity(spark, str(tmp_path)).collect()) == [(0, 0), (1, 0), (1, 0), (2, 0)]
    assert machine.score(None) == machine.score("") < 0.5


# --- near duplicates ---


def slow_components(rows):
    """Smallest id reachable, all pairs compared."""
    fps = [(i, simhash.fingerprint_of(t) & (2**64 - 1)) for i, t in rows]
    group = list(range(len(fps)))

    def find(x):
        while group[x] != x:
            group[x] = group[group[x]]
            x = group[x]
        return x

    values = np.array([f for _, f in fps], np.uint64)
    for a in range(len(fps)):
        for b in np.flatnonzero(np.bitwise_count(values[a:] ^ values[a]) <= 3) + a:
            group[find(a)] = find(int(b))
    least = {}
    for k, (i, _) in enumerate(fps):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [(i, f, least.get(find(k))) for k, (i, f) in enumerate(fps)]


def test_fingerprints_by_the_book():
    import xxhash

    for text in ["", None, "One", "a b", "A B  c\td e e e e", "x\x0by\x0cz\u00a0w é É", "the " * 500]:
        words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) if w]
        shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert simhash.fingerprint_of(text) & (2**64 - 1) == want


def test_simhash_query_equals_all_pairs(spark, tmp_path):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    rows = [(None, "lone text here now"), (None, ""), (7, None), (900_000, "")]
    for i in range(300):
        body = [rng.choice(words) for _ in range(rng.choice([3, 30, 300]))]
        for j in range(rng.choice([1, 1, 2, 6])):
            copy = list(body)
            if j:
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((1000 * i + j, " ".join(copy)))
    rows += rows[:40]
    rng.shuffle(rows)
    table(spark, [(i, t, "en", "s", 0) for i, t in rows], DOCS, tmp_path, "documents")
    got = queries.op8_simhash(spark, str(tmp_path)).collect()
    key = lambda r: (str(r[0]), r[1], str(r[2]))
    want = [(i, f"{f:016x}", c) for i, f, c in slow_components(rows)]
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("spread", [2, 64])
def test_shards_lose_no_link(spark, spread):
    rng = np.random.default_rng(4)
    centres = rng.integers(0, 2**63, 40, np.uint64)
    points = centres[rng.integers(0, 40, 3000)]
    for _ in range(6 if spread == 2 else 40):
        points = points ^ (np.uint64(1) << rng.integers(0, 64, len(points)).astype(np.uint64))
    points = np.unique(points)
    df = spark.createDataFrame([(int(p),) for p in points.view(np.int64)], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.link(df, shard_size=100, block=150)).collect()}
    group = np.arange(len(points))
    near = [np.flatnonzero(np.bitwise_count(points ^ p) <= 3) for p in points]
    while True:
        lower = np.array([group[n].min() for n in near])
        if (lower == group).all():
            break
        group = lower
    values = points.view(np.int64).tolist()
    mine = [roots.get(v, v) for v in values]
    assert len(set(zip(mine, group.tolist(), strict=True))) == len(set(mine)) == len(set(group.tolist()))


# --- benchmark ---


def slow_tiles(doc, item, least):
    """The textbook's tiling, every pair of places tried for every tile."""
    free_d, free_i, out = [True] * len(doc), [True] * len(item), []
    while True:
        best = (least - 1, 0, 0)
        for p in range(len(doc)):
            for q in range(len(item)):
                n = 0
                while p + n < len(doc) and q + n < len(item) and doc[p + n] == item[q + n] and free_d[p + n] and free_i[q + n]:
                    n += 1
                if n > best[0]:
                    best = (n, p, q)
        n, p, q = best
        if n < least:
            return out
        free_d[p : p + n] = free_i[q : q + n] = [False] * n
        out.append((p, q, n))


def test_tiling_equals_the_textbook():
    rng = random.Random(9)
    for _ in range(150):
        item = [rng.randrange(4) for _ in range(rng.randrange(3, 25))]
        doc = [rng.randrange(5) for _ in range(rng.randrange(40))]
        cut = rng.randrange(len(item))
        doc += item[cut:] + [9] * rng.randrange(2) + item[:cut]
        own = [tuple(item[q : q + 3]) for q in range(len(item) - 2)]
        places = [p for p in range(len(doc) - 2) if tuple(doc[p : p + 3]) in own]
        number = {seed: i for i, seed in enumerate(dict.fromkeys(own))}
        runs = decontaminate.shared_runs(np.array(places, np.int64), np.array([number[tuple(doc[p : p + 3])] for p in places], np.int64), np.array([number[x] for x in own]), 3)
        assert decontaminate.tiles(runs, len(item), 3) == slow_tiles(doc, item, 3)


def test_decontamination(spark, tmp_path):
    item = [f"w{i}" for i in range(40)]
    moved = item[20:] + ["between"] + item[:20]
    docs = [(1, "Before: " + ", ".join(item) + " after"), (2, " ".join(moved).upper()), (3, " ".join(item[:30])), (4, " ".join(item[:33])), (5, " ".join(reversed(item))), (6, None), (7, ""), (1, " ".join(item)), (None, " ".join(item)), (8, "tiny one"), (9, " ".join(["x"] * 20_000 + item))]
    table(spark, [(i, t, "", "", 0) for i, t in docs], DOCS, tmp_path, "documents")
    table(spark, [(1, " ".join(item)), (2, None), (3, ""), (4, "tiny one"), (None, " ".join(item[:10])), (1, " ".join(item))], "item_id long, text string", tmp_path, "benchmark")
    got = sorted((r.doc_id or -1, r.item_id or -1, round(r.coverage, 3), r.n_tiles) for r in queries.op10_decontaminate(spark, str(tmp_path)).collect())
    long = [(1, 1, 1.0, 1), (1, 1, 1.0, 1), (1, 1, 1.0, 1), (1, 1, 1.0, 1), (2, 1, 1.0, 2), (2, 1, 1.0, 2), (4, 1, 0.825, 1), (4, 1, 0.825, 1), (9, 1, 1.0, 1), (9, 1, 1.0, 1), (-1, 1, 1.0, 1), (-1, 1, 1.0, 1)]
    short = [(i, -1, 1.0, 1) for i in (1, 1, 2, 3, 4, 9, -1)]
    assert got == sorted(long + short)
    few = decontaminate.contaminated(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/benchmark.parquet"), salts=3)
    assert sorted((r.doc_id or -1, r.item_id or -1, round(r.coverage, 3), r.n_tiles) for r in few.collect()) == got
    table(spark, [], "item_id long, text string", tmp_path, "benchmark")
    assert queries.op10_decontaminate(spark, str(tmp_path)).collect() == []


def test_hot_keys_are_dealt_out(spark):
    many = spark.range(40_000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("k"), "id")
    few = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k long, v string")
    joined = join_hot(many, few, ["k"], salts=5)
    assert "__salt" in joined._jdf.queryExecution().toString() and joined.columns == ["k", "id", "v"]
    got = {r.v: r.n for r in joined.groupBy("v").agg(F.countDistinct("id").alias("n")).collect()}
    assert got == {"a": 13_335, "b": 13_335, "c": 1} and joined.count() == 26_671
    assert join_hot(many.limit(0), few, ["k"]).count() == 0


def test_one_word_a_thousand_times(spark):
    docs = spark.createDataFrame([(1, "word " * 300_000), (2, "a b c d e f")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "word " * 400), (2, "word " * 9 + "other " * 9)], "item_id long, text string")
    assert [(r.doc_id, r.item_id, r.coverage, r.longest_tile) for r in decontaminate.contaminated(docs, items).collect()] == [(1, 1, 1.0, 400)]
    assert [r.doc_id for r in decontaminate.clean(docs.union(docs.limit(0)), items).collect()] == [2]


# --- pipeline ---


def slow_pipeline(docs, items, model_redact, encode):
    kept = [d for d in docs if d[1] and any(c.isalpha() for c in d[1])]
    seen, out = set(), []
    for (i, text), (_, _, component) in sorted(zip(kept, slow_components(kept), strict=True), key=lambda x: x[0][0]):
        if component not in seen:
            seen.add(component)
            out.append((i, text))
    clean = []
    for i, text in out:
        tokens = decontaminate.tokens_of(text)
        share = lambda item: sum(n for _, _, n in slow_tiles(tokens, item, 5)) / len(item)
        joined = " " + b" ".join(tokens).decode() + " "
        if not any(f" {b' '.join(x[k : k + 5]).decode()} " in joined for x in items for k in range(len(x) - 4)) or all(share(x) < 0.8 for x in items):
            clean.append((i, text))
    return {i: encode(model_redact(text)) for i, text in clean}


def test_pipeline_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/documents.parquet").collect()
    items = [decontaminate.tokens_of(r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    from tests.llm.test_text_operators import library

    def plain_redact(text):
        return slow_redact(text, base(text))

    want = slow_pipeline([(r.doc_id, r.text) for r in rows], items, plain_redact, library("bytes"))
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, folder).collect()}
    assert got == want  # so small a table teaches the trees to add nothing
    assert 0 < len(got) < len(rows)


def test_stages_take_odd_rows(spark, tmp_path):
    rows = [(1, "the same words in a text", "en", "s", 1), (1, "the same words in a text", "en", "s", 1), (2, "the same words in a text", "en", "s", 1), (3, None, None, None, None), (4, "", "en", "s", 0), (5, "1 2 3", "fr", "s", 0), (None, "quite another text without id", "en", "s", 1), (None, "quite another text without id", "en", "s", 1), (6, "word " * 50_000, "en", "s", 1)]
    table(spark, [(1, "unrelated item of the benchmark")], "item_id long, text string", tmp_path, "benchmark")
    for own in (rows, [(i, t, None, s, n) for i, t, _, s, n in rows], []):
        docs = table(spark, own, DOCS, tmp_path, "documents")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, str(tmp_path)).columns == docs.columns
        got = sorted((r.doc_id or -1, r.n_tokens > 0) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
        assert got == ([(-1, True), (1, True), (6, True)] if own else [])
    docs = table(spark, rows, DOCS, tmp_path, "documents")
    kept = simhash.representatives(docs).collect()
    assert sorted((r.doc_id or -1, (r.text or "")[:5]) for r in kept) == [(-1, "quite"), (1, "the s"), (3, ""), (5, "1 2 3"), (6, "word ")]
