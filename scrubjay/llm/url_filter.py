"""URL filter: rules on hosts and paths, and naive Bayes over words for the rest.

Host names run words together.  A Viterbi search under a unigram model splits
each label of a host into the most likely words; the model's words and counts
come from what all pages say, their whole text, without the hosts' own names,
which would else be words as frequent as their pages.  A multinomial naive Bayes
model over the host's words and the path's tokens then scores a URL.  It
learns from the URLs that rules decide, their verdict as label, over all
pages.

A word is what pages of at least two hosts say; one letter has to make up a
hundredth of all words and two a thousandth, as fragments of names would else
do.  A word is as likely as its share of all words; letters that are no word
have a fixed, small likelihood that falls with their number.  All of this goes
by shares and by what differs, so copies of a table change no split, and rare
words need no floor.  Words stay a table of any size: each host is joined with
those that it could be made of, and split by them alone.  The Bayes model has
``2**16`` hashed tokens.

Defined results: a URL that is null or has no ``://`` has an empty host and
path.  Names have no more than 63 letters in a label; longer runs are left
whole, and so are words, which can't occur in one.  Ties of two splits go to the
one whose last word is longer.  Of rules of equal length that fit, the one
whose text sorts last counts, of equal texts the last in the list.  A URL
without any known token gets the verdict that the rules give more often; with
even odds, or if the rules decide no page, it is allowed.  Rows are judged one
by one, so repeated rows are equal and extra columns never read.
"""

from __future__ import annotations

from dataclasses import dataclass
import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubjay.llm.common import join_hot, materialize

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BITS = 16
LONGEST_LABEL = 63
#: Least shares of all words for short ones, by their letters.
SHORT = {1: 1e-2, 2: 1e-3}
#: Log likelihood of letters that are no word: at all, and for each of them.
UNKNOWN, UNKNOWN_LETTER = -9.0, -2.5
#: What of a page isn't said: scripts, styles, comments, tags, entities.
_UNSAID = r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&#?[0-9A-Za-z]+;"
_TOKEN = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class Rule:
    """A verdict for a host, its subdomains and the paths that begin with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def parse_rule(line: str) -> Rule:
    """``allow example.org/a`` as a rule."""
    verdict, rest = line.split(maxsplit=1)
    host, slash, path = rest.partition("/")
    if verdict not in ("allow", "block") or not host:
        raise ValueError(f"not a rule: {line}")
    return Rule(verdict, host, slash + path)


def host_of(url: Column) -> Column:
    """Lower-cased text after the first ``://`` up to ``/``, ``?``, ``#`` or the end."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """Text after the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, null if none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):  # the longest is asked first
        fits = (host == rule.host) | host.endswith("." + rule.host)
        fits = fits & path.startswith(rule.path) if rule.path else fits
        text, verdict = F.when(fits, rule.text).otherwise(text), F.when(fits, rule.verdict).otherwise(verdict)
    return text, verdict


def unknown(letters: int) -> float:
    """Log likelihood of a run of letters that is no word."""
    return UNKNOWN + UNKNOWN_LETTER * letters


def split(label: str, logs: dict[str, float]) -> tuple[str, ...]:
    """Most likely words of a run of letters by their logs; a run too long for a label stays whole."""
    if not 2 <= len(label) <= LONGEST_LABEL:
        return (label,) if label else ()
    best, back = [0.0] + [-math.inf] * len(label), [0] * (len(label) + 1)
    for end in range(1, len(label) + 1):
        for start in range(end):
            log = logs.get(label[start:end], unknown(end - start))
            if best[start] + log > best[end]:
                best[end], back[end] = best[start] + log, start
    out, at = [], len(label)
    while at:
        out.append(label[back[at] : at])
        at = back[at]
    return tuple(out[::-1])


def running_words(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(word, n, first, last): what all pages say, less each page's own host's names, with the least and greatest hash of a host that says it."""
    letters = lambda text: F.split(F.lower(text), r"[^\p{L}]+")
    host = host_of(F.col(url))
    running = pages.select(letters(F.regexp_replace(F.col(html), _UNSAID, " ")).alias("words"), letters(host).alias("names"), F.xxhash64(host).alias("host"))
    # a name that joins words and stands in its own pages isn't a word for that
    own = F.filter("words", lambda w: (F.length(w) > 0) & (F.length(w) <= LONGEST_LABEL) & ~F.array_contains("names", w))
    words = running.select("host", F.explode(own).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n"), F.min("host").alias("first"), F.max("host").alias("last"))


def learn_words(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """The unigram model as a table: (word, log)."""
    counts = materialize(running_words(pages, url, html), "words")
    total = counts.agg(F.sum("n")).first()[0] or 1
    share = F.col("n") / F.lit(float(total))
    least = F.when(F.length("word") == 1, SHORT[1]).when(F.length("word") == 2, SHORT[2]).otherwise(0.0)
    return counts.where((F.col("first") != F.col("last")) & (share >= least)).select("word", F.log(share).alias("log"))


def runs_of(host: str) -> list[str]:
    """The runs of letters and digits of a host's labels."""
    return [run for label in host.split(".") for run in _TOKEN.findall(label)]


def split_hosts(hosts: DataFrame, words: DataFrame) -> DataFrame:
    """(host, pieces): the words of each host's labels.

    Only words that are a part of some label matter, so each host's parts are
    joined with the table of words; short words that are a part of most hosts
    are dealt out.
    """

    @F.arrow_udf("array<string>")
    def parts(rows: pa.Array) -> pa.Array:
        found = lambda run: {run[i:j] for i in range(len(run)) for j in range(i + 1, len(run) + 1)} if 2 <= len(run) <= LONGEST_LABEL else set()
        return pa.array([sorted(x for x in set().union(*map(found, set(runs_of(h)))) if x.isalpha()) for h in rows.to_pylist()], pa.list_(pa.string()))

    @F.arrow_udf("array<string>")
    def pieces(rows: pa.Array, known: pa.Array, logs: pa.Array) -> pa.Array:
        out = []
        for host, own, values in zip(rows.to_pylist(), known.to_pylist(), logs.to_pylist(), strict=True):
            of = dict(zip(own or (), values or (), strict=True))
            out.append([w for run in runs_of(host) for w in split(run, of)])
        return pa.array(out, pa.list_(pa.string()))

    each = materialize(hosts.select("host", F.explode(parts("host")).alias("word")), "parts")
    often = each.groupBy("word").agg(F.count("*").alias("n"))
    met = materialize(often.join(words, "word"), "met")
    joined = join_hot(each, met.select("word", "log"), ["word"], counts=often)
    known = joined.groupBy("host").agg(F.collect_list(F.struct("word", "log")).alias("known"))  # parts of one host
    return hosts.join(known, "host", "left").select("host", pieces("host", "known.word", "known.log").alias("pieces"))


def _hashed(tokens: list[str]) -> list[int]:
    return [zlib.crc32(t.encode()) >> (32 - _BITS) for t in tokens]


def tokens(pieces: Column, path: Column) -> Column:
    """Hashed tokens (array<int>) of each URL: its host's words and its path's tokens, marked apart."""

    @F.arrow_udf("array<int>")
    def hashed(words: pa.Array, paths: pa.Array) -> pa.Array:
        known: dict[str, int] = {}
        out = []
        for own, path in zip(words.to_pylist(), paths.to_pylist(), strict=True):
            marked = ["h:" + w for w in own] + ["p:" + t.lower() for t in _TOKEN.findall(path) if not t.isdigit()]
            fresh = [t for t in marked if t not in known]
            known.update(zip(fresh, _hashed(fresh), strict=True))
            out.append([known[t] for t in marked])
        return pa.array(out, pa.list_(pa.int32()))

    return hashed(pieces, path)


def learn_bayes(rows: DataFrame, tokens: str, verdict: str, smoothing: float = 1.0) -> np.ndarray:
    """Log odds of block for each hashed token, and the prior log odds as the last entry.

    ``rows`` are all that have a verdict; counts are summed before they are
    shuffled, and at most one row per hashed token comes back.
    """
    block = F.when(F.col(verdict) == "block", 1).otherwise(0)
    prior = rows.agg(F.count("*"), F.sum(block)).first()
    n, n_block = prior[0], prior[1] or 0
    odds = np.zeros(2**_BITS + 1)
    if not 0 < n_block < n:
        odds[-1] = 1.0 if n_block else -1.0
        return odds
    counted = rows.select(F.explode(tokens).alias("token"), block.alias("block")).groupBy("token").agg(F.sum("block").alias("b"), F.count("*").alias("n"))
    blocked, allowed = np.zeros(2**_BITS), np.zeros(2**_BITS)
    for r in counted.collect():
        blocked[r.token], allowed[r.token] = r.b, r.n - r.b
    used = blocked + allowed > 0
    size = used.sum()
    logs = np.log((blocked + smoothing) / (blocked.sum() + smoothing * size)) - np.log((allowed + smoothing) / (allowed.sum() + smoothing * size))
    odds[:-1][used] = logs[used]  # a token never seen tells nothing
    odds[-1] = math.log(n_block / (n - n_block))
    return odds


def log_odds(tokens: Column, odds: np.ndarray) -> Column:
    """Log odds that a URL's verdict is block."""

    @F.arrow_udf("double")
    def judge(rows: pa.Array) -> pa.Array:
        at = np.repeat(np.arange(len(rows)), rows.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
        flat = rows.flatten().to_numpy(zero_copy_only=False)
        return pa.array(odds[-1] + np.bincount(at, odds[flat], len(rows)), pa.float64())

    return judge(tokens)


def judge(pages: DataFrame, rules: list[Rule], page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule`` and ``verdict`` of every row of ``pages``."""
    host, path = host_of(F.col(url)), path_of(F.col(url))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path")).select("*", rule.alias("rule"), verdict.alias("decided"))
    hosts = materialize(split_hosts(materialize(rows.select("host").distinct(), "hosts"), learn_words(pages, url, html)), "pieces")
    named = join_hot(rows, hosts, ["host"])
    rows = materialize(named.select(*rows.columns, tokens(F.col("pieces"), F.col("path")).alias("tokens")), "urls")
    odds = learn_bayes(rows.where(F.col("decided").isNotNull()), "tokens", "decided")
    scored = rows.select("*", log_odds(F.col("tokens"), odds).alias("odds"))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("decided", F.when(F.col("odds") > 0, "block").otherwise("allow")).alias("verdict"))
