"""URL filters: rules on host and path, and for the rest a multinomial naive Bayes over segmented words.

Names run together ("bestfreenews") are split by a unigram Viterbi search: of all ways to cut a token into
words, the one of greatest probability under the word counts of the pages' own texts. Each different token is
split once; which words it holds is a join, so that no vocabulary is cut off or sent around.

The classifier counts the words of hosts and of paths as different tokens, hashed into BUCKETS. No table labels
urls: the first fit takes the pages that hold a seed word as ones to block, and learns them by their other words alone. From
then on expectation maximization gives every page, with or without a seed, the class that its words make likely; seeds are
words like any other, which tell something only as far as they keep such company. A verdict is the model's, never the
list's. Urls that differ in digits only are one row of all this, with their number of pages.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, batch_of, materialize, slices, table

SHORTEST = 2  # letters of a word
MAX_RULES = 1_000
BUCKETS = 1 << 18
SMOOTHING = 0.1
ROUNDS = 2  # of expectation maximization after the first fit
TRUST = 0.99  # probability in the first fit that a page with a seed is one to block
OFTEN = 1_000  # a token in over 1 of so many urls is joined where the urls lie
SEED_SHARE = 1_000  # each seed word counts as one in so many words of the pages at least
NUMBER = "<number>"
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
# Words of urls that training starts from.
SEEDS = ("adult", "ads", "bets", "betting", "casino", "escort", "pills", "poker", "porn", "spam", "viagra", "xxx")


# ---------------------------------------------------------------- parts and rules
def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty for a null url or one without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return ascii_lower(host), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """struct(verdict, rule) of the longest rule that fits, else null. A rule is host and path in one string; it
    fits its host and all subdomains where the path starts with the rule's. At most MAX_RULES rules."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules are tried one after the other")
    found = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the longest comes last, and so outermost
        name, slash, start = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + start))
        found = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(found)
    return found


# ---------------------------------------------------------------- words
def word_counts(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(word, n) of all words in all pages' texts, without tags."""
    text = F.lower(F.regexp_replace(F.col(html_col).cast("string"), r"(?s)<[^>]*>|&\w+;", " "))
    words = pages.select(F.explode(F.split(text, r"[^\p{L}]+")).alias("word")).filter(f"length(word) >= {SHORTEST}")
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def best_split(token: str, pieces: list[tuple[int, int, int]], total: int) -> list[str]:
    """The likeliest cut of token into words. pieces: (start, length, count) of each known word in it. A word
    costs -ln(count / total); an unknown stretch of k letters counts as much less than one appearance and the
    less the longer it is, and is left out of the result. Ties: the longer last word."""
    known: dict[int, list[tuple[int, float]]] = {}
    for start, length, n in sorted(pieces):
        known.setdefault(start + length, []).append((start, math.log(total / n)))
    open_, letter = math.log(total), math.log(10)
    best, back = [0.0], [(0, False)]
    unknown, since = math.inf, 0  # least cost of a split that ends in an unknown stretch, and where that began
    for end in range(1, len(token) + 1):
        if best[end - 1] + open_ < unknown:
            unknown, since = best[end - 1] + open_, end - 1
        unknown += letter
        least, way = unknown, (since, False)
        for start, cost in known.get(end, ()):
            if best[start] + cost < least:
                least, way = best[start] + cost, (start, True)
        best.append(least)
        back.append(way)
    out, end = [], len(token)
    while end:
        start, word = back[end]
        if word:
            out.append(token[start:end])
        end = start
    return out[::-1]


def split_tokens(tokens: DataFrame, counts: DataFrame) -> DataFrame:
    """(token, words) for a table of different tokens: their substrings of any length that a word has meet the words in
    a join, and each token is searched once, whatever its length. counts: (word, n), a table read several times."""
    sizes = [r[0] for r in counts.select(F.length("word").alias("k")).distinct().collect()]  # few: lengths of words
    total = int(counts.agg(F.sum("n")).first()[0] or 0) + 1
    parts = tokens.select("token", F.explode(F.array(*map(F.lit, sorted(sizes) or [1]))).alias("k")).filter("k <= length(token)")
    parts = parts.select("token", "k", F.explode(F.sequence(F.lit(1), F.length("token") - F.col("k") + 1)).alias("at"))
    met = parts.withColumn("word", F.expr("substring(token, at, k)")).join(counts, "word")
    pieces = met.groupBy("token").agg(F.collect_list(F.struct((F.col("at") - 1).alias("at"), "k", "n")).alias("pieces"))
    schema = pa.schema([("token", pa.string()), ("words", pa.list_(pa.string()))])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = [best_split(t, [(p["at"], p["k"], p["n"]) for p in ps], total) for t, ps in zip(part.column(0).to_pylist(), part.column(1).to_pylist())]
            yield batch_of(schema, part.column(0), found)

    return pieces.mapInArrow(search, "token string, words array<string>")


def with_words(urls: DataFrame, counts: DataFrame) -> DataFrame:
    """Adds words (array<string>) to different rows (host, path, ...): h:word for hosts, p:word for paths. Runs of
    letters are split (one letter is a word as it is), digits are NUMBER."""
    runs = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"\p{L}+|\p{N}+"), F.lit(0))
    kind = lambda k, c: F.transform(runs(F.col(c)), lambda t: F.struct(F.lit(k).alias("kind"), t.alias("token")))
    each = urls.select("host", "path", F.explode(F.concat(kind("h:", "host"), kind("p:", "path"))).alias("t")).select("host", "path", "t.*")
    letters = each.filter(F.col("token").rlike(r"^\p{L}{2}"))
    tokens = materialize(letters.groupBy("token").agg(F.count(F.lit(1)).alias("n")), "url-tokens")
    most = int(tokens.agg(F.sum("n")).first()[0] or 0) // OFTEN
    split = materialize(split_tokens(tokens, counts).join(tokens, "token"), "tokens")
    often = letters.join(F.broadcast(split.filter(F.col("n") > most)), "token")  # fewer than OFTEN tokens
    seldom = letters.join(F.broadcast(tokens.filter(F.col("n") > most).select("token")), "token", "left_anti").join(split, "token")
    named = often.unionByName(seldom).select("host", "path", F.transform("words", lambda w: F.concat("kind", w)).alias("words"))
    short = F.when(F.col("token").rlike(r"^\p{L}"), F.col("token")).otherwise(F.lit(NUMBER))
    others = each.filter(~F.col("token").rlike(r"^\p{L}{2}")).select("host", "path", F.array(F.concat("kind", short)).alias("words"))
    found = named.union(others).groupBy("host", "path").agg(F.flatten(F.collect_list("words")).alias("words"))
    return urls.join(found, ["host", "path"], "left").withColumn("words", F.coalesce("words", F.array().cast("array<string>")))


# ---------------------------------------------------------------- naive Bayes
def bucket(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "replace")) % BUCKETS


def log_odds(counts: np.ndarray, pages: np.ndarray) -> tuple[float, np.ndarray]:
    """counts: tokens by class (rows: allow, block) and bucket; pages: by class. (prior log odds, log odds by bucket); a class
    without pages: even odds."""
    if not pages.min() > 0:
        return 0.0, np.zeros(BUCKETS)
    met = counts.sum(axis=0) > 0  # other words tell nothing
    allow, block = np.log(counts + SMOOTHING) - np.log(counts.sum(axis=1, keepdims=True) + SMOOTHING * (np.count_nonzero(met) + 1))
    return float(np.log(pages[1]) - np.log(pages[0])), np.where(met, block - allow, 0.0)


def _summed(words: DataFrame, weight, masked: frozenset[str] = frozenset()) -> tuple[np.ndarray, np.ndarray]:
    """Soft counts of tokens and pages by class; weight(ids of a url's tokens, seeded): its probability to be blocked. Words of
    `masked` don't count in urls that hold one."""
    schema = pa.schema([("at", pa.int32()), ("allow", pa.float64()), ("block", pa.float64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, BUCKETS + 1))  # the last place: pages
        for part in slices(batches):
            for ws, seeded, n in zip(*(part.column(c).to_pylist() for c in ("words", "seeded", "n"))):
                ids = np.array([*(bucket(w) for w in ws if w[2:] not in masked), BUCKETS], np.int64)
                p = weight(ids[:-1], seeded)
                np.add.at(sums[1], ids, n * p)
                np.add.at(sums[0], ids, n * (1 - p))
        at = np.flatnonzero(sums.any(axis=0))
        yield batch_of(schema, at.astype(np.int32), sums[0][at], sums[1][at])

    parts = words.select("words", "seeded", "n").mapInArrow(count, "at int, allow double, block double")
    total = np.zeros((2, BUCKETS + 1))
    for r in parts.groupBy("at").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block")).collect():  # at most BUCKETS + 1
        total[:, r["at"]] = r["allow"], r["block"]
    return total[:, :BUCKETS], total[:, BUCKETS]


def fit_bayes(words: DataFrame, rounds: int = ROUNDS, seeds: tuple[str, ...] = SEEDS) -> tuple[float, np.ndarray]:
    """words: words, seeded and n (pages) by url. The first fit allows all pages without a seed and sees no seed word; each
    round of expectation maximization then gives every page, seeded or not, the probability that the model so far has for it."""
    prior, odds = log_odds(*_summed(words, lambda ids, seeded: TRUST if seeded else 0.0, frozenset(seeds)))
    for _ in range(rounds):
        sent = words.sparkSession.sparkContext.broadcast((prior, odds))  # BUCKETS doubles

        def likely(ids: np.ndarray, seeded: bool, sent=sent) -> float:
            return 1 / (1 + math.exp(-min(max(sent.value[0] + sent.value[1][ids].sum(), -30), 30)))

        prior, odds = log_odds(*_summed(words, likely))
    return prior, odds


def url_words(parts: DataFrame, pages: DataFrame, seeds: tuple[str, ...] = SEEDS) -> DataFrame:
    """(host, path, n, words, seeded) of the different urls of parts (host, path) with digits written as 0; counts are of
    all words of pages."""
    counts = materialize(word_counts(pages), "words")
    usual = 1 + int(counts.agg(F.sum("n")).first()[0] or 0) // SEED_SHARE
    own = pages.sparkSession.createDataFrame([(w, usual) for w in seeds], "word string, n long")
    counts = counts.union(own).groupBy("word").agg(F.max("n").alias("n"))
    urls = materialize(parts.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n")), "urls")
    seeded = F.arrays_overlap("words", F.array(*(F.lit(f"{k}:{w}") for w in seeds for k in "hp")))
    return with_words(urls, counts).withColumn("seeded", seeded)


def judge_urls(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, seeds: tuple[str, ...] = SEEDS) -> DataFrame:
    """page_id, host, path, rule, verdict, log_odds for every row of pages (page_id, url, html).

    Nulls: a null url has an empty host and path (verdict by the prior), a null html has no words, a null
    page_id is carried along. Repeated rows each get their row. Tokens of any length are searched whole. Other
    columns are not read. Empty table: empty result. Rules win over the classifier, which blocks where its log
    odds are above zero (a tie at zero is allowed); with no page of either class it allows all. Ties of the longest rule can't
    be: rules that fit one url and are equally long are equal.
    """
    host, path = url_parts(F.col("url").cast("string"))
    parts = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    alike = lambda c: F.regexp_replace(F.lower(F.col(c)), r"\p{N}+", "0")
    words = materialize(url_words(parts.select(alike("host").alias("host"), alike("path").alias("path")), pages, seeds), "url_words")
    prior, odds = fit_bayes(words, seeds=seeds)
    sent = pages.sparkSession.sparkContext.broadcast(odds)
    schema = pa.schema([("_host", pa.string()), ("_path", pa.string()), ("log_odds", pa.float64())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            of = sent.value
            yield batch_of(schema, part.column(0), part.column(1), [prior + float(of[list(map(bucket, ws))].sum()) if ws else prior for ws in part.column(2).to_pylist()])

    scored = words.select("host", "path", "words").mapInArrow(score, "_host string, _path string, log_odds double")
    found = parts.withColumn("_rule", matching_rule(F.col("host"), F.col("path"), rules))
    found = found.join(scored, (alike("host") == F.col("_host")) & (alike("path") == F.col("_path")))
    return found.select(
        "page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce("_rule.verdict", F.when(F.col("log_odds") > 0, "block").otherwise("allow")).alias("verdict"), "log_odds"
    )


def op1_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))
