"""URL filters: rules come first; else host names are cut into words by a unigram Viterbi, and naive Bayes scores the words of host and path."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.llm.runtime import ascii_lower, cut, cut_slim, join_by_key

#: Verdict and rule; a rule is a host, which stands for its subdomains too, and the beginning of a path.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Words that mark a host as unwanted for training.
SEEDS = ("adult", "ads", "advert", "bet", "bets", "betting", "casino", "cheap", "drugs", "escort", "gambling", "jackpot", "loans", "pills", "poker", "porn", "replica", "sex", "slots", "spam", "viagra", "warez", "xxx")
#: Rules that a row looks through, letters of the longest word, and how many tokens of all hosts and paths a class is taken to have beforehand.
MAX_RULES, LONGEST, BACKGROUND = 1000, 20, 2.0
#: Shares of all words: of each seed at least, and of unknown words, which goes down tenfold with each letter.
SEED_SHARE, UNKNOWN_SHARE = 2e-4, 1e-2
NAME = r"[^\x00-\x60\x7B-\x7F]+"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both are empty where it is null or has no ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def best_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """struct(size, rule, verdict) of the longest rule that fits; of equally long ones the greatest in code-point order; null if none fits."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"over {MAX_RULES} rules")
    fits = [F.lit(None).cast("struct<size:int,rule:string,verdict:string>")]
    for verdict, rule in rules:
        of, _, begin = rule.partition("/")
        here = ((host == of) | F.endswith(host, F.lit(f".{of}"))) & F.startswith(path, F.lit(f"/{begin}"))
        fits.append(F.when(here, F.struct(F.lit(len(rule)).alias("size"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.array_max(F.array_compact(F.array(*fits)))


def names_of(text: Column) -> Column:
    """Runs of lower-case letters."""
    return F.regexp_extract_all(text, F.lit(NAME), F.lit(0))


def cut_name(name: str, found: list[tuple[int, int, float]]) -> list[str]:
    """The likeliest words that make up a name, the longer last word of equally likely ones. found has (begin, letters, share) of the
    parts that are known words; any other part is an unknown word."""
    log = {(b, k): math.log(share) for b, k, share in found}
    best, last = [0.0], [0]
    for end in range(1, len(name) + 1):
        score, begin = max((best[b] + log.get((b, end - b), math.log(UNKNOWN_SHARE) - (end - b) * math.log(10)), -b) for b in range(max(0, end - LONGEST), end))
        best.append(score)
        last.append(-begin)
    words, end = [], len(name)
    while end:
        words.append(name[last[end] : end])
        end = last[end]
    return words[::-1]


def segmented(names: DataFrame, words: DataFrame) -> DataFrame:
    """(name, words) of the distinct names, by the shares (word, share) of known words; parts of names meet words by a join."""
    begins = F.sequence(F.lit(0), F.char_length("name") - 1)
    lengths = F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.char_length("name") - F.col("b")))
    parts = names.select("name", F.explode(begins).alias("b")).select("name", "b", F.explode(lengths).alias("k"))
    parts = parts.withColumn("word", F.substring("name", F.col("b") + 1, F.col("k"))).join(words, "word")
    found = parts.groupBy("name").agg(F.collect_list(F.struct("b", "k", "share")).alias("found"))

    @F.pandas_udf("array<string>")
    def cut_names(names: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([cut_name(n, [] if f is None else [(x["b"], x["k"], x["share"]) for x in f]) for n, f in zip(names, found, strict=True)])

    return names.join(found, "name", "left").select("name", cut_names("name", "found").alias("words"))


def word_shares(pages: DataFrame, hosts: DataFrame, text_col: str, seeds: tuple[str, ...]) -> DataFrame:
    """(word, share) of what the pages show and what the hosts themselves divide, such as the parts of names with hyphens."""
    labels = hosts.select(F.explode(F.split("host", r"\.")).alias("label")).select(names_of(F.col("label")).alias("names")).where(F.size("names") > 1)
    counts = cut(page_words(pages, text_col).unionByName(labels.select(F.explode("names").alias("word"))).groupBy("word").agg(F.count("*").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 1
    seeded = pages.sparkSession.createDataFrame([(s, SEED_SHARE) for s in seeds], "word string, share double")
    return counts.select("word", (F.col("n") / total).alias("share")).unionByName(seeded).groupBy("word").agg(F.max("share").alias("share"))


def page_words(pages: DataFrame, text_col: str) -> DataFrame:
    """(word) of the letters of all pages outside markup, words of LONGEST letters at most."""
    text = ascii_lower(F.regexp_replace(text_col, "<[^>]*>", " "))
    return pages.select(F.explode(names_of(text)).alias("word")).where(F.char_length("word") <= LONGEST)


def _summed(rows: DataFrame, weights: DataFrame, keys: list[str]) -> DataFrame:
    """The weights of the tokens of each key added up."""
    return join_by_key(rows, weights, ["token"], "n").groupBy(*keys).agg(F.sum("weight").alias("weight"))


def site_scores(sites: DataFrame, hosts: DataFrame, seeds: tuple[str, ...]) -> DataFrame:
    """(host, path, n, score) of distinct (host, path, n); hosts has the words of each host and how many sites it has.

    A host with a seed teaches the class of what is unwanted, with all its words and paths; the other hosts teach the other. A
    token's share in a class is that of multinomial naive Bayes with BACKGROUND tokens as frequent as overall. score is the
    logarithm of the odds, over 0 for what is unwanted."""
    hosts = cut_slim(hosts.withColumn("unwanted", F.arrays_overlap("words", F.array(*map(F.lit, seeds)))))
    of_host = hosts.select("host", "sites", "unwanted", F.explode(F.transform("words", lambda w: F.concat(F.lit("h:"), w))).alias("token"))
    labelled = join_by_key(sites, hosts.select("host", "sites", "unwanted"), ["host"], "sites")
    of_path = labelled.select("host", "path", "unwanted", F.explode(F.transform(names_of(ascii_lower(F.col("path"))), lambda w: F.concat(F.lit("p:"), w))).alias("token"))
    of_path = cut(of_path)
    sums = of_host.select("token", "unwanted", F.col("sites").alias("n")).unionByName(of_path.select("token", "unwanted", F.lit(1).cast("long").alias("n")))
    by_token = cut_slim(sums.groupBy("token").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("unwanted"), F.col("n")).otherwise(0)).alias("bad")))
    all_n, all_bad = by_token.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    rows, bad_rows = hosts.agg(F.coalesce(F.sum("sites"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("unwanted"), F.col("sites")).otherwise(0)), F.lit(0))).first()
    prior = math.log((bad_rows + 1) / (rows - bad_rows + 1))
    common = BACKGROUND * F.col("n") / max(all_n, 1)
    weight = F.log((F.col("bad") + common) / (all_bad + BACKGROUND)) - F.log((F.col("n") - F.col("bad") + common) / (all_n - all_bad + BACKGROUND))
    weights = by_token.select("token", "n", weight.alias("weight"))
    by_host = _summed(of_host.select("host", "token"), weights, ["host"]).withColumnRenamed("weight", "host_weight")
    by_host = hosts.select("host", "sites").join(by_host, "host", "left")
    by_path = _summed(of_path.select("host", "path", "token"), weights, ["host", "path"])
    score = prior + F.coalesce("host_weight", F.lit(0.0)) + F.coalesce("weight", F.lit(0.0))
    return join_by_key(sites, by_host, ["host"], "sites").join(by_path, ["host", "path"], "left").select("host", "path", "n", score.alias("score"))


def judge_urls(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, seeds: tuple[str, ...] = SEEDS, id_col: str = "page_id", url_col: str = "url", text_col: str = "html") -> DataFrame:
    """(id, host, path, rule, verdict, score): the verdict of the longest rule that fits a url, or else that of its score.

    Words are learned from the texts of all pages and the divided names of all hosts, and the seeds are words too; every distinct
    host and path teaches once. A null url and one without :// have an empty host and path, which no rule fits, and the prior
    odds for a score; null texts have no words; repeated rows and ids stay as they are; an empty table gives no rows. Other columns are not looked at."""
    host, path = url_parts(F.col(url_col))
    rows = pages.select(F.col(id_col).alias(id_col), host.alias("host"), path.alias("path"))
    sites = cut(rows.groupBy("host", "path").agg(F.count("*").alias("n")))
    hosts = cut_slim(sites.groupBy("host").agg(F.count("*").alias("sites")).withColumn("names", names_of(F.col("host"))))
    of_name = hosts.select("host", F.posexplode("names").alias("at", "name"))
    names = cut_slim(of_name.groupBy("name").agg(F.count("*").alias("hosts")))
    cut_names = segmented(names.select("name"), word_shares(pages, hosts, text_col, seeds)).join(names, "name")
    parts = join_by_key(of_name, cut_names, ["name"], "hosts").groupBy("host").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "words"))), lambda x: x["words"])).alias("words"))
    hosts = hosts.select("host", "sites").join(parts, "host", "left").withColumn("words", F.coalesce("words", F.array().cast("array<string>")))
    scores = site_scores(sites, hosts, seeds)
    judged = scores.withColumn("fit", best_rule(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce("fit.verdict", F.when(F.col("score") > 0, "block").otherwise("allow"))
    judged = judged.select("host", "path", "n", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), "score")
    return join_by_key(rows, judged, ["host", "path"], "n").select(id_col, "host", "path", "rule", "verdict", "score")
