"""URL filters: rules, and naive Bayes over segmented host names.

A host's labels are often words run together. They are split by the most likely
sequence of words under a unigram model (Viterbi): a public word list in the order
of frequency, its share falling with the rank, and all tokens of all urls, counted;
and for what neither holds a price that rises with the length. Words of one or two
letters don't take part in splitting unless a name below has them: they'd cut
ordinary words up.

A multinomial naive Bayes with add-one smoothing, fitted on the labelled names
below, scores the words of host and path. The tables hold no labelled urls, so it is
carried on to the table's own words by one round of expectation and maximisation:
each url counts for its words by the odds it is unwanted, and a word that isn't
among the names speaks if the urls that have it lean clearly to one side. Other
words say nothing, nor do a host's last label and prefixes such as www and blog.

The rules come first: a rule (host, path, verdict) fits its host and all its
subdomains if the url's path starts with the rule's, and the longest that fits
decides. Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end,
A-Z lower-cased; path: from there up to ``?``, ``#`` or the end.

A null url, or one without ``://``, has an empty host and path; no rule fits it
and its verdict is allow. Very long urls are judged whole. Repeated rows are judged
alike. Of splittings that cost the same the one with the shorter last known word
stands, of rules that fit with the same length the last by name. An empty table gives
an empty result. Other columns are not read.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import exp, log

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evisift.llm.common import table
from evisift.storage import materialize

RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Labelled names: words that unwanted hosts and paths are made of, and words of ordinary ones.
BLOCKED = (
    "online casino bonus", "best poker slots", "jackpot spin win", "sports betting odds", "place bets online", "bet now", "slots free spin", "roulette blackjack table",
    "gambling bookmaker tips", "buy cheap meds", "viagra pills shop", "diet pills deal", "cheap viagra", "steroids without prescription", "payday loan fast", "instant loans no credit",
    "get rich quick", "binary options profit", "crypto doubler", "free porn", "porn tube", "adult sex cams", "adult videos", "xxx videos", "sexy nude girls", "hot singles dating",
    "escort girls", "hookup tonight", "milf webcam", "erotic massage", "click bait ads", "popup ads server", "tracking pixel", "track clicks", "banner ads network", "adserver",
    "doubleclick tracker", "spam mailer", "link farm", "spam links network", "replica watches sale", "fake designer bags", "free gift winner", "free iphone prize", "lottery prize claim",
    "keygen crack download", "warez torrent", "pirated movies stream", "phish login verify", "phishing kit", "malware loader", "trojan exploit", "fake reviews buy", "buy followers likes",
    "seo backlinks cheap", "miracle weight loss", "scam investment",
)
ALLOWED = (
    "news daily", "city library", "open science journal", "school of music", "health clinic", "public records", "garden club", "travel guide", "history museum",
    "weather report", "recipe book", "software docs", "online shop", "book store", "art gallery", "research group", "student forum", "local sports team",
    "free software", "photo album", "data portal", "help center", "support desk", "article archive", "community wiki", "code review", "film review", "job board",
    "market report", "law firm", "engineering notes", "mail server", "farm fresh food", "win back time", "cheap flights guide", "track and field", "video lectures",
    "adult education", "pharmacy college", "credit union", "bank branch", "university press", "football club", "running track", "dairy farm", "family farm", "loan library",
    "fast trains", "network engineering", "web server guide", "watch repair", "gift shop", "music download", "movie theater", "girls school", "hotel booking", "pixel art",
    "weight training", "investment bank", "tips for parents", "best books", "table tennis", "stream ecology", "prize for literature", "online courses", "ski resort",
    "city council", "fire department", "church choir", "animal shelter", "car rental", "real estate", "kitchen design", "chess club", "language school", "bicycle repair",
    "river valley", "mountain hiking", "green energy", "solar power", "baby clothes", "coffee roasters", "wine cellar", "bakery", "dental care", "hospital", "insurance",
    "programming tutorial", "linux kernel", "open data", "maps", "radio station", "theatre festival", "orchestra", "botanical garden", "zoo", "aquarium", "airport", "railway",
)
#: A public vocabulary of words in the order of frequency, read by the driver; tokens that it counts for, and by how many ranks its head is flattened.
LEXICON, PRIOR, FLAT = "/opt/tokenizers/word_bpe_49k.json", 50_000, 200
#: Leading labels of hosts that tell how a site is served, not what it is: no evidence if another label but the last follows.
PREFIX = re.compile(r"(www\d*|m|mobile|blogs?|amp|cdn|static|img|web)\Z")
#: Words of the lexicon besides the given ones, at most: the most frequent of the table's. The letters of a word.
LEARNT, LETTERS = 200_000, 32
#: What the table's words say: urls without a lean that every word is taken to have besides its own, and the least and the most log odds of a word.
SMOOTH, LEAST_ODDS, MOST_ODDS = 4.0, 1.0, 2.0
TOKEN = re.compile(r"[a-z]+")


def parts(url: str | None) -> tuple[str, str]:
    """Host and path."""
    at = url.find("://") if url is not None else -1
    if at < 0:
        return "", ""
    rest = re.split(r"[?#]", url[at + 3 :], maxsplit=1)[0]
    host, slash, path = rest.partition("/")
    return re.sub("[A-Z]+", lambda m: m[0].lower(), host), slash + path


def rule_for(host: str, path: str, rules: tuple = RULES) -> tuple[str, str] | None:
    """(name, verdict) of the longest rule that fits."""
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else None


def common_words(path: str = LEXICON) -> dict[str, float]:
    """Words of three letters or more of a vocabulary file with word ends, each with the tokens that it counts for, by Zipf and Mandelbrot."""
    with open(path, "rb") as f:  # noqa: PTH123  the driver's own copy of the vocabulary
        vocabulary = json.load(f)["model"]["vocab"]
    words = [w[:-4] for w in sorted(vocabulary, key=vocabulary.get) if re.fullmatch(r"[a-z]{3,32}</w>", w)]
    share = [1 / (r + FLAT) for r in range(len(words))]
    whole = sum(share)
    return {w: PRIOR * s / whole for w, s in zip(words, share, strict=True)}


@dataclass
class NameModel:
    """Unigram costs of the lexicon and the log ratios of naive Bayes."""

    counts: dict[str, int]
    #: Tokens that the counts are of, also of words that they don't hold.
    tokens: int | None = None
    blocked: tuple[str, ...] = BLOCKED
    allowed: tuple[str, ...] = ALLOWED
    general: dict[str, float] = field(default_factory=dict)
    #: Log odds of words that aren't among the names.
    learnt: dict[str, float] = field(default_factory=dict)
    cost: dict[str, float] = field(init=False)
    ratio: dict[str, float] = field(init=False)
    kept: dict[str, list[str]] = field(init=False, default_factory=dict)

    def __post_init__(self) -> None:
        bad, good = (Counter(w for name in names for w in name.split()) for names in (self.blocked, self.allowed))
        words = set(bad) | set(good)
        lexicon = words | set(self.general) | {w for w in self.counts if 2 < len(w) <= LETTERS}
        total = len(lexicon) + sum(self.general.values()) + (sum(self.counts.values()) if self.tokens is None else self.tokens)
        self.cost = {w: -log((self.counts.get(w, 0) + self.general.get(w, 0.0) + 1) / total) for w in lexicon}
        self.unknown = log(total) + 2.0
        self.longest = max(map(len, lexicon), default=1)
        n_bad, n_good = sum(bad.values()) + len(words), sum(good.values()) + len(words)
        self.ratio = self.learnt | {w: log((bad[w] + 1) / n_bad) - log((good[w] + 1) / n_good) for w in words}

    def segment(self, name: str) -> list[str]:
        """The likeliest words of a name of letters. A stretch outside of the lexicon costs ``unknown`` and two nats a letter."""
        if name in self.kept:
            return self.kept[name]
        n = len(name)
        # a state is a position and whether the last letter belongs to an unknown stretch
        known, open_ = [(0.0, None)] + [(float("inf"), None)] * n, [(float("inf"), None)] * (n + 1)
        for i in range(1, n + 1):
            open_[i] = min((known[i - 1][0] + self.unknown + 2.0, (i - 1, 0)), (open_[i - 1][0] + 2.0, (i - 1, 1)))
            for j in range(max(0, i - self.longest), i):
                c = self.cost.get(name[j:i])
                if c is not None:
                    best, kind = min((known[j][0], 0), (open_[j][0], 1))
                    known[i] = min(known[i], (best + c, (j, kind)))
        out, i, kind, end = [], n, 0 if known[n][0] <= open_[n][0] else 1, n
        while i:
            j, before = (known if kind == 0 else open_)[i][1]
            if kind == 0 or before == 0:
                out.append(name[j:end])
                end = j
            i, kind = j, before
        out.reverse()
        if len(self.kept) < 100_000 and n <= LETTERS:
            self.kept[name] = out
        return out

    def words(self, host: str, path: str) -> list[str]:
        labels = host.split(".")
        while len(labels) > 2 and PREFIX.match(labels[0]):
            labels.pop(0)
        if len(labels) > 1:  # the last label is no name
            labels.pop()
        return [w for name in TOKEN.findall(".".join(labels)) + TOKEN.findall(path.lower()) for w in self.segment(name)]

    def score(self, host: str, path: str) -> float:
        """Log odds that a url is unwanted, with equal priors."""
        return sum(self.ratio.get(w, 0.0) for w in self.words(host, path))


def lean(unwanted: float, n: float) -> float:
    """Log odds that a word adds if n urls have it, of which so many are expected to be unwanted; 0 if they don't lean clearly."""
    share = (unwanted + SMOOTH / 2) / (n + SMOOTH)
    odds = log(share / (1 - share))
    return 0.0 if abs(odds) < LEAST_ODDS else max(-MOST_ODDS, min(MOST_ODDS, odds))


def fit_names(pages: DataFrame, url_col: str = "url", blocked: tuple[str, ...] = BLOCKED, allowed: tuple[str, ...] = ALLOWED, lexicon: str = LEXICON) -> NameModel:
    """A model whose words are counted over all tokens of all urls: a token is what stands between characters other than letters.

    The given words (the labelled names' and the lexicon's) are counted first, where
    they stand alone. Under these counts each distinct token is split, and all pieces
    are counted, so that names run together count for their parts and a stretch that
    no given word covers is a new word. Under those counts every url is split and
    scored, and its words get its odds. At most one row a given word and twice LEARNT
    rows come to the driver.
    """
    spark = pages.sparkSession
    general = common_words(lexicon)
    given = {w for n in blocked + allowed for w in n.split()} | set(general)
    tokens = pages.select(F.explode(F.split(F.lower(url_col), "[^a-z]+")).alias("w")).filter("w <> ''").groupBy("w").agg(F.count("*").alias("n"))
    tokens = materialize(tokens, "tokens")
    total = tokens.agg(F.sum("n")).first()[0] or 0
    names = spark.createDataFrame(pa.table({"w": sorted(given)}))
    alone = {r["w"]: r["n"] for r in tokens.join(F.broadcast(names), "w").collect()}
    first = spark.sparkContext.broadcast(NameModel(alone, total, blocked, allowed, general))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = first.value
        for b in batches:
            out = Counter()
            for token, n in zip(b.column("w").to_pylist(), b.column("n").to_pylist(), strict=True):
                for w in model.segment(token):
                    out[w] += n
            yield pa.RecordBatch.from_arrays([pa.array(out.keys(), pa.string()), pa.array([w in model.general or w in model.ratio for w in out], pa.bool_()), pa.array(out.values(), pa.int64())], ["w", "given", "n"])

    pieces = materialize(tokens.mapInArrow(split, "w string, given boolean, n bigint").groupBy("w", "given").agg(F.sum("n").alias("n")), "pieces")
    sums = pieces.agg(F.sum("n")).first()[0] or 0
    kept = pieces.filter(F.length("w") <= LETTERS).orderBy(F.desc("given"), F.desc("n"), "w").limit(LEARNT + len(given))
    counts = {r["w"]: r["n"] for r in kept.collect()}
    model = NameModel(counts, sums, blocked, allowed, general)
    second = spark.sparkContext.broadcast(model)

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = second.value
        for b in batches:
            bad, every = Counter(), Counter()
            for url in b.column("url").to_pylist():
                words = set(model.words(*parts(url)))
                p = 1 / (1 + exp(-max(-30.0, min(30.0, sum(model.ratio.get(w, 0.0) for w in words)))))
                for w in words:
                    if w not in model.ratio and len(w) <= LETTERS:
                        bad[w] += round(p * 1e6)  # whole numbers: their sums don't depend on the order
                        every[w] += 1
            yield pa.RecordBatch.from_arrays([pa.array(every.keys(), pa.string()), pa.array([bad[w] for w in every], pa.int64()), pa.array(every.values(), pa.int64())], ["w", "bad", "n"])

    leans = pages.select(F.col(url_col).alias("url")).mapInArrow(expect, "w string, bad bigint, n bigint").groupBy("w").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    share = (F.col("bad") / 1e6 + SMOOTH / 2) / (F.col("n") + SMOOTH)
    leans = leans.filter(F.abs(F.log(share / (1 - share))) >= LEAST_ODDS).orderBy(F.desc("n"), "w").limit(LEARNT)
    learnt = {r["w"]: lean(r["bad"] / 1e6, r["n"]) for r in leans.collect()}
    first.unpersist()
    second.unpersist()
    return NameModel(counts, sums, blocked, allowed, general, learnt)


def judge(pages: DataFrame, rules: tuple = RULES, blocked: tuple[str, ...] = BLOCKED, allowed: tuple[str, ...] = ALLOWED, lexicon: str = LEXICON, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of pages: its id, host, path, rule (null if none fits), verdict and the words' log odds."""
    shared = pages.sparkSession.sparkContext.broadcast(fit_names(pages, url_col, blocked, allowed, lexicon))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            out = []
            for url in b.column("url").to_pylist():
                host, path = parts(url)
                fits, odds = rule_for(host, path, rules), model.score(host, path)
                out.append((host, path, fits[0] if fits else None, fits[1] if fits else "block" if odds > 0 else "allow", odds))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array(c, pa.string()) for c in cols[:4]), pa.array(cols[4], pa.float64())], ["id", "host", "path", "rule", "verdict", "log_odds"])

    out = rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, host string, path string, rule string, verdict string, log_odds double")
    return out.withColumnRenamed("id", id_col)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"))
