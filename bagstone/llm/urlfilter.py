"""URL filter: rules first, then logistic regression on hashed n-grams.

The host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the
end, with A-Z lower-cased; the path is what follows it up to ``?``, ``#`` or
the end. A rule (host and path prefix) fits its host and all subdomains; of
those that fit, the longest decides. Other URLs are judged by a logistic
regression on the hashed character 3- and 4-grams of host and path. The model
is fitted on the driver from at most `MAX_LABELLED` labelled URLs (a parameter);
their features come from the same expression that scores pages. Scoring runs in
DataFrame functions: each n-gram's hash picks a weight from an array.

Defined cases: a null URL, or one without ``://``, has an empty host and path
and is judged by the model's intercept. Labelled rows with a null are not used.
Without both classes among them the model allows everything. Repeated rows give
one result row each; only the id and URL columns are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bagstone.llm.common import lower_ascii

#: Rules of the contract: verdict, host, path prefix. Fixed values.
RULES: list[tuple[str, str, str]] = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]
WIDTH = 4096
GRAMS = (3, 4)
MAX_LABELLED = 5_000
#: Blocking takes more than a balance of odds: a wrong block loses a page for good.
BLOCK_FROM = 0.8

#: Words of unwanted and of ordinary hosts, by what such hosts are commonly called; the labelled table pairs them with
#: the same paths and prefixes, so that only the words tell them apart. None is a host of the tables at hand; the
#: ordinary ones hold look-alikes of the unwanted.
UNWANTED = (
    "online-casino", "casino-royal", "casino-bonus", "slots-casino", "poker-online", "win-jackpot", "win-prizes", "big-win", "lotto-win", "sports-betting", "betting-odds", "best-bets", "live-bets", "bets-online", "bookie-bets",
    "viagra-shop", "cialis-online", "cheap-meds", "cheap-viagra", "diet-pills", "pills-online", "pills-shop", "no-rx-pharmacy", "replica-watches", "cheap-replica", "fake-rolex", "payday-loans", "quick-loans", "get-rich-quick",
    "xxx-videos", "xxx-cams", "porn-tube", "hot-porn", "adult-cams", "adult-videos", "adult-dating", "adult-chat", "sexcams", "hot-singles", "escort-girls", "nude-pics", "x-rated",
    "spam-links", "spam-mailer", "bulk-spam", "spamhost", "link-farm", "click-farm", "content-farm", "seo-farm", "ads-server", "ads-click", "pop-ads", "adserv", "ad-tracker", "click-track", "track-clicks", "tracking-pixel", "ads-network", "banner-ads",
    "crack-keygen", "serials-crack", "warez-downloads", "free-iphone", "free-giveaway", "free-casino", "free-porn", "malware-host", "phishing-login", "bitcoin-doubler",
)
ORDINARY = (
    "news", "daily-news", "wiki", "library", "public-library", "city-council", "university", "open-data", "garden-club", "weather", "museum", "art-museum", "school", "primary-school", "cooking", "recipes", "travel-notes", "science", "history", "health-info", "bookshop",
    "music-review", "long-walks", "maths", "cheese-makers", "farming-today", "dairy-farm", "farmers-market", "free-software", "freedom", "adult-education", "track-and-field", "railway-tracks", "addresses", "roads", "winter-sports", "windows-help", "better-homes", "alphabet", "diabetes-care", "pillows", "pillars",
    "thornton", "other-voices", "northern-star", "the-herald", "thatched-roofs", "theatre", "theory", "threads", "thistle", "station", "nations", "fiction", "education", "translations", "holiday-inn", "birding", "sewing", "trading-post", "harbour", "lighthouse", "astronomy", "chess", "choir", "cycling", "gardening",
    "geology", "hospital", "island-ferry", "journal", "kitchen", "knitting", "language-lab", "law-review", "maps", "mountains", "nature", "ocean", "opera", "orchestra", "photography", "physics", "poetry", "radio", "rivers", "sailing", "seeds", "society", "swimming", "tennis", "tourism", "transport", "trees", "village", "volunteers", "zoology",
)
_PREFIXES = ("", "www.", "m.", "blog.")
_PATHS = ("/en/12", "/fr/7.html", "/de/301/", "/es/88", "")


def labelled_urls(spark: SparkSession, without: frozenset[str] = frozenset()) -> DataFrame:
    """The built-in labelled table: url, bad; without some names, for tests."""
    rows = [
        (f"https://{_PREFIXES[(k + j) % 4]}{name}.example.{tld}{_PATHS[(k + j) % 5]}", bad)
        for bad, names in ((1, UNWANTED), (0, ORDINARY))
        for k, name in enumerate(n for n in names if n not in without)
        for j, tld in enumerate(("com", "org", "net"))
    ]
    return spark.createDataFrame(rows, "url string, bad int")


def _rest(url: Column) -> Column:
    """What follows the first ://, or an empty string."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(F.coalesce(_rest(url), F.lit("")), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(_rest(url), F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]], part: int) -> Column:
    """Part 0 (verdict) or the name, host and path joined, of the longest rule
    that fits, else null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1], r[2])):
        fits = ((host == rule[1]) | host.endswith("." + rule[1])) & path.startswith(rule[2])
        out = F.when(fits, F.lit(rule[0] if part == 0 else rule[1] + rule[2])).otherwise(out)
    return out


def slots(host: Column, path: Column, width: int = WIDTH) -> Column:
    """The distinct hashed n-grams of the host, then of the path, as 0-based
    slots; a leading and a closing mark make ends visible."""

    def grams(kind: str, part: Column, n: int) -> Column:
        marked = F.concat(F.lit("^"), part, F.lit("$"))
        at = F.sequence(F.lit(1), F.greatest(F.length(marked) - (n - 1), F.lit(1)))
        return F.transform(at, lambda i: F.pmod(F.xxhash64(F.concat(F.lit(kind), F.substring(marked, i, F.lit(n)))), F.lit(width)).cast("int"))

    return F.array_distinct(F.concat(*(grams(kind, part, n) for kind, part in (("h", host), ("p", path)) for n in GRAMS)))


def fit(labelled: DataFrame, width: int = WIDTH, passes: int = 40, l2: float = 1e-4, max_labelled: int = MAX_LABELLED) -> tuple[list[float], float]:
    """weights and intercept, from a small labelled table (url, bad), of which
    at most max_labelled rows are used, those with the smallest hash."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    usable = labelled.where("url IS NOT NULL AND bad IN (0, 1)").select("url", "bad")
    rows = usable.orderBy(F.xxhash64("url"), "url", "bad").limit(max_labelled).select(slots(host, path, width).alias("x"), "bad").collect()
    good, bad = sum(not r["bad"] for r in rows), sum(r["bad"] for r in rows)
    weights, intercept = [0.0] * width, 0.0
    if not good or not bad:
        return weights, -1.0
    squares, square = [1e-8] * width, 1e-8
    for _ in range(passes):  # AdaGrad, in one order
        for r in rows:
            z = intercept + sum(weights[i] for i in r["x"])
            off = (1 / (1 + math.exp(-max(-50.0, min(50.0, z)))) - r["bad"]) * (len(rows) / 2 / (bad if r["bad"] else good))
            square += off * off
            intercept -= 0.1 * off / math.sqrt(square)
            for i in r["x"]:
                g = off + l2 * weights[i]
                squares[i] += g * g
                weights[i] -= 0.1 * g / math.sqrt(squares[i])
    return weights, intercept


def judge(pages: DataFrame, model: tuple[list[float], float], rules: list[tuple[str, str, str]] | None = None, id_col: str = "page_id", url_col: str = "url", block_from: float = BLOCK_FROM) -> DataFrame:
    """A row per input row: page_id, host, path, rule, verdict, p_block."""
    rules = RULES if rules is None else rules
    weights, intercept = model
    url = F.col(f"`{url_col}`")
    parts = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    host, path = F.col("host"), F.col("path")
    array = F.lit([float(w) for w in weights])
    margin = F.aggregate(slots(host, path, len(weights)), F.lit(float(intercept)), lambda acc, i: acc + F.get(array, i))
    scored = parts.select("page_id", "host", "path", rule_of(host, path, rules, 1).alias("rule"), rule_of(host, path, rules, 0).alias("ruled"), (1 / (1 + F.exp(-margin))).alias("p_block"))
    learned = F.when(F.col("p_block") >= block_from, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", learned).alias("verdict"), "p_block")
