"""URL filters: rules by host and path, and logistic regression on hashed character n-grams, in DataFrame functions only.

The regression is trained from a small labelled table of URLs. Its weights are sums of the labelled URLs' features, so
it is trained by one number for each of these (the dual form of gradient descent, from zero, with weight decay): their
Gram matrix comes from a join of their features, and the epochs run inside one expression over its rows. The weights,
one for each bucket, are then part of the scoring expression: pages are judged where they are, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GRAMS = (3, 4)
BUCKETS = 4096
EPOCHS = 500
RATE = 0.003
DECAY = 0.0005
MOST_LABELLED = 500  # rows of the labelled table; more are an error, none are left out
# The rules' hosts and paths, and what they say.
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
# Labels made by hand: words of hosts that a filter for training data blocks (gambling, adult pages, drugs, quick money, bait,
# copies and cracks, advertising), and words of hosts that it allows. None is a word of a host of the given tables.
BLOCKED_WORDS = """bet betting bettor wager slot slots jackpot poker roulette blackjack bingo lotto lottery gamble gambling gambler casinos odds
porn porno xxx sex sexy nude nudes escort fetish milf erotic webcam camgirl hentai hookup dating
viagra cialis pill pharma pharmacy meds drugs steroid steroids slimming detox weightloss
loan loans payday cash money rich forex crypto bitcoin profit payout earn
freebie cheapest discount deal deals promo coupon winner winning prize prizes giveaway bonus bargain
replica replicas fake fakes warez crack cracked keygen serial torrent torrents pirate hack hacked cheats
spammer adserver advert adverts click clicks clickbait popup popups tracker tracking traffic redirect seo backlink leads affiliate""".split()
ALLOWED_WORDS = """news blog docs wiki library museum weather school city health recipes travel science history music garden forum archive letters theatre
river mountain bread stone paper north winter thunder reading nation tender shore bird watch old maps map forest lake valley bridge
village church castle harbour island ocean summer spring autumn flower tree rose oak maple apple orange lemon kitchen cooking baking
bakery coffee tea wine cheese farmers market street house home family children teacher student college university research physics
chemistry biology math language grammar poetry poems novel books bookshop press journal magazine radio film cinema photo painting gallery
artist design craft wood metal glass pottery sewing knitting running cycling hiking sailing fishing climbing football tennis chess
animals horse cat dog fox wolf bear eagle insects fossils stars planet space rocket engine train railway airport council hospital""".split()
COMMON_GROUPS = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()


def hosts(words: list[str], steps: tuple[int, ...]) -> list[str]:
    """Each word with those some steps further on, with a hyphen or without."""
    n = len(words)
    return [f"{word}{'-' if (i + k) % 3 else ''}{words[(i * step + k + 1) % n]}" for k, step in enumerate(steps) for i, word in enumerate(words) if words[(i * step + k + 1) % n] != word]


def labelled_urls(spark: SparkSession, left_out: frozenset[str] = frozenset()) -> DataFrame:
    """url, label (1: block), at most MOST_LABELLED rows: hosts made of the words above but those left out, and of common
    groups of letters, with some schemes, subdomains, ends and paths, which are alike for both labels."""
    bad, good = ([w for w in words if w not in left_out] for words in (BLOCKED_WORDS, ALLOWED_WORDS))
    ends = ("com/en/118", "net/fr/402.html", "org/de/635/", "net/en/951", "com/es/77", "org/fr/246", "com/", "org", "net/index.html?p=3", "com/a/b/c")
    leads = ("http://", "https://", "http://www.", "https://www.", "https://blog.", "http://m.")
    blocked = hosts(bad, (7,)) + bad[::2]
    letters = [a + COMMON_GROUPS[(7 * i + 3) % len(COMMON_GROUPS)] + COMMON_GROUPS[(11 * i + 8) % len(COMMON_GROUPS)] for i, a in enumerate(COMMON_GROUPS)]
    allowed = hosts(good, (5, 9)) + good[::4] + letters
    rows = [(f"{leads[(i * 5 + label) % len(leads)]}{host}.example.{ends[(i * 7 + label) % len(ends)]}", label) for label, some in ((1, blocked), (0, allowed)) for i, host in enumerate(some)]
    text = F.lit("\n".join(f"{label} {url}" for url, label in rows))
    lines = spark.range(1).select(F.explode(F.split(text, "\n")).alias("line"))
    return lines.select(F.substring("line", 3, 1000).alias("url"), F.substring("line", 1, 1).cast("int").alias("label"))


def host_of(url: Column) -> Column:
    """What follows the first :// up to /, ?, # or the end, A to Z lower-cased; empty if there is none."""
    host = F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ? or # or the end."""
    return F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def features(host: Column, path: Column, buckets: int = BUCKETS) -> Column:
    """The different buckets of the n-grams of host and path, each with its bounds marked."""

    def grams(text: Column, mark: str, n: int) -> Column:
        whole = F.concat(F.lit("^"), text, F.lit("$"))
        starts = F.when(F.length(whole) >= n, F.sequence(F.lit(1), F.length(whole) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.pmod(F.xxhash64(F.lit(mark), F.substring(whole, i, n)), F.lit(buckets)).cast("int"))

    return F.array_distinct(F.concat(*[grams(text, mark, n) for text, mark in ((host, "h"), (path, "p")) for n in GRAMS]))


def train(labelled: DataFrame, buckets: int = BUCKETS) -> list[float]:
    """The bias and a weight for each bucket. Rows with a null label don't count; a null URL is an empty one; without
    rows of both labels all is zero."""
    rows = labelled.filter("label is not null").select(F.coalesce("url", F.lit("")).alias("url"), F.col("label").cast("double").alias("y"))
    rows = rows.groupBy("url").agg(F.max("y").alias("y")).select("y", "url", features(host_of(F.col("url")), path_of(F.col("url")), buckets).alias("x"))
    n, kinds = rows.agg(F.count("*"), F.countDistinct("y")).first()
    if n > MOST_LABELLED:
        raise ValueError(f"{n} labelled URLs; at most {MOST_LABELLED} are allowed")
    if kinds < 2:
        return [0.0] * (buckets + 1)
    single = rows.select("url", "y", F.explode("x").alias("b"))
    other = single.select(F.col("url").alias("to"), "b")
    gram = single.join(other, "b").groupBy("url", "y", "to").agg(F.count("*").cast("double").alias("k"))
    # a row of the matrix for each URL, in the order of the URLs; the bias is a feature that all have
    gram = gram.unionByName(rows.select("url", "y").join(F.broadcast(rows.select(F.col("url").alias("to"))), F.lit(True)).withColumn("k", F.lit(1.0)))  # at most MOST_LABELLED squared
    gram = gram.groupBy("url", "y", "to").agg(F.sum("k").alias("k")).groupBy("url", "y").agg(F.transform(F.sort_array(F.collect_list(F.struct("to", "k"))), lambda s: s["k"]).alias("k"))
    whole = gram.agg(F.sort_array(F.collect_list(F.struct("url", "y", "k"))).alias("m"))
    ys, ks, urls = F.transform("m", lambda r: r["y"]), F.transform("m", lambda r: r["k"]), F.transform("m", lambda r: r["url"])
    whole = whole.select(ys.alias("y"), ks.alias("k"), urls.alias("url"))

    def epoch(a: Column, _: Column) -> Column:
        z = F.transform(F.col("k"), lambda row: F.aggregate(F.zip_with(row, a, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v))
        step = F.zip_with(F.col("y"), z, lambda y, v: F.lit(RATE) * (y - F.lit(1.0) / (F.lit(1.0) + F.exp(-v))))
        return F.zip_with(a, step, lambda p, q: p * (1 - DECAY) + q)

    solved = whole.select(F.explode(F.arrays_zip("url", F.aggregate(F.sequence(F.lit(1), F.lit(EPOCHS)), F.transform(F.col("y"), lambda _: F.lit(0.0)), epoch).alias("a"))).alias("s")).select("s.url", "s.a")
    weights = rows.join(solved, "url").select(F.explode(F.concat(F.array(F.lit(-1)), "x")).alias("b"), "a").groupBy("b").agg(F.sum("a").alias("w")).collect()  # at most buckets + 1 rows
    out = [0.0] * (buckets + 1)
    for bucket, weight in weights:
        out[bucket + 1] = weight
    return out


def scored(host: Column, path: Column, weights: list[float]) -> Column:
    """The log-odds of block."""
    table = F.split(F.lit(",".join(map(repr, weights[1:]))), ",").cast("array<double>")
    return F.aggregate(features(host, path, len(weights) - 1), F.lit(weights[0]), lambda s, b: s + F.get(table, b))


def judge(pages: DataFrame, weights: list[float], rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and the regression's log-odds for each row.

    A rule fits its host and all subdomains, if the path starts with the rule's; the longest rule wins, then the first.
    Null URLs and those without :// have an empty host and path and the method's verdict on these; repeated rows and
    null page_ids stay; an empty table gives no rows; other columns are left out.
    """
    host, path = F.col("host"), F.col("path")
    split = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, said = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, begin, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(begin)
        rule, said = F.when(fits, F.lit(name + begin)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(said)
    judged = split.select("*", rule.alias("rule"), said.alias("said"), scored(host, path, weights).alias("log_odds"))
    verdict = F.coalesce("said", F.when(F.col("log_odds") > 0, "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "log_odds")
