"""URL filters: rules, and logistic regression on hashed character n-grams of host and path.

Everything is a DataFrame or SQL expression. A rule (host, path, verdict) fits its host and all subdomains where the
url's path starts with the rule's; the longest rule wins. Other urls get the model's verdict. The model is trained from
a small labelled table: n-grams are hashed into ``BUCKETS`` counts and fitted by penalised logistic regression.

The hosts of the labelled table are made of common words by kind of site; none is taken from tables that are to be judged.

Defined cases: a null url, or one without ``://``, has an empty host and path, fits no rule and is judged by the model
on empty features (its intercept); a very long url is read whole; repeated rows are judged each; an empty table gives an
empty result; other columns pass through ``judge``, and its host, path, rule, score and verdict take the place of columns
of these names.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BUCKETS = 4_096
GRAMS = (3, 4, 5)
PENALTY = 0.01
#: (host, path, verdict); a rule's name is host + path.
RULES = (
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
)
#: Words of the labelled table by kind of site, from common knowledge of such names; written without the tables it judges.
BLOCK_WORDS = {
    "gambling": "blackjack roulette baccarat jackpot wager bookie bookmaker lotto bingo holdem pokies craps slotmachine punters",
    "pharmacy": "viagra cialis tramadol xanax ambien steroids pharmarx noscript phentermine valium levitra painkiller dietslim nootropic",
    "erotic": "porn porno erotica escorts camgirls nude nudes hentai fetish milf hotgirls striptease sexcam playmates",
    "junk": "backlinks autoblog doorway clickbait linkexchange seoboost trafficbot bulkmailer articlespin massmail followers likesbuy massposts emailblast",
    "marketing": "popunder popups banner adbroker adclick affiliate doubleclix retarget impressions sponsorlink pixeltag clickthru adnetwork promoclick",
    "piracy": "warez torrents keygen cracked serials nulled fullrip seedbox camrip illegaldl unlockcode pirated leeching megaripz",
    "fraud": "phishing verifyaccount paydayloan quickcash replicas rolexcopy miracle getrich cryptodouble instantloan luckyprize giveaway forex ponzi",
}
ALLOW_WORDS = {
    "learning": "school university college campus academy faculty lectures syllabus students teachers science physics chemistry biology",
    "reading": "library archive museum books journal press gazette herald chronicle editor poetry novel essays publisher",
    "public": "council city ministry court police parliament embassy transit railway harbour citizens census borough county",
    "health": "hospital clinic nurses dentist surgery medicine cancer-care wellbeing paediatrics hospice therapy nutrition midwife optician",
    "home": "garden kitchen recipes baking knitting carpentry pottery family parents pets housing cottage furniture orchard",
    "software": "docs developer python kernel compiler database openssl manual wiki forum tutorial packages release projects",
    "nature": "weather climate ocean forest birds wildlife geology mountain river volcano astronomy botany insects glacier",
}
#: What stands around a host word, alike for both kinds, and paths, which differ.
PREFIXES, DOMAINS = ("", "www.", "blog.", "m."), ("example.com", "example.org", "example.net")
BLOCK_PATHS = (
    "/promo/signup-bonus", "/order/no-prescription", "/go/redirect.php", "/landing/offer-today", "/join/vip-members", "/download/setup-crack.exe", "/click?aff=7", "/live/girls-online",
    "/deal/limited-discount", "/jackpot/play-now", "/account/verify-login", "/buy/order-online",
)
ALLOW_PATHS = (
    "/about", "/docs/install.html", "/news/2021/05/opening", "/wiki/History_of_science", "/articles/12", "/contact", "/research/papers/3.pdf", "/events/calendar",
    "/lessons/reading", "/staff/directory", "/blog/2019/notes", "/index.html",
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    after = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.regexp_extract(after, "^([^/?#]*)", 1)
    return F.when(F.instr(url, "://") > 0, F.translate(host, _UPPER, _LOWER)).otherwise("")


def path_of(url: Column) -> Column:
    after = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(after, "^[^/?#]*([^?#]*)", 1)).otherwise("")


def rule_name(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, or null."""
    out = F.lit(None).cast("string")
    for rule_host, rule_path, _ in sorted(rules, key=lambda r: len(r[0] + r[1])):  # the longest is asked first
        fits = F.concat(F.lit("."), host).endswith("." + rule_host) & path.startswith(rule_path)
        out = F.when(fits, rule_host + rule_path).otherwise(out)
    return out


def _grams(kind: str, text: Column, n: int) -> Column:
    """The hashed n-grams of ``text``, from an array of its characters, so that a long one costs no more a character."""
    starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - (n - 1))).otherwise(F.array().cast("array<int>"))
    hashed = lambda c: F.transform(starts, lambda i: F.pmod(F.xxhash64(F.lit(kind), F.array_join(F.slice(c, i, n), "")), F.lit(BUCKETS)).cast("int"))
    return F.flatten(F.transform(F.array(F.split(text, "")), hashed))


def buckets_of(host: Column, path: Column) -> Column:
    """The hashed n-grams of host and of path, each framed so that its ends show, as an array of distinct buckets."""
    framed = [("h", F.concat(F.lit("^"), host, F.lit("$"))), ("p", F.concat(F.lit("^"), path, F.lit("$")))]
    return F.array_distinct(F.concat(*[_grams(kind, text, n) for kind, text in framed for n in GRAMS]))


def labelled_hosts(words: dict[str, str]) -> list[str]:
    """Each word alone, and each beside two others of its kind, joined or with a dash."""
    out = []
    for kind in words.values():
        w = kind.split()
        out += w + [w[i] + w[(i + 1) % len(w)] for i in range(len(w))] + [w[i] + "-" + w[(i + 3) % len(w)] for i in range(len(w))]
    return out


def labelled_urls(spark: SparkSession, block: dict[str, str] = BLOCK_WORDS, allow: dict[str, str] = ALLOW_WORDS) -> DataFrame:
    """The small labelled table: url, label (1 block, 0 allow). A host has two urls: a path of its class, and a number."""
    rows = []
    for label, words, paths in ((1, block, BLOCK_PATHS), (0, allow, ALLOW_PATHS)):
        for i, host in enumerate(labelled_hosts(words)):
            for j, path in enumerate((paths[i % len(paths)], f"/{i % 50}")):
                place = PREFIXES[(i + j) % len(PREFIXES)] + host + "." + DOMAINS[(i + 2 * j) % len(DOMAINS)]
                rows.append(f"('https://{place}{path}', {label}D)")
    return spark.sql(f"SELECT url, label FROM VALUES {', '.join(rows)} AS t(url, label)")


def train(labelled: DataFrame) -> tuple[list[float], float]:
    """Weights of the buckets and the intercept, from url and label (a table of bounded size)."""
    found = labelled.select("label", F.transform(buckets_of(host_of(F.col("url")), path_of(F.col("url"))), lambda b: b.cast("string")).alias("b"))
    seen = CountVectorizer(inputCol="b", outputCol="features", binary=True, vocabSize=BUCKETS).fit(found)  # the buckets in use, as sparse vectors
    model = LogisticRegression(regParam=PENALTY, elasticNetParam=0.0, standardization=False, maxIter=20)
    fitted = model.fit(seen.transform(found).select("label", "features").coalesce(1))
    weights = [0.0] * BUCKETS
    for bucket, weight in zip(seen.vocabulary, fitted.coefficients, strict=True):
        weights[int(bucket)] = float(weight)
    return weights, float(fitted.intercept)


def judge(pages: DataFrame, weights: list[float], intercept: float, rules=RULES, url_col: str = "url") -> DataFrame:
    """``pages`` with host, path, rule, score (log-odds of block) and verdict."""
    url = pages[url_col]
    out = pages.withColumns({"host": host_of(url), "path": path_of(url)})
    table = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")  # folded to one literal
    grams = buckets_of(F.col("host"), F.col("path"))
    score = F.aggregate(grams, F.lit(float(intercept)), lambda s, b: s + F.element_at(table, b + 1))
    verdicts = F.create_map(*[F.lit(x) for h, p, v in rules for x in (h + p, v)])
    out = out.withColumns({"rule": rule_name(F.col("host"), F.col("path"), rules), "score": score})
    return out.withColumn("verdict", F.coalesce(F.element_at(verdicts, F.col("rule")), F.when(F.col("score") > 0, "block").otherwise("allow")))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights, intercept = train(labelled_urls(spark))
    pages = common.read(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, weights, intercept).select("page_id", "host", "path", "rule", "verdict", F.round("score", 6).alias("score"))
