"""URL filters in DataFrame functions: longest-prefix rules, then logistic regression on hashed
character n-grams of host and path.

Null urls and urls without "://" have an empty host and path, fit no rule and are allowed (there is
no evidence). Urls are read whole, however long. A score of just max_score (a tie) is allowed. Repeated rows
are judged each; an empty table gives an empty result; only page_id and url are read, so other columns can't
clash.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import once
from millrace.llm.common import ascii_lower, columns_of, spare

#: Rows of a labelled table that a fit reads at most, by the smallest hash of the url.
MAX_LABELLED = 20_000
#: Rules up to this number are compiled into one expression; more are joined by host suffix, with the same result.
MAX_INLINE_RULES = 500
N_BUCKETS = 1 << 14

#: The hosts of the built-in labelled table. Those that are wanted are well-known public sites, some
#: with letters that unwanted names have too.
WANTED = """nytimes.com theguardian.com reuters.com spiegel.de zeit.de elpais.com lavanguardia.com repubblica.it nrc.nl asahi.com
nature.com arxiv.org plos.org jstor.org acm.org mit.edu stanford.edu ox.ac.uk cam.ac.uk sussex.ac.uk ed.ac.uk ethz.ch tum.de unam.mx
usp.br u-tokyo.ac.jp wikipedia.org gutenberg.org archive.org loc.gov bl.uk bnf.fr nasa.gov noaa.gov nih.gov usda.gov europa.eu
service.gov.uk bund.de who.int un.org unesco.org worldbank.org redcross.org github.com python.org mozilla.org apache.org debian.org
stackoverflow.com readthedocs.io w3.org ietf.org metoffice.gov.uk espn.com olympics.com imdb.com goodreads.com allrecipes.com
lonelyplanet.com booking.com etsy.com ikea.com lego.com siemens.com philips.com mayoclinic.org nhs.uk khanacademy.org coursera.org
duolingo.com wordpress.com flickr.com vimeo.com nationalgeographic.com metmuseum.org louvre.fr adobe.com adidas.de alphabet.xyz
betterhealth.vic.gov.au tibetanreview.net scunthorpe.co.uk middlesexcounty.gov spillway.org pillarhouse.co.uk loandsend.fr
cryptogamic-botany.org camera-museum.nl trackandfield.org clickhouse.com winchester.gov.uk winterthur.ch topeka.org essen.de""".split()
UNWANTED = """royal-casino-slots.com bestpokerbonus.net casino24x.info win-casino.biz megaslots-online.com luckyjackpot777.com
freespins-casino.org onlinepokerking.net poker-deluxe.top bet-now365.com sportsbet-pro.net livebets.club bettingtipster.xyz
betwinner-bonus.com jackpotcity-slots.net gambling-zone.biz casinohub.online vegas-slot-machine.info lottery-winner.top
cheap-viagra-online.biz buycialis24.com canadian-pharmacy-meds.net pills4u.info rx-pills-discount.com viagra-generic.top
online-pharmacy-store.biz dietpills-now.com weightloss-pills.xyz cheapmeds-rx.org xxx-tube-free.com freepornhub24.net
hotsexcams.biz live-sex-cams.com adult-hookup.club escort-girls.info nude-webcams.net xxxvideos-free.top milf-porn.xyz
sexdating4free.com adultfriend-chat.biz pornstar-clips.net torrent-downloadz.com crackz-keygen.net warez-serials.info
free-crack-software.xyz keygen-zone.top torrentking.club serial-keys-free.biz nulled-scripts.net adserver-track.com
ads.clickbanner.net popup-ads.biz adtrack-click.info banner-exchange.top affiliate-tracker.net clicktrack-ads.com
trackingpixel-ads.net popunder-network.biz payday-loans-fast.com quickcash-loan.net easyloans24.biz badcredit-loans.info
instant-payday-cash.com cashadvance-loan.top bitcoin-doubler.biz crypto-getrich.com free-bitcoin-faucet.net
forex-profit-robot.info cryptogiveaway-eth.top earnmoney-fast.xyz getrichquick.club coupon-spam.net free-coupons-deals.biz
cheap-replica-watches.com replica-handbags-outlet.net fakerolex-shop.biz cheapjerseys-outlet.top louis-replica.info
phishing-login-secure.xyz secure-paypa1-login.info account-verify-bank.top appleid-unlock.biz malware-scanner-free.net
virus-alert-fix.com winner-prize-claim.club free-iphone-giveaway.top survey-rewards.xyz scam-lottery-prize.info
seo-backlinks-cheap.net buy-followers-likes.com spamblaster.biz essay-cheap-writer.net hacked-accounts.xyz""".split()
#: What follows a host.
WANTED_PATHS = """/ /en/ /de/ /fr/ /es/ /about /contact.html /index.html /news/world /2019/05/article-name.html /blog/post-title /wiki/Main_Page
/docs/guide/intro /products/item-123 /research/papers /library/catalogue /articles/4711 /en/1234 /de/987/ /fr/42.html /events /help/faq""".split()
UNWANTED_PATHS = """/ /en/ /index.php /go/click?id=99 /bonus/free-spins /casino/play-now /buy/cheap-pills /xxx/video-17 /win/prize.html /track/aff123
/deals/discount-90 /loans/apply-now /download/crack.exe /cams/live /jackpot /order/viagra /en/77 /signup/bonus""".split()


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): the host from the first "://" up to / ? # or the end with A-Z in lower case, the
    path from there up to ? # or the end; both empty for null or without "://"."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda n: F.coalesce(F.regexp_extract(url, pattern, n), F.lit(""))
    return ascii_lower(part(1)), part(2)


def _fits(host: Column, path: Column, rule_host: Column, rule_path: Column) -> Column:
    return ((host == rule_host) | F.endswith(host, F.concat(F.lit("."), rule_host))) & F.startswith(path, rule_path)


def match_rules(urls: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """urls (host, path, and more) with rule and rule_verdict of the longest rule that fits, else null.
    rules: (verdict, "host/path prefix"); of equally long rules the first in the alphabet wins, and of one rule
    with both verdicts allow."""
    rules = sorted({rule: verdict for verdict, rule in sorted(rules, reverse=True)}.items(), key=lambda r: (-len(r[0]), r[0]))
    if len(rules) > MAX_INLINE_RULES:
        return _join_rules(urls, rules)
    found = spare(urls, "__r")[0]
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in reversed(rules):
        host, slash, path = rule.partition("/")
        fits = _fits(F.col("host"), F.col("path"), F.lit(host), F.lit(slash + path))
        chosen = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chosen)
    return urls.withColumn(found, chosen).select(
        *columns_of(urls), F.col(f"{found}.rule").alias("rule"), F.col(f"{found}.verdict").alias("rule_verdict")
    )


def _join_rules(urls: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """For many rules (rule, verdict): the distinct (host, path) pairs meet the rules by each suffix of the host."""
    table = urls.sparkSession.createDataFrame(
        [(r.partition("/")[0], "/" + r.partition("/")[2] if "/" in r else "", r, v) for r, v in rules],
        "rule_host string, rule_path string, rule string, rule_verdict string",
    )
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    places = urls.select("host", "path").distinct()
    best = (
        places.select("host", "path", F.explode(suffixes).alias("rule_host"))
        .join(table, "rule_host")
        .where(F.startswith("path", F.col("rule_path")))
        .groupBy("host", "path")
        .agg(F.min(F.struct((-F.length("rule")).alias("n"), "rule", "rule_verdict")).alias("b"))
        .select("host", "path", "b.rule", "b.rule_verdict")
    )
    return urls.join(best, ["host", "path"], "left").select(*columns_of(urls), "rule", "rule_verdict")


def grams(host: Column, path: Column) -> Column:
    """Character 3- and 4-grams of host and path, marked by where they are; digits all become 0; what is shorter is one
    gram. Characters are cut once and joined with those behind them, so that the work grows with the url."""

    def of(c: Column, mark: str) -> Column:
        c = F.concat(F.lit("^"), F.regexp_replace(c, "[0-9]+", "0"), F.lit("$"))
        after = lambda x, k: F.slice(x, k + 1, F.size(x))
        join = lambda a, b: F.concat(a, b)

        def cut(ch: Column) -> Column:
            three = F.zip_with(F.zip_with(F.transform(ch, lambda x: F.concat(F.lit(mark), x)), after(ch, 1), join), after(ch, 2), join)
            both = once(three, lambda x: F.concat(F.array_compact(x), F.array_compact(F.zip_with(x, after(ch, 3), join))))
            return F.concat(both, F.when(F.size(ch) < 4, F.array(F.concat(F.lit(mark), F.array_join(ch, "")))).otherwise(F.array().cast("array<string>")))

        return once(F.split(c, ""), cut)

    return F.concat(of(host, "h:"), of(path, "p:"))


def sample_labelled(spark: SparkSession, per_host: int = 24) -> DataFrame:
    """The built-in labelled table (url, label, site): per_host urls of each fixed host, with subdomains and paths
    picked by hashes of their number, so it is the same on every machine; 1 is unwanted."""
    sites = [(h, 0) for h in WANTED] + [(h, 1) for h in UNWANTED]
    items = lambda values: F.array(*[F.lit(x) for x in values])
    pick = lambda values, salt: F.element_at(items(values), (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(values))) + 1).cast("int"))
    at = (F.col("id") % len(sites) + 1).cast("int")
    site, label = F.element_at(items([h for h, _ in sites]), at), F.element_at(items([y for _, y in sites]), at)
    lead = pick(["", "", "", "www.", "www.", "m.", "blog."], 1)
    path = F.when(label == 1, pick(UNWANTED_PATHS, 2)).otherwise(pick(WANTED_PATHS, 3))
    url = F.concat(pick(["http://", "https://"], 4), lead, site, path)
    return spark.range(len(sites) * per_host).select(url.alias("url"), label.alias("label"), site.alias("site"))


def _vectors(urls: DataFrame) -> DataFrame:
    hashing = HashingTF(numFeatures=N_BUCKETS, binary=True, inputCol="__grams", outputCol="__features")
    return hashing.transform(urls.withColumn("__grams", grams(F.col("host"), F.col("path"))))


def train(labelled: DataFrame, reg: float = 0.001, max_iter: int = 40) -> LogisticRegressionModel:
    """Logistic regression fitted to at most MAX_LABELLED rows of labelled (url, label 0/1)."""
    bounded = labelled.where("url is not null and label is not null").orderBy(F.xxhash64("url"), "url").limit(MAX_LABELLED)
    host, path = split_url(F.col("url"))
    rows = _vectors(bounded.select(host.alias("host"), path.alias("path"), F.col("label").cast("double").alias("label")))
    fit = LogisticRegression(featuresCol="__features", labelCol="label", regParam=reg, maxIter=max_iter)
    return fit.fit(rows.coalesce(1))


def judge(pages: DataFrame, rules: list[tuple[str, str]], model: LogisticRegressionModel, max_score: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block), score of each row of pages (page_id, url)."""
    host, path = split_url(F.col("url"))
    placed = match_rules(pages.select("page_id", host.alias("host"), path.alias("path")), rules)
    model.setProbabilityCol("__p").setRawPredictionCol("").setPredictionCol("")
    scored = model.transform(_vectors(placed))
    score = F.when(F.col("host") == "", F.lit(0.0)).otherwise(vector_to_array("__p")[1])
    return scored.select("page_id", "host", "path", "rule", "rule_verdict", score.alias("score")).select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("rule_verdict", F.when(F.col("score") > max_score, "block").otherwise("allow")).alias("verdict"),
        "score",
    )
