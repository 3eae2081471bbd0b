"""URL filter: host and path rules first, else logistic regression on hashed character n-grams.

``judge`` is native: only DataFrame functions. The model is trained by MLlib (JVM) on a small labelled
URL table that comes with the call; ``SEED_URLS`` is the default. Its words do not come from any test table.

Defined results: a null url, or one without ``://``, has empty host and path, fits no rule and is judged
by the model's intercept; very long urls are read whole; duplicates are judged alike; an empty table gives
an empty result; extra columns are dropped.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, columns_of

BUCKETS = 4096          # hashed n-gram space
GRAMS = (3, 4)          # n-gram lengths
MAX_RULES = 1000        # rules are literals of the plan, so their number is bounded
MAX_SEEDS = 10_000      # labelled urls

#: Small labelled url table: words of unwanted and of ordinary hosts, written down from general knowledge, set into a few url shapes.
BLOCK_WORDS = tuple("""casino-royal online-casino poker-room slots-jackpot sports-betting bets-online lottery-winner roulette-club blackjack-vip
viagra-store pharmacy-discount diet-pills pills-express steroids-shop weight-loss-fast miracle-cure cheap-meds payday-loan quick-cash loans-instant credit-repair
forex-signals crypto-doubler bitcoin-generator get-rich make-money-fast adult-chat adult-videos xxx-tube porn-hd sex-cams escort-dates hot-singles nude-pics
torrent-movies warez-download crack-keygen serial-keys free-streams pirate-films replica-watch fake-designer cheap-handbags outlet-cheap spam-mailer bulk-spam
link-farm content-farm click-bait click-tracker ads-server pixel-track popup-ads tracking-ads buy-followers buy-likes free-iphone free-giftcards win-prize
casino-bonus win-money prize-winner survey-reward lucky-draw phishing-login virus-alert free-ringtones""".split())
ALLOW_WORDS = tuple("""news weather library museum university school garden recipes cooking travel history science physics biology chemistry mathematics
medicine hospital government parliament council court economy business finance insurance engineering software hardware developer documentation wiki
encyclopedia dictionary language literature books poetry music orchestra theatre cinema art gallery photography design architecture football tennis
athletics cycling hiking mountain river ocean forest wildlife birds farming village city region island bridge railway airport ferry road energy
water climate solar research journal institute foundation charity community forum blog diary magazine radio television podcast teacher student children
family health kitchen bakery coffee market workshop carpenter gardener thoughts other reader then north earth""".split())
SHAPES = ("https://www.{}.example.com/en/{}.html", "http://{}.example.net/de/{}/", "https://blog.{}.example.net/fr/{}?page=2",
          "http://m.{}.example.com/es/{}")


def seed_urls(block: tuple[str, ...], allow: tuple[str, ...]) -> list[tuple[str, int]]:
    return [(s.format(w, 17 * i + 3), y) for y, words in ((1, block), (0, allow)) for i, w in enumerate(words) for s in SHAPES]


SEED_URLS = seed_urls(BLOCK_WORDS, ALLOW_WORDS)


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): host after the first ``://`` up to / ? # or end, A-Z lowered; path then up to ? # or end."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), path


def grams(host: Column, path: Column) -> Column:
    """Character n-grams of host and path (digits of the path read as 0); each text is closed by marks."""
    def cut(s: Column, mark: str) -> Column:
        def of(c: Column) -> Column:  # c: the characters, bound once a row, so that long urls cost linear time
            def grams_of(n: int) -> Column:
                return F.transform(F.sequence(F.lit(0), F.greatest(F.size(c) - n, F.lit(0))),
                                   lambda i: F.concat(F.lit(mark), *[F.coalesce(F.get(c, i + k), F.lit("")) for k in range(n)]))
            return F.concat(*map(grams_of, GRAMS))
        return F.get(F.transform(F.array(F.split(F.concat(F.lit("^"), s, F.lit("$")), "")), of), 0)
    return F.concat(cut(host, "h"), cut(F.translate(path, "123456789", "000000000"), "p"))


def _features(rows: DataFrame) -> DataFrame:
    host, path = split_url(F.col("url"))
    return rows.select("*", host.alias("host"), path.alias("path")).withColumn("grams", grams(F.col("host"), F.col("path")))


def fit(labelled: DataFrame, reg: float = 0.003) -> PipelineModel:
    """p(block) from (url, label), by MLlib in the JVM. The table must be small (MAX_SEEDS rows)."""
    rows = columns_of(labelled, url="string", label="double").where("url IS NOT NULL AND label IS NOT NULL")
    if rows.limit(MAX_SEEDS + 1).count() > MAX_SEEDS:
        raise ValueError(f"more than {MAX_SEEDS} labelled urls")
    x = _features(rows).select("label", "grams").coalesce(1).persist()
    try:
        return Pipeline(stages=[HashingTF(numFeatures=BUCKETS, binary=True, inputCol="grams", outputCol="features"),
                                LogisticRegression(regParam=reg, maxIter=50, standardization=False)]).fit(x)
    finally:
        x.unpersist()


def seeds(spark: SparkSession, urls: list[tuple[str, int]] | None = None) -> DataFrame:
    """The fixed list above (or ``urls``), sent as literals of the plan."""
    rows = SEED_URLS if urls is None else urls
    return spark.sql("SELECT inline(array(" + ", ".join(f"struct('{u}' AS url, {float(y)}D AS label)" for u, y in rows) + "))")


def rule_columns(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, null where none fits. A rule is 'host/path'."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, act in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # the longest is tested first: it is nested last
        h, _, p = text.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(act)).otherwise(verdict)
    return rule, verdict


def judge(pages: DataFrame, rules: list[tuple[str, str]], model: PipelineModel, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, p_block."""
    rows = model.transform(_features(columns_of(pages, page_id="long", url="string")))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    return rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("by_rule"),
                       F.get(vector_to_array("probability"), 1).alias("p_block")) \
        .withColumn("verdict", F.coalesce("by_rule", F.when(F.col("p_block") >= threshold, "block").otherwise("allow"))) \
        .select("page_id", "host", "path", "rule", "verdict", "p_block")
