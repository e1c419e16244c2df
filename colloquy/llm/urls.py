"""URL filters: allow and block rules by host and path, and for the rest a logistic regression on hashed n-grams.

Everything is DataFrame work: hosts and paths are cut by built-in functions, the rules are one literal array that is
filtered a row, and features are ``HashingTF`` vectors of character n-grams (``LENGTHS``), those of the host and those
of the path apart. The regression is Spark's own, fitted on a small table of labelled URLs (``LABELLED``, at most
``MOST_LABELLED`` rows). The pages are read once and nothing of theirs is shuffled.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LENGTHS, FEATURES, PENALTY, ROUNDS, MOST_LABELLED = (3, 4, 5), 1 << 14, 2e-3, 100, 100_000

#: (verdict, host, path) of the contract.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))

#: Hosts of labelled URLs: advertising, gambling, adult pages, sham shops and link farms; and ordinary ones.
BLOCKED_HOSTS = """
casino-royal.example lucky-casino.example m.casino-star.example www.casino-luck.example poker-win.example jackpot-win.example win-big.example blog.slots-win.example
sport-bets.example www.bets-online.example free-spins.example m.live-bets.example free-coins.example www.free-gift.example free-money.example blog.free-prize.example
adult-video.example www.adult-chat.example m.adult-site.example adult-world.example x-adult.example xxx-tube.example
spam-link.example www.link-farm.example blog.spam-page.example seo-farm.example spam-ring.example m.spam-blast.example
diet-pills.example www.cheap-drugs.example buy-pills.example m.pills-shop.example cheap-watch.example blog.cheap-meds.example cheap-loans.example
ads-server.example www.track-user.example ads-click.example m.click-track.example blog.ads-banner.example pop-ads.example ads-stream.example
""".split()
ALLOWED_HOSTS = """
www.city-news.example news.harbour.example m.evening.example daily.mountain.example library.example www.museum.example blog.garden.example blog.kitchen.example
docs.python.example wiki.forest.example www.school.example m.weather.example www.railway.example theatre.example orchestra.example thunder.example www.lantern.example
nation.example blog.station.example m.tradition.example section.example ration.example blog.motion.example fashion.example british.example
www.shelter.example together.example blog.feather.example leather.example other.example m.whether.example this-that.example
rinse.example inland.example www.ermine.example heron.example m.handle.example restore.example trash-sort.example www.fresh.example
thanks.example blog.threshold.example ondine.example www.thimble.example m.thousand.example history.example wishing.example blog.shining.example table.example
www.tool-shop.example chess-online.example live-music.example home-page.example data-server.example m.camp-site.example watch-maker.example sheep-farm.example royal-park.example
""".split()
#: Paths that say nothing: every host above has each of them. Then paths that tell, on hosts that do not.
PATHS = ("", "/", "/en/12", "/fr/345.html", "/de/6789/", "/es/0")
BLOCKED_PATHS = "/casino/slots /bets/odds /free/prize /adult/cam /cheap/pills /ads/banner /track/pixel /spam/links".split()
ALLOWED_PATHS = "/news/world /library/books /garden/roses /wiki/Oak /weather/today /school/maths /docs/guide /museum/hours".split()
LABELLED = [(f"https://{h}{p}", y) for hosts, y in ((BLOCKED_HOSTS, 1.0), (ALLOWED_HOSTS, 0.0)) for h in hosts for p in PATHS]
LABELLED += [(f"http://{h}{p}", y) for paths, y in ((BLOCKED_PATHS, 1.0), (ALLOWED_PATHS, 0.0)) for h in ("site.example", "www.page.example") for p in paths]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end (A-Z lower-cased), and then up to ``?`` or ``#``.

    Both are empty for null and where there is no ``://``.
    """
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules) -> Column:
    """The (rule, verdict) that fits: its host is ``host`` or a domain above it and its path begins ``path``.

    The longest rule wins; of equally long ones that with the longer host, then block, then the first by code point. Null
    where none fits. The rules are a list of the caller's, tried one by one for each URL.
    """
    order = sorted({(v, h.translate(str.maketrans(_UPPER, _LOWER)), p) for v, h, p in rules}, key=lambda r: (-len(r[1]) - len(r[2]), -len(r[1]), r[0] != "block", r))
    if not order:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    table = F.array(*[F.struct(F.lit(h).alias("host"), F.lit("." + h).alias("below"), F.lit(p).alias("path"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")) for v, h, p in order])
    fits = lambda r: ((host == r["host"]) | F.endswith(host, r["below"])) & F.startswith(path, r["path"])
    found = F.get(F.filter(table, fits), F.lit(0))
    return F.when(found.isNotNull(), F.struct(found["rule"].alias("rule"), found["verdict"].alias("verdict")))


def _grams(chars: str, mark: str) -> Column:
    """All character n-grams of a column of single characters, marked with their field."""
    c = F.col(chars)

    def of_length(n: int) -> Column:
        start = F.when(F.size(c) >= n, F.sequence(F.lit(0), F.size(c) - n)).otherwise(F.array().cast("array<int>"))
        return F.transform(start, lambda i: F.concat(F.lit(mark), *[F.get(c, i + k) for k in range(n)]))

    return F.concat(*map(of_length, LENGTHS))


def with_grams(rows: DataFrame) -> DataFrame:
    """Column ``_grams`` of the columns ``host`` and ``path``; characters are cut once a row, in a step of their own."""
    split = lambda c: F.split(F.concat(F.lit("^"), c, F.lit("$")), "")
    cut = rows.withColumns({"_host": split(F.col("host")), "_path": split(F.col("path"))})
    return cut.withColumn("_grams", F.concat(_grams("_host", "h"), _grams("_path", "p"))).drop("_host", "_path")


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The small labelled table: url, label (1: block)."""
    return spark.createDataFrame(LABELLED, "url string, label double")


def fit(labelled: DataFrame) -> PipelineModel | None:
    """The regression over the labelled URLs (url, label); None where they are not of both labels.

    Rows with a null label do not count, repeated ones do. More than ``MOST_LABELLED`` rows are too many for a small
    table and an error.
    """
    rows = labelled.where("label is not null").select("url", F.col("label").cast("double").alias("label"))
    seen = rows.agg(F.count("*").alias("n"), F.min("label").alias("least"), F.max("label").alias("most")).first()
    if seen.n > MOST_LABELLED:
        raise ValueError(f"the labelled table has {seen.n} rows; {MOST_LABELLED} are the most")
    if seen.n == 0 or seen.least == seen.most:
        return None
    host, path = host_and_path(F.col("url"))
    rows = with_grams(rows.select("label", host.alias("host"), path.alias("path"))).coalesce(1).sortWithinPartitions("label", "host", "path")
    features = HashingTF(inputCol="_grams", outputCol="_features", numFeatures=FEATURES, binary=True)
    model = LogisticRegression(featuresCol="_features", labelCol="label", predictionCol="_blocked", rawPredictionCol="_raw", probabilityCol="_probability", regParam=PENALTY, maxIter=ROUNDS)
    return PipelineModel([features, model.fit(features.transform(rows))])


def judge(pages: DataFrame, labelled: DataFrame | None = None, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block) of every row of ``pages``.

    The longest rule that fits decides, and where none fits the regression does. A null URL and one without ``://`` have
    an empty host and path, fit no rule and get the regression's verdict on nothing; a labelled table of one label only
    (or none) blocks what it says (nothing). Repeated rows are judged each, other columns are ignored, null ids pass.
    """
    model = fit(labelled if labelled is not None else labelled_urls(pages.sparkSession))
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("_rule", longest_rule(F.col("host"), F.col("path"), rules))
    if model is None:
        only = labelled.agg(F.max("label")).first()[0]
        rows = rows.withColumn("_blocked", F.lit(float(only or 0)))
    else:
        rows = model.transform(with_grams(rows))
    learnt = F.when(F.col("_blocked") > 0.5, "block").otherwise("allow")
    return rows.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce("_rule.verdict", learnt).alias("verdict"))
