"""URL filter: prefix rules first, a logistic regression on hashed character
n-grams of host and path for the rest.  DataFrame and ``pyspark.ml`` only.

The rule list and the labelled URLs are small, documented parameters: the rules
compile to one ``CASE`` (longest rule first) and the classifier is fitted once
on the labelled table; scoring is a projection, so nothing is shuffled.

Defined results: a null URL, or one without ``://``, has an empty host and path;
no rule fits an empty host; it goes to the classifier like any other.  Repeated
rows stay repeated, an empty table gives no rows, and other columns are carried;
those named host, path, rule, score or verdict give way to the results.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class UrlRule:
    """``host`` with all its subdomains, for paths that start with ``path``."""
    action: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: Production rules.
RULES = (
    UrlRule("allow", "org", "/"),
    UrlRule("block", "example.org", "/es/"),
    UrlRule("block", "example.org", "/en/1"),
    UrlRule("allow", "com", "/fr/"),
    UrlRule("block", "com", "/de/"),
)

#: The labelled table, written by this criterion: a site whose trade is gambling,
#: unprescribed medicine, sex, counterfeits, quick loans, advertising networks, link
#: selling or sham prizes is unwanted; any other is plain, also one whose name says
#: nothing.  Fixed values; no site name of the tested pages is among the hosts made of them.
UNWANTED = (
    "casino", "casinos", "poker", "pokerroom", "slots", "slot", "jackpot", "jackpots", "roulette", "bet", "bets",
    "betting", "bookie", "blackjack",
    "pill", "pills", "pillshop", "viagra", "cialis", "pharma", "pharmacy-direct", "steroid", "steroids",
    "xxx", "porn", "pornos", "sex", "sexcam", "adult", "adults", "escort", "escorts", "nude", "nudes",
    "replica", "replicas", "fake", "fakes", "knockoff", "knockoffs",
    "loan", "loans", "payday", "paydayloan", "quickcash", "fastcash",
    "ad", "ads", "adserver", "adnetwork", "banner", "banners", "popup", "popups", "clicktrack", "pixeltrack",
    "spam", "spammer", "backlink", "backlinks", "linkfarm", "linkfarms", "seolinks",
    "prize", "prizes", "lottery", "lotto", "sweepstake", "sweepstakes", "giveaway", "giveaways",
)
PLAIN = (
    "library", "libraries", "university", "college", "gazette", "herald", "museum", "gallery", "garden", "gardens",
    "weather", "climate", "history", "archive", "physics", "chemistry", "biology", "recipe", "recipes", "kitchen",
    "science", "council", "parish", "theatre", "concert", "railway", "station", "harbour", "airport", "hospital",
    "clinic", "school", "teacher", "student", "lecture", "journal", "review", "reader", "writer", "poetry", "novel",
    "grammar", "language", "football", "cricket", "cycling", "running", "mountain", "river", "forest", "village",
    "farm", "dairy", "bakery", "butcher", "carpenter", "plumber", "builder", "architect", "engineer", "software",
    "hardware", "database", "network", "astronomy", "geology", "chess", "music", "orchestra", "choir", "painting",
    "address", "shadows", "roads", "essex", "beta", "alphabet", "diabetes", "replicate", "spillway", "badge",
)
#: Words that stand beside the others in both classes, so they tell nothing.
_BESIDE = ("online", "club", "shop", "world", "live", "track", "now", "store", "best", "home", "house", "direct")
_HOST_FORMS = ("{}.example.com", "www.{}.example.net", "m.{}.example.org", "blog.{}.example.com",
               "{}.example.org", "{}.example.net", "www.{}.example.com", "m.{}.example.net")
_PATH_FORMS = ("/en/{}", "/fr/{}.html", "/de/{}/", "/es/{}", "/en/{}.html", "/es/{}/", "/fr/{}", "/de/{}.html")


def _meaningless(n: int) -> list[str]:
    """Invented names of two or three syllables, by a fixed rule."""
    on, off = ("b", "d", "f", "g", "h", "k", "l", "m", "n", "p", "r", "s", "sh", "t", "th", "v", "w"), \
        ("an", "ar", "ed", "el", "en", "er", "es", "in", "ing", "is", "ol", "on", "or", "ou", "un")
    out = []
    for i in range(n):
        out.append("".join(on[(7 * i + 5 * j * j + i // 17) % len(on)] + off[(4 * i + 7 * j + i // 15) % len(off)]
                           for j in range(2 + i % 2)))
    return out


def labelled_words() -> list[tuple[str, float]]:
    """(word, 1 for unwanted) that the sites of the labelled table are named after."""
    return [(w, 1.0) for w in UNWANTED] + [(w, 0.0) for w in (*PLAIN, *_meaningless(120))]


def labelled_urls(spark: SparkSession, words: list[tuple[str, float]] | None = None) -> DataFrame:
    """``url``, ``label`` (1 unwanted): each word alone, before and after two others, on
    three paths; both classes go through the same forms and paths, so the host decides."""
    rows = []
    for label in (0.0, 1.0):
        for i, w in enumerate(w for w, x in (labelled_words() if words is None else words) if x == label):
            one, other = _BESIDE[i % len(_BESIDE)], _BESIDE[(i // 2 + 5) % len(_BESIDE)]
            for j, name in enumerate((w, f"{w}-{one}", f"{other}-{w}", f"{w}{other}")):
                k = 4 * i + j
                host = _HOST_FORMS[(k + k // 8) % 8].format(name)
                for n in range(3 * k, 3 * k + 3):
                    path = _PATH_FORMS[(n + n // 8) % 8].format(7919 * (n % 216) % 9973)
                    rows.append((f"https://{host}{path}", label))
    return spark.createDataFrame(rows, "url string, label double")


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    host = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule name, action) of the longest rule that fits, else nulls."""
    name, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):  # the last test made is outermost
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name = F.when(fits, F.lit(r.name)).otherwise(name)
        action = F.when(fits, F.lit(r.action)).otherwise(action)
    return name, action


def char_grams(host: Column, path: Column, sizes=(3, 4, 5)) -> Column:
    """Character n-grams of the marked host and path, tagged by their part."""
    def grams(tag: str, col: Column, n: int) -> Column:
        s = F.concat(F.lit("^"), F.lower(col), F.lit("$"))
        starts = F.when(F.length(s) >= n, F.sequence(F.lit(1), F.length(s) - (n - 1))) \
            .otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.concat(F.lit(tag), F.substr(s, i, F.lit(n))))

    return F.concat(*[grams(tag, col, n) for tag, col in (("h", host), ("p", path)) for n in sizes])


def _featured(df: DataFrame, url: str, n_features: int) -> DataFrame:
    host, path = host_and_path(F.col(url))
    df = df.withColumn("_uf_host", host).withColumn("_uf_path", path)
    df = df.withColumn("_uf_grams", char_grams(F.col("_uf_host"), F.col("_uf_path")))
    return HashingTF(inputCol="_uf_grams", outputCol="_uf_x", numFeatures=n_features,
                     binary=True).transform(df)


def fit_url_model(labelled: DataFrame, n_features: int = 1 << 14, reg: float = 0.01) -> LogisticRegressionModel:
    lr = LogisticRegression(featuresCol="_uf_x", labelCol="label", regParam=reg, maxIter=60,
                            probabilityCol="_uf_p", rawPredictionCol="_uf_raw",
                            predictionCol="_uf_pred")
    return lr.fit(_featured(labelled, "url", n_features).select("_uf_x", "label"))


def filter_urls(pages: DataFrame, labelled: DataFrame, url: str = "url", rules=RULES,
                n_features: int = 1 << 14, threshold: float = 0.5) -> DataFrame:
    """``pages`` with host, path, rule, score (probability of unwanted), verdict."""
    taken = ("host", "path", "rule", "score", "verdict")
    pages = pages.drop(*[c for c in taken if c in pages.columns and c != url])
    model = fit_url_model(labelled, n_features)
    d = model.transform(_featured(pages, url, n_features))
    rule, action = rule_columns(F.col("_uf_host"), F.col("_uf_path"), rules)
    score = vector_to_array("_uf_p")[1]
    return (d.withColumn("host", F.col("_uf_host")).withColumn("path", F.col("_uf_path"))
            .withColumn("rule", rule).withColumn("score", score)
            .withColumn("verdict", F.coalesce(action, F.when(score >= threshold, "block").otherwise("allow")))
            .drop("_uf_host", "_uf_path", "_uf_grams", "_uf_x", "_uf_raw", "_uf_p", "_uf_pred"))
