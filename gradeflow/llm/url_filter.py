"""URL filters: host and path rules, and a logistic regression on hashed character n-grams for the rest.

DataFrame and Spark ML operations alone; a model is fitted on a small labelled table of URLs.
"""

from __future__ import annotations

from random import Random

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rules up to this many become one CASE expression; more are joined by the suffixes of hosts.
CASES = 200
#: Lengths of character n-grams and number of hashed features.
GRAMS, FEATURES = (3, 4, 5), 1 << 16

# The labelled table is made from these words of unwanted and of wanted sites; any others would do.
UNWANTED = """
casino kasino casinos roulette blackjack poker slots jackpot bingo lotto bet bets betting sportsbet odds bookie wager gamble gambling
porn porno xxx nude nudes naked erotic escort camgirls hentai fetish milf hookup sexcam adult webcams
viagra cialis pills pharma pharmacy tramadol steroids painkiller dietpill slimming
payday fastloan quickcash easymoney freemoney giveaway prizes winner sweepstakes doubler getrich cryptoprofit
adserver ads adclick banner popup popunder tracker tracking pixel affiliate clickbait
backlinks linkfarm spam bulkmail followers likes trafficbot doorway
malware phishing keygen warez cracked keylogger trojan botnet ransom
replica counterfeit fakewatch knockoff
""".split()
WANTED = """
library science weather news city garden recipes museum history archive school river walks maps poetry health language
music theory birds chess engineering council travel guide forum photo physics biology chemistry math geography atlas
university faculty lecture journal article paper research institute hospital clinic dental doctor bakery kitchen cooking
football tennis cycling hiking climbing sailing theatre cinema opera orchestra gallery design fashion furniture carpentry
software developer docs manual tutorial database network linux python compiler hardware robotics energy solar water
forest farm animal zoo ocean climate geology space astronomy law court parliament election budget tax insurance bank
market shop store books comics stories novel essay letters diary family children toys games puzzle craft knitting
hotel railway airport bus harbour bridge street village region county embassy culture festival heritage church
""".split()
EITHER = "best my top online new super the free world daily easy big first express direct center hub zone club portal".split()
SYLLABLES = "ba ke lo mi nu ra se ti vo wa de fi go hu ja ne pu ri sa to ul er an os in".split()
ZONES = "com net org info io de fr es eu co.uk example.com example.org".split()
FORMS = ("{a}-{b}", "{a}{b}", "{e}-{a}", "{a}-{e}", "{a}{e}", "{e}{a}", "{a}{n}", "{a}", "{a}.{m}", "{m}-{a}", "{a}-{m}", "{a}.{e}-{m}")


def labelled_urls(spark: SparkSession, unwanted: list[str] | None = None, wanted: list[str] | None = None, each: int = 24, seed: int = 1) -> DataFrame:
    """(url, label): 1 for unwanted; some seven thousand rows, ``each`` for a word, drawn from the word lists by a rule.

    A word stands in the host, alone or with another of its kind, a common word or a made-up name, or in the
    path of a site with a made-up name; hosts of made-up names alone are wanted.
    """
    rng, rows = Random(seed), []
    lists = (WANTED if wanted is None else wanted, UNWANTED if unwanted is None else unwanted)
    made = lambda: "".join(rng.choices(SYLLABLES, k=rng.randint(2, 4)))

    def add(host: str, steps: list[str], label: int) -> None:
        steps = steps + rng.choices([made(), "en", "de", "fr", "index.html", str(rng.randint(1, 99999)), "page", rng.choice(WANTED)], k=rng.randint(0, 3))
        rows.append((f"http{rng.choice(('', 's'))}://{rng.choice(('', '', 'www.', 'm.', 'blog.'))}{host}.{rng.choice(ZONES)}/{'/'.join(steps)}", float(label)))

    for label, words in enumerate(lists):
        for word in words:
            for k in range(each):
                parts = {"a": word, "b": rng.choice(words), "e": rng.choice(EITHER), "m": made(), "n": rng.randint(1, 999)}
                if k % 4:
                    add(rng.choice(FORMS).format(**parts), [], label)
                else:
                    add(made(), [word if k % 8 else f"{parts['e']}-{word}"], label)
    for _ in range(40 * each):
        add(made() if rng.random() < 0.7 else f"{rng.choice(EITHER)}-{made()}", [], 0)
    return spark.createDataFrame(rows, "url string, label double")


def url_parts(urls: DataFrame) -> DataFrame:
    """With ``host`` (after the first ``://`` up to ``/ ? #``, A-Z lower-cased) and ``path`` (then up to ``? #``); both empty for null or no ``://``."""
    url = F.coalesce(F.col("url"), F.lit(""))
    host = F.translate(F.regexp_extract(url, r"://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return urls.withColumn("host", host).withColumn("path", F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1))


def grams() -> F.Column:
    """Character n-grams of host and path, marked at both ends, runs of digits as one 0; an empty url has none."""
    text = F.concat(F.lit("^"), F.col("host"), F.lit("|"), F.regexp_replace(F.lower("path"), "[0-9]+", "0"), F.lit("$"))

    def cut(n: int) -> F.Column:
        # Spark gives a function of two arguments the place as well, so n is bound here
        return F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    return F.when(F.length("host") + F.length("path") > 0, F.array_distinct(F.concat(*map(cut, GRAMS)))).otherwise(F.array().cast("array<string>"))


def fit(labelled: DataFrame) -> PipelineModel:
    """The regression on ``labelled`` (url, label: 1 for block)."""
    # a small table: in two tasks the sums of each step stay small as well
    rows = url_parts(labelled).withColumn("_grams", grams()).coalesce(2)
    hashing = HashingTF(inputCol="_grams", outputCol="_features", numFeatures=FEATURES, binary=True)
    return Pipeline(stages=[hashing, LogisticRegression(featuresCol="_features", labelCol="label", probabilityCol="_p", predictionCol="_y", rawPredictionCol="_raw", regParam=0.0001, maxIter=50, standardization=False)]).fit(rows)


def matched(parts: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """``parts`` with ``rule`` (host + path) and ``rule_verdict`` of the longest rule (host, path, verdict) that fits; nulls if none.

    A rule fits its host and all subdomains, if the path starts with the rule's; of equal length, the first by text.
    Of rules with the same host and path the first given counts.
    """
    once = {(host, path): said for host, path, said in reversed(rules)}
    ranked = sorted(((host, path, said) for (host, path), said in once.items()), key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))
    if len(ranked) <= CASES:
        rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
        for host, path, said in reversed(ranked):
            fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
            rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
        return parts.withColumn("rule", rule).withColumn("rule_verdict", verdict)
    spark = parts.sparkSession
    table = spark.createDataFrame([(h, p, h + p, v) for h, p, v in ranked], "_host string, _path string, _rule string, _said string")
    pairs = parts.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    met = pairs.withColumn("_host", F.explode(ends)).join(table, "_host").filter(F.col("path").startswith(F.col("_path")))
    best = met.groupBy("host", "path").agg(F.min(F.struct((-F.length("_rule")).alias("n"), F.col("_rule").alias("rule"), F.col("_said").alias("said"))).alias("best"))
    return parts.join(best, ["host", "path"], "left").select(*parts.columns, F.col("best.rule").alias("rule"), F.col("best.said").alias("rule_verdict"))


def judge(urls: DataFrame, rules: list[tuple[str, str, str]], model: PipelineModel, threshold: float = 0.5) -> DataFrame:
    """``urls`` (with ``url``) with host, path, rule, verdict (``allow`` or ``block``) and score (chance of block).

    The rule's verdict if one fits, else the model's. Null and malformed urls have an empty host
    and path, fit no rule and get the model's answer for no n-grams; urls of any length are read
    whole. Rows are kept one for one, repeated ones alike, and an empty table stays empty; own columns of
    these names are replaced.
    """
    rows = matched(url_parts(urls), rules).withColumn("_grams", grams())
    scored = model.transform(rows).withColumn("score", vector_to_array("_p")[1])
    own = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return scored.withColumn("verdict", F.coalesce("rule_verdict", own)).drop("_grams", "_features", "_p", "_y", "_raw", "rule_verdict")
