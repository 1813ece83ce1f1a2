"""URL filter: rules first, then a ratio of two character models learned from what the rules decide.

Each distinct URL is read as its UTF-8 bytes. The URLs that a rule allows train one Markov
model and those that a rule blocks the other. A byte is predicted from the longest context
seen, at most ORDER bytes, blended with all shorter ones (Witten-Bell): as many contexts as
the data have, with no cap. The mean over a URL's bytes of the difference of the two
log-likelihoods is its score. A quarter of the decided URLs is kept from training; the
threshold with the least sum of their two error rates is the verdict's.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineseek.llm.common import join_counted
from lineseek.runtime import BROADCAST_ROWS, materialize

# Verdict and where it holds: a host with its subdomains, and the beginning of the path.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
# Bytes of context at most.
ORDER = 5
SYMBOLS = 256
# Log-likelihoods are summed as whole millionths, so that no order of adding matters.
SCALE = 1_000_000
# Scores are cut at hundredths, and beyond this many not told apart, when the threshold is sought.
PER_NAT, MOST_BIN = 100, 10_000
# Decided URLs whose MD5 begins with one of these set the threshold and train nothing.
CALIBRATION = "0123"
# Bytes of a URL listed at once.
RUN = 4096


def host_of(url: Column) -> Column:
    found = F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit(""))
    return F.translate(found, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """The longest rule that fits, as struct (rule, verdict); nulls where none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    # A later `when` is tried last: the longest rule is put on last, around the others.
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        domain, slash, rest = rule.partition("/")
        fits = ((host == domain) | F.endswith(host, F.lit(f".{domain}"))) & F.startswith(path, F.lit(slash + rest))
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def distinct_urls(pages: DataFrame, rules: tuple) -> DataFrame:
    """url, uid, uses (rows), side (1 allowed by a rule, 0 blocked, else null), trains. Null counts as empty."""
    urls = pages.groupBy("_url").agg(F.count("*").alias("uses"))
    verdict = rule_of(host_of(F.col("_url")), path_of(F.col("_url")), rules)["verdict"]
    kept = F.substring(F.md5(F.col("_url").cast("binary")), 1, 1).isin(*CALIBRATION)
    side = F.when(verdict == "allow", 1).when(verdict == "block", 0)
    return urls.select("_url", "uses", side.alias("side"), (side.isNotNull() & ~kept).alias("trains")).withColumn(
        "uid", F.monotonically_increasing_id()
    )


def grams(urls: DataFrame, *keep: str) -> DataFrame:
    """One row per byte of a URL and its end: `gram`, the ORDER bytes before it and itself."""
    blank = lambda n: F.unhex(F.lit("00" * n))
    padded = urls.select(*keep, F.concat(blank(ORDER), F.col("_url").cast("binary"), blank(1)).alias("_bytes"))
    last = F.octet_length("_bytes") - ORDER
    runs = padded.withColumn("_last", last).withColumn("_run", F.explode(F.sequence(F.lit(1), "_last", F.lit(RUN))))
    at = runs.withColumn("_at", F.explode(F.sequence("_run", F.least(F.col("_run") + (RUN - 1), "_last"))))
    return at.select(*keep, F.substring("_bytes", F.col("_at"), F.lit(ORDER + 1)).alias("gram"))


def count_grams(urls: DataFrame) -> DataFrame:
    """Every gram of any URL, with its count in the URLs that train either model and in all."""
    trains = lambda side: F.count_if(F.col("trains") & (F.col("side") == side))
    return grams(urls, "side", "trains").groupBy("gram").agg(
        trains(1).alias("n_allow"), trains(0).alias("n_block"), F.count("*").alias("uses")
    )


def smoothed(level: DataFrame, length: int, below: DataFrame | None) -> DataFrame:
    """(gram, p_allow, p_block) of grams of one length, from those one shorter.

    Witten-Bell: (n + t * p of the shorter gram) / (N + t), with N the context's count and t
    the number of different bytes seen after it; a context not seen leaves the shorter one's.
    """
    context = Window.partitionBy("_context")  # at most 256 grams share one
    level = level.withColumn("_context", F.substring("gram", 1, length - 1))
    if below is None:
        level = level.withColumn("_p_allow", F.lit(1.0) / SYMBOLS).withColumn("_p_block", F.lit(1.0) / SYMBOLS)
    else:
        short = below.select(F.col("gram").alias("_short"), F.col("p_allow").alias("_p_allow"), F.col("p_block").alias("_p_block"))
        level = level.join(short, F.substring("gram", 2, length - 1) == F.col("_short"))

    def p(side: str) -> Column:
        n, shorter = F.col(f"n_{side}"), F.col(f"_p_{side}")
        total, kinds = F.sum(n).over(context), F.sum((n > 0).cast("long")).over(context)
        return F.when(total > 0, (n + kinds * shorter) / (total + kinds)).otherwise(shorter).alias(f"p_{side}")

    return level.select("gram", p("allow"), p("block"))


def gram_table(counted: DataFrame) -> DataFrame:
    """(gram, weight, uses): by how many millionths of a nat the gram speaks for `allow`."""
    below = None
    for length in range(1, ORDER + 1):
        level = counted.groupBy(F.substring("gram", ORDER + 2 - length, length).alias("gram")).agg(
            F.sum("n_allow").alias("n_allow"), F.sum("n_block").alias("n_block")
        )
        below = smoothed(level, length, below)
    whole = smoothed(counted, ORDER + 1, below)
    weight = F.floor((F.ln("p_allow") - F.ln("p_block")) * SCALE + 0.5).cast("long")
    return whole.select("gram", weight.alias("weight")).join(counted.select("gram", "uses"), "gram")


def score_urls(pages: DataFrame, rules: tuple = RULES, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """_url, uses, side, trains, total (millionths), n_bytes with the end, bin, of every distinct URL."""
    urls = materialize(distinct_urls(pages, rules))
    counted = materialize(count_grams(urls))
    table = materialize(gram_table(counted))
    met = join_counted(grams(urls, "uid"), table, "gram", "uses", broadcast_rows)
    sums = met.groupBy("uid").agg(F.sum("weight").alias("total"), F.count("*").alias("n_bytes"))
    mean = F.floor(F.col("total") / (F.col("n_bytes") * (SCALE // PER_NAT)))
    bin_ = F.greatest(F.lit(-MOST_BIN), F.least(F.lit(MOST_BIN), mean)).cast("int")
    return materialize(urls.join(sums, "uid").withColumn("bin", bin_).drop("uid"))


def threshold(scored: DataFrame) -> int | None:
    """The least bin still allowed: least sum of error rates on the calibration URLs, then the lowest.

    None where these hold no allowed or no blocked URL: then everything is allowed. At most
    2 * MOST_BIN + 1 rows reach the driver.
    """
    held = scored.where(F.col("side").isNotNull() & ~F.col("trains"))
    rows = held.groupBy("bin").agg(F.count_if(F.col("side") == 1).alias("a"), F.count_if(F.col("side") == 0).alias("b")).collect()
    allowed, blocked = sum(r["a"] for r in rows), sum(r["b"] for r in rows)
    if not allowed or not blocked:
        return None
    below, above, best = 0, blocked, None
    for r in sorted(rows, key=lambda r: r["bin"]):
        cost = below * blocked + above * allowed
        if best is None or cost < best[0]:
            best = cost, r["bin"]
        below, above = below + r["a"], above - r["b"]
    if below * blocked < best[0]:
        return max(r["bin"] for r in rows) + 1
    return best[1]


@dataclass(frozen=True)
class Judged:
    rows: DataFrame
    threshold: int | None


def judge(pages: DataFrame, keep: list[Column], rules: tuple = RULES, broadcast_rows: int = BROADCAST_ROWS) -> Judged:
    """`keep` columns and host, path, rule, verdict, score of every row of `pages` (column url).

    `score` is the mean difference of log-likelihoods per byte, in nats. A null URL and one
    without `://` have an empty host and path; they are scored as the texts they are (null:
    empty). Copies of a URL train and calibrate once and are judged alike. Without decided
    URLs of both kinds everything no rule decides is allowed. An empty table returns no rows.
    """
    rows = pages.select(*keep, host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.coalesce("url", F.lit("")).alias("_url"))
    scored = score_urls(rows.select("_url"), rules, broadcast_rows)
    least = threshold(scored)
    joined = join_counted(rows, scored.select("_url", "bin", "total", "n_bytes", "uses"), "_url", "uses", broadcast_rows)
    by_model = F.lit("allow") if least is None else F.when(F.col("bin") >= least, "allow").otherwise("block")
    judged = joined.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules)).select(
        *(c for c in joined.columns if c not in ("_url", "bin", "total", "n_bytes")),
        F.col("_rule.rule").alias("rule"),
        F.coalesce(F.col("_rule.verdict"), by_model).alias("verdict"),
        (F.col("total") / (F.col("n_bytes") * SCALE)).alias("score"),
    )
    return Judged(judged, least)


def filter_urls(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict, score of every page."""
    return judge(pages, [F.col("page_id")]).rows


def keep_allowed(pages: DataFrame) -> DataFrame:
    """The allowed pages, with all their columns whatever these are called."""
    row = F.struct(*(F.col(f"`{c}`") for c in pages.columns)).alias("_page")
    inner = pages.select("url", row)
    return judge(inner, [F.col("_page")]).rows.where(F.col("verdict") == "allow").select("_page.*")
