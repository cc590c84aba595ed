"""URL filter: host and path rules, then a ratio of character language models. DataFrame operations only.

URLs that a rule decides are examples: those allowed train one smoothed variable-order Markov model
of characters, those blocked another. Probabilities of order 1 to ORDER are interpolated by Witten
and Bell's weights, so a context that was seldom seen leans on shorter ones. A URL that no rule
decides is judged by the difference of its log-likelihoods divided by its length, against a
threshold that is calibrated on examples held out of training.

Characters are folded to 32 symbols, so there are at most 32**ORDER = 2**20 grams however many URLs
there are: that bounds the model table, the only data broadcast. Log ratios are kept as whole
millionths, so sums are exact in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from weftline.llm.common import cut, table

#: (verdict, host, path)
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
#: Rules become one expression; longer lists are refused.
MOST_RULES = 1000
ORDER = 4
SYMBOLS = 32
#: Examples whose URL's MD5 begins with one of these hexadecimal digits calibrate the threshold.
HELD_OUT = "012"
#: The threshold's steps, in millionths of log ratio per symbol, and how many there are either way.
BIN = 20_000
BINS = 200
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL; both empty without ://."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    after = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(after, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(after, r"\A[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null if none does; of equal lengths the first listed."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules")
    name = verdict = None
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        name = F.when(fits, rule_host + rule_path) if name is None else name.when(fits, rule_host + rule_path)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    empty = F.lit(None).cast("string")
    return (empty, empty) if name is None else (name, verdict)


def grams(url: Column) -> Column:
    """Overlapping grams of ORDER symbols, one for each symbol of the folded URL and one for its end."""
    folded = F.translate(F.coalesce(url, F.lit("")), UPPER, LOWER)
    folded = F.regexp_replace(F.regexp_replace(F.regexp_replace(folded, "[0-9]", "0"), "_", "-"), "[^a-z0./-]", "%")
    # a look-ahead finds a gram at every symbol in one pass; lambdas would fold the URL again for each
    return F.regexp_extract_all(F.concat(F.lit("^" * (ORDER - 1)), folded, F.lit("^")), F.lit(f"(?=(.{{{ORDER}}}))"), F.lit(1))


def model(counts: DataFrame) -> DataFrame:
    """(gram, ratio): millionths of log(accepted / rejected probability) of each gram's last symbol.

    counts has (gram, accepted, rejected) for every gram that is to be scored.
    """
    lower = None
    for k in range(1, ORDER + 1):
        own = counts.groupBy(F.right("gram", F.lit(k)).alias("g")).agg(F.sum("accepted").alias("a"), F.sum("rejected").alias("r"))
        context = own.groupBy(F.substring("g", 1, k - 1).alias("c")).agg(F.sum("a").alias("ca"), F.sum("r").alias("cr"), F.count_if(F.col("a") > 0).alias("ta"), F.count_if(F.col("r") > 0).alias("tr"))
        joined = own.withColumn("c", F.substring("g", 1, k - 1)).join(F.broadcast(context), "c")
        if lower is None:
            joined = joined.withColumns({"la": F.lit(1.0 / SYMBOLS), "lr": F.lit(1.0 / SYMBOLS)})
        else:
            joined = joined.withColumn("l", F.right("g", F.lit(k - 1))).join(F.broadcast(lower), "l")
        weigh = lambda n, t, total, low: F.when(F.col(total) + F.col(t) > 0, (F.col(n) + F.col(t) * F.col(low)) / (F.col(total) + F.col(t))).otherwise(F.col(low))
        lower = joined.select(F.col("g").alias("l"), weigh("a", "ta", "ca", "la").alias("la"), weigh("r", "tr", "cr", "lr").alias("lr"))
    return lower.select(F.col("l").alias("gram"), F.round((F.log("la") - F.log("lr")) * 1e6).cast("bigint").alias("ratio"))


def judge(pages: DataFrame, rules=RULES, id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """(id, url, host, path, rule, verdict, ratio, symbols) of every row.

    ratio / symbols is the log ratio for each symbol, in millionths. Null and empty URLs are scored by
    the end symbol alone; null ids and repeated rows keep their rows; without examples of one kind
    that model is uniform and the threshold is 0; an empty table gives an empty result; other columns
    are ignored.
    """
    host, path = parts(F.col("url"))
    urls = pages.select(F.col(id_column).alias("id"), F.col(url_column).alias("url")).withColumns({"host": host, "path": path})
    urls = urls.withColumns(dict(zip(("rule", "given"), rule_of(F.col("host"), F.col("path"), rules), strict=True)))
    held = F.left(F.md5(F.col("url").cast("binary")), F.lit(1)).isin(*HELD_OUT)
    every = urls.select("given", held.alias("held"), F.explode(grams(F.col("url"))).alias("gram"))
    learn = ~F.coalesce("held", F.lit(False))
    counts = cut(every.groupBy("gram").agg(F.count_if((F.col("given") == "allow") & learn).alias("accepted"), F.count_if((F.col("given") == "block") & learn).alias("rejected")))
    ratios = F.broadcast(cut(model(counts)))
    spread = urls.select("id", "url", F.posexplode(grams(F.col("url"))).alias("at", "gram")).join(ratios, "gram")
    # repeated rows are summed as one; the mean is the same and the rows come back below
    scored = spread.groupBy("id", "url").agg(F.sum("ratio").alias("ratio"), F.count("*").alias("symbols"), F.count_if(F.col("at") == 0).alias("rows"))
    scored = cut(scored.withColumns({"host": host, "path": path}))
    scored = scored.withColumns(dict(zip(("rule", "given"), rule_of(F.col("host"), F.col("path"), rules), strict=True))).withColumn("held", held)
    step = F.least(F.lit(BINS), F.greatest(F.lit(-BINS), F.floor(F.col("ratio") / (F.col("symbols") * BIN))))
    bins = scored.where("held and given is not null").groupBy(step.alias("bin")).agg(F.sum(F.when(F.col("given") == "allow", F.col("rows")).otherwise(0)).alias("good"), F.sum(F.when(F.col("given") == "block", F.col("rows")).otherwise(0)).alias("bad"))
    # at most 2 * BINS + 1 rows: the threshold below which examples are refused, by balanced error
    line, whole = W.orderBy("bin"), W.partitionBy()
    cuts = bins.withColumns({"lost": F.sum("good").over(line) - F.col("good"), "caught": F.sum("bad").over(line) - F.col("bad"), "all_good": F.sum("good").over(whole), "all_bad": F.sum("bad").over(whole)})
    best = cuts.where("all_good > 0 and all_bad > 0").orderBy(F.col("lost") * F.col("all_bad") + (F.col("all_bad") - F.col("caught")) * F.col("all_good"), F.abs("bin"), "bin").limit(1).select("bin")
    threshold = F.coalesce(best.scalar(), F.lit(0))
    verdict = F.coalesce("given", F.when(step >= threshold, "allow").otherwise("block"))
    out = scored.withColumn("verdict", verdict).withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows"))))
    return out.select(F.col("id").alias(id_column), F.col("url").alias(url_column), "host", "path", "rule", "verdict", "ratio", "symbols")


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def _oracle() -> str:
    fits = [(k, h + p, f"(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')") for k, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))]
    rule = "case " + " ".join(f"when {f} then '{n}'" for _, n, f in fits) + " end"
    given = "case " + " ".join(f"when {f} then '{k}'" for k, _, f in fits) + " end"
    levels = []
    weigh = lambda n, t, total, low: f"case when {total} + {t} > 0 then ({n} + {t} * {low}) / ({total} + {t}) else {low} end"
    for k in range(1, ORDER + 1):
        levels.append(f"o{k} as (select right(gram, {k}) as g, left(right(gram, {k}), {k - 1}) as c, sum(a)::double as a, sum(r)::double as r from n group by all)")
        levels.append(f"c{k} as (select c, sum(a) as ca, sum(r) as cr, count(*) filter (a > 0) as ta, count(*) filter (r > 0) as tr from o{k} group by c)")
        low = "" if k == 1 else f"join p{k - 1} l on l.g = right(o.g, {k - 1})"
        la, lr = ("(1.0::double / 32)",) * 2 if k == 1 else ("l.pa", "l.pr")
        levels.append(f"p{k} as (select o.g, {weigh('a', 'ta', 'ca', la)} as pa, {weigh('r', 'tr', 'cr', lr)} as pr from o{k} o join c{k} using (c) {low})")
    return f"""
with u0 as (select row_number() over () as rid, page_id, url, case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
u1 as (select *, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u0),
u as (select *, {rule} as rule, {given} as given, coalesce(left(md5(url), 1) in ({", ".join(f"'{x}'" for x in HELD_OUT)}), false) as held,
 '{"^" * (ORDER - 1)}' || regexp_replace(replace(regexp_replace(translate(coalesce(url, ''), '{UPPER}', '{LOWER}'), '[0-9]', '0', 'g'), '_', '-'), '[^a-z0./-]', '%', 'g') || '^' as s from u1),
g as (select rid, given, held, substr(s, i, {ORDER}) as gram from (select *, unnest(range(1, length(s) - {ORDER - 2})) as i from u)),
n as (select gram, count(*) filter (given = 'allow' and not held) as a, count(*) filter (given = 'block' and not held) as r from g group by gram),
{", ".join(levels)},
ratio as (select g as gram, round((ln(pa) - ln(pr)) * 1e6)::bigint as ratio from p{ORDER}),
score as (select rid, sum(ratio) as ratio, count(*) as symbols from g join ratio using (gram) group by rid),
s as (select u.*, greatest(-{BINS}, least({BINS}, floor(ratio::double / (symbols * {BIN}))))::bigint as bin from u join score using (rid)),
b as (select bin, count(*) filter (given = 'allow') as good, count(*) filter (given = 'block') as bad from s where held and given is not null group by bin),
w as (select bin, sum(good) over (order by bin) - good as lost, sum(bad) over (order by bin) - bad as caught, sum(good) over () as all_good, sum(bad) over () as all_bad from b),
t as (select coalesce((select bin from w where all_good > 0 and all_bad > 0 order by lost * all_bad + (all_bad - caught) * all_good, abs(bin), bin limit 1), 0) as threshold)
select page_id, host, path, rule, coalesce(given, case when bin >= threshold then 'allow' else 'block' end) as verdict from s, t
"""


ORACLE = _oracle()
