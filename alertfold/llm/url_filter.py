"""Filtering of URLs: explicit rules for hosts and paths, and a logistic regression for all other URLs.

The model sees hashed character n-grams of host and path, apart from each other. It is trained by full-batch gradient
descent on a small table of labelled URLs, as one expression over one row; its weights reach the rows as a scalar
subquery. Everything is built-in expressions: no Python runs on the rows, and rows are judged without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from alertfold.llm.common import free_name, let

# ---- fixed values: rules of the contract, longest match first is found by the code ----
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
# ---- fixed values: the labelled hosts; the paths are the same for both labels, so only hosts tell them apart ----
BLOCKED = """casino-royal.example.org blog.casino-games.example.net casino-wins.test www.casino-bonus.example.org www.online-casino.example.net casino777.test m.lucky-casino.example.net
winbig-casino.example.org win-now.example.net www.bigwin-slots.example.org slots-jackpot.example.net poker-win.example.org
free-bets.test bets-today.example.org www.sportbets.example.net m.best-bets.example.org bet-free.example.net
free-spins.example.org free-money.example.net cheap-meds.example.org www.cheap-pills.test pills-online.example.net
buy-pills.example.org m.diet-pills.example.net cheap-viagra.example.net cheap-loans.example.org cheap-watches.example.net
adult-cams.example.org www.adult-chat.example.net adultvideo.example.net m.adult-dating.example.org xxx-adult.example.net
porn-x.example.org sex-x.example.net hot-x.example.org ads-server.example.net www.ads-click.example.org
track-ads.example.net adtrack.example.org m.click-track.example.net tracker-ads.example.org pop-ads.example.net
spam-mail.example.org www.spam-links.example.net link-farm.example.org m.linkfarm.example.net content-farm.example.org
spam-seo.example.net farm-clicks.example.org click-farm.example.net spamfarm.test warez-crack.example.org
www.crack-keys.example.net free-crack.example.org keygen-warez.example.net phish-login.example.org
m.login-verify-bank.example.net payday-loans.example.org fake-replica.example.net replica-watches.example.org
cheap-replica.example.net fake-watches.test free-viagra.example.org buy-viagra.example.net poker-bets.example.net
www.poker-casino.example.org slots-casino.example.net bonus-slots.example.org jackpot-win.example.net verify-login.example.net
phish-bank.example.org crack-warez.example.org m.keygen-crack.example.net porn-cams.example.net adult-porn.example.org
sex-cams.example.org sex-dating.example.net money-loans.example.net cash-loans.example.org spam-ads.example.org""".split()
ALLOWED = """example.org www.example.org example.net www.example.net blog.example.net m.example.org news.example.org
www.library.example.net city-library.example.org m.museum.example.net blog.garden.example.org recipes.example.net
www.weather.example.org weather-maps.example.net open-maps.example.org university.example.net www.history.example.org
blog.travel.example.net travel-notes.example.org m.sports.example.net football-club.example.org school.example.net
www.science.example.org blog.physics.example.net math.example.org docs.example.net www.docs.python.example.org
m.books.example.net book-shop.example.org theatre.example.net www.music.example.org blog.photos.example.net
health.example.org m.hospital.example.net town-hall.example.org parliament.example.net www.statistics.example.org
blog.thermal.example.net m.thesis.example.org theory.example.net www.nation.example.org station.example.net
blog.education.example.org m.translation.example.net the-shire.example.org thatch.example.net www.harvest.example.org
bakery.example.net blog.carpentry.example.org m.river.example.net hill-walks.example.org wiki.example.net
forum.example.org www.archive.example.net blog.letters.example.org m.radio.example.net rail-times.example.org
airport.example.net www.encyclopedia.example.org blog.chess.example.net trains.test birds.test
www.cathedral.example.net farmers-market.example.org m.gardening.example.org window-makers.example.net blog.winter.example.org
alphabet.example.net www.betterhomes.example.org loan-library.example.net m.adultlearning.example.org tracks.example.net
cashmere-knits.example.org www.essex.example.net blog.mountains.example.net newspaper.example.org m.cinema.example.net
www.astronomy.example.org poetry.example.net choir.example.org blog.teachers.example.org m.students.example.net
research.example.org www.engineering.example.net kitchen.example.org blog.weaving.example.net m.pottery.example.org
lighthouse.example.net www.harbour.example.org village.example.net blog.rowing.example.org m.climbing.example.net""".split()
PATHS = ["/en/1234", "/de/99/", "/fr/4321.html", "/es/7", "/", "/en/803.html", "/de/5", "", "/index.html"]

SIZES, BUCKETS, ROUNDS, RATE, DECAY, PRIOR, MOST_LABELLED = (2, 3, 4), 65536, 200, 20.0, 0.0003, -1.0, 2000
PRIME, STEP = 2147483647, 1000003
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def given_labels(spark: SparkSession) -> DataFrame:
    """The built-in labelled URLs: url, blocked (0 or 1)."""
    rows = [(f"http://{h}{PATHS[k % len(PATHS)]}", y) for y, hosts in ((1, BLOCKED), (0, ALLOWED)) for k, h in enumerate(hosts)]
    return spark.createDataFrame(rows, "url string, blocked int")


def split_url(url: Column) -> Column:
    """Struct of host (after the first ``://``, A-Z lower-cased) and path (up to ``?`` or ``#``); both empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + F.lit(3))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.struct(F.translate(host, UPPER, LOWER).alias("host"), path.alias("path"))


def ngrams(text: Column, salt: int, buckets: int = BUCKETS) -> Column:
    """Distinct buckets of the character n-grams of ``text``; digits count as one character. ``salt`` keeps fields apart."""
    codes = F.transform(F.split(F.translate(text, "123456789", "000000000"), ""), lambda c: F.ascii(c).cast("long"))

    def of_size(codes: Column, n: int) -> Column:
        def hashed(i: Column) -> Column:
            h = F.lit(salt * 8 + n).cast("long")
            for k in range(n):
                h = (h * STEP + F.get(codes, i + k)) % PRIME
            return (h % buckets).cast("int")
        return F.when(F.size(codes) >= n, F.transform(F.sequence(F.lit(0), F.size(codes) - n), hashed)).otherwise(
            F.array().cast("array<int>"))

    return let(codes, lambda c: F.array_distinct(F.concat(*[of_size(c, n) for n in SIZES])))


def features(parts: Column, buckets: int = BUCKETS) -> Column:
    """n-grams of the host between marks for its ends, and of the path."""
    return F.struct(ngrams(F.concat(F.lit("^"), parts["host"], F.lit("$")), 1, buckets).alias("host"),
                    ngrams(parts["path"], 2, buckets).alias("path"))


def scale(ids: Column) -> Column:
    """One by the root of the number of n-grams."""
    return 1 / F.sqrt(F.greatest(F.size(ids), F.lit(1)).cast("double"))


def margin(found: Column, weights: Column, prior: float = PRIOR) -> Column:
    """``prior`` and the weights of either part's n-grams, each part scaled by the root of its number of n-grams."""
    side = lambda ids: scale(ids) * F.aggregate(ids, F.lit(0.0), lambda acc, i: acc + F.get(weights, i))
    return prior + side(found["host"]) + side(found["path"])


def fit(labelled: DataFrame, buckets: int = BUCKETS, rounds: int = ROUNDS, rate: float = RATE, decay: float = DECAY,
        prior: float = PRIOR, most_labelled: int = MOST_LABELLED) -> DataFrame:
    """One row (weights: one per bucket) from url and blocked (0 or 1).

    At most ``most_labelled`` rows are used, those with the smallest hash of their url: training runs in one row, of a size
    that this bound fixes. Rows without a label or url don't count. ``prior`` is the score of a URL without known n-grams;
    without labelled rows all weights are zero.
    """
    rows = labelled.where(F.col("url").isNotNull() & F.col("blocked").isNotNull()).select(
        "url", F.col("blocked").cast("double").alias("y"))
    rows = rows.orderBy(F.xxhash64("url"), "url", "y").limit(most_labelled).select(
        "url", "y", features(split_url(F.col("url")), buckets).alias("x"))
    # One row: the labelled URLs in a fixed order and the sorted n-grams that occur; n-grams are then named by their place
    # there. Both come through an aggregate, so that neither is computed anew inside the functions below.
    known = rows.select(F.explode(F.concat("x.host", "x.path")).alias("id")).agg(F.sort_array(F.collect_set("id")).alias("known"))
    one = rows.agg(F.sort_array(F.collect_list(F.struct("url", "y", "x"))).alias("rows")).crossJoin(F.broadcast(known))
    side = lambda ids: F.transform(ids, lambda i: F.struct(
        (F.array_position("known", i) - 1).cast("int").alias("at"), scale(ids).alias("v")))
    one = one.select("known", F.transform("rows", lambda r, n: F.struct(
        n.alias("row"), r["y"].alias("y"), F.concat(side(r["x"]["host"]), side(r["x"]["path"])).alias("of"))).alias("rows"))
    entry = one.select(F.explode("rows").alias("r")).select("r.row", F.explode("r.of").alias("e"))
    grams = entry.groupBy("e.at").agg(F.sort_array(F.collect_list(F.struct("row", "e.v"))).alias("of")).agg(
        F.sort_array(F.collect_list(F.struct("at", "of"))).alias("grams"))
    total = lambda of, values, key: F.aggregate(of, F.lit(0.0), lambda a, z: a + z["v"] * F.get(values, z[key]))

    def step(weights: Column, _: Column) -> Column:
        wrong = F.transform("rows", lambda r: r["y"] - 1 / (1 + F.exp(-(prior + total(r["of"], weights, "at")))))
        pace = rate / F.greatest(F.size("rows"), F.lit(1)).cast("double")
        return let(wrong, lambda e: F.transform("grams", lambda g: F.get(weights, g["at"]) * (1 - rate * decay)
                                                + pace * total(g["of"], e, "row")))

    start = F.array_repeat(F.lit(0.0), F.size("grams"))
    trained = one.crossJoin(F.broadcast(grams)).select(  # one row each
        "known", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step).alias("w"))
    found = trained.select(F.explode(F.arrays_zip("known", "w")).alias("z")).select(F.col("z.known").alias("id"), "z.w")
    every = labelled.sparkSession.range(0, buckets, 1, 1).select(F.col("id").cast("int").alias("id"))
    return every.join(F.broadcast(found), "id", "left").agg(F.transform(
        F.sort_array(F.collect_list(F.struct("id", F.coalesce("w", F.lit(0.0)).alias("w")))), lambda x: x["w"]).alias("weights"))


def rule_of(parts: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest fitting rule, or null. A rule fits its host and all subdomains."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for host, path, verdict in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((parts["host"] == host) | F.endswith(parts["host"], F.lit("." + host))) & F.startswith(parts["path"], F.lit(path))
        found = F.when(fits, F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def judge(pages: DataFrame, labelled: DataFrame | None = None, rules: list[tuple[str, str, str]] = RULES, url: str = "url",
          into: str = "judged") -> DataFrame:
    """``pages`` with the struct column ``into``: host, path, rule (null if none fits), verdict (allow or block).

    The longest rule that fits decides; else the model trained on ``labelled`` (url, blocked; the built-in table if none)
    blocks URLs whose probability is above one half. ``rules`` are a list of a few hundred at most, as they become one
    expression. A null URL, or one without ``://``, has empty host and path, fits no rule and gets the model's verdict on
    nothing, allow. URLs of any length count whole; repeated rows get equal results; an empty table gives an empty
    table; an existing column named ``into`` is replaced.
    """
    model = fit(given_labels(pages.sparkSession) if labelled is None else labelled)
    parts, weights = free_name(pages, "parts"), free_name(pages, "weights")
    rows = pages.withColumn(parts, split_url(F.col(url))).withColumn(weights, model.scalar())

    def verdict(p: Column) -> Column:
        return let(rule_of(p, rules), lambda r: F.struct(
            p["host"].alias("host"), p["path"].alias("path"), r["rule"].alias("rule"),
            F.when(r.isNotNull(), r["verdict"]).when(margin(features(p), F.col(weights)) > 0, "block").otherwise(
                "allow").alias("verdict")))

    return rows.withColumn(into, verdict(F.col(parts))).drop(parts, weights)


def oracle(pages: str) -> str:
    """The judgement with the built-in table and rules in DuckDB's SQL: same hashes, same rounds of training."""
    labels = ", ".join(f"('http://{h}{PATHS[k % len(PATHS)]}', {y})" for y, hosts in ((1, BLOCKED), (0, ALLOWED)) for k, h in enumerate(hosts))
    rest = "CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END"

    def grams(text: str, salt: int) -> str:
        lists = []
        for n in SIZES:
            h = str(salt * 8 + n)
            for k in range(n):
                h = f"(({h} * {STEP} + c[i + {k}]) % {PRIME})"
            lists.append(f"list_transform(range(1, len(c) - {n} + 2), lambda i: {h} % {BUCKETS})")
        codes = f"list_transform(string_split(translate({text}, '123456789', '000000000'), ''), lambda x: CAST(unicode(x) AS BIGINT))"
        return f"(SELECT list_distinct(list_concat({', '.join(lists)})) FROM (SELECT {codes} AS c))"

    def split(source: str) -> str:
        return (f"SELECT *, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, "
                f"regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM (SELECT *, {rest} AS rest FROM {source})")

    def entries(source: str) -> str:
        marked = "'^' || host || '$'"
        return ("SELECT row, id, v FROM (SELECT row, unnest(ids) AS id, 1 / sqrt(greatest(len(ids), 1)) AS v FROM ("
                f"SELECT row, {grams(marked, 1)} AS ids FROM {source} UNION ALL SELECT row, {grams('path', 2)} AS ids FROM {source}))")

    fits = [f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN {{'rule': '{h + p}', 'verdict': '{v}'}}"
            for h, p, v in sorted(RULES, key=lambda r: -len(r[0]) - len(r[1]))]
    return f"""WITH RECURSIVE labelled(url, y) AS (VALUES {labels}),
lab AS MATERIALIZED (SELECT row_number() OVER (ORDER BY url) AS row, y, host, path FROM ({split('labelled')})),
x AS MATERIALIZED ({entries('lab')}),
w AS (SELECT 0 AS t, id, CAST(0 AS DOUBLE) AS w FROM (SELECT DISTINCT id FROM x)
  UNION ALL
  SELECT w.t + 1, w.id, w.w * (1 - {RATE * DECAY}) + {RATE} / (SELECT count(*) FROM lab) * g.g FROM w JOIN (
    SELECT x.id, sum(x.v * e.e) AS g FROM x JOIN (
      SELECT lab.row, lab.y - 1 / (1 + exp(-({PRIOR} + coalesce(sum(x.v * w.w), 0)))) AS e
      FROM lab LEFT JOIN x ON x.row = lab.row LEFT JOIN w ON w.id = x.id GROUP BY lab.row, lab.y) e ON e.row = x.row
    GROUP BY x.id) g ON g.id = w.id WHERE w.t < {ROUNDS}),
urls AS MATERIALIZED (SELECT row_number() OVER () AS row, page_id, host, path FROM ({split(pages)})),
score AS (SELECT e.row, sum(e.v * coalesce(w.w, 0)) AS s FROM ({entries('urls')}) e
  LEFT JOIN (SELECT id, w FROM w WHERE t = {ROUNDS}) w ON w.id = e.id GROUP BY e.row),
ruled AS (SELECT *, CASE {' '.join(fits)} END AS r FROM urls)
SELECT page_id, host, path, r.rule AS rule,
  coalesce(r.verdict, CASE WHEN {PRIOR} + coalesce(s, 0) > 0 THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled LEFT JOIN score ON score.row = ruled.row"""
