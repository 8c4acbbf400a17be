"""URL filter: host and path rules, and link-graph propagation for what no rule covers.

Links of a page to other hosts give weighted host edges. Trust is personalised PageRank from the
hosts whose pages an allow rule covers; distrust is the same over reversed edges from hosts whose
pages a block rule covers, so that hosts linking to blocked ones inherit it. Rank that reaches a
host without links on goes back to the seeds, so both add up to one; rounds end when neither moves
by more than TOLERANCE in all. What a host inherits over links (its own seed not counted) decides
pages without a rule: blocked when distrust is above trust.

Defined results: a null url, or one without ``://``, has empty host and path, no rule, and verdict
allow; null html has no links, nor have comments and scripts, closed or
not; without seeds or links nothing is
inherited; rows that repeat a page are judged alike and add to link weights; an empty table gives an
empty result; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinfold.llm.common import broadcast_if_small, checkpointed

#: (rule, verdict); a rule is host/path-prefix.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
DAMPING, ROUNDS, TOLERANCE = 0.85, 100, 1e-6
#: Hosts with this share of all pages or more get their scores by broadcast; there are at most 1 / FREQUENT.
FREQUENT = 0.001
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: What holds no links, up to the page's end if it is not closed, and links of anchors and areas, whose tags end before the next one. So a page is read in linear time.
UNREAD = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)"
LINK = r"""(?is)<(?:a|area)\s(?:[^<>]*?\s)?href\s*=\s*["']?\s*(?:https?:)?//([^/"'?#\s<>]+)"""


def url_host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), URL, 1), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), URL, 2)


def fits(rule: str, host: Column, path: Column) -> Column:
    name, _, rest = rule.partition("/")
    return ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, or null."""
    return F.coalesce(*[F.when(fits(r, host, path), F.lit(r)) for r, _ in sorted(rules, key=lambda x: (-len(x[0]), x[0]))])


def host_edges(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(src, dst, n): how often pages of a host link to each other host."""
    read = F.regexp_replace(F.coalesce(F.col(html_col), F.lit("")), UNREAD, "")
    link = F.explode(F.regexp_extract_all(read, F.lit(LINK), 1))
    link = pages.where("host <> ''").select(F.col("host").alias("src"), link.alias("link"))
    return link.select("src", F.translate("link", UPPER, LOWER).alias("dst")).where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(kind, host, inherited): personalised PageRank from ``seeds`` (kind, host, seed), without the seeds themselves.

    ``edges`` is (kind, src, dst, n); every kind is a graph of its own whose seeds add up to one. A
    round joins by host and sums by host, for all kinds at once.
    """
    node = ["kind", "src"]
    share = checkpointed(edges.join(edges.groupBy(*node).agg(F.sum("n").alias("all")), node).select(*node, "dst", (F.col("n") / F.col("all")).alias("share")))
    seeds = checkpointed(seeds)
    inherited = checkpointed(seeds.select("kind", "host", F.lit(0.0).alias("inherited")).where("false"))
    reached: dict[str, float] = {}
    for _ in range(rounds):
        # all rank that is not handed over links is the seeds'
        left = F.lit(1.0)
        for kind, part in reached.items():
            left = F.when(F.col("kind") == kind, 1.0 - part).otherwise(left)
        rank = seeds.select("kind", F.col("host").alias("src"), (F.col("seed") * left).alias("r"))
        rank = rank.unionByName(inherited.select("kind", F.col("host").alias("src"), F.col("inherited").alias("r"))).groupBy(*node).agg(F.sum("r").alias("r"))
        now = checkpointed(share.join(rank, node).groupBy("kind", F.col("dst").alias("host")).agg((damping * F.sum(F.col("r") * F.col("share"))).alias("inherited")))
        both = now.withColumnRenamed("inherited", "x").join(inherited.withColumnRenamed("inherited", "y"), ["kind", "host"], "full").fillna(0.0, ["x", "y"])
        found = both.groupBy("kind").agg(F.sum(F.abs(F.col("x") - F.col("y"))).alias("moved"), F.sum("x").alias("reached")).collect()
        inherited, reached = now, {r["kind"]: r["reached"] for r in found}
        if all(r["moved"] <= tolerance for r in found):
            break
    return inherited


def with_scores(pages: DataFrame, scores: DataFrame, hosts: DataFrame) -> DataFrame:
    """``pages`` with trust and distrust of their host: few scores are broadcast, else those of frequent hosts.

    ``hosts`` is (host, n), pages by host. Pages that need no score carry a null host in ``of`` and are spread.
    """
    n = scores.count()
    keyed = pages.withColumn("of", F.coalesce("of", F.concat(F.lit(" "), F.spark_partition_id().cast("string"))))
    scores = scores.withColumnRenamed("host", "of")
    if (small := broadcast_if_small(scores, n, 80)) is not scores:
        return keyed.join(small, "of", "left").drop("of")
    total = hosts.agg(F.sum("n")).first()[0]
    often = hosts.where(F.col("n") >= FREQUENT * total).select(F.col("host").alias("of"))
    hot = F.broadcast(often.join(scores, "of", "left").withColumn("hot", F.lit(True)))  # at most 1 / FREQUENT rows
    found = keyed.join(hot, "of", "left")
    rest = found.where("hot is null").drop("trust", "distrust").join(scores, "of", "left")
    return found.where("hot").unionByName(rest).drop("of", "hot")


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rounds: int = ROUNDS, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(id, host, path, rule, verdict, trust, distrust) of each page."""
    url, html = F.col(url_col), F.col(html_col)
    named = pages.select(F.col(id_col).alias("id"), html.alias("html"), url_host(url).alias("host"), url_path(url).alias("path"))
    named = named.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    said = F.element_at(F.create_map(*[F.lit(x) for r in rules for x in r]), F.col("rule"))
    edges = checkpointed(host_edges(named))
    seen = checkpointed(named.where("host <> ''").withColumn("said", said).groupBy("host").agg(F.count("*").alias("n"), F.count_if(F.col("said") == "allow").alias("allowed"), F.count_if(F.col("said") == "block").alias("blocked")))
    total = seen.agg(F.sum(F.col("allowed") / F.col("n")).alias("a"), F.sum(F.col("blocked") / F.col("n")).alias("b")).first()
    # seeds add up to 1; a host's seed is in proportion to the share of its pages under a rule
    seed = lambda kind, c, all_: seen.where(F.col(c) > 0).select(F.lit(kind).alias("kind"), "host", (F.col(c) / F.col("n") / F.lit(all_ or 1.0)).alias("seed"))
    seeds = seed("trust", "allowed", total["a"]).unionByName(seed("distrust", "blocked", total["b"]))
    ways = edges.select(F.lit("trust").alias("kind"), "src", "dst", "n").unionByName(edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    ranks = propagate(ways, seeds, rounds, damping, tolerance)
    of = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("inherited"))).alias(kind)
    scores = checkpointed(ranks.join(seen.select("host"), "host").groupBy("host").agg(of("trust"), of("distrust")))
    out = named.select("id", "host", "path", "rule", said.alias("said"), F.when(F.col("rule").isNull() & (F.col("host") != ""), F.col("host")).alias("of"))
    scored = with_scores(out, scores, seen).fillna(0.0, ["trust", "distrust"])
    inherited = F.when(F.col("distrust") > F.col("trust"), "block").otherwise("allow")
    return scored.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("said", inherited).alias("verdict"), "trust", "distrust")


def op9_url_filter(spark, sf_dir):
    found = judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select("page_id", "host", "path", "rule", "verdict")


def op9_sql(rounds: int = 20, damping: float = DAMPING) -> str:
    """The same in SQL, with some rounds written out."""
    ordered = sorted(RULES, key=lambda x: (-len(x[0]), x[0]))

    def cases(values):
        out = []
        for (rule, said) in ordered:
            name, _, rest = rule.partition("/")
            out.append(f"WHEN (host = '{name}' OR host LIKE '%.{name}') AND starts_with(path, '/{rest}') THEN '{rule if values == 'rule' else said}'")
        return "CASE " + " ".join(out) + " END"

    link, unread = (x.replace("'", "''") for x in (LINK, UNREAD))
    parts = [
        rf"""u AS (SELECT page_id, coalesce(html, '') AS html, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
        regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages)""",
        f"p AS (SELECT *, {cases('rule')} AS rule, {cases('said')} AS said FROM u)",
        "seen AS (SELECT host, count(*) AS n, count(*) FILTER (WHERE said = 'allow') AS a, count(*) FILTER (WHERE said = 'block') AS b FROM p WHERE host <> '' GROUP BY host)",
        f"links AS (SELECT host AS src, translate(unnest(regexp_extract_all(regexp_replace(html, '{unread}', '', 'g'), '{link}', 1)), '{UPPER}', '{LOWER}') AS dst FROM p WHERE host <> '')",
        "e AS (SELECT src, dst, count(*) AS n FROM links WHERE src <> dst GROUP BY src, dst)",
        "t_share AS (SELECT src, dst, n::DOUBLE / sum(n) OVER (PARTITION BY src) AS share FROM e)",
        "d_share AS (SELECT dst AS src, src AS dst, n::DOUBLE / sum(n) OVER (PARTITION BY dst) AS share FROM e)",
        "t_seed AS (SELECT host, (a::DOUBLE / n) / (SELECT sum(a::DOUBLE / n) FROM seen) AS seed FROM seen WHERE a > 0)",
        "d_seed AS (SELECT host, (b::DOUBLE / n) / (SELECT sum(b::DOUBLE / n) FROM seen) AS seed FROM seen WHERE b > 0)",
    ]
    for k in "td":
        parts.append(f"{k}0 AS (SELECT host, 0.0::DOUBLE AS x FROM {k}_seed WHERE false)")
        for i in range(1, rounds + 1):
            rank = f"SELECT host, seed * (1 - (SELECT coalesce(sum(x), 0) FROM {k}{i - 1})) AS r FROM {k}_seed UNION ALL SELECT host, x AS r FROM {k}{i - 1}"
            parts.append(f"{k}{i} AS (SELECT s.dst AS host, {damping} * sum(r.r * s.share) AS x FROM {k}_share s JOIN (SELECT host, sum(r) AS r FROM ({rank}) GROUP BY host) r ON r.host = s.src GROUP BY s.dst)")
    return "WITH " + ",\n".join(parts) + f"\nSELECT page_id, p.host AS host, path, rule, coalesce(said, CASE WHEN coalesce(d.x, 0) > coalesce(t.x, 0) THEN 'block' ELSE 'allow' END) AS verdict FROM p LEFT JOIN t{rounds} t ON t.host = p.host LEFT JOIN d{rounds} d ON d.host = p.host"


OP9_SQL = op9_sql()
