"""URL filter by path-template trees (operator 2). DataFrame functions only.

Per host, a path segment stays literal where it is common among its siblings and becomes a wildcard where it isn't.
Branches of a host whose labelled shares don't differ significantly are merged, and branches whose smoothed
labelled purity reaches the threshold are rejected. Explicit rules come first and also are the labels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A literal segment has so many pages and such a share of its siblings' pages.
SUPPORT, SHARE = 5, 0.02
#: Labelled pages that either side of a comparison needs, its z value, and the purity that rejects.
COMPARED, Z, PURITY = 5, 1.96, 0.8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule (action, host, path) that fits as text, null if none does; the list is a bounded parameter."""
    found = F.lit(None).cast("string")
    for _, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        found = F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(p), F.lit(h + p)).otherwise(found)
    return found


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", support: int = SUPPORT, share: float = SHARE, purity: float = PURITY) -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity for every row.

    Null URLs and those without ``://`` have empty host and path and are judged like any other. Unlabelled branches
    have purity 0.5 and are allowed. Repeated rows are judged alike; an empty table gives an empty result.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    actions = F.create_map(*[F.lit(x) for a, h, p in rules for x in (h + p, a)]) if rules else F.expr("cast(map() AS map<string,string>)")
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    rows = rows.withColumn("action", actions[F.col("rule")])

    urls = rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.max(F.when(F.col("action") == "block", 1).when(F.col("action") == "allow", 0)).alias("y"))
    parts = F.filter(F.split("path", "/", -1), lambda s: s != "")
    segs = urls.select("host", "path", "n", F.posexplode_outer(parts).alias("pos", "seg"), parts.alias("parts"))
    shapes = F.transform(F.slice("parts", 1, F.coalesce("pos", F.lit(0))), lambda s: F.regexp_replace(s, "[0-9]+", "#"))
    segs = segs.select("host", "path", "n", F.coalesce("pos", F.lit(0)).alias("pos"), F.coalesce("seg", F.lit("")).alias("seg"), F.xxhash64(shapes).alias("parent"))
    key = ["host", "parent", "pos"]
    each = segs.groupBy(*key, "seg").agg(F.sum("n").alias("c"))
    total = each.groupBy(*key).agg(F.sum("c").alias("t"))
    literal = each.join(total, key).where((F.col("c") >= support) & (F.col("c") >= share * F.col("t"))).select(*key, "seg", F.lit(True).alias("literal"))
    named = segs.join(literal, [*key, "seg"], "left").withColumn("part", F.when(F.col("literal"), F.col("seg")).otherwise("*"))
    paths = named.groupBy("host", "path").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "part"))), lambda x: x["part"]).alias("parts"))
    paths = paths.select("host", "path", F.concat(F.lit("/"), F.array_join("parts", "/")).alias("template"), F.concat(F.lit("/"), F.array_join(F.slice("parts", 1, F.greatest(F.lit(1), F.size("parts") - 1)), "/")).alias("branch"), F.size("parts").alias("depth"))

    branch = ["host", "depth", "branch"]
    stats = urls.where("y IS NOT NULL").join(paths, ["host", "path"]).groupBy(*branch).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("y")).alias("b"))
    pool = stats.groupBy("host", "depth").agg(F.sum("n").alias("pn"), F.sum("b").alias("pb"))
    both = stats.join(pool, ["host", "depth"])
    rest, all_ = (F.col("pb") - F.col("b")) / F.nullif(F.col("pn") - F.col("n"), F.lit(0)), F.col("pb") / F.col("pn")
    error = F.sqrt(all_ * (1 - all_) * (1 / F.col("n") + 1 / F.nullif(F.col("pn") - F.col("n"), F.lit(0))))
    alike = (F.col("n") >= COMPARED) & (F.col("pn") - F.col("n") >= COMPARED) & (F.abs(F.col("b") / F.col("n") - rest) <= Z * error)
    both = both.withColumn("merged", F.coalesce(alike, F.lit(False)))
    pooled = both.where("merged").groupBy("host", "depth").agg(F.sum("n").alias("mn"), F.sum("b").alias("mb"))
    both = both.join(pooled, ["host", "depth"], "left")
    p = (F.when(F.col("merged"), F.col("mb")).otherwise(F.col("b")) + 1) / (F.when(F.col("merged"), F.col("mn")).otherwise(F.col("n")) + 2)
    judged = paths.join(both.select(*branch, p.alias("purity")), branch, "left").select("host", "path", "template", F.coalesce("purity", F.lit(0.5)).alias("purity"))
    out = rows.join(judged, ["host", "path"])
    verdict = F.coalesce("action", F.when(F.col("purity") >= purity, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", F.round("purity", 6).alias("purity"))


def oracle_sql(rules: list[tuple[str, str, str]], support: int = SUPPORT, share: float = SHARE, purity: float = PURITY) -> str:
    """The same in DuckDB SQL over table pages."""
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    longest = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h + p}'" for _, h, p in longest)
    action = " ".join(f"WHEN rule = '{h + p}' THEN '{a}'" for a, h, p in rules)
    return f"""
WITH r0 AS (SELECT page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r1 AS (SELECT *, CASE {rule} END AS rule FROM r0), r AS (SELECT *, CASE {action} END AS action FROM r1),
urls AS (SELECT host, path, count(*) AS n, max(CASE action WHEN 'block' THEN 1 WHEN 'allow' THEN 0 END) AS y, list_filter(string_split(path, '/'), lambda s: s <> '') AS parts FROM r GROUP BY host, path),
segs AS (SELECT host, path, n, i - 1 AS pos, coalesce(parts[i], '') AS seg, list_transform(parts[1:i - 1], lambda s: regexp_replace(s, '[0-9]+', '#', 'g')) AS parent FROM (SELECT *, unnest(range(1, greatest(1, len(parts)) + 1)) AS i FROM urls) u),
each AS (SELECT host, parent, pos, seg, sum(n) AS c FROM segs GROUP BY ALL),
lit AS (SELECT host, parent, pos, seg FROM (SELECT *, sum(c) OVER (PARTITION BY host, parent, pos) AS t FROM each) e WHERE c >= {support} AND c >= {share} * t),
named AS (SELECT s.host, s.path, s.pos, CASE WHEN l.host IS NULL THEN '*' ELSE s.seg END AS part FROM segs s LEFT JOIN lit l USING (host, parent, pos, seg)),
paths AS (SELECT host, path, '/' || array_to_string(parts, '/') AS template, '/' || array_to_string(parts[1:greatest(1, len(parts) - 1)], '/') AS branch, len(parts) AS depth FROM (SELECT host, path, list(part ORDER BY pos) AS parts FROM named GROUP BY host, path) p),
stats AS (SELECT host, depth, branch, sum(n) AS n, sum(n * y) AS b FROM urls JOIN paths USING (host, path) WHERE y IS NOT NULL GROUP BY ALL),
pools AS (SELECT *, sum(n) OVER w AS pn, sum(b) OVER w AS pb FROM stats WINDOW w AS (PARTITION BY host, depth)),
alike AS (SELECT *, coalesce(n >= {COMPARED} AND pn - n >= {COMPARED} AND abs(b / n - (pb - b) / nullif(pn - n, 0)) <= {Z} * sqrt((pb / pn) * (1 - pb / pn) * (1 / n + 1 / nullif(pn - n, 0))), false) AS merged FROM pools),
pure AS (SELECT host, depth, branch, (CASE WHEN merged THEN sum(CASE WHEN merged THEN b END) OVER w ELSE b END + 1) / (CASE WHEN merged THEN sum(CASE WHEN merged THEN n END) OVER w ELSE n END + 2) AS purity FROM alike WINDOW w AS (PARTITION BY host, depth))
SELECT page_id, r.host, r.path, rule, coalesce(action, CASE WHEN coalesce(purity, 0.5) >= {purity} THEN 'block' ELSE 'allow' END) AS verdict, template, round(CAST(coalesce(purity, 0.5) AS DOUBLE), 6) AS purity
FROM r JOIN paths USING (host, path) LEFT JOIN pure USING (host, depth, branch)
"""
