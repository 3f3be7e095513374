"""URL filters: rules first, then a path-template tree, with DataFrame functions only.

Every path becomes segments, all of them; digits are one sign and long hexadecimal strings
another. The tree of a host is made level by level on the table of distinct paths: a segment
stays a branch of its own if it has a share of its parent's pages (SHARE, and at least LEAST pages) and its
labelled rate differs from its parent's at Z standard errors; all others merge into the
wildcard. Below a parent of fewer than LEAST pages, or one whose labels all agree, nothing can stay
apart, so such paths are finished at once; the levels end when all are. A template's rate of
bad labels is smoothed towards its host's, and that towards all pages', with WEIGHT labels
each. Templates at REJECT or more are blocked.

Rules (host suffix, path start) decide before the tree; the longest that fits wins.

Joins put keys of over a thousandth of the rows apart (see ``_shared.often_first``), so that no host, template or
document gathers its pages in one task.

Nulls: a null url, or one without "://", has an empty host and path and is judged by the
empty template. Null labels are left out; a document with several labels is bad if any
says so. Equal urls are pages of their own. Very long urls are read whole. Rates that tie with REJECT block. Other
columns are not read, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import _shared

# Fixed rules: host suffix, path start, verdict.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
SHARE = 0.02
LEAST = 5
Z = 1.96
WEIGHT = 20.0
REJECT = 0.5
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, written host and path together, and its verdict; else nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for suffix, start, says in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == suffix) | F.endswith(host, F.lit(f".{suffix}"))) & F.startswith(path, F.lit(start))
        name, verdict = F.when(fits, F.lit(suffix + start)).otherwise(name), F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def segments(path: Column) -> Column:
    """The path's segments that are not empty, generalised."""
    return F.transform(
        F.filter(F.split(path, "/"), lambda s: s != ""),
        lambda s: F.when(F.rlike(s, F.lit("^[0-9a-f-]{16,}$")), F.lit("{h}")).otherwise(F.regexp_replace(s, "[0-9]+", "{n}")),
    )


def _level(rows: DataFrame, depth: int) -> DataFrame:
    """rows, all longer than depth, with their templates one segment longer, or to their end where nothing below can stay apart."""
    sums = lambda *by: [F.sum(c).alias(a) for c, a in zip(("n", "lab", "bad"), by, strict=True)]
    at = F.get(F.split("way", "/"), F.lit(depth))
    child = _shared.stored(rows.withColumn("seg", at).groupBy("host", "template", "seg").agg(*sums("n", "lab", "bad"), F.count("*").alias("ways")), "branches")
    parent = child.groupBy("host", "template").agg(*sums("all_n", "all_lab", "all_bad"), F.count("*").alias("branches"))
    branches, ways = child.agg(F.count("*"), F.sum("ways")).first()
    rate = F.col("all_bad") / F.nullif("all_lab", F.lit(0))
    apart = F.abs(F.col("bad") / F.nullif("lab", F.lit(0)) - rate) > Z * F.sqrt(rate * (1 - rate) / F.nullif("lab", F.lit(0)))
    goes_on = F.coalesce((F.col("all_n") >= LEAST) & (rate > 0) & (rate < 1), F.lit(False))
    kept = F.coalesce(goes_on & (F.col("n") >= LEAST) & (F.col("n") >= SHARE * F.col("all_n")) & apart, F.lit(False))
    judged = _shared.often_first(child, parent, ["host", "template"], "branches", branches)
    judged = judged.select("host", "template", "seg", "ways", kept.alias("kept"), goes_on.alias("goes_on"))
    joined = _shared.often_first(rows.withColumn("seg", at), judged, ["host", "template", "seg"], "ways", ways)
    length = F.size(F.split("way", "/"))
    step = F.when(~F.col("goes_on"), F.repeat(F.lit("/*"), length - depth)).otherwise(F.concat(F.lit("/"), F.when(F.col("kept"), F.col("seg")).otherwise("*")))
    open_ = F.col("goes_on") & (length > depth + 1)
    return joined.select("host", "way", "n", "lab", "bad", F.concat("template", step).alias("template"), open_.alias("open"))


def template_tree(labelled: DataFrame) -> DataFrame:
    """(host, way, n, template, rate) of each distinct path of labelled(host, path, bad or null).

    way is the generalised path; template what the tree made of it; rate its smoothed share of bad labels.
    """
    pages = labelled.select("host", F.array_join(segments(F.col("path")), "/").alias("way"), "bad")
    tree = pages.groupBy("host", "way").agg(F.count("*").alias("n"), F.count("bad").alias("lab"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    rows, done, depth = _shared.stored(tree.withColumns({"template": F.lit(""), "open": F.col("way") != ""}), "urls"), [], 0
    while True:
        done.append(rows.where(~F.col("open")).drop("open"))
        rows = rows.where("open").drop("open")
        if rows.isEmpty():
            break
        rows, depth = _shared.stored(_level(rows, depth), "urls"), depth + 1
    tree = done[0]
    for more in done[1:]:
        tree = tree.unionByName(more)
    tree = _shared.stored(tree, "templates")
    by_template = tree.groupBy("host", "template").agg(F.sum("lab").alias("t_lab"), F.sum("bad").alias("t_bad"), F.count("*").alias("ways"))
    by_host = by_template.groupBy("host").agg(F.sum("t_lab").alias("host_lab"), F.sum("t_bad").alias("host_bad"), F.count("*").alias("templates"))
    templates, ways = by_template.agg(F.count("*"), F.coalesce(F.sum("ways"), F.lit(0))).first()
    every = by_host.agg((F.coalesce(F.sum("host_bad"), F.lit(0)) / F.greatest(F.coalesce(F.sum("host_lab"), F.lit(0)), F.lit(1))).alias("every"))
    prior = (F.col("host_bad") + WEIGHT * F.col("every")) / (F.col("host_lab") + WEIGHT)
    own = _shared.often_first(by_template, by_host, ["host"], "templates", templates).join(F.broadcast(every))  # one row is broadcast
    rated = own.select("host", "template", "ways", ((F.col("t_bad") + WEIGHT * prior) / (F.col("t_lab") + WEIGHT)).alias("rate"))
    return _shared.often_first(tree.select("host", "way", "n", "template"), rated, ["host", "template"], "ways", ways)


def judge(pages: DataFrame, labelled: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, template, rate of every page; labelled must have a row for each of their paths."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    read = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("way", F.array_join(segments(F.col("path")), "/"))
    tree = _shared.stored(template_tree(labelled), "templates")
    total = tree.agg(F.sum("n")).first()[0] or 0
    name, says = rule_of(F.col("host"), F.col("path"), rules)
    found = _shared.often_first(read, tree, ["host", "way"], "n", total)
    own = F.when(F.col("rate") >= REJECT, F.lit("block")).otherwise("allow")
    return found.select("page_id", "host", "path", name.alias("rule"), F.coalesce(says, own).alias("verdict"), "template", "rate")


def page_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Every page with bad 0 or 1 by its document's labels, or null: the last number of a path names its document."""
    bad = F.max(((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int"))
    known = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(bad.alias("bad"))
    path = path_of(F.col("url"))
    number = F.regexp_extract(path, "([0-9]+)[^0-9]*$", 1).try_cast("long")
    read = pages.select(host_of(F.col("url")).alias("host"), path.alias("path"), number.alias("doc_id"))
    named = read.where(F.col("doc_id").isNotNull())
    classes = _shared.stored(named.groupBy("doc_id").agg(F.count("*").alias("n")).join(known, "doc_id", "left"), "page-labels")
    total = classes.agg(F.sum("n")).first()[0] or 0
    found = _shared.often_first(named, classes, ["doc_id"], "n", total).select("host", "path", "bad")
    return found.unionByName(read.where(F.col("doc_id").isNull()).select("host", "path", F.lit(None).cast("int").alias("bad")))


def op8_template_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _shared.table(spark, sf_dir, "pages")
    found = judge(pages, page_labels(pages, _shared.table(spark, sf_dir, "labels")))
    return found.select("page_id", "host", "path", "rule", "verdict", "template", F.round("rate", 9).alias("rate"))


def _sql() -> str:
    rule = verdict = "NULL"
    for suffix, start, says in sorted(RULES, key=lambda r: len(r[0] + r[1])):
        fits = f"(host = '{suffix}' OR ends_with(host, '.{suffix}')) AND starts_with(path, '{start}')"
        rule, verdict = f"CASE WHEN {fits} THEN '{suffix}{start}' ELSE {rule} END", f"CASE WHEN {fits} THEN '{says}' ELSE {verdict} END"
    plain = "list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: CASE WHEN regexp_full_match(s, '[0-9a-f-]{16,}') THEN '{h}' ELSE regexp_replace(s, '[0-9]+', '{n}', 'g') END)"
    rate, own = "(all_bad / nullif(all_lab, 0))", "(bad_s / nullif(lab_s, 0))"
    return f"""
    WITH RECURSIVE parsed AS (
        SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), '{_UPPER}', '{_LOWER}') AS host,
               coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
    ways AS (SELECT page_id, host, path, coalesce(array_to_string({plain}, '/'), '') AS way, regexp_extract(path, '([0-9]+)[^0-9]*$', 1) AS number FROM parsed),
    known AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality IS NULL OR toxic IS NULL THEN NULL ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
    base AS (
        SELECT host, way, count(*) AS n, count(bad) AS lab, CAST(coalesce(sum(bad), 0) AS BIGINT) AS bad
        FROM (SELECT host, way, TRY_CAST(number AS BIGINT) AS doc_id FROM ways) LEFT JOIN known USING (doc_id)
        GROUP BY host, way),
    level(host, way, n, lab, bad, template, depth, going) AS (
        SELECT host, way, n, lab, bad, '', 0, way <> '' FROM base
        UNION ALL
        SELECT host, way, n, lab, bad,
               template || CASE WHEN NOT goes_on THEN repeat('/*', segs - depth)
                                WHEN n_s >= {LEAST} AND n_s >= {SHARE} * all_n AND coalesce(abs({own} - {rate}) > {Z} * sqrt({rate} * (1 - {rate}) / nullif(lab_s, 0)), false) THEN '/' || seg
                                ELSE '/*' END,
               depth + 1, goes_on AND segs > depth + 1
        FROM (SELECT *, coalesce(all_n >= {LEAST} AND {rate} > 0 AND {rate} < 1, false) AS goes_on
              FROM (SELECT *, sum(n) OVER b AS n_s, sum(lab) OVER b AS lab_s, sum(bad) OVER b AS bad_s, sum(n) OVER p AS all_n, sum(lab) OVER p AS all_lab, sum(bad) OVER p AS all_bad
                    FROM (SELECT *, string_split(way, '/')[depth + 1] AS seg, len(string_split(way, '/')) AS segs FROM level WHERE going)
                    WINDOW b AS (PARTITION BY host, template, seg), p AS (PARTITION BY host, template)))),
    tree AS (SELECT * FROM level WHERE NOT going),
    by_host AS (SELECT host, sum(lab) AS host_lab, sum(bad) AS host_bad FROM tree GROUP BY host),
    every_page AS (SELECT coalesce(sum(host_bad), 0) / greatest(coalesce(sum(host_lab), 0), 1) AS every FROM by_host),
    rated AS (
        SELECT host, template, (t_bad + {WEIGHT} * (host_bad + {WEIGHT} * every) / (host_lab + {WEIGHT})) / (t_lab + {WEIGHT}) AS rate
        FROM (SELECT host, template, sum(lab) AS t_lab, sum(bad) AS t_bad FROM tree GROUP BY ALL) JOIN by_host USING (host) CROSS JOIN every_page)
    SELECT page_id, host, path, {rule} AS rule, coalesce({verdict}, CASE WHEN rate >= {REJECT} THEN 'block' ELSE 'allow' END) AS verdict, template, round(rate, 9) AS rate
    FROM ways JOIN (SELECT host, way, template FROM tree) USING (host, way) JOIN rated USING (host, template)
    """


ORACLE_SQL = _sql()
