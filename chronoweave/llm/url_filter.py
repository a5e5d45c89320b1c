"""URL filters by a tree of path templates.

Urls are judged by rules first: a rule names a host and a path, fits that host and its
subdomains where the url's path starts with the rule's, and the longest that fits wins.
Its verdict also labels the url. All urls, labelled or not, build a tree per host:

* runs of digits and long hexadecimal runs become ``#``;
* level by level, a segment that few of its parent's urls share becomes ``*``, unless it
  holds no letter; below a parent of fewer than `min_count` urls all of them do;
* templates of a host that differ in one segment only, and whose labels mostly agree, are
  merged there, into ``+block`` or ``+allow``, when each has enough labels and a two-sided
  test doesn't tell its share of blocked labels from the merged share; those that the test
  tells apart leave the pool, and what is left is tested again, until all agree. Positions
  are merged from left to right, each on the outcome of those before;
* a template is rejected when its smoothed share of blocked labels,
  (blocked + 1) / (labelled + 2), reaches `purity`.

Urls without a rule get their template's verdict. A template without labels is allowed.

Everything beyond single urls runs on counts per host and shape, which are summed before
they move. A host may have very many shapes: sums over a parent's segments are written out
before they are joined, so that adaptive execution can split such a parent. Paths of any
depth are told apart to their end; the tree is as many levels deep as parents of at least
`min_count` urls reach.

A null url, or one without ``://``, has an empty host and path. Rows that repeat are judged
each for itself. Columns other than the two named are never read. An empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, is_empty, scratch, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The rules of op2, (host and path, verdict).
RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))


def host_and_path(url: str) -> tuple[Column, Column]:
    """Of a string column without nulls."""
    rest = F.expr(f"if(instr({url}, '://') > 0, substr({url}, instr({url}, '://') + 3), '')")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


class UrlFilter:
    def __init__(self, rules=RULES, min_count: int = 5, min_share: float = 0.02, min_labels: int = 5, critical: float = 1.96, purity: float = 0.9):
        self.rules, self.min_count, self.min_share, self.min_labels, self.critical, self.purity = rules, min_count, min_share, min_labels, critical, purity

    def parsed(self, pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
        """(page_id, host, path, rule, label, shape)"""
        rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"))
        host, path = host_and_path("url")
        rows = rows.select("page_id", host.alias("host"), path.alias("path"))
        rule, label = F.lit(None).cast("string"), F.lit(None).cast("string")
        for text, verdict in sorted(self.rules, key=lambda r: len(r[0])):  # longer rules go around shorter ones
            h, _, p = text.partition("/")
            fits = ((F.col("host") == h) | F.col("host").endswith(f".{h}")) & F.col("path").startswith(f"/{p}")
            rule, label = F.when(fits, text).otherwise(rule), F.when(fits, verdict).otherwise(label)
        plain = F.regexp_replace(F.regexp_replace("path", r"\b(?=[a-f]*[0-9])[0-9a-f]{8,}\b", "#"), r"[0-9]+", "#")
        return rows.withColumns({"rule": rule, "label": label, "shape": plain})

    def templates(self, counts: DataFrame) -> DataFrame:
        """From (host, shape, n, labelled, blocked): these and the template."""
        fixed = lambda c: ~c.rlike(r"\p{L}")
        kept_columns = ["host", "shape", "n", "labelled", "blocked"]
        open_ = cut(counts.select(*kept_columns, F.split("shape", "/").alias("parts"), F.lit("").alias("prefix")), "tree")
        closed, level = [], 1
        while True:
            rows = open_.withColumn("segment", F.get("parts", F.lit(level)))
            per = rows.filter("segment is not null").groupBy("host", "prefix", "segment").agg(F.sum("n").alias("k"))
            parents = rows.filter("segment is not null").groupBy("host", "prefix").agg(F.sum("n").alias("whole"))
            parents = cut(parents.filter(F.col("whole") >= self.min_count), "parents")
            rest = F.slice("parts", F.lit(level + 1), F.greatest(F.size("parts") - level, F.lit(0)))
            rest = F.transform(rest, lambda x: F.concat(F.lit("/"), F.when(fixed(x), x).otherwise("*")))
            ended = F.concat("prefix", F.array_join(rest, "")).alias("template")
            if is_empty(parents):
                closed.append(open_.select(*kept_columns, ended))
                break
            often = per.filter((F.col("k") >= self.min_count) & ~fixed(F.col("segment"))).join(parents, ["host", "prefix"]).filter(F.col("k") >= self.min_share * F.col("whole"))
            often = cut(often.select("host", "prefix", "segment", F.lit(True).alias("often")), "often")
            placed = rows.join(parents, ["host", "prefix"], "left").join(often, ["host", "prefix", "segment"], "left")
            goes_on = F.col("whole").isNotNull() & F.col("segment").isNotNull()
            step = F.concat("prefix", F.lit("/"), F.when(F.col("often") | fixed(F.col("segment")), F.col("segment")).otherwise("*"))
            placed = cut(placed.select(*kept_columns, F.when(goes_on, F.col("parts")).alias("parts"), F.when(goes_on, step).alias("prefix"), F.when(~goes_on, ended).alias("template")), "tree")
            closed.append(placed.filter("parts is null").select(*kept_columns, "template"))
            open_, level = placed.filter("parts is not null").drop("template"), level + 1
        out = closed[0]
        for other in closed[1:]:
            out = out.union(other)
        return out

    def _alike(self, branches: DataFrame, at: int) -> DataFrame:
        """Of (host, merged, labelled, blocked): (host, merged, into), those that merge at
        a position."""
        parts = F.split("merged", "/")
        side = F.when(F.col("blocked") * 2 >= F.col("labelled"), "+block").otherwise("+allow")
        into = F.concat_ws("/", F.slice(parts, 1, at), side, F.slice(parts, F.lit(at + 2), F.greatest(F.size(parts) - at - 1, F.lit(0))))
        left = branches.filter(F.get(parts, F.lit(at)).rlike("^[^#*+]+$")).withColumn("into", into)
        share = F.col("blocked") / F.col("labelled")
        while True:
            pools = left.groupBy("host", "into").agg(F.count("*").alias("branches"), (F.sum("blocked") / F.sum("labelled")).alias("p"))
            pools = cut(pools.filter("branches > 1"), "pools")
            differs = F.abs(share - F.col("p")) > self.critical * F.sqrt(F.col("p") * (1 - F.col("p")) / F.col("labelled")) + 1e-12
            tested = cut(left.join(pools, ["host", "into"]).withColumn("differs", differs).drop("branches", "p"), "tested")
            if is_empty(tested.filter("differs")):
                return tested.select("host", "merged", "into")
            left = tested.filter("not differs").drop("differs")

    def merged(self, nodes: DataFrame) -> DataFrame:
        """From (host, template, n, labelled, blocked): (host, template, merged, purity)."""
        names = cut(nodes.select("host", "template", F.col("template").alias("merged"), "labelled", "blocked"), "names")
        sure = names.filter(F.col("labelled") >= self.min_labels)
        spots = sure.select("host", F.posexplode(F.split("template", "/")).alias("at", "segment"), "template").filter("at > 0 and segment rlike '^[^#*+]+$'")
        others = F.concat_ws("/", F.expr("slice(split(template, '/'), 1, at)"), F.lit("+"), F.expr("slice(split(template, '/'), at + 2, size(split(template, '/')))"))
        twins = spots.groupBy("host", "at", others.alias("others")).count().filter("count > 1")
        for r in twins.select("at").distinct().orderBy("at").collect():  # as many as a path has segments
            branches = names.groupBy("host", "merged").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
            alike = self._alike(branches.filter(F.col("labelled") >= self.min_labels), r["at"])
            renamed = names.join(alike, ["host", "merged"], "left")
            names = cut(renamed.select("host", "template", F.coalesce("into", "merged").alias("merged"), "labelled", "blocked"), "names")
        sums = cut(names.groupBy("host", "merged").agg(((F.sum("blocked") + 1) / (F.sum("labelled") + 2)).alias("purity")), "purity")
        return names.join(sums, ["host", "merged"]).select("host", "template", "merged", "purity")

    def judge(self, pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
        """(page_id, host, path, rule, verdict, template, purity) of every row."""
        with scratch() as made:
            rows = cut(self.parsed(pages, id_col, url_col), "urls")
            counts = rows.groupBy("host", "shape").agg(F.count("*").alias("n"), F.count("label").alias("labelled"), F.count_if(F.col("label") == "block").alias("blocked"))
            shapes = self.templates(counts)
            nodes = shapes.groupBy("host", "template").agg(F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
            judged = cut(shapes.select("host", "shape", "template").join(self.merged(nodes), ["host", "template"]).select("host", "shape", F.col("merged").alias("template"), "purity"), "templates")
            own = F.when(F.col("purity") >= self.purity, "block").otherwise("allow")
            out = cut(rows.join(judged, ["host", "shape"]).select("page_id", "host", "path", "rule", F.coalesce("label", own).alias("verdict"), "template", "purity"), "verdicts")
            made.pop()
        return out


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return UrlFilter().judge(table(spark, sf_dir, "pages"))
