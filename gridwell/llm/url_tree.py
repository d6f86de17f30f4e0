"""URL verdicts by rules and by a path-template tree for each host, in DataFrame operations only.

The urls that rules judge are the labels. Per host, path segments become a tree over the whole path: segments that few
rows share turn into wildcards. From the deepest level up, a branch takes in its siblings while a two-proportion test
does not tell their label rates apart from its own. Templates whose share of blocked labels, smoothed by what the same
template has on all hosts, is high enough are rejected; on a host without labels that prior alone decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridwell.plans.runtime import materialize, small

RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
#: A segment stays literal with this many rows and this share of its parent's rows.
MIN_ROWS, MIN_SHARE = 3, 0.02
#: A branch takes in a sibling while their label rates differ by fewer standard errors.
SAME_Z = 1.96
#: Weight of the host-free prior in labelled rows, and the smoothed share of blocked labels that rejects a template.
PRIOR_ROWS, REJECT = 4.0, 0.9
#: Rows of one host and path from which they are no longer joined by a shuffle on them.
HOT_ROWS = 100_000


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without "://"."""
    text, pattern = F.coalesce(url, F.lit("")), r"://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(text, pattern, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.regexp_extract(text, pattern, 2)


def match_rule(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        own_host, own_path = text[: text.index("/")], text[text.index("/") :]
        fits = ((host == own_host) | host.endswith("." + own_host)) & path.startswith(own_path)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def _generalise(paths: DataFrame) -> DataFrame:
    """paths(host, path, n, blocked, labelled) with `t`, the segments of the template: level by level, rare ones become *.

    Below a node of fewer than MIN_ROWS rows every segment is rare, so only the levels that larger nodes reach cost a round.
    """
    keep = ["host", "path", "n", "blocked", "labelled", "segs", "t"]
    live = paths.withColumn("segs", F.filter(F.split("path", "/"), lambda s: s != "")).withColumn("t", F.array().cast("array<string>"))
    done, level = live.filter(F.size("segs") == 0), 0
    live = live.filter(F.size("segs") > 0)
    while live.limit(1).count():
        live = live.withColumn("seg", F.get("segs", F.lit(level)))
        nodes = live.groupBy("host", "t").agg(F.sum("n").alias("all_n")).filter(F.col("all_n") >= MIN_ROWS)
        child = live.groupBy("host", "t", "seg").agg(F.sum("n").alias("seg_n")).filter(F.col("seg_n") >= MIN_ROWS)
        kept = child.join(nodes, ["host", "t"]).filter(F.col("seg_n") >= F.col("all_n") * MIN_SHARE).select("host", "t", "seg", F.lit(True).alias("literal"))
        placed = live.join(small(nodes.select("host", "t", F.lit(True).alias("large"))), ["host", "t"], "left").join(small(kept), ["host", "t", "seg"], "left")
        one = F.concat("t", F.array(F.when(F.col("literal"), F.col("seg")).otherwise(F.lit("*"))))
        rest = F.concat("t", F.array_repeat(F.lit("*"), F.size("segs") - level))
        placed = materialize(placed.select(*keep[:-1], F.when(F.col("large"), one).otherwise(rest).alias("t")), "url-tree")
        level += 1
        done = done.unionByName(placed.filter(F.size("t") == F.size("segs")))
        live = placed.filter(F.size("t") < F.size("segs"))
    return done.select("host", "path", "n", "blocked", "labelled", "t")


def _greedy(siblings: Column) -> Column:
    """(seg, branch) of siblings(rate, seg, b, l) in the order of their rates: each joins the branch before it if a
    two-proportion test does not tell its rate from all that is in the branch, or else begins one of its own name."""

    def step(acc: Column, x: Column) -> Column:
        n, m = acc["l"].cast("double"), x["l"].cast("double")
        pooled = (acc["b"] + x["b"]) / (n + m)
        error = F.sqrt(pooled * (1 - pooled) * (1 / n + 1 / m))
        same = F.when(acc["l"] > 0, F.abs(acc["b"] / n - x["b"] / m) <= error * SAME_Z).otherwise(F.lit(False))
        name = F.when(same, acc["name"]).otherwise(x["seg"])
        return F.struct(name.alias("name"), (F.when(same, acc["b"]).otherwise(F.lit(0)) + x["b"]).alias("b"), (F.when(same, acc["l"]).otherwise(F.lit(0)) + x["l"]).alias("l"), F.concat(acc["out"], F.array(F.struct(x["seg"].alias("seg"), name.alias("branch")))).alias("out"))

    start = F.struct(F.lit("").alias("name"), F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("l"), F.array().cast("array<struct<seg:string,branch:string>>").alias("out"))
    return F.aggregate(siblings, start, step, lambda acc: acc["out"])


def _merge(nodes: DataFrame) -> DataFrame:
    """nodes(host, t, blocked, labelled) with `branch`, t with merged segments replaced by their branch's name.

    Siblings are templates of a host that differ at one level alone; merging goes from the deepest literal level up. A
    parent has 1 / MIN_SHARE literal children and a wildcard at most, which bounds the lists. Branches without labels
    merge with none: their rate is unknown.
    """
    levels = nodes.select(F.posexplode("t").alias("level", "seg")).filter("seg <> '*'").select("level").distinct().collect()
    nodes = nodes.withColumn("branch", F.col("t"))
    for level in sorted((r.level for r in levels), reverse=True):
        sums = nodes.groupBy("host", "branch").agg(F.sum("blocked").alias("b"), F.sum("labelled").alias("l")).filter((F.size("branch") > level) & (F.col("l") > 0))
        around = F.concat(F.slice("branch", 1, level), F.array(F.lit("/")), F.slice("branch", level + 2, F.size("branch")))
        rows = sums.select("host", around.alias("around"), F.struct((F.col("b") / F.col("l")).alias("rate"), F.get("branch", F.lit(level)).alias("seg"), "b", "l").alias("x"))
        lists = rows.groupBy("host", "around").agg(F.sort_array(F.collect_list("x")).alias("xs")).filter(F.size("xs") > 1)
        moved = lists.select("host", "around", F.explode(_greedy(F.col("xs"))).alias("m")).filter("m.seg <> m.branch")
        swap = lambda c: F.concat(F.slice("around", 1, level), F.array(F.col(c)), F.slice("around", level + 2, F.size("around")))
        moved = moved.select("host", swap("m.seg").alias("branch"), swap("m.branch").alias("into"))
        nodes = materialize(nodes.join(small(moved), ["host", "branch"], "left").select("host", "t", "blocked", "labelled", F.coalesce("into", "branch").alias("branch")), "url-branches")
    return nodes


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) of every row of pages(page_id, url); other columns go.

    verdict is the rule's, else block where the purity of the template's branch is REJECT or more. template is the
    branch's. A null url or one without "://" has an empty host and path, no rule, and is judged by the template of empty
    paths. Very long urls count with their whole path. Repeated rows and null ids stay. An empty table gives an empty
    result. Rows are counted by (host, path) before any join, with partial aggregation; the tree's tables are joined by
    broadcast only if they are counted and small, and a path of HOT_ROWS rows or more is never one task's rows.
    """
    host, path = split_url(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = match_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("ruled", verdict)
    labelled = F.sum(F.col("ruled").isNotNull().cast("long"))
    blocked = F.sum(F.coalesce(F.col("ruled") == "block", F.lit(False)).cast("long"))
    paths = materialize(rows.groupBy("host", "path").agg(F.count("*").alias("n"), blocked.alias("blocked"), labelled.alias("labelled")), "url-paths")
    placed = _generalise(paths)
    merged = _merge(placed.groupBy("host", "t").agg(F.sum("blocked").alias("blocked"), F.sum("labelled").alias("labelled")))
    branch = merged.groupBy("host", "branch").agg(F.sum("blocked").alias("bb"), F.sum("labelled").alias("bl"))
    everywhere = merged.groupBy("t").agg(F.sum("blocked").alias("gb"), F.sum("labelled").alias("gl"))
    prior = (F.col("gb") + 0.5) / (F.col("gl") + 1.0)
    purity = F.round((F.col("bb") + PRIOR_ROWS * prior) / (F.col("bl") + PRIOR_ROWS), 6)
    name = F.when(F.size("branch") > 0, F.concat(F.lit("/"), F.array_join("branch", "/"))).otherwise(F.lit(""))
    scored = merged.join(small(branch), ["host", "branch"]).join(small(everywhere), "t").select("host", "t", name.alias("template"), purity.alias("purity"))
    scored = materialize(placed.join(small(scored), ["host", "t"]).select("host", "path", "n", "template", "purity"), "url-purity")
    hot, rest = scored.filter(F.col("n") >= HOT_ROWS).drop("n"), scored.drop("n")
    if hot.limit(1).count():
        hot = small(hot)
        cold = rows.join(hot.select("host", "path"), ["host", "path"], "left_anti").join(rest, ["host", "path"])
        out = rows.join(hot, ["host", "path"]).unionByName(cold)
    else:
        out = rows.join(rest, ["host", "path"])
    final = F.coalesce("ruled", F.when(F.col("purity") >= REJECT, F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", "rule", final.alias("verdict"), "template", "purity")


def oracle(depth: int = 6) -> str:
    """The same verdicts as DuckDB SQL, for paths of `depth` segments at most."""
    when_rule, when_verdict = "", ""
    for text, what in sorted(RULES, key=lambda r: (-len(r[0]), r[0])):
        h, p = text[: text.index("/")], text[text.index("/") :]
        fits = f"(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')"
        when_rule += f" when {fits} then '{text}'"
        when_verdict += f" when {fits} then '{what}'"
    sql = f"""with u as (select page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host, regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) path from pages),
r as (select *, case{when_rule} end as rule, case{when_verdict} end as ruled from u),
t0 as (select host, path, count(*) n, count(*) filter (where ruled = 'block') blocked, count(ruled) labelled, [x for x in string_split(path, '/') if x <> ''] segs, []::varchar[] as t from r group by host, path)"""
    for k in range(1, depth + 1):
        sql += f""",
c{k} as (select host, t, segs[{k}] seg, sum(n) seg_n from t{k - 1} where len(segs) >= {k} group by all),
l{k} as (select host, t, seg from (select *, sum(seg_n) over (partition by host, t) all_n from c{k}) where seg_n >= {MIN_ROWS} and seg_n >= all_n * {MIN_SHARE}::double),
t{k} as (select a.host, a.path, a.n, a.blocked, a.labelled, a.segs, case when len(a.segs) < {k} then a.t when l.seg is not null then list_append(a.t, a.segs[{k}]) else list_append(a.t, '*') end as t from t{k - 1} a left join l{k} l on a.host = l.host and a.t = l.t and a.segs[{k}] = l.seg)"""
    last = f"select host, t, sum(blocked)::bigint blocked, sum(labelled)::bigint labelled, t as branch from t{depth} group by host, t"
    for k in range(depth, 0, -1):
        sql += f""",
n{k} as ({last}),
s{k} as (select host, list_concat(branch[1:{k - 1}], ['/'], branch[{k + 1}:]) around, list_sort(list({{'rate': b / l, 'seg': branch[{k}], 'b': b, 'l': l}})) xs from (select host, branch, sum(blocked)::bigint b, sum(labelled)::bigint l from n{k} group by host, branch) where len(branch) >= {k} and l > 0 group by all),
g{k} as (select host, around, unnest(list_reduce(xs, lambda a, x: case when a.l > 0 and abs(a.b / a.l - x.b / x.l) <= sqrt(((a.b + x.b) / (a.l + x.l)) * (1 - (a.b + x.b) / (a.l + x.l)) * (1.0::double / a.l + 1.0::double / x.l)) * {SAME_Z}::double then {{'name': a.name, 'b': a.b + x.b, 'l': a.l + x.l, 'o': list_append(a.o, {{'seg': x.seg, 'branch': a.name}})}} else {{'name': x.seg, 'b': x.b, 'l': x.l, 'o': list_append(a.o, {{'seg': x.seg, 'branch': x.seg}})}} end, {{'name': '', 'b': 0::bigint, 'l': 0::bigint, 'o': []::struct(seg varchar, branch varchar)[]}}).o) m from s{k})"""
        last = f"select n.host, n.t, n.blocked, n.labelled, case when g.m is null then n.branch else list_concat(n.branch[1:{k - 1}], [g.m.branch], n.branch[{k + 1}:]) end as branch from n{k} n left join g{k} g on n.host = g.host and len(n.branch) >= {k} and g.around = list_concat(n.branch[1:{k - 1}], ['/'], n.branch[{k + 1}:]) and g.m.seg = n.branch[{k}]"
    return sql + f""",
k as ({last}),
q as (select *, sum(blocked) over (partition by host, branch) bb, sum(labelled) over (partition by host, branch) bl, sum(blocked) over (partition by t) gb, sum(labelled) over (partition by t) gl from k),
z as (select host, t, case when len(branch) > 0 then '/' || array_to_string(branch, '/') else '' end as template, round((bb + {PRIOR_ROWS}::double * ((gb + 0.5::double) / (gl + 1.0::double))) / (bl + {PRIOR_ROWS}::double), 6) purity from q)
select r.page_id, r.host, r.path, r.rule, coalesce(r.ruled, case when z.purity >= {REJECT} then 'block' else 'allow' end) verdict, z.template, z.purity
from r join t{depth} p on r.host = p.host and r.path = p.path join z on z.host = p.host and z.t = p.t"""
