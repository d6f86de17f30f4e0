"""Queries of the matrix operators by name, and the DuckDB SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridwell.operators import cluster, features, layouts, lsh, similarity, spgemm, work
from gridwell.operators.components import connected_components
from gridwell.operators.matrix import Matrix, invert, prefix_sum, prefix_sums, rows_sorted_unique
from gridwell.operators.spmv import LAYOUTS, spmv
from gridwell.plans import fixtures
from gridwell.plans.runtime import fresh_path, materialize
from gridwell.sources import logs, mtx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

# Parameters of the queries.
ALPHA, BETA = 0.8, 0.7
CLUSTER, CHUNK, SIGMA, ALIGN = 8, 8, 64, 4
BLOCK_R, BLOCK_C = 16, 8
OMEGA, SIGMA5 = 4, 16
K, BANDS, SEED = 64, 16, 7
CAP_LIMIT, CAP_WINDOW = 4, 2
PARTS = 28

# The matrices as SQL.
SP = "sp as (select l_suppkey i, l_partkey j, sum(l_quantity) v from lineitem group by all)"
RAW = "raw as (select l_orderkey i, l_partkey j, l_quantity v from lineitem)"
OP = "op as (select l_orderkey i, l_partkey j, sum(l_quantity) v from lineitem group by all)"
PP = "pp as (select a.l_partkey i, b.l_partkey j, sum(a.l_quantity) v from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and b.l_linenumber = a.l_linenumber + 1 group by all)"
CN = "cn as (select c_nationkey::bigint i, s_nationkey::bigint j, sum(l_quantity) v from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey group by all)"
EM = "em as (select i, j, x::double v from (select vec_id i, unnest(range(len(embedding))) j, unnest(embedding) x from embeddings) where abs(x) > 0.2::float)"
DT = "dt as (select distinct doc_id i, ('0x' || substr(md5(t), 1, 7))::bigint j, 1.0::double v from (select doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) t from documents) where t <> '')"
N_SUPP, N_PART, N_ORD, N_DOC = "(select count(*) from supplier)", "(select count(*) from part)", "(select count(*) from orders)", "(select max(doc_id) + 1 from documents)"
VX = f"x as (select range idx, ((range % 7) + 1)::double val from range(0, {N_PART}))"
VY = f"y as (select range idx, (range % 5)::double val from range(0, {N_SUPP}))"


def _add(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return keep


def _with(*parts: str) -> str:
    return "with " + ", ".join(parts) + " "


def _perm(spark: SparkSession, n: int) -> DataFrame:
    """old_row = new_row * 37 mod n, a permutation as 37 does not divide n."""
    return spark.range(n).select(F.col("id").alias("new_row"), (F.col("id") * 37 % n).alias("old_row"))


def _vectors(spark: SparkSession, m: Matrix) -> tuple[DataFrame, DataFrame]:
    x = spark.range(m.ncols).select(F.col("id").alias("idx"), ((F.col("id") % 7) + 1).cast("double").alias("val"))
    y = spark.range(m.nrows).select(F.col("id").alias("idx"), (F.col("id") % 5).cast("double").alias("val"))
    return x, y


def _gram(a: Matrix) -> Matrix:
    """The transpose without summing: a's entries are one a cell."""
    return Matrix(a.entries.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"), a.ncols, a.nrows)


# Entries and conversions.

@_add("csr_row_offsets", _with(OP) + f"select r.range i, coalesce(sum(n) over (order by r.range rows between unbounded preceding and 1 preceding), 0)::bigint as start from range(0, {N_ORD}) r left join (select i, count(*) n from op group by i) c on c.i = r.range")
def _(s, d):
    return layouts.csr_row_offsets(fixtures.order_part(s, d))


@_add("csr_rows", _with(SP) + "select i, cast(len(list(j)) as bigint) n, cast(list(j order by j) as varchar) cols, sum(v) total from sp group by i")
def _(s, d):
    rows = layouts.csr_rows(fixtures.supplier_part(s, d))
    return rows.select("i", F.size("cols").cast("long").alias("n"), F.concat(F.lit("["), F.array_join(F.transform("cols", lambda c: c.cast("string")), ", "), F.lit("]")).alias("cols"), F.aggregate("vals", F.lit(0.0), lambda a, b: a + b).alias("total"))


@_add("compact_entries", _with(RAW) + "select i, j, sum(v) v from raw group by i, j having sum(v) <> 0")
def _(s, d):
    return fixtures.order_part(s, d, raw=True).compact().entries


@_add("ell_layout", _with(OP, "s as (select *, row_number() over (partition by i order by j) - 1 slot from op)") + f"select r.range i, w.range::int slot, coalesce(s.j, -1) j, coalesce(s.v, 0.0) v from range(0, {N_ORD}) r cross join range(0, (select max(slot) + 1 from s)) w left join s on s.i = r.range and s.slot = w.range")
def _(s, d):
    return layouts.ell(fixtures.order_part(s, d))


_COUNTS = f"c as (select r.range i, coalesce(n, 0) n from range(0, {N_ORD}) r left join (select i, count(*) n from op group by i) k on k.i = r.range)"
_ORDERED = {
    "sell_chunk_widths": (0, "o as (select i, n, i new_row from c)"),
    "sell_c_sigma_widths": (SIGMA, f"o as (select i, n, (i // {SIGMA}) * {SIGMA} + row_number() over (partition by i // {SIGMA} order by n desc, i desc) - 1 new_row from c)"),
}
for _name, (_sigma, _o) in _ORDERED.items():
    _add(_name, _with(OP, _COUNTS, _o) + f"select new_row // {CHUNK} as chunk, (ceil(max(n) / {ALIGN}) * {ALIGN})::bigint width from o group by 1")(lambda s, d, g=_sigma: layouts.sell_widths(layouts.sell_order(fixtures.order_part(s, d), g, CHUNK), CHUNK, ALIGN))


@_add("sell_c_sigma_reorder", _with(OP, _COUNTS, _ORDERED["sell_c_sigma_widths"][1]) + "select i, n, new_row from o")
def _(s, d):
    return layouts.sell_order(fixtures.order_part(s, d), SIGMA, CHUNK)


@_add("sell_c_r_reorder", _with(OP, _COUNTS) + "select i, n, row_number() over (order by n desc, i desc) - 1 new_row from c")
def _(s, d):
    return layouts.sell_order(fixtures.order_part(s, d), None, CHUNK)


@_add("dia_diagonals", _with(PP) + "select j - i as \"offset\", count(*) n, min(i) first_i, sum(v) total from pp group by 1")
def _(s, d):
    return layouts.dia(fixtures.part_part(s, d), 1 << 30).select("offset", "n", "first_i", F.aggregate(F.map_values("vals"), F.lit(0.0), lambda a, b: a + b).alias("total"))


@_add("bsr_blocks", _with(SP, f"c as (select i // {BLOCK_R} bi, j // {BLOCK_C} bj, (i % {BLOCK_R}) * {BLOCK_C} + j % {BLOCK_C} pos, v from sp)") + "select bi, bj, count(*) n, sum(v) total, sum(v * (pos + 1)) placed from c group by bi, bj")
def _(s, d):
    b = layouts.bsr(fixtures.supplier_part(s, d), BLOCK_R, BLOCK_C)
    return b.select("bi", "bj", "n", F.aggregate("block", F.lit(0.0), lambda a, x: a + x).alias("total"), F.aggregate(F.transform("block", lambda x, p: x * (p + 1)), F.lit(0.0), lambda a, x: a + x).alias("placed"))


@_add("bsr_row_ptr", _with(SP, f"b as (select i // {BLOCK_R} bi, count(distinct j // {BLOCK_C}) n from sp group by 1)") + f"select r.range bi, coalesce(sum(n) over (order by r.range rows between unbounded preceding and 1 preceding), 0)::bigint as start from range(0, ({N_SUPP} + {BLOCK_R - 1}) // {BLOCK_R}) r left join b on b.bi = r.range")
def _(s, d):
    return layouts.bsr_row_ptr(fixtures.supplier_part(s, d), BLOCK_R, BLOCK_C)


@_add("csr5_tiles", _with(OP, f"t as (select (row_number() over (order by i, j) - 1) // {OMEGA * SIGMA5} tile, i from op)") + "select tile, min(i) tile_ptr, max(i) last_row, count(*) n, count(distinct i) < max(i) - min(i) + 1 has_empty from t group by tile")
def _(s, d):
    return layouts.csr5_tiles(fixtures.order_part(s, d), OMEGA, SIGMA5)


_TILED = f"t as (select (row_number() over (order by i, j) - 1) pos, i, (row_number() over (partition by i order by j) = 1)::int head from odd)"
_ODD = "odd as (select l_orderkey * 3 i, l_partkey j from lineitem where l_orderkey % 7 <> 0 group by all)"


def _odd_rows(s, d):
    """The entries of order_part but for one order in seven, with two empty rows after each row."""
    own = fixtures.order_part(s, d)
    return Matrix(own.entries.filter("i % 7 <> 0").select((F.col("i") * 3).alias("i"), "j", "v"), own.nrows * 3, own.ncols)


@_add("csr5_marked", _with(_ODD, _TILED, f"g as (select pos // {OMEGA * SIGMA5} tile, min(i) tile_ptr, max(i) last_row, count(*) n, count(distinct i) < max(i) - min(i) + 1 has_empty from t group by 1)") + "select *, coalesce(has_empty or lead(tile_ptr) over (order by tile) > last_row + 1, false) dirty from g")
def _(s, d):
    return layouts.csr5_marked(layouts.csr5_tiles(_odd_rows(s, d), OMEGA, SIGMA5))


@_add("csr5_lanes", _with(_ODD, _TILED, f"g as (select pos // {OMEGA * SIGMA5} tile, pos % {OMEGA * SIGMA5} // {SIGMA5} lane, string_agg(head::varchar, '' order by pos) flags, sum(head) heads from t group by all)") + "select tile, lane, flags, (sum(heads) over (partition by tile order by lane) - heads)::bigint y_offset from g")
def _(s, d):
    return layouts.csr5_lanes(_odd_rows(s, d), OMEGA, SIGMA5)


@_add("dia_numbers", _with(PP, "f as (select j - i as \"offset\", min(i) first_i from pp group by 1)") + "select \"offset\", row_number() over (order by first_i, \"offset\") - 1 number from f")
def _(s, d):
    m = fixtures.part_part(s, d)
    return layouts.dia_numbers(layouts.dia(m, 1 << 30), m.nrows, m.ncols)


_LANES = "select cluster, j, csz, sum(v * (lane + 1)) placed, sum(v) total, count(*) n from l group by all"
_VOFF = f"z as (select range c, range * (range + 1) // 2 as start, (range + 1) * (range + 2) // 2 as stop from range(0, 10000)), f as (select c cluster, start, least(stop, {N_SUPP}) stop from z where start < {N_SUPP})"


def _growing(spark: SparkSession, n: int) -> DataFrame:
    """Clusters of 1, 2, 3, ... rows, the last one cut."""
    c = spark.range(int((2 * n) ** 0.5) + 2).select(F.col("id").alias("cluster"), (F.col("id") * (F.col("id") + 1) / 2).cast("long").alias("start"), ((F.col("id") + 1) * (F.col("id") + 2) / 2).cast("long").alias("stop"))
    return c.filter(F.col("start") < n).withColumn("stop", F.least("stop", F.lit(n)))


def _shown(layout: DataFrame) -> DataFrame:
    lanes = layout.select("cluster", "j", F.col("csz").cast("long").alias("csz"), F.aggregate(F.transform("lanes", lambda x, p: x * (p + 1)), F.lit(0.0), lambda a, x: a + x).alias("placed"), F.aggregate("lanes", F.lit(0.0), lambda a, x: a + x).alias("total"), F.size(F.filter("lanes", lambda x: x != 0)).cast("long").alias("n"))
    return lanes


@_add("fcluster_layout", _with(SP, f"l as (select i // {CLUSTER} cluster, j, {CLUSTER}::bigint csz, i % {CLUSTER} lane, v from sp)") + _LANES)
def _(s, d):
    m = fixtures.supplier_part(s, d)
    return _shown(layouts.cluster_layout(m, layouts.fixed_clusters(m, CLUSTER)))


@_add("fcluster_to_entries", _with(SP) + "select i, j, v from sp where abs(v) >= 1e-6")
def _(s, d):
    m = fixtures.supplier_part(s, d)
    own = layouts.fixed_clusters(m, CLUSTER)
    return layouts.cluster_to_entries(layouts.cluster_layout(m, own), own, 1e-6)


@_add("vcluster_layout", _with(SP, _VOFF, "l as (select cluster, j, stop - start csz, i - start lane, v from sp join f on i >= start and i < stop)") + _LANES)
def _(s, d):
    m = fixtures.supplier_part(s, d)
    return _shown(layouts.cluster_layout(m, layouts.variable_clusters(m, _growing(s, m.nrows))))


@_add("vcluster_to_entries", _with(SP) + "select i, j, v from sp where v <> 0")
def _(s, d):
    m = fixtures.supplier_part(s, d)
    own = layouts.variable_clusters(m, _growing(s, m.nrows))
    return layouts.cluster_to_entries(layouts.cluster_layout(m, own), own)


_P = f"p as (select range new_row, range * 37 % {N_SUPP} old_row from range(0, {N_SUPP}))"


@_add("reorder_rows", _with(SP, _P) + "select new_row i, j, v from sp join p on sp.i = p.old_row")
def _(s, d):
    m = fixtures.supplier_part(s, d)
    return m.reorder(_perm(s, m.nrows)).entries


@_add("inverse_permutation", _with(_P) + "select old_row new_row, new_row old_row from p")
def _(s, d):
    return invert(_perm(s, fixtures.supplier_part(s, d).nrows))


@_add("transpose", _with(RAW) + "select j i, i j, sum(v) v from raw group by all having sum(v) <> 0")
def _(s, d):
    return fixtures.order_part(s, d, raw=True).transpose().entries


@_add("binary_pattern", _with(RAW) + "select i, j, 1.0::double v from raw")
def _(s, d):
    return fixtures.order_part(s, d, raw=True).pattern().entries


@_add("sort_columns", _with(SP) + "select i, j, v from sp order by i, j")
def _(s, d):
    return fixtures.supplier_part(s, d).sorted()


@_add("rows_sorted_unique", "select l_orderkey i, coalesce(bool_and(l_partkey > prev), true) ok from (select *, lag(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey) prev from lineitem) group by 1")
def _(s, d):
    line = s.read.parquet(f"{d}/lineitem.parquet")
    cells = line.select(F.col("l_orderkey").alias("i"), F.col("l_partkey").alias("j"), F.struct("l_linenumber", "l_partkey").alias("at"))
    return rows_sorted_unique(Matrix(cells, 0, 0), "at")


# Products with a vector.

_SPMV = _with(SP, VX, VY) + f"select y.idx i, round({ALPHA}::double * coalesce(s, 0) + {BETA}::double * y.val, 6) y from y left join (select i, sum(v * val) s from sp join x on x.idx = sp.j group by i) t on t.i = y.idx"
for _layout in LAYOUTS:

    @_add(f"spmv_{_layout}", _SPMV)
    def _(s, d, layout=_layout):
        m = fixtures.supplier_part(s, d)
        return spmv(m, *_vectors(s, m), ALPHA, BETA, layout, CHUNK, SIGMA, ALIGN).select("i", F.round("y", 6).alias("y"))


# Products of matrices.

_GRAM = _with(SP) + "select a.i, b.i j, sum(a.v * b.v) v from sp a join sp b on a.j = b.j group by all"


def _product(name: str, strategy: str, members=None):
    @_add(name, _GRAM)
    def _(s, d):
        a = fixtures.supplier_part(s, d)
        return spgemm.spgemm(a, _gram(a), strategy, members=members(s, a) if members else None).entries


_product("spgemm_hash", "hash")
_product("spgemm_sorted", "sorted")
_product("spgemm_spa", "spa")
_product("spgemm_fcluster", "cluster", lambda s, a: layouts.fixed_clusters(a, CLUSTER))
_product("spgemm_vcluster", "cluster", lambda s, a: layouts.variable_clusters(a, _growing(s, a.nrows)))
_product("spgemm_mixed", "mixed", lambda s, a: layouts.fixed_clusters(a, CLUSTER))


@_add("spgemm_square", _with(PP) + "select a.i, b.j, sum(a.v * b.v) v from pp a join pp b on a.j = b.i group by all")
def _(s, d):
    a = fixtures.part_part(s, d)
    return spgemm.spgemm(a, a).entries


@_add("spgemm_flops", _with(PP) + "select (2 * sum(n))::bigint flops from pp a join (select i, count(*) n from pp group by i) b on a.j = b.i")
def _(s, d):
    a = fixtures.part_part(s, d)
    return spgemm.flops(a, a)


@_add("spgemm_symbolic_nnz", _with(PP) + "select a.i, count(distinct b.j) nnz from pp a join pp b on a.j = b.i group by 1")
def _(s, d):
    a = fixtures.part_part(s, d)
    return spgemm.symbolic(a, a)


@_add("spgemm_reordered", _with(SP, _P) + "select p.new_row i, b.i j, sum(a.v * b.v) v from sp a join sp b on a.j = b.j join p on p.old_row = a.i group by all")
def _(s, d):
    a = fixtures.supplier_part(s, d)
    return spgemm.spgemm(a.reorder(_perm(s, a.nrows)), _gram(a)).entries


@_add("topk_jaccard", _with(SP, "c as (select a.i, b.i j, count(*) c from sp a join sp b on a.j = b.j and a.i <> b.i group by all)", "n as (select i, count(*) n from sp group by i)", "s as (select c.i, c.j, c / (a.n + b.n - c) jaccard from c join n a on a.i = c.i join n b on b.i = c.j)") + "select i, j, jaccard from s qualify row_number() over (partition by i order by jaccard desc, j) <= 7")
def _(s, d):
    return spgemm.topk_jaccard(fixtures.supplier_part(s, d))


# Work and partitions.

_WORK = f"w as (select r.range i, coalesce(sum(n), 0)::bigint as work from range(0, {N_PART}) r left join pp a on a.i = r.range left join (select i, count(*) n from pp group by i) b on b.i = a.j group by 1)"


@_add("row_work", _with(PP, _WORK) + "select i, work from w")
def _(s, d):
    a = fixtures.part_part(s, d)
    return work.row_work(a, a)


@_add("work_bins", _with(PP, _WORK) + f"select i, work, case when work = 0 then 0 else 1 + (select min(k.range) from range(0, 60) k where least(work, {N_PART}) <= 8 * 2 ** k.range) end::int bin from w")
def _(s, d):
    a = fixtures.part_part(s, d)
    return work.bins(work.row_work(a, a), a.ncols)


def _ranges_sql(share: str) -> str:
    return f"s as (select i, work, sum(work) over (order by i) - work before from w), t as (select {share} share from w), p as (select range part from range(0, {PARTS})) select p.part, coalesce((select min(i) from s where before >= p.part * (select share from t)), (select max(i) + 1 from s))::bigint as start from p"


@_add("work_partition", _with(PP, _WORK, _ranges_sql(f"ceil(sum(work) / {PARTS})::bigint")))
def _(s, d):
    a = fixtures.part_part(s, d)
    return work.ranges(work.row_work(a, a), "i", PARTS)


@_add("nnz_partition", _with(OP, f"w as (select r.range i, coalesce(n, 0) as work from range(0, {N_ORD}) r left join (select i, count(*) n from op group by i) k on k.i = r.range)", _ranges_sql(f"sum(work)::bigint // {PARTS}")))
def _(s, d):
    return work.ranges(fixtures.order_part(s, d).row_counts().withColumnRenamed("n", "work"), "i", PARTS, floor=True)


_LOADS = f"w as (select i // {CHUNK} as i, sum(n)::bigint as work from c group by 1)"


@_add("sell_partition", _with(OP, _COUNTS, _LOADS, _ranges_sql(f"sum(work)::bigint // {PARTS}")))
def _(s, d):
    counts = layouts.sell_order(fixtures.order_part(s, d), 0, CHUNK)
    return work.ranges(counts.groupBy(F.floor(F.col("new_row") / CHUNK).alias("i")).agg(F.sum("n").alias("work")), "i", PARTS, floor=True)


@_add("ell_greedy_partition", "with recursive " + ", ".join([OP, _COUNTS, "s as (select i, (sum(n) over (order by i) - n)::bigint before, (sum(n) over (order by i))::bigint upto from c)", f"t as (select greatest(max(upto) // {PARTS}, 1) share, max(i) + 1 stop from s)", f"g as (select 0::bigint part, 0::bigint as start, 0::bigint base union all select g.part + 1, s.i + 1, s.upto from g, t, s where s.before < g.base + t.share and s.upto >= g.base + t.share and g.part + 1 < {PARTS})"]) + f" select p.range part, coalesce(g.start, t.stop) as start from range(0, {PARTS}) p cross join t left join g on g.part = p.range")
def _(s, d):
    return work.greedy_ranges(fixtures.order_part(s, d).row_counts().withColumnRenamed("n", "work"), "i", PARTS)


_CW = "k as (select distinct cluster, csz, j from m join pp using (i)), n as (select i j, count(*) n from pp group by i) select c.cluster, coalesce(sum(n.n * k.csz), 0)::bigint as work from (select distinct cluster from m) c left join k using (cluster) left join n using (j) group by 1"
_FM = f"m as (select range i, range // {CLUSTER} cluster, {CLUSTER} csz from range(0, {N_PART}))"


@_add("fcluster_work", _with(PP, _FM, _CW))
def _(s, d):
    a = fixtures.part_part(s, d)
    return work.cluster_work(a, a, layouts.fixed_clusters(a, CLUSTER))


@_add("vcluster_work", _with(PP, _VOFF.replace(N_SUPP, N_PART), f"m as (select r.range i, cluster, stop - start csz from range(0, {N_PART}) r join f on r.range >= start and r.range < stop)", _CW))
def _(s, d):
    a = fixtures.part_part(s, d)
    return work.cluster_work(a, a, layouts.variable_clusters(a, _growing(s, a.nrows)))


@_add("classify_clusters", _with(PP, _FM, "k as (select distinct cluster, csz, j from m join pp using (i))", "a as (select cluster, csz, count(*) acols from k group by all)", "o as (select distinct k.cluster, b.j c from k join pp b on b.i = k.j)", "q as (select cluster, count(*) nnz, min(c) min_col, max(c) max_col from o group by 1)") + f"select cluster, csz, acols, nnz, min_col, max_col, (nnz / (max_col - min_col + 1) >= {work.DENSE_SHARE} and acols * ((select count(*) from pp) / {N_PART} * 16) + (max_col - min_col + 1) * csz * 8 <= {work.CACHE_BYTES * work.CACHE_SHARE})::int dense from a join q using (cluster)")
def _(s, d):
    a = fixtures.part_part(s, d)
    return work.classify(a, a, layouts.fixed_clusters(a, CLUSTER))


@_add("prefix_sums", _with(OP, _COUNTS) + "select i, n, (sum(n) over (order by i) - n)::bigint as before from c")
def _(s, d):
    return prefix_sum(fixtures.order_part(s, d).row_counts(), "i", "n")


@_add("prefix_sums_weighted", _with(OP, _COUNTS) + "select i, n, (sum(n) over (order by i) - n)::bigint as before, (sum(n * (i % 5 + 1)) over (order by i) - n * (i % 5 + 1))::bigint as weighted, (sum(n * 3) over (order by i) - n * 3)::bigint as tripled from c")
def _(s, d):
    n = F.col("n")
    return prefix_sums(fixtures.order_part(s, d).row_counts(), "i", {"before": n, "weighted": n * (F.col("i") % 5 + 1), "tripled": n * 3})


def _slots(order: str) -> str:
    return f"(select sum(w) * {CHUNK} from (select ceil(max(n) / {ALIGN}) * {ALIGN} w from ({order}) group by new_row // {CHUNK}))"


_ROWS_SP = f"c as (select r.range i, coalesce(n, 0) n from range(0, {N_SUPP}) r left join (select i, count(*) n from sp group by i) k on k.i = r.range)"
_SIZES = f"z as (select (select count(*) from sp) nnz, (select count(*) from c) nr, (select count(*) from c where n > 0) used, (select max(n) from c) widest, (select count(*) from (select distinct i // {BLOCK_R}, j // {BLOCK_C} from sp)) nb, {_slots('select n, i new_row from c')} s0, {_slots(f'select n, (i // {SIGMA}) * {SIGMA} + row_number() over (partition by i // {SIGMA} order by n desc, i desc) - 1 new_row from c')} s1, {_slots('select n, row_number() over (order by n desc, i desc) - 1 new_row from c')} s2)"
_BYTES = {
    "coo": "32 * nnz + 16 * used",
    "csr": "24 * nnz + 32 * nr",
    "csr5": f"24 * nnz + 32 * nr + 8 * (ceil(nnz / {OMEGA * SIGMA5}) + 1)",
    "bsr": f"16 * ceil(nr / {BLOCK_R}) + 8 * nb + 16 * nb * {BLOCK_R * BLOCK_C} + 16 * nr",
    "dia": "16 * nnz + 16 * nr",
    "ell": "16 * nr * widest + 8 * nnz + 16 * nr",
    "sell": f"8 * ceil(nr / {CHUNK}) + 16 * s0 + 8 * nnz + 16 * nr",
    "sell_c_sigma": f"8 * ceil(nr / {CHUNK}) + 16 * s1 + 8 * nnz + 24 * nr",
    "sell_c_r": f"8 * ceil(nr / {CHUNK}) + 16 * s2 + 8 * nnz + 24 * nr",
}


@_add("bytes_per_spmv", _with(SP, _ROWS_SP, _SIZES) + " union all ".join(f"select '{k}' layout, ({v})::bigint as bytes from z" for k, v in _BYTES.items()))
def _(s, d):
    return work.bytes_per_spmv(fixtures.supplier_part(s, d), BLOCK_R, BLOCK_C, OMEGA, SIGMA5, CHUNK, SIGMA, ALIGN)


@_add("best_bsr_dim", f"select d.range::bigint as size from range(1, 65) d order by abs(ceil({N_PART} / d.range) - 256), d.range limit 1")
def _(s, d):
    return s.createDataFrame([(work.best_block(fixtures.supplier_part(s, d).ncols, 256),)], "size long")


# Similarity.

@_add("exact_jaccard", _with(DT, f"p as (select range a, range + 1 b from range(0, {N_DOC} - 1))", "n as (select i, count(*) n from dt group by i)", "c as (select a, b, count(*) c from p join dt x on x.i = a join dt y on y.i = b and x.j = y.j group by all)") + "select p.a, p.b, case when coalesce(u.n, 0) + coalesce(w.n, 0) = 0 then 0 else coalesce(c, 0) / (coalesce(u.n, 0) + coalesce(w.n, 0) - coalesce(c, 0)) end jaccard from p left join c using (a, b) left join n u on u.i = p.a left join n w on w.i = p.b")
def _(s, d):
    m = fixtures.document_tokens(s, d)
    return similarity.exact_jaccard(m, s.range(m.nrows - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))


@_add("jaccard_offsets", "with recursive " + ", ".join([DT, "n as (select i, count(*) n from dt group by i)", f"p as (select a.range a, a.range + k.range b from range(0, {N_DOC}) a, range(1, 8) k where a.range + k.range < {N_DOC})", "c as (select a, b, count(*) c from p join dt x on x.i = a join dt y on y.i = b and x.j = y.j group by all)", "q as (select a, min(b) stop from (select p.a, p.b, case when coalesce(u.n, 0) + coalesce(w.n, 0) = 0 then 0 else coalesce(c, 0) / (coalesce(u.n, 0) + coalesce(w.n, 0) - coalesce(c, 0)) end s from p left join c using (a, b) left join n u on u.i = p.a left join n w on w.i = p.b) where s < 0.05::double - 1e-6 group by a)", f"s as (select r.range i, least(coalesce(stop, r.range + 8), {N_DOC}) nxt from range(0, {N_DOC}) r left join q on q.a = r.range)", f"t as (select 0::bigint as start, 0::bigint as cluster union all select nxt, cluster + 1 from t join s on s.i = t.start where nxt < {N_DOC})"]) + " select cluster, start, nxt as stop from t join s on s.i = t.start")
def _(s, d):
    return similarity.consecutive_clusters(fixtures.document_tokens(s, d), 0.05)


@_add("simple_offsets", f"select range cluster, range * {CLUSTER} as start, least((range + 1) * {CLUSTER}, {N_ORD}) as stop from range(0, ({N_ORD} + {CLUSTER - 1}) // {CLUSTER})")
def _(s, d):
    return similarity.equal_clusters(fixtures.order_part(s, d), CLUSTER)


_COEF = "cf as (select * from (values " + ", ".join(f"({k}, {a}::hugeint, {b}::hugeint)" for k, (a, b) in enumerate(lsh.coefficients(K, SEED))) + ") t(k, a, b))"
_SIG = f"hs as (select i, k, min((a * j + b) % 18446744073709551616::hugeint) h from dt, cf group by all), sg as (select r.range i, cf.k, coalesce(h, 18446744073709551615::hugeint) h from range(0, {N_DOC}) r cross join cf left join hs on hs.i = r.range and hs.k = cf.k), sl as (select i, list((case when h >= 9223372036854775808::hugeint then h - 18446744073709551616::hugeint else h end)::bigint order by k) sig from sg group by i)"
_BND = f"bd as (select i, b.range band, sig[b.range * {K // BANDS} + 1:(b.range + 1) * {K // BANDS}] part from sl, range(0, {BANDS}) b)"
_EST = f"(select count(*) from (select unnest(x.sig) a, unnest(y.sig) b) where a = b) / {K}"


def _sigs(s, d):
    return lsh.signatures(fixtures.document_tokens(s, d), K, SEED)


def _text(c):
    return F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: x.cast("string")), ", "), F.lit("]"))


@_add("minhash_signatures", _with(DT, _COEF, _SIG) + "select i, cast(sig as varchar) sig from sl")
def _(s, d):
    return _sigs(s, d).select("i", _text("sig").alias("sig"))


@_add("lsh_bands", _with(DT, _COEF, _SIG, _BND) + "select i, band::int band, cast(part as varchar) part from bd")
def _(s, d):
    return lsh.bands(_sigs(s, d), K, BANDS).select("i", "band", _text("part").alias("part"))


_CAPPED = f"r as (select *, row_number() over (partition by band, part order by i) rn, count(*) over (partition by band, part) n from bd), pr as (select distinct a.i, b.i j from r a join r b on a.band = b.band and a.part = b.part and b.rn > a.rn and (a.n <= %d or b.rn <= a.rn + %d))"


@_add("lsh_pairs_capped", _with(DT, _COEF, _SIG, _BND, _CAPPED % (CAP_LIMIT, CAP_WINDOW)) + "select i, j from pr")
def _(s, d):
    return lsh.bucket_pairs(lsh.bands(_sigs(s, d), K, BANDS), CAP_LIMIT, CAP_WINDOW)


@_add("lsh_pairs_naive", _with(DT, _COEF, _SIG, _BND) + "select distinct a.i, b.i j from bd a join bd b on a.band = b.band and a.part = b.part and a.i < b.i")
def _(s, d):
    return lsh.bucket_pairs(lsh.bands(_sigs(s, d), K, BANDS), None)


@_add("lsh_candidates", _with(DT, _COEF, _SIG, _BND, _CAPPED % (256, 16)) + f"select pr.i, pr.j, len(list_filter(list_zip(x.sig, y.sig), lambda z: z[1] = z[2])) / {K} score from pr join sl x on x.i = pr.i join sl y on y.i = pr.j")
def _(s, d):
    return lsh.candidates(fixtures.document_tokens(s, d), K, BANDS, SEED, 256, 16)


@_add("est_jaccard", _with(DT, _COEF, _SIG) + f"select x.i a, y.i b, len(list_filter(list_zip(x.sig, y.sig), lambda z: z[1] = z[2])) / {K} score from sl x join sl y on y.i = x.i + 1")
def _(s, d):
    sigs = _sigs(s, d)
    nxt = sigs.select((F.col("i") - 1).alias("i"), F.col("i").alias("b"), F.col("sig").alias("other"))
    return sigs.join(nxt, "i").select(F.col("i").alias("a"), "b", lsh.estimated_jaccard(F.col("sig"), F.col("other")).alias("score"))


def _hc(s, d, strategy="heap"):
    return cluster.preprocess(fixtures.document_tokens(s, d), K, BANDS, SEED, CLUSTER, strategy=strategy)


QUERIES["hc_fast"] = QUERIES["hc_v1"] = _hc
QUERIES["hc_v0"] = lambda s, d: _hc(s, d, strategy="members")


@_add("clsh_pipeline", f"select {N_DOC} as rows, true as permutes, true as covers, true as whole_clusters, true as in_bounds")
def _(s, d):
    """Signatures to permutation and offsets, told by what must hold of them."""
    m = fixtures.document_tokens(s, d)
    roots = materialize(_hc(s, d), "clsh-roots")
    perm, offsets = cluster.permutation(roots, m.nrows)
    told = perm.agg(F.count("*").alias("rows"), ((F.count_distinct("old_row") == m.nrows) & (F.count_distinct("new_row") == m.nrows) & (F.min("new_row") == 0) & (F.max("new_row") == m.nrows - 1)).alias("permutes"))
    spans = offsets.agg(((F.sum(F.col("stop") - F.col("start")) == m.nrows) & (F.min("start") == 0) & (F.max("stop") == m.nrows)).alias("covers"), (F.max(F.col("stop") - F.col("start")) <= 2 * CLUSTER - 2).alias("in_bounds"))
    placed = perm.join(roots, F.col("old_row") == F.col("i")).groupBy("root").agg((F.max("new_row") - F.min("new_row") + 1 == F.count("*")).alias("run"))
    return told.crossJoin(placed.agg(F.bool_and("run").alias("whole_clusters"))).crossJoin(spans).select("rows", "permutes", "covers", "whole_clusters", "in_bounds")


@_add("hc_linked", _with(DT, _COEF, _SIG, _BND, "pr as (select distinct a.i, b.i j from bd a join bd b on a.band = b.band and a.part = b.part and a.i < b.i)") + f"select {N_DOC} as rows, 0::bigint as strays, 0::bigint as outside, {N_DOC} - (select count(*) from (select i from pr union select j from pr)) as alone from (select 1)")
def _(s, d):
    """Roots that are not their own root, members that no pairs link to their root, rows without any pair.

    All pairs of every bucket count. What they link is what the links of their buckets do, so no pair is written.
    """
    m, sets = cluster.read_once(fixtures.document_tokens(s, d))
    sigs = materialize(lsh.packed_signatures(m, K, SEED), "hc-all-signatures")
    roots = materialize(cluster.preprocess(m, K, BANDS, SEED, CLUSTER, sets=sets, sigs=sigs), "hc-all-roots")
    parts = connected_components(lsh.Buckets(sigs, K, BANDS, m.ncols).links(), "i", "j").select(F.col("node").alias("i"), "component")
    named = roots.join(parts, "i", "left").select("i", "root", F.coalesce("component", "i").alias("part"), F.col("component").isNull().alias("alone"))
    top = named.select(F.col("i").alias("root"), F.col("root").alias("own"), F.col("part").alias("root_part"))
    return named.join(top, "root").agg(F.count("*").alias("rows"), F.count_if(F.col("own") != F.col("root")).alias("strays"), F.count_if(F.col("part") != F.col("root_part")).alias("outside"), F.count_if(F.col("alone")).alias("alone"))


QUERIES["hc_permutation"] = lambda s, d: cluster.permutation(_hc(s, d), fixtures.document_tokens(s, d).nrows)[0]
QUERIES["hc_offsets"] = lambda s, d: cluster.permutation(_hc(s, d), fixtures.document_tokens(s, d).nrows)[1]


@_add("spgemm_clsh", _with(SP) + "select a.i, b.i j, sum(a.v * b.v) v from sp a join sp b on a.j = b.j group by all")
def _(s, d):
    """The whole chain: signatures, pairs, clusters, permutation, clustered product with the mixed choice, rows put back."""
    a = fixtures.supplier_part(s, d)
    perm, offsets = cluster.permutation(cluster.preprocess(a, K, BANDS, SEED, CLUSTER), a.nrows)
    moved = a.reorder(perm)
    c = spgemm.spgemm(moved, _gram(a), "mixed", members=layouts.variable_clusters(moved, offsets))
    return c.reorder(invert(perm)).entries


# Features.

@_add("feat_basic", _with(PP) + f"select {N_PART} nrows, {N_PART} ncols, count(*) nnz, count(*) / ({N_PART}::double * {N_PART}) density from pp")
def _(s, d):
    return features.basic(fixtures.part_part(s, d))


@_add("feat_triangles", _with(PP) + "select count(*) filter (where i > j) lower, count(*) filter (where i < j) upper, count(*) filter (where i = j) diagonal from pp")
def _(s, d):
    return features.triangles(fixtures.part_part(s, d))


@_add("feat_diagonals", _with(PP) + f"select count(distinct j - i) diagonals, count(*) filter (where abs(j - i) <= (2 * {N_PART} - 1) // 20) / count(*) near_share from pp")
def _(s, d):
    return features.diagonals(fixtures.part_part(s, d))


def _spread_sql(source: str, shift: int = 0) -> str:
    return f"select (count(*) filter (where n > 0) - {shift}) / count(*) nonempty, min(n) least, max(n) most, sum(n)::bigint / count(*) mean, round((count(*) * sum(n * n)::bigint - sum(n)::bigint * sum(n)::bigint)::double / (count(*) * count(*)) - {shift} / count(*), 6) variance, round(sqrt(greatest((count(*) * sum(n * n)::bigint - sum(n)::bigint * sum(n)::bigint)::double / (count(*) * count(*)) - {shift} / count(*), 0)), 6) deviation from {source}"


def _block_sql(at: str, n: str) -> str:
    return f"(case when {at} < ({n} % 256) * ({n} // 256 + 1) then {at} // ({n} // 256 + 1) else ({n} % 256) + ({at} - ({n} % 256) * ({n} // 256 + 1)) // greatest({n} // 256, 1) end)"


_T = f"t as (select i, j, v, {_block_sql('i', N_PART)} tile_r, {_block_sql('j', N_PART)} tile_c from pp)"
_COUNT_SQL = {
    "row": [PP, f"k as (select r.range id, coalesce(n, 0) n from range(0, {N_PART}) r left join (select i, count(*) n from pp group by i) c on c.i = r.range)"],
    "col": [PP, f"k as (select r.range id, coalesce(n, 0) n from range(0, {N_PART}) r left join (select j, count(*) n from pp group by j) c on c.j = r.range)"],
}
for _by, _key, _n in (("tile", "tile_r * 256 + tile_c", 65536), ("rb", "tile_r", 256), ("cb", "tile_c", 256)):
    _COUNT_SQL[_by] = [PP, _T, f"k as (select r.range id, coalesce(n, 0) n from range(0, {_n}) r left join (select {_key} id, count(*) n from t group by 1) c on c.id = r.range)"]


def _counts(m: Matrix, by: str) -> DataFrame:
    return m.row_counts() if by == "row" else m.col_counts() if by == "col" else features.block_counts(m, by)


for _by in _COUNT_SQL:
    _add({"row": "feat_rows", "col": "feat_cols", "tile": "feat_tiles"}.get(_by, f"feat_{_by}"), _with(*_COUNT_SQL[_by]) + _spread_sql("k"))(lambda s, d, by=_by: features.spread(_counts(fixtures.part_part(s, d), by)))
    _add(f"feat_pratio_{_by}", _with(*_COUNT_SQL[_by], "o as (select row_number() over (order by n desc, id) c, sum(n) over (order by n desc, id rows unbounded preceding) s, count(*) over () z, sum(n) over () w from k)") + "select min(c / z) p from o where c * w + s * z >= z * w")(lambda s, d, by=_by: features.p_ratio(_counts(fixtures.part_part(s, d), by)))
    _add(f"feat_gini_{_by}", _with(*_COUNT_SQL[_by], "o as (select sum(n) over (order by n, id rows unbounded preceding) c, count(*) over () z, sum(n) over () w from k)") + "select round((any_value(w) * any_value(z) / 2 - (sum(c) - any_value(w) / 2)) / (any_value(w) * any_value(z) / 2), 9) gini from o")(lambda s, d, by=_by: features.gini(_counts(fixtures.part_part(s, d), by)))
    if _by in ("tile", "rb", "cb"):
        _add(f"feat_{_by}_shifted", _with(*_COUNT_SQL[_by]) + _spread_sql("k", 1))(lambda s, d, by=_by: features.spread(_counts(fixtures.part_part(s, d), by), shifted=True))
        _line, _id = ("j", "tile_c") if _by == "cb" else ("i", "tile_r" if _by == "rb" else "tile_r * 256 + tile_c")
        _add({"tile": "feat_tile_rows", "rb": "feat_rb_rows", "cb": "feat_cb_cols"}[_by], _with(PP, _T, f"q as (select {_id} id, {_line} line, count(*) n from t group by all)") + "select id, count(*) as lines, max(n) most, round(avg(n), 6) mean, round(sqrt((count(*) * sum(n * n) - sum(n) * sum(n))::double / (count(*) * count(*))), 6) deviation from q group by id")(lambda s, d, by=_by: features.inner_counts(fixtures.part_part(s, d), by))

_SYM = "select count(b.v) / count(*) as pattern, count(*) filter (where round(a.v, 6) = round(b.v, 6)) / count(*) as value, (count(b.v) = count(*) and count(*) filter (where round(a.v, 6) = round(b.v, 6)) = count(*))::int is_symmetric from (select * from {0} where i <> j) a left join {0} b on a.i = b.j and a.j = b.i"


@_add("feat_symmetry", _with(PP) + _SYM.format("pp"))
def _(s, d):
    return features.symmetry(fixtures.part_part(s, d))


@_add("feat_symmetry_small", _with(CN) + _SYM.format("cn"))
def _(s, d):
    return features.symmetry(fixtures.nation_nation(s, d))


@_add("feat_diag_dominance", _with(CN, "r as (select i, coalesce(sum(abs(v)) filter (where i = j), 0) - coalesce(sum(abs(v)) filter (where i <> j), 0) d from cn group by i)") + "select count(*) filter (where d > 0) / 25 dominance from r")
def _(s, d):
    return features.diagonal_dominance(fixtures.nation_nation(s, d))


@_add("feat_max_values", _with(PP) + "select coalesce(max(abs(v)) filter (where i = j), 0.0) on_diagonal, coalesce(max(abs(v)) filter (where i <> j), 0.0) off_diagonal from pp")
def _(s, d):
    return features.max_values(fixtures.part_part(s, d))


for _key, _name in (("i", "row"), ("j", "col")):
    _add(f"feat_variability_{_name}", _with(EM, f"g as (select greatest(0, max(log10(abs(v)))) top, least(0, min(log10(abs(v)))) low from em where v <> 0 group by {_key})") + "select coalesce(round(max(top - low), 6), -1.0) variability from g where low <> 0")(lambda s, d, key=_key: features.variability(fixtures.embeddings(s, d), key))


@_add("tile_ids", _with(PP, _T) + "select i, j, tile_r::bigint tile_r, tile_c::bigint tile_c from t")
def _(s, d):
    return features.tile_ids(fixtures.part_part(s, d))


@_add("feat_reuse", _with(PP, _T, "r as (select count(*) n from (select distinct i, tile_c from t))", "c as (select count(*) n from (select distinct j, tile_r from t))", "z as (select count(*) n from pp)") + f"select r.n / z.n uniq_r, c.n / z.n uniq_c, r.n / {N_PART} reuse_r, c.n / {N_PART} reuse_c from r, c, z")
def _(s, d):
    return features.reuse(fixtures.part_part(s, d))


@_add("feat_grx", _with(PP, _T, "r as (select count(*) n from (select distinct i // 8, tile_r, tile_c from t))", "c as (select count(*) n from (select distinct j // 8, tile_r, tile_c from t))", "z as (select count(*) n from pp)") + f"select r.n / z.n group_uniq_r, c.n / z.n group_uniq_c, r.n / {N_PART} group_reuse_r, c.n / {N_PART} group_reuse_c from r, c, z")
def _(s, d):
    return features.group_reuse(fixtures.part_part(s, d))


@_add("feat_row_distance", _with(PP, "r as (select i, (max(j) - min(j)) / count(*) d from pp group by i)") + f"select round(sum(d) / {N_PART}, 6) distance, round(sum(d) / {N_PART} / {N_PART}, 6) share from r")
def _(s, d):
    return features.row_distance(fixtures.part_part(s, d))


# Comparison.

@_add("max_rel_error", _with(SP) + "select round(max(abs(v - round(v * 1.01, 1)) / (abs(v) + abs(round(v * 1.01, 1)) + sqrt(2.220446049250313e-16))), 9) error from sp")
def _(s, d):
    m = fixtures.supplier_part(s, d).entries
    return features.max_relative_error(m, m.withColumn("v", F.round(F.col("v") * 1.01, 1)), ["i", "j"])


@_add("compare_entries", _with(SP) + "select i, j, v x, v + (i % 3) y from sp where i % 3 <> 0")
def _(s, d):
    m = fixtures.supplier_part(s, d).entries
    return features.differing(m, m.withColumn("v", F.col("v") + F.col("i") % 3), ["i", "j"])


@_add("compare_pairs", _with(SP, "a as (select i, j, v / 50 x from sp where i % 2 = 0)", "b as (select i, j, v / 50 + case when j % 7 = 0 then 0.5::double else 1e-9::double end y from sp where i % 2 = 0 and j % 5 <> 0 or i % 10 = 1 and j < 20)") + "select i, count(*) filter (where y is null) only_a, count(*) filter (where x is null) only_b, count(*) filter (where abs(x - y) > 1e-6::double) different from a full join b using (i, j) group by i having count(*) filter (where x is null or y is null or abs(x - y) > 1e-6::double) > 0")
def _(s, d):
    m = fixtures.supplier_part(s, d).entries
    a = m.filter("i % 2 = 0").select("i", "j", (F.col("v") / 50).alias("score"))
    b = m.filter("i % 2 = 0 and j % 5 <> 0 or i % 10 = 1 and j < 20").select("i", "j", (F.col("v") / 50 + F.when(F.col("j") % 7 == 0, 0.5).otherwise(1e-9)).alias("score"))
    return features.compare_pairs(a, b)


@_add("best_rows", "select o_custkey, o_orderkey, o_totalprice from orders qualify row_number() over (partition by o_custkey order by o_totalprice, o_orderkey) = 1")
def _(s, d):
    return logs.best_rows(fixtures.table(s, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", "o_totalprice", "o_orderkey")


# Files, written to and read from the shared folder.

@_add("mtx_roundtrip", _with(SP) + "select i, j, v from sp")
def _(s, d):
    path = fresh_path(s, "matrix")
    mtx.write_mtx(fixtures.supplier_part(s, d), path, parts=4)
    return mtx.read_mtx(s, path).entries


@_add("permutation_read", _with(_P) + "select new_row, old_row from p")
def _(s, d):
    n = fixtures.supplier_part(s, d).nrows
    path = fresh_path(s, "permutation")
    mtx.write_rows(_perm(s, n), "old_row", "new_row", path, parts=4)
    return mtx.read_permutation(s, path, n)


@_add("offsets_read", f"select range cluster, range * {CLUSTER} as start, least((range + 1) * {CLUSTER}, {N_SUPP}) as stop from range(0, ({N_SUPP} + {CLUSTER - 1}) // {CLUSTER})")
def _(s, d):
    m = fixtures.supplier_part(s, d)
    marks = similarity.equal_clusters(m, CLUSTER)
    path = fresh_path(s, "offsets")
    every = marks.select("start").unionByName(s.range(1).select(F.lit(m.nrows).cast("long").alias("start")))
    mtx.write_rows(every, "start", "start", path, parts=4)
    return mtx.read_offsets(s, path)


@_add("close_pairs_read", _with(SP, "c as (select a.i, b.i j, count(*) c from sp a join sp b on a.j = b.j and a.i <> b.i group by all)", "n as (select i, count(*) n from sp group by i)") + "select c.i, c.j, c / (a.n + b.n - c) score from c join n a on a.i = c.i join n b on b.i = c.j qualify row_number() over (partition by c.i order by c / (a.n + b.n - c) desc, c.j) <= 7")
def _(s, d):
    path = fresh_path(s, "pairs")
    mtx.write_triples(spgemm.topk_jaccard(fixtures.supplier_part(s, d)), path)
    return mtx.read_pairs(s, path)
