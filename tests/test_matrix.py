"""Matrix operators against plain-Python models, invariants and the DuckDB oracle."""

import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gridwell import catalog
from gridwell.functions.mod64 import affine, signed
from gridwell.operators import cluster, components, features, layouts, lsh, similarity, spgemm, work
from gridwell.operators.components import connected_components
from gridwell.operators.matrix import Matrix, invert, prefix_sum
from gridwell.operators.spmv import LAYOUTS, spmv
from gridwell.plans.microbench import accumulators
from gridwell.sources import logs, mtx
from gridwell.streaming.minhash import streaming_signatures

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def make(spark, cells, nrows, ncols):
    return Matrix(spark.createDataFrame([(i, j, float(v)) for i, j, v in cells], "i long, j long, v double"), nrows, ncols)


def random_cells(seed, nrows, ncols, n):
    r = random.Random(seed)
    return [(r.randrange(nrows), r.randrange(ncols), r.choice([-2, -1, 1, 2, 3])) for _ in range(n)]


def dense(cells):
    out = {}
    for i, j, v in cells:
        out[i, j] = out.get((i, j), 0) + v
    return out


def got(df):
    return {(r.i, r.j): r.v for r in df.collect()}


@pytest.mark.parametrize("name", [n for n in catalog.ORACLE_SQL])
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(catalog.ORACLE_SQL[name]).df()
    have = catalog.QUERIES[name](spark, SF).toPandas()
    assert sorted(have.columns) == sorted(want.columns)
    cols = sorted(have.columns)
    rows = lambda x: sorted(x[cols].astype(object).where(x[cols].notna(), None).itertuples(index=False, name=None), key=repr)
    assert rows(have) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_compact_and_products(spark):
    assert got(make(spark, [(0, 0, 1), (0, 0, 2), (0, 1, 5), (0, 1, -5)], 1, 2).compact().entries) == {(0, 0): 3.0}
    a, b = random_cells(1, 13, 11, 60), random_cells(2, 11, 17, 60)
    want = {}
    for (i, k), v in dense(a).items():
        for (k2, j), w in dense(b).items():
            if k == k2:
                want[i, j] = want.get((i, j), 0) + v * w
    ma, mb = make(spark, a, 13, 11), make(spark, b, 11, 17)
    clear = {c: v for c, v in want.items() if v}
    for strategy in ("hash", "sorted", "spa"):
        assert {c: v for c, v in got(spgemm.spgemm(ma, mb, strategy).entries).items() if v} == clear
    assert got(spgemm.spgemm(ma, mb, drop_zeros=True).entries) == clear
    for members in (layouts.fixed_clusters(ma, 4), layouts.variable_clusters(ma, spark.createDataFrame([(0, 0, 1), (1, 1, 6), (2, 6, 13)], "cluster long, start long, stop long"))):
        for strategy in ("cluster", "mixed"):
            assert got(spgemm.spgemm(ma, mb, strategy, members=members).entries) == clear
    salted = spgemm.products(ma, mb, heavy=5).groupBy("i", "j").agg(F.sum("p").alias("v"))
    assert {c: v for c, v in got(salted).items() if v} == clear
    with pytest.raises(ValueError):
        spgemm.spgemm(ma, ma)


def test_cancelled_cells_stay(spark):
    a, b = make(spark, [(0, 0, 1), (0, 1, 1)], 1, 2), make(spark, [(0, 0, 1), (1, 0, -1)], 2, 1)
    assert got(spgemm.spgemm(a, b).entries) == {(0, 0): 0.0}


@pytest.mark.parametrize("layout", LAYOUTS)
def test_spmv(spark, layout):
    cells = random_cells(3, 20, 14, 50)
    m = make(spark, cells, 20, 14).compact()
    x = spark.createDataFrame([(j, float(j % 5 + 1)) for j in range(14)], "idx long, val double")
    y = spark.createDataFrame([(i, float(i)) for i in range(20)], "idx long, val double")
    want = [0.5 * sum(v * (j % 5 + 1) for (r, j), v in dense(cells).items() if r == i) + 2 * i for i in range(20)]
    rows = spmv(m, x, y, 0.5, 2.0, layout, chunk=4, sigma=8, align=2).orderBy("i").collect()
    assert [r.y for r in rows] == pytest.approx(want)
    assert [r.y for r in spmv(m, x, y, 1.0, 0.0, layout, chunk=4, sigma=8, align=2).orderBy("i").collect()][0] == pytest.approx(2 * (want[0]))


def test_transpose_reorder_and_scan(spark):
    m = make(spark, random_cells(4, 9, 7, 30), 9, 7).compact()
    assert got(m.transpose().transpose().entries) == got(m.entries)
    perm = spark.createDataFrame([(n, n * 4 % 9) for n in range(9)], "new_row long, old_row long")
    assert got(m.reorder(perm).reorder(invert(perm)).entries) == got(m.entries)
    df = spark.range(200_000).select("id", (F.col("id") % 3).alias("v"))
    assert prefix_sum(df, "id", "v").filter("id = 150000").first().before == sum(k % 3 for k in range(150_000))


def test_hash_arithmetic(spark):
    r = random.Random(6)
    for _ in range(5):
        a, b = r.getrandbits(64), r.getrandbits(64)
        xs = [0, 1, (1 << 31) - 1] + [r.randrange(1 << 31) for _ in range(20)]
        rows = spark.createDataFrame([(x,) for x in xs], "x long").select("x", affine(a, b, F.col("x")).alias("h")).collect()
        assert all(row.h == signed(a * row.x + b) for row in rows)
        xs += [1 << 31, 1 << 62, (1 << 63) - 1] + [r.randrange(1 << 63) for _ in range(20)]
        rows = spark.createDataFrame([(x,) for x in xs], "x long").select("x", affine(a, b, F.col("x"), wide=True).alias("h")).collect()
        assert all(row.h == signed(a * row.x + b) for row in rows)


def test_buckets_of_any_size(spark, monkeypatch):
    """Pairs of small and large buckets, whatever the runs that large ones are cut into."""
    r = random.Random(14)
    rows = [(i, b, [r.choice([1, 1, 1, 2, 3, 4])]) for i in r.sample(range(500), 120) for b in range(2)]
    df = spark.createDataFrame(rows, "i long, band int, part array<long>")
    for limit, window, run in ((5, 3, 4), (30, 7, 8), (200, 2, 4), (1, 1, 1)):
        monkeypatch.setattr(lsh, "RUN_ROWS", max(run, window))
        monkeypatch.setattr(lsh, "SCAN_BUCKET", 64)
        want = set()
        for key in {(b, p[0]) for _, b, p in rows}:
            ids = sorted(i for i, b, p in rows if (b, p[0]) == key)
            for k, i in enumerate(ids):
                want |= {(i, j) for j in (ids[k + 1 :] if len(ids) <= limit else ids[k + 1 : k + 1 + window])}
        assert {tuple(x) for x in lsh.bucket_pairs(df, limit, window).collect()} == want
    every = {(a, b) for a, n, p in rows for b, m, q in rows if a < b and (n, p) == (m, q)}
    monkeypatch.setattr("gridwell.operators.joins.HEAVY_ROWS", 50)
    assert {tuple(x) for x in lsh.bucket_pairs(df, None).collect()} == every


def test_heavy_joins_and_dense_blocks(spark, monkeypatch):
    """Salted keys, many flushes, cut rows of B and repeated cells leave every strategy's result as it is."""
    a, b = random_cells(21, 40, 25, 300), random_cells(22, 25, 60, 300)
    ma, mb = make(spark, a, 40, 25), make(spark, b, 25, 60)
    want = got(spgemm.spgemm(ma, mb).entries)
    monkeypatch.setattr("gridwell.operators.joins.HEAVY_ROWS", 20)
    monkeypatch.setattr(spgemm, "HEAVY_ROWS", 100)
    monkeypatch.setattr(spgemm, "FLUSH_PRODUCTS", 16)
    monkeypatch.setattr(spgemm, "PIECE_COLUMNS", 8)
    monkeypatch.setattr(spgemm, "SPA_CELLS", 60 * 6)
    for strategy in ("hash", "spa"):
        assert got(spgemm.spgemm(ma, mb, strategy).entries) == want
    members = layouts.fixed_clusters(ma, 8)
    for strategy in ("cluster", "mixed"):
        assert got(spgemm.spgemm(ma, mb, strategy, members=members).entries) == {c: v for c, v in want.items() if v}
    assert work.classify(ma, mb, members).agg(F.sum("dense")).first()[0] > 0
    assert got(spgemm.spgemm(make(spark, [], 40, 25), mb, "spa").entries) == {}


def test_empty_rows_collide(spark):
    m = make(spark, [(0, 1, 1), (2, 1, 1)], 5, 3)
    pairs = {(r.i, r.j): r.score for r in lsh.candidates(m, 16, 4, 7).collect()}
    assert pairs == {(0, 2): 1.0, (1, 3): 1.0, (1, 4): 1.0, (3, 4): 1.0}
    capped = lsh.bucket_pairs(lsh.bands(lsh.signatures(m, 16), 16, 4), 2, 1)
    assert {tuple(r) for r in capped.collect()} == {(0, 2), (1, 3), (3, 4)}


def test_clusters_partition_rows(spark):
    r = random.Random(8)
    rows = {i: {r.randrange(12) for _ in range(r.randrange(6))} for i in range(60)}
    m = make(spark, [(i, j, 1) for i, c in rows.items() for j in c], 60, 12)
    pairs = sorted({(min(a, b), max(a, b)) for a, b in ((r.randrange(60), r.randrange(60)) for _ in range(90)) if a != b})
    scored = [(a, b, len(rows[a] & rows[b]) / max(1, len(rows[a] | rows[b]))) for a, b in pairs]
    found = {x.i: x.root for x in cluster.hierarchical(m, spark.createDataFrame(scored, "i long, j long, score double"), 4).collect()}
    whole = cluster.agglomerate(scored, rows, 4)
    assert found == {i: whole.get(i, i) for i in range(60)}
    perm, offsets = cluster.permutation(spark.createDataFrame(list(found.items()), "i long, root long"), 60)
    assert sorted(p.old_row for p in perm.collect()) == list(range(60))
    spans = sorted((o.cluster, o.start, o.stop) for o in offsets.collect())
    assert spans[0][1] == 0 and spans[-1][2] == 60 and all(a[2] == b[1] for a, b in zip(spans, spans[1:]))
    assert max(s[2] - s[1] for s in spans) <= 2 * 4 - 2


def greedy_model(pairs, rows, cap):
    """The greedy rule on plain lists: look at all waiting pairs, take the best, tell every member."""
    root = {x: x for i, j, _ in pairs for x in (i, j)}
    waiting, seen, closed = [(s, i, j) for i, j, s in pairs], {(i, j) for i, j, _ in pairs}, set()
    size = lambda r: sum(x == r for x in root.values())
    while waiting:
        best = max(waiting)
        waiting.remove(best)
        _, i, j = best
        a, b = root[i], root[j]
        if a == b or a in closed or b in closed:
            continue
        if (a, b) == (i, j):
            into, gone = (b, a) if size(b) > size(a) else (a, b)
            root = {x: into if r == gone else r for x, r in root.items()}
            if size(into) >= cap:
                closed.add(into)
        elif (min(a, b), max(a, b)) not in seen:
            a, b = min(a, b), max(a, b)
            seen.add((a, b))
            union = rows.get(a, set()) | rows.get(b, set())
            waiting.append((len(rows.get(a, set()) & rows.get(b, set())) / len(union) if union else 0.0, a, b))
    return root


@pytest.mark.parametrize("strategy", cluster.STRATEGIES)
def test_greedy_strategies_match_the_model(strategy):
    for seed in range(60):
        r = random.Random(seed)
        n = r.randint(2, 40)
        rows = {i: {r.randrange(8) for _ in range(r.randrange(6))} for i in range(n)}
        pairs = sorted({(min(a, b), max(a, b)) for a, b in ((r.randrange(n), r.randrange(n)) for _ in range(r.randint(1, 80))) if a != b})
        scored = [(a, b, r.choice([0.0, 0.25, 0.5, 0.75, 1.0])) for a, b in pairs]
        cap = r.choice([2, 3, 4, 8])
        assert cluster.STRATEGIES[strategy](scored, rows, cap) == greedy_model(scored, rows, cap)


def test_logs(spark, tmp_path):
    (tmp_path / "run.out").write_text("start\n===== Dataset: cant =====\nFLOPs: 12\nKernel: 1\n[mixed_acc] hash 3 dense 4\nAverage time: 2.5 ms\nAverage GFLOPS: 0.5\nAverage time: 9 ms\n===== Dataset: hood =====\nKernel: 2\n===== Dataset: cant =====\nAverage time: 1.5 ms\n")
    rows = logs.read_logs(spark, str(tmp_path / "run.out")).orderBy("at").collect()
    assert [tuple(x)[2:] for x in rows] == [("cant", 12, 1, "hash 3 dense 4", 2.5, 0.5), ("hood", None, 2, None, None, None), ("cant", None, None, None, 1.5, None)]
    best = logs.best_rows(logs.read_logs(spark, str(tmp_path / "run.out")), "dataset", "average_ms", "at")
    assert [(x.dataset, x.average_ms) for x in best.collect()] == [("cant", 1.5)]
    logs.write_csv(best, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).first().dataset == "cant"
    assert {x.faster for x in accumulators(spark, 64, 4, (0.1,), 1).collect()} <= {"hash", "dense"}


@pytest.mark.parametrize("hub", [3, 1_000_000])
def test_components(spark, monkeypatch, hub):
    monkeypatch.setattr(components, "HUB_ROWS", hub)
    r = random.Random(10)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(300)] + [(k, k + 1) for k in range(1000, 1200)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    have = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert have == {x: find(x) for x in list(root)}


def test_p_ratio_and_gini_model(spark):
    for counts in ([5, 0, 3, 3, 9, 1], [0, 0, 4], [2, 2, 2]):
        df = spark.createDataFrame([(k, c) for k, c in enumerate(counts)], "i long, n long")
        n, nnz, run = len(counts), sum(counts), 0
        want = None
        for c, v in enumerate(sorted(counts, reverse=True), 1):
            run += v
            if want is None and c * nnz + run * n >= n * nnz:
                want = c / n
        assert features.p_ratio(df).first().p == pytest.approx(want)
        cum, sums = 0, []
        for v in sorted(counts):
            cum += v
            sums.append(cum)
        area = sums[0] / 2 + sum((a + b) / 2 for a, b in zip(sums, sums[1:]))
        assert features.gini(df).first().gini == pytest.approx((nnz * n / 2 - area) / (nnz * n / 2))


def test_matrix_market(spark, tmp_path):
    sym = tmp_path / "s.mtx"
    sym.write_text("%%MatrixMarket MATRIX Coordinate Real Symmetric\n% note\n3 3 3\n1 1 2.5\n2 1 -1\n3 2 4\n")
    m = mtx.read_mtx(spark, str(sym))
    assert got(m.entries) == {(0, 0): 2.5, (1, 0): -1.0, (0, 1): -1.0, (2, 1): 4.0, (1, 2): 4.0} and (m.nrows, m.ncols) == (3, 3)
    pat = tmp_path / "p.mtx"
    pat.write_text("%%MatrixMarket matrix coordinate pattern general\n2 3 2\n1 3\n2 1\n")
    assert got(mtx.read_mtx(spark, str(pat)).entries) == {(0, 2): 1.0, (1, 0): 1.0}
    for bad in ("%%MatrixMarket matrix array pattern general", "%%MatrixMarket matrix coordinate complex general", "%%MatrixMarket matrix coordinate real hermitian", "no banner"):
        with pytest.raises(mtx.BadHeader):
            mtx.parse_banner(bad)
    mtx.write_mtx(m, str(tmp_path / "out"))
    assert got(mtx.read_mtx(spark, str(tmp_path / "out")).entries) == got(m.entries)
    perm = tmp_path / "x.perm"
    perm.write_text("2\n0\n1\n")
    assert [r.old_row for r in mtx.read_permutation(spark, str(perm), 5).orderBy("new_row").collect()] == [2, 0, 1, 3, 4]
    pairs = tmp_path / "pairs.txt"
    pairs.write_text("0 1\n2 3 0.5\n0 1 0.25\n-1 4 1\n")
    assert {(r.i, r.j, r.score) for r in mtx.read_pairs(spark, str(pairs)).collect()} == {(0, 1, 0.25), (2, 3, 0.5)}


def test_part_files_are_read_in_order(spark, tmp_path):
    """Four parts of growing size: Spark reads the last one first."""
    r = random.Random(15)
    cells = {(min(999, int(1000 * (1 - r.random() ** 3))), r.randrange(50)): float(r.randrange(1, 900)) for _ in range(4000)}
    m = make(spark, [(i, j, v) for (i, j), v in cells.items()], 1000, 50)
    mtx.write_mtx(m, str(tmp_path / "m"), parts=4)
    sizes = [os.path.getsize(tmp_path / "m" / f) for f in sorted(os.listdir(tmp_path / "m")) if f.startswith("part")]
    assert len(sizes) == 4
    back = mtx.read_mtx(spark, str(tmp_path / "m"))
    assert got(back.entries) == cells and (back.nrows, back.ncols) == (1000, 50) and back.entries.count() == len(cells)
    numbers = r.sample(range(10**6), 4000)
    for k, (lo, hi) in enumerate(((0, 40), (40, 300), (300, 1200), (1200, 4000))):
        for name, lines in (("p", numbers[lo:hi]), ("q", [f"{x % 40} {x % 7} {x}" for x in numbers[lo:hi]])):
            (tmp_path / name).mkdir(exist_ok=True)
            head = ["%%MatrixMarket matrix coordinate real general", "% note", "9 9 4000"] if k == 0 and name == "q" else []
            (tmp_path / name / f"part-{k:05d}.txt").write_text("\n".join(map(str, [*head, *lines])) + "\n")
    perm = mtx.read_permutation(spark, str(tmp_path / "p")).orderBy("new_row").collect()
    assert [x.old_row for x in perm] == numbers and [x.new_row for x in perm] == list(range(4000))
    spans = mtx.read_offsets(spark, str(tmp_path / "p")).orderBy("cluster").collect()
    assert [(x.start, x.stop) for x in spans] == list(zip(numbers, numbers[1:]))
    shift = 0 if 0 in (numbers[0] % 40, numbers[0] % 7) else 1
    want = {(x % 40 - shift, x % 7 - shift): float(x) for x in numbers if min(x % 40, x % 7) >= shift}
    assert {(x.i, x.j): x.score for x in mtx.read_pairs(spark, str(tmp_path / "q")).collect()} == want
    # splits of one file, and entries that look like the size line
    big = tmp_path / "big.mtx"
    big.write_text("%%MatrixMarket matrix coordinate pattern general\n%\n\n2 2 3\n" + "2 2 3\n" * 3 + "1 2\n" * 4000)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        again = mtx.read_mtx(spark, str(big))
        assert {(x.i, x.j): x["count"] for x in again.entries.groupBy("i", "j").count().collect()} == {(1, 1): 3, (0, 1): 4000}
        one = tmp_path / "one.perm"
        one.write_text("\n".join(map(str, numbers)))
        assert [x.old_row for x in mtx.read_permutation(spark, str(one)).orderBy("new_row").collect()] == numbers
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for text in ("1 1 1\n", "%%MatrixMarket matrix coordinate real general\n", "%%MatrixMarket matrix coordinate real general\n1 x 2\n"):
        (tmp_path / "bad.mtx").write_text(text)
        with pytest.raises(mtx.BadHeader):
            mtx.read_mtx(spark, str(tmp_path / "bad.mtx"))


def test_written_numbers_and_layout_readers(spark, tmp_path):
    values = [425.0, 0.1, 1 / 3, 1e-5, 1.5e300, 12345678901234567.0, 0.0, -2.5e-10, 1234567890123456.7, 100000.0]
    m = make(spark, [(k, k, v) for k, v in enumerate(values)], 10, 10)
    mtx.write_mtx(m, str(tmp_path / "n"), parts=1)
    lines = [x for x in (tmp_path / "n").glob("part*")][0].read_text().splitlines()[2:]
    assert lines == [f"{k + 1} {k + 1} %20.16g" % v for k, v in enumerate(values)]
    cells = random_cells(16, 12, 9, 40)
    m = make(spark, cells, 12, 9)
    path = str(tmp_path / "l")
    mtx.write_mtx(m, path, parts=3)
    own = m.compact()
    order = lambda df: sorted(map(repr, df.collect()))
    assert got(layouts.csr_to_entries(mtx.read_layout(spark, path, "csr"))) == got(own.entries)
    for name, options, want in (("bsr", {"br": 2, "bc": 3}, layouts.bsr(own, 2, 3)), ("csr5", {"omega": 2, "sigma": 4}, layouts.csr5(own, 2, 4)), ("ell", {}, layouts.ell(own)), ("dia", {}, layouts.dia(own)), ("sell", {"chunk": 4}, layouts.sell(own, 0, 4, 4)), ("sell_c_sigma", {"chunk": 4, "sigma": 8}, layouts.sell(own, 8, 4, 4)), ("sell_c_r", {"chunk": 4}, layouts.sell(own, None, 4, 4))):
        assert order(mtx.read_layout(spark, path, name, **options)) == order(want), name
    with pytest.raises(ValueError):
        mtx.read_layout(spark, path, "coo5")


def test_feature_files(spark, tmp_path):
    cells = random_cells(18, 300, 280, 900)
    m = make(spark, cells, 300, 280).compact()
    mtx.write_features({"basic": features.basic(m), "rows": features.spread(m.row_counts())}, str(tmp_path / "f"))
    rows = {(x.feature, x.name): x.value for x in spark.read.parquet(str(tmp_path / "f")).collect()}
    n = sum(1 for v in dense(cells).values() if v)
    assert rows["basic", "nnz"] == n and rows["rows", "most"] >= 1
    mtx.write_feature_images(m, str(tmp_path / "i"))
    sums = {x.image: x.n for x in spark.read.parquet(str(tmp_path / "i")).groupBy("image").agg(F.sum("n").alias("n")).collect()}
    assert sums == {"tile": n, "rb": n, "cb": n}


def test_consecutive_clusters(spark):
    rows = [{1, 2}, {1, 2}, {2, 3}, {9}, set(), set(), {4}, {4}]
    m = make(spark, [(i, j, 1) for i, c in enumerate(rows) for j in c], 8, 10)
    have = sorted((r.cluster, r.start, r.stop) for r in similarity.consecutive_clusters(m, 0.3, 8).collect())
    assert have == [(0, 0, 3), (1, 3, 4), (2, 4, 5), (3, 5, 6), (4, 6, 8)]


def test_work_ranges_cover_all(spark):
    df = spark.createDataFrame([(k, k % 7) for k in range(100)], "i long, work long")
    starts = [r.start for r in work.ranges(df, "i", 6).orderBy("part").collect()]
    assert starts[0] == 0 and starts == sorted(starts) and len(starts) == 6


def test_streaming_signatures(spark, tmp_path):
    m = make(spark, random_cells(12, 8, 30, 60), 8, 30)
    m.entries.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(m.entries.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streaming_signatures(stream, 8, 7).writeStream.outputMode("complete").format("memory").queryName("sigs").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    want = {r.i: r.sig for r in lsh.signatures(m, 8, 7).collect() if r.sig[0] != -1 or r.sig[1] != -1}
    assert {r.i: r.sig for r in spark.table("sigs").collect()} == want


def greedy_model(loads, parts):
    share, now, starts = max(sum(loads) // parts, 1), 0, [0]
    for i, n in enumerate(loads):
        now += n
        if now >= share and len(starts) < parts:
            starts.append(i + 1)
            now = 0
    return starts + [len(loads)] * (parts - len(starts))


@pytest.mark.parametrize("loads,parts", [([], 3), ([0, 0], 2), ([1, 0, 0, 9, 1, 1, 2], 3), ([1, 1], 5), ([3, 1, 4, 1, 5, 9, 2, 6], 4)])
def test_greedy_ranges(spark, loads, parts):
    df = spark.createDataFrame(list(enumerate(loads)), "i long, work long")
    assert sorted(map(tuple, work.greedy_ranges(df, "i", parts).collect())) == list(enumerate(greedy_model(loads, parts)))


def test_marked_tiles(spark):
    """Rows 0 and 4 fill a tile of two entries each; the gap between them makes the first dirty, not the last."""
    m = make(spark, [(0, 0, 1), (0, 1, 1), (4, 0, 1), (4, 2, 1)], 6, 3)
    got = {r.tile: (r.has_empty, r.dirty) for r in layouts.csr5_marked(layouts.csr5_tiles(m, 2, 1)).collect()}
    assert got == {0: (False, True), 1: (False, False)}
