"""MatrixMarket files and the plain text files that go with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from gridwell.operators import features, layouts
from gridwell.operators.matrix import Matrix
from gridwell.plans.runtime import small

_FIELDS, _FORMS = ("real", "integer", "pattern"), ("general", "symmetric", "skew-symmetric", "hermitian")


class BadHeader(ValueError):
    """A banner or size line that the format does not allow."""


def parse_banner(line: str) -> tuple[str, str, str]:
    """(layout, field, form). Tokens after the banner are read in any case."""
    parts = line.split()
    if len(parts) < 5 or parts[0] != "%%MatrixMarket" or parts[1].lower() != "matrix":
        raise BadHeader(line)
    layout, field, form = (p.lower() for p in parts[2:5])
    if layout not in ("coordinate", "array") or field not in (*_FIELDS, "complex") or form not in _FORMS:
        raise BadHeader(line)
    if layout == "array" and field == "pattern" or field == "real" and form == "hermitian" or field == "pattern" and form in ("hermitian", "skew-symmetric"):
        raise BadHeader(f"{line}: not a valid combination")
    if layout != "coordinate" or field == "complex":
        raise BadHeader(f"{line}: only real, integer and pattern coordinates are read")
    return layout, field, form


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, at, value) of the lines that are not blank. (file, block, at) is their order: part files by name,
    their splits by offset, and `at` inside of a split. Spark reads large files first, so the order of rows says nothing."""
    held = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    return held.filter(F.trim("value") != "").withColumn("at", F.monotonically_increasing_id())


def _head(lines: DataFrame) -> tuple[str | None, tuple | None]:
    """The banner, and (file, block, line) of the first line that is no comment; None without one."""
    place = ("file", "block", "at", "value")
    banner, first = lines.agg(*[F.min(F.when(c, F.struct(*place))) for c in (F.col("value").startswith("%%MatrixMarket"), ~F.col("value").startswith("%"))]).first()
    return banner and banner.value, first and (first.file, first.block, first.value)


def _without_first(data: DataFrame, first: tuple) -> DataFrame:
    """(value) of the lines, but for one that equals the first line in the first line's split; their order is lost."""
    same = (F.col("file") == first[0]) & (F.col("block") == first[1]) & (F.col("value") == first[2])
    again = data.sparkSession.range(data.filter(same).count() - 1).select(F.lit(first[2]).alias("value"))
    return data.filter(~same).select("value").unionByName(again)


def _numbered(lines: DataFrame, skip: int = 0) -> DataFrame:
    """(n, value) of the lines that are no comments, numbered in file order without the first `skip`.

    Only the sizes of splits pass one task; lines are numbered inside their split.
    """
    data = lines.filter(~F.col("value").startswith("%"))
    sizes = data.groupBy("file", "block").agg(F.count("*").alias("size"))
    base = sizes.select("file", "block", (F.sum("size").over(Window.orderBy("file", "block")) - F.col("size")).alias("base"))
    inside = F.row_number().over(Window.partitionBy("file", "block").orderBy("at"))
    placed = data.withColumn("inside", inside).join(small(base), ["file", "block"])
    return placed.select((F.col("base") + F.col("inside") - 1 - skip).cast("long").alias("n"), "value").filter("n >= 0")


def read_mtx(spark: SparkSession, path: str, compact: bool = False, mirror_skew: bool = False) -> Matrix:
    """A coordinate file, or a folder of part files in the order of their names; 1-based there, 0-based here.

    Pattern values are 1, symmetric files are mirrored. Skew-symmetric files are mirrored with their sign changed only
    if asked for. Duplicates stay unless compact. Raises BadHeader without a banner or a size line.
    """
    lines = _lines(spark, path)
    banner, first = _head(lines)
    _, field, form = parse_banner(banner or "")
    size = first[2].split() if first else []
    if len(size) != 3 or not all(x.isdigit() for x in size):
        raise BadHeader(" ".join(size))
    data = _without_first(lines.filter(~F.col("value").startswith("%")), first)
    parts = F.split(F.trim("value"), r"\s+")
    body = data.select((parts[0].cast("long") - 1).alias("i"), (parts[1].cast("long") - 1).alias("j"), (F.lit(1.0) if field == "pattern" else parts[2].cast("double")).alias("v"))
    if form == "symmetric" or form == "skew-symmetric" and mirror_skew:
        sign = -1.0 if form == "skew-symmetric" else 1.0
        body = body.unionByName(body.filter("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), (F.col("v") * sign).alias("v")))
    m = Matrix(body, int(size[0]), int(size[1]))
    return m.compact() if compact else m


def read_layout(spark: SparkSession, path: str, layout: str, **options) -> DataFrame:
    """A coordinate file straight into a layout: csr, bsr, csr5, ell, dia, sell, sell_c_sigma or sell_c_r.

    options are those of the layout's function in `layouts`. All but csr hold one value a cell, so duplicates are summed;
    csr is compact too.
    """
    m = read_mtx(spark, path, compact=True)
    chunk, align = options.get("chunk", 8), options.get("align", 4)
    if layout == "csr":
        return layouts.csr_rows(m)
    if layout in ("sell", "sell_c_sigma", "sell_c_r"):
        return layouts.sell(m, {"sell": 0, "sell_c_sigma": options.get("sigma", 64), "sell_c_r": None}[layout], chunk, align)
    if layout in ("bsr", "csr5", "ell", "dia"):
        return getattr(layouts, layout)(m, **options)
    raise ValueError(layout)


def _g16(v: Column) -> Column:
    """A double as C prints it by %20.16g: 16 digits without closing zeros, at least 20 wide."""
    raw = F.format_string("%.16g", v)
    bare = F.when(raw.contains("."), F.regexp_replace(F.regexp_replace(raw, r"(\.\d*?)0+(e|$)", "$1$2"), r"\.(e|$)", "$1")).otherwise(raw)
    return F.when(F.length(bare) < 20, F.lpad(bare, 20, " ")).otherwise(bare)


def write_mtx(m: Matrix, path: str, base: int = 1, parts: int | None = None) -> None:
    """A real general coordinate file as part files of text, which in the order of their names are one file.

    Rows ascend, then columns; the first part begins with banner and size line. parts: how many ranges at most.
    """
    spark, n = m.entries.sparkSession, m.entries.count()
    head = spark.createDataFrame([(-2, -2, "%%MatrixMarket matrix coordinate real general"), (-1, -1, f"{m.nrows} {m.ncols} {n}")], "i long, j long, value string")
    body = m.entries.select("i", "j", F.concat_ws(" ", F.col("i") + base, F.col("j") + base, _g16(F.col("v"))).alias("value"))
    whole = head.unionByName(body)
    (whole.repartitionByRange(parts, "i", "j") if parts else whole.repartitionByRange("i", "j")).sortWithinPartitions("i", "j").select("value").write.text(path)


def read_permutation(spark: SparkSession, path: str, nrows: int = 0) -> DataFrame:
    """(new_row, old_row) of a file with one 0-based row a line, plain or with a MatrixMarket head.

    With nrows the list is cut there, or goes on with the rows themselves. Part files are read in the order of their names.
    """
    lines = _lines(spark, path)
    banner, _ = _head(lines)
    out = _numbered(lines, 1 if banner else 0).select(F.col("n").alias("new_row"), F.split(F.trim("value"), r"\s+")[0].cast("long").alias("old_row"))
    if nrows:
        have = out.count()
        out = out.filter(F.col("new_row") < nrows).unionByName(spark.range(have, max(nrows, have)).select(F.col("id").alias("new_row"), F.col("id").alias("old_row")))
    return out


def read_offsets(spark: SparkSession, path: str) -> DataFrame:
    """(cluster, start, stop) of a file with one row number a line."""
    marks = read_permutation(spark, path).select(F.col("new_row").alias("cluster"), F.col("old_row").alias("start"))
    after = marks.select((F.col("cluster") - 1).alias("cluster"), F.col("start").alias("stop"))
    return marks.join(after, "cluster")


def read_pairs(spark: SparkSession, path: str, base: str = "auto") -> DataFrame:
    """(i, j, score) of a file of `u v [score]` lines, plain or MatrixMarket. A missing score is 1, negative ids go, and
    the last of duplicates wins. base auto: plain files are 0-based, MatrixMarket files 0-based if the first pair has a 0."""
    lines = _lines(spark, path)
    banner, _ = _head(lines)
    parts = F.split(F.trim("value"), r"\s+")
    rows = _numbered(lines, 1 if banner else 0).select("n", parts[0].cast("long").alias("i"), parts[1].cast("long").alias("j"), F.coalesce(F.get(parts, F.lit(2)).cast("double"), F.lit(1.0)).alias("score"))
    first = rows.filter("n = 0").first() if banner and base == "auto" else None
    shift = 1 if base == "1" or first is not None and first.i != 0 and first.j != 0 else 0
    rows = rows.select("n", (F.col("i") - shift).alias("i"), (F.col("j") - shift).alias("j"), "score").filter("i >= 0 and j >= 0")
    return rows.groupBy("i", "j").agg(F.max_by("score", "n").alias("score"))


def write_rows(df: DataFrame, column: str, order: str, path: str, parts: int | None = None) -> None:
    """One number a line, in order over the part files by name: permutation and offset files."""
    dealt = df.repartitionByRange(parts, order) if parts else df.repartitionByRange(order)
    dealt.sortWithinPartitions(order).select(F.col(column).cast("string").alias("value")).write.text(path)


def write_triples(df: DataFrame, path: str) -> None:
    """`i j value` lines, 0-based: coordinate dumps and candidate pairs."""
    a, b, c = df.columns[:3]
    df.select(F.concat_ws(" ", a, b, c).alias("value")).write.text(path)


def write_features(tables: dict[str, DataFrame], path: str) -> None:
    """All one-row feature tables as (feature, name, value) in Parquet."""
    out = None
    for feature, df in tables.items():
        row = df.select(F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in df.columns]), F.array(*[F.col(c).cast("double") for c in df.columns]))).alias("name", "value")).select(F.lit(feature).alias("feature"), "name", "value")
        out = row if out is None else out.unionByName(row)
    out.write.parquet(path)


def write_feature_images(m: Matrix, path: str) -> None:
    """The pictures of a matrix by tiles, row blocks and column blocks, as Parquet with image in ("tile", "rb", "cb").

    Columns: image, id, lines (rows or columns with entries), n (entries), most, mean and deviation of entries a line.
    """
    out = None
    for image in ("tile", "rb", "cb"):
        own = features.inner_counts(m, image).join(features.block_counts(m, image).select("id", "n"), "id").select(F.lit(image).alias("image"), "id", "lines", "n", "most", "mean", "deviation")
        out = own if out is None else out.unionByName(own)
    out.write.parquet(path)
