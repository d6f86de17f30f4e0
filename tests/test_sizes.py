"""What plans do with tables whose size their estimates do not show."""

import contextlib
import io

from gridwell.operators import layouts
from gridwell.operators.matrix import Matrix
from gridwell.operators.spmv import spmv


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_ell_broadcasts_no_padded_rows(spark):
    """The padded slots of 2000 rows, which look as small as the rows, must not be what a join hands to all tasks."""
    n = 2000
    m = Matrix(spark.range(300).selectExpr("5L i", "id j", "1.0D v"), n, n)
    x = spark.range(n).selectExpr("id idx", "2.0D val")
    frame = plan(layouts.ell(m).filter("j >= 0"))
    assert "BuildLeft" not in frame and "Inner" not in frame
    assert {r.i: r.y for r in spmv(m, x, x, layout="ell").filter("y <> 0").collect()} == {5: 600.0}


def test_ell_rows(spark):
    m = Matrix(spark.createDataFrame([(0, 3, 1.0), (0, 1, 2.0), (2, 0, 4.0), (3, 1, 1.0), (3, 1, -1.0)], "i long, j long, v double"), 4, 4)
    assert sorted(map(tuple, layouts.ell(m).collect())) == [(0, 0, 1, 2.0), (0, 1, 3, 1.0), (1, 0, -1, 0.0), (1, 1, -1, 0.0), (2, 0, 0, 4.0), (2, 1, -1, 0.0), (3, 0, -1, 0.0), (3, 1, -1, 0.0)]
    assert layouts.ell(Matrix(m.entries.limit(0), 4, 4)).count() == 0
