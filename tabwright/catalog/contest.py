"""Queries of the training contest: every contestant on the same held-out rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import models
from ..operators.crossfit import Blend, Search, Subspace
from ..operators.folds import fold_by_key
from ..operators.models import REGRESSION, Learner
from ..operators.stacking import StackLearner, linear_meta
from ..plans.contest import run_contest
from .base import query, read, rounded

_ALPHAS = (1.0, 1000.0, 1000000.0)


def contest_parts(spark, sf_dir):
    """Parts with the mean price of their order lines, in thousands, and the fold of their key."""
    lines = read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey"))
    target = lines.agg((F.avg("l_extendedprice") / 1000).alias("price"))
    parts = read(spark, sf_dir, "part").join(target, "p_partkey")
    table = models.feature_table(parts, "p_partkey", ["p_size", "p_retailprice"], "price")
    return fold_by_key(table, "key", 5)


def contestants():
    size, price = Subspace(Learner("ridge"), (0,)), Subspace(Learner("ridge"), (1,))
    members = {"by_size": size, "by_price": price}
    return {
        **members,
        "vote": Blend(members, "vote"),
        "blend": Blend(members, "score"),
        "tuned": Search("ridge", tuple({"alpha": a} for a in _ALPHAS)),
        "stack": StackLearner(members, {"linear": linear_meta(REGRESSION)}),
    }


KINDS = {"by_size": "single", "by_price": "single", "vote": "blend", "blend": "blend", "tuned": "tuned", "stack": "stack"}


def _tuned(i: int, alpha: float) -> str:
    det = f"((v11 + {alpha}) * (v22 + {alpha}) - v12 * v12)"
    return (
        f"my + ((v22 + {alpha}) * c1 - v12 * c2) / {det} * (x1 - m1) + ((v11 + {alpha}) * c2 - v12 * c1) / {det} * (x2 - m2) AS t{i}"
    )


# Held-out folds are sets of one or two; ``o`` is the outer one of a row's two.
HELD_SQL = f"""t AS (
    SELECT p_partkey AS key, p_partkey % 5 AS f, p_size::DOUBLE AS x1, p_retailprice::DOUBLE AS x2, y
    FROM part JOIN (SELECT l_partkey, AVG(l_extendedprice) / 1000 AS y FROM lineitem GROUP BY 1) ON l_partkey = p_partkey),
  folds AS (SELECT unnest(range(5)) AS k),
  held AS (SELECT a.k AS i, b.k AS j FROM folds a JOIN folds b ON a.k <= b.k),
  fits AS (
    SELECT i, j, AVG(x1) AS m1, AVG(x2) AS m2, AVG(y) AS my, VAR_POP(x1) * COUNT(*) AS v11, VAR_POP(x2) * COUNT(*) AS v22,
      COVAR_POP(x1, x2) * COUNT(*) AS v12, COVAR_POP(x1, y) * COUNT(*) AS c1, COVAR_POP(x2, y) * COUNT(*) AS c2
    FROM held JOIN t ON f <> i AND f <> j GROUP BY i, j),
  made AS (
    SELECT key, f, CASE WHEN f = i THEN j ELSE i END AS o, y, my + c1 / (v11 + 1) * (x1 - m1) AS a, my + c2 / (v22 + 1) * (x2 - m2) AS b,
      {", ".join(_tuned(i, a) for i, a in enumerate(_ALPHAS))}
    FROM fits JOIN t ON f = i OR f = j),
  errors AS (
    SELECT o, f, AVG((y - a) ** 2) AS a, AVG((y - b) ** 2) AS b, AVG((y - t0) ** 2) AS t0, AVG((y - t1) ** 2) AS t1, AVG((y - t2) ** 2) AS t2
    FROM made WHERE f <> o GROUP BY o, f),
  judged AS (SELECT o, AVG(a) AS a, AVG(b) AS b, AVG(t0) AS t0, AVG(t1) AS t1, AVG(t2) AS t2 FROM errors GROUP BY o),
  meta AS (
    SELECT o, AVG(a) AS ma, AVG(b) AS mb, AVG(y) AS my, VAR_POP(a) * COUNT(*) + 1 AS va, VAR_POP(b) * COUNT(*) + 1 AS vb,
      COVAR_POP(a, b) * COUNT(*) AS ab, COVAR_POP(a, y) * COUNT(*) AS ca, COVAR_POP(b, y) * COUNT(*) AS cb
    FROM made WHERE f <> o GROUP BY o),
  values_of AS (
    SELECT key, f, m.y, m.a AS by_size, m.b AS by_price, (m.a + m.b) / 2 AS vote,
      (m.a / j.a + m.b / j.b) / (1 / j.a + 1 / j.b) AS blend,
      CASE WHEN j.t0 <= j.t1 AND j.t0 <= j.t2 THEN m.t0 WHEN j.t1 <= j.t2 THEN m.t1 ELSE m.t2 END AS tuned,
      s.my + (vb * ca - ab * cb) / (va * vb - ab * ab) * (m.a - ma) + (va * cb - ab * ca) / (va * vb - ab * ab) * (m.b - mb) AS stack
    FROM made m JOIN judged j ON j.o = f JOIN meta s ON s.o = f WHERE m.o = f)"""
CONTEST_SQL = f"""WITH {HELD_SQL},
  long AS (
    {" UNION ALL ".join(f"SELECT '{c}' AS contestant, '{k}' AS kind, f, -AVG((y - {c}) ** 2) AS score FROM values_of GROUP BY f" for c, k in KINDS.items())}),
  board AS (
    SELECT contestant, kind, AVG(score) AS mean_score, STDDEV_POP(score) AS std_score, COUNT(*) AS folds FROM long GROUP BY 1, 2)
  SELECT contestant, kind, ROUND(mean_score, 4) AS mean_score, ROUND(std_score, 4) AS std_score, folds,
    ROW_NUMBER() OVER (ORDER BY mean_score DESC, contestant) = 1 AS promoted FROM board"""


@query("flow_contest", CONTEST_SQL)
def flow_contest(spark, sf_dir):
    """One row per contestant, and which one is promoted."""
    return rounded(run_contest(contest_parts(spark, sf_dir), REGRESSION, contestants(), KINDS).table, 4)


PREDICTIONS_SQL = f"""WITH {HELD_SQL}
  SELECT key, f AS fold, {", ".join(f"ROUND({c}, 4) AS {c}" for c in KINDS)} FROM values_of"""


@query("flow_contest_predictions", PREDICTIONS_SQL)
def flow_contest_predictions(spark, sf_dir):
    """Every contestant's prediction of every part, the part's fold held out."""
    contest = run_contest(contest_parts(spark, sf_dir), REGRESSION, contestants(), KINDS)
    return rounded(contest.fit.inputs(contest.contestants, contest.fit.folds, ()).drop("y"), 4)
