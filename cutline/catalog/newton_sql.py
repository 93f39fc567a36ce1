"""SQL of a penalised logistic fit by Newton steps, for the twins of queries that refit models."""

from __future__ import annotations

STEPS = 14


def newton_sql(inputs: str, width: int) -> str:
    """CTEs from ``inputs`` (model, label, trained, x1 ... x<width>) to ``auc_of`` (model, auc, positives, negatives).

    The statement they stand in must begin WITH RECURSIVE. Each step sums gradient and Hessian of every model
    and eliminates row by row; the intercept x0 = 1 is not penalised.
    """
    n = range(width + 1)
    margin = " + ".join(["w0"] + [f"w{i} * x{i}" for i in n[1:]])
    solved = "SELECT it, model, {w}, {g}, {h} FROM summed".format(
        w=", ".join(f"w{i}" for i in n),
        g=", ".join(f"g{i}{f' + w{i}' if i else ''} AS r{i}" for i in n),
        h=", ".join(f"h{i}{j}{' + 1' if i == j and i else ''} AS h{i}{j}" for i in n for j in n[i:]),
    )
    for k in n[:-1]:
        kept = [f"h{i}{j}" for i in n[: k + 1] for j in n[i:]] + [f"r{i}" for i in n[: k + 1]]
        left = [f"h{i}{j} - h{k}{i} * h{k}{j} / h{k}{k} AS h{i}{j}" for i in n[k + 1 :] for j in n[i:]]
        left += [f"r{i} - h{k}{i} * r{k} / h{k}{k} AS r{i}" for i in n[k + 1 :]]
        solved = f"SELECT it, model, {', '.join(f'w{i}' for i in n)}, {', '.join(kept + left)} FROM ({solved})"
    for k in reversed(n):
        rest = "".join(f" - h{k}{j} * s{j}" for j in n[k + 1 :])
        solved = f"SELECT *, (r{k}{rest}) / h{k}{k} AS s{k} FROM ({solved})"
    return f"""
inputs AS ({inputs}),
moments AS (
  SELECT model, {', '.join(f'avg(x{i}) AS m{i}, CASE WHEN stddev_pop(x{i}) = 0 THEN 1 ELSE stddev_pop(x{i}) END AS d{i}' for i in n[1:])}
  FROM inputs WHERE trained GROUP BY model),
design AS (
  SELECT model, label, trained, {', '.join(f'(x{i} - m{i}) / d{i} AS x{i}' for i in n[1:])} FROM inputs JOIN moments USING (model)),
newton AS (
  SELECT 0 AS it, model, {', '.join(f'0.0::DOUBLE AS w{i}' for i in n)} FROM moments
  UNION ALL
  SELECT it + 1, model, {', '.join(f'w{i} - s{i}' for i in n)} FROM (
    WITH at_point AS (
      SELECT d.*, w.* EXCLUDE (model), 1 / (1 + exp(-({margin}))) AS p, 1.0::DOUBLE AS x0
      FROM design AS d JOIN newton AS w USING (model) WHERE trained AND it < {STEPS}),
    summed AS (
      SELECT it, model, {', '.join(f'any_value(w{i}) AS w{i}' for i in n)}, {', '.join(f'sum((p - label) * x{i}) AS g{i}' for i in n)},
        {', '.join(f'sum(p * (1 - p) * x{i} * x{j}) AS h{i}{j}' for i in n for j in n[i:])}
      FROM at_point GROUP BY it, model)
    {solved})),
fit_scores AS (
  SELECT model, label, 1 / (1 + exp(-({margin}))) AS score FROM design JOIN newton USING (model) WHERE NOT trained AND it = {STEPS}),
fit_tally AS (
  SELECT model, score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg FROM fit_scores GROUP BY ALL),
fit_below AS (
  SELECT *, sum(neg) OVER (PARTITION BY model ORDER BY score) - neg AS lower FROM fit_tally),
auc_of AS (
  SELECT model, round(sum(pos * (lower + neg / 2.0))::DOUBLE / (sum(pos) * sum(neg))::DOUBLE, 6) AS auc,
    sum(pos)::BIGINT AS positives, sum(neg)::BIGINT AS negatives FROM fit_below GROUP BY model)
"""
