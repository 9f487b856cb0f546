"""Train/test splits."""

from __future__ import annotations

from ..operators import folds, splits
from .base import HOUR, PATCHY, READINGS, READINGS_WIDE, floor_sql, num, patchy, readings, readings_wide, registry, text

CHECKS, check = registry()


def quota_split_sql(table: str, source: str, group: str, strata: str, key: str = "event_id", more: str = "") -> str:
    """Seeded split with largest-remainder quotas; ``group`` is '1' for the whole table, ``more`` names columns to add."""
    digest = f"md5('42|' || CAST({key} AS VARCHAR))"
    return f"""WITH {source},
    keyed AS (SELECT *, {group} AS grp FROM {table}),
    sizes AS (SELECT grp, {strata} AS stratum, count(*) AS n FROM keyed GROUP BY 1, 2),
    totals AS (SELECT *, sum(n) OVER (PARTITION BY grp) AS total FROM sizes),
    aims AS (SELECT *, CAST(total - CASE WHEN total = 1 THEN 0 ELSE ceil(total * 0.2) END AS HUGEINT) AS n_train FROM totals),
    shares AS (SELECT *, (n * n_train) // total AS share, (n * n_train) % total AS rest FROM aims),
    quotas AS (SELECT grp, stratum, n - share - CASE WHEN row_number() OVER (PARTITION BY grp ORDER BY rest DESC, stratum NULLS FIRST)
                 <= n_train - sum(share) OVER (PARTITION BY grp) THEN 1 ELSE 0 END AS quota FROM shares),
    ranked AS (SELECT *, {strata} AS stratum, row_number() OVER (PARTITION BY grp, {strata} ORDER BY {digest}, {key}) AS place
               FROM keyed)
    SELECT {key}, run_id, health_status{more}, CASE WHEN place <= quota THEN 'test' ELSE 'train' END AS split
    FROM ranked r JOIN quotas q ON r.grp = q.grp AND r.stratum IS NOT DISTINCT FROM q.stratum"""


_SHOWN = ("event_id", "run_id", "health_status", "split")


@check("split_by_run", quota_split_sql("readings", READINGS, "run_id", "health_status"))
def split_by_run(spark, folder):
    return splits.split_by_run(readings(spark, folder), "event_id").select(*_SHOWN)


@check("split_by_run_null_status", quota_split_sql("patchy", PATCHY, "run_id", "health_status"))
def split_by_run_null_status(spark, folder):
    return splits.split_by_run(patchy(spark, folder), "event_id").select(*_SHOWN)


@check("split_by_run_unstratified", quota_split_sql("readings", READINGS, "run_id", "'all'"))
def split_by_run_unstratified(spark, folder):
    return splits.split_by_run(readings(spark, folder), "event_id", stratum=None).select(*_SHOWN)


@check("split_stratified", quota_split_sql("readings", READINGS, "1", "health_status"))
def split_stratified(spark, folder):
    return splits.split_stratified(readings(spark, folder), "event_id").select(*_SHOWN)


@check(
    "split_by_hash",
    f"""WITH {READINGS} SELECT event_id, run_id, health_status,
        CASE WHEN md5('42|' || CAST(event_id AS VARCHAR))[1:8] < '{int(0.2 * 2**32):08x}' THEN 'test' ELSE 'train' END AS split FROM readings""",
)
def split_by_hash(spark, folder):
    return splits.split_by_hash(readings(spark, folder), "event_id").select(*_SHOWN)


_WHOLE_RUNS = f"""WITH {READINGS},
    runs AS (SELECT run_id, row_number() OVER (ORDER BY run_id DESC) AS place, count(*) OVER () AS n
             FROM (SELECT DISTINCT run_id FROM readings)),
    split_rows AS (SELECT event_id, r.run_id, health_status,
                          CASE WHEN place <= greatest(1, CAST(floor(n * 0.2) AS BIGINT)) THEN 'test' ELSE 'train' END AS split
                   FROM readings r JOIN runs USING (run_id))"""


@check("split_whole_runs", f"{_WHOLE_RUNS} SELECT * FROM split_rows")
def split_whole_runs(spark, folder):
    return splits.split_whole_runs(readings(spark, folder)).select(*_SHOWN)


@check(
    "split_chronological",
    f"""WITH {PATCHY}
    SELECT event_id, run_id, health_status,
           CASE WHEN row_number() OVER (ORDER BY timestamp NULLS LAST, event_id) <= (SELECT CAST(floor(count(*) * 0.8) AS BIGINT) FROM patchy)
                THEN 'train' ELSE 'test' END AS split
    FROM patchy""",
)
def split_chronological(spark, folder):
    return splits.split_chronological(patchy(spark, folder), "event_id").select(*_SHOWN)


@check(
    "split_stratified_time",
    f"""WITH {PATCHY},
    placed AS (SELECT *, {floor_sql('timestamp', HOUR)} AS win FROM patchy),
    aims AS (SELECT health_status, greatest(1, CAST(floor(count(*) * 0.2) AS BIGINT)) AS aim FROM patchy
             WHERE health_status IS NOT NULL GROUP BY 1),
    wins AS (SELECT win, count(*) AS n FROM placed WHERE win IS NOT NULL GROUP BY 1 HAVING count(health_status) > 0),
    after_all AS (SELECT win, sum(n) OVER (ORDER BY win DESC) AS upto FROM wins),
    per AS (SELECT w.win, a.health_status, a.aim,
                   (SELECT count(*) FROM placed p WHERE p.win >= w.win AND p.health_status = a.health_status) AS upto
            FROM wins w, aims a),
    enough AS (SELECT win FROM per GROUP BY win HAVING bool_and(upto >= aim)
               INTERSECT SELECT win FROM after_all WHERE upto >= (SELECT greatest(1, CAST(floor(count(*) * 0.2) AS BIGINT)) FROM patchy)),
    cut AS (SELECT coalesce((SELECT max(win) FROM enough), (SELECT min(win) FROM wins)) AS start)
    SELECT event_id, run_id, health_status,
           CASE WHEN win >= (SELECT start FROM cut) AND win IN (SELECT win FROM wins) THEN 'test' ELSE 'train' END AS split
    FROM placed""",
)
def split_stratified_time(spark, folder):
    return splits.split_stratified_time(patchy(spark, folder)).select(*_SHOWN)


@check("split_counts", f"{_WHOLE_RUNS} SELECT split, count(*) AS rows FROM split_rows GROUP BY 1")
def split_counts(spark, folder):
    return splits.split_counts(splits.split_whole_runs(readings(spark, folder)))


@check(
    "leakage_runs",
    f"""WITH chosen AS ({quota_split_sql("readings", READINGS, "run_id", "health_status")})
    SELECT run_id FROM chosen WHERE split = 'train' INTERSECT SELECT run_id FROM chosen WHERE split = 'test'""",
)
def leakage_runs(spark, folder):
    return splits.leaked_runs(splits.split_by_run(readings(spark, folder), "event_id"))


@check(
    "loro_folds",
    f"""WITH {READINGS}, sizes AS (SELECT run_id, count(*) AS n FROM readings GROUP BY 1)
    SELECT row_number() OVER (ORDER BY run_id) AS fold, run_id, n AS test_rows,
           CAST((SELECT sum(n) FROM sizes) - n AS BIGINT) AS train_rows FROM sizes""",
)
def loro_folds(spark, folder):
    return splits.run_folds(readings(spark, folder))


_FOLD_SENSORS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _fold_sql() -> str:
    """Nearest centroid of the classes of all other runs, scaled by their variance, written out per fold."""
    total = ", ".join(f"sum({s}) AS s{i}, sum({s} * {s}) AS q{i}" for i, s in enumerate(_FOLD_SENSORS))
    rest = ", ".join(f"t.s{i} - coalesce(o.s{i}, 0) AS s{i}, t.q{i} - coalesce(o.q{i}, 0) AS q{i}" for i in range(4))
    scale = ", ".join(f"sum(q{i}) / sum(n) - (sum(s{i}) / sum(n)) ** 2 AS v{i}" for i in range(4))
    distance = " + ".join(f"(r.{s} - m.s{i} / m.n) ** 2 / v.v{i}" for i, s in enumerate(_FOLD_SENSORS))
    return f"""WITH {READINGS_WIDE},
    w AS (SELECT *, row_number() OVER () AS id FROM readings_wide),
    own AS (SELECT run_id, health_status, count(*) AS n, {total} FROM w GROUP BY 1, 2),
    every AS (SELECT health_status, count(*) AS n, {total} FROM w GROUP BY 1),
    fold AS (SELECT r.run_id, t.health_status, t.n - coalesce(o.n, 0) AS n, {rest} FROM (SELECT DISTINCT run_id FROM w) r, every t
             LEFT JOIN own o ON o.run_id = r.run_id AND o.health_status = t.health_status),
    v AS (SELECT run_id, {scale} FROM fold GROUP BY 1),
    said AS (SELECT r.id, r.run_id, r.health_status, min(struct_pack(d := {distance}, c := m.health_status)).c AS prediction
             FROM w r JOIN fold m USING (run_id) JOIN v USING (run_id) WHERE m.n > 0 GROUP BY 1, 2, 3),
    sides AS (SELECT run_id, health_status AS class, 1 AS support, 0 AS predicted, CAST(health_status = prediction AS INT) AS hits FROM said
              UNION ALL SELECT run_id, prediction, 0, 1, 0 FROM said),
    sums AS (SELECT run_id, class, CAST(sum(support) AS BIGINT) AS support, CAST(sum(predicted) AS BIGINT) AS predicted, CAST(sum(hits) AS BIGINT) AS hits FROM sides GROUP BY 1, 2)
    SELECT *, {num('CASE WHEN predicted > 0 THEN hits / predicted ELSE 0 END')} AS precision, {num('CASE WHEN support > 0 THEN hits / support ELSE 0 END')} AS recall,
           {num('2 * hits / (predicted + support)')} AS f1_score FROM sums"""


@check("loro_metrics", _fold_sql())
def loro_metrics(spark, folder):
    """Leave-one-run-out of all runs in one pass: per fold and class, what the nearest centroid of the other runs gets right."""
    rows = readings_wide(spark, folder).drop("timestamp")
    return folds.fold_report(folds.centroid_folds(rows, _FOLD_SENSORS))
