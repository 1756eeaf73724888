import numpy as np
from pyspark.sql import functions as F

from tagloom.functions.readings import NameRule
from tagloom.operators.regrid import regular_grid, smooth_slots

RULE = NameRule([("smart_9", "Power On Hours"), ("smart_194", "Drive Temperature")])
SCHEMA = "id bigint, drive_id string, reading_ts string, metrics_json string"


def dense_smoother(y, t, q, r, step, n_obs=None):
    """The same model as one Gaussian over all nodes: posterior mean and deviation at the slots' middles."""
    n = len(y)
    nodes = sorted([(k * step + (t[k] if not np.isnan(y[k]) else step / 2), k, "obs") for k in range(n)] + [(k * step + step / 2, k, "mid") for k in range(n)], key=lambda x: (x[0], x[2] != "obs"))
    scale = np.sqrt(r) / 0.7
    first = y[~np.isnan(y)][0]
    size = 2 * len(nodes)
    mean, cov = np.zeros(size), np.zeros((size, size))
    m, p = np.array([first, 0.0]), np.diag([(10 * scale) ** 2, (scale / 2) ** 2])
    trans = []
    for i, (at, _, _) in enumerate(nodes):
        h = at - nodes[i - 1][0] if i else 0.0
        f = np.array([[1, h], [0, 1]])
        m, p = f @ m, f @ p @ f.T + q * np.array([[h**3 / 3, h * h / 2], [h * h / 2, h]])
        trans.append(f)
        mean[2 * i : 2 * i + 2] = m
        cov[2 * i : 2 * i + 2, 2 * i : 2 * i + 2] = p
        for j in range(i):
            c = f @ cov[2 * (i - 1) : 2 * i, 2 * j : 2 * j + 2]
            cov[2 * i : 2 * i + 2, 2 * j : 2 * j + 2] = c
            cov[2 * j : 2 * j + 2, 2 * i : 2 * i + 2] = c.T
    obs = [(i, k) for i, (_, k, kind) in enumerate(nodes) if kind == "obs" and not np.isnan(y[k])]
    hm = np.zeros((len(obs), size))
    for a, (i, _) in enumerate(obs):
        hm[a, 2 * i] = 1
    gain = cov @ hm.T @ np.linalg.inv(hm @ cov @ hm.T + r * np.diag([1 / n_obs[k] if n_obs is not None else 1.0 for _, k in obs]))
    post = mean + gain @ (np.array([y[k] for _, k in obs]) - hm @ mean)
    var = cov - gain @ hm @ cov
    mids = [i for i, (_, _, kind) in enumerate(nodes) if kind == "mid"]
    return post[[2 * i for i in mids]], np.sqrt(np.diag(var)[[2 * i for i in mids]])


def test_smoother_equals_dense_gaussian():
    rng = np.random.default_rng(3)
    y = np.cumsum(rng.normal(size=14))
    y[[3, 4, 9]] = np.nan
    t = rng.uniform(0, 6, size=14)
    value, sd = smooth_slots(y[:, None, None], t[:, None], 2e-4, 6.0)
    d = np.abs(np.diff(y[~np.isnan(y)]))
    scale = 1.4826 * np.median(d)
    want, want_sd = dense_smoother(y, t, 2e-4 * scale**2, (0.7 * scale) ** 2, 6.0)
    assert np.allclose(value[:, 0, 0], want, atol=1e-6) and np.allclose(sd[:, 0, 0], want_sd, atol=1e-6)


def test_means_of_several_readings_weigh_more_and_blocks_do_not_matter():
    rng = np.random.default_rng(8)
    y = np.cumsum(rng.normal(size=17))
    y[[2, 3, 8, 9, 10]] = np.nan
    t, n = rng.uniform(0, 6, size=17), rng.integers(1, 9, 17)
    d = np.abs(np.diff(y[~np.isnan(y)]))
    scale = 1.4826 * np.median(d)
    want, want_sd = dense_smoother(y, t, 2e-4 * scale**2, (0.7 * scale) ** 2, 6.0, n)
    for block in (1, 4, 100):
        value, sd = smooth_slots(y[:, None, None], t[:, None], 2e-4, 6.0, n[:, None], block)
        assert np.allclose(value[:, 0, 0], want, atol=1e-6) and np.allclose(sd[:, 0, 0], want_sd, atol=1e-6)


def test_a_reading_of_a_wrong_year(spark):
    rows = [(1, "d", "2024-05-01T01:00:00", '{"smart_9": 10}'), (2, "d", "1994-05-01T01:00:00", '{"smart_9": 12}'), (3, "d", "2024-05-01T09:00:00", '{"smart_9": 11}')]
    g = regular_grid(spark.createDataFrame(rows, SCHEMA), RULE)
    assert g.count() == 10958 * 4 + 2 and g.where("missing").count() == 10958 * 4 - 1 and g.where("smart_9 is null or smart_9_grid is null").count() == 0


def test_line_is_kept_through_a_gap():
    y = np.arange(40.0) * 6
    y[15:22] = np.nan
    value, sd = smooth_slots(y[:, None, None], np.full((40, 1), 3.0), 2e-4, 6.0)
    assert np.allclose(value[15:22, 0, 0], np.arange(15, 22) * 6, atol=0.5)
    assert sd[18, 0, 0] > sd[5, 0, 0]


def test_grid_marks_missing_slots_and_fills(spark):
    j = '{"smart_9": %d}'
    rows = [(i, "d", ts, j % v) for i, (ts, v) in enumerate([("2024-05-01T01:00:00", 10), ("2024-05-01T02:00:00", 12), ("2024-05-02T07:00:00", 40), ("2024-05-02T07:00:00", 40)])]
    rows += [(8, "e", "2024-05-01T23:00:00", None), (9, None, "2024-05-01T00:00:00", j % 1), (10, "d", "never", j % 1)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("slot", F.lit("clash")).withColumn("n_readings", F.lit(0))
    got = {(r.drive_id, str(r.slot_start)[:13]): r for r in regular_grid(df, RULE).collect()}
    d = [got["d", f"2024-05-0{x}"] for x in ("1 00", "1 06", "1 12", "1 18", "2 00", "2 06")]
    assert len(got) == 7 and [r.n_readings for r in d] == [2, 0, 0, 0, 0, 1] and [r.missing for r in d] == [False, True, True, True, True, False]
    assert d[0].smart_9 == 11 and d[5].smart_9 == 40 and all(11 < r.smart_9 < 40 and r.smart_9_filled and r.smart_9_sd > 0 for r in d[1:5])
    assert d[0].smart_194 is None and not d[0].smart_194_filled
    e = got["e", "2024-05-01 18"]
    assert e.n_readings == 1 and not e.missing and e.smart_9 is None


def test_batches_of_drives_do_not_matter(spark, sf):
    from tagloom.functions.readings import name_rule
    from tagloom.session import table

    r, rule = table(spark, sf, "drive_readings"), name_rule(table(spark, sf, "smart_attributes"))
    a = sorted(map(str, regular_grid(r, rule, ["smart_9"]).select("drive_id", "slot_start", F.round("smart_9", 4)).collect()))
    b = sorted(map(str, regular_grid(r, rule, ["smart_9"], cells=1).select("drive_id", "slot_start", F.round("smart_9", 4)).collect()))
    assert a == b


def test_empty_table(spark):
    assert regular_grid(spark.createDataFrame([], SCHEMA), RULE).count() == 0
