"""DuckDB SQL for the registered queries, written against the same parquet views.

The SQL goes its own way wherever it can: draws from Murmur3 arithmetic instead of the built-in
``hash``, two-pass statistics instead of shifted sums, z-scored samples instead of algebra on the
sums, and Gauss-Jordan elimination instead of Cholesky.
"""

from __future__ import annotations

M32 = 0xFFFFFFFF
U32 = "4294967295::UBIGINT"
TOP = "2147483648::UBIGINT"


# --- Murmur3, 32 bit ---------------------------------------------------------------------------


def _rotl(x, r):
    return ((x << r) | (x >> (32 - r))) & M32


def _mix_word(k):
    return (_rotl((k * 0xCC9E2D51) & M32, 15) * 0x1B873593) & M32


def _hash_int(k, h):
    h = (_rotl(h ^ _mix_word(k), 13) * 5 + 0xE6546B64) & M32
    h ^= 4
    h = ((h ^ (h >> 16)) * 0x85EBCA6B) & M32
    h = ((h ^ (h >> 13)) * 0xC2B2AE35) & M32
    return h ^ (h >> 16)


def _u(n):
    return f"{n}::UBIGINT"


def _rot(x, r):
    return f"((({x}) << {r}) | (({x}) >> {32 - r})) & {U32}"


ABSORB = [  # word t into h
    ("t", lambda t, h: f"({t} * {_u(0xCC9E2D51)}) & {U32}"),
    ("t", lambda t, h: f"(({_rot(t, 15)}) * {_u(0x1B873593)}) & {U32}"),
    ("t", lambda t, h: f"xor({t}, {h})"),
    ("h", lambda t, h: f"(({_rot(t, 13)}) * 5::UBIGINT + {_u(0xE6546B64)}) & {U32}"),
]


def _finish(n):
    return [
        ("h", lambda t, h: f"xor({h}, {_u(n)})"),
        ("h", lambda t, h: f"(xor({h}, {h} >> 16) * {_u(0x85EBCA6B)}) & {U32}"),
        ("h", lambda t, h: f"(xor({h}, {h} >> 13) * {_u(0xC2B2AE35)}) & {U32}"),
        ("h", lambda t, h: f"xor({h}, {h} >> 16)"),
    ]


def hashed(sql: str, words: list[str]) -> str:
    """``sql`` (with a column h) after hashing the words, 1 word = int, 2 words = bigint."""
    for word in words:
        sql = f"SELECT *, ({word})::UBIGINT AS t FROM ({sql})"
        for target, step in ABSORB:
            sql = f"SELECT * REPLACE (({step('t', 'h')}) AS {target}) FROM ({sql})"
        sql = f"SELECT * EXCLUDE (t) FROM ({sql})"
    for target, step in _finish(4 * len(words)):
        sql = f"SELECT * REPLACE (({step('t', 'h')}) AS {target}) FROM ({sql})"
    return sql


# --- instances ---------------------------------------------------------------------------------

INSTANCES = {
    "lines": (
        4,
        "SELECT l_orderkey * 10 + l_linenumber AS id, [max(l_quantity / 50), max(l_extendedprice / 105000), "
        "max(l_discount * 10), max(l_tax * 12.5)]::DOUBLE[] AS x0 FROM lineitem GROUP BY 1",
    ),
    "parts": (
        2,
        "SELECT p_partkey AS id, [p_size / 50::DOUBLE, (p_retailprice - 900) / 100]::DOUBLE[] AS x0 FROM part",
    ),
    "orders": (
        2,
        "SELECT o_orderkey AS id, [o_totalprice / 500000, c_acctbal / 10000]::DOUBLE[] AS x0 "
        "FROM orders JOIN customer ON o_custkey = c_custkey",
    ),
    "embeddings": (64, "SELECT vec_id AS id, embedding::DOUBLE[] AS x0 FROM embeddings"),
    "documents": (1, "SELECT doc_id AS id, [n_chars / 10000::DOUBLE]::DOUBLE[] AS x0 FROM documents"),
    "synthetic": (
        30,
        "SELECT p_partkey AS id, list_transform(range(30), lambda i: CASE WHEN p_partkey % 2 = 0 OR i % 5 <> 0 "
        "THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END) AS x0 FROM part",
    ),
}


def _list(values):
    return "[" + ", ".join(values) + "]"


def _weights(d):
    return _list(f"{0.02 * (i + 1)!r}::DOUBLE" for i in range(d)) + "::DOUBLE[]"


def _sum(expr, d):
    """Sum of ``expr`` (with {i}, 1-based) over the features."""
    return "(" + " + ".join(expr.format(i=i) for i in range(1, d + 1)) + ")"


def samples(
    name, b, seed=1234, mask_prob=0.2, noise_std=0.1, kw=1.0, pred=None, take=None, pre="", background=None
) -> str:
    """CTEs inst, bg, smp: one row per sample with x, z, pred, dist, weight, bb, x0.

    ``pred``: SQL of another black box over a list named {v}.  ``take``: use the first d features.
    """
    d, inst = INSTANCES[name]
    if take:
        inst, d = f"SELECT id, x0[1:{take}] AS x0 FROM ({inst})", take
    words = [_u(_hash_int(k, 42)) for k in range(4 * ((d + 1) // 2))]
    score = pred or f"1 / (1 + exp(-(-1.0::DOUBLE + list_inner_product({{v}}, {_weights(d)}))))"
    means = background or "SELECT " + _list(f"round(avg(x0[{i}]), 9)" for i in range(1, d + 1)) + f" AS m FROM {pre}inst"
    keyed = f"SELECT id, x0 FROM {pre}inst"
    for half, start in (("hi", seed), ("lo", seed ^ 1540483477)):
        keyed = hashed(f"SELECT *, {_u(_hash_int(start & M32, 42))} AS h FROM ({keyed})", [f"id & {M32}", f"(id >> 32) & {M32}"])
        keyed = f"SELECT * EXCLUDE (h), h AS {half} FROM ({keyed})"
    keyed = f"SELECT *, unnest(range({b})) AS s FROM ({keyed})"
    for half in ("hi", "lo"):
        keyed = f"SELECT * EXCLUDE (h), h AS {half} FROM ({hashed(f'SELECT * EXCLUDE ({half}), {half} AS h FROM ({keyed})', ['s'])})"
    mixed = [f"({half} * {_u(0xCC9E2D51)}) & {U32} AS {half}" for half in ("hi", "lo")]
    keyed = f"SELECT id, x0, s, {', '.join(mixed)} FROM ({keyed})"
    mixed = [f"(({_rot(half, 15)}) * {_u(0x1B873593)}) & {U32} AS {half}" for half in ("hi", "lo")]
    keyed = f"SELECT id, x0, s, {', '.join(mixed)} FROM ({keyed})"
    cells = f"SELECT id, x0, s, hi, lo, {_list(words)} AS c FROM ({keyed})"
    turn = f"({_rot('w', 13)}) * 5::UBIGINT + {_u(0xE6546B64)} & {U32}"
    for step in ("xor(w, lo)", turn, "xor(w, hi)", turn, *[f("t", "w") for _, f in _finish(8)]):
        cells = f"SELECT * REPLACE (list_transform(c, lambda w: {step}) AS c) FROM ({cells})"
    cells = f"SELECT * REPLACE (list_transform(c, lambda w: xor(w, {TOP})::DOUBLE) AS c) FROM ({cells})"
    zed = f"list_transform(range(1, {d + 1}), lambda f: CASE WHEN c[f + 2 * ((f - 1) // 2)] < {mask_prob * 2**32!r} THEN 0 ELSE 1 END)"
    value = (
        f"list_transform(range(1, {d + 1}), lambda f: CASE WHEN z[f] = 0 THEN m[f] ELSE x0[f] + {noise_std!r} * "
        "sqrt(-2 * ln((c[4 * ((f - 1) // 2) + 3] + 1) / 4294967296.0::DOUBLE)) * CASE WHEN f % 2 = 1 "
        "THEN cos(c[4 * ((f - 1) // 2) + 4] * (2 * pi() / 4294967296.0::DOUBLE)) "
        "ELSE sin(c[4 * ((f - 1) // 2) + 4] * (2 * pi() / 4294967296.0::DOUBLE)) END END)"
    )
    return (
        f"{pre}inst AS MATERIALIZED ({inst}), {pre}bg AS MATERIALIZED ({means}), "
        f"{pre}cel AS (SELECT *, {zed} AS z FROM ({cells})), "
        f"{pre}val AS (SELECT id, s, x0, z::INTEGER[] AS z, ({value})::DOUBLE[] AS x FROM {pre}cel, {pre}bg), "
        f"{pre}smp AS MATERIALIZED (SELECT *, {score.format(v='x')} AS pred, {score.format(v='x0')} AS bb, "
        f"{_sum('(x[{i}] - x0[{i}]) * (x[{i}] - x0[{i}])', d)} AS dist, exp(-dist / {kw * kw!r}) AS weight FROM {pre}val)"
    )


# --- fits --------------------------------------------------------------------------------------


def standardized(d, pre="") -> str:
    """CTEs sta (mean, std per instance) and zed (samples with 1 and z-scores as xt)."""
    means = _list(f"avg(x[{i}])" for i in range(1, d + 1))
    stds = _list(f"stddev_pop(x[{i}]) + 1e-8" for i in range(1, d + 1))
    xt = _list(["1.0::DOUBLE"] + [f"(x[{i}] - mean[{i}]) / std[{i}]" for i in range(1, d + 1)])
    return (
        f"{pre}sta AS MATERIALIZED (SELECT id, {means} AS mean, {stds} AS std, count(*) AS n FROM {pre}smp GROUP BY id), "
        f"{pre}zed AS MATERIALIZED (SELECT id, s, pred, weight, bb, {xt} AS xt FROM {pre}smp JOIN {pre}sta USING (id))"
    )


def system(d, pre="") -> str:
    """CTE sys: gram (nested list, no ridge), rhs, sums per instance."""
    n = d + 1
    entry = {(i, j): f"sum(weight * xt[{i}] * xt[{j}]) AS a{i}_{j}" for i in range(1, n + 1) for j in range(i, n + 1)}
    rows = _list(
        _list(f"a{min(i, j)}_{max(i, j)}" for j in range(1, n + 1)) for i in range(1, n + 1)
    )
    rhs = [f"sum(weight * xt[{i}] * pred) AS b{i}" for i in range(1, n + 1)]
    return (
        f"{pre}sys AS MATERIALIZED (SELECT id, bb, {rows} AS a, {_list(f'b{i}' for i in range(1, n + 1))} AS b, sw, swyy "
        f"FROM (SELECT id, any_value(bb) AS bb, {', '.join(entry.values())}, {', '.join(rhs)}, sum(weight) AS sw, "
        f"sum(weight * pred * pred) AS swyy FROM {pre}zed GROUP BY id))"
    )


def wide_system(d, pre="") -> str:
    """The same through dot products of whole columns, for many features."""
    n = d + 1
    return (
        f"{pre}col AS MATERIALIZED (SELECT id, i, list(xt[i] * sqrt(weight) ORDER BY s) AS v, "
        f"list(pred * sqrt(weight) ORDER BY s) AS y, any_value(bb) AS bb, sum(weight) AS sw "
        f"FROM (SELECT *, unnest(range(1, {n + 1})) AS i FROM {pre}zed) GROUP BY id, i), "
        f"{pre}ent AS MATERIALIZED (SELECT p.id, p.i, q.i AS j, list_inner_product(p.v, q.v) AS a "
        f"FROM {pre}col p JOIN {pre}col q ON p.id = q.id AND p.i <= q.i)"
    )


def wide_rows(pre="") -> str:
    return (
        f"{pre}ful AS (SELECT id, i, j, a FROM {pre}ent UNION ALL SELECT id, j, i, a FROM {pre}ent WHERE i < j), "
        f"{pre}row AS (SELECT id, i, list(a ORDER BY j) AS r FROM {pre}ful GROUP BY id, i), "
        f"{pre}sys AS MATERIALIZED (SELECT r.id, any_value(c.bb) AS bb, list(r.r ORDER BY r.i) AS a, "
        f"list(list_inner_product(c.v, c.y) ORDER BY r.i) AS b, any_value(c.sw) AS sw "
        f"FROM {pre}row r JOIN {pre}col c ON r.id = c.id AND r.i = c.i GROUP BY r.id)"
    )


def solved(d, ridge=1e-3, pre="") -> str:
    """CTEs for beta of (A + ridge I) beta = b by Gauss-Jordan elimination."""
    n = d + 1
    start = (
        "list_transform(a, lambda r, i: list_append(list_transform(r, lambda v, j: "
        f"CASE WHEN i = j THEN v + {ridge!r} ELSE v END), b[i]))"
    )
    step = (
        "list_transform(m, lambda r, i: CASE WHEN i = k THEN list_transform(r, lambda v: v / m[k][k]) "
        "ELSE list_transform(r, lambda v, j: v - r[k] * m[k][j] / m[k][k]) END)"
    )
    return (
        f"{pre}eli AS (SELECT id, 1 AS k, {start} AS m FROM {pre}sys UNION ALL "
        f"SELECT id, k + 1, {step} FROM {pre}eli WHERE k <= {n}), "
        f"{pre}bet AS MATERIALIZED (SELECT id, list_transform(m, lambda r: r[{n + 1}]) AS beta FROM {pre}eli WHERE k = {n + 1})"
    )


def conjugate(d, ridge=1e-3, steps=200, pre="", free=0) -> str:
    """CTEs for beta by conjugate gradients, which only carry vectors; for many features. ``free``: entry without ridge."""
    n = d + 1
    ap = f"list_transform(a, lambda r, i: list_inner_product(r, p) + CASE WHEN i = {free} THEN 0 ELSE {ridge!r} * p[i] END)"
    return (
        f"{pre}eli AS (SELECT id, 0 AS k, {_list(['0.0::DOUBLE'] * n)} AS beta, b AS r, b AS p, list_inner_product(b, b) AS rr "
        f"FROM {pre}sys UNION ALL SELECT id, k + 1, beta, r, list_transform(r, lambda v, i: v + nn / rr * p[i]), nn FROM ("
        f"SELECT *, list_inner_product(r, r) AS nn FROM (SELECT id, k, rr, p, "
        f"list_transform(beta, lambda v, i: v + al * p[i]) AS beta, list_transform(r, lambda v, i: v - al * ap[i]) AS r FROM ("
        f"SELECT *, rr / list_inner_product(p, ap) AS al FROM (SELECT e.id, k, beta, r, p, rr, {ap} AS ap "
        f"FROM {pre}eli e JOIN {pre}sys y ON e.id = y.id WHERE k < {steps} AND rr > 1e-28))))), "
        f"{pre}bet AS MATERIALIZED (SELECT id, arg_max(beta, k) AS beta FROM {pre}eli GROUP BY id)"
    )


def descended(d, ridge=1e-3, iters=500, lr=1e-2, pre="") -> str:
    n = d + 1
    step = (
        "list_transform(beta, lambda v, i: v - "
        f"({lr!r} / greatest(sw, 1e-12)) * (list_inner_product(a[i], beta) - b[i] + {ridge!r} * v))"
    )
    return (
        f"{pre}eli AS (SELECT id, 0 AS k, {_list(['0.0::DOUBLE'] * n)} AS beta FROM {pre}sys UNION ALL "
        f"SELECT e.id, k + 1, {step} FROM {pre}eli e JOIN {pre}sys y ON e.id = y.id WHERE k < {iters}), "
        f"{pre}bet AS MATERIALIZED (SELECT id, beta FROM {pre}eli WHERE k = {iters})"
    )


def adam(d, epochs=300, lr=0.01, pre="") -> str:
    """Adam on the sums; the loss of the point before each step is kept as ``loss``."""
    n = d + 1
    zero = _list(["0.0::DOUBLE"] * n)
    grad = "list_transform(beta, lambda v, i: 2 * (list_inner_product(a[i], beta) - b[i]) / greatest(sw, 1e-12))"
    first = "list_transform(u, lambda v, i: 0.9::DOUBLE * v + 0.1::DOUBLE * g[i])"
    second = "list_transform(q, lambda v, i: 0.999::DOUBLE * v + 0.001::DOUBLE * g[i] * g[i])"
    move = (
        f"list_transform(beta, lambda v, i: v - {lr!r} * (nu[i] / (1 - pow(0.9::DOUBLE, k + 1))) / "
        "(sqrt(nq[i] / (1 - pow(0.999::DOUBLE, k + 1))) + 1e-8))"
    )
    loss = (
        "(list_inner_product(beta, list_transform(a, lambda r: list_inner_product(r, beta))) "
        "- 2 * list_inner_product(b, beta) + swyy) / greatest(sw, 1e-12)"
    )
    return (
        f"{pre}eli AS (SELECT id, 0 AS k, {zero} AS beta, {zero} AS u, {zero} AS q FROM {pre}sys UNION ALL "
        f"SELECT id, k + 1, {move}, nu, nq FROM (SELECT *, {second} AS nq FROM (SELECT *, {first} AS nu FROM "
        f"(SELECT e.id, k, beta, u, q, {grad} AS g FROM {pre}eli e JOIN {pre}sys y ON e.id = y.id WHERE k < {epochs})))), "
        f"{pre}bet AS MATERIALIZED (SELECT id, beta FROM {pre}eli WHERE k = {epochs}), "
        f"{pre}los AS (SELECT e.id, e.k AS epoch, {loss} AS loss FROM {pre}eli e JOIN {pre}sys y ON e.id = y.id WHERE k < {epochs})"
    )


def fitted(d, pre="", normalized=False) -> str:
    """CTE fit: coeff, intercept, surr, bb, r2 with two-pass sums over the samples."""
    coeff = _list(f"beta[{i + 1}] / std[{i}]" for i in range(1, d + 1))
    total = "sum(weight * (pred - ym) * (pred - ym))"
    guard = f"{total} / greatest(sum(weight), 1e-12)" if normalized else total
    return (
        f"{pre}cof AS MATERIALIZED (SELECT id, {coeff} AS coeff, mean, n, beta[1] - {_sum('beta[{i}+1] / std[{i}] * mean[{i}]', d)} "
        f"AS intercept FROM {pre}bet JOIN {pre}sta USING (id)), "
        f"{pre}prd AS MATERIALIZED (SELECT id, s, x0, x, z, pred, weight, bb, coeff, intercept, mean, n, "
        f"intercept + {_sum('coeff[{i}] * x[{i}]', d)} AS surr FROM {pre}smp JOIN {pre}cof USING (id)), "
        f"{pre}avg AS (SELECT id, sum(weight * pred) / greatest(sum(weight), 1e-12) AS ym FROM {pre}prd GROUP BY id), "
        f"{pre}fit AS MATERIALIZED (SELECT id, any_value(coeff) AS coeff, any_value(intercept) AS intercept, any_value(n) AS n, "
        f"any_value(mean) AS mean, any_value(bb) AS bb, any_value(x0) AS x0, sum(weight) AS sw, "
        f"any_value(intercept) + {_sum('any_value(coeff)[{i}] * any_value(x0)[{i}]', d)} AS surr_x0, "
        f"CASE WHEN {guard} > 1e-12 THEN 1 - sum(weight * (pred - surr) * (pred - surr)) / {total} ELSE 0 END AS r2 "
        f"FROM {pre}prd JOIN {pre}avg USING (id) GROUP BY id)"
    )


def explained(name, b, ridge=1e-3, solver="cholesky", pre="", wide=False, normalized=None, epochs=300, **kw) -> str:
    d = kw.get("take") or INSTANCES[name][0]
    solve = {
        "cholesky": lambda: conjugate(d, ridge, pre=pre) if wide else solved(d, ridge, pre),
        "gd": lambda: descended(d, ridge, pre=pre),
        "adam": lambda: adam(d, epochs, pre=pre),
    }[solver]()
    mid = f"{wide_system(d, pre)}, {wide_rows(pre)}" if wide else system(d, pre)
    normalized = solver == "adam" if normalized is None else normalized
    return ", ".join([samples(name, b, pre=pre, **kw), standardized(d, pre), mid, solve, fitted(d, pre, normalized)])


def rnd(expr, digits=6):
    return f"round({expr}, {digits}) + 0.0"


def trained(d, c=1.0, steps=12, pre="") -> str:
    """CTE tra (b: intercept and weights) of the logistic model on the rows trn (row_id, y, x), by reweighted least squares."""
    start = (
        f"{pre}xte AS MATERIALIZED (SELECT row_id, y, list_prepend(1.0::DOUBLE, x) AS xt FROM trn), "
        f"{pre}n0_bet AS (SELECT 1 AS id, {_list(['0.0::DOUBLE'] * (d + 1))} AS beta)"
    )
    parts = [start]
    for k in range(1, steps + 1):
        p = f"{pre}n{k}_"
        parts += [
            f"{p}zed AS MATERIALIZED (SELECT 1 AS id, row_id AS s, xt, 0 AS bb, v * (1 - v) AS weight, z + (y - v) / (v * (1 - v)) AS pred "
            f"FROM (SELECT *, 1 / (1 + exp(-z)) AS v FROM (SELECT *, list_inner_product(xt, beta) AS z FROM {pre}xte, {pre}n{k - 1}_bet)))",
            wide_system(d, p), wide_rows(p), conjugate(d, 1.0 / c, pre=p, free=1),
        ]
    return ", ".join([*parts, f"{pre}tra AS MATERIALIZED (SELECT beta AS b FROM {pre}n{steps}_bet)"])


def ablated(d, points, intercept=False, pre="") -> str:
    """CTEs for the ablation curve of ``fit``: rows (id, k, wmae) in abl."""
    first = _sum("coeff[{i}] * x[{i}]", d) + (" + intercept" if intercept else "")
    return (
        f"{pre}rnk AS MATERIALIZED (SELECT id, list(idx ORDER BY rank) AS ord FROM ({ranked(pre + 'fit', d)}) GROUP BY id), "
        f"{pre}abr AS (SELECT {pre}prd.*, ord, {first} AS p0 FROM {pre}prd JOIN {pre}rnk USING (id)), "
        f"{pre}stp AS (SELECT id, weight, pred, unnest(range(0, {points + 1})) AS k, p0, list_prepend(0.0::DOUBLE, list_transform(ord, "
        f"lambda i: coeff[i + 1] * (mean[i + 1] - x[i + 1]))) AS d FROM {pre}abr), "
        f"{pre}abl AS (SELECT id, k, sum(weight * abs(p0 + list_sum(d[1:k + 1]) - pred)) / sum(weight) AS wmae FROM {pre}stp GROUP BY id, k)"
    )


def ranked(source="fit", d=4, extra=""):
    """Features of every fit with their rank by falling |coefficient|."""
    return (
        f"SELECT id, f - 1 AS idx, coeff[f] AS c, row_number() OVER (PARTITION BY id ORDER BY abs(coeff[f]) DESC, f) AS rank"
        f"{extra} FROM (SELECT *, unnest(range(1, {d + 1})) AS f FROM {source})"
    )


def ranks(source, d):
    """Ordinal ranks of |coefficient|, rising."""
    return (
        f"SELECT id, f, coeff[f] AS c, row_number() OVER (PARTITION BY id ORDER BY abs(coeff[f]), f) AS r, "
        f"row_number() OVER (PARTITION BY id ORDER BY abs(coeff[f]) DESC, f) AS top "
        f"FROM (SELECT *, unnest(range(1, {d + 1})) AS f FROM {source})"
    )


def pair(a, b, d, k, name_a, name_b):
    return (
        f"SELECT id AS instance_id, '{name_a}' AS source_a, '{name_b}' AS source_b, {rnd('cosine')} AS cosine, "
        f"{rnd('spearman')} AS spearman, {rnd('overlap')} AS overlap, {rnd('delta')} AS max_abs_delta, "
        f"{rnd('abs(p.intercept - q.intercept)')} AS intercept_delta, {rnd('abs(p.r2 - q.r2)')} AS r2_delta, "
        f"{rnd('abs(p.surr_x0 - q.surr_x0)')} AS x0_delta FROM ("
        "SELECT u.id, CASE WHEN sqrt(sum(u.c * u.c)) * sqrt(sum(v.c * v.c)) > 1e-12 THEN sum(u.c * v.c) / "
        "(sqrt(sum(u.c * u.c)) * sqrt(sum(v.c * v.c))) ELSE 0 END AS cosine, coalesce(corr(u.r, v.r), 0) AS spearman, "
        f"count(*) FILTER (WHERE u.top <= {k} AND v.top <= {k}) / {float(k)!r} AS overlap, max(abs(u.c - v.c)) AS delta "
        f"FROM ({ranks(a, d)}) u JOIN ({ranks(b, d)}) v ON u.id = v.id AND u.f = v.f GROUP BY u.id) "
        f"JOIN {a} p USING (id) JOIN {b} q USING (id)"
    )


def names(values, idx):
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][{idx} + 1]"


LINE_NAMES = ["mean quantity", "extendedprice error", "worst discount", "tax"]
PART_NAMES = ["size", "worst retailprice"]


def group_of(n):
    return (
        f"CASE WHEN {n} LIKE '% error%' THEN 'error' WHEN {n} LIKE 'mean %' THEN 'mean' "
        f"WHEN {n} LIKE 'worst %' THEN 'worst' ELSE 'other' END"
    )


def label_of(n):
    return (
        f"CASE WHEN {n} LIKE '% error%' THEN replace({n}, ' error', '') || ' [error]' "
        f"WHEN {n} LIKE 'mean %' THEN replace({n}, 'mean ', '') || ' [mean]' "
        f"WHEN {n} LIKE 'worst %' THEN replace({n}, 'worst ', '') || ' [worst]' ELSE {n} END"
    )


def coefficients(d, solver):
    return (
        f" SELECT id AS instance_id, '{solver}' AS solver, {rnd('intercept')} AS intercept, (f - 1)::INTEGER AS feature_idx, "
        f"{rnd('coeff[f]')} AS coefficient FROM (SELECT *, unnest(range(1, {d + 1})) AS f FROM fit)"
    )


W = "WITH RECURSIVE "
ORACLES: dict[str, str] = {}

# perturbation
ORACLES["perturb_cells"] = (
    W + samples("parts", 32) + " SELECT id AS instance_id, s::INTEGER AS sample_id, (f - 1)::INTEGER AS feature_idx, "
    f"{rnd('x[f]', 8)} AS x, z[f] AS z FROM (SELECT *, unnest(range(1, 3)) AS f FROM smp)"
)
ORACLES["perturb_long"] = (
    W + samples("orders", 8) + " SELECT id AS instance_id, s::INTEGER AS sample_id, (f - 1)::INTEGER AS feature_idx, "
    f"{rnd('x[f]', 8)} AS x, z[f] AS z FROM (SELECT *, unnest(range(1, 3)) AS f FROM smp)"
)
ORACLES["perturb_mask_rate"] = (
    W + samples("orders", 64) + " SELECT (f - 1)::INTEGER AS feature_idx, count(*) AS cells, "
    "count(*) FILTER (WHERE z[f] = 0) AS masked FROM (SELECT *, unnest(range(1, 3)) AS f FROM smp) GROUP BY f"
)
ORACLES["synthetic_scores"] = (
    W + samples("synthetic", 16, background="SELECT list_transform(range(30), lambda i: 0.5::DOUBLE) AS m")
    + f" SELECT id AS instance_id, {rnd('avg(pred)')} AS mean_pred, {rnd('avg(weight)')} AS mean_weight, "
    "count(*) AS n_samples FROM smp GROUP BY id"
)

# scoring and weighting
ORACLES["score_samples"] = ORACLES["score_batched"] = (
    W + samples("lines", 8) + f" SELECT id AS instance_id, s::INTEGER AS sample_id, {rnd('pred', 8)} AS pred FROM smp"
)
ORACLES["distance_weight"] = (
    W + samples("orders", 16, kw=0.75)
    + f" SELECT id AS instance_id, s::INTEGER AS sample_id, {rnd('dist', 8)} AS dist, {rnd('weight', 8)} AS weight FROM smp"
)
ORACLES["run_means"] = (
    W + samples("orders", 64) + f" SELECT id AS instance_id, {rnd('avg(pred)')} AS mean_pred, "
    f"{rnd('avg(weight)')} AS mean_weight, count(*) AS n_samples FROM smp GROUP BY id"
)
ORACLES["score_at_x0"] = (
    f"SELECT id AS instance_id, round(1 / (1 + exp(-(-1.0::DOUBLE + list_inner_product(x0, {_weights(4)})))), 8) + 0.0 "
    f"AS bb_x0 FROM ({INSTANCES['lines'][1]})"
)
NETWORK = "1 / (1 + exp(-(tanh(2 * {v}[1] - {v}[2]) - 0.5 * tanh({v}[1] + 3 * {v}[2]))))"
ORACLES["explain_network"] = (
    W + explained("orders", 32, pred=NETWORK)
    + f" SELECT id AS instance_id, 'cholesky' AS solver, {rnd('intercept')} AS intercept, (f - 1)::INTEGER AS feature_idx, "
    f"{rnd('coeff[f]')} AS coefficient, {rnd('r2')} AS r2 FROM (SELECT *, unnest(range(1, 3)) AS f FROM fit)"
)
ORACLES["replay_scores"] = (
    W + samples("parts", 32, seed=42) + f" SELECT id AS instance_id, s::INTEGER AS sample_id, {rnd('pred', 8)} AS pred, "
    f"{rnd('dist', 8)} AS dist, {rnd('weight', 8)} AS weight FROM smp"
)
ORACLES["bundle_outputs"] = (
    W + samples("parts", 16) + f" SELECT id AS instance_id, s::INTEGER AS sample_id, {rnd('x[1]')} AS x_0, {rnd('x[2]')} AS x_1, "
    f"z[1] AS z_0, z[2] AS z_1, {rnd('pred')} AS pred, {rnd('weight')} AS weight FROM smp"
)

# moments and fits
ORACLES["feature_stats"] = (
    W + samples("lines", 16) + " SELECT id AS instance_id, (f - 1)::INTEGER AS feature_idx, count(*) AS n, "
    f"{rnd('sum(x[f])')} AS sum_x, {rnd('sum(x[f] * x[f])')} AS sum_xx, {rnd('avg(x[f])')} AS mean, "
    f"{rnd('stddev_pop(x[f]) + 1e-8')} AS std FROM (SELECT *, unnest(range(1, 5)) AS f FROM smp) GROUP BY id, f"
)
ORACLES["zscore_cells"] = (
    W + samples("parts", 16) + ", " + standardized(2) + " SELECT id AS instance_id, s::INTEGER AS sample_id, "
    f"(f - 1)::INTEGER AS feature_idx, {rnd('xt[f + 1]')} AS x_norm FROM (SELECT *, unnest(range(1, 3)) AS f FROM zed)"
)
ORACLES["gram_entries"] = (
    W + ", ".join([samples("orders", 32), standardized(2), system(2)])
    + " SELECT id AS instance_id, (i - 1)::INTEGER AS i, (j - 1)::INTEGER AS j, "
    + rnd("a[i][j] + CASE WHEN i = j THEN 0.001 ELSE 0 END")
    + " AS value FROM (SELECT *, unnest(range(i, 4)) AS j FROM (SELECT *, unnest(range(1, 4)) AS i FROM sys))"
)
ORACLES["rhs_entries"] = (
    W + ", ".join([samples("orders", 32), standardized(2), system(2)])
    + f" SELECT id AS instance_id, (i - 1)::INTEGER AS i, {rnd('b[i]')} AS value FROM (SELECT *, unnest(range(1, 4)) AS i FROM sys)"
)
ORACLES["gram_wide"] = (
    W + ", ".join([samples("embeddings", 128), standardized(64), wide_system(64)])
    + " SELECT id AS instance_id, (i - 1)::INTEGER AS i, (j - 1)::INTEGER AS j, "
    + rnd("a + CASE WHEN i = j THEN 0.001 ELSE 0 END")
    + " AS value FROM ent UNION ALL SELECT id, (i - 1)::INTEGER, -1, "
    + rnd("list_inner_product(v, y)") + " FROM col"
)
ORACLES["top_features"] = (
    W + explained("lines", 32) + f" SELECT id AS instance_id, rank::INTEGER AS rank, idx::INTEGER AS feature_idx, "
    f"{names(LINE_NAMES, 'idx')} AS feature, {rnd('c')} AS coefficient FROM ({ranked()}) WHERE rank <= 3"
)
ORACLES["fit_cholesky"] = W + explained("lines", 32) + coefficients(4, "cholesky")
ORACLES["fit_single_feature"] = W + explained("documents", 32) + coefficients(1, "cholesky")
ORACLES["fit_gd"] = W + explained("parts", 32, solver="gd") + coefficients(2, "gd")
ORACLES["fit_adam"] = W + explained("parts", 32, solver="adam") + coefficients(2, "adam")
ORACLES["loss_curve"] = (
    W + explained("parts", 32, solver="adam", epochs=100)
    + f" SELECT id AS instance_id, epoch::INTEGER AS epoch, {rnd('loss')} AS loss FROM los"
)
ORACLES["fit_wide"] = W + explained("embeddings", 200, wide=True) + coefficients(64, "cholesky")
ORACLES["fit_ranges"] = W + explained("lines", 64) + coefficients(4, "cholesky")
ORACLES["fit_replayed"] = W + explained("parts", 32) + coefficients(2, "cholesky")
ORACLES["fit_wide_ranges"] = ORACLES["fit_replayed_wide"] = ORACLES["fit_wide"]
ORACLES["fit_fallback"] = (
    "SELECT id AS instance_id, CASE WHEN x0[1] > 0.5 THEN 'gd' ELSE 'cholesky' END AS solver, "
    f"CASE WHEN x0[1] > 0.5 THEN 500 ELSE 0 END AS num_iters FROM ({INSTANCES['parts'][1]})"
)
ORACLES["fit_quality"] = (
    W + explained("lines", 32) + f" SELECT id AS instance_id, {rnd('r2')} AS r2, {rnd('surr_x0')} AS surr_x0, {rnd('bb')} AS bb_x0, "
    f"{rnd('abs(surr_x0 - bb)')} AS delta, {rnd('sw')} AS sum_weights, n AS n_samples FROM fit"
)
for _name, _norm in (("weighted_r2", False), ("weighted_r2_norm", True)):
    ORACLES[_name] = (
        W + explained("orders", 32, normalized=_norm)
        + f" SELECT id AS instance_id, {rnd('r2')} AS r2, {rnd('sw')} AS sum_weights FROM fit"
    )
ORACLES["surrogate_predictions"] = (
    W + explained("parts", 32) + f" SELECT id AS instance_id, s::INTEGER AS sample_id, {rnd('surr')} AS surr FROM prd"
)

# reports
NAME = names(LINE_NAMES, "f")
ORACLES["attribution_table"] = (
    W + explained("lines", 32) + f" SELECT id AS instance_id, f::INTEGER AS line, {NAME} AS feature, "
    f"{group_of(NAME)} AS \"group\", {rnd('coeff[f + 1]')} AS coefficient, {rnd('abs(coeff[f + 1])')} AS abs_coefficient, "
    "CASE WHEN coeff[f + 1] > 0 THEN 'positive' ELSE 'negative' END AS direction "
    "FROM (SELECT *, unnest(range(0, 4)) AS f FROM fit) "
    f"UNION ALL SELECT id, 4, 'intercept', '', {rnd('intercept')}, NULL, '' FROM fit "
    f"UNION ALL SELECT id, 5, 'weighted_r2', '', {rnd('r2')}, NULL, '' FROM fit"
)
ORACLES["importance_data"] = (
    W + explained("lines", 32) + f" SELECT id AS instance_id, (4 - rank)::INTEGER AS bar, {label_of(names(LINE_NAMES, 'idx'))} AS label, "
    f"{rnd('c')} AS coefficient, CASE WHEN c < 0 THEN 'negative' ELSE 'positive' END AS sign FROM ({ranked()}) WHERE rank <= 15"
)
ORACLES["consistency"] = (
    W + explained("lines", 32, mask_prob=0.5) + f" SELECT id AS instance_id, {rnd('surr_x0')} AS surr_x0, {rnd('bb')} AS bb_x0, "
    f"{rnd('abs(surr_x0 - bb)')} AS delta, CASE WHEN abs(surr_x0 - bb) < 0.001 THEN 'PASS' ELSE 'WARN' END AS status FROM fit"
)
ORACLES["ablation_curve"] = (
    W + explained("lines", 32)
    + f", rnk AS MATERIALIZED (SELECT id, list(idx ORDER BY rank) AS ord FROM ({ranked()}) GROUP BY id), "
    + "abl AS (SELECT prd.*, ord, " + _sum("coeff[{i}] * x[{i}]", 4) + " AS p0 FROM prd JOIN rnk USING (id)), "
    + "stp AS (SELECT id, weight, pred, unnest(range(0, 5)) AS k, p0, list_prepend(0.0::DOUBLE, list_transform(ord, "
    + "lambda i: coeff[i + 1] * (mean[i + 1] - x[i + 1]))) AS d FROM abl) "
    + f"SELECT id AS instance_id, k::INTEGER AS k, {rnd('sum(weight * abs(p0 + list_sum(d[1:k + 1]) - pred)) / sum(weight)')} AS wmae "
    + "FROM stp GROUP BY id, k"
)

# agreement
_three = ", ".join(
    [
        samples("parts", 32), standardized(2), system(2),
        *[
            part
            for tag, solve in (("c_", solved), ("g_", descended), ("a_", adam))
            for part in (
                f"{tag}smp AS (SELECT * FROM smp)", f"{tag}sta AS (SELECT * FROM sta)", f"{tag}sys AS (SELECT * FROM sys)",
                solve(2, pre=tag), fitted(2, tag, tag == "a_"),
            )
        ],
    ]
)
ORACLES["compare_solvers"] = (
    W + _three + " " + " UNION ALL ".join(
        pair(f"{p}fit", f"{q}fit", 2, 1, a, b)
        for p, q, a, b in (
            ("c_", "g_", "cholesky", "gd"), ("c_", "a_", "cholesky", "adam"), ("g_", "a_", "gd", "adam"),
        )
    )
)
ORACLES["source_summary"] = (
    W + _three + " " + " UNION ALL ".join(
        f"SELECT id AS instance_id, '{name}' AS source, {rnd('intercept')} AS intercept, {rnd('r2')} AS r2, "
        f"{rnd('surr_x0')} AS surr_x0, {rnd('bb')} AS bb_x0 FROM {tag}fit"
        for tag, name in (("c_", "cholesky"), ("g_", "gd"), ("a_", "adam"))
    )
)
ORACLES["compare_seeds"] = (
    W + explained("lines", 32, pre="p_") + ", " + explained("lines", 32, seed=42, pre="q_")
    + " " + pair("p_fit", "q_fit", 4, 2, "seed 1234", "seed 42")
)
ORACLES["side_by_side"] = (
    W + explained("lines", 32) + ", " + explained("lines", 32, ridge=10.0, pre="q_")
    + f" SELECT r.id AS instance_id, rank::INTEGER AS rank, {names(LINE_NAMES, 'idx')} AS feature, {rnd('c')} AS closed, "
    f"{rnd('q.coeff[idx + 1]')} AS strong_ridge, NULL::DOUBLE AS absent FROM ({ranked()}) r JOIN q_fit q USING (id) WHERE rank <= 2"
)
ORACLES["normalize_fits"] = (
    W + _three + " " + " UNION ALL ".join(
        f"SELECT id AS instance_id, '{name}' AS solver, 0.001::DOUBLE AS ridge, {rnd('intercept')} AS intercept, {rnd('r2')} AS r2, "
        f"{rnd('x0[1]')} AS x0_0, {rnd('x0[2]')} AS x0_1, '{','.join(PART_NAMES)}' AS feature_names, true AS no_loss FROM {tag}fit"
        for tag, name in (("c_", "cholesky"), ("g_", "gd"))
    )
)

# validation
STORED = (
    W + samples("parts", 32) + ", chk AS MATERIALIZED (SELECT *, round(pred, 4) AS sp, round(weight, 4) AS sw, "
    "abs(round(pred, 4) - pred) AS pd, abs(round(weight, 4) - weight) AS wd FROM smp)"
)
ORACLES["replay_check"] = (
    STORED + f" SELECT id AS instance_id, s::INTEGER AS sample_id, sp AS stored_pred, {rnd('pred', 8)} AS pred, sw AS stored_weight, "
    f"{rnd('weight', 8)} AS weight, {rnd('pd', 8)} AS pred_diff, {rnd('wd', 8)} AS weight_diff FROM chk"
)
ORACLES["tolerance_report"] = STORED + " " + " UNION ALL ".join(
    f"SELECT '{n}' AS name, count(*) AS n, {rnd(f'max({dif})', 9)} AS max_diff, {rnd(f'avg({dif})', 9)} AS mean_diff, "
    f"{rnd(f'max({dif} / (abs({ref}) + 1e-12))', 9)} AS max_rel, {rnd(f'avg({old})', 9)} AS mean_stored, "
    f"{rnd(f'avg({ref})', 9)} AS mean_recomputed, 0::BIGINT AS unmatched, bool_and({dif} <= 3e-5 + 1e-4 * abs({ref})) AS passed FROM chk"
    for n, dif, ref, old in (("preds", "pd", "pred", "sp"), ("weights", "wd", "weight", "sw"))
)
ORACLES["diff_histogram"] = STORED + "".join(
    f", spn{v} AS (SELECT min({v}) AS lo, max({v}) AS hi FROM chk), "
    f"cnt{v} AS (SELECT least(floor(({v} - lo) / (hi - lo) * 8), 7)::INTEGER AS bin, count(*) AS n FROM chk, spn{v} GROUP BY 1), "
    f"bin{v} AS (SELECT r.bin, lo, hi, coalesce(n, 0) AS n FROM (SELECT unnest(range(8))::INTEGER AS bin) r CROSS JOIN spn{v} "
    f"LEFT JOIN cnt{v} USING (bin))"
    for v in ("pd", "wd")
) + " " + " UNION ALL ".join(
    f"SELECT bin, {rnd('lo + bin * ((hi - lo) / 8)', 9)} AS lo, {rnd('lo + (bin + 1) * ((hi - lo) / 8)', 9)} AS hi, n, "
    f"floor(40 * n / max(n) OVER ())::INTEGER AS bar, '{name}' AS name FROM bin{v}"
    for v, name in (("pd", "preds"), ("wd", "weights"))
)
ORACLES["shape_check"] = (
    W + samples("orders", 16) + " SELECT id AS instance_id, true AS known, count(*) FILTER (WHERE weight > 0.9) AS n_rows, "
    "count(*) FILTER (WHERE weight > 0.9) AS n_found, "
    "count(*) FILTER (WHERE weight > 0.9) = 16 AS passed FROM smp GROUP BY id"
)
ORACLES["mask_checks"] = (
    W + samples("parts", 32) + ", dmg AS (SELECT id, x, m, CASE WHEN x[1] > 0.95 THEN [2, 0] ELSE z END AS z FROM smp, bg), "
    "cel1 AS (SELECT id, z[f] AS zz, x[f] AS xx, m[f] AS mm FROM (SELECT *, unnest(range(1, 3)) AS f FROM dmg)) "
    "SELECT id AS instance_id, count(*) AS cells, count(*) FILTER (WHERE zz = 0) AS masked, "
    "count(*) FILTER (WHERE zz NOT IN (0, 1)) AS bad_mask, count(*) FILTER (WHERE zz = 0 AND xx <> mm) AS bad_value, "
    "count(*) FILTER (WHERE zz NOT IN (0, 1) OR (zz = 0 AND xx <> mm)) = 0 AS passed FROM cel1 GROUP BY id"
)
# planted damage: rows under the negative of an id, a sample stored under another's number, null mask cells, wrong scores
BROKEN = STORED + (
    ", brk AS MATERIALIZED (SELECT id, CASE WHEN id % 11 = 3 AND s = 7 THEN 6 ELSE s END AS s, x, "
    "CASE WHEN id % 13 = 5 AND s = 1 THEN [NULL, 7] ELSE z END AS z, sp + CASE WHEN id % 17 = 2 AND s = 3 THEN 0.5::DOUBLE ELSE 0 END AS sp, "
    "sw, pred, weight FROM chk "
    "UNION ALL SELECT -id, s, x, z, 0, 0, NULL, NULL FROM chk WHERE id % 50 = 7 AND s < 8)"
)
_SHAPE = (
    "SELECT id AS instance_id, id >= 0 AS known, count(*) AS n_rows, count(DISTINCT s) AS n_found, "
    "id >= 0 AND count(*) = 32 AND count(DISTINCT s) = 32 AS passed FROM brk GROUP BY id"
)
_MASK = (
    "SELECT id AS instance_id, count(*) AS cells, count(*) FILTER (WHERE zz = 0) AS masked, "
    "count(*) FILTER (WHERE coalesce(zz NOT IN (0, 1), true)) AS bad_mask, "
    "count(*) FILTER (WHERE zz = 0 AND xx <> mm) AS bad_value, "
    "count(*) FILTER (WHERE coalesce(zz NOT IN (0, 1), true) OR (zz = 0 AND xx <> mm)) = 0 AS passed FROM "
    "(SELECT id, z[f] AS zz, x[f] AS xx, m[f] AS mm FROM (SELECT brk.*, m, unnest(range(1, 3)) AS f FROM brk, bg)) GROUP BY id"
)
_TOLERANCE = " UNION ALL ".join(
    f"SELECT '{n}' AS name, count(*) AS n, {rnd(f'max(abs({old} - {ref}))', 9)} AS max_diff, {rnd(f'avg(abs({old} - {ref}))', 9)} AS mean_diff, "
    f"{rnd(f'max(abs({old} - {ref}) / (abs({ref}) + 1e-12))', 9)} AS max_rel, {rnd(f'avg({old})', 9)} AS mean_stored, "
    f"{rnd(f'avg({ref})', 9)} AS mean_recomputed, count(*) FILTER (WHERE {ref} IS NULL) AS unmatched, "
    f"bool_and(coalesce(abs({old} - {ref}) <= 1e-4 + 1e-3 * abs({ref}), false)) AS passed FROM brk"
    for n, ref, old in (("preds", "pred", "sp"), ("weights", "weight", "sw"))
)
ORACLES["damage_tolerance"] = f"{BROKEN} {_TOLERANCE}"
ORACLES["damage_shape"] = f"{BROKEN} {_SHAPE}"
ORACLES["damage_masks"] = f"{BROKEN} {_MASK}"
ORACLES["damage_verdict"] = (
    f"{BROKEN} SELECT bool_and(passed) AS passed, 3::BIGINT AS checks FROM (SELECT passed FROM ({_TOLERANCE}) "
    f"UNION ALL SELECT passed FROM ({_SHAPE}) UNION ALL SELECT passed FROM ({_MASK}))"
)
ORACLES["verdict"] = (
    STORED + " SELECT bool_and(pd <= 1e-4 + 1e-3 * abs(pred) AND wd <= 1e-4 + 1e-3 * abs(weight)) AS passed, 3::BIGINT AS checks FROM chk"
)


# data preparation
def shuffled(table_sql: str, seed: int = 42) -> str:
    """Rows with ``o``, the hash that orders them."""
    keyed = hashed(
        f"SELECT *, {_u(_hash_int(seed, 42))} AS h FROM ({table_sql})",
        [f"row_id & {M32}", f"(row_id >> 32) & {M32}"],
    )
    return f"SELECT * EXCLUDE (h), xor(h, {TOP}) AS o FROM ({keyed})"


def split_sql(table_sql: str) -> str:
    return (
        "SELECT *, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY o, row_id) "
        f"<= round(0.2 * count(*) OVER (PARTITION BY label)) THEN 'test' ELSE 'train' END AS split FROM ({shuffled(table_sql)})"
    )


ORACLES["stratified_split"] = (
    f"SELECT row_id, label, split FROM ({split_sql('SELECT event_id AS row_id, event_type AS label FROM events')})"
)
ORACLES["binary_dataset"] = (
    f"SELECT vec_id AS row_id, (label <> 0)::INTEGER AS label, (f - 1)::INTEGER AS feature_idx, {rnd('embedding[f]::DOUBLE')} AS x "
    "FROM (SELECT *, unnest(range(1, 65)) AS f FROM embeddings)"
)
ORACLES["background_means"] = (
    f"SELECT (f - 1)::INTEGER AS feature_idx, {rnd('avg(x[f]::DOUBLE)')} AS mean FROM (SELECT *, unnest(range(1, 65)) AS f FROM "
    f"({split_sql('SELECT vec_id AS row_id, embedding AS x, label FROM embeddings')}) WHERE split = 'train') GROUP BY f"
)
_test = split_sql("SELECT o_orderkey AS row_id, o_totalprice, o_orderstatus AS label FROM orders")
ORACLES["select_instances"] = (
    "SELECT row_id, o_totalprice, label, position FROM (SELECT *, row_number() OVER (ORDER BY o, row_id) - 1 AS position "
    f"FROM ({_test}) WHERE split = 'test') WHERE position IN (0, 30, 77)"
)
_vec = (
    "SELECT '{c}' AS name, {lo} AS \"min\", {hi} AS \"max\", {mean} AS mean, count(v) AS n, NULL::BIGINT AS zeros, "
    "NULL::BIGINT AS ones FROM (SELECT {e} AS v FROM smp)"
)
ORACLES["vector_summary"] = (
    W + samples("lines", 8) + " " + " UNION ALL ".join(
        _vec.format(c=c, e=e, lo=rnd("min(v)"), hi=rnd("max(v)"), mean=rnd("avg(v)"))
        for c, e in (("x0", "unnest(x0)"), ("x", "unnest(x)"), ("pred", "pred"), ("weight", "weight"))
    )
    + f" UNION ALL SELECT 'z', {rnd('min(v)::DOUBLE')}, {rnd('max(v)::DOUBLE')}, {rnd('avg(v)')}, count(v), "
    "count(*) FILTER (WHERE v = 0), count(*) FILTER (WHERE v = 1) FROM (SELECT unnest(z) AS v FROM smp)"
)

# benchmark logs
_d, _b = "[128, 256, 512][user_id % 3 + 1]", "[32768, 65536, 131072][(user_id // 3) % 3 + 1]"
_tag = f"'D=' || {_d} || ' B=' || {_b}"
_v = {k: f"((n * {k}) // 1000 || '.' || lpad(((n * {k}) % 1000)::VARCHAR, 3, '0'))" for k in (1, 2, 4, 8)}
_times = f"'Timing (ms): gen ' || {_v[1]} || '  infer ' || {_v[2]} || '  weights ' || {_v[4]} || '  total ' || {_v[8]}"
LINES = (
    "lin AS MATERIALIZED (SELECT event_type || '.log' AS file, event_id AS seq, CASE event_id % 7 "
    f"WHEN 0 THEN {_tag} || ' run=' || (event_id % 6 + 1) || ' ' || {_times} "
    f"WHEN 1 THEN {_tag} WHEN 2 THEN {_times} WHEN 3 THEN {_tag} || ' ' || {_times} "
    f"WHEN 4 THEN {_tag} || ' CPU ' || {_times} WHEN 5 THEN '  CPU ' || {_times} || ' ' "
    f"ELSE 'Timing detail (ms): gen_init ' || {_v[1]} || '  perturb ' || {_v[1]} END AS line "
    "FROM (SELECT *, round(value)::BIGINT * 1000 + event_id % 1000 AS n FROM events))"
)
_TAG = r"D=(\d+)\s+B=(\d+)"
_BODY = r"Timing \(ms\):\s+gen\s+([\d.]+)\s+infer\s+([\d.]+)\s+weights\s+([\d.]+)\s+total\s+([\d.]+)"
_GPU, _CPU = rf"{_TAG}\s+{_BODY}", rf"{_TAG}\s+(?:CPU\s+)?{_BODY}"
STAGES = ("gen", "infer", "weights", "total")


def _tagged(kind):
    p = {"gpu": _GPU, "cpu": _CPU}[kind]
    cols = ", ".join(f"regexp_extract(line, '{p}', {i + 3})::DOUBLE AS {c}" for i, c in enumerate(STAGES))
    return (
        f"SELECT file, seq, regexp_extract(line, '{p}', 1)::INTEGER AS D, regexp_extract(line, '{p}', 2)::INTEGER AS B, {cols} "
        f"FROM lin WHERE regexp_matches(line, '{p}')"
    )


def _carried(source):
    cols = ", ".join(f"regexp_extract(line, '{_BODY}', {i + 1})::DOUBLE AS {c}" for i, c in enumerate(STAGES))
    tag = f"CASE WHEN regexp_matches(line, '{_TAG}') THEN regexp_extract(line, '{_TAG}', %d)::INTEGER END"
    over = "OVER (PARTITION BY file ORDER BY seq ROWS UNBOUNDED PRECEDING)"
    return (
        f"SELECT file, seq, line, last_value({tag % 1} IGNORE NULLS) {over} AS D, "
        f"last_value({tag % 2} IGNORE NULLS) {over} AS B FROM ({source})", cols,
    )


def _bare(kind):
    p = {"gpu": _GPU, "cpu": _CPU}[kind]
    rows, cols = _carried(f"SELECT * FROM lin WHERE NOT regexp_matches(line, '{p}')")
    return f"SELECT file, seq, D, B, {cols} FROM ({rows}) WHERE regexp_matches(line, '{_BODY}') AND D IS NOT NULL"


def _runs(kind):
    return f"{_tagged(kind)} UNION ALL {_bare(kind)}"


def _dropped(kind, n):
    return (
        f"SELECT file, seq, D, B, {', '.join(STAGES)} FROM (SELECT *, row_number() OVER (PARTITION BY D, B ORDER BY file, seq) AS rn, "
        f"count(*) OVER (PARTITION BY D, B) AS c FROM ({_runs(kind)})) WHERE rn > {n} OR c <= {n}"
    )


ORACLES["timing_tagged"] = (
    f"WITH {LINES} SELECT *, 'gpu' AS kind FROM ({_tagged('gpu')}) UNION ALL SELECT *, 'cpu' AS kind FROM ({_tagged('cpu')})"
)
ORACLES["timing_carry"] = f"WITH {LINES} {_bare('gpu')}"
ORACLES["timing_drop_first"] = f"WITH {LINES} {_dropped('gpu', 2)}"
ORACLES["timing_means"] = (
    f"WITH {LINES} SELECT D, B, {', '.join(rnd(f'avg({c})') + f' AS {c}' for c in STAGES)}, count(*) AS runs "
    f"FROM ({_dropped('cpu', 1)}) GROUP BY D, B"
)
_rows, _cols = _carried("SELECT * FROM lin")
_own = f"regexp_matches(line, '{_CPU}')"
COMBINED = (
    f"{LINES}, com AS MATERIALIZED (SELECT kind, D, B, {', '.join(f'arg_max({c}, (file, seq)) AS {c}' for c in STAGES)} FROM ("
    f"SELECT file, seq, CASE WHEN {_own} THEN regexp_extract(line, '{_TAG}', 1)::INTEGER ELSE D END AS D, "
    f"CASE WHEN {_own} THEN regexp_extract(line, '{_TAG}', 2)::INTEGER ELSE B END AS B, "
    f"CASE WHEN line LIKE '%CPU%' THEN 'cpu' ELSE 'gpu' END AS kind, {_cols} "
    f"FROM ({_rows}) WHERE regexp_matches(line, '{_BODY}') AND D IS NOT NULL) GROUP BY kind, D, B)"
)
ORACLES["timing_means_two"] = (
    f"WITH {LINES} SELECT D, B, {', '.join(rnd(f'avg({c})') + f' AS {c}' for c in STAGES)}, count(*) AS runs "
    f"FROM ({_dropped('gpu', 2)}) GROUP BY D, B"
)
ORACLES["timing_combined"] = f"WITH {COMBINED} SELECT * FROM com"


def _merge(gpu, cpu):
    side = ", ".join(f"g.{c} AS gpu_{c}" for c in STAGES) + ", " + ", ".join(f"c.{c} AS cpu_{c}" for c in STAGES)
    return (
        f"mrg AS (SELECT coalesce(g.D, c.D) AS D, coalesce(g.B, c.B) AS B, {side} FROM (SELECT * FROM com WHERE {gpu}) g "
        f"FULL OUTER JOIN (SELECT * FROM com WHERE {cpu}) c ON g.D = c.D AND g.B = c.B)"
    )


MERGED = f"WITH {COMBINED}, " + _merge("kind = 'gpu' AND D > 128", "kind = 'cpu' AND B < 131072")
ORACLES["timing_merge"] = f"{MERGED} SELECT * FROM mrg"
_by_b = ", ".join(
    f"round(max(cpu_total / nullif(gpu_total, 0)) FILTER (WHERE B = {b}), 6) + 0.0 AS b_{b}" for b in (32768, 65536, 131072)
)
ORACLES["speedup_matrix"] = (
    f"WITH {COMBINED}, " + _merge("kind = 'gpu'", "kind = 'cpu'") + f" SELECT D, {_by_b} FROM mrg GROUP BY D"
)
BOTH = f"WITH {COMBINED}, " + _merge("kind = 'gpu'", "kind = 'cpu'")
ORACLES["stage_breakdown"] = (
    f"{BOTH} SELECT D, B, 0 AS stage_no, 'Generation' AS stage, {rnd('gpu_gen')} AS value, 0.0::DOUBLE AS bottom FROM mrg "
    f"UNION ALL SELECT D, B, 1, 'Inference', {rnd('gpu_infer')}, {rnd('gpu_gen')} FROM mrg "
    f"UNION ALL SELECT D, B, 2, 'Weights', {rnd('gpu_weights')}, {rnd('gpu_gen + gpu_infer')} FROM mrg"
)
ORACLES["total_series"] = (
    f"{BOTH} SELECT D, 'gpu' AS device, B, gpu_total AS total FROM mrg WHERE gpu_total IS NOT NULL "
    "UNION ALL SELECT D, 'cpu', B, cpu_total FROM mrg WHERE cpu_total IS NOT NULL"
)
_grid = [(d, b, r) for d in (2, 4) for b in (16, 32) for r in (1, 2)]
ORACLES["sweep_grid"] = (
    W + ", ".join(explained("lines", b, take=d, seed=1234 + r, pre=f"g{i}_") for i, (d, b, r) in enumerate(_grid))
    + " " + " UNION ALL ".join(
        f"SELECT {d} AS D, {b} AS B, {r} AS run, {rnd('avg(r2)')} AS mean_r2, {rnd('avg(abs(surr_x0 - bb))')} AS mean_delta, "
        f"count(*) AS n FROM g{i}_fit"
        for i, (d, b, r) in enumerate(_grid)
    )
)
_made = "SELECT p_partkey, ['mean ', 'worst ', '', 'mean '][p_partkey % 4 + 1] || p_name || ['', ' error', ''][p_partkey % 3 + 1] AS feature FROM part"
ORACLES["display_names"] = (
    f"SELECT p_partkey, feature, {group_of('feature')} AS \"group\", {label_of('feature')} AS label FROM ({_made})"
)


# the trained black box
def divided(vector: str) -> str:
    """CTEs trn and tst (row_id, x, y): the first class against the rest."""
    table = f"SELECT vec_id AS row_id, {vector} AS x, (label = 0)::INTEGER AS label FROM embeddings"
    return (
        f"spl AS MATERIALIZED ({split_sql(table)}), trn AS (SELECT row_id, x, label AS y FROM spl WHERE split = 'train'), "
        "tst AS (SELECT row_id, x, label AS y FROM spl WHERE split = 'test')"
    )


_ALL, _FEW = "embedding::DOUBLE[]", "embedding[1:4]::DOUBLE[]"
_SCORE = "1 / (1 + exp(-((SELECT b[1] FROM tra) + list_inner_product({v}, (SELECT b[2:] FROM tra)))))"
INSTANCES["tested"] = (64, "SELECT row_id AS id, x AS x0 FROM tst")
INSTANCES["tested_few"] = (4, "SELECT row_id AS id, x AS x0 FROM tst")


def _means(d):
    return "SELECT " + _list(f"round(avg(x[{i}]), 9)" for i in range(1, d + 1)) + " AS m FROM trn"


ORACLES["trained_weights"] = (
    W + divided(_FEW) + ", " + trained(4) + ", " + trained(4, 0.01, pre="q_") + " " + " UNION ALL ".join(
        f"SELECT {c!r}::DOUBLE AS c, (f - 2)::INTEGER AS feature_idx, {rnd('b[f]')} AS weight FROM (SELECT *, unnest(range(1, 6)) AS f FROM {pre}tra)"
        for c, pre in ((1.0, ""), (0.01, "q_"))
    )
)
ORACLES["black_box_accuracy"] = (
    W + divided(_ALL) + ", " + trained(64) + " SELECT avg((((SELECT b[1] FROM tra) + list_inner_product(x, (SELECT b[2:] FROM tra)) > 0)"
    "::INTEGER = y)::INTEGER)::DOUBLE AS accuracy, count(*) AS n FROM tst"
)
ORACLES["explain_trained"] = (
    W + divided(_ALL) + ", " + trained(64) + ", " + explained("tested", 200, wide=True, pred=_SCORE, background=_means(64))
    + f" SELECT id AS instance_id, rank::INTEGER AS rank, idx::INTEGER AS feature_idx, 'feature_' || idx AS feature, {rnd('c')} AS coefficient "
    f"FROM ({ranked(d=64)}) WHERE rank <= 10"
)
_parts = [divided(_FEW), trained(4), samples("tested_few", 64, pred=_SCORE, background=_means(4)), standardized(4), system(4)]
for _tag, _solve in (("c_", solved), ("g_", descended), ("a_", adam)):
    _parts += [f"{_tag}{t} AS (SELECT * FROM {t})" for t in ("smp", "sta", "sys")]
    _parts += [_solve(4, pre=_tag), fitted(4, _tag, _tag == "a_"), ablated(4, 4, pre=_tag)]
_solvers = {"c_": "cholesky", "g_": "gd", "a_": "adam"}
_rows = []
for _tag, _name in _solvers.items():
    for _part, _value in (("r2", "r2"), ("delta", "abs(surr_x0 - bb)"), ("pass", "(abs(surr_x0 - bb) < 0.001)::INTEGER::DOUBLE")):
        _rows.append(f"SELECT id AS instance_id, '{_part}' AS part, '{_name}' AS subject, NULL::INTEGER AS k, {rnd(_value)} AS value FROM {_tag}fit")
    _rows.append(f"SELECT id, 'wmae', '{_name}', k::INTEGER, {rnd('wmae')} FROM {_tag}abl")
for _p, _q in (("c_", "g_"), ("c_", "a_"), ("g_", "a_")):
    _two = pair(f"{_p}fit", f"{_q}fit", 4, 2, _solvers[_p], _solvers[_q])
    for _part in ("cosine", "spearman", "overlap"):
        _rows.append(f"SELECT instance_id, '{_part}', source_a || '-' || source_b, NULL::INTEGER, {_part} FROM ({_two})")
ORACLES["evaluate_trained"] = W + ", ".join(_parts) + " " + " UNION ALL ".join(_rows)

# wide second pass, black boxes on arrays
ORACLES["weighted_r2_wide"] = (
    W + explained("embeddings", 200, wide=True) + f" SELECT id AS instance_id, {rnd('r2')} AS r2, {rnd('sw')} AS sum_weights FROM fit"
)
ORACLES["ablation_wide"] = (
    W + explained("embeddings", 200, wide=True) + ", " + ablated(64, 20, intercept=True)
    + f" SELECT id AS instance_id, k::INTEGER AS k, {rnd('wmae')} AS wmae FROM abl"
)
_hidden = [
    "tanh(list_inner_product({v}, " + _list(f"{((i * (j + 2)) % 7 - 3) / 20!r}::DOUBLE" for i in range(64)) + f") + {0.1 * j!r})" for j in range(3)
]
ORACLES["explain_batch_network"] = (
    W + explained("embeddings", 200, wide=True, pred=f"1 / (1 + exp(-({_hidden[0]} - 0.5 * {_hidden[1]} + 0.25 * {_hidden[2]})))")
    + coefficients(64, "cholesky")
)
_tags = {"seed 1234": ("p_", 1234), "seed 42": ("q_", 42), "seed 7": ("r_", 7)}
ORACLES["compare_seeds_wide"] = (
    W + ", ".join(explained("embeddings", 200, wide=True, seed=seed, pre=pre) for pre, seed in _tags.values()) + " " + " UNION ALL ".join(
        pair(f"{_tags[a][0]}fit", f"{_tags[b][0]}fit", 64, 10, a, b)
        for a, b in (("seed 1234", "seed 42"), ("seed 1234", "seed 7"), ("seed 42", "seed 7"))
    )
)

# stored scores, equal features, the values of a grid
ORACLES["fit_stored"] = (
    W + samples("parts", 32, pre="raw_") + ", smp AS MATERIALIZED (SELECT * REPLACE (round(pred, 4) AS pred, round(weight, 4) AS weight) FROM raw_smp), "
    + ", ".join([standardized(2), system(2), solved(2), fitted(2)]) + coefficients(2, "cholesky")
)
_at = "1 / (1 + exp(-(-1.0::DOUBLE + 0.02::DOUBLE * {v}[1] + 0.04::DOUBLE * {v}[1])))"
_low = "sqrt(greatest({}, 0.01::DOUBLE))".format
ORACLES["fit_singular"] = (
    W + samples("parts", 32, pre="raw_") + ", smp AS MATERIALIZED (SELECT id, s, z, [x0[1], x0[1]] AS x0, [x[1], x[1]] AS x, "
    f"{_at.format(v='x')} AS pred, {_at.format(v='x0')} AS bb, exp(-2 * (x[1] - x0[1]) * (x[1] - x0[1])) AS weight FROM raw_smp), "
    + standardized(2) + ", " + system(2)
    + f", l1 AS (SELECT *, {_low('a[1][1]')} AS p, a[2][1] / {_low('a[1][1]')} AS q, a[3][1] / {_low('a[1][1]')} AS r FROM sys), "
    f"l2 AS (SELECT *, {_low('a[2][2] - q * q')} AS t, (a[3][2] - r * q) / {_low('a[2][2] - q * q')} AS u FROM l1), "
    f"l3 AS (SELECT *, {_low('a[3][3] - r * r - u * u')} AS v, b[1] / p AS y1 FROM l2), "
    "f2 AS (SELECT *, (b[2] - q * y1) / t AS y2 FROM l3), f3 AS (SELECT *, (b[3] - r * y1 - u * y2) / v AS y3 FROM f2), "
    "g3 AS (SELECT *, y3 / v AS e3 FROM f3), g2 AS (SELECT *, (y2 - u * e3) / t AS e2 FROM g3), "
    "bet AS (SELECT id, [(y1 - q * e2 - r * e3) / p, e2, e3] AS beta FROM g2), " + fitted(2) + coefficients(2, "cholesky")
)
ORACLES["timing_grid"] = MERGED + " SELECT " + ", ".join(
    f"(SELECT string_agg(v::VARCHAR, ',' ORDER BY v) FROM (SELECT DISTINCT {c} AS v FROM mrg)) AS {c.lower()}_values" for c in "DB"
)
