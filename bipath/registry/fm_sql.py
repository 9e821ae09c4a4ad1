"""DuckDB SQL of the factorization machine: the same first weights, the same steps, unrolled, and what is ranked by them."""

from __future__ import annotations

import itertools

K = 2  # factors
TOL = 1e-6  # relative change of the training loss at which a run of many steps stops
NAMES = ["w", *(f"v{f}" for f in range(K))]


def _uniform(seed: int, salt: str, f: int) -> str:
    return f"((('0x' || substr(md5('{seed}/{salt}/' || feature || '/{f}'), 1, 10))::BIGINT::DOUBLE + 1) / 1099511627777.0)"


def _normal(seed: int, f: int) -> str:
    return f"sqrt(-2 * ln({_uniform(seed, 'radius', f)})) * cos(2 * pi() * {_uniform(seed, 'angle', f)})"


def _start(runs: list[dict], seed: int) -> list[tuple[str, str]]:
    """(name, text) of the tables from the cells to the first weights, ``trained0``."""
    points = " UNION ALL ".join(
        f"SELECT {i} AS run, {r['fold']} AS held, {r['regParam']}::DOUBLE AS reg, {r['initStd']}::DOUBLE AS std" for i, r in enumerate(runs)
    )
    return [
        ("runs", points),
        ("near", "SELECT proteinAId, row_number() OVER (ORDER BY proteinAId) - 1 AS feature FROM (SELECT DISTINCT proteinAId FROM strong)"),
        ("aims", "SELECT proteinId, row_number() OVER (ORDER BY proteinId) - 1 + (SELECT count(*) FROM near) AS feature FROM (SELECT DISTINCT proteinId FROM dti)"),
        ("cells", """
            SELECT 'p' AS kind, proteinBId AS id, feature, score / (SELECT sum(score) / count(DISTINCT proteinBId) FROM strong) AS x
            FROM strong JOIN near USING (proteinAId)
            UNION ALL SELECT 'd', drugId, feature, 1.0::DOUBLE / (SELECT count(*) / count(DISTINCT drugId) FROM dti) FROM dti JOIN aims USING (proteinId)
            UNION ALL SELECT DISTINCT 'd', drugId, -1, 1.0 FROM dti"""),
        ("learned", """
            SELECT a.*, r.run FROM rows_of a JOIN runs r ON a.fold <> r.held
            WHERE EXISTS (SELECT 1 FROM cells c WHERE c.kind = 'd' AND c.id = a.drugId)
              AND EXISTS (SELECT 1 FROM cells c WHERE c.kind = 'p' AND c.id = a.proteinId)"""),
        ("sizes", "SELECT run, count(*) AS n, avg(amount_interactions) AS mean FROM learned GROUP BY run"),
        ("trained0", f"""
            SELECT feature, r.run, CASE WHEN feature = -1 THEN coalesce(mean, 0.0) ELSE 0.0 END AS w,
              {", ".join(f"CASE WHEN feature = -1 THEN 0.0 ELSE {_normal(seed, f)} * std END AS v{f}" for f in range(K))},
              {", ".join(f"0.0::DOUBLE AS {m}_{c}" for m in "ms" for c in NAMES)}
            FROM (SELECT unnest(range(-1, (SELECT count(*) FROM near) + (SELECT count(*) FROM aims))) AS feature) f, runs r
            LEFT JOIN sizes z ON z.run = r.run"""),
    ]


def _steps(runs: list[dict], seed: int, step: float) -> list[tuple[str, str]]:
    """(name, text) of the tables from the cells to the weights after the last step, ``trained``."""
    tables = _start(runs, seed)
    last = max(r["maxIter"] for r in runs)
    for t in range(1, last + 1):
        before = f"trained{t - 1}"
        tables.append((f"side{t}", _sides(before)))
        half = " + ".join(f"power(d.a{f} + p.a{f}, 2) - d.q{f} - p.q{f}" for f in range(K))
        tables.append((f"off{t}", f"""
            SELECT a.drugId, a.proteinId, a.run, {", ".join(f"d.a{f} + p.a{f} AS t{f}" for f in range(K))},
              2 * (d.lin + p.lin + ({half}) / 2 - a.amount_interactions) AS e
            FROM learned a JOIN side{t} d ON d.kind = 'd' AND d.id = a.drugId AND d.run = a.run
            JOIN side{t} p ON p.kind = 'p' AND p.id = a.proteinId AND p.run = a.run"""))
        sums = ", ".join(["sum(e) AS e", *(f"sum(e * t{f}) AS e{f}" for f in range(K))])
        tables.append((f"sum{t}", f"""
            SELECT 'd' AS kind, drugId AS id, run, {sums} FROM off{t} GROUP BY drugId, run
            UNION ALL SELECT 'p', proteinId, run, {sums} FROM off{t} GROUP BY proteinId, run"""))
        tables.append((f"slope{t}", f"""
            SELECT c.feature, s.run, sum(x * e) AS gw, sum(x * x * e) AS gq, {", ".join(f"sum(x * e{f}) AS g{f}" for f in range(K))}
            FROM cells c JOIN sum{t} s ON s.kind = c.kind AND s.id = c.id GROUP BY c.feature, s.run"""))
        columns, moments = [], []
        for name in NAMES:
            total = "gw" if name == "w" else f"g{name[1:]} - o.{name} * gq"
            g = f"(coalesce({total}, 0.0) / z.n)"
            m, s = f"(0.9 * m_{name} + (1 - 0.9::DOUBLE) * {g})", f"(0.999 * s_{name} + (1 - 0.999::DOUBLE) * {g} * {g})"
            move = f"({m} / (1 - power(0.9::DOUBLE, {t}))) / (sqrt({s} / (1 - power(0.999::DOUBLE, {t}))) + 1e-8)"
            new = f"o.{name} - {step} * {move} - reg * o.{name}"
            columns.append(f"{new if name == 'w' else f'CASE WHEN o.feature = -1 THEN o.{name} ELSE {new} END'} AS {name}")
            moments += [f"{m} AS m_{name}", f"{s} AS s_{name}"]
        tables.append((f"trained{t}", f"""
            SELECT o.feature, o.run, {", ".join([*columns, *moments])}
            FROM {before} o JOIN runs r ON r.run = o.run JOIN sizes z ON z.run = o.run
            LEFT JOIN slope{t} g ON g.feature = o.feature AND g.run = o.run"""))
    tables.append(("sides", _sides(f"trained{last}")))
    return tables


def _until_settled(runs: list[dict], seed: int, step: float, tol: float = TOL) -> list[tuple[str, str]]:
    """The tables of :func:`_steps` for many steps: ``trained`` is recursive and keeps the last weights of a feature and run. A run
    makes no more rows after its maxIter steps, or before where its training loss changes by no more than ``tol`` of itself."""
    most = " ".join(f"WHEN {i} THEN {r['maxIter']}" for i, r in enumerate(runs))
    half = " + ".join(f"power(d.a{f} + p.a{f}, 2) - d.q{f} - p.q{f}" for f in range(K))
    sums = ", ".join(["sum(e) AS e", *(f"sum(e * t{f}) AS e{f}" for f in range(K))])
    columns, moments = [], []
    for name in NAMES:
        total = "gw" if name == "w" else f"g{name[1:]} - o.{name} * gq"
        g = f"(coalesce({total}, 0.0) / z.n)"
        m, s = f"(0.9 * m_{name} + (1 - 0.9::DOUBLE) * {g})", f"(0.999 * s_{name} + (1 - 0.999::DOUBLE) * {g} * {g})"
        move = f"({m} / (1 - power(0.9::DOUBLE, o.step + 1))) / (sqrt({s} / (1 - power(0.999::DOUBLE, o.step + 1))) + 1e-8)"
        new = f"o.{name} - {step} * {move} - reg * o.{name}"
        columns.append(f"{new if name == 'w' else f'CASE WHEN o.feature = -1 THEN o.{name} ELSE {new} END'} AS {name}")
        moments += [f"{m} AS m_{name}", f"{s} AS s_{name}"]
    states = ", ".join([*NAMES, *(f"{m}_{c}" for c in NAMES for m in "ms")])
    recursive = f"""
        SELECT feature, run, 0 AS step, NULL::DOUBLE AS loss, {states} FROM trained0
        UNION
        (WITH side AS MATERIALIZED ({_sides("trained")}),
        off AS MATERIALIZED (
            SELECT a.drugId, a.proteinId, a.run, {", ".join(f"d.a{f} + p.a{f} AS t{f}" for f in range(K))},
              2 * (d.lin + p.lin + ({half}) / 2 - a.amount_interactions) AS e
            FROM learned a JOIN side d ON d.kind = 'd' AND d.id = a.drugId AND d.run = a.run
            JOIN side p ON p.kind = 'p' AND p.id = a.proteinId AND p.run = a.run),
        sums AS MATERIALIZED (
            SELECT 'd' AS kind, drugId AS id, run, {sums} FROM off GROUP BY drugId, run
            UNION ALL SELECT 'p', proteinId, run, {sums} FROM off GROUP BY proteinId, run),
        slope AS MATERIALIZED (
            SELECT c.feature, s.run, sum(x * e) AS gw, sum(x * x * e) AS gq, {", ".join(f"sum(x * e{f}) AS g{f}" for f in range(K))}
            FROM cells c JOIN sums s ON s.kind = c.kind AND s.id = c.id GROUP BY c.feature, s.run),
        losses AS MATERIALIZED (SELECT run, sum(e * e) / 4 AS loss FROM off GROUP BY run)
        SELECT o.feature, o.run, o.step + 1, l.loss, {", ".join([*columns, *moments])}
        FROM trained o JOIN runs r ON r.run = o.run JOIN sizes z ON z.run = o.run JOIN losses l ON l.run = o.run
        LEFT JOIN slope g ON g.feature = o.feature AND g.run = o.run
        WHERE o.step < CASE o.run {most} END AND (o.loss IS NULL OR abs(o.loss - l.loss) > {tol} * abs(o.loss)))"""
    return [*_start(runs, seed), ("trained", recursive), ("sides", _sides("trained"))]


def _sides(weights: str) -> str:
    sums = ", ".join(f"sum(v{f} * x) AS a{f}, sum(v{f} * x * v{f} * x) AS q{f}" for f in range(K))
    return f"SELECT c.kind, c.id, w.run, sum(w.w * x) AS lin, {sums} FROM cells c JOIN {weights} w ON w.feature = c.feature GROUP BY c.kind, c.id, w.run"


def _prediction(drug: str = "d", protein: str = "p") -> str:
    half = " + ".join(f"power({drug}.a{f} + {protein}.a{f}, 2) - {drug}.q{f} - {protein}.q{f}" for f in range(K))
    return f"({drug}.lin + {protein}.lin + ({half}) / 2)"


def _errors() -> list[tuple[str, str]]:
    """Tables of the errors of each run on the rows it learned from and on those it leaves out."""
    return [
        ("scored", f"""
            SELECT r.run, a.fold = r.held AS out, a.amount_interactions::DOUBLE AS y, {_prediction()} AS prediction
            FROM rows_of a CROSS JOIN runs r
            JOIN sides d ON d.kind = 'd' AND d.id = a.drugId AND d.run = r.run
            JOIN sides p ON p.kind = 'p' AND p.id = a.proteinId AND p.run = r.run"""),
        ("errors", """
            SELECT run, sqrt(avg(power(prediction - y, 2)) FILTER (out)) AS rmse, sqrt(avg(power(prediction - y, 2)) FILTER (NOT out)) AS train_rmse,
              sqrt(avg(y * y) FILTER (out) - 2 * (avg(y) FILTER (NOT out)) * (avg(y) FILTER (out)) + power(avg(y) FILTER (NOT out), 2)) AS mean_rmse
            FROM scored GROUP BY run"""),
    ]


def _metrics(points: list[dict]) -> str:
    listed = " UNION ALL ".join(
        f"SELECT {i} AS grid_id, " + ", ".join(f"{v}::DOUBLE AS \"{k}\"" for k, v in p.items()) for i, p in enumerate(points)
    )
    names = ", ".join(f'"{k}"' for k in points[0])
    return f"""
        SELECT grid_id, {names}, round(rmse, 6) AS rmse, grid_id = (SELECT arg_min(grid_id, (rmse, grid_id)) FROM by_point) AS best,
          round(train_rmse, 6) AS train_rmse, round(mean_rmse, 6) AS mean_rmse, rmse < mean_rmse AS beats_mean
        FROM ({listed}) JOIN by_point USING (grid_id)"""


def _joined(base: list[tuple[str, str]], body: str, with_views) -> str:
    """``body`` behind the views of the network and the materialized tables ``base``."""
    recursive = any(_refers(name, text) for name, text in base)

    def table(name, text):
        return f"{name} USING KEY (feature, run) AS ({text})" if _refers(name, text) else f"{name} AS MATERIALIZED ({text})"

    inner = ",\n".join(table(name, text) for name, text in base)
    marked = with_views("\n".join(text for _, text in base))
    views = marked[len("WITH ") : marked.index("\n" + base[0][1])]
    return f"WITH {'RECURSIVE ' if recursive else ''}{views},\n{inner}\n{body}"


def _refers(name: str, text: str) -> bool:
    return f"FROM {name} " in text


def oracles(grid: dict[str, list], whole: dict[str, list], seed: int, step: float, folds: int, drug: str, seeds: list[str], with_views) -> dict[str, str]:
    """The SQL of each query on a factorization machine; ``with_views`` puts the network's views before a statement. ``whole`` is the
    grid of the queries that train until the loss settles."""
    points, long = ([dict(zip(g, values)) for values in itertools.product(*g.values())] for g in (grid, whole))
    if any(p["factorSize"] != K for p in [*points, *long]):
        raise ValueError(f"the SQL has {K} factors")
    rows_of = ("rows_of", "SELECT *, CASE WHEN split = 'test' THEN 0 ELSE 1 END AS fold FROM split_rows")
    by_point = ("by_point", "SELECT run AS grid_id, rmse, train_rmse, mean_rmse FROM errors")
    once = [rows_of, *_steps([{**p, "fold": 0} for p in points], seed, step), *_errors(), by_point]
    settled = [rows_of, *_until_settled([{**p, "fold": 0} for p in long], seed, step), *_errors(), by_point]
    bucket = f"('0x' || substr(md5(drugId || '|' || proteinId || '|{seed}'), 1, 8))::BIGINT"
    runs = [{**p, "fold": fold} for p in long for fold in (-1, *range(folds))]
    many = [("rows_of", f"SELECT *, {bucket} % {folds} AS fold FROM amount"), *_until_settled(runs, seed, step), *_errors()]
    many += [("by_point", f"""
        SELECT run // {folds + 1} AS grid_id, avg(rmse) AS rmse, avg(train_rmse) AS train_rmse, avg(mean_rmse) AS mean_rmse
        FROM errors WHERE run % {folds + 1} > 0 GROUP BY run // {folds + 1}""")]
    best = [
        ("chosen", "SELECT arg_min(grid_id, (rmse, grid_id)) AS run FROM by_point"),
        ("predictions", f"""
            SELECT d.id AS drugId, p.id AS proteinId, round({_prediction()}, 9) AS prediction
            FROM sides d JOIN sides p ON d.run = p.run AND d.kind = 'd' AND p.kind = 'p' WHERE d.run = (SELECT run FROM chosen)"""),
    ]

    def ranked(where: str = "true") -> str:
        return f"""
            SELECT drugId, proteinId, round(prediction, 6) AS prediction, rank FROM (
              SELECT *, rank() OVER (PARTITION BY drugId ORDER BY prediction DESC)::INTEGER AS rank FROM predictions WHERE {where})
            WHERE rank <= 10"""

    listed = ", ".join(f"'{s}'" for s in seeds)
    return {
        "fm_fit_grid": _joined(settled, _metrics(long), with_views),
        "fm_cross_validate": _joined(many, _metrics(long), with_views),
        "fm_rank_all": _joined([*once, *best], ranked(), with_views),
        "fm_rank_one_drug": _joined([*once, *best], ranked(f"drugId = '{drug}'"), with_views),
        "rank_specific_pairs": _joined([*settled, *best], ranked(f"drugId = '{drug}' AND proteinId IN ({listed})"), with_views),
    }
