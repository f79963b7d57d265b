"""DuckDB SQL of least squares with any number of regressors, for oracles.

Regressors are made orthogonal one after the other (each less its means and
its projections on those before), the response is projected on them, and the
coefficients follow by back substitution.  ``ols`` gives the common table
expressions up to ``fit``, one row: ``n, my, rss, tss, s2, b0, b1 ... bk,
m1 ... mk`` (means) and ``c_i_j`` (inverse of the centred cross products).
"""

from __future__ import annotations


def ols(source: str, regressors: list[str], response: str = "y") -> str:
    k = len(regressors)
    ks = range(1, k + 1)
    ctes = [f"o0 AS (SELECT CAST({response} AS DOUBLE) AS oy, "
            + ", ".join(f"CAST({x} AS DOUBLE) AS x{j}" for j, x in enumerate(regressors, 1)) + f" FROM {source} AS src)"]
    for j in ks:
        less = "".join(f" - z{i} * (sum(x{j} * z{i}) OVER () / sum(z{i} * z{i}) OVER ())" for i in range(1, j))
        ctes.append(f"o{j} AS (SELECT *, x{j} - avg(x{j}) OVER (){less} AS z{j} FROM o{j - 1})")
    sums = ["count(*) AS n", "avg(oy) AS my", "var_samp(oy) * (count(*) - 1) AS tss"]
    sums += [f"avg(x{j}) AS m{j}, sum(z{j} * z{j}) AS ss{j}, sum(oy * z{j}) / sum(z{j} * z{j}) AS g{j}" for j in ks]
    sums += [f"sum(x{j} * z{i}) / sum(z{i} * z{i}) AS r_{i}_{j}" for j in ks for i in range(1, j)]
    ctes.append(f"osum AS (SELECT {', '.join(sums)} FROM o{k})")
    # inverse of the unit triangular matrix, diagonal by diagonal
    last = "osum"
    for step in range(1, k):
        cells = []
        for i in range(1, k - step + 1):
            j = i + step
            terms = [f"r_{i}_{j}"] + [f"v_{i}_{m} * r_{m}_{j}" for m in range(i + 1, j)]
            cells.append(f"-({' + '.join(terms)}) AS v_{i}_{j}")
        ctes.append(f"ov{step} AS (SELECT *, {', '.join(cells)} FROM {last})")
        last = f"ov{step}"

    def v(i: int, j: int) -> str:
        return "1.0" if i == j else f"v_{i}_{j}"

    betas = [f"{' + '.join(f'{v(j, m)} * g{m}' for m in range(j, k + 1))} AS b{j}" for j in ks]
    inverse = [f"{' + '.join(f'{v(i, m)} * {v(j, m)} / ss{m}' for m in range(j, k + 1))} AS c_{i}_{j}"
               for i in ks for j in range(i, k + 1)]
    explained = " + ".join(f"g{j} * g{j} * ss{j}" for j in ks)
    ctes.append(f"ofit AS (SELECT *, {', '.join(betas + inverse)}, tss - ({explained}) AS rss FROM {last})")
    intercept = "my" + "".join(f" - b{j} * m{j}" for j in ks)
    ctes.append(f"fit AS (SELECT *, {intercept} AS b0, rss / (n - {k + 1}) AS s2 FROM ofit)")
    return "WITH " + ",\n".join(ctes)


def c(i: int, j: int) -> str:
    return f"c_{min(i, j)}_{max(i, j)}"


def variance_of_intercept(k: int) -> str:
    """Over ``s2``: 1/n + m' C m."""
    return "1.0 / n + " + " + ".join(f"m{i} * m{j} * {c(i, j)}" for i in range(1, k + 1) for j in range(1, k + 1))


def coefficient_rows(names: list[str], first: int = 0) -> str:
    """``term, estimate, std_error, t_value`` of the coefficients from place ``first`` (0: intercept)."""
    rows = []
    for j in range(first, len(names) + 1):
        name = names[j - 1] if j else "(Intercept)"
        var = c(j, j) if j else f"({variance_of_intercept(len(names))})"
        rows.append(f"SELECT '{name}' AS term, b{j} AS estimate, sqrt(s2 * {var}) AS std_error, "
                    f"b{j} / sqrt(s2 * {var}) AS t_value FROM fit")
    return " UNION ALL ".join(rows)


def statistics(k: int) -> str:
    """R2, adjusted R2, AIC and BIC of ``fit`` with ``k`` regressors."""
    return (f"1 - rss / tss AS r2, 1 - (rss / tss) * (n - 1) / (n - 1 - {k}) AS adj_r2, "
            f"n * (ln(2 * pi()) + ln(rss / n) + 1) + 2 * ({k} + 2) AS aic, "
            f"n * (ln(2 * pi()) + ln(rss / n) + 1) + ln(n) * ({k} + 2) AS bic")
