"""SQL of the two-state recursions, to hold the Spark results against. ``obs``: chrom, bin, e0, e1 (densities)."""

from __future__ import annotations


def forward(obs: str, name: str, start: tuple, a: tuple) -> str:
    """``name``: chrom, bin, a0, a1, s (scale), l (log-likelihood up to here). start and a are SQL expressions."""
    (p0, p1), ((a00, a01), (a10, a11)) = start, a
    return f"""{name} AS (
  SELECT chrom, bin, {p0}*e0/({p0}*e0+{p1}*e1) AS a0, {p1}*e1/({p0}*e0+{p1}*e1) AS a1, {p0}*e0+{p1}*e1 AS s, ln({p0}*e0+{p1}*e1) AS l FROM {obs} WHERE bin = 0
  UNION ALL
  SELECT chrom, bin, x0/(x0+x1), x1/(x0+x1), x0+x1, l+ln(x0+x1) FROM (
    SELECT o.chrom, o.bin, (f.a0*{a00}+f.a1*{a10})*o.e0 AS x0, (f.a0*{a01}+f.a1*{a11})*o.e1 AS x1, f.l FROM {name} f JOIN {obs} o ON o.chrom = f.chrom AND o.bin = f.bin + 1))"""


def backward(obs: str, fwd: str, name: str, a: tuple, last: int = 719) -> str:
    """``name``: chrom, bin, b0, b1, scaled by the forward scales."""
    (a00, a01), (a10, a11) = a
    return f"""{name} AS (
  SELECT chrom, bin, 1.0::DOUBLE AS b0, 1.0::DOUBLE AS b1 FROM {obs} WHERE bin = {last}
  UNION ALL
  SELECT p.chrom, p.bin - 1, ({a00}*o.e0*p.b0+{a01}*o.e1*p.b1)/f.s, ({a10}*o.e0*p.b0+{a11}*o.e1*p.b1)/f.s
  FROM {name} p JOIN {obs} o ON o.chrom = p.chrom AND o.bin = p.bin JOIN {fwd} f ON f.chrom = p.chrom AND f.bin = p.bin WHERE p.bin > 0)"""


def viterbi(obs: str, start: tuple, a: tuple, end: tuple, last: int = 719) -> str:
    """CTEs ``v`` and ``path`` (chrom, bin, state); of equal scores the lower state."""
    (p0, p1), ((a00, a01), (a10, a11)), (z0, z1) = start, a, end
    return f"""v AS (
  SELECT chrom, bin, ln({p0})+ln(e0) AS v0, ln({p1})+ln(e1) AS v1, 0 AS k0, 0 AS k1 FROM {obs} WHERE bin = 0
  UNION ALL
  SELECT o.chrom, o.bin, greatest(v0+ln({a00}), v1+ln({a10}))+ln(o.e0), greatest(v0+ln({a01}), v1+ln({a11}))+ln(o.e1),
    CASE WHEN v0+ln({a00}) >= v1+ln({a10}) THEN 0 ELSE 1 END, CASE WHEN v0+ln({a01}) >= v1+ln({a11}) THEN 0 ELSE 1 END
  FROM v JOIN {obs} o ON o.chrom = v.chrom AND o.bin = v.bin + 1
), path AS (
  SELECT chrom, bin, CASE WHEN v0+ln({z0}) >= v1+ln({z1}) THEN 0 ELSE 1 END AS state FROM v WHERE bin = {last}
  UNION ALL
  SELECT v.chrom, v.bin - 1, CASE WHEN path.state = 0 THEN v.k0 ELSE v.k1 END FROM path JOIN v ON v.chrom = path.chrom AND v.bin = path.bin WHERE path.bin > 0)"""


def em(obs_of, sym: str, rounds: int, start: tuple, a: tuple, emission: tuple[str, list[str]], model_of, least: float = 0.0) -> str:
    """CTEs of Baum-Welch: mN with the model after N rounds, one row; obs_of(N) gives the densities under it.

    emission: columns and values of the first model; model_of: SQL expressions of the next emission from ``g`` (g0, g1 and the observation).
    """
    names, values = emission
    flat = [*start, *a[0], *a[1]]
    ctes = [f"m0 AS (SELECT {', '.join(f'{x}::DOUBLE AS {n}' for x, n in zip(flat, ('p0', 'p1', 'a00', 'a01', 'a10', 'a11'), strict=True))}, {', '.join(f'{v}::DOUBLE AS {c}' for c, v in zip(names, values, strict=True))})"]
    for i in range(rounds):
        ctes.append(f"o{i} AS MATERIALIZED (SELECT s.chrom, s.bin, s.x, {obs_of('s.x', 'm')}, m.p0, m.p1, m.a00, m.a01, m.a10, m.a11 FROM {sym} s, m{i} m)")
        ctes.append(_forward_rows(i))
        ctes.append(_backward_rows(i))
        ctes.append(f"""g{i} AS MATERIALIZED (SELECT f.chrom, f.bin, o.x, f.a0*b.b0/(f.a0*b.b0+f.a1*b.b1) AS g0, f.a1*b.b1/(f.a0*b.b0+f.a1*b.b1) AS g1, f.l
  FROM f{i} f JOIN b{i} b ON f.chrom = b.chrom AND f.bin = b.bin JOIN o{i} o ON o.chrom = f.chrom AND o.bin = f.bin)""")
        ctes.append(f"""x{i} AS (SELECT sum(q00/(q00+q01+q10+q11)) AS n00, sum(q01/(q00+q01+q10+q11)) AS n01, sum(q10/(q00+q01+q10+q11)) AS n10, sum(q11/(q00+q01+q10+q11)) AS n11 FROM (
  SELECT f.a0*o.a00*o.e0*b.b0 AS q00, f.a0*o.a01*o.e1*b.b1 AS q01, f.a1*o.a10*o.e0*b.b0 AS q10, f.a1*o.a11*o.e1*b.b1 AS q11
  FROM f{i} f JOIN o{i} o ON o.chrom = f.chrom AND o.bin = f.bin + 1 JOIN b{i} b ON b.chrom = o.chrom AND b.bin = o.bin))""")
        ctes.append(f"""m{i + 1} AS MATERIALIZED (SELECT r.p0, r.p1, greatest(n00/(n00+n01), {least}) AS a00, least(n01/(n00+n01), {1 - least}) AS a01, least(n10/(n10+n11), {1 - least}) AS a10, greatest(n11/(n10+n11), {least}) AS a11, {', '.join(f'h.{c}' for c in names)}
  FROM x{i}, (SELECT avg(g0) AS p0, avg(g1) AS p1 FROM g{i} WHERE bin = 0) r, (SELECT {', '.join(f'{x} AS {c}' for x, c in zip(model_of, names, strict=True))} FROM g{i}, m{i} m) h)""")
    return ",\n".join(ctes)


def _forward_rows(i: int) -> str:
    return f"""f{i} AS (
  SELECT chrom, bin, p0*e0/(p0*e0+p1*e1) AS a0, p1*e1/(p0*e0+p1*e1) AS a1, p0*e0+p1*e1 AS s, ln(p0*e0+p1*e1) AS l FROM o{i} WHERE bin = 0
  UNION ALL
  SELECT chrom, bin, x0/(x0+x1), x1/(x0+x1), x0+x1, l+ln(x0+x1) FROM (
    SELECT o.chrom, o.bin, (f.a0*o.a00+f.a1*o.a10)*o.e0 AS x0, (f.a0*o.a01+f.a1*o.a11)*o.e1 AS x1, f.l FROM f{i} f JOIN o{i} o ON o.chrom = f.chrom AND o.bin = f.bin + 1))"""


def _backward_rows(i: int) -> str:
    return f"""b{i} AS (
  SELECT chrom, bin, 1.0::DOUBLE AS b0, 1.0::DOUBLE AS b1 FROM o{i} WHERE (chrom, bin) IN (SELECT (chrom, max(bin)) FROM o{i} GROUP BY chrom)
  UNION ALL
  SELECT p.chrom, p.bin - 1, (o.a00*o.e0*p.b0+o.a01*o.e1*p.b1)/f.s, (o.a10*o.e0*p.b0+o.a11*o.e1*p.b1)/f.s
  FROM b{i} p JOIN o{i} o ON o.chrom = p.chrom AND o.bin = p.bin JOIN f{i} f ON f.chrom = p.chrom AND f.bin = p.bin WHERE p.bin > 0)"""


def _node(m: float, d: float) -> str:
    """Log density of a node's detail, floored."""
    return f"greatest(-((l.detail - {m}) ** 2) / (2 * {d} * {d}) - ln({d} * sqrt(2 * pi())), ln(1e-300))"


def _up(top: int, model, join: str) -> list[str]:
    """CTEs u1 to uTOP (chrom, idx, v0, v1): what the nodes of a tree over l1 to lTOP have gathered. join: an SQL function of x and y."""
    at = lambda level: [_node(m, s) for m, s in zip(*(model.levels or {}).get(level, (model.means, model.deviations)), strict=True)]
    d = at(1)
    ctes = [f"u1 AS MATERIALIZED (SELECT l.chrom, l.idx, {d[0]} AS v0, {d[1]} AS v1 FROM l1 l)"]
    for i in range(2, top + 1):
        d = at(i)
        said = ", ".join(f"sum({join.format(x=f'(ln({a}) + v0)', y=f'(ln({b}) + v1)')}) AS s{s}" for s, (a, b) in enumerate(model.transition))
        ctes.append(f"u{i} AS MATERIALIZED (SELECT l.chrom, l.idx, {d[0]} + t.s0 AS v0, {d[1]} + t.s1 AS v1 FROM l{i} l JOIN (SELECT chrom, idx // 2 AS idx, {said} FROM u{i - 1} GROUP BY ALL) t ON t.chrom = l.chrom AND t.idx = l.idx)")
    return ctes


def tree_posterior(top: int, model) -> str:
    """CTEs g1 to gTOP: chrom, idx, g0, g1."""
    ctes = _up(top, model, "(greatest({x}, {y}) + ln(1 + exp(-abs({x} - {y}))))")
    (a00, a01), (a10, a11) = model.transition
    odds = f"exp(v1 - v0 + ln({model.root[1]}) - ln({model.root[0]}))"
    ctes.append(f"g{top} AS MATERIALIZED (SELECT chrom, idx, 1 / (1 + {odds}) AS g0, CASE WHEN isinf({odds}) THEN 1 ELSE {odds} / (1 + {odds}) END AS g1 FROM u{top})")
    for i in range(top - 1, 0, -1):
        e0, e1 = "exp(u.v0 - greatest(u.v0, u.v1))", "exp(u.v1 - greatest(u.v0, u.v1))"
        share = lambda j: f"(p.g0 * {(a00, a01)[j]} * {(e0, e1)[j]} / ({a00} * {e0} + {a01} * {e1}) + p.g1 * {(a10, a11)[j]} * {(e0, e1)[j]} / ({a10} * {e0} + {a11} * {e1}))"  # noqa: B023, E731
        ctes.append(f"g{i} AS MATERIALIZED (SELECT u.chrom, u.idx, {share(0)} AS g0, {share(1)} AS g1 FROM u{i} u JOIN g{i + 1} p ON p.chrom = u.chrom AND p.idx = u.idx // 2)")
    return ",\n".join(ctes)


def tree_viterbi(top: int, model) -> str:
    """CTEs w1 to wTOP: chrom, idx, state; of equal scores the lower state."""
    ctes = _up(top, model, "greatest({x}, {y})")
    ctes.append(f"w{top} AS MATERIALIZED (SELECT chrom, idx, (v1 + ln({model.root[1]}) > v0 + ln({model.root[0]}))::INT AS state FROM u{top})")
    (a00, a01), (a10, a11) = model.transition
    for i in range(top - 1, 0, -1):
        best = f"CASE p.state WHEN 0 THEN u.v1 + ln({a01}) > u.v0 + ln({a00}) ELSE u.v1 + ln({a11}) > u.v0 + ln({a10}) END"
        ctes.append(f"w{i} AS MATERIALIZED (SELECT u.chrom, u.idx, ({best})::INT AS state FROM u{i} u JOIN w{i + 1} p ON p.chrom = u.chrom AND p.idx = u.idx // 2)")
    return ",\n".join(ctes)


def inverse(top: int, detail: str) -> str:
    """CTEs rTOP to r0 (chrom, idx, approx): the signal of the pyramid l1 to lTOP; detail: the detail of l, with its g at hand."""
    ctes = [f"r{top} AS (SELECT chrom, idx, approx FROM l{top})"]
    for i in range(top, 0, -1):
        ctes.append(f"r{i - 1} AS MATERIALIZED (SELECT r.chrom, 2 * r.idx + k AS idx, CASE k WHEN 0 THEN r.approx - {detail} ELSE r.approx + {detail} END AS approx FROM r{i} r JOIN l{i} l ON l.chrom = r.chrom AND l.idx = r.idx JOIN g{i} g ON g.chrom = r.chrom AND g.idx = r.idx, (SELECT unnest([0, 1]) AS k))")
    return ",\n".join(ctes)
