"""Pieces of DuckDB SQL that several oracle queries share."""

from __future__ import annotations


def _det3(m: list[list[str]]) -> str:
    return (
        f"({m[0][0]}*({m[1][1]}*{m[2][2]}-{m[1][2]}*{m[2][1]}) - {m[0][1]}*({m[1][0]}*{m[2][2]}-{m[1][2]}*{m[2][0]})"
        f" + {m[0][2]}*({m[1][0]}*{m[2][1]}-{m[1][1]}*{m[2][0]}))"
    )


def det(m: list[list[str]]) -> str:
    """The determinant of one to three rows of expressions."""
    if len(m) == 3:
        return _det3(m)
    return f"({m[0][0]})" if len(m) == 1 else f"({m[0][0]}*{m[1][1]} - {m[0][1]}*{m[1][0]})"


def _solved(degree: int, x: str) -> str:
    if degree == 0:
        return "t0/s0"
    if degree == 1:
        return f"((t0*s2-t1*s1)+(s0*t1-s1*t0)*{x})/(s0*s2-s1*s1)"
    base = [["s0", "s1", "s2"], ["s1", "s2", "s3"], ["s2", "s3", "s4"]]
    terms = []
    for k, power in enumerate(("1", x, f"{x}*{x}")):
        terms.append(f"{_det3([[f't{r}' if c == k else base[r][c] for c in range(3)] for r in range(3)])}*{power}")
    return f"({' + '.join(terms)})/{_det3(base)}"


def lowess(source: str, key: str, out: str, degree: int, span: int, passes: int) -> str:
    """CTEs that smooth ``source`` (key, i from 0, v) into ``out`` (key, i, v, z); the series are longer than the span."""
    ctes = [f"{out}_n AS (SELECT {key}, count(*)::INTEGER AS m FROM {source} GROUP BY {key})"]
    ctes.append(f"{out}_w AS (SELECT a.{key}, a.i, least(greatest(a.i - {span // 2}, 0), m - {span}) AS f FROM {source} a JOIN {out}_n USING ({key}))")
    ctes.append(
        f"""{out}_p AS (SELECT w.{key}, w.i, b.i AS j, b.v, 2.0e0*(b.i-f)/{span - 1}-1 AS t, 2.0e0*(w.i-f)/{span - 1}-1 AS ti,
        power(1 - power(abs(w.i-b.i)::DOUBLE / greatest(w.i-f, {span - 1}-(w.i-f)), 3), 3) AS w
        FROM {out}_w w JOIN {source} b ON b.{key} = w.{key} AND b.i >= f AND b.i < f + {span})"""
    )
    sums = ", ".join([f"sum(ww*power(t,{k})) AS s{k}" for k in range(2 * degree + 1)] + [f"sum(ww*power(t,{k})*v) AS t{k}" for k in range(degree + 1)])
    robust = ""
    for k in range(passes + 1):
        weight, join = ("w", "") if not k else ("w*r*r", f" JOIN {robust} r ON r.{key} = p.{key} AND r.i = p.j")
        ctes.append(f"{out}_s{k} AS (SELECT {key}, i, any_value(ti) AS x, {sums} FROM (SELECT p.*, {weight} AS ww FROM {out}_p p{join}) GROUP BY {key}, i)")
        ctes.append(f"{out}_z{k} AS (SELECT a.{key}, a.i, a.v, {_solved(degree, 'x')} AS z FROM {out}_s{k} s JOIN {source} a ON a.{key} = s.{key} AND a.i = s.i)")
        robust = f"{out}_r{k}"
        ctes.append(
            f"""{robust} AS (SELECT {key}, i, CASE WHEN mad > 0 THEN CASE WHEN a < mad THEN 1-(a/mad)*(a/mad) ELSE 0 END ELSE 1 END AS r
            FROM (SELECT {key}, i, abs(z-v) AS a, 6*list_sort(list(abs(z-v)) OVER (PARTITION BY {key}))[(count(*) OVER (PARTITION BY {key}))//2+1] AS mad FROM {out}_z{k}))"""
        )
    ctes.append(f"{out} AS (SELECT * FROM {out}_z{passes})")
    return ",\n".join(ctes)
