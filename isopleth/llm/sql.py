"""DuckDB SQL for operators whose hashes SQL has to compute step by step.

Unsigned 128-bit integers hold the products of 64-bit numbers, which are then
taken modulo 2^64.
"""

from __future__ import annotations

#: The primes of XXH64: fixed values.
_PRIMES = (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)
_SEED = 42


def _wide(x: object) -> str:
    return f"CAST({x} AS UHUGEINT)"


def _mod(x: str) -> str:
    return f"(({x}) % {_wide(2**64)})"


def _times(x: str, prime: int) -> str:
    return _mod(f"{_wide(x)} * {_wide(prime)}")


def _turned(x: str, bits: int) -> str:
    return f"({_mod(f'{_wide(x)} * {_wide(2**bits)}')} + {_wide(x)} // {_wide(2 ** (64 - bits))})"


def _xor(a: str, b: str) -> str:
    return f"CAST(xor(CAST({a} AS UBIGINT), CAST({b} AS UBIGINT)) AS UHUGEINT)"


def _round(v: str, lane: str) -> str:
    return _times(_turned(_mod(f"{_wide(v)} + {_times(lane, _PRIMES[1])}"), 31), _PRIMES[0])


def _little_endian(piece: str) -> str:
    return f"list_reduce(list_reverse({piece}), lambda x, y: x * {_wide(256)} + y)"


def xxh64(source: str, seed: int = _SEED) -> str:
    """CTEs that end with ``hashed`` (s, h): XXH64 of each text ``s`` of ``source``."""
    p1, p2, p3, p4, p5 = _PRIMES
    starts = [n % 2**64 for n in (seed + p1 + p2, seed + p2, seed, seed - p1)]
    lanes = ", ".join(f"list_reduce(list_transform(range(0, q), lambda i: l[4 * i + {k + 1}]), lambda v, x: {_round('v', 'x')}, {_wide(n)}) AS v{k}" for k, n in enumerate(starts))
    merged = _mod(" + ".join(_turned(f"v{k}", r) for k, r in enumerate((1, 7, 12, 18))))
    out = f"""xb AS (SELECT s, list_transform(regexp_extract_all(hex(s), '..'), lambda x: CAST('0x' || x AS UHUGEINT)) AS b FROM {source}),
xl AS (SELECT s, b, len(b) AS n, len(b) // 32 AS q, list_transform(range(0, len(b) // 8), lambda i: {_little_endian('b[8 * i + 1 : 8 * i + 8]')}) AS l FROM xb),
xv AS (SELECT *, {lanes} FROM xl),
x0 AS (SELECT s, b, n, l[4 * q + 1 :] AS l, v0, v1, v2, v3, CASE WHEN n >= 32 THEN {merged} END AS h FROM xv)"""
    for k in range(4):
        out += f",\nx{k + 1} AS (SELECT s, b, n, l, v0, v1, v2, v3, {_mod(_times(_xor('h', _round('0', f'v{k}')), p1) + f' + {_wide(p4)}')} AS h FROM x{k})"
    eight = _mod(_times(_turned(_xor("h", _round("0", "x")), 27), p1) + f" + {_wide(p4)}")
    four = _mod(_times(_turned(_xor("h", _times(_little_endian("b[n // 8 * 8 + 1 : n // 8 * 8 + 4]"), p1)), 23), p2) + f" + {_wide(p3)}")
    one = _times(_turned(_xor("h", _times("x", p5)), 11), p1)
    first = _mod(f"coalesce(h, {_wide((seed + p5) % 2**64)}) + {_wide('n')}")
    shifted = lambda bits: f"{_wide('h')} // {_wide(2**bits)}"
    return out + f""",
x5 AS (SELECT s, b, n, list_reduce(l, lambda h, x: {eight}, {first}) AS h FROM x4),
x6 AS (SELECT s, b, n, CASE WHEN n % 8 >= 4 THEN {four} ELSE h END AS h FROM x5),
x7 AS (SELECT s, list_reduce(b[n // 4 * 4 + 1 :], lambda h, x: {one}, h) AS h FROM x6),
x8 AS (SELECT s, {_times(_xor('h', shifted(33)), p2)} AS h FROM x7),
x9 AS (SELECT s, {_times(_xor('h', shifted(29)), p3)} AS h FROM x8),
hashed AS (SELECT s, CAST({_xor('h', shifted(32))} AS UBIGINT) AS h FROM x9)"""


def simhash_components(shingle: int = 4, most: int = 4) -> str:
    """doc_id, fingerprint and component_id: every print meets every other one."""
    counts = ", ".join(f"sum(c * ((h >> {b}) & 1)) AS b{b}" for b in range(64))
    majority = " + ".join(f"CASE WHEN 2 * b{b} > n THEN {_wide(2**b)} ELSE 0 END" for b in range(64))
    return f"""WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, array_to_string(w[k : k + {shingle - 1}], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - {shingle - 1}) + 1)) AS k FROM docs WHERE len(w) > 0)),
counted AS (SELECT doc_id, s, count(*) AS c FROM windows GROUP BY ALL),
shingles AS (SELECT DISTINCT s FROM counted),
{xxh64('shingles')},
bits AS (SELECT doc_id, sum(c) AS n, {counts} FROM counted JOIN hashed USING (s) GROUP BY doc_id),
prints AS (SELECT doc_id, coalesce(CAST({majority} AS UBIGINT), 0) AS p FROM docs LEFT JOIN bits USING (doc_id)),
distinct_prints AS (SELECT p, min(doc_id) AS first FROM prints GROUP BY p),
near AS (SELECT a.p AS a, b.p AS b FROM distinct_prints a JOIN distinct_prints b ON bit_count(CAST(xor(a.p, b.p) AS HUGEINT)) <= {most}),
reach AS (SELECT a, b FROM near UNION SELECT reach.a, near.b FROM reach JOIN near ON reach.b = near.a),
roots AS (SELECT a AS p, min(first) AS component_id FROM reach JOIN distinct_prints ON distinct_prints.p = reach.b GROUP BY a)
SELECT doc_id, lower(lpad(to_hex(p), 16, '0')) AS fingerprint, component_id FROM prints JOIN roots USING (p)"""
