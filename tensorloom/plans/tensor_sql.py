"""Tile statistics as SQL text, in the few words where Spark and DuckDB differ told apart.

What follows from tiles is the same text in both.  The tiles themselves DuckDB makes
by SQL from weights; Spark has them from the row arrays (``operators.tiles``), as
tables in braces.  Tests hold both against plain Python.
"""

from __future__ import annotations

from dataclasses import dataclass

PALETTE_POLICIES = ("bump", "escape", "verbatim", "best", "unary")
RANK_POLICIES = ("rank_fixed", "rank_best", "rank_unary", "rank_rice")


@dataclass(frozen=True)
class Dialect:
    spine: str
    spine_column: str
    div: str
    #: Tiles and counts are tables that are given.
    given: bool

    def idiv(self, a: str, b: str) -> str:
        return f"({a} {self.div} {b})"


SPARK = Dialect("range(256)", "id", "div", True)
DUCKDB = Dialect("range(256)", "range", "//", False)


def bit_length(x: str) -> str:
    return "(CASE " + " ".join(f"WHEN {x} < {1 << b} THEN {b}" for b in range(9)) + " END)"


def plain_width(k: str) -> str:
    return f"(CASE WHEN {k} <= 1 THEN 0 WHEN {k} <= 2 THEN 1 WHEN {k} <= 4 THEN 2 WHEN {k} <= 8 THEN 3 WHEN {k} <= 16 THEN 4 ELSE 99 END)"


def exps(d: Dialect) -> str:
    return f"exps AS (SELECT name, cls, r, c, w, {d.idiv('w', '128')} % 256 AS ex FROM weights)"


def ranks(d: Dialect) -> str:
    """Exponents by count, most frequent first, ties by exponent; all 256, absent ones last."""
    counted = "hist AS (SELECT name, ex, n FROM {counts})" if d.given else "hist AS (SELECT name, ex, count(*) AS n FROM exps GROUP BY name, ex)"
    return f"""{counted},
ranks AS (SELECT name, ex, n, row_number() OVER (PARTITION BY name ORDER BY n DESC, ex) - 1 AS rk FROM (
  SELECT t.name, s.ex, coalesce(h.n, 0) AS n FROM (SELECT DISTINCT name FROM hist) t CROSS JOIN (SELECT {d.spine_column} AS ex FROM {d.spine}) s LEFT JOIN hist h ON h.name = t.name AND h.ex = s.ex) q)"""


def palette_tiles(d: Dialect, t: int) -> str:
    """A row for each tile: k distinct exponents, n weights, sums of the largest counts, and what the unary code needs."""
    if d.given:
        return "WITH tiles AS (SELECT * FROM {tiles})"
    tops = ", ".join(f"sum(CASE WHEN j < {(1 << b) - 1} THEN cnt ELSE 0 END) AS s{b}" for b in (1, 2, 3, 4))
    return f"""WITH {{weights}}{exps(d)},
cells AS (SELECT name, cls, r, {d.idiv('c', str(t))} AS t, ex, count(*) AS cnt FROM exps GROUP BY name, cls, r, {d.idiv('c', str(t))}, ex),
placed AS (SELECT *, row_number() OVER (PARTITION BY name, r, t ORDER BY cnt DESC, ex) - 1 AS j FROM cells),
tiles AS (SELECT name, cls, r, t, count(*) AS k, sum(cnt) AS n, {tops}, sum(cnt * (j + 1)) - min(cnt) AS u FROM placed GROUP BY name, cls, r, t)"""


def palette_costs(t: int) -> str:
    """idx, pal and esc bits of every candidate, for each tile."""
    esc = ", ".join(f"{t * b} AS i{b}, 8 * least(k, {(1 << b) - 1}) AS p{b}, 8 * (n - s{b}) AS e{b}" for b in (1, 2, 3, 4))
    return f"costs AS (SELECT name, cls, r, t, k, n, {t} * {plain_width('k')} AS ip, 8 * k AS pp, {esc}, {8 * t} AS iv, u + CASE WHEN k >= 2 THEN {t} - n ELSE 0 END AS iu FROM tiles)"


def palette_choice(policy: str, objective: str) -> tuple[str, str, str, str]:
    """SQL of a policy's choice code (the first cheapest candidate), and of its idx, pal, esc bits."""
    pal = (lambda x: x) if objective == "actual" else (lambda x: "128")
    cost = {"plain": f"ip + {pal('pp')}", **{f"esc{b}": f"i{b} + {pal(f'p{b}')} + e{b}" for b in (1, 2, 3, 4)}, "verb": f"iv + {pal('0')}", "unary": f"iu + {pal('pp')}"}
    bits = {"plain": ("ip", pal("pp"), "0"), **{f"esc{b}": (f"i{b}", pal(f"p{b}"), f"e{b}") for b in (1, 2, 3, 4)}, "verb": ("iv", pal("0"), "0"), "unary": ("iu", pal("pp"), "0")}
    valid = {"bump": {"plain": "k <= 16", "verb": "k > 16"}, "escape": {"plain": "k = 1", **{f"esc{b}": "TRUE" for b in (1, 2, 3, 4)}}, "verbatim": {"verb": "TRUE"}, "best": {"plain": "k <= 16", **{f"esc{b}": "TRUE" for b in (1, 2, 3, 4)}, "verb": "TRUE"}, "unary": {"unary": "TRUE"}}[policy]
    priced = {c: f"(CASE WHEN {ok} THEN {cost[c]} ELSE 1000000000 END)" for c, ok in valid.items()}
    least = f"least({', '.join(priced.values())})" if len(priced) > 1 else next(iter(priced.values()))
    pick = lambda of: "CASE " + " ".join(f"WHEN {p} = {least} THEN {of(c)}" for c, p in priced.items()) + " END"
    return pick(lambda c: f"'{c}'"), *(pick(lambda c, i=i: bits[c][i]) for i in range(3))


def _unpivoted(columns: list[tuple[str, ...]], names: str, measures: tuple[str, ...], source: str) -> str:
    """A row for each entry of ``columns`` from one aggregate that has ``measure_0``, ``measure_1``, ...: the tiles are read once."""
    values = ", ".join("(" + ", ".join(f"'{x}'" for x in c) + f", {i})" for i, c in enumerate(columns))
    picked = ", ".join(f"CAST(CASE p.i {' '.join(f'WHEN {i} THEN {m}_{i}' for i in range(len(columns)))} END AS BIGINT) AS {m}" for m in measures)
    return f"SELECT q.name, {', '.join(f'p.{n}' for n in names.split(', '))}, q.ntiles, q.numel, {picked} FROM {source} q CROSS JOIN (VALUES {values}) AS p({names}, i)"


def palette_totals(d: Dialect, t: int) -> str:
    """name, policy, objective and sums over tiles."""
    entries = [(policy, objective) for objective in ("actual", "p16") for policy in PALETTE_POLICIES]
    sums = ", ".join(f"sum({bits}) AS {m}_{i}" for i, e in enumerate(entries) for m, bits in zip(("idx", "pal", "esc"), palette_choice(*e)[1:], strict=True))
    totals = f"totals AS (SELECT name, count(*) AS ntiles, CAST(sum(n) AS BIGINT) AS numel, {sums} FROM costs GROUP BY name)"
    return f"{palette_tiles(d, t)},\n{palette_costs(t)},\n{totals}\n" + _unpivoted(entries, "policy, objective", ("idx", "pal", "esc"), "totals")


def best_choices(d: Dialect, t: int) -> str:
    code, *_ = palette_choice("best", "actual")
    return f"{palette_tiles(d, t)},\n{palette_costs(t)}\nSELECT name, choice, count(*) AS ntiles FROM (SELECT name, {code} AS choice FROM costs) q GROUP BY name, choice"


def tile_distinct(d: Dialect, t: int) -> str:
    shares = ", ".join(f"CAST(sum(CASE WHEN k <= {k} THEN 1 ELSE 0 END) AS BIGINT) AS k{k}" for k in (1, 2, 4, 8, 16))
    return f"{palette_tiles(d, t)}\nSELECT name, count(*) AS ntiles, CAST(sum(k) AS BIGINT) AS sum_k, {shares} FROM tiles GROUP BY name"


def rank_tiles(d: Dialect, t: int) -> str:
    """A row for each tile: n, the largest rank, ranks beyond escape codes, and Golomb-Rice sums for k from 0 to 3."""
    if d.given:
        return "WITH rtiles AS (SELECT * FROM {rtiles})"
    q = [d.idiv("rk", str(1 << k)) for k in range(4)]
    qm = [d.idiv("rmax", str(1 << k)) for k in range(4)]
    rice = ", ".join(f"sum(cnt * ({q[k]} + 1)) - sum(CASE WHEN {q[k]} = {qm[k]} THEN cnt ELSE 0 END) AS q{k}" for k in range(4))
    over = ", ".join(f"sum(CASE WHEN rk >= {(1 << b) - 1} THEN cnt ELSE 0 END) AS e{b}" for b in (1, 2, 3, 4))
    return f"""WITH {{weights}}{exps(d)},
{ranks(d)},
ranked AS (SELECT x.name, x.cls, x.r, {d.idiv('x.c', str(t))} AS t, k.rk, count(*) AS cnt FROM exps x JOIN ranks k ON k.name = x.name AND k.ex = x.ex GROUP BY x.name, x.cls, x.r, {d.idiv('x.c', str(t))}, k.rk),
topped AS (SELECT *, max(rk) OVER (PARTITION BY name, r, t) AS rmax FROM ranked),
rtiles AS (SELECT name, cls, r, t, sum(cnt) AS n, max(rk) AS rmax, {over}, {rice} FROM topped GROUP BY name, cls, r, t)"""


def rank_totals(d: Dialect, t: int) -> str:
    fixed = f"{t} * {bit_length('rmax')}"
    esc = [f"({t * b} + 8 * e{b})" for b in (1, 2, 3, 4)]
    rice = [f"({t * k} + q{k} + CASE WHEN {d.idiv('rmax', str(1 << k))} > 0 THEN {t} - n ELSE 0 END)" for k in range(3)]
    best = {"rank_fixed": fixed, "rank_best": f"least({fixed}, {', '.join(esc)}, {8 * t})", "rank_unary": rice[0], "rank_rice": f"least({', '.join(rice)})"}
    sums = ", ".join(f"sum({bits}) AS bits_{i}" for i, bits in enumerate(best.values()))
    totals = f"totals AS (SELECT name, count(*) AS ntiles, CAST(sum(n) AS BIGINT) AS numel, {sums} FROM rtiles GROUP BY name)"
    return f"{rank_tiles(d, t)},\n{totals}\n" + _unpivoted([(p,) for p in best], "policy", ("bits",), "totals")


def rank_bits(d: Dialect, t: int) -> str:
    """Bits per weight of the rank policies, with raw bytes, a byte for each tile, and 8 bits for each distinct exponent of a tensor."""
    distinct = "SELECT name, count(*) AS distinct_ex FROM {counts} GROUP BY name" if d.given else f"WITH {{weights}}{exps(d)} SELECT name, count(DISTINCT ex) AS distinct_ex FROM exps GROUP BY name"
    return f"""SELECT q.name, q.policy, CAST(8 * q.numel + q.bits + 8 * q.ntiles + 8 * h.distinct_ex AS BIGINT) AS total_bits, round((8 * q.numel + q.bits + 8 * q.ntiles + 8 * h.distinct_ex) / CAST(q.numel AS DOUBLE), 9) AS bits_per_weight
FROM ({rank_totals(d, t)}) q JOIN ({distinct}) h ON h.name = q.name"""


def v1_meta(d: Dialect) -> str:
    """Of each tile of 128 weights: stored width, whether it escapes, escapes, words of 32 bits; rows are padded with rank 0."""
    fixed = f"128 * {bit_length('rmax')}"
    esc = {b: f"({128 * b} + 8 * e{b})" for b in (1, 2, 3, 4)}
    least = f"least({fixed}, {', '.join(esc.values())})"
    pick = lambda first, of: f"CASE WHEN {fixed} = {least} THEN {first} " + " ".join(f"WHEN {c} = {least} THEN {of(b)}" for b, c in esc.items()) + " END"
    return f"{rank_tiles(d, 128)}\nSELECT name, cls, r, t, CAST(n AS BIGINT) AS n, CAST({pick(bit_length('rmax'), str)} AS BIGINT) AS b, CAST({pick('0', lambda b: '1')} AS BIGINT) AS escape, CAST({pick('0', lambda b: f'e{b}')} AS BIGINT) AS escapes FROM rtiles"


def v2_meta(d: Dialect) -> str:
    """Of each tile of 128 weights: k, qmax and bits of its code, over the real weights only."""
    qm = [d.idiv("rmax", str(1 << k)) for k in range(4)]
    cost = [f"(CASE WHEN {qm[k]} <= 63 THEN {k} * n + q{k} ELSE 1000000000 END)" for k in range(4)]
    least = f"least({', '.join(cost)})"
    pick = lambda of: "CASE " + " ".join(f"WHEN {cost[k]} = {least} THEN {of(k)}" for k in range(4)) + " END"
    return f"{rank_tiles(d, 128)}\nSELECT name, cls, r, t, CAST(n AS BIGINT) AS n, CAST({pick(str)} AS BIGINT) AS k, CAST({pick(lambda k: qm[k])} AS BIGINT) AS qmax, CAST({least} AS BIGINT) AS bits FROM rtiles"


def baselines(d: Dialect) -> str:
    """Bits of a palette for the whole tensor, of the best window of seven exponents, and of palettes of 16 for segments of 64."""
    width = "(CASE " + " ".join(f"WHEN n_ex <= {1 << b} THEN {b}" for b in range(9)) + " END)"
    # A segment's exponents are all among the 16 first if its largest rank is.
    if d.given:
        head, segments = "WITH " + ranks(d), "segments AS (SELECT name, n, CASE WHEN rmax < 16 THEN 1 ELSE 0 END AS inside FROM {rtiles})"
    else:
        head = f"WITH {{weights}}{exps(d)},\n{ranks(d)}"
        segments = f"segments AS (SELECT x.name, x.r, {d.idiv('x.c', '64')} AS s, count(*) AS n, min(CASE WHEN k.rk < 16 AND k.n > 0 THEN 1 ELSE 0 END) AS inside FROM exps x JOIN ranks k ON k.name = x.name AND k.ex = x.ex GROUP BY x.name, x.r, {d.idiv('x.c', '64')})"
    return f"""{head},
spans AS (SELECT name, ex, n, sum(n) OVER (PARTITION BY name ORDER BY ex ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING) AS seven FROM ranks),
whole AS (SELECT name, sum(n) AS n, sum(CASE WHEN n > 0 THEN 1 ELSE 0 END) AS n_ex, max(CASE WHEN ex <= 249 THEN seven ELSE 0 END) AS covered FROM spans GROUP BY name),
{segments},
kept AS (SELECT name, count(*) AS segments, sum(CASE WHEN inside = 1 THEN n ELSE 0 END) AS n_in FROM segments GROUP BY name)
SELECT w.name, CAST(w.n AS BIGINT) AS numel, CAST(w.n_ex AS BIGINT) AS distinct_ex, CAST(w.n * {width} + 8 * w.n_ex AS BIGINT) AS tensor_palette_bits, CAST(3 * w.n + 16 * (w.n - w.covered) AS BIGINT) AS window7_bits,
CAST(4 * k.n_in + 8 * (w.n - k.n_in) + k.segments + 128 AS BIGINT) AS palette16_bits, CAST(k.n_in AS BIGINT) AS weights_in_segments FROM whole w JOIN kept k ON k.name = w.name"""
