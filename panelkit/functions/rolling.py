"""Windows over an entity's rows at a cost per row that doesn't depend on their length.

Expressions are asked for first, then :meth:`Rolling.prepare` adds what they all need to the
panel in two sorts by date (one falling, one rising) after one shuffle by entity; then the
expressions can be selected.

Sums are differences of running sums.  Those are exact: each value is cut into two whole
numbers of up to 25 bits, in units of a power of two that the entity's largest value sets, so
a window's sum, and its sums of squares and products, are sums of whole numbers and cancel
without a trace.  What a value has below its unit, 2^-48 of the entity's largest one, is summed
as a double beside them.  With more than 4,000 rows an entity the unit gains a bit for each time
that the rows are four times as many.

Extremes come from blocks as long as the window, counted from an entity's last row: a window
meets two blocks at most, and is the rest of the first and the start of the second.  Each of
these is one running extreme that starts anew with the block.

Nulls, NaN and infinite values don't count in sums; nulls don't count in extremes.
"""

from __future__ import annotations

from inspect import signature
from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.functions import ts
from panelkit.functions.ts import DATE, ENTITY

LIMB = 25


RISING, FALLING = f"PARTITION BY {ENTITY} ORDER BY {DATE}", f"PARTITION BY {ENTITY} ORDER BY {DATE} DESC"
SO_FAR, ALL = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW", "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"


def _ratio(a: str, b: str) -> str:
    return f"try_divide({a}, CAST({b} AS DOUBLE))"


class Rolling:
    """Asks for windows of columns by name; ``define`` names an expression first.

    Inside, expressions are SQL text, which is parsed much faster than it is put together call by call.
    """

    def __init__(self):
        self.defined: dict[str, Column] = {}
        self.limbs: dict[str, None] = {}
        #: Running sums by field, and the fields of which each lag is needed.
        self.sums: dict[str, str] = {}
        self.lags: dict[int, dict[str, None]] = {}
        self.spreads: dict[str, str] = {}
        #: (column, sign, window length) of blocks, and the fields each shift needs.
        self.blocks: dict[tuple[str, int, int], None] = {}
        self.sides: dict[tuple[str, int], None] = {}
        self.shifts: dict[int, dict[str, None]] = {}

    def define(self, name: str, value: Column) -> str:
        self.defined[name] = value
        return name

    # -- rows -----------------------------------------------------------------------------

    col, ref, delta, div, lit = (staticmethod(f) for f in (ts.col, ts.ref, ts.delta, ts.div, F.lit))

    @staticmethod
    def gain(x) -> Column:
        """What is above 0; 0 for missing values."""
        return F.when(ts.col(x) > 0, ts.col(x)).otherwise(F.lit(0.0))

    @staticmethod
    def fading(base: float, n: int) -> Column:
        """``base`` to the power of the row's place among the last n rows, from 0."""
        return F.pow(F.lit(base), ts.window_position(n))

    @staticmethod
    def total_ordered(x, n: int) -> Column:
        """Sum from the oldest row to the newest."""
        return ts.total(x, n)

    # -- sums -----------------------------------------------------------------------------

    def _window(self, field: str, made: str, n: int) -> str:
        """Sum of a column of parts over the last n rows."""
        self.sums[field] = made
        self.lags.setdefault(n, {})[field] = None
        return f"__w{n}_{field}"

    def _parts(self, x: str, given: str | None = None) -> tuple[str, str]:
        """Both whole numbers of x; null where the other column has no value."""
        self.limbs[x] = None
        if given is None:
            return f"__a_{x}", f"__b_{x}"
        self.limbs[given] = None
        return tuple(f"CASE WHEN __a_{given} IS NOT NULL THEN __{k}_{x} END" for k in "ab")

    def _count(self, x: str, n: int) -> str:
        self._parts(x)
        return self._window(f"n_{x}", f"CAST(__a_{x} IS NOT NULL AS BIGINT)", n)

    def _both(self, x: str, n: int, given: str | None = None) -> tuple[str, str]:
        tag = x if given is None else f"{x}_{given}"
        high, low = self._parts(x, given)
        return self._window(f"a_{tag}", high, n), self._window(f"b_{tag}", low, n)

    def _rest(self, x: str, n: int) -> str:
        """Sum of what the values have below their unit."""
        return self._window(f"r_{x}", f"__r_{x}", n)

    def _sum(self, x: str, n: int) -> str:
        high, low = self._both(x, n)
        return f"((CAST({high} AS DOUBLE) * __limb + {low}) * __g_{x} + {self._rest(x, n)})"

    def count(self, x: str, n: int) -> Column:
        return F.expr(self._count(x, n))

    def total(self, x: str, n: int) -> Column:
        return F.expr(f"CASE WHEN {self._count(x, n)} > 0 THEN {self._sum(x, n)} END")

    def mean(self, x: str, n: int) -> Column:
        return F.expr(_ratio(self._sum(x, n), self._count(x, n)))

    @staticmethod
    def _combined(high: str, cross: str, low: str) -> str:
        return f"((CAST({high} AS DOUBLE) * __limb + ({cross})) * __limb + ({low}))"

    def _spread(self, x: str, n: int) -> tuple[str, str]:
        """(n times the sum of squared deviations in squared units, exact but for the last rounding; n)."""
        size, (a, b) = self._count(x, n), self._both(x, n)
        high, low = self._parts(x)
        aa, ab, bb = (self._window(f"{f}_{x}", made, n) for f, made in (("aa", f"{high} * {high}"), ("ab", f"{high} * {low}"), ("bb", f"{low} * {low}")))
        self.spreads[f"__v{n}_{x}"] = self._combined(f"({size} * {aa} - {a} * {a})", f"({size} * {ab} - {a} * {b}) * 2", f"{size} * {bb} - {b} * {b}")
        return f"__v{n}_{x}", size

    def std(self, x: str, n: int) -> Column:
        """Sample deviation; 0 where all values of a window have equal units."""
        spread, size = self._spread(x, n)
        (high, low), (a, b), rest = self._parts(x), self._both(x, n), self._rest(x, n)
        along = lambda f, part, total: f"({size} * {self._window(f'{f}_{x}', f'{part} * __r_{x}', n)} - {total} * {rest})"
        fine = f"CASE WHEN {spread} > 0 THEN greatest({spread} + 2 * (__limb * {along('ar', high, a)} + {along('br', low, b)}) / __g_{x}, 0D) ELSE 0D END"
        return F.expr(f"sqrt({_ratio(fine, f'{size} * ({size} - 1)')}) * __g_{x}")

    def corr(self, x: str, y: str, n: int) -> Column:
        """Sample covariance of the rows that have both over the product of the deviations."""
        (xh, xl), (yh, yl) = self._parts(x, y), self._parts(y, x)
        size = self._window(f"n_{x}_{y}", f"CAST(__a_{x} IS NOT NULL AND __a_{y} IS NOT NULL AS BIGINT)", n)
        (xa, xb), (ya, yb) = self._both(x, n, y), self._both(y, n, x)
        hh, hl, lh, ll = (self._window(f"{f}_{x}_{y}", made, n) for f, made in (("hh", f"{xh} * {yh}"), ("hl", f"{xh} * {yl}"), ("lh", f"{xl} * {yh}"), ("ll", f"{xl} * {yl}")))
        shared = self._combined(f"({size} * {hh} - {xa} * {ya})", f"({size} * {hl} - {xa} * {yb}) + ({size} * {lh} - {xb} * {ya})", f"{size} * {ll} - {xb} * {yb}")
        deviations = []
        for z in (x, y):
            spread, rows = self._spread(z, n)
            deviations.append(f"sqrt({_ratio(spread, f'{rows} * ({rows} - 1)')}) * __g_{z}")
        covariance = f"{_ratio(shared, f'{size} * ({size} - 1)')} * __g_{x} * __g_{y}"
        return F.expr(f"try_divide({covariance}, {deviations[0]} * {deviations[1]})")

    def slope(self, x: str, n: int) -> Column:
        """Least-squares slope against the row number."""
        size, (a, b) = self._count(x, n), self._both(x, n)
        high, low = self._parts(x)
        number = f"CASE WHEN {high} IS NOT NULL THEN __rn END"
        k, kk, ka, kb = (self._window(f"{f}_{x}", made, n) for f, made in (("k", number), ("kk", f"({number}) * __rn"), ("ka", f"__rn * {high}"), ("kb", f"__rn * {low}")))
        along = f"(CAST({size} * {ka} - {k} * {a} AS DOUBLE) * __limb + ({size} * {kb} - {k} * {b}))"
        return F.expr(_ratio(f"{along} * __g_{x}", f"{size} * {kk} - {k} * {k}"))

    # -- extremes -------------------------------------------------------------------------

    def _shifted(self, field: str, by: int) -> tuple[str, str]:
        """(the field ``by`` rows on, whether there is such a row)."""
        if by == 0:
            return field, "true"
        self.shifts.setdefault(by, {})[field] = None
        found = f"__shift{by}".replace("-", "m")
        return f"{found}.{field}", f"{found} IS NOT NULL"

    def _extreme(self, x: str, first: int, last: int, sign: int) -> str:
        n, side = last - first + 1, _side(x, sign)
        self.blocks[x, sign, n] = None
        self.sides[x, sign] = None
        rest, starts = self._shifted(f"__rest_{side}_{n}", first)
        start, ends = self._shifted(f"__start_{side}_{n}", last)
        up, _ = self._shifted(f"__up_{side}", last)
        down, _ = self._shifted(f"__down_{side}", first)
        found = f"CASE WHEN {starts} AND {ends} THEN greatest({rest}.v, {start}.v) WHEN {ends} THEN {up} WHEN {starts} THEN {down} ELSE __all_{side} END"
        return f"({'' if sign > 0 else '-'}({found}))"

    def extreme(self, x: str, first: int, last: int, sign: int) -> Column:
        """Largest (sign 1) or least (sign -1) value of the rows from ``first`` to ``last``, relative to each row."""
        return F.expr(self._extreme(x, first, last, sign))

    def high(self, x: str, n: int) -> Column:
        return self.extreme(x, 1 - n, 0, 1)

    def low(self, x: str, n: int) -> Column:
        return self.extreme(x, 1 - n, 0, -1)

    def minmax(self, x: str, n: int) -> Column:
        most, least = self._extreme(x, 1 - n, 0, 1), self._extreme(x, 1 - n, 0, -1)
        return F.expr(f"try_divide({x} - {least}, {most} - {least})")

    # -- what all of it needs ---------------------------------------------------------------

    def prepare(self, panel: DataFrame) -> DataFrame:
        out = panel.select("*", *[c.alias(name) for name, c in self.defined.items()])
        signed = lambda x, sign: f"CAST({x} AS DOUBLE) * {sign}"
        # a block's number, rising in reading order, and a value: its maximum restarts with each block
        blocked = lambda x, sign, n, order: f"struct(floor((__end - 1) / {n}) * {order} AS b, {signed(x, sign)} AS v)"
        if self.blocks:
            out = out.selectExpr("*", f"row_number() OVER ({FALLING}) AS __end")
            out = out.selectExpr(
                "*", *[f"max({blocked(x, s, n, 1)}) OVER ({FALLING} {SO_FAR}) AS __rest_{_side(x, s)}_{n}" for x, s, n in self.blocks],
                *[f"max({signed(x, s)}) OVER ({FALLING} {SO_FAR}) AS __down_{_side(x, s)}" for x, s in self.sides])
        out = out.selectExpr(
            "*", f"CAST(row_number() OVER ({RISING}) AS BIGINT) AS __rn", f"count(1) OVER ({RISING} {ALL}) AS __rows",
            *[f"max(abs({_finite(x)})) OVER ({RISING} {ALL}) AS __m_{x}" for x in self.limbs],
            *[f"max({blocked(x, s, n, -1)}) OVER ({RISING} {SO_FAR}) AS __start_{_side(x, s)}_{n}" for x, s, n in self.blocks],
            *[f"max({signed(x, s)}) OVER ({RISING} {SO_FAR}) AS __up_{_side(x, s)}" for x, s in self.sides],
            *[f"max({signed(x, s)}) OVER ({RISING} {ALL}) AS __all_{_side(x, s)}" for x, s in self.sides])
        if self.sums:
            out = self._with_sums(out)
        lags = [f"lag(struct({', '.join(f'__sums.{f} AS {f}' for f in fields)}), {n}) OVER ({RISING}) AS __lag{n}" for n, fields in self.lags.items()]
        lags += [f"{'lag' if by < 0 else 'lead'}(struct({', '.join(fields)}), {abs(by)}) OVER ({RISING}) AS __shift{by}".replace("shift-", "shiftm") for by, fields in self.shifts.items()]
        out = out.selectExpr("*", *lags)
        # each window's sums are columns of their own before they are put to use
        gone = {"__sums", *(f"__lag{n}" for n in self.lags)}
        sums = [f"coalesce(__sums.{f}, 0) - coalesce(__lag{n}.{f}, 0) AS __w{n}_{f}" for n, fields in self.lags.items() for f in fields]
        out = out.selectExpr(*[c for c in out.columns if c not in gone], *sums) if sums else out
        return out.selectExpr("*", *[f"{made} AS {name}" for name, made in self.spreads.items()]) if self.spreads else out

    def _with_sums(self, out: DataFrame) -> DataFrame:
        # bits of a part: sums over an entity's rows and over squares of window lengths must fit
        longest, first = 2 * ceil(log2(max(self.lags))), out.columns
        bits = f"CAST(least({LIMB}, floor((62 - greatest(ceil(log2(__rows + 1)), {longest})) / 2)) AS DOUBLE)"
        keep = [c for c in first if not c.startswith("__m_")]
        out = out.selectExpr("*", f"{bits} AS __bits")
        unit = lambda x: f"CASE WHEN __m_{x} > 0 THEN pow(2D, floor(log2(__m_{x})) + 2 - __bits * 2) ELSE 1D END AS __g_{x}"
        out = out.selectExpr(*keep, "pow(2D, __bits) AS __limb", *[unit(x) for x in self.limbs])
        keep = out.columns
        out = out.selectExpr("*", *[f"rint({_finite(x)} / __g_{x}) AS __x_{x}" for x in self.limbs])
        out = out.selectExpr("*", *[f"floor(__x_{x} / __limb) AS __a_{x}" for x in self.limbs])
        out = out.selectExpr(*keep, *[f"__a_{x}" for x in self.limbs], *[f"CAST(__x_{x} - __a_{x} * __limb AS BIGINT) AS __b_{x}" for x in self.limbs],
                             *[f"{_finite(x)} - __x_{x} * __g_{x} AS __r_{x}" for x in self.limbs])
        out = out.selectExpr("*", *[f"sum({made}) OVER ({RISING} {SO_FAR}) AS __p_{f}" for f, made in self.sums.items()])
        return out.selectExpr(*keep, f"struct({', '.join(f'__p_{f} AS {f}' for f in self.sums)}) AS __sums")


def _side(x: str, sign: int) -> str:
    return f"{x}_{'p' if sign > 0 else 'm'}"


def _finite(x: str) -> str:
    return f"CASE WHEN abs({x}) < double('infinity') THEN CAST({x} AS DOUBLE) END"


def select_rolling(panel: DataFrame, keep: list[str], columns: dict) -> DataFrame:
    """``keep`` and named columns of the panel; a maker whose first parameter is called ``r`` gets a :class:`Rolling`."""
    rolling = Rolling()
    made = {name: make(rolling) if "r" in signature(make).parameters else make() for name, make in columns.items()}
    out = rolling.prepare(panel) if rolling.sums or rolling.blocks else panel
    return out.select(*keep, *[c.alias(name) for name, c in made.items()])
