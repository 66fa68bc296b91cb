"""Windows over many entities at once as numpy arrays, and what takes such arrays from task to task.

A block is an array of (rows of an entity in date order, entities), so a lag is a shift along
the first axis.  Entities of like length share a block; the shorter ones end in copies of their
last row, which no other row sees.  :class:`Windows` has the makers of :class:`rolling.Rolling`
that factors use, and gives a :class:`Series` for each.

Sums are differences of running sums, of the same whole numbers as in :mod:`rolling`, so they
are exact; as whole numbers wrap around, an entity may have any number of rows.

Nulls, NaN and infinite values don't count in sums; nulls don't count in extremes, where NaN is
the largest value.
"""

from __future__ import annotations

import struct
import sys
from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

# goes to the tasks with the query, so workers need not have the library
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bits of a part of a number.
LIMB = 25
#: Values of a block: a few arrays of that size stay in a core's cache.
CELLS = 16_384
#: Rows of a chunk, but for one entity that has more.
CHUNK = 40_000


class Series:
    """Values and which of them are there; ``valid`` None says all."""

    __slots__ = ("values", "valid")

    def __init__(self, values, valid=None):
        self.values, self.valid = values, valid

    def _with(self, other, made):
        if isinstance(other, Series):
            return Series(made(self.values, other.values), both(self.valid, other.valid))
        return Series(made(self.values, other), self.valid)

    def __add__(self, other):
        return self._with(other, lambda a, b: a + b)

    def __sub__(self, other):
        return self._with(other, lambda a, b: a - b)

    def __mul__(self, other):
        return self._with(other, lambda a, b: a * b)

    def __rsub__(self, other):
        return self._with(other, lambda a, b: b - a)

    __radd__, __rmul__ = __add__, __mul__


def both(a, b):
    return b if a is None else a if b is None else a & b


def divide(a: Series, b: Series) -> Series:
    """Null where the divisor is 0."""
    zero = b.values == 0
    if not zero.any():
        return Series(a.values / b.values, both(a.valid, b.valid))
    return Series(a.values / np.where(zero, 1.0, b.values), both(both(a.valid, b.valid), ~zero))


def steady(values: np.ndarray, digits: int) -> np.ndarray:
    """:func:`xs.steady` in units of the last digit, which are whole numbers."""
    return np.floor(values * float(10**digits) + 0.50001)


class Windows:
    """A block's columns by name, with the factors made so far."""

    def __init__(self, columns: dict[str, Series], shape: tuple[int, int]):
        self.columns, self.shape, self.number = columns, shape, np.arange(1.0, shape[0] + 1)[:, None]
        #: What is asked for again.
        self.kept: dict = {}

    # -- rows -----------------------------------------------------------------------------

    def col(self, x) -> Series:
        return self.columns[x] if isinstance(x, str) else x

    @staticmethod
    def lit(value: float) -> Series:
        return Series(np.float64(value))

    def define(self, name: str, value: Series) -> str:
        self.columns[name] = value
        return name

    def ref(self, x, n: int) -> Series:
        x = self.col(x)
        values, valid = np.zeros_like(x.values), np.zeros(x.values.shape, bool)
        values[n:] = x.values[: max(len(values) - n, 0)]
        valid[n:] = True if x.valid is None else x.valid[: max(len(values) - n, 0)]
        return Series(values, valid)

    def delta(self, x, n: int) -> Series:
        return self.col(x) - self.ref(x, n)

    def div(self, a, b) -> Series:
        return divide(self.col(a), self.col(b))

    def gain(self, x) -> Series:
        """What is above 0; 0 for missing values."""
        x = self.col(x)
        above = (x.values > 0) | np.isnan(x.values)
        return Series(np.where(above if x.valid is None else above & x.valid, x.values, 0.0))

    def fading(self, base: float, n: int) -> Series:
        """``base`` to the power of the row's place among the last n rows, from 0."""
        place = np.minimum(self.number - 1, n - 1)
        return Series(np.broadcast_to(np.power(base, place), self.shape))

    # -- sums -----------------------------------------------------------------------------

    def _once(self, key, made):
        if key not in self.kept:
            self.kept[key] = made()
        return self.kept[key]

    def _finite(self, x):
        """(values, 0 where one doesn't count; which count, or None)."""

        def made():
            s = self.col(x)
            good = np.isfinite(s.values)
            if s.valid is not None:
                good &= s.valid
            values = np.broadcast_to(s.values, self.shape)
            if good.all():
                return values, None
            good = np.broadcast_to(good, self.shape)
            return np.where(good, values, 0.0), good

        return self._once(("finite", x), made)

    def _window(self, key, n: int, made):
        """Sums of an array over the last n rows; whole numbers may wrap, as their windows fit."""

        def total():
            so_far = self._once(("running", key), lambda: np.cumsum(made(), axis=0))
            out = so_far.copy()
            out[n:] -= so_far[:-n]
            return out

        return self._once(("window", key, n), total)

    def _counted(self, key, good, n: int):
        if good is None:
            return np.minimum(self.number, n).astype(np.int64)
        return self._window(("n", key), n, lambda: good.astype(np.int64))

    def count(self, x, n: int) -> np.ndarray:
        return self._counted(x, self._finite(x)[1], n)

    def _some(self, x, n: int):
        """Windows with a value, or None for all."""
        return None if self._finite(x)[1] is None else self.count(x, n) > 0

    @staticmethod
    def _bits(n: int) -> int:
        """Bits of a part: sums of products over n rows, n times, must fit."""
        return min(LIMB, (62 - 2 * ceil(log2(max(n, 2)))) // 2)

    def _parts(self, x, bits: int):
        """(higher and lower whole number, the rest below the unit or None, the unit)."""

        def made():
            values = self._finite(x)[0]
            most = np.abs(values).max(axis=0, keepdims=True, initial=0.0)
            unit = np.where(most > 0, np.exp2(np.floor(np.log2(np.where(most > 0, most, 1.0))) + 2 - 2 * bits), 1.0)
            whole = np.rint(values / unit)
            high = np.floor(whole / 2.0**bits)
            rest = values - whole * unit
            return high.astype(np.int64), (whole - high * 2.0**bits).astype(np.int64), rest if rest.any() else None, unit

        return self._once(("parts", x, bits), made)

    def _both(self, x, n: int):
        """Sums of both parts over the last n rows."""
        bits = self._bits(n)
        high, low, _, _ = self._parts(x, bits)
        return self._window(("a", x, bits), n, lambda: high), self._window(("b", x, bits), n, lambda: low)

    def _rest(self, x, n: int):
        rest = self._parts(x, self._bits(n))[2]
        return None if rest is None else self._window(("r", x, self._bits(n)), n, lambda: rest)

    def _sum(self, x, n: int) -> np.ndarray:
        def made():
            (a, b), rest, unit = self._both(x, n), self._rest(x, n), self._parts(x, self._bits(n))[3]
            out = (a * 2.0 ** self._bits(n) + b) * unit
            return out if rest is None else out + rest

        return self._once(("sum", x, n), made)

    def total(self, x, n: int) -> Series:
        return Series(self._sum(x, n), self._some(x, n))

    def total_ordered(self, x, n: int) -> Series:
        """Sum from the oldest row to the newest."""
        values, good = self._finite(x)
        out = np.zeros(self.shape)
        for k in range(min(n, len(values)) - 1, 0, -1):
            out[k:] += values[:-k]
        return Series(out + values, self._some(x, n))

    def mean(self, x, n: int) -> Series:
        return Series(self._sum(x, n) / np.maximum(self.count(x, n), 1), self._some(x, n))

    @staticmethod
    def _combined(high, cross, low, bits: int):
        return (high * 2.0**bits + cross) * 2.0**bits + low

    def _spread(self, x, n: int):
        """n times the sum of squared deviations in squared units, exact but for the last rounding."""

        def made():
            bits, size, (a, b) = self._bits(n), self.count(x, n), self._both(x, n)
            high, low, _, _ = self._parts(x, bits)
            aa, ab, bb = (self._window((f, x, bits), n, lambda p=p, q=q: p * q) for f, p, q in (("aa", high, high), ("ab", high, low), ("bb", low, low)))
            return self._combined(size * aa - a * a, (size * ab - a * b) * 2, size * bb - b * b, bits)

        return self._once(("spread", x, n), made)

    def std(self, x, n: int) -> Series:
        """Sample deviation; 0 where all values of a window have equal units."""
        bits, size, spread, rest = self._bits(n), self.count(x, n), self._spread(x, n), self._rest(x, n)
        high, low, parts, unit = self._parts(x, bits)
        if rest is not None:
            a, b = self._both(x, n)
            ar, br = (self._window((f, x, bits), n, lambda p=p: p * parts) for f, p in (("ar", high), ("br", low)))
            spread = np.where(spread > 0, np.maximum(spread + 2 * (2.0**bits * (size * ar - a * rest) + (size * br - b * rest)) / unit, 0.0), 0.0)
        return Series(np.sqrt(spread / np.maximum(size * (size - 1), 1)) * unit, size > 1)

    def corr(self, x, y, n: int) -> Series:
        """Sample covariance of the rows that have both over the product of the deviations."""
        bits, good = self._bits(n), both(self._finite(x)[1], self._finite(y)[1])
        size = self._counted((x, y), good, n)
        (xh, xl, _, xg), (yh, yl, _, yg) = self._parts(x, bits), self._parts(y, bits)
        if good is None:
            (xa, xb), (ya, yb) = self._both(x, n), self._both(y, n)
        else:
            xa, xb, ya, yb = (self._window((f, x, y, bits), n, lambda p=p: p * good) for f, p in (("xa", xh), ("xb", xl), ("ya", yh), ("yb", yl)))
        hh, hl, lh, ll = (self._window((f, x, y, bits), n, lambda p=p, q=q: p * q) for f, p, q in (("hh", xh, yh), ("hl", xh, yl), ("lh", xl, yh), ("ll", xl, yl)))
        shared = self._combined(size * hh - xa * ya, (size * hl - xa * yb) + (size * lh - xb * ya), size * ll - xb * yb, bits)
        deviations = []
        for z, unit in ((x, xg), (y, yg)):
            rows = self.count(z, n)
            deviations.append(Series(np.sqrt(self._spread(z, n) / np.maximum(rows * (rows - 1), 1)) * unit, rows > 1))
        return divide(Series(shared / np.maximum(size * (size - 1), 1) * xg * yg, size > 1), deviations[0] * deviations[1])

    def slope(self, x, n: int) -> Series:
        """Least-squares slope against the row number."""
        bits, size, (a, b), good = self._bits(n), self.count(x, n), self._both(x, n), self._finite(x)[1]
        high, low, _, unit = self._parts(x, bits)
        number = np.broadcast_to(self.number.astype(np.int64), self.shape)
        number = number if good is None else number * good
        k, kk, ka, kb = (self._window((f, x, bits), n, lambda p=p: number * p) for f, p in (("k", 1), ("kk", number), ("ka", high), ("kb", low)))
        along = (size * ka - k * a) * 2.0**bits + (size * kb - k * b)
        return divide(Series(along * unit), Series((size * kk - k * k).astype(float), self._some(x, n)))

    # -- extremes -------------------------------------------------------------------------

    def _extreme(self, x, n: int, sign: int) -> Series:
        def made():
            s = self.col(x)
            nan = np.isnan(s.values)
            if s.valid is not None:
                nan &= s.valid
            pick = np.maximum if sign > 0 else np.fmin
            values = s.values if s.valid is None else np.where(s.valid, s.values, -np.inf if sign > 0 else np.nan)
            wide = 1
            while wide < min(n, len(values)):
                by = min(wide, min(n, len(values)) - wide)
                out = values.copy()
                out[by:] = pick(values[by:], values[:-by])
                values, wide = out, wide + by
            return Series(values, None if s.valid is None else self._counted(("there", x), s.valid, n) > 0)

        return self._once(("extreme", x, n, sign), made)

    def high(self, x, n: int) -> Series:
        return self._extreme(x, n, 1)

    def low(self, x, n: int) -> Series:
        return self._extreme(x, n, -1)

    def minmax(self, x, n: int) -> Series:
        most, least = self.high(x, n), self.low(x, n)
        return divide(self.col(x) - least, most - least)


class Needs(dict):
    """Columns of one row, which notes the names that are asked for."""

    def __missing__(self, name: str) -> Series:
        self[name] = Series(np.ones((1, 1)))
        return self[name]


# -- blocks of a chunk ---------------------------------------------------------------------


def chunks(batches: Iterator[pa.RecordBatch], number: str, most: int = CHUNK) -> Iterator[pa.Table]:
    """Tables of whole entities; batches come by entity, and ``number`` is 1 in an entity's first row."""
    held, rows = [], 0
    for batch in batches:
        firsts = np.flatnonzero(np.asarray(batch.column(batch.schema.get_field_index(number))) == 1)
        start = 0
        while True:
            # the first entity that begins once there are enough rows
            at = firsts[np.searchsorted(firsts, max(start + (most - rows), start)) :][:1]
            if not len(at):
                break
            if rows + at[0] - start:
                held.append(batch.slice(start, at[0] - start))
                yield pa.Table.from_batches(held).combine_chunks()
            held, rows, start = [], 0, int(at[0])
        if batch.num_rows > start:
            held.append(batch.slice(start))
            rows += batch.num_rows - start
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def blocks(number: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of each cell of a block; rows of the chunk that it has; their cells)."""
    starts = np.flatnonzero(number == 1)
    sizes = np.diff(np.append(starts, len(number)))
    order = np.argsort(sizes, kind="stable")
    first = 0
    while first < len(order):
        last = first + 1
        while last < len(order) and (last + 1 - first) * sizes[order[last]] <= CELLS:
            last += 1
        some = np.sort(order[first:last])
        size, n = sizes[some], int(sizes[some].max())
        cells = starts[some] + np.minimum(np.arange(n)[:, None], size - 1)
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        entity = np.repeat(np.arange(len(some)), size)
        yield cells, starts[some][entity] + place, place * len(some) + entity
        first = last


def series(column) -> tuple[np.ndarray, np.ndarray | None]:
    """A column of doubles as values and which of them are there."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not column.null_count:
        return np.asarray(column), None
    return np.asarray(column.fill_null(0.0)), np.asarray(column.is_valid())


def block_of(columns: dict[str, tuple], cells: np.ndarray) -> Windows:
    taken = {}
    for name, (values, valid) in columns.items():
        there = None if valid is None else valid[cells]
        taken[name] = Series(values[cells], None if there is None or there.all() else there)
    return Windows(taken, cells.shape)


# -- arrays on their way -------------------------------------------------------------------


def pack(arrays: list[np.ndarray], more: bytes = b"") -> bytes:
    """Arrays of one length and other bytes, compressed; bytes of the same weight lie together."""
    planes = [np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() for a in arrays]
    size = len(arrays[0]) if arrays else 0
    whole = b"".join([struct.pack("<qq", size, len(more)), more, *planes])
    return struct.pack("<q", len(whole)) + pa.compress(whole, codec="zstd", asbytes=True)


def unpack(blob, dtypes: list) -> tuple[list[np.ndarray], bytes]:
    blob = memoryview(blob)
    whole = pa.decompress(blob[8:], struct.unpack("<q", blob[:8])[0], codec="zstd", asbytes=True)
    n, more = struct.unpack("<qq", whole[:16])
    at, found = 16 + more, []
    for dtype in map(np.dtype, dtypes):
        planes = np.frombuffer(whole, np.uint8, n * dtype.itemsize, at).reshape(dtype.itemsize, n)
        found.append(np.ascontiguousarray(planes.T).view(dtype).reshape(n))
        at += n * dtype.itemsize
    return found, whole[16 : 16 + more]


def portions(items: Iterator, size, most: int = 4_000_000) -> Iterator[list]:
    """Lists of items that have ``most`` bytes, or a bit more."""
    held, total = [], 0
    for item in items:
        held.append(item)
        total += size(item)
        if total >= most:
            yield held
            held, total = [], 0
    if held:
        yield held


def framed(bodies: list[bytes]) -> bytes:
    return struct.pack(f"<{len(bodies) + 1}q", len(bodies), *map(len, bodies)) + b"".join(bodies)


def unframed(blob) -> list[memoryview]:
    blob = memoryview(blob)
    (n,) = struct.unpack("<q", blob[:8])
    at, found = 8 * (n + 1), []
    for size in struct.unpack(f"<{n}q", blob[8:at]):
        found.append(blob[at : at + size])
        at += size
    return found


def bits_of(flags: list[np.ndarray], rows: int) -> list[np.ndarray]:
    """Flags as whole numbers of 64 bits."""
    words = [np.zeros(rows, np.uint64) for _ in range((len(flags) + 63) // 64)]
    for k, flag in enumerate(flags):
        words[k // 64] |= flag.astype(np.uint64) << np.uint64(k % 64)
    return words


def bit(words: list[np.ndarray], k: int) -> np.ndarray:
    return (words[k // 64] >> np.uint64(k % 64)) & np.uint64(1) == 1


def sent(table: pa.Table) -> bytes:
    """A table with its schema, compressed by column."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def received(blob) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(blob)).read_all()
