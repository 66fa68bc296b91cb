"""Factor catalog: families as data, with the stage and lookback of each factor.

Stage 1 factors read raw columns, stage 2 ones read stage 1, and stage 3 ones rank a staged
column over a date.  A factor is built by what it is given: :class:`arrays.Windows` makes it of
arrays, which is what :meth:`FactorCatalog.compute` does, :class:`rolling.Rolling` as a Column.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from panelkit.functions import arrays, ts, xs

# factors are made in the tasks, so workers need not have the library
cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(ts)

WINDOWS = (5, 10, 20, 30, 60)
#: Tiles of a date.
TILES = 5
#: Means, deviations and correlations are rounded to so many digits before they are ranked.
RANK_DIGITS = 6


@dataclass(frozen=True)
class Factor:
    name: str
    stage: int
    lookback: int
    build: Callable
    base: str | None = None  # stage 3: the staged column that is ranked
    digits: int | None = None  # stage 3: digits the base is rounded to, if its last bits are noise


class FactorCatalog:
    """Named factors; ``add`` extends it."""

    def __init__(self, factors: list[Factor] | None = None):
        self.factors: dict[str, Factor] = {}
        for f in factors or []:
            self.add(f)

    def add(self, factor: Factor) -> None:
        if factor.name in self.factors:
            raise ValueError(f"factor {factor.name} is there already")
        self.factors[factor.name] = factor

    def __add__(self, other: FactorCatalog) -> FactorCatalog:
        return FactorCatalog([*self.factors.values(), *other.factors.values()])

    @property
    def names(self) -> list[str]:
        return list(self.factors)

    @property
    def lookback(self) -> int:
        return max((f.lookback for f in self.factors.values()), default=0)

    def compute(self, panel: DataFrame, tasks: int | None = None, keep: tuple[str, ...] = (), where: str | None = None, digits: dict[str, int] | None = None) -> DataFrame:
        """(entity, trade_date, ``keep``..., factors...), over ``tasks`` tasks, or the session's number.

        Of rows where the column ``where`` isn't true no factors are returned; they still count
        in windows and ranks.  With ``digits`` all factors are doubles, rounded to so many digits.
        """
        types = [T.StructField(n, T.IntegerType() if digits is None and self.factors[n].stage == 3 else T.DoubleType()) for n in self.names]
        kept = panel.select(ts.ENTITY, ts.DATE, *keep).schema.fields
        make, names = self._maker((*keep, *([where] if where else [])), where), self.names

        def rows(table: pa.Table, ranks: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
            for taken, made in make(table, ranks):
                out = [table.column(n).combine_chunks().take(taken) for n in (ts.ENTITY, ts.DATE, *keep)]
                for n in names:
                    values, valid = made[n]
                    if digits is not None:
                        values = arrays.steady(values, digits[n]) / float(10 ** digits[n])
                    out.append(pa.array(values, mask=None if valid is None else ~valid))
                yield pa.record_batch(out, names=[ts.ENTITY, ts.DATE, *keep, *names])

        return self.apply(panel, rows, T.StructType([*kept, *types]), tasks, (*keep, *([where] if where else [])))

    def by_date(self, panel: DataFrame, finish: Callable[[Day], pa.Table], schema: T.StructType, tasks: int | None = None, keep: tuple[str, ...] = (), where: str | None = None,
                names: list[str] | None = None, complete: bool = False, digits: dict[str, int] | None = None) -> DataFrame:
        """What ``finish`` makes of the factors ``names`` of each date, with the columns ``keep``.

        Factors go to their dates as compressed messages.  Rows where ``where`` isn't true stay
        behind, and with ``complete`` those without one of the factors.
        """
        names = names or self.names
        sent = self._sent_to_dates(panel, tasks, keep, where, names, complete, digits)
        return sent.groupBy("bucket").applyInArrow(lambda table: finish(Day(table.column("body"), names, digits)), schema)

    def compute_by_date(self, panel: DataFrame, tasks: int | None = None, where: str | None = None, digits: dict[str, int] | None = None) -> DataFrame:
        """What ``compute`` gives, all as doubles, dealt by date; the factors go there as messages."""
        names = self.names

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for bodies in arrays.portions((body for batch in batches for body in batch.column(batch.schema.get_field_index("body"))), lambda body: len(body.as_buffer())):
                day = Day(bodies, names, digits)
                made = [*day.rows.columns, *[pa.array(v, mask=missing if missing.any() else None) for _, v, missing in day.factors()]]
                yield from pa.table(made, names=[ts.ENTITY, ts.DATE, *names]).combine_chunks().to_batches()

        schema = T.StructType([*panel.select(ts.ENTITY, ts.DATE).schema.fields, *[T.StructField(n, T.DoubleType()) for n in names]])
        return self._sent_to_dates(panel, tasks, (), where, names, False, digits).mapInArrow(rows, schema)

    def _sent_to_dates(self, panel: DataFrame, tasks: int | None, keep: tuple[str, ...], where: str | None, names: list[str], complete: bool, digits: dict[str, int] | None) -> DataFrame:
        """Messages of factors, dealt by date."""
        also = (*keep, *([where] if where else []))
        make = self._maker(also, where)

        def rows(table: pa.Table, ranks: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
            taken, values, there = [], {n: [] for n in names}, {n: [] for n in names}
            for some, made in make(table, ranks):
                whole = None
                for n in names if complete else ():
                    whole = arrays.both(whole, made[n][1])
                chosen = np.arange(len(some)) if whole is None else np.flatnonzero(whole)
                taken.append(some[chosen])
                for n in names:
                    value, valid = made[n][0][chosen], made[n][1]
                    values[n].append(value.astype(float) if digits is None else arrays.steady(value, digits[n]))
                    there[n].append(np.ones(len(chosen), bool) if valid is None else valid[chosen])
            taken = np.concatenate(taken) if taken else np.zeros(0, np.int64)
            if not len(taken):
                return
            rows = table.select([ts.ENTITY, ts.DATE, *keep]).take(taken)
            days = _days(rows)
            order = np.argsort(days, kind="stable")
            days, rows = days[order], rows.take(order).combine_chunks()
            groups = []
            for some in _grouped(names):
                groups.append([np.concatenate(values.pop(n))[order] for n in some] + arrays.bits_of([np.concatenate(there.pop(n))[order] for n in some], len(order)))
            ends = np.append(np.flatnonzero(days[1:] != days[:-1]) + 1, len(days))
            bodies, at = [], 0
            for end in ends.tolist():
                bodies.append(arrays.framed([arrays.sent(rows.slice(at, end - at)), *[arrays.pack([a[at:end] for a in g]) for g in groups]]))
                at = end
            yield _messages(days[ends - 1], np.zeros(len(ends), np.int64), days[ends - 1], bodies)

        sent = self.apply(panel, rows, MESSAGE, tasks, also)
        return sent.repartition("bucket") if tasks is None else sent.repartition(tasks, "bucket")

    def reads(self) -> list[str]:
        """Raw columns that the factors are made of."""
        needs = arrays.Windows(arrays.Needs(), (1, 1))
        for f in self.factors.values():
            if f.stage < 3:
                needs.columns.setdefault(f.name, f.build(needs))
            else:
                f.build(needs)
        return sorted(n for n in needs.columns if n not in self.factors and not n.startswith("__"))

    def apply(self, panel: DataFrame, rows: Callable, schema: T.StructType, tasks: int | None, keep: tuple[str, ...]) -> DataFrame:
        """What ``rows(table, ranks)`` yields for each chunk of whole entities, with the ranks of stage 3.

        The chunk's columns go to the tasks that rank dates and on to those that make the factors,
        as one compressed message; beside it go the values that are ranked, and come the ranks, as
        a message for each chunk and date.  No row of factors is shuffled.
        """
        wanted = [n for n in self.reads() if n not in keep]
        numbered = panel.select(ts.ENTITY, ts.DATE, *[F.col(n).cast("double").alias(n) for n in wanted], *keep, F.row_number().over(ts.over()).alias(NUMBER))
        ranks = {f.name: f for f in self.factors.values() if f.stage == 3}
        if not ranks:

            def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for table in arrays.chunks(batches, NUMBER):
                    yield from rows(table, {})

            return numbered.mapInArrow(whole, schema)
        bases = {f.base: f for f in ranks.values()}
        kinds = {n: ("rank" if "RANK" in n.split("_") else "tile", list(bases).index(f.base)) for n, f in ranks.items()}
        deal = lambda df, by: df.repartition(by) if tasks is None else df.repartition(tasks, by)
        entity = to_arrow_schema(T.StructType([numbered.schema[ts.ENTITY]]))
        sent = numbered.mapInArrow(_bases_sent(bases), MESSAGE)
        sent = deal(sent, "bucket").groupBy("bucket").applyInArrow(_days_ranked([f.digits for f in bases.values()], list(kinds.values()), entity), MESSAGE)

        def joined(table: pa.Table) -> pa.Table:
            raw, found = _with_ranks(table, list(kinds))
            out = list(rows(raw, found))
            return pa.Table.from_batches(out) if out else none

        none = pa.table([pa.array([], f.type) for f in to_arrow_schema(schema)], schema=to_arrow_schema(schema))
        return deal(sent, "part").groupBy("part").applyInArrow(joined, schema)

    def _maker(self, keep: tuple[str, ...], where: str | None) -> Callable:
        """``make(table, ranks)`` yields (rows, {factor: (values, which are there)}) for each block."""
        stage = {k: [f for f in self.factors.values() if f.stage == k] for k in (1, 2)}
        wanted, ranked = [n for n in self.reads() if n not in keep], [f.name for f in self.factors.values() if f.stage == 3]

        def make(table: pa.Table, ranks: dict[str, np.ndarray]):
            columns = {n: arrays.series(table.column(n).cast("double")) for n in [*wanted, *[k for k in keep if k in reads]]}
            chosen = None if where is None else np.asarray(table.column(where).fill_null(False).combine_chunks().to_numpy(zero_copy_only=False), bool)
            for cells, taken, places in arrays.blocks(np.asarray(table.column(NUMBER))):
                if chosen is not None:
                    inside = chosen[taken]
                    taken, places = taken[inside], places[inside]
                    if not len(taken):
                        continue
                block = arrays.block_of(columns, cells)
                out = {}
                for f in (*stage[1], *stage[2]):
                    s = f.build(block)
                    block.columns.setdefault(f.name, s)
                    out[f.name] = _picked(s, cells.shape, places)
                yield taken, out | {n: (ranks[n][taken], None) for n in ranked}

        reads = set(self.reads())
        return make


NUMBER = "__rn"
#: A message: what it goes by, the chunk it comes from, its date as a number (null for the chunk itself).
MESSAGE = T.StructType([T.StructField(n, T.LongType()) for n in ("bucket", "part", "day")] + [T.StructField("body", T.BinaryType())])
#: Chunks have higher buckets than dates; a missing date has the lowest.
CHUNKS, NO_DATE = 1 << 40, -(1 << 40)


def _grouped(names: list[str]) -> list[list[str]]:
    """Factors of a date that are unpacked together."""
    return [names[k : k + 16] for k in range(0, len(names), 16)]


class Day:
    """Rows of messages, such as all of a date: ``rows`` with keys and other columns, and factors that are unpacked in groups."""

    def __init__(self, bodies: Iterable[pa.BinaryScalar], names: list[str], digits: dict[str, int] | None):
        self.parts = [arrays.unframed(b.as_buffer()) for b in bodies]
        self.names, self.digits = names, digits
        self.rows = pa.concat_tables([arrays.received(p[0]) for p in self.parts]).combine_chunks()

    def factors(self) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
        """(name, values, which are missing) of each factor in order."""
        for k, some in enumerate(_grouped(self.names)):
            found = [arrays.unpack(p[1 + k], [np.float64] * len(some) + [np.uint64])[0] for p in self.parts]
            flags = [np.concatenate([f[len(some)] for f in found])]
            for j, n in enumerate(some):
                values = np.concatenate([f[j] for f in found])
                yield n, values if self.digits is None else values / float(10 ** self.digits[n]), ~arrays.bit(flags, j)


def _picked(s: arrays.Series, shape: tuple[int, int], places: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    values = np.broadcast_to(s.values, shape).reshape(-1)[places]
    if s.valid is None:
        return values, None
    valid = np.broadcast_to(s.valid, shape).reshape(-1)[places]
    return values, None if valid.all() else valid


def _days(table: pa.Table) -> np.ndarray:
    column = table.column(ts.DATE)
    column = column.cast(pa.int32()) if pa.types.is_date32(column.type) else column
    return np.asarray(column.cast(pa.int64()).fill_null(NO_DATE))


def _messages(buckets, parts, days, bodies) -> pa.RecordBatch:
    return pa.record_batch([pa.array(buckets, pa.int64()), pa.array(parts, pa.int64()), pa.array(days, pa.int64()), pa.array(bodies, pa.binary())], names=["bucket", "part", "day", "body"])


def _bases_sent(bases: dict[str, Factor]) -> Callable:
    """Each chunk as a message, and what is ranked of it as one for each date."""
    reads = FactorCatalog([Factor(b, 1, f.lookback, f.build) for b, f in bases.items()]).reads()

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for k, table in enumerate(arrays.chunks(batches, NUMBER)):
            part = (task << 20) + k
            yield _messages([CHUNKS + part], [part], [None], [arrays.sent(table)])
            columns = {n: arrays.series(table.column(n).cast("double")) for n in reads}
            made = {b: (np.zeros(table.num_rows), np.ones(table.num_rows, bool)) for b in bases}
            for cells, taken, places in arrays.blocks(np.asarray(table.column(NUMBER))):
                block = arrays.block_of(columns, cells)
                for b, f in bases.items():
                    values, valid = _picked(f.build(block), cells.shape, places)
                    made[b][0][taken] = values if f.digits is None else arrays.steady(values, f.digits)
                    if valid is not None:
                        made[b][0][taken[~valid]] = 0
                        made[b][1][taken] = valid
            days = _days(table)
            order = np.argsort(days, kind="stable")
            days, entity = days[order], table.select([ts.ENTITY]).take(order).combine_chunks()
            ends = np.append(np.flatnonzero(days[1:] != days[:-1]) + 1, len(days))
            sent = [made[b][0][order] for b in bases] + arrays.bits_of([made[b][1][order] for b in bases], len(order))
            bodies, at = [], 0
            for end in ends.tolist():
                bodies.append(arrays.pack([a[at:end] for a in sent], entity.slice(at, end - at).to_batches()[0].serialize().to_pybytes()))
                at = end
            yield _messages(days[ends - 1], np.full(len(ends), part), days[ends - 1], bodies)

    return send


def _days_ranked(digits: list[int | None], kinds: list[tuple[str, int]], entity: pa.Schema) -> Callable:
    """Ranks of a date in place of what is ranked; chunks pass."""

    def rank(table: pa.Table) -> pa.Table:
        if table.column("bucket")[0].as_py() >= CHUNKS:
            return table
        words = (len(digits) + 63) // 64
        found, entities = [], []
        for body in table.column("body"):
            values, more = arrays.unpack(body.as_buffer(), [np.float64] * len(digits) + [np.uint64] * words)
            found.append(values)
            entities.append(more)
        sizes = [len(f[0]) for f in found]
        size = sum(sizes)
        order = np.arange(size) if not any(kind == "tile" for kind, _ in kinds) else xs.by_entity(pa.Table.from_batches([pa.ipc.read_record_batch(pa.py_buffer(m), entity) for m in entities]))
        tile, made = xs.tiles_of(size, TILES), [None] * len(kinds)
        flags = [np.concatenate([f[len(digits) + k] for f in found]) for k in range(words)]
        for b, n in enumerate(digits):
            value = np.concatenate([f[b] for f in found])
            rows, first, _, _ = xs.peers(value if n is None else value / float(10**n), ~arrays.bit(flags, b), order)
            for k, (kind, base) in enumerate(kinds):
                if base == b:
                    made[k] = np.empty(size, np.int32 if kind == "rank" else np.int8)
                    made[k][rows] = first + 1 if kind == "rank" else tile
        bodies, at = [], 0
        for n in sizes:
            bodies.append(arrays.pack([m[at : at + n] for m in made]))
            at += n
        return pa.table([table.column("bucket"), table.column("part"), table.column("day"), pa.array(bodies, pa.binary())], names=table.column_names)

    return rank


def _with_ranks(table: pa.Table, names: list[str]) -> tuple[pa.Table, dict[str, np.ndarray]]:
    """A chunk and its ranks, in the order of its rows."""
    day = np.asarray(table.column("day").fill_null(0))
    whole = np.asarray(table.column("day").is_null())
    body = table.column("body").combine_chunks()
    raw = arrays.received(body[int(np.flatnonzero(whole)[0])].as_buffer())
    dates = np.flatnonzero(~whole)
    kinds = [np.int32 if "RANK" in n.split("_") else np.int8 for n in names]
    found = [arrays.unpack(body[int(k)].as_buffer(), kinds)[0] for k in dates[np.argsort(day[dates], kind="stable")]]
    order = np.argsort(_days(raw), kind="stable")
    ranks = {}
    for k, n in enumerate(names):
        ranks[n] = np.empty(raw.num_rows, np.int32)
        ranks[n][order] = np.concatenate([f[k] for f in found])
    return raw, ranks


def _of_field(x: str, ratios: bool = True, extremes: bool = True) -> list[Factor]:
    """Lags, means, deviations and extremes of one raw column."""
    out = [Factor(f"REF_{x}_{n}", 1, n + 1, lambda r, n=n: r.div(r.ref(x, n), x) - 1) for n in (1, 2)] if ratios else []
    out += [Factor(f"MEAN_{x}_{n}", 1, n, lambda r, n=n: r.div(r.mean(x, n), x)) for n in WINDOWS]
    out += [Factor(f"STD_{x}_{n}", 1, n, lambda r, n=n: r.std(x, n)) for n in WINDOWS]
    if extremes:
        out += [Factor(f"MAX_{x}_{n}", 1, n, lambda r, n=n: r.high(x, n)) for n in WINDOWS]
        if extremes != "max":
            out += [Factor(f"MIN_{x}_{n}", 1, n, lambda r, n=n: r.low(x, n)) for n in WINDOWS]
    return out


def price_volume() -> FactorCatalog:
    """191 factors over seven raw columns."""
    out: list[Factor] = []
    for x in ("open", "high", "low", "close"):
        out += _of_field(x)
    out += _of_field("volume", extremes="max")
    out += [Factor(f"CORR_volume_{n}", 1, n, lambda r, n=n: r.corr("close", "volume", n)) for n in WINDOWS]
    out += _of_field("amount", extremes=False)
    out += [Factor(f"CORR_amount_{n}", 1, n, lambda r, n=n: r.corr("close", "amount", n)) for n in WINDOWS]
    out += _of_field("vwap", extremes=False)
    based = ["REF_close_1", *(f"MEAN_close_{n}" for n in WINDOWS), *(f"STD_close_{n}" for n in WINDOWS), *(f"CORR_volume_{n}" for n in WINDOWS)]
    known = {f.name: f for f in out}
    for kind in ("RANK", "QUANTILE"):
        out += [Factor(f"{kind}_{b}", 3, known[b].lookback, known[b].build, b, None if b == "REF_close_1" else RANK_DIGITS) for b in based]
    for x in ("close", "volume", "amount"):
        out += [Factor(f"DELTA_{x}_{n}", 1, n + 1, lambda r, n=n, x=x: r.delta(x, n)) for n in WINDOWS]
    # sums this large show at six digits in which order they were added, so these are added in the order of rows
    out += [Factor(f"SUM_close_{n}", 1, n, lambda r, n=n: r.total_ordered("close", n)) for n in WINDOWS]
    return FactorCatalog(out)


def _channel(r, n: int):
    least = r.low("close", n)
    return r.div(r.mean("close", n) - least, r.high("close", n) - least)


def _ema(r, n: int):
    """Ratio of weighted sums; a row weighs ((n-1)/(n+1)) to the power of its place among the last n rows."""
    weight = r.define(f"__w{n}", r.fading((n - 1) / (n + 1), n))
    return r.div(r.total(r.define(f"__cw{n}", r.col("close") * r.col(weight)), n), r.total(weight, n))


def _rsi(r, n: int):
    """A missing change counts as 0 in both averages."""
    change = r.delta("close", 1)
    gain, loss = r.mean(r.define("__gain", r.gain(change)), n), r.mean(r.define("__loss", r.gain(change * -1.0)), n)
    return 100.0 - r.div(r.lit(100.0), 1.0 + r.div(gain, loss))


def extended() -> FactorCatalog:
    """13 price-pattern factors."""
    return FactorCatalog([
        Factor("CHP30", 1, 30, lambda r: r.div(r.col("close") - r.low("low", 30), r.high("high", 30) - r.low("low", 30))),
        Factor("SKEWP10", 1, 10, lambda r: _channel(r, 10)),
        Factor("SKEWP20", 1, 20, lambda r: _channel(r, 20)),
        Factor("GAP", 1, 2, lambda r: r.div("open", r.ref("close", 1)) - 1),
        Factor("DRP", 1, 1, lambda r: r.div(r.col("close") - r.col("low"), r.col("high") - r.col("low"))),
        Factor("O2C", 1, 1, lambda r: r.div("close", "open") - 1),
        Factor("HLC", 1, 1, lambda r: r.div(r.col("high") - r.col("close"), r.col("high") - r.col("low"))),
        Factor("EMA12C", 1, 24, lambda r: _ema(r, 12)),
        Factor("EMA26C", 1, 52, lambda r: _ema(r, 26)),
        Factor("MACD", 2, 52, lambda r: r.col("EMA12C") - r.col("EMA26C")),
        Factor("RSI14", 1, 15, lambda r: _rsi(r, 14)),
        Factor("SLOPE5", 1, 5, lambda r: r.slope("close", 5)),
        Factor("SLOPE20", 1, 20, lambda r: r.slope("close", 20)),
    ])


def fundamental() -> FactorCatalog:
    """8 fundamental factors; min-max names differ from raw columns, which stay readable."""
    return FactorCatalog([
        Factor("PE_TTM_MINMAX_750", 1, 750, lambda r: r.minmax("pe_ttm", 750)),
        Factor("PB_MINMAX_750", 1, 750, lambda r: r.minmax("pb", 750)),
        Factor("ROE_RAW", 1, 1, lambda r: r.div("pb", "pe_ttm")),
        Factor("ROE", 1, 750, lambda r: r.minmax(r.define("__roe", r.div("pb", "pe_ttm")), 750)),
        Factor("MV", 1, 750, lambda r: r.minmax("total_mv", 750)),
        Factor("TURN", 1, 1, lambda r: r.col("turnover_rate")),
        Factor("TURN_RANK", 3, 1, lambda r: r.col("turnover_rate"), "TURN"),
        Factor("VOLRATIO", 1, 1, lambda r: r.col("volume_ratio")),
    ])


def combined() -> FactorCatalog:
    return price_volume() + extended() + fundamental()
