"""A request by example: columns per table plus split, scenario, dataset and place."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scenelake.plans.catalog import Catalog, Edge
from scenelake.plans.scenarios import SCENARIOS, Scenario
from scenelake.plans.selection import Selection
from scenelake.plans.shards import shuffled, with_shards
from scenelake.sources.payloads import DECODERS, decode

SPLITS = ("all", "training", "validation", "testing")


@dataclass(frozen=True)
class SceneQuery:
    """Immutable request; plans from the catalog's DataFrames.

    ``limit=0`` means no limit. A limit or an offset always sorts by a total
    order: the asked-for column, else a default uid, then the tables' keys.
    Such a page is a filter between two keys, whatever its size. They are found
    by counting when the request is built; nothing is sorted, numbered or
    written for it. Counts and types need no page.
    """

    catalog: Catalog
    data: Mapping[str, Sequence[str]]
    splits: Sequence[str] = ("all",)
    scenario: str | Scenario = "all"
    datasets: Sequence[str] = ("all",)
    location: str | None = None
    orderby: str | None = None
    limit: int = 0
    offset: int = 0
    late_payloads: bool = True

    def __post_init__(self) -> None:
        if not isinstance(self.data, Mapping) or not self.data:
            raise ValueError("data must map table names to column lists")
        for table, columns in self.data.items():
            missing = [c for c in columns if c not in self.catalog.table(table).columns]
            if missing:
                raise ValueError(f"table {table!r} has no column {missing}")
        unknown = [s for s in self.splits if s not in SPLITS]
        if unknown or not self.splits:
            raise ValueError(f"invalid split {unknown}; known: {SPLITS}")
        if isinstance(self.scenario, str) and self.scenario not in SCENARIOS:
            raise ValueError(f"invalid scenario {self.scenario!r}; known: {sorted(SCENARIOS)}")
        if self.limit < 0 or self.offset < 0:
            raise ValueError("limit and offset must not be negative")

    # -- what is asked for ------------------------------------------------

    @cached_property
    def _conditions(self) -> dict[str, tuple[str, ...]]:
        """Accepted values per filter column; ``all`` anywhere in a list means no filter."""
        scenario = SCENARIOS[self.scenario] if isinstance(self.scenario, str) else self.scenario
        wanted = dict(scenario.conditions)
        if "all" not in self.splits:
            wanted["split"] = tuple(self.splits)
        if "all" not in self.datasets:
            wanted["dataset"] = tuple(self.datasets)
        if self.location:
            wanted["location"] = (self.location,)
        return wanted

    @cached_property
    def _filters(self) -> dict[tuple[str, str], tuple[str, ...]]:
        return {(self.catalog.owner(c), c): values for c, values in self._conditions.items()}

    @property
    def tables(self) -> list[str]:
        """Requested tables in request order, then the ones only filters or the order need."""
        extra = [table for table, _ in self._filters]
        if self.orderby and not any(self.orderby in self.catalog.table(t).columns for t in self.data):
            extra.append(self.catalog.owner(self.orderby))
        return list(dict.fromkeys([*self.data, *extra]))

    @property
    def columns(self) -> list[tuple[str, str]]:
        return [(table, column) for table, columns in self.data.items() for column in columns]

    @cached_property
    def names(self) -> list[str]:
        """Output names: the plain column, or ``table__column`` where two tables share it."""
        plain = [column for _, column in self.columns]
        return [c if plain.count(c) == 1 else f"{t}__{c}" for t, c in self.columns]

    def steps(self) -> list[Edge]:
        steps = self.catalog.join_path(self.tables)
        return self.catalog.skip_unused_parents(steps, set(self.tables))

    # -- order --------------------------------------------------------------

    def default_order(self) -> tuple[str, str]:
        """The uid a limit sorts by when no order is given.

        A split or dataset filter brings its table into the choice.
        """
        filtered = [t for t, c in self._filters if c in ("split", "dataset")]
        tables = list(dict.fromkeys([*self.data, *filtered]))
        for table in tables:
            if table in ("weather", "camera", "lidar"):
                return table, "weather_uid"
        for table in tables:
            if "camera" in table:
                return table, "camera_uid"
            if "lidar" in table:
                return table, "lidar_uid"
        raise ValueError(f"no uid column to order {list(self.data)} by; give orderby")

    def _order_source(self) -> tuple[str, str]:
        if not self.orderby:
            return self.default_order()
        owners = [t for t in self.tables if self.orderby in self.catalog.table(t).columns]
        requested = [t for t in owners if self.orderby in self.data.get(t, ())]
        return (requested or owners)[0], self.orderby

    def _joined_tables(self) -> list[str]:
        return list(dict.fromkeys([self.tables[0], *(s.target for s in self.steps())]))

    def order_columns(self) -> list[tuple[str, str]]:
        """Sort column, then the keys of all joined tables: a total order even under fan-out."""
        keys = [(t, k) for t in self._joined_tables() for k in self.catalog.keys.get(t, ())]
        return list(dict.fromkeys([self._order_source(), *keys]))

    # -- plans --------------------------------------------------------------

    def _matching(self) -> DataFrame:
        joined = self.catalog.join(self.tables[0], self.steps())
        tests = [F.col(f"{t}.{c}").isin(*values) for (t, c), values in self._filters.items()]
        return joined.where(reduce(Column.__and__, tests)) if tests else joined

    def _ordered(self) -> bool:
        return bool(self.orderby or self.limit or self.offset)

    def _payloads(self) -> list[tuple[str, str]]:
        """Requested binary and array columns of tables whose key can fetch them later."""
        wide = (T.BinaryType, T.ArrayType)
        return [
            (t, c)
            for t, c in self.columns
            if isinstance(self.catalog.table(t).schema[c].dataType, wide)
            and self.catalog.keys.get(t)
            and c not in self.catalog.keys[t]
        ]

    def _page(self, df: DataFrame, order: list[str]) -> DataFrame:
        """Rows offset to offset + limit of the order, found by counting; the first ranges are drawn from
        the table that holds the leading column.
        """
        table, column = self._order_source()
        leading = self.catalog.table(table).select(column)
        return Selection(df, order).page(self.offset, self.limit, leading)

    def _narrow(self) -> tuple[DataFrame, list[Column], list[tuple[str, str]]]:
        """Matching rows before paging: result columns ``_c<i>``, sort columns ``_o<i>``,
        the sort order, and the payload columns left for ``_fetch``.
        """
        wanted = {tc: F.col(f"{tc[0]}.{tc[1]}").alias(f"_c{i}") for i, tc in enumerate(self.columns)}
        if not self._ordered():
            return self._matching().select(*wanted.values()), [], []
        sort_by = self.order_columns()
        sort = [F.col(f"{t}.{c}").alias(f"_o{i}") for i, (t, c) in enumerate(sort_by)]
        order = [F.col(f"_o{i}").asc_nulls_last() for i in range(len(sort_by))]
        late = self._payloads() if self.late_payloads and (self.limit or self.offset) else []
        early = [column for tc, column in wanted.items() if tc not in late]
        return self._matching().select(*early, *sort), order, late

    def _paged(self) -> tuple[DataFrame, list[Column], list[tuple[str, str]]]:
        narrow, order, late = self._narrow()
        if self.limit or self.offset:
            narrow = self._page(narrow, [f"_o{i}" for i in range(len(self.order_columns()))])
        return narrow, order, late

    def _fetch(self, page: DataFrame, late: list[tuple[str, str]]) -> DataFrame:
        """Join the payload columns back onto the rows that survived the page."""
        position = {tc: i for i, tc in enumerate(self.columns)}
        sort_by = self.order_columns() if late else []
        for table in dict.fromkeys(t for t, _ in late):
            keys = self.catalog.keys[table]
            payload = self.catalog.table(table).select(
                *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
                *[F.col(c).alias(f"_c{position[(t, c)]}") for t, c in late if t == table],
            )
            match = [F.col(f"_o{sort_by.index((table, k))}") == F.col(f"_k{i}") for i, k in enumerate(keys)]
            page = page.join(payload, reduce(Column.__and__, match)).drop(
                *[f"_k{i}" for i in range(len(keys))]
            )
        return page

    def _named(self) -> list[Column]:
        return [F.col(f"_c{i}").alias(name) for i, name in enumerate(self.names)]

    def build(self) -> DataFrame:
        """The requested columns, exactly in request order."""
        page, order, late = self._paged()
        plan = self._fetch(page, late)
        return (plan.orderBy(*order) if order else plan).select(*self._named())

    def decoded(self, decoders: Mapping | None = None) -> DataFrame:
        """The request with its binary payloads as typed arrays; ``decoders`` replaces the known ones by column."""
        known = DECODERS if decoders is None else {**DECODERS, **decoders}
        # Two tables may share a column name; both are decoded alike.
        return decode(self.build(), {n: known[c] for n, (_, c) in zip(self.names, self.columns) if c in known})

    def count_frame(self) -> DataFrame:
        """Row count of the request including limit and offset, as a one-row DataFrame."""
        left = F.greatest(F.count("*") - F.lit(self.offset), F.lit(0))
        return self._matching().agg((F.least(left, F.lit(self.limit)) if self.limit else left).cast("long").alias("n_rows"))

    def count(self) -> int:
        return self.count_frame().first()["n_rows"]

    def dtypes(self) -> list[tuple[str, str]]:
        return self._unpaged().build().dtypes

    def _unpaged(self) -> SceneQuery:
        return replace(self, limit=0, offset=0, orderby=None)

    def dataset_samples(self) -> DataFrame:
        """Samples per dataset over the whole catalog."""
        table = self.catalog.table(self.catalog.owner("dataset"))
        return table.groupBy("dataset").agg(F.count("dataset").alias("samples"))

    def mean_first(self) -> DataFrame:
        """Mean of the first requested column, 0 for an empty result.

        Arrays average by position (``pos``, ``pos_1``, ... for nested ones),
        structs by field (``mean_<field>``).
        """
        table, column = self.columns[0]
        kind = self.catalog.table(table).schema[column].dataType
        rows, at = self.build().select(F.col(f"`{self.names[0]}`").alias("v")), []
        while isinstance(kind, T.ArrayType):
            at.append(f"pos_{len(at)}" if at else "pos")
            rows = rows.select(*at[:-1], F.posexplode("v").alias(at[-1], "v"))
            kind = kind.elementType
        if isinstance(kind, T.StructType):
            means = [F.avg(f"v.{f}").alias(f"mean_{f}") for f in kind.names]
        else:
            means = [(F.avg("v") if at else F.coalesce(F.avg("v"), F.lit(0.0))).alias("mean")]
        return rows.groupBy(*at).agg(*means)

    # -- delivery -----------------------------------------------------------

    def with_shards(self, shards: int) -> DataFrame:
        """The request's rows with a ``shard`` number, in contiguous runs of the order."""
        request = self if self._ordered() else replace(self, orderby=self._order_source()[1])
        page, order, late = request._paged()
        return request._fetch(with_shards(page, order, shards), late).select(
            *request._named(), "row_idx", "shard"
        )

    def shard(self, index: int, shards: int) -> DataFrame:
        return self.with_shards(shards).where(F.col("shard") == index).orderBy("row_idx").drop("row_idx", "shard")

    def shuffle(self, seed: int, key: Sequence[str], shards: int = 0) -> DataFrame:
        """Rows in a seeded order with their ``position``; with ``shards``, numbered inside each shard."""
        if not shards:
            return shuffled(self.build(), key, seed)
        return shuffled(self.with_shards(shards).drop("row_idx"), key, seed, ["shard"])

    def iterate(self) -> Iterator[Row]:
        """Rows in order, one partition in driver memory at a time."""
        return self.build().toLocalIterator(prefetchPartitions=True)

    def batches(self, size: int = 1000) -> Iterator[list[Row]]:
        batch: list[Row] = []
        for row in self.iterate():
            batch.append(row)
            if len(batch) == size:
                yield batch
                batch = []
        if batch:
            yield batch

    def map_batches(self, fn: Callable, schema: str | T.StructType) -> DataFrame:
        """Apply ``fn(pandas.DataFrame) -> pandas.DataFrame`` to Arrow batches of the request."""

        def apply(frames):
            for frame in frames:
                yield fn(frame)

        return self.build().mapInPandas(apply, schema)


def get_field(df: DataFrame, field_name: str) -> DataFrame:
    """One column of a result, by column name."""
    if field_name not in df.columns:
        raise KeyError(f"field not found: {field_name}")
    return df.select(field_name)


def set_field(df: DataFrame, field_name: str, value: Column) -> DataFrame:
    """Replace one existing column of a result."""
    if field_name not in df.columns:
        raise KeyError(f"field not found: {field_name}")
    return df.withColumn(field_name, value)
