"""A model: cells of matrices by scenario, the labels they stand at, and what can be asked of them. Models don't change; operators return new ones.

A model's cells are a table in the folder that driver and executors share: plans stay as short as one formula, and a lost executor costs no more than
its last tasks. What formulas have in common is kept by Spark (memory, then disk) while it is used."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema
from .plans import blocks as B
from .plans.catalog import CATALOG, Strategy
from .plans.kernels import stored
from .plans.planner import Planner
from .schema import BASELINE, NotComputable, WrongInput, set_name

#: Where the cells of unified supply-use matrices go: by the levels of row and column.
SPLIT = {"Z": {("Commodity", "Activity"): "U", ("Activity", "Commodity"): "S"}, "z": {("Commodity", "Activity"): "u", ("Activity", "Commodity"): "s"}}
SPLIT_ROWS = {"Y": {"Activity": "Ya", "Commodity": "Yc"}}
SPLIT_COLUMNS = {x: {"Activity": f"{x}a", "Commodity": f"{x}c"} for x in "VvEe"}
VECTORS = {"X": "production", "p": "price index"}


def label_id(region: str | Column, level: str | Column, item: str | Column) -> Column:
    """The 64-bit id of a label; absent parts are told from empty ones. Models check that no two labels share one."""
    return F.xxhash64(*[F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("\0")) for c in (region, level, item)])


@dataclass(frozen=True)
class Model:
    kind: str
    cells: DataFrame
    axis: DataFrame
    units: DataFrame
    names: Mapping[str, tuple[str, ...]]
    tech: str = "industry"
    meta: Mapping = field(default_factory=dict)
    clusters: Mapping[str, Mapping[str, tuple[str, ...]]] = field(default_factory=dict)
    operators: Mapping[str, Strategy] = field(default_factory=dict)
    baseline: str = BASELINE

    # --- making

    @staticmethod
    def from_labelled(cells: DataFrame, kind: str, units: DataFrame | None = None, tech: str = "industry", check: bool = True, names: Mapping[str, tuple[str, ...]] | None = None, labels: DataFrame | None = None, **more) -> Model:
        """A model of labelled cells (schema.LABELLED). Cells that stand twice add up, absent ones are zero; null or NaN values are refused.
        X and other results are left out, they are made again; unified supply-use matrices are split by level. labels: region, level, item of labels that
        are part of the model even where they have no cell."""
        if kind not in schema.FLOWS:
            raise WrongInput(f"no kind of table is called {kind!r}")
        spark = cells.sparkSession
        if check and not cells.filter("value is null or isnan(value) or matrix is null or scenario is null").isEmpty():
            raise WrongInput("values that are null or not numbers")
        if kind == "SUT":
            cells = cells.withColumn("matrix", _split_name())
        allowed = {*schema.FLOWS[kind], *schema.COEFFICIENTS[kind]}
        cells = cells.filter(F.col("matrix").isin(*allowed))
        labelled = [f"{c}_{s}" for s in ("from", "to") for c in ("region", "level", "item")]
        whole = cells.groupBy("scenario", "matrix", *labelled).agg(F.sum("value").alias("value"))
        whole = whole.withColumn("i", label_id("region_from", "level_from", "item_from")).withColumn("j", label_id("region_to", "level_to", "item_to"))
        whole = stored(whole)
        sides = [whole.select(*[F.col(f"{c}_{s}").alias(c) for c in ("region", "level", "item")]) for s in ("from", "to")]
        sides = sides if labels is None else [*sides, labels.select("region", "level", "item")]
        axis = reduce(DataFrame.union, sides).distinct().select(label_id("region", "level", "item").alias("id"), "region", "level", "item").persist()
        if check and not axis.groupBy("id").count().filter("count > 1").isEmpty():
            raise WrongInput("two labels share an id")
        ids = whole.select("scenario", "matrix", "i", "j", "value")
        if names is None:
            found: dict[str, list[str]] = {}
            for r in ids.select("scenario", "matrix").distinct().collect():  # a name for each matrix, not its cells
                found.setdefault(r["scenario"], []).append(r["matrix"])
            names = {k: tuple(sorted(v)) for k, v in found.items()}
        units = units if units is not None else spark.createDataFrame([], schema.UNITS)
        return Model(kind, ids, axis, units, names, tech, **more)

    def with_blocks(self, scenario: str, blocks: Mapping[str, DataFrame], keep: Iterable[str] = (), axis: DataFrame | None = None) -> Model:
        """This model with a scenario of exactly these blocks and, of its own before, those in keep."""
        old = self.names.get(scenario, ())
        kept = [m for m in old if m in set(keep) and m not in blocks]
        cells = self.cells.filter((F.col("scenario") != scenario) | F.col("matrix").isin(*kept)) if old else self.cells
        if blocks:
            rows = [b.select(F.lit(scenario).alias("scenario"), F.lit(name).alias("matrix"), "i", "j", "value") for name, b in blocks.items()]
            cells = cells.unionByName(stored(reduce(DataFrame.unionByName, rows)))
        names = {**self.names, scenario: tuple(sorted([*kept, *blocks]))}
        return replace(self, cells=cells, names=names, axis=self.axis if axis is None else axis)

    # --- labels

    @property
    def spark(self) -> SparkSession:
        return self.cells.sparkSession

    @property
    def levels(self) -> tuple[str, ...]:
        return schema.LEVELS[self.kind]

    def ids(self, level: str) -> DataFrame:
        return self.axis.filter(F.col("level") == level).select("id")

    @cached_property
    def sizes(self) -> dict[str, int]:
        return {r["level"]: r["count"] for r in self.axis.groupBy("level").count().collect()}

    def size(self, level: str) -> int:
        return self.sizes.get(level, 0)

    def index(self, name: str) -> DataFrame:
        """The labels of a set, as item; regions are those of every label that has one."""
        level = set_name(name, self.kind)
        if level == "Region":
            return self.axis.filter("region is not null").select(F.col("region").alias("item")).distinct()
        return self.axis.filter(F.col("level") == level).select("item").distinct()

    def search(self, pattern: str, name: str | None = None, ignore_case: bool = True) -> DataFrame:
        """level, item of labels that a regular expression finds."""
        levels = [set_name(name, self.kind)] if name else ["Region", *self.sizes]
        found = None
        for level in levels:
            some = self.index(level).filter(F.col("item").rlike(("(?i)" if ignore_case else "") + pattern)).select(F.lit(level).alias("level"), "item")
            found = some if found is None else found.union(some)
        return found

    @property
    def scenarios(self) -> tuple[str, ...]:
        return tuple(sorted(self.names))

    @property
    def is_multi_region(self) -> bool:
        return self.index("Region").count() > 1

    @property
    def is_hybrid(self) -> bool:
        """Whether the goods and factors are counted in more than one unit."""
        levels = {"IOT": ("Sector", "Factor of production"), "SUT": ("Activity", "Commodity", "Factor of production")}[self.kind]
        return self.units.filter(F.col("level").isin(*levels)).select("unit").distinct().count() > 1

    def same_sets(self, other: Model) -> bool:
        """Whether both have the same kind and labels."""
        return self.kind == other.kind and all(a.exceptAll(b).isEmpty() for a, b in ((self.axis, other.axis), (other.axis, self.axis)))

    # --- notes

    def note(self, text: str) -> Model:
        """The model with a dated line in its history."""
        line = f"{datetime.now(timezone.utc):%Y-%m-%d %H:%M:%S} {text}"
        return replace(self, meta={**self.meta, "history": (*self.meta.get("history", ()), line)})

    def describe(self, **meta) -> Model:
        """The model with entries (name, year, source, price, licence, ...) in its metadata."""
        return replace(self, meta={**self.meta, **meta})

    def save_meta(self, path: str) -> None:
        """Metadata and history as one JSON line, in any store that Spark writes."""
        line = json.dumps({"kind": self.kind, "tech": self.tech, **self.meta}, default=str, sort_keys=True)
        self.spark.createDataFrame([(line,)], "value string").coalesce(1).write.text(path)

    # --- blocks

    def has(self, matrix: str, scenario: str | None = None) -> bool:
        return matrix in self.names.get(scenario or self.baseline, ())

    def stored_block(self, matrix: str, scenario: str | None = None) -> DataFrame:
        return self.cells.filter((F.col("scenario") == (scenario or self.baseline)) & (F.col("matrix") == matrix)).select("i", "j", "value")

    def planner(self, scenario: str | None = None, method: str | None = None) -> Planner:
        scenario = scenario or self.baseline
        if scenario not in self.names:
            raise WrongInput(f"no scenario is called {scenario!r}")
        return Planner(self, scenario, method)

    def resolve(self, matrix: str, scenario: str | None = None, method: str | None = None) -> DataFrame:
        """The block of a matrix, made if need be."""
        return self.planner(scenario, method).resolve(matrix)

    def resolve_many(self, matrices: Iterable[str], scenario: str | None = None, method: str | None = None) -> dict[str, DataFrame]:
        planner = self.planner(scenario, method)
        return {m: planner.resolve(m) for m in matrices}

    def explain(self, matrix: str, scenario: str | None = None, method: str | None = None) -> str:
        """How a matrix would be made, as an indented tree."""
        return "\n".join(self.planner(scenario, method).plan(matrix).lines())

    def calc_all(self, matrices: Iterable[str] | None = None, scenario: str | None = None, method: str | None = None, force: bool = False) -> Model:
        """This model with matrices made and kept; force makes those anew that are kept already and can be made."""
        scenario = scenario or self.baseline
        wanted = list(matrices) if matrices is not None else [m for m, s in CATALOG[self.kind].items() if s]
        base = self.without(wanted, scenario) if force else self
        planner, made = base.planner(scenario, method), {}
        for m in wanted:
            if base.has(m, scenario):
                continue
            try:
                made[m] = planner.resolve(m)
            except NotComputable:
                if self.has(m, scenario):
                    made[m] = self.stored_block(m, scenario)
                elif matrices is not None:
                    raise
        return base.with_blocks(scenario, made, base.names[scenario])

    def without(self, matrices: Iterable[str], scenario: str) -> Model:
        gone = set(matrices)
        return self.with_blocks(scenario, {}, [m for m in self.names.get(scenario, ()) if m not in gone])

    def labelled(self, block: DataFrame, vector: str | None = None) -> DataFrame:
        """region_from, level_from, item_from, region_to, level_to, item_to, value of a block; a vector's column is called `vector`."""
        side = lambda s, k: self.axis.select(F.col("id").alias(k), *[F.col(c).alias(f"{c}_{s}") for c in ("region", "level", "item")])
        rows = block.join(side("from", "i"), "i")
        if vector is not None:
            return rows.select("region_from", "level_from", "item_from", F.lit(None).cast("string").alias("region_to"), F.lit(None).cast("string").alias("level_to"), F.lit(vector).alias("item_to"), "value")
        return rows.join(side("to", "j"), "j").select(*[f"{c}_{s}" for s in ("from", "to") for c in ("region", "level", "item")], "value")

    def labelled_cells(self, scenarios: Iterable[str] | None = None) -> DataFrame:
        """All stored cells with their labels (schema.LABELLED)."""
        cells = self.cells if scenarios is None else self.cells.filter(F.col("scenario").isin(*scenarios))
        side = lambda s, k: self.axis.select(F.col("id").alias(k), *[F.col(c).alias(f"{c}_{s}") for c in ("region", "level", "item")])
        rows = cells.join(side("from", "i"), "i").join(side("to", "j"), "j")
        return rows.select("scenario", "matrix", *[f"{c}_{s}" for s in ("from", "to") for c in ("region", "level", "item")], "value")

    def table(self, matrix: str, scenario: str | None = None, method: str | None = None) -> DataFrame:
        """A matrix with its labels."""
        vector = VECTORS.get(matrix[0]) if matrix[0] in VECTORS and matrix in ("X", "Xa", "Xc", "p", "pa", "pc") else None
        return self.labelled(self.resolve(matrix, scenario, method), vector)

    def query(self, matrices: Iterable[str], scenarios: Iterable[str] | None = None, base: str | None = None, relative: bool = False) -> dict[str, dict[str, DataFrame]]:
        """Blocks by scenario and matrix; with a base scenario, how much they differ from its blocks (or by what share of them)."""
        out: dict[str, dict[str, DataFrame]] = {}
        against = self.planner(base) if base else None
        for s in scenarios or (self.baseline,):
            planner = self.planner(s)
            out[s] = {m: B.difference(planner.resolve(m), against.resolve(m), relative) if against else planner.resolve(m) for m in matrices}
        return out

    # --- scenarios

    def clone_scenario(self, scenario: str, name: str) -> Model:
        if scenario not in self.names or name in self.names:
            raise WrongInput(f"{scenario!r} must be a scenario and {name!r} must not")
        copy = self.cells.filter(F.col("scenario") == scenario).withColumn("scenario", F.lit(name))
        return replace(self, cells=self.cells.unionByName(copy), names={**self.names, name: self.names[scenario]})

    def rename_scenario(self, scenario: str, name: str) -> Model:
        if scenario not in self.names or name in self.names:
            raise WrongInput(f"{scenario!r} must be a scenario and {name!r} must not")
        cells = self.cells.withColumn("scenario", F.when(F.col("scenario") == scenario, name).otherwise(F.col("scenario")))
        names = {name if k == scenario else k: v for k, v in self.names.items()}
        return replace(self, cells=cells, names=names, baseline=name if scenario == self.baseline else self.baseline)

    def drop_scenarios(self, keep: Iterable[str] | None = None) -> Model:
        keep = set(keep or (self.baseline,)) | {self.baseline}
        return replace(self, cells=self.cells.filter(F.col("scenario").isin(*keep)), names={k: v for k, v in self.names.items() if k in keep})

    def build_new(self, scenario: str) -> Model:
        """A model whose baseline is this one's scenario."""
        only = replace(self, cells=self.cells.filter(F.col("scenario") == scenario), names={scenario: self.names[scenario]}, baseline=scenario)
        return only if scenario == BASELINE else only.rename_scenario(scenario, BASELINE)

    def update_scenario(self, scenario: str, **blocks: DataFrame) -> Model:
        """Other blocks in place of a scenario's; all that could be derived from the old ones goes."""
        allowed = {*schema.FLOWS[self.kind], *schema.COEFFICIENTS[self.kind]}
        if wrong := set(blocks) - allowed:
            raise WrongInput(f"can't be given: {sorted(wrong)}")
        flows = any(m in schema.FLOWS[self.kind] and m not in schema.COEFFICIENTS[self.kind] for m in blocks)
        base = self.reset(scenario, "flows" if flows else "coefficients") if not all(m in (*schema.FLOWS[self.kind][-2:], "Y", "Ya", "Yc") for m in blocks) else self.reset(scenario, "coefficients")
        return base.with_blocks(scenario, blocks, base.names[scenario])

    def reset(self, scenario: str | None = None, to: str = "flows") -> Model:
        """A scenario of only the flows, or only the coefficients with final demand, that the rest is made from."""
        scenario = scenario or self.baseline
        wanted = (schema.FLOWS if to == "flows" else schema.COEFFICIENTS)[self.kind]
        planner, made = self.planner(scenario), {}
        for m in wanted:
            if self.has(m, scenario):
                continue
            try:
                made[m] = planner.resolve(m)
            except NotComputable:
                continue
        return self.with_blocks(scenario, made, wanted)

    def change_assumption(self, tech: str) -> Model:
        """Another technology assumption ("industry" or "product"); every scenario goes back to its flows."""
        if tech not in ("industry", "product") or self.kind != "SUT":
            raise WrongInput("the technology assumption is industry or product, of a supply-use table")
        out = self
        for s in self.names:
            out = out.reset(s, "flows")
        return replace(out, tech=tech)

    def add_scenario(self, other: Model, name: str) -> Model:
        """Another model's baseline as a scenario; kind, labels and units must agree."""
        same_units = all(a.exceptAll(b).isEmpty() for a, b in ((self.units, other.units), (other.units, self.units)))
        if name in self.names or not self.same_sets(other) or self.tech != other.tech or not same_units:
            raise WrongInput("kind, labels, units and assumption must agree, and the name be new")
        cells = other.cells.filter(F.col("scenario") == other.baseline).withColumn("scenario", F.lit(name))
        return replace(self, cells=self.cells.unionByName(cells), names={**self.names, name: other.names[other.baseline]})

    def with_clusters(self, **clusters: Mapping[str, Iterable[str]]) -> Model:
        """Named groups of a set's labels, for shocks and trade."""
        known = {k: dict(v) for k, v in self.clusters.items()}
        for name, groups in clusters.items():
            known.setdefault(set_name(name.replace("_", " "), self.kind), {}).update({k: tuple(v) for k, v in groups.items()})
        return replace(self, clusters=known)

    def rename_units(self, level: str, old: str, new: str) -> Model:
        """Another name for a unit; no value changes."""
        at = (F.col("level") == set_name(level, self.kind)) & (F.col("unit") == old)
        return replace(self, units=self.units.withColumn("unit", F.when(at, new).otherwise(F.col("unit"))))


def _split_name() -> Column:
    """The split name of a supply-use matrix."""
    out = F.col("matrix")
    for whole, parts in SPLIT.items():
        for (rows, columns), name in parts.items():
            out = F.when((F.col("matrix") == whole) & (F.col("level_from") == rows) & (F.col("level_to") == columns), name).otherwise(out)
    for table, side in ((SPLIT_ROWS, "level_from"), (SPLIT_COLUMNS, "level_to")):
        for whole, parts in table.items():
            for level, name in parts.items():
                out = F.when((F.col("matrix") == whole) & (F.col(side) == level), name).otherwise(out)
    return out
