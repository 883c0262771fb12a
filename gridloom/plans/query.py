"""The chainable entity query. Every call adds to one lazy DataFrame plan; ``find`` returns it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators import filters, links
from gridloom.operators.filters import Condition, EntityType, Ontology
from gridloom.operators.reach import EdgeTable, lineage_edges


class Workspace:
    """All tables a query may touch. The edge tables may be functions, called when first needed."""

    def __init__(self, types: dict[str, EntityType], process: EntityType, process_input, process_output, ontology: Ontology):
        self.types = types
        self.process = process
        self.ontology = ontology
        self._input, self._output = process_input, process_output
        self._edges: EdgeTable | None = None

    @property
    def process_input(self) -> DataFrame:
        return self._input() if callable(self._input) else self._input

    @property
    def process_output(self) -> DataFrame:
        return self._output() if callable(self._output) else self._output

    def named_types(self, io: DataFrame) -> DataFrame:
        """Edges with array types shown as ``DDT_<data type>`` in place of their reference prefix."""
        brick = self.types.get("Brick")
        if brick is None:
            return io
        names = brick.df.select("obj_type", F.concat(F.lit("DDT_"), "data_type_term_name").alias("_ddt")).distinct()
        return io.join(names, "obj_type", "left").withColumn("obj_type", F.coalesce("_ddt", "obj_type")).drop("_ddt")

    @property
    def edges(self) -> EdgeTable:
        """Both edge tables as one, stored once in both directions: every walk step reads from it."""
        if self._edges is None:
            self._edges = EdgeTable.store(lineage_edges(self.process_input, self.process_output))
        return self._edges

    def query(self, type_name: str) -> "Query":
        return Query(self, self.types[type_name])

    def find(self, type_name: str, criterion: dict | None = None) -> DataFrame:
        return self.query(type_name).has(criterion).find()

    def find_one(self, type_name: str, criterion: dict | None = None) -> DataFrame:
        return self.query(type_name).has(criterion).find_one()


class Query:
    def __init__(self, workspace: Workspace, etype: EntityType):
        self._ws = workspace
        self._type = etype
        self._has: list[Condition] = []
        self._input_of: list[Condition] = []
        self._output_of: list[Condition] = []
        self._up: list[tuple[EntityType, list[Condition], list[str]]] = []
        self._down: list[tuple[EntityType, list[Condition]]] = []
        self._parents: list[tuple[list[str], list[str]]] = []
        self._all_up = False
        self._all_down = False

    def has(self, criterion: dict | None) -> "Query":
        self._has += filters.parse_criteria(criterion, self._type)
        return self

    def is_input_of_process(self, criterion: dict) -> "Query":
        self._input_of += filters.parse_criteria(criterion, self._ws.process)
        return self

    def is_output_of_process(self, criterion: dict) -> "Query":
        self._output_of += filters.parse_criteria(criterion, self._ws.process)
        return self

    def search_all_up(self, on: bool) -> "Query":
        self._all_up = on
        return self

    def search_all_down(self, on: bool) -> "Query":
        self._all_down = on
        return self

    def linked_up_to(self, type_name: str, criterion: dict | None) -> "Query":
        other = self._ws.types[type_name]
        self._up.append((other, filters.parse_criteria(criterion, other), []))
        return self

    def linked_down_to(self, type_name: str, criterion: dict | None) -> "Query":
        other = self._ws.types[type_name]
        self._down.append((other, filters.parse_criteria(criterion, other)))
        return self

    def linked_up_to_item_with_properties(self, props: list[str], add_properties: bool = False, name: str | None = None) -> "Query":
        """Link to the first type, by name, that has all the properties."""
        names = [name] if name else sorted(self._ws.types)
        fitting = [n for n in names if all(p in self._ws.types[n].props for p in props)]
        if not fitting:
            raise ValueError(f"No type has the properties {', '.join(props)}")
        self._up.append((self._ws.types[fitting[0]], [], list(props) if add_properties else []))
        return self

    def immediate_parent(self, criterion: dict) -> "Query":
        sides = []
        for side in ("processInputs", "processOutputs"):
            wanted = criterion.get(side)
            wanted = [wanted] if isinstance(wanted, str) else wanted
            if not wanted:
                raise ValueError(f"Need at least one of {side}")
            sides.append(list(wanted))
        self._parents.append((sides[0], sides[1]))
        return self

    def find(self) -> DataFrame:
        ws, etype = self._ws, self._type
        if (self._all_up or self._all_down) and not self._output_of:
            raise ValueError("search_all_up and search_all_down need an output-of-process filter")
        rows = filters.apply_conditions(etype.df, self._has, etype, ws.ontology)
        if self._input_of:
            procs = filters.apply_conditions(ws.process.df, self._input_of, ws.process, ws.ontology)
            rows = links.io_of_process(rows, etype.vertex, ws.process_input, procs)
        if self._output_of:
            procs = filters.apply_conditions(ws.process.df, self._output_of, ws.process, ws.ontology)
            if self._all_up or self._all_down:
                rows = links.search_all(
                    rows, etype.vertex, procs, ws.process_input, ws.process_output, ws.edges, self._all_up, self._all_down
                )
            else:
                rows = links.io_of_process(rows, etype.vertex, ws.process_output, procs)
        for inputs, outputs in self._parents:
            made_from, made = ws.process_input, ws.process_output
            if any(name.startswith("DDT_") for name in inputs + outputs):
                made_from, made = ws.named_types(made_from), ws.named_types(made)
            rows = links.immediate_parent(rows, etype.vertex, made_from, made, inputs, outputs)
        for other, conditions, props in self._up:
            start = filters.apply_conditions(other.df, conditions, other, ws.ontology)
            if props:
                start = start.select(other.vertex, *[F.col(other.props[p].column).alias(p) for p in props])
                rows = links.linked_with_props(rows, etype.vertex, start, other.vertex, props, ws.edges)
            else:
                rows = links.linked_up_to(rows, etype.vertex, start.select(F.col(other.vertex).alias("vertex")), ws.edges)
        for other, conditions in self._down:
            start = filters.apply_conditions(other.df, conditions, other, ws.ontology)
            rows = links.linked_down_to(rows, etype.vertex, start.select(F.col(other.vertex).alias("vertex")), ws.edges)
        return rows

    def find_one(self) -> DataFrame:
        return filters.find_one(self.find(), self._type.pk)
