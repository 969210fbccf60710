"""A rulebase or session at rest: its analysis, its answers by route, and swapping it while it is asked.

Every answer is a plan over relations; nothing is computed before it is asked for. State is replaced as a whole: an answer
is made from one state, whatever is swapped meanwhile."""

from __future__ import annotations

import threading
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import names
from .operators import annotations as A
from .operators import callgraph, depgraph, extract, hierarchy, lookup, memory, nodes, resolution, sourcing, synthesis
from .runtime import cut
from .sources.session import Session, layer_of, read_layers, write_export

#: How a session's own evidence is added to the layers that are given.
MODES = ("none", "reuse", "auto-detect-from-rulebase", "auto-detect-from-memory", "auto-detect")
GENERATED, MEMORY = "generated", "memory"


@dataclass(frozen=True)
class Spec:
    """source: layers, lowest first (paths, {rule: {key: value}} or entries); enrichment: one of MODES; what a caller knows of
    constructors (specs, spec_resolver), of arguments (resolver), and of facts that stand for functions: functions(type, var)."""

    source: tuple = ()
    enrichment: str | None = None
    specs: DataFrame | None = None
    spec_resolver: Callable | None = None
    resolver: Callable | None = None
    functions: DataFrame | None = None

    @staticmethod
    def of(x) -> Spec:
        if isinstance(x, Spec):
            return x
        if x is None:
            return Spec()
        if isinstance(x, dict) and set(x) & {"source", "enrichment"}:
            s = x.get("source")
            return Spec(tuple(s) if isinstance(s, (list, tuple)) else (() if s is None else (s,)), x.get("enrichment"))
        return Spec(tuple(x) if isinstance(x, (list, tuple)) else (x,))


def sourced(session: Session) -> Session:
    """The session with the relations of a source analysis that it lacks, read from its texts.

    Namespaces that own rules are read from assembled texts: right sides that the session has come after the text there is, or
    one made from the namespace's mappings."""
    if "usages" in session.tables or not {"sources", "mappings"} & set(session.tables):
        return session
    texts, productions = session["sources"], session["productions"]
    made = synthesis.combined(productions.filter("rhs <> ''"), sourcing.namespace_texts(texts), session["mappings"], session["var_defs"])
    every = cut(synthesis.all_texts(texts, made), "texts")
    found = sourcing.read(every)
    usages = synthesis.pruned_usages(found.usages, productions, made)
    return replace(session, tables=found.tables() | session.tables | {"usages": usages, "sources": every})


def aliases_of(session: Session, conds: DataFrame, functions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """usages with those of facts that are functions of their own, and by which alias each caller is reached.

    functions(type, var): the variable that a bound fact of a type stands for."""
    usages = session["usages"]
    bound = extract.bindings(conds).withColumnRenamed("prod", "rule")
    own = usages.select(callgraph.qualified(F.col("from"), F.col("from_var")).alias("rule"), "name")
    pairs = cut(callgraph.alias_pairs(bound, own, functions), "pairs")
    more = cut(callgraph.alias_usages(pairs).withColumn("usage_id", -1 - F.monotonically_increasing_id()), "aliases")
    every = usages.unionByName(more)
    near = callgraph.reachable(callgraph.calls(every), pairs.select("var").distinct(), callgraph.BOUNDARY, itself=True).toDF("inserter", "node")
    return every, callgraph.alias_contexts(pairs, near)


def generated(session: Session, spec: Spec, pos: int) -> DataFrame:
    """The layer of what the source says: inferred callsites of all rules."""
    session = sourced(session)
    p = session["productions"]
    rules = extract.rule_names(p).withColumnRenamed("name", "rule")
    conds = extract.conditions(p)
    usages, aliases = aliases_of(session, conds, spec.functions) if spec.functions is not None else (session["usages"], None)
    sites = resolution.infer(rules, usages, session["sources"], session["locals"], session["local_usages"], session["records"], spec.specs, spec.spec_resolver, spec.resolver, aliases, extract.rulebase_types(conds), session["ancestors"])
    return resolution.entries(cut(sites, "inferred"), rules, GENERATED, pos)


def static_layers(session: Session, spec: Spec) -> DataFrame:
    """Entries of the productions' own properties, the given layers and, in the modes that ask for it, the generated one,
    unless a given layer has its id."""
    every = A.props_layer(session["productions"])
    for i, x in enumerate(spec.source, 1):
        if isinstance(x, DataFrame):
            every = every.unionByName(x.withColumn("layer_pos", F.lit(i).cast("int")))
        elif isinstance(x, dict):
            every = every.unionByName(layer_of(session.spark, x, "source" if len(spec.source) == 1 else f"source-{i}", i))
        elif isinstance(x, str):
            every = every.unionByName(read_layers(session.spark, [x], i))
        else:
            raise TypeError(f"a layer is a path, a dict or entries, not {type(x).__name__}")
    if spec.enrichment in ("auto-detect-from-rulebase", "auto-detect") and not every.filter(F.col("layer") == GENERATED).limit(1).count():
        every = every.unionByName(generated(session, spec, len(spec.source) + 1))
    return every


def resolved(session: Session, spec: Spec, current: DataFrame | None = None) -> DataFrame:
    """The entries that hold for a session: see MODES. With reuse and no source, those that held before."""
    if spec.enrichment not in (None, *MODES):
        raise ValueError(f"enrichment is one of {MODES}, not {spec.enrichment}")
    if spec.enrichment == "reuse" and not spec.source and current is not None:
        return current
    entries = cut(static_layers(session, spec), "layers")
    if spec.enrichment in ("auto-detect-from-memory", "auto-detect") and session.working_memory:
        seen = A.memory_types(session["facts"], session["insertions"])
        more = A.memory_delta(A.merge(entries, bindings=session.names), seen, session.names)
        entries = cut(entries.unionByName(A.as_layer(more, MEMORY, len(spec.source) + 2)), "layers")
    return entries


class Analysis:
    """The relations of a rulebase under its annotations, each computed when it is first asked for."""

    def __init__(self, session: Session, entries: DataFrame):
        self.session, self.entries = session, entries

    @cached_property
    def merged(self) -> A.Merged:
        return A.merge(self.entries, bindings=self.session.names)

    @cached_property
    def productions(self) -> DataFrame:
        return extract.with_namespace(extract.latest(self.session["productions"]))

    @cached_property
    def usage(self) -> DataFrame:
        return cut(extract.usage(extract.conditions(self.productions), self.merged.types), "usage")

    @cached_property
    def ancestors(self) -> DataFrame:
        """(type, ancestor) of all types in use; a given hierarchy of parents is closed."""
        return cut(hierarchy.closure(self.session["ancestors"], "type", "ancestor"), "ancestors")

    @cached_property
    def up(self) -> DataFrame:
        types = self.usage.select("type").unionByName(self.ancestors.select("type")).unionByName(self.ancestors.select(F.col("ancestor").alias("type"))).distinct()
        return hierarchy.reflexive(self.ancestors, types)

    @cached_property
    def summaries(self) -> DataFrame:
        rows = depgraph.summaries(self.productions, self.usage, self.up, self.merged.scalars)
        d = self.merged.detections.groupBy(F.col("rule").alias("name")).agg(F.max(F.when(F.col("dim") == "insert", F.col("resolution"))).alias("insert_resolution"), F.max(F.when(F.col("dim") == "retract", F.col("resolution"))).alias("retract_resolution"))
        forms = extract.lhs_forms(self.productions)
        return cut(rows.join(d, "name", "left").join(forms, "name", "left"), "summaries")

    @cached_property
    def types(self) -> DataFrame:
        direct = self.usage.select("type").distinct()
        above = self.ancestors.join(direct, "type", "left_semi")
        near = above.select("type").unionByName(above.select(F.col("ancestor").alias("type"))).distinct()
        ordered = hierarchy.ordered_ancestors(self.ancestors.join(near, "type", "left_semi"))
        return cut(depgraph.fact_types(self.productions, self.usage, ordered, hierarchy.ordered_descendants(ordered)), "types")

    @cached_property
    def nodes(self) -> DataFrame:
        return nodes.summaries(self.session["nodes"])

    @cached_property
    def unresolved(self) -> DataFrame:
        """Rules whose text speaks of insertions or retractions though no types are declared."""
        text = self.productions.select(F.col("name").alias("prod"), "kind", "rhs").filter("kind = 'rule'")
        return depgraph.unresolved(text, self.usage, "rhs", ("insert!", "insert-unconditional!", "retract!"))

    @cached_property
    def production_ids(self) -> DataFrame:
        return depgraph.route_index(self.productions)

    @cached_property
    def type_ids(self) -> DataFrame:
        return depgraph.route_index(self.types)

    @cached_property
    def detections(self) -> DataFrame:
        """rule, dim, resolution and the rows of its callsites: source, ns, filename, status, types, constructor and chain."""
        from .operators import callsites

        known = self.types.select(F.col("name").alias("t"), "known")
        via = callsites.field("via")
        s = self.merged.sites.select("rule", "dim", "pos", "callsite_id", callsites.field("source-str").alias("source"), callsites.field("ns-name-sym").alias("ns"), callsites.field("filename").alias("filename"), callsites.field("status").alias("status"), callsites.field("constructor-sym").alias("constructor"), F.from_json(callsites.field("resolved-types"), "array<string>").alias("resolved"), resolution.provenance_chain(F.col("rule"), via).alias("chain"))
        t = s.select("rule", "dim", "pos", F.posexplode("resolved").alias("i", "t")).join(known, "t", "left").groupBy("rule", "dim", "pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "t", "known"))), lambda x: names.type_ref(x["t"], x["known"])).alias("types"))
        rows = s.drop("resolved").join(t, ["rule", "dim", "pos"], "left")
        per = rows.groupBy("rule", "dim").agg(F.array_sort(F.collect_list(F.struct("pos", "source", "ns", "filename", "status", "types", "constructor", "chain"))).alias("callsites"))
        return self.merged.detections.join(per, ["rule", "dim"], "left")

    @cached_property
    def production_index(self) -> lookup.Index:
        """Whole answers of productions, by route id."""
        d = self.detections.groupBy(F.col("rule").alias("name")).agg(F.collect_list(F.struct("dim", "resolution", "callsites")).alias("detections"))
        return lookup.written(cut(self.summaries.join(d, "name", "left"), "answers"), "id")

    @cached_property
    def type_index(self) -> lookup.Index:
        return lookup.written(self.types.drop("place"), "id")

    @cached_property
    def session_type_index(self) -> lookup.Index:
        m = self.memory
        near = lambda role: m.groups(role).groupBy(F.col("type").alias("name")).agg(F.array_sort(F.collect_list(F.struct("place", "name", "id", "ns", "kind", "facts"))).alias(role))
        return lookup.written(cut(m.types().join(near("inserted_from"), "name", "left").join(near("used_by"), "name", "left"), "answers"), "id")

    @cached_property
    def session_facts(self) -> DataFrame:
        return cut(self.memory.facts(), "answers")

    @cached_property
    def fact_index(self) -> lookup.Index:
        return lookup.written(self.session_facts, "id")

    @cached_property
    def activity_index(self) -> lookup.Index:
        """What each production matched, with bindings, and what it inserted, by its name."""
        m = self.memory
        facts = self.session_facts.withColumnRenamed("id", "fact_id")
        fact = F.struct(F.col("fact_id").alias("id"), "type", "ns", "data", "is_root", "inserted_from", "used_by").alias("fact")
        met = m.activity().join(facts, "fact_id").select("prod", F.lit("match").alias("what"), fact, "bindings", F.col("fact_id").alias("place"))
        made = m.inserted().join(facts, "fact_id").select("prod", F.lit("inserted").alias("what"), fact, F.array().cast("array<string>").alias("bindings"), "place")
        return lookup.written(cut(met.unionByName(made), "answers"), "prod")

    @cached_property
    def counts(self) -> dict[str, int]:
        p = self.productions.agg(F.count_if(F.col("kind") == "rule").alias("r"), F.count_if(F.col("kind") == "query").alias("q")).first()
        return {"rule-count": p["r"], "query-count": p["q"], "fact-type-count": self.types.count()}

    @cached_property
    def memory(self) -> memory.Memory:
        s = self.session
        order = memory.type_order(extract.read_types(extract.conditions(self.productions)))
        return memory.Memory(s["facts"], s["activations"], s["matches"], s["insertions"], self.productions, order, self.types.select(F.col("name").alias("type")))


@dataclass(frozen=True, eq=False)
class State:
    session: Session
    spec: Spec
    entries: DataFrame


def started(session: Session, spec=None) -> State:
    s = Spec.of(spec)
    return State(session, s, resolved(session, s))


def swapped(state: State, session: Session | None = None, spec=None) -> State:
    """A new session or the same one, under a new specification; without one, only the productions' own properties."""
    s, now = Spec.of(spec), session or state.session
    return State(now, s, resolved(now, s, state.entries))


def reloaded(state: State) -> State:
    """The same session and specification; layers are read from their files again."""
    return replace(state, entries=resolved(state.session, state.spec, state.entries))


class NotFound(LookupError):
    status = 404


class NoWorkingMemory(LookupError):
    """reason: rulebase-input, where there is no session, or disabled-by-config."""

    status = 409

    def __init__(self, reason: str):
        super().__init__(reason)
        self.reason = reason


@dataclass
class Cache:
    """The analysis of the last session and annotations that were asked for; others are built again."""

    state: State | None = None
    analysis: Analysis | None = None
    lock: threading.Lock = field(default_factory=threading.Lock)

    def get(self, state: State) -> Analysis:
        with self.lock:
            old = self.state
            if old is None or old.session is not state.session or old.entries is not state.entries:
                self.state, self.analysis = state, Analysis(state.session, state.entries)
            return self.analysis

    def warm(self, state: State) -> None:
        a = self.get(state)
        a.summaries.count(), a.types.count()
        if state.session.working_memory:
            a.memory.ids.count()


LIST = ("name", "id", "ns", "doc", "lhs_types", "insert_types", "retract_types", "source", "sink", "unlinked", "no_output", "insert_resolution", "retract_resolution")


class Engine:
    """Answers by route. get(route) returns a DataFrame of the answer's rows, or a dict for a summary."""

    def __init__(self, session: Session, spec=None, working_memory: bool = True, warm: bool = False):
        self.working_memory, self.cache = working_memory, Cache()
        self.state: State | None = started(session, spec)
        self._swap = threading.Lock()
        if warm:
            self.cache.warm(self.state)

    def swap(self, session: Session | None = None, spec=None, warm: bool = False) -> None:
        with self._swap:
            now = swapped(self._require(), session, spec)
            if warm:
                self.cache.warm(now)
            self.state = now

    def reload(self) -> None:
        with self._swap:
            self.state = reloaded(self._require())

    def stop(self) -> None:
        self.state, self.cache = None, Cache()

    def _require(self) -> State:
        if self.state is None:
            raise RuntimeError("the engine isn't started")
        return self.state

    @property
    def analysis(self) -> Analysis:
        return self.cache.get(self._require())

    def _memory(self) -> memory.Memory:
        if not self.working_memory:
            raise NoWorkingMemory("disabled-by-config")
        if not self._require().session.working_memory:
            raise NoWorkingMemory("rulebase-input")
        return self.analysis.memory

    def _one(self, index: lookup.Index, value, kind: str | None = None) -> DataFrame:
        """The answer with this id, of productions those of a kind; written when the first one is asked for, and read by its id."""
        out = index.get(value)
        out = out if kind is None else out.filter(F.col("kind") == kind)
        if not out.limit(1).count():
            raise NotFound(value)
        return out

    def summary(self) -> dict:
        return self.analysis.counts | {"working-memory-available": self.working_memory and self._require().session.working_memory}

    def rules(self, kind: str = "rule") -> DataFrame:
        return self.analysis.summaries.filter(F.col("kind") == kind).orderBy("prod_ord").select(*LIST[:5], "params", "upstream", "downstream") if kind == "query" else self.analysis.summaries.filter(F.col("kind") == kind).orderBy("prod_ord").select(*LIST)

    def production(self, kind: str, ident: str) -> DataFrame:
        return self._one(self.analysis.production_index, ident, kind)

    def fact_types(self) -> DataFrame:
        return self.analysis.types.orderBy("place").drop("ancestors", "descendants", "place")

    def fact_type(self, ident: str) -> DataFrame:
        return self._one(self.analysis.type_index, ident)

    def session_types(self) -> DataFrame:
        return self._memory().types()

    def session_type(self, ident: str) -> DataFrame:
        self._memory()
        return self._one(self.analysis.session_type_index, ident)

    def fact(self, ident: int) -> DataFrame:
        self._memory()
        return self._one(self.analysis.fact_index, int(ident))

    def activity(self, kind: str, ident: str) -> DataFrame:
        """What a production matched, with bindings, and what it inserted (rules alone): rows (what, fact, bindings, place)."""
        self._memory()
        name = self._one(self.analysis.production_index, ident, kind).first()["name"]
        out = self.analysis.activity_index.get(name).drop("prod")
        return out.filter(F.lit(kind == "rule") | (F.col("what") == "match")).orderBy("what", "place")

    def annotations(self) -> DataFrame:
        return self.analysis.merged.annotations()

    def elements(self, node: str) -> DataFrame:
        """The facts that a node holds, by id."""
        m = self._memory()
        return memory.node_elements(self._require().session["elements"].filter(F.col("node") == node), m.ids).orderBy("fact_id", "bindings")

    def tokens(self, node: str) -> DataFrame:
        """The partial matches that a node holds."""
        m = self._memory()
        return memory.node_tokens(self._require().session["tokens"].filter(F.col("node") == node), m.ids).orderBy("token")

    def export(self, root: str) -> None:
        """All answers, written once: lists as they are, and a folder for each object that they name."""
        a = self.analysis
        by = lambda kind: a.summaries.filter(F.col("kind") == kind)
        tree = {"rules": by("rule"), "queries": by("query"), "fact-types": a.types.drop("place"), "annotations": self.annotations()}
        tree["rulebase-summary"] = a.session.spark.createDataFrame([tuple(self.summary().values())], ", ".join(f"`{k}` {'boolean' if isinstance(v, bool) else 'long'}" for k, v in self.summary().items()))
        if self.working_memory and self._require().session.working_memory:
            ids = a.summaries.select(F.col("name").alias("prod"), "id", "kind")
            rows = a.activity_index.all().join(ids, "prod")
            tree |= {"session/fact-types": a.session_type_index.all(), "session/facts": a.session_facts}
            tree |= {f"session/{many}": rows.filter(F.col("kind") == kind).filter(F.lit(kind == "rule") | (F.col("what") == "match")).drop("kind") for kind, many in (("rule", "rules"), ("query", "queries"))}
        write_export(tree, root)

    def routes(self) -> dict[str, Callable]:
        """Route patterns: a trailing * is an id."""
        return {
            "/v1/rulebase-summary": self.summary,
            "/v1/rulebase-analysis": lambda: self.analysis.summaries,
            "/v1/rules": self.rules,
            "/v1/rules/*": lambda i: self.production("rule", i),
            "/v1/queries": lambda: self.rules("query"),
            "/v1/queries/*": lambda i: self.production("query", i),
            "/v1/fact-types": self.fact_types,
            "/v1/fact-types/*": self.fact_type,
            "/v1/session/fact-types": self.session_types,
            "/v1/session/fact-types/*": self.session_type,
            "/v1/session/facts/*": self.fact,
            "/v1/session/rules/*": lambda i: self.activity("rule", i),
            "/v1/session/queries/*": lambda i: self.activity("query", i),
            "/v1/session/elements/*": self.elements,
            "/v1/session/tokens/*": self.tokens,
            "/v1/memory-analysis": lambda: self._memory() and self.analysis.session_facts,
            "/v1/annotations": self.annotations,
        }

    def get(self, route: str) -> DataFrame | dict:
        """The answer of a route; names never stand for ids. An unknown route or id is NotFound."""
        table, (head, _, tail) = self.routes(), route.rstrip("/").rpartition("/")
        if route.rstrip("/") in table:
            return table[route.rstrip("/")]()
        if f"{head}/*" in table and tail:
            return table[f"{head}/*"](tail)
        raise NotFound(route)


__all__ = ["Analysis", "Cache", "Engine", "NoWorkingMemory", "NotFound", "Spec", "State", "reloaded", "resolved", "started", "swapped"]
