"""A space: a set of terms, with its algebra, pattern queries and one-shot rewriting.

Facts (functor s1 … sn) of symbols may be kept as a relation: a table of typed columns c1 … cn by functor and arity. Patterns on it become predicates
on these columns, which reach the files, and equi-joins. All other terms are generic: a table of term (canonical string), functor, arity, is_ground, and
node, a map from paths to (kind, arity, sym, sub). Ground terms are matched by predicates and equi-joins on these alone. Only terms with variables,
narrowed the same way, are unified in Python. No term is in both parts.
A space is immutable: every change gives a new one, so forks and snapshots are the handle itself.
"""

import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.session import cut
from factloom.terms import MAX_BYTES, Var, canon, nodes, parse, parse_all, raw, render, symbol, valid, variables
from factloom.unify import canonical, specificity_of, unified

NODE = T.StructType().add("kind", "string").add("arity", "integer").add("sym", "string").add("sub", "string")
ATOMS = T.StructType().add("term", "string").add("functor", "string").add("arity", "integer").add("is_ground", "boolean").add("node", T.MapType(T.StringType(), NODE)).add("rejected", "boolean")
GENERIC = [f.name for f in ATOMS.fields if f.name != "rejected"]
#: Functors and arities that a space knows of its generic terms; with more it counts any as present. Parts that a table is copied to where pairs must be tried.
KINDS, SPREAD = 1000, 16
#: A symbol that begins so names a mutable cell.
CELL = "&cell:"

Key = tuple[str, int]


@dataclass(frozen=True)
class Kinds:
    """(functor, arity) of ground terms and of terms with variables; None for any. A functor is None where it is no symbol, an arity -1 for no expression."""

    ground: frozenset | None
    schematic: frozenset | None

    def __or__(self, other: "Kinds") -> "Kinds":
        both = lambda a, b: None if a is None or b is None else a | b
        return Kinds(both(self.ground, other.ground), both(self.schematic, other.schematic))


NO_KINDS = Kinds(frozenset(), frozenset())


def _head(term) -> str | None:
    return term[0] if isinstance(term, tuple) and term and isinstance(term[0], str) else None


def _arity(term) -> int:
    return len(term) if isinstance(term, tuple) else -1


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of any number of terms to rows of atoms."""
    schema = pa.schema([("term", pa.string()), ("functor", pa.string()), ("arity", pa.int32()), ("is_ground", pa.bool_()),
                        ("node", pa.map_(pa.string(), pa.struct([("kind", pa.string()), ("arity", pa.int32()), ("sym", pa.string()), ("sub", pa.string())]))), ("rejected", pa.bool_())])
    for batch in batches:
        for start in range(0, batch.num_rows, 1000):
            out = []
            for text in batch.column(0).slice(start, 1000).to_pylist():
                for term in parse_all(text or ""):
                    term = canon(term)
                    parts = [(p, {"kind": k, "arity": a, "sym": s, "sub": t}) for p, k, a, s, t in nodes(term)]
                    out.append({"term": render(term), "functor": _head(term), "arity": _arity(term), "is_ground": not variables(term), "node": parts, "rejected": not valid(term)})
            yield pa.RecordBatch.from_pylist(out, schema)


def atoms_of(texts: DataFrame) -> DataFrame:
    """The atoms in a table whose only column is text; each once."""
    return texts.mapInArrow(_rows, ATOMS).dropDuplicates(["term"])


def _is_text(kind: T.DataType) -> bool:
    return not isinstance(kind, T.IntegralType | T.BooleanType)


def text_of(column: Column, kind: T.DataType) -> Column:
    """A typed value as a symbol: its string, in quotes if it holds white space, brackets and the like."""
    text = column.cast("string")
    if not _is_text(kind):
        return text
    quoted = F.concat(F.lit('"'), F.regexp_replace(text, r'(["\\])', r"\\$1"), F.lit('"'))
    return F.when(text.rlike(r'^[^\s();"$][^\s();"]*$'), text).otherwise(quoted)


def _fits(column: Column, kind: T.DataType) -> Column:
    """The envelope for a typed value."""
    fits = column.isNotNull()
    return fits & F.octet_length(column.cast("string")).between(1, MAX_BYTES) if _is_text(kind) else fits


def _equals(column: Column, kind: T.DataType, sym: str) -> Column:
    """Whether a typed value is a symbol, as a predicate on the plain column wherever its type allows."""
    if isinstance(kind, T.IntegralType):
        return column == F.lit(int(sym)) if re.fullmatch(r"0|-?[1-9]\d*", sym) and abs(int(sym)) < 2**63 else F.lit(False)
    if isinstance(kind, T.StringType):
        return column == F.lit(raw(sym)) if symbol(raw(sym)) == sym else F.lit(False)
    if isinstance(kind, T.BooleanType):
        return column == F.lit(sym == "true") if sym in ("true", "false") else F.lit(False)
    return text_of(column, kind) == F.lit(sym)


def _columns(rows: DataFrame) -> list[tuple[Column, T.DataType]]:
    return [(F.col(f"`{f.name}`"), f.dataType) for f in rows.schema.fields]


def _term(functor: str, rows: DataFrame) -> Column:
    return F.concat(F.lit(f"({functor}"), *(x for c, k in _columns(rows) for x in (F.lit(" "), text_of(c, k))), F.lit(")"))


def as_atoms(key: Key, rows: DataFrame) -> DataFrame:
    """A relation as generic terms, without Python."""
    functor, arity = key
    term = _term(functor, rows)
    leaf = lambda sym: F.struct(F.lit("sym").alias("kind"), F.lit(0).alias("arity"), sym.alias("sym"), sym.alias("sub"))
    top = F.struct(F.lit("expr").alias("kind"), F.lit(arity).alias("arity"), F.lit(None).cast("string").alias("sym"), term.alias("sub"))
    entries = [F.lit(""), top, F.lit("0"), leaf(F.lit(functor))] + [x for i, (c, k) in enumerate(_columns(rows)) for x in (F.lit(str(i + 1)), leaf(text_of(c, k)))]
    return rows.select(term.alias("term"), F.lit(functor).alias("functor"), F.lit(arity).alias("arity"), F.lit(True).alias("is_ground"), F.create_map(*entries).alias("node"))


def path_predicates(pattern) -> tuple[list[Column], dict[Var, list[str]], list[tuple[str, str]]]:
    """Predicates on `node` that a pattern asks of ground terms, the paths of its variables, and (path, symbol) of its constants."""
    tests, places, constants = [], {}, []
    at = lambda p: F.element_at("node", F.lit(p))
    for path, kind, arity, sym, _ in nodes(pattern):
        if kind == "expr":
            tests.append((at(path)["kind"] == "expr") & (at(path)["arity"] == arity))
        elif kind == "sym":
            constants.append((path, sym))
            tests.append(at(path)["sym"] == sym)

    def walk(term, path):
        if isinstance(term, Var):
            places.setdefault(term, []).append(path)
        elif isinstance(term, tuple):
            for i, x in enumerate(term):
                walk(x, f"{path}.{i}" if path else str(i))

    walk(pattern, "")
    for paths in places.values():
        tests += [at(paths[0])["sub"] == at(p)["sub"] for p in paths[1:]]
    return tests, places, constants


def _might_match(constants) -> list[Column]:
    """What terms with variables must meet: at each constant's path that symbol, or a variable there or above."""
    tests = []
    for path, sym in constants:
        steps = path.split(".") if path else []
        ups = [".".join(steps[:i]) for i in range(len(steps) + 1)]
        var = reduce(lambda a, b: a | b, (F.coalesce(F.element_at("node", F.lit(u))["kind"] == "var", F.lit(False)) for u in ups))
        tests.append(var | F.coalesce(F.element_at("node", F.lit(path))["sym"] == sym, F.lit(False)))
    return tests


def factors_of(pattern) -> list:
    return list(pattern[1:]) if isinstance(pattern, tuple) and pattern and pattern[0] == "," else [pattern]


def classify(pattern) -> tuple[Key, dict[int, str], list[Var]] | None:
    """(key, symbols by place, variables) of a factor that pushed filters on a relation answer; None for all others: a variable
    functor, a compound argument, a repeated variable, no argument or none bound."""
    if not _head(pattern) or len(pattern) < 2 or any(isinstance(x, tuple) for x in pattern[1:]):
        return None
    free = [x for x in pattern[1:] if isinstance(x, Var)]
    bound = {i: x for i, x in enumerate(pattern) if i and isinstance(x, str)}
    return ((pattern[0], len(pattern)), bound, free) if bound and len(set(free)) == len(free) else None


def _as_int(x: Column) -> Column:
    text = x.cast("string")
    return F.when(text.rlike(r"^-?\d{1,18}$"), text).cast("bigint")


#: Relations that are computed rather than stored, by functor: how many arguments they ask for, and whether these stand in it, or the one that follows from them.
ARITHMETIC: dict[str, tuple[int, Callable[..., Column]]] = {
    "gtFn": (2, lambda a, b: _as_int(a) > _as_int(b)),
    "lte": (2, lambda a, b: _as_int(a) <= _as_int(b)),
    "addFn": (2, lambda a, b: (_as_int(a) + _as_int(b)).cast("string")),
    "incFn": (1, lambda a: (_as_int(a) + 1).cast("string")),
    "decFn": (1, lambda a: (_as_int(a) - 1).cast("string")),
}


class Space:
    def __init__(
        self, generic: DataFrame | None = None, rejected: Iterable[DataFrame] = (), version: int = 0, relations: dict[Key, DataFrame] | None = None,
        kinds: Kinds | None = None, spark: SparkSession | None = None, cells: DataFrame | None = None, functions: dict | None = None,
    ):
        self.generic, self.relations, self._rejected, self.version = generic, dict(relations or {}), tuple(rejected), version
        self._kinds = NO_KINDS if generic is None else kinds
        self.cells, self.functions, self.id = cells, dict(functions or {}), uuid.uuid4().hex
        self.spark = spark or (generic if generic is not None else next(iter(self.relations.values()))).sparkSession

    def _with(self, **changes) -> "Space":
        own = {"generic": self.generic, "rejected": self._rejected, "version": self.version + 1, "relations": self.relations, "kinds": self._kinds, "spark": self.spark, "cells": self.cells, "functions": self.functions}
        return Space(**(own | changes))

    # ---- making, storing
    @classmethod
    def from_texts(cls, texts: DataFrame) -> "Space":
        every = cut(atoms_of(texts))
        return cls(every.where("not rejected").drop("rejected"), [every.where("rejected")])

    @classmethod
    def from_text(cls, spark: SparkSession, text: str, slices: int = 1) -> "Space":
        terms = [canon(t) for t in parse_all(text)]
        kind = lambda some: frozenset((_head(t), _arity(t)) for t in some)
        texts = spark.createDataFrame([(render(t),) for t in terms], "text string").repartition(slices)
        space = cls.from_texts(texts)
        space._kinds = Kinds(kind(t for t in terms if not variables(t)), kind(t for t in terms if variables(t)))
        return space

    @classmethod
    def read_text(cls, spark: SparkSession, path: str) -> "Space":
        """A file of terms. If every line closes what it opens, lines are parsed on their own, in parallel; else each file as a whole."""
        lines = spark.read.text(path).withColumnRenamed("value", "text")
        bare = F.regexp_replace("text", r'"(?:[^"\\]|\\.)*"|;[^\n]*', "")
        depth = F.aggregate(F.regexp_extract_all(bare, F.lit("[()]"), F.lit(0)), F.lit(0), lambda n, c: F.when(n < 0, n).otherwise(n + F.when(c == "(", 1).otherwise(-1)))
        split = lines.where((depth != 0) | bare.contains('"')).isEmpty()
        return cls.from_texts(lines if split else spark.read.text(path, wholetext=True))

    @classmethod
    def from_columns(cls, functor: str, rows: DataFrame, unique: bool = False) -> "Space":
        """The relation (functor c1 … cn) of a table's columns. Rows with a null or a value outside the envelope are rejected.

        `unique` says that no row comes twice, so that they need not be compared.
        """
        if symbol(raw(functor)) != functor or not 0 < len(rows.columns) < 63:
            raise ValueError("not a functor with 1 to 62 arguments")
        fits = reduce(lambda a, b: a & b, (_fits(c, k) for c, k in _columns(rows)))
        rel = rows.where(fits).toDF(*(f"c{i + 1}" for i in range(len(rows.columns))))
        return cls(relations={(functor, len(rows.columns) + 1): rel if unique else rel.distinct()}, rejected=[rows.where(~fits)])

    def promote(self, functor: str, arity: int) -> "Space":
        """With the generic facts of one functor and arity that hold symbols alone as a relation of strings."""
        if self.generic is None or (functor, arity) in self.relations:
            return self
        at = [F.element_at("node", F.lit(str(i)))["sym"] for i in range(1, arity)]
        flat = reduce(lambda a, b: a & b, (c.isNotNull() for c in at), F.col("is_ground") & (F.col("functor") == functor) & (F.col("arity") == arity))
        plain = lambda c: F.when(c.startswith('"'), F.regexp_replace(F.expr("substring(_s, 2, length(_s) - 2)"), r"\\(.)", "$1")).otherwise(c)
        rel = self.generic.where(flat)
        for i, c in enumerate(at):
            rel = rel.withColumn("_s", c).withColumn(f"c{i + 1}", plain(F.col("_s")))
        rel = rel.select(*(f"c{i + 1}" for i in range(len(at))))
        return self._with(generic=self.generic.where(~F.coalesce(flat, F.lit(False))), relations=self.relations | {(functor, arity): rel}, kinds=None)

    def save(self, path: str) -> None:
        """Each relation as a table of its own, the generic terms by functor and arity, and a list of them."""
        parts = []
        for i, ((functor, arity), rows) in enumerate(sorted(self.relations.items(), key=lambda x: x[0])):
            rows.write.mode("overwrite").parquet(f"{path}/relation-{i}")
            parts.append((f"relation-{i}", functor, arity))
        if self.generic is not None:
            self.generic.write.mode("overwrite").partitionBy("functor", "arity").parquet(f"{path}/generic")
            parts.append(("generic", None, None))
        self.spark.createDataFrame(parts, "name string, functor string, arity int").coalesce(1).write.mode("overwrite").parquet(f"{path}/parts")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> "Space":
        """A saved space."""
        generic, relations = None, {}
        for r in spark.read.parquet(f"{path}/parts").collect():
            stored = spark.read.parquet(f"{path}/{r.name}")
            if r.functor is None:
                generic = stored.withColumn("arity", F.col("arity").cast("int")).withColumn("functor", F.col("functor").cast("string")).select(*GENERIC)
            else:
                relations[r.functor, r.arity] = stored
        return cls(generic, relations=relations, spark=spark)

    def load(self, path: str) -> "Space":
        """This space with the stored terms added."""
        return self.union(Space.read(self.spark, path))

    def dump(self, path: str) -> None:
        self.atoms.select("term").write.mode("overwrite").text(path)

    def snapshot(self) -> "Space":
        return self

    fork = snapshot

    def pinned(self) -> "Space":
        """The same space with all its tables written."""
        kept = lambda df: df if df is None or getattr(df, "_factloom_stored", False) else cut(df)
        return self._with(generic=kept(self.generic), relations={k: kept(r) for k, r in self.relations.items()}, version=self.version)

    # ---- looking
    @property
    def atoms(self) -> DataFrame:
        """All terms in the generic form."""
        parts = [as_atoms(k, r) for k, r in self.relations.items()] + ([] if self.generic is None else [self.generic.select(*GENERIC)])
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], T.StructType(ATOMS.fields[:-1]))

    def kinds(self) -> Kinds:
        """What generic terms there are; looked up once for a space that was read or computed."""
        if self._kinds is None:

            def some(rows):
                found = rows.select("functor", "arity").distinct().limit(KINDS + 1).collect()
                return frozenset((r.functor, r.arity) for r in found) if len(found) <= KINDS else None

            self._kinds = Kinds(some(self.generic.where("is_ground")), some(self.generic.where("not is_ground")))
        return self._kinds

    def count(self) -> int:
        return sum(r.count() for r in self.relations.values()) + (0 if self.generic is None else self.generic.count())

    def is_empty(self) -> bool:
        return all(r.isEmpty() for r in self.relations.values()) and (self.generic is None or self.generic.isEmpty())

    def rejected_count(self) -> int:
        return sum(r.count() for r in self._rejected)

    def is_ground(self) -> bool:
        return self.kinds().schematic == frozenset()

    def __repr__(self):
        return f"Space({self.count()} atoms)"

    def sharded(self, n: int) -> "Space":
        """Dealt over n shards by hash of the whole fact."""
        return self._with(generic=None if self.generic is None else self.generic.repartition(n, "term"), relations={k: r.repartition(n, *r.columns) for k, r in self.relations.items()})

    def shard_counts(self, n: int) -> DataFrame:
        """(shard, n): how many terms each of n shards by hash holds; they add up to the count."""
        shard = F.pmod(F.xxhash64("term"), F.lit(n)).alias("shard")
        return self.atoms.groupBy(shard).agg(F.count("*").alias("n"))

    def visit(self) -> Iterator[str]:
        """All terms in stored order, a partition at a time."""
        from factloom.operators.order import in_order

        return (r.term for r in in_order(self.atoms.select("term")).toLocalIterator())

    def grounded(self) -> DataFrame:
        """(display, type): the typed values that relations hold, by what they print; of several types with one display the first in order counts."""
        parts = [
            rows.select(text_of(c, k).alias("display"), F.lit(k.simpleString()).alias("type")) for rows in self.relations.values() for c, k in _columns(rows) if not isinstance(k, T.StringType)
        ]
        every = reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], "display string, type string")
        return every.groupBy("display").agg(F.min("type").alias("type"))

    def has_cells(self) -> bool:
        """Whether a term holds a mutable cell."""
        return not self.atoms.where(F.exists(F.map_values("node"), lambda x: x["sym"].startswith(CELL))).isEmpty()

    # ---- algebra
    def add(self, *terms: str) -> "Space":
        return self.union(Space.from_text(self.spark, " ".join(terms)))

    def union(self, other: "Space") -> "Space":
        relations = dict(self.relations)
        for key, rows in other.relations.items():
            if key in relations:
                own = relations[key]
                if own.schema.simpleString() != rows.schema.simpleString():
                    own, rows = (r.select(*(F.col(c).cast("string").alias(c) for c in r.columns)) for r in (own, rows))
                rows = own.unionByName(rows).distinct()
            relations[key] = rows
        parts = [g.select(*GENERIC) for g in (self.generic, other.generic) if g is not None]
        generic = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]).dropDuplicates(["term"]) if parts else None
        kinds = None if self._kinds is None or other._kinds is None else self._kinds | other._kinds
        made = self._with(relations=relations, generic=generic, kinds=kinds, rejected=self._rejected + other._rejected)
        return made._apart()

    def _apart(self) -> "Space":
        """Without the generic terms that relations hold."""
        ground = None if self._kinds is None else self._kinds.ground
        keys = [k for k in self.relations if self.generic is not None and (ground is None or k in ground)]
        if not keys:
            return self
        held = reduce(DataFrame.unionByName, [self.relations[k].select(_term(k[0], self.relations[k]).alias("term")) for k in keys])
        same = reduce(lambda a, b: a | b, ((F.col("functor") == k[0]) & (F.col("arity") == k[1]) for k in keys)) & F.col("is_ground")
        same = F.coalesce(same, F.lit(False))
        self.generic = self.generic.where(~same).unionByName(self.generic.where(same).join(held, "term", "left_anti").select(*self.generic.columns))
        return self

    def _sift(self, other: "Space", how: str) -> "Space":
        terms = other.atoms.select("term")
        relations = {}
        for key, rows in self.relations.items():
            theirs, ground = other.relations.get(key), other.kinds().ground
            if (ground is not None and key not in ground) and (theirs is None or theirs.schema.simpleString() == rows.schema.simpleString()):
                empty = rows if how == "left_anti" else rows.where(F.lit(False))
                relations[key] = empty if theirs is None else rows.join(theirs, rows.columns, how)
            else:
                relations[key] = rows.withColumn("_term", _term(key[0], rows)).join(terms.withColumnRenamed("term", "_term"), "_term", how).select(*rows.columns)
        return self._with(relations=relations, generic=None if self.generic is None else self.generic.join(terms, "term", how).select(*GENERIC))

    def intersect(self, other: "Space") -> "Space":
        return self._sift(other, "left_semi")

    def subtract(self, other: "Space") -> "Space":
        return self._sift(other, "left_anti")

    def without(self, terms: DataFrame) -> "Space":
        """Less the canonical terms in a table whose only column is term."""
        relations = {k: r.withColumn("term", _term(k[0], r)).join(terms, "term", "left_anti").select(*r.columns) for k, r in self.relations.items()}
        return self._with(relations=relations, generic=None if self.generic is None else self.generic.join(terms, "term", "left_anti").select(*GENERIC))

    def remove(self, term: str) -> tuple["Space", bool]:
        t = canon(parse(term))
        key = (_head(t), _arity(t))
        if key in self.relations and all(isinstance(x, str) for x in t):
            rows = self.relations[key]
            same = reduce(lambda a, b: a & b, (_equals(c, k, x) for (c, k), x in zip(_columns(rows), t[1:], strict=True)))
            if not rows.where(same).isEmpty():
                return self._with(relations=self.relations | {key: rows.where(~same)}), True
        if self.generic is None:
            return self, False
        same = F.col("term") == render(t)
        had = not self.generic.where(same).isEmpty()
        return (self._with(generic=self.generic.where(~same)), True) if had else (self, False)

    def replace(self, old: str, new: str) -> tuple["Space", bool]:
        without, had = self.remove(old)
        return (without.add(new), True) if had else (self, False)

    def restrict(self, pattern: str) -> "Space":
        """Terms under the pattern's ground beginning: what follows its first variable doesn't matter."""
        term, tests = parse(pattern), []
        at = lambda p: F.element_at("node", F.lit(p))
        for path, kind, arity, sym, _ in nodes(term):
            if kind == "var":
                break
            tests.append(at(path)["arity"] == arity if kind == "expr" else at(path)["sym"] == sym)
        relations = {}
        for key, rows in self.relations.items():
            if isinstance(term, tuple) and len(term) == key[1] and (not _head(term) or _head(term) == key[0]):
                for (c, k), x in zip(_columns(rows), term[1:], strict=True):
                    if isinstance(x, Var) or isinstance(term[0], Var):
                        break
                    rows = rows.where(_equals(c, k, x) if isinstance(x, str) else F.lit(False))
                relations[key] = rows
            elif isinstance(term, Var):
                relations[key] = rows
        return self._with(relations=relations, generic=None if self.generic is None else reduce(DataFrame.where, tests, self.generic))

    # ---- cells and computed relations
    def with_cells(self, values: DataFrame) -> "Space":
        """With cells set: `values` has id and value, a canonical term. A symbol &cell:id in a fact is that cell, whatever its value is by then."""
        new = values.select(F.col("id").cast("string").alias("id"), "value")
        if self.cells is not None:
            new = new.unionByName(self.cells.join(new.select("id"), "id", "left_anti"))
        return self._with(cells=new)

    def with_functions(self, functions: dict | None = None) -> "Space":
        """With relations computed from their bound arguments, `ARITHMETIC` if none are named."""
        return self._with(functions=self.functions | (ARITHMETIC if functions is None else functions))

    # ---- queries
    def query(self, pattern: str, ordered: bool = False) -> DataFrame:
        """A row of canonical strings for each match, a column for each variable; a bag, as matches are.

        `ordered` sorts by specificity, facts that agree with a pattern before those where just one of both has a variable, and then by stored order.
        A cell in the pattern stands for its present value: it matches cells of that value; a variable bound to a cell shows the value.
        """
        term = parse(pattern)
        names = list(variables(term))
        if not factors_of(term):
            return self.spark.range(1).select()
        if self.cells is None:
            return self._matches(term, names, ordered).select(*(F.col(f"`{v.name}`") for v in names))
        probes = {sym: Var(f"_cell{i}") for i, sym in enumerate(sorted({s for _, kind, _, s, _ in nodes(term) if kind == "sym" and s.startswith(CELL)}))}
        found = self._matches(_without_cells(term, probes), [*names, *probes.values()], ordered)
        for sym, var in probes.items():
            there = self.cells.select(F.concat(F.lit(CELL), "id").alias(var.name), F.col("value").alias("_there"))
            asked = self.cells.where(F.col("id") == sym[len(CELL) :]).select(F.col("value").alias("_there"))
            found = found.join(there.join(asked, "_there", "left_semi"), var.name, "left_semi")
        for v in names:
            now = self.cells.select(F.concat(F.lit(CELL), "id").alias(v.name), F.col("value").alias("_now"))
            found = found.join(now, v.name, "left").withColumn(v.name, F.coalesce("_now", F.col(f"`{v.name}`"))).drop("_now")
        return found.select(*(F.col(f"`{v.name}`") for v in names))

    def _matches(self, term, names: list[Var], ordered: bool) -> DataFrame:
        factors = factors_of(term)
        if len(factors) > 62:
            raise ValueError("more than 62 conjuncts")
        stored = [f for f in factors if _head(f) not in self.functions]
        if self._ground_for(stored):
            tables = [self._match(f, f"_f{i}" if ordered else None) for i, f in _narrow_first(stored)]
            rows = natural_join(tables) if tables else self.spark.range(1).select()
            rows = _as_terms(rows)
        else:
            rows = self._join_schematic(stored, ordered)
        rows = self._compute(rows, [f for f in factors if _head(f) in self.functions])
        if ordered:
            from factloom.operators.order import trie_order

            facts = [(f, F.col(f"_f{i}")) for i, f in enumerate(stored)]
            rows = rows.orderBy(F.concat(*(specificity_of(render(f), c) for f, c in facts)), *(trie_order(c) for _, c in facts))
        return rows

    def _compute(self, rows: DataFrame, factors: list) -> DataFrame:
        """Computed relations, each as soon as its arguments are bound."""
        waiting = list(factors)
        while waiting:
            ready = next((f for f in waiting if all(not isinstance(x, Var) or x.name in rows.columns for x in f[1 : 1 + self.functions[f[0]][0]])), None)
            if ready is None:
                raise ValueError(f"arguments of {render(waiting[0])} are not bound")
            waiting.remove(ready)
            n, function = self.functions[ready[0]]
            args = [F.col(f"`{x.name}`") if isinstance(x, Var) else F.lit(x) for x in ready[1:]]
            value = function(*args[:n])
            if len(args) == n:
                rows = rows.where(value)
            elif isinstance(ready[1 + n], Var) and ready[1 + n].name not in rows.columns:
                rows = rows.withColumn(ready[1 + n].name, value).where(F.col(f"`{ready[1 + n].name}`").isNotNull())
            else:
                rows = rows.where(args[n] == value)
        return rows

    def _schematic_for(self, f) -> bool:
        """Whether a term with variables may match a factor."""
        kinds = self.kinds().schematic
        fits = lambda functor, arity: arity < 0 or arity == _arity(f) and (functor is None or _head(f) in (None, functor))
        return kinds is None or bool(kinds) and (not isinstance(f, tuple) or any(fits(*k) for k in kinds))

    def _ground_for(self, factors: list) -> bool:
        """Whether no fact with variables may match a factor: then matching is filtering, and joins are equi-joins."""
        return self.generic is None or not any(map(self._schematic_for, factors))

    def _relations_for(self, f) -> list[Key]:
        return [k for k in self.relations if isinstance(f, Var) or _arity(f) == k[1] and (isinstance(f[0], Var) or f[0] == k[0])]

    def _generic_for(self, f) -> bool:
        kinds = None if self.generic is None else self.kinds().ground
        fits = lambda functor, arity: _arity(f) == arity and (functor is None or not _head(f) or _head(f) == functor)
        return self.generic is not None and (kinds is None or isinstance(f, Var) or any(fits(*k) for k in kinds))

    def _match(self, f, fact: str | None = None) -> DataFrame:
        """The ground facts that a factor matches: a column for each variable, and one for the fact if it is named."""
        tables = [self._match_relation(k, f, fact) for k in self._relations_for(f)]
        if self._generic_for(f) or not tables:
            tables.append(self._match_generic(f, fact))
        if len(tables) > 1:
            tables = [_as_terms(t) for t in tables]
        return reduce(DataFrame.unionByName, tables)

    def _match_relation(self, key: Key, f, fact: str | None) -> DataFrame:
        rows = self.relations[key]
        columns = dict(enumerate(_columns(rows), 1))
        own = [] if fact is None else [_term(key[0], rows).alias(fact)]
        if isinstance(f, Var):
            return rows.select(_term(key[0], rows).alias(f.name, metadata=TERM), *own)
        places: dict[Var, list[int]] = {}
        for i, x in enumerate(f):
            if isinstance(x, Var):
                places.setdefault(x, []).append(i)
            elif i:
                rows = rows.where(_equals(*columns[i], x) if isinstance(x, str) else F.lit(False))
        as_text = lambda i: text_of(*columns[i]) if i else F.lit(key[0])
        for at in places.values():
            for i, j in zip(at, at[1:]):
                same = i and j and columns[i][1] == columns[j][1]
                rows = rows.where(columns[i][0] == columns[j][0] if same else as_text(i) == as_text(j))
        return rows.select(*(columns[at[0]][0].alias(v.name) if at[0] else F.lit(key[0]).alias(v.name, metadata=TERM) for v, at in places.items()), *own)

    def _match_generic(self, f, fact: str | None) -> DataFrame:
        tests, places, _ = path_predicates(f)
        rows = self.spark.createDataFrame([], T.StructType(ATOMS.fields[:-1])) if self.generic is None else self.generic.where("is_ground")
        if isinstance(f, tuple):
            rows = rows.where(F.col("arity") == len(f))
            if _head(f):
                rows = rows.where(F.col("functor") == f[0])
        rows = reduce(DataFrame.where, tests, rows)
        own = [] if fact is None else [F.col("term").alias(fact)]
        return rows.select(*(F.element_at("node", F.lit(paths[0]))["sub"].alias(v.name, metadata=TERM) for v, paths in places.items()), *own)

    def _might(self, f) -> DataFrame:
        """Generic terms with variables that a factor may match."""
        _, _, constants = path_predicates(f)
        might = reduce(DataFrame.where, _might_match(constants), self.generic.where("not is_ground"))
        if isinstance(f, tuple):
            might = might.where((F.col("arity") == len(f)) | (F.col("arity") < 0) & (F.element_at("node", F.lit(""))["kind"] == "var"))
        return might.select("term")

    def _join_schematic(self, factors: list, ordered: bool) -> DataFrame:
        """Factor by factor. Where both sides are ground a factor is an equi-join on its bound variables; bindings with variables meet all facts
        that share a ground value with them, and facts with variables all bindings, and these are unified.
        """
        rows, seen = None, []
        for i, f in enumerate(factors):
            fact = f"_f{i}"
            own = list(variables(f))
            ground = _as_terms(self._match(f, fact))
            might = self._might(f).withColumnRenamed("term", fact) if self.generic is not None and self._schematic_for(f) else None
            kept = [f"_f{j}" for j in range(i)]
            after = seen + [v for v in own if v not in seen]
            if rows is None:
                parts = [ground] if might is None else [ground, unified(might, f, [], after, fact)]
            else:
                shared = [v.name for v in own if v in seen]
                free = reduce(lambda a, b: a | b, (F.col(f"`{c}`").contains("$") for c in shared), F.lit(False))
                rows = rows.withColumn("_free", free)
                parts = [natural_join([rows.where("not _free").drop("_free"), ground])]
                if shared:
                    parts.append(unified(_meet(rows.where("_free").drop("_free"), ground, shared, fact), f, seen, after, fact))
                if might is not None:
                    parts.append(unified(spread(rows.drop("_free"), might), f, seen, after, fact))
            rows, seen = reduce(DataFrame.unionByName, [p.select(*(F.col(f"`{v.name}`") for v in after), *kept, fact) for p in parts]), after
        return rows if ordered else rows.drop(*(f"_f{i}" for i in range(len(factors))))

    def count_matches(self, pattern: str) -> int:
        from factloom.operators.aggregate import count_join

        factors = factors_of(parse(pattern))
        if len(factors) > 1 and self.cells is None and not any(_head(f) in self.functions for f in factors) and self._ground_for(factors):
            return count_join(_same_types([self._match(f) for f in factors]))
        return self.query(pattern).count()

    def tables(self, pattern: str) -> list[DataFrame]:
        """The tables that the factors of a ground conjunction match, with columns of the same types where they share a variable."""
        factors = factors_of(parse(pattern))
        if not self._ground_for(factors):
            raise ValueError("facts with variables may match")
        return _same_types([self._match(f) for f in factors])

    def values(self, pattern: str) -> DataFrame:
        """The matches with typed values where relations have them, for patterns that no fact with variables matches."""
        factors = factors_of(parse(pattern))
        stored = [f for f in factors if _head(f) not in self.functions]
        if not self._ground_for(stored):
            raise ValueError("facts with variables may match")
        rows = self._compute(natural_join([self._match(f) for _, f in _narrow_first(stored)]), [f for f in factors if _head(f) in self.functions])
        return rows.select(*(F.col(f"`{v.name}`") for v in variables(parse(pattern))))

    # ---- rewriting
    def transform(self, patterns: str, templates: str) -> tuple["Space", int, bool]:
        """(space with the templates' instances, number of matches, whether any was new)."""
        term = parse(patterns)
        made = factors_of(parse(templates))
        if self.cells is None and not self.functions and factors_of(term) and self._ground_for(factors_of(term)):
            rows = natural_join(_same_types([self._match(f) for f in factors_of(term)])).withColumn("_one", F.lit(1))
            if all(self._is_flat(t, rows) for t in made):
                rows = cut(rows)
                space, new = self._add_flat(rows, made)
                return space, rows.count(), new
        rows = cut(self.query(patterns).withColumn("_one", F.lit(1)))
        fresh = cut(atoms_of(instantiate(rows, made)).where("not rejected").drop("rejected").join(self.atoms.select("term"), "term", "left_anti"))
        generic = fresh if self.generic is None else self.generic.select(*GENERIC).unionByName(fresh.select(*GENERIC))
        return self._with(generic=generic, kinds=None), rows.count(), not fresh.isEmpty()

    def _is_flat(self, template, rows: DataFrame) -> bool:
        """Whether a template makes facts of a relation: a functor and symbols or typed columns."""
        typed = {f.name for f in rows.schema.fields if _is_typed(f)}
        return bool(_head(template)) and len(template) > 1 and all(isinstance(x, str) or isinstance(x, Var) and x.name in typed for x in template[1:])

    def _add_flat(self, rows: DataFrame, templates: list) -> tuple["Space", bool]:
        space, new = self, False
        for t in templates:
            made = Space.from_columns(t[0], rows.select(*((F.col(f"`{x.name}`") if isinstance(x, Var) else F.lit(raw(x))).alias(f"c{i}") for i, x in enumerate(t[1:], 1))))
            fresh = made.subtract(space).pinned()
            new = new or not fresh.is_empty()
            space = space.union(fresh)
        return space, new


#: Marks string columns that hold terms; all other columns hold symbols as typed values.
TERM = {"term": True}


def _is_typed(field: T.StructField) -> bool:
    return not field.metadata.get("term") and not field.name.startswith("_f")


def _as_terms(rows: DataFrame, names: set[str] | None = None) -> DataFrame:
    """Typed columns, all or those named, as terms."""
    term = lambda f: (text_of(F.col(f"`{f.name}`"), f.dataType) if _is_typed(f) else F.col(f"`{f.name}`")).alias(f.name, metadata=TERM)
    return rows.select(*(F.col(f"`{f.name}`") if f.name.startswith("_f") or names is not None and f.name not in names else term(f) for f in rows.schema.fields))


def _without_cells(term, probes: dict[str, Var]):
    if isinstance(term, tuple):
        return tuple(_without_cells(x, probes) for x in term)
    return probes.get(term, term) if isinstance(term, str) else term


def spread(left: DataFrame, right: DataFrame) -> DataFrame:
    """All pairs, as an equi-join: `left` is dealt over `SPREAD` parts, to each of which `right`, the smaller one, is copied."""
    dealt = left.withColumn("_part", F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in left.columns)), F.lit(SPREAD)))
    copied = right.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SPREAD - 1).cast("bigint"))))
    return dealt.join(copied, "_part").drop("_part")


def _meet(rows: DataFrame, facts: DataFrame, shared: list[str], fact: str) -> DataFrame:
    """Bindings with variables and ground facts that may agree: joined on the first shared variable that is ground, all pairs where none is."""
    ground = lambda c: ~F.col(f"`{c}`").contains("$")
    parts, left = [], rows
    for c in shared:
        parts.append(left.where(ground(c)).withColumn("_v", F.col(f"`{c}`")).join(facts.select(F.col(f"`{c}`").alias("_v"), fact), "_v").drop("_v"))
        left = left.where(~ground(c))
    parts.append(spread(facts.select(fact), left).select(*rows.columns, fact))
    return reduce(DataFrame.unionByName, parts)


def _same_types(tables: list[DataFrame]) -> list[DataFrame]:
    """Columns of one name that differ in type, or hold terms in one table and values in another, become terms in all."""
    kinds: dict[str, set] = {}
    for t in tables:
        for f in t.schema.fields:
            kinds.setdefault(f.name, set()).add((f.dataType.simpleString(), _is_typed(f)))
    mixed = {c for c, k in kinds.items() if len(k) > 1}
    return [_as_terms(t, mixed) if mixed & set(t.columns) else t for t in tables]


def _narrow_first(factors: list) -> list[tuple[int, object]]:
    """The factors with their places, those with the most constants first: joins start where the fewest rows are."""
    constants = lambda f: sum(kind == "sym" for path, kind, *_ in nodes(f) if path != "0")
    return sorted(enumerate(factors), key=lambda x: -constants(x[1]))


def natural_join(tables: list[DataFrame]) -> DataFrame:
    """An inner join on shared columns; connected tables first, so a product comes only where nothing is shared."""
    tables = _same_types(tables)
    left, rest = tables[0], list(tables[1:])
    while rest:
        at = next((i for i, t in enumerate(rest) if set(t.columns) & set(left.columns)), 0)
        right = rest.pop(at)
        on = [c for c in left.columns if c in right.columns]
        left = left.join(right, on) if on else left.crossJoin(right)
    return left


def instantiate(rows: DataFrame, templates: Iterable) -> DataFrame:
    """One column, text: every template with the row's values; variables that the row lacks stay variables."""

    def build(term) -> list[Column]:
        if isinstance(term, tuple):
            parts = [x for i, t in enumerate(term) for x in ([F.lit(" ")] if i else []) + build(t)]
            return [F.lit("("), *parts, F.lit(")")]
        if isinstance(term, Var) and term.name in rows.columns:
            return [F.col(f"`{term.name}`")]
        # apart from the numbered variables that values may hold
        return [F.lit(f"$t.{term.name}" if isinstance(term, Var) else term)]

    texts = [F.concat(*build(t)) for t in templates]
    return rows.select(F.explode(F.array(*texts)).alias("t")).select(canonical(F.col("t")).alias("text"))
