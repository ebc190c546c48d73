"""Programs of rules: (exec PRIORITY PATTERNS TEMPLATES), rewritten to tables and fired one by one.

PATTERNS is (, p …) or (I (BTM p) (ACT name p) …). TEMPLATES is (, t …) or (O sink …), the sinks being
(+ t), (- t), (pure t $v expression), (guard (table key [bound]) fact), (choose (index key) witness), (ACT name t),
(tensor-op-f32 (op …) (inputs …) (output (name …)) (from p …) (backend …)), tensor-op-f64, the same in doubles, and the folds (count t $v),
(sum t $v $x), (min t $v $x), (max t $v $x), (and t $v $x), which bind $v over all matches with equal other values of t.
A firing takes the rule out whether or not anything matched; it sees the space as before, rules included. Rules of priority (quiesce …)
wait until no other rule is left, or those that arm each other again leave the store as it has been before.
"""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.scalar import REGISTRY, expression
from factloom.operators.guard import guard
from factloom.operators.order import rule_order
from factloom.operators.tensor import add, einsum, unary
from factloom.session import Parts, cut
from factloom.space import Space, atoms_of, instantiate, natural_join
from factloom.terms import Var, canon, parse, render, variables
from factloom.unify import canonical, pair_up, unified

FOLDS = {"count": lambda x: F.count("*"), "sum": lambda x: F.sum(x.cast("bigint")), "min": lambda x: F.min(x.cast("bigint")), "max": lambda x: F.max(x.cast("bigint")), "and": lambda x: F.min(x == "true")}


def _waits(rule) -> bool:
    """Whether a rule is a barrier."""
    return isinstance(rule[1], tuple) and rule[1][:1] == ("quiesce",)


class Program:
    def __init__(self, space: Space, tables: dict[str, Space] | None = None, root: str | None = None):
        """`tables` are named tables (ACT); with `root`, a folder, tables are stored there and found again by other programs."""
        self.space, self.tables, self.root, self.fired = space, dict(tables or {}), root, 0
        self._seen: set = set()

    def table(self, name: str) -> Space:
        if name not in self.tables and self.root:
            self.tables[name] = Space.read(self.space.spark, f"{self.root}/{name}")
        return self.tables[name]

    def rules(self) -> list:
        """The rules in firing order: the text of a program, not data."""
        if self.space.generic is None:
            return []
        found = [parse(r.term) for r in self.space.generic.where("functor = 'exec' and arity = 4").select("term").collect()]
        return sorted(found, key=lambda rule: (_waits(rule), rule_order(rule[1]), render(rule)))

    def step(self, n: int = 1) -> int:
        """Fires up to n rules; how many did fire."""
        done = 0
        while done < n:
            rules = self.rules()
            if not rules:
                break
            waiting = [r for r in rules if _waits(r)]
            if waiting and len(waiting) < len(rules) and self._settled():
                # rules that arm each other again have stopped changing anything else
                rules = waiting
            if _waits(rules[0]):
                self._seen.clear()
            self._fire(rules[0])
            done += 1
        self.fired += done
        return done

    def _settled(self) -> bool:
        """Whether the whole store has been as it is now before, since a barrier fired last."""
        at = self.space.atoms.agg(F.count("*"), F.bit_xor(F.xxhash64("term")), F.bit_xor(F.xxhash64(F.lit(1), "term"))).first()
        known = tuple(at) in self._seen
        self._seen.add(tuple(at))
        return known

    def run(self, fuel: int = 1000) -> Space:
        self.step(fuel)
        return self.space

    def _fire(self, rule) -> None:
        _, _, patterns, templates = rule
        rows = cut(self._match(patterns).withColumn("_one", F.lit(1)))
        space, _ = self.space.remove(render(canon(rule)))
        sinks = [("+", t) for t in templates[1:]] if templates[0] == "," else list(templates[1:])
        for sink in sinks:
            space = self._write(space, rows, sink)
        self.space = space.pinned()

    def _match(self, patterns) -> DataFrame:
        if patterns[0] == ",":
            return self.space.query(render(patterns))
        parts = []
        for source in patterns[1:]:
            where, name, p = (self.space, None, source[1]) if source[0] == "BTM" else (self.table(source[1]), source[1], source[2])
            parts.append(where.query(render(p)))
        return natural_join(parts)

    def _write(self, space: Space, rows: DataFrame, sink) -> Space:
        kind, *args = sink
        if kind == "+":
            return self._add(space, instantiate(rows, args))
        if kind == "-":
            gone = instantiate(rows, args).select(F.col("text").alias("term"))
            return space.without(gone)
        if kind == "pure":
            template, var, value = args
            return self._add(space, instantiate(rows.withColumn(var.name, expression(value).cast("string")), [template]))
        if kind in FOLDS:
            template, var, *of = args
            keys = [v.name for v in variables(template) if v != var and v.name in rows.columns]
            folded = rows.groupBy(*keys).agg(FOLDS[kind](F.col(of[0].name) if of else None).cast("string").alias(var.name))
            return self._add(space, instantiate(folded.withColumn("_one", F.lit(1)), [template]))
        if kind == "guard":
            # before the firing: what this one writes is held against itself
            (table, key, *bound), fact = args
            pairs = self._pairs(rows, (key, fact, *bound))
            stored = self.space.query(f"({table} $key $bound)" if bound else f"({table} $key)")
            if bound:
                pairs, stored = (x.withColumn("bound", F.col("bound").cast("bigint")) for x in (pairs, stored))
            left = guard(pairs, stored, bound="bound" if bound else None)
            return self._add(space, left.select(F.col("fact").alias("text")))
        if kind in ("tensor-op-f32", "tensor-op-f64"):
            return self._tensor(space, rows, kind[-3:], *args)
        if kind == "choose":
            (index, key), witness = args
            pairs = self._pairs(rows, (key, witness))
            first = pairs.groupBy("key").agg(F.min(F.struct(F.length("fact"), F.col("fact"))).alias("w")).select("key", F.col("w.fact").alias("fact"))
            left = guard(first, space.query(f"({index} $key)").select("key"))
            space = self._add(space, left.select(F.col("fact").alias("text")))
            return self._add(space, left.select(F.concat(F.lit(f"({index} "), "key", F.lit(")")).alias("text")))
        if kind == "ACT":
            name, template = args
            made = Space.from_texts(instantiate(rows, [template]))
            if self.root:
                made.save(f"{self.root}/{name}")
            self.tables[name] = made
            return space
        raise ValueError(f"no sink {kind}")

    def _tensor(self, space: Space, rows: DataFrame, kind: str, *args) -> Space:
        """(op einsum SPEC | unary NAME | add), (inputs …), (output (name …)), (from pattern …): patterns hold a tensor's indices and, last, its value."""
        part = {a[0]: a[1:] for a in args}
        if rows.isEmpty():
            return space
        tensors, dtype = [], {"f32": "float", "f64": "double"}[kind]
        for p in part["from"]:
            found = self.space.query(render(p))
            *index, value = found.columns
            tensors.append(found.select(*(F.col(f"`{c}`").cast("bigint").alias(c) for c in index), F.col(f"`{value}`").cast(dtype).alias("v")))
        op, *how = part["op"]
        if op == "einsum":
            made = einsum(how[0], *tensors, dtype=dtype)
        elif op == "unary":
            made = unary(lambda v: REGISTRY[f"{how[0]}_{kind}"](v), tensors[0], dtype=dtype)
        elif op == "add":
            made = add(tensors[0], tensors[1].toDF(*tensors[0].columns), dtype=dtype)
        else:
            raise ValueError(f"no tensor operation {op}")
        return space.union(Space.from_columns(part["output"][0][0], made, unique=True))

    @staticmethod
    def _pairs(rows: DataFrame, terms) -> DataFrame:
        both = instantiate(rows, [("pair", *terms)])
        parts = atoms_of(both).where("functor = 'pair'")
        at = lambda i: F.element_at("node", F.lit(str(i)))["sub"]
        names = ["key", "fact", "bound"][: len(terms)]
        # variables are numbered over the whole pair: on their own, key and fact are numbered anew
        return parts.select(*(canonical(at(i)).alias(name) for i, name in enumerate(names, 1)))

    @staticmethod
    def _add(space: Space, texts: DataFrame) -> Space:
        return space.union(Space(atoms_of(texts).where("not rejected").drop("rejected")))


def scheduled(bodies: list, space: Space, fuel: int, run) -> Space:
    """Fires each body once a tick, until nothing changes or the fuel is used up."""
    size = space.count()
    for _ in range(fuel):
        space = reduce(lambda s, body: run(s, body), bodies, space).pinned()
        was, size = size, space.count()
        if size == was:
            break
    return space


def rewrite(space: Space, term: str, fuel: int = 64) -> list[str]:
    """What (= lhs rhs) equations with variables rewrite a term to, outermost, all branches; what none matches any more."""
    found = rewrite_all(space, space.spark.createDataFrame([(term,)], "term string"), fuel)
    return sorted(r.normal for r in found.collect())


def rewrite_all(space: Space, terms: DataFrame, fuel: int = 64) -> DataFrame:
    """(term, normal) for each of `terms`. A round unifies all terms reached with the equations that may fit, and only new ones go on."""
    equations = cut(space.query("(= $lhs $rhs)").select(F.format_string("(= %s %s)", "lhs", "rhs").alias("_eq"), "lhs"))
    seen = Parts(terms.select(canonical(F.col("term")).alias("term")).distinct().select("term", F.col("term").alias("at")))
    frontier, done = seen.all(), []
    for _ in range(fuel):
        # the row's own term keeps its variables in `was`
        met = pair_up(frontier, "at", equations, "lhs").withColumn("was", F.col("at"))
        made = cut(unified(met, ("=", Var("at"), Var("_to")), [Var("at")], [Var("_to")], "_eq").select("term", "was", F.col("_to").alias("to")).distinct())
        done.append(cut(frontier.join(made.select("term", F.col("was").alias("at")), ["term", "at"], "left_anti")))
        frontier = seen.append(made.select("term", canonical(F.col("to")).alias("at")).distinct().join(seen.all(), ["term", "at"], "left_anti"))
        if not seen.added:
            break
    return reduce(DataFrame.unionByName, done).select("term", F.col("at").alias("normal")).distinct()
