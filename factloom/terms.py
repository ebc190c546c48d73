"""Terms: parsing, rendering, alpha-canonical form, the encoding envelope and orders.

A symbol is a str, a variable a Var, an expression a tuple. The canonical string of a term, with variables
numbered by first occurrence, is its identity: alpha-equivalent terms have the same.
"""

import re
from dataclasses import dataclass

_TOKEN = re.compile(r'\s+|;[^\n]*|(\(|\)|"(?:[^"\\]|\\.)*"|[^\s();]+)')
MAX_BYTES, MAX_ARITY, MAX_FACTORS = 63, 63, 62


@dataclass(frozen=True)
class Var:
    name: str

    def __repr__(self):
        return f"${self.name}"


def parse_all(text: str) -> list:
    """All terms of a program text; `;` starts a comment."""
    out, stack, at = [], [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"unreadable text at {at}")
        at, token = m.end(), m[1]
        if token is None:
            continue
        if token == "(":
            stack.append([])
            continue
        if token == ")":
            if not stack:
                raise ValueError("stray )")
            term = tuple(stack.pop())
        else:
            term = Var(token[1:]) if token[0] == "$" and len(token) > 1 else token
        (stack[-1] if stack else out).append(term)
    if stack:
        raise ValueError("unclosed (")
    return out


def parse(text: str):
    terms = parse_all(text)
    if len(terms) != 1:
        raise ValueError("one term expected")
    return terms[0]


def render(term) -> str:
    return f"({' '.join(map(render, term))})" if isinstance(term, tuple) else repr(term) if isinstance(term, Var) else term


def variables(term, seen: dict | None = None) -> dict:
    """Variables in order of first occurrence."""
    seen = {} if seen is None else seen
    if isinstance(term, Var):
        seen.setdefault(term, len(seen))
    elif isinstance(term, tuple):
        for x in term:
            variables(x, seen)
    return seen


def canon(term):
    """Variables renamed 0, 1, … by first occurrence."""
    names = variables(term)
    return substitute(term, {v: Var(str(i)) for v, i in names.items()}) if names else term


def substitute(term, bindings: dict):
    if isinstance(term, Var):
        return bindings.get(term, term)
    return tuple(substitute(x, bindings) for x in term) if isinstance(term, tuple) else term


def symbol(text: str) -> str:
    """The symbol of a text, in quotes if it holds white space, brackets and the like."""
    return text if re.fullmatch(r'[^\s();"$][^\s();"]*', text) else '"' + re.sub(r'(["\\])', r"\\\1", text) + '"'


def raw(sym: str) -> str:
    """The text of a symbol."""
    return re.sub(r"\\(.)", r"\1", sym[1:-1], flags=re.S) if len(sym) > 1 and sym[0] == sym[-1] == '"' else sym


def valid(term) -> bool:
    """The envelope: symbols of 1 to 63 bytes, at most 63 children."""
    if isinstance(term, tuple):
        return len(term) <= MAX_ARITY and all(map(valid, term))
    return isinstance(term, Var) or 1 <= len(raw(term).encode()) <= MAX_BYTES


def nodes(term, path: str = ""):
    """(path, kind, arity, symbol, canonical string) of the term and all terms inside, before their parts."""
    if isinstance(term, tuple):
        yield path, "expr", len(term), None, render(term)
        for i, x in enumerate(term):
            yield from nodes(x, f"{path}.{i}" if path else str(i))
    else:
        yield path, "var" if isinstance(term, Var) else "sym", 0, None if isinstance(term, Var) else term, render(term)


def trie_key(term) -> list:
    """A list that sorts as stored terms do: expressions by arity, back-references, first variables, symbols by length and bytes."""
    out, seen = [], set()

    def walk(t):
        if isinstance(t, tuple):
            out.append((0, len(t), b""))
            for x in t:
                walk(x)
        elif isinstance(t, Var):
            out.append((1, int(t.name) if t.name.isdigit() else 0, b"") if t in seen else (2, 0, b""))
            seen.add(t)
        else:
            out.append((3, len(t.encode()), t.encode()))

    walk(term)
    return out


def specificity(pattern, fact) -> list[int]:
    """0 where both agree or both are variables, 1 where just one is, in preorder."""
    if isinstance(pattern, Var) or isinstance(fact, Var):
        return [int(isinstance(pattern, Var) != isinstance(fact, Var))]
    if isinstance(pattern, tuple) and isinstance(fact, tuple):
        return [0] + [x for p, f in zip(pattern, fact) for x in specificity(p, f)]
    return [0]


def peano_depth(term) -> int | None:
    """n of (S (S … Z)), or None."""
    n = 0
    while isinstance(term, tuple) and len(term) == 2 and term[0] == "S":
        term, n = term[1], n + 1
    return n if term == "Z" else None


def priority_key(term):
    """Sorts numbers by value, then symbols, expressions (Peano numerals by depth first, tuples item by item) and variables by name."""
    if isinstance(term, Var):
        return (3, 0, term.name, ())
    if isinstance(term, tuple):
        depth = peano_depth(term)
        return (2, 0, depth, ()) if depth is not None else (2, 1, 0, tuple(map(priority_key, term)))
    if re.fullmatch(r"[+-]?\d+", term):
        return (0, int(term), "", ())
    return (1, 0, term, ())
