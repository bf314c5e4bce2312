"""Pure functions over Python source: features, rewrites and slices. No Spark here; operators/code.py runs them in batches.

A rewrite is a function from tree to tree. Most are one call of edit(), which walks a tree bottom-up (children before their
parent) and hands nodes of the named kinds to small functions.
"""

from __future__ import annotations

import ast
import builtins
import hashlib
import random
import re
import textwrap
from collections import deque
from collections.abc import Callable

Functions = (ast.FunctionDef, ast.AsyncFunctionDef)
_BLOCKS = ("body", "orelse", "finalbody")


# ---- walking --------------------------------------------------------------------------------------------------------


class _Editor(ast.NodeTransformer):
    def __init__(self, rules: dict[str, Callable]):
        self.rules = rules

    def visit(self, node: ast.AST):
        self.generic_visit(node)
        rule = self.rules.get(type(node).__name__)
        return rule(node) if rule else node


def edit(tree: ast.AST, **rules: Callable) -> ast.AST:
    return _Editor(rules).visit(tree)


def filled(tree: ast.AST) -> ast.AST:
    """The tree with `pass` in every block that must have a statement and lost its last one."""
    for node in ast.walk(tree):
        if isinstance(getattr(node, "body", None), list) and not node.body and not isinstance(node, ast.Module):
            node.body = [ast.Pass()]
        if isinstance(node, ast.Try) and not node.handlers and not node.finalbody:
            node.finalbody = [ast.Pass()]
    return tree


def is_docstring(s: ast.AST) -> bool:
    return isinstance(s, ast.Expr) and isinstance(s.value, ast.Constant) and isinstance(s.value.value, str)


def load(name: str) -> ast.Name:
    return ast.Name(name, ast.Load())


def store(name: str) -> ast.Name:
    return ast.Name(name, ast.Store())


def negate(e: ast.expr) -> ast.expr:
    return ast.UnaryOp(ast.Not(), e)


def is_not(e: ast.expr) -> bool:
    return isinstance(e, ast.UnaryOp) and isinstance(e.op, ast.Not)


def call(name: str, *args: ast.expr) -> ast.Call:
    return ast.Call(load(name), list(args), [])


def range_parts(e: ast.expr) -> tuple[ast.expr, ast.expr, ast.expr] | None:
    """(start, stop, step) of a plain range(...) call."""
    if not (isinstance(e, ast.Call) and isinstance(e.func, ast.Name) and e.func.id == "range" and 1 <= len(e.args) <= 3 and not e.keywords):
        return None
    a = e.args
    return (ast.Constant(0), a[0], ast.Constant(1)) if len(a) == 1 else (a[0], a[1], a[2] if len(a) == 3 else ast.Constant(1))


def number(e: ast.expr) -> int | float | None:
    if isinstance(e, ast.UnaryOp) and isinstance(e.op, ast.USub) and (n := number(e.operand)) is not None:
        return -n
    return e.value if isinstance(e, ast.Constant) and type(e.value) in (int, float) else None


# ---- rewrites -------------------------------------------------------------------------------------------------------


def control_flow(tree, compat: bool = False):
    """`if c: body` with a lone `return` as else becomes a guard and the body; elif chains become separate ifs."""
    if compat:
        return tree

    def guard(node):
        if len(node.orelse) == 1 and isinstance(node.orelse[0], ast.Return):
            return [ast.If(negate(node.test), node.orelse, []), *node.body]
        parts, seen = [], []
        while len(node.orelse) == 1 and isinstance(node.orelse[0], ast.If) and getattr(node.orelse[0], "elif_", False):
            parts.append((list(seen), node.test, node.body))
            seen.append(node.test)
            node = node.orelse[0]
        if not parts:
            return node
        parts.append((list(seen), node.test, node.body))
        if node.orelse:
            parts.append(([*seen, node.test], None, node.orelse))
        out = []
        for before, test, body in parts:
            tests = [*(negate(t) for t in before), *([test] if test is not None else [])]
            out.append(ast.If(tests[0] if len(tests) == 1 else ast.BoolOp(ast.And(), tests), body, []))
        return out

    elifs = {id(n.orelse[0]) for n in ast.walk(tree) if isinstance(n, ast.If) and len(n.orelse) == 1 and isinstance(n.orelse[0], ast.If)}
    for n in ast.walk(tree):
        if isinstance(n, ast.If):
            n.elif_ = id(n) in elifs
    return edit(tree, If=lambda n: n if n.elif_ else guard(n))


def variable_naming(tree):
    """Each name, from its first assignment on, becomes var_N; parameters and earlier reads stay."""
    known: dict[str, str] = {}

    def rename(n):
        if isinstance(n.ctx, ast.Store):
            known.setdefault(n.id, f"var_{len(known)}")
        if not isinstance(n.ctx, ast.Del):
            n.id = known.get(n.id, n.id)
        return n

    return edit(tree, Name=rename)


#: What the result of an operator is called.
_RESULTS = {ast.Add: "sum_value", ast.Sub: "diff_value", ast.Mult: "product", ast.Div: "quotient", ast.Mod: "remainder"}
_COMPLEX = (ast.BinOp, ast.Call, ast.Subscript)


def expression(tree):
    """An assignment's complex value moves to a named temporary before it."""
    count = 0

    def complex_(e):
        if isinstance(e, ast.BinOp):
            return any(isinstance(x, _COMPLEX) or (isinstance(x, ast.Compare) and len(x.ops) > 1) for x in (e.left, e.right))
        if isinstance(e, ast.Call):
            return any(isinstance(x, _COMPLEX) for x in e.args)
        return isinstance(e, ast.Subscript) and isinstance(e.slice, ast.BinOp)

    def name(e):
        nonlocal count
        if isinstance(e, ast.BinOp) and type(e.op) in _RESULTS:
            return _RESULTS[type(e.op)]
        if isinstance(e, ast.Subscript):
            return f"{e.value.id}_item" if isinstance(e.value, ast.Name) else "item"
        if isinstance(e, ast.Call):
            return f"{e.func.id}_result" if isinstance(e.func, ast.Name) else "result"
        count += 1
        return f"temp_{count}"

    def hoist(s):
        if not complex_(s.value):
            return s
        temp = name(s.value)
        return [ast.Assign([store(temp)], s.value), ast.Assign(s.targets, load(temp))]

    return edit(tree, Assign=hoist)


def loop_standard(tree):
    """Directly nested loops over ranges of step 1 become one loop over flat_idx, where no bound depends on an outer variable.

    Loops that break, continue, or assign a loop variable stay, and so do bounds that aren't known not to be negative. A pair
    `for i in range(n): for k in range(ptr[i], ptr[i + 1])` becomes one loop over k, in which i follows ptr: the row pointers of
    a compressed sparse matrix, which are taken to be sorted.
    """

    def next_of(e, name):
        return isinstance(e, ast.BinOp) and isinstance(e.op, ast.Add) and {ast.dump(e.left), ast.dump(e.right)} == {ast.dump(load(name)), ast.dump(ast.Constant(1))}

    def by_rows(node):
        outer, inner = range_parts(node.iter), node.body[0] if len(node.body) == 1 else None
        if not (outer and number(outer[2]) == 1 and isinstance(inner, ast.For) and isinstance(node.target, ast.Name) and isinstance(inner.target, ast.Name)) or node.orelse or inner.orelse:
            return None
        i, k, parts = node.target.id, inner.target.id, range_parts(inner.iter)
        if not parts or number(parts[2]) != 1 or not all(isinstance(e, ast.Subscript) and isinstance(e.value, ast.Name) for e in parts[:2]):
            return None
        (first, last), (start, stop) = parts[:2], outer[:2]
        pointers = first.value.id
        if last.value.id != pointers or not (isinstance(first.slice, ast.Name) and first.slice.id == i and next_of(last.slice, i)):
            return None
        inside = [n for s in inner.body for n in ast.walk(s)]
        stored = {n.id for n in inside if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store)}
        written = {n.value.id for n in inside if isinstance(n, ast.Subscript) and isinstance(n.value, ast.Name) and not isinstance(n.ctx, ast.Load)}
        fixed = {i, k, pointers} | {n.id for e in (start, stop) for n in ast.walk(e) if isinstance(n, ast.Name)}
        if len({i, k, pointers}) < 3 or (stored | written) & fixed or any(isinstance(n, (ast.Break, ast.Return, ast.Yield, ast.YieldFrom)) for n in inside):
            return None
        at = lambda e: ast.Subscript(load(pointers), e, ast.Load())
        follow = ast.While(ast.Compare(load(k), [ast.GtE()], [at(ast.BinOp(load(i), ast.Add(), ast.Constant(1)))]), [ast.AugAssign(store(i), ast.Add(), ast.Constant(1))], [])
        return [ast.Assign([store(i)], start), ast.For(store(k), call("range", at(start), at(stop)), [follow, *inner.body], [])]

    def length(start, stop):
        a, b = number(start), number(stop)
        if isinstance(a, int) and isinstance(b, int):
            return ast.Constant(b - a) if b >= a else None
        if a == 0:
            return stop if isinstance(stop, ast.Call) and isinstance(stop.func, ast.Name) and stop.func.id == "len" else call("max", stop, ast.Constant(0))
        return call("max", ast.BinOp(stop, ast.Sub(), start), ast.Constant(0))

    def product(items):
        out = items[0]
        for x in items[1:]:
            out = ast.BinOp(out, ast.Mult(), x)
        return out

    def flatten(node):
        names, ranges, at = [], [], node
        while True:
            parts = range_parts(at.iter)
            if not parts or number(parts[2]) != 1 or not isinstance(at.target, ast.Name) or at.orelse:
                return node if not names else None
            names.append(at.target.id)
            ranges.append(parts)
            if len(at.body) != 1 or not isinstance(at.body[0], ast.For):
                break
            at = at.body[0]
        if len(names) < 2 or len(set(names)) < len(names):
            return node
        inside = [n for s in at.body for n in ast.walk(s)]
        stored = {n.id for n in inside if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store)}
        used = {n.id for r in ranges for e in r[:2] for n in ast.walk(e) if isinstance(n, ast.Name)}
        if any(isinstance(n, (ast.Break, ast.Continue, ast.Return, ast.Yield, ast.YieldFrom)) for n in inside) or stored & ({*names} | used) or used & {*names}:
            return node
        sizes = [length(a, b) for a, b, _ in ranges]
        if None in sizes:
            return node
        places = []
        for i, (name, (start, _, _)) in enumerate(zip(names, ranges)):
            place = load("flat_idx")
            if i < len(names) - 1:
                place = ast.BinOp(place, ast.FloorDiv(), product(sizes[i + 1 :]))
            if i:
                place = ast.BinOp(place, ast.Mod(), sizes[i])
            places.append(ast.Assign([store(name)], place if number(start) == 0 else ast.BinOp(start, ast.Add(), place)))
        return ast.For(store("flat_idx"), call("range", product(sizes)), [*places, *at.body], [])

    class Outermost(ast.NodeTransformer):
        def visit_For(self, node):
            rows = by_rows(node)
            if rows:
                return rows
            new = flatten(node)
            if new is None or new is node:
                return self.generic_visit(node)
            return new

    return Outermost().visit(tree)


def drop_self(tree):
    """Methods lose their first parameter `self`, and self.x becomes x."""

    def method(n):
        if n.args.args and n.args.args[0].arg == "self":
            n.args.args.pop(0)
        return n

    return edit(tree, FunctionDef=method, Attribute=lambda n: ast.Name(n.attr, n.ctx) if isinstance(n.value, ast.Name) and n.value.id == "self" else n)


def drop_path(tree):
    def last(n):
        n.name = n.name.rpartition(".")[2]
        return n

    def short(n):
        n.names = [last(a) for a in n.names]
        return n

    def from_(n):
        n.module, n.level = (n.module or "").rpartition(".")[2] or n.module, 0 if n.module else n.level
        return n

    return edit(tree, Import=short, ImportFrom=from_)


def drop_return(tree):
    return filled(edit(tree, Return=lambda n: ast.Expr(n.value) if n.value else None))


def drop_vars(tree, declaration: bool = False):
    """Assigned values become None, or the assignments go."""

    def drop(n):
        if declaration:
            return None
        if n.value is not None:
            n.value = ast.Constant(None)
        return n

    return filled(edit(tree, Assign=drop, AnnAssign=drop))


def remove_exceptions(tree):
    return filled(edit(tree, Try=lambda n: n.body, Raise=lambda n: None))


def remove_print(tree):
    return edit(tree, Expr=lambda n: ast.Pass() if isinstance(n.value, ast.Call) and isinstance(n.value.func, ast.Name) and n.value.func.id == "print" else n)


def remove_else(tree):
    def drop(n):
        n.orelse = []
        return n

    return edit(tree, If=drop, Try=drop)


def remove_docstrings(tree):
    def drop(n):
        if n.body and is_docstring(n.body[0]):
            n.body.pop(0)
        return n

    return filled(edit(tree, Module=drop, FunctionDef=drop, AsyncFunctionDef=drop, ClassDef=drop))


def _random_for(seed: int, name: str) -> random.Random:
    """A generator for one function: the same at any place and order of work."""
    return random.Random(int.from_bytes(hashlib.blake2b(f"{seed}:{name}".encode(), digest_size=8).digest(), "little"))


def _in_functions(tree, change: Callable):
    def visit(n):
        change(n)
        return n

    return edit(tree, FunctionDef=visit, AsyncFunctionDef=visit)


def _after_docstring(body: list) -> int:
    return 1 if body and is_docstring(body[0]) else 0


def log_statement(tree, seed: int = 0, position: int | None = None):
    """print('LOG: reached') at a random place of each function body, after a docstring; or at a fixed place."""

    def insert(n):
        first = _after_docstring(n.body)
        at = _random_for(seed, n.name).randint(first, len(n.body)) if position is None else min(first + position, len(n.body))
        n.body.insert(at, ast.Expr(call("print", ast.Constant("LOG: reached"))))

    return _in_functions(tree, insert)


def loop_exchange(tree, safe: bool = False):
    """`for v in range` becomes an initialised while; `while v < n` that ends in v += s becomes for v in range(0, n, s).

    safe leaves loops with `continue`, whose increment the while form would skip.
    """

    def to_while(n):
        parts = range_parts(n.iter)
        if not parts or not isinstance(n.target, ast.Name) or (safe and any(isinstance(x, ast.Continue) for s in n.body for x in ast.walk(s))):
            return n
        start, stop, step = parts
        below = (number(step) or 0) < 0 or (isinstance(step, ast.UnaryOp) and isinstance(step.op, ast.USub))
        v = n.target.id
        test = ast.Compare(load(v), [ast.Gt() if below else ast.Lt()], [stop])
        return [ast.Assign([store(v)], start), ast.While(test, [*n.body, ast.AugAssign(store(v), ast.Add(), step)], n.orelse)]

    def to_for(n):
        t, last = n.test, n.body[-1]
        if not (isinstance(t, ast.Compare) and len(t.ops) == 1 and isinstance(t.ops[0], ast.Lt) and isinstance(t.left, ast.Name)):
            return n
        if not (isinstance(last, ast.AugAssign) and isinstance(last.op, ast.Add) and isinstance(last.target, ast.Name) and last.target.id == t.left.id):
            return n
        return filled(ast.For(store(t.left.id), call("range", ast.Constant(0), t.comparators[0], last.value), n.body[:-1], n.orelse))

    return edit(tree, For=to_while, While=to_for)


#: Calls without side effects.
PURE_CALLS = {"len", "abs", "min", "max", "sorted", "sum", "any", "all"}
_PURE = (ast.Constant, ast.Name, ast.BinOp, ast.UnaryOp, ast.BoolOp, ast.Compare, ast.Tuple, ast.List, ast.Set, ast.Dict, ast.Subscript, ast.Slice, ast.Attribute, ast.IfExp, ast.operator, ast.unaryop, ast.boolop, ast.cmpop, ast.expr_context)


def _pure(e: ast.AST) -> bool:
    if isinstance(e, ast.Call):
        return isinstance(e.func, ast.Name) and e.func.id in PURE_CALLS and not e.keywords and all(map(_pure, e.args))
    return isinstance(e, _PURE) and all(map(_pure, ast.iter_child_nodes(e)))


def _reads_writes(s: ast.stmt) -> tuple[set[str], set[str]] | None:
    """Names that a pure statement reads and writes; None if it isn't one. Attributes and items write their base name."""
    if isinstance(s, ast.Expr):
        targets, values = [], [s.value]
    elif isinstance(s, ast.Assign):
        targets, values = s.targets, [s.value]
    elif isinstance(s, ast.AugAssign):
        targets, values = [s.target], [s.value, s.target]
    elif isinstance(s, ast.AnnAssign) and s.value is not None:
        targets, values = [s.target], [s.value]
    else:
        return None
    names = lambda e: {n.id for n in ast.walk(e) if isinstance(n, ast.Name)}
    reads, writes = set(), set()
    for t in targets:
        base = t if isinstance(t, ast.Name) else getattr(t, "value", None)
        if not isinstance(t, (ast.Name, ast.Attribute, ast.Subscript)) or not isinstance(base, ast.Name):
            return None
        writes.add(base.id)
        if isinstance(t, ast.Subscript):
            values = [*values, t.slice]
    for v in values:
        if not _pure(v):
            return None
        reads |= names(v)
    return reads, writes


def permute_statement(tree, seed: int = 1337, most: int = 2, adjacent_only: bool = False):
    """At most `most` random swaps in each block of pure statements that share no written name.

    Statements between the swapped ones are not looked at, unless only adjacent ones may swap.
    """
    rng = random.Random(seed)

    def shuffle(body):
        first = _after_docstring(body)
        pairs = [(i, j) for i in range(first, len(body)) for j in range(i + 1, len(body)) if (not adjacent_only or j == i + 1) and _reads_writes(body[i]) and _reads_writes(body[j])]
        rng.shuffle(pairs)
        original, swaps = list(body), 0
        for a, b in pairs:
            if swaps == most:
                break
            (r1, w1), (r2, w2) = _reads_writes(original[a]), _reads_writes(original[b])
            if not (r1 & w2 or r2 & w1 or w1 & w2):
                i, j = (next(k for k, s in enumerate(body) if s is original[x]) for x in (a, b))
                body[i], body[j] = body[j], body[i]
                swaps += 1

    def blocks(n):
        for field in _BLOCKS:
            if isinstance(block := getattr(n, field, None), list):
                shuffle(block)
        return n

    return edit(tree, **dict.fromkeys(("FunctionDef", "AsyncFunctionDef", "If", "For", "While", "With", "Try"), blocks))


#: What a comparison becomes with its sides exchanged.
_MIRROR = {ast.Lt: ast.Gt, ast.Gt: ast.Lt, ast.LtE: ast.GtE, ast.GtE: ast.LtE, ast.Eq: ast.Eq, ast.NotEq: ast.NotEq, ast.Is: ast.Is, ast.IsNot: ast.IsNot}


def reorder_condition(tree):
    """In the tests of if and while: `a < b` becomes `b > a`, operands of and/or are reversed; membership tests stay."""

    def turn(e):
        if isinstance(e, ast.BoolOp):
            e.values = [turn(v) for v in reversed(e.values)]
        elif is_not(e):
            e.operand = turn(e.operand)
        elif isinstance(e, ast.Compare) and len(e.ops) == 1 and type(e.ops[0]) in _MIRROR:
            return ast.Compare(e.comparators[0], [_MIRROR[type(e.ops[0])]()], [e.left])
        return e

    def test(n):
        n.test = turn(n.test)
        return n

    return edit(tree, If=test, While=test)


def try_catch_insertion(tree, seed: int = 0, mode: str = "reraising"):
    """One statement of each function, not a docstring or pass, goes into a try: reraising, masking or finally."""

    def wrap(n):
        free = [i for i in range(_after_docstring(n.body), len(n.body)) if not isinstance(n.body[i], ast.Pass)]
        if free:
            i = _random_for(seed, n.name).choice(free)
            handlers = [] if mode == "finally" else [ast.ExceptHandler(load("Exception"), None, [ast.Pass() if mode == "masking" else ast.Raise()])]
            n.body[i] = ast.Try([n.body[i]], handlers, [], [ast.Pass()] if mode == "finally" else [])

    return _in_functions(tree, wrap)


def dead_code_insertion(tree, seed: int = 0, position: str = "random", payloads: tuple[str, ...] = ("assign", "call", "loop")):
    """An unreachable `if False:` in each function, at a random place, the top, middle or bottom, after a docstring."""
    fresh = 0

    def insert(n):
        nonlocal fresh
        rng, first = _random_for(seed, n.name), _after_docstring(n.body)
        taken = {x.id for s in n.body for x in ast.walk(s) if isinstance(x, ast.Name)}
        kind = rng.choice(payloads)
        if kind == "assign":
            while f"_unused_{fresh}" in taken:
                fresh += 1
            inner = ast.Assign([store(f"_unused_{fresh}")], ast.Constant(0))
            fresh += 1
        elif kind == "call":
            nothing = ast.arguments(posonlyargs=[], args=[], kwonlyargs=[], kw_defaults=[], defaults=[])
            inner = ast.Expr(ast.Call(ast.Lambda(nothing, ast.Constant(None)), [], []))
        else:
            inner = ast.For(store("_i"), call("range", ast.Constant(0)), [ast.Pass()], [])
        places = {"top": max(first, 1), "middle": max(first, len(n.body) // 2), "bottom": len(n.body)}
        n.body.insert(places.get(position, rng.randint(first, len(n.body))), ast.If(ast.Constant(False), [inner], []))

    return _in_functions(tree, insert)


def boolean_exchange(tree):
    """Reads of a function's first variable set to True or False become the other constant; its assignment stays."""
    for fn in [n for n in ast.walk(tree) if isinstance(n, Functions)]:
        flags = (s for s in fn.body if isinstance(s, ast.Assign) and len(s.targets) == 1 and isinstance(s.targets[0], ast.Name) and isinstance(s.value, ast.Constant) and isinstance(s.value.value, bool))
        if flag := next(flags, None):
            name, other = flag.targets[0].id, not flag.value.value
            fn.body = [edit(s, Name=lambda n, name=name, other=other: ast.Constant(other) if n.id == name and isinstance(n.ctx, ast.Load) else n) for s in fn.body]
    return tree


def switch_to_if(tree):
    """match over values, alternatives of values and wildcards becomes if, elif, else; other patterns leave it."""

    def test(subject, pattern):
        if isinstance(pattern, ast.MatchValue):
            return ast.Compare(subject, [ast.Eq()], [pattern.value])
        if isinstance(pattern, ast.MatchSingleton):
            return ast.Compare(subject, [ast.Is()], [ast.Constant(pattern.value)])
        if isinstance(pattern, ast.MatchOr) and (parts := [test(subject, p) for p in pattern.patterns]) and None not in parts:
            return ast.BoolOp(ast.Or(), parts)
        return None

    def convert(n):
        out, wild = None, False
        cases = []
        for c in n.cases:
            wild = isinstance(c.pattern, ast.MatchAs) and c.pattern.pattern is None and c.pattern.name is None
            t = ast.Constant(True) if wild else test(n.subject, c.pattern)
            if t is None:
                return n
            if c.guard is not None:
                t = c.guard if wild else ast.BoolOp(ast.And(), [t, c.guard])
                wild = False
            cases.append((t, wild, c.body))
            if wild:
                break
        for t, wild, body in reversed(cases):
            out = body if wild else [ast.If(t, body, out or [])]
        return out

    return edit(tree, Match=convert)


def if_normalize(tree):
    """De Morgan once; `if not a: x else: y` turned round; nested ifs joined by and; an else after a branch that leaves, hoisted."""

    def leaves(body):
        last = body[-1] if body else None
        return isinstance(last, (ast.Return, ast.Raise, ast.Break, ast.Continue)) or (isinstance(last, ast.If) and leaves(last.body) and leaves(last.orelse))

    def normal(n):
        if is_not(n.test) and isinstance(n.test.operand, ast.BoolOp):
            inner = n.test.operand
            n.test = ast.BoolOp(ast.Or() if isinstance(inner.op, ast.And) else ast.And(), [v.operand if is_not(v) else negate(v) for v in inner.values])
        if n.orelse and is_not(n.test):
            n.test, n.body, n.orelse = n.test.operand, n.orelse, n.body
        if not n.orelse and len(n.body) == 1 and isinstance(n.body[0], ast.If) and not n.body[0].orelse:
            n.test, n.body = ast.BoolOp(ast.And(), [n.test, n.body[0].test]), n.body[0].body
        if n.orelse and leaves(n.body):
            rest, n.orelse = n.orelse, []
            return [n, *rest]
        return n

    return edit(tree, If=normal)


def if_invert(tree):
    def invert(n):
        n.test, n.body, n.orelse = negate(n.test), n.orelse or [ast.Pass()], n.body
        return n

    return edit(tree, If=invert)


def same(tree):
    return tree


#: Rewrites by name. drop_comments only writes the tree out again; function_extract changes nothing.
TREE_REWRITES: dict[str, Callable] = {
    "control_flow": control_flow, "variable_naming": variable_naming, "expression": expression, "loop_standard": loop_standard, "function_extract": same,
    "drop_comments": same, "drop_self": drop_self, "drop_path": drop_path, "drop_return": drop_return, "drop_vars": drop_vars,
    "remove_exceptions": remove_exceptions, "remove_print": remove_print, "remove_else": remove_else, "remove_docstrings": remove_docstrings,
    "log_statement": log_statement, "loop_exchange": loop_exchange, "permute_statement": permute_statement, "reorder_condition": reorder_condition,
    "try_catch_insertion": try_catch_insertion, "dead_code_insertion": dead_code_insertion, "boolean_exchange": boolean_exchange,
    "switch_to_if": switch_to_if, "if_normalize": if_normalize, "if_invert_condition": if_invert, "if_invert": if_invert,
}


def replace_parentheses(code: str) -> str:
    return re.sub("[()]", "", code)


def forget_indent(code: str, flat: bool = False) -> str:
    lead = lambda x: "    " if flat and x[:1].isspace() else ""
    return "\n".join(lead(x) + x.lstrip() if x.strip() else x for x in code.split("\n"))


TEXT_REWRITES: dict[str, Callable] = {"replace_parentheses": replace_parentheses, "forget_indent": forget_indent, "remove_indent": forget_indent}


def register_transform(name: str, rewrite: Callable, text: bool = False) -> None:
    """Adds a rewrite (of a tree, or of a text) under a name of one's own."""
    (TEXT_REWRITES if text else TREE_REWRITES)[name] = rewrite


def transform_code(code: str, names: list[str], options: dict[str, dict] | None = None) -> tuple[str, str | None]:
    """(rewritten code, error): tree rewrites in order, written out only if the tree changed (or comments go), then text rewrites.

    On an error the code comes back as it was, with the message. Unknown names are passed over.
    """
    source, options = code.strip(), options or {}
    try:
        tree = ast.parse(source)
        before, out = ast.dump(tree), source
        wanted = [n for n in names if n in TREE_REWRITES]
        for name in wanted:
            tree = ast.fix_missing_locations(TREE_REWRITES[name](tree, **options.get(name, {})))
        if "drop_comments" in wanted or ast.dump(tree) != before:
            out = ast.unparse(tree)
        for name in names:
            if name in TEXT_REWRITES:
                out = TEXT_REWRITES[name](out, **options.get(name, {}))
        return out, None
    except Exception as e:  # noqa: BLE001  a row's error is data
        return code, f"{type(e).__name__}: {e}"


#: The core rewrites, in the order in which they run before others.
CORE = ["function_extract", "control_flow", "loop_standard", "expression", "variable_naming"]


def pipeline_code(code: str, names: list[str] | None = None, include_core: bool = True, options: dict[str, dict] | None = None, keep: bool = False) -> tuple[str | None, str | None]:
    """(code, error) of the variant that runs the core rewrites first, if asked to, and always writes the tree out again.

    Without names all rewrites run. On an error the code is None, or with keep the text as it was.
    """
    wanted, options = names or [*TREE_REWRITES, *TEXT_REWRITES], options or {}
    try:
        tree = ast.parse(textwrap.dedent(code).strip())
        for name in [*(CORE if include_core else []), *(n for n in wanted if n in TREE_REWRITES)]:
            tree = ast.fix_missing_locations(TREE_REWRITES[name](tree, **options.get(name, {})))
        out = ast.unparse(tree)
        for name in wanted:
            if name in TEXT_REWRITES:
                out = TEXT_REWRITES[name](out, **options.get(name, {}))
        return out, None
    except Exception as e:  # noqa: BLE001  a row's error is data
        return (code if keep else None), f"{type(e).__name__}: {e}"


# ---- features -------------------------------------------------------------------------------------------------------


def features(code: str) -> dict:
    """All that one parse tells: construct flags, two complexity scores (-1 or null if invalid), the first definition's name."""
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError, RecursionError):
        return {"valid": False, "has_if": False, "has_loop": False, "has_switch": False, "complexity": -1, "complexity_v1": -1, "defs": 0, "primary_name": "invalid"}
    count = lambda *kinds: sum(isinstance(n, kinds) for n in nodes)
    nodes = list(ast.walk(tree))
    defs, classes, ifs, loops, tries = count(ast.FunctionDef), count(ast.ClassDef), count(ast.If), count(ast.For, ast.While), count(ast.Try)
    name, queue = "unknown", deque([tree])
    while queue:
        n = queue.popleft()
        if isinstance(n, (ast.FunctionDef, ast.ClassDef)):
            name = n.name
            break
        queue.extend(ast.iter_child_nodes(n))
    return {"valid": True, "has_if": ifs > 0, "has_loop": loops > 0, "has_switch": count(ast.Match) > 0, "complexity": 2 * defs + 3 * classes + ifs + 2 * loops + 2 * tries, "complexity_v1": 2 * defs + 3 * classes + ifs + loops, "defs": defs + classes, "primary_name": name}


# ---- slices ---------------------------------------------------------------------------------------------------------


def split_top_level(code: str) -> list[tuple[str | None, str]]:
    """(name, text) of each top-level function by its lines; the whole text, without a name, if there is none."""
    code = code.strip()
    if not code:
        return []
    try:
        found = [n for n in ast.parse(code).body if isinstance(n, Functions)]
    except (SyntaxError, ValueError, RecursionError):
        found = []
    lines = code.splitlines()
    return [(n.name, "\n".join(lines[n.lineno - 1 : n.end_lineno]) + "\n") for n in found] or [(None, code + "\n")]


def extract_functions(code: str) -> list[dict]:
    """Every function at any depth: name, code, line range, docstring."""
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError, RecursionError):
        return []
    lines = code.split("\n")
    found = sorted((n for n in ast.walk(tree) if isinstance(n, ast.FunctionDef)), key=lambda n: n.lineno)
    return [{"function_name": n.name, "code": "\n".join(lines[n.lineno - 1 : n.end_lineno]), "line_range": f"{n.lineno}-{n.end_lineno}", "docstring": ast.get_docstring(n) or ""} for n in found]


def _literal(e: ast.expr) -> bool:
    if isinstance(e, (ast.Tuple, ast.List, ast.Set)):
        return all(map(_literal, e.elts))
    if isinstance(e, ast.Dict):
        return all(k is not None and _literal(k) and _literal(v) for k, v in zip(e.keys, e.values))
    return isinstance(e, ast.Constant) or number(e) is not None


def slice_functions(code: str, most: int = 4000) -> list[dict]:
    """One small module for each top-level function: imports, the constants it reads, stubs of the helpers it calls, itself.

    Constants of more than `most` characters are left out of the module and named in dropped_consts.
    """
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError, RecursionError):
        return []
    imports = [n for n in tree.body if isinstance(n, (ast.Import, ast.ImportFrom))]
    functions = {n.name: n for n in tree.body if isinstance(n, ast.FunctionDef)}
    constants = {n.targets[0].id: n for n in tree.body if isinstance(n, ast.Assign) and len(n.targets) == 1 and isinstance(n.targets[0], ast.Name) and _literal(n.value)}
    out = []
    for name, fn in functions.items():
        nodes = list(ast.walk(fn))
        a = fn.args
        local = {x.arg for x in (*a.posonlyargs, *a.args, *a.kwonlyargs, a.vararg, a.kwarg) if x} | {n.id for n in nodes if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store)} | {n.name for n in nodes if isinstance(n, ast.ExceptHandler) and n.name}
        reads = {n.id for n in nodes if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Load)} - local - set(dir(builtins))
        called = {n.func.id if isinstance(n.func, ast.Name) else n.func.attr for n in nodes if isinstance(n, ast.Call) and isinstance(n.func, (ast.Name, ast.Attribute))}
        read = [c for c in constants if c in reads]
        needed = [c for c in read if len(ast.unparse(constants[c])) <= most]
        helpers = [h for h in functions if h in called and h != name]
        stub = lambda h: ast.FunctionDef(h, functions[h].args, [ast.Raise(call("NotImplementedError"))], [], type_params=[])
        body = [*imports, *(constants[c] for c in needed), *map(stub, helpers), fn]
        text = ast.unparse(ast.fix_missing_locations(ast.Module(body, [])))
        out.append({"function": name, "code": text, "needed_consts": needed, "dropped_consts": [c for c in read if c not in needed], "stubbed_helpers": helpers, "imports_included": len(imports), "lines_out": len(text.splitlines())})
    return out
