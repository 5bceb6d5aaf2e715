"""The routes' expression language, compiled once to Spark columns.

Slots are VARIANT columns. A missing path is SQL NULL, an explicit null is the
variant null, so the two never mix. An expression compiles to a value and an
error column; the error is null where the value is good.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"""\s*(?:(?P<num>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<str>"(?:[^"\\]|\\.)*")|(?P<field>\.[A-Za-z_][A-Za-z0-9_]*)
    |(?P<var>\$[A-Za-z_][A-Za-z0-9_]*)|(?P<word>[A-Za-z_][A-Za-z0-9_]*)|(?P<op>//|==|!=|<=|>=|[.|\[\]{}(),:;?+\-*/%<>]))""",
    re.X,
)


class ExpressionError(ValueError):
    """A text that is no expression, or one that has no column form."""


def tokenise(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m or m.end() == at:
            raise ExpressionError(f"cannot read {text[at:]!r}")
        out.append((m.lastgroup, m.group(m.lastgroup)))
        at = m.end()
    return out


class Parser:
    """Precedence climbing over pipes, commas, alternatives, comparisons and arithmetic."""

    LEVELS = [["|"], [","], ["//"], ["or"], ["and"], ["==", "!=", "<", "<=", ">", ">="], ["+", "-"], ["*", "/", "%"]]
    #: Where a comma ends a field instead of joining results.
    ITEM = 2

    def __init__(self, text: str):
        self.tokens, self.at = tokenise(text), 0

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) else None

    def take(self, wanted: str | None = None) -> tuple[str, str]:
        if self.at >= len(self.tokens) or (wanted and self.tokens[self.at][1] != wanted):
            raise ExpressionError(f"expected {wanted or 'more'}, found {self.peek()}")
        self.at += 1
        return self.tokens[self.at - 1]

    def variable(self) -> str:
        kind, text = self.take()
        if kind != "var":
            raise ExpressionError(f"expected a variable, found {text!r}")
        return text

    def parse(self) -> tuple:
        tree = self.level(0)
        if self.peek() is not None:
            raise ExpressionError(f"unexpected {self.peek()!r}")
        return tree

    def level(self, n: int) -> tuple:
        if n == len(self.LEVELS):
            return self.postfix()
        left = self.level(n + 1)
        if n == 0 and self.peek() == "as":
            self.take()
            name = self.variable()
            self.take("|")
            return ("bind", left, name, self.level(0))
        while self.peek() in self.LEVELS[n]:
            op = self.take()[1]
            # what follows a pipe may bind a variable for all that comes after it
            left = ("op", op, left, self.level(0 if n == 0 else n + 1))
        return left

    def postfix(self) -> tuple:
        node = self.term()
        while self.peek() in ("[", "?") or (self.at < len(self.tokens) and self.tokens[self.at][0] == "field"):
            node = self.suffix(node)
        return node

    def suffix(self, node: tuple) -> tuple:
        kind, text = self.take()
        if kind == "field":
            return ("get", node, text[1:])
        if text == "?":
            return ("try", node)
        if self.peek() == "]":
            self.take()
            return ("each", node)
        sign = -1 if self.peek() == "-" and self.take() else 1
        kind, text = self.take()
        if kind not in ("num", "str") or (kind == "str" and sign < 0):
            raise ExpressionError("only literal keys and indexes are supported")
        self.take("]")
        return ("get", node, sign * int(text) if kind == "num" else json.loads(text))

    def term(self) -> tuple:
        kind, text = self.take()
        if kind in ("num", "str"):
            return ("lit", json.loads(text))
        if kind == "field":
            return ("get", ("self",), text[1:])
        if kind == "var":
            return ("var", text)
        if text == ".":
            if self.peek() == "[":
                return self.suffix(("self",))
            return ("self",)
        if text == "(":
            inner = self.level(0)
            self.take(")")
            return inner
        if text == "-":
            return ("op", "-", ("lit", 0), self.postfix())
        if text == "[":
            items = []
            if self.peek() != "]":
                tree = self.level(0)
                while tree[:2] == ("op", ","):
                    items, tree = [tree[3], *items], tree[2]
                items = [tree, *items]
            self.take("]")
            return ("array", items)
        if text == "{":
            return self.fields()
        if text in ("true", "false", "null"):
            return ("lit", json.loads(text))
        if text == "if":
            return self.condition()
        if text == "try":
            return ("try", self.postfix())
        if text == "reduce":
            source = self.postfix()
            self.take("as")
            name = self.variable()
            self.take("(")
            start = self.level(0)
            self.take(";")
            step = self.level(0)
            self.take(")")
            return ("reduce", source, name, start, step)
        if text in ("not", "length", "tostring", "tonumber", "keys", "type"):
            return ("call", text)
        raise ExpressionError(f"unknown name {text!r}")

    def fields(self) -> tuple:
        fields = []
        while self.peek() != "}":
            kind, key = self.take()
            key = json.loads(key) if kind == "str" else key.lstrip("$")
            if self.peek() == ":":
                self.take()
                fields.append((key, self.level(self.ITEM)))
            else:
                fields.append((key, ("var", f"${key}") if kind == "var" else ("get", ("self",), key)))
            if self.peek() == ",":
                self.take()
        self.take("}")
        return ("object", fields)

    def condition(self) -> tuple:
        test = self.level(0)
        self.take("then")
        yes = self.level(0)
        if self.peek() == "elif":
            self.take()
            return ("if", test, yes, self.condition())
        no: tuple = ("self",)
        if self.peek() == "else":
            self.take()
            no = self.level(0)
        self.take("end")
        return ("if", test, yes, no)


def canonical(text: str) -> str:
    """``$.n.rest`` as ``.[n].rest``; other texts stay."""
    m = re.fullmatch(r"\$\.(\d+)(.*)", text.strip(), re.S)
    if m:
        return f".[{m[1]}]{m[2]}"
    if text.strip().startswith("$."):
        raise ExpressionError(f"{text!r} names no slot")
    return text.strip()


def _null() -> Column:
    return F.parse_json(F.lit("null"))


def variant_literal(value: Any) -> Column:
    return F.parse_json(F.lit(json.dumps(value)))


def _or_null(v: Column) -> Column:
    return F.coalesce(v, _null())


def _truth(v: Column) -> Column:
    """False for null, false and missing, else true."""
    return F.coalesce(~F.is_variant_null(v) & (F.to_json(v) != "false"), F.lit(False))


def _shape(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def _long(v: Column) -> Column:
    """A whole number that fits in 64 bits, else null."""
    return F.when(_shape(v) == "BIGINT", F.try_variant_get(v, "$", "bigint"))


def _number(v: Column) -> Column:
    return F.when(_shape(v).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(v, "$", "double"))


def _string(v: Column) -> Column:
    return F.when(_shape(v) == "STRING", v.cast("string"))


def _items(v: Column) -> Column:
    return F.when(_shape(v).startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>"))


def _members(v: Column) -> Column:
    return F.when(_shape(v).startswith("OBJECT"), F.try_variant_get(v, "$", "map<string,variant>"))


def _text(v: Column) -> Column:
    return F.when(F.schema_of_variant(v) == "STRING", v.cast("string")).otherwise(F.to_json(v))


_ORDER = "array<struct<kind:int,number:double,whole:bigint,text:string>>"


def _sort_key(v: Column) -> Column:
    """Order of values: null, false, true, numbers, text, arrays item by item, objects by keys, then values.

    Numbers compare as doubles, whole ones then exactly. Values inside a
    container's items compare by their JSON text.
    """
    v = _or_null(v)

    def entry(x: Column, text: Column | None = None) -> Column:
        shape = _shape(x)
        kind = (
            F.when(F.is_variant_null(x), 0).when(shape == "BOOLEAN", F.when(F.to_json(x) == "true", 2).otherwise(1))
            .when(shape == "STRING", 4).when(shape.startswith("ARRAY"), 5).when(shape.startswith("OBJECT"), 6).otherwise(3)
        )
        own = F.coalesce(_string(x), F.to_json(x)) if text is None else text
        return F.struct(
            kind.alias("kind"), F.when(kind == 3, _number(x)).alias("number"), F.when(kind == 3, F.coalesce(_long(x), F.lit(0))).alias("whole"),
            F.when(kind >= 4, own).alias("text"),
        )

    keys = F.array_sort(F.map_keys(_members(v)))
    values = F.transform(keys, lambda k: F.element_at(_members(v), k))
    inner = F.coalesce(F.transform(_items(v), entry), F.transform(values, entry), F.expr(f"cast(array() as {_ORDER})"))
    outer = F.when(_items(v).isNotNull(), F.lit("")).when(keys.isNotNull(), F.to_json(keys)).otherwise(F.coalesce(_string(v), F.to_json(v)))
    return F.concat(F.array(entry(v, outer)).cast(_ORDER), inner.cast(_ORDER))


def _from_double(d: Column) -> Column:
    """A number as JSON would write it: whole ones without a fraction."""
    whole = (d == F.floor(d)) & (F.abs(d) < 9e15)
    return F.when(whole, d.cast("bigint").cast("variant")).otherwise(d.cast("variant"))


def _same(x: Column, y: Column) -> Column:
    return _sort_key(x) == _sort_key(y)


def _arithmetic(op: str, a: Column, b: Column) -> Column:
    """``a op b``; null where the types do not fit. Whole numbers stay exact as long as they fit in 64 bits."""
    x, y, m, n = _number(a), _number(b), _long(a), _long(b)
    s, t = _string(a), _string(b)
    if op == "+":
        merged = F.map_zip_with(_members(a), _members(b), lambda k, v, w: F.coalesce(w, v))
        return (
            F.when(F.is_variant_null(a), b).when(F.is_variant_null(b), a)
            .when(x.isNotNull(), F.coalesce(F.try_add(m, n).cast("variant"), _from_double(x + y)))
            .when(s.isNotNull(), F.concat(s, t).cast("variant"))
            .when(_items(a).isNotNull(), F.to_variant_object(F.concat(_items(a), _items(b))))
            .otherwise(F.to_variant_object(merged))
        )
    if op == "-":
        left = F.filter(_items(a), lambda v: ~F.exists(_items(b), lambda w: F.to_json(v) == F.to_json(w)))
        number = F.coalesce(F.try_subtract(m, n).cast("variant"), _from_double(x - y))
        return F.coalesce(number, F.when(_items(b).isNotNull(), F.to_variant_object(left)))
    if op == "*":
        times = F.when(y > 0, F.repeat(s, F.ceil(y).cast("int"))).otherwise(F.lit(None))
        repeated = F.when(s.isNotNull() & y.isNotNull(), F.coalesce(times.cast("variant"), _null()))
        return F.coalesce(F.try_multiply(m, n).cast("variant"), _from_double(x * y), repeated)
    if op == "/":
        pieces = F.split(s, F.concat(F.lit("\\Q"), t, F.lit("\\E")), -1)
        return F.coalesce(_from_double(F.try_divide(x, y)), F.to_variant_object(F.transform(pieces, lambda p: p.cast("variant"))))
    whole = F.try_mod(F.coalesce(m, x.cast("bigint")), F.coalesce(n, y.cast("bigint")))
    return whole.cast("variant")


def _step(key: str | int) -> str:
    if isinstance(key, int):
        return f"[{key}]"
    return f".{key}" if re.fullmatch("[A-Za-z_][A-Za-z0-9_]*", key) else "[" + json.dumps(key).replace('"', "'") + "]"


@dataclass
class Slots:
    """Columns of the slots that an expression may read; ``sequence`` numbers the events of a plan, if they have it."""

    columns: list[Column]
    sequence: Column | None = None


#: Trees whose number of results depends on the data.
_MANY = ("each", "try")


def _children(tree: Any) -> list:
    """Subtrees of a tree."""
    if tree[0] == "object":
        return [x for _, x in tree[1]]
    if tree[0] == "array":
        return list(tree[1])
    return [x for x in tree[1:] if isinstance(x, tuple)]


def several(tree: tuple) -> bool:
    """Whether a tree may have any number of results other than one."""
    if tree[0] in _MANY or (tree[0] == "op" and tree[1] == ","):
        return True
    if tree[0] in ("array", "reduce"):
        return False  # all results of the items become one value
    return any(several(x) for x in _children(tree))


def _get(base: Column, *keys: str | int) -> Column:
    """What lies below a value; a single key may count from the end."""
    if isinstance(keys[0], int) and keys[0] < 0:
        return F.try_element_at(_items(base), F.lit(keys[0]))
    return F.try_variant_get(base, "$" + "".join(map(_step, keys)), "variant")


def _call(name: str, v: Column) -> Column:
    shape = _shape(v)
    if name == "not":
        return (~_truth(v)).cast("variant")
    if name == "tostring":
        return _text(v).cast("variant")
    if name == "tonumber":
        whole = _text(v).try_cast("bigint").cast("variant")
        return F.coalesce(F.when(~_text(v).rlike("[.eE]"), whole), _from_double(_text(v).try_cast("double")))
    if name == "length":
        size = F.when(F.is_variant_null(v), 0).when(_items(v).isNotNull(), F.size(_items(v))).when(_members(v).isNotNull(), F.size(_members(v)))
        return F.coalesce(size, F.when(_number(v).isNull(), F.length(_text(v)))).cast("bigint").cast("variant")
    if name == "keys":
        return F.to_variant_object(F.array_sort(F.map_keys(_members(v))))
    kinds = (("STRING", "string"), ("BOOLEAN", "boolean"), ("ARRAY", "array"), ("OBJECT", "object"), ("VOID", "null"))
    out = F.lit('"number"')
    for start, kind in kinds:
        out = F.when(shape.startswith(start), f'"{kind}"').otherwise(out)
    return F.parse_json(out)


_COMPARE = {
    "==": lambda x, y: x == y, "!=": lambda x, y: x != y, "<": lambda x, y: x < y,
    "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y,
}
_MIRROR = {"==": "==", "!=": "!=", "<": ">", "<=": ">=", ">": "<", ">=": "<="}


def _compare(op: str, a: Column, b: Column) -> Column:
    """``a op b`` in the order of :func:`_sort_key`; numbers and texts need no key."""
    of = _COMPARE[op]
    numbers = F.coalesce(of(_long(a), _long(b)), of(_number(a), _number(b)))
    return F.coalesce(numbers, of(_string(a), _string(b)), of(_sort_key(a), _sort_key(b)))


def _compare_literal(op: str, v: Column, value: Any) -> Column:
    """``v op value`` for a number or a text: values of other types are all less or all greater."""
    of = _COMPARE[op]
    shape = _shape(v)
    if isinstance(value, str):
        own, less = of(_string(v), F.lit(value)), ~shape.rlike("^(ARRAY|OBJECT)")
    else:
        own = of(_number(v), F.lit(float(value)))
        if isinstance(value, int):
            own = F.coalesce(of(_long(v), F.lit(value)), own)
        less = shape.isin("VOID", "BOOLEAN")
    other = {"==": F.lit(False), "!=": F.lit(True)}.get(op, less if op in ("<", "<=") else ~less)
    return F.coalesce(own, other)


def _operator(op: str, a: Column, b: Column) -> Column:
    if op in ("and", "or"):
        both = _truth(a) & _truth(b) if op == "and" else _truth(a) | _truth(b)
        return both.cast("variant")
    if op in _COMPARE:
        return _compare(op, a, b).cast("variant")
    return _arithmetic(op, a, b)


def _plain(tree: tuple) -> bool:
    """Whether a tree is a number or a text, whose comparisons need no key."""
    return tree[0] == "lit" and isinstance(tree[1], int | float | str) and not isinstance(tree[1], bool)


@dataclass
class _Scope:
    """What a subtree sees: the input of the pipe (None: all slots), the slots and the variables."""

    here: Column | None
    slots: Slots
    names: dict[str, Column] = field(default_factory=dict)

    def at(self, here: Column | None) -> _Scope:
        return replace(self, here=here)

    def with_name(self, name: str, value: Column) -> _Scope:
        return replace(self, names={**self.names, name: value})


def _slot(tree: tuple, scope: _Scope) -> Column | None:
    """The column of a slot, if the tree names one."""
    if tree[0] != "get" or tree[1] != ("self",) or scope.here is not None:
        return None
    if not isinstance(tree[2], int) or tree[2] < 0:
        raise ExpressionError("an expression begins with a slot such as .[0]")
    columns = scope.slots.columns
    return columns[tree[2]] if tree[2] < len(columns) else F.lit(None).cast("variant")


def _one(tree: tuple, scope: _Scope) -> Column:
    """The value of a tree that has exactly one result."""
    kind = tree[0]
    if kind == "self":
        if scope.here is None:
            raise ExpressionError("the array of all slots has no column form")
        return scope.here
    if kind == "lit":
        return variant_literal(tree[1])
    if kind == "var":
        if tree[1] not in scope.names:
            raise ExpressionError(f"unknown variable {tree[1]}")
        return scope.names[tree[1]]
    if kind == "get":
        keys: list[str | int] = []
        # one look along the whole path, down to a slot, an index from the end or another kind of tree
        while tree[0] == "get" and _slot(tree, scope) is None and not (isinstance(tree[2], int) and tree[2] < 0):
            keys, tree = [tree[2], *keys], tree[1]
        if not keys:
            slot = _slot(tree, scope)
            return _get(_one(tree[1], scope), tree[2]) if slot is None else slot
        return _get(_one(tree, scope), *keys)
    if kind == "array":
        if any(several(x) for x in tree[1]):
            return F.to_variant_object(F.flatten(F.array(*(F.transform(_every(x, scope), _or_null) for x in tree[1]))))
        return F.to_variant_object(F.array(*(_or_null(_one(x, scope)) for x in tree[1]))) if tree[1] else variant_literal([])
    if kind == "object":
        fields = [_or_null(_one(x, scope)).alias(k) for k, x in tree[1]]
        return F.to_variant_object(F.struct(*fields)) if fields else variant_literal({})
    if kind == "if":
        return F.when(_truth(_one(tree[1], scope)), _one(tree[2], scope)).otherwise(_one(tree[3], scope))
    if kind == "call":
        return _call(tree[1], _or_null(scope.here))
    if kind == "bind":
        return _one(tree[3], scope.with_name(tree[2], _or_null(_one(tree[1], scope))))
    if kind == "reduce":
        _, source, name, start, step = tree
        first = _or_null(_one(start, scope))
        return F.aggregate(
            _every(source, scope), first, lambda total, x: _or_null(_one(step, scope.at(total).with_name(name, _or_null(x))))
        )
    _, op, left, right = tree
    a = _one(left, scope)
    if op == "|":
        return _one(right, scope.at(_or_null(a)))
    b = _one(right, scope)
    if op == "//":
        return F.when(_truth(a), a).otherwise(b)
    if op in _COMPARE and _plain(right):
        return _compare_literal(op, _or_null(a), right[1]).cast("variant")
    if op in _COMPARE and _plain(left):
        return _compare_literal(_MIRROR[op], _or_null(b), left[1]).cast("variant")
    # an absent field is null to an operator; what an operator could not compute stays without a value
    a, b = (_or_null(v) if t[0] == "get" else v for t, v in ((left, a), (right, b)))
    return _operator(op, a, b)


def _every(tree: tuple, scope: _Scope) -> Column:
    """All results of a tree in order, as ``array<variant>``; one that fails is null."""
    if not several(tree):
        return F.array(_one(tree, scope))
    kind = tree[0]

    def each(source: tuple, then) -> Column:
        return F.flatten(F.transform(_every(source, scope), then))

    if kind == "get":
        return F.transform(_every(tree[1], scope), lambda x: _get(x, tree[2]))
    if kind == "each":
        none = F.expr("array(cast(null as variant))")
        inner = lambda x: F.coalesce(_items(x), F.map_values(_members(x)), none)
        return each(tree[1], inner)
    if kind == "try":
        return F.filter(_every(tree[1], scope), lambda x: x.isNotNull())
    if kind == "bind":
        return each(tree[1], lambda x: _every(tree[3], scope.with_name(tree[2], _or_null(x))))
    if kind == "if":
        return each(tree[1], lambda x: F.when(_truth(x), _every(tree[2], scope)).otherwise(_every(tree[3], scope)))
    if kind == "object":
        raise ExpressionError("a field with several results has no column form")
    _, op, left, right = tree
    if op == ",":
        return F.concat(_every(left, scope), _every(right, scope))
    if op == "|":
        return each(left, lambda x: _every(right, scope.at(_or_null(x))))
    if op == "//":
        good = F.filter(_every(left, scope), _truth)
        return F.when(F.size(good) > 0, good).otherwise(_every(right, scope))
    # the right side varies slowest
    return each(right, lambda y: F.transform(_every(left, scope), lambda x: _operator(op, x, y)))


def is_path(tree: tuple) -> bool:
    """Whether a tree is a plain slot path."""
    return tree[0] == "self" or (tree[0] == "get" and is_path(tree[1]))


def _slot_of(tree: tuple) -> int | None:
    while tree[0] == "get" and tree[1] != ("self",):
        tree = tree[1]
    return tree[2] if tree[0] == "get" and isinstance(tree[2], int) else None


def _paths(tree: tuple) -> list[tuple]:
    """Plain slot paths within a tree."""
    if is_path(tree) and _slot_of(tree) is not None:
        return [tree]
    if tree[0] == "op" and tree[1] == "|":
        return _paths(tree[2])  # what follows a pipe reads its input
    return [p for x in _children(tree) for p in _paths(x)]


def resolve(text: str, slots: Slots) -> tuple[Column, Column]:
    """Value and error kind of an expression: missing paths are errors, nulls are values.

    ``MissingSlot`` for a slot that no phase has filled, ``TypeMismatch`` if a key
    is asked of what is no object (or an index of what is no array), ``NoResults``
    and ``MultipleResults`` unless there is exactly one, ``Runtime`` if an operator
    does not fit its values, else ``MissingPath``.
    """
    tree = Parser(canonical(text)).parse()
    scope = _Scope(None, slots)
    slot = _slot_of(tree)
    if is_path(tree) and slot is not None and slot >= len(slots.columns):
        return F.lit(None).cast("variant"), F.lit("MissingSlot")
    if not is_path(tree):
        absent = F.lit(False)
        for path in _paths(tree):
            absent = absent | _one(path, scope).isNull()
        count = None
        if several(tree):
            results = _every(tree, scope)
            count, value = F.size(results), F.get(results, F.lit(0))
        else:
            value = _one(tree, scope)
        # a null that an operator made counts as missing
        missing = value.isNull() | F.is_variant_null(value)
        error = F.when(value.isNull() & ~absent, F.lit("Runtime")).when(missing, F.lit("MissingPath"))
        if count is not None:
            error = F.when(count == 0, F.lit("NoResults")).when(count > 1, F.lit("MultipleResults")).otherwise(error)
        return F.when(error.isNull(), value) if count is not None else value, error
    value = _one(tree, scope)
    kind = F.lit("MissingPath")
    node = tree
    while node[0] == "get" and node[1] != ("self",):
        parent = _one(node[1], scope)
        wanted = "ARRAY" if isinstance(node[2], int) else "OBJECT"
        kind = F.when(
            parent.isNotNull() & ~F.schema_of_variant(parent).startswith(wanted), F.lit("TypeMismatch")
        ).otherwise(kind)
        node = node[1]
    return value, F.when(value.isNull(), kind)


def stringify(v: Column) -> Column:
    """Text of a value in a template: null is empty, strings are bare, the rest is JSON."""
    return F.when(F.is_variant_null(v), F.lit("")).otherwise(_text(v))


_PLACEHOLDER = re.compile(r"""(?:^|(?<=[\s({\[<>"':,]))\.[A-Za-z0-9_.\[\]]+""")


def string_template(text: str, slots: Slots) -> tuple[Column, Column]:
    """A template string: an expression, a quoted literal, or text with placeholders."""
    bare = text.strip()
    if bare.startswith((".", "$.")):
        return resolve(bare, slots)
    if len(bare) >= 2 and bare[0] == bare[-1] and bare[0] in "\"'":
        inner = bare[1:-1]
        if bare[0] == '"':
            inner = re.sub(r"\\(.)", lambda m: {"n": "\n", "r": "\r", "t": "\t"}.get(m[1], m[1]), inner)
        return variant_literal(inner), F.lit(None).cast("string")
    parts, errors, at = [], [], 0
    for m in _PLACEHOLDER.finditer(text):
        value, error = resolve(m[0], slots)
        parts += [F.lit(text[at : m.start()]), stringify(value)]
        errors.append(error)
        at = m.end()
    if not parts:
        return variant_literal(text), F.lit(None).cast("string")
    joined = F.concat(*parts, F.lit(text[at:]))
    return joined.cast("variant"), F.coalesce(*errors)


def template(node: Any, slots: Slots) -> tuple[Column, Column]:
    """Value and error of a template tree; objects and arrays are resolved inside."""
    none = F.lit(None).cast("string")
    if isinstance(node, dict):
        if not node:
            return variant_literal({}), none
        items = {k: template(v, slots) for k, v in node.items()}
        value = F.to_variant_object(F.struct(*(_or_null(v).alias(k) for k, (v, _) in items.items())))
        return value, F.coalesce(*(e for _, e in items.values()), none)
    if isinstance(node, list):
        if not node:
            return variant_literal([]), none
        values = [template(v, slots) for v in node]
        return F.to_variant_object(F.array(*(_or_null(v) for v, _ in values))), F.coalesce(*(e for _, e in values), none)
    if isinstance(node, str):
        return string_template(node, slots)
    return variant_literal(node), none
