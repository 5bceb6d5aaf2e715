"""The expression language on one event: values, errors, templates."""

import json

import pytest
from pyspark.sql import functions as F

from weirflow.functions import expressions as ex

EVENT = {
    "header": {"id": "h-1"},
    "body": {
        "tags": ["a", "b", "c"], "none": [], "one": [7], "n": 5, "big": 9007199254740993, "rate": 2.5, "off": False, "nil": None,
        "name": "Ann", "nested": {"deep": {"x": 1}}, "rows": [{"v": 2}, {"v": 3}, {}], "r": 3, "size": {"a": 1, "b": 2},
    },
}
SECOND = {"kept": "yes", "count": 1}

VALUES = {
    ".[0].body.n": 5,
    "$.0.body.n": 5,
    ".[1].kept": "yes",
    ".[0].body.tags[1]": "b",
    ".[0].body.tags[-1]": "c",
    '.[0].body["name"]': "Ann",
    ".[0].body.nil": None,
    ".[0].body.off": False,
    ".[0].body.tags": ["a", "b", "c"],
    ".[0].body | {n: .n, pair: [.n, .name], size}": {"n": 5, "pair": [5, "Ann"], "size": {"a": 1, "b": 2}},
    ".[0].body.missing // 9": 9,
    ".[0].body.off // 9": 9,
    ".[0].body.nil // .[1].kept": "yes",
    ".[0].body.n + 1": 6,
    ".[0].body.r-1": 2,
    ".[0].body.n * 2 - 1": 9,
    ".[0].body.n / 2": 2.5,
    ".[0].body.n % 3": 2,
    ".[0].body.big + 1": 9007199254740994,
    ".[0].body.big == 9007199254740992": False,
    ".[0].body.rate + 1": 3.5,
    "null + .[0].body.n": 5,
    '.[0].body.name + "!"': "Ann!",
    ".[0].body.tags + [1]": ["a", "b", "c", 1],
    '.[0].body.tags - ["b"]': ["a", "c"],
    ".[0].body.size + {b: 3}": {"a": 1, "b": 3},
    '"a-b" / "-"': ["a", "b"],
    '"ab" * 2': "abab",
    "[9] < [10]": True,
    "[1, 2] < [1]": False,
    '"a" < "b"': True,
    "1 < true": False,
    "null < false": True,
    "{a: 2} < {a: 10}": True,
    ".[0].body.n > 4 and .[0].body.n < 9": True,
    ".[0].body.off or false": False,
    ".[0].body.off | not": True,
    'if .[0].body.n > 9 then "big" elif .[0].body.n > 4 then "mid" else "low" end': "mid",
    ".[0].body.tags | length": 3,
    ".[0].body.size | keys": ["a", "b"],
    '"12" | tonumber': 12,
    "12 | tostring": "12",
    ".[0].body.name | type": "string",
    ".[0].body.one[]": 7,
    "[.[0].body.tags[]]": ["a", "b", "c"],
    "[.[0].body.rows[] | .v // 0]": [2, 3, 0],
    "[.[0].body.rows[].v]": [2, 3, None],
    "[.[0].body.size[]]": [1, 2],
    "[.[0].body.n, .[0].body.r]": [5, 3],
    "[(1, 2) + (10, 20)]": [11, 12, 21, 22],
    "reduce .[0].body.tags[] as $t (\"\"; . + $t)": "abc",
    "reduce (1, 2, 3) as $x (0; . + $x * $x)": 14,
    ".[0].body.n as $n | [$n, $n + 1]": [5, 6],
    "[.[0].body.n[]?]": [],
    "[.[0].body.tags[]?]": ["a", "b", "c"],
    "[try .[0].body.n[]]": [],
    "[]": [],
    "{}": {},
    "-1": -1,
}
ERRORS = {
    ".[0].body.absent": "MissingPath",
    ".[0].body.tags[9]": "MissingPath",
    ".[4].x": "MissingSlot",
    ".[0].body.name.x": "TypeMismatch",
    ".[0].body.n[0]": "TypeMismatch",
    ".[0].body.tags.x": "TypeMismatch",
    ".[0].body.tags[]": "MultipleResults",
    ".[0].body.n, .[0].body.r": "MultipleResults",
    ".[0].body.none[]": "NoResults",
    '5 + "b"': "Runtime",
    '.[0].body.n + "b"': "Runtime",
    "[1] - 1": "Runtime",
    ".[0].body.absent + 1": None,
    ".[0].body.absent - 1": "MissingPath",
    ".[0].body.n": None,
    ".[0].body.nil": None,
}
REFUSED = (".[0].a |", "{", ".5.x(", "$.body", ".[0] | map(.x)", "$x", ".[0].a[", '"open')
TEMPLATES = [
    ("id: .[1].kept, n=.[0].body.n", "id: yes, n=.[0].body.n"),
    ("id: .[1].kept (.[0].body.n)", "id: yes (5)"),
    ("nil: .[0].body.nil!", "nil: !"),
    ("list .[0].body.one end", "list [7] end"),
    ("'plain .[0].x'", "plain .[0].x"),
    ('"two\\nlines \\"quoted\\""', 'two\nlines "quoted"'),
    ("no paths here", "no paths here"),
    (" .[0].body.n ", 5),
    ({"a": [".[0].body.n", {"b": ".[1].kept"}], "c": 7, "d": None}, {"a": [5, {"b": "yes"}], "c": 7, "d": None}),
    ([], []),
]


@pytest.fixture(scope="module")
def event(spark):
    row = spark.createDataFrame([(json.dumps(EVENT), json.dumps(SECOND))], "a string, b string")
    return row.select(F.parse_json("a").alias("s0"), F.parse_json("b").alias("s1"))


SLOTS = ("s0", "s1")


def _slots():
    return ex.Slots([F.col(s) for s in SLOTS])


def test_values(event):
    columns = []
    for i, text in enumerate(VALUES):
        value, error = ex.resolve(text, _slots())
        columns += [F.to_json(value).alias(f"v{i}"), error.alias(f"e{i}")]
    row = event.select(*columns).first()
    for i, (text, wanted) in enumerate(VALUES.items()):
        got, error = row[f"v{i}"], row[f"e{i}"]
        assert error is None and json.loads(got) == wanted, (text, got, error)


def test_errors(event):
    row = event.select(*(ex.resolve(text, _slots())[1].alias(f"e{i}") for i, text in enumerate(ERRORS))).first()
    assert {text: row[f"e{i}"] for i, text in enumerate(ERRORS)} == ERRORS


@pytest.mark.parametrize("text", REFUSED)
def test_refused(spark, text):
    with pytest.raises(ValueError):
        ex.resolve(text, ex.Slots([F.col("s0")]))


def test_templates(event):
    row = event.select(*(F.to_json(ex.template(t, _slots())[0]).alias(f"v{i}") for i, (t, _) in enumerate(TEMPLATES))).first()
    for i, (text, wanted) in enumerate(TEMPLATES):
        assert json.loads(row[f"v{i}"]) == wanted, (text, row[f"v{i}"])
