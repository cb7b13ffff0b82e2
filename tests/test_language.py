"""The query language on the hand-made models."""

import pytest

from codeloom.operators.predicates import where_all
from codeloom.plans import dsl
from tests import fixtures


@pytest.fixture(scope="module")
def ops(spark):
    return fixtures.operators(spark)


@pytest.fixture(scope="module")
def service(spark):
    return fixtures.service(spark)


@pytest.fixture(scope="module")
def mvc(spark):
    return fixtures.mvc(spark)


def ids(c, q, **how):
    return sorted(r["id"] for r in dsl.execute(c, q, **how).collect())


def cond(field, operator, value):
    return {"field": field, "operator": operator, "value": value}


@pytest.mark.parametrize(
    "field,operator,value,expected",
    [
        ("name", "eq", "getUser", [1]),
        ("name", "eq", None, [10]),
        ("name", "ne", "getUser", [2, 3, 4, 5, 6, 7, 8, 9]),
        ("name", "ne", None, [1, 2, 3, 4, 5, 6, 7, 8, 9]),
        ("line_number_start", "gt", 30, [5]),
        ("line_number_start", "gt", "30", [5]),
        ("line_number_start", "lt", 10, [10]),
        ("line_number_start", "ge", 30, [4, 5, 9]),
        ("line_number_start", "le", 10, [1, 6, 10]),
        ("name", "like", "get%", [1, 2]),
        ("name", "like", "GET%", []),
        ("name", "ilike", "GET%", [1, 2]),
        ("name", "in", ["getUser", "createUser", "deleteUser"], [1, 3, 5]),
        ("name", "in", [], []),
        ("name", "not_in", ["getUser"], [2, 3, 4, 5, 6, 7, 8, 9]),
        ("name", "not_in", [], list(range(1, 11))),
        ("name", "contains", "User", [1, 2, 3, 4, 5, 6, 7, 9]),
        ("name", "startswith", "find", [6, 7]),
        ("name", "endswith", "Users", [2, 7]),
        ("line_number_start", "between", [20, 30], [3, 4, 8, 9]),
        ("name", "is_null", True, [10]),
        ("name", "is_null", False, [1, 2, 3, 4, 5, 6, 7, 8, 9]),
        ("name", "like", "a\\b%", []),
    ],
)
def test_operators(ops, field, operator, value, expected):
    assert ids(ops, {"conditions": [cond(field, operator, value)]}) == expected


def test_conditions_add_up(ops):
    q = {"type": "function", "conditions": [cond("name", "contains", "User"), cond("line_number_start", "gt", 10), cond("src_loc", "endswith", "db.hs:30")]}
    assert ids(ops, q) == [9]
    assert len(ids(ops, {"type": "function", "conditions": []})) == 10


def test_unknown_names(ops):
    for q in ({"conditions": [cond("nope", "eq", 1)]}, {"conditions": [cond("name", "nope", 1)]}, {"type": "type", "joins": [{"type": "function"}]}):
        with pytest.raises(ValueError):
            dsl.execute(ops, q)
        assert dsl.execute(ops, q, strict=False).count() > 0
    with pytest.raises(ValueError):
        dsl.execute(ops, {"type": "nope"}, strict=False)


def test_wildcards(ops):
    q = {"conditions": [cond("name", "contains", "get%Users")]}
    assert ids(ops, q) == [] and ids(ops, q, wildcards=True) == [2]


def test_joins(service):
    callers = {"conditions": [cond("name", "eq", "processData")], "joins": [{"type": "calling_function"}]}
    assert ids(service, callers) == [3, 5]
    assert ids(service, {"type": "module", "conditions": [cond("name", "eq", "app.handlers")], "joins": [{"type": "function"}]}) == [3, 5]
    nested = {"type": "module", "conditions": [cond("name", "eq", "app.core")], "joins": [{"type": "function", "joins": [{"type": "called_by"}]}]}
    assert ids(service, nested) == [3, 5]
    assert ids(service, {"joins": [{"type": "where_function"}]}) == [3]
    assert ids(service, {"type": "module", "joins": [{"type": "import", "conditions": [cond("module_name", "eq", "app.util")]}]}) == [3]
    assert ids(service, {"joins": [{"type": "module", "conditions": [cond("name", "eq", "app.util")]}]}) == [2, 4]


def test_callees(ops, mvc):
    q = {"joins": [{"type": "called_function", "conditions": [cond("name", "ilike", "%save%")]}]}
    assert ids(ops, q) == [3, 4]
    assert ids(mvc, {"conditions": [cond("name", "like", "%Controller")], "joins": [{"type": "called_function", "conditions": [cond("name", "eq", "isValid")]}]}) == [1, 2]


def test_a_switching_join_must_be_last(service):
    with pytest.raises(ValueError):
        dsl.execute(service, {"type": "module", "joins": [{"type": "function"}, {"type": "type"}]})


def test_empty_catalog(spark):
    c = fixtures.catalog(spark)
    assert ids(c, {"conditions": [cond("name", "eq", "x")]}) == []
    assert where_all(c["module"], []).count() == 0
