import pytest

from rowloom.catalog import Column, Index, Table, index_options, table_options
from rowloom.errors import InvalidDefinition, NoIndex, Unsupported
from rowloom.functions.jsontext import canonical
from rowloom.operators.access import constant_prefix
from rowloom.plans.gate import check_scan
from rowloom.types import column_type


@pytest.mark.parametrize(
    ("text", "storage", "spark"),
    [
        ("tinyint", "INT", "tinyint"), ("BOOL", "INT", "tinyint"), ("smallint", "INT", "smallint"), ("mediumint", "INT", "int"), ("INT(11)", "INT", "int"),
        ("int unsigned", "INT", "bigint"), ("bigint", "INT", "bigint"), ("bigint unsigned", "INT", "decimal(20,0)"), ("float", "FLOAT", "float"),
        ("double", "FLOAT", "double"), ("char(3)", "STRING", "string"), ("varchar(32)", "STRING", "string"), ("longtext", "STRING", "string"),
        ("varbinary(9)", "BYTES", "binary"), ("blob", "BYTES", "binary"), ("datetime", "TIMESTAMP", "timestamp"), ("timestamp(0)", "TIMESTAMP", "timestamp"), ("json", "JSON", "string"),
    ],
)
def test_types(text, storage, spark):
    t = column_type(text)
    assert (t.storage, t.spark.simpleString()) == (storage, spark)
    assert column_type(t.text) == t  # the text names the same type again


@pytest.mark.parametrize("text", ["decimal(10,2)", "date", "time", "year", "enum('a')", "set('a')", "bit(3)", "datetime(6)", "point", "varchar"])
def test_refused_types(text):
    with pytest.raises((Unsupported, InvalidDefinition)):
        column_type(text)


def table(**more):
    columns = [Column("id", "bigint"), Column("city", "varchar(32)", True), Column("age", "int")]
    return Table(**{"name": "t", "columns": columns, "key": "id"} | more)


def test_rules():
    t = table(indexes=[Index("i", "age", covering=["city"]), Index("u", "CITY", unique=True), Index("e", "city")]).validate()
    assert [i.kind for i in t.indexes] == ["RANGE", "UNIQUE", "EQ"]
    assert Table.unpacked(t.packed()) == t
    for bad in (
        {"name": "a:b"}, {"key": "nope"}, {"columns": []}, {"default_ttl": -1}, {"columns": [Column("id", "int"), Column("ID", "int")]},
        {"columns": [Column("id", "int"), Column("_x", "int")]}, {"columns": [Column("id", "double")]}, {"columns": [Column("id", "varchar(3)")], "auto_increment": True},
        {"indexes": [Index("i", "city", covering=["age"])]}, {"indexes": [Index("i", "city", unique=True, asynchronous=True)]},
        {"indexes": [Index("i", "city"), Index("I", "age")]}, {"indexes": [Index("_i", "city")]}, {"indexes": [Index(f"i{k}", "city") for k in range(17)]},
        {"columns": [Column(f"c{k}", "int") for k in range(257)], "key": "c0"},
    ):
        with pytest.raises(InvalidDefinition):
            table(**bad).validate()


def test_options():
    assert table_options("just words") == 0
    assert table_options('x:{"default_ttl": 60}') == 60
    assert index_options('x:{"covering": ["a"], "async": false}') == (["a"], False)
    for bad in ('x:{"default_ttl": -1}', 'x:{"other": 1}', 'x:{"default_ttl": "1"}', "x:{"):
        with pytest.raises(InvalidDefinition):
            table_options(bad)


@pytest.mark.parametrize(
    ("text", "want"),
    [('{"b":1,"a":2}', '{"a":2,"b":1}'), ('{"a":1,"a":2}', '{"a":2}'), ("1.0", "1"), ("1e3", "1000"), ("[1, 2 ,3]", "[1,2,3]"), ('"x"', '"x"'), ("null", "null"),
     ("1e21", "1e+21"), ("0.0000001", "1e-07"), ('{"é":"ü"}', '{"é":"ü"}'), ("0.1", "0.1")],
)
def test_canonical_json(text, want):
    assert canonical(text) == want
    assert canonical(want) == want


@pytest.mark.parametrize("text", ["{", "NaN", "", "{'a':1}", "1 2"])
def test_bad_json(text):
    with pytest.raises(ValueError):
        canonical(text)


def test_prefix_patterns():
    assert constant_prefix("abc%") == "abc"
    assert not any(map(constant_prefix, ["%", "a_%", "%a", "a%b", "abc", "a%%", "a\\%"]))


def test_gate():
    check_scan("t", 100)
    check_scan("Big", 10**6, "other, bIG")
    check_scan("t", None)
    with pytest.raises(NoIndex):
        check_scan("t", 10**6)
